"""Analytics over multidimensional complex arrays as Spark relations."""
