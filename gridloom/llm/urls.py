"""URL filters as a temporal list join, in DataFrame operations only.

A list is a history: dated entries that add a host suffix to the list or take it off. Per
entry the next event ends the validity of the one before (lead over its dates), which gives intervals
[valid_from, valid_to). A capture is evaluated as of its fetch time: its host is broken into its suffixes, which
are joined by equality with the entries, and the interval must hold the fetch time. The list is broadcast only
where its count is at most BROADCAST rows, else the join is by shuffle, where Spark splits skewed keys. Only
the identifier, the URL and the fetch time of a capture take part; page texts are never read.

Cases: a null URL, one without a host, or a null fetch time matches nothing and is allowed; events of one entry
and one time: a removal wins; repeated events change nothing; rows repeated whole are evaluated each; hosts are
compared in lower case without port, user and final dot; an empty table or list gives no match; other columns,
whatever their names, are not read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Rows of a list up to which it is broadcast.
BROADCAST = 50_000

#: Entries of the list that op10 applies, beside those of history(): (pattern, action, date). A pattern is a host suffix.
EVENTS = [
    ("spam-farm.example.org", "add", "2024-01-10"),
    ("cheap-pills.example.com", "add", "2024-01-01"),
    ("cheap-pills.example.com", "remove", "2024-05-01"),
    ("cheap-pills.example.com", "add", "2024-08-15"),
    ("blog.ththan.example.net", "add", "2024-03-01"),
    ("ththan.example.net", "add", "2024-06-01"),
    ("ththan.example.net", "remove", "2024-09-01"),
    ("example.info", "add", "2024-02-01"),
    ("m.therou.example.com", "add", "2024-01-01"),
    ("m.therou.example.com", "remove", "2024-01-01"),
    ("therha.example.com", "add", "2024-11-20"),
]
#: Captures of the test tables carry no time; op10 takes it from the identifier: a day of 2024.
FETCH_DAYS = 366


def intervals(events: DataFrame) -> DataFrame:
    """(pattern, valid_from, valid_to) from events (pattern, action, at): valid_to is null while an entry is active."""
    e = events.select(F.lower("pattern").alias("pattern"), (F.col("action") == "add").cast("int").alias("adds"), F.col("at").cast("timestamp").alias("at"))
    e = e.where("pattern is not null and at is not null and adds is not null").groupBy("pattern", "at").agg(F.min("adds").alias("adds"))
    w = Window.partitionBy("pattern").orderBy("at")
    e = e.withColumn("before", F.lag("adds", 1, 0).over(w)).where("adds <> before")  # repeated events change nothing
    e = e.withColumn("valid_to", F.lead("at").over(w))
    return e.where("adds = 1").select("pattern", F.col("at").alias("valid_from"), "valid_to")


def host_of(url):
    """Host in lower case, without user, port and final dot; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    host = F.rtrim(host, F.lit("."))
    return F.when(host != "", host)


def suffixes(host):
    """The host and what follows each of its dots."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    tails = F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."))
    return F.array_distinct(tails)


def history(hosts: DataFrame) -> DataFrame:
    """Events (pattern, action, at) of a made-up list that grows with the hosts: about an eighth of them are entered on some day of 2024, half of these are taken off later."""
    code = lambda k: F.expr(f"ascii(substr(m, {k}, 1))")
    entered = hosts.select(F.col("host").alias("pattern"), F.md5("host").alias("m")).where("host is not null").distinct().where("substr(m, 1, 1) in ('0', '1')")
    entered = entered.withColumn("day", code(2) * 3 % FETCH_DAYS).withColumn("later", F.col("day") + 1 + code(3) * 2)
    at = lambda d: F.expr(f"cast(timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval({d}) as timestamp)").alias("at")
    off = entered.where("substr(m, 4, 1) in ('0', '1', '2', '3', '4', '5', '6', '7')")
    return entered.select("pattern", F.lit("add").alias("action"), at("day")).union(off.select("pattern", F.lit("remove").alias("action"), at("later")))


def filter_captures(captures: DataFrame, events: DataFrame) -> DataFrame:
    """captures (page_id, url, fetched_at) with host, blocked, and matched: the longest pattern active at the time."""
    lists = Scratch(captures.sparkSession, "urls").write(intervals(events), "lists")
    if lists.limit(BROADCAST + 1).count() <= BROADCAST:
        lists = F.broadcast(lists)
    rows = captures.select("page_id", "url", F.col("fetched_at").cast("timestamp").alias("fetched_at"), host_of(F.col("url")).alias("host"))
    named = ["page_id", "url", "fetched_at"]
    rows = rows.withColumns({"row": F.xxhash64(*named), "row2": F.xxhash64(F.lit(11), *named)})  # together 128 bits
    probes = rows.where("host is not null").select("row", "row2", "fetched_at", F.explode(suffixes(F.col("host"))).alias("pattern")).distinct()
    hits = probes.join(lists, "pattern").where("valid_from <= fetched_at and (valid_to is null or fetched_at < valid_to)")
    best = hits.groupBy("row", "row2").agg(F.max(F.struct(F.length("pattern").alias("n"), "pattern")).alias("m")).select("row", "row2", F.col("m.pattern").alias("matched"))
    return rows.join(best, ["row", "row2"], "left").select("page_id", "url", "fetched_at", "host", F.col("matched").isNotNull().alias("blocked"), "matched")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    at = F.expr(f"timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(pmod(page_id, {FETCH_DAYS}) as int))").cast("timestamp")
    events = spark.createDataFrame(EVENTS, "pattern string, action string, at string").withColumn("at", F.to_timestamp("at"))
    events = events.union(history(pages.select(host_of(F.col("url")).alias("host"))))
    found = filter_captures(pages.select("page_id", "url", at.alias("fetched_at")), events)
    return found.select("page_id", "host", F.pmod(F.col("page_id"), F.lit(FETCH_DAYS)).cast("int").alias("fetch_day"), "blocked", "matched")


OP10_SQL = rf"""
WITH p AS (
  SELECT row_number() OVER () AS r, page_id, TIMESTAMP '2024-01-01' + to_days(CAST(page_id % {FETCH_DAYS} AS INTEGER)) AS fetched_at,
         nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '.'), '') AS host
  FROM pages
), n AS (
  SELECT pattern, m, ascii(substr(m, 2, 1)) * 3 % {FETCH_DAYS} AS day, ascii(substr(m, 3, 1)) * 2 + 1 AS more
  FROM (SELECT DISTINCT host AS pattern, md5(host) AS m FROM p WHERE host IS NOT NULL) WHERE substr(m, 1, 1) IN ('0', '1')
), h AS (
  SELECT pattern, 'add' AS action, TIMESTAMP '2024-01-01' + to_days(CAST(day AS INTEGER)) AS ts FROM n
  UNION ALL
  SELECT pattern, 'remove', TIMESTAMP '2024-01-01' + to_days(CAST(day + more AS INTEGER)) FROM n WHERE substr(m, 4, 1) <= '7'
  UNION ALL
  SELECT pattern, action, CAST(d AS TIMESTAMP) FROM (VALUES {", ".join(map(str, EVENTS))}) t(pattern, action, d)
), e AS (
  SELECT pattern, ts, min(CASE WHEN action = 'add' THEN 1 ELSE 0 END) AS adds FROM h GROUP BY pattern, ts
), c AS (
  SELECT * FROM (SELECT *, lag(adds, 1, 0) OVER (PARTITION BY pattern ORDER BY ts) AS before FROM e) WHERE adds <> before
), i AS (
  SELECT * FROM (SELECT pattern, adds, ts AS valid_from, lead(ts) OVER (PARTITION BY pattern ORDER BY ts) AS valid_to FROM c) WHERE adds = 1
), s AS (
  SELECT r, fetched_at, array_to_string(labels[k:], '.') AS pattern
  FROM (SELECT r, fetched_at, string_split(host, '.') AS labels, unnest(generate_series(1, len(string_split(host, '.')))) AS k FROM p WHERE host IS NOT NULL)
), m AS (
  SELECT s.r, max_by(i.pattern, length(i.pattern)) AS matched FROM s JOIN i ON s.pattern = i.pattern
  WHERE i.valid_from <= s.fetched_at AND (i.valid_to IS NULL OR s.fetched_at < i.valid_to) GROUP BY s.r
)
SELECT page_id, host, CAST(page_id % {FETCH_DAYS} AS INTEGER) AS fetch_day, matched IS NOT NULL AS blocked, matched
FROM p LEFT JOIN m ON p.r = m.r
"""
