"""Line deduplication in DataFrame operations only.

Texts are taken apart once: a line becomes the hash of its key, with its document and position, and these are written.
They are range-partitioned by hash and document and sorted within, the largest document first and lines by position;
the document is part of the range, so a line of a third of all documents is split over tasks. The sorted rows are
streamed (an aggregation by sort order, without a further exchange): each document shows a hash once, by its first
occurrence, and of the documents of a hash the first one, which is the largest, keeps it. Only a count and that first
document of each hash leave a range, so ranges that share a hash merge a row each. What comes back to a document is a
keep bitmap in words of 64 lines, of which only words with a zero are stored; the text itself is shuffled once, to
meet its bitmap, and only dropped lines ever leave it.

A key is two 64-bit hashes with different seeds, so that a clash (2^-128 a pair) does not arise.

Cases: null and empty texts are one empty line; keys shorter than min_chars never drop; a doc_id that occurs in
several rows counts as one document, and its rows (told apart by their text) share decisions; rows repeated
whole share them too; a null doc_id is one document, smaller than any other; an empty table gives an empty result;
other columns are not read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, Scratch, ascii_lower, release


def _row_key():
    return F.xxhash64(F.lit(3), F.col("text"))


def keep_bitmaps(spark: SparkSession, docs: DataFrame, work: Scratch, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, row_key, words): for rows of docs (doc_id, text) that lose lines, a map from word number to keep bits, of words with a zero."""
    lines = docs.select("doc_id", _row_key().alias("row_key"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    key = ascii_lower(F.btrim("line", F.lit(SPACES)))
    lines = lines.select("doc_id", "row_key", "pos", key.alias("key")).where(F.length("key") >= min_chars)
    lines = work.write(lines.select(F.xxhash64("key").alias("h"), F.xxhash64(F.lit(11), "key").alias("g"), "doc_id", "row_key", "pos"), "lines")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ("h", "g", F.desc_nulls_last("doc_id"))
    ranged = lines.repartitionByRange(parts, *order).sortWithinPartitions(*order, "row_key", "pos")
    # first() of a struct is aggregated by sort order, which the ranges have
    seen = ranged.groupBy("h", "g", "doc_id").agg(F.first(F.struct("row_key", "pos")).alias("first"))
    common = seen.groupBy("h", "g").agg(F.count("first").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs)
    # written, so that the join's sides are plain exchanges, of which Spark splits the partition of a hot line
    common = work.write(common.select("h", "g", "keeper"), "common")
    gone = lines.join(common, ["h", "g"]).where("not (doc_id <=> keeper)").select("doc_id", "row_key", "pos")
    word = F.expr("pos div 64").cast("int").alias("word")
    bits = gone.groupBy("doc_id", "row_key", word).agg(F.bitwise_not(F.bit_or(F.expr("shiftleft(1L, pos % 64)"))).alias("bits"))
    return bits.groupBy("doc_id", "row_key").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))


def drop_common_lines(spark: SparkSession, docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, n_lines, n_dropped, text (the lines that stay, joined by a line feed)."""
    work = Scratch(spark, "lines")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    maps = work.write(keep_bitmaps(spark, docs, work, min_chars, min_docs), "bitmaps")
    work.drop("lines")
    work.drop("common")
    release(spark)
    own = docs.select("doc_id", _row_key().alias("row_key"), "text").alias("own")
    same = F.col("own.doc_id").eqNullSafe(F.col("maps.doc_id")) & (F.col("own.row_key") == F.col("maps.row_key"))
    rows = own.join(maps.alias("maps"), same, "left").select("own.doc_id", "text", "words")
    rows = rows.withColumn("lines", F.split("text", "\n", -1))
    stays = "shiftright(coalesce(try_element_at(words, cast(i div 64 as int)), -1L), cast(i % 64 as int)) & 1L"
    kept = F.expr(f"filter(lines, (x, i) -> ({stays}) = 1L)")
    dropped = F.aggregate(F.map_values("words"), F.lit(0), lambda a, b: a + F.bit_count(F.bitwise_not(b)))
    whole = F.col("words").isNull()
    return rows.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.when(whole, 0).otherwise(dropped).cast("long").alias("n_dropped"), F.when(whole, F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_common_lines(spark, docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d
), k AS (
  SELECT r, doc_id, pos, line,
         translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), c AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT k.*, (c.key IS NOT NULL AND k.doc_id <> c.keeper) AS gone FROM k LEFT JOIN c ON k.key = c.key
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines,
       CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""
