"""From documents to training sequences: five stages, each over all rows that the one before it kept.

The result of a stage is to be written before the next one begins, as run() does: its tables are then dropped.

Cases: decisions are made for rows, so a row that is repeated whole leaves once, rows with one doc_id and different
texts are documents of their own, and rows without doc_id count like others (of equals they come last); a null text
is empty and stays null; texts of any length are read whole; an empty table gives an empty result; columns beyond
those of documents are not read, and none of these may be missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import exact, packing, simhash, substrings, toxicity
from gridloom.llm.common import Scratch, among, release

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Tables of the stage before, dropped when the next stage no longer reads them.
_LEFT: list[Scratch] = []


def _begin(spark: SparkSession, docs: DataFrame, name: str) -> Scratch:
    """A folder for the tables of a stage. Those of the stage before go: its result has been written and is read from there.

    Where docs still read them (a result that was not written), they stay until the process ends."""
    work = Scratch(spark, name)
    read = docs.inputFiles() if _LEFT else ()
    for old in _LEFT[:]:
        if not any(old.root in f for f in read):
            old.drop()
            _LEFT.remove(old)
    release(spark)  # shuffles of the stage before
    _LEFT.append(work)
    return work


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def _numbered(docs: DataFrame, work: Scratch) -> DataFrame:
    """The documents with an own number (rid) for each row, written out, so that every reading sees the same numbers.

    Decisions are made for rows and joined by rid: doc_ids may be repeated or null."""
    return work.write(_documents(docs).withColumn("rid", F.monotonically_increasing_id()), "rows")


def _first_of_each(spark: SparkSession, rows: DataFrame, groups: DataFrame, work: Scratch, *order) -> DataFrame:
    """Of each group (groups: doc_id, which is a rid, and group) the first row in this order, then by doc_id (nulls last) and rid."""
    keys = rows.select(F.col("rid"), F.struct(*order, F.col("doc_id").isNull(), "doc_id", "rid").alias("o"))
    first = keys.join(groups.select(F.col("doc_id").alias("rid"), "group"), "rid").groupBy("group").agg(F.min("o").alias("o"))
    first = work.write(first.select("o.rid"), "first")
    for name in ("runs", "index"):
        work.drop(name)
    release(spark)
    return _documents(among(rows, first, "rid", work, "bitmaps"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar scores 0.5 or more go."""
    _begin(spark, docs, "toxicity-stage")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out(F.col("doc_id")))
    model = toxicity.fit(spark, docs, labels)
    return toxicity.keep_clean(_documents(docs), model)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space the longest stays, of those the one with the smallest doc_id."""
    work = _begin(spark, docs, "exact-stage")
    rows = _numbered(docs, work)
    groups = exact.exact_duplicates(spark, rows, id_col="rid", work=work).select("doc_id", F.col("keep_id").alias("group"))
    return _first_of_each(spark, rows, groups, work, -F.coalesce(F.length("text"), F.lit(0)))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the smallest doc_id stays."""
    work = _begin(spark, docs, "near-stage")
    rows = _numbered(docs, work)
    groups = simhash.near_duplicate_groups(spark, rows, words=5, similarity=0.8, id_col="rid", numbered=True).select("doc_id", F.col("component_id").alias("group"))
    return _first_of_each(spark, rows, groups, work)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that stand in repeats of 35 words or more go; a document left without words goes."""
    work = _begin(spark, docs, "substring-stage")
    own = F.struct("doc_id", "lang", "source", "n_chars", F.col("text").isNull().alias("no_text"))
    cut = substrings.remove_repeats(spark, docs, window=35, with_text=True, carry=own, work=work).where("n_words = 0 or n_removed < n_words")
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("row.n_chars")).cast("long").alias("n_chars")
    return cut.select("row.doc_id", F.when(~F.col("row.no_text"), F.col("kept")).alias("text"), "row.lang", "row.source", n_chars)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their ids, placed in sequences."""
    import public_tokenizers

    _begin(spark, docs, "packing-stage")
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), segments=packing.SEGMENTS, forget=True)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("substring dedup", substring_stage),
    ("packing", packing_stage),
]

#: Fingerprints, a fitted model and packing cannot be expressed in SQL; the pipeline is tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read as the next one's input."""
    work = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = work.write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before:
            work.drop(before)
        before = name.replace(" ", "-")
    return STAGES[-1][1](spark, docs, sf_dir)
