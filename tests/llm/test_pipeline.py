import brute
import corpus_pipeline
from gridloom.llm import common, toxicity
from gridloom.llm.common import Scratch


def test_stages_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    work, seen = Scratch(spark, "test"), [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = work.write(stage(spark, docs, d), name.replace(" ", "-"))
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        seen.append(docs)
    texts = [{r.doc_id: r.text for r in x.collect()} for x in seen]
    model = toxicity.fit(spark, seen[0], spark.read.parquet(f"{d}/labels.parquet").where(~toxicity.held_out(toxicity.F.col("doc_id"))))
    assert texts[1] == {i: t for i, t in texts[0].items() if model.score(t or "") < 0.5}
    assert texts[2] == {r[0]: texts[1][r[0]] for r in brute.exact(texts[1].items()) if r[3]}
    assert set(texts[3]) == {i for i, g in brute.near_groups(texts[2]).items() if i == g}
    ids = sorted(texts[3])
    for i, (n, gone, sha) in zip(ids, brute.repeats([texts[3][i] for i in ids]), strict=True):
        assert (i in texts[4]) == (n == 0 or gone < n)
        if i in texts[4]:
            assert brute.sha(texts[4][i] or "") == sha if gone else texts[4][i] == texts[3][i]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, d).collect()
    brute.check_packing(sorted(texts[4].items()), [(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.sequence_id, r.offset) for r in last])


def test_run_gives_the_same_rows(spark):
    d = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, d)
    assert out.agg({"length": "sum"}).first()[0] > 0 and "ids" in out.columns


def test_rows_with_repeated_and_null_ids(spark):
    long = " ".join(f"v{i}" for i in range(60))
    other = " ".join(f"u{i}" for i in range(60))
    rows = [(1, long), (1, long), (2, "few words"), (2, "few words"), (3, other), (3, "another text of id 3"), (None, "without id"), (None, "without id"), (None, "also without id"), (4, other + "\n"), (5, None), (5, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    want = sorted([(1, long), (2, "few words"), (4, other + "\n"), (3, "another text of id 3"), (None, "without id"), (None, "also without id"), (5, None)], key=str)
    work = Scratch(spark, "test")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        docs = work.write(stage(spark, docs, ""), name.replace(" ", "-"))
        assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=str) == want, name


def test_near_stage_keeps_one_row_of_one_id(spark):
    text = " ".join(f"v{i}" for i in range(200))
    rows = [(7, text), (7, text), (7, text + " end"), (None, text), (None, "x " + text), (9, "nothing alike")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_stage(spark, docs, "").collect()
    assert sorted(r.doc_id for r in got) == [7, 9]


def test_empty_table_and_further_columns(spark):
    docs = spark.createDataFrame([(1, "some words here", "en", "s", 15, "x", 7)], "doc_id long, text string, lang string, source string, n_chars long, row string, rid long")
    for rows, want in ((docs, [1]), (docs.limit(0), [])):
        work, now = Scratch(spark, "test"), rows
        for name, stage in corpus_pipeline.STAGES[1:4]:
            now = work.write(stage(spark, now, ""), name.replace(" ", "-"))
            assert now.columns == list(corpus_pipeline.COLUMNS) and [r.doc_id for r in now.collect()] == want
        assert len({r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, now, "").collect()}) == len(want)


def test_rows_that_stay_are_chosen_without_shuffling_texts(spark):
    text = " ".join(f"v{i}" for i in range(200))
    rows = [(i, text + " end" * (i % 3)) for i in range(30)] + [(i, f"text number {i} " + text[i:]) for i in range(30, 60)] + [(99, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables that are not small
    try:
        for stage in (corpus_pipeline.exact_stage, corpus_pipeline.near_stage):
            out = stage(spark, docs, "")
            assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString(), stage
            assert len({r.doc_id for r in out.collect()}) == out.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_among_gives_the_rows_of_the_numbers(spark, monkeypatch):
    numbers = [0, 1, 63, 64, 4095, 4096, 8191, -1, -64, -4097, (3 << 33) + 5, 2**63 - 1, -(2**63)]
    rows = spark.createDataFrame([(x + d,) for x in numbers for d in (-1, 0, 1) if -(2**63) <= x + d < 2**63], "id long")
    given = sorted(r.id for r in rows.collect())
    for chunks in (common.CHUNKS, 0):  # bitmaps, then rows shuffled
        monkeypatch.setattr(common, "CHUNKS", chunks)
        for wanted in (numbers, []):
            some = spark.createDataFrame([(x,) for x in wanted * 2], "id long")
            got = common.among(rows, some, "id", Scratch(spark, "test"), "bits")
            assert sorted(r.id for r in got.collect()) == sorted(x for x in given if x in wanted)
