import random
import zlib

from gridloom.llm import toxicity


def test_held_out_accuracy_and_columns(spark):
    d = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in toxicity.op9_toxicity(spark, d).collect()}
    rows = [(got[r.doc_id].score, r.toxic) for r in spark.read.parquet(f"{d}/labels.parquet").collect() if r.toxic is not None and got[r.doc_id].held_out]
    pos, neg = [s for s, y in rows if y == 1], [s for s, y in rows if y == 0]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    right = (sum(p >= 0.5 for p in pos) + sum(n < 0.5 for n in neg)) / len(rows)
    assert auc > 0.95 and right > 0.95, (auc, right)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())


def grammar():
    return toxicity.Grammar({"idiot*": 2.0})


def test_clauses_are_scored_not_words():
    g = grammar()
    score = lambda s: g.machine.clause([g.symbols[w] for w in s.split()])[0]
    plain = score("what an idiotic thing")
    assert score("you idiots") > plain > score("not an idiotic thing") > 0
    assert score("he said what an idiotic thing") < plain
    assert score("we burn wood") == 0 < score("i will burn you")


def test_edge_rows_and_missing_labels(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "idiot " * 50000, 1), (3, "idiot", 1)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(spark, docs, none)
    assert [r.score for r in toxicity.score_documents(docs, model).collect()] == [0.0] * 4
    bad = spark.createDataFrame([(1, None), (None, 1), (2, 7)], "doc_id long, toxic int")
    assert toxicity.fit(spark, docs, bad).weights is None
    assert toxicity.score_documents(docs.limit(0), model).collect() == []


def test_labels_of_the_held_out_fold_change_nothing(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet")
    models = [toxicity.fit(spark, docs, x.where(~toxicity.held_out(x["doc_id"]))) for x in (labels, labels.selectExpr("doc_id", f"case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - toxic else toxic end as toxic"))]
    assert models[0].weights.tolist() == models[1].weights.tolist() and models[0].grammar.entries == models[1].grammar.entries


def test_machine_is_the_composition_of_the_transducers():
    """Clauses scored by a plain loop over the words, without states."""
    g, rng = toxicity.Grammar({"idiot*": 2.0, "fool": 1.5}), random.Random(2)
    words = ["idiots", "fool", "kill", "you", "not", "said", "thing", "a", "never", "they"]
    for _ in range(3000):
        c = [rng.choice(words) for _ in range(rng.randint(0, 9))]
        total = 0.0
        for i, w in enumerate(c):
            weight = {"idiots": 2.0, "fool": 1.5}.get(w, 0.0)
            weight *= 0.3 if {"not", "never"} & set(c[max(0, i - toxicity.NEAR) : i]) else 1.0
            total += weight * (0.5 if "said" in c[:i] else 1.0)
        insult, threat, aimed = {"idiots", "fool"} & set(c), "kill" in c, {"you", "they"} & set(c)
        total += 1.0 if threat and (insult or aimed) else 0.0
        want = total * (1.25 if aimed else 1.0) if insult or (threat and aimed) else 0.0
        got = g.machine.clause([g.symbols[w] for w in c])
        assert abs(got[0] - want) < 1e-12 and got[1] == bool(threat and aimed), c


def test_long_words_and_all_entries_count():
    word = "x" * 5000
    named = ["w" + "".join(chr(97 + int(c)) for c in str(i)) for i in range(30_000)]
    g = toxicity.Grammar({word: 3.0} | dict.fromkeys(named, 1.0))
    assert g.features(f"you {word}")[0] > 3 and g.features(f"you {named[-1]}")[0] > 1 and g.features("you " + word[:-1])[0] == 0
