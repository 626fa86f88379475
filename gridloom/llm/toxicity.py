"""Toxicity by a weighted finite-state pattern grammar.

Five transducers read a clause (what stands between marks of punctuation) word by word: insult, threat, target,
negation and reported speech. Each is a set of states with arcs, given as data: an arc reads a kind of word, goes to
a state, and may weigh an insult at that place by a factor; at the end of a clause final arcs weigh what was matched.
They are composed into one machine, whose states are the reachable tuples of theirs and whose factors are products,
so a clause is scored by one walk: an insult or threat opens a match, a target raises it, a negation in the few words
before it or a verb of saying lowers it. Single words never score: features of a document are those of its clauses.

Insults and their weights are learned from labelled documents: words and word beginnings (so that inflected forms
share one entry) by the log-odds of the documents that hold them. The other kinds of words are a lexicon, which is a
parameter. A document is scored by its matched clauses through a logistic model of a few features, fitted on other
labelled documents than those that gave the entries.

The fit sees at most `max_labelled` labelled documents (default 10,000), chosen by a hash of their identifier;
scoring covers every row. Labels, language, source and identifier are never inputs of a score.

Cases: null and empty texts have no clause and get the score of no match; texts of any length are read whole;
labels that are null or not 0 or 1 are left out; a table without positive or negative labels gives the share of
positives (0 without labels) as every score; repeated rows are scored each; an empty table gives an empty
result; other columns are not read."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, batch, blocks, tidy

#: Labelled documents that a fit sees at most.
MAX_LABELLED = 10_000
#: Lengths of word beginnings that can be entries.
STEMS = (4, 5, 6)

#: Words of the kinds that are not learned, as a default; English, German, French and Spanish.
LEXICON = {
    "threat": frozenset("kill hurt destroy burn beat shoot stab attack punish regret die bleed töte töten schlage tuer frapper brûler matar quemar golpear".split()),
    "target": frozenset("you your yours yourself he she him her they them their du dich dir dein ihr euch sie tu te toi ton vous votre tú te usted ustedes ellos".split()),
    "negation": frozenset("not no never isn aren wasn don doesn nicht kein keine nie ne pas jamais aucun nunca jamás".split()),
    "report": frozenset("said says say wrote called quoted claims claimed reported according sagte sagt schrieb dit disait écrit dijo dice escribió".split()),
}

_WORDS = re.compile(r"[^\W\d_]+").findall
_CLAUSES = re.compile(r"[.!?;:,\n|()\"]+")

#: Kinds of words as bits; a word may be of several.
KINDS = {"insult": 1, "threat": 2, "target": 4, "negation": 8, "report": 16}
NEAR = 3  # words after a negation in which it lowers a match


@dataclass(frozen=True)
class Transducer:
    """arcs: (state, kind of word) -> (state, factor of an insult there). Kind "" stands for any other word.

    Where a word has a kind without an arc from the state, the arc of "" is taken; without that, the state stays."""

    start: str
    arcs: dict[tuple[str, str], tuple[str, float]]

    def states(self) -> set[str]:
        return {self.start, *(s for s, _ in self.arcs), *(s for s, _ in self.arcs.values())}

    def step(self, state: str, kinds: int) -> tuple[str, float]:
        for kind, bit in KINDS.items():
            if kinds & bit and (state, kind) in self.arcs:
                return self.arcs[state, kind]
        return self.arcs.get((state, ""), (state, 1.0))


#: The grammar: transducers, and for final states (of insult, threat and target) what a clause gets: (factor, sum).
TRANSDUCERS = {
    "insult": Transducer("none", {("none", "insult"): ("some", 1.0)}),
    "threat": Transducer("none", {("none", "threat"): ("some", 1.0)}),
    "target": Transducer("none", {("none", "target"): ("aimed", 1.0)}),
    "negation": Transducer("0", {("0", "negation"): (str(NEAR), 1.0)} | {(str(k), "negation"): (str(NEAR), 0.3) for k in range(1, NEAR + 1)} | {(str(k), ""): (str(k - 1), 0.3) for k in range(1, NEAR + 1)}),
    "report": Transducer("own", {("own", "report"): ("said", 1.0), ("said", ""): ("said", 0.5)}),
}
#: Final arcs: a threat needs somebody it is aimed at; what is aimed weighs more.
FINALS = {
    ("some", "none", "none"): (1.0, 0.0),
    ("some", "none", "aimed"): (1.25, 0.0),
    ("none", "some", "none"): (0.0, 0.0),
    ("none", "some", "aimed"): (1.25, 1.0),
    ("some", "some", "none"): (1.0, 1.0),
    ("some", "some", "aimed"): (1.25, 1.0),
    ("none", "none", "none"): (0.0, 0.0),
    ("none", "none", "aimed"): (0.0, 0.0),
}


class Machine:
    """The composition: for state and kinds (a number) the next state and the factor, and for each state what a clause gets."""

    def __init__(self, parts: dict[str, Transducer] = TRANSDUCERS, finals: dict = FINALS):
        order = list(parts)
        first = tuple(p.start for p in parts.values())
        number, todo, self.arcs = {first: 0}, [first], []
        while todo:
            state = todo.pop(0)
            row = []
            for kinds in range(1 << len(KINDS)):
                moves = [parts[name].step(s, kinds) for name, s in zip(order, state, strict=True)]
                to = tuple(m[0] for m in moves)
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                row.append((number[to], math.prod(m[1] for m in moves)))
            self.arcs.append(row)
        own = [order.index(k) for k in ("insult", "threat", "target")]
        self.finals = [finals[tuple(s[i] for i in own)] for s in number]
        self.aimed_threat = [s[own[1]] == "some" and s[own[2]] == "aimed" for s in number]

    def clause(self, symbols: list[tuple[int, float]]) -> tuple[float, bool]:
        """(score, whether it is an aimed threat) of a clause, given as kinds and weights of its words."""
        state, total = 0, 0.0
        for kinds, weight in symbols:
            state, factor = self.arcs[state][kinds]
            if weight:
                total += weight * factor
        factor, more = self.finals[state]
        return (total + more) * factor, self.aimed_threat[state]


def entries_of(word: str):
    """What can be an entry of the insult transducer for a word: itself, and its beginnings with a star."""
    yield word
    for n in STEMS:
        if len(word) > n:
            yield word[:n] + "*"


class Symbols(dict):
    """Word -> (kinds, weight), from weights of entries and the lexicon; words of usual length are remembered up to MOST."""

    MOST, USUAL = 100_000, 32

    def __init__(self, entries: dict[str, float], lexicon: dict):
        self.entries, self.lexicon = entries, lexicon

    def __missing__(self, word: str) -> tuple[int, float]:
        get = self.entries.get
        weight = max([get(e, 0.0) for e in entries_of(word)])
        kinds = sum(KINDS[k] for k, words in self.lexicon.items() if word in words) | KINDS["insult"] * (weight > 0)
        if weight > 0:
            kinds &= ~KINDS["threat"]  # an entry has its learned weight
        if len(word) <= self.USUAL:
            if len(self) >= self.MOST:
                self.clear()
            self[word] = kinds, weight
        return kinds, weight


class Opens(dict):
    """Word -> whether it can open a match, for words of usual length."""

    def __init__(self, symbols: Symbols, kinds: int):
        self.symbols, self.kinds = symbols, kinds

    def __missing__(self, word: str) -> int:
        found = self.symbols[word][0] & self.kinds
        if len(word) <= Symbols.USUAL:
            if len(self) >= Symbols.MOST:
                self.clear()
            self[word] = found
        return found


class Grammar:
    """The composed machine and the words it knows."""

    OPENS = KINDS["insult"] | KINDS["threat"]

    def __init__(self, entries: dict[str, float], lexicon: dict | None = None):
        self.entries, self.lexicon = entries, LEXICON if lexicon is None else lexicon
        self.symbols, self.machine = Symbols(entries, self.lexicon), Machine()
        self.opening = Opens(self.symbols, self.OPENS)

    def __reduce__(self):
        return Grammar, (self.entries, self.lexicon)

    def features(self, text: str) -> list[float]:
        """Of the clauses: the best and the second best score, their sum and number, the share that matches, and whether one is an aimed threat."""
        text = text.lower()
        if not any(map(self.opening.__getitem__, _WORDS(text))):
            return [0.0] * 6
        symbols, opens, machine = self.symbols, self.OPENS, self.machine
        scores, n, threat = [], 0, False
        for c in _CLAUSES.split(text):
            own = [symbols[w] for w in _WORDS(c)]
            if not own:
                continue
            n += 1
            if any([k & opens for k, _ in own]):
                score, aimed = machine.clause(own)
                threat = threat or aimed
                if score > 0:
                    scores.append(score)
        if not scores:
            return [0.0] * 6
        scores.sort(reverse=True)
        second = scores[1] if len(scores) > 1 else 0.0
        return [min(scores[0], 10.0), min(second, 10.0), math.log1p(sum(scores)), math.log1p(len(scores)), len(scores) / n, float(threat)]


class Model:
    """score() of a text; weights None: the share of positives stands for every text."""

    def __init__(self, grammar: Grammar, weights: np.ndarray | None, prior: float):
        self.grammar, self.weights, self.prior = grammar, weights, prior

    def score(self, text: str) -> float:
        if self.weights is None:
            return self.prior
        z = float(np.dot(self.weights[1:], self.grammar.features(text)) + self.weights[0])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights (first the intercept) by Newton steps with a ridge penalty."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


_COUNTS = pa.schema([("entry", pa.string()), ("half", pa.int8()), ("y", pa.int8()), ("n", pa.int64())])


@tidy
def _counts(batches):
    """(entry, half, label, documents) of a batch; half halves the labelled documents. An empty entry counts all."""
    for b in blocks(batches, 0):
        found: dict[tuple, Counter] = {}
        for text, y, half in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            c = found.setdefault((half, y), Counter())
            c[""] += 1
            c.update({e for w in set(_WORDS((text or "").lower())) for e in entries_of(w)})
        if rows := [(e, half, y, n) for (half, y), c in found.items() for e, n in c.items()]:
            yield batch(_COUNTS, *zip(*rows, strict=True))


_FEATURES = pa.schema([("y", pa.int8()), ("x", pa.list_(pa.float64()))])


@tidy
def _features(batches, grammars):
    for b in blocks(batches, 0):
        rows = [(y, grammars[half].features(text or "")) for text, y, half in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)]
        if rows:
            yield batch(_FEATURES, *zip(*rows, strict=True))


def _weigh(counts: list, keep: set[int]) -> dict[str, float]:
    """Weights of entries from the documents of these halves: log-odds, less the more uncertain they are."""
    n, total = {}, [0, 0]
    for e, half, y, k in counts:
        if half in keep:
            if e == "":
                total[y] += k
            else:
                n.setdefault(e, [0, 0])[y] += k
    out = {}
    for e, (neg, pos) in n.items():
        if pos >= 3:
            odds = math.log((pos + 0.5) / (total[1] + 1)) - math.log((neg + 0.5) / (total[0] + 1))
            sure = odds - 1.0 * math.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5)) - 0.5
            if sure > 1.0:
                out[e] = min(5.0, sure)
    return out


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, lexicon: dict | None = None) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, toxic), of which max_labelled at most are used; lexicon: kinds of words as in LEXICON."""
    work = Scratch(spark, "toxicity")
    y = labels.select("doc_id", F.col("toxic").cast("byte").alias("y")).where("doc_id is not null and y in (0, 1)").distinct()
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_labelled)  # bounded, so it can be broadcast
    sample = docs.select("doc_id", "text").join(F.broadcast(y), "doc_id")
    sample = work.write(sample.select("text", "y", F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(2)).cast("byte").alias("half")), "sample")
    counts = sample.mapInArrow(_counts, "entry string, half byte, y byte, n long").groupBy("entry", "half", "y").agg(F.sum("n").alias("n"))
    counts = work.write(counts, "counts")
    useful = counts.where("y = 1 and entry <> ''").groupBy("entry").agg(F.sum("n").alias("pos")).where("pos >= 3")
    against = counts.where("y = 0 and entry <> ''").groupBy("entry").agg(F.sum("n").alias("neg"))
    sizes = {r.y: r.n for r in counts.where("entry = ''").groupBy("y").agg(F.sum("n").alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    if not pos or not neg:
        return Model(Grammar({}, lexicon), None, 1.0 if pos else 0.0)
    odd = useful.join(against, "entry", "left").where(F.col("pos") * neg > 2 * F.coalesce("neg", F.lit(0)) * pos)
    # entries of the bounded sample of labelled documents: they are bounded as well
    rows = counts.join(odd.select("entry"), "entry").union(counts.where("entry = ''")).select("entry", "half", "y", "n").collect()
    rows = [tuple(r) for r in rows]
    # features of each half come from entries of the other: a model fitted on its own entries trusts rare ones too much
    halves = [Grammar(_weigh(rows, {1}), lexicon), Grammar(_weigh(rows, {0}), lexicon)]
    fitted = sample.mapInArrow(partial(_features, grammars=halves), "y byte, x array<double>").collect()
    work.drop()
    x, t = np.array([r.x for r in fitted]), np.array([r.y for r in fitted], float)
    order = np.lexsort((*x.T, t))
    return Model(Grammar(_weigh(rows, {0, 1}), lexicon), fit_logistic(x[order], t[order]), pos / (pos + neg))


_OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


@tidy
def _score(batches, model):
    for b in batches:
        yield batch(_OUT, b.column(0), [model.score(t.as_py() or "") for t in b.column(1)])


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(partial(_score, model=model), "doc_id long, score double")


@tidy
def _keep(batches, model, column, limit):
    for b in batches:
        yield b.filter(pa.array([model.score(t.as_py() or "") < limit for t in b.column(column)], pa.bool_()))


def keep_clean(docs: DataFrame, model: Model, limit: float = 0.5, text_col: str = "text") -> DataFrame:
    """Rows of docs, with all their columns, whose score is below the limit."""
    return docs.mapInArrow(partial(_keep, model=model, column=docs.columns.index(text_col), limit=limit), docs.schema)


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id")))
    scored = score_documents(docs, fit(spark, docs, labels))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
