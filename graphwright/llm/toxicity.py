"""Toxicity: a weighted finite-state pattern grammar over clauses.

Five small transducers read the words of a clause and are composed into one
machine (``ClauseMachine``):

* insult: stems learned from labelled rows, each with a log-odds weight;
* threat: verbs of harm, which count only when the clause has a target;
* target: second- and third-person address, raises what follows or precedes it;
* negation: lowers an insult or threat within the next ``NEGATION_REACH`` words;
* reported speech: lowers what a clause only quotes.

A clause is what lies between sentence marks or line feeds.  The clause scores
of a document (sum, largest, number, density) go through a logistic model.

Learning uses labelled rows only: at most ``max_toxic`` toxic and ``max_clean``
clean rows (those with the smallest hash of ``doc_id``) that ``train`` admits.
Stems are prefixes and whole words whose counts in the two classes differ
beyond chance (G2 test).  The logistic model is fitted on scores from stems of
the other half of the sample, so it does not trust stems that only fit their
own rows.  Scoring reads the text alone.

Rows: null and empty texts have no clause and get the score of the intercept.
Repeated documents get equal scores.  A null ``doc_id`` is scored, is never a
training row and is not held out.  Without labels of both classes every score
is 0.  An empty table gives no rows.  ``keep`` returns the columns it got,
whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import slices

THRESHOLD = 0.7
MAX_TOXIC, MAX_CLEAN = 4_000, 12_000
MIN_G2, MIN_ROWS, MAX_STEMS = 30.0, 4, 5_000
STEM_LENGTHS = (4, 5, 6, 7)
NEGATION_REACH = 3
SLICE = 4 << 20  # bytes of text that a worker turns into Python strings at a time
NEGATED, REPORTED, TARGETED, THREAT_WEIGHT = 0.2, 0.4, 1.25, 4.0

# Closed word classes of the grammar.
TARGETS = frozenset("you your yours yourself u he she they him her them his their vous tu toi ton ta du dich dir "
                    "sie ihr euch tú ti usted ustedes vosotros".split())
NEGATIONS = frozenset("not no never neither nor without isnt arent wasnt dont doesnt didnt cannot ne pas jamais "
                      "sans nicht kein keine nie ohne nunca jamás sin tampoco".split())
REPORTS = frozenset("said says say quoted quote reported reports wrote writes claimed claims alleged dit "
                    "écrit sagte schrieb dijo escribió".split())
THREATS = frozenset("kill hurt destroy murder stab shoot strangle beat burn hang tuer frapper töten schlagen "
                    "matar golpear".split())

WORD = re.compile(r"[^\W\d_]+")
EDGE = re.compile(r"[.!?;\n]+")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def stems(word: str):
    """Whole word (marked with a final ``$``) and its prefixes."""
    yield word + "$"
    for k in STEM_LENGTHS:
        if len(word) >= k:
            yield word[:k]


class ClauseMachine:
    """The composed transducers; ``lexicon`` maps a stem to its weight."""

    def __init__(self, lexicon: dict[str, float]):
        import ahocorasick
        self.lexicon = lexicon
        self.finder = ahocorasick.Automaton()
        for s in {s.rstrip("$") for s in lexicon} | THREATS:
            self.finder.add_word(s, len(s))
        self.finder.make_automaton()

    def insult(self, word: str) -> float:
        return max((self.lexicon.get(s, 0.0) for s in stems(word)), default=0.0)

    def clause(self, words: list[str]) -> float:
        """Weight of one clause: one pass, each word moves the negation, report
        and target states and may emit weight."""
        negated = reported = targeted = 0
        emitted, threat = 0.0, 0.0
        for w in words:
            if w in NEGATIONS:
                negated = NEGATION_REACH
                continue
            if w in REPORTS:
                reported = 1
                continue
            if w in TARGETS:
                targeted = 1
            else:
                scale = (NEGATED if negated else 1.0) * (REPORTED if reported else 1.0)
                emitted += scale * self.insult(w)
                if w in THREATS:
                    threat += scale * THREAT_WEIGHT
            negated = max(0, negated - 1)
        return emitted * (TARGETED if targeted else 1.0) + (threat if targeted else 0.0)

    def features(self, text: str | None) -> tuple[float, float, float, float]:
        """(log sum, largest, log number, log density) of the scoring clauses."""
        text = (text or "").lower()
        places = [end - size + 1 for end, size in self.finder.iter(text)]
        places = [p for p in places if p == 0 or not text[p - 1].isalpha()]
        if not places:
            return 0.0, 0.0, 0.0, 0.0
        places.sort()
        scores, stop = [], -1
        for p in places:
            if p < stop:
                continue
            start = max(text.rfind(m, 0, p) for m in ".!?;\n") + 1
            edge = EDGE.search(text, p)
            stop = edge.start() if edge else len(text)
            s = self.clause(WORD.findall(text, start, stop))
            if s > 0:
                scores.append(s)
        if not scores:
            return 0.0, 0.0, 0.0, 0.0
        total = sum(scores)
        words = len(text) / 6 + 20
        return math.log1p(total), max(scores) / 10, math.log1p(len(scores)), math.log1p(100 * total / words)


class Model:
    def __init__(self, lexicon: dict[str, float], weights: np.ndarray | None):
        self.lexicon, self.weights = lexicon, weights

    def scorer(self):
        machine = ClauseMachine(self.lexicon)

        def score(texts: list) -> np.ndarray:
            if self.weights is None:
                return np.zeros(len(texts))
            x = np.array([machine.features(t) for t in texts]).reshape(-1, 4)
            return 1 / (1 + np.exp(-(self.weights[0] + x @ self.weights[1:])))
        return score


def _sample(labels: DataFrame, train: Column, max_toxic: int, max_clean: int) -> DataFrame:
    """(doc_id, toxic): bounded by the two parameters."""
    rows = labels.where(train & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)) \
        .select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    return (rows.where("toxic = 1").orderBy(*order).limit(max_toxic)
            .unionByName(rows.where("toxic = 0").orderBy(*order).limit(max_clean)))


def _count_stems(batches):
    """Rows with each stem, added up within a slice."""
    for b in slices(batches, 1, SLICE // 4):
        counts: dict[tuple[int, int], Counter] = {}
        for doc_id, text, toxic in zip(*(c.to_pylist() for c in b.columns)):
            seen = {s for w in set(WORD.findall(text.lower())) for s in stems(w)}
            counts.setdefault((doc_id % 2, toxic), Counter()).update(seen)
        for (fold, toxic), c in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array(list(c)), pa.array([fold] * len(c), pa.int32()),
                                              pa.array([toxic] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())],
                                             ["stem", "fold", "toxic", "n"])


def _g2(a, b, n1, n0):
    """Likelihood-ratio statistic of a stem in ``a`` of ``n1`` and ``b`` of ``n0`` rows."""
    p = (a + b) / (n1 + n0)
    terms = ((a, n1 * p), (b, n0 * p), (n1 - a, n1 * (1 - p)), (n0 - b, n0 * (1 - p)))
    return 2 * sum(np.where(x > 0, x * np.log(np.maximum(x, 1e-12) / np.maximum(e, 1e-12)), 0) for x, e in terms)


def _lexicon(rows, n1: int, n0: int) -> dict[str, float]:
    a, b = rows["a"].to_numpy(float), rows["b"].to_numpy(float)
    odds = np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1))
    keep = (a >= MIN_ROWS) & (odds > 1.5) & (_g2(a, b, n1, n0) >= MIN_G2)
    best = rows.assign(w=odds)[keep].sort_values(["w", "stem"], ascending=[False, True]).head(MAX_STEMS)
    return dict(zip(best["stem"], best["w"].round(4)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    x = np.hstack([np.ones((len(x), 1)), x])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-6), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, train: Column | None = None,
        max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model:
    """Learn the stems and the logistic model from labelled rows that ``train`` admits."""
    sample = _sample(labels, F.lit(True) if train is None else train, max_toxic, max_clean)
    # bounded by max_toxic + max_clean rows of two numbers
    rows = (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
            .join(F.broadcast(sample), "doc_id").select("doc_id", "text", "toxic"))
    per_fold = (rows.mapInArrow(_count_stems, "stem string, fold int, toxic int, n bigint")
                .groupBy("stem").agg(*(F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == t), F.col("n")).otherwise(0))
                                       .alias(f"n{f}{t}") for f in (0, 1) for t in (0, 1)))
                .where(F.col("n01") + F.col("n11") >= MIN_ROWS)
                .where("n01 + n11 > 0.02 * (n00 + n10)").toPandas())
    size = rows.groupBy(F.pmod("doc_id", F.lit(2)).alias("f"), "toxic").count().collect()
    n = Counter({(r.f, r.toxic): r["count"] for r in size})
    pos, neg = n[0, 1] + n[1, 1], n[0, 0] + n[1, 0]
    if not pos or not neg:
        return Model({}, None)

    def lexicon(folds):
        part = per_fold.assign(a=sum(per_fold[f"n{f}1"] for f in folds), b=sum(per_fold[f"n{f}0"] for f in folds))
        return _lexicon(part, sum(n[f, 1] for f in folds), sum(n[f, 0] for f in folds))

    other = {f: lexicon((1 - f,)) for f in (0, 1)}

    def featured(batches):
        machines = {f: ClauseMachine(lex) for f, lex in other.items()}
        for b in slices(batches, 1, SLICE):
            ids, texts, toxic = (c.to_pylist() for c in b.columns)
            x = np.array([machines[i % 2].features(t) for i, t in zip(ids, texts)]).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, k]) for k in range(4)), b.column(2)],
                                             ["a", "b", "c", "d", "toxic"])

    seen = rows.mapInArrow(featured, "a double, b double, c double, d double, toxic int").toPandas()
    seen = seen.sort_values(list(seen.columns))
    return Model(lexicon((0, 1)), _logistic(seen[["a", "b", "c", "d"]].to_numpy(), seen["toxic"].to_numpy(float)))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = shared.value.scorer()
        for b in slices(batches, 2, SLICE):
            s = scorer(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s),
                                              pa.array((s >= threshold).astype(np.int32))],
                                             ["doc_id", "held_out", "score", "predicted"])

    return (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"),
                        F.coalesce("text", F.lit("")).alias("text"))
            .mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int"))


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        scorer = shared.value.scorer()
        for b in slices(batches, at, SLICE):
            yield b.filter(pa.array(scorer(b.column(at).to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)
