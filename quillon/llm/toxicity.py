"""Toxicity by maximum-scoring segments of token log-odds.

*Tokens.*  A token is a maximal run of word characters, in lower case.  Its features are the
token itself and its beginnings of ``STEMS`` characters.  Over a bounded sample of labelled
documents, each feature's log-odds of standing in a toxic against a clean document is taken with
a Dirichlet prior centred on the feature's overall rate; a token scores the greatest log-odds of
its significant features, and a small negative score where no feature is significant.

*Segments.*  All maximal scoring segments of a text are found in one linear scan (disjoint
stretches whose score can't be raised by growing or shrinking): these are its toxic passages.

*Calibration.*  Under clean text, the best segment score of n tokens follows an extreme-value
law with tail K n exp(-lambda s); lambda follows from the token scores of clean sample documents,
K from their best segments.  A document's evidence is the sum, over its segments, of what their
scores exceed the expected extreme by, in units of lambda; a logistic curve turns evidence into a
probability.  Law and curve are fitted on all sample documents, each scored by the log-odds of
the ``FOLDS`` - 1 folds it isn't in; the model itself has the log-odds of all.

Only the sample's size is bounded: every document is scored whole.  The model has the significant
features of the sample, so what is broadcast is bounded by the sample too; of each sample
document the driver gets a few numbers.

Defined results: null and empty texts have no evidence and get the curve's value at 0; without
labels of both kinds every document gets the share of toxic labels (0 without labels); several
labels of a document count as toxic if one is; repeated rows are scored again; ids and all other
columns never enter a score, and columns of any name pass by; very long texts are scanned whole;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.bpe import chunks
from quillon.llm.common import lean

#: Labelled documents that the model is fitted on, at most.
SAMPLE_DOCS = 12_000
#: Folds of the sample.
FOLDS = 3
#: Lengths of the beginnings that are features of a token.
STEMS = (3, 4, 5, 6, 7, 8)
#: Documents a feature must stand in.
MIN_DOCS = 3
#: Weight of the prior, as a share of the sample's documents, in a feature's significance and in its score.
PRIOR_SHARE, SCORE_PRIOR_SHARE = 0.2, 0.02
#: Standard errors from which a log-odds counts, and size from which a positive one does: what is merely
#: more frequent in toxic text, such as a common stem, isn't toxic.
SIGNIFICANT, STRONG = 2.5, 2.0
#: Score of a token without a significant feature, and bounds of the others.
NEUTRAL, LEAST, MOST = -0.25, -1.0, 6.0
#: Bounds and step of the score histogram.
STEP = 0.05
#: Tokens whose scores a worker keeps.
MEMO_TOKENS = 300_000

_token = re.compile(r"\w+").findall


def tokens_of(text: str | None) -> list[str]:
    return _token(text.lower()) if text else []


def features_of(token: str) -> list[str]:
    """The token as a whole (marked by a blank) and its beginnings."""
    return [f"{token} ", *(token[:k] for k in STEMS if len(token) > k or (len(token) == k))]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(begin, end, score)`` of a sequence of scores, in order.

    One pass; only positive scores cost anything, others enter through running sums.
    """
    total = np.cumsum(scores)
    stack: list[tuple[int, int, float, float]] = []  # begin, end, sum before, sum after
    links: list[int] = []  # nearest segment to the left whose sum before is less
    for i in np.flatnonzero(scores > 0).tolist():
        right = float(total[i])
        left = right - float(scores[i])
        begin = i
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = links[j]
            if j < 0 or stack[j][3] >= right:
                stack.append((begin, i + 1, left, right))
                links.append(j)
                break
            begin, left = stack[j][0], stack[j][2]
            del stack[j:], links[j:]
    return [(b, e, r - left) for b, e, left, r in stack]


@dataclass
class Model:
    """Feature log-odds, the extreme-value law of clean text, and the curve."""

    odds: dict[str, float] = field(default_factory=dict)  # a feature's score
    rate: float = 1.0  # lambda
    size: float = 1.0  # K
    bias: float = -30.0
    slope: float = 0.0
    memo: dict[str, float] = field(default_factory=dict, repr=False, compare=False)

    def token_score(self, token: str) -> float:
        found = [self.odds[f] for f in features_of(token) if f in self.odds]
        return max(found, default=NEUTRAL)

    def scores(self, tokens: list[str]) -> np.ndarray:
        memo = self.memo
        for t in set(tokens).difference(memo):
            if len(memo) >= MEMO_TOKENS:
                memo.clear()
                return self.scores(tokens) if len(set(tokens)) < MEMO_TOKENS else np.array([self.token_score(x) for x in tokens])
            memo[t] = self.token_score(t)
        return np.fromiter(map(memo.__getitem__, tokens), np.float64, len(tokens))

    def excess(self, score: float, n: int) -> float:
        """By how much a segment's score exceeds the extreme expected of ``n`` clean tokens."""
        return self.rate * score - math.log(max(1.0, self.size * n))

    def p_value(self, score: float, n: int) -> float:
        """Chance that ``n`` clean tokens have a segment of that score."""
        return -math.expm1(-math.exp(min(700.0, -self.excess(score, n) if self.size * n > 1 else math.log(max(1e-300, self.size * n)) - self.rate * score)))

    def evidence(self, found: list[tuple[int, int, float]], n: int) -> float:
        return sum(max(0.0, self.excess(s, n)) for _, _, s in found)

    def probability(self, evidence: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-700.0, min(700.0, self.bias + self.slope * math.log1p(evidence)))))

    def score(self, text: str | None) -> float:
        tokens = tokens_of(text)
        found = segments(self.scores(tokens)) if tokens else []
        return self.probability(self.evidence(found, len(tokens)))

    def passages(self, text: str | None, p: float = 0.05) -> list[tuple[int, int, float, float]]:
        """``(begin, end, score, p value)`` of each significant toxic passage, in characters."""
        lower = (text or "").lower()
        spans = [m.span() for m in re.finditer(r"\w+", lower)]
        if not spans or len(lower) != len(text):  # lowering changed lengths: spans would be off
            spans = [m.span() for m in re.finditer(r"\w+", text or "")]
            if not spans:
                return []
            scores = self.scores([text[a:b].lower() for a, b in spans])
        else:
            scores = self.scores([lower[a:b] for a, b in spans])
        out = []
        for b, e, s in segments(scores):
            value = self.p_value(s, len(spans))
            if value <= p:
                out.append((spans[b][0], spans[e - 1][1], s, value))
        return out


def log_odds(toxic: int, clean: int, n_toxic: int, n_clean: int, share: float = PRIOR_SHARE) -> tuple[float, float]:
    """A feature's log-odds ratio under the prior and its significance in standard errors."""
    n = n_toxic + n_clean
    prior = share * n
    rate = (toxic + clean) / n
    a, b = toxic + prior * rate, clean + prior * rate
    odds = math.log(a / (n_toxic + prior - a)) - math.log(b / (n_clean + prior - b))
    return odds, odds / math.sqrt(1 / a + 1 / b)


def _rate(histogram: dict[int, float]) -> float:
    """lambda: the positive root of the mean of exp(lambda score) = 1 over clean tokens."""
    total = sum(histogram.values())
    items = [(k * STEP, v / total) for k, v in histogram.items()] if total else []
    if not items or max(s for s, _ in items) <= 0 or sum(s * p for s, p in items) >= 0:
        return 1.0

    def f(x: float) -> float:
        return sum(p * math.exp(x * s) for s, p in items) - 1

    hi = 1e-3
    while f(hi) < 0 and hi < 50:
        hi *= 2
    lo = hi / 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Bias and slope of a logistic curve, lightly ridged, by Newton's steps."""
    a = np.stack([np.ones(len(x)), x], axis=1)
    w = np.array([math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)), 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + np.array([0.0, 0.05]) * w
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag([1e-9, 0.05])
        step = np.linalg.solve(h, g)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def sample_of(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_DOCS) -> DataFrame:
    """``(text, toxic, part)`` of at most ``limit`` labelled documents, those whose ids have the least
    digests; ``part`` is the fold."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    digest = F.md5(F.col("doc_id").cast("string"))
    ids = known.orderBy(digest, "doc_id").limit(limit).select(F.col("doc_id").alias("_id"), "_toxic", (F.conv(F.substring(digest, 25, 8), 16, 10).cast("long") % FOLDS).cast("int").alias("_part"))
    # at most ``limit`` rows of 16 bytes
    return docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).select("text", F.col("_toxic").alias("toxic"), F.col("_part").alias("part"))


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_DOCS) -> Model:
    """A model of the labelled documents; only ids in ``labels`` are looked at."""
    sample = sample_of(docs, labels, limit).cache()
    try:
        return _fit(sample)
    finally:
        sample.unpersist()


def odds_of(counts: list[tuple[str, list[int], list[int]]], toxic: list[int], clean: list[int], but: int = -1) -> dict[str, float]:
    """Scores of the significant features, given in how many toxic and clean documents of each fold they stand;
    the fold ``but`` is left out."""
    folds = [k for k in range(len(toxic)) if k != but]
    n_toxic, n_clean = sum(toxic[k] for k in folds), sum(clean[k] for k in folds)
    out: dict[str, float] = {}
    if not n_toxic or not n_clean:
        return out
    for feature, t, c in counts:
        a, b = sum(t[k] for k in folds), sum(c[k] for k in folds)
        if a + b < MIN_DOCS or abs(log_odds(a, b, n_toxic, n_clean)[1]) < SIGNIFICANT:
            continue
        o, _ = log_odds(a, b, n_toxic, n_clean, SCORE_PRIOR_SHARE)
        if not 0 < o < STRONG:
            # a feature of clean text must not undo a passage: its score stays near the neutral one
            out[feature] = min(MOST, o) if o > 0 else max(LEAST, NEUTRAL + 0.1 * o)
    return out


def _per_document(sample: DataFrame, models: list[Model], schema: str, row) -> list:
    """``row(toxic, tokens, scores)`` of each sample document, scored by its fold's model; a few numbers each."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                rows = []
                for text, toxic, which in zip(*(part.column(c).to_pylist() for c in ("text", "toxic", "part")), strict=True):
                    tokens = tokens_of(text)
                    rows.append((toxic > 0, *row(len(tokens), models[which].scores(tokens))))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*rows, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return sample.select("text", "toxic", "part").mapInArrow(lean("toxicity", run), schema).collect()


def _fit(sample: DataFrame) -> Model:
    sizes = {(r[0], r[1]): r[2] for r in sample.groupBy(F.col("toxic") > 0, "part").count().collect()}
    toxic, clean = ([sizes.get((kind, k), 0) for k in range(FOLDS)] for kind in (True, False))
    n_toxic, n_clean = sum(toxic), sum(clean)
    if not n_toxic or not n_clean:
        return Model(bias=30.0 if n_toxic else -30.0)

    def counted(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                found = [Counter() for _ in range(2 * FOLDS)]
                for text, y, k in zip(*(part.column(c).to_pylist() for c in ("text", "toxic", "part")), strict=True):
                    found[k + FOLDS * (y <= 0)].update({f for t in set(tokens_of(text)) for f in features_of(t)})
                names = sorted(set().union(*found))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array([x[f] for f in names], pa.int64()) for x in found]], names=["f", *columns])

    columns = [f"t{k}" for k in range(FOLDS)] + [f"c{k}" for k in range(FOLDS)]
    counts = sample.select("text", "toxic", "part").mapInArrow(lean("toxicity", counted), "f string, " + ", ".join(f"{c} long" for c in columns)).groupBy("f").agg(*[F.sum(c).alias(c) for c in columns])

    def significance(but: int):
        folds = [k for k in range(FOLDS) if k != but]
        nt, nc = sum(toxic[k] for k in folds), sum(clean[k] for k in folds)
        if not nt or not nc:
            return F.lit(0.0)
        t, c = (reduce(add, [F.col(f"{x}{k}") for k in folds]) for x in "tc")
        prior = PRIOR_SHARE * (nt + nc)
        rate = (t + c) / (nt + nc)
        a, b = t + prior * rate, c + prior * rate
        odds = F.log(a / (nt + prior - a)) - F.log(b / (nc + prior - b))
        return F.when(t + c >= MIN_DOCS, F.abs(odds / F.sqrt(1 / a + 1 / b))).otherwise(0.0)

    # what is significant over all folds or over all but one; a little less, as sums may differ in their last digits
    kept = counts.where(F.greatest(*[significance(k) for k in range(-1, FOLDS)]) > SIGNIFICANT - 1e-6).collect()
    found = [(r["f"], [r[f"t{k}"] for k in range(FOLDS)], [r[f"c{k}"] for k in range(FOLDS)]) for r in kept]
    model = Model(odds_of(found, toxic, clean))
    models = [Model(odds_of(found, toxic, clean, k)) for k in range(FOLDS)]

    def law(n: int, scores: np.ndarray):
        values, times = np.unique(np.round(scores / STEP).astype(np.int64), return_counts=True)
        return n, max((s for _, _, s in segments(scores)), default=0.0), values.tolist(), times.tolist()

    held = _per_document(sample, models, "toxic boolean, n long, best double, score array<long>, times array<long>", law)
    histogram: Counter = Counter()
    for r in held:
        if not r["toxic"]:
            histogram.update(dict(zip(r["score"], r["times"], strict=True)))
    model.rate = _rate(histogram)
    extremes = [(r["n"], r["best"]) for r in held if not r["toxic"] and r["n"]]
    weight = sum(n * math.exp(-model.rate * s) for n, s in extremes)
    model.size = len(extremes) / weight if weight else 1.0
    held = _per_document(sample, models, "toxic boolean, evidence double", lambda n, scores: (model.evidence(segments(scores), n),))
    x = np.array([math.log1p(r["evidence"]) for r in held])
    y = np.array([float(r["toxic"]) for r in held])
    model.bias, model.slope = _curve(x, y)
    model.slope = max(0.0, model.slope)
    return model


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)`` of each row of ``docs``.  Map only."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([model.score(t) for t in part.column("text").to_pylist()], pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean("toxicity", run), "doc_id long, score double")


def clean_documents(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; columns as they are."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, text_col):
                keep = pa.array([model.score(t) < threshold for t in part.column(text_col).to_pylist()], pa.bool_())
                yield part.filter(keep)

    return docs.mapInArrow(lean("toxicity", run), docs.schema)


def toxic_passages(docs: DataFrame, model: Model, p: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row ``(doc_id, begin, end, score, p_value)`` for each significant passage of each text."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                rows = [(i, *x) for i, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True) for x in model.passages(t, p)]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], names=["doc_id", "begin", "end", "score", "p_value"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean("toxicity", run), "doc_id long, begin long, end long, score double, p_value double")
