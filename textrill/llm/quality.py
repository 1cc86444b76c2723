"""Quality classifier by positive-unlabelled learning (operator 3).

Trusted positives and unlabelled web text are all that it learns from. With the class prior c, the
risk of a score g is

    c * E_pos[loss(g)]  +  max(0, E_unl[loss(-g)] - c * E_pos[loss(-g)])

The second part estimates the risk on negatives; without the bound at 0 a flexible model drives it below, which no
true risk is. With the logistic loss and a linear g the unbounded sum is convex: Newton steps minimise it over all
rows, each a distributed sum of a few hundred numbers. Where a step ends with the second part below
0, the next one raises that part again instead; the best bounded risk seen is kept.

The prior is estimated from positives and unlabelled rows alone: a first model with an even prior orders the rows, and above any
score the share of unlabelled rows over that of positives is the prior plus what negatives there are. It is taken at the score
where its upper confidence bound is least (best bin estimation). All rows are unlabelled text, those with a label among them, and labels
other than a trusted positive are not used. The features are statistics of the text's signs, words and lines; nothing else of the row is read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType

from textrill.llm.bpe_automaton import text_batches
from textrill.llm.common import fresh, give_back, table
from textrill.session import materialise

FOLDS = 5
CUT = 0.3
RIDGE = 1e-3
STEPS = 12
TEXT_RUN = 1 << 20
BINS = 2000
FIRST_PRIOR, FIRST_RIDGE = 0.5, 0.2
DELTA, GAMMA = 0.1, 0.01

_SIGNS = b".,;:!?|%$&#*@=+/\\<>{}[]()_~^\"'-"
_FEATURES = 30


def features(text: str) -> list[float]:
    """Statistics of a whole text, each of a size around 1; an empty text has zeros."""
    if not text:
        return [0.0] * _FEATURES
    data = text.encode()
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = len(data)
    share = lambda k: math.log1p(100.0 * k / n)
    upper, lower = int(counts[65:91].sum()), int(counts[97:123].sum())
    signs = [int(counts[b]) for b in _SIGNS]
    words = text.split()
    kinds = Counter(words)
    m = max(1, len(words))
    lines = [x for x in text.split("\n") if x]
    k = max(1, len(lines))
    most = kinds.most_common(1)[0][1] if kinds else 0
    again = sum(map(str.__eq__, words, words[1:]))
    held = counts[counts > 0] / n
    return [
        1.0,
        math.log1p(n) / 8, math.log1p(len(words)) / 6, math.log1p(n / m) / 2,
        share(upper), math.log1p(100.0 * upper / (1 + upper + lower)), share(lower), share(int(counts[48:58].sum())),
        share(int(counts[32])), share(int(counts[10])), share(int(counts[128:].sum())),
        share(sum(signs)), *(share(s) for s in signs[:8]),
        share(signs[8] + signs[9] + signs[10] + signs[11]), share(sum(signs[12:])), share(int(counts[:32].sum() - counts[10])),
        len(kinds) / m, math.log1p(100.0 * most / m), math.log1p(100.0 * again / m),
        len(set(lines)) / k, math.log1p(n / k) / 5,
        float(-(held * np.log2(held)).sum()) / 5,
        math.log1p(max(map(len, words), default=0)) / 3,
    ][:_FEATURES]


def softplus(g: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, g)


def sigmoid(g: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0.0, -g))


@dataclass(frozen=True)
class Model:
    """Weights over features scaled by ``(x - mean) / spread``; ``prior`` alone where nothing was learned."""

    weights: tuple[float, ...]
    mean: tuple[float, ...]
    spread: tuple[float, ...]
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(x), self.prior)
        return sigmoid(scaled(x, np.array(self.mean), np.array(self.spread)) @ np.array(self.weights))


def scaled(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / spread, -8.0, 8.0)
    z[:, 0] = 1.0
    return z


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS, F.lit(0)) == 0


def with_features(docs: DataFrame, column: str) -> DataFrame:
    """Add the features of the text as a binary of doubles; every other column passes through."""

    schema = StructType([*docs.schema.fields, StructField(column, BinaryType())])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in text_batches(batch, at, TEXT_RUN):
                rows = [np.array(features(t), "<f8").tobytes() for t in texts]
                part = batch.slice(begin, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, pa.binary())], schema.names)
        give_back()

    return docs.mapInArrow(run, schema)


def _sums(rows: DataFrame, of) -> dict[str, np.ndarray]:
    """Sum ``of(matrix)`` over all rows (``u``) and over the trusted positives (``p``): one partial sum per task, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            trusted = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<f8").reshape(len(trusted), -1)
            for role, some in (("u", x), ("p", x[trusted])):
                if len(some):
                    total[role] = total[role] + of(some) if role in total else of(some)
        for role, part in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([role] * len(part)), pa.array(range(len(part)), pa.int32()), pa.array(part)],
                ["role", "i", "v"],
            )

    found = rows.select("trusted", "x").mapInArrow(run, "role string, i int, v double")
    out: dict[str, np.ndarray] = {}
    for r in found.groupBy("role", "i").agg(F.sum("v").alias("v")).orderBy("role", "i").collect():
        out.setdefault(r["role"], []).append(r["v"])
    return {role: np.array(v) for role, v in out.items()}


def fit(rows: DataFrame, prior: float, ridge: float = RIDGE) -> Model:
    """Learn from ``(trusted, x)``: all rows are unlabelled text, the trusted ones are positives besides."""
    moments = _sums(rows, lambda x: np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)]))
    if "p" not in moments or "u" not in moments:
        return Model((), (), (), prior)
    n_p, n_u, d = moments["p"][0], moments["u"][0], (len(moments["u"]) - 1) // 2
    mean = moments["u"][1 : d + 1] / n_u
    spread = np.sqrt(np.maximum(moments["u"][d + 1 :] / n_u - mean**2, 0.0))
    spread[spread < 1e-6] = 1.0
    upper = np.triu_indices(d)

    def part(w: np.ndarray):
        def of(x: np.ndarray) -> np.ndarray:
            z = scaled(x, mean, spread)
            g = z @ w
            s = sigmoid(g)
            hess = (z * (s * (1 - s))[:, None]).T @ z
            return np.concatenate([[softplus(g).sum(), softplus(-g).sum()], z.T @ s, z.sum(axis=0), hess[upper]])

        return of

    pull = np.full(d, ridge)
    pull[0] = 0.0
    w = np.zeros(d)
    best, best_w = np.inf, w
    for _ in range(STEPS):
        sums = _sums(rows, part(w))
        p, u = sums["p"] / n_p, sums["u"] / n_u
        negative = u[0] - prior * p[0]
        risk = prior * p[1] + max(0.0, negative)
        if risk + 0.5 * (pull * w * w).sum() < best:
            best, best_w = risk + 0.5 * (pull * w * w).sum(), w
        hess = np.zeros((d, d))
        hess[upper] = u[2 + 2 * d :]
        hess = hess + np.triu(hess, 1).T + np.diag(pull + 1e-6)
        if negative < 0:  # raise the part that fell below 0
            step = np.linalg.solve(hess, u[2 : 2 + d] - prior * p[2 : 2 + d])
        else:
            step = -np.linalg.solve(hess, u[2 : 2 + d] - prior * p[2 + d : 2 + 2 * d] + pull * w)
        step *= min(1.0, 4.0 / max(1e-12, float(np.abs(step).max())))
        if float(np.abs(step).max()) < 1e-4:
            break
        w = w + step
    return Model(tuple(best_w.tolist()), tuple(mean.tolist()), tuple(spread.tolist()), prior)


def best_bin(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The class prior from the counts of positives and of unlabelled rows per bin of the score, lowest first."""
    n_p, n_u = positive.sum(), unlabelled.sum()
    above_p, above_u = np.cumsum(positive[::-1]) / n_p, np.cumsum(unlabelled[::-1]) / n_u
    some = above_p > 0
    ratio = above_u[some] / above_p[some]
    slack = (math.sqrt(math.log(4 / DELTA) / (2 * n_u)) + math.sqrt(math.log(4 / DELTA) / (2 * n_p))) / above_p[some]
    return float(min(1.0, max(1 / n_u, ratio[(ratio + (1 + GAMMA) * slack).argmin()])))


def estimated_prior(rows: DataFrame) -> float:
    """The class prior of ``(trusted, x)``; ``FIRST_PRIOR`` where there are no positives."""
    first = fit(rows, FIRST_PRIOR, FIRST_RIDGE)
    if not first.weights:
        return FIRST_PRIOR
    counts = _sums(rows, lambda x: np.bincount((first.score(x) * (BINS - 1)).astype(int), minlength=BINS).astype(float))
    return best_bin(counts["p"], counts["u"])


def training_rows(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``(trusted, x)`` of all rows with features.

    Labels count only outside the held-out fold. A document with several labels is trusted if all are positive; labels that
    are null, neither 0 nor 1, or without a document count for nothing. Repeated rows of one id are trusted each.
    """
    known = (
        labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("quality").alias("_quality")).where("_quality = 1")
    )
    told = rows.select("doc_id", "_x").join(known, "doc_id", "left")
    return told.select(F.col("_quality").isNotNull().alias("trusted"), F.col("_x").alias("x"))


def learn(docs: DataFrame, labels: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and the written features ``(doc_id, _x)`` of every row."""
    rows = materialise(with_features(docs.select("doc_id", "text"), "_x").drop("text"), "quality-features")
    told = materialise(training_rows(rows, labels), "quality-roles")
    return fit(told, estimated_prior(told)), rows


def scored(rows: DataFrame, model: Model, column: str, into: str) -> DataFrame:
    """Replace the features column by the score."""
    kept = [c for c in rows.columns if c != column]
    schema = StructType([*rows.select(*kept).schema.fields, StructField(into, DoubleType())])
    at = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(at).to_pylist()), "<f8").reshape(batch.num_rows, -1)
            scores = model.score(x) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(scores)], schema.names)

    return rows.select(*kept, column).mapInArrow(run, schema)


def judged(docs: DataFrame, model: Model, into: str) -> DataFrame:
    """Add the score of the text; every other column passes through."""
    schema = StructType([*docs.schema.fields, StructField(into, DoubleType())])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in text_batches(batch, at, TEXT_RUN):
                scores = model.score(np.array([features(t) for t in texts]))
                yield pa.RecordBatch.from_arrays([*batch.slice(begin, len(texts)).columns, pa.array(scores)], schema.names)
        give_back()

    return docs.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``cut``, with their columns.

    Rows are scored where they stand, so texts aren't shuffled, rows without an id or with one that repeats
    are judged by their own text, and an empty table stays empty. Without trusted positives nothing is
    learned and nothing is rejected.
    """
    model, _ = learn(docs, labels)
    if not model.weights:
        return docs
    names = {c: f"c{i}" if c != "text" else c for i, c in enumerate(docs.columns)}
    plain = docs.select(*(F.col(c).alias(n) for c, n in names.items()))
    score = fresh(plain, "score")
    return judged(plain, model, score).where(F.col(score) >= cut).select(*(F.col(n).alias(c) for c, n in names.items()))


def op3_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document. Null and empty texts have features of zeros, and are scored; repeated rows stay,
    each with the score of its own text; a row without an id counts as held out."""
    model, rows = learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored(rows, model, "_x", "score").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"),
    )
