"""A quality classifier: random Fourier features, ridge regression and isotonic calibration.

Each document gives 16 statistics of its whole text.  Standardised, and held
within six deviations, they are mapped to cosines of random projections, which
approximate a Gaussian kernel.  Every partition sums its part of the normal
equations over the labelled documents, by fold; the parts are added by row blocks
on the executors, so the driver gets a few matrices of fixed size.

Calibration is the isotonic regression of the labels on the documents' own
scores, each by the fit that left its fold out.  Scores are range-partitioned;
each partition pools its adjacent violators, and the driver pools the partitions'
pools, which gives what pooling all rows at once gives.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.isotonic import pooled
from meridian.llm.text import texts_of, type_of, words
from meridian.plans.materialize import materialize

FEATURES = 256
WIDTH = 3.0
RIDGE = 1e-3
FOLDS = 4
CUTOFF = 0.5
STATISTICS = (
    "log_words", "word_length", "long_words", "distinct_words", "top_word", "top_pair", "letters", "capitals", "digits", "spaces",
    "marks", "full_stops", "repeated_lines", "line_length", "byte_entropy", "bars",
)
_KIND = np.zeros((256, 8))
for _c in range(256):
    _KIND[_c] = [chr(_c).isalpha() or _c >= 128, 65 <= _c <= 90, 48 <= _c <= 57, _c in b" \t\r\n", 33 <= _c < 127 and not chr(_c).isalnum(), _c in b".?!,", _c in b"|<>{}[]\\^~", 0]


def statistics(text: str | None) -> list[float]:
    """The 16 statistics of a text; zeros for a null text or one without words."""
    found = words(text)
    if not found:
        return [0.0] * len(STATISTICS)
    raw = text.encode("utf-8", "replace")
    n, count = len(found), Counter(found)
    codes = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = codes / len(raw)
    letters, capitals, digits, spaces, marks, stops, bars, _ = share @ _KIND
    some = share[share > 0]
    lines = [line for line in text.split("\n") if line]
    pairs = Counter(zip(found, found[1:]))
    return [
        np.log1p(n), sum(map(len, found)) / n, sum(k for w, k in count.items() if len(w) > 12) / n, len(count) / n, max(count.values()) / n,
        max(pairs.values(), default=0) / n, letters, capitals, digits, spaces, marks, stops, 1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(len(raw) / max(1, len(lines))), float(-(some * np.log2(some)).sum()), bars,
    ]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): the statistics of each row of ``docs``."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([statistics(t) for t in texts_of(batch.column(1))], pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(measure, f"doc_id {type_of(docs, id_col)}, x array<double>")


class Model:
    """The fitted map from statistics to calibrated probabilities."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.directions = rng.normal(size=(mean.size, FEATURES)) / WIDTH
        self.phases = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights, self.points = np.zeros(FEATURES + 1), (np.zeros(1), np.zeros(1))

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features and a constant."""
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.directions + self.phases), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lift(x) @ self.weights

    def calibrate(self, pools: list[list[float]]) -> None:
        """Take the breakpoints of the map from scores to probabilities."""
        self.points = (np.array([e for p in pools for e in p[:2]]), np.array([p[2] for p in pools for _ in "ab"]))

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), *self.points)


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def fit(stats: DataFrame, labels: DataFrame, label_id_col: str = "doc_id", label_col: str = "quality", seed: int = 1) -> Model:
    """Fit on every labelled row of ``stats`` (a table of features())."""
    marks = labels.select(F.col(label_id_col).cast(type_of(stats, "doc_id")).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("y").alias("y"))
    known = materialize(stats.join(marks, "doc_id").select("x", "y", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold")), "labelled")
    size = len(STATISTICS)
    moments = known.agg(*[f(F.col("x")[k]).alias(f"{n}{k}") for k in range(size) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    model = Model(np.array([moments[f"m{k}"] or 0.0 for k in range(size)]), np.array([moments[f"s{k}"] or 0.0 for k in range(size)]), seed)
    width = FEATURES + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, width, width + 1))
        for batch in batches:
            z, y, fold = model.lift(_matrix(batch.column(0))), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for k in range(FOLDS):
                own = z[fold == k]
                total[k] += own.T @ np.c_[own, y[fold == k]]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FOLDS * width)), pa.array([r.tobytes() for r in total.reshape(-1, width + 1)], pa.binary())], ["i", "row"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows[i] = rows.get(i, 0) + np.frombuffer(row)
        yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()), pa.array([r.tobytes() for r in rows.values()], pa.binary())], ["i", "row"])

    shape = "i long, row binary"
    rows = {r["i"]: np.frombuffer(r["row"]) for r in known.mapInArrow(partial, shape).repartition("i").mapInArrow(added, shape).collect()}
    if not rows:
        return model
    folds = np.stack([rows[i] for i in range(FOLDS * width)]).reshape(FOLDS, width, width + 1)
    total = folds.sum(axis=0)
    if not total[-1, -2]:
        return model
    solve = lambda part: np.linalg.solve(part[:, :-1] + RIDGE * max(1.0, part[-1, -2]) * np.eye(width), part[:, -1])
    model.weights = solve(total)
    without = [solve(total - fold) for fold in folds]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, fold = model.lift(_matrix(batch.column(0))), batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array((z * np.stack(without)[fold]).sum(axis=1)), batch.column(1)], ["score", "y"])

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pools: list[list[float]] = []
        for batch in batches:
            x, y, n = (batch.column(c).to_numpy().astype(float) for c in range(3))
            pools = pooled(*(np.r_[[p[k] for p in pools], new] for k, new in enumerate((x, x, y, n))))
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pools], pa.float64()) for k in range(4)], ["low", "high", "y", "n"])

    # pools of adjacent violators are few: at most about n^(2/3) of n labels that are 0 or 1
    levels = known.mapInArrow(scored, "score double, y int").groupBy("score").agg(F.avg("y").alias("y"), F.count("*").alias("n"))
    pools = levels.repartitionByRange("score").sortWithinPartitions("score").mapInArrow(pool, "low double, high double, y double, n double").toArrow().sort_by("low")
    model.calibrate(pooled(*(pools.column(c).to_numpy() for c in ("low", "high", "y", "n"))))
    return model


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality", cutoff: float = CUTOFF, seed: int = 1) -> DataFrame:
    """One row for each row of ``docs``: (doc_id, score, keep).

    score is the calibrated probability of good quality, keep whether it reaches
    ``cutoff``.

    Ids can be of any type.  Nulls: a null text, as one without words, has score 0; a null id is kept;
    labels with a null id or label are ignored.  Very long texts are measured
    whole.  Repeated rows are scored alike; contradictory labels count as bad;
    tied scores share a probability.  Without labels every score is 0; an empty
    table gives no rows.  Other columns are not read.
    """
    stats = materialize(features(docs, id_col, text_col), "statistics")
    model = fit(stats.where("x[0] > 0"), labels, label_id_col, label_col, seed)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            score = np.where(x[:, 0] > 0, model.score(x), 0.0) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(score >= cutoff)], ["doc_id", "score", "keep"])

    return stats.mapInArrow(judge, f"doc_id {type_of(docs, id_col)}, score double, keep boolean")
