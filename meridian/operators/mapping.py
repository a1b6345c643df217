"""Maps between embedding spaces: fitting, applying, keeping.

A fit reads the pairs once, to check them and to sum the Gram matrix of
[x, y, 1], which holds what every linear map needs in both directions.  An
automatic ridge reads them once more for each direction.
"""

from __future__ import annotations

import hashlib
import math
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from meridian.functions import vec
from meridian.operators.blocks import matrix, normalized
from meridian.operators.linalg import NotUsable, least_squares, pair_gram, protocol_solve, truncated
from meridian.plans.materialize import materialize

ALPHAS = np.logspace(-3, 3, 25)
#: Bytes of pairs up to which a network is trained on the driver; beyond them each epoch is a pass over the pairs on the executors.
MLP_BYTES = 64 << 20


class MappingError(ValueError):
    """A map can't be fitted or applied."""


@dataclass
class Mapping:
    """A fitted map; weights [d_src (+1), d_tgt], inverse [d_tgt (+1), d_src] or None."""

    kind: str
    weights: np.ndarray
    inverse: np.ndarray | None
    bias: bool = False
    alpha: float | None = None
    inverse_alpha: float | None = None
    normalize_output: bool = True
    layers: dict[str, list[np.ndarray]] = field(default_factory=dict)
    recalibrator: tuple[list[float], list[float]] | None = None
    validation: dict = field(default_factory=dict)
    metadata: dict[str, str] = field(default_factory=dict)

    @property
    def d_src(self) -> int:
        return self.layers["forward"][0].shape[0] if self.layers else self.weights.shape[0] - self.bias

    @property
    def d_tgt(self) -> int:
        return self.layers["forward"][2].shape[1] if self.layers else self.weights.shape[1]

    @property
    def checksum(self) -> str:
        return hashlib.sha256(np.ascontiguousarray(self.weights).tobytes()).hexdigest()[:12]

    def with_metadata(self, **more: str) -> Mapping:
        self.metadata = self.metadata | more
        return self

    def apply(self, m: np.ndarray, inverse: bool = False) -> np.ndarray:
        """Map the rows of a matrix."""
        want = self.d_tgt if inverse else self.d_src
        if m.size and m.shape[1] != want:
            raise MappingError(f"vectors have {m.shape[1]} dimensions, the map takes {want}")
        if self.layers:
            out = _network(self.layers["inverse" if inverse else "forward"], m)
        else:
            w = self.inverse if inverse else self.weights
            if w is None:
                raise MappingError("this map has no inverse")
            out = np.c_[m, np.ones(len(m))] @ w if self.bias else m @ w
        return normalized(out) if self.normalize_output else out

    def transform(self, df: DataFrame, column: str, out: str | None = None, inverse: bool = False) -> DataFrame:
        """``df`` with the mapped column (in place, or as ``out``); works on streams alike."""
        out = out or column
        kept = [c for c in df.columns if c != out]
        fields = [f for f in df.schema.fields if f.name != out]
        at, n = len(kept), self
        packed = df.select(*[df[f"`{c}`"] for c in kept], F.col(column).cast("array<double>").alias(out))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                mapped = n.apply(matrix(batch.column(at)), inverse) if batch.num_rows else np.zeros((0, 1))
                offsets = np.arange(0, mapped.size + 1, mapped.shape[1], dtype=np.int32) if batch.num_rows else np.zeros(1, np.int32)
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(mapped.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:at], column], batch.schema.names)

        schema = packed.select(*[f"`{f.name}`" for f in fields]).schema.add(out, ArrayType(DoubleType()))
        return packed.mapInArrow(run, schema)

    def map_queries(self, df: DataFrame, column: str) -> DataFrame:
        """New-space queries to the legacy space, normalised once more."""
        mapped = self.transform(df, column, inverse=True)
        return mapped.withColumn(column, vec.l2_normalize_or_keep(F.col(column)))

    def recalibrate(self, score):
        """A score column through the recalibrator, or as it is without one."""
        return vec.interpolate(score, *self.recalibrator) if self.recalibrator else score


def validate(pairs: DataFrame, x: str = "x", y: str = "y") -> tuple[int, int, int]:
    """(rows, d_src, d_tgt) of a usable set of pairs; raises MappingError otherwise, warns when there are few."""
    a, b = F.col(x).cast("array<double>"), F.col(y).cast("array<double>")
    r = pairs.agg(F.count("*").alias("n"), F.min(F.size(a)).alias("a0"), F.max(F.size(a)).alias("a1"), F.min(F.size(b)).alias("b0"), F.max(F.size(b)).alias("b1"), F.bool_and(F.coalesce(vec.is_finite(a) & vec.is_finite(b), F.lit(False))).alias("ok")).first()
    if not r["n"]:
        raise MappingError("no pairs")
    if not r["ok"]:
        raise MappingError("pairs have missing values, or values that aren't finite")
    if r["a0"] != r["a1"] or r["b0"] != r["b1"] or r["a0"] < 1 or r["b0"] < 1:
        raise MappingError("vectors of one side differ in their dimension")
    if r["n"] < 10 * min(r["a0"], r["b0"]):
        warnings.warn(f"{r['n']} pairs are fewer than ten for each dimension", stacklevel=2)
    return r["n"], r["a0"], r["b0"]


@dataclass
class Blocks:
    """The Gram matrix of [x, y, 1] by blocks."""

    xx: np.ndarray
    xy: np.ndarray
    yy: np.ndarray
    n: int
    d_src: int
    d_tgt: int

    @classmethod
    def of(cls, pairs: DataFrame, x: str, y: str, bias: bool) -> Blocks:
        try:
            g, n, p, q = pair_gram(pairs, x, y)
        except NotUsable as error:
            raise MappingError(str(error)) from None
        if n < 10 * min(p, q):
            warnings.warn(f"{n} pairs are fewer than ten for each dimension", stacklevel=3)
        xs = [*range(p), p + q] if bias else list(range(p))
        ys = [*range(p, p + q), p + q] if bias else list(range(p, p + q))
        blocks = cls(g[np.ix_(xs, xs)], g[np.ix_(xs, range(p, p + q))], g[np.ix_(ys, ys)], n, p, q)
        blocks.yx = g[np.ix_(ys, range(p))]
        rank = int((np.linalg.eigvalsh(blocks.xx[:p, :p]) > 1e-16 * max(1.0, np.trace(blocks.xx))).sum())
        if rank < min(n, p):
            warnings.warn(f"the source vectors have rank {rank} only", stacklevel=3)
        return blocks


def _ridge(xx: np.ndarray, xy: np.ndarray, alpha: float) -> np.ndarray:
    return np.linalg.solve(xx + alpha * np.eye(len(xx)), xy)


def auto_alpha(pairs: DataFrame, xx: np.ndarray, xy: np.ndarray, x: str, y: str, bias: bool, alphas: np.ndarray = ALPHAS) -> float:
    """The alpha of least squared leave-one-out error, by one more pass: e / (1 - h) for each row and alpha."""
    values, vectors = np.linalg.eigh(xx)
    projected = vectors.T @ xy
    p = len(xx) - bias

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(alphas))
        for batch in batches:
            if batch.num_rows:
                both = matrix(batch.column(0))
                a, b = both[:, :p], both[:, p:]
                z = (np.c_[a, np.ones(len(a))] if bias else a) @ vectors
                for k, alpha in enumerate(alphas):
                    shrunk = 1 / (np.maximum(values, 0) + alpha)
                    h = (z * z * shrunk).sum(axis=1)
                    total[k] += ((((b - z @ (projected * shrunk[:, None])) / (1 - h)[:, None]) ** 2)).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(alphas), dtype=np.int32)), pa.array(total)], ["k", "e"])

    rows = pairs.select(F.concat(F.col(x).cast("array<double>"), F.col(y).cast("array<double>")).alias("v")).mapInArrow(errors, "k int, e double").groupBy("k").agg(F.sum("e").alias("e")).collect()
    return float(alphas[min(rows, key=lambda r: (r["e"], r["k"]))["k"]])


def fit_ridge(pairs: DataFrame, x: str = "x", y: str = "y", alpha: float | None = None, bias: bool = True, rank: int | None = None, kind: str = "ridge") -> Mapping:
    """Ridge both ways, with the bias penalised too; alpha None: by leave-one-out, for each direction."""
    b = Blocks.of(pairs, x, y, bias)
    forward = auto_alpha(pairs, b.xx, b.xy, x, y, bias) if alpha is None else alpha
    backward = auto_alpha(pairs, b.yy, b.yx, y, x, bias) if alpha is None else alpha
    return Mapping(kind, truncated(_ridge(b.xx, b.xy, forward), rank), truncated(_ridge(b.yy, b.yx, backward), rank), bias, forward, backward)


def fit_procrustes(pairs: DataFrame, x: str = "x", y: str = "y") -> Mapping:
    """The rotation nearest to the pairs; equal dimensions only."""
    b = Blocks.of(pairs, x, y, False)
    if b.d_src != b.d_tgt:
        raise MappingError("a rotation needs equal dimensions")
    u, _, vt = np.linalg.svd(b.xy)
    return Mapping("procrustes", u @ vt, (u @ vt).T)


def fit_procrustes_diag(pairs: DataFrame, x: str = "x", y: str = "y") -> Mapping:
    """A rotation, then a factor for each dimension; the inverse divides by the factors before rotating back."""
    b = Blocks.of(pairs, x, y, False)
    if b.d_src != b.d_tgt:
        raise MappingError("a rotation needs equal dimensions")
    u, _, vt = np.linalg.svd(b.xy)
    r = u @ vt
    s = np.diag(r.T @ b.xy) / np.maximum(np.diag(r.T @ b.xx @ r), 1e-8)
    back = np.where(np.abs(s) > 1e-8, 1 / np.where(s == 0, 1, s), 0)
    return Mapping("procrustes_diag", r * s, back[:, None] * r.T)


def fit_lowrank(pairs: DataFrame, x: str = "x", y: str = "y", rank: int | None = None, alpha: float | None = None, bias: bool = True) -> Mapping:
    """Ridge cut to a rank in both directions."""
    return fit_ridge(pairs, x, y, alpha, bias, rank, "lowrank")


def fit_protocol(pairs: DataFrame, x: str = "x", y: str = "y", plain: bool = False) -> Mapping:
    """Unnormalised least squares both ways as agents use it; plain: minimum norm without any ridge."""
    b = Blocks.of(pairs, x, y, False)
    if plain:
        return Mapping("lstsq", least_squares(b.xx, b.xy), least_squares(b.yy, b.yx), normalize_output=False)
    return Mapping("protocol", protocol_solve(b.xx, b.xy, b.n), protocol_solve(b.yy, b.yx, b.n), normalize_output=False)


_ERF = np.vectorize(math.erf)


def _gelu(z: np.ndarray) -> np.ndarray:
    return z * 0.5 * (1 + _ERF(z / math.sqrt(2)))


def _network(layers: list[np.ndarray], m: np.ndarray) -> np.ndarray:
    w1, b1, w2, b2 = layers
    out = _gelu(m @ w1 + b1) @ w2 + b2
    return out + m if m.shape[1] == out.shape[1] else out


class _Net:
    """Linear, GELU, linear, with a skip connection if square, and the state of Adam."""

    def __init__(self, p: int, q: int, hidden: int, seed: int):
        rng = np.random.default_rng(seed)
        uniform = lambda a, b: rng.uniform(-1, 1, (a, b)) / math.sqrt(a)
        self.layers = [uniform(p, hidden), np.zeros(hidden), np.zeros((hidden, q)) if p == q else uniform(hidden, q), np.zeros(q)]
        self.first, self.second, self.t = [np.zeros_like(w) for w in self.layers], [np.zeros_like(w) for w in self.layers], 0

    def step(self, gradients: list[np.ndarray], rate: float) -> None:
        self.t += 1
        for p, m, v, g in zip(self.layers, self.first, self.second, gradients):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def _gradients(layers: list[np.ndarray], x: np.ndarray, y: np.ndarray, total: int) -> list[np.ndarray]:
    """What the rows add to the gradient of the mean squared error over ``total`` values."""
    skip = x.shape[1] == y.shape[1]
    z = x @ layers[0] + layers[1]
    phi = 0.5 * (1 + _ERF(z / math.sqrt(2)))
    h = z * phi
    error = 2 * (h @ layers[2] + layers[3] + (x if skip else 0) - y) / total
    dz = (error @ layers[2].T) * (phi + z * np.exp(-z * z / 2) / math.sqrt(2 * math.pi))
    return [x.T @ dz, dz.sum(axis=0), h.T @ error, error.sum(axis=0)]


def _epoch(rows: DataFrame, nets: list[list[np.ndarray]], totals: list[int]) -> list[list[np.ndarray]]:
    """The gradients of both nets over all rows: partitions sum their part, executors add the parts, piece by piece."""
    shared = rows.sparkSession.sparkContext.broadcast(nets)  # of the networks' size
    width = 4096

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                x, y = (matrix(c) for c in batch.slice(at, 4096).columns)
                flat = np.concatenate([g.ravel() for layers, a, b, n in zip(shared.value, (x, y), (y, x), totals) for g in _gradients(layers, a, b, n)])
                total = flat if total is None else total + flat
        if total is not None:
            pieces = [total[k : k + width].tobytes() for k in range(0, total.size, width)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pieces))), pa.array(pieces, pa.binary())], ["i", "piece"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, piece in zip(*(c.to_pylist() for c in batch.columns)):
                sums[i] = sums.get(i, 0) + np.frombuffer(piece)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["i", "piece"])

    shape = "i long, piece binary"
    pieces = {r["i"]: np.frombuffer(r["piece"]) for r in rows.mapInArrow(partial, shape).repartition("i").mapInArrow(added, shape).collect()}
    shared.destroy()
    flat, out, at = np.concatenate([pieces[i] for i in range(len(pieces))]), [], 0
    for layers in nets:
        out.append([])
        for w in layers:
            out[-1].append(flat[at : at + w.size].reshape(w.shape))
            at += w.size
    return out


def fit_mlp(pairs: DataFrame, x: str = "x", y: str = "y", hidden: int | None = None, rate: float = 1e-3, epochs: int = 200, seed: int = 0, id_col: str = "id") -> Mapping:
    """Experimental: linear, GELU, linear with a skip connection if square, full-batch Adam over all pairs; one net each way.

    Up to ``MLP_BYTES`` of pairs are trained on by the driver; beyond, the
    gradients of each epoch are summed over the partitions.
    """
    n, p, q = validate(pairs, x, y)
    size = hidden or min(256, p)
    forward, inverse = _Net(p, q, size, seed), _Net(q, p, size, seed + 1)
    both = pairs.select(F.col(x).cast("array<double>").alias("x"), F.col(y).cast("array<double>").alias("y"), F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))).alias("h"))
    if n * (p + q) * 8 <= MLP_BYTES:
        rows = both.orderBy("h").toArrow()
        a, b = (matrix(rows.column(c).combine_chunks()) for c in ("x", "y"))
        for net, u, v in ((forward, a, b), (inverse, b, a)):
            for _ in range(epochs):
                net.step(_gradients(net.layers, u, v, v.size), rate)
    else:
        rows = materialize(both.select("x", "y"), "training")  # read once for each epoch
        for _ in range(epochs):
            for net, g in zip((forward, inverse), _epoch(rows, [forward.layers, inverse.layers], [n * q, n * p])):
                net.step(g, rate)
    return Mapping("mlp", np.zeros((p, q)), None, layers={"forward": forward.layers, "inverse": inverse.layers})


FITTERS = {"ridge": fit_ridge, "procrustes": fit_procrustes, "procrustes_diag": fit_procrustes_diag, "lowrank": fit_lowrank, "mlp": fit_mlp, "protocol": fit_protocol}


def register_mapping(name: str):
    """Decorator that adds a fitter to the registry."""

    def add(fitter):
        FITTERS[name] = fitter
        return fitter

    return add


def fitters_for(d_src: int, d_tgt: int) -> list[str]:
    """Names of the fitters that work for these dimensions."""
    return [n for n in FITTERS if d_src == d_tgt or not n.startswith("procrustes")]


def fit(kind: str, pairs: DataFrame, normalize_output: bool | None = None, **options) -> Mapping:
    """Fit by registered name; lowrank has rank min(256, both dimensions) unless given; normalize_output overrides the map's own."""
    fitted = _fit(kind, pairs, **options)
    if normalize_output is not None:
        fitted.normalize_output = normalize_output
    return fitted


def fit_with_holdout(kind: str, pairs: DataFrame, holdout_fraction: float = 0.1, seed: int = 0, x: str = "x", y: str = "y", id_col: str = "id", **options) -> Mapping:
    """Fit on what a hash-chosen holdout leaves, with the holdout's retention report as validation."""
    from meridian.operators.calibration import holdout
    from meridian.operators.metrics import retention_report

    split = materialize(holdout(pairs.select(id_col, x, y), holdout_fraction, seed, id_col), "split")
    fitted = fit(kind, split.where("not is_holdout").drop("is_holdout"), x=x, y=y, **options)
    rest = split.where("is_holdout").select(id_col, F.col(x).alias("v"), vec.l2_normalize(vec.doubles(y)).alias("t"))
    fitted.validation = retention_report(fitted.transform(rest, "v"), "v", "t", id_col).first().asDict()
    return fitted


def _fit(kind: str, pairs: DataFrame, **options) -> Mapping:
    if kind not in FITTERS:
        raise MappingError(f"unknown map {kind}; known: {', '.join(sorted(FITTERS))}")
    if kind == "lowrank" and "rank" not in options:
        first = pairs.select(F.size(options.get("x", "x")).alias("a"), F.size(options.get("y", "y")).alias("b")).first()
        options["rank"] = min(256, first["a"], first["b"]) if first else None
    return FITTERS[kind](pairs, **options)


def transform_sql(df: DataFrame, column: str, weights: DataFrame, d_tgt: int, id_col: str = "id") -> DataFrame:
    """(id, mapped): the map as a join with (i, j, w) and a sum, for small matrices and as a check; not normalised."""
    cells = df.select(F.col(id_col).alias("id"), F.posexplode(F.col(column).cast("array<double>")).alias("i", "value"))
    sums = cells.join(F.broadcast(weights), "i").groupBy("id", "j").agg(F.sum(F.col("value") * F.col("w")).alias("value"))
    entries = F.map_from_entries(F.collect_list(F.struct("j", "value")))
    return sums.groupBy("id").agg(entries.alias("m")).select("id", F.transform(F.sequence(F.lit(0), F.lit(d_tgt - 1)), lambda j: F.coalesce(F.col("m")[j], F.lit(0.0))).alias("mapped"))


def standardize(df: DataFrame, column: str, dims: int, whiten: bool = False, out: str = "vec") -> DataFrame:
    """``df`` with its own column means taken off, and divided by the deviations if ``whiten``."""
    v = F.col(column).cast("array<double>")
    stats = df.agg(F.array(*[F.avg(v[k]) for k in range(dims)]).alias("mean_of"), F.array(*[F.stddev_pop(v[k]) for k in range(dims)]).alias("spread_of"))
    centred = F.zip_with(v, F.col("mean_of"), lambda x, m: x - m)
    if whiten:
        centred = F.zip_with(centred, F.col("spread_of"), lambda x, s: x / F.greatest(s, F.lit(1e-12)))
    return df.crossJoin(F.broadcast(stats)).withColumn(out, centred).drop("mean_of", "spread_of")
