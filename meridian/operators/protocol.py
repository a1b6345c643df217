"""Agents exchanging vectors: calibration of a pair, transfer, fallback to text, negotiation, health.

A model row is (source, target, valid_until timestamp, quality double, weights
array<array<double>>): one row for each direction.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from meridian.functions import vec
from meridian.operators.mapping import Mapping, fit_protocol

VALID_DAYS = 7
#: Bytes of all models' weights that are sent to every executor.
WEIGHT_BYTES = 64 << 20
MIN_QUALITY = 0.7
MODEL = "source string, target string, created timestamp, valid_until timestamp, training double, quality double, worst double, weights array<array<double>>"


class ProtocolError(RuntimeError):
    """Something agents can react to; recoverable ones fall back to text."""

    recoverable = True

    def __init__(self, message: str, **context):
        super().__init__(message)
        self.context = context


class NotCalibrated(ProtocolError):
    pass


class MatrixExpired(ProtocolError):
    pass


class CalibrationFailed(ProtocolError):
    recoverable = False


def vocabulary(spark: SparkSession, stems: list[str], prefixes: list[str], suffixes: list[str], size: int) -> DataFrame:
    """(text): stems and their affixed forms, distinct, ``size`` of them in hash order."""
    one = lambda words, name: spark.createDataFrame([(w,) for w in ["", *words]], f"{name} string")
    forms = spark.createDataFrame([(s,) for s in stems], "stem string").crossJoin(F.broadcast(one(prefixes, "p"))).crossJoin(F.broadcast(one(suffixes, "s")))
    return forms.select(F.concat("p", "stem", "s").alias("text")).distinct().orderBy(F.md5("text"), "text").limit(size)


def round_trip(pairs: DataFrame, mapping: Mapping, column: str = "x", id_col: str = "id") -> DataFrame:
    """(id, sim): cosine of a vector with itself after there and back."""
    there = mapping.transform(pairs.select(id_col, F.col(column).alias("v0")), "v0", "there")
    back = mapping.transform(there, "there", "back", inverse=True)
    return back.select(F.col(id_col).alias("id"), vec.cosine_unclipped(vec.doubles("v0"), F.col("back")).alias("sim"))


def similarity_summary(sims: DataFrame, column: str = "sim") -> DataFrame:
    """(mean, median, std, min, max, n): the median is the midpoint, the deviation that of a population."""
    return sims.agg(F.avg(column).alias("mean"), F.median(column).alias("median"), F.stddev_pop(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"), F.count("*").alias("n"))


def calibrate(spark: SparkSession, train: DataFrame, validation: DataFrame, source: str, target: str, threshold: float = MIN_QUALITY, x: str = "x", y: str = "y", id_col: str = "id") -> tuple[DataFrame, Mapping]:
    """(two model rows, the map) fitted on train and judged by round trips of validation."""
    mapping = fit_protocol(train, x, y)
    trained = similarity_summary(round_trip(train, mapping, x, id_col)).first()["mean"]
    found = similarity_summary(round_trip(validation, mapping, x, id_col)).first()
    if found["mean"] is None or found["mean"] < threshold:
        raise CalibrationFailed(f"round trips reach {found['mean']}, below {threshold}", source=source, target=target)
    rows = [(a, b, float(trained), float(found["mean"]), float(found["min"]), np.asarray(w).tolist()) for a, b, w in ((source, target, mapping.weights), (target, source, mapping.inverse))]
    models = spark.createDataFrame(rows, "source string, target string, training double, quality double, worst double, weights array<array<double>>")
    return models.select("source", "target", F.current_timestamp().alias("created"), (F.current_timestamp() + F.expr(f"interval {VALID_DAYS} days")).alias("valid_until"), "training", "quality", "worst", "weights"), mapping


def vector_matrix(v: Column, weights: Column) -> Column:
    """v times a row-major matrix, neither checked for size nor normalised."""
    return F.aggregate(F.zip_with(v, weights, lambda x, row: F.transform(row, lambda w: x * w)), F.transform(weights[0], lambda _: F.lit(0.0)), lambda s, r: F.zip_with(s, r, lambda a, b: a + b))


def matrix_multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, w) times (i, j, w) in long form: a join on the inner index and a sum."""
    return a.select("i", F.col("j").alias("k"), F.col("w").alias("wa")).join(b.select(F.col("i").alias("k"), "j", F.col("w").alias("wb")), "k").groupBy("i", "j").agg(F.sum(F.col("wa") * F.col("wb")).alias("w"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")


def expired(valid_until: Column, now: Column | None = None) -> Column:
    return valid_until < (F.current_timestamp() if now is None else now)


def requires_recalibration(pairs: DataFrame, models: DataFrame, now: Column | None = None, threshold: float = MIN_QUALITY) -> DataFrame:
    """``pairs`` (source, target) with whether their model is missing, expired or below the threshold."""
    joined = pairs.join(models.select("source", "target", "valid_until", "quality"), ["source", "target"], "left")
    need = F.col("valid_until").isNull() | expired(F.col("valid_until"), now) | (F.col("quality") < threshold)
    return joined.select("source", "target", F.coalesce(need, F.lit(True)).alias("requires_recalibration"))


def transfer(messages: DataFrame, models: DataFrame, now: Column | None = None, open_pairs: DataFrame | None = None, weight_bytes: int = WEIGHT_BYTES) -> DataFrame:
    """``messages`` (source, target, vec, ...) with transferred, original_norm, expected_quality, error and method.

    error tells why a message can't go as a vector; such messages go as text.
    The weights don't travel with the messages: within ``weight_bytes`` they go to
    every executor once, and messages are multiplied by the block; beyond it they
    are joined to the messages that need them.
    """
    known = models.select("source", "target", "valid_until", "quality", F.lit(True).alias("is_known"))
    joined = messages.join(known, ["source", "target"], "left")
    error = F.when(F.col("is_known").isNull(), "not calibrated").when(expired(F.col("valid_until"), now), "matrix expired")
    if open_pairs is not None:
        joined = joined.join(open_pairs.select("source", "target", F.lit(True).alias("is_open")), ["source", "target"], "left")
        error = F.when(F.col("is_open"), "circuit open").otherwise(error)
    marked = joined.withColumn("error", error)
    size = models.agg(F.sum(F.size("weights").cast("long") * F.size(F.col("weights")[0]) * 8)).first()[0] or 0
    if size <= weight_bytes:
        marked = _multiplied(marked, models)
    else:
        weights = models.select("source", "target", "weights")
        marked = marked.join(weights, ["source", "target"], "left").withColumn("transferred", F.when(F.col("error").isNull(), vector_matrix(F.col("vec"), F.col("weights"))))
    return marked.select(*messages.columns, "transferred", vec.norm(F.col("vec")).alias("original_norm"), F.when(F.col("error").isNull(), F.col("quality")).alias("expected_quality"), "error", F.when(F.col("error").isNull(), "vector").otherwise("text").alias("method"))


def _multiplied(messages: DataFrame, models: DataFrame) -> DataFrame:
    """``messages`` with transferred: of those without an error, the vector times its pair's matrix, a block of a pair at a time."""
    matrices = {(r["source"], r["target"]): np.array(r["weights"]) for r in models.select("source", "target", "weights").collect()}
    sent = models.sparkSession.sparkContext.broadcast(matrices)
    at = {c: messages.columns.index(c) for c in ("source", "target", "vec", "error")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks: dict[tuple, list[int]] = {}
            pairs = zip(*(batch.column(at[c]).to_pylist() for c in ("source", "target", "error", "vec")))
            out: list = [None] * batch.num_rows
            vectors = []
            for k, (a, b, error, v) in enumerate(pairs):
                vectors.append(v)
                if error is None and v is not None:
                    blocks.setdefault((a, b, len(v)), []).append(k)
            for (a, b, n), rows in blocks.items():
                w = sent.value[a, b]
                for k, row in zip(rows, np.array([vectors[k] for k in rows], float) @ w[:n]):  # unchecked, as agents do
                    out[k] = row.tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float64()))], [*batch.schema.names, "transferred"])

    return messages.mapInArrow(run, StructType([*messages.schema.fields, StructField("transferred", ArrayType(DoubleType()))]))


def embed_with_events(texts: DataFrame, embed: Callable[[Column], Column], agent: str, model: str, batch: int = 100, text_col: str = "text", id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """(``texts`` with vec, event rows for the monitor): an embed_batch event for each ``batch`` texts in id order, ten tokens and the model's price a text."""
    from meridian.operators.monitor import model_cost
    from meridian.plans.numbering import numbered

    listed = numbered(texts.select(id_col), id_col).groupBy(F.expr(f"position div {batch}").alias("batch")).agg(F.count("*").cast("int").alias("batch_size"))
    sized = listed.select("batch", "batch_size", (F.col("batch_size") * 10).cast("long").alias("tokens"), F.lit(model).alias("model"))
    priced = model_cost(sized)
    none = [F.lit(None).cast(t).alias(n) for n, t in (("partner", "string"), ("duration_ms", "double"), ("quality", "double"))]
    events = priced.select(F.lit("embed_batch").alias("event_type"), F.lit(agent).alias("agent"), none[0], F.current_timestamp().alias("ts"), *none[1:], "tokens", F.col("usd").alias("cost"), "batch_size")
    return texts.withColumn("vec", embed(F.col(text_col))), events


def send(messages: DataFrame, agents: DataFrame, models: DataFrame, auto_calibrate: bool = True, now: Column | None = None, fallback_language: str = "en") -> DataFrame:
    """``messages`` (source, target, text, vec, ...) negotiated for each pair, then sent: transfer()'s columns with reason and language.

    agents (agent, supports): whether one can take vectors.  A message goes as a
    vector only if its pair agreed on it and the transfer works; else its text
    goes, in the fallback language, with the reason.
    """
    able = agents.select("agent", "supports")
    pairs = messages.select("source", "target").distinct()
    pairs = pairs.join(able.toDF("source", "supports1"), "source", "left").join(able.toDF("target", "supports2"), "target", "left")
    usable = models.select("source", "target", (~expired(F.col("valid_until"), now)).alias("calibrated"))
    cases = pairs.join(usable, ["source", "target"], "left").select("source", "target", F.coalesce("supports1", F.lit(False)).alias("supports1"), F.coalesce("supports2", F.lit(False)).alias("supports2"), F.lit(auto_calibrate).alias("auto_calibrate"), "calibrated")
    agreed = negotiate(cases).select("source", "target", "uses_vectors", "reason")
    sent = transfer(messages, models, now).join(agreed, ["source", "target"])
    vector = F.col("uses_vectors") & F.col("error").isNull()
    return sent.select(*messages.columns, F.when(vector, F.col("transferred")).alias("transferred"), F.when(vector, F.col("expected_quality")).alias("expected_quality"), F.when(vector, "vector").otherwise("text").alias("method"), F.when(~vector, F.coalesce("reason", "error")).alias("reason"), F.when(~vector, F.lit(fallback_language)).alias("language"))


def batch_send(messages: DataFrame, agents: DataFrame, models: DataFrame, order: str = "position", **options) -> DataFrame:
    """send() in the order of a column."""
    return send(messages, agents, models, **options).orderBy(order)


def capabilities(models: DataFrame, agent: str, dims: int, model: str) -> DataFrame:
    """One row: what an agent tells others of itself (agent, model, dims, n_partners, partners)."""
    own = models.where(F.col("source") == agent).agg(F.count_distinct("target").alias("n_partners"), F.array_sort(F.collect_set("target")).alias("partners"))
    return own.select(F.lit(agent).alias("agent"), F.lit(model).alias("model"), F.lit(dims).alias("dims"), "n_partners", "partners")


def enable_for(thing, **methods: Callable):
    """An object with the calls that an agent needs, those it lacks taken from ``methods``."""
    for name, method in methods.items():
        if not callable(getattr(thing, name, None)):
            setattr(thing, name, method)
    if not is_agent(thing):
        raise ProtocolError("this object can't become an agent", missing=[n for n in ("embed", "calibrate_with", "transfer_to") if not callable(getattr(thing, n, None))])
    return thing


def negotiate(cases: DataFrame) -> DataFrame:
    """``cases`` (supports1, supports2, auto_calibrate, calibrated) with uses_vectors and reason."""
    both = F.col("supports1") & F.col("supports2")
    uses = both & F.col("auto_calibrate") & F.coalesce("calibrated", F.lit(False))
    reason = (
        F.when(both & ~F.col("auto_calibrate"), "auto-calibration disabled")
        .when(both & F.col("calibrated").isNull(), "calibration error")
        .when(both & ~F.col("calibrated"), "calibration failed")
        .when(~F.col("supports1") & ~F.col("supports2"), "agent 1 and agent 2 don't support vectors")
        .when(~F.col("supports1"), "agent 1 doesn't support vectors")
        .when(~F.col("supports2"), "agent 2 doesn't support vectors")
    )
    return cases.select("*", uses.alias("uses_vectors"), reason.alias("reason"))


def connection_health(models: DataFrame, breakers: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """(source, target, calibrated, expired, quality, breaker) of every model; breakers: (source, target, state)."""
    joined = models if breakers is None else models.join(breakers, ["source", "target"], "left")
    state = F.lit("CLOSED") if breakers is None else F.coalesce("state", F.lit("CLOSED"))
    return joined.select("source", "target", F.lit(True).alias("calibrated"), expired(F.col("valid_until"), now).alias("expired"), "quality", state.alias("breaker"))


def knowledge_lookup(messages: DataFrame, base: DataFrame) -> DataFrame:
    """(message_id, key, sim): the key of the nearest entry (key, id, vec) of a knowledge base."""
    from meridian.operators.knn import topk

    best = topk(messages, base, 1, ("message_id", "vec"), ("id", "vec"))
    return best.join(base.select("id", "key"), "id").select(F.col("query_id").alias("message_id"), "key", "sim")


def is_agent(thing) -> bool:
    """Whether an object can take part: it has what calibration and transfer call."""
    return all(callable(getattr(thing, n, None)) for n in ("embed", "calibrate_with", "transfer_to"))


def retry(action: Callable, retries: int = 3, base: float = 1.0, most: float = 30.0, factor: float = 2.0, jitter: bool = True, sleep: Callable[[float], None] = time.sleep):
    """The action's result after up to ``retries`` more attempts, with exponential delays."""
    for attempt in range(retries + 1):
        try:
            return action()
        except Exception:
            if attempt == retries:
                raise
            sleep(min(base * factor**attempt, most) * (0.5 + random.random() if jitter else 1))
