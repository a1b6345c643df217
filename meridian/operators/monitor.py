"""Roll-ups of monitor and telemetry events.

An event row is (event_type, agent, partner, ts, duration_ms, quality, tokens,
cost, batch_size); all but the first two may be null.  The functions work on
streams too, where they need no window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EVENT_TYPES = ("embed", "embed_batch", "transfer", "calibration_start", "calibration_end", "negotiation", "fallback", "error", "retry", "circuit_break", "message", "send", "receive", "info")
#: USD for a million tokens by model, then by provider.
MODEL_COSTS = {"openai:text-embedding-3-small": 0.02, "openai:text-embedding-3-large": 0.13, "openai:text-embedding-ada-002": 0.10, "voyage:voyage-2": 0.10, "voyage:voyage-large-2": 0.12, "voyage:voyage-code-2": 0.12, "cohere:embed-english-v3.0": 0.10, "cohere:embed-multilingual-v3.0": 0.10, "huggingface:*": 0.0, "mock:*": 0.0}
DEFAULT_COST = 0.10
TEXT_COST = 0.003
TEXT_MS = 500


def totals(events: DataFrame) -> DataFrame:
    """One row of counts by kind, and of time, tokens and cost; a batch counts as its size."""
    of = lambda t: F.col("event_type") == t
    embeds = F.sum(F.when(of("embed"), 1).when(of("embed_batch"), F.coalesce("batch_size", F.lit(1))).otherwise(0))
    counts = [F.count_if(of(t)).alias(n) for t, n in (("transfer", "transfers"), ("calibration_end", "calibrations"), ("negotiation", "negotiations"), ("fallback", "fallbacks"), ("error", "errors"), ("retry", "retries"))]
    return events.agg(F.count("*").alias("events"), embeds.alias("embeds"), *counts, *[F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{c}") for c in ("duration_ms", "tokens", "cost")])


def agent_stats(events: DataFrame) -> DataFrame:
    """(agent, embeds, sent, received, errors, total_ms, total_cost, avg_quality, n_quality); a transfer also counts for its partner."""
    of = lambda t: F.col("event_type") == t
    own = events.select("agent", F.when(of("embed") | of("embed_batch"), F.coalesce("batch_size", F.lit(1))).otherwise(0).alias("e"), of("transfer").cast("int").alias("s"), F.lit(0).alias("r"), of("error").cast("int").alias("x"), "duration_ms", "cost", "quality")
    nothing = [F.lit(0).alias(c) for c in ("e", "s")]
    theirs = events.where(of("transfer") & F.col("partner").isNotNull()).select(F.col("partner").alias("agent"), *nothing, F.lit(1).alias("r"), F.lit(0).alias("x"), *[F.lit(None).cast("double").alias(c) for c in ("duration_ms", "cost", "quality")])
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return own.union(theirs).groupBy("agent").agg(F.sum("e").alias("embeds"), F.sum("s").alias("sent"), F.sum("r").alias("received"), F.sum("x").alias("errors"), zero("duration_ms").alias("total_ms"), zero("cost").alias("total_cost"), F.coalesce(F.avg("quality"), F.lit(0.0)).alias("avg_quality"), F.count("quality").alias("n_quality"))


def quality_band(mean: Column) -> Column:
    return F.when(mean >= 0.95, "excellent").when(mean >= 0.90, "very good").when(mean >= 0.80, "good").when(mean >= 0.70, "acceptable").otherwise("poor")


def pair_quality(events: DataFrame) -> DataFrame:
    """(agent, partner, n, mean, median, min, max, band); the median is the upper one, and a mean that is a bound but for the order of its sum counts as the bound."""
    scored = events.where("quality is not null and partner is not null")
    upper = F.expr("percentile_disc(0.5) within group (order by quality desc)")  # by counts of values, not by lists of rows
    out = scored.groupBy("agent", "partner").agg(F.count("*").alias("n"), F.avg("quality").alias("mean"), upper.alias("median"), F.min("quality").alias("min"), F.max("quality").alias("max"))
    return out.withColumn("band", quality_band(F.round("mean", 12)))


def running_quality(events: DataFrame, order: list[str]) -> DataFrame:
    """``events`` with the agent's mean quality so far."""
    return events.where("quality is not null").withColumn("running", F.avg("quality").over(Window.partitionBy("agent").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def recent(events: DataFrame, order: list[Column], n: int = 10_000) -> DataFrame:
    """The last n events: a bounded sort, not a total one."""
    return events.orderBy(*order).limit(n)


def cost_report(totals_row: DataFrame) -> DataFrame:
    """totals() with the cost and time of sending text instead, savings, error rate and mean time."""
    ops = F.col("embeds") + F.col("transfers")
    text = ops * TEXT_COST
    saved = F.greatest(F.lit(0.0), text - F.col("total_cost"))
    return totals_row.select("*", ops.alias("operations"), text.alias("text_cost"), saved.alias("savings"), F.when(text > 0, saved / text * 100).otherwise(0.0).alias("savings_pct"), F.when(ops > 0, F.col("total_duration_ms") / ops).otherwise(0.0).alias("avg_ms"), F.when(F.col("events") > 0, F.col("errors") / F.col("events") * 100).otherwise(0.0).alias("error_pct"), F.greatest(F.lit(0.0), ops * TEXT_MS - F.col("total_duration_ms")).alias("ms_saved"))


def model_cost(models: DataFrame, model_col: str = "model", tokens_col: str = "tokens", prices: dict[str, float] = MODEL_COSTS) -> DataFrame:
    """``models`` with price and usd: by the exact model, else by its provider, else the default."""
    table = models.sparkSession.createDataFrame(list(prices.items()), "key string, price double")
    exact, wild = F.broadcast(table.toDF("k1", "p1")), F.broadcast(table.toDF("k2", "p2"))
    provider = F.concat(F.element_at(F.split(F.col(model_col), ":"), 1), F.lit(":*"))
    joined = models.join(exact, F.col(model_col) == F.col("k1"), "left").join(wild, provider == F.col("k2"), "left")
    price = F.coalesce("p1", "p2", F.lit(DEFAULT_COST))
    return joined.select(*[models[c] for c in models.columns], price.alias("price"), (F.col(tokens_col) * price / 1e6).alias("usd"))


def telemetry_summary(events: DataFrame, wrapper_col: str = "wrapper") -> DataFrame:
    """(wrapper, n): counts by wrapper, a missing one as ``unknown``, and the total with a null wrapper."""
    return events.select(F.coalesce(wrapper_col, F.lit("unknown")).alias("wrapper")).rollup("wrapper").agg(F.count("*").alias("n"))


def duration_text(ms: Column) -> Column:
    """Hours, minutes and seconds as text."""
    s = F.floor(ms / 1000).cast("long")
    return F.when(s >= 3600, F.format_string("%dh %dm", F.floor(s / 3600), F.floor(s / 60) % 60)).when(s >= 60, F.format_string("%dm %ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%ds", s))


def degradation(outcomes: DataFrame, ok_col: str = "ok") -> DataFrame:
    """(n, n_primary, n_fallback, fallback_pct)."""
    return outcomes.agg(F.count("*").alias("n"), F.count_if(F.col(ok_col)).alias("n_primary"), F.count_if(~F.col(ok_col)).alias("n_fallback"), F.coalesce(F.avg((~F.col(ok_col)).cast("double")) * 100, F.lit(0.0)).alias("fallback_pct"))


LEVELS = {"off": 0, "minimal": 1, "standard": 2, "detailed": 3, "verbose": 4}


def event_text(events: DataFrame, level: str = "standard") -> DataFrame:
    """(line): events as lines of text; embeddings only from level detailed on."""
    shown = events if LEVELS[level] >= LEVELS["detailed"] else events.where(~F.col("event_type").isin("embed", "embed_batch"))
    part = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}="), value))
    ms = F.date_format(F.col("ts").cast("timestamp"), "HH:mm:ss.SSS")
    parts = [F.concat(F.lit("["), ms, F.lit("]")), F.upper("event_type"), part("agent", F.col("agent").cast("string")), part("partner", F.col("partner").cast("string")), part("time", F.format_string("%.1fms", F.col("duration_ms").cast("double"))), part("quality", F.format_string("%.4f", F.col("quality").cast("double"))), part("cost", F.format_string("$%.6f", F.col("cost").cast("double")))]
    null = {2: "agent", 3: "partner", 4: "duration_ms", 5: "quality", 6: "cost"}
    parts = [F.when(F.col(null[k]).isNotNull(), p) if k in null else p for k, p in enumerate(parts)]
    return shown.select(F.concat_ws(" ", *parts).alias("line"))


class Monitor:
    """A session's events, kept as a table of JSON lines: switched on and off, reset, and exported."""

    def __init__(self, spark, folder: str, level: str = "off"):
        self.spark, self.root, self.level, self.run = spark, folder.rstrip("/"), level, 0

    def enable(self, level: str = "standard") -> Monitor:
        self.level = level if level in LEVELS else "standard"
        return self

    def disable(self) -> None:
        self.level = "off"

    def reset(self) -> None:
        """Begin anew; what was recorded stays in its folder."""
        self.run += 1

    @property
    def folder(self) -> str:
        return f"{self.root}/run={self.run}"

    def record(self, events: DataFrame) -> bool:
        """Append events unless the monitor is off."""
        if self.level == "off":
            return False
        events.write.mode("append").parquet(self.folder)
        return True

    def events(self) -> DataFrame:
        return self.spark.read.parquet(self.folder)

    def export(self, last: int = 100) -> DataFrame:
        """(json): totals, agents, pairs and the last events in one document."""
        e = self.events()
        listed = lambda df: df.agg(F.to_json(F.collect_list(F.struct("*"))).alias("j"))
        parts = [("stats", totals(e).select(F.to_json(F.struct("*")).alias("j"))), ("agents", listed(agent_stats(e).orderBy("agent"))), ("pairs", listed(pair_quality(e).orderBy("agent", "partner"))), ("recent", listed(recent(e, [F.desc("ts")], last)))]
        row = None
        for name, df in parts:
            one = df.withColumnRenamed("j", name)
            row = one if row is None else row.crossJoin(one)
        return row.select(F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{n}":'), F.col(n)) for n, _ in parts]), F.lit("}")).alias("json"))
