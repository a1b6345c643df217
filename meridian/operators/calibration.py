"""Calibration samples, splits, checksums and cost plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.plans.numbering import numbered

#: USD for a million tokens, tried in this order.
PRICES = [("text-embedding-ada-002", 0.10), ("text-embedding-3-small", 0.02), ("text-embedding-3-large", 0.13), ("voyage-3", 0.06)]
DEFAULT_PRICE = 0.05
TOKENS_PER_TEXT = 100


def seeded(id_col: str | Column, seed: int) -> Column:
    """A hash that orders rows alike in every engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), (F.col(id_col) if isinstance(id_col, str) else id_col).cast("string")))


def sample(df: DataFrame, k: int, seed: int = 0, id_col: str = "id", replace: bool | None = None) -> DataFrame:
    """k rows without replacement; if there are fewer, with replacement, through hashed positions and ``draw``.

    replace False: never with replacement, so all rows if there are fewer than k.
    """
    n = df.count()
    if not n:
        raise ValueError("nothing to sample from")
    if k <= n and not replace or replace is False:
        return df.orderBy(seeded(id_col, seed), id_col).limit(k)
    draws = df.sparkSession.range(k).select(F.col("id").alias("draw")).withColumn("position", F.pmod(F.conv(F.substring(seeded("draw", seed), 1, 8), 16, 10).cast("long"), F.lit(n)))
    return draws.join(numbered(df, id_col, rows=n), "position").drop("position")


def rotated(df: DataFrame, k: int, seed: int = 0, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(position, text): k texts from a fixed list, from place ``seed`` on; past its end they carry a number."""
    n = df.count()
    listed = numbered(df.select(id_col, F.col(text_col).alias("t")), id_col, name="at").select("t", "at")
    places = df.sparkSession.range(k).select(F.col("id").alias("position"), F.pmod(F.col("id") + seed, F.lit(n)).alias("at"))
    return places.join(listed, "at").select("position", F.when(F.col("position") < n, F.col("t")).otherwise(F.concat("t", F.lit(" ["), F.col("position").cast("string"), F.lit("]"))).alias("text"))


def holdout(df: DataFrame, fraction: float = 0.1, seed: int = 0, id_col: str = "id") -> DataFrame:
    """``df`` with is_holdout: ceil(fraction * n) rows by hash."""
    n = df.count()
    test = -(-int(round(fraction * n * 1e9)) // 10**9)
    return numbered(df, seeded(id_col, seed), id_col, name="place", rows=n).withColumn("is_holdout", F.col("place") < test).drop("place")


def disjoint(df: DataFrame, used: DataFrame, id_col: str = "id") -> DataFrame:
    return df.join(used.select(id_col).distinct(), id_col, "left_anti")


#: Sentences of several registers for trials without a corpus of one's own.
BUILTIN = (
    "The ferry leaves the harbour at a quarter past six.", "Please restart the router before you call support.", "Interest on the loan is charged every month.", "A recursive function needs a case that ends it.",
    "The patient was given two tablets after dinner.", "Glaciers carve valleys as they move downhill.", "Our returns desk is on the second floor.", "The court adjourned until Monday morning.",
    "Boil the lentils for twenty minutes, then add salt.", "Voltage equals current times resistance.", "She scored twice in the last ten minutes.", "The museum keeps letters from three centuries.",
    "Indexes make reads faster and writes slower.", "Rain is expected along the coast by evening.", "The committee approved the budget without changes.", "Bees tell each other where flowers are by dancing.",
    "Your parcel was handed to a neighbour.", "The novel begins at the end of a long war.", "Steel expands when it is heated.", "Children under five travel free of charge.",
)
#: The frozen list: it never changes under its name.
FROZEN_ID = "meridian-calibration-1"


def builtin(spark) -> DataFrame:
    """(id, text) of the built-in sentences."""
    return spark.createDataFrame(list(enumerate(BUILTIN)), "id long, text string")


def frozen(spark, path: str | None = None) -> DataFrame:
    """(id, text) of the frozen list, or of a JSON file {"corpus_id", "texts"} with the same id."""
    texts = BUILTIN
    if path is not None:
        import json

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        if content.get("corpus_id") != FROZEN_ID:
            raise ValueError(f"{path} isn't {FROZEN_ID}")
        texts = content["texts"]
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def manifest(df: DataFrame, corpus_id: str = FROZEN_ID, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(corpus_id, k, checksum): what a calibration was made with; the checksum begins with the id and a line break."""
    return corpus_checksum(df, id_col, text_col, corpus_id + "\n").crossJoin(df.agg(F.count("*").alias("k"))).select(F.lit(corpus_id).alias("corpus_id"), "k", "checksum")


def corpus_checksum(df: DataFrame, id_col: str = "id", text_col: str = "text", prefix: str = "") -> DataFrame:
    """(checksum): SHA-256 over a prefix and the texts in id order, each followed by NUL.

    It needs the texts in one place, so it is for calibration samples; for whole
    tables use table_checksum().
    """
    texts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(id_col), F.col(text_col)))), lambda s: s[text_col])
    return df.agg(F.sha2(F.concat(F.lit(prefix), F.array_join(texts, "\0"), F.when(F.size(texts) > 0, "\0").otherwise("")), 256).alias("checksum"))


def table_checksum(df: DataFrame, *columns: str) -> DataFrame:
    """(n, checksum): order-free, by one aggregate: XOR of row hashes."""
    return df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*columns)).alias("checksum"))


def batches(df: DataFrame, size: int, id_col: str = "id") -> DataFrame:
    """(batch, start, n, first_id, last_id) of rows in id order."""
    listed = numbered(df.select(id_col), id_col).withColumn("batch", F.expr(f"position div {size}"))
    return listed.groupBy("batch").agg((F.col("batch") * size).alias("start"), F.count("*").alias("n"), F.min(id_col).alias("first_id"), F.max(id_col).alias("last_id"))


def recommend_k(min_dim: Column, corpus: Column) -> Column:
    return F.least(F.greatest(10 * min_dim, F.lit(2000)), F.lit(20000), F.greatest(corpus, 10 * min_dim))


def price_table(spark, prices: list[tuple[str, float]] = PRICES) -> DataFrame:
    return spark.createDataFrame([(k, p, n) for n, (k, p) in enumerate(prices)], "key string, price double, ordinal int")


def with_price(models: DataFrame, model_col: str = "model", prices: list[tuple[str, float]] = PRICES) -> DataFrame:
    """``models`` with the price of the first key that is part of the model's name."""
    table = F.broadcast(price_table(models.sparkSession, prices))
    found = models.join(table, F.contains(F.col(model_col), F.col("key")), "left").groupBy(*models.columns).agg(F.min_by("price", "ordinal").alias("found"))
    return found.withColumn("price", F.coalesce("found", F.lit(DEFAULT_PRICE))).drop("found")


def cost_plan(plans: DataFrame) -> DataFrame:
    """Calls and USD of calibrating and of embedding everything anew, for rows (model, dim_old, dim_new, corpus)."""
    k = recommend_k(F.least("dim_old", "dim_new"), F.col("corpus"))
    priced = with_price(plans).withColumn("k", k)
    usd = lambda calls: calls * TOKENS_PER_TEXT / 1e6 * F.col("price")
    return priced.withColumn("calibrate_calls", 2 * F.col("k")).withColumn("calibrate_usd", usd(2 * F.col("k"))).withColumn("full_usd", usd(F.col("corpus")))


def diverse_sample(df: DataFrame, k: int, column: str = "vec", id_col: str = "id", seed: int = 1) -> DataFrame:
    """(cluster, id): the row nearest to the centre of each non-empty cluster of k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.select(F.col(id_col).alias("id"), F.col(column).cast("array<double>").alias("v"), array_to_vector(F.col(column).cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=10).fit(rows)
    centres = df.sparkSession.createDataFrame([(n, [float(x) for x in c]) for n, c in enumerate(model.clusterCenters())], "cluster int, centre array<double>")
    distance = F.aggregate(F.zip_with("v", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return model.transform(rows).withColumnRenamed("prediction", "cluster").join(F.broadcast(centres), "cluster").groupBy("cluster").agg(F.min_by("id", F.struct(distance, F.col("id"))).alias("id"))


def kmeans(df: DataFrame, k: int = 2, column: str = "vec", id_col: str = "id", seed: int = 1) -> DataFrame:
    """(id, cluster) of k-means over mapped vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.select(F.col(id_col).alias("id"), array_to_vector(F.col(column).cast("array<double>")).alias("features"))
    return KMeans(k=k, seed=seed, maxIter=20).fit(rows).transform(rows).select("id", F.col("prediction").alias("cluster"))
