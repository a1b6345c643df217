"""Text to vector: embedders, their registry, routing, prefixes and the content-addressed cache."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.functions import vec

#: Models that need a prefix for queries and passages.
PREFIXES = {f"intfloat/{m}": ("query: ", "passage: ") for m in ("e5-small-v2", "e5-base-v2", "e5-large-v2", "multilingual-e5-small", "multilingual-e5-base", "multilingual-e5-large")}
DIMENSIONS = {"text-embedding-ada-002": 1536, "text-embedding-3-small": 1536, "text-embedding-3-large": 3072}
BATCHES = {"openai": 128, "cohere": 96, "voyage": 128, "gemini": 64, "local": 1024}


@dataclass(frozen=True)
class Embedder:
    """A named text embedder; ``embed`` takes a list of texts and gives a matrix."""

    model_id: str
    dims: int
    embed: Callable[[list[str]], np.ndarray]
    batch: int = 128

    def column(self, text: Column) -> Column:
        """The embedding of a text column, a batch of texts at a time; null texts count as empty."""
        embed, size, dims = self.embed, self.batch, self.dims

        @F.pandas_udf("array<double>")
        def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in series:
                rows = []
                for at in range(0, len(texts), size):
                    part = np.asarray(embed(texts.iloc[at : at + size].fillna("").tolist()), float)
                    if part.shape[1] != dims:
                        raise ValueError(f"the embedder gave {part.shape[1]} dimensions, not {dims}")
                    rows += part.tolist()
                yield pd.Series(rows, index=texts.index)

        return run(text)


def sincode(text: Column, dims: int) -> Column:
    """v[i] = sin(code point of character i * i) over the first dims characters, zero padded, to unit length.

    For texts without characters beyond the basic plane.
    """
    n = F.least(F.length(text), F.lit(dims))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.when(i < n, F.sin((F.ascii(F.substring(text, i + 1, F.lit(1))) * i).cast("double"))).otherwise(F.lit(0.0)))
    length = vec.norm(raw)
    return F.transform(raw, lambda x: x / F.when(length == 0, F.lit(1.0)).otherwise(length))


def charcode(text: Column, dims: int) -> Column:
    """v[i] = code point of character i / 255, zero padded."""
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.when(i < F.length(text), F.ascii(F.substring(text, i + 1, F.lit(1))) / F.lit(255.0)).otherwise(F.lit(0.0)))


def md5_mod(text: Column, dims: int) -> Column:
    """v[i] = (MD5 of the text as a number + i) mod 1000 / 1000."""
    digest = F.md5(text)
    # 16^24, 16^16 and 16^8 mod 1000
    parts = [(0, 336), (8, 616), (16, 296), (24, 1)]
    total = sum((F.conv(F.substring(digest, at + 1, 8), 16, 10).cast("long") % 1000 * weight for at, weight in parts), F.lit(0))
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: (total + i) % 1000 / F.lit(1000.0))


def string_hash(text: Column) -> Column:
    """The 31-multiplier hash as a signed 32-bit integer."""
    return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0).cast("long"), lambda h, i: F.when(F.length(text) > 0, F.pmod(h * 31 + F.ascii(F.substring(text, i, F.lit(1))), F.lit(1 << 32))).otherwise(h), lambda h: F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h))


def lcg(text: Column, dims: int) -> Column:
    """A unit vector of a linear congruential generator that starts from the absolute string hash."""
    m = 1 << 31
    start = F.abs(string_hash(text))
    states = F.aggregate(F.sequence(F.lit(1), F.lit(dims)), F.array(start), lambda s, _: F.concat(s, F.array(F.pmod(F.element_at(s, -1) * 1103515245 + 12345, F.lit(m)))))
    return vec.l2_normalize(F.transform(F.slice(states, 2, dims), lambda x: x / F.lit(float(m)) * 2 - 1))


class Registry:
    """Named factories; a name is taken once unless overridden."""

    def __init__(self) -> None:
        self._known: dict[str, Callable] = {}

    def register(self, name: str, factory: Callable, override: bool = False) -> None:
        if name in self._known and not override:
            raise ValueError(f"{name} is registered already")
        self._known[name] = factory

    def get(self, name: str) -> Callable:
        if name not in self._known:
            raise KeyError(f"{name} isn't registered; known: {', '.join(sorted(self._known))}")
        return self._known[name]

    def create(self, name: str, *args, **options):
        return self.get(name)(*args, **options)

    def decorator(self, name: str, override: bool = False) -> Callable:
        def add(factory: Callable) -> Callable:
            self.register(name, factory, override)
            return factory

        return add

    def list(self) -> list[str]:
        return sorted(self._known)

    def has(self, name: str) -> bool:
        return name in self._known

    def unregister(self, name: str) -> bool:
        return self._known.pop(name, None) is not None

    def clear(self) -> None:
        self._known.clear()


#: Column embedders (text, dims) -> column; a deployment adds its own.
EMBEDDERS = Registry()
for _name, _factory in (("sincode", sincode), ("charcode", charcode), ("md5", md5_mod), ("lcg", lcg)):
    EMBEDDERS.register(_name, _factory)


def provider_of(model: Column) -> Column:
    """The provider that serves a model id: explicit prefix, then known names, then parts of the name."""
    lower = F.lower(model)
    out = None
    for p in ("openai", "voyage", "cohere", "gemini"):
        out = (F if out is None else out).when(F.startswith(model, F.lit(f"{p}:")), p)
    return (
        out.when(F.startswith(lower, F.lit("text-embedding-")), "openai")
        .when(F.startswith(lower, F.lit("voyage")), "voyage")
        .when(F.contains(lower, F.lit("cohere")) | F.startswith(lower, F.lit("embed-")), "cohere")
        .when(F.startswith(lower, F.lit("models/")) | F.contains(lower, F.lit("gemini")), "gemini")
        .otherwise("local")
    )


def model_name(model: Column) -> Column:
    """The id without an explicit provider prefix."""
    return F.regexp_replace(model, "^(openai|voyage|cohere|gemini):", "")


def prefixed(text: Column, model_id: str, kind: str) -> Column:
    """The text with the prefix that the model needs for kind query or passage."""
    query, passage = PREFIXES.get(model_id, ("", ""))
    prefix = {"query": query, "passage": passage}.get(kind, "")
    return F.concat(F.lit(prefix), text) if prefix else text


def cache_key(text: Column, model_id: str) -> Column:
    return F.sha2(F.concat(F.lit(model_id), F.lit("\0"), text), 256)


def cache_folder(root: str, model_id: str) -> str:
    """Where a model's cache lies: a folder by hash of its id."""
    import hashlib

    return f"{root.rstrip('/')}/{hashlib.sha256(model_id.encode()).hexdigest()[:16]}"


def embed_cached(texts: DataFrame, cache: DataFrame | None, embedder: Callable[[Column], Column], model_id: str, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(``texts`` with cached and vec, new rows (key, vec) for the cache); each distinct missing text is embedded once."""
    keyed = texts.withColumn("key", cache_key(F.col(text_col), model_id))
    distinct = keyed.select("key", F.col(text_col).alias("t")).dropDuplicates(["key"])
    missing = distinct if cache is None else distinct.join(cache.select("key"), "key", "left_anti")
    new = missing.select("key", embedder(F.col("t")).alias("vec"))
    old = new.select("key", "vec", F.lit(False).alias("cached")).limit(0) if cache is None else cache.select("key", "vec", F.lit(True).alias("cached"))
    known = old.unionByName(new.select("key", "vec", F.lit(False).alias("cached")))
    return keyed.join(known, "key"), new


def cache_stats(embedded: DataFrame) -> DataFrame:
    """(hits, misses, distinct_misses) of embed_cached() rows."""
    return embedded.agg(F.count_if("cached").alias("hits"), F.count_if(~F.col("cached")).alias("misses"), F.count_distinct(F.when(~F.col("cached"), F.col("key"))).alias("distinct_misses"))
