"""Embedders of the providers, over injected clients, and the factory that routes a model id to one.

A client factory takes no argument and is called once in each worker, so keys and
connections stay there.  Without one the provider's own library is asked, and a
missing library or key is an error that says so.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.functions.providers import BATCHES, DIMENSIONS, Embedder, cache_folder, embed_cached
from meridian.plans.materialize import materialize

#: Known dimensions besides those of providers.DIMENSIONS.
KNOWN = DIMENSIONS | {"embed-english-v3.0": 1024, "embed-multilingual-v3.0": 1024, "embed-english-light-v3.0": 384, "voyage-2": 1024, "voyage-large-2": 1536, "voyage-code-2": 1536, "voyage-3": 1024, "models/text-embedding-004": 768}
_LIBRARIES = {"openai": ("openai", "OpenAI", "OPENAI_API_KEY"), "cohere": ("cohere", "ClientV2", "COHERE_API_KEY"), "voyage": ("voyageai", "Client", "VOYAGE_API_KEY"), "gemini": ("google.generativeai", "", "GOOGLE_API_KEY"), "local": ("sentence_transformers", "SentenceTransformer", ""), "huggingface": ("huggingface_hub", "InferenceClient", "HF_TOKEN")}


class ProviderError(RuntimeError):
    """A provider can't be used."""


def own_client(provider: str, model: str) -> Callable[[], object]:
    """A factory of the provider's own client."""

    def make() -> object:
        import importlib

        library, name, key = _LIBRARIES[provider]
        try:
            module = importlib.import_module(library)
        except ImportError:
            raise ProviderError(f"{library} isn't installed, which {provider} models need") from None
        secret = os.environ.get(key) if key else None
        if key and not secret:
            raise ProviderError(f"{key} isn't set")
        if provider == "gemini":
            module.configure(api_key=secret)
            return module
        return getattr(module, name)(model) if provider == "local" else getattr(module, name)(api_key=secret)

    return make


def _openai(client, model: str, texts: list[str], dims: int | None, kind: str) -> list:
    more = {"dimensions": dims} if dims is not None else {}
    return [d.embedding for d in sorted(client.embeddings.create(model=model, input=texts, **more).data, key=lambda d: d.index)]


def _cohere(client, model: str, texts: list[str], dims: int | None, kind: str) -> list:
    found = client.embed(texts=texts, model=model, input_type=kind or "search_document", embedding_types=["float"]).embeddings
    return getattr(found, "float", None) or getattr(found, "float_", None) or found


def _voyage(client, model: str, texts: list[str], dims: int | None, kind: str) -> list:
    return client.embed(texts, model=model, **({"input_type": kind} if kind else {})).embeddings


def _gemini(client, model: str, texts: list[str], dims: int | None, kind: str) -> list:
    return [client.embed_content(model=model, content=t)["embedding"] for t in texts]


def _local(client, model: str, texts: list[str], dims: int | None, kind: str) -> list:
    return client.encode(texts, convert_to_numpy=True)


def _huggingface(client, model: str, texts: list[str], dims: int | None, kind: str) -> list:
    return [client.feature_extraction(t, model=model) for t in texts]


CALLS = {"openai": _openai, "cohere": _cohere, "voyage": _voyage, "gemini": _gemini, "local": _local, "huggingface": _huggingface}


@dataclass(frozen=True)
class Calls:
    """The embedding call of one model; the client is made at the first call, once in each process."""

    provider: str
    model: str
    client: Callable[[], object]
    dims: int | None = None
    kind: str = ""

    def __call__(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros((0, self.dims or 0))
        rows = np.asarray(CALLS[self.provider](_client(self.client), self.model, list(texts), self.dims, self.kind), float)
        if len(rows) != len(texts):
            raise ProviderError(f"{self.provider} gave {len(rows)} vectors for {len(texts)} texts")
        return rows


@cache
def _client(factory: Callable[[], object]) -> object:
    return factory()


def route(model_id: str) -> tuple[str, str]:
    """(provider, model name) of an id, by the rules of providers.provider_of()."""
    for p in ("openai", "voyage", "cohere", "gemini", "huggingface"):
        if model_id.startswith(f"{p}:"):
            return p, model_id[len(p) + 1 :]
    lower = model_id.lower()
    if lower.startswith("text-embedding-"):
        return "openai", model_id
    if lower.startswith("voyage"):
        return "voyage", model_id
    if "cohere" in lower or lower.startswith("embed-"):
        return "cohere", model_id
    if lower.startswith("models/") or "gemini" in lower:
        return "gemini", model_id
    return "local", model_id


def embedder(model_id: str, client: Callable[[], object] | None = None, dims: int | None = None, batch: int | None = None, kind: str = "") -> Embedder:
    """The embedder of a model; dimensions that aren't known are asked for once."""
    provider, model = route(model_id)
    factory = client or own_client(provider, model)
    size = dims if dims is not None else KNOWN.get(model)
    if size is None:
        size = Calls(provider, model, factory, None, kind)(["dimension"]).shape[1]
    return Embedder(model_id, size, Calls(provider, model, factory, dims, kind), batch or BATCHES.get(provider, 32))


class CachedEmbedder:
    """An embedder over a content-addressed Parquet cache: a text is embedded once, whoever asks."""

    def __init__(self, own: Embedder, root: str):
        self.own, self.model_id, self.dims = own, own.model_id, own.dims
        self.folder = cache_folder(root, own.model_id)

    def embed(self, texts: DataFrame, text_col: str = "text") -> DataFrame:
        """``texts`` with key, vec and cached; what is new is appended to the cache first."""
        spark = texts.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        old = spark.read.parquet(self.folder) if there else None
        _, new = embed_cached(texts, old, self.own.column, self.model_id, text_col)
        fresh = materialize(new, "embedded")
        fresh.write.mode("append").parquet(self.folder)
        known = fresh.withColumn("cached", F.lit(False))
        if old is not None:
            known = old.withColumn("cached", F.lit(True)).unionByName(known)
        from meridian.functions.providers import cache_key

        return texts.withColumn("key", cache_key(F.col(text_col), self.model_id)).join(known, "key")


def with_cache(own: Embedder | CachedEmbedder, root: str | None = None) -> CachedEmbedder:
    """Cached, once: a cached embedder stays as it is.  root: MERIDIAN_CACHE unless given."""
    if isinstance(own, CachedEmbedder):
        return own
    root = root or os.environ.get("MERIDIAN_CACHE")
    if not root:
        raise ProviderError("name a folder for the cache, or set MERIDIAN_CACHE")
    return CachedEmbedder(own, root)


def create_embedder(model_id: str, root: str | None = None, cached: bool = True, **options) -> Embedder | CachedEmbedder:
    """The embedder of a model id, cached unless that is declined; options as embedder() takes them."""
    own = embedder(model_id, **options)
    return with_cache(own, root) if cached else own
