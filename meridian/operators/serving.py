"""Serving new-model queries against a corpus that is still in the old space.

One class stands in for the query side of any framework: it has the method
names that vector-database and chain libraries call.
"""

from __future__ import annotations

import asyncio
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.operators.blocks import normalized
from meridian.operators.knn import topk
from meridian.operators.mapping import Mapping, MappingError


DIRECTIONS = ("new_to_old", "old_to_new")


class ResponseShim:
    """An API client whose ``embeddings.create`` maps the vectors of the response; usage and all else pass through."""

    def __init__(self, client, mapping: Mapping, direction: str = "new_to_old"):
        if direction not in DIRECTIONS:
            raise ValueError(f"direction is one of {', '.join(DIRECTIONS)}")
        self._client, self._mapping, self._inverse = client, mapping, direction == "new_to_old"

    def __getattr__(self, name: str):
        return getattr(self._client, name)

    @property
    def embeddings(self) -> ResponseShim:
        return self

    def create(self, *, input: list[str] | str, model: str | None = None, **options):  # noqa: A002 - the name that callers pass
        response = self._client.embeddings.create(input=[input] if isinstance(input, str) else list(input), model=model, **options)
        if response.data:
            mapped = self._mapping.apply(np.asarray([d.embedding for d in response.data], float), inverse=self._inverse)
            for item, row in zip(response.data, normalized(mapped)):
                item.embedding = row.tolist()
        return response


class QueryEmbedder:
    """Texts to vectors of the old space: embed with the new model, map back, normalise.

    ``documents`` tells whether texts for the corpus may be embedded too; a
    mixed corpus is an error unless asked for.  direction: new_to_old takes the
    inverse map, old_to_new the forward one.
    """

    def __init__(self, embed: Callable[[list[str]], np.ndarray], mapping: Mapping, documents: bool = False, direction: str = "new_to_old"):
        if direction not in DIRECTIONS:
            raise ValueError(f"direction is one of {', '.join(DIRECTIONS)}")
        if direction == "new_to_old" and mapping.inverse is None and not mapping.layers:
            raise MappingError("queries need a map with an inverse")
        self.embed, self.mapping, self.documents, self.direction = embed, mapping, documents, direction

    @property
    def dims(self) -> int:
        return self.mapping.d_src if self.direction == "new_to_old" else self.mapping.d_tgt

    def config(self) -> dict:
        """What a database keeps of an embedding function, to tell whether another is the same."""
        return {"name": "meridian_query", "mapping": self.mapping.checksum, "direction": self.direction, "documents": self.documents, "dims": self.dims}

    @classmethod
    def from_config(cls, config: dict, embed: Callable[[list[str]], np.ndarray], mapping: Mapping) -> QueryEmbedder:
        """The embedder of a config(); another map than it was made with is an error."""
        if config["mapping"] != mapping.checksum:
            raise MappingError("this isn't the map of the collection's embedding function")
        return cls(embed, mapping, config["documents"], config["direction"])

    def _mapped(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros((0, self.dims))
        return normalized(self.mapping.apply(np.asarray(self.embed(texts), float), inverse=self.direction == "new_to_old"))

    def embed_query(self, text: str) -> list[float]:
        return self._mapped([text])[0].tolist()

    def embed_queries(self, texts: list[str] | str) -> list[list[float]]:
        return self._mapped([texts] if isinstance(texts, str) else list(texts)).tolist()

    def embed_documents(self, texts: list[str]) -> list[list[float]]:
        if not self.documents:
            raise MappingError("this embedder serves queries; the corpus stays as it is")
        return self._mapped(list(texts)).tolist()

    async def aembed_query(self, text: str) -> list[float]:
        return await asyncio.to_thread(self.embed_query, text)

    async def aembed_documents(self, texts: list[str]) -> list[list[float]]:
        return await asyncio.to_thread(self.embed_documents, texts)

    def __call__(self, input: list[str] | str) -> list[list[float]]:  # noqa: A002 - the name that callers pass
        return self.embed_queries(input)

    def column(self, text: Column) -> Column:
        """The same for a text column, in Arrow batches."""
        @F.pandas_udf("array<double>")
        def run(texts: pd.Series) -> pd.Series:
            return pd.Series(self._mapped(texts.fillna("").tolist()).tolist(), index=texts.index)

        return run(text)

    def search(self, queries: DataFrame, store: DataFrame, k: int = 10, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
        """(query_id, rank, id, sim, payload) for queries (id long, vec in the new space) against a store with numeric ids."""
        mapped = self.mapping.map_queries(queries.select("id", "vec"), "vec")
        hits = topk(mapped, store.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")), k)
        extra = [c for c in ("text", "payload") if c in store.columns]
        return hits.join(store.select(F.col(id_col).cast("long").alias("id"), *extra), "id").select("query_id", "rank", "id", "sim", *extra)
