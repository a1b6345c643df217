"""Vector databases as Spark data sources: Qdrant, Chroma and Pinecone.

``spark.dataSource.register(VectorService)`` makes ``format("vector_service")``
known; ``read`` and ``write`` below do that.  Options:

service    qdrant, chroma or pinecone
client     "module:factory"; the factory gets the options and gives the client,
           on the driver and in every worker.  By default the service's own
           library is asked, and a missing one is an error that says so.
collection the collection, or the namespace of a Pinecone index
batch      rows that one request reads or writes (1024)
pages      pages that one task reads (16)

A read is planned from the pages' starts, which the driver lists without
vectors, and pages are read in parallel.  A write upserts by id, so a task that is
run again changes nothing; the collection is made if it is absent.
"""

from __future__ import annotations

import importlib
import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from meridian.sources.stores import SCHEMA, target_metric

BATCH = 1024
#: Pages that one task reads.
PAGES = 16


class ServiceError(RuntimeError):
    """A vector service can't be reached or used."""


def _plain(payload: dict | None) -> dict[str, str]:
    return {str(k): v if isinstance(v, str) else json.dumps(v) for k, v in (payload or {}).items() if v is not None}


class Qdrant:
    """Points by scrolling; a page begins at a point's id, the first at None."""

    def __init__(self, client, collection: str, text_field: str = "text"):
        self.client, self.collection, self.text = client, collection, text_field

    @staticmethod
    def connect(options: dict):
        try:
            from qdrant_client import QdrantClient
        except ImportError:
            raise ServiceError("qdrant_client isn't installed; install it or pass a client") from None
        return QdrantClient(url=options.get("url"), api_key=options.get("api_key") or os.environ.get("QDRANT_API_KEY"))

    def count(self) -> int:
        return self.client.get_collection(self.collection).points_count or 0

    def starts(self, batch: int) -> Iterator[object]:
        at = None
        while True:
            yield at
            points, at = self.client.scroll(collection_name=self.collection, limit=batch, offset=at, with_payload=False, with_vectors=False)
            if at is None or not points:
                return

    def page(self, at, batch: int) -> list[tuple]:
        points, _ = self.client.scroll(collection_name=self.collection, limit=batch, offset=at, with_payload=True, with_vectors=True)
        return [(str(p.id), [float(x) for x in p.vector], (p.payload or {}).get(self.text), _plain(p.payload)) for p in points]

    def ensure(self, dims: int, metric: str) -> None:
        try:
            self.client.get_collection(self.collection)
        except Exception:
            try:
                from qdrant_client.models import Distance, VectorParams

                config = VectorParams(size=dims, distance=Distance.COSINE if metric == "cosine" else Distance.EUCLID)
            except ImportError:
                config = {"size": dims, "distance": metric}
            self.client.create_collection(collection_name=self.collection, vectors_config=config)

    def upsert(self, rows: list[Row]) -> None:
        points = [{"id": int(r["id"]) if r["id"].isdigit() else r["id"], "vector": list(r["vec"]), "payload": (r["payload"] or {}) | ({self.text: r["text"]} if r["text"] is not None else {})} for r in rows]
        try:
            from qdrant_client.models import PointStruct

            points = [PointStruct(**p) for p in points]
        except ImportError:
            pass
        self.client.upsert(collection_name=self.collection, points=points)


class Chroma:
    """Rows by offset; a page begins at a row's number."""

    def __init__(self, client, collection: str, text_field: str = "text"):
        self.client, self.name = client, collection

    @staticmethod
    def connect(options: dict):
        try:
            import chromadb
        except ImportError:
            raise ServiceError("chromadb isn't installed; install it or pass a client") from None
        return chromadb.HttpClient(host=options.get("host", "localhost"), port=int(options.get("port", 8000)))

    @property
    def collection(self):
        return self.client.get_collection(self.name)

    def count(self) -> int:
        return self.collection.count()

    def starts(self, batch: int) -> Iterator[int]:
        yield from range(0, self.count(), batch)

    def page(self, at, batch: int) -> list[tuple]:
        found = self.collection.get(limit=batch, offset=at, include=["embeddings", "metadatas", "documents"])
        n = len(found["ids"])
        metas, texts = found.get("metadatas") or [None] * n, found.get("documents") or [None] * n
        return [(str(i), [float(x) for x in v], t, _plain(m)) for i, v, t, m in zip(found["ids"], found["embeddings"], texts, metas)]

    def ensure(self, dims: int, metric: str) -> None:
        self.client.get_or_create_collection(self.name, metadata={"hnsw:space": "cosine" if metric == "cosine" else "l2"})

    def upsert(self, rows: list[Row]) -> None:
        self.collection.upsert(ids=[r["id"] for r in rows], embeddings=[list(r["vec"]) for r in rows], metadatas=[r["payload"] or None for r in rows], documents=[r["text"] or "" for r in rows])


class Pinecone:
    """Vectors of a namespace by pages of ids; a page begins at a token, the first at None."""

    def __init__(self, client, collection: str, text_field: str = "text"):
        self.client, self.namespace, self.text = client, collection, text_field

    @staticmethod
    def connect(options: dict):
        try:
            from pinecone import Pinecone as Service
        except ImportError:
            raise ServiceError("pinecone isn't installed; install it or pass a client") from None
        return Service(api_key=options.get("api_key") or os.environ.get("PINECONE_API_KEY")).Index(options["index"])

    def count(self) -> int:
        return self.client.describe_index_stats().get("namespaces", {}).get(self.namespace, {}).get("vector_count", 0)

    def starts(self, batch: int) -> Iterator[object]:
        token = None
        while True:
            yield token
            token = self.client.list_paginated(namespace=self.namespace, limit=batch, pagination_token=token).get("next")
            if not token:
                return

    def page(self, at, batch: int) -> list[tuple]:
        ids = self.client.list_paginated(namespace=self.namespace, limit=batch, pagination_token=at)["ids"]
        found = self.client.fetch(ids=ids, namespace=self.namespace)["vectors"] if ids else {}
        return [(i, [float(x) for x in v["values"]], (v.get("metadata") or {}).get(self.text), _plain(v.get("metadata"))) for i, v in found.items()]

    def ensure(self, dims: int, metric: str) -> None:
        """A namespace is there from its first vector on."""

    def upsert(self, rows: list[Row]) -> None:
        self.client.upsert(vectors=[{"id": r["id"], "values": list(r["vec"]), "metadata": (r["payload"] or {}) | ({self.text: r["text"]} if r["text"] is not None else {})} for r in rows], namespace=self.namespace)


SERVICES = {"qdrant": Qdrant, "chroma": Chroma, "pinecone": Pinecone}


def open_service(options: dict):
    """The service of these options, connected."""
    kind = options.get("service", "")
    if kind not in SERVICES:
        raise ServiceError(f"unknown service {kind}; known: {', '.join(sorted(SERVICES))}")
    if not options.get("collection") and kind != "pinecone":
        raise ServiceError("name a collection")
    own = SERVICES[kind]
    if options.get("client"):
        module, _, factory = options["client"].partition(":")
        client = getattr(importlib.import_module(module), factory)(dict(options))
    else:
        client = own.connect(options)
    return own(client, options.get("collection", ""), options.get("text_field", "text"))


class _Pages(InputPartition):
    def __init__(self, starts: list):
        super().__init__(None)
        self.starts = starts


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.batch, self.pages = options, int(options.get("batch", BATCH)), int(options.get("pages", PAGES))

    def partitions(self) -> list[_Pages]:
        starts = list(open_service(self.options).starts(self.batch))
        return [_Pages(starts[k : k + self.pages]) for k in range(0, len(starts), self.pages)] or [_Pages([])]

    def read(self, partition: _Pages) -> Iterator[tuple]:
        service = open_service(self.options)
        for at in partition.starts:
            yield from service.page(at, self.batch)


class _Written(WriterCommitMessage):
    def __init__(self, n: int):
        self.n = n


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.options, self.batch = options, int(options.get("batch", BATCH))

    def write(self, rows: Iterator[Row]) -> _Written:
        service, held, n, ready = open_service(self.options), [], 0, False
        for row in rows:
            if not ready:
                service.ensure(len(row["vec"]), target_metric(self.options.get("distance")))
                ready = True
            held.append(row)
            if len(held) == self.batch:
                service.upsert(held)
                n, held = n + len(held), []
        if held:
            service.upsert(held)
        return _Written(n + len(held))

    def commit(self, messages: list) -> None:
        """Nothing is left to do: upserts are final."""

    def abort(self, messages: list) -> None:
        """What was upserted stays, and is upserted again by the next run."""


class VectorService(DataSource):
    """``format("vector_service")``."""

    @classmethod
    def name(cls) -> str:
        return "vector_service"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options))


def read(spark: SparkSession, **options: str) -> DataFrame:
    """A collection as a store."""
    spark.dataSource.register(VectorService)
    return spark.read.format("vector_service").options(**options).load()


def write(df: DataFrame, **options: str) -> None:
    """Upsert a store into a collection."""
    df.sparkSession.dataSource.register(VectorService)
    df.select("id", "vec", "text", "payload").write.format("vector_service").options(**options).mode("append").save()


def migrated_name(collection: str) -> str:
    """What a collection is called after migration."""
    return f"{collection}_migrated"
