"""Stand-ins for vector services, kept in a folder that all workers share; for tests and trials without a network.

They have the calls of the services' clients that the connectors use.  A
collection is a SQLite file indexed by key, so that a page is read from where it
begins, a count reads no vectors, and concurrent upserts wait for each other.
"""

from __future__ import annotations

import json
import os
import sqlite3
from collections.abc import Iterable
from contextlib import closing
from types import SimpleNamespace


class _Collection:
    """Rows (key, value) in the order of their keys as text."""

    def __init__(self, path: str):
        self.path = f"{path}/rows.sqlite"

    def _open(self) -> sqlite3.Connection:
        own = sqlite3.connect(self.path, timeout=600, isolation_level=None)
        own.execute("pragma synchronous = off")
        return own

    def create(self) -> None:
        """Made under its name by a rename, as workers may do it at once: the first one stays."""
        folder = os.path.dirname(self.path)
        os.makedirs(folder, exist_ok=True)
        if os.path.exists(self.path):
            return
        fresh = f"{self.path}.{os.getpid()}.new"
        with closing(sqlite3.connect(fresh)) as own:
            own.execute("create table if not exists rows (name text primary key, key text not null, value text not null)")
            own.commit()
        try:
            os.link(fresh, self.path)
        except FileExistsError:
            pass
        os.remove(fresh)

    def exists(self) -> bool:
        return os.path.exists(self.path)

    def put(self, rows: Iterable[tuple]) -> None:
        self.create()
        cells = [(str(key), json.dumps(key), json.dumps(value)) for key, value in rows]
        with closing(self._open()) as own:
            own.execute("begin immediate")
            own.executemany("insert or replace into rows values (?, ?, ?)", cells)
            own.execute("commit")

    def _rows(self, sql: str, values: Iterable = ()) -> list[tuple]:
        if not self.exists():
            return []
        with closing(self._open()) as own:
            return own.execute(sql, tuple(values)).fetchall()

    def count(self) -> int:
        return self._rows("select count(*) from rows")[0][0] if self.exists() else 0

    def names(self, at: str | None, limit: int) -> list[str]:
        """Keys from ``at`` on, as text."""
        return [r[0] for r in self._rows("select name from rows where name >= ? order by name limit ?", ("" if at is None else at, limit))]

    def page(self, at: str | None, limit: int) -> list[tuple]:
        """(key, value) from the key ``at`` on."""
        return [(json.loads(k), json.loads(v)) for k, v in self._rows("select key, value from rows where name >= ? order by name limit ?", ("" if at is None else at, limit))]

    def page_at(self, offset: int, limit: int) -> list[tuple]:
        """(key, value) from a row's number on: keys alone are passed over to find it."""
        first = self._rows("select name from rows order by name limit 1 offset ?", (offset,))
        return self.page(first[0][0], limit) if first else []

    def of(self, keys: list) -> list[tuple]:
        out = []
        for at in range(0, len(keys), 500):
            some = [str(k) for k in keys[at : at + 500]]
            out += self._rows(f"select key, value from rows where name in ({','.join('?' * len(some))}) order by name", some)
        return [(json.loads(k), json.loads(v)) for k, v in out]


class FakeQdrant:
    def __init__(self, root: str):
        self.root = root

    def _of(self, name: str) -> _Collection:
        return _Collection(f"{self.root}/{name}")

    def get_collection(self, name: str):
        if not self._of(name).exists():
            raise LookupError(name)
        return SimpleNamespace(points_count=self._of(name).count())

    def create_collection(self, collection_name: str, vectors_config) -> None:
        self._of(collection_name).create()

    def scroll(self, collection_name: str, limit: int, offset, with_payload: bool, with_vectors: bool):
        own, at = self._of(collection_name), None if offset is None else str(offset)
        names = own.names(at, limit + 1)
        rows = own.page(at, limit) if with_payload or with_vectors else [(n, {}) for n in names[:limit]]
        points = [SimpleNamespace(id=k, vector=v["vector"] if with_vectors else None, payload=v["payload"] if with_payload else None) for k, v in rows]
        return points, names[limit] if len(names) > limit else None

    def upsert(self, collection_name: str, points: list[dict]) -> None:
        self._of(collection_name).put((p["id"], {"vector": p["vector"], "payload": p["payload"]}) for p in points)


class FakeChroma:
    def __init__(self, root: str):
        self.root = root

    def get_collection(self, name: str):
        own = _Collection(f"{self.root}/{name}")
        if not own.exists():
            raise LookupError(name)
        return FakeChromaCollection(own)

    def get_or_create_collection(self, name: str, metadata: dict | None = None):
        _Collection(f"{self.root}/{name}").create()
        return self.get_collection(name)


class FakeChromaCollection:
    def __init__(self, own: _Collection):
        self.own = own

    def count(self) -> int:
        return self.own.count()

    def get(self, limit: int, offset: int, include: list[str]) -> dict:
        rows = self.own.page_at(offset, limit)
        return {"ids": [k for k, _ in rows], "embeddings": [v["embedding"] for _, v in rows], "metadatas": [v["metadata"] for _, v in rows], "documents": [v["document"] for _, v in rows]}

    def upsert(self, ids: list, embeddings: list, metadatas: list, documents: list) -> None:
        self.own.put((i, {"embedding": e, "metadata": m, "document": d}) for i, e, m, d in zip(ids, embeddings, metadatas, documents))


class FakePinecone:
    def __init__(self, root: str):
        self.root = root

    def _of(self, namespace: str) -> _Collection:
        return _Collection(f"{self.root}/{namespace or 'default'}")

    def describe_index_stats(self) -> dict:
        names = os.listdir(self.root) if os.path.isdir(self.root) else []
        return {"namespaces": {n: {"vector_count": self._of(n).count()} for n in names}}

    def list_paginated(self, namespace: str, limit: int, pagination_token=None) -> dict:
        ids = self._of(namespace).names(pagination_token, limit + 1)
        return {"ids": ids[:limit], "next": ids[limit] if len(ids) > limit else None}

    def fetch(self, ids: list, namespace: str) -> dict:
        return {"vectors": {k: {"values": v["values"], "metadata": v["metadata"]} for k, v in self._of(namespace).of(ids)}}

    def upsert(self, vectors: list[dict], namespace: str) -> None:
        self._of(namespace).put((v["id"], {"values": v["values"], "metadata": v["metadata"]}) for v in vectors)


def qdrant(options: dict) -> FakeQdrant:
    return FakeQdrant(options["root"].removeprefix("file://"))


def chroma(options: dict) -> FakeChroma:
    return FakeChroma(options["root"].removeprefix("file://"))


def pinecone(options: dict) -> FakePinecone:
    return FakePinecone(options["root"].removeprefix("file://"))
