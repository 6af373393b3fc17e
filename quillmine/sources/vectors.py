"""The contract of a vector store, and one over a store's table of chunks."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmine.operators import retrieval, tables
from quillmine.sources.store import Store


class VectorStore(Protocol):
    """What the engine asks of a vector store; owners never see each other's rows."""

    def put(self, rows: DataFrame) -> None: ...

    def update(self, rows: DataFrame) -> None: ...

    def delete(self, ids: Sequence[str], user_id: str) -> None: ...

    def delete_document(self, document_id: str, user_id: str) -> None: ...

    def near(self, vector: Sequence[float], user_id: str, k: int, floor: float = 0.0, topic: str | None = None, tags: Sequence[str] = ()) -> DataFrame: ...

    def matching(self, terms: Sequence[str], user_id: str, k: int) -> DataFrame: ...


class TableVectors:
    """A VectorStore of the rows of one table with chunk_id, document_id, user_id and vector."""

    def __init__(self, store: Store, name: str = "chunks"):
        self.store, self.name = store, name

    def put(self, rows: DataFrame) -> None:
        """Add rows; ones whose id is known take the place of the old ones."""
        old = self.store.read(self.name)
        full = rows.withColumns({c: F.lit(None) for c in old.columns if c not in rows.columns}).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in old.schema])
        self.store.write(self.name, tables.replaced(old, full, "chunk_id"))

    def update(self, rows: DataFrame) -> None:
        """Change the given columns of rows that are there."""
        old = self.store.read(self.name)
        known = rows.join(old.select("chunk_id"), "chunk_id", "left_semi")
        self.store.write(self.name, tables.merged(old, known, ["chunk_id"]))

    def delete(self, ids: Sequence[str], user_id: str) -> None:
        self.store.write(self.name, tables.deleted(self.store.read(self.name), ids, owner=user_id))

    def delete_document(self, document_id: str, user_id: str) -> None:
        self.store.write(self.name, tables.without_document({self.name: self.store.read(self.name)}, document_id, user_id)[self.name])

    def near(self, vector: Sequence[float], user_id: str, k: int, floor: float = 0.0, topic: str | None = None, tags: Sequence[str] = ()) -> DataFrame:
        own = retrieval.restricted(self.store.read(self.name), user_id, topic=topic, tags=tags)
        return retrieval.vector_hits(own.where("vector is not null"), vector, k, floor)

    def matching(self, terms: Sequence[str], user_id: str, k: int) -> DataFrame:
        return retrieval.keyword_hits(retrieval.restricted(self.store.read(self.name), user_id), terms, k)
