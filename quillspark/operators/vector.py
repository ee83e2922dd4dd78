"""Exact vector search by inner product of unit vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inner_product(column: str, query: Sequence[float]) -> Column:
    """In double, 0 beyond the shorter; the query is a literal array, so the scan stays in the JVM."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return F.aggregate(F.zip_with(column, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def scores(vectors: DataFrame, query: Sequence[float], column: str = "vector") -> DataFrame:
    """The vectors of the query's length with their score, 4 decimals."""
    fits = F.size(column) == len(query)
    return vectors.where(fits).withColumn("score", F.round(inner_product(column, query) * 10000) / 10000)


def top_k(vectors: DataFrame, query: Sequence[float], limit: int = 10, column: str = "vector", key: str = "rel_path") -> DataFrame:
    return scores(vectors, query, column).orderBy(F.desc("score"), key).limit(limit)


def best_per_note(vectors: DataFrame, query: Sequence[float], limit: int = 10, column: str = "vector", key: str = "rel_path", order: str = "chunk_index") -> DataFrame:
    """The best chunk of each note, the first of equal ones: pre-aggregated, then the best notes."""
    scored = scores(vectors, query, column)
    rest = [c for c in scored.columns if c not in (key, "score", order)]
    best = scored.groupBy(key).agg(F.max_by(F.struct(*rest, order, "score"), F.struct("score", -F.col(order))).alias("b"))
    return best.select(key, "b.*").orderBy(F.desc("score"), key).limit(limit)


# --- stored vectors: rows of chunks with the hash of the note that they were made from


def to_embed(meta: DataFrame, vectors: DataFrame) -> DataFrame:
    """(rel_path, content_hash): notes that have no vectors of their present text."""
    return meta.select("rel_path", "content_hash").join(vectors.select("rel_path", "content_hash").distinct(), ["rel_path", "content_hash"], "left_anti")


def orphans(vectors: DataFrame, meta: DataFrame) -> DataFrame:
    """Vectors of notes that are gone."""
    return vectors.join(meta.select("rel_path"), "rel_path", "left_anti")


def still_current(vectors: DataFrame, meta: DataFrame) -> DataFrame:
    """Vectors whose note still has the text that they were made from; those of changed and of deleted notes go."""
    return vectors.join(meta.select("rel_path", "content_hash"), ["rel_path", "content_hash"], "left_semi")


def from_blob(column: str) -> Column:
    """A packed little-endian float vector as an array."""
    import numpy as np

    @F.pandas_udf("array<float>")
    def unpack(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4"))

    return unpack(column)


def to_blob(column: str) -> Column:
    import numpy as np

    @F.pandas_udf("binary")
    def pack(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return pack(column)


def embed(chunks: DataFrame, embedder: Callable[[list[str]], list[list[float]]], text: str = "embed_text") -> DataFrame:
    """The chunks with the vector that a pluggable embedder gives their passage, scaled to length 1."""
    import numpy as np

    rest = chunks.drop("vector", "dim")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema) + ", vector array<float>, dim bigint"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            got = np.asarray(embedder([f"passage: {t}" for t in part[text]]), np.float32).reshape(len(part), -1)
            size = np.linalg.norm(got, axis=1, keepdims=True)
            yield part.assign(vector=list(got / np.where(size > 0, size, 1)), dim=got.shape[1])

    return rest.mapInPandas(run, schema)
