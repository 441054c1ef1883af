"""Exact cosine search over stored vectors, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.frames import small
from quarry.operators.sparse import ranked


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


#: Rows of a block: some MB of vectors, and a score matrix of some MB for two blocks.
VECTORS, QUERIES = 8192, 256


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows (id, v, tag) packed to rows (ids, data, tags, dims) of ``size`` each at most; the vectors as unit vectors, zero vectors as they are.

    Vectors of different dimensions go to different blocks; those that hold a
    null or not-a-number are left out.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1)
            lengths = np.diff(v.offsets.to_numpy())
            flat = v.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
            starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
            for dims in np.unique(lengths[lengths > 0]):
                own = np.nonzero(lengths == dims)[0]
                m = flat[starts[own][:, None] + np.arange(dims)]
                good = np.isfinite(m).all(axis=1)
                own, m = own[good], m[good]
                for at in range(0, len(own), size):
                    part, some = own[at : at + size], m[at : at + size]
                    length = np.sqrt((some * some).sum(axis=1, keepdims=True))
                    unit = np.divide(some, length, out=np.zeros_like(some), where=length > 0)
                    ids, tags = batch.column(0).take(pa.array(part)).to_pylist(), batch.column(2).take(pa.array(part)).to_pylist()
                    yield pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([unit.tobytes()]), pa.array([tags], pa.list_(pa.string())), pa.array([int(dims)], pa.int32())], names=["ids", "data", "tags", "dims"])

    return rows.mapInArrow(pack, "ids array<long>, data binary, tags array<string>, dims int")


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int, match: tuple[str, str] | None = None, query: str = "query_id", key: str = "vec_id") -> DataFrame:
    """Rows (query, key, rank, score): the nearest of ``vectors`` (key, embedding) for queries (query, vector).

    Every query meets every vector of its dimension: packed blocks of queries
    meet packed blocks of vectors, each meeting is one matrix product that keeps
    the best ``k`` of each query, and only those are ranked.  Queries are
    broadcast if the optimizer knows that they are few, else blocks meet in a
    cartesian plan.  ``match`` names a column of the vectors and one of the
    queries that must be equal; tags that no query wants are dropped before
    packing.  Ties, to nine decimals, go to the smaller key.  Null vectors, and
    those that hold a null, meet nothing.
    """
    own, want = (F.col(c).cast("string") for c in match) if match else (F.lit("").cast("string"),) * 2
    stored = vectors.where("embedding IS NOT NULL").select(F.col(key).cast("long").alias("id"), "embedding", own.alias("tag"))
    asked = queries.where("vector IS NOT NULL").select(F.col(query).cast("long").alias("id"), "vector", want.alias("tag"))
    if match:
        stored = stored.join(asked.select("tag").distinct(), "tag", "left_semi").select("id", "embedding", "tag")
    v, q = _blocks(stored, VECTORS), _blocks(asked, QUERIES)
    q = q.select(F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.col("tags").alias("q_tags"), F.col("dims").alias("q_dims"))
    met = v.join(F.broadcast(q) if small(asked) else q, F.col("dims") == F.col("q_dims"))  # blocks, not rows

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one meeting at a time, its vectors read where they lie
                ids, data, tags, _, q_ids, q_data, q_tags, _ = (c[i] for c in batch.columns)
                names, q_names = ids.values.to_numpy(), q_ids.values.to_numpy()
                scores = np.frombuffer(q_data.as_buffer()).reshape(len(q_names), -1) @ np.frombuffer(data.as_buffer()).reshape(len(names), -1).T
                scores = np.round(np.maximum((1 + scores) / 2, 0), 12)
                if match:
                    codes: dict[str | None, int] = {}
                    own, want = (np.array([codes.setdefault(t, len(codes)) for t in x.as_py()]) for x in (tags, q_tags))
                    scores[want[:, None] != own[None, :]] = -1
                least = np.round(np.partition(scores, len(names) - k, axis=1)[:, len(names) - k], 9) if k < len(names) else np.zeros(len(q_names))
                rounded = np.round(scores, 9)
                row, column = np.nonzero((rounded >= least[:, None]) & (scores >= 0))  # the best k and what ties with the last of them
                order = np.lexsort((names[column], -rounded[row, column], row))
                row, column = row[order], column[order]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                row, column = row[rank < k], column[rank < k]
                yield pa.RecordBatch.from_arrays([pa.array(q_names[row]), pa.array(names[column]), pa.array(scores[row, column])], names=[query, key, "score"])

    return ranked(met.mapInArrow(best, f"{query} long, {key} long, score double"), k, query, key)


def dimensions(vectors: DataFrame) -> DataFrame:
    """One row (n_vectors, n_dims, dim, consistent)."""
    size = F.size("embedding")
    return vectors.agg(F.count("*").alias("n_vectors"), F.countDistinct(size).alias("n_dims"), F.max(size).cast("long").alias("dim"), (F.countDistinct(size) <= 1).alias("consistent"))
