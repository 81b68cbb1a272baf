"""Exact top-k by inner product over an impact-ordered index, score at a time.

Vectors of integers are dealt to shards of bounded size. In a shard, components are counted from the least of their
dimension and written in binary; a posting segment is the set of vectors that have one bit of one dimension. For a
query, what a segment adds is its component times the bit's value, so its impact is quantised to powers of two.
Segments are processed by descending impact, one power after another, for a block of queries at once. After each, what
lower bits can still add or take bounds every sum from both sides; the search of a query ends on the proof that all
but a few vectors lie below k others, and those few are rescored exactly. Queries travel to the shards in sorted blocks, and a shard's answers are k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.rowwise import workers_can_import

SHARD_ROWS = 8192
QUERY_BLOCK = 256
EXACT_LIMIT = 1 << 52  # sums below are exact as doubles


class ImpactIndex:
    """Segments of one shard: vectors (rows of `values`) of one length, and their ids."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], values[order]
        self.least = self.values.min(0) if len(values) else np.zeros(values.shape[1], np.int64)
        self.peak = max((abs(int(v)) for v in (self.values.max(initial=0), self.values.min(initial=0))), default=0)
        # counted from the least, as many bits as the widest dimension needs; beyond the limit no segment is used
        self.exact = self.peak < 1 << 30
        self.above = self.values - self.least if self.exact else self.values
        self.bits = int(self.above.max(initial=0)).bit_length() if self.exact else 0

    def _fits(self, queries: np.ndarray) -> np.ndarray:
        """Queries whose sums are exact as doubles."""
        limit = (EXACT_LIMIT - 1) // max(2 * self.peak * max(self.values.shape[1], 1), 1)
        return self.exact & (queries <= limit).all(1) & (queries >= -limit).all(1)

    def _possible_rows(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[np.ndarray]:
        """For each query the rows that can be among the best k of those without its own id."""
        n = len(self.ids)
        first, last = np.searchsorted(self.ids, own, "left"), np.searchsorted(self.ids, own, "right")
        everything = np.arange(n)
        out = [np.r_[everything[:a], everything[b:]] for a, b in zip(first, last)]
        open_queries = np.flatnonzero(self._fits(queries)) if n > 4 * k else everything[:0]
        if not len(open_queries) or not self.bits:
            return out
        q = queries[open_queries].astype(np.float64)
        sums = np.repeat((q @ self.least.astype(np.float64))[:, None], n, axis=1)
        for row, i in enumerate(open_queries):
            sums[row, first[i] : last[i]] = -np.inf
        gain, loss = np.maximum(q, 0).sum(1), np.minimum(q, 0).sum(1)
        few = max(4 * k, n // 64)
        for bit in range(self.bits - 1, -1, -1):
            sums += (q * float(1 << bit)) @ ((self.above >> bit) & 1).T.astype(np.float64)
            rest = float((1 << bit) - 1)
            if bit > self.bits - 4 and bit:
                continue  # the highest bits alone prove nothing
            kth = np.partition(sums, n - k, axis=1)[:, n - k]
            possible = sums + (rest * gain)[:, None] >= (kth + rest * loss)[:, None]
            done = possible.sum(1) <= few if bit else np.ones(len(q), bool)
            for row in np.flatnonzero(done):
                rows = np.flatnonzero(possible[row])
                i = open_queries[row]
                out[i] = rows[(rows < first[i]) | (rows >= last[i])]
            if done.all():
                break
            left = ~done
            q, sums, gain, loss, open_queries = q[left], sums[left], gain[left], loss[left], open_queries[left]
        return out

    def _scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        most = self.peak * max(abs(int(v)) for v in (query.max(initial=0), query.min(initial=0))) * len(query)
        if most < 1 << 63:
            return self.values[rows] @ query
        exact = [sum(int(a) * int(b) for a, b in zip(v, query)) for v in self.values[rows]]
        if any(not -(1 << 63) <= s < 1 << 63 for s in exact):
            raise OverflowError("an inner product does not fit a long")
        return np.array(exact, np.int64)

    def best(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
        """(id, score) of the best k rows for each query but those with its own id; ties to smaller ids."""
        out = []
        for query, rows in zip(queries, self._possible_rows(queries, own, k)):
            scores = self._scores(rows, query)
            if len(rows) > k:
                kth = np.partition(scores, len(rows) - k)[len(rows) - k]
                rows, scores = rows[scores >= kth], scores[scores >= kth]
            # highest first, without turning the sign of the least long
            order = np.lexsort((-self.ids[rows], scores))[::-1][:k]
            out.append(list(zip(self.ids[rows[order]].tolist(), scores[order].tolist())))
        return out


def _as_rows(column: pa.Array) -> list[np.ndarray]:
    flat = column.values.to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(offsets, offsets[1:])]


def integer_vectors(table: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * x) of every component; rows with a null id, a null vector or a component
    that is null, not finite or 2**62 and more when scaled are left out, and equal rows count once."""
    vector = F.col(vector_col).cast("array<double>")
    rows = table.select(F.col(id_col).cast("long").alias("id"), vector.alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")) & (F.abs(x * float(scale)) < 2.0**62))
    )
    return rows.select("id", F.transform("v", lambda x: F.floor(x * float(scale))).alias("v")).distinct()


def top_k(
    table: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding",
    scale: int = 256, shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(query_id, rank, id_col, score): the best k rows for each row whose id is divisible by `every`.

    Only vectors of the query's length are compared; rows with the query's id are not. Ties go to smaller ids; equal
    rows count once. A query finds fewer rows where there are fewer, so an empty table gives no rows. A score that
    does not fit a long raises OverflowError. Other columns take no part.
    """
    spark = table.sparkSession
    workers_can_import(spark)
    rows = integer_vectors(table, id_col, vector_col, scale)
    shards = max(1, -(-rows.count() // shard_rows))
    members = rows.select(F.pmod(F.xxhash64("id", "v"), F.lit(shards)).alias("shard"), F.lit(0).alias("query"), "id", "v")
    queries = rows.where(F.col("id") % every == 0)
    visits = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.lit(1).alias("query"), "id", "v")
    placed = members.unionByName(visits).repartition("shard").sortWithinPartitions("shard", "query", "id")
    schema = pa.schema([("query_id", pa.int64()), ("query_key", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])

    def answers(indexes: dict[int, ImpactIndex], asked: list[tuple[int, int, np.ndarray]]) -> list[tuple]:
        out = []
        by_length: dict[int, list[tuple[int, int, np.ndarray]]] = {}
        for ask in asked:
            by_length.setdefault(len(ask[2]), []).append(ask)
        for length, some in by_length.items():
            if length in indexes:
                best = indexes[length].best(np.stack([v for _, _, v in some]), np.array([i for i, _, _ in some]), k)
                out += [(i, key, x, score) for (i, key, _), found in zip(some, best) for x, score in found]
        return out

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, members, indexes, asked = None, {}, None, []

        def flush() -> Iterator[pa.RecordBatch]:
            out = answers(indexes, asked) if asked else []
            asked.clear()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

        for batch in batches:
            columns = (batch.column("shard").to_pylist(), batch.column("query").to_pylist(), batch.column("id").to_pylist())
            keys = batch.column("key").to_pylist()
            for s, is_query, i, key, v in zip(*columns, keys, _as_rows(batch.column("v"))):
                if s != shard:
                    yield from flush()
                    shard, members, indexes = s, {}, None
                if not is_query:
                    members.setdefault(len(v), []).append((i, v.copy()))
                    continue
                if indexes is None:
                    indexes = {
                        n: ImpactIndex(np.array([x for x, _ in m]), np.stack([y for _, y in m])) for n, m in members.items()
                    }
                asked.append((i, key, v.copy()))
                if len(asked) == QUERY_BLOCK:
                    yield from flush()
        yield from flush()

    found = placed.withColumn("key", F.xxhash64("v")).mapInArrow(run, "query_id long, query_key long, id long, score long")
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
