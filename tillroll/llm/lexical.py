"""Ranked lexical search by the Best Position Algorithm.

Documents are dealt to shards of bounded size where they are. In a shard every query term has a list of its
documents by descending impact. A search reads all lists of its terms in step; a document met for the first time is
looked up in every other list by direct access, which gives its exact score and its position in each list. Positions
seen, by whichever way, are marked; a list's best position is the last one before the first unseen. What no document
has shown yet cannot score more than the impacts just behind the best positions, taken together. When that threshold
falls strictly below the k-th score, the search of the shard ends: documents of equal score are never left out.

Best scores go on from shard to shard of a task as a floor; a task hands on k rows a query.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tillroll.llm.rowwise import with_text_columns, workers_can_import
from tillroll.session import stage

# Bytes of a term (ASCII letters and digits, everything beyond ASCII), letters in lower case.
TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

QUERY_BYTES = 4 << 20  # text of the queries that one pass over the documents answers
CELLS = 1 << 22  # documents of a shard times the terms of the longest query
SHARD_ROWS = (64, 8192)
FIRST_STEP = 32  # positions of the first round; each round doubles them
MERGE_PARTS = 64


def terms(text: str | None) -> list[bytes]:
    """The terms of a text, in order, with repeats."""
    return (text or "").encode("utf-8", "replace").translate(TERM_BYTES).split()


@dataclass(frozen=True)
class Query:
    item: object
    words: dict[bytes, int]


def query_blocks(queries: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[Query]]:
    """Queries in blocks of at most `limit` bytes of text, or one longer text."""
    block, size = [], 0
    for item, text in queries.select(id_col, F.col(text_col).cast("string")).toLocalIterator():
        length = len((text or "").encode("utf-8", "replace"))
        if block and size + length > limit:
            yield block
            block, size = [], 0
        block.append(Query(item, Counter(terms(text))))
        size += length
    if block:
        yield block


def postings(docs: DataFrame, number: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(id, n, ids, tf) of every document with a term: how many it has, and how often each query term occurs."""

    def count(data: np.ndarray, offsets: np.ndarray) -> list:
        raw = data.tobytes().translate(TERM_BYTES)
        n, found = [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            words = raw[a:b].split()
            n.append(len(words))
            found.append(np.fromiter(map(number.get, words, repeat(-1)), np.int64, len(words)))
        owner = np.repeat(np.arange(len(n)), n)
        term = np.concatenate([*found, np.zeros(0, np.int64)])
        known = term >= 0
        cell, times = np.unique(owner[known] * max(len(number), 1) + term[known], return_counts=True)
        owner, term = np.divmod(cell, max(len(number), 1))
        bounds = np.searchsorted(owner, np.arange(len(n) + 1)).astype(np.int32)
        return [n, *(pa.ListArray.from_arrays(pa.array(bounds), pa.array(v, pa.int32())) for v in (term, times))]

    fields = [
        T.StructField("n", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("tf", T.ArrayType(T.IntegerType())),
    ]
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return with_text_columns(keyed, count, fields, "text", ["id"]).where("n > 0")


def term_weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def lengths(n: np.ndarray, documents: int, all_terms: int) -> np.ndarray:
    """The length measure m of documents with `n` terms, in whole numbers also where 64 bits do not hold the product."""
    if 25 * documents * int(n.max(initial=0)) < 1 << 63:
        return 75 + (25 * n * documents) // all_terms
    return np.array([75 + 25 * v * documents // all_terms for v in n.tolist()], np.int64)


class Shard:
    """Impact lists of some documents. Documents are numbered by ascending id, a null id last."""

    def __init__(self, n: np.ndarray, bounds: np.ndarray, ids: np.ndarray, tf: np.ndarray, documents: int, all_terms: int):
        m = lengths(n, documents, all_terms)
        doc = np.repeat(np.arange(len(n)), np.diff(bounds))
        impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[doc])
        order = np.lexsort((doc, -impact, ids))
        self.size = len(n)
        self.doc, self.impact = doc[order].astype(np.int32), impact[order].astype(np.int32)
        self.terms, self.first = np.unique(ids[order], return_index=True)
        self.last = np.r_[self.first[1:], len(order)].astype(np.int64)
        self.looked_at = 0  # documents that the last search scored

    def lists(self, term: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and weight of the lists of those terms that occur here."""
        if not len(self.terms):
            none = np.zeros(0, np.int64)
            return none, none, none
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        here = self.terms[at] == term
        return self.first[at[here]], self.last[at[here]], weight[here]

    def search(self, term: np.ndarray, weight: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of all that are seen and may be among the best k; `floor` has up to k scores
        of other documents, highest first. Every document left out scores less than k others."""
        start, end, weight = self.lists(term, weight)
        size, self.looked_at = end - start, 0
        none = np.zeros(0, np.int64)
        if not len(start):
            return none, none
        kth = int(floor[k - 1]) if len(floor) >= k else 0
        threshold = int((weight * self.impact[start]).sum())
        if threshold < kth:
            return none, none
        begin = np.r_[0, np.cumsum(size)]
        flat = np.arange(begin[-1]) - np.repeat(begin[:-1] - start, size)
        # direct access: position in the concatenated lists of (list, document), -1 where it is missing
        place = np.full((len(start), self.size), -1, np.int32)
        place[np.repeat(np.arange(len(start)), size), self.doc[flat]] = np.arange(begin[-1])
        impact = self.impact[flat].astype(np.int64)
        seen, met = np.zeros(begin[-1], bool), np.zeros(self.size, bool)
        docs, scores, best = [], [], floor[:k].astype(np.int64)
        depth, step = 0, FIRST_STEP
        while True:
            low, high = np.minimum(start + depth, end), np.minimum(start + depth + step, end)
            count = high - low
            total = int(count.sum())
            if not total:
                break
            at = np.arange(total) + np.repeat(low - np.r_[0, np.cumsum(count)[:-1]], count)
            fresh = np.unique(self.doc[at])
            fresh = fresh[~met[fresh]]
            met[fresh] = True
            self.looked_at += len(fresh)
            positions = place[:, fresh]
            found = positions >= 0
            seen[positions[found]] = True
            score = (np.where(found, impact[positions], 0) * weight[:, None]).sum(0)
            docs.append(fresh)
            scores.append(score)
            best = np.sort(np.r_[best, score])[::-1][:k]
            depth, step = depth + step, step * 2
            unseen = np.flatnonzero(~seen)
            next_unseen = np.r_[unseen, begin[-1]][np.searchsorted(unseen, begin[:-1])]
            behind = np.where(next_unseen < begin[1:], impact[np.minimum(next_unseen, begin[-1] - 1)], 0)
            if len(best) == k and int((weight * behind).sum()) < best[-1]:
                break
        docs, scores = np.concatenate(docs), np.concatenate(scores)
        keep = (scores > 0) & (scores >= (best[-1] if len(best) == k else 1))
        docs, scores = docs[keep], scores[keep]
        order = np.lexsort((docs, -scores))[:k]
        return docs[order], scores[order]


def _shard_rows(block: list[Query]) -> int:
    longest = max((len(q.words) for q in block), default=1)
    return max(SHARD_ROWS[0], min(SHARD_ROWS[1], CELLS // max(longest, 1)))


def _search_tasks(rows: DataFrame, block: list[Query], number: dict[bytes, int], weight: np.ndarray, documents: int, all_terms: int, k: int) -> DataFrame:
    """(query, task, id, score): the best k of each task for each query of the block."""
    asked = []
    for q in block:
        term = np.array([number[t] for t in q.words], np.int64)
        term_weights = weight[term] * np.array(list(q.words.values()), np.int64)
        order = np.argsort(term, kind="stable")
        term, term_weights = term[order], term_weights[order]
        asked.append((term[term_weights > 0], term_weights[term_weights > 0]))
    size = _shard_rows(block)
    schema = T.StructType(
        [T.StructField("query", T.IntegerType()), T.StructField("id", rows.schema["id"].dataType), T.StructField("score", T.LongType())]
    )
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(pa.array([], arrow.field(1).type), np.zeros(0, np.int64)) for _ in asked]
        for part in shards(batches, size):
            ids = part.column("id")
            by_id = pa.compute.sort_indices(ids, null_placement="at_end")
            part = part.take(by_id)
            ids, lists = part.column("id"), part.column("ids")
            bounds = np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
            shard = Shard(
                part.column("n").to_numpy(), bounds,
                lists.flatten().to_numpy().astype(np.int64), part.column("tf").flatten().to_numpy().astype(np.int64),
                documents, all_terms,
            )
            for i, (term, term_weights) in enumerate(asked):
                known, known_scores = best[i]
                found, scores = shard.search(term, term_weights, k, known_scores)
                if len(found):
                    both = pa.concat_arrays([known, ids.take(pa.array(found))])
                    all_scores = np.r_[known_scores, scores]
                    id_rank = np.empty(len(both), np.int64)
                    id_rank[pa.compute.sort_indices(both, null_placement="at_end").to_numpy()] = np.arange(len(both))
                    order = np.lexsort((id_rank, -all_scores))[:k]
                    best[i] = both.take(pa.array(order)), all_scores[order]
        for i, (ids, scores) in enumerate(best):
            if len(scores):
                number_column = pa.array(np.full(len(scores), i, np.int32))
                yield pa.RecordBatch.from_arrays([number_column, ids, pa.array(scores)], schema=arrow)

    return rows.mapInArrow(run, schema).withColumn("task", F.spark_partition_id())


def shards(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows of a task in parts of `size` rows."""
    held, n = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            take = min(size - n, batch.num_rows - at)
            held.append(batch.slice(at, take))
            at, n = at + take, n + take
            if n == size:
                yield _joined(held)
                held, n = [], 0
    if n:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _best(found: DataFrame, k: int) -> DataFrame:
    """The best k of each query, merged in two steps so that no task receives the rows of all tasks at once."""
    part = F.pmod(F.hash("task"), F.lit(MERGE_PARTS))
    order = [F.desc("score"), F.asc_nulls_last("id")]
    some = found.withColumn("rank", F.row_number().over(Window.partitionBy("query", part).orderBy(*order)))
    some = some.where(F.col("rank") <= k).drop("rank")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)


def search(
    docs: DataFrame,
    queries: DataFrame,
    k: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """(item, rank, id, score): the `k` documents of highest score above 0 for every query.

    Equal scores go by ascending id, a null id last. Null and empty texts have no terms: such a document is never
    found, such a query finds nothing. Every row is a document or a query of its own, repeated rows too. Whole texts
    count, however long. Other columns take no part. Empty tables give no rows. Queries are answered in blocks of
    `query_bytes` of text, with one pass over the documents each; their terms are what travels to the tasks.
    """
    spark = docs.sparkSession
    workers_can_import(spark)
    schema = T.StructType(
        [
            T.StructField(item_col, queries.schema[item_col].dataType),
            T.StructField("rank", T.IntegerType()),
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField("score", T.LongType()),
        ]
    )
    out = spark.createDataFrame([], schema)
    for block in query_blocks(queries, item_col, item_text_col, query_bytes):
        number = {t: i for i, t in enumerate(sorted(set().union(*(q.words for q in block))))}
        rows = stage(postings(docs, number, id_col, text_col), "postings")
        documents, all_terms = rows.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not number or not documents:
            continue
        df = rows.select(F.explode("ids").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).toPandas()
        in_documents = np.zeros(len(number), np.int64)
        in_documents[df["t"].to_numpy(int)] = df["df"].to_numpy(np.int64)
        weight = np.array([term_weight(documents, d) for d in in_documents.tolist()], np.int64)
        found = _search_tasks(rows, block, number, weight, documents, int(all_terms), k)
        best = _best(stage(found, "found"), k)
        items = spark.createDataFrame(
            [(i, q.item) for i, q in enumerate(block)],
            T.StructType([T.StructField("query", T.IntegerType()), T.StructField("item", schema[item_col].dataType)]),
        )
        named = best.join(F.broadcast(items), "query")
        out = out.unionByName(
            named.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
        )
    return out
