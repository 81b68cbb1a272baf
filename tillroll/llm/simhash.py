"""SimHash fingerprints of word shingles, and their near-duplicate groups by BK-trees.

Fingerprints that differ in at most r bits agree in one of r + 1 parts of their 64 bits, or in a of
r + a parts. So distinct fingerprints are dealt to shards by the values of such parts, each shard
holds a BK-tree, and every fingerprint is looked up in the trees of its own shards. More agreeing
parts (longer keys) keep the shards small when there are more fingerprints; any number finds every
link. A shard with many fingerprints is split into several trees, and its members are sent to each.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm.bktree import Forest, Sets
from tillroll.llm.components import components
from tillroll.llm.rowwise import with_text_columns, workers_can_import
from tillroll.session import stage

SEED = 42
BITS = 64
TREE_SIZE = 4096  # a shard with more members is split into trees of about this size


def fingerprint(text: bytes, shingle: int) -> int:
    """Bit set if over half of the shingle hashes (repeats included) have it."""
    words = text.lower().split()  # of bytes: lowers A-Z, splits on \x20 and \x09-\x0D
    if not words:
        return 0
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    hashes = np.frombuffer(b"".join(xxhash.xxh64_digest(p, SEED) for p in parts), np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def with_fingerprint(docs: DataFrame, shingle: int = 3, text_col: str = "text", keep=("doc_id",)) -> DataFrame:
    """Columns `keep` and `fingerprint`, as a signed long. Null and empty texts have fingerprint 0."""

    def run(data, offsets):
        raw, at = data.tobytes(), offsets.tolist()
        return [[fingerprint(raw[a:b], shingle) for a, b in zip(at, at[1:])]]

    return with_text_columns(docs, run, [T.StructField("fingerprint", T.LongType())], text_col, keep)


def _keys(radius: int, agreeing: int) -> list[int]:
    """Masks over the 64 bits: any two words within the radius agree under one of them."""
    parts = radius + agreeing
    borders = [BITS * i // parts for i in range(parts + 1)]
    bits = [sum(1 << b for b in range(low, high)) for low, high in zip(borders, borders[1:])]
    return [sum(chosen) for chosen in combinations(bits, agreeing)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _shards(words: DataFrame, radius: int, agreeing: int) -> DataFrame:
    """(key, value, part, query, fingerprint): members (query 0) and visitors (query 1) of each tree."""
    keys = F.array(*(F.lit(_signed(mask)) for mask in _keys(radius, agreeing)))
    rows = words.select("fingerprint", F.posexplode(keys).alias("key", "mask")).select(
        "key", F.col("fingerprint").bitwiseAND(F.col("mask")).alias("value"), "fingerprint"
    )
    sizes = rows.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))
    crowded = sizes.where(F.col("n") > TREE_SIZE).select("key", "value", F.ceil(F.col("n") / TREE_SIZE).alias("trees"))
    rows = rows.join(crowded, ["key", "value"], "left").withColumn("trees", F.coalesce("trees", F.lit(1)))
    own = F.pmod(F.xxhash64("fingerprint"), F.col("trees"))
    # a member of tree i visits the trees after it; the pair with a member of an earlier tree is found from there
    rows = rows.withColumn("own", own).withColumn("part", F.explode(F.sequence("own", F.col("trees") - 1)))
    return rows.select("key", "value", "part", (F.col("part") != F.col("own")).cast("int").alias("query"), "fingerprint")


class _Linker:
    """Takes sorted shard rows, gives links (u, v) that connect what lies within the radius in a shard."""

    def __init__(self, radius: int):
        self.radius = radius

    def links(self, tree: np.ndarray, query: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        member = query == 0
        forest = Forest(words[member], tree[member])
        own, sets = forest.words, Sets(int(member.sum()))
        u, v = [], []
        at = np.flatnonzero(member)
        back = np.full(len(words), -1)
        back[at] = np.arange(len(at))
        for q, node in forest.search(words, tree, self.radius):
            inside = back[q] >= 0
            sets.join(back[q[inside]], node[inside])
            q, node = q[~inside], node[~inside]
            if len(q):
                # a visitor is linked to one of its nodes, the others are joined to that one
                order = np.argsort(q, kind="stable")
                q, node = q[order], node[order]
                head = np.r_[True, q[1:] != q[:-1]]
                sets.join(node, node[head][np.cumsum(head) - 1])
                u.append(words[q[head]])
                v.append(own[node[head]])
        root = sets.find(np.arange(len(own)))
        moved = root != np.arange(len(own))
        u.append(own[moved])
        v.append(own[root[moved]])
        return np.concatenate(u), np.concatenate(v)


def _link_partition(radius: int, rows_at_once: int = 1 << 16):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        linker = _Linker(radius)
        held: list[tuple[np.ndarray, ...]] = []
        count = 0

        def close(table: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            shard, query, words = table
            number = np.cumsum(np.r_[True, (shard[1:] != shard[:-1]).any(1)]) - 1
            u, v = linker.links(number, query, words)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], schema=schema)

        def merged() -> tuple[np.ndarray, ...]:
            return tuple(np.concatenate(c) for c in zip(*held))

        for batch in batches:
            if not batch.num_rows:
                continue
            key, value, part, query, word = (np.asarray(batch.column(i)) for i in range(5))
            held.append((np.stack([key, value, part], 1), query, word.view(np.uint64)))
            count += batch.num_rows
            if count < rows_at_once:
                continue
            shard, query, words = merged()
            same = (shard == shard[-1]).all(1)
            cut = int(np.argmax(same))  # rows from here on may go on in the next batch
            if cut:
                yield close((shard[:cut], query[:cut], words[:cut]))
            elif query[-1]:
                # one crowded shard: its members have all come, visitors are done once looked up
                yield close((shard, query, words))
                stay = query == 0
                shard, query, words = shard[stay], query[stay], words[stay]
            held = [(shard[cut:], query[cut:], words[cut:])]
            count = len(held[0][1])
        if count:
            yield close(merged())

    return run


def linked(words: DataFrame, radius: int = 3, agreeing: int | None = None) -> DataFrame:
    """(node, root) for each distinct fingerprint of `words` that has a neighbour within the radius.

    `agreeing` sets the length of the shard keys; by default it follows from the number of
    fingerprints so that a shard of evenly spread ones stays below a thousand.
    """
    workers_can_import(words.sparkSession)
    if agreeing is None:
        n, agreeing = words.count(), 1
        while agreeing < 8 and n >> (BITS * agreeing // (radius + agreeing)) > 1000:
            agreeing += 1
    shards = _shards(words, radius, agreeing)
    placed = shards.repartition("key", "value", "part").sortWithinPartitions("key", "value", "part", "query")
    return components(placed.mapInArrow(_link_partition(radius), "u long, v long"))


def _groups(rows: DataFrame, radius: int) -> DataFrame:
    """(fingerprint, least): the smallest `id` struct of the component, for every fingerprint of `rows`."""
    words = stage(rows.groupBy("fingerprint").agg(F.min("id").alias("least")), "fingerprints")
    roots = linked(words.select("fingerprint"), radius).withColumnRenamed("node", "fingerprint")
    rooted = words.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    least = rooted.groupBy("root").agg(F.min("least").alias("best"))
    return rooted.join(least, "root").select("fingerprint", F.col("best").alias("least"))


def _order(id_col: str, *more: str):
    """Ids in order, null ones last."""
    return F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), *more)


def simhash_components(
    docs: DataFrame, shingle: int = 3, radius: int = 3, text_col: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """id_col, fingerprint (16 hex digits) and component_id, one row per row of `docs`.

    component_id is the smallest non-null id that links reach, the row's own included. Rows with a
    null id link by their fingerprint like any other. Texts without words have fingerprint zero.
    """
    rows = with_fingerprint(docs, shingle, text_col, [id_col])
    rows = stage(rows.select(id_col, "fingerprint"), "simhash")
    least = _groups(rows.select("fingerprint", _order(id_col).alias("id")), radius)
    return rows.join(least, "fingerprint").select(
        id_col,
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        F.col("least.id").alias("component_id"),
    )


def keep_one_of_each(
    docs: DataFrame, shingle: int = 3, radius: int = 3, text_col: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """One row of each near-duplicate group, the one with the smallest id; all columns stay as they are."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = with_fingerprint(docs.toDF(*names), shingle, names[docs.columns.index(text_col)], names)
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = stage(rows, "simhash")
    key = names[docs.columns.index(id_col)]
    least = _groups(rows.select("fingerprint", _order(key, "row").alias("id")), radius)
    keep = least.select(F.col("least.row").alias("row")).distinct()
    return rows.join(keep, "row", "left_semi").select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns)))
