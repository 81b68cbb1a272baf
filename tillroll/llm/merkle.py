"""Merkle manifest of a dataset, with a version of the tree for every changed document.

Each document is a leaf. The leaves of a source, by ascending id, are hashed in runs of 16 up to one
node, the subroot; subroots in the order of their sources are hashed likewise to the root. A tree is
stored in aligned blocks of 16**depth nodes: a block row has its leaves' runs, the runs of the levels
above, and its own root, which is a leaf of the next layer of blocks. So no task holds more than one block,
and a source of any size is spread over as many blocks as it needs.

The tree is persistent. A changed leaf makes a version that copies the ancestors of that leaf and
shares every other node: first those inside its block, then, with the path through the upper layers that
its block was handed, those above. `Manifest.versions` lists the copies, `Manifest.runs` the shared nodes.

All of it is built-in functions: range partitioning gives ranks, one grouping per layer gives blocks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.text import let
from tillroll.session import stage

FAN = 16  # fixed value: nodes hashed into one
HEX = 64  # characters of a digest
DEPTH = 3  # levels in a block
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")  # fixed value: what a leaf hashes, in order

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def leaf_hash(values: Sequence[Column]) -> Column:
    """Digest of the values, each as its length in bytes, a colon and its text, or "-" if null."""

    def framed(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(framed, values)), 256)


def _key(source: Column) -> Column:
    """Never null, and ordered as sources are: null first, then by bytes."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def ranked(nodes: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Add `rank`, the 0-based place of a row in its group `k` by `order`; written out.

    Rows are dealt by ranges of (k, order), so a group of any size lies in neighbouring partitions. A row's
    place is its place in its partition plus the rows of its group in partitions before: one count per
    (group, partition), of which there are no more than partitions and groups together.
    """
    columns = nodes.columns
    placed = nodes.repartitionByRange("k", *order).sortWithinPartitions("k", *order)
    # partition number above the 33 low bits, place inside the partition below
    placed = stage(placed.withColumn("__at", F.monotonically_increasing_id()), "sorted")
    placed = placed.withColumn("__part", F.shiftright("__at", 33))
    counts = placed.groupBy("k", "__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("k").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("k", "__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"))
    return placed.join(stage(counts, "places"), ["k", "__part"]).select(
        *columns, (F.col("__at") + F.col("__shift")).alias("rank")
    )


def _runs(hashes: Column) -> Column:
    """Neighbouring hashes, 16 to a string."""
    last = F.ceil(F.size(hashes) / FAN).cast("int") - 1
    return F.transform(
        F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(hashes, (i * FAN + 1).cast("int"), F.lit(FAN)), "")
    )


def _hashed(runs: Column) -> Column:
    return F.transform(runs, lambda r: F.sha2(r, 256))


def _height(block: Column, size: Column, depth: int) -> Column:
    """Levels inside a block: all, unless the block is alone in its tree and smaller."""
    height = F.lit(depth)
    for level in range(depth - 1, -1, -1):
        height = F.when(size <= FAN**level, level).otherwise(height)
    return F.when(block > 0, depth).otherwise(height).cast("int")


def blocks_of(nodes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(k, block, items, runs, height, hash) of nodes (k, rank, hash, item): aligned blocks, written out.

    `items` is in the order of ranks, `runs` has one array of strings per level, `hash` is the block's root.
    """
    entry = F.struct("rank", "hash", "item")
    width = FAN**depth
    block = F.floor(F.col("rank") / width).cast("long").alias("block")
    found = nodes.groupBy("k", block).agg(F.array_sort(F.collect_list(entry)).alias("__all"))
    found = found.select(
        "k",
        "block",
        _height(F.col("block"), F.size("__all"), depth).alias("height"),
        F.transform("__all", lambda e: e["item"]).alias("items"),
        let(F.transform("__all", lambda e: e["hash"]), _runs).alias("__runs0"),
        F.get(F.col("__all.hash"), F.lit(0)).alias("__first"),
    )
    for level in range(1, depth):
        found = found.withColumn(f"__runs{level}", let(_hashed(F.col(f"__runs{level - 1}")), _runs))
    root = F.sha2(F.get(F.element_at(F.array(*[f"__runs{level}" for level in range(depth)]), F.greatest("height", F.lit(1))), F.lit(0)), 256)
    runs = F.slice(F.array(*[F.col(f"__runs{level}") for level in range(depth)]), F.lit(1), F.col("height"))
    return stage(
        found.select(
            "k", "block", "items", runs.alias("runs"), "height",
            F.when(F.col("height") == 0, F.col("__first")).otherwise(root).alias("hash"), F.col("__first").alias("first"),
        ),
        "blocks",
    )


def _path(place: Column, depth: int) -> Column:
    """Steps (run, at) from a node at `place` of a block to the block's root."""
    steps = [
        F.struct(
            F.get(F.get("runs", F.lit(level)), F.shiftright(place, 4 * (level + 1))).alias("run"),
            F.shiftright(place, 4 * level).bitwiseAND(F.lit(FAN - 1)).alias("at"),
        )
        for level in range(depth)
    ]
    return F.slice(F.array(*steps), F.lit(1), F.col("height"))


@dataclass(frozen=True)
class Tree:
    """Trees of all groups. `blocks`: the lowest layer; `above`: (k, block, path) from its blocks to the
    group's root; `roots`: (k, hash)."""

    layers: tuple[DataFrame, ...]
    above: DataFrame
    roots: DataFrame
    depth: int


def grow(nodes: DataFrame, depth: int = DEPTH) -> Tree:
    """Trees over nodes (k, rank, hash, item), one per group."""
    layers = [blocks_of(nodes, depth)]
    while layers[-1].where("block > 0").limit(1).count():
        below = layers[-1].select("k", F.col("block").alias("rank"), "hash", F.lit(None).cast("int").alias("item"))
        layers.append(blocks_of(below, depth))
    top = layers[-1]
    none = F.array().cast("array<struct<run:string,at:int>>")
    above = top.select("k", "block", none.alias("path"))
    for layer in reversed(layers[1:]):
        rows = layer.join(above, ["k", "block"])
        below = F.transform(
            "items", lambda _, i: F.struct((F.col("block") * FAN**depth + i).alias("block"), _path(i, depth).alias("low"))
        )
        rows = rows.select("k", F.col("path").alias("high"), F.inline(below))
        above = stage(rows.select("k", "block", F.concat("low", "high").alias("path")), "above")
    return Tree(tuple(layers), above, top.select("k", "hash"), depth)


def fold(leaf: Column, path: Column) -> Column:
    """Digests of the ancestors that a leaf has when it stands at the start of `path`, leaf first."""

    def climb(done: Column, step: Column) -> Column:
        own = F.element_at(done, -1)
        left = F.substring(step["run"], F.lit(1), step["at"] * HEX)
        right = F.substring(step["run"], step["at"] * HEX + HEX + 1, F.lit(FAN * HEX))
        return F.concat(done, F.array(F.sha2(F.concat(left, own, right), 256)))

    return F.aggregate(path, F.array(leaf), climb)


def siblings(path: Column) -> Column:
    """The other nodes of each run on the path, joined."""

    def others(step: Column) -> Column:
        left = F.substring(step["run"], F.lit(1), step["at"] * HEX)
        return F.concat(left, F.substring(step["run"], step["at"] * HEX + HEX + 1, F.lit(FAN * HEX)))

    return F.array_join(F.transform(path, others), "")


@dataclass(frozen=True)
class Manifest:
    """`sources`: the trees of sources, their leaves' items (id, changed); `top`: the tree over subroots."""

    sources: Tree
    top: Tree

    def _leaves(self, make) -> DataFrame:
        """One row per leaf with `subroot`, `root` and the struct `make(item, leaf, path)`."""
        # each block of a tree of sources is handed its path to the root once, whatever it holds
        top = self.top.layers[0].join(self.top.above, ["k", "block"])
        up = top.join(self.top.roots.withColumnRenamed("hash", "root"), "k").select(
            "root",
            F.col("path").alias("high"),
            F.inline(F.transform("items", lambda k, i: F.struct(k.alias("k"), _path(i, self.top.depth).alias("low")))),
        )
        up = up.select("k", "root", F.concat("low", "high").alias("__top"))
        up = up.join(self.sources.roots.withColumnRenamed("hash", "subroot"), "k")
        above = self.sources.above.join(stage(up, "up"), "k")
        above = stage(above.select("k", "block", "subroot", "root", F.concat("path", "__top").alias("high")), "handed")
        rows = self.sources.layers[0].join(above, ["k", "block"])

        def leaf(item: Column, i: Column) -> Column:
            run = F.get(F.get("runs", F.lit(0)), F.shiftright(i, 4))
            own = F.coalesce(F.substring(run, i.bitwiseAND(F.lit(FAN - 1)) * HEX + 1, F.lit(HEX)), F.col("first"))
            path = F.concat(_path(i, self.sources.depth), F.col("high"))
            return let(F.struct(own.alias("leaf"), path.alias("path")), lambda v: make(item, v["leaf"], v["path"]))

        return rows.select("subroot", "root", F.inline(F.transform("items", leaf)))

    def proofs(self) -> DataFrame:
        """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every leaf: what its siblings prove
        of the changed leaf where there is one, else of the leaf itself."""

        def make(item: Column, leaf: Column, path: Column) -> Column:
            now = F.coalesce(item["changed"], leaf)
            return F.struct(
                item["id"].alias("id"),
                leaf.alias("leaf"),
                F.sha2(siblings(path), 256).alias("proof_sha256"),
                F.element_at(fold(now, path), -1).alias("folded_root"),
            )

        return self._leaves(make).select(
            "id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
        )

    def versions(self) -> DataFrame:
        """(id, changed, copies) of every changed leaf: the digests its version copies, leaf first and root
        last; all other nodes are shared with the original."""

        def make(item: Column, leaf: Column, path: Column) -> Column:
            return F.struct(item["id"].alias("id"), item["changed"].alias("changed"), fold(item["changed"], path).alias("copies"))

        return self._leaves(make).where(F.col("changed").isNotNull()).select("id", "changed", "copies")

    def runs(self) -> DataFrame:
        """(k, layer, block, level, run, nodes) of the shared nodes of the trees of sources."""
        out = None
        for number, layer in enumerate(self.sources.layers):
            rows = layer.select("k", F.lit(number).alias("layer"), "block", F.posexplode("runs").alias("level", "__r"))
            rows = rows.select("k", "layer", "block", "level", F.posexplode("__r").alias("run", "nodes"))
            out = rows if out is None else out.unionByName(rows)
        return out


def is_tampered(id_col: str, every: int = 5) -> Column:
    """Ids whose unsigned CRC-32 as decimal text is divisible by `every`; never a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % every == 0, F.lit(False))


def build(
    docs: DataFrame,
    columns: Sequence[str] = COLUMNS,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    tampered: Column | None = None,
    depth: int = DEPTH,
) -> Manifest:
    """The manifest of `docs`, with a changed leaf (text in ASCII lower case) where `tampered` holds.

    Leaves ascend by id, null first; rows of equal id by their digest, so repeated rows are leaves next to
    each other. A null source is a source of its own, the first. Null, empty and very long texts are hashed as
    they are; an empty table gives a manifest without rows. Other columns take no part.
    """
    where = is_tampered(id_col) if tampered is None else tampered
    changed = [lower_ascii(F.col(c).cast("string")) if c == text_col else F.col(c) for c in columns]
    leaves = docs.select(
        _key(F.col(source_col)).alias("k"),
        leaf_hash([F.col(c) for c in columns]).alias("hash"),
        F.struct(F.col(id_col).alias("id"), F.when(where, leaf_hash(changed)).alias("changed")).alias("item"),
    )
    leaves = ranked(stage(leaves, "leaves"), [F.col("item.id"), F.col("hash")])
    sources = grow(leaves, depth)
    subroots = sources.roots.select(F.lit("").alias("k"), "hash", F.col("k").alias("item"))
    return Manifest(sources, grow(ranked(subroots, [F.col("item")]), depth))


def manifest(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row; see `build`."""
    return build(docs, depth=depth).proofs().withColumnRenamed("id", "doc_id")
