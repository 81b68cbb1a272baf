"""Bytes of passages that occur more than once, by distributed prefix doubling on sampled positions.

A window is a string of `window` bytes within one document. Each window has an anchor (see `blocks`), and
what every window of an anchor shares, the core, is named first. Cores that occur once end their windows:
they are unique. The windows of an anchor reach over a longer string, its span: the pair (core name, span
name) ranks the survivors anew, and where a pair repeats all windows of the span repeat. Only what is left
between the two, at the borders of passages, is ranked window by window at the full length, on one cell
per pair. Matches never cross documents; the rounds are joins and aggregates keyed by names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm.arrays import document_of
from tillroll.llm.blocks import BLOCK, anchors, block_names, names_at
from tillroll.llm.rowwise import with_text_columns, workers_can_import
from tillroll.session import stage

WINDOW = 200
CROWD = 1 << 15  # cells of one core (about 8 MB) that a task compares by itself; more are dealt out by window name

# A cell in one long: 18 bits of a second text hash, start of its first window, number of windows less one,
# and the anchor's distance from the first window.
TAG_BITS, START_BITS, SMALL_BITS = 18, 29, 8


def reach_of(window: int) -> int:
    """Positions an anchor is chosen among: two thirds of the window, the rest and one is the core."""
    return max(1, min(window - BLOCK + 1, window * 2 // 3 + 4, 1 << SMALL_BITS))


def _keyed(docs: DataFrame, text_col: str, carry: tuple[str, ...]) -> DataFrame:
    """`carry` as c0.., text (null: empty), and two hashes that stand for the text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kept = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(carry)), text.alias("text"))
    return kept.withColumns({"h": F.xxhash64("text"), "tag": F.crc32(F.col("text").cast("binary")) % (1 << TAG_BITS)})


def _cores(keyed: DataFrame, window: int) -> DataFrame:
    reach = reach_of(window)

    def run(data, offsets):
        n = len(offsets) - 1
        names = [np.zeros(0, np.int64)]
        ends = [np.zeros(0, np.int64)]
        for blocks, at, _, _, begin in anchors(data, offsets, window, reach):
            names.append(names_at(blocks, at, window - reach + 1).view(np.int64))
            ends.append(document_of(at + begin, offsets))
        counts = np.bincount(np.concatenate(ends), minlength=n)
        lists = pa.ListArray.from_arrays(
            pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(np.concatenate(names))
        )
        return [lists]

    field = T.StructField("cores", T.ArrayType(T.LongType()))
    return with_text_columns(keyed, run, [field], "text", []).select(F.explode("cores").alias("core"))


def _cells(keyed: DataFrame, window: int) -> DataFrame:
    """(core, span, h, cell) of every anchor. Texts of 2**29 bytes and more are refused."""
    reach = reach_of(window)
    inner = T.StructType(
        [T.StructField("core", T.LongType()), T.StructField("span", T.LongType()), T.StructField("place", T.LongType())]
    )

    def run(data, offsets):
        n = len(offsets) - 1
        if int(np.diff(offsets).max(initial=0)) >= 1 << START_BITS:
            raise ValueError("a text is too long")
        parts = [(np.zeros(0, np.int64),) * 4]
        for blocks, at, low, high, begin in anchors(data, offsets, window, reach):
            document = document_of(low + begin, offsets)
            core = names_at(blocks, at, window - reach + 1)
            span = names_at(blocks, low, high - low + window, seed=1)
            place = ((low + begin - offsets[document]) << 2 * SMALL_BITS) | ((high - low) << SMALL_BITS) | (at - low)
            parts.append((core.view(np.int64), span.view(np.int64), place, document))
        core, span, place, document = (np.concatenate(c) for c in zip(*parts))
        counts = np.bincount(document, minlength=n)
        values = pa.StructArray.from_arrays([pa.array(core), pa.array(span), pa.array(place)], ["core", "span", "place"])
        return [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), values)]

    made = with_text_columns(keyed, run, [T.StructField("cells", T.ArrayType(inner))], "text", ["h", "tag"])
    cell = F.shiftleft(F.col("tag").cast("long"), START_BITS + 2 * SMALL_BITS).bitwiseOR(F.col("x.place"))
    return made.select("h", "tag", F.explode("cells").alias("x")).select("x.core", "x.span", "h", cell.alias("cell"))


def _start(cell):
    return F.shiftright(cell, 2 * SMALL_BITS).bitwiseAND((1 << START_BITS) - 1)


def _more(cell):
    """Windows of the cell less one."""
    return F.shiftright(cell, SMALL_BITS).bitwiseAND((1 << SMALL_BITS) - 1)


def _tag(cell):
    return F.shiftright(cell, START_BITS + 2 * SMALL_BITS)


def _contexts(keyed: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(core, crowd, h, cell, context): the bytes that the windows of each wanted cell reach over."""
    lists = wanted.groupBy("h", _tag(F.col("cell")).alias("tag")).agg(
        F.collect_list(F.struct("core", "crowd", "cell")).alias("wanted")
    )
    joined = keyed.select("h", "tag", "text").join(lists, ["h", "tag"])
    binary = F.col("text").cast("binary")
    x = joined.select("h", binary.alias("bytes"), F.explode("wanted").alias("x"))
    start, more = _start(F.col("x.cell")), _more(F.col("x.cell"))
    context = F.substring("bytes", (start + 1).cast("int"), (more + window).cast("int"))
    # copies of a text give equal rows
    return x.select("x.core", "x.crowd", "h", "x.cell", context.alias("context"))


def _window_names(blocks: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    return names_at(blocks, at, window, 0), names_at(blocks, at, window, 1)


RANGES = "h long, tag long, start long, end long"


def _compared(cells: pa.Table, window: int) -> pa.RecordBatch:
    """Runs of repeated windows among the cells of each core in `cells`, as byte ranges of their texts."""
    core, h, cell = (np.asarray(cells.column(c)) for c in ("core", "h", "cell"))
    order = np.lexsort((cell, h, core))
    core, h, cell = core[order], h[order], cell[order]
    keep = np.r_[True, (np.diff(core) != 0) | (np.diff(h) != 0) | (np.diff(cell) != 0)]  # copies give equal cells
    core, h, cell = core[keep], h[keep], cell[keep]
    contexts = cells.column("context").combine_chunks().cast(pa.large_binary()).take(pa.array(order[keep]))
    _, offsets, data = contexts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[contexts.offset : contexts.offset + len(contexts)]
    blocks = block_names(np.frombuffer(data, np.uint8))
    count = (cell >> SMALL_BITS & (1 << SMALL_BITS) - 1) + 1
    ends = np.cumsum(count)
    owner = np.repeat(np.arange(len(cell)), count)
    k = np.arange(ends[-1]) - np.repeat(ends - count, count)
    a, b = _window_names(blocks, offsets[owner] + k, window)
    # windows of different cores, or at different distances from their anchors, differ
    group = np.cumsum(np.r_[True, np.diff(core) != 0])[owner] << SMALL_BITS
    group += (cell & (1 << SMALL_BITS) - 1)[owner] - k
    order = np.lexsort((b, a, group))
    same = (np.diff(group[order]) == 0) & (np.diff(a[order]) == 0) & (np.diff(b[order]) == 0)
    again = np.zeros(len(a), bool)
    again[order] = np.r_[same, False] | np.r_[False, same]
    hits = np.flatnonzero(again)
    head = np.r_[True, (np.diff(hits) != 1) | (np.diff(owner[hits]) != 0)][: len(hits)]
    tail = np.r_[head[1:], [True] * min(len(hits), 1)].astype(bool)
    who = owner[hits[head]]
    first = cell[who] >> 2 * SMALL_BITS & (1 << START_BITS) - 1
    columns = (h[who], cell[who] >> (START_BITS + 2 * SMALL_BITS), first + k[hits[head]], first + k[hits[tail]] + window)
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h", "tag", "start", "end"])


def _compared_in_tasks(contexts: DataFrame, window: int, at_once: int = 1 << 14) -> DataFrame:
    """Repeated windows among the cells of each core, cores of at most CROWD cells.

    Cells come sorted by core and are compared in blocks of whole cores.
    """
    rows = contexts.repartition("core").sortWithinPartitions("core")

    def run(batches):
        held = None
        for batch in batches:
            batch = pa.Table.from_batches([batch])
            held = batch if held is None else pa.concat_tables([held, batch])
            if held.num_rows < at_once:
                continue
            core = np.asarray(held.column("core"))
            cut = int(np.argmax(core == core[-1]))
            if cut:
                yield _compared(held.slice(0, cut), window)
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield _compared(held, window)

    return rows.mapInArrow(run, RANGES)


def _compared_by_name(contexts: DataFrame, window: int) -> DataFrame:
    """The same for crowded cores: one row per window, counted by name."""

    def run(batches):
        for batch in batches:
            columns = [[] for _ in range(5)]
            for h, cell, context in zip(*(batch.column(k).to_pylist() for k in ("h", "cell", "context"))):
                more = cell >> SMALL_BITS & (1 << SMALL_BITS) - 1
                blocks = block_names(np.frombuffer(context, np.uint8))
                a, b = _window_names(blocks, np.arange(more + 1), window)
                for column, values in zip(columns, (a.view(np.int64), b.view(np.int64), np.full(more + 1, h),
                                                    np.full(more + 1, cell), np.arange(more + 1))):
                    column.append(values)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=["a", "b", "h", "cell", "k"])

    windows = contexts.mapInArrow(run, "a long, b long, h long, cell long, k long")
    windows = stage(windows.dropDuplicates(["a", "b", "h", "cell", "k"]), "windows")
    again = windows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "b")
    start = _start(F.col("cell")) + F.col("k")
    return windows.join(again, ["a", "b"], "left_semi").select(
        "h", _tag(F.col("cell")).alias("tag"), start.alias("start"), (start + window).alias("end")
    )


def repeated_ranges(keyed: DataFrame, window: int) -> DataFrame:
    """(h, tag, start, end): byte ranges that together hold exactly the repeated windows of each text."""
    cores = _cores(keyed, window).groupBy("core").agg(F.count(F.lit(1)).alias("n"))
    repeated = stage(cores.where("n > 1").select("core"), "cores")
    cells = stage(_cells(keyed, window).join(repeated, "core", "left_semi"), "cells")
    pairs = cells.groupBy("core", "span").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("h", "cell")).alias("one"))
    pairs = stage(pairs, "pairs")
    # all windows of a repeated span repeat
    whole = cells.join(pairs.where("n > 1").select("core", "span"), ["core", "span"], "left_semi")
    start = _start(F.col("cell"))
    whole = whole.select("h", _tag(F.col("cell")).alias("tag"), start.alias("start"), (start + _more(F.col("cell")) + window).alias("end"))
    # cores with a span of its own: its windows against one cell of each other span
    undecided = pairs.groupBy("core").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("crowd"))
    undecided = undecided.where("least = 1 AND crowd > 1").select("core", "crowd")
    wanted = pairs.join(undecided, "core").select("core", "crowd", "one.h", "one.cell")
    contexts = stage(_contexts(keyed, wanted, window), "contexts")
    border = _compared_in_tasks(contexts.where(F.col("crowd") <= CROWD), window).unionByName(
        _compared_by_name(contexts.where(F.col("crowd") > CROWD), window)
    )
    return whole.unionByName(border)


FIELDS = [
    T.StructField("n_bytes", T.LongType()),
    T.StructField("n_removed", T.LongType()),
    T.StructField("n_spans", T.LongType()),
    T.StructField("kept", T.BinaryType()),
]


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Columns `carry`, n_bytes, n_removed, n_spans and kept (the remaining bytes), one row per row of `docs`.

    A byte goes if a string of `window` bytes that covers it starts anywhere else, in this or any other
    document; strings are judged on the input. Null texts are empty; repeated rows hold each other's
    strings. Kept bytes may cut a character. Of other columns only `carry` stays.
    """
    workers_can_import(docs.sparkSession)
    keyed = _keyed(docs, text_col, carry)
    ranges = repeated_ranges(keyed, window)
    lists = ranges.groupBy("h", "tag").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))
    joined = keyed.join(lists, ["h", "tag"], "left").select(
        *(c for c in keyed.columns if c not in ("h", "tag")),
        F.transform("ranges", lambda r: r["start"]).alias("__starts"),
        F.transform("ranges", lambda r: r["end"]).alias("__ends"),
    )
    inner = [f"c{i}" for i in range(len(carry))]

    def run(batches):
        for batch in batches:
            out = [[], [], [], []]
            texts = batch.column("text").cast(pa.binary())
            for text, starts, ends in zip(texts, batch.column("__starts"), batch.column("__ends")):
                raw = text.as_py()
                n = len(raw)
                if not starts.is_valid:
                    row = (n, 0, 0, raw)
                else:
                    steps = np.zeros(n + 1, np.int64)
                    np.add.at(steps, starts.values.to_numpy(), 1)
                    np.add.at(steps, ends.values.to_numpy(), -1)
                    gone = np.cumsum(steps[:n]) > 0
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    row = (n, int(gone.sum()), spans, np.frombuffer(raw, np.uint8)[~gone].tobytes())
                for column, value in zip(out, row):
                    column.append(value)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in inner), *(pa.array(v, t) for v, t in zip(out, types))],
                names=[*inner, *(f.name for f in FIELDS)],
            )

    schema = T.StructType([*(joined.schema[c] for c in inner), *FIELDS])
    done = joined.mapInArrow(run, schema)
    return done.select(*(F.col(i).alias(c) for i, c in zip(inner, carry)), *(f.name for f in FIELDS))
