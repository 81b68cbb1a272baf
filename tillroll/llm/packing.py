"""Packing documents into sequences by non-negative least squares over length combinations.

Documents are cut at whole windows; a tail is left of most. Shallow combinations of lengths that fill
a window are enumerated, their repeat counts are fitted to the histogram of lengths, rounded down,
and topped up greedily. What no combination takes follows as one stream of tails, ordered by length,
that is cut at window ends. The histogram has at most one row per length of a window, so the plan is
small however many documents there are; each piece finds its place from its rank within its length.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm.encoder import encoder
from tillroll.llm.ranks import rank_in_group
from tillroll.llm.rowwise import with_text_columns
from tillroll.session import stage

WINDOW = 2048
END_ID = 1


def combinations(histogram: np.ndarray) -> list[tuple[int, ...]]:
    """Length combinations that fill a window (or a smaller power of two on their own), over lengths that occur."""
    window = len(histogram) - 1
    there = histogram > 0
    out = {(1 << k,) for k in range(window.bit_length()) if 1 << k <= window and there[1 << k]}
    lengths = np.flatnonzero(there).tolist()
    for a in lengths:
        if 2 * a <= window and there[window - a]:
            out.add((a, window - a))
        for parts, ways in ((3, 8), (4, 6)):
            most = (window - a) // (parts - 1)  # the next length up to an even share
            if a > most:
                continue
            for b in np.unique(np.linspace(a, most, ways).astype(int)).tolist():
                c = window - a - b if parts == 3 else b
                last = window - a - b - c if parts == 4 else 0
                combo = tuple(x for x in (a, b, c, last) if x)
                if sum(combo) == window and min(combo) > 0 and all(there[x] for x in combo):
                    out.add(tuple(sorted(combo)))
    return sorted(out, key=lambda c: (len(c), c))


def repeat_counts(histogram: np.ndarray, combos: list[tuple[int, ...]], steps: int = 600) -> np.ndarray:
    """Non-negative x that minimises |A x - histogram|, A the lengths in each combination; accelerated projection."""
    if not combos:
        return np.zeros(0)
    column = np.repeat(np.arange(len(combos)), [len(c) for c in combos])
    row = np.concatenate([np.array(c) for c in combos])
    scale = max(1.0, float(histogram.max()))
    goal = histogram / scale

    def apply(x):
        return np.bincount(row, x[column], len(histogram))

    def back(r):
        return np.bincount(column, r[row], len(combos))

    probe = np.ones(len(combos))
    for _ in range(30):
        probe = back(apply(probe))
        size = np.linalg.norm(probe)
        probe /= size
    step = 1 / (1.05 * size)
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(y - step * back(apply(y) - goal), 0)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / after * (new - x)
        x, t = new, after
    return x * scale


@dataclass
class Plan:
    """For each length, ranges of ranks with the first sequence and the offset they go to; then the stream."""

    length: np.ndarray
    first_rank: np.ndarray
    first_sequence: np.ndarray
    offset: np.ndarray
    used: np.ndarray  # by length: ranks that combinations take
    stream: np.ndarray  # by length: where its first left-over piece starts in the stream
    stream_sequence: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position of each piece as (sequence, offset); pieces of the stream may run past their window."""
        window = len(self.used) - 1
        key = self.length * (1 << 45) + self.first_rank
        at = np.searchsorted(key, length * (1 << 45) + rank, "right") - 1
        inside = rank < self.used[length]
        at = np.where(inside, at, 0)
        position = self.stream[length] + (rank - self.used[length]) * length
        if not len(key):
            return self.stream_sequence + position // window, position % window
        sequence = np.where(
            inside, self.first_sequence[at] + rank - self.first_rank[at], self.stream_sequence + position // window
        )
        return sequence, np.where(inside, self.offset[at], position % window)


def make_plan(histogram: np.ndarray) -> Plan:
    """`histogram[n]`: pieces of length n, up to the window."""
    combos = combinations(histogram)
    wanted = np.floor(repeat_counts(histogram.astype(float), combos) + 1e-9).astype(np.int64)
    left = histogram.astype(np.int64).copy()
    counts = np.zeros(len(combos), np.int64)

    def take(j: int, limit: int | None) -> None:
        parts, many = np.unique(combos[j], return_counts=True)
        n = int((left[parts] // many).min())
        n = n if limit is None else min(n, limit)
        left[parts] -= n * many
        counts[j] += n

    for j in np.argsort(-wanted, kind="stable").tolist():
        take(j, int(wanted[j]))
    for j in range(len(combos)):
        take(j, None)
    length, first_rank, first_sequence, offset = [], [], [], []
    used = np.zeros(len(histogram), np.int64)
    sequence = 0
    for combo, n in zip(combos, counts.tolist()):
        if not n:
            continue
        at = 0
        for part in combo:
            length.append(part)
            first_rank.append(int(used[part]))
            first_sequence.append(sequence)
            offset.append(at)
            used[part] += n
            at += part
        sequence += n
    order = np.lexsort((first_rank, length))
    columns = [np.array(c, np.int64)[order] if len(c) else np.zeros(0, np.int64)
               for c in (length, first_rank, first_sequence, offset)]
    stream = np.cumsum(left * np.arange(len(left)))
    stream = np.r_[0, stream[:-1]]
    return Plan(*columns, used, stream, sequence)


def _tokenized(docs: DataFrame, path: str, text_col: str, carry: tuple[str, ...], window: int) -> DataFrame:
    """One row per document: `carry`, doc_tokens, checksums of its whole windows, its tail as packed ids."""

    def run(data, offsets):
        raw, at = data.tobytes(), offsets.tolist()
        coder = encoder(path)
        small = coder.tokenizer.get_vocab_size() <= 1 << 16
        end = np.array([END_ID], "<u4").tobytes()
        total, checks, tails, tail_checks = [], [], [], []
        for ids in coder.encode([raw[a:b] for a, b in zip(at, at[1:])]):
            ids += end
            n = len(ids) // 4
            whole = n // window * window * 4
            total.append(n)
            checks.append([zlib.crc32(ids[i : i + 4 * window]) for i in range(0, whole, 4 * window)])
            tail = ids[whole:]
            tail_checks.append(zlib.crc32(tail))
            tails.append(np.frombuffer(tail, "<u4").astype("<u2").tobytes() if small else tail)
        return [total, checks, pa.array(tails, pa.binary()), tail_checks]

    fields = [
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("checks", T.ArrayType(T.LongType())),
        T.StructField("tail", T.BinaryType()),
        T.StructField("tail_check", T.LongType()),
    ]
    return with_text_columns(docs, run, fields, text_col, carry)


def pack(
    docs: DataFrame, tokenizer_path: str, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), window: int = WINDOW
) -> DataFrame:
    """One row per piece: `carry`, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and then id 1; null and empty texts are that id alone. Repeated rows are
    documents of their own. Every sequence but the last is full or holds one piece whose length is a
    power of two. Columns of `docs` other than `carry` are left behind.
    """
    inner = [f"c{i}" for i in range(len(carry))]
    source = docs.select(*(F.col(c).alias(i) for c, i in zip(carry, inner)), F.col(text_col).alias("__text"))
    tokens = _tokenized(source, tokenizer_path, "__text", tuple(inner), window)
    tokens = stage(tokens.withColumn("row", F.monotonically_increasing_id()), "tokens")

    whole = tokens.select("row", *inner, "doc_tokens", F.posexplode("checks").alias("k", "check")).select(
        "row", *inner, "doc_tokens", (F.col("k") * window).cast("long").alias("start"), F.lit(window).cast("long").alias("length"), "check"
    )
    rest = F.col("doc_tokens") % window
    tails = tokens.where(rest > 0).select(
        "row", *inner, "doc_tokens", (F.col("doc_tokens") - rest).alias("start"), rest.alias("length"), F.col("tail_check").alias("check")
    )
    pieces = whole.unionByName(tails).withColumn("draw", F.xxhash64("row", "start"))

    histogram = np.zeros(window + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # one row per length, at most a window of them
        histogram[r["length"]] = r["count"]
    plan = make_plan(histogram)
    ranked = rank_in_group(pieces, ["length"], "draw", int(histogram.sum()), "rank")

    schema = ranked.drop("draw", "rank").schema.add("sequence_id", T.LongType()).add("offset", T.LongType())
    keep = [f.name for f in schema.fields[:-2]]

    def place(batches):
        for b in batches:
            sequence, offset = plan.place(np.asarray(b["length"]), np.asarray(b["rank"]))
            yield pa.RecordBatch.from_arrays(
                [*(b[c] for c in keep), pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"]
            )

    placed = stage(ranked.mapInArrow(place, schema), "placed")
    over = F.col("offset") + F.col("length") > window
    columns = [*inner, "start", "length", "check", "doc_tokens", "sequence_id", "offset"]
    cut = _cut(placed.where(over), tokens.select("row", "tail"), window, columns)
    result = placed.where(~over).select(*columns).unionByName(cut)
    return result.select(
        *(F.col(i).alias(c) for i, c in zip(inner, carry)),
        "start", "length", F.col("check").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
    )


def _cut(crossing: DataFrame, tails: DataFrame, window: int, columns: list[str]) -> DataFrame:
    """The two parts of each tail that crosses a window end, with checksums of their own."""
    joined = crossing.join(tails, "row").select(*columns, "tail")
    schema = joined.drop("tail").schema

    def run(batches):
        for b in batches:
            offset, length = np.asarray(b["offset"]), np.asarray(b["length"])
            first = window - offset
            checks: tuple[list, list] = ([], [])
            for tail, n, k in zip(b["tail"], length.tolist(), first.tolist()):
                raw = tail.as_py()
                ids = raw if len(raw) == 4 * n else np.frombuffer(raw, "<u2").astype("<u4").tobytes()
                checks[0].append(zlib.crc32(ids[: 4 * k]))
                checks[1].append(zlib.crc32(ids[4 * k :]))
            start, sequence = np.asarray(b["start"]), np.asarray(b["sequence_id"])
            for second in (0, 1):
                new = {
                    "start": start + first if second else start,
                    "length": length - first if second else first,
                    "check": np.array(checks[second], np.int64),
                    "sequence_id": sequence + second,
                    "offset": np.zeros_like(offset) if second else offset,
                }
                yield pa.RecordBatch.from_arrays(
                    [pa.array(new[c]) if c in new else b[c] for c in columns], names=columns
                )

    return joined.mapInArrow(run, schema)
