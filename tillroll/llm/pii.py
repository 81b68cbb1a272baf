"""Personal data: fixed patterns, and a conditional random field over the shapes of words.

Every match of a pattern lies within a run of its own characters, so runs are found in the bytes
first and patterns are applied to the few runs that can match. A sequence of the field is a stretch
of a line around words with a digit, an at sign or a plus; what it labels and passes the exact checks
of its kind is added where no base span lies.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm import crf
from tillroll.llm import spans as sp
from tillroll.llm.arrays import CodePoints, byte_table, document_of, runs, sums
from tillroll.llm.rowwise import with_text_columns

# The patterns of the base spans and the limits of their digits.
EMAIL = re.compile(rb"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(rb"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(rb"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS, IP_PART = (12, 19), (9, 15), 255
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "crf_email", "crf_ip", "crf_card", "crf_phone")

_ALPHA = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_NUM = b"0123456789"
LETTER, DIGIT = byte_table(_ALPHA), byte_table(_NUM)
EMAIL_RUN, IP_RUN = byte_table(_ALPHA + _NUM + b"._%+-@"), byte_table(_NUM + b".")
CARD_RUN, PHONE_RUN = byte_table(_NUM + b" -"), byte_table(_NUM + b" -+().")
SPACE = byte_table(b" \t\n\x0b\x0c\r")
BRACKET = byte_table(b"()-")

FIELDS = [
    *(T.StructField(f"n_{kind}", T.LongType()) for kind in BASE_KINDS),
    T.StructField("base_sha256", T.StringType()),
    T.StructField("spans", T.StringType()),
]


def luhn(digits: bytes) -> bool:
    values = [b - 48 for b in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def _digits(text: bytes) -> bytes:
    return bytes(b for b in text if 48 <= b <= 57)


def _is_ip_part(part: bytes) -> bool:
    """Whether digits of any number stand for at most 255."""
    value = part.lstrip(b"0")
    return len(value) < 3 or len(value) == 3 and int(value) <= IP_PART


def _valid(kind: int, text: bytes) -> bool:
    """The exact checks of a kind."""
    digits = _digits(text)
    if kind == 0:
        return EMAIL.fullmatch(text) is not None
    if kind == 1:
        return all(map(_is_ip_part, text.split(b"."))) if IP.fullmatch(text) else False
    if kind == 2:
        return CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits)
    return PHONE_DIGITS[0] <= len(digits) <= PHONE_DIGITS[1]


def base_spans(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(document, kind, start, end) in bytes."""
    raw, found = data.tobytes(), []
    digit, dot = DIGIT[data], data == 46
    for kind, (pattern, table) in enumerate(((EMAIL, EMAIL_RUN), (IP, IP_RUN), (CARD, CARD_RUN), (PHONE, PHONE_RUN))):
        starts, ends = runs(table[data], offsets)
        long = ends - starts >= (3, 7, CARD_DIGITS[0], PHONE_DIGITS[0])[kind]
        starts, ends = starts[long], ends[long]
        if kind == 0:
            can = sums(data == 64, starts, ends) > 0
        elif kind == 1:
            can = (sums(dot, starts, ends) >= 3) & (sums(digit, starts, ends) >= 4)
        elif kind == 2:
            can = sums(digit, starts, ends) >= CARD_DIGITS[0]
        else:
            can = (sums(digit, starts, ends) >= PHONE_DIGITS[0]) & (sums(data == 43, starts, ends) > 0)
        for start, end in zip(starts[can].tolist(), ends[can].tolist()):
            for m in pattern.finditer(raw, start, end):
                if _valid(kind, m[0]):
                    found.append((kind, m.start(), m.end()))
    documents = document_of(np.array([f[1] for f in found], np.int64), offsets).tolist()
    return [(d, *f) for d, f in zip(documents, found)]


N_CODES = 4 * 2 * 4 * 2 * 2 * 3 * 2


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, shape code and line number of each word."""
    starts, ends = runs(~SPACE[data], offsets)
    digits = sums(DIGIT[data], starts, ends)
    letters = sums(LETTER[data] | (data >= 128), starts, ends)
    at = sums(data == 64, starts, ends)
    dots = sums(data == 46, starts, ends)
    brackets = sums(BRACKET[data], starts, ends)
    plus = data[starts] == 43
    others = (ends - starts) - digits - letters - at - dots - brackets - plus
    code = np.searchsorted([1, 4, 8], digits, "right")
    for value, size in (
        (at > 0, 2), (np.minimum(dots, 3), 4), (plus, 2), (brackets > 0, 2),
        (np.searchsorted([1, 3], letters, "right"), 3), (others > 0, 2),
    ):
        code = code * size + value
    breaks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 10, out=breaks[1:])
    line = breaks[starts] + document_of(starts, offsets)  # a new document is a new line
    return starts, ends, code, line


def special(code: np.ndarray) -> np.ndarray:
    """Words with a digit, an at sign or a leading plus."""
    return (code // 96 > 0) | (code // 12 % 2 == 1)


def sequences(code: np.ndarray, line: np.ndarray, near: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """First word and length of each stretch of a line that is at most `near` words from a special word."""
    n = len(code)
    steps = np.zeros(n + 1, np.int32)
    at = np.flatnonzero(special(code))
    head = np.r_[True, line[1:] != line[:-1]] if n else np.zeros(0, bool)
    begins = np.flatnonzero(head)
    of = np.cumsum(head)[at] - 1
    np.add.at(steps, np.maximum(at - near, begins[of]), 1)
    np.add.at(steps, np.minimum(at + near + 1, np.r_[begins[1:], n][of]), -1)
    inside = np.cumsum(steps[:n]) > 0
    return _stretches(inside, head)


def _stretches(inside: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(inside)
    first = inside & (head | np.r_[True, ~inside[:-1]][:n])
    last = inside & np.r_[head[1:] | ~inside[1:], [True] * min(n, 1)]
    first = np.flatnonzero(first)
    return first, np.flatnonzero(last) + 1 - first


def _padded(code: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    column = np.arange(int(length.max()))
    where = first[:, None] + column[None, :]
    return np.where(column[None, :] < length[:, None], code[np.minimum(where, len(code) - 1)], -1)


def label_words(model: crf.LinearChain, code: np.ndarray, line: np.ndarray, cells: int = 1 << 17) -> np.ndarray:
    """Labels of all words; words outside the sequences stay unlabelled."""
    labels = np.zeros(len(code), np.int8)
    if not len(code):
        return labels
    first, length = sequences(code, line)
    order = np.argsort(length, kind="stable")
    first, length = first[order], length[order]
    at = 0
    while at < len(first):
        end = at + 1
        while end < len(first) and (end - at + 1) * length[end] <= cells:
            end += 1
        got = model.viterbi(_padded(code, first[at:end], length[at:end]))
        inside = np.arange(got.shape[1])[None, :] < length[at:end, None]
        labels[(first[at:end, None] + np.arange(got.shape[1])[None, :])[inside]] = got[inside]
        at = end
    return labels


def added_spans(model, data, offsets) -> list[tuple[int, int, int, int]]:
    """(document, kind, start, end) of labelled runs of words that pass the checks of their kind."""
    starts, ends, code, line = words(data, offsets)
    labels = label_words(model, code, line)
    hit = np.flatnonzero(labels)
    if not len(hit):
        return []
    new = np.r_[True, (np.diff(hit) != 1) | (labels[hit[1:]] != labels[hit[:-1]]) | (line[hit[1:]] != line[hit[:-1]])]
    heads = np.flatnonzero(new)
    tails = np.r_[heads[1:], len(hit)] - 1
    raw, out = data.tobytes(), []
    documents = document_of(starts[hit[heads]], offsets).tolist()
    for d, h, t in zip(documents, hit[heads].tolist(), hit[tails].tolist()):
        kind = int(labels[h]) - 1
        text = raw[starts[h] : ends[t]]
        # punctuation around the run is not part of it
        left = len(text) - len(text.lstrip(b"\"'<>[]{},;:!?.#$%&*|=(" if kind != 3 else b"\"'<>[]{},;:!?.#$%&*|="))
        right = len(text) - len(text.rstrip(b"\"'<>[]{},;:!?.#$%&*|=)"))
        text = text[left : len(text) - right]
        if text and _valid(kind, text):
            out.append((d, kind, int(starts[h]) + left, int(ends[t]) - right))
    return out


def labelled_sequences(
    docs: DataFrame, text_col: str = "text", key: str = "doc_id", documents: int = 4000, rows: int = 1500, words_kept: int = 32
) -> tuple[np.ndarray, np.ndarray]:
    """The labelled table: shape codes and labels of sequences, padded to `words_kept`.

    At most `documents` keys chosen by hash and at most `rows` of their sequences, of which at most
    the first `words_kept` words are learned from. Labels come from the base spans.
    """
    docs = docs.select(F.col(key).alias("key"), F.col(text_col).alias("text"))
    keys = docs.select("key").where(F.col("key").isNotNull()).orderBy(F.xxhash64("key"), "key").limit(documents)
    some = docs.join(F.broadcast(keys), "key", "left_semi")

    def label(data, offsets):
        out = [[] for _ in range(len(offsets) - 1)]
        starts, _, code, line = words(data, offsets)
        if not len(starts):
            return [out]
        kind_at = np.zeros(len(data), np.int8)
        for _, kind, a, b in base_spans(data, offsets):
            kind_at[a:b] = kind + 1
        per_word = np.maximum.reduceat(kind_at, starts)
        first, length = sequences(code, line)
        length = np.minimum(length, words_kept)
        for d, a, n in zip(document_of(starts[first], offsets).tolist(), first.tolist(), length.tolist()):
            row = np.full((2, words_kept), -1, np.int16)
            row[0, :n], row[1, :n] = code[a : a + n], per_word[a : a + n]
            out[d].append(row.tobytes())
        return [out]

    field = T.StructField("found", T.ArrayType(T.BinaryType()))
    found = with_text_columns(some, label, [field], "text", ["key"]).select(F.explode("found").alias("row"))
    got = found.orderBy(F.xxhash64("row"), "row").limit(rows).toPandas()["row"]
    lines = np.frombuffer(b"".join(bytes(r) for r in got), np.int16).reshape(-1, 2, words_kept).astype(np.int64)
    return lines[:, 0], np.maximum(lines[:, 1], 0)


def train(codes: np.ndarray, labels: np.ndarray) -> crf.LinearChain | None:
    """None where there is nothing to learn from."""
    if not len(codes) or not labels.any():
        return None
    return crf.train(codes, labels, N_CODES, len(BASE_KINDS) + 1)


def all_spans(model, data, offsets) -> tuple[list[list[sp.Span]], list[list[sp.Span]]]:
    """Base spans and added spans per document, in code points."""
    n = len(offsets) - 1
    points = CodePoints(data, offsets)

    def spread(found, first_kind):
        per: list[list[sp.Span]] = [[] for _ in range(n)]
        documents = np.array([f[0] for f in found], np.int64)
        a = points.of(np.array([f[2] for f in found], np.int64), documents)
        b = points.of(np.array([f[3] for f in found], np.int64), documents)
        for (d, kind, _, _), start, end in zip(found, a.tolist(), b.tolist()):
            per[d].append((KINDS[first_kind + kind], start, end))
        return per

    base = [sp.in_order(s, KINDS) for s in spread(base_spans(data, offsets), 0)]
    if model is None:
        return base, [[] for _ in range(n)]
    more = spread(added_spans(model, data, offsets), len(BASE_KINDS))
    return base, [[s for s in m if sp.apart(s[1], s[2], b)] for b, m in zip(base, more)]


def find_pii(
    docs: DataFrame, model: crf.LinearChain | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Columns `keep`, counts and digest of the base spans, and all spans (code points, end exclusive).

    Null and empty texts have no spans; repeated rows give repeated results.
    """

    def run(data, offsets):
        base, more = all_spans(model, data, offsets)
        number = [sp.counts(s, BASE_KINDS) for s in base]
        return [
            *([c[i] for c in number] for i in range(4)),
            [sp.digest(sp.as_text(s)) for s in base],
            pa.array([sp.as_text(sp.in_order(s + m, KINDS)) for s, m in zip(base, more)], pa.string()),
        ]

    return with_text_columns(docs, run, FIELDS, text_col, keep)


def mask_pii(docs: DataFrame, model: crf.LinearChain | None, text_col: str = "text") -> DataFrame:
    """All columns of `docs`; each span in the text is replaced by its kind in brackets.

    Null texts stay null; texts without spans stay as they are.
    """

    def run(data, offsets):
        base, more = all_spans(model, data, offsets)
        raw = data.tobytes()
        out = []
        for i, (b, m) in enumerate(zip(base, more)):
            text = raw[offsets[i] : offsets[i + 1]]
            out.append(sp.masked(text.decode(), b + m) if b or m else text)
        return [pa.array([t.encode() if isinstance(t, str) else t for t in out], pa.binary()).cast(pa.string())]

    names = [f"c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index(text_col)]
    made = with_text_columns(docs.toDF(*names), run, [T.StructField("masked", T.StringType())], text, names)
    masked = F.when(F.col(text).isNotNull(), F.col("masked"))
    return made.select(*((masked if n == text else F.col(n)).alias(c) for n, c in zip(names, docs.columns)))
