"""Quality classifier: an additive model over counts that each whole text gives."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm import gam
from tillroll.llm.rowwise import with_text_columns

THRESHOLD = 0.3  # fixed value: from this score on a document counts as class 1

_CLASSES = {
    "upper": bytes(range(65, 91)),
    "lower": bytes(range(97, 123)),
    "digit": b"0123456789",
    "blank": b" \t\x0b\x0c\r",
    "line": b"\n",
    "shout": b"!",
    "bar": b"|",
    "symbol": b"#*$%&<>@^~=+\\",
    "stop": b".,;:?",
    "bracket": b"()[]{}\"'`-_/",
    "tail": bytes(range(0x80, 0xC0)),
    "wide": bytes(range(0xC0, 0x100)),
}
_CLASS = np.full(256, len(_CLASSES), np.uint8)
for _number, _bytes in enumerate(_CLASSES.values()):
    _CLASS[list(_bytes)] = _number

FEATURES = (
    "log_words", "mean_word", "upper", "digit", "shout", "bar", "symbol", "stop", "bracket", "wide", "blank", "control",
    "distinct", "most_frequent", "short_words", "capitals", "longest_word", "repeated_triples", "log_lines",
    "words_a_line", "repeated_lines", "ended_lines",
)


def _word_features(text: bytes) -> list[float]:
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * 13
    count = Counter(words)
    number = {w: i for i, w in enumerate(count)}
    times = np.fromiter(count.values(), np.int64, len(count))
    length = np.fromiter(map(len, count), np.int64, len(count))
    capital = np.fromiter(map(bytes.isupper, count), bool, len(count))
    again = 0.0
    if n > 2:
        at = np.fromiter(map(number.__getitem__, words), np.uint64, n)
        triple = (at[:-2] * np.uint64(0x9E3779B97F4A7C15) + at[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + at[2:]
        again = 1 - len(np.unique(triple)) / (n - 2)
    lines = [line for line in text.split(b"\n") if line.strip()]
    return [
        np.log1p(n),
        float((times * length).sum()) / n,
        len(count) / n,
        int(times.max()) / n,
        float(times[length <= 3].sum()) / n,
        float(times[capital & (length > 1)].sum()) / n,
        np.log1p(int(length.max())),
        again,
        np.log1p(len(lines)),
        n / len(lines),
        1 - len(set(lines)) / len(lines),
        sum(line.rstrip().endswith((b".", b"!", b"?")) for line in lines) / len(lines),
        1.0,
    ]


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Features of the texts of a slice; all zero for a text without words."""
    n, kinds = len(offsets) - 1, len(_CLASSES) + 1
    size = np.diff(offsets)
    cell = np.repeat(np.arange(n) * kinds, size) + _CLASS[data]
    count = dict(zip([*_CLASSES, "control"], np.bincount(cell, minlength=n * kinds).reshape(n, kinds).T))
    points = np.maximum(size - count["tail"], 1)
    letters = np.maximum(count["upper"] + count["lower"] + count["wide"], 1)
    raw = data.tobytes()
    word = np.array([_word_features(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]).reshape(n, 13)
    shares = [count["upper"] / letters] + [
        count[kind] / points
        for kind in ("digit", "shout", "bar", "symbol", "stop", "bracket", "wide", "blank", "control")
    ]
    return np.column_stack([word[:, 0], word[:, 1], *shares, word[:, 2:12]]) * word[:, 12:]


def is_held_out(id_col: str) -> Column:
    """Ids whose labels are never learned from: CRC-32 of the id as text is divisible by 5. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled_features(
    docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", rows: int = 20_000
) -> tuple[np.ndarray, np.ndarray]:
    """Features and classes of at most `rows` labelled documents outside the held-out ids, chosen by a hash of the id.

    A repeated label counts by its mean, from one half on as 1; null labels and null ids are left out.
    """
    label, key = F.col(label_col), F.col(id_col)
    known = labels.where(label.isNotNull() & key.isNotNull() & ~is_held_out(id_col))
    known = known.groupBy(key.alias("id")).agg((F.avg(label.cast("double")) >= 0.5).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(key.alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    field = T.StructField("x", T.ArrayType(T.DoubleType()))
    made = with_text_columns(texts, lambda d, o: [list(text_features(d, o))], [field], "text", ["id", "y"])
    got = made.orderBy(F.xxhash64("id"), "id", "x").limit(rows).select("y", "x").toPandas()
    x = np.array(got["x"].tolist(), float).reshape(-1, len(FEATURES))
    return x, got["y"].to_numpy(int)


FIELDS = [T.StructField("score", T.DoubleType())]


def score(docs: DataFrame, model: gam.AdditiveModel, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` and score, one row per row of `docs`: how likely the whole text is of class 1.

    Only the text is looked at. Null and empty texts, and texts without words, have all features zero and the
    score that this gives. Equal texts have equal scores. An empty table gives no rows.
    """
    return with_text_columns(docs, lambda d, o: [model.score(text_features(d, o)).tolist()], FIELDS, text_col, keep)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, learned from the labels of those not held out."""
    model = gam.train(*labelled_features(docs, labels))
    predicted = F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted")
    return score(docs, model).select("doc_id", is_held_out("doc_id").alias("held_out"), "score", predicted)
