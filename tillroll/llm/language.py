"""Language by rank-order profiles of character n-grams.

A profile lists the most frequent n-grams (one to three characters of letters, words set off by blanks) of a
language. A document's n-grams that any profile knows are ranked by how often they occur in the whole text, and
its distance to a language is how far each of the first ones is out of place there, `PROFILE` where it is missing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm.arrays import text_slices
from tillroll.llm.rowwise import with_text_columns

PROFILE = 400  # n-grams in a profile, and of a document that are looked at
BLANK = 32
WIDE = 1 << 21  # more than any code point
UNKNOWN = "und"
SLICE = 1 << 19

_tables: list[np.ndarray] = []


def _lower_letters() -> np.ndarray:
    """Code point to its lower case if that is one letter, itself if it is a letter, else 0."""
    if not _tables:
        table = np.zeros(0x110000, np.int32)
        for point in range(0x110000):
            c = chr(point)
            if c.isalpha():
                low = c.lower()
                table[point] = ord(low) if len(low) == 1 and low.isalpha() else point
        _tables.append(table)
    return _tables[0]


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters of a slice in lower case with single blanks between words, and the document of each.

    Documents are set apart by a blank, so a text may share one with the next.
    """
    n = len(offsets) - 1
    text = data.tobytes().decode()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=before[1:])
    at = before[offsets]
    code = _lower_letters()[points]
    code = np.insert(code, at, 0)  # one before each document and one at the end
    document = np.repeat(np.arange(-1, n), np.r_[0, np.diff(at)] + 1)
    document[at + np.arange(n + 1)] = np.minimum(np.arange(n + 1), max(n - 1, 0))
    letter = code > 0
    keep = letter.copy()
    keep[:-1] |= letter[1:]  # the blank before a word
    keep[1:] |= letter[:-1]
    code, document = code[keep], document[keep]
    blank = code == 0
    single = ~(blank & np.r_[False, blank[:-1]]) if len(blank) else blank
    code, document = code[single], document[single]
    return np.where(code == 0, BLANK, code).astype(np.int64), document


def grams(code: np.ndarray, document: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams as one number each, and their documents: letters, pairs and triples without a blank inside."""
    letter = code != BLANK
    one = letter
    two = letter[:-1] | letter[1:] if len(code) > 1 else np.zeros(0, bool)
    three = letter[1:-1] if len(code) > 2 else np.zeros(0, bool)
    pairs = code[:-1] * WIDE + code[1:] if len(code) > 1 else code[:0]
    triples = pairs[:-1] * WIDE + code[2:] if len(code) > 2 else code[:0]
    # the document of a letter in the n-gram, as a blank may stand between two documents
    of_pair = np.where(letter[:-1], document[:-1], document[1:]) if len(code) > 1 else document[:0]
    of_triple = document[1:-1] if len(code) > 2 else document[:0]
    return (
        np.concatenate([code[one], pairs[two], triples[three]]),
        np.concatenate([document[one], of_pair[two], of_triple[three]]),
    )


@dataclass
class Profiles:
    languages: list[str]
    known: np.ndarray  # n-grams of any profile, most frequent over all languages first
    rank: np.ndarray  # language x n-gram; PROFILE where it is missing

    def __post_init__(self) -> None:
        order = np.argsort(self.known, kind="stable")
        self._sorted, self._place = self.known[order], order

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], list[float]]:
        n, v = len(offsets) - 1, len(self.known)
        code, document = letters(data, offsets)
        has_letters = np.bincount(document[code != BLANK], minlength=n) > 0
        if not self.languages:
            return [UNKNOWN] * n, [0.0] * n
        gram, owner = grams(code, document)
        at = np.minimum(np.searchsorted(self._sorted, gram), v - 1)
        hit = self._sorted[at] == gram
        cell = owner[hit] * v + self._place[at[hit]]
        counts = np.bincount(cell, minlength=n * v).reshape(n, v)
        order = np.argsort(-counts, axis=1, kind="stable")[:, :PROFILE]
        looked_at = np.take_along_axis(counts, order, 1) > 0
        place = np.arange(order.shape[1])
        distance = np.stack(
            [np.where(looked_at, np.minimum(np.abs(ranks[order] - place), PROFILE), 0).sum(1) for ranks in self.rank], 1
        )
        best = distance.argmin(1)  # ties to the first language by code point
        most = np.maximum(looked_at.sum(1) * PROFILE, 1)
        score = np.where(looked_at.any(1), 1 - distance[np.arange(n), best] / most, 0.0)
        names = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), has_letters.tolist())]
        return names, np.where(has_letters, score, 0.0).tolist()


def is_held_out(id_col: str):
    """Ids kept from learning: CRC-32 of the id as text leaves 2 by 4. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def learn(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", documents: int = 20_000
) -> Profiles:
    """Profiles from a sample of at most `documents` texts with a language, chosen by a hash of the id; equal
    ids are told apart by the text."""
    known = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"))
    known = known.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    marked = known.withColumn("mark", F.xxhash64("id", F.xxhash64("text")))
    chosen = marked.select("mark").orderBy("mark").limit(documents)
    some = marked.join(F.broadcast(chosen.distinct()), "mark", "left_semi")

    def count(batches):
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for first, last, data, offsets in text_slices(batch.column("text"), SLICE):
                names, number = np.unique(langs[first:last].astype(str), return_inverse=True)
                gram, owner = grams(*letters(data, offsets))
                for i, name in enumerate(names.tolist()):
                    values, n = np.unique(gram[number[owner] == i], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(values), pa.string()), pa.array(values), pa.array(n)], names=["lang", "gram", "n"]
                    )

    counted = some.select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
    total = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = total.withColumn("place", place).where(F.col("place") <= PROFILE).toPandas()
    return _profiles(rows)


def _profiles(rows) -> Profiles:
    """From (lang, gram, n, place): at most PROFILE rows a language."""
    languages = sorted(set(rows["lang"]), key=lambda s: s.encode())
    overall = rows.groupby("gram")["n"].sum().reset_index().sort_values(["n", "gram"], ascending=[False, True])
    known = overall["gram"].to_numpy(np.int64)
    rank = np.full((len(languages), len(known)), PROFILE, np.int64)
    row = rows["lang"].map({name: i for i, name in enumerate(languages)}).to_numpy(int)
    column = rows["gram"].map({g: i for i, g in enumerate(known.tolist())}).to_numpy(int)
    rank[row, column] = rows["place"].to_numpy(int) - 1
    return Profiles(languages, known, rank)


FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]


def predict(docs: DataFrame, profiles: Profiles, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep`, lang_pred and score (0 to 1), one row per row of `docs`.

    `und` with score 0 where the text is null or has no letters, or nothing was learned. Letters that no
    profile knows give the first language with score 0. Only the text is looked at.
    """

    def run(data, offsets):
        names, scores = [], []
        # a slice is cut smaller here: each document takes a row of counts
        for at in range(0, len(offsets) - 1, 256):
            part = offsets[at : at + 257]
            a, b = profiles.predict(data[part[0] : part[-1]], part - part[0])
            names += a
            scores += b
        return [pa.array(names, pa.string()), scores]

    return with_text_columns(docs, run, FIELDS, text_col, keep)
