"""Secrets: fixed patterns, and a small character network that looks at every other candidate.

A candidate is a run of `[A-Za-z0-9+/_.=-]` with enough characters, digits and
letters (parameters of `candidates`). The network sees all its characters, in blocks,
and those around each block, as classes; a candidate scores as its best block. It is
trained on a generated table of labelled lines (`findings`), so that it always has findings and others to learn
from, and then on all candidates of the documents, labelled by the base patterns, in parts whose networks are
averaged. Its scores are calibrated on all that was held back of both, and the threshold is the highest one
that still finds the wanted share of the findings held back.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm import findings
from tillroll.llm import spans as sp
from tillroll.llm.arrays import CodePoints, byte_table, document_of, runs, sums
from tillroll.llm.rowwise import with_text_columns
from tillroll.session import stage

# The patterns of the base findings and their least lengths.
ASSIGN = re.compile(
    rb"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX_DIGITS = byte_table(b"0123456789abcdef")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "model")

SECRET_CHARACTERS = byte_table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
DIGITS = byte_table(b"0123456789")
LETTERS = byte_table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
MIN_CANDIDATE, MIN_DIGITS, MIN_LETTERS = 16, 3, 2
LEFT, INSIDE, RIGHT = 24, 40, 16
WIDTH = LEFT + INSIDE + RIGHT

FIELDS = [
    T.StructField("n_assign", T.LongType()),
    T.StructField("n_access", T.LongType()),
    T.StructField("n_hex", T.LongType()),
    T.StructField("base_sha256", T.StringType()),
    T.StructField("spans", T.StringType()),
]


def _classes() -> np.ndarray:
    table = np.full(256, 18, np.uint8)
    table[128:] = 19
    for number, characters in enumerate(
        (b"0123456789", b"abcdef", b"ghijklmnopqrstuvwxyz", b"ABCDEF", b"GHIJKLMNOPQRSTUVWXYZ", b" ", b"\n",
         b"+", b"/", b"_", b".", b"=", b"-", b":", b"\"", b"'", b"@"), start=1
    ):
        table[list(characters)] = number
    return table


CLASS_OF = _classes()
N_CLASSES = 20  # class 0: beyond the text


def base_findings(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(document, kind, start, end) in bytes."""
    found = []
    raw = data.tobytes()
    # an assignment lies within a line that holds ':' or '='
    starts, ends = runs(data != 10, offsets)
    marked = sums((data == 58) | (data == 61), starts, ends) > 0
    for start, end in zip(starts[marked].tolist(), ends[marked].tolist()):
        for m in ASSIGN.finditer(raw, start, end):
            if m.end(1) - m.start(1) >= MIN_ASSIGN:
                found.append((0, m.start(), m.end()))
    at = raw.find(b"AKIA")
    while at >= 0:
        end = int(offsets[np.searchsorted(offsets, at, "right")])
        m = ACCESS.match(raw, at, end)
        if m and m.end() - at >= MIN_ACCESS:
            found.append((1, at, m.end()))
        at = raw.find(b"AKIA", m.end() if m else at + 1)
    starts, ends = runs(HEX_DIGITS[data], offsets)
    long = ends - starts >= MIN_HEX
    found += [(2, s, e) for s, e in zip(starts[long].tolist(), ends[long].tolist())]
    documents = document_of(np.array([f[1] for f in found], np.int64), offsets).tolist()
    return [(d, *f) for d, f in zip(documents, found)]


def candidates(
    data: np.ndarray, offsets: np.ndarray, least: int = MIN_CANDIDATE, digits: int = MIN_DIGITS, letters: int = MIN_LETTERS
) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the runs of at least `least` characters with so many digits and letters."""
    starts, ends = runs(SECRET_CHARACTERS[data], offsets)
    long = ends - starts >= least
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return starts, ends
    good = (sums(DIGITS[data], starts, ends) >= digits) & (sums(LETTERS[data], starts, ends) >= letters)
    return starts[good], ends[good]


def blocks(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of up to `INSIDE` characters that make up each run, and the run of each; a short rest goes back into
    the run, so that every block but that of a short run is full."""
    count = np.maximum(-(-(ends - starts) // INSIDE), 1)
    of = np.repeat(np.arange(len(starts)), count)
    number = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    low = np.maximum(np.minimum(starts[of] + number * INSIDE, ends[of] - INSIDE), starts[of])
    return low, np.minimum(low + INSIDE, ends[of]), of


def windows(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Character classes around each block of a candidate: left context, the block, right context.

    Bit 5 tells characters of the candidate from those around it.
    """
    documents = document_of(starts, offsets)
    low, high = offsets[documents], offsets[documents + 1]
    inside = np.minimum(ends - starts, INSIDE)
    column = np.arange(WIDTH)
    where = starts[:, None] - LEFT + column[None, :]
    right = column >= LEFT + INSIDE
    where[:, right] = ends[:, None] + (column[right] - LEFT - INSIDE)[None, :]
    own = (column >= LEFT)[None, :] & (column[None, :] < (LEFT + inside)[:, None])
    known = (where >= low[:, None]) & (where < high[:, None])
    known[:, LEFT : LEFT + INSIDE] &= own[:, LEFT : LEFT + INSIDE]
    classes = np.where(known, CLASS_OF[data[np.clip(where, 0, max(len(data) - 1, 0))]], 0)
    return (classes | (own << 5)).astype(np.uint8)


@dataclass
class CharacterNetwork:
    """Embedding, one convolution, maximum over positions, logistic output; calibrated."""

    kernel: np.ndarray  # taps x (class and inside bit) x filters
    bias: np.ndarray
    weight: np.ndarray
    offset: float
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    def _pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        taps = len(self.kernel)
        length = x.shape[1] - taps + 1
        h = np.zeros((len(x), length, len(self.bias)), np.float32) + self.bias
        for k in range(taps):
            h += self.kernel[k][x[:, k : k + length]]
        best = h.argmax(1)
        return np.maximum(np.take_along_axis(h, best[:, None, :], 1)[:, 0], 0), best

    def logits(self, x: np.ndarray, block: int = 2048) -> np.ndarray:
        parts = [self._pooled(x[i : i + block])[0] @ self.weight + self.offset for i in range(0, len(x), block)]
        return np.concatenate(parts) if parts else np.zeros(0, np.float32)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(x) + self.shift, -30, 30)))

    def is_secret(self, x: np.ndarray) -> np.ndarray:
        return self.probabilities(x) >= self.threshold

    def finds(self, data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether any block of each candidate is taken for a secret."""
        low, high, of = blocks(starts, ends)
        out = np.zeros(len(starts), bool)
        for at in range(0, len(low), 4096):  # windows of a bounded number of blocks at a time
            part = slice(at, at + 4096)
            np.logical_or.at(out, of[part], self.is_secret(windows(data, offsets, low[part], high[part])))
        return out


def train(x: np.ndarray, y: np.ndarray, recall: float = 0.98, steps: int = 400, seed: int = 42) -> CharacterNetwork | None:
    """None unless there are findings and others both for training and for calibration."""
    held = np.arange(len(y)) % 4 == 3
    if min((y[~held] == 1).sum(), (y[~held] == 0).sum(), (y[held] == 1).sum(), (y[held] == 0).sum()) < 2:
        return None
    rng = np.random.default_rng(seed)
    taps, filters = 5, 16
    net = CharacterNetwork(
        rng.normal(0, 0.2, (taps, 64, filters)).astype(np.float32),
        np.zeros(filters, np.float32),
        rng.normal(0, 0.3, filters).astype(np.float32),
        0.0,
    )
    xt, yt = x[~held], y[~held].astype(np.float32)
    sides = [np.flatnonzero(yt == v) for v in (0, 1)]
    picks = (np.concatenate([rng.choice(side, 32) for side in sides]) for _ in range(steps))
    _descend(net, ((xt[pick], yt[pick]) for pick in picks))
    _calibrate(net, x[held], y[held].astype(float), recall)
    return net


def _descend(net: CharacterNetwork, batches: Iterable[tuple[np.ndarray, np.ndarray]], rate: float = 0.02) -> None:
    """A step of gradient descent with moments for each batch."""
    parameters = [net.kernel, net.bias, net.weight, np.full(1, net.offset, np.float32)]
    first = [np.zeros_like(p) for p in parameters]
    second = [np.zeros_like(p) for p in parameters]
    for step, (xb, yb) in enumerate(batches, start=1):
        pooled, best = net._pooled(xb)
        p = 1 / (1 + np.exp(-np.clip(pooled @ net.weight + parameters[3][0], -30, 30)))
        d = (p - yb) / len(yb)
        d_pooled = d[:, None] * net.weight * (pooled > 0)
        d_kernel = np.zeros_like(net.kernel)
        for k in range(len(net.kernel)):
            ids = np.take_along_axis(xb, best + k, 1)  # rows x filters
            np.add.at(d_kernel[k], (ids, np.arange(len(net.bias))[None, :]), d_pooled)
        gradients = [d_kernel, d_pooled.sum(0), pooled.T @ d + 1e-4 * net.weight, np.array([d.sum()], np.float32)]
        for q, g, m, v in zip(parameters, gradients, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    net.offset = float(parameters[3][0])


def _calibrate(net: CharacterNetwork, x: np.ndarray, y: np.ndarray, recall: float) -> None:
    """Logistic calibration on the part held back, then the highest threshold with the wanted recall."""
    _calibrate_scores(net, net.logits(x).astype(float), y, np.ones(len(y)), recall)


def _calibrate_scores(net: CharacterNetwork, z: np.ndarray, y: np.ndarray, weight: np.ndarray, recall: float) -> None:
    a, b = 1.0, 0.0
    right, wrong = (weight * y).sum(), (weight * (1 - y)).sum()
    goal = np.where(y == 1, (right + 1) / (right + 2), 1 / (wrong + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w, off = weight * (p * (1 - p) + 1e-6), weight * (p - goal)
        g = np.array([(off * z).sum() + 1e-3 * (a - 1), off.sum()])
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        move = np.linalg.solve(h, g)
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-8:
            break
    net.slope, net.shift = float(max(a, 1e-3)), float(b)
    found = 1 / (1 + np.exp(-np.clip(net.slope * z[y == 1] + net.shift, -30, 30)))
    order = np.argsort(found, kind="stable")
    below = np.cumsum(weight[y == 1][order])
    net.threshold = float(found[order][np.searchsorted(below, (1 - recall) * below[-1], "right")])


def every_candidate(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, n): each different block of a candidate of any document, as the byte that tells whether a base pattern
    covers the candidate and the block's window, and how often it occurs."""

    def label(data, offsets):
        out = [[] for _ in range(len(offsets) - 1)]
        starts, ends = candidates(data, offsets)
        if len(starts):
            covered = np.zeros(len(data) + 1, np.int64)
            for _, _, a, b in base_findings(data, offsets):
                covered[a] += 1
                covered[b] -= 1
            y = sums(np.cumsum(covered)[:-1] > 0, starts, ends) > 0
            low, high, of = blocks(starts, ends)
            x = windows(data, offsets, low, high)
            for d, row, hit in zip(document_of(low, offsets).tolist(), x, y[of].tolist()):
                out[d].append(bytes([hit]) + row.tobytes())
        return [out]

    field = T.StructField("found", T.ArrayType(T.BinaryType()))
    found = with_text_columns(docs, label, [field], text_col, []).select(F.explode("found").alias("row"))
    return found.groupBy("row").agg(F.count(F.lit(1)).alias("n"))


def _table(rows: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Windows and labels of `rows`."""
    table = np.frombuffer(b"".join(bytes(r) for r in rows), np.uint8).reshape(-1, WIDTH + 1)
    return table[:, 1:], table[:, 0]


def labelled_candidates(docs: DataFrame, text_col: str = "text", rows: int = 6000) -> tuple[np.ndarray, np.ndarray]:
    """Windows and labels of at most `rows` different candidates, to look at; `trained` learns from all."""
    got = every_candidate(docs, text_col).orderBy(F.xxhash64("row"), "row").limit(rows).toPandas()["row"]
    return _table(got)


def generated_candidates(rows: int = 3000, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Windows and labels of the generated table of `rows` lines, in a mixed order."""
    lines = findings.labelled_lines(rows, seed)
    data = np.frombuffer(b"".join(line for line, *_ in lines), np.uint8)
    offsets = np.cumsum([0, *(len(line) for line, *_ in lines)])
    starts = np.array([offsets[i] + a for i, (_, a, _, _) in enumerate(lines)], np.int64)
    ends = np.array([offsets[i] + b for i, (_, _, b, _) in enumerate(lines)], np.int64)
    low, high, of = blocks(starts, ends)
    order = np.random.default_rng(seed).permutation(len(of))
    return windows(data, offsets, low, high)[order], np.array([n for *_, n in lines])[of][order]


def _numbers(net: CharacterNetwork) -> np.ndarray:
    return np.concatenate([net.kernel.ravel(), net.bias, net.weight, [net.offset]]).astype(float)


def _network(numbers: np.ndarray, like: CharacterNetwork) -> CharacterNetwork:
    size, filters = like.kernel.size, len(like.bias)
    kernel, bias, weight, offset = np.split(np.asarray(numbers, np.float32), [size, size + filters, size + 2 * filters])
    return CharacterNetwork(kernel.reshape(like.kernel.shape), bias, weight, float(offset[0]))


def _taught(net: CharacterNetwork, candidates: DataFrame, x: np.ndarray, y: np.ndarray, parts: int, number: int) -> CharacterNetwork:
    """The mean of the networks that the parts of `candidates` (row, n) make of `net`, by their rows. A part takes
    each of its rows once, one row among three of the generated ones `x` and `y`."""
    before, like = _numbers(net), net
    sides = [np.flatnonzero(y == v) for v in (0, 1)]

    def teach(rows: pd.DataFrame) -> pd.DataFrame:
        own_x, own_y = _table(sorted(map(bytes, rows["row"])))
        rng = np.random.default_rng([number, len(own_y), int(rows["part"].iloc[0])])
        order, one = rng.permutation(len(own_y)), _network(before, like)

        def batches():
            for at in range(0, len(order), 16):
                own = order[at : at + 16]
                more = np.concatenate([rng.choice(side, 24) for side in sides])
                yield np.concatenate([x[more], own_x[own]]), np.concatenate([y[more], own_y[own]]).astype(np.float32)

        _descend(one, batches(), 0.002)
        n = float(len(own_y))
        return pd.DataFrame({"place": np.arange(len(before)), "total": _numbers(one) * n, "n": n})

    dealt = candidates.withColumn("part", F.pmod(F.xxhash64("row", F.lit(number)), F.lit(parts)))
    taught = dealt.groupBy("part").applyInPandas(teach, "place int, total double, n double")
    # as many rows as the network has numbers; rounded, so that the order of the parts does not show
    mean = taught.groupBy("place").agg(F.round(F.sum("total") / F.sum("n"), 6).alias("v")).toPandas()
    return _network(mean.sort_values("place")["v"].to_numpy(), like) if len(mean) else net


def _scores_held(net: CharacterNetwork, candidates: DataFrame) -> pd.DataFrame:
    """(z, y, n): scores of all rows of `candidates` in steps of a thousandth, rounded down, and how many have them;
    beyond 30 they make no difference."""

    def score(batches):
        for batch in batches:
            x, y = _table(batch["row"].to_pylist())
            z = np.floor(np.clip(net.logits(x).astype(float), -30, 30) * 1000).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(z), pa.array(y.astype(np.int32)), batch["n"]], names=["z", "y", "n"])

    scored = candidates.mapInArrow(score, "z int, y int, n long")
    return scored.groupBy("z", "y").agg(F.sum("n").alias("n")).orderBy("z", "y").toPandas()


def trained(
    docs: DataFrame, text_col: str = "text", recall: float = 0.98, rounds: int = 2, part_rows: int = 4096
) -> CharacterNetwork:
    """The network from the generated table and all candidates of `docs`.

    What a base pattern covers teaches nothing that the base does not find, and may not outweigh the rest: the
    documents' rows make up a quarter of each batch, and at most a quarter of the generated rows' weight in the
    calibration.
    """
    x, y = generated_candidates()
    net = train(x, y, recall)
    held = np.arange(len(y)) % 4 == 3  # as `train` does
    candidates = stage(every_candidate(docs, text_col), "candidates")
    known = candidates.count()
    if not known:
        return net
    back = F.pmod(F.xxhash64("row"), F.lit(4)) == 3
    for number in range(rounds):
        net = _taught(net, candidates.where(~back), x[~held], y[~held], -(-known // part_rows), number)
    scores = _scores_held(net, candidates.where(back))
    own = scores["n"].to_numpy(float)
    own *= min(1.0, held.sum() / 4 / max(own.sum(), 1.0))
    z = np.concatenate([net.logits(x[held]).astype(float), scores["z"].to_numpy(float) / 1000])
    labels = np.concatenate([y[held], scores["y"].to_numpy()]).astype(float)
    _calibrate_scores(net, z, labels, np.concatenate([np.ones(held.sum()), own]), recall)
    return net


def find_secrets(
    docs: DataFrame, model: CharacterNetwork | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Columns `keep`, counts and digest of the base findings, and all spans (code points, end exclusive).

    Null and empty texts have no findings, an empty table no rows; repeated rows give repeated results. Whole
    texts count, however long, and of a candidate every character. Where kinds start at one place they come in
    the order of `KINDS`. Other columns take no part. Spans of kind `model` are candidates that the network
    takes for secrets and no base finding overlaps.
    """

    def run(data, offsets):
        n = len(offsets) - 1
        per: list[list[sp.Span]] = [[] for _ in range(n)]
        points = CodePoints(data, offsets)
        found = base_findings(data, offsets)
        documents = np.array([f[0] for f in found], np.int64)
        starts = points.of(np.array([f[2] for f in found], np.int64), documents)
        ends = points.of(np.array([f[3] for f in found], np.int64), documents)
        for (d, kind, _, _), a, b in zip(found, starts.tolist(), ends.tolist()):
            per[d].append((BASE_KINDS[kind], a, b))
        base = [sp.in_order(s, KINDS) for s in per]
        more: list[list[sp.Span]] = [[] for _ in range(n)]
        if model is not None:
            starts, ends = candidates(data, offsets)
            if len(starts):
                hit = model.finds(data, offsets, starts, ends)
                starts, ends = starts[hit], ends[hit]
                documents = document_of(starts, offsets)
                a, b = points.of(starts, documents), points.of(ends, documents)
                for d, s, e in zip(documents.tolist(), a.tolist(), b.tolist()):
                    if sp.apart(s, e, base[d]):
                        more[d].append(("model", s, e))
        number = [sp.counts(s, BASE_KINDS) for s in base]
        return [
            *([c[i] for c in number] for i in range(3)),
            [sp.digest(sp.as_text(s)) for s in base],
            pa.array([sp.as_text(sp.in_order(s + m, KINDS)) for s, m in zip(base, more)], pa.string()),
        ]

    return with_text_columns(docs, run, FIELDS, text_col, keep)
