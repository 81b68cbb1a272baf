"""A labelled table of its own for the secret scan: seeded lines with findings and with runs that only look like them."""

from __future__ import annotations

import numpy as np

LOWER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
LETTERS = LOWER + LOWER.upper()
BASE64 = LETTERS + DIGITS + "+/"
HEX = DIGITS + "abcdef"

# Lines around a finding and around others; {} is where it stands.
SECRET_LINES = (
    'password = "{}"', "api_key: {}", "export TOKEN={}", "secret={}", "Authorization: Bearer {}", "x-auth: {}",
    '"private_key": "{}",', "client credential {} rotated", "key {} was leaked", "login with {} please", "{}",
    "https://user:{}@host/db", "--access-key {} \\", "signature={}&v=2", "the old one was {} .",
)
OTHER_LINES = (
    "see {} for details", "file {} not found", "cp {} backup/", "version {} released", "at {} the job ended", "id {}",
    "https://example.org/{}", "import {}", "chapter {}", "order {} shipped", "ref={}", "path: {}", "name = {}", "{}",
    "({})", "build {} passed",
)
WORDS = "user account backup report index table page draft final summer photo invoice module python lib site core test data build release common config".split()


def _pick(rng: np.random.Generator, alphabet: str, low: int, high: int) -> str:
    return "".join(rng.choice(list(alphabet), int(rng.integers(low, high + 1))))


def _words(rng: np.random.Generator, low: int, high: int, joiner: str) -> str:
    return joiner.join(rng.choice(WORDS, int(rng.integers(low, high + 1))))


def finding(rng: np.random.Generator) -> str:
    """A run of random characters as keys and tokens have them."""
    kind = int(rng.integers(6))
    if kind == 0:
        return _pick(rng, HEX, 20, 64)
    if kind == 1:
        return _pick(rng, BASE64, 24, 88) + rng.choice(["", "=", "=="])
    if kind == 2:
        return "AKIA" + _pick(rng, LOWER.upper() + DIGITS, 16, 16)
    if kind == 3:
        return ".".join(_pick(rng, LETTERS + DIGITS + "_-", low, low + 30) for low in (20, 30, 24))
    if kind == 4:
        return rng.choice(["sk_live_", "ghp_", "xoxb-", "pk-"]) + _pick(rng, LETTERS + DIGITS, 24, 40)
    return _pick(rng, LETTERS + DIGITS, 18, 44)


def lookalike(rng: np.random.Generator) -> str:
    """A run of the same characters that is a path, a version, a date, a number or a name."""
    kind = int(rng.integers(7))
    date = f"{rng.integers(1990, 2030)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}"
    if kind == 0:
        return f"{_words(rng, 2, 5, '/')}/v{rng.integers(1, 30)}.{rng.integers(0, 99)}/{_words(rng, 1, 2, '_')}{rng.integers(0, 999)}.html"
    if kind == 1:
        return f"{_words(rng, 1, 3, '-')}-{rng.integers(0, 30)}.{rng.integers(0, 30)}.{rng.integers(0, 30)}-rc{rng.integers(0, 9)}"
    if kind == 2:
        return f"{date}T{rng.integers(0, 24):02d}.{rng.integers(0, 60):02d}.{rng.integers(0, 60):02d}-{_words(rng, 1, 2, '-')}"
    if kind == 3:
        return f"{rng.choice(list('ABCDEFGHINO'))}{rng.choice(list('ORNXY'))}-{date}-{rng.integers(1, 10**6):09d}"
    if kind == 4:
        return f"{_words(rng, 2, 4, '_')}_{rng.integers(100, 9999)}_{_words(rng, 1, 3, '_')}"
    if kind == 5:
        return f"{_words(rng, 2, 3, '.')}.{_words(rng, 1, 2, '')}{rng.integers(100, 999)}={rng.integers(0, 10**6)}"
    return f"{_words(rng, 2, 4, '-')}--{date}-{_words(rng, 1, 3, '-')}"


def labelled_lines(rows: int, seed: int) -> list[tuple[bytes, int, int, int]]:
    """(line, start, end, label) of `rows` lines, findings and others in turn."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(rows):
        label = i % 2
        value = finding(rng) if label else lookalike(rng)
        line = str(rng.choice(SECRET_LINES if label else OTHER_LINES))
        before, after = line.split("{}", 1) if rng.random() < 0.7 else ("", "")
        lead = _words(rng, 0, 5, " ") + str(rng.choice([" ", "\n"]))
        head = lead + before
        out.append(((head + value + after + "\n" + _words(rng, 0, 3, " ")).encode(), len(head), len(head) + len(value), label))
    return out
