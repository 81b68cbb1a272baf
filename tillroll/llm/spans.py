"""Found spans of a document: in order, as text, and with a digest."""

from __future__ import annotations

import hashlib
from collections import Counter

Span = tuple[str, int, int]


def in_order(spans: list[Span], kinds: tuple[str, ...]) -> list[Span]:
    """By start, then by the place of the kind in `kinds`."""
    rank = {kind: i for i, kind in enumerate(kinds)}
    return sorted(spans, key=lambda s: (s[1], rank[s[0]], s[2]))


def as_text(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def counts(spans: list[Span], kinds: tuple[str, ...]) -> list[int]:
    seen = Counter(kind for kind, _, _ in spans)
    return [seen[kind] for kind in kinds]


def apart(start: int, end: int, taken: list[Span]) -> bool:
    """True if no span of `taken` overlaps start..end."""
    return all(end <= a or b <= start for _, a, b in taken)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans merge."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])
