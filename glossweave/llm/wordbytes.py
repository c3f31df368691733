"""Words of many texts at once, as numpy arrays over their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

UPPER, LOWER, DIGIT, STOP, BANG, BAR, SYMBOL, WIDE, SPACE, LINE = range(10)
KINDS = 10


def _kind(c: int) -> int:
    ch = chr(c)
    if c >= 0x80:
        return WIDE
    if ch.isalpha():
        return UPPER if ch.isupper() else LOWER
    if ch.isdigit():
        return DIGIT
    if ch == "\n":
        return LINE
    if ch.isspace() or c < 0x20 or c == 0x7F:
        return SPACE
    return {"!": BANG, "|": BAR}.get(ch, STOP if ch in ".,;:?'\"-()" else SYMBOL)


KIND = np.array([_kind(c) for c in range(256)], dtype=np.uint8)
_LOWERED = np.array([c + 32 if 0x41 <= c <= 0x5A else c for c in range(256)], dtype=np.uint8)
_IN_LETTER_WORD = np.isin(KIND, (UPPER, LOWER, DIGIT, WIDE))
_IN_SPACED_WORD = ~np.isin(KIND, (SPACE, LINE))


class Texts:
    """``letters``: words are runs of letters and digits, else of anything but white space. ``of``: each word's text."""

    def __init__(self, texts: list[bytes | None], *, letters: bool):
        self.n = len(texts)
        blob = b"\n".join(t or b"" for t in texts) + b"\n" + bytes(8)
        raw = np.frombuffer(blob, dtype=np.uint8)
        self.size = np.array([len(t or b"") for t in texts], dtype=np.int64)
        self.begin = np.cumsum(self.size + 1) - self.size - 1
        self.kind = KIND[raw[:-8]]
        self.low = _LOWERED[raw]
        inside = (_IN_LETTER_WORD if letters else _IN_SPACED_WORD)[raw[:-8]]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])))).reshape(-1, 2)
        self.start, self.end = edges[:, 0], edges[:, 1]
        self.of = np.searchsorted(self.begin, self.start, side="right") - 1
        self.words = np.bincount(self.of, minlength=self.n)

    def kinds(self, group: np.ndarray, groups: int) -> np.ndarray:
        """How many bytes of each kind each group has; ``group`` numbers the group of each byte."""
        return np.bincount(group * KINDS + self.kind, minlength=groups * KINDS).reshape(groups, KINDS)

    def text_of_byte(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.size + 1)

    def heads(self, k: int) -> np.ndarray:
        """The first ``k`` bytes (8 at most) of each word, lower-case, as one integer; 0 for shorter words."""
        out = np.zeros(len(self.start), dtype=np.uint64)
        for j in range(k):
            out |= self.low[self.start + j].astype(np.uint64) << np.uint64(8 * j)
        out[self.end - self.start < k] = 0
        return out

    def whole(self) -> np.ndarray:
        """A 64-bit hash of each word, equal for equal words."""
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        lead = self.start[0]
        at = np.arange(lead, len(self.kind)) - np.repeat(self.start, np.diff(np.append(self.start, len(self.kind))))
        inside = np.zeros(len(self.kind) + 1, dtype=np.int8)
        np.add.at(inside, self.start, 1)
        np.add.at(inside, self.end, -1)
        inside = np.cumsum(inside[:-1])[lead:]
        value = (self.low[lead : len(self.kind)].astype(np.uint64) + np.uint64(1)) * _weights(at) * inside.astype(np.uint64)
        return np.add.reduceat(value, self.start - lead)


_W = np.random.default_rng(7).integers(1, 1 << 63, 1 << 12, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _weights(at: np.ndarray) -> np.ndarray:
    return _W[at & 0xFFF] + (at >> 12).astype(np.uint64)
