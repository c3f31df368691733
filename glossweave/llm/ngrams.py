"""Word n-grams of many texts at once, interned in an open-addressed numpy table.

Lower-case words of a batch stand in one array of bytes, each followed by one space, so a run of words is a stretch of it.
Stretches are hashed by XXH64. A slot of the table holds the first stretch that came to it; another one with the same hash has its bytes
compared and goes to the next slot if they differ. Then buckets, counts and gains are worked out for slots, and gathered for occurrences.
"""

from __future__ import annotations

import zlib

import numpy as np
import xxhash

_LOWERED = np.array([c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)], dtype=np.uint8)
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
#: From so many bytes on the library hashes a stretch by itself.
_STRIPE = 32


def _crc_steps() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = c >> np.uint32(1) ^ np.where(c & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return c


_CRC = _crc_steps()
#: From so many bytes on the library takes the CRC of a stretch by itself.
_LONG = 64


def _turn(x: np.ndarray, k: int) -> np.ndarray:
    return x << np.uint64(k) | x >> np.uint64(64 - k)


class Ngrams:
    """All runs of 1 to ``most`` consecutive words of each text, repeats included. ``of``: each run's text; ``words``: each text's words."""

    def __init__(self, texts: list[bytes | None], most: int = 2):
        raw = _LOWERED[np.frombuffer(b"\n".join(t or b"" for t in texts) + b"\n", dtype=np.uint8)]
        size = np.array([len(t or b"") + 1 for t in texts], dtype=np.int64)
        inside = raw != 0x20
        keep = inside.copy()
        keep[1:] |= inside[:-1]
        self.bytes = np.concatenate((raw[keep], np.zeros(8, dtype=np.uint8)))
        end = np.flatnonzero(self.bytes[:-8] == 0x20)
        start = np.concatenate(([0], end[:-1] + 1)) if len(end) else end
        text = np.searchsorted(np.cumsum(size), np.flatnonzero(keep)[end], side="right")
        self.words = np.bincount(text, minlength=len(texts))
        starts, sizes, of = [start], [end - start], [text]
        for k in range(1, most):
            same = np.flatnonzero(text[k:] == text[:-k]) if len(text) > k else np.zeros(0, dtype=np.int64)
            starts.append(start[same])
            sizes.append(end[same + k] - start[same])
            of.append(text[same])
        self.start, self.size, self.of = map(np.concatenate, (starts, sizes, of))
        self._wide = np.ndarray(max(0, len(self.bytes) - 7), dtype="<u8", buffer=self.bytes.data, strides=(1,))

    def hashes(self) -> np.ndarray:
        """XXH64 of each run."""
        h = self.size.astype(np.uint64) + _P5
        at = self.start.copy()
        short = self.size < _STRIPE
        for lane in range(_STRIPE // 8 - 1):
            i = np.flatnonzero(short & (self.size >= 8 * lane + 8))
            h[i] = _turn(h[i] ^ _turn(self._wide[at[i]] * _P2, 31) * _P1, 27) * _P1 + _P4
            at[i] += 8
        i = np.flatnonzero(short & (self.size & 4 > 0))
        h[i] = _turn(h[i] ^ (self._wide[at[i]] & np.uint64(0xFFFFFFFF)) * _P1, 23) * _P2 + _P3
        at[i] += 4
        for k in range(3):
            i = np.flatnonzero(short & (self.size & 3 > k))
            h[i] = _turn(h[i] ^ self.bytes[at[i]] * _P5, 11) * _P1
            at[i] += 1
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> np.uint64(29)
        h *= _P3
        h ^= h >> np.uint64(32)
        for i in np.flatnonzero(~short).tolist():
            h[i] = xxhash.xxh64_intdigest(self.bytes[self.start[i] : self.start[i] + self.size[i]].data)
        return h

    def _same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether runs ``a`` and ``b`` are the same bytes, pair by pair."""
        same = self.size[a] == self.size[b]
        i = np.flatnonzero(same & (a != b))
        done = 0
        while len(i):
            rest = np.minimum(self.size[a[i]] - done, 8)
            apart = self._wide[self.start[a[i]] + done] ^ self._wide[self.start[b[i]] + done]
            differ = apart << (np.uint64(8) * (8 - rest).astype(np.uint64)) != 0
            same[i[differ]] = False
            done += 8
            i = i[~differ & (self.size[a[i]] > done)]
        return same

    def interned(self, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Each run's slot, slots numbered from 0, and of each slot the run that has it first."""
        h = self.hashes() if hashes is None else hashes
        room = 1 << max(4, int(2 * len(h)).bit_length())
        held = np.full(room, -1, dtype=np.int64)
        slot = (h & np.uint64(room - 1)).astype(np.int64)
        open_ = np.arange(len(h))
        while len(open_):
            free = open_[held[slot[open_]] < 0]
            held[slot[free]] = free
            owner = held[slot[open_]]
            met = h[owner] == h[open_]
            met[met] = self._same(owner[met], open_[met])
            open_ = open_[~met]
            slot[open_] = slot[open_] + 1 & room - 1
        taken = np.flatnonzero(held >= 0)
        number = np.empty(room, dtype=np.int64)
        number[taken] = np.arange(len(taken))
        return number[slot], held[taken]

    def crc32(self, runs: np.ndarray) -> np.ndarray:
        """Unsigned CRC-32 of the given runs."""
        out = np.empty(len(runs), dtype=np.uint32)
        order = np.argsort(-self.size[runs], kind="stable")
        start, size = self.start[runs][order], self.size[runs][order]
        long = int(np.searchsorted(-size, -_LONG, side="right"))
        c = np.full(len(runs), 0xFFFFFFFF, dtype=np.uint32)
        n = len(runs)
        for j in range(int(size[long]) if long < n else 0):
            n = long + int(np.searchsorted(-size[long:n], -j, side="left"))
            c[long:n] = _CRC[(c[long:n] ^ self.bytes[start[long:n] + j]) & np.uint32(0xFF)] ^ c[long:n] >> np.uint32(8)
        c ^= np.uint32(0xFFFFFFFF)
        for i in range(long):
            c[i] = zlib.crc32(self.bytes[start[i] : start[i] + size[i]].data)
        out[order] = c
        return out
