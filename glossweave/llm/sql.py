"""Pieces of the DuckDB SQL that stands beside the operators."""

from __future__ import annotations


def _steps() -> list[int]:
    """What four bits at the low end of a CRC-32 become."""
    out = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def crc32(text: str) -> str:
    """Unsigned CRC-32 of a string's UTF-8 bytes, four bits at a time: of each byte the low ones first."""
    halves = ", ".join(f"strpos('0123456789ABCDEF', x[{k}])::UINTEGER - 1" for k in (2, 1))
    bits = f"flatten(list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: [{halves}]))"
    table = f"[{', '.join(map(str, _steps()))}]::UINTEGER[]"
    return f"xor(4294967295::UINTEGER, list_reduce(list_prepend(4294967295::UINTEGER, {bits}), lambda c, b: xor(({table})[(xor(c, b) & 15) + 1], c >> 4)))"


def folded(text: str) -> str:
    """A-Z as a-z, and nothing else changed."""
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
