"""Encoding whole texts with a public tokenizer, a chunk at a time.

A pre-tokenizer never lets a token reach from a character that isn't white space over a following space or
newline, nor from a letter or digit over a following mark that isn't an apostrophe. So texts are cut there, chunks are
remembered, and a text's ids are its chunks' ids in a row. A word of letters goes to the library's model by itself,
any other chunk that is new to the whole library. Texts with characters for which a cut isn't safe go to the library
whole, and so do all texts if the tokenizer's normalizer and pre-tokenizer aren't ones for which this is known.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable

_CHUNKS = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_OTHER_SPACE = re.compile(r"[^\S \n]|\0")
_OTHER_SPACES = [c for c in map(chr, range(0x3001)) if _OTHER_SPACE.match(c)]
#: Marks at a chunk's end that no special token holds and that begin no contraction.
_MARKS = '.,;:!?#$%&*()+-=@"'
_LONG = 200
# Normalizer and pre-tokenizer of the tokenizers for which cuts are safe, those that keep and those that drop white space.
_SAFE = {
    False: (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}),
    True: (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ]},
    ),
}


def _uneven(text: str) -> bool:
    """Whether one space or newline between two words isn't all the white space there is."""
    ends = text[:1] + text[-1:]
    return " " in ends or "\n" in ends or any(x in text for x in ("  ", "\n\n", " \n", "\n ")) or any(x in text for x in _OTHER_SPACES)


def _byte_characters() -> dict[int, str]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and number the others from U+0100 on."""
    others = [b for b in range(256) if not (0x21 <= b <= 0x7E or (0xA1 <= b and b != 0xAD))]
    return {b: chr(0x100 + k) for k, b in enumerate(others)}


class _Memory(dict):
    """Learns what it is asked for and lacks."""

    def __init__(self, learn: Callable[[str], bytes]):
        self.learn = learn

    def __missing__(self, key: str) -> bytes:
        self[key] = value = self.learn(key)
        return value


class Encoder:
    """``drops_space``: the tokenizer has no tokens with white space, so any cut at a space or newline is safe.

    ``encode`` gives little-endian 16-bit ids. ``remembered`` bounds the chunks that are kept: the newest so many, and
    as many before them as long as they turn up again."""

    def __init__(self, path: str, *, drops_space: bool, remembered: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError("ids beyond 16 bits")
        settings = json.loads(self.library.to_str())
        self.safe = (settings["normalizer"], settings["pre_tokenizer"]) == _SAFE[drops_space] and settings["model"]["type"] == "BPE"
        self.drops_space, self.remembered = drops_space, remembered
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.words_alone = not any(x.isalpha() for x in special)
        self.marks = "".join(c for c in _MARKS if not any(c in x for x in special))
        self.merge, self.characters = self.library.model.tokenize, _byte_characters()
        self.space = self.characters[0x20]
        self.known, self.before = _Memory(self._learn), {}
        self.tails = _Memory(lambda x: self._direct([x])[0])

    def _direct(self, texts: list[str]) -> list[bytes]:
        return [array("H", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _keys(self, text: str) -> list[str] | None:
        """Of each chunk. A key is the chunk without the space it begins with; with a newline it begins with; or after a
        NUL as it is. None if only the whole text is safe."""
        if self.drops_space:
            return text.replace("\n", " ").split(" ")
        if not _uneven(text):
            keys = text.replace("\n", " \n").split(" ")
            keys[0] = "\0" + keys[0] if keys[0] else ""
            return keys
        if _OTHER_SPACE.search(text):
            return None
        return [c[1:] if c[0] == " " and c[1:2] not in (" ", "\n", "") else "\0" + c for c in _CHUNKS.findall(text)]

    def _learn(self, key: str) -> bytes:
        if (value := self.before.get(key)) is not None:
            return value
        if self.words_alone and key.isalpha() and len(key) <= _LONG and (key.isascii() or max(key) <= "ÿ"):
            return self._word(key.lower() if self.drops_space else " " + key)
        stem = key.rstrip(self.marks)
        if 1 < len(stem) < len(key) <= len(stem) + 8 and stem[-1] <= "ÿ" and stem[-1].isalnum():
            return self.known[stem] + self.tails[key[len(stem) :]]
        if not key:
            return b""
        if self.drops_space:
            return self._direct([key])[0]
        if key[0] == "\n" and self.words_alone and key[1:].isalpha() and len(key) <= _LONG and max(key) <= "ÿ":
            return self.tails["\n"] + self._word(key[1:])
        return self._direct([key[1:] if key[0] == "\0" else key if key[0] == "\n" else " " + key])[0]

    def _word(self, text: str) -> bytes:
        """Letters up to U+00FF, which are one pre-token with the space before them; the model takes those as they are."""
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(self.characters)
        elif text[0] == " ":
            text = self.space + text[1:]
        return array("H", [t.id for t in self.merge(text)]).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.safe:
            return [x if t else b"" for t, x in zip(texts, self._direct([t or "" for t in texts]), strict=True)]
        return [self._one(t) if t else b"" for t in texts]

    def _one(self, text: str) -> bytes:
        keys = self._keys(text)
        if keys is None:
            return self._direct([text])[0]
        if len(self.tails) > 10_000:
            self.tails.clear()
        if len(self.known) > self.remembered:
            self.before, self.known = self.known, _Memory(self._learn)
        return b"".join(map(self.known.__getitem__, keys))


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, *, drops_space: bool) -> Encoder:
    """One for each Python worker: what it remembers serves later tasks too."""
    if (path, drops_space) not in _ENCODERS:
        _ENCODERS[path, drops_space] = Encoder(path, drops_space=drops_space)
    return _ENCODERS[path, drops_space]
