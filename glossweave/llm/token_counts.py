"""Token counts by a finite-state transducer compiled from a sentencepiece BPE model.

What BPE makes of a text is a row of pieces of which every two neighbours, encoded together, stay those two pieces;
for each prefix of the text exactly one piece can be last. So a reader of the text only has to know, for each place
behind it where a piece that isn't complete yet may have begun, the last piece of the text up to there and how many
pieces that text has. That is a finite state: the characters since the earliest such place, and for each place a
piece and a count relative to the present one. A transition on a character carries the change in the number of
pieces. States and transitions are compiled from the vocabulary when they are first needed and kept in a hash table
of numpy arrays.

No piece reaches over a border between a character and a space mark, so there the machine is in its first state
again. Texts are cut into chunks at such borders, every chunk's state map is then a constant, and thousands of
chunks run in step, a numpy table lookup for each character place. A run of characters with no border is cut
anyway; such a chunk's map is computed for the states that the characters before it lead to, and a parallel prefix scan
composes the maps of a run by doubling pointers. Maps that lack the state that comes in get it, and the scan is repeated.

Null and empty texts have no tokens. Characters that the model lacks count as their UTF-8 bytes. Very long texts are many
chunks. Repeated rows are counted each; an empty table gives no rows. A model with another normalizer or with pieces too long for a
transition's counter is refused.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.llm.common import own_columns, ship, table

SPACE = "▁"
_MIX, _ALL = 0x9E3779B97F4A7C15, (1 << 64) - 1  # of multiplicative hashing
_NONE = ""  # a last piece that nothing can merge with
#: Texts whose counts show how a model treats white space, letters of other widths and cases, and special strings.
_PROBES = ["", " ", "a", " a", "a  b ", "\t\n a\r\n", "ﬁ ａ① É é", "İstanbul STRASSE", "<s></s><unk>", "▁ x▁", "\u200b\u00a0z", "日本語"]


class Transducer:
    def __init__(self, path: str, *, most_states: int = 300_000, columns: int = 255):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        normal = [k for k in range(n) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))]
        self.rank = {model.id_to_piece(k): -model.get_score(k) for k in normal}
        self.open = {p[:k] for p in self.rank for k in range(1, len(p))}
        self.near = {p[k : k + 2] for p in self.rank for k in range(len(p) - 1)}
        self.chars = {c for p in self.rank for c in p}
        if any(x[1] == SPACE != x[0] for x in self.near) or not all(c in self.rank for c in self.chars):
            raise ValueError("this model has pieces over word borders, or characters that aren't pieces")
        if max(map(len, self.rank)) > 31:
            raise ValueError("pieces longer than a transition's change can hold")
        self.stays: dict[tuple[str, str], bool] = {}
        self.most_states, self.columns = most_states, columns
        self.column = np.zeros(0x110000, dtype=np.uint8)  # 0: no column of its own
        self.by_column = [""]
        self.own(SPACE)
        self.clear()
        if [len(x) for x in model.encode(_PROBES)] != self.counts(_PROBES).tolist():
            raise ValueError("this model normalises texts or adds a space otherwise than is assumed")

    def clear(self) -> None:
        self.first = ("", ((0, _NONE, 0),))
        self.states, self.number = [self.first], {self.first: 0}
        self.resize(16)

    def resize(self, bits: int) -> None:
        """A table of 2**bits places; the transitions there were before move over."""
        old = (self.keys, self.moves) if bits > 16 else (np.array([], dtype=np.int64), None)
        self.bits, self.filled = bits, 0
        self.keys, self.moves = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits, dtype=np.int32)
        for at in np.flatnonzero(old[0] >= 0).tolist():
            self.put(int(old[0][at]), int(old[1][at]))

    def put(self, key: int, move: int) -> None:
        at = (key * _MIX & _ALL) >> (64 - self.bits)
        while self.keys[at] not in (-1, key):
            at = (at + 1) & ((1 << self.bits) - 1)
        self.filled += self.keys[at] == -1
        self.keys[at], self.moves[at] = key, move

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The transitions of these keys, -1 where there is none yet."""
        at = ((keys.astype(np.uint64) * np.uint64(_MIX)) >> np.uint64(64 - self.bits)).astype(np.int64)
        there = self.keys[at]
        got = self.moves[at]
        todo = np.flatnonzero(there != keys)
        while todo.size:
            empty = there[todo] == -1
            got[todo[empty]] = -1
            todo = todo[~empty]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            there[todo] = self.keys[at[todo]]
            got[todo] = self.moves[at[todo]]
            todo = todo[there[todo] != keys[todo]]
        return got

    def own(self, c: str) -> None:
        if not self.column[ord(c)] and len(self.by_column) < self.columns:
            self.column[ord(c)] = len(self.by_column)
            self.by_column.append(c)

    def pieces(self, text: str) -> list[str]:
        """BPE as it is defined: of all neighbours that make a piece, the best merge first, the leftmost of equals."""
        parts = list(text)
        while True:
            best = min(((self.rank[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.rank), default=None)
            if best is None:
                return parts
            parts[best[1] : best[1] + 2] = ["".join(parts[best[1] : best[1] + 2])]

    def fits(self, last: str, piece: str) -> bool:
        key = (last, piece)
        if key not in self.stays:
            self.stays[key] = self.pieces(last + piece) == [x for x in key if x]
        return self.stays[key]

    def step(self, state: tuple, c: str) -> tuple[tuple, int]:
        """The state after ``c`` and the change in the number of pieces."""
        text, places = state
        if c not in self.chars:
            return self.first, len(c.encode())
        if text and text[-1] + c not in self.near:  # nothing merges over this border
            text, places = "", ((0, _NONE, places[-1][2]),)
        elif not text and places[-1][1] != _NONE and places[-1][1][-1] + c not in self.near:
            places = ((0, _NONE, 0),)
        for back, last, n in places:
            piece = text[len(text) - back :] + c
            if piece in self.rank and self.fits(last, piece):
                break
        else:
            raise AssertionError("no piece ends here")
        change = n + 1
        text += c
        rest = tuple((b + 1, x, m - change) for b, x, m in places if text[len(text) - b - 1 :] in self.open)
        keep = rest[0][0] if rest else 0
        return (text[len(text) - keep :], (*rest, (0, piece, 0))), change

    def number_of(self, state: tuple) -> int:
        if state not in self.number:
            self.number[state] = len(self.states)
            self.states.append(state)
        return self.number[state]

    def compile(self, keys: np.ndarray) -> None:
        for key in np.unique(keys).tolist():
            state, change = self.step(self.states[key >> 8], self.by_column[key & 255])
            self.put(key, self.number_of(state) * 64 + change + 32)
        if self.filled > 1 << self.bits - 1:
            self.resize(self.bits + 2)

    def run(self, codes: np.ndarray, wide: np.ndarray, start: np.ndarray, length: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit states and counts of chunks that run in step. ``wide``: the characters, for those without a column."""
        order = np.argsort(-length, kind="stable")
        at, left, now = start[order], length[order], state[order].astype(np.int64)
        total = np.zeros(len(order), dtype=np.int64)
        n = len(order)
        for k in range(int(left[0]) if n else 0):
            while left[n - 1] <= k:
                n -= 1
            code = codes[at[:n] + k].astype(np.int64)
            key = now[:n] * 256 + code
            got = self.get(key)
            if (odd := np.flatnonzero(got < 0)).size:
                if (own := odd[code[odd] > 0]).size:
                    self.compile(key[own])
                    got[own] = self.get(key[own])
                for i in odd[code[odd] == 0].tolist():
                    to, change = self.step(self.states[now[i]], chr(wide[at[i] + k]))
                    got[i] = self.number_of(to) * 64 + change + 32
            now[:n] = got >> 6
            total[:n] += (got & 63) - 32
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return now[back], total[back]

    def composed(self, codes: np.ndarray, wide: np.ndarray, start: np.ndarray, length: np.ndarray, cut: np.ndarray, leave: np.ndarray, warm: int) -> np.ndarray:
        """Counts of the chunks ``cut``, which no border begins. Each gets a map from entry states to exit states and counts. A
        scan then composes the maps of each run of chunks: every entry of a map points to the entry of the next that its exit
        is, and pointers are doubled, so a run of k chunks takes log2(k) steps. An entry that a map lacks is added."""
        chunk, entry = np.concatenate((cut, cut)), np.concatenate([self.run(codes, wide, start[cut] - w, np.full(len(cut), w), np.zeros(len(cut), dtype=np.int64))[0] for w in (warm, warm - warm // 3)])
        first = cut[~np.isin(cut - 1, cut)]  # where runs begin; what comes in is known
        chunk, entry = np.concatenate((chunk, first)), np.concatenate((entry, leave[first - 1]))
        known = np.zeros((0, 4), dtype=np.int64)  # chunk, entry, exit, count
        while True:
            new = np.unique(np.stack((chunk, entry), axis=1), axis=0)
            out, n = self.run(codes, wide, start[new[:, 0]], length[new[:, 0]], new[:, 1])
            known = np.concatenate((known, np.column_stack((new, out, n))))
            known = known[np.lexsort((known[:, 1], known[:, 0]))]
            key = known[:, 0] << 32 | known[:, 1]
            last = ~np.isin(known[:, 0] + 1, cut)
            want = known[:, 0] + 1 << 32 | known[:, 2]
            at = np.minimum(np.searchsorted(key, want), len(key) - 1)
            there = (key[at] == want) & ~last
            to = np.where(there, at, np.arange(len(key)))  # the last and those without a next point to themselves
            reached = np.isin(key, first << 32 | leave[first - 1])
            step = to
            for _ in range(int(len(cut)).bit_length()):
                reached[step[reached]] = True
                step = step[step]
            missing = np.flatnonzero(reached & ~there & ~last)
            if not missing.size:
                counts = np.zeros(len(start), dtype=np.int64)
                counts[known[reached, 0]] = known[reached, 3]
                return counts[cut]
            chunk, entry = known[missing, 0] + 1, known[missing, 2]

    def counts(self, texts: list[str], chunk: int = 256, warm: int = 48) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(texts), dtype=np.int64)
        full = [k for k, t in enumerate(texts) if t]
        if not full:
            return out
        if len(self.states) > self.most_states:
            self.clear()
        whole = "".join(SPACE + texts[k] for k in full).replace(" ", SPACE)
        wide = np.frombuffer(whole.encode("utf-32-le"), dtype="<u4")
        if len(self.by_column) < self.columns:
            for c in np.unique(wide[self.column[wide] == 0]).tolist():
                self.own(chr(c))
        codes = self.column[wide]
        sizes = np.array([len(texts[k]) + 1 for k in full], dtype=np.int64)
        begins = np.cumsum(sizes) - sizes
        space = codes == self.column[ord(SPACE)]
        borders = np.flatnonzero(space & ~np.concatenate(([False], space[:-1])))
        pick = np.searchsorted(borders, np.arange(0, len(codes), chunk))
        known = np.unique(np.concatenate((begins, borders[pick[pick < len(borders)]])))
        ends = np.append(known[1:], len(codes))
        more = np.maximum(0, (ends - known) // chunk - 1)  # forced cuts in a chunk that no border ends in time
        start = np.repeat(known, more + 1)
        turn = np.arange(len(start)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
        start = start + turn * chunk
        length = np.append(start[1:], len(codes)) - start
        whole_run, cut = np.flatnonzero(turn == 0), np.flatnonzero(turn)
        n = np.zeros(len(start), dtype=np.int64)
        leave = np.zeros(len(start), dtype=np.int64)
        zero = np.zeros(len(start), dtype=np.int64)
        leave[whole_run], n[whole_run] = self.run(codes, wide, start[whole_run], length[whole_run], zero[whole_run])
        if cut.size:
            n[cut] = self.composed(codes, wide, start, length, cut, leave, warm)
        of = np.searchsorted(begins, start, side="right") - 1
        out[full] = np.bincount(of, weights=n, minlength=len(full)).astype(np.int64)
        return out


_TRANSDUCERS: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One for each Python worker: what it has compiled serves later tasks too."""
    if path not in _TRANSDUCERS:
        _TRANSDUCERS[path] = Transducer(path)
    return _TRANSDUCERS[path]


def _count(path: str, block_chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            done = 0
            while done < batch.num_rows:
                texts, size = [], 0
                while done < batch.num_rows and size < block_chars:
                    t = batch.column("text")[done].as_py() or ""
                    texts.append(t)
                    size += len(t)
                    done += 1
                ids = batch.column("doc_id").slice(done - len(texts), len(texts))
                yield pa.record_batch([ids, pa.array([len(t.encode()) for t in texts], pa.int64()), machine.counts(texts)], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, *, model: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 1 << 21) -> DataFrame:
    """Per row: doc_id, n_bytes of UTF-8 and n_tokens."""
    ship(docs.sparkSession)
    own = own_columns(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return own.mapInArrow(_count(model, block_chars), "doc_id long, n_bytes long, n_tokens long")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = count_tokens(table(spark, sf_dir, "documents"), model=public_tokenizers.path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)
