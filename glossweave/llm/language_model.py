"""Language-model scores: a log-bilinear word model with a class factor, trained with noise-contrastive estimation.

Words are counted over all training documents by Spark. The ``frequent`` most frequent words (of 64 bytes at most, which bounds
the broadcast) get numbers, and one pass writes every document as an array of numbers; all later passes are numpy over these. Words
with ``LEAST`` occurrences, ``most_vectors`` of them at most, have vectors of their own: as context, and as what is predicted. So the
predicted vocabulary grows with the corpus until that bound. They are clustered by what stands before and after them, and
each cluster is cut by frequency into classes of ``CLASS_WORDS``. All other words belong to a class by their letter pairs; a text's end is a
class of its own.

The prediction from the two words before is the sum of their vectors, each through a matrix of its place. p(word) is
p(class) by a softmax over class vectors times p(word in class) by a softmax over the word vectors of the class; in a class of other words it is
the share of the word's count in the class, with one added to each and one place for all unseen words. So all
probabilities sum to 1. The letter pairs of the classes are counted over all training words, beginning from clusters of the most frequent ones. Training learns every window of all training text against noise from the class counts and from the word counts of the
class. The driver only makes a start, from 1 in ``DRAWN`` tokens (2**18 at least, 2**22 at most). Then in each of ``ROUNDS`` rounds all tasks learn their share of
the text from the same weights, and what they have learnt is averaged by their tokens, so no token is left out. Scoring is batched matrix products in the tasks.

Counts of words beyond the frequent ones are joined, so every count is exact.

Null and empty texts are one end token. Repeated rows are scored each. Very long texts are scored in slices with their whole
context. Without training documents all counts are 0.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.llm.common import in_parts, own_columns, ship, table, written
from glossweave.llm.toxicity import fold

LEAST, AROUND, CLUSTERS, CLASS_WORDS, LETTER_CLASSES, SIZE, DRAWN = 100, 64, 48, 128, 24, 32, 64
ROUNDS = 2
END = b"\n"  # no word holds it
_PAIRS = 4096
#: Tokens scored at once, and rows of a matrix of scores, so that it stays in the cache.
_SLICE, _ROWS = 1 << 17, 1 << 12
#: Bytes of text, and documents, that are split at once.
_OCTETS, _DOCS = 4 << 20, 1 << 10
#: Weights in a row of what a task has learnt.
_CHUNK = 1 << 14


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of all texts one after another, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.binary()).view(pa.string()), ""))))
    words, size = lists.flatten().cast(pa.binary()), np.diff(lists.offsets.to_numpy())
    real = pc.greater(pc.binary_length(words), 0)
    if pc.all(real, min_count=0).as_py():
        return words, size
    # a text without words has given an empty one
    return words.filter(real), size - np.bincount(np.repeat(np.arange(len(size)), size), ~real.to_numpy(zero_copy_only=False), len(size)).astype(size.dtype)


def _list(column: pa.Array) -> list:
    """``column.to_pylist()`` for columns without nulls, several times as fast."""
    return column.to_numpy(zero_copy_only=False).tolist()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows, ends = [], 0, 0
    for part in in_parts(batches, "text", rows=_DOCS, octets=_OCTETS):
        found = split(part.column("text"))[0].value_counts()
        held.append(pa.table([found.field("values"), found.field("counts")], names=["word", "n"]))
        rows, ends = rows + len(found), ends + part.num_rows
        if rows > 1_000_000:
            held = [pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])]
            rows = held[0].num_rows
            if rows > 400_000:
                yield from held[0].to_batches(max_chunksize=50_000)
                held, rows = [], 0
    held.append(pa.table([pa.array([END] if ends else [], pa.binary()), pa.array([ends] if ends else [], pa.int64())], names=["word", "n"]))
    yield from pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"]).to_batches(max_chunksize=50_000)


def letter_pairs(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the letter pairs of all words (one is the word's border), and where each word's begin."""
    raw = np.frombuffer(b"\n" + b"\n".join(words) + b"\n", dtype=np.uint8).astype(np.int64)
    pairs = (raw[:-1] * 61 + raw[1:] * 257) % _PAIRS
    first = np.concatenate(([0], np.cumsum([len(w) + 1 for w in words])[:-1]))
    return pairs, first


def clusters(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means: the cluster of each row."""
    r = np.random.default_rng(seed)
    centres = x[r.choice(len(x), min(k, len(x)), replace=False)].copy()
    own = np.zeros(len(x), dtype=np.int64)
    for _ in range(20):
        own = (x @ centres.T * 2 - (centres**2).sum(axis=1)).argmax(axis=1)
        for j in range(len(centres)):
            if (own == j).any():
                centres[j] = x[own == j].mean(axis=0)
    return own


def letter_classes(words: list[bytes]) -> np.ndarray:
    """Log-probability of each letter pair in each class, from clusters of ``words`` by their letter pairs."""
    if not words:
        return np.zeros((_PAIRS, LETTER_CLASSES))
    pairs, first = letter_pairs(words)
    of = np.repeat(np.arange(len(words)), np.diff(np.append(first, len(pairs))))
    x = np.zeros((len(words), 512))
    np.add.at(x, (of, pairs % 512), 1)
    own = clusters(np.sqrt(x / x.sum(axis=1, keepdims=True)), LETTER_CLASSES, 3)
    n = np.bincount(pairs * LETTER_CLASSES + own[of], minlength=_PAIRS * LETTER_CLASSES).reshape(_PAIRS, LETTER_CLASSES) + 0.02
    return np.log(n / n.sum(axis=0))


def _likeliest(letters: np.ndarray, pairs: np.ndarray, first: np.ndarray, most: int = 32) -> np.ndarray:
    """The class of each word. A word's pairs are added from its first to its last, whatever words stand beside it, so that a word has one class everywhere."""
    size = np.diff(np.append(first, len(pairs)))
    total = np.zeros((len(first), letters.shape[1]))
    turn = np.argsort(-size, kind="stable")
    turn = turn[np.searchsorted(-size[turn], -most) :]
    begin, reach = first[turn], np.searchsorted(-size[turn], -np.arange(most + 1))
    some = np.zeros((len(turn), letters.shape[1]))
    for k in range(most):
        n = reach[k]  # words of more pairs
        some[:n] += np.take(letters, pairs[begin[:n] + k], axis=0)
    total[turn] = some
    if (longer := size > most).any():
        total[longer] = np.add.reduceat(letters[pairs[np.repeat(longer, size)]], np.cumsum(size[longer]) - size[longer], axis=0)
    return total.argmax(axis=1)


def _pairs_in_classes(letters) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """How often each letter pair stands in the words of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_PAIRS * LETTER_CLASSES, dtype=np.int64)
        for batch in batches:
            words = [w for w in _list(batch.column("word")) if w != END]
            for k in range(0, len(words), 20_000):
                pairs, first = letter_pairs(words[k : k + 20_000])
                own = _likeliest(letters.value, pairs, first)
                total += np.bincount(pairs * LETTER_CLASSES + np.repeat(own, np.diff(np.append(first, len(pairs)))), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    return run


def letters_of_all(counts: DataFrame, letters: np.ndarray) -> np.ndarray:
    """``letter_classes`` anew, from the letter pairs of all counted words in the classes that ``letters`` puts them into."""
    cells = counts.select("word").mapInArrow(_pairs_in_classes(counts.sparkSession.sparkContext.broadcast(letters)), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    n = np.full(_PAIRS * LETTER_CLASSES, 0.02)
    n[cells.column("cell").to_numpy()] += cells.column("n").to_numpy()
    n = n.reshape(_PAIRS, LETTER_CLASSES)
    return np.log(n / n.sum(axis=0))


def class_by_letters(letters: np.ndarray, words: list[bytes]) -> np.ndarray:
    out = [np.zeros(0, dtype=np.int64)]
    for k in range(0, len(words), 20_000):
        out.append(_likeliest(letters, *letter_pairs(words[k : k + 20_000])))
    return np.concatenate(out)


#: What this Python worker has built last: the broadcast's value and the places of its words.
_LAST: list = [None, None]

NUMBERED = "uid long, doc_id long, train boolean, ids binary, word binary"


def _number(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents as numbers: of frequent words, then of letter classes, then of the end. And rows of the words without a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        value = shared.value
        if _LAST[0] is not value:
            _LAST[:] = [value, {w: k for k, w in enumerate(value[0])}]
        get, (words, letters) = _LAST[1].get, value
        end = len(words) + LETTER_CLASSES
        uid = TaskContext.get().partitionId() << 36
        for part in in_parts(batches, "text", rows=_DOCS, octets=_OCTETS):
            flat, size = split(part.column("text"))
            size = size.astype(np.int64) + 1
            coded = flat.dictionary_encode()
            distinct = _list(coded.dictionary)
            number = np.fromiter(map(get, distinct, repeat(-1)), dtype=np.int32, count=len(distinct))
            unnumbered = number < 0
            number[unnumbered] = len(words) + class_by_letters(letters, [distinct[k] for k in np.flatnonzero(unnumbered).tolist()])
            code = coded.indices.to_numpy()
            at, other = number[code], np.flatnonzero(unnumbered[code])
            more = coded.dictionary.take(pa.array(code[other]))
            stops = np.cumsum(size)
            ids = np.full(stops[-1], end, dtype=np.int32)
            inside = np.ones(len(ids), dtype=bool)
            inside[stops - 1] = False
            ids[inside] = at
            uids = np.arange(uid, uid + len(size))
            uid += len(size)
            raw = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.concatenate(([0], stops * 4)).astype(np.int32)), pa.py_buffer(ids)])
            names = [x.split()[0] for x in NUMBERED.split(", ")]
            yield pa.record_batch([uids, part.column("doc_id"), part.column("train"), raw, pa.nulls(len(size), pa.binary())], names=names)
            if len(more):
                owner = uids[np.searchsorted(np.cumsum(size - 1), other, side="right")]
                n = len(more)
                yield pa.record_batch([owner, pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.binary()), more], names=names)

    return run


def _numbers(batches: Iterator[pa.RecordBatch], tokens: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows with about so many tokens: the rows, all numbers, and the number of tokens of each row."""
    for batch in batches:
        column = batch.column("ids")
        at = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 4
        ids = np.frombuffer(column.buffers()[2] or b"", dtype=np.int32)
        k = 0
        while k < batch.num_rows:
            to = max(k + 1, int(np.searchsorted(at, at[k] + tokens, side="right")) - 1)
            yield batch.slice(k, to - k), ids[at[k] : at[to]], np.diff(at[k : to + 1])
            k = to


def _context(x: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The places before each of texts in a row, each ended: the one before, and the one before that."""
    one = np.concatenate(([end], x[:-1]))
    return one, np.where(one == end, end, np.concatenate(([end, end], x))[: len(x)])


def _gather(vectors: int, frequent: int, rate: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of the ``AROUND`` most frequent words before and behind each word with a vector; and draws of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(max(1, vectors) * 2 * AROUND, dtype=np.int64)
        end = frequent + LETTER_CLASSES
        for part, ids, _ in _numbers(batches, 1 << 19):
            at = ids.astype(np.int64)
            for w, c, side in ((at[:-1], at[1:], 0), (at[1:], at[:-1], AROUND)):
                own = (w < vectors) & (c < min(AROUND, frequent))
                total += np.bincount(w[own] * 2 * AROUND + side + c[own], minlength=len(total))
            one, two = _context(at, end)
            drawn = np.flatnonzero(np.random.default_rng(part.column("uid")[0].as_py()).random(len(at)) < rate)
            raw = np.stack((two[drawn], one[drawn], at[drawn]), axis=1).astype("<i4").tobytes()
            yield pa.record_batch([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([raw], pa.binary())], names=["cell", "n", "draws"])
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at]), pa.nulls(len(at), pa.binary())], names=["cell", "n", "draws"])

    return run


def _in_classes(letters, vectors) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Tokens and types of each letter class, of the words without vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_, with_vectors = letters.value, set(vectors.value)
        tokens, types = np.zeros(LETTER_CLASSES, dtype=np.int64), np.zeros(LETTER_CLASSES, dtype=np.int64)
        for batch in batches:
            rows = [(w, n) for w, n in zip(_list(batch.column("word")), _list(batch.column("n")), strict=True) if w != END and w not in with_vectors]
            if rows:
                own = class_by_letters(table_, [w for w, _ in rows])
                tokens += np.bincount(own, [n for _, n in rows], LETTER_CLASSES).astype(np.int64)
                types += np.bincount(own, minlength=LETTER_CLASSES)
        yield pa.record_batch([np.arange(LETTER_CLASSES), tokens, types], names=["class", "tokens", "types"])

    return run


class Adam:
    def __init__(self, weights: dict[str, np.ndarray], rate: float, steps: int):
        self.w, self.rate, self.steps, self.step = weights, rate, steps, 0
        self.m, self.v = ({k: np.zeros_like(a) for k, a in weights.items()} for _ in range(2))

    def update(self, gradients: dict[str, np.ndarray]) -> None:
        self.step += 1
        slow = self.rate * min(1.0, 2 * (1 - self.step / (self.steps + 1)))
        for k, g in gradients.items():  # in place, as there is a step for each few thousand tokens
            m, v = self.m[k], self.v[k]
            by = np.square(g)
            by -= v
            by *= 0.01
            v += by
            np.subtract(g, m, out=by)
            by *= 0.1
            m += by
            np.sqrt(v, out=by)
            by *= 1 / (1 - 0.99**self.step) ** 0.5
            by += 1e-8
            np.divide(m, by, out=by)
            by *= slow / (1 - 0.9**self.step)
            self.w[k] -= by


def _sums(at: np.ndarray, rows: np.ndarray, n: int, few: int = 32) -> np.ndarray:
    """For each of ``n`` places the sum of the rows that belong to it: the first rows of all places, then the second ones, and so on; what places have beyond ``few``, place by place."""
    out = np.zeros((n, *rows.shape[1:]), dtype=rows.dtype)
    if len(at):
        order = np.argsort(at.astype(np.uint16) if n <= 1 << 16 else at, kind="stable")
        first = np.flatnonzero(np.diff(at[order], prepend=-1))
        size = np.diff(np.append(first, len(at)))
        turn = np.argsort(-size, kind="stable")
        first, size = first[turn], size[turn]
        reach = np.searchsorted(-size, -np.arange(few + 1))
        total = np.take(rows, order[first], axis=0)
        for k in range(1, few):
            if more := reach[k]:  # places with more rows
                total[:more] += np.take(rows, order[first[:more] + k], axis=0)
        for k in range(reach[few]):
            total[k] += np.take(rows, order[first[k] + few : first[k] + size[k]], axis=0).sum(axis=0)
        out[at[order[first]]] = total
    return out


class Model:
    """``around``: a row of neighbour counts for each word with a vector. ``counts``: of the numbered words, the most frequent first.

    A number is a frequent word, a letter class or the end; ``x`` is its place as context, ``y`` its class, and ``slot`` its
    place among the word vectors, which stand class by class from ``start``."""

    def __init__(self, around: np.ndarray, counts: np.ndarray, by_letters: np.ndarray, tokens: np.ndarray, types: np.ndarray, ends: int):
        k, frequent = len(around), len(counts)
        own = clusters(np.sqrt(around / np.maximum(around.sum(axis=1, keepdims=True), 1)), CLUSTERS, 3) if k else np.zeros(0, dtype=np.int64)
        order = np.lexsort((np.arange(k), own))
        rank = np.zeros(k, dtype=np.int64)
        rank[order] = np.arange(k) - np.searchsorted(own[order], own[order])
        _, classes = np.unique(own * (k + 1) + rank // CLASS_WORDS, return_inverse=True)
        self.word_classes = int(classes.max()) + 1 if k else 0
        order = np.argsort(classes, kind="stable")
        self.start = np.searchsorted(classes[order], np.arange(self.word_classes + 1))
        self.slot = np.full(frequent + LETTER_CLASSES + 1, -1)
        self.slot[order] = np.arange(k)
        others = np.concatenate((by_letters[k:], np.arange(LETTER_CLASSES), [LETTER_CLASSES])).astype(np.int64)
        self.x = np.concatenate((np.arange(k), k + others))
        self.y = np.concatenate((classes, self.word_classes + others))
        self.end = k + LETTER_CLASSES
        places = np.log10(np.append(tokens + types + 1.0, 1.0))
        own_count = np.log10(np.concatenate((counts[k:] + 1.0, np.ones(LETTER_CLASSES + 1))))
        self.extra = np.concatenate((np.zeros(k), own_count - places[others]))
        n = np.concatenate((counts, np.maximum(tokens - np.bincount(by_letters[k:], counts[k:], LETTER_CLASSES), 0), [ends]))
        self.class_n = np.bincount(self.y, n, self.word_classes + LETTER_CLASSES + 1) + 0.5
        word_n = counts[order] + 1.0
        self.word_q = word_n / np.repeat(np.add.reduceat(word_n, self.start[:-1]), np.diff(self.start)) if k else word_n
        r = np.random.default_rng(4)
        f = np.float32
        self.w = {
            "in": r.normal(0, 0.1, (self.end + 1, SIZE)).astype(f), "m1": (np.eye(SIZE) + r.normal(0, 0.05, (SIZE, SIZE))).astype(f), "m2": (0.5 * np.eye(SIZE) + r.normal(0, 0.05, (SIZE, SIZE))).astype(f),
            "out": r.normal(0, 0.1, (len(self.class_n), SIZE)).astype(f), "b": np.log(self.class_n / self.class_n.sum()).astype(f), "word": r.normal(0, 0.1, (k, SIZE)).astype(f), "word_b": np.log(self.word_q).astype(f),
        }

    def fit(self, draws: np.ndarray, *, least_steps: int = 600, batch: int = 4096, noise: int = 16, word_noise: int = 8, rate: float = 0.02) -> None:
        """``draws``: rows of two numbers before and a number."""
        if not len(draws):
            return
        r, w = np.random.default_rng(5), self.w
        steps = max(least_steps, len(draws) // batch)
        adam = Adam(w, rate, steps)
        q = self.class_n / self.class_n.sum()
        shift, cum = np.log(noise * q).astype(np.float32), np.cumsum(q)
        word_shift, word_cum = np.log(word_noise * self.word_q).astype(np.float32), np.cumsum(self.word_q)
        two, one, this, slots = self.x[draws[:, 0]], self.x[draws[:, 1]], self.y[draws[:, 2]], self.slot[draws[:, 2]]
        turn = r.permutation(len(draws))
        for step in range(steps):
            own = turn[np.arange(step * batch, (step + 1) * batch) % len(turn)]
            a, b, y, s = one[own], two[own], this[own], slots[own]
            x1, x2 = w["in"][a], w["in"][b]
            guess = x1 @ w["m1"] + x2 @ w["m2"]
            # classes: the true one against noise ones
            every = np.concatenate((y[:, None], np.minimum(np.searchsorted(cum, r.random((batch, noise))), len(q) - 1)), axis=1)
            score = np.take_along_axis(guess @ w["out"].T + w["b"], every, axis=1)
            d = 1 / (1 + np.exp(np.clip(shift[every] - score, -60, 60)))
            d[:, 0] -= 1  # gradient of the noise-contrastive loss
            full = np.bincount((np.arange(batch)[:, None] * len(q) + every).ravel(), d.ravel() / batch, batch * len(q)).reshape(batch, -1).astype(np.float32)
            dg = full @ w["out"]
            g = {"out": full.T @ guess, "b": full.sum(axis=0)}
            # words of the class, likewise
            if len(at := np.flatnonzero(s >= 0)):
                base = np.where(self.start[y[at]] > 0, word_cum[self.start[y[at]] - 1], 0.0)
                pick = np.searchsorted(word_cum, base[:, None] + r.random((len(at), word_noise)))
                pick = np.clip(pick, self.start[y[at]][:, None], self.start[y[at] + 1][:, None] - 1)
                every = np.concatenate((s[at][:, None], pick), axis=1)
                vectors = w["word"][every]
                score = np.einsum("nkd,nd->nk", vectors, guess[at]) + w["word_b"][every]
                d = 1 / (1 + np.exp(np.clip(word_shift[every] - score, -60, 60)))
                d[:, 0] -= 1
                d = (d / batch).astype(np.float32)
                dg[at] += np.einsum("nk,nkd->nd", d, vectors)
                g["word"] = _sums(every.ravel(), (d[:, :, None] * guess[at][:, None, :]).reshape(-1, SIZE), len(w["word"]))
                g["word_b"] = np.bincount(every.ravel(), d.ravel(), len(w["word"])).astype(np.float32)
            g |= {"m1": x1.T @ dg, "m2": x2.T @ dg, "in": _sums(np.concatenate((a, b)), np.concatenate((dg @ w["m1"].T, dg @ w["m2"].T)), len(w["in"]))}
            adam.update(g)

    def learner(self, steps: int, rate: float) -> tuple["Model", "Adam"]:
        """A copy with weights of its own and what updates them; this one may be shared by tasks."""
        own = copy.copy(self)
        own.w = {k: a.copy() for k, a in self.w.items()}
        return own, Adam(own.w, rate, steps)

    def gradients(self, r: np.random.Generator, two: np.ndarray, one: np.ndarray, ids: np.ndarray, *, batch: int, noise: int = 16, word_noise: int = 4) -> dict[str, np.ndarray]:
        """Of the noise-contrastive loss of tokens (context places and numbers), by ``batch``; they share the noise, so that the work is matrix products."""
        w, k, classes = self.w, len(self.w["word"]), len(self.class_n)
        key = np.where(self.slot[ids] >= 0, self.slot[ids], k + self.y[ids] - self.word_classes)
        turn = np.argsort(key.astype(np.uint16) if k + classes <= 1 << 16 else key, kind="stable")  # class by class, word by word
        one, two, key, y = one[turn], two[turn], key[turn], self.y[ids[turn]]
        guess = np.take(w["in"] @ w["m1"], one, axis=0)
        guess += np.take(w["in"] @ w["m2"], two, axis=0)
        f, by = np.float32, np.float32(1 / batch)

        def right(score: np.ndarray, shift: np.ndarray) -> np.ndarray:
            score -= shift
            np.exp(np.negative(np.clip(score, -60, 60, out=score), out=score), out=score)
            score += 1
            return np.reciprocal(score, out=score)

        # classes against noise ones
        q = self.class_n / self.class_n.sum()
        shift = np.log(noise * q).astype(f)
        drawn = np.minimum(np.searchsorted(np.cumsum(q), r.random(noise)), classes - 1)
        vectors = w["out"][drawn]
        d = right(guess @ vectors.T, shift[drawn] - w["b"][drawn])
        d *= by
        dg = d @ vectors
        g = {"out": _sums(drawn, d.T @ guess, classes), "b": np.bincount(drawn, d.sum(axis=0), classes).astype(f)}
        # the true class, and noise words of it, by one product for each class; all else for all tokens at once
        word_shift, cum = np.log(word_noise * self.word_q).astype(f), np.cumsum(self.word_q)
        bounds = np.searchsorted(y, np.arange(classes + 1))
        found = np.flatnonzero(np.diff(bounds))
        m = int(np.searchsorted(found, self.word_classes))  # classes of words with vectors come first
        n = int(bounds[self.word_classes])
        lo, hi = self.start[found[:m]], self.start[found[:m] + 1]
        words = np.clip(np.searchsorted(cum, np.where(lo > 0, cum[lo - 1], 0.0)[:, None] + r.random((m, word_noise))), lo[:, None], hi[:, None] - 1) if m else np.zeros((0, word_noise), dtype=np.int64)
        vectors, less = np.zeros((len(found), 1 + word_noise, SIZE), dtype=f), np.zeros((len(found), 1 + word_noise), dtype=f)
        vectors[:, 0], less[:, 0] = w["out"][found], shift[found] - w["b"][found]
        vectors[:m, 1:], less[:m, 1:] = w["word"][words], word_shift[words] - w["word_b"][words]
        parts = [slice(x, z) for x, z in zip(bounds[found].tolist(), bounds[found + 1].tolist(), strict=True)]
        d = np.empty((len(y), 1 + word_noise), dtype=f)
        for j, part in enumerate(parts):
            np.matmul(guess[part], vectors[j].T, out=d[part])
        d = right(d, np.repeat(less, np.diff(bounds)[found], axis=0))
        d[:, 0] -= 1
        d[n:, 1:] = 0
        d *= by
        more, of = np.empty_like(guess), np.empty_like(vectors)
        for j, part in enumerate(parts):
            np.matmul(d[part], vectors[j], out=more[part])
            np.matmul(d[part].T, guess[part], out=of[j])
        dg += more
        sums = np.add.reduceat(d, bounds[found], axis=0) if len(found) else d
        g["out"][found] += of[:, 0]
        g["b"][found] += sums[:, 0]
        g["word"] = _sums(words.ravel(), of[:m, 1:].reshape(-1, SIZE), k)
        g["word_b"] = np.bincount(words.ravel(), sums[:m, 1:].ravel(), k).astype(f)
        if n:
            own, s = guess[:n], key[:n]
            mine = np.take(w["word"], s, axis=0)
            t = (right(np.einsum("nd,nd->n", own, mine) + w["word_b"][s], word_shift[s]) - 1) * by
            mine *= t[:, None]
            dg[:n] += mine
            g["word"] += _sums(s, np.multiply(own, t[:, None], out=mine), k)
            g["word_b"] += np.bincount(s, t, k).astype(f)
        # the contexts' vectors and their matrices
        of_one, of_two = _sums(one, dg, len(w["in"])), _sums(two, dg, len(w["in"]))
        return g | {"m1": w["in"].T @ of_one, "m2": w["in"].T @ of_two, "in": of_one @ w["m1"].T + of_two @ w["m2"].T}

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.w.values()])

    def move(self, by: np.ndarray) -> None:
        at = 0
        for a in self.w.values():
            a += by[at : at + a.size].reshape(a.shape).astype(a.dtype)
            at += a.size

    def start_scoring(self) -> None:
        self.one, self.two = self.w["in"] @ self.w["m1"], self.w["in"] @ self.w["m2"]
        self.exp_b, self.exp_word_b = np.exp(self.w["b"]), np.exp(self.w["word_b"])

    def log10(self, two: np.ndarray, one: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Of tokens, by their numbers and their context places; for words without a number, of one that isn't counted."""
        w, y = self.w, self.y[ids]
        order = np.argsort(y.astype(np.uint16) if len(self.class_n) <= 1 << 16 else y, kind="stable")
        ids, y = ids[order], y[order]
        guess = np.take(self.one, one[order], axis=0)
        guess += np.take(self.two, two[order], axis=0)
        logs = np.zeros(len(ids))
        room = np.empty(_ROWS * max(len(self.class_n), *np.diff(self.start), 1), dtype=guess.dtype)

        def add(lo: int, hi: int, vectors: np.ndarray, bias: np.ndarray, exp_bias: np.ndarray, true: np.ndarray) -> None:
            plain = len(bias) and abs(bias.max()) < 20
            for k in range(lo, hi, _ROWS):
                to = min(hi, k + _ROWS)
                score, own = room[: (to - k) * len(bias)].reshape(to - k, -1), true[k - lo : to - lo]
                np.matmul(guess[k:to], vectors.T, out=score)
                logs[k:to] += score[np.arange(to - k), own] + bias[own]
                if plain and score.max() < 60 and score.min() > -60:  # no exponential overflows or vanishes
                    logs[k:to] -= np.log(np.exp(score, out=score) @ exp_bias)
                else:
                    score += bias
                    top = score.max(axis=1)
                    score -= top[:, None]
                    logs[k:to] -= top + np.log(np.exp(score, out=score).sum(axis=1))

        add(0, len(ids), w["out"], w["b"], self.exp_b, y)
        bounds = np.searchsorted(y, np.arange(self.word_classes + 1))
        for c in np.flatnonzero(np.diff(bounds)).tolist():
            own = slice(self.start[c], self.start[c + 1])
            add(bounds[c], bounds[c + 1], w["word"][own], w["word_b"][own], self.exp_word_b[own], self.slot[ids[bounds[c] : bounds[c + 1]]] - self.start[c])
        out = np.empty(len(ids))
        out[order] = logs / np.log(10) + self.extra[ids]
        return out


LEARNT = "chunk int, uid long, tokens long, moved binary"


def _learn(shared, turn: int, tokens: int, rate: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """How far a task's share of a round's text moves the weights, and how many tokens that is. ``tokens``: of a task, about."""
    batch = min(1 << 15, max(1 << 12, tokens // 32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, adam = shared.value.learner(max(8, tokens // batch), rate)
        first, n = None, 0
        for k, (part, ids, _) in enumerate(_numbers(batches, batch)):
            if k % ROUNDS != turn:
                continue
            first = part.column("uid")[0].as_py() if first is None else first
            r = np.random.default_rng((first, turn, k))
            one, two = _context(model.x[ids], model.end)
            for x in range(0, len(ids), batch):
                own = slice(x, x + batch)
                adam.update(model.gradients(r, two[own], one[own], ids[own], batch=batch))
            n += len(ids)
        if n:
            moved = model.flat() - shared.value.flat()
            for k, x in enumerate(range(0, len(moved), _CHUNK)):
                yield pa.record_batch([pa.array([k], pa.int32()), pa.array([first]), pa.array([n]), pa.array([moved[x : x + _CHUNK].tobytes()], pa.binary())], names=["chunk", "uid", "tokens", "moved"])

    return run


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean of each chunk by tokens; rows come by chunk."""
    chunk, total, n = None, np.zeros(0), 0

    def mean() -> pa.RecordBatch:
        return pa.record_batch([pa.array([chunk], pa.int32()), pa.array([n]), pa.array([(total / n).astype("<f4").tobytes()], pa.binary())], names=["chunk", "tokens", "moved"])

    for batch in batches:
        for k, tokens, raw in zip(*(batch.column(c).to_pylist() for c in ("chunk", "tokens", "moved")), strict=True):
            if k != chunk:
                if n:
                    yield mean()
                chunk, total, n = k, np.zeros(len(raw) // 4), 0
            total += np.frombuffer(raw, dtype="<f4").astype(float) * tokens
            n += tokens
    if n:
        yield mean()


def learn_all(model: Model, texts: DataFrame, n_all: int, *, rate: float = 0.008) -> int:
    """``texts`` (uid, ids) of all training documents, each token learnt once. Gives how many that were."""
    spark, learnt = texts.sparkSession, 0
    share = -(-n_all // max(1, texts.rdd.getNumPartitions()))
    for turn in range(ROUNDS):
        moved = texts.mapInArrow(_learn(spark.sparkContext.broadcast(model), turn, share // ROUNDS, rate), LEARNT)
        means = moved.repartition("chunk").sortWithinPartitions("chunk", "uid").mapInArrow(_average, "chunk int, tokens long, moved binary").toArrow().sort_by("chunk")
        if means.num_rows:
            model.move(np.frombuffer(b"".join(means.column("moved").to_pylist()), dtype="<f4"))
            learnt += means.column("tokens")[0].as_py()
    return learnt


SCORED = "uid long, doc_id long, n long, known long, counted double, model double"


def _score(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, log_count, known = shared.value
        model.start_scoring()
        for part, ids, size in _numbers(batches, 1 << 17):
            one, two = _context(model.x[ids], model.end)
            by_token = np.concatenate([model.log10(two[k : k + _SLICE], one[k : k + _SLICE], ids[k : k + _SLICE]) for k in range(0, len(ids), _SLICE)])
            first = np.cumsum(size) - size
            found = [part.column("uid"), part.column("doc_id"), size, np.add.reduceat(known[ids], first), np.add.reduceat(log_count[ids], first), np.add.reduceat(by_token, first)]
            yield pa.record_batch(found, names=[x.split()[0] for x in SCORED.split(", ")])

    return run


def language_model_scores(docs: DataFrame, train_on, *, id_col: str = "doc_id", text_col: str = "text", frequent: int = 1 << 18, most_vectors: int = 8192) -> DataFrame:
    """``train_on``: a condition on a row of (doc_id, text). Per row: doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    ship(spark)
    send = spark.sparkContext.broadcast
    train_on = F.expr(train_on) if isinstance(train_on, str) else train_on
    own = own_columns(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("train", F.coalesce(train_on, F.lit(False)))
    counts = written(own.filter("train").drop("train").mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.max(F.when(F.col("word") == F.lit(END), F.col("n"))).alias("ends")).first()
    n_all, v_all, ends = total["n"] or 0, total["v"], total["ends"] or 0
    top = counts.filter((F.octet_length("word") <= 64) & (F.col("word") != F.lit(END))).orderBy(F.desc("n"), "word").limit(frequent).toArrow()  # the bound
    words, n = top.column("word").to_pylist(), top.column("n").to_numpy().astype(float)
    letters = letters_of_all(counts, letter_classes(words[:4096])) if words else letter_classes(words)
    vectors = min(int((n >= LEAST).sum()), most_vectors)
    numbered = written(own.mapInArrow(_number(send((words, letters))), NUMBERED))
    texts = numbered.filter("word IS NULL")
    rate = min(1.0, max(1 << 18, min(1 << 22, n_all // DRAWN)) / max(1, n_all))
    gathered = written(texts.filter("train").select("uid", "ids").mapInArrow(_gather(vectors, len(words), rate), "cell long, n long, draws binary"))
    cells = gathered.filter("draws IS NULL").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    around = np.zeros(max(1, vectors) * 2 * AROUND)
    around[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    drawn = gathered.filter("draws IS NOT NULL").select("draws").toArrow().column("draws").to_pylist()
    draws = np.frombuffer(b"".join(sorted(drawn)), dtype="<i4").reshape(-1, 3)
    in_class = counts.mapInArrow(_in_classes(send(letters), send(words[:vectors])), "class long, tokens long, types long").groupBy("class").agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).orderBy("class").toPandas()
    tokens, types = (np.zeros(LETTER_CLASSES) + (in_class[c].to_numpy(dtype=float) if len(in_class) else 0) for c in ("tokens", "types"))
    model = Model(around.reshape(-1, 2 * AROUND)[:vectors], n, class_by_letters(letters, words), tokens, types, ends)
    model.fit(draws)
    learn_all(model, texts.filter("train").select("uid", "ids"), n_all)
    place = len(words) + LETTER_CLASSES
    log_count, known = np.zeros(place + 1), np.zeros(place + 1, dtype=np.int64)
    log_count[: len(words)], known[: len(words)] = np.log10(n + 1), 1
    log_count[place], known[place] = np.log10(ends + 1), ends > 0
    scored = written(texts.select("uid", "doc_id", "ids").mapInArrow(_score(send((model, log_count, known))), SCORED))
    rare = numbered.filter("word IS NOT NULL").select("uid", "word").join(counts, "word")
    rare = rare.groupBy("uid").agg(F.sum(F.log10(F.col("n") + 1)).alias("more"), F.count("*").alias("more_known"))
    more, more_known = F.coalesce("more", F.lit(0.0)), F.coalesce("more_known", F.lit(0))
    return scored.join(rare, "uid", "left").select(
        "doc_id", F.col("n").alias("n_tokens"), (F.col("known") + more_known).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("counted") + more - F.col("n") * F.lit(float(np.log10(n_all + v_all + 1)))).alias("base_score"), (F.col("model") + more).alias("score"),
    )


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(fold(F.col("doc_id"), 7) == 2, F.lit(False))
    found = language_model_scores(table(spark, sf_dir, "documents"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
