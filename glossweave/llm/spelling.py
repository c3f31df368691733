"""Spelling variants: words of a corpus that one inserted, deleted or replaced letter parts, by FM-index search schemes.

Words are counted over the whole corpus first; what remains is a vocabulary. A word of which one letter is wrong is right in
its left or in its right half, so the search scheme has two parts: match one half exactly, then extend across the other, allowing one
error. The two directions of the index lie in different shards. Words with the same first three letters share a shard of one direction,
where left halves are matched and extended to the right; words with the same last three share one of the other, where right halves are extended
to the left. Words of six letters and more have halves of three at least, so a word meets all its near words in these two places.

An index is the delimited vocabulary of a shard in suffix order: its last column, and for every letter the rows that it precedes. A step from an interval of
suffix ranks to the next is two binary searches, made for many words at once; a delimiter at the end of a match gives the word's number.

Shards are measured. One beyond ``most_chars`` is cut into blocks of words, and each block of queries goes to each block of the index, so
no group outgrows a task, and no pairs leave it: a task gives each word's count of near words and its best one.

Null texts have no words. A null doc_id is read as an empty string. Rows that repeat a doc_id count each. Empty tables give no rows; other columns of the table aren't read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.llm.common import forget, own_columns, ship, table, written
from glossweave.llm.sql import crc32, folded

#: Letters of a shard's words, on average, and at most; a letter takes some 60 bytes while an index is built.
SHARD_CHARS, MOST_CHARS = 1 << 18, 1 << 20
#: Words searched for at once, and words that a task counts before it gives the counts away.
TOGETHER, HELD = 1 << 13, 1 << 18
LEAST_LETTERS = 6

_RUN = re.compile("[a-zÀ-ÿ]+")


class Direction:
    """Words in suffix order, searched from their ends to their beginnings."""

    def __init__(self, words: list[str]):
        """``words``: sorted and distinct."""
        self.k = len(words)
        text = np.frombuffer(("\n".join(words) + "\n").encode("utf-32-le"), dtype=np.uint32)
        self.letters, code = np.unique(text, return_inverse=True)  # a delimiter has code 0
        n = len(code)
        # a delimiter is less than any letter, and delimiters are in the order of their words, so no suffix is compared beyond one
        rank = code + self.k
        ends = np.flatnonzero(code == 0)
        rank[ends] = np.arange(self.k)
        rank = np.unique(rank, return_inverse=True)[1]
        step = 1
        while rank.max() < n - 1:
            beyond = np.zeros(n, dtype=np.int64)
            beyond[:-step] = rank[step:] + 1
            rank = np.unique(rank * (n + 1) + beyond, return_inverse=True)[1]
            step *= 2
        self.last = np.empty(n, dtype=np.int64)
        self.last[rank] = code[np.arange(n) - 1]
        rows = np.argsort(self.last, kind="stable")
        self.n, self.rows = n, self.last[rows] * n + rows

    def before(self, letter: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of matches that ``letter`` precedes; of letters below 0, none."""
        known = letter >= 0
        base = np.where(known, letter, 0) * self.n
        lo, hi = np.searchsorted(self.rows, base + lo), np.searchsorted(self.rows, base + hi)
        return lo, np.where(known, hi, lo)

    def letters_before(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which letters precede the matches of each interval: numbers of intervals, and letters."""
        size, alphabet = hi - lo, len(self.letters)
        few = np.flatnonzero((size > 0) & (size <= alphabet))
        at = np.repeat(few, size[few])
        place = np.arange(len(at)) - np.repeat(np.cumsum(size[few]) - size[few], size[few])
        met = np.unique(at * alphabet + self.last[lo[at] + place])
        many = np.flatnonzero(size > alphabet)
        every = (many[:, None] * alphabet + np.arange(alphabet)).ravel()
        both = np.concatenate((met, every))
        both = both[both % alphabet > 0]
        return both // alphabet, both % alphabet

    def near(self, words: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a searched word and an indexed one that end in the same ``exact`` letters and differ by one error before them. A pair comes once."""
        size = np.array([len(w) for w in words], dtype=np.int64)
        flat = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        place = np.minimum(np.searchsorted(self.letters, flat), len(self.letters) - 1)
        flat = np.where(self.letters[place] == flat, place, -1)
        end = np.cumsum(size)
        query = np.arange(len(words))  # matched without an error so far
        lo, hi = np.zeros(len(words), dtype=np.int64), np.full(len(words), self.k)
        one = [np.zeros(0, dtype=np.int64)] * 3  # matched with one error: query, interval
        found = []
        step = 0
        while len(query) or len(one[0]):
            may = np.flatnonzero(step >= exact[query])
            at, letter = self.letters_before(lo[may], hi[may])
            at = may[at]
            a, b = self.before(letter, lo[at], hi[at])
            live = a < b
            at, letter, a, b = at[live], letter[live], a[live], b[live]
            one = [np.concatenate(x) for x in zip(one, (query[at], a, b), strict=True)]  # a letter more
            done = size[one[0]] == step
            first, last = self.before(np.zeros(done.sum(), dtype=np.int64), one[1][done], one[2][done])
            whole = first < last
            found.append(one[0][done][whole] * self.k + first[whole])
            one = [x[~done] for x in one]
            wanted = flat[end[one[0]] - 1 - step]
            one[1:] = self.before(wanted, *one[1:])
            own = step < size[query[at]]
            at, letter, a, b = at[own], letter[own], a[own], b[own]
            other = flat[end[query[at]] - 1 - step] != letter
            short = may[step < size[query[may]]]
            one = [np.concatenate(x) for x in zip(one, (query[at][other], a[other], b[other]), (query[short], lo[short], hi[short]), strict=True)]  # another letter; a letter less
            live = one[1] < one[2]
            one = [x[live] for x in one]
            go = size[query] > step
            query, lo, hi = query[go], lo[go], hi[go]
            lo, hi = self.before(flat[end[query] - 1 - step], lo, hi)
            live = lo < hi
            query, lo, hi = query[live], lo[live], hi[live]
            step += 1
        both = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
        return both // self.k, both % self.k


def _searched(group: pa.Table) -> pa.Table:
    """Of one shard (or a block of queries and one of the index): each query's near words found here, counted, and the best."""
    side = group.column("side")[0].as_py()
    words, n, role = group.column("word").to_pylist(), group.column("n").to_numpy(), group.column("role").to_numpy()
    turned = [w[::-1] for w in words] if side else words
    indexed = sorted(np.flatnonzero(role & 1).tolist(), key=turned.__getitem__)
    queries = np.flatnonzero(role & 2).tolist()
    out: list[list] = [[], [], [], []]
    if indexed:
        index = Direction([turned[i] for i in indexed])
        order = np.empty(len(indexed), dtype=np.int64)
        order[sorted(range(len(indexed)), key=lambda i: words[indexed[i]])] = np.arange(len(indexed))
        count = n[indexed]
        for x in range(0, len(queries), TOGETHER):
            own = queries[x : x + TOGETHER]
            half = np.array([len(words[i]) // 2 for i in own])
            exact = half if side else np.array([len(words[i]) for i in own]) - half
            q, found = index.near([turned[i] for i in own], exact)
            if not side:  # with the same left half, the other direction has the pair
                fresh = [words[own[a]][: half[a]] != words[indexed[b]][: half[a]] for a, b in zip(q.tolist(), found.tolist(), strict=True)]
                fresh = np.array(fresh, dtype=bool)
                q, found = q[fresh], found[fresh]
            best = np.lexsort((order[found], -count[found], q))
            q, found = q[best], found[best]
            head = np.flatnonzero(np.diff(q, prepend=-1))
            out[0] += [words[own[i]] for i in q[head]]
            out[1] += np.diff(np.append(head, len(q))).tolist()
            out[2] += count[found[head]].tolist()
            out[3] += [words[indexed[i]] for i in found[head]]
    return pa.table({"word": pa.array(out[0], pa.string()), "n_near": pa.array(out[1], pa.int64()), "best_n": pa.array(out[2], pa.int64()), "best": pa.array(out[3], pa.string())})


def near_words(vocabulary: DataFrame, *, shard_chars: int = SHARD_CHARS, most_chars: int = MOST_CHARS) -> DataFrame:
    """Of a table (word, n) of distinct words of six letters and more: each word that has near words, their number, and the one of largest n (ties: the smallest)."""
    ship(vocabulary.sparkSession)
    chars = vocabulary.agg(F.sum(F.length("word") + 1).alias("chars")).first()["chars"] or 0
    shards = -(-chars // shard_chars) or 1
    ends = F.array(*(F.struct(F.lit(k).alias("side"), F.pmod(F.xxhash64(part), F.lit(shards)).alias("shard")) for k, part in enumerate((F.expr("right(word, 3)"), F.expr("left(word, 3)")))))
    placed = vocabulary.select("word", "n", F.explode(ends).alias("at")).select("word", "n", "at.side", "at.shard")
    blocks = placed.groupBy("side", "shard").agg(F.ceil(F.sum(F.length("word") + 1) / most_chars).alias("blocks"))
    # one row for each shard: their number is the vocabulary's size over a shard's
    own = placed.join(F.broadcast(blocks), ["side", "shard"]).withColumn("own", F.pmod(F.xxhash64("word", F.lit(1)), "blocks"))
    met = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: _places(F.col("own"), j))
    groups = own.select("side", "shard", "word", "n", F.explode(F.flatten(met)).alias("m")).select("side", "shard", "m.indexed", "m.asked", "m.role", "word", "n")
    found = groups.groupBy("side", "shard", "indexed", "asked").applyInArrow(_searched, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.n")).alias("best_n"), F.col("best.word").alias("best"))


def _places(own: Column, j: Column) -> Column:
    """Where a word of block ``own`` meets block ``j``: once in its own, else once in the index and once among the queries."""

    def place(indexed: Column, asked: Column, role: int) -> Column:
        return F.struct(indexed.alias("indexed"), asked.alias("asked"), F.lit(role).alias("role"))

    return F.when(own == j, F.array(place(own, own, 3))).otherwise(F.array(place(own, j, 1), place(j, own, 2)))


def _counted(damage: int):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def given() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if not text:
                    continue
                head = zlib.crc32(f"{doc}:".encode())
                for run, n in Counter(_RUN.findall(text.lower().decode())).items():  # of bytes, only A-Z have a lower case
                    h = zlib.crc32(run.encode(), head)
                    if damage and h % damage == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                    held[run] += n
                if len(held) > HELD:
                    yield given()
        yield given()

    return counted


def word_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", damage: int = 199) -> DataFrame:
    """All words and how often they occur: maximal runs of Latin letters, A-Z as a-z. Of a run whose hash ``damage`` divides, one letter is deleted first; 0 deletes none."""
    ship(docs.sparkSession)
    own = own_columns(docs, doc=id_col, text=text_col).withColumn("doc", F.coalesce(F.col("doc").cast("string"), F.lit("")))
    return own.mapInArrow(_counted(damage), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def variant_groups(counts: DataFrame, *, least_n: int = 5, ratio: int = 5, shard_chars: int = SHARD_CHARS, most_chars: int = MOST_CHARS) -> DataFrame:
    """Of a table (word, n): words of six letters and ``least_n`` occurrences, with their form, root and numbers.

    A word's form is its most frequent near word, if that has ``ratio`` times its occurrences. Counts grow by that along a chain of forms, so
    chains are short, and pointers are doubled until they end: a chain of 16 words takes four rounds.
    """
    vocabulary = written(counts.filter((F.col("n") >= least_n) & (F.length("word") >= LEAST_LETTERS)))
    near = near_words(vocabulary, shard_chars=shard_chars, most_chars=most_chars)
    formed = F.col("best_n") >= ratio * F.col("n")
    forms = written(
        vocabulary.join(near, "word", "left")
        .select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n"))
    )
    # up: the word that a pointer has reached; only words with a form point anywhere
    ups = written(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("up")))
    while True:
        further = _salted(ups)
        more = ups.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(8))).join(further, ["up", "salt"], "left")
        after = written(more.select("word", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")))
        moved = not after.filter("moved").isEmpty()
        forget(ups)
        ups = after
        if not moved:
            break
    return forms.join(ups.select("word", F.col("up").alias("root")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _salted(ups: DataFrame) -> DataFrame:
    """Where each pointing word points, eight times: the form of a third of all words is eight keys."""
    return ups.select(F.col("word").alias("up"), F.col("up").alias("next"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("salt"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_groups(word_counts(table(spark, sf_dir, "documents")))


OP11_SQL = f"""
WITH RECURSIVE run AS (SELECT doc_id, unnest(regexp_extract_all({folded("text")}, '[a-zÀ-ÿ]+')) AS run FROM documents),
each_run AS (SELECT run, n, {crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")}::BIGINT AS h FROM (SELECT doc_id, run, count(*) AS n FROM run GROUP BY doc_id, run)),
counted AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, sum(n)::BIGINT AS n
  FROM each_run GROUP BY 1),
v AS (SELECT word, n FROM counted WHERE length(word) >= {LEAST_LETTERS} AND n >= 5),
place AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
gap AS (SELECT word, n, left(word, i - 1) || '*' || substr(word, i + 1) AS other, left(word, i - 1) || substr(word, i + 1) AS less FROM place),
pair AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM gap a JOIN gap b ON a.other = b.other AND a.word <> b.word
  UNION SELECT a.word, a.n, v.word, v.n FROM gap a JOIN v ON a.less = v.word
  UNION SELECT v.word, v.n, a.word, a.n FROM gap a JOIN v ON a.less = v.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pair GROUP BY word),
found AS (
  SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 5 * v.n THEN near END AS form, CASE WHEN near_n >= 5 * v.n THEN near_n END AS form_n
  FROM v LEFT JOIN best USING (word)),
chain AS (SELECT word, form AS up, 1 AS d FROM found WHERE form IS NOT NULL UNION ALL SELECT c.word, f.form, d + 1 FROM chain c JOIN found f ON f.word = c.up WHERE f.form IS NOT NULL),
root AS (SELECT word, arg_max(up, d) AS root FROM chain GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM found LEFT JOIN root USING (word)
"""
