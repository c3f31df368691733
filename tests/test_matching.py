"""Terms found by the automaton against plain search, in one shard, many, and by the index join."""

import random
import re

import pytest

from glossweave.operators import qa
from glossweave.operators.matching import fold, term_matches_in, with_term_count
from glossweave.sources.derived import GLOSSARY_SCHEMA

TERMS = ["the", "The", "a.b", " spaced ", "", None, "é", "École", "翻译", "a翻", "a", "ab", "abc", "x_y", "K", "straße", "İ", "one two", "the"]
TEXTS = [None, "", "The then THE the", "(A.B) a_b aab ab ABC", "école É xé", "机器翻译a翻B", "straSSe STRASSE Straße", "one  two One Two", "K k ſ S", "i İ ı", "spaced", "x_y x_yz", "abcabc abc"]


def _plain(term, text, how):
    t = (term or "") if how == "exact" else (term or "").strip()
    if not t or not text:
        return []
    if how == "exact" or how == "term" and re.search("[一-鿿]", t):
        return [m.start() for m in re.finditer(f"(?={re.escape(t)})", text)]
    low, word = fold(text), "abcdefghijklmnopqrstuvwxyz0123456789_"
    at = [m.start() for m in re.finditer(f"(?={re.escape(fold(t))})", low)]
    free = lambda i: not 0 <= i < len(low) or low[i] not in word
    return at if how == "lower" else [i for i in at if free(i - 1) and free(i + len(t))]


@pytest.mark.parametrize("how", ["term", "exact", "lower"])
def test_matches(spark, how):
    draw = random.Random(4)
    names = TERMS + ["".join(draw.choice("ab é") for _ in range(3)) for _ in range(20)]
    own = TEXTS + ["".join(draw.choice("abA é_") for _ in range(40)) for _ in range(20)]
    texts = spark.createDataFrame(list(enumerate(own)), "k int, text string")
    terms = spark.createDataFrame(list(enumerate(names)), "id int, source string")
    want = {(k, i): at for k, x in enumerate(own) for i, t in enumerate(names) if (at := _plain(t, x, how))}
    for shard in (1 << 20, 8):
        got = term_matches_in(texts, terms, how=how, keep=["k"], positions="at", shard_chars=shard)
        assert got.columns == ["k", "id", "source", "at"]
        assert {(r["k"], r["id"]): sorted(r["at"]) for r in got.collect()} == want and got.count() == len(want)
        counted = {r["k"]: r["n"] for r in with_term_count(texts, terms, name="n", how=how, shard_chars=shard).collect()}
        assert counted == {k: sum(a == k for a, _ in want) for k in range(len(own))}
    joined = term_matches_in(texts, terms, how=how, keep=["k"], most_chars=0)
    assert sorted((r["k"], r["id"]) for r in joined.collect()) == sorted(want)


def test_no_terms_and_no_texts(spark):
    texts, terms = spark.createDataFrame([(1, "a")], "k int, text string"), spark.createDataFrame([(1, "a")], "id int, source string")
    assert term_matches_in(texts, terms.limit(0)).columns == ["k", "text", "id", "source"]
    assert term_matches_in(texts, terms.limit(0)).count() == 0 == term_matches_in(texts.limit(0), terms).count()
    assert [r["n"] for r in with_term_count(texts, terms.limit(0), name="n").collect()] == [0]


def test_findings_by_target_language(spark):
    rows = [
        ("A", 1, 0, "Some whole text here", "some  WHOLE text here", "Chinese"), ("A", 1, 1, "Some whole text here", "Some whole text here", "English"), ("A", 1, 2, "Acme Corp", "acme corp", None),
        ("A", 1, 3, "机器翻译很好 用户 见 www.翻译很好.cn", "Machine 翻译很好 and 用户 and 别的 at www.翻译很好.cn", "English"), ("A", 1, 4, "the annex shows large tables, see www.annex.example", "der annex zeigt large tables, www.annex.example", "German"), ("A", 1, 5, "two words", None, "German"),
    ]
    pairs = spark.createDataFrame(rows, "arm string, conv_id long, seg_idx int, source string, target string, target_lang string")
    g = spark.createDataFrame([("t1", "acme  corp", "", [], "preserve", "locked", "global", 0)], GLOSSARY_SCHEMA).withColumnRenamed("source", "term_source")
    got = sorted((r["seg_idx"], r["type"], r["severity"], r["reason"]) for r in qa.findings(pairs, g).collect())
    assert got == [
        (0, "identical", "actionable", ""), (0, "residual", "informational", "WHOLE"), (3, "residual", "actionable", "翻译很好"), (3, "residual", "informational", "用户"), (4, "residual", "actionable", "large tables"), (4, "residual", "informational", "annex"), (5, "blank", "blocking", ""),
    ]


def test_occurrences_of_many_words(spark):
    """Terms that are one word, by the counts of all words, as by the automaton; and what folds to ASCII."""
    from glossweave.operators import terms as t

    assert {chr(c): fold(chr(c)) for c in range(128, 0x110000) if not 0xD800 <= c < 0xE000 and fold(chr(c)).isascii()} == dict(zip(t._ODD, t._EVEN, strict=True))
    segments = spark.createDataFrame([(k % 4, k, x) for k, x in enumerate(TEXTS + ["\u017ftone \u212ailo İ ı the", "THE stone_kilo kilo"])], "doc_id long, seg_idx int, text string")
    names = [*enumerate([*TERMS, "kilo", "STONE", "stone_kilo", "tab\t", "line\n"]), (0, "the")]
    terms = spark.createDataFrame(names, "id int, source string")
    got, want = (sorted(map(tuple, t.occurrences(segments, terms, few_chars=n).collect())) for n in (0, 1 << 20))
    assert got == want and len(got) > 10
