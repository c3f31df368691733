"""Token files, packing and token counts against the libraries themselves."""

import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from glossweave.llm.common import new_path
from glossweave.llm.encode import Encoder
from glossweave.llm.packing import op8_vector_packing, pack, pack_documents
from glossweave.llm.token_counts import Transducer, count_tokens, op10_token_counts
from glossweave.llm.token_files import code, decode, op3_token_files, read_token_files, read_token_ids, write_token_files

BYTE, WORD, PIECE = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
HARD = [
    "", " ", "\n\n\n", "a.", "x, y.", "it's.", "$., 3.14, 3,", "don't. O'Neil's, ", "<|endoftext|> a<|endoftext|>. b", "<|startoftext|>,", "é. ́b", "İstanbul. ﬁ, ", "a \n b  c\n\nd ", "\0a \0", "tab\tx .", "<s> </s> <unk>",
    "日本語テキスト", "😀😀 é", "x▁y ▁ z", "a" * 3000, "   " * 50, "word. " * 4000, "ａｂ", "x\xa0y.",
]
ANY = st.text(st.sampled_from("abcthe  ..,\n\né日0'İ́\x01<>|/s▁\t\xa0ß"), max_size=60)
DOCS = "doc_id long, text string, start string, n_tokens int"


def _rows(spark):
    texts = [*HARD, None, HARD[3], "same text", "same text"]
    return spark.createDataFrame([(k * 3 + 1, t, "clash", 7) for k, t in enumerate(texts)], DOCS), texts


@pytest.mark.parametrize(("path", "drops"), [(BYTE, False), (WORD, True)])
def test_encoder(path, drops):
    library, own = Tokenizer.from_file(path), Encoder(path, drops_space=drops, remembered=20)

    def same(texts):
        want = [np.array(e.ids, dtype="<u2").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
        assert own.encode(texts) == want

    same(HARD)
    settings(max_examples=150, deadline=None)(given(st.lists(ANY, min_size=1, max_size=4))(same))()


@pytest.mark.parametrize(("path", "drops"), [(BYTE, True), (WORD, False)])
def test_encoder_of_another_tokenizer_than_it_knows(path, drops):
    library, own = Tokenizer.from_file(path), Encoder(path, drops_space=drops)
    assert not own.safe
    assert own.encode([*HARD, None]) == [np.array(e.ids, dtype="<u2").tobytes() for e in library.encode_batch([*HARD, ""], add_special_tokens=False)]


def test_counts():
    library, own = sentencepiece.SentencePieceProcessor(model_file=PIECE), Transducer(PIECE)

    def same(texts):
        assert own.counts(texts, chunk=16, warm=5).tolist() == [len(x) for x in library.encode(texts)]

    same(HARD)
    settings(max_examples=150, deadline=None)(given(st.lists(ANY, min_size=1, max_size=4))(same))()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1 << 31), max_size=9), min_size=1, max_size=5))
def test_code(ranks):
    n = np.array([len(x) for x in ranks])
    control, data = code(np.array([y for x in ranks for y in x], dtype=np.uint32), n)
    got = decode(control, data)
    at = 0
    for x in ranks:
        assert got[at : at + len(x)].tolist() == x
        at += -(-len(x) // 4) * 4


def _expect(spark, library, texts, end):
    return [library.encode(t or "", add_special_tokens=False).ids + [end] for t in texts]


def test_token_files(spark):
    docs, texts = _rows(spark)
    want = _expect(spark, Tokenizer.from_file(BYTE), texts, 2)
    write_token_files(docs, path := new_path(spark), tokenizer=BYTE, end_id=2)
    assert spark.read.parquet(f"{path}/blocks").select("part").distinct().count() > 2
    got = {r["doc_id"]: r for r in read_token_files(spark, path).collect()}
    ids = {r["doc_id"]: r["ids"] for r in read_token_ids(spark, path).collect()}
    start = 0
    for k, w in enumerate(want):
        r = got[k * 3 + 1]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(w), zlib.crc32(np.array(w, dtype="<u4").tobytes()))
        assert ids[k * 3 + 1] == w
        start += len(w)


def test_token_files_of_repeated_and_null_ids(spark):
    rows = [(7, f"text {k}") for k in range(60)] + [(None, "no id")] * 20 + [(k, "same text") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    write_token_files(docs, path := new_path(spark), tokenizer=BYTE, end_id=2)
    got = sorted(read_token_files(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None] * 20 + sorted(i for i, _ in rows if i is not None)
    library = Tokenizer.from_file(BYTE)
    want = sorted((i or -1, zlib.crc32(np.array([*library.encode(t).ids, 2], dtype="<u4").tobytes())) for i, t in rows)
    assert sorted((r["doc_id"] or -1, r["ids_crc32"]) for r in got) == want
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got[:-1])]).tolist()


def test_packing_of_turns(spark):
    """Answers bear loss, prompts don't; the limit binds, and every id lies in one piece."""
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()
    of = {}
    for r in sorted(turns, key=lambda r: (r["conv_id"], r["turn"])):
        of.setdefault(r["conv_id"], {"user": "", "assistant": ""}).setdefault(r["role"], "")
        of[r["conv_id"]][r["role"]] += (r["text"] or "") + "\n"
    rows = [(i, t["user"], t["assistant"]) for i, t in of.items()] + [(-1, None, "answer " * 900), (-2, "prompt " * 5000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, prompt string, text string")
    library = Tokenizer.from_file(WORD)
    sizes = {i: (len(library.encode(p or "", add_special_tokens=False)), len(library.encode(t or "", add_special_tokens=False)) + 1) for i, p, t in rows}
    got = pack_documents(docs, tokenizer=WORD, end_id=1, drops_space=True, prompt_col="prompt", max_loss=300).collect()
    for i, (p, t) in sizes.items():
        own = [r for r in got if r["doc_id"] == i]
        assert sum(r["length"] for r in own) == p + t
        assert sum(r["loss_tokens"] for r in own) == p + t - max(1, p)
    loss, used = {}, {}
    for r in got:
        loss[r["sequence_id"]] = loss.get(r["sequence_id"], 0) + r["loss_tokens"]
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    assert max(loss.values()) == 300
    assert max(used.values()) <= 2048


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    write_token_files(none, path := new_path(spark), tokenizer=BYTE, end_id=2)
    assert read_token_files(spark, path).count() == 0
    assert pack_documents(none, tokenizer=WORD, end_id=1, drops_space=True).count() == 0
    assert count_tokens(none, model=PIECE).count() == 0


def test_pack_documents(spark):
    docs, texts = _rows(spark)
    want = _expect(spark, Tokenizer.from_file(WORD), texts, 1)
    for limits in ({}, {"max_segments": 3, "block_items": 5}, {"max_loss": 100}):
        rows = pack_documents(docs, tokenizer=WORD, end_id=1, drops_space=True, **limits).collect()
        by_doc, by_sequence = {}, {}
        for r in rows:
            by_doc.setdefault(r["doc_id"], []).append(r)
            by_sequence.setdefault(r["sequence_id"], []).append(r)
        for k, w in enumerate(want):
            at = 0
            for r in sorted(by_doc[k * 3 + 1], key=lambda r: r["start"]):
                assert (r["start"], r["doc_tokens"]) == (at, len(w))
                assert r["ids_crc32"] == zlib.crc32(np.array(w[at : at + r["length"]], dtype="<u4").tobytes())
                at += r["length"]
            assert at == len(w)
        for members in by_sequence.values():
            at = 0
            for r in sorted(members, key=lambda r: r["offset"]):
                assert r["offset"] == at
                at += r["length"]
            assert at <= 2048
            assert len(members) <= limits.get("max_segments", 256)
            assert sum(r["length"] - (r["start"] == 0) for r in members) <= limits.get("max_loss", 2048)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.just(1), st.integers(0, 20)), max_size=40))
def test_pack(demands):
    d = np.array(demands, dtype=np.int64).reshape(-1, 3)
    limits = (30, 4, 20)
    got = pack(d, limits)
    assert sorted(x for b in got for x in b) == list(range(len(d)))
    assert all((d[b].sum(axis=0) <= limits).all() for b in got)


def test_queries(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    counts = op10_token_counts(spark, sf_dir).collect()
    assert len(counts) == n
    for r in counts:
        k = len(library.encode(texts[r["doc_id"]] or ""))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((texts[r["doc_id"]] or "").encode()), k, k > 4096)
    byte, word = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    start = 0
    files = sorted(op3_token_files(spark, sf_dir).collect(), key=lambda r: r["doc_id"])
    assert len(files) == n
    for r in files:
        ids = [*byte.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    pieces = op8_vector_packing(spark, sf_dir).collect()
    by_doc = {}
    for r in pieces:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for i, text in texts.items():
        ids, at = [*word.encode(text or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids[at : at + r["length"]], dtype="<u4").tobytes()))
            at += r["length"]
        assert at == len(ids)
    used, size = {}, 2048
    for r in pieces:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    padding = sum(0 if x & (x - 1) == 0 else size - x for x in used.values())
    assert padding < 0.05 * sum(used.values())
