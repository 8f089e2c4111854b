import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from eventledger.llm import tokenfile
from eventledger.llm.eliasfano import EliasFano

public_tokenizers = pytest.importorskip("public_tokenizers")


@given(st.lists(st.integers(0, 10**6), max_size=400), st.integers(0, 2**60))
@settings(max_examples=60, deadline=None)
def test_elias_fano_selects(values, jump):
    values = np.cumsum([*values[:3], jump, *values[3:]], dtype=np.int64)
    ef, end = EliasFano.from_bytes(b"xx" + (raw := EliasFano.of(values).to_bytes()), 2)
    assert end == len(raw) + 2
    assert ef.select(np.arange(len(values))).tolist() == values.tolist()
    assert ef.select(np.arange(0, len(values), 7)[::-1]).tolist() == values[::7][::-1].tolist()
    with pytest.raises(IndexError):
        ef.select(np.array([len(values)]))


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(1).integers(0, 2000, 100_000))
    assert len(EliasFano.of(values).to_bytes()) * 8 < 100_000 * (2 + 10 + 1)
    assert EliasFano.of(np.zeros(0, dtype=int)).select(np.zeros(0, dtype=int)).tolist() == []


EDGES = ["", "a", " a", "a ", "a  b", "a \n b", "\n", "x\n\ny", "don't can't I'm 'sit", "é, ü.\nOü", "½1 a½ ²3", "12,3 4", "日本 語。", "<|endoftext|>", "a <|endoftext|> b", "tab\tx", "nb x y", "😀 x", "f(x), -- a_b|c %%% don't", "A.\nB?!\nC ", " a b", "a\u0085 b", "w" * 5000]


def plain(text):
    t = tokenfile.encoder(tokenfile.default_tokenizer()).tokenizer
    return t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("slots", [tokenfile.SLOTS, 64])
def test_encoder_equals_whole_texts(slots):
    coder = tokenfile.Encoder(tokenfile.default_tokenizer(), slots)
    rng = random.Random(4)
    alphabet = ["a", "B", "é", " ", " ", "  ", "\n", ".", ",", "'", "'s", "1", "½", "日", "_", "\t", "\u00a0", "\u2003", "%", "\x1d"]
    texts = EDGES + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(1500)]
    for some in (texts, texts[::-1], texts[:1], [""]):
        raw = [t.encode() for t in some]
        offsets = np.cumsum([0, *map(len, raw)])
        ids, counts = coder.encode(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets, 0)
        at = np.concatenate([[0], np.cumsum(counts)])
        for text, a, b in zip(some, at[:-1], at[1:]):
            assert ids[a:b].tolist() == plain(text) + [0], repr(text)
        assert at[-1] == len(ids)


def expected(texts):
    out, start = [], 0
    for doc, text in texts:
        ids = plain(text or "") + [0]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_blocks_round_trip(spark, monkeypatch):
    texts = [(i * 3 - 20, t) for i, t in enumerate([*EDGES, None, "long text " * 20_000, *EDGES])]
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, start int").repartition(3)
    rows = tokenfile.documents_of(tokenfile.write(docs, tokenfile.default_tokenizer())).collect()
    assert sorted(map(tuple, rows)) == expected(texts)
    assert tokenfile.documents_of(tokenfile.write(docs.limit(0), tokenfile.default_tokenizer())).count() == 0
    names = [None, None, -(2**63), -4, -4, 2**63 - 1]
    block = tokenfile.read_block(tokenfile.write_block(names, np.array([1, 2, 1, 1, 1, 3]), np.arange(9, dtype="<u2")))
    every = np.arange(6)
    assert block.doc_ids(every).to_pylist() == names and block.doc_ids(every[3:4]).to_pylist() == [-4]
    assert [x.tolist() for x in block.bounds(every)] == [[0, 1, 3, 4, 5, 6], [1, 3, 4, 5, 6, 9]] and block.ids.tolist() == list(range(9))
    twice = spark.createDataFrame([(None, "b"), (4, "x"), (None, "a"), (4, "y"), (None, "b")], "doc_id long, text string")
    found = sorted(tokenfile.documents_of(tokenfile.write(twice, tokenfile.default_tokenizer(), shards=3)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [None, None, None, 4, 4] and sum(r.n_tokens for r in found) == found[-1].start + found[-1].n_tokens


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_that_collide_under_polynomials(spark):
    """Thue-Morse words and their complements have one polynomial hash modulo 2**64, whatever its base."""
    word = thue_morse(1024)
    other = word.translate(str.maketrans("ab", "ba"))
    texts = [(1, word + " " + other), (2, other), (3, word), (4, other + " " + word)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = tokenfile.documents_of(tokenfile.write(docs, tokenfile.default_tokenizer())).collect()
    assert sorted(map(tuple, rows)) == expected(texts)


def test_parts_of_equal_hash_are_told_apart():
    """With a hash that knows only lengths, bytes decide."""
    coder = tokenfile.Encoder(tokenfile.default_tokenizer(), values=np.ones_like(tokenfile._VALUES))
    texts = ["one two six", "ten two one x", "six six red", "one", "abc", "one abc"]
    for some in (texts, texts[::-1], texts):
        raw = [t.encode() for t in some]
        ids, counts = coder.encode(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)]), 0)
        at = np.concatenate([[0], np.cumsum(counts)])
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [plain(t) + [0] for t in some]


def test_query_on_whole_table(spark, sf):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    assert sorted(map(tuple, tokenfile.op7_tokenfile(spark, sf).collect())) == expected(texts)
