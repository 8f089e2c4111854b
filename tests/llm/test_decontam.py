import hashlib
import random
import re

import pyarrow as pa
import pytest

from eventledger.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(texts, items, window=10):
    at = {}
    for name, text in items:
        w = words(text)
        size = min(window, len(w))
        for j in range(len(w) - size + 1 if size else 0):
            at.setdefault(tuple(w[j : j + size]), set()).update([] if name is None else [str(name)])
    sizes = sorted({len(k) for k in at})
    out = []
    for text in texts:
        w = words(text)
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (names := at.get(tuple(w[i : i + size]))) is not None:
                    hit.update(range(i, i + size))
                    found |= names
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def rows_of(frame):
    return [(r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in sorted(frame.collect(), key=lambda r: r.doc_id)]


def test_suffix_array_is_sorted_to_its_depth():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("ab cd ef g".split()) for _ in range(rng.randrange(40))) for _ in range(60)]
    hashes, bounds = decontam.hashed(pa.array(texts))
    shard = decontam.Shard(hashes, bounds, 12)
    suffix = [tuple(shard.rank[i : min(i + 12, shard.end[i])]) for i in shard.order]
    assert sorted(shard.order.tolist()) == list(range(len(hashes)))
    assert suffix == sorted(suffix)


@pytest.mark.parametrize("most", [decontam.BLOCK_BYTES, 300])
def test_equals_brute_force(spark, tmp_path, monkeypatch, most):
    rng = random.Random(7)
    vocabulary = "alpha BETA gamma délta 12 x".split()
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 30])))) for i in range(40)]
    items += [(40, None), (41, "One two, three! four five six seven eight nine ten eleven"), (42, items[5][1]), (None, "alpha zz"), (None, "yy yy yy"), (41, "alpha yy alpha"), (7, items[7][1])]
    texts = [None, "", "... !!", "x" * 200_000, "one TWO three four five six seven eight nine ten"]
    for _ in range(80):
        parts = [" ".join(rng.choice([*vocabulary, "zz", "yy"]) for _ in range(rng.randrange(60)))]
        parts.insert(rng.randrange(2), (rng.choice(items)[1] or "").upper())
        texts.append(" - ".join(parts))
    texts += texts[5:25] + ["alpha " * 30_000]
    path = str(tmp_path)
    spark.createDataFrame([(i, t, 0, 1) for i, t in enumerate(texts)], "doc_id long, text string, hits int, words int").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    monkeypatch.setattr(decontam.blocks, "__defaults__", (decontam.WINDOW, most))
    assert rows_of(decontam.op4_decontam(spark, path)) == brute(texts, items)


def test_empty_tables(spark, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    assert decontam.op4_decontam(spark, path).count() == 0
    docs = spark.createDataFrame([(1, "a b", 2)], "doc_id long, text string, extra int")
    assert decontam.clean_documents(docs, spark.read.parquet(f"{path}/benchmark.parquet")).collect() == docs.collect()


@pytest.mark.parametrize("most", [decontam.BLOCK_BYTES, 40])
def test_columns_of_any_name_stay(spark, monkeypatch, most):
    monkeypatch.setattr(decontam.blocks, "__defaults__", (decontam.WINDOW, most))
    names = ["words", "hits", "items", "longest", "_hits", "_words", "n", "h", "size"]
    docs = spark.createDataFrame([(1, "clean text", *range(9)), (None, "a leaked passage stands here", *range(9)), (3, None, *range(9))], ["doc_id", "text", *names])
    items = spark.createDataFrame([("i", "Leaked passage"), ("j", "some other words that fill another block")], "item_id string, text string")
    kept = decontam.clean_documents(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
    assert kept.select(*names).distinct().collect() == [tuple(range(9))]


def test_longest_match(spark):
    body = " ".join(f"w{i}" for i in range(60))
    docs = pa.array([f"x {body} y", " ".join(body.split()[5:30]), "q " + " ".join(body.split()[40:]) + " " + " ".join(body.split()[:12]), "w1 w2"])
    block = decontam.block_of(["i", "j"], pa.array([body, "q w40 w41"]))
    words, bounds = decontam.hashed(docs)
    assert decontam.match(decontam.Shard(words, bounds, block.depth), block)[3].tolist() == [60, 25, 20, 0]


def test_whole_tables(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    found = rows_of(decontam.op4_decontam(spark, sf))
    assert found == brute(texts, items)
    assert any(x[-1] for x in found)
