"""The pipeline against plain versions of its stages, each on the table the stage before wrote."""

import re
import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from eventledger.llm import tokenfile  # noqa: E402

from .test_decontam import brute as leaks  # noqa: E402
from .test_neardup import brute as groups  # noqa: E402


def test_stages_hold_their_contracts(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, tables = docs.columns, [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.staged(stage(spark, tables[-1], sf), f"test-{i}")
        assert i == 4 or out.columns == columns
        tables.append(out)
    texts = [{r.doc_id: r.text for r in t.select("doc_id", "text").collect()} for t in tables[:5]]
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
    clean = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 0").collect()}
    gone = texts[0].keys() - texts[1].keys()
    assert len(gone & toxic) > 0.8 * len(toxic & texts[0].keys()) and len(gone & clean) <= 0.01 * len(clean)
    component = groups(texts[1], 5)
    assert texts[2].keys() == {i for i, (_, c) in component.items() if c == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    order = sorted(texts[2])
    hit = dict(zip(order, leaks([texts[2][i] for i in order], items)))
    assert texts[3].keys() == {i for i in order if not hit[i][-1]}
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    size = sum(words(t) for t in texts[3].values())
    mixed = tables[4].collect()
    assert abs(sum(words(r.text) for r in mixed) - 1.5 * size) < 0.05 * size
    assert all(texts[3][r.doc_id] == r.text for r in mixed)
    coder = tokenfile.encoder(tokenfile.default_tokenizer()).tokenizer
    start, want = 0, []
    for r in sorted(mixed, key=lambda r: r.doc_id):
        ids = [*coder.encode(r.text, add_special_tokens=False).ids, 0]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, tables[5].collect())) == want


def test_registered_and_optional(spark, sf):
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries()
    assert {c for c, _ in corpus_pipeline.run(spark, sf).dtypes} == {"doc_id", "start", "n_tokens", "ids_crc32"}
