"""Words whose polynomial hashes modulo 2**64 are equal whatever the base: Thue-Morse words and their complements."""

import numpy as np
import pyarrow as pa
import pytest

from eventledger.llm import bytewords, decontam, licenses, neardup

from .test_tokenfile import thue_morse

WORD = thue_morse(2048)
OTHER = WORD.translate(str.maketrans("ab", "ba"))


def hashes(text, kind):
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    return bytewords.words_of(data, np.array([0, len(data)]), kind).hashes


@pytest.mark.parametrize("kind", [bytewords.ALNUM, bytewords.NON_SPACE])
def test_hashes_are_of_words_alone(kind):
    assert len(set(hashes(f"{WORD} {OTHER} ab ba aab aba baa a b aa", kind).tolist())) == 10
    text = "One oNE  x" + "é" * 200 + " ONE x" + "é" * 199 + " x" + "é" * 200
    h = hashes(text, kind)
    assert h[0] == h[1] == h[3] and h[2] == h[5] != h[4]


def test_near_duplicates(spark):
    docs = spark.createDataFrame([(1, WORD), (2, OTHER), (3, WORD.upper())], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in neardup.near_duplicates(docs, 2).collect()} == {(1, 1), (2, 2), (3, 1)}


def test_decontamination_and_licenses():
    block = decontam.block_of(["i"], pa.array([OTHER]))
    words, bounds = decontam.hashed(pa.array([WORD, OTHER]))
    assert decontam.match(decontam.Shard(words, bounds, block.depth), block)[0].tolist() == [False, True]
    scanner = licenses.Scanner({"l": f"{OTHER} license"}, {})
    data = f"{WORD} license".encode()
    assert scanner.scan(bytewords.words_of(np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)]), bytewords.ALNUM))[0][5] == ""
