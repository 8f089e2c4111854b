import random
import re

import pytest
from pyspark.sql import functions as F

from eventledger.llm import components, neardup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(texts, k, percent=80):
    """{doc_id: (size of its set, least id reachable)}"""
    sets = {i: shingles(t, k) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    holders, first = {}, {}
    for i, s in sets.items():
        if not s:
            continue
        if s in first:
            parent[max(find(i), find(first[s]))] = min(find(i), find(first[s]))
            continue
        first[s] = i
        shared = {}
        for g in s:
            for j in holders.get(g, ()):
                shared[j] = shared.get(j, 0) + 1
            holders.setdefault(g, []).append(i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def compared(frame, texts, k):
    want = brute(texts, k)
    rows = frame.collect()
    assert len(rows) == len(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


@pytest.mark.parametrize("k", [2, 5])
def test_groups_around_the_threshold(spark, k):
    """Copies of a base with so many changes that links between them are a matter of luck; chains; copies."""
    rng = random.Random(k)
    words = [f"w{i}" for i in range(5000)]
    texts = {}

    def add(t):
        texts[len(texts)] = t

    for n, size, rate in ((250, 120, 0.055 / k * 2), (60, 300, 0.06 / k * 2), (40, 60, 0.03)):
        base = [rng.choice(words) for _ in range(size)]
        for _ in range(n):
            add(" ".join(rng.choice(words) if rng.random() < rate else w for w in base))
    step = [rng.choice(words) for _ in range(100)]
    for _ in range(30):  # each links with the next only
        step = step[4:] + [rng.choice(words) for _ in range(4)]
        add(" ".join(step))
    for t in [None, "", " \n", "one", "ONE", "one two", "x" * 100_000, "a b " * 20_000]:
        add(t)
    for i in (0, 0, 250, 300, 5):
        add((texts[i] or "").upper())
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, rep int").repartition(3)
    compared(neardup.near_duplicates(docs, k), texts, k)


def test_far_copies_are_not_paired_with_each_other(spark, monkeypatch):
    """A large group whose members are all like the base, which isn't there, and hardly any two like each other."""
    rng, plain, rows = random.Random(3), neardup.staged, {}

    def counted(frame, tag):
        out = plain(frame, tag)
        rows.setdefault(tag, []).append(out.count())
        return out

    monkeypatch.setattr(neardup, "staged", counted)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(150)]
    texts = {i: " ".join(rng.choice(words) if rng.random() < 0.035 else w for w in base) for i in range(600)}
    texts |= {600 + i: " ".join(base[:60] + [rng.choice(words) for _ in range(90)]) for i in range(300)}  # a passage in common
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    compared(neardup.near_duplicates(docs, 5), texts, 5)
    assert rows["open"][0] > 5_000 and max(rows["pairs"][1:]) < 3_000 and rows["deltas"][0] < 10_000, rows


def test_empty_and_null_ids(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (1, "a b c"), (1, "a b c")], "doc_id long, text string")
    rows = sorted(neardup.near_duplicates(docs, 2).collect(), key=lambda r: r.doc_id or 0)
    assert [(r.doc_id, r.component_id, r.kept) for r in rows] == [(None, None, True), (1, 1, True), (1, 1, True), (3, 1, False)]
    kept = neardup.deduplicated(docs.withColumn("kept", F.lit(7)).withColumn("row", F.lit(8)), 2)
    assert kept.columns == ["doc_id", "text", "kept", "row"] and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1]


def test_repeated_ids_are_one_node(spark):
    """One id on several texts joins what each of them is linked with; null ids of one text stay once."""
    one, two, three = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    rows = [(5, one), (5, two), (2, one + " x"), (3, two + " y"), (9, three), (9, three), (None, one), (None, one), (7, two), (7, three), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.component_id) for r in neardup.near_duplicates(docs, 5).collect()}
    assert found == {(5, 2), (2, 2), (3, 2), (9, 2), (7, 2), (None, None), (8, 8)}
    assert sorted((r.doc_id or 0, r.text) for r in neardup.deduplicated(docs, 5).collect()) == [(0, one), (2, one + " x"), (8, "")]


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    parent = {x: x for e in edges for x in e}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    found = components.components(spark.createDataFrame(edges, "u long, v long")).collect()
    loops = {a for a, b in edges if a == b}
    want = {x: find(x) for x in parent}
    got = {r.node: r.root for r in found}
    assert len(found) == len(got) and all(want[x] == got.get(x, x if x in loops else None) for x in want)


def test_query_on_whole_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    compared(neardup.op9_neardup(spark, sf), texts, 2)
