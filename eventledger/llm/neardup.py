"""Near-duplicate documents: universal hash minima, banding, signature and full-set verification, components.

1. One pass turns each document into its set of k-word shingles (64-bit hashes), the set's size and
   fingerprint, 288 universal hash minima and 48 band hashes of 6 minima. At similarity 0.8 a pair
   misses all bands with probability 5e-7; unrelated documents hardly ever meet.
2. Documents with equal sets are one class; only each class's least id goes on.
3. Within a band's bucket all members are compared with one pivot, not with each other; each bucket has
   another pivot. Signatures that agree in under 63% (7 standard deviations under 0.8) end a candidate; the
   others are confirmed on full sets.
4. Buckets whose members are then still in several components are open. Each member of one is compared with a few
   centres: its set is written as the difference from the centre's, which is small in a group of near copies. Either both
   of two sets are close enough to the centre to be linked through it, or their differences must overlap by a known number,
   so they share one of each one's rarest elements; such pairs are confirmed on full sets. No link is lost, and sets that
   only have in common what the whole group has are never paired.
5. Components by alternating large-star and small-star.

Defined results: null and empty texts have no set and link with nothing; a text of fewer than k words has one
shingle, the whole sequence; rows with equal doc_id are one node, linked with whatever one of its texts is linked with; a
null doc_id is linked with nothing, has a null component and is kept; empty tables give empty tables. Only doc_id and text are
read, so other columns can't clash. deduplicated() keeps one row of each component: of rows with the doc_id that stays the one
with the least text, and of rows with null doc_id one of each text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytewords import NON_SPACE, Words, groups, mixed, words_of
from .common import bloom_has, bloom_of, read, staged, trimmed
from .components import components

BANDS, ROWS = 48, 6
#: Signatures agreeing in fewer of their BANDS * ROWS minima end a candidate.
AGREE = 183
#: Visitors of a centre that share one copy of its set.
BLOCK = 256
_RANDOM = np.random.default_rng(97)
_MULTIPLY = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes text by text, sorted, and where each text's start."""
    h, bounds = words.hashes, words.bounds
    n = np.diff(bounds)
    made = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    at = np.zeros(len(made) + 1, dtype=np.int64)
    np.cumsum(made, out=at[1:])
    first = np.repeat(bounds[:-1] - at[:-1], made) + np.arange(at[-1])
    last = np.repeat(bounds[1:], made)
    out = np.zeros(at[-1], dtype=np.uint64)
    for j in range(k):
        there = first + j < last
        step = mixed(out + h[np.minimum(first + j, len(h) - 1)] * np.uint64(2 * j + 3)) if len(h) else out
        out = np.where(there, step, out)
    for a, b in zip(at[:-1], at[1:]):
        out[a:b].sort()
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = out[1:] != out[:-1]
    keep[at[:-1][made > 0]] = True
    kept_before = np.zeros(len(out) + 1, dtype=np.int64)
    np.cumsum(keep, out=kept_before[1:])
    return out[keep], kept_before[at]


def minima(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """BANDS * ROWS universal hash minima of each non-empty set."""
    out = np.empty((BANDS * ROWS, len(at)), dtype=np.uint64)
    room = np.empty_like(sets)
    for i in range(BANDS * ROWS):
        np.multiply(sets, _MULTIPLY[i], out=room)
        np.add(room, _ADD[i], out=room)
        out[i] = np.minimum.reduceat(room, at)
    return out


_PROFILE = "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>, signature binary"


def _profiles(k: int):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in groups(batch.column("text")):
                sets, at = shingles(words_of(data, offsets, NON_SPACE), k)
                n = np.diff(at)
                full = n > 0
                fp = np.zeros((2, len(n)), dtype=np.uint64)
                bands = np.zeros((len(n), BANDS), dtype=np.uint64)
                signature = np.zeros((len(n), BANDS * ROWS), dtype=np.uint8)
                if full.any():
                    starts = at[:-1][full]
                    fp[0, full] = np.add.reduceat(mixed(sets + np.uint64(1)), starts)
                    fp[1, full] = np.add.reduceat(mixed(sets ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)
                    least = minima(sets, starts)
                    signature[full] = (least.T >> np.uint64(40)).astype(np.uint8)
                    by_band = least.reshape(BANDS, ROWS, -1)
                    h = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[:, None], by_band.shape[2], axis=1)
                    for r in range(ROWS):
                        h = mixed(h * np.uint64(0x2545F4914F6CDD1D) + by_band[:, r])
                    bands[full] = h.T
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(n) * BANDS + 1, BANDS, dtype=np.int32)), pa.array(bands.view(np.int64).ravel()))
                columns = [
                    batch.column("doc_id").slice(first, last - first),
                    pa.array(n.astype(np.int64)),
                    pa.array(fp[0].view(np.int64), mask=~full),
                    pa.array(fp[1].view(np.int64), mask=~full),
                    lists,
                    pa.array([x.tobytes() for x in signature], type=pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "fp1", "fp2", "bands", "signature"])

    return run


def _sets(k: int, wanted: np.ndarray):
    """Shingle sets of the rows whose hash h is in the filter."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(bloom_has(wanted, batch.column("h").to_numpy())))
            for first, last, data, offsets in groups(batch.column("text")):
                sets, at = shingles(words_of(data, offsets, NON_SPACE), k)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), lists], names=["doc_id", "shingles"])

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Of candidate pairs (a, b), those whose signatures and then full shingle sets are similar enough."""
    sig = reps.select("rep", "signature")
    likely = (
        pairs.join(sig.select(F.col("rep").alias("a"), F.col("signature").alias("sa")), "a")
        .join(sig.select(F.col("rep").alias("b"), F.col("signature").alias("sb")), "b")
        .mapInArrow(_agreeing, "a long, b long")
    )
    inter = F.size(F.array_intersect("sa", "sb"))
    both = (
        likely.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa")), "a")
        .join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb")), "b")
        .select("a", "b", inter.alias("inter"), (F.size("sa") + F.size("sb") - inter).alias("both"))
    )
    return staged(both.where(100 * F.col("inter") >= percent * F.col("both")).select("a", "b"), "links")


def _visits(open_: DataFrame) -> DataFrame:
    """(centre, rep, root, parts): the centres that each member of an open bucket is compared with.

    A member's home is the largest open bucket that it is in; members visit the homes of all that they share an open bucket
    with, so any two that share one meet. A home's centre is the visitor that meets most members; homes with one centre are one.
    """
    per = open_.groupBy("rep").agg(F.max(F.struct("n", "bucket"))["bucket"].alias("home"), F.sum("n").alias("reach"))
    met = open_.select("bucket", "rep").join(per, "rep")
    meets = met.select("bucket", "home").distinct()
    top = met.groupBy("bucket").agg(F.max(F.struct("reach", "rep")).alias("top"))
    centres = meets.join(top, "bucket").groupBy("home").agg(F.max("top")["rep"].alias("centre"))
    there = meets.join(centres, "home").select("bucket", "centre").distinct()
    visits = staged(open_.join(there, "bucket").select("centre", "rep", "root").distinct(), "visits")
    parts = visits.groupBy("centre").agg(F.count("*").alias("m"), F.min("root").alias("least"), F.max("root").alias("most"))
    return visits.join(parts.where("least <> most").select("centre", F.expr(f"(m + {BLOCK - 1}) div {BLOCK}").alias("parts")), "centre")


def _deltas(visits: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Each visitor's set as its difference from the centre's.

    With far = (100 + percent) |difference| - (100 - percent) |set|, two sets are similar enough if the sum of their far is 0
    or less; else if and only if their differences share at least that sum over 2 (100 + percent). The centre has the least far.
    """
    dealt = visits.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")))
    copies = visits.select("centre", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).distinct()
    copies = copies.join(sets.select(F.col("rep").alias("centre"), F.col("shingles").alias("middle")), "centre")
    both = dealt.join(sets.select("rep", "shingles"), "rep").join(copies, ["centre", "part"])
    apart = F.concat(F.array_except("shingles", "middle"), F.array_except("middle", "shingles"))
    rows = both.select("centre", "rep", "root", F.size("shingles").alias("n"), apart.alias("delta"), (-(100 - percent) * F.size("middle")).alias("far_c"))
    rows = rows.withColumn("far", (100 + percent) * F.size("delta") - (100 - percent) * F.col("n"))
    return staged(rows.withColumn("outer", F.expr("far + far_c > 0")), "deltas")


def _candidates(deltas: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a centre's visitors, at least one of them outside its reach, whose differences may share enough.

    Differences are ordered by how many visitors hold an element, rarest first. Two that share s elements share one among
    the first |difference| - s + 1 of each. What most visitors have in common is in no difference.
    """
    twice = 2 * (100 + percent)
    least = F.when(F.col("outer"), F.col("far") + F.col("far_c")).otherwise(F.col("far") - F.col("far_c") + 1)
    rows = deltas.join(deltas.where("outer").select("centre").distinct(), "centre", "left_semi")
    rows = rows.select("centre", "rep", "root", "n", "far", "outer", F.size("delta").alias("d"), (F.size("delta") - F.ceil(least / twice) + 1).alias("first"), F.explode("delta").alias("token"))
    shared = rows.withColumn("held", F.count("*").over(Window.partitionBy("centre", "token"))).where("held > 1")
    one = Window.partitionBy("centre", "rep")
    alone = F.col("d") - F.count("*").over(one)
    rows = shared.withColumn("place", alone + F.row_number().over(one.orderBy("held", "token"))).where("place <= first")
    rows = staged(rows.drop("first", "held"), "prefixes")
    x, y = rows.where("outer").alias("x"), rows.alias("y")
    room = F.least(F.col("x.d") - F.col("x.place"), F.col("y.d") - F.col("y.place")) + 1
    pairs = x.join(y, ["centre", "token"]).where("x.root <> y.root and (x.rep < y.rep or not y.outer)")
    pairs = pairs.where((twice * room >= F.col("x.far") + F.col("y.far")) & F.expr(f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"))
    return staged(pairs.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct(), "pairs")


def _rest(members: DataFrame, roots: DataFrame, sets: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of a bucket that lie in different components."""
    known = members.where("n > 2").join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("bucket", "rep", "n", F.coalesce("root", "rep").alias("root"))
    split = known.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("bucket")
    open_ = staged(known.join(split, "bucket", "left_semi"), "open")
    deltas = _deltas(_visits(open_), sets, percent)
    stars = deltas.where("not outer and rep <> centre").select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b"))
    return staged(stars.unionByName(_confirmed(_candidates(deltas, percent), sets, reps, percent)).distinct(), "links")


@trimmed
def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
        ok = (a == b).sum(axis=1) >= AGREE
        yield batch.select(["a", "b"]).filter(pa.array(ok))


def _same_id(full: DataFrame) -> DataFrame:
    """Edges (u, v) between classes of equal sets that one doc_id lies in; full has doc_id and the class's rep."""
    several = full.groupBy("doc_id").agg(F.min("rep").alias("v"), F.max("rep").alias("most")).where("v <> most").select("doc_id", "v")
    return full.select("doc_id", F.col("rep").alias("u")).join(several, "doc_id").where("u <> v").select("u", "v").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    profile = staged(texts.mapInArrow(_profiles(k), _PROFILE), "profiles")
    full = profile.where("n_shingles > 0 and doc_id is not null")
    key = ["fp1", "fp2", "n_shingles"]
    classes = full.groupBy(*key).agg(F.min("doc_id").alias("rep"))
    # A doc_id with several texts may represent several classes; its rows then stand side by side here and in sets.
    reps = staged(full.join(classes, key).where("doc_id = rep").select("rep", *key, "bands", "signature").dropDuplicates(["rep", *key]).drop(*key), "reps")
    rows = reps.select("rep", F.explode("bands").alias("bucket"))
    # rep XOR bucket orders the members of each bucket in another way; its least gives the pivot.
    stars = rows.groupBy("bucket").agg(F.min(F.col("rep").bitwiseXOR(F.col("bucket"))).alias("least"), F.count("*").alias("n")).where("n > 1")
    members = rows.join(stars, "bucket").select("bucket", "rep", F.col("least").bitwiseXOR(F.col("bucket")).alias("pivot"), "n")
    members = staged(members, "members")
    pairs = staged(members.where("rep <> pivot").select(F.least("pivot", "rep").alias("a"), F.greatest("pivot", "rep").alias("b")).distinct(), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = bloom_of(wanted.select(F.xxhash64("id").alias("h")), "h")
    hashed = texts.withColumn("h", F.xxhash64("doc_id"))
    sets = hashed.mapInArrow(_sets(k, wanted), "doc_id long, shingles array<long>").withColumnRenamed("doc_id", "rep")
    sets = staged(sets.join(reps.select("rep").distinct(), "rep", "left_semi").where("size(shingles) > 0"), "sets")
    as_edges = lambda x: x.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    linked = as_edges(_confirmed(pairs, sets, reps, percent)).unionByName(_same_id(full.join(classes, key).select("doc_id", "rep")))
    roots = staged(components(linked), "roots")
    more = _rest(members, roots, sets, reps, percent)
    if not more.isEmpty():
        old = roots.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))
        roots = staged(components(old.unionByName(as_edges(more))), "roots")
    class_root = classes.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select(*key, F.coalesce("root", "rep").alias("root"))
    ids = profile.select("doc_id", *key)
    rows = ids.join(class_root, key, "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")))
    kept = F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept")
    return rows.select("doc_id", "n_shingles", "component_id", kept)


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component of near-duplicates, all columns kept."""
    columns = docs.columns
    rows = docs.select(F.struct(*columns).alias("row"), F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = staged(near_duplicates(docs, k, percent).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("kept").alias("kept")), "kept")
    single = rows.join(ids.where("kept and n = 1 and doc_id is not null").select(F.col("doc_id").alias("id")), "id", "left_semi")
    out = single.select("row")
    # Few tables have such rows; only they are read again for them.
    if not ids.where("kept and n > 1 and doc_id is not null").isEmpty():
        again = rows.join(ids.where("kept and n > 1").select(F.col("doc_id").alias("id")), "id", "left_semi")
        out = out.unionByName(again.groupBy("id").agg(F.min_by("row", "text").alias("row")).select("row"))
    if not ids.where("doc_id is null").isEmpty():
        out = out.unionByName(rows.where("id is null").groupBy("text").agg(F.first("row").alias("row")).select("row"))
    return out.select(*[F.col("row")[c].alias(c) for c in columns])


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), k=2)
