"""Toxicity by gradient-boosted trees over dense features of whole texts, with isotonic calibration.

Features: densities of a fixed lexicon and of a learned one (words, and word beginnings for inflected
forms), lexicon words near second-person words, capitals, punctuation, and obfuscation (signs or digits
between letters, lexicon words once such signs are read as letters).

Learning uses a bounded sample of the labelled rows, those with the least id hashes; SAMPLE is the bound. Weights of the learned
lexicon are log ratios shrunk by count; it holds each token of two toxic documents or more that lies STRIKING standard deviations
above the toxic share of the documents that have it, however many these are.
It falls into FOLDS parts by id hash. The trees see each row with lexicon features learned without its part, as unseen texts have
them; isotonic calibration fits scores of trees grown without the row's part. Scoring uses the lexicon of the whole sample.

Defined results: null and empty texts have zero features and a score like any other; without labels, or
with one class only, the score is the labelled share (0.5 without labels); repeated rows have repeated
results; of a labelled id with several texts the least is learned from; empty tables give empty tables. Only doc_id, text and labels' doc_id, toxic are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytewords import ALNUM, Words, groups, mixed, words_of
from .common import drop_stage, read, staged, trimmed, unused
from .gbt import Boosted, isotonic

#: Labelled rows used at most.
SAMPLE, FOLDS = 16_000, 4
#: Of the learned lexicon: standard deviations above the toxic share, and documents' worth of that share in each weight.
STRIKING, SHRINK = 3.0, 2.0
#: Bytes of word beginnings that the learned lexicon may hold; 0 stands for whole words.
BEGINNINGS = (0, 3, 4, 5, 6, 7, 8)
#: Words that insult in themselves, in four languages (lower case, also without accents).
LEXICON = """trash pathetic idiot worthless disgusting stupid clown scum loser moron idiots losers morons dumb filthy vermin garbage imbecile
    fool fools stupidity idiotic moronic jerk jerks creep bastard bastards asshole assholes bitch bitches whore slut fuck fucking fucker shit shitty bullshit crap dumbass dipshit
    retard retarded lunatic nitwit halfwit dimwit dunce simpleton weakling parasite swine degenerate despicable contemptible repulsive revolting vile subhuman useless
    idioten trottel dummkopf schwachkopf arschloch arsch scheiße scheisse versager abschaum depp deppen blödmann vollidiot dreckskerl miststück schlampe hure missgeburt widerlich erbärmlich wertlos
    dumm blöd nichtsnutz hohlkopf ungeziefer
    idiote idiots imbécile imbéciles crétin crétins abruti abrutis débile connard connards connasse salaud salope ordure ordures minable pourriture vermine enfoiré merde merdeux stupide
    répugnant méprisable imbecile cretin debile
    idiota idiotas imbécil imbéciles estúpido estúpida estúpidos tonto tonta cabrón pendejo gilipollas basura escoria inútil payaso asqueroso asquerosa patético mierda puta maldito
    despreciable imbecil estupido patetico inutil""".split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre ti tú usted tus".split()

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_PUNCT = np.zeros(256, dtype=bool)
for _a, _b in ((33, 48), (58, 65), (91, 97), (123, 127)):
    _PUNCT[_a:_b] = True
_SIGN = np.zeros(256, dtype=bool)
_SIGN[[ord(c) for c in "0134578@$!*"]] = True
#: What signs stand for between letters.
_LEET = np.arange(256, dtype=np.uint8)
for _a, _b in zip("013457@$!", "oieastasi"):
    _LEET[ord(_a)] = ord(_b)

FEATURES = (
    "words fixed_density fixed_count learned_sum learned_density learned_count strong_count strong_density learned_max "
    "near_second_person second_person capitals shouted exclaim question punctuation obfuscation leet_count digits word_length"
).split()


def lowered(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with the accented capitals of Latin-1 as small letters (words_of folds A-Z itself)."""
    out = data.copy()
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    capital = (data[second] >= 0x80) & (data[second] <= 0x9E) & (data[second] != 0x97)
    out[second[capital]] += 0x20
    return out


def _hashes(words: list[str]) -> np.ndarray:
    data = " ".join(words).encode()
    return np.sort(words_of(np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)]), ALNUM).hashes)


@dataclass
class Lookup:
    """Weights of hashes: a bitmap over 16 bits answers most misses, a sorted array the rest."""

    keys: np.ndarray
    weights: np.ndarray

    def __post_init__(self):
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[(self.keys >> np.uint64(48)).astype(np.int64)] = True

    def of(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes))
        if len(self.keys):
            rows = np.flatnonzero(self.maybe[(hashes >> np.uint64(48)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.keys, hashes[rows]), len(self.keys) - 1)
            hit = self.keys[at] == hashes[rows]
            out[rows[hit]] = self.weights[at[hit]]
        return out


def _lookup(words: list[str]) -> Lookup:
    keys = _hashes(words)
    return Lookup(keys, np.ones(len(keys)))


def _tokens(words: Words, n: int) -> np.ndarray:
    """Hashes of whole words (n = 0) or of their first n bytes, told apart by length; 0 where a word is shorter."""
    h = words.prefixes(n) if n else words.hashes
    return np.where(h == 0, h, mixed(h + np.uint64(n)))


def _sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def features(data: np.ndarray, offsets: np.ndarray, learned: Lookup) -> np.ndarray:
    """One row of FEATURES for each text."""
    small = lowered(data)
    words = words_of(small, offsets, ALNUM)
    n, size = np.diff(words.bounds), np.diff(offsets)
    each, byte = np.maximum(n, 1), np.maximum(size, 1)
    fixed = _lookup(LEXICON).of(words.hashes)
    weight = np.zeros(len(words.hashes))
    for k in BEGINNINGS:
        np.maximum(weight, learned.of(_tokens(words, k)), out=weight)
    second = _lookup(SECOND_PERSON).of(words.hashes)
    seen = np.zeros(len(second) + 1)
    np.cumsum(second, out=seen[1:])
    owner = words.owner()
    place = np.arange(len(second))
    low, high = np.maximum(place - 5, words.bounds[:-1][owner]), np.minimum(place + 6, words.bounds[1:][owner])
    near = ((fixed > 0) | (weight > 1)) & (seen[high] > seen[low])
    inner = np.zeros(len(data), dtype=bool)
    if len(data) > 2:
        letter = _LETTER[data]
        inner[1:-1] = _SIGN[data[1:-1]] & letter[:-2] & (letter[2:] | _SIGN[data[2:]])
    leet_words = words_of(np.where(inner, _LEET[data], small), offsets, ALNUM)
    leet = _sum(_lookup(LEXICON).of(leet_words.hashes), leet_words.bounds)
    upper = np.zeros(len(data) + 1)
    np.cumsum(_UPPER[data], out=upper[1:])
    length = words.ends - words.starts
    shouted = (upper[words.ends] - upper[words.starts] == length) & (length > 2)
    count = lambda mask: _sum(mask, offsets)
    top = np.zeros(len(n))
    np.maximum.at(top, owner, weight)
    fixed_n, strong_n, learned_n = _sum(fixed, words.bounds), _sum(weight > 2, words.bounds), _sum(weight > 0, words.bounds)
    columns = [
        np.log1p(n), fixed_n / each, fixed_n, _sum(weight, words.bounds) / each, learned_n / each, learned_n, strong_n, strong_n / each, top,
        _sum(near, words.bounds) / each, _sum(second, words.bounds) / each, count(_UPPER[data]) / byte, _sum(shouted, words.bounds) / each,
        count(data == 33) / byte, count(data == 63) / byte, count(_PUNCT[data]) / byte, count(inner) / each, leet,
        count((data >= 48) & (data < 58)) / byte, _sum(length, words.bounds) / each,
    ]
    return np.stack(columns, axis=1)


@trimmed
def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, class, occurrences, documents) of some texts; the class is 2 * fold + label."""
    for batch in batches:
        kind = (2 * batch.column("fold").to_numpy() + batch.column("toxic").to_numpy()).astype(np.int64)
        for first, last, data, offsets in groups(batch.column("text")):
            words = words_of(lowered(data), offsets, ALNUM)
            owner = words.owner()
            for k in BEGINNINGS:
                token = _tokens(words, k)
                real = token != 0
                both = np.unique(np.stack([token[real].view(np.int64), owner[real]]), axis=1, return_counts=True)
                keys, at = np.unique(np.stack([both[0][0], kind[first:last][both[0][1]]]), axis=1, return_inverse=True)
                at = at.ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[0]), pa.array(keys[1]),
                        pa.array(np.bincount(at, both[1], keys.shape[1]).astype(np.int64)), pa.array(np.bincount(at, minlength=keys.shape[1]).astype(np.int64)),
                    ],
                    names=["token", "kind", "occurrences", "documents"],
                )


def learn_lexica(sample: DataFrame) -> list[Lookup]:
    """Tokens that toxic texts hold far more often than their share, weighted by how much more often they occur there.

    One lexicon for each fold, learned from the others, and last one from the whole sample.
    """
    counts = sample.mapInArrow(_counts, "token long, kind long, occurrences long, documents long")
    kinds = range(2 * FOLDS)
    one = lambda c, v: F.sum(F.when(F.col("kind") == v, F.col(c)).otherwise(0)).alias(f"{c[0]}{v}")
    per = counts.groupBy("token").agg(*[one(c, v) for v in kinds for c in ("occurrences", "documents")])
    per = staged(per.where(" + ".join(f"d{v}" for v in kinds if v % 2) + " >= 2"), "toxic-tokens")
    have = {r.kind: r.n for r in sample.groupBy((2 * F.col("fold") + F.col("toxic")).alias("kind")).agg(F.count("*").alias("n")).collect()}
    out = []
    for left_out in (*range(FOLDS), None):
        good, bad = ([v for v in kinds if v // 2 != left_out and v % 2 == y] for y in (0, 1))
        n0, n1 = (sum(have.get(v, 0) for v in vs) for vs in (good, bad))
        if not n0 or not n1:
            out.append(Lookup(np.zeros(0, dtype=np.uint64), np.zeros(0)))
            continue
        share = n1 / (n0 + n1)
        total = lambda c, vs: sum((F.col(f"{c}{v}") for v in vs), F.lit(0))
        d1, d, o1, o = total("d", bad), total("d", [*good, *bad]), total("o", bad), total("o", [*good, *bad])
        striking = (d1 - d * share) / F.sqrt(d * share * (1 - share))
        ratio = F.ln((o1 + SHRINK * share) / (o + SHRINK) / share)
        top = per.where((d1 >= 2) & (striking > STRIKING) & (ratio > float(np.log(2)))).select("token", ratio.alias("ratio")).toPandas()
        keys, weights = top["token"].to_numpy(np.int64).view(np.uint64), top["ratio"].to_numpy(float)
        order = np.argsort(keys)
        out.append(Lookup(keys[order], weights[order]))
    drop_stage(per)
    return out


@dataclass
class Model:
    learned: Lookup
    trees: Boosted
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.trees.margin(x), *self.knots), 0.0, 1.0)


def _features_only(learned: Lookup):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in groups(batch.column("text")):
                x = features(data, offsets, learned)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(first, last - first) for c in ("fold", "toxic")] + [lists], names=["fold", "toxic", "x"])

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """labels: doc_id, toxic. At most sample labelled rows are broadcast, learned from and brought to the driver as features."""
    chosen = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(sample).withColumnRenamed("doc_id", "_labelled")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.expr("doc_id = _labelled"))
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = staged(rows.select("text", "toxic", F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(FOLDS)).cast("int").alias("fold")).coalesce(8), "toxic-sample")
    *partial, learned = learn_lexica(rows)
    parts = [rows.where(F.col("fold") == f).mapInArrow(_features_only(lexicon), "fold int, toxic int, x array<double>") for f, lexicon in enumerate(partial)]
    table = reduce(DataFrame.unionByName, parts).toPandas()
    drop_stage(rows)
    y = table["toxic"].to_numpy(int)
    x = np.stack(table["x"].to_list()) if len(table) else np.zeros((0, len(FEATURES)))
    order = np.lexsort((*x.T, y))
    x, y, fold = x[order], y[order], table["fold"].to_numpy()[order]
    trees = Boosted().fit(x, y)
    outside = np.full(len(y), trees.start)
    for part in range(FOLDS):
        if (fold == part).any():
            outside[fold == part] = Boosted().fit(x[fold != part], y[fold != part]).margin(x[fold == part])
    return Model(learned, trees, isotonic(outside, y))


def _scores(model: Model, keep: list[str], name: str):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.score(features(data, offsets, model.learned)) for _, _, data, offsets in groups(batch.column("text"))]
            if parts:
                kept = [batch.column(batch.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.concatenate(parts))], names=[*keep, name])

    return run


def scored(docs: DataFrame, model: Model, keep: list[str] | None = None, name: str = "toxicity_score") -> DataFrame:
    """The columns keep of docs (all by default), and one more: name, which must be none of them."""
    keep = docs.columns if keep is None else keep
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(_scores(model, keep, name), schema)


def non_toxic(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """docs that a model learned from labels scores under least; all columns stay."""
    score = unused(docs.columns, "score")
    return scored(docs, train(docs, labels), name=score).where(F.col(score) < least).drop(score)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = train(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic").where(remainder != 0))
    held_out = F.coalesce(remainder == 0, F.lit(False))
    rows = scored(docs.select("doc_id", held_out.alias("held_out"), "text"), model, ["doc_id", "held_out"], "score")
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
