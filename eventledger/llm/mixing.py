"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Each document gets an exponential key -ln(u)/w, u a hash of its id and text and w its quality weight. Within a
source documents are taken in key order until the prefix sum of their sizes meets the source's budget; of
the document at which it ends, the query counts only the words that the budget leaves, and the pipeline
takes it whole if at least half fits.
Budgets over the source's size first take complete epochs; the rest is selected by key.

No source is gathered in one task: keys fall into cells by the key's own distribution, cells are summed per source, and the
one cell in which the budget ends is divided again, LEVELS times. Of the last cell's rows equal ones are added up before they are ordered.

Defined results: a null text has size 0, a null source is a source of its own (last), a source without
words has target 0, documents without words are never taken; rows with equal id, text and source follow each other,
and if the budget ends among them, so many of them are taken as it allows, no matter which; empty tables give empty tables. Only the
named columns are read, so other columns can't clash. Sources themselves are ordered in one task, one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, staged

#: Parameters of the registered query.
WEIGHTS = (5, 2, 1)
SHARE, LIMIT, SEED = 1.5, 2.0, "mix-1"
#: Parts that a cell is divided into, and how often.
CELLS, LEVELS = 1024, 3
#: Signs whose share lowers a document's quality weight, down to a half.
NOISE = "#$%*&|{}<>^~"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """0.5 to 1: the more noise signs, the less."""
    n = F.length(text)
    share = (n - F.length(F.translate(text, NOISE, ""))) / F.greatest(n, F.lit(1))
    return F.coalesce(1 - 0.5 * F.least(F.lit(1.0), 5 * share), F.lit(1.0))


def digest(doc_id: Column, text: Column, seed: str) -> Column:
    """Hex digest of the seed, id and text: where u comes from, and the order of rows with equal keys."""
    text = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), text).cast("binary"))


def key_of(mark: Column, weight: Column) -> Column:
    """The exponential key, from 48 bits of the digest."""
    u = (F.conv(F.substring(mark, 1, 12), 16, 10).cast("long") + 0.5) / float(1 << 48)
    return -F.ln(u) / weight


def keyed(docs: DataFrame, seed: str = SEED, weight: Column | None = None) -> DataFrame:
    """doc_id, source, size, mark and key of each row."""
    w = quality_weight(F.col("text")) if weight is None else weight
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), digest(F.col("doc_id"), F.col("text"), seed).alias("mark"), w.alias("w"))
    return rows.select("doc_id", "source", "size", "mark", key_of(F.col("mark"), F.col("w")).alias("key"))


def targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """source, source_size, target: one row a source.

    Sources in order of need (limit over weight) are filled to their limit while the common level reaches
    it; the others share what is left by weight. This is where resharing the excess again and again ends.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), turn + 1))
    per = per.withColumn("cap", F.col("source_size") * limit)
    need = Window.orderBy((F.col("cap") / F.col("w")), F.col("source").asc_nulls_last())
    before = need.rowsBetween(Window.unboundedPreceding, -1)
    onward = need.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = need.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("budget", F.sum("source_size").over(everything) * share)
    left = F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    per = per.withColumn("full", left / F.sum("w").over(onward) >= F.col("cap") / F.col("w"))
    free_w = F.sum(F.when(~F.col("full"), F.col("w")).otherwise(0.0)).over(everything)
    used = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(everything)
    level = (F.col("budget") - used) / free_w
    return per.select(
        "source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.round(level * F.col("w"), 6)).alias("target")
    )


def thresholds(sized: DataFrame, target: DataFrame) -> DataFrame:
    """source, source_size, target, epochs and where fractional selection ends.

    last_key, last_mark: the last rows taken; there are ties equal ones, and room words are left for them.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = target.withColumn("epochs", whole).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    rows = sized.where("size > 0").select("source", "size", "key", "mark", F.least(1 - F.exp(-F.col("key")), F.lit(1 - 2.0**-53)).alias("at"))
    edge = goal.where("rest > 0").select("source", "rest", F.lit(0).cast("long").alias("cell"), F.lit(0).cast("long").alias("base"))
    cell = lambda level: F.floor(F.col("r.at") * float(CELLS**level)).cast("long")
    inside = lambda level: rows.alias("r").join(edge.alias("e"), F.expr("r.source <=> e.source") & (cell(level) == F.col("e.cell")))
    ordered = Window.partitionBy("source").rowsBetween(Window.unboundedPreceding, 0)
    for level in range(LEVELS):
        mass = inside(level).groupBy("r.source", cell(level + 1).alias("cell"), "e.rest", "e.base").agg(F.sum("r.size").alias("mass"))
        mass = mass.withColumn("base", F.col("base") + F.sum("mass").over(ordered.orderBy("cell")) - F.col("mass"))
        edge = mass.where("rest > base and rest <= base + mass").select("source", "rest", "cell", "base")
    tied = inside(LEVELS).groupBy("r.source", "r.key", "r.mark", "e.rest", "e.base").agg(F.sum("r.size").alias("mass"), F.count("*").alias("ties"))
    before = F.col("base") + F.sum("mass").over(ordered.orderBy("key", "mark")) - F.col("mass")
    last = tied.withColumn("before", before).where("rest > before and rest <= before + mass").alias("t")
    return goal.alias("g").join(last, F.expr("g.source <=> t.source"), "left").select(
        "g.source", "g.source_size", "g.target", "g.epochs", F.col("t.key").alias("last_key"), F.col("t.mark").alias("last_mark"),
        "t.ties", F.floor(F.col("t.rest") - F.col("t.before")).alias("room"),
    )


def placed(rows: DataFrame, edge: DataFrame) -> DataFrame:
    """Of rows (row, source, size, key, mark): row, size, the thresholds e of its source, is it before the last rows taken, its rank among them.

    Where these are single rows, as they are unless ids repeat or are null, there is nothing to order. Else they are staged with the
    number of the task that wrote them; ranks are those within a task's rows after the counts of the tasks before.
    """
    both = rows.alias("d").join(edge.alias("e"), F.expr("d.source <=> e.source"))
    same = F.col("d.key") == F.col("e.last_key")
    before = (F.col("d.key") < F.col("e.last_key")) | (same & (F.col("d.mark") < F.col("e.last_mark")))
    false = F.lit(False)
    both = both.select("d.row", "d.size", F.struct("e.*").alias("e"), F.coalesce(before, false).alias("before"), F.coalesce(same & (F.col("d.mark") == F.col("e.last_mark")), false).alias("among"))
    none, one = F.lit(None).cast("long"), F.lit(1).cast("long")
    if edge.where("ties > 1").isEmpty():
        return both.withColumn("rank", F.when(F.col("among"), one).otherwise(none)).drop("among")
    tied = staged(both.where("among").withColumn("task", F.spark_partition_id()), "mix-ties")
    per = tied.groupBy(F.col("e.source").alias("source"), "task").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("source").orderBy("task").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    per = per.select("source", "task", earlier.alias("earlier")).alias("p")
    here = F.row_number().over(Window.partitionBy("e.source", "task").orderBy(one)).cast("long")
    tied = tied.withColumn("here", here).alias("t").join(per, F.expr("t.e.source <=> p.source and t.task = p.task"))
    rest = both.where("not among").select("row", "size", "e", "before", none.alias("rank"))
    return rest.unionByName(tied.select("t.row", "t.size", "t.e", "t.before", (F.col("t.here") + F.col("p.earlier")).alias("rank")))


def words_taken() -> Column:
    """Words taken of a row of placed(): whole epochs, then all of it, or of the last ones what the budget leaves."""
    size = F.col("size")
    left = F.least(size, F.greatest(F.lit(0).cast("long"), F.col("e.room") - (F.col("rank") - 1) * size))
    return size * F.col("e.epochs") + F.when(F.col("before"), size).when(F.col("rank").isNotNull(), left).otherwise(F.lit(0).cast("long"))


def copies() -> Column:
    """Whole copies of a row of placed(): one of the last ones counts if at least half of it is in the budget."""
    fits = F.coalesce(2 * (F.col("e.room") - (F.col("rank") - 1) * F.col("size")) >= F.col("size"), F.lit(False))
    return F.when(F.col("size") > 0, F.col("e.epochs") + (F.col("before") | fits).cast("long")).otherwise(F.lit(0).cast("long"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, limit: float = LIMIT, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, mark, key of each document; thresholds of each source), both staged."""
    sized = staged(keyed(docs, seed), "mix-sized")
    return sized, staged(thresholds(sized, targets(sized, weights, share, limit)), "mix-edge")


def mixed_documents(docs: DataFrame, seed: str = SEED, **params) -> DataFrame:
    """docs, each row as often as the mix takes it (0 to limit times); all columns stay.

    The thresholds are one row a source; Spark broadcasts them while they are under its size threshold
    and joins by shuffle beyond it. The texts themselves are never sorted.
    """
    _, edge = mix(docs, seed=seed, **params)
    # Size, mark and key are columns below the join and nothing filters on them, so that each is computed once a row.
    rows = docs.select(F.struct("*").alias("row"), "source", word_count(F.col("text")).alias("size"), digest(F.col("doc_id"), F.col("text"), seed).alias("mark"), quality_weight(F.col("text")).alias("w"))
    rows = rows.select("row", "source", "size", "mark", key_of(F.col("mark"), F.col("w")).alias("key"))
    out = placed(rows, edge).select("row", F.explode(F.array_repeat(F.lit(1), copies().cast("int"))))
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized, edge = mix(read(spark, sf_dir, "documents"))
    rows = placed(sized.select(F.col("doc_id").alias("row"), "source", "size", "key", "mark"), edge)
    return rows.select(F.col("row").alias("doc_id"), "size", "e.source_size", "e.target", words_taken().alias("taken"))


#: The same mix by plain windows over whole sources.
ORACLE = f"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
    md5('{SEED}:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) as mark,
    -ln((('0x' || substr(mark, 1, 12))::bigint + 0.5) / 281474976710656.0::double)
      / coalesce(1 - 0.5 * least(1.0::double, 5 * (length(text) - length(translate(text, '{NOISE}', '')))::double / greatest(length(text), 1)), 1.0) as key
  from documents),
p as (select source, sum(size)::bigint as source_size,
    case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as w
  from d group by source),
q as (select *, 2.0::double * source_size as cap, {SHARE}::double * sum(source_size) over () as budget from p),
r as (select *, (budget - coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0.0))
    / sum(w) over (order by cap / w, source nulls last rows between current row and unbounded following) >= cap / w as filled from q),
t as (select source, source_size, case when filled then cap else round((budget - sum(case when filled then cap else 0 end) over ())
    / sum(case when filled then 0 else w end) over () * w, 6) end as target from r),
g as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as epochs from t),
x as (select d.doc_id, d.size, g.source_size, g.target, g.epochs,
    g.target - g.epochs * g.source_size
      - (sum(d.size) over (partition by d.source order by d.key, d.mark rows between unbounded preceding and current row) - d.size) as room
  from d join g on d.source is not distinct from g.source)
select doc_id, size, source_size, target, (size * epochs + greatest(0, least(size, floor(room)::bigint)))::bigint as taken from x
"""
