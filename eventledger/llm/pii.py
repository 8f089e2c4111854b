"""Personal data: regular expressions propose spans, validators confirm them, context words adjust scores.

DataFrame functions only. A text is split at the matches of a kind; piece and match lengths, summed in
blocks, give the positions in code points in linear time. Alternations that Java would run recursively or
from each start of a run anew are possessive or anchored at the start of the run; what they match is the same.

Kinds: email, ip, card, phone (the contract's), then iban (mod-97) and ssn (fixed ranges, kept only
where a context word stands nearby). A span's score starts at its kind's prior; a context word within 40
characters before or 24 after raises it by 0.25, a context word of another kind lowers it by 0.15.

Defined results: null and empty texts have no spans, the digest of the empty string and spans ''. Rows are
independent, so repeated rows give repeated results. Only doc_id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

LOCAL = "A-Za-z0-9._%+-"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: Cheap necessary condition on the text.
    gate: str
    #: Confirms a match, given as the SQL variable x.
    valid: str
    prior: float
    #: Words nearby that speak for the kind.
    context: str
    #: Spans under this score are dropped; 0 for base kinds.
    least: float = 0.0


_DIGITS = "regexp_replace(x, '[^0-9]', '')"
_PART = "length(ltrim('0', q)) <= 3 and coalesce(try_cast(q as int), 0) <= 255"
_IBAN = "regexp_replace(x, ' ', '')"
_MOD97 = f"""aggregate(split(concat(substr({_IBAN}, 5), substr({_IBAN}, 1, 4)), ''), 0, (a, c) ->
  case when c = '' then a when c between '0' and '9' then (a * 10 + cast(c as int)) % 97 else (a * 100 + ascii(c) - 55) % 97 end)"""

KINDS = (
    Kind("email", rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(text, '@')", "true", 0.7, "mail|contact|write|reach"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", r"text rlike '[0-9]\\.[0-9]++\\.[0-9]++\\.[0-9]'", f"forall(split(x, '[.]'), q -> {_PART})", 0.55, r"\bip\b|host|server|address|addr"),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", "text rlike '[0-9](?:[ -]?[0-9]){15}'", f"length({_DIGITS}) between 16 and 19 and luhn_check({_DIGITS})", 0.65, "card|credit|visa|payment|account"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "contains(text, '+')", f"length({_DIGITS}) between 8 and 15", 0.55, "phone|tel|call|mobile|fax"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "text rlike '[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}'", f"{_MOD97} = 1", 0.8, "iban|bank|account|transfer", 0.5),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "text rlike '[0-9]{3}-[0-9]{2}-[0-9]{4}'", "true", 0.35, "ssn|social security|tax id", 0.5),
)
BASE = KINDS[:4]
BLOCK = 64


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def located(m: str, p: str) -> str:
    """SQL for array<struct<start, end, value, near>> from an array of matches and one of the parts between them."""
    step = f"transform({m}, (x, i) -> cast(length({p}[i]) + length(x) as bigint))"
    sums = f"transform(sequence(0, (size({m}) - 1) div {BLOCK}), g -> aggregate(slice(s.step, cast(g * {BLOCK} + 1 as int), {BLOCK}), 0L, (a, b) -> a + b))"
    before = "transform(t.sums, (x, g) -> aggregate(slice(t.sums, 1, g), 0L, (a, b) -> a + b))"
    end = f"u.before[i div {BLOCK}] + aggregate(slice(u.step, cast((i div {BLOCK}) * {BLOCK} + 1 as int), cast(i % {BLOCK} + 1 as int)), 0L, (a, b) -> a + b)"
    near = f"lower(concat(right({p}[i], 40), ' ', left({p}[i + 1], 24)))"
    return f"""
      transform(array(named_struct('step', {step})), s ->
        transform(array(named_struct('step', s.step, 'sums', {sums})), t ->
          transform(array(named_struct('step', t.step, 'before', {before})), u ->
            transform({m}, (x, i) -> named_struct('start', {end} - length(x), 'end', {end}, 'value', x, 'near', {near}))
          )[0])[0])[0]"""


def _spans(kind: Kind) -> Column:
    """array<struct<kind, start, end, value, score>> from the columns m and p of the kind."""
    m, p, n = f"m_{kind.name}", f"p_{kind.name}", kind.name
    others = "|".join(k.context for k in KINDS if k.name != n)
    bonus = f"case when y.near rlike {quoted(kind.context)} then 0.25D else 0D end"
    malus = f"case when y.near rlike {quoted(others)} then 0.15D else 0D end"
    score = f"least(1D, greatest(0D, {kind.prior}D + {bonus} - {malus}))"
    scored = f"transform({located(m, p)}, y -> named_struct('kind', '{n}', 'start', y.start, 'end', y.end, 'value', y.value, 'score', {score}))"
    empty = "cast(array() as array<struct<kind string, start bigint, end bigint, value string, score double>>)"
    kept = f"filter({scored}, y -> y.score >= {kind.least}D and transform(array(y.value), x -> {kind.valid})[0])"
    return F.expr(f"case when size({m}) > 0 then {kept} else {empty} end").alias(n)


def personal_data(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns named in keep, and for each kind an array of spans (kind, start, end, value, score)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*keep, text.alias("text"))
    none = "cast(array() as array<string>)"
    for k in KINDS:
        pattern = quoted(k.pattern)
        rows = rows.withColumn(f"m_{k.name}", F.expr(f"case when {k.gate} then regexp_extract_all(text, {pattern}, 0) else {none} end"))
    for k in KINDS:
        rows = rows.withColumn(f"p_{k.name}", F.expr(f"case when size(m_{k.name}) > 0 then split(text, {quoted(k.pattern)}, -1) else {none} end"))
    return rows.select(*keep, *[_spans(k) for k in KINDS])


def _joined(spans: str) -> str:
    return f"array_join(transform({spans}, y -> concat(y.kind, ':', cast(y.start as string), ':', cast(y.end as string))), ',')"


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(read(spark, sf_dir, "documents"), "doc_id")
    base, added = ", ".join(k.name for k in BASE), ", ".join(k.name for k in KINDS)
    return found.select(
        "doc_id",
        *[F.size(k.name).cast("long").alias(f"n_{k.name}") for k in BASE],
        F.sha2(F.expr(_joined(f"concat({base})")).cast("binary"), 256).alias("base_sha256"),
        F.expr(_joined(f"concat({added})")).alias("spans"),
        *[F.size(k.name).cast("long").alias(f"n_{k.name}") for k in KINDS if k not in BASE],
        F.expr(f"round(aggregate(concat({added}), 0D, (a, y) -> a + y.score), 6)").alias("score_sum"),
    )
