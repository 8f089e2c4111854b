"""Secret scans: pattern candidates judged by a random forest, in DataFrame operations only.

A candidate is a run of at least 10 key characters with a digit, or any value of at least 4 characters right behind a
credential word and an assignment, whatever its signs: passphrases, letter-only keys, short passwords. Features: length; shares of
digits and capitals, distinct characters; transitions between characters (changes of class, and the share of neighbouring letters
that are common pairs in words); coverage by a dictionary; form (hexadecimal, path signs, prefixes of issued keys, values that stand
for a value); the document's path, where docs have one; and neighbouring words that speak for or against a secret. The forest is trained by
Spark ML from labelled findings (texts with one finding, its path and its label) and written out as SQL, so that scoring stays within the
same row expression.

Default findings come from a rule: keys, digests, encodings and passphrases in the surroundings of credentials, in assignments, headers
and connection strings, against commit ids, lock files, checksums, identifiers, file names, versions, number runs, placeholders and plain
words behind an assignment. A caller may pass findings of their own; their path may be null or left out.

Defined results: null and empty texts have no candidates, empty spans and a null score; rows are independent, so repeated rows
have repeated results; an empty table gives an empty table; without findings of both labels every candidate
scores the labelled share (0 without findings); without a path the path's features are 0. Only text and the named columns are read.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, staged
from .pii import located, quoted

_KEY = "A-Za-z0-9+/_=-"
#: A credential word and an assignment, up to where the value begins.
_CREDENTIAL = r"(?:token|secret|passw(?:or)?d|passphrase|pwd|(?:api|access|auth|private|secret)[ _-]?key|auth|credentials?)[\"']?[ ]{0,2}(?::=|=>|=|:)[ ]{0,2}"
#: The short look behind comes first, since it fails at most places.
_ASSIGNED = rf"(?<=[=:>][ \"']{{0,3}})(?<=(?i:{_CREDENTIAL})[\"']?)[^\s\"'`,;<>()=:][^\s\"'`,;<>()]{{2,}}[^\s\"'`,;<>().!?]"
CANDIDATE = rf"(?<![{_KEY}])(?=[A-Za-z+/_=-]*+[0-9])[{_KEY}]{{10,}}+|{_ASSIGNED}"
#: Findings of the default rule, trees, depth; a score of LEAST or more is a secret.
FINDINGS, TREES, LEVELS, LEAST = 4400, 15, 7, 0.5

#: Common words and word parts, for dictionary coverage; longer ones are tried first.
WORDS = """access account action address admin after allow archive array author batch before block build button cache call change check class client close cloud code color
    commit config connect content copy count create current custom data default delete demo device direct display document domain edit email engine error event example
    export field file filter folder form format from function get global group head help host image import index info input install item key label layer level line link
    list load local log login main member message method mode model module name network node number object open option order output page panel path print process project
    public query read record release report request result return root row sample save schema screen script search section select send server service session set share
    size source start state static status stream string style support switch system table target task test text time title token type update upload user value version
    view web window your ing ion ent ter con ver ment able""".split()
#: Common pairs of letters within words.
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur ca el ta la ns di fo ho pe ec pr no ct us ac ot il tr ly nc et ut ss so rs un lo wa ge ie wh ee wi em ad ol rt po we na ul ni ts mo ow pa im mi ai sh ir su id os iv ia am fi ci vi pl ig tu ev ld ry mp fe bl ab gh ty op wo sa ay ex ke fr oo av ag if ap gr od bo sp rd do uc bu ei ov by rm ep tt oc fa ef cu rn sc gi da yo cr cl du ga qu ue ff ba ey ls va um pp ua up lu go ht ru ug ds lt pi rc rr eg au ck ew mu br bi pt ak pu ui rg ib tl ny ki rk ys ob mm fu ph og ms ye ud mb ip ub oi rl gu dr hr cc tw ft wn nu af hu nn eo vo rv nf xp gn sm fl iz ok nl my gl aw ju oa eq sy sl ps jo lf nv je nk kn gs dy hy ze ks xt bs ik dd pm bb".split()[:190]
FOR = r"token|secret|passw|pwd|api[ _-]?key|auth|credential|private|bearer|login|://[a-z0-9_]+:"
AGAINST = r"sha-?(1|256|384|512)|md5|checksum|digest|integrity|commit|revision|uuid|guid|etag|hash|version|order|isbn|doi|fingerprint|resolved|nonce|color"
#: Beginnings of keys as their issuers write them (fixed values).
ISSUED = r"^(AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|xox[abprs]-|sk_live_|rk_live_|AIza|ya29|eyJ[A-Za-z0-9_-]{8}|SG[.]|npm_|pypi-|dop_v1_)"
#: Paths that often hold secrets, and paths of tests, documentation and generated files.
PATH_FOR, PATH_AGAINST = r"(^|/)[.]env|config|settings|secret|credential|deploy|prod|[.](env|ini|cfg|conf|pem|key|tfvars|properties)$", r"test|spec|mock|fixture|example|sample|docs?/|readme|vendor|node_modules|[.](lock|sum|svg|min[.]js|map|md)$"

#: Values that stand for a value.
STANDS_FOR = r"^(none|null|nil|true|false|yes|no|empty|required|optional|string|text|field|basic|bearer|enabled|disabled|invalid|missing|expired|unknown|please|hidden|request|response|header|value)$|your|example|change_?me|placeholder|redacted|dummy|xxx|[*]{3}|environ|getenv|self[.]|[$%{]"

#: Feature name and SQL over y.value and y.near.
FEATURES = {
    "length": "length(y.value)",
    "digits": "regexp_count(y.value, '[0-9]') / length(y.value)",
    "capitals": "regexp_count(y.value, '[A-Z]') / length(y.value)",
    "changes": "regexp_count(y.value, '[a-z](?=[^a-z])|[A-Z](?=[^A-Z])|[0-9](?=[^0-9])') / length(y.value)",
    "pairs": f"regexp_count(lower(y.value), '(?=(?:{'|'.join(PAIRS)}))') / greatest(1, length(y.value) - 1)",
    "hexadecimal": "case when y.value rlike '^[0-9a-f]+$' then 1 else 0 end",
    "distinct_chars": "size(array_distinct(split(y.value, ''))) / length(y.value)",
    "dictionary": f"1 - length(regexp_replace(lower(y.value), '{'|'.join(sorted(WORDS, key=lambda w: (-len(w), w)))}', '')) / length(y.value)",
    "issued": f"case when y.value rlike {quoted(ISSUED)} then 1 else 0 end",
    "path_for": f"case when lower(path) rlike {quoted(PATH_FOR)} then 1 else 0 end",
    "path_against": f"case when lower(path) rlike {quoted(PATH_AGAINST)} then 1 else 0 end",
    "path_signs": "regexp_count(y.value, '[/_-]') / length(y.value)",
    "letter_run": "coalesce(array_max(transform(regexp_extract_all(y.value, '[A-Za-z]+', 0), z -> length(z))), 0) / length(y.value)",
    "words_for": f"case when y.near rlike {quoted(FOR)} then 1 else 0 end",
    "words_against": f"case when y.near rlike {quoted(AGAINST)} then 1 else 0 end",
    "stands_for": f"case when lower(y.value) rlike {quoted(STANDS_FOR)} then 1 else 0 end",
    "credential": f"case when y.near rlike {quoted(_CREDENTIAL + chr(91) + chr(34) + chr(39) + chr(93) + '? ')} then 1 else 0 end",
    "assigned": r"case when y.near rlike '[=:][ \"\']{0,2} ' then 1 else 0 end",
}


def candidates(docs: DataFrame, *keep: str, path: str | None = None) -> DataFrame:
    """The columns keep, and cand: array<struct<start, end, value, features...>>. path: the column of docs that has a document's path."""
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path else F.lit("")
    rows = docs.select(*keep, F.coalesce("text", F.lit("")).alias("text"), where.alias("path"))
    none = "cast(array() as array<string>)"
    pattern = quoted(CANDIDATE)
    rows = rows.withColumn("m", F.expr(f"case when text rlike '[0-9=:]' then regexp_extract_all(text, {pattern}, 0) else {none} end"))
    rows = rows.withColumn("p", F.expr(f"case when size(m) > 0 then split(text, {pattern}, -1) else {none} end"))
    fields = ", ".join(f"'{k}', cast({v} as double)" for k, v in FEATURES.items())
    made = f"transform({located('m', 'p')}, y -> named_struct('start', y.start, 'end', y.end, 'value', y.value, {fields}))"
    kinds = ", ".join(f"{k} double" for k in FEATURES)
    empty = f"cast(array() as array<struct<start bigint, end bigint, value string, {kinds}>>)"
    return rows.select(*keep, F.expr(f"case when size(m) > 0 then {made} else {empty} end").alias("cand"))


def default_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """text, path, label: one finding a text, by rule; every third has no path."""
    hexa, wide = "sha1(cast(id as string))", "sha2(cast(id as string), 256)"
    coded = f"base64(unhex({wide}))"
    plain = f"translate({coded}, '+/=', 'xYz')"
    letters = f"translate({coded}, '+/=0123456789', 'kQzRwXbTgYmVp')"
    pick = lambda step, *words: f"element_at(array({', '.join(map(repr, words))}), cast(1 + id div (SHAPES * {step}) % {len(words)} as int))"  # noqa: E731 (texts take turns)
    some = ("correct", "Purple", "horse", "Monkey", "dragon", "Winter", "battery", "summer", "Coffee", "sun", "Rocket", "blue")
    word, camel = pick(1, *some), f"concat({pick(1, *some)}, initcap({pick(12, *some)}), initcap({pick(5, *some)}))"
    name = pick(1, "token", "secret", "api_key", "auth_token", "client_secret", "access_key", "private_key", "password")
    sign = pick(3, " = \"", "=", ": ", ": \"", " := \"")
    true = [
        f"concat('set ', {name}, {sign}, {hexa}, '\" now')",
        f"concat({name}, '=', substr({hexa}, 1, cast(12 + id % 13 as int)), ' and more')",
        f"concat({name}, {sign}, {plain}, '\" in use')",
        f"concat('the client secret is \"', substr({coded}, 1, 32), '\" kept')",
        f"concat('aws key AKIA', upper(translate(substr({wide}, 1, 15), '0189', 'WXYZ')), '7 was found')",
        f"concat({name}, ' = ', substr({plain}, 1, 40))",
        f"concat('password=', substr({letters}, 1, cast(12 + id % 13 as int)), ' and more')",
        f"concat({name}, ': \"', substr({letters}, 1, 20), '\" in use')",
        f"concat('password=', {camel}, ' is set')",
        f"concat('password: ', {word}, cast(id % 97 as string), ' for the login')",
        f"concat('pwd = \"', substr({letters}, 1, cast(6 + id % 5 as int)), '\" there')",
        f"concat('password=', {word}, cast(id % 97 as string), ' was leaked')",
        f"concat('use ghp_', substr({plain}, 1, 36), ' to push')",
        f"concat('Authorization: Bearer eyJ', {plain}, substr({plain}, 3, 20), ' sent')",
        f"concat('open postgres://admin:', substr({plain}, 2, 18), '@db.internal/app')",
        f"concat('slack xoxb-', cast(100000000000 + id as string), '-', substr({plain}, 1, 24), ' posts')",
        f"concat('export SERVICE_TOKEN=', substr({plain}, 4, 28), ' then start')",
        f"concat('sk_live_', substr({plain}, 1, 24), ' charges cards')",
        f"concat('\"private_key_id\": \"', substr({wide}, 1, 40), '\", next')",
        f"concat('login with credentials ', substr({plain}, 1, 22), '9 please')",
    ]
    false = [
        f"concat('see commit ', {hexa}, ' for this')",
        f"concat('sha256: ', {wide}, ' of it')",
        f"concat('id ', substr({wide}, 1, 8), '-', substr({wide}, 9, 4), '-4', substr({wide}, 14, 3), '-a', substr({wide}, 18, 3), '-', substr({wide}, 21, 12), ' seen')",
        "concat('from /usr/lib/python3/dist-packages/module', cast(id as string), ' loaded')",
        "concat('release-', cast(2000 + id % 30 as string), '-01-15-build', cast(id as string), ' is out')",
        "concat('order number ', cast(1000000000 + id * 7919 as string), ' sent')",
        "concat('token = \"your-token-here-', cast(id % 100 as string), '\" as example')",
        "concat('password=changeme12345', ' please')",
        "concat('a configuration', cast(id as string), 'file_of_tests here')",
        "concat('call ', cast(4900000000000 + id * 104729 as string), ' today')",
        f"concat('etag ', substr({hexa}, 1, 32), ' cached')",
        f"concat('password: ', {pick(1, 'required', 'string', 'please', 'none', 'true', 'hidden', 'field', 'missing')}, ' in this form')",
        f"concat('token = ', {pick(1, 'None', 'null', 'request', 'self.token', 'os.environ', 'string', 'value')}, ' here')",
        f"concat('secret: ', {pick(1, 'this', 'that', 'they', 'when', 'with', 'there', 'after', 'which')}, ' and so on')",
        f"concat('password = \"', {pick(1, 'your_password', 'changeme', 'xxxxxxxx', '********', 'example', 'placeholder')}, '\" as example')",
        f"concat('auth: ', {pick(1, 'basic', 'bearer', 'enabled', 'invalid', 'expired', 'unknown')}, ' in the log')",
        f"concat('integrity sha512-', {plain}, substr({plain}, 1, 40), ' resolved')",
        f"concat('static/js/main-', substr({hexa}, 1, 20), ' loaded')",
        f"concat('image data ', {coded}, {coded}, {coded}, ' shown')",
        f"concat('fingerprint ', substr({wide}, 1, 32), ' of the host')",
        "concat('get_user_by_id_and_name_v', cast(id % 50 as string), '_with_default called')",
        "concat('UPPER_CASE_CONSTANT_NUMBER_', cast(id % 1000 as string), ' is set')",
        "concat('the year 2024-01-', cast(10 + id % 20 as string), '-12-30-00 passed')",
        f"concat('session_nonce revision ', substr({plain}, 1, 16), '4 rolled')",
    ]
    texts, paths = [(x, 1) for x in true] + [(x, 0) for x in false], {}
    paths[1] = pick(2, "config/prod.env", "deploy/secrets.yml", "app/settings.py", ".env", "src/main.py", "infra/main.tfvars", "test/unit.py", "notes.txt")
    paths[0] = pick(2, "package-lock.json", "yarn.lock", "docs/guide.md", "test/fixtures/a.json", "src/util.py", "README.md", "vendor/x.min.js", "config/app.ini")
    cases = " ".join(f"when {i} then named_struct('text', {x}, 'path', if(id div {len(texts)} % 3 = 0, null, {paths[y]}), 'label', {y})" for i, (x, y) in enumerate(texts))
    made = f"case id % {len(texts)} {cases} end".replace("SHAPES", str(len(texts)))
    return spark.range(0, n, 1, 2).select(F.expr(made).alias("f")).select("f.*")


def _tree_sql(lines: list[str], names: list[str]) -> str:
    """SQL of a tree from Spark ML's description, read from the front."""
    line = lines.pop(0)
    if line.startswith("Predict"):
        return f"{float(line.split(':')[1])}D"
    _, number, _, cut = line[line.index("(") + 1 : -1].split(" ")
    left = _tree_sql(lines, names)
    lines.pop(0)  # the line that starts with Else
    return f"case when y.{names[int(number)]} <= {cut}D then {left} else {_tree_sql(lines, names)} end"


def forest_sql(findings: DataFrame, trees: int = TREES, depth: int = LEVELS) -> str:
    """SQL over a candidate y: the share of trees that call it a secret."""
    names = list(FEATURES)
    found = findings.select("text", "label", (F.col("path") if "path" in findings.columns else F.lit(None).cast("string")).alias("path"))
    one = candidates(found, "label", path="path").where("size(cand) > 0").select(F.col("label").cast("double").alias("label"), F.expr("cand[0]").alias("y"))
    one = staged(one.select("label", *[f"y.{x}" for x in names]).where("label in (0, 1)"), "findings")
    counts = one.agg(F.count("*").alias("n"), F.sum("label").alias("bad")).first()
    if not counts.n or counts.bad in (0, counts.n):
        return f"{(counts.bad or 0) / max(counts.n, 1)}D"
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(one).select("label", "features")
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, featureSubsetStrategy="sqrt").fit(rows)
    parts = []
    for text in model.toDebugString.split("  Tree ")[1:]:
        lines = [x.strip() for x in text.split("\n")[1:] if x.strip()]
        parts.append(_tree_sql(lines, names))
    return "(" + " + ".join(parts) + f") / {len(parts)}D"


def secrets(docs: DataFrame, findings: DataFrame | None = None, *keep: str, path: str | None = None) -> DataFrame:
    """The columns keep, and found: array<struct<start, end, value, score>> of all candidates; path: the column with a document's path."""
    score = forest_sql(default_findings(docs.sparkSession) if findings is None else findings)
    found = F.expr(f"transform(cand, y -> named_struct('start', y.start, 'end', y.end, 'value', y.value, 'score', round({score}, 6)))")
    return candidates(docs, *keep, path=path).select(*keep, found.alias("found"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets(read(spark, sf_dir, "documents"), None, "doc_id")
    hits = F.filter("found", lambda y: y.score >= LEAST)
    spans = F.array_join(F.transform(hits, lambda y: F.concat(y.start.cast("string"), F.lit(":"), y.end.cast("string"))), ",")
    return rows.select(
        "doc_id",
        F.size("found").cast("long").alias("n_candidates"),
        F.size(hits).cast("long").alias("n_secrets"),
        spans.alias("spans"),
        F.array_max(F.transform("found", lambda y: y.score)).alias("max_score"),
    )
