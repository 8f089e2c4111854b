import hashlib
import random
import re
import time

import pytest

from eventledger.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base(text):
    out = []
    for kind, pattern in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE)):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": lambda: True,
                "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")),
                "card": lambda: 16 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 8 <= len(digits) <= 15,
            }[kind]()
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


CASES = [
    None,
    "",
    "a@b.c.d@e.f x",
    "a@b.c._x@y.z.",
    "mail me: é😀jo.e+x@ex-ample.co.uk, or 1.2.3.4.5 and 256.1.1.1 and 007.0.00.255",
    "card 4111 1111 1111 1111 ok, 4111-1111-1111-1112 no, 1 2 3",
    "call +1 (555) 010-9999. or +49 30 1234567 890 1234 56 7 or +1-2",
    "iban DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432, DE88 3704 0044 0532 0130 00",
    "my ssn is 123-45-6789 but 223-45-6789 stands in a long way off from any word that could tell what it is",
    "x@y" * 2000 + " a@b.co" * 900,
    "+1 2345678" * 500 + "😀 9.9.9.9 " * 200,
]


def test_base_spans_equal_brute_force(spark):
    rows = [(i, t, "kept") for i, t in enumerate(CASES)] + [(2, CASES[2], "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    found = pii.personal_data(docs, "doc_id").collect()
    assert len(found) == len(rows)
    for r in found:
        mine = [f"{s.kind}:{s.start}:{s.end}" for k in pii.BASE for s in r[k.name]]
        assert mine == base(CASES[r.doc_id]), r.doc_id
        for k in pii.KINDS:
            for s in r[k.name]:
                assert CASES[r.doc_id][s.start : s.end] == s.value
    by_id = {r.doc_id: r for r in found}
    assert [s.value for s in by_id[7].iban] == ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"]
    assert [s.value for s in by_id[8].ssn] == ["123-45-6789"]


@pytest.mark.parametrize("text", ["7" * 300_000, "a" * 300_000, "1 " * 150_000, "+" + "1" * 300_000 + " x", "a.b@c" * 60_000])
def test_long_runs_end_soon(spark, text):
    began = time.time()
    row = pii.personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string"), "doc_id").first()
    assert [f"{s.kind}:{s.start}:{s.end}" for k in pii.BASE for s in row[k.name]] == (base(text) if "@" in text else [])
    assert time.time() - began < 60


def test_query_on_whole_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = pii.op3_pii(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in spans) for k in ("email", "ip", "card", "phone")]
        assert r.spans.startswith(",".join(spans))


CONTEXT = {"email": "mail|contact|write|reach", "ip": r"\bip\b|host|server|address|addr", "card": "card|credit|visa|payment|account", "phone": "phone|tel|call|mobile|fax", "iban": "iban|bank|account|transfer", "ssn": "ssn|social security|tax id"}
PRIOR = {"email": 0.7, "ip": 0.55, "card": 0.65, "phone": 0.55, "iban": 0.8, "ssn": 0.35}
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")


def scored(text):
    """(kind, start, end, score) of all spans, by plain Python."""
    text, out, matches = text or "", [], {}
    for kind, pattern in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE), ("iban", IBAN), ("ssn", SSN)):
        matches[kind] = [m.span() for m in pattern.finditer(text)]
    valid = {tuple(s.split(":")) for s in base(text)}
    for kind, spans in matches.items():
        for i, (a, b) in enumerate(spans):
            value = text[a:b].replace(" ", "")
            if kind == "iban":
                ok = int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1
            else:
                ok = kind == "ssn" or (kind, str(a), str(b)) in valid
            before = text[spans[i - 1][1] if i else 0 : a][-40:]
            near = (before + " " + text[b : spans[i + 1][0] if i + 1 < len(spans) else len(text)][:24]).lower()
            score = PRIOR[kind] + 0.25 * bool(re.search(CONTEXT[kind], near)) - 0.15 * any(re.search(c, near) for k, c in CONTEXT.items() if k != kind)
            score = min(1.0, max(0.0, score))
            if ok and (kind not in ("iban", "ssn") or score >= 0.5):
                out.append((kind, a, b, round(score, 6)))
    return sorted(out)


def test_all_kinds_and_scores_equal_brute_force(spark):
    rng = random.Random(9)
    parts = ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "GB82WEST12345698765433", "FR1420041010050500013M02606", "123-45-6789", "666-45-6789", "987-65-4321", "078-05-1120", "a@b.co", "8.8.8.8", "999.1.1.1", "4111 1111 1111 1111", "+49 30 1234567",
        "my ssn", "iban", "bank transfer", "call", "mail", "host", "credit card", "tax id", "words that say nothing at all here", "é😀", "\n", ", ", "x" * 45]
    texts = [*CASES, *(" ".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(400))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.personal_data(docs, "doc_id").collect():
        found = sorted((s.kind, s.start, s.end, round(s.score, 6)) for k in pii.KINDS for s in r[k.name])
        assert found == scored(texts[r.doc_id]), texts[r.doc_id]
