"""Column expressions of the message layer: keys, subjects, wire formats, validity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def dedup_key(table: Column, id_: Column, index: Column) -> Column:
    return F.concat_ws(":", table, id_.cast("string"), index.cast("string"))


def rendered(template: Column, **values: Column) -> Column:
    """A template with `{name}` replaced; a null value is empty."""
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def subject_spec(fixed: Column, template: Column) -> Column:
    return F.coalesce(F.nullif(fixed, F.lit("")), F.nullif(template, F.lit("")), F.lit("{outbox}.{op}"))


def native_encode(id_: Column, op: Column, table: Column, payload: Column) -> Column:
    return F.concat(F.lit('{"outbox_id":'), id_, F.lit(',"op":"'), op, F.lit('","stream_table":"'), table, F.lit('","payload":'), payload, F.lit("}"))


def cloudevents_encode(id_: Column, op: Column, table: Column, payload: Column, at: Column) -> Column:
    time = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.concat(
        F.lit('{"specversion":"1.0","id":"'), table, F.lit(":"), id_, F.lit('","type":"io.ledger.'), op, F.lit('","source":"/outbox/'), table,
        F.lit('","time":"'), time, F.lit('","data":'), payload, F.lit("}"),
    )


def identifier_valid(name: Column) -> Column:
    size = F.octet_length(name)
    return size.between(1, 63) & ~name.contains('"') & ~name.contains("\0")


def subject_valid(subject: Column) -> Column:
    """No empty token; `*` and `>` stand alone, `>` only at the end."""
    tokens = F.split(subject, r"\.")
    last = F.size(tokens) - 1
    ok = F.transform(tokens, lambda t, i: (t != "") & (~t.contains("*") | (t == "*")) & (~t.contains(">") | ((t == ">") & (i == last))))
    return F.forall(ok, lambda x: x)


#: Names that a webhook must never reach, beside private and local addresses (fixed values).
FORBIDDEN = (
    "localhost", "localhost.localdomain", "ip6-localhost", "ip6-loopback", "metadata", "metadata.google.internal",
    "metadata.azure.com", "instance-data.ec2.internal",
)


def _number(text: Column, base: int = 10) -> Column:
    return F.conv(text, base, 10).cast("int")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def ipv4_octets(host: Column) -> Column:
    """The four numbers of a dotted address; null if it is none."""
    octets = F.when(host.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), F.transform(F.split(host, r"\."), lambda o: _number(o)))
    return _let(octets, lambda v: F.when(F.forall(v, lambda o: o <= 255), v))


def ipv6_groups(host: Column) -> Column:
    """The eight numbers of an address without its brackets; null if it is none. A dotted end counts as two groups."""
    pair = lambda v, i: F.lower(F.hex(F.element_at(v, i) * 256 + F.element_at(v, i + 1)))
    end = ipv4_octets(F.regexp_extract(host, r"^.*:([0-9.]+)$", 1))
    plain = _let(end, lambda v: F.when(v.isNull(), host).otherwise(F.concat(F.regexp_extract(host, r"^(.*:)[0-9.]+$", 1), pair(v, 1), F.lit(":"), pair(v, 3))))
    groups = lambda side: F.filter(F.split(F.coalesce(side, F.lit("")), ":", -1), lambda g: side != "")

    def whole(sides: Column) -> Column:
        both = F.struct(groups(F.get(sides, F.lit(0))).alias("l"), groups(F.get(sides, F.lit(1))).alias("r"), F.size(sides).alias("n"))
        missing = lambda b: F.lit(8) - F.size(b.l) - F.size(b.r)
        return _let(both, lambda b: F.when((b.n == 1) & (missing(b) == 0), b.l).when((b.n == 2) & (missing(b) >= 1), F.concat(b.l, F.array_repeat(F.lit("0"), missing(b)), b.r)))

    found = _let(F.split(plain, "::", -1), whole)
    return _let(found, lambda v: F.when(F.forall(v, lambda g: g.rlike("^[0-9A-Fa-f]{1,4}$")), F.transform(v, lambda g: _number(g, 16))))


def _private_ipv4(o: Column) -> Column:
    a, b, c = (F.element_at(o, i) for i in (1, 2, 3))
    return (
        a.isin(0, 10, 127) | (a >= 224) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b.isin(0, 2, 168) | ((b == 88) & (c == 99)))) | ((a == 198) & (b.isin(18, 19) | ((b == 51) & (c == 100)))) | ((a == 203) & (b == 0) & (c == 113))
    )


def _private_ipv6(g: Column) -> Column:
    at = lambda i: F.element_at(g, i + 1)
    zeros = lambda n: F.forall(F.slice(g, 1, n), lambda x: x == 0)
    inner = F.array(*[x for i in (6, 7) for x in (F.shiftright(at(i), 8), at(i).bitwiseAND(255))])
    return (
        (zeros(7) & at(7).isin(0, 1)) | (at(0) >= 0xFF00) | at(0).between(0xFE80, 0xFEBF) | at(0).between(0xFC00, 0xFDFF)
        | ((at(0) == 0x2001) & (at(1) == 0x0DB8)) | (zeros(5) & (at(5) == 0xFFFF) & _private_ipv4(inner))
    )


def url_verdict(url: Column) -> Column:
    """ok, or the first reason against a webhook's address: host, scheme, userinfo, fragment, forbidden, private.

    A host is refused unless it is plainly a name or an address: brackets must hold an IPv6 address, and a name whose last
    label is a number (as in short or octal IPv4 forms) is none.
    """
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    place = F.regexp_extract(F.regexp_replace(authority, "^.*@", ""), r"^(\[[^\]]*\]|[^\[\]:]*)(:[0-9]*)?$", 1)
    false = F.lit(False)

    def verdict(x: Column) -> Column:
        named = x.host.rlike(r"^[^\s\[\]<>%|^\\]+$") & ~x.host.rlike(r"(^|\.)([0-9]+|0x[0-9a-f]*)$") & ~x.host.contains("..")
        known = x.four.isNotNull() | x.six.isNotNull() | named
        private = F.coalesce(_private_ipv4(x.four), false) | F.coalesce(_private_ipv6(x.six), false)
        return (
            F.when(~F.coalesce(known, false), "host").when(~url.rlike("^[Hh][Tt][Tt][Pp][Ss]://"), "scheme").when(x.authority.contains("@"), "userinfo").when(url.contains("#"), "fragment")
            .when(x.host.isin(*FORBIDDEN), "forbidden").when(private, "private").otherwise("ok")
        )

    def addresses(x: Column) -> Column:
        four, six = ipv4_octets(x.host), ipv6_groups(F.regexp_extract(x.host, r"^\[(.*)\]$", 1))
        return _let(F.struct(x.host.alias("host"), x.authority.alias("authority"), four.alias("four"), six.alias("six")), verdict)

    return _let(F.struct(F.rtrim(F.lower(place), F.lit(".")).alias("host"), authority.alias("authority")), addresses)


#: Failure codes of a connector (fixed values): those that never succeed on another try, and the others.
PERMANENT = ("authentication", "authorization", "tls_verification", "invalid_destination", "message_too_large", "protocol_rejection", "invalid_config", "shutdown")
TRANSIENT = ("unavailable", "timeout", "throttled", "unknown")


def error_class(code: Column) -> Column:
    """permanent or transient; a code that is none of these counts as unknown and may be tried again."""
    return F.when(code.isin(*PERMANENT), "permanent").otherwise("transient")


def status_code(status: Column) -> Column:
    """The failure code of a webhook's HTTP status; null for success."""
    return (
        F.when(status.between(200, 299), F.lit(None).cast("string")).when(status.isin(408, 425, 429) | status.between(500, 599), "throttled").when(status.between(300, 399), "invalid_destination")
        .when(status.isin(401, 403), "authentication").when(status.between(400, 499), "protocol_rejection").otherwise("unknown")
    )


def publish_directive(outcome: Column, code: Column, failures: Column, most: Column, dlq: Column) -> Column:
    """What a worker does next: go on, wait, put the batch aside and why, or stop. failures: how many on end, this one included."""
    aside = F.when(outcome == "breaker_open", "sink_permanent").when(error_class(code) == "permanent", "sink_permanent").when(failures > most, "max_retries_exceeded")
    return (
        F.when(outcome == "success", "continue").when(dlq & aside.isNotNull(), F.concat(F.lit("dead_letter:"), aside))
        .when((outcome != "breaker_open") & (error_class(code) == "permanent"), "stop").otherwise("backoff")
    )
