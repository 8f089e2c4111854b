import random
import re

from eventledger.llm import urls

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(LOWER), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule(host, path):
    fits = []
    for verdict, r in urls.RULES:
        name, _, start = r.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start):
            fits.append((len(r), r, verdict))
    return max(fits, default=(0, None, None))[1:]


def test_rules_and_templates(spark):
    given = [None, "", "no scheme", "http://", "http://NET", "http://net/", "http://a.NET/x?y#z", "http://xnet/", "https://Example.net/en/1", "https://a.example.net/en", "ftp://example.com/de/", "http://shop.example.com/DE/1", "http://org/fr/", "a://b://c/d", "http://h?x=://y", "http://h#f", "http://x.org/" + "a/" * 3000, "http://é.ORG/FR/ü"]
    given += [f"http://one.example.com/de/{i}" for i in range(30)] + [f"http://one.example.com/p{i}x/{i}" for i in range(40)] + ["http://one.example.com/p1x/1"] * 3
    rows = [(i, u, "h", "v") for i, u in enumerate(given)]
    out = urls.judged(spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")).collect()
    assert sorted(r.page_id for r in out) == list(range(len(given)))
    for r in out:
        host, path = parts(given[r.page_id])
        name, verdict = rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, name), given[r.page_id]
        assert r.verdict == (verdict or r.verdict) and r.verdict in ("block", "allow") and 0 <= r.purity <= 1
    templates = {r.template for r in out if r.host == "one.example.com"}
    assert "/de/<number>" in templates and len(templates) < 6
    assert urls.judged(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_unlabelled_siblings_of_ruled_pages_are_not_rejected(spark):
    given, unruled = [], {}
    for n in (1, 2, 500):
        host = f"http://n{n}.example.com"
        given += [f"{host}/de/{i}" for i in range(n)]
        for url in (f"{host}/en/1", f"{host}/fr/a/b", f"{host}/", host, f"{host}/de"):
            unruled[len(given)] = url
            given.append(url)
    wide = [f"http://wide.example.com/{a}{b}/x" for a in "abcdefgh" for b in "klmnop"]
    unruled |= {len(given) + 100 + i: u for i, u in enumerate(wide)}
    rows = [(i, u) for i, u in enumerate(given)] + [(len(given) + 100 + i, u) for i, u in enumerate(wide)]
    rows += [(9000 + i, f"http://wide.example.com/de/{i}") for i in range(50)]
    out = {r.page_id: r for r in urls.judged(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert len(out) == len(rows)
    for i, url in unruled.items():
        assert (out[i].rule, out[i].verdict, out[i].purity) == (None, "allow", urls.PRIOR), url
    assert all(out[9000 + i].verdict == "block" for i in range(50))


def test_a_template_is_judged_by_its_own_examples(spark):
    rules = (("block", "h/a/1"), ("allow", "h/b/1"), ("block", "h/c/1"))
    given = [f"http://h/a/1{i}" for i in range(9)] + [f"http://h/b/1{i}" for i in range(9)] + [f"http://h/c/1{i}" for i in range(40)]
    asked = {"http://h/a/2": "block", "http://h/b/2": "allow", "http://h/c/2": "block", "http://h/d/2": "allow", "http://h/c": "allow"}
    given += asked
    out = urls.judged(spark.createDataFrame(list(enumerate(given)), "page_id long, url string"), rules).collect()
    assert {given[r.page_id]: r.verdict for r in out if r.rule is None} == asked


def tree(paths):
    """{segments: (template, purity)} of one host's {segments: (n, bad, u)}, by recursion."""
    out = {}

    def smooth(n, bad, parent):
        return (bad + urls.WEIGHT * (parent if bad else urls.PRIOR)) / (n + urls.WEIGHT)

    def node(members, at, template, parent):
        n, bad, u = (sum(paths[m][i] for m in members) for i in range(3))
        purity = smooth(n, bad, parent)
        while all(len(m) > at for m in members) and len({m[at] for m in members}) == 1:
            template, at = f"{template}/{members[0][at]}", at + 1
        if n == 0 or (u == 0 and bad in (0, n)):
            out.update((m, (template, purity)) for m in members)
            return
        by = {}
        for m in members:
            by.setdefault(m[at] if len(m) > at else "", []).append(m)
        sums = {s: tuple(sum(paths[m][i] for m in ms) for i in (0, 1)) for s, ms in by.items()}
        inner = [s for s in by if s]
        if "" in by:
            own = smooth(*sums[""], purity) if inner else purity
            out.update((m, (template, own)) for m in by[""])
        names = {s: s for s in inner}
        if len(inner) > urls.FANOUT:
            kinds, k, before = sorted({sums[s] for s in inner if sums[s][0]}, key=lambda c: (c[1] / c[0], c[0])), 0, None
            classes = {}
            for c in kinds:
                times = sum(sums[s] == c for s in inner)
                now = (c[0] * times, c[1] * times)
                if before:
                    pool = (now[1] + before[1]) / (now[0] + before[0])
                    z = abs(now[1] / now[0] - before[1] / before[0]) / (max(pool * (1 - pool), 1e-12) * (1 / now[0] + 1 / before[0])) ** 0.5
                    k += z > urls.APART
                classes[c], before = k, now
            names = {s: f"*{classes[sums[s]]}" if sums[s][0] else "*" for s in inner}
        groups = {}
        for s in inner:
            groups.setdefault(names[s], []).extend(by[s])
        for name, ms in groups.items():
            node(ms, at + 1, f"{template}/{name}", purity)

    if paths:
        node(list(paths), 0, "", urls.PRIOR)
    return out


def test_tree_equals_recursion(spark):
    rng = random.Random(11)
    hosts = {}
    for h in range(6):
        width = (3, 30, 60)[h % 3]
        for _ in range(250):
            path = tuple(f"s{rng.randrange(width if i == 1 else 3)}{rng.choice('abc')}" for i in range(rng.randrange(0, 7)))
            n = rng.choice([0, 0, 1, 4, 9])
            share = 0.9 if path[1:2] and path[1] < "s2" else 0.1
            hosts.setdefault(f"h{h}", {})[path] = (n, sum(rng.random() < share for _ in range(n)), rng.choice([0, 1, 3]) if n else 2)
    rows = [(h, list(p), *c) for h, paths in hosts.items() for p, c in paths.items()]
    found = urls.tree_of(spark.createDataFrame(rows, "host string, segments array<string>, n long, bad long, u long")).collect()
    assert len(found) == len(rows)
    want = {h: tree(paths) for h, paths in hosts.items()}
    for r in found:
        template, purity = want[r.host][tuple(r.segments)]
        assert r.template == template and abs(r.purity - purity) < 1e-9
    assert any("/*1" in r.template for r in found)


def test_branches_that_differ_far_down_are_told_apart(spark):
    deep = "/".join(f"seg{i}x" for i in range(12))
    rules = tuple(("block" if i % 2 else "allow", f"h/{deep}/k{'ab'[i % 2]}/{c}") for i in range(2) for c in "pqr")
    given = [f"http://h/{deep}/k{'ab'[i % 2]}/{c}{j}" for i in range(2) for c in "pqr" for j in range(9)]
    asked = {f"http://h/{deep}/kb/zz": "allow", f"http://h/{deep}/kb/p": "block", f"http://h/{deep}/ka/z": "allow", "http://h/seg0x": "allow"}
    out = urls.judged(spark.createDataFrame(list(enumerate([*given, *asked])), "page_id long, url string"), rules).collect()
    assert {x.verdict for x in out if "/kb/" in x.path and x.rule} == {"block"}
    assert all(r.verdict == asked[u] for r in out for u in asked if r.path == u[8:] and r.rule is None)
    assert len({r.template for r in out if r.rule}) >= 2


def test_query_on_whole_table(spark, sf):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    out = urls.op8_urls(spark, sf).collect()
    assert len(out) == len(pages)
    for r in out:
        host, path = parts(pages[r.page_id])
        name, verdict = rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, name)
        assert verdict is None or r.verdict == verdict
