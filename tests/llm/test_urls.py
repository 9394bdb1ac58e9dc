"""Hosts, paths and rules against plain Python."""

import re

from plumbline.llm.url_filter import RULES, url_verdicts


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[1:]) if fits else (host, path, None, None)


def test_rules(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url")
    odd = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "a://b.example.com", "x://net/es/", "x://y.net/fr/a/b/c/d/e/f/g/h/i/j"]
    pages = pages.unionByName(spark.createDataFrame([(-1 - k, u) for k, u in enumerate(odd)], "page_id long, url string"))
    urls = {r.page_id: r.url for r in pages.collect()}
    rows = url_verdicts(pages).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path, rule, verdict = brute(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block")
        assert verdict is None or r.verdict == verdict
    assert url_verdicts(pages.limit(0)).collect() == []


def judged(urls, depth=8, least=8, share=0.3, z=1.96, prior=4.0, reject=0.5):
    """The template tree over a set of urls, node by node, in plain Python: {(host, path): (template, share)}."""
    sites = {}
    for u in urls:
        host, path, _, fixed = brute(u)
        segs = re.sub("^/", "", path).split("/") if path else []
        segs = segs[: depth - 1] + (["/".join(segs[depth - 1 :])] if len(segs) >= depth else [])
        sites[host, path] = [segs, {"block": 1, "allow": 0}.get(fixed), ""]
    for level in range(max((len(s[0]) for s in sites.values()), default=0)):
        here = [(h, s) for (h, _), s in sites.items() if len(s[0]) > level]
        nodes, everywhere = {}, {}
        for h, s in here:
            nodes.setdefault((h, s[2]), []).append(s)
            everywhere.setdefault(s[2], []).append(s[0][level])
        many = lambda values, n: len(set(values)) >= least and len(set(values)) >= share * n
        longer = []
        for (_, template), members in nodes.items():
            variable = many([s[0][level] for s in members], len(members)) or many(everywhere[template], len(everywhere[template]))
            labels = [s[1] for s in members if s[1] is not None]
            for s in members:
                own = [x[1] for x in members if x[1] is not None and x[0][level] == s[0][level]]
                n, k, rest = len(own), sum(own), len(labels) - len(own)
                merged = False
                if n and rest:
                    p = sum(labels) / len(labels)
                    merged = abs(k / n - (sum(labels) - k) / rest) <= z * (p * (1 - p) * (1 / n + 1 / rest)) ** 0.5
                longer.append((s, "*" if variable else "{similar}" if merged else s[0][level]))
        for s, name in longer:
            s[2] = f"{s[2]}/{name}"
    rate = lambda test, base: (sum(s[1] for (h, _), s in sites.items() if s[1] is not None and test(h, s)) + prior * base) / (
        sum(s[1] is not None and test(h, s) for (h, _), s in sites.items()) + prior
    )
    labels = [s[1] for s in sites.values() if s[1] is not None]
    overall = sum(labels) / len(labels) if labels else 0.0
    out = {}
    for (host, path), s in sites.items():
        base = rate(lambda h, x, s=s: x[2] == s[2], overall)
        base = rate(lambda h, x, host=host: h == host, base)
        out[host, path] = (s[2], rate(lambda h, x, s=s, host=host: h == host and x[2] == s[2], base))
    return out


def planted():
    urls = [f"http://shop{h}.com/item/{i}/view" for h in range(3) for i in range(12)]
    urls += [f"http://a.net/es/{i}" for i in range(20)] + [f"http://a.net/pt/{i}" for i in range(20)] + [f"http://a.net/{x}/about" for x in ("fr", "es", "de")]
    urls += [f"http://b.org/{x}/p{i % 3}" for x in ("one", "two") for i in range(6)] + ["http://c.org/" + "s/" * 12 + "end", "http://d.org/" + "x" * 20_000]
    return urls + ["http://www.example.com/en/1", "http://example.com/en/2", None, "none"]


def test_tree_and_purity_equal_plain_python(spark, folder):
    given = [r.url for r in spark.read.parquet(f"{folder}/pages.parquet").select("url").collect()]
    for urls in (planted(), given):
        rows = url_verdicts(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
        expected = judged(urls)
        for r in rows:
            template, share = expected[r.host, r.path]
            assert (r.template, round(r.share, 9)) == (template, round(share, 9))
            fixed = brute(urls[r.page_id])[3]
            assert r.verdict == (fixed or ("block" if r.share >= 0.5 else "allow"))
        assert len(rows) == len(urls)


def test_repeated_rows_change_no_verdict(spark):
    urls = [(i, f"http://h.de/de/{i}") for i in range(20)] + [(100 + i, f"http://h.net/es/{i}") for i in range(20)]
    extra = "page_id long, url string"
    once = {r.page_id: (r.verdict, r.template, r.share) for r in url_verdicts(spark.createDataFrame(urls, extra)).collect()}
    often = url_verdicts(spark.createDataFrame(urls * 10 + [(None, None)] * 3 + [(7, "http://h.de/de/7")], extra)).collect()
    assert len(often) == 404
    assert {r.page_id: (r.verdict, r.template) for r in often if r.page_id is not None} == {k: v[:2] for k, v in once.items()}
    clash = "page_id long, url string, host int, path int, segs int, label string, template int, fixed int, share string, seg string"
    rows = url_verdicts(spark.createDataFrame([(*u, *[None] * 8) for u in urls], clash)).collect()
    assert {r.page_id: (r.verdict, r.template, r.share) for r in rows} == once
