import math
import random
import re

from lodestack.llm import urlfilter
from lodestack.llm.urlfilter import RULES, filter_urls

SCHEMA = "page_id long, url string, template string, n long"
URLS = [None, "", "no scheme", "http://", "HTTP://X.Example.ORG", "https://a.example.org/es/1?x=/y", "http://example.org/en/15#top", "http://example.org/en/25", "http://badexample.org/es/1",
        "x://a://b/c", "http://h.com/fr/1", "http://h.com/de/2", "http://com/de/", "http://h.com/de", "http://h.net?q=1/2", "http://É.net/\n/x", "http://h.net/" + "/".join("abcdefghij") + "/" + "y" * 9000]


def data():
    rows = [(i, u, "clash", 1) for i, u in enumerate(URLS)]
    rows += [(100 + i, f"http://s.net/blog/{2000 + i % 5}/post-{i}", "c", 1) for i in range(60)]
    rows += [(200 + i, f"http://big.com/{['fr', 'de', 'en'][i % 3]}/{i}", None, None) for i in range(90)]
    rows += [(300 + i, f"http://spam.com/de/{i}", None, None) for i in range(40)] + [(400, "http://spam.com/de2", None, None), (None, "http://h.com/fr/1", None, None), rows[5], rows[5]]
    return rows


def brute(url):
    m = re.match(r"(?s)(.*?)://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[2]), m[3]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else (None, None)


def test_rules_match_brute_force(spark):
    rows = data()
    got = filter_urls(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    for p, u, *_ in rows:
        host, path, (rule, verdict) = brute(u)
        for r in by[p]:
            if p is None:
                continue
            assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block")
            if verdict:
                assert r.verdict == verdict


def test_templates(spark):
    got = {r.page_id: r for r in filter_urls(spark.createDataFrame(data(), SCHEMA)).collect()}
    assert got[130].template == "/blog/*/*" and got[130].labelled == 0 and got[130].verdict == "allow"
    assert got[200].template == "/fr/*" and got[201].template == "/de/*" and got[202].template == "/en/*"
    assert got[201].purity > 0.8 and got[200].purity < 0.2 and got[202].verdict == "allow"
    assert got[16].template == "/*" * 11 and got[0].template == ""


def test_pure_templates_reject(spark):
    rows = [(i, f"http://spam.com/de/{i}", "", 0) for i in range(50)] + [(90, "http://spam.com/de", "", 0)]
    mixed = filter_urls(spark.createDataFrame(rows, SCHEMA), rules=(("block", "spam.com", "/de/"), ("block", "spam.com", "/x")))
    got = {r.page_id: r for r in mixed.collect()}
    assert got[0].rule == "spam.com/de/" and got[0].purity > 0.9 and got[90].rule is None
    near = filter_urls(spark.createDataFrame([(i, f"http://w.com/a/{i}", "", 0) for i in range(100, 160)] + [(1, "http://w.com/a/2", "", 0)], SCHEMA), rules=(("block", "w.com", "/a/1"),))
    assert {r.page_id: r.verdict for r in near.collect()}[1] == "block"  # its template is all but purely blocked


def test_a_small_section_of_a_large_host_stays_apart(spark):
    rows = [(i, f"http://m.com/a{i % 50}/{i}", "", 0) for i in range(1000)] + [(2000 + i, f"http://m.com/b/{100 + i}", "", 0) for i in range(40)] + [(3000, "http://m.com/b/2", "", 0)]
    got = {r.page_id: r for r in filter_urls(spark.createDataFrame(rows, SCHEMA), rules=(("allow", "m.com", "/a"), ("block", "m.com", "/b/1"))).collect()}
    assert got[3000].rule is None and got[3000].template == "/b/*" and got[3000].verdict == "block" and got[0].template == "/*/*"


def test_deep_paths_are_told_apart(spark):
    deep = "/".join("abcdefghijkl")
    rows = [(i, f"http://d.com/{deep}/{'xy'[i % 2]}/{i}", "", 0) for i in range(100, 200)] + [(1, f"http://d.com/{deep}/x/2", "", 0), (2, f"http://d.com/{deep}/y/2", "", 0)]
    got = {r.page_id: r for r in filter_urls(spark.createDataFrame(rows, SCHEMA), rules=(("block", "d.com", f"/{deep}/x/1"), ("allow", "d.com", f"/{deep}/y/1"))).collect()}
    assert got[1].template == f"/{deep}/x/*" and got[1].verdict == "block" and got[2].template == f"/{deep}/y/*" and got[2].verdict == "allow"


def test_a_literal_star_is_no_wildcard(spark):
    rows = [(i, f"http://h.com/*/{i}", "", 0) for i in range(100, 130)] + [(i, f"http://h.com/{i}/z", "", 0) for i in range(200, 230)]
    got = {r.page_id: r.template for r in filter_urls(spark.createDataFrame(rows, SCHEMA), rules=(("block", "h.com", "/*/"),)).collect()}
    assert got[100] == "/\\*/*" and got[200].startswith("/*/")


def test_templates_of_other_hosts_are_evidence(spark):
    rows = [(i, f"http://s{i % 9}.com/casino/{i}", "", 0) for i in range(90)] + [(500 + i, f"http://quiet.net/casino/{i}", "", 0) for i in range(9)] + [(600 + i, f"http://quiet.net/news/{i}", "", 0) for i in range(9)] + [(700 + i, f"http://s{i % 9}.com/news/{i}", "", 0) for i in range(90)]
    got = {r.page_id: r for r in filter_urls(spark.createDataFrame(rows, SCHEMA), rules=(("block", "com", "/casino/"), ("allow", "com", "/news/"))).collect()}
    assert got[500].rule is None and got[500].template == "/*/*" or got[500].verdict == "block"
    assert got[600].verdict == "allow"


def brute_templates(counts):
    """Templates of one host from {path: (n, lab, blk)}: the tree walked node by node in plain Python."""

    def go(prefix, rows):
        done = {p: prefix for p, segs, _ in rows if not segs}
        rows = [r for r in rows if r[1]]
        if not rows:
            return done
        if sum(c[0] for *_, c in rows) < urlfilter.MIN_COUNT:
            return done | {p: prefix + "/*" * len(segs) for p, segs, _ in rows}
        kids = {}
        for r in rows:
            kids.setdefault(r[1][0], []).append(r)
        stats = {}
        for seg, own in kids.items():
            stats[seg] = tuple(sum(c[k] for *_, c in own) for k in range(3)) + (sum(c[0] for _, s, c in own if len(s) == 1),)
        name = lambda seg: "/" + ("\\" if seg[:1] in ("*", "\\") else "") + seg
        if len(kids) == 1:
            steps = {seg: name(seg) for seg in kids}
        else:
            up = lambda a, b: math.ceil(4 * a / b)
            cell = lambda s: -1 if s[0] < urlfilter.MIN_COUNT else up(s[3], s[0]) + 5 * up(s[1], s[0]) + 25 * (up(s[2], s[1]) + 1 if s[1] else 0)
            cells = {}
            for s in stats.values():
                old = cells.get(cell(s), (0, 0, 0, 0, 0))
                cells[cell(s)] = (old[0] + 1, *(x + y for x, y in zip(old[1:], s)))
            pools = urlfilter.merge_cells([(c, *v) for c, v in cells.items()])
            steps = {}
            for seg, s in stats.items():
                wild, pool = pools[cell(s)]
                apart = cell(s) >= 0 and (wild == "" or urlfilter._differ(s, tuple(x - y for x, y in zip(pool, s))))
                steps[seg] = name(seg) if apart else "/" + (wild or "*") if cell(s) >= 0 else "/*"
        by = {}
        for seg, own in kids.items():
            by.setdefault(steps[seg], []).extend((p, s[1:], c) for p, s, c in own)
        for step, own in by.items():
            done |= go(prefix + step, own)
        return done

    return go("", [(p, [] if p == "" else re.sub("^/", "", p).split("/"), c) for p, c in counts.items()])


def test_templates_purities_and_verdicts_match_brute_force(spark):
    rng = random.Random(6)
    rows = data()
    for i in range(1500):
        path = "/".join(rng.choice([["fr", "de", "en", "es"], ["a", "b", "*x", ""], [str(rng.randint(0, 30)), "idx"], ["q"]][min(k, 3)]) for k in range(rng.randint(0, 6)))
        rows.append((1000 + i, f"http://h{rng.choice('1112')}.{rng.choice(['com', 'net', 'org'])}/{path}", "", 0))
    got = filter_urls(spark.createDataFrame(rows, SCHEMA)).collect()
    counts = {}
    for _, u, *_ in rows:
        host, path, (_, verdict) = brute(u)
        c = counts.setdefault(host, {}).setdefault(path, [0, 0, 0])
        counts[host][path] = [c[0] + 1, c[1] + (verdict is not None), c[2] + (verdict == "block")]
    want = {h: brute_templates(c) for h, c in counts.items()}
    for r in got:
        assert r.template == want[r.host][r.path], (r.host, r.path)
    lab, every = {}, [0, 0]
    for h, c in counts.items():
        for p, (_, a, b) in c.items():
            for key in ((h, want[h][p]), (None, want[h][p]), (h, None), (None, None)):
                x = lab.setdefault(key, [0, 0])
                x[0] += a
                x[1] += b
    for r in got:
        own, host, other = lab[r.host, r.template], lab[r.host, None], lab[None, r.template] if re.search("/[^*]", r.template) else [0, 0]
        assert r.labelled == own[0] and 0 <= r.purity <= 1
        if r.rule is None and max(host[0], other[0]) < urlfilter.MIN_LABELS:
            assert r.verdict == "allow"
        if r.rule is None and max(host[0], other[0]) >= urlfilter.MIN_LABELS:
            assert r.verdict == ("block" if r.purity >= urlfilter.PURITY else "allow")
    assert any(r.rule is None and r.verdict == "block" for r in got)


def test_empty_table(spark):
    assert filter_urls(spark.createDataFrame([], SCHEMA)).count() == 0
