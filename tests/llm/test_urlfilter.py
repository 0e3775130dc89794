import re

from corpusgraph.llm import urlfilter

PAGES = [
    (1, "http://Shop.Example.NET/en/x?q=1", '<a href="https://far.org/fr/y">a</a>'),
    (2, "https://example.net/de/#t", None),
    (3, "https://notexample.net", ""),
    (4, "https://www.example.com/de/1", '<a href="//spam.biz/1">s</a>'),
    (5, "https://example.com/en/1", None),
    (6, "https://a.org/fr/", '<a href=\'http://good.biz/\'>g</a>'),
    (7, "ftp://org/fr/z", ""),
    (8, None, "x"),
    (9, "no scheme", "x"),
    (10, "http://", "x"),
    (11, "http://linker.biz/", '<a href="http://evil.net/x">1</a><a href="http://worse.net/">2</a>'),
    (12, "http://evil.net/a", '<a href="http://good.biz/">x</a>'),
    (13, "http://worse.net/a", ""),
    (14, "http://clean.biz/a", '<a href="/in">x</a><a href="http://good.biz/">x</a>'),
    (15, "http://good.biz/", ""),
    (15, "http://good.biz/", ""),
    (None, "http://x.example.net/en/?a://b", None),
    (16, "a\nb://Host\n.com/p\nq?r", None),
]


def split(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return (m[1].translate(low), m[2]) if m else ("", "")


def rule(host, path):
    fits = [(len(r), r, v) for v, r in urlfilter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    return max(fits, default=(0, None, None))[1:]


def walk(pages, kind, reverse):
    """Scores of personalised PageRank with weight 1 for each seed, by a dense loop."""
    share, edges = {}, {}
    for _, url, html in pages:
        host, path = split(url)
        if host:
            share.setdefault(host, []).append(rule(host, path)[1] == kind)
        for to in re.findall(r"""href=["'](?:https?:)?//([^"'/]+)""", html or ""):
            if host and to != host:
                pair = (to, host) if reverse else (host, to)
                edges[pair] = edges.get(pair, 0) + 1
    seeds = {h for h, x in share.items() if sum(x) / len(x) > urlfilter.SEED_SHARE}
    out = {}
    for (a, _), n in edges.items():
        out[a] = out.get(a, 0) + n
    start = {h: 1 - urlfilter.DAMPING for h in seeds}
    rank = dict(start)
    for _ in range(urlfilter.MOST):
        new = dict(start)
        for (a, b), n in edges.items():
            if a in rank:
                new[b] = new.get(b, 0) + urlfilter.DAMPING * rank[a] * n / out[a]
        rank = new
    return {h: x / (1 - urlfilter.DAMPING) for h, x in rank.items()}


def test_against_a_dense_walk(spark):
    got = urlfilter.judge(spark.createDataFrame(PAGES, "page_id long, url string, html string")).collect()
    trust, distrust = walk(PAGES, "allow", False), walk(PAGES, "block", True)
    want = []
    for k, url, _ in PAGES:
        host, path = split(url)
        r, v = rule(host, path)
        t, d = trust.get(host, 0.0), distrust.get(host, 0.0)
        want.append((k, host, path, r, v or ("block" if d >= urlfilter.THRESHOLD and d > t else "allow"), round(t, 6), round(d, 6)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    by = {r.page_id: r.verdict for r in got}
    assert by[11] == "block" and by[14] == by[15] == by[5] == "allow"


def test_a_long_chain_is_walked_to_its_end(spark):
    """Distrust of 0.85^14 reaches the host that is 14 links behind a blocked one, and no further host."""
    pages = [(0, "http://bad.net/", None)] + [(i, f"http://h{i}.io/", f'<a href="http://{"bad.net" if i == 1 else f"h{i - 1}.io"}/">') for i in range(1, 20)]
    got = {r.page_id: r for r in urlfilter.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[i].distrust == round(0.85**i, 6) for i in got)
    assert [i for i in sorted(got) if got[i].verdict == "block"] == list(range(15))


def test_edges(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert urlfilter.judge(empty).count() == 0
    more = spark.createDataFrame([(1, "http://a.b/", "", "x", "y", "z")], "page_id long, url string, html string, host string, _key string, trust string")
    assert urlfilter.judge(more).columns == ["page_id", "host", "path", "rule", "verdict", "trust", "distrust"]
    assert urlfilter.judge(more).count() == 1
