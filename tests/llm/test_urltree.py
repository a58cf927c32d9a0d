import pytest

from roadweave.llm.queries import URL_RULES
from roadweave.llm.urltree import filter_urls


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    end = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:end]


def rule(host, path):
    fits = [r for r in URL_RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return (best[0] + best[1], best[2]) if best else (None, None)


def check(rows, got):
    key = lambda r: tuple(map(str, r))
    want = []
    for i, url in rows:
        host, path = parse(url)
        want.append((i, host, path, rule(host, path)[0]))
    assert sorted([(r.page_id, r.host, r.path, r.rule) for r in got], key=key) == sorted(want, key=key)
    for r in got:
        given = rule(r.host, r.path)[1]
        assert r.verdict == given if given else r.verdict in ("allow", "block")


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = filter_urls(pages, URL_RULES).collect()
    check([(r.page_id, r.url) for r in pages.collect()], got)
    assert all(r.verdict == "allow" for r in got if r.rule is None and r.host.endswith(".org"))


def test_odd_rows(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/1", "https://example.com/en", "http://xexample.com/en/", "http://a.net/es/1?x://y.com/",
            "http://net/fr/", "x://b.NET#/es/", "http://É.com/É", "http://u:p@h.com:8/a//b/", "http://h.net\n/es/", "a://b://c/d", "http://www.example.com/en/x", "http://m.www.example.com/en/x"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(None, "http://a.net/es/1"), (3, "http://")]
    df = spark.createDataFrame([r + ("h", "r") for r in rows], "page_id long, url string, host string, rule string")
    check(rows, filter_urls(df, URL_RULES).collect())
    assert filter_urls(df.limit(0), URL_RULES).count() == 0


def decided(spark, urls, rules, **more):
    got = filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules, **more).collect()
    return {r.page_id: r for r in got}


def test_templates_and_rejection(spark):
    """Spam folders that the rules only partly cover are rejected, clean folders of the same host are not."""
    rules = [("s.io", "/buy/1", "block"), ("s.io", "/news/1", "allow"), ("t.io", "/x/1", "block")]
    urls = [f"http://s.io/buy/{i}/offer{i}.html" for i in range(1, 200)] + [f"http://s.io/news/{i}" for i in range(1, 200)]
    urls += [f"http://s.io/help/{i}" for i in range(50)] + ["http://t.io/x/1", "http://t.io/x/2"]
    by = decided(spark, urls, rules)
    assert {r.template for r in by.values() if r.host == "s.io"} == {"/buy/*/*", "/news/*", "/help/*"}
    for i, u in enumerate(urls):
        assert by[i].verdict == ("block" if "/buy/" in u or u == "http://t.io/x/1" else "allow")
    # /help/* has the shape of /news/*, so it takes the labels of that branch, not of /buy/*/*
    assert by[len(urls) - 3].branch == "/+/*" and by[len(urls) - 3].purity < 0.1


def test_similar_branches_share_labels(spark):
    """Unlabelled folders that look like blocked ones go with them; one of another shape and one with other labels do not."""
    rules = [("m.io", f"/c{i}/1", "block") for i in range(9)] + [("m.io", "/e/", "allow")]
    urls = [f"http://m.io/{c}/{k}" for c in (*(f"c{i}" for i in range(9)), "d", "e") for k in (1, 22, 33)]
    urls += [f"http://m.io/f/about/team/{c}" for c in ("ann", "bob", "tom")]
    by = {urls[i]: r for i, r in decided(spark, urls, rules).items()}
    assert {r.branch for u, r in by.items() if "/c" in u or "/d" in u} == {"/+/*"}
    assert by["http://m.io/d/1"].verdict == "block" and by["http://m.io/e/1"].branch == "/e/*"
    assert by["http://m.io/f/about/team/ann"].branch == "/f/about/team/+" and by["http://m.io/f/about/team/ann"].verdict == "allow"
    host = (0 + 1) / (3 + 2)  # what the host has beyond the merged branch
    assert by["http://m.io/d/1"].purity == pytest.approx((9 + 2 * host) / 11)


def brute_tree(urls, rules, max_depth=6, max_children=12, min_share=0.02, min_rows=30, merge_z=1.96, prior=0.5, strength=2.0):
    """url -> (template, branch, purity), by plain loops over the rules of the method."""
    import re
    from collections import Counter, defaultdict

    from roadweave.llm.urltree import VARIABLE

    def by_rule(h, p):
        fits = [r for r in rules if (h == r[0] or h.endswith("." + r[0])) and p.startswith(r[1])]
        return max(fits, key=lambda r: len(r[0] + r[1]))[2] if fits else None

    count = Counter(parse(u) for u in urls)
    template = dict.fromkeys(count, "")
    for level in range(max_depth):
        nodes, segs = Counter(), {}
        for (h, p), n in count.items():
            parts = [s for s in p.split("/") if s]
            if level < len(parts):
                s = "*" if re.search(VARIABLE, parts[level]) else parts[level]
                segs[h, p] = s
                nodes[h, template[h, p], s] += n
        total, children = Counter(), Counter()
        for (h, t, s), n in nodes.items():
            total[h, t] += n
            children[h, t] += 1
        for (h, p), s in segs.items():
            t = template[h, p]
            n = nodes[h, t, s]
            keep = children[h, t] <= max_children or (n >= min_rows and n >= min_share * total[h, t])
            template[h, p] = f"{t}/{s if keep else '*'}"
    for h, p in template:
        if len([s for s in p.split("/") if s]) > max_depth:
            template[h, p] += "/**"
    allow, block = Counter(), Counter()
    for (h, p), n in count.items():
        allow[h, template[h, p]] += n * (by_rule(h, p) == "allow")
        block[h, template[h, p]] += n * (by_rule(h, p) == "block")
    rows = Counter()
    for (h, p), n in count.items():
        rows[h, template[h, p]] += n
    labels = {x: (block[x], block[x] + allow[x]) for x in rows}

    def levels(x):
        parts = x[1].split("/")
        return [((x[0], k, "/".join(parts[:k])), parts[k], "/".join(parts[k + 1 :])) for k in range(len(parts))]

    own, shape, family = defaultdict(lambda: [0, 0]), defaultdict(Counter), defaultdict(set)
    for x, n in rows.items():
        for at, seg, below in levels(x):
            own[at, seg][0] += labels[x][0]
            own[at, seg][1] += labels[x][1]
            if at[1] and seg not in ("*", "**"):
                shape[at, seg][below] += n
    for (at, seg), c in shape.items():
        family[at, " ".join(sorted(s for s, n in c.items() if n >= 0.1 * c.total()))].add(seg)
    group = {}
    for (at, _), segs in family.items():
        pool = sum((shape[at, s] for s in segs), Counter())
        df, alike = len(pool) - 1, []
        for s in segs:
            n = shape[at, s].total()
            chi = sum((shape[at, s][b] - n * pool[b] / pool.total()) ** 2 / (n * pool[b] / pool.total()) for b in pool)
            if chi <= df + merge_z * (2 * df) ** 0.5 + 1e-6:
                alike.append(s)
        b, n = (sum(own[at, s][k] for s in alike) for k in (0, 1))
        near = lambda x, m: m == 0 or abs(x / m - b / n) / (max(b / n * (1 - b / n), 1e-9) / m) ** 0.5 < merge_z
        members = [s for s in alike if near(*own[at, s])]
        if len(members) > 1:
            sums = tuple(sum(own[at, s][k] for s in members) for k in (0, 1))
            group |= {(at, s): sums for s in members}
    out = {}
    for u in urls:
        h, p = parse(u)
        purity, branch, way = prior, [], []
        for at, seg, _ in levels((h, template[h, p])):
            branch.append("+" if (at, seg) in group else seg)
            way.append(group.get((at, seg), own[at, seg]))
        for (b, n), (below_b, below_n) in zip(way, [*way[1:], (0, 0)]):
            purity = (max(0, b - below_b) + purity * strength) / (max(0, n - below_n) + strength)
        out[u] = (template[h, p], "/".join(branch), purity)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_tree_against_brute_force(spark, seed):
    import random

    rnd = random.Random(seed)
    words = ["en", "de", "shop", "buy", "news", "x1", "item12345", "2024-01-02", "deadbeef01", "a.b", "*"] + [f"w{chr(97 + i)}q" for i in range(20)]
    urls = ["http://" + rnd.choice(["a.io", "b.io"]) + "".join("/" + rnd.choice(words) for _ in range(rnd.randrange(9))) for _ in range(400)]
    rules = [("a.io", "/buy", "block"), ("a.io", "/en", "allow"), ("b.io", "/shop", "block"), ("a.io", "/buy/en", "allow"), ("b.io", "/de", "block")]
    got = filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules, max_children=5, min_rows=4).collect()
    want = brute_tree(urls, rules, max_children=5, min_rows=4)
    for r in got:
        t, b, p = want[urls[r.page_id]]
        assert (r.template, r.branch, r.purity) == (t, b, pytest.approx(p))
        if r.rule is None:
            assert r.verdict == ("block" if p >= 0.8 else "allow")


def test_unlabelled_templates_follow_their_branches(spark):
    rules = [("b.net", "/fr/", "block"), ("b.net", "/es/", "block"), ("c.com", "/x/bad/", "block"), ("c.com", "/y/", "allow")]
    urls = [f"http://b.net/{p}/{i}" for p in ("fr", "es", "en") for i in range(9)] + [f"http://d.org/en/{i}" for i in range(9)]
    urls += [f"http://c.com/{p}/{i}" for p in ("x/bad", "x/new", "y", "z") for i in range(9)]
    got = filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
    by = {r.path.rsplit("/", 1)[0] + r.host[:1]: r for r in got}
    low = lambda *way: __import__("functools").reduce(lambda p, x: (x[0] + 2 * p) / (x[1] + 2), way, 0.5)
    # /en looks like /fr and /es, which are blocked
    assert by["/enb"].purity == pytest.approx(low((18, 18), (0, 0))) and by["/enb"].verdict == "block" and by["/enb"].branch == "/+/*"
    # /x has a blocked folder and one like it; /z looks like /y, which is allowed
    assert by["/x/newc"].verdict == "block" and by["/x/newc"].branch == "/x/+/*"
    assert by["/zc"].verdict == "allow" and by["/zc"].purity < 0.2
    assert by["/end"].purity == 0.5 and by["/end"].verdict == "allow"


def test_query_decides_urls_without_a_rule(spark):
    from roadweave.llm.queries import op10_url_templates

    verdicts = {(r.host.rsplit(".", 1)[-1], r.verdict) for r in op10_url_templates(spark, "/root/testdata/sf0.01").filter("rule is null").collect()}
    assert {("net", "block"), ("org", "allow")} <= verdicts
