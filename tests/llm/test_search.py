import numpy as np
from pyspark.sql import functions as F

from atlasmill.llm import ann, urls

VECTORS = "vec_id long, embedding array<float>, score string, cell string, ids string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "?", "?", "?") for i, v in rows], VECTORS)


def brute(rows, k, every):
    clean = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, v in clean:
        if q % every == 0:
            out[q] = sorted((-float(v @ w), i) for i, w in clean if i != q)[:k]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(900, 16)), rng.normal(size=(20, 16)).repeat(20, 0) + 0.05 * rng.normal(size=(400, 16))]).astype(np.float32)
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    want = brute(rows, 10, 10)
    got = {}
    for r in ann.search(vectors(spark, rows), lambda i: i % 10 == 0, k=10, centroids=16, group_rows=100).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == set(want) and all(sorted(g) == list(range(1, 11)) for g in got.values())
    hits = sum(len({i for i, _ in got[q].values()} & {i for _, i in w}) for q, w in want.items())
    assert hits >= 0.9 * 10 * len(want)
    for q, g in got.items():
        ordered = [g[k] for k in sorted(g)]
        assert ordered == sorted(ordered, key=lambda p: (-p[1], p[0])) and q not in [i for i, _ in ordered]
        assert all(abs(s - float(x[q].astype(float) @ x[i].astype(float))) < 1e-9 for i, s in ordered)


def test_walk_is_in_order_of_distance():
    rng = np.random.default_rng(1)
    index = ann.Index(rng.normal(size=(7, 3)), rng.normal(size=(5, 3)), 1.0)
    d1, d2 = index.distances(rng.normal(size=(1, 6)))
    cells = index.walk(d1[0], d2[0], [1] * 35, 35)
    sums = [d1[0][c // 5] + d2[0][c % 5] for c in cells]
    assert sorted(cells) == list(range(35)) and sums == sorted(sums)
    assert len(index.walk(d1[0], d2[0], [1] * 35, 4)) == 4


def test_copies_ties_and_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0]) for i in range(40)] + [(100, [0.0, 1.0]), (101, [2.0, 0.0]), (102, None), (103, [0.0, 0.0]), (104, [nan, 1.0]), (105, [inf, 1.0]), (106, [None, 1.0]), (107, []), (None, [1.0, 1.0])]
    got = {}
    for r in ann.search(vectors(spark, rows), lambda i: i % 20 == 0, k=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got[0] == [101, *range(1, 20)] and got[20] == [101, *range(19)] and set(got) == {0, 20, 100}
    assert len(got[100]) == 20


def test_fewer_candidates_than_asked(spark):
    got = ann.search(vectors(spark, [(0, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [-1.0, 0.0])]), lambda i: i == 0, k=20).collect()
    assert sorted((r.rank, r.vec_id) for r in got) == [(1, 1), (2, 2)]
    assert ann.search(vectors(spark, [(0, [1.0, 2.0])]), lambda i: i == 0).count() == 0
    assert ann.search(vectors(spark, [(0, [1.0])]).limit(0), lambda i: i == 0).count() == 0


PAGES = "page_id long, url string, host string, good string, verdict string"
RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}


def judged(spark, pages, outcomes=(), **params):
    df = spark.createDataFrame([(i, u, "?", "?", "?") for i, u in pages], PAGES)
    return urls.judge(df, spark.createDataFrame(list(outcomes), "page_id long, good int"), RULES, **params).collect()


def test_hosts_paths_and_rules(spark):
    cases = {
        "http://A.Example.COM/en/x?q": ("a.example.com", "/en/x", "example.com/en/", "block"), "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "https://x.www.example.com/en/a#b": ("x.www.example.com", "/en/a", "www.example.com/en/", "allow"), "https://example.com/EN/": ("example.com", "/EN/", "com/", "allow"),
        "https://myexample.com/en/": ("myexample.com", "/en/", "com/", "allow"), "http://a.net/es/": ("a.net", "/es/", "net/es/", "block"), "http://a.net/es": ("a.net", "/es", None, "allow"),
        "http://com": ("com", "", None, "allow"), "x://y://z/p": ("y:", "//z/p", None, "allow"), "no scheme/en/": ("", "", None, "allow"), "http://b.com?x=/en/": ("b.com", "", None, "allow"), "": ("", "", None, "allow"),
        "http://É.com:80/a\nb": ("É.com:80", "/a\nb", None, "allow"),
    }
    got = {r.page_id: tuple(r)[1:5] for r in judged(spark, enumerate(cases))}
    assert got == {i: v for i, v in enumerate(cases.values())}
    (null,) = judged(spark, [(None, None)])
    assert (null.host, null.path, null.rule, null.verdict) == ("", "", None, "allow")
    assert judged(spark, [(1, "http://a.org/")][:0]) == []


def test_reputation_shrinks_and_only_evidence_blocks(spark):
    pages, outcomes = [], []
    for host, n, good in (("bad.one.org", 60, 2), ("good.one.org", 60, 58), ("few.one.org", 1, 0), ("a.two.org", 50, 48)):
        for i in range(n):
            pages.append((len(pages), f"http://{host}/{i}"))
            outcomes.append((len(outcomes), int(i < good)))
    pages += [(9000, "http://new.one.org/"), (9001, "http://new.three.info/")]
    got = {r.host: r for r in judged(spark, pages, outcomes)}
    assert {h: r.verdict for h, r in got.items()} == {"bad.one.org": "block", "good.one.org": "allow", "few.one.org": "allow", "a.two.org": "allow", "new.one.org": "allow", "new.three.info": "allow"}
    assert 0.02 < got["bad.one.org"].posterior_mean < 0.2 and got["few.one.org"].posterior_mean > 0.2


def test_registered_domains(spark):
    names = {"a.b.example.co.uk:80": ("example.co.uk", "co.uk"), "x.example.com": ("example.com", "com"), "localhost": ("localhost", "localhost"), "u@h.org": ("h.org", "org"), "": ("", "")}
    d, s = urls.levels(F.col("h"))
    got = spark.createDataFrame([(n,) for n in names], "h string").select("h", d.alias("d"), s.alias("s")).collect()
    assert {r.h: (r.d, r.s) for r in got} == names
