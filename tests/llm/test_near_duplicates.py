import itertools
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from atlasmill.llm import graph, lines, simhash

DOCS = "doc_id long, text string, fp string, component_id string, node int"


def plain_fingerprint(text, k):
    words = [w.encode() for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({i: " " for i in (9, 10, 11, 12, 13)}).split(" ") if w]
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints_of_odd_texts(monkeypatch):
    texts = [None, "", " \t\n", "One", "one TWO three", "É one\x0btwo x three four five", "a b c d " * 50, "ÀB c", "x" * 100]
    assert [simhash.fingerprint(t) for t in texts] == [plain_fingerprint(t, 4) for t in texts]
    monkeypatch.setattr(simhash, "LONG_TEXT", 3)
    assert [simhash.fingerprint(t) for t in texts] == [plain_fingerprint(t, 4) for t in texts]


def test_components_equal_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    base = [[rng.choice(words) for _ in range(rng.randint(60, 200))] for _ in range(12)]
    texts = [None, "", "  ", "one", "one"]
    for b in base:
        for _ in range(6):
            c = list(b)
            for _ in range(rng.randint(0, 2)):
                c[rng.randrange(len(c))] = rng.choice(words)
            texts.append(" ".join(c))
    docs = spark.createDataFrame([(100 - i, t, "x", "y", 1) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    prints = {100 - i: plain_fingerprint(t, 4) for i, t in enumerate(texts)}
    pairs = [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 4]
    assert {i: r.component_id for i, r in got.items()} == plain_components(pairs, prints)
    assert {i: r.fp % (1 << 64) for i, r in got.items()} == prints
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(plain_components(pairs, prints).values())


@pytest.mark.parametrize("rows", [16_000, 20, 2])
def test_links_equal_brute_force_on_dense_fingerprints(spark, monkeypatch, rows):
    """Also with routes that are dealt out by further bits, and sorts that go on by further bits."""
    monkeypatch.setattr(simhash, "ROUTE_ROWS", rows)
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 1 << 63, 6)
    prints = {int(s) ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False)) for s in seeds for n in (0, 1, 2, 3, 4, 5, 6) for _ in range(5)}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >= 1 << 63 else p for p in prints]
    df = spark.createDataFrame(list(zip(signed, range(len(prints)))), "fp long, rep long")
    got = [tuple(r) for r in simhash.links(df).collect()]
    near = [(a, b) for a, b in itertools.combinations(range(len(prints)), 2) if (prints[a] ^ prints[b]).bit_count() <= 4]
    assert set(map(tuple, map(sorted, got))) <= set(near)
    assert plain_components(got, range(len(prints))) == plain_components(near, range(len(prints)))


def test_stars_in_small_sorts(monkeypatch):
    monkeypatch.setattr(simhash, "SORTED_AT_ONCE", 100)
    v = np.array([0, 0b1111, 1 << 40, (1 << 40) | 1], np.uint64)
    out = []
    simhash._stars(v, np.arange(4), np.full(4, 2), 48, out)
    got = {tuple(p) for p in np.concatenate(out).tolist()}
    assert got <= {(0, 1), (0, 2), (0, 3), (1, 3), (2, 3)} and set(plain_components(got, range(4)).values()) == {0}


def test_odd_radius_is_refused(spark):
    with pytest.raises(ValueError, match="even"):
        simhash.links(spark.createDataFrame([], "fp long, rep long"), radius=3)


def test_repeats_null_ids_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "", "", 0), (1, "a b", "", "", 0), (None, "a b", "", "", 0), (2, "a b", "", "", 0)], DOCS)
    got = simhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got if r.doc_id) == [(1, 1), (1, 1), (2, 1)] and [r.component_id for r in got if r.doc_id is None] == [None]
    assert simhash.keep_first(docs).count() == 3
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_an_id_of_several_texts_links_each_of_them(spark):
    texts = ["alpha beta gamma delta epsilon", "one two three four five six"]
    docs = spark.createDataFrame([(5, texts[0], "", "", 0), (5, texts[1], "", "", 0), (3, texts[1], "", "", 0), (9, texts[0], "", "", 0)], DOCS)
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(docs).collect()}
    prints = [(p - (1 << 64) if p >= 1 << 63 else p) for p in (plain_fingerprint(t, 4) for t in texts)]
    assert got == {(5, prints[0]): 5, (5, prints[1]): 3, (3, prints[1]): 3, (9, prints[0]): 5}
    assert sorted((r.doc_id, r.text) for r in simhash.keep_first(docs).collect()) == [(3, texts[1]), (5, texts[0])]


def test_graph_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (None, 3), (302, 301), (301, 302)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    want = {**dict.fromkeys(range(1, 41), 0), **dict.fromkeys(range(101, 160), 100), 302: 301}
    assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


LINES = "doc_id long, text string, n_lines string, h1 string, id int"


def plain_lines(texts, q=8, jaccard=0.8):
    """Lines kept of each text: one of each component of near lines, that of the least (doc, place)."""
    found = {}
    for d, t in sorted((d, t) for d, t in texts if t is not None):
        for i, x in enumerate(t.split("\n")):
            if x.strip(" "):
                found.setdefault(x.strip(" "), (d, i))
    sets = {x: {x[i : i + q] for i in range(max(1, len(x) - q + 1))} for x in found}
    holds = {}
    for x, grams in sets.items():
        for g in grams:
            holds.setdefault(g, []).append(x)
    common = Counter(p for xs in holds.values() for p in itertools.combinations(xs, 2))
    near = [(found[a], found[b]) for (a, b), n in common.items() if n >= jaccard * (len(sets[a]) + len(sets[b]) - n)]
    part = plain_components(near, found.values())
    return {(d): None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if not x.strip(" ") or part[found[x.strip(" ")]] == (d, i)) for d, t in texts}


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(5)
    syllables = ["ta", "ro", "ning", "ble", "sh", "ö", "漢", "and", "un"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    base = [" ".join(word() for _ in range(rng.randint(25, 60))) for _ in range(25)]
    texts = [(0, None), (1, ""), (2, " \n\n "), (3, "ab\nab\n ab\nabc"), (4, "😀" * 30 + "\n" + "😀" * 31), (5, base[0] + "\n" + "y" * 9000)]
    for d in range(6, 60):
        lines_ = []
        for _ in range(rng.randint(1, 5)):
            w = rng.choice(base).split(" ")
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = word()
            lines_.append(" ".join(w))
        texts.append((d, "\n".join(lines_)))
    docs = spark.createDataFrame([(d, t, "?", "?", 7) for d, t in texts], LINES)
    out = lines.deduplicate(docs)
    assert out.columns == ["doc_id", "text", "h1", "id", "n_lines", "n_removed"]
    got = {r.doc_id: r for r in out.collect()}
    want = plain_lines(texts)
    assert {d: None if t is None else t.count("\n") for d, t in texts if t is None or not t.strip()} == {d: None if got[d].text is None else got[d].text.count("\n") for d, t in texts if t is None or not t.strip()}
    assert {d: r.text for d, r in got.items()} == want
    exact = [t for _, t in texts if t and len(t) < 20]
    assert all(want[d] == got[d].text for d, t in texts if t in exact)
    assert got[0].n_lines == 0 and got[1].n_lines == 1
    assert all(r.n_lines - r.n_removed == (0 if r.text is None else len(r.text.split("\n"))) for r in got.values() if r.text)


def test_line_dedup_of_repeats_null_ids_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "same line\nother", "", "", 0), (1, "same line", "", "", 0), (1, "same line", "", "", 0), (1, "x\nsame line", "", "", 0)], LINES)
    got = lines.deduplicate(docs).collect()
    assert sorted((r.doc_id is not None, r.text, r.n_removed) for r in got) == [(False, "same line\nother", 0), (True, "", 1), (True, "", 1), (True, "x", 1)]
    repeats = spark.createDataFrame([(7, "a line\n\nand more", "", "", 0)] * 3 + [(8, "and more", "", "", 0), (8, None, "", "", 0), (8, None, "", "", 0)], LINES)
    got = [(r.doc_id, r.text, r.n_lines, r.n_removed) for r in lines.deduplicate(repeats).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, [(7, "a line\n\nand more", 3, 0), (7, "", 3, 2), (7, "", 3, 2), (8, "", 1, 1), (8, None, 0, 0), (8, None, 0, 0)]))
    assert lines.deduplicate(docs.limit(0)).count() == 0


def test_line_recall(spark):
    """Of pairs of lines at just over the similarity, nearly all are found."""
    rng = random.Random(9)
    rows = []
    for i in range(300):
        a = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(240))
        at = rng.randrange(20, 200)
        rows += [(2 * i, f"{a}", "", "", 0), (2 * i + 1, f"{a[:at]}#{a[at + 1:at + 9]}#{a[at + 10:]}", "", "", 0)]
    got = lines.deduplicate(spark.createDataFrame(rows, LINES)).where("n_removed = 1").count()
    assert got >= 294


def test_short_line_recall(spark):
    """Lines of 16 to 60 characters, one of each pair with characters added at the end, and all pairs that are near."""
    rng = random.Random(11)
    rows = []
    while len(rows) < 600:
        a = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(rng.randint(16, 60))).strip()
        b = a + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(max(1, (len(a) - 7) // 5)))
        x, y = ({t[i : i + 8] for i in range(len(t) - 7)} for t in (a, b))
        if len(x & y) >= 0.8 * len(x | y):
            rows += [(len(rows), a, "", "", 0), (len(rows) + 1, b, "", "", 0)]
    assert lines.deduplicate(spark.createDataFrame(rows, LINES)).where("n_removed = 1").count() >= 0.98 * len(rows) / 2


def test_line_dedup_of_many_unlike_groups_in_each_bucket(spark):
    """Lines of one long prefix meet in crowded buckets; all near pairs of sixty unlike groups are found there."""
    rng = random.Random(21)
    letters = "abcdefghijklmnopqrstuvwxyz"
    random_text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    prefix, rows = random_text(600), []
    for i in range(60):
        tail = random_text(90)
        rows += [(2 * i, prefix + tail), (2 * i + 1, prefix + "".join("#" if j % 15 == 8 else x for j, x in enumerate(tail)))]
    want = plain_lines(rows)
    assert sum(t != "" for t in want.values()) == 60
    got = {r.doc_id: r.text for r in lines.deduplicate(spark.createDataFrame([(d, t, "", "", 0) for d, t in rows], LINES)).collect()}
    assert got == want


def test_line_dedup_stores_no_text_of_lines_that_meet_no_other(spark, monkeypatch):
    """All but one copy of each line that met another goes by hashes, so that disk doesn't hold the texts again."""
    rng = random.Random(4)
    random_text = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(120))
    alike = random_text()
    store, texts = lines.stored, {}

    def kept(df, name):
        table = store(df, name)
        if "line" in table.columns:
            texts[name] = sorted(r.line for r in table.select("line").collect())
        return table

    monkeypatch.setattr(lines, "stored", kept)
    rows = [(i, f"{random_text()}\n{alike}{'x' * (i % 2)}", "", "", 0) for i in range(20)]
    got = lines.deduplicate(spark.createDataFrame(rows, LINES))
    assert got.where("n_removed = 1").count() == 19
    assert texts == {"line-candidates": [alike, alike + "x"]}


def test_line_dedup_with_several_rounds_of_comparisons(spark):
    """Many unlike pairs in one bucket, whose lines get bitmaps of different lengths, and lines whose shingles repeat."""
    rng = random.Random(8)
    random_text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    prefix, rows = random_text(70), [(0, "the " * 300), (1, "the " * 200), (2, "the " * 300 + random_text(40))]
    for i in range(40):
        line = prefix + random_text((75, 145, 245)[i % 3])
        rows += [(2 * i + 3, line), (2 * i + 4, line[:-30] + random_text(12) + line[-18:])]
    got = {r.doc_id: r.text for r in lines.deduplicate(spark.createDataFrame([(d, t, "", "", 0) for d, t in rows], LINES)).collect()}
    assert got == plain_lines(rows)


def test_line_dedup_of_short_and_longer_periodic_lines(spark):
    """Lines of equal sets of shingles are near whatever their lengths."""
    rows = [(0, "ab" * 10, "", "", 0), (1, "ab" * 45, "", "", 0), (2, "xyz" * 6, "", "", 0)]
    assert {r.doc_id: r.text for r in lines.deduplicate(spark.createDataFrame(rows, LINES)).collect()} == plain_lines([(r[0], r[1]) for r in rows]) == {0: "ab" * 10, 1: "", 2: "xyz" * 6}


def test_lines_of_one_bucket_but_unlike_lengths_are_not_compared(spark, monkeypatch):
    """Lines that share long runs but whose numbers of shingles rule them out leave the buckets before pairs are made."""
    rng = random.Random(6)
    random_text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    store, rows = lines.stored, {}

    def kept(df, name):
        table = store(df, name)
        rows.setdefault(name, table.count())
        return table

    monkeypatch.setattr(lines, "stored", kept)
    base = random_text(300)
    texts = [base, base + random_text(400), base + random_text(1200)]
    got = lines.deduplicate(spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(texts)], LINES))
    assert {r.doc_id: r.text for r in got.collect()} == dict(enumerate(texts))
    assert rows["line-buckets"] > 0 and rows["line-rest"] == rows["line-pairs"] == 0
