import itertools
import random
import warnings
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from atlasmill.llm import mixing, packing, sharding, toxicity
from atlasmill.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, size string, shard string, piece string, score string, source string, lang string, topic string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "?", "?", "?", "?", "s", "en", "?") for i, t in rows], DOCS)


ODD = [(1, None), (2, ""), (3, "a"), (4, "word " * 30_000), (5, "a"), (5, "a"), (5, "b"), (None, "n"), (6, "漢字 é́ İx <|endoftext|> \x1cz don't I'LL")]


# --- toxicity -----------------------------------------------------------------------------------------------------


def labelled(spark, n=400):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(5, 400))]
        if i % 4 == 0:
            text.insert(rng.randrange(len(text)), rng.choice(["zwxyq", "vukkuv"]))
        rows.append((i, " ".join(text)))
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(n)], "doc_id long, toxic int, score int")
    return docs(spark, rows), labels


def test_held_out_accuracy(spark):
    d, labels = labelled(spark)
    model = toxicity.fit(d, labels.where(~toxicity.held_out("doc_id")))
    got = toxicity.score(d, model).join(labels.select("doc_id", "toxic"), "doc_id").where(toxicity.held_out("doc_id")).collect()
    assert len(got) > 60 and all((r.score >= 0.5) == bool(r.toxic) for r in got)
    kept = toxicity.keep_clean(d, model)
    assert kept.columns == d.columns and 295 <= kept.count() <= 305


def test_scores_of_odd_texts(spark):
    d, labels = labelled(spark, 120)
    model = toxicity.fit(d, labels)
    got = toxicity.score(docs(spark, ODD), model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(docs(spark, ODD).limit(0), model).count() == 0 and toxicity.keep_clean(docs(spark, ODD).limit(0), model).count() == 0
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1


def test_fit_without_both_labels(spark):
    d, labels = labelled(spark, 20)
    for some, want in ((labels.limit(0), 0.5), (labels.where("toxic = 0"), 0.0), (labels.withColumn("toxic", F.lit(None).cast("int")), 0.5)):
        assert abs(toxicity.fit(d, some).score("x") - want) < 1e-6
    assert toxicity.fit(d.limit(0), labels).score("x") == pytest.approx(0.25, abs=0.01)


def test_features_in_pieces(monkeypatch):
    text = "Some text, é漢😀 " * 50
    want = toxicity.features(text)
    monkeypatch.setattr(toxicity, "PIECE", 7)
    assert np.array_equal(toxicity.features(text), want)


def test_held_out_is_the_crc(spark):
    got = spark.range(200).select("id", toxicity.held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)


# --- packing ------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_encoder_equals_the_tokenizer(tokenizer, monkeypatch):
    encoder = packing.PieceEncoder(tokenizer_path())
    rng = random.Random(0)
    letters = "abcdefghijzé ßÀÇñ .,'\"!?-_()#$%&*@0123456789²½\n\t\xa0\x85ÿĀſ'"
    texts = [t or "" for _, t in ODD] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += [a + b for a in texts[9:60] for b in ("'s", "'re'll", "<|endoftext|>", "\x1f", "Ə", "ς Σ", "\0", "e\u0301", "😀")]
    for size in (1 << 20, 5):
        monkeypatch.setattr(packing, "PIECE", size)
        for t in texts:
            assert np.frombuffer(encoder.encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def check_packing(rows, capacity, max_docs=None, max_attention=None):
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity and len(parts) <= (max_docs or at) and sum(n * n for _, n in parts) <= (max_attention or at * at)
    return len(held)


def test_pieces_and_packing_of_odd_texts(spark, tokenizer):
    parts = packing.pieces(docs(spark, ODD), tokenizer_path(), capacity=64, keep_ids=True)
    rows = parts.collect()
    whole = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id or 0, r.piece)):
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length <= 64 and zlib.crc32(r.ids) == r.ids_crc32 and r.start == 64 * r.piece
        whole[r.doc_id].append(ids)
    for i, t in ODD:
        if i not in (5, None):
            assert sum(whole[i], []) == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
    packed = packing.pack(parts, capacity=64).collect()
    assert len(packed) == len(rows)
    n = check_packing(packed, 64)
    assert n <= -(-sum(r.length for r in rows) // 64) + 1
    assert packing.pack(parts.limit(0), capacity=64).count() == 0 and packing.pieces(docs(spark, ODD).limit(0), tokenizer_path()).count() == 0


def plain_best_fit(lengths, capacity):
    """Longest first, each into the open bin that it leaves the fullest, or a new one."""
    rest = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rest) if r >= n]
        if fits:
            rest[min(fits, key=lambda i: rest[i])] -= n
        else:
            rest.append(capacity - n)
    return len(rest)


@pytest.mark.parametrize("low, high", [(1, 400), (200, 700), (513, 1024)])
def test_groups_take_hardly_more_sequences_than_one(spark, low, high):
    """Sequences that small groups leave with room are packed again across groups."""
    rng = random.Random(low)
    rows = [(None if i % 50 == 0 else i, 0, 0, rng.randint(low, high), i % 700) for i in range(3000)]
    parts = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(parts, capacity=1024, group_rows=100).collect()
    assert sorted((r.doc_id or -1, r.length, r.ids_crc32) for r in got) == sorted((d or -1, n, c) for d, _, _, n, c in rows)
    assert check_packing(got, 1024) <= plain_best_fit([r[3] for r in rows], 1024) * 1.01 + 1


@pytest.mark.parametrize("measure", ["norm", "dot"])
def test_every_constraint_holds(spark, measure):
    rng = random.Random(4)
    rows = [(i, 0, 0, rng.randint(1, 60), i) for i in range(600)]
    parts = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(parts, capacity=100, max_docs=4, max_attention=4000, measure=measure, group_rows=200).collect()
    assert len(got) == 600 and len({r.doc_id for r in got}) == 600
    check_packing(got, 100, 4, 4000)
    with pytest.raises(Exception, match="larger than a sequence"):
        packing.pack(parts, capacity=10).collect()


def test_few_bins_for_vectors():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 2048, 3000).astype(float)
    sizes = np.stack([lengths, np.ones(3000), lengths**2], axis=1)
    bins, places = packing.vector_best_fit(sizes, np.array([2048.0, 2048.0, 2048.0**2]))
    assert len(set(bins.tolist())) <= 1.01 * max(lengths.sum() / 2048, (lengths > 1024).sum()) and (np.bincount(bins, weights=lengths) <= 2048).all()
    assert set(zip(bins.tolist(), places.tolist())) == {(b, p) for b in set(bins.tolist()) for p in range((bins == b).sum())}


# --- sharding -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("run_rows", [sharding.RUN_ROWS, 20])
def test_shards(spark, monkeypatch, run_rows):
    monkeypatch.setattr(sharding, "RUN_ROWS", run_rows)
    rng = random.Random(1)
    rows = [(i, rng.choice("abc") * rng.randint(0, 3000)) for i in range(2000)] + ODD
    got = sharding.shard(docs(spark, rows), shards=7).collect()
    assert len(got) == len(rows)
    sizes, slots, of_text = defaultdict(int), defaultdict(list), {}
    size = lambda t: len((t or "").encode()) + 16
    assert sorted((r.doc_id or -1, r["size"], r.text_crc32) for r in got) == sorted((i or -1, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    for r in got:
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        assert of_text.setdefault((r["size"], r.text_crc32), r.shard) == r.shard
    assert set(sizes) == set(range(7)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(sizes.values()) / 7
    assert max(sizes.values()) - min(sizes.values()) <= 0.001 * mean
    assert sharding.shard(docs(spark, rows).limit(0)).count() == 0


def test_a_heavy_group_stays_whole(spark):
    rows = [(i, "hot" * 50) for i in range(300)] + [(1000 + i, "t" * i) for i in range(300)]
    got = sharding.shard(docs(spark, rows), shards=4, items=1000).groupBy("shard").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("z")).collect()
    sizes = sorted(r.s for r in got)
    assert sizes[-1] == 300 * 166 and sizes[-2] - sizes[0] <= 0.002 * sizes[0]


@pytest.mark.parametrize("seed", range(5))
def test_differencing_against_every_partition(seed):
    """The spread is close to the least of all partitions, and never that of a cruder one: largest first to the lightest."""
    rng = random.Random(seed)
    weights = {i: rng.randint(1, 1000) for i in range(9)}

    def spread(parts):
        sums = [sum(w for i, w in weights.items() if parts[i] == p) for p in range(3)]
        return max(sums) - min(sums)

    best = min(spread(dict(enumerate(choice))) for choice in itertools.product(range(3), repeat=9))
    got = sharding.karmarkar_karp(weights, 3)
    sums, greedy = [0, 0, 0], {}
    for i, w in sorted(weights.items(), key=lambda x: -x[1]):
        greedy[i] = sums.index(min(sums))
        sums[greedy[i]] += w
    assert set(got) == set(weights) and best <= spread(got) <= max(spread(greedy), best + 60)


def test_differencing():
    weights = {i: w for i, w in enumerate([8, 7, 6, 5, 4])}
    parts = sharding.karmarkar_karp(weights, 2)
    sums = [sum(w for i, w in weights.items() if parts[i] == p) for p in (0, 1)]
    assert abs(sums[0] - sums[1]) == 2
    assert sharding.karmarkar_karp({}, 3) == {} and sharding.karmarkar_karp({"a": 5}, 3) == {"a": 2}


# --- mixing -------------------------------------------------------------------------------------------------------


def test_raking_meets_targets():
    rng = random.Random(0)
    cells = {(a, b): float(rng.randint(50, 500)) for a in "xyz" for b in "pq"}
    targets = [{"x": 0.3, "y": 0.3, "z": 0.4}, {"p": 0.5, "q": 0.5}]
    p = mixing.rake(cells, targets, 0.3, 60)
    total = sum(cells.values())
    for d, shares in enumerate(targets):
        for v, share in shares.items():
            assert sum(n * p[c] for c, n in cells.items() if c[d] == v) == pytest.approx(0.3 * total * share, rel=1e-6)


def plain_goals(cells, shares, d, want):
    """Goals of a dimension, its scale found by halving an interval."""
    has = {v: sum(n for c, n in cells.items() if c[d] == v) for v in shares}
    low, high = 0.0, 1e9
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(has[v], mid * want * s) for v, s in shares.items()) < want else (low, mid)
    return {v: min(has[v], high * want * s) for v, s in shares.items()}


def plain_rake(cells, targets, keep):
    """Each step's factors by halving an interval, many sweeps."""
    p = dict.fromkeys(cells, keep)
    for _ in range(150):
        for d, shares in enumerate(targets):
            goal = plain_goals(cells, shares, d, keep * sum(cells.values()))
            for v in shares:
                of, low, high = [c for c in cells if c[d] == v], 0.0, 1e6
                for _ in range(90):
                    mid = (low + high) / 2
                    low, high = (mid, high) if sum(cells[c] * min(1.0, mid * p[c]) for c in of) < goal[v] else (low, mid)
                p.update({c: min(1.0, high * p[c]) for c in of})
    return p


@pytest.mark.parametrize("seed", range(4))
def test_raking_with_shares_out_of_reach(seed):
    """Values without enough tokens give all they have, the others of the dimension take what they lack, and the kept share is met."""
    rng = random.Random(seed)
    cells = {(a, b): float(rng.randint(50, 500)) for a in "xyz" for b in "pq"}
    cells["x", "p"] = 0.0
    targets = [{"x": 0.6, "y": 0.2, "z": 0.2}, {"p": 0.45, "q": 0.55}]
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        p = mixing.rake(cells, targets, 0.7)
    want = plain_rake(cells, targets, 0.7)
    assert all(p[c] == pytest.approx(want[c], abs=1e-6) for c, n in cells.items() if n) and all(0 <= x <= 1 for x in p.values())
    assert sum(n * p[c] for c, n in cells.items()) == pytest.approx(0.7 * sum(cells.values()))
    assert sum(n * p[c] for c, n in cells.items() if c[0] == "x") == pytest.approx(min(0.42 * sum(cells.values()), cells["x", "q"]))


def test_raking_of_goals_that_exclude_each_other_and_of_none():
    cells = {("x", "p"): 100.0, ("y", "q"): 100.0}
    with pytest.warns(UserWarning, match="x 0.111, y 9"):
        mixing.rake(cells, [{"x": 0.9, "y": 0.1}, {"p": 0.1, "q": 0.9}], 0.5)
    assert mixing.rake(cells, [{"x": 0.0, "y": 1.0}], 0.5) == {("x", "p"): 0.0, ("y", "q"): 1.0}
    assert mixing.rake(cells, [{"x": 0.0, "y": 0.0}], 0.5) == {("x", "p"): 0.0, ("y", "q"): 0.0}
    assert mixing.rake({}, [{}, {}], 0.5) == {} and mixing.raised([], 1.0) == 0.0


def test_mix_samples_to_the_targets(spark):
    rows = [(i, "w " * 99 + "w", "?", "?", "?", "?", "big" if i % 10 else "small", "en" if i % 3 else "xx", "?") for i in range(4000)]
    d = spark.createDataFrame(rows, DOCS)
    dims = {"source": (["big", "small"], {"big": 0.5, "small": 0.5}), "lang": (["en"], {"en": 0.7, "*": 0.3}), "topic": (list(mixing.TOPICS), 1.0)}
    out = mixing.mix(d, dims, keep=0.15, sweeps=20)
    assert out.columns == [*d.columns, "mix_tokens", "mix_probability", "mix_kept"]
    got = {(r.source): r for r in out.groupBy("source").agg(F.sum(F.col("mix_tokens") * F.col("mix_probability")).alias("e"), F.sum(F.when(F.col("mix_kept"), F.col("mix_tokens"))).alias("k")).collect()}
    assert got["big"].e == pytest.approx(got["small"].e, rel=0.01) and abs(got["big"].k / got["small"].k - 1) < 0.2


def test_mix_of_odd_rows(spark):
    dims = {"source": (["s"], 0.5), "lang": (["en"], 0.5)}
    out = mixing.mix(docs(spark, ODD).withColumn("lang", F.when(F.col("doc_id") > 2, F.col("lang"))), dims).collect()
    assert len(out) == len(ODD) and all(0 <= r.mix_probability <= 1 for r in out)
    assert len({r.mix_kept for r in out if r.doc_id == 5 and r.text == "a"}) == 1 and {r.mix_tokens for r in out if not r.text} == {0}
    assert mixing.mix(docs(spark, ODD).limit(0), dims).count() == 0


def test_topics(spark):
    texts = {"if (x) { y(); z(); }": "code", "a | b | c": "table", "stop! now! go!": "shout", "a# b$ c% d": "noise", "plain": "note", "plain words " * 60: "prose"}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", mixing.topic(F.col("t")).alias("k")).collect()
    assert {r.t: r.k for r in got} == texts
