"""Importance resampling and the divergence audit against plain versions."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from atlasmill.llm import divergence, importance
from atlasmill.llm import queries as Q

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def runs(text):
    words = WORD.findall((text or "").translate(UPPER))
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain_resample(docs, target, percent=5, min_words=20):
    crc = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = [0] * 10000, [0] * 10000
    for texts, counts in (([x for _, x in docs], s), (target, t)):
        for x in texts:
            for f in runs(x)[1]:
                counts[crc(f)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + 10000) / ((s[b] + 1) * (sum(t) + 10000)))) for b in range(10000)]
    out = {}
    for i, x in docs:
        words, fs = runs(x)
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[crc(f)] for f in fs)
        out[i] = [len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)]
    able = sorted((i for i in out if out[i][4] >= min_words), key=lambda i: (-out[i][2], i))
    for r, i in enumerate(able[: percent * len(able) // 100]):
        out[i][3] = r + 1
    return {i: tuple(v[:4]) for i, v in out.items()}


def words_of(rng, n):
    return " ".join(rng.choice(["Alpha", "beta7", "ÉTÉ", "naïve", "x" * 70, "z" * 300, "The", "of", "a-b", "日本", "q1\tq2"]) for _ in range(n))


def documents(n, seed=3):
    rng = random.Random(seed)
    odd = [None, "", " ,. ", "one", "One two", "one two\nthree", "x" * 100_000, "x y " * 60_000, "\x00 nul\x00byte"]
    return list(enumerate(odd)) + [(i, words_of(rng, rng.randrange(60))) for i in range(len(odd), n)]


SCHEMA = "doc_id long, text string, weight string, score string, rank string, lang string, source string, row string"


def frame(spark, rows):
    return spark.createDataFrame([(i, x, "?", "?", "?", "en", "s", "?") for i, x in rows], SCHEMA)


def test_moved_crc_is_zlibs():
    rng = random.Random(0)
    for n in (0, 1, 5, 63, 64, 65, 1000, 70_001):
        a, b = rng.randbytes(10), rng.randbytes(n)
        joined = importance.moved(np.array([zlib.crc32(a)], np.uint32), np.array([n])) ^ np.uint32(zlib.crc32(b))
        assert int(joined[0]) == zlib.crc32(a + b)


def test_resampling_equals_the_plain_one(spark, monkeypatch):
    monkeypatch.setattr(importance, "FEW", 8)
    docs, target = documents(900), ["beta7 the of naïve", "Alpha 日本 q1", None]
    got = importance.resample(frame(spark, docs), spark.createDataFrame([(t,) for t in target], "text string"), percent=37)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and all(t == "bigint" for _, t in got.dtypes)
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == plain_resample(docs, target, percent=37)


def test_resampling_of_repeats_ties_and_nothing(spark):
    docs = [(7, "same words here " * 20)] * 30 + [(None, "same words here " * 20)] * 2 + [(8, "few")]
    target = spark.createDataFrame([("same words",)], "text string")
    got = importance.resample(frame(spark, docs).repartition(5), target, percent=50).collect()
    assert len(got) == 33 and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 17))
    assert importance.resample(frame(spark, docs).limit(0), target).count() == 0
    assert importance.resample(frame(spark, [(1, "a")]), target.limit(0)).collect()[0]["rank"] is None
    some = frame(spark, documents(300))
    result = importance.resample(some, target, percent=10)
    assert importance.drawn(some, result).count() == result.where("rank is not null").count() > 10


def test_cutoff_is_exact_over_uneven_partitions(spark, monkeypatch):
    monkeypatch.setattr(importance, "FEW", 3)
    rng = random.Random(5)
    rows = [(rng.randrange(40), rng.randrange(30), i) for i in range(2000)]
    keys = spark.createDataFrame(rows, "minus long, id long, `row` long").repartitionByRange(7, "minus")
    from atlasmill.llm.shared import stored

    held = stored(keys, "test-keys")
    for k in (0, 1, 2, 999, 1999, 2000):
        assert importance.cutoff(held, k) == (sorted(rows)[k - 1] if k else None)


def plain_audit(docs, min_docs, top):
    letters = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    rows = [(lang or "", source or "", letters.findall((x or "").translate(UPPER))) for lang, source, x in docs]
    out = set()
    for lang in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == lang]
        terms = {t for r in mine for t in r[2]}
        kept = {t for t in terms if sum(t in r[2] for r in mine) >= min_docs}
        sources = sorted({r[1] for r in mine})
        count = {s: {t: sum(r[2].count(t) for r in mine if r[1] == s) for t in kept} for s in sources}
        whole = {t: sum(count[s][t] for s in sources) for t in kept}
        price = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        p, q = {s: price(count[s]) for s in sources}, price(whole)
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            over = [(q[t] - p[s][t], t) for t in kept if count[s][t] and p[s][t] > q[t]]
            key = lambda x: (x[0], x[1].encode())
            out |= {(lang, s, "pair", o, -v, n + 1) for n, (v, o) in enumerate(sorted(pairs, key=key))}
            out |= {(lang, s, "term", o, -v, n + 1) for n, (v, o) in enumerate(sorted(over, key=key)[:top])}
    return out


@pytest.mark.parametrize(("band", "columns"), [(32, 1024), (3, 7), (1, 1)])
def test_audit_equals_the_plain_one(spark, monkeypatch, band, columns):
    monkeypatch.setattr(divergence, "BAND", band)
    monkeypatch.setattr(divergence, "COLUMNS", columns)
    monkeypatch.setattr(divergence, "PIECE", 64)
    rng = random.Random(1)
    vocabulary = [rng.choice("abcÉdß日") * rng.randrange(1, 4) + rng.choice("xyzXYZ") for _ in range(60)]
    docs = [(rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s10", None, "ö", "Z", "only"]), " ".join(rng.choice(vocabulary[: rng.randrange(1, 60)]) for _ in range(rng.randrange(30)))) for _ in range(150)]
    docs += [("fr", "s1", "rare"), ("fr", "s2", None), ("it", "one", "9 _ [ `")] + [("en", "s1", "long" * 50)] * 4
    df = spark.createDataFrame([(s, x, lang, "?", "?") for lang, s, x in docs], "source string, text string, lang string, item string, term string")
    got = divergence.audit(df, min_docs=4, top_terms=5)
    assert {tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect()} == plain_audit(docs, 4, 5)


def test_audit_of_nothing_and_shares_of_large_counts(spark):
    df = spark.createDataFrame([("a", "b", "c")], "lang string, source string, text string")
    assert divergence.audit(df.limit(0)).count() == 0 and divergence.audit(df).count() == 0
    n, total = 10**13 + 7, 10**15 + 3
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(9))).collect()[0][0]
    assert got == 1 + 10**9 * (n + 5) // (total + 45)


def test_terms_held_in_tasks_are_passed_on(spark, monkeypatch):
    rows = [("l", "s", " ".join(f"t{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(j, j + 50))) for j in range(60)]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    whole = {tuple(r) for r in divergence.term_counts(df).collect()}
    monkeypatch.setattr(divergence, "HELD", 10)
    assert {tuple(r) for r in divergence.term_counts(df).collect()} == whole


def test_registered_queries_on_the_smallest_tables(spark):
    from pathlib import Path

    data = Path("/root/testdata/sf0.001")
    if not data.is_dir():
        pytest.skip("no test tables")
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    assert {r.doc_id: tuple(r)[1:] for r in Q.op12_importance_resampling(spark, str(data)).collect()} == plain_resample(docs, target)
