"""Personal data against a plain version with Python's regular expressions, and discovery by planted contexts."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from atlasmill.llm import pii

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in twice) % 10 == 0


def plain(text):
    out = []
    for kind, form in FORMS.items():
        for m in re.finditer(form, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else False, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def found(df, **params):
    got = pii.find(df, **params)
    name = lambda spans: [(pii.KINDS[s.kind], s.start, s.end) for s in spans]
    return [(r.doc_id, name(r.base), name(r.spans)) for r in got.collect()]


ODD = [
    None, "", "@", "a@b", "a@b.c", "a@b.c@d.e+x@f.g.", "x..@-.-", "a@b..c", "é@b.c", "a@é.b", "1.2.3.4.5.6.7.8", "1.2.3.4", "256.1.1.1 1.1.1.255", "0001.0002.0.000255", "1.2.3.99999999999999999999",
    "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111111", "4111111111111112", "x4111111111111111y", "411111111111111", "41111111111111111111", "+1 (743) 555-3824", "+1 (743) 555-3824 227.5.221.1", "++49.30-1234567)", "+12345678901234567", "+1 2", "+1()-. 234567",
    "日本 +81 90 1234 5678 😀 a.b@c.de 😀 10.0.0.1", "a" * 50_000, "9" * 50_000, "+" * 20_000, "a@" * 20_000, "1." * 30_000, "- " * 20_000 + "5", "a@b" + ".c" * 30_000, "1 " * 30_000, "mail me: x@y.zz, or\nring +44 20 7946 0958.", "0 00 <s> @0", " +49 30 1234567\x00", "1" + "." * 30_000,
]
SCHEMA = "doc_id long, text string, kind string, spans string, s string, th string, pattern string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "?", "?", "?", "?", "?") for i, t in enumerate(texts)], SCHEMA)


def test_fixed_forms_equal_the_plain_ones(spark):
    rng = random.Random(7)
    parts = ["a@b.c", "1.2.3.4", "4111 1111 1111 1111", "+1 (743) 555-3824", " ", ".", "-", "+", "@", "7", "x", "é", "😀", "\n", "(", ")", "255", "4242424242424242", "%"]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(600)]
    got = {i: (base, spans) for i, base, spans in found(frame(spark, texts), support=10**6)}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i][0] == plain(t), (i, (t or "")[:80])
        assert got[i][1] == got[i][0]


def test_running_sums(spark):
    for n in (0, 1, 2, 3, 64, 1000):
        got = spark.range(1).select(pii.running(F.sequence(F.lit(1), F.lit(n)) if n else F.array().cast("array<bigint>")).alias("x")).collect()[0].x
        assert got == [i * (i + 1) // 2 for i in range(1, n + 1)]


def planted():
    """Numbers follow "my phone is", addresses "write to"; of each two can only be told by what stands before them."""
    rng = random.Random(2)
    filler = lambda: " ".join(rng.choice("alpha beta gamma delta is to the".split()) for _ in range(12))
    texts = [f"{filler()} my phone is +1 (555) 010-{1000 + i} {filler()} write to user{i}@host{i % 5}.org {filler()}" for i in range(12)]
    texts += [f"{filler()} my phone is 555 010-77{i}4, {filler()}" for i in range(2)] + [f"{filler()} write to someone@localhost{i}" for i in range(2)]
    clean = [f"{filler()} in 2024 there were 31415926 {filler()} to 9 of 1{i}" for i in range(12)]
    return texts, clean


def test_contexts_discover_unseen_identifiers(spark):
    texts, clean = planted()
    got = {i: (base, spans) for i, base, spans in found(frame(spark, texts + clean), confidence=0.7, support=3)}
    added = {i: [s for s in spans if s not in base] for i, (base, spans) in got.items()}
    said = {i: [(k, (texts + clean)[i][a:b]) for k, a, b in spans] for i, spans in added.items() if spans}
    assert said == {12: [("phone", "555 010-7704")], 13: [("phone", "555 010-7714")], 14: [("email", "someone@localhost0")], 15: [("email", "someone@localhost1")]}
    for i, (base, spans) in got.items():
        assert base == plain((texts + clean)[i]) and set(base) <= set(spans)


def test_patterns_and_their_places(spark, monkeypatch):
    texts, clean = planted()
    df = frame(spark, texts + clean)
    by_pattern = {(r.pattern, pii.KINDS[r.kind]): r for r in pii.bootstrap(df, confidence=0.7).patterns.collect()}
    assert set(by_pattern) == {("phone is", "phone"), ("write to", "email")}
    assert by_pattern["phone is", "phone"].places == 14 and by_pattern["write to", "email"].places == 14
    wanted = spark.createDataFrame([("is",), ("phone is",), ("<s>",), (" <s>",), ("never seen",)], "pattern string")
    ways = []
    for limit in (10, 0):
        monkeypatch.setattr(pii, "BROADCAST", limit)
        ways.append({r.pattern: r.places for r in pii.occurrences(df, "text", wanted).collect()})
    assert ways[0] == ways[1] and ways[0]["phone is"] == 14 and ways[0]["<s>"] == ways[0][" <s>"] == 28 and "never seen" not in ways[0]


def test_repeats_null_ids_and_nothing(spark):
    row = "my phone is +1 (555) 010-1000"
    df = spark.createDataFrame([(None, row), (None, row), (1, row), (1, "other"), (2, None)], "doc_id long, text string")
    got = sorted(found(df), key=str)
    assert len(got) == 5 and sum(bool(base) for _, base, _ in got) == 3
    assert found(df.limit(0)) == []


def test_redaction(spark):
    texts = ["call +1 (743) 555-3824 or é a@b.cd!", "none", None, "a@b.cd a@b.cd"]
    df = frame(spark, texts)
    got = {r.doc_id: r.t for r in pii.find(df).join(df.select("doc_id", "text"), "doc_id").select("doc_id", pii.redacted(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert got == {0: "call <phone> or é <email>!", 1: "none", 2: None, 3: "<email> <email>"}


def test_query_on_the_smallest_table(spark):
    from pathlib import Path

    from atlasmill.llm import queries as Q

    data = Path("/root/testdata/sf0.001")
    if not data.is_dir():
        pytest.skip("no test tables")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = Q.op11_personal_data(spark, str(data)).collect()
    assert len(got) == len(texts)
    for r in got:
        base = plain(texts[r.doc_id])
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest() and set(said.split(",")) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in pii.KINDS]
