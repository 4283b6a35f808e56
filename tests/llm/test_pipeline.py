"""Each stage of the pipeline against a plain version, and all of them together."""

import hashlib
import importlib.util
import struct
import zlib
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no test tables")


def beside(name):
    """A test file of this folder as a module, for its plain versions."""
    spec = importlib.util.spec_from_file_location(f"plain_{name}", Path(__file__).parent / f"{name}.py")
    plain = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(plain)
    return plain


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    top, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{DATA}/documents.parquet"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(DATA)).write.parquet(f"{top}/{i}")
        before, docs = docs, spark.read.parquet(f"{top}/{i}")
        out.append((name, before, docs))
    return out


def test_stages_keep_the_columns(stages):
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns and 0 < after.count() <= before.count()


def test_toxic_documents_go_and_clean_ones_stay(spark, stages):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    _, before, after = stages[0]
    gone = before.join(after, "doc_id", "left_anti").join(labels, "doc_id")
    assert gone.where("toxic = 0").count() == 0
    assert after.join(labels.where("toxic = 1"), "doc_id").count() == 0


def test_lines_are_those_that_brute_force_keeps(stages):
    plain = beside("test_near_duplicates")
    _, before, after = stages[1]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    want = plain.plain_lines(rows)
    had = dict(rows)
    want = {d: t for d, t in want.items() if t == had[d] or (t or "").strip(" ") != ""}
    assert {r.doc_id: r.text for r in after.collect()} == want


def test_the_mix_is_raking_and_a_draw(stages):
    """Tokens, topics, cells, probabilities and the draw, all in plain Python."""
    from atlasmill.llm import mixing
    from atlasmill.llm.queries import MIX, MIX_KEEP

    def topic(t):
        n, share = len(t), lambda chars: sum(t.count(c) for c in chars)
        rules = (("code", "{}();=", 25), ("table", "|", 40), ("shout", "!", 40), ("noise", "#$%&*", 25))
        return next((name for name, chars, k in rules if share(chars) * k > n), "note" if n < 500 else "prose")

    _, before, after = stages[3]
    rows, cells = {}, Counter()
    for r in before.collect():
        t = r.text or ""
        cell = tuple(v if v in MIX[d][0] else "*" for d, v in (("source", r.source), ("lang", r.lang), ("topic", topic(t))))
        rows[r.doc_id] = cell
        cells[cell] += t.count(" ") + 1 if t else 0
    targets = []
    for i, (_, power) in enumerate(MIX.values()):
        found = Counter()
        for c, n in cells.items():
            found[c[i]] += n
        targets.append(mixing.tempered(found, power))
    p = beside("test_documents").plain_rake(cells, targets, MIX_KEEP)
    want = {d for d, c in rows.items() if int(hashlib.md5(str(d).encode()).hexdigest()[:8], 16) / 2**32 < p[c]}
    assert {r.doc_id for r in after.collect()} == want and 0 < len(want) < len(rows)


def test_lines_repeat_no_more(stages):
    _, before, after = stages[1]
    lines = after.select(F.explode(F.split("text", "\n")).alias("x")).where("trim(x) <> ''").groupBy(F.trim("x")).count()
    assert lines.where("count > 1").count() == 0
    assert after.where("n_chars <> char_length(text)").count() == 0
    assert after.join(before.select("doc_id"), "doc_id", "left_anti").count() == 0


def test_one_of_each_fingerprint_stays(stages):
    from atlasmill.llm.simhash import fingerprint

    _, before, after = stages[2]
    prints = {r.doc_id: fingerprint(r.text, 5) for r in before.collect()}
    kept = {r.doc_id for r in after.collect()}
    for d, p in prints.items():
        near = [e for e, q in prints.items() if (p ^ q).bit_count() <= 4]
        assert (d in kept) or any(e < d for e in near)
        if len(near) == 1:
            assert d in kept


def test_packed_pieces_are_those_of_the_tokenizer_in_few_sequences(stages):
    from tokenizers import Tokenizer

    from atlasmill.llm.queries import tokenizer_path

    plain, tokenizer = beside("test_documents"), Tokenizer.from_file(tokenizer_path())
    _, before, after = stages[4]
    want = []
    for r in before.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        parts = [ids[at : at + 2048] for at in range(0, len(ids), 2048)]
        want += [(r.doc_id, i, 2048 * i, len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x))) for i, x in enumerate(parts)]
    got = after.collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    assert plain.check_packing(got, 2048) <= plain.plain_best_fit([w[3] for w in want], 2048)


def test_run_gives_what_its_stages_give(spark, stages):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = sorted(map(tuple, corpus_pipeline.run(spark, str(DATA)).select(*columns).collect()))
    assert got and got == sorted(map(tuple, stages[4][2].select(*columns).collect()))


def test_registry():
    assert sorted(int(n.split("_")[0][2:]) for n in entry.queries() if n.startswith("op")) == list(range(1, 14)) and "pipeline" in entry.queries()
