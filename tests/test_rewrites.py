"""Rewrites that fail between their steps, and bad rows set apart."""

import pytest

from atlasmill import sources as Z
from atlasmill.plans import sinks as K
from atlasmill.sources.folders import Versions, scratch


def values(spark, path):
    return [r.value for r in Z.numbered_lines(spark, path).orderBy("seq").collect()]


def upper(spark, path):
    return Z.numbered_lines(spark, path).orderBy("seq").selectExpr("upper(value) AS value")


@pytest.mark.parametrize("step", ["first write", "mark", "replacing"])
def test_a_rewrite_that_fails_loses_nothing(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "lines")
    (tmp_path / "lines").write_text("a\nb\nc\n", encoding="utf-8")
    whole, write, calls = ["a", "b", "c"], K.write_lines, []

    def lost(*args, **kwargs):
        raise OSError("lost")

    def failing(df, to, dry_run=False):
        calls.append(to)
        if step == "first write" or len(calls) > 1:
            if step == "replacing":  # what was there is gone already
                (tmp_path / "lines").unlink()
            lost()
        return write(df, to, dry_run)

    with monkeypatch.context() as m:
        m.setattr(K, "write_lines", failing)
        if step == "mark":
            m.setattr(Versions, "commit", lost)
        with pytest.raises(OSError):
            K.rewrite_lines(upper(spark, path), path)
    assert values(spark, path) == (["A", "B", "C"] if step == "replacing" else whole)
    assert K.restore(spark, path) == (step == "replacing")
    assert values(spark, path) == (["A", "B", "C"] if step == "replacing" else whole)
    K.rewrite_lines(upper(spark, path), path)
    K.rewrite_lines(upper(spark, path), path)
    assert values(spark, path) == ["A", "B", "C"] and not list(tmp_path.glob("*.versions"))


def test_bad_rows_are_set_apart_in_the_same_pass(spark, tmp_path):
    for name, text in (("a.tsv", "h\th\th\n1\tx\ty\nshort\n\n2\tx\ty\tmore\n"), ("b.tsv", "h\n3\t\t\n \t \nonly\tone\n")):
        (tmp_path / name).write_text(text, encoding="utf-8")
    path, apart = str(tmp_path / "*.tsv"), scratch(spark, "apart")
    good = Z.tab_rows_apart(spark, path, ["k", "p", "q"], apart, header=True)
    assert [tuple(r)[1:] for r in good.orderBy("seq").collect()] == [("1", "x", "y"), ("2", "x", "y"), ("3", "", "")]
    assert [(r.seq, r.line_no, r.reason, r.value) for r in Z.bad_rows(spark, apart).orderBy("seq").collect()] == [(2, 2, "1 columns, 3 expected", "short"), (8, 3, "2 columns, 3 expected", "only\tone")]
    with pytest.raises(Z.TooManyBadRows, match="3 bad lines, 2 allowed"):
        Z.tab_rows_apart(spark, path, ["k", "p", "q"], apart, header=True, exact=True, most=2)
    assert Z.bad_rows(spark, apart).count() == 2  # those of the last pass that was accepted
    assert Z.tab_rows_apart(spark, path, ["k", "p", "q"], apart, header=True, exact=True, most=3).count() == 2
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "e.tsv").write_text("", encoding="utf-8")
    assert Z.tab_rows_apart(spark, str(tmp_path / "none"), ["k"], scratch(spark, "apart")).count() == 0
