"""Mixing sources to target weights by iterative proportional fitting.

Documents' tokens are summed by cell: source, language and topic, with every value that a dimension doesn't list under
``*``, so there are as many cells as the listed values allow, whatever the table holds. Inclusion probabilities of the
cells are raked to each dimension's goals in turn, none above 1, until they stand still, and a document is kept where a
uniform number drawn from its id's hash is below its cell's probability.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OTHER = "*"
#: Every text has one of these topics.
TOPICS = ("code", "table", "shout", "noise", "note", "prose")
#: Fitting ends when a sweep moves no probability by more.
TOLERANCE = 1e-12


def tokens(text: Column) -> Column:
    """Space-separated words of a text; 0 for null and empty ones."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0)).otherwise(F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1).cast("long")


def topic(text: Column) -> Column:
    """A text's topic by the share of telling characters: braces and semicolons, bars, exclamations, signs; else by length."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)

    def share(chars: str) -> Column:
        rest = t
        for c in chars:  # a search for each is faster than translate()
            rest = F.replace(rest, F.lit(c), F.lit(""))
        return n - F.length(rest)

    return (
        F.when(share("{}();=") * 25 > n, "code").when(share("|") * 40 > n, "table").when(share("!") * 40 > n, "shout")
        .when(share("#$%&*") * 25 > n, "noise").when(n < 500, "note").otherwise("prose")
    )


def tempered(counts: dict[str, float], power: float) -> dict[str, float]:
    """Shares in proportion to counts' shares to a power: below 1 it lifts what is rare."""
    total = sum(counts.values()) or 1.0
    raised = {k: (v / total) ** power if v else 0.0 for k, v in counts.items()}
    return {k: v / (sum(raised.values()) or 1.0) for k, v in raised.items()}


def raised(group: list[tuple[float, float]], total: float) -> float:
    """The factor f by which sum(n * min(1, f * p)) of a group of (p, n) comes to total; if all of n is less, one that lifts each p over 0 to 1.

    Of the sums that take the first j by descending p as 1 and the others as f * p, none is less than the true one, so
    the greatest of their solutions is its own.
    """
    rest, rests = 0.0, []
    group = sorted(group, reverse=True)
    for p, n in reversed(group):
        rest += n * p
        rests.append(rest)
    full, factor = 0.0, 0.0
    for (_, n), rest in zip(group, reversed(rests)):
        if rest > 0:
            factor = max(factor, (total - full) / rest)
        full += n
    return factor


def goals(cells: dict[tuple, float], targets: list[dict[str, float]], keep: float) -> list[dict[str, float]]:
    """Tokens to keep by dimension and value: each value's share of keep times all tokens, as far as it has them.

    A value with fewer gives all of its tokens, and what it lacks is shared by the others of its dimension in proportion.
    """
    want, out = keep * sum(cells.values()), []
    for d, shares in enumerate(targets):
        has = dict.fromkeys(shares, 0.0)
        for c, n in cells.items():
            has[c[d]] += n
        part = {v: want * shares[v] / n for v, n in has.items() if n}
        f = raised([(x, has[v]) for v, x in part.items()], want)
        out.append({v: n * min(1.0, f * part[v]) if n else 0.0 for v, n in has.items()})
    return out


def rake(cells: dict[tuple, float], targets: list[dict[str, float]], keep: float, sweeps: int = 200) -> dict[tuple, float]:
    """Inclusion probabilities of cells (values by dimension -> tokens): proportional fitting to the goals of targets.

    targets: by dimension, each value's share of what is kept. A step takes a dimension's values in turn and multiplies
    their cells' probabilities, those that would pass 1 excepted, so that the value's goal is met exactly. Sweeps end
    when none moves a probability by more than TOLERANCE. If ``sweeps`` of them don't get there, or goals of several
    dimensions exclude each other, a warning names the values over a hundredth away, with their share of the goal.
    """
    wanted, p = goals(cells, targets, keep), dict.fromkeys(cells, keep)
    members: list[dict[str, list[tuple]]] = []
    for d, goal in enumerate(wanted):
        members.append({v: [] for v in goal})
        for c in sorted(cells):
            members[d][c[d]].append(c)
    for _ in range(sweeps):
        last = dict(p)
        for d, goal in enumerate(wanted):
            for v, of in members[d].items():
                if any(cells[c] for c in of):
                    f = raised([(p[c], cells[c]) for c in of], goal[v])
                    p.update((c, min(1.0, f * p[c])) for c in of)
        if all(abs(x - last[c]) <= TOLERANCE for c, x in p.items()):
            break
    away = []
    for d, goal in enumerate(wanted):
        now = {v: sum(cells[c] * p[c] for c in of) for v, of in members[d].items()}
        away += [f"{v} {now[v] / n:.3f}" for v, n in sorted(goal.items()) if n > 0 and abs(now[v] / n - 1) > 0.01]
    if away:
        warnings.warn(f"mixing ends away from its goals: {', '.join(away)}", stacklevel=2)
    return p


def mix(docs: DataFrame, dims: dict[str, tuple[list[str], float | dict[str, float]]], keep: float = 0.8, sweeps: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with columns mix_tokens, mix_probability and mix_kept.

    dims: dimension -> (listed values, target), where target is the share of each listed value and of ``*``, or the
    power that tempers the shares found; rake() says how shares out of reach are met. sweeps bounds the fitting's sweeps. A dimension is a column of docs, or ``topic``, which is derived from the text
    whether or not docs has such a column. Nulls and values not listed count as ``*``. The sample depends on ids and
    nothing else, so repeated rows go or stay together; a null id draws like an empty one. Documents without tokens
    are drawn like others of their cell. A very long text is one document like others: it is kept or not as a whole. An empty table gives an empty result. Columns named like those added are
    replaced.
    """
    cell = {d: F.col(f"`{d}`").cast("string") if d != "topic" else topic(F.col(text_col)) for d in dims}
    cell = {d: F.when(c.isin(dims[d][0]), c).otherwise(OTHER) for d, c in cell.items()}
    names = [f"_mix_{d}" for d in dims]
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("mix_tokens", "mix_probability", "mix_kept")], tokens(F.col(text_col)).alias("mix_tokens"), *[c.alias(n) for n, c in zip(names, cell.values())])
    # a row for each combination of listed values at most
    cells = {tuple(r[n] for n in names): float(r["t"]) for r in base.groupBy(*names).agg(F.sum("mix_tokens").alias("t")).collect()}
    targets = []
    for i, (_, target) in enumerate(dims.values()):
        found: dict[str, float] = {}
        for c, n in sorted(cells.items()):
            found[c[i]] = found.get(c[i], 0.0) + n
        targets.append({v: target.get(v, 0.0) for v in found} if isinstance(target, dict) else tempered(found, target))
    p = rake(cells, targets, keep, sweeps)
    spark = docs.sparkSession
    table = spark.createDataFrame([(*c, x) for c, x in p.items()], ", ".join(f"`{n}` string" for n in names) + ", mix_probability double")
    drawn = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double") / 2**32
    return base.join(F.broadcast(table), names).withColumn("mix_kept", drawn < F.col("mix_probability")).drop(*names)
