"""URL filters: explicit rules first, then empirical-Bayes host reputation.

Labelled outcomes of pages are counted by host. A beta-binomial prior shrinks them level by level: a suffix's rate
towards all pages', a registered domain's towards its suffix's, a host's towards its domain's. The strength of each
level's prior is estimated from the spread of the rates at that level (method of moments). A host is blocked when
the upper bound of its posterior rate of good outcomes is below the threshold: only evidence blocks, a host without
outcomes has its domain's, suffix's or the overall posterior and its width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atlasmill.llm.shared import stored

#: Bounds of a prior's strength, in pages.
WEAKEST, STRONGEST = 1.0, 1000.0
#: Second labels under which domains are registered, as in example.co.uk.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null and where there is no ://."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits; rules: 'host/path prefix' -> verdict, kept as conditions."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r), r)):
        name, _, prefix = r.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{prefix}")
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, rules[r]).otherwise(verdict)
    return rule, verdict


def levels(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host (port and user left out): the last two labels and the last, or three and two under SECOND_LEVEL of a country."""
    name = F.regexp_replace(host, r"^.*@|:\d*$", "")
    two = F.substring_index(name, ".", -2)
    deep = two.rlike(rf"^(?:{'|'.join(SECOND_LEVEL)})\.[a-z][a-z]$")
    return F.when(deep, F.substring_index(name, ".", -3)).otherwise(two), F.when(deep, two).otherwise(F.substring_index(name, ".", -1))


def _strength(groups: DataFrame) -> float:
    """A prior's strength from groups (n, k, m: the mean that each group's rate is drawn around), by moments."""
    apart = F.col("k") / F.col("n") - F.col("m")
    n, g, nn, ss, vv = groups.agg(F.sum("n"), F.count("n"), F.sum(F.col("n") * F.col("n")), F.sum(F.col("n") * apart * apart), F.sum(F.col("n") * F.col("m") * (1 - F.col("m")))).first()
    if not g or n <= nn / n:
        return STRONGEST
    between = (ss - g * vv / n) / (n - nn / n)
    return min(STRONGEST, max(WEAKEST, vv / n / between - 1)) if between > 0 else STRONGEST


def reputation(outcomes: DataFrame) -> tuple[list[DataFrame], tuple[float, float]]:
    """[by suffix, by (suffix, domain), by (suffix, domain, host)] of posterior (a, b), and the overall one, from
    outcomes (host, domain, suffix, good 0 or 1). Nulls of good count for nothing."""
    known = outcomes.where("good is not null")
    host = known.groupBy("suffix", "domain", "host").agg(F.count("good").cast("double").alias("n"), F.sum("good").cast("double").alias("k"))
    host = stored(host, "host-outcomes")
    domain = host.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffix = host.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    n, k = host.agg(F.coalesce(F.sum("n"), F.lit(0.0)), F.coalesce(F.sum("k"), F.lit(0.0))).first()
    overall = (k + 1, n - k + 1)
    mean = overall[0] / (overall[0] + overall[1])
    out, above, keys = [], None, []
    for level, key in ((suffix, "suffix"), (domain, "domain"), (host, "host")):
        drawn = level.join(above, keys) if keys else level.withColumn("m", F.lit(mean))
        strength = _strength(drawn)
        keys = [*keys, key]
        post = drawn.select(*keys, (F.col("m") * strength + F.col("k")).alias("a"), ((1 - F.col("m")) * strength + F.col("n") - F.col("k")).alias("b"))
        above = post.select(*keys, (F.col("a") / (F.col("a") + F.col("b"))).alias("m"))
        out.append(post)
    return out, overall


def judge(pages: DataFrame, outcomes: DataFrame, rules: dict[str, str], id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5, z: float = 1.645) -> DataFrame:
    """(id_col, host, path, rule, verdict, posterior_mean, posterior_bound) of every page.

    outcomes: (id_col, good 0 or 1) of some pages. verdict is the longest fitting rule's, else block where the
    posterior rate of good outcomes, mean plus z deviations, is below threshold, else allow. A null url and one without
    :// have empty host and path, fit no rule, and share one reputation. Repeated ids and rows each come out; an outcome
    counts for every page of its id. Without outcomes nothing is blocked but by rules. An empty table gives an empty
    result. Other columns are not read, so names may clash.
    """
    host, path = host_path(F.col(url_col))
    parsed = pages.select(id_col, F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    rule, by_rule = matching_rule(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumns({"rule": rule, "_by_rule": by_rule})
    domain, suffix = levels(F.col("host"))
    good = outcomes.select(F.col(id_col), F.col("good").cast("int").alias("good"))
    seen = parsed.join(good, id_col).select("host", domain.alias("domain"), suffix.alias("suffix"), "good")
    (suffixes, domains, hosts), (a0, b0) = reputation(seen)
    named = parsed.select("host").distinct().select("host", domain.alias("domain"), suffix.alias("suffix"))
    for level, keys, mark in ((hosts, ["suffix", "domain", "host"], "h"), (domains, ["suffix", "domain"], "d"), (suffixes, ["suffix"], "s")):
        named = named.join(level.withColumnsRenamed({"a": f"a{mark}", "b": f"b{mark}"}), keys, "left")
    a, b = (F.coalesce(f"{x}h", f"{x}d", f"{x}s", F.lit(y)) for x, y in (("a", a0), ("b", b0)))
    known = named.select("host", a.alias("a"), b.alias("b"))
    n, mean = F.col("a") + F.col("b"), F.col("a") / (F.col("a") + F.col("b"))
    known = known.select("host", mean.alias("posterior_mean"), (mean + z * F.sqrt(F.col("a") * F.col("b") / (n * n * (n + 1)))).alias("posterior_bound"))
    known = stored(known, "host-reputation")  # read from a table, its join can be split where a host has very many pages
    verdict = F.coalesce("_by_rule", F.when(F.col("posterior_bound") < threshold, "block").otherwise("allow"))
    return parsed.join(known, "host").select(id_col, "host", "path", "rule", verdict.alias("verdict"), "posterior_mean", "posterior_bound")
