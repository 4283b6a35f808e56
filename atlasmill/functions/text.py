"""Address text: trimming, expansion of multi-building addresses, tokens and runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from atlasmill.functions import rules as R


def bind(value: Column, use) -> Column:
    """use(value) with value computed once: a lambda's variable stands for it, however often use names it."""
    return F.get(F.transform(F.array(value), use), 0)


def control_trim(x) -> Column:
    """Without the characters up to U+0020 at both ends; other white space stays."""
    return F.regexp_replace(x, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def abbreviated(x: Column, n: int = 20) -> Column:
    """The first n characters, with … behind them where there are more."""
    return F.when(F.char_length(x) > n, F.concat(F.left(x, F.lit(n)), F.lit("…"))).otherwise(x)


def url_encoded(x: Column) -> Column:
    """Percent-encoded UTF-8 as in forms: a space is +."""
    return F.url_encode(x)


def query_digest(x: Column) -> Column:
    """MD5 of the UTF-8 text, as lower-case hex."""
    return F.md5(F.encode(x, "UTF-8"))


def or_empty(x) -> Column:
    return F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))


def without_alias(x: Column) -> Column:
    """Without parenthesised parts; as it was where nothing else is in it."""
    stripped = control_trim(F.regexp_replace(x, R.ALIAS, ""))
    return F.when(stripped == "", x).otherwise(stripped)


def dots_to_separators(x: Column) -> Column:
    return F.regexp_replace(x, r"(?<=\d)\.(?=\d)", "、")


def is_unit_fragment(x: Column) -> Column:
    return x.rlike(f"^(?:{R.UNIT_FRAGMENT})$") | x.rlike(f"^(?:{R.PURE_TOKEN})$")


def stripped_prefix(x: Column) -> Column:
    """What stands before the unit that ends x, else null. Tokens are taken from the left, so of a long tail of letters
    and digits only the last run of at most four goes."""

    def before(pattern: str) -> Column:
        last = F.try_element_at(F.regexp_extract_all(x, F.lit(f"({pattern})"), F.lit(0)), F.lit(-1))
        at = F.length(x) - F.length(last)
        return F.when(last.isNotNull() & x.endswith(last) & (at > 0), F.left(x, at))

    return F.coalesce(before(R.PURE_TOKEN), before(R.UNIT_FRAGMENT))


def parts_of(x: Column) -> Column:
    """x split at separators, empty parts at the end left out."""
    return F.split(F.regexp_replace(x, f"{R.SEPARATORS}$", ""), R.SEPARATORS, -1)


def by_separator(x: Column) -> Column:
    """Sub-addresses of a list of units, else null: every part after the first is a unit, bare tokens take the first suffix found."""

    def listed(parts: Column, first: Column, prefix: Column) -> Column:
        rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
        suffixes = F.filter(F.transform(parts, lambda p: F.regexp_extract(F.right(p, F.lit(6)), f"^(?:{R.UNIT_FRAGMENT})$", 1)), lambda s: s != "")
        tokens = F.concat(F.array(F.substr(first, F.length(prefix) + 1)), rest)
        out = bind(F.coalesce(F.get(suffixes, 0), F.lit("")), lambda suffix: F.transform(tokens, lambda t: F.concat(prefix, t, F.when(t.rlike(f"^(?:{R.PURE_TOKEN})$"), suffix).otherwise(""))))
        return F.when((F.size(parts) >= 2) & (F.length(prefix) >= 2) & F.forall(rest, is_unit_fragment), out)

    split = lambda parts: bind(F.get(parts, 0), lambda first: bind(stripped_prefix(first), lambda prefix: listed(parts, first, prefix)))
    return F.when(x.rlike(R.SEPARATORS), bind(parts_of(x), split))


def _found(x: Column, pattern: str, use) -> Column:
    """use(what stands before the first match, and the match's two groups) where there is one with two characters before it."""
    groups = F.struct(F.regexp_extract(x, f"(?s)^(.*?)(?:{pattern})", 1).alias("prefix"), F.regexp_extract(x, pattern, 1).alias("first"), F.regexp_extract(x, pattern, 2).alias("second"))
    return F.when(x.rlike(pattern), bind(groups, lambda g: F.when(F.length(g["prefix"]) >= 2, use(g["prefix"], g["first"], g["second"]))))


def by_letters(x: Column) -> Column:
    """One sub-address for each of two to four letters before a suffix; what follows the suffix goes."""
    return _found(x, R.LETTER_GROUP, lambda prefix, letters, suffix: F.transform(F.split(letters, ""), lambda c: F.concat(prefix, c, suffix)))


def group_tokens(group: Column) -> Column:
    """Two numbers that rise by up to the span are a range, whatever stands between them; anything else is a list."""
    raw = F.split(group, R.GROUP_SEPARATORS, -1)
    low, high = F.try_element_at(raw, F.lit(1)).try_cast("int"), F.try_element_at(raw, F.lit(2)).try_cast("int")
    is_range = group.rlike(r"^\d{1,4}" + R.GROUP_SEPARATORS + r"\d{1,4}$") & (high > low) & (high - low <= R.RANGE_SPAN)
    return F.when(is_range, F.transform(F.sequence(low, F.when(is_range, high).otherwise(low)), lambda i: i.cast("string"))).otherwise(raw)


def by_numbers(x: Column) -> Column:
    return _found(x, R.NUMBER_GROUP, lambda prefix, group, suffix: F.transform(group_tokens(group), lambda t: F.concat(prefix, t, suffix)))


def expanded(address) -> Column:
    """An address's sub-addresses in order; an address that isn't split stands for itself, aliases included."""
    trimmed = control_trim(address)
    return bind(trimmed, lambda a: bind(dots_to_separators(without_alias(a)), lambda s: F.coalesce(by_separator(s), by_letters(s), by_numbers(s), F.array(a))))


def cjk_runs(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(R.CJK_RUN), F.lit(0))


def is_generic(x: Column) -> Column:
    return x.rlike("|".join(R.GENERIC_WORDS))


def effective_runs(x: Column) -> Column:
    return F.filter(cjk_runs(x), lambda r: ~((F.length(r) <= 4) & is_generic(r)))


def unit_tokens(x: Column) -> Column:
    return F.concat(F.regexp_extract_all(x, F.lit(R.UNIT_TOKEN), F.lit(0)), F.regexp_extract_all(x, F.lit(R.NUMERAL_UNIT), F.lit(0)))


def cjk_length(x: Column) -> Column:
    return F.length(F.regexp_replace(x, "[^\\u4e00-\\u9fa5]", ""))


def is_subsequence(a: Column, b: Column) -> Column:
    """Whether a's characters stand in b in that order."""
    n = F.length(a)
    met = F.aggregate(F.filter(F.split(b, ""), lambda c: c != ""), F.lit(0), lambda i, c: F.when((i < n) & (F.substring(a, i + 1, F.lit(1)) == c), i + 1).otherwise(i))
    return met == n


def has_any(hay: Column, tokens: Column) -> Column:
    return F.exists(tokens, lambda t: hay.contains(t))


def has_bounded(hay: Column, tokens: Column) -> Column:
    """Whether a token stands in hay without a letter or digit before it."""
    return F.exists(tokens, lambda t: F.rlike(hay, F.concat(F.lit(r"(?<![0-9A-Za-z])\Q"), t, F.lit(r"\E"))))


def district_of(x: Column) -> Column:
    """The district of the first area keyword in x, else the first district named, else null."""
    rows = [*R.AREA_DISTRICTS, *((d[:-1], d) for d in R.DISTRICTS)]
    listed = F.expr("array(" + ", ".join(f"struct('{k}' AS k, '{d}' AS d)" for k, d in rows) + ")")
    return F.get(F.filter(listed, lambda row: x.contains(row["k"])), 0)["d"]
