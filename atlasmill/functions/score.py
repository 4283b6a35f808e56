"""Scores of a candidate place for an address, 100 at most."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from atlasmill.functions import rules as R
from atlasmill.functions import text as T


#: What the rules need of an address; the same for all its candidates.
TERMS = ("bare", "units", "runs", "district", "home")
Terms = dict[str, Column]


def address_terms(address: Column) -> Terms:
    """The address without spaces, its units, its keywords, the district that it implies, and whether it is a home's."""
    made = (F.replace(address, F.lit(" "), F.lit("")), T.unit_tokens(address), T.effective_runs(address), T.district_of(address), address.rlike(R.RESIDENTIAL_INPUT))
    return dict(zip(TERMS, made))


def _terms(address: Column | Terms) -> Terms:
    return address if isinstance(address, dict) else address_terms(address)


def hit_share(hay: Column, runs: Column) -> Column:
    return F.size(F.filter(runs, lambda r: hay.contains(r))) / F.size(runs)


def _shared(hay: Column, runs: Column, most: float) -> Column:
    return T.bind(runs, lambda r: F.when(F.size(r) > 0, most * hit_share(hay, r)).otherwise(0.0))


def name_score(name: Column, address: Column | Terms) -> Column:
    """Up to 40: equal; contained; containing; in order within; else by the share of keywords, halved where no unit of the address is named."""
    return T.bind(F.replace(name, F.lit(" "), F.lit("")), lambda n: _name_score(name, n, _terms(address)))


def _name_score(name: Column, n: Column, t: Terms) -> Column:
    a, units = t["bare"], t["units"]
    halved = F.when((F.size(units) > 0) & ~T.has_any(n, units), 0.5).otherwise(1.0)
    plain = ~T.is_generic(n)
    return (
        F.when(name.isNull() | (name == "") | a.isNull(), 0.0).when(n == a, 40.0)
        .when(n.contains(a), F.when(plain, 30.0).otherwise(15.0))
        .when(plain & a.contains(n) & (T.cjk_length(n) >= 2), 30.0)
        .when(plain & (F.length(a) >= 5) & T.is_subsequence(a, n), 28.0)
        .otherwise(_shared(n, t["runs"], 40.0) * halved)
    )


def address_score(where: Column, address: Column | Terms) -> Column:
    """Up to 25 by the share of keywords; 10 more in the district that the address implies, 15 less in another."""
    t = _terms(address)
    base, own = _shared(where, t["runs"], 25.0), t["district"]
    other = F.exists(F.array(*map(F.lit, R.DISTRICTS)), lambda d: (d != own) & where.contains(d))
    moved = F.when(own.isNull(), base).when(where.contains(own), F.least(F.lit(25.0), base + 10)).when(other, F.greatest(F.lit(0.0), base - 15)).otherwise(base)
    return F.when(where.isNull() | (where == ""), 0.0).otherwise(moved)


def unit_score(name: Column, where: Column, address: Column | Terms) -> Column:
    hay = F.concat(T.or_empty(name), F.lit(" "), T.or_empty(where))
    tokens = _terms(address)["units"]
    return F.when(F.size(tokens) == 0, 10.0).when(T.has_bounded(hay, tokens), 20.0).when(hay.rlike(f"[{R.UNIT_CHARACTERS}]"), 0.0).otherwise(10.0)


def tag_all(std_tag: Column, show_tag: Column) -> Column:
    return F.concat(T.or_empty(std_tag), F.when(show_tag.isNull(), "").otherwise(F.concat(F.lit(";"), show_tag)))


def type_score(tag: Column, address: Column | Terms) -> Column:
    home = _terms(address)["home"]
    return F.when(tag.rlike(R.RESIDENTIAL_TAG), F.when(home, 10.0).otherwise(5.0)).otherwise(F.when(home, 0.0).otherwise(5.0))


def penalty(tag: Column, address: Column | Terms) -> Column:
    """Half for a commercial tag at a residential address, else one."""
    return F.when(_terms(address)["home"] & tag.rlike(R.COMMERCIAL_TAG), 0.5).otherwise(1.0)


def scores(name: Column, where: Column, std_tag: Column, show_tag: Column, has_polygons: Column, address: Column | Terms) -> dict[str, Column]:
    """name_s, addr_s, unit_s, type_s, poly_s of a candidate, for an address or its terms; total() and detail() make the rest of them."""
    tag, t = tag_all(std_tag, show_tag), _terms(address)
    factor = penalty(tag, t)
    return {
        "name_s": name_score(name, t) * factor, "addr_s": address_score(where, t) * factor,
        "unit_s": unit_score(name, where, t), "type_s": type_score(tag, t),
        "poly_s": F.when(has_polygons, 5.0).otherwise(0.0),
    }


PARTS = ("name_s", "addr_s", "unit_s", "type_s", "poly_s")


def total(parts=None) -> Column:
    """The sum of parts, which give a column for each name; of the columns of those names unless given."""
    of = F.col if parts is None else parts.__getitem__
    return sum((of(p) for p in PARTS[1:]), of(PARTS[0]))


def detail(parts=None) -> Column:
    """The scores as text, rounded half up."""
    of = F.col if parts is None else parts.__getitem__
    return F.format_string("名称%.0f/地址%.0f/楼栋%.0f/类型%.0f/多边形%.0f=%.0f", *map(of, PARTS), of("total") if parts is None else total(parts))
