"""Resolving addresses: expand, look up responses, score and choose candidates, merge footprints, and name the status.

Candidates are scored, ranked and guarded inside the row of their response, so that between the lookup and the
regrouping of an address's parts nothing is shuffled. Three shuffles remain: by address (first occurrence), by the
query's digest (lookup) and by the address's number (regrouping).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atlasmill.functions import geometry as G
from atlasmill.functions import responses as P
from atlasmill.functions import rules as R
from atlasmill.functions import score as S
from atlasmill.functions import text as T
from atlasmill.operators import before, city_allowed, dense_ids, place_type, region_name, spread, status, streaks, within_bounds


@dataclass(frozen=True)
class Settings:
    """bounds: lon, lat, lon, lat. strict drops candidates without a centre and takes the mean centre where no part has a polygon.

    accept: which candidates count at all, as a condition on a candidate's struct; None: all.
    """

    city: str = R.CITY
    bounds: tuple[float, float, float, float] = (113.75, 22.40, 114.65, 22.88)
    threshold: int = 40
    first_id: int = 10124
    official: bool = True
    strict: bool = False
    accept: Callable[[Column], Column] | None = None


def sub_queries(inputs: DataFrame) -> DataFrame:
    """(seq, address, sub_pos, n_sub, sub, query_md5) of inputs (seq, address), each address once, at its first place."""
    least = F.when(F.count_if(F.col("seq").isNull()) == 0, F.min("seq")).alias("seq")  # a row without a number comes first
    first = inputs.select("seq", T.control_trim(F.col("address")).alias("address")).where("address <> ''").groupBy("address").agg(least)
    parts = spread(first, "seq").withColumn("subs", T.expanded(F.col("address")))
    # outer, though no address is without a part: else Spark filters by the whole expansion, below the deal and once more
    each = parts.select("seq", "address", F.size("subs").alias("n_sub"), F.posexplode_outer("subs").alias("sub_pos", "sub"))
    return each.withColumn("query_md5", T.query_digest(F.col("sub")))


def score_struct(c: Column, address: Column | S.Terms) -> Column:
    """struct(total, detail and the five scores) of a candidate."""
    parts = S.scores(c["name"], c["addr"], c["std_tag"], c["show_tag"], F.size(c["polygons"]) > 0, address)
    summed = lambda p: F.struct(S.total(p).alias("total"), S.detail(p).alias("detail"), *[p[k].alias(k) for k in S.PARTS])
    return T.bind(F.struct(*[v.alias(k) for k, v in parts.items()]), summed)


def with_terms(df: DataFrame, address: str) -> DataFrame:
    """df with terms, what the scores need of an address, computed once for all its candidates."""
    return df.withColumn("terms", F.struct(*[c.alias(k) for k, c in S.address_terms(F.col(address)).items()]))


def terms_of(df: DataFrame) -> S.Terms:
    """The terms of with_terms(), for ranked()."""
    return {k: df["terms"][k] for k in S.TERMS}


def ranked(candidates: Column, address: Column | S.Terms, settings: Settings) -> Column:
    """Candidates of an address, or of its terms, with scores and admissible, best first: larger total, then one with polygons, then earlier in the response."""

    def one(c: Column) -> Column:
        located = c["center"].isNotNull()
        inside = T.bind(G.to_lonlat(c["center"]["x"], c["center"]["y"], settings.official), lambda p: within_bounds(located, p["x"], p["y"], settings.bounds))
        guard = city_allowed(c["city_name"], settings.city) & F.coalesce(inside, F.lit(True))
        if settings.strict:
            guard = guard & located
        order = lambda s: F.struct((-s["total"]).alias("a"), (F.size(c["polygons"]) == 0).alias("b"), c["idx"].alias("i"), guard.alias("admissible"), s.alias("score"), c.alias("candidate"))
        return T.bind(score_struct(c, address), order)

    accepted = candidates if settings.accept is None else F.filter(candidates, lambda c: F.coalesce(settings.accept(c), F.lit(False)))
    return F.array_sort(F.transform(accepted, one))


def latest_responses(responses: DataFrame) -> DataFrame:
    """(query_md5, raw), one row for each query: its last answer by stored_at, where there is such a column.

    A response that reports an error counts only where a query has no answer at all. Of rows that don't differ in
    stored_at, one that names places goes before one that names none, then the larger text. Each text is parsed once.
    """
    at = F.col("stored_at").cast("long") if "stored_at" in responses.columns else F.lit(0).cast("long")
    key = T.bind(P.head(F.col("raw")), lambda h: F.struct((~h["auth_error"]).alias("ok"), at.alias("at"), (F.size(h["content"]) > 0).alias("some"), F.col("raw").alias("raw")))
    # the key is made before rows are sorted for their groups, so that they hold a text once and nothing parsed
    return responses.select("query_md5", key.alias("key")).groupBy("query_md5").agg(F.max("key").alias("best")).select("query_md5", "best.raw")


def outcomes_by_query(responses: DataFrame) -> DataFrame:
    """(query_md5, outcome) of responses (query_md5, raw), or of a ResponseStore's lookup(), which has them already.

    Never broadcast, however small Spark takes it for: by the bytes of compressed files it misjudges what parsing makes of them.
    """
    if "outcome" in responses.columns:
        return responses.select("query_md5", "outcome").hint("merge")
    return latest_responses(responses).select("query_md5", F.when(F.col("raw").isNotNull(), P.envelope(F.col("raw"))).alias("outcome")).hint("merge")


def looked_up(subs: DataFrame, responses: DataFrame, how: str) -> DataFrame:
    """subs with the outcome of their query, in as many tasks as the session shuffles to.

    Parsing and scoring happen in the tasks of this join, and their work is not in proportion to its bytes: dealt out by
    number, its two sides are not packed together by adaptive execution.
    """
    dealt = subs.repartition(int(subs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "query_md5")
    return dealt.join(outcomes_by_query(responses), "query_md5", how)


def chosen(subs: DataFrame, responses: DataFrame, settings: Settings) -> DataFrame:
    """subs with answered, n_candidates, best (a candidate or null), total, detail and note of their response."""
    found = with_terms(looked_up(subs, responses, "left"), "sub")
    found = found.withColumn("ranked", ranked(F.col("outcome.candidates"), terms_of(found), settings))
    found = found.withColumn("skipped", F.get(F.filter(F.transform("ranked", lambda r, i: F.when(r["admissible"], i)), lambda i: i.isNotNull()), 0))
    found = found.withColumn("pick", F.get("ranked", F.col("skipped")))
    detail = F.concat("pick.score.detail", F.when(F.col("skipped") > 0, F.format_string("（已跳过%d个市外/越界候选）", "skipped")).otherwise(""))
    low = F.col("pick.score.total") < settings.threshold
    note = F.when(low, F.format_string(f"「%s」最高分 %.0f 低于阈值 {settings.threshold}", "sub", "pick.score.total"))
    return found.select(
        "seq", "address", "sub_pos", "n_sub", "sub", F.col("outcome").isNotNull().alias("answered"), F.when(F.col("outcome").isNotNull(), F.size("outcome.candidates")).otherwise(0).alias("n_candidates"),
        F.col("pick.candidate").alias("best"), F.col("pick.score.total").alias("total"), detail.alias("detail"), F.coalesce(low, F.lit(False)).alias("low"), note.alias("note"), "skipped",
    )


def candidate_lines(subs: DataFrame, responses: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(seq, sub_pos, rank, idx, name, total, detail): every scored candidate, best first, for review."""
    found = with_terms(looked_up(subs, responses, "inner"), "sub")
    # outer, or Spark would rank once more to filter by what is ranked
    each = found.select("seq", "sub_pos", F.posexplode_outer(ranked(F.col("outcome.candidates"), terms_of(found), settings)).alias("rank", "r"))
    return each.where("rank is not null").select("seq", "sub_pos", "rank", "r.candidate.idx", "r.candidate.name", "r.score.total", "r.score.detail")


def empty_streaks(outcomes: DataFrame, threshold: int, carried: int = 0) -> DataFrame:
    """outcomes of chosen() with streak: queries in a row, by address and part, that were answered without any candidate.

    A query without a response doesn't count and is left out; a streak that reaches the threshold starts again, and the
    first goes on from carried. Parts are numbered over the addresses' part counts, however many an address has.
    """
    starts = before(outcomes.groupBy("seq").agg(F.max("n_sub").alias("_parts")), F.col("_parts"), "seq", "_start").select("seq", "_start")
    asked = outcomes.where("answered").join(starts, "seq").withColumn("_order", F.col("_start") + F.col("sub_pos"))
    return streaks(asked, F.col("n_candidates") == 0, "_order", threshold, carried).drop("_order", "_start")


def regrouped(outcomes: DataFrame, settings: Settings) -> DataFrame:
    """One result for each address from its parts' outcomes, in their order; see resolve()."""
    part = F.struct("sub_pos", "sub", "best", "detail", "low", "note")
    rows = outcomes.groupBy("seq", "address", "n_sub").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    rows = rows.withColumn("hits", F.filter("parts", lambda p: p["best"].isNotNull())).withColumn("multi", F.col("n_sub") > 1)
    first = F.get("hits", 0)["best"]
    center = lambda p: F.coalesce(p["best"]["center"], G.point(F.lit(0.0), F.lit(0.0)))
    rows = rows.withColumn("centers", F.transform("hits", center))
    footprint = lambda p: T.bind(center(p), lambda c: G.chosen_footprint(p["best"]["polygons"], c["x"], c["y"]))
    rows = rows.withColumn("rings", F.filter(F.transform("hits", footprint), lambda r: r.isNotNull()))
    merging = F.col("multi") & (F.size("rings") > 0)
    rows = rows.withColumn("hull", F.when(merging, G.convex_hull(F.flatten("rings"))))
    lone = F.when(F.col("multi"), G.mean_point(F.col("centers"))).otherwise(F.get("centers", 0)) if settings.strict else F.get("centers", 0)
    rows = rows.withColumn("center_mc", F.when(merging, F.coalesce(F.when(F.col("hull").isNotNull(), G.centroid(F.col("hull"))), G.mean_point(F.col("centers")))).otherwise(lone))
    n_hits = F.size("hits")
    notes = F.concat(
        F.filter(F.transform("hits", lambda p: p["note"]), lambda n: n.isNotNull()),
        F.when((n_hits > 0) & (n_hits < F.col("n_sub")), F.array(F.format_string("部分子地址失败（%d/%d）", n_hits, "n_sub"))).otherwise(F.array().cast("array<string>")),
        F.when(merging & F.col("hull").isNull(), F.array(F.lit(R.EMPTY_MERGE))).otherwise(F.array().cast("array<string>")),
    )
    rows = rows.withColumn("notes", notes)
    located = F.col("center_mc").isNotNull()
    rows = rows.withColumn("ll", G.to_lonlat(F.col("center_mc.x"), F.col("center_mc.y"), settings.official))
    ring = G.ring_to_lonlat(F.coalesce("hull", F.get("rings", 0)), settings.official)
    detail = F.transform("hits", lambda p: F.concat(F.lit("["), T.or_empty(p["best"]["name"]), F.lit("] "), p["detail"]))
    return rows.select(
        "seq", F.col("address").alias("input_address"), F.when(located, region_name(F.col("multi"), first["name"], F.col("address"))).otherwise(F.when(F.col("multi"), F.col("address"))).alias("region_name"),
        F.when(located, F.col("ll.x")).alias("center_lon"), F.when(located, F.col("ll.y")).alias("center_lat"),
        F.when(located, F.coalesce(ring, F.array().cast(G.RING))).otherwise(F.array().cast(G.RING)).alias("polygon"),
        F.when(n_hits > 0, place_type(first["std_tag"], first["show_tag"])).otherwise(R.UNKNOWN_TYPE).alias("place_type"),
        status(located, F.exists("hits", lambda p: p["low"]), F.col("notes")).alias("status"), first["name"].alias("selected_name"),
        F.array_join(detail, " || ").alias("score_detail"), F.transform("parts", lambda p: p["sub"]).alias("sub_queries"),
        F.when(~located, R.NO_RESULT).otherwise(F.nullif(F.array_join("notes", "; "), F.lit(""))).alias("message"),
    )


def resolve(inputs: DataFrame, responses: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Results (region_id, seq, input_address, region_name, center_lon, center_lat, polygon, place_type, status,
    selected_name, score_detail, sub_queries, message) of inputs (seq, address) from stored responses (query_md5, raw).

    A part without a response or an admissible candidate is left out; if others of its address are found, the result
    is of low confidence. A candidate without a centre passes the bounds and stands at (0, 0), unless strict. Ids rise
    by one with each result that has a centre, in input order.

    The results are persisted before they are numbered, since their count by bucket and their rows are both needed, and
    sinks read them again; a lost executor's part is computed anew. release() lets them go.
    """
    return numbered(chosen(sub_queries(inputs), responses, settings), settings)


def numbered(outcomes: DataFrame, settings: Settings) -> DataFrame:
    """resolve() of outcomes that chosen() has found."""
    results = regrouped(outcomes, settings).persist(StorageLevel.MEMORY_AND_DISK)
    ok = F.col("center_lon").isNotNull() & F.col("center_lat").isNotNull()
    found = dense_ids(results, ok, "seq", settings.first_id)
    found.held = results
    return found


def release(resolved: DataFrame) -> None:
    """Lets go what resolve() has persisted for its result; the result can still be read, and is then computed anew."""
    resolved.held.unpersist()
