"""python -m atlasmill resolve|buffer|enrich|merge|store: the flows over files. Without --write, buffer, enrich and merge only show what they would write."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from atlasmill import sources as Z
from atlasmill.functions import text as T
from atlasmill.operators import summary
from atlasmill.plans import enrich as E
from atlasmill.plans import sinks as K
from atlasmill.plans.resolve import Settings, candidate_lines, release, resolve, sub_queries
from atlasmill.sources.store import ResponseStore

DEFAULTS = {
    "input.path": "addresses.txt", "input.header": "地址", "output.path": "output", "failed.path": "failed", "review.path": "review", "html.path": "map.html", "html.ak": "",
    "cache.dir": "cache", "cache.store": "", "candidates.path": "", "region.id.start": 10124, "match.score.threshold": 40, "coord.algorithm": "official", "bounds": "113.75,22.40,114.65,22.88", "city": "深圳市", "strict": False,
}


def settings(found: dict) -> Settings:
    """Bounds that aren't four numbers keep the default, as a bad number does."""
    try:
        box = tuple(float(x) for x in str(found["bounds"]).split(","))
    except ValueError:
        box = ()
    return Settings(
        city=str(found["city"]), bounds=box if len(box) == 4 else Settings.bounds, threshold=int(found["match.score.threshold"]),
        first_id=int(found["region.id.start"]), official=str(found["coord.algorithm"]).lower() == "official", strict=bool(found["strict"]),
    )


def run_resolve(spark: SparkSession, config: str | None) -> None:
    found = Z.properties(config, DEFAULTS)
    inputs = Z.addresses(spark, str(found["input.path"]), header=str(found["input.header"]))
    known = ResponseStore(spark, str(found["cache.store"])).lookup() if found["cache.store"] else Z.response_cache(spark, str(found["cache.dir"]))
    results = resolve(inputs, known, settings(found))
    K.write_lines(K.result_lines(results), str(found["output.path"]))
    K.write_lines(K.failed_lines(results), str(found["failed.path"]))
    K.write_lines(K.review_lines(results), str(found["review.path"]))
    Path(str(found["html.path"])).write_text(K.map_page(results, "map", str(found["html.ak"])), encoding="utf-8")
    if found["candidates.path"]:
        listed = candidate_lines(sub_queries(inputs), known, settings(found))
        at = F.struct("seq", "sub_pos", "rank").alias("at")
        K.write_lines(K.lines(listed.withColumn("at", at), [F.col(c).cast("string") for c in ("seq", "sub_pos", "rank", "name", "total", "detail")], "at"), str(found["candidates.path"]))
    summary(results).show()
    release(results)


def run_store(spark: SparkSession, cache: str, store: str, compact: bool) -> None:
    """Adds a folder of responses to a store."""
    kept = ResponseStore(spark, store)
    kept.append(Z.response_cache(spark, cache))
    if compact:
        kept.compact()
        kept.prune()


def run_merge(spark: SparkSession, a: argparse.Namespace) -> None:
    """Codes and labels of result rows by their address, with further answers behind them; the failure and review lists follow."""
    rows = Z.tab_rows(spark, a.results, E.COLUMNS)
    listed = Z.tab_rows(spark, a.answers, ["address", "query", "code", "label"], exact=True).withColumn("query_md5", T.query_digest(F.col("query")))
    known = ResponseStore(spark, a.cache).texts() if a.store else Z.response_cache(spark, a.cache)
    given = listed.join(known, "query_md5", "left").drop("query_md5")
    accept = (lambda c: c["std_tag"].startswith(a.accept)) if a.accept else None
    rules = Settings(accept=accept)
    extra = E.additions(given, rules)
    preferred = F.col("district") == a.district if a.district else None
    old = rows.join(extra.select("code").distinct(), "code", "left_anti")
    new = E.merged(E.recoded(old, Z.labels(spark, a.labels), preferred), extra)
    failed, review = Z.tab_rows(spark, a.failed, ["address", "message"]), Z.tab_rows(spark, a.review, ["address", "name", "detail", "message"])
    lists = {
        a.results: K.lines(new, [F.col(c) for c in E.COLUMNS]),
        a.review: K.lines(E.reviewed(review, failed, E.answered(given, rules)), [F.col(c) for c in ("address", "name", "detail", "message")]),
        a.failed: K.lines(E.still_failed(failed, extra), [F.col(c) for c in ("address", "message")]),
    }
    for path, lines in lists.items():  # the failures last: they tell whether the review list is still to be added to
        if a.write:
            K.rewrite_lines(lines, path)
        else:
            print(f"{path}: {lines.count()} lines")


def run_buffer(spark: SparkSession, source: str, metres: float, target: str | None, write: bool, simple: bool = False) -> None:
    """Six columns and the expanded range; target None rewrites the source."""
    lines = K.buffered_lines(Z.tab_rows(spark, source, E.COLUMNS), metres, simple)
    if not write:
        lines.show(20, truncate=120)
    elif target is None:
        K.rewrite_lines(lines, source)
    else:
        K.write_lines(lines, target)


def run_enrich(spark: SparkSession, results: str, inputs: str, labels: str, target: str, write: bool) -> None:
    rows = Z.tab_rows(spark, results, ["code", "name", "center", "ring", "place_type"], exact=True)
    listed, known = Z.addresses(spark, inputs, header="地址"), Z.labels(spark, labels)
    out = E.enriched(rows, listed, known)
    E.N.unlabelled(out, known).select("address").show(20, truncate=False)
    K.write_lines(K.lines(out, [F.col(c) for c in E.COLUMNS]), target, dry_run=not write)


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="atlasmill", description=__doc__)
    kinds = parser.add_subparsers(dest="kind", required=True)
    one = kinds.add_parser("resolve")
    one.add_argument("--config")
    two = kinds.add_parser("buffer")
    two.add_argument("source", nargs="?", default="output")
    two.add_argument("metres", nargs="?", type=float, default=1000.0)
    two.add_argument("target", nargs="?")
    three = kinds.add_parser("enrich")
    for name in ("results", "inputs", "labels", "target"):
        three.add_argument(name)
    four = kinds.add_parser("store")
    for name in ("cache", "store"):
        four.add_argument(name)
    four.add_argument("--compact", action="store_true")
    five = kinds.add_parser("merge")
    for name in ("results", "labels", "answers", "cache", "failed", "review"):
        five.add_argument(name)
    five.add_argument("--store", action="store_true", help="cache is a store")
    five.add_argument("--accept", help="what the tag of a candidate must begin with")
    five.add_argument("--district", help="whose label row counts, of several")
    two.add_argument("--simple", action="store_true", help="ranges that don't cross themselves")
    for p in (two, three, five):
        p.add_argument("--write", action="store_true")
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName("atlasmill").config("spark.python.sql.dataFrameDebugging.enabled", "false").config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "16k").getOrCreate()
    if a.kind == "resolve":
        run_resolve(spark, a.config)
    elif a.kind == "buffer":
        run_buffer(spark, a.source, a.metres, a.target, a.write, a.simple)
    elif a.kind == "store":
        run_store(spark, a.cache, a.store, a.compact)
    elif a.kind == "merge":
        run_merge(spark, a)
    else:
        run_enrich(spark, a.results, a.inputs, a.labels, a.target, a.write)


if __name__ == "__main__":
    main()
