"""Search responses: one JSON document to its envelope and candidate places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from atlasmill.functions import geometry as G
from atlasmill.functions.text import bind

GEO_PAIR = r"(-?\d+\.?\d*),(-?\d+\.?\d*)"
CANDIDATE = f"struct<idx:int,name:string,addr:string,std_tag:string,show_tag:string,city_name:string,center:{G.POINT},polygons:array<{G.RING}>>"


def field(doc: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(doc, path, kind)


def text_field(doc: Column, path: str) -> Column:
    """A scalar as text; a container counts as an empty text, a missing or null field as null."""
    return bind(field(doc, path, "variant"), lambda v: F.when(F.left(F.schema_of_variant(v), F.lit(5)).isin("OBJEC", "ARRAY"), F.lit("")).otherwise(field(v, "$", "string")))


def center(doc: Column) -> Column:
    """Nested point; else hundredths, if both are whole numbers and x isn't 0; else the first pair in the text field."""
    number = lambda v: F.when(F.schema_of_variant(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), v.cast("double"))
    nested = G.point(*(field(doc, f"$.ext.detail_info.navi_xy.diPoint.{k}", "double") for k in "xy"))
    whole = G.point(*(bind(field(doc, f"$.diPoint{k}", "variant"), number) for k in "XY"))
    pair = bind(field(doc, "$.geo", "variant"), lambda v: F.when(F.schema_of_variant(v) == "STRING", v.cast("string")))
    found = lambda s: G.point(*(F.regexp_extract(s, GEO_PAIR, i).try_cast("double") for i in (1, 2)))
    known = lambda p: p["x"].isNotNull() & p["y"].isNotNull()
    return F.coalesce(
        bind(nested, lambda p: F.when(known(p) & ~F.isnan(p["x"]) & ~F.isnan(p["y"]), p)),
        bind(whole, lambda p: F.when(known(p) & (F.abs(p["x"]) >= 1), G.point(p["x"] / 100, p["y"] / 100))),
        bind(bind(pair, found), lambda p: F.when(known(p), p)),
    )


def is_object(doc: Column) -> Column:
    return field(doc, "$", "struct<>").isNotNull()  # a schema would be made of all that is in it


def fields(doc: Column, idx: Column) -> Column:
    """A candidate of one object of the response; reads no more of it than the paths named."""
    info = bind(text_field(doc, "$.tag_info"), lambda inner: F.when(inner.startswith("{"), F.try_parse_json(inner)))
    return bind(info, lambda parsed: _fields(doc, parsed, idx))


def _fields(doc: Column, info: Column, idx: Column) -> Column:
    show = F.coalesce(text_field(info, "$.classification.show_tag"), text_field(doc, "$.show_tag[0]"))
    return F.struct(
        idx.cast("int").alias("idx"), text_field(doc, "$.name").alias("name"),
        F.coalesce(text_field(doc, "$.addr"), text_field(doc, "$.poi_address")).alias("addr"),
        F.coalesce(text_field(doc, "$.std_tag"), text_field(info, "$.classification.std_tag")).alias("std_tag"), show.alias("show_tag"),
        text_field(doc, "$.city_name").alias("city_name"), center(doc).alias("center"),
        G.parsed_polygons(text_field(doc, "$.ext.detail_info.guoke_geo_bud.bud_geom")).alias("polygons"),
    )


def candidate(doc: Column, idx: Column) -> Column:
    """A candidate of one element of the response; null for what isn't an object."""
    return F.when(is_object(doc), fields(doc, idx))


def _head(raw: Column, doc: Column) -> tuple[Column, Column, Column]:
    """Whether a response failed, its error code, and its elements."""
    code = F.coalesce(field(doc, "$.result.error", "int"), F.lit(0))
    challenged = F.coalesce(field(doc, "$.result.anti_session.need_recaptcha", "boolean"), F.lit(False))
    blank = raw.isNotNull() & (F.length(raw) > 0) & raw.rlike(r"^\s*$")
    return (doc.isNull() & ~blank) | (code != 0) | challenged, code, F.coalesce(field(doc, "$.content", "array<variant>"), F.array().cast("array<variant>"))


def head(raw: Column) -> Column:
    """struct(auth_error, error_code, content) of a response's text, as envelope() has it, with its elements as they are."""
    def read(doc: Column) -> Column:
        failed, code, content = _head(raw, doc)
        return F.struct(failed.alias("auth_error"), code.alias("error_code"), content.alias("content"))

    return bind(F.try_parse_json(raw), read)


def envelope(raw: Column) -> Column:
    """struct(auth_error, error_code, candidates) of a response's text.

    Malformed and empty texts and such as report an error or a challenge are errors, without candidates; a text of
    blanks alone has no candidates and is no error. Elements that aren't objects are left out but keep their number.
    """
    def read(doc: Column) -> Column:
        failed, code, content = _head(raw, doc)
        found = F.filter(F.transform(content, candidate), lambda c: c.isNotNull())
        return F.struct(failed.alias("auth_error"), code.alias("error_code"), F.when(failed, F.array().cast(f"array<{CANDIDATE}>")).otherwise(found).alias("candidates"))

    return bind(F.try_parse_json(raw), read)
