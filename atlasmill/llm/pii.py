"""Personal data: identifiers of fixed forms, and unseen ones by bootstrapped contextual extraction, in functions alone.

Seeds are identifiers of fixed forms (RULES): e-mail addresses, IP addresses, card and phone numbers. A *mention* is any run
of token characters that holds a digit or an @; spaces between groups of digits belong to it. One that a seed's span
touches is an instance of the seed's kind. Words before a mention induce lexical patterns, of the last word and of the
last two.

A pattern's confidence in a kind is the share of all places where its words stand, mentions or not, that the kind's
instances follow, each counted by its own confidence, with SMOOTHING places against it. An instance that no seed touches
has the confidence that at least one of its patterns is right. Both are computed in turn, by joins along the edges of the
graph of patterns and instances. A pattern is believed if its confidence is at least ``confidence`` and at least
``support`` different instances follow it in as many documents; an instance if one of its patterns is, it looks like an
identifier (five digits or more, or an @), and its own confidence is at least ``confidence``. Mentions of believed instances
behind believed patterns are new spans.

Places are code points. The running sums of lengths take a logarithmic number of steps over an array, so a text may hold
very many identifiers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atlasmill.llm.shared import discard, stored

#: Fixed forms of the kinds, in the order of results. Possessive, so that a run without a match costs one look at each of
#: its characters: what follows a run can't be part of it, and a match begins where a run does or where the last match ended.
RULES = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){15,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
KINDS = tuple(RULES)
#: A mention: token characters of which one is a digit or an @, less punctuation behind it; groups of digits are joined.
MENTION = r"(?<![A-Za-z0-9._%+@()-])(?=[A-Za-z._%+()-]*+[0-9@])[A-Za-z0-9._%+@()-]*[A-Za-z0-9@)](?:(?<=[0-9)]) [(0-9][0-9().-]*[0-9)])*+"
#: Stands for a mention among words; no word holds a digit, since a mention takes it.
PLACE = "0"
#: Rounds of confidence, and places counted against every pattern.
ROUNDS, SMOOTHING = 3, 1.0
#: Patterns, as hashes of 8 bytes, that are broadcast at most.
BROADCAST = 200_000
SPAN = "struct<kind:int,start:bigint,end:bigint>"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), 0)


def running(lengths: Column) -> Column:
    """The sums of an array of numbers up to each place, by doubling steps."""
    def step(a: Column, d: int) -> Column:
        return F.when(F.size(a) > d, F.transform(a, lambda v, i: v + F.coalesce(F.get(a, i - d), F.lit(0).cast("bigint")))).otherwise(a)

    out = lengths
    for k in range(31):
        out = bind(out, partial(step, d=1 << k))
    return out


def found(text: Column, pattern: str) -> Column:
    """array<struct<s, start, end>> of the matches of a pattern, leftmost first, in code points."""
    matches, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    length = lambda a: F.transform(a, lambda x: F.char_length(x).cast("bigint"))

    def placed(p: Column) -> Column:
        # the k-th match ends after all parts up to the k-th and all matches up to it
        ends = running(F.zip_with(length(F.slice(p["b"], 1, F.size(p["m"]))), length(p["m"]), lambda x, y: x + y))
        return F.zip_with(p["m"], ends, lambda s, end: F.struct(s.alias("s"), (end - F.char_length(s)).alias("start"), end.alias("end")))

    return bind(F.struct(matches.alias("m"), between.alias("b")), placed)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a text of digits passes the check by Luhn's sum."""
    def value(i: Column) -> Column:
        d = F.substring(digits, F.char_length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)

    places = F.sequence(F.lit(0), F.char_length(digits) - 1)
    return F.aggregate(places, F.lit(0), lambda total, i: total + value(i)) % 10 == 0


def _holds(kind: str, s: Column) -> Column:
    """What a match of a kind's pattern must fulfil besides."""
    n = F.char_length(_digits(s))
    if kind == "ip":
        part = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(s, r"\."), lambda p: (F.char_length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(n.between(16, 19), _luhn(_digits(s))).otherwise(False)
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column) -> Column:
    """array<SPAN> of the identifiers of fixed forms, by kind and then by start."""
    none = F.array().cast(f"array<{SPAN}>")

    def of(k: int, kind: str) -> Column:
        may = text.contains("@") if kind == "email" else text.contains("+") if kind == "phone" else text.rlike("[0-9]")
        kept = F.filter(found(text, RULES[kind]), lambda m: _holds(kind, m["s"]))
        return F.when(may, F.transform(kept, lambda m: F.struct(F.lit(k).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))).otherwise(none)

    return F.concat(*[of(k, kind) for k, kind in enumerate(KINDS)])


def tokens(text: Column) -> Column:
    """Lower-case words of a text in order, with PLACE for each mention; the first is <s>, the text's start."""
    return F.split(F.concat(F.lit("<s> "), F.rtrim(F.lower(F.regexp_replace(text, MENTION, f" {PLACE} ")))), r"\s+", -1)


def read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, spans, mentions) of each of docs: base spans, and (start, end, s, kinds, one, two) of each mention.

    th holds two hashes of the text; kinds are those of base spans that touch the mention, one and two the last words
    before it.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    rows = rows.select("id", "text", F.struct(F.xxhash64("text").alias("x"), F.xxhash64(F.lit(1), "text").alias("y")).alias("th"), base_spans(F.col("text")).alias("spans"))
    some = F.col("text").rlike("[0-9@]")
    words = F.when(some, tokens(F.col("text")))
    places = lambda t: F.filter(F.transform(t, lambda w, i: F.when(w == PLACE, i)), lambda i: i.isNotNull())

    def one(m: Column, i: Column, t: Column) -> Column:
        touching = F.filter("spans", lambda b: (b["start"] < m["end"]) & (b["end"] > m["start"]))
        last, before = F.get(t, i - 1), F.coalesce(F.get(t, i - 2), F.lit(""))
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lower(m["s"]).alias("s"), F.array_distinct(F.transform(touching, lambda b: b["kind"])).alias("kinds"), last.alias("one"), F.concat_ws(" ", before, last).alias("two"))

    mentions = bind(words, lambda t: bind(F.arrays_zip(found(F.col("text"), MENTION).alias("m"), places(t).alias("i")), lambda z: F.transform(z, lambda p: one(p["m"], p["i"], t))))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,s:string,kinds:array<int>,one:string,two:string>>")
    return rows.select("id", "th", "spans", F.when(some, mentions).otherwise(empty).alias("mentions"))


def occurrences(docs: DataFrame, text_col: str, patterns: DataFrame) -> DataFrame:
    """(pattern, places): how often the words of each pattern stand in docs, whatever follows them.

    Words are compared by a hash of 64 bits. Up to BROADCAST patterns go to all tasks, as hashes, so that nothing but
    their counts is shuffled; more are met by counts of all words.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    listed = docs.select(tokens(text).alias("t"))
    at = listed.select("t", F.explode(F.sequence(F.lit(0), F.size("t") - 1)).alias("i"))
    before = F.coalesce(F.get("t", F.col("i") - 1), F.lit(""))
    keys = at.select(F.explode(F.array(F.xxhash64(F.get("t", F.col("i"))), F.xxhash64(before, F.get("t", F.col("i"))))).alias("key"))
    wanted = patterns.select("pattern", _key(F.col("pattern")).alias("key"))
    if wanted.count() <= BROADCAST:
        keys = keys.join(F.broadcast(wanted.select("key").distinct()), "key")
    return wanted.join(keys.groupBy("key").agg(F.count(F.lit(1)).alias("places")), "key").select("pattern", "places")


def _key(pattern: Column) -> Column:
    """The hash by which occurrences() finds a pattern of one or two words."""
    parts = F.split(pattern, " ", -1)
    return F.when(F.size(parts) == 1, F.xxhash64(F.get(parts, 0))).otherwise(F.xxhash64(F.get(parts, 0), F.get(parts, 1)))


@dataclass
class Findings:
    """read: of all documents; patterns (pattern, kind, confidence, support, places); instances (s, kind, confidence)."""

    read: DataFrame
    patterns: DataFrame
    instances: DataFrame

    def new_spans(self) -> DataFrame:
        """(th, added): spans of believed instances behind believed patterns, for each text that has any."""
        each = self.read.select("th", F.explode("mentions").alias("m")).where(F.size("m.kinds") == 0)
        behind = each.select("th", "m.start", "m.end", "m.s", F.explode(F.array("m.one", "m.two")).alias("pattern"))
        right = behind.join(self.patterns.select("pattern", "kind"), "pattern").join(self.instances.select("s", "kind"), ["s", "kind"])  # few of many
        return right.groupBy("th").agg(F.collect_set(F.struct(F.col("kind"), F.col("start"), F.col("end"))).alias("added"))


def bootstrap(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", confidence: float = 0.8, support: int = 3) -> Findings:
    """Patterns and instances of the confidence asked for; see the module."""
    seen = stored(read(docs, id_col, text_col), "pii-read")
    each = seen.select("th", F.explode("mentions").alias("m")).select("th", "m.s", "m.kinds", F.explode(F.array("m.one", "m.two")).alias("pattern"))
    # an edge for each pattern and mention, with the kinds of its seeds; n counts places, text is one that has them
    edges = each.groupBy("pattern", "s", "kinds").agg(F.count(F.lit(1)).alias("n"), F.min("th").alias("text"))
    seeded = edges.where(F.size("kinds") > 0).select("pattern", "s", "text", F.explode("kinds").alias("kind"))
    enough = seeded.groupBy("pattern", "kind").agg(F.countDistinct("s").alias("support"), F.countDistinct("text").alias("texts")).where((F.col("support") >= support) & (F.col("texts") >= support))
    candidates = stored(enough.select("pattern", "kind", "support"), "pii-candidates")
    places = occurrences(docs, text_col, candidates.select("pattern").distinct())
    known = stored(candidates.join(places, "pattern"), "pii-patterns")
    graph = edges.join(known.select("pattern", F.col("kind").alias("of"), "places"), "pattern")
    graph = stored(graph.select("pattern", F.col("of").alias("kind"), "s", "n", "places", F.array_contains("kinds", F.col("of")).alias("seed"), (F.size("kinds") > 0).alias("base")), "pii-graph")
    # what looks like no identifier, or is one of fixed form, is never an instance that was found
    email = F.col("kind") == KINDS.index("email")
    able = ~F.col("base") & F.when(email, F.col("s").contains("@")).otherwise(~F.col("s").contains("@") & (F.char_length(_digits(F.col("s"))) >= 5))
    trusted = believed = None
    for _ in range(ROUNDS):
        last = [t for t in (trusted, believed) if t is not None]
        held = graph.withColumn("confidence", F.lit(None).cast("double")) if believed is None else graph.join(believed, ["s", "kind"], "left")
        sure = F.coalesce(F.when(F.col("seed"), 1.0), "confidence", F.lit(0.0))
        scored = held.groupBy("pattern", "kind").agg((F.sum(F.col("n") * sure) / (F.max("places") + SMOOTHING)).alias("confidence"))
        trusted = stored(scored.where(F.col("confidence") >= confidence), "pii-trusted")
        wrong = F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))
        reached = graph.where(able).select("pattern", "kind", "s").distinct().join(trusted, ["pattern", "kind"])
        believed = stored(reached.groupBy("s", "kind").agg((1 - wrong).alias("confidence")).where(F.col("confidence") >= confidence), "pii-believed")
        discard(*last)
    discard(graph, candidates)
    return Findings(seen, trusted.join(known, ["pattern", "kind"]), believed)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", confidence: float = 0.8, support: int = 3) -> DataFrame:
    """(id_col, base, spans) of each of docs: arrays of (kind, start, end), by kind (its place in KINDS) and start.

    base are the identifiers of fixed forms, spans those and what the patterns found. Spans are functions of the text, so
    repeated rows, null and repeated ids have their own equal rows. A null text is empty and has no spans, and an empty
    table gives an empty result. A mention that a base span touches isn't found again. Other columns are not read, so
    names may clash. A text is held whole, with its words, while it is read: some 40 times its bytes.
    """
    findings = bootstrap(docs, id_col, text_col, confidence, support)
    rows = findings.read.select("id", "th", "spans").join(stored(findings.new_spans(), "pii-added"), "th", "left")
    every = F.array_sort(F.concat("spans", F.coalesce("added", F.array().cast(f"array<{SPAN}>"))))
    return rows.select(F.col("id").alias(id_col), F.col("spans").alias("base"), every.alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    name = lambda k: F.get(F.array(*map(F.lit, KINDS)), k)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """text with each span replaced by its kind in angle brackets; of spans that overlap the first in order of place."""
    by_place = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    apart = F.filter(by_place, lambda s: ~F.exists(by_place, lambda o: (o < s) & (o["end"] > s["start"])))
    name = lambda k: F.concat(F.lit("<"), F.get(F.array(*map(F.lit, KINDS)), k), F.lit(">"))

    def replaced(s: Column) -> Column:
        between = F.transform(s, lambda x, i: F.concat(F.substring(text, F.coalesce(F.get(s, i - 1)["end"], F.lit(0)).cast("int") + 1, (x["start"] - F.coalesce(F.get(s, i - 1)["end"], F.lit(0))).cast("int")), name(x["kind"])))
        tail = F.substring(text, F.coalesce(F.get(s, F.size(s) - 1)["end"], F.lit(0)).cast("int") + 1, F.char_length(text))
        return F.concat(F.array_join(between, ""), tail)

    return bind(apart, replaced)
