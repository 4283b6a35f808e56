"""The subpackage's registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atlasmill.llm import ann, divergence, importance, lines, media, mixing, packing, pii, sharding, simhash, toxicity, urls, warc
from atlasmill.llm.shared import stored

TOKENIZER = "word_bpe_49k.json"
RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
MIX = {"source": ([f"src{i}" for i in range(20)], 0.7), "lang": (["en", "de", "fr", "es"], 0.8), "topic": (list(mixing.TOPICS), 0.9)}
MIX_KEEP, MIX_SWEEPS = 0.8, 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=4, radius=4)
    return found.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op4_mix_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), MIX, MIX_KEEP, MIX_SWEEPS)
    return mixed.select("doc_id", "source", "lang", "mix_tokens", F.round("mix_probability", 6).alias("mix_probability"), "mix_kept")


def op5_shard_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard(table(spark, sf_dir, "documents"), shards=40)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return urls.judge(table(spark, sf_dir, "pages"), outcomes, RULES).select("page_id", "host", "path", "rule", "verdict", *[F.round(c, 6).alias(c) for c in ("posterior_mean", "posterior_bound")])


def op7_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = stored(packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048), "pieces")
    return packing.pack(parts, capacity=2048)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = toxicity.held_out("doc_id")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held))
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0, k=20)


def op10_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"), confidence=0.8, support=3)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5, min_words=20, seed=42)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), min_docs=30, top_terms=50)


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup, op2_line_dedup, op3_media_columns, op4_mix_to_targets, op5_shard_by_bytes,
        op6_url_reputation, op7_vector_best_fit, op8_toxicity, op9_inverted_multi_index, op10_warc_segments,
        op11_personal_data, op12_importance_resampling, op13_source_divergence,
    )
}



def _mix_sql() -> str:
    """Goals and raking as windows over cells, a recursion with a step for each dimension, and the same draw by the id's md5."""
    def share(chars: str) -> str:
        rest = "coalesce(text, '')"
        for c in chars:
            rest = f"replace({rest}, '{c}', '')"
        return f"(n - length({rest}))"

    listed = lambda c, values: f"CASE WHEN {c} IN ({', '.join(repr(v) for v in values)}) THEN {c} ELSE '*' END"
    topic = f"CASE WHEN {share('{}();=')} * 25 > n THEN 'code' WHEN {share('|')} * 40 > n THEN 'table' WHEN {share('!')} * 40 > n THEN 'shout' WHEN {share('#$%&*')} * 25 > n THEN 'noise' WHEN n < 500 THEN 'note' ELSE 'prose' END"
    tables = [
        "d AS MATERIALIZED (SELECT doc_id, source, lang, " + f"{listed('source', MIX['source'][0])} AS k0, {listed('lang', MIX['lang'][0])} AS k1, {topic} AS k2, "
        "CASE WHEN n = 0 THEN 0 ELSE n - length(replace(text, ' ', '')) + 1 END::BIGINT AS mix_tokens FROM (SELECT *, length(coalesce(text, '')) AS n FROM documents))",
        f"c0 AS MATERIALIZED (SELECT k0, k1, k2, sum(mix_tokens)::DOUBLE AS n, {MIX_KEEP}::DOUBLE AS p FROM d GROUP BY ALL)",
    ]
    factor = lambda total, of: f"max(CASE WHEN rest > 0 THEN ({total} - coalesce(full_, 0)) / rest END) OVER ({of})"
    sums = lambda of: (
        f"sum(n) OVER ({of} ORDER BY p DESC, k0, k1, k2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS full_, "
        f"sum(n * p) OVER ({of} ORDER BY p DESC, k0, k1, k2 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest"
    )
    for i, (_, power) in enumerate(MIX.values()):
        tables += [
            f"t{i} AS MATERIALIZED (SELECT k{i}, n, {MIX_KEEP} * total AS want, {MIX_KEEP} * total * pow(n / total, {power}) / sum(pow(n / total, {power})) OVER () / n AS p FROM (SELECT k{i}, sum(n) AS n, (SELECT sum(n) FROM c0) AS total FROM c0 GROUP BY k{i}) WHERE n > 0)",
            f"g{i} AS MATERIALIZED (SELECT k{i}, n * least(1.0, p * {factor('want', '')}) AS goal{i} FROM (SELECT *, {sums('').replace(', k0, k1, k2', f', k{i}')} FROM t{i}))",
        ]
    goals = " ".join(f"LEFT JOIN g{i} USING (k{i})" for i in range(len(MIX)))
    at = lambda name: "CASE step % 3 " + " ".join(f"WHEN {i} THEN {name}{i}" for i in range(len(MIX))) + " END"
    tables += [
        f"b AS MATERIALIZED (SELECT * FROM c0 {goals})",
        f"""r AS (SELECT k0, k1, k2, n, p, goal0, goal1, goal2, 0 AS step FROM b UNION ALL
SELECT k0, k1, k2, n, CASE WHEN goal IS NULL THEN p ELSE least(1.0, p * {factor('goal', 'PARTITION BY k')}) END AS p, goal0, goal1, goal2, step + 1 AS step
FROM (SELECT *, {sums('PARTITION BY k')} FROM (SELECT *, {at('k')} AS k, {at('goal')} AS goal FROM r WHERE step < {len(MIX) * MIX_SWEEPS})))""",
    ]
    return "WITH RECURSIVE " + ",\n".join(tables) + f"""
SELECT doc_id, source, lang, mix_tokens, round(p, 6) AS mix_probability, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::UBIGINT / 4294967296.0 < p AS mix_kept FROM d JOIN r USING (k0, k1, k2) WHERE step = {len(MIX) * MIX_SWEEPS}"""


def _url_sql() -> str:
    """The rules as conditions, and the shrunken rates level by level."""
    rules = sorted(RULES, key=lambda r: (-len(r), r))
    fits = lambda r: f"(host = '{r.partition('/')[0]}' OR host LIKE '%.{r.partition('/')[0]}') AND starts_with(path, '/{r.partition('/')[2]}')"
    case = lambda f: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{f(r)}'" for r in rules) + " END"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    moments = lambda level, mean: (
        f"SELECT CASE WHEN g = 0 OR n <= nn / n THEN {urls.STRONGEST} WHEN (ss - g * vv / n) / (n - nn / n) > 0 THEN least({urls.STRONGEST}, greatest({urls.WEAKEST}, vv / n / ((ss - g * vv / n) / (n - nn / n)) - 1)) ELSE {urls.STRONGEST} END AS z "
        f"FROM (SELECT sum(n) n, count(n) g, sum(n * n) nn, sum(n * (k / n - m) * (k / n - m)) ss, sum(n * m * (1 - m)) vv FROM {level})"
    )
    return f"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{upper}', '{upper.lower()}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
p AS (SELECT page_id, host, path, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name FROM u),
w AS (SELECT *, array_to_string(list_slice(string_split(name, '.'), -2, -1), '.') AS two, array_to_string(list_slice(string_split(name, '.'), -3, -1), '.') AS three, list_extract(string_split(name, '.'), -1) AS one FROM p),
q AS (SELECT page_id, host, path, CASE WHEN deep THEN three ELSE two END AS domain, CASE WHEN deep THEN two ELSE one END AS suffix FROM (SELECT *, regexp_full_match(two, '(?:{'|'.join(urls.SECOND_LEVEL)})[.][a-z][a-z]') AS deep FROM w)),
h AS MATERIALIZED (SELECT suffix, domain, host, count(quality)::DOUBLE n, sum(quality)::DOUBLE k FROM q JOIN labels ON page_id = doc_id WHERE quality IS NOT NULL GROUP BY ALL),
g AS (SELECT (coalesce(sum(k), 0) + 1) AS a0, coalesce(sum(n) - sum(k), 0) + 1 AS b0 FROM h),
s1 AS (SELECT suffix, sum(n) n, sum(k) k, (SELECT a0 / (a0 + b0) FROM g) AS m FROM h GROUP BY suffix),
s2 AS MATERIALIZED (SELECT suffix, m * z + k AS a, (1 - m) * z + n - k AS b FROM s1, ({moments('s1', 'm')})),
d1 AS (SELECT suffix, domain, n, k, a / (a + b) AS m FROM (SELECT suffix, domain, sum(n) n, sum(k) k FROM h GROUP BY ALL) JOIN s2 USING (suffix)),
d2 AS MATERIALIZED (SELECT suffix, domain, m * z + k AS a, (1 - m) * z + n - k AS b FROM d1, ({moments('d1', 'm')})),
h1 AS (SELECT suffix, domain, host, n, k, a / (a + b) AS m FROM h JOIN d2 USING (suffix, domain)),
h2 AS MATERIALIZED (SELECT suffix, domain, host, m * z + k AS a, (1 - m) * z + n - k AS b FROM h1, ({moments('h1', 'm')})),
v AS (SELECT page_id, host, path, coalesce(h2.a, d2.a, s2.a, a0) AS a, coalesce(h2.b, d2.b, s2.b, b0) AS b FROM q LEFT JOIN h2 USING (suffix, domain, host) LEFT JOIN d2 USING (suffix, domain) LEFT JOIN s2 USING (suffix), g)
SELECT page_id, host, path, {case(lambda r: r)} AS rule, coalesce({case(RULES.get)}, CASE WHEN mean + deviations < 0.5 THEN 'block' ELSE 'allow' END) AS verdict, round(mean, 6) AS posterior_mean, round(mean + deviations, 6) AS posterior_bound
FROM (SELECT *, a / (a + b) AS mean, 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS deviations FROM v)"""


def _warc_sql() -> str:
    """Twenty bits of the digest at a time are five hex digits and four letters of base32."""
    letter = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)"
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, row_number() OVER w AS copy, first_value(page_id) OVER w AS first FROM pages WINDOW w AS (PARTITION BY coalesce(html, '') ORDER BY page_id)),
d AS (SELECT *, sha1(html) AS h FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, array_to_string([{letter} FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN copy = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN copy > 1 THEN first END AS refers_to FROM d"""


def _divergence_sql() -> str:
    """Every cell of the matrix, zeros included."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    share = lambda n, total: f"(1 + (1000000000::HUGEINT * ({n} + 5)) // ({total} + 5 * v))::BIGINT"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{upper}', '{upper.lower()}') AS text FROM documents),
w AS MATERIALIZED (SELECT lang, source, term, row, count(*) AS n FROM (SELECT lang, source, row, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d) GROUP BY ALL),
t AS MATERIALIZED (SELECT lang, term, sum(n) AS n FROM w GROUP BY ALL HAVING count(*) >= 30),
l AS MATERIALIZED (SELECT lang, count(*) AS v, sum(n) AS total FROM t GROUP BY ALL),
c AS MATERIALIZED (SELECT lang, source, term, sum(w.n) AS n FROM w SEMI JOIN t USING (lang, term) GROUP BY ALL),
g AS MATERIALIZED (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS MATERIALIZED (SELECT lang, source, term, coalesce(c.n, 0) AS n, {share('coalesce(c.n, 0)', 'g.total')} AS p, {share('t.n', 'l.total')} AS q FROM g JOIN l USING (lang) JOIN t USING (lang) LEFT JOIN c USING (lang, source, term)),
f AS (SELECT lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b USING (lang) LEFT JOIN (SELECT lang, a.source AS x, b.source AS y, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b USING (lang, term) GROUP BY ALL) s ON s.lang = a.lang AND x = a.source AND y = b.source WHERE a.source <> b.source
UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM f QUALIFY part = 'pair' OR rank <= 50"""


#: The other operators' results are not to be had from SQL in reasonable time; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op4_mix_to_targets": _mix_sql(), "op6_url_reputation": _url_sql(), "op10_warc_segments": _warc_sql(), "op13_source_divergence": _divergence_sql()}
