"""One registered query per corpus operator, with its SQL where SQL can express it."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality import ALPHA, DELTA, RULES

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(build):
        LLM_QUERIES[name] = build
        if sql is not None:
            LLM_ORACLES[name] = sql
        return build

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register(
    "op1_mix_sources",
    r"""
WITH sized AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h
    FROM documents
), sources AS (
    SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sized GROUP BY source
), weighed AS (
    SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END :: DOUBLE AS weight FROM sources
), ordered AS (
    SELECT *, row_number() OVER (ORDER BY 2 * source_size / weight, rank) AS k FROM weighed
), levels AS (
    SELECT *, (1.5 :: DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ordered
), chosen AS (
    SELECT level FROM levels WHERE level * weight < 2 * source_size ORDER BY k LIMIT 1
), planned AS (
    SELECT source, source_size, weight, least(CAST(2 * source_size AS DOUBLE), (SELECT level FROM chosen) * weight) AS target FROM weighed
), placed AS (
    SELECT s.doc_id, s.size, p.source_size, p.target, p.weight,
        coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins
    FROM sized s JOIN planned p ON s.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
    CAST(greatest(0, least(size, round(target) - begins)) + greatest(0, least(size, round(target) - begins - source_size)) AS BIGINT) AS taken,
    CASE WHEN size = 0 OR round(target) <= begins THEN NULL
        WHEN weight = 5 THEN least(1.0, 2 * area / (7.5 + sqrt(7.5 * 7.5 - 10 * area)))
        WHEN weight = 2 THEN least(1.0, 2 * area / (2.0 + sqrt(4.0)))
        WHEN area < 0.3125 THEN least(0.5, 2 * area / (0.5 + sqrt(0.25 + area)))
        ELSE least(1.0, 0.5 + 2 * (area - 0.3125) / (0.75 + sqrt(0.5625 + 5 * (area - 0.3125)))) END AS first_position
FROM (SELECT *, least(1.0, begins / greatest(target, 1e-300)) * weight AS area FROM placed)
""",
)
def op1_mix_sources(spark, sf_dir):
    from .mixing import mix

    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    digest = mixed.select("doc_id", "size", "source_size", "target", "taken", F.get("takes", F.lit(0))["position"].alias("first_position"))
    return digest.orderBy("first_position", "doc_id")


@register(
    "op5_line_dedup",
    r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), shared AS (
    SELECT key, max(doc_id) AS owner FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
    SELECT k.*, s.owner IS NOT NULL AND s.owner <> k.doc_id AS dropped FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (dropped) AS BIGINT) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
)
def op5_line_dedup(spark, sf_dir):
    from .lines import dedup_lines

    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@register("op9_shard_documents")
def op9_shard_documents(spark, sf_dir):
    from .sharding import shard

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    # Only narrow columns go through the range sort.
    narrow = docs.select("doc_id", "source", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"))
    return shard(narrow).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@register(
    "op6_url_filter",
    r"""
WITH parsed AS (
    SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(coalesce(url, ''), '(?s)^[^?#]*\?([^#]*)', 1) AS query
    FROM pages
), keyed AS (
    SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, ':(80|443)$', '') || regexp_replace(path, '/+$', '') || '?'
        || coalesce(array_to_string(list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid)='))), '&'), '') END AS canonical
    FROM parsed
), listed AS (
    SELECT canonical FROM keyed WHERE canonical IS NOT NULL GROUP BY canonical HAVING count(*) > 1
), rules(verdict, top, start) AS (
    VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fitting AS (
    SELECT k.*, r.verdict, r.top || r.start AS rule, row_number() OVER (PARTITION BY page_id, url ORDER BY length(r.top || r.start) DESC NULLS LAST) AS k
    FROM keyed k LEFT JOIN rules r ON (k.host = r.top OR ends_with(k.host, '.' || r.top)) AND starts_with(k.path, r.start)
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM fitting f LEFT JOIN listed l ON f.canonical = l.canonical WHERE k = 1
""",
)
def op6_url_filter(spark, sf_dir):
    from .urls import judge_urls, repeated_urls

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    # The list: addresses that the crawl fetched more than once.
    return judge_urls(pages, repeated_urls(pages)).select("page_id", "host", "path", "rule", "verdict")


#: The ladder of each quality rule as SQL rows.
_LADDER = ", ".join(f"('{name}', {step}, {cutoff} :: DOUBLE)" for name, cuts in RULES.items() for step, cutoff in enumerate(cuts))


@register(
    "op10_quality_rules",
    rf"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, 'null') AS stratum, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM documents
), placed AS (
    SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS pos, len(words) AS n FROM docs
), windows AS (
    SELECT r, pos, n, string_agg(word, ' ') OVER (PARTITION BY r ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS w FROM placed
), repeated AS (
    SELECT r, pos FROM (SELECT r, pos, count(*) OVER (PARTITION BY r, w) AS k FROM windows WHERE pos + 7 <= n) WHERE k > 1
), covered AS (
    SELECT r, sum(step) AS n FROM (SELECT r, least(8, coalesce(lead(pos) OVER (PARTITION BY r ORDER BY pos) - pos, 8)) AS step FROM repeated) GROUP BY r
), counted AS (
    SELECT d.r, doc_id, stratum, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, len(regexp_extract_all(text, '\p{{Lu}}')) AS capitals
    FROM docs d LEFT JOIN covered c ON d.r = c.r
), based AS (
    SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted
), valued AS (
    SELECT r, doc_id, stratum, base_failed, unnest(['symbols_per_word', 'capital_share', 'duplicate_line_share', 'repeat_word_share', 'chars_per_word']) AS rule,
        coalesce(unnest([n_symbols / nullif(n_words, 0), capitals / nullif(word_chars, 0), n_dup_lines / nullif(n_lines, 0), n_repeat_words / nullif(n_words, 0), word_chars / nullif(n_words, 0)]), 0) AS x
    FROM based
), held AS (
    SELECT * FROM valued WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL)
), ladder(rule, step, cutoff) AS (
    VALUES {_LADDER}
), tried AS (
    SELECT stratum, h.rule, step, cutoff, count(*) AS n, count(*) FILTER (x > cutoff) AS k FROM held h JOIN ladder l ON h.rule = l.rule GROUP BY ALL
), tested AS (
    SELECT *, k < {ALPHA} / {len(RULES)} * n AND list_sum(list_transform(range(0, k + 1),
            lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA / len(RULES)} :: DOUBLE) + (n - i) * ln(1 - {ALPHA / len(RULES)} :: DOUBLE))))
        <= {DELTA} :: DOUBLE / ({len(RULES)} * (SELECT count(DISTINCT stratum) FROM held)) AS passes
    FROM tried
), certified AS (
    SELECT stratum, rule, min(cutoff) AS cutoff FROM (SELECT *, bool_and(passes) OVER (PARTITION BY stratum, rule ORDER BY step) AS so_far FROM tested) WHERE so_far GROUP BY stratum, rule
), rejected AS (
    SELECT DISTINCT r FROM valued v JOIN certified c ON v.stratum = c.stratum AND v.rule = c.rule WHERE x > cutoff
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND r NOT IN (SELECT r FROM rejected) AS kept FROM based
""",
)
def op10_quality_rules(spark, sf_dir):
    from ..session import durable
    from .quality import apply_cutoffs, cutoffs, measured

    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    # Measures are narrow and read twice: once for the cutoffs, once for the verdict.
    rows = durable(measured(docs).drop("text"))
    judged = apply_cutoffs(rows, cutoffs(rows, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@register("op2_ngram_jaccard_join")
def op2_ngram_jaccard_join(spark, sf_dir):
    from .jaccard import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"), ngram=4, percent=85).select("doc_id", "n_shingles", "component_id")


@register(
    "op4_warc_round_trip",
    """
WITH payloads AS (
    SELECT page_id, coalesce(html, '') AS body, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages
), shared AS (
    SELECT body, max(page_id) AS page FROM payloads WHERE payload_bytes >= 1000 GROUP BY body HAVING count(*) > 1
), typed AS (
    SELECT p.*, CASE WHEN page IS NOT NULL AND page_id IS DISTINCT FROM page THEN page END AS refers_to FROM payloads p LEFT JOIN shared s ON p.body = s.body
)
SELECT page_id, payload_bytes, sha1(body) AS payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM typed
""",
)
def op4_warc_round_trip(spark, sf_dir):
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op7_best_fit_packing")
def op7_best_fit_packing(spark, sf_dir):
    from .packing import exact_cluster, pack_documents

    return pack_documents(table(spark, sf_dir, "documents").withColumn("cluster", exact_cluster()))


@register("op8_toxicity")
def op8_toxicity(spark, sf_dir):
    from .toxicity import score_documents, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    net = train(docs, table(spark, sf_dir, "labels").where(~held_out).select("doc_id", "toxic"))
    scored = score_documents(docs, net)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@register("op3_spot_signatures")
def op3_spot_signatures(spark, sf_dir):
    from .spotsigs import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


@register("op11_language_id")
def op11_language_id(spark, sf_dir):
    from .langid import learn, predict

    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = learn(docs.where(~held_out & F.col("doc_id").isNotNull()).select("text", "lang"))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


#: CRC-32 by half bytes, as SQL over the digits of ``{0}``. The sixteen entries follow from the polynomial.
def _crc_entry(k: int) -> int:
    for _ in range(4):
        k = k >> 1 ^ (0xEDB88320 if k & 1 else 0)
    return k


_CRC_SQL = (
    "xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split({0}, ''), lambda c: [ascii(c) & 15, ascii(c) >> 4]))), "
    f"lambda a, b: xor(a >> 4, [{', '.join(str(_crc_entry(k)) for k in range(16))}][(xor(a, b) & 15) + 1])))"
)


def _planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of one document in ten go on periodically from some place."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g = h // 10
    a = g % len(words)
    p = 1 + (len(words) - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(len(words) - a) // p))[: len(words) - a]


@register(
    "op12_periodic_runs",
    rf"""
WITH taken AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words, {_CRC_SQL.format("CAST(doc_id AS VARCHAR)")} :: BIGINT AS h FROM documents
), sized AS (
    SELECT *, len(words) AS n, CASE WHEN h % 10 = 0 AND len(words) > 0 THEN (h // 10) % len(words) END AS a FROM taken
), edits AS (
    SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM sized
), edited AS (
    SELECT r, doc_id, CASE WHEN a IS NULL THEN words ELSE list_transform(range(0, n), lambda i: words[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) END AS words FROM edits
), placed AS (
    SELECT r, unnest(words) AS w, unnest(range(0, len(words))) AS i, len(words) AS n FROM edited
), equal AS (
    SELECT x.r, y.i - x.i AS q, x.i FROM placed x JOIN placed y ON x.r = y.r AND x.w = y.w AND y.i > x.i AND 3 * (y.i - x.i) <= x.n
), islands AS (
    SELECT r, q, min(i) AS s, max(i) - min(i) + 1 + q AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS g FROM equal) GROUP BY r, q, g
), runs AS (
    SELECT r, s, l, min(q) AS q FROM islands WHERE l >= greatest(24, 3 * q) GROUP BY r, s, l
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY r ORDER BY CAST(l AS DOUBLE) / q DESC, s, q) AS k FROM runs
), listed AS (
    SELECT r, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS listing FROM runs GROUP BY r
), dropped AS (
    SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM runs
), kept AS (
    SELECT p.r, string_agg(w, ' ' ORDER BY p.i) AS text FROM placed p ANTI JOIN dropped d ON p.r = d.r AND p.i = d.i GROUP BY p.r
)
SELECT t.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(s AS BIGINT) AS start, CAST(l AS BIGINT) AS length, CAST(q AS BIGINT) AS period, CAST(1000 * l // q AS BIGINT) AS exponent_milli,
    sha256(coalesce(listing, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM taken t LEFT JOIN listed ON t.r = listed.r LEFT JOIN ranked ON t.r = ranked.r AND ranked.k = 1 LEFT JOIN kept ON t.r = kept.r
""",
)
def op12_periodic_runs(spark, sf_dir):
    from .periodic import collapse_runs

    found = collapse_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), change=_planted)
    # The greatest exact length/period: by cross products, the first of equals in order of start and period.
    ahead = lambda best, x: F.when(best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best)
    top = F.aggregate("runs", F.get("runs", F.lit(0)), ahead)
    digest = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("_top"), "runs", "text")
    line = lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n"))
    return digest.select(
        "doc_id", "n_runs", "_top.start", "_top.length", "_top.period", F.expr("1000 * _top.length div _top.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"),
    )


@register(
    "op13_ranked_search",
    r"""
WITH found AS (
    SELECT row_number() OVER () AS r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), counted AS (
    SELECT r, doc_id, term, count(*) AS tf FROM found GROUP BY ALL
), sizes AS (
    SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM counted GROUP BY r
), whole AS (
    SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes
), asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), weighed AS (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * (SELECT docs FROM whole) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counted WHERE term IN (SELECT term FROM asked) GROUP BY term
), scored AS (
    SELECT item_id, c.r, c.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS BIGINT) AS score
    FROM asked a JOIN weighed USING (term) JOIN counted c USING (term) JOIN sizes s ON c.r = s.r CROSS JOIN whole GROUP BY ALL
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
""",
)
def op13_ranked_search(spark, sf_dir):
    from .lexical import search

    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
