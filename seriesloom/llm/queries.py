"""The queries of this subpackage, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_cnn, curriculum, divergence, fm_decontam, html_blocks, jaccard_join, lexical, license_scan, pattern_packing, quality_rules, sstable, suffix_dedup, winnowing


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.fingerprints(table(spark, sf_dir, "documents"))


def op3_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.round_trip(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_matches, licenses (names of matched templates, sorted, comma-joined) and best containment."""
    found = license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array_sort(F.array_distinct(F.col("matches.template")))
    return found.select(
        "doc_id", "n_words", F.size("matches").cast("long").alias("n_matches"), F.array_join(names, ",").alias("licenses"), F.array_max("matches.containment").alias("best")
    )


def op5_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.trim(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pattern_packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1, capacity=4096)


def op8_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_cnn.identify(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(table(spark, sf_dir, "documents"))


def op10_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fm_decontam.scan(docs, table(spark, sf_dir, "benchmark")).drop("text", "spans")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


DIVERGENCE_SQL = r"""WITH g AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS (SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT row_number() OVER () AS doc, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents)),
k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(total) AS nl FROM k GROUP BY lang),
s AS (SELECT g.lang, g.source, coalesce(max(v.v), 0) AS v, coalesce(max(v.nl), 0) AS nl, coalesce(sum(c.n) FILTER (WHERE k.term IS NOT NULL), 0) AS whole FROM g LEFT JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source LEFT JOIN k ON k.lang = c.lang AND k.term = c.term GROUP BY g.lang, g.source),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + 1000000000 * (coalesce(c.n, 0) + 1) // (s.whole + s.v) AS BIGINT) AS p, CAST(1 + 1000000000 * (k.total + 1) // (s.nl + s.v) AS BIGINT) AS q FROM s JOIN k ON k.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
w AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(w.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN w ON w.lang = a.lang AND w.source = a.source AND w.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r) WHERE part = 'pair' OR rank <= 200"""


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SEARCH_SQL = r"""WITH d AS (SELECT doc_id, row_number() OVER () AS doc, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
g AS (SELECT count(*) FILTER (WHERE len(ts) > 0) AS n, CAST(sum(len(ts)) AS HUGEINT) AS l FROM d),
b AS (SELECT item_id, row_number() OVER () AS item, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
q AS (SELECT item_id, item, term, count(*) AS times FROM b GROUP BY ALL),
p AS (SELECT doc, doc_id, term, n, count(*) AS tf FROM (SELECT doc, doc_id, len(ts) AS n, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * max(g.n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, g GROUP BY term),
s AS (SELECT q.item_id, q.item, p.doc, p.doc_id, CAST(sum(q.times * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * CAST(25 + (75 * p.n * g.n) // g.l AS BIGINT)))) AS BIGINT) AS score FROM p JOIN w ON w.term = p.term JOIN q ON q.term = p.term, g GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10"""


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.mix(table(spark, sf_dir, "documents"))


MIX_SQL = r"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][place % 3 + 1] AS w, 2 * source_size AS cap FROM s),
r AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - (sum(cap) OVER o - cap)) / (sum(w) OVER () - (sum(w) OVER o - w)) AS level FROM w WINDOW o AS (ORDER BY cap / w, place ROWS UNBOUNDED PRECEDING)),
t AS (SELECT source, source_size, w, least(CAST(cap AS DOUBLE), coalesce((SELECT arg_min(level, cap / w) FROM r WHERE level < cap / w), 'inf'::DOUBLE) * w) AS target FROM r),
c AS (SELECT d.doc_id, d.size, source_size, target, w, sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(concat_ws(' ', CAST(d.doc_id AS VARCHAR), CAST(d.size AS VARCHAR))), d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS begin FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source),
e AS (SELECT *, greatest(0, least(size, floor(target) - begin)) AS once, greatest(0, least(size, floor(target) - begin - source_size)) AS again, begin / target AS u, (begin + source_size) / target AS v FROM c)
SELECT doc_id, size, source_size, target, CAST(once + again AS BIGINT) AS taken, CASE WHEN once > 0 THEN CASE w WHEN 5 THEN 2 * u / (1.5 + sqrt(2.25 - 2 * u)) WHEN 2 THEN u ELSE 2 * u / (0.5 + sqrt(0.25 + 2 * u)) END END AS first_position,
  CASE WHEN again > 0 THEN CASE w WHEN 5 THEN 2 * v / (1.5 + sqrt(2.25 - 2 * v)) WHEN 2 THEN v ELSE 2 * v / (0.5 + sqrt(0.25 + 2 * v)) END END AS last_position FROM e"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_winnowing": op2_winnowing,
    "op3_token_tables": op3_token_tables,
    "op4_license_scan": op4_license_scan,
    "op5_html_blocks": op5_html_blocks,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_pattern_packing": op7_pattern_packing,
    "op8_byte_cnn": op8_byte_cnn,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_fm_decontamination": op10_fm_decontamination,
    "op11_source_divergence": op11_source_divergence,
    "op12_lexical_search": op12_lexical_search,
    "op13_source_mix": op13_source_mix,
}
ORACLE_SQL: dict[str, str] = {"op11_source_divergence": DIVERGENCE_SQL, "op12_lexical_search": SEARCH_SQL, "op13_source_mix": MIX_SQL}
