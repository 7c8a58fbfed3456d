"""The registered queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import bpe, cotraining, exact_dedup, html_text, mixing, ngram_join, quality_rules, sharding, toxicity, url_rules
from codeloom.llm.common import materialize, may_be_in, small_batches, table, without

#: Weights of the mix, in two-hundredths: a tenth for src0, 4.5 % for each other listed source and for the rest.
MIX_UNITS = {"src0": 20, **{f"src{i}": 9 for i in range(1, 20)}, mixing.OTHER: 9}
MIX_BLOCK_ROWS = 8
#: Verdicts for hosts and paths.
SITE_RULES = [
    url_rules.SiteRule("allow", "org", "/"),
    url_rules.SiteRule("block", "example.org", "/es/"),
    url_rules.SiteRule("block", "example.org", "/en/1"),
    url_rules.SiteRule("allow", "com", "/fr/"),
    url_rules.SiteRule("block", "com", "/de/"),
]
#: A mined rule's least share of the labelled pages, rows and confidence, and most tokens.
URL_MINING = {"support": 0.001, "least_rows": 4, "confidence": 0.6, "most_tokens": 3}
#: The vocabulary file of the encoder, by its name in the tokenizer package.
BPE_FILE = "word_bpe_49k.json"


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), shards=16)


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    judged = url_rules.judge_urls(pages, url_rules.labels_by_number(pages, table(spark, sf_dir, "labels")), SITE_RULES, **URL_MINING)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.learn_from_labels(docs, table(spark, sf_dir, "labels"))
    judged = quality_rules.judge(docs.select("doc_id", "text"), rules)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), MIX_UNITS, MIX_BLOCK_ROWS)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), words=5, percent=75)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = cotraining.train(docs, table(spark, sf_dir, "labels"))
    return cotraining.score_quality(docs, model).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def token_digests(docs: DataFrame, *more: Column) -> DataFrame:
    """Of each document: the number of its tokens, and digests of its ids and of what they decode to."""
    import public_tokenizers

    coded = bpe.encode_documents(docs, public_tokenizers.path(BPE_FILE), more=more)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), *coded.columns[3:])


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = toxicity.learn(docs, labels.where(~held_out))
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "toxic_words")


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the learned rules."""
    rules = quality_rules.learn_from_labels(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules).where("kept").select(*docs.columns)


def stage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one row: of those with the largest id, the least by all columns."""
    columns = docs.columns
    judged = exact_dedup.exact_dedup(docs).where("group_size > 1").select(F.col("text_sha256").alias("_digest"), F.col("keep_id").alias("_keep"))
    classes = materialize(judged.distinct(), "dedup-classes")
    rows = docs.withColumn("_digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    lone = without(rows, classes, "_digest").select(*columns)
    tied = may_be_in(rows, classes, "_digest").join(classes, "_digest").where(F.col("doc_id").eqNullSafe(F.col("_keep")))
    return lone.unionByName(tied.groupBy("_digest").agg(F.min(F.struct(*columns)).alias("row")).select("row.*"))


def stage_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies, one row: the first of those with the smallest id; rows without id come last."""
    columns = docs.columns
    rows = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "near-rows")
    linked = materialize(ngram_join.jaccard_components(rows, words=5, percent=75, id_col="_row").select("_row", "component_id"), "near-linked")
    several = linked.join(linked.where("_row <> component_id").select("component_id").distinct(), "component_id", "left_semi")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_row"))
    first = several.join(rows.select("_row", "doc_id"), "_row").groupBy("component_id").agg(F.min_by("_row", order).alias("_row"))
    dropped = materialize(several.join(first, "_row", "left_anti").select("_row"), "near-dropped")
    return without(rows, dropped, "_row").select(*columns)


def _row_digest(docs: DataFrame) -> Column:
    """Orders rows with equal ids by all that they hold."""
    return F.sha2(F.to_json(F.struct(*docs.columns)), 256)


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, dealt to files and sorted in them by their place in the mix. The files' order is the mix: the next stage numbers its rows by it."""
    columns = docs.columns
    placed = mixing.mix(docs.withColumn("_tie", _row_digest(docs)), MIX_UNITS, MIX_BLOCK_ROWS, keep=[c for c in columns if c != "doc_id"], ties=("_tie",))
    return placed.repartitionByRange("slot", "seat").sortWithinPartitions("slot", "seat").select(*columns)


def in_files(docs: DataFrame) -> list[Column]:
    """(file, row): where a frame's rows stand in its Parquet files, the files by the number of the partition that they were; rows of no file by their order in the frame."""
    try:
        docs.select("_metadata.file_name", "_metadata.row_index")
    except AnalysisException:
        return [F.struct(F.lit(0).cast("long").alias("part"), F.lit("").alias("name")).alias("file"), F.monotonically_increasing_id().alias("row")]
    name = F.col("_metadata.file_name")
    part = F.coalesce(F.expr(r"try_cast(regexp_extract(_metadata.file_name, '^part-([0-9]+)', 1) AS BIGINT)"), F.lit(0).cast("long"))
    return [F.struct(part.alias("part"), name.alias("name")).alias("file"), F.col("_metadata.row_index").alias("row")]


def stage_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token digests with its slot and seat in the mix, in that order.

    Files are read again in no set order, but each row knows its file and its place there: a stream's rows take their slots and seats in the order
    that the mixing stage gave them.
    """
    with small_batches(spark):
        coded = materialize(token_digests(docs, F.col("source"), *in_files(docs)), "pipeline-tokens")
    digests = ["n_tokens", "ids_sha256", "decoded_sha256"]
    placed = mixing.mix(coded, MIX_UNITS, MIX_BLOCK_ROWS, keep=digests, order=("file", "row"))
    return placed.select("doc_id", *digests, "slot", "seat").orderBy("slot", "seat")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_sharding": op2_sharding,
    "op3_url_rules": op3_url_rules,
    "op4_quality_rules": op4_quality_rules,
    "op5_html": op5_html,
    "op6_mixing": op6_mixing,
    "op7_ngram_join": op7_ngram_join,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_bpe": op9_bpe,
    "op10_toxicity": op10_toxicity,
}

_OP1 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""

#: The schedule by recursion over slots: the released block that is due first, larger weights, then names breaking ties.
_OP6 = """
WITH RECURSIVE units(stream, u) AS (VALUES {units}),
total AS (SELECT sum(u)::BIGINT AS p FROM units),
blocks AS (SELECT stream, u, k, ((k - 1) * p) // u AS release, (k * p + u - 1) // u AS due FROM units, total, generate_series(1, u) AS g(k)),
steps(t, done, stream, k, release, due) AS (
  SELECT -1::BIGINT, []::VARCHAR[], NULL::VARCHAR, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT
  UNION ALL
  SELECT s.t + 1, list_append(s.done, b.stream || ' ' || b.k), b.stream, b.k, b.release, b.due
  FROM (SELECT * FROM steps WHERE t + 1 < (SELECT p FROM total)) s, LATERAL (
    SELECT * FROM blocks b WHERE b.release <= s.t + 1 AND NOT list_contains(s.done, b.stream || ' ' || b.k)
    ORDER BY b.due, b.u DESC, b.stream, b.k LIMIT 1) b),
d AS (SELECT doc_id, source, CASE WHEN source IN (SELECT stream FROM units WHERE stream <> '*') THEN source ELSE '*' END AS stream,
             coalesce(md5(doc_id::VARCHAR), '') AS o FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY o, doc_id NULLS FIRST) - 1 AS rank FROM d),
b AS (SELECT r.*, u, rank // {rows} AS blk FROM r JOIN units USING (stream))
SELECT doc_id, source, b.stream, blk + 1 AS block, t + (blk // u) * p AS slot, rank % {rows} AS seat,
       release + (blk // u) * p AS release, due + (blk // u) * p AS deadline
FROM b JOIN steps ON steps.stream = b.stream AND steps.k = blk % u + 1, total
"""

_URL = r"'^(.*?)://([^/?#]*)([^?#]*)(?:\\?([^#]*))?(?:#(.*))?$'"
_DIGITS = "regexp_replace(lower({}), '[0-9]+', '0', 'g')"

#: Token sets of one to three by self-joins, in place of FP-growth.
_OP3 = r"""
WITH p AS (SELECT page_id, url, CASE WHEN regexp_matches(url, {url}, 's') THEN url END AS u FROM pages),
f AS (SELECT page_id, url, regexp_extract(u, {url}, 1, 's') AS scheme, coalesce(translate(regexp_extract(u, {url}, 2, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(u, {url}, 3, 's'), '') AS path, regexp_extract(u, {url}, 4, 's') AS query, regexp_extract(u, {url}, 5, 's') AS part FROM p),
l AS (SELECT *, string_split(host, '.') AS labels FROM f),
t AS (SELECT page_id, url, list_sort(list_distinct(list_concat(
    list_transform(list_filter([scheme], lambda x: x <> ''), lambda x: 'scheme:' || {x}), list_transform(list_filter([host], lambda x: x <> ''), lambda x: 'host:' || {x}),
    list_transform(list_filter(labels[1:1], lambda x: x <> ''), lambda x: 'first:' || {x}), list_transform(list_filter(labels[-1:], lambda x: x <> ''), lambda x: 'last:' || {x}),
    list_transform(list_filter(flatten(list_transform(list_filter(labels, lambda y: contains(y, '-')), lambda y: string_split(y, '-'))), lambda x: x <> ''), lambda x: 'word:' || {x}),
    list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: 'path:' || {x}),
    list_transform(list_filter(list_transform(string_split(query, '&'), lambda y: split_part(y, '=', 1)), lambda x: x <> ''), lambda x: 'key:' || {x}),
    list_transform(list_filter([part], lambda x: x <> ''), lambda x: 'part:' || {x})))) AS tokens FROM l WHERE host <> ''),
own AS (SELECT doc_id, max(1 - quality) AS bad FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
labelled AS (SELECT row_number() OVER () AS r, tokens, bad FROM t JOIN own ON own.doc_id = try_cast(regexp_extract(url, '^.*?://[^/?#]*[^?#]*?([0-9]+)[^0-9/?#]*/?(?:[?#].*)?$', 1, 's') AS BIGINT)),
w AS (SELECT r, bad, unnest(tokens) AS k FROM labelled),
s AS (SELECT r, bad, [k] AS items FROM w
  UNION ALL SELECT a.r, a.bad, [a.k, b.k] FROM w a JOIN w b ON a.r = b.r AND a.k < b.k
  UNION ALL SELECT a.r, a.bad, [a.k, b.k, c.k] FROM w a JOIN w b ON a.r = b.r AND a.k < b.k JOIN w c ON b.r = c.r AND b.k < c.k),
rules AS (SELECT items FROM s GROUP BY items HAVING sum(bad) >= greatest({least}, ceil({support} * (SELECT count(*) FROM labelled))) AND sum(bad) >= {confidence} * count(*)),
hit AS (SELECT DISTINCT page_id FROM t, rules WHERE list_has_all(tokens, items)),
site(verdict, h, p) AS (VALUES {rules}),
fit AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(site.verdict, length(h || p)) AS verdict
  FROM f JOIN site ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT f.page_id, f.host, f.path, fit.rule, coalesce(fit.verdict, CASE WHEN hit.page_id IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM f LEFT JOIN fit USING (page_id) LEFT JOIN hit USING (page_id)
"""

#: Every pair that shares a shingle is counted; links are followed by recursion.
_OP7 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS s FROM w),
x AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS k FROM g),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS shared FROM x a JOIN x b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM c WHERE 100 * shared >= 75 * (na + nb - shared)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT g.doc_id, len(s)::BIGINT AS n_shingles, least(g.doc_id, coalesce(m.least, g.doc_id)) AS component_id FROM g LEFT JOIN m ON m.a = g.doc_id
"""

ORACLES: dict[str, str] = {
    "op7_ngram_join": _OP7,
    "op3_url_rules": _OP3.format(
        url=_URL, x=_DIGITS.format("x"), least=URL_MINING["least_rows"], support=URL_MINING["support"], confidence=URL_MINING["confidence"],
        rules=", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in SITE_RULES),
    ),
    "op1_exact_dedup": _OP1,
    "op6_mixing": _OP6.format(units=", ".join(f"('{s}', {u}::BIGINT)" for s, u in MIX_UNITS.items()), rows=MIX_BLOCK_ROWS),
}
