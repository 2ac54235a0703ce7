"""The driver's queries for these operators, and their DuckDB equivalents where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, language, middles, neighbours, packing, runs, simhash, substrings, tokens, urls, warc
from .common import visible_to_tasks

Query = Callable[[SparkSession, str], DataFrame]

#: Tokenizer files; every executor has them.
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
END_ID = 2
PACKED_END_ID = 1

RULES = [
    urls.Rule("net", "/", "block"),
    urls.Rule("example.net", "/en/", "allow"),
    urls.Rule("example.com", "/de/", "block"),
    urls.Rule("org", "/fr/", "allow"),
]
#: Sites, without what stands before and behind their names, all of whose pages make the list of URLs: it grows with the pages.
LISTED_SITES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
#: The name of a site in its host.
_SITE = r"^(?:(?:www|m|blog)\.)?([^.]*)\."


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    visible_to_tasks(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    listed = pages.where(F.regexp_extract(urls.host_of(F.col("url")), _SITE, 1).isin(LISTED_SITES)).select("url")
    return urls.judge_urls(pages, listed, RULES)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return judged.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokens.token_files(table(spark, sf_dir, "documents"), WORD_TOKENIZER, END_ID)
    return files.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.drop_repeats(table(spark, sf_dir, "documents"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest_neighbours(vectors, vectors.where("vec_id % 50 = 0"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archived = warc.archive_pages(table(spark, sf_dir, "pages"))
    return archived.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.where(~language.held_out()))
    return language.identify(docs.select("doc_id", "text"), model).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), BYTE_RANKS, PATTERN).drop("ids")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), WORD_TOKENIZER, PACKED_END_ID)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document, by a hash of its id, repeats itself from some word on."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashed = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", "text", hashed.alias("_h"), F.when(hashed % 10 == 0, words).alias("_words"))
    rows = rows.select("doc_id", "text", "_words", F.floor(F.col("_h") / 10).alias("_g"), F.nullif(F.size("_words"), F.lit(0)).alias("_n"))
    rows = rows.withColumn("_a", F.when(F.col("_words").isNotNull(), F.col("_g") % F.col("_n")))
    rows = rows.withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8)))
    repeated = F.expr("transform(_words, (w, i) -> CASE WHEN i < _a THEN w ELSE element_at(_words, CAST(_a + (i - _a) % _p + 1 AS INT)) END)")
    return rows.select("doc_id", F.when(F.col("_p").isNotNull(), F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "start",
        "length",
        "period",
        F.expr("1000 * length div period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = middles.fill_in_middle(table(spark, sf_dir, "documents"))
    back = middles.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_simhash, op2_url_filter, op3_decontaminate, op4_token_files, op5_substring_dedup, op6_nearest_neighbours, op7_chat_format, op8_warc, op9_language, op10_byte_bpe, op11_packing, op12_periodic_runs, op13_fill_in_middle, pipeline)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RULE_SQL = "CASE" + "".join(
    f" WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{{{i}}}'"
    for i, r in sorted(enumerate(RULES), key=lambda x: -len(x[1].text))
) + " END"
_ITEM_WORDS = r"regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op2_url_filter": f"""
WITH parts AS (
  SELECT page_id, coalesce({_LOWER.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")}, '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
keyed AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(?:www|m)\\.', '') || regexp_replace(path, '(?:\\.html)?/*$', '') END AS key
  FROM parts),
listed AS (
  SELECT DISTINCT key FROM keyed
  WHERE regexp_extract(host, '{_SITE}', 1) IN ({', '.join(f"'{s}'" for s in LISTED_SITES)}))
SELECT page_id, host, path, {_RULE_SQL.format(*(r.text for r in RULES))} AS rule,
       coalesce({_RULE_SQL.format(*(r.verdict for r in RULES))}, CASE WHEN listed.key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       listed.key IS NOT NULL AS listed
FROM keyed LEFT JOIN listed USING (key)""",
    "op3_decontaminate": f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ITEM_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, size, array_to_string(w[i : i + size - 1], ' ') AS gram
  FROM (SELECT item, w, least(13, len(w)) AS size, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM windows),
grams AS (
  SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS gram
  FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM docs, sizes)),
found AS (SELECT doc_id, i, windows.size AS size, item FROM grams JOIN windows ON grams.size = windows.size AND grams.gram = windows.gram),
hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op8_warc": """
WITH hashed AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
firsts AS (SELECT hex, min(page_id) AS first FROM hashed GROUP BY hex),
parts AS (SELECT *, list_transform(range(8), lambda i: CAST('0x' || substr(hex, CAST(i * 5 + 1 AS INTEGER), 5) AS BIGINT)) AS fives FROM hashed JOIN firsts USING (hex))
SELECT page_id, payload_bytes,
       array_to_string(flatten(list_transform(fives, lambda v: list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((v >> s) & 31) + 1 AS INTEGER), 1)))), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM parts""",
    "op13_fill_in_middle": r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || doc_id) AS h, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u FROM documents),
drawn AS (
  SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n,
         list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS d FROM units),
placed AS (
  SELECT doc_id, text, u, n, least(d[1] % (n + 1), d[2] % (n + 1)) AS a, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d[3] % 100 >= 100 THEN 'plain'
              WHEN d[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (
  SELECT *, coalesce(array_to_string(u[1 : a], ''), '') AS p, coalesce(array_to_string(u[a + 1 : b], ''), '') AS m, coalesce(array_to_string(u[b + 1 :], ''), '') AS s FROM placed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts""",
}
