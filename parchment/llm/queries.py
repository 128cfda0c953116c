"""The queries of the operators in this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.llm import decontam, jaccard, langid, media, packing, secrets, sharding, tokens, toxicity, urls
from parchment.llm.common import bounded_batches, prepare, table


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))

    def of(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")

    def told(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("secrets", lambda s: s["kind"] != "learned")
    return found.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("secrets")).alias("spans"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify_languages(docs, langid.train_language_model(docs))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_round_trip(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.col("items")
    return found.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), "contaminated")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train_toxicity_model(docs, table(spark, sf_dir, "labels")))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_files(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_secrets, op2_jaccard_join, op3_packing, op4_language_id, op5_media, op6_decontamination, op7_url_filters, op8_toxicity, op9_token_files, op10_sharding)

    def ready(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            bounded_batches(spark)
            return f(spark, sf_dir)

        return run

    return {f.__name__: ready(f) for f in found}


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS h FROM s GROUP BY doc_id),
f AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS set_id FROM n),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n AS x ON a = x.doc_id JOIN n AS y ON b = y.doc_id WHERE 10 * c >= 8 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
k AS (SELECT a, min(b) AS class_id FROM r GROUP BY a),
c AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT d.doc_id, class_id, coalesce(set_id, d.doc_id) AS set_id, coalesce(n_links, 0) AS n_links
FROM documents AS d JOIN k ON d.doc_id = k.a LEFT JOIN f ON d.doc_id = f.doc_id LEFT JOIN c ON d.doc_id = c.a
"""

_DECONTAM = f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark),
win AS (SELECT DISTINCT item, least(13, len(ws)) AS size, unnest(list_transform(range(1, len(ws) - least(13, len(ws)) + 2),
        lambda k: array_to_string(ws[k : k + least(13, len(ws)) - 1], ' '))) AS g FROM i WHERE len(ws) > 0),
w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
sizes AS (SELECT DISTINCT size FROM win),
pos AS (SELECT doc_id, size, unnest(range(1, len(ws) - size + 2)) AS k, ws FROM w, sizes WHERE len(ws) >= size),
h AS (SELECT doc_id, k, pos.size, item FROM (SELECT doc_id, k, size, array_to_string(ws[k : k + size - 1], ' ') AS g FROM pos) AS pos JOIN win ON pos.g = win.g AND pos.size = win.size),
cover AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS word FROM h) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS told FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(told, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _sharding_sql() -> str:
    filled = "".join(f"{k:02x}" for k in sharding.lookup_table())
    return f"""
WITH t AS (SELECT '{filled}' AS filled), d AS (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) % {sharding.SLOTS} AS slot FROM documents)
SELECT doc_id, slot, CAST('0x' || substr(filled, 2 * slot + 1, 2) AS INTEGER) AS shard FROM d, t
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_jaccard_join": _JACCARD, "op6_decontamination": _DECONTAM, "op10_sharding": _sharding_sql()}
