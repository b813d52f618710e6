"""The numbered queries over the driver tables, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import exact, langid, latent, licenses, lm, near, packing, passages, spelling, training_order, urls, warc, whitening
from lacuna.llm.license_sql import scan_sql
from lacuna.llm.store import Store
from lacuna.llm.url_sql import verdict_sql
from lacuna.plans.registry import Query, QueryFunction

QUERIES: dict[str, Query] = {}


def query(sql: str | None = None):
    def register(run: QueryFunction) -> QueryFunction:
        QUERIES[run.__name__] = Query(run, sql)
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document. No SQL: tested by held-out accuracy."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(langid.training_rows(docs.select("doc_id", "text", "lang")))
    held_out = F.coalesce(langid.crc_remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    found = model.predict(docs.select("doc_id", "text"))
    return found.select("doc_id", held_out, "lang_pred", "score", "rejected")


@query(
    r"""
    WITH d AS (
      SELECT doc_id, length(coalesce(text, '')) AS n,
        sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
      FROM documents)
    SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
      count(*) OVER (PARTITION BY text_sha256) AS group_size,
      doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS kept, text_sha256
    FROM d
    """
)
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group and survivor of every document, by an index that starts empty."""
    index, store = exact.new_index(spark)
    return exact.dedup(table(spark, sf_dir, "documents"), index, store)


@query()
def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document. No SQL: an exact join is too slow on whole tables; tested against brute force."""
    return near.near_duplicates(table(spark, sf_dir, "documents"), Store(spark, "near"))


@query()
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items held by documents. No SQL: tested against a brute-force search."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = latent.with_leaks(docs, table(spark, sf_dir, "benchmark"), Store(spark, "leaks"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def word_bpe() -> str:
    """The tokenizer of the contract. Every executor has the same installation."""
    return public_tokenizers.path("word_bpe_49k.json")


@query()
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens. No SQL: tested by an exact round trip."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.pack(docs, word_bpe(), Store(spark, "packing"))
    crc = F.crc32("ids").alias("ids_crc32")
    return pieces.select("doc_id", "start", "length", crc, "doc_tokens", "sequence_id", "offset", "curve_key")


@query()
def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents. No SQL: the base is tested against counts, the model by held-out scores."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(langid.crc_remainder(F.col("doc_id"), 10) == 0, F.lit(False))
    found = lm.score_texts(docs, docs.where(~held_out), Store(spark, "lm"))
    return found.withColumn("held_out", held_out)


URL_RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]


@query(verdict_sql(URL_RULES))
def op3_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES, Store(spark, "urls"))


@query(
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
    d AS (
      SELECT page_id, html, hex, min(page_id) OVER (PARTITION BY hex) AS first,
        list_transform(range(8), lambda i: ('0x' || hex[5 * i + 1:5 * i + 5])::INT) AS groups FROM p)
    SELECT page_id, strlen(html) AS payload_bytes,
      array_to_string(list_transform(groups, lambda g:
        array_to_string(list_transform([15, 10, 5, 0], lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((g >> b) & 31) + 1, 1)), '')), '')
        AS payload_digest,
      CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN page_id <> first THEN first END AS refers_to
    FROM d
    """
)
def op2_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written to archives and read back."""
    store = Store(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), store.path("archives"))
    found = warc.read_archives(spark, store.path("archives"), blocks=False).where("kind = 'record'")
    return found.select(
        warc.page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        warc.page_of(F.col("refers_to")).alias("refers_to"),
    )


@query()
def op5_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sequence's slot and what lies there, read back from the shards. No SQL: tested by a round trip."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    order, layout, folder = training_order.write_shards(docs, word_bpe(), Store(spark, "order"))
    back = training_order.read_shards(spark, folder, layout)
    back = back.select("slot", "shard", "byte_offset", F.crc32("ids").alias("ids_crc32"))
    return back.join(order, "slot")


@query()
def op4_shared_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more in several documents. No SQL: tested against planted and brute-force passages."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return passages.shared_passages(docs, Store(spark, "passages"))


@query()
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of all vectors. No SQL: eigenvectors are beyond it; tested against a dense decomposition."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", Store(spark, "whitening"))


@query()
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms of all words. No SQL: DuckDB has no crc32 and pairs of all words are too slow; tested against brute force."""
    return spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text"), Store(spark, "spelling"))


@query(scan_sql())
def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses named in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.digest(licenses.scan(docs), ["doc_id"])
