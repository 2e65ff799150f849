"""Registered queries of the llm operators, next to their SQL where SQL can express them."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def case(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def crc32_of(column: str):
    return F.crc32(F.col(column).cast("string").cast("binary"))


@case("op5_ngram_jaccard_join")
def op5(spark, folder):
    from .ngram_join import shingle_components
    return shingle_components(table(spark, folder, "documents"), width=3, num=90, den=100)


@case("op1_best_fit_packing")
def op1(spark, folder):
    import public_tokenizers

    from .packing import pack, token_pieces
    pieces = token_pieces(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), size=2048)
    return pack(pieces, size=2048)


def remainder(divisor: int):
    """crc32 of doc_id as text, modulo; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % divisor


@case("op8_lm_scoring")
def op8(spark, folder):
    from .language_model import score_texts
    docs = table(spark, folder, "documents").select("doc_id", "text", (remainder(7) == 2).alias("held_out"))
    return score_texts(docs, ~F.col("held_out"), carry=("held_out",))


@case("op2_language_id")
def op2(spark, folder):
    from . import language_id
    docs = table(spark, folder, "documents").withColumn("held_out", remainder(3) == 1)
    model = language_id.fit(docs.where("not held_out"))
    return language_id.identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


@case("op4_toxicity")
def op4(spark, folder):
    from . import toxicity
    docs = table(spark, folder, "documents").select("doc_id", "text", (remainder(5) == 0).alias("held_out"))
    training = toxicity.labelled_texts(docs.where("not held_out"), table(spark, folder, "labels"))
    return toxicity.score(docs, toxicity.fit(training)).select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@case("op9_exact_topk", """
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
           FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""")
def op9(spark, folder):
    from .topk_search import top_k
    return top_k(table(spark, folder, "embeddings"), k=5, query_divisor=50)


@case("op10_kd_tree_sharding")
def op10(spark, folder):
    from .sharding import kd_shards
    return kd_shards(table(spark, folder, "documents"), 8, ("lang", "source", "n_chars", "doc_id")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@case("op6_secret_scan")
def op6(spark, folder):
    from .secrets import find_secrets, span_text
    found = find_secrets(table(spark, folder, "documents").select("doc_id", "text")).drop("text")
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secret_spans", lambda s: s["kind"] < 3)
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(span_text(base).cast("binary"), 256).alias("base_sha256"), span_text(F.col("secret_spans")).alias("spans"))


@case("op3_decontamination")
def op3(spark, folder):
    from .decontamination import contaminated
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@case("op7_license_scan")
def op7(spark, folder):
    from .licenses import find_licences
    return find_licences(table(spark, folder, "documents"))


@case("op11_lexical_search", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
           FROM documents WHERE text IS NOT NULL),
sized AS (SELECT doc_id, t, len(t) AS n FROM d WHERE len(t) > 0),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM sized),
normed AS (SELECT doc_id, t, 75 + (25 * n * docs) // terms AS m FROM sized, total),
item_terms AS (SELECT item_id, term, count(*) AS times FROM (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE text IS NOT NULL) GROUP BY item_id, term),
postings AS (SELECT doc_id, m, term, count(*) AS tf FROM (SELECT doc_id, m, unnest(t) AS term FROM normed)
             WHERE term IN (SELECT term FROM item_terms) GROUP BY doc_id, m, term),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
            FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), total),
scored AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
           FROM item_terms JOIN weights USING (term) JOIN postings USING (term) GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20""")
def op11(spark, folder):
    from .lexical_search import search
    return search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=20)


@case("op12_spelling_variants")
def op12(spark, folder):
    from .spelling import spelling_forms
    return spelling_forms(table(spark, folder, "documents"))


@case("op13_exact_dedup", """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)""")
def op13(spark, folder):
    from .exact_dedup import duplicates
    return duplicates(table(spark, folder, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
