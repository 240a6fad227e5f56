"""The registered queries of this folder: one per operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import public_tokenizers

from granary.llm import balltree, blocks, bpe, edits, eliasfano, jaccard, licences, mtree, negatives, ordinal, suffixes, toxicity, warc
from granary.llm.common import table
from granary.session import provide_folder, ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            provide_folder(spark)
            ship(spark)
            return fn(spark, folder)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


@query(
    "op1_mtree_top_k",
    """
    WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
               FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id,
                 CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = mtree.integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return mtree.top_k(vectors, F.col("id") % 50 == 0, k=5)


@query("op3_elias_fano_ids")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = eliasfano.write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return eliasfano.read_shards(manifest)


@query("op10_bpe_rank_queue")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)


@query(
    "op7_warc_normaliser",
    """
    WITH d AS (SELECT page_id, url, encode(coalesce(html, '')) AS p FROM pages),
    h AS (SELECT page_id, url, octet_length(p) AS n, sha1(p) AS hex, sha256(p) AS key FROM d),
    b AS (SELECT *, list_transform(range(0, 32), lambda i: (
            (CAST('0x' || substr(hex, CAST(i * 5 // 4 AS INTEGER) + 1, 1) AS INTEGER) * 16
             + CAST('0x' || coalesce(nullif(substr(hex, CAST(i * 5 // 4 AS INTEGER) + 2, 1), ''), '0') AS INTEGER))
            >> CAST(3 - (i * 5) % 4 AS INTEGER)) & 31) AS digits, max(page_id) OVER (PARTITION BY key) AS top FROM h)
    SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
           list_aggregate(list_transform(digits, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(x AS INTEGER) + 1, 1)), 'string_agg', '') AS payload_digest,
           CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to, url
    FROM b
    """,
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(warc.with_originals(table(spark, sf_dir, "pages")))
    normalised = warc.normalise(archives)
    warc.drop_archives(archives)
    return warc.read_archives(normalised)


@query("op9_block_rules")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.extract(table(spark, sf_dir, "pages"))


@query("op8_edit_matches")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_ordinal_quality")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ordinal.score(docs, ordinal.train(docs, table(spark, sf_dir, "labels")))


@query("op5_weak_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query("op6_rare_licence_words")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


@query("op4_jaccard_regions")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"), size=3, num=90, den=100, count_links=True)


@query(
    "op11_ball_tree_search",
    r"""
    WITH d AS (SELECT row_number() OVER () AS no, doc_id,
                      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
    t AS (SELECT no, doc_id, len(terms) AS n, unnest(terms) AS term FROM d),
    f AS (SELECT no, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM t GROUP BY no, term),
    g AS (SELECT term, count(*) AS df FROM f GROUP BY term),
    c AS (SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM d WHERE len(terms) > 0),
    q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
    s AS (SELECT q.item_id, f.no, any_value(f.doc_id) AS doc_id,
                 CAST(sum(CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT)
                          * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
          FROM q JOIN f USING (term) JOIN g USING (term) CROSS JOIN c GROUP BY q.item_id, f.no),
    r AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_two_stage_suffixes")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.without_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda t, x: t + x)
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query(
    "op13_packed_negatives",
    """
    WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                      list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
               FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
                 CAST(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * c.e[i])) AS BIGINT) AS score
          FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
    p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS nth FROM s WHERE same),
    n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
                 CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
          FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
          WHERE p.nth <= 5)
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = negatives.labelled_vectors(table(spark, sf_dir, "embeddings"), "vec_id", moved, "embedding")
    return negatives.hard_negatives(vectors, F.col("id") % 50 == 0)


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = _pipeline
