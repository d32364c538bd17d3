"""Registered queries of the subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from catalog.session import ship
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerstack.llm import (
    bpe,
    conversation_repair,
    curriculum,
    fingerprints,
    hash_ring,
    hilbert_ann,
    html_text,
    lattice_lm,
    ngram_join,
    pii,
    quality,
    spelling_variants,
    sql,
    substring_dedup,
)

#: The key of the registered queries' surrogates; a user passes a secret one.
KEY = "registered queries"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Add a query, and its SQL where there is one."""

    def add(query):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return query(spark, sf_dir)

        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return query

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("op1_bpe")
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document by the public 50k byte-level vocabulary."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.digests(docs, vocabulary).drop("text")


@register("op3_fingerprints")
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its text half replaced by the next one's."""
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


@register("op6_lattice_lm")
def op6_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of every document by a model of six of seven folds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = lattice_lm.fold(F.col("doc_id"), 7) == 2
    model = lattice_lm.fit(docs.where(~held_out), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return lattice_lm.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score",
        "score",
    )


@register("op7_ngram_join")
def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingle sets are similar to at least 0.8."""
    return ngram_join.join_components(table(spark, sf_dir, "documents"))


@register("op8_substring_dedup")
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that 13-word windows of earlier documents cover, removed."""
    spans = substring_dedup.duplicate_spans(table(spark, sf_dir, "documents"))
    return spans.select("doc_id", "n_words", "n_removed", "kept_sha256")


def _mix_sql() -> str:
    """The mix of `curriculum.mix`: lines, water level and positions, by plain window sums."""
    weights, tilts = curriculum.WEIGHTS, curriculum.TILTS
    pick = lambda v: "CASE turn % 3 " + " ".join(
        f"WHEN {i} THEN {x}::DOUBLE" for i, x in enumerate(v)
    ) + " END"
    return f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    md5(concat_ws('|', coalesce(doc_id::VARCHAR, ''), coalesce(md5(text), ''))) AS key
  FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size,
    row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM d GROUP BY source),
w AS (SELECT *, {pick(weights)} AS weight, {pick(tilts)} AS tilt, {curriculum.MOST_REPEATS} * source_size::DOUBLE AS cap FROM t),
r AS (SELECT *, cap / weight AS fills_at,
    coalesce(sum(cap) OVER b, 0) AS full_, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS open_,
    sum(source_size) OVER ()::DOUBLE AS total
  FROM w WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - full_) / open_ AS level FROM r),
g AS (SELECT *, least(cap, weight * (SELECT level FROM l WHERE level <= fills_at ORDER BY fills_at, turn LIMIT 1)) AS target FROM l),
p AS (SELECT d.doc_id, d.size, g.source_size, g.target, g.tilt, g.total, round(g.target)::BIGINT AS wanted,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS line_start
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
q AS (SELECT *, wanted // greatest(source_size, 1) AS whole FROM p),
m AS (SELECT *, least(greatest(wanted - whole * source_size - line_start, 0), size) AS more FROM q),
c AS (SELECT *, (whole * size + more)::BIGINT AS taken,
    CASE WHEN size = 0 THEN 0 ELSE whole + (more > 0)::INT END::INT AS copies, line_start / target AS y FROM m)
SELECT doc_id, size, source_size, round(target, 3) AS target, taken, line_start, copies, tilt,
  round(CASE WHEN copies > 0 THEN total * least(1.0, CASE WHEN y <= 0 THEN 0.0
    ELSE 2 * y / ((1 - tilt) + sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * y)) END) END, 3) AS position
FROM c"""


@register("op9_curriculum", _mix_sql())
def op9_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents by source, in order of training position."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return curriculum.mix(docs).select(
        "doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken",
        "line_start", "copies", "tilt", F.round("position", 3).alias("position"),
    )


@register("op10_quality")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learnt from four of five folds of the labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(quality.fold(F.col("doc_id"), 5) != 0)
    model = quality.fit(docs, labels)
    return quality.score(docs, model).select(
        "doc_id", (quality.fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted"
    )


@register("op4_pii")
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of all documents with surrogates for personal data."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace(docs, KEY).select("doc_id", "n_entities", "text")


@register("op5_hilbert_ann")
def op5_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth one, by shifted Hilbert orderings."""
    vectors = table(spark, sf_dir, "embeddings")
    return hilbert_ann.nearest(vectors, lambda i: i % 100 == 0)


@register("op2_html_text")
def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    text = html_text.extract(pages, keep=["page_id", "url"])
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@register("op11_conversation_repair", sql.conversation_repair())
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repairs of all conversations after damage, also of those that lost all rows."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    repairs = conversation_repair.repair(conversation_repair.damaged(rows))
    return conversation_repair.with_lost(rows, repairs)


@register("op12_hash_ring")
def op12_hash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of a hash ring whose row counts are bounded by the fair share."""
    out = hash_ring.assign(table(spark, sf_dir, "documents"), shards=40, load="rows")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@register("op13_spelling_variants", sql.spelling_variants())
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Common forms of all words of at least 5 letters and 3 occurrences, some of which lost a letter."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling_variants.group_variants(spelling_variants.count_words(docs, spoil=97))


@register("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of the documents that pass all stages of the pipeline."""
    return corpus_pipeline.run(spark, sf_dir)
