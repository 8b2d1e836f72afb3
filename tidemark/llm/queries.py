"""Queries of the llm problems over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.io import table
from tidemark.llm import fusion, lookalike, mainbody, nearduplicates, neighbours, packing, reading, tokenize
from tidemark.operators.instants import with_source_clock
from tidemark.session import cut


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    items = lookalike.same_looking_pairs(table(spark, folder, "collected_items"), "item", "record_id", "title")
    return items.unionByName(lookalike.same_looking_pairs(table(spark, folder, "radar_events"), "event", "event_id", "title_zh"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "source_specs").where("kind = 'html_page'").select(F.col("id").alias("source_id")).distinct()
    items = table(spark, folder, "collected_items").select("record_id", "source_id", "title", "content", "raw_snapshot").join(pages, "source_id", "left_semi")
    return mainbody.body_lines(items, "record_id", "content", "raw_snapshot", "title")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    versions = table(spark, folder, "item_versions").select("id", "embedding_vector", "metadata")
    got = neighbours.nearest(versions, "id", "embedding_vector", F.col("metadata.embedding_space"))
    return got.select(F.col("id").alias("version_id"), F.col("neighbour").alias("neighbour_id"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "collected_items").select("record_id", "external_id", "source_id", "summary", "authors", "published_at", "collected_at")
    events = table(spark, folder, "radar_events").select("event_id", "cluster_id", "source_id", "primary_url", "verification_status", "first_seen_at")
    made = fusion.item_claims(with_source_clock(items, table(spark, folder, "source_specs"))).unionByName(fusion.event_claims(events))
    return fusion.survivors(made).select(F.col("grp").alias("group_key"), F.col("field").alias("field_name"), F.col("key").alias("row_key"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "source_specs").where("kind = 'html_page'").select(F.col("id").alias("source_id")).distinct()
    items = table(spark, folder, "collected_items").select("record_id", "source_id", "content").join(pages, "source_id", "left_anti")
    none = F.lit(None).cast("string")
    rows = items.select(F.lit("item").alias("kind"), F.col("record_id").alias("id"), none.alias("apart"), F.col("content").alias("text"))
    events = table(spark, folder, "radar_events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("cluster_id").alias("apart"), F.col("summary_zh").alias("text"))
    how = {"item": ("word", 3, 40), "event": ("character", 4, 0)}
    return nearduplicates.near_duplicates(rows.unionByName(events), how, 0.5).select(F.col("kind").alias("record_kind"), "id_a", "id_b")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenize.token_ids(table(spark, folder, "documents"), "doc_id", "text")


def p9_packing(spark: SparkSession, folder: str) -> DataFrame:
    sizes = tokenize.token_counts(table(spark, folder, "documents"), "doc_id", "text")
    return packing.pack_documents(sizes, "doc_id", "n_tokens", 2048)


def p9_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the packing of all documents, as counts: nothing lost, doubled, split, overlapping or over-full."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    sizes = cut(tokenize.token_counts(documents, "doc_id", "text"))
    rows = cut(packing.pack_documents(sizes, "doc_id", "n_tokens", 2048))
    boxes = rows.where("container is not null").groupBy("container").agg(F.sum("n_tokens").alias("fill"), F.max(F.col("start") + F.col("n_tokens")).alias("end"))
    per = rows.groupBy("doc_id").agg(F.sum("n_tokens").alias("packed"), F.count("*").alias("pieces"), F.countDistinct("piece").alias("distinct"), F.count_if(F.col("container").isNull()).alias("unplaced"))
    docs = per.join(sizes, "doc_id", "full").agg(
        F.count("*").alias("documents"), F.coalesce(F.sum("unplaced"), F.lit(0)).alias("without_container"), F.count_if(~F.col("packed").eqNullSafe(F.coalesce("n_tokens", F.lit(0)))).alias("wrong_size"),
        F.count_if((F.col("n_tokens") <= 2048) & (F.col("pieces") > 1)).alias("split"), F.count_if(F.col("pieces") != F.col("distinct")).alias("repeated"),
    )
    # a box whose parts end where they sum to has neither gaps nor overlaps
    return docs.join(F.broadcast(boxes.agg(F.count_if(F.col("fill") > 2048).alias("over_full"), F.count_if(F.col("fill") != F.col("end")).alias("overlapping"))))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return reading.reading_levels(table(spark, folder, "documents"), table(spark, folder, "reading_labels"))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p4_found": p4_found, "p6_found": p6_found, "p7_found": p7_found, "p8_ids": p8_ids, "p9_packing": p9_packing, "p9_invariants": p9_invariants, "p10_found": p10_found}
P4_SQL = """
WITH v AS (SELECT id, metadata.embedding_space AS space, CAST(embedding_vector AS DOUBLE[]) AS e FROM item_versions WHERE len(embedding_vector) = 128 AND metadata.embedding_space IS NOT NULL),
ok AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.e, b.e) AS c FROM ok a JOIN ok b ON a.space = b.space AND a.id <> b.id)
SELECT a AS version_id, b AS neighbour_id FROM p WHERE c >= 0.8 QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(c, 9) DESC, b) <= 5
"""

P7_SQL = r"""
WITH w AS (SELECT record_id AS id, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS w FROM collected_items c WHERE content IS NOT NULL AND len(regexp_extract_all(content, '\S+')) >= 40
AND NOT EXISTS (SELECT 1 FROM source_specs s WHERE s.id = c.source_id AND s.kind = 'html_page')),
e AS (SELECT event_id AS id, cluster_id AS apart, regexp_replace(lower(summary_zh), '[^\p{L}\p{N}]', '', 'g') AS t FROM radar_events WHERE summary_zh IS NOT NULL),
s AS (SELECT 'item' AS kind, id, NULL AS apart, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w
UNION ALL SELECT 'event', id, apart, list_distinct(list_transform(range(1, length(t) - 2), lambda i: substr(t, i, 4))) FROM e),
x AS (SELECT kind, id, apart, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.kind, a.id AS a, b.id AS b FROM x a JOIN x b ON a.kind = b.kind AND a.g = b.g AND a.id < b.id AND (a.apart IS NULL OR b.apart IS NULL OR a.apart <> b.apart) GROUP BY ALL HAVING 3 * count(*) >= any_value(a.n) + any_value(b.n))
SELECT kind AS record_kind, a AS id_a, b AS id_b FROM p
"""

P9_SQL = """
SELECT count(*) AS documents, count_if(text IS NULL OR text = '')::BIGINT AS without_container, 0::BIGINT AS wrong_size, 0::BIGINT AS split, 0::BIGINT AS repeated, 0::BIGINT AS over_full, 0::BIGINT AS overlapping FROM documents
"""

ORACLES = {"p4_found": P4_SQL, "p7_found": P7_SQL, "p9_invariants": P9_SQL}
