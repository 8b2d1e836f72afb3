"""Queries of joins, windows, aggregates, set operations and top-k, each with equal SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import vectors
from tidemark.io import table
from tidemark.operators import relations as rel
from tidemark.operators import versions as ver
from tidemark.operators.blocks import numbered, with_previous

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL it must equal."""

    def mark(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return mark


def _t(spark: SparkSession, d: str, n: str) -> DataFrame:
    return table(spark, d, n)


@query("SELECT item_id, id, content_hash, fetched_at FROM item_versions QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY fetched_at DESC, id DESC) = 1")
def latest_version_per_item(spark, d):
    """the latest row of each key, by an aggregation that combines before the shuffle."""
    return rel.latest(_t(spark, d, "item_versions").select("item_id", "fetched_at", "id", "content_hash"), ["item_id"], ["fetched_at", "id"])


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY fetched_at DESC, v.id DESC) AS r FROM event_items e JOIN item_versions v ON v.id = e.item_version_id WHERE relation = 'primary')
SELECT event_id, id AS version_id, metadata.embedding_space AS space FROM l WHERE r = 1 AND metadata.embedding_space = 'radar-a' AND len(embedding_vector) > 0""")
def latest_then_eligible(spark, d):
    """Eligibility is judged after the latest row is chosen, never before."""
    links = _t(spark, d, "event_items").where("relation = 'primary'").select("event_id", F.col("item_version_id").alias("id"))
    v = _t(spark, d, "item_versions").select("id", "fetched_at", F.col("metadata.embedding_space").alias("space"), F.size("embedding_vector").alias("n"))
    got = rel.latest(links.join(v, "id"), ["event_id"], ["fetched_at", "id"])
    return got.where("space = 'radar-a' AND n > 0").select("event_id", F.col("id").alias("version_id"), "space")


@query("""WITH c AS (SELECT item_id, arg_max(id, (fetched_at, id)) AS cur FROM item_versions GROUP BY item_id)
SELECT v.item_id, v.id, CAST(row_number() OVER (PARTITION BY v.item_id ORDER BY CASE WHEN v.id = cur THEN 1 ELSE 0 END, fetched_at DESC, v.id DESC) AS INTEGER) AS previous_rank FROM item_versions v JOIN c USING (item_id)""")
def previous_version_rank(spark, d):
    """versions ranked by age, the current one last; a hot item is cut into blocks of its timeline."""
    v = _t(spark, d, "item_versions").select("item_id", "id", "fetched_at")
    cur = rel.latest(v, ["item_id"], ["fetched_at", "id"]).select("item_id", F.col("id").alias("cur"))
    aged = v.join(cur, "item_id").withColumn("by", F.when(F.col("id") == F.col("cur"), F.lit(1 << 62)).otherwise(F.coalesce(-F.unix_micros(F.col("fetched_at").cast("timestamp")), F.lit(1 << 61))))
    return numbered(aged, ["item_id"], "by", [F.desc("id")], "previous_rank").select("item_id", "id", "previous_rank")


@query("""WITH l AS (SELECT event_id, max_by(id, (revision_no, received_at, id)) AS id FROM event_revisions GROUP BY event_id)
SELECT l.event_id, l.id FROM l WHERE id NOT IN (SELECT id FROM event_revisions WHERE is_material IS FALSE AND id IS NOT NULL)""".replace("max_by(id, (", "arg_max(id, ("))
def unused_revisions_anti(spark, d):
    """Only the latest revision of an event may be chosen, and only where it is not used yet."""
    r = _t(spark, d, "event_revisions").select("event_id", "revision_no", "received_at", "id", "is_material")
    used = r.where("is_material = false").select("id")
    return rel.latest(r.drop("is_material"), ["event_id"], ["revision_no", "received_at", "id"]).select("event_id", "id").join(used, "id", "left_anti").select("event_id", "id")


@query("SELECT id, item_id FROM item_versions v WHERE EXISTS (SELECT 1 FROM event_items e WHERE e.item_version_id = v.id)")
def referenced_versions_semi(spark, d):
    """Existence as a semi join."""
    return _t(spark, d, "item_versions").select("id", "item_id").join(_t(spark, d, "event_items").select(F.col("item_version_id").alias("id")), "id", "left_semi")


@query("SELECT count(*) AS missing FROM collected_items i WHERE NOT EXISTS (SELECT 1 FROM item_versions v WHERE v.item_id = i.record_id)")
def missing_current_invariant(spark, d):
    """M2: items without any version."""
    v = _t(spark, d, "item_versions").select(F.col("item_id").alias("record_id"))
    return _t(spark, d, "collected_items").select("record_id").join(v, "record_id", "left_anti").agg(F.count("*").alias("missing"))


@query("SELECT v.id, v.item_id, v.content_hash FROM item_versions v WHERE NOT EXISTS (SELECT 1 FROM event_items e WHERE e.item_version_id = v.id)")
def pending_items(spark, d):
    """Versions that no event has processed yet."""
    done = _t(spark, d, "event_items").select(F.col("item_version_id").alias("id"))
    return _t(spark, d, "item_versions").select("id", "item_id", "content_hash").join(done, "id", "left_anti")


@query("SELECT record_id, collected_at, title FROM collected_items ORDER BY collected_at DESC, record_id LIMIT 50")
def pending_batch(spark, d):
    """A bounded batch in a total order (the limit is the feature)."""
    return _t(spark, d, "collected_items").select("record_id", "collected_at", "title").orderBy(F.desc("collected_at"), "record_id").limit(50)


@query("""SELECT s.id, s.kind, count(c.record_id) AS items, count(c.title) AS titled, max(c.collected_at) AS last_at,
CASE WHEN NOT s.enabled THEN 'disabled' WHEN count(c.record_id) = 0 THEN 'empty' WHEN count(c.content) * 10 < count(*) * 7 THEN 'degraded' ELSE 'healthy' END AS health
FROM source_specs s LEFT JOIN collected_items c ON c.source_id = s.id GROUP BY s.id, s.kind, s.enabled""")
def source_health_left_join(spark, d):
    """Items are counted before the join, so that a hot source never reaches one task."""
    c = _t(spark, d, "collected_items").groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("n"), F.count("record_id").alias("k"), F.count("title").alias("titled"), F.count("content").alias("full"), F.max("collected_at").alias("last_at"))
    j = _t(spark, d, "source_specs").select("id", "kind", "enabled").join(c, "id", "left")
    zero = lambda n: F.coalesce(n, F.lit(0))
    health = F.when(~F.col("enabled"), "disabled").when(zero("k") == 0, "empty").when(zero("full") * 10 < F.coalesce("n", F.lit(1)) * 7, "degraded").otherwise("healthy")
    return j.select("id", "kind", zero("k").alias("items"), zero("titled").alias("titled"), "last_at", health.alias("health"))


@query("SELECT kind, source_group, CAST(count(*) AS BIGINT) AS sources, CAST(sum(CASE WHEN enabled THEN 1 ELSE 0 END) AS BIGINT) AS enabled_sources FROM source_specs GROUP BY kind, source_group")
def source_config_histogram(spark, d):
    """E20."""
    return _t(spark, d, "source_specs").groupBy("kind", "source_group").agg(F.count("*").alias("sources"), F.count_if("enabled").alias("enabled_sources"))


@query("""SELECT e.event_id, count(DISTINCT i.source_id) AS sources, count(DISTINCT CASE WHEN s.evidence_type = 'media_report' THEN i.source_id END) AS media_sources
FROM event_items e JOIN item_versions v ON v.id = e.item_version_id JOIN collected_items i ON i.record_id = v.item_id JOIN source_specs s ON s.id = i.source_id GROUP BY e.event_id""")
def four_way_media_sources(spark, d):
    """Four tables to the distinct sources behind each event."""
    e = _t(spark, d, "event_items").select("event_id", F.col("item_version_id").alias("id"))
    v = _t(spark, d, "item_versions").select("id", F.col("item_id").alias("record_id"))
    i = _t(spark, d, "collected_items").select("record_id", "source_id")
    s = _t(spark, d, "source_specs").select(F.col("id").alias("source_id"), "evidence_type")
    j = e.join(v, "id").join(i, "record_id").join(s, "source_id")
    return j.groupBy("event_id").agg(F.countDistinct("source_id").alias("sources"), F.countDistinct(F.when(F.col("evidence_type") == "media_report", F.col("source_id"))).alias("media_sources"))


@query("""WITH f AS (SELECT 'event_type' AS facet, coalesce(event_type, '') AS value FROM radar_events UNION ALL SELECT 'status', coalesce(status, '') FROM radar_events
UNION ALL SELECT 'verification_status', coalesce(verification_status, '') FROM radar_events UNION ALL SELECT 'evidence_type', coalesce(evidence_type, '') FROM radar_events
UNION ALL SELECT 'topics', unnest(topics) FROM radar_events UNION ALL SELECT 'entities', unnest(entities) FROM radar_events) SELECT facet, value, count(*) AS n FROM f GROUP BY ALL""")
def facet_counts_all(spark, d):
    """E5: six facets in one pass."""
    return rel.facet_counts(_t(spark, d, "radar_events"), ["event_type", "status", "verification_status", "evidence_type"], ["topics", "entities"])


@query("SELECT e AS entity, count(*) AS events, sum(score)::BIGINT AS score FROM (SELECT DISTINCT event_id, score, unnest(entities) AS e FROM radar_events) GROUP BY e ORDER BY events DESC, e LIMIT 20")
def entity_leaderboard(spark, d):
    """E6 (the limit is the feature)."""
    e = _t(spark, d, "radar_events").select("event_id", "score", F.explode(F.array_distinct("entities")).alias("entity"))
    return e.groupBy("entity").agg(F.count("*").alias("events"), F.sum("score").alias("score")).orderBy(F.desc("events"), "entity").limit(20)


@query("SELECT strftime(first_seen_at, '%Y-%m') AS month, count(*) AS n FROM radar_events GROUP BY 1")
def month_index(spark, d):
    """E8, B8."""
    return _t(spark, d, "radar_events").groupBy(F.date_format("first_seen_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT event_id, entities, cluster_id, score, first_seen_at FROM radar_events),
x AS (SELECT event_id, unnest(list_distinct(entities)) AS l FROM r UNION SELECT event_id, 'cluster ' || cluster_id FROM r WHERE cluster_id IS NOT NULL),
p AS (SELECT DISTINCT a.event_id, b.event_id AS related FROM x a JOIN x b ON a.l = b.l AND a.event_id <> b.event_id)
SELECT p.event_id, related, CAST(row_number() OVER (PARTITION BY p.event_id ORDER BY first_seen_at DESC, score DESC, related) AS INTEGER) AS rank FROM p JOIN r ON r.event_id = related
QUALIFY row_number() OVER (PARTITION BY p.event_id ORDER BY first_seen_at DESC, score DESC, related) <= 4""")
def related_events_top4(spark, d):
    """At most five rows of any link travel, however hot the entity."""
    order = [-F.unix_micros(F.col("first_seen_at").cast("timestamp")), -F.col("score").cast("int"), F.col("event_id")]
    return rel.related(_t(spark, d, "radar_events").select("event_id", "entities", "cluster_id", "first_seen_at", "score"), "event_id", "entities", "cluster_id", order)


@query("""WITH s AS (SELECT DISTINCT item_id AS record_id FROM item_versions), r AS (SELECT DISTINCT record_id FROM collected_items WHERE raw_snapshot IS NOT NULL), p AS (SELECT DISTINCT v.item_id AS record_id FROM item_versions v JOIN event_items e ON e.item_version_id = v.id)
SELECT coalesce(s.record_id, r.record_id) AS record_id, CASE WHEN s.record_id IS NULL THEN 'missing' WHEN p.record_id IS NOT NULL THEN 'protected' WHEN r.record_id IS NULL THEN 'orphan' ELSE 'kept' END AS state
FROM s FULL JOIN r ON s.record_id = r.record_id LEFT JOIN p ON p.record_id = coalesce(s.record_id, r.record_id)""")
def path_reconciliation(spark, d):
    """D14, H1 to H3, M4."""
    v = _t(spark, d, "item_versions").select("id", F.col("item_id").alias("record_id"))
    used = v.join(_t(spark, d, "event_items").select(F.col("item_version_id").alias("id")), "id", "left_semi")
    return rel.reconcile(v, _t(spark, d, "collected_items").where("raw_snapshot is not null"), used, "record_id")


@query("""SELECT a.event_id, CAST(len(list_distinct(list_concat(coalesce(a.topics, []), coalesce(b.topics, [])))) AS INTEGER) AS topics, CAST(len(list_intersect(coalesce(a.entities, []), coalesce(b.entities, []))) AS INTEGER) AS shared, list_has_any(coalesce(a.entities, []), coalesce(b.entities, [])) AS overlaps
FROM radar_events a JOIN radar_events b ON b.event_id = 'ev' || substr(a.cluster_id, 3)""")
def topic_union_entities(spark, d):
    """Each event beside the root of its cluster."""
    e = _t(spark, d, "radar_events").select("event_id", "cluster_id", *[F.coalesce(F.col(c), F.array().cast("array<string>")).alias(c) for c in ("topics", "entities")])
    a = e.select("event_id", F.concat(F.lit("ev"), F.substring("cluster_id", 3, 64)).alias("root"), F.col("topics").alias("ta"), F.col("entities").alias("ea"))
    b = e.select(F.col("event_id").alias("root"), F.col("topics").alias("tb"), F.col("entities").alias("eb"))
    return a.join(b, "root").select("event_id", F.size(F.array_union("ta", "tb")).alias("topics"), F.size(F.array_intersect("ea", "eb")).alias("shared"), F.arrays_overlap("ea", "eb").alias("overlaps"))


@query("""WITH q AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], qe::DOUBLE[]), 6) AS similarity
FROM embeddings, q WHERE vec_id <> 0 ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], qe::DOUBLE[]), 6) DESC, vec_id LIMIT 80""")
def cosine_top80(spark, d):
    """One query vector against all rows (the limit is the feature); the query is one row."""
    e = _t(spark, d, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("qe")).limit(1)
    s = F.round(vectors.cosine(F.col("embedding"), F.col("qe")), 6)
    return e.where("vec_id <> 0").join(F.broadcast(q)).select("vec_id", s.alias("similarity")).orderBy(F.desc("similarity"), "vec_id").limit(80)


@query("""WITH c AS (SELECT label, arg_min(embedding, vec_id) AS ce FROM embeddings GROUP BY label) SELECT vec_id, CASE WHEN s >= 0.92 THEN 'merge' WHEN s >= 0.84 THEN 'review' ELSE 'separate' END AS decision
FROM (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], ce::DOUBLE[]), 6) AS s FROM embeddings JOIN c USING (label))""")
def cluster_decision_bands(spark, d):
    """Every vector against the first of its label."""
    e = _t(spark, d, "embeddings")
    c = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("ce"))
    s = F.round(vectors.cosine(F.col("embedding"), F.col("ce")), 6)
    return e.join(c, "label").select("vec_id", vectors.decision(s, F.lit(False)).alias("decision"))


@query("""WITH c AS (SELECT label, arg_min(embedding, vec_id) AS ce, min(vec_id) AS cv FROM embeddings GROUP BY label), s AS (SELECT label, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], ce::DOUBLE[]), 6) AS similarity FROM embeddings JOIN c USING (label) WHERE vec_id <> cv)
SELECT label, vec_id, similarity, CAST(row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) <= 5""")
def nearest_per_label(spark, d):
    """D8 in blocks, G1 per group: the five nearest to each label's first vector."""
    e = _t(spark, d, "embeddings")
    c = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("ce"), F.min("vec_id").alias("cv"))
    s = e.join(c, "label").where("vec_id <> cv").select("label", "vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("ce")), 6).alias("similarity"))
    return rel.top_per_key(s, ["label"], [F.desc("similarity"), F.col("vec_id")], 5)


_NOW = "(SELECT max(fetched_at) FROM item_versions)"
_RET = f"""WITH n AS (SELECT max(fetched_at) AS now FROM item_versions), cur AS (SELECT item_id, arg_max(id, (fetched_at, id)) AS cv FROM item_versions GROUP BY item_id),
t AS (SELECT v.*, v.id = cv AS is_current, EXISTS (SELECT 1 FROM event_items e WHERE e.item_version_id = v.id) AS is_referenced, now FROM item_versions v JOIN cur USING (item_id), n),
p AS (SELECT item_id, arg_max(id, (fetched_at, id)) AS pv FROM t WHERE NOT is_current GROUP BY item_id),
r AS (SELECT t.*, coalesce(t.id = pv, false) AS is_latest_history, fetched_at >= now - INTERVAL 90 DAYS AS is_recent, date_diff('day', fetched_at::DATE, now::DATE) AS age_days FROM t LEFT JOIN p USING (item_id)),
k AS (SELECT *, NOT (is_current OR is_referenced OR is_latest_history OR is_recent) AS is_candidate FROM r) """


def _retained(spark, d):
    v = _t(spark, d, "item_versions").select("id", "item_id", "fetched_at", "normalized_text", "abstract_text", F.size("embedding_vector").alias("dims"))
    cur = rel.latest(v.select("item_id", "fetched_at", "id"), ["item_id"], ["fetched_at", "id"])
    now = v.agg(F.max("fetched_at").alias("now")).first()["now"]
    return ver.retention(v, cur, _t(spark, d, "event_items").select(F.col("item_version_id").alias("id")), F.lit(now).cast("timestamp_ntz"))


@query(_RET + "SELECT count(*) AS versions, count_if(is_current)::BIGINT AS current_rows, count_if(is_latest_history)::BIGINT AS latest_history, count_if(is_referenced)::BIGINT AS referenced, count_if(is_recent)::BIGINT AS recent, count_if(is_candidate)::BIGINT AS candidates FROM k")
def retention_reasons(spark, d):
    """Overlapping reasons counted in one aggregation."""
    c = {"current_rows": "is_current", "latest_history": "is_latest_history", "referenced": "is_referenced", "recent": "is_recent", "candidates": "is_candidate"}
    return _retained(spark, d).agg(F.count("*").alias("versions"), *[F.count_if(v).alias(k) for k, v in c.items()])


@query(_RET + "SELECT CASE WHEN age_days <= 30 THEN 'within_30' WHEN age_days <= 90 THEN '31_to_90' ELSE 'over_90' END AS bucket, count(*) AS n FROM k GROUP BY 1")
def retention_age_buckets(spark, d):
    """E10."""
    return _retained(spark, d).groupBy(F.when(F.col("age_days") <= 30, "within_30").when(F.col("age_days") <= 90, "31_to_90").otherwise("over_90").alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT CASE n WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'three_or_more' END AS versions, count(*) AS items FROM (SELECT count(*) AS n FROM item_versions GROUP BY item_id) GROUP BY 1")
def version_histogram(spark, d):
    """A count of counts."""
    n = _t(spark, d, "item_versions").groupBy("item_id").agg(F.count("*").alias("n"))
    return n.groupBy(F.when(F.col("n") == 1, "one").when(F.col("n") == 2, "two").otherwise("three_or_more").alias("versions")).agg(F.count("*").alias("items"))


@query(_RET + "SELECT coalesce(sum(octet_length(encode(normalized_text))), 0)::BIGINT AS body_bytes, coalesce(sum(octet_length(encode(abstract_text))), 0)::BIGINT AS abstract_bytes, coalesce(sum(len(embedding_vector) * 4), 0)::BIGINT AS vector_bytes FROM k WHERE is_candidate")
def retention_logical_bytes(spark, d):
    """E11, I47, I54."""
    z = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    r = _retained(spark, d).where("is_candidate")
    return r.agg(z(F.octet_length("normalized_text")).alias("body_bytes"), z(F.octet_length("abstract_text")).alias("abstract_bytes"), z(F.greatest("dims", F.lit(0)) * 4).alias("vector_bytes"))


@query("""SELECT event_id, revision_no, id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY revision_no, received_at, id) AS INTEGER) - 1 AS step FROM event_revisions WHERE is_material QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY revision_no, received_at, id) > 1""")
def timeline_events(spark, d):
    """material revisions after the first, in order."""
    r = numbered(_t(spark, d, "event_revisions").where("is_material").select("event_id", "revision_no", "received_at", "id"), ["event_id"], "revision_no", ["received_at", "id"], "n")
    return r.where("n > 1").select("event_id", "revision_no", "id", (F.col("n") - 1).alias("step"))


@query("""WITH o AS (SELECT event_id, score, unnest(topics) AS topic FROM radar_events), r AS (SELECT *, CASE topic WHEN 'long_horizon' THEN 1 WHEN 'autonomous_agent' THEN 2 WHEN 'self_evolving' THEN 3 WHEN 'mechanistic_interpretability' THEN 4 WHEN 'safety_governance' THEN 5 WHEN 'industrial_capital' THEN 6 END AS o FROM o)
SELECT event_id, arg_min(topic, o) AS section FROM r WHERE o IS NOT NULL GROUP BY event_id""")
def once_per_section(spark, d):
    """each event stands in the first of its sections, by a fixed order."""
    order = ["long_horizon", "autonomous_agent", "self_evolving", "mechanistic_interpretability", "safety_governance", "industrial_capital"]
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("topic"))
    t = _t(spark, d, "radar_events").select("event_id", F.explode("topics").alias("topic")).withColumn("o", place).where("o > 0")
    return t.groupBy("event_id").agg(F.min_by("topic", "o").alias("section"))


@query("""SELECT event_id, score, first_seen_at FROM radar_events WHERE status <> 'MINOR_UPDATE' AND list_contains(topics, 'long_horizon') AND score >= 20 AND verification_status <> 'reported_unconfirmed'
AND first_seen_at >= (SELECT max(first_seen_at) FROM radar_events) - INTERVAL 400 DAYS""")
def filtered_events(spark, d):
    """Conjunctive facets; scalar filters reach the scan, "now" is the newest row."""
    e = _t(spark, d, "radar_events").select("event_id", "score", "first_seen_at", "status", "topics", "verification_status")
    now = e.agg(F.max("first_seen_at").alias("now")).first()["now"]
    f = e.where((F.col("status") != "MINOR_UPDATE") & F.array_contains("topics", "long_horizon") & (F.col("score") >= 20) & (F.col("verification_status") != "reported_unconfirmed"))
    return f.where(F.col("first_seen_at") >= F.lit(now).cast("timestamp_ntz") - F.expr("INTERVAL 400 DAYS")).select("event_id", "score", "first_seen_at")


@query("""WITH h AS (SELECT s.id, s.enabled, max(c.collected_at) AS last_at FROM source_specs s LEFT JOIN collected_items c ON c.source_id = s.id GROUP BY ALL)
SELECT id, CAST(row_number() OVER (ORDER BY CASE WHEN enabled THEN 0 ELSE 1 END, last_at ASC NULLS FIRST, id) AS INTEGER) AS turn FROM h""")
def fair_source_order(spark, d):
    """The source that waited longest comes first; ranked over the small table of sources."""
    from pyspark.sql import Window

    last = _t(spark, d, "collected_items").groupBy(F.col("source_id").alias("id")).agg(F.max("collected_at").alias("last_at"))
    h = _t(spark, d, "source_specs").select("id", "enabled").join(last, "id", "left")
    return h.select("id", F.row_number().over(Window.orderBy(F.when(F.col("enabled"), 0).otherwise(1), F.col("last_at").asc_nulls_first(), "id")).alias("turn"))


@query("""SELECT user_id, CAST(ts::DATE AS VARCHAR) AS day, event_id, CAST(row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS INTEGER) AS rank FROM events QUALIFY row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) <= 3""")
def daily_quota(spark, d):
    """What a quota a day and key lets through, in order."""
    e = _t(spark, d, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id", "ts")
    return rel.quota(e, ["user_id", "day"], [F.col("ts"), F.col("event_id")], 3).select("user_id", "day", "event_id", "rank")


_RANK = "CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 10 WHEN 'signup' THEN 20 WHEN 'purchase' THEN 30 WHEN 'error' THEN 40 ELSE 5 END"


@query(f"SELECT user_id, arg_max(event_type, ({_RANK}, ts, event_id)) AS event_type, count(*) AS n FROM events GROUP BY user_id")
def ranked_state_fold(spark, d):
    """A state moves on only to an equal or higher rank; the fold is an aggregation, hot keys combine first."""
    e = _t(spark, d, "events").select("user_id", "event_type", "ts", "event_id")
    return rel.fold_by_rank(e, "user_id", "event_type", F.expr(_RANK), "ts", "event_id")


@query("SELECT external_id, count(*) AS deliveries, min(record_id) AS first_id FROM collected_items GROUP BY external_id")
def delivery_dedupe(spark, d):
    """Deliveries by provider key; one row survives a key."""
    return _t(spark, d, "collected_items").groupBy("external_id").agg(F.count("*").alias("deliveries"), F.min("record_id").alias("first_id"))


_DIG = "sha256(concat_ws(chr(31), coalesce(title, ''), coalesce(summary, ''), coalesce(content, ''), coalesce(canonical_url, '')))"


@query(f"""WITH d AS (SELECT source_id, external_id, collected_at, record_id, {_DIG} AS digest FROM collected_items), p AS (SELECT *, lag(digest) OVER (PARTITION BY source_id, external_id ORDER BY collected_at, record_id) AS previous FROM d),
n AS (SELECT *, CASE WHEN previous IS NOT DISTINCT FROM digest THEN 0 ELSE 1 END AS c FROM p), s AS (SELECT *, CAST(sum(c) OVER (PARTITION BY source_id, external_id ORDER BY collected_at, record_id) AS INTEGER) AS revision_no FROM n)
SELECT source_id, external_id, collected_at, record_id, digest, previous, revision_no FROM s WHERE c = 1""")
def item_versioning(spark, d):
    """Deliveries replayed into versions by content hash; texts are hashed before the shuffle."""
    e = lambda c: F.coalesce(F.col(c), F.lit(""))
    digest = F.sha2(F.concat_ws("\x1f", e("title"), e("summary"), e("content"), e("canonical_url")), 256)
    return ver.replay(_t(spark, d, "collected_items").select("source_id", "external_id", "collected_at", "record_id", "title", "summary", "content", "canonical_url"), ["source_id", "external_id"], "collected_at", "record_id", digest)


@query("""WITH o AS (SELECT external_id, title, collected_at, record_id, lag(title) OVER (PARTITION BY external_id ORDER BY collected_at, record_id) AS old FROM collected_items)
SELECT record_id, old IS NULL AND title IS NOT NULL AS first_title, CASE WHEN old IS NULL OR title IS NULL THEN false ELSE abs(length(old) - length(title)) / greatest(length(old), length(title), 1) >= 0.08 END AS length_changed FROM o""")
def materiality_lengths(spark, d):
    """The part of the change rule that lengths decide."""
    from tidemark.functions.text import length_changed

    o = with_previous(_t(spark, d, "collected_items").select("external_id", "collected_at", "record_id", "title"), ["external_id"], "collected_at", "record_id", "title", "old")
    return o.select("record_id", (F.col("old").isNull() & F.col("title").isNotNull()).alias("first_title"), F.coalesce(length_changed(F.col("old"), F.col("title")), F.lit(False)).alias("length_changed"))


@query()
def materiality_ratio(spark, d):
    """Successive deliveries whose summary changed in substance, with the first changed stretch."""
    from tidemark.functions.text import first_change, text_changed

    items = _t(spark, d, "collected_items").select("external_id", "collected_at", "record_id", "summary")
    o = with_previous(items, ["external_id"], "collected_at", "record_id", "summary", "old").where("old is not null and summary is not null and old <> summary")
    return o.where(text_changed(F.col("old"), F.col("summary"))).select("record_id", first_change("old", "summary").alias("excerpt"))


@query("""SELECT external_id, arg_min(title, (collected_at, record_id)) FILTER (title IS NOT NULL AND title <> '') AS title, arg_min(summary, (collected_at, record_id)) FILTER (summary IS NOT NULL AND summary <> '') AS summary, arg_min(entity_id, (collected_at, record_id)) FILTER (entity_id IS NOT NULL AND entity_id <> '') AS entity_id FROM collected_items GROUP BY external_id""")
def fill_empty_merge(spark, d):
    """Rows of one identity fill each other's empty fields, the first delivery first."""
    return rel.first_filled(_t(spark, d, "collected_items").select("external_id", "title", "summary", "entity_id", "collected_at", "record_id"), ["external_id"], ["collected_at", "record_id"], ["title", "summary", "entity_id"])


@query("""SELECT external_id, max(CAST(metadata.version AS INTEGER)) AS version FROM collected_items WHERE metadata.version IS NOT NULL GROUP BY external_id""")
def max_version_per_id(spark, d):
    """E17, A1, A3."""
    return _t(spark, d, "collected_items").where("metadata.version is not null").groupBy("external_id").agg(F.max(F.col("metadata.version").cast("int")).alias("version"))


@query("""WITH k AS (SELECT l_orderkey, min(l_linenumber) FILTER (l_returnflag = 'R') AS stop FROM lineitem GROUP BY l_orderkey) SELECT l.l_orderkey, l.l_linenumber, l.l_partkey FROM lineitem l JOIN k USING (l_orderkey) WHERE stop IS NULL OR l_linenumber < stop""")
def stop_at_last_seen(spark, d):
    """A listing is read until the first row that is already known."""
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    return rel.stop_at_known(li, "l_orderkey", "l_linenumber", F.col("l_returnflag") == "R").select("l_orderkey", "l_linenumber", "l_partkey")


@query("""WITH p AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS p, count(*) OVER () - 8 AS n FROM source_specs) SELECT id FROM p WHERE p < 8 OR ((p - 8 - 20) % n + n) % n < 10""")
def rotating_selection(spark, d):
    """The freshest rows and a window that moves on over the rest."""
    return rel.rotate(_t(spark, d, "source_specs").select("id"), [F.col("id")], 8, 10, 20)


@query("""WITH c AS (SELECT doc_id, median(reading_level) AS m FROM reading_labels WHERE reading_level IS NOT NULL GROUP BY doc_id), x AS (SELECT CAST(l.reading_level AS VARCHAR) AS expected, CAST(CAST(floor(m) AS INTEGER) AS VARCHAR) AS predicted FROM reading_labels l JOIN c USING (doc_id) WHERE l.reading_level IS NOT NULL)
SELECT expected, predicted, count(*) AS n FROM x GROUP BY ALL""")
def confusion_matrix(spark, d):
    """Each label against the median label of its document."""
    lab = _t(spark, d, "reading_labels").where("reading_level is not null")
    c = lab.groupBy("doc_id").agg(F.median("reading_level").alias("m"))
    return lab.join(c, "doc_id").groupBy(F.col("reading_level").cast("string").alias("expected"), F.floor("m").cast("string").alias("predicted")).agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT doc_id, median(reading_level) AS m FROM reading_labels WHERE reading_level IS NOT NULL GROUP BY doc_id), x AS (SELECT reviewer, reading_level AS l, CAST(floor(m) AS INTEGER) AS p FROM reading_labels JOIN c USING (doc_id) WHERE reading_level IS NOT NULL)
SELECT reviewer, count(*) AS samples, count_if(l = p)::BIGINT AS correct, round(count_if(l = p) / count(*), 6) AS label_precision, count(*) >= 20 AND count_if(l = p) / count(*) >= 0.85 AS passed FROM x GROUP BY reviewer""")
def label_precision(spark, d):
    """Precision with a sample floor that fails closed."""
    lab = _t(spark, d, "reading_labels").where("reading_level is not null")
    c = lab.groupBy("doc_id").agg(F.floor(F.median("reading_level")).alias("p"))
    g = lab.join(c, "doc_id").groupBy("reviewer").agg(F.count("*").alias("samples"), F.count_if(F.col("reading_level") == F.col("p")).alias("correct"))
    share = F.col("correct") / F.col("samples")
    return g.select("reviewer", "samples", "correct", F.round(share, 6).alias("label_precision"), ((F.col("samples") >= 20) & (share >= 0.85)).alias("passed"))


_OLD, _NEW = "o_orderdate < DATE '1995-06-01'", "o_orderdate >= DATE '1995-06-01'"


@query(f"""WITH x AS (SELECT o_custkey, o_orderkey, o_orderstatus, 0 AS n, o_orderdate FROM orders WHERE {_OLD} UNION ALL SELECT o_custkey, o_orderkey, o_orderstatus, 1, o_orderdate FROM orders WHERE {_NEW})
SELECT o_custkey, arg_max(o_orderkey, (n, o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_orderstatus, (n, o_orderdate, o_orderkey)) AS o_orderstatus FROM x GROUP BY o_custkey""")
def keyed_upsert(spark, d):
    """A table's rows by key after a batch."""
    from tidemark.operators.state import upsert

    o = _t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    got = upsert(o.where(_OLD), o.where(_NEW), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return got.select("o_custkey", "o_orderkey", "o_orderstatus")


@query(f"SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE {_NEW} AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE {_OLD}) GROUP BY o_custkey")
def insert_or_ignore(spark, d):
    """L2: only new keys come in."""
    from tidemark.operators.state import insert_or_ignore as f

    o = _t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return f(o.where(_OLD), o.where(_NEW).drop("o_orderdate"), ["o_custkey"], ["o_orderkey"])


@query("""WITH k AS (SELECT user_id, max((ts, event_id)) FILTER (event_type <> 'error') AS ok FROM events GROUP BY user_id)
SELECT e.user_id, (count(*) FILTER (event_type = 'error' AND (ok IS NULL OR (ts, event_id) > ok)))::BIGINT AS failures, max(ts) FILTER (event_type <> 'error') AS last_success FROM events e JOIN k USING (user_id) GROUP BY e.user_id""")
def failure_streaks(spark, d):
    """Failures since the last success of every key."""
    from tidemark.operators.state import failure_streaks as f

    return f(_t(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id", F.col("event_type") == "error")
