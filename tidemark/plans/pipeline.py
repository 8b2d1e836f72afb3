"""Queries of the item and event pipeline: identity, versions, ledger, selection, filters, rollups, export, each with equal SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import identity as ident
from tidemark.functions import jsons, rules
from tidemark.functions import text as txt
from tidemark.io import table
from tidemark.operators import events as ev
from tidemark.operators import relations as rel
from tidemark.operators import versions as ver
from tidemark.operators.blocks import with_previous
from tidemark.streaming import jobs

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


_CUT = "TIMESTAMP '2025-06-01 00:00:00'"
_MATERIAL = ", ".join(repr(x) for x in ev.MATERIAL)


@query(f"""WITH r AS (SELECT * FROM event_revisions WHERE event_id IS NOT NULL), cur AS (SELECT * FROM r WHERE created_at < {_CUT}), b AS (SELECT event_id, content_hash, min((created_at, revision_no, id)) AS o, arg_max(status, (created_at, revision_no, id)) AS status FROM r WHERE created_at >= {_CUT} AND content_hash IS NOT NULL GROUP BY ALL),
h AS (SELECT event_id, content_hash, min(revision_no) AS known FROM cur WHERE content_hash IS NOT NULL GROUP BY ALL), l AS (SELECT event_id, max(revision_no) AS last FROM cur GROUP BY ALL), j AS (SELECT b.*, known, coalesce(last, 0) AS last FROM b LEFT JOIN h USING (event_id, content_hash) LEFT JOIN l USING (event_id))
SELECT event_id, content_hash, CAST(coalesce(known, last + row_number() OVER (PARTITION BY event_id, known IS NULL ORDER BY o, content_hash)) AS INTEGER) AS revision_no, status, status IN ({_MATERIAL}) AS is_material FROM j""")
def revision_ledger(spark, d):
    """What a later batch adds to or renews in the revisions so far."""
    r = table(spark, d, "event_revisions").select("event_id", "content_hash", "revision_no", "status", "created_at", "id")
    cut = F.expr(f"{_CUT}").cast("timestamp_ntz")
    return ev.ledger(r.where(F.col("created_at") < cut), r.where(F.col("created_at") >= cut), "event_id", "content_hash", ["created_at", "revision_no", "id"])


_USED = "SELECT id AS revision_id, CASE WHEN revision_no % 2 = 0 THEN 'digest' ELSE 'alert' END AS kind, strftime(received_at, '%Y-%m') AS delivery_key FROM event_revisions WHERE id IS NOT NULL AND received_at < TIMESTAMP '2025-09-01 00:00:00'"


@query(f"""WITH u AS ({_USED}), l AS (SELECT event_id, arg_max(revision_no, (revision_no, created_at, id)) AS revision_no, arg_max(id, (revision_no, created_at, id)) AS id, arg_max(status, (revision_no, created_at, id)) AS status FROM event_revisions WHERE created_at <= {_CUT} GROUP BY event_id)
SELECT event_id, revision_no, id FROM l WHERE status IN ({_MATERIAL}) AND NOT EXISTS (SELECT 1 FROM u WHERE u.revision_id = l.id AND kind = 'digest' AND delivery_key <> '2024-05')""")
def digest_selection(spark, d):
    """The latest revision of each event that its kind of delivery has not used; months of receipt stand for deliveries."""
    r = table(spark, d, "event_revisions").select("event_id", "revision_no", "id", "status", "created_at", "received_at")
    used = r.where("id is not null and received_at < timestamp_ntz '2025-09-01 00:00:00'").select(F.col("id").alias("revision_id"), F.when(F.col("revision_no") % 2 == 0, "digest").otherwise("alert").alias("kind"), F.date_format("received_at", "yyyy-MM").alias("delivery_key"))
    return ev.select_unused(r.drop("received_at"), used, "digest", "2024-05", F.expr(_CUT).cast("timestamp_ntz"))


@query()
def item_identity(spark, d):
    """Deliveries of one source under an equal id or address are one item."""
    c = table(spark, d, "collected_items").select("record_id", "source_id", "external_id", ident.canonical_url(F.col("canonical_url")).alias("url"))
    return ev.same_items(c, "source_id", "external_id", "url", "record_id")


@query()
def item_ingest(spark, d):
    """Deliveries of each item in order, as versions with their kind of change, by the hash of texts, address and revision keys."""
    c = table(spark, d, "collected_items").select("record_id", "source_id", "external_id", "canonical_url", "title", "summary", "content", "metadata", "published_at", "collected_at")
    keys = {"version": "metadata.version", "tag_name": "metadata.tag_name", "sha": "metadata.sha", "code_url": "metadata.code_url"}
    digest = ident.record_hash(F.col("title"), F.col("summary"), F.col("content"), F.col("canonical_url"), lambda k: F.col(keys[k]) if k in keys else F.lit(None).cast("string"))
    slim = c.select("source_id", "external_id", "collected_at", "record_id", digest.alias("digest"))
    v = ver.replay(slim, ["source_id", "external_id"], "collected_at", "record_id", F.col("digest"))
    version = F.concat_ws(":", F.coalesce("metadata.version", "metadata.tag_name", F.lit("content")), F.substring("digest", 1, 16))
    item = ident.stable_id(F.col("source_id"), F.col("external_id"))
    return v.join(c.select("record_id", "metadata"), "record_id").select("record_id", item.alias("item"), "digest", version.alias("version_key"), "revision_no", F.col("previous").isNull().alias("is_first"))


@query()
def change_descriptions(spark, d):
    """What changed between successive deliveries of an external id, in up to four phrases."""
    c = table(spark, d, "collected_items").select("external_id", "collected_at", "record_id", F.struct("title", "summary", "content", "metadata", "evidence_type").alias("x"))
    o = with_previous(c.where("external_id is not null"), ["external_id"], "collected_at", "record_id", "x", "old").where("old is not null")
    meta = lambda side: lambda k: F.col(f"{side}.metadata.{k}") if k in ("version", "tag_name", "sha", "code_url") else F.lit(None).cast("string")
    e = lambda c: F.coalesce(c, F.lit(""))
    side = lambda s: {"title": e(F.col(f"{s}.title")), "summary": e(F.col(f"{s}.summary")), "body": F.coalesce(F.nullif(f"{s}.content", F.lit("")), e(F.col(f"{s}.summary")))}
    return o.select("record_id", txt.change_phrases(side("old"), side("x"), meta("old"), meta("x"), F.lit(False)).alias("changes"))


_M = f"(SELECT e.*, m.material_updated_at FROM radar_events e LEFT JOIN (SELECT event_id, max(created_at) AS material_updated_at FROM event_revisions WHERE is_material AND status = 'MATERIAL_UPDATE' GROUP BY event_id) m USING (event_id))"


def _events(spark, d):
    """Events with the time of their last material revision."""
    r = table(spark, d, "event_revisions").where("is_material and status = 'MATERIAL_UPDATE'").groupBy("event_id").agg(F.max("created_at").alias("material_updated_at"))
    return table(spark, d, "radar_events").join(r, "event_id", "left")


def _now(events, column):
    return F.lit(events.agg(F.max(column)).first()[0]).cast("timestamp_ntz")


@query(f"SELECT event_id FROM {_M} WHERE greatest(first_seen_at, coalesce(material_updated_at, first_seen_at)) >= (SELECT max(first_seen_at) FROM radar_events) - INTERVAL 30 DAYS")
def export_window(spark, d):
    """Events seen or materially updated within thirty days."""
    e = _events(spark, d).select("event_id", "first_seen_at", "material_updated_at")
    now = _now(table(spark, d, "radar_events"), "first_seen_at")
    return e.where(F.greatest("first_seen_at", F.coalesce("material_updated_at", "first_seen_at")) >= now - F.expr("INTERVAL 30 DAYS")).select("event_id")


_T = "CASE WHEN status = 'MATERIAL_UPDATE' THEN coalesce(material_updated_at, first_seen_at) ELSE first_seen_at END"


@query(f"""SELECT event_id, score, CAST(row_number() OVER (ORDER BY {_T} DESC NULLS LAST, score DESC, event_id) AS INTEGER) AS place FROM {_M} WHERE list_contains(topics, 'long_horizon') AND verification_status = 'corroborated' AND score >= 10
AND {_T} >= (SELECT max(first_seen_at) FROM radar_events) - INTERVAL 3000 DAYS QUALIFY place <= 200""")
def facet_filters(spark, d):
    """C13, C14, G11 (the limit is the feature): conjunctive optional filters, the range by the time an event counts, the head of the list in its order."""
    from pyspark.sql import Window

    f = {"topic": "long_horizon", "entity": None, "verification_status": "corroborated", "evidence_type": None, "status": None, "event_type": None, "source_id": None, "min_score": 10}
    e = ev.filter_events(_events(spark, d), f, _now(table(spark, d, "radar_events"), "first_seen_at"), 3000)
    order = [F.desc_nulls_last("at"), F.desc("score"), F.col("event_id")]
    head = e.select("event_id", "score", ev.event_time(e).alias("at")).orderBy(*order).limit(200)
    return head.select("event_id", "score", F.row_number().over(Window.orderBy(*order)).alias("place"))


@query("SELECT event_id, score FROM radar_events WHERE score IS NOT NULL ORDER BY first_seen_at DESC NULLS LAST, score DESC, event_id LIMIT 100")
def export_order(spark, d):
    """G8 (the limit is the feature): newest first, then by score."""
    e = table(spark, d, "radar_events").where("score is not null").select("event_id", "score", "first_seen_at")
    return e.orderBy(F.desc_nulls_last("first_seen_at"), F.desc("score"), "event_id").limit(100).select("event_id", "score")


@query("""WITH v AS (SELECT item_id, arg_max(id, (fetched_at, id)) AS id FROM item_versions GROUP BY item_id) SELECT i.id, i.item_id FROM item_versions i JOIN v ON v.id = i.id WHERE coalesce(len(i.embedding_vector), 0) <> 128 ORDER BY i.fetched_at, i.id LIMIT 50""")
def pending_embeddings(spark, d):
    """C3, D2, G3 (the limit is the feature): current versions without a usable vector, the oldest first."""
    v = table(spark, d, "item_versions").select("item_id", "id", "fetched_at", F.coalesce(F.array_size("embedding_vector"), F.lit(0)).alias("n"))
    return rel.latest(v, ["item_id"], ["fetched_at", "id"]).where("n <> 128").orderBy("fetched_at", "id").limit(50).select("id", "item_id")


@query("""WITH t AS (SELECT event_id, score, first_seen_at FROM radar_events WHERE status <> 'MINOR_UPDATE' AND score IS NOT NULL ORDER BY score DESC, first_seen_at DESC, event_id LIMIT 60) SELECT event_id, score, CAST(row_number() OVER (ORDER BY score DESC, first_seen_at DESC, event_id) AS INTEGER) AS attempt FROM t QUALIFY attempt <= 20""")
def editorial_top(spark, d):
    """G4, G6, G7 (the limits are the feature): three times the wanted rows are read, attempts are capped."""
    from pyspark.sql import Window

    order = [F.desc("score"), F.desc("first_seen_at"), F.col("event_id")]
    t = table(spark, d, "radar_events").where("status <> 'MINOR_UPDATE' and score is not null").select("event_id", "score", "first_seen_at").orderBy(*order).limit(60)
    return t.withColumn("attempt", F.row_number().over(Window.orderBy(*order))).where("attempt <= 20").select("event_id", "score", "attempt")


@query("SELECT event_id, score FROM radar_events WHERE event_type = 'PAPER' AND score IS NOT NULL AND first_seen_at >= (SELECT max(first_seen_at) FROM radar_events WHERE event_type = 'PAPER') - INTERVAL 36 HOURS ORDER BY score DESC, first_seen_at DESC, event_id LIMIT 100")
def deep_read_top(spark, d):
    """G5 (the limit is the feature): papers of the last 36 hours by score."""
    e = table(spark, d, "radar_events").where("event_type = 'PAPER'").select("event_id", "score", "first_seen_at")
    now = _now(e, "first_seen_at")
    return e.where(F.col("score").isNotNull() & (F.col("first_seen_at") >= now - F.expr("INTERVAL 36 HOURS"))).orderBy(F.desc("score"), F.desc("first_seen_at"), "event_id").limit(100).select("event_id", "score")


@query("SELECT section, n FROM (" + " UNION ALL ".join(f"SELECT '{s}' AS section, (count(*) FILTER (list_has_any(topics, {list(ts)!r})))::BIGINT AS n FROM radar_events" for s, ts in ev.SECTIONS) + ")")
def section_counts(spark, d):
    """C15, E7."""
    return ev.section_counts(table(spark, d, "radar_events"), "topics")


_HEALTH = "(SELECT s.id, CASE WHEN NOT s.enabled THEN 'disabled' WHEN count(c.record_id) = 0 THEN 'failing' WHEN count(c.content) * 10 < count(*) * 8 THEN 'degraded' ELSE 'healthy' END AS status, max(c.collected_at) AS last_at FROM source_specs s LEFT JOIN collected_items c ON c.source_id = s.id GROUP BY s.id, s.enabled)"


@query(f"SELECT (count(*) FILTER (status = 'healthy'))::BIGINT AS healthy, (count(*) FILTER (status NOT IN ('healthy', 'disabled')))::BIGINT AS attention, max(last_at) AS last_success, (SELECT coalesce(string_agg(id || ': ' || status, ' | ' ORDER BY id), '') FROM (SELECT id, status FROM {_HEALTH} WHERE status NOT IN ('healthy', 'disabled') ORDER BY id LIMIT 10)) AS notices FROM {_HEALTH}")
def health_rollup(spark, d):
    """Counts, the newest success and the first ten notices."""
    c = table(spark, d, "collected_items").groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("n"), F.count("content").alias("full"), F.max("collected_at").alias("last_at"))
    j = table(spark, d, "source_specs").select("id", "enabled").join(c, "id", "left")
    status = F.when(~F.col("enabled"), "disabled").when(F.col("n").isNull(), "failing").when(F.col("full") * 10 < F.col("n") * 8, "degraded").otherwise("healthy")
    return ev.health_rollup(j.select("id", status.alias("status"), "last_at")).withColumn("notices", F.array_join("notices", " | "))


_REG = "regexp_extract(i.canonical_url, '^https?://([^/?#:]+)', 1)"


@query(f"""WITH l AS (SELECT e.event_id, i.source_id, coalesce(s.evidence_type = 'media_report', false) AS is_media, array_to_string(string_split({_REG}, '.')[-2:], '.') AS domain FROM event_items e JOIN item_versions v ON v.id = e.item_version_id JOIN collected_items i ON i.record_id = v.item_id LEFT JOIN source_specs s ON s.id = i.source_id)
SELECT event_id, count(DISTINCT CASE WHEN is_media THEN source_id END) AS media_sources, count(DISTINCT nullif(domain, '')) AS publishers, count(DISTINCT CASE WHEN is_media THEN source_id END) >= 2 OR count(DISTINCT nullif(domain, '')) >= 2 AS passed FROM l GROUP BY event_id""")
def publisher_gate(spark, d):
    """Two media sources behind an event, or else two publishers."""
    e = table(spark, d, "event_items").select("event_id", F.col("item_version_id").alias("id"))
    v = table(spark, d, "item_versions").select("id", F.col("item_id").alias("record_id"))
    i = table(spark, d, "collected_items").select("record_id", "source_id", ident.registrable_domain(F.col("canonical_url")).alias("domain"))
    s = table(spark, d, "source_specs").select(F.col("id").alias("source_id"), (F.col("evidence_type") == "media_report").alias("m"))
    j = e.join(v, "id").join(i, "record_id").join(s, "source_id", "left").withColumn("is_media", F.coalesce("m", F.lit(False)))
    return ev.publisher_gate(j)


_V = "(SELECT source_id, external_id, collected_at, record_id, sha256(concat_ws(chr(31), coalesce(title, ''), coalesce(summary, ''))) AS digest, row_number() OVER w AS k, lag(sha256(concat_ws(chr(31), coalesce(title, ''), coalesce(summary, '')))) OVER w AS p FROM collected_items WINDOW w AS (PARTITION BY source_id, external_id ORDER BY collected_at, record_id))"


@query(f"SELECT source_id, count(*) AS deliveries, (count(*) FILTER (k = 1))::BIGINT AS new, (count(*) FILTER (k > 1 AND digest <> p))::BIGINT AS changed, (count(*) FILTER (k > 1 AND digest = p))::BIGINT AS unchanged FROM {_V} GROUP BY source_id")
def run_counts(spark, d):
    """What each source's deliveries did to its items."""
    e = lambda c: F.coalesce(F.col(c), F.lit(""))
    c = table(spark, d, "collected_items").select("source_id", "external_id", "collected_at", "record_id", F.sha2(F.concat_ws("\x1f", e("title"), e("summary")), 256).alias("digest"))
    return ev.run_counts(ver.replay(c, ["source_id", "external_id"], "collected_at", "record_id", F.col("digest")), c, "source_id")


_ALLOWED = ["long_horizon", "self_evolving", "safety_governance", "autonomous_agent", "industrial_capital"]


@query(f"SELECT event_id, coalesce(list_sort(list_distinct(list_filter(topics, lambda x: NOT list_contains({_ALLOWED!r}, x)))), [])::VARCHAR[] AS unknown_list FROM radar_events".replace("SELECT event_id, coalesce(", "SELECT event_id, array_to_string(coalesce(").replace("[])::VARCHAR[] AS unknown_list", "[]), ',') AS unknown"))
def unknown_topics(spark, d):
    """H6: what an event's topics hold beyond the allowed ones."""
    allowed = F.array(*[F.lit(x) for x in _ALLOWED])
    return table(spark, d, "radar_events").select("event_id", F.array_join(F.array_sort(F.array_except(F.coalesce("topics", F.array().cast("array<string>")), allowed)), ",").alias("unknown"))


@query("SELECT record_id, collected_at FROM collected_items WHERE raw_snapshot IS NOT NULL AND collected_at < (SELECT max(collected_at) FROM collected_items) - INTERVAL 14 DAYS")
def expired_snapshots(spark, d):
    """M3: raw snapshots kept for longer than fourteen days."""
    c = table(spark, d, "collected_items").where("raw_snapshot is not null").select("record_id", "collected_at")
    now = _now(table(spark, d, "collected_items"), "collected_at")
    return c.where(F.col("collected_at") < now - F.expr("INTERVAL 14 DAYS"))


@query("""WITH k AS (SELECT user_id, max((ts, event_id)) FILTER (event_type <> 'error') AS ok FROM events GROUP BY user_id), f AS (SELECT e.user_id, count(*) FILTER (event_type = 'error' AND (ok IS NULL OR (ts, event_id) > ok)) AS failures, count(*) AS n FROM events e JOIN k USING (user_id) GROUP BY e.user_id)
SELECT user_id, array_to_string(list_filter(['failing', 'busy'], lambda x: CASE x WHEN 'failing' THEN failures >= 3 ELSE n >= 25 END), ',') AS reasons FROM f WHERE failures >= 3 OR n >= 25""")
def failure_reasons(spark, d):
    """M5 to M7: keys with three failures in a row or more rows than their capacity, with every reason that holds."""
    from tidemark.operators.state import failure_streaks

    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    f = failure_streaks(e, "user_id", "ts", "event_id", F.col("event_type") == "error").join(e.groupBy("user_id").agg(F.count("*").alias("n")), "user_id")
    reasons = F.array_compact(F.array(F.when(F.col("failures") >= 3, "failing"), F.when(F.col("n") >= 25, "busy")))
    return f.where(F.size(reasons) > 0).select("user_id", F.array_join(reasons, ",").alias("reasons"))


@query("SELECT event_id, CAST(first_seen_at + INTERVAL 8 HOURS AS DATE)::TIMESTAMP + INTERVAL 5 HOURS + INTERVAL 45 MINUTES AS send_at, strftime(first_seen_at, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(first_seen_at) % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST(epoch_us(first_seen_at) % 1000000 AS VARCHAR), 6, '0') END || 'Z' AS iso, epoch_us(first_seen_at) AS back_us FROM radar_events")
def send_times(spark, d):
    """The local sending time of each event's day, its ISO text, and the text read back."""
    e = table(spark, d, "radar_events").select("event_id", "first_seen_at")
    day = F.date_format(F.from_utc_timestamp("first_seen_at", "Asia/Shanghai"), "yyyy-MM-dd")
    iso = jsons.iso_utc(F.col("first_seen_at"))
    return e.select("event_id", jsons.send_at(day).cast("timestamp_ntz").alias("send_at"), iso.alias("iso"), F.unix_micros(jsons.from_iso(iso)).alias("back_us"))


_NOTICE = """CASE event_type WHEN 'view' THEN json_object('send', json_object('message_id', 's' || event_id)) WHEN 'click' THEN json_object('bounce', json_object('message_id', 'b' || event_id, 'type', 'hard')) WHEN 'error' THEN json_object('reject', json_object('reason', 'policy'), 'message_id', 'm' || event_id) ELSE json_object('other', 1) END"""


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 's' || event_id WHEN 'click' THEN 'b' || event_id WHEN 'error' THEN 'm' || event_id END AS message_id, CASE event_type WHEN 'click' THEN 'hard' WHEN 'error' THEN 'policy' ELSE 'old' END AS error FROM events""")
def notice_paths(spark, d):
    """The message a notice names and the error it states, by the first path that holds one."""
    e = table(spark, d, "events").select("event_id", "event_type")
    k = lambda c: F.concat(F.lit(c), F.col("event_id").cast("string"))
    t = F.col("event_type")
    body = F.to_json(F.struct(
        F.when(t == "view", F.struct(k("s").alias("message_id"))).alias("send"), F.when(t == "click", F.struct(k("b").alias("message_id"), F.lit("hard").alias("type"))).alias("bounce"),
        F.when(t == "error", F.struct(F.lit("policy").alias("reason"))).alias("reject"), F.when(t == "error", k("m")).alias("message_id"),
    ))
    return e.select("event_id", jsons.first_path(body, jsons.MESSAGE_PATHS).alias("message_id"), jsons.first_path(body, jsons.ERROR_PATHS, F.lit("old")).alias("error"))


@query("""SELECT id, kind, CASE WHEN config IS NULL OR len(map_keys(config)) = 0 THEN 1 ELSE len(list_distinct(list_concat(map_keys(config), ['page_size']))) END AS keys, 'x' AS page_size FROM source_specs""")
def merged_configs(spark, d):
    """A configuration over the stored one; the new value of a key counts."""
    s = table(spark, d, "source_specs").select("id", "kind", jsons.merged(F.col("config"), F.create_map(F.lit("page_size"), F.lit("x"))).alias("m"))
    return s.select("id", "kind", F.size("m").cast("bigint").alias("keys"), F.col("m")["page_size"].alias("page_size"))


@query("""WITH m AS (SELECT cluster_id, count(*) FILTER (verification_status = 'corroborated') AS c, count(*) FILTER (verification_status = 'verified_primary') AS p, count(*) FILTER (verification_status = 'company_claim') AS k, min(event_id) AS a, max(event_id) AS b FROM radar_events WHERE cluster_id IS NOT NULL GROUP BY cluster_id),
x AS (SELECT cluster_id, (SELECT verification_status FROM radar_events e WHERE e.event_id = a) AS va, (SELECT verification_status FROM radar_events e WHERE e.event_id = b) AS vb FROM m WHERE a <> b)
SELECT cluster_id, CASE WHEN 'corroborated' IN (va, vb) THEN 'corroborated' WHEN va = 'reported_unconfirmed' AND vb = 'reported_unconfirmed' THEN 'reported_unconfirmed' WHEN va = 'company_claim' AND vb = 'company_claim' THEN 'company_claim' WHEN 'verified_primary' IN (va, vb) THEN 'corroborated' WHEN 'company_claim' IN (va, vb) THEN 'company_claim' ELSE va END AS combined FROM x""")
def evidence_promotion(spark, d):
    """The standing of a cluster's first and last account together."""
    e = table(spark, d, "radar_events").where("cluster_id is not null").groupBy("cluster_id").agg(F.min_by("verification_status", "event_id").alias("a"), F.max_by("verification_status", "event_id").alias("b"), F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))
    return e.where("lo <> hi").select("cluster_id", rules.combined_verification(F.col("a"), F.col("b")).alias("combined"))


@query("""SELECT event_id, CASE WHEN evidence_type IN ('paper', 'regulatory_filing', 'exchange_filing', 'official_filing', 'official_repo', 'official_standard') THEN 'verified_primary' WHEN evidence_type = 'official_company' THEN 'company_claim' ELSE 'reported_unconfirmed' END AS verification,
CASE WHEN evidence_type = 'paper' OR source_type = 'pmlr' THEN 'paper' ELSE 'official_company' END AS shown, CASE status WHEN 'NEW_ENTITY' THEN '首次收录' WHEN 'MATERIAL_UPDATE' THEN '标题、核心摘要、版本或关键事实发生实质变化' WHEN 'MINOR_UPDATE' THEN '页面或非关键元数据变化，仅更新归档' WHEN 'DISCOVERED_LATE' THEN '来源时间早于本次采集窗口，属于迟发现事件' END AS said FROM radar_events""")
def evidence_labels(spark, d):
    """Standing by evidence, the label shown, the sentence for a state."""
    t = F.col("evidence_type")
    return table(spark, d, "radar_events").select("event_id", rules.verification_of(t).alias("verification"), rules.shown_evidence(t, F.col("source_type")).alias("shown"), rules.state_text(F.col("status")).alias("said"))


@query("SELECT e AS entity, CASE WHEN starts_with(e, 'author:') THEN 'author_group' WHEN e IN (SELECT entity_id FROM collected_items WHERE entity_id IS NOT NULL) THEN 'issuer' ELSE 'company' END AS kind, count(*) AS n FROM (SELECT unnest(entities) AS e FROM radar_events) GROUP BY 1, 2")
def entity_kinds(spark, d):
    """What each entity is; the entities of items stand for the list of issuers."""
    n = table(spark, d, "radar_events").select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n"))
    known = table(spark, d, "collected_items").where("entity_id is not null").select(F.col("entity_id").alias("entity"), F.lit(True).alias("issuer")).distinct()
    return n.join(known, "entity", "left").select("entity", rules.entity_kind(F.col("entity"), F.coalesce("issuer", F.lit(False))).alias("kind"), "n")


_ET = "CASE " + " ".join("WHEN (" + " OR ".join(f"contains(h, '{t}')" for t in ts) + ")" + (" AND (" + " OR ".join(f"contains(h, '{t}')" for t in rules.COMPUTE_TERMS) + ")" if k == "CAPEX_COMPUTE" else "") + f" THEN '{k}'" for k, ts in rules.EVENT_TERMS) + " ELSE 'PUBLICATION' END"


@query(f"WITH t AS (SELECT doc_id, doc_kind, lower(coalesce(text, '')) AS h FROM documents) SELECT doc_id, CASE WHEN doc_kind = 'filing' THEN 'OWNERSHIP' ELSE {_ET} END AS kind FROM t")
def event_kinds(spark, d):
    """The kind of event whole texts tell of, in the rules' order; filings by their form."""
    t = table(spark, d, "documents").select("doc_id", "doc_kind", F.coalesce("text", F.lit("")).alias("text"))
    form = F.when(F.col("doc_kind") == "filing", "SC 13D")
    return t.select("doc_id", rules.filing_event_type(form, F.lit(None).cast("string"), rules.event_type(F.col("text"), F.lit("rss"))).alias("kind"))


@query("SELECT event_id, cluster_id, coalesce(len(topics), 0)::INTEGER AS topics, CASE WHEN regexp_matches(primary_url, '(?i)^https?://[^/?#\\s]+') THEN primary_url END AS primary_url, coalesce(len(list_distinct(list_filter(corroborating_urls, lambda u: regexp_matches(u, '(?i)^https?://[^/?#\\s]+')))), 0)::INTEGER AS links, greatest(0, least(100, score))::INTEGER AS score FROM radar_events")
def dataset_events(spark, d):
    """The allowed fields of events, through the guard."""
    from tidemark.operators.export import guard

    e = guard(ev.public_events(table(spark, d, "radar_events"), ident.is_web_url(F.col("primary_url"))), ["primary_url"])
    return e.select("event_id", "cluster_id", F.size("topics").alias("topics"), "primary_url", F.size("corroborating_urls").alias("links"), F.coalesce("score", F.lit(0)).alias("score"))


@query("SELECT record_id, CASE WHEN p = '' THEN 'unknown' ELSE p END AS label FROM (SELECT record_id, left(regexp_replace(regexp_replace(coalesce(title, ''), '[^a-zA-Z0-9._-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g'), 120) AS p FROM collected_items)")
def path_labels(spark, d):
    """Titles as parts of stored paths."""
    return table(spark, d, "collected_items").select("record_id", txt.path_label(F.coalesce("title", F.lit(""))).alias("label"))


@query("""SELECT DISTINCT a.event_id AS notice, b.event_id AS delivery FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'purchase' AND b.ts BETWEEN a.ts - INTERVAL 2 HOURS AND a.ts + INTERVAL 2 HOURS""")
def stream_attached_notices(spark, d):
    """A stream of notices meets a stream of deliveries of the same key, whichever comes first."""
    s = lambda kind, name, at: jobs.read_files(spark, d, "events", table(spark, d, "events").schema).where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(name), F.col("ts").alias(at))
    return jobs.attached(s("error", "notice", "noticed"), s("purchase", "delivery", "delivered"), "user_id", "noticed", "delivered", "2 hours", jobs.workspace(spark)).select("notice", "delivery").distinct()
