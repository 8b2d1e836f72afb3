"""Queries of text, identity, URL, time, rule, search, cluster, export and stream operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import identity as ident
from tidemark.functions import rules as rul
from tidemark.functions import text as txt
from tidemark.functions import vectors
from tidemark.io import table
from tidemark.operators import clusters, export, search
from tidemark.operators import events as ev
from tidemark.operators import relations as rel
from tidemark.plans.relational import _RANK
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


_URL = r"""WITH u AS (SELECT {k}, trim({c}) AS u FROM {t}),
x AS (SELECT {k}, u, coalesce(nullif(lower(regexp_extract(u, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)), ''), 'https') AS s, lower(regexp_extract(u, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://([^/?#]*))?', 1)) AS h,
regexp_replace(regexp_extract(u, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), '/{{2,}}', '/', 'g') AS p, list_filter(string_split(regexp_extract(u, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '') AS q FROM u),
y AS (SELECT *, CASE WHEN p = '/' THEN p ELSE regexp_replace(p, '/+$', '') END AS path, list_sort(list_filter(list_transform(q, lambda x: {{'k': url_decode(replace(split_part(x, '=', 1), '+', ' ')), 'v': CASE WHEN contains(x, '=') THEN url_decode(replace(substr(x, strpos(x, '=') + 1), '+', ' ')) ELSE '' END}}),
lambda y: NOT starts_with(lower(y.k), 'utm_') AND lower(y.k) NOT IN ('fbclid', 'gclid', 'mc_cid', 'mc_eid', 'ref', 'source'))) AS pairs FROM x)
SELECT {k}, CASE WHEN u IS NULL THEN NULL ELSE s || CASE WHEN h <> '' OR (s IN ('http', 'https', 'ftp', 'sftp', 'file', 'ws', 'wss', 'git', 'svn', 'rsync') AND (path = '' OR starts_with(path, '/'))) THEN '://' ELSE ':' END || h || path
|| CASE WHEN len(pairs) > 0 THEN '?' || list_aggregate(list_transform(pairs, lambda y: replace(url_encode(y.k), '%20', '+') || '=' || replace(url_encode(y.v), '%20', '+')), 'string_agg', '&') ELSE '' END END AS url FROM y"""


@query(_URL.format(k="record_id", c="canonical_url", t="collected_items"))
def canonical_urls(spark, d):
    """I19."""
    return table(spark, d, "collected_items").select("record_id", ident.canonical_url(F.col("canonical_url")).alias("url"))


_HOST = r"regexp_replace(lower(list_last(string_split(regexp_extract(trim(primary_url), '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://([^/?#]*))?', 1), '@'))), ':[0-9]*$', '')"


@query(f"""WITH h AS (SELECT event_id, string_split({_HOST}, '.') AS l, {_HOST} AS h FROM radar_events) SELECT event_id, CASE WHEN h = '' OR h IS NULL THEN NULL WHEN array_to_string(l[greatest(len(l) - 1, 1):], '.') IN ('co.uk', 'com.cn', 'com.hk', 'com.au', 'co.jp', 'org.cn') THEN array_to_string(l[greatest(len(l) - 2, 1):], '.') ELSE array_to_string(l[greatest(len(l) - 1, 1):], '.') END AS domain FROM h""")
def registrable_domains(spark, d):
    """I20."""
    return table(spark, d, "radar_events").select("event_id", ident.registrable_domain(F.col("primary_url")).alias("domain"))


@query(r"SELECT event_id, coalesce(regexp_matches(primary_url, '(?i)^https?://[^/?#\s]+'), false) AS usable FROM radar_events")
def safe_urls(spark, d):
    """I24, C21."""
    return table(spark, d, "radar_events").select("event_id", ident.is_web_url(F.col("primary_url")).alias("usable"))


@query(r"""SELECT record_id, sha256(lower(trim(regexp_replace(coalesce(source_id, ''), '\s+', ' ', 'g'))) || chr(31) || lower(trim(regexp_replace(coalesce(external_id, ''), '\s+', ' ', 'g')))) AS id FROM collected_items""")
def stable_ids(spark, d):
    """I17, I22."""
    return table(spark, d, "collected_items").select("record_id", ident.stable_id(F.col("source_id"), F.col("external_id")).alias("id"))


@query()
def normalized_text_hash(spark, d):
    """Whole texts, markup and CSS removed."""
    return table(spark, d, "documents").select("doc_id", ident.content_hash(F.col("text")).alias("hash"))


@query(r"""SELECT record_id, lower(regexp_extract(external_id, '(?i)([a-z-]+/[0-9]{7}|[0-9]{4}\.[0-9]{4,5})(?:v([0-9]+))?', 1)) AS id, CAST(coalesce(nullif(regexp_extract(external_id, '(?i)([a-z-]+/[0-9]{7}|[0-9]{4}\.[0-9]{4,5})(?:v([0-9]+))?', 2), ''), '1') AS INTEGER) AS version FROM collected_items WHERE regexp_matches(external_id, '(?i)([a-z-]+/[0-9]{7}|[0-9]{4}\.[0-9]{4,5})')""")
def arxiv_identity(spark, d):
    """I21."""
    x = table(spark, d, "collected_items").select("record_id", ident.arxiv_identity(F.col("external_id")).alias("x"))
    return x.where("x is not null").select("record_id", "x.id", "x.version")


_KINDS = [("filing", ["filing", "charter"]), ("release", ["releases", "version"]), ("report", ["report", "survey"]), ("benchmark", ["benchmark"])]
_KIND_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(coalesce(title, '')), '{t}')" for t in ts) + f" THEN '{k}'" for k, ts in _KINDS) + " ELSE 'publication' END"


@query(f"SELECT record_id, {_KIND_SQL} AS kind FROM collected_items")
def infer_event_type(spark, d):
    """Ordered rules, the first that fits."""
    return table(spark, d, "collected_items").select("record_id", txt.first_match(F.lower(F.coalesce("title", F.lit(""))), _KINDS, F.lit("publication")).alias("kind"))


_RULES = [
    rul.TopicRule("agents", hard=("autonomous", "delegation", "orchestration"), boosters=("planner", "memory-store"), kinds=("code_release",)),
    rul.TopicRule("evaluation", hard=("benchmark", "evaluation", "ablation"), boosters=("verifier",), required=("report", "structured", "distributed")),
    rul.TopicRule("governance", hard=("governance", "compliance", "charter"), boosters=("audit-trail", "disclosure")),
]


def _has(t: str) -> str:
    return f"regexp_matches(h, '(^|[^a-z0-9]){t}($|[^a-z0-9])')"


def _n(ts: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"CAST({_has(t)} AS INTEGER)" for t in ts) + ")"


def _rule_sql(r: rul.TopicRule) -> str:
    base = f"({_n(r.hard)} > 0" + (f" OR coalesce(evidence_type, '') IN ({', '.join(repr(k) for k in r.kinds)})" if r.kinds else "") + ")"
    need = f" AND {_n(r.required)} > 0" if r.required else ""
    return f"SELECT record_id, '{r.topic}' AS topic, least(30, 16 + 4 * {_n(r.hard)} + 2 * {_n(r.boosters)}) AS strength FROM t WHERE {base}{need}"


@query("WITH t AS (SELECT record_id, evidence_type, lower(coalesce(title, '') || chr(10) || coalesce(summary, '')) AS h FROM collected_items) " + " UNION ALL ".join(map(_rule_sql, _RULES)))
def topic_strengths(spark, d):
    """Rules compiled into one expression; no join with terms."""
    t = table(spark, d, "collected_items").select("record_id", "evidence_type", F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("summary", F.lit(""))).alias("h"))
    return t.select("record_id", F.explode(rul.classify(F.col("h"), F.col("evidence_type"), _RULES)).alias("x")).select("record_id", "x.topic", "x.strength")


_TAGS = {"open": ["open"], "public_private": ["public", "private"], "long_context": ["long-running", "multi-stage"]}


@query("SELECT record_id, tag FROM (SELECT record_id, lower(coalesce(summary, '')) AS h FROM collected_items) t, (VALUES ('open'), ('public_private'), ('long_context')) v(tag) WHERE CASE tag WHEN 'open' THEN " + _has("open") + " WHEN 'public_private' THEN " + _has("public") + " OR " + _has("private") + " ELSE " + _has("long-running") + " OR " + _has("multi-stage") + " END")
def cross_tags(spark, d):
    """Tags any of whose terms a text holds."""
    return table(spark, d, "collected_items").select("record_id", F.explode(rul.tags(F.col("summary"), _TAGS)).alias("tag"))


_NAMES = """(SELECT DISTINCT name, lower(name) AS low FROM (SELECT unnest(entities) AS name FROM radar_events) WHERE name IS NOT NULL)"""


@query(rf"""SELECT record_id, arg_max(name, (length(name), name)) AS entity FROM (SELECT record_id, lower(title) AS t FROM collected_items WHERE title IS NOT NULL) i JOIN {_NAMES} n ON contains(t, low) AND (NOT regexp_matches(low, '^[a-z0-9_-]+$') OR regexp_matches(t, '(^|[^a-z0-9])' || regexp_escape(low) || '($|[^a-z0-9])')) GROUP BY record_id""")
def alias_detection(spark, d):
    """The longest name of an entity that a title holds, of several words or none."""
    names = table(spark, d, "radar_events").select(F.explode("entities").alias("entity")).distinct()
    return ev.aliases_in(table(spark, d, "collected_items").select("record_id", "title"), "record_id", "title", names, "entity").select("record_id", F.col("name").alias("entity"))


# Tokens in SQL: a Han character alone, else runs of letters and digits with the marks on them.
_TOKENS = r"list_distinct(regexp_extract_all(regexp_replace(lower({c}), '(\p{{Han}})', ' \1 ', 'g'), '[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}\p{{M}}]*'))"


@query(f"SELECT w AS token, count(*) AS docs FROM (SELECT record_id, unnest({_TOKENS.format(c='title')}) AS w FROM collected_items) GROUP BY w")
def token_counts(spark, d):
    """Document counts of the tokens of every title, combined before the shuffle."""
    w = table(spark, d, "collected_items").select("record_id", F.explode(F.array_distinct(txt.tokens(F.col("title")))).alias("token"))
    return w.groupBy("token").agg(F.count("*").alias("docs"))


_FUZZY = lambda term, edits: f"(starts_with(w, '{term}') OR levenshtein(regexp_replace(w, '[^ -~]', '?', 'g'), '{term}') <= {edits})"


@query(f"SELECT DISTINCT record_id FROM (SELECT record_id, unnest({_TOKENS.format(c='title')}) AS w FROM collected_items) WHERE {_FUZZY('benchm', 1)} OR {_FUZZY('governence', 2)}")
def search_membership(spark, d):
    """Prefix and fuzzy membership of two terms, over every title."""
    c = table(spark, d, "collected_items").select("record_id", "title")
    return search.search(search.postings(c, "record_id", {"title": 3.0}), "record_id", ["benchm", "governence"]).select("record_id")


_TERMS = ["benchm", "governence"]


@query()
def search_events(spark, d):
    """The same over five fields of every event; topics stand for tags, which the tables don't hold."""
    e = table(spark, d, "radar_events").select("event_id", *search.EVENT_FIELDS)
    return search.search(search.postings(e, "event_id", search.EVENT_FIELDS), "event_id", _TERMS + ["审查"]).select("event_id")


@query(r"SELECT record_id, regexp_replace(regexp_replace(regexp_replace(canonical_url, '[?#].*$', ''), '/+$', ''), '^.*/', '') AS slug FROM collected_items WHERE canonical_url IS NOT NULL")
def slugs(spark, d):
    """The last path segment."""
    bare = F.regexp_replace(F.regexp_replace("canonical_url", r"[?#].*$", ""), "/+$", "")
    return table(spark, d, "collected_items").where("canonical_url is not null").select("record_id", F.element_at(F.split(bare, "/"), -1).alias("slug"))


@query(r"""SELECT record_id, array_to_string(list_transform(string_split(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(canonical_url, '[?#].*$', ''), '/+$', ''), '^.*/', ''), '-[0-9]{4}-[0-9]{2}-[0-9]{2}$', ''), '[-_]+', ' ', 'g')), ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') AS title FROM collected_items WHERE canonical_url IS NOT NULL""")
def slug_titles(spark, d):
    """I11."""
    return table(spark, d, "collected_items").where("canonical_url is not null").select("record_id", txt.slug_title(F.col("canonical_url")).alias("title"))


@query("SELECT event_id, CAST(props->>'$.k' AS INTEGER) AS k FROM events")
def json_path_props(spark, d):
    """Paths of open JSON."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").select("event_id", k.alias("k"))


@query("SELECT event_id, coalesce(len(topics), 0)::INTEGER AS n, coalesce(list_contains(topics, 'long_horizon'), false) AS long, coalesce(len(list_filter(entities, lambda x: starts_with(x, 'org-'))), 0)::BIGINT AS orgs FROM radar_events")
def array_metadata(spark, d):
    """I47, I48."""
    none = F.array().cast("array<string>")
    e = table(spark, d, "radar_events").select("event_id", F.coalesce("topics", none).alias("topics"), F.coalesce("entities", none).alias("entities"))
    return e.select("event_id", F.size("topics").alias("n"), F.array_contains("topics", "long_horizon").alias("long"), F.size(F.filter("entities", lambda x: x.startswith("org-"))).cast("bigint").alias("orgs"))


@query("SELECT record_id, octet_length(encode(title)) AS title_bytes, length(title) AS title_chars, octet_length(encode(content)) AS content_bytes FROM collected_items")
def octet_lengths(spark, d):
    """I54."""
    return table(spark, d, "collected_items").select("record_id", F.octet_length("title").cast("bigint").alias("title_bytes"), F.length("title").cast("bigint").alias("title_chars"), F.octet_length("content").cast("bigint").alias("content_bytes"))


@query("SELECT event_id, CAST(CAST(first_seen_at + INTERVAL 8 HOURS AS DATE) AS VARCHAR) AS day FROM radar_events")
def product_day(spark, d):
    """The day in Shanghai, which keeps one offset."""
    return table(spark, d, "radar_events").select("event_id", F.date_format(F.from_utc_timestamp("first_seen_at", "Asia/Shanghai"), "yyyy-MM-dd").alias("day"))


@query("""WITH l AS (SELECT source_id, max(collected_at) AS seen FROM collected_items GROUP BY source_id) SELECT id, seen + CASE cadence WHEN 'hourly' THEN INTERVAL 1 HOUR WHEN 'daily' THEN INTERVAL 1 DAY ELSE INTERVAL 7 DAYS END AS due FROM source_specs s JOIN l ON l.source_id = s.id""")
def cadence_next_due(spark, d):
    """I27, C1."""
    last = table(spark, d, "collected_items").groupBy(F.col("source_id").alias("id")).agg(F.max("collected_at").alias("at"))
    step = F.expr("CASE cadence WHEN 'hourly' THEN INTERVAL '1' HOUR WHEN 'daily' THEN INTERVAL '24' HOUR ELSE INTERVAL '168' HOUR END")
    return table(spark, d, "source_specs").join(last, "id").select("id", (F.col("at") + step).alias("due"))


@query("SELECT id, received_at > created_at + INTERVAL 48 HOURS AS late FROM event_revisions")
def late_discovery(spark, d):
    """I31, C4."""
    return table(spark, d, "event_revisions").select("id", (F.col("received_at") > F.col("created_at") + F.expr("INTERVAL 48 HOURS")).alias("late"))


@query("SELECT event_id, CASE WHEN score >= 80 THEN 'a' WHEN score >= 65 THEN 'b' WHEN score >= 45 THEN 'c' ELSE 'd' END AS band FROM radar_events")
def score_bands(spark, d):
    """I15."""
    s = F.col("score")
    return table(spark, d, "radar_events").select("event_id", F.when(s >= 80, "a").when(s >= 65, "b").when(s >= 45, "c").otherwise("d").alias("band"))


@query("""WITH w AS (SELECT *, CASE verification_status WHEN 'verified_primary' THEN 4 WHEN 'corroborated' THEN 3 WHEN 'company_claim' THEN 2 ELSE 1 END AS v FROM radar_events),
r AS (SELECT event_id, score, first_seen_at, score * 2 + v * 10 + len(coalesce(corroborating_urls, [])) AS weight FROM w WHERE status <> 'MINOR_UPDATE') SELECT event_id, score, CAST(weight AS INTEGER) AS weight FROM r ORDER BY weight DESC, event_id LIMIT 20""")
def ranked_public_events(spark, d):
    """C9, G6 to G8 (the limit is the feature)."""
    v = F.expr("CASE verification_status WHEN 'verified_primary' THEN 4 WHEN 'corroborated' THEN 3 WHEN 'company_claim' THEN 2 ELSE 1 END")
    e = table(spark, d, "radar_events").where("status <> 'MINOR_UPDATE'")
    w = F.col("score").cast("int") * 2 + v * 10 + F.size(F.coalesce("corroborating_urls", F.array().cast("array<string>")))
    return e.select("event_id", "score", w.alias("weight")).orderBy(F.desc("weight"), "event_id").limit(20)


@query("""SELECT '<item><title>' || replace(replace(replace(replace(title_zh, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</title><link>' || replace(replace(replace(replace(primary_url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</link><guid isPermaLink="false">' || event_id || '</guid><pubDate>' || strftime(first_seen_at, '%a, %d %b %Y %H:%M:%S') || ' +0000</pubDate></item>' AS line
FROM (SELECT * FROM radar_events WHERE title_zh IS NOT NULL AND primary_url IS NOT NULL ORDER BY first_seen_at DESC, event_id LIMIT 60)""")
def rss_lines(spark, d):
    """B9, G9 (the limit is the feature)."""
    e = table(spark, d, "radar_events").where("title_zh is not null and primary_url is not null").orderBy(F.desc("first_seen_at"), "event_id").limit(60)
    return e.select(export.feed_line(F.col("title_zh"), F.col("primary_url"), F.col("event_id"), F.col("first_seen_at")).alias("line"))


@query()
def feature_hash_embedding(spark, d):
    """I40."""
    return table(spark, d, "radar_events").select("event_id", vectors.feature_hash(F.col("title_zh")).alias("vector"))


@query()
def greedy_clusters(spark, d):
    """Events in order of first sight, newest first, by the embedding of their latest primary version, to roots within 14 days."""
    links = table(spark, d, "event_items").where("relation = 'primary'").select("event_id", F.col("item_version_id").alias("id"))
    v = table(spark, d, "item_versions").select("id", "fetched_at", F.col("metadata.embedding_space").alias("space"), "embedding_vector")
    newest = rel.latest(links.join(v.select("id", "fetched_at"), "id"), ["event_id"], ["fetched_at", "id"]).select("event_id", "id")
    e = table(spark, d, "radar_events").select("event_id", "event_type", "first_seen_at").join(newest, "event_id", "left").join(v.select("id", "space", "embedding_vector"), "id", "left")
    vector = F.when(vectors.is_valid(F.col("embedding_vector"), 128), F.col("embedding_vector"))
    order = F.struct(-F.unix_micros(F.col("first_seen_at").cast("timestamp")), "event_id")
    return clusters.greedy_clusters(e.withColumn("vector", vector), "event_id", "vector", ["event_type", "space"], order, 0.92, 128, F.unix_micros(F.col("first_seen_at").cast("timestamp")), 14 * 86_400_000_000)


@query()
def html_links(spark, d):
    """Anchors of whole pages."""
    from tidemark.sources.pages import links_of

    p = table(spark, d, "collected_items").where("raw_snapshot is not null").select("record_id", F.col("raw_snapshot").cast("string").alias("page"))
    return p.select("record_id", F.posexplode(links_of("page")).alias("pos", "a")).select("record_id", "pos", "a.href", "a.text")


@query()
def html_article(spark, d):
    """Titles and addresses of whole pages."""
    from tidemark.sources.pages import article_of

    p = table(spark, d, "collected_items").where("raw_snapshot is not null").select("record_id", article_of(F.col("raw_snapshot").cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("p"))
    return p.select("record_id", "p.title", "p.description", F.length(F.coalesce("p.content", F.lit(""))).alias("chars"))


@query("SELECT CAST(time_bucket(INTERVAL 1 DAY, ts) AS VARCHAR) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling_counts(spark, d):
    """Event-time windows over a stream of files."""
    s = jobs.read_files(spark, d, "events", table(spark, d, "events").schema)
    got = jobs.tumbling_counts(s, "ts", "1 day", ["event_type"], jobs.workspace(spark))
    return got.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@query(f"SELECT user_id, arg_max(event_type, ({_RANK}, ts, event_id)) AS state, count(*) AS n FROM events GROUP BY user_id")
def stream_ranked_states(spark, d):
    """Custom state over a stream."""
    s = jobs.read_files(spark, d, "events", table(spark, d, "events").schema)
    return jobs.ranked_states(s, "user_id", "event_type", F.expr(_RANK), "ts", "event_id", jobs.workspace(spark))


@query("SELECT source_id, external_id, sha256(concat_ws(chr(31), coalesce(title, ''), coalesce(summary, ''))) AS digest, min(collected_at) AS first_at, max(collected_at) AS last_at FROM collected_items GROUP BY ALL")
def stream_ingest_available_now(spark, d):
    """Deliveries of a stream into versions."""
    s = jobs.read_files(spark, d, "collected_items", table(spark, d, "collected_items").schema)
    e = lambda c: F.coalesce(F.col(c), F.lit(""))
    return jobs.version_stream(s, ["source_id", "external_id"], "collected_at", "record_id", F.sha2(F.concat_ws("\x1f", e("title"), e("summary")), 256), jobs.workspace(spark))


@query("SELECT count(*) AS n, count(DISTINCT external_id) AS keys FROM (SELECT external_id FROM collected_items WHERE external_id IS NOT NULL GROUP BY external_id)")
def stream_first_deliveries(spark, d):
    """One delivery a key by event time, late rows folded in, as counts."""
    return _first_deliveries(spark, d).agg(F.count("*").alias("n"), F.countDistinct("external_id").alias("keys"))


@query("SELECT external_id, arg_min(record_id, (collected_at, record_id)) AS record_id, min(collected_at) AS collected_at FROM collected_items WHERE external_id IS NOT NULL GROUP BY external_id")
def stream_first_records(spark, d):
    """The delivery of each key that survives, the first by event time."""
    return _first_deliveries(spark, d)


def _first_deliveries(spark, d):
    s = jobs.read_files(spark, d, "collected_items", table(spark, d, "collected_items").schema).where("external_id is not null").select("external_id", "record_id", "collected_at")
    return jobs.first_deliveries(s, "collected_at", "external_id", jobs.workspace(spark), "record_id")
