"""Event tables: revision ledger, selection of what is not used yet, item identity, filters, rollups and the public dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.blocks import numbered
from tidemark.operators.relations import latest
from tidemark.session import cut

# States whose revisions are material.
MATERIAL = ("NEW_ENTITY", "MATERIAL_UPDATE", "DISCOVERED_LATE")


def ledger(current: DataFrame, batch: DataFrame, event: str, digest: str, order: list[str]) -> DataFrame:
    """(event, digest, revision_no, status, is_material): what a batch adds to or renews in a ledger of revisions.

    ``current``: event, digest, revision_no. A digest that its event holds keeps its number; new ones are numbered on from
    the event's greatest, in the order of ``order`` (its first is a time). Of equal digests in the batch the last row counts
    for the status and the first for the order. Rows with a null event or digest take no part.
    """
    rows = batch.where(F.col(event).isNotNull() & F.col(digest).isNotNull()).select(F.col(event).alias("e"), F.col(digest).alias("d"), F.struct(*order).alias("o"), "status")
    one = rows.groupBy("e", "d").agg(F.min("o").alias("first"), F.max_by("status", "o").alias("status"))
    held = current.where(F.col(digest).isNotNull()).groupBy(F.col(event).alias("e"), F.col(digest).alias("d")).agg(F.min("revision_no").alias("known"))
    last = current.groupBy(F.col(event).alias("e")).agg(F.max("revision_no").alias("last"))
    both = one.join(held, ["e", "d"], "left").join(last, "e", "left")
    fresh = both.where("known is null").withColumn("at", F.unix_micros(F.col("first")[order[0]].cast("timestamp"))).withColumn("tie", F.col("first").cast("string"))
    fresh = numbered(fresh, ["e"], "at", ["first", "d"], "k").withColumn("revision_no", F.coalesce("last", F.lit(0)) + F.col("k"))
    old = both.where("known is not null").withColumn("revision_no", F.col("known"))
    cols = ["e", "d", "revision_no", "status"]
    out = fresh.select(*cols).unionByName(old.select(*cols))
    return out.select(F.col("e").alias(event), F.col("d").alias(digest), F.col("revision_no").cast("int").alias("revision_no"), "status", F.col("status").isin(*MATERIAL).alias("is_material"))


def select_unused(revisions: DataFrame, used: DataFrame, kind: str, own_key: str, cutoff: Column) -> DataFrame:
    """The latest revision of each event, where it is material in kind, not later than ``cutoff`` and not used yet in a delivery of ``kind``.

    ``revisions``: event_id, revision_no, id, status, created_at; ``used``: revision_id, kind, delivery_key. What the
    delivery ``own_key`` holds itself doesn't count as used, so that composing again selects the same. The latest is taken
    of what the cutoff allows.
    """
    seen = revisions.where(F.col("created_at") <= cutoff)
    newest = latest(seen.select("event_id", "revision_no", "created_at", "id", "status"), ["event_id"], ["revision_no", "created_at", "id"])
    taken = used.where((F.col("kind") == kind) & (F.col("delivery_key") != own_key)).select(F.col("revision_id").alias("id"))
    return newest.where(F.col("status").isin(*MATERIAL)).join(taken, "id", "left_anti").select("event_id", "revision_no", "id")


def same_items(deliveries: DataFrame, source: str, native: str, url: str, key: str, max_rounds: int = 60) -> DataFrame:
    """(key, item): deliveries of one source with an equal native id or an equal address are one item, named by its least key.

    Both relations hold transitively: a rotated id under a known address, a moved address under a known id. Labels travel
    by turns along ids and addresses until none changes; each turn aggregates before it shuffles. Null ids and addresses
    join nothing; rows with a null key take no part. Chains longer than ``max_rounds`` are an error, never a partial answer.
    """
    # ids and addresses as hashes, told apart by a mark; what no other row shares needs no turn
    rows = deliveries.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.when(F.col(native).isNotNull(), F.xxhash64(F.lit("n"), source, native)).alias("n"), F.when(F.col(url).isNotNull(), F.xxhash64(F.lit("u"), source, url)).alias("u"))
    pairs = rows.select("k", F.explode(F.array_compact(F.array("n", "u"))).alias("x"))
    shared = pairs.groupBy("x").agg(F.countDistinct("k").alias("c")).where("c > 1").select("x")
    edges = cut(pairs.join(shared, "x", "left_semi").distinct())
    label = cut(edges.select("k").distinct().select("k", F.col("k").alias("item")))
    for _ in range(max_rounds):
        at = edges.join(label, "k").groupBy("x").agg(F.min("item").alias("low"))
        moved = cut(edges.join(at, "x").groupBy("k").agg(F.min("low").alias("new")).join(label, "k").select("k", F.col("new").alias("item"), (F.col("new") < F.col("item")).alias("changed")))
        if not moved.where("changed").take(1):
            return rows.select("k").distinct().join(label, "k", "left").select(F.col("k").alias(key), F.coalesce("item", "k").alias("item"))
        label = moved.select("k", "item")
    raise RuntimeError("items didn't settle; raise max_rounds")


def event_time(events: DataFrame) -> Column:
    """When an event counts: the time of its material update where that is its state, else when it was first seen (C14)."""
    return F.when(F.col("status") == "MATERIAL_UPDATE", F.coalesce("material_updated_at", "first_seen_at")).otherwise(F.col("first_seen_at"))


def filter_events(events: DataFrame, filters: dict, now: Column | None = None, days: int | None = None) -> DataFrame:
    """Events that meet all given filters (C13, C14): topic, entity, tag in their lists; event_type, status, verification_status, evidence_type, source_id equal; min_score at least.

    A filter that is not given or None holds for all. ``days`` keeps those whose time is no earlier than so many before ``now``.
    """
    known = {"topic": "topics", "entity": "entities", "tag": "cross_tags"}
    unknown = set(filters) - set(known) - {"event_type", "status", "verification_status", "evidence_type", "source_id", "min_score"}
    if unknown:
        raise ValueError(f"no such filter: {', '.join(sorted(unknown))}")
    for name, value in filters.items():
        if value is None:
            continue
        events = events.where(F.array_contains(known[name], value) if name in known else F.col("score") >= value if name == "min_score" else F.col(name) == value)
    return events if days is None else events.where(event_time(events) >= now - F.expr(f"INTERVAL {days} DAYS"))


# Sections in their order, and the topics that each shows.
SECTIONS = (
    ("long_horizon", ("long_horizon",)), ("autonomous_agent", ("autonomous_agent",)), ("self_evolving", ("self_evolving",)), ("mechanistic_interpretability", ("mechanistic_interpretability",)),
    ("safety_governance", ("safety_governance", "mechanistic_interpretability")), ("industrial_capital", ("industrial_capital",)), ("podcast_culture", ("podcast_culture",)),
)


def section_counts(events: DataFrame, topics: str) -> DataFrame:
    """(section, n): events of each section; the safety section shows interpretability too; empty ones count 0."""
    has = lambda ts: F.coalesce(F.arrays_overlap(topics, F.array(*[F.lit(t) for t in ts])), F.lit(False))
    one = events.agg(*[F.count_if(has(ts)).alias(s) for s, ts in SECTIONS])
    return one.select(F.explode(F.array(*[F.struct(F.lit(s).alias("section"), F.col(s).alias("n")) for s, _ in SECTIONS])).alias("x")).select("x.*")


def health_rollup(health: DataFrame, notices: int = 10) -> DataFrame:
    """One row: sources that are healthy, that need a look, the newest success, and the first ``notices`` of those that need one.

    ``health``: id, status, last_at. Disabled sources are in neither count. The list is bounded before it is gathered.
    """
    bad = ~F.col("status").isin("healthy", "disabled")
    first = health.where(bad).orderBy("id").limit(notices).agg(F.array_sort(F.collect_list(F.concat_ws(": ", "id", "status"))).alias("notices"))
    return health.agg(F.count_if(F.col("status") == "healthy").alias("healthy"), F.count_if(bad).alias("attention"), F.max("last_at").alias("last_success")).join(F.broadcast(first))


# The fields of an event that may leave.
PUBLIC = ("event_id", "cluster_id", "event_type", "topics", "entities", "title_zh", "summary_zh", "why_it_matters", "first_seen_at", "status", "source_type", "evidence_type", "verification_status", "score", "primary_url", "corroborating_urls")


def public_events(events: DataFrame, safe: Column) -> DataFrame:
    """The allowed fields of events, and no other column; unsafe addresses are dropped from the links."""
    empty = F.array().cast("array<string>")
    links = F.array_distinct(F.filter(F.coalesce("corroborating_urls", empty), lambda u: u.rlike(r"(?i)^https?://[^/?#\s]+")))
    shaped = {"topics": F.coalesce("topics", empty), "entities": F.coalesce("entities", empty), "corroborating_urls": links, "primary_url": F.when(safe, F.col("primary_url")), "score": F.greatest(F.lit(0), F.least(F.lit(100), F.col("score").cast("int")))}
    return events.select(*[shaped[c].alias(c) if c in shaped else F.col(c) for c in PUBLIC])


def write_dataset(events: DataFrame, health: DataFrame, facets: DataFrame, at: str, path: str, version: str = "1") -> None:
    """The public dataset: events by month, and one document a table for facets, months, health and the window.

    Every part is written by executors; the window and health documents are one row each.
    """
    events.withColumn("month", F.date_format(at, "yyyy-MM")).write.mode("overwrite").partitionBy("month").json(f"{path}/events")
    facets.groupBy("facet").agg(F.map_from_entries(F.collect_list(F.struct("value", "n"))).alias("counts")).write.mode("overwrite").json(f"{path}/facets")
    events.groupBy(F.date_format(at, "yyyy-MM").alias("month")).agg(F.count("*").alias("events")).write.mode("overwrite").json(f"{path}/months")
    events.agg(F.lit(version).alias("schema_version"), F.min(at).alias("window_start"), F.max(at).alias("window_end"), F.count("*").alias("events")).write.mode("overwrite").json(f"{path}/window")
    health_rollup(health).write.mode("overwrite").json(f"{path}/health")


def run_counts(versions: DataFrame, deliveries: DataFrame, source: str) -> DataFrame:
    """(source, deliveries, new, changed, unchanged): what a run did to each source's items (E13). ``versions``: source, revision_no of what was written."""
    d = deliveries.groupBy(source).agg(F.count("*").alias("deliveries"))
    v = versions.groupBy(source).agg(F.count_if(F.col("revision_no") == 1).alias("new"), F.count_if(F.col("revision_no") > 1).alias("changed"))
    j = d.withColumnRenamed(source, "__s").join(v, F.col("__s").eqNullSafe(F.col(source)), "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return j.select(F.col("__s").alias(source), "deliveries", zero("new").alias("new"), zero("changed").alias("changed"), (F.col("deliveries") - zero("new") - zero("changed")).alias("unchanged"))


def preview(rows: DataFrame, order: list[str], k: int, flag: str) -> tuple[DataFrame, DataFrame]:
    """(the first ``k`` flagged rows, counts over all rows): the list is bounded, the counts never are."""
    return rows.where(flag).orderBy(*order).limit(k), rows.agg(F.count("*").alias("rows"), F.count_if(F.expr(flag)).alias("flagged"))


def publisher_gate(links: DataFrame, least: int = 2) -> DataFrame:
    """(event_id, media_sources, publishers, passed): two media sources, or else two publishers' domains, behind an event.

    ``links``: event_id, source_id, is_media, domain.
    """
    g = links.groupBy("event_id").agg(F.countDistinct(F.when(F.col("is_media"), F.col("source_id"))).alias("media_sources"), F.countDistinct("domain").alias("publishers"))
    return g.withColumn("passed", (F.col("media_sources") >= least) | (F.col("publishers") >= least))


def aliases_in(texts: DataFrame, key: str, text: str, names: DataFrame, name: str, longest: int = 6) -> DataFrame:
    """(key, name): the longest name that a text holds, of equal ones the last by order.

    A name of letters, digits, dashes and underscores must stand between other characters, any other name anywhere.
    Candidates come from an equi-join on runs of tokens, at most ``longest`` of them; longer names (and those without a
    token) are sought by their first ``longest`` tokens; all are verified on the text. No text meets all names.
    """
    from tidemark.functions.text import tokens

    head = lambda ts, n: F.array_join(F.slice(ts, 1, n), " ")
    n = names.where(F.col(name).isNotNull()).select(F.lower(name).alias("low"), F.col(name).alias("name")).distinct().withColumn("ts", tokens(F.col("low"))).where(F.size("ts") > 0).select("low", "name", head(F.col("ts"), longest).alias("run"))
    t = texts.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.lower(text).alias("low_text"))
    own = t.withColumn("ts", tokens(F.col("low_text"))).where(F.size("ts") > 0)
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size("ts")), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("ts") - i + 1)), lambda m: F.array_join(F.slice("ts", i, m), " "))))
    met = own.select("k", F.explode(F.array_distinct(runs)).alias("run")).join(n, "run").select("k", "low", "name").join(t, "k")
    quoted = F.concat(F.lit(r"(?<![a-z0-9])\Q"), "low", F.lit(r"\E(?![a-z0-9])"))
    holds = F.when(F.col("low").rlike(r"^[a-z0-9_-]+$"), F.regexp_like("low_text", quoted)).otherwise(F.contains("low_text", "low"))
    return met.where(holds).groupBy("k").agg(F.max_by("name", F.struct(F.length("name"), "name")).alias("name")).withColumnRenamed("k", key)
