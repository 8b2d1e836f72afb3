"""Topic rules compiled into Column expressions: one pass over a row, no join with a table of terms."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import contains_term, found_terms


@dataclass(frozen=True)
class TopicRule:
    """A topic with its terms: ``hard`` ones qualify, ``boosters`` add strength, ``required`` must be met by one, ``kinds`` qualify by event type."""

    topic: str
    hard: tuple[str, ...] = ()
    boosters: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    exempt: tuple[str, ...] = field(default=())

    def qualifies(self, text: Column, kind: Column) -> Column:
        any_of = lambda terms: F.coalesce(F.array_size(found_terms(text, list(terms))) > 0, F.lit(False))
        base = any_of(self.hard) | (kind.isin(*self.kinds) if self.kinds else F.lit(False))
        return base & (any_of(self.required) | any_of(self.exempt)) if self.required else base

    def strength(self, text: Column) -> Column:
        """16, plus 4 a hard term and 2 a booster, at most 30."""
        return F.least(F.lit(30), 16 + 4 * F.size(found_terms(text, list(self.hard))) + 2 * F.size(found_terms(text, list(self.boosters))))


def classify(text: Column, kind: Column, rules: list[TopicRule]) -> Column:
    """array of (topic, strength, terms), in the rules' order, of the rules that qualify."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    each = [
        F.when(r.qualifies(lower, F.coalesce(kind, F.lit(""))), F.struct(F.lit(r.topic).alias("topic"), r.strength(lower).alias("strength"), F.concat(found_terms(lower, list(r.hard)), found_terms(lower, list(r.boosters))).alias("terms")))
        for r in rules
    ]
    return F.array_compact(F.array(*each))


def tags(text: Column, terms: dict[str, list[str]]) -> Column:
    """The tags any of whose terms a text holds, in their order."""
    lower = F.lower(F.coalesce(text, F.lit("")))

    def any_of(ts: list[str]) -> Column:
        hit = F.lit(False)
        for t in ts:
            hit = hit | contains_term(lower, t.lower())
        return hit

    return F.array_compact(F.array(*[F.when(any_of(ts), F.lit(tag)) for tag, ts in terms.items()]))


# Kinds of events by the terms that tell them, in their order; a computing investment needs a co-term too.
EVENT_TERMS = (
    ("IPO_FILING", ("ipo", "listing application", "prospectus", "招股书", "上市申请")),
    ("RAISE", ("funding round", "raised", "financing", "placing", "placement", "subscription of new shares", "allotment", "融资", "募资", "配售", "增发", "认购新股")),
    ("M_AND_A", ("acquisition", "merger", "takeover", "收购", "并购", "合并")),
    ("CAPEX_COMPUTE", ("capital expenditure", "data center", "gpu cluster", "算力投资", "资本开支")),
    ("MATERIAL_CONTRACT", ("material contract", "重大合同")),
    ("EARNINGS_GUIDANCE", ("earnings guidance", "revenue guidance", "业绩指引", "盈利预告")),
    ("OWNERSHIP", ("beneficial ownership", "shareholding", "持股", "权益变动")),
    ("REGULATORY_EXPORT", ("export control", "regulatory action", "出口管制", "监管决定")),
)
COMPUTE_TERMS = ("gpu", "accelerator", "ai infrastructure", "artificial intelligence infrastructure", "data center", "datacenter", "算力", "智算")
PAPER_KINDS = ("arxiv_api", "arxiv_oai", "openreview_api", "acl_anthology", "pmlr")


def event_type(text: Column, kind: Column, terms: tuple = EVENT_TERMS, co_terms: tuple[str, ...] = COMPUTE_TERMS) -> Column:
    """The kind of event that a normalised text tells of: the first rule any of whose terms it holds, else by the kind of its source."""
    low = F.lower(text)
    held = lambda ts: F.greatest(*[low.contains(t) for t in ts], F.lit(False))
    out = F.when(kind.isin(*PAPER_KINDS), "PAPER").when(kind == "github_releases", "RELEASE").when(kind == "huggingface_models", "MODEL_RELEASE").otherwise("PUBLICATION")
    for label, ts in reversed(terms):
        out = F.when(held(ts) & held(co_terms) if label == "CAPEX_COMPUTE" else held(ts), label).otherwise(out)
    return out


def filing_event_type(form: Column, items: Column, otherwise: Column) -> Column:
    """The kind of event a filing's form and items tell, else ``otherwise``."""
    f, i = F.coalesce(form, F.lit("")), F.coalesce(items, F.lit(""))
    starts = lambda *ps: F.greatest(*[f.startswith(p) for p in ps], F.lit(False))
    current = starts("8-K", "6-K")
    return (
        F.when(starts("S-1", "F-1", "424B"), "IPO_FILING").when(starts("4", "SC 13D", "SC 13G"), "OWNERSHIP").when(current & (i.contains("1.01") | i.contains("1.02")), "MATERIAL_CONTRACT")
        .when(current & i.contains("2.01"), "M_AND_A").when(current & i.contains("3.02"), "RAISE").otherwise(otherwise)
    )


def verification_of(evidence: Column) -> Column:
    """The standing of what one source says, by its kind of evidence."""
    first = ("paper", "regulatory_filing", "exchange_filing", "official_filing", "official_repo", "official_standard")
    return F.when(evidence.isin(*first), "verified_primary").when(evidence == "official_company", "company_claim").otherwise("reported_unconfirmed")


def combined_verification(current: Column, supporting: Column) -> Column:
    """The standing of two accounts of one thing: any corroboration, or a primary source beside another, corroborates."""
    either = lambda v: (current == v) | (supporting == v)
    both = lambda v: (current == v) & (supporting == v)
    return F.when(either("corroborated"), "corroborated").when(both("reported_unconfirmed"), "reported_unconfirmed").when(both("company_claim"), "company_claim").when(either("verified_primary"), "corroborated").when(either("company_claim"), "company_claim").otherwise(current)


def shown_evidence(evidence: Column, source_type: Column) -> Column:
    """The evidence label shown, by the stated evidence or the source's type, in order of precedence."""
    e, s = F.coalesce(evidence, F.lit("")), F.coalesce(source_type, F.lit(""))
    return (
        F.when((e == "paper") | s.isin(*PAPER_KINDS), "paper").when(e.isin("regulatory_filing", "exchange_filing", "official_filing") | s.isin("sec_submissions", "exchange_filing"), "official_filing")
        .when((e == "official_repo") | s.isin("github_releases", "huggingface_models"), "open_source_release").when((e == "reputable_media") | s.isin("reputable_media", "sitemap", "rss"), "reputable_media").otherwise("official_company")
    )


def entity_kind(entity: Column, is_issuer: Column) -> Column:
    """What an entity is: authors by their mark, issuers by the list, four known projects, else a company."""
    return F.when(entity.startswith("author:"), "author_group").when(is_issuer, "issuer").when(entity.isin("mcp", "a2a", "terminal_bench", "gaia"), "project").otherwise("company")


# What is said of a state where nothing else is known.
STATE_TEXT = {"NEW_ENTITY": "首次收录", "MATERIAL_UPDATE": "标题、核心摘要、版本或关键事实发生实质变化", "MINOR_UPDATE": "页面或非关键元数据变化，仅更新归档", "DISCOVERED_LATE": "来源时间早于本次采集窗口，属于迟发现事件"}


def state_text(status: Column) -> Column:
    """The default sentence for a state; null for an unknown one."""
    out = F.lit(None).cast("string")
    for k, v in STATE_TEXT.items():
        out = F.when(status == k, v).otherwise(out)
    return out
