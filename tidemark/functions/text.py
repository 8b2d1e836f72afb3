"""Term matching, tokens, ratios and excerpts."""

from __future__ import annotations

import re
from difflib import SequenceMatcher
from os.path import commonprefix

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.identity import normalize_content


def contains_term(text: Column, term: str) -> Column:
    """Whether a lower-case text holds a term: an ASCII word only between other characters, any other term anywhere."""
    if re.fullmatch(r"[a-z0-9_-]+", term):
        return text.rlike(rf"(?<![a-z0-9]){re.escape(term)}(?![a-z0-9])")
    return text.contains(term)


def found_terms(text: Column, terms: list[str]) -> Column:
    """The terms, in their order, that a lower-case text holds."""
    return F.array_compact(F.array(*[F.when(contains_term(text, t), F.lit(t)) for t in terms])) if terms else F.array().cast("array<string>")


def first_match(text: Column, rules: list[tuple[str, list[str]]], default: Column) -> Column:
    """The label of the first rule any of whose terms stands in the text."""
    out = default
    for label, terms in reversed(rules):
        hit = F.lit(False)
        for t in terms:
            hit = hit | text.contains(t.lower())
        out = F.when(hit, F.lit(label)).otherwise(out)
    return out


def slug_title(url: Column) -> Column:
    """The last path segment as a title: without a date at its end, dashes as blanks, first letters upper case."""
    last = F.element_at(F.split(F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), "/+$", ""), "/"), -1)
    bare = F.regexp_replace(last, r"-\d{4}-\d{2}-\d{2}$", "")
    return F.initcap(F.trim(F.regexp_replace(bare, r"[-_]+", " ")))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters or digits with the marks on them; each Han character alone."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{IsHan}|[\p{L}\p{N}&&[^\p{IsHan}]][\p{L}\p{N}\p{M}&&[^\p{IsHan}]]*)"), 1), lambda t: t != "")


def length_changed(old: Column, new: Column, least: float = 0.08) -> Column:
    """Whether two non-empty texts differ in length by ``least`` of the longer."""
    a, b = F.length(old), F.length(new)
    return F.abs(a - b) / F.greatest(a, b, F.lit(1)) >= least


#: From this length on, the equal ends of two texts count as matched before the blocks between them are sought.
LONG = 10_000


def _middle(a: str, b: str) -> tuple[int, int]:
    """Lengths of the equal beginnings and of the equal ends beyond them."""
    head = len(commonprefix((a, b)))
    return head, len(commonprefix((a[head:][::-1], b[head:][::-1])))


def ratio_of(a: str | None, b: str | None, most: int | None = None) -> float:
    """Matching-block ratio of two whole texts, or of their first ``most`` characters where a caller asks for that."""
    a, b = (a or "")[:most], (b or "")[:most]
    if max(len(a), len(b)) <= LONG:
        return SequenceMatcher(None, a, b, autojunk=False).ratio()
    head, tail = _middle(a, b)
    blocks = SequenceMatcher(None, a[head : len(a) - tail], b[head : len(b) - tail], autojunk=False).get_matching_blocks()
    return 2 * (head + tail + sum(x.size for x in blocks)) / (len(a) + len(b))


def similarity(old: Column, new: Column, most: int | None = None) -> Column:
    """``ratio_of`` for a pair of columns; meant for few pairs, after ``length_changed`` has decided the rest."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([ratio_of(a, b, most) for a, b in zip(x, y)], dtype=float)

    return run(old, new)


@F.pandas_udf(T.StringType())
def first_change(old: pd.Series, new: pd.Series) -> pd.Series:
    """What the first differing stretch of two texts became, at most 80 characters a side; null where they are equal."""

    def one(a: str | None, b: str | None) -> str | None:
        a, b = a or "", b or ""
        if a == b:
            return None
        if max(len(a), len(b)) > LONG:  # equal ends of long texts are no change; the matcher sees what lies between
            head, tail = _middle(a, b)
            a, b = a[head : len(a) - tail], b[head : len(b) - tail]
        how, i, j, k, l = next(x for x in SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if x[0] != "equal")
        return f"{a[i:j].strip()[:80] or '-'} -> {b[k:l].strip()[:80] or '-'}"

    return pd.Series([one(a, b) for a, b in zip(old, new)], dtype=object)


def _changed(a: Column, b: Column, one_empty: bool, least_ratio: float, most: int | None) -> Column:
    easy = (a == b) | (a == "") | (b == "") | length_changed(a, b)
    hard = similarity(F.when(~easy, a), F.when(~easy, b), most)
    return F.when(a == b, False).when((a == "") | (b == ""), one_empty).when(length_changed(a, b), True).otherwise(hard < least_ratio)


def text_changed(old: Column, new: Column, least_ratio: float = 0.94, most: int | None = None) -> Column:
    """Whether a summary changed in substance: one side empty, or a tenth-like change of length or of matching blocks (I8).

    Texts are compared in their normalised form, so that white space, entities and markup are no change. Equal texts, and
    those whose lengths differ enough, never reach the Python ratio's cost: both are nulled first.
    """
    return _changed(normalize_content(old), normalize_content(new), True, least_ratio, most)


# Kinds of sources whose bodies are compared.
BODY_KINDS = ("html", "html_page", "rss", "github_releases")


def body_changed(old: Column, new: Column, kind: Column, least_ratio: float = 0.94, most: int | None = None) -> Column:
    """As ``text_changed`` for bodies, of sources whose bodies count only; a body that comes or goes is no change."""
    counts = F.coalesce(kind.isin(*BODY_KINDS), F.lit(False))
    a, b = normalize_content(F.when(counts, old)), normalize_content(F.when(counts, new))
    return counts & _changed(a, b, False, least_ratio, most)


# Metadata whose change is told, with its name.
TOLD = (("acceptance_status", "录用状态"), ("code_url", "代码链接"), ("project_url", "项目页"), ("amount", "金额"), ("participants", "参与方"), ("transaction_status", "交易状态"), ("regulatory_outcome", "监管结论"))
NONE, MINOR, OTHER_CHANGE = "无", "仅页面结构、链接参数或非关键元数据变化", "关键事实发生实质变化"


def short_value(value: Column, most: int = 80) -> Column:
    """A value for a sentence: normalised, cut, a dash-like word for none."""
    return F.coalesce(F.nullif(F.substring(normalize_content(value), 1, most), F.lit("")), F.lit(NONE))


def path_label(value: Column, most: int = 120) -> Column:
    """A text as one part of a stored path: runs of other characters than letters, digits, dot, dash and underscore as one dash."""
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(F.regexp_replace(value, r"[^a-zA-Z0-9._-]+", "-"), r"^[-.]+|[-.]+$", ""), 1, most), F.lit("")), F.lit("unknown"))


def change_phrases(old: dict[str, Column], new: dict[str, Column], old_meta, new_meta, minor: Column) -> Column:  # noqa: ANN001
    """Up to four phrases on what changed between two deliveries, joined; one sentence for a minor change.

    ``old`` and ``new`` hold title, summary, body; ``old_meta`` and ``new_meta`` give a metadata value by its name.
    """
    version = lambda m: F.coalesce(m("version"), m("tag_name"))
    differs = lambda a, b: ~a.eqNullSafe(b)
    n = {k: normalize_content(v) for k, v in old.items()}
    m = {k: normalize_content(v) for k, v in new.items()}
    quoted = lambda a, b: F.concat(F.lit("“"), a, F.lit("”→“"), b, F.lit("”"))
    phrases = [F.when(differs(version(old_meta), version(new_meta)), F.concat(F.lit("版本 "), F.coalesce(version(old_meta), F.lit(NONE)), F.lit("→"), F.coalesce(version(new_meta), F.lit(NONE))))]
    phrases += [F.when(differs(old_meta(k), new_meta(k)), F.concat(F.lit(label + " "), short_value(old_meta(k)), F.lit("→"), short_value(new_meta(k)))) for k, label in TOLD]
    phrases.append(F.when(n["title"] != m["title"], F.concat(F.lit("标题"), quoted(F.substring(n["title"], 1, 60), F.substring(m["title"], 1, 60)))))
    summary = text_changed(old["summary"], new["summary"])
    excerpt = first_change(n["summary"], m["summary"])
    body = body_changed(old["body"], new["body"], F.lit("html"))
    size = lambda t: F.length(t).cast("string")
    phrases.append(F.when(summary, F.concat(F.lit("核心摘要 "), excerpt)).when(body, F.concat(F.lit("正文实质更新（"), size(n["body"]), F.lit("→"), size(m["body"]), F.lit(" 字）"))))
    told = F.array_join(F.slice(F.array_compact(F.array(*phrases)), 1, 4), "；")
    return F.when(minor, F.lit(MINOR)).otherwise(F.coalesce(F.nullif(told, F.lit("")), F.lit(OTHER_CHANGE)))
