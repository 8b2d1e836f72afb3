"""The main body of web pages: the maximum-scoring run of lines.

Words score by their log-odds of standing in an article, named elements by theirs, and so does how a line ends and how
long it is where it ends without a mark (as other pages' headlines do); all weights are fitted on labelled pages, which are
the pages whose own markup says what is article and what is furniture. What pages put into their articles' own element
(bylines, dates, comment openings) is known by forms of lines that recur under many headlines, learned from the same
pages. A linear scan finds the contiguous run of lines with the greatest sum. Within the run, lines that score below zero
drop out.

Defined results: a null, empty or undecodable field has no lines; a page whose best run stays under ``LEAST`` has no
article. Bytes that aren't UTF-8 are decoded with replacement marks. Very long pages are scanned whole.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled pages that the weights are fitted on at most (the first by hash of their key).
LABELLED = 1500
#: A run must score this much to be an article.
LEAST = 4.0
#: What a line scores at most for and against; a headline that the page names scores ``HEAD``.
MOST, WORST, HEAD = 3.0, 5.0, 8.0
#: What furniture inside an article and a copyright line cost: an article goes on after the one, not after the other.
INSERT, STOP = 0.5, 20.0
#: Log-odds this near zero count as none.
SHRINK = 1.5

#: A form of line counts as furniture where this share of the labelled pages' headlines have it, and ``FORMS`` of them at least.
FORM_SHARE, FORMS = 0.004, 4
# Sections that hold no article text, in markup that names them.
OUTSIDE = ("nav", "aside", "footer", "dialog", "header", "form")
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
HIDDEN = ("script", "style", "head", "noscript", "template", "svg")

# Containers that sites use alike for anything; they say nothing of what they hold.
GENERIC = {"div", "p", "table", "tbody", "tr", "td"}

_TAG = re.compile(r"<[^<>]*>")
_LINK = re.compile(r"(?is)<a\b.*?</a>")
_WORD = re.compile(r"[^\W\d_]+|\d+|[|>©]")
_NAME = re.compile(r"</?\s*([a-zA-Z][a-zA-Z0-9]*)")


def tidy(text: str) -> str:
    return " ".join(html.unescape(_TAG.sub("", text)).replace("﻿", "").split())


def words(text: str) -> list[str]:
    """Words in lower case, digits as #; the first two words count as an opening of their own, a short line also as a whole."""
    got = ["#" if w[0].isdigit() else w.lower() for w in _WORD.findall(text)]
    end = "$stop" if text and text[-1] in ".;:!,?…\"'”)" else "$none" if len(got) < 5 else "$title" if len(got) <= 16 else "$open"
    return got + (["^" + " ".join(got[:2])] if got else []) + [end] + (["=" + " ".join(got)] if 0 < len(got) <= 6 else [])


STOPS = tuple(".!?…")
_SHAPE = re.compile(r"([^\W\d_]+(?:['’.-][^\W\d_]+)*)|\d+|[^\w\s]")


def forms(text: str) -> list[str]:
    """What a line has in common with others of its kind: its shape as a whole, where short, and its opening up to a first mark.

    In a shape numbers are #, and capitalised words but the first are runs of A, so that bylines and dates of all pages
    share theirs; a sentence has none. An opening is the words up to a first stop or bar, four at most, where more follows;
    up to a colon only where no sentence follows.
    """
    ended = text[-1:] in STOPS
    out, words_ = [], 0
    for m in _SHAPE.finditer(text):
        w = m.group()
        if m.group(1):
            words_ += 1
            w = "A" if words_ > 1 and w[0].isupper() else w.lower()
        elif w[0].isdigit():
            w = "#"
        if not (out and w == out[-1] and w in "A#"):
            out.append(w)
        if len(out) > 16:
            break
    got = ["~" + " ".join(out)] if 2 <= len(out) <= 14 and words_ <= 10 and any(w in "A#|:>" for w in out) and not ended else []
    first = next((i for i, w in enumerate(out[:6]) if w in ".!:|"), None)
    if first and first <= 4 and first + 1 < len(out) and not (ended and out[first] == ":") and not any(w in "A#" for w in out[:first]):
        got.append("^~" + " ".join(out[: first + 1]))
    return got


def lines_of(page: str, markup: bool) -> list[tuple[str, list[str], str]]:
    """(text, tags, section) of each line; section is '' in the open, or the innermost naming element around it."""
    if not markup:
        return [(" ".join(x.split()), [], "") for x in page.split("\n")]
    out, stack, tag_open = [], [], False
    for raw in page.split("\n"):
        tags = []
        inside = stack[-1] if stack else ""
        for m in re.finditer(r"<(/?)\s*([a-zA-Z][a-zA-Z0-9]*)", raw):
            name = m.group(2).lower()
            tags.append(m.group(1) + name)
            if name in OUTSIDE or name in HIDDEN or name in ("article", "main"):
                if not m.group(1):
                    stack.append(name)
                    inside = name if name in HIDDEN or inside not in HIDDEN else inside
                elif name in stack:
                    while stack and stack.pop() != name:
                        pass
        if "a" in tags and tidy(_LINK.sub("", raw)):  # a link within a text is another thing than a line that is a link
            tags = [t + "+" if t in ("a", "/a") else t for t in tags]
        out.append((tidy(raw), tags, next((s for s in stack if s in HIDDEN), inside) or inside))
    return out


def fit(pages: list[str]) -> dict[str, float]:
    """Log-odds of words, tags and whole short lines, from pages whose markup has an article element.

    Words of a line that many pages share count once, so that one site's footer can't outweigh what articles say;
    short lines as wholes count on every page. "" holds the odds before any word is seen.
    """
    good, bad, whole = Counter(), Counter(), (Counter(), Counter())
    labelled = [lines_of(p, True) for p in pages]
    outside = {re.sub(r"\d", "#", t) for ls in labelled for t, _, s in ls if t and s in OUTSIDE}
    furniture = furniture_forms(labelled)
    seen: set[tuple[str, ...]] = set()
    count = [1, 1]
    for ls in labelled:
        for i, (text, tags, section) in enumerate(ls):
            if not text or section in HIDDEN or section in ("article", "main") and not furniture.isdisjoint(forms(text)):
                continue  # known by their form; what comments and other headlines say isn't held against their words
            is_article = section in ("article", "main") and re.sub(r"\d", "#", text) not in outside
            got = words(text)
            if got and got[-1][0] == "=":
                whole[is_article][got.pop()] += 1
            got += ["<" + t for t in tags if t.lstrip("/") not in GENERIC]
            if (is_article, *got) not in seen:
                seen.add((is_article, *got))
                count[is_article] += 1
                (good if is_article else bad).update(set(got))
    p, n = sum(good.values()) + 1, sum(bad.values()) + 1
    share = p / (p + n)

    def odds(w: str) -> float:
        """Shrunk by ``SHRINK``: words that both kinds of line use say nothing."""
        x = math.log((good[w] + share) / p) - math.log((bad[w] + 1 - share) / n)
        return math.copysign(max(0.0, min(5.0, abs(x)) - SHRINK), x)

    out = {w: odds(w) for w in good.keys() | bad.keys()}
    if "<a" not in out:  # a sample without a line that is a link says nothing of such lines: tags are negative
        out |= {"<a": -WORST, "</a": -WORST}
    lines = [sum(c.values()) + 1 for c in whole]
    of = lines[1] / sum(lines)
    out |= {w: max(-8.0, min(8.0, 2 * (math.log((whole[1][w] + of) / lines[1]) - math.log((whole[0][w] + 1 - of) / lines[0])))) for w in whole[0].keys() | whole[1].keys() if whole[0][w] + whole[1][w] >= 3}
    return {w: round(x, 4) for w, x in (out | {"": math.log(count[1] / count[0])} | dict.fromkeys(furniture, -INSERT)).items() if x}


def furniture_forms(pages: list[list[tuple[str, list[str], str]]]) -> set[str]:
    """Forms of lines that recur under many headlines: what pages put beside or into their articles, not what articles say.

    Copies of a page share its headline and count once; sub-headings and the headline itself are no furniture, however
    often they recur.
    """
    under: dict[str, set[str]] = {}
    for ls in pages:
        head = next((t for t, tags, _ in ls if "h1" in tags and t), "") or next((t for t, _, s in ls if s == "article" and t), "")
        for text, tags, section in ls:
            if text and section not in HIDDEN and not HEADINGS & set(tags):
                for f in forms(text):
                    under.setdefault(f, set()).add(head)
    heads = {h for hs in under.values() for h in hs}
    return {f for f, hs in under.items() if len(hs) >= max(FORMS, FORM_SHARE * len(heads))}


def plain(text: str | None) -> str:
    """A headline in a comparable form."""
    from tidemark.llm.lookalike import by_table

    return by_table(" ".join((text or "").split())).strip().casefold()


def article_lines(page: str, markup: bool, title: str | None, weights: dict[str, float]) -> list[int]:
    """Numbers, from 1, of the lines of the article."""
    lines = lines_of(page, markup)
    heads = {plain(title)} if title else set()
    if markup and (m := re.search(r"(?is)<title>(.*?)</title>", page)):
        heads |= {plain(tidy(m.group(1)).rsplit(" | ", 1)[0])}
    heads.discard("")
    scores: list[float] = []
    head = None
    for i, (text, tags, section) in enumerate(lines):
        if not text or section in HIDDEN or section in OUTSIDE:
            scores.append(-WORST if text else 0.0)
        elif head is None and "a" not in tags[:1] and plain(text) in heads:
            head = i
            scores.append(HEAD)
        elif text.startswith("©"):
            scores.append(-STOP)
        elif (any(f in weights for f in forms(text)) or _barred(text) or "a" in tags and weights.get("<a", 0.0) < 0 and text[-1] not in STOPS) and not HEADINGS & set(tags):
            scores.append(-INSERT)
        else:
            s = weights.get("", 0.0) + sum(weights.get(w, 0.0) for w in words(text)) + sum(weights.get("<" + t, 0.0) for t in tags if t.lstrip("/") not in GENERIC)
            scores.append(min(MOST, s) if s > 0 else -INSERT if head is not None else max(-WORST, s))
    best, at, total, start = LEAST, None, 0.0, 0
    for i, s in enumerate(scores):
        if i == head or total <= 0 and (head is None or i < head):  # nothing before the headline is the article
            total, start = 0.0, i
        total += s
        if total > best:
            best, at = total, (start, i)
        if i == head:
            best, at = HEAD, (head, head)
    return [i + 1 for i in range(at[0], at[1] + 1) if scores[i] > 0] if at else []


def _barred(text: str) -> bool:
    """Whether a line is parts set apart by bars, as bylines and menus are, and no sentence."""
    return " | " in text and text[-1] not in STOPS


@lru_cache(2)
def _table(items: tuple[tuple[str, float], ...]) -> dict[str, float]:
    return dict(items)


def body_lines(df: DataFrame, key: str, text_field: str, page_field: str, title: str, most: int = LABELLED) -> DataFrame:
    """(record_id, field_name, line_no) of every line of article text in the plain and the marked-up field.

    Repeated rows give their lines once.
    """
    mark = F.encode(F.lit("<article"), "UTF-8") if dict(df.dtypes)[page_field] == "binary" else F.lit("<article")
    labelled = df.select(key, F.col(page_field).alias("p")).where(F.contains(F.col("p"), mark)).orderBy(F.xxhash64(key), key).limit(most)

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pages = [bytes(p).decode("utf-8", "replace") if not isinstance(p, str) else p for b in batches for p in b["p"]]
        found = fit(pages)
        yield pd.DataFrame({"word": list(found), "weight": list(found.values())})

    # one task fits them all; only weights reach the driver
    weights = tuple(sorted((r["word"], r["weight"]) for r in labelled.select("p").coalesce(1).mapInPandas(fitted, "word string, weight double").collect()))

    @F.pandas_udf("array<int>")
    def of_text(texts: pd.Series, titles: pd.Series) -> pd.Series:
        w = _table(weights)
        return pd.Series([article_lines(t, False, h, w) if t else [] for t, h in zip(texts, titles)])

    @F.pandas_udf("array<int>")
    def of_page(pages: pd.Series, titles: pd.Series) -> pd.Series:
        w = _table(weights)
        return pd.Series([article_lines(bytes(p).decode("utf-8", "replace") if not isinstance(p, str) else p, True, h, w) if p else [] for p, h in zip(pages, titles)])

    both = df.select(F.col(key).alias("record_id"), of_text(text_field, title).alias("a"), of_page(page_field, title).alias("b"))
    found = F.array(F.struct(F.lit(text_field).alias("field_name"), F.col("a").alias("lines")), F.struct(F.lit(page_field).alias("field_name"), F.col("b").alias("lines")))
    each = both.select("record_id", F.explode(found).alias("x")).where(F.size("x.lines") > 0).select("record_id", "x.field_name", "x.lines").distinct()
    return each.select("record_id", "field_name", F.explode("lines").alias("line_no"))
