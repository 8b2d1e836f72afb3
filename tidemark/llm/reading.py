"""Reading level of documents: classic readability formulas, each mapped to a level, combined by their median.

Sentence lengths, word lengths and syllables (counted by hyphenation-style patterns of each language over its vowel
groups) feed five formulas. Thresholds that turn a formula's grade into a level are fitted on labelled documents,
per language, and apart for texts with and without sentence marks (transcripts); the document's level is the median of
the five levels.

Defined results: documents with null text, of another language or with fewer than ``LEAST_WORDS`` words get no level;
a language (and kind) with fewer than ``OWN`` labelled documents takes the thresholds of its kind in all languages, or
else of all labelled documents, and with fewer than ``OWN`` at all the ``DEFAULT`` ones. Very long texts are read whole. Repeated rows are kept as they are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_WORDS = 40
#: Labelled documents that thresholds need to be fitted on.
OWN = 20
#: Labelled documents that thresholds are fitted on, at most (the first by hash of their key).
LABELLED = 20_000
LANGUAGES = ("en", "de", "fr", "es")
FORMULAS = ("kincaid", "fog", "lix", "ari", "rix")
#: Words a sentence where a text has no sentence marks.
UNMARKED = 15.0
LEVELS = 4
DEFAULT = {"kincaid": (4.0, 9.0, 15.0), "fog": (6.0, 11.0, 17.0), "lix": (25.0, 45.0, 60.0), "ari": (4.0, 10.0, 16.0), "rix": (1.0, 4.0, 10.0)}

_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_STOP = re.compile(r"[^\W\d_][)\"'”»]*[;…]*[.!?…]+[)\"'”»]*(?=\s|$)")
_VOWELS = {"en": "aeiouy", "de": "aeiouyäöü", "fr": "aeiouyàâéèêëîïôöùûüœæ", "es": "aeiouáéíóúü"}
_GROUPS = {k: re.compile("[" + v + "]+") for k, v in _VOWELS.items()}

#: Hyphenation-style patterns: a dot is a word's end, a digit the level of the letter after it. Where patterns meet in a
#: letter the highest level holds. A letter of an odd level is a syllable's nucleus, one of an even level is none; the first
#: letter of a vowel group has level 1 without a pattern, its other letters 0.
PATTERNS = {
    "en": [
        "2e.", "2es.", "2ed.", "2ely.", "2ement", "2eful", "2eless", "2eness", "2eteen", "e3e.", "e1a1tiv", "i1a", "i1o", "i1u", "i1ent", "i1er.", "i1est.", "u1a", "u1ou", "e1o", "e1u", "y1i", "y1a", "y1e",
        "ti2o", "si2o", "ci2o", "gi2o", "ci2a", "ti2a", "si2a", "qu2a", "gu2a", "ti2e", "ci2e", "que2", "t3ed.", "d3ed.", "pe2o", "a1ing", "e1ing", "o1ing", "re1a2ct", "re1e", "re1i", "cre1at", "co1o2p", "co1or", "sci3e", "di1et", "qui1e", "o1e2t.", "li1a",
        *[c + "l3e." for c in "bcdfgkptz"], *[c + "l3es." for c in "bcdfgkptz"], *[c + "3es." for c in ("s", "z", "x", "ch", "sh", "c", "g")],
    ],
    "de": ["e1a", "e1o", "i1a", "i1o", "i1u", "i1ä", "i1ö", "u1a", "u1o", "u1i", "u1ie", "u1e", "a1o", "o1a", "o1e2r", "ä1o", "ge1e", "be1e", "ge1i", "be1i", "ge1u", "be1u", "se3um", "re1i", "re1e", "ie1u", "e2u", "a2u", "qu2a", "qu2e", "qu2i", "qu2o", "ie1r1e", "ei1e", "eu1e", "au1e", "äu1e", "aue1"],
    "fr": ["é1â", "é1en", "é1er", "2e.", "2es.", "2ent.", "é1a", "é1o", "é1i", "é1u", "a1é", "o1é", "i1é", "u1é", "a1ï", "o1ï", "é1e2.", "é1e2s.", "i2e.", "u2e.", "é2e.", "é2es.", "i1a", "cri1", "pli1", "bli1", "tri1o", "o1a", "a1o", "qu2a", "qu2e", "qu2i", "qu2o", "gu2e", "gu2i", "c3el.", "m3ent.", "c3ent.", "t3ent.", "v3ent.", "d3ent.", "g3ent.", "i3ent.", "n2ent.", "r2ent.", "s2ent."],
    "es": [*[a + "1" + b for a in "aeoáéó" for b in "aeoáéó"], *["í1" + b for b in "aeo"], *["ú1" + b for b in "aeo"], *[a + "1í" for a in "aeo"], *[a + "1ú" for a in "aeo"], "qu2e", "qu2i", "gu2e", "gu2i"],
}


@lru_cache(8)
def _parsed(lang: str) -> dict[str, list[tuple[str, list[tuple[int, int]]]]]:
    """Patterns by their first letter, as letters and (place, level) of those that have one."""
    out: dict[str, list[tuple[str, list[tuple[int, int]]]]] = {}
    for p in PATTERNS[lang]:
        letters, levels = "", []
        for ch in p:
            if ch.isdigit():
                levels.append((len(letters), int(ch)))
            else:
                letters += ch
        levels = [(i, n) for i, n in levels if i < len(letters)]
        out.setdefault(letters[0], []).append((letters, levels))
    return out


@lru_cache(200_000)
def syllables(word: str, lang: str) -> int:
    """Syllables of a lower-case word by the patterns of its language, at least one."""
    text = "." + word + "."
    level = [0] * len(text)
    for m in _GROUPS[lang].finditer(text):
        level[m.start()] = 1
    patterns = _parsed(lang)
    for i, ch in enumerate(text):
        for letters, levels in patterns.get(ch, ()):
            if text.startswith(letters, i):
                for at, n in levels:
                    level[i + at] = max(level[i + at], n)
    return max(1, sum(n % 2 for n in level))


@lru_cache(200_000)
def _of_word(word: str, lang: str) -> tuple[int, int, bool, bool]:
    s = syllables(word.lower(), lang)
    return len(word), s, s >= 3, len(word) > 6


def grades(text: str | None, lang: str | None) -> tuple[list[float], bool] | None:
    """The grade by each formula, and whether the text has sentence marks; None where no level is defined."""
    if text is None or lang not in _VOWELS or len(text.split(None, LEAST_WORDS - 1)) < LEAST_WORDS:
        return None
    found = Counter(_WORD.findall(text))
    n = sum(found.values())
    if not n:
        return None
    letters = syl = hard = long = 0
    for w, k in found.items():
        a, b, c, d = _of_word(w, lang)
        letters += a * k
        syl += b * k
        hard += c * k
        long += d * k
    stops = len(_STOP.findall(text))
    marked = stops * 60 >= n
    s = n / stops if marked else UNMARKED
    return [0.39 * s + 11.8 * syl / n - 15.59, 0.4 * (s + 100 * hard / n), s + 100 * long / n, 4.71 * letters / n + 0.5 * s - 21.43, long / n * s], marked


def thresholds(values: np.ndarray, levels: np.ndarray) -> tuple[float, ...]:
    """The cuts, in order, that put the values into 1..LEVELS with the least total distance from their labels."""
    order = np.argsort(values, kind="stable")
    v, y = values[order], levels[order]
    n = len(v)
    cost = [np.concatenate([[0.0], np.cumsum(np.abs(y - k))]) for k in range(1, LEVELS + 1)]
    same = np.concatenate([[False], v[1:] == v[:-1], [False]])  # no cut parts equal values
    total, back = np.where(same, np.inf, cost[0]), []
    for k in range(1, LEVELS):
        g = np.where(same, np.inf, total - cost[k])
        low = np.minimum.accumulate(g)
        at = np.maximum.accumulate(np.where(g <= low, np.arange(n + 1), 0))
        back.append(at)
        total = low + cost[k]
    i, cuts = n, []
    for at in reversed(back):
        i = int(at[i])
        cuts.append(float("inf") if i >= n else float(v[i] if i == 0 else (v[i] + v[i - 1]) / 2))
    return tuple(reversed(cuts))


def _grades_of(df: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """(key, lang, marked, one column a formula) of the documents that get a level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, langs, got = [], [], []
            for k, l, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                g = grades(t, l)
                if g is not None:
                    keys.append(k)
                    langs.append(l)
                    got.append([*g[0], g[1]])
            x = np.array(got, np.float64).reshape(-1, len(FORMULAS) + 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, b.column(0).type), pa.array(langs, pa.string()), pa.array(x[:, -1] > 0), *[pa.array(x[:, i]) for i in range(len(FORMULAS))]], names=["key", "lang", "marked", *FORMULAS]
            )

    kind = df.schema[key].dataType.simpleString()
    slim = df.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text")).where(F.col("lang").isin(*LANGUAGES) & F.col("text").isNotNull())
    return slim.mapInArrow(run, f"key {kind}, lang string, marked boolean, " + ", ".join(f"{f} double" for f in FORMULAS))


def fit(documents: DataFrame, labels: DataFrame, key: str, text: str, lang: str, level: str, most: int = LABELLED) -> dict[tuple[str, bool], dict[str, tuple[float, ...]]]:
    """Thresholds by (language, marked), from the median label of each labelled document."""
    known = labels.where(F.col(level).between(1, LEVELS) & F.col(key).isNotNull()).groupBy(key).agg(F.avg(level).alias("level"))
    chosen = known.orderBy(F.xxhash64(key), key).limit(most)  # at most ``most`` keys, so they are broadcast: no text is shuffled
    rows = _grades_of(documents.join(F.broadcast(chosen.select(key)), key, "left_semi"), key, text, lang).join(chosen.withColumnRenamed(key, "key"), "key").toPandas()
    out: dict[tuple[str, bool], dict[str, tuple[float, ...]]] = {}
    for l in LANGUAGES:
        for marked in (True, False):
            own = rows[(rows["lang"] == l) & (rows["marked"] == marked)]
            use = own if len(own) >= OWN else rows[rows["marked"] == marked] if (rows["marked"] == marked).sum() >= OWN else rows
            out[l, marked] = {f: thresholds(use[f].to_numpy(float), use["level"].to_numpy(float)) for f in FORMULAS} if len(use) >= OWN else DEFAULT
    return out


def _level(cuts: tuple[float, ...], grade: Column) -> Column:
    return sum((F.when(grade >= c, 1).otherwise(0) for c in cuts if c != float("inf")), F.lit(1))


def reading_levels(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", level: str = "reading_level") -> DataFrame:
    """(key, level): the median of the levels by five formulas."""
    cuts = fit(documents, labels, key, text, lang, level)
    each = []
    for f in FORMULAS:
        c = F.lit(None).cast("int")
        for (l, marked), by in cuts.items():
            c = F.when((F.col("lang") == l) & (F.col("marked") == marked), _level(by[f], F.col(f))).otherwise(c)
        each.append(c)
    middle = F.element_at(F.array_sort(F.array(*each)), len(FORMULAS) // 2 + 1)
    return _grades_of(documents, key, text, lang).select(F.col("key").alias(key), middle.alias(level))
