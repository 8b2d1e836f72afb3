"""Text in one visual form: look-alike letters, widths, accents' composition, invisible characters and spaces.

A token is walked, character by character, through a trie of vocabulary words by a weighted edit automaton: a character
follows any of its readings (what it may look like) at no cost, an ignorable one stays where it is at no cost, anything
else costs ``EDIT``. Of the cheapest words that the walk ends in the most frequent is the token's canonical spelling; a
token that ends in none is spelled by the table, which takes each character's first reading. Most characters have one
reading, and there walk and table agree; a borrowed letter that looks like two (a palochka like I and l) is settled by
the word it stands in.

The vocabulary holds the commonest words that the table leaves as they are, counted over all rows, ``VOCABULARY`` of
them at most: a documented bound on what is sent to the workers. Beyond it a letter of two readings takes its first.

Defined results: null gives null; a text of nothing but ignorables and spaces gives the empty text.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.pairs import pairs_within

VOCABULARY = 20_000
EDIT = 1.0
CACHE = 200_000

# Letters of other scripts by the Latin letter they look like.
LOOKALIKES = {
    "A": "АΑᎪ", "B": "ВΒᏴ", "C": "СϹᏟ", "D": "Ꭰ", "E": "ЕΕᎬ", "F": "Ϝ", "G": "ԌᏀ", "H": "НΗᎻ", "I": "ІΙӀ", "J": "ЈͿᎫ",
    "K": "КΚᏦ", "L": "Ꮮ", "M": "МΜᎷϺ", "N": "Ν", "O": "ОΟՕ", "P": "РΡᏢ", "Q": "Ԛ", "R": "Ꭱ", "S": "ЅՏᏚ", "T": "ТΤᎢ", "U": "Ս",
    "V": "ѴᏙ", "W": "ԜᎳ", "X": "ХΧ", "Y": "ҮΥᎩ", "Z": "ΖᏃ",
    "a": "а", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡց", "h": "һհ", "i": "іⅰ", "j": "јϳ", "l": "ӏ", "n": "ո", "o": "оοօ", "p": "р",
    "q": "ԛ", "s": "ѕ", "u": "ս", "v": "ѵ", "w": "ԝ", "x": "х", "y": "у",
}

# Radicals of the supplement block by the ideograph they stand for, where Unicode gives no mapping.
RADICALS = {
    "⺁": "厂", "⺄": "乙", "⺅": "亻", "⺈": "刀", "⺉": "刂", "⺋": "㔾", "⺌": "小", "⺍": "小", "⺎": "兀", "⺏": "尣", "⺐": "尢", "⺒": "巳", "⺓": "幺",
    "⺖": "忄", "⺗": "心", "⺘": "扌", "⺙": "攵", "⺛": "旡", "⺝": "月", "⺠": "民", "⺡": "氵", "⺢": "氺", "⺣": "灬", "⺤": "爫", "⺦": "丬", "⺨": "犭",
    "⺫": "罒", "⺬": "示", "⺭": "礻", "⺮": "竹", "⺯": "糹", "⺰": "纟", "⺱": "罓", "⺲": "罒", "⺷": "羊", "⺹": "耂", "⺻": "聿", "⺼": "月", "⺽": "臼",
    "⺾": "艹", "⺿": "艹", "⻀": "艹", "⻁": "虎", "⻂": "衤", "⻃": "覀", "⻄": "西", "⻅": "见", "⻆": "角", "⻈": "讠", "⻉": "贝", "⻋": "车", "⻌": "辶",
    "⻍": "辶", "⻎": "辶", "⻏": "阝", "⻐": "钅", "⻑": "長", "⻒": "镸", "⻓": "长", "⻔": "门", "⻖": "阝", "⻗": "雨", "⻘": "青", "⻙": "韦", "⻚": "页",
    "⻛": "风", "⻜": "飞", "⻝": "食", "⻟": "飠", "⻠": "饣", "⻢": "马", "⻣": "骨", "⻤": "鬼", "⻥": "鱼", "⻦": "鸟", "⻧": "卤", "⻨": "麦", "⻩": "黄",
    "⻫": "斉", "⻬": "齐", "⻭": "歯", "⻮": "齿", "⻯": "竜", "⻰": "龙", "⻲": "亀", "⻳": "龟",
}

# Borrowed letters that look like two Latin ones, by the second; the first is in LOOKALIKES.
SECOND = {"Ӏ": "l", "І": "l", "Ι": "l", "ӏ": "I"}

_PLAIN = ("<wide>", "<narrow>", "<compat>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")


@lru_cache(1)
def _borrowed() -> dict[str, str]:
    return {x: latin for latin, others in LOOKALIKES.items() for x in others} | RADICALS


@lru_cache(65536)
def atoms(ch: str) -> tuple[str, ...]:
    """What a character looks like, in plain characters and combining marks; ignorables give none, any space one blank."""
    seen = _borrowed().get(ch)
    if seen:
        return (seen,)
    o, cat = ord(ch), unicodedata.category(ch)
    if cat in ("Zs", "Zl", "Zp") or ch in "\t\n\v\f\r\x85":
        return (" ",)
    if cat in ("Cf", "Cc") or ch in "͏ᅟᅠㅤ឴឵ﾠ⠀" or 0xFE00 <= o <= 0xFE0F or 0x180B <= o <= 0x180F or 0xE0100 <= o <= 0xE01EF:
        return ()
    how = unicodedata.decomposition(ch)
    if 0xAC00 <= o <= 0xD7A3:
        return tuple(unicodedata.normalize("NFD", ch))
    if not how:
        return (ch,)
    kind, _, rest = how.rpartition("> ")
    if kind and kind + ">" not in _PLAIN:  # raised, lowered, circled and other visible styles stay
        return (ch,)
    parts = [chr(int(x, 16)) for x in rest.split()]
    if kind and parts[0] == " " and len(parts) > 1:  # a spacing accent is not a blank with an accent
        return (ch,)
    return tuple(a for p in parts for a in atoms(p))


@lru_cache(65536)
def readings(ch: str) -> tuple[tuple[str, ...], ...]:
    """All that a character may look like; an ignorable has the empty reading."""
    second = SECOND.get(ch)
    return (atoms(ch), (second,)) if second else (atoms(ch),)


def by_table(token: str) -> str:
    """A token in plain characters, composed."""
    return unicodedata.normalize("NFC", "".join(a for ch in token for a in atoms(ch)))


class Trie:
    """Vocabulary words by their decomposed characters; each end holds its word's place in the order of preference."""

    __slots__ = ("next", "rank", "words")

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.rank: list[int | None] = [None]
        self.words: list[str] = []

    def add(self, word: str) -> None:
        """Words come in order of preference: the first spelling at an end stays."""
        at = 0
        for a in unicodedata.normalize("NFD", word):
            step = self.next[at].get(a)
            if step is None:
                step = self.next[at][a] = len(self.next)
                self.next.append({})
                self.rank.append(None)
            at = step
        if self.rank[at] is None:
            self.rank[at] = len(self.words)
            self.words.append(word)

    def _along(self, node: int, way: tuple[str, ...]) -> int | None:
        for a in way:
            step = self.next[node].get(a)
            if step is None:
                return None
            node = step
        return node

    def match(self, token: str, bound: float = 0.0) -> tuple[float, str] | None:
        """The cheapest word within ``bound`` of ``token`` and its cost; of equally cheap ones the most preferred.

        A state is a node and the cost to be there. Every reading of a character leads on at no cost, the empty one of an
        ignorable to where it is; with a bound of ``EDIT`` or more a character may also be wrong, missing or too many, at
        ``EDIT`` each.
        """
        states = self._open({0: 0.0}, bound)
        for ch in unicodedata.normalize("NFD", token):
            after: dict[int, float] = {}
            for node, cost in states.items():
                ends = [(to, cost) for way in readings(ch) if (to := self._along(node, way)) is not None]
                if cost + EDIT <= bound:
                    ends += [(to, cost + EDIT) for to in (*self.next[node].values(), node)]
                for to, c in ends:
                    if c < after.get(to, bound + 1e-9):
                        after[to] = c
            states = self._open(after, bound)
            if not states:
                return None
        ends = [(cost, self.rank[node]) for node, cost in states.items() if self.rank[node] is not None]
        return (min(ends)[0], self.words[min(ends)[1]]) if ends else None

    def _open(self, states: dict[int, float], bound: float) -> dict[int, float]:
        """States reached as well by leaving out characters of a word."""
        if bound < EDIT:
            return states
        todo = list(states)
        while todo:
            node = todo.pop()
            for step in self.next[node].values():
                if states[node] + EDIT <= bound and states[node] + EDIT < states.get(step, bound + 1e-9):
                    states[step] = states[node] + EDIT
                    todo.append(step)
        return states


class Speller:
    """Canonical texts, token by token, with a bounded memory of tokens."""

    def __init__(self, words: list[str]) -> None:
        self.trie, self.known = Trie(), {}
        for w in words:
            self.trie.add(w)

    def token(self, token: str) -> str:
        got = self.known.get(token)
        if got is None:
            hit = self.trie.match(token)
            got = hit[1] if hit else by_table(token)
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[token] = got
        return got

    def text(self, text: str) -> str:
        # spaces are found on the plain form of each character, so that any kind of space parts tokens
        cut = "".join(" " if atoms(ch) == (" ",) else ch for ch in text) if not text.isascii() else text
        out = " ".join(x for t in cut.split() if (x := self.token(t)))
        return out if " " not in out else " ".join(out.split())


@lru_cache(2)
def _speller(words: tuple[str, ...]) -> Speller:
    return Speller(list(words))


def vocabulary(texts: DataFrame, column: str, size: int = VOCABULARY) -> list[str]:
    """The commonest words that the table leaves as they are, most frequent first; counted over all rows, at most ``size``."""

    @F.pandas_udf("boolean")
    def canonical(words: pd.Series) -> pd.Series:
        return words.map(lambda w: by_table(w) == w).astype(bool)

    words = texts.where(F.col(column).isNotNull()).select(F.explode(F.split(F.col(column), r"\s+")).alias("w")).where("w <> ''").groupBy("w").count()
    # at most a quarter of common words can be in a foreign form before the list comes out shorter, which changes no result
    top = words.orderBy(F.desc("count"), "w").limit(size).where(canonical("w")).orderBy(F.desc("count"), "w")
    return [r["w"] for r in top.select("w").collect()]


def one_form(text: Column, words: list[str]) -> Column:
    """``text`` in its one visual form."""
    fixed = tuple(words)

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        s = _speller(fixed)
        return values.map(lambda v: None if v is None else s.text(v))

    return run(text)


def same_looking_pairs(df: DataFrame, kind: str, key: str, text: str) -> DataFrame:
    """(record_kind, id_a, id_b): pairs of rows whose texts differ but look the same, the smaller key first.

    Null keys, null texts and texts that come out empty take no part; repeated rows count once.
    """
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    words = vocabulary(rows, "text")
    forms = rows.groupBy("id", "text").count().drop("count").withColumn("form", one_form(F.col("text"), words)).where("form <> ''")
    return pairs_within(forms, "form", "text").select(F.lit(kind).alias("record_kind"), "id_a", "id_b")
