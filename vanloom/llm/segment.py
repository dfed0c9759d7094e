"""Problem 7: sentence boundaries across languages and scripts.

Segmentation by cascading rule tables. A rule is a pair of regular expressions, one for the text before a
position and one for the text after it, and says break or no break; the tables of a
language come before the common ones, and the first rule that matches decides the position. Positions inside
a quotation or a bracket are never open, which keeps a quotation and its attribution together. Line
breaks always separate.

Null and empty texts have no sentences. Texts are handled whole. Unknown or missing language codes are
replaced by a guess from script and function words.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``breaks`` at a position if the text before ends in ``before`` and the text after starts with ``after``; None matches always.

    What comes before is matched backwards from the position, so the time of a rule does not depend on where in the text it is.
    """

    breaks: bool
    before: regex.Pattern | None
    after: regex.Pattern | None

    def decides(self, text: str, pos: int) -> bool:
        return (self.before is None or self.before.match(text, 0, pos) is not None) and (self.after is None or self.after.match(text, pos) is not None)


def _rule(breaks: bool, before: str, after: str = "") -> Rule:
    return Rule(breaks, regex.compile(before, regex.REVERSE) if before else None, regex.compile(after) if after else None)


_NEW = r"\s*[\p{Lu}\p{Lt}]"
_OPEN = r"[“\"«‘'(\[]?\s?"
_VI_TITLE = r"anh|chị|em|bà|ông|cô|chú|bác|cháu|thầy|bé|Anh|Chị|Em|Bà|Ông|Cô|Chú|Bác|Cháu|Thầy|Bé"
#: Titles, administrative units and the like that always want a name after them.
_VI_ABBR = r"PGS|GS|TSKH|TS|ThS|Ths|BS|BSCK|LS|KS|KTS|DS|NSND|NSƯT|CN|TP|Tp|TX|Tx|TT|Tt|Ths|ĐD|Kp|KP|St|Mr|Mrs|Ms|Dr|Th\s?\.\s?S"
_DASH = r"[–—-]"

VIETNAMESE = (
    _rule(False, rf"(?<![\p{{L}}\p{{N}}])(?:{_VI_ABBR})\s?\.", r"\s*\.?\s*[\p{L}\p{N}]"),
    # Q., P., H., X. before a place; after a person's name or form of address the letter is an initial instead.
    _rule(False, rf"(?:^|[.!?:;,”–-]\s+|[\n(“]\s*|(?<!\p{{L}})(?!(?:{_VI_TITLE})\s)(?:\p{{Ll}}+|\p{{Lu}}{{2,}}|Ở|Tại|Thuế|Tòa|Tỉnh|Công an)\s+)[QPHXĐF]\s?\.", r"\s*\p{Lu}\p{Ll}*"),
    _rule(False, r"(?<![\p{L}\p{N}])\p{Lu}\s?\.", r"\s*\d+\s+(?:năm|tháng|lần)\b"),
    _rule(False, r"(?<![\p{L}\p{N}])(?:số|Số|điều|khoản|tr|đ)\s?\.", r"\s*[\p{Ll}\d]"),
)
ENGLISH = (
    _rule(False, r"(?<![\p{L}\p{N}])(?:Mr|Mrs|Ms|Dr|Prof|Sgt|Lt|Capt|Col|Gen|Rev|Hon|St|Insp|Det|Messrs|vs|cf|viz|e\.g|i\.e)\s?\.", r"\s*\S"),
    _rule(False, r"(?<![\p{L}\p{N}])(?:No|Nos|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept?|Oct|Nov|Dec|[Aa]rt|pp?|[Vv]ol|[Ff]ig|[Ss]ec|ca?)\s?\.", r"\s*\d"),
    _rule(False, r"(?<![\p{L}\p{N}])U\.\s?[SKN]\.", r"\s+\p{Lu}"),
)
FRENCH = (
    _rule(False, r"(?<![\p{L}\p{N}])(?:MM?|Mme|Mlle|Me|Dr|Pr|St|Ste|Mgr)\s?\.", r"\s*\S"),
    _rule(False, r"(?<![\p{L}\p{N}])(?:[Aa]rt|[Nn]o?s?|pp?|al|[Ff]ig|janv|févr|avr|juil|sept|oct|nov|déc|env|av)\s?\.", r"\s*[\d\p{Ll}]"),
)
#: Latin-script rules after those of the language.
LATIN = (
    _rule(False, r"", r"\s*[,;:)\]]|\s*" + _DASH + r"|\s*\(\s?\p{Ll}|\s*\p{Ll}"),
    # Without a space: only between a word or number and a new capitalised word, or at a quotation.
    _rule(True, r"(?:[\p{Ll}\p{N}%²”\"»)]|\p{L}{2}|\p{L}\p{M})\s?[.!?…\s]*[.!?…][”\"»’)]*", r"\p{Lu}(?:\p{Ll}|\p{Lu}+\s)|[“«]"),
    _rule(True, r"[\p{Ll}%”\"»)]\s?[.!?…\s]*[.!?…]", r"\d+\s\p{L}|\p{Lu}\.\s?\p{Lu}"),
    _rule(True, r"(?:[\p{L}\p{N}]{2}|[%”\"»)])\s?[.!?…\s]*[.!?…]", rf"(?:(?:{_VI_ABBR}|Mr|Mrs|Dr)\s?\.\s?)+\p{{Lu}}"),
    _rule(True, rf"(?:\p{{Lu}}\p{{Ll}}+\s|\p{{Lu}}\.\s?|(?<!\p{{L}})(?:{_VI_TITLE})\s)\p{{Lu}}\s?\.", rf"\p{{Lu}}\p{{Ll}}+\s|\p{{Lu}}{{2,}}|(?:{_VI_ABBR})\s?\.\s?\p{{Lu}}"),
    _rule(False, r"\S", r"\S"),
    _rule(True, r"", rf"\s+{_OPEN}[\p{{Lu}}\p{{Lt}}\p{{Lo}}\p{{N}}]|\s*$|\s+[“\"«‘(\[]|\s+[^\p{{L}}\p{{N}}\s]"),
)
IDEOGRAPHIC = (
    _rule(False, r"", r"\s*[，、；：）」』》,;]|\s*[)\]]"),
    _rule(False, r"[.]", r"\s*[\p{Ll}\d]|\p{L}"),
    _rule(True, r"", r""),
)
DEVANAGARI = (
    _rule(False, r"[.]", r"\s*\S"),
    _rule(False, r"", r"\s*[,;:)\]]"),
    _rule(True, r"", r""),
)
GERMAN = (
    _rule(False, r"(?<![\p{L}\p{N}])(?:Hr|Fr|Dr|Prof|Dipl|Ing|St|vgl|bzw|ca|evtl|ggf|inkl|Nr|Abs|Art|Str|[zZ]\.\s?B|[dD]\.\s?h|u\.\s?a|i\.\s?d\.\s?R|[zZ]|[dD]|u)\s?\.", r"\s*\S"),
    _rule(False, r"(?<![\p{L}\p{N}])\d{1,2}\s?\.", r"\s*(?:Jan|Feb|Mär|Apr|Mai|Jun|Jul|Aug|Sep|Okt|Nov|Dez|Jahrhundert|\p{Ll}|\d{1,2}\s?\.)"),
)
THAI = (_rule(False, r"", r"[ \u00a0]+(?:พ\.?ศ|ค\.?ศ|ปี\s?\d|เวลา\s?\d)"), _rule(False, r"[^ \u00a0]", r"[^ \u00a0]"))
#: Scripts with an end mark of their own, which always ends a sentence; a full stop only before a space.
MARKED = (
    _rule(False, r"[.]", r"\s*[\p{Ll}\d]|\S"),
    _rule(False, r"", r"\s*[,;:)\]،؛፣፤፥]"),
    _rule(True, r"", r""),
)
TABLES: dict[str, tuple[Rule, ...]] = {
    "vi": VIETNAMESE + LATIN,
    "en": ENGLISH + LATIN,
    "fr": FRENCH + LATIN,
    "zh": IDEOGRAPHIC,
    "ja": IDEOGRAPHIC,
    "hi": DEVANAGARI,
    "de": GERMAN + LATIN,
    "th": THAI,
    "my": MARKED,
    "km": MARKED,
    "am": MARKED,
    "ar": MARKED,
    "": VIETNAMESE + ENGLISH + LATIN,
}
#: Positions a rule may decide: after end marks (spaced ones too) and the closing marks behind them.
_END = regex.compile(r"[.!?…。！？｡।॥။។៕።؟۔](?:[  ]?[.!?…。！？｡।॥။។៕።؟۔])*(?:[  ]?[”»’」』）)\]]|\"(?!\w))*")
_PAIRED = re.compile("[“「『«‘\"(（]")
_QUOTE = regex.compile(r"“[^“”\n]*”|「[^「」\n]*」|『[^『』\n]*』|«[^«»\n]*»|‘[^‘’\n]{12,}’(?!\p{L})|(?<![\p{L}\p{N}])\"[^\"\n]*\"|\([^()\n]*\)|（[^（）\n]*）")
_MARK = regex.compile(r"[.!?…。！？｡।॥။។៕።؟۔]")
#: Languages whose sentences end at spaces: where those are that the rules decide on.
SPACED_OUT = {"th": regex.compile(r"(?<=[฀-๿”)])[ \u00a0]+(?=[฀-๿“(])")}
LATIN_TABLES = ("vi", "en", "fr", "de")
_LANGS = {"vi": "vi", "vie": "vi", "en": "en", "eng": "en", "fr": "fr", "fra": "fr", "zh": "zh", "zho": "zh", "ja": "ja", "jpn": "ja", "th": "th", "tha": "th", "hi": "hi", "hin": "hi", "de": "de", "deu": "de", "ger": "de"}
_WORDS = {
    "vi": regex.compile(r"\b(?:của|và|tại|ngày|người|được|các|cho|đã|là|ở|với)\b"),
    "en": regex.compile(r"\b(?:the|of|and|to|that|was|were|with|from|had)\b", regex.I),
    "de": regex.compile(r"\b(?:der|und|ist|nicht|mit|von|wurde|eine?)\b", regex.I),
    "fr": regex.compile(r"\b(?:le|la|les|des|du|une?|et|à|est|avec|dans|pour)\b", regex.I),
}


_SCRIPTS = (("th", ((0x0E00, 0x0E80),)), ("ja", ((0x3040, 0x3100),)), ("hi", ((0x0900, 0x0980),)), ("zh", ((0x4E00, 0xA000),)), ("my", ((0x1000, 0x10A0),)), ("km", ((0x1780, 0x1800),)), ("ar", ((0x0600, 0x0700),)), ("am", ((0x1200, 0x1380),)))


@lru_cache(1)
def _script_of() -> np.ndarray:
    """Per code point: 0 for no letter, 1 for a letter, more for one of _SCRIPTS."""
    out = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x32000)), dtype=np.uint8, count=0x32000)
    for k, (_, ranges) in enumerate(_SCRIPTS, 2):
        for a, z in ranges:
            out[a:z] = k
    return out


def language(code: str | None, text: str) -> str:
    """Table name for a text; a script that a quarter of the letters have overrules a code that contradicts it."""
    head = (code or "").strip().lower().replace("_", "-").split("-")[0]
    if not text.isascii():
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        n = np.bincount(_script_of()[points[points < 0x32000]], minlength=2 + len(_SCRIPTS))
        letters = n[1:].sum()
        for k, (name, _) in enumerate(_SCRIPTS, 2):
            if 4 * n[k] > letters:
                return name
    got = _LANGS.get(head, "")
    if got in LATIN_TABLES:
        return got
    hits = {k: len(rx.findall(text)) for k, rx in _WORDS.items()}
    best = max(hits, key=lambda k: hits[k])
    return best if hits[best] else ""


_GAP = " \u00a0"
_LINE = re.compile("[\\n\\r\u2028\u2029]")
_CONTENT = re.compile(r"[^\W_]")
_ATTRIBUTION = regex.compile(r"\s*[\p{Ll},;:,、–-]")


def _before(text: str, at: int) -> str:
    """The last character before ``at`` that is no gap."""
    while at > 0 and text[at - 1] in _GAP:
        at -= 1
    return text[at - 1 : at]


def sentences(text: str | None, code: str | None = None) -> list[tuple[int, int]]:
    """Start and end (exclusive) of every sentence, in code points, without surrounding white space."""
    if not text:
        return []
    lang = language(code, text)
    rules = TABLES[lang]
    cuts = {m.start() for m in _LINE.finditer(text)}
    if lang in SPACED_OUT:
        cuts |= {m.start() for m in SPACED_OUT[lang].finditer(text) if not any(not r.breaks and r.decides(text, m.start()) for r in rules)}
    shut: dict[int, tuple[int, bool]] = {}
    closed: list[tuple[int, int]] = []
    if _PAIRED.search(text):
        for m in _QUOTE.finditer(text):
            closed.append(m.span())
            shut[m.end()] = (m.start(), _before(text, m.start()) in (":", "："))
    k = 0
    for m in _END.finditer(text):
        pos = m.end()
        while k < len(closed) and closed[k][1] <= m.start():
            k += 1
        if k < len(closed) and closed[k][0] <= m.start() < closed[k][1]:
            a, z = closed[k]
            if pos < z or text[a] in "(（":
                continue
            # The end mark is the quotation's own. What follows is its attribution unless it was introduced before.
            if not (text[z:pos].strip() and _MARK.search(text, z, pos)) and (not shut[z][1] or _ATTRIBUTION.match(text, z)):
                continue
            pos = max(pos, z)
        if lang in SPACED_OUT and m.group()[0] in ".!?…":
            # A mark of another script decides nothing by itself there.
            continue
        for r in rules:
            if r.decides(text, pos):
                if r.breaks:
                    cuts.add(pos)
                break
    out, last = [], 0
    for c in [*sorted(cuts), len(text)]:
        part = text[last:c]
        a = last + len(part) - len(part.lstrip())
        z = last + len(part.rstrip())
        if z > a:
            if out and not _CONTENT.search(text, a, z):
                if "\n" not in text[out[-1][1] : a]:
                    out[-1] = (out[-1][0], z)
            else:
                out.append((a, z))
        last = c
    return out


def units(docs: DataFrame, key: str = "doc_id", text: str = "Content", lang: str = "lang") -> DataFrame:
    """``doc_id, sent_id, sent_start, sent_end, sentence`` of every document."""

    @F.pandas_udf("array<struct<sent_start:int,sent_end:int,sentence:string>>")
    def cut_up(texts: pd.Series, codes: pd.Series) -> pd.Series:
        return pd.Series([[{"sent_start": a, "sent_end": z, "sentence": t[a:z]} for a, z in sentences(t, c)] if t else [] for t, c in zip(texts, codes, strict=True)])

    rows = docs.select(F.col(key).alias("doc_id"), cut_up(F.col(text), F.col(lang)).alias("_s"))
    return rows.select("doc_id", F.posexplode("_s").alias("sent_id", "_u")).select("doc_id", "sent_id", "_u.*")
