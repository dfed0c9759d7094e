"""Problem 5: visually identical text with different characters.

``unify`` brings a text to one form: compatibility-normalised letters and digits, composed accents,
ordinary spaces, no default-ignorable characters, and Latin letters in Latin words. Joined
emoji, full-width punctuation, symbols such as ², ½, № and words wholly in another script stay. ``compare_key``
adds full case folding and single spaces, for equality tests.

Null stays null, empty stays empty. Work is done once per distinct value of a batch, on the whole text.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vanloom.llm.encoding import FIELDS, fit, repair, scan, suspicious

# Letters that look like a Latin one, grouped by script.
LIKE = dict(zip(
    "АВЕЅІЈКМНОРСТУХҮԌԛԝасеѕіјорухүһԁӏ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαικνρυχ" "ՕՍօոսց" "ᎪᏴᏟᎠᎬᎻᎫᎦᎷᏢᎡᏚᎢᏙᏔ" "ðÐƉɖıɑɡ",
    "ABESIJKMHOPCTYXYGqwaceSijopyxyhdl" "ABEZHIKMNOPTYXoaiKvpux" "OUonug" "AVCDEHJSMPRSTVW" "đĐĐđiag", strict=True)) | {"ѕ": "s", "κ": "k"} | dict(zip("ьѵωηⲟⲞꓐꓳꓢʀʏ", "bvwnoOBOSRY", strict=True))
_SPACE = "\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
_HIDDEN = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff0-\ufff8\U000e0000-\U000e0fff"
_WIDE = "０-９Ａ-Ｚａ-ｚ"
#: Letters that stand for others in one glyph or at half width.
_MATH = "\U0001d400-\U0001d7ff\ufb00-\ufb06\uff65-\uff9f"
_MARK = "\u0300-\u036f\u3099\u309a"
_JOIN = r"(?<=[\p{So}\p{Sk}\ufe0f].)(?=[\p{So}\p{Sm}])"
_KEEP = regex.compile(rf"\u200d{_JOIN}|[\ufe0e\ufe0f](?<=[\p{{So}}\p{{Sm}}#*0-9©®‼⁉™].)|[\U000e0020-\U000e007f](?<=\p{{So}}[\U000e0020-\U000e007f]+)")
_NARROW = regex.compile(f"[{_WIDE}{_MATH}]+")
_APART = regex.compile(r"(?<=\p{L}[\u0300-\u036f]*)[ \u00a0]+(?=[\u0300-\u036f])")
_COMPOSE = regex.compile(rf"[^{_MARK}\s][{_MARK}]+")
_LATIN = regex.compile(r"\p{Latin}")
_OTHER = regex.compile("[" + "".join(LIKE) + "]")
_LIKE_WORD = re.compile(f"[^\\W\\d_]*[{''.join(LIKE)}](?:[^\\W\\d_]|[\u0300-\u036f])*")
#: First sieve: every text that ``unify`` could change has one of these.
SIEVE = f"[{_SPACE}{_HIDDEN}{_WIDE}{_MARK}{_MATH}{''.join(LIKE)}]"


def _latin(m: regex.Match) -> str:
    w = m.group()
    if not _OTHER.search(w):
        return w
    plain = _OTHER.sub("", w)
    # Only a word that also has Latin letters of its own; ð and its like count as stand-ins themselves.
    if not _LATIN.search(plain) or regex.search("[þæÞÆ]", plain):
        return w
    return _OTHER.sub(lambda c: LIKE[c.group()], w)


# The standard library's scan of a single class is the faster test for whether a step has work to do.
_HAS = {name: re.compile(f"[{chars}]") for name, chars in {"hidden": _HIDDEN, "space": _SPACE, "wide": _WIDE + _MATH, "mark": _MARK, "like": "".join(LIKE)}.items()}


def unify(text: str | None) -> str | None:
    """One form for texts that look alike."""
    if not text:
        return text
    if _HAS["hidden"].search(text):
        kept: set[int] = {k for m in _KEEP.finditer(text) for k in range(*m.span())}
        text = _HAS["hidden"].sub(lambda m: m.group() if m.start() in kept else "", text)
    if _HAS["space"].search(text):
        text = _HAS["space"].sub(" ", text)
    if _HAS["wide"].search(text):
        text = _NARROW.sub(lambda m: unicodedata.normalize("NFKC", m.group()), text)
    if _HAS["mark"].search(text):
        text = _APART.sub("", text)
        text = _COMPOSE.sub(lambda m: unicodedata.normalize("NFC", m.group()), text)
    if _HAS["like"].search(text):
        text = _LIKE_WORD.sub(_latin, text)
    return text


def compare_key(text: str | None) -> str | None:
    """The form in which texts are compared: unified, in compatibility composed form, with full case folding and single spaces. Symbols that
    ``unify`` leaves as they are, such as ² or Ⅳ, are equal to their plain letters here."""
    if text is None:
        return None
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", unify(text)).casefold()).split())


def changed(texts: pa.Array, _odd: pa.Array | None = None) -> list[str | None]:
    """The unified form of each text that ``unify`` changes, null for the others."""
    out: list[str | None] = [None] * len(texts)
    at = np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, SIEVE), False).to_numpy(zero_copy_only=False))
    seen: dict[str, str | None] = {}
    for i, t in zip(at, texts.take(pa.array(at)).to_pylist(), strict=True):
        if t not in seen:
            new = unify(t)
            seen[t] = None if new == t else new
        out[i] = seen[t]
    return out


def differing(rows: DataFrame, key: str, text: str, table_name: str, but_garbled: bool = False, also: tuple[str, ...] = ()) -> DataFrame:
    """``table_name, record_id, unified`` of rows that ``unify`` changes.

    With ``but_garbled``, texts of problem 2 are left out; its model is trained in the same pass on
    the clean texts of ``text`` and the fields ``also``.
    """
    if not but_garbled:

        def run(batches):
            for b in batches:
                new = pa.array(changed(b.column(1)), pa.string())
                some = pc.is_valid(new)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(some), new.filter(some)], names=["record_id", "unified"])

        hit = rows.select(F.col(key).cast("bigint").alias("record_id"), F.col(text).alias("_t")).mapInArrow(run, "record_id bigint, unified string")
    else:
        names = rows.select(F.col(key).cast("bigint").alias("record_id"), F.col(text).alias("main"), *[F.col(f).alias(f"also{i}") for i, f in enumerate(also)])

        def pick(texts: pa.Array, odd: pa.Array) -> list[str | None]:
            return changed(texts)

        model, hit = scan(names, {"record_id": "bigint"}, ("main", *[f"also{i}" for i in range(len(also))]), pick)
        shared = rows.sparkSession.sparkContext.broadcast(model)

        @F.pandas_udf("boolean")
        def garbled(texts: pd.Series) -> pd.Series:
            return texts.map({t: bool(repair(t, shared.value).chain) for t in texts.unique()})

        hit = hit.where("field_name = 'main'").where(~garbled("text")).select("record_id", F.col("kept").alias("unified"))
    return hit.select(F.lit(table_name).alias("table_name"), "record_id", "unified")


def variants(articles: DataFrame, sentences: DataFrame) -> DataFrame:
    """``table_name, record_id, unified`` over both tables."""
    a = differing(articles, "article_id", "Content", "raw_articles", but_garbled=True, also=("Summarize",))
    return a.unionByName(differing(sentences, "row_id", "sentence", "sentences"))


def _formed(rows: DataFrame, key: str, text: str, table_name: str, garbled: tuple[str, ...] = ()) -> DataFrame:
    """``table_name, record_id, unified, compare_key, changed`` of every text. Damage of problem 2 is undone first where ``garbled`` names
    the fields on whose clean texts its model is trained: a stretch that is still garbled has no look-alikes, and unifying it would end its repair."""
    shared = rows.sparkSession.sparkContext.broadcast(fit(rows, garbled)) if garbled else None

    def run(batches):
        for b in batches:
            valid = b.filter(pc.is_valid(b.column(1)))
            texts = valid.column(1)
            odd = suspicious(texts).to_pylist() if shared else [False] * len(texts)
            like = pc.match_substring_regex(texts, SIEVE).to_pylist()
            seen: dict[str, tuple[str, str]] = {}
            for t, o, k in zip(texts.to_pylist(), odd, like, strict=True):
                if t not in seen:
                    plain = repair(t, shared.value).text if o else t
                    new = unify(plain) if k or o else plain
                    seen[t] = new, compare_key(new)
            got = [(*seen[t], seen[t][0] != t) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([valid.column(0), *(pa.array([g[i] for g in got], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.bool_())))], names=["record_id", "unified", "compare_key", "changed"])

    hit = rows.select(F.col(key).cast("bigint").alias("record_id"), F.col(text).alias("_t")).mapInArrow(run, "record_id bigint, unified string, compare_key string, changed boolean")
    return hit.select(F.lit(table_name).alias("table_name"), "record_id", "unified", "compare_key", "changed")


def all_forms(articles: DataFrame, sentences: DataFrame) -> DataFrame:
    """``table_name, record_id, unified, compare_key, changed`` of every text of both tables, whether it has variants or not, so that
    texts that look alike can be found by ``compare_key``. Garbled ones are restored first; null has no row."""
    a = _formed(articles, "article_id", "Content", "raw_articles", tuple(f for f in FIELDS if f in articles.columns))
    return a.unionByName(_formed(sentences, "row_id", "sentence", "sentences"))


def one_form(articles: DataFrame, sentences: DataFrame) -> DataFrame:
    """``table_name, record_id, unified, compare_key`` of every text that has variants, garbled ones too."""
    return all_forms(articles, sentences).where("changed").drop("changed")
