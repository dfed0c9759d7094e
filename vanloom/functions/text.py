"""Text scalars as Column expressions; built-ins wherever Spark has them, Arrow functions for Unicode normalisation."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters, digits and underscore, as Python's \w sees them (Java's own \w is ASCII).
WORD = r"\p{L}\p{N}_"
SPACE = r"[\s \u0085\u001C-\u001F  \p{Zs}]"
UPPER = r"\p{Lu}"


def _normal(form: str):
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: unicodedata.normalize(form, t), na_action="ignore")

    return run


def nfc(text: Column) -> Column:
    """Canonical composition."""
    return F.pandas_udf(_normal("NFC"), "string")(text)


def nfd(text: Column) -> Column:
    """Canonical decomposition."""
    return F.pandas_udf(_normal("NFD"), "string")(text)


def at(array: Column | str, i: Column | int) -> Column:
    """Element i, from 1 or from the end for negative numbers; null where there is none."""
    return F.try_element_at(array, i if isinstance(i, Column) else F.lit(i))


def composed(text: Column) -> Column:
    """NFC that leaves the JVM only for texts with combining marks or characters that NFC may change."""
    return F.when(text.rlike(r"[̀-ͯ̀-ͅʹ;·ऀ-෿ἀ-῿ -⁯Ω-Å゙゚豈-﫿]"), nfc(text)).otherwise(text)


def collapse(text: Column) -> Column:
    """Runs of white space to one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def clean_text(text: Column) -> Column:
    """Repairs spacing and composition: null gives an empty text."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+(?=[\\u0300-\\u036F])", "")
    t = F.regexp_replace(composed(t), r"[​﻿­]", "")
    return collapse(F.regexp_replace(t, "�", " "))


def norm_key(text: Column) -> Column:
    """Lower case; everything but letters, digits and underscores becomes one space."""
    return F.trim(F.regexp_replace(F.lower(text), f"[^{WORD}]+", " "))


def head_key(text: Column, n: int = 200) -> Column:
    return F.substring(norm_key(text), 1, n)


def sentence_key(text: Column) -> Column:
    """Composed, spaces collapsed, lower case."""
    return F.lower(collapse(composed(text)))


def n_words(text: Column) -> Column:
    """Words between white space; 0 for null and blank texts."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda w: w != ""))


def detokenize(text: Column) -> Column:
    """Deletes spaces before closing and after opening punctuation."""
    t = F.regexp_replace(text, r"\s+([.,;:!?…%)\]”’»])", "$1")
    return F.regexp_replace(t, r"([(\[“‘«])\s+", "$1")


#: Capital letters of the Latin blocks and those up to the Vietnamese ones, as a character class without its brackets.
CAPITAL = "A-Z" + "".join(chr(c) for c in range(0xC0, 0x1EFA) if chr(c).isupper())
SPACES = SPACE[1:-1]

# Photo captions, clip markers and links, as (pattern, replacement). A caption with a name in capitals
# and a caption with a source leave a full stop, so that what follows does not join the sentence before.
_CAPITALS = f"[{CAPITAL}][{CAPITAL}.]*"
NOISE = (
    (rf"\({SPACE}*(?:Ảnh|Nguồn){SPACE}*:[^()]{{0,60}}\)", " "),
    (rf"[-–]?{SPACE}*(?:Ảnh|Đồ hoạ|Đồ họa){SPACE}*:{SPACE}*(?:{_CAPITALS}{SPACE}*\.?{SPACE}*){{1,4}}(?={SPACE}|$)", " . "),
    (rf"[-–]{SPACE}*Ảnh{SPACE}*:{SPACE}*[^.]{{1,50}}?{SPACE}\.(?={SPACE}|$)", " . "),
    (rf"(?:XEM CLIP|Xem [Cc]lip|Clip){SPACE}*:{SPACE}*", ""),
    (rf"https?://[^{SPACES}]+|www\.[^{SPACES}]+", " "),
)


def remove_noise(text: Column) -> Column:
    """Drops photo captions, clip markers and links, then repairs the dots left over."""
    for pattern, new in NOISE:
        text = F.regexp_replace(text, pattern, new)
    return dots(text)


def dots(text: Column) -> Column:
    """Full stops with nothing but spaces between them to one (an ellipsis stays), one at the start dropped, spaces collapsed."""
    t = F.regexp_replace(text, rf"\.(?:{SPACE}+\.)+", ".")
    return collapse(F.regexp_replace(t, rf"^{SPACE}*\.{SPACE}*", ""))


def token_key(token: Column) -> Column:
    """Folds variants of a token: eth to đ, underscores to spaces, composition, case and two tone-mark placements."""
    t = F.lower(composed(F.translate(token, "Ðð_", "Đđ ")))
    return F.regexp_replace(F.regexp_replace(t, "tuý", "túy"), "uỷ", "ủy")


def tokens(text: Column) -> Column:
    """Words, and every other visible character by itself."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}_\s]"), F.lit(0))


def syllables(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"[{WORD}]+|[^{WORD}\s]"), F.lit(0))


def merge_fragments(sentences: Column) -> Column:
    """Appends a fragment to the sentence before it: under three words, or begun with closing punctuation or a small letter."""
    fragment = lambda s: (n_words(s) < 3) | s.rlike(r"^[(,;:)”’]") | s.rlike(r"^\p{Ll}")
    return F.aggregate(
        sentences,
        F.array().cast("array<string>"),
        lambda acc, s: F.when((F.size(acc) > 0) & fragment(s), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat_ws(" ", at(acc, -1), s)))).otherwise(F.concat(acc, F.array(s))),
    )


def rough_sentences(text: Column) -> Column:
    """Fallback segmenter: after an end mark and white space, unless a single capital stands before the dot."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?…])(?<!(?<![\p{L}])\p{Lu}\.)\s+|\n+"), F.trim), lambda s: s != "")


def similarity(a: Column | str, b: Column | str) -> Column:
    """Ratcliff-Obershelp ratio, the second argument being the reference; null for nulls."""
    return F.pandas_udf(_ratios, "double")(a, b)


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def accent_fold(text: Column) -> Column:
    """struct<folded,offsets>: text without accents, in lower case, and the source position of each of its characters."""
    return F.pandas_udf(_folds, "struct<folded:string,offsets:array<int>>")(text)


def _folds(text: pd.Series) -> pd.DataFrame:
    rows = []
    for t in text:
        chars, at = [], []
        for i, c in enumerate(t or ""):
            for d in unicodedata.normalize("NFD", c).casefold():
                if unicodedata.category(d) != "Mn":
                    chars.append(d)
                    at.append(i)
        rows.append(("".join(chars), at))
    return pd.DataFrame(rows, columns=["folded", "offsets"])


#: Abbreviations: two or more capitals, or letters with dots.
ABBREVIATION = r"(?:^|[^\p{L}])(?:\p{Lu}{2,}|(?:\p{L}\.){2,})"
