"""Alignment of mentions with tokens: locating, overlap resolution, token offsets, BIO encoding. Row-local; errors come
back as data, one message per record."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from vanloom.functions.spans import ALIASES
from vanloom.operators.vocabulary import ENTITY_LABELS

ALIGNED = "struct<sentence:string,tokens:array<string>,token_offsets:array<struct<start:int,end:int>>,labels:array<string>,entities:array<struct<text:string,label:string,start:int,end:int>>,removed:int,error:string>"
_SURFACE = regex.compile(r"[^\W_]+(?:\p{M}+[^\W_]*)*|[^\w\s]")


def surface(text: str) -> list[str]:
    """Default segmenter."""
    return [m.group() for m in _SURFACE.finditer(text)]


def fold(text: str) -> tuple[str, list[int]]:
    """Accent-folded text and the source position of each character."""
    chars, at = [], []
    for i, c in enumerate(text):
        for d in unicodedata.normalize("NFD", "đ" if c in "ðĐÐđ" else c).casefold().replace("đ", "d"):
            if not unicodedata.combining(d):
                chars.append(d)
                at.append(i)
    return "".join(chars), at


def _wordlike(c: str) -> bool:
    return c.isalnum() or c == "_" or unicodedata.combining(c) != 0


def locate(text: str, mention: str) -> list[tuple[int, int]]:
    """All whole-word occurrences of a mention, white space being flexible: in its own case, else in any."""
    words = mention.split()
    if not words:
        return []
    if " ".join(words) in text:
        # The usual case: the mention stands there as written.
        word, out, at = " ".join(words), [], -1
        while (at := text.find(word, at + 1)) >= 0:
            if not (at and _wordlike(text[at - 1])) and not (at + len(word) < len(text) and _wordlike(text[at + len(word)])):
                out.append((at, at + len(word)))
        if out and "  " not in text and "\n" not in text and "\t" not in text:
            return out
    body = r"\s+".join(regex.escape(w) for w in words)
    for flags in (0, regex.I):
        got = [m.span() for m in regex.finditer(rf"(?<!\w){body}(?!\w)", text, flags)]
        if got:
            return got
    return []


def resolve(spans: list[tuple[int, int, str]]) -> tuple[list[tuple[int, int, str]], int, str | None]:
    """Longest first; exact repeats and shorter overlaps go, equally long overlaps are an error."""
    kept: list[tuple[int, int, str]] = []
    removed = 0
    for a, z, lab in sorted(spans, key=lambda s: (s[0] - s[1], s[0])):
        clash = [k for k in kept if a < k[1] and k[0] < z]
        if not clash:
            kept.append((a, z, lab))
        elif any(k[1] - k[0] == z - a and k != (a, z, lab) for k in clash):
            return kept, removed, f"overlapping mentions of equal length at {a}-{z}"
        else:
            removed += 1
    return sorted(kept), removed, None


def offsets(text: str, tokens: list[str]) -> tuple[list[tuple[int, int]], str | None]:
    """Offsets of tokens in order: exact in any case, underscores standing for spaces, else without accents; only blanks may be skipped."""
    out, at = [], 0
    for tok in tokens:
        skip = at
        while skip < len(text) and (text[skip].isspace() or text[skip] == "_"):
            skip += 1
        if tok and text[skip : skip + len(tok)].lower() == tok.lower():
            out.append((skip, skip + len(tok)))
            at = skip + len(tok)
            continue
        body = r"[\s_]*".join(regex.escape(p) for p in tok.split("_") if p)
        m = regex.compile(rf"[\s_]*({body})", regex.I).match(text, at) if body else None
        if m is None and body:
            plain, back = fold(text[at:])
            want = r"[\s_]*".join(regex.escape(fold(p)[0]) for p in tok.split("_") if p)
            f = regex.match(rf"[\s_]*({want})", plain)
            if f is None or f.start(1) == f.end(1):
                return out, f"token {tok!r} not found from {at}"
            span = (at + back[f.start(1)], at + back[f.end(1) - 1] + 1)
            while span[1] < len(text) and unicodedata.combining(text[span[1]]):
                span = (span[0], span[1] + 1)
        elif m is None:
            return out, f"empty token at {at}"
        else:
            span = m.span(1)
        out.append(span)
        at = span[1]
    return (out, None) if not text[at:].strip(" _\t\n") else (out, f"text left over from {at}")


def align(text: str, mentions: list[tuple[str, str, int | None, int | None]], segmenter: Callable[[str], list[str]] = surface) -> dict:
    """One record: sentence, tokens, offsets, BIO labels, entities; ``error`` says what does not fit."""
    text = unicodedata.normalize("NFC", text)
    spans, error = [], None
    for mention, label, a, z in mentions:
        mention = unicodedata.normalize("NFC", mention)
        if label not in ENTITY_LABELS:
            error = error or f"unknown label {label}"
        elif a is not None and z is not None and a >= 0:
            if z > len(text) or text[a:z].casefold() != mention.casefold():
                error = error or f"offsets {a}-{z} do not hold {mention!r}"
            else:
                spans.append((a, z, label))
        else:
            got = locate(text, mention)
            error = error if got else error or f"mention {mention!r} not found"
            spans += [(s, e, label) for s, e in got]
    kept, removed, clash = resolve(spans)
    error = error or clash
    toks, lost = offsets(text, segmenter(text))
    error = error or lost
    cuts = sorted({x for s in kept for x in s[:2]})
    pieces = []
    for a, z in toks:
        for s, e in zip([a, *(c for c in cuts if a < c < z)], [*(c for c in cuts if a < c < z), z], strict=True):
            part = text[s:e]
            s, e = s + len(part) - len(part.lstrip()), e - (len(part) - len(part.rstrip()))
            if e > s:
                pieces.append((s, e))
    labels = []
    for s, e in pieces:
        hit = next(((a, lab) for a, z, lab in kept if a <= s and e <= z), None)
        labels.append("O" if hit is None else ("B-" if hit[0] == s else "I-") + hit[1])
    for a, z, lab in kept:
        mine = [p for p in pieces if a <= p[0] and p[1] <= z]
        if not mine or mine[0][0] != a or z - mine[-1][1] > 1 or (z - mine[-1][1] == 1 and text[z - 1] != "."):
            error = error or f"{lab} {a}-{z} does not end with a token"
    return {
        "sentence": text, "tokens": [text[s:e].replace(" ", "_") for s, e in pieces], "token_offsets": [{"start": s, "end": e} for s, e in pieces], "labels": labels,
        "entities": [{"text": text[a:z], "label": lab, "start": a, "end": z} for a, z, lab in kept], "removed": removed, "error": error,
    }


def aligned(text: Column, mentions: Column, segmenter: Callable[[str], list[str]] = surface) -> Column:
    """``align`` over rows; ``mentions`` is array<struct<text,label>>. Null and blank sentences give an error."""

    @F.pandas_udf(ALIGNED)
    def run(texts: pd.Series, items: pd.Series) -> pd.DataFrame:
        rows = [align(t or "", [(m["text"], m["label"], None, None) for m in (i if i is not None else [])], segmenter) if t and t.strip() else {**align("", []), "error": "empty sentence"} for t, i in zip(texts, items, strict=True)]
        return pd.DataFrame(rows, columns=["sentence", "tokens", "token_offsets", "labels", "entities", "removed", "error"])

    return run(text, mentions)


def check(sentence: str | None, cell: str | None) -> str | None:
    """What is wrong with an annotated row, null for nothing. Mentions are looked for from left to right, each from the end of the one before,
    and from the start of the sentence if there is none further on; then the record is aligned."""
    sentence = (sentence or "").strip()
    if not sentence:
        return "empty sentence"
    raw = (cell or "").strip()
    if not raw:
        return "empty entities"
    mentions: list[tuple[str, str, int | None, int | None]] = []
    at = 0
    for item in () if raw.upper() == "NONE" else filter(None, map(str.strip, raw.split(";"))):
        text, bar, label = item.rpartition("|")
        text, label = text.strip(), label.strip().upper()
        label = ALIASES.get(label, label)
        if not bar or not text:
            return f"item without label: {item!r}"
        if label not in ENTITY_LABELS:
            return f"unknown label {label}"
        start = sentence.find(text, at)
        start = start if start >= 0 else sentence.find(text)
        if start < 0:
            return f"mention {text!r} not found"
        at = start + len(text)
        mentions.append((text, label, start, at))
    return align(sentence, mentions)["error"]


def checked(sentence: Column, cell: Column) -> Column:
    """``check`` over rows."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, cells: pd.Series) -> pd.Series:
        return pd.Series([check(t, c) for t, c in zip(texts, cells, strict=True)], dtype="object")

    return run(sentence, cell)
