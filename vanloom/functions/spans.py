"""Span algebra inside a row, as SQL higher-order functions. A span is struct<start,end,text,label>; offsets are
code points of the sentence, the end exclusive. No shuffle, no Python."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from vanloom.functions.text import at

LETTER = r"\p{L}"


def finditer(text: Column, pattern: str, label: Column | str) -> Column:
    """All non-overlapping matches of a positive-width pattern, with their offsets.

    The pieces between matches and the matches alternate; an offset is the sum of the lengths before it.
    """
    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    lab = F.lit(label) if isinstance(label, str) else label

    def one(hit: Column, i: Column) -> Column:
        sum_ = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + F.length(x))
        start = sum_(F.slice(pieces, F.lit(1), i + 1)) + sum_(F.slice(hits, F.lit(1), i))
        return F.struct(start.alias("start"), (start + F.length(hit)).alias("end"), hit.alias("text"), lab.alias("label"))

    return F.transform(hits, one)


def whole(spans: Column, text: Column, word: str = LETTER) -> Column:
    """Spans not adjacent to further word characters."""

    def free(s: Column) -> Column:
        before = F.when(s["start"] > 0, text.substr(s["start"], F.lit(1))).otherwise("")
        return ~before.rlike(f"[{word}]") & ~text.substr(s["end"] + 1, F.lit(1)).rlike(f"[{word}]")

    return F.filter(spans, free)


def alternation(phrases: list[str]) -> str:
    """Longest first, any case."""
    return "(?iu)(?:" + "|".join(re.escape(p).replace("\\ ", " ") for p in sorted(phrases, key=lambda p: (-len(p), p))) + ")"


def phrases(text: Column, lexicon: dict[str, list[str]], word: str = LETTER) -> Column:
    """Whole-phrase hits of every lexicon entry; overlapping hits of different entries all stay."""
    found = [whole(finditer(text, f"(?iu)\\Q{p}\\E", label), text, word) for label, some in lexicon.items() for p in some]
    return F.flatten(F.array(*found))


def token_phrase(tokens: Column, phrase: list[str]) -> Column:
    """0-based token positions where the phrase's tokens occur in sequence."""
    n = len(phrase)
    at = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    want = F.array(*[F.lit(p) for p in phrase])
    return F.transform(F.filter(at, lambda i: F.slice(tokens, i, n) == want), lambda i: i - 1)


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def greedy(spans: Column, *, longest: bool = True, by_priority: bool = False) -> Column:
    """Keeps spans that touch none kept before; order: priority (a field, low first), length, start, input position."""
    width = lambda s: s["end"] - s["start"]
    keyed = F.transform(
        spans,
        lambda s, i: F.struct((s["prio"] if by_priority else F.lit(0)).alias("p"), (-width(s) if longest else s["start"]).alias("w"), s["start"].alias("a"), i.alias("i"), s.alias("s")),
    )
    ordered = F.transform(F.array_sort(keyed), lambda k: k["s"])
    kept = F.aggregate(ordered, F.slice(ordered, 1, 0), lambda acc, s: F.when(F.exists(acc, lambda k: overlaps(k, s)), acc).otherwise(F.concat(acc, F.array(s))))
    return F.array_sort(kept)


def unblocked(spans: Column, blocked: Column) -> Column:
    return F.filter(spans, lambda s: ~F.exists(blocked, lambda b: overlaps(s, b)))


def contained(spans: Column, outer: Column) -> Column:
    return F.filter(spans, lambda s: F.exists(outer, lambda o: (o["start"] <= s["start"]) & (s["end"] <= o["end"])))


def exact_text(text: Column, s: Column) -> Column:
    """Whether the span's text is what stands there."""
    return text.substr(s["start"] + 1, s["end"] - s["start"]) == s["text"]


def nearest_before(spans: Column, position: Column) -> Column:
    """The last span, in array order, that ends at or before the position; null if none."""
    some = F.filter(spans, lambda s: s["end"] <= position)
    return F.when(F.size(some) > 0, at(some, -1))


def highlight(text: Column, spans: Column) -> Column:
    """Text with [span|LABEL] marks; an overlapping span prints again and the cursor goes to the larger end."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.when(s["start"] > acc["at"], text.substr(acc["at"] + 1, s["start"] - acc["at"])).otherwise("")
        return F.struct(F.concat(acc["out"], gap, F.lit("["), s["text"], F.lit("|"), s["label"], F.lit("]")).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    return F.aggregate(F.array_sort(spans), start, step, lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.length(text))))


def snippet(text: Column, s: Column, before: int = 40, after: int = 120) -> Column:
    """Context of a span, with an ellipsis on each side that was clipped."""
    a, z = F.greatest(s["start"] - before, F.lit(0)), F.least(s["end"] + after, F.length(text))
    return F.concat(F.when(a > 0, "…").otherwise(""), F.trim(text.substr(a + 1, z - a)), F.when(z < F.length(text), "…").otherwise(""))


def parse_entities(field: Column, aliases: dict[str, str] | None = None) -> Column:
    """``TEXT|LABEL; …`` to array<struct<text,label>>; NONE, blank and null give an empty array, items without a bar are skipped."""
    items = F.filter(F.transform(F.split(F.coalesce(field, F.lit("")), ";"), F.trim), lambda x: x.contains("|"))

    def one(x: Column) -> Column:
        label = F.upper(F.trim(F.regexp_extract(x, r"(?s)^.*\|([^|]*)$", 1)))
        for a, b in (aliases or ALIASES).items():
            label = F.when(label == a, b).otherwise(label)
        return F.struct(F.trim(F.regexp_extract(x, r"(?s)^(.*)\|[^|]*$", 1)).alias("text"), label.alias("label"))

    return F.when(F.upper(F.trim(field)) == "NONE", F.array().cast("array<struct<text:string,label:string>>")).otherwise(F.transform(items, one))


# Accepted spellings of labels.
ALIASES = {"PER": "PERSON", "ORG": "ORGANIZATION", "LOC": "LOCATION", "DATE": "TIME", "DATE/TIME": "TIME", "DATE_TIME": "TIME"}


def format_entities(spans: Column, empty: str = "NONE") -> Column:
    """``TEXT|LABEL; …`` by position."""
    joined = F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat(s["text"], F.lit("|"), s["label"])), "; ")
    return F.when(F.coalesce(joined, F.lit("")) == "", empty).otherwise(joined)


def located(text: Column, items: Column) -> Column:
    """Parsed entities that occur in the text, at their first occurrence, as spans sorted by position."""
    spans = F.transform(items, lambda e: F.struct((F.instr(text, e["text"]) - 1).alias("start"), (F.instr(text, e["text"]) - 1 + F.length(e["text"])).alias("end"), e["text"].alias("text"), e["label"].alias("label")))
    return F.array_sort(F.filter(spans, lambda s: (s["start"] >= 0) & (s["text"] != "")))


def cut_at(spans: Column, cuts: Column) -> Column:
    """Splits word spans at cut points that fall inside them; array<struct<start,end>>."""

    def one(s: Column) -> Column:
        inner = F.array_sort(F.array_distinct(F.filter(cuts, lambda c: (c > s["start"]) & (c < s["end"]))))
        edges = F.concat(F.array(s["start"]), inner, F.array(s["end"]))
        return F.transform(F.slice(edges, 1, F.size(edges) - 1), lambda a, i: F.struct(a.alias("start"), at(edges, i + 2).alias("end")))

    return F.flatten(F.transform(spans, one))


def bio_encode(tokens: Column, spans: Column) -> Column:
    """B-/I-/O labels of token spans; a token belongs to a span that contains it, and begins it where their starts agree."""

    def tag(t: Column) -> Column:
        inside = F.filter(spans, lambda s: (s["start"] <= t["start"]) & (t["end"] <= s["end"]))
        first = at(inside, 1)
        return F.when(F.size(inside) == 0, "O").otherwise(F.concat(F.when(first["start"] == t["start"], "B-").otherwise("I-"), first["label"]))

    return F.transform(tokens, tag)


def bio_decode(tokens: Column, labels: Column, text: Column) -> Column:
    """Spans of BIO labels; an I- without a matching open span begins a new one."""
    pairs = F.arrays_zip(tokens.alias("t"), labels.alias("l"))
    empty = F.array().cast("array<struct<start:int,end:int,label:string,open:boolean>>")

    def step(acc: Column, p: Column) -> Column:
        kind, name = F.substring(p["l"], 1, 1), p["l"].substr(F.lit(3), F.length(p["l"]))
        last = at(acc, -1)
        go_on = (F.size(acc) > 0) & (kind == "I") & F.coalesce(F.when(F.size(acc) > 0, last["open"] & (last["label"] == name)), F.lit(False))
        head = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        new = F.struct(p["t"]["start"].cast("int").alias("start"), p["t"]["end"].cast("int").alias("end"), name.alias("label"), F.lit(True).alias("open"))
        longer = F.struct(last["start"].alias("start"), p["t"]["end"].cast("int").alias("end"), last["label"].alias("label"), F.lit(True).alias("open"))
        shut = F.transform(acc, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"), F.lit(False).alias("open")))
        return F.when(kind == "O", shut).when(go_on, F.concat(head, F.array(longer))).otherwise(F.concat(acc, F.array(new)))

    spans = F.aggregate(pairs, empty, step)
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), text.substr(s["start"] + 1, s["end"] - s["start"]).alias("text"), s["label"].alias("label")))


def bio_triggers(tokens: Column, labels: Column, text: Column) -> Column:
    """``bio_decode`` of event triggers, numbered t0, t1, … in text order."""
    return F.transform(bio_decode(tokens, labels, text), lambda s, i: F.struct(F.concat(F.lit("t"), i.cast("string")).alias("id"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), s["label"].alias("label")))


def marked_pair(text: Column, trigger: Column, entity: Column) -> Column:
    """``<EVENT> <ENTITY> …`` with the trigger in <t> and the entity in <e>; they must not overlap."""
    first_t = trigger["start"] < entity["start"]
    a, b = F.when(first_t, trigger).otherwise(entity), F.when(first_t, entity).otherwise(trigger)
    ta, tb = F.when(first_t, "t").otherwise("e"), F.when(first_t, "e").otherwise("t")
    wrap = lambda s, tag: F.concat(F.lit("<"), tag, F.lit("> "), s["text"], F.lit(" </"), tag, F.lit(">"))
    return F.concat(
        F.lit("<"), trigger["label"], F.lit("> <"), entity["label"], F.lit("> "), text.substr(F.lit(1), a["start"]), wrap(a, ta), text.substr(a["end"] + 1, b["start"] - a["end"]), wrap(b, tb), text.substr(b["end"] + 1, F.length(text))
    )
