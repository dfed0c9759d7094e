"""Event triggers (three engines) and the roles of entities, sentence-local and usable on streams.

Spans are struct<start,end,text,label>; triggers also have an id. Engine A is pure SQL; B and C look
at windows and clauses around a hit and run as Arrow functions, behind a regular expression that keeps
sentences without any trigger phrase in the JVM.
"""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from vanloom.functions.text import at

from vanloom.functions import spans as S
from vanloom.operators import vocabulary as V

TRIGGER = "array<struct<id:string,start:int,end:int,text:string,label:string>>"


def triggers_a(text: Column, entities: Column | None = None, lexicon: dict[str, list[str]] | None = None, stop: list[str] | None = None, drugs: list[str] | None = None) -> Column:
    """Pre-annotation triggers: whole phrases, longest first, not within stop phrases, crimes or organisations."""
    lexicon, stop, drugs = lexicon or V.TRIGGERS_A, stop or V.STOP_A, drugs or V.DRUGS_A
    gated = {k: v for k, v in lexicon.items() if k != "MA_TUY"}
    hits = S.phrases(text, gated)
    if "MA_TUY" in lexicon:
        drug = S.phrases(text, {"MA_TUY": lexicon["MA_TUY"]})
        hits = F.concat(hits, F.when(text.rlike(S.alternation(drugs)), drug).otherwise(F.slice(drug, 1, 0)))
    shields = S.phrases(text, {"": stop})
    kept = S.unblocked(hits, shields)
    if entities is not None:
        kept = S.unblocked(kept, F.filter(entities, lambda e: e["label"].isin("CRIME", "ORGANIZATION")))
    any_ = S.alternation([p for some in lexicon.values() for p in some])
    return F.when(text.rlike(any_), S.greedy(kept)).otherwise(F.slice(hits, 1, 0))


def _phrases(words: list[str], before: str = r"(?<!\p{L})", after: str = r"(?!\p{L})") -> regex.Pattern:
    return regex.compile(before + "(?:" + "|".join(regex.escape(w) for w in sorted(words, key=lambda w: (-len(w), w))) + ")" + after, regex.I)


def _each(words: dict[str, list[str]]) -> list[tuple[str, regex.Pattern]]:
    return [(label, _phrases([w])) for label, some in words.items() for w in some]


def _longest(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Non-overlapping spans, the longer first, then the left one; in text order."""
    kept: list[tuple[int, int, str]] = []
    for a, z, lab in sorted(found, key=lambda s: (s[0] - s[1], s[0])):
        if not any(a < e and s < z for s, e, _ in kept):
            kept.append((a, z, lab))
    return sorted(kept)


class BaselineTriggers:
    """Engine B: a wide lexicon and reasons against a hit, each a predicate over the text around it."""

    def __init__(self):
        self.lexicon = _each(V.TRIGGERS_B)
        self.weak = _phrases(V.WEAK_DRUG_VERBS_B)
        self.shield = [_phrases([p]) for p in V.STOP_B]
        self.drug = regex.compile("|".join(map(regex.escape, V.DRUGS_B)), regex.I)
        self.unreal, self.cue, self.crime = (regex.compile(p, regex.I) for p in (V.NOT_HAPPENED_B, V.CLAUSE_CUES_B, V.CRIME_BEFORE_B))

    def __call__(self, text: str, entities: list | None) -> list[tuple[int, int, str]]:
        blocked = [m.span() for rx in self.shield for m in rx.finditer(text)]
        blocked += [(e["start"], e["end"]) for e in (entities if entities is not None else []) if e["label"] in ("CRIME", "ORGANIZATION")]
        drugs = [m.span() for m in self.drug.finditer(text)]

        def near(a: int, z: int) -> bool:
            return any(a <= s and e <= z for s, e in drugs)

        def happened(a: int, z: int) -> bool:
            if any(a < e and s < z for s, e in blocked):
                return False
            left = text[max(0, a - 40) : a]
            clause = regex.split("[,;:]", text[:a])[-1]
            return not (self.unreal.search(left) or self.crime.search(left) or self.cue.search(clause))

        found = [(*m.span(), lab) for lab, rx in self.lexicon for m in rx.finditer(text) if lab != "MA_TUY" or near(m.start() - 40, m.end() + 60)]
        found += [(*m.span(), "MA_TUY") for m in self.weak.finditer(text, overlapped=True) if near(m.end(), m.end() + 25)] if drugs else []
        kept = _longest([f for f in found if happened(f[0], f[1])])
        out, said = [], set()
        for i, (a, z, lab) in enumerate(kept):
            word = text[a:z].lower()
            following = kept[i + 1] if i + 1 < len(kept) else None
            # Restraint right before an arrest is the arrest; a repeated charge or a chain of tricks is one event.
            if word == "khống chế" and following and following[2] == "BAT_GIU" and following[0] - z <= 3:
                continue
            once = {"KHOI_TO": (lab, word), "LUA_DAO": lab}.get(lab)
            if once is not None and once in said:
                continue
            said.add(once)
            out.append((a, z, lab))
        return out


_END = regex.compile(r"[!?\n]|(?<!(?<!\p{L})\p{Lu})\.")
_CLAUSE = regex.compile(r"[,;:]|\bnhưng\b|\bvà\s+sau\s+đó\b", regex.I)


def sentence_at(text: str, position: int) -> tuple[int, int]:
    """Bounds of the sentence around a position; the dot of a single capital does not end one."""
    left, right = 0, len(text)
    for m in _END.finditer(text):
        if m.end() <= position:
            left = m.end()
        elif m.start() >= position:
            right = m.end()
            break
    return left, right


class ServiceTriggers:
    """Engine C: rules with required context; administrative, repeated and unrealised mentions drop out."""

    def __init__(self):
        self.rules = [(_phrases([p], r"(?<!\w)", r"(?!\w)"), *rule) for p, *rule in V.RULES_C]
        self.shield = [regex.compile(p, regex.I) for p in V.SHIELDS_C]
        self.admin = _phrases(list(V.ADMINISTRATIVE_C), "", "")

    def __call__(self, text: str, _entities=None) -> list[tuple[int, int, str]]:
        shields = [m.span() for rx in self.shield for m in rx.finditer(text)]
        quiet = [sentence_at(text, m.start()) for m in self.admin.finditer(text)]

        def rest(z: int) -> str:
            m = _CLAUSE.search(text, z)
            return text[z : m.start() if m else len(text)].lower()

        found = []
        for rx, label, needs, where in self.rules:
            for m in rx.finditer(text):
                a, z = m.span()
                if any(s <= a and z <= e for s, e in shields) or any(s <= a < e for s, e in quiet):
                    continue
                if needs:
                    context = text[slice(*sentence_at(text, a))].lower() if where == "sentence" else rest(z)
                    if not any(n in context for n in needs):
                        continue
                found.append((a, z, label))
        out, said = [], set()
        for a, z, label in _longest(found):
            s, e = sentence_at(text, a)
            if (text[a:z].lower(), s) in said:
                continue
            said.add((text[a:z].lower(), s))
            start = max([s, *(m.end() for m in _CLAUSE.finditer(text, s, a))])
            before, after = text[start:a].lower(), rest(z)
            asked = regex.search(r"\bhay\s+không\b|\?", after)
            if any(c in before for c in V.UNREALISED_C) or any(c in text[z:e].lower() for c in V.PLANNED_AFTER_C) or (asked and asked.start() <= 30):
                continue
            out.append((a, z, label))
        return out


_ENGINES = {"baseline": BaselineTriggers, "service": ServiceTriggers}
_READY: dict[str, object] = {}


def _engine(name: str):
    """Built once per worker."""
    if name not in _READY:
        _READY[name] = _ENGINES[name]()
    return _READY[name]


def triggers(text: Column, entities: Column | None, engine: str) -> Column:
    """Triggers of the "baseline" or "service" engine, ids t0, t1, … in text order; an empty array for null texts."""

    @F.pandas_udf(TRIGGER)
    def find(texts: pd.Series, ents: pd.Series) -> pd.Series:
        run = _engine(engine)
        return pd.Series([[{"id": f"t{i}", "start": a, "end": z, "text": t[a:z], "label": lab} for i, (a, z, lab) in enumerate(run(t, e))] if t else [] for t, e in zip(texts, ents, strict=True)])

    words = [p for some in V.TRIGGERS_B.values() for p in some] + V.WEAK_DRUG_VERBS_B if engine == "baseline" else [p for p, *_ in V.RULES_C]
    none = F.array().cast("array<struct<start:int,end:int,text:string,label:string>>")
    ents = none if entities is None else F.transform(entities, lambda e: F.struct(e["start"].cast("int").alias("start"), e["end"].cast("int").alias("end"), e["text"].alias("text"), e["label"].alias("label")))
    gate = text.rlike(S.alternation(words))
    return F.when(gate, find(F.when(gate, text), ents)).otherwise(F.array().cast(TRIGGER))


def clause_bounds(text: Column, position: Column) -> Column:
    """struct<a,z>: the clause around a position, cut at ; . ! ?"""
    before = text.substr(F.lit(1), position)
    after = text.substr(position + 1, F.length(text))
    a = F.length(before) - F.length(F.regexp_extract(before, r"([^;.!?]*)$", 1))
    return F.struct(a.cast("int").alias("a"), (position + F.length(F.regexp_extract(after, r"^([^;.!?]*)", 1))).cast("int").alias("z"))


def is_home(text: Column, start: Column) -> Column:
    """Whether a place names where someone is from or lives: the last cue in the address before it decides."""
    window = text.substr(F.greatest(start - 79, F.lit(1)), F.least(start, F.lit(80)))
    part = F.regexp_extract(window, r"([^();.]*)$", 1)
    cues = "|".join(V.HOME_CUES)
    cue = rf"(?iu)(?:(?:{cues})(?:(?!{cues}|(?<!\p{{L}})ở(?!\p{{L}})).)*|(?<!\p{{L}})ở(?!\p{{L}})\s*\S*\s*)$"
    return part.rlike(cue)


def role_of(text: Column, t: Column, e: Column) -> Column:
    """The decision table of the rule linker; null where an entity has no role for a trigger."""
    et, lab = t["label"], e["label"]
    after = e["start"] >= t["end"]
    crime = et.isin(*V.CRIME_EVENTS)
    sentence = e["text"].rlike("(?iu)tù|tử hình|chung thân")
    between = F.when(e["end"] <= t["start"], text.substr(e["end"] + 1, t["start"] - e["end"])).otherwise("")
    reported = between.rlike("(?iu)" + "|".join(V.REPORTING))
    return (
        F.when(lab == "CRIME", "TOI_DANH")
        .when((lab == "LOCATION") & ~is_home(text, e["start"]), "DIA_DIEM")
        .when((lab == "TIME") & ~reported & sentence & (et == "XET_XU"), "MUC_AN")
        .when((lab == "TIME") & ~reported & ~sentence, "THOI_GIAN")
        .when((lab == "DRUG") & et.isin("MA_TUY", "THU_GIU"), "TANG_VAT")
        .when((lab == "MONEY") & et.isin("LUA_DAO", "CUOP_TROM"), "TAI_SAN")
        .when((lab == "PRODUCT") & et.isin("THU_GIU", "MA_TUY"), "TANG_VAT")
        .when((lab == "PRODUCT") & et.isin("CUOP_TROM", "LUA_DAO"), "TAI_SAN")
        .when((lab == "PRODUCT") & (et == "BAO_LUC"), "HUNG_KHI")
        .when((lab == "ORGANIZATION") & ~crime & ~after, "CO_QUAN")
        .when((lab == "PERSON") & crime & after, "NAN_NHAN")
        .when((lab == "PERSON") & crime, "DOI_TUONG")
        .when((lab == "PERSON") & after, "DOI_TUONG")
    )


def admits(role: Column, label: Column) -> Column:
    ok = F.lit(False)
    for r, labels in V.ROLE_LABELS.items():
        ok = F.when(role == r, label.isin(*labels)).otherwise(ok)
    return ok


def link(text: Column, trigs: Column, entities: Column) -> Column:
    """array<struct<trigger_id,arg_id,role>>: entities in the trigger's clause with their roles.

    Of organisations only the last one, in list order, that ends before the trigger is its agency.
    """

    def of_trigger(t: Column) -> Column:
        c = clause_bounds(text, t["start"])
        local = F.filter(entities, lambda e: (e["start"] >= c["a"]) & (e["end"] <= c["z"]))
        agency = S.nearest_before(F.filter(local, lambda e: e["label"] == "ORGANIZATION"), t["start"])
        rel = F.transform(local, lambda e: F.struct(t["id"].alias("trigger_id"), e["id"].alias("arg_id"), role_of(text, t, e).alias("role"), e["label"].alias("label"), (e["id"] == agency["id"]).alias("agency")))
        rel = F.filter(rel, lambda r: r["role"].isNotNull() & admits(r["role"], r["label"]) & ((r["role"] != "CO_QUAN") | F.coalesce(r["agency"], F.lit(False))))
        return F.transform(rel, lambda r: F.struct(r["trigger_id"], r["arg_id"], r["role"]))

    return F.flatten(F.transform(trigs, of_trigger))


def service_events(text: Column, trigs: Column, entities: Column) -> Column:
    """array<struct<event_type,trigger,arguments>>: same-sentence arguments; triggers without any are left out."""
    ordered = F.array_sort(F.transform(entities, lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["text"].alias("text"), e["label"].alias("label"))))
    stops = S.finditer(text, r"[!?\n]|(?<!(?<!\p{L})\p{Lu})\.", "")

    def of_trigger(t: Column) -> Column:
        a = F.coalesce(F.array_max(F.transform(F.filter(stops, lambda s: s["end"] <= t["start"]), lambda s: s["end"])), F.lit(0))
        z = F.coalesce(F.array_min(F.transform(F.filter(stops, lambda s: s["start"] >= t["start"]), lambda s: s["end"])), F.length(text))
        local = F.filter(ordered, lambda e: (e["start"] >= a) & (e["end"] <= z))
        some = lambda kind: F.filter(local, lambda e: e["label"] == kind)
        arg = lambda role, e: F.struct(role.alias("role"), e.alias("entity"))
        org = S.nearest_before(some("ORGANIZATION"), t["start"])
        later = F.filter(some("PERSON"), lambda e: e["start"] >= t["end"])
        earlier = S.nearest_before(some("PERSON"), t["start"])
        people = F.when(F.size(later) > 0, later).when(earlier.isNotNull(), F.array(earlier)).otherwise(F.slice(later, 1, 0))
        agency = F.when(org.isNotNull(), F.array(arg(F.lit("CO_QUAN"), org))).otherwise(F.slice(F.transform(local, lambda e: arg(F.lit("CO_QUAN"), e)), 1, 0))
        times = F.transform(some("TIME"), lambda e: arg(F.when((t["label"] == "XET_XU") & e["text"].rlike(r"(?iu)(?<!\p{L})tù(?!\p{L})"), "MUC_AN").otherwise("THOI_GIAN"), e))
        args = F.concat(agency, F.transform(people, lambda e: arg(F.lit("DOI_TUONG"), e)), times)
        return F.struct(t["label"].alias("event_type"), t.alias("trigger"), args.alias("arguments"))

    return F.filter(F.transform(trigs, of_trigger), lambda ev: F.size(ev["arguments"]) > 0)


def pairs(trigs: Column, entities: Column, relations: Column) -> Column:
    """Trigger and entity pairs that do not overlap, with their gold role or NONE."""

    def of_trigger(t: Column) -> Column:
        free = F.filter(entities, lambda e: ~S.overlaps(t, e))

        def role(e: Column) -> Column:
            r = F.filter(relations, lambda r: (r["trigger_id"] == t["id"]) & (r["arg_id"] == e["id"]))
            return F.when(F.size(r) > 0, at(r, 1)["role"]).otherwise("NONE")

        return F.transform(free, lambda e: F.struct(t["id"].alias("trigger_id"), e["id"].alias("arg_id"), role(e).alias("role")))

    return F.flatten(F.transform(trigs, of_trigger))


def choose_role(scores: Column, label: Column, roles: list[str]) -> Column:
    """The best admissible role of a scorer's logits (one per role, NONE first); inadmissible roles are masked out."""
    names = F.array(*[F.lit(r) for r in ("NONE", *roles)])
    masked = F.transform(scores, lambda x, i: F.when((i == 0) | admits(at(names, i + 1), label), x).otherwise(F.lit(float("-inf"))))
    return at(names, F.array_position(masked, F.array_max(masked)).cast("int"))
