"""Two rule recognisers of entities. Each is one Arrow function with its vocabulary built once per worker; both
return array<struct<start,end,text,label>> in text order, an empty array for null texts."""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from vanloom.operators import vocabulary as V

SPAN = "array<struct<start:int,end:int,text:string,label:string>>"
PROVENANCE = "array<struct<start:int,end:int,text:string,label:string,rule:string,priority:int,selected:boolean>>"


def _select(found: list[tuple], key) -> list[tuple]:
    kept: list[tuple] = []
    for s in sorted(found, key=key):
        if not any(s[0] < k[1] and k[0] < s[1] for k in kept):
            kept.append(s)
    return sorted(kept)


class PreAnnotation:
    """Recogniser A: crimes, organisations, then money, time and drugs; a tagger for names may be plugged in."""

    def __init__(self, tagger=None):
        self.tagger = tagger
        cap = "[A-ZĐÀ-Ỹ]"
        self.crime = [
            regex.compile(rf"(?<=tội\s)[\"“]?({cap}[^.;:()\"”]{{2,80}}?)[\"”]?(?=\s*[.;:()]|\s+(?:theo|tại|với|đối với|xảy ra|khi|nhưng)\s|$)"),
            regex.compile(r"(?:hành vi|tội danh|về tội|tội)\s*[\"“]([^\"”]{3,80})[\"”]"),
        ]
        self.joined = regex.compile(rf"\s+và\s+(?={cap})")
        heads = "|".join(map(regex.escape, sorted(V.ORG_HEADS_A, key=len, reverse=True)))
        inner = "|".join(V.ORG_INNER_A)
        # A name goes on over capitalised words and the words that occur inside such names, up to punctuation, and ends on a capitalised word.
        self.org = regex.compile(rf"(?:{heads})(?:(?:\s+(?:(?i:{inner})(?![\p{{L}}]))*)*\s+(?:TP\.?|Q\.?|\p{{Lu}}[\p{{L}}\p{{N}}\-/]*)(?![\p{{L}}]))*")
        self.plain = [(regex.compile(V.MONEY_A, regex.I), "MONEY"), (regex.compile(V.TIME_A, regex.I), "TIME"), (regex.compile(V.DRUG_A, regex.I), "DRUG")]

    def __call__(self, text: str) -> list[tuple[int, int, str, str]]:
        found: list[tuple] = []
        for rx in self.crime:
            for m in rx.finditer(text):
                at = m.start(1)
                edges = [(x.start(), x.end()) for x in self.joined.finditer(m.group(1))]
                for a, z in zip([0, *(e for _, e in edges)], [*(s for s, _ in edges), len(m.group(1))], strict=True):
                    part = m.group(1)[a:z].rstrip()
                    if part.strip():
                        found.append((at + a, at + a + len(part), "CRIME", 0))
        found += [(*m.span(), "ORGANIZATION", 1) for m in self.org.finditer(text)]
        found += [(*m.span(), label, 2) for rx, label in self.plain for m in rx.finditer(text) if m.group().strip()]
        if self.tagger is not None:
            found += [(a, z, label, 3) for a, z, label in self.tagger(text)]
        return [(a, z, text[a:z], lab) for a, z, lab, _ in _select(found, lambda s: (s[3], s[0] - s[1]))]


class _Sentence:
    """Tokens of one text with what the rules ask of them, and how far a name goes on from a token."""

    def __init__(self, text: str, rules: "RuleRecogniser"):
        self.text, self.rules = text, rules
        self.toks = [(m.start(), m.end(), m.group()) for m in rules.token.finditer(text)]
        self.low = [rules.norm(t[2]) for t in self.toks]
        self.n = len(self.toks)

    def word(self, i: int) -> str:
        return self.low[i] if 0 <= i < self.n else ""

    def sign(self, i: int) -> str:
        return self.toks[i][2] if 0 <= i < self.n else ""

    def capital(self, i: int) -> bool:
        return self.sign(i)[:1].isupper()

    def named(self, i: int) -> bool:
        return self.capital(i) or self.sign(i).isdigit()

    def has(self, i: int, words: list[str]) -> bool:
        return self.low[i : i + len(words)] == words

    def cue_within(self, a: int, z: int) -> bool:
        """Whether an agency or administrative unit overlaps the tokens."""
        return any(self.has(i, w) and i < z and a < i + len(w) for i in range(max(0, a - 4), z) for w in self.rules.barrier.get(self.word(i), ()))

    def _run(self, i: int, limit: int, fits, joints: str) -> int:
        """Tokens that fit, and joints between two of them, up to a stop word."""
        j, stop = i, self.rules.stop
        while j < min(self.n, i + limit) and self.low[j] not in stop:
            if not fits(j) and not (self.sign(j) in joints and fits(j + 1) and self.word(j + 1) not in stop):
                break
            j += 1
        return j

    def person(self, i: int) -> int:
        return self._run(i, 4, self.capital, ".")

    def place(self, i: int) -> int:
        return self._run(i, 6, self.named, ".-")

    def organisation(self, i: int) -> int:
        """Where the name that follows a cue ends: a walk over the tokens with two states, whether a part of a name came last and whether the police was named."""
        r, j, name, police = self.rules, i, False, False
        while j < min(self.n, i + 14):
            w, sign, nxt = self.low[j], self.sign(j), self.word(j + 1)
            unit = next((u for u in r.inside if self.has(j, u)), None) if name and not police else None
            if unit:
                j += len(unit)
                continue
            if w in r.block:
                break
            if self.named(j) or sign == "&":
                name = True
            elif sign in (".", "-") and self.named(j + 1) and nxt not in r.block and nxt not in r.stop or sign == "," and name and nxt in r.after_comma:
                pass
            elif w == "và":
                # "And" joins parts of a name, not two agencies.
                if not name or j + 1 >= self.n or (nxt in r.heads and self.capital(j + 1)):
                    break
            elif w == "an" and j > i and self.word(j - 1) == "công" and not police:
                name = police = True
            elif police or j == i:
                if w not in r.after_cue:
                    break
                name = True
            elif w == "báo" and self.word(j - 1) == "nhà":
                name = True
            elif not (name and w in r.inner and self._goes_on(j)):
                break
            j += 1
        return self._trimmed(i, j)

    def _goes_on(self, j: int) -> bool:
        """Whether a small word is within a name: it is one that may end it, or the next token continues it or is no word."""
        return self.low[j] in self.rules.final or j + 1 >= self.n or not any(c.isalnum() for c in self.sign(j + 1)) or self.named(j + 1) or self.word(j + 1) in self.rules.inner

    def _trimmed(self, i: int, j: int) -> int:
        """Without trailing signs, numbers that belong to nothing and words that end no name."""
        while j > i:
            last = self.sign(j - 1)
            if last.isdigit():
                if j - 2 >= i and (self.word(j - 2) in self.rules.number_prefix or self.sign(j - 2) == "."):
                    break
            elif not (last in (".", "-") or (self.word(j - 1) in self.rules.dangling and not self.capital(j - 1))):
                break
            j -= 1
        return j


class RuleRecogniser:
    """Recogniser B: candidates with priorities from rules over tokens, the best of which is selected."""

    def __init__(self, dictionary: dict[str, list[str]] | None = None):
        self.token = regex.compile(r"[\p{L}\p{M}\p{N}]+|[^\w\s]")
        self.inner, self.surnames, self.titles = set(V.ORG_INNER_B), set(V.SURNAMES_B), set(V.TITLES_B)
        self.block, self.stop, self.final, self.dangling = set(V.ORG_BLOCK_B), set(V.NAME_STOP_B), set(V.ORG_FINAL_B), set(V.ORG_DANGLING_B)
        self.after_comma, self.after_cue, self.number_prefix = set(V.ORG_COMMA_B), set(V.ORG_AFTER_CUE_B), set(V.ORG_NUMBER_PREFIX_B)
        self.offices, self.name_block, self.not_after, self.place_words = set(V.OFFICES_B), set(V.NAME_BLOCK_B), set(V.NAME_NOT_AFTER_B), set(V.PLACE_WORDS_B)
        self.noise = set(V.PRODUCT_NOISE_B)
        self.inside = [self._words(u) for u in V.ORG_UNITS_B]
        cues, alone, units = ([self._words(x) for x in some] for some in (V.ORG_CUES_B, V.ORG_ALONE_B, V.PLACE_UNITS_B))
        self.heads = {w[0] for w in (*cues, *alone)}
        self.barrier: dict[str, list[list[str]]] = {}
        for w in (*cues, *alone, *units):
            # "CA" is a cue in capitals only; a name may have that word.
            if w != ["ca"]:
                self.barrier.setdefault(w[0], []).append(w)
        self.times = [(regex.compile(p, regex.I), n) for p, n in V.TIMES_B]
        self.money = regex.compile(V.MONEY_B, regex.I)
        # Phrases by their first word, so that a token is compared only with phrases it may begin.
        fixed = (("DRUG", V.DRUG_TERMS_B), ("PRODUCT", V.PRODUCT_TERMS_B), ("CRIME", V.CRIME_TERMS_B))
        groups = {
            "dictionary": [(lab, self._words(p), 120) for lab, some in (dictionary or {}).items() for p in some],
            "phrase": [(lab, self._words(p), 90) for lab, some in fixed for p in some],
            "place": [("LOCATION", self._words(p), 72) for p in V.PLACES_B],
            "cue": [("", w, 0) for w in cues],
            "alone": [("", w, 0) for w in alone],
            "unit": [("", w, 0) for w in units],
            "role": [("", self._words(p), 0) for p in V.ROLE_PHRASES_B],
            "brand": [("", self._words(p), 0) for p in V.BRAND_HEADS_B],
        }
        self.by_first: dict[str, list[tuple[str, list[str], int]]] = {}
        for kind, some in groups.items():
            for lab, w, base in some:
                # Of a group, longer phrases rank higher.
                self.by_first.setdefault(f"{kind}:{w[0]}", []).append((lab, w, base + len(w)))

    @staticmethod
    def norm(word: str) -> str:
        return unicodedata.normalize("NFC", word.replace("Ð", "Đ").replace("ð", "đ")).casefold().replace("tuý", "túy").replace("uỷ", "ủy")

    def _words(self, phrase: str) -> list[str]:
        return [self.norm(m.group()) for m in self.token.finditer(phrase)]

    def candidates(self, text: str) -> list[tuple[int, int, str, str, int]]:
        """(start, end, label, rule, priority)."""
        s = _Sentence(text, self)
        out: list[tuple[int, int, str, str, int]] = []

        def add(i: int, j: int, label: str, rule: str, priority: int):
            if i < j:
                out.append((s.toks[i][0], s.toks[j - 1][1], label, rule, priority))

        def at(kind: str, i: int) -> list[tuple[str, list[str], int]]:
            return [x for x in self.by_first.get(f"{kind}:{s.word(i)}", ()) if s.has(i, x[1])]

        generic = 0
        for i in range(s.n):
            for label, words, rank in at("dictionary", i):
                add(i, i + len(words), label, "dictionary", rank)
            for kind in ("alone", "cue"):
                for _, words, _ in at(kind, i):
                    end = i + len(words)
                    if not (s.capital(i) or s.named(end) or s.word(end) in self.after_cue):
                        continue
                    if kind == "cue" and (s.word(i - 1) in self.offices or (words == ["ca"] and not s.sign(i).isupper())):
                        continue
                    stop = s.organisation(end)
                    if kind == "alone" or stop > end:
                        add(i, max(end, stop), "ORGANIZATION", kind, 110)
            if s.low[i] in ("ở", "tại", "thuộc") and s.capital(i + 1) and s.word(i + 1) not in self.place_words | self.offices:
                stop = s.place(i + 1)
                if not s.cue_within(i + 1, stop):
                    add(i + 1, stop, "LOCATION", "preposition", 65)
            for _, words, _ in at("unit", i):
                start = i + len(words)
                start += s.sign(start) == "."
                stop = s.place(start)
                if stop > start:
                    add(i, stop, "LOCATION", "unit", 80)
            for label, words, rank in at("place", i):
                if s.word(i - 1) != "người" and s.word(i - 1) not in self.place_words:
                    add(i, i + len(words), label, "gazetteer", rank)
            people = [(i + 1, 85, "title")] if s.low[i] in self.titles else []
            people += [(i + len(words), 60, "role") for _, words, _ in at("role", i)]
            for start, priority, rule in people:
                stop = s.person(start) if s.capital(start) else start
                if not s.cue_within(start, stop):
                    add(start, stop, "PERSON", rule, priority)
            if i >= generic and s.capital(i) and s.low[i] not in self.name_block and s.word(i - 1) not in self.not_after:
                stop = s.person(i)
                if stop - i >= 2 and s.low[i] in self.surnames and not s.cue_within(i, stop):
                    add(i, stop, "PERSON", "surname", 35)
                generic = max(stop, i + 1)
            for label, words, rank in at("phrase", i):
                start, end = i, i + len(words)
                if words == ["dao"] and s.word(end) == "động":
                    continue
                while label == "PRODUCT" and start < end - 1 and s.low[start] in self.noise:
                    start += 1
                add(start, end, label, "phrase", rank)
            for _, words, _ in at("brand", i):
                end = i + len(words)
                if s.word(end) == "hiệu" and s.person(end + 1) > end + 1:
                    add(i, s.person(end + 1), "PRODUCT", "brand", 95)
        starts, ends = {t[0] for t in s.toks}, {t[1] for t in s.toks}
        # Regular expressions count where both ends are token ends.
        for rx, label, rule, priority in [*((rx, "TIME", "time", n) for rx, n in self.times), (self.money, "MONEY", "money", 105)]:
            for m in rx.finditer(text):
                born = label == "TIME" and priority == 100 and regex.fullmatch(r"(?:19|20)\d{2}", m.group()) and regex.search(r"(?:sinh|SN)\s*$", text[max(0, m.start() - 12) : m.start()], regex.I)
                if m.start() in starts and m.end() in ends and not born:
                    out.append((m.start(), m.end(), label, rule, priority))
        return out

    def explain(self, text: str) -> list[tuple]:
        """All candidates, one per extent and the first of the highest priority, with whether they were selected."""
        best: dict[tuple[int, int], tuple] = {}
        for c in self.candidates(text):
            if (c[0], c[1]) not in best or c[4] > best[c[0], c[1]][4]:
                best[c[0], c[1]] = c
        chosen = set(_select(list(best.values()), lambda s: (-s[4], s[0] - s[1], s[0])))
        return [(*c[:2], text[c[0] : c[1]], *c[2:], c in chosen) for c in sorted(best.values())]

    def __call__(self, text: str) -> list[tuple[int, int, str, str]]:
        return [(a, z, t, lab) for a, z, t, lab, _, _, sel in self.explain(text) if sel]


_READY: dict[str, object] = {}


def _recogniser(engine: str, dictionary: dict[str, list[str]] | None):
    """The recogniser of this worker, made once for each vocabulary."""
    key = f"{engine}:{dictionary}"
    if key not in _READY:
        _READY[key] = PreAnnotation() if engine == "preannotation" else RuleRecogniser(dictionary)
    return _READY[key]


def recognised(text: str, engine: str = "rules", dictionary: dict[str, list[str]] | None = None) -> list[dict]:
    """Entities of one text, composed first."""
    return [dict(zip(("start", "end", "text", "label"), s, strict=True)) for s in _recogniser(engine, dictionary)(unicodedata.normalize("NFC", text))]


def entities(text: Column, engine: str = "rules", dictionary: dict[str, list[str]] | None = None) -> Column:
    """Entities by the "rules" (B) or "preannotation" (A) recogniser; texts are composed (NFC) first, as offsets refer to that form."""

    @F.pandas_udf(SPAN)
    def find(texts: pd.Series) -> pd.Series:
        return pd.Series([recognised(t, engine, dictionary) if t else [] for t in texts])

    return find(text)


def explained(text: Column, dictionary: dict[str, list[str]] | None = None) -> Column:
    """All candidates of the rule recogniser with rule, priority and whether they were selected."""

    @F.pandas_udf(PROVENANCE)
    def find(texts: pd.Series) -> pd.Series:
        run = _recogniser("rules", dictionary)
        names = ("start", "end", "text", "label", "rule", "priority", "selected")
        return pd.Series([[dict(zip(names, s, strict=True)) for s in run.explain(unicodedata.normalize("NFC", t))] if t else [] for t in texts])

    return find(text)
