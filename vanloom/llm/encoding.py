"""Problem 2: garbled text from wrong character encoding.

A character trigram model is trained on the clean records. For every record with unusual characters each
candidate chain (encode with the wrong codec, decode with the right one) is applied to the
stretches it can explain, and the likeliest is accepted where the model prefers it by more
than a margin validated on held-out records that are garbled on purpose. Text whose bytes were lost (U+FFFD,
or question marks inside words) is reported but cannot be restored.

Null and empty texts are never cases. Texts are handled whole, whatever their length. Repeated rows
each get their result. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vanloom.llm.charmodel import CharModel, Counts, gathered
from vanloom.session import cut

FIELDS = ("Content", "Summarize")
#: Wrong codecs of UTF-8 text. "western" is Windows-1252 with Latin-1 controls for its unused bytes.
WRONG = ("western", "cp1258", "cp1250", "mac_roman", "cp437", "cp1254")
#: Log-probability gain per character that a restored stretch must reach; see validated_margin().
MARGIN = 0.6

# The Vietnamese legacy code page TCVN 5712 (ABC fonts), byte as Windows-1252 shows it -> letter.
TCVN = dict(zip(
    "µ¶·¸¹¨»¼½¾Æ©ÇÈÉÊË®ÌÎÏÐÑªÒÓÔÕÖ×ØÜÝÞßáâãä«åæçèé¬êëìíîïñòóô­õö÷øùúûüýþ¡¢£¤¥¦§",
    "àảãáạăằẳẵắặâầẩẫấậđèẻẽéẹêềểễếệìỉĩíịòỏõóọôồổỗốộơờởỡớợùủũúụưừửữứựỳỷỹýỵĂÂÊÔƠƯĐ", strict=True))
#: Of these: signs, which no word contains, and capitals, which no word has after a small letter.
_SIGN = "µ¶·¸¹¨»¼½¾©ª«¬®\xad§¡¢£¤¥¦×÷"
_CAPITAL = "ÆÇÈËÌÎÏÐÑÖØÜÞ"
_URL = re.compile(r"(?:https?://|www\.)\S+")
_LOST = regex.compile(r"\p{L}\?\p{Ll}|(?:^|(?<=[\s“\"(]))\?+\p{Ll}|\?\?\p{Ll}|\p{L}\?\?(?=[\s\p{Ll}])")


class _Undone(dict):
    """Sequence of a wrong codec's characters -> what it was, or null; the sequences met are few and are decoded once."""

    def __init__(self, inverse: dict[str, int]):
        self.inverse = inverse

    def __missing__(self, seq: str) -> str | None:
        try:
            got = bytes(self.inverse[c] for c in seq).decode("utf-8")
        except UnicodeDecodeError:
            got = None
        if len(self) > 1 << 16:
            self.clear()
        self[seq] = got
        return got


class _Once:
    """The model and the steps while one text is restored: no string is scored twice, and no chain of a stretch followed twice,
    though stretches come up under several codecs and again in each round."""

    def __init__(self, model: CharModel):
        self.model = model
        self.means: dict[str, float] = {}
        self.chains: dict[tuple, tuple[float, str, tuple[str, ...]]] = {}
        self.steps: dict[tuple[str, str], tuple[str, int]] = {}

    def mean(self, text: str) -> float:
        got = self.means.get(text)
        if got is None:
            got = self.means[text] = self.model.mean(text)
        return got

    def replace(self, text: str, codec: str) -> tuple[str, int]:
        got = self.steps.get((text, codec))
        if got is None:
            undone, rx = _image(codec)
            got = self.steps[text, codec] = _replace(text, rx, undone)
        return got

    def chain(self, text: str, codec: str, left: str, right: str, margin: float) -> tuple[float, str, tuple[str, ...]]:
        key = text, codec, left, right
        got = self.chains.get(key)
        if got is None:
            got = self.chains[key] = _best_chain(text, codec, lambda s: self.mean(left + s + right), margin, self.replace)
        return got


def _as_is(text: str, model: "CharModel | _Once") -> float:
    """Score of the text taken as it stands, no-break spaces and soft hyphens being mere formatting (problem 5)."""
    plain = text.replace("\xa0", " ").replace("\xad", "")
    return max(model.mean(text), model.mean(plain)) if plain != text else model.mean(text)


def _clusters(spans: list[tuple[int, int]], gap: int) -> list[list[int]]:
    out: list[list[int]] = []
    for k, (s, _) in enumerate(spans):
        if out and s - spans[out[-1][-1]][1] <= gap:
            out[-1].append(k)
        else:
            out.append([k])
    return out


def _replace(text: str, rx: re.Pattern, undone: _Undone) -> tuple[str, int]:
    """Undoes every well-formed sequence; (text, how many)."""
    n = 0

    def one(m: re.Match) -> str:
        nonlocal n
        d = undone[m.group()]
        n += d is not None
        return m.group() if d is None else d

    return rx.sub(one, text), n


def _shown(codec: str) -> list[set[str]]:
    """The characters as which each high byte may appear under a wrong codec."""
    out: list[set[str]] = [set() for _ in range(256)]
    for b in range(128, 256):
        for n in ("cp1252", "latin-1") if codec == "western" else (codec,):
            try:
                out[b].add(bytes([b]).decode(n))
            except UnicodeDecodeError:
                out[b].add(chr(b))
    return out


def _class(shown: list[set[str]], a: int, z: int) -> str:
    return "[" + "".join(sorted("\\" + c if c in "\\]^-[" else c for b in range(a, z + 1) for c in shown[b])) + "]"


def _sequences(codec: str) -> str:
    """Pattern of well-formed UTF-8 sequences as the characters of the wrong codec."""
    shown = _shown(codec)
    k = _class(shown, 0x80, 0xBF)
    return f"{_class(shown, 0xC2, 0xDF)}{k}|{_class(shown, 0xE0, 0xEF)}{k}{k}|{_class(shown, 0xF0, 0xF4)}{k}{k}{k}"


@lru_cache(None)
def _image(codec: str) -> tuple[_Undone, re.Pattern]:
    """What the sequences of the wrong codec were (from character -> byte), and its pattern of UTF-8 sequences."""
    return _Undone({c: b for b, some in enumerate(_shown(codec)) for c in some}), re.compile(_sequences(codec))


@lru_cache(None)
def _any_sequence() -> re.Pattern:
    return re.compile("|".join(_sequences(c) for c in WRONG))


def _legacy(text: str) -> bool:
    """Whether the letters beyond ASCII are those of the legacy code page, but for a tenth; leftovers of lost bytes stand among other letters."""
    high = [c for c in text if ord(c) > 127 and c not in "“”‘’–…"]
    return 10 * sum(c not in TCVN for c in high) <= len(high)


def _best_chain(text: str, codec: str, score: Callable[[str], float], margin: float, replace: Callable[[str, str], tuple[str, int]]) -> tuple[float, str, tuple[str, ...]]:
    """(score, text, steps) of the likeliest chain that begins with ``codec``; steps may differ. A text that a step has
    brought to light is also read in the legacy code page, as its damage may have been the older one.

    Every reading is followed until nothing is left to undo. Each step makes the text shorter, and a reading that several chains reach is followed once."""
    best: tuple[float, str, tuple[str, ...]] = (float("-inf"), text, ())
    open_, seen = [(text, ())], {text}
    while open_:
        after = []
        for now, steps in open_:
            # Most texts are whole after one step: one search for any codec's sequences tells.
            for c in (codec,) if not steps else WRONG if _any_sequence().search(now) else ():
                new, done = replace(now, c)
                if not done or new in seen:
                    continue
                seen.add(new)
                got = score(new)
                after.append((new, (*steps, c)))
                if got > best[0]:
                    best = (got, new, (*steps, c))
                if _NEAR.search(new) and _legacy(new):
                    old = "".join(TCVN.get(x, x) for x in new)
                    if (more := score(old)) > max(best[0], got + margin):
                        best = (more, old, (*steps, c, "tcvn3"))
        open_ = after
    return best


def _utf8(text: str, model: _Once, margin: float) -> tuple[str, str, int]:
    """The likeliest chain of each stretch: new text, steps, accepted stretches."""
    fits: list[tuple[float, str, int, int, str, tuple[str, ...]]] = []
    total = dict.fromkeys(WRONG, 0.0)
    for codec in WRONG:
        found = [m.span() for m in _image(codec)[1].finditer(text)]
        if not found:
            continue
        before = None
        for group in _clusters(found, 24):
            a, z = found[group[0]][0], found[group[-1]][1]
            # A stretch that was garbled twice has a frame of leftovers; widen it to the words it touches.
            while a > 0 and not text[a - 1].isspace():
                a -= 1
            while z < len(text) and not text[z].isspace():
                z += 1
            # Clusters in one word widen to the same stretch; others that overlap are all read.
            if (a, z) == before:
                continue
            before = a, z
            left, right = text[max(0, a - 3) : a], text[z : z + 3]
            base = _as_is(left + text[a:z] + right, model)
            score, keep, steps = model.chain(text[a:z], codec, left, right, margin)
            if score - base > margin:
                fits.append(((score - base) * (z - a), codec, a, z, keep, steps))
                total[codec] += (score - base) * (z - a)
    # Of stretches that overlap, the one that gains most; of equal ones, the codec that gains most in the text.
    taken: list[tuple[int, int, str, tuple[str, ...]]] = []
    for _, codec, a, z, keep, steps in sorted(fits, key=lambda f: (-round(f[0], 6), -total[f[1]])):
        if all(z <= b or y <= a for b, y, *_ in taken):
            taken.append((a, z, keep, steps))
    new, last, chains = [], 0, []
    for a, z, keep, steps in sorted(taken):
        new += [text[last:a], keep]
        last = z
        if steps not in chains:
            chains.append(steps)
    # A chain that another one begins with is not named again.
    chains = [c for c in chains if not any(d != c and d[: len(c)] == c for d in chains)]
    names = [f"utf-8>{s}" if s != "tcvn3" else "tcvn3>western" for c in chains for s in c]
    return "".join(new) + text[last:], "+".join(names), len(taken)


_WORD = re.compile(r"\S+")
_NEAR = re.compile(f"[^\\W\\d_][{_SIGN}ßøþ]|[{_SIGN}](?:[^\\W\\d_]|[µ¶·¸¹¨¼½¾ª¬®\xad])|[a-zà-ÿ{_SIGN}][{_CAPITAL}]")


def _tcvn(text: str, model: _Once, margin: float) -> tuple[str, int]:
    """Undoes the legacy code page in runs of words; (text, accepted stretches)."""
    words = list(_WORD.finditer(text))
    able = [any(c in TCVN for c in m.group()) and all(ord(c) < 128 or c in TCVN or c in "“”‘’–…" for c in m.group()) for m in words]
    strong = [ok and _NEAR.search(m.group()) is not None for ok, m in zip(able, words, strict=True)]
    if not any(strong):
        return text, 0
    out, last, n = [], 0, 0
    k = 0
    while k < len(words):
        if not able[k]:
            k += 1
            continue
        end, far, plain = k, k, 0
        while far + 1 < len(words):
            far += 1
            raw = words[far].group()
            if able[far]:
                end, plain = far, 0
            elif all(ord(c) < 128 for c in raw) and plain < 6:
                plain += 1
            else:
                break
        if any(strong[k : end + 1]):
            fixed = []
            for j in range(k, end + 1):
                m = words[j]
                raw = m.group()
                new = "".join(TCVN.get(c, c) for c in raw)
                a, z = text[max(0, m.start() - 2) : m.start()], text[m.end() : m.end() + 1]
                fixed.append(new if able[j] and model.mean(a + new + z) > _as_is(a + raw + z, model) else raw)
            a, z = words[k].start(), words[end].end()
            pieces, at = [], a
            for j, new in zip(range(k, end + 1), fixed, strict=True):
                pieces += [text[at : words[j].start()], new]
                at = words[j].end()
            whole = "".join(pieces)
            if whole != text[a:z]:
                changed = [(words[j].group(), new) for j, new in zip(range(k, end + 1), fixed, strict=True) if new != words[j].group()]
                gain = np.mean([model.mean(f" {b} ") - _as_is(f" {r} ", model) for r, b in changed])
                if gain > margin and any(_NEAR.search(r) for r, _ in changed):
                    out += [text[last:a], whole]
                    last = z
                    n += 1
        k = end + 1
    return ("".join(out) + text[last:], n) if n else (text, 0)


@dataclass
class Repair:
    text: str
    chain: str
    stretches: int
    lost: bool


def repair(text: str | None, model: CharModel, margin: float = MARGIN) -> Repair:
    """Restores one text; ``chain`` is empty where nothing was wrong."""
    if not text:
        return Repair(text, "", 0, False)
    now, steps, total, once = text, [], 0, _Once(model)
    # Each round makes the text shorter, so this ends.
    while True:
        now, chain, n = _utf8(now, once, margin)
        if not n:
            break
        steps.append(chain)
        total += n
    now, n = _tcvn(now, once, margin)
    steps += ["tcvn3>western"] * (n > 0)
    total += n
    lost = "�" in now or ("?" in now and _LOST.search(_URL.sub(" ", now)) is not None)
    if lost:
        steps.append("lost")
    return Repair(now, "+".join(steps), total, lost)


def garble(text: str, chain: str) -> str:
    """The damage that ``repair`` undoes; for validation and tests."""
    if chain == "tcvn3":
        back = {v: k for k, v in TCVN.items()}
        return "".join(back.get(c, c) for c in text)
    if chain == "western":
        return "".join(c for b in text.encode("utf-8") for c in (bytes([b]).decode("cp1252", "ignore") or chr(b)))
    return text.encode("utf-8").decode(chain, "replace")


#: First sieve (RE2 syntax): a UTF-8 sequence under some wrong codec, a code-page letter within a word, or lost letters.
ODD = "|".join(
    [_sequences(c) for c in WRONG]
    + [rf"\p{{L}}[{_SIGN}ßøþ]|[{_SIGN}](?:\p{{L}}|[µ¶·¸¹¨¼½¾ª¬®\xad])|[a-zà-ÿ{_SIGN}][{_CAPITAL}]"]
    + [r"\x{fffd}|\p{L}\?\p{Ll}|(?:^|[\s“\"(])\?+\p{Ll}|\?\?\p{Ll}|\p{L}\?\?"]
)


def suspicious(texts: pa.Array) -> pa.Array:
    """First sieve: true for every text that ``repair`` could change or report; null texts are false."""
    return pc.fill_null(pc.match_substring_regex(texts, ODD), False)


def scan(records: DataFrame, keys: dict[str, str], fields: tuple[str, ...], pick: Callable[[pa.Array, pa.Array], list[str | None]]) -> tuple[CharModel, DataFrame]:
    """One pass over all records: the model of the clean texts, and the picked texts.

    ``keys`` maps the key columns of the second result to SQL types. ``pick`` gets the texts of a
    field and the sieve's verdicts and returns, for each text, what to keep of it (null: nothing).
    The pass is written to the shared folder, so neither part is computed twice.
    """
    names = list(keys)
    schema = ", ".join([*(f"{k} {t}" for k, t in keys.items()), "field_name string", "text string", "kept string", "bucket int", "n bigint"])

    def run(batches):
        counts, types = Counts(), None
        for b in batches:
            types = [b.schema.field(i).type for i in range(len(names))]
            for i, f in enumerate(fields, len(names)):
                texts = b.column(i)
                odd = suspicious(texts)
                counts.add(texts.filter(pc.and_(pc.invert(odd), pc.is_valid(texts))).to_pylist())
                kept = pa.array(pick(texts, odd), pa.string())
                some = pc.is_valid(kept)
                n = pc.sum(some.cast(pa.int64())).as_py() or 0
                if n:
                    yield pa.RecordBatch.from_arrays([*(b.column(j).filter(some) for j in range(len(names))), pa.array([f] * n), texts.filter(some), kept.filter(some), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())], names=[*names, "field_name", "text", "kept", "bucket", "n"])
        if types is not None:
            at, n = counts.rows()
            none = pa.nulls(len(at), pa.string())
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(at), t) for t in types), none, none, none, at, n], names=[*names, "field_name", "text", "kept", "bucket", "n"])

    done = cut(records.select(*[F.col(k).cast(t).alias(k) for k, t in keys.items()], *[F.col(f).alias(f"_{i}") for i, f in enumerate(fields)]).mapInArrow(run, schema))
    model = gathered(done.where("bucket is not null").select("bucket", "n"))
    return model, done.where("bucket is null").select(*names, "field_name", "text", "kept")


def fit(records: DataFrame, fields: tuple[str, ...] = FIELDS) -> CharModel:
    """Model of all records' clean fields."""
    return scan(records, {}, fields, lambda texts, odd: [None] * len(texts))[0]


def validated_margin(texts: list[str], model: CharModel) -> tuple[float, float]:
    """The margin with the best F1 on held-out clean texts, and that F1.

    The texts are cut into sentences of which every second is garbled by one of the chains; the margin is the
    one at which garbled and intact sentences are told apart best.
    """
    chains = ("western", "latin-1", "cp1258", "cp1250", "mac_roman", "tcvn3")
    cases: list[tuple[str, bool]] = []
    for k, text in enumerate(texts):
        for j, part in enumerate(re.split(r"(?<=[.!?])\s+", text)):
            bad = garble(part, chains[(k + j) % len(chains)]) if j % 2 else part
            cases.append((bad, bad != part))
    best = (MARGIN, 0.0)
    for m in (0.2, 0.4, 0.6, 0.8, 1.0, 1.4, 2.0):
        said = [bool(repair(t, model, m).chain) for t, _ in cases]
        tp = sum(a and b for a, (_, b) in zip(said, cases, strict=True))
        f1 = 2 * tp / max(1, sum(said) + sum(b for _, b in cases))
        if f1 > best[1] + 1e-9:
            best = (m, f1)
    return best


def repaired(records: DataFrame, keys: dict[str, str], fields: tuple[str, ...] = FIELDS, margin: float = MARGIN) -> DataFrame:
    """``keys, field_name, chain, stretches, lost, restored`` for each damaged field of each record."""
    model, odd = scan(records, keys, fields, lambda texts, verdicts: [t if v else None for t, v in zip(texts.to_pylist(), verdicts.to_pylist(), strict=True)])
    shared = records.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("chain string, stretches int, lost boolean, restored string")
    def mend(texts: pd.Series) -> pd.DataFrame:
        done: dict[str, Repair] = {t: repair(t, shared.value, margin) for t in texts.unique()}
        got = [done[t] for t in texts]
        return pd.DataFrame({"chain": [g.chain for g in got], "stretches": [g.stretches for g in got], "lost": [g.lost for g in got], "restored": [g.text for g in got]})

    rows = odd.select(*keys, "field_name", mend("text").alias("_r")).where("_r.chain <> ''")
    return rows.select(*keys, "field_name", "_r.*")


def garbled_fields(records: DataFrame) -> DataFrame:
    """``article_id, field_name`` of damaged fields, restorable or not."""
    return repaired(records, {"article_id": "bigint"}).select("article_id", "field_name")
