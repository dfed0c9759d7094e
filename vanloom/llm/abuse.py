"""Problem 10: abusive, hateful or sexual content.

A weighted finite-state grammar in two stages. The first transducer undoes disguises: look-alike characters, digits
and masks for letters, separated or repeated letters, dropped accents. The second matches phrases
of the classes below over the restored words of a clause, longest first, so that a harmless longer
phrase shields the word in it. The string of classes then runs through the transducers of ``RULES``, one after the other: negation
strikes out what it governs, reported speech and warnings take weight away from what is close to them, targets and groups
add to what is hostile. A clause counts, not an isolated word.

The score of a document is that of its worst clause. Null and empty texts score 0. Every line of the whole
text is read. Lexicons are parameters (``Grammar``).
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vanloom.llm.lookalike import LIKE, SIEVE, unify

THRESHOLD = 1.0
#: Longest clause in words; longer ones are read in overlapping windows.
WINDOW = 120

#: Words of reporting count up to so many words before and after what they report.
BEFORE, AFTER = 6, 4
#: A negation governs what begins up to so many words after it.
GOVERNS = 3

#: Phrases by class, with the weight of the class's phrase (``phrase`` or ``phrase=weight``).
LEXICON: dict[str, str] = {
    "insult": """
        ngu như bò; ngu xuẩn; ngu si; ngu dốt; đần độn; óc chó; óc bã đậu; óc lợn; súc vật; súc sinh; chó má; chó đẻ; chó chết; mặt lợn; mặt chó; khốn nạn; khốn kiếp;
        mất dạy; vô học; vô lại; bẩn thỉu; thối tha; thối nát; rác rưởi; đểu cáng; đểu giả; hạ tiện; hèn hạ; đê tiện; đồ bỏ đi; đồ chó; đồ lợn; đồ ngu; đồ khốn; đồ điên; đồ hèn; cặn bã;
        ăn hại; ăn bám; mọi rợ; man rợ; lười biếng=0.4; lừa lọc=0.4; phá hoại=0.3; trộm cướp=0.3; bẩn như chuột; không đáng làm người; dơ dáy; dơ bẩn; con đĩ; đĩ thõa; điếm thúi; thằng khốn; thằng chó; thằng ngu;
        nhìn như cái bô; xấu người xấu nết; sống chỉ tốn cơm; sống chỉ chật đất; hết thuốc chữa=0.4; thế mà cũng đòi=0.3; câm mồm; câm họng; im mồm; ngậm mồm; khuất mắt=0.4;
        idiot; idiots; moron; morons; imbecile; retard; scumbag; asshole; bastard; bastards; bitch; bitches; slut; whore; cunt; dumb fuck; dumbass; piece of shit; shithead; filthy rat; filthy pig;
        worthless pig; worthless trash; brainless clown; brainless; loser=0.4; stupid=0.5; trash=0.3; subhuman; shut your mouth; shut the fuck up; nobody * wants you=0.5;
        cretin; cretins; degenerate; degenerates; cockroach; cockroaches; swine; pervert=0.4; dimwit; halfwit; pathetic=0.3; filth=0.4; scum; lowlife; jerk=0.4;
        connard; connasse; salope; enculé; fils de pute; pauvre con; sale con; sale pute; pute; ordure=0.4; crétin; une merde; une vraie merde; abruti; sous-merde;
        arschloch; dreckskerl; missgeburt; hurensohn; schlampe; wichser; drecksau""",
    "vulgar": """
        địt mẹ; địt con mẹ; địt; đụ má; đụ mẹ; đm; đmm; dkm; vcl; vkl; cc mày; mẹ kiếp; mẹ mày; bố mày; tổ sư; clgt; fuck you; fucking; fuck; fucker; motherfucker; go to hell; nique ta mère; va te faire""",
    "threat": """
        cho ăn dao=1; cho ăn đòn; đập vỡ mặt=0.9; đập chết; đánh chết; chém chết; giết chết=0.5; giết mày=1; giết cả nhà=1; xiên chết; đốt nhà chúng nó=1; đốt nhà=0.5; đi chết đi=0.9; chết đi=0.6; chết hết=0.6; chết hết càng tốt=1; khỏi cần tòa xử=0.4; cút đi=0.5; cút khỏi=0.6; cút về=0.6;
        biến khỏi=0.5; coi chừng cái mạng=1; là phải đánh=0.7; chửi thẳng mặt=0.5; chứ sợ gì=0.2; i hope you die=1; hope you die; die in a ditch=0.8; kill you=1; kill yourself=1; i will find you; nobody would miss=0.7; someone ran that thing over=0.7; ran you over; beat you up; slit your throat=1; watch your back=0.5; go die=0.7; drop dead=0.6; je vais te tuer=1; va crever=0.8; crève=0.6; ich bringe dich um=1; verrecke=0.8""",
    "group": """
        you people=0.4; those people=0.3; loại người=0.4; bọn người=0.4; bọn nhập cư=0.5; lũ theo đạo=0.5; bọn theo đạo=0.5; nhà nào theo=0.3; cứ thấy dân=0.4; đàn bà chỉ biết=0.8; lũ đàn bà=0.6; women like=0.4; all * people are=0.4; families breed=0.5; never trust a=0.5; bọn da đen; bọn mọi; sales immigrés""",
    "degrade": """
        giống hạ đẳng=1; hạ đẳng=0.7; giống mọi; diệt sạch=0.8; dọn sạch khỏi=0.8; đuổi hết khỏi=0.8; đuổi sạch; giống ấy=0.3; từ trong máu=0.7; đừng cho con cái chơi chung=0.7; cho đỡ chật=0.4; để làm gì=0.2; cho đi làm=0.2; vermin=0.8; breed like rats=1; like rats=0.4; like animals=0.4;
        wiped out=0.5; should be wiped out=0.9; throw them out=0.7; keep them out=0.7; born thieves=0.7; belong in the kitchen=0.9; go back to your country=0.9; inferior race=1; parasites=0.5""",
    "sexual": """
        vú=0.4; vú to=0.7; mông căng=0.6; mông to=0.5; sướng rên=0.8; rên la; nứng=0.8; chịch=0.9; chịch cả đêm=1; đè ra=0.4; bú liếm=0.9; bú cu=1; bú lồn=1; liếm lồn=1; lồn=0.8; cặc=0.8; buồi=0.8; khỏa thân=0.5; trần truồng=0.5; làm tình=0.5; không che=0.4; chat sex=0.7; gái gọi=0.4; show hàng=0.6; qua đêm=0.3; ib kín=0.3; ai cần ib=0.3;
        cởi hết cho anh xem=1; cởi hết=0.5; anh chiều=0.2; đủ trò=0.3; một set=0.2; dâm đãng; dâm=0.3; nude pics=0.6; nudes=0.5; nude=0.3; wet pussy=0.9; pussy=0.7; no blur=0.4; blowjob=0.9; horny=0.6; big tits=0.9; suck my dick=1; cumshot=1; anal sex=0.6; hardcore porn=0.7; bộ ảnh=0.2; clip=0.1""",
    "target": """
        mày; bọn mày; chúng mày; tụi mày; tao; thằng; con này; cái thằng; cái con; cái lũ; cái ngữ; lũ; bọn; đồ; thứ; loại; ngữ như; ngữ; chúng nó; nó; như mày; you; you are; your; yourself; they; them; tu; toi; espèce de; du bist; ihr seid; dich""",
    "negate": """
        not; not a; not an; not even; never; would never; will never; nobody is; no one is; nobody should; no one should; nobody may; don't; do not; doesn't; isn't; aren't; wasn't; without;
        không phải; không phải là; không hề; không bao giờ; chưa bao giờ; chưa từng; chẳng phải; không ai được; không ai được nói; không được; không nên; đừng gọi; đừng bao giờ; không gọi;
        pas; n'est pas; n'es pas; jamais; kein; keine; nicht; niemand""",
    "report": """
        bị phạt; phạt tiền; bị cáo; bị can; nạn nhân; bị hại; cáo trạng; phiên tòa; phiên xử; hội đồng xét xử; về tội; tội danh; lĩnh án; khai nhận; khai giết người; khai rằng; tố cáo; tố giác; trình báo; báo công an; khởi tố; điều tra; triệt phá; tạm giữ; bắt giữ; xử lý;
        văn hóa phẩm; lời lẽ; xúc phạm; bôi nhọ; chửi mắng; chửi bới; lên án; cảnh báo; cảnh giác; khuyến cáo; phòng chống; giáo dục giới tính; sức khỏe sinh sản; luật; theo luật; có điều; nghị định; quy định; có thông báo chưa; xử kín; phản ứng; dư luận; phát biểu; đưa tin;
        hắn nói; hắn chửi; ông ta nói; bà ta nói; anh ta nói; cô ta nói; hét lên; quát; he said; she said; they said; said to; he called; she called; called me; called him; called her; yelled at; shouted at; il a dit; elle a dit; convicted of; charged with; accused of; sentenced; reported that; the court; police said; warned; survey; hearing; the word; condamné; accusé de; plainte""",
    "harmless": """
        hạt óc chó; thịt lợn; đầu lợn; giết thời gian; ngu ngơ; chó nhà; con chó nhà; tính lộn; lộn; killed it; killing it; dog barked; cocktail; đồ ăn; đồ đạc; đồ dùng; đồ chơi; đồ uống; tiệm cầm đồ; cầm đồ; bản đồ; sơ đồ; thứ hai; thứ ba; thứ tư; thứ năm; thứ sáu; thứ bảy; tuần thứ; lần thứ; thứ trưởng; loại xe; loại hình; các loại; nhiều loại; bọn trẻ; con cái;
        giới tính; age and sex; sex only; sex education; same sex; quan hệ tình dục; mại dâm; hiếp dâm; xâm hại tình dục; dâm ô; khiêu dâm; đồi trụy; bú sữa; bú mẹ; tượng khỏa thân; tranh khỏa thân; bò; bao cao su; animal shit; kill time; no idea""",
}
#: Weight of a phrase without one of its own.
DEFAULT = {"insult": 0.6, "vulgar": 0.7, "threat": 0.7, "group": 0.5, "degrade": 0.7, "sexual": 0.6, "target": 0.4, "report": 0.8, "negate": 0.0, "harmless": 0.0}
HARSH = ("insult", "vulgar", "threat", "degrade", "sexual")

_LEET = str.maketrans("013457", "oieast")
_SEPARATORS = "._~=|+·-"
_SPLIT = regex.compile(rf"^[\p{{P}}\p{{S}}]*(?:\p{{L}}\p{{M}}*[{regex.escape(_SEPARATORS)}]+)+(?:\p{{L}}\p{{M}}*)?[\p{{P}}\p{{S}}]*$")
_CLAUSE = regex.compile(r"(?<=[.!?…])(?<!(?<!\p{L})\p{L}\.)\s+|\s*\p{So}+\s+")
_TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}#@*$]+(?:['’][\p{L}\p{M}]+)?")
_ACCENTED = regex.compile(r"[ăâđêôơưàáảãạằắẳẵặầấẩẫậèéẻẽẹềếểễệìíỉĩịòóỏõọồốổỗộờớởỡợùúủũụừứửữựỳýỷỹỵ]")
_SINGLE = regex.compile(r"\p{L}\p{M}*[,;:!]*")
_LETTER = regex.compile(r"\p{L}")
_MASK = regex.compile(r"[#@*$]")
_MANY = regex.compile(r"(.)\1+")


@lru_cache(200_000)
def plain(word: str) -> str:
    """Without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c)).replace("đ", "d")


def _once(word: str) -> str:
    return _MANY.sub(r"\1", word)


@dataclass(frozen=True)
class Word:
    """A restored word; ``loose`` words (accents lost or masked) also match without accents or with gaps."""

    text: str
    loose: bool = False
    masked: bool = False


def restore(clause: str) -> list[Word]:
    """The words of a clause without their disguises."""
    parts: list[str] = []
    single: list[str] = []

    def close():
        if len(single) > 1:
            parts.append("".join(single))
        else:
            parts.extend(single)
        single.clear()

    for raw in clause.split():
        token = raw
        if _SPLIT.match(raw):
            token = "".join(c for c in raw if c.isalpha() or unicodedata.combining(c))
        alone = _SINGLE.fullmatch(raw)
        if alone and not raw[0].isupper() or (alone and not single and len(raw) == 1):
            single.append(raw[0])
            continue
        close()
        parts.append(token)
    close()
    bare = not _ACCENTED.search(clause)
    out = []
    for p in parts:
        for t in _TOKEN.findall(p):
            lettered = _LETTER.search(t) is not None
            masked = lettered and _MASK.search(t) is not None
            leet = lettered and any(c.isdigit() for c in t)
            if leet:
                t = t.translate(_LEET)
            t = _once(t.strip("$") if not masked else t)
            if t:
                out.append(Word(t, loose=leet or bare, masked=masked))
    return out


#: A matched phrase: first word, word after the last, class, weight.
Mark = tuple[int, int, str, float]


def negation(tape: list[Mark]) -> tuple[list[Mark], float]:
    """Drops what a negation governs. State: the end of the last negation; whatever is harsh and begins within GOVERNS words of it
    is not said. A second negation within reach cancels the first ("not without")."""
    out: list[Mark] = []
    upto, open_ = -1, False
    for mark in tape:
        start, end, name, _ = mark
        if name == "negate":
            open_ = not (open_ and start <= upto)
            upto = end + GOVERNS
        elif name in HARSH and open_ and start <= upto:
            upto = end + GOVERNS
        else:
            out.append(mark)
    return out, 0.0


def force(tape: list[Mark]) -> tuple[list[Mark], float]:
    """Adds up what is harsh."""
    return tape, sum(weight for _, _, name, weight in tape if name in HARSH)


def address(tape: list[Mark]) -> tuple[list[Mark], float]:
    """A target makes an insult or threat of words that alone are only rude; group words alone are nothing."""
    if not any(name in HARSH and name != "sexual" and weight for _, _, name, weight in tape):
        return tape, 0.0
    weights = {c: sum(w for _, _, name, w in tape if name == c) for c in ("target", "group")}
    return tape, min(0.6, weights["target"]) + weights["group"]


def distance(tape: list[Mark]) -> tuple[list[Mark], float]:
    """Reported or warned of, by words close before or after: only language of its own force remains."""
    harsh = [(a, b) for a, b, name, _ in tape if name in HARSH]
    near = sum(weight for a, b, name, weight in tape if name == "report" and any(0 <= s - b <= BEFORE or 0 <= a - e <= AFTER for s, e in harsh))
    forceful = any(name == "vulgar" for _, _, name, _ in tape) or sum(name == "target" for _, _, name, _ in tape) > 1
    return tape, -near * (0.4 if forceful else 1.0)


#: The transducers in the order in which they are composed: each reads the tape the one before it wrote, and gives a weight.
RULES = (negation, force, address, distance)


@dataclass
class Grammar:
    """Phrases indexed by their first word, in both spellings, and by the phrase without spaces."""

    lexicon: dict[str, str] = field(default_factory=lambda: LEXICON)

    def __post_init__(self):
        self.phrases: list[tuple[tuple[str, ...], str, float]] = []
        for name, text in self.lexicon.items():
            for item in text.replace("\n", " ").split(";"):
                phrase, _, weight = item.strip().partition("=")
                if phrase.strip():
                    self.phrases.append((tuple(_once(w) for w in phrase.split()), name, float(weight) if weight else DEFAULT[name]))
        self.exact: dict[str, list[int]] = {}
        self.flat: dict[str, list[int]] = {}
        self.glued: dict[str, int] = {}
        for i, (words, _, _) in enumerate(self.phrases):
            self.exact.setdefault(words[0], []).append(i)
            self.flat.setdefault(plain(words[0]), []).append(i)
            if len(words) > 1:
                self.glued["".join(words)] = i
                self.glued[plain("".join(words))] = i
        self.first = sorted({(w[0], len(w[0])) for w, _, _ in self.phrases})

    def _fits(self, word: Word, want: str) -> bool:
        if want == "*" or word.text == want:
            return True
        if word.masked:
            a = word.text
            return len(a) == len(want) and any(c not in "#@*$" for c in a) and all(x == y or x in "#@*$" or x == plain(y) for x, y in zip(a, want, strict=True))
        return word.loose and plain(word.text) == plain(want)

    def _starts(self, word: Word) -> list[int]:
        if word.masked:
            return [i for w, n in self.first if n == len(word.text) and self._fits(word, w) for i in self.exact[w]]
        got = self.exact.get(word.text, [])
        return self.flat.get(plain(word.text), []) if word.loose else got

    def matches(self, words: list[Word]) -> list[tuple[int, int, str, float]]:
        """(start, end, class, weight): at each place the longest phrase, left to right; targets may lie inside others."""
        out = []
        k = 0
        while k < len(words):
            best: tuple[int, int] | None = None
            for i in self._starts(words[k]):
                phrase = self.phrases[i][0]
                if k + len(phrase) <= len(words) and all(self._fits(w, p) for w, p in zip(words[k : k + len(phrase)], phrase, strict=True)):
                    # Words of which only masks or bare letters are left may begin many phrases: the longest, then the heaviest.
                    rank = (len(phrase), self.phrases[i][2])
                    if best is None or rank > (len(self.phrases[best[0]][0]), self.phrases[best[0]][2]):
                        best = (i, len(phrase))
            if best is None and len(words[k].text) > 4:
                i = self.glued.get(words[k].text)
                if i is None and words[k].loose:
                    i = self.glued.get(plain(words[k].text))
                if i is not None:
                    best = (i, 1)
            if best is None:
                k += 1
                continue
            _, name, weight = self.phrases[best[0]]
            out.append((k, k + best[1], name, weight))
            k += best[1]
        return out

    def clause(self, text: str) -> float:
        """Weight of one clause."""
        words = restore(text)
        worst = 0.0
        for a in range(0, max(1, len(words)), WINDOW // 2):
            worst = max(worst, self._compose(self.matches(words[a : a + WINDOW])))
            if a + WINDOW >= len(words):
                break
        return worst

    def _compose(self, found: list[Mark]) -> float:
        tape, total = found, 0.0
        for rule in RULES:
            tape, change = rule(tape)
            total += change
        return max(0.0, round(total, 3))

    def score(self, text: str | None) -> float:
        """Weight of the worst clause of a document."""
        return max((self.clause(_fold_case(c)) for c in clauses(text)), default=0.0)


def clauses(text: str | None) -> list[str]:
    """The clauses of every line, unified."""
    out = []
    for line in (unify(text) or "").splitlines():
        line = unicodedata.normalize("NFC", line.strip())
        if line:
            out += _CLAUSE.split(line)
    return out


_CAPITALS = regex.compile(r"(?<!\p{L})(?:\p{Lu}\.){2,}(*SKIP)(*FAIL)|\p{L}[\p{L}\p{M}]+|\p{L}(?=[.\-_@#*$\p{N}])|^\p{L}")


def _fold_case(text: str) -> str:
    """Lower case, except for single capitals and chains of them, which are initials."""
    return _CAPITALS.sub(lambda m: m.group().lower(), text)


@lru_cache(1)
def default_grammar() -> Grammar:
    return Grammar()


#: Phrases that are long enough to be looked for in the running letters of a text, without spaces and accents.
LONG = 5
_HOSTILE = ("insult", "vulgar", "threat", "degrade")
MASKED = r"[\p{L}][#@*$]|[#@*$][\p{L}]"


@lru_cache(1)
def _letters() -> np.ndarray:
    """Per code point the plain small letter it may stand for, 0 for none; line breaks stay."""
    table = np.zeros(0x110000, dtype=np.uint8)
    for c in range(0x20, 0x3000):
        base = plain(LIKE.get(chr(c), chr(c)).lower())
        if base[:1].isascii() and base[:1].isalpha():
            table[c] = ord(base[0])
    for c in range(0xFF21, 0xFF5B):
        low = chr(c - 0xFEE0).lower()
        table[c] = ord(low) if low.isalpha() else 0
    for digit, letter in zip("013457", "oieast", strict=True):
        table[ord(digit)] = table[ord(digit) + 0xFEE0] = ord(letter)
    table[ord("\n")] = ord("\n")
    return table


class Sieve:
    """Finds the texts that the grammar may give any weight: those with a hostile or sexual phrase.

    The first transducer in its coarsest form: all accents, spaces, separators and repetitions are dropped, digits
    are letters. Short phrases are looked for as whole words; masked letters always count. It lets through more than the
    grammar accepts and nothing less.
    """

    def __init__(self, grammar: Grammar):
        self.auto = ahocorasick.Automaton()
        short = []
        for words, name, _ in grammar.phrases:
            if name not in (*_HOSTILE, "sexual"):
                continue
            longest = max("".join(words).split("*"), key=len) if "*" in words else "".join(words)
            key = _once(plain(longest))
            if len(key) >= LONG:
                self.auto.add_word(key, key)
            else:
                short.append(" ".join(words))
        self.auto.make_automaton()
        gap = r"[\s._~=|+\-\x{ad}\x{200b}-\x{200f}\x{2060}\x{feff}]*"
        self.short = r"(?i)(?:^|[^\p{L}])(?:" + "|".join(gap.join(re2(c) for c in w.replace(" ", "")) for w in short) + r")(?:[^\p{L}]|$)"

    def passes(self, texts: pa.Array) -> np.ndarray:
        """Which texts need the grammar."""
        words = ["" if t is None else t for t in texts.to_pylist()]
        for i in np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, SIEVE), False).to_numpy(zero_copy_only=False)).tolist():
            words[i] = unify(words[i])
        out = pc.match_substring_regex(pa.array(words, pa.string()), f"{MASKED}|{self.short}").to_numpy(zero_copy_only=False).copy()
        for k in range(0, len(words), 500):
            part = words[k : k + 500]
            raw = np.frombuffer("\n".join(t.replace("\n", " ") for t in part).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            f = _letters()[raw]
            f = f[f > 0]
            keep = np.ones(len(f), dtype=bool)
            keep[1:] = (f[1:] != f[:-1]) | (f[1:] == 10)
            f = f[keep]
            ends = np.flatnonzero(f == 10)
            for at, _ in self.auto.iter(f.tobytes().decode("latin-1")):
                out[k + int(np.searchsorted(ends, at))] = True
        return out


def re2(c: str) -> str:
    """A letter or one of the signs that stand for it."""
    other = {"o": "0", "i": "1", "e": "3", "a": "4", "s": "5", "t": "7"}.get(plain(c), "")
    some = "".join(sorted({c, plain(c)})) + other
    return f"[{some}]+"


@lru_cache(1)
def default_sieve() -> Sieve:
    return Sieve(default_grammar())


def score_all(texts: pa.Array, grammar: Grammar, sieve: Sieve) -> list[float]:
    """Scores of texts. The sieve is used twice, on the texts and on the clauses of those that pass."""
    out = [0.0] * len(texts)
    some = np.flatnonzero(sieve.passes(texts))
    parts, owner = [], []
    for i, t in zip(some.tolist(), texts.take(pa.array(some)).to_pylist(), strict=True):
        got = clauses(t)
        parts += got
        owner += [i] * len(got)
    done: dict[str, float] = {}
    for k in np.flatnonzero(sieve.passes(pa.array(parts, pa.string()))).tolist() if parts else []:
        c = parts[k]
        if c not in done:
            done[c] = grammar.clause(_fold_case(c))
        out[owner[k]] = max(out[owner[k]], done[c])
    return out


def scored(docs: DataFrame, text: str = "text", grammar: Grammar | None = None) -> DataFrame:
    """``docs`` with ``abuse_score``; a document is abusive from THRESHOLD on."""

    @F.pandas_udf("double")
    def weigh(texts: pd.Series) -> pd.Series:
        g = grammar or default_grammar()
        sieve = default_sieve() if grammar is None else Sieve(grammar)
        return pd.Series(score_all(pa.array(texts, pa.string(), from_pandas=True), g, sieve), dtype="float64")

    return docs.withColumn("abuse_score", weigh(F.col(text)))


def abusive(docs: DataFrame) -> DataFrame:
    """``doc_id`` of abusive documents."""
    return scored(docs.select("doc_id", "text")).where(F.col("abuse_score") >= THRESHOLD).select("doc_id")


def rates(docs: DataFrame) -> DataFrame:
    """Documents, abusive documents and their share per source."""
    hit = (F.col("abuse_score") >= THRESHOLD).cast("int")
    got = scored(docs.select("source", "text")).groupBy("source").agg(F.count("*").alias("documents"), F.sum(hit).alias("abusive"))
    return got.withColumn("rate", F.round(F.col("abusive") / F.col("documents"), 6))
