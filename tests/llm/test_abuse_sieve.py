"""Problem 10: the sieve lets through whatever the grammar gives weight."""

import random

import pyarrow as pa
import pytest

from vanloom.llm import abuse


@pytest.mark.parametrize("text", ["cặc lồn nứng", "show hàng cho xem nứng", "chịch rồi lại chịch", "vú", "NỨNG", "xem clip"])
def test_p10_short_and_repeated_sexual_phrases(text):
    g = abuse.default_grammar()
    assert g.score(text) > 0 and abuse.score_all(pa.array([text]), g, abuse.default_sieve()) == [g.score(text)]


def test_p10_sieve_equals_grammar_on_random_phrases():
    g, rng = abuse.default_grammar(), random.Random(2)
    phrases = [" ".join(w).replace("*", "người") for w, _, _ in g.phrases]
    other = "hôm nay trời đẹp cả nhà đi chơi ở công viên".split()
    forms = (str, str.upper, abuse.plain, lambda p: p.replace("o", "0").replace("i", "1"), lambda p: ".".join(p), lambda p: p[:-1] + p[-1] * 3)
    texts = []
    for k in range(3000):
        parts = [rng.choice(forms)(p) if k % 2 else p for p in rng.choices(phrases, k=rng.randrange(1, 4))] + rng.sample(other, 3)
        rng.shuffle(parts)
        texts.append(" ".join(parts))
    want = [g.score(t) for t in texts]
    got = abuse.score_all(pa.array(texts), g, abuse.default_sieve())
    assert [(t, a, b) for t, a, b in zip(texts, got, want, strict=True) if a != b] == []
