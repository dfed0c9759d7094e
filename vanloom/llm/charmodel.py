"""Smoothed character trigram model of fixed size, counted over all clean text.

Counts live in hashed tables whose size does not depend on the data (SIZES), so the model may be
collected and broadcast whatever the corpus: at most sum(SIZES) numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets for single characters, pairs and triples.
SIZES = (1 << 16, 1 << 17, 1 << 18)
WEIGHTS = (0.02, 0.18, 0.8)
#: Characters counted at a time; bounds the memory of a task.
CHUNK = 1 << 20
_M1, _M2, _M3 = np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def buckets(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table positions of each character, of each pair, of each triple."""
    c1, c2 = c * _M1, c * _M2
    return c1 >> np.uint32(16), (c2[:-1] + c1[1:]) >> np.uint32(15), (c[:-2] * _M3 + c2[1:-1] + c1[2:]) >> np.uint32(14)


class Counts:
    """Running counts of one task."""

    def __init__(self):
        self.total = [np.zeros(n, dtype=np.int64) for n in SIZES]
        self.wait: list[str] = []
        self.chars = 0

    def add(self, texts: list[str]) -> None:
        for t in texts:
            self.wait.append(t)
            self.chars += len(t)
            if self.chars > CHUNK:
                self.flush()

    def flush(self) -> None:
        joined = "\n".join(self.wait)
        self.wait, self.chars = [], 0
        for k in range(0, max(0, len(joined) - 2), CHUNK):
            for t, at in zip(self.total, buckets(codes(joined[k : k + CHUNK + 2])), strict=True):
                t += np.bincount(at, minlength=len(t))

    def rows(self) -> tuple[pa.Array, pa.Array]:
        """Non-zero buckets, numbered through all tables, and their counts."""
        self.flush()
        flat = np.concatenate(self.total)
        at = np.flatnonzero(flat)
        return pa.array(at, pa.int32()), pa.array(flat[at])


def gathered(counts: DataFrame) -> "CharModel":
    """The model of all tasks' ``bucket, n`` rows; combined on the map side, sum(SIZES) rows at most."""
    got = counts.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    flat = np.zeros(sum(SIZES), dtype=np.float64)
    flat[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return CharModel(np.split(flat, np.cumsum(SIZES)[:-1]))


class CharModel:
    """Interpolated trigram probabilities; unseen characters get a small share."""

    def __init__(self, counts: list[np.ndarray]):
        self.one, self.two, self.three = (np.asarray(c, dtype=np.float32) for c in counts)
        self.n = float(max(1.0, counts[0].sum()))
        self._terms: tuple[np.ndarray, ...] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_terms": None}

    def logp(self, text: str) -> np.ndarray:
        """Log probability of each character from the third on."""
        if len(text) < 3:
            return np.zeros(0)
        if self._terms is None:
            self._terms = WEIGHTS[2] * self.three, self.two + 1.0, WEIGHTS[1] * self.two, self.one + 1.0, WEIGHTS[0] * (self.one + 0.01) / self.n
        three, pairs, two, singles, one = self._terms
        a, b, c = buckets(codes(text))
        p = three.take(c)
        p /= pairs.take(b[:-1])
        q = two.take(b[1:])
        q /= singles.take(a[1:-1])
        p += q
        p += one.take(a[2:])
        p += 1e-12
        return np.log(p, out=p)

    def mean(self, text: str) -> float:
        got = self.logp(text)
        return float(np.add.reduce(got) / got.size) if got.size else -12.0
