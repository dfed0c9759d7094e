"""Problem 8: filling fixed-capacity containers with whole documents.

Minimum bin slack. For each bin the longest remaining item is set, then a bitset subset-sum program over the
available lengths finds the fullest feasible combination, which is taken out; a combination is used again
as long as its lengths last. Documents are dealt by hash into pools of bounded size, which are packed
independently, so that no task grows with the corpus; a pool has hundreds of bins, of which only the last is
not full. Items longer than the capacity are cut into full pieces and a rest, nothing else is cut.

Documents without tokens take no room and get bin null. Repeated ids are separate items.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vanloom.llm.tokens import VOCABULARY, n_tokens
from vanloom.session import cut

#: A pool holds about this many tokens, and at least POOL_BINS bins of its container.
POOL_TOKENS = 4_000_000
POOL_BINS = 256


def fullest(lengths: list[int], counts: list[int], room: int) -> list[tuple[int, int]]:
    """The (index, how many) of a fullest combination within ``room``; ``lengths`` descend.

    A bit of ``reach`` is a sum that can be made; the sums before each step are kept to trace the best one back.
    """
    if room <= 0:
        return []
    full = (1 << (room + 1)) - 1
    reach, trail = 1, []
    for i, (size, n) in enumerate(zip(lengths, counts, strict=True)):
        if not n or size > room:
            continue
        left, part = min(n, room // size), 1
        while left:
            take = min(part, left)
            trail.append((i, take, reach))
            reach |= (reach << (take * size)) & full
            left -= take
            part *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    used: dict[int, int] = {}
    for i, take, before in reversed(trail):
        if not before >> total & 1:
            total -= take * lengths[i]
            used[i] = used.get(i, 0) + take
    return sorted(used.items())


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of each item; every item is at least 1 and at most ``capacity``."""
    order = np.argsort(-sizes, kind="stable")
    values, first, counts = np.unique(-sizes[order], return_index=True, return_counts=True)
    lengths, left = (-values).tolist(), counts.tolist()
    nexts = first.tolist()
    out = np.full(len(sizes), -1, dtype=np.int64)
    bin_no, head = 0, 0
    while head < len(lengths):
        if not left[head]:
            head += 1
            continue
        left[head] -= 1
        combo = dict(fullest(lengths, left, capacity - lengths[head]))
        left[head] += 1
        combo[head] = combo.get(head, 0) + 1
        for _ in range(min(left[i] // n for i, n in combo.items())):
            for i, n in combo.items():
                out[order[nexts[i] : nexts[i] + n]] = bin_no
                nexts[i] += n
                left[i] -= n
            bin_no += 1
    return out


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_tokens``; written once."""
    return cut(docs.select(F.col(key).alias("doc_id"), n_tokens(F.col(text), vocabulary).alias("n_tokens")))


def fill(docs: DataFrame, containers: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``container_name, pool, bin, doc_id, token_start, token_end``: one row per document and piece.

    ``containers`` (container_name, capacity_tokens) is a small table of settings; rows without a positive capacity are ignored.
    """
    sizes = sized(docs, key, text, vocabulary)
    total = sizes.agg(F.sum("n_tokens")).first()[0] or 0
    out = None
    for c in containers.where("capacity_tokens > 0").orderBy("container_name").collect():
        cap = int(c.capacity_tokens)
        pools = max(1, round(total / max(POOL_TOKENS, POOL_BINS * cap)))
        rest = F.col("n_tokens") % cap
        cuts = F.when(F.col("n_tokens") > cap, F.expr(f"transform(sequence(0, cast(ceil(n_tokens / {cap}) as int) - 1), k -> struct(k * {cap} as token_start, least((k + 1) * {cap}, n_tokens) as token_end))"))
        cuts = F.coalesce(cuts, F.array(F.struct(F.lit(0).alias("token_start"), F.col("n_tokens").alias("token_end"))))
        items = sizes.withColumn("pool", F.pmod(F.xxhash64("doc_id", F.lit(cap)), F.lit(pools)).cast("int")).select("doc_id", "pool", F.explode(cuts).alias("p")).select("doc_id", "pool", "p.*")
        size = F.col("token_end") - F.col("token_start")
        # Full pieces and empty documents need no packing.
        alone = items.where((size == cap) | (size == 0)).select("pool", F.when(size == cap, F.concat_ws("-", F.lit("full"), F.col("doc_id").cast("string"), F.col("token_start").cast("string"))).alias("bin"), "doc_id", "token_start", "token_end")
        types = dict(items.dtypes)
        shared = items.where((size > 0) & (size < cap)).groupBy("pool").applyInPandas(_packer(cap), f"pool int, bin string, doc_id {types['doc_id']}, token_start int, token_end int")
        part = alone.unionByName(shared).select(F.lit(c.container_name).alias("container_name"), F.lit(cap).alias("capacity_tokens"), "*")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = sizes.limit(0).select(F.lit("").alias("container_name"), F.lit(0).alias("capacity_tokens"), F.lit(0).alias("pool"), F.lit("").alias("bin"), "doc_id", F.lit(0).alias("token_start"), F.lit(0).alias("token_end"))
    return out


def _packer(cap: int):
    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["doc_id", "token_start"], kind="stable")
        g["bin"] = pack((g.token_end - g.token_start).to_numpy(), cap).astype(str)
        return g[["pool", "bin", "doc_id", "token_start", "token_end"]]

    return one


def fill_report(filled: DataFrame) -> DataFrame:
    """Bins, documents, tokens and the share of room left over, per container."""
    bins = filled.where("bin is not null").groupBy("container_name", "capacity_tokens", "pool", "bin").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("used"), F.count("*").alias("items"))
    return bins.groupBy("container_name", "capacity_tokens").agg(F.count("*").alias("bins"), F.sum("items").alias("items"), F.sum("used").alias("tokens"), F.max("used").alias("fullest_bin"), F.round(1 - F.sum("used") / (F.count("*") * F.first("capacity_tokens")), 6).alias("unused_share"))
