"""Problem 9: mixing sources to target weights.

A source's documents are wanted a fractional number of times each: tokens wanted / tokens available. The whole
part is given to all; the fractional parts are made integral by pivotal dependent rounding: two fractional
documents exchange token mass at random until one of them is integral, which keeps every document's
expectation and the source's token total. Documents are rounded within shards of bounded size; each shard leaves one
fractional document at most, and these residuals are combined through a reduction tree of
fan-in FANOUT until one is left per source, which is decided by chance.

Null sources belong to no mix. Documents without tokens are never drawn. A source that has no documents gets no share and is reported so.
"""

from __future__ import annotations

import math
import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vanloom.llm.tokens import VOCABULARY, n_tokens
from vanloom.session import cut

SHARD_DOCS = 20_000
FANOUT = 64


def pivotal(p: list[float], size: list[int], rng: random.Random) -> tuple[list[int], int | None, float]:
    """Rounds probabilities, moving token mass between two items at a time.

    Returns the decisions, the index of the item left fractional (or None) and its probability.
    """
    out = [0] * len(p)
    open_, q = None, 0.0
    for i, x in enumerate(p):
        if x <= 1e-12 or x >= 1 - 1e-12:
            out[i] = round(x)
            continue
        if open_ is None:
            open_, q = i, x
            continue
        a, b = size[open_], size[i]
        # Mass m moves from i to the open item, or from the open item to i, as far as one of them allows.
        up, down = min((1 - q) * a, x * b), min(q * a, (1 - x) * b)
        if rng.random() * (up + down) < down:
            q, x = q + up / a, x - up / b
        else:
            q, x = q - down / a, x + down / b
        if q <= 1e-12 or q >= 1 - 1e-12:
            out[open_] = round(q)
            open_, q = i, x
            if x <= 1e-12 or x >= 1 - 1e-12:
                out[i], open_, q = round(x), None, 0.0
        else:
            out[i] = round(x)
    return out, open_, q


def plan(docs: DataFrame, targets: DataFrame, size: float | None = None) -> DataFrame:
    """``mix_name, source, target_weight, max_repeats, available, documents, copies``: expected copies per document.

    ``docs``: source, n_tokens. Without ``size`` a mix is as large as its scarcest source allows.
    """
    # Of the sources only those that a target names are counted, so what is broadcast is no larger than the targets.
    named = targets.select("source").distinct()
    have = docs.where("n_tokens > 0").join(F.broadcast(named), "source", "left_semi").groupBy("source").agg(F.sum("n_tokens").alias("available"), F.count("*").alias("documents"))
    goal = targets.join(F.broadcast(have), "source", "left").withColumn("available", F.coalesce("available", F.lit(0))).withColumn("documents", F.coalesce("documents", F.lit(0)))
    able = F.when((F.col("available") > 0) & (F.col("target_weight") > 0), F.col("available") * F.col("max_repeats") / F.col("target_weight"))
    limit = goal.groupBy("mix_name").agg(F.min(able).alias("limit"))
    goal = goal.join(F.broadcast(limit), "mix_name").withColumn("size", F.least("limit", F.lit(size)) if size else F.col("limit"))
    return goal.withColumn("copies", F.when(F.col("available") > 0, F.least(F.col("max_repeats").cast("double"), F.col("size") * F.col("target_weight") / F.col("available"))).otherwise(0.0)).drop("limit")


def mix(docs: DataFrame, targets: DataFrame, size: float | None = None, seed: int = 42, vocabulary: str = VOCABULARY) -> DataFrame:
    """``mix_name, source, doc_id, n_tokens, copies`` with copies > 0."""
    # Tokens are counted in place: a row is a document, also where ids repeat.
    rows = cut(docs.where(F.col("source").isNotNull()).select("doc_id", "source", n_tokens(F.col("text"), vocabulary).alias("n_tokens"))).where("n_tokens > 0")
    goal = cut(plan(rows, targets, size).where("copies > 0").select("mix_name", "source", "copies", F.greatest(F.lit(1), F.ceil(F.col("documents") / SHARD_DOCS)).alias("shards")))
    want = rows.join(F.broadcast(goal), "source").withColumn("whole", F.floor("copies").cast("int")).withColumn("part", F.col("copies") - F.floor("copies"))
    want = want.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed)), "shards").cast("int"))
    kind = dict(rows.dtypes)["doc_id"]
    schema = f"mix_name string, source string, doc_id {kind}, n_tokens int, whole int, part double, shard int"

    def round_up(level: int):
        def one(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values(["doc_id", "n_tokens"], kind="stable").reset_index(drop=True)
            done, open_, q = pivotal(g.part.tolist(), g.n_tokens.tolist(), random.Random(f"{seed}:{level}:{key}"))
            g["part"] = pd.Series(done, dtype="float64")
            if open_ is not None:
                g.loc[open_, "part"] = q
            return g

        return one

    now = want.select("mix_name", "source", "doc_id", "n_tokens", "whole", "part", "shard")
    shards = int(goal.agg(F.max("shards")).first()[0] or 1)
    levels = 1 + (math.ceil(math.log(shards, FANOUT)) if shards > 1 else 0)
    done = None
    for level in range(levels):
        now = cut(now.groupBy("mix_name", "source", "shard").applyInPandas(round_up(level), schema))
        settled = now.where("part in (0.0, 1.0)")
        done = settled if done is None else done.unionByName(settled)
        now = now.where("part not in (0.0, 1.0)").withColumn("shard", F.floor(F.col("shard") / FANOUT).cast("int"))
    last = now.withColumn("part", F.when(F.pmod(F.xxhash64("mix_name", "source", F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20)) < F.col("part"), 1.0).otherwise(0.0))
    copies = (F.col("whole") + F.col("part")).cast("int")
    return done.unionByName(last).select("mix_name", "source", "doc_id", "n_tokens", copies.alias("copies")).where("copies > 0")


def mix_report(docs: DataFrame, targets: DataFrame, mixed: DataFrame) -> DataFrame:
    """Target and actual share of each source, documents used and the largest number of copies."""
    used = mixed.groupBy("mix_name", "source").agg(F.count("*").alias("documents_used"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    total = used.groupBy("mix_name").agg(F.sum("tokens").alias("all_tokens"))
    out = targets.select("mix_name", "source", "target_weight", "max_repeats").join(used, ["mix_name", "source"], "left").join(total, "mix_name", "left")
    zero = {c: 0 for c in ("documents_used", "tokens", "most_copies", "all_tokens")}
    return out.na.fill(zero).withColumn("actual_share", F.round(F.when(F.col("all_tokens") > 0, F.col("tokens") / F.col("all_tokens")).otherwise(0.0), 6)).drop("all_tokens")
