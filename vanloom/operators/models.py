"""Learned models are plugged in: a predictor is a function over batches, loaded once per worker. Without one, the rules answer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vanloom.functions import spans as S
from vanloom.operators import entities as E
from vanloom.operators import events as V
from vanloom.operators import vocabulary

#: Longest input of the taggers, in pieces.
MAX_PIECES = 256


def predicted_entities(text: Column, load: Callable[[], Callable[[list[str]], list[list[dict]]]] | None = None) -> Column:
    """Entities by a plugged-in model, or by the rule recogniser.

    ``load`` is called once per worker and returns a function from sentences to lists of spans
    (dicts with start, end, text, label).
    """
    if load is None:
        return E.entities(text)

    @F.pandas_udf(E.SPAN)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = load()
        for b in batches:
            yield pd.Series(predict(b.fillna("").tolist()), index=b.index)

    return run(text)


def predicted_triggers(text: Column, entities: Column | None = None, source: str = "baseline", load=None) -> Column:
    """Triggers of a rule engine ("baseline", "service"), or with source "model" of a plugged-in tagger.

    ``load`` is as in ``predicted_entities``; the tagger's spans are numbered t0, t1, … in text order.
    """
    if source != "model":
        return V.triggers(text, entities, source)
    if load is None:
        raise ValueError("source model needs a tagger")
    spans = F.array_sort(predicted_entities(text, load))
    return F.transform(spans, lambda s, i: F.struct(F.concat(F.lit("t"), i.cast("string")).alias("id"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), s["label"].alias("label")))


def event_records(rows: DataFrame, triggers: str = "rules", arguments: str = "rules", entities: DataFrame | None = None, load_triggers=None, score=None) -> DataFrame:
    """Event records (ann_id, sentence, entities, triggers, relations) predicted for records.

    ``triggers``: "rules", "model" (``load_triggers``) or "gold" (those of the records). ``arguments``: "rules", "model" (``score``: a function
    from sentence, trigger and entity columns to an array of scores, NONE first) or "gold". ``entities`` (ann_id, entities), where given, replaces
    the records' entities; a record without a row there has none.
    """
    if entities is not None:
        kind = dict(rows.dtypes)["entities"]
        rows = rows.drop("entities").join(entities.select("ann_id", "entities"), "ann_id", "left").withColumn("entities", F.coalesce("entities", F.array().cast(kind)))
    t = F.col("sentence")
    if triggers != "gold":
        rows = rows.withColumn("triggers", predicted_triggers(t, F.col("entities"), "baseline" if triggers == "rules" else triggers, load_triggers))
    if arguments == "rules":
        return rows.withColumn("relations", V.link(t, F.col("triggers"), F.col("entities")))
    if arguments == "model":
        if score is None:
            raise ValueError("arguments model needs a scorer")
        roles = list(vocabulary.ROLE_LABELS)

        def of(trigger: Column) -> Column:
            free = F.filter(F.col("entities"), lambda e: ~S.overlaps(trigger, e))
            found = F.transform(free, lambda e: F.struct(trigger["id"].alias("trigger_id"), e["id"].alias("arg_id"), V.choose_role(score(t, trigger, e), e["label"], roles).alias("role")))
            return F.filter(found, lambda r: r["role"] != "NONE")

        return rows.withColumn("relations", F.flatten(F.transform("triggers", of)))
    return rows


def labelled(rows: DataFrame, load=None, text: str = "sentence") -> DataFrame:
    """The corpus labelling job: ``sentence, entities`` with TEXT|LABEL cells, NONE for none or a blank sentence, PREDICTION_ERROR
    where the tagger fails on the sentence. One sentence's failure does not touch the others."""

    @F.pandas_udf("string")
    def cells(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = load() if load else None
        for b in batches:
            out = []
            for sentence in b:
                if not sentence or not sentence.strip():
                    out.append("NONE")
                    continue
                try:
                    found = predict([sentence.strip()])[0] if predict else E.recognised(sentence.strip())
                    out.append("; ".join(f"{e['text']}|{e['label']}" for e in found) or "NONE")
                except Exception:
                    out.append("PREDICTION_ERROR")
            yield pd.Series(out, index=b.index, dtype="object")

    return rows.select(F.coalesce(F.col(text), F.lit("")).alias("sentence"), cells(F.col(text)).alias("entities"))


def first_piece_labels(tokens: list[str], labels: list[str], pieces: Callable[[str], list[int]], truncate: bool, limit: int = MAX_PIECES) -> tuple[list[int], list[str | None]]:
    """Piece ids and labels: a token's label stands at its first piece, the others get none. Too long inputs are cut or refused."""
    ids: list[int] = []
    out: list[str | None] = []
    for tok, lab in zip(tokens, labels, strict=True):
        some = pieces(tok)
        ids += some
        out += [lab] + [None] * (len(some) - 1)
    if len(ids) > limit:
        if not truncate:
            raise ValueError(f"{len(ids)} pieces exceed {limit}")
        ids, out = ids[:limit], out[:limit]
    return ids, out


def over_length(tokens: Column, limit: int = MAX_PIECES) -> Column:
    """Predicate for inputs that the tagger cannot take, by tokens."""
    return F.size(tokens) > limit


def pipeline(rows: DataFrame, text: str = "sentence", load=None, source: str = "rules") -> DataFrame:
    """Adds status, entities, triggers and events to sentences. Status: EMPTY for blank texts, NO_MODEL where a model was asked for and none is there, else OK."""
    blank = F.trim(F.coalesce(F.col(text), F.lit(""))) == ""
    status = F.when(blank, "EMPTY").when(F.lit(source == "model" and load is None), "NO_MODEL").otherwise("OK")
    out = rows.withColumn("status", status).withColumn("entities", predicted_entities(F.when(~blank, F.col(text)), load))
    out = out.withColumn("triggers", V.triggers(F.col(text), None, "service"))
    return out.withColumn("events", V.service_events(F.col(text), F.col("triggers"), F.col("entities")))
