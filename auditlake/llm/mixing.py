"""Operator 1: mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in shuffled order, passed several times where its target
exceeds its size. A document's virtual finish time is the source's words up to and with it,
divided by the source's target. The mix takes documents in the order of these times until the
total budget is spent, so all queues advance at their weights.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import running_sum, stored, word_count


def targets(sizes: DataFrame, weights: Sequence[int], budget_percent: int, repeats: int) -> DataFrame:
    """source, source_size, target from one row per source.

    Sources in code point order, null last, get ``weights`` in turn. Targets share
    ``budget_percent`` of all words by weight; none exceeds ``repeats`` times its source, and
    the excess goes to the others by weight until none is above."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(1))
    by_need = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    upto = by_need.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    weight = F.element_at(F.array(*[F.lit(w).cast("bigint") for w in weights]),
                          ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", weight)
    # sources that fill up first come first; level: what a unit of weight gets if this one is not full
    s = s.select("*", F.sum("source_size").over(every).alias("all"), F.sum("weight").over(every).alias("weights"),
                 (F.sum("source_size").over(upto) - F.col("source_size")).alias("full"),
                 (F.sum("weight").over(upto) - F.col("weight")).alias("full_weight"))
    level = ((F.col("all") * budget_percent / 100 - F.col("full") * repeats)
             / (F.col("weights") - F.col("full_weight")))
    s = s.withColumn("level", level)
    open_ = F.col("weight") * F.col("level") < F.col("source_size") * repeats
    s = s.withColumn("final", F.min(F.when(open_, F.struct("full_weight", "level"))).over(every))
    cap = F.col("source_size").cast("double") * repeats
    return s.select("source", "source_size", F.when(
        F.col("final").isNull() | (F.col("full_weight") < F.col("final.full_weight")), cap).otherwise(
        F.least(cap, F.col("weight") * F.col("final.level"))).alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), budget_percent: int = 150, repeats: int = 2,
        seed: str = "mix", id: str = "doc_id", text: str = "text", source: str = "source", row: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, size (words, null text: 0), source_size,
    target (its source's) and copies (how often the mix takes it, 0 to ``repeats``).

    Null sources form one source. Documents without words are never taken. Rows with the same id
    and size may swap places, unless ``row`` names a column that tells them apart; it is returned
    as ``row``. An empty table gives an empty mix. Other columns are not read."""
    named = [docs[row].alias("row")] if row else []
    keys = ["turn", "doc_id", "size", *(["row"] if row else [])]
    slim = docs.select(docs[id].alias("doc_id"), docs[source].alias("source"), word_count(docs[text]).alias("size"), *named)
    shuffled = slim.withColumn("turn", F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    queued = stored(running_sum(shuffled, ["source"], keys, "size", "upto"))
    plan = targets(queued.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget_percent, repeats)
    plan = stored(plan)
    timed = queued.join(plan.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    passes = timed.where("size > 0").select(*keys, F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(repeats - 1)),
        lambda k: (k.cast("bigint") * F.col("source_size") + F.col("upto")) / F.col("target"))).alias("finish"))
    spent = running_sum(passes, [], ["finish", *keys], "size", "spent")
    budget = plan.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * budget_percent / 100
    last = spent.where(F.col("spent") <= budget).agg(F.max(F.struct("finish", *keys)).alias("z")).first()["z"]
    copies = F.lit(0)
    if last is not None:
        kinds = dict(slim.dtypes) | {"finish": "double", "turn": "string"}
        edge = F.struct(*[F.lit(last[k]).cast(kinds[k]).alias(k) for k in ["finish", *keys]])
        for k in range(repeats):
            finish = (F.lit(k).cast("bigint") * F.col("source_size") + F.col("upto")) / F.col("target")
            mine = F.struct(finish.alias("finish"), *keys)
            copies = copies + F.when((F.col("size") > 0) & (mine <= edge), 1).otherwise(0)
    return timed.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), *(["row"] if row else []))
