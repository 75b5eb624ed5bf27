"""Mixing sources to target weights (operator 8).

Tokens are summed per source; weights give each source a target, which stops at
``MOST`` times the source's size while the excess is shared again by weight.  The
quotient of target and size is the source's repetition rate: each document is
emitted floor(rate) times, plus one copy if its hash-seeded Bernoulli draw falls
under the fraction.  Of ``SEEDS`` seeds each source takes the one whose draws come
nearest its target, so also a source with few, uneven documents is near it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import Scratch, number_of, numbered, picked, with_place

WEIGHTS = (5, 2, 1)
MOST, SEEDS = 3, 32


def word_count(text: Column) -> Column:
    """The number of ``[^\\x20\\x09-\\x0D]+`` in a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(seed: int, key: Column) -> Column:
    """A uniform number of [0, 1) that the seed and the key alone decide."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 53)) / F.lit(float(1 << 53))


def source_targets(totals: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``totals (source, source_size)`` with each source's target.

    Sources in order of code points, null last, take the weights in turn.  Each
    round raises the level, the target of a unit of weight, until no source that
    isn't stopped lies above its most; a round is one sum over the sources.
    """
    ranked = with_place(totals, scratch, [F.col("source").asc_nulls_last()], "rank")
    ranked = scratch.table(ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))))
    level, stopped = 0.0, -1
    while True:
        full = F.col("source_size") * most <= F.col("weight") * level
        row = ranked.agg(F.sum("source_size").alias("all"), F.coalesce(F.sum(F.when(full, F.col("source_size") * most)), F.lit(0)).alias("fixed"), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("weights"), F.count_if(full).alias("n")).first()
        if row["n"] == stopped or not row["weights"]:
            break
        level, stopped = (row["all"] - row["fixed"]) / row["weights"], row["n"]
    return ranked.select("source", "source_size", F.least((F.col("source_size") * most).cast("double"), F.col("weight") * level).alias("target"))


def mixing_plan(sized: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """For each source of ``sized (doc_id, source, size)``: source_size, target, times (whole copies), part, seed."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rates = source_targets(totals, scratch, weights, most).withColumn("times", F.floor(rate)).withColumn("part", rate - F.col("times"))
    rates = scratch.table(rates)
    drawn = sized.join(rates, sized["source"].eqNullSafe(rates["source"])).select(rates["source"], "source_size", "target", "times", "part", "doc_id", "size")
    miss = [F.struct(F.abs(F.sum(F.when(draw(k, F.col("doc_id")) < F.col("part"), F.col("size")).otherwise(0)) - (F.col("target") - F.col("times") * F.col("source_size"))).alias("miss"), F.lit(k).alias("seed")) for k in range(SEEDS)]
    best = drawn.groupBy("source", "source_size", "target", "times", "part").agg(F.least(*miss)["seed"].alias("seed"))
    return scratch.table(best)


def _copies() -> Column:
    return (F.col("times") + F.when(draw(F.col("seed"), F.col("doc_id")) < F.col("part"), 1).otherwise(0)).cast("long")


def mix_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, source_size, target, taken, copies.

    A null or wordless text has size 0; a null source is a source of its own, the
    last; rows with equal or null doc_ids share their draw.  Where all sizes are 0,
    targets are 0.  Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    own = picked(docs, doc_id=(doc_id, "long"), source=(source, "string"), text=(text, "string"))
    sized = scratch.table(own.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    plan = mixing_plan(sized, scratch)
    out = sized.join(plan, sized["source"].eqNullSafe(plan["source"])).withColumn("copies", _copies())
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs``, with all their columns, whatever their names, each as many times as its source's rate says.

    Nulls, repeated rows and empty tables go as in ``mix_report``.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    key, said, words = (F.col(number_of(docs, c)) for c in (doc_id, source, text))
    plain, key, said = numbered(docs), key.cast("long"), said.cast("string")
    plan = mixing_plan(scratch.table(plain.select(key.alias("doc_id"), said.alias("source"), word_count(words.cast("string")).alias("size"))), scratch)
    copies = F.col("times") + F.when(draw(F.col("seed"), key) < F.col("part"), 1).otherwise(0)
    out = plain.join(plan.select("source", "times", "part", "seed"), said.eqNullSafe(F.col("source")))
    out = out.withColumn("copy", F.explode(F.array_repeat(F.lit(1), copies.cast("int"))))
    return out.select(*plain.columns).toDF(*docs.columns)
