"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in hashed order, passed through up to
``max_repeats`` times. A document's virtual finish time is the words its source
has sent by then, over the source's target. All documents of all sources stand
in the order of that time, and the mix is the longest head of it whose words
stay within the budget. So at any point every source has sent the same share of
its target, but for a part of one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_words, running_sums, saved

#: Weights of the sources in code point order, null last, over and over. Fixed values of the data contract.
WEIGHTS = (5, 2, 1)
SHARE, REPEATS = 1.5, 2


def fair_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> tuple[DataFrame, int]:
    """``source, source_size, target``, the words to take from each source, and the budget.

    sizes: ``source, size``. Words go by weight, none over ``repeats`` times its
    size; what a full source cannot take is shared by weight among the others:
    in the order of size over weight, sources are full until one is not at the
    level that the full ones leave. Sources may be very many (hosts, say); the
    driver gets sums only.
    """
    ranked = running_sums(sizes.withColumn("no_source", F.col("source").isNull()), ["no_source", "source"], "size")
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    weighed = saved(ranked.select("no_source", "source", "size", F.element_at(cycle, (F.col("_index") % len(weights) + 1).cast("int")).alias("weight")))
    total = weighed.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    budget, full = share * (total["size"] or 0), F.col("size") * repeats
    ratio = full.cast("double") / F.col("weight")
    ahead = running_sums(weighed.withColumn("full", full).withColumn("ratio", ratio), ["ratio", "no_source", "source"], ["full", "weight"])
    level = (F.lit(budget) - F.col("_before_full")) / (F.lit(total["weight"]) - F.col("_before_weight"))
    first = ahead.filter(F.col("ratio") >= level).agg(F.min_by(level, "_index")).first()[0]
    target = F.least(full.cast("double"), F.col("weight") * F.lit(float("inf") if first is None else first))
    return saved(weighed.select("source", F.col("size").alias("source_size"), target.alias("target"))), int(budget)


def _queued(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    """Adds nothing but the operator's own columns; the queue's order is (key, tie)."""
    return docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        n_words(F.col(f"`{text_col}`")).alias("size"),
        *_order(id_col, text_col, seed),
    )


def _order(id_col: str, text_col: str, seed: str) -> list[F.Column]:
    key = F.md5(F.concat(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")), F.lit(":" + seed)))
    return [key.alias("key"), F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("tie")]


def mix_table(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """Returns ``id_col, source, size, source_size, target, taken``, a row for each document.

    Null text has size 0 and nothing is taken of it; null sources are one
    source, the last; rows of equal id and text stand together in the queue and
    count one by one; an empty table gives no rows; ids may be of any type. Only
    ids, sources and sizes are sorted.
    """
    queue = saved(_queued(docs, id_col, text_col, source_col, seed))
    mixed = _taken(queue, weights, share, repeats)
    return mixed.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", F.col("taken").cast("long"))


def _finish(epoch: int) -> F.Column:
    return (F.col("source_size") * epoch + F.col("sent")) / F.when(F.col("target") > 0, F.col("target"))


def _same(a: str, b: str) -> F.Column:
    return F.col(a).eqNullSafe(F.col(b))


def _taken(queue: DataFrame, weights, share: float, repeats: int) -> DataFrame:
    """The queue with ``source_size``, ``target`` and ``taken``."""
    targets, budget = fair_targets(queue.groupBy("source").agg(F.sum("size").alias("size")), weights, share, repeats)
    queue = queue.withColumn("no_source", F.col("source").isNull())
    sent = running_sums(queue, ["no_source", "source", "key", "tie"], "size", "source")
    sent = sent.withColumn("sent", F.col("_before") + F.col("size")).withColumnRenamed("_index", "place").drop("_before")
    # Both sides are tables: Spark broadcasts targets of a small size and splits hot sources otherwise.
    sent = saved(saved(sent).join(targets.withColumnRenamed("source", "source_"), _same("source", "source_")).drop("source_"))
    # A source that fills its target in one pass is not sent twice.
    times = F.array(*[F.struct(F.lit(e).alias("epoch"), _finish(e).alias("finish")) for e in range(repeats)])
    copies = sent.filter("size > 0").select("no_source", "source", "place", "size", F.explode(times).alias("t")).select("*", "t.*").drop("t").filter(F.col("finish").isNotNull())
    order = ["finish", "no_source", "source", "place", "epoch"]
    at = F.struct(F.col("finish"), F.col("no_source"), F.coalesce("source", F.lit("")).alias("source"), F.col("place"), F.col("epoch"))
    last = running_sums(copies, order, "size").filter(F.col("_before") + F.col("size") <= budget).agg(F.max(at).alias("at")).first()["at"]
    if last is None:
        return sent.withColumn("taken", F.lit(0))
    border = F.struct(F.lit(last.finish), F.lit(last.no_source), F.lit(last.source), F.lit(last.place).cast("long"), F.lit(last.epoch))
    taken = F.lit(0)
    for e in range(repeats):
        own = F.struct(_finish(e), F.col("no_source"), F.coalesce("source", F.lit("")), F.col("place"), F.lit(e))
        taken = taken + F.when((F.col("size") > 0) & F.col("target").isNotNull() & (F.col("target") > 0) & (own <= border), F.col("size")).otherwise(0)
    return sent.withColumn("taken", taken)


def mix_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """The documents of the mix themselves, all columns kept, repeats as rows of their own.

    A source's queue is taken from its head, so one border for each source and
    pass decides, and the table of borders is joined to the documents: while it
    is small, Spark broadcasts it and moves no text. Rows equal in id and text
    share a place at the border and go in together.
    """
    queue = saved(_queued(docs, id_col, text_col, source_col, seed))
    taken = _taken(queue, weights, share, repeats)
    borders = taken.filter("size > 0").groupBy("source").agg(*[F.max(F.when(F.col("taken") >= e * F.col("size"), F.struct("key", "tie"))).alias(f"border{e}") for e in range(1, repeats + 1)])
    borders = saved(borders.withColumnRenamed("source", "source_"))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{source_col}`").cast("string").alias("source_own"), n_words(F.col(f"`{text_col}`")).alias("size"), F.struct(*_order(id_col, text_col, seed)).alias("place"))
    held = own.join(borders, _same("source_own", "source_"))
    times = sum((F.when((F.col("size") > 0) & (F.col("place") <= F.col(f"border{e}")), 1).otherwise(0) for e in range(1, repeats + 1)), F.lit(0))
    return held.withColumn("times", times).select("row", F.explode(F.array_repeat(F.lit(0), F.col("times")))).select("row.*")
