"""Mixing sources to target weights (operator 9): hash-threshold histograms, JVM expressions only.

A document's size is its number of words. Sources in code point order, null last, weigh
``weights`` in turn and share the whole corpus; a source may take at most ``max_repeats`` times
its size, and what it can't take goes to the others by weight. Within a source every
document is taken ``floor(target / size)`` times, and those under a hash threshold once
more: sizes are summed by source and hash bucket, the running sums tell which buckets fit the remaining budget, and
only the bucket at the edge is opened again, at the next bits of the hash, down to single
hash values. Nothing is sorted but the buckets. Hashes depend on the id alone, so reruns agree and a
larger budget only adds documents (thresholds nest).

Documents with one id share a hash and are taken or left together. Null ids hash as the empty
text. Null and empty texts have size 0 and are taken as often as others, adding nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.tables import stage

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BITS, LEVELS = 12, 5


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _hash(id_col: str) -> Column:
    """60 bits of the id's md5."""
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    A source is full when its limit per weight is below the level at which limits of the
    full ones and weight times level of the others add up to the whole.
    """
    # A window over all sources: one row each, however many documents there are.
    numbered = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(numbered) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(max_repeats)))
    by_limit = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    below = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("full_before", F.coalesce(F.sum("most").over(below), F.lit(0.0)))
    rows = rows.withColumn("weight_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(below), F.lit(0.0)))
    rows = rows.withColumn("total", F.sum(F.col("source_size").cast("double")).over(every))
    # The level if all sources before this one are full and no other.
    rows = rows.withColumn("level_here", (F.col("total") - F.col("full_before")) / F.col("weight_left"))
    open_here = F.col("most") / F.col("weight") > F.col("level_here")
    rows = rows.withColumn("rank", F.row_number().over(by_limit))
    rows = rows.withColumn("level", F.min(F.when(open_here, F.struct("rank", "level_here"))).over(every))
    target = F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("weight") * F.col("level.level_here")))
    return rows.select("source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``copies`` (how often a document is taken) and ``taken`` (its words, repeats counted) added."""
    names = docs.columns
    added = ("size", "source_size", "target", "taken", "copies")
    own = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    at = {c: f"c{names.index(c)}" for c in (id_col, text_col, source_col)}
    sized = own.withColumn("_size", n_words(F.col(at[text_col]).cast("string"))).withColumn("_hash", _hash(at[id_col]))
    narrow = stage(sized.select(F.col(at[source_col]).alias("source"), F.col("_size").alias("size"), F.col("_hash").alias("hash")), "mix-sizes")

    first = F.shiftright("hash", BITS * (LEVELS - 1))
    buckets = stage(narrow.groupBy("source", first.alias("bucket")).agg(F.sum("size").alias("size")), "mix-buckets")
    sizes = buckets.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, weights, max_repeats)
    plan = plan.withColumn("repeats", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    budget = F.col("target") - F.col("repeats") * F.col("source_size")
    # ``low``: hashes below it are taken once more. ``left``: what of the budget they leave over.
    edge = stage(plan.withColumn("left", budget).withColumn("low", F.lit(0).cast("long")), "mix-plan")
    rows = narrow
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        if level:
            here = F.col("hash").between(F.col("low"), F.col("low") + F.lit((1 << (shift + BITS)) - 1))
            edges = edge.select(F.col("source").alias("_s"), "low")
            rows = rows.join(edges, F.col("source").eqNullSafe(F.col("_s"))).where(here).select("source", "size", "hash")
            rows = stage(rows, "mix-edge")
            buckets = rows.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("size"))
        running = Window.partitionBy("source").orderBy("bucket")
        sums = buckets.withColumn("upto", F.sum("size").over(running)).withColumnRenamed("source", "_s")
        joined = sums.join(edge.select("source", "left"), F.col("_s").eqNullSafe(F.col("source")))
        over = F.col("upto") > F.col("left")
        found = joined.groupBy("_s").agg(
            F.min(F.when(over, F.struct("bucket", "size"))).alias("_at"),
            F.coalesce(F.max(F.when(~over, F.col("upto"))), F.lit(0)).alias("_used"),
        )
        edge = edge.join(found, F.col("source").eqNullSafe(F.col("_s")), "left")
        # No bucket over the budget: everything that is left fits.
        beyond = F.col("low") + F.lit(1 << (shift + BITS))
        left = F.col("left") - F.coalesce("_used", F.lit(0))
        low = F.shiftleft("_at.bucket", shift)
        if not shift:  # a single hash value: taken if that comes nearer to the budget
            low = low + F.when(F.col("_at.size") < 2 * left, 1).otherwise(0)
        edge = edge.select("source", "source_size", "target", "repeats", left.alias("left"), F.coalesce(low, beyond).alias("low"))
        edge = stage(edge, "mix-edge-plan")
    last = edge.select(F.col("source").alias("_s"), "source_size", "target", "repeats", "low")
    copies = F.col("repeats") + F.when(F.col("_hash") < F.col("low"), 1).otherwise(0)
    out = sized.join(last, F.col(at[source_col]).eqNullSafe(F.col("_s")))
    kept = [F.col(f"c{i}").alias(c) for i, c in enumerate(names) if c not in added]
    return out.select(*kept, F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * copies).alias("taken"), copies.alias("copies"))
