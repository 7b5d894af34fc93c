"""Mixing sources to target weights by Efraimidis-Spirakis sampling without replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_small, staged

#: Least buckets of the sampling key within a source, and documents for each beyond; prefix sums run over buckets, then
#: within the one at the boundary.
BUCKETS, PER_BUCKET = 1024, 20_000
WEIGHTS = (5.0, 2.0, 1.0)
#: Share of all sizes that the targets have together, and how often a source may be taken at most.
SHARE, MOST = 1.5, 2.0
SEED = 11


def words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text (null: none)."""
    plain = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.filter(F.split(plain, " "), lambda w: w != "")


def quality_weight(text: Column) -> Column:
    """Weight of a document, from 0.05 to 1: the share of its characters that are not symbols such as | # % & * $ !."""
    t = F.coalesce(text, F.lit(""))
    plain = F.length(F.translate(t, "|#%&*$!<>{}[]=_~^", ""))
    return F.greatest(F.lit(0.05), F.pow(plain / F.greatest(F.length(t), F.lit(1)), 4))


def uniform(*cols: Column, seed: int = SEED) -> Column:
    """A number in (0, 1) that depends on the columns alone, so reruns agree."""
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11)
    return (h.cast("double") + 0.5) / F.lit(float(1 << 53))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources by code point, null last, have the weights in turn. All targets make ``share`` times all sizes; none is
    above ``most`` times its source's size, the excess being reshared by weight. That is the water level L at which
    the sum of min(most * size, weight * L) is the total: sources in order of most * size / weight are full up to the
    first at which the rest, by weight, no longer fills one (there, and only there, the level by weight is largest).
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    turn = F.array(*[F.lit(w) for w in weights])
    t = sizes.withColumn("weight", F.element_at(turn, ((F.row_number().over(order) - 1) % len(weights)).cast("int") + 1))
    t = t.withColumn("cap", F.lit(most) * F.col("source_size"))
    full = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    everything = Window.partitionBy()
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("rest", F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    t = t.withColumn("left", F.sum("weight").over(full.rowsBetween(0, Window.unboundedFollowing)))
    level = F.max(F.when(F.col("rest") * F.col("weight") < F.col("cap") * F.col("left"), F.col("rest") / F.col("left"))).over(everything)
    t = t.withColumn("level", level)
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("level")))
    return t.select("source", "source_size", target.cast("double").alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, carried: bool = False) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, copies) for each row of ``docs (doc_id, text, source)``.

    ``copies`` complete epochs of a source come first; the rest of its target goes to the documents with the least
    exponential keys -ln(u) / quality weight, up to the one at which the prefix sum of sizes is nearest the rest.
    taken = copies * size. Null texts have size 0 and are in complete epochs only by name; a null source is a source
    of its own; equal rows tie in key and are told apart by a hash of the row, then arbitrarily (they are equal, so
    the totals agree). No rows give no rows. A document is never taken in part. carried: the whole row comes too, as ``row``.
    """
    text = F.col("text").cast("string")
    size = F.size(words(text)).cast("long")
    key = -F.log(uniform(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.xxhash64(text), seed=seed)) / quality_weight(text)
    row = [F.struct(*[docs[c] for c in docs.columns]).alias("row")] if carried else []
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").isNull().alias("no_source"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), size.alias("size"), key.alias("key"), *row)
    sized = staged(sized, "sized")
    # 1 - exp(-key) is near uniform, and grows with the key: buckets of it are ranges of keys of like size
    buckets = max(BUCKETS, sized.count() // PER_BUCKET)
    sized = sized.withColumn("bucket", F.least(F.lit(buckets - 1), F.floor((1 - F.exp(-F.col("key"))) * buckets)).cast("int"))
    of = ["no_source", "source"]
    sums = staged(sized.groupBy(*of, "bucket").agg(F.sum("size").alias("size")), "bucket_sizes")
    per_source = sums.groupBy(*of).agg(F.sum("size").cast("long").alias("source_size"))
    goal = targets(per_source.select(F.when(~F.col("no_source"), F.col("source")).alias("source"), "source_size"), weights, share, most)
    goal = goal.select(F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source"), "source_size", "target")
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    goal = goal.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    upto = Window.partitionBy(*of).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cut = sums.withColumn("before", F.coalesce(F.sum("size").over(upto), F.lit(0))).join(goal, of)
    # the boundary bucket is the last that begins below the rest
    cut = cut.groupBy(*of).agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("epochs").alias("epochs"), F.first("rest").alias("rest"),
                               F.max(F.when(F.col("before") < F.col("rest"), F.struct("bucket", "before"))).alias("at"))
    cut = staged(cut.select(*of, "source_size", "target", "epochs", "rest", F.coalesce("at.bucket", F.lit(-1)).alias("last"), F.coalesce("at.before", F.lit(0)).alias("begun")), "cut")
    each = join_small(sized, cut, of)
    inside = F.col("bucket") == F.col("last")
    sure = each.where(~inside).withColumn("more", (F.col("bucket") < F.col("last")).cast("int"))
    order = Window.partitionBy(*of).orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    edge = each.where(inside).withColumn("upto", F.col("begun") + F.sum("size").over(order))
    # nearest: the document that crosses the rest is taken if at least half of it is below
    edge = edge.withColumn("more", (F.col("upto") - F.col("size") / 2.0 <= F.col("rest")).cast("int")).drop("upto")
    both = sure.unionByName(edge)
    copies = (F.col("epochs") + F.col("more")).cast("int")
    return both.select("doc_id", F.when(~F.col("no_source"), F.col("source")).alias("source"), "size", "source_size", "target",
                       (F.col("size") * copies).cast("long").alias("taken"), copies.alias("copies"), *(["row"] if carried else []))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` in the mix: each row as often as it is taken, with or without a doc_id of its own; rows never taken go."""
    taken = mix(docs, carried=True).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
