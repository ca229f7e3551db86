"""Mixing sources to target weights: capped water-filling and seeded repetitions.

Everything a document needs to know is decided per source: how often the source is taken
whole, and which seeded keys get one more repetition. A document's share is then computed
where it lies, by a lookup of its source; texts are read once and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, staged, word_count

#: Keys have 60 bits; the upper 16 number the buckets that are summed first.
_BUCKET_SHIFT = 44


def _key(id_col: str, seed: int) -> Column:
    """A seeded place in the order of repetitions; rows with one id share it."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds ``rank`` (from 0) by code point, null last, without sorting all in one task."""
    spark, order = sources.sparkSession, F.col("source").asc_nulls_last()
    ranges = sources.repartitionByRange(partitions(spark), order).withColumn("part", F.spark_partition_id())
    ranges = staged(ranges, "ranges")
    before = ranges.groupBy("part").count().select(
        "part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before")
    )
    within = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return ranges.withColumn("within", within).join(before, "part").select(
        "source", "source_size", (F.col("before") + F.col("within")).alias("rank")
    )


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    The sources share ``share`` times all sizes by weight; a source whose part is above
    ``max_epochs`` times its size is clamped there and the rest is dealt again by weight,
    until none is above. Each round is an aggregate; the driver sees one row of sums.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    known = _ranked(sizes).select("source", "source_size", weight.cast("double").alias("weight"))
    known = staged(known.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))), "sources")
    total, level = known.agg(F.sum("source_size"), F.sum("weight")).first()
    goal, clamped = share * (total or 0), -1
    level = goal / level if level else 0.0
    while True:
        above = F.col("cap") < F.col("weight") * level
        n, capped, free = known.agg(
            F.count_if(above), F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("weight")))
        ).first()
        if not free or n == clamped:
            break
        level, clamped = (goal - (capped or 0.0)) / free, n
    return known.select("source", "source_size", F.least("cap", F.col("weight") * level).alias("target"))


def _last_whole(units: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per source the last key up to which all units together stay within ``wanted``.

    Buckets of keys are summed first, so that only the one bucket in which the sum passes
    ``wanted`` is ordered unit by unit.
    """
    by_bucket = units.groupBy("source", F.shiftright("key", _BUCKET_SHIFT).alias("bucket")).agg(F.sum("size").alias("size"))
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("bucket"))
    sums = by_bucket.withColumn("upto", upto).join(wanted, F.expr("source <=> of"))
    edge = sums.where(F.col("upto") > F.col("wanted")).groupBy("of", "wanted").agg(
        F.min("bucket").alias("bucket"), F.min_by(F.col("upto") - F.col("size"), "bucket").alias("before")
    )
    edge = wanted.select("of").join(edge.withColumnRenamed("of", "at"), F.expr("of <=> at"), "left")
    inside = units.join(edge, F.expr("source <=> of") & (F.shiftright("key", _BUCKET_SHIFT) == F.col("bucket")))
    upto = F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("key"))
    fits = inside.withColumn("upto", upto).where(F.col("upto") <= F.col("wanted"))
    last = fits.groupBy(F.col("source").alias("at")).agg(F.max("key").alias("key"), F.max("upto").alias("upto"))
    whole_buckets = (F.shiftleft(F.col("bucket"), _BUCKET_SHIFT) - 1).cast("long")
    return edge.drop("at").join(last, F.expr("of <=> at"), "left").select(
        "of",
        F.when(F.col("bucket").isNull(), F.lit(2**62)).otherwise(F.coalesce("key", whole_buckets)).alias("last_key"),
        F.coalesce("upto", "before").alias("reached"),
    )


def plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    max_epochs: float = 2,
    seed: int = 0,
    top_ups: int = 2,
) -> DataFrame:
    """Per source: ``source, source_size, target, whole, last_key, extra_keys``.

    A document of the source is taken ``whole`` times, and once more if its key is at most
    ``last_key`` or among ``extra_keys``. Keys are taken in order while they fit the
    target; then ``top_ups`` times the one that comes nearest to what is left, where it
    comes nearer than nothing, so that even a source of few documents meets its target.
    """
    units = docs.select(F.col(source_col).alias("source"), _key(id_col, seed).alias("key"), word_count(text_col).alias("size"))
    units = staged(units.groupBy("source", "key").agg(F.sum("size").alias("size")), "units")
    sizes = units.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = targets(sizes, weights, share, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goals = goals.withColumn("whole", epochs.cast("long"))
    goals = staged(goals.withColumn("wanted", F.col("target") - F.col("whole") * F.col("source_size")), "goals")
    wanted = goals.select(F.col("source").alias("of"), "wanted")
    taken = goals.join(_last_whole(units, wanted), F.expr("source <=> of")).drop("of")
    taken = taken.withColumn("left", F.col("wanted") - F.coalesce("reached", F.col("source_size").cast("double")))
    taken = staged(taken.withColumn("extra_keys", F.expr("array()").cast("array<long>")), "taken")
    for _ in range(top_ups):
        state = taken.select(F.col("source").alias("of"), "last_key", "extra_keys", "left")
        gap = F.abs(F.col("size") - F.col("left"))
        free = units.join(state, F.expr("source <=> of")).where(
            (F.col("key") > F.col("last_key")) & (gap < F.col("left")) & ~F.array_contains("extra_keys", F.col("key"))
        )
        best = free.groupBy(F.col("of").alias("at")).agg(F.min(F.struct(gap, "key", "size")).alias("best"))
        best = best.select("at", "best.key", "best.size")
        taken = staged(
            taken.join(best, F.expr("source <=> at"), "left").select(
                "source", "source_size", "target", "whole", "last_key",
                (F.col("left") - F.coalesce("size", F.lit(0))).alias("left"),
                F.when(F.col("key").isNull(), F.col("extra_keys")).otherwise(
                    F.array_append("extra_keys", F.col("key"))).alias("extra_keys"),
            ),
            "taken",
        )
    return taken.select("source", "source_size", "target", "whole", "last_key", "extra_keys")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    max_epochs: float = 2,
    seed: int = 0,
    top_ups: int = 2,
) -> DataFrame:
    """Every row of ``docs`` as a struct ``row``, with ``size, source_size, target, copies``.

    ``size`` is the number of words (null text: 0). Sources ordered by code point, null
    last as a source of its own, get ``weights`` in turn. Null ids share one key, as do
    repeated rows, so they are repeated alike. No row is taken more than ``max_epochs``
    times (rounded up). Columns of ``docs`` may have any name. An empty table yields an
    empty result.
    """
    per_source = plan(docs, id_col, text_col, source_col, weights, share, max_epochs, seed, top_ups)
    rows = docs.select(
        F.struct("*").alias("row"), F.col(source_col).alias("of"), _key(id_col, seed).alias("key"), word_count(text_col).alias("size")
    )
    extra = (F.col("key") <= F.col("last_key")) | F.array_contains("extra_keys", F.col("key"))
    # A source that is taken as often as allowed has nothing left to add, not even empty texts.
    extra &= F.col("whole") < max_epochs
    return rows.join(per_source, F.expr("of <=> source")).select(
        "row", "size", "source_size", "target", (F.col("whole") + extra.cast("long")).alias("copies")
    )


def repeated(mixed: DataFrame) -> DataFrame:
    """The mixed rows themselves, each as often as it is taken."""
    often = mixed.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return often.select("row.*")


def sql(table: str, weights=(5, 2, 1), share=1.5, max_epochs=2, seed=0) -> str:
    """The same plan for a second engine (two top-ups)."""
    pick = """select source, arg_min(key, (gap, key)) key, arg_min(size, (gap, key)) size from (
      select u.source, u.key, u.size, abs(u.size - t.rest) gap from units u join {0} t on u.source is not distinct from t.source
      where u.key > t.last_key and abs(u.size - t.rest) < t.rest and not list_contains(t.extra, u.key)) group by 1"""
    added = """select t.source, t.source_size, t.target, t.whole, t.last_key, t.rest - coalesce(b.size, 0) rest,
      case when b.key is null then t.extra else list_append(t.extra, b.key) end extra
      from {0} t left join {1} b on t.source is not distinct from b.source"""
    return rf"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint size,
    ('0x' || substr(md5('{seed}:' || coalesce(doc_id::varchar, '')), 1, 15))::bigint key from {table}),
units as (select source, key, sum(size)::bigint size from d group by 1, 2),
s as (select source, sum(size)::bigint source_size from units group by 1),
w as (select *, ({list(weights)})[((row_number() over (order by source nulls last) - 1) % {len(weights)})::int + 1]::double weight,
    source_size * {float(max_epochs)}::double cap from s),
o as (select *, row_number() over (order by cap / weight, source nulls last) k, sum(source_size) over () * {share}::double goal,
    sum(weight) over () all_w, sum(cap) over (order by cap / weight, source nulls last rows unbounded preceding) - cap caps,
    sum(weight) over (order by cap / weight, source nulls last rows unbounded preceding) - weight ws from w),
l as (select min(k) k, arg_min((goal - caps) / (all_w - ws), k) level from o where cap >= weight * ((goal - caps) / (all_w - ws))),
g as (select source, source_size, least(cap, weight * level) target from w, l),
g2 as (select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint whole from g),
g3 as (select *, target - whole * source_size wanted from g2),
c as (select g3.source, u.key, sum(u.size) over (partition by u.source order by u.key) upto, wanted
    from units u join g3 on u.source is not distinct from g3.source),
t0 as (select g3.source, source_size, target, whole, coalesce(max(c.key), -1) last_key, any_value(g3.wanted) - coalesce(max(c.upto), 0) rest,
    []::bigint[] extra from g3 left join c on g3.source is not distinct from c.source and c.upto <= c.wanted group by 1, 2, 3, 4),
b1 as ({pick.format("t0")}), t1 as ({added.format("t0", "b1")}),
b2 as ({pick.format("t1")}), t2 as ({added.format("t1", "b2")})
select d.doc_id, d.size, t.source_size, t.target,
    d.size * (t.whole + (d.key <= t.last_key or list_contains(t.extra, d.key))::bigint) taken
from d join t2 t on d.source is not distinct from t.source"""
