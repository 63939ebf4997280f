"""Running sums, numbers and medians over groups of any size, and prefix scans in chunks.

A window over a group takes the whole group into one task. Here rows are dealt by ranges of (group,
order), each range is summed by itself, and only a row per range and group carries the sums over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.functions.lineage import cut

#: Rows of a chunk of a scan.
CHUNK = 4_096


def running_total(rows: DataFrame, group: str, order: list[str], amount: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``amount`` up to and with each row of its group, by ``order``, whose ties are in any order."""
    return running_totals(rows, group, order, {name: amount})


def running_totals(rows: DataFrame, group: str, order: list[str], amounts: dict[str, Column]) -> DataFrame:
    """:func:`running_total` of several amounts at once.

    A group's ranges are as many as the shuffle's partitions at most, so the window over them is small.
    """
    own, upto = {f"_amount{k}": v for k, v in enumerate(amounts.values())}, range(len(amounts))
    ranged = cut(rows.withColumns(own).repartitionByRange(group, *order).withColumn("_range", F.spark_partition_id()))
    so_far = Window.partitionBy(group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = ranged.withColumns({f"_within{k}": F.sum(f"_amount{k}").over(so_far) for k in upto})
    totals = ranged.groupBy(F.col(group).alias("_group"), F.col("_range").alias("_at")).agg(*(F.sum(f"_amount{k}").alias(f"_total{k}") for k in upto))
    earlier = Window.partitionBy("_group").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.withColumns({f"_before{k}": F.sum(f"_total{k}").over(earlier) for k in upto})
    joined = within.join(before, within[group].eqNullSafe(before["_group"]) & (within["_range"] == before["_at"]))
    return joined.withColumns({name: F.coalesce(f"_before{k}", F.lit(0)) + F.col(f"_within{k}") for k, name in enumerate(amounts)}).select(*rows.columns, *amounts)


def numbered(rows: DataFrame, group: str, order: list[str], name: str = "seq") -> DataFrame:
    """``rows`` with their number (from 1) in their group by ``order``."""
    return running_total(rows, group, order, F.lit(1).cast("long"), name)


def last_known(rows: DataFrame, group: str, order: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the latest ``value`` that is not null up to and with each row of its group, by ``order``."""
    ranged = cut(rows.repartitionByRange(group, *order).withColumn("_range", F.spark_partition_id()))
    window = Window.partitionBy(group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = ranged.withColumn("_within", F.last(value, ignorenulls=True).over(window))
    ends = ranged.filter(F.col(value).isNotNull()).groupBy(F.col(group).alias("_group"), F.col("_range").alias("_at")).agg(F.max_by(value, F.struct(*order)).alias("_end"))
    every = ranged.select(F.col(group).alias("_group"), F.col("_range").alias("_at")).distinct().join(ends, ["_group", "_at"], "left")
    before = every.withColumn("_before", F.last("_end", ignorenulls=True).over(Window.partitionBy("_group").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)))
    joined = within.join(before, within[group].eqNullSafe(before["_group"]) & (within["_range"] == before["_at"]), "left")
    return joined.withColumn(name, F.coalesce("_within", "_before")).select(*rows.columns, name)


def medians(rows: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """``group`` and ``name``, the exact median of ``value`` (the mean of two middles; nulls left out).

    Equal values are counted before they are dealt out, so neither a group nor a value of any share fills a task.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_n"))
    upto = running_total(counts, group, [value], F.col("_n"), "_upto")
    sizes = counts.groupBy(F.col(group).alias("_group")).agg(F.sum("_n").alias("_size"))
    found = upto.join(sizes, upto[group].eqNullSafe(sizes["_group"]))
    at = lambda rank: F.max(F.when((F.col("_upto") - F.col("_n") < rank) & (rank <= F.col("_upto")), F.col(value)))
    low, high = F.floor((F.col("_size") + 1) / 2), F.floor(F.col("_size") / 2) + 1
    return found.groupBy(group).agg(((at(low) + at(high)) / 2).alias(name))


def in_chunks(rows: DataFrame, seq: str, size: int, halo: int = 0) -> DataFrame:
    """``rows`` with ``chunk`` and ``own``: runs of ``size`` of the dense numbers ``seq`` (from 1), each led by the last ``halo`` rows before it (not own)."""
    home = F.floor((F.col(seq) - 1) / size)
    follows = (F.col(seq) - 1) % size >= size - halo
    chunks = F.when(follows, F.array(home, home + 1)).otherwise(F.array(home)) if halo else F.array(home)
    return rows.withColumn("chunk", F.explode(chunks)).withColumn("own", F.col("chunk") == home)


def decayed_sums(rows: DataFrame, window, column: str, rest: float, size: int) -> DataFrame:
    """``column`` becomes its sum over the rows of the window so far, each row back weighing ``rest`` times less.

    A parallel prefix: with each doubling step a row takes in the sum that ends so many rows before it.
    """
    step = 1
    while step < size and rest**step > 0:
        rows = rows.withColumn(column, F.col(column) + F.lit(rest**step) * F.coalesce(F.lag(column, step).over(window), F.lit(0.0)))
        step *= 2
    return rows


#: What a chunk does to whatever comes after it: rows, sums and least prefix sums of both arms, decayed sum.
STATE = ["n", "s_hi", "m_hi", "s_lo", "m_lo", "b"]


def carried(chunks: DataFrame, group: str, rest: float, size: int) -> DataFrame:
    """``group``, ``chunk`` and STATE of all that lies before each chunk but the first.

    ``chunks`` has the STATE of each chunk by itself, numbered from 0. They are scanned like rows, by chunks of
    chunks, and so on until one chunk is left of each group.
    """
    w = Window.partitionBy(group, "upper").orderBy("chunk")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    rows = chunks.withColumn("upper", F.floor(F.col("chunk") / size))
    # The least prefix sum of several chunks: each one's own after the sums before it.
    for arm in ("hi", "lo"):
        rows = rows.withColumn(f"_led_{arm}", F.col(f"m_{arm}") + F.coalesce(F.sum(f"s_{arm}").over(before), F.lit(0.0)))
    rows = rows.withColumn("upto_n", F.sum("n").over(upto))
    step = 1
    while step < size:
        weight = F.pow(F.lit(rest), F.col("upto_n") - F.coalesce(F.lag("upto_n", step).over(w), F.lit(0)))
        rows = rows.withColumn("b", F.col("b") + weight * F.coalesce(F.lag("b", step).over(w), F.lit(0.0)))
        step *= 2
    scanned = rows.select(
        group, "chunk", "upper", F.col("upto_n").alias("n"), *(x for arm in ("hi", "lo") for x in (F.sum(f"s_{arm}").over(upto).alias(f"s_{arm}"), F.min(f"_led_{arm}").over(upto).alias(f"m_{arm}"))), "b",
    )
    scanned = cut(scanned)
    if not scanned.filter("upper > 0").isEmpty():
        last = scanned.groupBy(group, "upper").agg(F.max_by(F.struct(*STATE), "chunk").alias("s")).select(group, F.col("upper").alias("chunk"), *(F.col(f"s.{c}").alias(c) for c in STATE))
        above = carried(last, group, rest, size).select(F.col(group).alias("_group"), F.col("chunk").alias("_upper"), *(F.col(c).alias(f"_{c}") for c in STATE))
        joined = scanned.join(above, scanned[group].eqNullSafe(above["_group"]) & (scanned["upper"] == above["_upper"]), "left")
        scanned = joined.select(group, "chunk", "upper", *(c.alias(name) for name, c in zip(STATE, followed(rest), strict=True)))
    return scanned.select(group, (F.col("chunk") + 1).alias("chunk"), *STATE)


def followed(rest: float) -> list[Column]:
    """STATE of what columns _n, _s_hi ... say (null: nothing), followed by what n, s_hi ... say."""
    old = {c: F.coalesce(f"_{c}", F.lit(0.0)) for c in STATE}
    least = lambda arm: F.least(F.col(f"_m_{arm}"), F.col(f"m_{arm}") + old[f"s_{arm}"])  # noqa: E731  least() passes over nulls
    return [
        (F.col("n") + F.coalesce("_n", F.lit(0))).cast("long"), F.col("s_hi") + old["s_hi"], least("hi"), F.col("s_lo") + old["s_lo"], least("lo"),
        F.col("b") + F.pow(F.lit(rest), F.col("n").cast("double")) * old["b"],
    ]

