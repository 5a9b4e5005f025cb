"""Building blocks that keep plans safe when one key holds much of the data.

* ``first_per_key``   one row per key by map-side combining, never a per-key sort
* ``dim_join``        broadcast behind a row-count check, salted shuffle join beyond it
* ``fan_out``         a join in which narrow rows become many, dealt to all tasks first
* ``attach``          put a per-key aggregate back on its detail rows, salted
* ``global_row_number`` / ``global_running`` ordered positions and running sums over a
  whole table by range partitioning instead of one un-partitioned window
* ``exact_quantiles`` linear-interpolated quantiles from counted distinct values
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tapewire.session import shared_dir

BROADCAST_ROWS = 200_000
SALTS = 16


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder, cutting lineage reliably."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan, re-split when it has fewer splits than the cluster has cores.

    For heavy per-row text work on a few unsplittable files; large inputs pass unchanged.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, F.xxhash64(*scan.columns)) if scan.rdd.getNumPartitions() < cores else scan


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed exactly once per row.

    The optimizer rewrites a filter on a derived column into one on its definition,
    and so repeats a costly text expression for every mention.  Passing the values
    through a one-element explode keeps them: filters stay above it.
    """
    packed = F.struct(*[c.alias(n) for n, c in columns.items()])
    out = df.select(*[c for c in df.columns if c not in columns], F.explode(F.array(packed)).alias("_once"))
    return out.select(*[c for c in df.columns if c not in columns], *[F.col("_once")[n].alias(n) for n in columns])


def explode_some(df: DataFrame, keep: Sequence[str | Column], array: Column, name: str) -> DataFrame:
    """Kept columns with one row per non-NULL element; the array expression is not repeated as a filter."""
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True when the frame has at most ``max_rows`` rows; reads no further than that."""
    return df.limit(max_rows + 1).count() <= max_rows


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], last: bool = False) -> DataFrame:
    """The first (or last) row of each key by ``order``.

    An aggregate rather than a ranked window: each task keeps one row per key
    before the shuffle, so a key with a third of the rows costs no more than any other.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    best = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def _salted(fact: DataFrame, small: DataFrame, on: Sequence[str], salts: int) -> tuple[DataFrame, DataFrame]:
    plain = [c for c, t in fact.dtypes if "map<" not in t]  # maps have no hash
    fact = fact.withColumn("_salt", F.pmod(F.xxhash64(*plain), F.lit(salts)))
    small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return fact, small


def attach(fact: DataFrame, per_key: DataFrame, on: Sequence[str], how: str = "left", salts: int = SALTS) -> DataFrame:
    """Join detail rows to one-row-per-key values, spreading each key over ``salts`` tasks."""
    fact, per_key = _salted(fact, per_key, on, salts)
    return fact.join(per_key, [*on, "_salt"], how).drop("_salt")


def dim_join(
    fact: DataFrame,
    dim: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join a large table to a lookup table: broadcast if it fits, else salted shuffle."""
    if fits(dim, max_rows):
        return fact.join(F.broadcast(dim), list(on), how)
    return attach(fact, dim, on, how)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt to a fixed number of tasks, by keys or evenly: for steps that cost far more than the bytes they read.

    Adaptive execution and file splits go by bytes; a fixed number of tasks is left as it is.
    """
    session = df.sparkSession
    return df.repartition(max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism), *keys)


def fan_out(rows: DataFrame, dim: DataFrame, on: Sequence[str], max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Inner join in which each of ``rows`` becomes many.

    Undealt, a few small rows would meet the whole of ``dim`` in one task.
    """
    if fits(dim, max_rows):
        return dealt(rows).join(F.broadcast(dim), list(on))
    rows, dim = _salted(rows, dim, on, SALTS)
    keys = [*on, "_salt"]
    return dealt(rows, *keys).join(dealt(dim, *keys), keys).drop("_salt")


def _ordered_blocks(df: DataFrame, order: Sequence[Column], blocks: int | None) -> DataFrame:
    # The block id is stored before the checkpoint, so a lost executor cannot
    # re-sample other boundaries between the two uses of the table.
    n = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).withColumn("_block", F.spark_partition_id())
    return checkpointed(ranged)


def global_row_number(df: DataFrame, order: Sequence[Column], name: str = "rn", blocks: int | None = None) -> DataFrame:
    """Row number over the whole table by ``order`` (which must be total), block by block."""
    ranged = _ordered_blocks(df, order, blocks)
    sizes = ranged.groupBy("_block").agg(F.count("*").alias("_n"))
    # one row per block: at most ``blocks`` rows reach this window and the broadcast
    before = sizes.select(
        "_block",
        F.coalesce(F.sum("_n").over(W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
    )
    inside = F.row_number().over(W.partitionBy("_block").orderBy(*order))
    return (
        ranged.join(F.broadcast(before), "_block")
        .withColumn(name, (inside + F.col("_before")).cast("long"))
        .drop("_block", "_before")
    )


def global_running(
    df: DataFrame, order: Sequence[Column], sums: dict[str, str], blocks: int | None = None
) -> DataFrame:
    """Running sums over the whole table by ``order``: ``sums`` maps new name to summed column."""
    ranged = _ordered_blocks(df, order, blocks)
    totals = ranged.groupBy("_block").agg(*[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    prior = W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(
        "_block", *[F.coalesce(F.sum(f"_t_{o}").over(prior), F.lit(0)).alias(f"_b_{o}") for o in sums]
    )
    inside = W.partitionBy("_block").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(before), "_block")
    for o, c in sums.items():
        out = out.withColumn(o, F.sum(c).over(inside) + F.col(f"_b_{o}"))
    return out.drop("_block", *[f"_b_{o}" for o in sums])


def exact_quantiles(df: DataFrame, column: str, probs: Sequence[float]) -> DataFrame:
    """Rows ``(prob, value)``: quantiles with linear interpolation, as ``percentile`` defines them.

    Values are counted per distinct value first, so repeats collapse before the
    shuffle, and the order statistics are found from running counts; no task
    holds the whole column.  ``approx_quantiles`` trades exactness for one pass.
    """
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(
        F.count("*").alias("n")
    )
    running = global_running(counted, [F.col("v")], {"upto": "n"})
    # A row covers the zero-based positions [upto - n, upto); a quantile needs the
    # positions floor(pos) and floor(pos) + 1.
    total = running.agg(F.sum("n")).scalar()
    first = F.col("upto") - F.col("n")

    def low_index(p: Column) -> Column:
        return F.floor(p * (F.col("_total") - 1))

    wanted = F.filter(
        F.array(*[F.lit(float(p)) for p in probs]),
        lambda p: (F.col("upto") > low_index(p)) & (first <= low_index(p) + 1),
    )
    hit = (
        running.withColumn("_total", total)
        .withColumn("prob", F.explode(wanted))
        .withColumn("_lo", low_index(F.col("prob")))
        .withColumn("_frac", F.col("prob") * (F.col("_total") - 1) - F.col("_lo"))
    )
    at = lambda i: (first <= i) & (F.col("upto") > i)
    ends = hit.groupBy("prob").agg(
        F.max(F.when(at(F.col("_lo")), F.col("v"))).alias("_a"),
        F.max(F.when(at(F.col("_lo") + 1), F.col("v"))).alias("_b"),
        F.max("_frac").alias("_frac"),
    )
    upper = F.coalesce("_b", "_a")
    return ends.select("prob", (F.col("_a") + F.col("_frac") * (upper - F.col("_a"))).alias("value"))


def approx_quantiles(df: DataFrame, column: str, probs: Sequence[float], accuracy: int = 10_000) -> DataFrame:
    """Rows ``(prob, value)`` from a mergeable sketch, for dashboards that need one pass."""
    sketch = df.agg(F.percentile_approx(column, [float(p) for p in probs], accuracy).alias("vs"))
    probs_col = F.array(*[F.lit(float(p)) for p in probs])
    return sketch.select(F.explode(F.arrays_zip(probs_col.alias("prob"), F.col("vs").alias("value"))).alias("z")).select(
        "z.prob", "z.value"
    )


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
