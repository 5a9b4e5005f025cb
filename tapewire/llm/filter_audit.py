"""Filter interaction audit: what each filter removes in every order in which the filters can be applied.

Every document becomes a mask of the filters it fails.  A recursive common table expression
extends filter prefixes by a letter not yet used and joins each with the counted masks of
its part, carrying the bits applied so far; a level of the recursion emits the metrics of that step.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewire.llm.batches import null_safe
from tapewire.operators.scale import checkpointed, once

LETTERS = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"
METRICS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
PARTS_A_RUN = 2_000  # parts of one recursion: 326 rows each, under Spark's limit of a million rows


def _own_mask(text: Column) -> Column:
    """Bits 1, 2, 4, 8 for the filters A to D, which look at one text only."""
    words = F.array_remove(F.split(text, SPACE), "")
    seen = F.struct(F.size(words).alias("n"), F.size(F.array_distinct(words)).alias("d"))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))

    def bits(w: Column) -> Column:
        fails = (w["n"] < 100, 100 * w["d"] < 80 * w["n"], 100 * capitals > 10 * F.length(text), text.rlike("[#$%&*|]"))
        return sum((F.when(bad, 1 << i).otherwise(0) for i, bad in enumerate(fails)), F.lit(0))

    return F.element_at(F.transform(F.array(seen), bits), 1)


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Rows (part, mask, good, toxic, n): how many documents of a part fail exactly the filters in ``mask``.

    Filter E fails where a smaller id has the same text anywhere in the table.  Texts are compared
    by SHA-256; only digests, ids and masks are shuffled.  Equal rows are counted together before the first
    shuffle, and the joins run on unique ids, so a text that a third of the table shares is no hot key.

    NULL texts are empty; a NULL part is the empty string.  Rows that share an id are documents of their own; a row without an id never fails E,
    is no smaller id to others and has no labels.  An id labelled more than once is good (toxic) if any of its labels says so.
    Texts of any length are measured whole.  Columns other than the named ones are not looked at, whatever their names.
    """
    slim = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    measured = once(slim, own=_own_mask(F.col("text")), digest=F.unhex(F.sha2("text", 256))).drop("text")
    rows = checkpointed(measured.groupBy("doc_id", "part", "own", "digest").agg(F.count("*").alias("n")))
    first = rows.where(F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    flag = lambda c: F.max((F.col(c) == 1).cast("int"))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.coalesce(flag("quality"), F.lit(0)).alias("good"), F.coalesce(flag("toxic"), F.lit(0)).alias("toxic")
    )
    named = rows.where(F.col("doc_id").isNotNull()).join(first, ["doc_id", "digest"], "left").join(marks, "doc_id", "left")
    copy = F.when(F.col("first").isNull(), 1 << LETTERS.index("E")).otherwise(0)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    known = named.select("part", (F.col("own") + copy).alias("mask"), zero("good"), zero("toxic"), "n")
    nameless = rows.where(F.col("doc_id").isNull()).select("part", F.col("own").alias("mask"), F.lit(0).alias("good"), F.lit(0).alias("toxic"), "n")
    return known.unionByName(nameless).groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


# Each level joins the prefixes of a part with its mask cells, at most 32, kept as one array.  ``l.i`` is an unused letter.
WALK = """
WITH RECURSIVE walk(part, filter_order, step, applied, {names}) AS (
  SELECT part, '', 0, 0, {zeros} FROM {{cells}}
  UNION ALL
  SELECT part, concat(filter_order, substr('{letters}', i + 1, 1)), step + 1, applied | bit, {sums}
  FROM (SELECT w.part, w.filter_order, w.step, w.applied, l.i, shiftleft(1, l.i) AS bit, c.cells
        FROM walk w JOIN {{cells}} c ON c.part = w.part
        LATERAL VIEW explode(filter(sequence(0, {last}), i -> w.applied & shiftleft(1, i) = 0)) l AS i))
SELECT part, filter_order, step, {names} FROM walk WHERE step > 0"""

# metric -> (cells that count, what is summed)
SUMS = {
    "kept": ("x.mask & (applied | bit) = 0", "n"),
    "removed": ("x.mask & applied = 0 AND x.mask & bit <> 0", "n"),
    "redundant": ("x.mask & applied <> 0 AND x.mask & bit <> 0", "n"),
    "unique_fails": ("x.mask = bit", "n"),
    "good_lost": ("x.mask & applied = 0 AND x.mask & bit <> 0", "good"),
    "toxic_lost": ("x.mask & applied = 0 AND x.mask & bit <> 0", "toxic"),
}


def enumerate_prefixes(counted: DataFrame) -> DataFrame:
    """Rows (part, filter_order, step, metrics) for every prefix of every order: 325 a part."""
    cell = F.struct("mask", "n", "good", "toxic")
    sums = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0)).alias(c)
    per_mask = counted.groupBy("part", "mask").agg(sums("good"), sums("toxic"), F.sum("n").alias("n"))
    cells = per_mask.groupBy("part").agg(F.collect_list(cell).alias("cells"))  # 32 cells at most
    cells = checkpointed(cells)  # one narrow row a part
    runs = math.ceil(max(cells.count(), 1) / PARTS_A_RUN)
    cells = cells.withColumn("run", F.pmod(F.xxhash64("part"), F.lit(runs)))
    sql = WALK.format(
        names=", ".join(METRICS),
        zeros=", ".join("0L" for _ in METRICS),
        letters=LETTERS,
        last=len(LETTERS) - 1,
        sums=", ".join(f"aggregate(cells, 0L, (a, x) -> a + CASE WHEN {SUMS[m][0]} THEN x.{SUMS[m][1]} ELSE 0L END)" for m in METRICS),
    )
    walks = [counted.sparkSession.sql(sql, cells=cells.where(F.col("run") == r)) for r in range(runs)]
    whole = walks[0]
    for walk in walks[1:]:
        whole = whole.unionByName(walk)
    return checkpointed(whole)


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Rows (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    One row for every part, order and step.  A prefix of k letters stands for the (5 - k)! orders that begin with
    it, which is how ``shapley`` sums a letter's removals over all orders.  An empty table has no parts and gives no rows;
    what NULLs, ties and repeated rows mean is said at ``masks``.
    """
    steps = enumerate_prefixes(masks(docs, labels, id_col, text_col, part_col))
    letter = F.right("filter_order", F.lit(1))
    orders = F.element_at(F.array(*[F.lit(math.factorial(len(LETTERS) - k)) for k in range(1, len(LETTERS) + 1)]), F.col("step"))
    shapley = steps.groupBy("part", letter.alias("letter")).agg(F.sum(F.col("removed") * orders).cast("long").alias("shapley"))
    full = steps.where(F.col("step") == len(LETTERS)).select("part", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step"))
    full = full.withColumns({"prefix": F.left("filter_order", F.col("step")), "letter": F.substr("filter_order", F.col("step"), F.lit(1))})
    metrics = steps.select("part", F.col("filter_order").alias("prefix"), *METRICS)
    out = null_safe(full, metrics, ["part", "prefix"], "inner").join(shapley, ["part", "letter"])
    return out.select("part", "filter_order", "step", *METRICS, "shapley")
