"""Mixing sources to target weights by systematic sampling.

Each document of a source is expected ``target / source_size`` times. Along the
documents of a source, sorted by size, these expectations are summed, one
offset is added, and a document is emitted once for each whole number its step
crosses. Sorting by size spreads the picks over short and long documents; the
offset is the one, of a few drawn from the source's name, whose words come
nearest to the target.

The expectation is the same for all documents of a source, so the sum before a
document is that times its rank; the rank is found in two levels, within
ranges of the sorted rows and over the ranges, so a source that holds most rows
is spread over many tasks. Only one row per source and range meets in one
place.

Null text has no words, a null source is a source. Documents without words are
never taken; a source without words has target 0. Rows with equal ids are
documents of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fungo.llm.common import WORD, free_name, landed, numbered, stored
from fungo.session import parallel_parts

LIMIT = 3
WEIGHTS = (1, 2, 3)
OFFSETS = 16


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def offset(source: Column, k: int) -> Column:
    """A number in [0, 1) drawn from the source's name."""
    digest = F.md5(F.concat(F.coalesce(source, F.lit("null:")), F.lit(f"#{k}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def targets(sources: DataFrame) -> DataFrame:
    """source, source_size, target: shares by weight, each at most LIMIT times its source's size.

    Sources whose limit is reached first are those with the least size for
    their weight; the share of the others follows from what is left. One row
    per source is ranked here."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    by_room = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before, after = by_room.rowsBetween(Window.unboundedPreceding, -1), by_room.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    level = (total - LIMIT * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after)
    ranked = sources.withColumn("weight", weight).select("*", level.alias("level")).withColumn(
        "open", F.col("level") * F.col("weight") <= LIMIT * F.col("source_size"))
    first_open = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(
        by_room.rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("share", first_open).select(
        "source", "source_size",
        F.coalesce(F.col("share") * F.col("weight"), LIMIT * F.col("source_size")).cast("double").alias("target"))


def copies(ratio: Column, rank: Column, start: Column) -> Column:
    return (F.floor(ratio * rank + start) - F.floor(ratio * (rank - 1) + start)).cast("long")


def mix(docs: DataFrame) -> DataFrame:
    """row_id, doc_id, size, source, source_size, target, copies: one row per row of docs."""
    parts = parallel_parts(docs.sparkSession)
    sized = stored(numbered(landed(docs).select("doc_id", "source", words(F.col("text")).alias("size"))))
    shares = stored(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))))
    ranged = stored(sized.repartitionByRange(parts, "source", "size", "doc_id", "row_id")
                    .withColumn("part", F.spark_partition_id()))
    order = Window.partitionBy("part", "source").orderBy("size", "doc_id", "row_id")
    ranges = stored(ranged.groupBy("source", "part").agg(F.count("*").alias("n")))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranges.select("source", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    heads = stored(bases.join(shares, bases["source"].eqNullSafe(shares["source"])).select(
        F.struct("part", bases["source"]).alias("head"), "base", "source_size", "target", ratio.alias("ratio")))
    ranked = stored(
        ranged.withColumn("local", F.row_number().over(order))
        .join(heads, F.struct("part", "source").eqNullSafe(F.col("head")))
        .select("row_id", "doc_id", "source", "size", "source_size", "target", "ratio",
                (F.col("base") + F.col("local")).alias("rank")))
    tried = ranked.groupBy("source", "target").agg(*(
        F.sum(copies(F.col("ratio"), F.col("rank"), offset(F.col("source"), k)) * F.col("size")).alias(f"k{k}")
        for k in range(OFFSETS)))
    best = stored(tried.select(
        F.col("source").alias("of"),
        F.array_min(F.array(*(F.struct(F.abs(F.col(f"k{k}") - F.col("target")), F.lit(k), offset(F.col("source"), k).alias("start"))
                              for k in range(OFFSETS))))["start"].alias("start")))
    return ranked.join(best, F.col("source").eqNullSafe(F.col("of"))).select(
        "row_id", "doc_id", "size", "source", "source_size", "target",
        copies(F.col("ratio"), F.col("rank"), F.col("start")).alias("copies"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken."""
    docs = landed(docs)
    taken = stored(mix(docs).where("copies > 0 and size > 0").select("row_id", "copies"))
    name, times, no = (free_name(docs, n) for n in ("row_id", "mix_copies", "mix_no"))
    # The list of what is taken grows with the corpus, so it is merged at every size.
    return (numbered(docs, name).join(taken.toDF(name, times).hint("merge"), name)
            .withColumn(no, F.explode(F.sequence(F.lit(1), F.col(times).cast("int"))))
            .select(*(F.col(f"`{c}`") for c in docs.columns)))


def sql() -> str:
    """The same rows, with one window over each source."""
    order = "source_size / weight, source IS NULL, source"
    return rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents),
  s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
  w AS (SELECT *, {list(WEIGHTS)}[(row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(WEIGHTS)} + 1] AS weight,
          sum(source_size) OVER ()::BIGINT AS total FROM s),
  l AS (SELECT *, (total - {LIMIT} * coalesce(sum(source_size) OVER (ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
          / (sum(weight) OVER (ORDER BY {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level FROM w),
  t AS (SELECT source, source_size, coalesce(first_value(CASE WHEN level * weight <= {LIMIT} * source_size THEN level END IGNORE NULLS)
          OVER (ORDER BY {order} ROWS UNBOUNDED PRECEDING) * weight, {LIMIT} * source_size)::DOUBLE AS target FROM l),
  r AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0e0 END AS ratio,
          row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id) AS n
        FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
  k AS (SELECT source, k, ('0x' || substr(md5(coalesce(source, 'null:') || '#' || k), 1, 8))::BIGINT / {float(1 << 32)!r} AS start
        FROM s, range({OFFSETS}) AS x(k)),
  b AS (SELECT r.source, k, start, abs(sum((floor(ratio * n + start) - floor(ratio * (n - 1) + start))::BIGINT * size) - target) AS miss
        FROM r JOIN k ON r.source IS NOT DISTINCT FROM k.source GROUP BY r.source, k, start, target),
  best AS (SELECT source, arg_min(start, (miss, k)) AS start FROM b GROUP BY source)
SELECT doc_id, size, source_size, target, (floor(ratio * n + start) - floor(ratio * (n - 1) + start))::BIGINT * size AS taken
FROM r JOIN best ON r.source IS NOT DISTINCT FROM best.source"""
