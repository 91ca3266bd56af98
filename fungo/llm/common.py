"""What the corpus operators share.

Row numbers: operators that must come back to a row number it by ``numbered``
on each pass: by its file and its row in that file, which no split of a scan
changes. ``landed`` makes sure that there are files: a table that does not come
from files is written once, beside the checkpoints.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fungo.session import checkpoint_ready

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BATCH_ROWS, BATCH_BYTES = 1000, 32 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Bound what a Python worker holds at once, by rows and by bytes: texts are long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def stored(df: DataFrame) -> DataFrame:
    """Write a table beside the checkpoints, which all executors share, and read it again.

    It cuts the lineage, survives the loss of an executor and is narrower on
    disk than a checkpoint of rows."""
    spark = df.sparkSession
    checkpoint_ready(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Row numbers of one file; hashes of this many paths are broadcast at most (16 bytes each).
FILE_ROWS, BROADCAST_FILES = 1 << 40, 2_000_000


def file_rows(docs: DataFrame) -> DataFrame | None:
    """All columns of docs, the path of each row's file and the row's place in it; None where rows do not come from files."""
    path, at = free_name(docs, "file_path"), free_name(docs, "file_row")
    try:
        meta = docs.metadataColumn("_metadata")
        rows = docs.select("*", meta["file_path"].alias(path), meta["row_index"].alias(at))
        rows.schema  # names are resolved here
    except AnalysisException:
        return None
    return rows


def landed(docs: DataFrame) -> DataFrame:
    """docs as rows of files: as they are, or written once."""
    return docs if file_rows(docs) is not None else stored(docs)


def numbered(docs: DataFrame, name: str = "row_id") -> DataFrame:
    """docs, which must be rows of files (see ``landed``), with a number of each row.

    Files are numbered in a written table of path hashes; it is joined as the
    planner sees fit, and broadcast by hint only up to a stated size."""
    rows = file_rows(docs)
    if rows is None:
        raise ValueError("rows that do not come from files have no lasting number; write them first (landed)")
    path, at, no, mark = (free_name(docs, n) for n in ("file_path", "file_row", "file_no", "file_mark"))
    marks = stored(
        rows.select(path).groupBy(F.xxhash64(path).alias(mark)).agg((F.min(path) != F.max(path)).alias("clash"))
        .select(mark, "clash", (F.row_number().over(Window.orderBy(mark)) - 1).cast("long").alias(no)))
    n, clash = marks.agg(F.count("*"), F.max("clash")).first()
    if clash:
        raise ValueError("two files of one path hash")
    marks = marks.select(mark, no)
    return (rows.withColumn(mark, F.xxhash64(path)).join(F.broadcast(marks) if n <= BROADCAST_FILES else marks, mark)
            .withColumn(name, F.col(no) * FILE_ROWS + F.col(at)).drop(path, at, no, mark))


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, or with underscores until no column has it (names don't depend on case)."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node that an edge (a, b) touches; root is the smallest node reachable.

    Alternating large and small stars: each node is tied to the smallest of its
    neighbours until nothing changes. Minima are partial aggregates and the
    rows come back by joins, so a node with very many edges is never gathered.
    """
    def smallest(pairs: DataFrame) -> DataFrame:
        return stored(pairs.groupBy("a").agg(F.min("b").alias("m")))

    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = stored(both.join(smallest(both), "a").where("b > a")
                       .select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct())
        low = smallest(large)
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select("root", "root").distinct().toDF("node", "root"))
