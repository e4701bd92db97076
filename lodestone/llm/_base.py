"""Shared storage, sizes and graph steps of the training-data operators.

Intermediate tables go to the shared folder named by ``spark.checkpoint.dir``;
reading them again cuts the lineage, so a lost executor costs only the tasks
after the last written table.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Broadcast at most so many bytes at once; larger sides go in blocks or through a shuffle.
MAX_BROADCAST_BYTES = 64 << 20
#: The same in rows of a few numbers.
MAX_BROADCAST_ROWS = 1 << 18

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only for a local master without a setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="lodestone-")
    atexit.register(shutil.rmtree, own, True)
    folder = "file://" + own
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder; removed when the driver ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def stash(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: exact size statistics, no lineage."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete ``path`` through the file system that it names."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # the JVM may have ended before
            return


def col(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def boxed(docs: DataFrame, name: str = "row") -> Column:
    """All columns of ``docs`` as one, so that no name can clash; ``select("row.*")`` opens it."""
    return F.struct(*(col(c) for c in docs.columns)).alias(name)


def small(df: DataFrame) -> DataFrame:
    """A stashed table, to be broadcast if it has at most ``MAX_BROADCAST_ROWS`` rows; beyond, joins shuffle."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_ROWS else df


def only(docs: DataFrame, rows: DataFrame, stay: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of ``docs`` the rows that stay, with all their columns.

    ``rows(id, th, sig)`` has every document's class, ``stay(sig, stay)`` the first document of each, as a struct
    with ``id`` and ``th``; of rows equal to it in both one stays.
    """
    keyed = docs.select(boxed(docs), col(id_col).alias("id"), text_hash(col(text_col)).alias("th"))

    def among(table: DataFrame) -> Column:
        return keyed["id"].eqNullSafe(table["i"]) & (keyed["th"] == table["t"])

    told = rows.join(stay, "sig").select(F.col("id").alias("i"), F.col("th").alias("t"), (F.col("id").eqNullSafe(F.col("stay.id")) & (F.col("th") == F.col("stay.th"))).alias("first"))
    told = stash(told.groupBy("i", "t", "first").agg(F.count(F.lit(1)).alias("n")).where("not first or n > 1"), "told")
    gone, twice = (small(stash(told.where(x).select("i", "t"), "gone")) for x in ("not first", "first"))
    keyed = keyed.join(gone, among(gone), "left_anti")
    if twice.isEmpty():
        return keyed.select("row.*")
    once = keyed.join(twice, among(twice), "left_semi").groupBy("id", "th").agg(F.first("row").alias("row"))
    return keyed.join(twice, among(twice), "left_anti").select("row").unionByName(once.select("row")).select("row.*")


def text_hash(text: Column) -> Column:
    """Tells rows of one id apart by their text; never null."""
    return F.xxhash64(text)


def connected_components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``(node, root)`` for every node of ``edges(src, dst)``, both long.

    Randomised contraction: in each round every node joins the neighbour (or
    itself) of least hash, the graph shrinks to the chosen nodes by an expected
    constant factor, and the per-round choices are composed at the end.  No
    task and no driver ever holds a component; hubs meet only map-side combined
    aggregates and joins that adaptive execution can split.
    """
    here = stash(edges.where("src <> dst").select("src", "dst").distinct(), "edges")
    rounds: list[DataFrame] = []
    for k in range(max_rounds):
        if here.isEmpty():
            break
        both = here.unionByName(here.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        order = F.struct(F.xxhash64(F.lit(k), "dst").alias("h"), F.col("dst").alias("n"))
        own = F.struct(F.xxhash64(F.lit(k), "src").alias("h"), F.col("src").alias("n"))
        step = stash(both.groupBy("src").agg(F.min(order).alias("a"), F.first(own).alias("b")).select(F.col("src").alias("node"), F.least("a", "b")["n"].alias("rep")), "step")
        rounds.append(step)
        left = step.select(F.col("node").alias("src"), F.col("rep").alias("s"))
        right = step.select(F.col("node").alias("dst"), F.col("rep").alias("d"))
        here = stash(here.join(left, "src").join(right, "dst").where("s <> d").select(F.least("s", "d").alias("src"), F.greatest("s", "d").alias("dst")).distinct(), "edges")
    else:
        raise RuntimeError("components didn't settle")
    if not rounds:
        return edges.sparkSession.createDataFrame([], "node long, root long")
    out = rounds[-1].select("node", F.col("rep").alias("root"))
    for step in reversed(rounds[:-1]):
        later = out.select(F.col("node").alias("rep"), "root")
        out = stash(step.join(later, "rep", "left").select("node", F.coalesce("root", "rep").alias("root")), "roots")
    return out
