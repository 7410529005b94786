"""Reading tables and cutting lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def current_rows(df: DataFrame, key: str, seq: str) -> DataFrame:
    """Of each key only the row with the highest ``seq``; rows without key are left out.

    Rows delivered twice are equal, so any of them may stay. Spark ranks within each input
    partition before the shuffle, so a key that holds a third of all rows sends one row a partition.
    A null ``seq`` ranks last.
    """
    newest = Window.partitionBy(key).orderBy(F.col(seq).desc_nulls_last())
    rank = fresh(*df.columns)
    return df.where(F.col(key).isNotNull()).withColumn(rank, F.row_number().over(newest)).where(F.col(rank) == 1).drop(rank)


def checkpointed(df: DataFrame, costly: bool = False) -> DataFrame:
    """``df`` written to the checkpoint folder that all executors share, and read from there.

    The folder is the session's; only a local session without one gets a folder of its own. Estimates of sizes
    are not carried over: in loops of joins they are products of products, which take ever longer to multiply.
    Adaptive execution measures the sizes as it runs.

    A checkpoint is written by a job of its own, which repeats the last stage. ``costly``: keep that stage's rows
    until then instead, which pays where it calls Python.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="loomgraph-checkpoint-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    held = df.persist(StorageLevel.MEMORY_AND_DISK) if costly else df
    kept = held.checkpoint(eager=True)
    if costly:
        held.unpersist()
    plan = kept._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.queryExecution().toRdd(), plan.schema(), False), spark)


def fresh_many(n: int, *columns: str) -> list[str]:
    """``n`` column names that none of ``columns`` has, and that begin no other's."""
    base = fresh(*columns)
    while any(c.lower().startswith(base) for c in columns):
        base += "x"
    return [f"{base}{i}" for i in range(n)]


def fresh(*columns: str) -> str:
    """A column name that none of ``columns`` has, whatever their case."""
    taken, name = {c.lower() for c in columns}, "__x"
    while name in taken:
        name += "x"
    return name


#: Tasks over which the rows of a hot key are spread.
SALTS = 64


def hot_keys(rows: DataFrame, key: str, n: int, least: int) -> list:
    """The values of ``key`` that more than ``least`` and more than a 200th of ``n`` rows have, ``n`` being at least the number of rows: 200 at most."""
    if n <= least:
        return []
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).count()
    return [r[0] for r in counts.where(F.col("count") > max(least, n // 200)).select(key).collect()]


def lookup(rows: DataFrame, by_key: DataFrame, key: str, hot: list, how: str = "left") -> DataFrame:
    """``rows`` joined with the one row of ``by_key`` that has their key; rows of ``hot`` keys are spread over tasks by their hash, to each of which that one row goes."""
    if not hot:
        return rows.join(by_key, key, how)
    salt = fresh(*rows.columns, *by_key.columns)
    spread = F.when(F.col(key).isin(hot), F.pmod(F.xxhash64(*[c for c in rows.columns if c != key]), F.lit(SALTS))).otherwise(F.lit(0))
    copies = F.when(F.col(key).isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn(salt, spread.cast("int")).join(by_key.withColumn(salt, F.explode(copies)), [key, salt], how).drop(salt)


def bounded(rows: DataFrame, most: int = 10_000) -> DataFrame:
    """``rows`` after a check that they are at most ``most``, as of a table that is small by contract before it is broadcast; more raise an error."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"a table of more than {most} rows where a small one is needed")
    return rows
