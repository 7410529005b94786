"""Source files as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that hold no source of a project.
PRUNED = (".venv", "venv", "env", ".git", "__pycache__", "site-packages", "build", "dist", ".tox", ".pytest_cache", ".idea", ".vscode")


def kept_path(path: Column, suffix: str = ".py") -> Column:
    """Whether a path relative to the scanned root has the suffix and passes no pruned folder."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return path.endswith(suffix) & ~F.arrays_overlap(folders, F.array(*[F.lit(x) for x in PRUNED]))


def with_lines(files: DataFrame) -> DataFrame:
    """``files`` (file_path, content) with text, code_lines, name and line_count; bad UTF-8 is replaced, a last line end opens no line."""
    text = F.decode(F.coalesce("content", F.lit(b"")), "UTF-8")
    lines = F.split(F.regexp_replace(text, r"(\r\n|\r|\n)$", ""), r"\r\n|\r|\n")
    rows = files.withColumn("text", text).withColumn("code_lines", F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(lines))
    return rows.withColumn("name", F.element_at(F.split("file_path", "/"), -1)).withColumn("line_count", F.size("code_lines"))


def scan(spark: SparkSession, root: str, suffix: str = ".py") -> DataFrame:
    """(file_path, content) of the files under a folder; paths are relative to it. A folder that is missing gives no rows."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop) or not fs.getFileStatus(hadoop).isDirectory():
        return spark.createDataFrame([], "file_path string, content binary")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(root)
    base = fs.makeQualified(hadoop).toUri().getPath().rstrip("/") + "/"
    relative = F.expr(f"substring(path, locate('{base}', path) + {len(base)})")
    rows = files.select(relative.alias("file_path"), "content")
    return rows.where(kept_path(F.col("file_path"), suffix))
