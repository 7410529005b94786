"""Where results go: tables in a folder, and reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as Parquet under its name, in place of what was there."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def read_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}


def clear(spark: SparkSession, folder: str, names: list[str]) -> list[str]:
    """Removes tables; gives the names that were there."""
    gone = []
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(path) and fs.delete(path, True):
            gone.append(name)
    return gone


def markdown_report(summary: dict, rows: list[dict]) -> str:
    """A report of an evaluation: figures, a table with short reasons, and a section for each item.

    ``rows`` are an evaluation's items (id, question, is_correct, reason, answer, truth), a few hundred at most.
    """
    cell = lambda x: str(x or "").replace("|", "\\|").replace("\n", " ")
    short = lambda x: x if len(x) <= 85 else x[:85] + "..."
    out = ["# Evaluation", "", *(f"- {k}: {v}" for k, v in summary.items()), "", "| id | verdict | reason |", "|-|-|-|"]
    out += [f"| {r['id']} | {'PASS' if r['is_correct'] else 'FAIL'} | {short(cell(r.get('reason')))} |" for r in rows]
    for r in rows:
        out += ["", f"## {r['id']}", "", f"Question: {r.get('question') or ''}", "", f"Answer: {r.get('answer') or ''}", "", f"Expected: {r.get('truth') or ''}"]
    return "\n".join(out) + "\n"


def write_report(summary: dict, rows: list[dict], json_path: str, markdown_path: str) -> None:
    """Both forms of a report; called after each item, so that a broken run leaves what it had."""
    with open(json_path, "w", encoding="utf-8") as f:
        json.dump({"summary": summary, "results": rows}, f, ensure_ascii=False, indent=2, default=str)
    with open(markdown_path, "w", encoding="utf-8") as f:
        f.write(markdown_report(summary, rows))
