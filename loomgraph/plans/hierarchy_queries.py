"""Queries of problem 3 and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import hierarchy as H
from loomgraph.storage import table


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.parent_links(table(spark, sf_dir, "class_nodes"), table(spark, sf_dir, "inheritance_map"), table(spark, sf_dir, "import_nodes"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each class with a parent: its root and depth, from its heavy chain and its place in it."""
    links = H.checkpointed(_links(spark, sf_dir))
    found = H.hierarchy(links, paths=False).join(links.select("id"), "id", "left_semi")
    return found.select(F.col("id").alias("class_id"), "root_id", "depth")


def p3_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every class: root, depth, path and number of descendants; classes without a parent are roots."""
    links = H.checkpointed(_links(spark, sf_dir))
    classes = table(spark, sf_dir, "class_nodes").select("id").where("id is not null").distinct()
    found = H.hierarchy(links, classes)
    return found.select(F.col("id").alias("class_id"), "root_id", "depth", F.array_join("path", " > ").alias("path"), "descendants", (F.col("last") - F.col("first")).alias("span"))


def p3_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every class above every class."""
    found = H.hierarchy(H.checkpointed(_links(spark, sf_dir)))
    return H.descendant_pairs(found).select(F.col("id").alias("class_id"), F.col("descendant").alias("descendant_id"), "distance")


_LINKS = r"""
classes AS (SELECT id, file_path, bases FROM class_nodes WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingest_seq DESC) = 1),
spelt AS (SELECT regexp_replace(regexp_replace(replace(trim(child_id), '\', '/'), '/(\./|/)+', '/', 'g'), '^(\./)+', '') AS id,
  regexp_replace(regexp_replace(replace(trim(parent_id), '\', '/'), '/(\./|/)+', '/', 'g'), '^(\./)+', '') AS parent, ingest_seq FROM inheritance_map),
mapped AS (SELECT id, parent FROM (SELECT * FROM spelt WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingest_seq DESC) = 1) WHERE parent IN (SELECT id FROM classes)),
based AS (SELECT id, file_path, generate_subscripts(bases, 1) AS pos, unnest(bases) AS base FROM classes),
imported AS (SELECT DISTINCT file_path, module, nullif(trim(imported_symbol), '') AS symbol, nullif(trim(alias), '') AS alias,
  CASE WHEN module LIKE '.%' THEN regexp_replace(file_path, '/[^/]*$', '') ELSE split_part(file_path, '/', 1) END
    || '/' || replace(ltrim(module, '.'), '.', '/') || '.py' AS file FROM import_nodes),
targets AS (
  SELECT b.id, b.pos, 0 AS rank, i.file || '::' || i.symbol AS parent FROM based b JOIN imported i
    ON b.file_path = i.file_path AND i.symbol IS NOT NULL AND b.base = coalesce(i.alias, i.symbol)
  UNION ALL SELECT b.id, b.pos, 0, i.file || '::' || regexp_extract(b.base, '([^.]*)$', 1) FROM based b JOIN imported i
    ON b.file_path = i.file_path AND i.symbol IS NULL AND regexp_extract(b.base, '^(.*)\.[^.]*$', 1) = coalesce(i.alias, i.module)
  UNION ALL SELECT id, pos, 1, file_path || '::' || base FROM based WHERE base NOT LIKE '%.%'),
first_base AS (SELECT id, parent FROM targets WHERE parent IN (SELECT id FROM classes)
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos, rank, parent) = 1),
links AS (SELECT c.id, coalesce(m.parent, f.parent) AS parent FROM classes c LEFT JOIN mapped m USING (id)
  LEFT JOIN first_base f USING (id) WHERE coalesce(m.parent, f.parent) IS NOT NULL),
way(id, top, depth, path) AS (SELECT id, parent, 1, [id, parent] FROM links
  UNION ALL SELECT w.id, l.parent, w.depth + 1, list_append(w.path, l.parent) FROM way w JOIN links l ON l.id = w.top WHERE w.depth < 200),
ends AS (SELECT w.id, w.top, w.depth, w.path FROM way w WHERE w.top NOT IN (SELECT id FROM links))
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p3_found": p3_found, "p3_paths": p3_paths, "p3_descendants": p3_descendants}

SQL: dict[str, str] = {
    "p3_found": f"WITH RECURSIVE {_LINKS} SELECT l.id AS class_id, coalesce(e.top, 'cycle') AS root_id, coalesce(e.depth, -1) AS depth FROM links l LEFT JOIN ends e ON l.id = e.id",
    "p3_paths": f"""WITH RECURSIVE {_LINKS},
      below AS (SELECT w.top AS id, count(*) AS n FROM way w JOIN ends e ON w.id = e.id GROUP BY 1)
      SELECT c.id AS class_id, CASE WHEN l.id IS NULL THEN c.id ELSE coalesce(e.top, 'cycle') END AS root_id,
        CASE WHEN l.id IS NULL THEN 0 ELSE coalesce(e.depth, -1) END AS depth,
        CASE WHEN l.id IS NULL THEN c.id WHEN e.id IS NULL THEN NULL ELSE array_to_string(list_reverse(e.path), ' > ') END AS path,
        CASE WHEN l.id IS NOT NULL AND e.id IS NULL THEN NULL ELSE coalesce(b.n, 0) END AS descendants,
        CASE WHEN l.id IS NOT NULL AND e.id IS NULL THEN NULL ELSE coalesce(b.n, 0) END AS span
      FROM classes c LEFT JOIN links l ON c.id = l.id LEFT JOIN ends e ON c.id = e.id LEFT JOIN below b ON c.id = b.id""",
    "p3_descendants": f"WITH RECURSIVE {_LINKS} SELECT w.top AS class_id, w.id AS descendant_id, w.depth AS distance FROM way w JOIN ends e ON w.id = e.id",
}
