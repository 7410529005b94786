"""Symbols in edges to node ids, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.hierarchy import module_files
from loomgraph.storage import checkpointed, hot_keys, lookup


def alias_targets(imports: DataFrame, files: DataFrame | None = None, strict_reference: bool = False) -> DataFrame:
    """(file_path, local_name, target): what an imported name means, as ``file.py`` or ``file.py::symbol``.

    With ``files`` (file_path) modules are found under the importing file's root, its folder or the scan's root; with
    ``strict_reference`` the module's dots become slashes and nothing is looked up. Of several imports of a name in
    a file the largest target counts.
    """
    local = F.coalesce("alias", "imported_symbol", "module")
    suffix = F.when(F.col("imported_symbol").isNotNull(), F.concat(F.lit("::"), "imported_symbol")).otherwise(F.lit(""))
    literal = F.concat(F.translate("module", ".", "/"), F.lit(".py"))
    rows = imports.select("file_path", local.alias("local_name"), suffix.alias("suffix"), literal.alias("literal"), "module")
    if strict_reference or files is None:
        rows = rows.select("file_path", "local_name", F.concat("literal", "suffix").alias("target"))
    else:
        places = F.array_union(module_files(F.col("file_path"), F.col("module")), F.array("literal", F.concat(F.translate("module", ".", "/"), F.lit("/__init__.py"))))
        known = files.select(F.col("file_path").alias("place")).distinct()
        rows = rows.select("file_path", "local_name", "suffix", F.explode(places).alias("place")).join(known, "place", "left_semi").select("file_path", "local_name", F.concat("place", "suffix").alias("target"))
    return rows.groupBy("file_path", "local_name").agg(F.max("target").alias("target"))


def resolved_targets(edges: DataFrame, aliases: DataFrame) -> DataFrame:
    """``edges`` (src, edge, target, line) with resolved: the id that the target's text means from where it stands.

    ``self.x`` in a method is a member of its class; ``self`` elsewhere is nothing. Else an imported name wins, also as
    the part before a dot, over a name in the caller's file.
    """
    file = F.split("src", "::")[0]
    member = F.when(F.col("src").contains("::") & F.split("src", "::")[1].contains("."), F.concat(F.regexp_replace("src", r"\.[^.]*$", ""), F.lit("."), F.split("target", r"\.")[1]))
    rows = edges.withColumn("caller_file", file).withColumn("head", F.regexp_extract("target", r"^(.*)\.[^.]*$", 1)).withColumn("tail", F.regexp_extract("target", r"([^.]*)$", 1))
    whole = aliases.select(F.col("file_path").alias("caller_file"), F.col("local_name").alias("target"), F.col("target").alias("whole"))
    part = aliases.select(F.col("file_path").alias("caller_file"), F.col("local_name").alias("head"), F.col("target").alias("part"))
    rows = rows.join(whole, ["caller_file", "target"], "left").join(part, ["caller_file", "head"], "left")
    joined = F.concat("part", F.when(F.col("part").contains("::"), F.lit(".")).otherwise(F.lit("::")), "tail")
    resolved = F.when(F.col("target").startswith("self."), member).otherwise(F.coalesce("whole", joined, F.concat_ws("::", "caller_file", "target")))
    return rows.select("src", "edge", "target", "line", resolved.alias("resolved"))


def resolved_edges(edges: DataFrame, aliases: DataFrame, functions: DataFrame, classes: DataFrame, variables: DataFrame) -> DataFrame:
    """(src, edge, target): RESOLVED_CALLS to functions, INSTANTIATES classes, RESOLVED_INHERITS and RESOLVED_USES_VARIABLE, each once."""
    rows = resolved_targets(edges.where(F.col("edge").isin("CALLS", "INHERITS_FROM", "USES_VARIABLE")), aliases)
    names = {"CALLS": ((functions, "RESOLVED_CALLS"), (classes, "INSTANTIATES")), "INHERITS_FROM": ((classes, "RESOLVED_INHERITS"),), "USES_VARIABLE": ((variables, "RESOLVED_USES_VARIABLE"),)}
    registry = None
    for edge, kinds in names.items():
        for rank, (ids, kind) in enumerate(kinds):
            part = ids.select(F.lit(edge).alias("edge"), F.col("id").alias("resolved"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"))
            registry = part if registry is None else registry.unionByName(part)
    best = registry.groupBy("edge", "resolved").agg(F.min_by("kind", "rank").alias("kind"))
    return rows.join(best, ["edge", "resolved"]).select("src", F.col("kind").alias("edge"), F.col("resolved").alias("target")).distinct()


def ordered_bases(classes: DataFrame, aliases: DataFrame) -> DataFrame:
    """(src, target, position): the classes that a class's bases mean, with the place of each base in the list."""
    bases = classes.select(F.col("id").alias("src"), F.posexplode("bases").alias("line", "target")).withColumn("edge", F.lit("INHERITS_FROM"))
    rows = resolved_targets(bases, aliases).select("src", F.col("resolved").alias("target"), F.col("line").alias("position"))
    return rows.join(classes.select(F.col("id").alias("target")).distinct(), "target", "left_semi").select("src", "target", "position")


def attribute_uses(edges: DataFrame, inherits: DataFrame, attributes: DataFrame, hot_rows: int = 100_000) -> DataFrame:
    """(src, edge, target): RESOLVED_USES_INST_ATTR from methods to the attribute of their class or of the first class above that has it.

    ``inherits``: src, target, and position if the order of bases is known (else bases are in the order of targets); ``attributes``: id, name, class_id.
    First is meant depth first: a base and all above it come before the next base. So each class above is reached with the
    list of positions on the way, the smallest list wins, and ways go on from a class only where its list became smaller.
    A way round a cycle only makes a list longer, so cyclic bases end; there is no limit of depth.
    """
    uses = edges.where("edge = 'USES_INSTANCE_ATTRIBUTE'").select("src", F.col("target").alias("name"), F.regexp_replace("src", r"\.[^.]*$", "").alias("class_id")).distinct()
    place = F.col("position").cast("int") if "position" in inherits.columns else F.lit(0)
    # One row a class, so that a base that many have is spread (``lookup``).
    up = inherits.groupBy(F.col("src").alias("class_id")).agg(F.array_sort(F.collect_set(F.struct(place.alias("position"), F.col("target").alias("parent")))).alias("bases"))
    if "position" not in inherits.columns:
        up = up.withColumn("bases", F.transform("bases", lambda x, i: F.struct(i.cast("int").alias("position"), x["parent"].alias("parent"))))
    up = checkpointed(up)
    best = frontier = checkpointed(uses.select(F.col("class_id").alias("own"), "class_id", F.array().cast("array<int>").alias("way")).distinct())
    while n := frontier.count():
        above = lookup(frontier, up, "class_id", hot_keys(frontier, "class_id", n, hot_rows), "inner").select("own", "way", F.inline("bases"))
        above = above.groupBy("own", F.col("parent").alias("class_id")).agg(F.min(F.concat("way", F.array("position"))).alias("way"))
        known = best.select("own", "class_id", F.col("way").alias("known"))
        frontier = checkpointed(above.join(known, ["own", "class_id"], "left").where("known is null or way < known").select("own", "class_id", "way"))
        best = checkpointed(best.unionByName(frontier).groupBy("own", "class_id").agg(F.min("way").alias("way")))
    held = best.join(attributes.select("class_id", "name", F.col("id").alias("attribute")), "class_id").groupBy("own", "name").agg(F.min_by("attribute", F.struct("way", "attribute")).alias("target"))
    return uses.select("src", "name", F.col("class_id").alias("own")).join(held, ["own", "name"]).select("src", F.lit("RESOLVED_USES_INST_ATTR").alias("edge"), "target").distinct()
