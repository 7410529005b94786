"""Parent links to hierarchies: roots, depths, paths and descendants, with cycles told apart (problem 3).

Nodes whose way up never ends are told apart by pointer doubling, whose rounds also sum up the subtrees: a depth of d takes
log2(d) rounds of joins over rows of a few ids; every round is checkpointed. Trees are then cut into heavy chains (Sleator and
Tarjan): a node's heavy child is the one with the largest subtree, and any way to a root crosses at most log2(n)
chains. Roots, depths, paths and intervals are those of the chains, plus a node's place in its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.storage import checkpointed, current_rows, hot_keys, lookup

#: Parts in which the children of one parent are numbered, so that no task numbers all children of a wide class.
PARTS = 64
#: Rows of one key from which on they are spread over tasks.
HOT_ROWS = 100_000
#: Widths of the blocks of positions by which intervals meet the nodes in them.
WIDTHS = (1, 16, 256, 4096)


def spelled(path: Column) -> Column:
    """A path id in its one spelling: no blanks around it, slashes, no repeated or leading ``./`` segments."""
    x = F.translate(F.trim(path), "\\", "/")
    x = F.regexp_replace(x, r"/(?:\./|/)+", "/")
    return F.regexp_replace(x, r"^(?:\./)+", "")


def module_files(file_path: Column, module: Column) -> Column:
    """The files that a module can be: under the first segment of the importing file's path, or, for a module with
    leading dots, under the file's directory and its parents."""
    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    name = F.regexp_replace(module, r"^\.+", "")
    path = F.translate(name, ".", "/")
    parts = F.split(file_path, "/")
    base = F.when(dots == 0, F.element_at(parts, 1)).otherwise(F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - dots, F.lit(0))), "/"))
    stem = F.concat_ws("/", F.nullif(base, F.lit("")), F.nullif(path, F.lit("")))
    return F.array(F.concat(stem, F.lit(".py")), F.concat(stem, F.lit("/__init__.py")))


def parent_links(class_nodes: DataFrame, inheritance_map: DataFrame, import_nodes: DataFrame) -> DataFrame:
    """(id, parent) for each id of ``class_nodes`` that has a parent there.

    The current inheritance_map link counts if it leads to a class; else the first of the current row's bases that
    does: a base's name is looked up among the names that the file imports, then among the file's classes. Null and
    empty names lead nowhere. Of several imports of one name, the smallest id that is a class counts.
    """
    classes = current_rows(class_nodes.select("id", "file_path", "bases", "ingest_seq"), "id", "ingest_seq")
    known = classes.select(F.col("id").alias("known"))
    links = inheritance_map.select(spelled(F.col("child_id")).alias("id"), spelled(F.col("parent_id")).alias("known"), "ingest_seq")
    links = current_rows(links, "id", "ingest_seq").join(known, "known", "left_semi").select("id", F.col("known").alias("mapped"))

    based = classes.select("id", "file_path", F.posexplode_outer("bases").alias("pos", "base")).where(F.trim("base") != "")
    based = based.select("id", "file_path", "pos", F.regexp_replace(F.trim("base"), r"[\[(].*$", "").alias("base"))
    # Dotted bases: what is before the last dot names a module, the rest the class.
    based = based.withColumn("owner", F.regexp_extract("base", r"^(.*)\.[^.]*$", 1)).withColumn("last", F.regexp_extract("base", r"([^.]*)$", 1))
    imports = import_nodes.where("file_path is not null and module is not null").select("file_path", "module", F.nullif(F.trim("imported_symbol"), F.lit("")).alias("symbol"), F.nullif(F.trim("alias"), F.lit("")).alias("alias")).distinct()
    inner = F.concat("module", F.when(F.col("module").rlike(r"\.$"), F.lit("")).otherwise(F.lit(".")), "symbol")
    names = imports.where("symbol is not null").select("file_path", F.coalesce("alias", "symbol").alias("local"), F.explode(module_files(F.col("file_path"), F.col("module"))).alias("file"), F.col("symbol").alias("cls"))
    modules = imports.where("symbol is null").select("file_path", F.coalesce("alias", "module").alias("local"), F.explode(module_files(F.col("file_path"), F.col("module"))).alias("file"))
    inner_modules = imports.where("symbol is not null").select("file_path", F.coalesce("alias", "symbol").alias("local"), F.explode(module_files(F.col("file_path"), inner)).alias("file"))
    modules = modules.unionByName(inner_modules)
    plain = based.where("owner = ''").join(names, (based["base"] == names["local"]) & (based["file_path"] == names["file_path"])).select("id", "pos", F.lit(0).alias("rank"), F.concat_ws("::", "file", "cls").alias("known"))
    dotted = based.where("owner <> ''").join(modules, (based["owner"] == modules["local"]) & (based["file_path"] == modules["file_path"])).select("id", "pos", F.lit(0).alias("rank"), F.concat_ws("::", "file", "last").alias("known"))
    own = based.where("owner = ''").select("id", "pos", F.lit(1).alias("rank"), F.concat_ws("::", "file_path", "base").alias("known"))
    found = plain.unionByName(dotted).unionByName(own).join(known, "known", "left_semi")
    first = found.groupBy("id").agg(F.min(F.struct("pos", "rank", "known")).alias("m")).select("id", F.col("m.known").alias("based"))
    return classes.select("id").join(links, "id", "left").join(first, "id", "left").select("id", F.coalesce("mapped", "based").alias("parent")).where("parent is not null")


def _separated(tree: DataFrame, hot_rows: int) -> tuple[DataFrame, int]:
    """``tree`` (id, parent) with looped and size, and its number of rows: whether the way up never ends, and, where it ends, the nodes of the subtree, its top included.

    After round k a row knows the node 2^k links up and the size of its subtree to depth 2^k: that and those of the nodes
    2^k below make the next. Depths have no gaps, so a round that ends no row's way means that the rest goes round for
    ever. Nothing below a node whose way ends is looped, so its size is right.
    """
    state = checkpointed(tree.select("id", "parent", F.col("parent").alias("jump"), F.lit(1).cast("bigint").alias("size")))
    n, left = state.agg(F.count("*"), F.count("jump")).first()
    before = None
    while left and left != before:
        before = left
        below = state.where("jump is not null").groupBy(F.col("jump").alias("id")).agg(F.sum("size").alias("more"))
        summed = state.join(below, "id", "left").select("id", "parent", "jump", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))
        above = state.select(F.col("id").alias("jump"), F.col("jump").alias("next"))
        moved = lookup(summed, above, "jump", hot_keys(state, "jump", n, hot_rows))
        state = checkpointed(moved.select("id", "parent", F.col("next").alias("jump"), "size"))
        left = state.where("jump is not null").count()
    return state.select("id", "parent", F.col("jump").isNotNull().alias("looped"), "size"), n


def _ranked(rows: DataFrame) -> DataFrame:
    """``rows`` (id, up) with head and place: the first node of each row's chain and the links to it. Each node is ``up`` of one row at most, so no key is hot."""
    kept = [c for c in rows.columns if c != "up"]
    state = checkpointed(rows.select(*kept, F.col("up").alias("jump"), F.col("id").alias("head"), F.lit(0).cast("bigint").alias("place")))
    step = 1
    while not state.where("jump is not null").isEmpty():
        above = state.select(F.col("id").alias("jump"), F.col("jump").alias("next"), F.col("head").alias("above_head"), F.col("place").alias("above_place"))
        moved = state.where("jump is not null").drop("head", "place").join(above, "jump").select(*kept, F.col("next").alias("jump"), F.col("above_head").alias("head"), (F.lit(step) + F.col("above_place")).alias("place"))
        state = checkpointed(state.where("jump is null").unionByName(moved))
        step *= 2
    return state.drop("jump")


def hierarchy(links: DataFrame, nodes: DataFrame | None = None, paths: bool = True, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id, root_id, depth) of each node, and with ``paths`` path, descendants, first, last.

    ``links``: id, parent; ``nodes`` (id): further nodes, roots if they have no link. path goes from the root to the node.
    first and last number the tree from its root (0) so that a node's descendants are the nodes of the same root with a first
    above its own and at most its last. Nodes whose way up never ends have root_id ``cycle``, depth -1 and null
    path, descendants, first and last. A null id is no node; of repeated links the smallest parent counts.

    The nodes of a chain are gathered in one row; its last node's path holds them all anyway. Keys with more than
    ``hot_rows`` rows (parents, chains) are spread over tasks.
    """
    links = links.where("id is not null and parent is not null").groupBy("id").agg(F.min("parent").alias("parent"))
    every = links.unionByName(links.select(F.col("parent").alias("id"), F.lit(None).cast("string").alias("parent")))
    every = every if nodes is None else every.unionByName(nodes.where("id is not null").select("id", F.lit(None).cast("string").alias("parent")))
    tree, n = _separated(every.groupBy("id").agg(F.max("parent").alias("parent")), hot_rows)
    cyclic, sound = tree.where("looped"), tree.where("not looped").select("id", "parent", "size")

    wide = hot_keys(sound, "parent", n, hot_rows)
    heavy = sound.where("parent is not null").groupBy("parent").agg(F.min_by(F.struct("id", "size"), F.struct(-F.col("size"), "id")).alias("h")).select("parent", F.col("h.id").alias("heavy"), F.col("h.size").alias("heavy_size"))
    linked = lookup(sound, heavy, "parent", wide).select("id", "parent", "size", "heavy_size", F.when(F.col("heavy") == F.col("id"), F.col("parent")).alias("up"))
    placed = _ranked(linked)
    # Chains: each head, and the node on another chain that it hangs on.
    heads = placed.where("place = 0").select("head", "parent", "size", F.col("heavy_size").alias("sibling_size"))
    attach = placed.select(F.col("id").alias("parent"), F.col("head").alias("above"), F.col("place").alias("at"))
    chains = lookup(heads, attach, "parent", wide)
    carried: dict[str, tuple[Column, Column]] = {  # of a chain: at a root, and from the chain above
        "root_id": (F.col("head"), F.col("above_root_id")),
        "depth": (F.lit(0).cast("bigint"), F.col("above_depth") + F.col("at") + 1),
    }
    if paths:
        chains = chains.join(_light_steps(chains), "head", "left")
        segments = placed.groupBy("head").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("members"))
        chains = chains.join(segments, "head")
        carried["number"] = (F.lit(0).cast("bigint"), F.col("above_number") + F.col("at") + F.col("step"))
        carried["prefix"] = (F.array().cast("array<string>"), F.concat("above_prefix", F.slice("above_members", 1, F.col("at").cast("int") + 1)))
        carried["members"] = (F.col("members"), F.col("members"))
    chains = checkpointed(chains)
    # From the roots down: a chain starts behind the node that it hangs on, whose chain is done.
    level = checkpointed(chains.where("parent is null").select("head", *[top.alias(c) for c, (top, _) in carried.items()]))
    crowded, whole = hot_keys(chains, "above", n, hot_rows), level
    while not level.isEmpty():
        upper = level.select(F.col("head").alias("above"), *[F.col(c).alias(f"above_{c}") for c in carried])
        level = checkpointed(lookup(chains.where("above is not null"), upper, "above", crowded, "inner").select("head", *[below.alias(c) for c, (_, below) in carried.items()]))
        whole = whole.unionByName(level)
    out = lookup(placed.select("id", "head", "place", "size"), whole, "head", hot_keys(placed, "head", n, hot_rows), "inner")
    columns = {"id": F.col("id"), "root_id": F.col("root_id"), "depth": (F.col("depth") + F.col("place")).cast("int")}
    none = {"id": F.col("id"), "root_id": F.lit("cycle"), "depth": F.lit(-1)}
    if paths:
        first = F.col("number") + F.col("place")
        columns |= {"path": F.concat("prefix", F.slice("members", 1, F.col("place").cast("int") + 1)), "descendants": F.col("size") - 1, "first": first, "last": first + F.col("size") - 1}
        none |= {"path": F.lit(None).cast("array<string>")} | {c: F.lit(None).cast("bigint") for c in ("descendants", "first", "last")}
    return out.select(*[c.alias(x) for x, c in columns.items()]).unionByName(cyclic.select(*[c.alias(x) for x, c in none.items()]))


def _light_steps(chains: DataFrame) -> DataFrame:
    """(head, step): how far behind its parent a chain's head is numbered: behind the heavy sibling's subtree and its light siblings before it.

    In parts by hash, so two small prefix sums do for a wide parent.
    """
    light = chains.where("parent is not null").select("head", "parent", "size", "sibling_size", F.pmod(F.xxhash64("head"), F.lit(PARTS)).alias("part"))
    before = Window.partitionBy("parent", "part").orderBy("head").rowsBetween(Window.unboundedPreceding, -1)
    parts_before = Window.partitionBy("parent").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = light.groupBy("parent", "part").agg(F.sum("size").alias("s")).withColumn("offset", F.coalesce(F.sum("s").over(parts_before), F.lit(0))).drop("s")
    light = light.withColumn("own", F.coalesce(F.sum("size").over(before), F.lit(0))).join(parts, ["parent", "part"])
    return light.select("head", (1 + F.col("sibling_size") + F.col("own") + F.col("offset")).alias("step"))


def _block_of(width: int):
    return lambda k: F.struct(F.lit(width).alias("width"), k.alias("block"))


def descendant_pairs(found: DataFrame) -> DataFrame:
    """(id, descendant, distance) of every node above every node, from the intervals of ``hierarchy``.

    A node's descendants are numbered from ``first`` + 1 to ``last``. The interval is cut into whole blocks of ``WIDTHS``
    positions, the widest in its middle, and a node is in one block of each width: an equality join in which no key has more
    than 4096 nodes, and no pair comes twice.
    """
    rows = found.where("first is not null").select("id", "root_id", "depth", "first", "last")
    inside = rows.select("root_id", F.col("id").alias("descendant"), F.col("depth").alias("deep"), F.explode(F.array(*[F.struct(F.lit(w).alias("width"), F.floor(F.col("first") / w).alias("block")) for w in WIDTHS])).alias("b"))
    inside = inside.select("root_id", "b.width", "b.block", "descendant", "deep")
    # At each width: whole blocks of the interval that lie outside the next width's whole blocks.
    low, high, parts = F.col("first") + 1, F.col("last") + 1, []
    for w, wider in zip(WIDTHS, [*WIDTHS[1:], None]):
        a, b = F.ceil(low / w), F.floor(high / w)
        if wider is None:
            spans = [(a, b)]
        else:
            c, d = F.ceil(low / wider) * (wider // w), F.floor(high / wider) * (wider // w)
            whole = c < d
            spans = [(a, F.when(whole, c).otherwise(b)), (F.when(whole, d).otherwise(b), b)]
        for x, y in spans:
            blocks = F.when(x < y, F.sequence(x, y - 1)).otherwise(F.array().cast("array<bigint>"))
            parts.append(F.transform(blocks, _block_of(w)))
    cover = rows.where("last > first").select("root_id", "id", "depth", F.explode(F.concat(*parts)).alias("b")).select("root_id", "b.width", "b.block", "id", "depth")
    return cover.join(inside, ["root_id", "width", "block"]).select("id", "descendant", (F.col("deep") - F.col("depth")).alias("distance"))
