"""Most similar vectors for every vector (problem 2): vantage-point trees in overlapping shards."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.storage import checkpointed, hot_keys, lookup

#: Rows a shard aims at, shards a vector goes to, and the most pivots (2 MB of broadcast at 128 numbers of two bytes a vector, 4 MB at most).
SHARD_ROWS, COPIES, MOST_PIVOTS = 3000, 7, 16_384
#: Share of the triangle inequality's bound that a search keeps; 1 makes the search exact.
FACTOR = 0.25
#: Rows with one vector from which on they are spread over tasks; parts in which the rows that ask a shard meet its members.
HOT_ROWS, PARTS = 100_000, 8
_LEAF = 160


def _quantized(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in 16-bit steps of a vector's own scale; products are right to about 3e-6."""
    top = np.abs(vectors).max(1, keepdims=True)
    return np.rint(vectors / top * 32767).astype(np.int16)


def _unit(blobs, size: int) -> np.ndarray:
    v = np.frombuffer(b"".join(blobs), np.int16).reshape(-1, size).astype(np.float32)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def usable(vectors: DataFrame, size: int, key: str = "id", vector: str = "vector") -> DataFrame:
    """(id, q): rows whose vector has ``size`` finite elements, not all zero, with its direction in 16-bit steps. Other columns are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                v = np.stack([np.asarray(x, np.float64) for x in pdf["v"]])
                good = np.isfinite(v).all(1) & (v != 0).any(1)
                yield pd.DataFrame({"id": pdf["id"].to_numpy()[good], "q": [row.tobytes() for row in _quantized(v[good])]})

    rows = vectors.where((F.size(vector) == size) & F.col(key).isNotNull() & ~F.exists(vector, lambda x: x.isNull()))
    return rows.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v")).mapInPandas(run, "id bigint, q binary")


class _Found:
    """The best k matches of each query so far, by rounded similarity and then the smaller id."""

    def __init__(self, n: int, k: int, least: float):
        self.k, self.kth = k, np.full(n, least)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.top = np.full((n, k), -1.0)
        self.least = least

    def add(self, queries: np.ndarray, items: np.ndarray, sims: np.ndarray) -> None:
        a, b = np.nonzero(sims >= (self.kth[queries] - 1e-6)[:, None])
        q, x = queries[a], items[b]
        keep = q != x
        q, x, s = q[keep], x[keep], np.round(sims[a, b][keep].astype(np.float64), 6)
        if not len(q):
            return
        order = np.lexsort((x, -s, q))
        q, x, s = q[order], x[order], s[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        near = rank < self.k
        q, x, s, rank = q[near], x[near], s[near], rank[near]
        self.parts.append((q, x, s))
        touched = np.unique(q)
        fresh = np.full((len(touched), self.k), -1.0)
        fresh[np.searchsorted(touched, q), rank] = s
        both = np.sort(np.concatenate((self.top[touched], fresh), 1), 1)[:, -self.k :]
        self.top[touched] = both
        self.kth[touched] = np.maximum(self.least, both[:, 0])


def _build(v: np.ndarray, items: np.ndarray, rng: np.random.Generator):
    """A vantage-point tree: (vantage, radius, inner, outer), or the items of a leaf."""
    if len(items) <= _LEAF:
        return items
    vantage = v[items[rng.integers(len(items))]]
    d = np.arccos(np.clip(v[items] @ vantage, -1, 1))
    radius = float(np.median(d))
    inside = d < radius
    if not inside.any() or inside.all():
        half = len(items) // 2
        inside = np.arange(len(items)) < half
        return (None, 0.0, _build(v, items[inside], rng), _build(v, items[~inside], rng))
    return (vantage, radius, _build(v, items[inside], rng), _build(v, items[~inside], rng))


def _search(tree, v: np.ndarray, queries: np.ndarray, found: _Found, factor: float) -> None:
    """All queries at once: each goes to its nearer side first and to the other if the relaxed bound allows."""
    if not len(queries):
        return
    if isinstance(tree, np.ndarray):
        found.add(queries, tree, v[queries] @ v[tree].T)
        return
    vantage, radius, inner, outer = tree
    if vantage is None:
        _search(inner, v, queries, found, factor)
        _search(outer, v, queries, found, factor)
        return
    gap = np.arccos(np.clip(v[queries] @ vantage, -1, 1)) - radius
    first = gap < 0
    _search(inner, v, queries[first], found, factor)
    _search(outer, v, queries[~first], found, factor)
    reach = np.arccos(np.clip(found.kth[queries], -1, 1)) * factor
    more = np.abs(gap) <= reach
    _search(outer, v, queries[first & more], found, factor)
    _search(inner, v, queries[~first & more], found, factor)


def search_shard(ids: np.ndarray, v: np.ndarray, k: int, least: float, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, similarity): for each row its best k others in the shard, at or above ``least``."""
    order = np.argsort(ids, kind="stable")
    ids, v = ids[order], v[order]
    rows = np.arange(len(ids))
    found = _Found(len(ids), k, least)
    _search(_build(v, rows, np.random.default_rng(len(ids))), v, rows, found, factor)
    if not found.parts:
        return ids[:0], ids[:0], np.zeros(0)
    q, x, s = (np.concatenate(p) for p in zip(*found.parts))
    order = np.lexsort((x, -s, q))
    q, x, s = q[order], x[order], s[order]
    fresh = np.ones(len(q), bool)
    fresh[1:] = (q[1:] != q[:-1]) | (x[1:] != x[:-1])
    q, x, s = q[fresh], x[fresh], s[fresh]
    near = np.arange(len(q)) - np.searchsorted(q, q) < k
    return ids[q[near]], ids[x[near]], s[near]


def _nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, near: int) -> np.ndarray:
    """The places of each vector's ``near`` nearest pivots."""
    if near >= len(pivots):
        return np.tile(np.arange(len(pivots)), (len(vectors), 1))
    return np.argpartition(-(vectors @ pivots.T), near - 1, 1)[:, :near]


def _drawn(rows: DataFrame, wanted: int, size: int) -> np.ndarray:
    """At most ``wanted`` (bounded by ``MOST_PIVOTS``) of the rows' vectors, by the hash of their ids."""
    drawn = rows.select("q", F.xxhash64(F.lit(3), "id").alias("h"), "id").orderBy("h", "id").limit(wanted).collect()
    return _unit([bytes(r["q"]) for r in drawn], size).astype(np.float16)


def _placed(rows: DataFrame, pivots: np.ndarray, near: int, size: int) -> DataFrame:
    """(shard, id, q): each row at its ``near`` nearest pivots."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)  # 4 MB at most

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = shared.value.astype(np.float32)
        for pdf in batches:
            for i in range(0, len(pdf), 1024):
                part = pdf.iloc[i : i + 1024]
                best = _nearest_pivots(_unit(part["q"], size), p, near)
                yield pd.DataFrame({"shard": best.ravel().astype(np.int64), "id": np.repeat(part["id"].to_numpy(), best.shape[1]), "q": np.repeat(part["q"].to_numpy(), best.shape[1])})

    return rows.select("id", "q").mapInPandas(assign, "shard bigint, id bigint, q binary")


def _placed_twice(rows: DataFrame, wanted: int, most: int, copies: int, size: int) -> DataFrame:
    """``_placed`` where ``wanted`` pivots are too many to broadcast: coarse cells first, then pivots of the cells.

    Each of about sqrt(``wanted``) cells draws its pivots from the rows nearest to it. A row goes to its nearest cells, where parts of its rows
    meet all pivots of the cell, and of the pivots that it met there it keeps the nearest. No part holds more than the
    cell's pivots and a bounded number of rows.
    """
    coarse = min(most, math.isqrt(wanted) + 1)
    cells, a_cell = _drawn(rows, coarse, size), -(-wanted // coarse)
    own = _placed(rows, cells, 1, size)
    order = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(5), "id"), "id")
    fine = own.withColumn("r", F.row_number().over(order)).where(F.col("r") <= a_cell).select("shard", F.col("id").alias("pivot"), F.col("q").alias("p"))
    parts = max(1, -(-rows.count() * copies // (coarse * 20_000)))
    met = _placed(rows, cells, min(copies, coarse), size).withColumn("part", F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(parts)))
    fine = fine.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))))

    def choose(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"shard": [], "id": [], "q": [], "s": []})
        v, p = _unit(left["q"], size), _unit(right["p"], size)
        best = _nearest_pivots(v, p, copies)
        sims = np.take_along_axis(v @ p.T, best, 1)
        return pd.DataFrame({"shard": right["pivot"].to_numpy()[best].ravel(), "id": np.repeat(left["id"].to_numpy(), best.shape[1]), "q": np.repeat(left["q"].to_numpy(), best.shape[1]), "s": sims.ravel()})

    found = met.groupBy("shard", "part").cogroup(fine.groupBy("shard", "part")).applyInPandas(choose, "shard bigint, id bigint, q binary, s float")
    rank = Window.partitionBy("id").orderBy(F.col("s").desc(), "shard")
    return found.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= copies).select("shard", "id", "q")


def _in_blocks(placed: DataFrame, shard_rows: int, shards: int | None = None) -> DataFrame:
    """``placed`` with x and y: shards of over 8 times the aim are cut into blocks, and each row goes to every pair of its block with another, so that no task holds more and no pair is lost. Of at most ``MOST_PIVOTS`` ``shards`` the large ones are broadcast."""
    sizes = placed.groupBy("shard").count().where(F.col("count") > 8 * shard_rows).select("shard", F.ceil(F.col("count") / (4 * shard_rows)).alias("blocks"))
    sizes = F.broadcast(sizes) if shards is not None and shards <= MOST_PIVOTS else sizes
    cut = placed.join(sizes, "shard", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("bigint")))
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    others = F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)
    pair = F.explode(F.transform(others, lambda o: F.struct(F.least(o, own).alias("x"), F.greatest(o, own).alias("y"))))
    return cut.withColumn("pair", pair).select("shard", F.col("pair.x").alias("x"), F.col("pair.y").alias("y"), "id", "q")


def _best(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("a").orderBy(F.col("similarity").desc(), "b")
    found = found.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    return found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")


def nearest(rows: DataFrame, size: int, k: int = 5, least: float = 0.7, shard_rows: int = SHARD_ROWS, copies: int = COPIES, factor: float = FACTOR, most_pivots: int = MOST_PIVOTS) -> DataFrame:
    """(a, b, similarity): for each row of ``rows`` (id, q of ``usable``; ids unique) the k most similar other rows.

    Similarity is the cosine rounded to 6 decimals; less than ``least`` does not count, and equal values go to the smaller id.

    * Exact copies: of rows with equal vectors only the k + 1 smallest ids are searched. They are every
      copy's nearest, so the other copies get their k smallest without a search, however many they are.
    * Shards: pivots are drawn from the different vectors by the hash of their id, as many as make shards of about ``shard_rows`` rows; more than
      ``most_pivots``, which is what is broadcast, in two levels. Each row goes to the shards of its ``copies`` nearest
      pivots. Near rows share one of them all but surely. A crowd of alike rows holds as many pivots as it has
      vectors, so it is cut into shards like the rest.
    * Trees: each shard has a vantage-point tree, searched for its own rows. ``factor`` is the share of the triangle
      inequality's bound that a search keeps. 1 is exact: what was found then bounds the search of all shards (``_exact``).
    """
    rows = checkpointed(rows.select("id", "q"), costly=True)
    key = [F.xxhash64("q"), F.xxhash64(F.lit(1), "q")]
    same = Window.partitionBy(*key).orderBy("id")
    first = rows.withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1)
    narrow = rows.select("id", key[0].alias("h1"), key[1].alias("h2"))
    heads = first.where(F.col("r") <= k).groupBy(key[0].alias("h1"), key[1].alias("other")).agg(F.collect_list("id").alias("heads"))
    n = rows.count()
    hot = hot_keys(narrow, "h1", n, HOT_ROWS)
    rest = lookup(narrow.join(first.select("id"), "id", "left_anti"), heads, "h1", hot, "inner").where("h2 = other")
    rest = rest.select(F.col("id").alias("a"), F.explode("heads").alias("b"), F.lit(1.0).alias("similarity"))

    different = first.where("r = 1").select("id", "q")
    wanted = -(-n * copies // shard_rows)
    wanted = 1 if wanted <= copies else wanted
    if wanted <= most_pivots:
        pivots = _drawn(different, wanted, size)
        if not len(pivots):
            return rest
        placed = _placed(first, pivots, copies if wanted > 1 else 1, size)
    else:
        placed = checkpointed(_placed_twice(first.select("id", "q"), wanted, most_pivots, copies, size), costly=True)
    # A task takes its shards one by one, so the session's number of partitions bounds no memory.
    placed = _in_blocks(placed, shard_rows, wanted)

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, s = search_shard(pdf["id"].to_numpy(), _unit(pdf["q"], size), k, least, factor)
        return pd.DataFrame({"a": a, "b": b, "similarity": s})

    found = _best(placed.groupBy("shard", "x", "y").applyInPandas(search, "a bigint, b bigint, similarity double"), k)
    if factor >= 1:
        found = _exact(first.select("id", "q"), found, different, min(most_pivots, wanted), size, k, least, shard_rows)
    return found.unionByName(rest)


def _exact(rows: DataFrame, found: DataFrame, different: DataFrame, wanted: int, size: int, k: int, least: float, shard_rows: int) -> DataFrame:
    """The k nearest of each row, none missed: ``found`` gives a bound for each row, and all shards that it does not rule out are searched.

    Each row is a member of its nearest pivot's shard alone. A shard whose members lie within an angle r of its pivot can hold a match at most
    an angle t away only if the row lies within r + t of the pivot. Members and rows of a shard meet in blocks of bounded size.
    """
    pivots = _drawn(different, wanted, size)
    if not len(pivots):
        return found
    shared = rows.sparkSession.sparkContext.broadcast(pivots)
    home = checkpointed(_placed(rows, pivots, 1, size), costly=True)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = shared.value.astype(np.float32)
        for pdf in batches:
            if len(pdf):
                cosines = (_unit(pdf["q"], size) * p[pdf["shard"].to_numpy()]).sum(1)
                yield pd.DataFrame({"shard": pdf["shard"], "r": np.arccos(np.clip(cosines, -1, 1)).astype(float)})

    # One number a pivot.
    radius = {r["shard"]: r["r"] for r in home.mapInPandas(spread, "shard bigint, r double").groupBy("shard").agg(F.max("r").alias("r")).collect()}
    radii = np.array([radius.get(i, -np.inf) for i in range(len(pivots))])
    kth = found.groupBy(F.col("a").alias("id")).agg(F.when(F.count("*") >= k, F.min("similarity")).alias("kth"))
    bounded = rows.join(kth, "id", "left").select("id", "q", F.coalesce("kth", F.lit(least)).alias("kth"))

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = shared.value.astype(np.float32)
        for pdf in batches:
            for i in range(0, len(pdf), 256):
                part = pdf.iloc[i : i + 256]
                angle = np.arccos(np.clip(_unit(part["q"], size) @ p.T, -1, 1))
                a, shard = np.nonzero(angle <= radii + np.arccos(np.clip(part["kth"].to_numpy() - 1e-5, -1, 1))[:, None] + 2e-3)
                yield pd.DataFrame({"shard": shard.astype(np.int64), "id": part["id"].to_numpy()[a], "q": part["q"].to_numpy()[a]})

    members = home.groupBy("shard").agg(F.ceil(F.count("*") / (4 * shard_rows)).alias("m"))
    asking = bounded.mapInPandas(reach, "shard bigint, id bigint, q binary").join(members, "shard")
    own = lambda n: F.pmod(F.xxhash64("id"), n)
    asking = asking.withColumn("x", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1))).withColumn("y", own(F.lit(PARTS))).drop("m")
    there = home.join(members, "shard").withColumn("x", own(F.col("m"))).withColumn("y", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(PARTS - 1).cast("bigint")))).drop("m")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": [], "similarity": []})
        a, b, v, out = left["id"].to_numpy(), right["id"].to_numpy(), _unit(right["q"], size).T, []
        order = np.argsort(b, kind="stable")
        for i in range(0, len(a), 512):
            s = np.round((_unit(left["q"].iloc[i : i + 512], size) @ v)[:, order].astype(np.float64), 6)
            s[a[i : i + 512, None] == b[order][None]] = -2
            best = np.argsort(-s, 1, kind="stable")[:, :k]
            sims = np.take_along_axis(s, best, 1)
            x, y = np.nonzero(sims >= least)
            out.append(pd.DataFrame({"a": a[i : i + 512][x], "b": b[order][best[x, y]], "similarity": sims[x, y]}))
        return pd.concat(out)

    more = asking.groupBy("shard", "x", "y").cogroup(there.groupBy("shard", "x", "y")).applyInPandas(meet, "a bigint, b bigint, similarity double")
    return _best(more.unionByName(found), k)


def pairs(found: DataFrame) -> DataFrame:
    """(a_id, b_id), the smaller first: pairs of which at least one is among the other's nearest."""
    return found.select(F.least("a", "b").alias("a_id"), F.greatest("a", "b").alias("b_id")).distinct()
