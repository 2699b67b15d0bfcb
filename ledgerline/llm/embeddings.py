"""Embedding near-dedup: tiles of vectors in principal-component order, compared a few dimensions at a time.

Vectors with equal labels and equal numbers of components are compared by cosine. Equal vectors form a class, and one of
each class is compared. The principal components come from sums of products gathered on Spark. A vector lies in a cell of
the grid on its leading components, as wide as the largest distance that a link allows, so links join neighbouring cells
only; a cell's vectors are dealt into tiles. In a pair of tiles, products of the leading components are taken first;
pairs whose product cannot reach the threshold by the norms of what follows are dropped, and the rest go on. What is left
is confirmed by the cosine of the vectors themselves.

Tiles of neighbouring cells meet in squares of a bounded number of tiles, so a cell may hold any share of the vectors: its
tiles are copied to as many squares as the other side has groups, and each square is a key of its own.

A pair of tiles returns a row for each linked vector: how many others it links with there, and the least vector of its
part of the links. These suffice for counts and components, and their number does not grow with the square of a group.

Defined cases: vectors that are null, zero, or have null or non-finite components, and those without label or vec_id,
link with nothing; repeated vectors link with each other; rows that repeat a vec_id are each a vector and share its
component; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import dropped, small_batches, written
from ledgerline.llm.components import connected_components

THRESHOLD = 0.98
GRID = 3  # leading components of the grid
TILE = 512
SQUARE = 16  # tiles of each side that meet under one key
STEP = 16


def _rows(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<f8").reshape(len(blobs), -1)


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Axes by number of components, leading first, from the second moments of the unit vectors."""

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                x = _rows(part["x"].tolist())
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                x = np.hstack([x, np.ones((len(x), 1))])
                sums[dim] = sums.get(dim, 0) + x.T @ x
        yield pd.DataFrame({"dim": list(sums), "sums": [s.tobytes() for s in sums.values()]})

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, s in zip(batch["dim"], batch["sums"], strict=True):
                sums[dim] = sums.get(dim, 0) + np.frombuffer(s, "<f8")
        yield pd.DataFrame({"dim": list(sums), "sums": [s.tobytes() for s in sums.values()]})

    # a matrix of dim x dim from each task, and of their sums a few to the driver, however many vectors there are
    parts = vectors.select("dim", "x").mapInPandas(moments, "dim int, sums binary").repartition(16).mapInPandas(summed, "dim int, sums binary")
    total = {}
    for dim, s in next(summed(iter([parts.toPandas()]))).itertuples(index=False, name=None):
        total[dim] = np.frombuffer(s, "<f8").reshape(dim + 1, dim + 1)
    axes = {}
    for dim, s in total.items():
        mean = s[-1, :-1] / s[-1, -1]
        _, found = np.linalg.eigh(s[:-1, :-1] / s[-1, -1] - np.outer(mean, mean))
        axes[dim] = found[:, ::-1].round(12)
    return axes


def tile_links(ax: np.ndarray, bx: np.ndarray, axes: np.ndarray, threshold: float, same: bool, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked pairs of two tiles (i < j where they are the same tile)."""
    a = ax / np.linalg.norm(ax, axis=1, keepdims=True)
    b = bx / np.linalg.norm(bx, axis=1, keepdims=True)
    pa, pb, dim = a @ axes, b @ axes, a.shape[1]
    low = threshold - 1e-9
    k = min(step, dim)
    rest = lambda p, k: np.sqrt(np.maximum((p[:, k:] ** 2).sum(axis=1), 0))
    bound = pa[:, :k] @ pb[:, :k].T
    part = bound + np.outer(rest(pa, k), rest(pb, k))
    if same:
        part = np.triu(part, 1) - np.tril(np.full_like(part, 2.0))
    i, j = np.nonzero(part >= low)
    products = bound[i, j]
    while k < dim and len(i):
        more = min(k + step, dim)
        products = products + np.einsum("ij,ij->i", pa[i, k:more], pb[j, k:more])
        k = more
        keep = products + rest(pa, k)[i] * rest(pb, k)[j] >= low
        i, j, products = i[keep], j[keep], products[keep]
    found = [np.einsum("ij,ij->i", a[i[s : s + 65536]], b[j[s : s + 65536]]) >= threshold for s in range(0, len(i), 65536)]
    sure = np.concatenate(found) if found else np.zeros(0, bool)
    return i[sure], j[sure]


def _least_of_parts(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least position of each position's part of the links."""
    least = np.arange(n)
    while True:
        before = least.copy()
        m = np.minimum(least[i], least[j])
        np.minimum.at(least, i, m)
        np.minimum.at(least, j, m)
        least = least[least]
        if (least == before).all():
            return least


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD, grid: int = GRID, tile: int = TILE, square: int = SQUARE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    spark = df.sparkSession
    x = F.col("e")
    rows = df.select(df[vec_id].cast("long").alias("id"), df[label].cast("string").alias("label"), df[embedding].cast("array<double>").alias("e"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    good = F.col("id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~bad & F.exists(x, lambda c: c != 0)
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))

    def packed(vectors: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else (np.asarray(v, "<f8") + 0.0).tobytes() for v in vectors], dtype=object)

    blob = F.pandas_udf(packed, "binary")(F.when(F.col("good"), x))
    rows = rows.select("id", "label", "good", F.when(F.col("good"), F.size(x)).alias("dim"), blob.alias("x"))
    rows = rows.withColumn("hash", F.sha2("x", 256))
    # equal vectors of a label are a class with a number of its own: an id may stand for several vectors
    classes = rows.filter("good").groupBy("label", "dim", "hash").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("size"), F.min("x").alias("x"))
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()), "vectors")
    axes = spark.sparkContext.broadcast(principal_axes(classes))
    width = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9

    def cells(dims: pd.Series, vectors: pd.Series) -> pd.Series:
        out = []
        for dim, v in zip(dims, vectors, strict=True):
            y = np.frombuffer(v, "<f8")
            out.append(np.floor((y / np.linalg.norm(y)) @ axes.value[dim][:, :grid] / width).astype(np.int32).tolist() + [0] * max(0, grid - dim))
        return pd.Series(out, dtype=object)

    placed = classes.select("label", "dim", "id", "size", "x", F.pandas_udf(cells, "array<int>")("dim", "x").alias("cell"))
    placed = written(placed, "cells")
    crowd = placed.groupBy("label", "dim", "cell").agg(F.ceil(F.count(F.lit(1)) / tile).alias("tiles"))
    dealt = placed.join(crowd, ["label", "dim", "cell"]).withColumn("tile", F.pmod(F.xxhash64("id", "x"), F.col("tiles")))
    # tiles hold about `tile` vectors each, however many a cell has
    tiles = dealt.groupBy("label", "dim", "cell", "tile").agg(F.collect_list(F.struct("id", "size", "x")).alias("v"))
    tiles = written(tiles.withColumn("tile", F.struct("cell", "tile")), "tiles")
    pairs = _meetings(tiles, crowd, grid, square)
    pairs = pairs.select("dim", (F.col("t1") == F.col("t2")).alias("same"), *[F.col(f"{v}.{c}").alias(f"{c}{k}") for k, v in enumerate(("v1", "v2")) for c in ("id", "size", "x")])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p in batch.itertuples():
                a, b = _rows(list(p.x0)), _rows(list(p.x1))
                i, j = tile_links(a, b, axes.value[p.dim], threshold, p.same)
                if not len(i):
                    continue
                ids = np.concatenate([p.id0, p.id0[:0] if p.same else p.id1])
                sizes = np.concatenate([p.size0, p.size0[:0] if p.same else p.size1])
                if not p.same:
                    j = j + len(a)
                links = np.bincount(i, sizes[j], len(ids)) + np.bincount(j, sizes[i], len(ids))
                least = _least_of_parts(len(ids), i, j)
                at = np.unique(np.concatenate([i, j]))
                yield pd.DataFrame({"id": ids[at], "links": links[at].astype(np.int64), "hub": ids[least[at]]})

    # a row holds two tiles: a few to a batch keep the workers small
    with small_batches(spark, 8):
        found = written(pairs.mapInPandas(compare, "id long, links long, hub long"), "found")
    dropped(tiles)
    counts = found.groupBy(F.col("id").alias("class")).agg(F.sum("links").alias("links"))
    nodes = connected_components(found.select(F.col("id").alias("u"), F.col("hub").alias("v")).unionByName(_shared_ids(rows, classes)))
    numbered = classes.select("label", "dim", "hash", F.col("id").alias("class"), "least", "size").join(counts, "class", "left").join(nodes.select(F.col("node").alias("class"), F.col("component").alias("root")), "class", "left")
    numbered = numbered.withColumn("root", F.coalesce("root", "class"))
    roots = numbered.groupBy("root").agg(F.min("least").alias("component"))
    out = rows.filter("good").select("id", "label", "dim", "hash").join(numbered.join(roots, "root").drop("least"), ["label", "dim", "hash"])
    component, links = F.col("component"), F.col("size") - 1 + F.coalesce("links", F.lit(0))
    linked = out.select(F.col("id").alias("vec_id"), links.cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
    alone = rows.filter("NOT good").select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionByName(alone)


def _shared_ids(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Classes that share an id are one component, since components are of ids: (u, v) with the least such class."""
    good = rows.filter("good").select("id", "label", "dim", "hash")
    repeated = good.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id")
    held = good.join(repeated, "id", "left_semi").join(classes.select("label", "dim", "hash", F.col("id").alias("class")), ["label", "dim", "hash"]).select("id", "class").distinct()
    return held.join(held.groupBy("id").agg(F.min("class").alias("v")), "id").filter("class <> v").select(F.col("class").alias("u"), "v")


def _meetings(tiles: DataFrame, crowd: DataFrame, grid: int, square: int) -> DataFrame:
    """Pairs of tiles of the same or of neighbouring cells, each once, with both tiles' vectors (v1, v2)."""
    cells = crowd.select("label", "dim", "cell", F.ceil(F.col("tiles") / square).alias("groups"))
    ahead = [s for s in itertools.product((-1, 0, 1), repeat=grid) if s >= (0,) * grid]
    shifts = F.array(*[F.array(*[F.lit(c) for c in s]) for s in ahead])
    to = F.explode(F.transform(shifts, lambda s: F.zip_with("cell", s, lambda a, b: a + b)))
    routes = cells.select("label", "dim", F.col("cell").alias("from"), F.col("groups").alias("gl"), to.alias("cell")).join(cells, ["label", "dim", "cell"])
    # at most half of the neighbours for each cell, and one row for each cell that is met
    outward = routes.groupBy("label", "dim", F.col("from").alias("cell")).agg(F.collect_list(F.struct(F.col("cell").alias("to"), F.col("groups").alias("gr"))).alias("routes"))
    inward = routes.groupBy("label", "dim", "cell").agg(F.max("gl").alias("gl"))
    group = F.floor(F.col("tile.tile") / square)
    count = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = tiles.join(outward, ["label", "dim", "cell"]).select("label", "dim", F.col("tile").alias("t1"), F.col("v").alias("v1"), group.alias("l"), F.inline("routes"))
    left = left.select("label", "dim", "t1", "v1", F.col("to").alias("cell"), "l", count("gr").alias("r"))
    right = tiles.join(inward, ["label", "dim", "cell"]).select("label", "dim", F.col("tile").alias("t2"), F.col("v").alias("v2"), "cell", group.alias("r"), count("gl").alias("l"))
    return left.join(right, ["label", "dim", "cell", "l", "r"]).filter((F.col("t1.cell") != F.col("t2.cell")) | (F.col("t1") <= F.col("t2")))
