"""Embedding near-duplicates: binary codes of randomly rotated vectors decide which pairs are recomputed exactly.

Equal vectors are one node. A node's unit vector is rotated at random; the signs of its coordinates are its code, and the inner product of the code
(as a unit vector) with what it stands for is stored as correction factor. The code's inner product with another rotated vector, divided by the factor, then
estimates the vectors' cosine without bias, with an error of deviation sqrt((1 - factor**2) / factor**2 * (1 - cosine**2) / (bits - 1)). Pairs whose estimate
is below the wanted cosine by more than ``SIGMAS`` deviations are dropped, and all others are recomputed in double precision.

Pairs are searched where they meet: in a table, a vector's cell is its largest coordinate and that one's sign in each of some further rotations. How many (the level)
is chosen once for all vectors of a length, by the work that it makes; a higher level has more tables, so that a pair at 0.95 is missed with a chance of
``MISSED`` at any level, and at level 0 all vectors share one cell. No cell is ever divided: the pairs of one with more than ``bucket`` nodes are
all searched, block against block. A pair counts in the first table in which it meets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import arrow_rows, hot_join, hot_split, stored
from tidemark.llm.components import components
from tidemark.llm.simhash import least_labels

LEVELS, CELL_BITS = 3, 12
#: The chance that a pair at a cosine of 0.95 shares a cell of one rotation, for lengths up to 64, 128, 512 and above (measured, rounded down), and that it meets in no table.
SHARED, MISSED = ((64, 0.59), (128, 0.56), (512, 0.51), (1 << 62, 0.46)), 2e-5
SIGMAS = 5.0
_LEAST_BITS, _MOST_CELLS = 128, 1 << (CELL_BITS - 1)


def rotated(x: np.ndarray, seed: int, bits: int) -> np.ndarray:
    """Rows of ``x``, filled up with zeros to ``bits`` (a power of two), under a random rotation: three rounds of random signs and a Hadamard transform."""
    rng = np.random.default_rng(seed)
    y = np.zeros((len(x), bits))
    y[:, : x.shape[1]] = x
    for _ in range(3):
        y *= rng.choice([-1.0, 1.0], bits)
        half = 1
        while half < bits:
            pairs = y.reshape(len(x), bits // (2 * half), 2, half)
            y = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), bits)
            half *= 2
        y /= np.sqrt(bits)
    return y


def _power(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def code_bits(dim: int) -> int:
    return max(_LEAST_BITS, _power(dim))


def codes(unit: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated vectors, their codes (a bit for each sign, packed in bytes) and correction factors."""
    turned = rotated(unit, seed, code_bits(unit.shape[1]))
    return turned, np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])


def tables(dim: int, level: int) -> int:
    """Tables that keep the chance to miss a pair at 0.95 at ``MISSED``."""
    shared = next(p for most, p in SHARED if dim <= most) ** level
    return 1 if level == 0 else math.ceil(math.log(MISSED) / math.log1p(-shared))


def cells(unit: np.ndarray, seed: int, levels: int = LEVELS) -> np.ndarray:
    """Cell numbers of a table's first ``levels`` rotations, packed into one long each."""
    out = np.zeros(len(unit), np.int64)
    for level in range(levels):
        turned = rotated(unit, seed * LEVELS + level + 2, _power(unit.shape[1]))[:, :_MOST_CELLS]
        at = np.abs(turned).argmax(axis=1)
        out |= (2 * at + (turned[np.arange(len(at)), at] > 0)) << (CELL_BITS * level)
    return out


def units(raw: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors in double precision, of rows of equal length."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def near_pairs(unit: np.ndarray, code: np.ndarray, factor: np.ndarray, least: float, apart: np.ndarray | None = None, step: int = 1024, exact: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places i < j whose cosine is ``least`` or more (with ``apart``: and whose values there differ), a block of i at a time.

    With ``exact`` only pairs are dropped whose estimate proves a lesser cosine: what a vector has outside of its code adds at most sqrt(1 - cosine**2) times that part's length.
    """
    bits = 8 * code.shape[1]
    turned = rotated(unit, 1, bits).astype(np.float32)
    signs = (2.0 * np.unpackbits(code, axis=1) - 1).astype(np.float32) / np.float32(np.sqrt(bits))
    slack = (1.0 if exact else SIGMAS / np.sqrt(bits - 1)) * np.sqrt(np.maximum(0, 1 - factor**2) / factor**2 * (1 - least**2)) + 1e-4
    for lo in range(0, len(unit), step):
        estimate = turned[lo : lo + step] @ signs[lo:].T / factor[lo:]
        i, j = np.nonzero(estimate >= least - slack[lo:])
        later = j > i
        i, j = i[later] + lo, j[later] + lo
        if apart is not None:
            keep = apart[i] != apart[j]
            i, j = i[keep], j[keep]
        for at in range(0, len(i), 1 << 18):
            a, b = i[at : at + (1 << 18)], j[at : at + (1 << 18)]
            near = np.einsum("ij,ij->i", unit[a], unit[b]) >= least
            yield a[near], b[near]


def _vectors(rows: DataFrame, key: str, column: str, kind: str) -> DataFrame:
    """vec_id and vec: the numbers' bytes, or null where the vector can link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(1):
                x = None if v.values is None or v.values.null_count else v.values.to_numpy(zero_copy_only=False).astype(kind) + 0.0  # one zero
                out.append(x.astype(kind).tobytes() if x is not None and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "vec"])

    return rows.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{column}`").alias("vec")).mapInArrow(run, "vec_id long, vec binary")


def _by_length(batch: pa.RecordBatch, kind: str) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """dim, places and unit vectors, for each length in a batch of node, n, dim, vec."""
    raw, dims = batch.column(3).to_pylist(), batch.column(2).to_numpy()
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        yield int(dim), pa.array(at), units([raw[k] for k in at], kind)


def _levels(nodes: DataFrame, kind: str, bucket: int) -> dict[int, int]:
    """The level of each length that more than ``bucket`` nodes have (1 for the others): what costs least, by the cells of one table.

    A node costs what its cell holds, and ``bucket`` more for being sent there, in each of the level's tables.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, unit in _by_length(batch, kind):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), dim, np.int32)), pa.array(cells(unit, 0))], ["dim", "cell"])

    rows = nodes.select("node", "n", "dim", "vec").mapInArrow(run, "dim int, cell long").select("dim", "cell", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("level"))
    key = F.expr(f"cell & (shiftleft(1L, {CELL_BITS} * level) - 1)").alias("key")
    sizes = rows.groupBy("dim", "level", key).agg(F.count("*").alias("size")).groupBy("dim", "level").agg(F.sum("size").alias("all"), F.sum(F.col("size").cast("double") * (F.col("size") + bucket)).alias("work"))
    costs: dict[int, list[tuple[float, int]]] = {}
    for dim, level, work in sizes.filter(F.col("all") > bucket).select("dim", "level", "work").collect():
        costs.setdefault(dim, []).append((tables(dim, level) * work, level))
    return {dim: min(some)[1] for dim, some in costs.items()}


def _coded(nodes: DataFrame, kind: str, levels: dict[int, int], usual: int = 1) -> DataFrame:
    """node, n, dim, vec, code, factor and cells (one long for each table) of each distinct vector; ``usual``: the level of lengths without one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, unit in _by_length(batch, kind):
                _, code, factor = codes(unit)
                level = levels.get(dim, usual)
                number = tables(dim, level)
                table = np.stack([cells(unit, t, level) for t in range(number)], axis=1)
                lists = pa.ListArray.from_arrays(np.arange(0, table.size + 1, number, dtype=np.int32), pa.array(table.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(factor), lists], ["node", "n", "dim", "vec", "code", "factor", "cells"])

    return nodes.select("node", "n", "dim", "vec").mapInArrow(run, "node long, n long, dim int, vec binary, code binary, factor double, cells array<long>")


def _cuts(coded: DataFrame, bucket: int) -> DataFrame:
    """node and cuts: the tables (tab) where a node is not alone in its cell, and the blocks (cut) that the cell is searched in."""
    rows = coded.select("node", "dim", F.posexplode("cells").alias("tab", "key"))
    sizes = stored(rows.groupBy("dim", "tab", "key").agg(F.count("*").alias("size")).filter("size > 1"), "cells")
    met = hot_join(rows, *hot_split(sizes.withColumn("weight", F.col("size")), "weight"), ["dim", "tab", "key"])
    return met.groupBy("node").agg(F.collect_list(F.struct("tab", F.ceil(F.col("size") / bucket).cast("int").alias("cut"))).alias("cuts"))


def links(nodes: DataFrame, kind: str, least: float = 0.95, bucket: int = 2048, exact: bool = False) -> DataFrame:
    """node, root, links: for nodes that have links in a cell, their number there (copies counted, each pair in one cell only) and the least node that they reach there."""
    coded = stored(_coded(nodes, kind, {}, 0) if exact else _coded(nodes, kind, _levels(nodes, kind, bucket)), "vector-codes")
    probes = coded.join(_cuts(coded, bucket), "node").select("*", F.explode("cuts").alias("at")).select("*", "at.*")
    probes = probes.withColumn("block", F.pmod(F.xxhash64("node"), F.col("cut")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
    keys = ["dim", "tab", "key", "lo", "hi"]
    probes = probes.select("dim", "tab", F.element_at("cells", F.col("tab") + 1).alias("key"), F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "n", "factor", "code", "vec", F.slice("cells", F.lit(1), F.col("tab")).alias("keys"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(table: pa.Table) -> pa.RecordBatch:
            dim, tab, _, lo, hi = (table.column(k)[0].as_py() for k in range(5))
            block, node, n, factor = (table.column(k).to_numpy() for k in range(5, 9))
            code, vec = (table.column(k).to_pylist() for k in (9, 10))
            before = np.array(table.column(11).combine_chunks().flatten()).reshape(table.num_rows, tab)
            order = np.argsort(node, kind="stable")
            block, node, n, factor, before = block[order], node[order], n[order], factor[order], before[order]
            unit, code = units([vec[k] for k in order], kind), np.frombuffer(b"".join(code[k] for k in order), np.uint8).reshape(len(order), -1)
            count, labels = np.zeros(len(node), np.int64), np.arange(len(node))
            for i, j in near_pairs(unit, code, factor, least, block if lo != hi else None, exact=exact):
                new = ~(before[i] == before[j]).any(axis=1)
                i, j = i[new], j[new]
                np.add.at(count, i, n[j])
                np.add.at(count, j, n[i])
                labels = least_labels(labels, i, j)
            some = np.flatnonzero(count)
            return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[labels[some]]), pa.array(count[some])], ["node", "root", "links"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch])
            group = np.stack([table.column(k).to_numpy() for k in range(5)])
            starts = [0, *(np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1).tolist()]
            for a, b in zip(starts, starts[1:]):
                if b - a > 1:
                    yield found(table.slice(a, b - a))
            held = table.slice(starts[-1]).to_batches()
        if held:
            yield found(pa.Table.from_batches(held))

    return probes.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(search, "node long, root long, links long")


def near_vectors(rows: DataFrame, key: str = "vec_id", column: str = "embedding", least: float = 0.95, bucket: int = 2048, exact: bool = False) -> DataFrame:
    """vec_id (long), n_links (long), component_id (long), kept (boolean) of every row.

    Links are the other rows whose vectors have a cosine of ``least`` or more; component_id is the smallest vec_id reachable, its own included. Vectors that are
    null, empty or zero, or have a null or a number that is not finite, link with nothing, and vectors of different lengths not with each other. Rows that repeat a
    vec_id are vectors of their own that share a name; a null vec_id is a component's id only if it has no other, and null <=> null is kept. Further columns, whatever
    their names, are not read. An empty table gives no rows. Nothing is capped: no pair below ``least`` is given, and one at 0.95 or more is missed with a chance of ``MISSED``
    at most, however many vectors there are and however many share a cell; below a ``least`` of 0.95 that grows. With ``exact`` all pairs of distinct vectors are
    searched, block against block, and none is missed: the work grows with their square, memory does not.
    """
    arrow_rows(rows.sparkSession, 2048)
    kind = "<f4" if isinstance(rows.schema[column].dataType.elementType, T.FloatType) else "<f8"
    vectors = _vectors(rows, key, column, kind)
    distinct = vectors.filter("vec IS NOT NULL").groupBy("vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    width = np.dtype(kind).itemsize
    nodes = stored(distinct.select(F.monotonically_increasing_id().alias("node"), "least", "n", F.expr(f"cast(octet_length(vec) div {width} as int)").alias("dim"), "vec"), "vectors")
    found = stored(links(nodes, kind, least, bucket, exact).groupBy("node", "root").agg(F.sum("links").alias("links")), "vector-links")
    ties = components(found.filter("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    tied = stored(nodes.select("node", "least").join(ties, "node", "left").withColumn("root", F.coalesce("root", "node")), "vector-roots")
    named = tied.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("weight"))
    named = hot_join(tied.select("node", "root"), *hot_split(named, "weight"), "root")
    facts = nodes.select("node", "vec", "n").join(named, "node").join(counts, "node", "left").select("vec", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.col("n").alias("weight"))
    known = hot_join(vectors.filter("vec IS NOT NULL"), *hot_split(stored(facts, "vector-facts"), "weight"), "vec").select("vec_id", "n_links", "component_id")
    alone = vectors.filter("vec IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.union(alone).withColumn("kept", F.expr("vec_id <=> component_id"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
