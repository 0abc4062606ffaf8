"""Groups of texts at a Jaccard similarity of shingle sets, found by the SimHash index and by MinHash bands, and checked exactly.

Texts of equal sets are one node. The Gray-order index links nodes whose SimHashes differ in a few bits; these are nearly equal sets. Less similar ones
differ in more bits than that index can search, so nodes that agree in a whole band of minima also meet in a bucket. Pairs met either way are linked only
if their sets, which are compared whole, are similar enough. Small buckets give all their pairs. Of a large one all members are paired with ``HUBS`` of them, the same in
every bucket where they are, and what then is in different groups is paired across these; so members already in one group are not compared, and many near copies of a text are no large job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows, hot_join, hot_split, slices, stored, text_bytes
from tidemark.llm.components import components
from tidemark.llm.simhash import keep_least, links as index_links, shingle_hashes, simhash

#: At a similarity of 0.8 all bands differ with chance (1 - 0.8 ** ROWS) ** BANDS = 0.0004, at 0.9 below 1e-7.
BANDS, ROWS, HUBS = 20, 5, 4


def min_hashes(hashes: np.ndarray, starts: np.ndarray, seed: int) -> np.ndarray:
    """BANDS * ROWS minima for each of the lists of hashes (none is empty) that begin at ``starts``."""
    rng = np.random.default_rng(seed)
    odd, add = (rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64) for _ in range(2))
    return np.stack([np.minimum.reduceat(hashes * (m | np.uint64(1)) + a, starts) for m, a in zip(odd, add)], axis=1)


def shingle_sets(docs: DataFrame, words: int = 5, seed: int = 42) -> DataFrame:
    """doc_id (long), node (hash of the whole set; 0: no words), fp (its SimHash), shingles (the set) and bands of every row of ``docs`` (doc_id, text)."""
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = text_bytes(batch.column(1))
            for lo, hi in slices(at):
                sets = [np.unique(np.array(shingle_hashes(raw[at[k] : at[k + 1]].tobytes(), words, seed), np.uint64)) for k in range(lo, hi)]
                counts = np.array([len(s) for s in sets])
                flat, some = np.concatenate(sets), np.flatnonzero(counts)
                nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), seed) if len(s) else 0 for s in sets], np.uint64)
                prints = simhash(flat, counts)
                keys = np.zeros((0, BANDS), np.uint64)
                if len(some):
                    least = min_hashes(flat, (np.cumsum(counts) - counts)[some], seed).reshape(len(some), BANDS, ROWS)
                    keys = np.array([[xxhash.xxh64_intdigest(m.tobytes(), b) for b, m in enumerate(row)] for row in least], np.uint64)
                lists = [
                    pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), pa.array(values.view(np.int64)))
                    for n, values in ((counts, flat), (np.where(counts > 0, BANDS, 0), keys.reshape(-1)))
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(nodes.view(np.int64)), pa.array(prints.view(np.int64)), *lists], ["doc_id", "node", "fp", "shingles", "bands"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, node long, fp long, shingles array<long>, bands array<long>")


def _similar(pairs: DataFrame, whole: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) of nodes whose sets (``whole``: node, shingles) have a Jaccard similarity of ``least`` or more."""
    pairs = stored(pairs.distinct(), "pairs")
    a, b = (whole.select(F.col("node").alias(k), F.col("shingles").alias(f"of_{k}")) for k in ("u", "v"))
    both = F.size(F.array_intersect("of_u", "of_v"))
    return stored(pairs.join(a, "u").join(b, "v").filter(both >= least * (F.size("of_u") + F.size("of_v") - both) - 1e-9).select("u", "v"), "similar")


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def _by_index(nodes: DataFrame, most: int) -> DataFrame:
    """u, v: nodes (columns node, fp) that the Gray-order index links, each fingerprint standing for its least node, and other nodes with that one."""
    firsts = stored(nodes.groupBy("fp").agg(F.min("node").alias("first")), "set-fingerprints")
    same = nodes.join(firsts, "fp").filter("node <> first").select(*_ordered("node", "first"))
    a, b = (firsts.select(F.col("fp").alias(k), F.col("first").alias(f"of_{k}")) for k in ("u", "v"))
    return same.union(index_links(firsts.select("fp"), most).join(a, "u").join(b, "v").select(*_ordered("of_u", "of_v")))


def _across(apart: DataFrame, whole: DataFrame, least: float, nodes: int = 2048, shingles: int = 4 << 20) -> DataFrame:
    """u, v: links of similar sets in one band whose nodes (``apart``: band, node, root) are in different groups, for each node one to each other group at most in a block.

    A band is cut into blocks of about ``nodes`` nodes and ``shingles`` shingles, and each two blocks meet in a task; pairs are compared there by counts of
    common shingles, so what is shuffled are sets, a copy for each block of their band, and never pairs.
    """
    rows = apart.join(whole, "node")
    cut = rows.groupBy("band").agg(F.ceil(F.greatest(F.count("*") / nodes, F.sum(F.size("shingles")) / shingles)).cast("int").alias("parts"))
    rows = rows.join(cut, "band").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("band", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "root", "shingles")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(table: pa.Table) -> pa.RecordBatch:
            own, node, root = (table.column(k).to_numpy() for k in (3, 4, 5))
            sets = table.column(6).combine_chunks()
            sizes = np.diff(sets.offsets.to_numpy().astype(np.int64))
            _, shingle = np.unique(sets.flatten().to_numpy(), return_inverse=True)
            holder, ends = np.repeat(np.arange(len(node)), sizes), np.cumsum(sizes)
            order = np.argsort(shingle, kind="stable")
            many = np.bincount(shingle)
            first, holder = np.cumsum(many) - many, holder[order]
            split, u, v = table.column(1)[0].as_py() != table.column(2)[0].as_py(), [], []
            for k in range(len(node)):
                mine = shingle[ends[k] - sizes[k] : ends[k]]
                n = many[mine]
                at = np.repeat(first[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                both = np.bincount(holder[at], minlength=len(node))
                near = (both >= least * (sizes[k] + sizes - both) - 1e-9) & (root > root[k])
                near = np.flatnonzero(near & (own != own[k]) if split else near)
                if len(near):
                    _, one = np.unique(root[near], return_index=True)
                    u += [node[k]] * len(one)
                    v += node[near[one]].tolist()
            a, b = np.array(u, np.int64), np.array(v, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["u", "v"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch])
            group = np.stack([table.column(k).to_numpy() for k in range(3)])
            starts = [0, *(np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1).tolist()]
            for a, b in zip(starts, starts[1:]):
                yield found(table.slice(a, b - a).combine_chunks())
            held = table.slice(starts[-1]).to_batches()
        if held:
            yield found(pa.Table.from_batches(held).combine_chunks())

    keys = ("band", "lo", "hi")
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(search, "u long, v long").distinct()


def similar_groups(docs: DataFrame, words: int = 5, least: float = 0.8, small: int = 16, most: int = 3) -> DataFrame:
    """doc_id, component_id: the smallest doc_id that links of similar texts reach, its own included; rows and null ids as in ``simhash.near_duplicates``.

    Texts without words are one group. ``most``: bits that the SimHashes of indexed links may differ in.
    """
    no_id = F.lit(-(1 << 63))
    sets = stored(shingle_sets(docs, words).drop("shingles"), "shingle-bands")
    nodes = stored(sets.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "shingle-nodes")
    indexed = stored(_by_index(nodes.filter("node <> 0").select("node", "fp"), most), "index-links")
    members = nodes.select("node", F.explode("bands").alias("band"))
    sizes = members.groupBy("band").count().filter("count > 1")
    members = stored(members.join(sizes, "band"), "band-members")
    # the sets of nodes that meet others, each from one of its texts
    meeting = members.select("node").union(indexed.select("u")).union(indexed.select("v")).distinct()
    met = nodes.join(meeting, "node").select(F.coalesce("least", no_id).alias("key"), F.col("node").alias("own"))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), no_id).alias("key"), "text").join(met.select("key").distinct(), "key", "left_semi")
    again = shingle_sets(texts.withColumnRenamed("key", "doc_id"), words).select(F.col("doc_id").alias("key"), "node", "shingles")
    again = again.join(met, (again["key"] == met["key"]) & (again["node"] == met["own"]), "left_semi")
    whole = stored(again.groupBy("node").agg(F.first("shingles").alias("shingles")), "met-sets")
    lists = members.filter(F.col("count") <= small).groupBy("band").agg(F.sort_array(F.collect_list("node")).alias("ns"))
    pairs = lists.select(F.expr("explode(flatten(transform(ns, (a, i) -> transform(slice(ns, i + 2, size(ns)), b -> struct(a AS u, b AS v)))))").alias("p")).select("p.*")
    large = members.filter(F.col("count") > small).select("band", "node")
    least_of = large.groupBy("band").agg(F.array(*[F.min(F.struct(F.xxhash64("node", F.lit(k)), "node"))["node"] for k in range(HUBS)]).alias("hubs"))
    hubs = large.join(least_of.select("band", F.explode("hubs").alias("hub")), "band").filter("node <> hub").select(*_ordered("node", "hub"))
    links = _similar(indexed.union(pairs).union(hubs), whole, least)
    groups = components(links)
    named = large.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = named.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("band")
    apart = stored(named.join(apart, "band"), "large-bands")
    if not apart.isEmpty():
        groups = components(links.union(stored(_across(apart, whole, least), "similar-across")))
    tied = nodes.select("node", "least", "copies").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    roots = tied.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("weight"))
    named = stored(hot_join(tied, *hot_split(stored(roots, "set-roots"), "weight"), "root").select("node", "component_id", "copies"), "set-groups")
    return hot_join(sets.select("doc_id", "node"), *hot_split(named, "copies"), "node").select("doc_id", "component_id")


def keep_one_similar(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """One document of each group of similar texts, that of the smallest doc_id; columns as in ``docs``."""
    return keep_least(docs, similar_groups(docs.select("doc_id", "text"), words, least))
