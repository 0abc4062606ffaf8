"""SimHash near-duplicates, found with a hierarchical index over fingerprints in Gray order.

Fingerprints that link at d or fewer of 64 bits agree in at least one of d + 1 parts, so they meet in a bucket of (part, value). A bucket of
more than ``bucket`` fingerprints is dealt again by parts of its other bits; after a few rounds so few bits are free that no bucket can be
large. Inside a bucket fingerprints are sorted by Gray rank; neighbours then agree in most bits, and each node of the index holds the bits
that all below it share and its parent doesn't hold. A search adds up differences on its way down and drops a whole node beyond d.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import arrow_rows, fresh, slices, stored, text_bytes
from tidemark.llm.components import components

FANOUT = 8
QUERIES = 1024


def simhash(shingle_hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of texts with ``counts`` hashes each, in order: a bit is 1 if set in over half of them; no hash: zero."""
    out = np.zeros(len(counts), np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    ends = np.cumsum(counts)
    for k, (end, n) in enumerate(zip(ends, counts)):
        if n:
            ones = np.zeros(64, np.int64)
            for at in range(end - n, end, 1 << 16):
                part = shingle_hashes[at : min(end, at + (1 << 16))]
                ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
            out[k] = np.bitwise_or.reduce(weights[2 * ones > n], initial=np.uint64(0))
    return out


def shingle_hashes(text: bytes, words: int, seed: int) -> list[int]:
    low = text.lower().split()
    if len(low) <= words:
        return [xxhash.xxh64_intdigest(b" ".join(low), seed)] if low else []
    return [xxhash.xxh64_intdigest(b" ".join(t), seed) for t in zip(*(low[k:] for k in range(words)))]


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, keep: tuple[str, ...] = ("doc_id",), out: str = "fp") -> DataFrame:
    """Columns ``keep`` and the SimHash (long) of every whole text over shingles of ``words`` words, repeats included."""
    arrow_rows(docs.sparkSession)
    schema = docs.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = text_bytes(batch.column(len(keep)))
            prints = []
            for lo, hi in slices(at):
                lists = [shingle_hashes(raw[at[k] : at[k + 1]].tobytes(), words, seed) for k in range(lo, hi)]
                counts = np.array([len(x) for x in lists])
                prints.append(simhash(np.array([h for x in lists for h in x], np.uint64), counts))
            found = np.concatenate(prints or [np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found)], [*keep, out])

    return docs.select(*keep, F.col("text").alias(fresh(docs, "text_of"))).mapInArrow(run, T.StructType([*schema.fields, T.StructField(out, T.LongType())]))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each 64-bit word in the reflected Gray sequence."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


class GrayIndex:
    """Index over the fingerprints of whole buckets (``bucket``: a number for each fingerprint)."""

    def __init__(self, fps: np.ndarray, bucket: np.ndarray) -> None:
        order = np.lexsort((gray_rank(fps), bucket))
        self.fps, self.bucket = fps[order], bucket[order]
        new = np.concatenate([[True], self.bucket[1:] != self.bucket[:-1]])
        first = np.maximum.accumulate(np.where(new, np.arange(len(fps)), 0))
        inside = np.arange(len(fps)) - first
        self.levels, step = [], 1
        while True:
            starts = np.flatnonzero(inside % step == 0)
            spread = np.bitwise_or.reduceat(self.fps ^ np.repeat(self.fps[starts], np.diff([*starts, len(fps)])), starts)
            self.levels.append((starts, np.concatenate([starts[1:], [len(fps)]]), self.fps[starts], ~spread))
            if len(starts) == new.sum():
                break
            step *= FANOUT
        self.levels.reverse()
        self.children = [np.searchsorted(low[0], up[0]) for up, low in zip(self.levels, self.levels[1:])]
        self.child_ends = [np.searchsorted(low[0], up[1]) for up, low in zip(self.levels, self.levels[1:])]

    def links(self, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (i, j) with i < j of one bucket that differ in ``most`` bits or fewer, a block of queries at a time."""
        top = np.searchsorted(self.levels[0][0], np.arange(len(self.fps)), "right") - 1
        for lo in range(0, len(self.fps), QUERIES):
            query = np.arange(lo, min(len(self.fps), lo + QUERIES))
            node, apart, above = top[query], np.zeros(len(query), np.int64), np.zeros(len(query), np.uint64)
            for depth, (_, ends, pattern, common) in enumerate(self.levels):
                if depth:
                    n = self.child_ends[depth - 1][node] - self.children[depth - 1][node]
                    child = np.repeat(self.children[depth - 1][node], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    query, apart, above, node = np.repeat(query, n), np.repeat(apart, n), np.repeat(self.levels[depth - 1][3][node], n), child
                    later = ends[node] > query + 1
                    query, apart, above, node = query[later], apart[later], above[later], node[later]
                apart = apart + np.bitwise_count((self.fps[query] ^ pattern[node]) & common[node] & ~above)
                near = apart <= most
                query, apart, node = query[near], apart[near], node[near]
            other = self.levels[-1][0][node]
            yield query[other > query], other[other > query]


def least_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    while len(a):
        x, y = labels[a], labels[b]
        differ = x != y
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        if not len(a):
            break
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(jumped := labels[labels], labels):
            labels = jumped
    return labels


def _parts(mask: int, parts: int) -> list[int]:
    """``mask`` with each of ``parts`` runs of its free bits added."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | sum(1 << b for b in free[len(free) * k // parts : len(free) * (k + 1) // parts]) for k in range(parts)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame, most: int = 3, bucket: int = 4096) -> DataFrame:
    """u, v (long): links that connect all distinct fingerprints (column fp) which differ in ``most`` bits or fewer.

    Within a bucket each fingerprint is linked to the first one that it is connected with there; so groups of copies give no pairs.
    """
    spark, parts = prints.sparkSession, most + 1
    masks = _parts(0, parts)
    rows, done = prints.withColumn("mask", F.explode(F.array(*[F.lit(_signed(m)) for m in masks]))), []
    while True:
        rows = rows.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = stored(rows.groupBy("mask", "value").count().filter("count > 1"), "buckets")
        met = rows.join(sizes, ["mask", "value"])
        free = 64 - max(bin(m).count("1") for m in masks)
        if 1 << free <= bucket or sizes.filter(F.col("count") > bucket).isEmpty():
            done.append(met.select("mask", "value", "fp"))
            break
        done.append(met.filter(F.col("count") <= bucket).select("mask", "value", "fp"))
        # at most parts ** round rows: every way to take parts
        finer = spark.createDataFrame([(_signed(m), _signed(f)) for m in masks for f in _parts(m, parts)], "mask long, finer long")
        masks = sorted({f for m in masks for f in _parts(m, parts)})
        hot = met.filter(F.col("count") > bucket).select("mask", "fp")
        rows = stored(hot.join(F.broadcast(finer), "mask").select("fp", F.col("finer").alias("mask")).distinct(), "hot-fingerprints")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush(table: np.ndarray):
            change = np.concatenate([[True], (table[1:, :2] != table[:-1, :2]).any(axis=1)])
            index = GrayIndex(table[:, 2].copy().view(np.uint64), np.cumsum(change))
            labels = np.arange(len(table))
            for a, b in index.links(most):
                labels = least_labels(labels, a, b)
            tied = np.flatnonzero(labels != np.arange(len(table)))
            prints = index.fps.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(prints[tied]), pa.array(prints[labels[tied]])], ["u", "v"])

        for batch in batches:
            if batch.num_rows:
                held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1))
            if sum(map(len, held)) >= 100_000:
                table = np.concatenate(held)
                whole = np.flatnonzero((table[:, :2] != table[-1, :2]).any(axis=1))
                if len(whole):
                    yield flush(table[: whole[-1] + 1])
                    held = [table[whole[-1] + 1 :]]
        if held:
            yield flush(np.concatenate(held))

    found = [d.repartition("mask", "value").sortWithinPartitions("mask", "value").mapInArrow(search, "u long, v long") for d in done]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def near_duplicates(docs: DataFrame, words: int = 3, most: int = 3, bucket: int = 4096) -> DataFrame:
    """doc_id, fp (long), component_id: the smallest doc_id that links of fingerprints reach, its own included.

    Fingerprints of distinct value are compared, whatever number of texts has them. A text without words (null, empty or white space) has
    fingerprint zero and is linked like any other. Repeated rows stay. A null doc_id is never a component's id unless it has no other.
    """
    prints = stored(fingerprints(docs.withColumn("doc_id", F.col("doc_id").cast("long")), words), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(links(distinct.select("fp"), most, bucket))
    tied = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = tied.join(tied.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_least(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The document of each group's component_id (``groups``: doc_id, component_id); of rows that repeat it any one; columns as in ``docs``."""
    key, no_id = fresh(docs, "kept_id"), F.lit(-(1 << 63))
    kept = groups.filter("doc_id <=> component_id").select(F.coalesce("doc_id", no_id).alias(key)).distinct()
    return docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), no_id)).join(kept, key).dropDuplicates([key]).select(*[f"`{c}`" for c in docs.columns])


def keep_one(docs: DataFrame, words: int = 3, most: int = 3) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest doc_id (rows that repeat it: any one); columns as in ``docs``."""
    return keep_least(docs, near_duplicates(docs.select("doc_id", "text"), words, most))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
