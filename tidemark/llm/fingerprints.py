"""Document fingerprints from prefix polynomial hashes.

``PrefixHashes`` keeps, modulo two primes, the running sums of code point times power for every prefix of a text. Any span's hash is a difference
of two of them, so equality of spans takes constant time and the longest common extension of two places a binary search. A document's
fingerprint is the hash of the whole text beside the least hashes, in ``SLOTS`` classes, of all its spans of ``SPAN`` code points.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows, partitions_of, stored

PRIMES = (2**31 - 1, 2**31 - 19)
BASES = (1_103_515_245, 742_938_285)
SPAN, SLOTS = 16, 64
_POWERS: list[list[np.ndarray]] = []


def _mod_powers(n: int) -> list[list[np.ndarray]]:
    """For each prime the powers of its base, and of the base's inverse, up to n."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        size, tables = max(n, 1 << 15), []
        for p, b in zip(PRIMES, BASES):
            both = []
            for base in (b % p, pow(b, -1, p)):
                out = np.ones(1, np.int64)
                while len(out) < size:  # doubles: the powers so far times the next one
                    out = np.concatenate([out, out * pow(base, len(out), p) % p])
                both.append(out)
            tables.append(both)
        _POWERS[:] = tables
    return _POWERS


class PrefixHashes:
    """Prefix sums of a text's code points, modulo both primes."""

    def __init__(self, points: np.ndarray) -> None:
        self.n = len(points)
        self.sums = []
        c = points.astype(np.int64) + 1
        for (power, _), p in zip(_mod_powers(self.n + 1), PRIMES):
            s = np.zeros(self.n + 1, np.int64)
            np.cumsum(c * power[: self.n] % p, out=s[1:])
            self.sums.append(s % p)

    def span(self, start, length, k: int = 0):
        """Hash of spans modulo prime k, wherever they stand."""
        p, down = PRIMES[k], _mod_powers(self.n + 1)[k][1]
        s = self.sums[k]
        return (s[start + length] - s[start]) % p * down[start] % p

    def equal(self, start: int, other: PrefixHashes, at: int, length: int) -> bool:
        return all(self.span(start, length, k) == other.span(at, length, k) for k in range(2))

    def extension(self, start: int, other: PrefixHashes, at: int) -> int:
        """Code points that agree from ``start`` here and ``at`` there on."""
        lo, hi = 0, min(self.n - start, other.n - at)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if self.equal(start, other, at, mid) else (lo, mid - 1)
        return lo

    def whole(self) -> int:
        return int(self.sums[0][-1]) << 31 | int(self.sums[1][-1])

    def sketch(self) -> np.ndarray:
        """For each class the least span hash (1 to 65535), 0 if no span is in it. A shorter text is one span."""
        out = np.full(SLOTS, 1 << 16, np.int64)
        if self.n:
            size = min(SPAN, self.n)
            h = self.span(np.arange(self.n - size + 1), size).astype(np.uint64) + np.uint64(size << 40)
            h *= np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            # with many spans the least of 2**40 values; its low bits tell spans apart
            slot, value = (h & np.uint64(SLOTS - 1)).astype(np.int64), h >> np.uint64(24)
            least = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
            np.minimum.at(least, slot, value)
            used = least != np.iinfo(np.uint64).max
            out[used] = (least[used] % np.uint64(65535)).astype(np.int64) + 1
        return np.where(out == 1 << 16, 0, out)

    def fingerprint(self) -> tuple[str, np.ndarray]:
        sketch = self.sketch()
        return f"{self.whole():016x}{self.n:08x}" + sketch.astype(">u2").tobytes().hex(), sketch


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1 from two sketches: what share of their spans the texts have in common (both empty: 1)."""
    used = (a > 0) | (b > 0)
    if not used.any():
        return 1.0
    share = float((a[used] == b[used]).mean())
    return 2 * share / (1 + share)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def edited(text: str, following: str) -> str:
    """The last half (rounded down) of the code points replaced by as many first ones of the following text, or by all that it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_NAMES = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "same_edited", "same_next")
_KINDS = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
_TYPES = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, same_edited long, same_next long"


class _Hashed:
    """A row with its text's prefix hashes and fingerprint, which serve it and the row before it."""

    def __init__(self, doc_id: int | None, text: str) -> None:
        self.doc_id, self.text, self.prefix = doc_id, text, PrefixHashes(_points(text))
        self.mark, self.sketch = self.prefix.fingerprint()

    def followed_by(self, after: _Hashed) -> tuple:
        changed = edited(self.text, after.text)
        other = PrefixHashes(_points(changed))
        mark, sketch = other.fingerprint()
        sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
        return self.doc_id, len(self.text), sha, self.mark, mark, likeness(self.sketch, sketch), likeness(self.sketch, after.sketch), self.prefix.extension(0, other, 0), self.prefix.extension(0, after.prefix, 0)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Of every whole text (null: empty): n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, same_edited, same_next.

    The last two are the code points that the text shares from its start with the edited text and with the next document. Documents follow each other by
    descending doc_id, nulls last, those of equal doc_id by a hash of their text; the first follows the last. A table of one row is followed by itself, an empty one
    gives no rows. Repeated rows follow each other and all stay. Further columns, whatever their names, are not read.

    Texts are shuffled once, by ranges. Inside a range a row meets the next one in its task; a range's first and last row are kept beside the results, and the last one is
    joined to the first of the next range that has rows.
    """
    arrow_rows(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = (F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    ranged = docs.repartitionByRange(partitions_of(docs), *order).sortWithinPartitions(*order, "text")

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edge(name: str, row: _Hashed) -> pa.RecordBatch:
            values = [[row.doc_id], *[[None]] * (len(_NAMES) - 1), [name], [part], [row.text]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(values, (*_KINDS, pa.string(), pa.int32(), pa.string()))], [*_NAMES, "edge", "part", "text"])

        part, last = TaskContext.get().partitionId(), None
        for batch in batches:
            out = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                row = _Hashed(doc_id, text)
                if last is None:
                    yield edge("head", row)
                else:
                    out.append(last.followed_by(row))
                last = row
            columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(_NAMES), _KINDS)]
            none = [pa.nulls(len(out), t) for t in (pa.string(), pa.int32(), pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *none], [*_NAMES, "edge", "part", "text"])
        if last is not None:
            yield edge("tail", last)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_Hashed(doc_id, text).followed_by(_Hashed(None, after)) for doc_id, text, after in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(_NAMES), _KINDS)], list(_NAMES))

    found = stored(ranged.mapInArrow(within, f"{_TYPES}, edge string, part int, text string"), "fingerprints")
    heads, tails = found.filter("edge = 'head'"), found.filter("edge = 'tail'").select("part", "doc_id", "text")
    places = Window.orderBy("part")  # a number for each range
    following = heads.select("part", F.coalesce(F.lead("part").over(places), F.first("part").over(places)).alias("next"))
    edges = tails.join(following, "part").join(heads.select(F.col("part").alias("next"), F.col("text").alias("after")), "next")
    return found.filter("edge IS NULL").select(*_NAMES).union(edges.select("doc_id", "text", "after").mapInArrow(across, _TYPES))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
