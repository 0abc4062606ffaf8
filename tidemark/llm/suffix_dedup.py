"""Removal of long repeated passages, found with a run-length index (run-compressed Burrows-Wheeler transform with sampled run ends).

Equal ``LENGTH``-byte windows choose the same place inside them, their anchor: the least hash of all their ``KMER``-byte strings. So windows are
gathered by anchor, each text gives one fragment (all windows of one anchor, about 100 places apart) at a time, and only anchors that occur
again are looked at. Fragments that occur again whole are repeated whole. The others go, with one of each repeated kind, into blocks. A
block's run-length index holds, for each end of a run of its transform, the place in the text and the match with the neighbouring
suffix; between these samples the matching statistics fall by one with each place, so one pass streams them all and marks long ones.

A group of very many different fragments with one anchor is split: windows at like distances from the anchor have a longer string in
common than the anchor itself, so they are gathered again by that string, half of the distances at a time, until groups are small.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows, hot_join, hot_split, powers, slices, stored, text_bytes

LENGTH, KMER = 200, 32
#: Different fragments that a group may have before it is split, and bytes of a block.
GROUP, BLOCK_BYTES = 1000, 1 << 20
_BASE, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


class Hashes:
    """Hashes of any byte spans of a buffer, from prefix sums modulo 2**64."""

    def __init__(self, raw: np.ndarray) -> None:
        up, self.down = powers(_BASE, len(raw) + 1)
        x = raw.astype(np.uint64)
        # a byte's value is mixed first: sums of plain powers collide on some regular texts
        x = (x + np.uint64(1)) * np.uint64(_MIX)
        x ^= x >> np.uint64(31)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(x * up[: len(raw)], out=self.sums[1:])

    def spans(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        h = (self.sums[stop] - self.sums[start]) * self.down[start] + (stop - start).astype(np.uint64) * np.uint64(_MIX)
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(27))


def anchors(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text number, anchor, first and last window start (places in the text), hash of the anchor, of the fragment; for all windows."""
    none = np.zeros(0, np.int64)
    if len(raw) < LENGTH:
        return none, none, none, none, none, none
    h = Hashes(raw)
    places = np.arange(len(raw) - KMER + 1)
    kmers = h.spans(places, places + KMER)
    span = LENGTH - KMER + 1
    # the place in the low bits: of equal hashes the first counts
    low = np.uint64(max(1, int(len(raw)).bit_length()))
    least = (kmers >> low << low) | places.astype(np.uint64)
    width = 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(kmers) - span + 1], least[span - width : span - width + len(kmers) - span + 1])
    chosen = (least & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    text = np.searchsorted(at, np.arange(len(chosen)), "right") - 1
    valid = np.arange(len(chosen)) + LENGTH <= at[np.minimum(text + 1, len(at) - 1)]
    starts = np.flatnonzero(valid)
    if not len(starts):
        return none, none, none, none, none, none
    chosen, text = chosen[starts], text[starts]
    new = np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])])
    first, last = starts[new], starts[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(starts) - 1]])]
    chosen, text = chosen[new], text[new]
    fragment = h.spans(first, last + LENGTH) ^ ((chosen - first).astype(np.uint64) * np.uint64(_BASE))
    return text, chosen - at[text], first - at[text], last - at[text], kmers[chosen].view(np.int64), fragment.view(np.int64)


class RunLengthIndex:
    """Run-length index of a block of strings, and the matching statistics of all its places against all others.

    It keeps the transform's runs (``symbols`` and ``lengths``; -1 stands for what comes before a string) and of each run only its ends: the places in
    the text (``heads``, ``tails``) and the match of each tail with the next head (``match``). The suffix array is needed to build it and not kept.
    """

    def __init__(self, raw: np.ndarray, at: np.ndarray) -> None:
        """raw: the strings' bytes one after another; at: their offsets."""
        self.raw, n = raw, len(raw)
        self.end = np.repeat(at[1:], np.diff(at))
        order = self._sorted(n)
        before = np.full(n, -1, np.int64)
        inner = np.ones(n, bool)
        inner[at[:-1][at[:-1] < n]] = False
        before[inner] = raw[np.flatnonzero(inner) - 1]
        transform = before[order]
        # a run is of equal bytes; what begins a string is a run of its own
        starts = np.flatnonzero(np.concatenate([[True], (transform[1:] != transform[:-1]) | (transform[1:] < 0)]))
        self.symbols, self.lengths = transform[starts].astype(np.int16), np.diff(np.concatenate([starts, [n]]))
        self.heads, self.tails = order[starts], order[starts + self.lengths - 1]
        self.match = self._match(self.tails[:-1], self.heads[1:])

    def _sorted(self, n: int) -> np.ndarray:
        """Suffixes in order, by doubling the length that ranks cover; equal suffixes in order of place."""
        wide, key = np.zeros(n + 7, np.uint64), np.zeros(n, np.uint64)
        wide[:n] = self.raw.astype(np.uint64) + np.uint64(1)
        left = self.end - np.arange(n)
        for k in range(7):
            key |= np.where(k < left, wide[k : k + n], np.uint64(0)) << np.uint64(9 * (6 - k))
        order = np.argsort(key, kind="stable")
        rank = _ranks(key[order], order)
        covered, longest = 7, int(left.max(initial=0))
        open_ = _tied(rank, order)
        while covered < longest and len(open_):
            after = open_ + covered
            more = np.where(after < self.end[open_], rank[np.minimum(after, n - 1)] + 1, 0)
            pair = rank[open_] * (n + 1) + more
            by = np.argsort(pair, kind="stable")
            base, value = rank[open_][by], pair[by]
            place = np.arange(len(by))
            begin = np.maximum.accumulate(np.where(np.concatenate([[True], base[1:] != base[:-1]]), place, 0))
            change = np.maximum.accumulate(np.where(np.concatenate([[True], value[1:] != value[:-1]]), place, 0))
            rank[open_[by]] = base + change - begin
            open_ = np.sort(open_)
            covered *= 2
            counts = np.bincount(rank[open_], minlength=n)
            open_ = open_[counts[rank[open_]] > 1]
        return np.lexsort((np.arange(n), rank)) if len(open_) else np.argsort(rank, kind="stable")

    def _match(self, a: np.ndarray, b: np.ndarray, most: int = 1 << 30) -> np.ndarray:
        """Longest common extensions of places a and b."""
        limit = np.minimum(self.end[a] - a, self.end[b] - b)
        out, live = np.zeros(len(a), np.int64), np.arange(len(a))
        padded = np.concatenate([self.raw, np.zeros(8, np.uint8)])
        words = np.lib.stride_tricks.sliding_window_view(padded, 8)
        while len(live):
            x = np.ascontiguousarray(words[a[live] + out[live]]).view(">u8").ravel().astype(np.uint64)
            x ^= np.ascontiguousarray(words[b[live] + out[live]]).view(">u8").ravel().astype(np.uint64)
            equal = np.where(x == 0, 8, 0)
            differ = np.flatnonzero(x)
            # bytes before the first that differs
            equal[differ] = 7 - (np.floor(np.log2((x[differ] >> np.uint64(1)).astype(np.float64) + 0.6)).astype(np.int64) + 1) // 8
            got = np.minimum(out[live] + equal, limit[live])
            out[live] = got
            live = live[(equal == 8) & (got < limit[live])]
        return out

    def _streamed(self, places: np.ndarray, match: np.ndarray, alone: np.ndarray) -> np.ndarray:
        """Matching statistics of all places in text order: between samples they fall by one with each place."""
        reach = np.zeros(len(self.raw), np.int64)
        reach[places] = places + match
        reach[alone] = alone
        return np.maximum(np.maximum.accumulate(reach) - np.arange(len(self.raw)), 0)

    def statistics(self) -> np.ndarray:
        """For each place how long a string from there on also begins elsewhere in the block.

        The suffix above a run's head is the tail before it, that below a tail the next head; all other places have what the place before them in the
        text has, less one.
        """
        above = self._streamed(self.heads[1:], self.match, self.heads[:1])
        below = self._streamed(self.tails[:-1], self.match, self.tails[-1:])
        return np.maximum(above, below)


def _ranks(keys: np.ndarray, order: np.ndarray) -> np.ndarray:
    change = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    rank = np.zeros(len(order), np.int64)
    rank[order] = np.maximum.accumulate(np.where(change, np.arange(len(order)), 0))
    return rank


def _tied(rank: np.ndarray, order: np.ndarray) -> np.ndarray:
    counts = np.bincount(rank, minlength=len(rank))
    return np.flatnonzero(counts[rank] > 1)


def _ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge[::2], edge[1::2] - 1


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """id, th, at, kh, fh of every fragment; at: its first window start, 8 bits from there to the anchor, 8 bits to the last window start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = text_bytes(batch.column(2))
            for lo, hi in slices(at, 1 << 19):
                found = anchors(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                rows, at_anchor, first, last = found[:4]
                place = first << 16 | (at_anchor - first) << 8 | (last - first)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows + lo)), batch.column(1).take(pa.array(rows + lo)), pa.array(place), pa.array(found[4]), pa.array(found[5])], ["id", "th", "at", "kh", "fh"])

    return docs.select("id", "th", "text").mapInArrow(run, "id long, th long, at long, kh long, fh long")


def _contents(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: id, th, a, lo, hi, key, open. Adds the fragment's bytes; place: the anchor's place in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = text_bytes(batch.column(2))
            out = []
            for k, (doc, th, wants) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist())):
                text = raw[at[k] : at[k + 1]]
                out += [(w["key"], text[w["lo"] : w["hi"] + LENGTH].tobytes(), w["a"] - w["lo"], doc, th, w["lo"], w["open"]) for w in wants]
            kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, kinds)], ["key", "bytes", "place", "id", "th", "lo", "open"])

    gathered = wanted.groupBy("id", "th").agg(F.collect_list(F.struct("a", "lo", "hi", "key", "open")).alias("wants"))
    return docs.select("id", "th", "text").join(gathered, ["id", "th"]).mapInArrow(run, "key long, bytes binary, place int, id long, th long, lo int, open boolean")


def _in_blocks(fragments: DataFrame) -> DataFrame:
    """id, th, lo, hi: ranges of window starts that occur again within their group (key); only open fragments' ranges are given."""

    def search(rows: list[tuple]) -> pa.RecordBatch:
        _, contents, ids, ths, los, opens = zip(*rows)
        raw = np.frombuffer(b"".join(contents), np.uint8)
        at = np.concatenate([[0], np.cumsum([len(c) for c in contents])])
        long_ = RunLengthIndex(raw, at).statistics() >= LENGTH
        out = []
        for k in np.flatnonzero(opens):
            a, b = _ranges(long_[at[k] : at[k + 1]])
            out += [(ids[k], ths[k], los[k] + int(x), los[k] + int(y)) for x, y in zip(a, b)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["id", "th", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != last and size >= BLOCK_BYTES:
                    yield search(held)
                    held, size = [], 0
                last = row[0]
                held.append(row)
                size += len(row[1])
        if held:
            yield search(held)

    return fragments.select("key", "bytes", "id", "th", "lo", "open").repartition("key").sortWithinPartitions("key").mapInArrow(run, "id long, th long, lo int, hi int")


def _halves(fragments: DataFrame, size: int) -> DataFrame:
    """Split fragments of a group by distances (``size`` of them at a time) of window starts from the anchor; key: what all have in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, content, place, doc, th, lo, open_ in zip(*(c.to_pylist() for c in batch.columns)):
                h = Hashes(np.frombuffer(content, np.uint8))
                last = len(content) - LENGTH  # window starts 0 .. last, at distances place - start
                for cell in range(max(place - last, 0) // size, place // size + 1):
                    a, b = max(place - (cell + 1) * size + 1, 0), min(place - cell * size, last)
                    if a <= b:
                        # of any window at these distances: from the nearest start to the end of the farthest
                        common = (place - cell * size, place - (cell + 1) * size + 1 + LENGTH)
                        core = (max(common[0], 0), min(common[1], len(content)))
                        full = core == common
                        key = int(h.spans(np.array([core[0]]), np.array([core[1]])).view(np.int64)[0]) if full else None
                        out.append((key, content[a : b + LENGTH], place - a, doc, th, lo + a, open_, cell))
            kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 8, kinds)], ["key", "bytes", "place", "id", "th", "lo", "open", "cell"])

    return fragments.select("key", "bytes", "place", "id", "th", "lo", "open").mapInArrow(run, "key long, bytes binary, place int, id long, th long, lo int, open boolean, cell int")


def repeated_ranges(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """id, th, lo, hi: ranges of window starts (bytes) that occur again anywhere. docs: id, th (hash of the text), text."""
    arrow_rows(docs.sparkSession)
    rows = stored(_anchor_rows(docs), "anchors")
    kinds = rows.groupBy("kh", "fh").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("id", "th", "at")])
    kinds = stored(kinds, "fragments")
    groups = kinds.groupBy("kh").agg(F.count("*").alias("kinds"), F.count_if(F.col("n") == 1).alias("singles"))
    lo, hi = F.shiftright("at", 16).cast("int"), (F.shiftright("at", 16) + F.col("at").bitwiseAND(255)).cast("int")
    a = (F.shiftright("at", 16) + F.shiftright("at", 8).bitwiseAND(255)).cast("int")
    again = kinds.filter("n > 1").select("kh", "fh", "n")
    # only where a fragment has a hundredth of the rows are these read twice, to join it by broadcast
    hot, others = hot_split(again, "n", parts=100)
    found_whole = rows.join(others, ["kh", "fh"]) if others is not None and hot.isEmpty() else hot_join(rows, hot, others, ["kh", "fh"])
    whole = found_whole.select("id", "th", lo.alias("lo"), hi.alias("hi"))
    looked_at = kinds.join(groups.filter("kinds > 1 AND singles > 0"), "kh")
    wanted = looked_at.select("id", "th", a.alias("a"), lo.alias("lo"), hi.alias("hi"), F.col("kh").alias("key"), (F.col("n") == 1).alias("open"))
    fragments = stored(_contents(docs, wanted), "fragment-bytes")
    many = stored(groups.filter((F.col("kinds") > group) & (F.col("singles") > 0)).select(F.col("kh").alias("key")), "large-groups")
    if many.isEmpty():
        return whole.union(_in_blocks(fragments))
    found = whole.union(_in_blocks(fragments.join(many, "key", "left_anti")))
    hot, size = fragments.join(many, "key", "left_semi"), LENGTH - KMER + 1
    while size > 1:
        size = (size + 1) // 2
        cells = _halves(hot, size)
        cells = stored(cells.withColumn("fh", F.xxhash64("bytes")), "split-fragments")
        alike = stored(cells.groupBy("key", "fh", "place").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("id", "th", "lo")]), "split-kinds")
        # windows of a split fragment that occurs again whole
        found = found.union(cells.filter("open").join(alike.filter("n > 1").select("key", "fh", "place"), ["key", "fh", "place"]).select("id", "th", "lo", (F.col("lo") + F.length("bytes") - LENGTH).alias("hi")))
        groups = alike.groupBy("key").agg(F.count("*").alias("kinds"), F.count_if(F.col("n") == 1).alias("singles")).filter("kinds > 1 AND singles > 0")
        one = alike.join(groups, "key").select("key", "id", "th", "lo", "place", F.col("n").alias("copies"), "kinds")
        left = cells.join(one, ["key", "id", "th", "lo", "place"]).withColumn("open", F.col("open") & (F.col("copies") == 1))
        left = stored(left.select("key", "bytes", "place", "id", "th", "lo", "open", "kinds"), "split-groups")
        found = found.union(_in_blocks(left.filter(F.col("kinds") <= group)))
        hot = left.filter(F.col("kinds") > group)
        if hot.isEmpty():
            break
    return found


def remove_repeats(docs: DataFrame, group: int = GROUP, texts: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept (null unless ``texts``): texts as UTF-8 bytes (null: empty) without what occurs again.

    Every byte goes that is covered by a ``LENGTH``-byte string which also begins anywhere else, in the same text or another. Repeated rows are
    texts like any other: each makes the other one go. Texts shorter than that stay as they are; of very long texts every window counts. Further columns of
    ``docs`` are not read, whatever their names. An empty table gives no rows. Fragments that occur again whole are told by two 64-bit hashes, their
    anchor's and their own; all other matches are of bytes.
    """
    no_id = F.lit(-(1 << 63))
    text = F.coalesce("text", F.lit(""))
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), no_id).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    marks = repeated_ranges(docs, group).groupBy("id", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = text_bytes(batch.column(1))
            out = []
            for k, (doc, ranges) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                text = raw[at[k] : at[k + 1]]
                change = np.zeros(len(text) + 1, np.int64)
                if ranges:
                    np.add.at(change, [r["lo"] for r in ranges], 1)
                    np.add.at(change, [r["hi"] + LENGTH for r in ranges], -1)
                gone = np.cumsum(change)[:-1] > 0
                a, b = _ranges(gone)
                kept = text[~gone].tobytes()
                out.append((None if doc == -(1 << 63) else doc, len(text), int(gone.sum()), len(a), hashlib.sha256(kept).hexdigest(), [{"start": int(x), "stop": int(y) + 1} for x, y in zip(a, b)], kept if texts else None))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    types = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:bigint,stop:bigint>>, kept binary"
    return docs.join(marks, ["id", "th"], "left").select("id", "text", "ranges").mapInArrow(run, types)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False).drop("spans", "kept")
