"""Benchmark decontamination with suffix arrays of the training texts.

Every task takes its documents as shards, sorts the suffixes (in words) of each shard that can begin a benchmark window into a suffix
array, and binary-searches every benchmark suffix in it. So documents are not shuffled. The benchmark's side is broadcast in blocks of
``block_words`` words (or one longer item); the driver holds one block and the rows of the next. With one block documents are read once; with more, each
block's pass writes only what it found, by the digest of the text, and the findings are joined to the documents at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows, fresh, hot_join, hot_split, new_path, powers, slices, stored, text_bytes

_BASE, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Lower-cased word byte, or 0: digits, letters and every byte of a character beyond ASCII.
_WORD_BYTE = np.array([c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 0 for c in range(256)], np.uint8)
_TABLE_BITS = 20
RESULT = "struct<n_words:bigint,n_hit:bigint,longest:int,items:array<string>,spans:array<struct<start:int,stop:int>>>"


class Words:
    """The words of texts (bytes one after another, ``at``: their offsets), lower-cased: places, 64-bit hashes, and each text's first word (and the end)."""

    def __init__(self, raw: np.ndarray, at: np.ndarray) -> None:
        self.low = _WORD_BYTE[raw]
        inside = np.zeros(len(raw) + 2, np.int8)
        inside[1:-1] = self.low != 0
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        starts, stops = edge[::2], edge[1::2]
        cut = at[1:-1]  # a word never crosses from one text to the next
        if len(starts) and len(cut):
            k = np.searchsorted(starts, cut, "left") - 1
            cross = np.unique(cut[(k >= 0) & (stops[np.maximum(k, 0)] > cut)])
            starts, stops = np.sort(np.concatenate([starts, cross])), np.sort(np.concatenate([stops, cross]))
        up, down = powers(_BASE, len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((self.low.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
        hashes = (sums[stops] - sums[starts]) * down[starts] * np.uint64(_MIX)
        self.hashes = hashes ^ (hashes >> np.uint64(29))
        self.starts, self.stops, self.first = starts, stops, np.searchsorted(starts, at, "left")

    def prefix(self) -> np.ndarray:
        """Prefix sums of the words' hashes: any run of words has a hash of its own."""
        sums = np.zeros(len(self.hashes) + 1, np.uint64)
        np.cumsum(self.hashes * powers(_BASE, len(self.hashes) + 1)[0][: len(self.hashes)], out=sums[1:])
        return sums


def same_bytes(a: Words, i: np.ndarray, b: Words, j: np.ndarray) -> np.ndarray:
    """Whether words i of a and j of b have the same bytes."""
    size = a.stops[i] - a.starts[i]
    same = size == b.stops[j] - b.starts[j]
    i, j, size = i[same], j[same], size[same]
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    differ = a.low[np.repeat(a.starts[i], size) + inside] != b.low[np.repeat(b.starts[j], size) + inside]
    same[np.flatnonzero(same)[np.repeat(np.arange(len(i)), size)[differ]]] = False
    return same


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each place on (of fewer at the end)."""
    out = words.copy()
    for k in range(1, n):
        out[: len(words) - k] = out[: len(words) - k] * np.uint64(_BASE) + words[k:]
    return out * np.uint64(_MIX)


class BenchmarkBlock:
    """The suffixes of some benchmark items: what a task needs for its binary searches."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        raw, at = text_bytes(pa.array([t for _, t in items], pa.string()))
        self.text = Words(raw, at)
        self.words, first, self.prefix = self.text.hashes, self.text.first, self.text.prefix()
        words = self.words
        self.names, self.window = [n for n, _ in items], window
        # each distinct word, and one place that has it
        self.vocabulary, self.example, ids = np.unique(words, return_index=True, return_inverse=True)
        item, place, length = [], [], []
        for k in range(len(items)):
            n = int(first[k + 1] - first[k])
            if n:
                size = min(window, n)
                count = n - size + 1
                item.append(np.full(count, k))
                place.append(first[k] + np.arange(count))
                length.append(np.full(count, size))
        self.empty = not item
        if self.empty:
            return
        item, place, length = (np.concatenate(x).astype(np.int64) for x in (item, place, length))
        self.end = first[item + 1]
        keys = self.keys(ids + 1, place, np.minimum(place + length, self.end))
        # equal windows are one class; a class knows its items and the places where it begins
        both = np.array([k + bytes([n]) for k, n in zip(keys.tolist(), length.tolist())], object)
        classes, of = np.unique(both.astype(f"V{4 * window + 1}"), return_inverse=True)
        # the places of a class in the order of their whole suffixes
        order = np.lexsort((self._ranks(ids, np.repeat(first[1:], np.diff(first)))[place], of))
        self.item, self.place, self.stop = item[order], place[order], self.end[order]
        self.begin = np.searchsorted(of[order], np.arange(len(classes) + 1))
        head = order[self.begin[:-1]]
        self.key, self.length = keys[head], length[head]
        self.lead = int(min(3, self.length.min()))
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[_grams(words, self.lead)[place] >> np.uint64(64 - _TABLE_BITS)] = True

    @staticmethod
    def _ranks(ids: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Ranks of all suffixes (each to its item's end), by doubling the words that they cover."""
        n, rank, covered = len(ids), ids.astype(np.int64), 1
        at, longest = np.arange(n), int((end - np.arange(n)).max(initial=0))
        while covered < longest:
            after = np.where(at + covered < end, rank[np.minimum(at + covered, n - 1)] + 1, 0)
            rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1]
            covered *= 2
        return rank

    def keys(self, ids: np.ndarray, places: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """The first ``window`` word ids from each place on as bytes that sort as the suffixes do."""
        at = places[:, None] + np.arange(self.window)
        rows = np.where(at < stops[:, None], ids[np.minimum(at, len(ids) - 1)], 0).astype(">u4")
        return np.ascontiguousarray(rows).view(f"V{4 * self.window}").ravel()

    def search(self, raw: np.ndarray, at: np.ndarray):
        """Words of each text, and of every match: text, first word in it, words, longest verbatim match from there on, class."""
        texts = Words(raw, at)
        words, first = texts.hashes, texts.first
        counts = first[1:] - first[:-1]
        none = np.zeros(0, np.int64)
        if self.empty or not len(words):
            return counts, none, none, none, none, none
        places = np.flatnonzero(self.table[_grams(words, self.lead) >> np.uint64(64 - _TABLE_BITS)])
        if not len(places):
            return counts, none, none, none, none, none
        stops = first[np.searchsorted(first, places, "right")]
        need = np.unique(np.minimum(places[:, None] + np.arange(self.window), len(words) - 1))
        ids = np.zeros(len(words), np.int64)
        found = np.minimum(np.searchsorted(self.vocabulary, words[need]), len(self.vocabulary) - 1)
        equal = self.vocabulary[found] == words[need]
        equal[equal] = same_bytes(texts, need[equal], self.text, self.example[found[equal]])
        ids[need] = np.where(equal, found + 1, 0)
        suffixes = self.keys(ids, places, stops)
        width = 4 * self.window
        order = np.argsort(as_text := suffixes.view(f"S{width}"), kind="stable")
        array = as_text[order]
        low = self.key.view(f"S{width}")
        high = self.key.view(np.uint8).reshape(-1, width).copy()
        for size in np.unique(self.length):
            high[self.length == size, 4 * size :] = 255
        left, right = np.searchsorted(array, low, "left"), np.searchsorted(array, high.reshape(-1).view(f"S{width}"), "right")
        hits = np.flatnonzero(right > left)
        n = right[hits] - left[hits]
        rank = np.repeat(left[hits], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start, kind = places[order[rank]], np.repeat(hits, n)
        size = self.length[kind]
        text = np.searchsorted(first, start, "right") - 1
        inside = start + size <= first[text + 1]
        start, kind, size, text = start[inside], kind[inside], size[inside], text[inside]
        return counts, text, start - first[text], size, self._longest(texts, start, kind, size, text), kind

    def _longest(self, texts: Words, start, kind, size, text) -> np.ndarray:
        """The longest verbatim match from each match on: its suffix is searched for among its class's, and the nearest one shares most."""
        up, down = powers(_BASE, max(len(texts.hashes), len(self.words)) + 1)
        prefix, end = texts.prefix(), texts.first[text + 1]

        def common(a, stop_a, b, stop_b, least):
            low, high = least.copy(), np.minimum(stop_a - a, stop_b - b)
            while (open_ := np.flatnonzero(low < high)).size:
                middle = (low[open_] + high[open_] + 1) // 2
                i, j = a[open_], b[open_]
                equal = (prefix[i + middle] - prefix[i]) * down[i] == (self.prefix[j + middle] - self.prefix[j]) * down[j]
                low[open_] = np.where(equal, middle, low[open_])
                high[open_] = np.where(equal, high[open_], middle - 1)
            return low

        best, left, right = size.copy(), self.begin[kind].copy(), self.begin[kind + 1].copy()
        while (open_ := np.flatnonzero(left < right)).size:
            middle = (left[open_] + right[open_]) // 2
            a, b = start[open_], self.place[middle]
            shared = common(a, end[open_], b, self.stop[middle], size[open_])
            best[open_] = np.maximum(best[open_], shared)
            mine, other = a + shared, b + shared
            over = other >= self.stop[middle]
            more = texts.hashes[np.minimum(mine, len(texts.hashes) - 1)] > self.words[np.minimum(other, len(self.words) - 1)]
            later = np.where(mine >= end[open_], False, over | more)
            left[open_] = np.where(later, middle + 1, left[open_])
            right[open_] = np.where(later, right[open_], middle)
        return best


def _blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[BenchmarkBlock]:
    held, n = [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), F.coalesce("text", F.lit(""))).toLocalIterator():
        size = len(row[1]) // 2 + 1
        if held and n + size > block_words:
            yield BenchmarkBlock(held, window)
            held, n = [], 0
        held.append((row[0], row[1]))
        n += size
    yield BenchmarkBlock(held, window)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_words: int = 500_000, out: str = "contamination", keep: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` (columns ``keep``, or all) with a struct ``out``: n_words, n_hit, longest, items, spans.

    A window is ``window`` consecutive words of a benchmark item, or the whole item if it is shorter. ``spans`` are the maximal runs of
    document words inside window occurrences, ``items`` the sorted ids of items with an occurring window, ``longest`` the longest verbatim
    match in words. A null text or item text has no words; a null item_id counts as a window but names no item; an empty benchmark hits nothing.
    Repeated documents all stay, items with equal windows are all named, very long texts count whole, and an empty table gives no rows. If ``docs``
    has a column ``out``, the new one gets underscores at its end.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    kept = docs.columns if keep is None else keep
    out = fresh(docs, out)
    text = fresh(docs, "text_of")
    names = [F.col(f"`{c}`") for c in kept]
    source = docs.select(*names, F.col("text").alias(text))
    blocks = _blocks(benchmark, window, block_words)
    block, following = next(blocks), next(blocks, None)
    if following is None:
        shared = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = pa.array([row for _, row in _found(shared.value, batch.column(len(kept)))], _FOUND)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], found], [*kept, out])

        types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)
        return source.mapInArrow(search, f"{types}, `{out}` {RESULT}")
    path, number = new_path(spark, "contamination"), 0
    while block is not None:
        shared = spark.sparkContext.broadcast(block)

        def hits(batches: Iterator[pa.RecordBatch], shared=shared, number=number) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(0)
                rows = [(hashlib.sha256(texts[k].as_buffer()).hexdigest(), number, row) for k, row in _found(shared.value, texts) if row["n_hit"]]
                columns = [[r[k] for r in rows] for k in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), _FOUND))], ["digest", "block", "found"])

        docs.select(F.col("text").alias(text)).mapInArrow(hits, f"digest string, block int, found {RESULT}").write.mode("append").parquet(path)
        shared.destroy()
        block, following, number = following, next(blocks, None), number + 1
    digest, rows = fresh(docs, "digest_of"), fresh(docs, "rows_of")
    once = spark.read.parquet(path).groupBy("digest", "block").agg(F.first("found").alias("found"), F.count("*").alias("rows"))
    once = once.groupBy("digest").agg(F.collect_list("found").alias("all"), F.max("rows").alias("rows"))  # a row for each block at most

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([_all_blocks(x) for x in batch.column(2).to_pylist()], _FOUND)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], [digest, rows, out])

    merged = stored(once.select("digest", "rows", "all").mapInArrow(merge, f"`{digest}` string, `{rows}` long, `{out}` {RESULT}"), "contamination")
    joined = hot_join(source.withColumn(digest, F.sha2(F.col(text), 256)), *hot_split(merged, rows), digest, "left")
    words = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", -1), lambda w: w != "")).cast("long")
    none = F.struct(words.alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.lit(0).alias("longest"), F.array().cast("array<string>").alias("items"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))
    return joined.select(*names, F.coalesce(F.col(out), none).alias(out))


_FOUND = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("longest", pa.int32()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))])


def _found(index: BenchmarkBlock, column: pa.Array) -> Iterator[tuple[int, dict]]:
    """Number and findings of each text."""
    raw, at = text_bytes(column)
    for lo, hi in slices(at):
        counts, of, start, size, longest, kind = index.search(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        order = np.lexsort((start, of))
        bounds = np.searchsorted(of[order], np.arange(hi - lo + 1))
        for k in range(hi - lo):
            mine = order[bounds[k] : bounds[k + 1]]
            items = {index.names[i] for c in np.unique(kind[mine]) for i in np.unique(index.item[index.begin[c] : index.begin[c + 1]])}
            yield lo + k, _merged(int(counts[k]), start[mine], start[mine] + size[mine], longest[mine], items)


def _all_blocks(found: list[dict]) -> dict:
    spans = [(x["start"], x["stop"]) for f in found for x in f["spans"]]
    start, stop = np.array(spans, np.int64).reshape(-1, 2).T
    return _merged(found[0]["n_words"], start, stop, np.array([f["longest"] for f in found]), {i for f in found for i in f["items"]})


def _merged(n_words: int, start: np.ndarray, stop: np.ndarray, longest: np.ndarray, items: set) -> dict:
    spans = []
    if len(start):
        order = np.argsort(start, kind="stable")
        start, reach = start[order], np.maximum.accumulate(stop[order])
        new = np.concatenate([[True], start[1:] > reach[:-1]])
        ends = np.concatenate([reach[:-1][new[1:]], reach[-1:]])
        spans = [{"start": int(a), "stop": int(b)} for a, b in zip(start[new], ends)]
    best = int(longest.max(initial=0))
    return {"n_words": n_words, "n_hit": sum(x["stop"] - x["start"] for x in spans), "longest": best, "items": sorted(x for x in items if x is not None), "spans": spans}


def is_contaminated(found: str, per_hit: int = 20):
    """Condition: any hit, and at least one word in ``per_hit`` is hit."""
    return (F.col(f"{found}.n_hit") > 0) & (per_hit * F.col(f"{found}.n_hit") >= F.col(f"{found}.n_words"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    found = fresh(docs, "contamination")
    return find_contamination(docs, benchmark, out=found).filter(~is_contaminated(found)).drop(found)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = find_contamination(docs, benchmark, keep=["doc_id"])
    c = "contamination"
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"), f"{c}.n_words", f"{c}.n_hit", F.size(f"{c}.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(f"{c}.items", ","), 256).alias("items_sha256"), is_contaminated(c).alias("contaminated"),
    )


def oracle() -> str:
    """The query's question in SQL; as the text is joined as words, no place in a document is met twice by one window."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""WITH d AS (SELECT doc_id, {words} AS w FROM documents), b AS (SELECT item_id, {words} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[k:k + least(13, len(w)) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT doc_id, k, n, item_id FROM dw JOIN bw USING (n, g)), h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN i ON d.doc_id = i.doc_id"""
