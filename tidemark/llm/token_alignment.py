"""Alignment of two tokenizers' tokens by the byte offsets at which both end a token.

The ends of one tokenizer's tokens are an ascending list, and so are the other's. ``common_ends`` intersects them by galloping: each end of the shorter
list doubles its step into the longer one until it is passed, and a binary search places it in the last step. The common ends cut both lists into
groups, and the differences of their ranks are the ranges of tokens that overlap.

Both vocabularies leave a text's parts alone at a single space between two other characters, so every such place is a common end. A text is cut
there, and a distinct part is encoded and intersected once in a chunk of texts. A chunk sends each distinct pair of ids once, with the number of its documents
that link it; the corpus's counts come back to the chunks that have the pair, and are summed by document there.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, fields
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows, packed, slices, stored, text_bytes, unpacked

_DOUBLE = re.compile(r"\s\s")
_BREAK = re.compile(r"(?<=\S) (?=\S)")
_LOADED: dict = {}
#: Parts encoded in one call; links of a group beyond which its pairs are counted instead of listed.
_TOGETHER, _LARGE = 2048, 4096
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_CHUNK = "part int, chunk int, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, a array<int>, b array<int>, docs array<long>, own binary"


def parts_of(text: str) -> list[str]:
    """Parts of space + ``text`` (not empty), each without the space that it begins with."""
    whole = " " + text
    if text[-1] == " " or _DOUBLE.search(whole):
        first, *others = _BREAK.split(whole)
        return [first[1:], *others]
    return text.split(" ")


def gallop(ends: np.ndarray, others: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """For each of ``ends`` the first place in ascending ``others`` from ``first`` on, before ``stop``, whose value is no less, or ``stop``.

    All searches go side by side: each doubles its step until it is no longer below, and then halves the last step.
    """
    low, step = first - 1, np.ones(len(ends), np.int64)
    high = np.minimum(low + step, stop)
    on = np.flatnonzero(high < stop)
    while len(on):
        on = on[others[high[on]] < ends[on]]
        low[on] = high[on]
        step[on] *= 2
        high[on] = np.minimum(low[on] + step[on], stop[on])
        on = on[high[on] < stop[on]]
    on = np.flatnonzero(high - low > 1)
    while len(on):
        middle = (low[on] + high[on]) // 2
        below = others[middle] < ends[on]
        low[on[below]], high[on[~below]] = middle[below], middle[~below]
        on = on[high[on] - low[on] > 1]
    return high


def common_ends(a: np.ndarray, many_a: np.ndarray, b: np.ndarray, many_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places i and j with a[i] == b[j], in order, of the lists of many texts one after another (``many``: the length of each); each text's shorter list drives the search."""
    out = []
    stop_a, stop_b = np.cumsum(many_a), np.cumsum(many_b)
    for own, many, stop, others, many_other, stop_other, drives in ((a, many_a, stop_a, b, many_b, stop_b, many_a <= many_b), (b, many_b, stop_b, a, many_a, stop_a, many_b < many_a)):
        text = np.repeat(np.arange(len(many)), many)
        at = np.flatnonzero(drives[text])
        text = text[at]
        to = gallop(own[at], others, (stop_other - many_other)[text], stop_other[text])
        met = (to < stop_other[text]) & (others[np.minimum(to, len(others) - 1)] == own[at]) if len(others) else np.zeros(len(at), bool)
        out.append((at[met], to[met]))
    i, j = np.concatenate([out[0][0], out[1][1]]), np.concatenate([out[0][1], out[1][0]])
    order = np.argsort(i, kind="stable")
    return i[order], j[order]


def _byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 stands for itself, other bytes follow from 256 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Aligner:
    """Encodes parts by both tokenizers: A a byte-level tokenizers .json file, B a sentencepiece .model that adds the leading space itself."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        byte = _byte_characters()
        self.bytes_a = {i: bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        #: whether no piece goes on beyond a space, so that parts stand alone
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces) and self.b.encode("a  b") == self.b.encode("a") + self.b.encode(" b")
        numbers = lambda n, end: np.array([str(k).encode() + end for k in range(n)], object)
        many_a, many_b = 1 + max(self.bytes_a), len(pieces)
        self.bytes_a = [self.bytes_a.get(k, b"") for k in range(many_a)]
        self.size_a, self.size_b = (np.array([*map(len, table)]) for table in (self.bytes_a, self.bytes_b))
        self.text_a, self.last_a = numbers(many_a, b","), numbers(many_a, b"|")
        self.text_b, self.last_b = numbers(many_b, b","), numbers(many_b, b";")

    def align(self, parts: list[str]) -> Aligned:
        return Aligned.joined([self._align(parts[lo : lo + _TOGETHER]) for lo in range(0, len(parts), _TOGETHER)])

    def _align(self, parts: list[str]) -> Aligned:
        texts = [" " + p for p in parts]
        raw = [t.encode() for t in texts]
        of_a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        of_b = self.b.encode(parts, num_threads=1)
        give = lambda table, ids: b"".join(map(table.__getitem__, ids))
        sizes = [np.fromiter(chain.from_iterable(x), np.int64) for x in (of_a, of_b)]
        whole, same = b"".join(raw), [True] * len(parts)
        sizes = [np.bincount(np.repeat(np.arange(len(parts)), [*map(len, x)]), size[ids], len(parts)) for x, size, ids in ((of_a, self.size_a, sizes[0]), (of_b, self.size_b, sizes[1]))]
        if any((n != [*map(len, raw)]).any() for n in sizes) or not give(self.bytes_a, chain.from_iterable(of_a)) == whole == give(self.bytes_b, chain.from_iterable(of_b)):
            same = [give(self.bytes_a, x) == t == give(self.bytes_b, y) for x, y, t in zip(of_a, of_b, raw)]
            of_a, of_b = ([x if ok else [] for x, ok in zip(ids, same)] for ids in (of_a, of_b))
        many_a, many_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (of_a, of_b))
        a, b = (np.fromiter(chain.from_iterable(x), np.int64, n.sum()) for x, n in ((of_a, many_a), (of_b, many_b)))
        i, j = common_ends(np.cumsum(self.size_a[a]), many_a, np.cumsum(self.size_b[b]), many_b)
        # ranks of common ends: a group has the tokens after the one before it
        from_a, from_b = np.concatenate([[0], i + 1])[:-1], np.concatenate([[0], j + 1])[:-1]
        in_a, in_b = i + 1 - from_a, j + 1 - from_b
        text = np.searchsorted(np.cumsum(many_a), i, "right")
        counts = np.stack([many_a, many_b, np.bincount(text, minlength=len(parts)), np.bincount(text, in_a * in_b, len(parts)).astype(np.int64)], axis=1)
        # ids as text, in the order of groups: those of A in a group stand after all of B in the groups before
        line = np.empty(len(a) + len(b), object)
        line[np.arange(len(a)) + np.repeat(from_b, in_a)], line[np.arange(len(b)) + np.repeat(i + 1, in_b)] = self.text_a[a], self.text_b[b]
        line[i + from_b], line[j + i + 1] = self.last_a[a[i]], self.last_b[b[j]]
        ends, line = np.cumsum(many_a + many_b).tolist(), line.tolist()
        names = [b"".join(line[lo:hi]) for lo, hi in zip([0, *ends], ends)]
        # all pairs of a group; of a very large group each distinct pair once
        large = np.flatnonzero(in_a * in_b > _LARGE)
        pairs, times, owner = [], [], []
        for g in large.tolist():
            (x, n), (y, m) = np.unique(a[from_a[g] : i[g] + 1], return_counts=True), np.unique(b[from_b[g] : j[g] + 1], return_counts=True)
            pairs.append((x[:, None] << 32 | y).reshape(-1))
            times.append((n[:, None] * m).reshape(-1))
            owner.append(np.full(len(pairs[-1]), text[g]))
        small = in_a * in_b <= _LARGE
        n = (in_a * in_b)[small]
        place, wide = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), np.repeat(in_b[small], n)
        pairs.append(a[np.repeat(from_a[small], n) + place // wide] << 32 | b[np.repeat(from_b[small], n) + place % wide])
        times.append(np.ones(len(place), np.int64))
        owner.append(np.repeat(text[small], n))
        pairs, times, owner = map(np.concatenate, (pairs, times, owner))
        if len(large):
            order = np.argsort(owner, kind="stable")
            pairs, times, owner = pairs[order], times[order], owner[order]
        return Aligned(np.array(same, bool), counts, names, np.bincount(owner, minlength=len(parts)), pairs, times)


@dataclass
class Aligned:
    """Of parts: whether both give the bytes back; n_a, n_b, n_groups, n_links; the groups as text, each with an end; how many linked pairs follow, as id of A << 32 | id of B, and how often each."""

    same: np.ndarray
    counts: np.ndarray
    names: list[bytes]
    sizes: np.ndarray
    pairs: np.ndarray
    times: np.ndarray

    @staticmethod
    def joined(some: list[Aligned]) -> Aligned:
        columns = [[getattr(x, f.name) for x in some] for f in fields(Aligned)]
        return Aligned(*(list(chain.from_iterable(c)) if f.name == "names" else np.concatenate(c) for c, f in zip(columns, fields(Aligned))))


def _aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _LOADED:
        _LOADED[path_a, path_b] = Aligner(path_a, path_b)
    return _LOADED[path_a, path_b]


class _Chunk:
    """Texts side by side: distinct parts with what ``Aligner`` says of them, and how often each document has which."""

    def __init__(self, aligner: Aligner) -> None:
        self.aligner, self.number, self.bad, self.names, self.found = aligner, {}, set(), [], []
        self.ids, self.shas, self.many, self.words, self.frequencies = [], [], array("i"), array("i"), array("i")
        self.size = self.links = 0

    def _learn(self, parts: list[str]) -> int:
        """The number of the first of the parts."""
        first, new = len(self.names), self.aligner.align(parts)
        self.names += new.names
        self.bad.update((first + np.flatnonzero(~new.same)).tolist())
        self.links += len(new.pairs)
        self.found.append(new)
        return first

    def add(self, ids: list, texts: list[str | None]) -> None:
        parts = [(parts_of(t) if self.aligner.cuts else [t]) if t else [] for t in texts]
        new = [p for p in dict.fromkeys(chain.from_iterable(parts)) if p not in self.number]
        if new:
            self.number.update(zip(new, range(self._learn(new), len(self.names))))
        number, name = self.number.__getitem__, self.names.__getitem__
        for doc_id, text, own in zip(ids, texts, parts):
            at = list(map(number, own))
            if self.bad and not self.bad.isdisjoint(at):
                at = [self._learn([text])]  # only the whole text's bytes can tell
                at = [] if at[0] in self.bad else at
            distinct = Counter(at)
            self.ids.append(doc_id)
            self.shas.append(hashlib.sha256(b"".join(map(name, at))[:-1]).hexdigest() if at else "")
            self.many.append(len(distinct))
            self.words.extend(distinct)
            self.frequencies.extend(distinct.values())
            self.size += len(text or "")

    def row(self, part: int, chunk: int) -> pa.RecordBatch:
        many, words, frequencies = (np.frombuffer(x, np.int32).astype(np.int64) for x in (self.many, self.words, self.frequencies))
        known = Aligned.joined(self.found) if self.found else Aligned(*[np.zeros(0, np.int64)] * 6)
        pairs, flat = np.unique(known.pairs, return_inverse=True)
        sizes, ends = known.sizes.astype(np.int64), np.concatenate([[0], np.cumsum(many)])
        totals = [np.diff(np.concatenate([[0], np.cumsum(c[words] * frequencies)])[ends]) for c in known.counts.reshape(-1, 4).T]
        docs, first, lo = np.zeros(len(pairs), np.int64), np.cumsum(sizes) - sizes, 0
        while lo < len(many):  # documents of some million parts at once
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + (1 << 20), "right")) - 1)
            own, doc = words[ends[lo] : ends[hi]], np.repeat(np.arange(hi - lo), many[lo:hi])
            n = sizes[own]
            at = np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            met = np.unique(np.repeat(doc, n) * len(docs) + flat[at])
            docs += np.bincount(met % len(docs), minlength=len(docs)) if len(docs) else 0
            lo = hi
        lists = [pa.array([x], pa.list_(t)) for x, t in ((self.ids, pa.int64()), *((t, pa.int64()) for t in totals), (self.shas, pa.string()), *((p.astype(np.int32), pa.int32()) for p in (pairs >> 32, pairs & 0xFFFFFFFF)), (docs, pa.int64()))]
        own = packed(many, words, frequencies, sizes, flat, known.times)
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([chunk], pa.int32()), *lists, pa.array([own], pa.binary())], [c.split()[0] for c in _CHUNK.split(", ")])


def _chunks(docs: DataFrame, path_a: str, path_b: str, chunk_chars: int, most_links: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, name, held = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            ids, texts = (c.to_pylist() for c in batch.columns)
            for lo, hi in slices(text_bytes(batch.column(1))[1]):
                held = held or _Chunk(_aligner(path_a, path_b))
                held.add(ids[lo:hi], texts[lo:hi])
                if held.size >= chunk_chars or held.links >= most_links:
                    yield held.row(part, name)
                    held, name = None, name + 1
        if held:
            yield held.row(part, name)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _CHUNK)


def align_tokens(docs: DataFrame, path_a: str, path_b: str, chunk_chars: int = 16 << 20, most_links: int = 1_000_000) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum (long) and groups_sha256 of every whole text.

    ``path_a``: a byte-level tokenizers .json file, applied to space + text; ``path_b``: a sentencepiece .model, applied to the text. Tokens of special
    strings are never made. Texts that are null or empty, or that one of both doesn't give back byte by byte (with the space before), have zeros and
    an empty digest. Repeated rows, and rows that share a doc_id or have none, are documents of their own, each counted. Ties for an id's
    highest count all are best. Further columns of ``docs``, whatever their names, are not read. An empty table gives no rows. ``chunk_chars``, ``most_links``
    (of its distinct parts): a chunk ends after the slice of texts that reaches either; a longer single text is a chunk of its own and is held whole.
    """
    arrow_rows(docs.sparkSession)
    chunks = stored(_chunks(docs, path_a, path_b, chunk_chars, most_links), "aligned-chunks", "zstd")
    pairs = chunks.select("part", "chunk", F.posexplode(F.arrays_zip("a", "b", "docs")).alias("place", "p")).select("part", "chunk", "place", "p.*")
    counts = pairs.groupBy("a", "b").agg(F.sum("docs").alias("count"))
    # a row for each id of A, so never more than its vocabulary has
    best = F.broadcast(counts.groupBy("a").agg(F.max("count").alias("best")))
    facts = counts.join(best, "a").select("a", "b", "count", (F.col("count") == F.col("best")).cast("int").alias("is_best"))
    back = pairs.drop("docs").join(facts, ["a", "b"]).groupBy("part", "chunk").agg(F.collect_list(F.struct("place", "count", "is_best")).alias("facts"))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                many, words, frequencies, sizes, pair, times = (x.astype(np.int64) for x in unpacked(batch.column(0)[row].as_py()))
                sums, facts = [], batch.column(1)[row].values
                place, *values = (facts.field(k).to_numpy().astype(np.int64) if facts is not None else np.zeros(0, np.int64) for k in range(3))
                ends, starts = np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([[0], np.cumsum(many)])
                for value in reversed(values):
                    each = np.zeros(len(place), np.int64)
                    each[place] = value
                    word = np.diff(np.concatenate([[0], np.cumsum(each[pair] * times)])[ends])
                    sums.append(np.diff(np.concatenate([[0], np.cumsum(word[words] * frequencies)])[starts]))
                lists = [batch.column(k)[row].values for k in range(2, 8)]
                yield pa.RecordBatch.from_arrays([*lists[:5], *map(pa.array, sums), lists[5]], ["doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256"])

    joined = chunks.drop("a", "b", "docs").join(back, ["part", "chunk"], "left").select("own", "facts", "doc_id", *_COUNTS, "groups_sha256")
    return joined.mapInArrow(total, ", ".join(f"{c} long" for c in ("doc_id", *_COUNTS, "n_best", "count_sum")) + ", groups_sha256 string")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    a, b = (str(public_tokenizers.path(name)) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return align_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), a, b)
