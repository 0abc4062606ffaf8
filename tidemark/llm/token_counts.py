"""Token counts: pieces are counted once per distinct pre-token, joined to each document's pre-token frequencies, and summed.

Texts are taken in chunks. A chunk keeps its distinct pre-tokens and, for each document, their numbers and frequencies. Spark sorts the pre-tokens of
all chunks, the library counts each distinct one once, and the counts go back to the chunks that have it, where they are joined to the documents'
frequencies by number. A chunk sends a pre-token once however frequent it is, so no pre-token has more rows than there are chunks.
"""

from __future__ import annotations

import os
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows, packed, stored, text_bytes, unpacked

_DOUBLE = re.compile(r"\s\s")
_BREAK = re.compile(r"(?<=\S) (?=\S)")
_LOADED: dict = {}
#: A chunk's name: the number of its partition (31 bits), then of the chunk in it (32 bits).
_NAME_BITS = 32


def pre_tokens(text: str) -> list[str]:
    """Parts that no token crosses, each with its leading space.

    A byte-level vocabulary puts one leading space into a token, and a run of white space before a word is cut before its last
    character. So a text may be cut before a single space between two other characters; longer runs of white space stay whole.
    """
    parts = _BREAK.split(text) if _DOUBLE.search(text) else text.split(" ")
    return [parts[0], *[" " + p for p in parts[1:]]]


def _counter(path: str):
    """Function list of strings -> list of counts; the library is loaded once in a worker process."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_file=path)
            _LOADED[path] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            _LOADED[path] = lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
    return _LOADED[path]


_CHUNK = "chunk long, doc_id array<long>, n_bytes array<long>, pieces array<string>, own binary"


def _chunks(docs: DataFrame, whole: bool, chunk_bytes: int) -> DataFrame:
    """A row for each chunk: ids and sizes of its documents, its distinct pre-tokens, and how many each document has, their numbers and frequencies."""

    def chunk(name: int, held: list) -> pa.RecordBatch:
        number: dict[str, int] = {}
        many, numbers, frequencies = array("i"), array("i"), array("i")
        for _, _, text in held:
            own = Counter() if not text else Counter((text,)) if whole else Counter(pre_tokens(text))
            own.pop("", None)
            many.append(len(own))
            numbers.extend([number.setdefault(piece, len(number)) for piece in own])
            frequencies.extend(own.values())
        long_lists = [pa.array([[row[k] for row in held]], pa.list_(pa.int64())) for k in (0, 1)]
        many, numbers, frequencies = (np.frombuffer(x, np.int32) for x in (many, numbers, frequencies))
        # ascending in each document, as steps: small numbers take little room
        order = np.lexsort((numbers, np.repeat(np.arange(len(many)), many)))
        own = packed(many, np.diff(numbers[order], prepend=0), frequencies[order])
        columns = [pa.array([name]), *long_lists, pa.array([list(number)], pa.list_(pa.string())), pa.array([own], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["chunk", "doc_id", "n_bytes", "pieces", "own"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, name = [], 0, TaskContext.get().partitionId() << _NAME_BITS
        for batch in batches:
            sizes = np.diff(text_bytes(batch.column(1))[1]).tolist()
            for row in zip(batch.column(0).to_pylist(), sizes, batch.column(1).to_pylist()):
                held.append(row)
                size += row[1]
                if size >= chunk_bytes:
                    yield chunk(name, held)
                    held, size, name = [], 0, name + 1
        if held:
            yield chunk(name, held)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _CHUNK)


def _counts(chunks: DataFrame, tokenizer: str, most: int = 1_000_000) -> DataFrame:
    """chunk, counts: for a part of a chunk's pre-tokens their places and numbers of tokens. Each distinct pre-token is counted once."""

    def by_chunk(held: list[tuple]) -> pa.RecordBatch:
        chunk, place, n = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(chunk, kind="stable")
        ids, starts = np.unique(chunk[order], return_index=True)
        blobs = [packed(place[rows], n[rows]) for rows in np.split(order, starts[1:])]
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(blobs, pa.binary())], ["chunk", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            distinct = batch.column(0).dictionary_encode()
            pieces = distinct.dictionary.to_pylist()
            new = [p for p in pieces if p not in last]
            known = last | dict(zip(new, _counter(tokenizer)(new) if new else []))
            last = {pieces[-1]: known[pieces[-1]]}  # rows are sorted: only the last pre-token can go on
            n = np.array([known[p] for p in pieces], np.int64)[distinct.indices.to_numpy()]
            held.append((batch.column(1).to_numpy(), batch.column(2).to_numpy(), n))
            size += batch.num_rows
            if size >= most:
                yield by_chunk(held)
                held, size = [], 0
        if held:
            yield by_chunk(held)

    places = chunks.select(F.posexplode("pieces").alias("place", "piece"), "chunk").select("piece", "chunk", "place")
    return places.repartition("piece").sortWithinPartitions("piece").mapInArrow(run, "chunk long, counts binary")


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, chunk_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text.

    ``tokenizer``: path of a tokenizers .json file (byte-level vocabulary, GPT-2 pre-tokens) or of a sentencepiece .model; the latter
    has no pre-tokens that stand alone, so whole texts are its pieces. ``chunk_bytes``: text that a chunk has, or one longer text.
    A null or empty text has 0 bytes and 0 tokens. Repeated rows give repeated rows. Further columns of ``docs`` are not read.
    An empty table gives no rows.
    """
    arrow_rows(docs.sparkSession)
    chunks = stored(_chunks(docs, tokenizer.endswith(".model"), chunk_bytes), "token-chunks", "zstd")
    counts = _counts(chunks, tokenizer).groupBy("chunk").agg(F.collect_list("counts").alias("counts"))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                doc_id, n_bytes = (batch.column(k)[row].values for k in (0, 1))
                many, numbers, frequencies = unpacked(batch.column(3)[row].as_py())
                each = np.zeros(batch.column(2)[row].as_py(), np.int64)
                for blob in batch.column(4)[row].as_py() or []:
                    place, n = unpacked(blob)
                    each[place] = n
                sums = np.concatenate([[0], np.cumsum(each[np.cumsum(numbers)] * frequencies)])
                ends = np.concatenate([[0], np.cumsum(many.astype(np.int64))])
                yield pa.RecordBatch.from_arrays([doc_id, n_bytes, pa.array(sums[ends[1:]] - sums[ends[:-1]], pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    joined = chunks.select("chunk", "doc_id", "n_bytes", F.size("pieces").alias("size"), "own").join(counts, "chunk", "left")
    return joined.select("doc_id", "n_bytes", "size", "own", "counts").mapInArrow(total, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), str(public_tokenizers.path("byte_bpe_50k.json")))
