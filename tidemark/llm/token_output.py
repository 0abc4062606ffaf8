"""Token-id files: independent zstandard frames, a trailing seek table and a checksum for each frame.

File layout (all integers little-endian)::

    frame*            zstandard frames, each one the ids (uint32) of whole documents in order
    seek table        for each frame: compressed size u64, ids u64, first document u64, documents u64, crc32 of the ids' bytes u32
    document table    one zstandard frame: doc_id i64 (null: smallest i64), ids u32, as two arrays
    footer            frames u64, documents u64, bytes of the document table u64, crc32 of both tables u32, magic ``TDMKIDS1``

A reader takes the footer, then the tables, then only the frames that hold the documents it wants.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows, by_id_range, filesystem, new_path, partitions_of, slices, text_bytes

MAGIC = b"TDMKIDS1"
SEEK = np.dtype([("size", "<u8"), ("ids", "<u8"), ("first", "<u8"), ("docs", "<u8"), ("crc", "<u4")])
FOOTER = struct.Struct("<QQQI8s")
FRAME_BYTES = 1 << 20
NO_ID = np.iinfo(np.int64).min
_MEMO: dict[str, RunIds] = {}


class Writer:
    """Writes one file; ``add`` takes the ids of a document as little-endian uint32 bytes."""

    def __init__(self, sink, frame_bytes: int = FRAME_BYTES, level: int = 1) -> None:
        import zstandard

        self.sink, self.frame_bytes, self.pack = sink, frame_bytes, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.part, self.held, self.first, self.seek, self.ids, self.sizes = [], 0, 0, [], [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(NO_ID if doc_id is None else doc_id)
        self.sizes.append(len(ids) // 4)
        self.part.append(ids)
        self.held += len(ids)
        if self.held >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if len(self.ids) > self.first:
            raw = b"".join(self.part)
            frame = self.pack.compress(raw)
            self.sink.write(frame)
            self.seek.append((len(frame), len(raw) // 4, self.first, len(self.ids) - self.first, zlib.crc32(raw)))
            self.part, self.held, self.first = [], 0, len(self.ids)

    def close(self) -> None:
        self.flush()
        table = np.array(self.seek, SEEK).tobytes()
        documents = self.pack.compress(np.array(self.ids, "<i8").tobytes() + np.array(self.sizes, "<u4").tobytes())
        self.sink.write(table + documents + FOOTER.pack(len(self.seek), len(self.ids), len(documents), zlib.crc32(documents, zlib.crc32(table)), MAGIC))


class Reader:
    """Reads one file (seekable); every frame's checksum is tested when it is read."""

    def __init__(self, source, size: int) -> None:
        import zstandard

        self.source, self.unpack = source, zstandard.ZstdDecompressor()
        source.seek(size - FOOTER.size)
        frames, docs, length, crc, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        source.seek(size - FOOTER.size - length - frames * SEEK.itemsize)
        tables = source.read(frames * SEEK.itemsize + length)
        if zlib.crc32(tables) != crc:
            raise ValueError("the seek table is damaged")
        self.seek = np.frombuffer(tables[: frames * SEEK.itemsize], SEEK)
        raw = self.unpack.decompress(tables[frames * SEEK.itemsize :])
        self.ids, self.sizes = np.frombuffer(raw[: 8 * docs], "<i8"), np.frombuffer(raw[8 * docs :], "<u4").astype(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.seek["size"].astype(np.int64))])

    def frame(self, k: int) -> bytes:
        self.source.seek(int(self.offsets[k]))
        raw = self.unpack.decompress(self.source.read(int(self.seek["size"][k])))
        if zlib.crc32(raw) != int(self.seek["crc"][k]):
            raise ValueError(f"frame {k} is damaged")
        return raw

    def documents(self, wanted: list[int] | None = None) -> Iterator[tuple[int, bytes]]:
        """(place in the file, ids) of the documents at the wanted places, or of all; only their frames are decompressed."""
        want = None if wanted is None else set(wanted)
        for k, row in enumerate(self.seek):
            first, docs = int(row["first"]), int(row["docs"])
            if want is None or any(i in want for i in range(first, first + docs)):
                raw, at = self.frame(k), 4 * np.concatenate([[0], np.cumsum(self.sizes[first : first + docs])])
                for i in range(docs):
                    if want is None or first + i in want:
                        yield first + i, raw[at[i] : at[i + 1]]


class RunIds:
    """Ids of distinct runs between white space, in one array; a run is encoded when it is first met and forgotten only when too many are held.

    Runs are given to the library joined by single spaces, ``together`` at a time, and each token goes to the run in which it starts: the tokenizer
    must cut at white space and drop it.
    """

    def __init__(self, path: str, cap: int, together: int = 256) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model, self.cap, self.together = Tokenizer.from_file(path), cap, together
        self.model.no_truncation()
        self.model.no_padding()
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.ids, self.begin = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64)

    def learn(self, new: list[bytes]) -> None:
        texts = [w.decode("utf-8", "replace") for w in new]
        groups = [texts[k : k + self.together] for k in range(0, len(texts), self.together)]
        count, ids = np.zeros(len(new), np.int64), []
        for k, (group, found) in enumerate(zip(groups, self.model.encode_batch([" ".join(g) for g in groups], add_special_tokens=False))):
            stops = np.cumsum(np.fromiter(map(len, group), np.int64, len(group)) + 1)
            starts = np.array([a for a, _ in found.offsets], np.int64)
            of = np.searchsorted(stops, starts, "right")
            count[k * self.together : k * self.together + len(group)] = np.bincount(of, minlength=len(group))
            ids.append(np.array(found.ids, np.uint32))
        base, flat = len(self.at), np.concatenate(ids)
        total = int(self.begin[base])
        self.ids = _grown(self.ids, total + len(flat))
        self.begin = _grown(self.begin, base + len(new) + 1)
        self.ids[total : total + len(flat)] = flat
        self.begin[base + 1 : base + len(new) + 1] = total + np.cumsum(count)
        self.at.update(zip(new, range(base, base + len(new))))

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each text's begin."""
        if len(self.at) > self.cap:
            self.clear()
        lists = pc.ascii_split_whitespace(texts)
        ends = lists.offsets.to_numpy()
        distinct = pc.dictionary_encode(lists.flatten().cast(pa.large_binary()))
        names = distinct.dictionary.to_numpy(zero_copy_only=False)
        known = list(map(self.at.get, names))
        if None in known:
            self.learn([w for w, k in zip(names, known) if k is None])
            known = list(map(self.at.__getitem__, names))
        runs = np.array(known, np.int64)[distinct.indices.to_numpy()]
        n = self.begin[runs + 1] - self.begin[runs]
        stops = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.repeat(self.begin[runs] - stops[:-1], n) + np.arange(stops[-1])]
        return ids, stops[ends - ends[0]]


def _grown(array: np.ndarray, size: int) -> np.ndarray:
    return array if size <= len(array) else np.concatenate([array, np.zeros(max(size, len(array)), array.dtype)])


def _runs(path: str, cap: int) -> RunIds:
    """One for each worker process and tokenizer."""
    if path not in _MEMO:
        _MEMO[path] = RunIds(path, cap)
    return _MEMO[path]


def write_tokens(docs: DataFrame, tokenizer: str, out: str, end_id: int = 2, memo: int = 1_000_000, partitions: int | None = None) -> DataFrame:
    """Encode every whole text, end it with ``end_id`` and write the ids to files in ``out``, ascending doc_id (nulls last).

    Returns the manifest, a row for each file: part, path, bytes, n_docs, n_tokens, start (ids in all files before it).
    The tokenizer must cut at white space and drop it (a word vocabulary): then each distinct run between white space is encoded once by a
    task's worker, which holds about ``memo`` of them. A retried task writes a file of a new name, and only the names in the manifest count. Null
    and empty texts have the end id alone; a very long text is encoded whole and is one frame. Repeated rows, and other rows of equal doc_id, all
    stay, in any order. Further columns of ``docs`` are not read. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _runs(tokenizer, memo)
        part, sink = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if sink is None:
                part = batch.column(2)[0].as_py()
                fs, folder = filesystem(out)
                fs.create_dir(folder, recursive=True)
                name = f"ids-{part:06d}-{uuid.uuid4().hex}.bin"
                sink = fs.open_output_stream(f"{folder}/{name}")
                writer = Writer(sink)
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).fill_null("").cast(pa.large_string())
            for lo, hi in slices(text_bytes(texts)[1], 8 << 20):
                ids, begin = runs.of(texts.slice(lo, hi - lo))
                for k in range(hi - lo):
                    writer.add(doc_ids[lo + k], ids[begin[k] : begin[k + 1]].tobytes() + end)
        if sink is not None:
            writer.close()
            sink.close()
            columns = [[part], [f"{out}/{name}"], [fs.get_file_info(f"{folder}/{name}").size], [len(writer.ids)], [int(np.sum(writer.sizes))]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["part", "path", "bytes", "n_docs", "n_tokens"])

    ordered = by_id_range(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id", partitions or partitions_of(docs))
    files = new_path(spark, "token-manifest")
    ordered.withColumn("part", F.spark_partition_id()).mapInArrow(write, "part int, path string, bytes long, n_docs long, n_tokens long").write.parquet(files)
    manifest = spark.read.parquet(files)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files of a manifest, from the files alone."""
    spark = manifest.sparkSession

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            for row in rows.itertuples():
                fs, path = filesystem(row.path)
                with fs.open_input_file(path) as source:
                    reader = Reader(source, source.size())
                    crc = np.fromiter((zlib.crc32(ids) for _, ids in reader.documents()), np.int64, len(reader.ids))
                ids = pd.array(reader.ids, dtype="Int64")
                ids[reader.ids == NO_ID] = pd.NA
                yield pd.DataFrame({"doc_id": ids, "start": row.start + np.cumsum(reader.sizes) - reader.sizes, "n_tokens": reader.sizes, "ids_crc32": crc})

    return manifest.select("path", "start").repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))).mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_output(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet") if docs is None else docs
    return read_tokens(write_tokens(docs, str(public_tokenizers.path("word_bpe_49k.json")), new_path(spark, "token-ids")))
