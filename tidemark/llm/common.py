"""Helpers that several corpus operators share."""

from __future__ import annotations

import re
import uuid
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one Arrow batch holds; long texts stay bounded by ``slices`` below.
ARROW_ROWS = 512
#: UTF-8 bytes of text that a task works on at once (a longer single text is a slice of its own).
SLICE_BYTES = 2 << 20


def arrow_rows(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Keep Arrow batches small, as texts may be long."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); a local one of our own only if unset and all is local."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        path = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them again."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(uri: str):
    """pyarrow file system and path of a URI or plain path."""
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        if urlparse(uri).scheme == "file":
            return fs.LocalFileSystem(), urlparse(uri).path
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (relative to them) of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges of at most ``limit`` bytes, or of one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


class Generations:
    """A bounded memo: at ``cap`` new entries the older half goes. It only saves work, never changes a result."""

    def __init__(self, cap: int = 300_000) -> None:
        self.cap, self.young, self.old = cap, {}, {}

    def fill(self, keys, make) -> dict:
        """``young`` with every key in it; ``make(list)`` gives the values of the missing ones."""
        young, old = self.young, self.old
        missing = [k for k in keys if k not in young]
        if missing:
            if len(young) + len(missing) > self.cap and young:
                self.old, self.young = young, {}
                return self.fill(keys, make)
            new = []
            for k in missing:
                if k in old:
                    young[k] = old[k]
                else:
                    new.append(k)
            if new:
                young.update(zip(new, make(new)))
        return young


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of int32, compressed by byte planes."""
    import zstandard

    flat = np.concatenate(arrays).astype("<i4")
    head = np.array([len(arrays), *map(len, arrays)], "<i8").tobytes()
    return head + zstandard.ZstdCompressor(level=1).compress(flat.view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked(blob: bytes) -> list[np.ndarray]:
    import zstandard

    k = int(np.frombuffer(blob[:8], "<i8")[0])
    sizes = np.frombuffer(blob[8 : 8 + 8 * k], "<i8")
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8 + 8 * k :]), np.uint8).reshape(4, -1)
    return np.split(np.ascontiguousarray(planes.T).view("<i4").ravel(), np.cumsum(sizes)[:-1])


def by_id_range(docs: DataFrame, key: str, partitions: int, descending: bool = False) -> DataFrame:
    """Rows in partitions that hold ascending (or descending) ranges of ``key``, sorted inside; nulls come last."""
    order = F.col(key).desc_nulls_last() if descending else F.col(key).asc_nulls_last()
    return docs.repartitionByRange(partitions, order).sortWithinPartitions(order)


def partitions_of(docs: DataFrame, least: int = 12, each: int = 64 << 20) -> int:
    """Shuffle partitions for whole texts: what the session is set to, ``least`` at least, and enough for about ``each`` bytes of text in one."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(least, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-total // each))


def hot_split(table: DataFrame, weight: str, parts: int = 1000, small: int = 20_000) -> tuple[DataFrame, DataFrame | None]:
    """``table`` without its column ``weight``: rows that have a share of 1 / ``parts`` of its sum or more (so ``parts`` at most), and the others.

    A table of at most ``small`` rows is all given first, and None.
    """
    rows, total = table.agg(F.count("*"), F.sum(F.col(weight).cast("double"))).first()
    if rows <= small:
        return table.drop(weight), None
    hot = F.coalesce(F.col(weight) * float(parts) >= total, F.lit(False))
    return table.filter(hot).drop(weight), table.filter(~hot).drop(weight)


def hot_join(large: DataFrame, hot: DataFrame, others: DataFrame | None, keys: str | list[str], how: str = "inner") -> DataFrame:
    """``large`` joined (``how``: inner or left) to a table with a row for each key, cut by ``hot_split`` at the number of rows that a key has in ``large``.

    The rows of hot keys stay where they are, as those keys are few and broadcast; so no key of the shuffle has a large part of the rows.
    """
    keys = [keys] if isinstance(keys, str) else keys
    if others is None:
        return large.join(F.broadcast(hot), keys, how)
    rest = large.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return large.join(F.broadcast(hot), keys).unionByName(rest.join(others, keys, how))


def crc_mod(column: str, mod: int):
    """crc32 of an id as text, modulo ``mod``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % mod


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` (case apart) has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (base is odd)."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            have = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b % 2**64, np.uint64))]) for b in (base, pow(base, -1, 2**64)))
        _POWERS[base] = have
    return have
