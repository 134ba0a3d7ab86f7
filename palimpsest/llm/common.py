"""What the training-data operators share: the shared work folder, Arrow access, bounded filters and hot keys."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null identifier inside an operator: null sorts after every real one.
NULL_ID = (1 << 63) - 1

#: At most so many rows are broadcast; beyond that the join shuffles.
BROADCAST_ROWS = 500_000

#: And at most so many bytes of a column of varying length.
BROADCAST_BYTES = 32 << 20

#: A filter never takes more bits than this (8 MiB), whatever the input.
FILTER_BITS = 1 << 26


#: Whole texts go to Python in batches of at most so many rows.
BATCH_ROWS = 2000


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's number of rows in an Arrow batch to ``BATCH_ROWS``: a worker holds a batch several times over,
    and texts are long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share.

    The folder is the one in ``spark.checkpoint.dir``. Where it is unset (tests, one machine) a temporary folder is
    made and set; on any other master that is an error, because executors would not see it.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/palimpsest/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows to the shared folder and reads them back: cuts lineage and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def small_enough(df: DataFrame, limit: int = BROADCAST_ROWS, size_col: str | None = None) -> DataFrame:
    """The table marked for broadcast if its row count, which is checked, is within the limit; else as it is.

    Where rows can be long, ``size_col`` names the long column, whose bytes may be ``BROADCAST_BYTES`` at most.
    """
    if size_col:
        rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(size_col)), F.lit(0))).first()
        return F.broadcast(df) if rows <= limit and size <= BROADCAST_BYTES else df
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def id_column(name: str):
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID)).alias("doc_id")


def real_id(name: str):
    return F.when(F.col(name) != NULL_ID, F.col(name)).alias(name)


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text), whatever other columns there are; null text is empty and a null identifier sorts last."""
    bounded_batches(docs.sparkSession)
    return docs.select(id_column(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def byte_list(column: pa.Array) -> list[bytes]:
    """The column's values as bytes, nulls as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


class WordHashes(dict):
    """64-bit hash by word; the memory is bounded: frequent words come early and stay."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.LIMIT and len(word) < 64:
            self[word] = found
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


_TABLES, _AT_WORK = [], [""]


def per_operator(table):
    """A table that a worker process keeps from task to task, until a task of another operator begins."""
    _TABLES.append(cache(table))
    return _TABLES[-1]


def begin(operator: str) -> None:
    """Called where a task starts: a worker process outlives a stage, so the tables of the operator before go, and memory
    that was freed goes back to the system, which Python's and Arrow's allocators keep otherwise."""
    if _AT_WORK[0] != operator:
        _AT_WORK[0] = operator
        for table in _TABLES:
            table.cache_clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


@per_operator
def word_hashes() -> WordHashes:
    """One table a worker process, kept from task to task."""
    return WordHashes()


_LOWER = bytes(range(256)).lower()

#: Bytes that are part of words, where words are what ASCII white space parts.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Texts are split in stretches of about so many bytes, which bounds the arrays; groups of texts are as long.
STRETCH = 1 << 20


@cache
def _byte_codes() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@cache
def _place_codes(n: int) -> np.ndarray:
    return mix(np.arange(n, dtype=np.uint64) + np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def groups_of(texts: list[bytes], size: int = STRETCH):
    """(begin, end) of runs of texts of about ``size`` bytes together; a longer text is a run of its own."""
    begin, held = 0, 0
    for n, text in enumerate(texts):
        if held and held + len(text) > size:
            yield begin, n
            begin, held = n, 0
        held += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def _stretches(data: bytes, word: np.ndarray):
    """(begin, end) of pieces of about ``STRETCH`` bytes that part no word."""
    at = 0
    while at < len(data):
        end, step = min(len(data), at + STRETCH), 4096
        while end < len(data) and word[data[end - 1]]:  # on to the end of the word
            ahead = np.flatnonzero(~word[np.frombuffer(data, dtype=np.uint8, count=min(step, len(data) - end), offset=end)])
            end, step = (end + int(ahead[0]) + 1, 0) if len(ahead) else (min(len(data), end + step), step * 2)
        yield at, end
        at = end


_MARK = np.zeros(256, dtype=bool)
_MARK[list(b".,;:!?")] = True


def _endings(part: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The last three bytes of each word, without the marks that end it, as a number."""
    last = np.maximum.accumulate(np.where(_MARK[part], -1, np.arange(len(part), dtype=np.int64)))[end - 1]
    out = np.zeros(len(begin), dtype=np.uint64)
    for back in range(3):
        at = last - back
        out = (out << np.uint64(8)) | np.where(at >= begin, part[np.maximum(at, 0)], 0).astype(np.uint64)
    return out


def split_words(texts: list[bytes], lower: bool = True, word: np.ndarray = NOT_SPACE, ending_bits: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, cuts): a 64-bit hash of each word of each text, in order; words cuts[n] to cuts[n + 1] are of text n.

    Words are runs of the bytes that ``word`` marks; ``lower`` lower-cases A-Z first. A word's hash is the sum, over its
    bytes, of the byte's code times the place's code, spread at the end. With ``ending_bits``, so many last bits are
    instead a hash of the word's last three bytes before the marks that end it.
    """
    data = b" ".join(texts) + b" "
    if lower:
        data = data.translate(_LOWER)
    hashes, begins = [], []
    codes = _byte_codes()
    for at, end in _stretches(data, word):
        part = np.frombuffer(data, dtype=np.uint8, count=end - at, offset=at)
        inside = word[part]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edge = np.concatenate([[0], edge])
        if len(edge) & 1:
            edge = np.append(edge, len(part))
        begin, size = edge[::2], edge[1::2] - edge[::2]
        if not len(begin):
            continue
        first = np.cumsum(size) - size
        place = np.arange(first[-1] + size[-1], dtype=np.int32) - np.repeat(first.astype(np.int32), size)
        longest = 1 << int(size.max()).bit_length()
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(codes[part[inside]] * _place_codes(longest)[place], first)
            found = mix(sums + size.astype(np.uint64))
        if ending_bits:
            found = (found >> np.uint64(ending_bits) << np.uint64(ending_bits)) | (mix(_endings(part, begin, begin + size) + np.uint64(1)) >> np.uint64(64 - ending_bits))
        hashes.append(found)
        begins.append(begin + at)
    if not hashes:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return np.concatenate(hashes), np.searchsorted(np.concatenate(begins), np.concatenate([[0], ends]))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift), to spread bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Filter:
    """A Bloom filter of bounded size, made of blocks: a key's leading bits choose the block.

    Each block is filled by one task from the keys of its range, so no task or driver ever holds more than the
    filter itself. When the keys outgrow the bound, more of what is not in the set passes; nothing in it is lost.
    """

    BLOCKS = 256

    def __init__(self, bits: np.ndarray):
        self.bits = bits  # BLOCKS x bytes

    @staticmethod
    def block_bytes(keys: int) -> int:
        return max(32, min(FILTER_BITS, 1 << int(max(1, keys * 12)).bit_length()) // Filter.BLOCKS // 8)

    @staticmethod
    def of(keys: np.ndarray, n_bytes: int) -> bytes:
        """The block that holds these keys."""
        out = np.zeros(n_bytes * 8, dtype=bool)
        for place in Filter._places(keys, n_bytes):
            out[place] = True
        return np.packbits(out, bitorder="little").tobytes()

    @staticmethod
    def _places(keys: np.ndarray, n_bytes: int):
        h = mix(keys)
        for shift in (0, 20, 40):
            yield ((h >> np.uint64(shift)) % np.uint64(n_bytes * 8)).astype(np.int64)

    def hits(self, keys: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(0, dtype=bool)
        n = self.bits.shape[1]
        flat, base = self.bits.reshape(-1), (keys >> np.uint64(56)).astype(np.int64) * n
        found = np.ones(len(keys), dtype=bool)
        for place in self._places(keys, n):
            found &= (flat[base + (place >> 3)] >> (place & 7).astype(np.uint8)) & 1 == 1
        return found


def filter_of(df: DataFrame, key: str, count: int) -> Filter:
    """The filter of a column of longs (read as unsigned 64-bit keys); ``count`` rows at most are expected."""
    n_bytes = Filter.block_bytes(count)

    def block(table: pa.Table) -> pa.Table:
        keys = table.column("k").to_numpy().view(np.uint64)
        return pa.table({"b": pa.array([int(keys[0] >> np.uint64(56))], pa.int32()), "bits": pa.array([zlib.compress(Filter.of(keys, n_bytes), 1)], pa.binary())})

    keyed = df.select(F.col(key).alias("k"), F.shiftrightunsigned(F.col(key), 56).cast("int").alias("b"))
    return Filter.gathered(keyed.groupBy("b").applyInArrow(block, "b int, bits binary").collect(), n_bytes)


def _gathered(rows, n_bytes: int) -> Filter:
    bits = np.zeros((Filter.BLOCKS, n_bytes), dtype=np.uint8)
    for row in rows:
        bits[row["b"]] = np.frombuffer(zlib.decompress(bytes(row["bits"])), dtype=np.uint8)
    return Filter(bits)


Filter.gathered = staticmethod(_gathered)
