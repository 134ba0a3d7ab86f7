"""Exact duplicates through a log-structured merge index of text digests.

Each scan task fills a memtable (digest -> smallest identifier, rows) and flushes it, sorted, as a run with a Bloom
filter; a run is cut by digest range. Compaction merges the run pieces of one range: digests that the filters of the
other runs exclude pass by, the others go through a k-way merge that keeps the smallest identifier and adds the rows.
Documents whose digest the compacted index holds more than once are hits: their bytes are compared with those of the
document that stays, and only equal bytes count. Digests that collide are grouped again by their bytes.

Memtables add up copies before anything is shuffled, so a digest costs one entry a run however hot it is. The byte
check of a large group is dealt over salts: the document that stays is repeated once for every ``SALT`` members.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import begin, byte_list, filter_of, identified, real_id, shuffle_partitions, small_enough, stored

#: Members of a group that one copy of the staying text serves in the byte check.
SALT = 4096

_ODD = re.compile(rb"[\x09-\x0D]|  ")


def normalised(text: bytes) -> bytes:
    """Each run of ASCII white space becomes one space."""
    return re.sub(rb"[\x20\x09-\x0D]+", b" ", text) if _ODD.search(text) else text


def _spots(keys: list[bytes], bits: int) -> np.ndarray:
    """Filter positions, two a key."""
    words = np.frombuffer(b"".join(hashlib.blake2b(k, digest_size=16).digest() if len(k) < 16 else k[:16] for k in keys), dtype="<u8").reshape(-1, 2)
    return (words & np.uint64(bits - 1)).astype(np.int64)


def _flush(mem: dict, run: str, ranges: int, key_bytes: int, bits: int) -> pa.RecordBatch:
    """A sorted run, cut by digest range."""
    rows: dict[str, list] = {k: [] for k in ("range_id", "run", "n", "shas", "ids", "counts", "filter")}
    keys = sorted(mem)
    cuts = [int.from_bytes(k[:2].ljust(2, b"\0"), "big") * ranges >> 16 for k in keys]
    begin = 0
    while begin < len(keys):
        end = begin
        while end < len(keys) and cuts[end] == cuts[begin]:
            end += 1
        part = keys[begin:end]
        seen = np.zeros(bits, dtype=bool)
        seen[_spots(part, bits).reshape(-1)] = True
        rows["range_id"].append(cuts[begin])
        rows["run"].append(run)
        rows["n"].append(len(part))
        rows["shas"].append(b"".join(mem[k][2] for k in part))
        rows["ids"].append(np.array([mem[k][0] for k in part], dtype="<i8").tobytes())
        rows["counts"].append(np.array([mem[k][1] for k in part], dtype="<i8").tobytes())
        rows["filter"].append(np.packbits(seen).tobytes())
        begin = end
    kinds = {"range_id": pa.int32(), "run": pa.string(), "n": pa.int32()}
    return pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.binary())) for k, v in rows.items()})


def _memtables(ranges: int, key_bytes: int, limit: int, bits: int):
    def scan(batches):
        begin("exact_dedup")
        mem: dict[bytes, list] = {}
        part, flushed = TaskContext.get().partitionId(), 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), byte_list(batch.column(1)), strict=True):
                sha = hashlib.sha256(normalised(text)).digest()
                held = mem.get(key := sha[:key_bytes])
                if held is None:
                    mem[key] = [doc_id, 1, sha]
                else:
                    held[1] += 1
                    if doc_id < held[0]:
                        held[0], held[2] = doc_id, sha
                if len(mem) >= limit:
                    yield _flush(mem, f"{part}-{flushed}", ranges, key_bytes, bits)
                    mem, flushed = {}, flushed + 1
        if mem:
            yield _flush(mem, f"{part}-{flushed}", ranges, key_bytes, bits)

    return scan


def _compaction(key_bytes: int):
    def merge(pieces: pa.Table) -> pa.Table:
        runs = []
        for piece in sorted(pieces.to_pylist(), key=lambda p: p["run"]):
            shas = [piece["shas"][i : i + 32] for i in range(0, len(piece["shas"]), 32)]
            runs.append((shas, np.frombuffer(piece["ids"], dtype="<i8").tolist(), np.frombuffer(piece["counts"], dtype="<i8").tolist(), np.unpackbits(np.frombuffer(piece["filter"], dtype=np.uint8)).astype(bool)))
        # What the filters of all earlier runs and of all later ones exclude is in one run alone.
        spots = [_spots([s[:key_bytes] for s in run[0]], len(run[3])) for run in runs]
        alone = [np.ones(len(run[0]), dtype=bool) for run in runs]
        for order in (range(len(runs)), range(len(runs) - 1, -1, -1)):
            seen = np.zeros_like(runs[0][3])
            for k in order:
                alone[k] &= ~seen[spots[k]].all(axis=1)
                seen |= runs[k][3]
        out: list[tuple] = []
        shared = []
        for (shas, ids, counts, _), single in zip(runs, alone, strict=True):
            entries = list(zip(shas, ids, counts, strict=True))
            out += [e for e, s in zip(entries, single, strict=True) if s]
            shared.append([(e[0][:key_bytes], *e) for e, s in zip(entries, single, strict=True) if not s])
        now = None
        for key, sha, doc_id, count in heapq.merge(*shared):
            if now is not None and now[0] == key:
                now[3] += count
                if doc_id < now[2]:
                    now[1], now[2] = sha, doc_id
            else:
                if now is not None:
                    out.append(tuple(now[1:]))
                now = [key, sha, doc_id, count]
        if now is not None:
            out.append(tuple(now[1:]))
        return pa.table({"key": pa.array([e[0][:key_bytes] for e in out], pa.binary()), "keep_id": pa.array([e[1] for e in out], pa.int64()), "group_size": pa.array([e[2] for e in out], pa.int64()), "text_sha256": pa.array([e[0].hex() for e in out], pa.string())})

    return merge


def _key64(key: bytes) -> int:
    return int.from_bytes(key[:8].ljust(8, b"\0"), "big", signed=True)


def _hits(wanted, key_bytes: int):
    """The documents whose digest may be that of a group."""

    def scan(batches):
        begin("exact_dedup")
        for batch in batches:
            texts = [normalised(t) for t in byte_list(batch.column(1))]
            shas = [hashlib.sha256(t).digest() for t in texts]
            keys = np.array([_key64(s[:key_bytes]) for s in shas], dtype=np.int64).view(np.uint64)
            at = np.flatnonzero(wanted.value.hits(keys))
            ids = batch.column(0).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([ids, pa.array([shas[i][:key_bytes] for i in at], pa.binary()), pa.array([shas[i].hex() for i in at], pa.string()), pa.array([texts[i] for i in at], pa.binary())], names=["doc_id", "key", "text_sha256", "bytes"])

    return scan


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_bytes: int = 32, memtable_rows: int = 200_000) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after each run of ASCII white space is one space; null is the empty text.
    Of equal texts the smallest doc_id stays (a null doc_id sorts last and comes back as null); of rows that repeat
    the smallest doc_id one stays. An empty table gives no rows. Other columns are not looked at. ``key_bytes`` is
    how much of the SHA-256 the index holds; with less than 32, collisions occur and are resolved by the bytes.
    """
    spark = docs.sparkSession
    rows = identified(docs, id_col, text_col)
    ranges = shuffle_partitions(spark)
    bits = 1 << max(10, min(20, int(8 * memtable_rows / ranges).bit_length()))
    runs = rows.mapInArrow(_memtables(ranges, key_bytes, memtable_rows, bits), "range_id int, run string, n int, shas binary, ids binary, counts binary, filter binary")
    index = stored(runs.groupBy("range_id").applyInArrow(_compaction(key_bytes), "key binary, keep_id long, group_size long, text_sha256 string"), "lsm-index")
    groups = index.where("group_size > 1").select("key", "keep_id", "group_size")
    total, several = index.agg(F.coalesce(F.sum("group_size"), F.lit(0)), F.count(F.when(F.col("group_size") > 1, 1))).first()
    single = index.where("group_size = 1").select(F.col("keep_id").alias("doc_id"), "keep_id", "group_size", F.lit(True).alias("kept"), "text_sha256")
    if not several:
        return single.select(real_id("doc_id"), real_id("keep_id"), "group_size", "kept", "text_sha256")

    key64 = F.udf(_key64, "long") if key_bytes < 8 else F.conv(F.hex(F.substring("key", 1, 8)), 16, -10).cast("long")
    wanted = spark.sparkContext.broadcast(filter_of(groups.select((key64("key") if key_bytes < 8 else key64).alias("k")), "k", several))
    found = stored(rows.mapInArrow(_hits(wanted, key_bytes), "doc_id long, key binary, text_sha256 string, bytes binary"), "lsm-hits")

    staying = found.join(small_enough(groups), "key").where("doc_id = keep_id")
    staying = staying.groupBy("key", "keep_id", "group_size").agg(F.min_by("bytes", "text_sha256").alias("kept_bytes"), F.min("text_sha256").alias("kept_sha"), F.count(F.lit(1)).alias("rows"))
    # At most 1000 groups hold over a thousandth of the rows each.
    hot = F.broadcast(groups.where(F.col("group_size") > max(SALT, total // 1000)).select("key", F.ceil(F.col("group_size") / SALT).cast("int").alias("salts")))
    members = found.join(hot, "key", "left").withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_sha256"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    served = staying.join(hot, "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    checked = members.join(served, ["key", "salt"]).where(~((F.col("doc_id") == F.col("keep_id")) & (F.col("text_sha256") == F.col("kept_sha"))))
    checked = checked.select("doc_id", "key", "keep_id", "group_size", "text_sha256", (F.col("bytes") == F.col("kept_bytes")).alias("same"))
    again = staying.where("rows > 1").select(F.col("keep_id").alias("doc_id"), "key", "keep_id", "group_size", F.col("kept_sha").alias("text_sha256"), F.explode(F.sequence(F.lit(2), F.col("rows"))).alias("nth")).select("doc_id", "key", "keep_id", "group_size", "text_sha256", F.lit(True).alias("same"))
    if key_bytes < 32:  # rows of the staying doc_id may also differ in text
        again = again.where("false").unionByName(_repeats(found, staying))
    verified = stored(checked.unionByName(again), "lsm-verified")
    kept = index.where("group_size > 1").select(F.col("keep_id").alias("doc_id"), "key", "keep_id", "group_size", "text_sha256", F.lit(True).alias("kept"))
    everyone = kept.unionByName(verified.select("doc_id", "key", "keep_id", "group_size", "text_sha256", F.lit(False).alias("kept")))
    if verified.where("not same").limit(1).count():
        everyone = _by_bytes(everyone, verified, found)
    out = everyone.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").unionByName(single)
    return out.select(real_id("doc_id"), real_id("keep_id"), "group_size", "kept", "text_sha256")


def _repeats(found: DataFrame, staying: DataFrame) -> DataFrame:
    own = found.join(staying.select("key", "keep_id", "group_size", "kept_sha"), "key").where("doc_id = keep_id and text_sha256 = kept_sha")
    n = own.groupBy("doc_id", "key", "keep_id", "group_size", "text_sha256").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    return n.select("doc_id", "key", "keep_id", "group_size", "text_sha256", F.explode(F.sequence(F.lit(2), F.col("rows"))).alias("nth")).select("doc_id", "key", "keep_id", "group_size", "text_sha256", F.lit(True).alias("same"))


def _by_bytes(everyone: DataFrame, verified: DataFrame, found: DataFrame) -> DataFrame:
    """Where a digest stands for different bytes, its documents are grouped by the bytes themselves."""
    torn = verified.where("not same").select("key").distinct()
    rows = found.join(torn, "key", "left_semi")
    sizes = rows.groupBy("key", "bytes").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.first("text_sha256").alias("text_sha256"))
    ids = rows.groupBy("key", "bytes", "doc_id").agg(F.count(F.lit(1)).alias("rows")).join(sizes, ["key", "bytes"])
    ids = ids.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    mended = ids.select("doc_id", "key", "keep_id", "group_size", "text_sha256", ((F.col("doc_id") == F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"))
    return everyone.join(torn, "key", "left_anti").unionByName(mended)


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that stay: one of each text. Rows without doc_id stay."""
    found = exact_dedup(docs, id_col, text_col).where("not kept and doc_id is not null")
    found = stored(found.select(F.col("doc_id").alias(id_col), F.col("text_sha256").alias("__palimpsest_key"), (F.col("doc_id") == F.col("keep_id")).alias("again")), "copies")
    away = small_enough(found.where("not again").select(id_col, "__palimpsest_key").distinct())
    out = docs.withColumn("__palimpsest_key", F.sha2(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+", " "), 256))
    out = out.join(away, [id_col, "__palimpsest_key"], "left_anti").select(*docs.columns, "__palimpsest_key")
    if found.where("again").limit(1).count():
        named = F.col(id_col).isNotNull()
        out = out.where(named).dropDuplicates([id_col, "__palimpsest_key"]).unionByName(out.where(~named))
    return out.select(docs.columns)
