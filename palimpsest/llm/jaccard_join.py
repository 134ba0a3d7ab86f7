"""Jaccard self-join of word shingle sets as a T-occurrence search with DivideSkip.

A set of n shingles links with another at similarity s only if they share T >= s/(1+s) * (n + m) shingles, so at least
one of the n - ceil(s*n) + 1 rarest of each: DivideSkip's short lists, when the T - 1 longest lists are set aside.

1. Each document becomes its sorted shingle hashes, their count, a digest (equal sets are one class, represented by
   its smallest doc_id), a 512-bit parity sketch and, for a larger set, a wide one of about a bit a shingle. A table of
   2**20 counters over all shingles of all documents orders shingles from rare to frequent; it steers the cost only, any
   fixed order gives the same links.
2. The short lists are dealt by shingle range; lists of one document go. In a shard, each query merges its short lists
   up to itself; a candidate must have a size that s allows, and sketches whose differing bits, a lower bound of the
   sets' symmetric difference, allow it too. Up to ``FEW`` candidates are all kept; of more, the one that a hash of the
   pair puts first, which is mostly the same in each shard, so a large group of near copies gives a few candidates a
   query and not all pairs.
3. Candidates are verified by the query, in blocks that each set reaches once: first by the wide sketches, then by the
   shingles. The query's shingles are divided again by their frequency: the lists of the rarer ones are heap-merged, and
   only candidates that they leave a chance are probed for the frequent ones by binary search. Those that reach T are links.
4. Links make components. Queries that had more than ``FEW`` candidates in a shard go on to a further pass there, over
   candidates in other components only, with another hash; nearly all have found their component by then. The shard
   names the lists, few and long ones first, that hold every candidate it left out; no other is read again. When no more
   than ``FULL_PASS`` candidates are left, or after ``PASSES`` passes, all that are still in another component are
   verified, so no link between components is missed.

Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import begin, byte_list, groups_of, identified, mix, real_id, shuffle_partitions, small_enough, split_words, stored
from palimpsest.llm.components import components

COUNTERS, CHUNKS, SKETCH, FEW, PASSES = 1 << 20, 16, 512, 4, 2

#: A shingle's counter is named by its leading bits.
_COUNTER = np.uint64(64 - 20)

#: Candidates that are verified without a further choice.
FULL_PASS = 100_000

#: Postings of a shard, in the mean, at most.
SHARD_POSTINGS = 1_000_000

#: DivideSkip's weight of a binary search against a step of the heap.
MU = 0.0085


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of word hashes; fewer words are one shingle, none have none."""
    if not len(h):
        return np.zeros(0, dtype=np.uint64)
    n = max(1, len(h) - size + 1)
    with np.errstate(over="ignore"):
        out = np.full(n, min(size, len(h)), dtype=np.uint64)
        for j in range(min(size, len(h))):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
    return np.unique(out)


def shingle_sets(texts: list[bytes], size: int):
    """The shingles of each text, A-Z lower-cased."""
    for lo, hi in groups_of(texts):
        h, cuts = split_words(texts[lo:hi])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield shingles(h[a:b], size)


def sketch(tokens: np.ndarray, bits: int = SKETCH) -> bytes:
    """Parity of the number of shingles in each bucket, by the last bits of their hashes; ``bits`` is a power of two."""
    counts = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def wide_sketch(tokens: np.ndarray) -> bytes | None:
    """About a bit a shingle; None where that is no more than the sketch itself has."""
    return sketch(tokens, 1 << (len(tokens) - 1).bit_length()) if len(tokens) > SKETCH else None


def sketches_allow(x: bytes, y: bytes, n: int, m: int, percent: int) -> bool:
    """Whether sets of n and m shingles with these wide sketches can link; the longer sketch is folded."""
    a, b = (np.frombuffer(z, dtype=np.uint64) for z in sorted((x, y), key=len))
    differ = int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)).sum())
    return differ <= n + m - 2 * overlap(n, m, percent)


def short_count(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def overlap(n: int, m: int, percent: int) -> int:
    """The least shared shingles for 100 * shared >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


def _sets(size: int):
    """Per document (doc_id, n, digest, sketch, wide); per task its counters, in chunks."""

    def scan(batches):
        begin("jaccard_join")
        total, held, n = np.zeros(COUNTERS, dtype=np.int64), [], 0

        def add():
            total[:] += np.bincount((np.concatenate(held) >> _COUNTER).astype(np.int64), minlength=COUNTERS)

        for batch in batches:
            rows = []
            for doc_id, tokens in zip(batch.column(0).to_pylist(), shingle_sets(byte_list(batch.column(1)), size), strict=True):
                held.append(tokens)
                n += len(tokens)
                rows.append((doc_id, len(tokens), hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None, sketch(tokens), wide_sketch(tokens), None, None))
                if n > 1_000_000:
                    add()
                    held, n = [], 0
            yield _batch(rows)
        if held:
            add()
        counts = np.minimum(total, 255).astype(np.uint8).reshape(CHUNKS, -1)
        yield _batch([(None, None, None, None, None, k, zlib.compress(c.tobytes(), 1)) for k, c in enumerate(counts) if c.any()])

    def _batch(rows):
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["doc_id", "n", "digest", "sketch", "wide", "chunk", "counts"])

    return scan


def _added(table: pa.Table) -> pa.Table:
    total = np.zeros(COUNTERS // CHUNKS, dtype=np.int64)
    for c in table.column("counts").to_pylist():
        total += np.frombuffer(zlib.decompress(c), dtype=np.uint8)
    rank = np.log2(total + 1).astype(np.uint8)  # frequency classes, each twice the last
    return pa.table({"chunk": table.column("chunk").slice(0, 1), "rank": pa.array([zlib.compress(rank.tobytes(), 1)], pa.binary())})


def _unpacked(ranks: dict[int, bytes]) -> np.ndarray:
    """Frequency classes by counter."""
    rank, w = np.zeros(COUNTERS, dtype=np.uint8), COUNTERS // CHUNKS
    for chunk, packed in ranks.items():
        rank[chunk * w : (chunk + 1) * w] = np.frombuffer(zlib.decompress(packed), dtype=np.uint8)
    return rank


def _short_lists(ranks, size: int, percent: int, parts: int):
    """The rarest shingles of each document, packed by range of shingles."""

    def emit(held):
        tokens, ids, sizes = (np.concatenate(x) for x in zip(*held, strict=True))
        part = ((tokens >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        tokens, ids, sizes = tokens[order], ids[order], sizes[order]
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        rows = [(p, tokens[a:b].tobytes(), ids[a:b].tobytes(), sizes[a:b].tobytes()) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["part", "tokens", "ids", "sizes"])

    def scan(batches):
        begin("jaccard_join")
        held, n = [], 0
        rank = _unpacked(ranks.value)
        for batch in batches:
            for doc_id, tokens in zip(batch.column(0).to_pylist(), shingle_sets(byte_list(batch.column(1)), size), strict=True):
                if not len(tokens):
                    continue
                key = (rank[(tokens >> _COUNTER).astype(np.int64)].astype(np.uint64) << np.uint64(58)) | (tokens >> np.uint64(6))
                own = tokens[np.argsort(key, kind="stable")[: short_count(len(tokens), percent)]]
                held.append((own, np.full(len(own), doc_id, dtype=np.int64), np.full(len(own), len(tokens), dtype=np.int32)))
                n += len(own)
                if n > 1_000_000:
                    yield emit(held)
                    held, n = [], 0
        if held:
            yield emit(held)

    return scan


def _shared(table: pa.Table) -> pa.Table:
    """Postings of the lists with two documents at least."""
    tokens, ids, sizes = (np.concatenate([np.frombuffer(x, dtype=kind) for x in table.column(name).to_pylist()]) for name, kind in (("tokens", np.uint64), ("ids", np.int64), ("sizes", np.int32)))
    _, where, count = np.unique(tokens, return_inverse=True, return_counts=True)
    keep = count[where] > 1
    n = int(keep.sum())
    return pa.table({"part": pa.array(np.full(n, table.column("part")[0].as_py()), pa.int32()), "token": pa.array(tokens[keep].view(np.int64)), "doc_id": pa.array(ids[keep]), "n": pa.array(sizes[keep])})


def _merged(lists: list[np.ndarray]) -> np.ndarray:
    """The distinct members of sorted lists; a few short ones through a heap, longer ones by sorting."""
    if sum(map(len, lists)) <= 64:
        out: list[int] = []
        for x in heapq.merge(*(x.tolist() for x in lists)):
            if not out or out[-1] != x:
                out.append(x)
        return np.array(out, dtype=np.int64)
    return np.unique(np.concatenate(lists))


def _holding(lists: list[np.ndarray], wanted: np.ndarray, mask: np.ndarray) -> list[int]:
    """Which of the lists, long ones first, hold all that is wanted; ``mask`` is False for every member, before and after."""
    mask[wanted], out = True, []
    for k in sorted(range(len(lists)), key=lambda k: -len(lists[k])):
        new = lists[k][mask[lists[k]]]
        if len(new):
            mask[new] = False
            out.append(k)
    return out


def _candidates(percent: int, number: int):
    """Candidate pairs of one shard: (query, other, how many there were, where not all are here), and for a query whose
    candidates are not all here, (query, shingle) of lists that hold the others. Passes after the first (number 0) have
    the queries and lists that are still open and candidates of other components only; the last one, number ``PASSES``,
    keeps every candidate."""

    def shard(table: pa.Table) -> pa.Table:
        token, doc, size = (table.column(k).to_numpy() for k in ("token", "doc_id", "n"))
        ids, first, place = np.unique(doc, return_index=True, return_inverse=True)
        sizes = size[first].astype(np.int64)
        bits = np.frombuffer(b"".join(table.column("sketch").take(pa.array(first)).to_pylist()), dtype=np.uint64).reshape(len(ids), SKETCH // 64)
        group = table.column("root").to_numpy()[first] if number else None
        order = np.lexsort((place, token))
        token, place = token[order], place[order]
        asks = table.column("open").to_numpy(zero_copy_only=False)[order] if number else None
        begins = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        list_of = np.cumsum(np.concatenate([[True], token[1:] != token[:-1]])) - 1
        by_doc = np.argsort(place, kind="stable")
        cuts = np.searchsorted(place[by_doc], np.arange(len(ids) + 1))
        out_a, out_b, out_more, left_a, left_token, mask = [], [], [], [], [], np.zeros(len(ids), dtype=bool)
        for q in range(len(ids)) if asks is None else np.unique(place[asks]):
            at = by_doc[cuts[q] : cuts[q + 1]]
            at = [p for p in (at if asks is None else at[asks[at]]) if p > begins[list_of[p]]]
            lists = [place[begins[list_of[p]] : p] for p in at]  # members below the query
            if not lists:
                continue
            c = lists[0] if len(lists) == 1 else _merged(lists)
            c = c[c != q]  # rows that repeat a doc_id
            n, m = sizes[q], sizes[c]
            c = c[(100 * np.minimum(n, m) >= percent * np.maximum(n, m))]
            if group is not None:
                c = c[group[c] != group[q]]
            if not len(c):
                continue
            m = sizes[c]
            differ = np.bitwise_count(bits[c] ^ bits[q]).sum(axis=1)
            # shared >= T, so the symmetric difference is n + m - 2 T at most
            c = c[differ <= n + m - 2 * -(-percent * (n + m) // (100 + percent))]
            more = len(c) if len(c) > FEW and number < PASSES else 0
            if more:
                # By a hash of the pair: shards agree on it, and the choices of a group make a tree of small degree.
                with np.errstate(over="ignore"):
                    one = [mix(ids[c].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + ids[q : q + 1].view(np.uint64) + np.uint64(number)).argmin()]
                left = _holding(lists, np.delete(c, one), mask)
                left_a += [ids[q]] * len(left)
                left_token += [token[at[k]] for k in left]
                c = c[one]
            out_a += [ids[q]] * len(c)
            out_b += ids[c].tolist()
            out_more += [more] * len(c)
        none = [None] * len(left_a)
        columns = (("a", out_a + left_a), ("b", out_b + none), ("more", out_more + none), ("token", [None] * len(out_a) + left_token))
        return pa.table({name: pa.array(values, pa.int64()) for name, values in columns})

    return shard


def divide_skip(query: np.ndarray, others: list[np.ndarray], percent: int, rank: np.ndarray | None = None) -> list[int]:
    """Which of the others link with the query; all are sorted shingle arrays.

    ``rank`` has the frequency class of each of the query's shingles, by which the long lists are chosen.
    """
    need = [overlap(len(query), len(o), percent) for o in others]
    least = min(need)
    n_long = max(0, min(least - 1, int(least / (MU * math.log2(max(2, len(others))) + 1))))
    order = np.argsort(rank, kind="stable") if rank is not None else np.arange(len(query))
    short, long = np.sort(query[order[: len(query) - n_long]]), query[order[len(query) - n_long :]]
    lists: list[list[int]] = [[] for _ in short]  # of the short ones alone
    for c, tokens in enumerate(others):
        for k in np.flatnonzero(_holds(tokens, short)).tolist():
            lists[k].append(c)
    count: dict[int, int] = {}
    for c in heapq.merge(*(x for x in lists if x)):
        count[c] = count.get(c, 0) + 1
    found = []
    for c, tokens in enumerate(others):
        shared = count.get(c, 0)
        if shared >= need[c] - n_long and shared + int(_holds(tokens, long).sum()) >= need[c]:  # else the long lists can't make up for it
            found.append(c)
    return found


def _holds(tokens: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """Which of the probes are in a sorted array, by binary search."""
    spot = np.searchsorted(tokens, probes)
    spot[spot == len(tokens)] = 0
    return tokens[spot] == probes


def _by_query(pairs: pa.Table):
    """(query, others) with at most 256 others."""
    a, b = pairs.column("a").to_numpy(), pairs.column("b").to_numpy()
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    cuts = np.append(np.flatnonzero(np.diff(a, prepend=a[:1] - 1)), len(a))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        for k in range(lo, hi, 256):
            yield int(a[lo]), b[k : min(hi, k + 256)].tolist()


def _linked(found: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})


def _verified(percent: int, ranks):
    """Searches of one block: each query's candidates by T-occurrence over the sets that came with the block."""

    def check(pairs: pa.Table, members: pa.Table) -> pa.Table:
        rank, found = _unpacked(ranks.value), []
        sets = {i: np.frombuffer(t, dtype=np.uint64) for i, t in zip(members.column("doc_id").to_pylist(), members.column("held").to_pylist(), strict=True)}
        for q, others in _by_query(pairs):
            own = sets[q]
            found += [(q, others[c]) for c in divide_skip(own, [sets[o] for o in others], percent, rank[(own >> _COUNTER).astype(np.int64)])]
        return _linked(found)

    return check


def _not_excluded(percent: int):
    """The pairs of one block that their wide sketches allow."""

    def check(pairs: pa.Table, members: pa.Table) -> pa.Table:
        wide = dict(zip(members.column("doc_id").to_pylist(), zip(members.column("held").to_pylist(), members.column("n").to_pylist(), strict=True), strict=True))
        found = []
        for q, others in _by_query(pairs):
            for o in others:
                (x, n), (y, m) = wide[q], wide[o]
                if x is None or y is None or sketches_allow(x, y, n, m, percent):
                    found.append((q, o))
        return _linked(found)

    return check


def _tokens(size: int):
    def scan(batches):
        begin("jaccard_join")
        for batch in batches:
            sets = [t.tobytes() for t in shingle_sets(byte_list(batch.column(1)), size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary()), pa.array([len(t) // 8 for t in sets], pa.int64())], names=["doc_id", "held", "n"])

    return scan


#: Pairs of one candidate component that stay together, and documents of a block, in the mean.
TOGETHER, BLOCK_DOCS = 4000, 1000


def _checked(pairs: DataFrame, members, check) -> DataFrame:
    """The pairs (a, b) that pass; ``members`` gives (doc_id, held, n) of the documents in a one-column table.

    Pairs are dealt to blocks by the component that they form (a large one by query too), so that what is held of a
    document goes once to a block however many of its pairs are there.
    """
    pairs = pairs.join(components(pairs).withColumnRenamed("node", "a"), "a").select("a", "b", "root")
    parts = pairs.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).cast("int").alias("parts")).where("parts > 1")
    docs = F.explode(F.array("a", "b"))
    involved = stored(pairs.select(docs.alias("doc_id")).distinct(), "involved")
    blocks = max(shuffle_partitions(pairs.sparkSession), involved.count() // BLOCK_DOCS)
    dealt = pairs.join(small_enough(parts), "root", "left")
    dealt = dealt.select("a", "b", F.pmod(F.xxhash64("root", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1)))), F.lit(blocks)).cast("int").alias("block"))
    dealt = stored(dealt, "dealt")
    members = dealt.select("block", docs.alias("doc_id")).distinct().join(members(small_enough(involved)), "doc_id").select(F.col("block").alias("at"), "doc_id", "held", "n")
    return dealt.groupBy("block").cogroup(members.groupBy("at")).applyInArrow(check, "a long, b long")


def _links(rows: DataFrame, sets: DataFrame, ranks, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link: those that the wide sketches, if there are any, allow, verified by their shingles."""
    wide = sets.select("doc_id", F.col("wide").alias("held"), "n")
    allowed = pairs if not wide.where("held is not null").limit(1).count() else stored(_checked(pairs, lambda docs: wide.join(docs, "doc_id", "left_semi").dropDuplicates(["doc_id"]), _not_excluded(percent)), "allowed")
    return _checked(allowed, lambda docs: rows.join(docs, "doc_id", "left_semi").mapInArrow(_tokens(size), "doc_id long, held binary, n long"), _verified(percent, ranks))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, percent: int = 90) -> DataFrame:
    """One row per input row: doc_id, n_shingles, class_id (smallest doc_id with an equal set), component_id.

    Shingles are ``size`` consecutive words, A-Z lower-cased; a text of fewer words is one shingle; documents link
    when 100 * shared >= percent * union. Null, empty and blank texts have no shingles and link with nothing. Rows
    that repeat a doc_id should hold the same text; one of them stands for all in a class. A null doc_id sorts last
    and comes back as null; an empty table gives no rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    rows = identified(docs, id_col, text_col)
    first = stored(rows.mapInArrow(_sets(size), "doc_id long, n long, digest binary, sketch binary, wide binary, chunk int, counts binary"), "sets-and-counts")
    added = first.where("chunk is not null").select("chunk", "counts").groupBy("chunk").applyInArrow(_added, "chunk int, rank binary")
    ranks = spark.sparkContext.broadcast({r["chunk"]: bytes(r["rank"]) for r in added.collect()})
    sets = first.where("chunk is null")
    expected = sets.where("n > 0").agg(F.coalesce(F.sum(F.col("n") * (100 - percent) / 100 + 1), F.lit(0))).first()[0]
    parts = max(shuffle_partitions(spark), math.ceil(expected / SHARD_POSTINGS))
    classes = sets.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("rows"))
    copies = stored(classes.where("rows > 1").select("digest", "class_id"), "classes")
    placed = sets.select("doc_id", "n", "digest").join(small_enough(copies), "digest", "left").select("doc_id", "n", F.coalesce("class_id", "doc_id").alias("class_id"))
    placed = stored(placed, "placed")
    others = placed.where("doc_id <> class_id").select("doc_id")

    short = rows.join(small_enough(others), "doc_id", "left_anti").mapInArrow(_short_lists(ranks, size, percent, parts), "part int, tokens binary, ids binary, sizes binary")
    postings = short.groupBy("part").applyInArrow(_shared, "part int, token long, doc_id long, n int")
    marks = sets.where("n > 0").groupBy("doc_id").agg(F.first("sketch").alias("sketch"))
    postings = stored(postings.join(marks, "doc_id"), "postings")
    links, roots, tested, asking = None, None, None, postings
    number = 0
    while True:
        found = stored(asking.groupBy("part").applyInArrow(_candidates(percent, number), "a long, b long, more long, token long"), "candidates")
        pairs = stored(found.where("token is null").select("a", "b").distinct(), "pairs")
        if tested is not None:  # every hash has first choices of its own
            pairs = stored(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        if not number or pairs.limit(1).count():
            verified = stored(_links(rows, sets, ranks, pairs, size, percent), "verified")
            links = verified if links is None else links.unionByName(verified)
            roots = components(links)
        rest = found.agg(F.sum("more")).first()[0]
        if not rest:
            break
        tested = pairs if tested is None else tested.unionByName(pairs)
        left = found.where("token is not null").select("token", F.col("a").alias("doc_id"), F.lit(True).alias("open"))
        lists = stored(left.select("token").distinct(), "lists")
        postings = stored(postings.join(small_enough(lists), "token", "left_semi"), "postings")  # no later pass needs other lists
        asking = postings.join(small_enough(roots.withColumnRenamed("node", "doc_id")), "doc_id", "left").join(small_enough(left), ["token", "doc_id"], "left")
        asking = asking.withColumn("root", F.coalesce("root", "doc_id")).withColumn("open", F.coalesce("open", F.lit(False)))
        number = PASSES if rest <= FULL_PASS else number + 1
    out = placed.join(small_enough(roots.withColumnRenamed("node", "class_id")), "class_id", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), "class_id", F.coalesce("root", "class_id").alias("component_id"))
    return out.select(real_id("doc_id"), "n_shingles", real_id("class_id"), real_id("component_id"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows, with all their columns, whose doc_id is the smallest of its component."""
    found = jaccard_join(docs, size=size, percent=percent)
    gone = stored(found.where("doc_id <> component_id").select("doc_id").distinct(), "near-copies")
    return docs.join(small_enough(gone), "doc_id", "left_anti").select(docs.columns)

