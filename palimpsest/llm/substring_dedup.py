"""Repeated passages through suffix automata of reference shards.

A window is ``window`` consecutive words. Winnowing chooses, in every window, the q-gram of words with the smallest
hash (the rightmost of equals), so equal windows always choose an equal q-gram: the anchor. Anchors that occur in two
documents at least are found from packed arrays of hashes and kept in a filter of bounded size; windows whose anchor
is not among them are in one document alone.

The stretch of words that an anchor's windows cover is dealt by anchor: a shard is one anchor's stretches, and copies
of a stretch are added up (smallest document, list of the others) before and after the shuffle. In a shard, distinct
stretches are streamed, smallest document first, through a suffix automaton of the stretches before them: the
matching statistics give, for each word, the longest suffix that an earlier document holds, and where it reaches the
window's length its words are marked; then the automaton is extended by the stretch. Further documents with the same
stretch are marked whole. Maximal marked spans are joined by document and cut out of the text.

Broadcasting each automaton to all documents would stream the corpus once per shard; dealing by anchor brings each
stretch to the one automaton that can match it, with the same result.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import Filter, byte_list, identified, mix, real_id, shuffle_partitions, small_enough, stored, word_hashes

WINDOW, QGRAM = 13, 5
FLUSH = 4_000_000


def anchors(hashes: np.ndarray, window: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each q-gram, and for each window the position of its anchor; (grams, anchor of window, changes)."""
    n = len(hashes) - window + 1
    grams = np.zeros(len(hashes) - q + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(q):
            grams = mix(grams + hashes[j : j + len(grams)] * np.uint64(2 * j + 3)) if j == q - 1 else grams * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + len(grams)]
    best = np.arange(n)
    for j in range(1, window - q + 1):
        best = np.where(grams[j : j + n] <= grams[best], np.arange(j, j + n), best)
    return grams, best, np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))


class SuffixAutomaton:
    """Of word sequences put in one after the other."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def extend(self, words: list[bytes]) -> None:
        last = 0
        for w in words:
            last = self._put(last, w)

    def _put(self, last: int, w: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:  # the generalised case: the transition is there already
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        now = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = now
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[now] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return now

    def _clone(self, p: int, w: bytes, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        twin = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = twin
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = twin
            p = link[p]
        return twin

    def statistics(self, words: list[bytes]) -> list[int]:
        """For each word the length of the longest suffix ending there that the automaton holds."""
        out, state, held = [], 0, 0
        nxt, link, length = self.next, self.link, self.length
        for w in words:
            while state and w not in nxt[state]:
                state = link[state]
                held = length[state]
            if w in nxt[state]:
                state = nxt[state][w]
                held += 1
            else:
                held = 0
            out.append(held)
        return out


def spans_of(stats: list[int], window: int) -> list[tuple[int, int]]:
    """Maximal spans covered by windows that the statistics show."""
    out: list[tuple[int, int]] = []
    for end, held in enumerate(stats, 1):
        if held >= window:
            begin = end - window
            if out and begin <= out[-1][1]:
                out[-1] = (out[-1][0], end)
            else:
                out.append((begin, end))
    return out


def _packed_anchors(window: int, q: int, bits: int):
    """Per task and flush: the distinct anchors of each of 2**bits ranges, and whether two documents have it."""

    def pack(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, count = np.unique(np.concatenate(held), return_counts=True)  # each document gave its own once
        part = (keys >> np.uint64(64 - bits)).astype(np.int64)
        cuts = np.searchsorted(part, np.arange((1 << bits) + 1))
        rows = [(b, keys[lo:hi].tobytes(), np.packbits(count[lo:hi] > 1).tobytes()) for b, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if hi > lo]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["part", "keys", "twice"])

    def scan(batches):
        table, held, n = word_hashes(), [], 0
        for batch in batches:
            for text in byte_list(batch.column(1)):
                words = text.split()
                if len(words) < window:
                    continue
                grams, best, change = anchors(table.of(words), window, q)
                own = np.unique(grams[best[change]])
                held.append(own)
                n += len(own)
                if n > FLUSH:
                    yield pack(held)
                    held, n = [], 0
        if held:
            yield pack(held)

    return scan


def _shared(n_bytes: int):
    """Of one range: the anchors that two documents have, as bits of the filter's block."""

    def merge(table: pa.Table) -> pa.Table:
        keys, twice = [], []
        for k, t in zip(table.column("keys").to_pylist(), table.column("twice").to_pylist(), strict=True):
            own = np.frombuffer(k, dtype=np.uint64)
            keys.append(own)
            twice.append(own[np.unpackbits(np.frombuffer(t, dtype=np.uint8))[: len(own)].astype(bool)])
        found, count = np.unique(np.concatenate([*keys, *twice]), return_counts=True)
        block = int(found[0] >> np.uint64(56))
        return pa.table({"b": pa.array([block], pa.int32()), "bits": pa.array([zlib.compress(Filter.of(found[count > 1], n_bytes), 1)], pa.binary())})

    return merge


def _block(table: pa.Table) -> pa.Table:
    """The ranges of one block together."""
    bits = None
    for packed in table.column("bits").to_pylist():
        own = np.frombuffer(zlib.decompress(packed), dtype=np.uint8)
        bits = own if bits is None else bits | own
    return pa.table({"b": table.column("b").slice(0, 1), "bits": pa.array([zlib.compress(bits.tobytes(), 1)], pa.binary())})


_PIECE = "anchor long, words binary, first_id long, ids binary, starts binary"


def _pieces(shared, window: int, q: int, batch_rows: int = 50_000):
    """The stretches around shared anchors; equal ones of a batch are added up."""

    def emit(held: dict) -> pa.RecordBatch:
        rows = []
        for (anchor, words), (ids, starts) in held.items():
            rows.append((anchor, words, min(ids), np.array(ids, dtype="<i8").tobytes(), np.array(starts, dtype="<i4").tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary()))], names=["anchor", "words", "first_id", "ids", "starts"])

    def scan(batches):
        table, held = word_hashes(), {}
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), byte_list(batch.column(1)), strict=True):
                words = text.split()
                if len(words) < window:
                    continue
                grams, best, change = anchors(table.of(words), window, q)
                at = best[change]
                keys = grams[at]
                ends = np.concatenate([change[1:], [len(best)]]) + window - 1
                for n in np.flatnonzero(shared.value.hits(keys)):
                    begin = int(change[n])
                    key = (int(keys[n].view(np.int64)), b" ".join(words[begin : int(ends[n])]))
                    ids, starts = held.setdefault(key, ([], []))
                    ids.append(doc_id)
                    starts.append(begin)
            if len(held) > batch_rows:
                yield emit(held)
                held = {}
        if held:
            yield emit(held)

    return scan


def _marks(window: int):
    """Streams the pieces, which come sorted by anchor; emits packed (doc_id, begin, end)."""

    def shared_windows(texts: list[list[bytes]]) -> bool:
        """Whether two stretches may hold the same window; where none do, there is nothing for an automaton to match."""
        seen: set[int] = set()
        for words in texts:
            own = {hash(tuple(words[i : i + window])) for i in range(len(words) - window + 1)}
            if not seen.isdisjoint(own):
                return True
            seen |= own
        return False

    def one(stretches: dict[bytes, list]) -> list:
        out = []
        for text, (first, ids, starts) in stretches.items():  # copies of a whole stretch
            if len(ids) > 1 or len(ids[0]) > 1:
                ids, starts = np.concatenate(ids), np.concatenate(starts).astype(np.int64)
                rest = ids > first
                if rest.any():
                    out.append((ids[rest], starts[rest], starts[rest] + text.count(b" ") + 1))
        if len(stretches) == 1 or not shared_windows([t.split(b" ") for t in stretches]):
            return out
        automaton, pending, current = SuffixAutomaton(), [], None
        for text, (first, ids, starts) in sorted(stretches.items(), key=lambda e: (e[1][0], e[0])):
            words = text.split(b" ")
            if first != current:  # what the same document holds doesn't count against it
                for p in pending:
                    automaton.extend(p)
                pending, current = [], first
            if spans := spans_of(automaton.statistics(words), window):
                ids, starts = np.concatenate(ids), np.concatenate(starts).astype(np.int64)
                own = ids == first
                for begin, end in spans:
                    out.append((ids[own], starts[own] + begin, starts[own] + end))
            pending.append(words)
        return out

    def emit(found: list) -> pa.RecordBatch:
        ids, begins, ends = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, dtype=np.int64) for k in range(3))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(begins.astype(np.int32)), pa.array(ends.astype(np.int32))], names=["doc_id", "begin", "end"])

    def stream(batches):
        key, held, found, n = None, {}, [], 0
        for batch in batches:
            for anchor, text, first, ids, starts in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if anchor != key:
                    if held:
                        found += one(held)
                    key, held = anchor, {}
                entry = held.get(text)
                ids, starts = np.frombuffer(ids, dtype="<i8"), np.frombuffer(starts, dtype="<i4")
                n += len(ids)
                if entry is None:
                    held[text] = [first, [ids], [starts]]
                else:
                    entry[0] = min(entry[0], first)
                    entry[1].append(ids)
                    entry[2].append(starts)
            if len(found) > 10_000:
                yield emit(found)
                found = []
        if held:
            found += one(held)
        if found:
            yield emit(found)

    return stream


def _maximal(batches):
    """Joins the overlapping and touching spans of each document."""
    for batch in batches:
        rows = []
        for doc_id, spans in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            begin = spans.values.field("begin").to_numpy()
            order = np.argsort(begin, kind="stable")
            begin, end = begin[order], np.maximum.accumulate(spans.values.field("end").to_numpy()[order])
            new = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]]))
            rows.append((doc_id, np.stack([begin[new], end[np.concatenate([new[1:], [len(end)]]) - 1]], axis=1).astype("<i4").tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["doc_id", "spans"])


def _cut(batches):
    for batch in batches:
        rows = []
        for doc_id, text, spans in zip(batch.column(0).to_pylist(), byte_list(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            words = text.split()
            n = len(words)
            if spans:
                keep = np.ones(n, dtype=bool)
                for begin, end in np.frombuffer(spans, dtype="<i4").reshape(-1, 2):
                    keep[begin:end] = False
                words = [words[i] for i in np.flatnonzero(keep)]
            kept = b" ".join(words)
            rows.append((doc_id, n, n - len(words), hashlib.sha256(kept).hexdigest(), kept))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, spans): the maximal word spans to remove (32-bit begin, end pairs), for the documents that have any."""
    if window < QGRAM:
        raise ValueError(f"a window has {QGRAM} words at least")
    spark = docs.sparkSession
    rows = identified(docs, id_col, text_col)
    n_bytes, bits = Filter.block_bytes(1 << 40), max(8, (shuffle_partitions(spark) - 1).bit_length())
    packed = rows.mapInArrow(_packed_anchors(window, QGRAM, bits), "part int, keys binary, twice binary")
    found = packed.groupBy("part").applyInArrow(_shared(n_bytes), "b int, bits binary")
    found = found.groupBy("b").applyInArrow(_block, "b int, bits binary")
    shared = spark.sparkContext.broadcast(Filter.gathered(found.collect(), n_bytes))
    pieces = rows.mapInArrow(_pieces(shared, window, QGRAM), _PIECE)
    pieces = pieces.repartition(shuffle_partitions(spark), "anchor").sortWithinPartitions("anchor")
    marks = pieces.mapInArrow(_marks(window), "doc_id long, begin int, end int")
    return marks.groupBy("doc_id").agg(F.collect_list(F.struct("begin", "end")).alias("spans")).mapInArrow(_maximal, "doc_id long, spans binary")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, kept (the words that stay, as UTF-8).

    A word goes if a window that covers it also starts in a document with a smaller doc_id; windows are those of the
    input. Null and empty texts have no words. Rows that repeat a doc_id are one document in this sense: none removes
    from another, and the spans found for any of them are cut out of each of them. A null doc_id sorts last and comes
    back as null; an empty table gives no rows; other columns are not looked at.
    """
    rows = identified(docs, id_col, text_col)
    spans = stored(repeated_spans(docs, id_col, text_col, window), "spans")
    out = rows.join(small_enough(spans, size_col="spans"), "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary")
    return out.select(real_id("doc_id"), "n_words", "n_removed", "kept_sha256", "kept")
