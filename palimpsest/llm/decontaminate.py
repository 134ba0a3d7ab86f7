"""Benchmark decontamination by the q-gram lemma.

A benchmark item's windows are its stretches of ``WINDOW`` characters, one from each position (a shorter item is one
window; one under ``LEAST`` characters is only searched for as it is, not inside a longer word). A text holds a window
within k edits only if, around one diagonal, it shares at least m - q + 1 - k * q of the window's q-grams. Shared
q-grams are sorted by document, item, diagonal band and place in the item, in bands that overlap by half, so that every
stretch of k + 1 neighbouring diagonals lies in one band; sliding along the places tells which windows reach the bound
in a band, without an entry for each window. Those are aligned inside the band. The edits of neighbouring windows
differ by one at most, so one alignment decides the windows after it too: with e edits, the next k - e match and, over
the budget, the next e - k - 1 don't. Texts and items are compared lower-cased, with runs of white space as one space.

One pass over the texts, no shuffle. The benchmark is broadcast in blocks of about ``BLOCK_CHARS`` characters; a larger
one takes more passes, each of which adds its regions to the row, with the rows written in between.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import begin, bounded_batches, identified, real_id, stored

Q, WINDOW, RATE, LEAST = 8, 96, 0.1, 32
BLOCK_CHARS = 4_000_000

#: Distance of the bands; each is twice as wide, more than the edits of a window by which a path can leave a diagonal.
STEP = int(WINDOW * RATE) + 1

#: Longer texts are searched in pieces that share ``2 * WINDOW`` characters, more than a window can match.
PIECE_CHARS = 500_000

#: Letters and digits of scripts that part words by spaces.
_LETTER = r"[^\W_\u2e80-\U0010ffff]"

_BASE = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def grams(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the q-gram at each position but the last q - 1."""
    n = len(codes) - Q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    wide = codes.astype(np.uint64)
    out = wide[:n].copy()
    with np.errstate(over="ignore"):
        for j in range(1, Q):
            out *= _BASE
            out += wide[j : j + n]
        return out * _BASE


class Patterns:
    """Benchmark items and the places of their q-grams."""

    def __init__(self, items: list[tuple[int, str]]):
        self.short: list[tuple[int, re.Pattern, str]] = []
        ids, texts = [], []
        for item, text in items:
            said = normal(text)
            if len(said) < LEAST:
                if said:
                    before, after = (f"(?{side}!{_LETTER})" if re.match(_LETTER, edge) else "" for side, edge in (("<", said[0]), ("", said[-1])))
                    self.short.append((item, re.compile(before + re.escape(said) + after), said))
                continue
            ids.append(item)
            texts.append(code_points(said))
        self.item = np.array(ids, dtype=np.int64)
        self.length = np.array([len(t) for t in texts], dtype=np.int64)
        self.codes = np.concatenate(texts) if texts else np.zeros(0, dtype="<u4")
        self.begin = np.cumsum(self.length) - self.length
        self.size = np.minimum(self.length, WINDOW)
        self.budget = (self.size * RATE).astype(np.int64)
        self.least = np.maximum(1, self.size - Q + 1 - self.budget * Q)
        all_grams = [grams(t) for t in texts]
        flat = np.concatenate(all_grams) if texts else np.zeros(0, dtype=np.uint64)
        owner = np.repeat(np.arange(len(texts)), [len(g) for g in all_grams])
        place = np.concatenate([np.arange(len(g)) for g in all_grams]) if texts else np.zeros(0, dtype=np.int64)
        order = np.argsort(flat, kind="stable")
        self.gram, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.owner, self.place = owner[order].astype(np.int32), place[order].astype(np.int32)
        self.table = np.zeros(1 << 22, dtype=bool)
        self.table[(self.gram >> np.uint64(42)).astype(np.int64)] = True

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position in the text, item, place in the item) of each shared q-gram."""
        g = grams(codes)
        where = np.flatnonzero(self.table[(g >> np.uint64(42)).astype(np.int64)])
        k = np.searchsorted(self.gram, g[where])
        k[k == len(self.gram)] = 0
        real = self.gram[k] == g[where]
        where, k = where[real], k[real]
        n = self.count[k]
        at = np.repeat(self.first[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(where, n), self.owner[at].astype(np.int64), self.place[at].astype(np.int64)


def candidates(patterns: Patterns, text: np.ndarray, pos: np.ndarray, item: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, item, first diagonal of a band, lo, hi): windows that begin at lo to hi of the item reach the bound there."""
    shift = int(patterns.length.max()) // STEP + 2  # no band has a number under 0
    band = (pos - place) // STEP + shift
    bands = int(band.max()) + 1
    key = (text * len(patterns.item) + item) * bands
    key = np.concatenate([key + band, key + band - 1])
    place, item = np.concatenate([place, place]), np.concatenate([item, item])
    order = np.lexsort((place, key))
    key, place, item = key[order], place[order], item[order]
    end = np.arange(len(key)) + patterns.least[item] - 1
    inside = end < len(key)
    end[~inside] = 0
    good = np.flatnonzero(inside & (key[end] == key) & (place[end] - place + Q <= patterns.size[item]))
    key, item, lo, hi = key[good], item[good], place[end[good]] + Q - patterns.size[item[good]], place[good]
    lo, hi = np.maximum(0, lo), np.minimum(hi, patterns.length[item] - patterns.size[item])
    key, item, lo, hi = (x[lo <= hi] for x in (key, item, lo, hi))
    if not len(key):
        return key, key, key, key, key
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (lo[1:] > hi[:-1] + 1)]))  # lo and hi rise within a key
    last = np.append(new[1:], len(key)) - 1
    return key[new] // bands // len(patterns.item), item[new], (key[new] % bands - shift) * STEP, lo[new], hi[last]


def banded(pattern: np.ndarray, size: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each pattern against a stretch of its text inside the band, and the diagonal on which it ends.

    pattern: C x m codes (padded), size: real lengths, text: C x (m + band) codes, of which the i-th of the pattern meets
    the i-th and those after it. The first row costs nothing, so the stretch may begin on any diagonal of the band.
    """
    c, width = len(pattern), text.shape[1] - pattern.shape[1]
    step = np.arange(width, dtype=np.int16)
    row = np.zeros((c, width), dtype=np.int16)
    last = row.copy()
    for i in range(pattern.shape[1]):
        new = row + (text[:, i : i + width] != pattern[:, i : i + 1])
        np.minimum(new[:, :-1], row[:, 1:] + 1, out=new[:, :-1])
        row = np.minimum.accumulate(new - step, axis=1) + step
        ends = size == i + 1
        if ends.any():
            last[ends] = row[ends]
    end = last.argmin(axis=1)
    return last[np.arange(c), end].astype(np.int64), end


def sought(patterns: Patterns, whole: list[str]) -> tuple[np.ndarray, ...]:
    """The candidates in normalised texts, by text number."""
    # A separator that is in no window keeps q-grams inside one text.
    codes = code_points("\uffff".join(whole) + "\uffff")
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in whole])])
    pos, item, place = patterns.hits(codes)
    if not len(pos):
        return pos, item, place, place, place
    text, item, diagonal, lo, hi = candidates(patterns, np.searchsorted(begins, pos, side="right") - 1, pos, item, place)
    return text, item, diagonal - begins[text], lo, hi


def aligned(patterns: Patterns, whole: list[str], text: np.ndarray, item: np.ndarray, diagonal: np.ndarray, at: np.ndarray, hi: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(text number, item, begin, end, edits) of candidates that hold a window; a run of windows that match is there
    with its first, its last and some between, which overlap."""
    codes = code_points("\uffff".join(whole) + "\uffff")
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in whole])])
    diagonal = diagonal + begins[text]  # of the text alone before
    out = []
    width = 2 * STEP
    while len(at):
        edits, stop = np.empty(len(at), dtype=np.int64), np.empty(len(at), dtype=np.int64)
        for a in range(0, len(at), 4000):
            t, n, s, d = (x[a : a + 4000] for x in (text, item, at, diagonal))
            spot = (s + d)[:, None] + np.arange(WINDOW + width)
            inside = (spot >= begins[t][:, None]) & (spot < begins[t + 1][:, None] - 1)
            said = np.where(inside, codes[np.clip(spot, 0, len(codes) - 1)], 0x110000)
            own = np.arange(WINDOW)
            pattern = np.where(own < patterns.size[n][:, None], patterns.codes[np.minimum((patterns.begin[n] + s)[:, None] + own, len(patterns.codes) - 1)], 0x110001)
            edits[a : a + 4000], w = banded(pattern, patterns.size[n], said)
            stop[a : a + 4000] = s + d + patterns.size[n] + w
        spare = patterns.budget[item] - edits
        for k in np.flatnonzero(spare >= 0):
            t = int(text[k])
            end = min(int(stop[k] - begins[t]), len(whole[t]))
            out.append((t, int(patterns.item[item[k]]), max(0, end - int(patterns.size[item[k]])), end, int(edits[k])))
        # From a match to the last window that it proves; over the budget to the first that may match.
        ahead = np.where((spare > 0) & (at < hi), np.minimum(at + spare, hi), at + np.maximum(1, -spare))
        go = ahead <= hi
        text, item, diagonal, at, hi = text[go], item[go], diagonal[go], ahead[go], hi[go]
    return out


def _blocks(benchmark: DataFrame) -> Iterator[Patterns]:
    rows = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    held, chars = [], 0
    for r in rows.toLocalIterator():
        held.append((r["item_id"], r["text"]))
        chars += len(r["text"])
        if chars >= BLOCK_CHARS:
            yield Patterns(held)
            held, chars = [], 0
    if held:
        yield Patterns(held)


_SPAN = pa.struct([("item_id", pa.int64()), ("begin", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())])
_SPANS = "array<struct<item_id:long,begin:int,end:int,edits:int>>"


def _merged(found: list[tuple[int, int, int, int]]) -> list[dict]:
    """Overlapping regions of one item become one, with the fewest edits of a window in it."""
    out: list[dict] = []
    for item, begin, end, edits in sorted(found):
        if out and out[-1]["item_id"] == item and begin <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], end)
            out[-1]["edits"] = min(out[-1]["edits"], edits)
        else:
            out.append({"item_id": item, "begin": begin, "end": end, "edits": edits})
    return out


#: Texts are searched in groups of about so many characters, which bounds the arrays whatever a batch holds; texts of
#: about so many with candidates are aligned together, as the steps of an alignment cost the same for few as for many.
GROUP_CHARS, ALIGNED_CHARS = 60_000, 1_000_000


def spans(patterns: Patterns, texts: list[str]) -> list[list[dict]]:
    """The regions of each text."""
    own: list[list] = [[] for _ in texts]
    group: list[tuple[int, int, str]] = []
    pool: list[tuple[int, int, str]] = []
    kept: list[tuple[np.ndarray, ...]] = []
    held = pooled = 0

    def done() -> None:
        nonlocal pooled
        text, *windows = sought(patterns, [g[2] for g in group])
        which, text = np.unique(text, return_inverse=True)
        if len(which):
            kept.append((text + len(pool), *windows))
            pool.extend(group[k] for k in which)
            pooled += sum(len(group[k][2]) for k in which)

    def align() -> None:
        for k, item, begin, end, edits in aligned(patterns, [g[2] for g in pool], *(np.concatenate(x) for x in zip(*kept, strict=True))):
            n, offset, _ = pool[k]
            own[n].append((item, begin + offset, end + offset, edits))

    for n, text in enumerate(map(normal, texts)):
        for item, exact, said in patterns.short:
            if said in text:
                own[n] += [(item, m.start(), m.end(), 0) for m in exact.finditer(text)]
        if not len(patterns.item):
            continue
        for offset in range(0, max(1, len(text)), PIECE_CHARS):
            piece = text[offset : offset + PIECE_CHARS + 2 * WINDOW]
            if held and held + len(piece) > GROUP_CHARS:
                done()
                group, held = [], 0
                if pooled >= ALIGNED_CHARS:
                    align()
                    pool, kept, pooled = [], [], 0
            group.append((n, offset, piece))
            held += len(piece)
    if group:
        done()
    if pool:
        align()
    return [_merged(f) for f in own]


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, contaminated, item_ids, regions (item_id, begin, end, edits).

    Positions are in the normalised text; edits are the fewest of the windows that were aligned. Items under ``LEAST``
    characters are found without edits only. Null and empty texts hold nothing, and null and empty items are in no text;
    a null doc_id comes back as null; repeated rows are searched each; an empty table gives no rows; other columns are
    not looked at.
    """
    out = identified(docs).withColumn("regions", F.array().cast(_SPANS))
    for n, patterns in enumerate(_blocks(benchmark)):
        shared = docs.sparkSession.sparkContext.broadcast(patterns)

        def scan(batches, shared=shared):
            begin("decontaminate")
            for batch in batches:
                found = [r + f for r, f in zip(batch.column(2).to_pylist(), spans(shared.value, batch.column(1).to_pylist()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(_SPAN))], names=["doc_id", "text", "regions"])

        out = (stored(out, "block") if n else out).mapInArrow(scan, f"doc_id long, text string, regions {_SPANS}")
    items = F.array_sort(F.array_distinct(F.transform("regions", lambda r: r["item_id"])))
    return out.select(real_id("doc_id"), (F.size("regions") > 0).alias("contaminated"), items.alias("item_ids"), "regions")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that hold no region of the benchmark; one pass a block, no join."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    for n, patterns in enumerate(_blocks(benchmark)):
        shared = docs.sparkSession.sparkContext.broadcast(patterns)

        def scan(batches, shared=shared):
            begin("decontaminate")
            for batch in batches:
                found = spans(shared.value, [t or "" for t in batch.column(at).to_pylist()])
                yield batch.filter(pa.array([not f for f in found], pa.bool_()))

        docs = (stored(docs, "block") if n else docs).mapInArrow(scan, docs.schema)
    return docs
