"""Best-fit packing of documents into sequences, in bulk-synchronous steps.

Documents are cut into pieces of at most ``capacity`` tokens. Pieces of one length are interchangeable, and so are
sequences with one fill, so the sorted sides of the sweep are held as runs (length, how many) and (gap, how many): at
most ``capacity`` runs of pieces, whatever the input. A step takes the longest pieces not yet placed and, in a sweep
over the sorted gaps, gives them the successor: the smallest gap that takes the length. Piece number r of the run goes
to gap number r of the run (rank decides who gets which), the gaps shrink, and the rest of the run sweeps on; when no
gap is left that takes it, new sequences open. That is best-fit decreasing, whole runs at a time.

The rows themselves are ranked once, within (length, part of a hash of the document), so that a length which a third
of all pieces share is still dealt over all tasks, and each row reads its place from the runs' intervals of ranks.
"""

from __future__ import annotations

import os
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import begin, byte_list, identified, per_operator, real_id, shuffle_partitions, small_enough, stored


class WordIds(dict):
    """Token ids (packed, unsigned 32-bit) by white-space word; the memory is bounded.

    The vocabulary's pre-tokeniser never joins what ASCII white space parts, so a text's ids are those of its words.
    It lower-cases, so A-Z may be lower-cased first, except where a text could hold a special token's string; and it
    parts a word of letters from the marks that end it. Words of letters are new to the table hundreds at a time and
    are encoded in one string: each of them ends in the one id whose token carries the end-of-word mark.
    """

    LIMIT, TOGETHER = 400_000, 512
    MARKS = b".,;:!?"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(self.tokenizer.get_vocab_size())])

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: set[bytes]) -> None:
        """Puts in the words that aren't there."""
        letters, others, marked = set(), [], []
        for word in words:
            stem = word.rstrip(self.MARKS)
            if not stem.decode().lower().isalpha():
                others.append(word)
                continue
            if len(stem) < len(word):
                marked.append((word, stem, word[len(stem) :]))
                if marked[-1][2] not in self:
                    self[marked[-1][2]] = array("I", self._encoded([marked[-1][2].decode()])[0]).tobytes()
            if stem not in self:
                letters.add(stem)
        alone = sorted(letters)
        chunks = [alone[i : i + self.TOGETHER] for i in range(0, len(alone), self.TOGETHER)]
        for chunk, ids in zip(chunks, self._encoded([b" ".join(c).decode() for c in chunks]), strict=True):
            ids = np.array(ids, dtype="<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(chunk) and cuts[-1] == len(ids):
                self.update(zip(chunk, (x.tobytes() for x in np.split(ids, cuts[:-1])), strict=True))
            else:
                others += chunk
        for word, ids in zip(others, self._encoded([w.decode() for w in others]), strict=True):
            self[word] = array("I", ids).tobytes()
        for word, stem, marks in marked:
            self[word] = self[stem] + self[marks]

    def of(self, texts: list[bytes]) -> list[bytes]:
        split = [(t if b"<|" in t else t.lower()).split() for t in texts]
        if new := set().union(*split).difference(self.keys()):
            self.learn(new)
        out = [b"".join(map(self.__getitem__, words)) for words in split]
        while len(self) > self.LIMIT:  # the latest go: frequent words come early
            self.popitem()
        return out


@per_operator
def word_ids(path: str) -> WordIds:
    """One table a worker process, kept from task to task."""
    return WordIds(path)


def _in_groups(words: WordIds, texts: list[bytes], size: int = 1 << 22) -> Iterator[bytes]:
    """The texts' ids, worked on in groups of a few megabytes."""
    group: list[bytes] = []
    held = 0
    for text in texts:
        group.append(text)
        held += len(text)
        if held >= size:
            yield from words.of(group)
            group, held = [], 0
    yield from words.of(group)


def _pieces(path: str, capacity: int, end_id: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("packing")
        words, end = word_ids(path), array("I", [end_id]).tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), _in_groups(words, byte_list(batch.column(1))), strict=True):
                ids += end
                for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + capacity)]
                    rows.append((doc_id, piece, start, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def best_fit_runs(lengths: dict[int, int], capacity: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: where intervals of ranks begin, the sequence of the first rank of each, and the offset there."""
    gaps: list[int] = []  # distinct gaps, sorted
    runs: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, how many)
    opened = 0
    plan: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def put(gap: int, first: int, count: int) -> None:
        if gap > 0:
            if gap not in runs:
                runs[gap] = []
                insort(gaps, gap)
            runs[gap].append((first, count))

    for length in sorted(lengths, reverse=True):
        left, rank, out = lengths[length], 0, []
        while left:
            at = bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                first, count = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap]
                    gaps.pop(at)
            else:  # so many sequences as the rest of the run fills
                gap, first, count = capacity, opened, -(-left // (capacity // length))
                opened += count
            took = min(left, count)
            out.append((rank, first, capacity - gap))
            put(gap - length, first, took)
            if took < count:
                put(gap, first + took, count - took)
            rank, left = rank + took, left - took
        plan[length] = tuple(np.array(x, dtype=np.int64) for x in zip(*out, strict=True))
    return plan


def _places(plan):
    def place(batches):
        begin("packing")
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(rank), dtype=np.int64), np.empty(len(rank), dtype=np.int64)
            for x in np.unique(length):
                begins, firsts, offsets = plan.value[int(x)]
                own = np.flatnonzero(length == x)
                at = np.searchsorted(begins, rank[own], side="right") - 1
                sequence[own], offset[own] = firsts[at] + rank[own] - begins[at], offsets[at]
            keep = [batch.column(k) for k in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep[:3], keep[3].cast(pa.int64()), keep[4], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return place


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and then ``end_id``; only a longer one than ``capacity`` is cut. Null and empty texts
    are ``end_id`` alone; a null doc_id comes back as null; rows that repeat a doc_id are packed each for itself; an
    empty table gives no rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    cut = identified(docs, id_col, text_col).mapInArrow(_pieces(tokenizer, capacity, end_id), "doc_id long, piece int, start long, length int, ids_crc32 long")
    pieces = stored(cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int")), "pieces")
    counts = stored(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    plan = spark.sparkContext.broadcast(best_fit_runs({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    within = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = pieces.withColumn("within", within).join(small_enough(before), ["length", "part"]).withColumn("rank", F.col("within") + F.col("before"))
    out = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_places(plan), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.select(real_id("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
