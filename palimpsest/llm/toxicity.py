"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Examples are a bounded sample of the labelled training rows (``EXAMPLES`` of each label, by a hash of doc_id). Terms
are all words of the examples. A text's vector is (1 + ln tf) * idf * evidence over those terms, where a word's evidence
is its chi-square against the labels as a part of ``CHI2``, 1 at most; similarity is the exact cosine of two such
vectors. The inverted index holds, per term, its postings cut into blocks of example numbers, and each block's largest
weight; lists that reach nearly every block are held as rows. A search adds up the rows, then visits the blocks whose
upper bound reaches the ``K``-th best so far, so it returns exactly the nearest examples; examples are numbered by their
most frequent word and length, which keeps those of one language in the same blocks. The nearest vote with weight 1 / (1 - cosine + 0.1), and a logistic
curve fitted on the examples' own leave-one-out votes, which tasks search for, weighted back to the labels' shares,
makes votes into probabilities. A text without any word of the examples has the share of toxic rows among such examples.

Scoring is one pass over the texts, with a model of bounded size. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import begin, byte_list, groups_of, identified, real_id, shuffle_partitions, split_words, stored

EXAMPLES, CHI2, K, BLOCK = 4096, 40.0, 16, 64

#: Bytes of words: letters, and all bytes of other scripts.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[ord("a") : ord("z") + 1] = True
LETTERS[0x80:] = True


def counted(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, word hash, count), in order of text and hash."""
    h, cuts = split_words(texts, word=LETTERS)
    kinds, which = np.unique(h, return_inverse=True)
    key, n = np.unique(np.repeat(np.arange(len(texts)), np.diff(cuts)) * max(1, len(kinds)) + which, return_counts=True)
    owner, which = np.divmod(key, max(1, len(kinds)))
    return owner, kinds[which], n


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each range, one range after the other."""
    ends = np.cumsum(size)
    return np.repeat(begin - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


class BlockMaxIndex:
    """Postings of unit vectors by term and example. A run is the postings of one term in one block of ``BLOCK``
    examples; the runs' largest weights bound what a block can score. Lists that hold an eighth of all examples or
    more reach every block and are kept as rows instead, a weight for each example, which are added up whole."""

    def __init__(self, size: int, terms: int, example: np.ndarray, term: np.ndarray, weight: np.ndarray):
        self.size, self.blocks = size, max(1, -(-size // BLOCK))
        often = np.flatnonzero(8 * np.bincount(term, minlength=terms) >= max(8, size))
        self.row = np.full(terms, -1, dtype=np.int32)
        self.row[often] = np.arange(len(often))
        self.rows = np.zeros((len(often), self.blocks * BLOCK))
        dense = self.row[term] >= 0
        self.rows[self.row[term[dense]], example[dense]] = weight[dense]
        example, term, weight = example[~dense], term[~dense], weight[~dense]
        order = np.lexsort((example, term))
        run = term[order] * self.blocks + example[order] // BLOCK
        begin = np.flatnonzero(np.diff(run, prepend=-1))
        self.example, self.weight = example[order].astype(np.int32 if size > 32_767 else np.int16), weight[order]
        self.begin = np.append(begin, len(run)).astype(np.int32)
        self.block = (run[begin] % self.blocks).astype(np.int32 if size > 32_767 else np.int16)
        self.most = np.maximum.reduceat(self.weight, begin) if len(begin) else np.zeros(0)
        self.first = np.searchsorted(run[begin], np.arange(terms + 1) * self.blocks).astype(np.int32)  # a term's runs

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(similarities, examples) of the k best, best first, ties by smaller number; similarities over 0 only.

        The query is its terms, rising, and their weights.
        """
        row = self.row[terms]
        dense = row >= 0
        score = weights[dense] @ self.rows[row[dense]]
        if without >= 0:
            score[without] = 0
        terms, weights = terms[~dense], weights[~dense]
        n = self.first[terms + 1] - self.first[terms]
        runs, weight = ranges(self.first[terms], n), np.repeat(weights, n)
        block = self.block[runs]
        # What the rows give is a lower bound of a score; with the runs' largest weights, an upper bound of a block's.
        least = np.partition(score, -k)[-k] if self.size >= k else 0.0
        bound = np.bincount(block, weight * self.most[runs], minlength=self.blocks)
        chosen = bound + score.reshape(self.blocks, BLOCK).max(axis=1) >= least - 1e-12
        here = chosen[block]
        runs, weight = runs[here], weight[here]
        begin = self.begin[runs]
        n = self.begin[runs + 1] - begin
        at = ranges(begin, n)
        score += np.bincount(self.example[at], np.repeat(weight, n) * self.weight[at], minlength=len(score))
        if without >= 0:
            score[without] = 0
        found = np.flatnonzero((score > 0) & (score >= least - 1e-11))
        if len(found) > k:
            found = found[score[found] >= np.partition(score[found], -k)[-k] - 1e-11]
        found = found[np.lexsort((found, -np.round(score[found], 12)))][:k]
        return score[found], found


def vote(near: np.ndarray, labels: np.ndarray, prior: float) -> float:
    """The share of toxic votes; near: similarities, labels: of the same examples."""
    weights = 1 / (1.1 - np.minimum(1.0, near))
    return float((weights @ labels + prior) / (weights.sum() + 1))


def fitted_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression of y on x by Newton steps, with a small ridge."""
    a = np.array([1.0, 0.0])
    data = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(data @ a, -30, 30)))
        step = np.linalg.solve((data * (w * p * (1 - p) + 1e-9)[:, None]).T @ data + 1e-3 * np.eye(2), data.T @ (w * (y - p)) - 1e-3 * (a - [1.0, 0.0]))
        a += step
        if np.abs(step).max() < 1e-8:
            break
    return float(a[0]), float(a[1])


def logit(p: float) -> float:
    p = min(1 - 1e-6, max(1e-6, p))
    return math.log(p / (1 - p))


class Model:
    """Terms and index of the examples, and the labels' shares."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, example: np.ndarray, words: np.ndarray, counts: np.ndarray, toxic_share: float):
        """Example number, word hash and count of each word of each example; toxic_share: of all labelled training rows."""
        order = self._order(len(ids), example, words, counts)
        self.ids, self.labels, self.share = ids[order], labels[order], toxic_share
        example = np.argsort(order, kind="stable")[example]
        self.keys, term = np.unique(words, return_inverse=True)
        n = [int(np.sum(labels == y)) for y in (0, 1)]
        a, b = (np.bincount(term, self.labels[example] == y, minlength=len(self.keys)) for y in (1, 0))
        c, d = n[1] - a, n[0] - b
        total = (a + b) * (c + d) * n[1] * n[0]
        chi2 = (a * d - b * c) ** 2 * (n[0] + n[1]) / np.where(total > 0, total, 1) * (total > 0)
        self.weight = (np.log((1 + len(ids)) / (1 + a + b)) + 1) * np.minimum(1.0, chi2 / CHI2)
        owner, at, weight = self._vectors(len(ids), example, term, counts)
        self.index = BlockMaxIndex(len(ids), len(self.keys), owner, at, weight)
        self.by_label = np.array([(1 - toxic_share) / max(1, n[0]), toxic_share / max(1, n[1])])
        bare = self.labels[np.bincount(owner, minlength=len(ids)) == 0]
        self.without = (self.by_label[1] * np.sum(bare) + 1e-4 * toxic_share) / (self.by_label[bare].sum() + 1e-4) if len(ids) else toxic_share

    @staticmethod
    def _order(n: int, example: np.ndarray, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Examples by their most frequent word and their length."""
        by = np.lexsort((words, -counts, example))
        first = by[np.flatnonzero(np.diff(example[by], prepend=-1))]
        lead = np.zeros(n, dtype=np.uint64)
        lead[example[first]] = words[first]
        return np.lexsort((np.arange(n), np.bincount(example, counts, minlength=n), lead))

    def _vectors(self, n: int, owner: np.ndarray, term: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit vectors as (owner, term, weight); owners and, within them, terms rise."""
        by = np.lexsort((term, owner))
        owner, term, weight = owner[by], term[by], (1 + np.log(counts[by])) * self.weight[term[by]]
        real = weight > 0
        owner, term, weight = owner[real], term[real], weight[real]
        norm = np.sqrt(np.bincount(owner, weight * weight, minlength=n))
        return owner, term, weight / norm[owner]

    def votes(self, n: int, owner: np.ndarray, words: np.ndarray, counts: np.ndarray, without: list[int] | None = None) -> list[tuple[float | None, np.ndarray, np.ndarray]]:
        """(vote, similarities, examples) of each of n texts, given by text number, word hash and count of each word;
        the vote is None for a text without a vector. ``without`` has the doc_id that each text may not meet."""
        kinds, which = np.unique(words, return_inverse=True)
        at = np.searchsorted(self.keys, kinds)
        at[at == len(self.keys)] = 0
        term = np.where(self.keys[at] == kinds, at, -1)[which] if len(self.keys) else np.full(len(words), -1)
        known = term >= 0
        owner, term, weight = self._vectors(n, owner[known], term[known], counts[known])
        cuts = np.searchsorted(owner, np.arange(n + 1))
        by_id = np.argsort(self.ids)
        out: list[tuple[float | None, np.ndarray, np.ndarray]] = []
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if a == b:
                out.append((None, np.zeros(0), np.zeros(0, dtype=np.int64)))
                continue
            own = -1 if without is None else int(by_id[np.searchsorted(self.ids, without[k], sorter=by_id)])
            near, who = self.index.nearest(term[a:b], weight[a:b], K, own)
            out.append((vote(near, self.labels[who], self.share), near, who))
        return out

    def calibrated(self, votes: dict[int, float]) -> tuple[float, float]:
        """The curve that the examples' own votes, by doc_id, give."""
        number = {int(i): k for k, i in enumerate(self.ids)}
        own = sorted(votes)
        if len(own) < 2:
            return 1.0, 0.0
        y = self.labels[[number[i] for i in own]]
        return fitted_logistic(np.array([logit(votes[i]) for i in own]), y.astype(float), self.by_label[y] * len(self.ids))

    def scores(self, texts: list[bytes], curve: tuple[float, float]) -> list[tuple[float, list[tuple[float, int]]]]:
        """Of each text the probability and the nearest examples as (similarity, doc_id)."""
        out = []
        for lo, hi in groups_of(texts):
            for p, near, who in self.votes(hi - lo, *counted(texts[lo:hi])):
                x = curve[0] * logit(p) + curve[1] if p is not None else logit(self.without)
                out.append((1 / (1 + math.exp(-max(-30.0, min(30.0, x)))), [(float(s), int(self.ids[n])) for s, n in zip(near[:3], who[:3], strict=True)]))
        return out


def held_out(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string")) % 5 == 0


def _counted(batches):
    """Each example's word hashes and counts, packed."""
    begin("toxicity")
    for batch in batches:
        texts, packed = byte_list(batch.column(2)), []
        for lo, hi in groups_of(texts):
            owner, words, counts = counted(texts[lo:hi])
            cuts = np.searchsorted(owner, np.arange(hi - lo + 1))
            packed += [(words[a:b].tobytes(), counts[a:b].astype("<i4").tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([p[k] for p in packed], pa.binary()) for k in (0, 1))], names=["doc_id", "label", "words", "counts"])


def _unpacked(words: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, word hash, count) of packed ones."""
    owner = np.repeat(np.arange(len(words)), [len(w) // 8 for w in words])
    return owner, np.frombuffer(b"".join(words), dtype=np.uint64), np.frombuffer(b"".join(counts), dtype="<i4").astype(np.int64)


def learn(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> tuple[Broadcast, tuple[float, float]]:
    """(model, curve) of a bounded sample: at most ``examples`` training rows of each label.

    Labels without doc_id or toxic are left out; of several for one document the highest counts. A label whose
    document is missing is left out too; of rows that repeat a doc_id one text counts. Without any label the score is
    0.5 for every text.
    """
    spark = docs.sparkSession
    rows = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("label"))
    rows = rows.where(~held_out()).groupBy("doc_id").agg(F.max("label").alias("label"))
    n, toxic = rows.agg(F.count("label"), F.coalesce(F.sum("label"), F.lit(0))).first()
    order = (F.xxhash64("doc_id"), "doc_id")
    sample = rows.where("label = 1").orderBy(*order).limit(examples).unionByName(rows.where("label = 0").orderBy(*order).limit(examples))
    found = identified(docs).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    found = stored(found.mapInArrow(_counted, "doc_id long, label int, words binary, counts binary"), "examples")
    held = sorted((r["doc_id"], r["label"], bytes(r["words"]), bytes(r["counts"])) for r in found.toLocalIterator())
    owner, words, counts = _unpacked([h[2] for h in held], [h[3] for h in held])
    shared = spark.sparkContext.broadcast(Model(np.array([h[0] for h in held], dtype=np.int64), np.array([h[1] for h in held], dtype=np.int64), owner, words, counts, (toxic + 0.5) / (n + 1)))

    def own(batches):
        begin("toxicity")
        for batch in batches:
            packed = _unpacked(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            votes = shared.value.votes(batch.num_rows, *packed, batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v[0] for v in votes], pa.float64())], names=["doc_id", "vote"])

    votes = found.select("doc_id", "words", "counts").repartition(shuffle_partitions(spark)).mapInArrow(own, "doc_id long, vote double").where("vote is not null").collect()
    return shared, shared.value.calibrated({r["doc_id"]: r["vote"] for r in votes})


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, neighbours (doc_id, similarity; the nearest three).

    Null and empty texts have the score of texts without evidence; a null doc_id comes back as null; repeated rows
    are scored each; an empty table gives no rows; other columns are not looked at.
    """
    model, curve = learn(docs, labels)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64())]))

    def scan(batches):
        begin("toxicity")
        m = model.value
        for batch in batches:
            found = m.scores(byte_list(batch.column(1)), curve)
            near = [[{"doc_id": d, "similarity": s} for s, d in f[1]] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.float64()), pa.array(near, kind)], names=["doc_id", "score", "neighbours"])

    out = identified(docs).mapInArrow(scan, "doc_id long, score double, neighbours array<struct<doc_id:long,similarity:double>>")
    out = out.select(real_id("doc_id"), "score", "neighbours")
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "neighbours")


def without_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose score is under 0.5; one pass, no join."""
    model, curve = learn(docs, labels)
    at = docs.columns.index(text_col)

    def scan(batches):
        begin("toxicity")
        m = model.value
        for batch in batches:
            yield batch.filter(pa.array([p < 0.5 for p, _ in m.scores(byte_list(batch.column(at)), curve)], pa.bool_()))

    return docs.mapInArrow(scan, docs.schema)
