"""A hidden Markov language model: Baum-Welch counts added up across partitions, exact scaled forward scores.

Symbols: the ``HEAD`` most frequent training tokens are symbols of their own; every other word is emitted as one of
``TAILS`` tail symbols (by its last letters) and, given the symbol, with probability (c + 0.5) / (sum of c + 0.5 *
(words of the symbol + 1)), where c is its training count and the last 0.5 is for words not seen. So the tables that
are broadcast have a fixed size, while every token of the corpus is counted and every tail word's own count enters
the score through a join by word. A text is its words and an end token.

Training: the start is the symbols' counts in all training documents, disturbed at random by state, with states that
tend to stay; no sample is drawn. Then each of ``ROUNDS`` Baum-Welch rounds runs over every token of all training
documents: tasks compute expected counts by scaled forward and backward recursions and add them up, the sums of the
partitions are added by chunk, and the new tables are broadcast. A text of over ``PIECE`` tokens is worked on in pieces,
between which both recursions are carried over, so it stays one sequence. The score is the forward recursion's exact
likelihood.

Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import NULL_ID, byte_list, groups_of, identified, real_id, split_words, stored

HEAD, TAILS, STATES, ROUNDS = 1 << 15, 1 << 12, 6, 14

#: The end token's code; no word has it but by a chance of 2**-64.
END = -0x5EED

#: Recursions run over groups of documents of similar length, of about so many tokens; longer texts than PIECE go alone.
GROUP, PIECE = 800_000, 1 << 16

#: Tokens of a partition's documents that are grouped together, over its batches.
TOGETHER = 4_000_000

#: Steps between two scalings.
SCALED = 8


def held_out(column: str = "doc_id") -> Column:
    return F.crc32(F.col(column).cast("string")) % 5 == 1


def word_codes(texts: list[bytes]):
    """The codes of each text's words and end: 52 bits of hash, then 12 that name the tail symbol, by last letters."""
    for lo, hi in groups_of(texts):
        h, cuts = split_words(texts[lo:hi], ending_bits=TAILS.bit_length() - 1)
        h = h.view(np.int64)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield np.append(h[a:b], END)


def _counted(batches):
    """Codes and counts, added up in the task."""
    keys, counts, parts, size = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), [], 0

    def added():
        own, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (keys[:0], counts[:0])
        both, where = np.unique(np.concatenate([keys, own]), return_inverse=True)
        return both, np.bincount(where, np.concatenate([counts, n]), minlength=len(both)).astype(np.int64)

    def emit():
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["h", "c"])

    for batch in batches:
        for codes in word_codes(byte_list(batch.column(1))):
            parts.append(codes)
            size += len(codes)
            if size > 1_000_000:
                keys, counts = added()
                parts, size = [], 0
                if len(keys) > 600_000:
                    yield emit()
                    keys, counts = keys[:0], counts[:0]
    keys, counts = added()
    if len(keys):
        yield emit()


class Vocabulary:
    """The head's codes, sorted, with their symbols and what they and the tail symbols weigh."""

    def __init__(self, codes: np.ndarray, symbols: np.ndarray, head_log: np.ndarray, tail_log: np.ndarray):
        self.codes, self.symbols, self.head_log, self.tail_log = codes, symbols, head_log, tail_log

    def encode(self, codes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.codes, codes)
        at[at == len(self.codes)] = 0
        return np.where(self.codes[at] == codes, self.symbols[at], len(self.head_log) + (codes & (TAILS - 1)))


def _encoded(vocabulary):
    """Per document: symbols, the codes of its tail words and how often each is there, and the parts of its scores
    that tables of fixed size give: the head's base score, and the logarithms of the tail symbols' masses."""

    def scan(batches):
        v = vocabulary.value
        for batch in batches:
            rows = []
            for doc_id, codes in zip(batch.column(0).to_pylist(), word_codes(byte_list(batch.column(1))), strict=True):
                symbols = v.encode(codes)
                tail = symbols >= len(v.head_log)
                h, n = np.unique(codes[tail], return_counts=True)
                n_tail = int(tail.sum())
                rows.append((doc_id, symbols.astype("<u2").tobytes(), h.tobytes(), n.astype("<i4").tobytes(), len(codes), n_tail, float(v.head_log[symbols[~tail]].sum()), float(v.tail_log[symbols[tail] - len(v.head_log)].sum())))
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["doc_id", "symbols", "tails", "times", "n_tokens", "n_tail", "head_base", "tail_mass"])

    return scan


class Tables:
    """Start (K), move (K x K) and emit (symbols x K) probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @staticmethod
    def of(start: np.ndarray, move: np.ndarray, emit: np.ndarray, base: np.ndarray) -> Tables:
        """From expected counts; emissions are smoothed towards the symbols' shares, which keeps every one possible."""
        emit = emit + 50.0 * base[:, None] + 1e-3 * base[:, None] * emit.sum(axis=0)
        return Tables((start + 1) / (start + 1).sum(), (move + 1) / (move + 1).sum(axis=1, keepdims=True), (emit / emit.sum(axis=0)).astype(np.float32))


def groups(docs: list[np.ndarray]):
    """Numbers of documents, longest first, in groups of similar length."""
    order = sorted(range(len(docs)), key=lambda n: -len(docs[n]))
    held: list[int] = []
    for n in order:
        longest = len(docs[held[0]]) if held else 0
        if held and (len(held) * longest > GROUP or len(docs[n]) * 2 < longest or longest > PIECE >= len(docs[n])):
            yield held
            held = []
        held.append(n)
    if held:
        yield held


class Recursions:
    """Scaled forward and backward recursions, a step for all documents of a group at once.

    Rows stand longest first, so at step t the first ``alive[t]`` rows go on; a table has a line for each token, by step
    and then by row. Forward probabilities are scaled every ``SCALED`` steps, in which they can't vanish: for learning,
    emissions are first divided by the symbol's largest.
    """

    def __init__(self, tables: Tables, learn: bool):
        kind = np.float32 if learn else np.float64
        self.learn, self.a, self.start = learn, tables.move.astype(kind), tables.start.astype(kind)
        self.emission, self.top = tables.emit.astype(kind), None
        if learn:
            self.top = self.emission.max(axis=1)
            self.emission /= np.where(self.top > 0, self.top, 1)[:, None]
            k = len(self.start)
            self.counts = np.zeros(k), np.zeros((k, k)), np.zeros((len(self.emission), k))

    def forward(self, docs: list[np.ndarray], first: np.ndarray):
        """(log-likelihoods, last forward probabilities, tables) of documents, longest first; ``first`` has each row's
        state probabilities before its first token. The tables (forward, emissions with scales) are for learning."""
        sizes = np.array([len(d) for d in docs])
        alive = len(docs) - np.searchsorted(sizes[::-1], np.arange(sizes[0]), side="right")
        cuts = np.concatenate([[0], np.cumsum(alive)])
        symbols = np.empty(cuts[-1], dtype=np.int64)
        for row, d in enumerate(docs):
            symbols[cuts[: len(d)] + row] = d
        b, at, logs, last = np.take(self.emission, symbols, axis=0), cuts.tolist(), np.zeros(len(docs)), np.empty_like(first)
        held = np.empty_like(b) if self.learn else None
        now = first
        for t in range(len(alive)):
            lo, hi = at[t], at[t + 1]
            n = hi - lo
            if t:
                now = now[:n] @ self.a
            now = np.multiply(now, b[lo:hi], out=held[lo:hi] if self.learn else None)
            if t % SCALED == SCALED - 1:
                s = now.sum(axis=1)
                logs[:n] += np.log(s)
                now /= s[:, None]
                if self.learn:
                    b[lo:hi] /= s[:, None]
            if t + 2 == len(at) or at[t + 2] - hi < n:  # rows that end here
                end = at[t + 2] - hi if t + 2 < len(at) else 0
                last[end:n] = now[end:]
        logs += np.log(last.sum(axis=1))
        if self.learn:
            rows = np.arange(cuts[-1]) - np.repeat(cuts[:-1], alive)
            logs += np.bincount(rows, np.log(self.top[symbols]), minlength=len(docs))
        return logs, last, (symbols, alive, cuts, held, b)

    def backward(self, sizes: np.ndarray, last: np.ndarray, state: tuple, after: np.ndarray) -> np.ndarray:
        """Adds the expected counts; ``after`` has each row's backward probabilities at its end. Returns, by row, the
        first token's emissions times its backward probabilities."""
        symbols, alive, cuts, alpha, b = state
        beta, at = np.empty_like(alpha), cuts.tolist()
        beta[cuts[sizes - 1] + np.arange(len(sizes))] = after / (last * after).sum(axis=1)[:, None]
        back = np.ascontiguousarray(self.a.T)
        for t in range(len(alive) - 2, -1, -1):
            lo, mid, hi = at[t], at[t + 1], at[t + 2]
            right = b[mid:hi]
            right *= beta[mid:hi]
            np.matmul(right, back, out=beta[lo : lo + hi - mid])
        start, move, emit = self.counts
        before = np.arange(cuts[1], cuts[-1]) - np.repeat(alive[:-1], alive[1:])
        for k in range(0, len(before), 1 << 16):  # sums of single precision, in parts
            move += np.take(alpha, before[k : k + (1 << 16)], axis=0).T @ b[cuts[1] + k : cuts[1] + k + (1 << 16)] * self.a
        gamma = np.multiply(alpha, beta, out=alpha)
        for k in range(len(self.start)):
            emit[:, k] += np.bincount(symbols, gamma[:, k], minlength=len(emit))
        self.first_gamma = gamma[: alive[0]].sum(axis=0)
        return b[: alive[0]] * beta[: alive[0]]

    def whole(self, docs: list[np.ndarray]) -> np.ndarray:
        first = np.broadcast_to(self.start, (len(docs), len(self.start)))
        logs, last, state = self.forward(docs, first)
        if self.learn:
            self.backward(np.array([len(d) for d in docs]), last, state, np.ones_like(last))
            self.counts[0][:] += self.first_gamma
        return logs

    def in_pieces(self, doc: np.ndarray) -> float:
        """A long document, with both recursions carried from piece to piece."""
        pieces = [doc[i : i + PIECE] for i in range(0, len(doc), PIECE)]
        firsts, ends, total = [self.start[None, :]], [], 0.0
        for piece in pieces:
            logs, last, _ = self.forward([piece], firsts[-1])
            total += float(logs[0])
            ends.append(last / last.sum())
            firsts.append(ends[-1] @ self.a)
        if self.learn:
            after = np.ones_like(self.start)[None, :]
            for n in range(len(pieces) - 1, -1, -1):
                _, last, state = self.forward([pieces[n]], firsts[n])
                right = self.backward(np.array([len(pieces[n])]), last, state, after)
                if n:
                    step = ends[n - 1].T @ right * self.a
                    self.counts[1][:] += step / step.sum()
                    after = right @ self.a.T
                    after /= after.sum()
            self.counts[0][:] += self.first_gamma
        return total


def recursions(tables: Tables, docs: list[np.ndarray], learn: bool):
    """(log-likelihoods, expected counts or None) of symbol sequences."""
    work, out = Recursions(tables, learn), np.zeros(len(docs))
    for group in groups(docs):
        if len(docs[group[0]]) > PIECE:
            for n in group:
                out[n] = work.in_pieces(docs[n])
        else:
            out[group] = work.whole([docs[n] for n in group])
    return out, work.counts if learn else None


def _together(batches):
    """(symbols of each document, batches) of some ``TOGETHER`` tokens, so that a step of the recursions has many rows."""
    docs, held, size = [], [], 0
    for batch in batches:
        own = [np.frombuffer(x, dtype="<u2") for x in batch.column("symbols").to_pylist()]
        more = sum(map(len, own))
        if held and size + more > TOGETHER:
            yield docs, held
            docs, held, size = [], [], 0
        docs += own
        held.append(batch)
        size += more
    if held:
        yield docs, held


def _expected(tables):
    """Baum-Welch counts of one partition, in chunks of symbols; the last chunk has start and move."""

    def scan(batches):
        total = None
        for docs, _ in _together(batches):
            _, counts = recursions(tables.value, docs, True)
            total = counts if total is None else tuple(x + y for x, y in zip(total, counts, strict=True))
        if total is not None:
            start, move, emit = total
            parts = np.array_split(emit, 16)
            rows = [(n, zlib.compress(p.astype("<f4").tobytes(), 1)) for n, p in enumerate(parts)] + [(16, zlib.compress(np.concatenate([start, move.reshape(-1)]).astype("<f4").tobytes(), 1))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["chunk", "counts"])

    return scan


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(zlib.decompress(c), dtype="<f4").astype(np.float64) for c in table.column("counts").to_pylist())
    return pa.table({"chunk": table.column("chunk").slice(0, 1), "counts": pa.array([total.astype("<f8").tobytes()], pa.binary())})


def started(base: np.ndarray) -> Tables:
    """Tables to start from: the symbols' shares, each disturbed by state, which tells the states apart."""
    rng = np.random.default_rng(7)
    emit, move = base[:, None] * (0.5 + rng.random((len(base), STATES))), np.eye(STATES) * 20 + 1.0
    return Tables(np.full(STATES, 1 / STATES), move / move.sum(axis=1, keepdims=True), (emit / emit.sum(axis=0)).astype(np.float32))


def _scores(tables):
    def scan(batches):
        for docs, held in _together(batches):
            logs, n = recursions(tables.value, docs, False)[0] / math.log(10), 0
            for batch in held:
                yield pa.RecordBatch.from_arrays([pa.array(logs[n : n + len(batch)]), *(batch.column(c) for c in _KEPT)], names=["forward", *_KEPT])
                n += len(batch)

    return scan


_KEPT = ("doc_id", "row", "n_tokens", "n_tail", "head_base", "tail_mass")


def _tails(batches):
    """(row, code, how often) of the documents' tail words."""
    for batch in batches:
        packed = batch.column("tails").to_pylist()
        size = [len(p) // 8 for p in packed]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(batch.column("row").to_numpy(), size)), pa.array(np.frombuffer(b"".join(packed), dtype="<i8")), pa.array(np.frombuffer(b"".join(batch.column("times").to_pylist()), dtype="<i4"))], names=["row", "h", "n"]
        )


def most_frequent(counts: DataFrame, n: int) -> list:
    """The n rows (h, c) with the largest c, ties by smaller h, in that order.

    Histograms first say which rows can be among them, so that the driver gets about n rows and not n of every task.
    """
    c, h = F.col("c"), F.col("h")
    level = F.when(c < 1024, c).otherwise(1024 + F.floor(F.log2(c.cast("double")) * 64)).cast("long")
    least, rest = _bound(counts.groupBy(level.alias("b")).count().collect(), n, -1)
    if least is None:
        return sorted(counts.collect(), key=lambda r: (-r["c"], r["h"]))
    rows = counts.where(level > least).collect()
    edge = counts.where(level == least)
    if least < 1024:  # one count, of which as many may have it as there are words
        place = F.shiftright(h, 50)
        most, _ = _bound(edge.groupBy(place.alias("b")).count().collect(), rest, 1)
        edge = edge.where(place <= most) if most is not None else edge
    return sorted(rows + edge.collect(), key=lambda r: (-r["c"], r["h"]))[:n]


def _bound(histogram: list, n: int, sign: int) -> tuple[int | None, int]:
    """(bin in which the n-th row lies, rows still wanted there), by rising bins, or falling ones with sign -1; the bin
    is None where there are no more than n rows."""
    for row in sorted(histogram, key=lambda r: sign * r["b"]):
        if n <= row["count"]:
            return row["b"], n
        n -= row["count"]
    return None, n


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A-Z are lower-cased; tokens are the words and one end. Null and empty texts are the end token alone. A null doc_id
    belongs to the training rows and comes back as null; rows that repeat a doc_id are scored and learned each; an
    empty table gives no rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    rows = identified(docs, id_col, text_col)
    train = (F.col("doc_id") == NULL_ID) | ~held_out()
    counts = stored(rows.where(train).mapInArrow(_counted, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "word-counts")
    total, distinct, end_count = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("h") == END, F.col("c"))), F.lit(0))).first()
    top = most_frequent(counts.where(F.col("h") != END), HEAD - 1)
    # Where the head is full, its last word says which others are in the tail; ties go by code, as in the order above.
    least, last = (top[-1]["c"], top[-1]["h"]) if len(top) == HEAD - 1 else (0, END)
    tail_words = counts.where((F.col("h") != END) & ((F.col("c") < least) | ((F.col("c") == least) & (F.col("h") > last))))
    sums = {r["tail"]: (r["c"], r["v"]) for r in tail_words.groupBy((F.col("h").bitwiseAND(TAILS - 1)).cast("int").alias("tail")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect()}
    tail_count, tail_kinds = (np.array([sums.get(t, (0, 0))[k] for t in range(TAILS)], dtype=np.float64) for k in (0, 1))
    head_count = np.zeros(HEAD)
    head_count[: len(top) + 1] = [end_count, *(r["c"] for r in top)]
    codes = np.array([END, *(r["h"] for r in top)], dtype=np.int64)
    order = np.argsort(codes)
    denominator = math.log10(total + 0.5 * (distinct + 1))
    vocabulary = spark.sparkContext.broadcast(Vocabulary(codes[order], order, np.log10(head_count + 0.5) - denominator, np.log10(tail_count + 0.5 * (tail_kinds + 1))))
    base = np.concatenate([head_count, tail_count]) + 0.5
    base[len(top) + 1 : HEAD] = 0.0  # symbols that stand for no word
    base /= base.sum()

    encoded = rows.mapInArrow(_encoded(vocabulary), "doc_id long, symbols binary, tails binary, times binary, n_tokens long, n_tail long, head_base double, tail_mass double")
    encoded = stored(encoded.withColumn("row", F.monotonically_increasing_id()), "encoded")
    tables = started(base)
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(tables)
        added = encoded.where(train).select("symbols").mapInArrow(_expected(shared), "chunk int, counts binary").groupBy("chunk").applyInArrow(_added, "chunk int, counts binary")
        parts = {r["chunk"]: np.frombuffer(r["counts"], dtype="<f8") for r in added.collect()}
        if parts:
            k = STATES
            tables = Tables.of(parts[16][:k], parts[16][k:].reshape(k, k), np.concatenate([parts[n].reshape(-1, k) for n in range(16)]), base)
    scored = encoded.select("symbols", *_KEPT).mapInArrow(_scores(spark.sparkContext.broadcast(tables)), "forward double, doc_id long, row long, n_tokens long, n_tail long, head_base double, tail_mass double")

    # A tail word that training rows have adds log10(c + 0.5) to either score; one that they don't, log10(0.5).
    half = math.log10(0.5)
    used = encoded.select("row", "tails", "times").mapInArrow(_tails, "row long, h long, n int")
    own = used.join(tail_words, "h").groupBy("row").agg(F.sum(F.col("n").cast("long")).alias("known"), F.sum(F.col("n") * (F.log10(F.col("c") + 0.5) - half)).alias("gain"))
    out = scored.join(own, "row", "left")
    known, gain = F.coalesce("known", F.lit(0)), F.coalesce("gain", F.lit(0.0)) + F.col("n_tail") * F.lit(half)
    return out.select(
        real_id("doc_id"),
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("n_tokens") - F.col("n_tail") - F.when(F.lit(end_count > 0), 0).otherwise(1) + known).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("head_base") + gain - F.col("n_tail") * F.lit(denominator)).alias("base_score"),
        (F.col("forward") + gain - F.col("tail_mass")).alias("score"),
    )
