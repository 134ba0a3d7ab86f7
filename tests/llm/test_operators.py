"""Each operator against brute force, an exact round trip or held-out accuracy, and on odd rows."""

import functools
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from palimpsest.llm import chat_format, common, decontaminate, exact_dedup, hmm_lm, jaccard_join, packing, quality, substring_dedup, toxicity, warc
from palimpsest.llm.components import components

SCHEMA = "doc_id long, text string, lang string, key string, n long"
VOCAB = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def table(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "k", 7) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(VOCAB) + str(rng.randint(0, 60)) for _ in range(n))
    out = [(i, text(rng.randint(1, 120))) for i in range(120)]
    for i in range(120, 200):  # near and exact copies
        words = rng.choice(out)[1].split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = "edit" + str(rng.randint(0, 9))
        out.append((i, rng.choice([" ", "  ", "\n"]).join(words)))
    passage = text(30)
    out += [(200 + i, f"{text(20)} {passage} {text(5)}") for i in range(30)]
    return out


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "One"), (5, "one"), (6, "two words"), (7, "x " * 30_000), (8, None), (9, "two words")]


def sets_of(text, size):
    words = (text or "").encode().lower().split()
    return {tuple(words)} if 0 < len(words) < size else {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute_components(rows, size, percent):
    sets = {i: sets_of(t, size) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80), (2, 60)])
def test_jaccard_join(spark, corpus, size, percent):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_join(table(spark, corpus), size=size, percent=percent).collect()}
    assert got == brute_components(corpus, size, percent)


@pytest.mark.parametrize("full_pass", [100_000, 20])
def test_jaccard_join_large_groups(spark, monkeypatch, full_pass):
    """Near copies in a chain and more than a few candidates a query."""
    monkeypatch.setattr(jaccard_join, "FULL_PASS", full_pass)
    rng = random.Random(9)
    base = [rng.choice(VOCAB) + str(rng.randint(0, 99)) for _ in range(100)]
    rows = []
    for i in range(60):
        words = list(base)
        for k in range(rng.randint(0, 3)):
            words[rng.randrange(100)] = f"e{i}-{k}"
        rows.append((i, " ".join(words)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_join(table(spark, rows)).collect()}
    assert got == brute_components(rows, 3, 90)


def test_jaccard_join_rereads_few_lists(spark, monkeypatch):
    """Later passes read lists that hold candidates which a shard left out, not all lists of an open query."""
    monkeypatch.setattr(jaccard_join, "FULL_PASS", 20)
    read, real = [], jaccard_join.stored

    def told(df, name):
        out = real(df, name)
        if name == "postings":
            read.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "stored", told)
    rng = random.Random(11)
    rows = []
    for g in range(4):
        base = [rng.choice(VOCAB) + str(rng.randint(0, 99)) for _ in range(300)]
        for i in range(30):
            words = list(base)
            for k in range(rng.randint(0, 6)):
                words[rng.randrange(300)] = f"e{g}-{i}-{k}"
            rows.append((g * 30 + i, " ".join(words)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_join(table(spark, rows)).collect()}
    assert got == brute_components(rows, 3, 90)
    assert len(read) > 1 and read[1] * 3 < read[0], read


def test_holding():
    """The lists that are named hold every candidate that was left out."""
    rng = np.random.default_rng(8)
    for _ in range(100):
        lists = [np.sort(rng.choice(50, rng.integers(1, 12), replace=False)) for _ in range(rng.integers(1, 9))]
        held = np.unique(np.concatenate(lists))
        wanted, mask = held[rng.random(len(held)) < 0.6], np.zeros(50, dtype=bool)
        named = jaccard_join._holding(lists, wanted, mask)
        assert set(wanted.tolist()) <= {x for k in named for x in lists[k].tolist()}
        assert len(named) == len(set(named)) <= len(wanted) and not mask.any()


def test_jaccard_join_odd(spark):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_join(table(spark, ODD)).collect()}
    assert got == brute_components(ODD, 3, 90)
    assert jaccard_join.jaccard_join(table(spark, [])).count() == 0


def test_divide_skip():
    rng = np.random.default_rng(3)
    for _ in range(50):
        q = np.unique(rng.integers(0, 300, 120).astype(np.uint64))
        others = [np.unique(np.concatenate([rng.permutation(q)[: rng.integers(1, len(q) + 1)], rng.integers(0, 400, rng.integers(0, 20)).astype(np.uint64)])) for _ in range(6)]
        want = [n for n, o in enumerate(others) if 100 * len(np.intersect1d(q, o)) >= 80 * len(np.union1d(q, o))]
        assert jaccard_join.divide_skip(q, others, 80) == want
        assert jaccard_join.divide_skip(q, others, 80, rng.integers(0, 9, len(q))) == want


def test_sketches_exclude_no_link():
    rng = np.random.default_rng(4)
    hits = 0
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 62, rng.integers(520, 3000)).astype(np.uint64))
        b = np.unique(np.concatenate([rng.permutation(a)[: int(len(a) * rng.uniform(0.7, 1))], rng.integers(0, 1 << 62, rng.integers(0, 200)).astype(np.uint64)]))
        if len(b) <= 512:
            continue
        allowed = jaccard_join.sketches_allow(jaccard_join.wide_sketch(a), jaccard_join.wide_sketch(b), len(a), len(b), 90)
        shared = len(np.intersect1d(a, b))
        linked = 100 * shared >= 90 * (len(a) + len(b) - shared)
        assert allowed or not linked
        hits += allowed and not linked
    assert hits < 60


@pytest.mark.parametrize("one_task", [500_000, 10])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr("palimpsest.llm.components.ONE_TASK", one_task)
    rng = random.Random(2)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1200)]
    from palimpsest.llm.components import union_find

    want = {k: v for k, v in union_find(*zip(*links, strict=True)).items() if k != v}
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want


def brute_dedup(rows):
    norm = lambda t: exact_dedup.normalised((t or "").encode())
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    return sorted((i, min(groups[norm(t)]), len(groups[norm(t)]), i == min(groups[norm(t)]), hashlib.sha256(norm(t)).hexdigest()) for i, t in rows)


@pytest.mark.parametrize("key_bytes,memtable", [(32, 200_000), (32, 7), (1, 50)])
def test_exact_dedup(spark, corpus, key_bytes, memtable):
    rows = corpus + [(1000 + i, t) for i, t in ODD]
    got = exact_dedup.exact_dedup(table(spark, rows), key_bytes=key_bytes, memtable_rows=memtable)
    assert sorted(tuple(r) for r in got.collect()) == brute_dedup(rows)


def test_exact_dedup_repeated_and_null_ids(spark):
    rows = [(1, "a b"), (1, "a b"), (2, "a  b"), (None, "a b"), (None, "c")]
    got = exact_dedup.exact_dedup(table(spark, rows)).collect()
    assert Counter((r["doc_id"], r["kept"], r["group_size"]) for r in got) == Counter({(1, True, 4): 1, (1, False, 4): 1, (2, False, 4): 1, (None, False, 4): 1, (None, True, 1): 1})
    assert exact_dedup.exact_dedup(table(spark, [])).count() == 0
    left = exact_dedup.without_copies(table(spark, rows))
    assert left.columns == ["doc_id", "text", "lang", "key", "n"]
    assert Counter(r["doc_id"] for r in left.collect())[1] == 1


def test_language_model(spark, corpus):
    rows = corpus + [(1000 + i, t) for i, t in ODD]
    got = {r["doc_id"]: r for r in hmm_lm.score(table(spark, rows)).collect()}
    tokens = {i: (t or "").encode().lower().split() + [None] for i, t in rows}
    counts = Counter(w for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in t)
    total = sum(counts.values())
    for i, t in tokens.items():
        r = got[i]
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (len(counts) + 1))) for w in t), rel=1e-9)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(counts[w] > 0 for w in t), total)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 1)
        assert -1e9 < r["score"] < 0
    assert hmm_lm.score(table(spark, [])).count() == 0


def test_language_model_learns_from_every_token(spark):
    """Against Baum-Welch in one place: more documents than a sample would hold, and words after token 4,096."""
    import numpy as np

    rng = random.Random(9)
    topics = VOCAB[:10], VOCAB[10:]
    rows = [(i, " ".join(rng.choice(topics[i % 2]) for _ in range(3))) for i in range(1900)]
    rows += [(5000 + i, "x " * 4096 + " ".join(rng.choice(topics[n // 40 % 2]) for n in range(2000))) for i in range(6)]
    got = {r["doc_id"]: r["score"] for r in hmm_lm.score(table(spark, rows)).collect()}
    words = {i: t.split() for i, t in rows}
    train = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    counts = Counter(w for i in train for w in words[i])
    code = {w: int(next(hmm_lm.word_codes([w.encode()]))[0]) for w in counts}
    symbol = {w: n + 1 for n, w in enumerate(sorted(counts, key=lambda w: (-counts[w], code[w])))}
    base = np.full(hmm_lm.HEAD + hmm_lm.TAILS, 0.5)
    base[: len(counts) + 1] += [len(train), *(counts[w] for w in symbol)]
    base[len(counts) + 1 : hmm_lm.HEAD] = 0
    base /= base.sum()
    docs = {i: np.array([symbol[w] for w in words[i]] + [0]) for i in words}
    tables = hmm_lm.started(base)
    for _ in range(14):
        _, found = hmm_lm.recursions(tables, [docs[i] for i in train], True)
        tables = hmm_lm.Tables.of(*found, base)
    want, _ = hmm_lm.recursions(tables, list(docs.values()), False)
    for i, w in zip(docs, want, strict=True):
        assert got[i] == pytest.approx(w / math.log(10), rel=2e-3)


def test_recursions_carry_over_pieces(monkeypatch):
    """A long text's likelihood and counts are the same in one piece and in many."""
    rng = np.random.default_rng(5)
    k, symbols = 4, 50
    one = lambda *shape: (lambda x: x / x.sum(axis=-1, keepdims=True))(rng.random(shape) ** 4)
    tables = hmm_lm.Tables(one(k), one(k, k), one(k, symbols).T.astype(np.float64))
    docs = [rng.integers(0, symbols, n) for n in (1000, 3, 333, 64, 65, 1)]
    whole, counts = hmm_lm.recursions(tables, docs, True)
    exact, _ = hmm_lm.recursions(tables, docs, False)
    monkeypatch.setattr(hmm_lm, "PIECE", 64)
    parts, own = hmm_lm.recursions(tables, docs, True)
    assert parts == pytest.approx(whole, rel=1e-4) and hmm_lm.recursions(tables, docs, False)[0] == pytest.approx(exact, rel=1e-9)
    for x, y in zip(counts, own, strict=True):
        assert y == pytest.approx(x, rel=1e-3, abs=1e-3)


@pytest.mark.parametrize("n", [1, 50, 400, 2000])
def test_most_frequent(spark, n):
    """Ties at the border, by smaller code, among small and large counts."""
    rng = random.Random(n)
    rows = list({rng.randrange(-(1 << 63), 1 << 63): rng.choice([1, 1, 1, 2, 3, 7, 1500, 1501, 1502, 10**6]) for _ in range(900)}.items())
    got = hmm_lm.most_frequent(spark.createDataFrame(rows, "h long, c long"), n)
    assert [(r["h"], r["c"]) for r in got] == sorted(rows, key=lambda r: (-r[1], r[0]))[:n]


def test_language_model_odd_rows(spark):
    """Null and repeated doc_ids are scored each; a full head leaves the other words to the tail."""
    docs = spark.createDataFrame([(None, "a b", 1), (None, None, 2), (3, "a b", 3), (3, "a b", 4), (4, "c " * 66_000, 5)], "doc_id long, text string, row int")
    got = hmm_lm.score(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == [("3", 3), ("3", 3), ("4", 66_001), ("None", 1), ("None", 3)]
    assert all(-math.inf < r["score"] < 0 for r in got)


def test_language_model_with_a_full_head(spark, corpus, monkeypatch):
    """With a head of 64 symbols nearly all words are in the tail, and the base score is still exact."""
    monkeypatch.setattr(hmm_lm, "HEAD", 64)
    got = {r["doc_id"]: r for r in hmm_lm.score(table(spark, corpus)).collect()}
    tokens = {i: t.encode().lower().split() + [None] for i, t in corpus}
    counts = Counter(w for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in t)
    total = sum(counts.values())
    for i, t in tokens.items():
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (len(counts) + 1))) for w in t), rel=1e-9)
        assert got[i]["n_known"] == sum(counts[w] > 0 for w in t)


def test_forward_recursion_is_exact():
    """Against a plain sum over all state paths."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    k, symbols = 3, 5
    one = lambda *shape: (lambda x: x / x.sum(axis=-1, keepdims=True))(rng.random(shape))
    tables = hmm_lm.Tables(one(k), one(k, k), one(k, symbols).T.astype(np.float64))
    docs = [rng.integers(0, symbols, n) for n in (1, 4, 6, 4)]
    logs, counts = hmm_lm.recursions(tables, docs, True)
    exact, _ = hmm_lm.recursions(tables, docs, False)
    for doc, got, near in zip(docs, exact, logs, strict=True):
        total = 0.0
        for path in itertools.product(range(k), repeat=len(doc)):
            p = tables.start[path[0]] * tables.emit[doc[0], path[0]]
            for a, b, x in zip(path[:-1], path[1:], doc[1:], strict=True):
                p *= tables.move[a, b] * tables.emit[x, b]
            total += p
        assert got == pytest.approx(math.log(total), rel=1e-9)
        assert near == pytest.approx(got, rel=1e-4)
    assert counts[2].sum() == pytest.approx(sum(map(len, docs)), rel=1e-4) and counts[1].sum() == pytest.approx(sum(len(d) - 1 for d in docs), rel=1e-4)


def test_block_max_index_is_exact():
    rng = random.Random(4)
    vectors = []
    for _ in range(300):
        v = {t: rng.random() + 0.1 for t in [*rng.sample(range(30), rng.randint(1, 6)), *rng.sample(range(30, 300), 3)]}
        n = math.sqrt(sum(x * x for x in v.values()))
        vectors.append({t: x / n for t, x in sorted(v.items())})
    example = np.repeat(np.arange(len(vectors)), [len(v) for v in vectors])
    found = toxicity.BlockMaxIndex(len(vectors), 300, example, np.array([t for v in vectors for t in v]), np.array([w for v in vectors for w in v.values()]))
    assert 0 < len(found.rows) < 300  # both kinds of lists
    for own, q in enumerate(vectors[:60]):
        for without in (-1, own):
            want = sorted(((-round(sum(w * v.get(t, 0) for t, w in q.items()), 12), n) for n, v in enumerate(vectors) if n != without and any(t in v for t in q)))[:16]
            assert [(-round(s, 12), n) for s, n in zip(*(x.tolist() for x in found.nearest(np.array(list(q)), np.array(list(q.values())), 16, without)), strict=True)] == want


def test_toxicity(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        bad = rng.random() < 0.2
        words = [rng.choice(VOCAB) for _ in range(40)] + (rng.sample(["nasty", "vile", "foul"], 2) if bad else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    marks = spark.createDataFrame(labels + [(5, None), (None, 1), (9999, 1)], "doc_id long, toxic int")
    docs = table(spark, rows + [(1000 + i, t) for i, t in ODD])
    got = {r["doc_id"]: r for r in toxicity.score(docs, marks).collect()}
    assert len(got) == len(rows) + len(ODD)
    held = [(got[i]["predicted"], y) for i, y in labels if got[i]["held_out"]]
    assert sum(p == y for p, y in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[1002]["predicted"] == 0
    left = toxicity.without_toxic(docs, marks)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {i for i, r in got.items() if not r["predicted"]}
    assert toxicity.score(table(spark, rows[:5]), marks.limit(0)).count() == 5


def test_toxicity_on_a_small_table(spark):
    """Few labels, so that no single word is strong evidence: most toxic documents are found all the same."""
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("documents", "labels"))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, marks).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in marks.collect() if r["doc_id"] in got and r["toxic"] is not None}
    assert sum(got[i] for i, y in labels.items() if y > 0) >= 7
    assert sum(got[i] for i, y in labels.items() if y == 0) <= 4


def brute_toxicity(rows, labels, k=toxicity.K, chi=toxicity.CHI2):
    """Probabilities by all cosines, in plain Python; labels: label by doc_id of the training rows."""
    bag = {i: Counter(re.findall(rb"[a-z\x80-\xff]+", (t or "").encode().lower())) for i, t in rows}
    examples = sorted(i for i in labels if i in bag)
    n = [sum(labels[i] == y for i in examples) for y in (0, 1)]
    weight = {}
    for w in {w for i in examples for w in bag[i]}:
        a, b = (sum(w in bag[i] for i in examples if labels[i] == y) for y in (1, 0))
        c, d = n[1] - a, n[0] - b
        total = (a + b) * (c + d) * n[1] * n[0]
        weight[w] = (math.log((1 + len(examples)) / (1 + a + b)) + 1) * min(1.0, ((a * d - b * c) ** 2 * sum(n) / total if total else 0.0) / chi)

    def vector(i):
        raw = {w: (1 + math.log(c)) * weight[w] for w, c in bag[i].items() if weight.get(w)}
        size = math.sqrt(sum(x * x for x in raw.values()))
        return {w: x / size for w, x in raw.items()}

    vectors = {i: vector(i) for i in bag}
    share = (sum(labels.values()) + 0.5) / (len(labels) + 1)

    def voted(i, without=None):
        near = sorted(((sum(x * vectors[e].get(w, 0.0) for w, x in vectors[i].items()), labels[e]) for e in examples if e != without), reverse=True)[:k]
        votes = [(1 / (1.1 - min(1.0, s)), y) for s, y in near if s > 0]
        p = (sum(v * y for v, y in votes) + share) / (sum(v for v, _ in votes) + 1)
        return math.log(min(1 - 1e-6, max(1e-6, p)) / (1 - min(1 - 1e-6, max(1e-6, p))))

    own = [i for i in examples if vectors[i]]
    by_label = [(1 - share) / n[0], share / n[1]]
    curve = toxicity.fitted_logistic(np.array([voted(i, i) for i in own]), np.array([float(labels[i]) for i in own]), np.array([by_label[labels[i]] * len(examples) for i in own]))
    bare = [labels[i] for i in examples if not vectors[i]]
    without = (by_label[1] * sum(bare) + 1e-4 * share) / (sum(by_label[y] for y in bare) + 1e-4)
    return {i: 1 / (1 + math.exp(-max(-30.0, min(30.0, curve[0] * voted(i) + curve[1])))) if vectors[i] else without for i in bag}


def test_toxicity_matches_brute_force(spark):
    """Ties between neighbours of one similarity are few here; a vote's weight depends on similarities alone."""
    rng = random.Random(21)
    rows, labels = [], {}
    for i in range(260):
        bad = rng.random() < 0.3
        words = [rng.choice(VOCAB) for _ in range(rng.choice([0, *range(8, 31)]))] + (rng.sample(["nasty", "vile", "foul", "rotten"], 2) if bad else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels[i] = int(bad)
    rows += [(1000 + i, t) for i, t in ODD]
    got = {r["doc_id"]: r for r in toxicity.score(table(spark, rows), spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")).collect()}
    assert {i for i, r in got.items() if r["held_out"]} == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    want = brute_toxicity(rows, {i: y for i, y in labels.items() if zlib.crc32(str(i).encode()) % 5})
    assert {i: r["score"] for i, r in got.items()} == pytest.approx(want, abs=1e-6)


def test_toxicity_indexes_every_word():
    rng = random.Random(2)
    texts = [b" ".join(b"%c%c%c" % tuple(rng.randrange(97, 123) for _ in range(3)) for _ in range(30)) for _ in range(200)]
    owner, words, counts = toxicity.counted(texts)
    model = toxicity.Model(np.arange(200), np.arange(200) % 2, owner, words, counts, 0.5)
    kinds = {w for t in texts for w in t.split()}
    assert len(model.keys) == len(kinds) > 512


def test_toxicity_odd_rows(spark):
    """Null and repeated doc_ids, rows without labels, empty tables, other columns, very long texts."""
    docs = spark.createDataFrame([(None, "vile words", 1), (None, "vile words", 2), (3, "kind words", 3), (3, "vile words", 4), (4, "a " * 300_000, 5)], "doc_id long, text string, score int")
    marks = spark.createDataFrame([(3, 1), (3, 0), (4, 0), (1, 1)], "doc_id long, toxic int")
    got = toxicity.score(docs, marks).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["3", "3", "4", "None", "None"] and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(docs.limit(0), marks).count() == 0
    assert {r["score"] for r in toxicity.score(docs, marks.limit(0)).collect()} == {0.5}


def test_split_words(monkeypatch):
    rng = random.Random(6)
    texts = [bytes(rng.choice(b"ab \t\n\x0b\x0c\r\x1c\xc3\xa9AZ") for _ in range(rng.randint(0, 60))) for _ in range(300)] + [b"", b"x" * 9000 + b" y", b" "]
    seen = {}
    for stretch in (50, 1 << 20):
        monkeypatch.setattr(common, "STRETCH", stretch)
        for lower in (True, False):
            hashes, cuts = common.split_words(texts, lower)
            want = [(t.lower() if lower else t).split() for t in texts]
            assert np.diff(cuts).tolist() == [len(w) for w in want]
            for word, h in zip((w for words in want for w in words), hashes.tolist(), strict=True):
                assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)
    assert [texts[a:b] for a, b in common.groups_of(texts, 100)] and sum((texts[a:b] for a, b in common.groups_of(texts, 100)), []) == texts


def brute_substrings(rows, window):
    first, words = {}, {i: (t or "").encode().split() for i, t in rows}
    for i, w in words.items():
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words.items():
        gone = {p for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < i for p in range(k, k + window)}
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("window", [13, 7, 5])
def test_substring_dedup(spark, corpus, window):
    rows = corpus + [(1000 + i, t) for i, t in ODD]
    got = substring_dedup.substring_dedup(table(spark, rows), window=window).drop("kept")
    assert sorted(tuple(r) for r in got.collect()) == brute_substrings(rows, window)
    assert substring_dedup.substring_dedup(table(spark, [])).count() == 0


def test_suffix_automaton():
    rng = random.Random(6)
    for _ in range(40):
        texts = [[rng.choice("abc") for _ in range(rng.randint(1, 12))] for _ in range(3)]
        a = substring_dedup.SuffixAutomaton()
        for t in texts:
            a.extend(t)
        q = [rng.choice("abcd") for _ in range(15)]
        held = lambda s: any(t[i : i + len(s)] == s for t in texts for i in range(len(t)))  # noqa: E731, B023
        assert a.statistics(q) == [max(n for n in range(e + 2) if n == 0 or held(q[e + 1 - n : e + 1])) for e in range(len(q))]


PAGES = "page_id long, url string, html string, origin string"


def test_warc(spark):
    rng = random.Random(3)
    html = ["", None, "é" * 10, "<p>" + "x" * 5000, "a\r\n\r\nb"] + ["".join(rng.choice("abc\r\n<>") for _ in range(rng.randint(0, 3000))) for _ in range(40)]
    pages = [(i, "u", html[i % len(html)], "o") for i in range(100)] + [(None, "u", "lost", "o")]
    got = {r["page_id"]: tuple(r)[1:] for r in warc.round_trip(spark.createDataFrame(pages, PAGES), segment_bytes=700).collect()}
    first = {}
    for i, _, h, _ in pages:
        if i is not None:
            first.setdefault(h or "", i)
    for i, _, h, _ in pages:
        body = (h or "").encode()
        home = first.get(h or "", i)
        assert got[i] == (len(body), warc.digest(body), "response" if home == i else "revisit", None if home == i else home)
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_warc_broken_segments():
    assert warc.dechunked(warc.chunked(b"x" * 20_000)) == b"x" * 20_000
    assert warc.dechunked(b"5\r\nabc") is None and warc.dechunked(b"zz\r\n") is None
    records = list(warc.page_records(1, 0, b"y" * 5000, None, 600))
    data = b"\r\n\r\n".join(records) + b"\r\n\r\n"
    assert len(list(warc.parsed(data))) == len(records) > 3
    segments = [{"origin": "o", "segment": n, "total": None, "record_type": "response", "payload_digest": "", "block": b"b"} for n in (1, 3)]
    assert warc._joined("o", segments, False)[3] == "broken"


def test_packing(spark, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    encode = Tokenizer.from_file(path).encode
    rows = corpus + [(1000 + i, t) for i, t in ODD] + [(2000, "İ, don't <|endoftext|> <|ENDOFTEXT|> é́. 12,3!"), (2001, "日本語。 ΑΣ. ß")]
    got = packing.pack(table(spark, rows), path, capacity=256).collect()
    texts, by_doc, by_sequence = dict(rows), {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    lengths = []
    for i, t in texts.items():
        ids = [*encode(t or "", add_special_tokens=False).ids, 0]
        pieces = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["start"] for r in pieces] == list(range(0, len(ids), 256))
        for r in pieces:
            part = ids[r["start"] : r["start"] + 256]
            assert (r["length"], r["ids_crc32"]) == (len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)))
            lengths.append(len(part))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    gaps = []  # best-fit decreasing, one piece at a time
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(256 - n)
    assert len(by_sequence) == len(gaps) <= 1.02 * math.ceil(sum(lengths) / 256)
    assert packing.pack(table(spark, []), path).count() == 0


MESSAGES = "tree long, message long, parent long, role string, text string, score double"


def test_chat_format(spark):
    texts = ["</s>[INST] ok [/INST]", "<\\/s> <\\\\s> [\\INST]", "", None, "a < b [x] \\", "<s", "plain"]
    rng = random.Random(1)
    rows, paths = [], {}
    for tree in range(12):
        parent = {0: None}
        for m in range(1, rng.randint(2, 12)):
            parent[m] = rng.randrange(m)
        score = {m: rng.random() for m in parent}
        rows += [(tree, m, p, "user" if m % 2 else "assistant", rng.choice(texts), score[m]) for m, p in parent.items()]
        leaves = []
        for leaf in set(parent) - {p for p in parent.values() if p is not None}:
            way, x = [], leaf
            while x is not None:
                way.append(x)
                x = parent[x]
            leaves.append((-sum(score[m] for m in way) / len(way), leaf, way[::-1]))
        paths[tree] = min(leaves)
    rows += [(50, 1, 2, "user", "circle", 0.0), (50, 2, 1, "user", "circle", 0.0), (51, 1, 77, "user", "lost parent", None)]
    paths[51] = (0.0, 1, [1])
    said = {(r[0], r[1]): (r[3], r[4] or "") for r in rows}
    got = {r["tree"]: r for r in chat_format.read_back(chat_format.formatted(spark.createDataFrame(rows, MESSAGES))).collect()}
    assert set(got) == set(paths)
    for tree, (_, leaf, way) in paths.items():
        assert got[tree]["leaf"] == leaf
        assert [tuple(t) for t in got[tree]["turns"]] == [said[tree, m] for m in way]
        assert got[tree]["loss_text"] == "".join(said[tree, m][1] for m in way if said[tree, m][0] == "assistant")
    every = chat_format.branches(spark.createDataFrame(rows, MESSAGES), None)
    assert every.where("rank = 1").select("tree").distinct().count() == len(paths)


def test_chat_format_odd_rows(spark):
    """Repeated messages count once, the smallest by parent, score, role and text; ties go to the smaller leaf."""
    rows = [(1, 1, None, "user", "root", 0.5), (1, 1, None, "user", "root", 0.5), (1, 1, None, "user", "later", 0.5), (1, 2, 1, "assistant", "reply", 0.5), (1, 2, 1, "assistant", "reply", None)]
    rows += [(2, 1, None, "user", "a", 0.0), (2, 2, 1, "assistant", "b", 1.0), (2, 3, 1, "assistant", "c", 1.0), (2, None, 1, "user", "x", 9.0), (None, 1, None, "user", "x", 1.0), (3, 1, None, None, None, None)]
    messages = spark.createDataFrame([(*r, 0, "h") for r in rows], MESSAGES + ", rank int, head string")
    got = {r["tree"]: r for r in chat_format.read_back(chat_format.formatted(messages)).collect()}
    assert {t: [tuple(x) for x in r["turns"]] for t, r in got.items()} == {1: [("user", "later"), ("assistant", "reply")], 2: [("user", "a"), ("assistant", "b")], 3: [("", "")]}
    assert chat_format.formatted(messages.limit(0)).count() == 0
    assert {(r["tree"], r["leaf"], r["rank"]) for r in chat_format.branches(messages, 5).select("tree", "leaf", "rank").collect()} == {(1, 2, 1), (2, 2, 1), (2, 3, 2), (3, 1, 1)}


def test_chat_branches_of_a_comb(spark):
    """A chain with a leaf at each message: only the chosen path is listed."""
    n = 120
    rows = [(1, m, m - 1 if m else None, "user", str(m), 1.0) for m in range(n)] + [(1, n + m, m, "user", "leaf", m / n) for m in range(n)]
    got = chat_format.branches(spark.createDataFrame(rows, MESSAGES)).collect()
    # The mean of a leaf's path is largest where the chain is longest.
    assert {r["leaf"] for r in got} == {2 * n - 1} and len(got) == n + 1


def test_chat_threads_and_digests(spark):
    rows = [(7, 2, "assistant", "<s>"), (7, 1, "user", None), (7, 1, "user", "again"), (None, 1, "user", "nowhere"), (8, None, None, "x")]
    got = {r["conv_id"]: r for r in chat_format.digests(chat_format.formatted(chat_format.threads(spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, score int")))).collect()}
    assert set(got) == {7, 8} and got[7]["n_turns"] == 3 and got[8]["n_turns"] == 1
    assert got[7]["turns_sha256"] == hashlib.sha256(b"user\n\nuser\nagain\nassistant\n<s>\n").hexdigest()
    assert (got[7]["loss_chars"], got[7]["loss_sha256"]) == (3, hashlib.sha256(b"<s>").hexdigest())
    assert got[7]["formatted_chars"] == sum(len(f"<s>[INST] {r} [/INST]{t}</s>") for r, t in [("user", ""), ("user", "again"), ("assistant", "<\\s>")])


def test_quality_likelihood_and_gradient():
    """The likelihood against the definition of the model in plain Python, the gradient against finite differences."""
    rng = np.random.default_rng(11)
    n, width, top = 40, 12, 3
    grades = rng.integers(0, top + 1, n)
    index, value, owner = rng.integers(0, width, 5 * n), rng.random(5 * n), np.repeat(np.arange(n), 5)
    weights, cuts = rng.normal(size=width), np.array([-0.5, 0.1, -0.7])

    def plain(w, c):
        bounds = [-math.inf, c[0], c[0] + math.exp(c[1]), c[0] + math.exp(c[1]) + math.exp(c[2]), math.inf]
        below = lambda t, z: 0.0 if t == -math.inf else 1.0 if t == math.inf else 1 / (1 + math.exp(z - t))
        total = 0.0
        for i in range(n):
            z = sum(v * w[k] for k, v, o in zip(index, value, owner, strict=True) if o == i)
            total -= math.log(below(bounds[grades[i] + 1], z) - below(bounds[grades[i]], z))
        return total / n + quality.RIDGE / 2 * sum(x * x for x in w)

    loss, by_weight, by_cut = quality.loss_and_gradient(weights, cuts, index, value, owner, grades)
    assert loss == pytest.approx(plain(weights, cuts), rel=1e-12)
    for k in range(width):
        step = np.eye(width)[k] * 1e-6
        assert by_weight[k] == pytest.approx((plain(weights + step, cuts) - plain(weights - step, cuts)) / 2e-6, abs=1e-6)
    for k in range(top):
        step = np.eye(top)[k] * 1e-6
        assert by_cut[k] == pytest.approx((plain(weights, cuts + step) - plain(weights, cuts - step)) / 2e-6, abs=1e-6)
    tails = quality.Model(weights, quality.thresholds_of(cuts)).tails(np.array([-1.0, 0.0, 2.0]))
    assert (np.diff(tails, axis=1) < 0).all() and (np.diff(tails, axis=0) > 0).all()


def test_quality_odd_rows(spark):
    """Null and repeated doc_ids are scored each; long words of marks and digits; no documents."""
    docs = spark.createDataFrame([(None, "a b", 1), (None, "a b", 2), (3, "word " * 9, 3), (3, None, 4), (4, "x9-" * 40_000, 5)], "doc_id long, text string, grade int")
    ratings = spark.createDataFrame([(3, 1), (3, 0), (4, 2), (None, 1)], "doc_id long, grade int")
    got = quality.classify(docs, ratings).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["3", "3", "4", "None", "None"] and all(0 <= r["score"] <= 1 <= 1 + r["expected_grade"] <= 3 for r in got)
    assert quality.classify(docs.limit(0), ratings).count() == 0


def test_quality(spark):
    rng = random.Random(12)
    rows, ratings = [], []
    for i in range(900):
        grade = rng.randrange(3)
        words = [rng.choice(VOCAB) + ("###" if rng.random() < (0.5, 0.15, 0.0)[grade] else "") for _ in range(60)]
        rows.append((i, " ".join(words)))
        ratings.append((i, grade))
    docs = table(spark, rows + [(1000 + i, t) for i, t in ODD])
    got = {r["doc_id"]: r for r in quality.classify(docs, spark.createDataFrame([*ratings, (None, 1), (3, None)], "doc_id long, grade int")).collect()}
    held = [(got[i], g) for i, g in ratings if got[i]["held_out"]]
    assert sum(r["selected"] == (g >= 1) for r, g in held) / len(held) > 0.9
    mean = [sum(r["expected_grade"] for r, g in held if g == k) / sum(g == k for _, g in held) for k in range(3)]
    assert mean[0] < mean[1] < mean[2] and len(got) == len(rows) + len(ODD)
    m = quality.fit([], __import__("numpy").zeros(0, dtype=int), 2)
    assert m.thresholds[0] < m.thresholds[1]


def edit_distance_in(pattern, text):
    """Least edits of the pattern against any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@functools.lru_cache(maxsize=4)
def places_of(text, size):
    found = {}
    for i in range(len(text) - size + 1):
        found.setdefault(text[i : i + size], []).append(i)
    return found


def leaks(item, text):
    """Whether the text holds a window of the item within a tenth of its characters; both are lower-cased, with runs of
    white space as one space. Of a window's equal parts, three more than edits, three at least are there unchanged and
    not more than that many places off."""
    item, text = (" ".join(x.lower().split()) for x in (item, text))
    size = min(len(item), 96)
    k = size // 10
    if len(item) < 32:
        return False
    part = size // (k + 3)
    places = places_of(text, part)
    for begin in range(len(item) - size + 1):
        window = item[begin : begin + size]
        near = sorted(y - x for x in range(0, part * (k + 3), part) for y in places.get(window[x : x + part], ()))
        for first, third in zip(near, near[2:], strict=False):
            if third - first <= k and edit_distance_in(window, text[max(0, first - 2 * k) : first + size + 3 * k]) <= k:
                return True
    return False


def test_decontaminate_near_the_budget(monkeypatch):
    """Windows with about as many edits as they may have, over few letters, so that many q-grams are shared by chance."""
    rng = random.Random(9)
    monkeypatch.setattr(decontaminate, "PIECE_CHARS", 150)
    hits = 0
    for case in range(60):
        letters = rng.choice(["ab", "abcd", "abcdefgh "])
        any_text = lambda n: "".join(rng.choice(letters) for _ in range(n))  # noqa: E731, B023
        item = decontaminate.normal(any_text(rng.choice([rng.randint(32, 96), rng.randint(97, 150)])))
        texts = []
        for _ in range(3):
            size = min(96, len(item))
            at = rng.randint(0, len(item) - size)
            cut = list(item[at : at + size])
            for _ in range(max(0, size // 10 + rng.randint(-4, 3))):
                x = rng.randrange(len(cut))
                cut[x] = rng.choice([rng.choice("ab"), "", cut[x] + rng.choice("az")])
            texts.append(any_text(rng.randint(0, 200)) + "".join(cut) + any_text(rng.randint(0, 60)))
        got = [bool(x) for x in decontaminate.spans(decontaminate.Patterns([(7, item)]), texts)]
        assert got == [leaks(item, t) for t in texts]
        hits += sum(got)
    assert 40 < hits < 180


def test_decontaminate(spark):
    rng = random.Random(21)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 8))) for _ in range(n))
    items = [(n, text(rng.randint(8, 60))) for n in range(12)] + [(50, "short"), (51, None), (None, text(30))]
    docs = []
    for i in range(60):
        body = text(40)
        if i % 3 == 0:
            item = list(items[rng.randrange(12)][1])
            for _ in range(rng.choice([0, 2, int(len(item) * 0.1), int(len(item) * 0.3)])):
                item[rng.randrange(len(item))] = rng.choice(["", "z", "zz"])
            body = f"{body} {''.join(item)} {text(10)}"
        docs.append((i, body.upper() if i % 2 else body))
    found = decontaminate.contamination(table(spark, docs + [(1000 + i, t) for i, t in ODD]), spark.createDataFrame(items, "item_id long, text string"))
    got = {r["doc_id"]: set(r["item_ids"]) for r in found.collect()}
    for i, t in docs:
        assert got[i] == {item for item, said in items if item is not None and leaks(said or "", t)}
    assert all(not got[1000 + i] for i, _ in ODD)
    left = decontaminate.without_contaminated(table(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"] for r in left.collect()} == {i for i, _ in docs if not got[i]}


def test_decontaminate_in_blocks(spark, monkeypatch):
    """Rows that repeat a doc_id or have none are searched each, whatever the benchmark's size."""
    rng = random.Random(4)
    items = [(n, " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(20))) for n in range(3)]
    rows = [(1, items[0][1]), (1, items[0][1]), (None, items[1][1]), (None, items[2][1]), (None, "clean"), (2, items[0][1] + " " + items[2][1])]
    marks = spark.createDataFrame(items, "item_id long, text string")
    got = []
    for chars in (4_000_000, 1):
        monkeypatch.setattr(decontaminate, "BLOCK_CHARS", chars)
        got.append(sorted((r["doc_id"] or 0, r["item_ids"], sorted(x["item_id"] for x in r["regions"])) for r in decontaminate.contamination(table(spark, rows), marks).collect()))
    assert got[0] == got[1] == [(0, [], []), (0, [1], [1]), (0, [2], [2]), (1, [0], [0]), (1, [0], [0]), (2, [0, 2], [0, 2])]


def test_without_copies_looks_at_the_text(spark):
    """A doc_id with several texts loses only the text that is a copy."""
    rows = [(3, "A a"), (5, "A  a"), (5, "B"), (5, "B"), (7, "B"), (None, "A a"), (None, "A a"), (None, None)]
    got = exact_dedup.without_copies(table(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got) == [(0, ""), (0, "A a"), (0, "A a"), (3, "A a"), (5, "B")]


def test_decontaminate_excerpts_and_short_items(spark):
    """Exact excerpts of a longer item at any place in it, and items too short for windows."""
    rng = random.Random(6)
    item = "".join(rng.choice("abcdefghij") for _ in range(400))
    items = [(1, item), (2, "Nine lives"), (3, "short"), (4, " "), (5, "短い文"), (6, "c++")]
    rows = [(n, "zzz " + item[n : n + 88] + " zzz") for n in range(0, 312, 3)]
    rows += [(1000, "a cat has nine\n lives."), (1001, "shorter nine livesaver"), (1002, "SHORT"), (1003, "この短い文を"), (1004, "in c++ or"), (1005, "in abc++"), (1006, None)]
    got = {r["doc_id"]: r["item_ids"] for r in decontaminate.contamination(table(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert all(got[n] == [1] for n in range(0, 312, 3))
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(table(spark, rows), empty).where("contaminated").count() == 0 and decontaminate.contamination(table(spark, rows).limit(0), empty).count() == 0
    assert [got[n] for n in range(1000, 1007)] == [[2], [], [3], [5], [6], [], []]


def test_decontaminate_aligns_texts_together(monkeypatch):
    """400 texts with two edited passages each, in many groups: the same regions as text by text; before, each group was aligned alone."""
    draw = random.Random(12)
    words = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(3, 9))) for _ in range(2000)]
    said = [" ".join(draw.choices(words, k=40)) for _ in range(30)]
    patterns = decontaminate.Patterns(list(enumerate(said)))
    texts = []
    for n in range(400):
        passages = [draw.choice(said)[draw.randrange(40) :] for _ in range(2)]
        for _ in range(draw.randrange(14)):
            at = draw.randrange(len(passages[0]))
            passages[0] = passages[0][:at] + "z" + passages[0][at + 1 :]
        texts.append(" ".join(x for p in passages for x in (" ".join(draw.choices(words, k=60)), p)) if n % 3 else " ".join(draw.choices(words, k=90)))
    texts[7] = ""
    calls, banded = [], decontaminate.banded
    monkeypatch.setattr(decontaminate, "banded", lambda *x: calls.append(len(x[0])) or banded(*x))
    monkeypatch.setattr(decontaminate, "GROUP_CHARS", 5000)
    found = decontaminate.spans(patterns, texts)
    together = len(calls)
    assert sum(map(bool, found)) > 250
    assert [{r["item_id"] for r in f} for f in found] == [{r["item_id"] for r in decontaminate.spans(patterns, [t])[0]} for t in texts]
    calls.clear()
    monkeypatch.setattr(decontaminate, "ALIGNED_CHARS", 1)  # each group alone, as before
    assert decontaminate.spans(patterns, texts) == found and len(calls) > 8 * together


def test_recursions_take_batches_together(monkeypatch):
    """40 small batches of a partition: one call of the recursions for all, up to the bound; before, one a batch."""
    from types import SimpleNamespace

    draw = np.random.default_rng(4)
    base = np.full(hmm_lm.HEAD + hmm_lm.TAILS, 1 / (hmm_lm.HEAD + hmm_lm.TAILS))
    shared = SimpleNamespace(value=hmm_lm.started(base))
    docs = [[draw.integers(0, len(base), draw.integers(1, 60)).astype("<u2") for _ in range(draw.integers(0, 5))] for _ in range(40)]
    batches = [pa.table({"symbols": pa.array([d.tobytes() for d in own], pa.binary()), **{c: pa.array(range(len(own)), pa.int64()) for c in hmm_lm._KEPT}}).combine_chunks().to_batches() or [] for own in docs]
    batches = [b for own in batches for b in own]
    sizes, recursions = [], hmm_lm.recursions
    monkeypatch.setattr(hmm_lm, "recursions", lambda t, d, learn: sizes.append(sum(map(len, d))) or recursions(t, d, learn))

    def results():
        counts = [np.frombuffer(zlib.decompress(c), dtype="<f4") for c in list(hmm_lm._expected(shared)(iter(batches)))[0].column("counts").to_pylist()]
        scored = list(hmm_lm._scores(shared)(iter(batches)))
        assert [b.num_rows for b in scored] == [b.num_rows for b in batches]
        return np.concatenate(counts), np.concatenate([b.column("forward").to_numpy() for b in scored])

    one = results()
    assert len(sizes) == 2
    monkeypatch.setattr(hmm_lm, "TOGETHER", 300)
    few = results()
    assert max(sizes[2:]) <= 300 and len(sizes) > 10
    for x, y in zip(one, few, strict=True):
        assert np.allclose(x, y, rtol=1e-4, atol=1e-6)
    alone = [recursions(shared.value, [d], False)[0][0] / np.log(10) for own in docs for d in own]
    assert np.allclose(one[1], alone)


def test_workers_drop_the_tables_of_other_operators():
    """A worker keeps the table of words between tasks of packing, and not once another operator is at work; before, for ever."""
    import public_tokenizers

    batch = lambda: iter([pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["one two three", ""])], names=["doc_id", "text"])])
    path = public_tokenizers.path("word_bpe_49k.json")
    first = pa.Table.from_batches(packing._pieces(path, 2048, 0)(batch()))
    held = packing.word_ids(path)
    assert len(held) == 3 and packing.word_ids.cache_info().currsize == 1
    assert pa.Table.from_batches(packing._pieces(path, 2048, 0)(batch())) == first and packing.word_ids(path) is held
    for other in (jaccard_join._sets(3), jaccard_join._tokens(3)):
        common.begin("packing")
        packing.word_ids(path)
        list(other(batch()))
        assert packing.word_ids.cache_info().currsize == 0
    assert pa.Table.from_batches(packing._pieces(path, 2048, 0)(batch())) == first
