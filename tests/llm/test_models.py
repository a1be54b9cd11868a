"""Language model, prefix trie and ranked search against plain Python."""

import cProfile
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import lm, search, trie
from pulsegrid.llm.common import documents

ODD = [(1, None), (2, ""), (3, "   \n\t"), (4, "same text"), (5, "same text"), (5, "same text"), (None, "without an id"), (6, "word " * 30_000), (7, "é日本🙂 A-Z|a_z 12")]


def odd(spark):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in ODD], "doc_id long, text string, row string, n int, m int, score int")


# language model


def tokens(text):
    return [*re.findall("[^\x20\x09-\x0d]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))), ""]


def check_lm(docs):
    source = [(r.doc_id, r.text) for r in docs.collect()]
    out = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t in source if not out(i) for w in tokens(t))
    n, v = counts.total(), len(counts)
    want = [(i, out(i), len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)) for i, t in source for w in [tokens(t)]]
    rows = lm.scores(docs).collect()
    assert len(rows) == len(want)
    for r, x in zip(sorted(rows, key=lambda r: (str(r.doc_id), r.n_tokens)), sorted(want, key=lambda x: (str(x[0]), x[2])), strict=True):
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == x[:5]
        assert r.base_score == pytest.approx(x[5], rel=1e-9, abs=1e-9) and (r.score < 0 or n == 0)
    return rows


@pytest.mark.parametrize("frequent", [lm.FREQUENT, 50])
def test_lm(spark, sf, monkeypatch, frequent):
    """Counts and base scores; the model does better than the counts on texts that it has not seen. With few words known to
    the tasks, the others come from the join, and give the same."""
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    monkeypatch.setattr(lm, "HEAD", min(frequent, 300))
    rows = check_lm(documents(spark, sf))
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)


def test_lm_edges(spark):
    rows = check_lm(odd(spark))
    assert len({r.score for r in rows if r.doc_id in (4, 5)}) == 1
    check_lm(odd(spark).limit(0))
    check_lm(odd(spark).filter("doc_id is null"))  # nothing to train on


def small_model():
    vocabulary = lm.Vocabulary.of([(b"w%d" % i, 100 - i) for i in range(60)], 20)
    return lm.Model.start(vocabulary, np.arange(1.0, vocabulary.head + lm.TAILS + 1)), vocabulary


def test_lm_is_a_distribution():
    model, vocabulary = small_model()
    states = np.random.default_rng(1).normal(size=(3, lm.HIDDEN)).astype(np.float32)
    every = np.arange(vocabulary.head + lm.TAILS)
    for s in states:
        logs, _, _ = model.output(np.repeat(s[None], len(every), 0), every)
        assert np.exp(logs).sum() == pytest.approx(1, abs=1e-4)


def test_lm_gradients(monkeypatch):
    """Against differences of the loss, in every part of the weights."""
    monkeypatch.setattr(lm, "_f", np.float64)
    model, vocabulary = small_model()
    model.w = {k: v.astype(float) for k, v in model.w.items()}
    rng = np.random.default_rng(2)
    n = vocabulary.head + lm.TAILS
    xs, ys, mask, h = rng.integers(0, n, (5, 6)), rng.integers(0, n, (5, 6)), rng.random((5, 6)) < 0.8, rng.normal(size=(6, lm.HIDDEN))

    def loss():
        states = np.asarray(model.walk(xs, h)[0], float).reshape(-1, lm.HIDDEN)
        some = np.flatnonzero(mask.ravel())
        return -model.output(states[some], ys.ravel()[some])[0].sum() / xs.size

    grads, _, _ = model.gradients(xs, ys, mask, h)
    for part in lm.PARTS:
        flat, want = model.w[part].reshape(-1), grads[part].reshape(-1)
        for i in [int(np.abs(want).argmax()), *rng.integers(0, len(flat), 3)]:
            old = flat[i]
            flat[i] = old + 1e-5
            high = loss()
            flat[i] = old - 1e-5
            low = loss()
            flat[i] = old
            assert want[i] == pytest.approx((high - low) / 2e-5, abs=1e-6), part


def test_lm_carries_its_state(monkeypatch):
    """A text walked in windows, among others in lanes, scores as if it were walked alone in one."""
    model, vocabulary = small_model()
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, vocabulary.head, k).astype(np.int32) for k in (1, 7, 200, 64, 65, 3, 500)]
    got = lm.score(model, texts)
    for text, x in zip(texts, got, strict=True):
        states, _ = model.walk(np.concatenate([[0], text[:-1]])[:, None], np.zeros((1, lm.HIDDEN), np.float32))
        assert x == pytest.approx(model.output(states[:, 0], text)[0].sum() / math.log(10), rel=1e-4)
    monkeypatch.setattr(lm, "SCORE_LANES", 2)
    monkeypatch.setattr(lm, "SCORE_STEPS", 5)
    assert lm.score(model, texts) == pytest.approx(got, rel=1e-4)


def test_lm_learns():
    """A language in which each word tells the next one."""
    model, vocabulary = small_model()
    rng = random.Random(4)

    def text():
        k = rng.randrange(60)
        return np.array([1 + (k + 7 * i) % 60 for i in range(40)] + [0], np.int32)

    before = lm.score(model, [text() for _ in range(20)]).sum()
    for _ in range(15):
        model, seen, _ = lm.train(model, iter([text() for _ in range(400)]))
        assert seen == 400 * 41
    assert lm.score(model, [text() for _ in range(20)]).sum() > before / 3


def test_lm_windows_hold_every_token():
    """Each symbol once, after the one before it, texts whole and in one lane from their begin on, whatever their lengths."""
    rng = np.random.default_rng(6)
    texts = [np.append(rng.integers(1, 50, k), 0).astype(np.int32) for k in (0, 1, 3, 15, 16, 17, 300, 40, 2, 0)]
    got, lanes = [], {}
    for xs, ys, mask, fresh, _ in lm.windows(iter(texts), 3, 16):
        for i in range(xs.shape[1]):
            for x, y, m, f in zip(xs[:, i], ys[:, i], mask[:, i], fresh[:, i], strict=True):
                if m:
                    if f:
                        assert x == 0
                        lanes[i] = []
                        got.append(lanes[i])
                    assert x == ([0] + lanes[i])[-1]
                    lanes[i].append(int(y))
    assert sorted(got) == sorted(x.tolist() for x in texts)


def test_lm_calls_do_not_grow_with_lanes(monkeypatch):
    """A window takes as many calls of Python and numpy with many lanes as with few, in training and in scoring."""
    model, vocabulary = small_model()
    monkeypatch.setattr(lm, "UPDATES", 1)
    rng = np.random.default_rng(7)

    def calls(do, lanes, windows, steps):
        texts = [np.append(rng.integers(0, vocabulary.head, windows * steps - 1), 0).astype(np.int32) for _ in range(lanes)]
        profile = cProfile.Profile()
        profile.runcall(do, texts)
        return sum(x.callcount for x in profile.getstats())

    for do, steps in ((lambda x: lm.train(model, iter(x)), lm.STEPS), (lambda x: lm.score(model, x), lm.SCORE_STEPS)):
        few, many = (calls(do, lanes, 12, steps) - calls(do, lanes, 4, steps) for lanes in (16, 128))
        assert many < 1.1 * few


def test_lm_with_large_weights():
    """States and probabilities stay what they are where exponentials overflow or vanish."""
    model, vocabulary = small_model()
    rng = np.random.default_rng(8)
    model.w = {k: (x * 3000).astype(np.float32) for k, x in model.w.items()}
    n = vocabulary.head + lm.TAILS
    states = model.walk(rng.integers(0, n, (5, 6)), np.zeros((6, lm.HIDDEN), np.float32))[0]
    assert np.isfinite(states).all() and np.abs(states).max() <= 1
    for s in states[-1]:
        assert np.exp(model.output(np.repeat(s[None], n, 0), np.arange(n))[0]).sum() == pytest.approx(1, abs=1e-4)


def test_lm_words_of_a_batch():
    """Words and their shapes, taken for a batch at once, are those of plain Python."""
    texts = [None, "", "  ", " a  B\x0bc\x0cd\x1ce\x85f É\xa0g \n", "x", "A x " + "ab1 " * 9, "é" * 30 + " z"]
    codes, distinct, begin = lm.words(pa.array(texts, pa.string()))
    want = [[w.encode() for w in tokens(t)[:-1]] for t in texts]
    words = distinct.to_pylist()
    assert [[words[k] for k in codes[a:b]] for a, b in zip(begin, begin[1:], strict=False)] == want
    assert len(set(words)) == len(words) and lm.shapes(distinct).tolist() == [lm.shape(w) for w in words]
    assert lm.shapes(distinct.slice(2, 4)).tolist() == [lm.shape(w) for w in words[2:6]]


def test_lm_trains_on_all_windows(spark, sf, monkeypatch):
    """The rounds' tasks see every token of every training text once."""
    seen, held = [], lm.written

    def kept(df, name):
        out = held(df, name)
        if name == "weights":
            seen.append(out)
        return out

    monkeypatch.setattr(lm, "written", kept)
    tokens = lm.scores(documents(spark, sf)).first().train_tokens
    assert len(seen) == lm.ROUNDS and sum(r.seen for x in seen for r in x.select("seen").collect()) == tokens


# prefix trie


def trie_rows(conversations):
    turns = defaultdict(list)
    for c, turn, role, text in conversations:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(x)] for c, x in turns.items()}
    built = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + x[h:])
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, x in built.items():
        for d in range(len(x) + 1):
            members[x[:d]].append(c)
            if d:
                kids[x[: d - 1]].add(x[:d])
        ends[x].append(c)
    leaves, saved = Counter(), Counter()
    for x, m in members.items():
        tokens = len(re.findall("[^\x20\x09-\x0d]+", x[-1][1])) if x else 0
        for d in range(len(x) + 1):
            leaves[x[:d]] += x not in kids
            saved[x[:d]] += (len(m) - 1) * tokens
    return sorted(
        (min(m), len(x), min(members[x[:-1]]) if x else -1, len(m), len(kids[x]), leaves[x], saved[x], hashlib.sha256(",".join(map(str, sorted(ends[x]))).encode()).hexdigest()) for x, m in members.items()
    )


def check_trie(df):
    got = sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in trie.conversation_trie(df).collect())
    assert got == trie_rows([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])


def test_trie_of_the_tables(spark, sf):
    check_trie(spark.read.parquet(f"{sf}/conversations.parquet"))


@pytest.mark.parametrize("longest", [3, 40, 150])
def test_trie_random(spark, longest, monkeypatch):
    """Few different turns, so that prefixes are shared deeply; up to three levels of blocks; nulls, ties, repeated rows, ids that
    are missing, large or negative, conversations without a turn left, clashing columns."""
    monkeypatch.setattr(trie, "CHUNK", 3)
    rng = random.Random(longest)
    rows = []
    for c in [*range(70), -7, -20, 10**12, 10**12 + 3, None]:
        if c in (20, 33):
            continue
        n, kind = rng.choice([1, 2, 3, longest // 2, longest]), rng.randrange(4)
        for i in range(n):
            text = f"t{i} a" if rng.random() < 0.97 and kind else rng.choice([None, "", "x y z", "été  b"])
            rows.append((c, rng.choice([None, i, i, i]), rng.choice(["user", None]) if kind == 1 else "u", text, "k", 1))
    rows += rows[:5]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, key string, depth int")
    check_trie(df)
    check_trie(df.limit(0))


# ranked search


def search_rows(docs, items, top=20):
    terms = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    own = [(i, Counter(w), len(w)) for i, t in docs if (w := terms(t))]
    total, length = len(own), sum(n for _, _, n in own)
    df = Counter(w for _, c, _ in own for w in c)
    out = []
    for i, text in sorted({(i, t) for i, t in items if terms(t)}):
        found = []
        for d, c, n in own:
            m = 75 + 25 * n * total // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 12 * m)) for w in terms(text) if c[w])
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(i, rank, f[3], -f[0]) for rank, f in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=str)


def check_search(docs, items):
    got = sorted((tuple(r) for r in search.search(docs, items).select("item_id", "rank", "doc_id", "score").collect()), key=str)
    assert got == search_rows([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])


@pytest.mark.parametrize("block", [search.BLOCK_TERMS, 300])
def test_search_of_the_tables(spark, sf, monkeypatch, block):
    monkeypatch.setattr(search, "BLOCK_TERMS", block)
    check_search(documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"))


def test_search_edges(spark, monkeypatch):
    """Hundreds of copies, ties across classes, terms in every text (of no weight), items without terms, repeated items."""
    monkeypatch.setattr(search, "CELLS", 50)
    monkeypatch.setattr(search, "PIECE", 64)
    rng = random.Random(8)
    docs = [(i, "copy of one two") for i in range(300)] + [(1000 + i, " ".join(rng.choice(["one", "two", "three", "four"]) for _ in range(rng.randrange(1, 9)))) for i in range(200)]
    docs += [(2000 - i, "one " + "x" * (i % 3)) for i in range(60)] + [(r[0], r[1]) for r in ODD]
    rng.shuffle(docs)
    items = [(1, "one"), (2, "TWO, two three"), (3, None), (4, "..."), (5, "nowhere"), (6, "copy one one"), (6, "copy one one"), (6, "four"), (7, "same text word 日本")]
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, m int, terms string")
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, size string")
    check_search(frame, asked)
    check_search(frame.limit(0), asked)
    assert search.search(frame, asked.limit(0)).collect() == []
    assert search.search(frame, asked.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_search_is_exact(spark):
    """Scores beyond 2^53 are not rounded."""
    docs = spark.createDataFrame([(i, f"a{i} common") for i in range(50)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a7 " * 400_000 + "a8")], "item_id long, text string")
    got = search.search(docs, items).collect()
    want = search_rows([(r.doc_id, r.text) for r in docs.collect()], [(1, "a7 " * 400_000 + "a8")])
    assert sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in got), key=str) == want
    assert max(r.score for r in got) > 10**14


def test_columns_of_other_names(spark):
    df = odd(spark).withColumn("a.b", F.lit(1))
    assert lm.scores(df).columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
