"""Archives, repeated substrings, quality, near copies, fingerprints and BPE against plain Python."""

import base64
import gzip
import hashlib
import io
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pulsegrid.llm import bpe, components, fingerprint, neardup, quality, substrings, warc
from pulsegrid.llm.common import documents

public_tokenizers = pytest.importorskip("public_tokenizers")
ODD = [(1, None), (2, ""), (3, "   \n\t"), (4, "same text"), (5, "same text"), (5, "same text"), (None, "without an id"), (6, "word " * 30_000), (7, "é日本🙂 a@b.cd 🙂 1.2.3.4")]


def odd(spark):
    return spark.createDataFrame([(i, t, "x", 1, "k") for i, t in ODD], "doc_id long, text string, row string, n int, stats string")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_archives(spark, sf):
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    pages += [(10_000, None, pages[0][2]), (10_001, "u", None), (10_002, "u\r\nv", ""), (-5, "u", pages[1][2]), (10_003, "u", "é" * 2_000_000)]
    got = rows(warc.round_trip(spark, spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as payload")))
    largest = defaultdict(int)
    for i, _, h in pages:
        largest[h or ""] = max(largest[h or ""], i)
    want = []
    for i, _, h in pages:
        raw, of = (h or "").encode(), largest[h or ""]
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if of == i else "revisit", None if of == i else of))
    assert got == sorted(want, key=str)
    assert warc.round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    small = warc.assign_revisits(spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string"), least=3)
    assert small.filter("refers_to is not null").count() == 0


def test_reader_is_sequential_and_checks():
    good = warc.member("response", {"Content-Type": "text/html", "WARC-Payload-Digest": "sha1:" + warc.digest_of(b"one")}, b"one")
    bad = warc.member("response", {"Content-Type": "text/html", "WARC-Payload-Digest": "sha1:" + warc.digest_of(b"two")}, b"not two")
    found = list(warc.records(io.BytesIO(good + bad + gzip.compress(b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 0\r\n\r\n\r\n\r\n"))))
    assert [(r.payload, r.digest_ok) for r in found] == [(b"one", True), (b"not two", False), (b"", None)]
    for broken in (good[:-5], gzip.compress(b"nonsense\r\n\r\n"), gzip.compress(b"WARC/1.0\r\nWARC-Type: x\r\nContent-Length: 9\r\n\r\nshort\r\n\r\n")):
        with pytest.raises(ValueError):
            list(warc.records(io.BytesIO(broken)))


def stripped(texts, n=substrings.LENGTH):
    seen = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def check_substrings(docs):
    source = docs.collect()
    want = [(r.doc_id, *x) for r, x in zip(source, stripped([(r.text or "").encode() for r in source]), strict=True)]
    assert rows(substrings.digest(docs)) == sorted(want, key=str)


@pytest.mark.parametrize("most", [substrings.MAX_RUNS, 1])
def test_substrings(spark, sf, monkeypatch, most):
    monkeypatch.setattr(substrings, "MAX_RUNS", most)
    check_substrings(documents(spark, sf).limit(120))
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefgh é") for _ in range(900))
    edits = [base[:k] + rng.choice("XYZ") + base[k + 1 :] for k in range(0, 900, 60)] + [base[100:420], base[100:299], "ab" * 300, "q" * 500, base * 2]
    check_substrings(spark.createDataFrame([(i, t) for i, t in enumerate(edits)] + ODD[:5] + [(5, base), (5, base)], "doc_id long, text string"))
    check_substrings(odd(spark).filter("doc_id <> 6").limit(0))


def test_blocks_sort_suffixes():
    """Sorted buckets against Python's order of the strings, over texts with long ties at all distances."""
    assert {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER} == set(range(substrings.PERIOD))
    rng = random.Random(17)
    unit = bytes(rng.randrange(97, 101) for _ in range(260))
    for raw in (unit * 6, bytes(rng.randrange(97, 99) for _ in range(900)) + unit + bytes(37) + unit + b"x" * 700, unit[:150] * 9 + unit):
        block = substrings.Block(raw)
        places = np.arange(len(raw) - substrings.LENGTH + 1)
        rng.shuffle(places)
        cuts = sorted(rng.sample(range(1, len(places)), 5))
        sizes = np.diff([0, *cuts, len(places)])
        got, begin = block.sorted(places, sizes), 0
        for size in sizes.tolist():
            mine = got[begin : begin + size].tolist()
            assert sorted(mine) == sorted(places[begin : begin + size].tolist())
            assert [raw[i : i + substrings.LENGTH] for i in mine] == sorted(raw[i : i + substrings.LENGTH] for i in mine)
            begin += size
        a, b = got[:-1], got[1:]
        assert block.same(a, b).tolist() == [raw[i : i + substrings.LENGTH] == raw[j : j + substrings.LENGTH] for i, j in zip(a.tolist(), b.tolist(), strict=True)]


def test_long_texts_are_cut_into_segments(spark, monkeypatch):
    rng = random.Random(10)
    t = "".join(rng.choice("abcdefgh") for _ in range(3000))
    monkeypatch.setattr(substrings, "SEGMENT", 500)
    parts = list(substrings.segments(t.encode()))
    assert b"".join(p[:500] for _, p in parts)[:3000] == t.encode() and all(len(p) <= 699 for _, p in parts)
    seen = [(o, lo + parts[o][0], n) for o, lo, n, *_ in zip(*substrings.runs_of([p for _, p in parts]), strict=True)]
    covered = sorted(i for _, lo, n in seen for i in range(lo, lo + n))
    assert covered == list(range(2801))


def test_quality(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = quality.quality(documents(spark, sf), labels).join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in out) >= 0.9 * len(out)
    held = [r for r in out if r.held_out]
    assert held and sum(r.predicted == r.quality for r in held) >= 0.85 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    # labels of the held-out fold and other columns are never read
    turned = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - quality else quality end as quality")
    assert rows(quality.quality(documents(spark, sf).drop("lang", "source"), turned)) == rows(quality.quality(documents(spark, sf), labels))


def test_quality_is_the_ridge_over_all_rows(spark, sf):
    """The sums over partitions, solved, and the calibration, against one matrix of all rows and a slow isotonic fit."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    label = {r.doc_id: r.quality for r in labels.collect()}
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    source = documents(spark, sf).collect()
    stats = np.array([quality.statistics(r.text or "") for r in source])
    own = np.array([fold(r.doc_id) if r.doc_id in label else 0 for r in source])
    y = np.array([label.get(r.doc_id, 0) for r in source], float)
    used = own > 0
    model = quality.Model(stats[used].mean(axis=0), np.maximum(stats[used].std(axis=0), 1e-6), None, None)
    z = model.lift(stats)
    fit = own > 1
    ridge = quality.RIDGE * fit.sum() / (quality.FEATURES + 1 - 1)
    model.weights = np.linalg.solve(z[fit].T @ z[fit] + ridge * np.eye(z.shape[1]), z[fit].T @ y[fit])
    raw = z @ model.weights
    bins = defaultdict(list)
    for i in np.flatnonzero(own == 1):
        bins[math.floor(raw[i] * quality.BINS)].append(i)
    x, v, w = (np.array(c) for c in zip(*[(raw[b].mean(), y[b].mean(), len(b)) for _, b in sorted(bins.items())], strict=True))
    steps = [max(min(v[a : b + 1] @ w[a : b + 1] / w[a : b + 1].sum() for b in range(i, len(v))) for a in range(i + 1)) for i in range(len(v))]
    got = {r.doc_id: r.score for r in quality.quality(documents(spark, sf), labels).collect()}
    level = np.array(steps)
    at = [x[level == s] @ w[level == s] / w[level == s].sum() for s in sorted(set(steps))]
    want = np.clip(np.interp(raw, at, sorted(set(steps))), 0, 1)
    assert max(abs(got[r.doc_id] - s) for r, s in zip(source, want, strict=True)) < 1e-4


def test_quality_edges(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.quality(odd(spark), none).collect()} == {0.5}
    some = spark.createDataFrame([(1, 0), (4, 1), (5, 0), (5, 1), (6, None), (None, 1)], "doc_id long, quality int")
    assert quality.quality(odd(spark), some).count() == len(ODD)
    assert quality.quality(odd(spark).limit(0), some).count() == 0
    x, y = quality.isotonic(np.arange(4.0), np.array([0.0, 0.6, 0.4, 1.0]), np.ones(4))
    assert y.tolist() == [0.0, 0.5, 1.0] and x.tolist() == [0.0, 1.5, 3.0]


def sets(texts, size):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    return out


def classes(ids, texts, size, percent):
    s = sets(texts, size)
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            both = len(s[i] & s[j])
            if both and 100 * both >= percent * (len(s[i]) + len(s[j]) - both):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(ids)):
        groups[find(i)].append(ids[i])
    name = {g: min((x for x in v if x is not None), default=None) for g, v in groups.items()}
    return sorted(((ids[i], len(s[i]), name[find(i)], ids[i] == name[find(i)]) for i in range(len(ids))), key=str)


def check_copies(docs, size, percent):
    source = docs.collect()
    assert rows(neardup.near_duplicates(docs, size, percent)) == classes([r.doc_id for r in source], [r.text for r in source], size, percent)


def test_near_copies(spark, sf):
    check_copies(documents(spark, sf), 3, 85)
    check_copies(odd(spark), 3, 85)
    check_copies(odd(spark).limit(0), 5, 80)


@pytest.mark.parametrize("with_base", [True, False])
def test_family_of_near_copies(spark, with_base):
    """Copies of one text with few to many edits, chains of copies, and a passage that all share."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(900)}" for _ in range(160)]
    texts = [" ".join(base)] if with_base else []
    for _ in range(150):
        t = list(base)
        for _ in range(rng.choice([1, 2, 3, 5, 8, 12, 20])):
            t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    chain = list(base)
    for _ in range(15):
        chain = chain[4:] + [f"y{rng.randrange(10**6)}" for _ in range(3)]
        texts.append(" ".join(chain))
    texts += [" ".join(base[:40] + [f"z{rng.randrange(10**6)}" for _ in range(rng.randrange(100))]) for _ in range(60)]
    rng.shuffle(texts)
    check_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, 85)


def test_one_row_of_each_component_stays(spark):
    """Ids on rows of different texts, exact repeats, and copies without an id."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    source = [(1, a), (2, a), (2, b), (3, b), (3, c), (4, d), (4, d), (None, d), (None, a + " more"), (None, "no id"), (None, "no id"), (5, ""), (5, ""), (5, None), (6, "")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(source)], "doc_id long, text string, `a.b` int")
    got = neardup.drop_copies(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, a), (2, b), (3, c), (4, d), (None, "no id"), (5, ""), (5, None), (6, "")], key=str)
    assert neardup.drop_copies(docs.limit(0)).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 70)] + [(100, 101), (5, 5), (None, 3), (101, 100)]
    got = dict(tuple(r) for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {i: 1 for i in range(1, 71)} | {100: 100, 101: 100}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("size", [40, 4000])
def test_fingerprints(spark, sf, monkeypatch, size):
    monkeypatch.setattr(fingerprint, "ROWS_PER_RANGE", size)
    for docs in (documents(spark, sf), odd(spark), odd(spark).limit(0), odd(spark).limit(1)):
        source = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "", r.doc_id) for r in docs.collect()))
        want = []
        for i, (_, _, text, doc_id) in enumerate(source):
            following = source[(i + 1) % len(source)][2]
            half = len(text) // 2
            other = (text[: len(text) - half] + following[:half]).encode()
            a, b, c = (fingerprint.fingerprint(x) for x in (text.encode(), other, following.encode()))
            want.append((doc_id, len(text), hashlib.sha256(other).hexdigest(), a.tobytes().hex(), b.tobytes().hex(), fingerprint.likeness(a, b), fingerprint.likeness(a, c)))
        assert rows(fingerprint.digest(docs)) == sorted(want, key=str)


def test_next_of_ids_beyond_doubles(spark, monkeypatch):
    """Hashed ids of 64 bits, ids next to each other at both ends of the range, and nulls, over several ranges."""
    monkeypatch.setattr(fingerprint, "ROWS_PER_RANGE", 20)
    rng = random.Random(13)
    top, low = 2**63 - 1, -(2**63)
    for ids in ([rng.randrange(low, top) for _ in range(300)], [top - 700 * i for i in range(300)], [top - i for i in range(150)] + [low + i for i in range(150)], [low] * 60 + [top] * 60):
        source = [(i, f"text {k}") for k, i in enumerate([*ids, None, None])]
        rng.shuffle(source)
        docs = spark.createDataFrame(source, "doc_id long, text string").repartition(3)
        ordered = sorted(source, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        want = [(i, t, ordered[(k + 1) % len(ordered)][1]) for k, (i, t) in enumerate(ordered)]
        assert rows(fingerprint.with_next(docs, lambda a, b: (a, b), "text string, following string")) == sorted(want, key=str)


def counted(data):
    """A digest by its definition: six triplets of every window of five bytes that lie inside the data, by plain counting."""
    buckets = [0] * 256
    for k, (x, y, z) in enumerate([(0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4)]):
        for i in range(len(data) - z):
            h = (data[i + x] * 0x01000193 + data[i + y] * 0x0001F35B + data[i + z] * 0x00009E37 + k * 0x2545F491) * 0x9E3779B1 % 2**32
            buckets[h >> 24] += 1
    q = [sorted(buckets)[i] for i in (63, 127, 191)]
    codes = [sum(c > x for x in q) for c in buckets]
    packed = bytes(codes[i] + 4 * codes[i + 1] + 16 * codes[i + 2] + 64 * codes[i + 3] for i in range(0, 256, 4))
    return bytes([min(255, int(math.log(len(data) + 1) / math.log(1.05)))]) + packed, codes


def test_fingerprint_by_its_definition():
    rng = random.Random(18)
    texts = [b"", b"a", b"ab", b"abc", b"abcd", b"abcde", bytes(1000), *(bytes(rng.randrange(97, 107) for _ in range(n)) for n in (10, 100, 3000))]
    made = [counted(t) for t in texts]
    assert [fingerprint.fingerprint(t).tobytes() for t in texts] == [m[0] for m in made]
    for a, ca in made:
        for b, cb in made:
            diff = sum(abs(x - y) for x, y in zip(ca, cb, strict=True)) + 4 * min(16, abs(a[0] - b[0]))
            assert fingerprint.likeness(np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)) == pytest.approx(1 - diff / (3 * 256 + 64))


def test_fingerprints_tell_edits_from_others(spark, sf):
    out = fingerprint.digest(documents(spark, sf)).filter("n_chars > 50").collect()
    assert sum(r.near_edited > r.near_next for r in out) >= 0.97 * len(out)


def test_bpe(spark, sf):
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    reference = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(12)
    texts = [r.text for r in documents(spark, sf).limit(80).collect()] + ["a" * 3000, "é" * 999, " " * 200 + "z", "ab" * 900, "日本語🙂🙂 don't we've\n\n\t 12345", *("".join(rng.choice("abé 🙂'sl1\n") for _ in range(80)) for _ in range(200))]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, None), (-1, "")], "doc_id long, text string").selectExpr("*", "1 as ids")
    got = {r.doc_id: r for r in bpe.digest(docs, path, pattern).collect()}
    for i, t in [*enumerate(texts), (None, ""), (-1, "")]:
        ids = reference.encode_ordinary(t)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    back = bpe.decode(bpe.encode(docs.select("doc_id", "text"), path, pattern), path)
    assert {r.doc_id: bytes(r.decoded).decode() for r in back.collect()} == {i: t for i, t in [*enumerate(texts), (None, ""), (-1, "")]}


def test_perfect_hash():
    keys = [bytes([a, b]) for a in range(100) for b in range(50)] + [b""]
    table = bpe.PerfectHash(keys)
    assert table.find(keys) == list(range(len(keys))) and table.find([b"no", b"\xff\xff\xff"]) == [-1, -1]
    assert sorted(table.slot.tolist()) == list(range(len(keys)))


def test_sets_of_one_digest(spark):
    """Sets that share their first digest alone are classes of their own."""
    rows = spark.createDataFrame([(1, 1, 10), (2, 1, 10), (3, 1, 20), (4, 2, 5), (5, None, None), (6, 1, 30)], "doc_id long, `set` long, second long")
    named = {r.doc_id: r["set"] for r in neardup._renamed(rows).collect()}
    assert named[1] == named[2] == 1 and named[4] == 2 and named[5] is None
    assert len({named[i] for i in (1, 3, 4, 6)}) == 4
    assert neardup._renamed(rows.filter("second <> 20 and second <> 30")).count() == 3
