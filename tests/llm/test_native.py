"""Decontamination, personal data, licenses and shards against plain Python."""

import hashlib
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import decontaminate, licenses, pii, sharding
from pulsegrid.llm.common import documents

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Null and empty texts, ties, repeated rows, a null id, one long text.
ODD = [(1, None), (2, ""), (3, "   \n\t"), (4, "same text"), (5, "same text"), (5, "same text"), (None, "without an id"), (6, "word " * 30_000), (7, "é日本🙂 a@b.cd 🙂 1.2.3.4")]


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def odd(spark):
    """ODD with columns of clashing names."""
    return spark.createDataFrame([(i, t, "x", 1, "k") for i, t in ODD], "doc_id long, text string, words string, n_words int, key string")


def contaminated(docs, items, span=13):
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(span, len(w))
        for j in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[j : j + n])].add(i)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if k := windows.get(tuple(w[j : j + n])):
                    hit.update(range(j, j + n))
                    found |= k
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def check_contamination(spark, docs, items):
    got = decontaminate.contamination(docs, items).drop("key")
    want = contaminated([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_contamination_of_the_tables(spark, sf):
    check_contamination(spark, documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"))


def test_contamination_edges(spark):
    long = [f"w{i}" for i in range(40)]
    items = [(1, " ".join(long[:20])), (2, " ".join(long[:13]).upper()), (3, "one two"), (4, "one two"), (5, ""), (6, None), (7, "solo"), (8, " ".join(long[5:17]))]
    docs = ODD + [(10, " ".join(long)), (11, " ".join(long[:12])), (12, " ".join(long[3:16]) + " x " + " ".join(long[3:16])), (13, "a one, two! b solo"), (14, " ".join(["filler"] * 300 + long[:13]))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_hit", F.lit("x"))
    check_contamination(spark, frame, spark.createDataFrame(items, "item_id long, text string"))
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(frame, none).filter("contaminated").count() == 0
    assert decontaminate.contamination(frame.limit(0), none).count() == 0


def test_contamination_random(spark):
    rng = random.Random(7)
    draw = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    docs = spark.createDataFrame([(i, draw(rng.randrange(60))) for i in range(60)], "doc_id long, text string")
    check_contamination(spark, docs, spark.createDataFrame([(i, draw(rng.randrange(20))) for i in range(8)], "item_id long, text string"))


def test_contamination_of_mixed_lengths(spark):
    """Items of all lengths at once, repeated words in texts and items, runs of one item that meet those of another."""
    rng = random.Random(11)
    draw = lambda n, of: " ".join(rng.choice(of) for _ in range(n))
    items = [(i, draw(i % 17, "ab" if i % 3 else "abcdefgh")) for i in range(40)] + [(100, "a " * 30), (101, "a " * 13), (102, "a " * 12)]
    docs = [(i, draw(rng.randrange(80), "ab" if i % 2 else "abcdefgh")) for i in range(40)] + [(200, "a " * 50), (201, "a " * 11), (202, "b " * 5 + "a " * 13)]
    check_contamination(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))


def test_contamination_of_repeated_words(spark):
    """100 000 equal words against items of 40 and 300 of them: a row for each window, whatever the items."""
    docs = [(1, "echo " * 20_000), (2, "echo " * 100_000), (3, "echo " * 12), (4, "one two three " * 10_000)]
    items = [(1, "echo " * 40), (2, "echo " * 300), (3, "two three one " * 5), (4, "two three " * 8)]
    got = {r.doc_id: tuple(r) for r in decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).drop("key").collect()}
    assert got[1][1:] == (20_000, 20_000, 2, sha("1,2"), True) and got[2][1:] == (100_000, 100_000, 2, sha("1,2"), True)
    assert got[3][1:] == (12, 0, 0, sha(""), False) and got[4][1:] == (30_000, 30_000, 1, sha("3"), True)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": lambda: True, "ip": lambda m=m: all(int(x) < 256 for x in m.group().split(".")), "card": lambda d=digits: 13 <= len(d) <= 19 and luhn(d), "phone": lambda d=digits: 9 <= len(d) <= 15}[kind]
            if ok():
                out.append((kind, m.start(), m.end()))
    return out


def check_pii(docs):
    got = sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.pii_digest(docs).collect()), key=str)
    want = []
    for r in docs.collect():
        spans = base_spans(r.text)
        n = Counter(s[0] for s in spans)
        want.append((r.doc_id, *(n[k] for k in PATTERNS), sha(",".join(f"{a}:{b}:{c}" for a, b, c in spans))))
    assert got == sorted(want, key=str)


def test_pii_of_the_tables(spark, sf):
    check_pii(documents(spark, sf))


def test_pii_edges(spark):
    check_pii(odd(spark))
    check_pii(odd(spark).limit(0))
    texts = ["a@b.c_d@e.fg.", "x@@y.zz a.b@c.d.e-f..g", "1.2.3.4.5.6.7.8 999.1.1.1.2 00001.2.3.255", "4111 1111 1111 1111 4111-1111-1111-1112 41111111--11111111", "+1 (555) 123-4567 +49.30.1 +123456789012345678", "9" * 5000, "a" * 20000 + "@b.cc", "a.b" * 5000 + "@x." + "y." * 5000]
    check_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_pii_random(spark):
    rng = random.Random(8)
    check_pii(spark.createDataFrame([(i, "".join(rng.choice("0123456789123.. -+()@a_é") for _ in range(rng.randrange(200)))) for i in range(400)], "doc_id long, text string"))


def test_pii_of_the_method(spark):
    rows = [(1, "account DE89 3704 0044 0532 0130 00 and DE88370400440532013000"), (2, "my ssn 123-45-6789"), (3, "part 123-45-6789")]
    got = {r.doc_id: r.spans for r in pii.pii_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].startswith("iban:8:35") and got[1].count("iban") == 1 and got[2] == "ssn:7:18" and got[3] == ""


def test_account_numbers_end_by_themselves(spark):
    one, two, cut, odd = "DE89370400440532013000", "GB82WEST12345698765432", "DE89 3704 0044 0532 0130 00", "XX46370400440532013000"
    texts = [
        f"IBAN {one} Please pay", f"{cut} BIC COBADEFF", f"{one} {two}", f"{cut} {two} {cut} 12", f"AB12 {one}", f"é🙂 {one}. {two}x {two}", f"{one[:-1]} 0 9", f"{odd} AND MORE",
        "MT84 MALT 0110 0001 2345 MTLC AST0 01S Is it", f"DE88370400440532013000 {one}", f"{one}Please", f"X{one}", "DE89 " * 3000 + one, "",
    ]
    want = [[one], [cut], [one, two], [cut, two, cut], [one], [one, two], [one[:-1] + " 0"], [odd], ["MT84 MALT 0110 0001 2345 MTLC AST0 01S"], [one], [], [], [one], []]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [r.text[s.start : s.end] for s in r.spans if s.kind == "iban"] for r in pii.find_pii(docs).collect()}
    assert got == dict(enumerate(want))
    assert [r.text for r in pii.redact(docs.filter("doc_id in (0, 2)")).orderBy("doc_id").collect()] == ["IBAN [IBAN] Please pay", "[IBAN] [IBAN]"]


def test_scores_and_secrets(spark):
    token, sha = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"
    texts = [f'token = "{token}"', f"commit {sha}", f"API_KEY={token}!", f"{token} is my password", "token " + "a" * 40, "key ein-sehr-langes-wort-mit-strichen", "keys 1234567890-1234567890-12", "ship 10.0.0.1", "my ip 10.0.0.1", "10.0.0.1 (hosts)", f"{'x ' * 40}{token} {'x ' * 40}token", "contact: é@x a@b.cc"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.spans, r.scores, r.n_secret, r.n_spans) for r in pii.pii_digest(docs).collect()}
    assert got == {
        0: ("secret:9:49", "0.50", 1, 1), 1: ("", "", 0, 0), 2: ("secret:8:48", "0.50", 1, 1), 3: ("secret:0:40", "0.50", 1, 1), 4: ("", "", 0, 0), 5: ("", "", 0, 0), 6: ("", "", 0, 0),
        7: ("ip:5:13", "0.60", 0, 1), 8: ("ip:6:14", "0.80", 0, 1), 9: ("ip:0:8", "0.80", 0, 1), 10: ("", "", 0, 0), 11: ("email:13:19", "1.00", 0, 1),
    }
    assert pii.redact(docs.filter("doc_id = 0")).first().text == 'token = "[SECRET]"'


def test_recall_of_planted_data(spark, sf):
    """Secrets, account numbers and ids planted in the tables' texts, and those that stand there: all are found, nothing else is."""
    rng = random.Random(19)
    source = [r.text or "" for r in documents(spark, sf).limit(120).collect()]
    rows, want = [], []
    for i, text in enumerate(source):
        token = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        planted, kind = [(f'token = "{token}"', "secret"), ("IBAN DE89 3704 0044 0532 0130 00", "iban"), ("SSN: 123-45-6789", "ssn"), ("", None)][i % 4]
        at = text.rfind(" ", 0, len(text) // 2) + 1
        rows.append((i, text[:at] + planted + " " + text[at:]))
        want.append(Counter({kind: 1} if kind else {}) + Counter({"secret": len(re.findall(r'token = "[0-9a-f]{40}"', text))}))
    got = {r.doc_id: Counter(s.kind for s in r.spans if s.kind not in pii.BASE_KINDS) for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == want


def test_many_spans(spark):
    """More spans than one block and chunk hold, in time that does not grow with their square."""
    n = 20_000
    text = " ".join(f"é{i}@b.cc" for i in range(n))
    docs = spark.createDataFrame([(1, text), (2, text[:5000])], "doc_id long, text string")
    check_pii(docs)
    want = re.sub(r"[0-9]+@b\.cc", "[EMAIL]", text)
    assert {r.doc_id: r.text for r in pii.redact(docs).collect()} == {1: want, 2: re.sub(r"[0-9]+@b\.c+", "[EMAIL]", text[:5000])}


def test_redact(spark):
    rows = [(1, "mail a@b.cc, host 10.0.0.1 🙂 +1 555 123 4567", 9), (2, None, 0), (3, "nothing", 7), (4, "é x@1.2.3.4 end", 1)]
    got = {r.doc_id: (r.text, r.n_chars) for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string, n_chars int")).collect()}
    assert got == {1: ("mail [EMAIL], host [IP] 🙂 [PHONE]", 9), 2: (None, 0), 3: ("nothing", 7), 4: ("é [EMAIL] end", 1)}


def license_rows(docs):
    """By every block of every text."""
    out = []
    for r in docs.collect():
        w, places, base = words(r.text), [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            places += at
            base |= {label} if at else set()
        labels, best = set(base), 0.0
        for label, template in licenses.TEMPLATES:
            t, n = set(template.split()), licenses.width(template)
            if len(t & set(w)) >= licenses.needed(len(t)):
                c = max(len(t & set(w[i : i + n])) for i in range(len(w)))
                if c >= licenses.needed(len(t)):
                    labels.add(label)
                    best = max(best, c / len(t))
        out.append((r.doc_id, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(1.0 if places else best, 6)))
    return sorted(out, key=str)


def test_licenses(spark, sf):
    rng = random.Random(14)
    notice = licenses.TEMPLATES[1][1].split()
    lines = ["CC BY cc by", "Licensed under CC BY-NC 4.0.", "all rights\n\nreserved General public   LICENSE", "released\nunder the MIT license", "Released under the MIT license, I say", " ".join(notice[1:]), " ".join(notice[:10] + ["x"] * 30 + notice[10:])]
    vocabulary = sorted({x for _, t in licenses.TEMPLATES for x in t.split()})
    lines += [" ".join(rng.choice([rng.choice(vocabulary), *notice[i % 5 : i % 5 + 3]]) for _ in range(200)) for i in range(40)]
    lines += [" ".join(["software the of"] * 3000 + notice)]
    extra = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    for docs in (documents(spark, sf), odd(spark), odd(spark).limit(0), extra):
        assert sorted((tuple(r) for r in licenses.license_digest(docs).collect()), key=str) == license_rows(docs)


def test_wrapped_notices_are_found(spark):
    """Each template in the middle of other words, wrapped at 40 to 80 columns, as a comment, with up to a tenth of its words changed."""
    rng = random.Random(15)
    rows, want = [], {}
    for label, template in licenses.TEMPLATES:
        for columns in (40, 60, 80):
            t = template.split()
            for i in rng.sample(range(len(t)), len(t) // 20):
                t[i] = "changed"
            filler = [rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(60)]
            text = "\n * ".join(textwrap.wrap(" ".join(filler[:30] + t + filler[30:]).capitalize(), columns))
            want[len(rows)] = label
            rows.append((len(rows), text, "x"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, `found.x` string")
    got = defaultdict(set)
    for r in licenses.find_templates(docs).collect():
        got[r.doc_id].add(r.found.label)
    assert sum(want[i] in got[i] for i in want) >= 0.95 * len(want)
    one = licenses.find_templates(docs.filter("doc_id = 3")).first()
    assert one["found.x"] == "x" and one.found.first == 30 and one.found.containment >= 0.9


def test_all_blocks(spark):
    """Copies of a notice in one text, next to each other and far apart, are blocks of their own, each with its place."""
    label, template = licenses.TEMPLATES[0]
    n = len(template.split())
    text = " ".join(["filler"] * 30 + template.split() + template.split() + ["other"] * 500 + template.split())
    rows = licenses.find_templates(spark.createDataFrame([(1, text), (2, template), (3, "nothing here")], "doc_id long, text string")).collect()
    got = sorted((r.doc_id, r.found.first) for r in rows if r.found.template == 0)
    assert got == [(1, 30), (1, 30 + n), (1, 530 + 2 * n), (2, 0)]
    assert all(r.found.containment == 1 for r in rows if r.found.template == 0)


def test_slots_of_a_hot_group(spark, monkeypatch):
    """100 000 equal texts: their slots are numbered in buckets of twice the usual rows at most."""
    sizes = []
    numbered = sharding._numbered

    def watched(df, keys, rows, by, order):
        sizes.append(df.groupBy(*keys, sharding._part(F.ceil(rows / sharding.ROWS_PER_BUCKET), by).alias("bucket")).count().agg(F.max("count")).first()[0] or 0)
        return numbered(df, keys, rows, by, order)

    monkeypatch.setattr(sharding, "_numbered", watched)
    docs = spark.range(100_000).select(F.col("id").alias("doc_id"), F.lit("the same").alias("text"))
    out = sharding.shard(docs, 3)
    assert out.groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("slots"), F.max("slot").alias("last")).filter("slots <> n or last <> n - 1 or n not in (33333, 33334)").count() == 0
    assert max(sizes) < 2 * sharding.ROWS_PER_BUCKET


@pytest.mark.parametrize("kind", ["tables", "odd", "hot", "empty"])
def test_shards(spark, sf, kind):
    docs = {
        "tables": lambda: documents(spark, sf), "odd": lambda: odd(spark), "empty": lambda: odd(spark).limit(0),
        "hot": lambda: spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"pair {i // 4}") for i in range(1500)], "doc_id long, text string"),
    }[kind]()
    rows = sharding.shard(docs).collect()
    source = docs.collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in source)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots[k]) for k in range(24)]
    assert not rows or max(counts) - min(counts) <= 1 and set(slots) <= set(range(24))
    found = sharding.cut_groups(docs, sharding.shard(docs)).first()
    if kind == "hot":  # 500 equal rows, 62 to a shard; then groups of 4, of which two may lie over each shard's end
        assert found.least_cut == 1 and found.n_cut <= 1 + 2 * 24
    if kind == "tables":
        assert found.n_cut == 0


@pytest.mark.parametrize(("groups", "rows", "least"), [(40, 6, 16), (20, 2, 4), (480, 2, 0), (1, 1000, 1), (30, 100, 6)])
def test_few_groups_are_cut(spark, groups, rows, least):
    """No more groups than the law `rows` must cut, where nothing else fills shards up."""
    docs = spark.createDataFrame([(i, f"group {i % groups}") for i in range(groups * rows)], "doc_id long, text string")
    out = sharding.shard(docs)
    found = sharding.cut_groups(docs, out).first()
    assert found.n_groups == groups and found.n_cut == least
    counts = [r.n for r in out.groupBy("shard").agg(F.count("*").alias("n")).collect()]
    assert sum(counts) == groups * rows and max(counts) - min(counts) <= 1


def test_balance_is_exact(spark):
    """Random holdings: every group goes once, every shard holds what it may."""
    rng = random.Random(16)
    for _ in range(300):
        held = Counter()
        for _ in range(rng.randrange(1, 120)):
            held[rng.randrange(24), rng.choice([1, 1, 2, 3, 5, 8, 30, rng.randrange(1, 200)])] += 1
        total = sum(size * n for (_, size), n in held.items())
        want = [-(-(k + 1) * total // 24) - -(-k * total // 24) for k in range(24)]
        plan = sharding.Balance(dict(held), want)
        load = Counter()
        for (k, size), n in held.items():
            load[k] += size * n
        for (k, size), moves in plan.moves.items():
            for first, last, to in moves:
                load[k] -= size * (last - first)
                load[to] += size * (last - first)
        for (k, size, _), cuts in plan.cuts.items():
            load[k] -= size
            assert [c[0] for c in cuts] == [0, *[c[1] for c in cuts[:-1]]] and cuts[-1][1] == size
            for first, last, to in cuts:
                load[to] += last - first
        assert [load[k] for k in range(24)] == want
