"""Queries of the training-data operators over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, fingerprint, licenses, lm, neardup, pii, quality, search, sharding, substrings, trie, warc
from .common import documents


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contamination(documents(spark, sf_dir), items).drop("key")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(documents(spark, sf_dir))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(documents(spark, sf_dir))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), size=3, percent=85)


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.digest(documents(spark, sf_dir))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digest(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digest(documents(spark, sf_dir))


def op11_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(documents(spark, sf_dir))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_warc": op2_warc,
    "op3_pii": op3_pii,
    "op4_substrings": op4_substrings,
    "op5_quality": op5_quality,
    "op6_sharding": op6_sharding,
    "op7_neardup": op7_neardup,
    "op8_fingerprint": op8_fingerprint,
    "op9_bpe": op9_bpe,
    "op10_licenses": op10_licenses,
    "op11_lm": op11_lm,
    "op12_trie": op12_trie,
    "op13_search": op13_search,
}

#: SQL of lower-casing A to Z, and of the words of a text.
_LOW = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: str) -> str:
    return f"regexp_extract_all({_LOW.format(text)}, '{_WORD}')"


OP1 = f"""WITH item AS (SELECT item_id, w, len(w) AS n, least(len(w), {decontaminate.SPAN}) AS k FROM (SELECT item_id, {_words('text')} AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, w[j:j + k - 1] AS g FROM (SELECT *, unnest(range(1, n - k + 2)) AS j FROM item)),
doc AS (SELECT doc_id, {_words('text')} AS w FROM documents),
pos AS (SELECT doc_id, k, j, w[j:j + k - 1] AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM doc, (SELECT DISTINCT k FROM win))),
hit AS (SELECT DISTINCT doc_id, item_id, j, pos.k FROM pos JOIN win ON pos.g = win.g AND pos.k = win.k),
spots AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + k)) AS p FROM hit) GROUP BY 1),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, item_id::varchar AS i FROM hit) GROUP BY 1)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM doc LEFT JOIN spots USING (doc_id) LEFT JOIN found USING (doc_id)"""

OP2 = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), g AS (SELECT h, max(page_id) AS newest FROM p GROUP BY 1)
SELECT page_id, octet_length(encode(h))::bigint AS payload_bytes,
array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (16 * bits[5 * i + 1] + 8 * bits[5 * i + 2] + 4 * bits[5 * i + 3] + 2 * bits[5 * i + 4] + bits[5 * i + 5])::int, 1)), '') AS payload_digest,
CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> newest THEN newest END AS refers_to
FROM (SELECT *, list_transform(string_split(unhex(sha1(h))::bit::varchar, ''), lambda c: c::int) AS bits FROM p JOIN g USING (h))"""


def _op3() -> str:
    """Base spans and secrets by the plain patterns: pieces between matches and the matches give the places."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]", "secret": "[A-Za-z0-9_-]{20,}",
    }
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(length({digits})), lambda i: CASE WHEN i % 2 = 0 THEN substr(reverse({digits}), i + 1, 1)::int ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][substr(reverse({digits}), i + 1, 1)::int + 1] END)) % 10 = 0"
    valid = {
        "email": "true", "ip": "list_max(list_transform(string_split(m, '.'), lambda x: CASE WHEN length(ltrim(x, '0')) > 3 THEN 999 ELSE coalesce(try_cast(ltrim(x, '0') AS int), 0) END)) <= 255",
        "card": f"length({digits}) BETWEEN 13 AND 19 AND {luhn}", "phone": f"length({digits}) BETWEEN 9 AND 15",
        "secret": f"length({digits}) >= {pii.SECRET_DIGITS} AND regexp_matches(m, '[A-Za-z]') AND len(list_distinct(string_split(m, ''))) >= {pii.SECRET_DISTINCT}",
    }
    parts = []
    for i, (kind, pattern) in enumerate(plain.items()):
        pieces = f"string_split_regex(t, '{pattern}')"
        located = f"SELECT doc_id, unnest(regexp_extract_all(t, '{pattern}')) AS m, unnest(list_slice({pieces}, 1, -2)) AS gap, unnest(list_slice({pieces}, 2, -1)) AS after, generate_subscripts(regexp_extract_all(t, '{pattern}'), 1) AS k FROM d"
        placed = f"SELECT *, (sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY k))::bigint AS e FROM ({located})"
        word = "(^|[^a-z0-9])(" + "|".join(pii.CONTEXT[kind]) + ")s?([^a-z0-9]|$)"
        near = " OR ".join(f"regexp_matches({_LOW.format(side)}, '{word}')" for side in (f"right(gap, {pii.CONTEXT_CHARS})", f"left(after, {pii.CONTEXT_CHARS})"))
        scored = f"SELECT *, {pii.PRIOR[kind]} + CASE WHEN {near} THEN {pii.CONTEXT_GAIN} ELSE 0 END AS score FROM ({placed}) WHERE {valid[kind]}"
        parts.append(f"SELECT doc_id, {i} AS o, '{kind}' AS kind, e - length(m) AS s, e, score FROM ({scored})" + (f" WHERE score >= {pii.LEAST_SCORE}" if kind not in pii.BASE_KINDS else ""))
    counts = ", ".join(f"coalesce(count(*) FILTER (kind = '{k}'), 0) AS n_{k}" for k in plain)
    span = "kind || ':' || s::varchar || ':' || e::varchar"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), sp AS ({' UNION ALL '.join(parts)}),
a AS (SELECT doc_id, {counts}, count(*) AS n_spans, string_agg({span}, ',' ORDER BY o, s) FILTER (kind <> 'secret') AS base, string_agg({span}, ',' ORDER BY o, s) AS spans, string_agg(printf('%.2f', score::double), ',' ORDER BY o, s) AS scores FROM sp GROUP BY 1)
SELECT d.doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in plain)}, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores FROM d LEFT JOIN a USING (doc_id)"""


def _op10() -> str:
    """Phrases by places; templates by all blocks of the documents that hold enough of their words."""
    phrases = ", ".join(f"('{p}', '{label}', {p.split()!r})" for p, label in licenses.BASE.items())
    templates = ", ".join(f"('{label}', {sorted(set(t.split()))!r}, {licenses.needed(len(set(t.split())))}, {licenses.width(t)})" for label, t in licenses.TEMPLATES)
    return f"""WITH d AS (SELECT doc_id, {_words('text')} AS w FROM documents),
ph(p, label, pw) AS (VALUES {phrases}), tp(tl, tw, least, width) AS (VALUES {templates}),
b AS (SELECT doc_id, label, j - 1 AS place FROM (SELECT doc_id, w, label, pw, unnest(range(1, len(w) - len(pw) + 2)) AS j FROM d, ph WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' ' || p || ' ')) WHERE w[j:j + len(pw) - 1] = pw),
bb AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY 1),
c AS (SELECT doc_id, w, tl, tw, least, width FROM (SELECT *, list_distinct(w) AS dw FROM d), tp WHERE len(list_intersect(dw, tw)) >= least),
t AS (SELECT doc_id, tl, len(list_intersect(w[j:j + width - 1], tw)) / len(tw) AS c, least / len(tw) AS need FROM (SELECT *, unnest(range(1, len(w) + 1)) AS j FROM c)),
f AS (SELECT doc_id, tl, max(c) AS best FROM t WHERE c >= need GROUP BY 1, 2),
tt AS (SELECT doc_id, max(best) AS best FROM f GROUP BY 1),
al AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM b UNION SELECT doc_id, tl FROM f) GROUP BY 1)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END, 6) AS score
FROM d LEFT JOIN bb USING (doc_id) LEFT JOIN tt USING (doc_id) LEFT JOIN al USING (doc_id)"""


_CRC = "(list_reduce([4294967295] || list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::bigint), lambda x, y: list_reduce([xor(x, y)] || range(8), lambda u, v: xor(u >> 1, 3988292384 * (u & 1)))))"

#: Nodes are paths of turn digests; subtrees by every node's prefixes.
OP12 = f"""WITH o AS (SELECT conv_id::bigint AS c, md5(coalesce(role, '')) || md5(coalesce(text, '')) AS d, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint AS w,
row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS p FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT c, xor({_CRC}, 4294967295) % 4 AS h FROM (SELECT DISTINCT c FROM o)),
hd AS (SELECT k.c, o.p, o.d, o.w FROM k JOIN o ON o.c = k.c - k.c % 20 AND o.p <= k.h),
m AS (SELECT c, count(*) AS m FROM hd GROUP BY 1),
rb AS (SELECT * FROM hd UNION ALL SELECT o.c, o.p - k.h + coalesce(m, 0), o.d, o.w FROM o JOIN k USING (c) LEFT JOIN m USING (c) WHERE o.p > k.h),
pre AS (SELECT c, p AS depth, string_agg(d, '') OVER (PARTITION BY c ORDER BY p) AS path, w FROM rb UNION ALL SELECT c, 0, '', 0 FROM k),
n AS (SELECT c, max(depth) AS n FROM pre GROUP BY 1),
node AS (SELECT depth, path, min(c) AS conv_id, count(*) AS n_convs, any_value(w) AS w, string_agg(c::varchar, ',' ORDER BY c) FILTER (n = depth) AS ends FROM pre JOIN n USING (c) GROUP BY 1, 2),
kid AS (SELECT left(path, 64 * (depth::int - 1)) AS path, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1),
own AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kid USING (path)),
sub AS (SELECT left(path, 64 * u::int) AS path, sum((n_children = 0)::int)::bigint AS n_leaves, sum((n_convs - 1) * w)::bigint AS saved_tokens FROM (SELECT *, unnest(range(depth::int + 1)) AS u FROM own) GROUP BY 1)
SELECT own.conv_id, own.depth, up.conv_id AS parent_conv_id, own.n_convs, own.n_children, n_leaves, saved_tokens, sha256(coalesce(own.ends, '')) AS ends_sha256
FROM own JOIN sub USING (path) LEFT JOIN node up ON own.depth > 0 AND up.path = left(own.path, 64 * (own.depth::int - 1))"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
OP13 = f"""WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(text, '{_TERM}'), lambda x: {_LOW.format('x')}) AS w FROM documents),
s AS (SELECT count(*)::bigint AS docs, sum(len(w))::bigint AS terms FROM d WHERE len(w) > 0),
it AS (SELECT item_id, t, count(*) AS c FROM (SELECT item_id, unnest(list_transform(regexp_extract_all(text, '{_TERM}'), lambda x: {_LOW.format('x')})) AS t FROM benchmark) GROUP BY 1, 2),
tf AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM it) GROUP BY 1, 2, 3),
w AS (SELECT t, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)))::bigint AS w FROM tf, s GROUP BY 1),
sc AS (SELECT item_id, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::bigint AS score FROM tf JOIN it USING (t) JOIN w USING (t), s GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::int AS rank FROM sc WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {search.TOP}"""

#: Others: substrings, quality, shards, near copies, fingerprints and BPE are tested against plain Python.
ORACLE_SQL: dict[str, str] = {"op1_decontaminate": OP1, "op2_warc": OP2, "op3_pii": _op3(), "op10_licenses": _op10(), "op12_trie": OP12, "op13_search": OP13}
