"""Personal data: regular expressions propose spans, checks confirm them, words nearby adjust the score.

Checks are Luhn for cards, mod-97 for account numbers, ranges for addresses and phone numbers, and a mix of characters for
secrets such as keys and tokens. A word of CONTEXT within CONTEXT_CHARS of a span (but not beyond the span of its kind before
or after it) adds CONTEXT_GAIN; kinds that a shape alone does not prove are left out below LEAST_SCORE.

One row in, one row out, without a shuffle or Python. Positions are code points, ends exclusive. A null or empty text has
no spans, an empty table gives an empty table, repeated rows each get their own answer. Time is linear in a text but for the
arrays of its spans, which grow in blocks of BLOCK (n spans take about n^1.5 copies of 8 bytes). Columns of the input other
than the key and the text are left out of `find_pii` and kept by `redact`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "secret")

#: Every pattern finds what the plain form of it finds, leftmost and non-overlapping, in time linear in the text:
#: possessive loops never give back, and look-behinds stop a search from starting anew inside a run that has failed.
#: For iban that holds for the first four characters alone; group 1 looks ahead over all that may belong to them, and the
#: character after it, and `_accounts` decides where the account number ends.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+[A-Za-z0-9]?))[A-Z]{2}[0-9]{2}",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"[A-Za-z0-9_-]{20,}+",
}
#: A text without a match of this cannot have the kind.
GUARDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]{2}|[0-9][\x20-][0-9]", "phone": r"\+[0-9]", "iban": "[A-Z]{2}[0-9]{2}", "ssn": "[0-9]-[0-9]{2}-[0-9]", "secret": "(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20}"}
CONTEXT = {
    "email": ("mail", "email", "e-mail", "contact", "write", "reply"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "credit", "visa", "pay", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank"),
    "ssn": ("ssn", "social", "security"),
    "secret": ("token", "secret", "key", "apikey", "api_key", "password", "passwd", "pwd", "auth", "bearer", "credential", "credentials", "private"),
}
#: Score before the context is looked at: checksums count for more than shapes.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3, "secret": 0.3}
CONTEXT_GAIN, CONTEXT_CHARS, LEAST_SCORE = 0.2, 40, 0.5
#: A secret has digits and letters, and so many different characters: words and numbers with hyphens do not.
SECRET_DIGITS, SECRET_DISTINCT = 3, 10
#: Items that are appended to one array; arrays of more are made of several.
BLOCK = 128
#: Characters of a text that are cut out at a time.
CHUNK = 2048

#: Account numbers have so many characters, blanks left out; countries that are not listed may have any from 15 to 34.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}

_SPAN = "struct<start:int,end:int,found:string,before:string,after:string>"


def _scan(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """What step(state, item) → (state, value) makes of items one after the other; null values are left out. kind: the values' type.

    Values are appended to arrays of BLOCK at most, and these to one another, so that n values take n^1.5 copies, not n^2.
    """
    none, nested = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def one(acc: Column, x: Column) -> Column:
        after, value = step(acc["state"], x)
        return F.struct(after.alias("state"), F.when(value.isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(value))).alias("out"))

    def block(acc: Column, part: Column) -> Column:
        made = F.aggregate(part, F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return F.transform(F.array(made), lambda m: F.struct(m["state"].alias("state"), F.concat(acc["out"], F.array(m["out"])).alias("out")))[0]

    starts = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
    blocks = F.transform(starts, lambda i: F.slice(items, i, BLOCK))
    return F.aggregate(blocks, F.struct(state.alias("state"), nested.alias("out")), block, lambda acc: F.flatten(acc["out"]))


def _located(text: Column, kind: str) -> Column:
    """Start, end and text of each match and what stands before and after it: the pieces between matches and the matches
    together give the positions."""
    pattern = PATTERNS[kind]
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(int(kind == "iban")))

    def step(pos: Column, x: Column) -> tuple[Column, Column]:
        start = pos + F.length(x["gap"])
        end = start + (F.lit(4) if kind == "iban" else F.coalesce(F.length(x["found"]), F.lit(0)))
        near = [F.right(x["gap"], F.lit(CONTEXT_CHARS)).alias("before"), F.substring(x["next"], 1, CONTEXT_CHARS).alias("after")]
        return end, F.when(x["found"].isNotNull(), F.struct(start.alias("start"), end.alias("end"), x["found"].alias("found"), *near))

    # with the pieces found once for all uses of them
    located = F.transform(
        F.array(F.struct(gaps.alias("gaps"), found.alias("found"))),
        lambda p: _scan(F.arrays_zip(p["gaps"].alias("gap"), p["found"].alias("found"), F.slice(p["gaps"], 2, F.size(p["gaps"])).alias("next")), F.lit(0), step, _SPAN),
    )[0]
    located = _accounts(located) if kind == "iban" else located
    return F.when(text.rlike(GUARDS[kind]), located).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _accounts(heads: Column) -> Column:
    """Of the places where an account number can begin, those where one does, leftmost and non-overlapping.

    It ends where its check is right: at its country's length if that is so, else at the greatest length for which it is. An
    end is never inside a word. What has no right end takes nothing from the places after it.
    """
    lengths = F.create_map(*[F.lit(x) for n, names in IBAN_LENGTHS.items() for c in names.split() for x in (c, n)])

    def account(run: Column) -> Column:
        own = F.try_element_at(lengths, F.substring(run, 1, 2))
        sizes = F.concat(F.when(own.isNull(), F.array().cast("array<int>")).otherwise(F.array(own)), F.sequence(F.lit(34), F.lit(15)))
        ends = F.transform(sizes, lambda n: F.regexp_substr(run, F.concat(F.lit(r"^(?:\x20?[A-Z0-9]){"), n, F.lit("}(?![A-Za-z0-9])"))))
        return F.get(F.filter(ends, lambda x: x.isNotNull() & (mod97(F.coalesce(x, F.lit(""))) == 1)), 0)

    def step(pos: Column, x: Column) -> tuple[Column, Column]:
        end = x["start"] + F.length(x["found"])
        fresh = x["found"].isNotNull() & (x["start"] >= pos)
        one = F.struct(x["start"].alias("start"), end.alias("end"), x["found"].alias("found"), x["before"].alias("before"), x["after"].alias("after"))
        return F.when(fresh, end).otherwise(pos), F.when(fresh, one)

    ended = F.transform(heads, lambda x: F.struct(x["start"].alias("start"), account(x["found"]).alias("found"), x["before"].alias("before"), x["after"].alias("after")))
    return F.transform(F.array(ended), lambda e: _scan(e, F.lit(0), step, _SPAN))[0]


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def part(c: Column, i: Column) -> Column:
        d = c.cast("int")
        doubled = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), part), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def mod97(code: Column) -> Column:
    """The remainder that an account number of the IBAN form leaves; 1 if it is right."""
    compact = F.regexp_replace(code, "\x20", "")
    turned = F.concat(F.substring(compact, 5, 64), F.substring(compact, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        v = F.ascii(c)
        return F.when(v < 65, (acc * 10 + (v - 48)) % 97).otherwise((acc * 100 + (v - 55)) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c)))


def _valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        return ~F.exists(F.split(found, r"\."), lambda p: ~p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$"))
    if kind == "card":
        return luhn(_digits(found))
    if kind == "phone":
        return F.length(_digits(found)).between(9, 15)
    if kind == "secret":
        return (F.length(_digits(found)) >= SECRET_DIGITS) & found.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(found, ""))) >= SECRET_DISTINCT)
    return F.lit(True)  # an iban has been checked where its end was looked for


def _score(kind: str, span: Column) -> Column:
    word = "(^|[^a-z0-9])(" + "|".join(CONTEXT[kind]) + ")s?([^a-z0-9]|$)"
    near = lower_ascii(span["before"]).rlike(word) | lower_ascii(span["after"]).rlike(word)
    return F.lit(PRIOR[kind]) + F.when(near, F.lit(CONTEXT_GAIN)).otherwise(F.lit(0.0))


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text (null as empty) and spans: array of (kind, start, end, score), by kind in the order of KINDS, then start.

    Kinds of BASE_KINDS stay whatever their score; others need LEAST_SCORE.
    """
    out = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = out.select("*", *[_located(F.col("text"), k).alias(f"at_{k}") for k in KINDS])

    def judged(kind: str) -> Column:
        spans = F.transform(
            F.filter(F.col(f"at_{kind}"), lambda s: _valid(kind, s["found"])),
            lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.round(_score(kind, s), 2).alias("score")),
        )
        return spans if kind in BASE_KINDS else F.filter(spans, lambda s: s["score"] >= LEAST_SCORE)

    return out.select(key, "text", F.concat(*[judged(k) for k in KINDS]).alias("spans"))


def span_list(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def pii_digest(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, of secrets and of all spans, the digest of the base spans, all spans, and their scores."""
    base = F.filter(F.col("spans"), lambda s: s["kind"].isin(*BASE_KINDS))

    def of(kind: str) -> Column:
        return F.filter(F.col("spans"), lambda s: s["kind"] == kind)

    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in (*BASE_KINDS, "secret")]
    scores = F.array_join(F.transform("spans", lambda s: F.format_string("%.2f", s["score"])), ",")
    return find_pii(docs).select("doc_id", *counts, F.size("spans").cast("long").alias("n_spans"), F.sha2(span_list(base), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"), scores.alias("scores"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span, base or not, replaced by its kind in brackets; overlapping spans become one.

    All columns stay; a null text stays null.
    """
    names = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text}`").alias("text"))
    found = find_pii(whole, "row", "text")
    ordered = F.array_sort(F.transform(F.col("spans"), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("last"), s["kind"].alias("kind"))))

    def step(pos: Column, s: Column) -> tuple[Column, Column]:
        piece = F.struct(pos.alias("from"), s["start"].alias("upto"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("label"))
        return F.greatest(pos, -s["last"]), F.when(s["start"] >= pos, piece)

    ended = F.concat(ordered, F.array(F.struct(F.length("text").alias("start"), (-F.length("text")).alias("last"), F.lit("").alias("kind"))))
    pieces = F.transform(F.array(ended), lambda e: _scan(e, F.lit(0), step, "struct<from:int,upto:int,label:string>"))[0]
    # characters from..upto lie in some chunks of the text: a piece is cut out of these alone
    chunks = F.regexp_extract_all(F.col("text"), F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))

    def cut(parts: Column, p: Column) -> Column:
        first = F.floor(p["from"] / CHUNK).cast("int")
        some = F.slice(parts, first + 1, F.floor(p["upto"] / CHUNK).cast("int") - first + 1)
        return F.concat(F.substring(F.array_join(some, ""), p["from"] - first * CHUNK + 1, p["upto"] - p["from"]), F.when(p["label"] == "[]", "").otherwise(p["label"]))

    changed = F.transform(F.array(F.struct(pieces.alias("pieces"), chunks.alias("chunks"))), lambda x: F.array_join(F.transform(x["pieces"], lambda p: cut(x["chunks"], p)), ""))[0]
    clean = F.when(F.size("spans") > 0, changed).otherwise(F.col("row")[text])
    return found.select("row", clean.alias("clean")).select(*[F.col("clean").alias(c) if c == text else F.col("row")[c].alias(c) for c in names])
