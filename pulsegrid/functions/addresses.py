"""Text to network addresses, by column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BYTE = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"{_BYTE}(\.{_BYTE}){{3}}"
_GROUPS = r"[0-9A-Fa-f]{1,4}(:[0-9A-Fa-f]{1,4})*"


def _let(value: Column, then) -> Column:  # noqa: ANN001
    return F.transform(F.array(value), then)[0]


def _byte(number: Column) -> Column:
    return F.lpad(F.hex(number.cast("long")), 2, "0")


def _hex4(text: Column) -> Column:
    """Eight hex digits of four numbers with dots."""
    return F.array_join(F.transform(F.split(text, r"\."), _byte), "")


def _groups(text: Column) -> Column:
    """Groups of hex digits between colons, none of empty text."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ":"))


def _hex6(text: Column) -> Column:
    """32 hex digits of an IPv6 address, null for anything else: dots become two groups, and :: is what is missing to eight."""
    last = F.regexp_extract(text, rf":({_V4})$", 1)

    def expanded(t: Column) -> Column:
        parts = F.split(t, "::")

        def joined(ab: Column) -> Column:
            a, b = ab["a"], ab["b"]
            n = F.size(a) + F.size(b)
            gap = F.size(parts) == 2
            # :: stands for one group at least
            fits = F.when(gap, n <= 7).otherwise(n == 8)
            every = F.concat(a, F.array_repeat(F.lit("0"), F.greatest(8 - n, F.lit(0))), b)
            return F.when(fits, F.upper(F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), "")))

        halves = F.struct(_groups(parts[0]).alias("a"), F.when(F.size(parts) == 2, _groups(F.get(parts, F.lit(1)))).otherwise(F.array().cast("array<string>")).alias("b"))
        side = rf"^({_GROUPS})?$"
        fine = (F.size(parts) <= 2) & parts[0].rlike(side) & F.coalesce(F.get(parts, F.lit(1)), F.lit("")).rlike(side)
        return F.when(fine & (t != ""), _let(halves, joined))

    dotted = F.concat(F.substring(text, 1, F.length(text) - F.length(last)), F.substring(_hex4(last), 1, 4), F.lit(":"), F.substring(_hex4(last), 5, 4))
    return _let(F.when(last != "", dotted).otherwise(text), expanded)


_MAPPED = "0" * 20 + "FFFF"


def _hex(column: str | Column) -> Column:
    """32 hex digits of an IPv4 (as mapped) or IPv6 address without a zone; null for anything else."""
    text = F.col(column) if isinstance(column, str) else column
    return _let(text.cast("string"), lambda t: F.when(t.rlike(rf"^{_V4}$"), F.concat(F.lit(_MAPPED), _hex4(t))).otherwise(_hex6(t)))


def ipv4_bytes(column: str | Column) -> Column:
    """4 bytes of an IPv4 address, also of a mapped one; null for anything else."""
    return _let(_hex(column), lambda h: F.when(h.startswith(_MAPPED), F.unhex(F.substring(h, 25, 8))))


def ipv6_bytes(column: str | Column) -> Column:
    """16 bytes of an address; IPv4 as ::ffff:a.b.c.d; null for anything else."""
    return F.unhex(_hex(column))
