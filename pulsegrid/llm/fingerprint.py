"""Document fingerprints: a quartile bucket digest of hashed byte triplets.

Triplets of bytes from a sliding window of five are hashed into BUCKETS counters. The digest holds a length code and for
every bucket the quartile that its count lies in, two bits each. Two digests are compared by a difference that is bounded
by MAX_DIFF, so likeness lies between 0 and 1. Equal bytes have equal digests.

`with_next` lays each document beside the one that follows it by doc_id, without a global sort in one task: ids are cut
into ranges near their quantiles, each range is one task's, and the first document of a range also goes to the range before.
Null ids come first; rows of equal id are in the order of their texts; the last is followed by the first. Null texts count as
empty; texts of fewer than three bytes have empty buckets and are told apart by length alone; very long ones are read whole, with
BUCKETS counters beside them. An empty table gives an empty table. Columns but id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 256
LENGTH_STEP = 1.05
#: A bucket's quartiles differ by 0 to 3; the length codes count up to 16 steps, 4 each.
MAX_DIFF = 3 * BUCKETS + 4 * 16
#: Offsets of the triplets in a window of five bytes; each has its own multiplier.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4))
#: Rows of a range, while there are fewer than MAX_RANGES; beyond, ranges grow and are sorted on disk.
ROWS_PER_RANGE, MAX_RANGES = 4000, 20_000
LEAST_ID = -(2**63)


def _counts(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    out = np.zeros(BUCKETS, np.int64)
    for k, (x, y, z) in enumerate(TRIPLETS):
        n = len(b) - z
        if n <= 0:
            continue
        h = (b[x : x + n] * np.uint32(0x01000193) + b[y : y + n] * np.uint32(0x0001F35B) + b[z : z + n] * np.uint32(0x00009E37) + np.uint32(k * 0x2545F491)) * np.uint32(0x9E3779B1)
        out += np.bincount(h >> np.uint32(24), minlength=BUCKETS)
    return out


def fingerprint(data: bytes) -> np.ndarray:
    """The digest as bytes: the length code, then four buckets in each byte."""
    counts = _counts(data)
    ordered = np.sort(counts)
    q1, q2, q3 = ordered[BUCKETS // 4 - 1], ordered[BUCKETS // 2 - 1], ordered[3 * BUCKETS // 4 - 1]
    codes = ((counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)).astype(np.uint8).reshape(-1, 4)
    length = min(255, int(np.log(len(data) + 1) / np.log(LENGTH_STEP)))
    return np.concatenate([[np.uint8(length)], (codes << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 minus the difference of two digests as a part of MAX_DIFF."""
    two = np.array([0, 2, 4, 6], np.uint8)
    x, y = ((v[1:, None] >> two) & 3 for v in (a, b))
    quartiles = int(np.abs(x.astype(np.int16) - y).sum())
    return 1.0 - (quartiles + 4 * min(16, abs(int(a[0]) - int(b[0])))) / MAX_DIFF


def edited(text: str, following: str) -> str:
    """text with its last half, rounded down, replaced by as many code points of the following document (or all it has)."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _range_of(cuts: list[int]) -> Callable[[Column], Column]:
    """The number of cuts up to an id. Nulls are replaced before Python sees them: with them, ids would come as doubles."""

    @F.pandas_udf("int")
    def count(ids):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(np.searchsorted(np.array(cuts, np.int64), ids.to_numpy("int64"), side="right").astype("int32"))

    return lambda ids: count(F.coalesce(ids, F.lit(LEAST_ID)))


def _boundaries(docs: DataFrame) -> tuple[list[int], DataFrame]:
    """Ids that begin a range, ascending, and the one row that comes first of all. As many as there are ranges reach the driver."""
    n = docs.count()
    ranges = max(1, min(MAX_RANGES, -(-n // ROWS_PER_RANGE)))
    at = [i / ranges for i in range(1, ranges)]
    cuts = docs.agg(F.percentile_approx("doc_id", at, 100 * ranges).alias("cuts"), F.min("doc_id").alias("least")).first() if at else None
    least = cuts["least"] if cuts else docs.agg(F.min("doc_id").alias("least")).first()["least"]
    first = docs.filter(F.col("doc_id").isNull() | (F.col("doc_id") == F.lit(least))).orderBy(F.col("doc_id").asc_nulls_first(), "text").limit(1)
    near = sorted(set((cuts and cuts["cuts"]) or []))
    if not near:
        return [], first
    # quantiles are computed in doubles: beyond 2^53 they need not be ids of the table, so each range begins at the least id that it holds
    heads = docs.filter(F.col("doc_id") > LEAST_ID).groupBy(_range_of(near)(F.col("doc_id")).alias("range")).agg(F.min("doc_id").alias("head"))
    return sorted(r["head"] for r in heads.filter("range > 0").collect()), first


def with_next(docs: DataFrame, row, schema: str) -> DataFrame:
    """doc_id and what row(text, text of the next document) returns, for every document; docs: doc_id and text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts, first = _boundaries(docs)
    range_of = _range_of(cuts)
    own = docs.withColumn("range", range_of(F.col("doc_id"))).withColumn("halo", F.lit(0))
    heads = docs.filter(F.col("doc_id").isin(cuts)) if cuts else docs.limit(0)
    heads = heads.withColumn("range", range_of(F.col("doc_id")) - 1).withColumn("halo", F.lit(1))
    last = first.withColumn("range", F.lit(len(cuts))).withColumn("halo", F.lit(2))
    dealt = own.unionByName(heads).unionByName(last).repartitionById(len(cuts) + 1, "range")
    ordered = dealt.sortWithinPartitions("range", "halo", F.col("doc_id").asc_nulls_first(), "text")
    names = ["doc_id", *(part.split()[0] for part in schema.split(", "))]
    types = ordered.sparkSession.createDataFrame([], f"doc_id bigint, {schema}").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        form = to_arrow_schema(types)
        held = None  # the document whose next one has not been seen yet
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                doc_id, text, k, halo = (batch.column(j)[i].as_py() for j in range(4))
                if held is not None and held[2] != k:
                    raise ValueError(f"document {held[0]} has none after it in range {held[2]}")
                if held is not None:
                    out.append((held[0], *row(held[1], text)))
                held = (doc_id, text, k) if halo == 0 else None
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), form.field(j).type) for j, c in enumerate(columns)], names)
        if held is not None:
            raise ValueError(f"document {held[0]} has none after it in range {held[2]}")

    return ordered.select("doc_id", "text", "range", "halo").mapInArrow(run, types)


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and their likeness to each other and to the next document's."""

    seen: dict[str, np.ndarray] = {}  # of the last following text, which mostly comes next

    def row(text: str, following: str) -> tuple:
        raw = edited(text, following).encode()
        a = seen.get(text)
        a = fingerprint(text.encode()) if a is None else a
        b, c = fingerprint(raw), fingerprint(following.encode())
        seen.clear()
        seen[following] = c
        return len(text), hashlib.sha256(raw).hexdigest(), a.tobytes().hex(), b.tobytes().hex(), likeness(a, b), likeness(a, c)

    return with_next(docs, row, "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
