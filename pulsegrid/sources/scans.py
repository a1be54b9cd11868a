"""Reading: object snapshots, scoped tables, history and change streams, legacy tables."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalars import first_real_date, strict_unhex


def read_snapshot(pairs: DataFrame, fields: StructType | str) -> DataFrame:
    """(field: hex id, value: JSON) → id (lower-case hex) and the typed fields. A bad id or bad JSON is an error."""
    schema = fields if isinstance(fields, StructType) else StructType.fromDDL(fields)
    parsed = pairs.select(F.lower(F.hex(strict_unhex("field"))).alias("id"), F.from_json("value", schema, {"mode": "FAILFAST"}).alias("v"))
    return parsed.select("id", *[F.col(f"v.{n}") for n in schema.names if n != "id"])


def fetch_by_ids(entities: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The entities whose key is among ids: the wide half of a two-step read."""
    return entities.join(ids.select(key).distinct(), key, "left_semi")


def attach_checksums(entities: DataFrame, checksums: DataFrame, key: str = "id") -> DataFrame:
    """entities with properties_checksum; one that is missing is an error."""
    own = entities.drop("properties_checksum").join(checksums.select(key, "properties_checksum"), key, "left")
    missing = F.raise_error(F.concat(F.lit("no checksum for "), F.col(key).cast("string"))).cast("string")
    return own.withColumn("properties_checksum", F.when(F.col("properties_checksum").isNull(), missing).otherwise(F.col("properties_checksum")))


def scan_scoped(table: DataFrame, environment: str, columns: list[str]) -> DataFrame:
    """Some columns of one environment's rows; both reach the scan."""
    return table.filter(F.col("environment_id") == environment).select(*columns)


def read_history_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 64, form: str = "parquet") -> DataFrame:
    """A history kind's events as a stream, from the beginning, so many files at a time."""
    return spark.readStream.format(form).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def known_changes(changes: DataFrame, keys: list[str]) -> DataFrame:
    """changes with a check that fails on any unknown redis_key."""
    wrong = F.raise_error(F.concat(F.lit("unknown key: "), F.coalesce("redis_key", F.lit("null")))).cast("string")
    return changes.withColumn("redis_key", F.when(F.col("redis_key").isin(*keys), F.col("redis_key")).otherwise(wrong))


def route_changes(changes: DataFrame, keys: dict[str, str]) -> dict[str, DataFrame]:
    """Changes by table; keys: redis_key → table. Each part carries a check that fails on any unknown key of the batch."""
    checked = known_changes(changes, list(keys))
    return {table: checked.filter(F.col("redis_key") == key) for key, table in keys.items()}


def key_predicates(keys: DataFrame, key: str, quoted: str, partitions: int) -> list[str]:
    """SQL conditions that deal the rows of keys into parts of about equal size, whatever gaps the ids have."""
    at = keys.agg(F.percentile_approx(key, [i / partitions for i in range(1, partitions)], 100 * partitions)).first()[0] if partitions > 1 else []
    cuts = sorted(set(at or []))
    bounds = [None, *cuts, None]
    parts = [" AND ".join([*([f"{quoted} > {a}"] if a is not None else []), *([f"{quoted} <= {b}"] if b is not None else [])]) for a, b in zip(bounds, bounds[1:], strict=False)]
    return [p or "1 = 1" for p in parts]


def read_legacy(spark: SparkSession, table: str, key: str, from_id: int, to_id: int, last_id: int | None = None, partitions: int = 64, **jdbc: str) -> DataFrame:
    """A legacy table's rows from_id..to_id beyond last_id: by JDBC if a url is given, else from Parquet.

    By JDBC each task reads one range of the key. Their bounds are quantiles of the ids that are there, which a scan of the key
    alone tells, so a table with gaps is not read by a few tasks. The range from_id..to_id is part of every condition.
    """
    low = from_id if last_id is None else max(from_id, last_id + 1)
    if "url" in jdbc:
        quoted = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(jdbc["url"]).quoteIdentifier(key)
        asked = f"{quoted} BETWEEN {low} AND {to_id}"
        properties = {"fetchsize": "20000"} | {k: str(v) for k, v in jdbc.items() if k != "url"}
        keys = spark.read.jdbc(jdbc["url"], f"(SELECT {quoted} FROM {table} WHERE {asked}) own_keys", properties=properties)
        conditions = [f"({c}) AND {asked}" for c in key_predicates(keys, keys.columns[0], quoted, partitions)]
        return spark.read.jdbc(jdbc["url"], table, predicates=conditions, properties=properties)
    return spark.read.parquet(table).filter(F.col(key).between(low, to_id))


def keyset_page(table: DataFrame, key: str, after: int | None = None, size: int = 20_000, descending: bool = False) -> DataFrame:
    """The next page by key after a checkpoint, for consumers that must resume row by row."""
    if after is not None:
        table = table.filter(F.col(key) < after if descending else F.col(key) > after)
    return table.orderBy(F.col(key).desc() if descending else F.col(key).asc()).limit(size)


def id_range(table: DataFrame, key: str, start: list[Column | str], end: list[Column | str], from_ts: Column, to_ts: Column) -> DataFrame:
    """One row (from_id, to_id): the first id that ends at from_ts or later, the last that starts at to_ts or earlier."""
    first = F.min(F.when(first_real_date(*end) >= from_ts, F.col(key)))
    last = F.max(F.when(first_real_date(*start) <= to_ts, F.col(key)))
    return table.agg(F.coalesce(first, F.lit(2**63 - 1)).alias("from_id"), F.coalesce(last, F.lit(0)).alias("to_id"))


def tasks_for(spark: SparkSession, rows: int, each: int) -> int:
    """Partitions for so many rows, about `each` in one: the memory of a task stays as it is when tables grow."""
    return max(spark.sparkContext.defaultParallelism, ceil(rows / each))
