"""Retention: old rows go, and what refers to them."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.schemas import RETENTION


def plan(now: datetime, history_days: int, sla_days: int, options: dict[str, int] | None = None) -> dict[str, int]:
    """Category → cutoff in ms, for categories that are kept for a limited time only. options override history categories."""
    options = options or {}
    if unknown := [c for c in options if c not in RETENTION or c.startswith("sla_")]:
        raise ValueError(f"no history category: {', '.join(unknown)}")
    days = {c: sla_days if c.startswith("sla_") else options.get(c, history_days) for c in RETENTION}
    now = now if now.tzinfo else now.replace(tzinfo=UTC)
    return {c: int((now - timedelta(days=d)).timestamp() * 1000) for c, d in days.items() if d >= 1}


def expired(environment: str, time: str, cutoff: int) -> Column:
    """Never true for a row without a time."""
    return F.coalesce((F.col("environment_id") == environment) & (F.col(time) < cutoff), F.lit(False))


def apply_retention(tables: dict[str, DataFrame], environment: str, now: datetime, history_days: int, sla_days: int, options: dict[str, int] | None = None) -> dict[str, DataFrame]:
    """tables (by name) without the rows of an environment that are too old; history and users follow the deleted rows."""
    out = dict(tables)
    for category, cutoff in plan(now, history_days, sla_days, options).items():
        c = RETENTION[category]
        if c.table in out:
            out[c.table] = tables[c.table].filter(~expired(environment, c.time, cutoff))
            if c.history_column and "history" in out:
                gone = tables[c.table].filter(expired(environment, c.time, cutoff))
                out["history"] = cascade(out["history"], gone, c.history_column, c.key)
            if category == "notification" and "user_notification_history" in out:
                gone = tables[c.table].filter(expired(environment, c.time, cutoff))
                out["user_notification_history"] = cascade(out["user_notification_history"], gone, "notification_history_id", c.key)
    return out


DAY_MS = 86_400_000


def save_by_day(rows: DataFrame, table: str, time: str, **options: str) -> None:
    """rows as a catalog table, partitioned by environment and by day of a time (rows without one: the null partition)."""
    dealt = rows.withColumn("day", F.expr(f"({time} - pmod({time}, {DAY_MS}L)) div {DAY_MS}L").cast("int"))
    dealt.repartition("environment_id", "day").write.partitionBy("environment_id", "day").options(**options).saveAsTable(table)


def _put_boundary(spark: SparkSession, table: str) -> None:
    day = spark.table(f"{table}__boundary")
    key = "spark.sql.sources.partitionOverwriteMode"  # insertInto takes it from the session alone
    before = spark.conf.get(key)
    spark.conf.set(key, "dynamic")
    try:
        day.select(*spark.table(table).columns).write.mode("overwrite").insertInto(table)
    finally:
        spark.conf.set(key, before)
    spark.sql(f"DROP TABLE {table}__boundary")


def drop_old_days(spark: SparkSession, table: str, time: str, environment: str, cutoff: int) -> DataFrame:
    """Take an environment's rows before a cutoff out of a table of `save_by_day`, and return what is left.

    Days before the cutoff's are dropped as partitions, by the catalog alone; of the rest only the cutoff's own day can hold rows
    that are too old, so it is the only one that is read, and written anew
    (beside the table first, so that a run that broke off can be done again). Done twice, it leaves the same table.
    """
    if spark.catalog.tableExists(f"{table}__boundary"):  # an earlier run broke off while it put a day in place
        _put_boundary(spark, table)
    boundary = cutoff // DAY_MS
    days = [dict(p.split("=", 1) for p in unquote(r[0]).split("/day=")[0:1]) | {"day": r[0].rpartition("=")[2]} for r in spark.sql(f"SHOW PARTITIONS {table}").collect()]
    own = {int(d["day"]) for d in days if d["environment_id"] == environment and d["day"].lstrip("-").isdigit()}
    old = {d for d in own if d < boundary}
    if boundary in own and cutoff % DAY_MS:
        kept = spark.table(table).filter((F.col("environment_id") == environment) & (F.col("day") == boundary) & (F.col(time) >= cutoff))
        if kept.isEmpty():
            old.add(boundary)
        else:
            at = next(r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect() if r["col_name"] == "Location")
            kept.coalesce(1).write.mode("overwrite").option("path", f"{at}__boundary").saveAsTable(f"{table}__boundary")
            _put_boundary(spark, table)
    if old:
        name = environment.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS " + ", ".join(f"PARTITION (environment_id = '{name}', day = {d})" for d in sorted(old)))
    return spark.table(table)


def cascade(children: DataFrame, gone: DataFrame, reference: str, key: str) -> DataFrame:
    """children without those that refer to a row that is gone; null references stay."""
    return children.join(gone.select(F.col(key).alias(reference)).distinct(), reference, "left_anti").select(*children.columns)


def orphans(children: DataFrame, parents: DataFrame, reference: str, key: str) -> DataFrame:
    """children whose reference is set and leads nowhere."""
    return children.filter(F.col(reference).isNotNull()).join(parents.select(F.col(key).alias(reference)), reference, "left_anti").select(*children.columns)


def retention_audit(table: DataFrame, time: str, cutoff: int, category: str) -> DataFrame:
    """Rows of each environment before a cutoff, from it on, and without a time."""
    return table.groupBy("environment_id").agg(
        F.lit(category).alias("category"), F.count_if(F.col(time) < cutoff).alias("n_old"), F.count_if(F.col(time) >= cutoff).alias("n_kept"), F.count_if(F.col(time).isNull()).alias("n_open")
    )
