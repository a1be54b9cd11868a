"""Custom variables: nested JSON values as flat rows, and joined to their objects."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.scalars import sha1_id
from .snapshot import snapshot_diff

#: Bytes of rows that are sent on at a time.
BATCH_BYTES = 4 << 20


def _no_constant(text: str) -> str:
    raise ValueError(f"not JSON: {text}")


#: Numbers as they are written.
_DECODER = json.JSONDecoder(parse_int=str, parse_float=str, parse_constant=_no_constant)
#: Halves of characters that JSON escapes alone.
_SURROGATES = re.compile("[\ud800-\udfff]")


def leaves(name: str, text: str, depth: int | None = None) -> Iterator[tuple[str, str | None]]:
    """(flatname, flatvalue) of each leaf of one JSON value."""
    open_ = [(name, _DECODER.decode(text), 0)]
    while open_:
        path, value, level = open_.pop()
        if isinstance(value, dict | list) and value:
            if depth is not None and level >= depth:
                raise ValueError(f"nested too deeply: {path}")
            children = value.items() if isinstance(value, dict) else enumerate(value)
            open_ += [(f"{path}.{k}" if isinstance(value, dict) else f"{path}[{k}]", v, level + 1) for k, v in children]
        elif isinstance(value, str):
            yield _SURROGATES.sub("\ufffd", path), _SURROGATES.sub("\ufffd", value)
        else:
            yield _SURROGATES.sub("\ufffd", path), None if value in ({}, []) else {None: "null", True: "true", False: "false"}[value]


def flatten_json(df: DataFrame, name: str = "name", value: str = "value", depth: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """df (or the columns to keep) with flatname and flatvalue, a row for each leaf of a JSON value; one pass over the rows.

    Children of objects are named a.b, of arrays a[0]. An empty container is a row without a value, JSON null the text null,
    other leaves their text; numbers stay as they are written. Of equal keys the last counts. Bad JSON is an error, as are
    containers below `depth` levels, if it is given; a value that is null has no rows. Columns named flatname or flatvalue are replaced.
    """
    kept = [f for f in df.schema.fields if f.name not in ("flatname", "flatvalue") and (keep is None or f.name in keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, names, values, size = [], [], [], 0
            others = batch.select(list(range(len(kept))))
            paths, texts = batch.column(len(kept)), batch.column(len(kept) + 1)
            for i in range(batch.num_rows):
                if texts[i].is_valid and paths[i].is_valid:
                    own = others.slice(i, 1).nbytes
                    for flatname, flatvalue in leaves(paths[i].as_py(), texts[i].as_py(), depth):
                        at.append(i)
                        names.append(flatname)
                        values.append(flatvalue)
                        size += own + len(flatname) + len(flatvalue or "")
                        if size >= BATCH_BYTES:
                            yield made(others, at, names, values)
                            at, names, values, size = [], [], [], 0
            if at:
                yield made(others, at, names, values)

    def made(others: pa.RecordBatch, at: list[int], names: list[str], values: list[str | None]) -> pa.RecordBatch:
        part = others.take(pa.array(at))
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(values, pa.string())], [*part.schema.names, "flatname", "flatvalue"])

    # functions over Arrow batches do not take names with dots
    own = df.select(*[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(kept)], F.col(f"`{name}`").alias("path"), F.col(f"`{value}`").alias("json"))
    schema = StructType([*own.schema.fields[: len(kept)], StructField("flatname", StringType()), StructField("flatvalue", StringType())])
    return own.mapInArrow(run, schema).toDF(*[f.name for f in kept], "flatname", "flatvalue")


def flatten_customvars(customvars: DataFrame, depth: int | None = None) -> DataFrame:
    """customvar → customvar_flat rows; the id is made of environment, variable, path and value."""
    own = customvars.select("environment_id", F.col("id").alias("customvar_id"), "name", F.col("value").alias("json"))
    flat = flatten_json(own, "name", "json", depth, ["environment_id", "customvar_id"])
    return flat.select(
        sha1_id("environment_id", "customvar_id", "flatname", "flatvalue").alias("id"), "environment_id", "customvar_id", F.sha1("flatname").alias("flatname_checksum"), "flatname", "flatvalue"
    )


def customvar_diff(desired: DataFrame, actual: DataFrame, actual_flat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Differences of variables and of their flat rows, from the desired variables."""
    return snapshot_diff(desired, actual), snapshot_diff(flatten_customvars(desired), actual_flat)


def object_customvars(links: DataFrame, customvars: DataFrame, key: str) -> DataFrame:
    """(key, vars): a map of name to JSON value for each object. links: key and customvar_id."""
    joined = links.join(customvars.select(F.col("id").alias("customvar_id"), "name", "value"), "customvar_id")
    entries = F.array_sort(F.collect_set(F.struct("name", "value")))
    return joined.groupBy(key).agg(F.map_from_entries(entries).alias("vars"))


def object_flat_customvars(links: DataFrame, customvars: DataFrame, flat: DataFrame, key: str) -> DataFrame:
    """(key, name, flatname, flatvalue)."""
    named = links.join(customvars.select(F.col("id").alias("customvar_id"), "name"), "customvar_id")
    return named.join(flat.select("customvar_id", "flatname", "flatvalue"), "customvar_id").select(key, "name", "flatname", "flatvalue")
