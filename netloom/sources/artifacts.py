"""Artifact folders: one sub-folder per table, as NDJSON or CSV, and a manifest of their schemas."""

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "manifest"
NESTED = (T.ArrayType, T.MapType, T.StructType)
# Quotes are doubled and blanks kept, a null is \\N, and a text that begins with a backslash gets another; so any text comes back as it was.
CSV = {"header": "true", "escape": '"', "nullValue": "\\N", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}

# Texts of packets and flows repeat much. A gzip file is read by one task, so files are bounded by rows. At gzip's own level most
# of the time of a written file goes into packing it; the fastest level takes a quarter of that for files a third (CSV) to a half (NDJSON) larger.
FILES = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": "250000"}


def _is_nested(field: T.StructField) -> bool:
    return isinstance(field.dataType, NESTED)


def _parted(frame: DataFrame) -> list[str]:
    return [c for c in frame.columns if c == "capture_id"]


def _in_json(kind: T.DataType) -> T.DataType:
    """The type as JSON has it: keys of a map are texts."""
    return T.MapType(T.StringType(), kind.valueType) if isinstance(kind, T.MapType) else kind


def _typed(field: T.StructField, value: Column) -> Column:
    """A value as read from JSON, with the keys of a map in their own type."""
    if _in_json(field.dataType) != field.dataType:
        value = F.transform_keys(value, lambda key, _: key.cast(field.dataType.keyType))
    return value.alias(field.name)


def _flat(field: T.StructField) -> Column:
    """A value as CSV has it."""
    if _is_nested(field):
        return F.to_json(field.name, {"ignoreNullFields": "false"}).alias(field.name)
    value = F.col(field.name)
    if isinstance(field.dataType, T.StringType) and field.name != "capture_id":
        value = F.when(value.startswith("\\"), F.concat(F.lit("\\"), value)).otherwise(value).alias(field.name)
    return value


def _unflat(field: T.StructField) -> Column:
    if _is_nested(field):
        return _typed(field, F.from_json(field.name, _in_json(field.dataType)))
    value = F.col(field.name)
    if isinstance(field.dataType, T.StringType) and field.name != "capture_id":
        value = F.when(value.startswith("\\"), F.substr(value, F.lit(2))).otherwise(value).alias(field.name)
    return value


def write_artifacts(tables: dict[str, DataFrame], folder: str, fmt: str = "ndjson", mode: str = "errorifexists") -> None:
    """Every table below `folder`, and a manifest of what was written.

    Every task writes its own parts, gzip files of bounded length, per capture where a table has captures. CSV has nested columns
    as JSON text. The manifest is written last, so a folder with a manifest is whole.
    """
    for name, frame in tables.items():
        if fmt == "csv":
            frame = frame.select(*[_flat(f) for f in frame.schema])
            frame.write.mode(mode).partitionBy(*_parted(frame)).options(**CSV, **FILES).csv(f"{folder}/{name}.csv")
        else:
            frame.write.mode(mode).partitionBy(*_parted(frame)).options(ignoreNullFields="false", **FILES).json(f"{folder}/{name}.{fmt}")
    if tables:
        spark = next(iter(tables.values())).sparkSession
        listed = [(name, fmt, json.dumps(frame.schema.jsonValue())) for name, frame in tables.items()]
        spark.createDataFrame(listed, "name string, format string, schema string").coalesce(1).write.mode(mode).json(f"{folder}/{MANIFEST}.json")


def write_ndjson(tables: dict[str, DataFrame], folder: str, mode: str = "errorifexists") -> None:
    write_artifacts(tables, folder, "ndjson", mode)


def write_csv(tables: dict[str, DataFrame], folder: str, mode: str = "errorifexists") -> None:
    write_artifacts(tables, folder, "csv", mode)


def read_artifact(spark: SparkSession, folder: str, name: str, schema: T.StructType, fmt: str = "ndjson") -> DataFrame:
    """A table of an artifact folder with all its columns and types; a table that is not there is empty."""
    try:
        if fmt != "csv":
            plain = T.StructType([T.StructField(f.name, _in_json(f.dataType)) for f in schema])
            return spark.read.schema(plain).json(f"{folder}/{name}.{fmt}").select(*[_typed(f, F.col(f.name)) for f in schema])
        # captures are folders, so their column is not in the files
        plain = T.StructType([T.StructField(f.name, T.StringType() if _is_nested(f) else f.dataType) for f in schema])
        rows = spark.read.schema(plain).options(**CSV, multiLine="true", enforceSchema="true").csv(f"{folder}/{name}.csv")
        return rows.select(*[_unflat(f) for f in schema])
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_manifest(spark: SparkSession, folder: str) -> dict[str, tuple[str, T.StructType]]:
    """Format and schema of each table of the folder: one small row for each."""
    rows = spark.read.schema("name string, format string, schema string").json(f"{folder}/{MANIFEST}.json").collect()
    return {r["name"]: (r["format"], T.StructType.fromJson(json.loads(r["schema"]))) for r in rows}


def read_artifacts(spark: SparkSession, folder: str, schemas: dict | None = None, fmt: str = "ndjson") -> dict[str, DataFrame]:
    """The tables of `schemas`, or all that the manifest of the folder lists."""
    if schemas is None:
        return {name: read_artifact(spark, folder, name, schema, kind) for name, (kind, schema) in read_manifest(spark, folder).items()}
    return {name: read_artifact(spark, folder, name, schema, fmt) for name, schema in schemas.items()}
