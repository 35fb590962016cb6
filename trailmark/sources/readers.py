"""Scans: metadata, benchmark files, trajectories, sample tables, image listings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.sources import schemas as S


def read_image_metadata(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return spark.read.schema(S.IMAGE_METADATA).option("header", True).csv(path)


def read_ground_truth(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return spark.read.schema(S.GROUND_TRUTH).option("header", True).csv(path)


# Places of the id, longitude and latitude in the benchmark file without a header.
POSITIONS = {"id": 1, "longitude": 12, "latitude": 13}


def read_positional_tsv(spark: SparkSession, path: str, columns: dict[str, int] = POSITIONS, text: Sequence[str] = ("id",)) -> DataFrame:
    """Columns of a headerless tab-separated file by place; those not in ``text`` are numbers."""
    width = max(columns.values()) + 1
    raw = spark.read.schema(", ".join(f"_c{i} string" for i in range(width))).option("sep", "\t").csv(path)
    return raw.select(
        *[(F.col(f"_c{i}") if name in text else F.col(f"_c{i}").try_cast("double")).alias(name) for name, i in columns.items()]
    )


def read_trajectories(spark: SparkSession, path: str | Sequence[str], mode: str = "drop", schema: str = S.TRAJECTORY) -> DataFrame:
    """Line-delimited JSON. ``drop`` skips blank and malformed lines, ``fail`` stops at one."""
    parse = {"drop": "DROPMALFORMED", "fail": "FAILFAST"}[mode]
    return spark.read.schema(schema).json(path, mode=parse)


def read_samples(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Parquet and JSON files as one table; columns that a file lacks are null."""
    by_kind: dict[str, list[str]] = {}
    for path in paths:
        suffix = path.rsplit(".", 1)[-1]
        kind = {"parquet": "parquet", "json": "json", "jsonl": "json"}.get(suffix)
        if kind is None:
            raise ValueError(f"unsupported file format: {path}")
        by_kind.setdefault(kind, []).append(path)
    parts = []
    for kind, files in by_kind.items():
        reader = spark.read.option("mergeSchema", True) if kind == "parquet" else spark.read
        parts.append(reader.format(kind).load(files))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def with_part_label(df: DataFrame, pattern: str = r"part[=_-]?([A-Za-z0-9]+)", name: str = "part") -> DataFrame:
    """Part label taken from the path of the file a row came from."""
    return df.withColumn(name, F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))


COLUMN_NAMES = {"IMG_ID": "id", "LAT": "latitude", "LON": "longitude"}


def normalize_columns(df: DataFrame, names: dict[str, str] = COLUMN_NAMES) -> DataFrame:
    """Renames where the source column exists and the target does not."""
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns and b not in df.columns})


def list_images(spark: SparkSession, path: str, pattern: str = "*", content: bool = False) -> DataFrame:
    """Paths and sizes of files; without ``content`` the bytes are never read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", *(["content"] if content else []))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)
