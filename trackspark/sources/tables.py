"""Segments and categories from files, with column roles found by name, and tables written to a folder."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEGMENTS = T.StructType([T.StructField("object_id", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("time", "x", "y", "z"))])
CATEGORIES = T.StructType([T.StructField("object_id", T.LongType()), T.StructField("category", T.StringType())])

#: Column names by role, compared without regard to case.
ROLE_NAMES = {
    "object_id": ("id", "track", "track id", "trackid", "cell", "cell id", "cellid", "object", "object id", "objectid", "parent", "parent id", "parentid"),
    "time": ("t", "time", "frame"),
    "x": ("x", "x coordinate", "x position", "coordinate x", "position x"),
    "y": ("y", "y coordinate", "y position", "coordinate y", "position y"),
    "z": ("z", "z coordinate", "z position", "coordinate z", "position z"),
    "category": ("category", "label", "type", "code"),
}
#: Names that this library adds: those of its own tables.
OWN_NAMES = {"object_id": ("object_id", "track_id", "cell_id", "parent_id"), "x": ("x_coordinate",), "y": ("y_coordinate",), "z": ("z_coordinate",)}


def roles(columns: Iterable[str], wanted: Iterable[str], chosen: Mapping[str, str] | None = None) -> dict[str, str]:
    """The column of each role: the chosen one, else the first whose name fits; roles without one are left out."""
    out = dict(chosen or {})
    for role in wanted:
        for name in columns:
            if role not in out and name.strip().lower() in ROLE_NAMES[role] + OWN_NAMES.get(role, ()):
                out[role] = name
    return out


def segments(df: DataFrame, chosen: Mapping[str, str] | None = None) -> DataFrame:
    """Typed segments of any table; NaN becomes null, values that are no numbers too, and two dimensions get z = 0."""
    found = roles(df.columns, ("object_id", "time", "x", "y", "z"), chosen)
    missing = [r for r in ("object_id", "time", "x", "y") if r not in found]
    if missing:
        raise ValueError(f"no column found for {missing} among {df.columns}")
    number = lambda c: F.nanvl(F.expr(f"try_cast(`{c}` as double)"), F.lit(None).cast("double"))
    columns = [F.col(f"`{found['object_id']}`").cast("long").alias("object_id"), *(number(found[r]).alias(r) for r in ("time", "x", "y"))]
    z = number(found["z"]) if "z" in found else F.lit(0.0)
    return df.select(*columns, z.alias("z")).where("object_id is not null and time is not null")


def categories(df: DataFrame, chosen: Mapping[str, str] | None = None) -> DataFrame:
    """One category per object: rows without id go, an id that is no whole number fails, of several categories the least stays."""
    found = roles(df.columns, ("object_id", "category"), chosen)
    rows = df.select(F.col(f"`{found['object_id']}`").cast("long").alias("object_id"), F.col(f"`{found['category']}`").cast("string").alias("category"))
    return rows.where("object_id is not null").groupBy("object_id").agg(F.min("category").alias("category"))


def read(spark: SparkSession, path: str, form: str = "csv") -> DataFrame:
    """A table; CSV columns are read as text, so no pass is spent on inferring types."""
    reader = spark.read.option("header", True) if form == "csv" else spark.read
    return reader.format(form).load(path)


def replicate_of(path: F.Column) -> F.Column:
    """The replicate's number in a file name like ``name-r2_Results``, else the name's stem."""
    name = F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
    number = F.regexp_extract(name, r"(?i)-r(\d+)(?:_|$)", 1)
    return F.when(number != "", F.concat(F.lit("r"), number)).otherwise(name)


def read_replicates(spark: SparkSession, pattern: str) -> DataFrame:
    """Summary tables of several runs (parquet) with their replicate, told by the name of the run's folder or file.

    A file that can't be read is left out, as a run that broke off may leave one; columns that only some have are null elsewhere.
    """
    reader = spark.read.option("mergeSchema", True).option("ignoreCorruptFiles", True).option("recursiveFileLookup", True)
    path = F.regexp_replace(F.col("_metadata.file_path"), r"/(features|summary_features)/[^/]*$", "")
    return reader.parquet(pattern).withColumn("replicate", replicate_of(path))


def replicate_folder(folder: str, name: str, replicate: int) -> str:
    """Where the results of one of several runs go, so that ``read_replicates`` tells it."""
    return f"{folder}/{name}-r{replicate}_results"


def write(tables: Mapping[str, DataFrame], folder: str, form: str = "parquet") -> None:
    """Each table to a folder of its own name."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        (writer.option("header", True) if form == "csv" else writer).format(form).save(f"{folder}/{name}")
