"""CSV tables, JSON lines and embedded CSV texts."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.operators.index import hash_index
from almanac.operators.profile import offset_bucket
from almanac.schema import CITY_SCHEMA, RESPONSE_SCHEMA

LINES_PER_FILE = 5000
CSV = {"header": "true", "emptyValue": "", "escape": '"'}


def read_csv(spark: SparkSession, path: str, schema=CITY_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).options(**CSV).option("multiLine", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.options(**CSV).csv(path)


def read_json_lines(spark: SparkSession, path: str, schema=RESPONSE_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """One compact JSON object per row."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.text(path)


def numbered_splits(df: DataFrame, key: list[str], lines: int = LINES_PER_FILE, seed: int = 42) -> DataFrame:
    """Add ``split_k``: number of the file a row belongs to when every file holds exactly ``lines`` rows, the last the rest."""
    placed = hash_index(df, key, seed, "_idx")
    return placed.withColumn("split_k", F.floor(F.col("_idx") / lines)).drop("_idx")


def write_numbered_splits(df: DataFrame, path: str, key: list[str], value: str, lines: int = LINES_PER_FILE) -> None:
    """Text files of at most ``lines`` lines below ``split_k=0``, ``split_k=1``, ...; the rows of a file meet in one task."""
    numbered = numbered_splits(df, key, lines).select("split_k", F.col(value).alias("value"))
    numbered.repartition("split_k").write.partitionBy("split_k").text(path)


def write_by_offset(df: DataFrame, path: str, offset: str) -> None:
    """One folder per UTC offset (``bucket=UTC_plus_5_5``); rows without an offset are left out.

    Tasks write their own share of every offset, so an offset with a third of all cities needs no single writer.
    """
    kept = df.filter(F.col(offset).isNotNull()).withColumn("bucket", offset_bucket(F.col(offset))).drop(offset)
    kept.write.partitionBy("bucket").options(**CSV).csv(path)


def to_csv_text(columns: dict[str, Column]) -> Column:
    """Parallel arrays as one CSV text: a header line, then one line per position."""
    names = list(columns)
    zipped = F.arrays_zip(*[c.alias(f"c{i}") for i, c in enumerate(columns.values())])
    lines = F.transform(zipped, lambda s: F.to_csv(
        F.struct(*[s[f"c{i}"].alias(f"c{i}") for i in range(len(names))]), {"emptyValue": "", "escape": '"'}))
    return F.concat(F.lit(",".join(names) + "\n"), F.array_join(lines, "\n"), F.lit("\n"))


def from_csv_text(value: str | Column, names: list[str]) -> Column:
    """Array of structs of texts from an embedded CSV text with a header line."""
    value = F.col(value) if isinstance(value, str) else value
    lines = F.filter(F.split(value, "\n", -1), lambda x: x != "")
    schema = ", ".join(f"`{n}` string" for n in names)
    return F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.from_csv(x, schema, {"escape": '"'}))


def merge_city_files(df: DataFrame, file: str, keep_country: str) -> DataFrame:
    """Union of per-file tables: duplicates removed within a file, ``Country`` from the file name (``_`` is a space)
    except for the one file that already has it."""
    once = df.dropDuplicates()
    stem = F.regexp_replace(file, r"\.csv$", "")
    country = F.when(F.col(file) == keep_country, F.col("Country")).otherwise(F.replace(stem, F.lit("_"), F.lit(" ")))
    return once.withColumn("Country", country)


def read_city_files(spark: SparkSession, path: str, schema) -> DataFrame:
    """CSV files of a folder with the name of the file each row came from."""
    return spark.read.schema(schema).options(**CSV).csv(path).withColumn("file", F.col("_metadata.file_name"))
