"""Scans and sinks of record collections. Sinks always write to a new place; nothing is changed where it lies."""

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanac.operators.gates import SLOTS, is_complete
from almanac.operators.index import lookup_join
from almanac.schema import CORRUPT, RECORD_SCHEMA

RECORD_FILES = "*_standardised.json"
NAME_PART = "_standardised.json"
#: Bytes of file contents that leave a reading task at once.
PORTION = 4 << 20


def scan_records(
    spark: SparkSession, path: str, files: str = RECORD_FILES, multi_line: bool = True, schema=RECORD_SCHEMA
) -> DataFrame:
    """Records of all matching files below ``path`` with the fixed schema and ``path`` = ``day/file``.

    ``multi_line`` reads one record per file; without it every line is a record, the layout for large collections.
    A malformed record becomes a row with ``_corrupt_record`` set.

    With one record per file there are as many files as records, so tasks list and read them, and the driver holds none of
    their names. Numbers stay as they are written; an object inside a field keeps its values, not its white space. A store that
    pyarrow cannot open, a pattern with alternatives or a schema of other things than texts is left to Spark's reader, whose list
    of files lies in the driver.
    """
    if multi_line and "{" not in files and _only_texts(schema) and _opens(path):
        texts = record_texts(spark, path, files).filter(r"content rlike '\\S'").withColumn("_as_text", bare_numbers_quoted("content"))
        found = parse_archive(texts, "_as_text", schema)
        if CORRUPT in schema.fieldNames():
            found = found.withColumn(CORRUPT, F.when(F.col(CORRUPT).isNotNull(), F.col("content")))
        return found.select(*schema.fieldNames(), "path")
    read = (
        spark.read.schema(schema).option("multiLine", multi_line).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT).option("recursiveFileLookup", True).option("pathGlobFilter", files)
        .json(path))
    return read.withColumn("path", day_and_file(F.col("_metadata.file_path")))


def _only_texts(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_only_texts(f.dataType) for f in kind)
    return _only_texts(kind.elementType) if isinstance(kind, T.ArrayType) else isinstance(kind, T.StringType)


def bare_numbers_quoted(content: str) -> Column:
    """JSON text with its numbers as texts, so that parsing cannot change how they are written; anything else, keys that are bare numbers
    included, stays as it is."""
    number = r"[-+]?(?:NaN|INF|Infinity)|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?"
    # A whole string is passed over first, so nothing inside one is taken for a number.
    pattern = rf'("(?:[^"\\]|\\.)*+")|(?<![\w.+-])({number})(?=\s*[,\]}}])'
    parts = F.regexp_replace(content, F.lit(f"(?s){pattern}"), F.lit("$1\u0001$2\u0001"))
    return F.regexp_replace(F.replace(parts, F.lit("\u0001\u0001"), F.lit("")), F.lit("\u0001([^\u0001]*)\u0001"), F.lit('"$1"'))


def _uri(path: str) -> str:
    local = re.sub("^file:/+", "/", path)
    return local if "://" in local or local.startswith("/") else f"file:{local}"


def _opens(path: str) -> bool:
    from pyarrow import fs

    try:
        return fs.FileSystem.from_uri(_uri(path)) is not None
    except (pa.ArrowException, OSError):
        return False


def record_texts(spark: SparkSession, path: str, files: str = RECORD_FILES) -> DataFrame:
    """(path, content) of all matching files below ``path``, listed by folder and read in tasks. Names that begin with ``_`` or ``.``
    are passed over, as Spark does."""
    uri, portion = _uri(path), PORTION

    def listing(deep: bool):
        def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from fnmatch import fnmatchcase

            from pyarrow import fs

            system, base = fs.FileSystem.from_uri(uri)
            for batch in batches:
                for folder in batch.column(0).to_pylist():
                    found = system.get_file_info(fs.FileSelector(folder or base, recursive=deep))
                    for at in range(0, len(found), 10_000):
                        kept = [(f.path, f.type == fs.FileType.Directory) for f in found[at:at + 10_000] if not any(
                            part.startswith(".") or part.startswith("_") and "=" not in part for part in f.path[len(base):].split("/"))]
                        kept = [(name, is_folder) for name, is_folder in kept if not deep and is_folder or (
                            not is_folder and fnmatchcase(name.rpartition("/")[2], files))]
                        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in kept], pa.string()), pa.array([d for _, d in kept], pa.bool_())], names=["name", "folder"])
        return entries

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def portion_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["path", "content"])

        system, _ = fs.FileSystem.from_uri(uri)
        for batch in batches:
            rows, held = [], 0
            for name in batch.column(0).to_pylist():
                with system.open_input_stream(name) as lines:
                    data = lines.read()
                rows.append(("/".join(name.split("/")[-2:]), data.decode("utf-8-sig", "replace")))
                held += len(data)
                if held > portion:
                    yield portion_of(rows)
                    rows, held = [], 0
            yield portion_of(rows)

    # Names are few bytes, but each is a file to open: a fixed number of partitions, which Spark does not put together.
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    columns = "name string, folder boolean"
    top = spark.createDataFrame([("",)], "folder string").mapInArrow(listing(False), columns)
    folders = top.filter("folder").select("name").repartition(parts, "name")
    names = top.filter("not folder").unionByName(folders.mapInArrow(listing(True), columns)).select("name")
    return names.repartition(parts, "name").mapInArrow(contents, "path string, content string")


def day_and_file(file_path: Column) -> Column:
    return F.regexp_extract(file_path, r"([^/]+/[^/]+)$", 1)


def parse_archive(archive: DataFrame, content: str, schema=RECORD_SCHEMA) -> DataFrame:
    """The same scan over a table of (path, content) rows: billions of small files are better kept as rows."""
    parsed = F.from_json(content, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return archive.withColumn("_r", parsed).select(*[c for c in archive.columns if c != content], "_r.*")


def named_records(df: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose file name marks a standardised record."""
    return df.filter(F.element_at(F.split(path, "/"), -1).contains(NAME_PART))


def readable(df: DataFrame) -> DataFrame:
    """Malformed records dropped. A text that parses to nothing at all is malformed as well."""
    return df.filter(F.col(CORRUPT).isNull())


def day_counts(df: DataFrame, path: str = "path", slots: int = SLOTS) -> DataFrame:
    """(day, found, with_data) per day folder."""
    return df.groupBy(F.substring_index(path, "/", 1).alias("day")).agg(
        F.count(F.lit(1)).alias("found"), F.count_if(is_complete(df, slots=slots)).alias("with_data"))


def scan_split(records: DataFrame, manifest: DataFrame, splits: str | Sequence[str], path: str = "path") -> DataFrame:
    """Records a manifest lists for one split or several; a subset manifest is one with fewer rows."""
    wanted = [splits] if isinstance(splits, str) else list(splits)
    listed = manifest.filter(F.col("split").isin(wanted)).select(path)
    return lookup_join(records, listed, path, "left_semi", unique_left=True)


def with_text(records: DataFrame, key: str) -> DataFrame:
    return records.filter(F.col(key).isNotNull())


def write_records(df: DataFrame, path: str, *partitions: str) -> None:
    """One JSON object per line, umlauts as they are, NULL keys left out."""
    df.write.partitionBy(*partitions).option("ignoreNullFields", True).json(path) if partitions else df.write.json(path)


def write_splits(df: DataFrame, path: str, split: str = "split", record_path: str = "path") -> DataFrame:
    """Copy the records of each split below ``path/data`` and write the manifest; returns the manifest."""
    df.write.partitionBy(split).parquet(f"{path}/data")
    # From the copy just written: two columns of it are read, the records are not computed a second time.
    copied = df.sparkSession.read.schema(df.schema).parquet(f"{path}/data")
    copied.select(split, F.concat(F.lit("data/"), record_path).alias(record_path)).write.parquet(f"{path}/manifest")
    return df.sparkSession.read.parquet(f"{path}/manifest")
