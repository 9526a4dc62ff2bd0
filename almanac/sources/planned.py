"""Record files whose number is planned from counts per day before anything is written."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almanac.storage import written

RECORDS_PER_FILE = 100_000
#: Records that one task writes, in as many files as they are planned for.
TASK_RECORDS = 10_000


def plan_files(records: DataFrame, day: str, per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """(day, records, files, before): how many files a day gets and how many records the days before it have. Written.

    A day has as many files as keep them within ``per_file`` records. One row per calendar day, so the running sum over
    them is small at any size of the collection.
    """
    days = records.groupBy(F.col(day).alias("day")).agg(F.count(F.lit(1)).alias("records")).withColumn(
        "files", F.ceil(F.col("records") / per_file).cast("int"))
    ahead = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    placed = days.select("*", F.coalesce(F.sum("records").over(ahead), F.lit(0)).alias("before"))
    return written(placed, "file-plan")


def write_planned(records: DataFrame, path: str, day: str, per_file: int = RECORDS_PER_FILE, format: str = "json") -> DataFrame:
    """Write the records below ``path/<day column>=<day>/file=<number>`` in no more files per day than planned; returns the plan.

    A record goes to one of its day's files by a hash of the record, and with it straight to the task of that file: one shuffle. Days
    and their files lie in a row, and a task writes those that begin in its stretch of ``TASK_RECORDS`` records, or of one file if
    that is larger; so the number of tasks grows with the records, not with the files, and no task writes more than about twice
    its stretch. A day of few records may leave a file that no record hashes to.
    """
    plan = plan_files(records, day, per_file)
    stretch = max(per_file, TASK_RECORDS)
    tasks = -(-(plan.agg(F.sum("records")).first()[0] or 1) // stretch)
    # One row per calendar day.
    placed = records.join(F.broadcast(plan.select(*[F.col(c).alias(f"_{c}") for c in ("day", "records", "files", "before")])), F.col(day).eqNullSafe(F.col("_day")))
    hashed = [f"`{f.name}`" for f in records.schema if "map<" not in f.dataType.simpleString()]
    dealt = placed.withColumn("file", F.pmod(F.xxhash64(*hashed), F.col("_files")).cast("int")).withColumn(
        "_task", F.floor((F.col("_before") + F.floor(F.col("file") * F.col("_records") / F.col("_files"))) / stretch).cast("int"))
    dealt = dealt.repartitionById(tasks, "_task").drop("_task", "_day", "_files", "_records", "_before")
    dealt.write.partitionBy(day, "file").option("ignoreNullFields", True).format(format).save(path)
    return plan


def write_record_files(records: DataFrame, root: str, path: str, content: str) -> None:
    """One file per record: ``content`` under ``root`` at the relative ``path``, such as ``day/name.json``. The layout a crawl leaves
    behind; for large collections one record a line is better. Tasks write through the file system of ``root``; a file appears
    whole or not at all, and a task that runs again writes the same ones."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root if "://" in root or root.startswith("/") else f"file:{root}")
        made = set()
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                folder = f"{base}/{name}".rpartition("/")[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                draft = f"{folder}/.{uuid.uuid4().hex}"
                with system.open_output_stream(draft) as out:
                    out.write((text or "").encode())
                system.move(draft, f"{base}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    records.select(F.col(path).cast("string"), F.col(content).cast("string")).mapInArrow(write, "n long").agg(F.sum("n")).collect()
