"""Results in numbered run folders, through Hadoop's file systems: any store that Spark writes to."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.plans.report import stage_file

STAGES = ("extraction", "cleaning", "conversion", "quality")


def _store(spark: SparkSession, directory: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(directory)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _folders(spark: SparkSession, directory: str) -> list:
    path, store = _store(spark, directory)
    return [f for f in store.listStatus(path) if f.isDirectory()] if store.exists(path) else []


def next_run(spark: SparkSession, directory: str) -> int:
    """Makes the folder numbered one above the highest there is and returns its number. Two callers never get the same one."""
    number = max((int(f.getPath().getName()) for f in _folders(spark, directory) if f.getPath().getName().isdigit()), default=0) + 1
    while True:
        path, store = _store(spark, f"{directory}/{number}/_begun")
        try:
            store.create(path, False).close()  # fails if another has begun this run
            return number
        except Exception as e:  # noqa: BLE001  Java's exceptions differ by store
            if "xist" not in str(e):
                raise
            number += 1


def write_stage(stage: DataFrame, directory: str, run: int, number: int, libraries: list[str], llm: bool = False) -> str:
    """Completed rows of a stage as a table in the run's folder, with the name that each row's file has."""
    name = STAGES[number - 1]
    done = stage.filter(F.col("status") == "completed") if "status" in stage.columns else stage
    used = [c for c in libraries if c in stage.columns]
    named = done.withColumn("file_name", stage_file(F.lit(number), F.lit(name), F.array(*used) if used else F.array().cast("array<string>"), F.lit("md"), F.lit(llm)))
    path = f"{directory}/{run}/{number}_{name}"
    named.write.mode("overwrite").parquet(path)
    return path


def storage_info(spark: SparkSession, directory: str) -> dict:
    path, store = _store(spark, directory)
    if not store.exists(path):
        return {"total_size_mb": 0.0, "total_files": 0, "total_directories": 0, "base_directory": directory}
    sums = store.getContentSummary(path)
    return {"total_size_mb": sums.getLength() / (1 << 20), "total_files": sums.getFileCount(), "total_directories": sums.getDirectoryCount() - 1, "base_directory": directory}


def cleanup(spark: SparkSession, directory: str, days: float = 7, now: float | None = None) -> int:
    """Deletes folders last changed over ``days`` days ago; how many went."""
    before, gone = ((time.time() if now is None else now) - days * 86400) * 1000, 0
    for folder in _folders(spark, directory):
        if folder.getModificationTime() < before:
            gone += bool(_store(spark, directory)[1].delete(folder.getPath(), True))
    return gone
