"""Extra: the stateless plans over streams of new rows or files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from vellumine.operators.metrics import score_texts
from vellumine.plans import pipeline
from vellumine.plans.registry import Registry


def document_stream(spark: SparkSession, path: str, schema: StructType, max_files: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def scored_stream(docs: DataFrame) -> DataFrame:
    return score_texts(docs)


def pipeline_stream(docs: DataFrame, registry: Registry, **choice) -> DataFrame:
    """Every combination of each new document, scored; ranking is per micro-batch, see ``best_writer``."""
    return pipeline.process(docs, registry, **choice)


def best_writer(path: str):
    """A ``foreachBatch`` function that appends each micro-batch's best combinations by document.

    A batch that is run again writes its own folder anew, so results are whole and single.
    """

    def write(batch: DataFrame, number: int) -> None:
        pipeline.best(batch, "doc_id").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
