"""Documents as they arrive: an extension, the batch operators over a streaming file source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.operators.documents import findings_of, read_documents


def arriving(spark: SparkSession, path: str, pattern: str = "*.pdf", each: int = 100) -> DataFrame:
    """A stream of (doc_id, content) of files that land in a folder, `each` files a batch at most."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", each).load(path)
    return files.select(F.col("path").alias("doc_id"), "content")


def findings_stream(spark: SparkSession, path: str, **how) -> DataFrame:
    """A stream of findings; every step is stateless by row, so no watermark is needed. What hangs on a document's other
    findings (a calculation order, a silent loss) is left to a batch."""
    return findings_of(read_documents(arriving(spark, path, **how))).drop("body").where("not (category = 'FORM' and detail = 'ORDER' or category = 'PROCESSING' and detail = 'LOST')")
