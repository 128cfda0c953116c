"""Sources and sinks: files as rows of bytes, parquet tables, JSON and text reports, written documents."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parchment.functions import sniffing
from parchment.session import prepare


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_files(spark: SparkSession, path: str, pattern: str = "*.pdf", largest: int | None = None) -> DataFrame:
    """doc_id (the path), name, length, content. Files over `largest` are left out before their bytes are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    if largest is not None:
        files = files.where(F.col("length") <= largest)
    return files.select(F.col("path").alias("doc_id"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "length", "content")


def oversized(spark: SparkSession, path: str, largest: int, pattern: str = "*.pdf") -> DataFrame:
    """The files that read_files leaves out, as findings; their content is never read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.where(F.col("length") > largest).select(F.col("path").alias("doc_id"), F.lit("LIMIT").alias("category"), F.lit("FILE_SIZE").alias("detail"), F.col("length").cast("string").alias("value"))


def size_in_bytes(text: Column) -> Column:
    """`10mb`, `1.5k` and the like, in powers of 1024; null for what is none."""
    number = F.regexp_extract(text, r"(?i)^\s*(\d+(?:\.\d+)?)\s*([kmg]?)b?\s*$", 1)
    unit = F.lower(F.regexp_extract(text, r"(?i)^\s*(\d+(?:\.\d+)?)\s*([kmg]?)b?\s*$", 2))
    factor = F.when(unit == "k", 1 << 10).when(unit == "m", 1 << 20).when(unit == "g", 1 << 30).otherwise(1)
    return F.when(number != "", F.floor(number.cast("double") * factor).cast("long"))


def read_ranges(spark: SparkSession, paths: list[str], offset: int = 0, length: int = 1024) -> DataFrame:
    """doc_id (the path), size and the bytes from offset on, of each file: ranged reads, so that a large file in an
    object store is not read whole to be told apart. An offset that is negative or past the end gives no bytes."""
    prepare(spark)

    def read(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            out = []
            for uri in batch["doc_id"]:
                store, name = fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)
                with store.open_input_file(name) as f:
                    size = f.size()
                    start, stop = span(offset, length, size)
                    out.append((uri, size, f.read_at(stop - start, start) if stop > start else b""))
            yield pd.DataFrame(out, columns=["doc_id", "size", "content"])

    return spark.createDataFrame([(p,) for p in paths], "doc_id string").repartition(max(1, min(len(paths), 200))).mapInPandas(read, "doc_id string, size long, content binary")


def span(offset, length, size: int) -> tuple[int, int]:
    """A read within a file: (start, stop), empty for what is no offset or length."""
    if type(offset) is not int or type(length) is not int or offset < 0 or length < 0 or offset >= size:
        return 0, 0
    return offset, min(size, offset + length)


def detected(docs: DataFrame) -> DataFrame:
    """docs (name, declared, content) with `offset` of the PDF in each, or null: where its header stands in the first
    bytes, or 0 without one if its name or declared type says PDF and it opens as one (then `heuristic` is true)."""

    @F.pandas_udf("boolean")
    def opens(content: pd.Series) -> pd.Series:
        from parchment.sources.pdf.inspect import inspect

        return content.map(lambda c: None if c is None else inspect(bytes(c)).pages > 0)

    prepare(docs.sparkSession)
    at = sniffing.detect_pdf(F.col("content"))
    says = (sniffing.family(F.col("declared")) == "application/pdf") | (sniffing.type_from_name(F.col("name")) == "application/pdf")
    tried = docs.withColumn("__at", at).withColumn("heuristic", opens(F.when(F.col("__at").isNull() & F.coalesce(says, F.lit(False)), F.col("content"))))
    tried = tried.withColumn("heuristic", F.coalesce("heuristic", F.lit(False)))
    return tried.withColumn("offset", F.coalesce("__at", F.when(F.col("heuristic"), F.lit(0)))).drop("__at")


def shown(text: Column) -> Column:
    """Text for a terminal: control characters, DEL and C1 as their JSON escapes."""
    return _escaped(text, [*range(0x20), *range(0x7F, 0xA0)])


def _escaped(text: Column, codes: list[int]) -> Column:
    odd = text.rlike("[" + "".join(f"\\x{{{c:x}}}" for c in codes) + "]")
    out = text
    for c in codes:
        out = F.replace(out, F.lit(chr(c)), F.lit(f"\\u{c:04x}"))
    return F.when(odd, out).otherwise(text)  # nearly all text has none


def report_lines(findings: DataFrame) -> DataFrame:
    """One printable line for each finding (doc_id, ordinal, action, category, detail, location[, description])."""
    what = F.col("description") if "description" in findings.columns else F.lit("")
    line = F.concat_ws(" ", F.rpad("action", 6, " "), F.concat_ws("/", "category", "detail"), F.when(F.coalesce("location", F.lit("")) != "", F.concat(F.lit("["), F.col("location"), F.lit("]"))), F.when(what != "", F.concat(F.lit("- "), what)))
    return findings.select("doc_id", "ordinal", shown(line).alias("line"))


def text_reports(inspections: DataFrame, findings: DataFrame) -> DataFrame:
    """doc_id, report: a line for the document and one for each finding, in order. Kinds are capped before (policy.reported)."""
    lines = report_lines(findings).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "line"))), lambda x: F.concat(F.lit("\n  "), x["line"])), "").alias("lines"))
    head = F.concat(shown(F.col("doc_id").cast("string")), F.lit(": "), F.col("status"), F.when(F.col("risk") != "", F.concat(F.lit(", risk "), F.col("risk"))).otherwise(""), F.coalesce(F.concat(F.lit(" (score "), F.col("score"), F.lit(")")), F.lit("")))
    return inspections.join(lines, "doc_id", "left").select("doc_id", F.concat(head, F.coalesce("lines", F.lit(""))).alias("report"))


def json_reports(inspections: DataFrame, findings: DataFrame) -> DataFrame:
    """A JSON report for each document, its findings in order; DEL and C1 are escaped too. Kinds are capped before
    (policy.reported), so a document's list is bounded."""
    extra = [c for c in ("value", "count", "description", "attachment") if c in findings.columns]
    one = F.struct("ordinal", "category", "detail", "action", "location", *extra)
    told = findings.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("findings"))
    rows = inspections.join(told, "doc_id", "left")
    return rows.select("doc_id", _escaped(F.to_json(F.struct("status", "score", "risk", "findings")), list(range(0x7F, 0xA0))).alias("report"))


def write_outputs(disarmed: DataFrame, path: str) -> None:
    """Write (doc_id, output) of the documents that have one; the writer's commit makes files appear whole."""
    disarmed.where("output is not null").select("doc_id", "output").write.mode("errorifexists").parquet(path)


def write_files(disarmed: DataFrame, path: str) -> int:
    """Write output of (name, output) as a file of its own for each document that has one; gives back how many.

    A file appears by a rename, so a task that fails or runs twice leaves no partial one. Names that repeat get a number.
    """
    prepare(disarmed.sparkSession)

    def write(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path))
        store.create_dir(base, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for name, output in zip(batch["name"], batch["output"]):
                with store.open_output_stream(f"{base}/.{name}.{attempt}") as out:
                    out.write(bytes(output))
                store.move(f"{base}/.{name}.{attempt}", f"{base}/{name}")
            yield pd.DataFrame({"written": [len(batch)]})

    rows = disarmed.where("output is not null").select(F.regexp_replace("name", r"[/\\\\\x00-\x1f]", "_").alias("name"), "doc_id", "output")
    seen = rows.select("doc_id", F.row_number().over(Window.partitionBy("name").orderBy("doc_id")).alias("n"))
    rows = rows.join(seen, "doc_id").select(F.when(F.col("n") > 1, F.concat(F.col("n") - 1, F.lit("-"), "name")).otherwise(F.col("name")).alias("name"), "output")
    return rows.mapInPandas(write, "written long").agg(F.coalesce(F.sum("written"), F.lit(0))).first()[0]
