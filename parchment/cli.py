"""Command line: inspect documents, or write cleaned copies. `python -m parchment inspect a.pdf`, `... defuse in.pdf out.pdf`.

A folder or a pattern is taken as many documents, of which each is a row; `-` is standard input or output. The exit
code is 0 where all are clean, 1 where something was or would be removed, 2 where one is rejected, 3 for a wrong use or
a failed read or write.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import tempfile

from parchment.sources.pdf.inspect import Limits

LIMITS = {"fileSize": "file_size", "objects": "objects", "decompressedBytes": "decompressed", "nestingDepth": "nesting", "timeMs": "seconds"}


class Misuse(Exception):
    """Arguments that make no sense."""


def size_of(text: str) -> int:
    """`10mb`, `1.5k` and the like in bytes, by powers of 1024."""
    text = text.strip().lower()
    digits = text.rstrip("kmgb").rstrip()
    unit = text[len(digits) :].strip()
    try:
        number = float(digits)
    except ValueError:
        raise Misuse(f"a size that is none: {text}") from None
    if unit not in ("", "b", "k", "kb", "m", "mb", "g", "gb") or number < 0 or not digits.replace(".", "", 1).isdigit():
        raise Misuse(f"a size that is none: {text}")
    return round(number * 1024 ** " kmg".index(unit[:1] if unit[:1] in ("k", "m", "g") else " "))


def limits_of(pairs: list[str]) -> Limits:
    out = {}
    for pair in pairs:
        name, _, value = pair.partition("=")
        if name not in LIMITS or not value:
            raise Misuse(f"a limit that is none: {pair}")
        number = size_of(value)
        out[LIMITS[name]] = number / 1000 if name == "timeMs" else number
    return Limits(**out)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="parchment", description=__doc__)
    out.add_argument("command", choices=("inspect", "defuse"))
    out.add_argument("paths", nargs="+")
    out.add_argument("--password", action="append", default=[])
    out.add_argument("--override", action="append", default=[], metavar="CATEGORY[/DETAIL]=ACTION")
    out.add_argument("--weight", action="append", default=[], metavar="CATEGORY[/DETAIL]=POINTS")
    out.add_argument("--keep-type", action="append", default=[])
    out.add_argument("--defuse-attached-pdfs", action="store_true")
    out.add_argument("--scrub-attached-csv", action="store_true")
    out.add_argument("--scrub-attached-tsv", action="store_true")
    out.add_argument("--keep-attached-json", action="store_true")
    out.add_argument("--csv-formulas", choices=("escape", "keep", "remove"), default="escape")
    out.add_argument("--strip-metadata", action="store_true")
    out.add_argument("--limit", action="append", default=[], metavar="NAME=VALUE")
    out.add_argument("--base")
    out.add_argument("--json", action="store_true")
    return out


def _table(spark, pairs: list[str], value: str):
    rows = []
    for at, pair in enumerate(pairs):
        kind, _, given = pair.partition("=")
        category, _, detail = kind.partition("/")
        if not category or not given:
            raise Misuse(f"no kind and value: {pair}")
        if value == "weight" and not given.lstrip("-").isdigit() or value == "action" and given not in ("info", "strip", "reject"):
            raise Misuse(f"a value that is none: {pair}")
        rows.append((at, category, detail or None, int(given) if value == "weight" else given))
    return spark.createDataFrame(rows, f"list_pos int, category string, detail string, {value} {'int' if value == 'weight' else 'string'}") if rows else None


def run(argv: list[str], spark=None) -> int:
    try:
        given = parser().parse_args(argv)
    except SystemExit as e:
        return 0 if e.code in (0, None) else 3
    held = None
    try:
        if len(given.paths) != (1 if given.command == "inspect" else 2):
            raise Misuse("inspect takes one path, defuse two")
        source, target = given.paths[0], given.paths[-1]
        if given.command == "defuse" and "-" not in (source, target) and os.path.exists(target) and os.path.exists(source) and os.path.samefile(source, target):
            raise Misuse("the input and the output are the same file")
        limits = limits_of(given.limit)
        if source == "-":
            held = tempfile.mkdtemp(prefix="parchment-")
            source = os.path.join(held, "input.pdf")
            _copy_input(sys.stdin.buffer, source, limits.file_size)
        return _go(given, source, target, limits, spark)
    except Misuse as e:
        print(f"{e}\n\n{parser().format_usage()}", file=sys.stderr)
        return 3
    except Exception as e:  # whatever fails here is a read or a write, which has an exit code of its own
        print(f"Error: {str(e).splitlines()[0] if str(e) else type(e).__name__}", file=sys.stderr)
        return 3
    finally:
        if held:
            import shutil

            shutil.rmtree(held, ignore_errors=True)


def _copy_input(stream, path: str, most: int | None) -> None:
    """Standard input as a file; a byte past the limit is enough to tell that it is too large."""
    with open(path, "wb") as out:
        left = None if most is None else most + 1
        while left is None or left > 0:
            data = stream.read(1 << 18 if left is None else min(left, 1 << 18))
            if not data:
                break
            out.write(data)
            left = None if left is None else left - len(data)


def _go(given, source: str, target: str, limits: Limits, spark) -> int:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from parchment.operators import documents, plugins, policy
    from parchment.sources import files

    mine = spark is None
    spark = spark or SparkSession.builder.master(os.environ.get("PARCHMENT_MASTER", "local[*]")).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        chosen = [plugins.pass_through(*given.keep_type)] if given.keep_type else []
        chosen += [plugins.PDF] * given.defuse_attached_pdfs + [plugins.csv_plugin(given.csv_formulas)] * given.scrub_attached_csv + [plugins.tsv_plugin(given.csv_formulas)] * given.scrub_attached_tsv + [plugins.JSON] * given.keep_attached_json
        docs = files.read_files(spark, source, pattern="*")
        if docs.select("doc_id").isEmpty():
            raise FileNotFoundError(source)
        how = {"overrides": _table(spark, given.override, "action"), "weights": _table(spark, given.weight, "weight"), "files": tuple(chosen), "base": given.base, "passwords": given.password, "limits": limits, "strip_metadata": given.strip_metadata}
        if given.command == "inspect":
            told, findings = documents.inspect_documents(docs, **how)
            statuses = files.json_reports(told, findings) if given.json else files.text_reports(told, findings)
        else:
            done, findings, _ = documents._disarmed(docs, **how)
            if target == "-" or os.path.splitext(target)[1]:
                rows = done.limit(2).collect()
                if len(rows) > 1:
                    raise Misuse("many documents need a folder to go to")
                _put(rows[0]["output"], target)
            else:
                files.write_files(done.join(docs.select("doc_id", "name"), "doc_id"), target)
            told = done.select("doc_id", "status", F.lit(None).cast("int").alias("score"), F.lit("").alias("risk"))
            statuses = (files.json_reports if given.json else files.text_reports)(told, policy.reported(findings))
        worst = told.agg(F.max(policy.exit_code(F.col("status")))).first()[0]
        for row in statuses.orderBy("doc_id").toLocalIterator():
            print(f"{row['report']}", file=sys.stderr if target == "-" and given.command == "defuse" else sys.stdout)
        return int(worst)
    finally:
        if mine:
            spark.stop()


def _put(output, target: str) -> None:
    if output is None:
        return
    if target == "-":
        sys.stdout.buffer.write(bytes(output))
        return
    with open(f"{target}.part", "wb") as out:
        out.write(bytes(output))
    os.replace(f"{target}.part", target)


def main() -> None:
    sys.exit(run(sys.argv[1:]))
