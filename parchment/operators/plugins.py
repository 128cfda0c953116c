"""Plugins for what documents contain: files and scripts. The first that accepts an item decides it.

A plugin says by a Column expression what it accepts, so choosing needs no Python; process runs in an Arrow UDF over
its own items only. It answers `passed`, `removed`, or (result, kept bytes or None, findings); result may also be
`scrubbed`, with the bytes to keep. What it raises, and any other answer, counts as failed, and the item goes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from parchment.functions import datafiles, sniffing

TOLD = "array<struct<category:string,detail:string,action:string,weight:int,location:string,attachment:string>>"
ANSWER = f"result string, output binary, told {TOLD}"


class Context(NamedTuple):
    """What a plugin learns of an item. depth: 1 for what lies in an uploaded document, 2 for what lies in that."""

    name: str
    declared: str
    sniffed: str
    location: str
    depth: int


class FilePlugin(NamedTuple):
    """accepts(name, declared type, type by content) of a file; process(bytes, Context), or None where the files are
    documents that the engine itself disarms."""

    name: str
    accepts: Callable[[Column, Column, Column], Column]
    process: Callable[[bytes, Context], Any] | None


class ScriptPlugin(NamedTuple):
    """accepts(text, location) of a script; process(text, Context), whose kept bytes are the new text."""

    name: str
    accepts: Callable[[Column, Column], Column]
    process: Callable[[str, Context], Any]


def _kind(declared: Column) -> Column:
    return F.trim(F.get(F.split(F.lower(declared), ";"), 0))


def _delimited(mark: bytes, formulas: str) -> Callable[[bytes, Context], Any]:
    def process(data: bytes, _: Context):
        found, out = datafiles.scan_delimited(data, mark)
        if found < 0 or (found and formulas == "remove"):
            return "removed"
        return ("scrubbed", out, []) if found and formulas == "escape" else "passed"

    return process


# The types that data files are declared as.
CSV_TYPES = ("text/csv", "application/csv", "text/comma-separated-values", "text/x-csv", "application/x-csv", "text/x-comma-separated-values")
TSV_TYPES = ("text/tab-separated-values", "text/tsv", "text/x-tsv")



def csv_plugin(formulas: str = "escape") -> FilePlugin:
    """Comma-separated files: cells that a spreadsheet would run are escaped, kept, or remove the file."""
    return FilePlugin("csv", lambda name, declared, _: (sniffing.extension_of(name) == "csv") | _kind(declared).isin(*CSV_TYPES), _delimited(b",", formulas))


def tsv_plugin(formulas: str = "escape") -> FilePlugin:
    return FilePlugin("tsv", lambda name, declared, _: sniffing.extension_of(name).isin("tsv", "tab") | _kind(declared).isin(*TSV_TYPES), _delimited(b"\t", formulas))


CSV, TSV = csv_plugin(), tsv_plugin()
JSON = FilePlugin("json", lambda name, declared, _: (sniffing.extension_of(name) == "json") | _kind(declared).isin("application/json", "text/json") | _kind(declared).endswith("+json"), lambda data, _: "passed" if datafiles.is_json(data) else "removed")
#: Documents inside documents: the engine's own run, a level down.
PDF = FilePlugin("pdf", lambda name, declared, sniffed: (sniffed == "application/pdf") | (sniffing.type_from_name(name) == "application/pdf") | (_kind(declared) == "application/pdf"), None)
DEFAULT = (CSV, TSV, JSON)


def pass_through(*types: str) -> FilePlugin:
    """Keeps files as they are, by MIME type (an entry with a slash) or by extension."""
    kinds = {t.lower() for t in types if "/" in t}
    endings = {t.strip().lower().removeprefix(".") for t in types if "/" not in t}

    def accepts(name: Column, declared: Column, sniffed: Column) -> Column:
        out = sniffing.extension_of(name).isin(*endings) if endings else F.lit(False)
        for t in (sniffed, declared, sniffing.type_from_name(name)):
            out = F.coalesce(out, F.lit(False)) | F.coalesce(_kind(t).isin(*kinds) if kinds else F.lit(False), F.lit(False))
        return out

    return FilePlugin(f"passThrough({','.join(types)})", accepts, lambda data, _: "passed")


def first_of(accepted: Sequence[Column]) -> Column:
    """The number of the first true column, or null."""
    return F.coalesce(*[F.when(F.coalesce(a, F.lit(False)), F.lit(k)) for k, a in enumerate(accepted)], F.lit(None).cast("int"))


def _answer(found: Any) -> tuple[str, bytes | None, list[dict]]:
    result, output, told = (found, None, []) if isinstance(found, str) else (tuple(found) + (None, None))[:3]
    if isinstance(output, str):
        output = output.encode()
    if result not in ("passed", "scrubbed", "removed") or (result == "scrubbed" and not output):
        result = "failed"
    return result, output, [{"category": t["category"], "detail": t["detail"], "action": t.get("action", "info"), "weight": int(t.get("weight", 0)), "location": t.get("location", ""), "attachment": t.get("attachment", "")} for t in told or []]


def answers(process: Callable, content: Column, context: dict[str, Column], depth: int, text: bool = False) -> Column:
    """struct(result, output, told) of each content that is not null."""

    @F.pandas_udf(ANSWER)
    def run(data: pd.Series, name: pd.Series, declared: pd.Series, sniffed: pd.Series, location: pd.Series) -> pd.DataFrame:
        rows: list[tuple] = []
        for body, *about in zip(data, name, declared, sniffed, location):
            if body is None:
                rows.append((None, None, None))
                continue
            try:
                body = bytes(body)
                rows.append(_answer(process(body.decode("utf-8", "surrogatepass") if text else body, Context(*(x or "" for x in about), depth))))
            except Exception:  # a plugin is the caller's code; whatever it raises is its failure, and is reported as such
                rows.append(("failed", None, []))
        return pd.DataFrame(rows, columns=["result", "output", "told"])

    return run(content, *[context[k] for k in ("name", "declared", "sniffed", "location")])
