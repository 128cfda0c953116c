"""File types from first bytes, names and declarations, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions and the types they name.
EXTENSIONS = """
pdf application/pdf
zip docx xlsx pptx odt ods odp epub jar application/zip
png image/png
jpg jpeg image/jpeg
gif image/gif
svg image/svg+xml
xml application/xml
html htm text/html
doc xls ppt msg application/x-ole-storage
exe dll application/x-msdownload
csv text/csv
tsv tab text/tab-separated-values
json application/json
"""

# First bytes, in hexadecimal, and the types they name, in the order they are tried.
SIGNATURES = """
504B03 504B05 504B07 application/zip
89504E47 image/png
FFD8FF image/jpeg
474946383761 474946383961 image/gif
D0CF11E0 application/x-ole-storage
4D5A application/x-msdownload
7F454C46 application/x-executable
"""

# Families that a signature exists for.
SNIFFABLE = ("application/pdf", "zip", "image/png", "image/jpeg", "image/gif", "ole", "application/x-msdownload", "application/x-executable", "svg", "xml", "text/html")

HEAD = 1024


def _pairs(table: str) -> list[tuple[str, str]]:
    return [(key, row[-1]) for row in map(str.split, table.split("\n")) if row for key in row[:-1]]


def sniff_type(content: Column) -> Column:
    """The type that the first bytes of a binary column show, or null. A PDF header counts anywhere in them."""
    head = F.substring(content, 1, HEAD)
    text = F.decode(head, "ISO-8859-1")
    first = F.hex(F.substring(content, 1, 8))
    out = F.when(F.instr(text, "%PDF-") > 0, F.lit("application/pdf"))
    for signature, kind in _pairs(SIGNATURES):
        out = out.when(first.startswith(signature), F.lit(kind))
    body = F.regexp_replace(F.regexp_replace(text, "^ï»¿", ""), r"^[\s\x{A0}\x{0B}]+", "")
    xml, svg = body.rlike(r"(?i)^<\?xml"), text.rlike(r"(?i)<svg[\s>/]")
    out = out.when(body.rlike(r"(?i)^<svg[\s>/]") | (xml & svg), F.lit("image/svg+xml"))
    return out.when(xml, F.lit("application/xml")).when(body.rlike(r"(?i)^(<!doctype html|<html[\s>])"), F.lit("text/html"))


def family(mime: Column) -> Column:
    """Types of one container, and aliases of one type, as one name."""
    m = F.trim(F.get(F.split(F.lower(mime), ";"), 0))
    return (
        F.when(m.isin("image/jpg", "image/pjpeg"), F.lit("image/jpeg"))
        .when(m == "image/x-png", F.lit("image/png"))
        .when(m == "application/x-pdf", F.lit("application/pdf"))
        .when(m.isin("application/zip", "application/x-zip-compressed", "application/x-zip", "application/epub+zip", "application/java-archive") | m.contains("openxmlformats") | m.contains("opendocument"), F.lit("zip"))
        .when(m == "image/svg+xml", F.lit("svg"))
        .when(m.isin("application/xml", "text/xml"), F.lit("xml"))
        .when(m.isin("application/msword", "application/vnd.ms-excel", "application/vnd.ms-powerpoint", "application/x-ole-storage", "application/vnd.ms-outlook"), F.lit("ole"))
        .otherwise(m)
    )


def extension_of(name: Column) -> Column:
    """The lower-cased extension of a file name, or null; dots and spaces at its end do not count."""
    found = F.regexp_extract(F.rtrim(name, F.lit(". ")), r"(?s)\.([^./\\]+)$", 1)
    return F.when(found != "", F.lower(found))


def type_from_name(name: Column) -> Column:
    ext = extension_of(name)
    out = None
    for kind in dict.fromkeys(t for _, t in _pairs(EXTENSIONS)):
        here = ext.isin(*[e for e, t in _pairs(EXTENSIONS) if t == kind])
        out = F.when(here, F.lit(kind)) if out is None else out.when(here, F.lit(kind))
    return out


def types_disagree(declared: Column, name: Column, sniffed: Column) -> Column:
    """Whether two of the three contradict each other, or a claim that has a signature met none."""
    claims = F.filter(F.array(declared, type_from_name(name)), lambda t: t.isNotNull() & (t != ""))
    claims = F.filter(F.transform(claims, family), lambda t: t != "application/octet-stream")
    every = F.when(sniffed.isNotNull(), F.concat(claims, F.array(family(sniffed)))).otherwise(claims)
    # svg and xml agree, so they count as one kind where they are compared
    kinds = F.array_distinct(F.transform(every, lambda t: F.when(t == "svg", F.lit("xml")).otherwise(t)))
    return (F.size(kinds) > 1) | (sniffed.isNull() & F.arrays_overlap(claims, F.array(*map(F.lit, SNIFFABLE))))


def detect_pdf(content: Column) -> Column:
    """Where a PDF begins in the first bytes (from 0), or null."""
    at = F.instr(F.decode(F.substring(content, 1, HEAD), "ISO-8859-1"), "%PDF-")
    return F.when(at > 0, at - 1)
