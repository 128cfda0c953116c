"""Queries over the driver's tables, each with its SQL. Hostile inputs are chosen by row key, alike in both."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.functions import datafiles, links, sniffing
from parchment.operators import documents, graph, plugins, policy
from parchment.plans.spec import finding_rows, finding_spec
from parchment.session import bounded_batches, prepare
from parchment.sources import files
from parchment.sources.files import read_table
from parchment.sources.pdf import builder

_found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            bounded_batches(spark)
            return f(spark, sf_dir)

        _found[f.__name__] = run
        if sql:
            _sql[f.__name__] = sql
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_found)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def pick(values: Iterable, key: Column) -> Column:
    """The value that a row's key chooses."""
    values = list(values)
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def _q(value) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def pick_sql(values: Iterable, key: str) -> str:
    values = list(values)
    return f"[{', '.join(map(_q, values))}][{key} % {len(values)} + 1]"


_HREF = 'href="([^"]*)"'
_URL_HOST = "lower(regexp_extract(url, '://([^/?#:]*)', 1))"


#: An http address as the SQL judges it: by its authority alone.
_JUDGED = """CASE WHEN NOT regexp_matches({u}, '^https?://') THEN 'OTHER_SCHEME' WHEN contains({a}, '@') THEN 'CREDENTIALS' WHEN contains({a}, '%') THEN 'ENCODED_HOST'
    WHEN regexp_matches({a}, '^([0-9.]+|\\[.*)(:[0-9]*)?$') THEN 'IP_HOST' WHEN contains({a}, 'xn--') THEN 'LOOKALIKE_HOST' ELSE 'SAFE' END"""


def _judged(u: str) -> str:
    return _JUDGED.format(u=u, a=f"regexp_extract({u}, '://([^/?#]*)', 1)")


@query(f"SELECT page_id, {_judged('url')} AS detail, {_URL_HOST} AS host FROM pages")
def url_verdict(spark, sf):
    v = links.link_verdict(F.col("url"))
    return read_table(spark, sf, "pages").select("page_id", v["detail"].alias("detail"), v["host"].alias("host"))


def _hrefs(spark, sf) -> DataFrame:
    pages = read_table(spark, sf, "pages")
    return pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(_HREF), F.lit(1))).alias("pos", "href"))


_HREFS = f"(SELECT page_id, url, unnest(range(len(h))) AS pos, unnest(h) AS href FROM (SELECT page_id, url, regexp_extract_all(html, '{_HREF}', 1) AS h FROM pages))"


@query(f"""SELECT page_id, CAST(pos AS INTEGER) AS pos, CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN {_judged('href')} WHEN regexp_matches(href, '^[/\\\\]{{2}}') THEN 'NETWORK_PATH'
    WHEN regexp_matches(href, '[\\x00-\\x1f]|\\\\') THEN 'PATH_TRICK' ELSE 'RELATIVE' END AS detail FROM {_HREFS}""")
def href_verdict(spark, sf):
    return _hrefs(spark, sf).select("page_id", "pos", links.link_verdict(F.col("href"))["detail"].alias("detail"))


@query(f"SELECT page_id, CAST(pos AS INTEGER) AS pos, {_judged('url')} AS detail, {_URL_HOST} AS host FROM {_HREFS}")
def href_with_base(spark, sf):
    rows = _hrefs(spark, sf)
    v = links.link_verdict(F.col("href"), F.col("url"))
    return rows.select("page_id", "pos", v["detail"].alias("detail"), v["host"].alias("host"))


#: Addresses around each page's own host {h} and number {n}: every scheme and every way to write a host.
ADDRESSES = [
    "https://{h}/a?b#{n}", "HTTP://{h}:8080/", "javascript:void({n})", " vbscript:x{n}", "data:text/plain,{n}", "file:///tmp/{n}", "file://{h}/{n}", "smb://{h}/{n}", "\\\\{h}\\{n}", "//{h}/{n}",
    "gopher://{h}/{n}", "news:{n}", "https://u{n}@{h}/", "http://10.0.7.{m}/", "http://[2001:db8::{m}]/", "https://xn--a{n}.{h}/", "https://%61{h}/", "mailto:a{n}@{h}", "mailto:a{n}@10.0.0.{m}", "{n}/page.html", "page-{n}.html?x=//y",
]


def _filled(templates: list[str], key: Column, host: Column) -> Column:
    out = pick(templates, key)
    for name, value in (("{h}", host), ("{n}", key.cast("string")), ("{m}", (key % 256).cast("string"))):
        out = F.replace(out, F.lit(name), value)
    return out


def _filled_sql(templates: list[str], key: str, host: str) -> str:
    return f"replace(replace(replace({pick_sql(templates, key)}, '{{h}}', {host}), '{{n}}', CAST({key} AS VARCHAR)), '{{m}}', CAST({key} % 256 AS VARCHAR))"


@query(f"""WITH a AS (SELECT page_id, trim({_filled_sql(ADDRESSES, 'page_id', _URL_HOST)}) AS u FROM pages), s AS (SELECT *, lower(regexp_extract(u, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) AS scheme FROM a)
    SELECT page_id, CASE WHEN regexp_matches(u, '^[/\\\\]{{2}}') THEN 'NETWORK_PATH' WHEN scheme = '' THEN 'RELATIVE' WHEN scheme IN ('javascript', 'vbscript') THEN 'URL' WHEN scheme = 'data' THEN 'DATA_URL'
    WHEN scheme = 'file' AND starts_with(u, 'file:///') THEN 'FILE_URL' WHEN scheme IN ('file', 'smb') THEN 'NETWORK_PATH' WHEN scheme = 'mailto' AND regexp_matches(u, '@[0-9.]+$') THEN 'IP_HOST' WHEN scheme = 'mailto' THEN 'SAFE'
    WHEN scheme NOT IN ('http', 'https') THEN 'OTHER_SCHEME' ELSE {_judged('lower(u)')} END AS detail FROM s""")
def hostile_uri_verdict(spark, sf):
    pages = read_table(spark, sf, "pages")
    host = F.lower(F.regexp_extract("url", "://([^/?#:]*)", 1))
    return pages.select("page_id", links.link_verdict(_filled(ADDRESSES, F.col("page_id"), host))["detail"].alias("detail"))


TRICKS = [
    ("docs/../../x.pdf", links.CLIMBS), ("..\\..\\calc.exe", links.BACKSLASH), ("docs/%2E%2E/x.pdf", links.ENCODED), ("docs/. ./x.pdf", links.DOTS), ("docs/\x01x.pdf", links.CONTROL),
    ("../../images/a.png", None), ("a/b/../c.html", None), ("a/../../b", links.CLIMBS), ("help/page.html?at=../..", None), ("a/./b//c", None), ("x%2fy", links.ENCODED),
]


@query(f"SELECT doc_id, {pick_sql([r for _, r in TRICKS], 'doc_id')} AS reason FROM documents")
def path_trick_reason(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", links.path_trick(pick([p for p, _ in TRICKS], F.col("doc_id"))).alias("reason"))


#: What a label says of a link to {h}: nothing, its site, one above or below it, an address at it, another one.
LABELS = ["click here", "at {h}", "www.{h}.", "see sub.{h}, please", "me@other.org", "https://{h}/x and other.org", "{h}_x", "other.org"]


@query(f"""WITH l AS (SELECT page_id, {_URL_HOST} AS host, {_filled_sql(LABELS, 'page_id', _URL_HOST)} AS label FROM pages),
    w AS (SELECT page_id, host, list_filter(string_split_regex(lower(label), '[ ,/]+|:|@'), lambda x: regexp_matches(x, '^([a-z0-9-]+\\.)+[a-z]+\\.?$')) AS named FROM l),
    n AS (SELECT page_id, host, list_transform(named, lambda x: regexp_replace(regexp_replace(x, '^www\\.', ''), '\\.$', '')) AS named FROM w)
    SELECT page_id, len(named) > 0 AND len(list_filter(named, lambda x: x = host OR ends_with(x, '.' || host) OR ends_with(host, '.' || x))) = 0 AS mismatch FROM n""")
def label_mismatch(spark, sf):
    pages = read_table(spark, sf, "pages")
    host = links.link_verdict(F.col("url"))["host"]
    return pages.select("page_id", links.label_mismatch(_filled(LABELS, F.col("page_id"), host), host).alias("mismatch"))


@query(
    """WITH l AS (SELECT page_id % 20 AS doc_id, page_id AS ordinal, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS host FROM pages),
    f AS (SELECT doc_id, host, min(ordinal) AS ordinal, count(*) AS n FROM l GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) AS k FROM f)
    SELECT doc_id, CAST(sum(n) AS BIGINT) AS count, string_agg(host, ', ' ORDER BY ordinal) FILTER (k <= 20) AS hosts FROM r GROUP BY doc_id"""
)
def safe_link_hosts(spark, sf):
    host = links.link_verdict(F.col("url"))["host"]
    return policy.safe_hosts(read_table(spark, sf, "pages").select((F.col("page_id") % 20).alias("doc_id"), F.col("page_id").alias("ordinal"), host.alias("host")))


@query("SELECT o_orderkey, (o_orderkey % 612) * (o_orderkey % 792) >= 0.5 * 612 * 792 AS full_page FROM orders")
def full_page_links(spark, sf):
    w, h = (F.col("o_orderkey") % 612).cast("double"), (F.col("o_orderkey") % 792).cast("double")
    rect = F.array(F.lit(0.0), F.lit(0.0), w, h)
    return read_table(spark, sf, "orders").select("o_orderkey", links.covers_page(rect, F.lit(None).cast("array<double>")).alias("full_page"))


@query("SELECT page_id, CASE WHEN regexp_matches(lower(html[1:1024]), '^\\s*(<!--.*?-->\\s*)*<(!doctype html|html|head|body|script)') THEN 'text/html' WHEN starts_with(trim(html), '<?xml') THEN 'application/xml' END AS sniffed FROM pages")
def sniff_pages(spark, sf):
    return read_table(spark, sf, "pages").select("page_id", sniffing.sniff_type(F.col("html").cast("binary")).alias("sniffed"))


#: Openings (in hex) before each document's text, and what content of that opening is.
MAGIC = [
    ("6a756e6b255044462d312e37", "application/pdf"), ("504b0304", "application/zip"), ("504b0102", None), ("89504e470d0a1a0a", "image/png"), ("ffd8ffe0", "image/jpeg"), ("474946383961", "image/gif"),
    ("d0cf11e0a1b11ae1", "application/x-ole-storage"), ("4d5a9000", "application/x-msdownload"), ("7f454c46", "application/x-executable"), ("efbbbf3c73766720", "image/svg+xml"), ("3c3f786d6c3f3e3c613e", "application/xml"), ("203c68746d6c3e", "text/html"), ("", None),
]


@query(f"""WITH m AS (SELECT doc_id, coalesce(text, '') AS text, {pick_sql([h for h, _ in MAGIC], 'doc_id')} AS opening FROM documents), c AS (SELECT doc_id, lower(opening || hex(encode(text[1:1000]))) AS h FROM m)
    SELECT doc_id, CASE WHEN contains(h[1:2048], '255044462d') THEN 'application/pdf' WHEN regexp_matches(h, '^504b0[357]0[468]') THEN 'application/zip' WHEN starts_with(h, '89504e47') THEN 'image/png' WHEN starts_with(h, 'ffd8ff') THEN 'image/jpeg'
    WHEN regexp_matches(h, '^4749463[8]3[79]61') THEN 'image/gif' WHEN starts_with(h, 'd0cf11e0') THEN 'application/x-ole-storage' WHEN starts_with(h, '4d5a') THEN 'application/x-msdownload' WHEN starts_with(h, '7f454c46') THEN 'application/x-executable'
    WHEN regexp_matches(h, '^(efbbbf)?3c737667') THEN 'image/svg+xml' WHEN starts_with(h, '3c3f786d6c') THEN 'application/xml' WHEN regexp_matches(h, '^(20)*3c68746d6c') THEN 'text/html' END AS sniffed FROM c""")
def sniff_magic(spark, sf):
    docs = read_table(spark, sf, "documents")
    content = F.concat(F.unhex(pick([h for h, _ in MAGIC], F.col("doc_id"))), F.encode(F.coalesce("text", F.lit("")), "utf-8"))
    return docs.select("doc_id", sniffing.sniff_type(content).alias("sniffed"))


TYPES = [
    ("application/pdf", "a.pdf", "application/pdf", False), ("image/jpg", "a.jpeg", "image/jpeg", False), ("text/csv", "a.csv", None, False), ("application/pdf", "a.pdf", None, True),
    (None, "a.docx", "application/zip", False), ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", "a.docx", "application/zip", False), ("image/png", "a.exe", "image/png", True),
    ("application/octet-stream", "a.bin", "application/zip", False), ("image/svg+xml", "a.xml", "application/xml", False), (None, "page.html.", None, True), ("text/plain", "a.json", None, True), (None, None, "application/x-msdownload", False),
]


@query(f"SELECT doc_id, {pick_sql([str(x[3]).lower() for x in TYPES], 'doc_id')} = 'true' AS disagree FROM documents")
def type_mismatch(spark, sf):
    declared, name, sniffed = (pick([x[k] for x in TYPES], F.col("doc_id")) for k in range(3))
    return read_table(spark, sf, "documents").select("doc_id", sniffing.types_disagree(declared, name, sniffed).alias("disagree"))


#: What stands behind the name of a file.
ENDINGS = [".PDF", ".tar.gz", "", ".html. .", "...", ".b/c", ".d/x.csv", ".b\\c", " .x", "."]


@query(f"""WITH n AS (SELECT doc_id, rtrim(source || {pick_sql(ENDINGS, 'doc_id')}, '. ') AS name FROM documents), l AS (SELECT doc_id, name, list_last(string_split(name, '.')) AS last FROM n)
    SELECT doc_id, CASE WHEN contains(name, '.') AND NOT contains(last, '/') AND NOT contains(last, chr(92)) THEN lower(last) END AS ext FROM l""")
def extension_of(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", sniffing.extension_of(F.concat("source", pick(ENDINGS, F.col("doc_id")))).alias("ext"))


@query("SELECT event_id, json_valid(props) AS valid FROM events")
def json_valid_props(spark, sf):
    return read_table(spark, sf, "events").select("event_id", datafiles.json_valid(F.col("props")).alias("valid"))


#: Ways to damage a JSON text, or not, as SQL that both engines take.
DAMAGE = ["props", "left(props, length(props) - 1)", "concat(props, props)", "concat('[', props, ',', props, ']')", "concat('[', props, ' ', props, ']')", "concat('{\"a\":', props, '}')", "concat('{a:', props, '}')", "replace(props, ':', ' ')", "concat('[', event_id, ']')", "concat('[0', event_id, ']')", "concat('\"', event_id)"]
_DAMAGED = "CASE " + " ".join(f"WHEN event_id % {len(DAMAGE)} = {k} THEN {x}" for k, x in enumerate(DAMAGE)) + " END"


@query(f"SELECT event_id, json_valid({_DAMAGED}) AS valid FROM events")
def json_invalid_mutations(spark, sf):
    return read_table(spark, sf, "events").select("event_id", datafiles.json_valid(F.expr(_DAMAGED)).alias("valid"))


#: Cells of a row made from an order: an opening, and what follows it.
OPENINGS = ["", "=", "@", "+", "-", "\t", "\"=", "\"", "'=", " ="]


@query(f"""WITH c AS (SELECT o_orderkey, {pick_sql(OPENINGS, 'o_orderkey')} AS a, {pick_sql(OPENINGS, '(o_orderkey // 7)')} AS b, CAST(o_custkey AS VARCHAR) AS n, o_orderstatus AS t FROM orders),
    u AS (SELECT o_orderkey, unnest([{{'open': a, 'rest': n}}, {{'open': b, 'rest': t}}, {{'open': '', 'rest': '-' || n}}]) AS x FROM c),
    r AS (SELECT o_orderkey, replace(x.open, '"', '') AS open, x.rest AS rest FROM u)
    SELECT o_orderkey, CAST(count(*) FILTER (open IN ('=', '@', chr(9)) OR (open IN ('+', '-') AND NOT regexp_matches(rest, '^[0-9]+$'))) AS INTEGER) AS found FROM r GROUP BY o_orderkey""")
def csv_formula_scan(spark, sf):
    def cell(opening: Column, rest: Column) -> Column:
        return F.concat(opening, rest, F.when(opening.startswith('"'), F.lit('"')).otherwise(""))

    key, n = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    line = F.concat(cell(pick(OPENINGS, key), n), F.lit(","), cell(pick(OPENINGS, F.floor(key / 7)), F.col("o_orderstatus")), F.lit(",-"), n, F.lit("\n"))
    return read_table(spark, sf, "orders").select("o_orderkey", datafiles.delimited(line)["found"].alias("found"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN '''=' ELSE '' END || l_shipmode AS line
    FROM (SELECT l_orderkey, l_linenumber, l_returnflag || ',' || l_linestatus || chr(10) AS l_shipmode FROM lineitem)""")
def csv_escape(spark, sf):
    rows = read_table(spark, sf, "lineitem")
    line = F.concat(F.when(F.col("l_linenumber") % 3 == 0, "=").otherwise(""), "l_returnflag", F.lit(","), "l_linestatus", F.lit("\n"))
    return rows.select("l_orderkey", "l_linenumber", datafiles.delimited(line)["output"].cast("string").alias("line"))


MARKS = ["", "\x01", "\x7f", "\u0085", "\t", "\u00e9"]


@query(f"SELECT doc_id, NOT regexp_matches(coalesce(text, '') || {pick_sql(MARKS, 'doc_id')}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F\\x{{80}}-\\x{{9F}}]') AS ok FROM documents")
def text_check(spark, sf):
    text = F.concat(F.coalesce("text", F.lit("")), pick(MARKS, F.col("doc_id")))
    return read_table(spark, sf, "documents").select("doc_id", datafiles.text_valid(text, strict=True).alias("ok"))


_LINES = "SELECT l_suppkey AS doc_id, 'ACTION' AS category, CASE l_returnflag WHEN 'A' THEN 'LAUNCH' WHEN 'N' THEN 'HIDE' ELSE 'NAMED' END AS detail, l_orderkey * 10 + l_linenumber AS ordinal, ['info', 'strip', 'reject'][(l_orderkey + l_linenumber) % 3 + 1] AS action FROM lineitem"


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, category, detail ORDER BY ordinal) AS k FROM ({_LINES}))
    SELECT doc_id, category, detail, count(*) FILTER (k <= 200) AS kept, coalesce(count(*) FILTER (k > 200), 0) AS more,
    max_by(action, CASE action WHEN 'reject' THEN 2 WHEN 'strip' THEN 1 ELSE 0 END) FILTER (k > 200) AS more_action FROM r GROUP BY 1, 2, 3""")
def finding_cap_200(spark, sf):
    rows = read_table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("doc_id"), F.lit("ACTION").alias("category"), F.when(F.col("l_returnflag") == "A", "LAUNCH").when(F.col("l_returnflag") == "N", "HIDE").otherwise("NAMED").alias("detail"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"), pick(["info", "strip", "reject"], F.col("l_orderkey") + F.col("l_linenumber")).alias("action"), F.lit("").alias("location"),
    )
    out = policy.capped(rows).groupBy("doc_id", "category", "detail")
    return out.agg(F.count(F.when(F.col("count").isNull(), 1)).alias("kept"), F.coalesce(F.max("count"), F.lit(0)).alias("more"), F.max(F.when(F.col("count").isNotNull(), F.col("action"))).alias("more_action"))


_SPEC = "(VALUES " + ", ".join(f"({i}, '{c}', '{d}', '{a}', {w})" for i, (c, d, a, w) in enumerate(finding_rows())) + ") AS spec(pos, category, detail, action, weight)"


def _chosen(spark, sf, keys: DataFrame) -> DataFrame:
    """keys (doc_id, ordinal, pos) as findings of the kind that stands at pos in the vocabulary."""
    rows = finding_rows()
    kinds = spark.createDataFrame([(i, c, d) for i, (c, d, _, _) in enumerate(rows)], "pos int, category string, detail string")
    return keys.join(F.broadcast(kinds), "pos").drop("pos")


def _order_findings(spark, sf) -> DataFrame:
    pos = (F.col("o_orderkey") * 31 % len(finding_rows())).cast("int")
    return _chosen(spark, sf, read_table(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ordinal"), pos.alias("pos")))


_ORDER_FINDINGS = f"(SELECT o_custkey AS doc_id, o_orderkey AS ordinal, category, detail, action, weight FROM orders JOIN {_SPEC} ON o_orderkey * 31 % {len(finding_rows())} = pos)"
OVERRIDES = [(0, "ACTION", None, "info"), (1, "ACTION", "LAUNCH", "reject"), (2, "ACTION", "LAUNCH", "info"), (3, "LINK", "SAFE", "strip"), (4, "METADATA", None, "strip"), (5, "METADATA", None, "reject")]


@query(f"""SELECT doc_id, ordinal, CASE WHEN category = 'ACTION' AND detail = 'LAUNCH' THEN 'reject' WHEN category = 'LINK' AND detail = 'SAFE' THEN 'strip'
    WHEN category = 'ACTION' THEN 'info' WHEN category = 'METADATA' THEN 'strip' ELSE action END AS action FROM {_ORDER_FINDINGS}""")
def override_actions(spark, sf):
    table = spark.createDataFrame(OVERRIDES, "list_pos int, category string, detail string, action string")
    return policy.with_actions(_order_findings(spark, sf), table).select("doc_id", "ordinal", "action")


_SCORED = f"""k AS (SELECT doc_id, category, detail, max(weight) AS weight FROM {_ORDER_FINDINGS} GROUP BY 1, 2, 3),
    h AS (SELECT doc_id, max(weight) + (sum(weight) - max(weight)) / 4.0 AS total,
    bool_or(category = 'JAVASCRIPT' AND weight > 0) AS script, bool_or(category = 'EMBEDDED_FILE' AND weight > 0) AS file, bool_or(detail = 'ESCAPED_NAMES') AS escaped,
    bool_or((category, detail) IN (('JAVASCRIPT', 'OPEN_ACTION'), ('JAVASCRIPT', 'DOCUMENT'), ('JAVASCRIPT', 'PAGE'), ('ACTION', 'TRIGGERED'))) AS starts,
    bool_or((category, detail) IN (('ACTION', 'LAUNCH'), ('ACTION', 'REMOTE_GOTO'), ('ACTION', 'EMBEDDED_GOTO'), ('ACTION', 'SUBMIT_FORM'))) AS leaves,
    bool_or(detail IN ('EMPTY_PASSWORD', 'JBIG2_IMAGE')) AS other FROM k GROUP BY doc_id),
    s AS (SELECT doc_id, CAST(least(100, round(total + CASE WHEN starts AND leaves THEN 20 ELSE 0 END + CASE WHEN script AND escaped THEN 20 ELSE 0 END
    + CASE WHEN script AND file THEN 15 ELSE 0 END + CASE WHEN script AND other THEN 10 ELSE 0 END)) AS INTEGER) AS score FROM h)"""
_BAND = "CASE WHEN score >= 80 THEN 'CRITICAL' WHEN score >= 50 THEN 'HIGH' WHEN score >= 25 THEN 'MEDIUM' WHEN score >= 1 THEN 'LOW' ELSE 'NONE' END"


@query(f"WITH {_SCORED} SELECT doc_id, score, {_BAND} AS risk FROM s")
def doc_score(spark, sf):
    return policy.scores(_order_findings(spark, sf))


@query(f"""WITH {_SCORED}, a AS (SELECT doc_id, bool_or(action = 'reject') AS rejects, bool_or(action = 'strip' OR detail IN ('PLUGIN_SCRUBBED', 'STRIPPED')) AS changes FROM {_ORDER_FINDINGS} GROUP BY doc_id),
    d AS (SELECT c_custkey AS doc_id, c_custkey % 17 = 0 AS incomplete FROM customer),
    i AS (SELECT d.doc_id, incomplete, CASE WHEN incomplete OR coalesce(rejects, false) THEN 'rejected' WHEN coalesce(changes, false) THEN 'strippable' ELSE 'clean' END AS status, coalesce(score, 0) AS score
    FROM d LEFT JOIN a USING (doc_id) LEFT JOIN s USING (doc_id))
    SELECT doc_id, status, CASE WHEN incomplete THEN -1 ELSE score END AS score, CASE WHEN incomplete THEN 'UNKNOWN' ELSE {_BAND} END AS risk,
    CASE status WHEN 'clean' THEN 0 WHEN 'strippable' THEN 1 ELSE 2 END AS exit_code FROM i""")
def doc_status(spark, sf):
    docs = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), (F.col("c_custkey") % 17 == 0).alias("incomplete"))
    out = policy.inspections(docs, policy.with_actions(_order_findings(spark, sf)))
    return out.withColumns({"score": F.coalesce("score", F.lit(-1)), "exit_code": policy.exit_code(F.col("status"))})


@query(f"SELECT action, count(*) AS kinds, CAST(sum(weight) AS BIGINT) AS weight FROM {_SPEC} GROUP BY action")
def spec_summary(spark, sf):
    return finding_spec(spark).groupBy("action").agg(F.count("*").alias("kinds"), F.sum("weight").alias("weight"))


PLUGINS = [(0, "tables", "csv"), (1, "any", "csv"), (2, "any", "json"), (3, "data", "json"), (4, "pdf", "pdf")]


@query("""WITH p(position, plugin, ext) AS (VALUES (0, 'tables', 'csv'), (1, 'any', 'csv'), (2, 'any', 'json'), (3, 'data', 'json'), (4, 'pdf', 'pdf')),
    i AS (SELECT o_orderkey AS item_id, ['csv', 'json', 'pdf', 'exe'][o_orderkey % 4 + 1] AS ext FROM orders),
    r AS (SELECT item_id, plugin, row_number() OVER (PARTITION BY item_id ORDER BY position) AS k FROM i JOIN p USING (ext)) SELECT item_id, plugin FROM r WHERE k = 1""")
def plugin_first_wins(spark, sf):
    items = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("item_id"), pick(["csv", "json", "pdf", "exe"], F.col("o_orderkey")).alias("ext"))
    return policy.first_plugin(items, spark.createDataFrame(PLUGINS, "position int, plugin string, ext string"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN 'strip' ELSE ['info', 'strip'][o_orderkey % 3 + 1] END AS action,
    'attachment "outer.pdf" > attachment "inner.pdf"' || CASE WHEN o_orderkey % 2 = 0 THEN ' > page 1' ELSE '' END AS location,
    'outer.pdf > ' || CASE WHEN o_orderkey % 5 = 0 THEN 'unnamed file' ELSE 'inner.pdf' END AS attachment FROM orders""")
def nested_attachment_label(spark, sf):
    key = F.col("o_orderkey")
    rows = read_table(spark, sf, "orders").select("o_orderkey", pick(["info", "strip", "reject"], key).alias("action"), F.when(key % 2 == 0, "page 1").otherwise("").alias("location"), F.lit(None).cast("string").alias("attachment"))
    inner = policy.contained(rows, F.lit('attachment "inner.pdf"'), F.when(key % 5 != 0, "inner.pdf"))
    return policy.contained(inner, F.lit('attachment "outer.pdf"'), F.lit("outer.pdf"))


@query("""WITH RECURSIVE o AS (SELECT n_nationkey AS doc_id, unnest(range(1, 61)) AS num FROM nation),
    e AS (SELECT doc_id, num AS src, unnest([2 * num, 2 * num + 1]) AS dst FROM o WHERE (num * 7 + doc_id) % 5 <> 0),
    r AS (SELECT DISTINCT doc_id, CAST(1 AS BIGINT) AS num FROM o UNION SELECT e.doc_id, e.dst FROM r JOIN e ON e.doc_id = r.doc_id AND e.src = r.num)
    SELECT doc_id, num FROM o WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = o.doc_id AND r.num = o.num)""")
def unreferenced_objects(spark, sf):
    objects = read_table(spark, sf, "nation").select(F.col("n_nationkey").alias("doc_id"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(60).cast("long"))).alias("num"))
    refs = objects.where("(num * 7 + doc_id) % 5 <> 0").select("doc_id", F.col("num").alias("src"), F.explode(F.array(F.col("num") * 2, F.col("num") * 2 + 1)).alias("dst"))
    return graph.unreferenced(objects, objects.where("num = 1"), refs)


# documents synthesised from row keys

LINK = "<< /S /URI /URI ({}) >>"
FILE = ["<< /Type /Filespec /F ({0}) /EF << /F 101 0 R >> >>"]
FEATURES: list[tuple[str, list[tuple[str, str]], dict]] = [
    ("plain", [], {}),
    ("script", [("JAVASCRIPT", "OPEN_ACTION")], {"catalog": "/OpenAction << /S /JavaScript /JS (app.alert\\(1\\)) >>"}),
    ("launch", [("ACTION", "TRIGGERED"), ("ACTION", "LAUNCH")], {"catalog": "/OpenAction << /S /Launch /F (calc.exe) >>"}),
    ("safe link", [("LINK", "SAFE")], {"annots": [builder.link(LINK.format("https://example.com/"))]}),
    ("ip link", [("LINK", "IP_HOST")], {"annots": [builder.link(LINK.format("http://10.0.0.1/"))]}),
    ("mismatch", [("LINK", "TEXT_MISMATCH")], {"annots": [builder.link(LINK.format("https://evil.example/"), extra="/Contents (see www.mybank.com)")]}),
    ("script link", [("JAVASCRIPT", "URL")], {"annots": [builder.link(LINK.format("javascript:x"))]}),
    ("full page", [("LINK", "FULL_PAGE")], {"annots": [builder.link(LINK.format("https://example.com/"), "[0 0 612 792]")]}),
    ("media", [("MEDIA", "MOVIE")], {"annots": ["<< /Type /Annot /Subtype /Movie /Rect [0 0 9 9] >>"]}),
    ("unknown annotation", [("ANNOTATION", "UNKNOWN_SUBTYPE")], {"annots": ["<< /Type /Annot /Subtype /Odd /Rect [0 0 9 9] >>"]}),
    ("page trigger", [("JAVASCRIPT", "PAGE")], {"page": "/AA << /O << /S /JavaScript /JS (2) >> >>"}),
    ("document script", [("JAVASCRIPT", "DOCUMENT")], {"catalog": "/Names << /JavaScript << /Names [(x) << /S /JavaScript /JS (1) >>] >> >>"}),
    ("chain", [("JAVASCRIPT", "CHAINED")], {"annots": [builder.link("<< /S /GoTo /D [10 0 R /Fit] /Next << /S /JavaScript /JS (3) >> >>")]}),
    ("remote", [("ACTION", "REMOTE_GOTO")], {"annots": [builder.link("<< /S /GoToR /F (x.pdf) >>")]}),
    ("csv", [("EMBEDDED_FILE", "PLUGIN_SCRUBBED")], {"catalog": "/Names << /EmbeddedFiles << /Names [(a.csv) 100 0 R] >> >>", "objects": [FILE[0].format("a.csv"), ("/Type /EmbeddedFile", b"=1,2\n")]}),
    ("json", [("EMBEDDED_FILE", "PLUGIN_PASSED")], {"catalog": "/Names << /EmbeddedFiles << /Names [(a.json) 100 0 R] >> >>", "objects": [FILE[0].format("a.json"), ("/Type /EmbeddedFile", b"{}")]}),
    ("broken json", [("EMBEDDED_FILE", "PLUGIN_REMOVED")], {"catalog": "/Names << /EmbeddedFiles << /Names [(a.json) 100 0 R] >> >>", "objects": [FILE[0].format("a.json"), ("/Type /EmbeddedFile", b"{,}")]}),
    ("program", [("EMBEDDED_FILE", "TYPE_MISMATCH"), ("EMBEDDED_FILE", "NO_PLUGIN")], {"catalog": "/Names << /EmbeddedFiles << /Names [(a.png) 100 0 R] >> >>", "objects": [FILE[0].format("a.png"), ("/Type /EmbeddedFile", b"MZ..")]}),
    ("loose", [("STRUCTURE", "UNREFERENCED_OBJECTS")], {"objects": ["<< /Lost true >>"]}),
    ("bookmark", [("JAVASCRIPT", "BOOKMARK")], {"catalog": "/Outlines 100 0 R", "objects": ["<< /Type /Outlines /First 101 0 R /Last 101 0 R >>", "<< /Title (go) /Parent 100 0 R /A << /S /JavaScript /JS (4) >> >>"]}),
    ("escaped", [("JAVASCRIPT", "OPEN_ACTION"), ("STRUCTURE", "ESCAPED_NAMES")], {"catalog": "/OpenAction << /S /J#61vaScript /JS (5) >>"}),
    ("info", [("METADATA", "INFO_DICTIONARY")], {"info": "/Title (x)"}),
    ("portfolio", [("EMBEDDED_FILE", "PORTFOLIO")], {"catalog": "/Collection << /View /D >>"}),
    ("field", [("FORM", "FIELDS"), ("JAVASCRIPT", "FIELD")], {"catalog": "/AcroForm << /Fields [100 0 R] >>", "objects": ["<< /FT /Tx /T (a) /AA << /C << /S /JavaScript /JS (6) >> >> >>"]}),
]
#: Documents that are built at a time.
BUILT = 256
DAMAGES = ["none", "startxref", "header", "leading", "trailing", "length", "update", "stream", "rc4", "locked"]


def synthesised(spark: SparkSession, sf: str, make: Callable[[int, str], bytes]) -> DataFrame:
    """(doc_id, content): a PDF for each document, built on the executors from its key and text."""

    def build(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), BUILT):
                some = batch.iloc[at : at + BUILT]
                yield pd.DataFrame({"doc_id": some["doc_id"], "content": [make(int(k), t or "") for k, t in zip(some["doc_id"], some["text"])]})

    return read_table(spark, sf, "documents").select("doc_id", "text").mapInPandas(build, "doc_id long, content binary")


def featured(key: int, text: str) -> bytes:
    how = FEATURES[key % len(FEATURES)][2]
    return builder.one_page(content=text.encode(), **how).build(trailer="/Info 6 0 R" if "info" in how else "")


def damaged(key: int, text: str) -> bytes:
    made, kind = builder.one_page(content=text.encode()), DAMAGES[key % len(DAMAGES)]
    if kind == "length":
        made.put(5, "<< /Length 3 >>\nstream\n" + "x" * 40 + "\nendstream")
    how = {"startxref": {"startxref": 3}, "header": {"header": False}, "leading": {"leading": b"junk\n"}, "trailing": {"trailing": b"more bytes"}, "stream": {"table": "stream"}, "rc4": {"password": "", "bits": 40 if key % 2 else 128}, "locked": {"password": "secret"}}.get(kind, {})
    out = made.build(**how)
    return builder.updated(out, {5: ("", b"BT ET")}) if kind == "update" else out


def paged(key: int, text: str) -> bytes:
    return builder.one_page(content=text.encode(), pages=1 + key % 7).build(table=("table", "stream")[key % 2])


@query("SELECT doc_id, CAST(1 + doc_id % 7 AS INTEGER) AS pages, false AS incomplete FROM documents")
def pdf_page_count(spark, sf):
    return documents.read_documents(synthesised(spark, sf, paged)).select("doc_id", "pages", "incomplete")


def _features_sql() -> str:
    rows = ", ".join(f"({i}, '{c}', '{d}')" for i, (_, kinds, _) in enumerate(FEATURES) for c, d in kinds)
    return f"(SELECT doc_id, category, detail FROM documents JOIN (VALUES {rows}) AS f(k, category, detail) ON doc_id % {len(FEATURES)} = k)"


@query(f"SELECT category, detail, count(*) AS found FROM {_features_sql()} GROUP BY 1, 2")
def pdf_findings_by_kind(spark, sf):
    _, found = documents.inspect_documents(synthesised(spark, sf, featured))
    return found.groupBy("category", "detail").agg(F.count("*").alias("found"))


_RECOVERY = [("startxref", "CORRUPTED", "XREF_REBUILT"), ("header", "CORRUPTED", "MISSING_HEADER"), ("leading", "CORRUPTED", "LEADING_BYTES"), ("trailing", "CORRUPTED", "TRAILING_BYTES"), ("length", "CORRUPTED", "STREAM_LENGTH_WRONG"), ("update", "STRUCTURE", "INCREMENTAL_UPDATES"), ("rc4", "ENCRYPTED", "EMPTY_PASSWORD"), ("locked", "ENCRYPTED", "PASSWORD_REQUIRED")]


@query(f"""WITH f(k, category, detail) AS (VALUES {", ".join(f"({DAMAGES.index(d)}, '{c}', '{x}')" for d, c, x in _RECOVERY)})
    SELECT doc_id, category, detail FROM documents JOIN f ON doc_id % {len(DAMAGES)} = k
    UNION ALL SELECT doc_id, 'ENCRYPTED', CASE WHEN doc_id % 2 = 1 THEN 'RC4_40' ELSE 'RC4_128' END FROM documents WHERE doc_id % {len(DAMAGES)} = {DAMAGES.index("rc4")}""")
def pdf_recovery(spark, sf):
    return documents.findings_of(documents.read_documents(synthesised(spark, sf, damaged))).select("doc_id", "category", "detail")


def _status_sql() -> str:
    actions = {(c, d): a for c, d, a, _ in finding_rows()}
    out = []
    for _, kinds, _ in FEATURES:
        acts = {actions[k] for k in kinds}
        out.append("defused" if "strip" in acts or any(d == "PLUGIN_SCRUBBED" for _, d in kinds) else "clean")
    return pick_sql(out, "doc_id")


@query(f"SELECT doc_id, {_status_sql()} AS status, true AS released FROM documents")
def pdf_disarm_clean(spark, sf):
    out = documents.disarm_documents(synthesised(spark, sf, featured))
    return out.select("doc_id", "status", F.col("output").isNotNull().alias("released"))


def tabled(key: int, text: str) -> bytes:
    """A document with two attached tables made from its key; one of them has a cell that a spreadsheet would run."""
    first, second = (f"{mark}{key},x\n{key}\n".encode() for mark in (("=", "") if key % 3 else ("", "=")))
    spec = "<< /Type /Filespec /F ({}.csv) /EF << /F {} 0 R >> >>"
    names = "/Names << /EmbeddedFiles << /Names [(a) 100 0 R (b) 101 0 R] >> >>"
    return builder.one_page(names, content=text.encode(), objects=[spec.format("a", 102), spec.format("b", 103), ("/Type /EmbeddedFile", first), ("/Type /EmbeddedFile /Filter /ASCIIHexDecode", second.hex().encode() + b">")]).build()


_TABLE = "sha256(CASE WHEN {} THEN chr(39) || '=' ELSE '' END || doc_id || ',x' || chr(10) || doc_id || chr(10))"


@query(f"""SELECT doc_id, 'a.csv' AS name, {_TABLE.format('doc_id % 3 <> 0')} AS digest FROM documents
    UNION ALL SELECT doc_id, 'b.csv', {_TABLE.format('doc_id % 3 = 0')} FROM documents""")
def pdf_disarm_attachments(spark, sf):
    """The attached files that the copies hold, read back from them."""
    out = documents.disarm_documents(synthesised(spark, sf, tabled)).select("doc_id", F.col("output").alias("content"))
    items = documents.read_documents(out).select("doc_id", F.explode("items").alias("i")).where("i.category = 'EMBEDDED_FILE' and i.detail = ''")
    return items.select("doc_id", F.col("i.value").alias("name"), F.sha2("i.content", 256).alias("digest"))


def linking(key: int, text: str) -> bytes:
    return builder.one_page(content=text.encode(), annots=[builder.link(f"<< /S /URI /URI (https://h{(key + k * k) % 29}.example.com/) >>") for k in range(key % 31)]).build()


@query("""WITH l AS (SELECT doc_id, unnest(range(doc_id % 31)) AS k FROM documents), h AS (SELECT doc_id, k, 'h' || (doc_id + k * k) % 29 || '.example.com' AS host FROM l),
    f AS (SELECT doc_id, host, min(k) AS k, count(*) AS n FROM h GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS pos FROM f)
    SELECT doc_id, CAST(sum(n) AS BIGINT) AS count, string_agg(host, ', ' ORDER BY k) FILTER (pos <= 20) AS hosts FROM r GROUP BY doc_id""")
def pdf_links_counted(spark, sf):
    """The one finding that a report holds for all kept links of a document."""
    _, found = documents.inspect_documents(synthesised(spark, sf, linking))
    return found.where("detail = 'SAFE'").select("doc_id", "count", F.col("value").alias("hosts"))


def launching(key: int, text: str) -> bytes:
    return builder.one_page(content=text.encode(), annots=[builder.link("<< /S /Launch >>")] * (195 + key % 11)).build()


@query("""WITH n AS (SELECT doc_id, 195 + doc_id % 11 AS n FROM documents)
    SELECT doc_id, CAST(least(n, 200) AS BIGINT) AS told, CAST(greatest(n - 200, 0) AS BIGINT) AS more FROM n""")
def pdf_findings_capped(spark, sf):
    _, found = documents.inspect_documents(synthesised(spark, sf, launching))
    return found.groupBy("doc_id").agg(F.count(F.when(F.col("count").isNull(), 1)).alias("told"), F.coalesce(F.sum("count"), F.lit(0)).alias("more"))


def nesting(key: int, text: str) -> bytes:
    """A document in a document, as often as its key says; the innermost holds a script."""
    made = builder.one_page("/OpenAction << /S /JavaScript /JS (1) >>", content=text.encode()).build()
    for k in range(key % 4):
        made = builder.one_page(f"/Names << /EmbeddedFiles << /Names [(d{k}) 100 0 R] >> >>", objects=[FILE[0].format(f"d{k}.pdf"), ("/Type /EmbeddedFile", made)]).build()
    return made


@query("""WITH k AS (SELECT doc_id, doc_id % 4 AS n FROM documents), d AS (SELECT doc_id, n, unnest(range(n + 1)) AS level FROM k)
    SELECT doc_id, CASE WHEN level = n THEN 'JAVASCRIPT' ELSE 'EMBEDDED_FILE' END AS category, CASE WHEN level = n THEN 'OPEN_ACTION' ELSE 'PLUGIN_SCRUBBED' END AS detail,
    array_to_string(list_transform(range(level), lambda k: 'd' || (n - 1 - k) || '.pdf'), ' > ') AS attachment FROM d""")
def pdf_nested(spark, sf):
    """What documents inside documents hold, as the uploaded one reports it."""
    _, found = documents.inspect_documents(synthesised(spark, sf, nesting), files=(plugins.PDF,))
    return found.select("doc_id", "category", "detail", F.coalesce("attachment", F.lit("")).alias("attachment"))


def scripted(key: int, text: str) -> bytes:
    return builder.one_page(f"/OpenAction << /S /JavaScript /JS ({('keep', 'drop', 'swap')[key % 3]} {key}) >>", content=text.encode()).build()


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'clean' ELSE 'defused' END AS status, CASE doc_id % 3 WHEN 0 THEN 'keep ' || doc_id WHEN 2 THEN 'kept ' || doc_id END AS script FROM documents""")
def pdf_script_plugins(spark, sf):
    """The scripts that a plugin keeps, drops or rewrites, read back from the copies."""

    def process(text, _):
        return "passed" if text.startswith("keep") else "removed" if text.startswith("drop") else ("scrubbed", text.replace("swap", "kept"), [])

    own = plugins.ScriptPlugin("own", lambda text, location: F.lit(True), process)
    done = documents.disarm_documents(synthesised(spark, sf, scripted), scripts=(own,))
    again = documents.read_documents(done.select("doc_id", F.col("output").alias("content"))).select("doc_id", F.filter("items", lambda i: i["category"] == "JAVASCRIPT").alias("i"))
    return done.select("doc_id", "status").join(again, "doc_id").select("doc_id", "status", F.get("i", 0)["content"].cast("string").alias("script"))


def signed(key: int, text: str) -> bytes:
    """A signature over the whole file, or for some keys over less of it."""
    made = builder.one_page("/AcroForm << /Fields [100 0 R] >>", content=text.encode(), objects=["<< /FT /Sig /T (s) /V 101 0 R >>", "<< /Type /Sig /ByteRange [0 00000000 00000000 00000000] /Contents <" + "00" * 8 + "> >>"]).build()
    gap = made.rindex(b"/Contents <0") + 10
    return made.replace(b"[0 00000000 00000000 00000000]", b"[0 %08d %08d %08d]" % (gap, gap + 18, len(made) - gap - 18 - (key % 4 == 3)))


@query("SELECT doc_id, doc_id % 4 <> 3 AS kept FROM documents")
def pdf_signed_kept(spark, sf):
    """Whether a signed document is handed out byte for byte."""
    docs = synthesised(spark, sf, signed)
    out = documents.disarm_documents(docs).select("doc_id", F.md5("output").alias("after"))
    return docs.select("doc_id", F.md5("content").alias("before")).join(out, "doc_id").select("doc_id", (F.col("before") == F.col("after")).alias("kept"))


def alternative(key: int, text: str) -> bytes:
    tree = f"/StructTreeRoot << /Type /StructTreeRoot /K << /S /Link /Alt (go to h{key % 5}.example.org) /K << /S /Span /K [<< /Type /OBJR /Obj 100 0 R >>] >> >> >>"
    return builder.one_page(tree, page="/Annots [100 0 R]", content=text.encode(), objects=[f"<< /Type /Annot /Subtype /Link /Rect [0 0 9 9] /A << /S /URI /URI (https://h{key % 7}.example.org/) >> >>"]).build()


@query("SELECT doc_id, CASE WHEN doc_id % 5 = doc_id % 7 THEN 'SAFE' ELSE 'TEXT_MISMATCH' END AS detail FROM documents")
def pdf_alternative_texts(spark, sf):
    """Links held against the alternative text of the structure element above them."""
    _, found = documents.inspect_documents(synthesised(spark, sf, alternative))
    return found.where("category = 'LINK'").select("doc_id", "detail")


@query(f"""WITH f AS (SELECT doc_id, f.category, f.detail, action, weight FROM {_features_sql()} AS f JOIN {_SPEC} ON f.category = spec.category AND f.detail = spec.detail),
    k AS (SELECT doc_id, category, detail, max(weight) AS weight FROM f GROUP BY 1, 2, 3),
    h AS (SELECT doc_id, max(weight) + (sum(weight) - max(weight)) / 4.0 + CASE WHEN bool_or(detail = 'TRIGGERED') AND bool_or(detail = 'LAUNCH') THEN 20 ELSE 0 END
    + CASE WHEN bool_or(category = 'JAVASCRIPT') AND bool_or(detail = 'ESCAPED_NAMES') THEN 20 ELSE 0 END AS total FROM k GROUP BY doc_id),
    i AS (SELECT d.doc_id, d.source, CAST(least(100, round(coalesce(total, 0))) AS INTEGER) AS score FROM documents AS d LEFT JOIN h USING (doc_id)),
    b AS (SELECT source, score, {_BAND} AS risk FROM i)
    SELECT source, risk, count(*) AS documents, CAST(sum(score) AS BIGINT) AS score FROM b GROUP BY 1, 2""")
def corpus_risk_summary(spark, sf):
    told, _ = documents.inspect_documents(synthesised(spark, sf, featured))
    sources = read_table(spark, sf, "documents").select("doc_id", "source")
    return told.join(sources, "doc_id").groupBy("source", "risk").agg(F.count("*").alias("documents"), F.sum("score").alias("score"))


FORM_KEYS = 5
#: Characters that XML forbids, even as references.
_NO_XML = re.compile("[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")


def formed(key: int, text: str) -> bytes:
    """A form in two packets whose parts the key counts; the whole text stands between as plain data."""
    n = key % FORM_KEYS
    some = {
        "script": '<event activity="click"><script contentType="application/x-javascript">a &lt; b &amp;&amp; c</script></event>' * n, "submit": '<submit target="https://example.com/f"/>' * (n // 2),
        "link": '<a href="https://example.com/?a&b=1">x</a>' * (n % 2), "href": '<image href="//server/x.png"/><image href="a.png"/>' * (n % 3), "execute": '<execute connection="c"/>' * (key % 2),
    }
    form = f'<template><subform name="top"><field name="f">{"".join(some.values())}</field></subform></template>'
    data = escape(_NO_XML.sub("", text), {"\r": "&#13;"})
    tail = f"<datasets><v>{data}</v></datasets><config><uri>{'x' * (key % 2)}</uri></config>" + "<xfdf/>" * (key % 3) + "</xdp:xdp>"
    head = f'<xdp:xdp xmlns:xdp="urn:x">{form}'
    return builder.one_page(catalog="/AcroForm << /Fields [] /XFA [(a) 100 0 R (b) 101 0 R] >>", objects=[("", head.encode()), ("", tail.encode())]).build()


@query(f"""WITH k AS (SELECT doc_id, doc_id % {FORM_KEYS} AS n FROM documents), f AS (SELECT doc_id, unnest([
    {{'category': 'FORM', 'detail': 'FIELDS', 'found': 0}}, {{'category': 'FORM', 'detail': 'XFA', 'found': 1}}, {{'category': 'JAVASCRIPT', 'detail': 'XFA', 'found': n}}, {{'category': 'ACTION', 'detail': 'SUBMIT_FORM', 'found': n // 2}},
    {{'category': 'LINK', 'detail': 'SAFE', 'found': n % 2}}, {{'category': 'FORM', 'detail': 'XFA_EXTERNAL_REFERENCE', 'found': n % 3 + doc_id % 2}}, {{'category': 'FORM', 'detail': 'XFA_EXECUTE', 'found': doc_id % 2}},
    {{'category': 'FORM', 'detail': 'XFA_PACKET', 'found': doc_id % 3}}]) AS r FROM k) SELECT doc_id, r.category AS category, r.detail AS detail, CAST(r.found AS BIGINT) AS found FROM f WHERE r.found > 0""")
def xfa_plan_counts(spark, sf):
    found = documents.findings_of(documents.read_documents(synthesised(spark, sf, formed)))
    return found.groupBy("doc_id", "category", "detail").agg(F.count("*").alias("found"))


_PACKED = [("a.csv", b"=1,2\n", "PLUGIN_SCRUBBED"), ("a.csv", b"1,2\n", "PLUGIN_PASSED"), ("a.csv", b'"open', "PLUGIN_REMOVED"), ("a.tsv", b"x\t@y\n", "PLUGIN_SCRUBBED"), ("a.json", b"[1]", "PLUGIN_PASSED"), ("a.json", b"[1", "PLUGIN_REMOVED"), ("a.bin", b"x", "NO_PLUGIN")]


def carrying(key: int, text: str) -> bytes:
    name, body, _ = _PACKED[key % len(_PACKED)]
    return builder.one_page(content=text.encode(), catalog=f"/Names << /EmbeddedFiles << /Names [({name}) 100 0 R] >> >>", objects=[FILE[0].format(name), ("/Type /EmbeddedFile", body)]).build()


@query(f"SELECT doc_id, {pick_sql([x[2] for x in _PACKED], 'doc_id')} AS detail FROM documents")
def pdf_attachment_plugins(spark, sf):
    found = documents.findings_of(documents.read_documents(synthesised(spark, sf, carrying)))
    return found.where("category = 'EMBEDDED_FILE'").select("doc_id", "detail")


def measured(key: int, text: str) -> bytes:
    """Page content as a plain stream, whose length is the text's."""
    made = builder.one_page()
    made.put(5, ("", text.encode()))
    return made.build(table=("table", "stream")[key % 2])


@query("SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS content_length FROM documents")
def pdf_content_length(spark, sf):
    return documents.read_documents(synthesised(spark, sf, measured)).select("doc_id", F.element_at("lengths", 1).alias("content_length"))


_PAIRS = [("JAVASCRIPT", "OPEN_ACTION", 0), ("ACTION", "LAUNCH", 1), ("STRUCTURE", "ESCAPED_NAMES", 2), ("EMBEDDED_FILE", "NO_PLUGIN", 3), ("ENCRYPTED", "EMPTY_PASSWORD", 4)]
_FLAGS = ", ".join(f"(c_custkey >> {bit}) & 1 AS b{bit}" for *_, bit in _PAIRS)


@query(f"""WITH b AS (SELECT c_custkey AS doc_id, {_FLAGS} FROM customer WHERE c_custkey % 32 <> 0)
    SELECT doc_id, CAST(20 * b0 * b1 + 20 * b0 * b2 + 15 * b0 * b3 + 10 * b0 * b4 AS INTEGER) AS bonus FROM b""")
def combination_bonus(spark, sf):
    bits = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(d).alias("detail"), F.lit(b).alias("bit")) for c, d, b in _PAIRS])
    rows = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.explode(bits).alias("k"))
    held = rows.where(F.getbit(F.col("doc_id"), F.col("k.bit")) == 1)
    return policy.bonuses(held.select("doc_id", "k.category", "k.detail"))


#: Units behind a number, and the power of 1024 that each is; null for none.
UNITS = [("", 0), ("b", 0), ("k", 1), (" KB ", 1), (".5m", 2), ("mb", 2), ("G", 3), ("x", None), (".5.2k", None)]


@query(f"""WITH u AS (SELECT doc_id, CAST(doc_id % 1000 AS VARCHAR) || {pick_sql([u for u, _ in UNITS], 'doc_id')} AS t FROM documents),
    p AS (SELECT doc_id, regexp_extract(t, '^([0-9]+([.][0-9]+)?) *([kKmMgG]?)[bB]? *$', ['number', 'part', 'unit']) AS m FROM u)
    SELECT doc_id, CASE WHEN m.number <> '' THEN CAST(floor(TRY_CAST(m.number AS DOUBLE) * CASE lower(m.unit) WHEN 'k' THEN 1024 WHEN 'm' THEN 1048576 WHEN 'g' THEN 1073741824 ELSE 1 END) AS BIGINT) END AS bytes FROM p""")
def size_option(spark, sf):
    text = F.concat((F.col("doc_id") % 1000).cast("string"), pick([u for u, _ in UNITS], F.col("doc_id")))
    return read_table(spark, sf, "documents").select("doc_id", files.size_in_bytes(text).alias("bytes"))
