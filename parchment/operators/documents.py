"""Documents through the kernel: bytes to items, items to findings, findings to a cleaned copy and its own inspection.

The kernel runs once a row in Arrow batches. What it cannot decide alone (links, labels, attached files, scripts) comes
back as items, is decided by Column expressions, plugins and joins, and goes to the second run as slots to remove and
bodies to put in place of others. The second run inspects what it wrote in the same task, so a copy is read where it
lies. Documents inside documents are taken level by level.

doc_id names a document: it is not null and does not repeat.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.functions import links, sniffing
from parchment.functions.links import let
from parchment.operators import plugins as plug
from parchment.operators import policy
from parchment.operators.plugins import FilePlugin, ScriptPlugin
from parchment.session import ensure_checkpoint_dir, prepare, stored
from parchment.sources.pdf.inspect import Limits, Report, inspect
from parchment.sources.pdf.walk import Item

ITEM = "ordinal int, category string, detail string, location string, slot string, value string, label string, content binary, other string, forced boolean, nth int"
ITEMS = f"array<struct<{', '.join(':'.join(x.split()) for x in ITEM.split(', '))}>>"
SCHEMA = f"doc_id {{id}}, version string, pages int, incomplete boolean, lengths array<bigint>, signed boolean, alone boolean, items {ITEMS}"
WRITTEN = ", output binary, after_version string, after_pages int, after_incomplete boolean, after_lengths array<bigint>, after_items " + ITEMS
#: Documents that the kernel holds at a time, small sides that are broadcast (bytes), levels of documents in documents.
BATCH, BROADCAST_BYTES, DEEPEST = 16, 64 << 20, 64


#: Kinds of items that are decided outside, or hang on other findings.
OPEN = frozenset((("LINK", ""), ("LINK", "LABEL"), ("EMBEDDED_FILE", ""), ("EMBEDDED_FILE", "NAME"), ("FORM", ""), ("FORM", "IMAGE"), ("FORM", "ORDER"), ("PROCESSING", "LOST")))
_FIELDS = [("ordinal", pa.int32()), *[(k, pa.string()) for k in Item._fields[1:7]], ("content", pa.binary()), ("other", pa.string()), ("forced", pa.bool_()), ("nth", pa.int32())]


def _text() -> Column:
    return F.lit(None).cast("string")


def _listed(reports: Sequence[Report]) -> tuple[pa.Array, pa.Array]:
    """The items of each report, field by field with their place among those of their kind; and which reports are alone."""
    ends, nths, alone = [0], [], []
    for r in reports:
        seen: dict[tuple[str, str], int] = {}
        for i in r.items:
            kind = i[1:3]
            seen[kind] = n = seen.get(kind, 0) + 1
            nths.append(n)
        ends.append(len(nths))
        alone.append(OPEN.isdisjoint(seen))
    columns = [*([*zip(*(i for r in reports for i in r.items))] or [()] * len(Item._fields)), nths]
    items = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS)], [k for k, _ in _FIELDS])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items), pa.array(alone, pa.bool_())


def _run(docs: DataFrame, write: bool, passwords: list[str] | None, limits: Limits, strip_metadata: bool) -> DataFrame:
    """The kernel over (doc_id, content), or with write over (doc_id, content, slots, bodies), whose copies it inspects."""
    prepare(docs.sparkSession)
    names = [x.split()[0] for x in (SCHEMA + WRITTEN * write).split(", ") if ":" not in x.split()[0]]

    def told(reports: list[Report]) -> list[pa.Array]:
        one = lambda name, t: pa.array([getattr(r, name) for r in reports], t)
        return [one("version", pa.string()), one("pages", pa.int32()), one("incomplete", pa.bool_()), one("lengths", pa.list_(pa.int64()))]

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                content = part["content"].to_pylist()
                slots = part["slots"].to_pylist() if write else [None] * len(content)
                bodies = part["bodies"].to_pylist() if write else [None] * len(content)
                first = [inspect(c, passwords, limits, None if s is None else frozenset(s), strip_metadata, None if b is None else {x["slot"]: x["body"] for x in b}) for c, s, b in zip(content, slots, bodies)]
                items, alone = _listed(first)
                out = [part["doc_id"], *told(first), pa.array([r.signed for r in first], pa.bool_()), alone, items]
                if write:
                    again = [inspect(r.output, None, Limits(decompressed=limits.decompressed, seconds=limits.seconds)) if r.output is not None else Report("", 0, True, [], [], False, None) for r in first]
                    out += [pa.array([r.output for r in first], pa.binary()), *told(again), _listed(again)[0]]
                yield pa.RecordBatch.from_arrays(out, names)

    columns = ["doc_id", "content", *(["slots", "bodies"] if write else [])]
    return docs.select(*columns).mapInArrow(kernel, (SCHEMA + WRITTEN * write).format(id=docs.schema["doc_id"].dataType.simpleString()))


def read_documents(docs: DataFrame, passwords: list[str] | None = None, limits: Limits = Limits(), strip_metadata: bool = False) -> DataFrame:
    """doc_id, version, pages, incomplete, lengths, signed, alone, items for each row of docs (doc_id, content).

    alone: none of the items is decided outside. nth of an item: its place among those of its kind in the document."""
    return _run(docs, False, passwords, limits, strip_metadata)


def _both_readings(first: Column, second: Column) -> Column:
    """Every reading of an address has to pass; a relative one does not end the check."""
    passes = lambda v: v["detail"].isin("SAFE", "RELATIVE")
    keeps = second.isNull() | ~passes(first) | ((second["detail"] == "SAFE") & (first["detail"] == "RELATIVE"))
    return F.when(keeps, first).otherwise(second)


def _misled(value: Column, label: Column, base: Column | None) -> Column:
    """Whether one of the labels (joined by NUL) names hosts of which none is that of a safe address (joined by NUL)."""
    hosts = F.transform(F.split(value, "\\x00"), lambda u: let(links.link_verdict(u, base), lambda v: F.when(v["detail"] == "SAFE", v["host"])))
    hosts = F.filter(hosts, lambda h: h.isNotNull())
    return let(hosts, lambda own: F.exists(F.split(label, "\\x00"), lambda t: let(links.hosts_in(t), lambda named: (F.size(named) > 0) & F.exists(own, lambda h: ~links.label_fits(h, named)))))


def findings_of(read: DataFrame, base: str | None = None, files: Sequence[FilePlugin] = plug.DEFAULT, scripts: Sequence[ScriptPlugin] = (), kept: DataFrame | None = None, nested: DataFrame | None = None, depth: int = 0) -> DataFrame:
    """What read_documents' items say, a row each: doc_id, ordinal, category, detail, location, slot, value, host,
    plugin, action, weight, attachment, body, forced.

    Links get the verdict on every reading, labels are held against them, files get a type check and their plugin's
    answer, and so do scripts and pictures of forms. kept (doc_id, md5, result): what a first run kept, as its copy is
    expected to hold it, is not asked about again. nested (doc_id, slot, result, output, told): the answers of the
    engine's own run on documents inside documents. An item is read once, and a plugin is handed only its own.
    """
    rows = read.select("doc_id", F.explode("items").alias("i")).select("doc_id", "i.*")
    is_a = lambda category, detail: (F.col("category") == category) & (F.col("detail") == detail)
    link, label, file, name, picture = (is_a(*k) for k in (("LINK", ""), ("LINK", "LABEL"), ("EMBEDDED_FILE", ""), ("EMBEDDED_FILE", "NAME"), ("FORM", "IMAGE")))
    href, script = is_a("FORM", ""), (F.col("category") == "JAVASCRIPT") & F.col("content").isNotNull()
    origin = F.lit(base) if base else None
    second = F.when(link & (F.col("other") != ""), links.link_verdict(F.col("other"), origin))
    rows = rows.withColumns({"v": F.when(link, links.link_verdict(F.col("value"), origin)), "v2": second, "sniffed": F.when(file | name | picture, sniffing.sniff_type(F.col("content")))})
    given = F.when(F.col("label") != "", F.col("label"))
    named = F.when(name, F.col("other")).when(file | (picture & (F.col("value") != "")), F.col("value"))
    rows = rows.withColumns({
        "v": _both_readings(F.col("v"), F.col("v2")), "misled": F.when(label, _misled(F.col("value"), F.col("label"), origin)),
        "odd": F.when(file | name, sniffing.types_disagree(given, F.col("value"), F.col("sniffed"))),
        "choice": F.when(file | name | picture, plug.first_of([p.accepts(named, given, F.col("sniffed")) for p in files])) if files else F.lit(None).cast("int"),
        "asked": F.when(script, plug.first_of([p.accepts(F.col("content").cast("string"), F.col("location")) for p in scripts])) if scripts else F.lit(None).cast("int"),
    })
    known = F.lit(None).cast("string")
    if kept is not None:
        rows = rows.withColumn("md5", F.when(file | picture | script, F.md5("content"))).join(kept.select("doc_id", "md5", F.col("result").alias("known")), ["doc_id", "md5"], "left")
        known = F.col("known")
    about = {"name": F.coalesce(F.col("value"), F.lit("")), "declared": F.col("label"), "sniffed": F.coalesce("sniffed", F.lit("")), "location": F.col("location")}
    ran = [F.struct(known.alias("result"), F.lit(None).cast("binary").alias("output"), F.array().cast(plug.TOLD).alias("told"))]
    guard = [known.isNotNull()]
    for k, p in enumerate(files):
        if p.process is not None:
            own = (file | picture) & (F.col("choice") == k) & known.isNull()
            ran.append(plug.answers(p.process, F.when(own, F.col("content")), about, depth + 1))
            guard.append(own)
    for k, p in enumerate(scripts):
        own = script & (F.col("asked") == k) & known.isNull()
        ran.append(plug.answers(p.process, F.when(own, F.col("content")), about, depth + 1, text=True))
        guard.append(own)
    # each answer in a column of its own, so that a UDF runs once
    rows = rows.withColumns({f"ran{k}": r for k, r in enumerate(ran)})
    answer = F.coalesce(*[F.when(g, F.col(f"ran{k}")) for k, g in enumerate(guard)])
    if nested is not None:
        told = nested.select("doc_id", "slot", F.struct("result", "output", F.col("told").cast(plug.TOLD).alias("told")).alias("inner"))
        rows = rows.join(told, ["doc_id", "slot"], "left")
        answer = F.coalesce(answer, F.when(file, F.col("inner")))
    rows = rows.withColumn("answer", answer)
    a, none = F.col("answer"), F.lit(None).cast("binary")

    def one(category, detail, slot="slot", body=none, forced=None, host=_text()) -> Column:
        detail = F.lit(detail) if isinstance(detail, str) else detail
        return F.struct(
            F.lit(category).alias("category"), detail.alias("detail"), (F.col(slot) if slot else F.lit("")).alias("slot"), F.col("location").alias("location"), host.alias("host"), F.lit(False).alias("plugin"), _text().alias("action"),
            F.lit(None).cast("int").alias("weight"), _text().alias("attachment"), body.alias("body"), (F.col("forced") if forced is None else forced).alias("forced"),
        )

    def inside(title: Column) -> Column:
        """What a plugin found, as the document that holds the item reports it."""
        return F.transform(a["told"], lambda t: F.struct(
            t["category"].alias("category"), t["detail"].alias("detail"), F.lit("").alias("slot"), F.concat_ws(" > ", "location", F.when(t["location"] != "", t["location"])).alias("location"), _text().alias("host"), F.lit(True).alias("plugin"),
            F.when(t["action"] == "reject", "strip").otherwise(t["action"]).alias("action"), t["weight"].alias("weight"), F.concat_ws(" > ", title, F.when(t["attachment"] != "", t["attachment"])).alias("attachment"), none.alias("body"), F.lit(False).alias("forced"),
        ))

    def answered(category: str, without: Column) -> Column:
        kinds = F.when(a["result"] == "passed", "PLUGIN_PASSED").when(a["result"] == "scrubbed", "PLUGIN_SCRUBBED").when(a["result"] == "removed", "PLUGIN_REMOVED").otherwise("PLUGIN_FAILED")
        stays = a["result"].isin("passed", "scrubbed")
        return F.when(a["result"].isNull(), without).otherwise(F.array(one(category, kinds, body=F.when(stays, a["output"]), forced=~stays)))

    plain = F.array(F.struct("category", "detail", "slot", "location", _text().alias("host"), F.lit(False).alias("plugin"), _text().alias("action"), F.lit(None).cast("int").alias("weight"), _text().alias("attachment"), none.alias("body"), "forced"))
    nothing = F.slice(plain, 1, 0)
    linked = F.when(F.col("v.detail") == "URL", F.array(one("JAVASCRIPT", "URL"))).otherwise(F.array(one("LINK", F.col("v.detail"), host=F.col("v.host"))))
    mismatch = F.when(F.col("odd"), F.array(one("EMBEDDED_FILE", "TYPE_MISMATCH"))).otherwise(nothing)
    title = F.when(F.coalesce(F.col("value"), F.lit("")) == "", F.lit("unnamed file")).otherwise(F.col("value"))
    attached = F.concat(mismatch, answered("EMBEDDED_FILE", F.array(one("EMBEDDED_FILE", "NO_PLUGIN"))), F.coalesce(inside(title), nothing))
    taken = F.lit(False)
    for k, p in enumerate(files):
        taken = F.when(F.col("choice") == k, F.coalesce(p.accepts(F.col("value"), given, F.col("sniffed")), F.lit(False))).otherwise(taken)
    renamed = F.concat(mismatch, F.when(F.col("choice").isNotNull() & ~taken, F.array(one("EMBEDDED_FILE", "NO_PLUGIN"))).otherwise(nothing))
    shown = F.concat(answered("FORM", F.array(one("FORM", "XFA_IMAGE"))), F.coalesce(inside(F.lit("XFA image")), nothing))
    ran_script = F.concat(F.when(a["result"] == "failed", plain).otherwise(nothing), answered("JAVASCRIPT", plain), F.coalesce(inside(_text()), nothing))
    target = links.trimmed(F.col("value"))
    outside = target.rlike(r"^([a-zA-Z][a-zA-Z0-9+.-]*:|[/\\])") | links.path_trick(target, separator=True).isNotNull()
    out = F.when(link, linked).when(label, F.when(F.col("misled"), F.array(one("LINK", "TEXT_MISMATCH"))).otherwise(nothing)).when(file, attached).when(name, renamed).when(picture, shown)
    out = out.when(href, F.when(outside, F.array(one("FORM", "XFA_EXTERNAL_REFERENCE"))).otherwise(nothing)).when(script & a.isNotNull(), ran_script).otherwise(plain)
    return rows.select("doc_id", "ordinal", "value", F.col("content").alias("__content"), F.explode(out).alias("t")).select("doc_id", "ordinal", "t.category", "t.detail", "t.location", "t.slot", "value", "t.host", "t.plugin", "t.action", "t.weight", "t.attachment", "t.body", "t.forced", F.when(F.col("t.detail").isin("PLUGIN_PASSED", "PLUGIN_SCRUBBED"), F.md5(F.coalesce("t.body", "__content"))).alias("md5"))


def _findings_alone(read: DataFrame) -> DataFrame:
    """findings_of for documents whose items are findings as they stand; with nth, their place among those of a kind."""
    none = {"host": _text(), "plugin": F.lit(False), "action": _text(), "weight": F.lit(None).cast("int"), "attachment": _text(), "body": F.lit(None).cast("binary"), "md5": _text()}
    rows = read.select("doc_id", F.explode("items").alias("i"))
    own = [F.col(f"i.{k}").alias(k) for k in ("ordinal", "category", "detail", "location", "slot", "value", "forced")]
    return rows.select("doc_id", *own, *[v.alias(k) for k, v in none.items()], F.coalesce("i.nth", F.lit(0)).alias("nth"))


def _acted(findings: DataFrame, overrides: DataFrame | None) -> DataFrame:
    acted = policy.with_actions(findings, overrides)
    return acted.withColumn("action", F.when(F.col("forced") & (F.col("action") == "info"), "strip").otherwise(F.col("action")))


def _settled(df: DataFrame) -> DataFrame:
    """Checkpointed: the kernel runs once for all that is asked of its rows, and once only if an executor is lost."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def _resolved(findings: DataFrame, overrides: DataFrame | None) -> DataFrame:
    """findings_of's rows with actions, and those that hang on others: a link inside what goes is not a kept one, a
    calculation order goes with the last of its scripts, and a loss counts that nothing else tells of."""
    acted = _settled(_acted(findings, overrides))
    root = F.regexp_extract("slot", r"^[^/\[#!]*", 0)
    gone = acted.where("action = 'strip' and slot <> ''").select("doc_id", "slot").distinct()
    above = gone.select("doc_id", root.alias("root"), F.regexp_replace("slot", "(#label|!trigger|!media)$", "").alias("above"))
    safe = (F.col("category") == "LINK") & (F.col("detail") == "SAFE")
    inside = (F.col("slot") == F.col("above")) | F.col("slot").startswith(F.concat("above", F.lit("/"))) | F.col("slot").startswith(F.concat("above", F.lit("[")))
    lost_links = acted.where(safe).select("doc_id", "slot", root.alias("root")).join(above, ["doc_id", "root"]).where(inside).select("doc_id", "slot", F.lit("SAFE").alias("detail")).distinct()
    out = acted.join(lost_links, ["doc_id", "slot", "detail"], "left_anti")
    hanging = (F.col("detail") == "ORDER") & (F.col("category") == "FORM") | (F.col("detail") == "LOST") & (F.col("category") == "PROCESSING")
    if acted.where(hanging).isEmpty():
        return out
    orders = acted.where("category = 'FORM' and detail = 'ORDER'").select("doc_id", "ordinal", "slot", "location", F.explode(F.split("value", "\\x00")).alias("script"))
    orders = orders.join(gone.select("doc_id", F.col("slot").alias("script"), F.lit(1).alias("gone")), ["doc_id", "script"], "left")
    orders = orders.groupBy("doc_id", "ordinal", "slot", "location").agg(F.count("*").alias("n"), F.count("gone").alias("gone")).where("n = gone")
    extra = orders.select("doc_id", "ordinal", F.lit("FORM").alias("category"), F.lit("CALCULATION_ORDER").alias("detail"), "location", "slot")
    busy = acted.where("action <> 'info' or detail in ('PLUGIN_SCRUBBED', 'STRIPPED')").select("doc_id").distinct()
    lost = acted.where("category = 'PROCESSING' and detail = 'LOST'").join(busy, "doc_id", "left_anti")
    extra = extra.unionByName(lost.select("doc_id", "ordinal", "category", F.lit("CONTENT_REMOVED").alias("detail"), "location", "slot"))
    extra = policy.with_actions(extra, overrides).withColumn("action", F.when((F.col("detail") == "CONTENT_REMOVED") & (F.col("action") == "info"), "strip").otherwise(F.col("action")))
    return _settled(out.where(~hanging).unionByName(extra, allowMissingColumns=True))


def _nested(read: DataFrame, files: Sequence[FilePlugin], how: dict, depth: int) -> DataFrame | None:
    """The engine's own run on documents inside documents, a level down: (doc_id, slot, result, output, told, deep)."""
    own = next((k for k, p in enumerate(files) if p.process is None), None)
    if own is None:
        return None
    items = read.select("doc_id", F.explode("items").alias("i")).where("i.category = 'EMBEDDED_FILE' and i.detail = ''").select("doc_id", "i.*")
    given, sniffed = F.when(F.col("label") != "", F.col("label")), sniffing.sniff_type(F.col("content"))
    inner = items.where(plug.first_of([p.accepts(F.col("value"), given, sniffed) for p in files]) == own)
    inner = _settled(inner.select(F.struct("doc_id", "slot").alias("doc_id"), "content"))
    if inner.isEmpty():
        return None
    limits: Limits = how.get("limits", Limits())
    if depth + 1 > (DEEPEST if limits.nesting is None else limits.nesting):
        return inner.select("doc_id.*", _text().alias("result"), F.lit(None).cast("binary").alias("output"), F.array().cast(plug.TOLD).alias("told"), F.lit(True).alias("deep"))
    done, findings, below = _disarmed(inner, files=files, depth=depth + 1, **{k: v for k, v in how.items() if k not in ("files", "depth")})
    weighed = policy.with_weights(findings, how.get("weights"))
    told = weighed.groupBy("doc_id").agg(F.collect_list(F.struct("category", "detail", "action", F.col("weight").cast("int").alias("weight"), F.coalesce("location", F.lit("")).alias("location"), F.coalesce("attachment", F.lit("")).alias("attachment"))).alias("told"))
    result = F.when(F.col("status") == "clean", "passed").when(F.col("status") == "defused", "scrubbed").otherwise("removed")
    out = done.join(told, "doc_id", "left").select("doc_id.*", result.alias("result"), "output", F.coalesce("told", F.array().cast(plug.TOLD)).alias("told"), F.lit(False).alias("deep"))
    if below is not None:  # a level that lies too deep stops the whole upload
        out = out.join(below.select("doc_id.*").withColumn("too_deep", F.lit(True)), ["doc_id", "slot"], "left").withColumn("deep", F.coalesce("too_deep", F.lit(False))).drop("too_deep")
    return _settled(out)


def _deep(nested: DataFrame | None) -> DataFrame | None:
    return None if nested is None else nested.where("deep").select("doc_id").distinct()


def _inspected(docs: DataFrame, overrides, weights, files, scripts, base, how: dict, depth: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """(read, findings, inspections, documents that hold one too deep)."""
    read = stored(read_documents(docs, **{k: v for k, v in how.items() if k in ("passwords", "limits", "strip_metadata")}))
    # documents alone have a plan without joins, plugins and shuffles; scripts are asked about wherever they are
    open_ones, alone = (read, None) if scripts else (read.where("not alone"), read.where("alone"))
    nested = _nested(read, files, how | {"overrides": overrides, "weights": weights, "scripts": scripts, "base": base}, depth)
    findings = _resolved(findings_of(open_ones, base, files, scripts, None, nested, depth), overrides)
    if alone is not None:
        findings = findings.unionByName(_acted(_findings_alone(alone), overrides), allowMissingColumns=True)
    deep = _deep(nested)
    if deep is not None:
        limit = deep.select("doc_id", F.lit(1 << 30).alias("ordinal"), F.lit("LIMIT").alias("category"), F.lit("NESTING_DEPTH").alias("detail"), F.lit("").alias("location"), F.lit("").alias("slot"))
        findings = findings.unionByName(policy.with_actions(limit, overrides), allowMissingColumns=True)
        read = read.join(deep.withColumn("deep", F.lit(True)), "doc_id", "left").withColumn("incomplete", F.col("incomplete") | F.coalesce("deep", F.lit(False))).drop("deep")
    return read, findings, policy.inspections(read, findings, weights), deep


def inspect_documents(docs: DataFrame, overrides: DataFrame | None = None, weights: DataFrame | None = None, files: Sequence[FilePlugin] = plug.DEFAULT, scripts: Sequence[ScriptPlugin] = (), base: str | None = None, **how) -> tuple[DataFrame, DataFrame]:
    """(inspections, findings): status, score and risk of each document, and its findings with actions, as reported.

    Kept links are one finding with their count and first hosts; of a kind that comes often the first 200 are told, and
    the rest as one; each has its description. how: passwords, limits, strip_metadata.
    """
    _, findings, told, _ = _inspected(docs, overrides, weights, files, scripts, base, how, 0)
    return told, policy.reported(findings)


def _beside(big: DataFrame, small: DataFrame, weight: Column, how: str = "inner") -> DataFrame:
    """big joined by doc_id with a settled table that has a row a document: sent to each executor while its rows weigh
    little enough, so that bytes of documents stay where they lie; else merged."""
    size = small.agg(F.sum(weight + 64)).first()[0] or 0
    return big.join(F.broadcast(small) if size <= BROADCAST_BYTES else small.hint("merge"), "doc_id", how)


def _disarmed(docs: DataFrame, overrides=None, weights=None, files=plug.DEFAULT, scripts=(), base=None, depth: int = 0, preserve_signatures: bool = True, **how) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(doc_id, status, output, reasons; findings before; documents too deep)."""
    read, findings, before, deep = _inspected(docs, overrides, weights, files, scripts, base, how, depth)
    slots = findings.where("action = 'strip' and slot <> ''").groupBy("doc_id").agg(F.collect_set("slot").alias("slots"))
    kept = findings.where("md5 is not null").select("doc_id", "md5", F.when(F.col("detail") == "PLUGIN_PASSED", "passed").otherwise("scrubbed").alias("result")).dropDuplicates(["doc_id", "md5"])
    bodies = findings.where("body is not null").groupBy("doc_id").agg(F.collect_list(F.struct("slot", "body")).alias("bodies"))
    broken = findings.where("category = 'CORRUPTED'").select("doc_id", F.lit(True).alias("broken")).distinct()
    plan = before.select("doc_id", "status").join(read.select("doc_id", F.col("signed") & F.lit(preserve_signatures)), "doc_id").toDF("doc_id", "status", "signed")
    plan = plan.join(slots, "doc_id", "left").join(bodies, "doc_id", "left").join(broken, "doc_id", "left")
    empty = F.array().cast("array<struct<slot:string,body:binary>>")
    plan = _settled(plan.select("doc_id", "status", (F.col("signed") & (F.col("status") == "clean") & F.col("broken").isNull()).alias("as_is"), F.coalesce("slots", F.array().cast("array<string>")).alias("slots"), F.coalesce("bodies", empty).alias("bodies")))
    weight = F.aggregate("slots", F.lit(0).cast("long"), lambda x, s: x + F.octet_length(s)) + F.aggregate("bodies", F.lit(0).cast("long"), lambda x, b: x + F.octet_length(b["body"]))
    go = _beside(docs.select("doc_id", "content"), plan.where("status <> 'rejected'").drop("status"), weight)
    settings = {"passwords": how.get("passwords"), "limits": how.get("limits", Limits()), "strip_metadata": how.get("strip_metadata", False)}
    written = _settled(_run(go.where("not as_is"), True, **settings))
    again = written.select("doc_id", F.col("after_incomplete").alias("incomplete"), F.col("after_items").alias("items"))
    left = _resolved(findings_of(again, base, [p for p in files if p.process is not None], scripts, kept, None, depth), overrides)
    # an attached document that the engine kept is known by its bytes, and other ones it has no business with here
    bad = left.where("action <> 'info'").groupBy("doc_id").agg(F.sort_array(F.collect_set(F.concat_ws("/", "category", "detail"))).alias("bad"))
    checked = written.select("doc_id", "after_incomplete", F.col("pages").alias("a"), F.col("after_pages").alias("b"), (F.col("lengths") == F.col("after_lengths")).alias("same")).join(bad, "doc_id", "left")
    reasons = F.concat(
        F.coalesce("bad", F.array().cast("array<string>")), F.when(F.col("after_incomplete") & F.col("bad").isNull(), F.array(F.lit("the output check stopped early"))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("a") != F.col("b"), F.array(F.concat(F.lit("pages "), F.col("a"), F.lit(" -> "), F.col("b")))).otherwise(F.array().cast("array<string>")), F.when(~F.col("same"), F.array(F.lit("page content changed"))).otherwise(F.array().cast("array<string>")),
    )
    checked = _settled(plan.select("doc_id", "status", "as_is").join(checked.select("doc_id", F.slice(reasons, 1, 10).alias("reasons")), "doc_id", "left"))
    fine = F.col("as_is") | (F.size(F.coalesce("reasons", F.array(F.lit("")).cast("array<string>"))) == 0)
    status = F.when((F.col("status") == "rejected") | ~fine, "rejected").when(F.col("status") == "strippable", "defused").otherwise("clean")
    verdict = checked.select("doc_id", status.alias("status"), F.array_join("reasons", ", ").alias("reasons"))
    outputs = written.select("doc_id", "output").unionByName(go.where("as_is").select("doc_id", F.col("content").alias("output")))
    out = _beside(outputs, verdict.where("status <> 'rejected'").drop("reasons"), F.lit(0))
    out = out.select("doc_id", "status", "output", F.lit("").alias("reasons")).unionByName(verdict.where("status = 'rejected'").select("doc_id", "status", F.lit(None).cast("binary").alias("output"), "reasons"))
    failed = checked.where(~fine & (F.col("status") != "rejected")).select("doc_id", F.lit((1 << 30) + 1).alias("ordinal"), F.lit("PROCESSING").alias("category"), F.lit("VERIFICATION_FAILED").alias("detail"), F.lit("").alias("location"), F.lit("").alias("slot"), F.array_join("reasons", ", ").alias("value"))
    findings = findings.unionByName(policy.with_actions(failed, overrides), allowMissingColumns=True)
    return out, findings, deep


def disarm_documents(docs: DataFrame, overrides: DataFrame | None = None, weights: DataFrame | None = None, files: Sequence[FilePlugin] = plug.DEFAULT, scripts: Sequence[ScriptPlugin] = (), base: str | None = None, **how) -> DataFrame:
    """doc_id, status, output, reasons: a cleaned copy of each document that can have one, once its inspection passed.

    status is clean, defused or rejected. A copy is released only if it has the pages and page contents of its source
    and nothing left that its own inspection would remove; reasons say why it was not. A clean document that is signed
    as a whole is handed out as it is, unless preserve_signatures is false. how: passwords, limits, strip_metadata.
    """
    return _disarmed(docs, overrides, weights, files, scripts, base, 0, **how)[0]


def removals(docs: DataFrame, overrides: DataFrame | None = None, **how) -> DataFrame:
    """The findings of each document that disarm_documents releases without what they tell of."""
    done, findings, _ = _disarmed(docs, overrides, **how)
    return policy.removed(findings).join(done.where("status = 'defused'").select("doc_id"), "doc_id", "left_semi")
