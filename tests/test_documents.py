"""Whole runs on documents: what a copy holds afterwards, what plugins decide, what lies in documents inside documents."""

import time
import zlib

import pytest
from pyspark.sql import functions as F

from parchment.operators import documents, plugins, policy
from parchment.operators.plugins import DEFAULT, PDF, FilePlugin, ScriptPlugin, pass_through
from parchment.sources.pdf import walk as walking
from parchment.sources.pdf.builder import link, one_page, updated
from parchment.sources.pdf.document import Intervals, Pdf, _header, heads, overlap
from parchment.sources.pdf.inspect import Limits, inspect

FILES = "/Names << /EmbeddedFiles << /Names [{}] >> >>"
SPEC = "<< /Type /Filespec {names} /EF << {streams} >> >>"


def holding(*bodies, names="/F (a.csv)", streams="/F 101 0 R", extra=""):
    return one_page(FILES.format("(x) 100 0 R") + extra, objects=[SPEC.format(names=names, streams=streams), *[("/Type /EmbeddedFile", b) for b in bodies]]).build()


def frame(spark, *docs):
    return spark.createDataFrame(list(enumerate(map(bytearray, docs))), "doc_id long, content binary")


def attached(data):
    """The plain bytes of every embedded file of a document, by name."""
    return {(i.value, bytes(i.content)) for i in inspect(data).items if i.category == "EMBEDDED_FILE" and i.detail == ""}


def run(spark, *docs, **how):
    """(status, output, findings as (category, detail, action)) of each document."""
    out, findings, _ = documents._disarmed(frame(spark, *docs), **how)
    told = {}
    for r in findings.collect():
        told.setdefault(r.doc_id, []).append((r.category, r.detail, r.action))
    return [(r.status, r.output and bytes(r.output), sorted(told.get(r.doc_id, []))) for r in sorted(out.collect(), key=lambda r: r.doc_id)]


def test_formulas_and_second_streams_do_not_survive(spark):
    formula = holding(b"=cmd|x,2\n")
    two = holding(b"{}", b"MZ program", names="/F (a.json) /UF (a.json)", streams="/UF 101 0 R /F 102 0 R /DOS 102 0 R")
    renamed = holding(b"{}", names="/UF (a.json) /F (a.exe)")
    both = holding(b"{}", names="/UF (a.json) /F (b.json)")
    (s1, o1, f1), (s2, o2, f2), (s3, o3, f3), (s4, o4, f4) = run(spark, formula, two, renamed, both)
    assert s1 == "defused" and attached(o1) == {("a.csv", b"'=cmd|x,2\n")} and b"=cmd" not in o1.replace(b"'=cmd", b"")
    assert ("EMBEDDED_FILE", "PLUGIN_SCRUBBED", "info") in f1
    assert s2 == "defused" and not attached(o2) and b"MZ program" not in o2 and ("EMBEDDED_FILE", "PLUGIN_REMOVED", "strip") in f2
    assert s3 == "defused" and not attached(o3) and ("EMBEDDED_FILE", "NO_PLUGIN", "strip") in f3
    assert s4 == "clean" and attached(o4) == {("a.json", b"{}")}


def test_plugins_answer_pass_scrub_remove_and_fail(spark):
    def process(data, context):
        assert context.depth == 1 and context.name
        if data == b"boom":
            raise ValueError
        if data == b"told":
            return "passed", None, [{"category": "OTHER", "detail": "SEEN", "action": "reject", "weight": 7, "location": "line 1"}]
        return {b"keep": "passed", b"gone": "removed", b"swap": ("scrubbed", b"new", []), b"none": ("scrubbed", b"", [])}.get(data, "odd answer")

    own = FilePlugin("own", lambda name, declared, sniffed: name.endswith(".own"), process)
    docs = [holding(x, names="/F (a.own)") for x in (b"keep", b"gone", b"swap", b"none", b"boom", b"what", b"told")]
    got = run(spark, *docs, files=(own, *DEFAULT))
    details = [[d for _, d, _ in f if d.startswith("PLUGIN")] for *_, f in got]
    assert details == [["PLUGIN_PASSED"], ["PLUGIN_REMOVED"], ["PLUGIN_SCRUBBED"], ["PLUGIN_FAILED"], ["PLUGIN_FAILED"], ["PLUGIN_FAILED"], ["PLUGIN_PASSED"]]
    assert [attached(o) for _, o, _ in got[:3]] == [{("a.own", b"keep")}, set(), {("a.own", b"new")}]
    assert all(not attached(o) for _, o, _ in got[3:6])
    # what it found inside is told, at its own weight, and rejects nothing but itself
    told, findings = documents.inspect_documents(frame(spark, docs[6]), files=(own,))
    row = findings.where("category = 'OTHER'").first()
    assert (row.action, row.weight, row.location, row.attachment) == ("strip", 7, 'attachment "x" > line 1', "a.own")
    assert told.first().score == 7


def test_pass_through_and_first_plugin(spark):
    picture = holding(b"\x89PNG\r\n\x1a\nxx", names="/F (a.png)")
    assert run(spark, picture)[0][2] == [("EMBEDDED_FILE", "NO_PLUGIN", "strip")]
    status, out, found = run(spark, picture, files=(pass_through("image/png", ".gif"), *DEFAULT))[0]
    assert status == "clean" and attached(out) == {("a.png", b"\x89PNG\r\n\x1a\nxx")} and found == [("EMBEDDED_FILE", "PLUGIN_PASSED", "info")]


def test_pictures_of_forms_go_to_plugins(spark):
    form = one_page("/AcroForm << /Fields [] /XFA [(a) 100 0 R] >>", objects=[("", b"<xdp><template><field><image contentType='image/png'>iVBORw0KGgo=</image></field></template></xdp>")]).build()
    assert ("FORM", "XFA_IMAGE", "strip") in run(spark, form)[0][2]
    swap = FilePlugin("swap", lambda n, d, s: s == "image/png", lambda data, _: ("scrubbed", b"clean!", []))
    status, out, found = run(spark, form, files=(swap,))[0]
    assert status == "defused" and ("FORM", "PLUGIN_SCRUBBED", "info") in found
    assert b"Y2xlYW4h" in b"".join(Pdf(out).get(r).raw for r in Pdf(out).resolve(Pdf(out).resolve(Pdf(out).resolve(Pdf(out).trailer["Root"])["AcroForm"])["XFA"])[1::2])


def test_scripts_go_to_plugins(spark):
    def process(text, context):
        if "raise" in text:
            raise ValueError
        return {"keep();": "passed", "drop();": "removed"}.get(text, ("scrubbed", text.replace("evil", "good"), [{"category": "OTHER", "detail": "SEEN"}]))

    own = ScriptPlugin("own", lambda text, location: ~text.contains("other"), process)
    docs = [one_page(f"/OpenAction << /S /JavaScript /JS ({t}) >>").build() for t in ("keep\\(\\);", "drop\\(\\);", "evil\\(\\);", "raise", "other")]
    got = run(spark, *docs, scripts=(own,))
    kinds = [[(c, d) for c, d, _ in f] for *_, f in got]
    assert kinds == [[("JAVASCRIPT", "PLUGIN_PASSED")], [("JAVASCRIPT", "PLUGIN_REMOVED")], [("JAVASCRIPT", "PLUGIN_SCRUBBED"), ("OTHER", "SEEN")], [("JAVASCRIPT", "OPEN_ACTION"), ("JAVASCRIPT", "PLUGIN_FAILED")], [("JAVASCRIPT", "OPEN_ACTION")]]
    assert [s for s, *_ in got] == ["clean", "defused", "defused", "defused", "defused"]
    scripts = [[bytes(i.content) for i in inspect(o).items if i.category == "JAVASCRIPT"] for _, o, _ in got]
    assert scripts == [[b"keep();"], [], [b"good();"], [], []]


def test_documents_inside_documents(spark):
    inner = one_page("/OpenAction << /S /JavaScript /JS (1) >>").build()
    middle = holding(inner, names="/F (inner.pdf)")
    outer = holding(middle, names="/F (outer.pdf)")
    files = (PDF, *DEFAULT)
    status, out, found = run(spark, outer, files=files)[0]
    assert status == "defused" and ("JAVASCRIPT", "OPEN_ACTION", "strip") in found and found.count(("EMBEDDED_FILE", "PLUGIN_SCRUBBED", "info")) == 2
    ((_, copy),) = attached(out)
    ((_, deep),) = attached(copy)
    assert not inspect(deep).items and inspect(deep).pages == 1
    _, findings = documents.inspect_documents(frame(spark, outer), files=files)
    row = findings.where("detail = 'OPEN_ACTION'").first()
    assert (row.location, row.attachment) == ('attachment "x" > attachment "x" > document open action', "outer.pdf > inner.pdf")
    # a locked one goes, and one too deep stops the whole upload
    locked = run(spark, holding(one_page().build(password="x"), names="/F (a.pdf)"), files=files)[0]
    assert locked[0] == "defused" and ("EMBEDDED_FILE", "PLUGIN_REMOVED", "strip") in locked[2] and not attached(locked[1])
    deep = run(spark, outer, inner, files=files, limits=Limits(nesting=1))
    assert deep[0][0] == "rejected" and ("LIMIT", "NESTING_DEPTH", "reject") in deep[0][2] and deep[1][0] == "defused"
    assert run(spark, outer, files=files, limits=Limits(nesting=2))[0][0] == "defused"


def test_labels_stand_beside_whole_chains(spark):
    tree = "/StructTreeRoot << /Type /StructTreeRoot /K << /S /Link /Alt (see www.mybank.com) /K [<< /Type /OBJR /Obj 100 0 R >>] >> >>"
    annot = "<< /Type /Annot /Subtype /Link /Rect [0 0 9 9] /A << /S /URI /URI ({}) {} >> {} >>"
    follow = "/Next << /S /URI /URI (https://evil.example/) >>"
    docs = [
        one_page(tree, page="/Annots [100 0 R]", objects=[annot.format("https://evil.example/", "", "")]).build(),  # by its alternative text
        one_page(tree, page="/Annots [100 0 R]", objects=[annot.format("https://login.mybank.com/", "", "")]).build(),
        one_page("", page="/Annots [100 0 R]", objects=[annot.format("https://mybank.com/", follow, "/Contents (mybank.com)")]).build(),  # further down its chain
        one_page("", page="/Annots [100 0 R]", objects=["<< /Type /Annot /Subtype /Link /Rect [0 0 9 9] /A << /S /URI /URI /javascript:x >> >>"]).build(),  # a name is read two ways
    ]
    got = [[(c, d) for c, d, _ in f] for *_, f in run(spark, *docs)]
    assert got == [[("LINK", "TEXT_MISMATCH")], [("LINK", "SAFE")], [("LINK", "TEXT_MISMATCH")], [("JAVASCRIPT", "URL")]]


def test_kept_links_are_one_finding_and_kinds_are_capped(spark):
    many = one_page(annots=[link(f"<< /S /URI /URI (https://h{k}.example.com/) >>") for k in range(25)] + [link("<< /S /Launch >>")] * 230).build()
    _, findings = documents.inspect_documents(frame(spark, many))
    safe = findings.where("detail = 'SAFE'").collect()
    assert [(r["count"], r["value"]) for r in safe] == [(25, ", ".join(f"h{k}.example.com" for k in range(20)))]
    launches = findings.where("detail = 'LAUNCH'").orderBy("ordinal").collect()
    assert len(launches) == 201 and sorted((r["location"], r["count"]) for r in launches if r["count"]) == [("additional occurrences", 30)]
    assert all(r["description"] for r in findings.collect())


def test_a_signed_document_is_handed_out_as_it_is(spark):
    made = one_page("/AcroForm << /Fields [100 0 R] >>", objects=["<< /FT /Sig /T (s) /V 101 0 R >>", "<< /Type /Sig /ByteRange [0 0000 0000 0000] /Contents <" + "00" * 16 + "> >>"]).build()
    gap = made.index(b"/Contents <") + 10
    numbers = (gap, gap + 34, len(made) - gap - 34)
    signed = made.replace(b"[0 0000 0000 0000]", b"[0 %04d %04d %04d]" % numbers)
    assert inspect(signed).signed and not inspect(made).signed
    (status, out, found), (_, rewritten, _) = run(spark, signed, made)
    assert status == "clean" and out == signed and ("SIGNATURE", "SIGNED", "info") in found and rewritten != made
    assert run(spark, signed, preserve_signatures=False)[0][1] != signed
    assert not inspect(updated(signed, {5: ("", b"x")})).signed


def test_a_calculation_order_goes_with_its_last_script(spark):
    field = "<< /FT /Tx /T (a) /AA << /C << /S /JavaScript /JS (6) >> >> >>"
    data = one_page("/AcroForm << /Fields [100 0 R] /CO [100 0 R] >>", objects=[field]).build()
    status, out, found = run(spark, data)[0]
    assert status == "defused" and ("FORM", "CALCULATION_ORDER", "strip") in found and b"/CO" not in out
    keep = ScriptPlugin("keep", lambda text, location: F.lit(True), lambda text, _: "passed")
    status, out, found = run(spark, data, scripts=(keep,))[0]
    assert status == "clean" and not [d for _, d, _ in found if d == "CALCULATION_ORDER"] and b"/CO" in out


def test_a_silent_loss_is_told_where_nothing_else_is(spark):
    loop = one_page("/OpenAction 100 0 R", objects=["<< /S /GoTo /D [10 0 R /Fit] /Next 100 0 R >>"]).build()
    overrides = spark.createDataFrame([(0, "ACTION", None, "info")], "list_pos int, category string, detail string, action string")
    assert ("PROCESSING", "CONTENT_REMOVED", "strip") in run(spark, loop, overrides=overrides)[0][2]


def test_removals_are_told(spark):
    rows = documents.removals(frame(spark, one_page("/OpenAction << /S /JavaScript /JS (1) >>").build(), one_page().build())).collect()
    assert [(r.doc_id, r.detail) for r in rows] == [(0, "OPEN_ACTION")]


def test_a_hot_document_is_ranked_in_parts(spark):
    rows = spark.range(10_000).select(F.lit(1).alias("doc_id"), F.lit("LINK").alias("category"), F.lit("IP_HOST").alias("detail"), F.col("id").alias("ordinal"), F.when(F.col("id") == 9000, "reject").otherwise("strip").alias("action"), F.lit("x").alias("location"))
    got = policy.capped(rows).orderBy("ordinal").collect()
    assert [r.ordinal for r in got if r["count"] is None] == list(range(200))
    assert [(r["count"], r.action, r.ordinal) for r in got if r["count"]] == [(9800, "reject", 200)]


def test_findings_of_documents_alone_are_capped_without_ranking(spark):
    many = [link("<< /S /Launch >>")] * 203
    docs = frame(spark, one_page(annots=many).build(), one_page(annots=[*many, link("<< /S /URI /URI (https://example.com/) >>")]).build())
    _, findings, _, _ = documents._inspected(docs, None, None, DEFAULT, (), None, {}, 0)
    placed = findings.groupBy("doc_id").agg(F.count("nth").alias("n"), F.max("nth").alias("last")).orderBy("doc_id").collect()
    assert [tuple(r) for r in placed] == [(0, 203, 203), (1, 0, None)]
    assert "Window" not in policy.capped(findings.where("nth is not null"))._jdf.queryExecution().optimizedPlan().toString()
    told = {0: [], 1: []}
    for r in policy.reported(findings).where("detail = 'LAUNCH'").orderBy("ordinal").collect():
        told[r.doc_id].append((r.ordinal, r.action, r.location, r.slot, r["count"]))
    assert told[0] == told[1]
    assert told[0][:200] == [(k, "strip", f"page 1, annotation {k + 1}", f"obj:10/Annots[{k}]/A", None) for k in range(200)]
    assert told[0][200:] == [(200, "strip", "additional occurrences", None, 3)]


# the kernel alone


def test_equal_annotations_are_walked_once_and_told_for_each_place(monkeypatch):
    one, seen = walking.Walk._annotation, []
    monkeypatch.setattr(walking.Walk, "_annotation", lambda self, d, *rest: seen.append(d) or one(self, d, *rest))
    follow = "<< /S /Launch /Next << /S /GoToR /F /x >> >>"
    equal, other = inspect(one_page(annots=[link(follow)] * 90).build()), inspect(one_page(annots=[link(follow, f"[0 0 {k} 1]") for k in range(90)]).build())
    assert len(seen) == 1 + 90
    assert equal.items == other.items and len(equal.items) == 180
    held = [(i.detail, i.location, i.slot) for i in inspect(one_page(annots=["<< /Type /Annot /Subtype /Text /Rect [0 0 9 9] /Metadata << >> /JS /x >>"] * 2).build()).items]
    assert held == [("XMP", "page 1, annotation 1", "metadata"), *[("UNATTACHED", f"page 1, annotation {k}", f"obj:10/Annots[{k - 1}]/JS") for k in (1, 2)]]
    gone = frozenset(f"obj:10/Annots[{k}]/A" for k in range(0, 90, 2))
    left = inspect(inspect(one_page(annots=[link(follow)] * 90).build(), remove=gone).output)
    assert [i.location for i in left.items if i.detail == "LAUNCH"] == [f"page 1, annotation {k + 1}" for k in range(1, 90, 2)]


def test_object_headers_are_found_by_their_last_word():
    for data in (b"1 0 obj", b"1 0 objobj 2  0\nobj endobj 123456789012 0 obj", b"1 123456 obj 7 0 objx 4 0 R obj", b"3" + b" " * 90 + b"0 obj", b"obj", b"\0 obj 1 obj"):
        assert [m.span() for m in heads(data)] == [m.span() for m in _header.finditer(data)]


def kinds(report):
    return [(i.category, i.detail) for i in report.items]


def unterminated(n):
    out, offsets = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), []
    bodies = ["1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n", "2 0 obj\n<< /Type /Pages /Kids [3 0 R] /Count 1 >>\nendobj\n", "3 0 obj\n<< /Type /Page /Parent 2 0 R /MediaBox [0 0 9 9] >>\nendobj\n"]
    for body in bodies + [f"{4 + k} 0 obj<</Length 1>>stream\nxx\n" for k in range(n)]:
        offsets.append(len(out))
        out += body.encode()
    at = len(out)
    rows = b"".join(b"%010d 00000 n\r\n" % o for o in offsets)
    return bytes(out + b"xref\n0 %d\n0000000000 65535 f\r\n" % (len(offsets) + 1) + rows + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(offsets) + 1, at))


def test_80_000_unterminated_streams_take_seconds():
    data, began = unterminated(80_000), time.monotonic()
    r = inspect(data, remove=frozenset())
    assert not r.incomplete and ("CORRUPTED", "STREAM_LENGTH_WRONG") in kinds(r) and time.monotonic() - began < 30
    began = time.monotonic()
    inspect(data[:-40])  # without its end the table is rebuilt from 80,000 headers
    assert time.monotonic() - began < 30


def test_headers_in_streams_and_comments_are_no_objects():
    made = one_page()
    made.put(5, ("", b"7 0 obj << /Type /Catalog >> endobj"))
    data = made.build(startxref=3).replace(b"%PDF-1.7\n", b"%PDF-1.7\n% 9 0 obj << /S /JavaScript /JS (1) >>\n")
    r = inspect(data)
    assert kinds(r) == [("CORRUPTED", "XREF_REBUILT")] and Pdf(data).live() == [1, 2, 5, 10]


def test_ranges():
    inside = Intervals([(5, 9), (1, 3), (2, 4), (9, 10)])
    assert [k for k in range(12) if k in inside] == [1, 2, 3, 5, 6, 7, 8, 9]
    assert overlap([(0, 3), (2, 1)]) and not overlap([(3, 2), (0, 3), (7, 0)])


def test_tables_that_repeat_a_number_are_rebuilt():
    data = one_page().build()
    at = data.index(b"trailer")
    twice = data[:at] + b"1 1\n0000000000 00000 n \n" + data[at:]
    assert ("CORRUPTED", "XREF_REBUILT") in kinds(inspect(twice)) and inspect(twice).pages == 1


def test_issues_have_their_reasons():
    direct = one_page("/Odd [<< /Length 3 >> stream\nabc\nendstream]").build()
    r = inspect(direct, remove=frozenset())
    assert [(i.location, i.value) for i in r.items if i.category == "CORRUPTED"] == [("", "streams written inside other objects: 1")]
    assert b"abc" in r.output and inspect(r.output).pages == 1
    other = one_page("/Odd 5 3 R").build()
    assert [i.value for i in inspect(other).items] == ["references whose generation does not match the object: 1"]
    held = one_page("/Odd 20 0 R", objects=[])
    held.put(20, ("/Type /ObjStm /N 0 /First 0", b""))
    assert [i.value for i in inspect(held.build()).items if i.category == "CORRUPTED"] == ["references to object or xref streams: 1"]


def test_long_chains_and_trees_are_told_and_reject(monkeypatch):
    monkeypatch.setattr(walking, "LINKS", 20)
    chain = one_page("/OpenAction 100 0 R", objects=[f"<< /S /GoTo /D [10 0 R /Fit] /Next {101 + k} 0 R >>" for k in range(30)] + ["<< /S /GoTo /D [10 0 R /Fit] >>"]).build()
    r = inspect(chain)
    assert r.incomplete and [i.value for i in r.items if i.category == "CORRUPTED"] == ["action chain too long"]
    monkeypatch.setattr(walking, "LINKS", 1000)
    assert not inspect(one_page("/OpenAction 100 0 R", objects=[f"<< /S /GoTo /D [10 0 R /Fit] /Next {101 + k} 0 R >>" for k in range(900)] + ["<< /S /GoTo /D [10 0 R /Fit] >>"]).build()).incomplete
    monkeypatch.setattr(walking, "NODES", 5)
    tree = one_page("/Names << /JavaScript << /Kids [100 0 R 101 0 R 102 0 R 103 0 R 104 0 R 105 0 R] >> >>", objects=["<< /Names [(a) << /S /JavaScript /JS (1) >>] >>"] * 6).build()
    r = inspect(tree)
    assert r.incomplete and "too many nodes" in [i.value for i in r.items]


def test_objects_that_are_also_actions():
    page = one_page("/OpenAction 10 0 R", page="/S /Launch /F (calc.exe)").build()
    first = inspect(page)
    assert kinds(first) == [("CORRUPTED", "MALFORMED_OBJECT"), ("ACTION", "LAUNCH")] and first.pages == 1
    out = inspect(page, remove=frozenset(i.slot for i in first.items if i.slot)).output
    assert b"/Launch" not in out and inspect(out).pages == 1 and not inspect(out).items
    annot = one_page(annots=["<< /Type /Annot /Subtype /Text /Rect [0 0 9 9] /S /JavaScript /JS (1) >>"]).build()
    assert kinds(inspect(annot)) == [("JAVASCRIPT", "ANNOTATION")]
    assert b"/JS" not in inspect(annot, remove=frozenset(i.slot for i in inspect(annot).items)).output


def test_what_removed_things_share_with_kept_ones_stays():
    shared = "<< /Type /XObject /Subtype /Form /BBox [0 0 1 1] /Mark (shared) >>"
    data = one_page(page="/Resources << /XObject << /X 101 0 R >> >> /Annots [100 0 R]", objects=["<< /Type /Annot /Subtype /Movie /Rect [0 0 9 9] /AP << /N 101 0 R >> >>", shared]).build()
    out = inspect(data, remove=frozenset(["obj:100"])).output
    assert b"/Movie" not in out and b"<736861726564>" in out
    action = one_page("/OpenAction 100 0 R /Odd [100 0 R]", objects=["<< /S /GoTo /D [10 0 R /Fit] >>"]).build()
    assert not inspect(action, remove=frozenset()).output.count(b"null")


def test_only_scripts_belong_among_document_scripts():
    data = one_page("/Names << /JavaScript << /Names [(a) << /S /GoTo /D [10 0 R /Fit] >> (b) 7] >> >>").build()
    r = inspect(data)
    assert [i.value for i in r.items] == ["not a script"] * 2
    assert b"/JavaScript" not in inspect(data, remove=frozenset(i.slot for i in r.items)).output


def test_pictures_that_forms_name():
    form = "/AcroForm << /Fields [] /XFA [(a) 100 0 R] >> /NeedsRendering true "
    objects = [("", b"<xdp><template><field><image href='p'/></field></template></xdp>"), ("", b"picture")]
    named = "/Names << /XFAImages << /Names [(p) 101 0 R (q) 7] >> >>"
    r = inspect(one_page(form + named, objects=objects).build(), remove=frozenset())
    assert [(i.detail, i.value, i.content) for i in r.items if i.detail in ("IMAGE", "MALFORMED_OBJECT")] == [("MALFORMED_OBJECT", "not a stream", None), ("IMAGE", "p", b"picture")][::-1]
    assert b"/NeedsRendering" in r.output and b"picture" in r.output
    gone = inspect(one_page(form + named, objects=objects).build(), remove=frozenset(["file:101"])).output
    assert b"picture" not in gone
    bare = inspect(one_page(named + " /NeedsRendering true", objects=["7", ("", b"picture")]).build(), remove=frozenset())
    assert [(i.detail, i.forced) for i in bare.items if i.category == "FORM"] == [("XFA_IMAGE", True)] and b"/NeedsRendering" not in bare.output


def test_metadata_goes_where_an_override_says_so():
    data = one_page("/Metadata 100 0 R", objects=[("/Type /Metadata /Subtype /XML", b"<x/>")], info="/Title (t)").build(trailer="/Info 6 0 R")
    r = inspect(data)
    assert kinds(r) == [("METADATA", "INFO_DICTIONARY"), ("METADATA", "XMP")]
    out = inspect(data, remove=frozenset(i.slot for i in r.items)).output
    assert b"<x/>" not in out and b"/Info" not in out and not inspect(out).items


def test_limits_of_time_and_size():
    data = one_page().build()
    assert kinds(inspect(data, limits=Limits(seconds=0))) == [("LIMIT", "TIME")]
    assert kinds(inspect(data, limits=Limits(file_size=10))) == [("LIMIT", "FILE_SIZE")]
    assert inspect(data, limits=Limits(file_size=10)).incomplete


def test_name_trees_are_written_in_order():
    data = one_page(FILES.format("(b) 100 0 R (a) 102 0 R"), objects=[SPEC.format(names="/F (b.json)", streams="/F 101 0 R"), ("/Type /EmbeddedFile", b"1"), SPEC.format(names="/F (a.json)", streams="/F 103 0 R"), ("/Type /EmbeddedFile", b"2")]).build()
    out = inspect(data, remove=frozenset()).output
    assert out.index(b"<61>") < out.index(b"<62>")


def test_a_replaced_file_is_packed_anew():
    data = holding(zlib.compress(b"=1\n"), streams="/F 101 0 R").replace(b"/Type /EmbeddedFile", b"/Type /EmbeddedFile /Filter /FlateDecode")
    out = inspect(Pdf(data).data, remove=frozenset(), bodies={"file:101": b"'=1\n"}).output
    assert attached(out) == {("a.csv", b"'=1\n")}
