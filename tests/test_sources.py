"""Files as they lie and as they arrive, and what is written of them."""

import json

import pytest

from parchment.operators.documents import disarm_documents, inspect_documents
from parchment.plans.queries import FEATURES, featured
from parchment.session import prepare
from parchment.sources import files
from parchment.streaming.landing import findings_stream


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("files")
    for key in (0, 1, 2):
        (path / f"{key}.pdf").write_bytes(featured(key, "some words"))
    return str(path)


def test_arriving_files_are_told_as_lying_ones(spark, folder, tmp_path):
    prepare(spark)
    stream = findings_stream(spark, folder).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    stream.awaitTermination(60)
    assert stream.exception() is None
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.doc_id[-5:], r.category, r.detail) for r in found) == sorted((f"{k}.pdf", *kind) for k in (0, 1, 2) for kind in FEATURES[k][1])


def test_reports_and_outputs(spark, folder, tmp_path):
    prepare(spark)
    docs = files.read_files(spark, folder)
    reports = {r.doc_id[-5:]: json.loads(r.report) for r in files.json_reports(*inspect_documents(docs)).collect()}
    assert reports["0.pdf"]["status"] == "clean" and reports["1.pdf"]["findings"][0]["detail"] == "OPEN_ACTION"
    files.write_outputs(disarm_documents(docs), str(tmp_path / "out"))
    assert sorted(bytes(r.output[:5]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [b"%PDF-"] * 3


def test_large_files_are_findings_only(spark, folder):
    assert files.read_files(spark, folder, largest=10).count() == 0
    assert {r.detail for r in files.oversized(spark, folder, 10).collect()} == {"FILE_SIZE"}


def test_a_file_for_each_document(spark, folder, tmp_path):
    prepare(spark)
    docs = files.read_files(spark, folder)
    done = disarm_documents(docs).join(docs.select("doc_id", "name"), "doc_id")
    twice = done.unionByName(done.selectExpr("concat(doc_id, 'x') AS doc_id", "status", "output", "reasons", "name"))
    assert files.write_files(twice, str(tmp_path / "copies")) == 6
    names = sorted(p.name for p in (tmp_path / "copies").iterdir())
    assert names == ["0.pdf", "1-0.pdf", "1-1.pdf", "1-2.pdf", "1.pdf", "2.pdf"]
    assert all((tmp_path / "copies" / n).read_bytes().startswith(b"%PDF-") for n in names)


def test_ranges_of_files(spark, folder):
    heads = {r.doc_id[-5:]: r for r in files.read_ranges(spark, [f"{folder}/{k}.pdf" for k in range(3)], 0, 5).collect()}
    assert {bytes(r.content) for r in heads.values()} == {b"%PDF-"} and heads["0.pdf"].size > 300
    assert [bytes(r.content) for r in files.read_ranges(spark, [f"{folder}/0.pdf"], 1 << 30).collect()] == [b""]
    assert files.span(-1, 5, 10) == files.span(2.0, 5, 10) == files.span(10, 1, 10) == (0, 0) and files.span(8, 5, 10) == (8, 10)


def test_detection(spark):
    prepare(spark)
    plain, bare = featured(0, ""), featured(0, "").replace(b"%PDF-1.7\n", b"\n")
    rows = [(0, "a.bin", None, plain), (1, "a.pdf", None, b"junk" + plain), (2, "a.pdf", None, bare), (3, "a.bin", "application/pdf", bare), (4, "a.bin", None, bare), (5, "a.pdf", None, b"no document"), (6, None, None, b""), (7, None, None, None)]
    got = {r.id: (r.offset, r.heuristic) for r in files.detected(spark.createDataFrame(rows, "id int, name string, declared string, content binary")).collect()}
    assert got == {0: (0, False), 1: (4, False), 2: (0, True), 3: (0, True), 4: (None, False), 5: (None, False), 6: (None, False), 7: (None, False)}


def test_reports_hold_no_control_characters(spark):
    told = spark.createDataFrame([("d\x1b[2J", "clean", 0, "NONE")], "doc_id string, status string, score int, risk string")
    found = spark.createDataFrame([("d\x1b[2J", 1, "info", "LINK", "SAFE", 'bookmark "a\nb\x7f\x9b"')], "doc_id string, ordinal int, action string, category string, detail string, location string")
    text = files.text_reports(told, found).first().report
    assert text == 'd\\u001b[2J: clean, risk NONE (score 0)\n  info   LINK/SAFE [bookmark "a\\u000ab\\u007f\\u009b"]'
    raw = files.json_reports(told, found).first().report
    assert "\x7f" not in raw and "\\u007f\\u009b" in raw and json.loads(raw)["findings"][0]["location"] == 'bookmark "a\nb\x7f\x9b"'


# command line


def test_commands(spark, folder, tmp_path, capfd, monkeypatch):
    import io
    import types

    from parchment import cli

    assert cli.run(["inspect", f"{folder}/0.pdf"], spark) == 0 and ": clean, risk NONE (score 0)" in capfd.readouterr().out
    assert cli.run(["inspect", f"{folder}/1.pdf", "--json"], spark) == 1
    assert json.loads(capfd.readouterr().out.strip().splitlines()[-1])["findings"][0]["detail"] == "OPEN_ACTION"
    assert cli.run(["inspect", f"{folder}/1.pdf", "--override", "JAVASCRIPT/OPEN_ACTION=info", "--weight", "JAVASCRIPT=5"], spark) == 0
    assert "(score 5)" in capfd.readouterr().out
    assert cli.run(["inspect", f"{folder}/1.pdf", "--limit", "fileSize=10"], spark) == 2
    out = tmp_path / "out.pdf"
    assert cli.run(["defuse", f"{folder}/1.pdf", str(out)], spark) == 1 and out.read_bytes().startswith(b"%PDF-") and b"alert" not in out.read_bytes()
    assert cli.run(["defuse", folder, str(tmp_path / "all")], spark) == 1 and len(list((tmp_path / "all").iterdir())) == 3
    monkeypatch.setattr("sys.stdin", types.SimpleNamespace(buffer=io.BytesIO(featured(2, "x"))))
    assert cli.run(["inspect", "-"], spark) == 1
    capfd.readouterr()
    for wrong in (["inspect"], ["inspect", "a", "b"], ["defuse", "a"], ["defuse", f"{folder}/0.pdf", f"{folder}/0.pdf"], ["inspect", "/no/such/file.pdf"], ["inspect", f"{folder}/0.pdf", "--limit", "x=1"], ["inspect", f"{folder}/0.pdf", "--override", "LINK=maybe"], ["what"]):
        assert cli.run(wrong, spark) == 3, wrong


def test_sizes_of_limits():
    from parchment import cli

    assert [cli.size_of(x) for x in ("7", "1.5k", "10mb", "2G", "3 KB")] == [7, 1536, 10 << 20, 2 << 30, 3072]
    for bad in ("", "x", "1.5.2k", "-1", "5tb"):
        with pytest.raises(cli.Misuse):
            cli.size_of(bad)
    assert cli.limits_of(["timeMs=1500", "nestingDepth=2"]) == cli.Limits(seconds=1.5, nesting=2)
