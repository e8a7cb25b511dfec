"""Word documents, schedules, corpora and streams, made and read back."""

import hashlib
import json
import os

import pytest

from stemma.operators import headings, schedule
from stemma.sources import corpora, docx, snapshots, word_files
from stemma.streaming import ingest, metrics


def _p(text, style=None, extra="", run=""):
    pr = (f'<w:pStyle w:val="{style}"/>' if style else "") + extra
    return f'<w:p><w:pPr>{pr}</w:pPr><w:r><w:rPr>{run}</w:rPr><w:t xml:space="preserve">{text}</w:t></w:r></w:p>'


def _table(rows):
    return "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{_p(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"


SOA = [["Procedure", "Screening", "Baseline", "Week 4"], ["Informed consent", "X", "X", "-"], ["Vitals", "X", "X", "X"], ["ECG", "-", "Х", "-"]]
TRAP = [["Item", "Visit 1", "Visit 2", "Visit 3"], ["a", "X", "X", "X"], ["b", "X", "X", "X"], ["c", "X", "X", "X"]]



def test_blocks_and_headings(spark, tmp_path):
    body = _p("Introduction", "Heading1") + _p("Protocol Version: 2.0") + _p("Objectives", "Heading2") + _p("2.1 Primary objective") + _p("3 PLAN OF ANALYSIS") + _p("4 a sentence that ends.") + _p("Outlined", extra='<w:outlineLvl w:val="2"/>')
    (tmp_path / "a.docx").write_bytes(docx.package(body))
    (tmp_path / "broken.docx").write_bytes(b"not a zip")
    found = docx.accepted(docx.files(spark, str(tmp_path)))
    b = docx.blocks(found)
    assert b.filter("error IS NOT NULL").count() == 1
    got = {r.text: (r.mode, r.level) for r in headings.detect(b.filter("error IS NULL")).collect()}
    assert got["Introduction"] == ("style", 1) and got["Objectives"] == ("style", 2)
    assert got["2.1 Primary objective"] == ("numbering", 2) and got["3 PLAN OF ANALYSIS"] == ("numbering", 1)
    assert got["4 a sentence that ends."][0] == "none" and got["Outlined"] == ("outline", 3)


def test_visual_headings_only_without_others(spark, tmp_path):
    looks = '<w:b/><w:sz w:val="36"/>'
    plain = "".join(_p(f"plain text number {i} that is ordinary.", run='<w:sz w:val="22"/>') for i in range(5))
    (tmp_path / "v.docx").write_bytes(docx.package(_p("Looks like one", extra='<w:jc w:val="center"/>', run=looks) + plain))
    got = headings.detect(docx.blocks(docx.files(spark, str(tmp_path)))).filter("mode = 'visual'").collect()
    assert [r.text for r in got] == ["Looks like one"]


def test_schedule_and_appendix_trap(spark, tmp_path):
    body = _p("Schedule of Activities", "Heading1") + _table(SOA) + _p("APPENDIX 6", "Heading1") + _p("Clinical Global Impressions Scale") + _table(TRAP)
    (tmp_path / "s.docx").write_bytes(docx.package(body))
    b = docx.blocks(docx.files(spark, str(tmp_path)))
    cells = b.filter("kind = 'cell'")
    scored = schedule.score_tables(cells, schedule.table_context(b, headings.detect(b)))
    chosen = schedule.choose(scored)
    assert [r.table_no for r in chosen.collect()] == [0]
    m = schedule.unpivot(cells, chosen)
    marked = {(r.procedure, r.visit) for r in m.filter("marked").collect()}
    assert marked == {("Informed consent", "Screening"), ("Informed consent", "Baseline"), ("Vitals", "Screening"), ("Vitals", "Baseline"), ("Vitals", "Week 4"), ("ECG", "Baseline")}
    d = schedule.density(m).first()
    assert (d.visits, d.procedures, d.marked) == (3, 3, 6)


def test_assembly_round_trip(spark, tmp_path):
    (tmp_path / "x.docx").write_bytes(docx.assemble([("Z", "last"), ("B", "two"), ("A", "one\nmore")], ["A", "B"]))
    rows = docx.blocks(docx.files(spark, str(tmp_path))).orderBy("para_index").collect()
    assert [r.text_raw for r in rows] == ["A", "one", "more", "B", "two", "Z", "last"]


def test_skips_and_samples(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"f{i}.docx").write_bytes(docx.assemble([(str(i), "t")]))
    (tmp_path / "n.txt").write_text("no")
    (tmp_path / "p.pdf").write_text("pdf")
    found = docx.accepted(docx.files(spark, str(tmp_path)))
    assert found.count() == 4 and found.filter("warning IS NOT NULL").count() == 1
    assert docx.unseen(found, found.filter("name = 'f0.docx'")).count() == 3
    v = spark.createDataFrame([("s", f"{i}", i) for i in range(6)] + [("t", "a", 1)], "study string, path string, modified long")
    assert sorted(r.path for r in docx.sample_versions(v, 3).collect()) == ["0", "1", "2", "5", "a"]


def test_names(spark):
    df = spark.createDataFrame([("../a b?.docx",), ("C:\\x\\y.docx",), ("...",), (None,)], "n string")
    from pyspark.sql import functions as F

    assert [r.x for r in df.select(docx.sanitize_name(F.col("n")).alias("x")).collect()] == ["a_b_.docx", "y.docx", "file", "file"]


def test_jsonl(spark, tmp_path):
    p = tmp_path / "h.jsonl"
    p.write_text('{"doc_version_id": "1", "hdr_anchor_id": "a", "heading_text_raw": "X", "heading_text_norm": "x"}\nnot json\n{"doc_version_id": "2", "hdr_anchor_id": "b", "heading_text_raw": "Y", "heading_text_norm": "y"}\n')
    df = corpora.read_jsonl(spark, str(p))
    assert len(df.collect()) == 2
    corpora.write_jsonl(df, str(tmp_path / "out"))
    assert len(corpora.read_jsonl(spark, str(tmp_path / "out")).collect()) == 2
    corpora.write_report(df, str(tmp_path / "csv"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    (tmp_path / "r.json").write_text(json.dumps({"a": [1]}))
    assert corpora.read_rules(spark, str(tmp_path / "r.json")) == {"a": [1]}


def test_partition_rewrite(spark, tmp_path):
    path = str(tmp_path / "t")
    corpora.overwrite_versions(spark.createDataFrame([("1", 1), ("2", 2)], "doc_version_id string, v long"), path)
    corpora.overwrite_versions(spark.createDataFrame([("2", 3)], "doc_version_id string, v long"), path)
    assert sorted((str(r.doc_version_id), r.v) for r in spark.read.parquet(path).collect()) == [("1", 1), ("2", 3)]


def test_stream_equals_batch(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.write.parquet(str(tmp_path / "in"))
    stream = metrics.windowed_counts(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("counts").collect()) == sorted(metrics.windowed_counts(src).collect())


def test_word_source_reads_as_the_parser_does(spark, tmp_path):
    word_files.register(spark)
    body = '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t>One</w:t></w:r></w:p>' + docx.table_xml([["a", "b"], ["c", "d & e"]]) + "<w:p><w:r><w:t>after</w:t></w:r></w:p>" * 5000
    contents = {"a.docx": docx.package(body), "b.docx": docx.package(""), "c.docx": b"no archive", "d.docx": docx.package("<w:p><w:r><w:t>x</w:t>")}
    rows = spark.createDataFrame([(n, bytearray(c)) for n, c in contents.items()], "name string, content binary").repartition(3)
    rows.write.format("word").mode("append").save(str(tmp_path / "w"))
    assert sorted(os.listdir(tmp_path / "w")) == sorted(contents)
    (tmp_path / "w" / "note.txt").write_text("not read")
    got = spark.read.format("word").load(str(tmp_path / "w")).collect()
    frame = spark.createDataFrame([(f"{tmp_path}/w/{n}", bytearray(c)) for n, c in contents.items()], "path string, content binary")
    key = lambda r: (r.path, r.para_index or 0)
    want = sorted(docx.blocks(frame).collect(), key=key)
    assert [r.asDict() | {"error": bool(r.error)} for r in sorted(got, key=key)] == [r.asDict() | {"error": bool(r.error)} for r in want]
    assert {r.file_hash for r in got} == {hashlib.sha256(c).hexdigest() for n, c in contents.items() if n != "b.docx"}
    with pytest.raises(Exception, match="there already"):
        rows.write.format("word").mode("append").save(str(tmp_path / "w"))
    with pytest.raises(Exception, match="once each"):
        rows.union(rows).write.format("word").mode("append").save(str(tmp_path / "v"))
    assert not [x for x in os.listdir(tmp_path / "v")]
    os.mkdir(tmp_path / "empty")
    assert spark.read.format("word").load(str(tmp_path / "empty")).count() == 0


def test_ingest_takes_up_where_it_was(spark, tmp_path):
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def run():
        ingest.ingest(ingest.unseen(ingest.arrivals(spark, folder, "id long, text string", files=1), "text"), out, state)
        return sorted((r.text or "") for r in spark.read.parquet(out).collect())

    spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "")], "id long, text string").repartition(3).write.parquet(folder)
    assert run() in (["", "a", "b"],) and run() == ["", "a", "b"]
    spark.createDataFrame([(6, "b"), (7, "c")], "id long, text string").write.mode("append").parquet(folder)
    assert run() == ["", "a", "b", "c"] and run() == ["", "a", "b", "c"]


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, path)
    assert snapshots.replace(spark.range(3), path) == 1
    reader = snapshots.read(spark, path)
    assert snapshots.replace(reader.selectExpr("id + 10 AS id"), path, base=1) == 2
    assert sorted(r.id for r in reader.collect()) == [0, 1, 2] and sorted(r.id for r in snapshots.read(spark, path).collect()) == [10, 11, 12]
    with pytest.raises(snapshots.Conflict):
        snapshots.replace(spark.range(1), path, base=1)
    with pytest.raises(Exception, match="no"):
        snapshots.replace(spark.range(3).selectExpr("raise_error('no')"), path)
    assert snapshots.versions(spark, path) == [1, 2] and len([x for x in os.listdir(path) if x.startswith("data-") and os.path.exists(f"{path}/{x}/_SUCCESS")]) == 2
    assert snapshots.vacuum(spark, path, keep=1) == 1 and snapshots.versions(spark, path) == [2]
    assert sorted(r.id for r in snapshots.read(spark, path, 2).collect()) == [10, 11, 12]


def test_a_lost_race_raises(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    snapshots.replace(spark.range(1), path)
    real, calls = snapshots.latest, []

    def latest(spark_, path_):  # another writer commits between the last look and the rename
        calls.append(1)
        if len(calls) == 1:
            monkeypatch.setattr(snapshots, "latest", real)
            snapshots.replace(spark.range(5), path)
        return 1

    monkeypatch.setattr(snapshots, "latest", latest)
    with pytest.raises(snapshots.Conflict):
        snapshots.replace(spark.range(2), path, base=1)
    assert snapshots.read(spark, path).count() == 5
