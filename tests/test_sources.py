"""Readers and writers on small literal files, and streams against their batch queries."""

import json
import sqlite3
import zipfile

from pyspark.sql import functions as F

from tallgrass.plans import catalogue
from tallgrass.sources import files, sinks
from tallgrass.streaming import events


def test_fixed_width(spark, tmp_path):
    line = lambda n, code, flag, short, long="": f"{n:05d} {code:<7} {flag} {short:<60} {long}"
    p = tmp_path / "order.txt"
    p.write_text("\n".join([line(1, "A00", 0, "Cholera", "Cholera, all"), line(2, "A000", 1, "Cholera due to x"), "short"]))
    assert [tuple(r) for r in files.fixed_width(spark, str(p)).collect()] == [("A00", "Cholera, all", True), ("A00.0", "Cholera due to x", False)]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("icd10_order_2024.txt", p.read_text())
        z.writestr("readme.txt", "no")
    assert [r.line for r in files.zip_member(spark, str(tmp_path / "a.zip"), "order.*txt").orderBy("n").collect()][-1] == "short"


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_text('code,name,STATUS\n1,"a, ""b""",ACTIVE\n2,c,OLD\n')
    assert files.csv_table(spark, str(tmp_path / "a.csv"), keep=F.col("STATUS") == "ACTIVE", id="code", label="name").collect() == [("1", 'a, "b"')]
    (tmp_path / "a.tsv").write_text('id\tactive\tterm\n1\t1\tsay "x\n2\t0\ty\n')
    assert [tuple(r) for r in files.snapshot_table(spark, str(tmp_path / "a.tsv")).collect()] == [("1", "1", 'say "x')]
    (tmp_path / "a.jsonl").write_text('{"k": 1}\n\nbroken\n{"k": 2}\n')
    assert sorted(r.k for r in files.json_lines(spark, str(tmp_path / "a.jsonl"), "k int").collect()) == [1, 2]
    (tmp_path / "a.md").write_text("| # | code | name |\n|---|---|---|\n| 1 | I10 | Hypertension |\ntext\n")
    assert files.markdown_rows(spark, str(tmp_path / "a.md")).collect() == [(1, ["I10", "Hypertension"])]


def test_xml_notes(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<x><diag><name>E08</name><codeFirst><note>the cause, such as P35.0 or C25</note></codeFirst><useAdditionalCode><note>control (Z79.4); E08.1</note></useAdditionalCode></diag><diag><name>I10</name></diag></x>")
    assert sorted(tuple(r) for r in files.note_edges(spark, str(tmp_path / "a.xml")).collect()) == [("E08", "codeFirst", "C25"), ("E08", "codeFirst", "P35"), ("E08", "useAdditionalCode", "Z79")]


def test_note_archive(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "c.db")
    db.executescript("CREATE TABLE col(models, decks); CREATE TABLE notes(id, mid, tags, flds); CREATE TABLE cards(nid, did, ord);")
    db.execute("INSERT INTO col VALUES (?, ?)", (json.dumps({"7": {"name": "Basic", "flds": [{"name": "Front"}, {"name": "Back"}]}}), json.dumps({"1": {"name": "Default"}, "2": {"name": "Med::Heart"}})))
    db.executemany("INSERT INTO notes VALUES (?, ?, ?, ?)", [(10, 7, " t ", "q\x1fa\x1fmore\x1f "), (11, 7, "", "q2")])
    db.executemany("INSERT INTO cards VALUES (?, ?, ?)", [(10, 1, 1), (10, 2, 0), (11, 1, 0)])
    db.commit()
    db.close()
    with zipfile.ZipFile(tmp_path / "d.apkg", "w") as z:
        z.write(tmp_path / "c.db", "collection.anki2")
    got = {r.note_id: r for r in files.note_archives(spark, str(tmp_path / "d.apkg")).collect()}
    assert got[10].deck == "Med::Heart" and got[10].fields == {"Front": "q", "Back": "a", "_extra_field_2": "more"} and got[11].fields == {"Front": "q2", "Back": ""} and got[11].model == "Basic"


def test_boxes_and_tables(spark):
    boxes = spark.createDataFrame([(1, 1, 0, 0, 10, 10), (1, 2, 1, 1, 5, 5), (1, 3, 0, 0, 10, 10), (2, 4, 1, 1, 5, 5)], "page int, id int, x0 int, y0 int, x1 int, y1 int")
    assert sorted(r.id for r in files.outermost_boxes(boxes, "page").collect()) == [1, 4]
    cells = spark.createDataFrame([(1, 1, ["A", "b\nc"]), (1, 2, ["", "d"]), (1, 3, ["", " "]), (1, 4, ["E", "f"])], "t int, r int, cells array<string>")
    assert files.table_text(cells, "t", "r").first().text == "[TABLE]\nA | b; c d\nE | f\n[/TABLE]"


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "v int, task string"), path, ["task"])
    sinks.replace_partitions(spark.createDataFrame([(9, "a")], "v int, task string"), path, ["task"])
    assert sorted((r.v, r.task) for r in spark.read.parquet(path).collect()) == [(2, "b"), (9, "a")]
    df = spark.createDataFrame([("1", "x", None), ("q", '{"a": 1}', "z")], "A string, j string, only string")
    assert [tuple(r) for r in sinks.copy_shared(df, spark.createDataFrame([], "a int, missing int, J string")).collect()] == [(1, "x"), (None, '{"a": 1}')]
    assert [r[0] for r in df.select(sinks.valid_json(F.col("j"))).collect()] == ['"x"', '{"a": 1}']
    nested = sinks.nested_json(spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "k int, pos int, t string"), "k", ["pos"], "items")
    assert {r.k: r["items"] and [x.t for x in r["items"]] for r in nested.collect()} == {1: ["a", "b"], 2: None}


def stream_rows(spark, df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.sql(f"SELECT * FROM {name}")


def test_streams_equal_batches(spark, sf, tmp_path):
    folder = str(tmp_path / "events")
    spark.read.parquet(f"{sf}/events.parquet").coalesce(1).write.parquet(folder)
    live = events.read_events(spark, folder)
    got = stream_rows(spark, events.tumbling_counts(live), "s_counts", "complete")
    want = catalogue.QUERIES["tumbling_counts"](spark, sf)
    assert sorted((r.hour.isoformat(), r.event_type, r.n) for r in got.collect()) == sorted((r.hour.isoformat(), r.event_type, r.n) for r in want.collect())
    got = stream_rows(spark, events.rate_limit(live), "s_rate", "append")
    assert sorted(map(tuple, got.collect())) == sorted((r.event_id, r.user_id, r.allowed) for r in catalogue.QUERIES["rate_limit"](spark, sf).collect())
    got = stream_rows(spark, events.idle_sessions(live), "s_sessions", "complete")
    assert got.agg(F.sum("n")).first()[0] == spark.read.parquet(folder).count()


def test_release_copy_and_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, "5", 'say "a", b', "x"), (2, "z", None, "y"), (3, "7", "", None)], "k int, n string, t string, secret string")
    sinks.release_copy(df, str(tmp_path / "copy"), drop=["secret"], keep=F.col("secret") != "y", types={"n": "int"})
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "copy")).collect()] == [(1, 5, 'say "a", b')]
    sinks.release_copy(df, str(tmp_path / "all"), drop=["secret"], types={"n": "int"})
    assert sorted((r.k, r.n) for r in spark.read.parquet(str(tmp_path / "all")).collect()) == [(1, 5), (2, None), (3, 7)]
    sinks.csv_export(df, str(tmp_path / "csv"), order=["k"])
    lines = sorted(line for f in (tmp_path / "csv").glob("part-*") for line in f.read_text().splitlines()[1:])
    assert lines == ['1,5,"say ""a"", b",x', "2,z,,y", '3,7,"",']


def test_cascade_delete(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = {"p": frame([(1,), (2,), (None,)], "id int"), "c": frame([(10, 1), (11, 1), (12, 2), (13, None)], "cid int, p int"), "g": frame([(5, 10), (6, 12), (7, 11), (7, 11), (8, None)], "gid int, c int")}
    links = [("p", "id", "c", "p"), ("c", "cid", "g", "c")]
    left, gone = sinks.cascade_delete(tables, links, frame([(1,), (1,), (9,), (None,)], "id int"))
    assert gone == {"p": 1, "c": 2, "g": 3}
    assert {n: sorted(map(tuple, df.collect()), key=repr) for n, df in left.items()} == {"p": [(2,), (None,)], "c": [(12, 2), (13, None)], "g": [(6, 12), (8, None)]}
    same, none = sinks.cascade_delete(tables, links, frame([], "id int"))
    assert none == {"p": 0, "c": 0, "g": 0} and same["g"].count() == 5


def test_processing_log(spark, tmp_path):
    path = str(tmp_path / "log")
    for stage, status, n in (("a", "started", None), ("b", "started", None), ("a", "done", 7), ("c", "started", None), ("c", "failed", None)):
        sinks.log_entry(spark, path, "r1", stage, status, n_rows=n, error="broken" if status == "failed" else None)
    log = spark.read.parquet(path)
    state = {r.stage: (r.status, r.n_rows, r.error, r.started_at is not None) for r in sinks.log_state(log).collect()}
    assert state == {"a": ("done", 7, None, True), "b": ("started", None, None, True), "c": ("failed", None, "broken", True)}
    assert sorted(r.stage for r in sinks.open_stages(log).collect()) == ["b", "c"]
