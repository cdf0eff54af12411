import json

import pytest
from pyspark.sql import functions as F

from wordmill.operators import fuzzy
from wordmill.sources import lexicon, tables
from wordmill.streaming import coverage


def test_ending_tables(spark, tmp_path):
    (tmp_path / "inc").mkdir()
    (tmp_path / "inc" / "b.tf").write_text(".table tail\n0, 1\nся, 2\n")
    (tmp_path / "a.tf").write_text("// endings\n.include inc/b.tf\n.table verb\n{\nю, 4, tail\nешь, , , 3\n}\n")
    rows = tables.parse_tables(tables.read_table_lines(tmp_path / "a.tf"), lambda t, before: int(t))
    got = {tuple(r) for r in tables.expand_endings(tables.ending_rows(spark, rows)).where("name = 'verb'").collect()}
    assert got == {("verb", "ю", 5, 0xFF), ("verb", "юся", 6, 0xFF), ("verb", "ешь", 4, 3)}
    with pytest.raises(ValueError, match="itself"):
        tables.expand_endings(tables.ending_rows(spark, [("x", "a", 0, "x", 255)]))


def test_equal_tables_and_alternations(spark):
    rows = [("b", "а", 1, 255), ("a", "а", 1, 255), ("c", "о", 1, 255)]
    same = {tuple(r) for r in tables.equal_tables(spark.createDataFrame(rows, "name string, ending string, grammar int, flags int")).collect()}
    assert same == {("a", "a"), ("b", "a"), ("c", "c")}
    alt = tables.alternations(spark.createDataFrame([("m", 1, "ж"), ("m", 2, "г"), ("m", 3, "ж")], "name string, level int, text string"))
    assert {tuple(r) for r in alt.collect()} == {("m", "ж", 5), ("m", "г", 2)}
    stems = spark.createDataFrame([(1, "но", "m", "t", None)], "lexeme_id long, stem string, alt string, table string, postfix string")
    ends = spark.createDataFrame([("t", "ка", 7, 2), ("t", "ек", 8, 1)], "name string, ending string, grammar int, level int")
    assert {r.form for r in tables.build(stems, alt, ends).collect()} == {"ногка", "ножек"}


def test_russian_lines_and_marks(spark):
    rows = [("ёл=ка м жо 3а//3б слово -разг- post:-то",), ("x",)]
    got = tables.russian_lines(spark.createDataFrame(rows, "line string")).collect()
    assert [(r.normal, r["index"], r.remark, r.postfix) for r in got] == [("елка", "3а", "разг", "-то"), ("елка", "3б", "разг", "-то")]
    r = spark.range(1).select(tables.flags(F.lit("разг. груб."), {"разг": 0x200, "груб": 0x400, "мн": 0x40}).alias("f"), tables.case_scale(F.lit("рд"), "ирдвтп").alias("c")).first()
    assert (r.f, r.c) == (0x600, 6)
    marks = tables.preferred(spark.createDataFrame([("a +++ LID:5",), ("b --- LID:6",), ("c LID:7",)], "line string"))
    assert {tuple(x) for x in marks.collect()} == {(5, "+"), (6, "-")}


def test_class_files_round_trip(spark, tmp_path):
    extracted = fuzzy.extract(lexicon.forms(spark))
    classed = fuzzy.classes(extracted)
    rows = tables.class_json(classed, fuzzy.models(extracted, classed), fuzzy.endings(classed)).collect()
    (tmp_path / "c.json").write_text(json.dumps({"classes": [json.loads(r.json) for r in rows]}))
    back = tables.read_classes(spark, str(tmp_path / "c.json")).collect()
    assert {r.class_id for r in back} == {r.class_id for r in rows} and all(r.models and r.inflex for r in back)
    (tmp_path / "bad.json").write_text('{"classes":[{"partSp":1,"index":3,"models":[{"suffix":"abc"}],"inflex":[{"id":0,"sz":""}]}]}')
    with pytest.raises(Exception, match="bad class 3"):
        tables.read_classes(spark, str(tmp_path / "bad.json")).collect()


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(f"2024-01-0{d} 10:00:00", "the click was zzz") for d in (1, 1, 2)], "ts string, text string").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(f"{tmp_path}/in")
    forms = lexicon.forms(spark)
    batch = {tuple(r) for r in coverage.windowed(rows, forms, "ts", "text").collect()}
    stream = coverage.windowed(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), forms, "ts", "text")
    query = stream.writeStream.format("memory").queryName("cov").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").start()
    query.processAllAvailable()
    query.stop()
    assert {tuple(r) for r in spark.table("cov").collect()} == batch and sum(r[1] for r in batch) == 12 and sum(r[2] for r in batch) == 9
