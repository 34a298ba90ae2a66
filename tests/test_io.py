"""Sources, sinks and streaming."""

from pyspark.sql import functions as F

from kham.operators import layout, quality
from kham.sources import office
from kham.streaming import analyze


def test_ocr_tsv(spark, tmp_path):
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n"
    (tmp_path / "a.tsv").write_text(head + "5\t1\t1\t1\t1\t1\t0\t0\t10\t10\t90.5\tกา\n5\t1\t1\t1\t1\t2\t30\t0\t10\t10\t60\t\"x\n5\t1\t1\t1\t1\t3\t50\t0\t10\t10\t-1\tz\n5\t1\t1\t1\t1\t4\t50\t0\t10\t10\tbad\tq\n5\t1\t1\t1\t1\t5\t50\t0\t10\t10\t80\t \n")
    words = office.read_ocr_tsv(spark, str(tmp_path))
    assert [r["text"] for r in words.orderBy("word").collect()] == ["กา", '"x']
    assert quality.ocr_lines(words, ["page"]).first()["text"] == 'กา "x'


def test_office_round_trip():
    items = [(0, "น้ำ <&> 1"), (1, "a\tb\nc\td"), (0, " ")]
    assert office.docx_items(office.docx_bytes(items)) == ["น้ำ <&> 1", "a\tb", "c\td"]
    assert office.xlsx_items(office.xlsx_bytes([(0, 0, "ก", None), (1, 27, "1,234.50", 1234.5)])) == ["ก", "1234.5"]


def test_stream(spark, tmp_path):
    docs = [(1, "น้ำ"), (2, "กํา"), (3, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    analyze.analyze_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r["doc_id"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[2]["fixed"] == "กำ" and got[2]["n_issues"] == 1 and got[1]["n_issues"] == 0 and got[3]["fixed"] is None


def test_heal_merge_and_verify(spark):
    runs = spark.createDataFrame([(1, 1, "ก"), (1, 2, "้"), (1, 3, "่า"), (1, 4, "")], "line int, run int, text string")
    assert [(r["run"], r["text"]) for r in layout.heal_runs(runs, ["line"]).orderBy("run").collect()] == [(1, "ก้่"), (3, "า")]
    e = spark.createDataFrame([(1, 0, "a  b"), (1, 1, "x")], "doc_id int, idx int, text string")
    g = spark.createDataFrame([(1, 0, "a b"), (1, 1, "y"), (1, 2, "z"), (1, 3, "w")], "doc_id int, idx int, text string")
    r, bad = quality.positional_verify(e, g)
    assert (r.first()["items_matched"], r.first()["mismatches"], bad.count()) == (1, 2, 2)
    b = quality.bag_match(e.select("doc_id", F.lit("1,234").alias("text")), e.select("doc_id", F.lit("1234").alias("text")))
    assert tuple(b.first())[1:] == (2, 2)


def test_spacing_rules(spark):
    g = [(0, "ก", 0.0, 6.0, None), (1, " ", 6.0, 6.1, None), (2, "ข", 6.0, 12.0, None), (3, "x", 16.0, 20.0, None), (4, " ", 20.0, 26.0, None), (5, " ", 26.0, 30.0, None), (6, "q", 30.0, 34.0, "น้")]
    df = spark.createDataFrame([(1, *x, 12.0) for x in g], "s int, pos int, c string, x0 double, x1 double, fix string, size double")
    assert layout.glyph_spacing(df, ["s"]).first()["text"] == "กข x น้"


def test_ocr_words_that_share_place_and_number(spark):
    kind = "page int, block int, par int, line int, word int, left int, top int, width int, height int, conf double, text string"
    said = [(1, 1, 1, 1, w, x, 0, 5, 10, 90.0, t) for w, x, t in ((1, 0, "x"), (2, 30, "b"), (2, 30, "a"), (2, 30, "a"))]
    for rows in (said, said[::-1], [said[2], said[0], said[1], said[3]]):
        assert quality.ocr_lines(spark.createDataFrame(rows, kind).coalesce(1), ["page"]).first()["text"] == "x aab"
