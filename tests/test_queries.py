"""Every query with SQL gives DuckDB's rows on the smallest tables; the others run."""

import duckdb
import pytest

import __spark_entry__ as entry
from kham.plans import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(f"{r[i]:.9g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_query(spark, db, name):
    df = entry.queries()[name](spark, SF)
    got = rows(df.columns, df.collect())
    assert got
    if name in Q.SQL:
        c = db.execute(Q.SQL[name])
        names = [x[0] for x in c.description]
        assert sorted(names) == sorted(df.columns)
        assert got == rows(names, c.fetchall())


def test_glyph_bucket_merge_takes_whole_lines(spark):
    lines = Q.D.doc_lines(spark, SF).select("doc_id", "line", "text").collect()
    by_line = {}
    for r in lines:
        by_line.setdefault((r["doc_id"], r["line"]), []).extend(((p * 6 + p // 11 * 4) * 0.1, p, c) for p, c in enumerate(r["text"]))
    want = []
    for key, entries in by_line.items():
        buckets = []
        for x, _, c in sorted(entries):
            if buckets and abs(buckets[-1][0] - x) <= 1.0:
                buckets[-1][1] += c
            else:
                buckets.append([x, c])
        want += [(*key, i, x, c) for i, (x, c) in enumerate(buckets)]
    got = [tuple(r) for r in Q.QUERIES["glyph_bucket_merge"](spark, SF).select("doc_id", "line", "bucket", "x", "ch").collect()]
    assert sorted(got) == sorted(want) and max(len(r["text"]) for r in lines) > 40


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_table_functions(spark):
    from pyspark.sql import functions as F

    from kham.functions import text as T
    from kham.streaming import analyze

    analyze.register(spark)
    spark.createDataFrame([(1, "้กา"), (2, "ก้ั"), (3, "ก็่้า"), (4, "น้ำใจ"), (5, None), (6, "")], "id int, t string").createOrReplaceTempView("said")
    got = {(r["id"], r["kind"], r["idx"]) for r in spark.sql("SELECT id, i.* FROM said, LATERAL audit_issues(t) i").collect()}
    assert got == {(1, "orphan_mark", 0), (2, "reorder", 2), (3, "multi_tone", 3)}
    assert {(r["id"], r["n"]) for r in spark.sql("SELECT id, size(thai_audit(t)) AS n FROM said").collect()} == {(1, 1), (2, 1), (3, 1), (4, 0), (5, 0), (6, 0)}
    assert spark.sql("SELECT thai_codepoints('กา', 1) AS c").head()["c"] == "U+0E01 ..."
    text = "ก้ั้ ่ํา" * 3
    row = spark.createDataFrame([(text,)], "t string").select(T.audit(F.col("t")).alias("a")).head()["a"]
    kinds = [k for k, *_ in T.audited(text)]
    assert row.asDict() == {k: kinds.count(k) for k in row.asDict()}


def test_source_items_pad_and_skip(spark):
    from kham.operators import compose

    cells = spark.createDataFrame([(1, 0, 0, 0, 0, "a", 5.0), (1, 0, 0, 0, 2, "c", 5.0), (1, 0, 0, 1, 0, None, 6.0), (1, 0, 0, 2, 1, "z", 7.0)], "doc_id long, page long, table long, row long, col int, value string, y0 double")
    paras = spark.createDataFrame([(1, 0, 0, 9.0, "after"), (1, 0, 1, 5.0, "tie"), (1, 0, 2, 1.0, " ")], "doc_id long, page long, para long, y0 double, text string")
    got = compose.source_items(paras, compose.table_rows(cells, ["doc_id", "page"])).orderBy("idx").collect()
    assert [(r["idx"], r["kind"], r["text"]) for r in got] == [(0, 0, "tie"), (1, 1, "a\t\tc"), (2, 1, "\tz\t"), (3, 0, "after")]


def test_ocr_totals_of_halves(spark):
    from kham.operators import compose

    c = [65.0, 47.0, 37.166667, 69.0, 50.5, 70.333333]  # their mean is 56.5, their doubles added in this order give less
    p = spark.createDataFrame([(1, "ocr", x) for x in c] + [(1, "text", 1.0), (2, "text", 9.0), (3, "ocr", None), (3, "ocr", 1.0)], "doc_id long, source string, confidence double").coalesce(1)
    got = {r["doc_id"]: (r["ocr_pages"], r["confidence"]) for r in compose.ocr_totals(p, "doc_id").collect()}
    assert got == {1: (6, 57), 2: (0, None), 3: (2, 1)}


def test_convert_verify_shuffles_documents_once(spark):
    plan = entry.queries()["convert_verify"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1  # written, read and compared in one pass
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 64


def test_docx_pairs(spark):
    from kham.operators import quality
    from kham.sources import office

    items = spark.createDataFrame([(1, 0, 0, "a"), (1, 1, 1, "b\tc"), (2, 0, 0, "x\x01y"), (2, 1, 0, "p\nq"), (3, 0, 1, "r\ns")], "doc_id long, idx int, kind int, text string")
    back = office.read_docx(office.write_docx(items, "doc_id", "idx"))
    want, _ = quality.positional_verify(items.select("doc_id", "idx", "text"), back)
    got, _ = quality.verify_pairs(office.docx_pairs(items))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))
