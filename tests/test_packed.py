"""Glyph operators over blocks give what those over rows give, and shuffle no glyphs."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from kham.operators import layout, packed
from kham.plans import queries as Q

SF = "/root/testdata/sf0.001"
NARROW = ["glyph_spacing", "span_spacing", "run_heal", "run_merge", "glyph_fix_nearest"]


@pytest.mark.parametrize("name", NARROW)
def test_no_glyph_is_shuffled(spark, name):
    assert "Exchange" not in entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_analysis_shuffles_texts_twice(spark):
    plan = entry.queries()["analyze_documents"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # lines, paragraphs


@pytest.mark.parametrize("name", NARROW)
def test_odd_documents(spark, tmp_path, name):
    docs = [(1, "jab wf \n\nxxnxx " * 5), (2, None), (3, ""), (4, "\n"), (5, "\n\n\nab cd ef gh ij kl"), (5, "abj\nxyz"), (None, "jjj abc abc abc"), (6, "ก้า é😀 x\r y" * 4), (7, "j" * 40), (8, "JB\x85  a")]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    df = entry.queries()[name](spark, str(tmp_path))
    got = sorted(tuple(map(str, r)) for r in df.collect())
    assert got
    if name in Q.SQL:
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({Q.SQL[name]})").fetchall()
        assert got == sorted(tuple(map(str, r)) for r in want)


def made(seed: int) -> tuple[list[tuple], packed.Glyphs]:
    """Random glyphs of 60 lines: marks, narrow and wide white space, characters without width, odd sizes."""
    rnd = random.Random(seed)
    rows = []
    for line in range(60):
        x = 0.0
        for pos in range(rnd.randint(1, 25)):
            c, w = rnd.choice("กขa   ้ัํ"), rnd.choice([0.0, 0.0, 0.005, 0.3, 6.0])
            x += rnd.choice([-4.0, 0.0, 0.0, 2.0, 3.0])
            rows.append((line, pos, c, x, x + w, rnd.choice([0.0, 8.0, 12.0])))
            x += w
    col = lambda k: np.array([r[k] for r in rows], float)
    return rows, packed.Glyphs(np.array([ord(r[2]) for r in rows], np.uint32), col(3), col(4), col(5), np.array([i for i, r in enumerate(rows) if r[1] == 0]))


def test_spacing_as_by_rows(spark):
    rows, g = made(1)
    df = layout.glyph_spacing(spark.createDataFrame(rows, "line int, pos int, c string, x0 double, x1 double, size double"), ["line"])
    assert packed.texts(*packed.spacing(g)).to_pylist() == [r["text"] for r in df.orderBy("line").collect()]


def test_runs_as_by_rows(spark):
    rnd = random.Random(2)
    runs = [(line, k, "".join(rnd.choice("กa ้ั") for _ in range(rnd.randint(1, 3))), rnd.random() < 0.5, 10.0 * k + rnd.choice([0, 3]), 10.0 * k + 10) for line in range(80) for k in range(rnd.randint(1, 9))]
    df = spark.createDataFrame(runs, "line int, run int, text string, bold boolean, x0 double, x1 double")
    n = np.cumsum([0, *(len(r[2]) for r in runs)])
    r = packed.Runs(np.array([ord(c) for x in runs for c in x[2]], np.uint32), n[:-1], np.array([x[0] for x in runs]))
    healed, kept = packed.heal_runs(r)
    want = layout.heal_runs(df, ["line"]).orderBy("line", "run").collect()
    assert [(runs[k][0], runs[k][1], t) for k, t in zip(kept, healed.texts().to_pylist(), strict=True)] == [(x["line"], x["run"], x["text"]) for x in want]
    merged, _, island = packed.merge_runs(r, np.array([x[3] for x in runs]))
    want = layout.merge_runs(df, ["line"], ["bold"]).orderBy("line", "island").collect()
    assert list(zip(merged.line.tolist(), island.tolist(), merged.texts().to_pylist(), strict=True)) == [(x["line"], x["island"], x["text"]) for x in want]
    need = packed.span_spaces(r, np.array([x[4] for x in runs]), np.array([x[5] for x in runs]), 12.0)
    df = df.selectExpr("*", "12.0D AS size", "text AS old")
    want = layout.span_spaces(df, ["line"], "run").orderBy("line", "run").collect()
    assert need.tolist() == [x["text"] != x["old"] for x in want] and need.any()


def test_nearest_fix_as_by_rows(spark):
    rnd = random.Random(3)
    glyphs = [(rnd.randint(0, 5), i, rnd.choice("ab"), rnd.randint(0, 40) / 8) for i in range(300)]
    fixes = sorted({(rnd.randint(0, 5), rnd.choice("ab"), rnd.randint(0, 40) / 8, rnd.randint(0, 3)) for _ in range(120)})
    last, numbered = None, []
    for line, c, x, ch in fixes:
        n = n + 1 if (line, c) == last else 1
        last = (line, c)
        numbered.append((line, c, x, str(ch), n))
    got = packed.nearest_fix(*(np.array(v) for v in ([g[0] for g in glyphs], [ord(g[2]) for g in glyphs], [g[3] for g in glyphs])), *(np.array(v) for v in ([f[0] for f in fixes], [ord(f[1]) for f in fixes], [f[2] for f in fixes], [f[3] for f in fixes])))
    g, b = spark.createDataFrame(glyphs, "line int, pos int, key string, ox double"), spark.createDataFrame(numbered, "line int, key string, x double, ch string, bucket int")
    want = {r["pos"]: r["fix"] for r in layout.nearest_fix(g, b, ["line", "key"], ["pos"]).collect()}
    assert [None if f < 0 else str(f) for f in got.tolist()] == [want[i] for i in range(300)] and (got >= 0).any() and (got < 0).any()


def test_empty_blocks():
    none = packed.Glyphs(np.zeros(0, np.uint32), *[np.zeros(0)] * 3, np.zeros(0, np.int64))
    assert packed.texts(*packed.spacing(none)) == pa.array([], pa.string())
