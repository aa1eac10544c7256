"""Line dedup against a plain version: ties, repeats, nulls, long texts, heavy lines."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from sextant.llm import lines

SHARED = ["A line that many hold", "  a LINE that many hold\t", "short", "", "Ünïcode line ÄÖ", "ünïcode line äö", "exactly10!", "nine char"]


def rows():
    rng = random.Random(5)
    made = [(k, "\n".join(rng.choice([*SHARED, f"own line of {k} / {j}", f"pair line {(k * 7 + j) // 9}"]) for j in range(rng.randrange(1, 30))))
            for k in range(60)]
    same = "only two rows of one id hold this\nA line that many hold"
    return [*made, (7, None), (8, ""), (200, same), (200, same), (200, "only two rows of one id hold this\nx"), (None, same), (None, "a line only null ids hold"),
            (None, "a line only null ids hold\nmore of it here"), (300, "\n" * 500), (301, "A line that many hold\r\n\r\nA line that many hold"),
            (302, "\n".join(f"very long text, line {j % 7000}" for j in range(40_000))), (303, "very long text, line 6999\nnew line in 303"), (-4, "new line in 303")]


@pytest.mark.parametrize(("sample", "heavy"), [(16, 256), (1, 2), (1, 5)])
def test_equals_plain_version(spark, sample, heavy):
    df = spark.createDataFrame(rows(), "doc_id long, text string").repartition(7)
    df = df.withColumn("key", F.lit(1)).withColumn("pos", F.lit("x")).withColumn("doc", F.lit(2)).withColumn("_ROW", F.lit(0))
    out, n_lines, n_dropped = lines.drop_repeats(df, sample=sample, heavy=heavy)
    assert out.columns == [*df.columns, n_lines, n_dropped]
    want = brute.line_dedup(rows())
    got = sorted(((r["doc_id"], r[n_lines], r[n_dropped], r["text"] or "") for r in out.collect()), key=repr)
    assert got == sorted(((doc, *want[doc, text]) for doc, text in rows()), key=repr)


def test_bitmaps_are_maximal_runs(spark):
    first, second = "\n".join(f"shared line {k}" for k in range(9)), ["shared line 0", "own line here", *[f"shared line {k}" for k in range(1, 5)], "shared line 1"]
    df = spark.createDataFrame([(1, first), (2, "\n".join(second))], "doc_id long, text string")
    out = lines.keep_bitmaps(df).collect()
    assert [(r["doc"], r["n_dropped"], [tuple(x) for x in r["dropped"]]) for r in out] == [(2, 6, [(0, 0), (2, 6)])]


def test_empty_table_and_plan(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lines.keep_bitmaps(df).count() == 0 and lines.report(df).count() == 0
    plan = lines.report(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
