"""Statistics per segment against pandas on every history of its own."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sextant.operators import refits as R

REFITS = [(40, 0), (60, 0), (95, 20), (200, 150)]
LAG = 3
RULES = ["x", "y", "z"]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(9)
    out = []
    for s, (symbol, bars) in enumerate((("A", 120), ("B", 90), ("C", 180), ("D", 12), ("E", 120))):
        for pos in range(bars):
            ret = 0.01 if symbol == "E" else float(rng.normal(0.001, 0.02)) if rng.random() < 0.95 else None
            for r, rule in enumerate(RULES):
                value = 4.0 if symbol == "E" else float(rng.normal(0, 1 + r + s)) if rng.random() < 0.9 else None
                out.append((symbol, rule, pos, value, ret))
    return pd.DataFrame(out, columns=["symbol", "rule", "pos", "value", "ret"]).astype({"value": float, "ret": float})


@pytest.fixture(scope="module")
def tables(spark, rows):
    clean = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in rows.itertuples(index=False)]
    df = spark.createDataFrame(clean, "symbol string, rule string, pos long, value double, ret double").repartition(5)
    table = spark.createDataFrame(REFITS, "refit long, start long")
    scalars = [(refit, rule, s) for k, (refit, _) in enumerate(REFITS) for rule, s in zip(RULES, (2.0 + k, 5.0, 9.0 - 2 * k))]
    return df, table, spark.createDataFrame(scalars, "refit long, rule string, scalar double"), {(a, b): s for a, b, s in scalars}


def history(rows, refit, start):
    return rows[(rows.pos >= start) & (rows.pos < refit)]


def test_segments_cover_every_history(tables):
    h = R.Histories(tables[1], [LAG, 5])
    bars = {r.pos: r.seg for r in h.of(tables[0].select("pos").distinct()).collect()}
    cover = {}
    for r in h.cover(LAG).collect():
        cover.setdefault(r.refit, {})[r.seg] = r.known
    for refit, start in REFITS:
        assert {p for p, s in bars.items() if s in cover[refit]} == {p for p in range(180) if start <= p < refit}
        assert {p for p, s in bars.items() if cover[refit].get(s)} == {p for p in range(180) if start <= p < refit - LAG}


def test_medians(tables, rows):
    got = {(r.refit, r.rule): r.m for r in R.medians(tables[0], R.Histories(tables[1]), F.abs("value"), "m").collect()}
    want = {(refit, rule): part.value.abs().median() for refit, start in REFITS for rule, part in history(rows, refit, start).groupby("rule")}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


@pytest.mark.parametrize("cap", [20.0, 6.0])
def test_scores_with_caps_and_unknown_outcomes(tables, rows, cap):
    df, table, scalars, of = tables
    got = {(r.refit, r.rule): r.score for r in R.scores(df, R.Histories(table, [LAG]), scalars, cap, LAG).collect()}
    for refit, start in REFITS:
        h = history(rows, refit, start)
        for rule, part in h.groupby("rule"):
            pnl = (part.value * of[refit, rule]).clip(-cap, cap) / 10 * part.ret.where(part.pos + LAG < refit)
            each = pnl.groupby(part.symbol).agg(["mean", "std"])
            score = np.where(each["std"] > 1e-12, np.maximum(each["mean"] / each["std"], 0), 0.0)
            assert got.pop((refit, rule)) == pytest.approx(np.median(score), rel=1e-9, abs=1e-12)
    assert not got


@pytest.mark.parametrize("cap", [20.0, 6.0])
def test_correlations_of_capped_forecasts(tables, rows, cap):
    df, table, scalars, of = tables
    wide = df.groupBy("symbol", "pos").pivot("rule", RULES).agg(F.first("value"))
    got = {r.refit: r.corrs for r in R.rule_corrs(wide, R.Histories(table), scalars, RULES, cap).collect()}
    flat = rows.pivot(index=["symbol", "pos"], columns="rule", values="value").reset_index()
    for refit, start in REFITS:
        part = history(flat, refit, start)
        capped = pd.DataFrame({r: (part[r] * of[refit, r]).clip(-cap, cap) for r in RULES})
        want = [capped[["x", "y"]].corr().iloc[0, 1], capped[["x", "z"]].corr().iloc[0, 1], capped[["y", "z"]].corr().iloc[0, 1]]
        np.testing.assert_allclose(got.pop(refit), want, rtol=1e-9)
    assert not got


def test_no_refits(spark, tables):
    h = R.Histories(spark.createDataFrame([], "refit long, start long"), [LAG])
    assert h.of(tables[0]).count() == 0 and h.cover(LAG).count() == 0
    assert R.medians(tables[0], h, F.col("value"), "m").count() == 0
