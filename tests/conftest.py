import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from sextant.session import build_session

    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.log.level": "ERROR",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def panel(spark):
    """Three series of 400 bars with gaps, as (ts, symbol, pos, close) and as a wide pandas frame."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(7)
    index = pd.date_range("2020-01-01", periods=400, freq="D")
    wide = pd.DataFrame({s: 100 + np.cumsum(rng.normal(0, 1, 400)) for s in ("A", "B", "C")}, index=index)
    wide = wide.mask(rng.random(wide.shape) < 0.12)
    wide.iloc[:40, 2] = np.nan
    from sextant.functions import timeaxis as T

    long = wide.stack().rename("close").reset_index()
    long.columns = ["ts", "symbol", "close"]
    df = spark.createDataFrame(long, "ts timestamp_ntz, symbol string, close double")
    return T.with_pos(df, T.DAY).cache(), wide


def as_wide(df, value):
    """(ts, symbol, value) as a wide pandas frame."""
    return df.select("ts", "symbol", value).toPandas().pivot(index="ts", columns="symbol", values=value).astype(float)
