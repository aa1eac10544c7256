"""Supplier keys of five digits: the SQL's ``lpad`` cuts them, so several suppliers share a name."""

import duckdb
import oracle
import pytest

import __spark_entry__ as E
from sextant.plans import panels as P

SF = "/root/testdata/sf0.001"
# suppliers 0 to 9 become 996 to 1005; a second copy of the tables has them as 10000 to 10009, all named S1000
SHIFT = "CASE WHEN copy = 0 THEN {key} + 996 ELSE {key} + 10000 END"


@pytest.fixture(scope="module")
def wide(tmp_path_factory):
    folder = tmp_path_factory.mktemp("wide")
    con = duckdb.connect()
    for name in oracle.TABLES:
        source = f"SELECT * FROM '{SF}/{name}.parquet'"
        if name in ("supplier", "lineitem"):
            key = f"{name[0]}_suppkey"
            # other prices in the copy, since the SQL leaves the order of equal rows of a bar open
            price = ", l_extendedprice + copy * l_quantity AS l_extendedprice" if name == "lineitem" else ""
            source = f"SELECT x.* REPLACE ({SHIFT.format(key=key)} AS {key}{price}) FROM ({source}) x, range(2) g(copy)"
        con.execute(f"COPY ({source}) TO '{folder}/{name}.parquet'")
    assert con.execute(f"SELECT min(s_suppkey), max(s_suppkey) FROM '{folder}/supplier.parquet'").fetchone() == (996, 10009)
    return str(folder)


@pytest.mark.parametrize("name", (
    "b14_coverage_stats", "b22_eligible_symbols", "g01_size_positions_short", "g16_round_quantity", "g17_rounded_portfolio",
    "g18_rebalance_sheet", "g20_group_attribution", "g22_exposure", "g22_net_exposure", "k13_holdings_weekly"))
def test_names_cut_to_four_digits(spark, wide, name):
    problem, rows = oracle.compare(E.queries()[name](spark, wide), oracle.connect(wide), E.oracle_sql()[name])
    assert problem is None and rows > 0, problem


def test_means_over_rows_that_share_a_bar(spark, wide):
    rows = sorted((r.pos, r.value) for r in P.positions(spark, wide).filter("symbol = 'S1000'").collect())
    want = {}
    for span, least in ((2, 2), (32, 32)):
        alpha, y, last = 2 / (span + 1), None, None
        for i, (pos, x) in enumerate(rows):
            aged = None if y is None else (1 - alpha) ** (pos - last)
            y, last = x if y is None else (y * aged + alpha * x) / (aged + alpha), pos
            want.setdefault(pos, {}).setdefault(span, []).append(y if i + 1 >= least else None)
    df = E.queries()["d05_ewma_null_runs"](spark, wide)
    n = oracle.connect(wide).execute(E.oracle_sql()["d05_ewma_null_runs"]).fetchall()
    assert df.count() == len(n)
    got = {}
    for r in df.filter("symbol = 'S1000'").collect():
        got.setdefault(r.pos, []).append((r.fast, r.slow))
    key = lambda t: tuple((v is None, v or 0.0) for v in t)
    for pos, w in want.items():
        pairs = sorted(((a, b) for a in w[2] for b in w[32]), key=key)
        mine = sorted(got[pos], key=key)
        assert len(mine) == len(pairs)
        assert sorted(f or 0 for f, _ in mine) == pytest.approx(sorted(a or 0 for a, _ in pairs), abs=2e-6)
        assert sorted(s or 0 for _, s in mine) == pytest.approx(sorted(b or 0 for _, b in pairs), abs=2e-6)


@pytest.fixture(scope="module")
def pooled(tmp_path_factory):
    """Suppliers 10010 to 10019 are all S1001: each has 12 rows and a small size, together they have 120 and the largest."""
    folder = tmp_path_factory.mktemp("pooled")
    con = duckdb.connect()
    con.execute(f"""COPY (
      SELECT k AS l_suppkey, TIMESTAMP '1995-01-02' + to_days(d::INTEGER) AS l_shipdate, 'N' AS l_returnflag,
        CASE WHEN k < 10000 THEN 10.0::DOUBLE ELSE 40.0::DOUBLE END AS l_quantity, (1000 + k)::DOUBLE AS l_extendedprice
      FROM (SELECT unnest(range(2000, 2030)) AS k UNION ALL SELECT unnest(range(10010, 10020))), range(100) g(d)
      WHERE d < CASE WHEN k >= 10000 THEN 12 WHEN k % 2 = 0 THEN 100 ELSE 50 END) TO '{folder}/lineitem.parquet'""")
    return str(folder)


def lineitem_only(folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet'")
    return con


def test_least_rows_are_those_of_a_name(spark, pooled):
    df = E.queries()["b22_eligible_symbols"](spark, pooled)
    problem, _ = oracle.compare(df, lineitem_only(pooled), E.oracle_sql()["b22_eligible_symbols"])
    assert problem is None, problem
    got = {r.symbol: r.n for r in df.collect()}
    assert got["S1001USDT"] == 120 and "S2001USDT" not in got


@pytest.fixture(scope="module")
def unfilled(tmp_path_factory):
    """Lines without a quantity, for supplier 3 all of them."""
    folder = tmp_path_factory.mktemp("unfilled")
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT * REPLACE (CASE WHEN l_suppkey <> 3 AND l_linenumber <> 2 THEN l_quantity END AS l_quantity)
      FROM '{SF}/lineitem.parquet') TO '{folder}/lineitem.parquet'""")
    con.execute(f"COPY (SELECT * FROM '{SF}/supplier.parquet') TO '{folder}/supplier.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", ("g16_round_quantity", "g17_rounded_portfolio", "g18_rebalance_sheet"))
def test_missing_quantities(spark, unfilled, name):
    con = lineitem_only(unfilled)
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{unfilled}/supplier.parquet'")
    problem, rows = oracle.compare(E.queries()[name](spark, unfilled), con, E.oracle_sql()[name])
    assert problem is None and rows > 0, problem


def test_largest_names_are_ranked_together(spark, pooled):
    df = E.queries()["k13_holdings_weekly"](spark, pooled)
    problem, _ = oracle.compare(df, lineitem_only(pooled), E.oracle_sql()["k13_holdings_weekly"])
    assert problem is None, problem
    labels = {r.label for r in df.collect()}
    assert {"S1001", "OTHER_NET"} <= labels and len(labels) <= 19
