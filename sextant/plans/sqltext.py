"""DuckDB text of the panels, shared by the comparison queries."""

from __future__ import annotations

WEEKLY = """panel AS (
  SELECT ts, symbol, c / (n * 100000.0::DOUBLE) AS close, c / 100000.0::DOUBLE AS volume,
         floor(epoch(ts) / 604800)::BIGINT AS pos
  FROM (SELECT date_trunc('week', o_orderdate)::TIMESTAMP AS ts,
               'N' || lpad(c_nationkey::VARCHAR, 2, '0') AS symbol,
               sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS c, count(*) AS n
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2))"""

DAILY = """bars AS (
  SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS ts, o_orderpriority AS symbol,
         arg_min(round(o_totalprice * 100)::BIGINT / 100000.0::DOUBLE, o_orderkey) AS open,
         max(round(o_totalprice * 100)::BIGINT / 100000.0::DOUBLE) AS high,
         min(round(o_totalprice * 100)::BIGINT / 100000.0::DOUBLE) AS low,
         arg_max(round(o_totalprice * 100)::BIGINT / 100000.0::DOUBLE, o_orderkey) AS close,
         count(*)::DOUBLE AS volume,
         sum(round(o_totalprice * 100)::BIGINT)::BIGINT / 100000.0::DOUBLE AS quote,
         floor(epoch(date_trunc('day', o_orderdate)::TIMESTAMP) / 86400)::BIGINT AS pos
  FROM orders GROUP BY date_trunc('day', o_orderdate), o_orderpriority)"""

HOURLY = """bars AS (
  SELECT date_trunc('hour', ts)::TIMESTAMP AS ts, event_type AS symbol,
         arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, (ts, event_id)) AS close, count(*)::DOUBLE AS volume,
         sum(round(value * 100)::BIGINT)::BIGINT / 100.0::DOUBLE AS quote,
         coalesce(sum(round(value * 100)::BIGINT) FILTER (user_id % 2 = 0), 0)::BIGINT / 100.0::DOUBLE AS taker,
         floor(epoch(date_trunc('hour', ts)::TIMESTAMP) / 3600)::BIGINT AS pos
  FROM events GROUP BY date_trunc('hour', ts), event_type)"""

USER_BARS = """bars AS (
  SELECT date_trunc('minute', ts)::TIMESTAMP AS ts, user_id::VARCHAR AS symbol, arg_max(value, (ts, event_id)) AS close,
         floor(epoch(date_trunc('minute', ts)::TIMESTAMP) / 60)::BIGINT AS pos
  FROM events GROUP BY date_trunc('minute', ts), user_id)"""

FUNDING_RAW = """raw_funding AS (
  SELECT event_type AS symbol,
         (date_trunc('day', ts)::TIMESTAMP + to_hours((hour(ts) // 8 * 8)::INTEGER)) AS funding_time,
         (value - 50) / 100000.0::DOUBLE AS funding_rate,
         CASE WHEN event_id % 17 <> 0 THEN value END AS mark_price, event_id AS seq
  FROM events)"""

FUNDING = FUNDING_RAW + """,
funding AS (
  SELECT symbol, funding_time, funding_rate, mark_price FROM raw_funding
  QUALIFY row_number() OVER (PARTITION BY symbol, funding_time ORDER BY seq DESC) = 1)"""

POSITIONS = """positions AS (
  SELECT date_trunc('day', l_shipdate)::TIMESTAMP AS ts, 'S' || lpad(l_suppkey::VARCHAR, 4, '0') AS symbol,
         sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) AS quantity,
         sum(round(l_extendedprice * 100)::BIGINT)::BIGINT / 100000.0::DOUBLE AS value,
         floor(epoch(date_trunc('day', l_shipdate)::TIMESTAMP) / 86400)::BIGINT AS pos
  FROM lineitem GROUP BY date_trunc('day', l_shipdate), l_suppkey)"""

# one-bar return on the regular calendar: the earlier bar has to exist
RETURNS = """rets AS (
  SELECT p.ts, p.symbol, p.pos, p.close, p.close / nullif(q.close, 0) - 1 AS ret
  FROM panel p LEFT JOIN panel q ON q.symbol = p.symbol AND q.pos = p.pos - 1)"""


def query(*ctes: str, select: str, recursive: bool = False) -> str:
    if not ctes:
        return select
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(ctes) + "\n" + select


def ewma_cte(name: str, source: str, value: str, span: float, min_bars: int = 1, adjust: bool = False,
             keys: str = "symbol", keep: str = "ts, pos") -> str:
    """Two CTEs: the recursion by row of each series and its shown part ``name`` (keys, keep, y)."""
    alpha = 2.0 / (span + 1.0)
    on = " AND ".join(f"r.{k.strip()} = n.{k.strip()}" for k in keys.split(","))
    rk = ", ".join(f"n.{k.strip()}" for k in keys.split(","))
    nk = ", ".join(f"n.{k.strip()}" for k in keep.split(","))
    grow = f"pow({1 - alpha!r}, n.pos - r.pos)"
    # state: num / den; with adjust=False the weight of the past restarts at 1 on every value
    new = "1.0" if adjust else repr(alpha)
    decayed = f"CASE WHEN n.x IS NULL THEN r.wt * {grow} ELSE " + (
        f"r.wt * {grow} + 1.0" if adjust else "1.0") + " END"
    avg = (f"CASE WHEN n.x IS NULL THEN r.y WHEN r.y IS NULL THEN n.x ELSE "
           f"(r.y * r.wt * {grow} + {new} * n.x) / (r.wt * {grow} + {new}) END")
    return f"""{name}_n AS (
  SELECT {keys}, {keep}, {value} AS x, row_number() OVER (PARTITION BY {keys} ORDER BY pos) AS rn
  FROM {source}),
{name}_r AS (
  SELECT {keys}, {keep}, rn, x AS y, 1.0::DOUBLE AS wt, (x IS NOT NULL)::BIGINT AS seen FROM {name}_n WHERE rn = 1
  UNION ALL
  SELECT {rk}, {nk}, n.rn, {avg}, CASE WHEN r.y IS NULL THEN 1.0 ELSE {decayed} END, r.seen + (n.x IS NOT NULL)::BIGINT
  FROM {name}_r r JOIN {name}_n n ON {on} AND n.rn = r.rn + 1),
{name} AS (SELECT {keys}, {keep}, CASE WHEN seen >= {min_bars} THEN y END AS y FROM {name}_r)"""
