"""Pieces of DuckDB SQL that the oracles share."""

from __future__ import annotations

#: The fixtures as the engine's tables.
TICKS = """ticks AS (SELECT event_type AS symbol, event_id AS seq, epoch_us(ts) // 1000 AS ts_ms, cents, cents / 100.0e0 AS price, k AS lots, k / 100.0e0 AS volume, user_id % 2 = 0 AS is_buyer_maker
    FROM (SELECT *, 6000000 + CAST(floor(CAST(round(value * 100) AS BIGINT) / 10.0e0) AS BIGINT) AS cents, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events))"""
RAW = """raw AS (SELECT event_type AS symbol, event_id AS seq, epoch_us(ts) // 1000 AS ts_ms, value AS price, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS lots FROM events)"""
MESSAGES = """messages AS (SELECT seq, l_returnflag AS symbol, epoch_us(l_shipdate) // 1000 AS timestamp, type, CASE WHEN type = 1 THEN seq ELSE greatest(seq - 1 - l_partkey % 50, 0) END AS order_id,
    CAST(l_suppkey % 2 AS INTEGER) AS side, CAST(floor(l_extendedprice / l_quantity) AS BIGINT) AS price, CAST(l_quantity AS BIGINT) AS qty
    FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus) AS seq,
        CASE WHEN l_linenumber < 6 THEN 1 WHEN l_linenumber = 6 THEN 2 ELSE 3 END AS type FROM lineitem))"""
REGISTRY = """registry AS (SELECT s_suppkey AS id, 'c' || s_nationkey || '-usd/t' AS raw_symbol, 'model_' || s_suppkey AS model_filename,
    CASE s_suppkey % 4 WHEN 0 THEN '{"max_inventory": ' || (s_suppkey % 7 + 4) || '.0, "base_trade_size": 0.' || (s_suppkey % 5 + 1) || ', "kappa": ' || (s_suppkey % 3 + 1) || '.5}'
        WHEN 1 THEN '{"max_inventory": ' || (s_suppkey % 7 + 4) || '.0}' WHEN 2 THEN '{}' END AS hyperparameters, 1700000000 + s_suppkey * 7919 % 100003 AS created_at FROM supplier)"""
LATEST = """latest AS (SELECT *, upper(regexp_replace(raw_symbol, '[/-]', '', 'g')) AS symbol FROM registry QUALIFY row_number() OVER (PARTITION BY raw_symbol ORDER BY created_at DESC, id DESC) = 1)"""
SYMBOLS = """symbols AS (SELECT 'C' || n_nationkey || 'USDT' AS symbol, CASE WHEN n_nationkey % 3 = 0 THEN '{"max_inventory": ' || (n_nationkey % 5 + 1) || '.0, "kappa": 2.5}' END AS sidecar FROM nation)"""


def number(json: str, key: str) -> str:
    return f"""TRY_CAST(regexp_extract({json}, '"{key}": ([0-9.]+)', 1) AS DOUBLE)"""


def r4(*columns: str) -> str:
    return ", ".join(f"round({c}, 4) AS {c}" for c in columns)


def candles(seconds: int) -> str:
    return f"""candles AS (SELECT symbol, ts_ms // {seconds * 1000} * {seconds} AS time, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, CAST(sum(lots) AS BIGINT) / 100.0e0 AS volume
    FROM raw GROUP BY symbol, ts_ms // {seconds * 1000})"""


def rolling(zero_slot: bool) -> str:
    slots = "CASE WHEN n > 1 AND n < 100 THEN n + 1 ELSE n END" if zero_slot else "n"
    return f"""sums AS (SELECT symbol, seq, count(*) OVER w AS n, sum(cents) OVER w AS s1, sum(cents * cents) OVER w AS s2 FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)),
vol AS (SELECT symbol, seq, n, CASE WHEN n = 1 THEN 0.1e0 ELSE greatest(sqrt(CAST(CAST(c * s2 - s1 * s1 AS BIGINT) AS DOUBLE) / CAST(c * c AS DOUBLE)) / 100.0e0, 0.1e0) END AS sigma FROM (SELECT *, {slots} AS c FROM sums))"""


#: Ticks with the deviation that a live quoter knows.
KNOWN = f"""{TICKS}, known AS (SELECT symbol, seq, ts_ms, price, k, CASE WHEN k = 1 THEN 0.1e0 ELSE greatest(sqrt(CAST(CAST(c * s2 - s1 * s1 AS BIGINT) AS DOUBLE) / CAST(c * c AS DOUBLE)) / 100.0e0, 0.1e0) END AS sigma
    FROM (SELECT symbol, seq, ts_ms, price, k, CASE WHEN k < 100 THEN k + 1 ELSE 100 END AS c, coalesce(sum(cents) OVER w, 0) + CASE WHEN k <= 100 THEN first ELSE 0 END AS s1,
        coalesce(sum(cents * cents) OVER w, 0) + CASE WHEN k <= 100 THEN first * first ELSE 0 END AS s2
        FROM (SELECT *, row_number() OVER o AS k, first_value(cents) OVER o AS first FROM ticks WINDOW o AS (PARTITION BY symbol ORDER BY seq))
        WINDOW w AS (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)))"""
QUOTED = f"""{KNOWN}, g AS (SELECT *, 0.1e0 * (60000.0e0 / greatest(price, 1.0e0)) AS gamma, ((seq % 21) - 10) / 2.0e0 AS inventory FROM known),
quoted AS (SELECT *, (gamma * sigma * sigma + (2.0e0 / gamma) * ln(1.0e0 + gamma / 1.5e0)) / 2 AS half, price - inventory * gamma * sigma * sigma AS reservation FROM g)"""


#: Ticks with the deviation that a replay knows: its start consumes a symbol's first tick, so steps begin with the second.
REPLAYED = f"""{TICKS}, known AS (SELECT symbol, seq, ts_ms, price, r - 1 AS k, CASE WHEN r = 2 THEN 0.1e0 ELSE greatest(sqrt(CAST(CAST(c * s2 - s1 * s1 AS BIGINT) AS DOUBLE) / CAST(c * c AS DOUBLE)) / 100.0e0, 0.1e0) END AS sigma
    FROM (SELECT *, CASE WHEN seen < 100 THEN seen + 1 ELSE 100 END AS c
        FROM (SELECT symbol, seq, ts_ms, price, row_number() OVER (PARTITION BY symbol ORDER BY seq) AS r, count(*) OVER w AS seen, sum(cents) OVER w AS s1, sum(cents * cents) OVER w AS s2
            FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING))) WHERE r > 1)"""


def sim(live: bool = True, quoting: str = "true", start: float = 1_000_000, base: float = 0.5, most: float = 10, actions: tuple = ((0, 0.1, 1.0),)) -> str:
    """``steps``: the quoter's recurrence, a row a step and action (number, gamma, spread), by a recursive query."""
    plan = ", ".join(f"({n}, {g}e0, {s}e0)" for n, g, s in actions)
    again = "pbid = 0 OR abs(px - panchor) / greatest(px, 1.0e0) > 0.0003e0" + ("" if live else " OR true")
    return f"""{KNOWN if live else REPLAYED}, plan AS (SELECT * FROM (VALUES {plan}) t(action, gamma0, spread)),
state AS (
    SELECT action, gamma0, spread, symbol, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS ts_ms, price AS mid, true AS is_quoting, 0.0e0 AS qbid, 0.0e0 AS qask, CAST(NULL AS VARCHAR) AS side, 0.0e0 AS size, 0.0e0 AS paid,
        CAST(NULL AS DOUBLE) AS realized, {start}e0 AS cash, 0.0e0 AS inventory, CAST(0 AS BIGINT) AS lots, 0.0e0 AS average, {start}e0 AS net_worth, 0.0e0 AS gained, 0.0e0 AS reward, false AS ended, 0.0e0 AS rbid, 0.0e0 AS rask, price AS anchor
    FROM known, plan WHERE k = 1
    UNION ALL
    SELECT action, gamma0, spread, symbol, k, seq, ts_ms, px, quoting, qbid, qask, CASE d WHEN 1 THEN 'BUY' WHEN -1 THEN 'SELL' END, CASE WHEN d <> 0 THEN sz ELSE 0.0e0 END, paid,
        CASE WHEN d <> 0 AND pinv * d < 0 THEN (pavg - paid) * d * least(sz, abs(pinv)) END, cash, inv, plots + d,
        CASE WHEN d = 0 THEN pavg WHEN pinv * d >= 0 THEN (pavg * abs(pinv) + paid * sz) / (abs(pinv) + sz) WHEN sz > abs(pinv) THEN paid ELSE pavg END,
        worth, worth - pworth, worth - pworth - 0.1e0 * inv * inv - CASE WHEN worth < {start}e0 * 0.8e0 THEN 100000.0e0 ELSE 0.0e0 END, worth < {start}e0 * 0.8e0,
        CASE WHEN d <> 0 THEN 0.0e0 ELSE qbid END, qask, anchor
    FROM (SELECT *, cash + inv * px AS worth FROM (
        SELECT *, pcash - (d * (paid * sz) + (paid * sz) * -0.0001e0) * (CASE WHEN d = 0 THEN 0 ELSE 1 END) AS cash, pinv + d * sz AS inv FROM (
        SELECT *, CASE d WHEN 1 THEN qbid WHEN -1 THEN qask ELSE 0.0e0 END AS paid FROM (
        SELECT *, CASE WHEN quoting AND px <= qbid AND pinv + sz <= {most}e0 THEN 1 WHEN quoting AND px >= qask AND pinv - sz >= -{most}e0 THEN -1 ELSE 0 END AS d FROM (
        SELECT *, CASE WHEN NOT quoting THEN 0.0e0 WHEN fresh THEN px - half ELSE pbid END AS qbid, CASE WHEN NOT quoting THEN 0.0e0 WHEN fresh THEN px + half ELSE pask END AS qask, CASE WHEN quoting AND fresh THEN px ELSE panchor END AS anchor FROM (
        SELECT *, least(greatest((gamma * sigma * sigma + (2.0e0 / gamma) * ln(1.0e0 + gamma / 1.5e0)) * spread / 2.0e0, px * 0.00003e0), px * 0.0001e0) AS half,
            {base}e0 * least(greatest(greatest(px * 0.005e0, 0.01e0) / greatest(sigma, 0.01e0), 0.2e0), 1.0e0) AS sz, ({again}) AS fresh FROM (
        SELECT s.action, s.gamma0, s.spread, n.symbol, n.k, n.seq, n.ts_ms, n.price AS px, n.sigma, s.gamma0 * (60000.0e0 / greatest(n.price, 1.0e0)) AS gamma, (n.{quoting}) AS quoting,
            s.cash AS pcash, s.inventory AS pinv, s.lots AS plots, s.average AS pavg, s.net_worth AS pworth, s.rbid AS pbid, s.rask AS pask, s.anchor AS panchor
        FROM state s JOIN known n ON n.symbol = s.symbol AND n.k = s.k + 1 WHERE NOT s.ended)))))))
),
steps AS (SELECT *, qbid AS bid, qask AS ask FROM state WHERE k > 0)""".replace("(n.true)", "true")


def sweep(actions: list, **parameters) -> str:
    return sim(actions=tuple(actions), **parameters)


FILLS = "fills AS (SELECT symbol, seq, ts_ms AS time, side, round(paid, 2) AS price, round(size, 4) AS size, CASE WHEN side = 'SELL' THEN round(gained, 2) ELSE 0.0e0 END AS realized_pnl FROM steps WHERE side IS NOT NULL)"
MARKERS = """markers AS (SELECT symbol, seq, time // 1000 AS time, CASE side WHEN 'BUY' THEN 'belowBar' ELSE 'aboveBar' END AS position, CASE side WHEN 'BUY' THEN '#10B981' ELSE '#EF4444' END AS color,
    CASE side WHEN 'BUY' THEN 'arrowUp' ELSE 'arrowDown' END AS shape, side AS text FROM fills)"""
