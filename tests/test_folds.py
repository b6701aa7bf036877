"""The ordered folds against plain emulators written from the semantics, whatever the Arrow batch size."""

import random

import pytest

from tests.conftest import rows_of
from tickforge.operators import folds, series


class PlainBook:
    """Lists of [id, price, quantity, side] in order of arrival."""

    def __init__(self):
        self.orders = []

    def best(self, side):
        prices = [o[1] for o in self.orders if o[3] == side and o[2] > 0 and o[1] < 1_000_000]
        return (max if side == 0 else min)(prices, default=-1)

    def apply(self, kind, oid, side, price, qty):
        fills = []
        if kind == 1:
            while qty:
                best = self.best(1 - side)
                if best == -1 or (best > price if side == 0 else best < price):
                    break
                o = next(o for o in self.orders if o[3] == 1 - side and o[1] == best and o[2] > 0)
                n = min(qty, o[2])
                fills.append((o[0], best, n))
                o[2] -= n
                qty -= n
            if qty:
                self.orders.append([oid, price, qty, side])
        elif kind in (2, 3):
            for o in self.orders:
                if o[0] == oid and o[2] > 0 and o[1] < 1_000_000 and oid < 5_000_000:
                    o[2] = 0
                    break
        return fills


def random_messages(n, seed):
    r, out = random.Random(seed), []
    for symbol in "ab":
        for seq in range(n):
            kind = r.choices([1, 2, 3, 9], [70, 15, 10, 5])[0]
            oid = seq if kind == 1 else r.randrange(max(seq, 1))
            price = r.choice([r.randrange(95, 106), 1_000_001]) if r.random() < 0.05 else r.randrange(95, 106)
            out.append((symbol, seq, seq // 3, kind, oid + (5_000_000 if r.random() < 0.02 else 0), r.randrange(2), price, r.randrange(0, 9)))
    return out


COLUMNS = "symbol string, seq long, timestamp long, type int, order_id long, side int, price long, qty long"


@pytest.mark.parametrize("batch", ["10000", "7"])
def test_book_equals_emulator(spark, batch):
    rows = random_messages(600, 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(rows, COLUMNS)
        got = {(r.symbol, r.seq): r for r in folds.book_l1(df).collect()}
        fills = {}
        for r in folds.fills(df).collect():
            fills.setdefault((r.symbol, r.seq), []).append((r.nth, r.resting_id, r.price, r.qty))
        changes = folds.resting_orders(df).groupBy("symbol", "side", "price").sum("change").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    books, cancelled = {}, 0
    for symbol, seq, _, kind, oid, side, price, qty in rows:
        book = books.setdefault(symbol, PlainBook())
        want = book.apply(kind, oid, side, price, qty)
        assert [f[1:] for f in sorted(fills.get((symbol, seq), []))] == want
        now = got[symbol, seq]
        assert (now.best_bid, now.best_ask) == (book.best(0), book.best(1))
        assert now.best_bid == -1 or now.best_ask == -1 or now.best_bid < now.best_ask
        cancelled += now.cancelled > 0
    assert cancelled > 20 and any(fills.values())
    depth = {(r[0], r[1], r[2]): r[3] for r in changes if r[3]}
    want = {}
    for symbol, book in books.items():
        for _, price, qty, side in book.orders:
            if qty and price < 1_000_000:
                want[symbol, side, price] = want.get((symbol, side, price), 0) + qty
    assert depth == want


def test_a_full_pool_drops_the_rest_of_an_order():
    book = folds.Book(max_resting=2)
    assert [book.add(k, 100 + k, 5, 1)[1] for k in range(3)] == ["RESTING", "RESTING", "POOL_EXHAUSTED"]
    assert book.add(9, 100, 7, 0) == ([(0, 100, 5)], "RESTING") and book.cancel(1) == 5 and book.add(10, 105, 1, 1)[1] == "RESTING"
    assert book.cancel(10) == 1 and book.cancel(10) == 0


def plain_quoter(prices, live=True, most=10.0, base=0.5):
    """Independent form of the live recurrence, from one list of prices."""
    import math

    import numpy as np

    # reset observes the first price; a replay has consumed it by then, a live quoter steps on it too
    seen, cash, inv, rest, anchor, out = [prices[0]], 1e6, 0.0, None, prices[0], []
    for p in prices if live else prices[1:]:
        if len(seen) == 1:
            sigma = 0.1
        else:
            window = seen[-100:] if len(seen) >= 100 else [*seen, 0.0]
            sigma = max(float(np.std(window)), 0.1)
        g = 0.1 * 60000 / max(p, 1)
        half = (g * sigma**2 + 2 / g * math.log(1 + g / 1.5)) / 2
        half = min(max(half, p * 0.00003), p * 0.0001)
        if rest is None or abs(p - anchor) / max(p, 1) > 0.0003 or not live:
            rest, anchor = (p - half, p + half), p
        size = base * min(max(max(p * 0.005, 0.01) / max(sigma, 0.01), 0.2), 1)
        side = None
        if p <= rest[0] and inv + size <= most:
            side, cash, inv = "BUY", cash - rest[0] * size * (1 - 0.0001), inv + size
        elif p >= rest[1] and inv - size >= -most:
            side, cash, inv = "SELL", cash + rest[1] * size * (1 + 0.0001), inv - size
        if side:
            rest = None
        out.append((side, cash + inv * p, inv))
        seen.append(p)
    return out


def walk(n, seed):
    r, cents, out = random.Random(seed), 6_000_000, []
    for _ in range(n):
        cents += r.randrange(-900, 901)
        out.append(cents)
    return out


TICK = "symbol string, seq long, ts_ms long, cents long, price double, is_buyer_maker boolean"


@pytest.mark.parametrize(("live", "most"), [(True, 10.0), (True, 1.0), (False, 10.0)])
def test_quoter_equals_emulator(spark, live, most):
    series_of = {s: walk(400, k) for k, s in enumerate("abc")}
    rows = [(s, i, i * 1000, c, c / 100, False) for s, cs in series_of.items() for i, c in enumerate(cs)]
    got = {}
    for r in folds.simulate(spark.createDataFrame(rows, TICK), live=live, max_inventory=most).collect():
        got.setdefault(r.symbol, []).append(r)
    for s, cents in series_of.items():
        want = plain_quoter([c / 100 for c in cents], live, most)
        mine = sorted(got[s], key=lambda r: r.seq)
        assert [r.side for r in mine] == [w[0] for w in want]
        assert all(abs(r.net_worth - w[1]) < 1e-3 and abs(r.inventory - w[2]) < 1e-9 and abs(r.inventory) <= most for r, w in zip(mine, want, strict=True))
        assert any(w[0] for w in want) == live  # replay never fills


def test_fold_does_not_depend_on_batches(spark):
    rows = [("a", i, i, c, c / 100, False) for i, c in enumerate(walk(300, 5))]
    df = spark.createDataFrame(rows, TICK)
    whole = rows_of(folds.simulate(df))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        assert rows_of(folds.simulate(df)) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_breaker_ends_the_series(spark):
    cents = [6_000_000, 5_990_000, 5_900_000, 3_000_000, 2_000_000, 2_000_000]
    rows = [("a", i, i, c, c / 100, False) for i, c in enumerate(cents)]
    got = sorted(folds.simulate(spark.createDataFrame(rows, TICK), start_cash=30_000.0, base_size=5.0, max_inventory=50.0).collect(), key=lambda r: r.seq)
    if any(r.terminated for r in got):
        assert got[-1].terminated and not any(r.terminated for r in got[:-1]) and got[-1].reward < -90_000


def test_asof_takes_the_latest_before(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t long")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("a", 6, "z")], "k string, u long, v string")
    assert rows_of(series.asof(left, right, "k", "t", "u", ["v"])) == [("a", 1, None), ("a", 5, "y"), ("b", 9, None)]


def test_toggles_hold_until_the_next(spark):
    ticks = spark.createDataFrame([("a", i, i * 10) for i in range(5)] + [("b", 9, 15)], "symbol string, seq long, ts_ms long")
    control = spark.createDataFrame([("a", 10, False), ("a", 25, True)], "symbol string, at_ms long, is_quoting boolean")
    got = {(r.symbol, r.seq): r.is_quoting for r in series.controlled(ticks, control).collect()}
    assert got == {("a", 0): True, ("a", 1): False, ("a", 2): False, ("a", 3): True, ("a", 4): True, ("b", 9): True}


def test_one_shuffle_feeds_window_and_fold(spark):
    df = spark.createDataFrame([("a", i, i, c, c / 100, False) for i, c in enumerate(walk(50, 5))], TICK)
    plan = folds.simulate(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan


def test_a_replay_starts_with_the_second_tick(spark):
    rows = [("a", i, i, c, c / 100, False) for i, c in enumerate(walk(3, 5))] + [("b", 0, 0, 6_000_000, 60000.0, False)]
    got = folds.simulate(spark.createDataFrame(rows, TICK), live=False).collect()
    assert [(r.symbol, r.seq) for r in sorted(got, key=lambda r: r.seq)] == [("a", 1), ("a", 2)]


def test_sweep_equals_single_runs(spark):
    """Every action of the sweep ends as a simulation of its own, at the breaker if that trips."""
    series_of = {s: walk(300, k) for k, s in enumerate("abc")}
    series_of["c"] = [c // (1 + i // 20 % 2) for i, c in enumerate(series_of["c"])]  # halves and doubles in turn
    df = spark.createDataFrame([(s, i, i, c, c / 100, False) for s, cs in series_of.items() for i, c in enumerate(cs)], TICK)
    fixed = dict(start_cash=60_000.0, base_size=1.0, max_inventory=400.0)
    actions = [(0, 0.1, 1.0), (1, 0.05, 0.5), (2, 0.5, 4.0)]
    got = {(r.symbol, r.action): r for r in folds.sweep(df, actions, **fixed).collect()}
    tripped = 0
    for n, gamma, spread in actions:
        alone = folds.simulate(df, gamma=gamma, spread=spread, **fixed).collect()
        for s in series_of:
            mine = sorted((r for r in alone if r.symbol == s), key=lambda r: r.seq)
            r = got[s, n]
            assert (r.net_worth, r.fills, r.steps, r.terminated) == (mine[-1].net_worth, sum(x.side is not None for x in mine), len(mine), mine[-1].terminated)
            tripped += r.terminated
    assert 0 < tripped < len(got)


@pytest.fixture(scope="module")
def played(spark):
    """The fixture's messages of the smallest folder, played through the plain book."""
    from tickforge.sources import tables

    rows = sorted(tables.messages(spark, "/root/testdata/sf0.001").select(*folds.ORDER_COLUMNS).collect(), key=lambda r: (r.symbol, r.seq))
    books, steps = {}, []
    for r in rows:
        book = books.setdefault(r.symbol, PlainBook())
        before = sum(o[2] for o in book.orders)
        book.apply(r.type, r.order_id, r.side, r.price, r.qty)
        gone = before - sum(o[2] for o in book.orders) if r.type in (2, 3) else 0
        steps.append((r, gone, book.best(0), book.best(1)))
    return books, steps


def test_book_queries_equal_the_plain_book(spark, played):
    from tickforge.plans import catalog

    folder = "/root/testdata/sf0.001"
    books, steps = played
    cancels = sorted((r.symbol, r.seq, "CANCELLED" if gone else "NOT_FOUND", gone) for r, gone, _, _ in steps if r.type in (2, 3))
    assert sorted((r.symbol, r.seq, r.status, r.cancelled) for r in catalog.QUERIES["lob_cancels"](spark, folder).collect()) == cancels and any(c[3] for c in cancels)
    depth = {}
    for symbol, book in books.items():
        for _, price, qty, side in book.orders:
            if qty and price < 1_000_000:
                depth[symbol, side, price] = depth.get((symbol, side, price), 0) + qty
    assert {(r.symbol, r.side, r.price): r.volume for r in catalog.QUERIES["book_depth"](spark, folder).collect()} == depth
    # advance_tick: the middle after each run of equal timestamps; done with the last
    mids, last = {}, {}
    for k, (r, _, bid, ask) in enumerate(steps):
        following = steps[k + 1][0] if k + 1 < len(steps) and steps[k + 1][0].symbol == r.symbol else None
        if following is None or following.timestamp != r.timestamp:
            tick = last[r.symbol] = last.get(r.symbol, 0) + 1
            mid = (bid + ask) / 2 if bid != -1 and ask != -1 else float(bid) if bid != -1 else float(ask) if ask != -1 else 62_500.0
            mids[r.symbol, tick] = (r.timestamp, mid, following is None)
    assert {(r.symbol, r.tick): (r.timestamp, r.mid, r.done) for r in catalog.QUERIES["replay_mid"](spark, folder).collect()} == mids


def test_book_folds_use_the_messages_own_shuffle(spark):
    from tickforge.sources import tables

    messages = tables.messages(spark, "/root/testdata/sf0.001")
    for found in (folds.book_l1(messages, dealt=True), folds.fills(messages, dealt=True), folds.resting_orders(messages, dealt=True)):
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
