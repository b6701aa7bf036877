"""Ordered folds: what depends on a symbol's own past decisions and no window can express.

Rows are dealt by symbol and sorted within tasks; a fold reads them in Arrow batches and keeps the state of the symbol it
is in, across batches. Memory is one batch and that state, whatever a symbol's length.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator
from heapq import heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickforge.functions.market import HIGHEST_HALF, LOWEST_HALF

from .series import quoting_sigma

STEP = (
    "symbol string, seq long, ts_ms long, mid double, sigma double, is_quoting boolean, bid double, ask double, side string, size double, "
    "fill_price double, realized double, cash double, inventory double, lots long, net_worth double, step_pnl double, reward double, terminated boolean"
)
ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
#: What a quoter runs with unless told otherwise.
PARAMETERS = dict(gamma=0.1, spread=1.0, kappa=1.5, start_cash=1_000_000.0, base_size=0.5, max_inventory=10.0, maker_fee=-0.0001, penalty=0.1, live=True)


def lists(*columns: pa.Array) -> list[list]:
    """Columns as lists of plain values; numbers without gaps by way of numpy, which is many times as fast."""
    plain = lambda c: not c.null_count and (pa.types.is_integer(c.type) or pa.types.is_floating(c.type))
    return [c.to_numpy().tolist() if plain(c) else c.to_pylist() for c in columns]


def columns_of(rows: list[tuple], n: int) -> list:
    """Rows as ``n`` columns."""
    return list(zip(*rows, strict=True)) if rows else [()] * n


def fold(df: DataFrame, state: Callable[[], object], run: Callable, schema: str, by: str = "symbol", order: str = "seq", dealt: bool = False) -> DataFrame:
    """Runs ``run(state, columns)`` over each key's rows in order, as many at a time as a batch holds; it returns columns.

    ``columns`` are Arrow arrays, in the order of df's columns, of one key's rows; what is returned may be arrays or
    sequences. ``dealt``: the rows come from a window over the same key, so they need no shuffle of their own. Rows
    without a key are in no series.
    """
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    kinds = [ARROW[t] for t in types]
    place = df.columns.index(by)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now = None, None
        for batch in batches:
            if not len(batch):
                continue
            numbers = batch.column(place).dictionary_encode().indices.to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(batch)]
            for at, end in pairwise(cuts):
                if (of := batch.column(place)[at].as_py()) != key:
                    key, now = of, state()
                out = run(now, [c.slice(at, end - at) for c in batch.columns])
                yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=list(names))

    rows = df.filter(F.col(by).isNotNull())
    return (rows if dealt else rows.repartition(by)).sortWithinPartitions(by, order).mapInArrow(read, schema)


class Quoter:
    """A two-sided quoter's state: cash, inventory and the quotes that rest."""

    def __init__(self, **parameters):
        self.__dict__.update(PARAMETERS | parameters)
        self.cash, self.inventory, self.lots = self.start_cash, 0.0, 0
        self.bid = self.ask = self.anchor = self.average = 0.0
        self.worth, self.ended, self.begun = self.start_cash, False, False

    def half_spread(self, mid: float, sigma: float, gamma: float, spread: float) -> float:
        gamma = gamma * (60000.0 / max(mid, 1.0))
        whole = (gamma * sigma * sigma + (2.0 / gamma) * math.log(1.0 + gamma / self.kappa)) * spread
        return min(max(whole / 2.0, mid * LOWEST_HALF), mid * HIGHEST_HALF)

    def _cost(self, sign: int, size: float, paid: float) -> float | None:
        """Keeps the average cost of the inventory; what a fill earns on the part of it that it closes."""
        held = abs(self.inventory)
        if self.inventory * sign >= 0:
            self.average = (self.average * held + paid * size) / (held + size)
            return None
        earned = (self.average - paid) * sign * min(size, held)
        if size > held:
            self.average = paid
        return earned

    def step(self, mid: float, sigma: float, quoting: bool = True, gamma: float | None = None, spread: float | None = None) -> tuple:
        """One tick; see STEP from is_quoting on."""
        side, size, paid, realized = None, 0.0, 0.0, None
        if not self.begun:
            self.anchor, self.begun = mid, True
        if not quoting:
            self.bid = self.ask = 0.0
            bid = ask = 0.0
        else:
            half = self.half_spread(mid, sigma, self.gamma if gamma is None else gamma, self.spread if spread is None else spread)
            moved = abs(mid - self.anchor) / max(mid, 1.0) > 0.0003
            if self.bid == 0.0 or moved or not self.live:
                self.bid, self.ask, self.anchor = mid - half, mid + half, mid
            bid, ask = self.bid, self.ask
            size = self.base_size * min(max(max(mid * 0.005, 0.01) / max(sigma, 0.01), 0.2), 1.0)
            if mid <= bid and self.inventory + size <= self.max_inventory:
                side, paid, sign = "BUY", bid, 1
            elif mid >= ask and self.inventory - size >= -self.max_inventory:
                side, paid, sign = "SELL", ask, -1
            if side:
                value = paid * size
                realized = self._cost(sign, size, paid)
                self.lots += sign
                self.inventory += sign * size
                self.cash -= sign * value + value * self.maker_fee
                self.bid = 0.0
        worth = self.cash + self.inventory * mid
        gained, self.worth = worth - self.worth, worth
        reward = gained - self.penalty * self.inventory**2
        self.ended = worth < self.start_cash * 0.8
        if self.ended:
            reward -= 100000.0
        return (quoting, bid, ask, side, size if side else 0.0, paid, realized, self.cash, self.inventory, self.lots, worth, gained, reward, self.ended)


def simulate(ticks: DataFrame, quoting: F.Column | None = None, scale: float = 100.0, **parameters) -> DataFrame:
    """The quoter over every symbol's ticks (see STEP). Steps after a loss of a fifth of the cash are not given.

    ``quoting``: a condition on the ticks under which quotes are out. With ``live=False`` a symbol's first tick is
    consumed by the start of the replay and gives no step.
    """
    rows = quoting_sigma(ticks, parameters.get("live", True), scale, by_symbol=True).withColumn("is_quoting", F.lit(True) if quoting is None else quoting)
    rows = rows.select("symbol", "seq", "ts_ms", "price", "sigma", "is_quoting")

    def run(q: Quoter, columns: list[pa.Array]) -> list:
        out = []
        for symbol, seq, ts_ms, price, sigma, out_there in zip(*lists(*columns), strict=True):
            if q.ended:
                break
            out.append((symbol, seq, ts_ms, price, sigma, *q.step(price, sigma, out_there)))
        return columns_of(out, len(STEP.split(", ")))

    return fold(rows, lambda: Quoter(**parameters), run, STEP, dealt=True)


def sweep(ticks: DataFrame, actions: list[tuple[int, float, float]], scale: float = 100.0, **parameters) -> DataFrame:
    """The quoter under several actions (number, gamma, spread) side by side, in one fold by symbol.

    For each symbol and action the last net worth, the fills and the steps, the last of them at a tripped breaker.
    """
    rows = quoting_sigma(ticks, parameters.get("live", True), scale, by_symbol=True).select("symbol", "seq", "price", "sigma")
    rows = rows.withColumn("last", F.lead("seq").over(Window.partitionBy("symbol").orderBy("seq")).isNull())
    def start() -> list[list]:
        return [[n, Quoter(gamma=g, spread=s, **parameters), 0, 0] for n, g, s in actions]

    def run(quoters: list[list], columns: list[pa.Array]) -> list:
        symbols, _, prices, sigmas, last = lists(*columns)
        for each in quoters:
            q = each[1]
            for price, sigma in zip(prices, sigmas, strict=True):
                if q.ended:
                    break
                each[2] += q.step(price, sigma)[3] is not None
                each[3] += 1
        if not last[-1]:
            return [()] * 6
        out = [(symbols[0], n, q.worth, fills, steps, q.ended) for n, q, fills, steps in quoters]
        return columns_of(out, 6)

    return fold(rows, start, run, "symbol string, action int, net_worth double, fills long, steps long, terminated boolean", dealt=True)


class Book:
    """Price-time priority for one symbol: levels are queues of [id, quantity left], best prices come from heaps."""

    def __init__(self, prices: int = 1_000_000, ids: int = 5_000_000, max_resting: int | None = None):
        self.prices, self.ids, self.max_resting, self.resting = prices, ids, max_resting, 0
        self.levels: tuple[dict, dict] = ({}, {})  # by side: price to queue
        self.volumes: tuple[dict, dict] = ({}, {})
        self.heaps: tuple[list, list] = ([], [])  # bids by their negative price
        self.live: dict[int, tuple[int, int, list]] = {}

    def best(self, side: int) -> int:
        heap, volumes = self.heaps[side], self.volumes[side]
        while heap:
            price = heap[0] if side else -heap[0]
            if volumes.get(price):
                return price
            self.levels[side].pop(price, None)
            heappop(heap)
        return -1

    def add(self, order_id: int, price: int, qty: int, side: int) -> tuple[list[tuple[int, int, int]], str]:
        """Fills (resting id, price, quantity), and what became of the rest."""
        fills, other = [], 1 - side
        while qty > 0 and (best := self.best(other)) != -1 and (best >= price if side else best <= price):
            queue = self.levels[other][best]
            while queue and qty > 0:
                resting = queue[0]
                n = min(qty, resting[1])
                if n:
                    fills.append((resting[0], best, n))
                    qty, resting[1] = qty - n, resting[1] - n
                    self.volumes[other][best] -= n
                if not resting[1]:
                    queue.popleft()
                    if n:
                        self.resting -= 1
                        self.live.pop(resting[0], None)
        if not qty:
            return fills, "FILLED" if fills else "EMPTY"
        if self.max_resting is not None and self.resting >= self.max_resting:
            return fills, "POOL_EXHAUSTED"
        self.resting += 1
        order = [order_id, qty]
        if order_id < self.ids:
            self.live[order_id] = (side, price, order)
        if price >= self.prices:
            return fills, "OFF_BOOK"
        volumes, levels = self.volumes[side], self.levels[side]
        held = volumes.get(price)
        if held:
            levels[price].append(order)
            volumes[price] = held + qty
        else:
            heappush(self.heaps[side], price if side else -price)
            if price in levels:
                levels[price].append(order)
            else:
                levels[price] = deque((order,))
            volumes[price] = qty
        return fills, "RESTING"

    def cancel(self, order_id: int) -> int:
        """Quantity taken off the book; 0 if there is no such order on it."""
        found = self.live.get(order_id)
        if found is None:
            return 0
        side, price, order = found
        if price >= self.prices:
            return 0
        del self.live[order_id]
        self.resting -= 1
        qty, order[1] = order[1], 0  # it leaves its queue when it comes to the front
        self.volumes[side][price] -= qty
        return qty

    def apply(self, kind: int, order_id: int, side: int, price: int, qty: int) -> tuple[list, str, int]:
        """Fills, what became of the message, and the quantity cancelled."""
        if kind == 1:
            return *self.add(order_id, price, qty, side), 0
        if kind in (2, 3):
            gone = self.cancel(order_id)
            return NONE, "CANCELLED" if gone else "NOT_FOUND", gone
        return NONE, "IGNORED", 0


NONE: list = []
ORDER_COLUMNS = ("symbol", "seq", "timestamp", "type", "order_id", "side", "price", "qty")


def book_l1(messages: DataFrame, dealt: bool = False) -> DataFrame:
    """Best prices and volumes, and what the message did, after every message.

    ``dealt``: the messages come from a window by symbol, as ``sources.tables.messages`` gives them.
    """

    def run(book: Book, columns: list[pa.Array]) -> list:
        symbols, seqs, times, *orders = columns
        bids, asks, best, apply = *book.volumes, book.best, book.apply
        out = []
        for order in zip(*lists(*orders), strict=True):
            fills, status, gone = apply(*order)
            bid, ask = best(0), best(1)
            out.append((status, sum([f[2] for f in fills]) if fills else 0, gone, bid, ask, bids.get(bid, 0), asks.get(ask, 0)))
        return [symbols, seqs, times, *columns_of(out, 7)]

    schema = "symbol string, seq long, timestamp long, status string, matched long, cancelled long, best_bid long, best_ask long, bid_volume long, ask_volume long"
    return fold(messages.select(*ORDER_COLUMNS), Book, run, schema, dealt=dealt)


def fills(messages: DataFrame, dealt: bool = False) -> DataFrame:
    """Every match: the taker's message, the resting order, price and quantity."""

    def run(book: Book, columns: list[pa.Array]) -> list:
        out = []
        for symbol, seq, _, *order in zip(*lists(*columns), strict=True):
            done, _, _ = book.apply(*order)
            if done:
                out += [(symbol, seq, k, order[1], resting, order[2], price, n) for k, (resting, price, n) in enumerate(done)]
        return columns_of(out, 8)

    schema = "symbol string, seq long, nth long, taker_id long, resting_id long, taker_side long, price long, qty long"
    return fold(messages.select(*ORDER_COLUMNS), Book, run, schema, dealt=dealt)


def resting_orders(messages: DataFrame, dealt: bool = False) -> DataFrame:
    """Orders on the book at the end, for depth by level.

    A row for each message that rested, with what of it was matched or cancelled later, all from the fold's events.
    """

    def run(book: Book, columns: list[pa.Array]) -> list:
        out = []
        for symbol, seq, _, kind, order_id, side, price, qty in zip(*lists(*columns), strict=True):
            held = book.live.get(order_id) if kind in (2, 3) else None
            done, status, gone = book.apply(kind, order_id, side, price, qty)
            out += [(symbol, seq, at, 1 - side, -n) for _, at, n in done]
            if status == "RESTING":
                out.append((symbol, seq, price, side, qty - sum(f[2] for f in done)))
            elif gone:
                out.append((symbol, seq, held[1], held[0], -gone))
        return columns_of(out, 5)

    return fold(messages.select(*ORDER_COLUMNS), Book, run, "symbol string, seq long, price long, side long, change long", dealt=dealt)
