"""Column functions: scaling, quoting formulas, depth and projections. All stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The middle of an empty book, the quoter's defaults, and the bounds of a half spread over the middle.
EMPTY_MID = 62_500.0
DEFAULT_GAMMA, DEFAULT_SPREAD, DEFAULT_KAPPA = 0.1, 1.0, 1.5
LOWEST_HALF, HIGHEST_HALF = 0.00003, 0.0001


def normalize_symbol(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, "[/-]", ""))


def feed_symbol(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "[/-]", ""))


def whole_price(price: Column) -> Column:
    """Live prices to the nearest integer, halves to even."""
    return F.bround(price, 0).cast("long")


def whole_volume(volume: Column) -> Column:
    """Volumes under 1 in ten-thousandths, halves to even; larger ones cut to integers."""
    return F.when(volume < 1, F.bround(volume * 10000, 0).cast("long")).otherwise(F.floor(volume).cast("long"))


def kline_quantity(volume: Column) -> Column:
    return F.greatest(F.lit(1), (F.when(volume > 0, volume / 4).otherwise(0.1) * 10000).cast("long"))


def trade_quantity(quantity: Column) -> Column:
    return F.greatest(F.lit(1), (quantity * 100).cast("long"))


def aggressor(maker: Column) -> Column:
    """1 (a sale) if the buyer was the maker."""
    return F.when(maker, 1).otherwise(0)


def timeframe(name: Column) -> Column:
    """Supported candle widths; 5h is served by 4h, anything else by 30m."""
    known = F.create_map(*[F.lit(x) for pair in (("30m", "30m"), ("2h", "2h"), ("4h", "4h"), ("5h", "4h")) for x in pair])
    return F.coalesce(F.try_element_at(known, name), F.lit("30m"))


def scaled_gamma(gamma: Column, mid: Column) -> Column:
    return gamma * (F.lit(60000.0) / F.greatest(mid, F.lit(1.0)))


def optimal_spread(sigma: Column, gamma: Column, kappa: Column, multiplier: Column) -> Column:
    return (gamma * sigma * sigma + (F.lit(2.0) / gamma) * F.log(F.lit(1.0) + gamma / kappa)) * multiplier


def reservation(mid: Column, inventory: Column, gamma: Column, sigma: Column) -> Column:
    return mid - inventory * gamma * sigma * sigma


def clamp_half(half: Column, mid: Column) -> Column:
    """Half spreads stay within 0.3 and 1 basis point of the middle."""
    return F.least(F.greatest(half, mid * LOWEST_HALF), mid * HIGHEST_HALF)


def trade_size(base: Column, mid: Column, sigma: Column) -> Column:
    ratio = F.greatest(mid * 0.005, F.lit(0.01)) / F.greatest(sigma, F.lit(0.01))
    return base * F.least(F.greatest(ratio, F.lit(0.2)), F.lit(1.0))


def live_depth(price: Column, volume: Column, maker: Column, bound: int = 1_000_000) -> dict[str, Column]:
    """The depth that a live tick leaves on a live-only book: best bid and ask with their volumes, or none beyond the bound."""
    bid = F.when(maker, F.greatest(price - 1, F.lit(0))).otherwise(price)
    ask = F.when(maker, price + 1).otherwise(price + 2)
    fits = (bid < bound) & (ask < bound)
    return {
        "best_bid": F.when(fits, bid).otherwise(-1), "best_ask": F.when(fits, ask).otherwise(-1),
        "bid_volume": F.when(fits, F.when(maker, volume).otherwise(volume * 2)).otherwise(0),
        "ask_volume": F.when(fits, F.when(maker, volume * 2).otherwise(volume)).otherwise(0),
    }


def imbalance(bid_volume: Column, ask_volume: Column) -> Column:
    total = bid_volume + ask_volume
    return F.when(total == 0, 0.0).otherwise((bid_volume - ask_volume) / total)


def mid_price(best_bid: Column, best_ask: Column) -> Column:
    """Of best prices that are -1 where a side is empty."""
    bid, ask = F.when(best_bid >= 0, best_bid.cast("double")), F.when(best_ask >= 0, best_ask.cast("double"))
    return F.coalesce((bid + ask) / 2, bid, ask, F.lit(EMPTY_MID))


def marker(side: Column) -> Column:
    """How a chart shows an execution (positions, colours and shapes are fixed values)."""
    buy = side == "BUY"
    pick = lambda a, b: F.when(buy, a).otherwise(b)
    return F.struct(pick("belowBar", "aboveBar").alias("position"), pick("#10B981", "#EF4444").alias("color"), pick("arrowUp", "arrowDown").alias("shape"), side.alias("text"))
