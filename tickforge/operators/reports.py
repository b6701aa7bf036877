"""Reports over simulated steps, and the model registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickforge.functions.market import marker, normalize_symbol

from .series import last_by, newest

#: What a model without hyperparameters runs with.
DEFAULTS = {"max_inventory": 10.0, "base_trade_size": 0.5, "kappa": 1.5}
HYPER = "struct<max_inventory:double,base_trade_size:double,kappa:double>"


def equity_curve(steps: DataFrame) -> DataFrame:
    return steps.select("symbol", "seq", "net_worth", "mid", "inventory")


def executions(steps: DataFrame) -> DataFrame:
    """Fills as the live feed shows them: a sale shows the step's gain, a purchase none."""
    pnl = F.when(F.col("side") == "SELL", F.round("step_pnl", 2)).otherwise(0.0)
    shown = steps.filter(F.col("side").isNotNull())
    return shown.select("symbol", "seq", F.col("ts_ms").alias("time"), "side", F.round("fill_price", 2).alias("price"), F.round("size", 4).alias("size"), pnl.alias("realized_pnl"))


def markers(fills: DataFrame) -> DataFrame:
    return fills.select("symbol", "seq", F.floor(F.col("time") / 1000).alias("time"), marker(F.col("side")).alias("m")).select("symbol", "seq", "time", "m.*")


def distinct_markers(marks: DataFrame, by_time_only: bool = False) -> DataFrame:
    """One marker for each second, text and position (or second alone): the last."""
    keys = ["symbol", "time"] if by_time_only else ["symbol", "time", "text", "position"]
    return last_by(marks, [F.col(k) for k in keys], "seq")


def backtest_metrics(steps: DataFrame, start_cash: float = 1_000_000.0) -> DataFrame:
    """By symbol: pnl, trades, win rate of closing fills in percent, and the deepest fall from a peak in percent."""
    peak = F.max("net_worth").over(Window.partitionBy("symbol").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    won = F.when(F.col("realized").isNotNull(), (F.col("realized") > 0).cast("double"))
    return steps.withColumn("fall", F.col("net_worth") / peak - 1).groupBy("symbol").agg(
        (F.max_by("net_worth", "seq") - start_cash).alias("pnl"), F.count("side").alias("trades"),
        (100 * F.avg(won)).alias("win_rate"), (100 * F.min("fall")).alias("max_drawdown"),
    )


def final_worth(steps: DataFrame, bankrupt: float = 100_000.0) -> DataFrame:
    worth = F.max_by("net_worth", "seq")
    return steps.groupBy("symbol").agg(worth.alias("net_worth"), F.count("*").alias("steps"), (worth < bankrupt).alias("bankrupt"))


def engine_status(steps: DataFrame) -> DataFrame:
    """The last state of every engine; a tripped breaker is offline."""
    last = newest(steps, ["symbol"], ["seq"], 1)
    return last.select("symbol", "seq", "mid", "inventory", "net_worth", "is_quoting", F.when(F.col("terminated"), "OFFLINE").otherwise("LIVE").alias("status"))


def snapshot(steps: DataFrame, points: int = 500, shown: int = 50) -> DataFrame:
    """What a new subscriber gets, by symbol: status, the last chart points and executions, in order of time.

    One pass over the steps, which are a fold and not to be run for each part.
    """
    back = Window.partitionBy("symbol").orderBy(F.desc("seq"))
    filled = F.col("side").isNotNull()
    ranked = steps.withColumns({"__nth": F.row_number().over(back), "__fill": F.count_if(filled).over(back.rowsBetween(Window.unboundedPreceding, 0))})
    point, fill = F.col("__nth") <= points, filled & (F.col("__fill") <= shown)
    pnl = F.when(F.col("side") == "SELL", F.round("step_pnl", 2)).otherwise(0.0).alias("realized_pnl")
    execution = F.struct("seq", "side", F.round("fill_price", 2).alias("price"), F.round("size", 4).alias("size"), pnl)
    status = F.struct("seq", "mid", "inventory", "net_worth", "is_quoting", F.when(F.col("terminated"), "OFFLINE").otherwise("LIVE").alias("status"))
    in_order = lambda c, when: F.array_sort(F.collect_list(F.when(when, c)))
    found = ranked.filter(point | fill).groupBy("symbol").agg(
        F.max_by(status, "seq").alias("s"), in_order(F.struct("seq", F.round("net_worth", 2).alias("net_worth")), point).alias("chart"), in_order(execution, fill).alias("executions"),
    )
    return found.select("symbol", "s.*", "chart", F.when(F.size("executions") > 0, F.col("executions")).alias("executions"))


def latest_model(registry: DataFrame) -> DataFrame:
    """The newest row of each symbol."""
    rows = registry.withColumn("symbol", normalize_symbol(F.col("raw_symbol")))
    return newest(rows, ["symbol"], ["created_at", "id"], 1)


def resolve(symbols: DataFrame, registry: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Hyperparameters of each symbol: of its registry row if it has one (missing keys take the defaults), else its sidecar, else the defaults."""
    rows = latest_model(registry).select("symbol", F.from_json("hyperparameters", HYPER).alias("row"), F.lit(True).alias("found"))
    beside = sidecars.select("symbol", F.from_json("sidecar", HYPER).alias("beside"))
    joined = symbols.join(rows, "symbol", "left").join(beside, "symbol", "left")

    def value(name: str, default: float) -> Column:
        source = F.when(F.col("found"), F.col(f"row.{name}")).otherwise(F.col(f"beside.{name}"))
        return F.coalesce(source, F.lit(default)).alias(name)

    origin = F.when(F.col("found"), "registry").when(F.col("beside").isNotNull(), "sidecar").otherwise("default")
    return joined.select("symbol", *[value(n, d) for n, d in DEFAULTS.items()], origin.alias("origin"))
