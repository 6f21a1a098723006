"""Signals: base class, the library of seven, and a registry. Higher scores are more attractive.

A signal contributes one score Column over a grid that has close, volume, ret and excess; the registry
puts all of them into one select, so they share the sort by ticker, and unpivots the result.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import by_date, by_ticker, rolling
from . import prices, universe


@dataclass
class Market:
    """bars: dense (date, ticker, close[, volume]); sectors (ticker, sector); membership (date, ticker) of members."""

    bars: DataFrame
    sectors: DataFrame | None = None
    membership: DataFrame | None = None

    def __post_init__(self) -> None:
        self.require("close")

    def require(self, *fields: str) -> None:
        missing = [f for f in fields if f not in self.bars.columns]
        if missing:
            raise ValueError(f"the panel lacks {', '.join(missing)}")

    def returns(self) -> DataFrame:
        return prices.returns(self.bars)

    def enriched(self) -> DataFrame:
        """bars + ret, excess over the equal-weight mean of all names, and the growth of 1 in excess returns."""
        r = self.returns().withColumn("excess", F.col("ret") - F.avg("ret").over(by_date()))
        return r.withColumn("growth", F.product(1 + F.coalesce("excess", F.lit(0.0))).over(by_ticker().rowsBetween(Window.unboundedPreceding, 0)))


class Signal(ABC):
    """Subclasses set family, rationale and defaults, and give a score column."""

    family = ""
    rationale = ""
    defaults: dict[str, int] = {}
    needs: tuple[str, ...] = ()

    def __init__(self, **params):
        self.params = {**self.defaults, **params}

    @property
    def name(self) -> str:
        return "_".join([type(self).__name__, *(f"{k}{self.params[k]}" for k in sorted(self.params))])

    @abstractmethod
    def score(self) -> Column:
        """Over Market.enriched(), whose windows run by ticker and date."""

    def __call__(self, market: Market) -> DataFrame:
        """date, ticker, score; null outside the universe."""
        market.require(*self.needs)
        column = self.score()
        if not isinstance(column, Column):
            raise TypeError(f"{self.name} gave no Column")
        out = market.enriched().select("date", "ticker", column.alias("score"))
        return universe.mask(out, market.membership) if market.membership is not None else out

    def __repr__(self) -> str:
        return f"<{self.name} ({self.family})>"


class Momentum12_1(Signal):
    family, rationale = "momentum", "past winners keep winning; the latest month is skipped, as it reverses"
    defaults = {"lookback": 252, "skip": 21}

    def score(self):
        w = by_ticker()
        return F.try_divide(F.lag("close", self.params["skip"]).over(w), F.lag("close", self.params["lookback"]).over(w)) - 1


class ShortTermReversal(Signal):
    family, rationale = "reversal", "short-run losers rebound"
    defaults = {"lookback": 21}

    def score(self):
        return -(F.try_divide(F.col("close"), F.lag("close", self.params["lookback"]).over(by_ticker())) - 1)


class LowVolatility(Signal):
    family, rationale = "risk", "quiet names earn more per unit of risk"
    defaults = {"window": 63}

    def score(self):
        n = self.params["window"]
        return -rolling(F.stddev_samp, F.col("ret"), n, n // 2, by_ticker())


class TrendStrength(Signal):
    family, rationale = "trend", "distance from the long average, in units of volatility"
    defaults = {"window": 200, "vol_window": 63}

    def score(self):
        n, v = self.params["window"], self.params["vol_window"]
        average = rolling(F.avg, F.col("close"), n, n // 2, by_ticker())
        return F.try_divide(F.try_divide(F.col("close"), average) - 1, rolling(F.stddev_samp, F.col("ret"), v, v // 2, by_ticker()))


class LiquidityTurnover(Signal):
    family, rationale, needs = "liquidity", "thinly traded names pay a premium", ("volume",)
    defaults = {"window": 63}

    def score(self):
        n = self.params["window"]
        return -F.ln(rolling(F.avg, F.col("close") * F.col("volume"), n, n // 2, by_ticker()))


class IdiosyncraticMomentum(Signal):
    family, rationale = "momentum", "momentum of what the market does not explain"
    defaults = {"lookback": 252, "skip": 21}

    def score(self):
        w = by_ticker()
        return F.try_divide(F.lag("growth", self.params["skip"]).over(w), F.lag("growth", self.params["lookback"]).over(w)) - 1


class VolumeShock(Signal):
    family, rationale, needs = "attention", "names with sudden volume are overbought", ("volume",)
    defaults = {"short": 5, "long": 63}

    def score(self):
        fast, slow = ((rolling(F.avg, F.col("volume"), n, max(n // 2, 1), by_ticker())) for n in (self.params["short"], self.params["long"]))
        return -F.ln(F.try_divide(fast, slow))


class Registry:
    """An ordered set of signals with distinct names."""

    def __init__(self):
        self.signals: list[Signal] = []

    def add(self, signal: Signal) -> Registry:
        if any(s.name == signal.name for s in self.signals):
            raise ValueError(f"{signal.name} is registered already")
        self.signals.append(signal)
        return self

    def __len__(self) -> int:
        return len(self.signals)

    def compute_all(self, market: Market) -> DataFrame:
        """date, ticker, signal, score of all signals, in one pass over the panel."""
        for s in self.signals:
            market.require(*s.needs)
        wide = market.enriched().select("date", "ticker", *[s.score().alias(f"s{k}") for k, s in enumerate(self.signals)])
        if market.membership is not None:
            marked = market.membership.select("date", "ticker").distinct().withColumn("__in", F.lit(True))
            wide = wide.join(marked, ["date", "ticker"], "left")
            wide = wide.withColumns({f"s{k}": F.when(F.col("__in"), F.col(f"s{k}")) for k in range(len(self.signals))})
        rows = F.explode(F.array(*[F.struct(F.lit(s.name).alias("signal"), F.col(f"s{k}").alias("score")) for k, s in enumerate(self.signals)]))
        return wide.select("date", "ticker", rows.alias("x")).select("date", "ticker", "x.signal", "x.score")

    def describe(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(s.name, s.family, s.rationale) for s in self.signals], "name string, family string, rationale string")


LIBRARY = (Momentum12_1, ShortTermReversal, LowVolatility, TrendStrength, LiquidityTurnover, IdiosyncraticMomentum, VolumeShock)


def default_registry(**params: dict) -> Registry:
    """All seven; params by class name, e.g. LowVolatility={"window": 13}."""
    out = Registry()
    for kind in LIBRARY:
        out.add(kind(**params.get(kind.__name__, {})))
    return out
