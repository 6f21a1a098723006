"""Defaults of the research engine, as one object."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from pathlib import Path

#: ETFs of the eleven sectors with their first trading day (fixed values)
SECTOR_ETFS = (
    ("XLB", "Materials", "1998-12-22"),
    ("XLC", "Communication Services", "2018-06-19"),
    ("XLE", "Energy", "1998-12-22"),
    ("XLF", "Financials", "1998-12-22"),
    ("XLI", "Industrials", "1998-12-22"),
    ("XLK", "Technology", "1998-12-22"),
    ("XLP", "Consumer Staples", "1998-12-22"),
    ("XLRE", "Real Estate", "2015-10-08"),
    ("XLU", "Utilities", "1998-12-22"),
    ("XLV", "Health Care", "1998-12-22"),
    ("XLY", "Consumer Discretionary", "1998-12-22"),
)


@dataclass(frozen=True)
class Settings:
    periods_per_year: int = 252
    winsor: tuple[float, float] = (0.01, 0.99)
    horizons: tuple[int, ...] = (1, 5, 21)
    execution_lag: int = 1
    cost_bps: float = 10.0
    min_names: int = 20
    min_price: float = 5.0
    min_dollar_volume: float = 5e6
    norm_window: int = 756
    norm_min: int = 252
    t_hurdle: float = 3.0
    proxies: tuple[str, ...] = ("^VIX", "SPY", "TLT", "HYG", "LQD")
    data_env: str = "TIDEMARK_DATA_DIR"
    extra: dict = field(default_factory=dict)


SETTINGS = Settings()


def data_dir(root: str | None = None) -> Path:
    """The environment's folder, else root/data if it holds curated data, else one in the home folder."""
    if given := os.environ.get(SETTINGS.data_env):
        return Path(given)
    local = Path(root or ".") / "data"
    return local if (local / "curated").exists() else Path.home() / ".tidemark"


def newey_west_lags(horizon: int) -> int:
    """Overlapping returns of h periods are correlated over h - 1 lags."""
    return max(horizon - 1, 0)
