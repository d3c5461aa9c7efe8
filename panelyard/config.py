"""Settings for every stage. Plain frozen dataclasses, no file loader."""

from __future__ import annotations

from dataclasses import dataclass, field

# Names of the portfolio-return variants (the ``universe`` column).
PORTFOLIO_SETS = ("op", "deciles_vw", "ex_nyse_p20_me", "ex_price5")

# Upper bound on distinct months in any table: 1900-01 .. 2099-12.
MAX_MONTHS = 2400


@dataclass(frozen=True)
class Universe:
    start: int = 197301
    end: int = 202312
    min_assets: int = 20
    portfolio_set: str = "op"


@dataclass(frozen=True)
class Split:
    train_start: int = 199401
    first_test_year: int = 2008
    val_years: int = 4
    test_step_years: int = 1
    embargo_months: int = 12
    expanding: bool = True
    train_years: int = 20
    min_train_months: int = 60
    min_val_months: int = 24


@dataclass(frozen=True)
class Costs:
    spread_bps: float = 25.0
    switch_bps: float = 25.0
    short_fee_bps_annual: float = 100.0
    multipliers: tuple[float, ...] = (0.0, 0.5, 1.0, 2.0, 3.0, 4.0)


@dataclass(frozen=True)
class Portfolio:
    scheme: str = "tilt"
    tilt_gross: float = 1.0
    gross_leverage: float = 1.0
    max_weight: float | None = 0.10
    n_quantiles: int = 5
    temperature: float = 1.0
    vol_target: float | None = 0.10


@dataclass(frozen=True)
class Training:
    seed: int = 0


@dataclass(frozen=True)
class Settings:
    universe: Universe = field(default_factory=Universe)
    split: Split = field(default_factory=Split)
    costs: Costs = field(default_factory=Costs)
    portfolio: Portfolio = field(default_factory=Portfolio)
    training: Training = field(default_factory=Training)
