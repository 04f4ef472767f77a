"""Time-ordered analytics and model evaluation on Spark."""

from .operators.backtest import BacktestRunner
from .operators.conformal import SplitConformalCalibrator
from .operators.folds import WalkForwardConfig, WalkForwardSplitter
from .plans.experiment import ForecastExperiment
from .sources.market import MarketData, read_market_csv

#: The loader by the name that says what it returns.
load_market_csv = read_market_csv

__version__ = "0.3.0"

__all__ = ["BacktestRunner", "ForecastExperiment", "MarketData", "SplitConformalCalibrator", "WalkForwardConfig", "WalkForwardSplitter", "__version__", "load_market_csv", "read_market_csv"]
