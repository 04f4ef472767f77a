"""Every operator as a query over the test tables, with its DuckDB SQL where SQL can express it.

Times are returned as text and doubles rounded, so that engines can be compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import BusinessCost, directional_accuracy, evaluate_pair, mae, pinball
from ..functions.scalar import rounded
from ..operators import features as fe
from ..operators.backtest import BacktestRunner, constant, default_models, fold_metrics, gradient_boosting, historical_mean, pooled_metrics, predictions, repeated_tests, require_valid, ridge_regression, seasonal_naive, wide
from ..operators.baselines import folds_of, predict_constant, predict_historical_mean, predict_seasonal_naive, train_statistics
from ..operators.bootstrap import arithmetic_starts, bootstrap_intervals, loss_difference, paired_bootstrap, sampling_plan
from ..operators.conformal import SplitConformalCalibrator, conformal_radius, interval_evaluation, intervals, require_intervals, split_segments
from ..operators.folds import WalkForwardConfig, isolation_violations, test_rows, train_rows
from ..operators.promotion import PromotionPolicy, win_rate
from ..operators.quality import quality_report, require_observations
from ..operators.strategy import simple_metrics, strategy_metrics, strategy_path
from ..scratch import Scratch
from ..sources.market import MarketData, fingerprint, read_table
from ..sources.synthetic import regime_returns
from ..sources.tables import events_hourly, lineitem_daily, orders_daily, segment_daily
from .experiment import simple_experiment
from .records import prediction_records, read_records, write_records
from .oracle import ALL, FEATURES, TARGET, VOLUME, r, ridge_sql, short, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
CONFIG = WalkForwardConfig(250, 20)
GAPPED = WalkForwardConfig(300, 15, 3, 25)
ROLLING = WalkForwardConfig(250, 20, 1, None, 400)
COST = BusinessCost(1.5, 1.0, 0.002, 0.00005)
BASELINES = {"naive_zero": constant(), "historical_mean": historical_mean(), "seasonal_naive_5": seasonal_naive(5)}
TS = "CAST(ts AS VARCHAR) AS ts"


def query(oracle: str | None = None):
    def add(f):
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: shown(f(spark, sf_dir))
        if oracle:
            ORACLE_SQL[name] = oracle.replace(", 6) AS ", ", 6) + 0 AS ")  # no negative zeros; large values see oracle.short
        return f

    return add


def shown(df: DataFrame) -> DataFrame:
    return rounded(df.withColumn("ts", F.col("ts").cast("string")) if "ts" in df.columns else df)


def matrix(spark, sf_dir, source=lineitem_daily) -> DataFrame:
    return fe.supervised_matrix(source(spark, sf_dir))


def tested(spark, sf_dir, source=lineitem_daily, config=CONFIG) -> DataFrame:
    return predictions(matrix(spark, sf_dir, source), config, BASELINES)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, for plans that read it more than once."""
    return Scratch(df.sparkSession, "catalogue").write(df, "rows")


def feature_query(columns: dict) -> str:
    return sql(f"SELECT series_id, {TS}, " + ", ".join(f"round({c}, 6) AS {c}" for c in columns) + " FROM feat")


def _features(spark, sf_dir, columns: dict) -> DataFrame:
    return fe.with_return(lineitem_daily(spark, sf_dir)).withColumns(columns).select("series_id", "ts", *columns)


@query(sql(f"SELECT series_id, {TS}, {r('close', 'volume')} FROM obs"))
def series_lineitem_daily(spark, sf_dir):
    return lineitem_daily(spark, sf_dir)


@query("""SELECT 'lines' AS series_id, count(*) AS observations, count(*) FILTER (WHERE d IS NULL) AS missing_times,
       CAST(count(d) - count(DISTINCT d) AS BIGINT) AS repeated_times,
       count(*) FILTER (WHERE c IS NULL OR NOT isfinite(c) OR c <= 0) AS bad_close,
       count(*) FILTER (WHERE v IS NULL OR NOT isfinite(v) OR v < 0) AS bad_volume
FROM (SELECT CAST(l_shipdate AS DATE) AS d, CAST(l_extendedprice AS DOUBLE) - 20000 AS c, CAST(l_quantity AS DOUBLE) - 10 AS v FROM lineitem)""")
def series_quality_report(spark, sf_dir):
    """Over single lines, whose days repeat, with prices and quantities shifted so that some are out of range."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return quality_report(lines.select(F.lit("lines").alias("series_id"), F.col("l_shipdate").cast("date").alias("ts"), (F.col("l_extendedprice").cast("double") - 20000).alias("close"), (F.col("l_quantity").cast("double") - 10).alias("volume")))


@query(sql("SELECT 'external_market_csv' AS kind, 'events' AS source_name, '' AS sha256, count(*) AS raw_observations, strftime(min(ts), '%Y-%m-%dT%H:%M:%SZ') AS start, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS \"end\", true AS has_volume FROM obs", series="events"))
def series_metadata(spark, sf_dir):
    made = MarketData(events_hourly(spark, sf_dir), "events", "").metadata()
    return spark.createDataFrame([made])


@query("""WITH o AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1),
t AS (SELECT row_number() OVER (ORDER BY d) - 1 AS i, sha256(strftime(d, '%Y-%m-%dT00:00:00.000000Z') || ',' || n || '.0') AS h FROM o),
k AS (SELECT i // 64 AS run, sha256(string_agg(h, chr(10) ORDER BY i)) AS x FROM t GROUP BY 1)
SELECT 'orders' AS series_id, sha256(string_agg(x, chr(10) ORDER BY run)) AS sha256 FROM k""")
def series_fingerprint(spark, sf_dir):
    """Of the number of orders of each day, whose text is the same in any engine; runs of 64, so the tree has two levels."""
    return fingerprint(orders_daily(spark, sf_dir).select("series_id", "ts", F.col("volume").alias("close")), 64)


@query(sql(f"SELECT o.series_id, CAST(o.ts AS VARCHAR) AS ts, round(o.close, 6) AS close, v.volume FROM obs o LEFT JOIN ({sql('SELECT * FROM obs', series='lineitem')}) v ON v.ts = o.ts", series="orders"))
def volume_reindex(spark, sf_dir):
    """Orders' closes with the lines' volume of the same day, null where there is none."""
    volume = lineitem_daily(spark, sf_dir).withColumn("series_id", F.lit("orders"))
    return fe.with_volume(orders_daily(spark, sf_dir).drop("volume"), volume)


@query(sql(f"SELECT series_id, {TS}, round(ret, 6) AS simple_return FROM ret"))
def simple_returns(spark, sf_dir):
    return fe.with_return(lineitem_daily(spark, sf_dir)).select("series_id", "ts", F.col("return").alias("simple_return"))


@query(feature_query({k: v for k, v in FEATURES.items() if "lag" in k}))
def lag_returns(spark, sf_dir):
    return _features(spark, sf_dir, fe.lag_returns())


@query(feature_query({k: v for k, v in FEATURES.items() if "mean" in k}))
def rolling_mean(spark, sf_dir):
    return _features(spark, sf_dir, fe.rolling_means())


@query(feature_query({k: v for k, v in FEATURES.items() if "vol" in k}))
def rolling_vol(spark, sf_dir):
    return _features(spark, sf_dir, fe.rolling_vols())


@query(feature_query({k: v for k, v in FEATURES.items() if "momentum" in k}))
def momentum(spark, sf_dir):
    return _features(spark, sf_dir, fe.momenta())


@query(feature_query(VOLUME))
def volume_features(spark, sf_dir):
    return _features(spark, sf_dir, fe.volume_features())


@query(feature_query(TARGET))
def next_return_target(spark, sf_dir):
    return _features(spark, sf_dir, fe.target())


@query(sql(f"SELECT series_id, {TS}, row_idx, {r(*ALL)} FROM mat"))
def supervised_matrix(spark, sf_dir):
    return matrix(spark, sf_dir)


FOLDS = "SELECT series_id, fold, train_start, train_end, test_start, test_end, train_end - train_start AS train_size, test_end - test_start AS test_size FROM folds"


@query(sql(FOLDS))
def folds_expanding(spark, sf_dir):
    return folds_of(matrix(spark, sf_dir), CONFIG)


@query(sql(FOLDS, gap=1, cap=400))
def folds_rolling(spark, sf_dir):
    return folds_of(matrix(spark, sf_dir), ROLLING)


@query(sql(FOLDS, min_train=300, test=15, gap=3, step=25))
def folds_gap_step(spark, sf_dir):
    return folds_of(matrix(spark, sf_dir), GAPPED)


@query(sql("SELECT count(*) FILTER (WHERE train_end + 3 <> test_start) AS gap_violations, count(*) FILTER (WHERE train_end - train_start < 300) AS train_size_violations, count(*) FILTER (WHERE test_end - test_start < 1) AS test_size_violations FROM folds", min_train=300, test=15, gap=3, step=25))
def fold_isolation_violations(spark, sf_dir):
    return isolation_violations(folds_of(matrix(spark, sf_dir), GAPPED), GAPPED)


@query(sql("SELECT m.series_id, CAST(m.ts AS VARCHAR) AS ts, row_idx, fold FROM mat m JOIN folds f ON m.series_id = f.series_id AND row_idx >= test_start AND row_idx < test_end", min_train=300, test=15, gap=3, step=25))
def fold_test_membership(spark, sf_dir):
    return test_rows(matrix(spark, sf_dir), GAPPED).select("series_id", "ts", "row_idx", "fold")


@query(sql(f"SELECT series_id, fold, {r('train_mean', 'mase_scale')} FROM stats", gap=1, cap=400))
def fold_train_stats(spark, sf_dir):
    return train_statistics(matrix(spark, sf_dir), ROLLING)


@query(sql(f"SELECT series_id, fold, {r('mase_scale')} FROM stats"))
def mase_scale(spark, sf_dir):
    return train_statistics(matrix(spark, sf_dir), CONFIG).select("series_id", "fold", "mase_scale")


def pred_query(block: str, **how) -> str:
    return sql(f"SELECT series_id, {TS}, row_idx, fold, model, {r('actual', 'prediction')} FROM {block}", **how)


@query(pred_query("zero"))
def pred_zero(spark, sf_dir):
    return predict_constant(matrix(spark, sf_dir), CONFIG)


@query(pred_query("hist", gap=1, cap=400))
def pred_historical_mean(spark, sf_dir):
    return predict_historical_mean(matrix(spark, sf_dir), ROLLING)


@query(pred_query("seas", min_train=300, test=15, gap=3, step=25))
def pred_seasonal_naive(spark, sf_dir):
    return predict_seasonal_naive(matrix(spark, sf_dir), GAPPED, 5)


@query(sql(f"SELECT series_id, CAST(min(ts) AS VARCHAR) AS ts, row_idx, fold, round(max(actual), 6) AS actual, " + ", ".join(f"round(max(CASE WHEN model = '{m}' THEN prediction END), 6) AS {m}" for m in BASELINES) + " FROM pred GROUP BY series_id, row_idx, fold"))
def prediction_wide(spark, sf_dir):
    return wide(tested(spark, sf_dir), list(BASELINES))


@query(sql("SELECT (SELECT count(*) FROM (SELECT 1 FROM pred GROUP BY series_id, row_idx, model HAVING count(*) > 1)) AS repeated, (SELECT count(*) FROM pred) AS tested"))
def overlap_check(spark, sf_dir):
    rows = tested(spark, sf_dir)
    return repeated_tests(rows).agg(F.count("*").alias("repeated")).crossJoin(rows.agg(F.count("*").alias("tested")))


@query(sql(f"SELECT series_id, fold, model, {r('mae', 'rmse', 'smape', 'mase')} FROM fm"))
def fold_metrics_report(spark, sf_dir):
    m = matrix(spark, sf_dir)
    return fold_metrics(predictions(m, CONFIG, BASELINES))


@query(sql(f"SELECT pm.series_id, pm.model, {r('mae', 'rmse', 'smape', 'directional_accuracy', 'mean_business_cost', 'total_business_cost', 'action_rate')} FROM pm JOIN pc USING (series_id, model)"))
def pooled_metrics_report(spark, sf_dir):
    return pooled_metrics(tested(spark, sf_dir), COST)


@query(sql(f"SELECT series_id, model, {r('directional_accuracy')} FROM pm", series="orders"))
def directional_accuracy_report(spark, sf_dir):
    return tested(spark, sf_dir, orders_daily).groupBy("series_id", "model").agg(directional_accuracy().alias("directional_accuracy"))


@query(sql(f"SELECT series_id, model, {r('mean_business_cost', 'total_business_cost', 'action_rate')} FROM pc", series="orders"))
def business_cost(spark, sf_dir):
    return tested(spark, sf_dir, orders_daily).groupBy("series_id", "model").agg(*COST.aggregates())


@query(sql("SELECT series_id, model, round(avg(greatest(0.05::DOUBLE * e, -0.95::DOUBLE * e)), 6) AS pinball_05, round(avg(greatest(0.95::DOUBLE * e, -0.05::DOUBLE * e)), 6) AS pinball_95 FROM e GROUP BY 1, 2"))
def pinball_loss(spark, sf_dir):
    return tested(spark, sf_dir).groupBy("series_id", "model").agg(pinball(0.05).alias("pinball_05"), pinball(0.95).alias("pinball_95"))


@query(sql(f"SELECT series_id, model, calibration_size, {r('radius')} FROM rad"))
def conformal_radius_report(spark, sf_dir):
    return conformal_radius(split_segments(tested(spark, sf_dir)).filter("calibrates"))


@query(sql(f"SELECT series_id, {TS}, row_idx, model, {r('actual', 'point', 'lower', 'upper')}, 0.9::DOUBLE AS coverage FROM iv"))
def conformal_intervals(spark, sf_dir):
    split = split_segments(tested(spark, sf_dir))
    return intervals(split.filter(~F.col("calibrates")), conformal_radius(split.filter("calibrates")))


@query(sql("SELECT iv.series_id, iv.model, max(calibration_size) AS calibration_size, round(max(radius), 6) AS radius, round(avg(CASE WHEN actual BETWEEN lower AND upper THEN 1.0::DOUBLE ELSE 0 END), 6) AS coverage, round(avg(upper - lower), 6) AS mean_width, round(avg(greatest(0.05::DOUBLE * (actual - lower), -0.95::DOUBLE * (actual - lower))), 6) AS lower_pinball_loss, round(avg(greatest(0.95::DOUBLE * (actual - upper), -0.05::DOUBLE * (actual - upper))), 6) AS upper_pinball_loss, count(*) AS evaluation_size FROM iv JOIN rad USING (series_id, model) GROUP BY 1, 2"))
def interval_eval(spark, sf_dir):
    return interval_evaluation(tested(spark, sf_dir))


def _small(spark, sf_dir) -> DataFrame:
    """Returns of the test tables are far from market returns; a hundredth of them keeps wealth in range."""
    return tested(spark, sf_dir).withColumn("actual", F.col("actual") / 100)


@query(sql(f"SELECT series_id, model, row_idx, {r('position', 'turnover', 'gross', 'net', 'wealth', 'drawdown')} FROM path"))
def strategy_path_report(spark, sf_dir):
    return strategy_path(_small(spark, sf_dir)).select("series_id", "model", "row_idx", "position", "turnover", "gross", "net", "wealth", "drawdown")


@query(sql("SELECT series_id, model, " + short("product(1 + gross) - 1", "gross_cumulative_return") + ", " + short("arg_max(wealth, row_idx) - 1", "net_cumulative_return") + ", round(avg(turnover), 6) AS average_turnover, round(coalesce(CASE WHEN stddev_samp(net) > 0 THEN avg(net) * 252 / (stddev_samp(net) * sqrt(252.0)) END, 0), 6) AS strategy_sharpe, round(min(drawdown), 6) AS max_drawdown FROM path GROUP BY 1, 2"))
def strategy_metrics_report(spark, sf_dir):
    return strategy_metrics(_small(spark, sf_dir))


@query(sql("SELECT series_id, count(*) AS observations, round(avg(d), 6) AS loss_difference FROM diff GROUP BY 1"))
def loss_difference_report(spark, sf_dir):
    return loss_difference(tested(spark, sf_dir), "historical_mean", "naive_zero").groupBy("series_id").agg(F.count("*").alias("observations"), F.avg("d").alias("loss_difference"))


SAMPLES = 3000


# Block sums are differences of running sums over the series continued with itself.
BOOTSTRAP = f"""SELECT series_id, round(quantile_cont(m, 0.05), 6) AS bootstrap_p05, round(quantile_cont(m, 0.95), 6) AS bootstrap_p95, round(avg(m), 6) AS bootstrap_mean FROM (
  SELECT g.series_id, g.sample, sum(e.before - s.before) / max(g.n) AS m
  FROM (SELECT series_id, n, sample, (sample * 7919 + j * 104729 + sample * j * 31) % n AS start, least(b, n - j * b) AS len
        FROM (SELECT series_id, count(*) AS n, CAST(ceil(pow(count(*), 1.0 / 3)) AS BIGINT) AS b FROM diff GROUP BY 1) z,
             (SELECT unnest(range({SAMPLES})) AS sample) q, (SELECT unnest(range(1000)) AS j) x WHERE j * b < n) g
  JOIN twice s ON s.series_id = g.series_id AND s.i = g.start
  JOIN twice e ON e.series_id = g.series_id AND e.i = g.start + g.len
  GROUP BY 1, 2) GROUP BY 1"""


def _bootstrap(spark, sf_dir, source) -> DataFrame:
    """With starts by integer arithmetic, which other engines can repeat."""
    diff = written(loss_difference(tested(spark, sf_dir, source), "historical_mean", "naive_zero"))
    plan = sampling_plan(diff)
    return bootstrap_intervals(diff, plan, arithmetic_starts(plan, SAMPLES)).select("series_id", "bootstrap_p05", "bootstrap_p95", "bootstrap_mean")


@query(sql(BOOTSTRAP))
def block_bootstrap(spark, sf_dir):
    return _bootstrap(spark, sf_dir, lineitem_daily)


@query(sql(BOOTSTRAP, series="segments"))
def panel_bootstrap(spark, sf_dir):
    """Of every segment at once: length, block and starts are a series' own."""
    return _bootstrap(spark, sf_dir, segment_daily)


@query(sql("SELECT series_id, round(avg(CASE WHEN c < b THEN 1.0::DOUBLE ELSE 0 END), 6) AS fold_win_rate FROM (SELECT series_id, fold, max(CASE WHEN model = 'seasonal_naive_5' THEN mae END) AS c, max(CASE WHEN model = 'naive_zero' THEN mae END) AS b FROM fm GROUP BY 1, 2) GROUP BY 1"))
def fold_win_rate(spark, sf_dir):
    m = matrix(spark, sf_dir)
    return win_rate(fold_metrics(predictions(m, CONFIG, BASELINES)), "seasonal_naive_5", "naive_zero")


DECISION = """SELECT series_id, 'seasonal_naive_5' AS candidate, 'naive_zero' AS baseline, CASE WHEN reasons = '' THEN 'champion' ELSE 'rejected' END AS status,
  CASE WHEN reasons = '' THEN 'all_promotion_gates_passed' ELSE reasons END AS reasons, round(i, 6) AS relative_mae_improvement, round(w, 6) AS fold_win_rate, round(k, 6) AS business_cost_ratio
FROM (SELECT *, concat_ws(',', CASE WHEN i < 0.01 THEN 'relative_mae_improvement_below_threshold' END, CASE WHEN w < 0.5 THEN 'insufficient_fold_win_rate' END, CASE WHEN k > 1 THEN 'business_cost_regression' END) AS reasons
  FROM (SELECT p.series_id, CASE WHEN bm = 0 THEN CASE WHEN cm = 0 THEN 0 ELSE -1 END ELSE (bm - cm) / bm END AS i, w, CASE WHEN bc = 0 THEN CASE WHEN cc = 0 THEN 1 ELSE 1.7976931348623157e308 END ELSE cc / bc END AS k
    FROM (SELECT pm.series_id, max(CASE WHEN model = 'seasonal_naive_5' THEN mae END) AS cm, max(CASE WHEN model = 'naive_zero' THEN mae END) AS bm, max(CASE WHEN model = 'seasonal_naive_5' THEN mean_business_cost END) AS cc, max(CASE WHEN model = 'naive_zero' THEN mean_business_cost END) AS bc FROM pm JOIN pc USING (series_id, model) GROUP BY 1) p
    JOIN (SELECT series_id, avg(CASE WHEN c < b THEN 1.0::DOUBLE ELSE 0 END) AS w FROM (SELECT series_id, fold, max(CASE WHEN model = 'seasonal_naive_5' THEN mae END) AS c, max(CASE WHEN model = 'naive_zero' THEN mae END) AS b FROM fm GROUP BY 1, 2) GROUP BY 1) q USING (series_id)))"""


@query(sql(DECISION, series="segments"))
def promotion_decision(spark, sf_dir):
    m = matrix(spark, sf_dir, segment_daily)
    rows = written(predictions(m, CONFIG, BASELINES))
    made = PromotionPolicy(0.01, 1.0, 0.5).decisions(pooled_metrics(rows, COST), fold_metrics(rows), "seasonal_naive_5", "naive_zero")
    return made.withColumn("reasons", F.array_join("reasons", ","))


@query(sql("SELECT series_id, model, round(avg(abs(actual - prediction)), 6) AS mae, round(avg(CASE WHEN sign(actual) = sign(prediction) THEN 1.0::DOUBLE ELSE 0 END), 6) AS directional_accuracy, round(sqrt(252.0) * avg(sign(prediction) * actual) / (stddev_samp(sign(prediction) * actual) + 1e-12), 6) AS toy_strategy_sharpe FROM pred GROUP BY 1, 2", series="orders"))
def legacy_metrics(spark, sf_dir):
    return simple_metrics(tested(spark, sf_dir, orders_daily))


@query(sql(f"SELECT pm.series_id, pm.model, {r('mae', 'rmse', 'smape', 'directional_accuracy')} FROM pm", series="segments", gap=1))
def panel_segment_backtest(spark, sf_dir):
    return pooled_metrics(tested(spark, sf_dir, segment_daily, WalkForwardConfig(250, 20, 1)))


@query(sql(f"SELECT series_id, fold, model, {r('mae', 'rmse', 'smape', 'mase')} FROM fm", series="events", min_train=200, test=25))
def events_hourly_backtest(spark, sf_dir):
    config = WalkForwardConfig(200, 25)
    m = matrix(spark, sf_dir, events_hourly)
    return fold_metrics(predictions(m, config, BASELINES))


def _flawed(spark, sf_dir) -> DataFrame:
    """The segments' matrix with one series cut short and one whose label never changes."""
    m = written(matrix(spark, sf_dir, segment_daily))
    return m.filter("series_id <> 'BUILDING' OR row_idx < 200").withColumn(fe.TARGET, F.when(F.col("series_id") == "MACHINERY", 0.5).otherwise(F.col(fe.TARGET)))


#: The same in SQL: the block before it, and the series left out of others.
FLAWED = "SELECT * REPLACE (CASE WHEN series_id = 'MACHINERY' THEN 0.5::DOUBLE ELSE target_next_return END AS target_next_return) FROM whole WHERE series_id <> 'BUILDING' OR row_idx < 200"


def flawed_sql(select: str) -> str:
    text = sql(select, series="segments", gap=1)
    a, b = text.split("mat AS (", 1)
    return a + "whole AS (" + b.replace("),\nsizes AS", f"),\nmat AS ({FLAWED}),\nsizes AS", 1)


@query(flawed_sql("""SELECT series_id, 'too_short' AS rule, 'not enough observations: ' || n || ', and the first fold tests row 251' AS reason FROM sizes WHERE n <= 251
UNION ALL SELECT series_id, 'constant_history', 'MASE is undefined for a constant training history: fold ' || min(fold) FROM stats WHERE mase_scale <= 2.220446049250313e-16 GROUP BY 1"""))
def panel_quarantine(spark, sf_dir):
    """Series that a backtest leaves out, and why."""
    return BacktestRunner(WalkForwardConfig(250, 20, 1), BASELINES).run(_flawed(spark, sf_dir)).quarantine


@query(flawed_sql(f"SELECT series_id, fold, model, {r('mae', 'rmse', 'smape', 'mase')} FROM fm WHERE series_id NOT IN (SELECT series_id FROM stats GROUP BY 1 HAVING min(mase_scale) <= 2.220446049250313e-16)"))
def panel_quarantine_metrics(spark, sf_dir):
    """The other series' metrics of the same backtest."""
    return BacktestRunner(WalkForwardConfig(250, 20, 1), BASELINES).run(_flawed(spark, sf_dir)).fold_metrics


@query(sql("SELECT series_id, count(*) AS n, min(row_idx) AS first_row, max(row_idx) AS last_row, count(*) - count(DISTINCT row_idx) AS repeated FROM mat GROUP BY 1", series="segments"))
def matrix_numbering(spark, sf_dir):
    """Of the matrix by ranges of 256 observations: numbers without holes, whatever the ranges."""
    m = fe.supervised_matrix(segment_daily(spark, sf_dir), 256)
    return m.groupBy("series_id").agg(F.count("*").alias("n"), F.min("row_idx").alias("first_row"), F.max("row_idx").alias("last_row"), (F.count("*") - F.countDistinct("row_idx")).alias("repeated"))


@query(sql(f"SELECT series_id, {TS}, row_idx, {r(*ALL)} FROM mat", series="segments"))
def supervised_matrix_ranges(spark, sf_dir):
    """The segments' matrix by ranges of 256 observations, as a long series is worked on."""
    return fe.supervised_matrix(segment_daily(spark, sf_dir), 256)


@query(sql("SELECT series_id, model, fold, count(*) AS tested, count(*) FILTER (WHERE actual > 0) AS rises, min(row_idx) AS first_row FROM pred GROUP BY 1, 2, 3", series="segments"))
def prediction_counts(spark, sf_dir):
    """How many rows each fold of each model tests."""
    rows = tested(spark, sf_dir, segment_daily)
    return rows.groupBy("series_id", "model", "fold").agg(F.count("*").alias("tested"), F.count_if(F.col("actual") > 0).alias("rises"), F.min("row_idx").alias("first_row"))


@query(sql(f"SELECT series_id, {TS}, row_idx, round(actual, 6) AS actual, " + ", ".join(f"round(max(CASE WHEN model = '{m}' THEN prediction END), 6) AS {m}" for m in BASELINES) + " FROM pred GROUP BY series_id, ts, row_idx, actual").replace(f"{TS}, row_idx", "CAST(ts AS VARCHAR) AS timestamp, row_idx"))
def prediction_record_rows(spark, sf_dir):
    """The records of the baselines, written as sorted JSON lines and read back by their listing."""
    records = prediction_records(tested(spark, sf_dir), list(BASELINES))
    folder = Scratch(spark, "records").path("sink")
    write_records(records, folder)
    return read_records(spark, folder, records.schema)


@query("SELECT 'customers' AS series_id, CAST(o_orderdate AS DATE)::VARCHAR AS ts, round(max(CAST(o_totalprice AS DOUBLE)), 6) AS close, CAST(count(DISTINCT o_custkey) AS DOUBLE) AS volume FROM orders GROUP BY 2")
def table_series(spark, sf_dir):
    """A series from a table that Spark reads: a day's largest order, and its customers."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.max(F.col("o_totalprice").cast("double")).alias("top"), F.countDistinct("o_custkey").alias("customers"))
    path = Scratch(spark, "table").path("days")
    orders.write.parquet(path)
    return read_table(spark, path, "day", "top", "customers").withColumn("series_id", F.lit("customers"))


@query(sql("SELECT count(*) AS rows, count(*) FILTER (WHERE mean_60 IS NULL OR NOT isfinite(mean_60) OR target_next_return IS NULL) AS bad, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in ("return_lag_1", "mean_60", "momentum_20", "volume_z_20")) + " FROM mat", series="segments"))
def matrix_checked(spark, sf_dir):
    """A checked matrix that names no future and is finite throughout."""
    m = written(fe.checked_matrix(segment_daily(spark, sf_dir)))
    fe.assert_no_leakage(m)
    return m.agg(F.count("*").alias("rows"), F.count_if(F.col("mean_60").isNull() | F.isnan("mean_60") | F.col(fe.TARGET).isNull()).alias("bad"), *(F.avg(c).alias(c) for c in ("return_lag_1", "mean_60", "momentum_20", "volume_z_20")))


@query()
def simple_backtest(spark, sf_dir):
    """The older flow: price features, boosting of 150 rounds, metrics without costs."""
    return simple_experiment(lineitem_daily(spark, sf_dir))


SHOCK_ROWS = 400


@query(f"""WITH RECURSIVE s AS (SELECT i, CASE WHEN i < {SHOCK_ROWS} * 0.35::DOUBLE THEN 0.12::DOUBLE WHEN i < {SHOCK_ROWS} * 0.70::DOUBLE THEN -0.08::DOUBLE ELSE 0.05::DOUBLE END AS phi,
    0.0015::DOUBLE * sin(i / 17.0::DOUBLE) + CASE WHEN i < {SHOCK_ROWS} * 0.35::DOUBLE THEN 0.010::DOUBLE WHEN i < {SHOCK_ROWS} * 0.70::DOUBLE THEN 0.016::DOUBLE ELSE 0.008::DOUBLE END * (((i * 7919) % 2001 - 1000) / 500.0::DOUBLE) AS push
  FROM (SELECT unnest(range(CAST({SHOCK_ROWS} AS BIGINT))) AS i)),
a AS (SELECT CAST(0 AS BIGINT) AS i, 0.0::DOUBLE AS ret UNION ALL SELECT s.i, s.phi * a.ret + s.push FROM a JOIN s ON s.i = a.i + 1)
SELECT 'shocks' AS series_id, i, round(ret, 6) AS simple_return FROM a""")
def ar_regime_recursion(spark, sf_dir):
    """The synthetic recursion on shocks by integer arithmetic."""
    z = ((F.col("id") * 7919) % 2001 - 1000) / F.lit(500.0)
    made = regime_returns(spark.range(SHOCK_ROWS).select(F.lit("shocks").alias("series_id"), F.col("id").alias("i"), z.alias("z")))
    return made.select("series_id", "i", F.col("return").alias("simple_return"))


#: Folds of the evidence flow, as in plans/experiment.py.
EVIDENCE = WalkForwardConfig(250, 25, 1)


@query(ridge_sql())
def ridge_backtest(spark, sf_dir):
    return pooled_metrics(predictions(matrix(spark, sf_dir), CONFIG, {"ridge": ridge_regression()}))


@query(ridge_sql(offset="1e6", series="segments", cap=400, gap=1))
def ridge_shifted_backtest(spark, sf_dir):
    """Rolling folds of the segments, with a feature whose mean is a million times its deviation."""
    m = matrix(spark, sf_dir, segment_daily).withColumn("return_lag_1", F.col("return_lag_1") + 1e6)
    return pooled_metrics(predictions(m, ROLLING, {"ridge": ridge_regression()}))


@query()
def boosting_backtest(spark, sf_dir):
    return pooled_metrics(predictions(matrix(spark, sf_dir), CONFIG, {"gradient_boosting": gradient_boosting()}))


INTERVALS = sql("SELECT iv.series_id, iv.model, max(calibration_size) AS calibration_size, round(max(radius), 6) AS radius, round(avg(CASE WHEN actual BETWEEN lower AND upper THEN 1.0::DOUBLE ELSE 0 END), 6) AS coverage, round(avg(upper - lower), 6) AS mean_width, round(avg(greatest(0.05::DOUBLE * (actual - lower), -0.95::DOUBLE * (actual - lower))), 6) AS lower_pinball_loss, round(avg(greatest(0.95::DOUBLE * (actual - upper), -0.05::DOUBLE * (actual - upper))), 6) AS upper_pinball_loss, count(*) AS evaluation_size FROM iv JOIN rad USING (series_id, model) WHERE iv.model = 'seasonal_naive_5' GROUP BY 1, 2", series="segments", test=25, gap=1)


def _evidence(spark, sf_dir, models, candidate: str) -> DataFrame:
    """Decision gates of a candidate against the zero forecast, and its interval, for each segment's series."""
    rows = written(predictions(matrix(spark, sf_dir, segment_daily), EVIDENCE, models))
    made = PromotionPolicy(0.01, 1.0, 0.5).decisions(pooled_metrics(rows, COST), fold_metrics(rows), candidate, "naive_zero")
    return made.withColumn("reasons", F.array_join("reasons", ",")).join(interval_evaluation(rows.filter(F.col("model") == candidate)), "series_id")


@query("SELECT * FROM (" + sql(DECISION, series="segments", test=25, gap=1) + ") JOIN (" + INTERVALS + ") USING (series_id)")
def evidence_baselines(spark, sf_dir):
    """The evidence flow with the baselines alone."""
    return _evidence(spark, sf_dir, BASELINES, "seasonal_naive_5")


@query()
def evidence_summary(spark, sf_dir):
    """The evidence flow with all five default models."""
    return _evidence(spark, sf_dir, default_models(), "gradient_boosting")


@query(sql("SELECT m.series_id, row_idx, fold FROM mat m JOIN folds f ON m.series_id = f.series_id AND row_idx >= train_start AND row_idx < train_end", series="events", min_train=200, test=25, cap=220))
def fold_train_membership(spark, sf_dir):
    """Training rows of each of the rolling folds."""
    config = WalkForwardConfig(200, 25, max_train_size=220)
    return train_rows(matrix(spark, sf_dir, events_hourly), config).select("series_id", "row_idx", "fold")


def refused(call) -> str:
    """What a call is refused for, in its first three words; empty if it isn't."""
    try:
        call()
    except (TypeError, ValueError) as e:
        return " ".join(str(e).split()[:3]).rstrip(":,")
    return ""


REFUSALS = {
    "bad close": "close must be",
    "infinite feature": "features and target",
    "short series": "not enough observations",
    "infinite error": "paired vectors need",
    "bad interval": "an interval has",
    "bad prediction": "invalid prediction vector",
    "policy bound": "min_fold_win_rate is out",
    "metric of nothing": "metric inputs must",
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in REFUSALS.items()) + ") AS t(made, refusal)")
def refusals(spark, sf_dir):
    """Tables of the orders' series made wrong in one way each, and what the checks say of them."""
    m = written(matrix(spark, sf_dir, orders_daily))
    rows = written(predictions(m, CONFIG, BASELINES))
    wrong = F.when(F.col("row_idx") == 300, float("inf"))
    made = {
        "bad close": lambda: require_observations(orders_daily(spark, sf_dir).withColumn("close", F.col("close") - F.col("close"))),
        "infinite feature": lambda: fe.assert_no_leakage(m.withColumn("mean_5", F.coalesce(wrong, "mean_5"))),
        "short series": lambda: BacktestRunner(WalkForwardConfig(100_000, 20), BASELINES).run(m),
        "infinite error": lambda: paired_bootstrap(rows.withColumn("prediction", F.coalesce(wrong, "prediction")), "historical_mean", "naive_zero"),
        "bad interval": lambda: require_intervals(rows.select(F.col("prediction").alias("point"), F.col("prediction").alias("lower"), (F.col("prediction") - 1).alias("upper"), F.lit(0.9).alias("coverage"))),
        "bad prediction": lambda: require_valid(rows.withColumn("prediction", F.coalesce(wrong, "prediction"))),
        "policy bound": lambda: PromotionPolicy(min_fold_win_rate=2.0),
        "metric of nothing": lambda: evaluate_pair(rows.filter("false"), mae()),
    }
    return spark.createDataFrame([(k, refused(f)) for k, f in made.items()], "made string, refusal string")


@query(sql("SELECT model AS method, calibration_size, round(radius, 6) AS radius, 0.9::DOUBLE AS target_coverage FROM rad WHERE model = 'naive_zero'").replace("model AS method", "'split_conformal_absolute_residual' AS method"))
def calibrator_metadata(spark, sf_dir):
    """Of a calibrator fitted on the earlier segment of the zero forecast."""
    rows = split_segments(tested(spark, sf_dir)).filter("calibrates and model = 'naive_zero'")
    return spark.createDataFrame([SplitConformalCalibrator(0.9).fit(rows).metadata()])


def flagship(spark, sf_dir) -> DataFrame:
    return QUERIES["pooled_metrics_report"](spark, sf_dir)
