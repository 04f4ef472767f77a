"""DuckDB SQL for the catalogue's queries, put together from named blocks.

``sql(select, *blocks)`` writes a WITH clause of the blocks a query names and those that they need.
"""

from __future__ import annotations

import re

LAGS, SPANS = (1, 2, 3, 5, 10, 20), (5, 10, 20, 60)
W = "(PARTITION BY series_id ORDER BY ts)"

SERIES = {
    "lineitem": "SELECT 'lineitem' AS series_id, CAST(l_shipdate AS DATE) AS ts, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS close, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS volume FROM lineitem GROUP BY 2",
    "orders": "SELECT 'orders' AS series_id, CAST(o_orderdate AS DATE) AS ts, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS close, CAST(count(*) AS DOUBLE) AS volume FROM orders GROUP BY 2",
    "events": "SELECT 'events' AS series_id, date_trunc('hour', CAST(ts AS TIMESTAMP)) AS ts, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) / count(value) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 2",
    "segments": "SELECT c_mktsegment AS series_id, CAST(o_orderdate AS DATE) AS ts, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS close, CAST(count(*) AS DOUBLE) AS volume FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2",
}


def over(k: int, f: str, x: str = "ret") -> str:
    frame = f"OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({x}) {frame} = {k} THEN {f}({x}) {frame} END"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER {W}"


def momentum(k: int) -> str:
    return f"({lag('close')}) / nullif({lag('close', k + 1)}, 0) - 1"


FEATURES = {f"return_lag_{k}": lag("ret", k) for k in LAGS}
for _k in SPANS:
    FEATURES |= {f"mean_{_k}": over(_k, "avg"), f"vol_{_k}": over(_k, "stddev_samp"), f"momentum_{_k}": momentum(_k)}
VOLUME = {
    "volume_change_lag_1": f"({lag('volume')}) / nullif({lag('volume', 2)}, 0) - 1",
    "volume_z_20": f"(({lag('volume')}) - ({over(20, 'avg', 'volume')})) / nullif({over(20, 'stddev_samp', 'volume')}, 0)",
}
TARGET = {"target_next_return": f"lead(ret, 1) OVER {W}"}
ALL = FEATURES | VOLUME | TARGET


def blocks(series: str = "lineitem", min_train=250, test=20, gap=0, step=None, cap=None, offset="0") -> dict[str, str]:
    step = step or test
    ts0 = min_train + gap
    start = f"greatest(0, {ts0} + k * {step} - {gap} - {cap})" if cap else "0"
    fold = f"CAST(floor((row_idx - {ts0}) / CAST({step} AS DOUBLE)) AS BIGINT)"
    return {
        "obs": SERIES[series],
        "ret": f"SELECT *, close / nullif({lag('close')}, 0) - 1 AS ret FROM obs",
        "feat": "SELECT series_id, ts, " + ", ".join(f"{e} AS {n}" for n, e in ALL.items()) + " FROM ret",
        "mat": f"SELECT *, row_number() OVER {W} - 1 AS row_idx FROM feat WHERE " + " AND ".join(f"{n} IS NOT NULL AND isfinite({n})" for n in ALL),
        "sizes": "SELECT series_id, count(*) AS n FROM mat GROUP BY 1",
        "folds": f"""SELECT series_id, k AS fold, CAST({start} AS BIGINT) AS train_start, {ts0} + k * {step} - {gap} AS train_end, {ts0} + k * {step} AS test_start, least({ts0} + k * {step} + {test}, n) AS test_end
            FROM (SELECT series_id, n, unnest(range(0, CAST(ceil((n - {ts0}) / CAST({step} AS DOUBLE)) AS BIGINT))) AS k FROM sizes WHERE n > {ts0})""",
        "oos": f"SELECT series_id, ts, row_idx, {fold} AS fold, target_next_return AS actual FROM mat WHERE row_idx >= {ts0} AND row_idx - {ts0} - {fold} * {step} < {test}",
        "train": "SELECT f.series_id, fold, row_idx, target_next_return AS y, abs(target_next_return - lag(target_next_return) OVER (PARTITION BY f.series_id, fold ORDER BY row_idx)) AS d FROM folds f JOIN mat m ON m.series_id = f.series_id AND row_idx >= train_start AND row_idx < train_end",
        "stats": "SELECT series_id, fold, avg(y) AS train_mean, avg(d) AS mase_scale FROM train GROUP BY 1, 2",
        "ridge_v": f"SELECT series_id, row_idx, [{', '.join(c + f' + {offset}' * (c == 'return_lag_1') for c in ALL)}] AS v FROM mat",
        "ridge_train": "SELECT f.series_id, fold, v FROM folds f JOIN ridge_v m ON m.series_id = f.series_id AND row_idx >= train_start AND row_idx < train_end",
        "ridge_mean": f"SELECT series_id, fold, list(mean ORDER BY i) AS m FROM (SELECT series_id, fold, i, avg(v[i]) AS mean FROM ridge_train, (SELECT unnest(range(1, {len(ALL)} + 1)) AS i) a GROUP BY 1, 2, 3) GROUP BY 1, 2",
        "ridge_cov": f"""SELECT series_id, fold, i, j, count(*) AS n, any_value(m[i]) AS mean, avg((v[i] - m[i]) * (v[j] - m[j])) AS cov
            FROM ridge_train JOIN ridge_mean USING (series_id, fold),
            (SELECT unnest(range(1, {len(ALL)} + 1)) AS i) a, (SELECT unnest(range(1, {len(ALL)} + 1)) AS j) b GROUP BY 1, 2, 3, 4""",
        "ridge_scale": f"SELECT series_id, fold, i, mean, CASE WHEN i <= {len(ALL) - 1} AND cov > 0 THEN sqrt(cov) ELSE 1 END AS scale FROM ridge_cov WHERE i = j",
        "zero": "SELECT *, 'naive_zero' AS model, 0.0::DOUBLE AS prediction FROM oos",
        "hist": "SELECT o.*, 'historical_mean' AS model, train_mean AS prediction FROM oos o JOIN stats USING (series_id, fold)",
        "seas": "SELECT o.*, 'seasonal_naive_5' AS model, m.target_next_return AS prediction FROM oos o JOIN folds f USING (series_id, fold) JOIN mat m ON m.series_id = o.series_id AND m.row_idx = f.train_end - 5 + (o.row_idx - f.test_start) % 5",
        "pred": "SELECT * FROM zero UNION ALL SELECT * FROM hist UNION ALL SELECT * FROM seas",
        "e": "SELECT *, actual - prediction AS e, abs(actual) + abs(prediction) AS size FROM pred",
        # Returns of the test tables are far from market returns; a hundredth of them keeps wealth in range.
        "small": "SELECT series_id, model, row_idx, actual / 100 AS actual, prediction FROM pred",
        "pos": "SELECT *, CAST(sign(prediction) AS DOUBLE) AS position FROM small",
        "turn": "SELECT *, coalesce(abs(position - lag(position) OVER m), abs(position)) AS turnover, position * actual AS gross FROM pos WINDOW m AS (PARTITION BY series_id, model ORDER BY row_idx)",
        "net": "SELECT *, gross - turnover * 0.0005 AS net FROM turn",
        "wealth": "SELECT *, product(1 + net) OVER (PARTITION BY series_id, model ORDER BY row_idx ROWS UNBOUNDED PRECEDING) AS wealth FROM net",
        "path": "SELECT *, wealth / max(wealth) OVER (PARTITION BY series_id, model ORDER BY row_idx ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM wealth",
        "seg": "SELECT *, row_number() OVER (PARTITION BY series_id, model ORDER BY row_idx) <= greatest(2, floor(count(*) OVER (PARTITION BY series_id, model) * 0.4::DOUBLE)) AS calibrates FROM pred",
        "res": "SELECT series_id, model, abs(actual - prediction) AS radius, row_number() OVER (PARTITION BY series_id, model ORDER BY abs(actual - prediction)) AS place, count(*) OVER (PARTITION BY series_id, model) AS calibration_size FROM seg WHERE calibrates",
        "rad": "SELECT series_id, model, calibration_size, radius FROM res WHERE place = least(calibration_size, ceil(CAST(calibration_size + 1 AS DOUBLE) * 0.9::DOUBLE))",
        "iv": "SELECT s.series_id, s.ts, s.row_idx, s.model, s.actual, s.prediction AS point, s.prediction - radius AS lower, s.prediction + radius AS upper FROM seg s JOIN rad USING (series_id, model) WHERE NOT calibrates",
        "cost": "SELECT *, CASE WHEN e >= 0 THEN e * 1.5::DOUBLE ELSE -e END + CASE WHEN abs(prediction) > 0.002 THEN 0.00005::DOUBLE ELSE 0 END AS c, CASE WHEN abs(prediction) > 0.002 THEN 1.0::DOUBLE ELSE 0 END AS acts FROM e",
        "diff": "SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY row_idx) - 1 AS i, max(CASE WHEN model = 'historical_mean' THEN abs(e) END) - max(CASE WHEN model = 'naive_zero' THEN abs(e) END) AS d FROM e GROUP BY series_id, row_idx",
        "twice": "SELECT series_id, i, coalesce(sum(d) OVER (PARTITION BY series_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT series_id, i, d FROM diff UNION ALL SELECT series_id, i + count(*) OVER (PARTITION BY series_id), d FROM diff)",
        "fm": "SELECT e.series_id, fold, model, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, avg(CASE WHEN size > 0 THEN 2 * abs(e) / size ELSE 0 END) AS smape, avg(abs(e)) / max(mase_scale) AS mase FROM e JOIN stats USING (series_id, fold) GROUP BY 1, 2, 3",
        "pm": "SELECT series_id, model, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, avg(CASE WHEN size > 0 THEN 2 * abs(e) / size ELSE 0 END) AS smape, avg(CASE WHEN sign(actual) = sign(prediction) THEN 1.0::DOUBLE ELSE 0 END) AS directional_accuracy FROM e GROUP BY 1, 2",
        "pc": "SELECT series_id, model, avg(c) AS mean_business_cost, sum(c) AS total_business_cost, avg(acts) AS action_rate FROM cost GROUP BY 1, 2",
    }


def sql(select: str, **how) -> str:
    """WITH the blocks that select needs, in order, then select."""
    have = blocks(**how)
    needed: set[str] = set()

    def need(text: str) -> None:
        for name in have:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                needed.add(name)
                need(have[name])

    need(select)
    return "WITH " + ",\n".join(f"{n} AS ({have[n]})" for n in have if n in needed) + "\n" + select


def short(x: str, name: str) -> str:
    """x rounded as results are: large values to fewer places."""
    return f"CASE WHEN abs({x}) < 1e6 THEN round({x}, 6) + 0 ELSE round({x}, 2) END AS {name}"


def r(*columns: str) -> str:
    """Rounded columns under their own names."""
    return ", ".join(short(c, c) for c in columns)


def ridge_sql(alpha: float = 3.0, **how) -> str:
    """Pooled metrics of ridge regression: covariances of each fold's training rows, and elimination over lists."""
    n = len(ALL) - 1
    return sql(f"""SELECT series_id, 'ridge' AS model, {short("avg(abs(e))", "mae")}, {short("sqrt(avg(e * e))", "rmse")},
  {short("avg(CASE WHEN abs(actual) + abs(p) > 0 THEN 2 * abs(e) / (abs(actual) + abs(p)) ELSE 0 END)", "smape")},
  {short("avg(CASE WHEN sign(actual) = sign(p) THEN 1.0::DOUBLE ELSE 0 END)", "directional_accuracy")}
FROM (SELECT series_id, actual, p, actual - p AS e FROM (
  SELECT o.series_id, o.row_idx, max(o.actual) AS actual, max(y.mean) + sum(w * (x - s.mean) / s.scale) AS p
  FROM (SELECT series_id, fold, i, m[i][{n + 1}] AS w FROM (
      WITH RECURSIVE step AS (
        SELECT series_id, fold, 1 AS k, m FROM (
          SELECT series_id, fold, list(line ORDER BY i) AS m FROM (
            SELECT c.series_id, c.fold, c.i, list(CASE WHEN c.j = {n + 1} THEN c.cov / a.scale ELSE c.cov / (a.scale * b.scale) + CASE WHEN c.i = c.j THEN {alpha}::DOUBLE / c.n ELSE 0 END END ORDER BY c.j) AS line
            FROM ridge_cov c JOIN ridge_scale a ON a.series_id = c.series_id AND a.fold = c.fold AND a.i = c.i
            JOIN ridge_scale b ON b.series_id = c.series_id AND b.fold = c.fold AND b.i = c.j WHERE c.i <= {n} GROUP BY 1, 2, 3) GROUP BY 1, 2)
        UNION ALL
        SELECT series_id, fold, k + 1, list_transform(range(1, {n + 1}), lambda i: CASE WHEN i = k THEN list_transform(m[k], lambda z: z / m[k][k]) ELSE list_transform(range(1, {n + 2}), lambda j: m[i][j] - m[i][k] / m[k][k] * m[k][j]) END)
        FROM step WHERE k <= {n})
      SELECT series_id, fold, m, unnest(range(1, {n + 1})) AS i FROM step WHERE k = {n + 1})) w
  JOIN ridge_scale s USING (series_id, fold, i)
  JOIN ridge_scale y ON y.series_id = w.series_id AND y.fold = w.fold AND y.i = {n + 1}
  JOIN oos o ON o.series_id = w.series_id AND o.fold = w.fold
  JOIN (SELECT series_id, row_idx, unnest(v) AS x, unnest(range(1, {n + 2})) AS i FROM ridge_v) x ON x.series_id = o.series_id AND x.row_idx = o.row_idx AND x.i = w.i
  GROUP BY 1, 2)) GROUP BY 1""", **how)
