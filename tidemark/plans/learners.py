"""Registered queries: the arena, pooled tree models and trained window models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scores import METRICS
from tidemark.operators import scoring, splits, trees, windowmodels
from tidemark.operators.arima import Order
from tidemark.operators.axis import shared_folder
from tidemark.operators.lagmodels import after_lags
from tidemark.plans import arena
from tidemark.plans import panels as P
from tidemark.plans.arena import SCORE_COLUMNS, ArenaConfig
from tidemark.plans.describe import report_sql
from tidemark.plans.registry import query
from tidemark.plans.rounding import r, rounded
from tidemark.plans.sqlmodels import PHASES, lag_ctes, order_ctes, phases_cte

W = "WITH "
LINEAR = ["arima", "arma", "linear_regression", "arimax"]
LINEAR_CONFIG = ArenaConfig(settings={"arima": {"order": (2, 0, 0)}, "arma": {"order": (1, 0)}})


def _board_sql() -> str:
    text = W + P.FILLED + phases_cte("filled", PHASES)
    text += order_ctes(Order(2, 0, 0), "two") + order_ctes(Order(1, 0, 0), "one") + lag_ctes(4)
    paths = [
        f"SELECT p.entity, p.phase, '{key}' AS model_key, s.value AS actual, p.predicted FROM {name}_path p "
        "JOIN filled s ON p.entity = s.entity AND p.rn = s.rn"
        for key, name in (("arima", "two"), ("arma", "one"))
    ]
    paths.append("SELECT entity, phase, 'linear_regression', actual, predicted FROM lagged_path")
    metrics = ", ".join(r(e, m, 6) for m, e in report_sql().items())
    wide = ", ".join(
        f"max({m}) FILTER (phase = '{phase}') AS {phase}_{m}" for phase in ("validation", "test") for m in METRICS
    )
    return text + f""",
preds AS ({' UNION ALL '.join(paths)}),
report AS (SELECT entity, model_key, phase, {metrics} FROM preds GROUP BY ALL),
wide AS (SELECT entity, model_key, {wide} FROM report GROUP BY ALL),
models AS (SELECT * FROM (VALUES (1, 'arima', 'ARIMA', 'Econometrics', 'ok', NULL), (2, 'arma', 'ARMA', 'Econometrics', 'ok',
  NULL), (3, 'linear_regression', 'Linear Regression', 'Lag models', 'ok', NULL),
  (4, 'arimax', 'ARIMAX', 'Econometrics', 'skipped', 'Needs exogenous columns.'))
  m(model_order, model_key, model, family, status, error)),
board AS (SELECT s.entity, m.*, w.* EXCLUDE (entity, model_key) FROM (SELECT DISTINCT entity FROM filled) s CROSS JOIN models m
  LEFT JOIN wide w ON w.entity = s.entity AND w.model_key = m.model_key)"""


def linear_arena(spark, folder):
    return arena.run(P.filled_series(spark, folder), LINEAR, LINEAR_CONFIG)


@query("arena_leaderboard", _board_sql() + " SELECT * FROM board")
def arena_leaderboard(spark, folder):
    board = linear_arena(spark, folder).board.drop("duration_seconds")
    return rounded(board, *SCORE_COLUMNS, digits=6)


@query(
    "rank_models",
    _board_sql() + """ SELECT entity, model, validation_rmse,
    row_number() OVER (PARTITION BY entity ORDER BY validation_rmse, model_order) AS place FROM board WHERE status = 'ok'""",
)
def rank_models(spark, folder):
    ranked = linear_arena(spark, folder).ranked("rmse")
    return rounded(ranked.select("entity", "model", "validation_rmse", "place"), "validation_rmse", digits=6)


@query(
    "arena_headline",
    _board_sql() + """ SELECT entity, arg_min(model, (validation_rmse, model_order)) FILTER (status = 'ok') AS best_model,
    min(test_rmse) FILTER (status = 'ok') AS best_test_rmse, count(*) FILTER (status = 'ok') AS succeeded,
    count(*) FILTER (status <> 'ok') AS failed_or_skipped FROM board GROUP BY entity""",
)
def arena_headline(spark, folder):
    return rounded(linear_arena(spark, folder).headline("rmse"), "best_test_rmse", digits=6)


def _isolation_sql() -> str:
    text = W + P.USER_SERIES + phases_cte("usr", PHASES)
    text += order_ctes(Order(1, 0, 1), "a") + order_ctes(Order(1, 0, 1, 1, 1, 0, 7, const=False), "s")
    fitted = " UNION ALL ".join(
        f"SELECT '{key}' AS model_key, CASE WHEN entity IN (SELECT entity FROM {name}_path) THEN 'ok' ELSE 'error' END AS status "
        "FROM (SELECT DISTINCT entity FROM usr)"
        for key, name in (("arima", "a"), ("sarima", "s"))
    )
    # The other families need fewer rows than the shortest series has; one is skipped for want of regressors.
    rest = " UNION ALL ".join(
        f"SELECT '{key}', '{status}' FROM (SELECT DISTINCT entity FROM usr)"
        for key, status in (("trend_fourier", "ok"), ("window_linear", "ok"), ("arimax", "skipped"))
    )
    return text + f" SELECT model_key, status, count(*) AS series FROM ({fitted} UNION ALL {rest}) GROUP BY ALL"


@query("model_isolation", _isolation_sql())
def model_isolation(spark, folder):
    """Outcomes of several families on short daily series: scored, failed for a series, skipped."""
    panel = P.user_series(spark, folder)
    config = ArenaConfig(settings={"sarima": {"seasonal": (1, 1, 0, 7)}})
    board = arena.run(panel, ["arima", "sarima", "trend_fourier", "window_linear", "arimax"], config).board
    return board.groupBy("model_key", "status").agg(F.count(F.lit(1)).alias("series"))


def _tree_query(key: str, family: str, **settings):
    @query(key)
    def plan(spark, folder):
        series = P.user_series(spark, folder)
        _, predictions = trees.lag_trees(series, family, after_lags(4, 0.2), 4, **settings)
        report = scoring.regression_report(predictions, ["entity", "phase"]).drop("phase")
        return rounded(report, *METRICS, digits=6)

    return plan


# Fewer and shallower trees than the library defaults, as thousands of boosting jobs take minutes in one process.
_tree_query("lag_random_forest", "random_forest", numTrees=20, maxDepth=8)
_tree_query("lag_gradient_boosting", "gradient_boosting", maxIter=10)
_tree_query("lag_boosted_subsampled", "boosted_subsampled", maxIter=10)


def _windows(spark, folder):
    return windowmodels.window_rows(P.user_series(spark, folder), splits.holdout(0.2), 4)


@query("validation_early_stop")
def validation_early_stop(spark, folder):
    rows = _windows(spark, folder)
    model = windowmodels.fit_with_early_stop(rows, maxIter=12)
    report = scoring.regression_report(windowmodels.predict_windows(model, rows), ["split"])
    shown = report.withColumns({"rounds": F.lit(model.getNumTrees), "look_back": F.lit(4)})
    return rounded(shown, *METRICS, digits=6)


@query("fit_history")
def fit_history(spark, folder):
    rows = _windows(spark, folder)
    model = windowmodels.fit_with_early_stop(rows, maxIter=8)
    return rounded(windowmodels.fit_history(model, rows, "test_fit"), "loss", "val_loss")


@query("stack_histories")
def stack_histories(spark, folder):
    rows = windowmodels.window_rows(P.user_series(spark, folder), splits.two_phases(0.6, 0.2, 0.2), 4)
    histories = {}
    for phase in ("validation", "test"):
        mine = rows.filter(F.col("phase") == phase)
        model = windowmodels.fit_with_early_stop(mine, maxIter=6)
        histories[f"{phase}_fit"] = windowmodels.fit_history(model, mine, phase)
    return rounded(windowmodels.stack_histories(histories), "loss", "val_loss")


@query("random_search")
def random_search(spark, folder):
    _, table = windowmodels.random_search(_windows(spark, folder), trials=3)
    return rounded(table, "learning_rate", "val_loss")


@query("save_load_model")
def save_load_model(spark, folder):
    import uuid

    series = P.user_series(spark, folder)
    rows = windowmodels.window_rows(series, splits.holdout(0.2), 4)
    model = windowmodels.fit_with_early_stop(rows, maxIter=6)
    path = windowmodels.save_model(model, rows, f"{shared_folder(spark)}/model-{uuid.uuid4().hex}")
    loaded, limits = windowmodels.load_model(spark, path)
    return rounded(windowmodels.forecast_windows(loaded, limits, series, 3, 4).drop("phase"), "predicted", digits=6)
