"""Queries over realized variance and the daily models built on it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models
from ..operators import variance as rv_ops
from ..operators.returns import clip_returns, log_returns
from . import inputs
from .registry import query
from .series import _KEYED
from .sql import clip, ln, r, statement


@query(
    "realized_variance",
    statement(f"SELECT index_date, {r('rv')} AS rv, {r('sqrt(252 * rv)')} AS rv_an FROM rv", "rv"),
)
def realized_variance(spark, folder):
    return inputs.daily_rv(spark, folder)


@query(
    "realized_variance_by_key",
    _KEYED
    + f"""SELECT event_type, index_date, {r('rv')} AS rv, {r('sqrt(252 * rv)')} AS rv_an FROM (
        SELECT event_type, index_date, sum(ret * ret) AS rv FROM (
            SELECT event_type, index_date, {clip('raw')} AS ret FROM (
                SELECT *, {ln('last_price')} - lag({ln('last_price')})
                    OVER (PARTITION BY event_type, index_date ORDER BY index_time) AS raw FROM padded))
        WHERE ret IS NOT NULL GROUP BY 1, 2) WHERE rv <> 0""",
)
def realized_variance_by_key(spark, folder):
    keys = ["event_type"]
    return rv_ops.realized_variance(inputs.returns(spark, folder, keys), keys)


def _sparse(spark, folder, grid=rv_ops.SPARSE_GRID, overnight="include"):
    return rv_ops.sparse_rv_calendar(inputs.padded(spark, folder), grid, overnight)


@query(
    "sparse_rv_calendar",
    statement(
        f"""SELECT s_grid, index_date, {r('rv_sparse')} AS rv_sparse, {r('sqrt(252 * rv_sparse)')} AS rv_sparse_an
        FROM sparse WHERE s_grid = 5""",
        "sparse",
    ),
)
def sparse_rv_calendar(spark, folder):
    return _sparse(spark, folder, [5])


@query(
    "sparse_rv_all",
    statement(
        f"""SELECT s_grid, index_date, {r('rv_sparse')} AS rv_sparse, {r('sqrt(252 * rv_sparse)')} AS rv_sparse_an
        FROM sparse""",
        "sparse",
    ),
)
def sparse_rv_all(spark, folder):
    return _sparse(spark, folder)


@query(
    "sparse_rv_exclude",
    statement(
        f"""SELECT s_grid, index_date, {r('sum(ret * ret)')} AS rv_sparse,
            {r('sqrt(252 * sum(ret * ret))')} AS rv_sparse_an FROM (
            SELECT s_grid, index_date, {ln('last_price')} - lag({ln('last_price')})
                OVER (PARTITION BY s_grid, index_date ORDER BY index_time) AS ret FROM sampled)
        WHERE ret IS NOT NULL AND NOT isnan(ret) GROUP BY 1, 2""",
        "sampled",
    ),
)
def sparse_rv_exclude(spark, folder):
    return _sparse(spark, folder, overnight="exclude")


@query(
    "signature_curve",
    statement(f"SELECT s_grid, {r('avg(rv_sparse)')} AS mean_rv_sparse FROM sparse GROUP BY 1", "sparse"),
)
def signature_curve(spark, folder):
    return rv_ops.signature_curve(_sparse(spark, folder))


_PERIODS = (5, 10, 15, 30)
_RANKS = [f"rank{s}" for s in _PERIODS]
_ROLLED = "\nUNION ALL ".join(
    f"""SELECT {s} AS s_grid, index_date, sum(ret * ret) AS rv_sparse FROM rank{s}
        WHERE (rn - 1) % {s} = 0 GROUP BY 1, 2"""
    for s in _PERIODS
)


def _returns(spark, folder):
    series = inputs.returns(spark, folder).select("index_date", "index_time", "log_ret")
    return inputs.stage(series, "returns")


@query(
    "sparse_rv_rolling",
    statement(
        f"""SELECT CAST(s_grid AS BIGINT) AS s_grid, index_date, {r('rv_sparse')} AS rv_sparse,
            {r('sqrt(252 * rv_sparse)')} AS rv_sparse_an FROM ({_ROLLED})""",
        *_RANKS,
    ),
)
def sparse_rv_rolling(spark, folder):
    return rv_ops.sparse_rv_rolling(_returns(spark, folder))


_PAIRS = rv_ops.ROLLING_GRID
_GRID = "\nUNION ALL ".join(
    f"""SELECT CAST({s} AS BIGINT) AS s, CAST({k} AS BIGINT) AS k, index_date, index_time, ret FROM rank{s}
        WHERE (rn - 1) % {k} = 0"""
    for s, k in _PAIRS
)


@query(
    "rolling_grid_s_k",
    statement(f"SELECT s, k, index_date, index_time, {r('ret')} AS ret FROM ({_GRID})", *_RANKS),
)
def rolling_grid_s_k(spark, folder):
    return rv_ops.rolling_returns(_returns(spark, folder))


@query(
    "rv_s_k",
    statement(
        f"""SELECT s, k, index_date, {r('sum(ret * ret)')} AS rv, {r('252 * sqrt(sum(ret * ret))')} AS rv_an
        FROM ({_GRID}) GROUP BY 1, 2, 3""",
        *_RANKS,
    ),
)
def rv_s_k(spark, folder):
    return rv_ops.rolling_rv(rv_ops.rolling_returns(_returns(spark, folder)))


_SUMS = "\nUNION ALL ".join(
    f"""SELECT CAST({s} AS BIGINT) AS s, index_date, CASE WHEN count(log_ret) OVER w = {s} THEN sum(log_ret) OVER w END AS ret
        FROM returns WINDOW w AS (PARTITION BY index_date ORDER BY index_time ROWS BETWEEN {s - 1} PRECEDING AND CURRENT ROW)"""
    for s in rv_ops.SPARSE_GRID
)


@query(
    "rv_of_sums",
    statement(
        f"""SELECT s, index_date, {r('sum(ret * ret)')} AS rv, {r('252 * sqrt(sum(ret * ret))')} AS rv_an
        FROM ({_SUMS}) WHERE ret IS NOT NULL GROUP BY 1, 2""",
        "returns",
    ),
)
def rv_of_sums(spark, folder):
    """Sums over 1 to 60 minutes in one plan."""
    return rv_ops.rv_of_sums(inputs.returns(spark, folder))


_WIDE = f"""SELECT rv.index_date, rv.rv, {', '.join(f's{s}.rv_sparse AS rv_s{s}' for s in _PERIODS)} FROM rv
    {' '.join(f'LEFT JOIN (SELECT * FROM ({_ROLLED}) WHERE s_grid = {s}) s{s} ON rv.index_date = s{s}.index_date'
              for s in _PERIODS)}"""
_WIDE_SQL = statement(
    f"SELECT index_date, {r('rv')} AS rv, {', '.join(f'{r(f'rv_s{s}')} AS rv_s{s}' for s in _PERIODS)} FROM ({_WIDE})",
    "rv",
    *_RANKS,
)


def _estimators(spark, folder, combine):
    series = _returns(spark, folder)
    return combine(rv_ops.realized_variance(series), rv_ops.sparse_rv_rolling(series))


@query("multiway_left_join", _WIDE_SQL)
def multiway_left_join(spark, folder):
    return _estimators(spark, folder, rv_ops.estimators_by_date)


@query("multiway_left_join_chain", _WIDE_SQL)
def multiway_left_join_chain(spark, folder):
    def chain(rv, sparse):
        return rv_ops.estimators_by_joins(rv, inputs.stage(sparse, "sparse"))

    return _estimators(spark, folder, chain)


@query(
    "signature_wide",
    statement(
        f"""SELECT unnest(['s1', 's5', 's10', 's15', 's30']) AS s, unnest([{r('avg(rv)')}, {r('avg(rv_s5)')},
            {r('avg(rv_s10)')}, {r('avg(rv_s15)')}, {r('avg(rv_s30)')}]) AS avg_rv_sparse,
            unnest([1, 5, 10, 15, 30]::BIGINT[]) AS minutes FROM ({_WIDE})""",
        "rv",
        *_RANKS,
    ),
)
def signature_wide(spark, folder):
    return rv_ops.signature_wide(_estimators(spark, folder, rv_ops.estimators_by_date))


# The same where overnight returns are 0, so that windows run from one date into the next.
_ZERO_RANKS = [f"zero_{name}" for name in _RANKS]


def _of_zero(sql: str) -> str:
    return sql.replace("FROM rank", "FROM zero_rank")


def _zero_returns(spark, folder):
    zeroed = log_returns(inputs.padded(spark, folder), overnight="zero")
    series = clip_returns(zeroed, inputs.THRESHOLD).select("index_date", "index_time", "log_ret")
    return inputs.stage(series, "zero-returns")


def _zero_estimators(spark, folder):
    series = _zero_returns(spark, folder)
    sparse = rv_ops.sparse_rv_rolling(series, across=True)
    return rv_ops.estimators_by_date(rv_ops.realized_variance(series), sparse)


@query(
    "rolling_grid_s_k_zero",
    statement(
        f"SELECT s, k, index_date, index_time, {r('ret')} AS ret FROM ({_of_zero(_GRID)})", *_ZERO_RANKS
    ),
)
def rolling_grid_s_k_zero(spark, folder):
    return rv_ops.rolling_returns(_zero_returns(spark, folder), across=True)


@query(
    "sparse_rv_rolling_zero",
    statement(
        f"""SELECT CAST(s_grid AS BIGINT) AS s_grid, index_date, {r('rv_sparse')} AS rv_sparse,
            {r('sqrt(252 * rv_sparse)')} AS rv_sparse_an FROM ({_of_zero(_ROLLED)})""",
        *_ZERO_RANKS,
    ),
)
def sparse_rv_rolling_zero(spark, folder):
    return rv_ops.sparse_rv_rolling(_zero_returns(spark, folder), across=True)


@query(
    "multiway_left_join_zero",
    statement(
        f"""SELECT index_date, {r('rv')} AS rv, {', '.join(f'{r(f'rv_s{s}')} AS rv_s{s}' for s in _PERIODS)}
        FROM ({_of_zero(_WIDE)})""",
        "rv",
        *_ZERO_RANKS,
    ),
)
def multiway_left_join_zero(spark, folder):
    return _zero_estimators(spark, folder)


@query(
    "signature_wide_zero",
    statement(
        f"""SELECT unnest(['s1', 's5', 's10', 's15', 's30']) AS s, unnest([{r('avg(rv)')}, {r('avg(rv_s5)')},
            {r('avg(rv_s10)')}, {r('avg(rv_s15)')}, {r('avg(rv_s30)')}]) AS avg_rv_sparse,
            unnest([1, 5, 10, 15, 30]::BIGINT[]) AS minutes FROM ({_of_zero(_WIDE)})""",
        "rv",
        *_ZERO_RANKS,
    ),
)
def signature_wide_zero(spark, folder):
    return rv_ops.signature_wide(_zero_estimators(spark, folder))


@query(
    "acf",
    statement(
        f"""SELECT CAST(b.t - a.t AS BIGINT) AS lag, {r('sum(a.x * b.x) / any_value(a.total)')} AS acf FROM d a
        JOIN d b ON b.t > a.t AND b.t - a.t <= 100 GROUP BY 1""".replace(
            "FROM d a",
            """FROM (SELECT *, sum(x * x) OVER () AS total FROM (SELECT row_number() OVER (ORDER BY date) AS t,
                turnover - avg(turnover) OVER () AS x FROM daily)) a""",
        ).replace(
            "JOIN d b",
            """JOIN (SELECT row_number() OVER (ORDER BY date) AS t,
                turnover - avg(turnover) OVER () AS x FROM daily) b""",
        ),
        "daily",
    ),
)
def acf(spark, folder):
    return rv_ops.acf(inputs.daily(spark, folder), "turnover", "date")


@query(
    "trend_smooth",
    statement(
        f"""SELECT date, {r('turnover')} AS turnover, {r('''avg(turnover) OVER (ORDER BY date
            ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING)''')} AS smooth FROM daily""",
        "daily",
    ),
)
def trend_smooth(spark, folder):
    series = inputs.daily(spark, folder).select("date", "turnover")
    return models.trend_smooth(series, "turnover", "date", 15)


@query(
    "local_trend",
    statement(
        f"""SELECT date, {r('turnover')} AS turnover, {r('(sxx * sy - sx * sxy) / (sw * sxx - sx * sx)')} AS trend FROM (
            SELECT date, any_value(turnover) AS turnover, sum(w) AS sw, sum(w * x) AS sx, sum(w * x * x) AS sxx,
                sum(w * y) AS sy, sum(w * x * y) AS sxy FROM (
                SELECT *, pow(1 - pow(abs(x) / max(abs(x)) OVER (PARTITION BY date), 3), 3) AS w FROM (
                    SELECT a.date, a.turnover, date_diff('day', a.date, b.date)::DOUBLE AS x, b.turnover AS y
                    FROM ranked a JOIN ranked b ON b.n BETWEEN a.n - 30 AND a.n + 30))
            GROUP BY date)""",
        "daily",
    ).replace("\nSELECT date,", ", ranked AS (SELECT *, row_number() OVER (ORDER BY date) AS n FROM daily)\nSELECT date,", 1),
)
def local_trend(spark, folder):
    """A line through the sixty nearest dates of each date."""
    series = inputs.daily(spark, folder).select("date", "turnover")
    return models.local_trend(series, "turnover", "date", 30)


def _ln_mean(frame, n):
    window = f"(ORDER BY date ROWS BETWEEN {frame})"
    return f"CASE WHEN count(turnover) OVER {window} = {n} THEN ln(avg(turnover) OVER {window}) END"


_HAR = f"""SELECT date, turnover, {_ln_mean('CURRENT ROW AND CURRENT ROW', 1)} AS ln_rv_d,
    {_ln_mean('4 PRECEDING AND CURRENT ROW', 5)} AS ln_rv_w,
    {_ln_mean('20 PRECEDING AND CURRENT ROW', 21)} AS ln_rv_m,
    {_ln_mean('1 FOLLOWING AND 21 FOLLOWING', 21)} AS ln_rv_next FROM daily"""


@query(
    "har_features",
    statement(
        f"""SELECT date, {', '.join(f'{r(c)} AS {c}' for c in
            ('turnover', 'ln_rv_d', 'ln_rv_w', 'ln_rv_m', 'ln_rv_next'))} FROM ({_HAR})""",
        "daily",
    ),
)
def har_features(spark, folder):
    return models.har_features(inputs.daily(spark, folder), "turnover", "date")


_HAR_FIT = f"""SELECT unnest(['(Intercept)', 'ln_rv_d', 'ln_rv_w', 'ln_rv_m']) AS term,
    unnest([{r('my - b1 * m1 - b2 * m2 - b3 * m3')}, {r('b1')}, {r('b2')}, {r('b3')}]) AS estimate FROM (
    SELECT *,
        (y1 * (c22 * c33 - c23 * c23) - c12 * (y2 * c33 - c23 * y3) + c13 * (y2 * c23 - c22 * y3)) / det AS b1,
        (c11 * (y2 * c33 - c23 * y3) - y1 * (c12 * c33 - c23 * c13) + c13 * (c12 * y3 - y2 * c13)) / det AS b2,
        (c11 * (c22 * y3 - y2 * c23) - c12 * (c12 * y3 - y2 * c13) + y1 * (c12 * c23 - c22 * c13)) / det AS b3
    FROM (SELECT *, c11 * (c22 * c33 - c23 * c23) - c12 * (c12 * c33 - c23 * c13)
            + c13 * (c12 * c23 - c22 * c13) AS det FROM (
        SELECT avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3,
            covar_pop(x1, x1) AS c11, covar_pop(x1, x2) AS c12, covar_pop(x1, x3) AS c13,
            covar_pop(x2, x2) AS c22, covar_pop(x2, x3) AS c23, covar_pop(x3, x3) AS c33,
            covar_pop(y, x1) AS y1, covar_pop(y, x2) AS y2, covar_pop(y, x3) AS y3
        FROM (SELECT ln_rv_d AS x1, ln_rv_w AS x2, ln_rv_m AS x3, ln_rv_next AS y FROM ({_HAR}))
        WHERE x1 IS NOT NULL AND x2 IS NOT NULL AND x3 IS NOT NULL AND y IS NOT NULL)))"""


@query("har_fit", statement(_HAR_FIT, "daily"))
def har_fit(spark, folder):
    return models.har_fit(models.har_features(inputs.daily(spark, folder), "turnover", "date"))


def _premium(spark, folder):
    rv = inputs.daily_rv(spark, folder).select("index_date", "rv")
    return models.variance_risk_premium(models.rv_iv_join(rv, inputs.implied_volatility(spark, folder)))


@query("rv_iv_join", statement(f"SELECT index_date, {r('rv')} AS rv, {r('iv')} AS iv FROM premium", "premium"))
def rv_iv_join(spark, folder):
    rv = inputs.daily_rv(spark, folder).select("index_date", "rv")
    return models.rv_iv_join(rv, inputs.implied_volatility(spark, folder))


@query(
    "vrp",
    statement(
        f"SELECT index_date, {', '.join(f'{r(c)} AS {c}' for c in ('rv', 'iv', 'iv_var', 'vrp'))} FROM premium",
        "premium",
    ),
)
def vrp(spark, folder):
    return _premium(spark, folder)


@query(
    "vrp_regression",
    statement(
        f"""SELECT {r('regr_intercept(ret_next, vrp)')} AS alpha, {r('regr_slope(ret_next, vrp)')} AS beta,
            {r('regr_r2(ret_next, vrp)')} AS r2, CAST(regr_count(ret_next, vrp) AS BIGINT) AS n
        FROM premium JOIN (
            SELECT index_date, {ln('lead(last_price) OVER (ORDER BY index_date)')} - {ln('last_price')} AS ret_next
            FROM padded WHERE index_time = 54000) USING (index_date)
        WHERE ret_next IS NOT NULL AND NOT isnan(ret_next)""",
        "premium",
        "padded",
    ),
)
def vrp_regression(spark, folder):
    prices = inputs.stage(inputs.padded(spark, folder), "padded")
    rv = rv_ops.realized_variance(clip_returns(log_returns(prices), inputs.THRESHOLD)).select("index_date", "rv")
    premium = models.variance_risk_premium(models.rv_iv_join(rv, inputs.implied_volatility(spark, folder)))
    closes = prices.groupBy("index_date").agg(F.max_by("last_price", "index_time").alias("close"))
    moves = models.next_day_return(closes, "close").select("index_date", "ret_next")
    return models.vrp_regression(premium.join(moves, "index_date"))


@query(
    "realized_moments",
    statement(
        f"""SELECT index_date, n, {r('rv')} AS rv, {r('sqrt(n) * cube / pow(rv, 1.5)')} AS rskew,
            {r('n * fourth / (rv * rv)')} AS rkurt FROM (
            SELECT index_date, count(log_ret) AS n, sum(log_ret * log_ret) AS rv,
                sum(log_ret * log_ret * log_ret) AS cube,
                sum(log_ret * log_ret * log_ret * log_ret) AS fourth
            FROM returns WHERE log_ret IS NOT NULL GROUP BY 1) WHERE rv > 0""",
        "returns",
    ),
)
def realized_moments(spark, folder):
    return models.realized_moments(inputs.returns(spark, folder))
