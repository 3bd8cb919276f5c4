"""SQL statements of the derived inputs, for the checks that run in another engine."""

from __future__ import annotations


def r(expression: str, digits: int = 6) -> str:
    """Rounded, with -0.0 turned into 0.0."""
    return f"(round({expression}, {digits}) + 0.0)"


def ln(x: str) -> str:
    return (
        f"(CASE WHEN {x} > 0 THEN ln({x}) WHEN {x} = 0 THEN CAST('-infinity' AS DOUBLE) "
        f"WHEN {x} < 0 THEN CAST('nan' AS DOUBLE) END)"
    )


def clip(x: str, threshold: float = 3.0) -> str:
    return f"(CASE WHEN {x} IS NULL OR isnan({x}) THEN NULL WHEN abs({x}) < {threshold} THEN {x} ELSE 0.0 END)"


MOMENT = "(CAST(index_date AS TIMESTAMP) + to_seconds(index_time))"
MINUTE_OF_DAY = "CAST(hour(ts) * 3600 + minute(ts) * 60 AS BIGINT)"
CENTS = "CAST(round(value * 100) AS BIGINT)"

# name -> (names it builds on, statement)
PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "tape": (
        (),
        f"""SELECT CAST(ts AS DATE) AS index_date, {MINUTE_OF_DAY} AS index_time,
            arg_max(value, row(ts, event_id)) AS last_price, count(*) AS no_trades,
            CAST(sum({CENTS}) AS BIGINT) AS q
        FROM events GROUP BY 1, 2""",
    ),
    "session_tape": (("tape",), "SELECT * FROM tape WHERE index_time BETWEEN 30600 AND 54000"),
    "grid": (
        ("tape",),
        """SELECT index_date, CAST(m.t AS BIGINT) AS index_time
        FROM (SELECT DISTINCT index_date FROM tape), range(30600, 54001, 60) AS m(t)""",
    ),
    "joined": (
        ("grid", "tape"),
        """SELECT index_date, index_time, last_price, no_trades
        FROM grid LEFT JOIN tape USING (index_date, index_time)""",
    ),
    "padded": (
        ("joined",),
        """SELECT index_date, index_time, no_trades, coalesce(
            last_value(last_price IGNORE NULLS) OVER (ORDER BY index_date, index_time
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
            first_value(last_price IGNORE NULLS) OVER (ORDER BY index_date, index_time
                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS last_price
        FROM joined""",
    ),
    "moves": (
        ("padded",),
        f"""SELECT *, {ln("last_price")} - lag({ln("last_price")}) OVER w AS raw_ret,
            index_date <> lag(index_date) OVER w AS date_change
        FROM padded WINDOW w AS (ORDER BY index_date, index_time)""",
    ),
    "returns": (
        ("moves",),
        f"""SELECT * EXCLUDE (raw_ret), {clip("CASE WHEN NOT date_change THEN raw_ret END")} AS log_ret
        FROM moves""",
    ),
    "rv": (
        ("returns",),
        """SELECT index_date, sum(log_ret * log_ret) AS rv FROM returns
        WHERE log_ret IS NOT NULL GROUP BY 1 HAVING sum(log_ret * log_ret) <> 0""",
    ),
    "voltape": (
        ("session_tape",),
        """SELECT index_date, index_time, no_trades,
            CAST(sum(q) OVER (PARTITION BY index_date ORDER BY index_time
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) % 200000 AS BIGINT) AS volume,
            CAST(index_date <> lag(index_date) OVER (ORDER BY index_date, index_time) AS BIGINT) AS day_change
        FROM session_tape""",
    ),
    "clean": (
        ("voltape",),
        """SELECT * FROM (SELECT *, CASE WHEN day_change = 1 THEN volume WHEN day_change = 0
            THEN volume - lag(volume) OVER (ORDER BY index_date, index_time) END AS new_volume FROM voltape)
        WHERE new_volume > 0""",
    ),
    "daily": (
        (),
        """SELECT date, n_orders, turnover_cents, largest_cents, turnover_cents / 1e6 AS turnover FROM (
            SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n_orders,
                CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS turnover_cents,
                max(CAST(round(o_totalprice * 100) AS BIGINT)) AS largest_cents
            FROM orders GROUP BY 1)""",
    ),
    "iv": (
        (),
        """SELECT CAST(ts AS DATE) AS index_date, stddev_samp(value) AS iv
        FROM events GROUP BY 1""",
    ),
    "premium": (
        ("rv", "iv"),
        """SELECT index_date, rv, iv, iv * iv / (100.0 * 100.0 * 252) AS iv_var,
            iv * iv / (100.0 * 100.0 * 252) - rv AS vrp FROM rv JOIN iv USING (index_date)""",
    ),
    "sampled": (
        ("moves",),
        """SELECT s.s AS s_grid, index_date, index_time, last_price
        FROM moves, range(1, 61) AS s(s)
        WHERE (index_time // 60) % 60 % s.s = 0 AND (date_change IS NULL OR NOT date_change)""",
    ),
    "sparse": (
        ("sampled",),
        f"""SELECT s_grid, index_date, sum(ret * ret) AS rv_sparse FROM (
            SELECT s_grid, index_date, {ln("last_price")} - lag({ln("last_price")})
                OVER (PARTITION BY s_grid ORDER BY index_date, index_time) AS ret FROM sampled)
        WHERE ret IS NOT NULL AND NOT isnan(ret) GROUP BY 1, 2""",
    ),
}

# Returns with 0 instead of NULL where the date changes.
PARTS["zero_returns"] = (
    ("moves",),
    f"""SELECT index_date, index_time, {clip("CASE WHEN NOT date_change THEN raw_ret ELSE 0.0 END")} AS log_ret
    FROM moves""",
)

# Rolling sums of log_ret over the whole series: NULL unless all rows are known.
for _s in (3, 5, 10, 15, 30):
    for _prefix in ("", "zero_"):
        PARTS[f"{_prefix}roll{_s}"] = (
            (f"{_prefix}returns",),
            f"""SELECT index_date, index_time, CASE WHEN count(log_ret) OVER w = {_s}
                THEN sum(log_ret) OVER w END AS ret FROM {_prefix}returns
            WINDOW w AS (ORDER BY index_date, index_time ROWS BETWEEN {_s - 1} PRECEDING AND CURRENT ROW)""",
        )
        PARTS[f"{_prefix}rank{_s}"] = (
            (f"{_prefix}roll{_s}",),
            f"""SELECT *, row_number() OVER (ORDER BY index_date, index_time) AS rn
            FROM {_prefix}roll{_s} WHERE ret IS NOT NULL""",
        )


def statement(body: str, *names: str) -> str:
    """``body`` behind the WITH list that defines ``names`` and what they build on."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name not in ordered:
            for needed in PARTS[name][0]:
                visit(needed)
            ordered.append(name)

    for name in names:
        visit(name)
    if not ordered:
        return body
    listed = ",\n".join(f"{name} AS ({PARTS[name][1]})" for name in ordered)
    return f"WITH {listed}\n{body}"
