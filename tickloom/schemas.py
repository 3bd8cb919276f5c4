"""Fixed schemas, as DDL, of the tables that are read from files."""

from __future__ import annotations

# The 23 columns of a raw bar file, by position.
RAW_BARS = """
    ticker string, raw_date double, raw_time int, type string,
    open double, high double, low double, last double,
    volume bigint, average_price double, vwap double, no_trades bigint,
    correction_qualifiers string,
    open_bid double, high_bid double, low_bid double, close_bid double, no_bids bigint,
    open_ask double, high_ask double, low_ask double, close_ask double, no_ask bigint
    """
RAW_BAR_NAMES = tuple(field.split()[0] for field in RAW_BARS.split(","))

TICKS = """
    tidy_dttm timestamp_ntz, tidy_date date, tidy_time int,
    last_price double, volume bigint, no_trades bigint
    """

RETURNS = """
    index timestamp_ntz, index_date date, index_time int, last_price double, log_ret double,
    volume bigint, no_trades bigint, index_num bigint, diff bigint, year int, half int, quarter int,
    month int, month_label string, day int, hour int, minute int, wday int, wday_label string,
    qday int, yday int, date_change boolean
    """

# Names and missing-value spellings of the daily index file.
INDICES = ("date", "mexbol_ipc", "vimex", "ipc_vix")
NA_TOKENS = ("#NA", "#N/A N/A")

EVENTS = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
)
ORDERS = """
    o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,
    o_orderdate timestamp_ntz, o_orderpriority string
    """
LINEITEM = """
    l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,
    l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,
    l_shipdate timestamp_ntz
    """
