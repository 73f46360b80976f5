"""SQL counterparts of the registered queries, written for another engine.

Each statement is independent of the Spark code: it derives the same tables from the test data with
plain SQL and brute-force joins.
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}

# ---- shared table expressions ---------------------------------------------------------------


def _bars(name: str, key: str, join: bool) -> str:
    source = "lineitem JOIN part ON l_partkey = p_partkey" if join else "lineitem"
    return f"""{name} AS (
  SELECT CAST({key} AS VARCHAR) AS ticker, CAST(l_shipdate AS DATE) AS date,
    arg_min(l_extendedprice, ROW(l_orderkey, l_linenumber, l_extendedprice)) AS open,
    max(l_extendedprice) AS high, min(l_extendedprice) AS low,
    arg_max(l_extendedprice, ROW(l_orderkey, l_linenumber, l_extendedprice)) AS close,
    arg_max(l_extendedprice, ROW(l_orderkey, l_linenumber, l_extendedprice)) AS adj_close,
    sum(l_quantity) AS volume
  FROM {source} GROUP BY 1, 2)"""


LAST = "last_day AS (SELECT max(CAST(l_shipdate AS DATE)) AS d FROM lineitem)"
BARS = _bars("bars", "p_brand", True)
SBARS = _bars("sbars", "l_suppkey", False)
EBARS = _bars("ebars0", "p_type", True) + """,
ebars AS (SELECT ticker AS ticker_etf, date, close, adj_close, CAST(volume AS BIGINT) AS volume
  FROM ebars0)"""
INDEX = """idx AS (SELECT o_orderstatus AS index_ticker, CAST(o_orderdate AS DATE) AS date,
    max(o_totalprice) AS close, max(o_totalprice) AS adj_close,
    CASE o_orderstatus WHEN 'F' THEN 'US' WHEN 'O' THEN 'EU' ELSE 'KR' END AS zone
  FROM orders GROUP BY 1, 2)"""
PRIORITY = """CASE o_orderpriority WHEN '1-URGENT' THEN 'USD' WHEN '2-HIGH' THEN 'CHF'
    WHEN '3-MEDIUM' THEN 'SEK' WHEN '4-NOT SPECIFIED' THEN 'KRW' WHEN '5-LOW' THEN 'GBP' END"""
FX = f"""fx AS (SELECT {PRIORITY} AS currency, CAST(o_orderdate AS DATE) AS date,
    max(o_totalprice) AS rate FROM orders GROUP BY 1, 2)"""
INSTR = """instr AS (
  SELECT ticker, 'Maker ' || n AS name, r_name AS sector, 'Goods' AS industry, n_name AS country,
    list_extract(['EUR', 'USD', 'CHF', 'SEK'], n % 4 + 1) AS currency, n * 1000.0 AS market_cap,
    CASE WHEN n % 7 <> 0 THEN n + 0.5 END AS pe_ratio, n,
    CASE WHEN n % 2 = 1 THEN 'US' ELSE 'EU' END AS z1, CASE WHEN n % 2 = 1 THEN 'EU' ELSE 'US' END AS z2
  FROM (SELECT DISTINCT p_brand AS ticker, CAST(substr(p_brand, 7) AS INTEGER) AS n FROM part) b
  LEFT JOIN region ON r_regionkey = n % 5 LEFT JOIN nation ON n_nationkey = n % 25)"""
ETF = """etf AS (
  SELECT ticker_etf, 'Fund ' || ticker_etf AS name, r_name AS sector,
    CASE WHEN ascii(ticker_etf) % 2 = 1 THEN 'US' ELSE 'EU' END AS zone,
    CASE WHEN ascii(ticker_etf) % 2 = 1 THEN 'F' ELSE 'O' END AS index_ticker
  FROM (SELECT DISTINCT p_type AS ticker_etf FROM part) t
  JOIN region ON r_regionkey = length(ticker_etf) % 5)"""


def _strength(name: str, source: str) -> str:
    return f"""{name}0 AS (
  SELECT b.*, i.adj_close AS index_price, e.index_ticker,
    row_number() OVER (PARTITION BY b.ticker_etf ORDER BY b.date) AS rn,
    first_value(b.adj_close) OVER (PARTITION BY b.ticker_etf ORDER BY b.date) AS e0,
    first_value(i.adj_close) OVER (PARTITION BY b.ticker_etf ORDER BY b.date) AS i0
  FROM {source} b JOIN etf e ON e.ticker_etf = b.ticker_etf
  JOIN idx i ON i.index_ticker = e.index_ticker AND i.date = b.date WHERE b.adj_close > 0),
{name}1 AS (SELECT *, (adj_close / e0) / (index_price / i0) AS ratio FROM {name}0),
{name}2 AS (SELECT *, avg(ratio) OVER (PARTITION BY ticker_etf ORDER BY date
    ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS ma FROM {name}1),
{name} AS (SELECT ticker_etf, date, close, adj_close, volume, index_price, index_ticker, ratio,
    ratio / ma AS ratio_vs_ma50, ratio / ma > 1.0 AS in_force FROM {name}2 WHERE rn >= 50)"""


STRENGTH = ",\n".join([EBARS, INDEX, ETF, _strength("strength", "ebars")])
FORCE = STRENGTH + """,
force AS (SELECT e.sector, e.zone, s.date, arg_min(s.in_force, s.ticker_etf) AS in_force
  FROM strength s JOIN etf e ON e.ticker_etf = s.ticker_etf GROUP BY 1, 2, 3)"""
MACRO = """macro AS (
  SELECT zone, index_ticker, date, price, sma_200, coalesce(price > sma_200, FALSE) AS bull FROM (
    SELECT zone, index_ticker, date, adj_close AS price, CASE WHEN row_number() OVER (
        PARTITION BY zone ORDER BY date) >= 200 THEN avg(adj_close) OVER (PARTITION BY zone
        ORDER BY date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) END AS sma_200 FROM idx))"""


def _indicators(name: str, source: str, min_history: int = 260) -> str:
    """Ranking indicators."""
    w = "PARTITION BY ticker ORDER BY date"
    return f"""{name}0 AS (
  SELECT ticker, date, adj_close AS price, coalesce(volume, 0) AS vol, high, low,
    row_number() OVER ({w}) AS rn, lag(adj_close) OVER ({w}) AS pc,
    lag(adj_close, 252) OVER ({w}) AS p252, ln(adj_close) AS lp
  FROM (SELECT *, count(*) OVER (PARTITION BY ticker) AS cnt FROM {source} WHERE adj_close > 0)
  WHERE cnt >= {min_history}),
{name}1 AS (SELECT *, CASE WHEN price > pc THEN vol WHEN price < pc THEN -vol ELSE 0 END AS sv,
    greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM {name}0),
{name}2 AS (SELECT *,
    CASE WHEN rn >= 200 THEN avg(price) OVER ({w} ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) END AS sma_200,
    CASE WHEN rn >= 150 THEN avg(price) OVER ({w} ROWS BETWEEN 149 PRECEDING AND CURRENT ROW) END AS sma_150,
    CASE WHEN rn > 252 THEN regr_r2(lp, rn) OVER ({w} ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING) END AS fit,
    avg(vol) OVER ({w} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS va,
    sum(sv) OVER ({w} ROWS UNBOUNDED PRECEDING) AS obv,
    avg(tr) OVER ({w} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS atr_14 FROM {name}1),
{name} AS (SELECT ticker, date, rn - 1 AS seq, price, sma_200, sma_150,
    (price - p252) / p252 * fit AS mom_r2, vol / (va + 1e-9) AS rvol,
    obv - lag(obv, 10) OVER ({w}) AS obv_slope, atr_14,
    lead(date) OVER ({w}) AS next_date FROM {name}2)"""


IND = BARS + ",\n" + _indicators("ind", "bars")
MONDAYS = "mondays AS (SELECT DISTINCT date AS calc_date FROM ind WHERE dayofweek(date) = 1)"


def _eligible(name: str, sma: str, min_mom: float, dates: str | None) -> str:
    if dates is None:
        source, day = "ind i", "i.date"
    else:
        source = f"""ind i JOIN {dates} m ON m.calc_date >= i.date
    AND m.calc_date <= i.date + 5 AND (i.next_date IS NULL OR m.calc_date < i.next_date)"""
        day = "m.calc_date"
    return f"""{name} AS (SELECT {day} AS calc_date, i.ticker, i.date AS row_date, i.seq, i.price,
    {sma} AS sma_value, i.mom_r2, coalesce(i.rvol, 0) AS rvol, coalesce(i.obv_slope, 0) AS obv_slope,
    coalesce(i.atr_14, 0) AS atr_14 FROM {source} WHERE i.price > {sma} AND i.mom_r2 > {min_mom})"""


def _ranked(name: str, source: str, extra: str = "") -> str:
    def norm(c: str) -> str:
        p = "OVER (PARTITION BY calc_date)"
        return f"""CASE WHEN max({c}) {p} - min({c}) {p} > 0
      THEN ({c} - min({c}) {p}) / (max({c}) {p} - min({c}) {p}) ELSE 0.5 END"""
    return f"""{name}0 AS (SELECT *, 0.5 * ({norm('mom_r2')}) + 0.25 * ({norm('rvol')})
    + 0.25 * ({norm('obv_slope')}) AS score FROM {source}),
{name} AS (SELECT *, row_number() OVER (PARTITION BY calc_date ORDER BY score DESC, ticker) AS rank{extra}
  FROM {name}0)"""


def _sector_ok(name: str, source: str, on: str) -> str:
    """Sector state through the two zones of an instrument."""
    return f"""{name} AS (
  SELECT c.*, i.sector, i.z1, i.z2, coalesce(f1.in_force, f2.in_force, TRUE) AS sector_ok
  FROM {source} c LEFT JOIN instr i ON i.ticker = c.ticker
  ASOF LEFT JOIN (SELECT * FROM force) f1 ON f1.sector = i.sector AND f1.zone = i.z1 AND f1.date <= c.{on}
  ASOF LEFT JOIN (SELECT * FROM force) f2 ON f2.sector = i.sector AND f2.zone = i.z2 AND f2.date <= c.{on})"""


def g(expr: str, digits: int = 6, name: str | None = None) -> str:
    """Same grid as the queries use."""
    return f"floor(({expr}) * 1e{digits} + 0.37) / 1e{digits} AS {name or expr}"


def day(expr: str, name: str | None = None) -> str:
    return f"CAST({expr} AS VARCHAR) AS {name or expr}"


def oracle(name: str, ctes: list[str], select: str) -> None:
    ORACLES[name] = "WITH " + ",\n".join(ctes) + "\n" + select if ctes else select


# ---- sources --------------------------------------------------------------------------------

oracle("landed_bars", [BARS], f"""SELECT ticker, {day('date')}, open, high, low, close, close AS adj_close,
  volume FROM bars WHERE CAST(volume AS BIGINT) % 7 <> 0""")
oracle("landed_index", [INDEX], f"""SELECT index_ticker, {day('date')}, close,
  CASE WHEN day(date) % 3 <> 0 THEN close + 1 ELSE close END AS adj_close FROM idx""")
oracle("landed_etf", [EBARS], f"""SELECT ticker_etf, {day('date')}, close, close AS adj_close, volume FROM ebars
  WHERE day(date) % 5 <> 0 AND day(date) % 7 <> 0""")
oracle("landed_fx", [FX], f"""SELECT currency, {day('date')}, rate AS rate_per_eur FROM fx
  WHERE day(date) % 4 <> 0 AND day(date) % 9 <> 0""")
oracle("landed_instruments", [INSTR], """SELECT ticker, name, CASE WHEN n % 3 <> 0 THEN
    upper(substr(sector, 1, 1)) || CASE WHEN sector LIKE '% %' THEN lower(split_part(substr(sector, 2), ' ', 1))
      || ' ' || upper(substr(split_part(sector, ' ', 2), 1, 1)) || lower(substr(split_part(sector, ' ', 2), 2))
      ELSE lower(substr(sector, 2)) END END AS sector,
  industry, country, currency, market_cap, pe_ratio, '2001-01-01' AS updated FROM instr""")
oracle("universe", [SBARS, INSTR], "SELECT ticker FROM instr UNION SELECT ticker FROM sbars")
oracle("fx_universe", [INSTR], "SELECT DISTINCT currency FROM instr WHERE currency <> 'EUR'")
oracle("tickers_with_history", [SBARS], """SELECT ticker, count(*) AS n_bars FROM sbars WHERE adj_close > 0
  GROUP BY 1 HAVING count(*) >= 500""")
oracle("valid_history_bars", [SBARS], f"""SELECT ticker, {day('date')}, adj_close FROM (
  SELECT *, count(*) OVER (PARTITION BY ticker) AS n FROM sbars WHERE CAST(volume AS BIGINT) % 5 <> 0
    AND CAST(volume AS BIGINT) % 7 <> 0 AND CAST(volume AS BIGINT) % 11 <> 0) WHERE n >= 320""")
oracle("landed_files", [BARS], f"SELECT ticker, {day('date')}, open, high, low, close, close AS adj_close, volume FROM bars")
oracle("incremental_slice", [BARS, LAST], f"""SELECT ticker, {day('date')}, close FROM bars, last_day
  WHERE date >= d - 220""")

# ---- sinks ----------------------------------------------------------------------------------

MERGED = """cuts AS (SELECT CAST(date_trunc('month', d) - INTERVAL 2 MONTH AS DATE) AS cut,
    CAST(date_trunc('month', d) - INTERVAL 3 MONTH AS DATE) AS start, d FROM last_day),
merged AS (SELECT ticker, date, open, high, low,
    close + CASE WHEN date >= start AND date < cut THEN 1.0 ELSE 0.0 END AS close,
    adj_close + CASE WHEN date >= start AND date < cut THEN 1.0 ELSE 0.0 END AS adj_close, volume
  FROM bars, cuts)"""
for _name in ("upsert_bars", "stream_upsert"):
    oracle(_name, [BARS, LAST, MERGED], f"SELECT ticker, {day('date')}, close, volume FROM merged")
oracle("upsert_policy", [INSTR], """SELECT ticker, name, sector, industry, country,
    coalesce(CASE WHEN n % 3 <> 0 THEN currency END, CASE WHEN n % 2 = 0 THEN 'GBP' END) AS currency,
    market_cap + CASE WHEN n % 2 = 0 THEN 5 ELSE 0 END AS market_cap,
    pe_ratio + CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END AS pe_ratio,
    CASE WHEN n % 2 = 0 THEN '2001-01-01' END AS updated FROM instr
  UNION ALL SELECT 'New' || ticker, name, sector, industry, country, 'JPY', market_cap, pe_ratio, '2001-01-01'
  FROM instr""")
oracle("update_from", [BARS], f"""SELECT ticker, {day('date')}, CASE WHEN day(date) % 2 <> 0 THEN open END AS open,
  close, volume * CASE WHEN day(date) % 2 = 0 THEN 2 ELSE 1 END AS volume FROM bars""")
oracle("insert_absent", [ETF], """SELECT ticker_etf, name, sector, zone, index_ticker, TRUE AS active FROM etf
  UNION ALL SELECT 'N' || ticker_etf, 'new', sector, zone, index_ticker, TRUE FROM etf""")
oracle("replace_day", [BARS, LAST], f"""SELECT {day('date', 'calc_date')}, ticker, close, rank FROM (
    SELECT date, ticker, close, row_number() OVER (PARTITION BY date ORDER BY close DESC, ticker) AS rank
    FROM bars WHERE date IN (SELECT max(date) FROM bars GROUP BY date_trunc('month', date))), last_day
  WHERE rank <= CASE WHEN year(date) = year(d) THEN 2 ELSE 5 END""")

SHIFTED = """ev AS (SELECT event_id, ts - INTERVAL 9000 DAY AS happened, user_id, event_type, value,
    'Brand#' || (user_id % 25 + 1) AS ticker FROM events)"""
OPINIONS = SHIFTED + """,
op0 AS (SELECT CAST(date_trunc('week', happened) AS DATE) AS week, ticker,
    CASE WHEN event_type IN ('click', 'error', 'purchase') THEN 'ranking' ELSE 'position' END AS type,
    event_id, happened, event_type FROM ev),
op AS (SELECT week, ticker, type, CASE WHEN event_id % 5 <> 0 THEN event_id % 20 + 1 END AS rank,
    CASE event_type WHEN 'click' THEN 'FORT' WHEN 'error' THEN 'MODÉRÉ' WHEN 'purchase' THEN 'FAIBLE'
      WHEN 'signup' THEN 'GARDER' ELSE 'VENDRE' END AS conviction,
    CASE WHEN type = 'position' THEN 'position_auto' ELSE 'cron' END AS source, happened AS generated_at,
    coalesce(CASE WHEN event_id % 7 <> 0 THEN 'v' || (event_id % 3) END, '—') AS prompt_version,
    'm' || (event_id % 2) AS model
  FROM op0 QUALIFY row_number() OVER (PARTITION BY week, ticker, type ORDER BY event_id DESC) = 1)"""
oracle("upsert_opinions", [OPINIONS], f"""SELECT {day('week')}, ticker, type, rank,
  CASE WHEN hit THEN 'FORT' ELSE conviction END AS conviction, CASE WHEN hit THEN 'ab' || ticker END AS text,
  CASE WHEN hit THEN '2002-01-01 00:00:00' ELSE strftime(generated_at, '%Y-%m-%d %H:%M:%S') END AS generated_at
  FROM (SELECT *, type = 'ranking' AND coalesce(rank % 2 = 0, FALSE) AS hit FROM op)""")
oracle("backfill_type", [OPINIONS], f"""SELECT {day('week')}, ticker, type AS was,
  coalesce(CASE WHEN rank % 3 = 0 THEN type END, CASE WHEN CASE WHEN rank % 4 <> 0 THEN source END
    LIKE 'position_%' THEN 'position' ELSE 'ranking' END) AS type, rank FROM op""")
oracle("fill_high_low", [BARS], f"""SELECT ticker, {day('date')},
  CASE WHEN day(date) % 2 = 0 OR day(date) % 3 <> 0 THEN open END AS open,
  CASE WHEN day(date) % 2 = 0 OR day(date) % 3 <> 0 THEN high END AS high,
  CASE WHEN day(date) % 2 = 0 OR day(date) % 3 <> 0 THEN low END AS low, close FROM bars""")


def _analysis(name: str, source: str) -> str:
    w = "PARTITION BY ticker ORDER BY date"
    return f"""{name}0 AS (SELECT *, row_number() OVER ({w}) AS rn, count(*) OVER (PARTITION BY ticker) AS cnt,
    adj_close - lag(adj_close) OVER ({w}) AS dl, lag(adj_close) OVER ({w}) AS pc FROM {source}),
{name}1 AS (SELECT *, CASE WHEN dl > 0 THEN dl ELSE 0 END AS gain, CASE WHEN dl < 0 THEN -dl ELSE 0 END AS loss,
    greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM {name}0),
{name}2 AS (SELECT *,
    CASE WHEN rn >= 14 THEN 100 - 100 / (1 + avg(gain) OVER ({w} ROWS 13 PRECEDING)
      / (avg(loss) OVER ({w} ROWS 13 PRECEDING) + 1e-9)) END AS rsi,
    avg(adj_close) OVER ({w} ROWS 199 PRECEDING) AS s200, avg(adj_close) OVER ({w} ROWS 49 PRECEDING) AS s50,
    CASE WHEN rn >= 20 THEN avg(adj_close) OVER ({w} ROWS 19 PRECEDING) END AS s20,
    CASE WHEN rn >= 20 THEN stddev_samp(adj_close) OVER ({w} ROWS 19 PRECEDING) END AS sd20,
    CASE WHEN rn >= 20 THEN avg(volume) OVER ({w} ROWS 19 PRECEDING) END AS va,
    avg(tr) OVER ({w} ROWS 13 PRECEDING) AS atr FROM {name}1),
{name} AS (SELECT ticker, date, adj_close, rsi AS rsi_14, s200 AS sma_200, s50 AS sma_50,
    s20 - 2 * sd20 AS bb_lower, (adj_close - (s20 - 2 * sd20)) / nullif(4 * sd20, 0) AS bb_position,
    va AS vol_avg_20, rsi - lag(rsi, 3) OVER ({w}) AS rsi_slope, volume / (va + 1e-9) AS vol_ratio,
    (adj_close - s200) / (s200 + 1e-9) AS dist_sma200, atr AS atr_14,
    CASE WHEN adj_close > s50 * 1.02 THEN 'BULL' WHEN adj_close < s50 * 0.98 THEN 'BEAR' ELSE 'NEUTRE' END AS regime,
    cnt FROM {name}2)"""


_WIDE = {"sma_200": 4, "sma_50": 4, "bb_lower": 2, "vol_avg_20": 4, "atr_14": 3}
_ANALYSIS = ["rsi_14", "sma_200", "sma_50", "bb_lower", "bb_position", "vol_avg_20", "rsi_slope", "vol_ratio",
             "dist_sma200", "atr_14"]
ANALYSIS_OUT = f"SELECT a.ticker, {day('date')}, " + ", ".join(
    "CASE WHEN cnt >= 50 THEN " + g(c, _WIDE.get(c, 6)).replace(" AS ", " END AS ") for c in _ANALYSIS) + \
    ", CASE WHEN cnt >= 50 THEN regime END AS regime, sector, pe_ratio FROM a LEFT JOIN instr i ON i.ticker = a.ticker"
oracle("analysis_indicators", [BARS, INSTR, _analysis("a", "bars")], ANALYSIS_OUT)
SLICE = "slice AS (SELECT bars.* FROM bars, last_day WHERE date >= d - 220)"
oracle("analysis_incremental", [BARS, INSTR, LAST, SLICE, _analysis("a", "slice")],
       ANALYSIS_OUT + ", last_day WHERE date >= d - 5")
_NIGHT = {"rsi_14": 6, "sma_200": 4, "vol_ratio": 6, "atr_14": 3}
oracle("nightly_analysis", [BARS, LAST, SLICE, _analysis("a", "bars"), _analysis("b", "slice"),
                            """night AS (SELECT a.ticker, a.date, """ + ", ".join(
    f"CASE WHEN a.date >= d - 5 THEN CASE WHEN b.cnt >= 50 THEN b.{c} END WHEN a.date <= d - 40 AND a.cnt >= 50 THEN a.{c} END AS {c}"
    for c in [*_NIGHT, "regime"]) + """ FROM a LEFT JOIN b ON b.ticker = a.ticker AND b.date = a.date, last_day)"""],
       f"SELECT ticker, {day('date')}, " + ", ".join(g(c, n) for c, n in _NIGHT.items()) + ", regime FROM night")
oracle("stream_tail", [BARS, LAST, MERGED, _analysis("a", "merged")],
       f"""SELECT ticker, {day('date')}, {g('rsi_14')}, {g('sma_200', 4)}, {g('atr_14', 4)}, regime
  FROM a""")

# ---- filters and lookups --------------------------------------------------------------------

POSITIONS = """positions AS (
  SELECT o_orderkey AS id, 'Brand#' || (o_custkey % 25 + 1) AS ticker, CAST(o_orderdate AS DATE) AS buy_date,
    CAST(o_totalprice AS DECIMAL(18, 4)) AS buy_price, CAST(o_orderkey % 9 + 1 AS DECIMAL(18, 4)) AS quantity,
    CASE WHEN o_orderstatus = 'F' THEN 'FERMÉ' ELSE 'OUVERT' END AS status,
    CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + CAST(o_custkey % 60 AS INTEGER) END AS sell_date,
    CASE WHEN o_orderstatus = 'F' THEN CAST(CAST(o_totalprice AS DECIMAL(12, 2)) + (o_orderkey % 2001 - 1000)
      AS DECIMAL(18, 4)) END AS sell_price,
    CASE WHEN o_orderstatus = 'F' THEN list_extract(['TRAILING_STOP', 'TREND_BROKEN', 'MOMENTUM_LOST', 'SECTOR_WEAK',
      'MACRO_BEARISH', 'MANUEL'], o_orderkey % 6 + 1) END AS sell_reason,
    c_nationkey AS portfolio_id,
    list_extract(['EUR', 'USD', 'CHF', 'SEK'], (o_custkey % 25 + 1) % 4 + 1) AS quote_currency,
    CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_totalprice AS DECIMAL(18, 4)) END AS invested_eur
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
amounts AS (SELECT *, round(quantity * buy_price, 2) AS invested, round((sell_price - buy_price) * quantity, 2) AS result,
    round(CAST(100 * (sell_price - buy_price) AS DOUBLE) / nullif(CAST(buy_price AS DOUBLE), 0), 2) AS result_pct
  FROM positions)"""
oracle("instrument_search", [INSTR], """SELECT ticker, name, sector FROM instr
  WHERE contains(upper(ticker), 'R 1') OR contains(upper(name), 'R 1')""")
oracle("instrument_search_indexed", [INSTR], """SELECT ticker, name, sector FROM instr
  WHERE contains(upper(ticker), 'R 1') OR contains(upper(name), 'R 1') UNION ALL SELECT ticker, name, sector FROM instr WHERE contains(upper(ticker), 'BRAND#23')""")
for _name, _where in (("positions_list_all", "TRUE"), ("positions_list_open", "status = 'OUVERT'"),
                      ("positions_of_portfolio", "status = 'FERMÉ' AND portfolio_id = 7")):
    oracle(_name, [POSITIONS], f"""SELECT id, ticker, portfolio_id, {day('buy_date')}, {day('sell_date')}, CAST(invested AS DOUBLE) AS invested,
  CAST(result AS DOUBLE) AS result, result_pct, status FROM amounts WHERE {_where}""")
oracle("positions_list", [POSITIONS], f"""SELECT id, ticker, {day('buy_date')}, {day('sell_date')},
  CAST(invested AS DOUBLE) AS invested, CAST(result AS DOUBLE) AS result, result_pct, sell_reason
  FROM amounts WHERE status = 'FERMÉ'""")
oracle("position_counts", [POSITIONS], """SELECT count(*) AS n_positions, count(*) FILTER (status = 'OUVERT') AS n_open,
  count(*) FILTER (status = 'FERMÉ') AS n_closed FROM positions""")
oracle("opinions_all", [OPINIONS], f"SELECT {day('week')}, ticker, type, rank, conviction FROM op")
oracle("opinions_latest_week", [OPINIONS], f"""SELECT {day('week')}, ticker, type, rank, conviction FROM op
  WHERE type = 'ranking' AND week = (SELECT max(week) FROM op)""")
oracle("opinion_of_ticker", [OPINIONS], f"""SELECT {day('week')}, upper(ticker) AS ticker, type, conviction FROM op
  WHERE ticker = 'Brand#7' ORDER BY op.week DESC, generated_at DESC LIMIT 1""")
WEEKS = """wk AS (SELECT week, percent_rank() OVER (ORDER BY week) AS p FROM (SELECT DISTINCT week FROM op)),
chosen AS (SELECT min(week) AS week FROM wk WHERE p >= 0.5)"""
oracle("opinions_of_week", [OPINIONS, WEEKS], f"SELECT {day('week')}, ticker, type, rank, conviction FROM op JOIN chosen USING (week)")
oracle("opinions_of_week_ticker", [OPINIONS, WEEKS], f"""SELECT {day('week')}, upper(ticker) AS ticker, type, rank, conviction
  FROM op JOIN chosen USING (week) WHERE ticker = 'Brand#7'""")
RECENT = """recent AS (SELECT * FROM op WHERE type = 'ranking' AND CAST(generated_at AS DATE) >=
    (SELECT max(CAST(generated_at AS DATE)) FROM op) - 7
  QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY week DESC, generated_at DESC) = 1)"""
oracle("opinion_latest7d", [OPINIONS, RECENT], f"SELECT {day('week')}, ticker, conviction, rank FROM recent")
oracle("conviction_counts", [OPINIONS, RECENT], "SELECT conviction, count(*) AS n FROM recent GROUP BY 1")
oracle("instrument_zones", [], """SELECT ticker,
    CASE WHEN ticker LIKE '%.KS' OR ticker LIKE '%.KQ' THEN 'KR' WHEN ticker NOT LIKE '%.%' THEN 'US,EU'
      WHEN country <> 'Canada' THEN 'EU,US' ELSE 'US,EU' END AS zones,
    CASE WHEN ticker LIKE '%.KS' OR ticker LIKE '%.KQ' THEN 'KR' WHEN ticker NOT LIKE '%.%' THEN 'US'
      WHEN country <> 'Canada' THEN 'EU' ELSE 'US' END AS zone,
    CASE WHEN country <> 'Canada' THEN 'EU,US' ELSE 'US,EU' END AS zones_by_country,
    CASE WHEN p_size % 5 = 0 THEN 'USD' WHEN ticker LIKE '%.KS' OR ticker LIKE '%.KQ' THEN 'KRW'
      WHEN ticker LIKE '%.ST' THEN 'SEK' WHEN ticker LIKE '%.%' THEN 'EUR' ELSE 'USD' END AS quote
  FROM (SELECT 'P' || p_partkey || list_extract(['', '.KS', '.KQ', '.DE', '.ST', '.TO'], p_partkey % 6 + 1) AS ticker,
    list_extract(['Ireland', 'Belgium', 'France', 'Canada'], p_partkey % 4 + 1) AS country, p_size FROM part)""")
oracle("strength_valid", [STRENGTH], f"""SELECT ticker_etf, {day('date')}, adj_close, in_force FROM strength
  WHERE day(date) % 6 <> 0 AND day(date) % 8 <> 0""")
EVENTS = f"""pe AS (
  SELECT o_orderkey AS event_id, o_orderdate + to_seconds(o_orderkey % 86400) AS event_time,
    list_extract(['open', 'edit', 'close'], o_orderkey % 3 + 1) AS kind,
    CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey // 6 END AS position_id,
    CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 11 = 0 THEN 'BAD TICKER'
      WHEN o_orderkey % 13 = 0 THEN 'NOPE' ELSE 'BRAND-' || (o_custkey % 25 + 1) END END AS ticker,
    CASE WHEN o_orderkey % 3 <> 1 OR o_orderkey % 5 <> 0 THEN CAST(o_totalprice AS DECIMAL(18, 4)) END AS price,
    CASE WHEN o_orderkey % 3 = 0 OR (o_orderkey % 3 = 1 AND o_orderkey % 4 = 0)
      THEN CAST(o_orderkey % 9 + 1 AS DECIMAL(18, 4)) END AS quantity,
    CASE WHEN o_orderkey % 3 <> 1 OR o_orderkey % 7 = 0 THEN CAST(o_orderdate AS DATE) END AS event_date,
    {PRIORITY} AS currency,
    CASE WHEN o_orderkey % 3 = 2 THEN CASE WHEN o_orderkey % 17 = 0 THEN 'WHIM' ELSE 'MANUEL' END END AS reason,
    CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 19 = 0 THEN 'tip' ELSE 'manuel' END END AS source,
    CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey % 26 AS INTEGER) END AS portfolio_id
  FROM orders),
checked AS (
  SELECT pe.*, p.status, p.quote_currency, p.buy_date,
    list_filter([
      CASE WHEN kind = 'open' AND source <> 'manuel' THEN 'BAD_SOURCE' END,
      CASE WHEN kind = 'open' AND pe.ticker = 'BAD TICKER' THEN 'BAD_TICKER' END,
      CASE WHEN kind = 'open' AND pe.ticker NOT IN (SELECT 'BRAND-' || substr(p_brand, 7) FROM part) THEN 'UNKNOWN_TICKER' END,
      CASE WHEN kind = 'open' AND n.n_nationkey IS NULL THEN 'NO_PORTFOLIO' END,
      CASE WHEN kind = 'open' AND n.n_regionkey = 0 THEN 'INACTIVE_PORTFOLIO' END,
      CASE WHEN kind = 'close' AND reason <> 'MANUEL' THEN 'BAD_REASON' END,
      CASE WHEN kind <> 'open' AND p.status IS NULL THEN 'NO_POSITION' END,
      CASE WHEN kind <> 'open' AND p.status = 'FERMÉ' THEN 'NOT_OPEN' END,
      CASE WHEN kind = 'edit' AND price IS NULL AND pe.quantity IS NULL AND event_date IS NULL THEN 'NOTHING_TO_EDIT' END
    ], lambda x: x IS NOT NULL) AS reasons
  FROM pe LEFT JOIN nation n ON n.n_nationkey = pe.portfolio_id LEFT JOIN positions p ON p.id = pe.position_id)"""
oracle("event_validation", [POSITIONS, EVENTS], """SELECT event_id, kind, array_to_string(reasons, ',') AS reject_reasons
  FROM checked""")

# ---- joins ----------------------------------------------------------------------------------

oracle("etf_index_join", [EBARS, INDEX, ETF], f"""SELECT b.ticker_etf, e.index_ticker, {day('b.date', 'date')}, b.adj_close,
  i.adj_close AS index_price FROM ebars b JOIN etf e USING (ticker_etf)
  JOIN idx i ON i.index_ticker = e.index_ticker AND i.date = b.date""")
oracle("latest_bar", [SBARS], f"""SELECT ticker, {day('date')}, close, volume FROM sbars
  WHERE (ticker, date) IN (SELECT ticker, max(date) FROM sbars GROUP BY 1)""")
oracle("asof_fx", [POSITIONS, FX], f"""SELECT id, quote_currency AS currency, {day('buy_date')}, f.rate,
  {day('f.date', 'rate_date')} FROM positions p ASOF LEFT JOIN fx f
  ON f.currency = p.quote_currency AND f.date <= p.buy_date""")
oracle("asof_tolerance", [SBARS], f"""SELECT id, o.ticker, {day('o.day', 'day')},
  CASE WHEN o.day - b.date <= 5 THEN close END AS close,
  CASE WHEN o.day - b.date <= 5 THEN CAST(b.date AS VARCHAR) END AS bar_date
  FROM (SELECT o_orderkey AS id, CAST(o_custkey % 100 AS VARCHAR) AS ticker, CAST(o_orderdate AS DATE) AS day FROM orders) o
  ASOF LEFT JOIN sbars b ON b.ticker = o.ticker AND b.date <= o.day""")
oracle("monday_rows", [IND, MONDAYS, _eligible("el", "sma_200", 0.0, "mondays")],
       f"SELECT {day('calc_date')}, ticker, {day('row_date')}, price FROM el")
CHOSEN = """chosen AS (SELECT ticker, sector, CASE WHEN h1 THEN z1 ELSE z2 END AS zone FROM (
    SELECT i.*, EXISTS (SELECT 1 FROM force f WHERE f.sector = i.sector AND f.zone = i.z1) AS h1,
      EXISTS (SELECT 1 FROM force f WHERE f.sector = i.sector AND f.zone = i.z2) AS h2 FROM instr i)
  WHERE h1 OR h2)"""
CARRIED = """carried AS (SELECT b.*, CASE WHEN c.zone IS NULL THEN TRUE ELSE coalesce(f.in_force, FALSE) END AS force_rel
  FROM bars b LEFT JOIN chosen c ON c.ticker = b.ticker
  ASOF LEFT JOIN (SELECT * FROM force) f ON f.sector = c.sector AND f.zone = c.zone AND f.date <= b.date)"""
oracle("sector_zone_choice", [FORCE, INSTR, CHOSEN], "SELECT ticker, sector, zone FROM chosen")
oracle("sector_ffill", [BARS, FORCE, INSTR, CHOSEN, CARRIED], f"SELECT ticker, {day('date')}, close, force_rel FROM carried")
oracle("sector_force_priority", [BARS, FORCE, INSTR, _sector_ok("sok", "bars", "date")],
       f"SELECT ticker, {day('date')}, sector_ok AS in_force FROM sok")
LOG = SHIFTED + """,
log AS (SELECT e.event_id AS id, e.ticker, CAST(e.happened AS DATE) AS date, e.value > 50 AS signal,
    CASE event_type WHEN 'click' THEN 'SUGGESTION' WHEN 'purchase' THEN 'SUGGESTION' WHEN 'error' THEN 'REJETÉ_ML'
      WHEN 'signup' THEN 'REJETÉ_NLP' ELSE 'IGNORÉ' END AS decision, e.value AS price_j0,
    b.adj_close AS price_j10, round((b.adj_close - e.value) / nullif(e.value, 0) * 100, 2) AS result_pct
  FROM ev e LEFT JOIN bars b ON b.ticker = e.ticker AND b.date = CAST(e.happened AS DATE) + 10)"""
oracle("signal_result_j10", [BARS, LOG], f"""SELECT id, ticker, {day('date')}, price_j0, price_j10,
  {g('result_pct', 1)} FROM log""")
oracle("portfolio_counts", [POSITIONS], """SELECT n_nationkey AS id, n_name AS name, TRUE AS active,
  count(*) FILTER (p.status = 'OUVERT') AS n_open, count(*) FILTER (p.status = 'FERMÉ') AS n_closed
  FROM nation LEFT JOIN positions p ON p.portfolio_id = n_nationkey WHERE n_regionkey <> 0 GROUP BY 1, 2""")


def _macro_ok(name: str, source: str, on: str, zone: str = "z1") -> str:
    return f"""{name} AS (SELECT c.*, coalesce(m.bull, TRUE) AS macro_ok FROM {source} c
  ASOF LEFT JOIN (SELECT * FROM macro) m ON m.zone = coalesce(c.{zone}, 'US') AND m.date <= c.{on})"""


def adaptive(atr: str, price: str) -> str:
    return f"""CASE WHEN {price} <= 0 THEN 3.0 ELSE greatest(2.0, least(4.0,
    round(2.0 + {atr} / {price} * 100 * 0.5, 2))) END"""


def _exits(name: str, entries: str, sma: str) -> str:
    """First exit of each entry under the stop and the four rules, walking over all bars after it."""
    return f"""{name}0 AS (SELECT e.ticker, e.seq, e.k, e.price AS p0, e.atr AS a0, b.seq AS bseq, b.date, b.price, b.{sma} AS mean,
    b.mom_r2, b.sector_ok, b.macro_ok, coalesce(b.atr_14, e.atr) AS a,
    greatest(e.price, max(b.price) OVER (PARTITION BY e.ticker, e.seq ORDER BY b.seq ROWS UNBOUNDED PRECEDING)) AS hi
  FROM {entries} e JOIN st b ON b.ticker = e.ticker AND b.seq > e.seq),
{name}1 AS (SELECT *, greatest(p0 - k * a0, max(hi - k * a) OVER (PARTITION BY ticker, seq ORDER BY bseq
    ROWS UNBOUNDED PRECEDING)) AS stop FROM {name}0),
{name}2 AS (SELECT *, CASE WHEN price <= stop THEN 'TRAILING_STOP' WHEN price < mean THEN 'TREND_BROKEN'
    WHEN mom_r2 < 0 THEN 'MOMENTUM_LOST' WHEN NOT sector_ok THEN 'SECTOR_WEAK' WHEN NOT macro_ok THEN 'MACRO_BEARISH'
    END AS reason FROM {name}1),
{name} AS (SELECT * FROM {name}2 WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ticker, seq ORDER BY bseq) = 1)"""


STATE = [_sector_ok("s0", "ind", "date"), _macro_ok("st", "s0", "date")]


def _entries(name: str, source: str) -> str:
    return f"""{name} AS (SELECT DISTINCT ticker, seq, price, atr_14 AS atr, {adaptive('atr_14', 'price')} AS k
  FROM {source} WHERE row_date = calc_date)"""


oracle("exit_check", [IND, MONDAYS, FORCE, INSTR, MACRO, *STATE, *[x for n in (200, 150) for x in (
    _eligible(f"el{n}", f"sma_{n}", 0.0, "mondays"), _entries(f"en{n}", f"el{n}"), _exits(f"ex{n}", f"en{n}", f"sma_{n}"))]],
    " UNION ALL ".join(f"""SELECT e.ticker, e.seq, {n} AS sma_period, {g('e.k', 2, 'k')}, x.bseq AS exit_seq, {day('x.date', 'exit_date')},
  x.price AS exit_price, x.reason AS exit_reason FROM en{n} e LEFT JOIN ex{n} x ON x.ticker = e.ticker AND x.seq = e.seq"""
                       for n in (200, 150)))

# ---- aggregates -----------------------------------------------------------------------------

oracle("stale_tickers", [SBARS, LAST], f"""SELECT ticker, {day('max(date)', 'last_date')} FROM sbars, last_day
  GROUP BY ticker, d HAVING max(date) < d - 3""")
oracle("missing_tickers", [SBARS], """SELECT CAST(c_custkey AS VARCHAR) AS ticker FROM customer WHERE
  CAST(c_custkey AS VARCHAR) NOT IN (SELECT ticker FROM sbars)""")
_PROFILE = {"log": ["id", "ticker", "date", "signal", "decision", "price_j0", "price_j10", "result_pct"],
            "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                         "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]}
oracle("profile", [BARS, LOG], "\nUNION ALL ".join(
    f"""SELECT '{'signal_log' if t == 'log' else t}' AS "table", {i} AS position, '{c}' AS "column", count(*) AS n_rows,
  count(*) - count({c}) AS n_null, {g(f'(count(*) - count({c})) * 100.0 / count(*)', 4, 'null_pct')} FROM {t}"""
    for t, cols in _PROFILE.items() for i, c in enumerate(cols, 1)))
oracle("system_health", [BARS, LOG], f"""SELECT {day('min(date)', 'first_date')}, {day('max(date)', 'last_date')},
  count(DISTINCT date) AS n_days, count(*) AS n_analyses, count(*) FILTER (signal) AS n_signals,
  count(*) FILTER (decision = 'SUGGESTION') AS n_suggestions, count(*) FILTER (decision = 'REJETÉ_ML') AS n_rejected_ml,
  count(*) FILTER (decision = 'REJETÉ_NLP') AS n_rejected_nlp,
  round(100.0 * count(*) FILTER (decision = 'SUGGESTION' AND result_pct >= 5)
    / nullif(count(*) FILTER (decision = 'SUGGESTION' AND result_pct IS NOT NULL), 0), 2) AS success_pct
  FROM log WHERE date >= (SELECT max(date) FROM log) - 30""")
LABEL = """label AS (SELECT ticker, date, adj_close, CASE WHEN f IS NULL THEN NULL WHEN f >= adj_close * 1.05 THEN 1 ELSE 0
    END AS target FROM (SELECT *, lead(adj_close, 10) OVER (PARTITION BY ticker ORDER BY date) AS f FROM bars
    WHERE adj_close > 0))"""
oracle("label10", [BARS, LABEL], f"SELECT ticker, {day('date')}, target FROM label")
oracle("label_share", [BARS, LABEL], """SELECT target, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct
  FROM label WHERE target IS NOT NULL GROUP BY 1""")
oracle("lot_concentration", [OPINIONS, INSTR], f"""SELECT {day('week', 'lot')},
  coalesce(CASE WHEN n % 4 <> 0 THEN sector END, 'Inconnu') AS sector, count(*) AS n FROM op LEFT JOIN instr USING (ticker)
  WHERE type = 'ranking' GROUP BY op.week, 2""")


def _forward(types: str) -> str:
    def horizon(h: str, days: int) -> str:
        return f"""
    CASE WHEN type IN ({types}) AND anchor + {days} <= d AND t{h}.date > anchor THEN t{h}.adj_close END AS price_{h},
    CASE WHEN type IN ({types}) AND anchor + {days} <= d AND t{h}.date > anchor
      THEN (t{h}.adj_close - start_price) / start_price END AS return_{h}"""
    joins = "".join(f"""
  ASOF LEFT JOIN (SELECT * FROM bars) t{h} ON t{h}.ticker = a.ticker AND t{h}.date <= a.anchor_{h}"""
                    for h in ("1w", "2w", "4w"))
    return f"""anchored AS (SELECT o.*, b.date AS anchor, b.adj_close AS start_price, b.date + 7 AS anchor_1w,
    b.date + 14 AS anchor_2w, b.date + 28 AS anchor_4w, CAST(o.generated_at AS DATE) AS written
  FROM op o ASOF LEFT JOIN (SELECT * FROM bars) b ON b.ticker = o.ticker AND b.date <= o.generated_at),
fwd AS (SELECT a.week, a.ticker, a.type, a.rank, a.conviction, a.prompt_version, a.model,
    {", ".join(horizon(h, n) for h, n in (("1w", 7), ("2w", 14), ("4w", 28)))}
  FROM anchored a CROSS JOIN last_day{joins})"""


FWD = [BARS, LAST, OPINIONS, _forward("'ranking'")]
_H = ("1w", "2w", "4w")
oracle("forward_returns", FWD, f"SELECT {day('week')}, ticker, type, " + ", ".join(
    [g(f"price_{h}") for h in _H] + [g(f"return_{h}") for h in _H]) + " FROM fwd")
SOME = "coalesce(return_1w, return_2w, return_4w) IS NOT NULL"


def _perf(keys: str, where: str, hit: str = "({r}) > 0") -> str:
    stats = ", ".join(f"{g(f'avg(return_{h})', 6, f'mean_{h}')}, " + g(
        f"avg(CAST({hit.format(r=f'return_{h}')} AS INTEGER))", 6, f"hit_{h}") for h in _H)
    return f"SELECT {keys}, count(*) AS n, {stats} FROM fwd WHERE {SOME} AND {where} GROUP BY ALL"


oracle("opinion_perf", FWD, _perf("conviction", "type = 'ranking'"))
oracle("opinion_perf_version", FWD, _perf("prompt_version, model", "type = 'ranking'"))
oracle("opinion_perf_position", [BARS, LAST, OPINIONS, _forward("'ranking', 'position'")], _perf(
    "conviction", "type = 'position'", "CASE WHEN conviction = 'VENDRE' THEN {r} < 0 ELSE {r} > 0 END"))
oracle("opinion_coverage", FWD, f"""SELECT type, count(*) AS n, count(*) FILTER ({SOME}) AS n_with_return,
  count(DISTINCT week) AS n_weeks, count(DISTINCT ticker) AS n_tickers FROM fwd GROUP BY 1""")
oracle("opinion_detail", FWD, f"""SELECT {day('week')}, ticker, rank, conviction, {', '.join(g(f'return_{h}') for h in _H)}
  FROM fwd WHERE type = 'ranking' AND prompt_version IN ('v0', 'v1', '—') AND model = 'm0' AND {SOME}""")
oracle("last_opinion", FWD + ["rank_op AS (SELECT *, coalesce(return_4w, return_2w, return_1w) AS r FROM fwd WHERE type = 'ranking')"],
       f"""SELECT {day('week')}, ticker, conviction,
  CAST(lag(week) OVER w AS VARCHAR) AS prev_week, lag(conviction) OVER w AS prev_conviction,
  {g('lag(r) OVER w', 6, 'prev_return')} FROM rank_op WINDOW w AS (PARTITION BY ticker ORDER BY rank_op.week)""")
oracle("closed_summary", [POSITIONS], """SELECT count(*) AS n_closed, count(*) FILTER (coalesce(result_pct, 0) > 0) AS n_wins,
  count(*) FILTER (coalesce(result_pct, 0) <= 0) AS n_losses, CAST(sum(result) AS DOUBLE) AS total_result
  FROM amounts WHERE status = 'FERMÉ'""")
oracle("exit_reason_stats", [POSITIONS], f"""SELECT portfolio_id, sell_reason AS exit_reason, count(*) AS n_trades,
  {g('avg(result_pct)', 5, 'avg_return_pct')}, {g('count(*) FILTER (result_pct > 0) * 100.0 / count(*)', 5, 'win_rate_pct')}
  FROM amounts WHERE status = 'FERMÉ' GROUP BY 1, 2""")
_WIN = "round(coalesce(avg(result_pct) FILTER (result_pct > 0), 0), 2)"
_LOSS = "round(coalesce(avg(result_pct) FILTER (result_pct <= 0), 0), 2)"
oracle("trade_measures", [POSITIONS], f"""SELECT ticker, count(*) AS n_trades,
  {g('count(*) FILTER (result_pct > 0) * 100.0 / count(*)', 4, 'win_rate_pct')}, {g(_WIN, 2, 'avg_win_pct')}, {g(_LOSS, 2, 'avg_loss_pct')},
  {g(f'CASE WHEN {_LOSS} <> 0 THEN abs({_WIN} / {_LOSS}) ELSE 0 END', 4, 'profit_factor')},
  {g('coalesce(avg(sell_date - buy_date) FILTER (sell_date > buy_date), 0)', 4, 'avg_duration_days')}
  FROM amounts WHERE status = 'FERMÉ' GROUP BY 1""")
EQUITY = """equity AS (SELECT index_ticker, date_trunc('week', date) AS wk, arg_max(close, date) AS v FROM idx GROUP BY 1, 2),
rets AS (SELECT *, v / lag(v) OVER (PARTITION BY index_ticker ORDER BY wk) - 1 AS r,
    max(v) OVER (PARTITION BY index_ticker ORDER BY wk ROWS UNBOUNDED PRECEDING) AS peak FROM equity)"""
oracle("sharpe_weekly", [INDEX, EQUITY], f"""SELECT index_ticker, {g('avg(r) / (stddev_pop(r) + 1e-9) * sqrt(52)', 6, 'sharpe')}
  FROM rets GROUP BY 1""")
oracle("drawdown", [INDEX, EQUITY], f"""SELECT index_ticker, {g('max((peak - v) / peak * 100)', 6, 'max_drawdown_pct')}
  FROM rets GROUP BY 1""")
PLAIN_RANK = [IND, MONDAYS, _eligible("el", "sma_200", 0.0, "mondays"), _ranked("rk", "el")]
oracle("sector_counts", [STRENGTH], """SELECT e.zone, count(*) AS n_sectors FROM strength s JOIN etf e USING (ticker_etf)
  WHERE in_force AND (s.ticker_etf, s.date) IN (SELECT ticker_etf, max(date) FROM strength GROUP BY 1) GROUP BY 1""")

# ---- indicators -----------------------------------------------------------------------------

_W = "PARTITION BY ticker ORDER BY date"
oracle("sma", [BARS], f"SELECT ticker, {day('date')}, " + ", ".join(
    f"CASE WHEN row_number() OVER ({_W}) >= {n} THEN " + g(
        f"avg(adj_close) OVER ({_W} ROWS {n - 1} PRECEDING)", 4, f"sma_{n}").replace(" AS sma", " END AS sma")
    for n in (20, 50, 150, 200)) + ", " + g(f"avg(adj_close) OVER ({_W} ROWS 199 PRECEDING)", 4, "sma_200_open") + " FROM bars")
oracle("rsi14", [BARS, _analysis("a", "bars")], f"SELECT ticker, {day('date')}, {g('rsi_14')}, {g('rsi_slope')} FROM a")
oracle("bollinger", [BARS, _analysis("a", "bars")], f"SELECT ticker, {day('date')}, {g('bb_lower', 2)}, {g('bb_position')} FROM a")
oracle("atr14", [BARS], f"""SELECT ticker, {day('date')}, {g(f'avg(tr) OVER ({_W} ROWS 13 PRECEDING)', 3, 'atr_14')} FROM (
  SELECT *, CASE WHEN CAST(substr(ticker, 7) AS INTEGER) % 5 <> 0 THEN greatest(high - low, abs(high - pc), abs(low - pc))
    ELSE abs(adj_close - pc) END AS tr FROM (SELECT *, lag(adj_close) OVER ({_W}) AS pc FROM bars))""")
oracle("rvol", [BARS], f"""SELECT ticker, {day('date')},
  CASE WHEN count(v) OVER ({_W} ROWS 19 PRECEDING) >= 20 THEN floor(v / (avg(v) OVER ({_W} ROWS 19 PRECEDING) + 1e-9)
    * 1e6 + 0.37) / 1e6 END AS vol_ratio,
  {g(f'coalesce(v, 0) / (avg(coalesce(v, 0)) OVER ({_W} ROWS 19 PRECEDING) + 1e-9)', 6, 'rvol')}
  FROM (SELECT *, CASE WHEN day(date) % 9 <> 0 THEN volume END AS v FROM bars)""")
oracle("obv_slope", [BARS], f"""SELECT ticker, {day('date')}, obv, obv - lag(obv, 10) OVER (PARTITION BY ticker ORDER BY o.date)
  AS obv_slope FROM (SELECT ticker, date, sum(sv) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS obv FROM (
    SELECT *, CASE WHEN adj_close > pc THEN volume WHEN adj_close < pc THEN -volume ELSE 0 END AS sv
    FROM (SELECT *, lag(adj_close) OVER ({_W}) AS pc FROM bars))) o""")
oracle("breakout50", [BARS], f"""SELECT ticker, {day('date')},
  adj_close >= max(adj_close) OVER (PARTITION BY ticker ORDER BY b.date ROWS 49 PRECEDING) AS breakout FROM bars b""")
oracle("regime", [BARS, _analysis("a", "bars")], f"SELECT ticker, {day('date')}, regime FROM a")
oracle("momentum_r2", [IND], f"SELECT ticker, {day('date')}, {g('mom_r2')} FROM ind")


def _signals(name: str, source: str) -> str:
    return f"""{name}0 AS (SELECT ticker, date, adj_close AS price, volume AS vol, high, low, force_rel,
    row_number() OVER ({_W}) AS rn, lag(adj_close) OVER ({_W}) AS pc, lag(adj_close, 252) OVER ({_W}) AS p252,
    ln(adj_close) AS lp FROM {source}),
{name}1 AS (SELECT *, CASE WHEN price > pc THEN vol WHEN price < pc THEN -vol ELSE 0 END AS sv,
    greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM {name}0),
{name}2 AS (SELECT *, avg(price) OVER ({_W} ROWS 199 PRECEDING) AS sma_200,
    CASE WHEN rn > 252 THEN regr_r2(lp, rn) OVER ({_W} ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING) END AS fit,
    price >= max(price) OVER ({_W} ROWS 49 PRECEDING) AS breakout,
    vol / (avg(vol) OVER ({_W} ROWS 19 PRECEDING) + 1e-9) AS rvol,
    sum(sv) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS obv, avg(tr) OVER ({_W} ROWS 13 PRECEDING) AS atr_14 FROM {name}1),
{name} AS (SELECT *, rn - 1 AS seq, (pc - p252) / p252 * fit AS mom_r2, price > sma_200 AS trend_ok, rvol > 1.5 AS rvol_high,
    coalesce(obv - lag(obv, 10) OVER ({_W}) > 0, FALSE) AS obv_rising FROM {name}2)"""


PLAIN_FORCE = "plain AS (SELECT *, TRUE AS force_rel FROM bars)"
oracle("momentum_r2_lagged", [BARS, PLAIN_FORCE, _signals("sg", "plain")], f"SELECT ticker, {day('date')}, {g('mom_r2')} FROM sg")
oracle("macro_regime", [INDEX, MACRO], f"SELECT zone, {day('date')}, price, {g('sma_200', 4)}, bull FROM macro")
oracle("macro_status", [INDEX, MACRO], f"""SELECT zone, {day('date')}, price, {g('sma_200', 4)},
  price > macro.sma_200 AS bull, {g('(price - macro.sma_200) / macro.sma_200 * 100', 6, 'pct_vs_sma')}
  FROM macro WHERE (zone, macro.date) IN (SELECT zone, max(date) FROM macro GROUP BY 1)""")
oracle("sector_strength", [STRENGTH], f"""SELECT ticker_etf, {day('date')}, {g('ratio')}, {g('ratio_vs_ma50')}, in_force
  FROM strength""")
INCREMENT = """cut AS (SELECT CAST(date_trunc('month', d) - INTERVAL 1 MONTH AS DATE) AS c
  FROM (SELECT max(CAST(o_orderdate AS DATE)) AS d FROM orders)),
fresh AS (SELECT ticker_etf, date, close, adj_close + CASE WHEN date >= c THEN 1 ELSE 0 END AS adj_close, volume
  FROM ebars, cut)"""
oracle("sector_strength_increment", [EBARS, INDEX, ETF, INCREMENT, _strength("st", "fresh")],
       f"""SELECT ticker_etf, {day('date')}, adj_close, {g('ratio_vs_ma50')}, in_force FROM st, cut WHERE st.date >= c""")
NEWEST = "(s.ticker_etf, s.date) IN (SELECT ticker_etf, max(date) FROM strength GROUP BY 1)"
oracle("sectors_in_force", [STRENGTH], f"""SELECT e.sector, e.zone, s.ticker_etf, e.index_ticker, {day('s.date', 'date')},
  {g('ratio')}, {g('ratio_vs_ma50')}, in_force FROM strength s JOIN etf e USING (ticker_etf) WHERE in_force AND {NEWEST}""")
oracle("sectors_dashboard", [STRENGTH], f"""SELECT e.zone, e.sector, e.ticker_etf, e.name, {day('n.date', 'date')},
  {g('round(n.ratio, 6)', 5, 'ratio')}, in_force, CASE WHEN in_force THEN '✅ En force' ELSE '❌ Hors force' END AS status
  FROM etf e LEFT JOIN (SELECT * FROM strength s WHERE {NEWEST}) n ON n.ticker_etf = e.ticker_etf""")

# ---- ranking --------------------------------------------------------------------------------

oracle("ranking_indicators", [IND], f"""SELECT ticker, {day('date')}, seq, price, {g('sma_200', 4)}, {g('sma_150', 4)},
  {g('mom_r2')}, {g('rvol')}, obv_slope, {g('atr_14', 3)} FROM ind""")
oracle("adaptive_k", [BARS], f"SELECT ticker, {day('date')}, {g(adaptive('(high - low)', 'close'), 2, 'k')} FROM bars")
oracle("composite_ranking", [IND, MONDAYS, FORCE, INSTR, _eligible("el", "sma_200", 0.0, "mondays"),
                             _sector_ok("sok", "el", "calc_date"),
                             "passing AS (SELECT * FROM sok WHERE sector_ok)", _ranked("rk", "passing")],
       f"SELECT {day('calc_date')}, rank, ticker, {g('score')}, sector FROM rk")
oracle("eligible_daily", [IND, _eligible("el", "sma_150", 0.01, None), _ranked("rk", "el")],
       f"SELECT {day('calc_date')}, rank, ticker, {g('score')} FROM rk WHERE rank <= 10")
oracle("daily_ranking", [
    IND, FORCE, INSTR, MACRO, "newest AS (SELECT max(date) AS calc_date FROM ind)",
    _eligible("el", "sma_200", 0.0, "newest"), _sector_ok("sok", "el", "calc_date"),
    "passing AS (SELECT * FROM sok WHERE sector_ok)", _ranked("rk", "passing", ", count(*) OVER () AS n_eligible"),
    """regime AS (SELECT string_agg(zone || '=' || bull, ',' ORDER BY zone) AS macro FROM (
    SELECT zone, arg_max(bull, date) AS bull FROM macro, newest WHERE date <= calc_date GROUP BY 1))"""],
    f"""SELECT '2002-01-01' AS calc_date, rank, ticker, {g('round(score, 4)', 3, 'score')},
  {g('round(mom_r2, 4)', 3, 'mom_r2')}, z1 AS zone, sector, macro, n_eligible,
  (SELECT count(DISTINCT ticker) FROM ind) AS n_total, {day('rk.calc_date', 'data_date')} FROM rk, regime WHERE rank <= 20""")
ORACLES["ranking_stored_latest"] = ORACLES["daily_ranking"].replace("sector, macro, n_eligible", "sector, n_eligible")
oracle("latest_ranking", PLAIN_RANK, f"""SELECT {day('calc_date')}, rank, ticker, {g('score')} FROM rk
  WHERE rank <= 2 AND rk.calc_date = (SELECT max(calc_date) FROM rk)""")
oracle("ticker_snapshot", PLAIN_RANK + [INSTR], f"""SELECT i.ticker, {day('i.date', 'date')},
  {g('round(i.mom_r2, 4)', 3, 'mom_r2')}, {g('round(i.rvol, 2)', 1, 'rvol')}, i.obv_slope, i.price,
  {g('CASE WHEN i.atr_14 > 0 THEN ' + adaptive('i.atr_14', 'i.price') + ' ELSE 3.0 END', 1, 'k')}, s.z1 AS zone, s.sector, r.rank
  FROM ind i LEFT JOIN instr s ON s.ticker = i.ticker LEFT JOIN (SELECT ticker, rank FROM rk WHERE rank <= 3
    AND calc_date = (SELECT max(calc_date) FROM rk)) r ON r.ticker = i.ticker
  WHERE i.next_date IS NULL""")
oracle("quant_diagnosis", [IND], f"""SELECT ticker, {day('date')}, {g('(price - sma_200) / sma_200 * 100', 4, 'pct_vs_sma')},
  CASE WHEN price > sma_200 THEN 'GREEN' WHEN sma_200 IS NOT NULL THEN 'RED' END AS trend_light,
  CASE WHEN mom_r2 > 0.3 THEN 'GREEN' WHEN mom_r2 > 0 THEN 'YELLOW' WHEN mom_r2 IS NOT NULL THEN 'RED' END AS momentum_light,
  CASE WHEN rvol > 2 THEN 'GREEN' WHEN rvol > 1 THEN 'YELLOW' ELSE 'RED' END AS volume_light,
  CASE WHEN obv_slope > 0 THEN 'GREEN' WHEN obv_slope IS NOT NULL THEN 'RED' END AS accumulation_light,
  TRUE AS has_momentum_data FROM ind""")

# ---- signals --------------------------------------------------------------------------------


def _thinned(name: str, source: str) -> str:
    """Greedy thinning by a recursive walk over the raw signals."""
    return f"""{name}(ticker, seq) AS (
  SELECT ticker, min(seq) FROM {source} GROUP BY 1
  UNION ALL SELECT t.ticker, (SELECT min(r.seq) FROM {source} r WHERE r.ticker = t.ticker AND r.seq > t.seq + 5)
  FROM {name} t WHERE EXISTS (SELECT 1 FROM {source} r WHERE r.ticker = t.ticker AND r.seq > t.seq + 5))"""


def recursive(name: str, ctes: list[str], select: str) -> None:
    ORACLES[name] = "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + select


FULL_SIGNALS = [BARS, FORCE, INSTR, CHOSEN, CARRIED, _signals("sg", "carried")]
recursive("cooldown", [BARS, PLAIN_FORCE, _signals("sg", "plain"), "raw AS (SELECT ticker, seq FROM sg WHERE rvol_high)",
                       _thinned("kept", "raw")], "SELECT ticker, seq FROM kept")
recursive("signals_v35", FULL_SIGNALS + [
    """flag AS (SELECT *, trend_ok AND force_rel AND coalesce(mom_r2 > 0, FALSE) AND breakout AND rvol_high AND obv_rising
    AS signal_raw FROM sg)""", "raw AS (SELECT ticker, seq FROM flag WHERE signal_raw)", _thinned("kept", "raw")],
    f"""SELECT f.ticker, {day('date')}, trend_ok, force_rel, breakout, rvol_high, obv_rising, signal_raw,
  k.seq IS NOT NULL AS signal FROM flag f LEFT JOIN kept k ON k.ticker = f.ticker AND k.seq = f.seq""")
BREAKOUTS = FULL_SIGNALS + ["raw AS (SELECT ticker, seq FROM sg WHERE breakout AND rvol_high)", _thinned("kept", "raw"),
                            """ent AS (SELECT s.*, kk.k FROM sg s JOIN kept USING (ticker, seq),
    (SELECT unnest([2.0, 2.5, 3.0, 3.5, 4.0]) AS k) kk)""",
                            """walk0 AS (SELECT e.ticker, e.seq, e.k, e.price AS p0, e.atr_14 AS a0, b.seq AS bseq, b.date, b.price,
    coalesce(b.atr_14, e.atr_14) AS a, greatest(e.price, max(b.price) OVER (PARTITION BY e.ticker, e.seq, e.k
      ORDER BY b.seq ROWS UNBOUNDED PRECEDING)) AS hi FROM ent e JOIN sg b ON b.ticker = e.ticker AND b.seq > e.seq),
walk AS (SELECT *, greatest(p0 - k * a0, max(hi - k * a) OVER (PARTITION BY ticker, seq, k ORDER BY bseq
    ROWS UNBOUNDED PRECEDING)) AS stop FROM walk0),
hit AS (SELECT * FROM walk WHERE price <= stop QUALIFY row_number() OVER (PARTITION BY ticker, seq, k ORDER BY bseq) = 1),
ex AS (SELECT e.ticker, e.seq, CAST(e.k AS DOUBLE) AS k, e.date AS entry_date, e.price, e.force_rel, h.bseq AS exit_seq,
    h.date AS exit_date, h.price AS exit_price FROM ent e LEFT JOIN hit h ON h.ticker = e.ticker AND h.seq = e.seq AND h.k = e.k)"""]
TAKEN = """taken(ticker, k, seq, exit_seq) AS (
  SELECT ticker, k, seq, exit_seq FROM ex QUALIFY row_number() OVER (PARTITION BY ticker, k ORDER BY seq) = 1
  UNION ALL SELECT x.ticker, x.k, x.seq, x.exit_seq FROM taken t JOIN ex x ON x.ticker = t.ticker AND x.k = t.k
    AND x.seq = (SELECT min(y.seq) FROM ex y WHERE y.ticker = t.ticker AND y.k = t.k AND y.seq > t.exit_seq))"""
recursive("chandelier_exits", BREAKOUTS, f"""SELECT ticker, seq, k, {day('entry_date')}, exit_seq, {day('exit_date')},
  exit_price FROM ex""")
recursive("signal_trades", BREAKOUTS + [TAKEN], """SELECT t.ticker, t.k, t.seq, t.exit_seq, x.exit_price
  FROM taken t JOIN ex x USING (ticker, k, seq)""")
recursive("trade_detail", BREAKOUTS + [TAKEN, f"""later AS (SELECT ticker, seq, lead(price, 30) OVER ({_W}) AS price_later,
    last_value(price) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_price FROM sg)""",
                                       """detail AS (SELECT x.*, t.seq IS NOT NULL AS kept, price_later,
    (coalesce(x.exit_price, last_price) - x.price) / x.price * 100 AS pct FROM ex x JOIN later l USING (ticker, seq)
    LEFT JOIN taken t ON t.ticker = x.ticker AND t.k = x.k AND t.seq = x.seq WHERE x.k = 2.0)"""],
          f"""SELECT ticker, k, {day('entry_date')}, CASE WHEN kept THEN CAST(exit_date AS VARCHAR) END AS exit_date,
  CASE WHEN kept THEN d.exit_date - d.entry_date END AS duration_days, price AS entry_price,
  CASE WHEN kept THEN exit_price END AS exit_price,
  CASE WHEN kept THEN floor(round(pct, 2) * 10 + 0.37) / 10 END AS return_pct,
  CASE WHEN NOT kept THEN 'IGNORED' WHEN exit_seq IS NULL THEN 'OPEN' WHEN round(pct, 2) > 0 THEN 'WIN' ELSE 'LOSS' END AS outcome,
  price_later, force_rel FROM detail d""")
recursive("signal_outcomes", FULL_SIGNALS + [
    "raw AS (SELECT ticker, seq FROM sg WHERE breakout AND rvol_high)", _thinned("kept", "raw"),
    f"fut AS (SELECT *, round((lead(price, 30) OVER ({_W}) - price) / price * 100, 2) AS r FROM sg)"],
    f"""SELECT ticker, force_rel, count(*) AS n_signals, {g('avg(r)', 4, 'mean_return_pct')},
  {g('avg(CAST(r > 0 AS INTEGER)) * 100', 4, 'success_pct')} FROM fut JOIN kept USING (ticker, seq)
  WHERE r IS NOT NULL GROUP BY 1, 2""")
SWEEP = BREAKOUTS + [TAKEN, f"""gridded AS (SELECT s.ticker, kk.k, s.seq, s.date,
    s.price / lag(s.price) OVER (PARTITION BY s.ticker, kk.k ORDER BY s.seq) - 1 AS chg
  FROM sg s, (SELECT unnest([2.0, 2.5, 3.0, 3.5, 4.0])::DOUBLE AS k) kk WHERE s.ticker IN (SELECT ticker FROM kept)),
daily AS (SELECT gr.*, CASE WHEN t.seq IS NOT NULL THEN chg ELSE 0.0 END AS ret FROM gridded gr LEFT JOIN taken t
  ON t.ticker = gr.ticker AND t.k = gr.k AND gr.seq > t.seq AND gr.seq <= coalesce(t.exit_seq, 2147483647)),
curve AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY ticker, k ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS v FROM daily),
curve2 AS (SELECT *, greatest(1.0, max(v) OVER (PARTITION BY ticker, k ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS peak FROM curve),
m1 AS (SELECT ticker, k, round(coalesce(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(365), 0), 3) AS sharpe,
    (arg_max(v, seq) - 1) * 100 AS total_return_pct, max((peak - v) / peak) * 100 AS max_drawdown_pct FROM curve2 GROUP BY 1, 2),
m2 AS (SELECT ticker, k, count(*) AS n_trades, coalesce(count(*) FILTER (r > 0) * 100.0 / nullif(count(r), 0), 0) AS win_rate_pct,
    coalesce(avg(r) FILTER (r > 0), 0) AS avg_win_pct FROM (SELECT ticker, k, (x.exit_price / x.price - 1) * 100 AS r
      FROM taken t JOIN ex x USING (ticker, k, seq)) GROUP BY 1, 2),
ms AS (SELECT *, sharpe >= 1.0 AS ok FROM m1 JOIN m2 USING (ticker, k))"""]
recursive("signal_backtest", SWEEP, f"""SELECT ticker, k, {g('sharpe', 2)}, {g('total_return_pct', 4)},
  {g('max_drawdown_pct', 4)}, n_trades, {g('win_rate_pct', 4)}, {g('avg_win_pct', 4)}, ok, 'TESTED' AS outcome FROM ms""")
oracle("backtest_admission", [SBARS, LAST], """SELECT ticker, count(*) AS n_days, count(*) >= 302 AS admitted FROM sbars, last_day
  WHERE date >= d - 1400 AND adj_close > 0 GROUP BY 1""")
recursive("best_k", SWEEP, f"""SELECT ticker, k AS best_k, {g('sharpe', 2, 'best_sharpe')} FROM ms
  QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ms.sharpe DESC, k) = 1""")
recursive("k_sweep", SWEEP + [
    """byk AS (SELECT k, round(avg(sharpe), 3) AS sharpe_mean, count(*) FILTER (ok) AS n_ok, count(*) AS n_tickers FROM ms GROUP BY 1),
bst AS (SELECT k AS bk, n_ok AS bn FROM byk ORDER BY sharpe_mean DESC, k LIMIT 1)"""],
    f"SELECT k, {g('sharpe_mean', 2)}, n_ok, n_tickers, k = bk AS is_best, bn >= 3 AS validated FROM byk, bst")

# ---- portfolio backtest ---------------------------------------------------------------------

_HELD = "STRUCT(ticker VARCHAR, entry DATE, price DOUBLE, k DOUBLE, shares DOUBLE, exit_date DATE, exit_price DOUBLE, exit_reason VARCHAR, money DOUBLE)[]"
BACKTEST_DAYS = """bt AS (SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) AS i, count(*) OVER () AS n
    FROM (SELECT DISTINCT date FROM ind)) WHERE n <= 302 OR i > 302),
mons AS MATERIALIZED (SELECT date AS calc_date, row_number() OVER (ORDER BY date) AS w FROM bt WHERE dayofweek(date) = 1),
ends AS (SELECT max(date) AS last_date, (SELECT max(calc_date) FROM mons) AS last_monday FROM bt)"""


def _hybrid(i: int, name: str, size: int, sma: int, least: float) -> list[str]:
    """Portfolio of one configuration, Monday by Monday: a recursive query whose state is the list of held trades."""
    stake = 50000.0 / size
    return [
        _eligible(f"el{i}", f"sma_{sma}", least, "mons"), _sector_ok(f"so{i}", f"el{i}", "calc_date"),
        f"sp{i} AS (SELECT * FROM so{i} WHERE sector_ok)", _ranked(f"rk{i}", f"sp{i}"), _macro_ok(f"rm{i}", f"rk{i}", "calc_date"),
        f"""pass{i} AS (SELECT *, row_number() OVER (PARTITION BY calc_date ORDER BY score DESC, ticker) AS place
  FROM rm{i} WHERE macro_ok)""",
        f"best{i} AS (SELECT * FROM pass{i} WHERE place <= {size})", _entries(f"en{i}", f"best{i}"), _exits(f"ex{i}", f"en{i}", f"sma_{sma}"),
        f"""cand{i} AS MATERIALIZED (SELECT b.calc_date, list({{'ticker': b.ticker, 'price': b.price, 'k': e.k, 'has_bar': b.row_date = b.calc_date,
    'exit_date': CASE WHEN x.date <= last_monday THEN x.date END, 'exit_price': CASE WHEN x.date <= last_monday THEN x.price END,
    'exit_reason': CASE WHEN x.date <= last_monday THEN x.reason END}} ORDER BY b.place) AS items
  FROM best{i} b LEFT JOIN en{i} e ON e.ticker = b.ticker AND e.seq = b.seq
  LEFT JOIN ex{i} x ON x.ticker = b.ticker AND x.seq = b.seq AND b.row_date = b.calc_date, ends GROUP BY 1)""",
        f"""run{i}(w, day, cash, held, n_free, n_bought, bought) AS (
  SELECT CAST(0 AS BIGINT), CAST(NULL AS DATE), CAST(50000 AS DOUBLE), CAST([] AS {_HELD}), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST([] AS {_HELD})
  UNION ALL
  SELECT w, calc_date, have - coalesce(list_sum(list_transform(news, lambda b: b.money)), 0), list_concat(kept, news), free, len(picked), news
  FROM (SELECT *, list_filter(list_transform(list_filter(picked, lambda x: x.has_bar), lambda x, j: {{'ticker': x.ticker, 'entry': calc_date,
        'price': x.price, 'k': x.k, 'shares': least({stake}, have - (j - 1) * {stake}) / x.price, 'exit_date': x.exit_date,
        'exit_price': x.exit_price, 'exit_reason': x.exit_reason, 'money': least({stake}, have - (j - 1) * {stake})}}),
      lambda b: b.money >= 100) AS news
    FROM (SELECT *, CASE WHEN free > 0 THEN list_filter(items, lambda x: NOT list_contains(names, x.ticker))[1:free] ELSE [] END AS picked
      FROM (SELECT *, CAST({size} - len(kept) AS BIGINT) AS free, list_transform(kept, lambda h: h.ticker) AS names
        FROM (SELECT m.w, m.calc_date, coalesce(c.items, []) AS items,
            list_filter(r.held, lambda h: coalesce(h.exit_date > m.calc_date, TRUE)) AS kept,
            r.cash + coalesce(list_sum(list_transform(list_filter(r.held, lambda h: coalesce(h.exit_date <= m.calc_date, FALSE)),
              lambda h: h.shares * h.exit_price)), 0) AS have
          FROM run{i} r JOIN mons m ON m.w = r.w + 1 LEFT JOIN cand{i} c ON c.calc_date = m.calc_date)))))""",
        f"""sold{i} AS (SELECT b.*, coalesce(b.exit_price, p.price) AS end_price, coalesce(b.exit_date, last_date) AS end_date
  FROM (SELECT unnest(bought, max_depth := 2) FROM run{i}) b JOIN ends ON TRUE
  ASOF LEFT JOIN (SELECT ticker, date, price FROM ind) p ON p.ticker = b.ticker AND p.date <= ends.last_date)""",
        f"""trades{i} AS (SELECT '{name}' AS config_id, ticker, entry AS entry_date, end_date AS exit_date,
    coalesce(exit_reason, 'END_OF_BACKTEST') AS exit_reason, round(price, 2) AS entry_price, round(end_price, 2) AS exit_price,
    round(shares, 4) AS shares, round(shares * (end_price - price), 2) AS pnl, round((end_price - price) / price * 100, 2) AS return_pct,
    end_date - entry AS duration_days, k AS k_used FROM sold{i})""",
        f"""worth{i} AS (SELECT h.day, sum(h.shares * p.price) AS v FROM (SELECT day, unnest(held, max_depth := 2) FROM run{i}) h
  ASOF LEFT JOIN (SELECT ticker, date, price FROM ind) p ON p.ticker = h.ticker AND p.date <= h.day GROUP BY 1)""",
        f"""equity{i} AS (SELECT '{name}' AS config_id, r.day AS date, round(r.cash + coalesce(v, 0), 2) AS value, round(r.cash, 2) AS cash,
    len(r.held) AS n_positions FROM run{i} r LEFT JOIN worth{i} USING (day) WHERE r.w > 0)""",
        f"""weeks{i} AS (SELECT '{name}' AS config_id, r.day AS date, CASE WHEN n_free > 0 THEN
    (SELECT count(*) FROM pass{i} p WHERE p.calc_date = r.day AND NOT list_contains(list_transform(list_filter(r.held,
      lambda h: h.entry < r.day), lambda h: h.ticker), p.ticker)) ELSE 0 END AS n_eligible, n_free, n_bought FROM run{i} r WHERE r.w > 0)""",
        f"""ret{i} AS (SELECT *, value / lag(value) OVER (ORDER BY date) - 1 AS r, max(value) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak
  FROM equity{i})""",
        f"""measure{i} AS (SELECT '{name}' AS config_id, q.*, t.* FROM (SELECT round((arg_max(value, date) / 50000.0 - 1) * 100, 2) AS total_return_pct,
      arg_max(value, date) AS final_value, round(avg(n_positions), 1) AS avg_positions_held,
      CASE WHEN count(*) > 2 THEN round(avg(r) / (stddev_pop(r) + 1e-9) * sqrt(52), 3) ELSE 0.0 END AS sharpe,
      round(greatest(max((peak - value) / peak) * 100, 0), 2) AS max_drawdown_pct FROM ret{i}) q,
    (SELECT n_trades, win_rate_pct, avg_win_pct, avg_loss_pct, round(CASE WHEN avg_loss_pct <> 0 THEN abs(avg_win_pct / avg_loss_pct) ELSE 0 END, 2)
        AS profit_factor, avg_duration_days
      FROM (SELECT count(*) AS n_trades, round(coalesce(count(*) FILTER (return_pct > 0) * 100.0 / nullif(count(*), 0), 0), 1) AS win_rate_pct,
        round(coalesce(avg(return_pct) FILTER (return_pct > 0), 0), 2) AS avg_win_pct,
        round(coalesce(avg(return_pct) FILTER (return_pct <= 0), 0), 2) AS avg_loss_pct,
        round(coalesce(avg(duration_days) FILTER (duration_days > 0), 0), 1) AS avg_duration_days FROM trades{i})) t)""",
    ]


HYBRID = [IND, FORCE, INSTR, MACRO, *STATE, BACKTEST_DAYS]
BASE = HYBRID + _hybrid(0, "base", 5, 200, 0.0)
recursive("hybrid_trades", BASE, f"""SELECT config_id, ticker, {day('entry_date')}, {day('exit_date')}, exit_reason, entry_price, exit_price,
  shares, pnl, return_pct, duration_days, k_used FROM trades0""")
recursive("hybrid_equity", BASE, f"SELECT config_id, {day('date')}, value, cash, n_positions FROM equity0")
recursive("hybrid_weeks", BASE, f"SELECT config_id, {day('date')}, n_eligible, n_free, n_bought FROM weeks0")
recursive("hybrid_metrics", BASE, "SELECT * FROM measure0")
recursive("hybrid_exit_reasons", BASE, f"""SELECT config_id, exit_reason, count(*) AS n_trades, {g('avg(return_pct)', 6, 'avg_return_pct')},
  {g('count(*) FILTER (return_pct > 0) * 100.0 / count(*)', 6, 'win_rate_pct')} FROM trades0 GROUP BY 1, 2""")
recursive("weeks_held", BASE, """SELECT config_id, ticker, count(*) AS weeks_held FROM (
    SELECT 'base' AS config_id, unnest(held, max_depth := 2) FROM run0) GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY config_id ORDER BY weeks_held DESC, ticker) <= 20""")
GRID = [("sma_200", 200, 0.0), ("sma_150", 150, 0.0), ("mom_r2>0.0", 200, 0.0), ("mom_r2>0.01", 200, 0.01), ("mom_r2>0.05", 200, 0.05)]
recursive("config_compare", HYBRID + [x for i, (n, sma, least) in enumerate(GRID) for x in _hybrid(i, n, 5, sma, least)] + [
    "measured AS (" + " UNION ALL ".join(f"SELECT {i} AS place, * FROM measure{i}" for i in range(len(GRID))) + ")"],
    """SELECT * EXCLUDE (place), place = (SELECT place FROM measured ORDER BY sharpe DESC, place LIMIT 1) AS is_best FROM measured""")

# ---- positions ------------------------------------------------------------------------------

oracle("positions_computed", [POSITIONS], """SELECT id, CAST(invested AS DOUBLE) AS invested, CAST(result AS DOUBLE) AS result,
  result_pct FROM amounts""")
oracle("positions_open", [BARS, LAST, POSITIONS, _analysis("a", "bars")], f"""SELECT p.id, p.ticker, {day('buy_date')},
  CAST(buy_price AS DOUBLE) AS buy_price, CAST(invested AS DOUBLE) AS invested, CAST(quantity AS DOUBLE) AS quantity,
  l.adj_close AS price, CAST(round((CAST(l.adj_close AS DECIMAL(18, 4)) - buy_price) * quantity, 2) AS DOUBLE) AS pl,
  round(CAST(100 * (CAST(l.adj_close AS DECIMAL(18, 4)) - buy_price) AS DOUBLE) / CAST(buy_price AS DOUBLE), 2) AS pl_pct,
  d - p.buy_date AS days_held, CASE WHEN cnt >= 50 THEN floor(rsi_14 * 1e6 + 0.37) / 1e6 END AS rsi_14
  FROM amounts p LEFT JOIN (SELECT * FROM a WHERE (ticker, date) IN (SELECT ticker, max(date) FROM bars GROUP BY 1)) l
  ON l.ticker = p.ticker, last_day WHERE status = 'OUVERT'""")
EVALUATED = [IND, FORCE, INSTR, MACRO, FX, POSITIONS, """lastind AS (SELECT * FROM ind WHERE next_date IS NULL)""",
             _sector_ok("ls", "lastind", "date"),
             """mdate AS (SELECT min(x) AS upto FROM (SELECT zone, max(date) AS x FROM macro GROUP BY 1)),
regime AS (SELECT zone, arg_max(bull, date) AS macro_ok FROM macro, mdate WHERE date <= upto GROUP BY 1),
lastfx AS (SELECT currency, arg_max(rate, date) AS rate FROM fx GROUP BY 1),
pos0 AS (SELECT p.id, p.ticker, p.buy_date, CAST(p.buy_price AS DOUBLE) AS bp, CAST(p.quantity AS DOUBLE) AS q,
    CAST(round(p.quantity * p.buy_price, 2) AS DOUBLE) AS invested, CAST(p.invested_eur AS DOUBLE) AS invested_eur,
    p.quote_currency, l.date AS data_date, l.price AS now, l.atr_14 AS atr_now, l.sma_200, l.mom_r2, l.sector_ok,
    coalesce(r.macro_ok, TRUE) AS macro_ok, CASE WHEN p.quote_currency = 'EUR' THEN 1.0 ELSE lf.rate END AS rate_now,
    f.date AS first_bar, coalesce(f.atr_14, l.atr_14, 0) AS atr0
  FROM positions p LEFT JOIN ls l ON l.ticker = p.ticker LEFT JOIN regime r ON r.zone = l.z1
  LEFT JOIN lastfx lf ON lf.currency = p.quote_currency
  ASOF LEFT JOIN (SELECT * FROM ind) f ON f.ticker = p.ticker AND f.date >= p.buy_date WHERE p.status = 'OUVERT'),
pos1 AS (SELECT p.*, CASE WHEN first_bar IS NULL THEN 3.0 WHEN atr0 > 0 THEN greatest(2.0, least(4.0,
      round(2.0 + atr0 / bp * 100 * 0.5, 2))) ELSE 3.0 END AS k,
    CASE WHEN p.quote_currency = 'EUR' THEN 1.0 ELSE x.rate END AS rate_buy
  FROM pos0 p ASOF LEFT JOIN (SELECT * FROM fx) x ON x.currency = p.quote_currency AND x.date <= p.buy_date),
steps AS (SELECT p.id, b.date, b.price, coalesce(b.atr_14, p.atr0) AS a, p.bp, p.k,
    greatest(p.bp, max(b.price) OVER (PARTITION BY p.id ORDER BY b.date ROWS UNBOUNDED PRECEDING)) AS hi
  FROM pos1 p JOIN ind b ON b.ticker = p.ticker AND b.date >= p.buy_date),
stops AS (SELECT id, max(hi - k * a) AS s, max(hi) AS hi FROM steps GROUP BY 1),
ev0 AS (SELECT p.*, greatest(CASE WHEN atr0 > 0 THEN bp - k * atr0 ELSE 0 END, s.s) AS stop, greatest(bp, s.hi) AS max_price,
    round(now * q / rate_now, 2) AS value_eur, coalesce(invested_eur, round(invested / rate_buy, 2)) AS cost_eur
  FROM pos1 p LEFT JOIN stops s ON s.id = p.id),
ev1 AS (SELECT *, CASE WHEN now <= stop THEN 'VIOLATED' WHEN round((now - stop) / now * 100, 2) < 2 THEN 'WARNING' ELSE 'OK' END AS c_trailing_stop,
    CASE WHEN sma_200 IS NULL THEN 'NO_DATA' WHEN now < sma_200 THEN 'VIOLATED' WHEN round((now - sma_200) / sma_200 * 100, 2) < 3
      THEN 'WARNING' ELSE 'OK' END AS c_trend_sma200,
    CASE WHEN mom_r2 IS NULL THEN 'NO_DATA' WHEN mom_r2 < 0 THEN 'VIOLATED' WHEN mom_r2 < 0.05 THEN 'WARNING' ELSE 'OK' END AS c_momentum_r2,
    CASE WHEN sector_ok THEN 'OK' ELSE 'VIOLATED' END AS c_sector, CASE WHEN macro_ok THEN 'OK' ELSE 'VIOLATED' END AS c_macro FROM ev0),
ev2 AS (SELECT *, """ + ", ".join(f"""list_filter([CASE WHEN c_trailing_stop = '{s}' THEN 'trailing_stop' END,
    CASE WHEN c_trend_sma200 = '{s}' THEN 'trend_sma200' END, CASE WHEN c_momentum_r2 = '{s}' THEN 'momentum_r2' END,
    CASE WHEN c_sector = '{s}' THEN 'sector' END, CASE WHEN c_macro = '{s}' THEN 'macro' END],
    lambda x: x IS NOT NULL) AS {n}""" for s, n in (("VIOLATED", "violated"), ("WARNING", "warnings"))) + """ FROM ev1),
evaluated AS (SELECT *, CASE WHEN len(violated) > 0 THEN 'SORTIE_RECOMMANDÉE' WHEN len(warnings) > 0 THEN 'VIGILANCE'
    ELSE 'SAIN' END AS alert FROM ev2)"""]
oracle("position_eval", EVALUATED, f"""SELECT id, ticker, {day('data_date')}, {g('k', 2)}, {g('round(e.stop, 2)', 2, 'stop')},
  round(max_price, 2) AS max_price, {g('round((now - bp) / bp * 100, 2)', 2, 'pnl_pct')},
  {g('round((now - bp) * q, 2)', 2, 'pnl_quote')}, {g('e.value_eur', 2, 'value_eur')},
  {g('round(e.value_eur - cost_eur, 2)', 2, 'pnl_eur')}, e.data_date - e.buy_date AS days_held, c_trailing_stop,
  c_trend_sma200, c_momentum_r2, c_sector, c_macro, array_to_string(e.violated, ',') AS violated,
  array_to_string(e.warnings, ',') AS warnings, alert FROM evaluated e""")
oracle("evaluation_rollup", EVALUATED, """SELECT count(*) AS n_positions, count(*) FILTER (alert = 'SORTIE_RECOMMANDÉE') AS n_exit,
  count(*) FILTER (alert = 'VIGILANCE') AS n_watch, count(*) FILTER (alert = 'SAIN') AS n_sound FROM evaluated""")


def _priced(name: str, source: str, quote: str, on: str) -> str:
    return f"""{name} AS (SELECT e.*, e.currency <> {quote} AS is_foreign, CASE WHEN e.currency <> {quote} THEN
    round(CAST(e.price AS DOUBLE) * CASE WHEN {quote} = 'EUR' THEN 1.0 ELSE fq.rate END / fi.rate, 4)
    ELSE CAST(e.price AS DOUBLE) END AS quoted
  FROM {source} e ASOF LEFT JOIN (SELECT * FROM fx) fi ON fi.currency = e.currency AND fi.date <= e.{on}
  ASOF LEFT JOIN (SELECT * FROM fx) fq ON fq.currency = {quote} AND fq.date <= e.{on})"""


oracle("position_events", [
    FX, POSITIONS, EVENTS, "good AS (SELECT * FROM checked WHERE len(reasons) = 0)",
    """opens AS (SELECT g.*, list_extract(['EUR', 'USD', 'CHF', 'SEK'], CAST(substr(g.ticker, 7) AS INTEGER) % 4 + 1) AS quote
  FROM good g WHERE kind = 'open')""", _priced("op1", "opens", "e.quote", "event_date"),
    _priced("cl1", "(SELECT * FROM good WHERE kind = 'close')", "e.quote_currency", "event_date"),
    """closing AS (SELECT * FROM cl1 WHERE quoted IS NOT NULL QUALIFY row_number() OVER (PARTITION BY position_id
    ORDER BY event_time, event_id) = 1)""",
    """ed0 AS (SELECT g.* FROM good g LEFT JOIN closing c ON c.position_id = g.position_id WHERE g.kind = 'edit'
  AND (c.event_id IS NULL OR (g.event_time, g.event_id) < (c.event_time, c.event_id)))""",
    _priced("ed1", "(SELECT * FROM ed0 WHERE event_date IS NOT NULL)", "e.quote_currency", "event_date"),
    "dated AS (SELECT * FROM ed1 WHERE price IS NULL OR quoted IS NOT NULL)",
    """undated AS (SELECT u.*, coalesce((SELECT d.event_date FROM dated d WHERE d.position_id = u.position_id
    AND (d.event_time, d.event_id) <= (u.event_time, u.event_id) ORDER BY d.event_time DESC, d.event_id DESC LIMIT 1), u.buy_date) AS eff
  FROM ed0 u WHERE u.event_date IS NULL)""", _priced("ud1", "undated", "e.quote_currency", "eff"),
    """edits AS (SELECT position_id, event_time, event_id, price, quoted, is_foreign, currency, quantity, event_date FROM dated
  UNION ALL SELECT position_id, event_time, event_id, price, quoted, is_foreign, currency, quantity, event_date FROM ud1
  WHERE price IS NULL OR quoted IS NOT NULL)""",
    """changed AS (SELECT position_id, arg_max(quoted, ROW(event_time, event_id)) FILTER (price IS NOT NULL) AS buy_price,
    arg_max(price, ROW(event_time, event_id)) FILTER (price IS NOT NULL AND is_foreign) AS txn_price,
    arg_max(currency, ROW(event_time, event_id)) FILTER (price IS NOT NULL AND is_foreign) AS txn_currency,
    arg_max(quantity, ROW(event_time, event_id)) FILTER (quantity IS NOT NULL) AS quantity,
    arg_max(event_date, ROW(event_time, event_id)) FILTER (event_date IS NOT NULL) AS buy_date FROM edits GROUP BY 1)"""],
    f"""SELECT p.id, p.ticker, CAST(coalesce(c.buy_date, p.buy_date) AS VARCHAR) AS buy_date,
  {g('coalesce(c.buy_price, CAST(p.buy_price AS DOUBLE))', 3, 'buy_price')},
  CAST(coalesce(c.quantity, p.quantity) AS DOUBLE) AS quantity,
  CASE WHEN x.position_id IS NOT NULL THEN 'FERMÉ' ELSE p.status END AS status,
  CAST(coalesce(x.event_date, p.sell_date) AS VARCHAR) AS sell_date,
  {g('coalesce(x.quoted, CAST(p.sell_price AS DOUBLE))', 3, 'sell_price')}, coalesce(x.reason, p.sell_reason) AS sell_reason,
  p.portfolio_id, p.quote_currency, CAST(c.txn_price AS DOUBLE) AS txn_price, c.txn_currency
  FROM positions p LEFT JOIN changed c ON c.position_id = p.id LEFT JOIN closing x ON x.position_id = p.id
  UNION ALL SELECT -event_id, ticker, CAST(event_date AS VARCHAR), floor(quoted * 1e3 + 0.37) / 1e3, CAST(quantity AS DOUBLE),
  'OUVERT', NULL, NULL, NULL, portfolio_id, quote, CASE WHEN is_foreign THEN CAST(price AS DOUBLE) END,
  CASE WHEN is_foreign THEN currency END FROM op1 WHERE quoted IS NOT NULL""")

# ---- texts ----------------------------------------------------------------------------------

GAP = r"[^\pL\pN]"
WS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || ' ' || chr(133) || chr(160) || chr(12288)"


def _pick(n: int, key: str, *options: str) -> str:
    quoted = ", ".join("'" + o.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for o in options)
    return f"list_extract([{quoted}], {key} % {n} + 1)"


TEXTS = "texts AS (SELECT doc_id, " + " || ".join([
    _pick(9, "doc_id", "", "CONVICTION : FORT\n", "conviction **modéré**\n", "CONVICTION — VENDRE\n", "CONVICTION: x FORT\n",
          "Conviction : 🟢 GARDER ; CONVICTION FAIBLE\n", "CONVICTION MODERE\n", "CONVICTION_RENFORCER\n",
          "CONVICTION : INSUFFISANT\n"),
    _pick(5, "doc_id", "", "RISQUE ÉVÉNEMENTIEL : OUI\n", "risque  événementiel - non\n",
          "RISQUE ÉVÉNEMENTIEL EARNINGS NON TROUVÉ\n", "RISQUE ÉVÉNEMENTIEL: peut-être\n"), "text",
    _pick(6, "doc_id", "", "\nRÉSUMÉ :\n\n  un deux \ntrois\nPOUR x", "\nRESUME: court", "\nRÉSUMÉ: **gras**",
          "\nRÉSUMÉ :POUR\nRESUME : repli", "\nRÉSUMÉ : fin\nCONCLUSION")]) + " AS text FROM documents)"


def _stated(text: str) -> str:
    rules = " ".join(f"WHEN regexp_matches(upper({text}), 'CONVICTION{GAP}{{0,30}}?{w}') THEN '{v}'" for w, v in (
        ("GARDER", "GARDER"), ("VENDRE", "VENDRE"), ("RENFORCER", "RENFORCER"), ("INSUFFISANT", "INSUFFISANT"),
        ("FORT", "FORT"), ("FAIBLE", "FAIBLE"), ("MODÉRÉ", "MODÉRÉ"), ("MODERE", "MODÉRÉ")))
    return f"CASE {rules} END"


def _risk(text: str) -> str:
    pattern = rf"(?i)RISQUE\s+ÉVÉNEMENTIEL{GAP}{{0,10}}(OUI|NON|EARNINGS NON TROUVÉ)"
    return f"CASE upper(regexp_extract({text}, '{pattern}', 1)) WHEN 'OUI' THEN TRUE WHEN 'NON' THEN FALSE END"


def _summary(name: str, source: str, key: str) -> str:
    """Summaries line by line: first marker with any kept line."""
    return f"""{name} AS (
  SELECT {key}, arg_min(s, place) AS summary FROM (
    SELECT {key}, place, string_agg(line, ' ' ORDER BY i) AS s FROM (
      SELECT *, min(CASE WHEN stop THEN i END) OVER (PARTITION BY {key}, place) AS cut FROM (
        SELECT {key}, place, i, trim(lines[i], {WS}) AS line, regexp_matches(trim(lines[i], {WS}),
            '^(ANALYSE|\\*\\*|POUR|CONTRE|CONCLUSION)') AS stop
        FROM (SELECT {key}, place, string_split(trim(substr(text, instr(text, marker) + length(marker)), {WS}), chr(10)) AS lines
          FROM {source}, (VALUES (1, 'RÉSUMÉ :'), (2, 'RÉSUMÉ:'), (3, 'RESUME :'), (4, 'RESUME:')) m(place, marker)
          WHERE contains(text, marker)) q, unnest(range(1, len(lines) + 1)) u(i)))
    WHERE line <> '' AND (cut IS NULL OR i < cut) GROUP BY {key}, place)
  GROUP BY {key})"""


oracle("extract_conviction", [TEXTS], f"""SELECT doc_id, coalesce({_stated('text')}, 'MODÉRÉ') AS conviction,
  {_stated('text')} IS NULL AS is_default FROM texts""")
oracle("extract_event_risk", [TEXTS], f"SELECT doc_id, {_risk('text')} AS event_risk FROM texts")
oracle("extract_summary", [TEXTS, _summary("sums", "texts", "doc_id")],
       "SELECT doc_id, coalesce(summary, '') AS summary, substr(coalesce(summary, ''), 1, 500) AS summary_shown FROM texts LEFT JOIN sums USING (doc_id)")
oracle("extract_conversations", ["conv AS (SELECT conv_id * 100000 + turn AS key, * FROM conversations)",
                                 _summary("sums", "conv", "key")],
       f"""SELECT conv_id, turn, coalesce({_stated('text')}, 'MODÉRÉ') AS conviction, {_stated('text')} IS NULL AS is_default,
  {_risk('text')} AS event_risk, coalesce(summary, '') AS summary FROM conv LEFT JOIN sums USING (key)""")
LOTS = r"""docs AS (SELECT doc_id, doc_id // 5 AS batch_id, text,
    CASE WHEN doc_id % 5 = 3 THEN lpad(CAST(doc_id AS VARCHAR), 6, '0') || '.KS' ELSE 'T' || doc_id END AS ticker FROM documents),
sections AS (SELECT *, '=== TICKER : ' || CASE WHEN doc_id % 5 = 1 THEN 'Société (' || ticker || ')'
    WHEN doc_id % 5 = 3 THEN CAST(doc_id AS VARCHAR) WHEN doc_id % 10 = 4 THEN 'inconnu' ELSE ticker END || ' ===' || chr(10) ||
  """ + _pick(7, "doc_id", "CONVICTION : **FORT**", "## Conviction — 🟡 modéré", "CONVICTION: FAIBLE", "CONVICTION : INSUFFISANT",
              "Conviction : (garder)", "pas de mot", "CONVICTION VENDRE") + \
    " || chr(10) || 'RISQUE ÉVÉNEMENTIEL : ' || " + _pick(4, "doc_id", "OUI", "non", "EARNINGS NON TROUVÉ", "?") + \
    """ || chr(10) || 'RÉSUMÉ : ' || text || chr(10) || 'POUR : hausse' || chr(10) || 'CONTRE : baisse' || chr(10) AS section FROM docs),
lots AS (SELECT batch_id, list(ticker ORDER BY doc_id) AS expected,
    'LECTURE DU LOT : le classement suit.' || chr(10) || CASE WHEN batch_id % 4 = 3 THEN '' ELSE chr(10) || '**CLASSEMENT** : '
      || string_agg(ticker, ' > ' ORDER BY doc_id DESC) || chr(10) END || string_agg(section, chr(10) ORDER BY doc_id) AS text
  FROM sections GROUP BY 1)"""
PARSED = LOTS + rf""",
parts AS (SELECT batch_id, expected, text, regexp_split_to_array(text, '===\s*TICKER\s*:\s*') AS p FROM lots),
sec0 AS (SELECT batch_id, expected, i AS pos, p[i] AS part FROM parts, unnest(range(2, len(p) + 1)) u(i)),
sec1 AS (SELECT *, upper(trim(CASE WHEN contains(part, '===') THEN split_part(part, '===', 1) ELSE split_part(part, chr(10), 1) END, {WS})) AS head,
    trim(CASE WHEN contains(part, '===') THEN substr(part, instr(part, '===') + 3) WHEN contains(part, chr(10))
      THEN substr(part, instr(part, chr(10)) + 1) ELSE '' END, {WS}) AS body FROM sec0),
sec2 AS (SELECT *, CASE WHEN list_contains(expected, regexp_extract(head, '^([A-Z0-9.\-]+)', 1)) THEN regexp_extract(head, '^([A-Z0-9.\-]+)', 1)
      ELSE coalesce(list_filter(expected, lambda t: contains(head, t))[1], list_filter(expected, lambda t: contains(
        ltrim(regexp_replace(regexp_replace(head, '[^A-Z0-9.]', '', 'g'), '\.(KS|KQ)', '', 'g'), '0'),
        ltrim(regexp_replace(t, '\.(KS|KQ)', '', 'g'), '0')))[1]) END AS ticker FROM sec1),
parsed AS (SELECT batch_id, ticker, arg_max(body, pos) AS text, min(pos) AS pos FROM sec2 WHERE ticker IS NOT NULL GROUP BY 1, 2),
head AS (SELECT batch_id, expected, CASE WHEN regexp_matches(text, '(?ims)LECTURE DU LOT{GAP}{{0,10}}(.*?)[\n\r]+{GAP}{{0,5}}CLASSEMENT')
      THEN trim(regexp_extract(text, '(?is)LECTURE DU LOT{GAP}{{0,10}}(.*?)[\n\r]+{GAP}{{0,5}}CLASSEMENT', 1), {WS}) END AS lot_reading,
    CASE WHEN regexp_matches(text, '(?im)^{GAP}{{0,5}}CLASSEMENT{GAP}{{0,10}}([^\n]+)')
      THEN regexp_extract(text, '(?im)^{GAP}{{0,5}}CLASSEMENT{GAP}{{0,10}}([^\n]+)', 1) END AS line FROM lots),
named AS (SELECT batch_id, list_distinct_ordered AS names, lot_reading, trim(line, {WS}) AS order_line FROM (
    SELECT *, list_filter(regexp_extract_all(upper(coalesce(line, '')), '[A-Z0-9][A-Z0-9.\-]{{0,14}}'),
      lambda t: list_contains(expected, t)) AS list_distinct_ordered FROM head))"""
oracle("extract_sections", [PARSED, _summary("sums", "(SELECT *, batch_id || '/' || ticker AS key FROM parsed)", "key")],
       f"""SELECT p.batch_id, p.ticker, CASE WHEN len(names) > 0 THEN nullif(list_position(names, p.ticker), 0)
    ELSE row_number() OVER (PARTITION BY p.batch_id ORDER BY p.pos) END AS ai_rank,
  coalesce({_stated('p.text')}, 'MODÉRÉ') AS conviction, {_stated('p.text')} IS NULL AS is_default,
  {_risk('p.text')} AS event_risk, coalesce(s.summary, '') AS summary, length(p.text) AS n_chars, lot_reading, order_line, substr(lot_reading, 1, 2000) AS reading_shown, substr(order_line, 1, 200) AS order_shown
  FROM parsed p JOIN named n USING (batch_id) LEFT JOIN sums s ON s.key = p.batch_id || '/' || p.ticker""")
oracle("parse_outcome", [PARSED, """got AS (SELECT batch_id, list(ticker) AS tickers FROM parsed GROUP BY 1),
outcome AS (SELECT l.batch_id, coalesce(len(tickers), 0) AS n_parsed, len(expected) AS n_expected,
    array_to_string(list_filter(expected, lambda t: NOT list_contains(coalesce(tickers, []), t)), ', ') AS lacking
  FROM lots l LEFT JOIN got g ON g.batch_id = l.batch_id)"""],
       """SELECT batch_id, n_parsed, n_expected, replace(lacking, ', ', ',') AS missing,
  CASE WHEN n_parsed = 0 THEN 'ERREUR' ELSE 'TERMINÉ' END AS status,
  CASE WHEN n_parsed = 0 THEN 'parse: 0/' || n_expected || ' section exploitable' WHEN lacking <> ''
    THEN 'partiel : ' || n_parsed || '/' || n_expected || ' — manquants : ' || lacking END AS note FROM outcome""")

# ---- learning -------------------------------------------------------------------------------

recursive("ml_dataset", FULL_SIGNALS + [
    "raw AS (SELECT ticker, seq FROM sg WHERE breakout AND rvol_high)", _thinned("kept", "raw"), LABEL,
    _analysis("a", "bars"),
    """rows0 AS (SELECT a.*, l.target, i.sector, i.pe_ratio, CASE WHEN k.seq IS NULL THEN 0.0 ELSE 1.0 END AS signal
  FROM a JOIN label l ON l.ticker = a.ticker AND l.date = a.date JOIN instr i ON i.ticker = a.ticker
  LEFT JOIN sg s ON s.ticker = a.ticker AND s.date = a.date LEFT JOIN kept k ON k.ticker = s.ticker AND k.seq = s.seq
  WHERE l.target IS NOT NULL AND a.rsi_14 IS NOT NULL AND a.cnt >= 50),
rows1 AS (SELECT *, row_number() OVER (ORDER BY date, md5(ticker), ticker) - 1 AS idx, count(*) OVER () AS n,
    (SELECT median(pe_ratio) FROM rows0) AS med FROM rows0)"""],
    f"SELECT ticker, {day('date')}, idx, " + g(
        "exp(idx / (n - 1)) * CASE WHEN signal = 1 THEN 5 ELSE 1 END", 6, "weight") +
    f""", CAST(target AS DOUBLE) AS target, signal, coalesce(pe_ratio, med) AS pe_ratio,
  {g('coalesce(r.vol_ratio, 1)', 6, 'vol_ratio')}, {g('coalesce(r.bb_position, 0)', 6, 'bb_position')}, """ +
    "SECTOR_COLUMNS, CASE WHEN regime = 'BULL' THEN 1.0 ELSE 0.0 END AS \"regime_BULL\", "
    "CASE WHEN regime = 'BEAR' THEN 1.0 ELSE 0.0 END AS \"regime_BEAR\", "
    "CASE WHEN regime = 'NEUTRE' THEN 1.0 ELSE 0.0 END AS \"regime_NEUTRE\" FROM rows1 r")
ORACLES["ml_folds"] = ORACLES["ml_dataset"][: ORACLES["ml_dataset"].index("SELECT ticker, CAST(date AS VARCHAR) AS date, idx, ")] + f"""SELECT fold, n - (5 - fold) * (n // 6) AS n_train,
  n // 6 AS n_test, count(*) FILTER (idx < n - (5 - fold) * (n // 6)) AS trained, count(*) FILTER (idx >= n - (5 - fold) * (n // 6)) AS tested,
  {day('max(date) FILTER (idx < n - (5 - fold) * (n // 6))', 'train_until')}, {day('min(date) FILTER (idx >= n - (5 - fold) * (n // 6))', 'test_from')},
  {day('max(date)', 'test_until')} FROM rows1, (SELECT unnest(range(5)) AS fold) f WHERE idx < n - (5 - fold) * (n // 6) + n // 6 GROUP BY fold, n"""
ORACLES["ml_dataset"] = ORACLES["ml_dataset"].replace("SECTOR_COLUMNS", ", ".join(
    f"CASE WHEN coalesce(sector, 'INCONNU') = '{s}' THEN 1.0 ELSE 0.0 END AS \"sector_{s.replace(' ', '_')}\""
    for s in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST", "INCONNU")))

_SECTORS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
oracle("ml_encoded", [BARS, INSTR, LAST, _analysis("a", "bars")], f"""SELECT ticker, {day('date')}, """ + ", ".join(
    [f"CASE WHEN sector = '{s}' THEN 1.0 ELSE 0.0 END::DOUBLE AS sector_{s.replace(' ', '_')}" for s in _SECTORS]
    + ["CASE WHEN sector IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS sector_INCONNU"]
    + [f"CASE WHEN {c} THEN 1.0 ELSE 0.0 END::DOUBLE AS regime_{n}" for n, c in (
        ("BULL", "regime IN ('HAUSSIER', 'BULL')"), ("BEAR", "regime IN ('BAISSIER', 'BEAR')"),
        ("NEUTRE", "regime IS NULL OR regime NOT IN ('HAUSSIER', 'BULL', 'BAISSIER', 'BEAR')"))])
       + " FROM a LEFT JOIN (SELECT ticker, sector FROM instr) USING (ticker), last_day WHERE date >= last_day.d - 5")
