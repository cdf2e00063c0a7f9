"""DuckDB SQL that states, independently of Spark, what each registered
query must return.  Views over the given tables (region … conversations)
are pre-registered by the checker; derived inputs are CTEs whose text
matches :mod:`tessera.plans.fixtures`.
"""

from __future__ import annotations

DIRTY_ORDERS = """
dirty_orders AS (
  SELECT o_orderkey,
         CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price,
         CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN 'nan'
              ELSE concat('  ', o_orderpriority, ' ') END AS prio,
         substr(CAST(o_orderdate AS VARCHAR), 1, 10) AS d,
         CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate END AS dt,
         CAST(NULL AS DOUBLE) AS empty_col
  FROM orders
  UNION ALL
  SELECT o_orderkey,
         CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END,
         CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN 'nan'
              ELSE concat('  ', o_orderpriority, ' ') END,
         substr(CAST(o_orderdate AS VARCHAR), 1, 10),
         CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate END,
         CAST(NULL AS DOUBLE)
  FROM orders WHERE o_orderkey % 17 = 0
)"""

SCORED_EVENTS = """
scored_events AS (
  SELECT event_id, value AS actual,
         value * CAST(0.9 AS DOUBLE) + CAST(user_id % 10 AS DOUBLE) AS predicted,
         CASE WHEN value > 50 THEN 1 ELSE 0 END AS label,
         CAST(user_id % 20 AS DOUBLE) / CAST(20 AS DOUBLE) AS score
  FROM events
)"""

# (l_orderkey, l_linenumber) repeats in the given data; these four identify a row
LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LINEITEM_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                    "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
DIRTY_COLUMNS = [("o_orderkey", "bigint"), ("price", "double"), ("prio", "string"),
                 ("d", "string"), ("dt", "timestamp"), ("empty_col", "double")]
EVENTS_COLUMNS = [("event_id", "bigint"), ("ts", "timestamp"), ("user_id", "bigint"),
                  ("event_type", "string"), ("value", "double"), ("props", "string")]


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" if ctes else ""


def union_all(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def _d(c: str) -> str:
    return f"CAST({c} AS DOUBLE)"


def column_statistics_sql(table: str, cols: list[str], prefix: str = "") -> str:
    parts = []
    for c in cols:
        x = _d(c)
        parts.append(
            f"SELECT '{c}' AS column_name, avg({x}) AS mean, quantile_cont({x}, 0.5) AS median, "
            f"stddev_samp({x}) AS std, min({x}) AS min_val, max({x}) AS max_val, "
            f"skewness({x}) AS skewness, kurtosis({x}) AS kurtosis, "
            f"count(*) - count({c}) AS null_count, "
            f"100.0 * CAST(count(*) - count({c}) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS null_pct "
            f"FROM {table}")
    return prefix + union_all(parts)


def missing_sql(table: str, cols: list[tuple[str, str]], prefix: str = "", only_missing: bool = False) -> str:
    parts = []
    for c, t in cols:
        dtype = "" if only_missing else f", '{t}' AS dtype"
        parts.append(
            f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing_count, "
            f"100.0 * CAST(count(*) - count({c}) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS missing_pct{dtype} "
            f"FROM {table}")
    body = union_all(parts)
    if only_missing:
        body = f"SELECT * FROM ({body}) WHERE missing_count > 0"
    return prefix + body


def dtype_report_sql(table: str, cols: list[tuple[str, str]], order_by: str) -> str:
    parts = []
    for c, t in cols:
        parts.append(
            f"SELECT '{c}' AS column_name, '{t}' AS dtype, count({c}) AS non_null, "
            f"count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS unique_values, "
            f"coalesce(CAST(arg_min({c}, {order_by}) AS VARCHAR), '') AS sample_value FROM {table}")
    return union_all(parts)


def describe_sql(table: str, num: list[str], cat: list[str]) -> str:
    parts = []
    for c in num:
        x = _d(c)
        parts.append(
            f"SELECT '{c}' AS column_name, count({c}) AS \"count\", CAST(NULL AS BIGINT) AS \"unique\", "
            f"CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq, avg({x}) AS mean, "
            f"stddev_samp({x}) AS std, min({x}) AS \"min\", quantile_cont({x}, 0.25) AS q25, "
            f"quantile_cont({x}, 0.5) AS q50, quantile_cont({x}, 0.75) AS q75, max({x}) AS \"max\" FROM {table}")
    for c in cat:
        top = (f"(SELECT {c} FROM {table} WHERE {c} IS NOT NULL GROUP BY {c} "
               f"ORDER BY count(*) DESC, {c} LIMIT 1)")
        freq = (f"(SELECT count(*) FROM {table} WHERE {c} IS NOT NULL GROUP BY {c} "
                f"ORDER BY count(*) DESC, {c} LIMIT 1)")
        nulls = ", ".join(f"CAST(NULL AS DOUBLE) AS {a}" for a in ("mean", "std", '"min"', "q25", "q50", "q75", '"max"'))
        parts.append(
            f"SELECT '{c}' AS column_name, count({c}) AS \"count\", count(DISTINCT {c}) AS \"unique\", "
            f"{top} AS top, {freq} AS freq, {nulls} FROM {table}")
    return union_all(parts)


def dataset_summary_sql(table: str, cols: list[str], n_num: int, n_cat: int, n_dt: int, prefix: str = "") -> str:
    miss = " + ".join(f"(count(*) - count({c}))" for c in cols)
    return prefix + (
        f"SELECT CAST(count(*) AS BIGINT) AS row_count, CAST({len(cols)} AS BIGINT) AS column_count, "
        f"CAST({miss} AS BIGINT) AS missing_values, "
        f"CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {table})) AS BIGINT) AS duplicate_rows, "
        f"CAST({n_num} AS BIGINT) AS numeric_columns, CAST({n_cat} AS BIGINT) AS categorical_columns, "
        f"CAST({n_dt} AS BIGINT) AS datetime_columns FROM {table}")


def profile_sql() -> dict[str, str]:
    dirty = with_(DIRTY_ORDERS)
    return {
        "column_statistics": column_statistics_sql("lineitem", LINEITEM_NUMERIC),
        "dataset_summary": dataset_summary_sql("dirty_orders", [c for c, _ in DIRTY_COLUMNS], 3, 2, 1, dirty),
        "missing_summary": missing_sql("dirty_orders", DIRTY_COLUMNS, dirty),
        "missing_report": missing_sql("dirty_orders", DIRTY_COLUMNS, dirty, only_missing=True),
        "dtype_report": dtype_report_sql("events", EVENTS_COLUMNS, "event_id"),
        "describe": describe_sql("customer", ["c_custkey", "c_nationkey", "c_acctbal"], ["c_name", "c_mktsegment"]),
    }


# ---------------------------------------------------------------------------
# relations and chart data
# ---------------------------------------------------------------------------
def correlation_sql(table: str, cols: list[str]) -> str:
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            parts.append(f"SELECT '{a}' AS col1, '{b}' AS col2, corr({_d(a)}, {_d(b)}) AS correlation FROM {table}")
    return union_all(parts)


def _bin_sql(x: str, n: int) -> str:
    """numpy bin index of x given lo/hi/step columns in scope (see relations.bin_index)."""
    def edge(k: str) -> str:
        return f"(CASE WHEN {k} >= {n} THEN hi ELSE {k} * step + lo END)"
    i0 = f"least(CAST(floor(({x} - lo) * (CAST({n} AS DOUBLE) / (hi - lo))) AS INTEGER), {n - 1})"
    i1 = f"(CASE WHEN {x} < {edge('i0')} THEN i0 - 1 ELSE i0 END)"
    i2 = f"(CASE WHEN i1 <> {n - 1} AND {x} >= {edge('(i1 + 1)')} THEN i1 + 1 ELSE i1 END)"
    return i0, i1, i2


def _bounds_cte(name: str, table: str, x: str, n: int) -> str:
    return (f"{name} AS (SELECT lo, hi, (hi - lo) / CAST({n} AS DOUBLE) AS step FROM ("
            f"SELECT CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS lo, "
            f"CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS hi FROM ("
            f"SELECT min({x}) AS mn, max({x}) AS mx FROM {table})))")


def _binned(table: str, x: str, bounds: str, n: int, keep: str = "") -> str:
    i0, i1, i2 = _bin_sql("x", n)
    keep_sel = f"{keep}, " if keep else ""
    return (f"SELECT {keep_sel}{i2} AS bin FROM (SELECT {keep_sel}x, lo, hi, step, {i1} AS i1 FROM ("
            f"SELECT {keep_sel}x, lo, hi, step, {i0} AS i0 FROM (SELECT {keep_sel}{x} AS x FROM {table} "
            f"WHERE {x} IS NOT NULL), {bounds}))")


def distribution_sql(table: str, cols: list[str], n: int = 10) -> str:
    parts = []
    for k, c in enumerate(cols):
        x = _d(c)
        b = f"bd{k}"
        grid = (f"SELECT i, i * step + lo AS e0, CASE WHEN i = {n - 1} THEN hi ELSE (i + 1) * step + lo END AS e1 "
                f"FROM range({n}) t(i), {b}")
        counts = f"SELECT bin, count(*) AS cnt FROM ({_binned(table, x, b, n)}) GROUP BY bin"
        parts.append(
            f"SELECT '{c.lower()}' AS column_name, e0 AS bin_start, e1 AS bin_end, "
            f"printf('%.2f – %.2f', e0, e1) AS bin_label, CAST(coalesce(cnt, 0) AS BIGINT) AS \"count\" "
            f"FROM ({grid}) g LEFT JOIN ({counts}) h ON g.i = h.bin")
    ctes = ",\n".join(_bounds_cte(f"bd{k}", table, _d(c), n) for k, c in enumerate(cols))
    return f"WITH {ctes}\n" + union_all(parts)


def box_stats_sql(table: str, value: str, group: str) -> str:
    return f"""
WITH q AS (
  SELECT {group}, count(*) AS n, quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.5) AS median,
         quantile_cont({value}, 0.75) AS q3
  FROM {table} WHERE {group} IS NOT NULL AND {value} IS NOT NULL GROUP BY {group}),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM q)
SELECT f.{group}, f.n, min(t.{value}) AS "min", f.q1, f.median, f.q3, max(t.{value}) AS "max",
       f.lower_fence, f.upper_fence,
       min(CASE WHEN t.{value} >= f.lower_fence AND t.{value} <= f.upper_fence THEN t.{value} END) AS whisker_low,
       max(CASE WHEN t.{value} >= f.lower_fence AND t.{value} <= f.upper_fence THEN t.{value} END) AS whisker_high,
       CAST(sum(CASE WHEN t.{value} < f.lower_fence OR t.{value} > f.upper_fence THEN 1 ELSE 0 END) AS BIGINT) AS outliers
FROM {table} t JOIN f ON t.{group} = f.{group} WHERE t.{value} IS NOT NULL
GROUP BY f.{group}, f.n, f.q1, f.median, f.q3, f.lower_fence, f.upper_fence"""


def violin_sql(table: str, value: str, group: str, n: int = 20) -> str:
    x = _d(value)
    binned = _binned(table, x, "bd", n, keep=group)
    return f"""
WITH {_bounds_cte('bd', table, x, n)},
c AS (SELECT {group}, bin, count(*) AS cnt FROM ({binned}) WHERE {group} IS NOT NULL GROUP BY {group}, bin),
e AS (SELECT c.*, bin * step + lo AS e0, CASE WHEN bin = {n - 1} THEN hi ELSE (bin + 1) * step + lo END AS e1 FROM c, bd)
SELECT {group}, CAST(bin AS INTEGER) AS bin, e0 AS bin_start, e1 AS bin_end, CAST(cnt AS BIGINT) AS "count",
       cnt / (sum(cnt) OVER (PARTITION BY {group}) * (e1 - e0)) AS density FROM e"""


def md5_bucket_sql(keys: list[str], seed: int = 42) -> str:
    text = " || '|' || ".join([f"'{seed}'"] + [f"CAST({k} AS VARCHAR)" for k in keys])
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"


def sample_sql(table: str, keys: list[str], n: int, select: str = "*") -> str:
    order = ", ".join(["_h"] + keys)
    return (f"SELECT {select} FROM (SELECT *, {md5_bucket_sql(keys)} AS _h FROM {table}) "
            f"ORDER BY {order} LIMIT {n}")


def missing_matrix_sql(table: str, keys: list[str], cols: list[str], n: int, prefix: str) -> str:
    flags = ", ".join(f"CAST({c} IS NULL AS INTEGER) AS {c}_missing" for c in cols)
    inner = sample_sql(table, keys, n)
    return prefix + f"SELECT {', '.join(keys)}, {flags} FROM ({inner})"


def chart_sql() -> dict[str, str]:
    dirty = with_(DIRTY_ORDERS)
    return {
        "correlation_matrix": correlation_sql("lineitem", LINEITEM_NUMERIC),
        "data_distribution": distribution_sql("lineitem", LINEITEM_NUMERIC, 10),
        "value_counts_topn": ("SELECT p_brand, count(*) AS \"count\" FROM part WHERE p_brand IS NOT NULL "
                              "GROUP BY p_brand ORDER BY \"count\" DESC, p_brand LIMIT 20"),
        "grouped_agg": ("SELECT o_orderpriority, avg(o_totalprice) AS o_totalprice FROM orders "
                        "WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority"),
        "trend_line": ("SELECT o_orderdate, o_orderstatus, avg(o_totalprice) AS o_totalprice FROM orders "
                       "WHERE o_orderdate IS NOT NULL AND o_orderstatus IS NOT NULL GROUP BY ALL"),
        "pie_share": ("WITH t AS (SELECT p_type, sum(p_retailprice) AS amount FROM part WHERE p_type IS NOT NULL "
                      "GROUP BY p_type ORDER BY amount DESC, p_type LIMIT 10) "
                      "SELECT p_type, amount, amount / (SELECT sum(amount) FROM t) AS share FROM t"),
        "box_stats": box_stats_sql("events", "value", "event_type"),
        "violin_density": violin_sql("events", "value", "event_type", 20),
        "ols_trend": ("SELECT regr_slope(l_extendedprice, l_quantity) AS slope, "
                      "regr_intercept(l_extendedprice, l_quantity) AS intercept, "
                      "regr_r2(l_extendedprice, l_quantity) AS r2, "
                      "CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n FROM lineitem"),
        "sample_rows": sample_sql("lineitem", LINE_KEYS, 5000, select="* EXCLUDE (_h)"),
        "missing_matrix": missing_matrix_sql("dirty_orders", ["o_orderkey"], [c for c, _ in DIRTY_COLUMNS],
                                             500, dirty),
        "head_rows": with_(SCORED_EVENTS) + "SELECT * FROM scored_events ORDER BY event_id LIMIT 150",
    }


# ---------------------------------------------------------------------------
# cleaning
# ---------------------------------------------------------------------------
def _trim(c: str) -> str:
    t = f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
    return f"CASE WHEN {t} IN ('nan', 'None', '') THEN NULL ELSE {t} END"


def _calendar(x: str, prefix: str = "") -> str:
    return ", ".join([
        f"CAST(year({x}) AS INTEGER) AS {prefix}year",
        f"CAST(month({x}) AS INTEGER) AS {prefix}month",
        f"CAST(quarter({x}) AS INTEGER) AS {prefix}quarter",
        f"CAST(weekofyear({x}) AS INTEGER) AS {prefix}week",
        f"CAST(day({x}) AS INTEGER) AS {prefix}day",
        f"CAST(isodow({x}) - 1 AS INTEGER) AS {prefix}dayofweek",
        f"CAST(isodow({x}) >= 6 AS INTEGER) AS {prefix}weekend",
    ])


def _mode(table: str, c: str) -> str:
    return (f"(SELECT {c} FROM {table} WHERE {c} IS NOT NULL GROUP BY {c} "
            f"ORDER BY count(*) DESC, {c} LIMIT 1)")


def _ffill(c: str, key: str) -> str:
    return (f"coalesce(last_value({c} IGNORE NULLS) OVER (ORDER BY {key} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
            f"first_value({c} IGNORE NULLS) OVER (ORDER BY {key} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))")


def _fences(table: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        parts.append(
            f"SELECT '{c}' AS column_name, q1, q3, q1 - 1.5 * (q3 - q1) AS lower_bound, q3 + 1.5 * (q3 - q1) AS upper_bound "
            f"FROM (SELECT quantile_cont({_d(c)}, 0.25) AS q1, quantile_cont({_d(c)}, 0.75) AS q3 FROM {table})")
    return union_all(parts)


EVENTS_NUMERIC = ["event_id", "user_id", "value"]


def clean_sql() -> dict[str, str]:
    dirty = with_(DIRTY_ORDERS)
    fences = f"fences AS ({_fences('events', EVENTS_NUMERIC)})"

    def fence(c, side):
        return f"(SELECT {side} FROM fences WHERE column_name = '{c}')"

    outside = " OR ".join(f"({c} < {fence(c, 'lower_bound')} OR {c} > {fence(c, 'upper_bound')})"
                          for c in EVENTS_NUMERIC)
    cleaned = DIRTY_ORDERS + f""",
t AS (SELECT o_orderkey, price, {_trim('prio')} AS prio, {_trim('d')} AS d, dt FROM dirty_orders),
u AS (SELECT DISTINCT * FROM t),
p AS (SELECT o_orderkey, price, prio, TRY_CAST(d AS TIMESTAMP) AS d, dt FROM u),
f AS (SELECT o_orderkey, coalesce(price, (SELECT quantile_cont(price, 0.5) FROM p)) AS price,
             coalesce(prio, {_mode('p', 'prio')}) AS prio, d, {_ffill('dt', 'o_orderkey')} AS dt,
             {_calendar('d')} FROM p),
b AS (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM f),
fb AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM b)
"""
    return {
        "trim_na": dirty + f"SELECT o_orderkey, price, {_trim('prio')} AS prio, {_trim('d')} AS d, dt, empty_col FROM dirty_orders",
        "drop_empty": dirty + "SELECT * EXCLUDE (empty_col) FROM dirty_orders",
        "dedup": dirty + "SELECT DISTINCT * FROM dirty_orders",
        "date_parse": dirty + "SELECT o_orderkey, price, prio, TRY_CAST(d AS TIMESTAMP) AS d, dt, empty_col FROM dirty_orders",
        "calendar_features": f"SELECT *, {_calendar('l_shipdate')} FROM lineitem",
        "impute_median": dirty + ("SELECT o_orderkey, coalesce(price, (SELECT quantile_cont(price, 0.5) FROM dirty_orders)) AS price, "
                                  "prio, d, dt, empty_col FROM dirty_orders"),
        "impute_mode": dirty + (f"SELECT o_orderkey, price, coalesce(prio, {_mode('dirty_orders', 'prio')}) AS prio, "
                                f"coalesce(d, {_mode('dirty_orders', 'd')}) AS d, dt, empty_col FROM dirty_orders"),
        "ffill_dates": dirty + f"SELECT o_orderkey, price, prio, d, {_ffill('dt', 'o_orderkey')} AS dt, empty_col FROM dirty_orders",
        "iqr_bounds": _fences("events", EVENTS_NUMERIC),
        "outlier_summary": f"WITH {fences} " + union_all([
            f"SELECT '{c}' AS column_name, count(*) AS outlier_count, {fence(c, 'lower_bound')} AS lower_bound, "
            f"{fence(c, 'upper_bound')} AS upper_bound FROM events "
            f"WHERE {c} < {fence(c, 'lower_bound')} OR {c} > {fence(c, 'upper_bound')} HAVING count(*) > 0"
            for c in EVENTS_NUMERIC]),
        # event_id and user_id have no values outside their fences (see outlier_summary), so only value is clipped
        "cap_outliers": f"WITH {fences} SELECT event_id, ts, user_id, event_type, "
                        f"least(greatest(value, {fence('value', 'lower_bound')}), {fence('value', 'upper_bound')}) AS value, "
                        f"props FROM events",
        "remove_outliers": f"WITH {fences} SELECT * FROM events WHERE NOT ({outside})",
        "clean_dataframe": "WITH " + cleaned + (
            "SELECT o_orderkey, CASE WHEN (SELECT count(*) FROM f, fb WHERE price < lo OR price > hi) > 0 "
            "THEN least(greatest(price, (SELECT lo FROM fb)), (SELECT hi FROM fb)) ELSE price END AS price, "
            "prio, d, dt, year, month, quarter, week, day, dayofweek, weekend FROM f"),
        "cleaning_report": "WITH " + cleaned + f""",
ko AS (SELECT quantile_cont(o_orderkey, 0.25) AS q1, quantile_cont(o_orderkey, 0.75) AS q3 FROM f),
kf AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM ko),
final_missing AS (SELECT {' + '.join(f'(count(*) - count({c}))' for c in
                  ['o_orderkey', 'price', 'prio', 'd', 'dt', 'year', 'month', 'quarter', 'week', 'day',
                   'dayofweek', 'weekend'])} AS m FROM f)
SELECT CAST((SELECT count(*) FROM dirty_orders) AS BIGINT) AS rows_before,
       CAST((SELECT count(*) FROM f) AS BIGINT) AS rows_after,
       CAST(6 AS BIGINT) AS columns_before, CAST(12 AS BIGINT) AS columns_after,
       CAST((SELECT count(*) FROM dirty_orders) - (SELECT count(*) FROM u) AS BIGINT) AS duplicates_removed,
       CAST((SELECT {' + '.join(f'(count(*) - count({c}))' for c, _ in DIRTY_COLUMNS)} FROM dirty_orders) AS BIGINT)
           AS missing_values_before,
       CAST((SELECT m FROM final_missing) AS BIGINT) AS missing_values_after,
       CAST((SELECT count(*) > 0 FROM f, fb WHERE price < lo OR price > hi) AS BIGINT)
         + CAST((SELECT count(*) > 0 FROM f, kf WHERE o_orderkey < lo OR o_orderkey > hi) AS BIGINT)
           AS outlier_columns,
       CAST(0 AS BIGINT) AS outlier_rows_removed""",
    }


# ---------------------------------------------------------------------------
# features
# ---------------------------------------------------------------------------
ORDERS_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
PART_COLUMNS = [("p_partkey", "num"), ("p_name", "cat"), ("p_brand", "cat"), ("p_type", "cat"),
                ("p_size", "num"), ("p_retailprice", "num")]


def _ratio_rows(table: str, cols: list[str]) -> str:
    return union_all([
        f"SELECT {i} AS pos, '{c}' AS column_name, count({c}) AS non_null, count(DISTINCT {c}) AS unique_values, "
        f"CAST(count(DISTINCT {c}) AS DOUBLE) / CAST(count({c}) AS DOUBLE) AS unique_ratio FROM {table}"
        for i, c in enumerate(cols)])


def _strategy(u: str) -> str:
    return f"CASE WHEN {u} <= 10 THEN 'onehot' WHEN {u} <= 50 THEN 'target' ELSE 'label' END"


def features_sql() -> dict[str, str]:
    part_all = "p_partkey, p_name, p_brand, p_type, p_size, p_retailprice"
    prio = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    prio_cols = ", ".join(f"CAST(coalesce(o_orderpriority, 'nan') = '{v}' AS INTEGER) AS \"o_orderpriority_{v}\""
                          for v in prio)
    status_cols = ", ".join(f"CAST(coalesce(o_orderstatus, 'nan') = '{v}' AS INTEGER) AS \"o_orderstatus_{v}\""
                            for v in ("F", "O", "P"))
    feat_cols = [c for c, _ in PART_COLUMNS if c != "p_retailprice"]
    cats = {c for c, k in PART_COLUMNS if k == "cat"}
    plan_parts = []
    for c in feat_cols:
        if c in cats:
            plan_parts.append(f"SELECT column_name, unique_values, CASE WHEN unique_ratio >= 0.9 THEN "
                              f"'excluded (id-like)' ELSE {_strategy('unique_values')} END AS strategy "
                              f"FROM r WHERE column_name = '{c}'")
        else:
            plan_parts.append(f"SELECT column_name, unique_values, 'excluded (id-like)' AS strategy "
                              f"FROM r WHERE column_name = '{c}' AND unique_ratio >= 0.9")
    return {
        "id_columns": (f"SELECT column_name, non_null, unique_values, unique_ratio, unique_ratio >= 0.9 AS is_id "
                       f"FROM ({_ratio_rows('orders', ORDERS_COLUMNS)})"),
        "suggest_target": (f"SELECT column_name AS target FROM ({_ratio_rows('orders', ['o_orderkey', 'o_custkey', 'o_totalprice'])}) "
                           f"WHERE unique_ratio < 0.9 ORDER BY pos LIMIT 1"),
        "problem_type": union_all([
            "SELECT 'l_returnflag' AS column_name, 'classification' AS problem_type"] + [
            f"SELECT '{c}', CASE WHEN count(DISTINCT {c}) <= 20 THEN 'classification' ELSE 'regression' END FROM lineitem"
            for c in ("l_linenumber", "l_quantity", "l_extendedprice")]),
        "encoding_plan": f"WITH r AS ({_ratio_rows('part', feat_cols)}) " + union_all(plan_parts),
        "label_encode": ("SELECT p_partkey, dense_rank() OVER (ORDER BY coalesce(p_name, 'nan')) - 1 AS p_name, "
                         "p_brand, p_type, p_size, p_retailprice FROM part"),
        "onehot": f"SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, {prio_cols} FROM orders",
        "target_encode": (
            "WITH g AS (SELECT avg(p_retailprice) AS gm FROM part), "
            "s AS (SELECT coalesce(p_brand, 'nan') AS k, avg(p_retailprice) AS m, count(p_retailprice) AS n "
            "FROM part GROUP BY 1) "
            "SELECT p_partkey, p_name, p_type, p_size, p_retailprice, "
            "coalesce((s.n * s.m + 10.0 * g.gm) / (s.n + 10.0), g.gm) AS p_brand_target_enc "
            "FROM part LEFT JOIN s ON coalesce(part.p_brand, 'nan') = s.k, g"),
        "engineer_features": (f"SELECT o_custkey, {_calendar('o_orderdate')}, {status_cols}, {prio_cols}, o_totalprice "
                              f"FROM orders"),
    }


# ---------------------------------------------------------------------------
# split, scaling, evaluation
# ---------------------------------------------------------------------------
SCALE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def split_sql(table: str, cols: list[str], keys: list[str], stratify: str | None) -> str:
    """ceil(rows x 0.2) test rows, shared among the classes by largest remainder."""
    cls = stratify or "'all'"
    order = ", ".join(["_h"] + keys)
    return (f"WITH h AS (SELECT *, {md5_bucket_sql(keys)} AS _h, {cls} AS _c FROM {table}), "
            "tot AS (SELECT count(*) AS n, CAST(ceil(count(*) * CAST(0.2 AS DECIMAL(3,1))) AS BIGINT) AS t FROM h), "
            "c AS (SELECT _c, count(*) AS k, count(*) * any_value(t) // any_value(n) AS whole, "
            "count(*) * any_value(t) % any_value(n) AS rest FROM h, tot GROUP BY _c), "
            "a AS (SELECT _c, whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, _c) "
            "<= (SELECT any_value(t) FROM tot) - sum(whole) OVER () THEN 1 ELSE 0 END AS t FROM c), "
            f"r AS (SELECT *, row_number() OVER (PARTITION BY _c ORDER BY {order}) AS _rn FROM h JOIN a USING (_c)) "
            f"SELECT {', '.join(cols)}, CASE WHEN _rn <= t THEN 'test' ELSE 'train' END AS split FROM r")


def scale_sql(kind: str) -> str:
    sel = []
    for c in SCALE_COLUMNS:
        if kind == "standard":
            center, spread = f"avg({c}) OVER ()", f"stddev_pop({c}) OVER ()"
        elif kind == "minmax":
            center, spread = f"min({c}) OVER ()", f"(max({c}) OVER () - min({c}) OVER ())"
        else:
            center = f"(SELECT quantile_cont({c}, 0.5) FROM lineitem)"
            spread = (f"((SELECT quantile_cont({c}, 0.75) FROM lineitem) - "
                      f"(SELECT quantile_cont({c}, 0.25) FROM lineitem))")
        sel.append(f"({c} - {center}) / (CASE WHEN {spread} = 0 OR {spread} IS NULL THEN 1 ELSE {spread} END) AS {c}")
    return f"SELECT {', '.join(LINE_KEYS)}, {', '.join(sel)} FROM lineitem"


def eval_sql() -> dict[str, str]:
    se = with_(SCORED_EVENTS)
    valid = "actual IS NOT NULL AND predicted IS NOT NULL"
    reg = ("avg(abs(actual - predicted)) AS mae, sqrt(avg((actual - predicted) * (actual - predicted))) AS rmse, "
           "CASE WHEN var_pop(actual) > 0 THEN 1 - sum((actual - predicted) * (actual - predicted)) / "
           "(var_pop(actual) * count(*)) END AS r2, count(*) AS n")
    li_cols = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
               "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    return {
        "stratified_split": split_sql("lineitem", li_cols, LINE_KEYS, "l_returnflag"),
        "random_split": split_sql("orders", ORDERS_COLUMNS, ["o_orderkey"], None),
        "standard_scale": scale_sql("standard"),
        "minmax_scale": scale_sql("minmax"),
        "robust_scale": scale_sql("robust"),
        "regression_metrics": se + f"SELECT {reg} FROM scored_events WHERE {valid}",
        "classification_metrics": se + """,
s AS (SELECT CAST(label AS VARCHAR) AS a, CAST(CASE WHEN predicted > 50 THEN 1 ELSE 0 END AS VARCHAR) AS p FROM scored_events),
c AS (SELECT a, p, count(*) AS n FROM s GROUP BY a, p),
sup AS (SELECT a AS k, sum(n) AS s FROM c GROUP BY a),
pr AS (SELECT p AS k, sum(n) AS pn FROM c GROUP BY p),
tp AS (SELECT a AS k, sum(n) AS t FROM c WHERE a = p GROUP BY a),
per AS (SELECT sup.k, CAST(sup.s AS DOUBLE) AS s, CAST(coalesce(tp.t, 0) AS DOUBLE) AS t,
               CAST(coalesce(pr.pn, 0) AS DOUBLE) AS pn
        FROM sup LEFT JOIN tp ON sup.k = tp.k LEFT JOIN pr ON sup.k = pr.k),
m AS (SELECT s, t, CASE WHEN pn > 0 THEN t / pn ELSE 0 END AS pc, t / s AS rc FROM per)
SELECT sum(t) / sum(s) AS accuracy, sum(s * pc) / sum(s) AS "precision", sum(s * rc) / sum(s) AS recall,
       sum(s * CASE WHEN pc + rc > 0 THEN 2 * pc * rc / (pc + rc) ELSE 0 END) / sum(s) AS f1,
       CAST(sum(s) AS BIGINT) AS n FROM m""",
        "roc_auc": se + """,
g AS (SELECT score AS s, CAST(sum(label) AS DOUBLE) AS pos, CAST(sum(1 - label) AS DOUBLE) AS neg
      FROM scored_events GROUP BY score),
r AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM g)
SELECT sum(pos * (nb + neg * 0.5)) / (sum(pos) * sum(neg)) AS roc_auc FROM r""",
        "residuals": se + ("SELECT row_number() OVER (ORDER BY event_id) AS row_idx, actual, predicted, "
                           "actual - predicted AS residual, abs(actual - predicted) AS abs_residual "
                           f"FROM scored_events WHERE {valid}"),
        "metrics_detail": se + f""",
m AS (SELECT e.event_type AS model, {reg} FROM scored_events s JOIN events e USING (event_id)
      WHERE {valid} GROUP BY e.event_type)
SELECT model, metric, value FROM (
  SELECT model, 'mae' AS metric, mae AS value FROM m UNION ALL
  SELECT model, 'rmse', rmse FROM m UNION ALL
  SELECT model, 'r2', r2 FROM m UNION ALL
  SELECT model, 'n', CAST(n AS DOUBLE) FROM m) WHERE value IS NOT NULL""",
    }


# ---------------------------------------------------------------------------
# sources, sinks
# ---------------------------------------------------------------------------
def sources_sql() -> dict[str, str]:
    cols = [c for c, _ in DIRTY_COLUMNS]
    miss = " + ".join(f"(count(*) - count({c}))" for c in cols)
    meta = DIRTY_ORDERS + f""",
s AS (SELECT count(*) AS r, {miss} AS m,
             count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_orders)) AS d FROM dirty_orders),
p AS (SELECT r, (CAST(m AS DOUBLE) / CAST(r * {len(cols)} AS DOUBLE)) * 100 AS mp,
             (CAST(d AS DOUBLE) / CAST(r AS DOUBLE)) * 100 AS dp FROM s)
"""
    rows = [("total_rows", "CAST(r AS VARCHAR)"), ("total_columns", f"'{len(cols)}'"),
            ("missing_percentage", "CAST(mp AS VARCHAR)"), ("duplicate_percentage", "CAST(dp AS VARCHAR)"),
            ("numeric_count", "'3'"), ("categorical_count", "'3'"),
            ("data_quality_score", "CAST(round(greatest(0.0, least(100.0, 100.0 - mp - dp)), 2) AS VARCHAR)"),
            ("has_raw", "'1'"), ("has_cleaned", "'0'"), ("has_processed", "'0'"), ("has_predictions", "'0'"),
            ("has_model_results", "'0'")]
    return {
        "run_metadata": "WITH " + meta + union_all([f"SELECT '{k}' AS key, {v} AS value FROM p" for k, v in rows]),
        "tighten_schema": "SELECT * FROM lineitem",
        "csv_roundtrip": "SELECT * FROM customer",
        "streaming_profile": union_all([
            f"SELECT '{c}' AS column_name, count(*) AS \"rows\", count({c}) AS non_null, avg({_d(c)}) AS mean, "
            f"stddev_samp({_d(c)}) AS std, min({_d(c)}) AS min_val, max({_d(c)}) AS max_val, "
            f"skewness({_d(c)}) AS skewness, kurtosis({_d(c)}) AS kurtosis FROM events"
            for c in ("event_id", "user_id", "value")]),
    }


def chart_more_sql() -> dict[str, str]:
    cols = LINEITEM_NUMERIC
    heat = union_all([
        f"SELECT '{a}' AS column_name, " + ", ".join(f"corr({_d(a)}, {_d(b)}) AS {b}" for b in cols)
        + " FROM lineitem" for a in cols])
    hist = distribution_sql("events", ["value"], 30)
    # The shared edges span both inputs; capping keeps values inside the
    # original range, so they are the edges of the original column
    f = _fences("events", ["value"])
    capped = (f"capped AS (SELECT least(greatest(value, (SELECT lower_bound FROM ({f}))), "
              f"(SELECT upper_bound FROM ({f}))) AS value FROM events)")
    n = 30
    grid = (f"SELECT i, i * step + lo AS e0, CASE WHEN i = {n - 1} THEN hi ELSE (i + 1) * step + lo END AS e1 "
            f"FROM range({n}) t(i), bd")

    def side(table, stage):
        counts = f"SELECT bin, count(*) AS cnt FROM ({_binned(table, 'value', 'bd', n)}) GROUP BY bin"
        return (f"SELECT 'value' AS column_name, e0 AS bin_start, e1 AS bin_end, "
                f"printf('%.2f – %.2f', e0, e1) AS bin_label, CAST(coalesce(cnt, 0) AS BIGINT) AS \"count\", "
                f"'{stage}' AS stage FROM ({grid}) g LEFT JOIN ({counts}) h ON g.i = h.bin")
    comparison = (f"WITH {_bounds_cte('bd', 'events', 'value', n)}, {capped}\n"
                  + union_all([side("events", "before"), side("capped", "after")]))
    summary = ("WITH r AS (SELECT count(DISTINCT p_name) AS u_name, count(DISTINCT p_brand) AS u_brand, "
               "count(DISTINCT p_type) AS u_type FROM part) "
               f"SELECT 'p_name' AS column_name, {_strategy('u_name')} AS strategy, u_name AS unique_values, "
               "CASE WHEN u_name <= 10 THEN u_name ELSE 1 END AS output_columns FROM r UNION ALL "
               f"SELECT 'p_brand', {_strategy('u_brand')}, u_brand, CASE WHEN u_brand <= 10 THEN u_brand ELSE 1 END "
               "FROM r UNION ALL "
               f"SELECT 'p_type', {_strategy('u_type')}, u_type, CASE WHEN u_type <= 10 THEN u_type ELSE 1 END FROM r")
    return {
        "correlation_heatmap": heat,
        "histogram": hist,
        "pair_sample": sample_sql("lineitem", LINE_KEYS, 5000,
                                  select=", ".join(LINE_KEYS + ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])),
        "outlier_comparison": comparison,
        "encoding_summary": summary,
    }


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for part in (profile_sql, chart_sql, clean_sql, features_sql, eval_sql, sources_sql, chart_more_sql):
        out.update(part())
    return out
