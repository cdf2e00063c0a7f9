"""Further registered queries: defaults, hard names and values, and parts of
training whose results SQL can state.  Each has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import boosting, chartdata, clean, features, ordered, profile, split_scale, train
from tessera.plans import fixtures
from tessera.plans.oracle import column_statistics_sql, describe_sql, split_sql, union_all
from tessera.sources import artifacts, csv as csv_source, sinks
from tessera.sources.tables import read_table

BIG = 9_007_199_254_740_993         # above 2^53: neighbours are one double
ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


# --- order keys ---------------------------------------------------------------
def q_row_index_bigint(spark, sf):
    e = read_table(spark, sf, "events").select((F.col("event_id") + F.lit(BIG)).alias("k"), "user_id")
    return ordered.row_index(e, "k")


def q_row_index_text(spark, sf):
    e = read_table(spark, sf, "events").select(F.concat(F.lit("event-"), F.col("event_id")).alias("k"), "user_id")
    return ordered.row_index(e, "k")


def q_ffill_hot_key(spark, sf):
    """Two thirds of the rows share the first key."""
    d = fixtures.dirty_orders(spark, sf).dropDuplicates()
    d = d.withColumn("hot", F.when(F.col("o_orderkey") % 3 != 0, "hot").otherwise(F.concat(F.lit("k"), F.col("o_orderkey"))))
    return ordered.ffill_bfill(d, ["dt"], ["hot", "o_orderkey"]).select("o_orderkey", "dt")


# --- names, types, counts -----------------------------------------------------
_NAMES = {"l_quantity": "emp.var.rate", "l_extendedprice": "a`b", "l_discount": "St. Louis", "l_tax": "x y"}


def q_hard_names(spark, sf):
    li = read_table(spark, sf, "lineitem").select(*[F.col(c).alias(n) for c, n in _NAMES.items()])
    return profile.column_statistics(li)


def q_describe_dates(spark, sf):
    return profile.describe(read_table(spark, sf, "lineitem").select("l_shipdate", "l_quantity", "l_returnflag"))


def q_distinct_counts(spark, sf):
    """More than 200 values in text columns, exactly."""
    li = read_table(spark, sf, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("supp"),
                                                  F.concat(F.lit("p"), F.col("l_partkey")).alias("part"), "l_returnflag")
    plan = features.plan_encodings(li, li.columns)
    return spark.createDataFrame([(c, n, s) for c, (s, n) in plan.items()], "column_name string, unique_values long, strategy string")


def q_id_ratios(spark, sf):
    """Distinct shares around the threshold of 0.9."""
    o = read_table(spark, sf, "orders")
    return features.id_report(o.select(*[F.when(F.col("o_orderkey") % 100 < F.lit(p), -(F.col("o_orderkey") % 2)).otherwise(
        F.col("o_orderkey")).alias(f"r{p}") for p in range(6, 14)]))


# --- dates and CSV --------------------------------------------------------------
_LAYOUTS = {"us": "M/d/yyyy", "eu": "d/M/yyyy", "dash": "dd-MMM-yyyy", "long": "MMM d, yyyy", "zulu": "yyyy-MM-dd'T'HH:mm:ss'Z'"}


def _dated(spark, sf):
    day = F.to_timestamp(F.to_date("o_orderdate"))
    return read_table(spark, sf, "orders").select("o_orderkey", *[F.date_format(day, f).alias(n) for n, f in _LAYOUTS.items()])


def q_date_layouts(spark, sf):
    out, parsed = clean.parse_date_columns(_dated(spark, sf))
    return out.select("o_orderkey", *[F.col(c).cast("date").alias(c) for c in parsed])


def q_date_losses(spark, sf):
    d = fixtures.dirty_orders(spark, sf).select(F.when(F.col("o_orderkey") % 1009 == 0, "soon").otherwise(F.col("d")).alias("d"))
    return clean.date_losses(d, {"d": ["yyyy-MM-dd"]})


def _both_orders(spark, sf):
    """Dates as day/month/year and as month/day/year; a few that are none."""
    d = _dated(spark, sf).select("o_orderkey", "eu", "us")
    d = d.withColumn("eu", F.when(F.col("o_orderkey") % 997 == 0, "soon").otherwise(F.col("eu")))
    return d.join(read_table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")


_DATE_PARTS = [f"{c}_{p}" for c in ("eu", "us") for p in ("year", "month", "day", "dayofweek")]


def q_engineer_dates(spark, sf):
    out, model = features.engineer_features(_both_orders(spark, sf), "o_totalprice", carry=["o_orderkey"])
    lost = model.date_values_lost
    return out.select("o_orderkey", *_DATE_PARTS, F.lit(lost["eu"]).cast("long").alias("eu_lost"), F.lit(lost.get("us", 0)).cast("long").alias("us_lost"))


def q_clean_named_dates(spark, sf):
    out, report = clean.clean_dataframe(_both_orders(spark, sf), date_columns=["eu", "us"], outlier_strategy="skip",
                                        extract_dates=False, order_by="o_orderkey")
    return out.select("o_orderkey", F.col("eu").cast("date").alias("eu"), F.col("us").cast("date").alias("us"),
                      F.lit(report.date_values_lost["eu"]).cast("long").alias("eu_lost"))


def q_score_dates(spark, sf):
    """New rows whose dates could all be read both ways, read as fitted."""
    both = _both_orders(spark, sf)
    _, model = features.engineer_features(both, "o_totalprice", carry=["o_orderkey"])
    either = F.to_date("us", "M/d/yyyy")
    new = both.where((F.dayofmonth(either) <= 12) & (F.col("eu") != "soon")).drop("o_totalprice")
    return features.transform_features(new, model, carry=["o_orderkey"]).select("o_orderkey", *_DATE_PARTS)


def q_class_positions(spark, sf):
    """Position of every line among those of its ship mode's class; one class
    holds most rows."""
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 10 > 0, "hot").otherwise(
        F.concat(F.lit("s"), F.col("l_suppkey"))).alias("cls"))
    return ordered.class_positions(li, ["l_orderkey", "l_linenumber"], "cls")


def q_contiguous_folds(spark, sf):
    """Stratified folds in row order; classes number from their first row."""
    o = read_table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 > 0, "hot").otherwise(
        F.concat(F.lit("c"), F.col("o_custkey") % 40)).alias("cls"))
    return split_scale.fold_labels(o, ["o_orderkey"], 3, stratify="cls")


def q_plain_folds(spark, sf):
    return split_scale.fold_labels(read_table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 4)


def q_fill_other(spark, sf):
    """Gaps in a boolean column."""
    o = read_table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice") > 100000).alias("big"))
    return clean.fill_missing_values(o)


def q_csv_messy(spark, sf):
    p = read_table(spark, sf, "part").select(
        "p_partkey", F.concat("p_size", F.when(F.col("p_partkey") % 2 == 0, "D").otherwise("f")).alias("code"),
        F.concat(F.lit('5" '), F.col("p_name"), F.lit(", \\n")).alias("note"), (F.col("p_retailprice") / 3).alias("third"))
    return csv_source.load_csv(spark, sinks.to_csv(p, artifacts.artifact_dir(spark, "messy"))).df


def q_csv_rejects(spark, sf):
    """Every fiftieth row has a field too many."""
    line = F.concat_ws(",", "o_orderkey", "o_totalprice", F.concat(F.lit('"'), "o_orderpriority", F.lit(', x"')),
                       F.when(F.col("o_orderkey") % 50 == 0, "surplus"))
    path = artifacts.artifact_dir(spark, "rejects")
    body = read_table(spark, sf, "orders").select(line.alias("value"))
    head = spark.createDataFrame([("o_orderkey,o_totalprice,note",)], "value string")
    head.unionByName(body).coalesce(1).write.text(path)
    read = csv_source.load_csv(spark, path)
    return read.df.withColumn("rejected", F.lit(read.rejected_rows).cast("long"))


def q_csv_encodings(spark, sf):
    """A folder of a Latin-1 and a UTF-8 file."""
    path = artifacts.artifact_dir(spark, "encodings")
    c = read_table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("é-ü "), "c_name").alias("name"))
    for encoding, part in (("ISO-8859-1", c.where("c_custkey % 2 = 0")), ("UTF-8", c.where("c_custkey % 2 = 1"))):
        part.coalesce(1).write.mode("append").option("header", True).option("encoding", encoding).csv(path)
    read = csv_source.load_csv(spark, path)
    return read.df.withColumn("encoding", F.lit(read.encoding))


def q_published_rows(spark, sf):
    """Two runs, the second with a table that fails: its first version stays."""
    target = sinks.Target(path=artifacts.artifact_dir(spark, "versions"))
    o = read_table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("Price"))
    sinks.publish_run(target, raw=o, cleaned=o.where("o_orderkey % 2 = 0"))
    broken = o.withColumn("Price", F.raise_error(F.lit("broken")).cast("double"))
    sinks.publish_run(target, raw=o.where("o_orderkey % 3 = 0"), cleaned=broken)
    both = [sinks.read_published(spark, target, t).withColumn("tab", F.lit(t)) for t in ("raw_data", "cleaned_data")]
    return both[0].unionByName(both[1])


# --- training, scoring ------------------------------------------------------------
def q_holdout_rows(spark, sf):
    """Keys and actual values of the test rows that training holds out."""
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    prep = train.prepare(o, "o_totalprice", ["o_orderkey"], problem_type="regression", persist=False)
    return prep.test.select("o_orderkey", F.col("_y").alias("actual"))


def q_linear_fit(spark, sf):
    from pyspark.ml.regression import LinearRegression
    li = read_table(spark, sf, "lineitem").withColumn("label", F.col("l_extendedprice").cast("double"))
    fit = train.ModelPipeline(["l_quantity"], LinearRegression(labelCol="label", solver="normal")).fit(li).model
    return spark.createDataFrame([(round(float(fit.coefficients[0]), 4), round(float(fit.intercept), 3))], "slope double, intercept double")


def _boosting_rows(spark, sf):
    from pyspark.ml.functions import array_to_vector
    li = read_table(spark, sf, "lineitem")
    x = F.array(*[F.col(c).cast("double") for c in ("l_quantity", "l_discount", "l_tax")])
    return li.select(array_to_vector(x).alias("features"), F.col("l_extendedprice").cast("double").alias("label"),
                     (F.col("l_orderkey") % 10 == 0).alias("val"), (F.col("l_orderkey") + F.col("l_linenumber")).alias("k"))


def q_boost_first_gains(spark, sf):
    """Every split of the first tree's first node, second order."""
    out = boosting.first_gains(_boosting_rows(spark, sf), boosting.Boosting(), ["l_quantity", "l_discount", "l_tax"])
    return out.select("feature", F.round("threshold", 2).alias("threshold"), "rows_left",
                      F.round(F.col("gain") / F.max("gain").over(Window.partitionBy(F.lit(1))), 3).alias("share"))


def q_boost_patience(spark, sf):
    """Validation losses by round on a label that is mostly noise, and whether
    the model kept the round."""
    rows = _boosting_rows(spark, sf).withColumn("label", (F.crc32(F.col("k").cast("string").cast("binary")) % 1000 + F.col("label") / 1000))
    model = boosting.Boosting(rounds=40, depth=4, rate=0.3, newton=False, subsample=0.8, patience=10, valCol="val").fit(rows)
    return spark.createDataFrame([(i + 1, loss, i < model.kept) for i, loss in enumerate(model.curve)], "round int, loss double, kept boolean")


def q_predict_keeps_rows(spark, sf):
    """Scoring returns the input columns of every row, with a number each."""
    from tessera.plans import catalog
    cfg, _ = catalog._orders_config(spark, sf)
    from tessera.operators import score
    out = score.predict_dataframe(read_table(spark, sf, "orders"), cfg)
    return out.select(*ORDERS, F.col("predicted_o_totalprice").isNotNull().alias("scored"), F.col("actual_o_totalprice").alias("actual"))


def q_tail_rows(spark, sf):
    return chartdata.head_rows(fixtures.scored_events(spark, sf), ["event_id"], 40, descending=True)


def queries() -> dict:
    return {n[2:]: f for n, f in globals().items() if n.startswith("q_")}


def oracle_sql() -> dict[str, str]:
    from tessera.plans.oracle import DIRTY_ORDERS, SCORED_EVENTS, with_
    hard = "\nUNION ALL\n".join(column_statistics_sql("lineitem", [c]).replace(f"'{c}' AS column_name", f"'{n}' AS column_name")
                                for c, n in _NAMES.items())
    dirty, scored = with_(DIRTY_ORDERS), with_(SCORED_EVENTS)
    hot = "CASE WHEN o_orderkey % 3 <> 0 THEN 'hot' ELSE 'k' || o_orderkey END"
    fill = ("coalesce(last_value(dt IGNORE NULLS) OVER (ORDER BY hot, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
            "first_value(dt IGNORE NULLS) OVER (ORDER BY hot, o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))")
    strategy = "CASE WHEN n <= 10 THEN 'onehot' WHEN n <= 50 THEN 'target' ELSE 'label' END"
    ratios = union_all([f"SELECT 'r{p}' AS column_name, count(*) AS non_null, count(DISTINCT x) AS unique_values, "
                        f"CAST(count(DISTINCT x) AS DOUBLE) / count(*) AS unique_ratio, CAST(count(DISTINCT x) AS DOUBLE) / count(*) >= 0.9 AS is_id "
                        f"FROM (SELECT CASE WHEN o_orderkey % 100 < {p} THEN -(o_orderkey % 2) ELSE o_orderkey END AS x FROM orders)"
                        for p in range(6, 14)])
    seconds = "epoch(CAST(l_shipdate AS TIMESTAMP))"
    days = ("SELECT 'l_shipdate' AS column_name, count(l_shipdate) AS \"count\", CAST(NULL AS BIGINT) AS \"unique\", CAST(NULL AS VARCHAR) AS top, "
            f"CAST(NULL AS BIGINT) AS freq, avg({seconds}) AS mean, CAST(NULL AS DOUBLE) AS std, min({seconds}) AS \"min\", "
            f"quantile_cont({seconds}, 0.25) AS q25, quantile_cont({seconds}, 0.5) AS q50, quantile_cont({seconds}, 0.75) AS q75, "
            f"max({seconds}) AS \"max\" FROM lineitem")
    days_of = ("(SELECT o_orderkey, CASE WHEN o_orderkey % 997 <> 0 THEN CAST(o_orderdate AS DATE) END AS eu, "
               "CAST(o_orderdate AS DATE) AS us FROM orders)")
    lost = "(SELECT count(*) FROM orders WHERE o_orderkey % 997 = 0)"
    parts = "o_orderkey, " + ", ".join(f"CAST({f} AS INTEGER) AS {c}_{n}" for c in ("eu", "us") for n, f in (
        ("year", f"year({c})"), ("month", f"month({c})"), ("day", f"day({c})"), ("dayofweek", f"isodow({c}) - 1")))
    cls = "CASE WHEN l_orderkey % 10 > 0 THEN 'hot' ELSE 's' || l_suppkey END"
    # the classes' rows in a row, in the order of their first rows, dealt to the folds in turn
    folds = ("WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 > 0 THEN 'hot' ELSE 'c' || (o_custkey % 40) END AS cls FROM orders), "
             "c AS (SELECT cls, min(o_orderkey) AS first FROM o GROUP BY cls), "
             "d AS (SELECT cls, (row_number() OVER (ORDER BY first, o_orderkey) - 1) % 3 AS fold FROM o JOIN c USING (cls)), "
             "s AS (SELECT cls, fold, row_number() OVER (PARTITION BY cls ORDER BY fold) AS r FROM d), "
             "p AS (SELECT o_orderkey, cls, row_number() OVER (PARTITION BY cls ORDER BY o_orderkey) AS r FROM o) "
             "SELECT o_orderkey, cls, CAST(fold AS INTEGER) AS fold FROM p JOIN s USING (cls, r)")
    score = "pow({0}, 2) / ({1} + 1)"
    boost = ("WITH r AS (SELECT *, avg(l_extendedprice) OVER () - l_extendedprice AS g FROM lineitem), "
             "s AS (" + union_all([f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS threshold, sum(g) AS g, count(*) AS n FROM r GROUP BY {c}"
                                   for c in ("l_quantity", "l_discount", "l_tax")]) + "), "
             "t AS (SELECT feature, threshold, sum(g) OVER f AS gl, sum(n) OVER f AS nl, sum(g) OVER (PARTITION BY feature) AS g, "
             "sum(n) OVER (PARTITION BY feature) AS n FROM s WINDOW f AS (PARTITION BY feature ORDER BY threshold)), "
             f"u AS (SELECT *, {score.format('gl', 'nl')} + {score.format('g - gl', '(n - nl)')} - {score.format('g', 'n')} AS gain FROM t WHERE nl < n) "
             "SELECT feature, round(threshold, 2) AS threshold, CAST(nl AS BIGINT) AS rows_left, round(gain / max(gain) OVER (), 3) AS share FROM u")
    return {
        "row_index_bigint": f"SELECT row_number() OVER (ORDER BY event_id) AS row_idx, event_id + {BIG} AS k, user_id FROM events",
        "row_index_text": "SELECT row_number() OVER (ORDER BY 'event-' || event_id) AS row_idx, 'event-' || event_id AS k, user_id FROM events",
        "ffill_hot_key": dirty + f", d AS (SELECT DISTINCT *, {hot} AS hot FROM dirty_orders) SELECT o_orderkey, {fill} AS dt FROM d",
        "hard_names": hard,
        "describe_dates": days + "\nUNION ALL\n" + describe_sql("lineitem", ["l_quantity"], ["l_returnflag"]),
        "distinct_counts": union_all([f"SELECT '{n}' AS column_name, n AS unique_values, {strategy} AS strategy FROM "
                                      f"(SELECT count(DISTINCT {c}) AS n FROM lineitem)"
                                      for n, c in (("supp", "l_suppkey"), ("part", "l_partkey"), ("l_returnflag", "l_returnflag"))]),
        "id_ratios": ratios,
        "date_layouts": "SELECT o_orderkey, " + ", ".join(f"CAST(o_orderdate AS DATE) AS {n}" for n in _LAYOUTS) + " FROM orders",
        "date_losses": dirty + "SELECT 'd' AS column_name, count(d) AS non_null, count(d) FILTER (o_orderkey % 1009 <> 0) AS parsed, "
                               "count(d) FILTER (o_orderkey % 1009 = 0) AS lost FROM dirty_orders",
        "engineer_dates": f"SELECT {parts}, {lost} AS eu_lost, CAST(0 AS BIGINT) AS us_lost FROM {days_of}",
        "clean_named_dates": f"SELECT o_orderkey, coalesce(eu, last_value(eu IGNORE NULLS) OVER w, first_value(eu IGNORE NULLS) OVER v) AS eu, us, "
                             f"{lost} AS eu_lost FROM {days_of} WINDOW w AS (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), "
                             "v AS (ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)",
        "score_dates": f"SELECT {parts} FROM {days_of} WHERE day(us) <= 12 AND eu IS NOT NULL",
        "class_positions": f"SELECT l_orderkey, l_linenumber, {cls} AS cls, CAST(row_number() OVER (PARTITION BY {cls} "
                           "ORDER BY l_orderkey, l_linenumber) - 1 AS BIGINT) AS position FROM lineitem",
        "contiguous_folds": folds,
        "plain_folds": "SELECT o_orderkey, CAST((SELECT count(*) FROM range(1, 4) t(f) WHERE r >= (SELECT sum(n // 4 + CASE WHEN i < n % 4 THEN 1 ELSE 0 END) "
                       "FROM range(4) s(i) WHERE i < f)) AS INTEGER) AS fold "
                       "FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders)",
        "fill_other": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN CASE WHEN o_totalprice > 100000 THEN 'true' ELSE 'false' END "
                      "ELSE 'Unknown' END AS big FROM orders",
        "csv_rejects": "SELECT o_orderkey, o_totalprice, o_orderpriority || ', x' AS note, (SELECT count(*) FROM orders WHERE o_orderkey % 50 = 0) AS rejected "
                       "FROM orders WHERE o_orderkey % 50 <> 0",
        "csv_encodings": "SELECT c_custkey, 'é-ü ' || c_name AS name, 'mixed' AS encoding FROM customer",
        "published_rows": "SELECT o_orderkey, o_totalprice AS price, 'raw_data' AS tab FROM orders WHERE o_orderkey % 3 = 0 "
                          "UNION ALL SELECT o_orderkey, o_totalprice, 'cleaned_data' FROM orders WHERE o_orderkey % 2 = 0",
        "csv_messy": "SELECT p_partkey, p_size || CASE WHEN p_partkey % 2 = 0 THEN 'D' ELSE 'f' END AS code, "
                     "'5\" ' || p_name || ', \\n' AS note, p_retailprice / 3 AS third FROM part",
        "holdout_rows": f"SELECT o_orderkey, o_totalprice AS actual FROM ({split_sql('orders', ORDERS, ['o_orderkey'], None)}) WHERE split = 'test'",
        "linear_fit": "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, "
                      "round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem",
        "boost_first_gains": boost,
        "predict_keeps_rows": f"SELECT {', '.join(ORDERS)}, true AS scored, o_totalprice AS actual FROM orders",
        "tail_rows": scored + "SELECT * FROM scored_events ORDER BY event_id DESC LIMIT 40",
    }
