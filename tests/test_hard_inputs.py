"""Names, values and keys that real tables have."""

import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from tessera.operators import chartdata, clean, evaluate, features, ordered, profile, relations, score, split_scale, train
from tessera.sources import csv as csv_source


def _file(text: str) -> str:
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-csv-"), "t.csv")
    with open(path, "w") as fh:
        fh.write(text)
    return path


def test_csv_codes_stay_text(spark):
    df = csv_source.read_csv(spark, _file("code,n,x,big,inf\n1D,1,1.5,9007199254740993,inf\n2F,-2,2e3,1,-Infinity\n3d,+3,.5,2,1\n"))
    assert dict(df.dtypes) == {"code": "string", "n": "bigint", "x": "double", "big": "bigint", "inf": "double"}
    assert [r.code for r in df.collect()] == ["1D", "2F", "3d"] and {r.big for r in df.collect()} == {9007199254740993, 1, 2}


@pytest.mark.parametrize("make", [lambda: "/nonexistent/missing.csv", lambda: _file("")])
def test_unreadable_csv_is_a_loader_error(spark, make):
    with pytest.raises(csv_source.LoaderError):
        csv_source.load_csv(spark, make())


@pytest.mark.parametrize("values", [
    ["5/2/2010", "12/25/2010"], ["25/12/2020", "1/2/2020", "31/1/2020"], ["05-Jan-2020", "6-Feb-2021"],
    ["Jan 5, 2020", "December 31, 2021"], ["2020-01-05T10:00:00Z", "2020-01-05T10:00:00.123Z"]])
def test_ordinary_date_layouts(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "d string")
    out, parsed = clean.parse_date_columns(df)
    assert parsed == ["d"] and out.where("d IS NULL").count() == 0


def test_day_first_columns_are_read_day_first(spark):
    df = spark.createDataFrame([(f"{d}/3/2020",) for d in range(1, 29)], "d string")
    out, _ = clean.parse_date_columns(df)
    assert {r.d.month for r in out.collect()} == {3}


def test_dotted_and_quoted_names_and_values_train_and_score(spark):
    r = random.Random(4)
    towns = ["St. Louis", "a`b", "New York", "x.y.z"]
    rows = [(i, r.choice(towns), float(i % 17), r.random()) for i in range(400)]
    df = spark.createDataFrame([(i, t, x, 3 * x + (t == "St. Louis") * 5 + e) for i, t, x, e in rows],
                               "id long, `home.town` string, `emp.var``rate` double, y double")
    assert {x["column_name"] for x in profile.column_statistics(df).collect()} >= {"emp.var`rate"}
    assert profile.describe(df).count() == 4 and relations.correlation_matrix(df).count() == 6
    processed, model = features.engineer_features(df, "y", carry=["id"])
    prep = train.prepare(processed, "y", ["id"], problem_type="regression")
    result = train.train_all_models(prep, cv_folds=0, models=["Linear Regression"])
    out = score.predict_dataframe(df, score.build_prediction_config(result, model, prep))
    assert out.columns == [*df.columns, "predicted_y", "actual_y"] and out.count() == 400
    assert out.agg(F.avg(F.abs(F.col("predicted_y") - F.col("actual_y")))).first()[0] < 0.5


def test_keys_beyond_doubles_and_text_keys(spark):
    big = 2 ** 53
    rows = [(big + i, None if i % 3 else f"v{i}") for i in range(60)]
    for blocks in (1, 16):
        df = spark.createDataFrame(rows, "k long, v string").repartition(7)
        out = {x.k: x.v for x in ordered.ffill_bfill(df, ["v"], "k", blocks=blocks).collect()}
        assert out == {big + i: f"v{i - i % 3}" for i in range(60)}
        text = df.select(F.format_string("key-%05d", F.col("k") - big).alias("k"), "v")
        assert {x.k: x.row_idx for x in ordered.row_index(text, "k", blocks=blocks).collect()} == {f"key-{i:05d}": i + 1 for i in range(60)}


def test_hot_order_key_spreads_and_keeps_one_order(spark):
    df = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(3000)], "k long, v long")
    b = ordered.with_blocks(df.repartition(5), "k", 8)
    sizes = [r["count"] for r in b.frame.groupBy(b.block).count().collect()]
    assert b.count == 8 and len(sizes) == 8 and max(sizes) < 900
    a = ordered.row_index(df.repartition(3), "k", blocks=8).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, ordered.row_index(df.repartition(9), "k", blocks=2).collect()))


def test_nan_is_no_outlier(spark):
    nan = float("nan")
    df = spark.createDataFrame([(float(i),) for i in range(50)] + [(nan,), (None,), (1e6,)], "x double")
    out, found = clean.cap_outliers_iqr(df)
    assert [s.outlier_count for s in found] == [1]
    values = [r.x for r in out.collect()]
    assert sum(v is not None and v != v for v in values) == 1 and max(v for v in values if v is not None and v == v) < 200
    s = split_scale.fit_scaler(df, ["x"], "minmax")
    assert s.center["x"] == 0.0 and s.scale["x"] == 1e6


def test_correlation_matches_numpy_with_gaps(spark):
    import numpy as np
    r = np.random.default_rng(2)
    x = r.normal(1e6, 1, (500, 4))
    x[:, 1] += x[:, 0]
    x[:, 3] = 7.0
    gaps = r.random((500, 4)) < 0.2
    rows = [tuple(None if g else float(v) for v, g in zip(a, b)) for a, b in zip(x, gaps)]
    got = {(m.col1, m.col2): m.correlation for m in relations.correlation_matrix(spark.createDataFrame(rows, "a double, b double, c double, d double")).collect()}
    for i, p in enumerate("abc"):
        for j, q in enumerate("abc"):
            if i <= j:
                ok = ~gaps[:, i] & ~gaps[:, j]
                assert abs(got[p, q] - np.corrcoef(x[ok, i], x[ok, j])[0, 1]) < 1e-9
    assert got["d", "d"] is None and got["a", "d"] is None


def test_duplicate_rows_by_hash_know_where_nulls_are(spark):
    df = spark.createDataFrame([("x", None, 0.0), (None, "x", 0.0), ("x", None, -0.0), ("x", None, float("nan"))], "a string, b string, c double")
    row = profile.dataset_summary(df).first()
    assert (row.row_count, row.duplicate_rows, row.missing_values) == (4, 1, 5)


@pytest.mark.parametrize("columns,found", [
    (["Actual", "Predicted"], ("Actual", "Predicted")), (["y_true", "actual_x", "prediction_y", "prediction"], ("y_true", "prediction")),
    (["label", "target", "pred"], ("label", "pred")), (["a", "b"], (None, None))])
def test_prediction_roles(spark, columns, found):
    df = spark.createDataFrame([tuple("1" for _ in columns)], ", ".join(f"{c} string" for c in columns))
    assert tuple(evaluate.column_of(df, role) for role in ("actual", "predicted")) == found


def test_scaling_rule_and_no_column_cap(spark):
    assert train.features_col_for("Neural Net") == train.SCALED and train.features_col_for("Random Forest") == train.RAW
    df = spark.range(20).select("id", *[(F.col("id") * i).cast("double").alias(f"c{i:02d}") for i in range(1, 41)])
    assert relations.correlation_wide(df).count() == 41
    assert len({r.column_name for r in relations.data_distribution(df).collect()}) == 41
    assert len(chartdata.missing_matrix(df, ["id"], 5).columns) > 40


def test_head_and_tail_with_ties_nulls_and_nan(spark):
    nan = float("nan")
    rows = [(float(i % 40), i) for i in range(400)] + [(None, 1000), (nan, 1001)]
    df = spark.createDataFrame(rows, "x double, i long").repartition(5)
    for descending in (False, True):
        order = [F.col(c).desc() if descending else F.col(c).asc() for c in ("x", "i")]
        want = [tuple(r) for r in df.orderBy(*order).limit(25).collect()]
        got = [tuple(r) for r in chartdata.head_rows(df, ["x", "i"], 25, descending).collect()]
        assert str(got) == str(want)


@pytest.mark.parametrize("text,spans,n", [
    ('a,b\n5" pipe,1\n6" pipe,2\n', False, 2), ('a,b\n"x ""y"" z",1\n"",2\n', False, 2), ('a,b\n"two\nlines",1\nx,2\n', True, 2),
    ('a,b\nx,"two\n\n""lines"", too"\n', True, 1), ('a,b\nit""s,"1"\n', False, 1)])
def test_only_fields_that_span_lines_stop_splitting(spark, text, spans, n):
    path = _file(text)
    assert csv_source.scan_text(spark, path)[1] is spans
    assert csv_source.read_csv(spark, path).count() == n


def test_one_layout_a_column(spark):
    """Values that fit day-first and month-first are read as the column's
    other values say; a value that only fits the other order is lost and counted."""
    from datetime import date
    rows = [("05/02/2010", "05/02/2010", "05/02/2010"), ("25/12/2010", "12/25/2010", "06/03/2010"), ("03/04/2011", "03/04/2011", "07/04/2010"),
            ("28/02/2011", "02/28/2011", None), ("12/31/2011", "x", "")]
    df = spark.createDataFrame(rows, "eu string, us string, either string")
    out, parsed = clean.parse_date_columns(df, ["eu", "us", "either"])
    got = [tuple(v and v.date() for v in r) for r in out.collect()]
    assert parsed == ["eu", "us", "either"]
    assert [r[0] for r in got] == [date(2010, 2, 5), date(2010, 12, 25), date(2011, 4, 3), date(2011, 2, 28), None]
    assert [r[1] for r in got] == [date(2010, 5, 2), date(2010, 12, 25), date(2011, 3, 4), date(2011, 2, 28), None]
    assert [r[2] for r in got] == [date(2010, 5, 2), date(2010, 6, 3), date(2010, 7, 4), None, None]
    votes = clean.date_layouts(df, ["eu", "us", "either"])
    assert {c: v.lost for c, v in votes.items()} == {"eu": 1, "us": 1, "either": 1}


def test_layouts_that_never_disagree_go_together(spark):
    df = spark.createDataFrame([("2020-01-05",), ("2020-01-06 10:00:00",), ("2020/01/07",)], "d string")
    out, _ = clean.parse_date_columns(df)
    assert [r.d.day for r in out.orderBy("d").collect()] == [5, 6, 7]


def test_cleaning_reports_lost_dates(spark):
    rows = [(i, f"{1 + i % 28}/3/2020" if i % 10 else "soon") for i in range(60)]
    out, report = clean.clean_dataframe(spark.createDataFrame(rows, "id long, d string"), date_columns=["d"], order_by="id")
    assert report.date_values_lost == {"d": 6} and "lost_dates=d:6" in report.actions
    assert {r.month for r in out.select("month").distinct().collect()} <= {3, None}
    report.release()


def test_typed_dates_may_come_as_text_when_scoring(spark):
    from datetime import datetime
    rows = [(i, datetime(2020, 1 + i % 12, 1 + i % 28), float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, d timestamp, y double")
    _, model = features.engineer_features(df, "y", carry=["id"])
    text = df.withColumn("d", df.d.cast("date").cast("string"))
    assert features.transform_features(text, model, carry=["id"]).collect() == features.transform_features(df, model, carry=["id"]).collect()


def test_scoring_rows_get_their_calendar_parts(spark):
    rows = [(i, f"{1 + i % 28}/{1 + i % 12}/2020", float(i)) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, d string, y double")
    processed, model = features.engineer_features(df, "y", carry=["id"])
    new = features.transform_features(df.drop("y"), model, carry=["id"])
    assert new.orderBy("id").collect() == processed.drop("y").orderBy("id").collect()
    assert new.agg({"month": "max"}).first()[0] == 12
