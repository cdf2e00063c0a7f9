"""Hand-made inputs with known answers (null, NaN, ties, constants, short
columns, empty columns, name clashes, CSV encodings)."""

import math
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tessera.functions.names import NameCollisionError, normalize_column_name, normalize_column_names
from tessera.operators import clean, ordered, profile, relations
from tessera.operators.split_scale import fit_scaler
from tessera.sources import csv as csv_source
from tessera.sources.tables import nan_to_null


def test_mode_tie_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("b",), (None,), ("c",)], "k string")
    assert profile.column_modes(df, ["k"])["k"] == ("a", 2)
    filled = clean.impute_mode(df).collect()
    assert sorted(r["k"] for r in filled) == ["a", "a", "a", "b", "b", "c"]


def test_nan_becomes_null_and_median(spark):
    df = nan_to_null(spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double"))
    assert [r["x"] for r in df.collect()].count(None) == 2
    out = clean.impute_median(df).collect()
    assert all(r["x"] == 1.0 for r in out)


def test_constant_column(spark):
    df = spark.createDataFrame([(7.0,), (7.0,), (7.0,)], "x double")
    b = clean.iqr_bounds(df)["x"]
    assert b[0] == b[1] == 7.0
    scaled = fit_scaler(df, ["x"], "standard").transform(df).collect()
    assert all(r["x"] == 0.0 for r in scaled)
    assert all(r["x"] == 0.0 for r in fit_scaler(df, ["x"], "minmax").transform(df).collect())
    hist = relations.data_distribution(df, n_bins=10).collect()
    assert min(r["bin_start"] for r in hist) == 6.5 and max(r["bin_end"] for r in hist) == 7.5
    assert sum(r["count"] for r in hist) == 3
    stats = profile.column_statistics(df).collect()[0]
    assert stats["skewness"] == 0.0 and stats["kurtosis"] is None       # kurtosis needs 4 values
    four = spark.createDataFrame([(7.0,)] * 4, "x double")
    assert profile.column_statistics(four).collect()[0]["kurtosis"] == 0.0


def test_all_null_column(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "a int, k string")
    out, dropped = clean.remove_empty_columns(df)
    assert dropped == ["k"] and out.columns == ["a"]
    filled = clean.impute_mode(df).collect()
    assert all(r["k"] == "Unknown" for r in filled)


def test_short_column_moments(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    r = profile.column_statistics(df).collect()[0]
    assert r["skewness"] is None and r["kurtosis"] is None
    assert r["median"] == 1.5


def test_even_count_median_on_ints(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    out = clean.impute_median(df)
    assert dict(out.dtypes)["x"] == "double"
    assert sorted(r["x"] for r in out.collect()) == [1.0, 1.5, 2.0]


def test_fill_order(spark):
    import datetime as dt
    a, b = dt.date(2020, 1, 1), dt.date(2020, 2, 1)
    df = spark.createDataFrame([(1, None), (2, a), (3, None), (4, b)], "t int, d date")
    out = {r["t"]: r["d"] for r in ordered.ffill_bfill(df, ["d"], "t", blocks=3).collect()}
    assert out == {1: a, 2: a, 3: a, 4: b}


def test_name_clash_raises(spark):
    df = spark.createDataFrame([(1, 2)], "`A b` int, `a_b` int")
    with pytest.raises(NameCollisionError):
        normalize_column_names(df)
    assert normalize_column_name("  Holiday/Promotion ") == "holiday_promotion"
    assert normalize_column_name("Store ID") == "store_id"


def test_latin1_csv(spark):
    d = tempfile.mkdtemp(prefix="tessera-csv-")
    path = os.path.join(d, "latin1.csv")
    with open(path, "wb") as fh:
        fh.write(b"name,n\ncaf\xe9,1\n")
    assert not csv_source.is_utf8(spark, path)
    df, enc = csv_source.load_csv_with_fallback_encoding(spark, path)
    assert enc == "ISO-8859-1"
    assert df.collect()[0]["name"] == "café"
    assert dict(df.dtypes)["n"] == "bigint"


def test_repeated_header_raises(spark):
    d = tempfile.mkdtemp(prefix="tessera-csv-")
    path = os.path.join(d, "dup.csv")
    with open(path, "w") as fh:
        fh.write("a,a,b\n1,2,3\n")
    with pytest.raises(csv_source.LoaderError):
        csv_source.load_csv(spark, path)


def test_csv_na_tokens_and_types(spark):
    d = tempfile.mkdtemp(prefix="tessera-csv-")
    path = os.path.join(d, "t.csv")
    with open(path, "w") as fh:
        fh.write("i,f,b,s\n1,1.5,True,x\nNA,n/a,False,NULL\n3,2,true,y\n")
    df = csv_source.read_csv(spark, path)
    assert dict(df.dtypes) == {"i": "bigint", "f": "double", "b": "boolean", "s": "string"}
    rows = df.orderBy("s").collect()
    assert rows[0]["i"] is None and rows[0]["s"] is None


def test_trim_tabs_and_tokens(spark):
    df = spark.createDataFrame([("\t a \n",), ("nan",), ("None",), ("  ",), ("b",)], "s string")
    out = [r["s"] for r in clean.trim_whitespace(df).collect()]
    assert out == ["a", None, None, None, "b"]


def test_calendar_features(spark):
    import datetime as dt
    df = spark.createDataFrame([(dt.datetime(2024, 12, 29),), (None,)], "d timestamp")
    out, added = clean.extract_datetime_features(df, ["d"])
    r = out.where(F.col("d").isNotNull()).collect()[0]
    # 2024-12-29 is a Sunday in ISO week 52
    assert (r["year"], r["month"], r["quarter"], r["week"], r["day"], r["dayofweek"], r["weekend"]) == \
        (2024, 12, 4, 52, 29, 6, 1)
    assert added == ["year", "month", "quarter", "week", "day", "dayofweek", "weekend"]
    assert out.where(F.col("d").isNull()).collect()[0]["year"] is None


def test_adjusted_skew_matches_pandas(spark):
    import pandas as pd
    vals = [1.0, 2.0, 2.0, 3.0, 10.0, 11.0, 4.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    r = profile.column_statistics(df).collect()[0]
    s = pd.Series(vals)
    assert math.isclose(r["skewness"], s.skew(), rel_tol=1e-9)
    assert math.isclose(r["kurtosis"], s.kurt(), rel_tol=1e-9)
    assert math.isclose(r["std"], s.std(), rel_tol=1e-9)
    assert r["median"] == s.median()


def test_box_stats_without_broadcast(spark, monkeypatch):
    from tessera.operators import chartdata
    from tessera.sources.tables import read_table
    e = read_table(spark, "/root/testdata/sf0.001", "events")
    exact = sorted(map(tuple, chartdata.box_stats(e, "value", "event_type").collect()))
    monkeypatch.setattr(chartdata, "BROADCAST_GROUPS", 0)
    many = sorted(map(tuple, chartdata.box_stats(e, "value", "event_type").collect()))
    assert len(exact) == len(many)
    for a, b in zip(exact, many):
        assert a[0] == b[0] and all(abs(x - y) < 1e-9 for x, y in zip(a[1:], b[1:]))


def _weighted_prf(pairs):
    """Brute force: support-weighted precision / recall / F1, 0 when undefined."""
    classes = {a for a, _ in pairs}
    n = len(pairs)
    prec = rec = f1 = 0.0
    for c in classes:
        tp = sum(1 for a, p in pairs if a == c and p == c)
        s = sum(1 for a, _ in pairs if a == c)
        pn = sum(1 for _, p in pairs if p == c)
        pc = tp / pn if pn else 0.0
        rc = tp / s if s else 0.0
        fc = 2 * pc * rc / (pc + rc) if pc + rc else 0.0
        prec, rec, f1 = prec + s * pc, rec + s * rc, f1 + s * fc
    acc = sum(1 for a, p in pairs if a == p) / n
    return acc, prec / n, rec / n, f1 / n


def test_classification_metrics_unpredicted_and_phantom_classes(spark):
    """'c' is never predicted (precision 0), 'z' is predicted but never
    actual (no support, no weight); null sides are skipped."""
    from tessera.operators.evaluate import classification_metrics
    pairs = [("a", "a")] * 5 + [("a", "b")] * 2 + [("b", "b")] * 3 + [("c", "a"), ("c", "z"), ("b", "z")]
    df = spark.createDataFrame(pairs + [(None, "a"), ("a", None)], "label string, prediction string")
    r = classification_metrics(df).collect()[0]
    acc, p, rc, f1 = _weighted_prf(pairs)
    assert r["n"] == len(pairs)
    for got, want in zip((r["accuracy"], r["precision"], r["recall"], r["f1"]), (acc, p, rc, f1)):
        assert math.isclose(got, want, rel_tol=1e-12)
    empty = classification_metrics(df.where(F.lit(False))).collect()[0]
    assert empty["n"] == 0 and empty["accuracy"] is None


def test_csv_quoting_like_pandas(spark):
    """Doubled quotes, a backslash, and a quoted line break read as pandas
    reads them; the multi-line read is chosen only when a field spans lines."""
    import pandas as pd
    d = tempfile.mkdtemp(prefix="tessera-csv-")
    spans = os.path.join(d, "spans.csv")
    with open(spans, "w") as fh:
        fh.write('id,txt\n1,"a ""b"" c"\n2,"line\nbreak"\n3,"back\\\\slash"\n4,plain\n')
    flat = os.path.join(d, "flat.csv")
    with open(flat, "w") as fh:
        fh.write('id,txt\n1,"a ""b"" c"\n2,"x, y"\n')
    for path, multi in ((spans, True), (flat, False)):
        assert csv_source.scan_text(spark, path) == (True, multi)
        got = [tuple(r) for r in csv_source.read_csv(spark, path).orderBy("id").collect()]
        want = [tuple(r) for r in pd.read_csv(path).itertuples(index=False)]
        assert got == want


def test_csv_write_read_round_trip_keeps_quotes(spark):
    from tessera.sources import sinks
    df = spark.createDataFrame([(1, 'say "hi"'), (2, "a\\b"), (3, "x,y")], "id long, txt string")
    d = tempfile.mkdtemp(prefix="tessera-csv-")
    out = sinks.to_csv(df, os.path.join(d, "out"))
    back = csv_source.read_csv(spark, out).orderBy("id").collect()
    assert [tuple(r) for r in back] == [(1, 'say "hi"'), (2, "a\\b"), (3, "x,y")]


def _pairwise_auc(ys, ss):
    pos = [s for y, s in zip(ys, ss) if y]
    neg = [s for y, s in zip(ys, ss) if not y]
    if not pos or not neg:
        return None
    wins = sum(1.0 if p > q else 0.5 if p == q else 0.0 for p in pos for q in neg)
    return wins / (len(pos) * len(neg))


def test_weighted_ovr_auc_matches_pairwise(spark):
    """Support-weighted one-vs-rest AUC with tied scores, a class with no
    rows ('d') and a null label, against brute-force pairwise counting."""
    import random
    from tessera.operators.evaluate import weighted_ovr_auc
    rng = random.Random(5)
    classes = ["a", "b", "c", "d"]
    rows = []
    for _ in range(300):
        lab = rng.choice(["a", "a", "b", "c"])
        ps = [round(rng.random(), 1) for _ in classes]        # coarse: many ties
        rows.append((lab, *ps))
    rows.append((None, 0.1, 0.2, 0.3, 0.4))
    df = spark.createDataFrame(rows, "label string, pa double, pb double, pc double, pd double").repartition(5)
    got = weighted_ovr_auc(df, "label", {c: f"p{c}" for c in classes})
    total, acc = 0, 0.0
    labelled = [r for r in rows if r[0] is not None]
    for i, c in enumerate(classes):
        n = sum(1 for r in labelled if r[0] == c)
        auc = _pairwise_auc([r[0] == c for r in labelled], [r[1 + i] for r in labelled])
        if n and auc is not None:
            acc, total = acc + n * auc, total + n
    assert math.isclose(got, acc / total, rel_tol=1e-12)


def test_grouped_running_total_restarts_per_group(spark):
    rows = [(g, k, float(k % 4)) for g in ("x", "y", None) for k in range(50)]
    df = spark.createDataFrame(rows, "g string, k long, v double").repartition(4)
    out = ordered.running_total(df, "k", "v", name="run", blocks=6, group="g").collect()
    for r in out:
        want = sum(float(k % 4) for k in range(r["k"]))
        assert r["run"] == want
