"""Invariants: idempotent cleaning steps, histogram totals, split and fold
partitions, and identical answers on 1 and 16 input partitions."""

from pyspark.sql import functions as F

from tessera.operators import chartdata, clean, ordered, relations, split_scale
from tessera.plans import fixtures
from tessera.sources.tables import read_table

from conftest import SF_SMALL


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_cleaning_steps_idempotent(spark):
    d = fixtures.dirty_orders(spark, SF_SMALL)
    once = clean.trim_whitespace(d)
    assert _rows(clean.trim_whitespace(once)) == _rows(once)
    dd = clean.remove_duplicates(once)
    assert _rows(clean.remove_duplicates(dd)) == _rows(dd)
    p1, parsed = clean.parse_date_columns(dd)
    assert parsed == ["d", "dt"] or parsed == ["d"]
    p2, _ = clean.parse_date_columns(p1)
    assert _rows(p2) == _rows(p1)


def test_histogram_counts_sum_to_non_null(spark):
    e = read_table(spark, SF_SMALL, "events")
    hist = relations.data_distribution(e, n_bins=10).collect()
    nonnull = e.agg(F.count("value")).collect()[0][0]
    assert sum(r["count"] for r in hist if r["column_name"] == "value") == nonnull
    assert len([r for r in hist if r["column_name"] == "value"]) == 10


def test_split_partitions_rows_and_is_stratified(spark):
    li = read_table(spark, SF_SMALL, "lineitem")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    s = split_scale.split_labels(li, keys, stratify="l_returnflag")
    assert s.count() == li.count()
    per = {(r["l_returnflag"], r["split"]): r["count"] for r in s.groupBy("l_returnflag", "split").count().collect()}
    import math
    for flag in {k[0] for k in per}:
        n = per.get((flag, "test"), 0) + per.get((flag, "train"), 0)
        assert abs(per.get((flag, "test"), 0) - n * 0.2) < 1
    assert sum(n for (_, side), n in per.items() if side == "test") == math.ceil(s.count() / 5)


def test_partition_invariance(spark):
    li = read_table(spark, SF_SMALL, "lineitem")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    one, many = li.coalesce(1), li.repartition(16)
    assert _rows(split_scale.split_labels(one, keys, "l_returnflag")) == \
        _rows(split_scale.split_labels(many, keys, "l_returnflag"))
    assert _rows(chartdata.sample_rows(one, keys, 100)) == _rows(chartdata.sample_rows(many, keys, 100))
    d = fixtures.dirty_orders(spark, SF_SMALL)
    assert _rows(ordered.ffill_bfill(d.coalesce(1), ["dt"], "o_orderkey", blocks=1)) == \
        _rows(ordered.ffill_bfill(d.repartition(16), ["dt"], "o_orderkey", blocks=16))
    e = read_table(spark, SF_SMALL, "events")
    a = _rows(ordered.row_index(e.coalesce(1), "event_id", blocks=1))
    b = _rows(ordered.row_index(e.repartition(16), "event_id", blocks=16))
    assert a == b and [r[0] for r in a] == list(range(1, len(a) + 1))


def test_dense_index_is_sorted_rank(spark):
    part = read_table(spark, SF_SMALL, "part").repartition(5)
    idx = {r["p_name"]: r["index"] for r in ordered.dense_index(part, "p_name").collect()}
    names = sorted(idx)
    assert [idx[n] for n in names] == list(range(len(names)))


def test_running_total(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 101)], "k int, v double").repartition(4)
    out = {r["k"]: r["running"] for r in ordered.running_total(df, "k", "v", blocks=7).collect()}
    assert all(out[k] == sum(range(1, k)) for k in out)
