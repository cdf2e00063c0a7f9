"""A third of the rows on one key/value/class: results stay exact."""

import random
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import quantiles as Q
from tessera.operators import clean, profile, split_scale


def _skewed(spark, n=3000):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(n):
        hot = i % 3 == 0
        rows.append((i, "hot" if hot else f"k{i % 97}", 5.0 if hot else float(rng.normal(100, 20)),
                     "A" if hot or i % 2 else "B"))
    return spark.createDataFrame(rows, "id long, k string, x double, cls string").repartition(8), rows


def test_hot_value_quantiles_and_modes(spark):
    df, rows = _skewed(spark)
    xs = np.array([r[2] for r in rows])
    got = Q.exact_quantiles(df, ["x"], [0.1, 0.33, 0.5, 0.9], bins=16, leaf=50)["x"]
    assert np.allclose(got, np.quantile(xs, [0.1, 0.33, 0.5, 0.9]))
    assert profile.column_modes(df, ["k"])["k"] == ("hot", 1000)
    assert profile.distinct_counts(df, ["k"])["k"] == 98


def test_hot_duplicates_collapse(spark):
    df, _ = _skewed(spark)
    dup = df.select("k", "cls").where(F.col("k") == "hot")
    assert clean.remove_duplicates(dup).count() == 1


def test_split_with_dominant_class(spark):
    df, rows = _skewed(spark)
    s = split_scale.split_labels(df, ["id"], stratify="cls")
    per = {(r["cls"], r["split"]): r["count"] for r in s.groupBy("cls", "split").count().collect()}
    assert per[("A", "test")] + per[("B", "test")] == math.ceil(len(rows) * 0.2)
    for cls in ("A", "B"):
        n = sum(1 for r in rows if r[3] == cls)
        assert abs(per[(cls, "test")] - n * 0.2) < 1


def _allocated(sizes, test_size=0.2):
    """Largest remainder in plain integers; ties by class."""
    n = sum(sizes.values())
    t = math.ceil(round(n * test_size, 9))
    out = {c: k * t // n for c, k in sizes.items()}
    rest = sorted(sizes, key=lambda c: (-(sizes[c] * t % n), c))
    for c in rest[:t - sum(out.values())]:
        out[c] += 1
    return out


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_split_size_is_shared_by_largest_remainder(spark, monkeypatch, broadcast):
    monkeypatch.setattr(split_scale, "BROADCAST_CLASSES", broadcast)
    sizes = {f"c{i:03d}": 2 + (i * 7) % 23 for i in range(120)}
    sizes |= {f"d{i}": 11 for i in range(10)}
    rows = [(j * 1000 + i, c) for i, (c, n) in enumerate(sizes.items()) for j in range(n)]
    df = spark.createDataFrame(rows, "id long, cls string").repartition(5)
    s = split_scale.split_labels(df, ["id"], stratify="cls")
    per = {r["cls"]: r["count"] for r in s.where("split = 'test'").groupBy("cls").count().collect()}
    assert {c: n for c, n in _allocated(sizes).items() if n} == per
    again = split_scale.split_labels(df.repartition(1), ["id"], stratify="cls")
    assert s.exceptAll(again).count() == 0


def test_split_refuses_one_row_classes(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, cls string")
    with pytest.raises(ValueError, match="one row"):
        split_scale.split_labels(df, ["id"], stratify="cls")


def _box_brute(xs):
    q1, med, q3 = np.quantile(xs, [0.25, 0.5, 0.75])
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    inside = xs[(xs >= lo) & (xs <= hi)]
    return (len(xs), xs.min(), q1, med, q3, xs.max(), lo, hi, inside.min(), inside.max(),
            int(((xs < lo) | (xs > hi)).sum()))


def test_box_stats_hot_group_split(spark, monkeypatch):
    """Many groups, one with a third of the rows, with the fence table beyond
    the broadcast bound: every number equals the brute-force answer."""
    from tessera.operators import chartdata
    df, rows = _skewed(spark)
    monkeypatch.setattr(chartdata, "BROADCAST_GROUPS", 0)
    monkeypatch.setattr(Q, "DEFAULT_LEAF", 20)
    got = {r["k"]: tuple(r)[1:] for r in chartdata.box_stats(df, "x", "k").collect()}
    by_key: dict = {}
    for r in rows:
        by_key.setdefault(r[1], []).append(r[2])
    assert set(got) == set(by_key)
    for k, xs in by_key.items():
        want = _box_brute(np.array(xs))
        assert got[k][0] == want[0] and got[k][-1] == want[-1]
        assert np.allclose(got[k][1:-1], want[1:-1]), k


def test_split_with_hot_duplicated_key(spark):
    """A third of the rows share one key: copies are settled together (same
    side of the split) and the non-duplicated rows still split exactly."""
    rows = [(0 if i % 3 == 0 else i, "A") for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, cls string").repartition(8)
    s = split_scale.split_labels(df, ["id"], stratify="cls")
    sides = s.where(F.col("id") == 0).select("split").distinct().count()
    assert sides == 1
    n_test = s.where(F.col("split") == "test").count()
    assert n_test >= math.ceil(3000 * 0.2) or n_test == s.where(F.col("id") != 0).where(
        F.col("split") == "test").count()


def _bucket(seed, *key):
    import hashlib
    text = "|".join([str(seed)] + [str(k) for k in key])
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


@pytest.mark.parametrize("hot_rank", [0, 3])
def test_sample_with_hot_duplicated_key(spark, monkeypatch, hot_rank):
    """A third of the rows are copies of one key whose bucket is among the
    smallest: the candidate band is crowded by copies, so the exact cut-off
    path runs.  The sample still has exactly n rows, and its keys are the
    first n of the (bucket, key) order (copies of a key are identical)."""
    from tessera.operators import chartdata
    monkeypatch.setattr(chartdata, "SAMPLE_CANDIDATE_SLACK", 0)
    calls = []
    exact_path = chartdata._sample_by_cut
    monkeypatch.setattr(chartdata, "_sample_by_cut", lambda *a: calls.append(1) or exact_path(*a))
    ids = list(range(1, 2001))
    by_bucket = sorted(ids, key=lambda i: (_bucket(42, i), i))
    hot = by_bucket[hot_rank]
    rows = [(i, i * 10) for i in ids] + [(hot, hot * 10)] * 1000
    df = spark.createDataFrame(rows, "id long, v long").repartition(7)
    n = 50
    got = sorted(r["id"] for r in chartdata.sample_rows(df, ["id"], n).collect())
    want = sorted(sorted((r for r in rows), key=lambda r: (_bucket(42, r[0]), r[0]))[i][0] for i in range(n))
    assert calls and len(got) == n
    assert got == want


def test_sample_small_and_empty(spark):
    from tessera.operators import chartdata
    df = spark.createDataFrame([(i, i) for i in range(30)], "id long, v long")
    assert chartdata.sample_rows(df, ["id"], 100).count() == 30
    assert chartdata.sample_rows(df.where(F.lit(False)), ["id"], 100).count() == 0


def plain_folds(classes, k):
    """Contiguous stratified folds of rows in order, by the definition: the
    classes numbered as they appear, their sorted numbers dealt in turn."""
    seen = {c: i for i, c in enumerate(dict.fromkeys(classes))}
    dealt = sorted(seen[c] for c in classes)
    out = {}
    for c, i in seen.items():
        shares = [sum(x == i for x in dealt[f::k]) for f in range(k)]
        out[c] = [f for f in range(k) for _ in range(shares[f])]
    return [out[c].pop(0) for c in classes]


def test_folds_are_contiguous_and_stratified(spark):
    r = random.Random(1)
    classes = ["hot"] * 400 + ["b"] * 50 + ["c"] * 7 + ["d"] * 2 + [None] * 11 + [f"one{i}" for i in range(30)]
    r.shuffle(classes)
    df = spark.createDataFrame(list(enumerate(classes)), "id long, cls string").repartition(5)
    for k, blocks in ((3, 9), (5, 1)):
        got = sorted((x.id, x.fold) for x in split_scale.fold_labels(df, ["id"], k, stratify="cls", blocks=blocks).collect())
        assert [f for _, f in got] == plain_folds(classes, k)
    plain = split_scale.fold_labels(df, "id", 4, where=F.col("cls") == "hot", blocks=6)
    folds = [x.fold for x in plain.where("cls = 'hot'").orderBy("id").collect()]
    assert folds == [0] * 100 + [1] * 100 + [2] * 100 + [3] * 100 and plain.count() == len(classes)


def test_prefix_scan_of_many_groups_and_blocks_stays_on_the_executors(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame
    from tessera.operators import ordered
    monkeypatch.setattr(ordered, "FAN", 8)
    n = 40_000
    df = spark.range(n).select("id", F.concat(F.lit("g"), F.when(F.col("id") % 4 > 0, F.lit(0)).otherwise(F.col("id") % 10_000)).alias("g"),
                               (F.col("id") % 7).alias("v"), F.lit(5).alias("_place"), F.lit(6).alias("_block"), F.lit(7).alias("_sum"))

    def none(*a, **k):
        raise AssertionError("a table reached the driver")
    with monkeypatch.context() as m:
        for name in ("collect", "toPandas", "toArrow"):
            m.setattr(DataFrame, name, none)
        out = ordered.running_total(df, "id", "v", "run", blocks=200, group="g")
        filled = ordered.ffill_bfill(df.withColumn("v", F.when(F.col("id") % 1000 == 500, F.col("v"))), ["v"], "id", blocks=200)
        index = ordered.row_index(df, "id", blocks=200)
    run, want, last = {}, {}, {}
    for i in range(n):
        g = 0 if i % 4 else i % 10_000
        want[i] = run.get(g, 0)
        run[g] = want[i] + i % 7
    got = out.collect()
    assert {r.id: r.run for r in got} == want and {(r._place, r._block, r._sum) for r in got} == {(5, 6, 7)}
    for r in filled.collect():
        assert r.v == (max(500, (r.id - 500) // 1000 * 1000 + 500)) % 7
    assert all(r.row_idx == r.id + 1 for r in index.collect())


def test_blocks_follow_the_bytes(spark, monkeypatch):
    from tessera.operators import ordered
    monkeypatch.setattr(ordered, "BLOCK_BYTES", 1 << 16)
    small, large = (spark.range(n).withColumn("t", F.repeat(F.lit("x"), 100)) for n in (1000, 10_000))
    a, b = ordered.with_blocks(small, "id"), ordered.with_blocks(large, "id")
    assert a.count == 2 and b.count == 19
    assert ordered.measured_bytes(small) == 1000 * (16 + 8 + 100)


def test_samples_keep_columns_named_like_internal_ones(spark):
    from tessera.operators import chartdata
    df = spark.range(300).select("id", F.lit(1).alias("_h"), F.lit(2).alias("_mid"), F.lit(3).alias("_quota"))
    out = chartdata.sample_rows(df, ["id"], 20)
    assert out.columns == df.columns and {tuple(r)[1:] for r in out.collect()} == {(1, 2, 3)}
    hot = spark.createDataFrame([(1, 1, 2, 3)] * 9000, "id long, _h int, _mid int, _pid int")
    assert {tuple(r) for r in chartdata.sample_rows(hot, ["id"], 20).collect()} == {(1, 1, 2, 3)}


def test_violin_with_nan_and_infinity(spark):
    from tessera.operators import chartdata
    rows = [("a", float(i)) for i in range(50)] + [("a", float("nan")), ("b", float("inf")), ("b", 3.0), ("b", None)]
    out = chartdata.violin_density(spark.createDataFrame(rows, "g string, x double"), "x", "g", 5).collect()
    assert sum(r["count"] for r in out) == 51


def test_multiclass_auc_counts_zero_scores(spark):
    from tessera.operators.evaluate import weighted_ovr_auc
    r = random.Random(2)
    rows = []
    for _ in range(300):
        p = [r.choice([0.0, 0.0, r.random()]) for _ in range(3)]
        rows.append((r.choice(["a", "b", "c", "other"]), *[r.choice([x, x, x, None, float("nan")]) for x in p]))
    df = spark.createDataFrame(rows, "y string, a double, b double, c double")
    total = acc = 0
    for i, c in enumerate("abc"):
        ok = [x for x in rows if x[1 + i] is not None and x[1 + i] == x[1 + i]]
        pos, neg = [x[1 + i] for x in ok if x[0] == c], [x[1 + i] for x in ok if x[0] != c]
        auc = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / len(pos) / len(neg)
        n = sum(x[0] == c for x in rows)
        acc, total = acc + n * auc, total + n
    assert abs(weighted_ovr_auc(df, "y", {c: c for c in "abc"}) - acc / total) < 1e-12
