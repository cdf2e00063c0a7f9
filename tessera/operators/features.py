"""Feature engineering: id-like columns, target suggestion, problem type,
encoding plan, label / one-hot / smoothed target encoding, and the
composite ``engineer_features`` with a reusable fitted ``FeatureModel``.

Fitted lookup tables (label indices, target means) stay DataFrames: they
are joined back, broadcast only when their row count — known from the fit —
is under ``BROADCAST_KEYS``; above that Catalyst/AQE plans a shuffle join.
One-hot values are bounded by the plan (≤ 10 per column) and become plain
``CASE`` expressions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.dates import DATE_FORMATS
from tessera.functions.schema import classify_columns, col
from tessera.session import cut_lineage
from tessera.operators.clean import apply_dates, detect_date_columns, extract_datetime_features, plan_dates
from tessera.operators.ordered import dense_index
from tessera.operators.profile import distinct_counts

# Fixed values that must equal the reference's behaviour.
CLASSIFICATION_UNIQUE_THRESHOLD = 20
ONE_HOT_MAX_CATEGORIES = 10
TARGET_ENCODING_MAX_CATEGORIES = 50
ID_COLUMN_UNIQUE_RATIO = 0.90
TARGET_SMOOTHING = 10.0
NULL_CATEGORY = "nan"
PREFERRED_TARGETS = ("target", "label", "y", "units sold", "price", "sales", "revenue",
                     "churn", "default", "class", "outcome")

#: Category maps are broadcast up to this many bytes (keys, and 16 a row).
BROADCAST_BYTES = 32 << 20


def _text(c: str) -> Column:
    """Category value as text with null as its own value ``'nan'``."""
    return F.coalesce(col(c).cast("string"), F.lit(NULL_CATEGORY))


def _map_bytes(mapping: DataFrame, key: str) -> int:
    return int(mapping.agg(F.sum(F.octet_length(key) + 16).alias("b")).first()["b"] or 0)


def _maybe_broadcast(mapping: DataFrame, key: str) -> DataFrame:
    return F.broadcast(mapping) if _map_bytes(mapping, key) <= BROADCAST_BYTES else mapping


# ---------------------------------------------------------------------------
# P11 id-like columns
# ---------------------------------------------------------------------------
ID_SCHEMA = T.StructType([
    T.StructField("column_name", T.StringType()), T.StructField("non_null", T.LongType()),
    T.StructField("unique_values", T.LongType()), T.StructField("unique_ratio", T.DoubleType()),
    T.StructField("is_id", T.BooleanType()),
])


def id_report(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Distinct/non-null ratio per column, counted exactly; ratio ≥ 0.9 → id-like."""
    cols = columns if columns is not None else list(df.columns)
    if not cols:
        return df.sparkSession.createDataFrame([], ID_SCHEMA)
    row = df.agg(*[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(cols)]).collect()[0]
    nonnull = {c: int(row[f"n{i}"]) for i, c in enumerate(cols)}
    uniq = distinct_counts(df, cols)
    rows = []
    for c in cols:
        n, u = nonnull[c], min(uniq[c], nonnull[c])
        ratio = (u / n) if n else None
        rows.append((c, n, u, ratio, bool(n) and ratio >= ID_COLUMN_UNIQUE_RATIO))
    return df.sparkSession.createDataFrame(rows, ID_SCHEMA)


def id_columns(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    return [r["column_name"] for r in id_report(df, columns).collect() if r["is_id"]]


# ---------------------------------------------------------------------------
# P15 / P16
# ---------------------------------------------------------------------------
def suggest_target(df: DataFrame) -> str | None:
    """Preferred names first (compared lower-case), then the first non-id
    numeric column, then the first text column with ≤ 20 distinct values."""
    from tessera.functions.names import normalize_column_name
    lower = {}
    for c in df.columns:
        lower.setdefault(c.lower(), c)
        lower.setdefault(normalize_column_name(c), c)
    for name in PREFERRED_TARGETS:
        for probe in (name, normalize_column_name(name)):
            if probe in lower:
                return lower[probe]
    groups = classify_columns(df)
    num, cat = list(groups.numeric), list(groups.categorical)
    ids = set(id_columns(df, num)) if num else set()
    for c in num:
        if c not in ids:
            return c
    small = distinct_counts(df, cat, exact=True) if cat else {}
    for c in cat:
        if small[c] <= CLASSIFICATION_UNIQUE_THRESHOLD:
            return c
    return None


def distinct_up_to(df: DataFrame, column: str, cap: int) -> int:
    """Exact number of distinct non-null values, counting stops at ``cap``."""
    return df.select(col(column)).where(col(column).isNotNull()).distinct().limit(cap).count()


def detect_problem_type(df: DataFrame, target: str) -> str:
    """text/bool → classification; numeric with ≤ 20 distinct values →
    classification, else regression.  All-null raises."""
    dtype = df.schema[target].dataType
    n = distinct_up_to(df, target, CLASSIFICATION_UNIQUE_THRESHOLD + 1)
    if n == 0:
        raise ValueError(f"{target}: every value is null, no problem type")
    numeric = isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                                 T.DoubleType, T.DecimalType))
    if not numeric:
        return "classification"
    return "classification" if n <= CLASSIFICATION_UNIQUE_THRESHOLD else "regression"


# ---------------------------------------------------------------------------
# A15 / E6 encoding plan
# ---------------------------------------------------------------------------
def choose_encoding_strategy(unique_count: int) -> str:
    if unique_count <= ONE_HOT_MAX_CATEGORIES:
        return "onehot"
    if unique_count <= TARGET_ENCODING_MAX_CATEGORIES:
        return "target"
    return "label"


def plan_encodings(df: DataFrame, categorical: list[str]) -> dict[str, tuple[str, int]]:
    """``{column: (strategy, distinct count)}``, counted exactly."""
    if not categorical:
        return {}
    counts = distinct_counts(df, categorical)
    return {c: (choose_encoding_strategy(counts[c]), counts[c]) for c in categorical}


PLAN_SCHEMA = T.StructType([T.StructField("column_name", T.StringType()),
                            T.StructField("unique_values", T.LongType()),
                            T.StructField("strategy", T.StringType())])


def encoding_plan(df: DataFrame, target: str, exclude_ids: bool = True) -> DataFrame:
    """Planned strategy per text feature; id-like columns listed as excluded."""
    features, _, excluded = select_feature_columns(df, target, exclude_ids=exclude_ids)
    feats = df.select(*[col(c) for c in features])
    cats = list(classify_columns(feats).categorical)
    plans = plan_encodings(df, cats)
    rows = [(c, plans[c][1], plans[c][0]) for c in cats]
    if excluded:
        uniq = distinct_counts(df, excluded, exact=True)
        rows += [(c, uniq[c], "excluded (id-like)") for c in excluded]
    return df.sparkSession.createDataFrame(rows, PLAN_SCHEMA)


# ---------------------------------------------------------------------------
# E1 / E2 / E3 encoders
# ---------------------------------------------------------------------------
@dataclass
class LabelEncoding:
    column: str
    mapping: DataFrame          # (value string, index long)
    size: int


def fit_label(df: DataFrame, column: str) -> LabelEncoding:
    """Sorted text classes → 0..k-1 (null is the class ``'nan'``)."""
    mapping = dense_index(df.select(_text(column).alias("value")), "value", "index")
    size = mapping.count()
    return LabelEncoding(column, mapping, size)


def apply_label(df: DataFrame, enc: LabelEncoding, unseen: int | None = None) -> DataFrame:
    """Replace the column by its class index; unseen classes → ``unseen``
    (None keeps null; scoring uses 0 like the reference)."""
    c = enc.column
    m = enc.mapping.select(F.col("value").alias("_lv"), F.col("index").alias("_li"))
    joined = df.join(_maybe_broadcast(m, "_lv"), _text(c) == F.col("_lv"), "left")
    idx = F.col("_li") if unseen is None else F.coalesce(F.col("_li"), F.lit(unseen).cast("long"))
    return joined.select(*[idx.alias(x) if x == c else col(x) for x in df.columns])


@dataclass
class OneHotEncoding:
    column: str
    values: list[str]

    @property
    def output_columns(self) -> list[str]:
        return [f"{self.column}_{v}" for v in self.values]


def fit_onehot(df: DataFrame, column: str, max_values: int = 1000) -> OneHotEncoding:
    """Sorted distinct values (null → ``'nan'``); bounded by ``max_values``."""
    vals = (df.select(_text(column).alias("v")).distinct().orderBy("v").limit(max_values + 1).collect())
    if len(vals) > max_values:
        raise ValueError(f"{column} has more than {max_values} values; one-hot is not sensible")
    return OneHotEncoding(column, [r["v"] for r in vals])


def onehot_columns(enc: OneHotEncoding) -> list[Column]:
    t = _text(enc.column)
    return [F.when(t == F.lit(v), 1).otherwise(0).alias(name) for v, name in zip(enc.values, enc.output_columns)]


def apply_onehot(df: DataFrame, enc: OneHotEncoding) -> DataFrame:
    """Drop the column and append one 0/1 column per fitted value (unseen → all 0)."""
    return df.select(*[col(x) for x in df.columns if x != enc.column], *onehot_columns(enc))


@dataclass
class TargetEncoding:
    column: str
    mapping: DataFrame          # (value string, encoded double)
    size: int
    global_mean: float | None
    smoothing: float = TARGET_SMOOTHING

    @property
    def output_column(self) -> str:
        return f"{self.column}_target_enc"


def fit_target(df: DataFrame, column: str, target: str, smoothing: float = TARGET_SMOOTHING) -> TargetEncoding:
    """(n·mean + s·global) / (n + s) per category over numeric target values."""
    y = col(target).try_cast("double")
    y = F.when(~F.isnan(y), y)
    # one shuffle: per-category mean, count and sum, written; the global
    # mean, the map size and the map itself are all read from it
    per_value = cut_lineage(df.select(_text(column).alias("value"), y.alias("_y"))
                            .groupBy("value").agg(F.avg("_y").alias("_m"), F.count("_y").alias("_n"),
                                                  F.sum("_y").alias("_s")))
    r = per_value.agg(F.count(F.lit(1)).alias("k"), F.sum("_s").alias("s"), F.sum("_n").alias("n")).collect()[0]
    gm = float(r["s"]) / r["n"] if r["n"] else None
    s = F.lit(float(smoothing))
    mapping = per_value.select(
        "value", ((F.col("_n") * F.col("_m") + s * F.lit(gm)) / (F.col("_n") + s)).alias("encoded"))
    return TargetEncoding(column, mapping, int(r["k"]), gm, smoothing)


def apply_target(df: DataFrame, enc: TargetEncoding) -> DataFrame:
    """Drop the column and append ``<col>_target_enc``; categories without a
    value (unseen, or no numeric target) → the training global mean."""
    m = enc.mapping.select(F.col("value").alias("_tv"), F.col("encoded").alias("_te"))
    joined = df.join(_maybe_broadcast(m, "_tv"), _text(enc.column) == F.col("_tv"), "left")
    enc_col = F.coalesce(F.col("_te"), F.lit(enc.global_mean).cast("double")).alias(enc.output_column)
    return joined.select(*[col(x) for x in df.columns if x != enc.column], enc_col)


# ---------------------------------------------------------------------------
# The feature model
# ---------------------------------------------------------------------------
TARGET, DATE, TEXT_DATE, ID, CATEGORY, VALUE = "target", "date", "text date", "id", "category", "value"


def column_roles(df: DataFrame, target: str | None = None, exclude_ids: bool = True, text_dates: bool = True) -> dict[str, str]:
    """What each column is to a model.  Text that looks like dates stays a
    candidate for a feature (only typed dates are none); id-like columns are
    found in one job over all candidates."""
    groups = classify_columns(df)
    roles = {c: DATE if c in groups.datetime else CATEGORY if c in groups.categorical else VALUE for c in df.columns}
    if text_dates:
        roles |= dict.fromkeys(detect_date_columns(df), TEXT_DATE)
    if target is not None:
        roles[target] = TARGET
    tested = [c for c, r in roles.items() if r not in (TARGET, DATE)]
    if exclude_ids and target is not None and tested:
        roles |= dict.fromkeys(id_columns(df, tested), ID)
    return roles


def get_datetime_columns(df: DataFrame) -> list[str]:
    """Typed dates, then text that looks like dates."""
    roles = column_roles(df)
    return [c for kind in (DATE, TEXT_DATE) for c, r in roles.items() if r == kind]


def select_feature_columns(df: DataFrame, target: str, exclude_ids: bool = True) -> tuple[list[str], list[str], list[str]]:
    """(features, datetime columns, excluded id columns)."""
    roles = column_roles(df, target, exclude_ids, text_dates=False)
    by = {r: [c for c in df.columns if roles[c] == r] for r in (ID, CATEGORY, VALUE)}
    return [c for c in df.columns if c in by[CATEGORY] + by[VALUE]], get_datetime_columns(df), by[ID]


@dataclass
class EncodingDetail:
    column: str
    strategy: str
    unique_count: int
    output_columns: list[str] = field(default_factory=list)


@dataclass
class FeatureModel:
    """Everything that turns raw rows into features: the layout of every date
    column, the calendar parts made of them, the columns that stay, and the
    encoder of each category.  ``transform`` applies it, to the rows it was
    fitted on as to new ones."""
    target: str
    date_columns: list[str]
    datetime_features: list[str]
    raw_features: list[str]
    excluded_ids: list[str]
    dropped_columns: list[str]
    feature_names: list[str]
    labels: dict[str, LabelEncoding] = field(default_factory=dict)
    onehots: dict[str, OneHotEncoding] = field(default_factory=dict)
    targets: dict[str, TargetEncoding] = field(default_factory=dict)
    details: list[EncodingDetail] = field(default_factory=list)
    date_formats: dict[str, list[str]] = field(default_factory=dict)
    date_values_lost: dict[str, int] = field(default_factory=dict)

    def encoding_summary(self, spark) -> DataFrame:
        """Column, strategy, distinct values, number of output columns."""
        return spark.createDataFrame(
            [(d.column, d.strategy, d.unique_count, len(d.output_columns)) for d in self.details],
            "column_name string, strategy string, unique_values long, output_columns long")

    def dated(self, df: DataFrame) -> DataFrame:
        """Dates read in their layouts (typed ones that come as text in any), calendar parts added."""
        out = apply_dates(df, {c: self.date_formats.get(c, DATE_FORMATS) for c in self.date_columns})
        return extract_datetime_features(out, self.date_columns)[0] if self.datetime_features else out

    def encoded(self, df: DataFrame, unseen_label: int | None) -> DataFrame:
        """Categories replaced by their encoders' columns."""
        for c in self.raw_features:
            if c in self.onehots:
                df = apply_onehot(df, self.onehots[c])
            elif c in self.targets:
                df = apply_target(df, self.targets[c])
            elif c in self.labels:
                df = apply_label(df, self.labels[c], unseen=unseen_label)
        return df

    def transform(self, df: DataFrame, unseen_label: int | None = 0, carry: list[str] | None = None) -> DataFrame:
        """``carry`` columns unchanged, the features, the target if it
        is there.  Inputs that are missing count as null, features that
        cannot be made as 0."""
        kept = [c for c in (carry or []) if c in df.columns]
        tail = [self.target] if self.target in df.columns and self.target not in kept else []
        gaps = {c: F.lit(None).cast("string") for c in self.raw_features + self.date_columns
                if c not in df.columns and c not in self.datetime_features}
        rows = self.dated(df.withColumns(gaps))
        own = [c for c in self.raw_features if c not in kept]
        out = self.encoded(rows.select(*[col(c) for c in kept + own + tail]), unseen_label)
        features = [col(c) if c in out.columns else F.lit(0).alias(c) for c in self.feature_names]
        return out.select(*[col(c) for c in kept], *features, *[col(c) for c in tail])


def fit_encoders(df: DataFrame, categories: list[str], target: str, use_target_encoding: bool = True) -> dict[str, tuple]:
    """``{column: (strategy, distinct values, encoder)}``."""
    out = {}
    for c, (strategy, n) in plan_encodings(df, categories).items():
        if strategy == "target" and not use_target_encoding:
            strategy = "label"
        fit = {"onehot": lambda: fit_onehot(df, c), "target": lambda: fit_target(df, c, target), "label": lambda: fit_label(df, c)}
        out[c] = (strategy, n, fit[strategy]())
    return out


def _outputs(column: str, encoder) -> list[str]:
    if isinstance(encoder, OneHotEncoding):
        return encoder.output_columns
    return [encoder.output_column] if isinstance(encoder, TargetEncoding) else [column]


def encode_categorical_columns(df: DataFrame, fit_df: DataFrame, categorical: list[str], target: str,
                               use_target_encoding: bool = True) -> tuple[DataFrame, FeatureModel]:
    """The categories of ``df`` encoded as fitted on ``fit_df``, and the model that did it."""
    model = _with_encoders(FeatureModel(target, [], [], list(categorical), [], [], []),
                           fit_encoders(fit_df, categorical, target, use_target_encoding))
    return model.encoded(df, None), model


def _with_encoders(model: FeatureModel, encoders: dict[str, tuple]) -> FeatureModel:
    places = {"label": model.labels, "onehot": model.onehots, "target": model.targets}
    for c, (strategy, n, encoder) in encoders.items():
        places[strategy][c] = encoder
        model.details.append(EncodingDetail(c, strategy, n, _outputs(c, encoder)))
    in_place = [c for c in model.raw_features if c not in model.onehots and c not in model.targets]
    model.feature_names = in_place + [o for c in model.raw_features if c not in in_place for o in _outputs(c, encoders[c][2])]
    return model


def fit_feature_model(df: DataFrame, target: str, *, use_target_encoding: bool = True, add_datetime_features: bool = True,
                      exclude_ids: bool = True, date_columns: list[str] | None = None) -> FeatureModel:
    """Everything E5 learns, from the rows ``df``."""
    dates = plan_dates(df, date_columns)
    layouts = {c: x for c, x in dates.items() if x}
    model = FeatureModel(target, list(dates), [], [], [], [], [], date_formats={c: list(x.formats) for c, x in layouts.items()},
                         date_values_lost={c: x.lost for c, x in layouts.items() if x.lost})
    if add_datetime_features and dates:
        model.datetime_features = extract_datetime_features(apply_dates(df, model.date_formats), model.date_columns)[1]
    rows = model.dated(df)
    roles = column_roles(rows, target, exclude_ids, text_dates=False)
    model.raw_features = [c for c in rows.columns if roles[c] in (CATEGORY, VALUE)]
    model.excluded_ids = [c for c in rows.columns if roles[c] == ID]
    model.dropped_columns = [c for c in rows.columns if roles[c] in (ID, DATE)]
    return _with_encoders(model, fit_encoders(rows, [c for c in model.raw_features if roles[c] == CATEGORY], target, use_target_encoding))


def engineer_features(df: DataFrame, target: str, *, use_target_encoding: bool = True, add_datetime_features: bool = True,
                      exclude_ids: bool = True, fit_on: DataFrame | None = None,
                      carry: list[str] | None = None) -> tuple[DataFrame, FeatureModel]:
    """E5: the features of ``df`` (and its target) with the model that makes
    them.  The model is fitted on ``fit_on`` (default: ``df``; pass the
    training rows to avoid target leakage), its date columns are those of
    ``df``.  ``carry`` columns (row keys) pass through and are no features."""
    if target not in df.columns:
        raise ValueError(f"no column {target} to predict")
    keys = [c for c in (carry or []) if c != target]
    rows = (df if fit_on is None else fit_on).drop(*keys)
    model = fit_feature_model(rows, target, use_target_encoding=use_target_encoding, add_datetime_features=add_datetime_features,
                              exclude_ids=exclude_ids, date_columns=None if fit_on is None else get_datetime_columns(df.drop(*keys)))
    return model.transform(df, unseen_label=None, carry=keys), model


def transform_features(df: DataFrame, model: FeatureModel, unseen_label: int = 0,
                       carry: list[str] | None = None) -> DataFrame:
    """``model`` on new rows (unseen label → class 0, unseen one-hot →
    all zeros, unseen target category → training mean)."""
    return model.transform(df, unseen_label, carry)
