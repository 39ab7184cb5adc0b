"""Table cleaning: each step is a function on DataFrames, ``clean`` runs them in the usual order."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.cast import NULL_SENTINELS, as_number, as_time, nan_to_null
from millrace.functions.names import numeric_columns, quoted, string_columns
from millrace.operators.ordering import row_index, trailing
from millrace.operators.quantiles import exact_quantiles
from millrace.session import checkpoint

# Name parts that mark a time column or a signal worth smoothing.
TIME_HINTS = ("date", "time", "timestamp", "datetime", "day")
SIGNAL_HINTS = ("temp", "vib", "pressure", "current", "voltage", "speed")


def c(name: str) -> Column:
    return F.col(quoted(name))


def tidy_names(df: DataFrame) -> DataFrame:
    """Strip column names; of columns that then share a name the first one stays."""
    names = [n.strip() for n in df.columns]
    positions = df.toDF(*[f"_{i}" for i in range(len(names))])
    keep = {n: i for i, n in reversed(list(enumerate(names)))}
    return positions.select(*[F.col(f"_{i}").alias(n) for i, n in enumerate(names) if keep[n] == i])


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.na.drop("all")


def drop_empty_columns(df: DataFrame) -> DataFrame:
    counts = df.agg(*[F.count(c(n)).alias(n) for n in df.columns]).first()
    return df.select(*[c(n) for n in df.columns if counts[n]])


def dedupe(df: DataFrame, key: Sequence[str] | None = None, order_by: Sequence[str] = ()) -> DataFrame:
    """Drop repeated rows; nulls compare equal. With a key the first row along ``order_by`` survives."""
    if not key:
        return df.dropDuplicates()
    rank = F.struct(*[c(n) for n in order_by])
    kept = df.groupBy(*[quoted(k) for k in key]).agg(F.min_by(F.struct(*[c(n) for n in df.columns]), rank).alias("_row"))
    return kept.select("_row.*").select(*[c(n) for n in df.columns])


def null_sentinels(df: DataFrame) -> DataFrame:
    texts = set(string_columns(df))
    return df.select(*[F.when(~c(n).isin(NULL_SENTINELS), c(n)).alias(n) if n in texts else c(n) for n in df.columns])


def cast_texts(df: DataFrame, share: float = 0.8) -> tuple[DataFrame, list[str]]:
    """Text columns that mostly read as numbers become doubles; time-named ones that parse become timestamps."""
    texts = string_columns(df)
    if not texts:
        return df, []
    kind = T.StringType()
    aggs = []
    for i, n in enumerate(texts):
        aggs += [F.count(c(n)).alias(f"n{i}"), F.count(as_number(c(n), kind)).alias(f"x{i}")]
        if any(h in n.lower() for h in TIME_HINTS):
            aggs.append(F.count(as_time(c(n), kind)).alias(f"t{i}"))
    row = df.agg(*aggs).first().asDict()
    new, log = {}, []
    for i, n in enumerate(texts):
        if row[f"n{i}"] and row[f"x{i}"] / row[f"n{i}"] >= share:
            new[n] = as_number(c(n), kind)
            log.append(f"schema cast numeric {n}")
        elif row.get(f"t{i}"):
            new[n] = as_time(c(n), kind)
            log.append(f"schema cast datetime {n}")
    return df.select(*[new[n].alias(n) if n in new else c(n) for n in df.columns]), log


def trend_impute(
    df: DataFrame,
    columns: Sequence[str],
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    rows_per_range: int | None = None,
) -> DataFrame:
    """Fill nulls from the least-squares line over row position; below five known values use the median.

    With ``partition_by`` every group has its own line: inside a group the table-wide index over
    (group, order) is a run of consecutive numbers, so both give the same line.
    """
    columns, groups = list(columns), list(partition_by)
    indexed = row_index(df, groups + list(order_by), "_at", rows_per_range)
    position = F.col("_at").cast("double")
    aggs = []
    for i, n in enumerate(columns):
        x = c(n).cast("double")
        aggs += [
            F.count(x).alias(f"_n{i}"),
            F.regr_slope(x, position).alias(f"_a{i}"),
            F.regr_intercept(x, position).alias(f"_b{i}"),
        ]
    if groups:
        indexed = _with_group_stats(indexed, indexed.groupBy(*[quoted(g) for g in groups]).agg(*aggs), groups)
        medians = [
            F.percentile(F.when(F.col(f"_n{i}") < 5, c(n).cast("double")), 0.5).alias(f"_m{i}")
            for i, n in enumerate(columns)
        ]
        indexed = _with_group_stats(indexed, indexed.groupBy(*[quoted(g) for g in groups]).agg(*medians), groups)
        stat = F.col
    else:
        row = indexed.agg(*aggs).first().asDict()
        short = [i for i in range(len(columns)) if 0 < row[f"_n{i}"] < 5]
        if short:
            few = [F.percentile(c(columns[i]).cast("double"), 0.5).alias(f"_m{i}") for i in short]
            row.update(df.agg(*few).first().asDict())
        stat = lambda key: F.lit(row.get(key)).cast("long" if key.startswith("_n") else "double")
    filled = {}
    for i, n in enumerate(columns):
        line = stat(f"_b{i}") + stat(f"_a{i}") * position
        guess = F.when(stat(f"_n{i}") >= 5, line).otherwise(stat(f"_m{i}"))
        filled[n] = F.coalesce(c(n).cast("double"), guess).alias(n)
    return indexed.select(*[filled.get(n, c(n)) for n in df.columns])


def _with_group_stats(df: DataFrame, stats: DataFrame, groups: Sequence[str]) -> DataFrame:
    renamed = stats.withColumnsRenamed({g: f"_g{i}" for i, g in enumerate(groups)})
    match = F.lit(True)
    for i, g in enumerate(groups):
        match = match & c(g).eqNullSafe(F.col(f"_g{i}"))
    return df.join(renamed, match, "left").drop(*[f"_g{i}" for i in range(len(groups))])


def median_impute(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    columns = list(columns)
    medians = exact_quantiles(df, {n: c(n) for n in columns}, [0.5])
    fill = {n: F.coalesce(c(n).cast("double"), F.lit(medians[n][0]).cast("double")).alias(n) for n in columns}
    return df.select(*[fill.get(n, c(n)) for n in df.columns])


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n): the most frequent text of every column, the smallest one on ties."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("column"), c(n).alias("value")) for n in columns]))
    counts = (
        df.select(pairs.alias("p")).select("p.*").where(F.col("value").isNotNull()).groupBy("column", "value").count()
    )
    best = F.min(F.struct((-F.col("count")).alias("rank"), F.col("value").alias("value"))).alias("best")
    return counts.groupBy("column").agg(best).select(
        "column", F.col("best.value").alias("value"), (-F.col("best.rank")).alias("n")
    )


def mode_impute(df: DataFrame, columns: Sequence[str] | None = None, empty: str = "Unknown") -> DataFrame:
    columns = string_columns(df) if columns is None else list(columns)
    if not columns:
        return df
    best = {r["column"]: r["value"] for r in modes(df, columns).collect()}
    fill = {n: F.coalesce(c(n), F.lit(best.get(n, empty))).alias(n) for n in columns}
    return df.select(*[fill.get(n, c(n)) for n in df.columns])


def bin_edges(df: DataFrame, columns: Sequence[str], q: int | None = None) -> dict[str, list[float]]:
    """Quantile edges without repeats. Without ``q`` a column with fewer than five values gets fewer bins."""
    columns = list(columns)
    want = {n: q for n in columns}
    if q is None:
        rough = df.agg(*[F.approx_count_distinct(c(n)).alias(f"d{i}") for i, n in enumerate(columns)]).first()
        narrow = [n for i, n in enumerate(columns) if rough[f"d{i}"] <= 50]
        exact = df.agg(F.lit(0), *[F.count_distinct(c(n)).alias(n) for n in narrow]).first().asDict() if narrow else {}
        want = {n: min(5, max(2, exact.get(n, 5))) for n in columns}
    edges = {}
    for bins in sorted(set(want.values())):
        group = {n: c(n) for n in columns if want[n] == bins}
        for n, cuts in exact_quantiles(df, group, [i / bins for i in range(bins + 1)]).items():
            known = [x for x in cuts if x is not None]
            edges[n] = sorted(set(known))
    return edges


def bin_number(column: Column, edges: Sequence[float]) -> Column:
    """1-based bin of intervals (lo, hi], the first one closed; NULL when there are no two edges."""
    if len(edges) < 2:
        return F.lit(None).cast("int")
    number = F.lit(1)
    for edge in edges[1:-1]:
        number = number + F.when(column > edge, 1).otherwise(0)
    return F.when(column.isNotNull(), number.cast("int"))


def _shorten(x: float, digits: int) -> float:
    """Three decimals, or as many significant digits below one."""
    if x != 0 and abs(x) < 1:
        digits += -math.floor(math.log10(abs(x))) - 1
    return round(x, digits)


def bin_labels(edges: Sequence[float]) -> list[str]:
    """Interval texts; digits are added until the shortened edges differ, and the first edge opens a little below."""
    digits = next((d for d in range(3, 20) if len({_shorten(e, d) for e in edges}) == len(edges)), 3)
    shown = [_shorten(e, digits) for e in edges]
    if shown:
        shown[0] = _shorten(shown[0] - 10.0**-digits, digits)
    return [f"({a}, {b}]" for a, b in zip(shown, shown[1:])]


def quantile_bins(
    df: DataFrame, columns: Sequence[str], q: int | None = None, suffix: str = "_bin", number_suffix: str | None = None
) -> DataFrame:
    """Add the interval text of every column's quantile bin, and the bin number when asked for."""
    edges = bin_edges(df, columns, q)
    new = {}
    for n in columns:
        number = bin_number(c(n), edges[n])
        labels = bin_labels(edges[n])
        text = F.lit(None).cast("string")
        if labels:
            text = F.element_at(F.array(*[F.lit(x) for x in labels]), number)
        new[n + suffix] = text
        if number_suffix:
            new[n + number_suffix] = number
    return df.withColumns(new)


def smooth(
    df: DataFrame,
    columns: Sequence[str],
    order_by: Sequence[str],
    window: int | None = None,
    partition_by: Sequence[str] = (),
    suffix: str = "_smooth",
    rows_per_range: int | None = None,
) -> DataFrame:
    """Trailing mean over ``window`` rows, nulls skipped; the default width follows the table size."""
    if window is None:
        window = min(5, max(2, df.count() // 10))
    means = {
        n + suffix: (lambda w, n=n: F.avg(c(n).cast("double")).over(w.rowsBetween(-(window - 1), 0))) for n in columns
    }
    return trailing(df, means, window - 1, order_by, partition_by, rows_per_range)


def znorm(df: DataFrame, columns: Sequence[str], suffix: str = "_z") -> DataFrame:
    aggs = []
    for i, n in enumerate(columns):
        aggs += [F.avg(c(n).cast("double")).alias(f"m{i}"), F.stddev_samp(c(n).cast("double")).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    scaled = {}
    for i, n in enumerate(columns):
        mean, std = F.lit(row[f"m{i}"]).cast("double"), F.lit(row[f"s{i}"]).cast("double")
        scaled[n + suffix] = (c(n).cast("double") - mean) / (std + F.lit(1e-9))
    return df.withColumns(scaled)


def lab_transforms(
    df: DataFrame,
    order_by: Sequence[str],
    bin_columns: Sequence[str] = (),
    smooth_columns: Sequence[str] = (),
    normalise_columns: Sequence[str] = (),
) -> tuple[DataFrame, list[str]]:
    """The SQL lab's quartile bins, trailing means over 3 to 12 rows and z-scores."""
    numbers, log = set(numeric_columns(df)), []
    bins, means, scales = ([n for n in names if n in numbers] for names in (bin_columns, smooth_columns, normalise_columns))
    if bins:
        df = quantile_bins(df, bins, 4, "_dwdm_bin")
        log += [f"binned {n}" for n in bins]
    if means:
        window = min(12, max(3, df.count() // 20))
        df = smooth(df, means, order_by, window, suffix="_dwdm_smooth")
        log += [f"smoothed {n}" for n in means]
    if scales:
        df = znorm(df, scales)
        log += [f"z-normalised {n}" for n in scales]
    return df, log


def clean(
    df: DataFrame,
    order_by: Sequence[str],
    impute: str = "trend",
    partition_by: Sequence[str] = (),
    bins: bool = True,
    smoothing: bool = True,
    bin_first: int | None = None,
) -> tuple[DataFrame, list[str]]:
    """The full cleaning run. ``impute="median"`` is the variant that drops empty columns and fills medians.

    ``order_by`` gives the row order that positions and trailing means follow, ending in a unique column. Binning takes
    the first ``bin_first`` numeric columns, all by default.
    """
    log = ["strip column names"]
    out = drop_empty_rows(nan_to_null(tidy_names(df)))
    if impute == "median":
        out = drop_empty_columns(out)
    out = null_sentinels(dedupe(out))
    log += ["drop empty rows", "drop duplicate rows", "null sentinels"]
    # Everything below aggregates this table several times; written once, the dedupe is not repeated.
    out, casts = cast_texts(checkpoint(out))
    log += casts
    numbers, texts = numeric_columns(out), string_columns(out)
    gaps = out.agg(F.lit(0), *[F.count_if(c(n).isNull()).alias(n) for n in numbers + texts]).first().asDict()
    holes = [n for n in numbers if gaps[n]]
    if holes and impute == "median":
        out = median_impute(out, holes)
    elif holes:
        out = trend_impute(out, holes, order_by, partition_by)
    log += [f"{impute} imputation {n}" for n in holes]
    blanks = [n for n in texts if gaps[n]]
    if blanks and impute == "median":
        out = out.na.fill("Unknown", blanks)
    elif blanks:
        out = mode_impute(out, blanks)
    log += [f"text imputation {n}" for n in blanks]
    signals = [n for n in numbers if any(h in n.lower() for h in SIGNAL_HINTS)]
    if holes and ((bins and numbers) or (smoothing and signals)):
        out = checkpoint(out)
    if bins and numbers:
        binned = numbers[:bin_first]
        out = quantile_bins(out, binned)
        log += [f"binning {n}" for n in binned]
    if smoothing and signals:
        out = smooth(out, signals, order_by, partition_by=partition_by)
        log += [f"smoothing {n}" for n in signals]
    return out, log
