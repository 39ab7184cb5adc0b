"""The quality report: nineteen checks as rows, computed from a few shared aggregations."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property
from threading import Lock

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.cast import number
from millrace.functions.names import numeric_columns, quoted, resolve, string_columns
from millrace.operators.anomaly import anomaly_summary
from millrace.operators.baskets import association_of_highs
from millrace.operators.density import dbscan_summary
from millrace.operators.ordering import row_index, trailing
from millrace.operators.profile import profile_rows, time_name
from millrace.operators.quantiles import exact_quantiles
from millrace.operators.windows import step_over

# Signal name parts and the jump that is physically impossible for them.
JUMP_LIMITS = {"temp": 50.0, "vib": 5.0, "pressure": 30.0, "speed": None, "current": None}

CHECK_SCHEMA = "check string, status string, detail string, metrics map<string,double>"


def c(name: str) -> Column:
    return F.col(quoted(name))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of every set of equal rows."""
    groups = df.groupBy(*[quoted(n) for n in df.columns]).agg(F.count("*").alias("copies"))
    return groups.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))


def outlier_counts(df: DataFrame, columns: Sequence[str] | None = None, quartiles: dict | None = None) -> DataFrame:
    """Per numeric column: values beyond three deviations and beyond Tukey's fences."""
    columns = list(columns or numeric_columns(df))
    values = {n: number(df, n) for n in columns}
    quartiles = quartiles or exact_quantiles(df, values, [0.25, 0.75])
    moments = []
    for i, n in enumerate(columns):
        moments += [F.avg(values[n]).alias(f"m{i}"), F.stddev_samp(values[n]).alias(f"s{i}"), F.count(values[n]).alias(f"n{i}")]
    row = df.agg(*moments).first()
    aggs, used = [], []
    for i, n in enumerate(columns):
        if row[f"n{i}"] < 5:
            continue
        used.append((i, n))
        z = F.abs((values[n] - row[f"m{i}"]) / (row[f"s{i}"] + 1e-9))
        aggs.append(F.count_if(z > 3).alias(f"z{i}"))
        q1, q3 = quartiles[n]
        fence = 1.5 * (q3 - q1)
        beyond = (values[n] < q1 - fence) | (values[n] > q3 + fence)
        aggs.append((F.count_if(beyond) if fence else F.lit(0).cast("long")).alias(f"q{i}"))
    one = df.agg(F.count("*").alias("rows"), *aggs)
    rows = [
        F.struct(F.lit(n).alias("column"), F.col(f"z{i}").alias("z_hits"), F.col(f"q{i}").alias("iqr_hits"))
        for i, n in used
    ]
    if not rows:
        return df.sparkSession.createDataFrame([], "column string, z_hits bigint, iqr_hits bigint")
    return one.select(F.inline(F.array(*rows)))


def signals(df: DataFrame) -> list[str]:
    return [n for n in numeric_columns(df) if any(h in n.lower() for h in JUMP_LIMITS)]


def jump_limit(name: str, deviation: float | None) -> float:
    for part in ("temp", "vib", "pressure"):
        if part in name.lower():
            return JUMP_LIMITS[part]
    return (deviation or 1.0) * 4


def with_steps(df: DataFrame, names: Sequence[str], order_by: Sequence[str], partition_by: Sequence[str] = (), **options):
    """Add ``<name>_step``, the change from the previous row, reading the table once for all columns."""
    helpers = {f"_s_{n}": number(df, n) for n in names}
    made = {f"{n}_step": step_over(f"_s_{n}") for n in names}
    return trailing(df.withColumns(helpers), made, 1, order_by, partition_by, **options).drop(*helpers)


def impossible_jumps(
    df: DataFrame, order_by: Sequence[str], partition_by: Sequence[str] = (), **options
) -> DataFrame:
    names = signals(df)
    if not names:
        return df.sparkSession.createDataFrame([], "column string, limit double, jumps bigint")
    spread = df.agg(*[F.stddev_samp(number(df, n)).alias(f"s{i}") for i, n in enumerate(names)]).first()
    limits = {n: jump_limit(n, spread[f"s{i}"]) for i, n in enumerate(names)}
    narrow = df.select(*[c(n) for n in dict.fromkeys([*partition_by, *order_by, *names])])
    stepped = with_steps(narrow, names, order_by, partition_by, **options)
    one = stepped.agg(*[F.count_if(F.abs(c(f"{n}_step")) > limits[n]).alias(f"j{i}") for i, n in enumerate(names)])
    rows = [
        F.struct(F.lit(n).alias("column"), F.lit(limits[n]).alias("limit"), F.col(f"j{i}").alias("jumps"))
        for i, n in enumerate(names)
    ]
    return one.select(F.inline(F.array(*rows)))


def sensor_correlations(df: DataFrame) -> DataFrame:
    """Pairwise correlation of temperature, pressure and vibration; below 0.05 either way counts as dead."""
    t = resolve(df.columns, "temperature", "temp")
    p = resolve(df.columns, "pressure")
    v = resolve(df.columns, "vibration", "vib")
    pairs = [(a, b) for a, b in ((t, p), (t, v), (p, v)) if a and b]
    if not pairs:
        return df.sparkSession.createDataFrame([], "pair string, corr double, dead boolean")
    return correlations(df, pairs).withColumn("dead", F.coalesce(F.abs("corr") < 0.05, F.lit(False)))


def pair_correlations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(row, col, corr): Pearson correlation per pair; a row counts for a pair when both values are there."""
    aggs = []
    for i, (a, b) in enumerate(pairs):
        x, y = number(df, a), number(df, b)
        both = x.isNotNull() & y.isNotNull()
        value = F.corr(F.when(both, x), F.when(both, y))
        aggs.append(F.when(~F.isnan(value), value).alias(f"c{i}"))
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(a).alias("row"), F.lit(b).alias("col"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)]
    return one.select(F.inline(F.array(*rows)))


def correlations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(pair, corr) with the two names joined by a bar."""
    return pair_correlations(df, pairs).select(F.concat_ws("|", "row", "col").alias("pair"), "corr")


def physics_rules(df: DataFrame, order_by: Sequence[str], partition_by: Sequence[str] = (), **options) -> DataFrame:
    """(rule, rows, violated): stuck sensor, leak, rising remaining life, missed failures."""
    t = resolve(df.columns, "temperature", "temp")
    v = resolve(df.columns, "vibration", "vib")
    p = resolve(df.columns, "pressure")
    r = resolve(df.columns, "rul")
    f = resolve(df.columns, "failure", "fault")
    speed = resolve(df.columns, "speed", "flow", "load")
    stepped = [n for n in dict.fromkeys([p if p and speed else None, speed if p else None, r]) if n]
    used = [n for n in dict.fromkeys([*partition_by, *order_by, t, v, p, r, f, speed]) if n]
    data = df.select(*[c(n) for n in used])
    if stepped:
        data = with_steps(data, stepped, order_by, partition_by, **options)
    rules: list[tuple[str, Column, Column]] = []
    if t and v:
        n = F.count_if((number(df, t) > 150) & (number(df, v) < 0.1))
        rules.append(("sensor stuck (temp>150 & vib<0.1)", n, n > 0))
    if p and speed:
        n = F.count_if((c(f"{p}_step") < -10) & (F.abs(c(f"{speed}_step")) < 0.5))
        rules.append(("leak or sensor fault", n, n > 0))
    if r:
        n = F.count_if(c(f"{r}_step") > 0)
        rules.append(("remaining life rises", n, F.coalesce(n / F.nullif(F.count(c(f"{r}_step")), F.lit(0)) > 0.6, F.lit(False))))
    if f and v:
        m = df.agg(F.avg(number(df, v)).alias("m"), F.stddev_samp(number(df, v)).alias("s")).first()
        high = number(df, v) > (m["m"] or 0.0) + 3 * (m["s"] or 1.0)
        n = F.count_if((F.coalesce(number(df, f), F.lit(0.0)) == 0) & high)
        rules.append(("possible missed failures", n, n > 0))
    if not rules:
        return df.sparkSession.createDataFrame([], "rule string, rows bigint, violated boolean")
    one = data.agg(
        *[n.alias(f"n{i}") for i, (_, n, _) in enumerate(rules)],
        *[bad.alias(f"b{i}") for i, (_, _, bad) in enumerate(rules)],
    )
    rows = [
        F.struct(F.lit(name).alias("rule"), F.col(f"n{i}").alias("rows"), F.col(f"b{i}").alias("violated"))
        for i, (name, _, _) in enumerate(rules)
    ]
    return one.select(F.inline(F.array(*rows)))


def expectations(
    df: DataFrame,
    order_by: Sequence[str] = (),
    partition_by: Sequence[str] = (),
    max_rows: int = 5_000_000,
    **options,
) -> DataFrame:
    """(expectation, column, success, observed) rows."""
    t = resolve(df.columns, "temperature", "temp")
    r = resolve(df.columns, "rul")
    when = resolve(df.columns, "timestamp", "time", "datetime", "date")
    machine = resolve(df.columns, "machine_id", "machine", "asset_id")
    aggs = [F.count("*").alias("rows")]
    for i, n in enumerate(df.columns):
        aggs.append(F.count_if(c(n).isNull()).alias(f"null{i}"))
    if t:
        aggs += [F.min(number(df, t)).alias("t_min"), F.max(number(df, t)).alias("t_max")]
    row = df.agg(*aggs).first().asDict()
    total = row["rows"]
    out = []
    for i, n in enumerate(df.columns):
        share = row[f"null{i}"] / total if total else 0.0
        out.append(("not_null", n, share < 0.2, share))
    if t:
        known = row["t_min"] is not None
        out.append(("between_0_and_200", t, known and row["t_min"] >= 0 and row["t_max"] <= 200, row["t_max"]))
    if r and order_by:
        known = df.where(number(df, r).isNotNull()).select(*[c(n) for n in dict.fromkeys([*partition_by, *order_by, r])])
        steps = with_steps(known, [r], order_by, partition_by, **options).agg(
            F.count(c(f"{r}_step")).alias("n"), F.count_if(c(f"{r}_step") <= 0).alias("down")
        ).first()
        rate = steps["down"] / steps["n"] if steps["n"] else 1.0
        out.append(("mostly_non_increasing", r, steps["n"] < 3 or rate >= 0.5, rate))
    if when and machine:
        keys = df.groupBy(c(when), c(machine)).agg(F.count("*").alias("k"))
        extra = keys.agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("d")).first()["d"]
        out.append(("unique_pair", f"{when}+{machine}", extra == 0, float(extra)))
    out.append(("row_count_between", "*", 1 <= total <= max_rows, float(total)))
    rows = [(a, b, bool(s), None if o is None else float(o)) for a, b, s, o in out]
    return df.sparkSession.createDataFrame(rows, "expectation string, column string, success boolean, observed double")


def dirty_labels(df: DataFrame) -> DataFrame:
    """Failures with low vibration and non-failures with extreme vibration."""
    label = resolve(df.columns, "failure", "fault", "label", "churn", "default")
    vib = resolve(df.columns, "vibration", "vib")
    if not label or not vib:
        return df.sparkSession.createDataFrame([], "flag string, rows bigint")
    v, f = number(df, vib), F.coalesce(number(df, label), F.lit(0.0))
    low, high = exact_quantiles(df, {"v": v}, [0.2, 0.95])["v"]
    one = df.agg(
        F.count_if((f == 1) & (v < F.lit(low))).alias("a"), F.count_if((f == 0) & (v > F.lit(high))).alias("b")
    )
    rows = [
        F.struct(F.lit("failure with low vibration").alias("flag"), F.col("a").alias("rows")),
        F.struct(F.lit("no failure with extreme vibration").alias("flag"), F.col("b").alias("rows")),
    ]
    return one.select(F.inline(F.array(*rows)))


def _vectors(df: DataFrame, columns: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Complete rows as vectors scaled to mean 0 and deviation 1."""
    full = df.select(*[c(n) for n in extra], *[number(df, n).alias(f"x{i}") for i, n in enumerate(columns)]).na.drop()
    raw = VectorAssembler(inputCols=[f"x{i}" for i in range(len(columns))], outputCol="raw").transform(full)
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(raw)
    return scaler.transform(raw)


def far_from_centre(df: DataFrame, columns: Sequence[str] | None = None, k: int = 3) -> DataFrame:
    """Rows farther from their cluster centre than mean + 2 deviations of that distance."""
    columns = list(columns or numeric_columns(df))
    data = _vectors(df, columns)
    model = KMeans(k=k, seed=42, maxIter=30).fit(data)
    centres = F.array(*[F.array(*[F.lit(float(v)) for v in centre]) for centre in model.clusterCenters()])
    point = vector_to_array("features")
    gap = F.zip_with(point, F.element_at(centres, F.col("prediction") + 1), lambda a, b: (a - b) * (a - b))
    distance = F.sqrt(F.aggregate(gap, F.lit(0.0), lambda acc, v: acc + v))
    placed = model.transform(data).select(distance.alias("d"))
    stats = placed.agg(F.avg("d").alias("m"), F.stddev_pop("d").alias("s")).first()
    limit = stats["m"] + 2 * stats["s"]
    return placed.agg(F.count("*").alias("rows"), F.count_if(F.col("d") > limit).alias("far_from_cluster"))


def explained_share(df: DataFrame, columns: Sequence[str], components: int = 3) -> float:
    data = _vectors(df, columns)
    # A constant column scales to zero and carries no variance.
    return float(sum(PCA(k=min(components, len(columns)), inputCol="features", outputCol="pc").fit(data).explainedVariance))


def pca_drift(df: DataFrame, order_by: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Variance explained by three components in the first and the second half of the rows."""
    columns = list(columns or numeric_columns(df))
    full = df.na.drop(subset=columns)
    indexed = row_index(full, order_by, "_at")
    half = full.count() // 2
    early = explained_share(indexed.where(F.col("_at") < half), columns)
    late = explained_share(indexed.where(F.col("_at") >= half), columns)
    drift = abs(early - late)
    row = [(early, late, drift, drift > 0.15)]
    return df.sparkSession.createDataFrame(row, "early double, late double, drift double, concept_drift boolean")


def high_cardinality(profile: dict) -> list[str]:
    return [n for n, p in profile.items() if p["distinct"] > max(50, p["rows"] // 2)]


class _Report:
    """The checks of one table. What several checks need is computed once, on first use."""

    def __init__(self, df: DataFrame, order_by: Sequence[str], partition_by: Sequence[str], max_rows: int):
        self.df, self.order_by, self.partition_by, self.max_rows = df, list(order_by), list(partition_by), max_rows
        self.numbers = numeric_columns(df)
        self._lock = Lock()

    @cached_property
    def profile(self) -> dict:
        return profile_rows(self.df, times=False)

    @cached_property
    def rows(self) -> int:
        return next((p["rows"] for p in self.profile.values()), 0)

    @cached_property
    def complete(self) -> int:
        return self.df.na.drop(subset=self.numbers).count() if self.numbers else 0

    @cached_property
    def outliers(self) -> list:
        return outlier_counts(self.df, self.numbers).collect() if self.numbers else []

    def _outliers(self) -> list:
        with self._lock:
            return self.outliers

    def _short(self, check: str, need: int):
        if len(self.numbers) >= 2 and self.complete >= need:
            return None
        return _row(check, "INFO", f"needs two numeric columns and {need} complete rows")

    def missing(self):
        cells = max(1, self.rows * len(self.df.columns))
        share = sum(p["rows"] - p["non_null"] for p in self.profile.values()) / cells
        return _row("missing", "FAIL" if share > 0.2 else "WARN" if share > 0.05 else "PASS", f"{share:.2%} missing", share=share)

    def constant(self):
        names = [n for n, p in self.profile.items() if p["constant"]]
        return _row("constant", "FAIL" if names else "PASS", ", ".join(names) or "none", columns=len(names))

    def zeros(self):
        share = sum(self.profile[n]["zeros"] for n in self.numbers) / max(1, self.rows * len(self.numbers))
        return _row("zeros", "WARN" if share > 0.3 else "PASS", f"{share:.1%} zeros", share=share)

    def duplicates(self):
        n = duplicate_rows(self.df).first()["duplicate_rows"]
        return _row("duplicates", "WARN" if n else "PASS", f"{n} duplicate rows", rows=n)

    def z_score(self):
        n = sum(o["z_hits"] for o in self._outliers())
        return _row("z_score", "WARN" if n else "PASS", f"{n} hits", rows=n)

    def iqr(self):
        n = sum(o["iqr_hits"] for o in self._outliers())
        return _row("iqr", "WARN" if n else "PASS", f"{n} hits", rows=n)

    def isolation_forest(self):
        short = self._short("isolation_forest", 15)
        if short:
            return short
        n = anomaly_summary(self.df, self.numbers).first()["anomalies"]
        return _row("isolation_forest", "WARN" if n else "PASS", f"{n} anomalies", rows=n)

    def dbscan_noise(self):
        short = self._short("dbscan_noise", 20)
        if short:
            return short
        found = dbscan_summary(self.df, self.numbers).first()
        n = found["noise_points"]
        return _row("dbscan_noise", "WARN" if n else "PASS", f"{n} noise points", rows=n, clusters=found["clusters"])

    def kmeans_distance(self):
        short = self._short("kmeans_distance", 20)
        if short:
            return short
        n = far_from_centre(self.df, self.numbers).first()["far_from_cluster"]
        return _row("kmeans_distance", "WARN" if n else "PASS", f"{n} far from their cluster", rows=n)

    def impossible_jump(self):
        jumps = [j for j in impossible_jumps(self.df, self.order_by, self.partition_by).collect() if j["jumps"]]
        n = sum(j["jumps"] for j in jumps)
        return _row("impossible_jump", "FAIL" if n else "PASS", ", ".join(f"{j['column']}:{j['jumps']}" for j in jumps) or "none", rows=n)

    def sensor_correlation(self):
        dead = [r["pair"] for r in sensor_correlations(self.df).collect() if r["dead"]]
        return _row("sensor_correlation", "WARN" if dead else "PASS", ", ".join(dead) or "none", pairs=len(dead))

    def expectations(self):
        found = expectations(self.df, self.order_by, self.partition_by, self.max_rows).collect()
        passed = sum(e["success"] for e in found)
        return _row("expectations", "PASS" if passed == len(found) else "WARN", f"{passed}/{len(found)} passed", passed=passed, total=len(found))

    def cardinality(self):
        wide = high_cardinality(self.profile)
        return _row("cardinality", "WARN" if wide else "PASS", ", ".join(wide) or "none", columns=len(wide))

    def dirty_labels(self):
        flags = [r for r in dirty_labels(self.df).collect() if r["rows"]]
        n = sum(r["rows"] for r in flags)
        return _row("dirty_labels", "WARN" if flags else "PASS", "; ".join(f"{r['rows']} rows: {r['flag']}" for r in flags) or "none", rows=n)

    def pca_drift(self):
        short = self._short("pca_drift", 30)
        if short:
            return short
        found = pca_drift(self.df, self.order_by, self.numbers).first()
        return _row("pca_drift", "WARN" if found["concept_drift"] else "PASS", f"drift {found['drift']:.3f}", drift=found["drift"])

    def physics_rules(self):
        broken = [r for r in physics_rules(self.df, self.order_by, self.partition_by).collect() if r["violated"]]
        return _row("physics_rules", "FAIL" if broken else "PASS", "; ".join(f"{r['rule']}: {r['rows']} rows" for r in broken) or "none", rules=len(broken))

    def association(self):
        texts = [n for n in string_columns(self.df) if self.profile[n]["distinct"] <= 12]
        n = association_of_highs(self.df, texts, self.numbers).where("suspicious").count()
        return _row("association", "WARN" if n else "PASS", f"{n} suspicious rules", rows=n)

    def rowcount(self):
        width = len(self.df.columns)
        return _row("rowcount", "PASS" if self.rows else "FAIL", f"{self.rows} rows x {width} columns", rows=self.rows, columns=width)

    def timestamp(self):
        when = time_name(self.df.columns)
        return _row("timestamp", "PASS" if when else "WARN", when or "missing")


CHECKS = (
    "missing", "constant", "zeros", "duplicates", "z_score", "iqr", "isolation_forest", "dbscan_noise",
    "kmeans_distance", "impossible_jump", "sensor_correlation", "expectations", "cardinality", "dirty_labels",
    "pca_drift", "physics_rules", "association", "rowcount", "timestamp",
)


def quality_report(
    df: DataFrame,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    max_rows: int = 5_000_000,
    checks: Sequence[str] = CHECKS,
    parallel: int = 4,
) -> DataFrame:
    """The checks as (check, status, detail, metrics) rows, in the order of ``CHECKS``."""
    report = _Report(df, order_by, partition_by, max_rows)
    # Shared figures first; the checks then run as concurrent jobs.
    _ = report.profile, report.complete
    with ThreadPoolExecutor(parallel) as pool:
        rows = list(pool.map(lambda name: getattr(report, name)(), [n for n in CHECKS if n in checks]))
    return df.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"place int, {CHECK_SCHEMA}")


def _row(check: str, status: str, detail: str, **metrics: float):
    return check, status, detail, {k: float(v) for k, v in metrics.items()}


def fail_lines(report: DataFrame, limit: int = 2) -> DataFrame:
    """The first failed or warned checks as sentences."""
    bad = report.where(F.upper("status").isin("FAIL", "WARN")).orderBy("place").limit(limit)
    return bad.select(F.concat(F.lit("Quality "), "check", F.lit(": "), "detail").alias("line"))
