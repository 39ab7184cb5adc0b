"""Equi-joins in which a missing key matches a missing key, and chains of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from millrace.functions.names import quoted

JOIN_TYPES = ("inner", "left", "right", "outer")

# Key names offered first when both tables have them.
PREFERRED_KEYS = {"machine_id", "asset_id", "id", "timestamp", "date", "customer_id", "sku"}


def suggest_keys(left: DataFrame, right: DataFrame) -> list[str]:
    shared = sorted(set(left.columns) & set(right.columns))
    return sorted(shared, key=lambda c: c.lower() not in PREFERRED_KEYS)


def join_two(
    left: DataFrame,
    right: DataFrame,
    how: str = "inner",
    on: Sequence[str] | None = None,
    left_on: str | None = None,
    right_on: str | None = None,
    suffixes: tuple[str, str] = ("_l", "_r"),
    null_safe: bool = True,
    spread: bool = False,
) -> tuple[DataFrame, dict]:
    """Join two tables. Returns the lazy result and what was joined on.

    ``spread`` is for keys of few values: the left rows are dealt out one by one over as many tasks as the result
    needs, and each task meets all right rows of a key.
    """
    how = (how or "inner").lower()
    if how not in JOIN_TYPES:
        raise ValueError(f"join type must be one of {JOIN_TYPES}, not {how}")
    meta: dict = {"how": how}
    keys = [k for k in (on or []) if k]
    if not keys and left_on and right_on:
        pairs, shared = [(left_on, right_on)], []
        meta["keys"] = [left_on, right_on]
    else:
        if not keys:
            keys = suggest_keys(left, right)[:1]
            meta["auto_key"] = True
        if not keys:
            raise ValueError("the tables share no column; name the join keys")
        pairs, shared = [(k, k) for k in keys], keys
        meta["keys"] = keys

    clash = (set(left.columns) & set(right.columns)) - set(shared)
    left_names = {c: c + suffixes[0] if c in clash else c for c in left.columns}
    right_names = {c: c + suffixes[1] if c in clash else c for c in right.columns}
    l = left.select(*[F.col(quoted(c)).alias(f"l_{i}") for i, c in enumerate(left.columns)])
    r = right.select(*[F.col(quoted(c)).alias(f"r_{i}") for i, c in enumerate(right.columns)])
    l_pos = {c: f"l_{i}" for i, c in enumerate(left.columns)}
    r_pos = {c: f"r_{i}" for i, c in enumerate(right.columns)}
    condition = F.lit(True)
    for a, b in pairs:
        x, y = F.col(l_pos[a]), F.col(r_pos[b])
        condition = condition & (x.eqNullSafe(y) if null_safe else x == y)

    if spread:
        l, r, condition = _spread(l, r, condition, how, [(l_pos[a], r_pos[b]) for a, b in pairs])

    if how == "outer":
        # A left join plus the unmatched right rows: unlike a full join, both can be split under skew.
        matched = l.join(r, condition, "left")
        lost = r.join(l.select(*[l_pos[a] for a, _ in pairs]), condition, "left_anti")
        joined = matched.unionByName(lost, allowMissingColumns=True)
    else:
        joined = l.join(r, condition, how)

    select = []
    for c in left.columns:
        column = F.col(l_pos[c])
        if c in shared:
            column = {"right": F.col(r_pos[c]), "outer": F.coalesce(column, F.col(r_pos[c]))}.get(how, column)
        select.append(column.alias(left_names[c]))
    select += [F.col(r_pos[c]).alias(right_names[c]) for c in right.columns if c not in shared]
    out = joined.select(*select)
    meta["columns"] = out.columns
    return out, meta


# Rows that one task of a spread join may give, tasks it may have, and right rows that may be sent to all of them.
SPREAD_ROWS, SPREAD_TASKS, SPREAD_SENT = 4_000_000, 20_000, 1_000_000


def _spread(l: DataFrame, r: DataFrame, condition: Column, how: str, pairs: Sequence[tuple[str, str]]) -> tuple[DataFrame, DataFrame, Column]:
    """Both sides so that left rows of one key meet the right ones in as many tasks as their pairs need.

    The left rows are dealt by all their columns, so a task that runs again deals alike. Few right rows are sent to all tasks;
    more are repeated for every piece of the left side.
    """
    if how not in ("inner", "left"):
        raise ValueError("only inner and left joins can be spread")
    a = l.groupBy(*[x for x, _ in pairs]).agg(F.count("*").alias("n"))
    b = r.groupBy(*[y for _, y in pairs]).agg(F.count("*").alias("m"))
    made = F.col("n").cast("double") * F.col("m") / SPREAD_ROWS
    found = a.join(b, condition).agg(F.ceil(F.sum(made)).alias("tasks"), F.max(F.least("n", F.ceil(made))).alias("pieces"), F.sum("m").alias("right")).first()
    tasks, pieces = (min(SPREAD_TASKS, found[n] or 1) for n in ("tasks", "pieces"))
    if tasks == 1:
        return l, r, condition
    if found["right"] <= SPREAD_SENT:
        # Rows of the right side without a partner are in neither result.
        return l.repartition(tasks, *l.columns), F.broadcast(r.join(a.drop("n"), condition, "left_semi")), condition
    l = l.withColumn("_piece", F.pmod(F.xxhash64(*l.columns), F.lit(pieces)).cast("int"))
    r = r.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    return l, r.hint("merge"), condition & (F.col("_piece") == F.col("_part"))


def join_totals(left: DataFrame, right: DataFrame, on: Sequence[str], sums: Mapping[str, str], count: str = "pairs", null_safe: bool = True) -> DataFrame:
    """Per key, the rows of the inner join and sums of columns over them, without making the rows.

    ``sums`` maps a column of either table, as `l.name` or `r.name`, to its name in the result. Each side is summed by key first;
    a sum then counts as often as the other side has rows.
    """
    sides = []
    for mark, side in (("l", left), ("r", right)):
        wanted = [c for c in sums if c.startswith(f"{mark}.")]
        adds = [F.sum(F.col(quoted(c[2:]))).alias(f"_{mark}{i}") for i, c in enumerate(wanted)]
        sides.append((side.groupBy(*[F.col(quoted(k)) for k in on]).agg(F.count("*").alias(f"_{mark}n"), *adds), wanted))
    (a, from_left), (b, from_right) = sides
    joined, _ = join_two(a, b, "inner", on=on, null_safe=null_safe)
    named = {c: (F.col(f"_l{i}") * F.col("_rn")) for i, c in enumerate(from_left)} | {c: (F.col(f"_r{i}") * F.col("_ln")) for i, c in enumerate(from_right)}
    return joined.select(*[F.col(quoted(k)) for k in on], (F.col("_ln") * F.col("_rn")).alias(count), *[named[c].alias(n) for c, n in sums.items()])


def join_many(
    tables: Mapping[str, DataFrame], steps: Sequence[Mapping], count_rows: bool = False
) -> tuple[DataFrame, list[dict]]:
    """Fold join steps; ``_result`` names the running result.

    With ``count_rows`` every log entry carries an Observation (``rows``) that is filled by the first action on
    the result, so counting costs no extra job.
    """
    if not tables or not steps:
        raise ValueError("name at least one table and one join step")
    known = dict(tables)
    if steps[0].get("left") not in known:
        raise KeyError(f"unknown left table: {steps[0].get('left')}")
    log = []
    working = known[steps[0]["left"]]
    for i, step in enumerate(steps):
        if step["right"] not in known:
            raise KeyError(f"unknown right table: {step['right']}")
        working, meta = join_two(
            working, known[step["right"]], step.get("how", "inner"), step.get("on"), step.get("left_on"), step.get("right_on")
        )
        meta.update(step=i + 1, left_name=step.get("left", "_result"), right_name=step["right"])
        if count_rows:
            meta["rows"] = Observation()
            working = working.observe(meta["rows"], F.count("*").alias("result_rows"))
        log.append(meta)
        known["_result"] = working
    return working, log
