"""Secret scans in SQL functions only.

Three patterns find the known kinds. Beside them, every run of 20 or more token characters is a candidate: a window of
20 characters slides over it, the count of each character is kept up to date with one addition and one removal, and
so is the sum of count * log2(count), from which the window's Shannon entropy follows. A candidate whose highest window
entropy reaches the limit of its character class is reported as `entropy`, unless an allow-list pattern matches it or
it touches a span that is known already. The words of the allow-list rule out the windows that touch them, not the run.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kind -> pattern, fewest characters, and the group whose length counts. The order is that of the report.
PATTERNS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    "access": (r"AKIA[A-Z0-9]+", 16, 0),
    "hex": (r"(?<![0-9a-f])[0-9a-f]{32,}", 32, 0),  # runs are matched whole, so shorter ones need not be listed
    "entropy": (r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", 20, 0),
}
KINDS = list(PATTERNS)
BASE = KINDS[:3]
WINDOW = 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
# Character class -> what it looks like, bits that a window needs. Random windows reach about 3.3, 4.0 and 4.1 bits.
CLASSES = {"hex": (r"^([0-9a-f]+|[0-9A-F]+)$", 2.8), "alnum": (r"^[A-Za-z0-9]+$", 3.5), "symbols": (r"", 3.7)}
WORDS = r"(?i)example|sample|dummy|placeholder|changeme|xxxx|0123456789|1234567890|abcdefgh"
ALLOWED = (
    r"^[0-9]+$",
    r"^[A-Za-z]+$",
    WORDS,
    r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$",
    r"^[/_=+-]*([A-Za-z]+|[0-9]{1,4})([/_=+-]+([A-Za-z]+|[0-9]{1,4}))*[/_=+-]*$",
)
BLOCK = 256


def _running(sizes: Column) -> Column:
    """Sums of all before each element."""
    begin = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("out"))
    step = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out"))
    return F.aggregate(sizes, begin, step, lambda acc: acc["out"])


def _offsets(sizes: Column) -> Column:
    """As _running, in blocks, so that a text with very many matches doesn't copy a long array for each."""
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b)
    blocks = F.transform(F.sequence(F.lit(0), F.size(sizes) - 1, F.lit(BLOCK)), lambda b: F.slice(sizes, b + 1, F.lit(BLOCK)))
    sums = F.zip_with(blocks, _running(F.transform(blocks, total)), lambda block, top: F.transform(_running(block), lambda x: x + top))
    return F.when(F.size(sizes) > 0, F.flatten(sums)).otherwise(F.array().cast("array<bigint>"))


def window_entropy(token: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits, of `window` characters in a row; 0 for a shorter token."""
    weight = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(window + 2)])
    chars = F.transform(F.split(token, ""), lambda c: F.position(c, F.lit(ALPHABET)) - 1)
    begin = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"), F.lit(0).alias("seen"),
        F.array().cast("array<int>").alias("recent"),
    )

    def step(acc: Column, new: Column) -> Column:
        full = acc["seen"] >= window
        old = F.when(full, F.element_at(acc["recent"], 1)).otherwise(F.lit(-1))
        n_new, n_old = F.get(acc["counts"], new), F.get(acc["counts"], old)
        gain = F.get(weight, n_new + 1) - F.get(weight, n_new)
        loss = F.when(full, F.get(weight, n_old) - F.get(weight, n_old - 1)).otherwise(0.0)
        total = acc["sum"] + F.when(old == new, F.lit(0.0)).otherwise(gain - loss)
        counts = F.transform(acc["counts"], lambda n, i: n + F.when(i == new, 1).otherwise(0) - F.when(i == old, 1).otherwise(0))
        recent = F.concat(F.when(full, F.slice(acc["recent"], 2, window - 1)).otherwise(acc["recent"]), F.array(new))
        bits = F.when(acc["seen"] + 1 >= window, F.lit(math.log2(window)) - total / window).otherwise(0.0)
        return F.struct(counts.alias("counts"), total.alias("sum"), F.greatest(acc["best"], bits).alias("best"), (acc["seen"] + 1).alias("seen"), recent.alias("recent"))

    return F.aggregate(chars, begin, step, lambda acc: acc["best"])


def _suspicious(token: Column, allowed: tuple[str, ...]) -> Column:
    limit = F.coalesce(*[F.when(token.rlike(shape) if shape else F.lit(True), F.lit(bits)) for shape, bits in CLASSES.values()])
    known = F.lit(False)
    for pattern in allowed:
        if pattern != WORDS:
            known = known | token.rlike(pattern)
    bits = window_entropy(token)
    if WORDS in allowed:
        between = F.array_max(F.transform(F.split(token, WORDS), lambda part: window_entropy(part)))
        bits = F.when(token.rlike(WORDS), between).otherwise(bits)
    return F.when(known, F.lit(False)).otherwise(bits >= limit)


def _placed(kind: str, number: int, least: int) -> Column:
    """The spans of a kind that are long enough, from what was found and the lengths before it."""

    def span(x: Column, before: Column) -> Column:
        start = before + x["gap"]
        return F.struct(start.alias("start"), F.lit(number).alias("kind"), (start + x["size"]).alias("end"), x["value"].alias("value"))

    spans = F.filter(F.zip_with(F.col(kind), F.col(f"{kind}_at"), span), lambda s: F.length(s["value"]) >= least)
    return F.coalesce(spans, F.array().cast("array<struct<start: bigint, kind: int, end: bigint, value: string>>"))


def find(docs: DataFrame, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """Every row of `docs` (text) as a struct `row`, with `base` and `extra`: arrays of (start, kind, end) in order.

    Starts and ends count characters, the end being exclusive; kind is a place in KINDS. A missing or empty text has no
    spans; repeated rows and other columns of any name go through unchanged.
    """
    at = docs.select(F.struct("*").alias("row"), F.coalesce(docs["text"], F.lit("")).alias("t"))
    t, none = F.col("t"), F.array().cast("array<string>")
    at = at.select("row", "t", *[F.when(t.rlike(p), F.regexp_extract_all(t, F.lit(p), F.lit(0))).otherwise(none).alias(k) for k, (p, _, _) in PATTERNS.items()])
    pairs = []
    for k, (p, _, group) in PATTERNS.items():
        gaps = F.split(t, p, -1)
        key = F.regexp_extract_all(t, F.lit(p), F.lit(group)) if group else F.col(k)
        whole = F.zip_with(F.zip_with(F.col(k), key, lambda m, v: F.struct(m.alias("m"), v.alias("v"))), F.slice(gaps, 1, F.greatest(F.size(k), F.lit(0))),
                           lambda x, g: F.struct(F.length(g).alias("gap"), F.length(x["m"]).alias("size"), x["v"].alias("value")))
        pairs.append(F.when(F.size(k) > 0, whole).alias(k))
    at = at.select("row", *pairs)
    sizes = [F.transform(k, lambda x: (x["gap"] + x["size"]).cast("long")).alias(f"{k}_sizes") for k in KINDS]
    at = at.select("*", *sizes).select("row", *KINDS, *[F.when(F.col(k).isNotNull(), _offsets(F.col(f"{k}_sizes"))).alias(f"{k}_at") for k in KINDS])
    spans = [_placed(k, i, least).alias(k) for i, (k, (_, least, _)) in enumerate(PATTERNS.items())]
    at = at.select("row", *spans)
    bare = lambda a: F.transform(a, lambda s: F.struct(s["start"], s["kind"], s["end"]))
    at = at.select("row", F.array_sort(bare(F.concat(*BASE))).alias("base"), "entropy")
    fresh = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])) & _suspicious(s["value"], allowed)
    extra = F.when(F.size("entropy") > 0, bare(F.filter("entropy", fresh))).otherwise(F.array().cast("array<struct<start: bigint, kind: int, end: bigint>>"))
    return at.select("row", "base", extra.alias("extra"))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def scan(docs: DataFrame, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of `docs` (doc_id, text).

    `spans` lists kind:start:end by start, then kind; base_sha256 is the digest of that list for the three base kinds.
    """
    found = find(docs.select("doc_id", "text"), allowed)
    number = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    return found.select(
        "row.doc_id",
        *[number(i).alias(f"n_{k}") for i, k in enumerate(BASE)],
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat("base", "extra"))).alias("spans"),
    )


def without_secrets(docs: DataFrame, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """The rows of `docs` in whose text nothing was found."""
    return find(docs, allowed).where((F.size("base") == 0) & (F.size("extra") == 0)).select("row.*")
