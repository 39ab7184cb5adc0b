"""A Merkle manifest of a table: one digest for all rows, and for each row the proof that it is part of it.

Leaves stand in order inside their language. At each level the nodes lie in runs of FAN; lag and lead columns of fixed
offsets, masked by a node's slot and the length of its run, are its siblings, and the rows of first children hash the
parents. What remains of a language is its subroot, and the subroots form a tree of the same kind. On the way down a node
hands its own siblings and those above it to its children: the proof of a leaf is the list of siblings from it to the root.

Texts are hashed where they are read and never travel. Levels are tables, each an eighth of the one below, and runs hold
eight rows at most, so no language is too large.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.words import LOWER_AZ, UPPER
from millrace.operators.ordering import row_index
from millrace.session import checkpoint

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ROWS_PER_RANGE = 50_000
TAMPERED = 3  # a row whose number of this kind is divisible by it is tampered with
SIBLINGS = "array<struct<left: string, right: string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """`-` for a missing value, else its length in UTF-8 bytes, a colon, and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(docs: DataFrame, text: Column) -> Column:
    return digest(*[field(text if name == "text" else docs[name]) for name in FIELDS])


def _runs(nodes: DataFrame) -> DataFrame:
    """`nodes` (tree, at, n, node) with up, the parent's place, and left and right: the siblings' digests before and after, one string each."""
    slot = F.pmod("at", F.lit(FAN))
    nodes = nodes.withColumn("up", ((F.col("at") - slot) / FAN).cast("long"))
    run, length = Window.partitionBy("tree", "up").orderBy("at"), F.least(F.lit(FAN).cast("long"), F.col("n") - F.col("up") * FAN)
    before = [F.when(slot >= k, F.lag("node", k).over(run)).otherwise("") for k in range(FAN - 1, 0, -1)]
    after = [F.when(slot + k < length, F.lead("node", k).over(run)).otherwise("") for k in range(1, FAN)]
    return nodes.withColumns({"left": F.concat(*before), "right": F.concat(*after)})


def _grown(leaves: DataFrame, most: int) -> list[DataFrame]:
    """The levels of all trees of (tree, at, n, node), leaves first, the largest having `most`; a tree ends where its n is 1."""
    levels = [leaves]
    while most > 1:
        firsts = _runs(levels[-1].where("n > 1")).where(F.pmod("at", F.lit(FAN)) == 0)
        size = F.ceil(F.col("n") / FAN)
        levels.append(checkpoint(firsts.select("tree", F.col("up").alias("at"), size.alias("n"), digest("node", "right").alias("node"))))
        most = -(-most // FAN)
    return levels


def _proven(levels: list[DataFrame], above: DataFrame | None, number: int = 0) -> DataFrame:
    """`levels[number]` with the columns of `above` (tree, proof, ...), which holds each tree's top: proof grows on the way down.

    Without `above` the tops have nothing above them.
    """
    level, given = levels[number], [c for c in above.columns if c not in ("tree", "proof")] if above else []
    shown = [*level.columns, "proof", *given]
    done = level.where("n = 1")
    done = (done.join(above, "tree") if above else done.withColumn("proof", F.array().cast(SIBLINGS))).select(*shown)
    if number + 1 == len(levels):
        return done
    upper = _proven(levels, above, number + 1).select("tree", F.col("at").alias("up"), "proof", *given)
    mine = _runs(level.where("n > 1")).join(upper, ["tree", "up"])
    mine = mine.withColumn("proof", F.concat(F.array(F.struct("left", "right")).cast(SIBLINGS), "proof"))
    return done.unionByName(mine.select(*shown))


def _placed(rows: DataFrame, order_by: list[str]) -> tuple[DataFrame, int]:
    """`rows` with at, the place inside `tree` along `order_by`, and n, the size of the tree; and the largest n."""
    placed = row_index(rows, ["tree", *order_by], "at", ROWS_PER_RANGE)
    sizes = checkpoint(placed.groupBy("tree").agg(F.min("at").alias("first"), F.count("*").alias("n")))
    placed = placed.join(sizes, "tree").withColumn("at", F.col("at") - F.col("first")).drop("first")
    return placed, sizes.agg(F.max("n")).first()[0] or 0


def folded(node: Column, proof: Column) -> Column:
    """The root that follows from a leaf and its proof."""
    return F.aggregate(proof, node, lambda x, s: digest(s["left"], x, s["right"]))


def tampered(docs: DataFrame) -> Column:
    """The text after tampering: rows whose doc_id has a crc32 divisible by TAMPERED have A-Z lowered."""
    number = F.crc32(docs["doc_id"].cast("string").cast("binary"))
    return F.when(F.pmod(number, F.lit(TAMPERED)) == 0, F.translate(docs["text"], UPPER, LOWER_AZ)).otherwise(docs["text"])


def manifest(docs: DataFrame, text_now: Column | None = None, give_proof: bool = False) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of `docs` (doc_id, source, lang, n_chars, text).

    The leaf is a digest of the five columns, missing values being told apart from empty ones. `text_now` is the text that
    a reader finds now (the row's own if left out): folded_root follows from it and the proof of the original, and verified
    says whether it is the root. Rows of a language are in order of doc_id (missing ones first), then of their leaf, so
    repeated rows stand side by side, each with its own place and proof. A missing language is a tree of its own, before the
    others. An empty table gives an empty result. With `give_proof` also `proof`, an array of (left, right) siblings.
    """
    now = F.lit(None).cast("string") if text_now is None else F.when(~text_now.eqNullSafe(docs["text"]), leaf(docs, text_now))
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), docs["lang"]), F.lit("-")).alias("tree"), "doc_id", leaf(docs, docs["text"]).alias("node"), now.alias("now")
    )
    rows = checkpoint(rows.withColumn("tie", F.monotonically_increasing_id()))
    leaves, most = _placed(rows, ["doc_id", "node", "tie"])
    levels = _grown(leaves.select("tree", "at", "n", "node"), most)
    tops = checkpoint(reduce(DataFrame.unionByName, [level.where("n = 1").select("tree", "node") for level in levels]))
    # Subroots are the leaves of one more tree; their order is that of the bytes of `tree`.
    roots, most = _placed(tops.select(F.lit("").alias("tree"), F.col("tree").alias("lang"), F.col("node")), ["lang"])
    roots = checkpoint(roots.withColumn("subroot", F.col("node")))
    upper = _grown(roots.select("tree", "at", "n", "node"), most)
    root = upper[-1].select("node").first()  # one row at most
    proofs = _proven([roots, *upper[1:]], None).select(F.col("lang").alias("tree"), "proof", "subroot")
    out = _proven([leaves, *levels[1:]], checkpoint(proofs)).withColumn("root", F.lit(root and root[0]).cast("string"))
    whole = F.aggregate("proof", F.lit(""), lambda x, s: F.concat(x, s["left"], s["right"]))
    out = out.withColumns({"proof_sha256": F.sha2(whole, 256), "folded_root": folded(F.coalesce("now", "node"), F.col("proof"))})
    names = ["doc_id", F.col("node").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")]
    return out.select(*names, *(["proof"] if give_proof else []))
