"""Merkle fingerprints of texts, in SQL functions only.

A text is cut into paragraphs: lines, and inside a line sentences or, where there are none, stretches of 200 characters.
Every character belongs to one paragraph. A section ends with a blank line or with a paragraph whose digest begins with a
zero, so cuts depend on what the text says there, and an edit moves only those near it. A section hashes the digests of
its paragraphs, the root those of the sections.

The fingerprint is `root/section/section...`, a section being its digest, a colon, and its paragraphs: 12 digits of the
digest and the length in hexadecimal, joined with commas. Equal roots mean equal texts. Else sections that stand on both
sides need no further look, and the paragraphs of the others tell how much two texts share, and where they differ.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.secrets import _offsets
from millrace.operators.ordering import trailing
from millrace.session import checkpoint

STOP = ".!?。！？"
PARAGRAPH = rf"[^\s{STOP}][^\n{STOP}]{{0,199}}+[{STOP}]*+\s*+|[{STOP}]++\s*+|\s++"
BLANK_LINE = r"\n[^\S\n]*\n"
LABEL = 12  # digits of a paragraph's digest in the fingerprint
ROWS_PER_RANGE = 50_000


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text; a missing one is empty and has a root only."""
    text = F.coalesce(text, F.lit(""))
    leaf = lambda p: F.struct(F.sha2(p, 256).alias("digest"), F.lower(F.hex(F.length(p))).alias("size"), p.rlike(BLANK_LINE).alias("blank"))
    leaves = F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), leaf)

    def sections(leaves: Column) -> Column:
        ends = lambda i: F.get(leaves, i - 1)["blank"] | F.get(leaves, i - 1)["digest"].startswith("0") | (i == F.size(leaves))
        cuts = F.filter(F.sequence(F.lit(1), F.size(leaves)), ends)
        return _let(cuts, lambda c: F.zip_with(F.concat(F.array(F.lit(0)), F.slice(c, 1, F.size(c) - 1)), c, lambda a, b: F.slice(leaves, a + 1, b - a)))

    def named(section: Column) -> Column:
        digest = F.sha2(F.array_join(F.transform(section, lambda x: x["digest"]), ""), 256)
        shown = F.array_join(F.transform(section, lambda x: F.concat(F.substring(x["digest"], 1, LABEL), x["size"])), ",")
        return F.struct(digest.alias("digest"), shown.alias("shown"))

    def whole(named: Column) -> Column:
        root = F.sha2(F.array_join(F.transform(named, lambda s: s["digest"]), ""), 256)
        return F.array_join(F.concat(F.array(root), F.transform(named, lambda s: F.concat(F.substring(s["digest"], 1, 16), F.lit(":"), s["shown"]))), "/")

    tree = lambda leaves: _let(F.transform(sections(leaves), named), whole)
    return F.when(text == "", F.sha2(F.lit(""), 256)).otherwise(_let(leaves, tree))


def root(fingerprint: Column) -> Column:
    return F.substring(fingerprint, 1, 64)


def _sections(fingerprint: Column) -> Column:
    parts = F.split(fingerprint, "/")
    return F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))


def _paragraphs(sections: Column) -> Column:
    return F.flatten(F.transform(sections, lambda s: F.split(F.substring_index(s, ":", -1), ",")))


def _length(paragraph: Column) -> Column:
    return F.conv(F.substring(paragraph, LABEL + 1, 16), 16, 10).cast("long")


def _weight(paragraphs: Column) -> Column:
    return F.aggregate(paragraphs, F.lit(0).cast("long"), lambda a, p: a + _length(p))


def likeness(one: Column, two: Column) -> Column:
    """Twice the characters of shared distinct paragraphs over those of both texts; 1 only for equal roots."""

    def compared(x: Column) -> Column:
        a, b = x["a"], x["b"]
        own = lambda p, q: F.array_distinct(_paragraphs(F.array_except(p, q)))
        both = F.struct(_weight(_paragraphs(F.array_intersect(a, b))).alias("whole"), own(a, b).alias("a"), own(b, a).alias("b"))
        return _let(both, lambda y: _share(y))

    def _share(y: Column) -> Column:
        total = 2 * y["whole"] + _weight(y["a"]) + _weight(y["b"])
        shared = 2 * (y["whole"] + _weight(F.array_intersect(y["a"], y["b"])))
        return F.when(total > 0, F.least(shared / total, F.lit(0.999999))).otherwise(0.0)

    pair = F.struct(_sections(one).alias("a"), _sections(two).alias("b"))
    return F.when(root(one) == root(two), F.lit(1.0)).otherwise(_let(pair, compared))


def differing(one: Column, two: Column) -> Column:
    """Where text `one` has paragraphs that `two` lacks: an array of (start, end) in characters, the end being exclusive."""

    def located(x: Column) -> Column:
        other = F.array_except(_paragraphs(F.array_except(x["a"], x["b"])), _paragraphs(x["b"]))
        mine = _paragraphs(x["a"])
        return _let(F.struct(mine.alias("mine"), other.alias("other"), _offsets(F.transform(mine, _length)).alias("at")), spans)

    def spans(y: Column) -> Column:
        each = F.zip_with(y["mine"], y["at"], lambda p, at: F.struct(at.alias("start"), (at + _length(p)).alias("end"), F.array_contains(y["other"], p).alias("new")))
        return F.transform(F.filter(each, lambda s: s["new"]), lambda s: F.struct(s["start"], s["end"]))

    return _let(F.struct(_sections(one).alias("a"), _sections(two).alias("b")), located)


def with_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of `docs` (doc_id, text).

    The edited text has its last floor(n_chars / 4) characters replaced by the first as many, or all, of the next document's.
    Documents are in order of doc_id (missing ones first), then of a hash of their text, and the first one follows the last. A
    row that repeats another, with a missing text being an empty one, is the same document: all its copies have the same next
    one. A single document is its own next one. An empty table gives an empty result.

    A text travels once, with its fingerprint; of the next document only the needed beginning does.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce(docs["text"], F.lit(""))
    name, key = F.coalesce(F.concat(F.lit("="), docs["doc_id"].cast("string")), F.lit("-")).alias("name"), F.xxhash64(text).alias("key")
    nodes = docs.select("doc_id", name, key, F.length(text).alias("n")).groupBy("doc_id", "name", "key").agg(F.max("n").alias("n"), F.count("*").alias("copies"))
    nodes = checkpoint(nodes)
    own = F.struct("name", "key", "n")
    last = nodes.agg(F.max_by(own, F.struct("doc_id", "key"))).first()[0]
    if last is None:
        last = ("", 0, 0)
    order = trailing(nodes, {"to": lambda w: F.lag(own).over(w)}, 1, ["doc_id", "key"], rows_per_range=ROWS_PER_RANGE)
    to = F.coalesce("to", F.struct(F.lit(last[0]).alias("name"), F.lit(last[1]).cast("long").alias("key"), F.lit(last[2]).alias("n")))
    order = checkpoint(order.select("name", "key", "copies", to.alias("to")))

    texts = docs.select(name, key, text.alias("text"), fingerprint(text).alias("fingerprint"))
    needed = F.floor(F.col("to.n") / 4).cast("int")
    sent = texts.join(order.hint("merge"), ["name", "key"])
    sent = sent.select("copies", "to.name", "to.key", F.substring("text", F.lit(1), needed).alias("begin"), F.col("fingerprint").alias("next_fingerprint"))
    one = F.first(F.struct("begin", "next_fingerprint")).alias("x")
    once = sent.where("copies > 1").groupBy("name", "key").agg(one).select("name", "key", "x.*")
    sent = sent.where("copies = 1").drop("copies").unionByName(once)
    n = F.length("text")
    edited = F.concat(F.substring("text", F.lit(1), (n - F.floor(n / 4)).cast("int")), F.col("begin"))
    out = texts.join(sent.hint("merge"), ["name", "key"]).select("*", edited.alias("edited"), n.cast("long").alias("n_chars"))
    out = out.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return out.select(
        F.when(F.col("name") != "-", F.substring("name", 2, 2**31 - 1)).cast(kind).alias("doc_id"),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
