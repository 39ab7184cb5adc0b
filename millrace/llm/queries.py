"""The registered queries of this package and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import align, ann, decontaminate, fingerprint, langid, licenses, manifest, mixing, neardup, quality, repeats, secrets, tokens
from millrace.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(check: str | None = None):
    def add(f):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return f(table(spark, folder))

        QUERIES[f.__name__] = run
        if check:
            CHECKS[f.__name__] = check
        return f

    return add


def table(spark: SparkSession, folder: str) -> Callable[[str], DataFrame]:
    tune(spark)
    # Rows for one Arrow batch; few, as a text may be very long.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return lambda name: spark.read.parquet(f"{folder}/{name}.parquet")


# The threshold rule as plain windows over single documents.
MIX = r"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
           ('0x' || md5('mix:' || coalesce(doc_id::VARCHAR, ''))[1:15])::BIGINT AS hash
    FROM documents
), totals AS (
    SELECT source, sum(size)::BIGINT AS size FROM sized GROUP BY source
), weighted AS (
    SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM totals
), ordered AS (
    SELECT *, [3, 1, 2][(rank - 1) % 3 + 1] AS weight FROM weighted
), level AS (
    SELECT *, 1.5::DOUBLE * sum(size) OVER () AS pot, sum(weight) OVER () AS all_weight,
           coalesce(sum(size) OVER before, 0)::BIGINT AS size_before, coalesce(sum(weight) OVER before, 0)::BIGINT AS weight_before
    FROM ordered WINDOW before AS (ORDER BY size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), capped AS (
    SELECT *, 2 * size * (all_weight - weight_before) <= weight * (pot - 2 * size_before) AS is_full FROM level
), targets AS (
    SELECT source, size, CASE WHEN is_full THEN (2 * size)::DOUBLE ELSE
        weight * (pot - 2 * coalesce(sum(size) FILTER (is_full) OVER (), 0)::BIGINT)
        / (all_weight - coalesce(sum(weight) FILTER (is_full) OVER (), 0)::BIGINT)::DOUBLE END AS target
    FROM capped
), running AS (
    SELECT d.*, t.size AS source_size, t.target, floor(t.target)::BIGINT AS words,
           sum(d.size) OVER (PARTITION BY d.source ORDER BY d.hash) - sum(d.size) OVER (PARTITION BY d.source, d.hash) AS below,
           sum(d.size) OVER (PARTITION BY d.source, d.hash) AS tied
    FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size = 0 THEN 0 ELSE words // source_size * size + CASE
           WHEN below + tied <= words % source_size THEN size
           WHEN below >= words % source_size THEN 0
           ELSE floor(size * (words % source_size - below) / tied) END END)::BIGINT AS taken
FROM running
"""


@query(MIX)
def op5_mixing(t):
    """Mix all documents: weights 3, 1, 2 by source, 150 % of all words, at most two passes."""
    return mixing.mix(t("documents"))


@query()
def op10_token_counts(t):
    """Exact token counts of all documents with the public 32k piece model."""
    return tokens.count_tokens(t("documents"))


# Words as lists, templates as rows; a key phrase is looked for at every word of every document.
_ROWS = ", ".join(f"({i}, '{label}', '{notice}', '{key}')" for i, (label, notice, key) in enumerate(licenses.TEMPLATES))
LICENSES = rf"""
WITH t AS (
    SELECT n, label, string_split(notice, ' ') AS notice, string_split(key, ' ') AS key,
           list_position(list_transform(generate_series(1, len(string_split(notice, ' '))), lambda i: string_split(notice, ' ')[i:i + len(string_split(key, ' ')) - 1] = string_split(key, ' ')), true) AS lead
    FROM (VALUES {_ROWS}) v(n, label, notice, key)
), dw AS (
    SELECT row_number() OVER () AS row, doc_id,
           list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
    FROM documents
), vocabulary AS (
    SELECT DISTINCT unnest(notice) AS word FROM t
), df AS (
    SELECT word, count(*) AS n FROM (SELECT DISTINCT row, unnest(w) AS word FROM dw) WHERE word IN (SELECT word FROM vocabulary) GROUP BY word
), weight AS (
    SELECT word, ln(((SELECT count(*) FROM dw) + 1)::DOUBLE / (coalesce(n, 0) + 1)) AS x FROM vocabulary LEFT JOIN df USING (word)
), parts AS (
    SELECT t.n, i, notice[i] AS word, x, i - lead AS at FROM t, unnest(generate_series(1, len(notice))) u(i) JOIN weight ON weight.word = notice[i]
), places AS (
    SELECT row, n, label, unnest(list_filter(generate_series(1, len(w)), lambda i: w[i] = key[1] AND w[i:i + len(key) - 1] = key)) AS s FROM dw, t
), shares AS (
    SELECT p.row, p.n, p.s, least(1.0, round(sum(CASE WHEN p.s + q.at >= 1 AND dw.w[p.s + q.at] = q.word THEN x ELSE 0.0 END ORDER BY i) / sum(x ORDER BY i), 6)) AS share
    FROM places p JOIN parts q USING (n) JOIN dw USING (row) GROUP BY p.row, p.n, p.s
), base(n, label, phrase) AS (
    VALUES (0, 'mit', ['under', 'the', 'mit', 'license']), (1, 'apache-2', ['apache', 'license', 'version', '2']), (2, 'cc-by-nc', ['cc', 'by', 'nc'])
), based AS (
    SELECT row, label, unnest(list_filter(generate_series(1, len(w)), lambda i: w[i:i + len(phrase) - 1] = phrase)) - 1 AS s FROM dw, base
), base_sum AS (
    SELECT row, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM based GROUP BY row
), all_sum AS (
    SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY row
), best AS (
    SELECT row, max(share) AS score FROM shares GROUP BY row
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM dw LEFT JOIN base_sum USING (row) LEFT JOIN all_sum USING (row) LEFT JOIN best USING (row)
"""


@query(LICENSES)
def op1_license_scan(t):
    """License phrases in all documents."""
    return licenses.scan(t("documents"))


@query()
def op7_secret_scan(t):
    """Secrets in all documents."""
    return secrets.scan(t("documents"))


# Windows as lists of words; a document's words are numbered, and each occurrence of a window marks its words.
DECONTAMINATE = r"""
WITH dw AS (
    SELECT row_number() OVER () AS row, doc_id,
           list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
    FROM documents
), bw AS (
    SELECT coalesce(item_id::VARCHAR, '') AS item_id,
           list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
    FROM benchmark
), windows AS (
    SELECT item_id, w[i:i + 12] AS win, least(len(w), 13) AS size
    FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM bw WHERE len(w) > 0)
), sizes AS (
    SELECT DISTINCT size FROM windows
), places AS (
    SELECT row, size, unnest(generate_series(1, len(w) - size + 1)) AS i, w FROM dw, sizes WHERE len(w) >= size
), found AS (
    SELECT DISTINCT p.row, p.i, p.size, x.item_id FROM (SELECT row, i, size, w[i:i + size - 1] AS win FROM places) p
    JOIN windows x ON p.win = x.win AND p.size = x.size
), hit AS (
    SELECT row, count(*) AS n_hit FROM (SELECT DISTINCT row, unnest(generate_series(i, i + size - 1)) FROM found) GROUP BY row
), per_item AS (
    SELECT row, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT row, item_id FROM found) GROUP BY row
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (row) LEFT JOIN per_item USING (row)
"""


@query(DECONTAMINATE)
def op6_decontamination(t):
    """Benchmark windows in all documents."""
    return decontaminate.overlaps(t("documents"), t("benchmark"))


@query()
def op3_quality_classifier(t):
    """Quality of all documents, learned from the labels outside the held-out third."""
    return quality.score(t("documents"), t("labels"))


@query()
def op2_jaccard_join(t):
    """Near duplicates among all documents: five-word shingles, similarity 0.8 or more."""
    return neardup.near_duplicates(t("documents"))


@query()
def op8_language_id(t):
    """Language of all documents, learned from the labelled ones that are not held out."""
    return langid.identify(t("documents"))


@query()
def op9_nearest_neighbours(t):
    """The ten nearest vectors of every hundredth one, among all."""
    embeddings = t("embeddings")
    return ann.nearest(embeddings, embeddings.where("vec_id % 100 = 0"))


@query()
def op4_suffix_array_dedup(t):
    """What is left of all documents without strings of 400 bytes that stand elsewhere too."""
    return repeats.without_repeats(t("documents"), give_kept=False)


@query()
def op11_alignment(t):
    """Tokens of the public 50k byte model and of the public 32k piece model that cover the same bytes of all documents."""
    return align.align(t("documents"))


@query()
def op12_merkle_manifest(t):
    """Root, proofs and their verification for all documents, some of which are tampered with after the manifest is made."""
    documents = t("documents")
    return manifest.manifest(documents, manifest.tampered(documents))


@query()
def op13_fingerprints(t):
    """Fingerprints of all documents and of their edited texts, and how alike they are."""
    return fingerprint.with_edits(t("documents"))
