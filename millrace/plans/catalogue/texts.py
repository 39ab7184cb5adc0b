"""Retrieval, domain detection, briefs and live tables."""

import uuid

from pyspark.sql import functions as F

from millrace.operators import domains as dm
from millrace.operators.briefs import impact_line, latest_versions, top_actions, weekly_briefs
from millrace.operators.retrieval import extract_answer, keyword_search, keyword_search_many, row_documents, vector_search
from millrace.operators.star import money_impact
from millrace.plans.catalogue import words
from millrace.plans.catalogue.base import kinds_sql, query, rounded
from millrace.session import checkpoint_dir
from millrace.streaming import live


@query(
    "row_documents",
    """SELECT c_custkey AS row_id, 'row_id=' || c_custkey || ' | c_name=' || c_name || ' | c_nationkey=' || c_nationkey ||
              ' | c_mktsegment=' || c_mktsegment AS document FROM customer""",
)
def documents_of_rows(t):
    return row_documents(t.customer, "c_custkey", ["c_name", "c_nationkey", "c_mktsegment"])


_WORDS = r"LIST_DISTINCT(REGEXP_EXTRACT_ALL(LOWER({}), '[a-zA-Z0-9_.]+'))"


@query(
    "keyword_topk",
    f"""WITH s AS (SELECT doc_id AS row_id, text, LEN(LIST_INTERSECT({_WORDS.format('text')}, ['why', 'the', 'report', 'did', 'fail', 'of', 'reading']))
                   + CASE WHEN CONTAINS(LOWER(text), 'vibration') OR CONTAINS(LOWER(text), 'fail') THEN 2 ELSE 0 END AS score FROM documents)
        SELECT row_id, score, 'keyword' AS source FROM s WHERE score > 0 ORDER BY score DESC, row_id LIMIT 6""",
)
def keyword_topk(t):
    found = keyword_search(t.documents, "Why did the reading of the report fail", 6, "doc_id", "text")
    return rounded(found.select("row_id", "score", "source"))


@query(
    "keyword_topk_many",
    f"""WITH q AS (SELECT item_id AS question_id, text AS question FROM benchmark),
             qw AS (SELECT question_id, UNNEST({_WORDS.format('question')}) AS word FROM q),
             dw AS (SELECT doc_id AS row_id, UNNEST({_WORDS.format('text')}) AS word FROM documents),
             o AS (SELECT question_id, row_id, COUNT(*) AS hits FROM qw JOIN dw USING (word) GROUP BY 1, 2),
             s AS (SELECT o.question_id, o.row_id, hits + CASE WHEN (CONTAINS(LOWER(question), 'fail') OR CONTAINS(LOWER(question), 'vibration')
                     OR CONTAINS(LOWER(question), 'temp') OR CONTAINS(LOWER(question), 'why') OR CONTAINS(LOWER(question), 'spike'))
                     AND (CONTAINS(LOWER(text), 'vibration') OR CONTAINS(LOWER(text), 'fail')) THEN 2 ELSE 0 END AS score
                   FROM o JOIN q USING (question_id) JOIN documents d ON d.doc_id = o.row_id)
        SELECT question_id, row_id, score, ROW_NUMBER() OVER (PARTITION BY question_id ORDER BY score DESC, row_id) AS rank FROM s
        QUALIFY rank <= 6""",
)
def keyword_topk_many(t):
    questions = t.benchmark.select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    return rounded(keyword_search_many(t.documents, questions, 6, "doc_id", "text"))


@query(
    "cosine_topk",
    """WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings ORDER BY vec_id LIMIT 1)
       SELECT vec_id, ROUND(LIST_COSINE_SIMILARITY(embedding::DOUBLE[], q), 6) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 6""",
)
def cosine_topk(t):
    wanted = t.embeddings.orderBy("vec_id").limit(1).first()["embedding"]
    return rounded(vector_search(t.embeddings, wanted, "vec_id", "embedding", 6))


@query(
    "extract_answer",
    """WITH m AS (SELECT MAX(vibration) AS v, MAX(temperature) AS t FROM readings WHERE CONTAINS(LOWER(machine_id), 'm1'))
       SELECT FORMAT('Machine m1 likely failed because vibration reached {:.2f}, temperature peaked at {:.2f}. Inspect bearings and schedule maintenance.', v, t) AS answer,
              ROUND(v, 6) AS peak_vibration, ROUND(t, 6) AS peak_temperature FROM m""",
    using=("readings",),
)
def answer(t):
    return rounded(extract_answer(t.readings, "Why did machine M1 fail?"))


def _tables(t):
    """The derived industry tables under neutral names."""
    names = ("sales", "readings", "patients", "students", "subscribers", "loans", "stock", "meters", "fields", "staff", "plant")
    return {n: getattr(t, n) for n in names}


def _catalogue(t, kinds=False):
    return dm.catalogue(t.spark, _tables(t), kinds=kinds)


# Column names and share of numeric columns of the derived tables, as their SELECTs give them.
_COLUMNS = {
    "sales": ("order_id customer_id sku region order_date revenue units product", 5 / 8),
    "readings": ("event_id timestamp machine_id location temperature vibration pressure speed rul failure", 7 / 10),
    "patients": ("event_id patient_id age bp glucose weight height readmission", 1.0),
    "students": ("student_id math_score attendance course", 3 / 4),
    "subscribers": ("subscriber_id churn tenure arpu data_usage plan", 5 / 6),
    "loans": ("application_id loan_amount income default_flag credit_score", 1.0),
    "stock": ("sku inventory demand lead_time shipments warehouse", 5 / 6),
    "meters": ("event_id timestamp load voltage current", 4 / 5),
    "fields": ("event_id timestamp moisture rainfall ph crop_yield", 5 / 6),
    "staff": ("employee_id salary department attrition", 3 / 4),
    "plant": ("event_id date asset_id downtime_minutes scrap availability oee", 5 / 7),
}


def _column_of(hint: str, columns: list[str]) -> str | None:
    return hint if hint in columns else next((c for c in columns if hint in c), None)


def _values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + ")"


def _all(tables: dict, kind: str, weight: float) -> list[tuple]:
    return [(domain, kind, w, weight) for domain, its in tables.items() for w in its]


def _scored() -> str:
    """CTEs ending in ``scored`` (tab, domain, nth, score, exclusive_hits, hits): the keyword scorer in SQL.

    Words are matched against joined column names, medians are taken from the data.
    """
    listed = _all(words.KEYWORDS, "keyword", 1.2) + _all(words.EXCLUSIVE, "exclusive", 3.5) + _all(words.AGAINST, "against", -2.5)
    boosts = [(d, w) for d, its in words.BOOSTERS.items() for w in its]
    medians = []
    for table, (names, _) in _COLUMNS.items():
        for domain, ranges in dm.RANGES.items():
            for hint, (low, high) in ranges.items():
                column = _column_of(hint, names.split())
                if column:
                    medians.append(
                        f"SELECT '{table}' AS tab, '{domain}' AS domain, CASE WHEN COUNT({column}) < 5 THEN 0.0 WHEN "
                        f"QUANTILE_CONT({column}, 0.5) BETWEEN {low} AND {high} THEN 1.8 ELSE -0.8 END AS points FROM {table}"
                    )
    domains = [(d, i) for i, d in enumerate(words.KEYWORDS)]
    return f"""t AS (SELECT * FROM {_values([(t, n, share) for t, (n, share) in _COLUMNS.items()])} v(tab, joined, share)),
        w AS (SELECT * FROM {_values(listed)} v(domain, kind, word, weight)), b AS (SELECT * FROM {_values(boosts)} v(domain, word)),
        m AS (SELECT tab, domain, SUM(points) AS points FROM ({" UNION ALL ".join(medians)}) GROUP BY tab, domain),
        h AS (SELECT tab, domain, SUM(weight) AS points, COUNT(*) FILTER (WHERE kind = 'exclusive') AS exclusive_hits,
                     ARRAY_TO_STRING(LIST_SORT(LIST(DISTINCT word)), ', ') AS hits FROM t JOIN w ON CONTAINS(joined, word) GROUP BY tab, domain),
        x AS (SELECT t.tab, d.domain, d.nth, COALESCE(h.points, 0)
                + CASE WHEN d.domain IN ('predictive_maintenance', 'energy_utilities', 'agriculture_iot') AND share > 0.55 THEN 0.8 ELSE 0 END
                + CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.domain = d.domain AND (LIST_CONTAINS(STR_SPLIT(REPLACE(joined, '_', ' '), ' '), b.word)
                                    OR LIST_CONTAINS(STR_SPLIT(joined, ' '), b.word))) THEN 1.5 ELSE 0 END AS points,
                COALESCE(exclusive_hits, 0) AS exclusive_hits, COALESCE(hits, '') AS hits
              FROM t CROSS JOIN {_values(domains)} d(domain, nth) LEFT JOIN h ON h.tab = t.tab AND h.domain = d.domain),
        scored AS (SELECT x.tab, x.domain, nth, CAST(GREATEST(CASE WHEN x.domain = 'healthcare' AND exclusive_hits = 0 THEN LEAST(x.points, 0.8)
               ELSE x.points END + COALESCE(m.points, 0), 0) AS DOUBLE) AS score, exclusive_hits, hits
        FROM x LEFT JOIN m ON m.tab = x.tab AND m.domain = x.domain)"""


def _decided() -> str:
    """CTEs ending in ``decided`` (tab, domain, confidence): the vote with the keyword scorer alone, and its corrections."""
    return f"""{_scored()},
        v AS (SELECT *, 0.35 * score / GREATEST(MAX(score) OVER (PARTITION BY tab), 1.0) + CASE WHEN exclusive_hits >= 2 THEN 0.35 ELSE 0 END AS raw FROM scored),
        c AS (SELECT *, CASE WHEN domain = 'healthcare' AND exclusive_hits = 0 THEN LEAST(raw, 0.15) ELSE raw END AS vote FROM v),
        e AS (SELECT tab, score AS ed_score, exclusive_hits AS ed_hits FROM c WHERE domain = 'education'),
        f AS (SELECT * FROM c QUALIFY ROW_NUMBER() OVER (PARTITION BY tab ORDER BY vote DESC, nth) = 1),
        g AS (SELECT f.*, ed_score, ed_hits, LEAST(0.99, GREATEST(0.3, vote)) AS sure, f.domain = 'healthcare' AND exclusive_hits = 0 AS hollow FROM f JOIN e USING (tab)),
        decided AS (SELECT tab, CASE WHEN hollow AND ed_hits >= 1 THEN 'education' WHEN hollow THEN 'generic'
                WHEN ed_hits >= 1 AND ed_score >= score THEN 'education' WHEN score <= 0 THEN 'generic' ELSE domain END AS domain,
              CASE WHEN hollow AND ed_hits >= 1 THEN GREATEST(sure, 0.7) WHEN hollow THEN LEAST(sure, 0.4)
                WHEN ed_hits >= 1 AND ed_score >= score THEN GREATEST(sure, LEAST(0.95, 0.55 + 0.05 * ed_score)) ELSE sure END AS confidence FROM g)"""


def _packed() -> str:
    """CTEs ending in ``best``: the second scorer in SQL, from names, kinds and medians."""
    listed = _all(words.STRONG, "strong", 3.0) + _all(words.WEAK, "weak", 0.6) + _all(words.PACK_AGAINST, "against", -2.0)
    fits = []
    for table, (names, _) in _COLUMNS.items():
        for hint, (low, high) in dm.RANGES["predictive_maintenance"].items():
            column = _column_of(hint, names.split())
            if column:
                fits.append(f"SELECT '{table}' AS tab, CASE WHEN COUNT({column}) >= 5 AND QUANTILE_CONT({column}, 0.5) BETWEEN {low} AND {high} THEN 1.5 ELSE 0 END AS points FROM {table}")
    return f"""{kinds_sql({t: n.split() for t, (n, _) in _COLUMNS.items()})},
        t AS (SELECT * FROM {_values([(t, n) for t, (n, _) in _COLUMNS.items()])} v(tab, joined)),
        w AS (SELECT * FROM {_values(listed)} v(domain, sort, word, weight)),
        h AS (SELECT tab, domain, SUM(weight) FILTER (WHERE sort <> 'against') AS good, SUM(weight) FILTER (WHERE sort = 'against') AS bad,
                     COUNT(*) FILTER (WHERE sort = 'strong') AS strong FROM t JOIN w ON CONTAINS(joined, word) GROUP BY tab, domain),
        f AS (SELECT tab, SUM(points) AS points FROM ({" UNION ALL ".join(fits)}) GROUP BY tab),
        k AS (SELECT tab, COUNT(*) FILTER (WHERE kind = 'date') AS dates, COUNT(*) FILTER (WHERE kind = 'number') / COUNT(*) AS numbers,
                     COUNT(*) FILTER (WHERE CONTAINS(col, 'churn') AND kind IN ('boolean', 'number', 'text')) AS churny FROM kinds GROUP BY tab),
        x AS (SELECT t.tab, d.domain, nth, GREATEST(0, CASE WHEN d.domain = 'health' AND COALESCE(strong, 0) = 0 THEN LEAST(COALESCE(good, 0), 0.4) ELSE COALESCE(good, 0) END
                + CASE WHEN d.domain = 'forecasting' AND dates > 0 THEN 2 ELSE 0 END + CASE WHEN d.domain = 'predictive_maintenance' AND numbers >= 0.45 THEN 1.5 ELSE 0 END
                + COALESCE(bad, 0) + CASE WHEN d.domain = 'churn' THEN 2.5 * churny ELSE 0 END
                + CASE WHEN d.domain = 'predictive_maintenance' THEN COALESCE(f.points, 0) ELSE 0 END)::DOUBLE AS score
              FROM t CROSS JOIN {_values([(d, i) for i, d in enumerate(words.STRONG)])} d(domain, nth) JOIN k ON k.tab = t.tab
              LEFT JOIN h ON h.tab = t.tab AND h.domain = d.domain LEFT JOIN f ON f.tab = t.tab),
        r AS (SELECT *, LEAD(score) OVER o AS next, ROW_NUMBER() OVER o AS place FROM x WINDOW o AS (PARTITION BY tab ORDER BY score DESC, nth)),
        best AS (SELECT tab, CASE WHEN score >= 2 THEN domain ELSE 'generic' END AS domain,
              CASE WHEN score >= 2 THEN LEAST(0.97, 0.45 + 0.08 * score + 0.15 * (score - next) / GREATEST(score, 1)) ELSE 0.35 END AS confidence FROM r WHERE place = 1)"""


def _printed() -> str:
    """The schema fingerprints in SQL: four keyword figures for each domain, then five facts about the table."""
    parts = []
    for i, d in enumerate(words.KEYWORDS):
        groups = (words.KEYWORDS[d], words.EXCLUSIVE[d], words.AGAINST[d], words.KEYWORDS[d])
        for j, its in enumerate(groups):
            found = f"LEN(LIST_FILTER({list(its)}, lambda x: CONTAINS(joined, x)))"
            parts.append((4 * i + j, f"{found} / {len(its)}" if j == 3 else found))
    n = 4 * len(words.KEYWORDS)
    parts += [(n, "share"), (n + 1, "texts / width"), (n + 2, "CASE WHEN REGEXP_MATCHES(joined, 'timestamp|date|time') THEN 1 ELSE 0 END"), (n + 3, "row_count"), (n + 4, "width")]
    return f"""{kinds_sql({t: n.split() for t, (n, _) in _COLUMNS.items()})},
        t AS (SELECT * FROM {_values([(t, n, share) for t, (n, share) in _COLUMNS.items()])} v(tab, joined, share)),
        k AS (SELECT tab, COUNT(*) FILTER (WHERE kind = 'text') AS texts, COUNT(*) AS width, MAX(n) AS row_count FROM kinds GROUP BY tab),
        p AS (SELECT tab, UNNEST([{", ".join(f"{{'position': {i}, 'value': ({x})::DOUBLE}}" for i, x in parts)}]) AS c FROM t JOIN k USING (tab))"""


@query("catalog_heuristic", f"""WITH {_scored()} SELECT tab AS "table", domain, ROUND(score, 4) AS score, exclusive_hits, hits FROM scored""", using=tuple(_COLUMNS))
def catalog_heuristic(t):
    return rounded(dm.heuristic_scores(_catalogue(t)).withColumn("hits", F.array_join("hits", ", ")), 4)


@query("catalog_domain", f"""WITH {_decided()} SELECT tab AS "table", domain, ROUND(confidence, 4) AS confidence FROM decided""", using=tuple(_COLUMNS))
def catalog_domain(t):
    return rounded(dm.decide(dm.vote(dm.heuristic_scores(_catalogue(t)))), 4)


@query("catalog_classifier")
def catalog_classifier(t):
    tables = _catalogue(t, kinds=True)
    scores = dm.heuristic_scores(tables)
    return rounded(dm.decide(dm.vote(scores, dm.classify_schemas(tables))), 4)


@query(
    "catalog_packs",
    f"""WITH {_packed()} SELECT tab AS "table", domain, ROUND(confidence, 4) AS confidence, CASE domain WHEN 'sales' THEN 'sales_forecasting'
        WHEN 'forecasting' THEN 'sales_forecasting' WHEN 'churn' THEN 'telecom_churn' WHEN 'predictive_maintenance' THEN 'predictive_maintenance'
        WHEN 'quality' THEN 'warehouse_logistics' WHEN 'education' THEN 'education' WHEN 'health' THEN 'healthcare' ELSE 'generic' END AS app_domain FROM best""",
    using=tuple(_COLUMNS),
)
def catalog_packs(t):
    return rounded(dm.pack_domain(dm.pack_scores(_catalogue(t, kinds=True))), 4)


@query("catalog_fingerprints", f"""WITH {_printed()} SELECT tab AS "table", CAST(c.position AS BIGINT) AS position, ROUND(c.value, 6) AS value FROM p""", using=tuple(_COLUMNS))
def catalog_fingerprints(t):
    prints = dm.schema_fingerprints(_catalogue(t, kinds=True))
    return rounded(prints.select("table", F.posexplode("fingerprint").alias("position", "value")), 6)


@query(
    "catalog_plant",
    f"""WITH t AS (SELECT * FROM {_values([(t, n) for t, (n, _) in _COLUMNS.items()])} v(tab, joined)),
             n AS ({" UNION ALL ".join(f"SELECT '{t}' AS tab, COUNT(*) AS row_count FROM {t}" for t in _COLUMNS)}),
             s AS (SELECT tab, LIST_DISTINCT(STR_SPLIT(REPLACE(joined, '_', ' '), ' ')) AS tokens FROM t),
             p AS (SELECT tab, 2 * LEN(LIST_INTERSECT(tokens, ['availability', 'oee', 'downtime', 'scrap', 'planned', 'performance', 'reject']))
                      + LEN(LIST_INTERSECT(tokens, ['quality', 'asset', 'machine', 'runtime', 'run', 'good', 'line', 'shift'])) AS score FROM s)
        SELECT tab AS "table", row_count AS rows, score, score >= 4 AND row_count > 0 AS match FROM p JOIN n USING (tab)""",
    using=tuple(_COLUMNS),
)
def catalog_plant(t):
    return rounded(dm.plant_score(_catalogue(t, kinds=True)))


@query(
    "catalog_override",
    f"""WITH {_decided()} SELECT tab AS "table", CASE WHEN tab = 'stock' THEN 'sales_forecasting' ELSE domain END AS domain, domain AS detected,
        ROUND(confidence, 4) AS confidence, tab = 'stock' AS overridden FROM decided""",
    using=tuple(_COLUMNS),
)
def catalog_override(t):
    decided = dm.decide(dm.vote(dm.heuristic_scores(_catalogue(t))))
    chosen = t.spark.createDataFrame([("stock", "sales_forecasting")], "table string, chosen string")
    return rounded(dm.with_override(decided, chosen), 4)


_ROLE_TABLES = {"sales": "sales", "readings": "predictive_maintenance", "patients": "health", "students": "education", "subscribers": "churn", "plant": "plant_oee"}
# The role each column has by its name, written out; `kind` where only the kind of the data decides.
_NAMED = [
    ("sales", "order_id", "id"), ("sales", "customer_id", "customer"), ("sales", "sku", "product"), ("sales", "region", "region"),
    ("sales", "order_date", "date"), ("sales", "revenue", "revenue"), ("sales", "units", "quantity"), ("sales", "product", "kind"),
    ("readings", "event_id", "id"), ("readings", "timestamp", "date"), ("readings", "machine_id", "asset"), ("readings", "location", "category"),
    ("readings", "temperature", "sensor"), ("readings", "vibration", "sensor"), ("readings", "pressure", "sensor"), ("readings", "speed", "kind"),
    ("readings", "rul", "rul_target"), ("readings", "failure", "failure_label"),
    ("patients", "event_id", "id"), ("patients", "patient_id", "patient_id"), ("patients", "age", "kind"), ("patients", "bp", "kind"),
    ("patients", "glucose", "kind"), ("patients", "weight", "kind"), ("patients", "height", "kind"), ("patients", "readmission", "readmission"),
    ("students", "student_id", "id"), ("students", "math_score", "score"), ("students", "attendance", "attendance"), ("students", "course", "course"),
    ("subscribers", "subscriber_id", "id"), ("subscribers", "churn", "churn_flag"), ("subscribers", "tenure", "tenure"), ("subscribers", "arpu", "kind"),
    ("subscribers", "data_usage", "kind"), ("subscribers", "plan", "subscription"),
    ("plant", "event_id", "id"), ("plant", "date", "date"), ("plant", "asset_id", "asset"), ("plant", "downtime_minutes", "downtime"),
    ("plant", "scrap", "scrap"), ("plant", "availability", "availability"), ("plant", "oee", "kind"),
]


@query(
    "catalog_roles",
    f"""WITH {kinds_sql({t: _COLUMNS[t][0].split() for t in _ROLE_TABLES})}, named AS (SELECT * FROM {_values(_NAMED)} v(tab, col, named)),
             r AS (SELECT k.tab, k.col, CASE WHEN named <> 'kind' THEN named WHEN kind = 'id_like' THEN CASE WHEN k.tab = 'subscribers' THEN 'customer_id' ELSE 'id' END
                   WHEN kind = 'number' THEN CASE WHEN k.tab = 'readings' THEN 'sensor' ELSE 'metric' END
                   WHEN kind = 'boolean' AND k.tab = 'subscribers' THEN 'churn_flag' WHEN kind = 'text' THEN 'category' END AS role
                   FROM kinds k JOIN named n ON n.tab = k.tab AND n.col = k.col)
        SELECT tab AS table_name, col AS column_name, role FROM r WHERE role IS NOT NULL""",
    using=tuple(_ROLE_TABLES),
)
def catalog_roles(t):
    tables = _tables(t)
    found = dm.catalogue(t.spark, {n: tables[n] for n in _ROLE_TABLES})
    domains = t.spark.createDataFrame(list(_ROLE_TABLES.items()), "table string, domain string")
    roles = dm.suggest_roles(found.join(domains, "table"))
    return roles.select(F.col("table").alias("table_name"), F.col("column").alias("column_name"), "role")


@query(
    "mapping_applied",
    """SELECT c_custkey AS customer_id, c_acctbal AS revenue, c_mktsegment AS region FROM customer
       UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier""",
)
def mapping_applied(t):
    saved = {"custkey": "customer_id", "acctbal": "revenue", "mktsegment": "region"}
    first = t.customer.toDF(*[c.removeprefix("c_") for c in t.customer.columns])
    second = t.supplier.select(F.col("s_suppkey").alias("s_custkey"), "s_acctbal")
    return dm.conform_all([first, second], saved)


@query(
    "latest_mapping",
    """SELECT o_custkey AS user_id, o_orderpriority AS name, o_orderkey AS mapping, STRFTIME(o_orderdate, '%Y-%m-%d') AS updated_at FROM orders
       QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
)
def latest_mapping(t):
    records = t.orders.select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("mapping"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("updated_at"),
    )
    return latest_versions(records, ["user_id", "name"], ["updated_at", "mapping"])


@query(
    "top3_actions",
    """WITH o AS (SELECT DISTINCT conv_id AS owner FROM conversations),
            f AS (SELECT conv_id AS owner, turn AS n, TRIM(text) AS text FROM conversations WHERE role = 'system' AND TRIM(text) <> ''),
            e AS (SELECT owner, COUNT(*) AS k FROM f GROUP BY owner),
            d AS (SELECT * FROM (VALUES (1000, 'Review the KPIs and pin the weakest metric on the board.'), (1001, 'Send the weekly pack once mail is set up.'),
                   (1002, 'Save a named column mapping so the next file maps by itself.')) v(n, text)),
            g AS (SELECT * FROM (VALUES (1000, 'Run the cleaning and the quality checks.'), (1001, 'Pin the weakest KPI on the board.'),
                   (1002, 'Send the weekly pack once mail is set up.')) v(n, text)),
            u AS (SELECT owner, n, text FROM f UNION ALL SELECT owner, d.n, d.text FROM o JOIN e USING (owner), d
                  UNION ALL SELECT owner, g.n, g.text FROM o, g WHERE owner NOT IN (SELECT owner FROM e)),
            q AS (SELECT * FROM u QUALIFY ROW_NUMBER() OVER (PARTITION BY owner, LOWER(TRIM(REGEXP_REPLACE(text, '\\s+', ' ', 'g'))) ORDER BY n) = 1)
       SELECT owner, ROW_NUMBER() OVER (PARTITION BY owner ORDER BY n) AS rank, text AS action FROM q QUALIFY rank <= 3""",
)
def top3_actions(t):
    findings = t.conversations.where("role = 'system'").select(
        F.col("conv_id").alias("owner"), F.lit(1).alias("priority"), F.col("turn").alias("seq"), "text"
    )
    owners = t.conversations.select(F.col("conv_id").alias("owner"))
    return rounded(top_actions(findings, owners))


@query(
    "weekly_briefs",
    """WITH j AS (SELECT c_custkey AS user_id, c_name || '@example.com' AS email FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_acctbal >= 0),
            s AS (SELECT * FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
       SELECT user_id, email, 'Weekly brief' || CHR(10) || 'Date: 2026-01-05' || CHR(10) || CHR(10) || 'Top 3 actions:' || CHR(10) ||
              CASE WHEN o_orderkey IS NULL THEN '  1. No actions yet' ELSE '  1. Check order ' || o_orderkey || CHR(10) || '  2. Priority ' || o_orderpriority END
              || CHR(10) || CHR(10) || 'Impact: ' || COALESCE(o_orderstatus, 'N/A') || CHR(10) || CHR(10) || 'KPI summary:' || CHR(10) ||
              CASE WHEN o_orderkey IS NULL THEN '  - No KPIs: -' ELSE '  - status: ' || o_orderstatus END AS brief, '2026-01-05' AS last_run
       FROM j LEFT JOIN s ON user_id = o_custkey""",
)
def briefs(t):
    jobs = t.customer.select(
        F.col("c_custkey").alias("user_id"), F.lit("weekly_report").alias("job_type"), (F.col("c_acctbal") >= 0).alias("enabled"),
        F.expr("CASE WHEN c_mktsegment <> 'BUILDING' THEN c_name || '@example.com' END").alias("email"),
    )
    sessions = t.orders.select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("session_id"),
        F.expr("array('Check order ' || o_orderkey, 'Priority ' || o_orderpriority)").alias("actions"), F.col("o_orderstatus").alias("impact"),
        F.expr("array(struct('status' AS name, o_orderstatus AS value))").alias("kpis"),
    )
    return weekly_briefs(jobs, sessions, "2026-01-05")


@query(
    "impact_finding",
    """WITH s AS (SELECT SUM(downtime_minutes) / 60.0 AS h, SUM(scrap) AS q FROM plant)
       SELECT FORMAT('Price the loss: ~${:,} ({:.1f} h downtime/loss, {} qty).', CAST(ROUND(h * 120 + q * 4) AS BIGINT), h, CAST(q AS BIGINT)) AS text FROM s""",
    using=("plant",),
)
def impact_finding(t):
    return impact_line(money_impact(t.plant, 120.0, 4.0, domain="plant_oee"))


# Raw registers as a collector would land them, made from the events.
_RAW = """
    SELECT ts AS timestamp, 'collector' AS source, 'M' || CAST(user_id AS STRING) AS device, event_id,
           CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k, CAST(FLOOR(value * 100) AS INT) AS cents,
           CASE WHEN event_type = 'error' THEN 7 ELSE 0 END AS flag
    FROM events"""


def _live_rows(frame):
    """Decoded rows; the event id travels in ``source`` and breaks ties of equal times."""
    parts = frame.selectExpr(
        "CAST(ts AS TIMESTAMP) AS timestamp", "CAST(event_id AS STRING) AS source", "'M' || CAST(user_id AS STRING) AS device",
        "CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k", "CAST(FLOOR(value * 100) AS INT) AS cents",
        "CASE WHEN event_type = 'error' THEN 7 ELSE 0 END AS flag",
    )
    registers = "array(500 + k, cents, 50 + k, 2200 + k, cents % 100, 1000 + k, k * 2, 100000 - k, flag, k * 10) AS registers"
    decoded = live.decode(parts.selectExpr("timestamp", "source", "device", registers))
    return decoded.withColumn("event_id", F.col("source").cast("long")).drop("source")


_DECODED = f"""d AS (SELECT timestamp, device, event_id, ROUND((500 + k) * 0.1::DOUBLE, 6) AS temperature, ROUND(cents * 0.001::DOUBLE, 6) AS vibration,
      ROUND((50 + k) * 0.1::DOUBLE, 6) AS pressure, ROUND((2200 + k) * 0.1::DOUBLE, 6) AS smps_voltage, ROUND((cents % 100) * 0.01::DOUBLE, 6) AS smps_current,
      CAST(1000 + k AS DOUBLE) AS speed, ROUND(k * 2 * 0.1::DOUBLE, 6) AS torque, CAST(100000 - k AS DOUBLE) AS rul,
      CASE WHEN flag > 0 THEN 1.0 ELSE 0.0 END AS failure, ROUND(k * 10 * 0.1::DOUBLE, 6) AS load FROM ({_RAW}))"""
_VALUES = "temperature, vibration, pressure, smps_voltage, smps_current, speed, torque, rul, failure, load"


@query("register_decode", f"WITH {_DECODED} SELECT event_id, device, {_VALUES} FROM d")
def register_decode(t):
    return _live_rows(t.events).drop("timestamp")


def _stream(t):
    schema = t.events.schema
    return _live_rows(live.as_stream(t.spark, t.folder, schema, pattern="events.parquet"))


@query(
    "live_latest",
    f"""WITH {_DECODED} SELECT device, {_VALUES} FROM d QUALIFY ROW_NUMBER() OVER (PARTITION BY device ORDER BY timestamp DESC, event_id DESC) = 1""",
)
def live_latest(t):
    return live.latest_values(_live_rows(t.events), "device", "timestamp", "event_id").drop("timestamp")


@query(
    "live_latest_stream",
    f"""WITH {_DECODED} SELECT device, {_VALUES} FROM d QUALIFY ROW_NUMBER() OVER (PARTITION BY device ORDER BY timestamp DESC, event_id DESC) = 1""",
)
def live_latest_stream(t):
    """The same rows from the events read as a stream."""
    out = _scratch(t, "latest")
    live.start_latest(_stream(t), "device", "timestamp", "event_id", out, _scratch(t, "latest-state")).awaitTermination()
    return live.read_latest(t.spark, out).drop("timestamp", "event_id")


_ALERTS = """, w AS (SELECT CAST(timestamp AS DATE) AS day, device, COUNT(*) AS rows, AVG(vibration) AS mean_vibration,
        ARG_MAX(vibration, (timestamp, event_id)) AS vibration, ARG_MAX(failure, (timestamp, event_id)) AS failure FROM d GROUP BY 1, 2)
    SELECT STRFTIME(day, '%Y-%m-%d') AS day, device, rows, ROUND(vibration, 6) AS vibration, ROUND(mean_vibration, 6) AS mean_vibration,
           vibration > mean_vibration * 1.5 + 0.1 AS spike, failure >= 1 AS failed FROM w"""


def _day(df):
    return rounded(df.withColumn("day", F.date_format("window_start", "yyyy-MM-dd")).select("day", "device", "rows", "vibration", "mean_vibration", "spike", "failed"))


@query("live_alerts", f"WITH {_DECODED}{_ALERTS}")
def live_alerts(t):
    return _day(live.alerts(_live_rows(t.events), "device", "timestamp", "event_id"))


def _scratch(t, name):
    return f"{checkpoint_dir(t.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(
    "live_alerts_stream",
    f"WITH {_DECODED}{_ALERTS} WHERE (spike OR failed) AND day < (SELECT CAST(MAX(timestamp) - INTERVAL 1 HOUR AS DATE) FROM d)",
)
def live_alerts_stream(t):
    """Windows the watermark has passed, written to an alert table by the stream."""
    out = _scratch(t, "alerts")
    live.start_alerts(_stream(t), "device", "timestamp", "event_id", out, _scratch(t, "alerts-state")).awaitTermination()
    return _day(t.spark.read.parquet(out))


@query(
    "live_buffer",
    f"""WITH {_DECODED}, u AS (SELECT * FROM d QUALIFY ROW_NUMBER() OVER (PARTITION BY device, timestamp ORDER BY event_id) = 1)
        SELECT device, event_id, vibration FROM u ORDER BY timestamp DESC, event_id DESC LIMIT 50000""",
)
def live_buffer(t):
    out = _scratch(t, "buffer")
    live.append_buffer(_stream(t), out, _scratch(t, "buffer-state"), key=("event_id",)).awaitTermination()
    return live.read_buffer(t.spark, out, 50_000, tie=("event_id",)).select("device", "event_id", "vibration")


@query(
    "live_trend",
    f"""WITH {_DECODED}, l AS (SELECT * FROM d ORDER BY timestamp DESC, event_id DESC LIMIT 50),
             i AS (SELECT vibration, ROW_NUMBER() OVER (ORDER BY timestamp, event_id) - 1 AS pos FROM l)
        SELECT ROUND(REGR_SLOPE(vibration, pos), 8) AS slope, COUNT(*) AS points, ROUND(ARG_MAX(vibration, pos), 6) AS last_value FROM i""",
)
def live_trend(t):
    return rounded(live.recent_trend(_live_rows(t.events), "vibration", ["timestamp", "event_id"]), 8)


@query(
    "live_trend_stream",
    f"""WITH {_DECODED}, l AS (SELECT * FROM d ORDER BY timestamp DESC, event_id DESC LIMIT 50),
             i AS (SELECT vibration, ROW_NUMBER() OVER (ORDER BY timestamp, event_id) - 1 AS pos FROM l)
        SELECT ROUND(REGR_SLOPE(vibration, pos), 8) AS slope, COUNT(*) AS points, ROUND(ARG_MAX(vibration, pos), 6) AS last_value FROM i""",
)
def live_trend_stream(t):
    """The trend of the newest rows, kept up to date by a stream job."""
    out = _scratch(t, "trend")
    live.start_trend(_stream(t), "vibration", ["timestamp", "event_id"], out, _scratch(t, "trend-state")).awaitTermination()
    return rounded(live.read_latest(t.spark, out).drop("_rows"), 8)


@query(
    "live_forecast",
    f"""WITH {_DECODED}, l AS (SELECT * FROM d ORDER BY timestamp DESC, event_id DESC LIMIT 500),
             i AS (SELECT vibration, ROW_NUMBER() OVER (ORDER BY timestamp, event_id) - 1 AS pos FROM l),
             f AS (SELECT REGR_SLOPE(vibration, pos) AS a, REGR_INTERCEPT(vibration, pos) AS b, COUNT(*) AS n FROM i)
        SELECT CAST(s AS BIGINT) AS step, ROUND(b + a * (n - 1 + s), 6) AS yhat FROM f, UNNEST(GENERATE_SERIES(1, 24)) u(s)""",
)
def live_forecast(t):
    """A straight line through the newest 500 values, 24 steps on."""
    return rounded(live.recent_forecast(_live_rows(t.events), "vibration", ["timestamp", "event_id"]))


@query(
    "live_insights",
    f"""WITH {_DECODED}, l AS (SELECT * FROM d QUALIFY ROW_NUMBER() OVER (PARTITION BY device ORDER BY timestamp DESC, event_id DESC) = 1),
             m AS (SELECT device, AVG(vibration) AS mean_v, COUNT(*) AS n FROM d GROUP BY device),
             b AS (SELECT device, LIST_FILTER([FORMAT('Buffer {{}} rows', n),
                     CASE WHEN vibration > mean_v * 1.5 + 0.1 THEN FORMAT('Vibration spike {{:.3f}} (mean {{:.3f}}): inspect bearings.', vibration, mean_v)
                          ELSE FORMAT('Vibration {{:.3f}} within recent envelope.', vibration) END,
                     FORMAT('Temperature {{:.2f}}', temperature),
                     CASE WHEN failure >= 1 THEN 'Failure flag 1 on the latest packet: open a maintenance ticket.' END], lambda x: x IS NOT NULL) AS lines
                   FROM l JOIN m USING (device))
        SELECT device, UNNEST(GENERATE_SERIES(0, LEN(lines) - 1)) AS seq, UNNEST(lines) AS line FROM b""",
)
def live_insights(t):
    return rounded(live.insights(_live_rows(t.events), "device", "timestamp", "event_id"))
