"""Text jobs over questions, logged SQL and messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ordercash.functions import messages, questions, sqllog
from ordercash.model import SAP, SAP_TABLES, catalog
from registry.base import query

CATALOG = catalog(SAP)


def _any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _list(values) -> str:
    return "(" + ", ".join(f"('{v}')" for v in values) + ")"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


@query(
    "dataset_questions",
    f"""SELECT question_id, question,
        {_any('lower(question)', questions.DOMAIN_WORDS)} AS is_dataset FROM questions""",
)
def _(s):
    return questions.dataset_questions(s.questions())


@query(
    "dataset_messages",
    f"""SELECT conv_id, turn, {_any('lower(text)', questions.DOMAIN_WORDS)} AS is_dataset
    FROM conversations""",
)
def _(s):
    flagged = questions.dataset_questions(s.messages(), "text")
    return flagged.select("conv_id", "turn", "is_dataset")


_HINTS = r"""SELECT question_id, question,
    trim(regexp_replace(question, '\s+', ' ', 'g')) AS normalized,
    NULLIF(regexp_extract(trim(regexp_replace(question, '\s+', ' ', 'g')),
        '(?i)\bcustomer\s+([A-Za-z0-9_-]+)\b', 1), '') AS customer_hint,
    NULLIF(regexp_extract(trim(regexp_replace(question, '\s+', ' ', 'g')),
        '(?i)\border\s+([A-Za-z0-9_-]+)\b', 1), '') AS order_hint
    FROM questions"""


@query("question_hints", _HINTS)
def _(s):
    return questions.question_hints(s.questions())


_CASES = " ".join(
    "WHEN " + " AND ".join(_any("q", words) for words in groups) + f" THEN '{name}'"
    for name, groups in questions.INTENTS
)


_INTENT = f"""SELECT question_id, question, CASE {_CASES} END AS intent FROM (
        SELECT *, lower(normalized)
            || CASE WHEN customer_hint IS NULL THEN '' ELSE ' customer order' END
            || CASE WHEN order_hint IS NULL THEN '' ELSE ' order' END AS q
        FROM ({_HINTS}))"""


@query("question_intent", _INTENT)
def _(s):
    return questions.question_intent(s.questions())


_TABLE_ROWS = " UNION ".join(
    f"""SELECT question_id, t AS table_name FROM questions, (VALUES {_list(tables)[1:-1]}) v(t)
    WHERE {_any('lower(question)', words)}"""
    for words, tables in questions.TABLE_GROUPS
)


_TABLES = f"""SELECT * FROM hits UNION SELECT question_id, '{questions.ALWAYS}' FROM questions
    UNION SELECT question_id, t FROM questions, (VALUES {_list(SAP_TABLES)[1:-1]}) v(t)
        WHERE question_id NOT IN (SELECT question_id FROM hits)"""


@query("question_tables", _TABLES, ctes={"hits": _TABLE_ROWS})
def _(s):
    return questions.question_tables(s.questions())


# The same jobs over the texts that are given: turns of conversations, and whole documents.
_ASKED = {
    "messages": "SELECT concat(conv_id, '/', turn) AS question_id, text AS question FROM conversations",
    "documents": "SELECT doc_id AS question_id, text AS question FROM documents",
}


def _asked(s, name):
    if name == "messages":
        return s.messages().select(
            F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("question_id"),
            F.col("text").alias("question"),
        )
    return s.raw("documents").select(F.col("doc_id").alias("question_id"), F.col("text").alias("question"))


def _over(sql: str) -> str:
    return sql.replace("FROM questions", "FROM asked")


def _register_over(name: str) -> None:
    asked = {"asked": _ASKED[name]}
    found = ["question_id", "customer_hint", "order_hint"]
    hints = f"SELECT {', '.join(found)}, md5(normalized) AS normalized FROM ({_over(_HINTS)})"

    @query(f"question_hints_{name}", hints, ctes=asked)
    def _(s):
        return questions.question_hints(_asked(s, name)).select(*found, F.md5("normalized").alias("normalized"))

    @query(f"question_intent_{name}", f"SELECT question_id, intent FROM ({_over(_INTENT)})", ctes=asked)
    def _(s):
        return questions.question_intent(_asked(s, name)).select("question_id", "intent")

    @query(f"question_tables_{name}", _over(_TABLES), ctes={**asked, "hits": _over(_TABLE_ROWS)})
    def _(s):
        return questions.question_tables(_asked(s, name))


for _name in _ASKED:
    _register_over(_name)


_AUDIT = rf"""SELECT log_id, sql_text, verdict, CASE WHEN verdict = 'ok' THEN
        CASE WHEN contains(lower(raw), 'limit') THEN raw ELSE raw || ' LIMIT 20' END END
        AS final_sql
    FROM (SELECT *, CASE WHEN trim(sql_text) = '' THEN 'empty'
            WHEN NOT (starts_with(lower(raw), 'select') OR starts_with(lower(raw), 'with'))
                THEN 'not_select'
            WHEN regexp_matches(lower(raw), '\b({'|'.join(sqllog.FORBIDDEN)})\b')
                THEN 'forbidden' ELSE 'ok' END AS verdict
        FROM (SELECT *, rtrim(trim(sql_text), ';') AS raw FROM {{log}}))"""


@query("sql_log_audit", _AUDIT.format(log="sql_log"))
def _(s):
    return sqllog.sql_log_audit(s.sql_log())


@query("sql_log_audit_joins", _AUDIT.format(log="joined_log"))
def _(s):
    return sqllog.sql_log_audit(s.joined_sql_log())


_N = sqllog.NAME
_COLUMN_ROWS = [(t, c) for t, cols in CATALOG.items() for c in cols]
_REF = rf"\b(from|join)\s+({_N})(?:\s+(?:as\s+)?({_N}))?"
_IDENTIFIER_CTES = {
    "lexed": rf"""SELECT log_id, regexp_replace(regexp_replace(lower(sql_text),
            '''(?:''''|[^''])*''', '''''', 'g'), '"(?:[^"]|"")*"', '""', 'g') AS q
        FROM sql_log""",
    "table_refs": f"""SELECT log_id, unnest(regexp_extract_all(q, '{_REF}', 2)) AS name,
            unnest(range(len(regexp_extract_all(q, '{_REF}', 2)))) AS pos,
            COALESCE(unnest(regexp_extract_all(q, '{_REF}', 3)), '') AS alias FROM lexed""",
    "known_refs": f"SELECT * FROM table_refs WHERE name IN {_in(CATALOG)}",
    "name_owners": f"""SELECT log_id, owner, arg_max(tbl, pos) AS tbl FROM (
        SELECT log_id, name AS owner, name AS tbl, 2 * pos AS pos FROM known_refs
        UNION ALL SELECT log_id, alias, name, 2 * pos + 1 FROM known_refs
            WHERE alias <> '' AND alias NOT IN {_in(sqllog.RESERVED)})
        GROUP BY log_id, owner""",
    "as_names": rf"""SELECT log_id, unnest(regexp_extract_all(q, '\bas\s+({_N})\b', 1)) AS name
        FROM lexed""",
    "qualified": rf"""SELECT log_id, unnest(regexp_extract_all(q, '\b({_N})\.({_N})\b', 1)) AS o,
            unnest(regexp_extract_all(q, '\b({_N})\.({_N})\b', 2)) AS c FROM lexed""",
    "loose_words": rf"""SELECT DISTINCT log_id, unnest(regexp_extract_all(regexp_replace(
            regexp_replace(q, '\b{_N}\.{_N}\b', ' ', 'g'), '\b[0-9]+(?:\.[0-9]+)?\b', ' ', 'g'),
            '\b({_N})\b', 1)) AS w FROM lexed""",
    "catalog_columns": "SELECT * FROM (VALUES "
    + ", ".join(f"('{t}', '{c}')" for t, c in _COLUMN_ROWS) + ") v(tbl, col)",
    "bad_names": f"""SELECT log_id, name AS bad FROM table_refs WHERE name NOT IN {_in(CATALOG)}
        UNION SELECT log_id, o || '.' || c FROM qualified q WHERE NOT EXISTS (
            SELECT 1 FROM name_owners n JOIN catalog_columns k ON k.tbl = n.tbl
            WHERE n.log_id = q.log_id AND n.owner = q.o AND k.col = q.c)
        UNION SELECT log_id, w FROM loose_words l
            WHERE w NOT IN {_in(sqllog.RESERVED)} AND w NOT IN {_in(CATALOG)}
            AND w NOT IN (SELECT col FROM catalog_columns)
            AND NOT EXISTS (SELECT 1 FROM name_owners n
                WHERE n.log_id = l.log_id AND n.owner = l.w)
            AND NOT EXISTS (SELECT 1 FROM as_names a
                WHERE a.log_id = l.log_id AND a.name = l.w)""",
}


_UNKNOWN = """SELECT s.log_id, COALESCE(string_agg(b.bad, ', ' ORDER BY b.bad), '') AS unknown
    FROM {log} s LEFT JOIN bad_names b ON b.log_id = s.log_id GROUP BY s.log_id"""


def _unknown(log):
    checked = sqllog.sql_log_identifiers(log, CATALOG)
    return checked.select("log_id", F.array_join("unknown", ", ").alias("unknown"))


@query("sql_log_identifiers", _UNKNOWN.format(log="sql_log"), ctes=_IDENTIFIER_CTES)
def _(s):
    return _unknown(s.sql_log())


@query(
    "sql_log_identifiers_joins",
    _UNKNOWN.format(log="joined_log"),
    ctes={**_IDENTIFIER_CTES, "lexed": _IDENTIFIER_CTES["lexed"].replace("sql_log", "joined_log")},
)
def _(s):
    return _unknown(s.joined_sql_log())


_NAMES = sorted({*CATALOG, *(c for cols in CATALOG.values() for c in cols)})


_ALIASES = rf"""SELECT log_id, n_words, n_unknown, CASE
        WHEN n_unknown > greatest(5, floor(n_words * CAST(0.45 AS DOUBLE)))
            THEN 'too_many_unknown'
        WHEN len(ids) <> len(list_distinct(ids)) THEN 'duplicate_id_alias'
        WHEN len(list_filter(ids, lambda a: a NOT IN {_in(sqllog.ID_ALIASES)})) > 0
            THEN 'bad_id_alias' ELSE 'ok' END AS verdict
    FROM (SELECT log_id, ids, CAST(len(words) AS INT) AS n_words, CAST(len(list_filter(words,
            lambda w: w NOT IN {_in(_NAMES)})) AS INT) AS n_unknown
        FROM (SELECT log_id,
            list_filter(list_distinct(regexp_extract_all(lower(sql_text), '\b({_N})\b', 1)),
                lambda w: w NOT IN {_in(sqllog.OLD_RESERVED)}) AS words,
            list_filter(regexp_extract_all(lower(sql_text), '\bas\s+({_N})\b', 1),
                lambda a: ends_with(a, '_id')) AS ids
        FROM {{log}}))"""


@query("sql_log_aliases", _ALIASES.format(log="sql_log"))
def _(s):
    return sqllog.sql_log_aliases(s.sql_log(), CATALOG).drop("sql_text")


@query("sql_log_aliases_joins", _ALIASES.format(log="joined_log"))
def _(s):
    return sqllog.sql_log_aliases(s.joined_sql_log(), CATALOG).drop("sql_text")


@query(
    "result_digest",
    """SELECT n AS n_results, 'Found ' || n || ' result(s).' || chr(10) || lines AS digest FROM (
        SELECT (SELECT COUNT(*) FROM o2c_products) AS n, string_agg(
            '- product_id: ' || product_id || ', product_name: ' || product_name ||
            ', product_type: ' || product_type || ', old_sku: ' || old_sku ||
            ', is_deleted: ' || is_deleted, chr(10) ORDER BY product_id) AS lines
        FROM (SELECT * FROM o2c_products ORDER BY product_id LIMIT 5))""",
)
def _(s):
    return messages.result_digest(s.star()["products"], ["product_id"])


@query(
    "result_digest_long",
    """SELECT n AS n_results, 'Found ' || n || ' result(s):' || chr(10) || lines AS digest FROM (
        SELECT (SELECT COUNT(*) FROM o2c_orders) AS n, string_agg('- order_id: ' || order_id ||
            ', customer_id: ' || customer_id || ', order_date: ' || CAST(order_date AS VARCHAR) ||
            ', total_amount: ' || CAST(CAST(total_amount AS DOUBLE) AS VARCHAR),
            chr(10) ORDER BY order_id) AS lines
        FROM (SELECT * FROM o2c_orders ORDER BY order_id LIMIT 10))""",
)
def _(s):
    rows = s.star()["orders"].select("order_id", "customer_id", "order_date", "total_amount")
    return messages.result_digest(rows, ["order_id"], rows=10, columns=None, mark=":")


def _stripped(column: str) -> str:
    return rf"""regexp_replace(list_aggregate(list_filter(string_split({column}, chr(10)),
        lambda l: NOT (starts_with(regexp_replace(l, '^\s+|\s+$', '', 'g'), '|') OR
        regexp_matches(regexp_replace(l, '^\s+|\s+$', '', 'g'), '^[-| ]+$'))),
        'string_agg', chr(10)), '(?:\A|\n)\s*\z', '')"""


@query(
    "strip_markdown_tables",
    f"""SELECT conv_id, turn, COALESCE({_stripped('text')}, '') AS text FROM conversations""",
)
def _(s):
    return s.messages().select(
        "conv_id", "turn", messages.strip_markdown_tables(F.col("text")).alias("text")
    )


@query(
    "strip_report_tables",
    f"""SELECT conv_id, turn, COALESCE({_stripped('text')}, '') AS text FROM (
        SELECT conv_id, turn, text || chr(10) || '| a | b |' || chr(10) || '|---|---|' || chr(10)
            || '  --- ' || chr(10) || '  ' || role || ' | x' || chr(10) || '  ' || chr(10) AS text
        FROM conversations)""",
)
def _(s):
    table = "\n| a | b |\n|---|---|\n  --- \n  "
    text = F.concat("text", F.lit(table), "role", F.lit(" | x\n  \n"))
    return s.messages().select(
        "conv_id", "turn", messages.strip_markdown_tables(text).alias("text")
    )
