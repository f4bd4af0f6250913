"""Inputs of the registered queries, derived from the given tables.

Each derived table is stated once as a list of SQL expressions that mean the same in Spark and in
the oracle; only time formatting differs between the two.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.registry import table

FIRST_YEAR, LAST_YEAR = 1995, 2001

_SPARK_TIME = {
    "TS14": "date_format(o_orderdate, 'yyyyMMddHHmmss')",
    "FINAL14": "date_format(add_months(o_orderdate, cast(3 * (o_orderkey % 3) as int)), 'yyyyMMddHHmmss')",
}
_ORACLE_TIME = {
    "TS14": "strftime(o_orderdate, '%Y%m%d%H%M%S')",
    "FINAL14": "strftime(o_orderdate + to_months(cast(3 * (o_orderkey % 3) as int)), '%Y%m%d%H%M%S')",
}

_ORIGINAL = (
    "concat('https://www.reddit.com/r/c', cast(o_custkey % 100 as string), "
    "case when o_orderkey % 2 = 0 then '/about/moderators' else '/wiki/index' end)"
)
_PREFIX = "'https://web.archive.org/web/'"

# One capture per order: 100 communities x 2 templates.
CAPTURES = {
    "pos": "o_orderkey",
    "community": "concat('c', cast(o_custkey % 100 as string))",
    "url": _ORIGINAL,
    "ts14": "{TS14}",
    "digest": "o_orderstatus",
    "year": "cast(substr({TS14}, 1, 4) as int)",
    "month": "cast(substr({TS14}, 5, 2) as int)",
    "half": "case when cast(substr({TS14}, 5, 2) as int) <= 6 then 1 else 2 end",
    "error_code": "cast(o_orderkey % 8 as int)",
    "capture_url": "concat(" + _PREFIX + ", {TS14}, '/', " + _ORIGINAL + ")",
    "final_url": "concat(" + _PREFIX + ", {FINAL14}, '/', " + _ORIGINAL + ")",
}

# One error event per line item: several errors per capture.
ERRORS = {
    "url": "concat('https://archive.example/', cast(l_orderkey as string))",
    "error_code": "cast(l_linenumber % 7 as int)",
    "ts": "cast(l_partkey * 10 + l_suppkey as double)",
}

# One attempt per line item, status from its keys; line number 1..7 is the attempt.
FETCH_LOG = {
    "url": (
        "concat(case when l_orderkey % 3 = 0 then 'http' else 'https' end, "
        "'://archive.example/', cast(l_orderkey as string))"
    ),
    "attempt": "l_linenumber",
    "status": (
        "cast(case l_suppkey % 9 when 0 then 200 when 1 then 429 when 2 then 403 when 3 then 403 "
        "when 4 then 503 when 5 then 404 when 6 then 403 else null end as int)"
    ),
    "error": (
        "case l_suppkey % 9 when 7 then 'timeout' when 8 then "
        "(case l_partkey % 4 when 0 then 'ssl' when 1 then 'connection' when 2 then 'other' "
        "else 'timeout' end) else null end"
    ),
}

# One labelled text per labelled document.
LABELLED = {
    "doc_id": "documents.doc_id",
    "text": "text",
    "label": "quality",
    "score": "cast(documents.doc_id % 97 as double) / 97",
}


def _exprs(columns: dict[str, str], times: dict[str, str]) -> list[str]:
    out = []
    for name, expr in columns.items():
        for mark, text in times.items():
            expr = expr.replace("{" + mark + "}", text)
        out.append(f"{expr} as {name}")
    return out


def oracle_view(columns: dict[str, str], source: str) -> str:
    return "select " + ", ".join(_exprs(columns, _ORACLE_TIME)) + f" from {source}"


ORACLE_VIEWS = {
    "captures": oracle_view(CAPTURES, "orders"),
    "errors": oracle_view(ERRORS, "lineitem"),
    "fetch_log": oracle_view(FETCH_LOG, "lineitem"),
    "labelled": oracle_view(
        LABELLED, "documents join labels on documents.doc_id = labels.doc_id"
    ),
}


def oracle(body: str, *views: str, **more: str) -> str:
    """Oracle text: the named views, then any further common table expressions, then ``body``."""
    parts = [f"{v} as ({ORACLE_VIEWS[v]})" for v in views]
    parts += [f"{name} as ({text})" for name, text in more.items()]
    return ("with " + ", ".join(parts) + " " if parts else "") + body


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*_exprs(CAPTURES, _SPARK_TIME))


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*_exprs(ERRORS, {}))


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*_exprs(FETCH_LOG, {}))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id").selectExpr(
        "doc_id", "text", "quality as label", "cast(doc_id % 97 as double) / 97 as score"
    )
