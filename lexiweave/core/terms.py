"""Normal forms that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BLANKS = " \t"
BLANKS_SQL = "' ' || chr(9)"


def term(c: Column | str) -> Column:
    """Lower case without surrounding spaces and tabs; null for null and for empty strings."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.lower(F.btrim(c, F.lit(BLANKS))), F.lit(""))


def term_sql(c: str) -> str:
    return f"nullif(lower(trim({c}, {BLANKS_SQL})), '')"


def relation_name(c: Column | str) -> Column:
    """Plain relation name: ``RelationType.IS_AGENT_OF`` and ``is_agent_of`` give ``is-agent-of``."""
    c = F.col(c) if isinstance(c, str) else c
    plain = F.translate(F.lower(F.regexp_replace(F.btrim(c, F.lit(BLANKS)), r"^RelationType\.", "")), "_", "-")
    return F.nullif(F.regexp_replace(plain, "^generic-relation$", "related-to"), F.lit(""))


def relation_name_sql(c: str) -> str:
    plain = f"replace(lower(regexp_replace(trim({c}, {BLANKS_SQL}), '^RelationType\\.', '')), '_', '-')"
    return f"nullif(CASE WHEN {plain} = 'generic-relation' THEN 'related-to' ELSE {plain} END, '')"
