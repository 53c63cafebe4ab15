"""Threat classes of requests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes and patterns of the threat classes.
UNKNOWN, INVALID, SQL_INJECTION, XSS, TRAVERSAL, SCAN = 0, 1, 10, 20, 30, 40
XSS_PATTERN = "<script|script>|alert|onmouseover|onmouseout"
SQL_PATTERN = "'.*(insert|update|exec|execute)"


def threat_class(path: Column, uri: Column, query: Column) -> Column:
    """Invalid before traversal before script before SQL injection; ``path`` is NULL if the URI is not valid."""
    return (
        F.when(path.isNull(), INVALID)
        .when(path.contains("/../") | uri.contains("%00"), TRAVERSAL)
        .when(query.rlike(XSS_PATTERN), XSS)
        .when(query.rlike(SQL_PATTERN), SQL_INJECTION)
        .otherwise(UNKNOWN)
    )
