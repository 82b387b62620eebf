"""Read-only guard for generated SQL (PRJ-13)."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import SparkSession

#: Words of statements that write.
WRITING = ("INSERT", "UPDATE", "DELETE", "DROP", "TRUNCATE", "ALTER", "CREATE", "GRANT", "REVOKE")
_WORD = re.compile(r"\b(" + "|".join(WRITING) + r")\b", re.IGNORECASE)
_QUOTED = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.DOTALL)
#: Logical nodes that a query may parse to at its top.
READING = frozenset("Project Filter Aggregate Sort GlobalLimit LocalLimit Limit Distinct Union Intersect Except UnresolvedWith With Join SubqueryAlias UnresolvedHaving WithWindowDefinition Offset GlobalOffset LocalOffset UnresolvedInlineTable OneRowRelation Generate Pivot Unpivot Tail Sample".split())


@dataclass(frozen=True)
class Verdict:
    allowed: bool
    reason: str = ""


def check_words(sql: str, strict: bool = False) -> Verdict:
    """First word SELECT or WITH and no writing word; strict also looks inside literals and comments, as a plain filter would."""
    seen = sql if strict else _QUOTED.sub(" '' ", sql)
    found = _WORD.search(seen)
    if found:
        return Verdict(False, f"forbidden word {found.group(1).upper()}")
    first = re.match(r"[\s(]*(\w+)", seen)
    if not first or first.group(1).upper() not in ("SELECT", "WITH"):
        return Verdict(False, "only SELECT and WITH are allowed")
    return Verdict(True)


def check(spark: SparkSession, sql: str, strict: bool = False) -> Verdict:
    """The words, and where the session has a parser the class of the parsed plan."""
    by_words = check_words(sql, strict)
    if not by_words.allowed:
        return by_words
    try:
        parser = spark._jsparkSession.sessionState().sqlParser()
    except AttributeError:
        return by_words
    try:
        node = parser.parsePlan(sql.rstrip().rstrip(";")).getClass().getSimpleName()
    except Exception as e:
        return Verdict(False, "cannot be parsed: " + str(e).split("\n")[0][:200])
    return Verdict(True) if node in READING else Verdict(False, f"statement of kind {node}")
