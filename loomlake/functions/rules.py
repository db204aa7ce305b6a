"""Column functions on permission rules: colon-separated segments, ``*`` for any one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEGMENTS = 4


def matches(rule: Column, permission: Column) -> Column:
    """Whether a rule grants a permission: its segments are equal or ``*``; a shorter rule is a prefix.

    A longer rule never matches, and blanks or nulls match nothing.
    """
    r, p = F.split(rule, ":"), F.split(permission, ":")
    equal = F.forall(F.zip_with(r, F.slice(p, 1, F.size(r)), lambda a, b: (a == "*") | a.eqNullSafe(b)), lambda x: x)
    return F.coalesce((rule != "") & (permission != "") & (F.size(r) <= F.size(p)) & equal, F.lit(False))


def rule_error(rule: Column, namespace: str) -> Column:
    """What is wrong with a rule, null if nothing."""
    first = F.get(F.split(rule, ":"), F.lit(0))
    return (
        F.when(~F.coalesce(rule.rlike(r"^[a-zA-Z0-9:_*.-]+$"), F.lit(False)), "characters")
        .when(F.size(F.split(rule, ":")) > SEGMENTS, "segments")
        .when((first != namespace) & (first != "*"), "namespace")
    )
