"""Severity ranks, levels and mappings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions.paths import lookup
from siftline.schemas import SEVERITY_LEVEL, SEVERITY_RANK

# Severities of an imported scanner report, display marks.
IMPORTED = {"HIGH": "high", "MEDIUM": "medium", "LOW": "low"}
MARKS = {"critical": "🔴", "high": "🟠", "medium": "🟡", "low": "🟢"}


def _table(values: dict[str, int], key: Column, default: int) -> Column:
    literal = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(literal, key), F.lit(default))


def rank(severity: Column) -> Column:
    """4 for critical down to 1 for low, 0 for anything else."""
    return _table(SEVERITY_RANK, severity, 0)


def level(severity: Column) -> Column:
    """5 for critical down to 1 for info; unknown and missing count as info."""
    return _table(SEVERITY_LEVEL, severity, 1)


def imported(severity: Column) -> Column:
    return F.coalesce(lookup(IMPORTED, F.upper(severity)), F.lit("medium"))


def is_valid(severity: Column) -> Column:
    return F.coalesce(F.lower(severity).isin(*SEVERITY_LEVEL), F.lit(False))


def mark(severity: Column, default: str = "🟢") -> Column:
    return F.coalesce(lookup(MARKS, severity), F.lit(default))
