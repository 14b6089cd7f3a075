"""Labels from years, numbers and category names.

Each function takes a column name or SQL expression as text and builds one CASE
expression. Assembling the same chains from Column objects costs a call into the
JVM per branch and literal, which adds up to seconds per report.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from laureate import fixed


def _literal(value: object) -> str:
    if isinstance(value, str):
        escaped = value.replace("\\", "\\\\").replace("'", "\\'")
        return f"'{escaped}'"
    # Without the suffix Spark would read a decimal.
    return f"{value!r}D" if isinstance(value, float) else str(value)


def _listed(values: Iterable[object]) -> str:
    return ", ".join(_literal(v) for v in values)


def _case(branches: Iterable[tuple[str, object]], default: str) -> Column:
    whens = " ".join(f"WHEN {test} THEN {_literal(value)}" for test, value in branches)
    return F.expr(f"CASE {whens} ELSE {default} END" if whens else default)


def era_label(year: str, eras: Sequence = fixed.ERAS) -> Column:
    return _case(
        ((f"{year} BETWEEN {lo} AND {hi}", label) for lo, hi, label in eras),
        _literal(fixed.NO_ERA),
    )


def era_order(year: str, eras: Sequence = fixed.ERAS) -> Column:
    """Position of the year's era, one past the last for years in none."""
    return _case(
        ((f"{year} BETWEEN {lo} AND {hi}", i) for i, (lo, hi, _) in enumerate(eras, 1)),
        _literal(len(eras) + 1),
    )


def coverage_tier(year: str) -> Column:
    return _case(
        [(f"{year} < {fixed.COVERAGE_SPLIT_YEAR}", fixed.COVERAGE_BEFORE)],
        _literal(fixed.COVERAGE_FROM),
    )


def bucketize(
    value: str,
    buckets: Sequence[tuple[float, object]],
    below: object,
    missing: object = None,
) -> Column:
    """Label of the highest lower bound that ``value`` reaches.

    Without ``missing`` a NULL value gets the ``below`` label.
    """
    branches = [(f"({value}) >= {_literal(bound)}", label) for bound, label in buckets]
    if missing is not None:
        branches.insert(0, (f"({value}) IS NULL", missing))
    return _case(branches, _literal(below))


def bucket_order(
    value: str,
    buckets: Sequence[tuple[float, object]],
    ascending: bool = False,
    missing: int | None = None,
) -> Column:
    """Sort position of the bucket; 1 is the highest one unless ``ascending``."""
    n = len(buckets) + 1
    place = [(bound, n - i if ascending else i + 1) for i, (bound, _) in enumerate(buckets)]
    return bucketize(value, place, 1 if ascending else n, missing)


def map_values(
    value: str,
    renames: Mapping[str, str] = fixed.GENRE_RENAMES,
    dropped: Sequence[str] = fixed.GENRES_DROPPED,
) -> Column:
    """Rename the listed values, turn dropped ones into NULL, keep the others.

    To report shooters on their own, pass renames without that entry.
    """
    by_target: dict[str, list[str]] = {}
    for name, target in renames.items():
        by_target.setdefault(target, []).append(name)
    kept = _case(
        ((f"{value} IN ({_listed(names)})", target) for target, names in by_target.items()),
        value,
    )
    if not dropped:
        return kept
    return F.when(F.expr(f"{value} NOT IN ({_listed(dropped)})"), kept)


def age(year: str, reference_year: int = fixed.REFERENCE_YEAR) -> str:
    """SQL text of the age in years, for the functions below."""
    return f"({reference_year} - {year})"


def age_bucket(years: str) -> Column:
    return bucketize(years, fixed.AGE_BUCKETS, fixed.AGE_BELOW)


def age_bucket_order(years: str) -> Column:
    return bucket_order(years, fixed.AGE_BUCKETS)


def delta_label(critic: str, user: str) -> Column:
    """Who liked it better, judged on the unrounded gap."""
    return bucketize(
        f"{user} - {critic}", fixed.DELTA_BUCKETS, fixed.DELTA_BELOW, fixed.DELTA_MISSING
    )


def longevity_tier(hours: str) -> Column:
    return bucketize(
        hours, fixed.LONGEVITY_BUCKETS, fixed.LONGEVITY_BELOW, fixed.LONGEVITY_MISSING
    )


def longevity_order(hours: str) -> Column:
    return bucket_order(hours, fixed.LONGEVITY_BUCKETS, ascending=True, missing=0)


def ownership_tier(owners: str) -> Column:
    return bucketize(
        owners, fixed.OWNERSHIP_BUCKETS, fixed.OWNERSHIP_BELOW, fixed.OWNERSHIP_MISSING
    )
