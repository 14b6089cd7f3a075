"""Text cleaning and matching keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from laureate.fixed import NAME_KEY_STRIPPED, UNKNOWN


def trimmed(text: Column, any_whitespace: bool = False) -> Column:
    """Strip outer blanks; ``any_whitespace`` also strips tabs and Unicode spaces."""
    if not any_whitespace:
        return F.trim(text)
    return F.regexp_replace(text, r"(?U)^\s+|(?U)\s+$", "")


def blank_as_null(text: Column, any_whitespace: bool = False) -> Column:
    return F.nullif(trimmed(text, any_whitespace), F.lit(""))


def waterfall(
    *candidates: Column, default: str = UNKNOWN, any_whitespace: bool = False
) -> Column:
    """First candidate that is neither NULL nor blank, else ``default``."""
    return F.coalesce(
        *[blank_as_null(c, any_whitespace) for c in candidates], F.lit(default)
    )


def first_token(text: Column, separator: str = ",") -> Column:
    """Text before the first separator; NULL when the text is NULL."""
    return F.get(F.split(text, rf"\Q{separator}\E"), F.lit(0))


def match_name(name: Column, any_whitespace: bool = False) -> Column:
    """Key for exact title matches: outer blanks and letter case ignored."""
    return F.lower(trimmed(name, any_whitespace))


def name_key(
    name: Column, unicode_letters: bool = False, any_whitespace: bool = False
) -> Column:
    """Key for near-identical titles: punctuation ignored as well.

    Outside ASCII every letter counts as punctuation, so titles in other scripts
    share the empty key. ``unicode_letters`` keeps letters and digits of all
    scripts, and the title itself where nothing else is left.
    """
    base = match_name(name, any_whitespace)
    if not unicode_letters:
        return F.regexp_replace(base, NAME_KEY_STRIPPED, "")
    kept = F.regexp_replace(base, r"[^\p{L}\p{M}\p{N} ]", "")
    return F.when(F.trim(kept) == "", base).otherwise(kept)
