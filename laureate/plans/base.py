"""The enriched, deduplicated and categorised games that three reports share."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laureate.fixed import DEFAULT_GATES, GENRE_RENAMES, UNKNOWN, Gates
from laureate.functions.labels import map_values
from laureate.operators.dedup import best_title
from laureate.operators.enrich import gate, join_nearest_seed, membership_flag, resolve
from laureate.operators.metrics import with_era


class Inputs(NamedTuple):
    """``eras`` (columns as in ``schemas.ERA_TABLE``) takes the place of the fixed eras."""

    titles: DataFrame
    seed: DataFrame
    flags: DataFrame
    eras: DataFrame | None = None


@dataclass(frozen=True)
class Options:
    """How titles become games.

    ``unicode_names`` keeps titles in other scripts apart when deduplicating, and
    ``any_whitespace`` treats tabs and Unicode spaces as blanks everywhere.
    """

    gates: Gates = DEFAULT_GATES
    year_tolerance: int = 1
    unicode_names: bool = False
    any_whitespace: bool = False
    genre_renames: Mapping[str, str] = field(default_factory=lambda: dict(GENRE_RENAMES))


DEFAULT_OPTIONS = Options()


def enriched(inputs: Inputs, options: Options = DEFAULT_OPTIONS) -> DataFrame:
    """One row per qualifying title, with fields resolved from the seeds.

    Titles are deduplicated before the seed joins. Which title wins depends on
    staging columns alone, so the result is that of joining first, but far fewer
    rows are joined and no name is left with more than a row per year.
    """
    blanks = options.any_whitespace
    kept = best_title(
        gate(inputs.titles, options.gates),
        unicode_letters=options.unicode_names,
        any_whitespace=blanks,
    )
    seeded = join_nearest_seed(kept, inputs.seed, options.year_tolerance, blanks)
    flagged = membership_flag(seeded, inputs.flags, "_flagged")
    return with_era(resolve(flagged, blanks), inputs.eras)


def games(
    inputs: Inputs, options: Options = DEFAULT_OPTIONS, drop_unknown: bool = False
) -> DataFrame:
    """``enriched`` with genres mapped; some become NULL.

    ``drop_unknown`` removes titles whose winning row has no genre. A losing row
    of the same title never takes its place.
    """
    rows = enriched(inputs, options)
    if drop_unknown:
        rows = rows.filter(F.col("genre") != UNKNOWN)
    return rows.withColumn("genre", map_values("genre", options.genre_renames))
