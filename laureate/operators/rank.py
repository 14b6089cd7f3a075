"""Ranks, champions, top-k and peaks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laureate.fixed import TOP_LABEL_SEPARATOR
from laureate.operators.dedup import keep_first
from laureate.operators.lookup import left_lookup
from laureate.operators.order import in_order
from laureate.operators.reuse import written_once


@dataclass(frozen=True)
class Contest:
    """A dense rank to compute: who takes part, in which groups, by what.

    ``order`` lists non-NULL numeric columns, compared from high to low. Rows with a
    NULL in a ``within`` column do not take part. Groups with fewer than ``min_size``
    participants are not ranked. ``size`` names an extra output column with the
    number of participants.
    """

    rank: str
    within: tuple[str, ...]
    order: tuple[str, ...]
    takes_part: Column | None = None
    min_size: int = 1
    size: str | None = None


ROWS = "_rows"


def score_profile(df: DataFrame, contests: Sequence[Contest]) -> DataFrame:
    """Distinct combinations of everything the contests look at, with row counts.

    Rows that tie in every respect fold into one inside each task, so a tie of
    any size costs one row per task in the shuffle.
    """
    return (
        _with_keys(df, contests)
        .groupBy(*_profile_keys(contests))
        .agg(F.count("*").alias(ROWS))
    )


def ranked_profile(profile: DataFrame, contests: Sequence[Contest]) -> DataFrame:
    """The profile's rows that take part in a contest, with their ranks.

    A window over a whole group would sort all its rows in one task. Here the distinct
    places of all contests and groups are sorted together over range partitions, which
    cut large groups wherever rows are even, and numbered in each partition. A place is
    its number there plus the places of its group in the partitions before: one number
    for each partition and group.
    """
    keys = _profile_keys(contests)
    groups = _group_columns(contests)
    g = [f"_g{i}" for i in range(len(groups))]
    order, places = _common_order(profile, contests)

    def entry(i: int, contest: Contest) -> Column:
        own_groups = [F.col(_group(c)) if c in contest.within else F.lit("") for c in groups]
        return F.struct(
            F.lit(i).alias("_contest"),
            F.col(_part(i)).alias("_in"),
            *[c.alias(name) for c, name in zip(own_groups, g)],
            *[c.alias(name) for name, c in places[i].items()],
        )

    entries = [entry(i, c) for i, c in enumerate(contests)]
    rows = (
        profile.select(*keys, ROWS, F.explode(F.array(*entries)).alias("_e"))
        .select(*keys, ROWS, "_e.*")
        .filter("_in")
        .drop("_in")
    )
    place = ["_contest", *g, *order]
    distinct = rows.groupBy(*place).agg(
        F.sum(ROWS).alias("_members"), F.count("*").alias("_entries")
    )
    ranked = _dense(distinct, ["_contest", *g], order)
    found = left_lookup(
        rows.withColumn("_spread", F.xxhash64(*keys)),
        ranked.select(*place, "_entries", "_place", "_group_members"),
        place, "_spread", weight="_entries",
    )
    columns = []
    for i, contest in enumerate(contests):
        mine = (F.col("_contest") == i) & (F.col("_group_members") >= contest.min_size)
        columns.append(F.max(F.when(mine, F.col("_place"))).alias(contest.rank))
        if contest.size:
            columns.append(F.max(F.when(mine, F.col("_group_members"))).alias(contest.size))
    return found.groupBy(*keys).agg(F.max(ROWS).alias(ROWS), *columns)


def _dense(places: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Number the rows of each group from 1, high to low, in ``_place``.

    Rows are distinct in group and order. ``_group_members`` adds up the ``_members``
    of the group.
    """
    sorted_ = in_order(places, [*[F.col(c) for c in group], *_descending(order)])
    stretches = sorted_.groupBy("_part", *group).agg(
        F.min("_row").alias("_first"), F.count("*").alias("_n"),
        F.sum("_members").alias("_sum"),
    )
    # At most one row of a group for each partition.
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stretches.select(
        "_part", *group, "_n",
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
        F.sum("_sum").over(whole).alias("_group_members"),
    )
    return (
        left_lookup(sorted_, offsets, ["_part", *group], "_row", weight="_n")
        .withColumn("_place", F.col("_row") + F.col("_shift"))
        .drop("_part", "_row", "_shift")
    )


def _common_order(
    profile: DataFrame, contests: Sequence[Contest]
) -> tuple[list[str], list[dict[str, Column]]]:
    """Order columns shared by all contests, and each contest's values for them.

    A contest with fewer columns has 0 there. Values keep the type of the first
    contest that has the column.
    """
    names, values = [], [{} for _ in contests]
    for j in range(max(len(c.order) for c in contests)):
        names.append(f"_o{j}")
        sources = [c.order[j] if j < len(c.order) else None for c in contests]
        kind = next(profile.schema[c].dataType for c in sources if c)
        for place, source in zip(values, sources):
            place[names[-1]] = (F.col(source) if source else F.lit(0)).cast(kind)
    return names, values


def _descending(columns: Sequence[str]) -> list[Column]:
    return [F.desc(c) for c in columns]


def dense_ranks(df: DataFrame, contests: Sequence[Contest], spread_by: str) -> DataFrame:
    """Add the contests' ranks (and sizes) to every row; NULL where not ranked.

    The ranks are worked out on the profile and looked up by each row, where a
    tie may be of any size. ``df`` is read twice, so pass a table or the result
    of ``written_once``.
    """
    ranked = ranked_profile(score_profile(df, contests), contests)
    keyed = _with_keys(df, contests)
    added = [c for c in keyed.columns if c not in df.columns]
    return left_lookup(
        keyed, ranked, _profile_keys(contests), spread_by, weight=ROWS
    ).drop(*added)


def dense_ranks_by_key(
    df: DataFrame, contests: Sequence[Contest], key: str, spread_by: str
) -> DataFrame:
    """As ``dense_ranks``, with each contest's ranked rows joined back by ``key``.

    Where rows share a key, each of them meets the ranks of all of them, once for every
    contest. On unique keys the result is that of ``dense_ranks``. Like there, pass a
    table.
    """
    ranked = written_once(
        dense_ranks(df, contests, spread_by).select(
            key, *[c for contest in contests for c in (contest.rank, contest.size) if c]
        ),
        "ranked-keys",
    )
    for contest in contests:
        columns = [c for c in (contest.rank, contest.size) if c]
        places = ranked.filter(F.col(contest.rank).isNotNull()).select(key, *columns)
        df = left_lookup(df, places, [key], spread_by)
    return df


def _part(i: int) -> str:
    return f"_part{i}"


def _group(column: str) -> str:
    return f"_group_{column}"


def _group_columns(contests: Sequence[Contest]) -> list[str]:
    return list(dict.fromkeys(c for contest in contests for c in contest.within))


def _with_keys(df: DataFrame, contests: Sequence[Contest]) -> DataFrame:
    """Add who takes part, and the group columns without NULLs."""
    parts = {}
    for i, contest in enumerate(contests):
        taking = F.lit(True) if contest.takes_part is None else contest.takes_part
        for c in contest.within:
            taking = taking & F.col(c).isNotNull()
        parts[_part(i)] = F.coalesce(taking, F.lit(False))
    groups = {
        _group(c): F.coalesce(F.col(c).cast("string"), F.lit(""))
        for c in _group_columns(contests)
    }
    return df.withColumns({**parts, **groups})


def _profile_keys(contests: Sequence[Contest]) -> list[str]:
    order = list(dict.fromkeys(c for contest in contests for c in contest.order))
    groups = [_group(c) for c in _group_columns(contests)]
    return [*groups, *order, *[_part(i) for i in range(len(contests))]]


def is_first(rank: str) -> Column:
    """TRUE for rank 1, FALSE for other ranks and for rows without a rank."""
    return F.coalesce(F.col(rank) == 1, F.lit(False))


def top_k(df: DataFrame, within: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The ``k`` best rows of each group, numbered from 1 in ``place``."""
    return keep_first(df, [F.col(c) for c in within], order, k, place="place")


def top_k_label(
    ranked: DataFrame, within: Sequence[str], text: Column, name: str
) -> DataFrame:
    """Join the texts of a ``top_k`` result in rank order; k bounds the list."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col("place"), text.alias("text"))))
    return ranked.groupBy(*within).agg(
        F.array_join(F.transform(pairs, lambda p: p["text"]), TOP_LABEL_SEPARATOR).alias(name)
    )


def peak(
    df: DataFrame, group: str, by: str, earliest: str, values: dict[str, str]
) -> DataFrame:
    """One row per group: ``values`` of its highest row, the earliest of equal ones."""
    best = F.max_by(
        F.struct(*[F.col(c).alias(n) for n, c in values.items()]),
        F.struct(F.col(by), -F.col(earliest)),
    )
    return df.groupBy(group).agg(best.alias("_best")).select(group, "_best.*")


def with_peak(
    df: DataFrame, group: str, by: str, earliest: str, values: dict[str, str]
) -> DataFrame:
    """As ``peak``, added to every row of a grouped result."""
    window = Window.partitionBy(group).orderBy(F.desc(by), F.col(earliest))
    return df.withColumns({n: F.first(c).over(window) for n, c in values.items()})
