"""DuckDB statements that define the expected result of every query.

They are written from the definitions rather than from the Spark code: range
joins instead of repeated seed rows, plain windows instead of counted ranks, value
lists instead of conditional chains.
"""

from __future__ import annotations

from laureate import fixed


def _text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _rows(rows) -> str:
    return ", ".join(
        "(" + ", ".join(_text(v) if v is None or isinstance(v, str) else str(v) for v in r) + ")"
        for r in rows
    )


def _round(expr: str, places: int) -> str:
    """Round the decimal text of a double, half away from zero, as Spark does."""
    return (
        f"CAST(round(CAST(CAST(({expr}) AS VARCHAR) AS DECIMAL(38, 15)), {places}) AS DOUBLE)"
    )


def _mean(expr: str, places: int) -> str:
    """Values added up as decimals, so the order of rows does not matter."""
    return _round(f"avg(CAST({expr} AS DECIMAL(24, 6)))", places)


def _share(condition: str, places: int) -> str:
    return _round(
        f"CAST(count(*) FILTER (WHERE {condition}) AS DOUBLE) / count(*) * 100", places
    )


def _ranges(buckets, below, missing=None) -> str:
    """(low, high, label, position from the highest) with open ends."""
    bounds = [b for b, _ in buckets]
    names = [n for _, n in buckets] + [below]
    lows = bounds + ["-1e18"]
    highs = ["1e18"] + bounds
    return _rows_raw(
        (lo, hi, _text(n), i) for i, (lo, hi, n) in enumerate(zip(lows, highs, names), 1)
    )


def _rows_raw(rows) -> str:
    return ", ".join("(" + ", ".join(str(v) for v in r) + ")" for r in rows)


TITLES = """
dated AS (
    SELECT *, CAST(1991 + 5 * (year(o_orderdate) - 1995) + o_custkey % 5 AS INTEGER) AS year
    FROM orders, customer, nation, region
    WHERE o_custkey = c_custkey AND c_nationkey = n_nationkey AND n_regionkey = r_regionkey
),
placed AS (
    SELECT *, CASE WHEN year = 2024 AND o_orderkey % 150 <> 0 THEN 2023 ELSE year END
        AS release_year,
        CAST([NULL, floor(o_totalprice * 100), floor(o_totalprice * 10), floor(o_totalprice),
            floor(o_totalprice / 10), floor(o_totalprice / 100)][o_orderkey % 6 + 1] AS BIGINT)
        AS owners_midpoint,
        CASE WHEN o_orderkey % 29 <> 0 THEN (o_custkey % 4) * 2500 END AS reviews_total
    FROM dated
),
titles AS (
    SELECT
        CAST(o_orderkey AS VARCHAR) AS game_key,
        CASE o_orderstatus WHEN 'F' THEN 'steam' ELSE 'metacritic' END AS source,
        [c_name, upper(c_name), replace(c_name, '#', '-'), '  ' || c_name || ' '][o_orderkey % 4 + 1]
            AS name_raw,
        release_year,
        CASE WHEN o_orderkey % 23 <> 0
            THEN CAST(least(50 + floor(o_totalprice / 10000), 95) AS INTEGER) END AS critic_score,
        CASE WHEN c_acctbal < 0 THEN NULL
            WHEN c_custkey % 3 = 0 THEN floor(c_acctbal / 1000) * 10
            ELSE least(c_acctbal / 100, 90) END AS user_score,
        CASE WHEN release_year >= 2003 THEN CAST(o_custkey % 130 AS DOUBLE) END
            AS avg_playtime_hrs,
        CASE WHEN release_year >= 2003 THEN CAST(o_custkey % 130 * 45 AS DOUBLE) END
            AS median_playtime_mins,
        owners_midpoint, owners_midpoint // 2 AS owners_range_low,
        owners_midpoint * 2 AS owners_range_high, reviews_total,
        CAST(o_orderkey % 101 AS DOUBLE) AS review_ratio_pct,
        reviews_total * (o_orderkey % 101) // 100 AS reviews_positive,
        reviews_total - reviews_total * (o_orderkey % 101) // 100 AS reviews_negative,
        CASE WHEN o_orderkey % 2 = 0 THEN reviews_total * 2 END AS recommendations,
        CASE WHEN release_year >= 2003 THEN o_orderkey % 5000 END AS peak_ccu,
        CAST(floor(o_totalprice / 100) / 100 AS DECIMAL(10, 2)) AS price_usd,
        release_year >= 2003 AS has_playtime_data,
        CASE o_orderkey % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'fuzzy' END AS score_match_tier,
        ['Action RPG', 'FPS', 'Casual', ' ', 'Strategy', 'Massively Multiplayer',
            'First-Person Shooter', 'RPG', NULL][o_orderkey % 9 + 1] AS primary_genre,
        CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN ',' || n_name
            ELSE c_mktsegment || ',' || n_name END AS genres_raw,
        CASE WHEN c_custkey % 7 = 0 THEN '' ELSE n_name END AS developer,
        CASE c_custkey % 11 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE r_name END AS publisher
    FROM placed
)"""

SEED = """
curated AS (
    SELECT
        c_custkey, '  ' || upper(c_name) || ' ' AS game_name,
        CAST(1990 + 5 * ((c_custkey // 5) % 7) + c_custkey % 5 + c_custkey % 3 AS INTEGER)
            AS seed_year,
        c_mktsegment AS developer_clean,
        CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 5 < 4 THEN r_name END AS genre_clean,
        CASE WHEN c_custkey % 13 <> 0 THEN c_custkey % 10 = 0 END AS is_vr
    FROM customer, nation, region
    WHERE c_nationkey = n_nationkey AND n_regionkey = r_regionkey
),
seed AS (
    SELECT * FROM curated
    UNION ALL SELECT c_custkey, game_name, seed_year + 1, 'Studio', 'RPG', true FROM curated
        WHERE c_custkey % 4 = 0
    UNION ALL SELECT c_custkey, game_name, seed_year, NULL, 'Puzzle', false FROM curated
        WHERE c_custkey % 8 = 0
)"""

FLAGS = """
flags AS (
    SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS app_id FROM lineitem WHERE l_quantity >= 49
)"""

ERAS = f"""
eras(first_year, last_year, era_label, era_sort_order) AS (
    VALUES {_rows((*e, i) for i, e in enumerate(fixed.ERAS, 1))}
)"""

GATED = f"""{TITLES},
gated AS (
    SELECT * FROM titles WHERE critic_score >= 75 AND release_year BETWEEN 1993 AND 2024
)"""

# Joined first, then one row per name and year.
ENRICHED = f"""{GATED}, {SEED}, {FLAGS}, {ERAS},
winners AS (
    SELECT
        g.*, s.developer_clean, s.genre_clean, s.is_vr AS seed_vr,
        f.app_id IS NOT NULL AS flagged
    FROM gated g
    LEFT JOIN seed s
        ON lower(trim(s.game_name)) = lower(trim(g.name_raw))
        AND g.release_year - s.seed_year BETWEEN -1 AND 1
    LEFT JOIN flags f ON f.app_id = g.game_key
    QUALIFY row_number() OVER (
        PARTITION BY regexp_replace(lower(trim(name_raw)), '[^a-z0-9 ]', '', 'g'), release_year
        ORDER BY source = 'steam' DESC, critic_score DESC, game_key,
            abs(release_year - seed_year) NULLS LAST, seed_year, developer_clean NULLS FIRST,
            genre_clean NULLS FIRST, s.is_vr NULLS FIRST
    ) = 1
),
enriched AS (
    SELECT
        w.game_key, w.source, w.name_raw AS game_name, w.release_year, w.critic_score,
        w.user_score, w.avg_playtime_hrs, w.median_playtime_mins, w.owners_midpoint,
        w.owners_range_low, w.owners_range_high, w.reviews_total, w.review_ratio_pct,
        w.reviews_positive, w.reviews_negative, w.recommendations, w.peak_ccu, w.price_usd,
        w.has_playtime_data, w.score_match_tier,
        CASE
            WHEN trim(coalesce(developer_clean, '')) <> '' THEN trim(developer_clean)
            WHEN trim(coalesce(developer, '')) <> '' THEN trim(developer)
            ELSE 'Unknown'
        END AS developer,
        CASE WHEN trim(coalesce(publisher, '')) <> '' THEN trim(publisher) ELSE 'Unknown' END
            AS publisher,
        CASE
            WHEN trim(coalesce(genre_clean, '')) <> '' THEN trim(genre_clean)
            WHEN trim(coalesce(primary_genre, '')) <> '' THEN trim(primary_genre)
            WHEN trim(split_part(coalesce(genres_raw, ''), ',', 1)) <> ''
                THEN trim(split_part(genres_raw, ',', 1))
            ELSE 'Unknown'
        END AS genre,
        coalesce(genres_raw, genre_clean, 'Unknown') AS genres_raw,
        flagged OR coalesce(seed_vr, false) AS is_vr,
        coalesce(era_label, 'Unknown') AS era_label,
        coalesce(era_sort_order, 10) AS era_sort_order
    FROM winners w LEFT JOIN eras ON release_year BETWEEN first_year AND last_year
),
genre_map(raw_genre, target) AS (
    VALUES {_rows([*fixed.GENRE_RENAMES.items(), *[(g, None) for g in fixed.GENRES_DROPPED]])}
)"""

GAMES = f"""{ENRICHED},
games AS (
    SELECT
        e.* REPLACE (CASE WHEN m.raw_genre IS NULL THEN e.genre ELSE m.target END AS genre)
    FROM enriched e LEFT JOIN genre_map m ON m.raw_genre = e.genre
)"""

YEARS = f"""{TITLES},
years AS (
    SELECT
        release_year,
        count(*) AS total_games,
        count(critic_score) AS scored_games,
        {_mean("critic_score", 2)} AS avg_critic_score,
        {_share("critic_score >= 90", 2)} AS pct_above_90,
        {_share("critic_score >= 80", 2)} AS pct_above_80,
        {_share("critic_score >= 70", 2)} AS pct_above_70,
        max(critic_score) AS peak_score,
        count(DISTINCT primary_genre) AS distinct_genres,
        {_mean("avg_playtime_hrs", 2)} AS avg_playtime_hrs,
        count(avg_playtime_hrs) AS games_with_playtime,
        {_mean("user_score", 2)} AS avg_user_score,
        count(user_score) AS games_with_user_score,
        {_mean("review_ratio_pct", 2)} AS avg_review_ratio,
        {_mean("owners_midpoint", 0)} AS avg_owners_midpoint
    FROM titles
    WHERE release_year BETWEEN 1993 AND 2024
    GROUP BY release_year
)"""


def _scale(source: str, expr: str, name: str) -> str:
    low = f"(SELECT min({expr}) FROM {source})"
    high = f"(SELECT max({expr}) FROM {source})"
    value = f"CAST(({expr}) - {low} AS DOUBLE) / ({high} - {low}) * 100"
    return f"CASE WHEN {high} > {low} THEN {_round(value, 2)} END AS {name}"


INDEXED = f"""{YEARS},
kept_years AS (SELECT * FROM years WHERE scored_games >= 5),
scaled AS (
    SELECT *,
        {_scale("kept_years", "pct_above_80", "p1_quality_rate")},
        {_scale("kept_years", "avg_critic_score", "p2_avg_score")},
        {_scale("kept_years", "distinct_genres", "p3_genre_diversity")},
        {_scale("kept_years", "ln(scored_games + 1)", "p4_volume")},
        {_scale("kept_years", "coalesce(avg_playtime_hrs, 0)", "p5_longevity")}
    FROM kept_years
),
indexed AS (
    SELECT *, {_round(" + ".join(f"{p} * {w}::DOUBLE" for p, w in fixed.PILLAR_WEIGHTS.items()), 2)}
        AS golden_era_index
    FROM scaled
)"""

INDEX_REPORT = f"""{INDEXED},
index_eras(first_year, last_year, era_label) AS (VALUES {_rows(fixed.INDEX_ERAS)}),
index_report AS (
    SELECT
        release_year, coalesce(era_label, 'Unknown') AS era_label,
        CASE WHEN release_year >= 2003 THEN 'Steam + Metacritic'
            ELSE 'Metacritic-only (pre-Steam)' END AS coverage_tier,
        total_games, scored_games, avg_critic_score, avg_user_score, pct_above_90,
        pct_above_80, pct_above_70, peak_score, distinct_genres, avg_playtime_hrs,
        avg_owners_midpoint, avg_review_ratio, p1_quality_rate, p2_avg_score,
        p3_genre_diversity, p4_volume, p5_longevity, golden_era_index,
        {_round("avg(golden_era_index) OVER near", 2)} AS golden_era_index_3yr_avg,
        dense_rank() OVER (ORDER BY golden_era_index DESC) AS era_index_rank,
        {_round("avg_critic_score - lag(avg_critic_score) OVER by_year", 2)} AS yoy_score_delta,
        scored_games - lag(scored_games) OVER by_year AS yoy_volume_delta,
        {_round("avg_user_score - avg_critic_score", 2)} AS nostalgia_delta
    FROM indexed LEFT JOIN index_eras ON release_year BETWEEN first_year AND last_year
    WINDOW by_year AS (ORDER BY release_year),
        near AS (ORDER BY release_year ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)
)"""


def _genre_years(source: str, genre: str) -> str:
    return f"""
genre_years AS (
    SELECT
        {genre}, release_year,
        count(*) AS game_count,
        {_mean("critic_score", 2)} AS avg_critic_score,
        {_mean("user_score", 2)} AS avg_user_score,
        max(critic_score) AS peak_score,
        {_share("critic_score >= 90", 1)} AS pct_above_90,
        {_share("critic_score >= 80", 1)} AS pct_above_80,
        {_mean("avg_playtime_hrs", 2)} AS avg_playtime_hrs,
        {_mean("owners_midpoint", 0)} AS avg_owners_midpoint,
        {_mean("coalesce(user_score, 0) - critic_score", 2)} AS avg_nostalgia_delta,
        (SELECT era_label FROM eras WHERE release_year BETWEEN first_year AND last_year)
            AS era_label
    FROM {source}
    WHERE {genre} IS NOT NULL
    GROUP BY {genre}, release_year
    HAVING count(*) >= 3
)"""


_QUALITY = _round(
    "pct_above_80 * 0.6::DOUBLE + least(game_count, 20) / 20.0::DOUBLE * 100 * 0.4::DOUBLE", 2
)

GENRE_YEARS = f"""{GAMES}, {_genre_years("games", "genre")},
quality AS (SELECT *, {_QUALITY} AS genre_quality_index FROM genre_years),
peaks AS (
    SELECT genre, release_year AS peak_year, genre_quality_index AS peak_index,
        avg_critic_score AS peak_avg_score
    FROM quality
    QUALIFY row_number() OVER (
        PARTITION BY genre ORDER BY genre_quality_index DESC, release_year) = 1
)"""

TOP = """
best AS (
    SELECT genre, release_year, game_key, game_name, critic_score, user_score,
        CAST(row_number() OVER (
            PARTITION BY genre, release_year
            ORDER BY critic_score DESC, coalesce(user_score, 0) DESC, game_name, game_key
        ) AS INTEGER) AS place
    FROM games WHERE genre IS NOT NULL
    QUALIFY place <= 3
),
top3 AS (
    SELECT genre, release_year,
        string_agg(game_name || ' (' || CAST(critic_score AS VARCHAR) || ')', ' · '
            ORDER BY place) AS top3_games
    FROM best GROUP BY genre, release_year
)"""

ERA_STATS = f"""
era_stats AS (
    SELECT
        era_label, era_sort_order,
        count(*) AS era_qualified_games,
        {_mean("critic_score", 1)} AS era_avg_score,
        max(critic_score) AS era_peak_score,
        count(DISTINCT genre) AS era_distinct_genres,
        min(release_year) AS era_start_year,
        max(release_year) AS era_end_year,
        count(*) FILTER (WHERE is_vr) AS era_vr_games
    FROM games WHERE genre IS NOT NULL GROUP BY era_label, era_sort_order
)"""

_MERIT = "critic_score DESC, coalesce(user_score, 0) DESC, coalesce(reviews_total, 0) DESC"

RANKS = f"""
era_ranks AS (
    SELECT game_key, dense_rank() OVER (PARTITION BY era_label ORDER BY {_MERIT}) AS era_rank
    FROM games
),
genre_ranks AS (
    SELECT game_key, genre_era_count,
        dense_rank() OVER (PARTITION BY era_label, genre ORDER BY {_MERIT}) AS genre_era_rank
    FROM games
    JOIN (SELECT era_label, genre, count(*) AS genre_era_count FROM games
          WHERE critic_score >= 80 GROUP BY ALL) USING (era_label, genre)
    WHERE critic_score >= 80 AND genre_era_count >= 3
),
vr_ranks AS (
    SELECT game_key, dense_rank() OVER (
        PARTITION BY era_label ORDER BY critic_score DESC, coalesce(user_score, 0) DESC
    ) AS vr_era_rank
    FROM games WHERE is_vr AND critic_score >= 80
)"""

CHAMPIONS = f"""{GAMES}, {ERA_STATS}, {RANKS},
champions AS (
    SELECT
        game_key, source, game_name, release_year, era_label, games.era_sort_order, genre,
        genres_raw, developer, publisher, is_vr, critic_score, user_score,
        {_round("coalesce(user_score, 0) - critic_score", 2)} AS nostalgia_delta,
        era_rank, era_rank = 1 AS is_era_champion,
        genre_era_rank, genre_era_count,
        coalesce(genre_era_rank, 0) = 1 AS is_genre_era_champion,
        vr_era_rank, coalesce(vr_era_rank, 0) = 1 AS is_vr_era_champion,
        era_qualified_games, era_avg_score, era_peak_score, era_distinct_genres,
        era_start_year, era_end_year, era_vr_games, avg_playtime_hrs, owners_midpoint,
        reviews_total, review_ratio_pct, peak_ccu, has_playtime_data, score_match_tier
    FROM games
    LEFT JOIN era_ranks USING (game_key)
    LEFT JOIN genre_ranks USING (game_key)
    LEFT JOIN vr_ranks USING (game_key)
    LEFT JOIN era_stats USING (era_label)
)"""

BUCKETS = f"""
ages(lo, hi, age_bucket, age_bucket_sort) AS (
    VALUES {_ranges(fixed.AGE_BUCKETS, fixed.AGE_BELOW)}
),
gaps(lo, hi, nostalgia_label, pos) AS (
    VALUES {_ranges(fixed.DELTA_BUCKETS, fixed.DELTA_BELOW)}
),
hours(lo, hi, longevity_tier, pos) AS (
    VALUES {_ranges(fixed.LONGEVITY_BUCKETS, fixed.LONGEVITY_BELOW)}
),
reach(lo, hi, ownership_tier, pos) AS (
    VALUES {_ranges(fixed.OWNERSHIP_BUCKETS, fixed.OWNERSHIP_BELOW)}
)"""


def _labelled(source: str) -> str:
    return f"""{BUCKETS},
labelled AS (
    SELECT
        t.*,
        {_round("user_score - critic_score", 2)} AS nostalgia_delta,
        coalesce(nostalgia_label, 'No user score') AS nostalgia_label,
        2024 - release_year AS game_age_years, age_bucket, age_bucket_sort,
        coalesce(longevity_tier, 'Legacy (pre-Steam, no data)') AS longevity_tier,
        CAST(coalesce(6 - h.pos, 0) AS INTEGER) AS longevity_tier_sort,
        coalesce(ownership_tier, 'Unknown') AS ownership_tier
    FROM {source} t
    LEFT JOIN ages a ON 2024 - release_year >= a.lo AND 2024 - release_year < a.hi
    LEFT JOIN gaps g ON user_score - critic_score >= g.lo AND user_score - critic_score < g.hi
    LEFT JOIN hours h ON avg_playtime_hrs >= h.lo AND avg_playtime_hrs < h.hi
    LEFT JOIN reach r ON owners_midpoint >= r.lo AND owners_midpoint < r.hi
)"""


ITEMS = f"""{GAMES}, {_labelled("games")},
items AS (
    SELECT
        game_key, source, game_name, release_year, era_label, genre, developer, publisher,
        is_vr, critic_score, user_score, nostalgia_delta, nostalgia_label, game_age_years,
        age_bucket, age_bucket_sort, avg_playtime_hrs, median_playtime_mins, peak_ccu,
        longevity_tier, longevity_tier_sort, has_playtime_data, owners_midpoint, owners_range_low,
        owners_range_high, ownership_tier, reviews_positive, reviews_negative, reviews_total,
        review_ratio_pct, recommendations, price_usd, score_match_tier
    FROM labelled
)"""

MATRIX = f"""{GAMES},
matrix AS (
    SELECT genre, era_label, era_sort_order, count(*) AS game_count,
        {_mean("critic_score", 2)} AS avg_critic_score,
        {_share("critic_score >= 80", 1)} AS pct_above_80
    FROM games WHERE genre IS NOT NULL
    GROUP BY genre, era_label, era_sort_order HAVING count(*) >= 3
)"""


def _bucket_query(columns: str) -> str:
    return f"WITH {GATED}, {_labelled('gated')} SELECT {columns} FROM labelled"


def _gap_by(column: str) -> str:
    return f"""WITH {ITEMS}
SELECT {column}, {_mean("nostalgia_delta", 2)} AS avg_nostalgia_delta,
    count(nostalgia_delta) AS compared_games
FROM items GROUP BY {column}"""


def _survivorship(column: str) -> str:
    return f"""WITH {ITEMS}
SELECT {column}, count(*) AS game_count,
    {_mean("critic_score", 2)} AS avg_critic_score,
    {_mean("owners_midpoint", 0)} AS avg_owners_midpoint
FROM items GROUP BY {column}"""


def _null_union() -> str:
    from laureate.schemas import ITEM_COLUMNS

    parts = [
        f"""SELECT '{c}' AS column_name, count(*) - count({c}) AS null_rows,
    {_round(f"(count(*) - count({c})) * 100.0::DOUBLE / count(*)", 2)} AS null_pct,
    count({c}) = 0 AS all_null FROM items"""
        for c in ITEM_COLUMNS
    ]
    return f"WITH {ITEMS}\n" + "\nUNION ALL\n".join(parts)


def _shared_keys(sql: str) -> str:
    whole = "CAST(o_orderkey AS VARCHAR) AS game_key"
    assert whole in sql
    return sql.replace(whole, "CAST(o_orderkey // 2 AS VARCHAR) AS game_key")


# Years of overlapping eras go to the first in order.
OTHER_ERAS = """
era_years AS (SELECT release_year, count(*) AS n FROM titles GROUP BY release_year),
era_table AS (
    SELECT DISTINCT release_year - release_year % 3 AS first_year,
        release_year - release_year % 3 + 1 AS last_year,
        'Years from ' || (release_year - release_year % 3) AS era_label,
        2100 - (release_year - release_year % 3) AS era_sort_order
    FROM era_years
    UNION ALL
    SELECT * FROM (SELECT release_year, release_year, 'Fullest year', 0 FROM era_years
        ORDER BY n DESC, release_year DESC LIMIT 1)
),
eras AS (
    SELECT y AS first_year, y AS last_year, arg_min(era_label, era_sort_order) AS era_label,
        CAST(min(era_sort_order) AS INTEGER) AS era_sort_order
    FROM era_table, (SELECT unnest(range(1980, 2040)) AS y)
    WHERE y BETWEEN era_table.first_year AND era_table.last_year GROUP BY y
)"""


def _other_eras(sql: str) -> str:
    assert ERAS in sql and "coalesce(era_sort_order, 10)" in sql
    past = "coalesce(era_sort_order, (SELECT max(era_sort_order) + 1 FROM era_table))"
    return sql.replace(ERAS, OTHER_ERAS).replace("coalesce(era_sort_order, 10)", past)


def _placed(report: str, columns: str, order: str) -> str:
    return f"""WITH {report[0]}
SELECT row_number() OVER (ORDER BY {order}) AS place, {columns} FROM {report[1]}"""


_WEIGHTED_ZERO = " + ".join(
    f"coalesce({p}, 0) * {w}::DOUBLE" for p, w in fixed.PILLAR_WEIGHTS.items()
)
_WEIGHT_USED = " + ".join(
    f"(CASE WHEN {p} IS NULL THEN 0 ELSE {w}::DOUBLE END)"
    for p, w in fixed.PILLAR_WEIGHTS.items()
)

_BY_SCORE = "critic_score DESC, coalesce(user_score, 0) DESC, game_key"

# A record is short, long, misfit or good, in this order.
INGEST = f"""WITH {TITLES},
numbered AS (
    SELECT *, CAST(game_key AS BIGINT) AS n,
        n % 11 = 0 AS short, n % 13 = 0 AS long, n % 17 = 0 AS misfit,
        CASE n % 5 WHEN 0 THEN name_raw || ', Jr.' WHEN 1 THEN 'The "' || name_raw || '"'
            ELSE name_raw END AS full_name
    FROM titles
)
SELECT NOT (short OR long OR misfit) AS accepted,
    CASE WHEN accepted THEN game_key END AS game_key, CASE WHEN accepted THEN source END AS source,
    CASE WHEN accepted THEN full_name END AS name_raw,
    CASE WHEN accepted THEN release_year END AS release_year,
    CASE WHEN accepted THEN critic_score END AS critic_score,
    CASE WHEN accepted THEN user_score END AS user_score,
    CASE WHEN accepted THEN publisher END AS publisher,
    CASE WHEN short THEN concat_ws(',', game_key, source, trim(name_raw))
        WHEN long OR misfit THEN concat_ws(',', game_key, source,
            CASE WHEN n % 5 < 2 THEN '"' || replace(full_name, '"', '""') || '"'
                ELSE full_name END,
            CAST(release_year AS VARCHAR),
            CASE WHEN misfit THEN 'n/a' ELSE coalesce(CAST(critic_score AS VARCHAR), '') END,
            coalesce(CAST(user_score AS VARCHAR), ''),
            CASE WHEN long THEN 'Ltd,extra' ELSE coalesce(publisher, '') END)
        END AS refused
FROM numbered"""

ORACLE: dict[str, str] = {
    "q_agg_null_groups": f"""WITH {GAMES},
eligible AS (SELECT game_key, era_label, genre FROM games WHERE critic_score >= 80),
sizes AS (SELECT era_label, genre, count(*) AS joined_rows FROM eligible GROUP BY ALL)
SELECT game_key, e.era_label, e.genre,
    count(*) OVER (PARTITION BY e.era_label, e.genre) AS group_rows, joined_rows
FROM eligible e LEFT JOIN sizes s ON s.era_label = e.era_label AND s.genre = e.genre""",
    "q_ingest_csv": INGEST,
    "q_merge_sources": f"""WITH {TITLES},
named AS (
    SELECT * REPLACE (CASE WHEN reviews_total % 1000 = 0
        THEN replace(lower(name_raw), 'customer', 'Покупатель') ELSE name_raw END AS name_raw)
    FROM titles
)
SELECT game_key, source, name_raw, release_year, critic_score FROM named
WHERE critic_score BETWEEN 0 AND 100 AND release_year BETWEEN 1993 AND 2024
QUALIFY row_number() OVER (
    PARTITION BY regexp_replace(lower(trim(name_raw)), '[^\\p{{L}}\\p{{M}}\\p{{N}} ]', '', 'g'),
        release_year
    ORDER BY source = 'steam' DESC, critic_score DESC, game_key, name_raw) = 1""",
    "q_replace_reload": f"""WITH {TITLES}
SELECT game_key, source, critic_score, release_year, price_usd FROM titles
WHERE source = 'metacritic' OR critic_score >= 75 AND release_year BETWEEN 1993 AND 2024""",
    "q_reload_inputs": f"""WITH {ENRICHED}
SELECT game_key, developer, publisher, genre, genres_raw, is_vr FROM enriched""",
    "q_key_audit": f"""WITH {_shared_keys(TITLES)}
SELECT game_key, count(*) AS n_rows FROM titles GROUP BY game_key HAVING count(*) > 1""",
    "q_join_repeated_keys": f"""WITH {_shared_keys(CHAMPIONS)}
SELECT game_key, game_name, release_year, era_rank, genre_era_rank, genre_era_count, vr_era_rank
FROM champions""",
    "q_order_index": _placed(
        (INDEX_REPORT, "index_report"), "release_year, golden_era_index", "release_year"
    ),
    "q_order_champions": _placed(
        (CHAMPIONS, "champions"), "game_key, era_sort_order, critic_score, user_score",
        f"era_sort_order, {_BY_SCORE}",
    ),
    "q_order_genre": _placed(
        (GENRE_YEARS, "quality"), "genre, release_year", "genre, release_year"
    ),
    "q_order_items": _placed(
        (ITEMS, "items"), "game_key, critic_score, user_score", _BY_SCORE
    ),
    "q_report_champions_eras": f"WITH {_other_eras(CHAMPIONS)} SELECT * FROM champions",
    "q_report_index_eras": f"""WITH {INDEXED}, {OTHER_ERAS}
SELECT release_year, coalesce(era_label, 'Unknown') AS era_label, total_games, golden_era_index
FROM indexed LEFT JOIN eras ON release_year BETWEEN first_year AND last_year""",
    "q_view_champions_genre": f"""WITH {CHAMPIONS}
SELECT game_key, genre, genre_era_rank FROM champions WHERE genre = 'RPG'""",
    "q_view_champions_vr": f"""WITH {CHAMPIONS}
SELECT game_key, is_vr, vr_era_rank FROM champions WHERE is_vr""",
    "q_agg_year_profile": f"WITH {YEARS} SELECT * FROM years",
    "q_agg_distinct": f"""WITH {TITLES}
SELECT release_year, count(DISTINCT primary_genre) AS distinct_genres
FROM titles GROUP BY release_year""",
    "q_agg_era_stats": f"WITH {GAMES}, {ERA_STATS} SELECT * FROM era_stats",
    "q_agg_genre_year": (
        f"WITH {GATED}, {ERAS}, {_genre_years('gated', 'genres_raw')} SELECT * FROM genre_years"
    ),
    "q_join_tolerance": f"""WITH {GATED}, {SEED}
SELECT game_key, name_raw, release_year, seed_year, developer_clean, genre_clean, is_vr
FROM gated LEFT JOIN seed
    ON lower(trim(name_raw)) = lower(trim(game_name)) AND abs(release_year - seed_year) <= 1""",
    "q_join_flag": f"""WITH {GATED}, {FLAGS}
SELECT game_key, game_key IN (SELECT app_id FROM flags) AS is_flagged FROM gated""",
    "q_join_inner_group_gate": f"""WITH {GATED}, {ERAS},
eligible AS (
    SELECT game_key, era_label, genres_raw
    FROM gated JOIN eras ON release_year BETWEEN first_year AND last_year
    WHERE critic_score >= 80
)
SELECT * FROM eligible JOIN (
    SELECT era_label, genres_raw, count(*) AS genre_era_count FROM eligible
    GROUP BY ALL HAVING count(*) >= 3) USING (era_label, genres_raw)""",
    "q_join_rank_back": f"""WITH {GAMES}, {RANKS}
SELECT game_key, era_label, genre, genre_era_rank
FROM games LEFT JOIN genre_ranks USING (game_key)""",
    "q_join_group_stats": f"""WITH {GAMES}, {ERA_STATS}
SELECT game_key, era_label, genre, era_stats.* EXCLUDE (era_label, era_sort_order)
FROM games LEFT JOIN era_stats USING (era_label)""",
    "q_peak_join": f"""WITH {GENRE_YEARS}, {TOP}
SELECT genre, release_year, genre_quality_index, peak_year, peak_index, peak_avg_score,
    top3_games
FROM quality LEFT JOIN peaks USING (genre) LEFT JOIN top3 USING (genre, release_year)""",
    "q_distinct_peak": f"WITH {GENRE_YEARS} SELECT * FROM peaks",
    "q_win_dedup": f"""WITH {GATED}
SELECT regexp_replace(lower(trim(name_raw)), '[^a-z0-9 ]', '', 'g') AS name_key,
    release_year, game_key, source, critic_score
FROM gated
QUALIFY row_number() OVER (PARTITION BY name_key, release_year
    ORDER BY source = 'steam' DESC, critic_score DESC, game_key) = 1""",
    "q_win_topk": f"""WITH {GAMES}, {TOP}
SELECT genre, release_year, place, game_key, game_name, critic_score, user_score FROM best""",
    "q_win_rank_global": f"""WITH {INDEX_REPORT}
SELECT release_year, golden_era_index, era_index_rank FROM index_report""",
    "q_win_rank_era": f"""WITH {CHAMPIONS}
SELECT game_key, era_label, critic_score, user_score, reviews_total, era_rank,
    is_era_champion AS is_champion FROM champions""",
    "q_win_rank_group_gated": f"""WITH {CHAMPIONS}
SELECT game_key, era_label, genre, critic_score, genre_era_rank, genre_era_count,
    is_genre_era_champion AS is_champion FROM champions""",
    "q_win_rank_flagged": f"""WITH {CHAMPIONS}
SELECT game_key, era_label, is_vr, critic_score, vr_era_rank,
    is_vr_era_champion AS is_champion FROM champions""",
    "q_win_lag": f"""WITH {INDEX_REPORT}
SELECT release_year, avg_critic_score, scored_games, yoy_score_delta, yoy_volume_delta
FROM index_report""",
    "q_win_lag_partitioned": f"""WITH {GENRE_YEARS}
SELECT genre, release_year,
    {_round("avg_critic_score - lag(avg_critic_score) OVER along", 2)} AS yoy_score_delta,
    game_count - lag(game_count) OVER along AS yoy_volume_delta
FROM quality WINDOW along AS (PARTITION BY genre ORDER BY release_year)""",
    "q_win_first_value": f"""WITH {GENRE_YEARS}
SELECT DISTINCT genre,
    first_value(release_year) OVER high AS peak_year,
    first_value(genre_quality_index) OVER high AS peak_index,
    first_value(avg_critic_score) OVER high AS peak_avg_score
FROM quality
WINDOW high AS (PARTITION BY genre ORDER BY genre_quality_index DESC, release_year)""",
    "q_win_minmax": f"""WITH {INDEXED}
SELECT release_year, p1_quality_rate, p2_avg_score, p3_genre_diversity, p4_volume,
    p5_longevity FROM scaled""",
    "q_scale_rows": f"""WITH {TITLES}
SELECT game_key, {_scale("titles", "critic_score", "scaled_score")},
    {_scale("titles", "ln(reviews_total + 1)", "scaled_reviews")}
FROM titles""",
    "q_win_centred_mean": f"""WITH {INDEX_REPORT}
SELECT release_year, golden_era_index_3yr_avg FROM index_report""",
    "q_top3_string": f"WITH {GAMES}, {TOP} SELECT * FROM top3",
    "q_waterfall": f"""WITH {ENRICHED}
SELECT game_key, developer, publisher, genre, genres_raw, is_vr FROM enriched""",
    "q_map_values": f"""WITH {GAMES}
SELECT game_key, e.genre, g.genre AS mapped_genre
FROM enriched e JOIN games g USING (game_key)""",
    "q_era_label": f"""WITH {TITLES}, {ERAS}
SELECT game_key, release_year, coalesce(era_label, 'Unknown') AS era_label,
    CAST(coalesce(era_sort_order, 10) AS INTEGER) AS era_sort_order,
    CASE WHEN release_year >= 2003 THEN 'Steam + Metacritic'
        ELSE 'Metacritic-only (pre-Steam)' END AS coverage_tier
FROM titles LEFT JOIN eras ON release_year BETWEEN first_year AND last_year""",
    "q_composite_index": f"""WITH {INDEXED}
SELECT release_year, golden_era_index,
    {_round(_WEIGHTED_ZERO, 2)} AS index_null_as_zero,
    {_round(f"({_WEIGHTED_ZERO}) / nullif({_WEIGHT_USED}, 0)", 2)} AS index_renormalised
FROM indexed""",
    "q_quality_index": f"""WITH {GENRE_YEARS}
SELECT genre, release_year, game_count, pct_above_80, genre_quality_index FROM quality""",
    "q_bucket_age": _bucket_query("game_key, game_age_years, age_bucket, age_bucket_sort"),
    "q_bucket_delta": _bucket_query("game_key, nostalgia_delta, nostalgia_label"),
    "q_bucket_longevity": _bucket_query(
        "game_key, avg_playtime_hrs, longevity_tier, longevity_tier_sort"
    ),
    "q_bucket_reach": _bucket_query("game_key, owners_midpoint, ownership_tier"),
    "q_report_index": f"WITH {INDEX_REPORT} SELECT * FROM index_report",
    "q_report_champions": f"WITH {CHAMPIONS} SELECT * FROM champions",
    "q_report_genre": f"""WITH {GENRE_YEARS}, {TOP}
SELECT
    genre, release_year, era_label, game_count, avg_critic_score, avg_user_score, peak_score,
    pct_above_90, pct_above_80, avg_playtime_hrs, avg_owners_midpoint, avg_nostalgia_delta,
    genre_quality_index,
    {_round("avg_critic_score - lag(avg_critic_score) OVER along", 2)} AS yoy_score_delta,
    game_count - lag(game_count) OVER along AS yoy_volume_delta,
    peak_year, peak_index, peak_avg_score, release_year = peak_year AS is_peak_year, top3_games
FROM quality LEFT JOIN peaks USING (genre) LEFT JOIN top3 USING (genre, release_year)
WINDOW along AS (PARTITION BY genre ORDER BY release_year)""",
    "q_report_items": f"WITH {ITEMS} SELECT * FROM items",
    "q_view_champions": f"""WITH {CHAMPIONS}
SELECT game_key, game_name, era_label, genre, era_rank, is_era_champion,
    is_genre_era_champion, is_vr_era_champion
FROM champions
WHERE era_rank <= 5 OR is_era_champion OR is_genre_era_champion OR is_vr_era_champion""",
    "q_view_delta_by_era": _gap_by("era_label"),
    "q_view_delta_by_age": _gap_by("age_bucket"),
    "q_view_legends": f"""WITH {ITEMS}
SELECT game_key, game_name, release_year, developer, genre, critic_score, user_score
FROM items WHERE critic_score >= 80 ORDER BY critic_score DESC, coalesce(user_score, 0) DESC""",
    "q_view_era_rank": f"""WITH {INDEX_REPORT},
by_era AS (
    SELECT era_label, {_round("avg(CAST(golden_era_index AS DECIMAL(18, 2)))", 2)} AS avg_index, count(*) AS years
    FROM index_report GROUP BY era_label
)
SELECT *, 1 + (SELECT count(DISTINCT b.avg_index) FROM by_era b WHERE b.avg_index > a.avg_index)
    AS era_place
FROM by_era a""",
    "q_view_all_eras": f"""WITH {MATRIX}
SELECT genre, count(*) AS eras_present, CAST(sum(game_count) AS BIGINT) AS game_count
FROM matrix GROUP BY genre
HAVING count(*) = (SELECT count(DISTINCT era_label) FROM matrix)""",
    "q_view_outlier": f"""WITH {ITEMS}
SELECT game_key, game_name, critic_score, user_score, nostalgia_delta FROM items
ORDER BY abs(nostalgia_delta) DESC NULLS LAST, game_key LIMIT 1""",
    "q_view_spotlight": f"""WITH {GAMES}
SELECT genre, count(*) OVER () AS game_count, game_key, game_name, release_year, critic_score
FROM games WHERE genre = 'RPG'
QUALIFY row_number() OVER (ORDER BY {_MERIT}, game_key) = 1""",
    "q_view_survivorship": _survivorship("era_label"),
    "q_view_survivorship_age": _survivorship("age_bucket"),
    "q_view_matrix": f"WITH {MATRIX} SELECT *, {_QUALITY} AS quality_index FROM matrix",
    "q_view_matrix_wide": f"""WITH {MATRIX}
SELECT genre, """
    + ", ".join(
        f'max({_QUALITY}) FILTER (WHERE era_label = {_text(label)}) AS "{label}"'
        for _, _, label in fixed.ERAS
    )
    + " FROM matrix GROUP BY genre",
    "q_view_quality": f"""WITH {GAMES}
SELECT era_label, count(*) AS game_count,
    {_share("source = 'steam'", 2)} AS primary_source_pct,
    {_share("genre IS NULL", 2)} AS null_genre_pct,
    {_share("user_score IS NULL", 2)} AS null_user_score_pct,
    {_share("avg_playtime_hrs IS NULL", 2)} AS null_playtime_pct,
    {_share("owners_midpoint IS NULL", 2)} AS null_owners_pct
FROM games GROUP BY era_label""",
    "q_view_nulls": _null_union(),
}
