"""Labels, ranges, weights and gates that decide the results.

Everything here is data, not logic. The functions elsewhere take these as
defaults and accept other values.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: eras, as (first year, last year, label) in display order ---
ERAS = (
    (1993, 1995, "Birth of 3D"),
    (1996, 1999, "Golden Age"),
    (2000, 2002, "Pre-Steam Peak"),
    (2003, 2006, "Steam Launch Era"),
    (2007, 2011, "Console Dominance Era"),
    (2012, 2014, "Indie Explosion"),
    (2015, 2018, "AAA Renaissance"),
    (2019, 2021, "Pandemic Boom"),
    (2022, 2024, "Post-Boom Correction"),
)
NO_ERA = "Unknown"

# The yearly index report words two of the labels differently.
INDEX_ERAS = (
    (1993, 1995, "Birth of 3D (Doom Era)"),
    (1996, 1999, "Golden Age Candidates"),
) + ERAS[2:]

# --- fixed values: source coverage, split at this year ---
COVERAGE_SPLIT_YEAR = 2003
COVERAGE_BEFORE = "Metacritic-only (pre-Steam)"
COVERAGE_FROM = "Steam + Metacritic"

# --- fixed values: categories ---
PRIMARY_SOURCE = "steam"
UNKNOWN = "Unknown"
GENRE_RENAMES = {
    "Massively Multiplayer": "MMO",
    "Action RPG": "RPG",
    "First-Person Shooter": "Action",
    "FPS": "Action",
}
GENRES_DROPPED = (
    "Casual",
    "Sexual Content",
    "Card Game",
    "Free To Play",
    "Survival",
    "Visual Novel",
    "Unknown",
)
GENRES = (
    "Action", "RPG", "Strategy", "Adventure", "Simulation", "Indie", "Sports",
    "Racing", "Open World", "MMO", "Puzzle", "Fighting", "Horror", "Stealth",
)

# --- fixed values: pillar weights of the yearly index ---
PILLAR_WEIGHTS = {
    "p1_quality_rate": 0.30,
    "p2_avg_score": 0.25,
    "p3_genre_diversity": 0.20,
    "p4_volume": 0.15,
    "p5_longevity": 0.10,
}

# --- fixed values: category-year quality index ---
QUALITY_SHARE_WEIGHT = 0.60
QUALITY_VOLUME_WEIGHT = 0.40
QUALITY_VOLUME_CAP = 20

# --- fixed values: item labels, as (lower bound, label) from high to low ---
REFERENCE_YEAR = 2024
AGE_BUCKETS = (
    (20, "20+ years (Legend tier)"),
    (15, "15-19 years (Classic tier)"),
    (10, "10-14 years (Established)"),
    (5, "5-9 years (Recent)"),
)
AGE_BELOW = "Under 5 years (New)"
DELTA_BUCKETS = (
    (10, "Cult Classic (users love it)"),
    (3, "Slight user preference"),
    (-3, "Critics and users agree"),
    (-10, "Slight critic preference"),
)
DELTA_BELOW = "Critics loved it more"
DELTA_MISSING = "No user score"
LONGEVITY_BUCKETS = (
    (100, "Timeless (100h+ avg)"),
    (50, "Long-lasting (50-100h)"),
    (20, "Well-played (20-50h)"),
    (5, "Moderate play (5-20h)"),
)
LONGEVITY_BELOW = "Low engagement (<5h)"
LONGEVITY_MISSING = "Legacy (pre-Steam, no data)"
OWNERSHIP_BUCKETS = (
    (10_000_000, "Mega (10M+ owners)"),
    (1_000_000, "Major (1-10M owners)"),
    (100_000, "Significant (100K-1M)"),
    (10_000, "Niche (10K-100K)"),
)
OWNERSHIP_BELOW = "Micro (<10K)"
OWNERSHIP_MISSING = "Unknown"

# --- fixed values: text formats ---
NAME_KEY_STRIPPED = "[^a-z0-9 ]"
TOP_LABEL_SEPARATOR = " · "
FLAGGED_CATEGORY = "VR"


@dataclass(frozen=True)
class Gates:
    """Which rows and groups count."""

    first_year: int = 1993
    last_year: int = 2024
    min_score: int = 75
    champion_score: int = 80
    min_scored_per_year: int = 5
    min_per_genre_year: int = 3
    min_per_genre_era: int = 3


DEFAULT_GATES = Gates()
