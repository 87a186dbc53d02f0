"""Row-local column expressions: cleaning of names, measures, dates and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The keyword lists of the severity classes, the first class that matches wins, and the topic filter.
RUPTURE_WORDS = ["rupture", "ruptured", "torn", "tear", "tore", "surgery", "surgical", "repair", "out for the season", "out for season", "remainder of the season", "missed remainder", "out indefinitely", "season-ending", "season ending"]
TENDON_WORDS = ["tendinopathy", "tendinitis", "tendinosis", "tendonitis", "tendon inflammation", "inflammation", "soreness", "tightness", "day-to-day", "dtd", "chronic", "discomfort", "irritation", "strain"]
TOPIC_WORDS = ["achilles", "calf", "heel"]
# The severity patterns of transaction notes, in order.
SEVERITY_PATTERNS = [("rupture", "ruptur|torn|compl[ei]te"), ("tear", "tear|partial"), ("tendinopathy", "strain|tendinit|tendinop|sore|inflam")]
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"


def number(c: Column, default: float | None = 0.0) -> Column:
    """A numeric string as double, the default if it isn't one (or is not a number)."""
    value = F.trim(c).try_cast("double")
    value = F.when(~F.isnan(value), value)
    return value if default is None else F.coalesce(value, F.lit(default))


def minutes(c: Column) -> Column:
    """'35:42' and '35.7' as minutes; words such as DNP, blanks and nulls are 0."""
    parts = F.split(F.trim(c), ":")
    clock = F.get(parts, F.lit(0)).try_cast("double") + F.get(parts, F.lit(1)).try_cast("double") / 60
    return F.when(F.contains(c, F.lit(":")), F.coalesce(clock, F.lit(0.0))).otherwise(number(c))


def height_inches(c: Column, default: float = 78.0) -> Column:
    feet, inches = (F.regexp_extract(c, r"^\s*(\d+)-(\d+)\s*$", k).try_cast("double") for k in (1, 2))
    return F.coalesce(feet * 12 + inches, F.lit(default))


def weight_lbs(c: Column, default: float = 220.0) -> Column:
    return number(F.replace(F.lower(c), F.lit("lbs"), F.lit("")), default)


def position_code(c: Column) -> Column:
    """guard 0, center 2, anything else or nothing 1."""
    p = F.lower(F.trim(c))
    return F.when(F.startswith(p, F.lit("center")), 2).when(F.startswith(p, F.lit("guard")), 0).otherwise(1)


def season_year(day: Column) -> Column:
    """The year a season ends in: it begins in October."""
    return F.year(day) + F.when(F.month(day) >= 10, 1).otherwise(0)


def season_label(year: Column) -> Column:
    """2024 as 2023-24."""
    return F.concat_ws("-", (year - 1).cast("string"), F.lpad((year % 100).cast("string"), 2, "0"))


def clean_name(c: Column) -> Column:
    """Without a leading bullet and a trailing parenthesis; of alternatives divided by slashes the shortest, the first of equals."""
    bare = F.trim(F.ltrim(c, F.lit("•")))
    cut = lambda x: F.trim(F.regexp_replace(x, r"\s*\([^)]*\)\s*$", ""))
    parts = F.transform(F.split(bare, "/"), lambda x, i: F.struct(F.length(cut(x)).alias("n"), i.alias("i"), cut(x).alias("name")))
    return F.when(F.contains(bare, F.lit("/")), F.array_min(parts)["name"]).otherwise(cut(bare))


def severity_by_pattern(c: Column) -> Column:
    text = F.lower(F.coalesce(c, F.lit("")))
    return reduce(lambda out, x: F.when(F.rlike(text, F.lit(x[1])), x[0]).otherwise(out), reversed(SEVERITY_PATTERNS), F.lit("unspecified"))


def any_keyword(c: Column, words: list[str]) -> Column:
    text = F.lower(F.coalesce(c, F.lit("")))
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def severity_by_keyword(c: Column) -> Column:
    return F.when(any_keyword(c, RUPTURE_WORDS), "rupture").when(any_keyword(c, TENDON_WORDS), "tendinopathy").otherwise("unspecified")


def on_topic(c: Column) -> Column:
    return any_keyword(c, TOPIC_WORDS)


def first_date(c: Column) -> Column:
    """The first 'Month D, YYYY' in a text as a date; null if there is none or it is no day."""
    found = F.regexp_extract(c, rf"(?U)(({MONTHS})\s+\d{{1,2}},\s+\d{{4}})", 1)
    return F.try_to_timestamp(F.regexp_replace(found, r"(?U)\s+", " "), F.lit("MMMM d, yyyy")).cast("date")


def age_years(birth: Column, day: Column, digits: int | None = None) -> Column:
    age = F.datediff(day, birth) / 365.25
    return age if digits is None else F.round(age, digits)


def bmi(lbs: Column, inches: Column) -> Column:
    return F.when(inches != 0, lbs * 703 / (inches * inches))


def years_in_league(season: Column, draft_year: Column) -> Column:
    return F.when(draft_year > 0, season - draft_year)


def days_into_season(day: Column) -> Column:
    start = F.make_date(season_year(day) - 1, F.lit(10), F.lit(1))
    return F.greatest(F.datediff(day, start), F.lit(0))


def time_bin(days: Column, bins: int = 60, horizon: int = 1825) -> Column:
    """Equal bins, closed on the left, of days clipped to 0 .. horizon; the last one holds the right edge."""
    clipped = F.least(F.greatest(days, F.lit(0)), F.lit(horizon)).cast("double")
    return F.least(F.width_bucket(clipped, F.lit(0.0), F.lit(float(horizon)), F.lit(bins)) - 1, F.lit(bins - 1)).cast("int")


def slug(url: Column) -> Column:
    """The entity's key in its page address."""
    return F.regexp_extract(url, r"/([^/]+?)(?:\.html)?/?$", 1)


def season_url(base: str, key: Column, season: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/players/"), F.substring(key, 1, 1), F.lit("/"), key, F.lit("/gamelog/"), season.cast("string"))


def load_log(games: DataFrame, entity: str, day: str, played: str, shots: str, throws: str, points: str) -> DataFrame:
    """Raw game rows as player_id, game_date, minutes_played, fga, fta, pts: bad dates and games of no minutes go."""
    rows = games.select(
        F.col(entity).alias("player_id"),
        F.try_to_timestamp(F.col(day).cast("string")).cast("date").alias("game_date"),
        minutes(F.col(played).cast("string")).alias("minutes_played"),
        *(number(F.col(c).cast("string")).alias(n) for c, n in ((shots, "fga"), (throws, "fta"), (points, "pts"))),
    )
    return rows.filter(F.col("game_date").isNotNull() & (F.col("minutes_played") > 0))
