"""Row-wise features: side randomisation, pair features, defaults, one-hot groups, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def swap_sides(df: DataFrame, pairs: list[tuple[str, str]], swap: Column) -> DataFrame:
    """Exchange the two columns of each pair where ``swap`` holds; ``swapped`` tells."""
    named = {a: F.when(swap, F.col(b)).otherwise(F.col(a)) for a, b in pairs} | {b: F.when(swap, F.col(a)).otherwise(F.col(b)) for a, b in pairs}
    return df.select(*[named[c].alias(c) if c in named else F.col(c) for c in df.columns], swap.alias("swapped"))


def pair_features(one: Column, two: Column, name: str, lower_is_better: bool = False) -> list[Column]:
    """Difference, ratio of the greater to the lesser, mean, and whether the first side has the advantage."""
    ahead = one < two if lower_is_better else one > two
    return [
        (one - two).alias(f"{name}_diff"),
        F.try_divide(F.greatest(one, two), F.least(one, two)).alias(f"{name}_ratio"),
        ((one + two) / 2).alias(f"{name}_avg"),
        ahead.cast("int").alias(f"{name}_advantage"),
    ]


#: What stands for an unknown part of a profile, and the least value that counts as known.
PROFILE = {"height": (180.0, 1.0), "age": (25.0, 0.0)}
UNRANKED = 999.0


def profile_defaults(height: Column, age: Column, rank: Column, points: Column) -> dict[str, Column]:
    """Unknown or impossible values replaced: 180 cm, 25 years, rank 999; points 0 if unranked, else 500."""
    known = lambda c, least: F.when(~F.isnan(c) & (c >= least) & (c < float("inf")), c)
    r = F.coalesce(F.when(rank > 0, known(rank, 0.0)), F.lit(UNRANKED))
    parts = {n: F.coalesce(known(c, PROFILE[n][1]), F.lit(PROFILE[n][0])) for n, c in (("height", height), ("age", age))}
    return parts | {"rank": r, "points": F.coalesce(known(points, 0.0), F.when(r >= UNRANKED, 0.0).otherwise(500.0))}


#: The default of last resort for a feature whose name holds a word; the first that fits.
NAME_DEFAULTS = (("points", 500.0), ("rank", 100.0), ("age", 25.0), ("height", 180.0), ("winrate", 0.5))


def feature_default(name: str) -> float:
    """The value of last resort for a feature, by its name."""
    plain = name.lower().replace("_", "")
    return next((value for word, value in NAME_DEFAULTS if word in plain), 0.0)


def fill_by_name(df: DataFrame) -> DataFrame:
    return df.fillna({c: feature_default(c) for c, kind in df.dtypes if kind == "double"})


def one_hot(value: Column, vocabulary: list[str], prefix: str, other: bool = False) -> list[Column]:
    """0/1 columns for a fixed vocabulary; ``other``: one more for any further known value."""
    out = [F.coalesce((value == v).cast("int"), F.lit(0)).alias(f"{prefix}_{i}") for i, v in enumerate(vocabulary)]
    if other:
        out.append(F.coalesce((~value.isin(*vocabulary)).cast("int"), F.lit(0)).alias(f"{prefix}_other"))
    return out


def one_hot_decode(columns: list[str], names: list[str], unknown: str = "unknown") -> Column:
    return F.coalesce(*[F.when(F.col(c) == 1, n) for c, n in zip(columns, names)], F.lit(unknown))


def one_hot_issues(columns: list[str], sums: tuple[int, ...] = (1,)) -> Column:
    """What is wrong with a one-hot group: values besides 0 and 1, or a sum that is not allowed."""
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    binary = F.lit(True)
    for c in columns:
        binary = binary & F.col(c).isin(0, 1)
    return F.filter(F.array(F.when(~binary, "not binary"), F.when(~total.isin(*sums), "sum")), lambda x: x.isNotNull())


def first_known(*columns: Column) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in columns])


def median_impute(df: DataFrame, columns: list[str], train: Column) -> DataFrame:
    """Nulls replaced by the median over the rows where ``train`` holds: one aggregated row joined to all."""
    medians = df.agg(*[F.median(F.when(train, F.col(c))).alias(f"_median_{c}") for c in columns])
    joined = df.join(F.broadcast(medians))  # a single row
    return joined.select(*[F.coalesce(c, f"_median_{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


def recency_weights(df: DataFrame, date: str, half_life_days: float, name: str = "weight") -> DataFrame:
    """0.5^(age / half-life) from the newest row, scaled to a mean of 1 over all rows (one aggregated row)."""
    newest = df.agg(F.max(date).alias("_newest"))
    raw = df.join(F.broadcast(newest)).withColumn("_raw", F.pow(F.lit(0.5), F.datediff("_newest", date) / half_life_days))
    mean = raw.agg(F.avg("_raw").alias("_mean"))
    return raw.join(F.broadcast(mean)).withColumn(name, F.col("_raw") / F.col("_mean")).drop("_newest", "_raw", "_mean")


def out_of_distribution(df: DataFrame, columns: list[str], train: Column, most: float = 8.0) -> DataFrame:
    """``flags``: for each column missing, or further than ``most`` deviations from the training mean."""
    stats = df.agg(*[f(F.when(train, F.col(c))).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    joined = df.join(F.broadcast(stats))
    flags = [F.when(F.col(c).isNull(), f"{c}:missing").when(F.abs(F.col(c) - F.col(f"_m_{c}")) > most * F.col(f"_s_{c}"), f"{c}:far") for c in columns]
    return joined.withColumn("flags", F.array_join(F.filter(F.array(*flags), lambda x: x.isNotNull()), ",")).select(*df.columns, "flags")


def walk_forward(first: int, last: int, train: int, validate: int = 1, test: int = 1) -> list[tuple[int, int, int, int]]:
    """(train from, train to, validation to, test to) years of blocked windows, ends exclusive."""
    return [(y, y + train, y + train + validate, y + train + validate + test) for y in range(first, last - train - validate - test + 2)]


def split_windows(df: DataFrame, year: str, windows: list[tuple[int, int, int, int]]) -> DataFrame:
    """Each row once for every window it takes part in, with ``window`` and ``part``."""
    spans = F.array(*[F.struct(F.lit(i).alias("window"), *[F.lit(v).alias(n) for n, v in zip("abcd", w)]) for i, w in enumerate(windows)])
    rows = df.withColumn("w", F.explode(spans)).where((F.col(year) >= F.col("w.a")) & (F.col(year) < F.col("w.d")))
    part = F.when(F.col(year) < F.col("w.b"), "train").when(F.col(year) < F.col("w.c"), "validation").otherwise("test")
    return rows.select(*df.columns, F.col("w.window").alias("window"), part.alias("part"))


#: Days before the final, by kind of tournament and round.
BEFORE_FINAL = {
    "G": {"R128": -13, "R64": -11, "R32": -9, "R16": -6, "QF": -4, "SF": -2, "F": 0, "BR": 0},
    "M_large": {"R128": -11, "R64": -9, "R32": -7, "R16": -5, "QF": -4, "SF": -2, "F": 0, "BR": 0},
    "M_medium_long": {"R64": -12, "R32": -10, "R16": -8, "QF": -4, "SF": -2, "F": 0, "BR": 0},
    "M_medium_short": {"R64": -6, "R32": -4, "R16": -3, "QF": -2, "SF": -1, "F": 0, "BR": 0},
    "M_small": {"R64": -6, "R32": -5, "R16": -3, "QF": -2, "SF": -1, "F": 0, "BR": 0},
    "standard": {"R32": -6, "R16": -4, "QF": -2, "SF": -1, "F": 0, "BR": 0},
}
#: Days from the start of the main draw to qualifying rounds, where their number is unknown.
QUALIFYING = {
    "G": {"Q1": -7, "Q2": -5, "Q3": -3, "Q4": -3},
    "M": {"Q1": -2, "Q2": -1},
    "default": {"Q1": -3, "Q2": -2, "Q3": -1, "Q4": -1},
}
#: Days from the start for levels without a knock-out week.
STATIC = {"O": {"RR": 1, "SF": 6, "F": 7}, "D": {"RR": 0, "QF": 0, "SF": 0, "F": 2, "BR": 2}}


def _lookup(table: dict[str, dict[str, int]], kind: Column, code: Column) -> Column:
    flat = F.create_map(*[F.lit(x) for k, rounds in table.items() for r, n in rounds.items() for x in (f"{k}:{r}", n)])
    return F.coalesce(F.try_element_at(flat, F.concat_ws(":", kind, code)), F.lit(0))


def round_day_offset(level: Column, draw: Column, code: Column, start: Column, qualifiers: Column) -> Column:
    """Days from a tournament's start to a round.

    Knock-out rounds count back from a final on a Sunday: the next one, or that
    of the second week for two-week events. Qualifying rounds are the days just
    before the start where their number is known.
    """
    weekday = F.weekday(start)
    to_sunday = F.when(weekday == 6, 7).otherwise(6 - weekday)
    medium_long = (level == "M") & (draw == 64) & (weekday != 0)
    large = (level == "M") & (draw >= 96)
    kind = F.when(level == "G", "G").when(large, "M_large").when(medium_long, "M_medium_long").when((level == "M") & (draw == 64), "M_medium_short").when(level == "M", "M_small").otherwise("standard")
    final = to_sunday + F.when((level == "G") | large | medium_long, 7).otherwise(0)
    number = F.substring(code, 2, 1).try_cast("int")
    group = F.when(level.isin(*[k for k in QUALIFYING if k != "default"]), level).otherwise("default")
    qualifying = F.coalesce(-(qualifiers - number + 1), _lookup(QUALIFYING, group, code))
    return F.when(level.isin(*STATIC), _lookup(STATIC, level, code)).when(code.rlike("^Q[1-4]$"), qualifying).otherwise(final + _lookup(BEFORE_FINAL, kind, code))


#: Words of a title that tell its level, in the order in which they are tried.
LEVEL_WORDS = (
    ("G", ("australian open", "roland garros", "french open", "wimbledon", "us open", "grand slam")),
    ("M", ("masters", "1000", "indian wells", "miami open", "monte carlo", "madrid", "rome", "canada", "toronto", "montreal", "cincinnati", "shanghai", "paris masters")),
    ("C", ("challenger",)),
)
LEVEL_PATTERNS = (("25", r"\b(m25|25k)\b"), ("15", r"\b(m15|15k)\b|itf.*men|men.*itf"))


def level_of_title(title: Column) -> Column:
    """A tournament's level from its title: the first rule that fits, else A."""
    t, out = F.lower(title), F.when(F.lit(False), "")
    for level, words in LEVEL_WORDS:
        out = out.when(t.rlike("|".join(words)), level)
    for level, pattern in LEVEL_PATTERNS:
        out = out.when(t.rlike(pattern), level)
    return out.otherwise("A")


#: Level codes of each reporting segment.
SEGMENTS = {"itf": ("15", "15.0", "25", "25.0", "M15", "M25"), "challenger": ("C", "CH", "CHALLENGER"), "atp": ("A", "M", "G", "ATP", "ATP250", "ATP500", "MASTERS", "GRAND_SLAM")}


def segment_of_level(level: Column, title: Column) -> Column:
    """Reporting segment; a title that says ITF or Challenger comes before the code."""
    code, t = F.upper(F.trim(level)), F.coalesce(F.lower(title), F.lit(""))
    return F.when(t.contains("itf") | code.isin(*SEGMENTS["itf"]), "itf").when(t.contains("challenger") | code.isin(*SEGMENTS["challenger"]), "challenger").when(code.isin(*SEGMENTS["atp"]), "atp").otherwise("unclassified")


#: Words of a title that tell its surface, then venues that do.
SURFACE_WORDS = (("Clay", ("clay", "terre")), ("Grass", ("grass", "lawn")), ("Hard", ("hard",)))
VENUES = (("Clay", ("roland garros", "french open")), ("Grass", ("wimbledon",)), ("Clay", ("monte carlo", "rome", "madrid", "barcelona", "hamburg")))


def surface_of_title(title: Column) -> Column:
    """A surface the title names or its venue has, else null."""
    t, out = F.lower(title), F.when(F.lit(False), "")
    for surface, words in (*SURFACE_WORDS, *VENUES):
        out = out.when(t.rlike("|".join(words)), surface)
    return out


def qualifier_rounds(df: DataFrame, event: str, round_code: str) -> DataFrame:
    """``qualifier_rounds`` of each event: distinct rounds that start with Q, quarter-finals aside."""
    is_q = F.col(round_code).startswith("Q") & (F.col(round_code) != "QF")
    return df.groupBy(event).agg(F.countDistinct(F.when(is_q, F.col(round_code))).alias("qualifier_rounds"))


def nested_funnel(df: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """How many rows pass each stage and all before it: one row, whose counts cannot rise."""
    passed, counts = F.lit(True), []
    for name, condition in stages:
        passed = passed & F.coalesce(condition, F.lit(False))
        counts.append(F.count_if(passed).alias(name))
    return df.agg(*counts)


def ranked(df: DataFrame, keys: list[str], order: list, name: str = "place") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
