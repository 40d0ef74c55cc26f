"""Log level analysis: counts, totals, shares, samples.

``level_frame`` reads the lines once and leaves at most five rows; counts,
totals, shares and the report are made from it. The other operators take lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from waybill.functions import logtext


def level_frame(lines: DataFrame, mode: str = "loose") -> DataFrame:
    """One row per level word, and one with level ``''`` for lines without any.

    ``n_lines`` counts lines, ``count`` only those with a level. At most five
    rows, so what is built on it may use one task.
    """
    return (
        lines.select(logtext.log_level(mode=mode).alias("log_level"))
        .groupBy("log_level")
        .agg(
            F.count("*").alias("n_lines"),
            F.count(F.nullif("log_level", F.lit(""))).alias("count"),
        )
    )


def log_level_counts(levels: DataFrame) -> DataFrame:
    """Lines per level, most frequent first."""
    # The condition is on the count and not on the level: a condition on the
    # grouping key is pushed below the aggregate and runs the regex twice.
    return (
        levels.filter("count > 0").select("log_level", "count")
        .orderBy(F.desc("count"), "log_level")
    )


def log_totals(levels: DataFrame) -> DataFrame:
    """All lines, lines with a level, and distinct levels."""
    return levels.agg(
        F.coalesce(F.sum("n_lines"), F.lit(0)).alias("total_lines"),
        F.coalesce(F.sum("count"), F.lit(0)).alias("lines_with_level"),
        F.count_if(F.col("count") > 0).alias("unique_levels"),
    )


def log_level_distribution(levels: DataFrame) -> DataFrame:
    """Lines per level and their percentage of the lines with a level."""
    total = F.sum("count").over(Window.partitionBy())
    return (
        levels.filter("count > 0")
        .select(
            "log_level", "count",
            F.try_divide(F.col("count") * 100.0, total).alias("percentage"),
        )
        .orderBy(F.desc("count"), "log_level")
    )


def level_counts_complete(levels: DataFrame) -> DataFrame:
    """Counts for every known level, 0 where a level does not occur."""
    known = levels.sparkSession.createDataFrame(
        list(enumerate(logtext.LEVELS)), "severity int, log_level string"
    )
    counts = levels.filter("count > 0").select("log_level", "count")
    # at most one row per level
    return (
        known.join(F.broadcast(counts), "log_level", "left")
        .select("log_level", F.coalesce("count", F.lit(0).cast("bigint")).alias("count"))
    )


def level_token_counts(lines: DataFrame) -> DataFrame:
    """Occurrences of each level word; a line may hold several."""
    # explode would add a filter on the array, and find the words twice
    return (
        lines.select(F.explode_outer(logtext.level_tokens()).alias("token"))
        .filter("token IS NOT NULL")
        .groupBy("token").agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "token")
    )


def lines_with_level(lines: DataFrame) -> DataFrame:
    """Lines that hold a level word, with that level."""
    return lines.filter(logtext.has_level()).select("*", logtext.log_level().alias("log_level"))


def _drawn(lines: DataFrame, n: int, file: Column | str) -> DataFrame:
    """The n lines whose place has the smallest digest."""
    place = F.concat_ws(":", file, "line_start")
    return lines.orderBy(F.md5(place), place).limit(n)


def sample_log_entries(lines: DataFrame, n: int = 10, file: Column | str = "file_path") -> DataFrame:
    """A repeatable sample of n lines with a level, each line as likely as any other.

    A line is known by its place: ``file`` and the byte at which it begins (``line_start``, see ``scan_placed_lines``). So
    the sample is the same however the files were cut, and equal lines are lines of their own. One pass: a task
    keeps n lines, and nothing else is moved.
    """
    return _entries(_drawn(lines.filter(logtext.has_level()), n, file))


def levels_and_sample(
    lines: DataFrame, n: int = 10, file: Column | str = "file_path", mode: str = "loose"
) -> tuple[DataFrame, DataFrame]:
    """The level frame and the sample of placed lines, from one pass, which runs here.

    The counts are metrics that the pass for the sample observes on its way. It has no shuffle, so a task that is
    run again after a loss is counted once. What comes to the driver is n lines and five numbers.
    """
    level = F.col("log_level")
    parsed = lines.select("value", "line_start", F.col(file).alias("file") if isinstance(file, str) else file.alias("file"), logtext.log_level(mode=mode).alias("log_level"))
    seen = Observation()
    watched = parsed.observe(seen, F.count("*").alias("all"), *[F.count_if(level == x).alias(x) for x in logtext.LEVELS])
    spark = lines.sparkSession
    drawn = _drawn(watched.filter(level != ""), n, "file").select(F.col("value").alias("log_entry"), "log_level").collect()
    counts = [(x, seen.get[x], seen.get[x]) for x in logtext.LEVELS if seen.get[x]]
    rest = seen.get["all"] - sum(c for _, c, _ in counts)
    frame = spark.createDataFrame(counts + [("", rest, 0)] * (rest > 0), "log_level string, n_lines long, count long")
    return frame, spark.createDataFrame(drawn, "log_entry string, log_level string")


def sample_by_text(lines: DataFrame, n: int = 10) -> DataFrame:
    """The same for lines whose places are not known.

    It does not depend on how the lines are partitioned, and equal lines of a file are lines of their
    own. They share a digest, so lines are counted by digest first; that shuffles a short key and a
    number, not the lines. The c copies behind a digest stand for c random numbers, of which only the n
    smallest can matter: in order, they grow by exponential steps that shrink as copies are used up, each
    step drawn from the digest and its number. The n smallest of all digests win, and a second pass
    fetches their lines.
    """
    digest = F.substring(F.md5(F.concat_ws("\n", "file_path", "value")), 1, 16)
    digested = lines.filter(logtext.has_level()).select("file_path", "value", digest.alias("digest"))
    counted = digested.groupBy("digest").agg(F.count("*").alias("copies"))

    def step(i: Column) -> Column:
        drawn = F.conv(F.substring(F.md5(F.concat_ws("\n", "digest", i)), 1, 12), 16, 10).cast("double")
        return -F.log((drawn + 1) / 2.0**48) / (F.col("copies") - i + 1)

    def place(j: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), j), F.lit(0.0), lambda total, i: total + step(i))

    firsts = F.sequence(F.lit(1), F.least(F.lit(n), "copies").cast("int"))
    won = (
        counted.select("digest", F.explode(F.transform(firsts, place)).alias("place"))
        .orderBy("place", "digest").limit(n).groupBy("digest").agg(F.count("*").alias("taken"))
    )
    fetched = (
        digested.join(F.broadcast(won), "digest")  # n rows
        .groupBy("digest", "taken").agg(F.min(F.struct("file_path", "value")).alias("line"))
    )
    return _entries(
        fetched.select("line.*", F.explode(F.sequence(F.lit(1).cast("bigint"), "taken")).alias("copy"))
    )


def sample_random(lines: DataFrame, n: int = 10, seed: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """A random sample of n lines with a level, and the columns ``keep`` of them."""
    return _entries(lines.filter(logtext.has_level()).orderBy(F.rand(seed)).limit(n), keep)


def sample_check(lines: DataFrame, n: int = 10, seed: int = 1) -> DataFrame:
    """What holds for a random sample of any seed: its rows, those that are lines of the table
    with the level they have, and its distinct places in the table."""
    sample = sample_random(lines.withColumn("line_id", F.monotonically_increasing_id()), n, seed, ("line_id",))
    levels = lines.filter(logtext.has_level()).select(
        F.col("value").alias("log_entry"), logtext.log_level().alias("log_level"), F.lit(1).alias("known")
    )
    wanted = F.broadcast(sample)  # n rows
    hits = levels.join(wanted, ["log_entry", "log_level"]).groupBy("line_id").agg(F.max("known").alias("known"))
    return hits.agg(F.count("*").alias("n_places"), F.sum("known").alias("n_known"))


def _entries(lines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return lines.select(F.col("value").alias("log_entry"), logtext.log_level().alias("log_level"), *keep)


def filter_error_lines(lines: DataFrame, word: str = "ERROR") -> DataFrame:
    """Lines that hold a word, as they are."""
    return lines.filter(logtext.contains_word(word))


def component_counts(lines: DataFrame) -> DataFrame:
    """Lines per component, with ``''`` for lines without one."""
    return lines.select(logtext.component().alias("component")).groupBy("component").agg(F.count("*").alias("count"))


def top_components(lines: DataFrame, n: int = 20) -> DataFrame:
    """The n components with most lines; ties go to the smaller name."""
    return component_counts(lines).orderBy(F.desc("count"), "component").limit(n)
