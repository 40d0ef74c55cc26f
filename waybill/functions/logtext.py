"""Column expressions that read one log line.

A line looks like ``17/03/29 10:04:41 INFO component: message``. Every
function returns a built-in Spark expression, so a scan that uses several of
them stays one pass in the JVM. "Not matched" is the empty string, and a null
line gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The levels and the line grammar.
LEVELS = ("INFO", "WARN", "ERROR", "DEBUG")
LEVEL = "(INFO|WARN|ERROR|DEBUG)"
STAMP = r"^(\d{2}/\d{2}/\d{2} \d{2}:\d{2}:\d{2})"
COMPONENT = LEVEL + r"\s+([^:]+):"
STRICT_LEVEL = STAMP + r"\s+" + LEVEL + r"(?:\s|$)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def log_level(line: Column | str = "value", mode: str = "loose") -> Column:
    """Level of a line.

    ``loose`` takes the first level word anywhere, also inside another word, so
    it counts stack trace text such as ``INFORMATION``. ``strict`` takes the
    word right behind the time stamp only.
    """
    if mode == "loose":
        return _first_level(_col(line))
    if mode == "strict":
        return F.regexp_extract(_col(line), STRICT_LEVEL, 2)
    raise ValueError(f"mode is 'loose' or 'strict', not {mode!r}")


def _first_level(line: Column) -> Column:
    """First level word. The usual line has INFO and nothing else in its first
    22 characters (time stamp, blank, INFO), which needs no regex: the words do
    not overlap, so one that began before INFO would lie in that head as well.
    """
    head = F.substring(line, 1, 22)
    plain = head.contains("INFO")
    for other in ("WARN", "ERROR", "DEBUG"):
        plain = plain & ~head.contains(other)
    return F.when(plain, F.lit("INFO")).otherwise(F.regexp_extract(line, LEVEL, 1))


def has_level(line: Column | str = "value") -> Column:
    """Whether a line holds a level word; the same as a level other than ``''``,
    without a regex."""
    info, *others = (_col(line).contains(word) for word in LEVELS)
    for other in others:
        info = info | other
    return info


def timestamp_text(line: Column | str = "value") -> Column:
    """The ``yy/MM/dd HH:mm:ss`` text at the very start of a line."""
    return F.regexp_extract(_col(line), STAMP, 1)


def component(line: Column | str = "value") -> Column:
    """Text between the level and the first colon behind it."""
    return F.regexp_extract(_col(line), COMPONENT, 2)


def parse_stamp(text: Column | str) -> Column:
    """Time stamp text to a zone-less timestamp; null when it is no real date.

    The two-digit year lies in 2000-2099. The text is turned into ISO form and
    cast, which costs less than a pattern-driven parse and never fails the job.
    """
    iso = F.concat(F.lit("20"), F.replace(_col(text), F.lit("/"), F.lit("-")))
    return iso.try_cast("timestamp_ntz")


def event_time(line: Column | str = "value") -> Column:
    """Time of a line, null when it has none or an impossible one."""
    return parse_stamp(timestamp_text(line))


def level_tokens(line: Column | str = "value") -> Column:
    """Every level word in a line, as an array."""
    return F.regexp_extract_all(_col(line), F.lit(LEVEL), F.lit(1))


def contains_word(word: str, line: Column | str = "value") -> Column:
    return _col(line).contains(word)
