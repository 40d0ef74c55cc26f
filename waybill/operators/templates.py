"""Templates of log messages: lines that differ in their varying parts only, grouped and counted.

The tree has the component at its top, then the number of words of a message, then one level for each word. A word with a
digit varies. A node that gets more than ``most`` different words at one place varies there. So below
a component and a length there are at most ``most`` words a place, however many messages differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.functions import logtext, paths

VARIES = "<*>"
MOST = 8


def message_templates(messages: DataFrame, most: int = MOST) -> DataFrame:
    """``template`` and count of each group of messages (``component``, ``message``, and other columns to count by).

    Messages are masked and counted in tasks before anything is moved. The words of a place are counted over distinct masked
    messages; places that vary are found from them, and the counts are merged under the templates.
    """
    keys = [c for c in messages.columns if c != "message"]
    words = F.transform(F.split(F.trim("message"), r"\s+"), lambda w: F.when(w.rlike("[0-9]"), F.lit(VARIES)).otherwise(w))
    masked = messages.select(*keys, words.alias("words")).groupBy(*keys, "words").agg(F.count("*").alias("n"))
    placed = masked.select("component", F.size("words").alias("length"), F.posexplode("words").alias("place", "word")).distinct()
    varying = (
        placed.groupBy("component", "length", "place").agg(F.count("*").alias("n_words")).filter(F.col("n_words") > most)
        .groupBy("component", "length").agg(F.collect_set("place").alias("varying"))  # places of one length
    )
    found = masked.withColumn("length", F.size("words")).join(varying, ["component", "length"], "left")
    general = F.transform("words", lambda w, i: F.when(F.array_contains("varying", i), F.lit(VARIES)).otherwise(w))
    return found.select(*keys, F.array_join(general, " ").alias("template"), "n").groupBy(*keys, "template").agg(F.sum("n").alias("n"))


def failure_templates(lines: DataFrame, most: int = MOST) -> DataFrame:
    """Error lines of each application by the template of their message (what follows the component)."""
    errors = lines.filter(logtext.contains_word("ERROR")).select(
        "file_path", logtext.log_level().alias("log_level"), logtext.component().alias("component"), "value"
    ).filter("log_level = 'ERROR'")
    message = F.regexp_replace("value", r"^.*?ERROR\s+[^:]*:", "")
    named = errors.select(paths.application_id().alias("application_id"), "component", message.alias("message"))
    return message_templates(named, most).withColumnRenamed("n", "n_errors")


def line_templates(lines: DataFrame, most: int = MOST) -> DataFrame:
    """All lines with a component, by template."""
    known = lines.select(logtext.component().alias("component"), "value").filter("component != ''")
    message = F.regexp_replace("value", r"^.*?(INFO|WARN|ERROR|DEBUG)\s+[^:]+:", "")
    return message_templates(known.select("component", message.alias("message")), most).withColumnRenamed("n", "n_lines")
