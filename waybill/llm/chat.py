"""Chat formatting from event logs.

A conversation is a log of events. The log is partitioned by conversation, ordered by
sequence number, and folded into final messages; the messages are rendered with a template
that marks turns and escapes its own control strings inside texts, so the output can be read
back exactly. Everything is a built-in function.

An event has ``conv_id``, ``seq``, ``turn``, ``kind``, ``role``, ``text``:

- ``message`` sets the text of its turn;
- ``delta`` adds to it (streamed output);
- ``edit`` sets it and discards what came before in all later turns;
- ``regenerate`` empties it, likewise; the deltas of the new answer follow.

Events are ordered by ``seq``, those without one last; where it is equal, by turn, kind, role and text. An event that
is there several times, equal in all of these, counts once.

A conversation becomes one row, so its turns meet in one task; the events of a turn are
collected apart from those of other turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The template: <|role|> newline text <|end|> newline. Escaped text holds no "<", "|" or "[".
END = "<|end|>\n"
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("|", "\\p"), ("[", "\\s"))  # the backslash first
TRAINED_ROLE = "assistant"
NO_SEQ = (1 << 63) - 1  # stands for a missing sequence number


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    # each backslash begins a pair, so pairs can be put back one kind after the other
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def fold(events: DataFrame) -> DataFrame:
    """Final messages: ``conv_id``, ``turn``, ``role``, ``text``, one for each turn that is left.

    Per turn, distinct events are collected in order; those from the last set event on count,
    unless an edit or a regeneration of an earlier turn came after them. The role is that of the
    first counted event that has one. Null text counts as empty, null kind as ``message``, a null turn comes ahead of all
    others. A null conversation is a conversation of its own.
    """
    kind = F.coalesce("kind", F.lit("message"))
    clean = events.select(
        "conv_id", F.coalesce(F.col("seq").cast("long"), F.lit(NO_SEQ)).alias("seq"), "turn", kind.alias("kind"), "role",
        F.coalesce("text", F.lit("")).alias("text"),
    )
    cuts = F.col("kind").isin("edit", "regenerate")
    turns = clean.groupBy("conv_id", "turn").agg(
        F.max(F.when(cuts, F.col("seq"))).alias("cut_at"),
        F.sort_array(F.collect_set(F.struct("seq", "kind", "role", "text"))).alias("log"),
    )
    ahead = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    # at equal seq an earlier turn's event comes first, so it cuts what has a smaller seq
    since = F.max("cut_at").over(ahead)
    is_set = lambda e: e["kind"].isin("message", "edit", "regenerate")
    set_at = F.array_max(F.transform("log", lambda e, i: F.when(is_set(e), i).otherwise(-1)))
    live = F.filter("log", lambda e, i: (i >= F.col("set_at")) & F.coalesce(e["seq"] >= F.col("since"), F.lit(True)))
    texts = F.transform("live", lambda e: F.when(e["kind"] == "regenerate", F.lit("")).otherwise(e["text"]))
    return (
        turns.withColumns({"since": since, "set_at": set_at}).select("conv_id", "turn", live.alias("live"))
        .filter(F.size("live") > 0)
        .select(
            "conv_id", "turn",
            F.get(F.filter(F.transform("live", lambda e: e["role"]), lambda r: r.isNotNull()), F.lit(0)).alias("role"),
            F.array_join(texts, "").alias("text"),
        )
    )


def events_of_rows(rows: DataFrame) -> DataFrame:
    """Rows of finished turns as events: each row a message of its own, in order of
    ``turn``, then role and text. Rows that share a turn, or have none, are all kept."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    place = F.row_number().over(order)
    return rows.select(
        "conv_id", place.alias("seq"), place.alias("turn"), F.lit("message").alias("kind"), "role", "text"
    )


def render(messages: DataFrame) -> DataFrame:
    """``conv_id``, ``formatted``, and ``loss_spans``: start and length, in characters and in UTF-8 bytes of
    ``formatted``, of the texts that are trained on (those of the assistant). Null roles count as empty."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    opened = F.concat(F.lit("<|"), escape(role), F.lit("|>\n"))
    pieces = messages.select(
        "conv_id", "turn", opened.alias("opened"), escape(text).alias("body"), (role == TRAINED_ROLE).alias("trained")
    )
    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)

    def start(size) -> Column:
        ahead = F.coalesce(F.sum(size("opened") + size("body") + len(END)).over(order), F.lit(0))
        return ahead + size("opened")

    spans = pieces.withColumns({"start": start(F.length), "byte_start": start(F.octet_length)})
    piece = F.struct(
        "turn", F.concat("opened", "body", F.lit(END)).alias("piece"), "trained",
        F.struct(
            "start", F.length("body").cast("long").alias("length"),
            "byte_start", F.octet_length("body").cast("long").alias("byte_length"),
        ).alias("span"),
    )
    return spans.groupBy("conv_id").agg(F.sort_array(F.collect_list(piece)).alias("all")).select(
        "conv_id",
        F.array_join(F.transform("all", lambda p: p["piece"]), "").alias("formatted"),
        F.transform(F.filter("all", lambda p: p["trained"]), lambda p: p["span"]).alias("loss_spans"),
    )


def under_mask() -> Column:
    """The text under the loss mask of a rendered conversation: the spans, cut out of ``formatted`` and unescaped.

    Spans are cut from bytes, which takes no longer for a late one than for an early one.
    """
    data = F.col("formatted").cast("binary")
    cut = lambda s: F.substring(data, (s["byte_start"] + 1).cast("int"), s["byte_length"].cast("int"))
    return F.array_join(F.transform("loss_spans", lambda s: unescape(cut(s).cast("string"))), "")


def format_chats(events: DataFrame) -> DataFrame:
    """Fold event logs and render them: one row per conversation that has a message left."""
    return render(fold(events))


def parse(formatted: DataFrame) -> DataFrame:
    """Read turns back from ``formatted``: adds ``turns``, an array of (role, text, trained). It needs that column alone."""
    split = F.split("formatted", r"<\|end\|>\n")
    pieces = F.slice(split, 1, F.size(split) - 1)

    def turn(piece: Column) -> Column:
        role = unescape(F.regexp_extract(piece, r"(?s)^<\|(.*?)\|>\n", 1))
        text = unescape(F.regexp_replace(piece, r"(?s)^<\|.*?\|>\n", ""))
        return F.struct(role.alias("role"), text.alias("text"), (role == TRAINED_ROLE).alias("trained"))

    return formatted.select("*", F.transform(pieces, turn).alias("turns"))
