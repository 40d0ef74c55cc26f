"""Audit of sources by divergence, on a cube of (group block, group block, term block) cells.

A group is a source of one language. Its term probabilities are smoothed and held as whole numbers, so all results are
exact. The divergence of two groups is a sum over all terms their language keeps, also terms that neither has. The groups of a
language are dealt into blocks of about ``GROUPS``, its kept terms into blocks of about ``TERMS``. A task owns a cell: two
blocks of groups and a block of terms. The slice of a group block at a term block is replicated to the cells that
need it, those of the block with every other block and itself; a cell computes the partial divergences of its pairs in both
directions, and the partial values are added up along the term axis. A cell's memory depends on the block sizes alone.

Words are counted in tasks, with bounded tables, before anything is shuffled; what is shuffled is counts.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waybill.llm.common import stored, text_bytes

UNIT = 1_000_000_000  # whole number that stands for probability 1
MIN_DOCS = 3
TOP = 200
GROUPS = 64  # of a block
TERMS = 8192  # of a block
HELD = 400_000  # counts a task holds before it passes them on
# Everything but letters is a blank: code points up to 0x7F that are no A-Z, a-z. Bytes of other code points stay.
LETTERS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b > 0x7F else 0x20 for b in range(256)
)
COUNTS = pa.schema([
    ("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("n_docs", pa.int64()),
])


def _count_batches(batches: Iterator[pa.RecordBatch], held: int):
    """Occurrences and documents of each term of each group, passed on whenever ``held`` counts are there.

    A group is passed on with a null term once per task, so that groups without terms are known.
    """
    n: dict[tuple[str, str], Counter] = defaultdict(Counter)
    docs: dict[tuple[str, str], Counter] = defaultdict(Counter)
    size = 0

    def passed_on():
        for (lang, source), terms in n.items():
            names = list(terms)
            seen = docs[lang, source]
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * (len(names) + 1)), pa.array([source] * (len(names) + 1)),
                pa.array([None, *names], pa.binary()).cast(pa.string()),
                pa.array([0, *terms.values()], pa.int64()), pa.array([0, *map(seen.__getitem__, names)], pa.int64()),
            ], schema=COUNTS)

    for batch in batches:
        for lang, source, text in zip(
            batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text")
        ):
            counts = Counter(text.as_py().translate(LETTERS).split())
            mine, seen = n[lang, source], docs[lang, source]
            size -= len(mine)
            mine.update(counts)
            seen.update(counts.keys())
            size += len(mine)
            if size >= held or len(n) >= held:
                yield from passed_on()
                n.clear()
                docs.clear()
                size = 0
    yield from passed_on()


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", held: int = HELD) -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` and ``n_docs`` of every term of every group; a null term for the group itself."""
    named = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), text_bytes(text_col).alias("text"),
    )
    counted = named.mapInArrow(partial(_count_batches, held=held), "lang string, source string, term string, n long, n_docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def _share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / total) without leaving 64 bits: long division, three digits at a time."""
    out, rest = np.divmod(count + 1, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def _share_column(count: str, total: str):
    return F.expr(f"1L + CAST({UNIT}BD * (CAST({count} AS DECIMAL(20, 0)) + 1) AS DECIMAL(38, 0)) div CAST({total} AS DECIMAL(20, 0))")


def _excess_column(p: str, q: str):
    """floor((p - q)^2 / q); p and q are at most UNIT + 1, so the square has 60 bits."""
    return F.expr(f"({p} - {q}) * ({p} - {q}) div {q}")


def _excess(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def _dense(slices: list[dict], n_terms: int) -> tuple[list[str], np.ndarray]:
    """Names and probabilities (groups x terms of the block) of a group block."""
    counts = np.zeros((len(slices), n_terms), np.int64)
    for row, s in enumerate(slices):
        counts[row, np.array(s["at"], np.int64)] = s["n"]
    total = np.array([s["total"] for s in slices], np.int64)
    return [s["source"] for s in slices], _share(counts, total[:, None])


def _cell(cell: pa.Table) -> pa.Table:
    """Partial divergences of all ordered pairs of a cell's two group blocks."""
    rows = cell.to_pylist()
    lang, a, b, n_terms = (rows[0][c] for c in ("lang", "a", "b", "n_terms"))
    left = _dense([r for r in rows if r["block"] == a], n_terms)
    right = left if a == b else _dense([r for r in rows if r["block"] == b], n_terms)
    one, two, value = [], [], []
    for (names, p), (others, q) in ((left, right),) if a == b else ((left, right), (right, left)):
        for name, mine in zip(names, p):
            one += [name] * len(others)
            two += others
            value.append(_excess(mine, q).sum(axis=1))
    out = pa.table({"source": pa.array(one, pa.string()), "item": pa.array(two, pa.string()),
                    "value": np.concatenate(value) if value else np.zeros(0, np.int64)})
    out = out.add_column(0, "lang", pa.array([lang] * len(one), pa.string()))
    return out.filter(pa.array([x != y for x, y in zip(one, two)], pa.bool_()))


def audit(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    min_docs: int = MIN_DOCS, top: int = TOP, groups: int = GROUPS, terms: int = TERMS, held: int = HELD,
) -> DataFrame:
    """How far each source of a language is from each other one, and which terms set it off from its language.

    Gives ``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank``. Part ``pair``: for each other source of the language, the
    sum over its kept terms of floor((p-q)^2/q), p of the source, q of the other. Part ``term``: kept terms
    the source has and that are likelier in it than in the language, up to rank ``top``.

    A language keeps the terms found in at least ``min_docs`` of its documents (rows). Null text, language and source count
    as ''. A language that keeps no term has the value 0 for every pair; a source alone in its language has
    no pair. Ties go by item. Repeated rows count as often as they are there. An empty table gives an empty
    result; other columns are not read.
    """
    counts = stored(term_counts(docs, text_col, lang_col, source_col, held), "counts")
    kept = (
        counts.filter("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("n_docs").alias("docs"))
        .filter(F.col("docs") >= min_docs).select("lang", "term", "n_lang")
    )
    kept = stored(kept, "kept")
    langs = stored(kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("n_of_lang")), "langs")
    mine = stored(counts.filter("term IS NOT NULL").join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "n_lang"), "mine")
    # groups, with what their language keeps; a group without kept terms has n_of 0
    sizes = mine.groupBy("lang", "source").agg(F.sum("n").alias("n_of"))
    named = counts.filter("term IS NULL").select("lang", "source")
    n_groups = named.groupBy("lang").agg(F.count("*").alias("n_groups"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n_groups") / groups)).cast("int")
    members = stored(
        named.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").join(n_groups, "lang").select(
            "lang", "source", F.coalesce("v", F.lit(0)).alias("v"), (F.coalesce("n_of", F.lit(0)) + F.coalesce("v", F.lit(0))).alias("total"),
            (F.col("n_of_lang") + F.col("v")).alias("lang_total"), blocks.alias("n_blocks"),
            F.pmod(F.xxhash64("source"), blocks).cast("int").alias("block"),
        ), "members",
    )
    pairs = _pairs(mine, kept, langs, members, terms)
    marked = _terms(mine, members)
    order = [F.desc("value"), F.asc("item")]
    group = Window.partitionBy("lang", "source").orderBy(*order)
    ranked = pairs.withColumn("rank", F.row_number().over(group)).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    first = marked.withColumn("rank", F.row_number().over(group)).filter(F.col("rank") <= top)
    return ranked.unionByName(first.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def _terms(mine: DataFrame, members: DataFrame) -> DataFrame:
    """Kept terms that are likelier in a group than in its language."""
    return (
        mine.filter("n > 0").join(members.select("lang", "source", "total", "lang_total"), ["lang", "source"])
        .select("lang", "source", F.col("term").alias("item"), _share_column("n", "total").alias("p"), _share_column("n_lang", "lang_total").alias("q"))
        .filter("p > q").select("lang", "source", "item", _excess_column("p", "q").alias("value"))
    )


def _pairs(mine: DataFrame, kept: DataFrame, langs: DataFrame, members: DataFrame, terms: int) -> DataFrame:
    """Divergence of each ordered pair of sources of a language."""
    n_cuts = F.greatest(F.lit(1), F.ceil(F.col("v") / terms)).cast("int")
    cut = F.pmod(F.xxhash64("term"), n_cuts).cast("int")
    # a number for each kept term inside its block; a block has about ``terms`` of them
    placed = kept.join(langs.select("lang", "v"), "lang").select("lang", "term", cut.alias("cut"))
    inside = Window.partitionBy("lang", "cut")
    placed = stored(placed.select(
        "*", (F.row_number().over(inside.orderBy("term")) - 1).alias("at"),
    ), "placed")
    cuts = placed.groupBy("lang", "cut").agg(F.count("*").cast("int").alias("n_terms"))
    sparse = mine.join(placed, ["lang", "term"]).groupBy("lang", "source", "cut").agg(F.collect_list(F.struct("at", "n")).alias("has"))
    # every group has a slice at every term block, an empty one too
    slices = (
        members.select("lang", "source", "total", "block", "n_blocks").join(cuts, "lang")
        .join(sparse, ["lang", "source", "cut"], "left")
        .select(
            "lang", "source", "total", "block", "n_blocks", "cut", "n_terms",
            F.coalesce(F.col("has.at"), F.array().cast("array<int>")).alias("at"), F.coalesce(F.col("has.n"), F.array().cast("array<bigint>")).alias("n"),
        )
    )
    dealt = slices.select(
        "lang", "source", "total", "block", "cut", "n_terms", "at", "n",
        F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other"),
    ).select(
        "lang", "source", "total", "block", "cut", "n_terms", "at", "n",
        F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"),
    )
    parts = dealt.groupBy("lang", "a", "b", "cut").applyInArrow(_cell, "lang string, source string, item string, value long")
    # a language that keeps nothing has no cell: its pairs are 0
    bare = members.filter("v = 0").select("lang", "source")
    none = bare.join(bare.withColumnRenamed("source", "item"), "lang").filter("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).unionByName(none)
