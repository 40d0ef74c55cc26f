"""The registered queries of this package and their SQL, where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.llm import (
    bloom_lm, bpe, chat, collision_search, divergence, hard_negatives, mixing, quality_ledger, simhash, string_kernel,
    substring, subword, token_counts,
)
from waybill.llm.common import held_out, table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
MOST_TOKENS = 512
GOOD_SCORE = 0.7


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken, sources = mixing.mix(table(spark, sf_dir, "documents"), F.array("source"))
    # one row per source
    return taken.join(F.broadcast(sources), "pattern").select(
        F.col("id").alias("doc_id"), "size", "source_size", "target",
        (F.col("size") * F.col("copies")).alias("taken"), "source",
    )


def op2_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return collision_search.nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


def op3_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    left_out = held_out("doc_id", 7, 2)
    scored = bloom_lm.score_documents(table(spark, sf_dir, "documents"), ~left_out)
    return scored.withColumnRenamed("id", "doc_id").withColumn("held_out", left_out)


def op4_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, left_out = table(spark, sf_dir, "documents"), held_out("doc_id", 3, 1)
    model = string_kernel.train(docs.filter(~left_out))
    found = string_kernel.predict(docs, model, ["doc_id"])
    return found.withColumn("held_out", left_out)


def op5_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_ledger.ledger(quality_ledger.measure(table(spark, sf_dir, "documents")))
    return rows.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        quality_ledger.rejected("base_v1").alias("base_failed"),
        (~quality_ledger.rejected("clean_v3")).alias("kept"), "failed",
    )


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select(control.columns).unionByName(control)
    read = chat.parse(chat.format_chats(chat.events_of_rows(rows)).withColumn("trained", chat.under_mask()))
    said = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return read.select("conv_id", "formatted", F.size("turns").cast("long").alias("n_turns"), said.alias("said"), "trained").select(
        "conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"), F.sha2("trained", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_subword(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, left_out = table(spark, sf_dir, "documents"), held_out("doc_id", 4, 2)
    model = subword.train(docs.filter(~left_out), table(spark, sf_dir, "labels"))
    scored = subword.score(docs, model, ["doc_id"])
    return scored.withColumn("held_out", left_out).withColumn(
        "predicted", (F.col("score") >= GOOD_SCORE).cast("int")
    )


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), VOCABULARY).withColumnRenamed("id", "doc_id")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), VOCABULARY)
    return counts.select(
        F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > MOST_TOKENS).alias("over_limit")
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), simhash.hex_print().alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op11_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, label=label)


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_collision_search": op2_collision_search,
    "op3_bloom_lm": op3_bloom_lm,
    "op4_string_kernel": op4_string_kernel,
    "op5_quality_ledger": op5_quality_ledger,
    "op6_chat": op6_chat,
    "op7_subword": op7_subword,
    "op8_bpe": op8_bpe,
    "op9_token_counts": op9_token_counts,
    "op10_simhash": op10_simhash,
    "op11_substring": op11_substring,
    "op12_divergence": op12_divergence,
    "op13_hard_negatives": op13_hard_negatives,
}
_RULES = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
    "capitals": "2 * n_capitals > n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
}
_BITS = " + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, rule in enumerate(_RULES.values()))
# The other queries can't be put in SQL: hashes with seeds, trained models, approximate search, tokenizers.
ORACLES: dict[str, str] = {
    "op5_quality_ledger": rf"""
      WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
      w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
          list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
      i AS (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w),
      g AS (SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(words[i:i + 4], ' ')) AS c FROM i),
      rep AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM g, range(5) t(k) WHERE c > 1 GROUP BY r),
      m AS (SELECT doc_id, len(words) AS n_words,
          coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
          len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
          coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines,
          len(regexp_extract_all(t, '[A-Z]{{2,}}')) AS n_capitals FROM w LEFT JOIN rep USING (r)),
      f AS (SELECT *, CAST({_BITS} AS BIGINT) AS failed FROM m)
      SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed,
        failed & 119 = 0 AS kept, failed FROM f""",
    "op6_chat": r"""
      WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
      n AS (SELECT *, length(role || text) + length(regexp_replace(role || text, '[^\\<|\[]', '', 'g')) AS escaped FROM c)
      SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
        sum(escaped + 13)::BIGINT AS formatted_chars
      FROM n GROUP BY 1""",
    "op11_substring": r"""
      WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
      i AS (SELECT r, words, unnest(range(1, len(words) - 33)) AS i FROM d),
      g AS (SELECT r, i, count(*) OVER (PARTITION BY md5(array_to_string(words[i:i + 34], ' '))) AS c FROM i),
      gone AS (SELECT r, list(DISTINCT i + k) AS gone FROM g, range(35) t(k) WHERE c > 1 GROUP BY r),
      m AS (SELECT doc_id, words, coalesce(map_from_entries(list_transform(gone, lambda x: (x, true))), MAP {}) AS gone FROM d LEFT JOIN gone USING (r))
      SELECT doc_id, len(words) AS n_words, cardinality(gone)::BIGINT AS n_removed,
        sha256(array_to_string(list_filter(words, lambda w, i: gone[i] IS NULL), ' ')) AS kept_sha256 FROM m""",
    "op12_divergence": r"""
      WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
          regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
        t AS (SELECT r, lang, source, translate(unnest(words), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
        kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY 1, 2, 3),
        all_c AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN kept k USING (lang) LEFT JOIN c USING (lang, source, term)),
        p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER w + count(*) OVER w) AS p
          FROM all_c WINDOW w AS (PARTITION BY lang, source)),
        q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER w + count(*) OVER w) AS q
          FROM kept WINDOW w AS (PARTITION BY lang)),
        pair AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
          FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
        pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
        terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value
          FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
          FROM (FROM pairs UNION ALL FROM terms))
      SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200""",
    "op13_hard_negatives": """
      WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
          list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS vec FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
      s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same,
          coalesce(list_sum(list_transform(list_zip(a.vec, b.vec), lambda p: p[1] * p[2])), 0)::BIGINT AS score
        FROM v a JOIN v b ON a.vec_id % 50 = 0 AND len(a.vec) = len(b.vec) AND (a.label <> b.label OR a.vec_id <> b.vec_id)),
      p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
      SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b)::INT AS rank,
        s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
      FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
      QUALIFY rank <= 3""",
}
