"""Quality ledger and chat formatting against plain Python."""

import hashlib
import re

import pytest
from collections import Counter

from pyspark.sql import functions as F

from waybill.llm import chat, quality_ledger
from waybill.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measured(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered.update(range(i, i + 5))
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)
    )


def test_query(spark, small_dir, rows):
    labels = spark.read.parquet(f"{small_dir}/labels.parquet").toPandas().set_index("doc_id").quality
    text = dict(zip(rows.doc_id, rows.text))
    for r in QUERIES["op5_quality_ledger"](spark, small_dir).collect():
        n, *rest = want = measured(text[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (n < 10 or 100 * rest[-1] > 20 * n)
        if r["base_failed"]:
            assert not r["kept"]
        elif r["doc_id"] in labels:
            assert r["kept"] == bool(labels[r["doc_id"]])


def test_measures_of_hard_texts(spark):
    texts = [
        "a b c d e a b c d e", "a a a a a a", "a b c d e x a b c d e f a b c d e f", "a b c d", "", None, " \n \t\n", "x\nx\nx\n\n \n",
        "é é é é é\x0bé\x0cé", "a|b $ % & < > # *", "a b c d e " * 300, "    x", "a\r\nb\r\na\r\n",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in quality_ledger.measure(df).collect():
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert got == measured(texts[r["id"]]), texts[r["id"]]


def test_ledger_edges_policies_and_ablations(spark, edge_docs, no_docs):
    rows = quality_ledger.ledger(quality_ledger.measure(edge_docs))
    held = rows.collect()
    assert len(held) == edge_docs.count()
    names = [r.name for r in quality_ledger.RULES]
    for r in held:
        assert bool(r["failed"] & 1) == (r["n_words"] < 10) and r["failed"] < 1 << len(names)
    got = {(r["policy"], r["rule"]): r for r in quality_ledger.ablations(rows).collect()}
    for policy, rules in quality_ledger.POLICIES.items():
        mask = quality_ledger.mask_of(rules)
        n = rows.filter(quality_ledger.rejected(policy)).count()
        for rule in rules:
            bit, r = 1 << names.index(rule), got[policy, rule]
            hit = [x["failed"] for x in held if x["failed"] & bit]
            other = 0
            for x in hit:
                other |= x & ~bit
            assert (r["n_failed"], r["n_removed"], r["other_rules"]) == (len(hit), n, other)
            assert r["n_only"] == sum(x["failed"] & mask == bit for x in held)
    assert quality_ledger.ledger(quality_ledger.measure(no_docs)).count() == 0


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_chat_query(spark, small_dir):
    turns = {}
    for r in spark.read.parquet(f"{small_dir}/conversations.parquet").collect():
        turns.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"] or ""))
    mark = "</s>[INST] ok [/INST]"
    turns[-1] = [(0, "user", mark), (1, "assistant", mark)]
    got = {r["conv_id"]: r for r in QUERIES["op6_chat"](spark, small_dir).collect()}
    assert set(got) == set(turns)
    for conv, said in turns.items():
        said.sort()
        trained = "".join(t for _, role, t in said if role == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(said) and r["turns_sha256"] == sha("".join(f"{a}\n{t}\n" for _, a, t in said))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(trained), sha(trained))


def test_chat_round_trip_and_spans(spark):
    texts = ["", None, "\\", "<|end|>\n", "<|user|>\n", "\\l\\b\\s", "[INST]</s>", "a|b|>\nc", "\n", "é\U0001f600", "x\\", "\\<[|" * 50]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)]
    rows += [(2, 0, None, "no role"), (2, 1, "a|>\n<b", "odd role"), (None, 3, "user", "no conversation"), (3, None, "user", "x"),
             (3, None, "user", "x"), (4, 5, "assistant", "tie"), (4, 5, "assistant", "tie")]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id bigint, turn bigint, role string, text string, seq int, kind string")
    formatted = chat.format_chats(chat.events_of_rows(df))
    spans = {r["conv_id"]: (r["formatted"], r["loss_spans"]) for r in formatted.collect()}
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat.parse(formatted).collect()}
    assert got[1] == [(r[2], r[3] or "") for r in rows if r[0] == 1]
    assert got[2] == [("", "no role"), ("a|>\n<b", "odd role")] and got[None] == [("user", "no conversation")]
    assert got[3] == [("user", "x")] * 2 and got[4] == [("assistant", "tie")] * 2
    codes = {"\\l": "<", "\\p": "|", "\\s": "[", "\\b": "\\"}
    masked = {r["conv_id"]: r["m"] for r in formatted.select("conv_id", chat.under_mask().alias("m")).collect()}
    for conv, said in got.items():
        assert masked[conv] == "".join(t for role, t in said if role == "assistant")
    for conv, (text, loss) in spans.items():
        under = [text[s["start"] : s["start"] + s["length"]] for s in loss]
        plain = [re.sub(r"\\[lpsb]", lambda m: codes[m[0]], t) for t in under]
        assert plain == [t for role, t in got[conv] if role == "assistant"]
    assert chat.format_chats(chat.events_of_rows(df.filter("false"))).count() == 0


def folded(events):
    """Event by event, in their order; repeated events once."""
    first = lambda x: (x is not None, x)  # nulls ahead

    def place(e):
        _, seq, turn, kind, role, text = e
        return (seq is None, seq or 0), first(turn), kind or "message", first(role), text or ""

    turns, done = {}, set()
    for e in sorted(events, key=place):
        _, seq, turn, kind, role, text = e
        kind, text = kind or "message", text or ""
        if (seq, turn, kind, role, text) in done:
            continue
        done.add((seq, turn, kind, role, text))
        if kind in ("edit", "regenerate"):
            for later in [t for t in turns if first(t) > first(turn)]:
                del turns[later]
        if kind != "delta" or turn not in turns:
            turns[turn] = [role, "" if kind == "regenerate" else text]
        else:
            turns[turn][1] += text
            turns[turn][0] = turns[turn][0] or role
    return {t: (role, text) for t, (role, text) in turns.items()}


def fold_of(spark, events):
    df = spark.createDataFrame(events, "conv_id bigint, seq bigint, turn bigint, kind string, role string, text string").repartition(4)
    got = {}
    for r in chat.fold(df).collect():
        got.setdefault(r["conv_id"], {})[r["turn"]] = (r["role"], r["text"])
    return got


@pytest.mark.parametrize("ties", [False, True])
def test_fold(spark, ties):
    import random

    rng = random.Random(9)
    events = []
    for conv in range(120):
        for seq in range(rng.randrange(1, 25)):
            kind = rng.choice(["message", "delta", "delta", "delta", "edit", "regenerate"] + [None] * ties)
            turn, role = rng.choice([0, 1, 2, 3, 4] + [None] * ties), rng.choice(["user", "assistant"] + [None] * ties)
            place = rng.choice([seq // 3, seq // 3, None]) if ties else seq
            events.append((conv, place, turn, kind, role, rng.choice(["a", "bb", None, "<c"])))
            if ties and rng.random() < 0.3:
                events.append(rng.choice([e for e in events if e[0] == conv]))
    got = fold_of(spark, events)
    for conv in range(120):
        mine = [e for e in events if e[0] == conv]
        assert got.get(conv, {}) == folded(mine), mine
    assert fold_of(spark, events[:0] + [(1, 1, 1, "message", "user", "x")]) == {1: {1: ("user", "x")}}


def test_fold_of_repeats_and_equal_places(spark):
    said = fold_of(spark, [
        (1, 1, 1, "message", "user", "hello"), (1, 1, 1, "message", "user", "hello"),
        (2, 1, 1, "message", "user", "ask"), (2, 2, 2, "delta", "assistant", "yes "), (2, 2, 2, "delta", "assistant", "yes "),
        (3, 1, 1, "delta", "user", "A"), (3, 1, 1, "message", "user", "B"),
        (4, None, 1, "delta", "user", "b"), (4, 7, 1, "message", "user", "a"),
    ])
    assert said == {1: {1: ("user", "hello")}, 2: {1: ("user", "ask"), 2: ("assistant", "yes ")}, 3: {1: ("user", "B")}, 4: {1: ("user", "ab")}}


def test_main_paths_are_native(spark, small_dir):
    for name in ("op5_quality_ledger", "op6_chat"):
        df = QUERIES[name](spark, small_dir)
        plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
        assert not re.search("Python|Pandas|Arrow", plan), name
