"""The pipeline stage by stage, each held against what its operator says of its input."""

import zlib
from collections import Counter

import corpus_pipeline
from test_simhash import components, slow_print
from waybill.llm import mixing, string_kernel, subword
from waybill.llm.common import held_out, stored, table


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns, before, seen = docs.columns, docs, {}
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, before, sf_dir), "test")
        seen[name] = (before.toPandas(), after.toPandas())
        before = after
    names = [n for n, _ in corpus_pipeline.STAGES]
    for name in names[:-1]:
        assert list(seen[name][1].columns) == columns
        into, out = seen[name]
        assert set(out.doc_id) <= set(into.doc_id)
        texts = dict(zip(into.doc_id, into.text))
        assert all(texts[i] == t for i, t in zip(out.doc_id, out.text))

    labels = table(spark, sf_dir, "labels").toPandas().set_index("doc_id").quality
    into, out = seen["quality classifier"]
    model = subword.train(docs.filter(~held_out("doc_id", 4, 2)), table(spark, sf_dir, "labels"))
    odds, bias = model.folded()
    good = subword.Features.of([(t or "").encode() for t in into.text]).means(odds) + bias >= 0.8472978603872037
    assert set(out.doc_id) == set(into.doc_id[good])
    held = [i for i in labels.index if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((i in set(out.doc_id)) == bool(labels[i]) for i in held) > 0.95 * len(held)

    into, out = seen["language ID"]
    lost = into[~into.doc_id.isin(out.doc_id)]
    assert len(lost) <= 0.01 * len(into)  # clean texts stay
    assert not any(string_kernel.has_letter((t or "").encode()) for t in lost.text) or len(lost) < 10

    into, out = seen["SimHash near-dedup"]
    into = into.sort_values("doc_id")
    group = components([slow_print(t) for t in into.text], 2)
    assert sorted(out.doc_id) == sorted({into.doc_id.iloc[g] for g in group})

    into, out = seen["mixing sources to target weights"]
    size = {i: len((t or "").encode().split()) for i, t in zip(into.doc_id, into.text)}
    source = dict(zip(into.doc_id, into.source))
    sizes = Counter()
    for i, n in size.items():
        sizes[source[i]] += n
    order = sorted(sizes)
    want = mixing.targets({s: sizes[s] for s in order}, mixing.cyclic_weights(order), sum(sizes.values()))
    taken = Counter()
    for i in out.doc_id:
        taken[source[i]] += size[i]
    assert all(abs(taken[s] - want[s]) <= max(30, 0.02 * want[s]) for s in order)
    assert max(Counter(out.doc_id).values()) <= 3

    into, out = seen["BPE encoding and decoding"]
    assert Counter(into.doc_id) == Counter(out.doc_id)


def test_empty_and_odd_tables(spark, edge_docs, no_docs, sf_dir):
    for docs in (edge_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            n = out.count()
            assert docs is not no_docs or n == 0, name
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns


def test_run_is_the_stages(spark, small_dir):
    a = sorted(map(tuple, corpus_pipeline.run(spark, small_dir).collect()))
    assert a and len({r[0] for r in a}) <= spark.read.parquet(f"{small_dir}/documents.parquet").count()
