"""The pipeline's stages against brute force, each on its own input."""

import collections

import corpus_pipeline
from reaction_norms.llm import common, mixing, packing, substrings, toxicity


def test_stages(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "passages", "mixing", "packing"]
    docs = common.documents(spark, sf)
    chain = toxicity.fit(docs, common.table(spark, sf, "labels"))
    kept = common.stored(corpus_pipeline.toxic(spark, docs, sf), "t")
    assert kept.columns == list(common.DOCUMENT)
    rows = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, t in rows.items() if chain.chances(t)[-1] < toxicity.THRESHOLD}

    from test_operators import brute_keepers, brute_repeats

    one = common.stored(corpus_pipeline.near_copies(spark, kept, sf), "t")
    assert one.columns == list(common.DOCUMENT)
    assert sorted(r.doc_id for r in one.collect()) == brute_keepers({r.doc_id: r.text for r in kept.collect()})

    cut = common.stored(corpus_pipeline.passages(spark, one, sf), "t")
    assert cut.columns == list(common.DOCUMENT)
    left = {r.doc_id: r.text for r in one.collect()}
    want = dict(zip(left, brute_repeats(left.values(), substrings.WINDOW)))
    got = {r.doc_id: r.text for r in cut.collect()}
    assert {i: len(t.split()) for i, t in got.items()} == {i: n - gone for i, (n, gone, _) in want.items()}
    assert all(got[i] == left[i] for i, (_, gone, _) in want.items() if not gone)

    mix = common.stored(corpus_pipeline.mixed(spark, cut, sf), "t")
    taken = collections.Counter()
    for r in mix.collect():
        taken[r.doc_id] += len(r.text.split())
    assert mix.columns == list(common.DOCUMENT) and dict(taken) == {r.doc_id: r.taken for r in mixing.mix(cut).collect() if r.taken}

    pieces = corpus_pipeline.packed(spark, mix, sf)
    n = pieces.agg({"length": "sum"}).first()[0]
    assert n == packing.encoded(mix).agg({"n": "sum"}).first()[0]
