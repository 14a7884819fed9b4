"""Each operator against brute force on small fixtures, and on its edge cases."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reaction_norms.llm import common, html, mixing, packing, quality, rules, sharding, simhash, substrings, toxicity, winnowing
from reaction_norms.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["a"] * len(texts))[i], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return common.documents(spark, sf)


@pytest.fixture(scope="module")
def table(docs):
    return docs.toPandas()


@pytest.fixture(scope="module")
def edge(spark):
    """Null and empty texts, a null id, white space only, a long text, repeated rows, clashing columns."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [
        (0, None, None, None, None), (1, "", "en", "a", 0), (2, " \n\t ", "en", "a", 4), (3, long, "en", "b", len(long)),
        (3, long, "en", "b", len(long)), (4, "one two", "en", None, 7), (None, "one two three four five six", "en", "b", 27),
        (5, "One  two\nthree four five six", "en", "a", 27), (None, None, None, "b", None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("c", "tag", "h", "bucket", "words", "text_crc32", "size", "start", "fp", "n_words", "block", "_t", "_w"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def labels(spark, sf):
    return common.table(spark, sf, "labels")


def operators(labels):
    return {
        "pack": packing.pack,
        "toxicity": lambda d: toxicity.scored(d, toxicity.fit(d, labels)),
        "without_toxic": lambda d: toxicity.without_toxic(d, toxicity.fit(d, labels)),
        "quality": lambda d: quality.scored(d, quality.fit(d, labels)),
        "rules": rules.judged,
        "substrings": substrings.dedup,
        "without_repeats": substrings.without_repeats,
        "simhash": simhash.near_duplicates,
        "keep_one": simhash.keep_one,
        "sharding": sharding.ring_shards,
        "mixing": mixing.mix,
        "mixed_documents": mixing.mixed_documents,
        "winnowing": winnowing.edit_trial,
    }


PER_ROW = {"toxicity", "quality", "rules", "substrings", "simhash", "sharding", "mixing", "winnowing"}


@pytest.mark.parametrize("name", sorted(operators(None)))
def test_edge_cases_and_empty_table(spark, edge, labels, name):
    op = operators(labels)[name]
    n = len(op(edge).collect())
    if name in PER_ROW:
        assert n == 9
    elif name == "keep_one":
        # ids 0, 1, 2 and the null id share fingerprint 0; both long rows, and both of six words, are copies
        assert n == 4
    assert op(spark.createDataFrame([], SCHEMA)).count() == 0


def test_html_edge_cases(spark):
    rows = [(1, None, None), (2, "http://h/x", ""), (3, "http://h/y", "<p>one<p>two &amp; three"), (3, "http://h/y", "<p>one<p>two &amp; three"), (None, "bad url", "<div" * 3000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("path", F.lit(1))
    got = collections.Counter((r.page_id, r.text) for r in html.extract(df).collect())
    assert got[(1, "")] == 1 and got[(2, "")] == 1 and got[(3, "one two & three")] == 2 and sum(got.values()) == 5
    assert html.extract(df.limit(0)).count() == 0


def test_packing_round_trip(spark, docs, table):
    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: [*full.encode(t or "", add_special_tokens=False).ids, 0] for i, t in zip(table.doc_id, table.text)}
    rows = sorted(packing.pack(docs, 256).collect(), key=lambda r: (r.sequence_id, r.offset))
    got, at = collections.defaultdict(list), 0
    for r in rows:
        assert r.sequence_id * 256 + r.offset == at and r.doc_tokens == len(want[r.doc_id]) and r.start == len(got[r.doc_id])
        got[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
        at += r.length
    assert got == want


def test_special_tokens_and_white_space_are_encoded_as_the_tokenizer_does():
    code = packing.coder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for text in ("a <|endoftext|> b", "x  y\n \nz ", "\x00　\x85'sé 12!!", ""):
        assert np.frombuffer(code.encode(text), "<u2").tolist() == code.full.encode(text, add_special_tokens=False).ids


def test_long_runs_of_white_space_are_packed(spark):
    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["x" + " " * 2_000_000 + "y", "\n" * 1_200_000, "plain"]
    got = collections.defaultdict(list)
    for r in sorted(packing.pack(frame(spark, texts)).collect(), key=lambda r: (r.doc_id, r.start)):
        got[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
    assert dict(got) == {i: [*full.encode(t, add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = common.documents(spark, sf), common.table(spark, sf, "labels")
    learn = labels.filter(F.col("doc_id") % 4 != 0)
    got = toxicity.scored(docs, toxicity.fit(docs, learn)).join(labels.filter(F.col("doc_id") % 4 == 0), "doc_id").groupBy("toxic", "rejected").count().collect()
    n = {(r.toxic, r.rejected): r["count"] for r in got}
    assert n.get((0, True), 0) <= 0.03 * n[0, False] and n[1, True] >= 2 * n.get((1, False), 0)


def test_chain_feeds_earlier_chances():
    w = {"one": np.array([2.0, -1.0]), "two": np.array([0.0, 3.0, -1.0])}
    chain = toxicity.Chain({"bad": 0}, w)
    a, b = chain.chances("So BAD")
    assert a == pytest.approx(1 / (1 + np.exp(-1.0))) and b == pytest.approx(1 / (1 + np.exp(-(3 * a - 1))))


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = common.documents(spark, sf), common.table(spark, sf, "labels")
    got = quality.op3_quality(spark, sf).filter("held_out").join(labels, "doc_id")
    right, n = got.agg(F.sum((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert right >= 0.95 * n
    assert docs.count() == quality.op3_quality(spark, sf).count()


def test_dual_descent_meets_its_optimum():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3))
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=60) > 0, 1, -1)
    rows, cost = [np.arange(3)] * 60, np.full(60, 0.5)
    w = quality.dual_descent(rows, list(x), y, 3, cost, epochs=400)
    loss = lambda v: 0.5 * v @ v + (cost * np.maximum(0, 1 - y * (x @ v))).sum()
    assert all(loss(w) <= loss(w + 0.05 * rng.normal(size=3)) + 1e-3 for _ in range(200))


def test_rule_counts(docs, table):
    text = dict(zip(table.doc_id, table.text))
    for r in rules.judged(docs).collect():
        t = text[r.doc_id] or ""
        w = WORD.findall(t)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = collections.Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)
        )
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.base_failed and r.kept)


def test_rules_agree_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    both = rules.judged(common.documents(spark, sf)).filter("not base_failed").join(common.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("good")), "doc_id")
    assert both.filter("good = 1 and not kept").count() == 0
    assert both.filter("good = 0 and kept").count() <= 0.1 * both.filter("good = 0").count()


def brute_repeats(texts, window):
    words = [WORD.findall(t or "") for t in texts]
    n = collections.Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if n[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("window", [35, 7])
def test_substrings(docs, table, window):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.dedup(docs, window).collect()}
    assert got == dict(zip(table.doc_id, brute_repeats(table.text, window)))


def test_substrings_of_frequent_words(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["a", "b"], 60)) for _ in range(150)] + ["x y " * 400] * 3 + ["x y " * 300 + "z"]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.dedup(frame(spark, texts), 6).collect()}
    assert got == dict(enumerate(brute_repeats(texts, 6)))
    kept = {r.doc_id: r.text for r in substrings.without_repeats(frame(spark, ["a b c d e f g q", "p a b c d e f g", "alone  here"]), 6).collect()}
    assert kept == {0: "q", 1: "p", 2: "alone  here"}


def test_cut_documents_keep_their_own_columns(spark):
    """Copies whose texts, spaces or other columns differ, whole repeated rows, short and null texts."""
    texts = ["a b c d e f g  q", "p a b c d e f g", "t u  v w x y", " t u v w x y", " t u v w x y", None, "", "few  words", "few words", "k  l m n o p q", None]
    ids = [0, 1, 2, 3, 3, 5, 6, 7, 8, 9, 10]
    rows = [(i, t, None if i % 2 else f"l{i}", "s", 1000 + i, "extra") for i, t in zip(ids, texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, copies string")
    got = collections.Counter(tuple(r) for r in substrings.without_repeats(df, 6).collect())
    cut = {0: "q", 1: "p", 2: "", 3: ""}
    assert got == collections.Counter((i, cut.get(i, t), lang, source, len(cut[i]) if i in cut else n) for i, t, lang, source, n, _ in rows)
    assert substrings.without_repeats(df.limit(0), 6).count() == 0


def brute_maximal_repeats(texts, window):
    """Per text the places where maximal repeats of ``window`` words or more begin and end."""
    words = [t.split() for t in texts]
    places = collections.defaultdict(list)
    for t, w in enumerate(words):
        for i in range(len(w) - window + 1):
            for j in range(i + window, len(w) + 1):
                places[tuple(w[i:j])].append((t, i, j))
    found = [(set(), set(), []) for _ in texts]
    for at in places.values():
        left = {words[t][i - 1] if i else (t, i) for t, i, _ in at}
        right = {words[t][j] if j < len(words[t]) else (t, j) for t, _, j in at}
        if len(at) > 1 and len(left) > 1 and len(right) > 1:
            for t, i, j in at:
                found[t][0].add(i), found[t][1].add(j), found[t][2].append(j - i)
    return found


def test_maximal_repeats(spark):
    rng = np.random.default_rng(4)
    long = [f"p{i}" for i in range(60)]
    texts = [" ".join([*rng.choice(["a", "b", "c"], 30), *long[k : k + 55], *rng.choice(["a", "b"], 20)]) for k in (0, 3, 5, 0)]
    texts += ["x y " * 20, " ".join(long[:50]), " ".join(long[:50]), " ".join(rng.choice(["a", "b"], 40)), "few words"]
    for window in (6, 35):
        want = brute_maximal_repeats(texts, window)
        assert max(n for *_, sizes in want for n in sizes) > 45
        for r in substrings.dedup(frame(spark, texts), window).collect():
            assert (set(r.opens), set(r.closes)) == want[r.doc_id][:2], (window, r.doc_id)


def test_ends_of_maximal_repeats_of_windows_that_overfill_a_bin(spark):
    texts = [f"u{i} a b c d e f g v{i}" for i in range(700)] + [f"u{i} a b c d e f h{i}" for i in range(5)]
    got = {r.doc_id: r for r in substrings.dedup(frame(spark, texts), 6).collect()}
    assert all((got[i].opens, got[i].closes, got[i].n_removed) == ([1], [7, 8], 7) for i in range(5, 700))
    assert all((got[i].opens, got[i].closes, got[i].n_removed) == ([0, 1], [7, 8], 8) for i in range(5))
    assert all((got[i].opens, got[i].closes, got[i].n_removed) == ([0, 1], [7], 7) for i in range(700, 705))


def test_no_table_name_is_left_behind(spark):
    substrings.dedup(frame(spark, ["a b c d e f g"] * 2), 6).collect()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("llm_")]


def brute_fingerprint(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, table):
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    f = {i: brute_fingerprint(t) for i, t in zip(table.doc_id, table.text)}
    root = {i: i for i in f}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in f:
        for b in f:
            if a < b and (f[a] ^ f[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert got == {i: (f[i], find(i)) for i in f}


def linked_places(near, n):
    """The least place of each place's component, from near(i): the places linked to i."""
    label = np.arange(n)
    for i in range(n):
        for j in near(i):
            a, b = label[i], label[j]
            if a != b:
                label[label == max(a, b)] = min(a, b)
    return label


def brute_keepers(texts):
    """The least id of each group of texts whose fingerprints are linked, from ids to texts."""
    ids = sorted(texts)
    f = np.array([brute_fingerprint(texts[i]) for i in ids], np.uint64)
    label = linked_places(lambda i: np.flatnonzero(np.bitwise_count(f ^ f[i]) <= simhash.MAX_BITS), len(ids))
    return [ids[k] for k in sorted(set(label.tolist()))]


def test_keep_one_keeps_the_least_document_of_each_component(docs, table):
    got = simhash.keep_one(docs)
    assert got.columns == list(common.DOCUMENT)
    assert sorted(r.doc_id for r in got.collect()) == brute_keepers(dict(zip(table.doc_id, table.text)))


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")


def test_a_large_group_of_near_copies_is_joined_without_broadcasts(spark):
    rng = np.random.default_rng(4)
    base = [f"w{x}" for x in rng.integers(0, 3000, 400)]
    texts = []
    for i in range(3000):
        words = list(base)
        words[int(rng.integers(0, 400))] = f"e{i}"
        texts.append(" ".join(words))
    texts += [" ".join(f"{c}{x}" for x in rng.integers(0, 3000, 50)) for c in "pqr"]
    got = simhash.keep_one(frame(spark, texts))
    kept = sorted(r.doc_id for r in got.collect())
    assert kept == brute_keepers(dict(enumerate(texts))) and broadcasts(got) == 0


def test_keep_one_keeps_a_row_of_each_component_whatever_its_ids(spark):
    text = [" ".join(f"{c}{i}" for i in range(20)) for c in "pqrst"]
    rows = [(None, text[0]), (None, text[1]), (None, text[1]), (7, text[2]), (None, text[2]), (9, text[3]), (9, text[4])]
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.text) for r in simhash.keep_one(df).collect()), key=lambda x: x[1])
    assert got == [(None, text[0]), (None, text[1]), (7, text[2]), (9, text[3]), (9, text[4])]


def test_tiles_and_masks_lose_no_link(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 1, dtype=np.uint64)[0]
    near = {int(base) ^ sum(1 << int(b) for b in rng.choice(64, 3, replace=False)) for _ in range(3000)}
    far = {int(x) for x in rng.integers(0, 1 << 63, 500, dtype=np.uint64)}
    fps = sorted(near | far)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    got = {r.node % (1 << 64): r.root for r in components(simhash.links(df)).collect()}
    u = np.array(fps, np.uint64)
    label = np.arange(len(u))
    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u ^ u[i]) <= 4):
            a, b = label[i], label[j]
            if a != b:
                label[label == max(a, b)] = min(a, b)
    groups = collections.Counter(label.tolist())
    assert len(got) == sum(n - 1 for n in groups.values())
    assert len(set(got.values())) == sum(n > 1 for n in groups.values())


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[i] == 100 for i in range(101, 130))


def test_sharding(docs, table):
    rows = sharding.ring_shards(docs).collect()
    text = {i: (t or "").encode() for i, t in zip(table.doc_id, table.text)}
    assert {(r.doc_id, r.size, r.text_crc32) for r in rows} == {(i, len(t) + 1, zlib.crc32(t)) for i, t in text.items()}
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(8)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    home = {r.doc_id: r.shard for r in sharding.ring_shards(docs, slack=0.25).collect()}
    more = {r.doc_id: r.shard for r in sharding.ring_shards(docs, shards=9, slack=0.25).collect()}
    assert sum(home[i] != more[i] for i in home) < 0.5 * len(home)


def test_spread_continues_clockwise():
    placed = sharding.spread({0: 5, 1: 1, 2: 0}, [0, 1, 2], [2, 2, 2])
    assert placed == [(0, 0, 2, 0, 0), (1, 0, 1, 1, 0), (0, 2, 3, 1, 1), (0, 3, 5, 2, 0)]


def test_mixing(spark, docs, table):
    rows = mixing.mix(docs).toPandas()
    words = {i: len(WORD.findall(t or "")) for i, t in zip(table.doc_id, table.text)}
    assert dict(zip(rows.doc_id, rows["size"])) == words and (rows.taken <= 2 * rows["size"]).all()
    rows["source"] = rows.doc_id.map(dict(zip(table.doc_id, table.source)))
    by = rows.groupby("source").agg(n=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(by.index))}
    full = set()
    while True:
        left = 1.5 * by.n.sum() - sum(2 * by.n[s] for s in full)
        share = left / sum(w for s, w in weight.items() if s not in full)
        new = {s for s in weight if s not in full and share * weight[s] > 2 * by.n[s]}
        if not new:
            break
        full |= new
    for s in weight:
        assert by.target[s] == pytest.approx(2 * by.n[s] if s in full else share * weight[s])
        assert abs(by.taken[s] - by.target[s]) <= 2 * mixing.BLOCK
    again = mixing.mix(docs.repartition(5)).toPandas()
    assert dict(zip(again.doc_id, again.taken)) == dict(zip(rows.doc_id, rows.taken))
    made = mixing.mixed_documents(docs).toPandas()
    got = made.text.map(lambda t: len(WORD.findall(t))).groupby(made.doc_id).sum()
    want = rows[rows.taken > 0].set_index("doc_id").taken
    assert got.sort_index().to_dict() == want.sort_index().to_dict()


def test_small_sources_meet_their_targets(spark):
    n = {"a": 20, "b": 150, "c": 40_000, "d": 5, None: 300}
    docs = frame(spark, [" ".join([s or "null"] * k) for s, k in n.items()], list(n))
    rows = mixing.mix(docs).toPandas()
    assert dict(zip(rows.doc_id, rows["size"])) == dict(enumerate(n.values()))
    assert (rows.target[rows["size"] < 1000] == 2 * rows["size"][rows["size"] < 1000]).all()
    assert (abs(rows.taken - rows.target) <= 0.02 * rows.target).all()
    made = mixing.mixed_documents(docs).toPandas()
    assert made.text.map(lambda t: len(t.split())).groupby(made.doc_id).sum().to_dict() == dict(zip(rows.doc_id, rows.taken))
    # a target below the limit: b and c have equal shares of what the smallest source leaves
    rows = mixing.mix(frame(spark, ["x " * 150, "y " * 150, "z " * 150], ["a", "b", "c"])).toPandas()
    assert (rows.target < 300).any() and (abs(rows.taken - rows.target) <= 0.1 * rows.target).all()


def test_permutation(spark):
    for n in (1, 2, 97, 1000):
        df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(11)).alias("x"))
        assert sorted(r.x for r in df.collect()) == list(range(n))


def test_winnowing(docs, table):
    rng = np.random.default_rng(2)
    for _ in range(60):
        text = "".join(rng.choice(list("ab"), int(rng.integers(0, 200))))
        h = winnowing.gram_hashes(text, 3)
        want = []
        for s in range(max(0, len(h) - min(5, len(h)) + 1) if len(h) else 0):
            part = h[s : s + 5] >> np.uint64(24)
            at = s + max(i for i in range(len(part)) if part[i] == part.min())
            if not want or want[-1] != at:
                want.append(at)
        assert winnowing.winnow(text, 3, 5)[0].tolist() == want
    order = table.sort_values("doc_id").reset_index(drop=True)
    got = {r.doc_id: r for r in winnowing.edit_trial(docs).collect()}
    for i, (doc, text) in enumerate(zip(order.doc_id, order.text)):
        q, after = len(text) // 4, order.text[(i + 1) % len(order)]
        new = text[: len(text) - q] + after[:q]
        assert (got[doc].n_chars, got[doc].edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert got[doc].near_next == pytest.approx(winnowing.likeness(winnowing.winnow(text)[1], winnowing.winnow(after)[1]))
    by_text = collections.defaultdict(set)
    for doc, text in zip(order.doc_id, order.text):
        by_text[text].add(got[doc].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())


def test_an_id_of_many_rows_is_split_and_its_copies_kept(spark):
    rng = np.random.default_rng(5)
    rows = [(None if i % 3 else i, " ".join(rng.choice(["ab", "cd", "ef", "gh"], 12)) if i % 6 else "same text for all of these rows", "en", "a", 0) for i in range(1500)]
    rows += [(None, "a copy of a row", "en", "a", 0)] * 400
    df = spark.createDataFrame(rows, SCHEMA)
    sizes = sorted(r["count"] for r in winnowing.with_next(df, 16).groupBy("bucket").count().collect())
    assert sizes[-1] <= 3 * sizes[len(sizes) // 2]
    got = winnowing.edit_trial(df, buckets=16).collect()
    assert len(got) == len(rows)
    # every text takes part once as a text and once as the next one
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert collections.Counter((r.doc_id, r.n_chars) for r in got) == collections.Counter((r[0], len(r[1])) for r in order)
    known = {r.doc_id: r for r in got if r.doc_id is not None}
    after = [r for r in order if r[0] is not None]
    for (i, text, *_), (_, following, *_) in zip(after, after[1:]):
        assert known[i].edited_sha256 == hashlib.sha256(winnowing.edited(text, following).encode()).hexdigest()
    copies = [r for r in got if r.doc_id is None and r.n_chars == 15]
    itself = hashlib.sha256(winnowing.edited("a copy of a row", "a copy of a row").encode()).hexdigest()
    assert sum(r.edited_sha256 == itself and r.near_next == 1 for r in copies) == 399


def test_likeness_follows_from_the_columns(docs):
    for r in winnowing.edit_trial(docs).limit(50).collect():
        a, b = ({s[i : i + 10] for i in range(0, len(s), 10)} for s in (r.fingerprint, r.edited_fingerprint))
        assert len(r.fingerprint) == 10 * len(r.positions) and r.near_edited == pytest.approx(len(a & b) / len(a | b))


def test_shared_passages_are_found():
    a, b = "x" * 50 + "the quick brown fox jumps over the lazy dog again and again" * 2, "the quick brown fox jumps over the lazy dog again and again" * 2 + "yz"
    assert set(winnowing.winnow(a)[1]) & set(winnowing.winnow(b)[1])


def test_html(spark, sf):
    page = """<html><body class="x"><header>Site</header><div id="nav-bar"><a>m</a></div><div class="cookie-notice">c</div>
    <div class="post12 content"><h1>T&amp;x</h1><p>Foo <b>ba</b>r<br>q<p>Next &nbsp; one<ul><li>a<li>b</ul><div class="comments"><p>bad</p></div>
    <form>f</form></div><script>if(a<b){"</p>"}</script><aside>s</aside><footer>foot</footer>"""
    df = spark.createDataFrame([(1, "http://U@h.example:80/a", page), (2, "http://h.example/b", page.replace("post12", "post7"))], "page_id long, url string, html string")
    assert {(r.host, r.text) for r in html.extract(df).collect()} == {("h.example", "T&x Foo bar q Next one a b")}
    pages = common.table(spark, sf, "pages").toPandas().set_index("page_id")
    for r in html.op10_html(spark, sf).collect():
        body = pages.html[r.page_id].split("<article>")[1].split("</article>")[0].split("<footer")[0]
        body = re.sub(r"</?(p|br|h1|b)>", lambda m: "" if m[1] == "b" else " ", body)
        import html as entities

        assert r.text == " ".join(entities.unescape(body).split()) and r.n_chars == len(r.text)


def test_an_odd_page_keeps_its_article_against_the_host(spark):
    good = "<body><div class='c'><p>" + "good words here " * 30 + "</p></div><div class='d'><p>few</p></div></body>"
    odd = "<body><div class='c'><p>short</p></div><div class='d'><p>" + "other words here " * 30 + "</p></div></body>"
    df = spark.createDataFrame([(i, "http://h/", good) for i in range(3)] + [(9, "http://h/", odd)], "page_id long, url string, html string")
    assert ("other words here " * 30).strip() in {r.page_id: r.text for r in html.extract(df).collect()}[9]


def test_html_keeps_title_and_lead_beside_the_body():
    body = "<div class='body'>" + "<p>" + "long text here " * 30 + "</p></div>"
    for inner in (body, "<ul><li>" + "one item here " * 40 + "</ul>", "<section><p>" + "text again " * 40 + "</p></section>"):
        page = f"<body><div><a href='/'>home page</a></div><article><h1>title</h1><p>lead</p>{inner}</article></body>"
        assert html.best_path(html.blocks(page))[0] == ">body>article"
        assert html.best_path(html.blocks(page.replace("article>", "div>")))[0] in (">body>div", ">body")


def test_a_page_of_another_template_keeps_its_article(spark):
    long = "other words here " * 30
    good = "<body><div class='c'><p>" + "good words here " * 30 + "</p></div><div class='d'><a href='/'>some links</a></div></body>"
    odd = f"<body><div class='c'><p><a href='/'>short teaser</a> more</p></div><div class='d'><p>{long}</p></div></body>"
    extra = good.replace("</body>", "<div class='e'><p>stray</p></div></body>")
    rows = [(i, "http://h/", good) for i in range(3)] + [(8, "http://h/", extra), (9, "http://h/", odd)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert long.strip() in got[9] and got[8] == got[0] == ("good words here " * 30).strip()


@pytest.mark.parametrize("name", ["layout has-sidebar", "post with-comments", "article-body ad-free", "legal-news", "page-layout no-sidebar"])
def test_html_names_that_only_speak_of_others_stay(name):
    assert [b[1] for b in html.blocks(f"<body><div class='{name}'><p>the text</p></div><div class='{name}'><p>more</p></div></body>")] == ["the text", "more"]


def test_html_spares_what_holds_the_article_and_reads_attributes_by_name():
    kept = lambda page: [b[1] for b in html.blocks(page)]
    assert kept("<body><div class='sidebar'><article><p>the text</p></article></div></body>") == ["the text"]
    assert kept("<body><div class='notice'><p>nearly all of the text</p></div><p>few</p></body>") == ["nearly all of the text", "few"]
    # an article elsewhere: comments and menus go, whatever they hold
    assert kept("<body><article>a</article><div class='comments-area'><article>one comment of many words</article></div><div id='nav-bar'>m</div></body>") == ["a"]
    assert kept("<p title='a hidden gem'>one</p><p data-id='nav-1' data-class=\"ad\">two</p><p hidden>three</p><p title=\"it's\" class='ad'>x</p>") == ["one", "two"]
    assert kept("<body><p>a <span class='ad'>b</span> c</p></body>") == ["a", "c"]


@pytest.mark.parametrize(
    "name",
    "disqus_thread comment-thread advert-300x250 ad-leaderboard nav-primary menu-main sidebar-primary related-stories share-this social-media cookie-law-info promo-card subscribe-now site-notice notice-bar".split(),
)
def test_html_drops_by_any_part_of_a_name(name):
    page = "<body><article><p>the whole text</p><div class='%s'><p>more</p></div><p>its end</p></article></body>"
    for marked in (page % name, page.replace("class", "id") % name):
        assert [b[1] for b in html.blocks(marked)] == ["the whole text", "its end"]


@pytest.mark.parametrize("name", "widget-content text-legal press-notice legal-news content-has-sidebar ad-free article-body".split())
def test_html_keeps_text_under_names_of_other_things(name):
    assert [b[1] for b in html.blocks(f"<body><article><p>the whole text</p><div class='{name}'><p>more</p></div></article></body>")] == ["the whole text", "more"]


def test_consensus_reaches_the_least_voted_path_of_a_host_and_changes_a_page(spark):
    """Twelve templates on one host; a page whose own best is a container within takes the host's path around it."""
    page = lambda k, inner: f"<body><div class='t{'abcdefghijklm'[k]}'>{inner}</div></body>"
    text = "<p>" + "plain words of the page " * 20 + "</p>"
    rows = [(100 * k + i, "http://h/", page(k, f"<div class='in'>{text}</div><p>a last line of text</p>")) for k in range(13) for i in range(13 - k)]
    rows.append((5000, "http://h/", page(12, f"<div class='in'>{text}</div>")))
    own = html.best_path(html.blocks(rows[-1][2]))[0]
    got = {r.page_id: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i].text.endswith("a last line of text") for i, *_ in rows[:-1]) and got[5000].text == ("plain words of the page " * 20).strip()
    assert got[5000].path != own and got[5000].path == got[1200].path
