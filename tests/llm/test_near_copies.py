"""Near copies against the similarity of all pairs."""

import numpy as np

import corpus_pipeline
from quadrat.llm import graph, near_copies, simhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def brute_groups(texts):
    ids = sorted(texts)
    sets = []
    for i in ids:
        w = (texts[i] or "").encode().lower().split()
        sets.append({b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    pairs = [(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets[:i]) if 5 * len(x & y) >= 4 * len(x | y)]
    a, b = np.array(pairs, np.int64).reshape(-1, 2).T
    return {i: ids[k] for i, k in zip(ids, graph.local_components(len(ids), a, b).tolist())}


def changed_copies(seed, count, words):
    """Copies of one text with some words changed, so that similarities lie on both sides of 0.8."""
    rng = np.random.default_rng(seed)
    first = [f"s{seed}w{i}" for i in range(words)]
    for _ in range(count):
        copy = list(first)
        for at in rng.integers(0, words, rng.integers(0, max(2, words // 20))):
            copy[at] = f"x{rng.integers(1 << 40)}"
        yield " ".join(copy[: words - int(rng.integers(0, words // 6 + 1))])


def test_groups_equal_brute_force(spark, table):
    texts = {r.doc_id: r.text for r in table("documents").select("doc_id", "text").collect()}
    more = ["", None, " ", "One", "one", "a b c", "a b c d e", *changed_copies(1, 90, 150), *changed_copies(2, 40, 30), *changed_copies(3, 12, 2000)]
    texts |= {10_000 + k: t for k, t in enumerate(more)}
    df = spark.createDataFrame(list(texts.items()), "k bigint, text string")
    got = {r.k: r.component_id for r in near_copies.near_copy_groups(df, "k").collect()}
    assert got == brute_groups(texts)
    assert near_copies.near_copy_groups(df.limit(0), "k").count() == 0


def test_stage_goes_by_similarity(spark):
    """A copy at similarity 0.86 goes although the fingerprints are 6 bits apart; a text at 0.69 stays."""
    base = [f"w{i}" for i in range(204)]
    near = base[:20] + ["n1"] + base[21:100] + ["n2"] + base[101:160] + ["n3"] + base[161:]
    far = [f"f{i}" if i % 27 == 13 else w for i, w in enumerate(base)]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far))]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    assert brute_groups(dict(rows)) == {1: 1, 2: 1, 3: 3}
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()) == [1, 3]


def test_stage_links_by_simhash_first(spark, monkeypatch):
    """Close copies are linked by their fingerprints, so the prefixes have no pair left to check."""
    base = [f"w{i}" for i in range(600)]
    texts = {1: " ".join(base), 2: " ".join([*base[:300], "new", *base[301:]]), 3: " ".join(f"v{i}" for i in range(300))}
    apart = (simhash.fingerprint(texts[1]) ^ simhash.fingerprint(texts[2])) & (1 << 64) - 1
    assert 0 < apart.bit_count() <= simhash.THRESHOLD
    checked = []
    whole = near_copies.verified

    def verified(rows, key, text, nodes, pairs):
        checked.append(pairs.count())
        return whole(rows, key, text, nodes, pairs)

    monkeypatch.setattr(near_copies, "verified", verified)
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()) == [1, 3]
    assert checked == [1, 0]


def with_passage(spark, count, shared, own):
    """Texts that have one passage in common, each with words of its own."""
    passage = [f"p{i}" for i in range(shared)]
    rows = [(k, " ".join([*passage, *[f"o{k}w{i}" for i in range(own)]])) for k in range(count)]
    return spark.createDataFrame(rows, "k bigint, text string")


def test_pairs_of_a_long_passage_are_named_once(spark, monkeypatch):
    """Texts too unlike to be linked meet in dozens of shingles of a passage, yet each pair leaves about once."""
    df = with_passage(spark, 20, 600, 100)
    made = []
    whole = near_copies.candidates

    def candidates(*args):
        made.append(whole(*args).count())
        return whole(*args)

    monkeypatch.setattr(near_copies, "candidates", candidates)
    assert all(r.k == r.component_id for r in near_copies.near_copy_groups(df, "k").collect())
    assert 0 < sum(made) <= 2 * 190


def test_passages_that_the_sample_misses_move_last(spark):
    """A passage that no sampled text shows is found by the counts of the prefixes and leaves them."""
    df = with_passage(spark, 20, 60, 200)
    nothing = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    nodes = near_copies.marks(df, "k", "text", nothing).withColumnRenamed("key", "node")
    first = {r.node: r.prefix for r in nodes.collect()}
    settled = {r.node: r.prefix for r in near_copies.settled_prefixes(df, "k", "text", nodes, nothing).collect()}
    assert {k: len(p) for k, p in settled.items()} == {k: len(p) for k, p in first.items()}
    before, after = (len(set.intersection(*map(set, each.values()))) for each in (first, settled))
    assert before >= 5 and 2 * after <= before


def test_long_texts_with_a_passage_in_common_are_not_paired(spark, monkeypatch):
    """Sketches as long as the texts need rule out pairs that only share a passage, so none is made of them."""
    made = []
    whole = near_copies.candidates

    def candidates(*args):
        made.append(whole(*args).count())
        return whole(*args)

    monkeypatch.setattr(near_copies, "candidates", candidates)
    for shared, own in ((760, 180), (4500, 900)):
        df = with_passage(spark, 12, shared, own)
        assert all(r.k == r.component_id for r in near_copies.near_copy_groups(df, "k").collect())
    assert made and not any(made)


def test_tables_go_when_nothing_reads_them(spark, monkeypatch):
    """When pairs are looked for, the tables with prefixes are gone, and none with texts or sets stays at the end."""
    tables = []
    whole, pairs = near_copies.written, near_copies.fingerprint_pairs

    def written(df, *more):
        tables.append(whole(df, *more))
        return tables[-1]

    def left():
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        places = [(t, jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(t.inputFiles()[0]))) for t in tables]
        return {c for t, place in places if place.getFileSystem(conf).exists(place) for c in t.columns}

    def fingerprint_pairs(*args):
        assert "sketch" in left() and "prefix" not in left() and "place" in left()
        return pairs(*args)

    monkeypatch.setattr(near_copies, "written", written)
    monkeypatch.setattr(near_copies, "fingerprint_pairs", fingerprint_pairs)
    df = spark.createDataFrame(list(enumerate(changed_copies(4, 30, 200))), "k bigint, text string")
    got = {r.k: r.component_id for r in near_copies.near_copy_groups(df, "k").collect()}
    assert got == brute_groups({r.k: r.text for r in df.collect()})
    assert "set" not in left() and "digest" in left()
