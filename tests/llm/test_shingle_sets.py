"""Near-dedup on five-word shingles at similarity 0.8, against all pairs."""

import random

import numpy as np
from spanweave.llm import shingle_sets

SCHEMA = "doc_id long, text string, tag int"


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


def pairs_of(rows, similarity=0.8):
    sets = [(i, shingles(t)) for i, t in rows]
    return [(i, j) for x, (i, a) in enumerate(sets) for j, b in sets[x + 1 :] if a == b or len(a & b) >= similarity * len(a | b)]


def smallest(rows, pairs):
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs:
        p, q = sorted((find(i), find(j)))
        root[q] = p
    return {i: find(i) for i in root}


def corpus():
    """Copies with one to twelve of 400 words changed, chains of copies, a hot passage, texts of a few words, blanks."""
    r = random.Random(8)
    word = lambda: f"w{r.randrange(5000)}"
    rows, passage = [], [word() for _ in range(50)]
    for i in range(30):
        base = [word() for _ in range(400)]
        rows.append((10 * i, " ".join(base)))
        for k in range(1, 8):
            base = base if i % 3 else list(rows[-1][1].split())  # a chain at every third
            copy = list(base)
            for at in r.sample(range(400), r.randint(1, 12)):
                copy[at] = word()
            rows.append((10 * i + k, " ".join(copy)))
    rows += [(1000 + i, " ".join(passage + [word() for _ in range(r.randint(0, 60))])) for i in range(60)]
    return rows + [(2000, "one two"), (2001, "One  two"), (2002, "one"), (2003, None), (2004, " \t"), (2005, "a b c d e"), (2006, "a b c d e a b c d e a b c d e")]


def test_all_near_pairs_are_joined(spark):
    rows = corpus()
    expected = smallest(rows, pairs_of(rows))
    docs = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(3)
    assert {(r.doc_id, r.component_id) for r in shingle_sets.near_groups(docs).collect()} == set(expected.items())
    kept = shingle_sets.dedup(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(expected.values()))


def test_pipeline_stage_drops_copies_with_changed_words(spark, tmp_path):
    import corpus_pipeline

    rows = corpus()
    docs = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, str(tmp_path)).collect()}
    assert kept == set(smallest(rows, pairs_of(rows)).values())


def test_null_keys_and_nothing(spark):
    docs = spark.createDataFrame([(None, "x y z", 1), (5, "x y z", 1), (3, "x y z", 1), (3, "x y z", 1), (None, "x y z", 2), (None, None, None)], SCHEMA)
    assert sorted((r.doc_id or 0) for r in shingle_sets.dedup(docs).collect()) == [0, 0, 0, 3]
    assert shingle_sets.dedup(docs.where("false")).count() == 0 and shingle_sets.near_groups(docs.where("false")).count() == 0


def test_a_key_with_several_texts_loses_only_copies(spark):
    text = lambda x: " ".join(f"{x}{i}" for i in range(30))
    docs = spark.createDataFrame([(5, text("a"), 1), (5, text("b"), 2), (4, text("a"), 3), (5, text("a"), 4), (6, text("c"), 5)], SCHEMA)
    assert sorted((r.doc_id, r.text[0], r.tag) for r in shingle_sets.dedup(docs).collect()) == [(4, "a", 3), (5, "b", 2), (6, "c", 5)]


def test_clashing_columns_and_very_long_texts(spark):
    long = " ".join(f"w{i % 7001}" for i in range(60_000))
    names = ("sid", "_sid", "n", "fp", "k", "root", "first", "won", "key", "_r", "_c0")
    docs = spark.createDataFrame([(1, long, 0), (2, long + " end", 0), (3, long[:100], 0)], SCHEMA).selectExpr("*", *(f"tag + {i} as {n}" for i, n in enumerate(names)))
    kept = shingle_sets.dedup(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id, r.won) for r in kept.collect()) == [(1, 7), (3, 7)]


def test_radius_and_bands():
    """What the module says about misses: of pairs at 0.8, by the bands and by the radius."""
    assert (1 - shingle_sets.SIMILARITY**shingle_sets.ROWS) ** shingle_sets.BANDS < 0.0005
    r = np.random.default_rng(3)
    beyond, shared = 0, 0
    for _ in range(1500):
        both, a, b = (r.integers(0, 2**64, n, dtype=np.uint64) for n in (160, 20, 20))
        fps, keys = shingle_sets.sketches([np.unique(np.concatenate([both, x])) for x in (a, b)])
        beyond += (int(fps[0] ^ fps[1]) % 2**64).bit_count() > shingle_sets.radius(0.8)
        shared += bool((keys[0] == keys[1]).any())
    assert beyond <= 3 and shared >= 1495
