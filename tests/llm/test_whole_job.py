"""Where an operator once did less than the whole job: each test fails on a cut of rows, counts or copies."""

import random
import zlib

import numpy as np
import pytest

from phantomlake.llm import near_dedup, packing, ppm
from phantomlake.llm.tokens import ChunkEncoder

from .conftest import prose
from .test_brute_force import BYTES, _ppm_bits


def edited(doc: int, edits: int) -> str:
    """204 words (200 shingles) of a document of its own; each edit changes 5 shingles."""
    return " ".join(f"d{doc}e{k}" if k in range(10, 10 + 20 * edits, 20) else f"d{doc}w{k}" for k in range(204))


def test_pipeline_drops_near_copies_from_080(spark, make):
    """The stage against brute force, with pairs at 0.905, 0.818 and 0.778."""
    import corpus_pipeline

    rows = [(2 * d, edited(d, 0)) for d in range(60)] + [(2 * d + 1, edited(d, (2, 4, 5)[d % 3])) for d in range(60)]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(200)} for i, t in rows}
    similar = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    want = {i for i in sets if i % 2 == 0 or not similar(sets[i - 1], sets[i])}
    assert len(want) == 80
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, make(rows), "").collect()} == want


def test_signature_misses_stay_under_the_stated_rate():
    for threshold in (70, 80, 85, 95):
        for coords in (near_dedup.COORDS, 256):
            m = near_dedup.least_matches(threshold, coords)
            assert near_dedup.missed(threshold, coords, m) <= near_dedup.MISS < near_dedup.missed(threshold, coords, m + 1)


def test_ppm_scores_with_all_counts(spark, make):
    """Scores against the definition over all counts, however few grams are broadcast and in how many buckets."""
    rows = [(k, prose(k, 40) + " é%" * (k % 3)) for k in range(30)] + [(100, ""), (101, "QQzx never seen 中"), (None, prose(3, 20))]
    whole = {r.doc_id: r for r in ppm.score(make(rows), order=3).collect()}
    held = {i: whole[i].held_out for i, _ in rows}
    train = ppm.grams_of([t.encode() for i, t in rows if not held[i]], 3)[0]
    want = {i: sum(_ppm_bits(train, t)) for i, t in rows}
    assert any(held.values())
    for options in ({}, {"max_grams": 50, "bucket_grams": 100}, {"max_grams": 0}):
        got = {r.doc_id: r.score for r in ppm.score(make(rows), order=3, **options).collect()}
        assert got.keys() == want.keys() and np.allclose([got[i] for i in want], list(want.values()), atol=1e-6, rtol=0)
    for order in (0, 1, 2):
        a, b = ({r.doc_id: r.score for r in ppm.score(make(rows), order=order, max_grams=m).collect()} for m in (10, 10**6))
        assert np.allclose([a[i] for i in want], [b[i] for i in want])


def test_packing_leaves_one_sequence_open(spark, make):
    """Documents a little over half a window, over partitions and rounds: all sequences but one end full."""
    rows = [(k, prose(k, 30 + k % 7)) for k in range(200)]
    encoder = ChunkEncoder.of(BYTES).tokenizer
    ids = {i: np.array([*encoder.encode(t).ids, 0], "<u4") for i, t in rows}
    size = max(map(len, ids.values())) * 3 // 2
    assert np.mean([size / 2 < len(x) < size for x in ids.values()]) > 0.5
    got = packing.pack(make(rows).repartition(9), BYTES, size=size, open_windows=3, group=2).collect()
    for i, x in ids.items():
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own[:-1])]).tolist() and sum(r.length for r in own) == len(x)
        assert all(zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(x) for r in own)
    windows: dict[int, list] = {}
    for r in got:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for w in windows.values():
        w.sort()
        assert [a for a, _ in w] == np.cumsum([0, *(n for _, n in w[:-1])]).tolist()
    assert len(windows) == -(-sum(map(len, ids.values())) // size)


@pytest.mark.parametrize("percent", [85, 86, 88])
def test_links_just_above_the_threshold_are_found(spark, make, percent):
    """Real near copies: pairs whose shared shingles are exactly `percent` in 100 of the union, in texts of their own."""
    rows = []
    for k in range(60):
        rng = random.Random(1000 * percent + k)
        words = [f"w{rng.randrange(10**9)}" for _ in range(104)]  # 100 shingles
        # words put in place of the last ones change one shingle each: 100 - c are shared, of 100 + c
        c = (100 * (100 - percent)) // (100 + percent)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[: 104 - c] + [f"x{rng.randrange(10**9)}" for _ in range(c)]))]
        assert 100 * (100 - c) >= percent * (100 + c)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(make(rows), threshold=85).collect()}
    assert all(got[2 * k + 1] == 2 * k for k in range(60))


def test_many_texts_without_words(spark, make):
    """They link with nothing, and no join brings them together."""
    rows = [(k, None if k % 2 else " \n") for k in range(500)] + [(600, "a b c d e f"), (601, "A B C D E F"), (None, "a b c d e f")]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(make(rows)).collect()}
    assert all(got[k] == (0, k, True) for k in range(500)) and got[600] == (2, 600, True) and got[601] == (2, 600, False) and got[None] == (2, None, True)


@pytest.mark.parametrize("order", [5, 6])
def test_ppm_at_production_order_with_crowded_endings(spark, make, order):
    """Most contexts end alike; they are dealt by more of their bytes, and scores stay those of the definition."""
    rng = random.Random(order)
    rows = [(k, " ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) + "ing" for _ in range(30))) for k in range(25)] + [(100, prose(1, 30)), (101, ""), (102, "é ing")]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    train = ppm.grams_of([t.encode() for i, t in rows if not held[i]], order)[0]
    want = {i: sum(_ppm_bits(train, t, order)) for i, t in rows}
    for bucket in (200_000, 60, 10):
        got = {r.doc_id: r.score for r in ppm.score(make(rows), order=order, max_grams=0, bucket_grams=bucket).collect()}
        assert np.allclose([got[i] for i in want], list(want.values()), atol=1e-6, rtol=0)


def test_a_crowded_ending_is_split(spark):
    """One ending with ten times the bound: no group of grams that must stay together is larger than it."""
    grams = spark.range(2000).selectExpr("(id % 400) * 4294967296 + 7 * 16777216 + 97 * 65536 + 98 * 256 + id div 400 as gram", "1L as n", "1L as seen")
    grams = grams.unionByName(spark.range(50).selectExpr("id * 256 + 5 as gram", "1L as n", "1L as seen"))
    dealt, more = ppm.dealt_by_ending(grams, 5, 200)
    groups = {}
    for r in dealt.collect():
        key = (r.length, (r.gram >> 8) & ((1 << (8 * r.length)) - 1))
        groups.setdefault(key, []).append(r.bucket)
    assert sum(map(len, groups.values())) == 2050 and max(map(len, groups.values())) <= 200 and all(len(set(b)) == 1 for b in groups.values())
    assert {r.level for r in more.collect()} == {2, 3} and all(r.n == 400 for r in more.collect())


def test_contexts_that_do_not_fit_are_refused(spark, make):
    with pytest.raises(ValueError, match="contexts of 7 bytes"):
        ppm.score(make([(1, "a")]), order=7)
