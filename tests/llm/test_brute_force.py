"""Operators against plain renderings of their definitions on small fixtures."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from phantomlake.llm import cleaning, decontaminate, license_scan, line_crf, near_dedup, packing, ppm, token_counts, token_files, url_filter
from phantomlake.llm.common import WordHashes, new_path, written
from phantomlake.llm.tokens import ChunkEncoder, default_tokenizer

from .conftest import prose

BYTES, WORD = default_tokenizer("byte_bpe_50k.json"), default_tokenizer("word_bpe_49k.json")
SPACES = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near_copy(text: str, edits: int, seed: int) -> str:
    rng = random.Random(seed)
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    base = [(k, prose(k, 60 + 30 * (k % 5))) for k in range(40)]
    copies = [(100 + k, near_copy(base[k % 6][1], k % 9, k)) for k in range(60)]
    return base + copies + [(200, ""), (201, "one two three"), (202, "One Two THREE"), (203, None)]


@pytest.mark.parametrize("most_bytes", [48_000_000, 20_000])
@pytest.mark.parametrize("path", [BYTES, WORD])
def test_chunks_encode_as_the_library(path, most_bytes):
    """Odd characters, white space and special strings, in many batches, with room for all chunks and for few."""
    encoder, rng = ChunkEncoder(path, most_bytes, joined=11), random.Random(7)
    parts = ["a", "Word", "IT'S", "12", "3.5", " ", "  ", "\n", "\t", " \n ", "é", "É", "ß", "Σ", "İ", "ſ", "ŉ", "Ĳ", "中文", "🙂", "́", "\x1c", "\x85", "\xa0", "\xad", "​", "\x00", "<|endoftext|>", "<|startoftext|>", "!?", "_", "²", "ª", "'ll", "'"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + [prose(3), ""]
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for a in range(0, len(texts), 300):
        some = pa.array(texts[a : a + 300], pa.large_string())
        ids, at = encoder.encode(some)
        assert [ids[x:y].tolist() for x, y in zip(at, at[1:], strict=False)] == want[a : a + 300]
        assert encoder.counts(some).tolist() == list(map(len, want[a : a + 300]))
        ids, at = encoder.encode(some, 7)
        assert [ids[x:y].tolist() for x, y in zip(at, at[1:], strict=False)] == [[*x, 7] for x in want[a : a + 300]]


def test_what_the_encoder_keeps_is_bounded():
    """Texts without spaces are one chunk each, and no two are alike: all but the last batch is forgotten."""
    encoder, rng = ChunkEncoder(BYTES, most_bytes=100_000), random.Random(3)
    for _ in range(20):
        texts = ["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(2000)) for _ in range(5)]
        ids, at = encoder.encode(pa.array(texts, pa.large_string()))
        assert [ids[x:y].tolist() for x, y in zip(at, at[1:], strict=False)] == [e.ids for e in encoder.tokenizer.encode_batch(texts)]
        assert encoder.held() < 100_000 + 5 * 2000 * (3 + 4 * 3) + 1000


def test_token_counts_use_the_cache(spark, make, rows):
    cache = new_path(spark, "cache")
    first = {r.doc_id: r.n_tokens for r in token_counts.token_counts(make(rows[:50]), BYTES, cache).collect()}
    size = spark.read.parquet(cache).count()
    again = {r.doc_id: r.n_tokens for r in token_counts.token_counts(make(rows[:50]), BYTES, cache).collect()}
    assert first == again and spark.read.parquet(cache).count() == size == len({t for _, t in rows[:50]})
    encoder = ChunkEncoder.of(BYTES).tokenizer
    got = token_counts.token_counts(make(rows), BYTES, cache).collect()
    texts = dict(rows)
    assert all(r.n_tokens == len(encoder.encode(texts[r.doc_id] or "").ids) and r.n_bytes == len((texts[r.doc_id] or "").encode()) for r in got)
    assert spark.read.parquet(cache).count() == len({t or "" for _, t in rows})


def test_packing_round_trip(spark, make, rows):
    rows = [*rows, (300, prose(9, 6000))]
    encoder = ChunkEncoder.of(BYTES).tokenizer
    ids = {i: np.array([*encoder.encode(t or "").ids, 0], "<u4") for i, t in rows}
    got = packing.pack(make(rows).repartition(5), BYTES, size=256, open_windows=4, group=2).collect()
    for i, x in ids.items():
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own[:-1])]).tolist() and sum(r.length for r in own) == len(x)
        assert all(zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(x) for r in own)
    windows: dict[int, list] = {}
    for r in got:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for w in windows.values():
        w.sort()
        assert [a for a, _ in w] == np.cumsum([0, *(n for _, n in w[:-1])]).tolist() and sum(n for _, n in w) <= 256
    assert len(windows) <= 1.1 * sum(map(len, ids.values())) / 256 + 1


def test_windows_by_the_rule():
    """Every piece against the rule read literally: the window it leaves least room in, else the fullest is filled by
    its head and emitted, and the tail is placed the same way."""
    rng = random.Random(8)
    windows, left = packing.Windows(100, 5, 0), {}
    for _ in range(2000):
        length = rng.randint(1, 99)
        parts, done = windows.place(length)
        assert sum(n for _, _, n in parts) == length
        for k, (w, at, n) in enumerate(parts):
            fits = [100 - used - (length if not k else length - parts[0][2]) for used in left.values()]
            best = min((x for x in fits if x >= 0), default=None)
            if best is not None:
                assert at == left[w] and 100 - at - n == best
            elif len(left) == 5:
                assert at == left[w] == max(left.values()) and n == 100 - at and len(parts) == 2
            else:
                assert at == 0 and w not in left
            left[w] = at + n
            if left[w] == 100:
                assert w in done
                del left[w]
        assert len(left) <= 5 and left == windows.open


def test_shards_round_trip(spark, make, rows):
    path = new_path(spark, "shards")
    manifest = written(token_files.write_shards(make(rows), path, WORD, shard_ids=2000, partitions=3), "manifest")
    encoder = ChunkEncoder.of(WORD).tokenizer
    texts, start = dict(rows), 0
    got = {r.doc_id: r for r in token_files.read_shards(spark, path, manifest).collect()}
    ids = {i: [*encoder.encode(texts[i] or "").ids, 1] for i in sorted(texts)}
    for i, x in ids.items():
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
        start += len(x)
    wanted = spark.createDataFrame([(i,) for i in [*ids, 9999, -5]], "doc_id long")
    found = {r.doc_id: r.ids for r in token_files.lookup(spark, path, manifest, wanted).collect()}
    assert found == ids


def test_equal_keys_over_several_shards(spark, make):
    """One id on many rows fills several shards and tasks: all of its records are found, null ids only read back."""
    rows = [(5, prose(k, 50)) for k in range(60)] + [(None, prose(k, 50)) for k in range(60, 90)] + [(k, prose(k, 50)) for k in range(3, 9)]
    path = new_path(spark, "shards")
    manifest = written(token_files.write_shards(make(rows).repartition(4), path, WORD, shard_ids=1500, partitions=6), "manifest")
    assert manifest.filter("min_key = 5").count() > 1
    encoder = ChunkEncoder.of(WORD).tokenizer
    want = Counter((i, *encoder.encode(t).ids, 1) for i, t in rows)
    found = Counter((r.doc_id, *r.ids) for r in token_files.lookup(spark, path, manifest, spark.createDataFrame([(k,) for k in range(20)], "doc_id long")).collect())
    assert found == Counter({x: n for x, n in want.items() if x[0] is not None})
    got = sorted(token_files.read_shards(spark, path, manifest).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == Counter({(x[0], zlib.crc32(np.array(x[1:], "<u4").tobytes())): n for x, n in want.items()})


def test_absent_keys_of_a_full_shard():
    keys = list(range(0, 3000, 3))
    shard = token_files.Shard.of(token_files.shard_bytes(keys, [np.array([k], "<u4").tobytes() for k in keys], 1))
    assert [[x.tolist() for x in shard.find(k)] for k in range(-50, 3050)] == [[[k]] if k in keys else [] for k in range(-50, 3050)]


def test_perfect_hash_has_no_gap():
    for n in (1, 2, 7, 1000):
        keys = np.random.default_rng(n).choice(10**9, n, replace=False).astype(np.int64)
        seeds, slots = token_files.perfect_hash(keys)
        assert sorted(slots.tolist()) == list(range(n)) and len(seeds) == -(-n // token_files.BUCKET)


def test_near_duplicates(spark, make, rows):
    sets = {}
    for i, t in rows:
        w = SPACES.findall((t or "").translate(AZ))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    comp = {i: i for i in sets}
    ids = sorted(sets)
    changed = True
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(comp[a], comp[b])
            changed |= comp[a] != low or comp[b] != low
            comp[a] = comp[b] = low
    # short blocks and lists, so that blocks and hubs are met on a small fixture
    for options in ({}, {"block": 4, "long_list": 6}):
        got = near_dedup.near_duplicates(make(rows), **options).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), comp[i], comp[i] == i) for i in sets}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance():
    rng = np.random.default_rng(2)
    for _ in range(40):
        item, text = rng.integers(0, 4, 6).astype(np.uint64), rng.integers(0, 4, 10).astype(np.uint64)
        want = min(edit_distance(item.tolist(), text[a:z].tolist()) for a in range(11) for z in range(a, 11))
        assert decontaminate.edit_distance(item, text) == want


def test_decontamination_finds_edited_items(spark, make):
    """Items with up to a tenth of their words edited are found, all of them; clean documents stay clean."""
    items = {k: " ".join(prose(1000 + k, 40).split()) for k in range(30)}
    docs = []
    for k, item in items.items():
        for n, edits in enumerate((0, 1, 3)):
            docs.append((10 * k + n, prose(2000 + k, 90) + "\n" + near_copy(item, edits, k).upper() + "\n" + prose(3000 + k, 90)))
    clean = [(5000 + k, prose(4000 + k, 300)) for k in range(40)]
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.find_items(make(docs + clean), bench).collect()}
    assert set(got) == {(i, i // 10) for i, _ in docs}
    assert all(got[i, i // 10] <= (0, 1, 3)[i % 10] for i, _ in docs)
    assert {r.doc_id for r in decontaminate.clean_documents(make(docs + clean), bench).collect()} == {i for i, _ in clean}


def words_edited(text: str, edits: int, rng: random.Random) -> str:
    """The text with so many words replaced, put in or taken out."""
    words = text.split()
    for _ in range(edits):
        at, kind = rng.randrange(len(words)), rng.randrange(3)
        words[at : at + (kind != 1)] = [f"new{rng.randrange(10**6)}"] * (kind != 2)
    return " ".join(words)


def test_lsh_recall_at_the_limit():
    """Items with a fifth of their words edited, under the limit of the exact check, all kinds of edits: what all windows
    would find by exact edit distance comes back for at least 0.95, and nothing else does."""
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(20 + 3 * (k % 13))) for k in range(100)]
    hashes = WordHashes()
    of = lambda t: hashes.of(decontaminate.words_of(t.encode()))
    lsh = decontaminate.Lsh(list(range(100)), [of(t) for t in texts], decontaminate.Settings())
    assert lsh.reached >= 0.99 and 0 < lsh.repetitions <= decontaminate.Settings().most_repetitions
    around = lambda: " ".join(f"x{rng.randrange(3000)}" for _ in range(30))
    docs = [f"{around()} {words_edited(t, len(t.split()) // 5, rng)} {around()}" for t in texts]
    found = [{x[0]: x[3] for x in xs} for xs in decontaminate.contaminated([x.encode() for x in docs], lsh, hashes)]
    want = [{k: e for k, t in enumerate(texts) if (e := decontaminate.edit_distance(of(t), of(x))) <= len(t.split()) // 5} for x in docs]
    assert all(k in want[k] for k in range(100))
    assert all(set(f) <= set(w) and all(f[k] >= w[k] for k in f) for f, w in zip(found, want, strict=True))
    assert sum(map(len, found)) >= 0.95 * sum(map(len, want))


def test_targeted_edits_leave_an_anchor():
    """The rarest words of an item are those edited: it is still found, whichever repetition does it."""
    rng = random.Random(6)
    common = [f"c{k}" for k in range(60)]
    texts = [" ".join([rng.choice(common) for _ in range(34)] + [f"r{k}a{j}" for j in range(6)]) for k in range(40)]
    hashes = WordHashes()
    lsh = decontaminate.Lsh(list(range(40)), [hashes.of(decontaminate.words_of(t.encode())) for t in texts], decontaminate.Settings())
    docs = [" ".join(f"x{rng.randrange(300)}" for _ in range(20)) + " " + " ".join("gone" if w.startswith("r") else w for w in t.split()) for t in texts]
    found = decontaminate.contaminated([x.encode() for x in docs], lsh, hashes)
    assert sum(any(x[0] == k and x[3] <= 6 for x in xs) for k, xs in enumerate(found)) >= 38


def test_short_items_stand_exactly(spark, make):
    items = [(1, "alpha beta gamma"), (2, "Alpha"), (3, "beta gamma delta epsilon"), (4, "!!!"), (5, "gamma, delta")]
    docs = [(1, "An ALPHA, beta gamma."), (2, "beta gamma delta"), (3, "alphabet"), (4, None), (5, "x beta"), (6, "gamma delta epsilon")]
    got = {(r.doc_id, r.item_id, r.start, r.edits) for r in decontaminate.find_items(make(docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 1, 1, 0), (1, 2, 1, 0), (2, 5, 1, 0), (6, 5, 0, 0)}


def test_all_windows_are_checked_where_recall_is_not_reached():
    hashes = WordHashes()
    items = [hashes.of([f"w{k}x{j}".encode() for j in range(30)]) for k in range(20)]
    lsh = decontaminate.Lsh(list(range(20)), items, decontaminate.Settings(bits=8, most_repetitions=2))
    assert lsh.repetitions == 0
    docs = [" ".join(f"w{k}x{j}" if j % 6 else "other" for j in range(30)).encode() for k in range(20)]
    assert [[x[0] for x in xs] for xs in decontaminate.contaminated(docs, lsh, hashes)] == [[k] for k in range(20)]


def test_quality_counts(spark, make, rows):
    rows = [*rows, (400, prose(5) + "\n" + prose(5)), (401, "### a b\n" * 30 + prose(6)), (402, "home | menu | about | x\n" + prose(7))]
    got = {r.doc_id: r for r in cleaning.quality_rules(make(rows)).collect()}
    for i, t in rows:
        t = t or ""
        w = SPACES.findall(t)
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        repeat = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines, seen, dup = t.split("\n"), set(), 0
        for x in lines:
            if SPACES.search(x):
                dup += x in seen
                seen.add(x)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(repeat))
        assert r.base_failed == (len(w) < 50 or 100 * len(repeat) > 50 * len(w)) and not (r.base_failed and r.kept)
    kept = {r.doc_id: r.text for r in cleaning.clean_documents(make(rows)).collect()}
    assert kept[402] == prose(7) and kept[1] == prose(1, 90) and 200 not in kept


def test_quality_line_rules():
    """One line for each rule on either side of its limit; the lines that fail are gone from the text."""
    words = lambda n: " ".join(f"w{k}" for k in range(n))
    bad = [
        "a # b * c $ d & e", "THIS IS ALL IN UPPER CASE", "no!! way?? oh!!", "one | two | three | four", "Mentions légales", "sign in", "zurück", "Tous droits réservés 2020.",
        "same same same same same same same same same same same", "and then came the river,", words(90) + " privacy policy and terms of use.",
    ]
    good = [words(300) + " a | b | c | d.", words(80) + " newsletter.", words(61) + ",", " ".join(["the", "of", "and"] * 400 + [f"x{k}" for k in range(120)]) + ".", "Short line\nAnother one", prose(2, 20000).replace("\n", " ") + " click here"]
    for line in bad:
        x = cleaning.judged(f"{prose(1)}\n{line}\n{prose(2)}".encode())
        assert (x.n_bad_lines, x.n_lost_words, x.clean.decode()) == (1, len(line.split()), f"{prose(1)}\n{prose(2)}"), line
    for line in good:
        assert cleaning.judged(f"{prose(1)}\n{line}\n{prose(2)}".encode()).n_bad_lines == 0, line[:80]
    listing = "First entry\nSecond entry\n\nThird entry"
    x = cleaning.judged(f"{prose(1)}\n{listing}\n{prose(2)}\n{listing.upper()}".encode())
    assert (x.n_bad_lines, x.clean.decode()) == (6, f"{prose(1)}\n\n{prose(2)}\n")


def test_ppm_is_a_distribution(spark, make, rows):
    """Base scores against the definition; the model's next-symbol probabilities add up to one in any context."""
    got = {r.doc_id: r for r in ppm.score(make(rows), order=3).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    tokens = {i: SPACES.findall((t or "").translate(AZ)) + [None] for i, t in rows}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert abs(r.base_score - sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws)) < 1e-6
    rare = {r.doc_id: r.base_score for r in ppm.score(make(rows), order=3, frequent=5).collect()}
    assert all(abs(rare[i] - got[i].base_score) < 1e-6 for i in rare)
    texts = [(t or "").encode() for i, t in rows if not held[i]]
    gram = ppm.grams_of(texts, 3)[0]
    for most in (10**9, 60):
        grams, counts = [], []
        for k in range(4):
            u, m = np.unique(gram & ((1 << (8 * (k + 1))) - 1), return_counts=True)
            least = np.sort(m)[-most] if len(m) > most else 1
            grams.append(u[m >= least])
            counts.append(m[m >= least])
        scorer = ppm.Scorer(ppm.Trie(3, grams, counts))
        for context in (b"\xff\xff\xff", b"the", b"qqq", b"ing", b"\xc3\xa9 "):
            code = int.from_bytes(context, "big") << 8
            assert abs((10 ** scorer.log10(code + np.arange(256))).sum() - 1) < 1e-9
    assert abs(got[1].score - sum(_ppm_bits(gram, prose(1, 90)))) < 1e-6


def _ppm_bits(train, text, order=3):
    """log10 of each symbol's probability, from sets and counts of the contexts alone."""
    tables = [{} for _ in range(order + 1)]
    for g in train.tolist():
        for k in range(order + 1):
            x = g & ((1 << (8 * (k + 1))) - 1)
            t = tables[k].setdefault(x >> 8, Counter())
            t[x & 255] += 1
    data = b"\xff" * order + text.translate(AZ).encode() + b"\xff"
    for at in range(order, len(data)):
        p, out = 0.0, set()
        for k in range(order, -1, -1):
            t = tables[k].get(int.from_bytes(data[at - k : at], "big"))
            if t is None:
                continue
            left = {s: c for s, c in t.items() if s not in out}
            total = sum(left.values()) + len(left)
            if data[at] in left:
                p += np.log10(left[data[at]] / total)
                break
            if left:
                p += np.log10(len(left) / total)
            out |= set(t)
        else:
            p -= np.log10(256 - len(out))
        yield p


def test_crf_marginals_match_enumeration():
    rng = np.random.default_rng(1)
    model = line_crf.LineCrf(rng.normal(size=line_crf.N_FEATURES), rng.normal(size=2), rng.normal(size=(2, 2)))
    sizes = np.array([3, 1, 4])
    x = rng.normal(size=(8, line_crf.N_FEATURES)) * 0.3
    got, pairs = model.marginals(x, sizes, pairs=True)
    want, both, at = [], np.zeros((2, 2)), 0
    for n in sizes:
        emit = x[at : at + n] @ model.weights
        total, good, joint = 0.0, np.zeros(n), np.zeros((2, 2))
        for code in range(2**n):
            y = [(code >> k) & 1 for k in range(n)]
            w = np.exp(model.start[y[0]] + sum(emit[k] * y[k] for k in range(n)) + sum(model.change[y[k], y[k + 1]] for k in range(n - 1)))
            total += w
            good += w * np.array(y)
            for k in range(n - 1):
                joint[y[k], y[k + 1]] += w
        want += (good / total).tolist()
        both += joint / total
        at += n
    assert np.allclose(got, want) and np.allclose(pairs, both)


def test_crf_learns(spark, make):
    """Held-out accuracy on prose against shouting, symbols and repetition."""
    bad = lambda k: "\n".join([prose(k).upper().replace(" ", "!! "), prose(k).replace(" ", "### "), "buy now " * 40][k % 3].split("\n"))
    rows = [(k, bad(k) if k % 4 == 0 else prose(k)) for k in range(240)]
    labels = spark.createDataFrame([(k, int(k % 4 != 0)) for k in range(240)], "doc_id long, quality int")
    got = line_crf.classify(make(rows), line_crf.fit(make(rows), labels)).filter("held_out").collect()
    assert len(got) > 30 and sum(r.predicted == (r.doc_id % 4 != 0) for r in got) >= 0.97 * len(got)


def test_license_base_and_rules(spark, make):
    texts = {
        1: "This work is licensed under the GNU General Public License, version 3.",
        2: "Released under the MIT License. MIT license, Apache License!",
        3: "SPDX-License-Identifier: Apache-2.0",
        4: "Licensed under CC BY-NC 4.0 and nothing else",
        5: "the license of the apache", 6: None,
    }
    got = {r.doc_id: r for r in license_scan.scan_licenses(make(list(texts.items()))).collect()}
    for i, t in texts.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(AZ))
        places = [(k, label) for phrase, label in license_scan.PHRASES for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(places)) and r.base_labels == ",".join(sorted({x for _, x in places}))
        assert (r.first_word, r.last_word) == (min((k for k, _ in places), default=None), max((k for k, _ in places), default=None))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert got[1].labels == "gpl,gpl-3" and got[3].labels == "apache-2.0" and got[4].labels == "cc-by,cc-by-nc-4.0" and got[5].labels == ""
    assert len(license_scan.all_rules()) > 300


def test_contained_detections_are_suppressed():
    rule = lambda label, pattern, priority: license_scan.Rule(label, b"x", pattern, priority, 0.5)
    scanner = license_scan.Scanner([rule("weak", "x y z", 2), rule("strong", "w x y z", 1), rule("apart", "x", 3)])
    assert [(r.label) for _, _, r in scanner.detections(b" w x y z x ")] == ["strong", "apart"]


def test_suppression_by_definition():
    """Random overlapping detections against the rule read literally: by priority, then length, then place."""
    rng = random.Random(11)
    patterns = [" ".join(rng.choice("xyz") for _ in range(rng.randint(1, 4))) for _ in range(25)]
    rules = [license_scan.Rule(f"r{k}", b"", p, rng.randrange(4), 0.5) for k, p in enumerate(patterns)]
    scanner = license_scan.Scanner(rules)
    for _ in range(200):
        text = (" " + " ".join(rng.choice("xyzw") for _ in range(rng.randint(1, 40))) + " ").encode()
        found = [(m.start(), m.end(), r) for r in rules for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )".encode(), text)]
        kept = []
        for a, z, r in sorted(found, key=lambda x: (x[2].priority, x[0] - x[1], x[0], x[2].label)):
            if not any(p <= a and z <= q for p, q, _ in kept):
                kept.append((a, z, r))
        assert scanner.detections(text) == sorted(kept, key=lambda x: x[:2])


def example(pattern):
    """A text that the pattern of a rule fits: first alternatives, everything optional present."""
    text = re.sub(r"\(\?![^()]*\)", "", pattern.replace(license_scan._ANY, "acme "))
    while (shorter := re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)\??", r"\1", text)) != text:
        text = shorter
    return re.sub(r"\[(.)[^\]]*\]", r"\1", text).replace("?", "")


def test_every_license_clause_finds_its_text():
    """Each clause is found where it stands, within other words, and not without its first or last word."""
    rules, scanner = license_scan.clause_rules(), license_scan.Scanner()
    assert len(rules) > 150 and len({r.pattern for r in rules}) == len(rules)
    for rule in rules:
        words = example(rule.pattern)
        text = f"Some words. {words}, and more of it".encode().upper()
        assert rule.keyword.decode() in words and len(rule.keyword) >= 8, rule
        assert rule.label in scanner.scan(text)[5].split(","), rule
        alone = license_scan.Scanner([rule])
        assert [alone.scan(text)[7]] + [alone.scan(x.encode())[7] for x in (words, words.split(" ", 1)[1], words.rsplit(" ", 1)[0], " ".join(words.split()[::-1]))] == [1, 1, 0, 0, 0], rule


def test_license_keywords_are_all_found():
    """The gate by words lets through every keyword that a text holds."""
    scanner, rng = license_scan.Scanner(), random.Random(8)
    keys = sorted(scanner.by_keyword)
    for _ in range(300):
        text = b" " + b" ".join(rng.choice([k, k[1:], k[:-1], b"x" + k + b"y", k.replace(b" ", b"  "), b"of the"]) for k in rng.sample(keys, 3)) + b" "
        assert sorted(scanner.held(text)) == [k for k in keys if k in text]


def test_license_clauses_outrank_names():
    scan = license_scan.Scanner().scan
    notice = "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    assert scan(notice.encode())[5] == "lgpl-2.1"
    assert scan(b"This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at x.")[5] == "mpl-2.0"
    assert scan(b"the software is good and shall be used by all; you may charge a fee for copies of this package")[5] == ""


def test_url_counts_hits_at_boundaries():
    automaton = url_filter.UrlPolicy(strict=("xxx",), soft=("free", "bets", "free-bets2")).automaton()
    assert url_filter.counted("http://free-bets.com/xxxx?xxx", automaton)[:3] == (1, 2, 2)
    assert url_filter.counted("freebets/free/free", automaton)[:3] == (0, 2, 1)


def test_url_terms_weigh_differently(spark):
    """Each distinct term counts once with its own weight; ordinary words do not block by twos."""
    assert len(url_filter.STRICT) + len(url_filter.SOFT) > 150 and not set(url_filter.STRICT) & set(url_filter.SOFT) and not set(url_filter.HEAVY) & set(url_filter.ORDINARY)
    urls = {
        "http://a.b/free-download": ("allow", 0.8), "http://a.b/free/free/free": ("allow", 0.4), "http://a.b/free-hot-download": ("block", 1.2),
        "http://casino-win.b/": ("block", 1.0), "http://casino.b/casino": ("allow", 0.6), "http://casino.b/poker": ("block", 1.2), "http://a.b/viagra": ("block", 1.0),
        "http://a.b/hotel/freedom/downloads": ("allow", 0.0), "http://a.b/sexe-gratuit": ("block", 1.0), "http://a.b/gratis/kredit": ("allow", 0.8),
    }
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert {r.page_id: (r.verdict, r.weight) for r in url_filter.judge_urls(pages).collect()} == dict(enumerate(urls.values()))
    own = spark.createDataFrame([("Tea", False, 0.3), ("tea", False, 0.7), ("milk", False, 0.3), ("rum", False, None), ("gin", False, 2.0), ("ale", True, 0.1), ("rye", False, float("nan"))], "term string, strict boolean, weight double")
    policy = url_filter.policy_of(own)
    assert (policy.strict, policy.soft, policy.weights) == (("ale", "gin"), ("milk", "rum", "rye", "tea"), (("milk", 30), ("tea", 70)))
    assert [url_filter.counted(x, policy.automaton())[3] for x in ("tea/milk", "tea", "rum/rye", "ale", "milk-rum")] == [100, 70, 100, 100, 80]


def test_url_sql_counts_as_the_automaton(spark, tmp_path):
    import duckdb

    rng = random.Random(5)
    bits = ["free", "adult-x", "adult", "win", "casino", "x", "-", "/", "|", "é", "?", "FREE", "paris-sportifs", "://", "org"]
    pages = spark.createDataFrame([(k, "".join(rng.choices(bits, k=rng.randrange(12)))) for k in range(300)], "page_id long, url string")
    pages.write.parquet(str(tmp_path / "pages"))
    db = duckdb.connect()
    db.sql(f"create view pages as select * from '{tmp_path}/pages/*.parquet'")
    got = sorted(tuple(r) for r in url_filter.judge_urls(spark.read.parquet(str(tmp_path / "pages"))).collect())
    assert got == sorted(db.sql(url_filter.oracle_sql()).fetchall()) and {r[4] for r in got} == {"allow", "block"}


def test_url_policy_from_tables(spark):
    terms = spark.createDataFrame([("Bad-Thing", True), ("soft", False), ("bad-thing", False), (None, True), ("", True), ("meh", None)], "term string, strict boolean")
    rules = spark.createDataFrame([("net/", "block", 2), ("net/", "allow", 1), ("x.net/a", "nothing", 0)], "rule string, action string, rank int")
    policy = url_filter.policy_of(terms, rules)
    assert (policy.strict, policy.soft, policy.rules) == (("bad-thing",), ("meh", "soft"), (("net/", "allow"), ("net/", "block")))
    pages = spark.createDataFrame([(1, "http://a.net/bad-thing"), (2, "http://a.com/BAD-thing"), (3, "http://a.com/soft/meh"), (4, "http://a.com/soft"), (5, "http://a.com/" + "soft-" * 50_000)], "page_id long, url string")
    got = {r.page_id: (r.verdict, r.rule) for r in url_filter.judge_urls(pages, policy).collect()}
    assert got == {1: ("allow", "net/"), 2: ("block", None), 3: ("block", None), 4: ("allow", None), 5: ("allow", None)}
    assert url_filter.judge_urls(pages.limit(0), policy).count() == 0
    with pytest.raises(ValueError):
        url_filter.policy_of(terms, most=2)


def test_crf_takes_one_bounded_row_of_an_id(spark, make):
    """Repeated rows of a sampled id and very many lines leave the fit as it is without them."""
    rows = [(k, prose(k, 120) if k % 3 else "BUY ### NOW!!\n" * 12) for k in range(60)]
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(60)], "doc_id long, quality int")
    one = line_crf.fit(make(rows), labels)
    many = line_crf.fit(make(rows + rows[:1] * 400), labels)
    assert np.allclose(one.weights, many.weights) and np.allclose(one.change, many.change)
    short = line_crf.fit(make([(k, t + "\n" + "tail line here.\n" * 3000) for k, t in rows]), labels, sample_lines=7)
    assert np.isfinite(short.weights).all()
