"""Repair, prefix trie and personal data against plain renderings of their definitions."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from phantomlake.llm import conversation_repair as cr
from phantomlake.llm import pii, prefix_trie
from phantomlake.llm.queries import queries

TABLE = "conv_id long, turn long, role string, text string, step int, plan string, digest string"
NONE = hashlib.sha256(b"").hexdigest()


@pytest.fixture
def talk(spark):
    """Conversations with columns whose names clash with what operators add."""
    return lambda rows: spark.createDataFrame([(*r, 1, "p", "d") for r in rows], TABLE)


def damage(rows):
    out = []
    for c, t, role, text in rows:
        part = lambda x: " " if x is None else x
        code = zlib.crc32(f"{part(c)}:{part(t)}".encode()) % 20
        role, text = part(role), part(text)
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        role = "user" if code == 4 else role
        out += [(c, t, role, text)] * (2 if code == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))


def by_conversation(rows):
    found = defaultdict(list)
    for r in rows:
        found[r[0]].append(r)
    return found


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        shown = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest_by_trying(rows):
    """The least (cost, audit) over every way to edit every row, with at most one insertion at each place."""
    marks, best = faults(rows), None
    spots = [[(), ("user",), ("assistant",)] for _ in range(len(rows) + 1)]
    options = [[("D", None)] + ([] if m in ("blank", "duplicate") else [("K", r[2]), ("R", "user"), ("R", "assistant")]) for r, m in zip(rows, marks, strict=True)]
    for edits in itertools.product(*options):
        for extra in itertools.product(*spots):
            audit, roles, cost = "", "", 0
            for k in range(len(rows) + 1):
                for role in extra[k]:
                    audit, roles, cost = audit + "I", roles + role[0], cost + 3
                if k < len(rows):
                    letter, role = edits[k]
                    audit, roles = audit + letter, roles + ("" if role is None else role[:1] or "-")
                    cost += {"D": 4, "K": 0, "R": 3}[letter] + 3 * (letter != "D" and marks[k] == "truncated")
            if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def repaired_by_hand(rows, audit):
    out, at, state = [], 0, ""
    for letter in audit:
        follows = "assistant" if state[-1:] == "u" else "user"
        if letter == "I":
            out.append((follows, ""))
        else:
            _, _, role, text = rows[at]
            at += 1
            if letter == "D":
                continue
            out.append((role if letter == "K" else follows, text))
        state += out[-1][0][0]
    assert at == len(rows)
    return out


def test_cheapest_edits():
    rng = random.Random(5)
    texts = {"-": " ", "s": "a.", "u": "a.", "a": "a.", "x": "a.", "S": "a", "U": "a", "A": "a", "X": "a"}
    roles = {"s": "system", "u": "user", "a": "assistant", "x": "tool", "-": "user"}
    for _ in range(150):
        rows = "".join(rng.choice("--suaxSUAX") for _ in range(rng.randint(0, 4)))
        made = [(1, k, roles[x.lower()], f"{k}{texts[x]}" if x != "-" else " ") for k, x in enumerate(rows)]
        assert cr.cheapest(rows) == cheapest_by_trying(made), rows
    long = "".join(rng.choice("--suaxSUAX") for _ in range(3000))
    cost, audit = cr.cheapest(long)
    assert len(audit.replace("I", "")) == 3000 and cost == sum(4 * (x == "D") + 3 * (x in "RI") for x in audit) + 3 * sum(r.isupper() for r, x in zip(long, audit.replace("I", ""), strict=True) if x != "D")


def talks(n, seed, most=5):
    rng = random.Random(seed)
    words = ["Yes.", "No!", "Why?", "half", " ", "", "One. Two", "\t\n", "Ünd."]
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, most)):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]), rng.choice([*words, None])))
    return rows


def expected_repairs(rows):
    out, damaged = {}, by_conversation(damage(rows))
    for c in {r[0] for r in rows}:
        mine = damaged[c]
        marks, turns = faults(mine), [r[1] for r in mine if r[1] is not None]
        initials = [r[2][:1] for r in mine]
        cost, audit = cheapest_by_trying(mine)
        text = "\n".join(f"{role}:{x}" for role, x in repaired_by_hand(mine, audit))
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(marks.count(x) for x in ("blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def test_repairs(spark, talk):
    rows = [*talks(120, 1, 4), (None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."), (None, None, None, None)]
    damaged, present = cr.damaged(talk(rows))
    got = {r.conv_id: tuple(r)[2:] for r in cr.repair_report(damaged, present).repartition(3).collect()}
    assert got == expected_repairs(rows)
    undamaged = talk([(1, 0, "user", "A."), (1, 1, "user", "B"), (1, 1, "user", "B"), (1, None, "system", "S.")])
    left = [tuple(r) for r in cr.repaired(undamaged).orderBy("position").collect()]
    assert left == [(1, 0, "K", "system", "S."), (1, 1, "K", "user", "A."), (1, 2, "R", "assistant", "B")]
    assert cr.repair_report(talk([])).count() == 0 and cr.repaired(talk([])).count() == 0


def test_conversations_whose_rows_are_all_gone(spark, talk):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    damaged, present = cr.damaged(talk([(gone, 0, "user", "Hi.")]))
    assert [tuple(r)[1:] for r in cr.repair_report(damaged, present).collect()] == [(0, 0, 0, 0, 0, 0, 0, "", NONE)]


def test_a_long_conversation(spark, talk):
    rows = [(7, k, "user" if k % 2 == 0 else "assistant", f"text {k} " + "x" * 3000 + ".") for k in range(4000)]
    got = cr.repair_report(talk(rows)).collect()[0]
    text = "\n".join(f"{r[2]}:{r[3]}" for r in rows)
    assert (got.cost, got.audit, got.repaired_sha256) == (0, "K" * 4000, hashlib.sha256(text.encode()).hexdigest())


def expected_nodes(rows, rebuild=True):
    rows = [(c, t, r or "", x or "") for c, t, r, x in rows if c is not None]
    digest = lambda r: hashlib.sha256(f"{len(r[2].encode())}:{r[2]}{r[3]}".encode()).digest()[:16]
    own = {c: [(r[2], r[3]) for r in sorted(v, key=lambda r: (r[1] is not None, r[1] or 0, r[2], digest(r)))] for c, v in by_conversation(rows).items()}
    talks = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if rebuild else 0
        talks[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in talks.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = sum(saved[x] for x in children[node]) + (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
    out = []
    for node, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(talks[c]) == len(node))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def shared_talks(n, seed):
    """Conversations of few different turns, so that many share their beginnings and many are copies."""
    rng = random.Random(seed)
    return [(c, t if t or rng.random() < 0.8 else None, rng.choice(["user", "assistant", None]), rng.choice(["Hi.", "Ho é.", "", None]) if t < 2 or rng.random() < 0.3 else f"{rng.randrange(4)}") for c in range(n) for t in range(rng.randint(1, 7))]


@pytest.mark.parametrize("shard", [1, 2, 7, 50_000])
def test_trie(spark, talk, shard):
    rows = [*shared_talks(150, 3), (None, 0, "user", "Hi."), (1000, None, None, None), *((2000 + k, t, "user", f"deep {min(t, 150 + k)}") for k in range(2) for t in range(200))]
    lists = prefix_trie.turn_lists(talk(rows))
    got = prefix_trie.trie(prefix_trie.rebuilt(lists), shard=shard).collect()
    assert sorted((tuple(r) for r in got), key=repr) == expected_nodes(rows)
    got = prefix_trie.trie(lists, shard=shard).collect()
    assert sorted((tuple(r) for r in got), key=repr) == expected_nodes(rows, rebuild=False)


def test_trie_of_copies(spark, talk):
    """One conversation of most ids is divided among shards; its ids are hashed in order."""
    rows = [(c, t, "user", f"{t}") for c in range(300) for t in range(2)] + [(1000, 0, "user", "0")]
    got = prefix_trie.trie(prefix_trie.turn_lists(talk(rows)), shard=16).collect()
    assert sorted((tuple(r) for r in got), key=repr) == expected_nodes(rows, rebuild=False)
    assert prefix_trie.conversation_trie(talk([])).count() == 0 and prefix_trie.conversation_trie(talk([(None, 1, "user", "a")])).count() == 0


def test_closing_parentheses():
    rng = random.Random(2)
    for n in (1, 2, 31, 32, 33, 500, 3000):
        for deep in (0.5, 0.9):
            bits, depth, left = [], 0, n
            while left or depth:
                if left and (not depth or rng.random() < deep):
                    bits, depth, left = [*bits, 1], depth + 1, left - 1
                else:
                    bits, depth = [*bits, 0], depth - 1
            stack, want = [], {}
            for k, b in enumerate(bits):
                if b:
                    stack.append(k)
                else:
                    want[stack.pop()] = k
            brackets = prefix_trie.Parentheses(np.array(bits, np.uint8))
            assert brackets.find_close().tolist() == [want[k] for k in brackets.opens.tolist()]


# ---- personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_base(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            twice = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
            good = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else 0, "card": 14 <= len(digits) <= 19 and sum(x // 10 + x % 10 for x in twice) % 10 == 0, "phone": 10 <= len(digits) <= 15}
            if good[kind]:
                out.append((m.start(), rank, m.end()))
    return sorted(out)


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(4)
    parts = ["a", "Z9", "@", "@b.c", ".", "..", "-", " ", "+", "+1", "(", ")", "12", "255", "256", "1.2.3.4", "007", "4111 1111 1111 1111", "4111111111111111", "5500-0000-0000-0004", "+1 (679) 555-1339", "é", "\n", "_", "%", "0000000255.1.1.1"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert pii.base_spans(text) == plain_base(text), text


def test_base_spans_of_endless_words_take_linear_time():
    for text in ("x" * 400_000, "1" * 400_000, "1." * 200_000, "+1" * 200_000, "a@" * 200_000, "1 " * 200_000, "+1(" * 100_000):
        pii.spans_of(text, pii.SpanField({}, np.zeros((5, 4))))


def test_forward_backward_sums_over_all_segmentations():
    rng = np.random.default_rng(3)
    n, pairs = 5, rng.normal(size=(5, 4))
    spans = [(i, j, y, float(rng.normal())) for i in range(n) for j in range(i, min(n, i + 3)) for y in range(4) if rng.random() < 0.7]

    def every(at, last):
        if at == n:
            yield 0.0, ()
            return
        for score, rest in every(at + 1, pii.OUT):
            yield score, rest
        for k, (i, j, y, s) in enumerate(spans):
            if i == at:
                for score, rest in every(j + 1, y):
                    yield score + s + pairs[last, y], ((k, last, y), *rest)

    found = list(every(0, pii.OUT))
    weights = np.exp([s for s, _ in found])
    scores = np.full((2, n, 3, 4), -np.inf)
    for i, j, y, s in spans:
        scores[:, i, j - i, y] = s
    total, chance, expected = pii.log_total(scores, pairs)
    assert np.allclose(total, np.log(weights.sum()))
    want, counts = np.zeros(len(spans)), np.zeros((5, 4))
    for w, (_, used) in zip(weights / weights.sum(), found, strict=True):
        for k, last, y in used:
            want[k] += w
            counts[last, y] += w
    assert np.allclose([chance[1, i, j - i, y] for i, j, y, _ in spans], want) and np.isclose(chance[0].sum(), want.sum()) and np.allclose(expected, counts)
    island = pii.Island("#", [(k, k + 1) for k in range(n)], [(i, j, (f"{i}{j}",)) for i in range(n) for j in range(i, min(n, i + 3))])
    model = pii.SpanField({(y, f"{i}{j}"): s for i, j, y, s in spans}, pairs)
    model.weights |= {(y, f[0]): -50.0 for i, j, f in island.spans for y in range(4) if (y, f[0]) not in model.weights}
    best = max(found, key=lambda x: x[0])
    every_kind = type("EveryKind", (pii.Island,), {"kinds": lambda self: (0, 1, 2, 3)})
    assert model.best(every_kind("#", island.atoms, island.spans)) == [spans[k][:3] for k, _, _ in best[1]]


def people(seed):
    """A text with data of each kind."""
    rng = random.Random(seed)
    card = [rng.randrange(10) for _ in range(15)]
    check = -sum(x if k % 2 else (2 * x) // 10 + 2 * x % 10 for k, x in enumerate(card)) % 10
    card = "".join(map(str, [*card, check]))
    data = [f"{'abcdefg'[rng.randrange(7)]}{rng.randrange(99)}.x@mail{rng.randrange(9)}.example.com", ".".join(str(rng.randrange(1, 255)) for _ in range(4)), card, f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"]
    rng.shuffle(data)
    return " in the house ".join(data[: rng.randint(0, 4)]) + f" and {rng.randrange(3000)} things, 3.5 or 12-13."


@pytest.fixture(scope="module")
def learned(spark, make):
    return pii.fit(make([(k, people(k)) for k in range(300)] + [(5, people(5)), (None, people(1)), (301, None), (302, "")]))


def test_field_finds_what_the_patterns_miss(learned):
    kinds = lambda t: [(pii.KINDS[y], t[a:z], b) for a, y, z, b in pii.spans_of(t, learned)]
    assert kinds("of +1 (964) 555-6360 4111111111111111 it") == [("phone", "+1 (964) 555-6360", False), ("card", "4111111111111111", False)]
    assert kinds("write to jane.doe (at) mail7 (dot) example (dot) com or so") == [("email", "jane.doe (at) mail7 (dot) example (dot) com", False)]
    assert kinds("phone: 1 (812) 555-7711 or") == [("phone", "1 (812) 555-7711", False)]
    for clean in ("in 1984 there were 1,200 of 3.5 and 12-13 and 2020-10-11", "version 1.2.3 of 10 20 30", "look (at) me", "1234 5678 9012 3456 things", "it cost 15000000 in 2019"):
        assert kinds(clean) == [], clean


def test_held_out_documents(learned):
    for k in range(1000, 1100):
        assert [x[:3] for x in pii.spans_of(people(k), learned)] == plain_base(people(k))


def test_reports_of_documents(spark, make, learned, odd_rows):
    rows = [*odd_rows, (20, people(3)), (20, people(3)), (21, "é𝄞 a@b.co " * 3), (22, "x@y.zz, +49 30 1234567890 1.2.3.4"), (23, "a" * 9_000 + " 10.0.0.1 " + "b" * 9_000)]
    got = pii.pii_report(make(rows), learned).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    texts = defaultdict(set)
    for i, t in rows:
        base = plain_base(t or "")
        name = ",".join(f"{pii.KINDS[y]}:{a}:{z}" for a, y, z in base)
        texts[i].add((*(sum(y == k for _, y, _ in base) for k in range(4)), hashlib.sha256(name.encode()).hexdigest()))
    for r in got:
        assert tuple(r)[1:6] in texts[r.doc_id]
        assert len(r.spans.split(",")) >= sum(tuple(r)[1:5])
    assert pii.pii_report(make([]), learned).count() == 0
    assert pii.fit(make([])).weights == {} and pii.fit(make([(1, "no data at all 5")])).weights == {}
    clean = {r.doc_id: r.text for r in pii.redacted(make(rows), learned).collect()}
    assert clean[21] == "é𝄞 [email] " * 3 and clean[2] is None and clean[1] == dict(rows)[1]


@pytest.mark.parametrize("name", ["op11_pii", "op12_conversation_repair", "op13_prefix_trie"])
def test_registered_queries(spark, name):
    """Whole results over given tables."""
    table = "documents" if name == "op11_pii" else "conversations"
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").select(*(["doc_id", "text"] if name == "op11_pii" else ["conv_id", "turn", "role", "text"])).collect()]
    got = queries()[name](spark, "/root/testdata/sf0.001").collect()
    if name == "op13_prefix_trie":
        assert sorted((tuple(r) for r in got), key=repr) == expected_nodes(rows)
    elif name == "op12_conversation_repair":
        damaged = by_conversation(damage(rows))
        assert {r.conv_id for r in got} == {r[0] for r in rows}
        for r in got:
            mine = damaged[r.conv_id]
            assert (r.blank, r.duplicate, r.truncated) == tuple(faults(mine).count(x) for x in ("blank", "duplicate", "truncated"))
            assert r.repaired_sha256 == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in repaired_by_hand(mine, r.audit)).encode()).hexdigest()
    else:
        assert {r.doc_id: tuple(r)[1:5] for r in got} == {i: tuple(sum(y == k for _, y, _ in plain_base(t or "")) for k in range(4)) for i, t in rows}


@pytest.mark.parametrize("name", ["op12_conversation_repair", "op13_prefix_trie"])
def test_oracles(spark, name):
    from phantomlake.llm.queries import oracle_sql

    con = duckdb.connect()
    con.sql("create view conversations as select * from '/root/testdata/sf0.001/conversations.parquet'")
    got, want = queries()[name](spark, "/root/testdata/sf0.001"), con.sql(oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(repr, want.select(*columns).fetchall()))
