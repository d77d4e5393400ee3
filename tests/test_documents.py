"""The merge of stored documents: foreign keys, unreadable entries, removals on both sides, newer versions."""

import json

import pytest
from pyspark.sql import functions as F

from phantomlake.operators import documents

KNOWN = ["device_id", "name", "n"]


def table(spark, docs):
    return spark.createDataFrame([(d if isinstance(d, str) or d is None else json.dumps(d),) for d in docs], "doc string")


def device(k, name, runs=(), **more):
    return {"device_id": k, "name": name, "runs": [{"run_id": r, "run_date": f"2026-01-0{9 - int(r[-1])}", "v": v} for r, v in runs]} | more


def merge(spark, base, mine, theirs):
    rows = documents.merged(*(table(spark, x) for x in (base, mine, theirs)), KNOWN).collect()
    return {r.device_id: json.loads(r.doc) for r in rows if not r.kept}, sorted(r.doc for r in rows if r.kept)


def runs_of(doc):
    return [(r["run_id"], r["v"]) if isinstance(r, dict) and "v" in r else r for r in doc["runs"]]


def test_foreign_keys_and_unreadable_entries_survive(spark):
    base = [device("a", "old", n=2)]
    theirs = [device("a", "old", n=2, new_key={"x": [1, True]}), "{broken", '{"other":1}', "[1]", '{"device_id":"q","runs":{"a":1}}', device("disk", "only there", new_key=1)]
    got, kept = merge(spark, base, [device("a", "mine", n=3), device("c", "fresh")], theirs)
    assert got["a"] == device("a", "mine", n=3, new_key={"x": [1, True]}) and got["c"] == device("c", "fresh")
    assert got["disk"] == device("disk", "only there", new_key=1) and len(got) == 3
    assert kept == sorted(["{broken", '{"other":1}', "[1]", '{"device_id":"q","runs":{"a":1}}'])


def test_fields_merge_one_by_one(spark):
    got, _ = merge(spark, [device("a", "x", n=1, zoom=1)], [device("a", "x", n=7)], [device("a", "theirs", n=2, zoom=5)])
    assert got["a"] == device("a", "theirs", n=7, zoom=5)
    got, _ = merge(spark, [device("a", "x", n=1)], [device("a", "x", n=None)], [device("a", "y", n=2)])
    assert got["a"]["n"] is None and got["a"]["name"] == "y"


def test_removed_scanners_stay_removed_unless_changed_here(spark):
    base = [device(k, k, [("r1", 0)]) for k in "abcde"]
    mine = [device("b", "b", [("r1", 0)]), device("c", "changed", [("r1", 0)]), device("d", "d", [("r1", 1)]), device("e", "e", []), device("f", "f")]
    theirs = [device("a", "changed there", [("r1", 5)]), device("g", "g")]
    got, _ = merge(spark, base, mine, theirs)
    assert set(got) == {"c", "d", "e", "f", "g"} and runs_of(got["d"]) == [("r1", 1)] and got["e"]["runs"] == []


def test_controls_merge_one_by_one(spark):
    """Both added one, one side removed and the other changed, in the order of their dates; unreadable ones stay behind."""
    base = [device("a", "x", [("r1", 0), ("r2", 0), ("r3", 0), ("r4", 0), ("r5", 0)])]
    mine = [device("a", "x", [("r1", 1), ("r2", 0), ("r4", 0), ("r5", 9), ("r6", 1)])]
    their = device("a", "x", [("r1", 2), ("r2", 2), ("r3", 2), ("r7", 2)])
    their["runs"] += [17, {"run_id": "r8"}]
    got, _ = merge(spark, base, mine, [their])
    assert runs_of(got["a"]) == [("r7", 2), ("r6", 1), ("r5", 9), ("r2", 2), ("r1", 1), 17, {"run_id": "r8"}]


def test_layout_and_repeats_do_not_matter(spark):
    base = ['{"device_id":"a","name":{"p":1,"q":2},"runs":[]}']
    mine = ['{"runs":[],  "name":{"q":2,"p":1},"device_id":"a"}']
    theirs = ['{"device_id":"a","name":"there","runs":[{"run_id":"r1","run_date":"d","v":1},{"run_id":"r1","run_date":"d","v":2}]}']
    got, _ = merge(spark, base, mine, theirs)
    assert got["a"]["name"] == "there" and runs_of(got["a"]) == [("r1", 2)]
    got, kept = merge(spark, [], [], [None, theirs[0], theirs[0]])
    assert list(got) == ["a"] and kept == [None]
    assert merge(spark, [], [], []) == ({}, [])


def test_newer_documents_are_refused(spark):
    theirs = table(spark, [device("a", "x")]).withColumn("version", F.lit(documents.SCHEMA_VERSION + 1))
    none = table(spark, [])
    with pytest.raises(ValueError, match="this library writes"):
        documents.merged(none, none, theirs, KNOWN, "version")
    same = theirs.withColumn("version", F.lit(documents.SCHEMA_VERSION))
    assert documents.merged(none, none, same, KNOWN, "version").count() == 1


def test_one_bad_control_hides_nothing(spark):
    """A scanner with one bad control of five keeps four and reports one."""
    doc = device("a", "x", [(f"r{k}", k) for k in range(4)])
    doc["runs"].insert(2, {"run_id": "bad"})
    del doc["runs"][0]["run_id"]
    doc["runs"][1]["run_id"], doc["runs"][1]["series_uid"] = "", "1.2.3"
    read = documents.parsed(table(spark, [doc, "{"]))
    rows = {r.device_id: r for r in read.collect()}
    assert [r.run_id[:11] for r in rows["a"].runs] == ["2026-01-09-", "1.2.3", "r2", "r3"] and [json.loads(x) for x in rows["a"].bad_runs] == [{"run_id": "bad"}] and rows[None].bad
    messages = documents.load_warnings(read, F.lit("Scanner"), F.lit(2)).collect()
    assert {r.message for r in messages} == {"Scanner : 1 contrôle illisible", "installation n° 2 illisible"}
