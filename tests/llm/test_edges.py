"""Every operator over odd rows and over an empty table: no crash, a row per document, defined values."""

import os
import zlib

import numpy as np
import pytest

from phantomlake.llm import cleaning, decontaminate, license_scan, line_crf, near_dedup, packing, ppm, token_counts, token_files, url_filter
from phantomlake.llm.common import new_path, written
from phantomlake.llm.queries import queries
from phantomlake.llm.tokens import ChunkEncoder, default_tokenizer

from .conftest import prose

BYTES, WORD = default_tokenizer("byte_bpe_50k.json"), default_tokenizer("word_bpe_49k.json")


def op10(spark, docs):
    path = new_path(spark, "shards")
    manifest = written(token_files.write_shards(docs, path, WORD), "manifest")
    return token_files.read_shards(spark, path, manifest)


RUNS = {
    "op2": lambda s, d: license_scan.scan_licenses(d),
    "op3": lambda s, d: ppm.score(d),
    "op4": lambda s, d: line_crf.classify(d, line_crf.fit(d, s.createDataFrame([(1, 1), (4, 0), (6, 1)], "doc_id long, quality int"))),
    "op7": lambda s, d: near_dedup.near_duplicates(d),
    "op8": lambda s, d: cleaning.quality_rules(d),
    "op9": lambda s, d: token_counts.token_counts(d, BYTES, new_path(s, "cache")),
    "op10": op10,
}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_one_row_per_document(spark, make, odd_rows, name):
    got = RUNS[name](spark, make(odd_rows)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in odd_rows)


@pytest.mark.parametrize("name", sorted(RUNS))
def test_empty_table(spark, make, name):
    assert RUNS[name](spark, make([])).count() == 0


def test_values_of_odd_texts(spark, make, odd_rows):
    """Null (2), empty (3), one endless word (7), blanks alone (8)."""
    got = {name: {r.doc_id: r for r in RUNS[name](spark, make(odd_rows)).collect()} for name in RUNS}
    of = lambda name, *columns: [tuple(got[name][i][c] for c in columns) for i in (2, 3, 7, 8)]
    assert of("op2", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score") == [(n, 0, None, None, "", "", 0.0) for n in (0, 0, 1, 0)]
    assert of("op3", "n_tokens") == [(1,), (1,), (2,), (1,)]
    assert got["op3"][2].score == got["op3"][3].score and got["op3"][2].base_score == got["op3"][3].base_score < 0
    assert got["op4"][2].score == got["op4"][3].score and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got["op4"].values())
    assert of("op7", "n_shingles", "component_id", "kept") == [(0, 2, True), (0, 3, True), (1, 7, True), (0, 8, True)]
    assert (got["op7"][None].component_id, got["op7"][None].kept, got["op7"][5].component_id, got["op7"][5].kept) == (None, True, 1, False)
    assert of("op8", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept") == [(n, 50_000 * n, 0, 0, 0, True, False) for n in (0, 0, 1, 0)]
    tokenizer = ChunkEncoder.of(BYTES).tokenizer
    assert of("op9", "n_bytes", "n_tokens", "over_limit") == [(0, 0, False), (0, 0, False), (50_000, len(tokenizer.encode("x" * 50_000).ids), True), (5, len(tokenizer.encode(" \t\n \x0b").ids), False)]
    word = ChunkEncoder.of(WORD).tokenizer
    for i, text in ((2, ""), (3, ""), (7, "x" * 50_000), (8, " ")):
        ids = [*word.encode(text).ids, 1]
        assert (got["op10"][i].n_tokens, got["op10"][i].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert got["op10"][None].start == 0


@pytest.fixture(scope="module")
def empty_tables(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("empty")
    for name in ("documents", "pages", "benchmark", "labels", "conversations"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries()))
def test_registered_query_over_empty_tables(spark, empty_tables, name):
    assert queries()[name](spark, empty_tables).count() == 0


def test_packing_edges(spark, make, odd_rows):
    got = packing.pack(make(odd_rows), BYTES).collect()
    assert {str(r.doc_id) for r in got} == {str(i) for i, _ in odd_rows}
    assert packing.pack(make([]), BYTES).count() == 0


def test_decontamination_edges(spark, make, odd_rows):
    items = spark.createDataFrame([(1, odd_rows[0][1][:300]), (2, None), (3, ""), (None, "a b c d e f g h i j")], "item_id long, text string")
    # document 6 begins with the words of document 1
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_items(make(odd_rows), items).collect()} == {(1, 1), (5, 1), (6, 1)}
    assert decontaminate.find_items(make([]), items).count() == 0
    assert decontaminate.find_items(make(odd_rows), items.limit(0)).count() == 0


def test_url_edges(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://"), (4, "http://A.Example.ORG/es/x?y"), (5, "https://x.net/casino/poker#a"), (5, "https://x.net/casino/poker#a")]
    got = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame([(i, u, "h", "r") for i, u in rows], "page_id long, url string, host string, rule string")).collect()}
    assert (got[1].host, got[1].path, got[1].verdict) == ("", "", "allow")
    assert (got[2].host, got[3].path) == ("", "")
    assert (got[4].host, got[4].path, got[4].rule, got[4].verdict) == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert (got[5].n_soft_distinct, got[5].verdict) == (2, "block")


def test_stages_keep_columns(spark, make, odd_rows):
    """Filtering stages return the documents' own columns, whatever their names."""
    docs = make(odd_rows)
    items = spark.createDataFrame([(1, odd_rows[0][1][:300])], "item_id long, text string")
    model = line_crf.fit(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    for out in (cleaning.clean_documents(docs), line_crf.good_documents(docs, model), near_dedup.without_near_duplicates(docs), decontaminate.clean_documents(docs, items)):
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        assert out.count() <= len(odd_rows)


def test_vocabulary_from_a_table(spark, make):
    """Rules with entries of one's own instead of the built-in ones."""
    own = cleaning.vocabulary_of(spark.createDataFrame([("menu", "Navigate"), ("boilerplate", "Own Phrase"), ("boilerplate", ""), ("boilerplate", None), ("menu", "navigate")], "kind string, text string"))
    assert own == cleaning.Vocabulary(frozenset([b"navigate"]), (b"own phrase",))
    text = f"{prose(1)}\nNavigate\nThis own phrase stands here.\nAll rights reserved.\nHome page is here.\n{prose(2)}".encode()
    assert b"Navigate" not in cleaning.judged(text, own).clean and b"own phrase" not in cleaning.judged(text, own).clean and b"All rights reserved." in cleaning.judged(text, own).clean
    assert b"All rights reserved." not in cleaning.judged(text).clean and b"own phrase" in cleaning.judged(text).clean
    with pytest.raises(ValueError, match="more than 1 entries"):
        cleaning.vocabulary_of(spark.createDataFrame([("menu", "a"), ("menu", "b")], "kind string, text string"), most=1)


def test_tidy_removes_what_was_written(spark, make, monkeypatch):
    from phantomlake.llm import common

    monkeypatch.setattr(common, "_MADE", [])
    table = common.written(make([(1, "a")]), "tidy-test")
    path = common._MADE[0]
    assert table.count() == 1 and common.exists(spark, path)
    assert common.tidy(spark) == 1 and not common.exists(spark, path) and common.tidy(spark) == 0
