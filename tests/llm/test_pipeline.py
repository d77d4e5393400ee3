"""The pipeline over the smallest tables, stage by stage."""

import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline(spark):
    import corpus_pipeline as p
    from phantomlake.llm.common import documents, written

    docs = documents(spark, SF)
    columns = docs.columns
    sizes = [docs.count()]
    for name, stage in p.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    # no text of the benchmark is left, no text occurs twice, and what was labelled good mostly stays
    left = docs.toPandas()
    items = [r[0].lower() for r in duckdb.sql(f"select text from '{SF}/benchmark.parquet'").fetchall()]
    assert not any(x in t.lower() for x in items for t in left.text)
    assert left.text.is_unique
    packed = p.STAGES[-1][1](spark, docs, SF)
    assert set(packed.select("doc_id").distinct().toPandas().doc_id) == set(left.doc_id)
    assert p.run(spark, SF).count() == packed.count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["op1_url_filter", "op7_near_dedup", "op8_quality_rules"])
def test_oracle(spark, name):
    from phantomlake.llm import queries as q

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    got, want = q.queries()[name](spark, SF).toPandas(), con.sql(q.oracle_sql()[name]).df()
    key = got.columns[0]
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a, b = (x[columns].sort_values(key).reset_index(drop=True).astype(str).replace("nan", "None") for x in (got, want))
    assert a.equals(b)
