import collections
import random

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    p = corpus_pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert [n for n, _ in p.STAGES] == ["quality_classifier", "line_dedup", "minhash_near_dedup", "mixing", "best_fit_packing"]
    kept = p.STAGES[0][1](spark, docs, SF)
    assert kept.columns == docs.columns
    have = {r["doc_id"] for r in kept.collect()}
    assert have >= {d for d, q in labels.items() if q == 1} and not have & {d for d, q in labels.items() if q == 0}
    slim = p.STAGES[1][1](spark, kept, SF).cache()
    assert slim.columns == docs.columns and slim.count() == len(have)
    single = p.STAGES[2][1](spark, slim, SF).cache()
    assert single.columns == docs.columns and single.select("text").distinct().count() == single.count()
    mixed = p.STAGES[3][1](spark, single, SF).cache()
    assert mixed.columns == docs.columns and mixed.select("doc_id").distinct().count() == single.count()
    packed = p.STAGES[4][1](spark, mixed, SF)
    assert packed.filter("piece = 0").count() == mixed.count()
    assert p.run(spark, SF).count() == packed.count()


@pytest.mark.parametrize("name", sorted(entry._llm()[1]))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    got, want = entry.queries()[name](spark, SF).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    key = sorted(got.columns)
    assert key == sorted(want.columns)
    assert got[key].sort_values("doc_id").astype(str).values.tolist() == want[key].sort_values("doc_id").astype(str).values.tolist()


ODD = "doc_id long, text string, lang string, source string, n_chars long, rank int, node string, score double"


def odd(spark):
    r = random.Random(3)
    say = lambda n: " ".join(r.choice(["the", "of", "and", "river", "bridge", "council", "stone", "water", f"w{r.randrange(500)}"]) for _ in range(n))
    rows = [(i, "\n".join(say(25) for _ in range(4)), "en", "a" if i % 3 else "b", 1, 1, "x", 0.5) for i in range(30)]
    rows += [rows[4], rows[4], (None, None, None, None, None, None, None, None), (None, say(40), None, None, None, None, None, None), (70, "", "en", "a", 0, None, None, None), (71, "\n\n", "en", None, None, None, None, None)]
    return spark.createDataFrame([*rows, (72, say(60_000), "en", "b", None, 1, "y", None)], ODD)


@pytest.mark.parametrize("k", range(4))
def test_stages_take_odd_rows_and_pass_all_columns_on(spark, k):
    docs = odd(spark)
    out = corpus_pipeline.STAGES[k][1](spark, docs, SF)
    assert out.columns == docs.columns
    rows, before = out.collect(), docs.collect()
    if k == 0:
        kept = collections.Counter(tuple(x) for x in rows)
        assert kept <= collections.Counter(tuple(x) for x in before) and all(n == kept[tuple(x)] or tuple(x) not in kept for x, n in ((before[4], 3),))
    if k == 1:
        assert len(rows) == len(before) and [x["text"] for x in rows if x["doc_id"] is None].count(None) == 1
    if k == 2:
        assert len({x["doc_id"] for x in rows if x["doc_id"] is not None and x["doc_id"] < 30}) == 30 and sum(x["doc_id"] == 4 for x in rows) == 1 and 72 in {x["doc_id"] for x in rows}
    if k == 3:
        assert {(x["doc_id"], x["source"]) for x in rows} == {(x["doc_id"], x["source"]) for x in before} and len(rows) >= len(before)
    assert corpus_pipeline.STAGES[k][1](spark, docs.filter("false"), SF).count() == 0


def test_the_last_stage_takes_odd_rows(spark):
    docs = odd(spark)
    got = corpus_pipeline.STAGES[4][1](spark, docs, SF).collect()
    assert collections.Counter(x["doc_id"] for x in got if x["piece"] == 0) == collections.Counter(x["doc_id"] for x in docs.collect())
    assert corpus_pipeline.STAGES[4][1](spark, docs.filter("false"), SF).count() == 0
