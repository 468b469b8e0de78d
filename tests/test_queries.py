import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(f"{x:.6f}" if isinstance(x, float) else str(x.tolist() if hasattr(x, "tolist") else x) for x in r) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry._own()[1]))
def test_query_equals_its_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(entry._own()[0]) - set(entry._own()[1])))
def test_query_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 10


def test_every_chunk_has_its_context(spark):
    texts = {str(r["doc_id"]): r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    chunks = {}
    for r in entry.queries()["chunk_contexts"](spark, SF).collect():
        assert r["context"].strip() == f"Document:\n{texts[r['doc_id']]}\n\nPart:\n{r['text']}\n\nSay in one sentence what the part is about.".strip()
        chunks.setdefault(r["doc_id"], []).append((r["order"], r["text"]))
    assert chunks.keys() == {d for d, t in texts.items() if t.strip()} and max(map(len, chunks.values())) > 1
    for d, parts in chunks.items():
        assert "".join("".join(t for _, t in sorted(parts)).split()) == "".join(texts[d].split())
