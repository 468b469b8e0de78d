"""Vectors, payloads and answers are made where their rows lie, and once."""

from pyspark.sql import functions as F

from tessera.config import RetrievalConfig
from tessera.operators import embed
from tessera.plans import catalog, rag
from tessera.plans.index import Indexer

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_each_hit_is_judged_and_answered_once(spark):
    """answers and dialogs without a hit were two plans, so all before them ran twice."""
    judged, answered = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def judge(prompt):
        judged.add(1)
        return "0" if "Text: two" in prompt else "1 | kept"

    def model(prompt):
        answered.add(1)
        return prompt

    docs = spark.createDataFrame([(str(i), str(i), f"p/{i}", 0, t) for i, t in enumerate(["one x", "two y", "three z"])], "id string, doc_id string, path string, `order` int, text string")
    docs = docs.withColumn("full", embed.dense(F.col("text"))).cache()
    talk = spark.createDataFrame([(1, 0, "user", "one"), (2, 0, "user", "two"), (3, 0, "user", "three")], "conv_id int, turn int, role string, text string")
    got = rag.answer(talk, docs, docs.select("id", embed.sparse(F.col("text")).alias("keywords")), RetrievalConfig(top_k=1), judge=judge, answer_model=model)
    said = {r["conv_id"]: r["answer"] for r in got.answers.collect()}
    assert said[2] == rag.NOTHING and said[1].startswith("one\n\nSources:\n\n[0] p/0") and said[3].startswith("three")
    assert (judged.value, answered.value) == (3, 2)


def test_weights_by_place_are_not_shuffled(spark, tmp_path):
    """every token was shuffled twice, by document and token and by document and index."""
    assert "Exchange" not in plan(catalog.QUERIES["sparse_vector_max"](spark, SF))
    rows = [(1, "a b  c\na  a  \tb x"), (2, None), (3, ""), (4, " lead"), (5, "a b c d e f g h a"), (5, "h \x1ca a"), (None, "n m"), (None, "m")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    tokens = catalog.words(d).withColumn("w", F.lit(1.0) / (1 + F.col("pos") % 7))
    want = sorted((str(r["doc_id"]), r["idx"], round(r["w"], 6)) for r in embed.sparse_rows(tokens, "doc_id").collect())
    assert sorted((str(r["doc_id"]), r["idx"], r["w"]) for r in catalog.QUERIES["sparse_vector_max"](spark, str(tmp_path)).collect()) == want


def test_many_vectors_equal_single_ones():
    maps = [{"a": 2, "b": 0.5}, {}, {"a": -1.0, "": 3.0}]
    start, idx, w = embed.entries(maps)
    for i, m in enumerate(maps):
        one = embed.sparse_of(m)
        assert (idx[start[i] : start[i + 1]].tolist(), w[start[i] : start[i + 1]].tolist()) == (one["indices"], one["values"])
    assert embed.hashed_embedding(["", "A a b"])[0] == [0.0] * 64 and sum(map(abs, embed.hashed_embedding(["A a b"])[0])) in (1.0, 3.0)
    few = embed.Known(len, 1)
    assert [few[x] for x in ("ab", "abc", "ab", "abc")] == [2, 3, 2, 3] and few.keys() == {"ab"}


def test_chunks_are_not_shuffled(spark):
    """each chunk met its document's payload by a join, which also multiplied the chunks of equal ids."""
    found = plan(catalog.QUERIES["index_run"](spark, SF))
    assert "Join" not in found and "Exchange" not in found
    docs = spark.createDataFrame([("d", "p", "one", "x"), ("d", "p", "two", "y")], "id string, path string, text string, creator string").withColumn("updated_at", F.current_timestamp())
    assert sorted((r["text"], r["payload"]) for r in Indexer().chunk(docs).collect()) == [("one", '{"creator":"x"}'), ("two", '{"creator":"y"}')]
