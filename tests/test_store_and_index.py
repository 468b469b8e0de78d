import datetime

from pyspark.sql import functions as F

from tessera.config import IndexConfig
from tessera.operators import chunk, embed, store
from tessera.plans.index import Indexer
from tessera.streaming.ingest import index_stream

DAY = datetime.datetime(2024, 5, 1)
SOURCE = "id string, path string, text string, updated_at timestamp, source_type string, size bigint"


def source(spark, rows):
    return spark.createDataFrame([(i, i, t, u, "markdown", len(t)) for i, t, u in rows], SOURCE)


def empty(spark):
    return spark.createDataFrame([], store.DOCUMENTS), spark.createDataFrame([], store.CHUNKS)


def test_upsert_delete_status(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "id string, v int")
    assert sorted(map(tuple, store.upsert(t, new).collect())) == [("a", 1), ("b", 3), ("c", 4)]
    assert sorted(map(tuple, store.delete(t, new.unionByName(new)).collect())) == [("a", 1)]
    c = spark.createDataFrame([("d", 3), ("d", 3), ("e", None)], "doc_id string, total int")
    assert [tuple(r) for r in store.index_status(c).collect()] == [("d", 2, 3)]


def test_a_second_run_does_nothing(spark):
    docs, chunks = empty(spark)
    src = source(spark, [("a", "one two", DAY), ("b", "", DAY), ("c", "# x\n" + "word " * 400 + "\n# y\nz", DAY)])
    todo, docs, chunks = Indexer(IndexConfig(block_limit=100)).run(src, docs, chunks)
    assert {r["id"]: r["action"] for r in todo.collect()} == {"a": "new", "b": "new", "c": "new"}
    rows = chunks.collect()
    assert sorted((r["doc_id"], r["order"]) for r in rows if r["doc_id"] != "c") == [("a", 0), ("b", 0)]
    mine = sorted((r["order"], r["total"]) for r in rows if r["doc_id"] == "c")
    assert mine == [(i, len(mine)) for i in range(len(mine))] and len(mine) > 2
    todo, _, _ = Indexer(IndexConfig(block_limit=100)).run(src, docs, chunks)
    assert {r["action"] for r in todo.collect()} == {"skip"}


def test_changes_are_found(spark):
    docs, chunks = empty(spark)
    src = source(spark, [(i, "text", DAY) for i in "abcdef"])
    _, docs, chunks = Indexer().run(src, docs, chunks)
    chunks = chunks.withColumn("total", F.when(F.col("doc_id") == "d", 5).otherwise(F.col("total"))).filter("doc_id <> 'e'")
    later = source(spark, [("a", "text", DAY), ("b", "text", DAY + datetime.timedelta(1)), ("c", "longer text", DAY), ("d", "text", DAY), ("e", "text", DAY), ("g", "new", DAY)])
    todo, after, _ = Indexer().run(later, docs, chunks)
    assert {r["id"]: r["action"] for r in todo.collect()} == {"a": "skip", "b": "reindex", "c": "reindex", "d": "reindex", "e": "reindex", "g": "new"}
    assert {r["id"] for r in after.collect()} == set("abcdefg")
    _, pruned, _ = Indexer().run(later, docs, chunks, prune=True)
    assert {r["id"] for r in pruned.collect()} == set("abcdeg")


def test_models_cut_and_describe(spark):
    docs, chunks = empty(spark)
    answers = lambda p: '{"chunks": ["one", " ", "two"]}' if p.startswith("Divide") else "about"
    _, _, chunks = Indexer(IndexConfig(chunker="llm", context="llm"), model=answers).run(source(spark, [("a", "text", DAY)]), docs, chunks)
    assert sorted((r["order"], r["total"], r["text"], r["context"]) for r in chunks.collect()) == [(0, 2, "one", "about"), (1, 2, "two", "about")]


def test_stream_is_idempotent(spark, tmp_path):
    docs, chunks = empty(spark)
    src = source(spark, [("a", "one", DAY), ("b", "two", DAY)])
    src.write.parquet(str(tmp_path / "in" / "x"))
    base, seen = str(tmp_path / "out"), []
    for k in range(2):
        stream = spark.readStream.schema(SOURCE).parquet(str(tmp_path / "in" / "*"))
        index_stream(stream, base, Indexer(), str(tmp_path / f"check{k}"), seen.append).awaitTermination()
        now = store.Current.read(spark, base)
        assert sorted((r["doc_id"], r["order"]) for r in now.chunks.collect()) == [("a", 0), ("b", 0)] and now.number == k + 1
    source(spark, [("b", "two and more", DAY), ("c", "three", DAY)]).write.parquet(str(tmp_path / "in" / "y"))
    stream = spark.readStream.schema(SOURCE).parquet(str(tmp_path / "in" / "*"))
    index_stream(stream, base, Indexer(), str(tmp_path / "check1"), seen.append).awaitTermination()
    now = store.Current.read(spark, base)
    assert {r["id"]: r["text"] for r in now.documents.collect()} == {"a": "one", "b": "two and more", "c": "three"} and seen == [0, 0, 1]
    # a batch that was applied before the stream noted it is left out
    now.replace(now.documents.filter("id <> 'c'"), now.chunks, **{str(tmp_path / "check2"): 0})
    index_stream(spark.readStream.schema(SOURCE).parquet(str(tmp_path / "in" / "*")), base, Indexer(), str(tmp_path / "check2")).awaitTermination()
    assert {r["id"] for r in store.Current.read(spark, base).documents.collect()} == {"a", "b"}


def test_chunks_carry_all_representations(spark):
    docs = source(spark, [("a", "one two one", DAY)]).withColumn("creator", F.lit("ann")).withColumn("created_at", F.to_timestamp(F.lit("2024-01-02T03:04:05Z")))
    row = Indexer().chunk(docs).first()
    assert dict(zip(row["keywords"]["indices"], row["keywords"]["values"], strict=True)) == {embed.index_of("one"): 2.0, embed.index_of("two"): 1.0}
    assert row["payload"] == '{"creator":"ann","created_at":"2024-01-02T03:04:05+00:00"}' and len(row["full"]) == 64
    assert Indexer().chunk(docs.drop("creator", "created_at")).first()["payload"] == "{}"
    assert sorted(tuple(r) for r in embed.postings_of(Indexer().chunk(docs)).select("idx", "w").collect()) == sorted([(embed.index_of("one"), 2.0), (embed.index_of("two"), 1.0)])


def test_counters_splitters_and_steps_are_injected(spark):
    docs, chunks = empty(spark)
    seen = []

    def step(changed):
        seen.append(sorted(r["id"] for r in changed.collect()))
        return changed.withColumn("text", F.concat("text", F.lit(" extra"))).withColumn("size", F.lit(99).cast("bigint"))

    use = Indexer(IndexConfig(block_limit=2), count=lambda t: len(t.split()), splitters=[lambda t: t.split(";")], document_steps=[step])
    src = source(spark, [("a", "x y;z", DAY), ("b", "q", DAY)])
    _, docs, chunks = use.run(src, docs, chunks)
    assert sorted((r["doc_id"], r["order"], r["text"]) for r in chunks.collect()) == [("a", 0, "x y"), ("a", 1, "z extra"), ("b", 0, "q extra")]
    todo, _, _ = Indexer(document_steps=[step]).run(src.withColumn("size", F.lit(99).cast("bigint")).filter("id = 'a'"), docs, chunks)
    assert {r["action"] for r in todo.collect()} == {"skip"} and seen == [["a", "b"], []]


def test_model_answers_are_asked_for_again(spark):
    answers = iter([None, "no JSON", '{"chunks": []}', '{"chunks": ["late"]}'])
    assert chunk_answers(spark, lambda p: next(answers), 3) == ["text"]
    answers = iter([None, '{"parts": 1}', '{"chunks": ["one", 2, "two"]}'])
    assert chunk_answers(spark, lambda p: next(answers), 3) == ["one", "two"]
    answers = iter(['["no object"]', "null", '{"chunks": "x"}'])
    assert chunk_answers(spark, lambda p: next(answers), 3) == ["text"]


def chunk_answers(spark, model, tries):
    got = []
    cut = chunk.cutter(model, tries)
    got += cut("text")
    return got
