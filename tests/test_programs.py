import json

from pyspark.sql import functions as F

from tessera import cli, sql
from tessera.config import RetrievalConfig, load_config
from tessera.operators.embed import dense, sparse_rows
from tessera.plans import rag


def test_index_and_query(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    for name, text in (("a.md", "# Cats\nCats sleep all day."), ("b.md", "# Trains\nTrains run at night.")):
        (tmp_path / "docs" / name).write_text(text)
    (tmp_path / "c.json").write_text(json.dumps({"local_documents": str(tmp_path / "docs")}))
    config, base = load_config(str(tmp_path / "c.json")), str(tmp_path / "store")
    assert {r["action"]: r["count"] for r in cli.index(spark, config, base).collect()} == {"new": 2}
    assert {r["action"]: r["count"] for r in cli.index(spark, config, base).collect()} == {"skip": 2}
    best = cli.query(spark, base, "Trains run", RetrievalConfig()).first()
    assert best["path"] == "b.md" and best["rank"] == 1 and "\n" not in best["preview"]


def test_dialogs_are_answered(spark):
    rows = [("c1", "d", "d/x.md", 0, "cats sleep"), ("c2", "d", "d/x.md", 1, "cats eat"), ("c3", "e", "e.md", 0, "trains run")]
    chunks = spark.createDataFrame(rows, "id string, doc_id string, path string, `order` int, text string").withColumn("full", dense(F.col("text")))
    words = chunks.select("id", F.explode(F.split("text", " ")).alias("tok"), F.lit(1.0).alias("w"))
    talk = spark.createDataFrame([(1, 0, "user", "sleep"), (2, 0, "user", "trains"), (2, 1, "assistant", "which"), (2, 2, "user", "run")], "conv_id int, turn int, role string, text string")
    judge = lambda p: "0" if "trains" in p.split("Text:")[1].split("Context:")[0] else "1 | cats"
    got = rag.answer(talk, chunks, sparse_rows(words, "id"), RetrievalConfig(top_k=1), judge=judge)
    kept = sorted((r["query"], r["doc_id"], r["order"], r["comment"], r["name"]) for r in got.chunks.collect())
    assert kept == [(1, "d", 0, "cats", "x.md"), (1, "d", 1, "cats", "x.md")]
    answers = {r["conv_id"]: r["answer"] for r in got.answers.collect()}
    assert answers[2] == rag.NOTHING and "[0] d/x.md\nAbout: \nText: cats sleep\nAs of: \n\n[1] d/x.md\nAbout: \nText: cats eat" in answers[1]
    said = [(r["conv_id"], r["n"], json.loads(r["event"])["event"]["type"]) for r in got.events.orderBy("conv_id", "n").collect()]
    assert said == [(1, 0, "status"), (1, 1, "status"), (1, 2, "status"), (1, 3, "citation"), (1, 4, "citation"), (2, 0, "status"), (2, 1, "status"), (2, 2, "status")]
    told = list(rag.pipe(talk, 1, chunks, sparse_rows(words, "id"), lambda prompt: iter(["a", "b"]), config=RetrievalConfig(top_k=1), judge=judge))
    assert told[2:6] == ["<think>", "[x.md]: ✔ cats\n", "[x.md]: ✔ cats\n", "</think>"] and told[-2:] == ["a", "b"] and len(told) == 11
    assert list(rag.pipe(talk, 2, chunks, sparse_rows(words, "id"), iter, config=RetrievalConfig(top_k=1), judge=judge))[-1] == rag.NOTHING


def test_sql_functions(spark):
    sql.register(spark)
    got = spark.sql("SELECT token_index('test') AS i, token_count('abcde') AS n, cosine(array(1D, 0D), array(1D, 1D)) AS c, html_markdown('<p>x</p>') AS m").first()
    assert got["i"] == 1085751994 and got["n"] == 2 and abs(got["c"] - 0.5**0.5) < 1e-9 and got["m"] == "x"
    assert spark.sql("SELECT count(*) AS n FROM (SELECT repeat('word ', 100) AS t) d, LATERAL recursive_split(d.t, 20)").first()["n"] > 3
