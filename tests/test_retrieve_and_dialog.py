import hashlib
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import chunk, dialog, embed, retrieve
from tessera.plans import catalog
from tessera.sources import html, readers
from tessera.config import WikiFilter, build, Config


def test_fusion_prefers_items_in_both_lists(spark):
    a = spark.createDataFrame([(0, "x", 1), (0, "y", 2)], "query int, id string, rank int")
    b = spark.createDataFrame([(0, "y", 1), (0, "z", 2)], "query int, id string, rank int")
    got = [(r["id"], r["score"]) for r in retrieve.fuse([a, b], 3).orderBy("rank").collect()]
    assert got == [("y", round(1 / 61 + 1 / 60, 6)), ("x", round(1 / 60, 6)), ("z", round(1 / 61, 6))]


def test_neighbours_are_taken_once_and_not_of_neighbours(spark):
    chunks = spark.createDataFrame([("d", i) for i in range(6)] + [("e", 0)], "doc_id string, `order` int")
    hits = spark.createDataFrame([("d", 0, 0.9), ("d", 2, 0.8), ("e", 0, 0.5)], "doc_id string, `order` int, score double")
    got = sorted((r["doc_id"], r["order"], r["score"]) for r in retrieve.neighbours(hits, chunks, 1).collect())
    assert got == [("d", 0, 0.9), ("d", 1, 0.0), ("d", 2, 0.8), ("d", 3, 0.0), ("e", 0, 0.5)]


def test_judge(spark):
    df = spark.createDataFrame([("a/x.md", "1 | good"), ("a/y.md", "0"), ("z", "")], "path string, v string")
    got = [(r["name"], r["comment"]) for r in retrieve.judged(df, F.col("v")).orderBy("path").collect()]
    assert got == [("x.md", "good"), ("z", "")]


def test_sparse_rows_take_the_largest_weight(spark):
    rows = spark.createDataFrame([(1, "a", 0.3), (1, " a", 0.9), (1, "b", 0.0), (1, "[CLS]", 5.0)], "k int, tok string, w double")
    got = embed.sparse_vectors(embed.sparse_rows(rows, "k", ("[CLS]",)), "k").collect()
    assert len(got) == 1 and [round(v, 6) for v in got[0]["keywords"]["values"]] == [0.9]


def test_vectors_survive_their_code(spark):
    df = spark.createDataFrame([([1.5, -2.25],), (None,)], "v array<float>")
    assert [r["x"] for r in df.select(embed.decode_vector(embed.encode_vector(F.col("v"))).alias("x")).collect()] == [[1.5, -2.25], None]


def test_answers_that_are_no_chunks_fall_back(spark):
    bad = ['{"x": 1}', '{"chunks": []}', '{"chunks": "a"}', '{"chunks": [" ", 3]}', "nonsense", None]
    df = spark.createDataFrame([(a,) for a in [*bad, '{"chunks": ["a", 1, "b"]}']], "a string")
    got = [r["x"] for r in df.select(chunk.chunks_or_block([F.col("a")], F.lit("block")).alias("x")).collect()]
    assert got == [["block"]] * 6 + [["a", "b"]]
    tries = iter(['{"chunks": []}', "?", '{"chunks": ["late"]}'])
    del tries
    texts = spark.createDataFrame([("t",)], "t string")
    assert texts.select(chunk.model_chunks(F.col("t"), lambda p: "never JSON").alias("x")).first()["x"] == ["t"]


def test_failures_of_the_context_model_give_empty_text(spark):
    def fail(prompt):
        raise RuntimeError("down")

    df = spark.createDataFrame([("t",)], "t string")
    assert df.select(chunk.complete(F.col("t"), fail, "").alias("x")).first()["x"] == ""


def test_intent_of_one_message_is_the_message(spark):
    rows = [(1, 0, "user", "  hi "), (2, 0, "system", "s"), (2, 1, "user", "q"), (2, 2, "assistant", "a")]
    got = {r["conv_id"]: r["intent"] for r in dialog.intent(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).collect()}
    assert got == {1: "hi", 2: "User: q\nAssistant: a"}


def test_stream_stops_at_the_mark(spark):
    frame = lambda t: f'data: {{"choices":[{{"delta":{{"content":"{t}"}}}}]}}'
    lines = [frame("a"), ": ping", "data: {bad", frame(""), frame("b"), "data: [DONE]", frame("c")]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "stream int, seq int, line string")
    assert dialog.stream_text(df).first()["answer"] == "ab"


def test_markdown_of_html():
    assert html.to_markdown("") == "" and html.to_markdown(None) == ""
    assert html.to_markdown("<h1>T</h1><p>a <strong>b</strong></p><script>x()</script><style>y</style>") == "# T\n\na **b**"
    assert html.to_markdown("<ul><li>a</li><li>b</li></ul>") == "- a\n- b"
    assert html.to_markdown("<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table>") == "| A | B |\n| --- | --- |\n| 1 | 2 |"
    assert "seen" in html.to_markdown('<img src="a.png" alt="x">', lambda s, a: "seen")

    def fail(src, alt):
        raise OSError

    assert "x" in html.to_markdown('<img src="a.png" alt="x">', fail)
    assert html.to_markdown('<p>t</p><img src="a.png">', lambda s, a: None) == "t"


def test_wiki_query_and_paging():
    assert "space in" in readers.wiki_query(WikiFilter(spaces=("A",)))
    q = readers.wiki_query(WikiFilter(spaces=("A",), ancestor_ids=("1",), skip_ancestor_ids=("2",)))
    assert "space in" not in q and "ancestor not in" in q and q.endswith("ORDER BY lastmodified DESC")
    pages = [str(i) for i in range(205)]
    calls = []
    assert readers.fetch_pages(lambda at, n: calls.append(at) or pages[at : at + n]) == pages and calls == [0, 200]


def test_markdown_files(spark, tmp_path):
    (tmp_path / "api v1").mkdir()
    (tmp_path / "a.md").write_text("# A\n", encoding="utf-8")
    (tmp_path / "api v1" / "b+c.md").write_text("ü", encoding="utf-8")
    (tmp_path / "c.txt").write_text("no")
    got = {r["id"]: (r["text"], r["size"]) for r in readers.markdown_files(spark, str(tmp_path)).collect()}
    assert got == {"a.md": ("# A\n", 4), "api v1/b+c.md": ("ü", 2)}


def test_unknown_settings_are_errors():
    import pytest

    assert build(Config, {"index": {"chunker": "llm"}}).index.safe_limit == 16128
    with pytest.raises(ValueError):
        build(Config, {"sources": {}})


def test_searches_equal_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    vec = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    counts = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        for tok, n in Counter(re.split("[ \n]+", r["text"])).items():
            h = hashlib.md5(tok.encode()).hexdigest()
            at = counts.setdefault(r["doc_id"], {})
            idx = sum(int(h[k : k + 8], 16) for k in (0, 8, 16, 24)) % 4294967295
            at[idx] = max(n, at.get(idx, 0))

    def best(scores, k):
        return {i: (s, n) for n, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k], 1)}

    def cosine(a, b):
        return round(float(a @ b) / (float(np.linalg.norm(a) * np.linalg.norm(b)) or 1.0), 6)

    dense = {q: best({i: cosine(a, vec[q]) for i, a in vec.items()}, 20) for q in vec if q % 50 == 0}
    sparse = {q: best({i: float(sum(n * c[x] for x, n in counts[q].items() if x in c)) for i, c in counts.items() if c.keys() & counts[q].keys()}, 20) for q in counts if q % 50 == 0}
    both = {q: best({i: round(sum(1 / (59 + part[q][i][1]) for part in (sparse, dense) if i in part.get(q, {})), 6) for i in {*sparse.get(q, {}), *dense.get(q, {})}}, 10) for q in {*sparse, *dense}}
    for name, want in (("sparse_search", sparse), ("dense_search", dense), ("hybrid_search", both)):
        got = {}
        for r in catalog.QUERIES[name](spark, sf).collect():
            got.setdefault(r["query"], {})[r["id"]] = (r["score"], r["rank"])
        assert len(want) > 1 and got.keys() == want.keys()
        for q in want:
            by_rank = [sorted((n, s) for s, n in x[q].values()) for x in (got, want)]
            assert len(by_rank[0]) == len(by_rank[1]) and all(a[0] == b[0] and abs(a[1] - b[1]) < 2e-6 for a, b in zip(*by_rank, strict=True)), (name, q)
            assert name == "dense_search" or got[q].keys() == want[q].keys()
