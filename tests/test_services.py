"""Model clients, representation services and the wiki source against small servers on this machine."""

import json
import threading
import time
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from tessera import cli, models, services
from tessera.config import RetrievalConfig, WikiConfig, WikiFilter, load_config
from tessera.functions import media_types
from tessera.operators import embed
from tessera.sources import wiki


@pytest.fixture
def serving():
    """serving(reply) runs a server; reply(path, body, headers) gives (code, text or bytes)."""
    running = []

    def run(reply):
        class Handler(BaseHTTPRequestHandler):
            def answer(self):
                body = self.rfile.read(int(self.headers.get("Content-Length", 0)))
                code, text = reply(self.path, json.loads(body) if body else None, self.headers)
                data = text if isinstance(text, bytes) else text.encode()
                self.send_response(code)
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            do_GET = do_POST = answer

            def log_message(self, *_):
                pass

        s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=s.serve_forever, daemon=True).start()
        running.append(s)
        return f"http://127.0.0.1:{s.server_address[1]}"

    yield run
    for s in running:
        s.shutdown()
        s.server_close()


def said(text):
    return json.dumps({"choices": [{"message": {"content": text}}]})


def test_completions(serving):
    seen, down = [], [2]

    def reply(path, body, headers):
        seen.append((path, headers["Authorization"], body))
        text = body["messages"][-1]["content"]
        if text == "busy" and down[0]:
            down[0] -= 1
            return 503, "later"
        return (400, "no") if text == "bad" else (200, said({"none": None, "json": '{"a": 1}', "prose": "not JSON"}.get(text if isinstance(text, str) else "", "fine")))

    c = models.ChatClient(serving(reply), "m", "k", temperature=0.1, max_tokens=50)
    assert c.complete("x") == "fine" and c("none") == "" and c.complete("busy") == "fine" and c.complete_json("json") == {"a": 1} and c.complete_json("none") == {}
    assert seen[0] == ("/chat/completions", "Bearer k", {"model": "m", "messages": [{"role": "user", "content": "x"}], "temperature": 0.1, "max_tokens": 50})
    with pytest.raises(ValueError):
        c.complete_json("prose")
    with pytest.raises(OSError):
        c.complete("bad")
    assert c.complete_vision("what", b"\x01") == "fine"
    assert seen[-1][2]["messages"][0]["content"][0]["image_url"]["url"] == "data:image/png;base64,AQ==" and seen[-1][2]["temperature"] == 0.0
    assert c.complete_all(["x", "none", "x"]) == ["fine", "", "fine"]


def test_calls_run_side_by_side_and_failures_are_caught(spark, serving):
    running, most = [], []

    def reply(path, body, headers):
        running.append(1)
        most.append(len(running))
        time.sleep(0.3)
        running.pop()
        text = body["messages"][-1]["content"]
        return (400, "no") if text == "7" else (200, said(f"got {text}"))

    c = models.ChatClient(serving(reply), "m", workers=8)
    got = spark.range(0, 16, 1, 1).select("id", models.completions(F.col("id").cast("string"), c, "failed").alias("a")).collect()
    assert {r["id"]: r["a"] for r in got} == {i: "failed" if i == 7 else f"got {i}" for i in range(16)}
    assert 4 <= max(most) <= 8


def test_streams(serving):
    frames = 'data: {"choices":[{"delta":{"content":"a"}}]}\n\n: ping\ndata: {"choices":[{"delta":{}}]}\ndata: {broken\ndata: {"choices":[{"delta":{"content":"b"}}]}\ndata: [DONE]\ndata: {"choices":[{"delta":{"content":"c"}}]}\n'
    assert list(models.ChatClient(serving(lambda *a: (200, frames)), "m").stream("x")) == ["a", "b"]


def test_descriptions_fall_back_on_alt_texts(serving):
    c = models.ChatClient(serving(lambda p, body, h: (200, said(" a chart ")) if "AQ==" in json.dumps(body) else (400, "no")), "m")
    d = models.describer(c, {"ok.png": b"\x01", "bad.png": b"\x02"}.get, media_types)
    assert [d("ok.png", "alt"), d("bad.png", "alt"), d("gone.png", "alt"), d("", ""), d("gone.png", "")] == ["a chart", "alt", "alt", None, None]


def test_representation_services(spark):
    s = services.server(0, embed.hashed_embedding, embed.counted_words, "small")
    threading.Thread(target=s.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{s.server_address[1]}"
    assert services.healthy(url) and not services.healthy("http://127.0.0.1:1")
    rows = spark.createDataFrame([("a b a",), ("",), (None,)], "t string").select(embed.dense(F.col("t"), services.dense_service(url)).alias("d"), embed.dense(F.col("t")).alias("e"), embed.sparse(F.col("t"), services.sparse_service(url)).alias("s")).collect()
    assert all(r["d"] == r["e"] for r in rows)
    assert sorted(zip(rows[0]["s"]["indices"], rows[0]["s"]["values"], strict=True)) == sorted([(embed.index_of("a"), 2.0), (embed.index_of("b"), 1.0)]) and rows[1]["s"]["indices"] == []
    with pytest.raises(OSError):
        services.dense_service(url + "/nowhere", tries=1)(["x"])
    s.shutdown()
    s.server_close()


def test_sparse_weights():
    assert embed.token_weights([0, 4, 5, 2, 6, 4], [9.0, 0.3, -1.0, 1.0, 0.0, 0.9], {0, 1, 2, 3}, lambda i: f" t{i} ") == {"t4": 0.9}
    assert embed.sparse_of({"test": 0.5}) == {"indices": [1085751994], "values": [0.5]}


def page(i):
    return {"content": {"id": str(i), "title": f"T{i}", "space": {"key": "S"}, "body": {"view": {"value": f'<p>page {i}</p><img src="/pic_{i}.png" alt="a_b">'}}, "history": {"lastUpdated": {"when": "2024-01-15T10:00:00Z"}}}}


@pytest.mark.parametrize("total", [True, False])
def test_wiki_pages(spark, serving, total):
    asked = []

    def reply(path, body, headers):
        u = urllib.parse.urlsplit(path)
        if u.path.endswith(".png"):
            return 200, b"\x01"
        q = urllib.parse.parse_qs(u.query)
        start, limit = int(q["start"][0]), int(q["limit"][0])
        asked.append((start, limit, q["cql"][0], headers["Authorization"]))
        return 200, json.dumps({"results": [page(i) for i in range(start, min(205, start + limit))]} | ({"totalSize": 205} if total else {}))

    config = WikiConfig(serving(reply), "me", "word", WikiFilter(spaces=("S",)))
    got = {r["id"]: r for r in wiki.wiki_pages(spark, config).collect()}
    assert sorted(map(int, got)) == list(range(205)) and got["3"]["path"] == "S/T3" and got["3"]["text"].startswith("# T3\n\npage 3")
    assert {(0, 200), (200, 200)} <= {a[:2] for a in asked} and all("space in" in a[2] and a[3] == "Basic bWU6d29yZA==" for a in asked)
    assert wiki.downloader(config)("/pic_1.png") == b"\x01" and wiki.downloader(config)("http://127.0.0.1:1/x.png") is None
    with pytest.raises(Exception, match="secret"):
        wiki.wiki_pages(spark, WikiConfig(config.url, "me", "")).collect()


def test_command_line_with_wiki_and_pictures(spark, serving, tmp_path):
    vision = serving(lambda *a: (200, said("a red_chart")))

    def reply(path, body, headers):
        return (200, b"\x01") if urllib.parse.urlsplit(path).path.endswith(".png") else (200, json.dumps({"results": [page(1)], "totalSize": 1}))

    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.md").write_text("# Cats\nCats sleep.")
    (tmp_path / "c.json").write_text(json.dumps({"local_documents": str(tmp_path / "docs"), "wiki": {"url": serving(reply), "user": "u", "secret": "s", "filter": {"spaces": ["S"]}}, "vision": {"url": vision, "model": "v"}}))
    config, base = load_config(str(tmp_path / "c.json")), str(tmp_path / "store")
    assert {r["action"]: r["count"] for r in cli.index(spark, config, base).collect()} == {"new": 2}
    best = cli.query(spark, base, "page 1", RetrievalConfig()).first()
    assert best["path"] == "S/T1" and "red\\_chart" in best["preview"]
    assert {r["action"]: r["count"] for r in cli.index(spark, config, base).collect()} == {"skip": 2}
