"""Representation services over HTTP: the server side of both models, and the clients that columns use.

Dense: POST /v1/embeddings {"input": text or texts, "encoding_format": "base64"} gives {"data": [{"embedding": base64 of 32-bit floats}]}.
Sparse: POST /encode {"text": text} gives {"token_weights": [{token: weight}]}. GET /health says whether the service is up.
"""

from __future__ import annotations

import base64
import json
import urllib.request
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np

from tessera.models import post
from tessera.operators.embed import Embed, Weigh


def server(port: int, embed: Embed | None = None, weigh: Weigh | None = None, name: str = "model", host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server of one model or both; serve_forever() runs it, server_address has the port if 0 was given."""

    class Handler(BaseHTTPRequestHandler):
        def reply(self, code: int, body: dict) -> None:
            data = json.dumps(body).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            self.reply(200, {"status": "ok", "model": name}) if self.path == "/health" else self.reply(404, {"error": "no such path"})

        def do_POST(self) -> None:
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))))
                if self.path == "/v1/embeddings" and embed:
                    texts = [body["input"]] if isinstance(body["input"], str) else body["input"]
                    plain = body.get("encoding_format", "float") != "base64"
                    rows = [[float(x) for x in v] if plain else base64.b64encode(np.asarray(v, "<f4").tobytes()).decode() for v in embed(texts)]
                    self.reply(200, {"model": name, "data": [{"index": i, "embedding": v} for i, v in enumerate(rows)]})
                elif self.path == "/encode" and weigh:
                    self.reply(200, {"token_weights": weigh([body["text"]])})
                else:
                    self.reply(404, {"error": "no such path"})
            except (ValueError, KeyError, TypeError) as e:
                self.reply(422, {"error": str(e)})

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def healthy(url: str, timeout: float = 5) -> bool:
    try:
        with urllib.request.urlopen(f"{url.rstrip('/')}/health", timeout=timeout) as r:
            return json.load(r).get("status") == "ok"
    except (OSError, ValueError):
        return False


def dense_service(url: str, timeout: float = 30, tries: int = 3) -> Embed:
    """A dense model behind the service."""

    def run(texts: list[str]) -> list[list[float]]:
        with post(f"{url.rstrip('/')}/v1/embeddings", {"input": texts, "encoding_format": "base64"}, timeout=timeout, tries=tries) as r:
            rows = sorted(json.load(r)["data"], key=lambda x: x.get("index", 0))
        return [np.frombuffer(base64.b64decode(x["embedding"]), "<f4").tolist() for x in rows]

    return run


def sparse_service(url: str, timeout: float = 30, tries: int = 3) -> Weigh:
    """A sparse model behind the service."""

    def one(text: str) -> dict[str, float]:
        with post(f"{url.rstrip('/')}/encode", {"text": text}, timeout=timeout, tries=tries) as r:
            return json.load(r)["token_weights"][0]

    return lambda texts: [one(t) for t in texts]
