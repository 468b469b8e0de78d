"""Clients for chat models behind the usual HTTP interface, with timeouts, retries and a bound on calls at a time.

A client is a plain value: it goes to the workers with a column and opens its connections there.
"""

from __future__ import annotations

import base64
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

IMAGE_PROMPT = "Describe the picture in one paragraph: what a chart or diagram shows, what a screenshot is of."


def post(url: str, body: dict, key: str | None = None, timeout: float = 60, tries: int = 3, wait: float = 0.5):
    """The open response to a JSON request; busy servers (429, 5xx) and broken connections are asked again."""
    head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    for left in range(tries - 1, -1, -1):
        try:
            return urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), head), timeout=timeout)
        except urllib.error.HTTPError as e:
            if not left or e.code != 429 and e.code < 500:
                raise
        except OSError:
            if not left:
                raise
        time.sleep(wait)
        wait *= 2
    raise AssertionError


def pieces(lines: Iterator[bytes]) -> Iterator[str]:
    """The text pieces of server-sent frames up to the end mark; other lines, bad JSON and empty pieces are left out."""
    for raw in lines:
        line = raw.decode("utf-8", "replace").rstrip("\r\n")
        if not line.startswith("data: "):
            continue
        if line[6:].strip() == "[DONE]":
            return
        try:
            found = json.loads(line[6:])["choices"][0]["delta"].get("content")
        except (ValueError, KeyError, IndexError, TypeError, AttributeError):
            continue
        if found:
            yield found


@dataclass(frozen=True)
class ChatClient:
    """complete, complete_json, complete_vision and stream take a user's text or a list of messages."""

    url: str
    model: str
    key: str = "none"
    temperature: float = 0.0
    max_tokens: int | None = None
    timeout: float = 60
    tries: int = 3
    workers: int = 8

    def ask(self, messages: str | list[dict], **more) -> dict:
        return {"model": self.model, "messages": [{"role": "user", "content": messages}] if isinstance(messages, str) else messages, "temperature": self.temperature} | ({"max_tokens": self.max_tokens} if self.max_tokens else {}) | more

    def send(self, body: dict, timeout: float | None = None):
        return post(f"{self.url.rstrip('/')}/chat/completions", body, self.key, timeout or self.timeout, self.tries)

    def complete(self, messages: str | list[dict], **more) -> str:
        """The answer's text, empty if there is none."""
        with self.send(self.ask(messages, **more)) as r:
            return json.load(r)["choices"][0]["message"]["content"] or ""

    __call__ = complete

    def complete_json(self, messages: str | list[dict]) -> dict:
        """An answer in JSON, {} if there is none; other text is a ValueError."""
        return json.loads(self.complete(messages, response_format={"type": "json_object"}) or "{}")

    def complete_vision(self, prompt: str, image: bytes, media_type: str = "image/png") -> str:
        data = f"data:{media_type};base64,{base64.b64encode(image).decode()}"
        return self.complete([{"role": "user", "content": [{"type": "image_url", "image_url": {"url": data}}, {"type": "text", "text": prompt}]}], temperature=0.0)

    def stream(self, messages: str | list[dict]) -> Iterator[str]:
        """The answer piece by piece."""
        with self.send(self.ask(messages, stream=True), 2 * self.timeout) as r:
            yield from pieces(iter(r))

    def complete_all(self, prompts: list[str]) -> list[str]:
        """The answers in the prompts' order, `workers` calls at a time."""
        with ThreadPoolExecutor(self.workers) as pool:
            return list(pool.map(self.complete, prompts))


def completions(c: Column, client: ChatClient, otherwise: str | None = None) -> Column:
    """Answers to a column of prompts, each batch with `client.workers` calls at a time; with `otherwise` a failed call gives that text."""

    def one(prompt: str) -> str:
        try:
            return client.complete(prompt)
        except Exception:
            if otherwise is None:
                raise
            return otherwise

    @F.arrow_udf("string")
    def run(prompts: pa.Array) -> pa.Array:
        with ThreadPoolExecutor(client.workers) as pool:
            return pa.array(list(pool.map(one, prompts.to_pylist())), pa.string())

    return run(c)


def describer(client: ChatClient, download: Callable[[str], bytes | None], guess: Callable[[str], str]) -> Callable[[str, str], str | None]:
    """A function from an image's address and alt text to its description: the alt text where the picture can't be had or described."""

    def describe(src: str, alt: str) -> str | None:
        picture = download(src) if src else None
        if picture:
            try:
                return client.complete_vision(IMAGE_PROMPT, picture, guess(src)).strip() or None
            except Exception:
                pass
        return alt or None

    return describe
