"""HTML to Markdown for a batch of pages, on the standard library's parser."""

from __future__ import annotations

import re
from collections.abc import Callable
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A description of an image by its address and its alternative text; None or a failure leaves the image out.
Describe = Callable[[str, str], str | None]


class _Markdown(HTMLParser):
    def __init__(self, describe: Describe | None) -> None:
        super().__init__(convert_charrefs=True)
        self.describe = describe
        self.out: list[str] = []
        self.hidden = 0
        self.lists: list[list] = []
        self.link: list[tuple[str, int]] = []
        self.row: list[str] | None = None
        self.cell: int | None = None
        self.heads = 0
        self.pre = 0
        self.code = 0

    def gap(self, n: int = 2) -> None:
        text = "".join(self.out[-3:])
        have = len(text) - len(text.rstrip("\n"))
        if self.out and self.cell is None:
            self.out.append("\n" * max(0, n - have))

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("script", "style"):
            self.hidden += 1
        elif re.fullmatch("h[1-6]", tag):
            self.gap()
            self.out.append("#" * int(tag[1]) + " ")
        elif tag in ("p", "div", "section", "article", "table", "blockquote"):
            self.gap()
            if tag == "table":
                self.heads = 0
        elif tag in ("ul", "ol"):
            self.gap(1 if self.lists else 2)
            self.lists.append([tag, 0])
        elif tag == "li":
            self.gap(1)
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.out.append("  " * max(0, len(self.lists) - 1) + ("- " if kind[0] == "ul" else f"{kind[1]}. "))
        elif tag == "br":
            self.out.append("\n" if self.cell is None else " ")
        elif tag == "hr":
            self.gap()
            self.out.append("---")
            self.gap()
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "code" and not self.pre:
            self.code += 1
            self.out.append("`")
        elif tag == "pre":
            self.gap()
            self.pre += 1
            self.out.append("```\n")
        elif tag == "a":
            self.link.append((a.get("href") or "", len(self.out)))
        elif tag == "img":
            self.image(a.get("src") or "", a.get("alt") or "")
        elif tag == "tr":
            self.row = []
        elif tag in ("td", "th") and self.row is not None:
            self.cell = len(self.out)

    def image(self, src: str, alt: str) -> None:
        if self.describe is None:
            self.out.append(f"![{alt}]({src})")
            return
        try:
            said = (self.describe(src, alt) if src else alt) or alt
        except Exception:
            said = alt
        if said.strip():
            self.gap()
            self.out.append(f"[Изображение: {escaped(said.strip())}]")
            self.gap()

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif re.fullmatch("h[1-6]|p|div|section|article|blockquote", tag):
            self.gap()
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self.gap(1 if self.lists else 2)
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "code" and not self.pre:
            self.code = max(0, self.code - 1)
            self.out.append("`")
        elif tag == "pre" and self.pre:
            self.pre -= 1
            self.out.append("\n```")
            self.gap()
        elif tag == "a" and self.link:
            href, at = self.link.pop()
            text = "".join(self.out[at:]).strip()
            self.out[at:] = [f"[{text}]({href})" if href and text else text]
        elif tag in ("td", "th") and self.cell is not None and self.row is not None:
            self.row.append(" ".join("".join(self.out[self.cell :]).split()))
            del self.out[self.cell :]
            self.cell = None
        elif tag == "tr" and self.row is not None:
            if self.row:
                self.gap(1 if self.heads else 2)
                self.out.append("| " + " | ".join(self.row) + " |")
                if not self.heads:
                    self.out.append("\n| " + " | ".join("---" for _ in self.row) + " |")
                self.heads += 1
            self.row = None
        elif tag == "table":
            self.gap()

    def handle_data(self, data):
        if self.hidden:
            return
        if self.pre:
            self.out.append(data)
            return
        text = re.sub(r"\s+", " ", data)
        if text == " " and (not self.out or self.out[-1].endswith("\n")):
            return
        self.out.append(text if self.code else escaped(text))


def escaped(text: str) -> str:
    """Text whose stars and underscores are not marks."""
    return re.sub(r"([*_])", r"\\\1", text)


def to_markdown(html: str | None, describe: Describe | None = None) -> str:
    if not html:
        return ""
    parser = _Markdown(describe)
    parser.feed(html)
    parser.close()
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", "".join(parser.out))).strip()


def markdown(c: Column, describe: Describe | None = None) -> Column:
    @F.arrow_udf("string")
    def run(pages: pa.Array) -> pa.Array:
        return pa.array([to_markdown(p, describe) for p in pages.to_pylist()], pa.string())

    return run(c)
