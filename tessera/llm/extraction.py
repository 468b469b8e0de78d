"""HTML extraction with a recurrent block labeller.

A page is cut into its leaf blocks of text. Each block becomes a vector of its hashed tag path (tags,
classes, ids, roles), its hashed words and a few measures; a bidirectional LSTM in numpy reads the blocks of the whole
page in order and labels every block as article or not. The article's blocks are joined by two newlines.

The labeller is trained at each use, on the driver: on pages made here from a grammar of page parts, and on up to
`sample` real pages (the first by a hash of page_id, at most LONGEST blocks each) whose own markup names the article.

Defined results: a null or empty page, or one without article blocks, gives the empty text; repeated rows give
repeated rows; a null page_id or url stays null; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import html as htmllib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .kernels import SLICE, text_slices, word_hashes

PATH, WORDS, HIDDEN, SAMPLE, LONGEST = 192, 48, 24, 150, 150
WIDTH = PATH + WORDS + 6

#: Fixed values of HTML: elements that begin a block, that have no end, that close an open paragraph, and whose text isn't shown.
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TAGS = set("head iframe noscript object script style svg template title".split())
RAW = set("script style textarea title".split())
LISTS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WHITE = re.compile(r"\s+")
PIECES = re.compile(r"[a-z]+")


def blocks(page: str) -> list[tuple[tuple, str, int]]:
    """The leaf blocks of a page in order: path (a tuple of (tag, names)), text, characters inside links."""
    out: list[tuple[tuple, str, int]] = []
    stack: list[tuple[str, str]] = []
    text: list[str] = []
    linked, links, hidden, at, path = 0, 0, 0, 0, ()

    def flush() -> None:
        nonlocal linked
        if text:
            clean = WHITE.sub(" ", "".join(text)).strip()
            if clean:
                out.append((path, clean, min(linked, len(clean))))
            text.clear()
        linked = 0

    def words(piece: str) -> None:
        nonlocal linked, path
        if piece and not hidden:
            piece = htmllib.unescape(piece)
            if not text or not "".join(text).strip():
                path = tuple(x for x in stack if x[0] in BLOCKS or x[1])
            text.append(piece)
            if links:
                linked += len(piece)

    def pop(to: int) -> None:
        nonlocal links, hidden
        for tag, _ in stack[to:]:
            links -= tag == "a"
            hidden -= tag in HIDDEN_TAGS
        del stack[to:]

    while True:
        m = TAG.search(page, at)
        words(page[at : m.start()] if m else page[at:])
        if not m:
            break
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            if m[0].startswith("<![CDATA["):
                words(m[0][9:].removesuffix("]]>"))
            continue
        tag, attributes = tag.lower(), m[3] if m[2] else m[6]
        if tag in BLOCKS:
            flush()
        elif tag == "br":
            text.append(" ")
        if m[1] or m[4]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if tag not in BLOCKS and any(x[0] in BLOCKS for x in stack[k + 1 :]):
                        break  # an inline end doesn't close blocks
                    pop(k)
                    break
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            if tag == "textarea":
                stack.append((tag, ""))
                flush()
                words(page[at : end.start() if end else len(page)])
                flush()
                stack.pop()
            at = end.end() if end else len(page)
            continue
        if tag in BLOCKS:
            if tag == "body":
                k = next((i for i, x in enumerate(stack) if x[0] == "head"), None)
                if k is not None:
                    pop(k)
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6") and (stack[k][0] == "p" or tag[0] == "h"):
                    pop(k)
                    break
                if stack[k][0] in BLOCKS:
                    break
            if tag in LISTS:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag or tag in ("dt", "dd") and stack[k][0] in ("dt", "dd") or tag in ("td", "th") and stack[k][0] in ("td", "th"):
                        pop(k)
                        break
                    if stack[k][0] in LISTS[tag]:
                        break
        if tag in VOID or attributes.rstrip().endswith("/") and tag not in BLOCKS:
            continue
        names = ""
        if attributes:
            names = " ".join(PIECES.findall(" ".join(a or b or c for _, a, b, c in ATTRIBUTE.findall(attributes)).lower()))
        stack.append((tag, names))
        links += tag == "a"
        hidden += tag in HIDDEN_TAGS
    flush()
    return out


_paths: dict[tuple, np.ndarray] = {}


def path_vector(path: tuple) -> np.ndarray:
    """Hashed tags, tag pairs and words of class, id and role along a path."""
    v = _paths.get(path)
    if v is None:
        keys, before = [], "^"
        for tag, names in path:
            keys += [tag, f"{before}>{tag}", *(f".{x}" for x in names.split())]
            before = tag
        keys.append(f"{before}$")
        v = np.zeros(PATH, np.float32)
        for k in keys:
            v[zlib.crc32(k.encode()) % PATH] = 1
        if len(_paths) > 20_000:
            _paths.clear()
        _paths[path] = v
    return v


def vectors(pages: list[list[tuple[tuple, str, int]]]) -> np.ndarray:
    """One row per block of all pages."""
    flat = [b for p in pages for b in p]
    if not flat:
        return np.zeros((0, WIDTH), np.float32)
    out = np.zeros((len(flat), WIDTH), np.float32)
    for i, (path, _, _) in enumerate(flat):
        out[i, :PATH] = path_vector(path)
    h, first = word_hashes(pa.array([t for _, t, _ in flat]))
    n = np.diff(first)
    counts = np.bincount(np.repeat(np.arange(len(flat)), n) * WORDS + (h % np.uint64(WORDS)).astype(np.int64), minlength=len(flat) * WORDS).reshape(-1, WORDS)
    out[:, PATH : PATH + WORDS] = counts / np.sqrt(np.maximum(1, (counts * counts).sum(axis=1, keepdims=True)))
    size = np.array([len(t) for _, t, _ in flat])
    out[:, -6] = np.log1p(size) / 8
    out[:, -5] = np.array([k for _, _, k in flat]) / size
    out[:, -4] = np.array([t[-1] in ".!?:;" for _, t, _ in flat])
    out[:, -3] = np.log1p(n) / 6
    out[:, -2] = np.concatenate([np.linspace(0, 1, len(p)) for p in pages if p])
    out[:, -1] = np.concatenate([np.full(len(p), 1 / len(p)) for p in pages if p])
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def begin(seed: int = 5) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    p = {}
    for d in "fb":
        p[f"{d}x"] = r.normal(0, 0.1, (WIDTH, 4 * HIDDEN)).astype(np.float32)
        p[f"{d}h"] = r.normal(0, 0.15, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
        p[f"{d}b"] = np.zeros(4 * HIDDEN, np.float32)
        p[f"{d}b"][HIDDEN : 2 * HIDDEN] = 1
    p["o"], p["ob"] = r.normal(0, 0.1, 2 * HIDDEN).astype(np.float32), np.zeros(1, np.float32)
    return p


def run_lstm(z: np.ndarray, wh: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states (time, page, HIDDEN) of one direction; z: inputs already projected."""
    steps, n, _ = z.shape
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    out = np.zeros((steps, n, HIDDEN), np.float32)
    for t in range(steps):
        a = z[t] + h @ wh
        s = sigmoid(a[:, : 3 * HIDDEN])
        i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(a[:, 3 * HIDDEN :])
        new = f * c + i * g
        th = np.tanh(new)
        m = mask[t][:, None]
        if keep is not None:
            keep.append((h, c, i, f, o, g, th, m))
        c, h = np.where(m, new, c), np.where(m, o * th, h)
        out[t] = h
    return out


def back_lstm(grad: np.ndarray, wh: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs and of the recurrent weights."""
    steps, n, _ = grad.shape
    dz, dw = np.zeros((steps, n, 4 * HIDDEN), np.float32), np.zeros_like(wh)
    dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, g, th, m = kept[t]
        dh = dh + grad[t]
        own, pass_h, pass_c = np.where(m, dh, 0), np.where(m, 0, dh), np.where(m, 0, dc)
        dcell = np.where(m, dc, 0) + own * o * (1 - th * th)
        da = np.concatenate([dcell * g * i * (1 - i), dcell * c * f * (1 - f), own * th * o * (1 - o), dcell * i * (1 - g * g)], axis=1)
        dz[t] = da
        dw += h.T @ da
        dh, dc = da @ wh.T + pass_h, dcell * f + pass_c
    return dz, dw


def padded(rows: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(sizes)
    x, mask = np.zeros((steps, len(sizes), rows.shape[1]), np.float32), np.zeros((steps, len(sizes)), bool)
    at = 0
    for k, n in enumerate(sizes):
        x[:n, k], mask[:n, k] = rows[at : at + n], True
        at += n
    return x, mask


def forward(p: dict, rows: np.ndarray, sizes: list[int], keep: tuple | None = None):
    """Logits (time, page); sequences are padded at their ends, which the mask skips."""
    proj = {d: rows @ p[f"{d}x"] + p[f"{d}b"] for d in "fb"}
    zf, mask = padded(proj["f"], sizes)
    zb, _ = padded(proj["b"], sizes)
    hf = run_lstm(zf, p["fh"], mask, keep[0] if keep else None)
    hb = run_lstm(zb[::-1], p["bh"], mask[::-1], keep[1] if keep else None)[::-1]
    return hf @ p["o"][:HIDDEN] + hb @ p["o"][HIDDEN:] + p["ob"], mask, hf, hb


def train(pages: list[list], labels: list[list[int]], passes: int = 12, batch: int = 24, rate: float = 0.01) -> dict[str, np.ndarray]:
    p = begin()
    first, second = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    some = [i for i in range(len(pages)) if pages[i]]
    rows = {i: vectors([pages[i]]) for i in some}
    pick, step = np.random.default_rng(3), 0
    for turn in range(passes):
        own_rate = rate * (1 - 0.9 * turn / passes)
        order = sorted(pick.permutation(some).tolist(), key=lambda i: len(pages[i]) // 8)
        groups = [order[a : a + batch] for a in range(0, len(order), batch)]
        for g in pick.permutation(len(groups)):
            own = groups[g]
            sizes = [len(pages[i]) for i in own]
            x = np.concatenate([rows[i] for i in own])
            kept: tuple = ([], [])
            logit, mask, hf, hb = forward(p, x, sizes, kept)
            y, _ = padded(np.concatenate([np.array(labels[i], np.float32) for i in own])[:, None], sizes)
            d = np.where(mask, sigmoid(logit) - y[:, :, 0], 0).astype(np.float32) / mask.sum()
            grad = {"o": np.concatenate([np.einsum("tn,tnh->h", d, hf), np.einsum("tn,tnh->h", d, hb)]), "ob": np.array([d.sum()], np.float32)}
            dzf, grad["fh"] = back_lstm(d[:, :, None] * p["o"][:HIDDEN], p["fh"], kept[0])
            dzb, grad["bh"] = back_lstm((d[:, :, None] * p["o"][HIDDEN:])[::-1], p["bh"], kept[1])
            dzb = dzb[::-1]
            for k, dz in (("f", dzf), ("b", dzb)):
                flat = np.concatenate([dz[:n, i] for i, n in enumerate(sizes)])
                grad[f"{k}x"], grad[f"{k}b"] = x.T @ flat, flat.sum(axis=0)
            step += 1
            for k, gr in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * gr
                second[k] = 0.999 * second[k] + 0.001 * gr * gr
                p[k] = p[k] - own_rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-7)
    return p


def label(p: dict, pages: list[list]) -> list[np.ndarray]:
    """For each page, which blocks belong to the article."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
    a = 0
    while a < len(order):
        e = a + 1
        while e < len(order) and e - a < 128 and len(pages[order[e]]) * (e - a + 1) <= 8192:
            e += 1
        own = order[a:e]
        sizes = [len(pages[i]) for i in own]
        logit, *_ = forward(p, vectors([pages[i] for i in own]), sizes)
        for k, i in enumerate(own):
            out[i] = logit[: sizes[k], k] > 0
        a = e
    return out


#: Names of page parts for the grammar, as they are common on the web.
ASIDE = {
    "nav": "nav menu navbar breadcrumb topnav navigation links topmenu", "header": "header masthead banner top sitehead logo", "footer": "footer bottom copyright legal colophon",
    "aside": "sidebar aside widget related popular rail recommended leftcol rightcol side right left", "div": "ad ads advert sponsored promo banner cookie notice consent popup newsletter subscribe share social sharing",
    "form": "search login signup form contact", "section": "comments comment respond replies discussion reviews",
}
ARTICLE = "article content main post entry story body text article-body entry-content post-content page-content maincol maincontent center"


def made_page(r: random.Random) -> tuple[list, list[int]]:
    """A page from the grammar, as blocks with labels: a shell of named, unnamed or table cells, parts around an article, and parts within it."""
    syllables = [a + b for a in "b c d f g l m n p r s t v th st er".split() for b in "a e i o u an en or".split()]
    often = ["".join(r.choice(syllables) for _ in range(r.randint(1, 2))) for _ in range(r.choice([3, 8, 20]))]  # a page's own frequent words
    usual = r.choice([0.0, 0.3, 0.6])
    word = lambda: r.choice(often) if r.random() < usual else "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    say = lambda a, b: (" ".join(word() for _ in range(r.randint(a, b))).capitalize() + r.choice([".", ".", ".", "", "!"]))
    out: list[tuple[tuple, str, int]] = []
    y: list[int] = []
    top = r.choice([(("html", ""),), ()]) + (("body", r.choice(["", "", "home", "page"])),)
    shell = top + r.choice([(), (), (("div", r.choice(["wrap", "container", "page", "site"])),)])
    style = r.choice(["tags", "tags", "divs", "divs", "table"])  # what the page's parts are made of
    if style == "table":
        shell += (("table", r.choice(["", "layout"])), ("tr", ""))
    plain = r.random() < 0.5 if style != "tags" else False  # paragraphs are divisions as well

    def add(path, text, linked, good):
        out.append((path, text, linked))
        y.append(good)

    def part(kind: str, inside: tuple = ()) -> None:
        names = r.choice(ASIDE[kind].split())
        tag = "td" if style == "table" and not inside else "div" if style == "divs" or r.random() > 0.6 else kind
        path = (inside or shell) + ((tag, names if tag == "div" or kind == "section" or r.random() < 0.5 else ""),)
        if kind in ("nav", "aside", "header", "footer") and r.random() < 0.75:
            heading = kind == "aside" and r.random() < 0.5
            if heading:
                add(path + ((r.choice(["h2", "h3", "h4", "div"]), ""),), say(1, 3), 0, 0)
            listed = r.choice([(("ul", ""), ("li", "")), (("ul", ""), ("li", "")), (("div", ""),), ()]) if plain or style == "table" else (("ul", ""), ("li", ""))
            if listed == ():
                t = " ".join(say(1, 2).strip(".!") for _ in range(r.randint(2, 6)))
                add(path, t, len(t), 0)
            else:
                for _ in range(r.randint(2, 9)):
                    t = say(1, 4)
                    add(path + listed, t, len(t), 0)
        else:
            if kind == "section" and r.random() < 0.7:
                add(path + ((r.choice(["h2", "h2", "h3"]), ""),), say(1, 3), 0, 0)
            for _ in range(r.randint(1, 6 if kind == "section" else 2)):
                t = say(2, 40 if kind == "section" else 16)
                add(path + r.choice([(), (("p", ""),), (("div", r.choice(["item", "comment", "box", ""])), ("p", ""))]), t, len(t) if kind == "div" and r.random() < 0.3 else 0, 0)

    for kind in r.sample(["header", "nav", "div", "div", "aside"], r.randint(1, 4)):
        part(kind)
    if r.random() < 0.95:
        name = r.choice(ARTICLE.split()).replace("-", " ")
        tag = "td" if style == "table" else "div" if style == "divs" else r.choice(["article", "article", "main", "div", "section"])
        path = shell + (r.choice([(), (("main", ""),)]) if style == "tags" else ()) + ((tag, "" if tag in ("article", "main") and r.random() < 0.6 else name),)
        if r.random() < 0.8:
            tag = r.choice(["h1", "h1", "div" if plain else "h1", "div" if plain else "h2"])
            add(path + ((tag, r.choice(["", "title", "headline", "title", "heading"]) if tag == "div" else ""),), say(1, 10), 0, 1)
        paragraph = r.choice([(("div", ""),), ()]) if plain and r.random() < 0.6 else (("p", ""),)
        for _ in range(r.choice([1, 2, 3, 5, 8, 14, 25])):
            if r.random() < 0.08:
                part(r.choice(["div", "div", "form", "aside"]), path)
            kind = r.random()
            t = say(1, r.choice([2, 6, 20, 90])) if paragraph else say(8, 90)
            if kind < 0.8:
                add(path + paragraph, t, r.choice([0, 0, 0, len(t) // 5]), 1)
            elif kind < 0.87:
                add(path + ((r.choice(["h2", "h3", "blockquote", "pre"]), ""),), t, 0, 1)
            elif kind < 0.94:
                for _ in range(r.randint(1, 4)):
                    add(path + ((r.choice(["ul", "ol"]), ""), ("li", "")), say(1, 12), 0, 1)
            else:
                for i in range(r.randint(2, 5)):
                    for _ in range(r.randint(2, 4)):
                        add(path + (("table", r.choice(["", "data"])), ("tr", ""), ("th" if not i and r.random() < 0.7 else "td", "")), r.choice([say(1, 4), str(r.randint(1, 9999))]), 0, 1)
    for kind in r.sample(["footer", "footer", "aside", "section", "div", "form"], r.randint(1, 4)):
        part(kind)
    return out, y


def own_labels(page: list) -> list[int] | None:
    """Labels of a page whose markup has the elements that name an article, else None: what these elements hold, apart from elements that are never part of one."""
    if not any(tag in ("article", "main") for path, _, _ in page for tag, _ in path):
        return None
    out = []
    for path, _, _ in page:
        tags = [tag for tag, _ in path]
        inner = tags[max((i for i, t in enumerate(tags) if t in ("article", "main")), default=len(path)) :]
        out.append(int(bool(inner) and not {"nav", "aside", "footer", "form", "button", "select"} & set(inner)))
    return out


def fit(pages: DataFrame, sample: int = SAMPLE, made: int = 1500) -> dict[str, np.ndarray]:
    """Trains the labeller; at most `sample` rows reach the driver."""
    usable, order = pages.filter(F.col("html").isNotNull() & (F.length("html") < 200_000)), [F.xxhash64("page_id"), F.col("page_id")]
    ids = [x[0] for x in usable.orderBy(*order).select("page_id").limit(sample).collect()]  # ids alone first, so that tasks send no pages which aren't taken
    named = F.col("page_id").isin([x for x in ids if x is not None])
    rows = usable.filter(named | F.col("page_id").isNull() if None in ids else named).orderBy(*order).select("html").limit(sample).collect()
    r = random.Random(11)
    xs, ys = map(list, zip(*(made_page(r) for _ in range(made)), strict=True))
    for row in rows:
        page = blocks(row["html"])
        y = own_labels(page)
        if page and len(page) <= LONGEST and y is not None:
            xs.append(page)
            ys.append(y)
    return train(xs, ys)


def extract(pages: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    sent = pages.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights

    def run(batches):
        p = sent.value
        for b in batches:
            html = b.column(2)
            for a, e in text_slices(html, SLICE, 512):
                parsed = [blocks(x.as_py() or "") for x in html.slice(a, e - a)]
                texts = ["\n\n".join(t for (_, t, _), k in zip(page, keep, strict=True) if k) for page, keep in zip(parsed, label(p, parsed), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, e - a), b.column(1).slice(a, e - a), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return extract(pages, fit(pages))
