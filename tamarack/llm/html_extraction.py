"""Main text of web pages by a tree-structured graphical model over the DOM.

Every node of a page's tree is a variable: a text is content or not, an element holds content or
not. Potentials of a node come from its name, its class words and the shape of what it holds,
potentials of an edge from the labels of parent and child. Marginals are exact: messages go once
upward and once downward (sum-product). Weights are fitted to labelled pages by gradient of the
likelihood, which takes the same messages.
"""

from __future__ import annotations

import difflib
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, materialize, read_table
from .html_tree import BLOCK, Tree, blocks_of, parse

#: Pages that a model is fitted to at most, and the bytes of each at most.
MOST_PAGES, MOST_BYTES = 600, 60_000
#: Steps of the gradient, their rate, and the weight of the penalty.
STEPS, RATE, PENALTY = 120, 0.15, 1e-3

# Elements whose text is never the article's.
NEVER = frozenset("head title script style noscript template textarea select option button object svg canvas audio video dialog input nav footer".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|#hidden")
_SENTENCE = re.compile(r"[.!?。！？…:;]")
_BINS = 12
#: Numbers that describe every node: they come before the learned words of tags and names.
_SHAPES = {"size": _BINS, "own": _BINS, "links": 5, "sentences": 5, "before": 5, "texts": 6, "leaf": 3, "depth": 6}
_FIRST = dict(zip(_SHAPES, np.cumsum([0, *_SHAPES.values()][:-1]).tolist(), strict=True))
_SHAPED = sum(_SHAPES.values())
_KINDS = 4  # of edges: to a text, an inline element, a block, a block that holds no text


def name_words(tag: str, names: str) -> list[str]:
    """What a node's name and its class, id and role say: whole words and their beginnings."""
    words = {w.lower() for w in _WORD.findall(names)}
    return [f"<{tag}>", *words, *{f"{w[:4]}-" for w in words if len(w) > 4}]


@dataclass
class Forest:
    """Trees of several pages as arrays; nodes of one depth are found together."""

    parent: np.ndarray
    depth: np.ndarray
    kind: np.ndarray
    never: np.ndarray
    row: np.ndarray  # features: node and feature
    column: np.ndarray
    first: np.ndarray  # the first node of each page
    levels: list[np.ndarray] = field(default_factory=list)


def _bin(x: np.ndarray, most: int) -> np.ndarray:
    return np.minimum(np.log2(x + 1).astype(np.int64), most - 1)


def forest(trees: list[Tree], vocabulary: dict[str, int]) -> Forest:
    sizes = [len(t.tag) for t in trees]
    first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    n = int(first[-1])
    parent = np.concatenate([np.array(t.parent, np.int64) + (a if a else 0) for t, a in zip(trees, first, strict=False)]) if trees else np.zeros(0, np.int64)
    parent[first[:-1]] = -1
    depth = np.concatenate([np.array(t.depth, np.int64) for t in trees]) if trees else np.zeros(0, np.int64)
    leaf, length, linked, stops, never, block = (np.zeros(n, np.int64) for _ in range(6))
    rows, columns, known = [], [], {}
    for tree, a in zip(trees, first.tolist(), strict=False):
        inside = [False] * len(tree.tag)  # a link
        dead = [False] * len(tree.tag)
        for i, (tag, names, text, up) in enumerate(zip(tree.tag, tree.names, tree.text, tree.parent, strict=True)):
            if up >= 0:
                inside[i], dead[i] = inside[up] or tag == "a", dead[up] or tag in NEVER
            if text is not None:
                leaf[a + i], length[a + i], stops[a + i] = 1, len(text), len(_SENTENCE.findall(text))
                linked[a + i] = len(text) if inside[i] else 0
            else:
                block[a + i] = tag in BLOCK
                key = tag, names
                if key not in known:
                    known[key] = [vocabulary[w] for w in name_words(tag, names) if w in vocabulary]
                for c in known[key]:
                    rows.append(a + i)
                    columns.append(c)
            never[a + i] = dead[i]
    alive = (leaf == 1) & (never == 0)
    total = np.where(alive, length, 0)
    own = total.copy()
    links, ends, texts = np.where(alive, linked, 0), np.where(alive, stops, 0), alive.astype(np.int64)
    order = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[order], np.arange(int(depth.max(initial=0)) + 2))
    levels = [order[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    for level in reversed(levels[1:]):
        for x in (total, links, ends, texts):
            np.add.at(x, parent[level], x[level])
    whole = total[first[:-1]] if len(trees) else total
    page = np.repeat(np.arange(len(trees)), sizes)
    before = np.cumsum(own) - own
    before = (before - before[first[:-1]][page]) / np.maximum(whole[page], 1) if n else before
    share = lambda a, b, m: np.minimum((m * a / np.maximum(b, 1)).astype(np.int64), m - 1)
    shapes = {
        "size": _bin(total, _BINS), "own": np.where(leaf == 1, _bin(length, _BINS), 0), "links": share(links, total, 5), "sentences": share(40 * ends, total, 5), "before": share(before, np.ones(n), 5),
        "texts": _bin(texts, 6), "leaf": np.where(leaf == 1, np.where(linked > 0, 2, 1), 0), "depth": np.minimum(depth // 2, 5),
    }
    kind = np.where(leaf == 1, 0, np.where(block == 0, 1, np.where(total > 0, 2, 3)))
    row = np.concatenate([np.tile(np.arange(n), len(shapes)), np.array(rows, np.int64)])
    column = np.concatenate([*[v + _FIRST[k] for k, v in shapes.items()], np.array(columns, np.int64)])
    return Forest(parent, depth, kind, never == 1, row, column, first, levels)


@dataclass
class Model:
    """Weights of node features (for "content" against "not") and of edges by kind, parent's and child's label."""

    vocabulary: dict[str, int]
    weights: np.ndarray
    edges: np.ndarray


def _log_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def marginals(model: Model, f: Forest) -> tuple[np.ndarray, np.ndarray]:
    """(each node's probability of label 1, each node's 2 x 2 table with its parent: parent's label first)."""
    n = len(f.parent)
    up = np.zeros((n, 2))
    up[:, 1] = np.bincount(f.row, model.weights[f.column], n) if n else 0
    up[f.never, 1] = -1e4
    sent = np.zeros((n, 2))
    edges = model.edges[f.kind]
    for level in reversed(f.levels[1:]):
        sent[level] = _log_sum(edges[level, :, 0] + up[level, 0, None], edges[level, :, 1] + up[level, 1, None])
        sent[level] -= sent[level].max(1, keepdims=True)
        np.add.at(up, f.parent[level], sent[level])
    belief, pairs = up.copy(), np.zeros((n, 2, 2))
    for level in f.levels[1:]:
        rest = belief[f.parent[level]] - sent[level]
        rest -= rest.max(1, keepdims=True)
        belief[level] += _log_sum(edges[level, 0] + rest[:, 0, None], edges[level, 1] + rest[:, 1, None])
        table = edges[level] + rest[:, :, None] + up[level, None, :]
        table = np.exp(table - table.max((1, 2), keepdims=True))
        pairs[level] = table / table.sum((1, 2), keepdims=True)
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700))), pairs


def node_labels(tree: Tree, text: str) -> list[bool]:
    """Labels of a page whose main text is known, blocks on lines of their own: a text's block is
    matched to a line, in order; an element holds content if a text in it does."""
    parts: dict[int, str] = {}
    for i, t in enumerate(tree.text):
        if t is not None:
            parts[tree.block[i]] = parts.get(tree.block[i], "") + t
    numbers = list(parts)
    own = [" ".join(parts[b].split()) for b in numbers]
    lines = [" ".join(x.split()) for x in (text or "").split("\n") if x.strip()]
    met = set()
    for m in difflib.SequenceMatcher(None, own, lines, autojunk=False).get_matching_blocks():
        met.update(numbers[m.a : m.a + m.size])
    labels = [t is not None and b in met for t, b in zip(tree.text, tree.block, strict=True)]
    for i in range(len(labels) - 1, 0, -1):
        if labels[i]:
            labels[tree.parent[i]] = True
    return labels


def fit(labelled: DataFrame, most: int = MOST_PAGES, most_bytes: int = MOST_BYTES) -> Model | None:
    """A model of labelled pages (html, text), text being the main text with a block a line. At most
    ``most`` pages of at most ``most_bytes`` each are used, picked by a hash of the page; null html
    and longer pages are left out. None without any."""
    usable = labelled.where((F.octet_length("html") > 0) & (F.octet_length("html") <= most_bytes))
    sample = usable.select("html", "text").orderBy(F.xxhash64("html", "text"), "html", "text").limit(most).collect()  # bounded by both parameters
    trees = [parse(r.html) for r in sample]
    if not trees:
        return None
    seen: dict[str, int] = {}
    for t in trees:
        for w in {w for tag, names in set(zip(t.tag, t.names, strict=True)) if tag != "#text" for w in name_words(tag, names)}:
            seen[w] = seen.get(w, 0) + 1
    vocabulary = {w: _SHAPED + i for i, w in enumerate(sorted(w for w, k in seen.items() if k >= 2))}
    f = forest(trees, vocabulary)
    y = np.concatenate([np.array(node_labels(t, r.text), np.int64) for t, r in zip(trees, sample, strict=True)])
    y[f.never] = 0
    has = f.parent >= 0
    wanted = np.zeros((_KINDS, 2, 2))
    np.add.at(wanted, (f.kind[has], y[f.parent[has]], y[has]), 1)
    model = Model(vocabulary, np.zeros(_SHAPED + len(vocabulary)), np.zeros((_KINDS, 2, 2)))
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (model.weights, model.edges)]
    for step in range(1, STEPS + 1):
        p, pairs = marginals(model, f)
        free = ~f.never[f.row]
        grown = np.bincount(f.column[free], (y - p)[f.row[free]], len(model.weights)) / len(trees) - PENALTY * model.weights
        have = np.zeros((_KINDS, 2, 2))
        np.add.at(have, f.kind[has], pairs[has])
        steps = (grown, (wanted - have) / len(trees) - PENALTY * model.edges)
        for value, slope, (m, v) in zip((model.weights, model.edges), steps, moments, strict=True):
            m += 0.1 * (slope - m)
            v += 0.01 * (slope * slope - v)
            value += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def content(model: Model, pages: list[str]) -> list[tuple[list[str], list[float]]]:
    """(texts of the main blocks, their marginals) of each page. A text counts from a marginal of 0.5."""
    trees = [parse(p) for p in pages]
    f = forest(trees, model.vocabulary)
    p = marginals(model, f)[0]
    out = []
    for tree, a, b in zip(trees, f.first, f.first[1:], strict=False):
        own = p[a:b]
        kept = [t is not None and x >= 0.5 for t, x in zip(tree.text, own, strict=True)]
        chances: dict[int, float] = {}
        for i, k in enumerate(kept):
            if k and tree.text[i].strip():
                chances[tree.block[i]] = min(chances.get(tree.block[i], 1.0), float(own[i]))
        out.append((blocks_of(tree, kept), list(chances.values())))
    return out


# --- labelled pages ---------------------------------------------------------------------
# Class words of parts of a page, and the elements that they are found on.
_PARTS = {
    "menu": (["nav", "div", "ul"], "nav menu navbar navigation topnav breadcrumb breadcrumbs pagination pager toc main-menu site-nav"),
    "header": (["header", "div"], "header site-header masthead banner top branding page-header"),
    "footer": (["footer", "div"], "footer site-footer bottom colophon copyright page-footer"),
    "side": (["aside", "div"], "sidebar side widget widget-area aside rail secondary"),
    "ad": (["div", "aside", "section", "ins"], "ad ads advert advertisement sponsor sponsored promo promotion ad-slot banner-ad"),
    "notice": (["div", "section", "aside"], "notice cookie-notice cookie-banner consent gdpr alert modal popup newsletter paywall subscribe"),
    "comments": (["section", "div", "ol", "ul"], "comments comment-list comments-area discussion responses replies reader-comments"),
    "more": (["div", "aside", "section", "ul"], "related share social recommended tags more-stories read-next author-box"),
}
_MAIN = "content article post entry story main body text post-content entry-content article-body story-text main-content"


def compose(texts: list[str], seed: int) -> tuple[str, str]:
    """A page in one of many layouts around these texts, and its main text. Longer texts are the
    article's paragraphs, shorter ones and pieces fill the rest."""
    rng = random.Random(seed)
    words = " ".join(texts).split() or ["text", "of", "a", "page"]
    escape = lambda t: t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    semantic = rng.random() < 0.55

    def phrase(a: int, b: int) -> str:
        k, n = rng.randrange(len(words)), rng.randint(a, b)
        return " ".join((words[k : k + n] or words[:n]))

    def attributes(names: str) -> str:
        if rng.random() < (0.45 if semantic else 0.1):
            return ""
        name = rng.choice(names.split())
        return f' id="{name}"' if rng.random() < 0.25 else f' class="{name}"'

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{i}">{escape(phrase(1, 4))}</a></li>' for i in range(n))

    def part(kind: str) -> str:
        tags, names = _PARTS[kind]
        tag = tags[0] if semantic and rng.random() < 0.7 else rng.choice(tags)
        head = attributes(names)
        if tag in ("div", "section", "ul", "ol", "aside", "ins") and not head:
            head = f' class="{rng.choice(names.split())}"'
        inner = f"<h3>{escape(phrase(1, 4))}</h3>" if rng.random() < 0.3 else ""
        if kind in ("menu", "more") or (kind == "side" and rng.random() < 0.5):
            inner += links(rng.randint(2, 9)) if tag in ("ul", "ol") else f"<ul>{links(rng.randint(2, 9))}</ul>"
        elif kind == "comments":
            for _ in range(rng.randint(1, 5)):
                one = rng.choice(["div", "li", "article"])
                inner += f'<{one} class="comment"><b>{escape(phrase(1, 2))}</b><p>{escape(phrase(5, 60))}</p></{one}>'
        elif kind == "header":
            inner += rng.choice([f"<h1>{escape(phrase(1, 3))}</h1>", f'<a href="/">{escape(phrase(1, 3))}</a>', f"<p>{escape(phrase(3, 9))}</p>"]) + rng.choice(["", f"<nav><ul>{links(4)}</ul></nav>"])
        elif kind == "footer":
            inner += rng.choice(["&copy; 2020 ", "Copyright &copy; ", "", "&copy; site.example.com &middot; "]) + escape(phrase(2, 25)) + rng.choice(["", f"<ul>{links(3)}</ul>"])
        else:
            inner += rng.choice(["{}", "<p>{}</p>", "<p>{}</p><a href='#'>x</a>", "<span>{}</span> <button>OK</button>"]).format(escape(phrase(2, 40)))
        return f"<{tag}{head}>{inner}</{tag}>"

    def form() -> str:
        return f'<form action="/s"><label>{escape(phrase(1, 4))}</label><input name="q"><textarea>{escape(phrase(0, 3))}</textarea><p>{escape(phrase(2, 15))}</p><button>{escape(phrase(1, 2))}</button></form>'

    lines, body = [], []

    def say(shape: str, *pieces: str) -> None:
        body.append(shape.format(*[escape(p) for p in pieces]))
        lines.extend(" ".join(p.split()) for p in pieces)

    title = phrase(3, 10)
    if rng.random() < 0.9:
        say(rng.choice(["<h1>{}</h1>", "<h1>{}</h1>", "<header><h1>{}</h1></header>", "<h2>{}</h2>"]), title)
    articles = [t for t in texts if len(t) > 30] or [phrase(5, 60)]
    for t in rng.sample(articles, min(len(articles), rng.choice([1, 2, 4, 8, 16]))):
        if rng.random() < 0.15:
            t = phrase(1, 8)  # short paragraphs are content too
        shape = rng.random()
        if shape < 0.62:
            say("<p>{}</p>", t)
        elif shape < 0.72:
            say("<p><b>{}<br>", t)
        elif shape < 0.8:
            a, _, b = t.partition(" ")
            body.append(f"<p>{escape(a)} <{rng.choice(['em', 'b', 'span', 'a href=x'])}>{escape(b)}</p>")
            lines.append(" ".join(t.split()))
        elif shape < 0.84:
            say("<div>{}</div>", t)
        elif shape < 0.88:
            say("<blockquote><p>{}</p></blockquote>", t)
        elif shape < 0.92:
            say("<ul><li>{}</li><li>{}</li></ul>", t, phrase(2, 12))
        elif shape < 0.95:
            say("<h2>{}</h2><p>{}</p>", phrase(1, 6), t)
        elif shape < 0.97:
            say("<table><tr><th>{}</th><td>{}</td></tr></table>", phrase(1, 3), phrase(1, 9))
        else:
            say("<figure><img src=x><figcaption>{}</figcaption></figure><pre>{}</pre>", phrase(2, 12), t)
        if rng.random() < 0.08:
            body.append(part(rng.choice(["ad", "more", "notice"])))
    inner = "".join(body)
    own = attributes(_MAIN)
    if semantic:
        main = rng.choice([f"<article>{inner}</article>", f"<article{own}>{inner}</article>", f"<main{own}>{inner}</main>", f"<main><article>{inner}</article></main>"])
    else:
        main = rng.choice([f"<div{own}>{inner}</div>", f"<div><div{own}>{inner}</div></div>", f"<section{own}>{inner}</section>", inner, f"<td{own}>{inner}</td>"])
    above = [part(k) for k in ("header", "menu", "notice", "ad", "side") if rng.random() < 0.5]
    below = [part(k) for k in ("more", "comments", "ad", "side", "notice", "menu") if rng.random() < 0.35]
    rng.shuffle(above)
    rng.shuffle(below)
    if rng.random() < 0.25:
        (above if rng.random() < 0.5 else below).append(form())
    whole = "".join([*above, "<!-- x -->" if rng.random() < 0.5 else "", main, *below, part("footer") if rng.random() < 0.8 else ""])
    if rng.random() < 0.08:
        whole = f'<form id="page">{whole}</form>'
    elif rng.random() < 0.4:
        whole = f'<div class="{rng.choice(["wrapper", "container", "page", "site", "layout", "row"])}">{whole}</div>'
    if main.startswith("<td"):
        whole = f"<table><tr>{whole}</tr></table>"
    page = f"<!DOCTYPE html><html><head><title>{escape(title)}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{whole}"
    return page + rng.choice(["</body></html>", ""]), "\n".join(lines)


def labelled_pages(pages: DataFrame, most: int = MOST_PAGES) -> DataFrame:
    """At most ``most`` labelled pages (html, text), composed of the texts of as many of the given
    distinct pages as there are up to that number, picked by a hash of the html, whose length is
    at most MOST_BYTES. Few pages are used several times. The texts come from all blocks of a page alike:
    how the page itself is laid out is not looked at."""
    usable = pages.select("html").where((F.octet_length("html") > 0) & (F.octet_length("html") <= MOST_BYTES))
    hashed = usable.select("html", F.xxhash64("html").alias("h"))
    last = hashed.select("h").distinct().orderBy("h").limit(most).agg(F.max("h")).first()[0]  # only hashes are compared
    few = hashed.where(F.col("h") <= F.lit(last)).groupBy("h").agg(F.min("html").alias("html"))
    sample = materialize(few.select("html"), "page-sample")
    times = most // max(1, sample.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for h in batch.column(0).to_pylist():
                texts, seed = [t for t in blocks_of(parse(h)) if len(t) < 4000], zlib.crc32(h.encode())
                made += [compose(texts, seed + i) for i in range(times)]
            yield pa.RecordBatch.from_pylist([{"html": h, "text": t} for h, t in made], schema=pa.schema([("html", pa.string()), ("text", pa.string())]))

    return sample.mapInArrow(run, "html string, text string")


def extract(pages: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """Each page with ``keep`` (a kept column named as a result goes), ``text`` (main blocks, joined
    by two line feeds; empty if there are none), ``n_chars`` (its code points) and ``least_marginal``
    (of the blocks, null without any). Null html counts as empty; repeated rows are treated alike;
    pages of any length are read whole. Without a model all blocks outside NEVER count."""
    results = ("text", "n_chars", "least_marginal")
    columns = [c for c in dict.fromkeys(keep) if c not in results]
    shared = pages.sparkSession.sparkContext.broadcast(model)  # weights: a few thousand numbers
    source = pages.select(*columns, F.col("html").alias("__page"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value or Model({}, np.zeros(_SHAPED), np.zeros((_KINDS, 2, 2)))  # every marginal is 0.5
        for batch in batches:
            for part in blocks(batch, "__page", 1 << 20):
                found = content(own, [h or "" for h in part.column(len(columns)).to_pylist()])
                texts = ["\n\n".join(t) for t, _ in found]
                made = [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array([min(p, default=None) for _, p in found], pa.float64())]
                yield pa.record_batch([*part.columns[: len(columns)], *made], names=[*columns, *results])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.drop("__page").schema.fields)
    return source.mapInArrow(run, f"{kind + ', ' if kind else ''}text string, n_chars long, least_marginal double")


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, by a model fitted to pages composed of the table's own texts."""
    pages = read_table(spark, sf_dir, "pages")
    model = fit(materialize(labelled_pages(pages), "labelled-pages"))
    return extract(pages, model, ["page_id", "url"])
