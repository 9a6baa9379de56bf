"""Main text of web pages: gradient-boosted trees over the elements of a page, decoded down its tree.

Each element is described by its subtree's density (links, tags, punctuation, paragraphs), the words of its class, id, role and
itemprop, its depth and ancestors, and its siblings. Spark's gradient-boosted trees, fitted on a bounded sample, give the
odds that it is main text. Decoding then takes the best consistent choice in one walk: an element is context, main or
cut; below context may be anything, below main only main or cut, below cut only cut. So nothing below a cut menu can
be text, and a chapter can't lose a paragraph that scored badly on its own unless that outweighs the cost of a cut.
The text of main elements stays, in page order, with one space between blocks.

What the trees learn from: the SAMPLE pages with the smallest hashes. Those that mark an article say what is main in them; the paragraphs and short texts of all are dealt into LAYOUTS page
layouts each, with the menus, notices, sidebars, adverts, forms, related links and readers' comments that pages have,
under the usual names, under names made up, and under none. A page that marks nothing is so covered too.

Null html: empty text. No main element: empty text. Null and repeated ids or urls: each row stands for itself. A page of text
without any block: that text. Very long or deep pages take linear time and the memory of one page. An
empty table gives no rows. Only page_id, url and html are read: other columns may have any names.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm.html_tree import INLINE, Page, parse

#: Pages that the trees learn from, layouts made for each, and the elements learned from at most.
SAMPLE, LAYOUTS, LEARNED = 160, 6, 40_000
TREES, DEPTH, STEP = 20, 5, 0.4
#: Odds are held to this; entering main text and cutting out of it cost so much.
LIMIT, ENTER, CUT = 4.0, 2.0, 1.0
#: Elements scored at once.
ROWS = 20_000

_MARKS = str.maketrans("", "", ".,;:!?")
#: Elements in kinds; a feature each, for the element itself and for what it stands in.
KINDS = [("article", "main"), ("nav", "menu"), ("header",), ("footer",), ("aside",), ("form", "fieldset", "label"), ("ul", "ol", "dl"), ("li", "dt", "dd")]
KINDS += [("table", "tbody", "tr", "td", "th"), ("section", "div"), ("p",), ("h1", "h2", "h3", "h4", "h5", "h6"), ("a",), ("blockquote", "pre", "figure")]
KIND = {tag: k for k, tags in enumerate(KINDS) for tag in tags}


class Trees(NamedTuple):
    """Odds of words, and trees as arrays: feature (-1: a leaf), threshold, left, right, value."""

    words: dict[str, float]
    trees: list[tuple[np.ndarray, ...]]

    def odds(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, threshold, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                f = feature[at]
                at = np.where(f < 0, at, np.where(x[rows, f] <= threshold[at], left[at], right[at]))
            total += value[at]
        return np.clip(2 * total, -LIMIT, LIMIT)


def features(page: Page, words: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each element, and its own text's length."""
    n = len(page.tags)
    own, begins, marks, spaces = np.zeros(n), np.full(n, np.inf), np.zeros(n), np.zeros(n)
    read = 0
    for k, text in page.pieces:
        chars = len(text) - text.count(" ")
        own[k] += chars
        begins[k] = min(begins[k], read)
        marks[k] += len(text) - len(text.translate(_MARKS))
        spaces[k] += text.count(" ")
        read += chars
    kind = np.array([KIND.get(t, -1) for t in page.tags])
    ends, parents = np.array(page.ends), np.array(page.parents)
    depth, link, score = np.zeros(n), np.zeros(n, bool), np.zeros(n)
    low, high, inside = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
    named, landmark = np.zeros(n), np.zeros(n)  # of the nearest element that has a known name, or is a landmark
    for k in range(1, n):
        p = page.parents[k]
        score[k] = sum(words.get(w, 0.0) for w in page.tokens[k])
        depth[k], link[k] = depth[p] + 1, link[p] or page.tags[k] == "a"
        low[k], high[k] = min(low[p], score[p]), max(high[p], score[p])
        inside[k] = inside[p] | (1 << kind[p] if kind[p] >= 0 else 0)
        named[k] = score[k] or named[p]
        landmark[k] = 1 if kind[k] == 0 else -1 if 0 < kind[k] <= KIND["form"] and not (kind[k] == KIND["header"] and landmark[p] > 0) else landmark[p]

    def below(of: np.ndarray) -> np.ndarray:
        c = np.concatenate(([0], np.cumsum(of)))
        return c[ends] - c[:n]

    chars = below(own)
    some = np.maximum(chars, 1.0)
    total = max(read, 1)
    first = np.minimum.reduceat(np.append(begins, np.inf), np.stack([np.arange(n), ends], 1).ravel())[::2]
    up = np.maximum(parents, 0)
    siblings, same = np.bincount(up[1:], minlength=n)[up], Counter(zip(page.parents, page.tags, strict=True))
    nth, seen = np.zeros(n), Counter()
    for k in range(1, n):
        seen[page.parents[k]] += 1
        nth[k] = seen[page.parents[k]]
    paragraphs = kind == KIND["p"]
    linked = below(own * link) / some
    in_p = below(own * np.array([paragraphs[k] or bool(inside[k] >> KIND["p"] & 1) for k in range(n)])) / some
    x = [
        depth, np.log1p(chars), np.log1p(own), linked, chars / total, np.where(np.isfinite(first), first, total) / total,
        below(np.ones(n)) * 100 / (some + 100), in_p, np.log1p(below(paragraphs)), np.log1p(below(kind == KIND["li"])), np.log1p(below(kind == KIND["a"])),
        np.log1p(below(kind == KIND["form"])), below(marks) / some, below(spaces) / some, np.log1p(siblings), nth / np.maximum(siblings, 1), chars / np.maximum(chars[up], 1),
        np.array([same[q, t] for q, t in zip(page.parents, page.tags, strict=True)]) / np.maximum(siblings, 1), score, low, high, linked[up], named, landmark,
    ]
    x += [kind == k for k in range(len(KINDS))] + [inside >> k & 1 for k in range(len(KINDS))]
    return np.column_stack(x).astype(np.float64), own


def decode(page: Page, odds: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Which elements are main: the best choice of context, main and cut that no ancestor contradicts. All of a page without blocks."""
    n = len(page.tags)
    if all(t in INLINE for t in page.tags[1:]):
        return np.ones(n, bool)
    weight = np.where(own > 0, odds * (1 + np.log1p(own)), 0.5 * odds)
    main, context = weight.tolist(), [0.0] * n
    # a word in bold or a link is as its block is
    bound = [t in INLINE for t in page.tags]
    for k in range(n - 1, 0, -1):
        p = page.parents[k]
        main[p] += main[k] if bound[k] else max(main[k], -CUT)
        context[p] += context[k] if bound[k] else max(context[k], main[k] - ENTER, 0.0)
    state = ["main" if main[0] - ENTER > max(context[0], 0.0) else "context"] * n
    for k in range(1, n):
        above = state[page.parents[k]]
        if bound[k]:
            state[k] = above
        elif above == "main":
            state[k] = "main" if main[k] >= -CUT else "cut"
        elif above == "cut" or max(context[k], main[k] - ENTER) <= 0:
            state[k] = "cut"
        else:
            state[k] = "main" if main[k] - ENTER >= context[k] else "context"
    return np.array([s == "main" for s in state])


def text_of(page: Page, kept: np.ndarray) -> str:
    return " ".join("".join(t if kept[k] else " " if t[:1] == " " else "" for k, t in page.pieces).split())


def extract(pages: Iterable[str], model: Trees) -> Iterator[str]:
    """The main text of each page; elements of many pages are scored at once."""
    waiting: list[tuple[Page, np.ndarray, np.ndarray]] = []

    def done() -> Iterator[str]:
        odds = model.odds(np.concatenate([x for _, x, _ in waiting]))
        at = 0
        for page, x, own in waiting:
            kept = decode(page, odds[at : at + len(x)], own)
            at += len(x)
            yield text_of(page, kept)

    size = 0
    for html in pages:
        page = parse(html)
        waiting.append((page, *features(page, model.words)))
        size += len(page.tags)
        if size >= ROWS:
            yield from done()
            waiting, size = [], 0
    if waiting:
        yield from done()


# ---- what the trees learn from

#: Usual names of what pages hold beside their text, and of the text's own container.
BESIDE = {
    "menu": "nav menu navbar navigation topnav breadcrumb breadcrumbs tabs toolbar sitenav",
    "header": "header masthead banner topbar site-header branding logo",
    "footer": "footer site-footer copyright colophon legal bottom",
    "sidebar": "sidebar side widget aside rail secondary trending popular recent tags archive",
    "notice": "notice cookie consent gdpr alert popup modal overlay message paywall banner",
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion",
    "form": "newsletter subscribe signup login search form contact-form feedback",
    "related": "related share social sharing more-stories recommended author-box pagination pager",
    "comments": "comments comment disqus respond replies discussion reviews comment-list",
}
MAIN = "content article post entry story article-body post-content entry-content main main-content body-text page-content text"
_LANDMARK = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}


class Content(NamedTuple):
    paragraphs: list[str]
    short: list[str]
    title: str


def content_of(page: Page) -> Content:
    """Paragraph-like and short texts of a page, and its first heading."""
    by_element: dict[int, list[str]] = {}
    for k, t in page.pieces:
        while page.tags[k] in ("b", "i", "em", "strong", "span") and page.parents[k] > 0:
            k = page.parents[k]
        by_element.setdefault(k, []).append(t)
    texts = [(page.tags[k], " ".join("".join(t).split())) for k, t in sorted(by_element.items())]
    paragraphs = [t for tag, t in texts if t and tag not in ("a", "li") and not tag.startswith("h")]
    return Content(paragraphs, [t for tag, t in texts if t and (tag in ("a", "li") or len(t) < 80)], next((t for tag, t in texts if tag == "h1"), ""))


_BLOCK = re.compile(r"<(h[1-6]|p|div|blockquote|ul|table|header)>")


def _escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;")


def layout(rng: random.Random, contents: list[Content]) -> str:
    """A page of text and what pages hold beside it; data-part says which is which."""
    here, other = rng.choice(contents), rng.choice(contents)
    short = [t for c in (here, other) for t in c.short] or ["more"]
    some = lambda most=12: " ".join(_escaped(rng.choice(short)).split()[:most]) or "more"
    paragraph = lambda c: _escaped(rng.choice(c.paragraphs)) if c.paragraphs else some()
    named = rng.random() < 0.75

    def mark(names: str) -> str:
        if not named:
            return ""
        name = rng.choice(names.split())
        made = rng.choice(["", "", f" box-{rng.randrange(99)}", f" {rng.choice('abcxyz')}{rng.randrange(9)}"])
        return f' {rng.choice(["class", "class", "id"])}="{rng.choice(["", "", "site-", "js-"])}{name}{made}"'

    def links(n: int) -> str:
        items = [f'<a href="/{k}">{some(3)}</a>' for k in range(n)]
        if rng.random() < 0.7:
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        return rng.choice([" | ", " ", "<br>"]).join(items)

    def beside(what: str) -> str:
        tag = _LANDMARK.get(what, "div") if rng.random() < 0.6 else rng.choice(["div", "section", "div"])
        if what == "menu":
            inner = links(rng.randint(3, 10))
        elif what == "header":
            inner = rng.choice([f"<h1>{some(4)}</h1><p>{some(8)}</p>", f'<a href="/">{some(3)}</a>', f"<div>{some(5)}</div>{links(3)}"])
        elif what == "footer":
            inner = rng.choice([f"&copy; {some(3)} &middot; {some(10)}", f"<p>&copy; 2024 {some(6)}</p>{links(4)}", f"<p>{some(20)}</p>"])
        elif what == "sidebar":
            inner = f"<h3>{some(3)}</h3>" + rng.choice([links(5), f"<p>{some(25)}</p>", f"<p>{some(20)}</p>{links(3)}"])
        elif what == "notice":
            inner = f"<p>{some(30)}</p>" + rng.choice(["<button>OK</button>", f'<a href="/privacy">{some(2)}</a>', ""])
        elif what == "advert":
            inner = rng.choice([some(10), f"<p>{some(15)}</p>", f'<a href="http://x.example/">{some(8)}</a>', paragraph(other)[:200]])
        elif what == "form":
            inner = f"<p>{some(12)}</p><label>{some(2)} <input name=q></label><button>{some(1)}</button>"
        elif what == "related":
            inner = f"<h3>{some(3)}</h3>{links(rng.randint(2, 6))}"
        else:
            one = lambda: rng.choice([f"<li><b>{some(2)}</b><p>{paragraph(other)}</p></li>", f"<div class=comment><p>{some(2)}</p><p>{paragraph(other)}</p></div>", f"<p>{some(30)}</p>"])
            inner = f"<h{(h := rng.randint(2, 4))}>{some(2)}</h{h}>" + "".join(one() for _ in range(rng.randint(1, 6)))
            return f'<{tag}{mark(BESIDE[what]) or " id=comments"} data-part=0>{inner}</{tag}>'
        # without a name or a landmark nothing tells an advert's or a notice's paragraph from the text
        name = mark(BESIDE[what]) or (f" class={BESIDE[what].split()[0]}" if tag in ("div", "section") and what in ("advert", "notice", "form", "sidebar", "header", "footer") else "")
        return f"<{tag}{name} data-part=0>{inner}</{tag}>"

    def heading() -> str:
        title = f"<h1>{_escaped(here.title) or some(8)}</h1>"
        return f"<header>{title}</header>" if rng.random() < 0.1 else title

    def blocks() -> Iterator[str]:
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6, 9])):
            p, shape = paragraph(here), rng.random()
            if shape < 0.55:
                yield f"<p>{p}</p>"
            elif shape < 0.65:
                yield f"<p>{p}"
            elif shape < 0.72:
                yield f"<p><b>{p[:60]}.<br><p>{p}</p>"
            elif shape < 0.77:
                yield f'<p>{p[: len(p) // 2]}<a href="/x">{some(3)}</a> {p[len(p) // 2 :]}</p>'
            elif shape < 0.8:
                yield f"<h2>{some(6)}</h2><p>{p}</p>"
            elif shape < 0.84:
                yield f"<{(t := rng.choice(['section', 'div']))}>{rng.choice(['', f'<h2>{some(5)}</h2>'])}<p>{p}</p><p>{some(rng.randint(2, 30))}</p></{t}>"
            elif shape < 0.87:
                yield "<ul>" + "".join(f"<li>{some(14)}" + rng.choice(["</li>", ""]) for _ in range(3)) + "</ul>"
            elif shape < 0.91:
                yield f"<blockquote><p>{p}</p></blockquote>"
            elif shape < 0.94:
                yield f"<table><tr><td>{some(4)}</td><td>{some(4)}</td></tr></table>"
            else:
                yield f"<div>{p}</div>"

    def body(bare: bool) -> Iterator[str]:
        """The text's blocks, and now and then something beside them; bare: each block is a part of its own."""
        for block in [heading()] * (rng.random() < 0.9) + list(blocks()):
            yield _BLOCK.sub(r"<\1 data-part=1>", block) if bare else block
            if rng.random() < 0.2:
                yield beside(rng.choice(["advert", "related", "form", "sidebar", "notice", "menu", "footer"]))

    tag = rng.choice(["article", "article", "main", "div", "div", "section", "td", "", ""])
    name = mark(MAIN) if named or tag in ("article", "main") else ""
    inside = "".join(body(not tag)) + (beside("comments") if rng.random() < 0.15 else "")
    text = f"<{tag}{name} data-part=1>{inside}</{tag}>" if tag else inside
    text = f"<table><tr>{text}</tr></table>" if tag == "td" else text
    if rng.random() < 0.35:
        text = f"<{(t := rng.choice(['main', 'div', 'section']))}{rng.choice([' id=wrapper', ' class=container', ''])}>{text}</{t}>"
    much = rng.choice([0.0, 0.0, 0.45, 0.45, 0.7])
    before = [beside(w) for w in ("header", "menu", "notice", "advert", "form") if rng.random() < much]
    after = [beside(w) for w in ("related", "comments", "sidebar", "advert", "notice", "form", "footer") if rng.random() < much]
    page = "".join(before) + text + "".join(after)
    if rng.random() < 0.3:
        page = f"<div{rng.choice([' id=page', ' class=wrap', ''])}>{page}</div>"
    return f"<html><head><title>{some(6)}</title></head><body>{page}</body></html>"


def parts(page: Page) -> list[int]:
    """1 for the elements of a layout's text, by the nearest data-part."""
    found = [0] * len(page.tags)
    for k in range(1, len(found)):
        found[k] = int(page.label[k]) if page.label[k] in ("0", "1") else found[page.parents[k]]
    return found


def landmarks(page: Page) -> list[int] | None:
    """1 for the elements of the one article that a page marks, but for what is beside the text there; None without one."""
    marked = [k for k, t in enumerate(page.tags) if t == "article"]
    if len(marked) != 1:
        return None
    names = {w for names in BESIDE.values() for n in names.split() for w in [n]}
    found = [0] * len(page.tags)
    for k in range(marked[0], page.ends[marked[0]]):
        aside = page.tags[k] in ("nav", "aside", "footer", "form") or any(t in names for t in page.tokens[k])
        found[k] = int(k == marked[0] or (found[page.parents[k]] and not aside))
    return found


def lessons(pages: list[tuple[int | None, str]], layouts: int = LAYOUTS) -> list[tuple[Page, list[int]]]:
    """Pages with the parts of their elements: those that mark an article, and layouts of the texts of all."""
    parsed = [parse(html) for _, html in pages]
    found = [(p, known) for p in parsed if (known := landmarks(p))]
    contents = [c for p in parsed if (c := content_of(p)).paragraphs or c.short] or [Content([], [], "")]
    rng = random.Random(len(contents))
    made = [parse(layout(rng, contents)) for _ in range(layouts * len(pages))]
    return found + [(p, parts(p)) for p in made]


def _flat(model) -> list[tuple[np.ndarray, ...]]:
    """Spark's trees as arrays."""
    out = []
    for tree in model._java_obj.trees():
        rows: list[list[float]] = []

        def walk(node, rows=rows) -> int:
            at = len(rows)
            rows.append([-1, 0.0, 0, 0, node.prediction()])
            if node.subtreeDepth():
                split = node.split()
                rows[at][:2] = split.featureIndex(), split.threshold()
                rows[at][2], rows[at][3] = walk(node.leftChild()), walk(node.rightChild())
            return at

        walk(tree.rootNode())
        feature, threshold, left, right, value = zip(*rows, strict=True)
        out.append((np.array(feature, np.int64), np.array(threshold), np.array(left, np.int64), np.array(right, np.int64), np.array(value)))
    weights = list(model.treeWeights)
    return [(*t[:4], t[4] * w) for t, w in zip(out, weights, strict=True)]


def fit(pages: DataFrame, sample: int = SAMPLE, layouts: int = LAYOUTS) -> Trees | None:
    """Trees learned from a bounded sample of the pages; None of an empty table."""
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("string").alias("id"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    # the order needs hashes only, the texts of the chosen pages follow
    hashed = rows.select(F.xxhash64("id", "html").alias("h"), "id", F.left("html", F.lit(MOST_LEARNED)).alias("html"))
    chosen = [(r["id"], r["html"]) for r in hashed.orderBy("h", "id").limit(sample).collect()]
    if not chosen:
        return None
    taught = lessons(chosen, layouts)
    seen, main = Counter(), Counter()
    for page, known in taught:
        # a word speaks for the elements that it names, once a page
        for w, k in {(w, known[k]) for k in range(len(known)) for w in page.tokens[k]}:
            seen[w] += 1
            main[w] += k
    words = {w: float(np.log((main[w] + 0.5) / (n - main[w] + 0.5))) for w, n in seen.items() if n >= 3}
    rng = random.Random(0)
    x, y = [], []
    for page, known in taught:
        # word odds are left out of some pages, so that the trees learn to do without
        numbers, own = features(page, {} if rng.random() < 0.1 else words)
        # what stands around the text is neither
        around = {0}
        for k in range(len(known) - 1, 0, -1):
            if page.parents[k] >= 0 and (k in around or known[k]) and not known[page.parents[k]]:
                around.add(page.parents[k])
        told = [k for k in range(1, len(known)) if numbers[k, 1] > 0 and k not in around]
        x.append(numbers[told])
        y += [known[k] for k in told]
    rows = np.concatenate(x)[:LEARNED]
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))
    table = spark.createDataFrame(pa.table({"label": pa.array(y[: len(rows)], pa.float64()), "features": lists}))
    data = table.select("label", array_to_vector("features").alias("features")).coalesce(1)
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, maxBins=32, seed=1).fit(data)
    return Trees(words, _flat(model))


#: Characters of a page that are learned from; all of it is extracted.
MOST_LEARNED = 50_000


def extract_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    kind = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"
    rows = pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string"))
    model = fit(pages)
    if model is None:
        return spark.createDataFrame([], kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = list(extract((h.as_py() or "" for h in batch.column(2)), model))
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, kind)
