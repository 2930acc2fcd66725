"""Operator 3, main-text extraction by a tree-structured graphical model.

Each page's block elements (and inline elements that carry a class, id or role) are the nodes of a tree. A node's state
says whether its own text belongs to the article. Node potentials are log-linear in features of tag, the parent's tag,
attribute words, text length and link share; a parent-child potential connects neighbours. Sum-product messages pass upward from the
leaves and downward from the root, which gives the exact marginal of each node; text of nodes with a marginal of at
least one half is kept. The weights are fitted on labelled pages (`labelled_pages`, built from templates) by gradient
ascent on the exact likelihood, whose gradient needs the same marginals.

One pass over the pages, each page on its own in time linear in its length, without a shuffle; the fitted weights have
a fixed size.

Defined results: a null or empty page, or one without article text, gives the empty text; markup that is never closed,
and pages that break off, are read as browsers do (a block start ends an open paragraph); repeated rows get equal
results; columns other than `page_id`, `url` and `html` are ignored; texts are never cut.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quarry.llm import io
from quarry.llm.text import steps

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z)""", re.S
)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")

INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup "
    "time tt u var wbr img br input button select option".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Never text.
SILENT = frozenset("script style title textarea noscript template iframe svg math object select option button head".split())
RAW = frozenset("script style title textarea iframe noscript template".split())
#: An opening tag of the first kind ends an open element of the second.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"tr", "td", "th", "thead"}, "body": {"head"},
}
LIMITS = frozenset("ul ol dl table article section main aside nav header footer body html form".split())


class Page:
    """The tree of a page: parent, tag and attribute words of each node, and its pieces of text in page order."""

    def __init__(self, source: str):
        self.parent, self.tag, self.marks, self.labels = [-1], ["html"], [[]], [None]
        #: (node, text, inside a link), or None where a block begins or ends
        self.pieces: list[tuple[int, str, bool] | None] = []
        #: open elements, where each tag of them stands, and how many are links or silent
        self.open: list[tuple[str, int]] = [("html", 0)]
        self.where: dict[str, list[int]] = defaultdict(list)
        self.links = self.silent = 0
        at, n = 0, len(source)
        while at < n:
            m = TOKEN.search(source, at)
            if m is None:
                self._text(source[at:])
                break
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                if self.where.get(tag):
                    for _ in range(len(self.open) - self.where[tag][-1]):
                        if self._pop() not in INLINE:
                            self.pieces.append(None)
                continue
            if tag == "html":
                continue
            if tag in RAW:
                end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(source, at)
                at = end.end() if end else n
                continue
            inline = tag in INLINE
            if not inline:
                self._end({"p"}, LIMITS)
                self._end(ENDS.get(tag, ()), LIMITS - {"body", "html"} if tag == "body" else LIMITS)
                self.pieces.append(None)
            elif tag == "br":
                self._text(" ")
            if tag in VOID:
                continue
            marks = [x for a in ATTRIBUTE.findall(m[3]) for x in WORD.findall((a[1] or a[2] or a[3]).lower())] if m[3] else []
            node = self.open[-1][1]
            if not inline or marks:
                self.parent.append(node)
                self.tag.append(tag)
                self.marks.append(marks)
                self.labels.append(m[3])
                node = len(self.tag) - 1
            if not m[3].endswith("/") or tag not in ("svg", "math"):
                self.where[tag].append(len(self.open))
                self.open.append((tag, node))
                self.links += tag == "a"
                self.silent += tag in SILENT

    def _pop(self) -> str:
        tag, _ = self.open.pop()
        self.where[tag].pop()
        self.links -= tag == "a"
        self.silent -= tag in SILENT
        return tag

    def _end(self, tags, limits) -> None:
        """End the nearest open element of `tags` unless one of `limits` is nearer."""
        nearest = max((self.where[t][-1] for t in tags if self.where.get(t)), default=0)
        limit = max((self.where[t][-1] for t in limits if self.where.get(t)), default=0)
        if nearest > limit:
            while len(self.open) > nearest:
                self._pop()

    def _text(self, text: str) -> None:
        if not self.silent:
            self.pieces.append((self.open[-1][1], text, self.links > 0))

    def blocks(self, wanted: list[bool] | np.ndarray) -> list[str]:
        out, now = [], []
        for piece in [*self.pieces, None]:
            if piece is None:
                if now:
                    block = SPACE.sub(" ", html.unescape("".join(now))).strip()
                    if block:
                        out.append(block)
                    now = []
            elif wanted[piece[0]]:
                now.append(piece[1])
        return out

    def features(self) -> list[list[str]]:
        n = len(self.tag)
        own, whole, linked, stops = [0] * n, [0] * n, [0] * n, [0] * n
        for piece in self.pieces:
            if piece:
                size = len(piece[1].strip())
                own[piece[0]] += size
                whole[piece[0]] += size
                linked[piece[0]] += size * piece[2]
                stops[piece[0]] += piece[1].count(". ") + piece[1].rstrip().endswith((".", "!", "?"))
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            whole[p] += whole[i]
            linked[p] += linked[i]
        out = []
        for i in range(n):
            share = linked[i] / whole[i] if whole[i] else 0
            out.append([
                "any", f"tag {self.tag[i]}", *{f"mark {x}" for x in self.marks[i]},
                f"own {min(4, len(str(own[i])) if own[i] else 0)}", f"links {0 if share < 0.05 else 1 if share < 0.5 else 2}",
                f"stops {min(2, stops[i])}", f"in {self.tag[self.parent[i]] if i else ''} {self.tag[i]}",
            ])
        return out


def marginals(parent: list[int], unary: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Probability that each node is content: sum-product in log space, upward and then downward.

    unary: log potential of state 1 against state 0; pair[a][b]: log potential of a parent in state a and child in b.
    """
    n = len(parent)
    (k00, k01), (k10, k11) = pair.tolist()
    up0, up1, u = [0.0] * n, [0.0] * n, unary.tolist()
    to0, to1 = [0.0] * n, [0.0] * n
    log = _log_sum
    for i in range(n - 1, 0, -1):
        zero, one = up0[i], up1[i] + u[i]
        to0[i], to1[i] = log(k00 + zero, k01 + one), log(k10 + zero, k11 + one)
        up0[parent[i]] += to0[i]
        up1[parent[i]] += to1[i]
    # belief of each node, without its own message for its children
    all0, all1 = [0.0] * n, [0.0] * n
    all0[0], all1[0] = up0[0], up1[0] + u[0]
    for i in range(1, n):
        p = parent[i]
        zero, one = all0[p] - to0[i], all1[p] - to1[i]
        all0[i] = up0[i] + log(zero + k00, one + k10)
        all1[i] = up1[i] + u[i] + log(zero + k01, one + k11)
    return 1 / (1 + np.exp(np.clip(np.array(all0) - np.array(all1), -500, 500)))


def _log_sum(a: float, b: float) -> float:
    d = a - b
    if d > 30:
        return a
    if d < -30:
        return b
    return max(a, b) + float(np.log1p(np.exp(-abs(d))))


def pair_expectation(parent: list[int], unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals, and the expected number of each state pair over the edges (by conditioning on the child's message)."""
    p = marginals(parent, unary, pair)
    total = np.zeros((2, 2))
    if len(parent) > 1:
        # the joint of an edge has these margins and the odds ratio of the pair potential
        ratio = float(np.exp(np.clip(pair[0, 0] + pair[1, 1] - pair[0, 1] - pair[1, 0], -30, 30)))
        x, y = p[np.array(parent[1:])], p[1:]
        s = 1 + (x + y) * (ratio - 1)
        both = (x * y) if abs(ratio - 1) < 1e-9 else (s - np.sqrt(np.maximum(s * s - 4 * ratio * (ratio - 1) * x * y, 0))) / (2 * (ratio - 1))
        total[1, 1], total[1, 0], total[0, 1] = both.sum(), (x - both).sum(), (y - both).sum()
        total[0, 0] = len(x) - total.sum()
    return p, total


# Labelled pages: y=1 or y=0 on an element holds for it and everything inside, until another y. {l} a long paragraph,
# {m} a sentence, {s} a few words, {a} a link, {n} a menu of links.
CONTENT = (
    '<article y=1><h1>{s}</h1><p>{l}</p><p>{m}</p><p>{l}</p></article>',
    '<article y=1 class="post"><h1>{s}</h1><p><b>{m}<br><p>{l}</p><h2>{s}</h2><p>{l}</p><ul><li>{s}</li><li>{m}</li></ul></article>',
    '<main y=1><h1>{s}</h1><p>{l}</p><blockquote>{m}</blockquote><pre>{m}</pre><p>{m}</p></main>',
    '<div y=1 id="content"><h1>{s}</h1><div><p>{l}</p><p>{m}</p></div><table><tr><td>{s}</td><td>{s}</td></tr></table></div>',
    '<div y=1 class="entry article-body"><h2>{s}</h2><p>{l}</p><p>{l}</p><p>{s}</p></div>',
    '<div y=0><div y=1 class="story text"><p>{l}</p><p>{m} {a} {m}</p></div></div>',
    '<section y=1><h1>{s}</h1><p>{l}</p><ol><li>{m}</li><li>{m}</li></ol><p>{m}</p></section>',
    '<article y=1><header><h1>{s}</h1></header><p>{l}</p><aside y=0 class="related">{n}</aside><p>{m}</p><div y=0 class="ad">{m}</div><p>{l}</p></article>',
    '<article y=1><h1>{s}</h1><p>{l}</p><figure><figcaption>{m}</figcaption></figure><p>{l}</p><div y=0 class="share social">{n}</div></article>',
    '<article y=1><h1>{s}</h1><p>{m}</p><div y=0 class="newsletter"><form><p>{m}</p></form></div><p>{l}</p><div y=0 class="comments"><p>{m}</p></div></article>',
    '<div y=1><p>{l}</p><p>{l}</p><p>{m}</p></div>',
    '<p y=1>{l}</p><p y=1>{m}</p><p y=1>{l}</p>',
    '<article y=1><h1>{s}</h1></article>',
    '<article y=1><h1>{m}</h1><p>{s}</p></article>',
    '<article y=1>{l}</article>',
    '<div y=1 class="post">{l}<br>{m}</div>',
    '<article y=1><h1>{s}</h1><dl><dt>{s}</dt><dd>{m}</dd><dt>{s}</dt><dd>{l}</dd></dl><p>{m}</p></article>',
    '<div y=1 class="page-body"><h1>{s}</h1><table><tr><th>{s}</th><th>{s}</th></tr><tr><td>{m}</td><td>{m}</td></tr></table><p>{l}</p></div>',
    '<article y=1><h1>{s}</h1><p>{l}</p><p>{m}</p><section y=0 class="replies"><h3>{s}</h3><div><p>{l}</p></div><div><p>{m}</p></div></section></article>',
    '<main y=1><article><h1>{s}</h1><p>{l}</p></article><div y=0 class="responses"><ol><li>{m}</li><li>{m}</li></ol></div></main>',
    '<div y=1><h1>{s}</h1><p>{l}</p><div>{m}</div><p>{l}</p></div>',
    '<main y=1><p>{l}</p><h3>{s}</h3><ul><li>{m}</li><li>{m}</li><li>{s}</li></ul><section><h3>{s}</h3><p>{l}</p></section></main>',
)
BEFORE = (
    "<nav>{n}</nav>", '<header><p>{s}</p>{n}</header>', '<div class="header top">{s}</div>', '<div class="menu nav">{n}</div>',
    '<div class="ad">{m}</div>', '<div class="banner advert promo"><p>{m}</p></div>', '<div id="cookie-notice" class="notice consent"><p>{m}</p></div>',
    '<ul class="breadcrumb"><li>{a}</li><li>{a}</li></ul>', '<form class="search"><label>{s}</label></form>', '<div class="ads sponsor">{l}</div>',
    '<div role="navigation">{n}</div>', '<header class="masthead"><h1>{s}</h1><p>{m}</p></header>', '<div class="cookie banner">{m} {a}</div>',
    '<div class="alert notice">{m}</div>', '<div class="advertisement"><p>{l}</p></div>', '<div>{s} {a} {a}</div>', '<p>{a} {s} {a}</p>',
    '<div class="box">{a} {s}</div>', '<div role="alert">{m}</div>',
)
AFTER = (
    "<footer>&copy; {s} {m}</footer>", "<footer><p>{m}</p>{n}</footer>", '<aside><h3>{s}</h3>{n}</aside>', '<div class="sidebar"><h3>{s}</h3><p>{m}</p>{n}</div>',
    '<section class="comments"><h2>{s}</h2><div class="comment"><p>{l}</p></div><div class="comment"><p>{m}</p></div></section>',
    '<div id="comments"><ul><li class="comment">{m}</li><li class="comment">{l}</li></ul></div>', '<div class="footer">{m}</div>',
    '<form class="newsletter subscribe"><p>{m}</p></form>', '<div class="related">{n}</div>', '<aside class="sidebar widget"><p>{l}</p></aside>',
    '<div class="pagination">{a} {a}</div>', '<form><p>{m}</p><label>{s}</label></form>', '<div class="copyright legal">{m}</div>',
    '<section id="reader-comments" class="discussion responses"><article class="comment"><p>{l}</p></article></section>',
    '<div>{n}</div>', '<p>{s} {a}</p>', '<div class="meta">{a} {s} {a}</div>', '<div role="contentinfo">{m}</div>', '<div class="discussion"><div><p>{m}</p></div><div><p>{l}</p></div></div>',
)


def labelled_pages(
    seed: int = 7, content: tuple = CONTENT, before_it: tuple = BEFORE, after_it: tuple = AFTER
) -> Iterator[tuple[Page, np.ndarray]]:
    """Pages of the templates with the label of each node; other seeds give other words and other neighbours."""
    random = np.random.default_rng(seed)

    def words(n: int) -> str:
        return " ".join("".join(random.choice(list("abdeilmnorst"), random.integers(2, 9))) for _ in range(n))

    def sentence(n: int) -> str:
        return words(n).capitalize() + "."

    def fill(template: str) -> str:
        kinds = {
            "l": lambda: " ".join(sentence(int(random.integers(6, 16))) for _ in range(int(random.integers(2, 9)))),
            "m": lambda: sentence(int(random.integers(5, 14))), "s": lambda: words(int(random.integers(1, 6))),
            "a": lambda: f'<a href="/x">{words(int(random.integers(1, 4)))}</a>',
            "n": lambda: "<ul>" + "".join(f'<li><a href="/x">{words(int(random.integers(1, 3)))}</a></li>' for _ in range(int(random.integers(2, 7)))) + "</ul>",
        }
        return re.sub(r"\{(\w)\}", lambda m: kinds[m[1]](), template)

    for k in range(8):
        for body in content:
            before = "".join(before_it[i] for i in random.permutation(len(before_it))[: random.integers(0, 4)])
            after = "".join(after_it[i] for i in random.permutation(len(after_it))[: random.integers(0, 4)])
            inner = fill(before + body + after)
            page = Page(f"<html><body>{inner}</body></html>" if k % 3 else f'<html><body><div id="page" class="wrapper">{inner}</div></body></html>')
            label = np.zeros(len(page.tag))
            for i in range(1, len(label)):
                own = re.search(r"\by=([01])", page.labels[i] or "")
                label[i] = int(own[1]) if own else label[page.parent[i]]
            yield page, label


def fit(
    labelled: list[tuple[Page, np.ndarray]] | None = None, rounds: int = 60, rate: float = 1.5, decay: float = 0.002
) -> tuple[dict[str, float], np.ndarray]:
    """Weights of the features and the pair potential, by gradient ascent on the likelihood of the labelled pages (those of
    all templates)."""
    pages = [(p.parent, p.features(), y) for p, y in (labelled_pages() if labelled is None else labelled)]
    names = {x: i for i, x in enumerate(sorted({f for _, fs, _ in pages for row in fs for f in row}))}
    rows = [[np.array([names[f] for f in row]) for row in fs] for _, fs, _ in pages]
    flat = [(np.concatenate(r), np.repeat(np.arange(len(r)), [len(x) for x in r])) for r in rows]
    weight, pair, n = np.zeros(len(names)), np.zeros((2, 2)), sum(len(y) for *_, y in pages)
    momentum_w, momentum_p = np.zeros_like(weight), np.zeros_like(pair)
    for _ in range(rounds):
        slope_w, slope_p = np.zeros_like(weight), np.zeros_like(pair)
        for (parent, _, y), (features, owner) in zip(pages, flat, strict=True):
            unary = np.bincount(owner, weights=weight[features], minlength=len(y))
            p, expected = pair_expectation(parent, unary, pair)
            slope_w += np.bincount(features, weights=(y - p)[owner], minlength=len(weight))
            seen = np.zeros((2, 2))
            np.add.at(seen, (y[parent[1:]].astype(int), y[1:].astype(int)), 1)
            slope_p += seen - expected
        momentum_w = 0.9 * momentum_w + slope_w * (20 / n) - decay * weight
        momentum_p = 0.9 * momentum_p + slope_p * (2 / n) - decay * pair
        weight, pair = weight + rate * 0.2 * momentum_w, pair + rate * 0.2 * momentum_p
    return {x: float(weight[i]) for x, i in names.items()}, pair


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(fit())

    def main_text(source: str | None) -> str:
        if not source:
            return ""
        weight, pair = shared.value
        page = Page(source)
        unary = np.array([sum(weight.get(f, 0.0) for f in row) for row in page.features()])
        return "\n".join(page.blocks(marginals(page.parent, unary, pair) >= 0.5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "html"):
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(io.table(spark, sf_dir, "pages"))
