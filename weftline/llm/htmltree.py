"""Main text of web pages by a tree-structured graphical model.

A page becomes a DOM tree; each node is content or not. Unary potentials come from a node's tag, its class and
id words and the text beneath it, pairwise potentials from the states of parent and child and the child's kind.
Sum-product messages pass upward and then downward, which gives exact marginals; weights are fitted by the
likelihood of labelled pages, whose gradient the same messages give. Text blocks whose node is content with a
marginal of one half at least are the page's text.

labelled_pages() makes the labelled pages: layouts of many kinds with random words, where the writer of a page
knows what belongs to the article.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, free

# Elements of HTML by how they are read.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe noembed noframes xmp svg math select canvas object audio video".split())
BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "head", "body", "button", "legend"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDERS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"datalist"}}
KINDS = "article main section div p h h1 list li nav header footer aside form table cell pre quote figure button a other".split()
OF_TAG = (
    {t: t for t in ("article", "main", "section", "div", "p", "h1", "li", "nav", "header", "footer", "aside", "form", "pre", "figure", "button", "a")}
    | dict.fromkeys(("h2", "h3", "h4", "h5", "h6"), "h")
    | dict.fromkeys(("ul", "ol", "dl", "menu"), "list")
    | dict.fromkeys(("dt", "dd"), "li")
    | dict.fromkeys(("table", "tbody", "thead", "tfoot", "tr"), "table")
    | dict.fromkeys(("td", "th", "caption"), "cell")
    | dict.fromkeys(("blockquote",), "quote")
    | dict.fromkeys(("figcaption", "center"), "div")
    | dict.fromkeys(("fieldset", "legend", "label", "input", "search", "dialog"), "form")
)
WORDS = {
    "good": "article content post entry story main body text page prose markdown document",
    "menu": "nav menu breadcrumb navbar toolbar pagination pager toc tabs links skip navigation",
    "top": "header banner masthead topbar logo brand",
    "foot": "footer copyright legal colophon bottom credits",
    "side": "sidebar aside related widget recommended popular trending more archive tags author bio rail",
    "note": "cookie consent notice alert popup modal overlay gdpr banner newsletter subscribe signup promo paywall toast",
    "ad": "ad ads advert advertisement sponsor sponsored promoted adsense dfp outbrain taboola commercial",
    "talk": "comment comments reply replies discussion disqus respond thread reader feedback",
    "share": "share social follow login form search print",
}
GROUPS = list(WORDS)
WORD_GROUPS: dict[str, list[int]] = {}
for _g, _names in WORDS.items():
    for _w in _names.split():
        WORD_GROUPS.setdefault(_w, []).append(GROUPS.index(_g))

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
SLOPPY = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
NAMES = re.compile(r"""(?:class|id|role|aria-label|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none|visibility\s*:\s*hidden""", re.I)
WORD = re.compile(r"[a-z]+|\d+", re.I)
RAW_END = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in RAW}


class Page:
    """A DOM's blocks. Lists by node: parent, tag, word groups, hidden; texts: (node, raw text inside and outside links)."""

    __slots__ = ("parent", "tag", "groups", "hidden", "texts")

    def __init__(self):
        self.parent, self.tag, self.groups, self.hidden, self.texts = [-1], ["html"], [()], [False], []

    def add(self, parent: int, tag: str, attrs: str) -> int:
        found: set[int] = set()
        hidden = False
        if attrs and "=" in attrs:
            for m in NAMES.finditer(attrs):
                for w in WORD.findall(m[1] or m[2] or m[3] or ""):
                    w = w.lower()
                    if w in WORD_GROUPS:
                        found.update(WORD_GROUPS[w])
        if attrs and HIDDEN.search(attrs):
            hidden = True
        self.parent.append(parent)
        self.tag.append(tag)
        self.groups.append(tuple(found))
        self.hidden.append(hidden)
        return len(self.tag) - 1


def parse(source: str) -> Page:
    """The tree of blocks. Open elements close as HTML implies; inline elements do not become nodes, but links are told apart."""
    page = Page()
    stack: list[tuple[str, int]] = [("html", 0)]
    opened: dict[str, list[int]] = {}  # where the stack has a tag, so that no search walks it
    run: list[str] = []
    linked = [0, 0]
    links = 0
    at, size = 0, len(source)

    def flush() -> None:
        nonlocal run
        if run:
            text = "".join(run)
            if not text.isspace():
                page.texts.append((stack[-1][1], text, linked[0], linked[1]))
            run = []
        linked[0] = linked[1] = 0

    def last(tags: set[str]) -> int:
        return max((opened[t][-1] for t in tags if opened.get(t)), default=0)

    def cut_at(k: int) -> None:
        for t, _ in stack[k:]:
            opened[t].pop()
        del stack[k:]

    def say(text: str) -> None:
        if text:
            run.append(text)
            n = len(text)
            linked[1] += n
            if links:
                linked[0] += n

    while at < size:
        lt = source.find("<", at)
        if lt < 0:
            say(source[at:])
            break
        if lt > at:
            say(source[at:lt])
        m = TOKEN.match(source, lt)
        if m is None:
            m = SLOPPY.match(source, lt)
        if m is None:
            # a '<' that begins no tag is text; a tag that never ends is dropped with what follows, as browsers do
            if lt + 1 < size and (source[lt + 1].isalpha() or source[lt + 1] == "/") and source.find(">", lt) < 0:
                break
            say("<")
            at = lt + 1
            continue
        at = m.end()
        if m.re is TOKEN and m[2] is None:
            continue
        close, tag, attrs = m[1], m[2].lower(), m[3]
        if close:
            if tag == "a":
                links = max(links - 1, 0)
            elif tag == "br":
                say("\n")
            elif tag in BLOCK:
                k = last({tag})
                if k or tag == "p":
                    flush()
                if k:
                    cut_at(k)
            continue
        if tag in RAW:
            if attrs.endswith("/") and tag in ("svg", "math"):
                continue
            end = RAW_END[tag].search(source, at)
            at = end.end() if end else size
            continue
        if tag == "br":
            say("\n")
            continue
        if tag == "a":
            links += 1
            continue
        if tag not in BLOCK:
            if tag in VOID:
                say("")
            continue
        flush()
        links = 0
        if tag in ("html", "body"):
            if attrs:
                stack[0] = ("html", 0)
            continue
        if tag == "head":
            continue
        if tag in CLOSES_P and (k := last({"p"})) > last({"td", "th", "button", "table"}):
            cut_at(k)
        if tag in SIBLINGS and (k := last(SIBLINGS[tag])) > last(HOLDERS[tag]):
            cut_at(k)
        if tag == "hr" or attrs.endswith("/") and tag in VOID:
            continue
        opened.setdefault(tag, []).append(len(stack))
        stack.append((tag, page.add(stack[-1][1], tag, attrs)))
    flush()
    return page


N_KIND, N_GROUP = len(KINDS), len(GROUPS)
VAGUE = np.array([k in ("div", "section", "other", "cell", "list", "table") for k in KINDS])
N_UNARY = N_KIND + 2 * N_GROUP + 10
N_PAIR = 2  # child's state equal to the parent's: content with content, other with other; for each kind of child
WEIGHTS = N_UNARY + N_PAIR * N_KIND


def features(page: Page) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unary features by node, kinds by node, parents."""
    n = len(page.tag)
    kind = np.array([KINDS.index(OF_TAG.get(t, "other")) for t in page.tag])
    x = np.zeros((n, N_UNARY))
    x[np.arange(n), kind] = 1
    up: list[set[int]] = [set()]
    for i in range(n):
        for g in page.groups[i]:
            x[i, N_KIND + g] = 1
        if i:
            above = up[page.parent[i]]
            up.append(above | set(page.groups[i]) if page.groups[i] else above)
            for g in above:
                x[i, N_KIND + N_GROUP + g] = 1
    own = np.zeros((n, 4))
    for node, text, inside, whole in page.texts:
        own[node] += (whole, inside, text.count(".") + text.count("!") + text.count("?"), 1)
    total = own.copy()
    for i in range(n - 1, 0, -1):
        total[page.parent[i]] += total[i]
    b = N_KIND + 2 * N_GROUP
    density = total[:, 1] / np.maximum(total[:, 0], 1)
    x[:, b] = density
    x[:, b + 1] = density > 0.5
    x[:, b + 2] = np.log1p(np.minimum(total[:, 0], 1000)) / 8  # beyond that, length says nothing more
    x[:, b + 3] = np.log1p(np.minimum(own[:, 0], 400)) / 6
    x[:, b + 4] = np.minimum(total[:, 2], 5) / 5
    x[:, b + 5] = page.hidden
    x[:, b + 6] = total[:, 0] / max(total[0, 0], 1)
    # lengths speak for containers that tags leave open; a short paragraph is content where its container is
    x[:, [b + 2, b + 3, b + 4, b + 6]] *= VAGUE[kind][:, None]
    x[:, b + 7] = 1
    # a heading of the page or its parts, and paragraphs, beneath a container
    beneath = np.stack([np.isin(kind, (KINDS.index("h1"), KINDS.index("h"))), kind == KINDS.index("p")], 1).astype(float)
    for i in range(n - 1, 0, -1):
        beneath[page.parent[i]] += beneath[i]
    x[:, b + 8] = (beneath[:, 0] > 0) * VAGUE[kind]
    x[:, b + 9] = np.log1p(np.minimum(beneath[:, 1], 8)) / 2 * VAGUE[kind]
    return x, kind, np.array(page.parent)


def marginals(unary: np.ndarray, pair: np.ndarray, parent: list[int]) -> tuple[list[float], list[tuple[float, float, float, float]], float]:
    """P(content) by node, joint tables with the parent (00, 01, 10, 11: parent first), and the log of the sum over all states.

    unary: log potential of content; pair: (n, 2) log potentials of (0, 0) and (1, 1) with the parent. Nodes follow
    their parents. All sums are scaled, so that deep and wide trees do not overflow.
    """
    n = len(unary)
    u = np.exp(np.clip(unary, -30, 30)).tolist()
    p00, p11 = np.exp(np.clip(pair[:, 0], -10, 10)).tolist(), np.exp(np.clip(pair[:, 1], -10, 10)).tolist()
    b0, b1 = [1.0] * n, u
    m0, m1 = [1.0] * n, [1.0] * n
    log = 0.0
    for i in range(n - 1, 0, -1):
        s = b0[i] + b1[i]
        b0[i] /= s
        b1[i] /= s
        log += np.log(s) if s > 0 else 0.0
        m0[i] = b0[i] * p00[i] + b1[i]
        m1[i] = b0[i] + b1[i] * p11[i]
        k = parent[i]
        b0[k] *= m0[i]
        b1[k] *= m1[i]
        t = b0[k] + b1[k]
        if t < 1e-100 or t > 1e100:
            b0[k] /= t
            b1[k] /= t
            log += np.log(t)
    s = b0[0] + b1[0]
    log += np.log(s)
    q0, q1 = [0.0] * n, [0.0] * n
    q0[0], q1[0] = b0[0] / s, b1[0] / s
    joint = [(0.0, 0.0, 0.0, 0.0)] * n
    for i in range(1, n):
        k = parent[i]
        up0, up1 = q0[k] / m0[i], q1[k] / m1[i]
        j = (up0 * b0[i] * p00[i], up0 * b1[i], up1 * b0[i], up1 * b1[i] * p11[i])
        joint[i] = j
        q1[i] = j[1] + j[3]
        q0[i] = j[0] + j[2]
    return q1, joint, log


def potentials(w: np.ndarray, x: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x @ w[:N_UNARY], w[N_UNARY:].reshape(N_KIND, N_PAIR)[kind]


def labelled_pages(n: int = 240, seed: int = 10) -> list[tuple[str, list[str]]]:
    """Pages and the blocks of their articles."""
    rng = np.random.default_rng(seed)
    pick = lambda *a: a[rng.integers(len(a))]
    syllables = "ba ce di fo gu ha je ki lo mu na pe ri so tu va we xi yo zu".split()
    word = lambda: "".join(pick(*syllables) for _ in range(rng.integers(1, 5)))

    def sentence(lo: int = 3, hi: int = 18) -> str:
        return " ".join(word() for _ in range(rng.integers(lo, hi))).capitalize() + pick(".", ".", ".", "!", "?", "")

    def para() -> str:
        roll = rng.random()
        if roll < 0.06:
            return " ".join([word()] * rng.integers(2, 90))
        if roll < 0.1:
            return f" {pick('|', '&amp;', '%%', '-')} ".join(word() for _ in range(rng.integers(1, 60)))
        if roll < 0.13:
            return " ".join(word().upper() for _ in range(rng.integers(1, 60)))
        if roll < 0.17:
            return word()
        return " ".join(sentence() for _ in range(pick(1, 1, 2, 4, 8)))

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(k))

    def junk(kind: str) -> str:
        name = pick(*WORDS[kind].split()) if rng.random() < 0.9 else word()
        attr = pick(f'class="{name}"', f'id="{name}"', f'class="{word()} {name}-{word()}"')
        tag = {"menu": "nav", "top": "header", "foot": "footer", "side": "aside", "talk": pick("section", "div"), "note": "div", "ad": pick("div", "aside", "section"), "share": pick("form", "div")}[kind]
        bare = tag in ("nav", "header", "footer", "aside", "form") and rng.random() < 0.6
        if rng.random() < 0.3 and not bare:
            tag = "div"
        body = {
            "menu": lambda: f"<ul>{links(rng.integers(2, 9))}</ul>",
            "top": lambda: pick(f"<h1>{word()}</h1>", f"<p>{sentence()}</p>", f"<a href='/'>{word()}</a><ul>{links(3)}</ul>"),
            "foot": lambda: pick(f"&copy; {word()} {sentence()}", f"<p>{para()}</p><ul>{links(4)}</ul>", sentence()),
            "side": lambda: f"<h3>{word()}</h3>" + pick(f"<ul>{links(5)}</ul>", f"<p>{para()}</p>"),
            "talk": lambda: "".join(pick(f"<div class='comment'><p>{para()}</p></div>", f"<li class='reply'>{para()}</li>", f"<p>{para()}</p>") for _ in range(rng.integers(1, 5))),
            "note": lambda: pick(sentence(), f"<p>{para()}</p><button>{word()}</button>"),
            "ad": lambda: pick(sentence(), para(), f"<p>{para()}</p>", f"<a href='/{word()}'>{sentence()}</a>"),
            "share": lambda: f"<label>{word()}</label><input name=q><button>{word()}</button>" + pick("", f"<p>{sentence()}</p>"),
        }[kind]()
        return f"<{tag}{'' if bare else ' ' + attr}>{body}</{tag}>"

    out = []
    for _ in range(n):
        blocks: list[str] = []

        def block(tag: str, text: str, blocks: list[str] = blocks) -> str:
            blocks.append(" ".join(text.split()))
            return pick(f"<{tag}>{text}</{tag}>", f"<{tag}><b>{text}</b></{tag}>", f"<{tag}>{text}</{tag}>")

        body = [block(pick("h1", "h1", "h2"), sentence(2, 9))] if rng.random() < 0.85 else []
        for _ in range(rng.integers(1, 12)):
            roll = rng.random()
            if roll < 0.72:
                body.append(block("p", para()))
            elif roll < 0.8:
                body.append(block(pick("h2", "h3"), sentence(1, 6)))
            elif roll < 0.87:
                body.append("<ul>" + "".join(block("li", sentence()) for _ in range(rng.integers(1, 6))) + "</ul>")
            elif roll < 0.9:
                body.append("<blockquote>" + block("p", para()) + "</blockquote>")
            elif roll < 0.93:
                body.append("<table><tr>" + "".join(block("td", sentence(1, 5)) for _ in range(3)) + "</tr></table>")
            elif roll < 0.95:
                body.append(block("pre", para()))
            else:
                body.append(junk(pick("ad", "note", "share", "talk")))
        inner = "".join(body)
        # container and name are drawn apart from each other; a name may mislead
        roll = rng.random()
        name = word() if roll < 0.15 else pick(*WORDS[pick(*GROUPS[1:])].split()) + f"-{word()}" if roll < 0.45 else pick(*WORDS["good"].split()) + pick("", f"-{word()}")
        attr = pick("", f" class='{name}'", f" id='{name}'", f" class='{word()} {name}'") if rng.random() < 0.65 else ""
        tag = pick("article", "article", "article", "main", "div", "div", "section", "section", "td", "blockquote")
        main = f"<{tag}{attr}>{inner}</{tag}>"
        if tag == "td":
            main = f"<table><tr>{main}</tr></table>"
        elif rng.random() < 0.15:
            main = f"<main{pick('', ' role=main')}>{main}</main>"
        before = [junk(k) for k in ("top", "menu", "note", "ad", "share", "side") if rng.random() < 0.45]
        after = [junk(k) for k in ("talk", "side", "ad", "foot", "menu", "note") if rng.random() < 0.45]
        whole = "".join(before) + main + "".join(after)
        if rng.random() < 0.3:
            whole = f"<div class='{pick('wrap', 'container', 'page', 'site')}'>{whole}</div>"
        out.append((f"<!DOCTYPE html><html><head><title>{word()}</title></head><body>{whole}</body></html>", blocks))
    return out


def states(page: Page, blocks: list[str]) -> np.ndarray:
    """Content is every node of the article's blocks and the nodes above that hold no other text."""
    n = len(page.tag)
    left = list(blocks)
    good, bad = np.zeros(n), np.zeros(n)
    for node, text, _, _ in page.texts:
        t = " ".join(html.unescape(text).split())
        if t in left:
            left.remove(t)
            good[node] += len(t)
        else:
            bad[node] += len(t)
    own = good > 0
    for i in range(n - 1, 0, -1):
        good[page.parent[i]] += good[i]
        bad[page.parent[i]] += bad[i]
    # the article's container is content though an advert stands in it
    return (own | (good > 2 * bad)).astype(int)


def fit(pages: list[tuple[str, list[str]]], rounds: int = 40, rate: float = 0.15, decay: float = 1e-3) -> np.ndarray:
    """Weights by Adam on the mean conditional log-likelihood of the labelled trees."""
    data = []
    for source, blocks in pages:
        page = parse(source)
        x, kind, parent = features(page)
        y = states(page, blocks)
        data.append((x, kind, parent.tolist(), y))
    w = np.zeros(WEIGHTS)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        grad = np.zeros_like(w)
        for x, kind, parent, y in data:
            unary, pair = potentials(w, x, kind)
            q, joint, _ = marginals(unary, pair, parent)
            grad[:N_UNARY] += x.T @ (y - np.array(q))
            j = np.array(joint)
            z = np.array(parent)
            same = np.stack(((y[z] == 0) & (y == 0), (y[z] == 1) & (y == 1)), 1) - j[:, [0, 3]]
            same[0] = 0
            np.add.at(grad[N_UNARY:].reshape(N_KIND, N_PAIR), kind, same)
        grad = grad / len(data) - decay * w
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad**2
        w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w


_fitted: list[np.ndarray] = []


def weights() -> np.ndarray:
    """The default model, fitted once for each process on labelled_pages()."""
    if not _fitted:
        _fitted.append(fit(labelled_pages(400)))
    return _fitted[0]


def extract(source: str, w: np.ndarray) -> str:
    """The blocks of content, in page order, joined by blank lines; white space within a block becomes single spaces."""
    page = parse(source)
    if not page.texts:
        return ""
    x, kind, parent = features(page)
    q, _, _ = marginals(*potentials(w, x, kind), parent.tolist())
    out = []
    for node, text, _, _ in page.texts:
        if q[node] >= 0.5:
            t = " ".join(html.unescape(text).split()) if "&" in text else " ".join(text.split())
            if t:
                out.append(t)
    return "\n\n".join(out)


def extract_pages(df: DataFrame, html_col: str = "html", out_col: str = "text", w: np.ndarray | None = None) -> DataFrame:
    """df with the main text of html_col in out_col: '' for null, empty and text-free pages. Every row is kept.

    Where df has a column of out_col's name, the text's has underscores behind it. What stands in svg, math, canvas, object, audio, video
    and other elements that show no running text is not read, within an article either.
    """
    bound_batches(df.sparkSession)
    w = weights() if w is None else w

    def texts(pages: pa.Array) -> pa.Array:
        return pa.array([extract(p or "", w) for p in pages.to_pylist()], pa.string())

    return df.withColumn(free(df, out_col), F.arrow_udf(texts, "string")(F.col(html_col)))


def sql_blocks(text: str) -> str:
    """DuckDB: a column of markup without tags and with the references that the supplied pages have."""
    out = f"regexp_replace({text}, '<[^>]+>', '', 'g')"
    for name, sign in (("quot", '"'), ("lt", "<"), ("gt", ">"), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        out = f"replace({out}, '&{name};', '{sign}')"
    return out


#: DuckDB, for pages as the supplied table has them, whose articles are an element of that name with headings and
#: paragraphs, some of them left open up to a line break: the blocks of that element.
SQL = rf"""
WITH b AS (SELECT page_id, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS raw
  FROM (SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '(?s)<(?:h1|p)>.*?(?:</h1>|</p>|<br>)') AS a FROM pages)),
t AS (SELECT page_id, i, trim(regexp_replace({sql_blocks('raw')}, '\s+', ' ', 'g')) AS t FROM b),
x AS (SELECT page_id, string_agg(t, chr(10) || chr(10) ORDER BY i) AS text FROM t WHERE t <> '' GROUP BY 1)
SELECT page_id, url, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n_chars FROM pages LEFT JOIN x USING (page_id)
"""
