"""HTML extraction (operator 7): main text by minimum cut.

A page is read as a tree of block-level elements with text blocks as leaves. Elements and blocks are the nodes of a graph.

- Terminal capacities: a logistic classifier of what a block says (length, punctuation, linked share, digits; no names of
  tags or classes) gives each block the capacity of its log-odds, at most LIMIT, to the content side or to the other. Its
  weights start from PRIOR and are fitted on blocks of a bounded sample of pages, those inside elements whose tag states their
  role. Elements that state a role (article, nav, names of classes) have a finite capacity of their own, in proportion to
  what they hold; on a page with an article so does the page itself, towards boilerplate.
- Smoothness edges: between a node and its DOM parent, between neighbouring blocks (more under one parent), and between
  neighbouring elements of one tag. Within an element that states its role, ties to the parent are TIE for each block held.

The cut is exact. An undirected edge that outweighs everything else at one of its ends lies on no minimum cut, so such
nodes are merged before Dinic's algorithm runs; TIE is such that this merges all of a stated element but elements within it
that state another role. Blocks whose own capacity outweighs all their edges keep their side.

Character references are decoded, white space inside a block becomes one space, blocks without text are left out, and
content blocks are joined by line feeds in page order. ``<br>`` is white space. Null and empty pages have an empty text, as
has a page without content. Markup may be broken: unclosed elements end with the page, a last unended tag is dropped, and of
an unclosed element that isn't raw text only the tag is. Only page_id, url and html are read; page_id and url may be null or
repeat, and repeated rows give repeated results. An empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pages (about) and blocks (at most) that the classifier is fitted on.
SAMPLE_PAGES, SAMPLE_BLOCKS = 4000, 200_000
#: Largest capacity of a block; tie of a block to an element that states its role: over LIMIT and all other edges of a block.
LIMIT, TIE = 3.0, 5.0
#: Edges: to a parent without a role, between neighbouring blocks under one parent, under two, between like elements.
LOOSE, BESIDE, ACROSS, ALIKE = 0.5, 0.6, 0.2, 0.3
#: Weights of the features before any block is seen.
PRIOR = np.array([0.9, 1.0, 1.0, -8.0, -0.6, 0.0, 0.0])

_RAW = {"script", "style", "iframe", "textarea", "title"}
_SKIPPED = {"template", "noscript", "svg", "object", "select", "canvas"}
_INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_INLINE |= set("math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mspace semantics".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BAD = set("nav header footer aside form button dialog menu head".split())
_GOOD = {"article", "main"}
#: Elements whose end is implied by the start of another.
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu", "menubar", "form"}
_NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|banner|breadcrumbs?|comments?|comment-list|respond|cookies?|consent|disclaimer|footer|header|masthead|menu|nav|navbar|navigation|newsletter|notices?|pager|pagination|popup|promo|related|share|sharing|sidebar|social|sponsor(?:ed)?|subscribe|toolbar|widget)(?:$|[\s_-])",
    re.I,
)
_TAG = re.compile(r"""<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
_ATTRIBUTE = re.compile(r"""([A-Za-z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")
_ENDS = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in _RAW | _SKIPPED}
_BLANKS = re.compile(r"\s+")
_STOPS = re.compile(r"[.,;:!?]")
_DIGITS = re.compile(r"[0-9]")


class Page:
    """Elements (0 is the page; parent, tag, role: 1 content, -1 boilerplate, 0 none) and blocks (text, element, linked characters)."""

    def __init__(self, page: str):
        self.parent, self.tag, self.role = [-1], [""], [0]
        self.text: list[str] = []
        self.home: list[int] = []
        self.linked: list[int] = []
        self._read(page)
        for k, tag in enumerate(self.tag):  # a form around the article is no form of the article's
            if tag in _GOOD:
                k = self.parent[k]
                while k > 0 and self.tag[k] != "form":
                    k = self.parent[k] if self.role[k] >= 0 else 0
                if k > 0 and self.role[k] < 0:
                    self.role[k] = 0
        # the element that states the role of each; boilerplate stays so whatever it holds
        self.region = [0] * len(self.parent)
        for k in range(1, len(self.parent)):
            above = self.region[self.parent[k]]
            if self.role[above] < 0 and above or not self.role[k]:
                self.region[k] = above
            else:
                self.region[k] = k
        self.stated = [self.role[self.region[k]] for k in self.home]
        if 1 in self.stated:
            self.role[0] = -1

    def _open(self, above: int, tag: str, attributes: str) -> int:
        role = 1 if tag in _GOOD else 0
        if tag in _BAD:
            role = -1
        elif attributes and tag not in ("body", "html", "article", "main"):
            got = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
            if got.get("role", "").lower() in _ROLE or "hidden" in got or any(_NAMED.search(got.get(k, "")) for k in ("class", "id")):
                role = -1
        self.parent.append(above)
        self.tag.append(tag)
        self.role.append(role)
        return len(self.parent) - 1

    def _read(self, page: str) -> None:
        open_, names = [0], Counter()
        held: list[str] = []
        links = linked = 0
        no_end: set[str] = set()  # what the rest of the page has no end of

        def flush() -> None:
            nonlocal linked
            text = _BLANKS.sub(" ", entities.unescape("".join(held))).strip()
            held.clear()
            if text:
                self.text.append(text)
                self.home.append(open_[-1])
                self.linked.append(min(linked, len(text)))
            linked = 0

        at, n = 0, len(page)
        while at < n:
            lt = page.find("<", at)
            said = page[at : lt if lt >= 0 else n]
            if said:
                held.append(said)
                if links:
                    linked += len(said.strip())
            if lt < 0:
                break
            if page.startswith("<!--", lt) and "--" not in no_end:
                end = page.find("-->", lt + 4)
                if end < 0:
                    no_end.add("--")
                at = n if end < 0 else end + 3
                continue
            if page.startswith(("<!", "<?"), lt):
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
                continue
            m = _TAG.match(page, lt)
            if not m:
                if re.match(r"</?[A-Za-z]", page[lt : lt + 3]):  # a tag that never ends, or whose quote never does
                    end = page.find(">", lt)
                    at = n if end < 0 else end + 1
                else:
                    held.append("<")
                    at = lt + 1
                continue
            at, tag = m.end(), m[2].lower()
            if m[1]:
                if tag == "a":
                    links = max(0, links - 1)
                if tag in _INLINE:
                    continue
                flush()
                if names[tag]:
                    while True:
                        closed = self.tag[open_.pop()]
                        names[closed] -= 1
                        if closed == tag:
                            break
                continue
            ended = m[3].endswith("/")
            if tag in _ENDS and not ended:
                end = None if tag in no_end else _ENDS[tag].search(page, at)
                if end:
                    at = end.end()
                else:
                    no_end.add(tag)
                    at = n if tag in _RAW else at
                held.append(" ")
                continue
            if tag == "br":
                held.append(" ")
                continue
            if tag in _INLINE:
                links += tag == "a"
                continue
            flush()
            if tag in _VOID or ended:
                continue
            if tag in _CLOSES and self.tag[open_[-1]] in _CLOSES[tag]:
                names[self.tag[open_.pop()]] -= 1
            open_.append(self._open(open_[-1], tag, m[3]))
            names[tag] += 1
        flush()


def features(text: str, linked: int) -> tuple[float, ...]:
    n = len(text)
    return (1.0, min(n, 400) / 80, min(len(_STOPS.findall(text)), 12) / 3, linked / n, float(n < 25), float(text[-1] in ".!?"), len(_DIGITS.findall(text)) / n)


def fitted(x: np.ndarray, y: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Weights of a logistic model by Newton steps, both labels weighing the same, drawn towards PRIOR."""
    w = PRIOR.copy()
    if not len(y) or y.min() == y.max():
        return w
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (y - p)) - (w - PRIOR)
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + np.eye(len(w)), grad)
        w = w + step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def minimum_cut(net: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes lie on the source's side of a minimum cut, by Dinic's algorithm.

    net: capacity from the source, or, negative, to the sink; edges (u, v, capacity) hold both ways.
    """
    n = len(net)
    if not any(c > 0 for c in net):
        return [False] * n
    s, t, small = n, n + 1, 1e-12
    out: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def edge(u: int, v: int, there: float, back: float) -> None:
        out[u].append(len(to))
        out[v].append(len(to) + 1)
        to.extend((v, u))
        room.extend((there, back))

    for u, v, c in edges:
        if u != v and c > 0:
            edge(u, v, c, c)
    for i, c in enumerate(net):
        if c > 0:
            edge(s, i, c, 0.0)
        elif c < 0:
            edge(i, t, -c, 0.0)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for e in out[u]:
                v = to[e]
                if room[e] > small and level[v] < 0:
                    level[v] = level[u] + 1
                    if v != t:
                        queue.append(v)
        if level[t] < 0:
            return [d >= 0 for d in level[:n]]
        place, path, u = [0] * (n + 2), [], s
        while True:
            if u == t:
                most = min(room[e] for e in path)
                cut = len(path)
                for k, e in enumerate(path):
                    room[e] -= most
                    room[e ^ 1] += most
                    if room[e] <= small and k < cut:
                        cut = k
                u = to[path[cut] ^ 1]
                del path[cut:]
                continue
            own, k = out[u], place[u]
            while k < len(own) and not (room[own[k]] > small and level[to[own[k]]] == level[u] + 1):
                k += 1
            place[u] = k
            if k < len(own):
                path.append(own[k])
                u = to[own[k]]
            elif u == s:
                break
            else:
                e = path.pop()
                u = to[e ^ 1]
                place[u] += 1


def content_side(source: list[float], sink: list[float], edges: list[float]) -> list[bool]:
    """minimum_cut on a chain: edges[i] joins nodes i and i + 1."""
    return minimum_cut([a - b for a, b in zip(source, sink, strict=True)], [(i, i + 1, c) for i, c in enumerate(edges)])


def capacities(page: Page, weights: np.ndarray) -> np.ndarray:
    """Of each block: its log-odds of being content, within LIMIT."""
    x = np.array([features(t, k) for t, k in zip(page.text, page.linked, strict=True)])
    return np.clip(x @ weights, -LIMIT, LIMIT)


def graph(page: Page, z: np.ndarray) -> tuple[list[float], list[tuple[int, int, float]]]:
    """The whole graph: capacities of elements, then of blocks, and the smoothness edges."""
    n, role, region = len(page.parent), page.role, page.region
    held = [1] * n  # blocks below an element that are of its own region, and regions that begin there, and one
    for k in page.home:
        held[k] += 1
    for k in range(n - 1, 0, -1):
        held[page.parent[k]] += 1 if region[k] == k else held[k] - 1
    net = [TIE * held[k] * role[region[k]] if region[k] == k else 0.0 for k in range(n)] + z.tolist()
    edges, last = [], {}
    for k in range(1, n):
        up = page.parent[k]
        edges.append((k, up, TIE * held[k] if region[k] == region[up] and role[region[k]] else LOOSE))
        if (up, page.tag[k]) in last and region[k] == region[up]:
            edges.append((last[up, page.tag[k]], k, ALIKE))
        last[up, page.tag[k]] = k
    for i, k in enumerate(page.home):
        edges.append((n + i, k, TIE if role[region[k]] else LOOSE))
        if i:
            edges.append((n + i - 1, n + i, BESIDE if page.home[i - 1] == k else ACROSS))
    return net, edges


def reduced(page: Page, net: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The side of each block in a minimum cut of the graph; equal to minimum_cut on all of it, but for blocks at no cost either way."""
    n, role, region = len(page.parent), page.role, page.region
    # ties in a region outweigh all else at their lower end, from the leaves up, so a region is one node
    rep = [region[k] if role[region[k]] else k for k in range(n)] + [region[k] if role[region[k]] else n + i for i, k in enumerate(page.home)]
    total = np.bincount(rep, net, len(net))
    if edges:
        u, v, c = (np.array(x) for x in zip(*edges, strict=True))
        at = np.array(rep)
        u, v = at[u], at[v]
        some = u != v
        u, v, c = u[some], v[some], c[some]
    else:
        u, v, c = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    fixed = np.zeros(len(net), bool)
    while len(u):  # a node whose capacity outweighs its edges keeps its side; its edges become its neighbours' capacities
        load = np.bincount(u, c, len(net)) + np.bincount(v, c, len(net))
        new = (np.abs(total) >= load) & (total != 0) & ~fixed & (load > 0)
        if 100 * new.sum() < len(u):  # the rest is left to the flow
            break
        fixed |= new
        side = np.sign(total)
        for a, b in ((u, v), (v, u)):
            pulls = new[a] & ~fixed[b]
            np.add.at(total, b[pulls], c[pulls] * side[a[pulls]])
        open_ = ~(fixed[u] | fixed[v])
        u, v, c = u[open_], v[open_], c[open_]
    left = np.unique(np.concatenate([u, v]))
    keep = total > 0
    if len(left):
        place = np.full(len(net), -1)
        place[left] = np.arange(len(left))
        keep[left] = minimum_cut(total[left].tolist(), list(zip(place[u].tolist(), place[v].tolist(), c.tolist(), strict=True)))
    return [bool(keep[rep[n + i]]) for i in range(len(page.home))]


def main_text(page: str | None, weights: np.ndarray = PRIOR) -> str:
    read = Page(page or "")
    if not read.text:
        return ""
    keep = reduced(read, *graph(read, capacities(read, weights)))
    return "\n".join(t for t, ok in zip(read.text, keep, strict=True) if ok)


def learn(pages: DataFrame, sample: int = SAMPLE_PAGES) -> np.ndarray:
    """The classifier's weights from about `sample` pages, chosen by a hash of url and page_id (all, if there are no more)."""
    n, steps = pages.count(), 1 << 30
    some = pages.select(F.col("url").cast("string").alias("url"), F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    some = some.filter(F.pmod(F.xxhash64("url", "page_id"), F.lit(steps)) < int(steps * min(1.0, sample / max(n, 1))))

    def measure(batches):
        for batch in batches:
            rows = []
            for p in batch["html"].to_pylist():
                page = Page(p or "")
                rows += [(*features(t, k), float(r > 0)) for t, k, r in zip(page.text, page.linked, page.stated, strict=True) if r]
            yield pa.RecordBatch.from_arrays([pa.array([np.array(r).tobytes() for r in rows], pa.binary())], names=["x"])

    got = sorted(bytes(r.x) for r in some.select("html").mapInArrow(measure, "x binary").limit(SAMPLE_BLOCKS).collect())
    x = np.frombuffer(b"".join(got), np.float64).reshape(-1, len(PRIOR) + 1)
    return fitted(x[:, :-1], x[:, -1])


def extracted(pages: DataFrame, weights: np.ndarray = PRIOR) -> DataFrame:
    """(page_id, url, text) for each page."""

    def extract(batches):
        for batch in batches:
            text = pa.array([main_text(p, weights) for p in batch["html"].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], text], names=["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(extract, "page_id long, url string, text string")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extracted(pages, learn(pages)).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
