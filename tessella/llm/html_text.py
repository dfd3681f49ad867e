"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of its block elements with the runs of text in them as leaves. Every node is content or not: its
tag, words of its class, id and role, and the looks of its text speak for it, and a potential for each kind of node ties
it to its parent. Sum-product messages go up and down the tree once and give each leaf's marginal; leaves at 0.5 or more
are the text. The weights are fitted by maximum likelihood, with the same messages, to labelled pages: `labelled_pages`
lays out a fixed number of them at random from a seed, with known labels; others can be given.

Defined cases: a null or empty page has the empty text; scripts and styles that never close go on to the page's end, and
other hidden elements that close by themselves, or not within their parent, are empty; comments end as in HTML; end tags
without a start are passed over; pages of any length are read whole, a batch of texts at a time; repeated rows get equal
texts; extra columns stay as they are, and where one is called text, the result is text_.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm import _spark as S

#: Fixed values of HTML: elements without an end, elements whose insides are no markup, elements whose insides are not shown as text, elements within a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OPAQUE = frozenset("script style noscript textarea title iframe noembed noframes".split())
HIDDEN = frozenset("template select svg object canvas audio video annotation annotation-xml".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: A start tag of the key ends an open element of the value, up to the container after it.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"})}
#: Words of a class, id or role that may tell what an element is for.
CUES = "ad ads advert advertisement aside banner body breadcrumb button comment comments consent content contentinfo cookie copyright disclaimer entry feed footer form header headline hero lead legal login main masthead menu meta modal nav navbar navigation newsletter notice pager pagination popup post promo promoted reader reaction recommended related replies reply respond search section share sidebar signup social sponsor sponsored story subscribe tag tags text toolbar top topbar widget article".split()
TAGS = "html body div section article main header footer nav aside form ul ol dl li dt dd table tbody thead tr td th p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption details summary fieldset address center menu head".split()
KINDS = {**dict.fromkeys("p h1 h2 h3 h4 h5 h6 blockquote pre dt dd td th li figcaption summary address".split(), 1), **dict.fromkeys("ul ol dl table tbody thead tr menu figure".split(), 2), **dict.fromkeys("nav aside header footer form fieldset".split(), 4)}
LEAF, OTHER, N_KINDS = 0, 3, 5

_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_CUED = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_WORD = re.compile(r"[a-z]+")
_FEATURES = {name: i for i, name in enumerate([*[f"tag {t}" for t in TAGS], "tag ?", *[f"cue {c}" for c in CUES], *[f"size {i}" for i in range(6)], "links none", "links some", "links most", "stops none", "stops some", "stops many", "ends in a stop", "copyright", *[f"box size {i}" for i in range(8)], "box links none", "box links some", "box links most", *[f"box stops {i}" for i in range(4)]])}
_TAG = {t: _FEATURES[f"tag {t}"] for t in TAGS}
_CUE = {c: _FEATURES[f"cue {c}"] for c in CUES}
N_FEATURES = len(_FEATURES)


@lru_cache(maxsize=4096)
def _cues(attributes: str) -> tuple[int, ...]:
    found = set()
    for value in _CUED.findall(attributes):
        split = re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()
        found.update(_CUE[w] for w in _WORD.findall(split) if w in _CUE)
    return tuple(sorted(found))


def _raw_end(html: str, name: str, at: int, attributes: str, no_end: set[str]) -> int:
    """Where an element whose insides are no markup ends. Code that never ends goes on to the page's end; other elements
    without an end, or closed by themselves, are empty. no_end: names known to have no end from here on."""
    code = name in ("script", "style")
    if not code and attributes.endswith("/"):
        return at
    stop = None if name in no_end else re.compile(f"</{name}(?=[\\s/>]|\\Z)[^>]*(?:>|\\Z)", re.I).search(html, at)
    if stop is None:
        no_end.add(name)
        return len(html) if code else at
    return stop.end()


def _hidden(html: str, at: int, tags: list[str]) -> dict[int, int]:
    """Of hidden elements from here on that end within their parents: from the end of the start tag to that of the end tag. tags: what is open."""
    out, open_, count, no_end = {}, [(t, 0) for t in tags], Counter(tags), set()
    while (m := _TOKEN.search(html, at)) is not None:
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name = name.lower()
        if not (m[1] or m[4]):
            if name in OPAQUE:
                at = _raw_end(html, name, at, m[3] or m[6] or "", no_end)
            elif name not in VOID and not ((name == "svg" or count["svg"]) and (m[3] or m[6] or "").endswith("/")):
                open_.append((name, at))
                count[name] += 1
        elif count[name]:
            while True:
                top, start = open_.pop()
                count[top] -= 1
                if top == name:
                    break
            if name in HIDDEN and start:
                out[start] = at
    return out


class Forest:
    """Nodes of many pages: parents, depths, kinds, features; leaves have texts. A page's first node is its root."""

    def __init__(self):
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.kind: list[int] = []
        self.node: list[int] = []
        self.feature: list[int] = []
        self.leaves: list[tuple[int, int, str]] = []  # page, node, text
        self.pages = 0

    def _add(self, parent: int, kind: int, features) -> int:
        n = len(self.parent)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.kind.append(kind)
        self.node.extend([n] * len(features))
        self.feature.extend(features)
        return n

    def _look(self, n: int, box: list[int]) -> None:
        """What an element looks like as a whole."""
        found = _box_looks(*box)
        self.node.extend([n] * len(found))
        self.feature.extend(found)

    def add(self, html: str) -> None:
        page, self.pages = self.pages, self.pages + 1
        stack, tags = [self._add(-1, OTHER, ())], [""]
        run: list[str] = []
        linked, in_link, at = 0, False, 0
        hidden: dict[int, int] | None = None
        no_end: set[str] = set()
        boxes = [[0, 0, 0, 0]]  # of each open element: characters, those in links, words, stops

        def flush() -> None:
            nonlocal linked
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                self.leaves.append((page, self._add(stack[-1], LEAF, _looks(text, linked)), text))
                box = boxes[-1]
                box[0] += len(text)
                box[1] += min(linked, len(text))
                box[2] += text.count(" ") + 1
                box[3] += _stops(text)
            linked = 0

        def close(upto: int) -> None:
            flush()
            while len(stack) > upto:
                box = boxes.pop()
                self._look(stack.pop(), box)
                for i in range(4):
                    boxes[-1][i] += box[i]
            del tags[upto:]

        while (m := _TOKEN.search(html, at)) is not None:
            if m.start() > at:
                raw = html[at : m.start()]
                if "&" in raw:
                    raw = unescape(raw)
                run.append(raw)
                if in_link:
                    linked += len(raw)
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name, end = name.lower(), bool(m[1] or m[4])
            if name in INLINE:
                if name == "a":
                    in_link = not end
                continue
            if name == "br":
                run.append(" ")
                continue
            if name in OPAQUE:
                if not end:
                    at = _raw_end(html, name, at, m[3] or m[6] or "", no_end)
                continue
            if name in HIDDEN:
                if not end:
                    if hidden is None:
                        hidden = _hidden(html, m.start(), tags[1:])
                    at = hidden.get(at, at)
                continue
            if end:
                for i in range(len(tags) - 1, 0, -1):
                    if tags[i] == name:
                        close(i)
                        in_link = False
                        break
                continue
            if name in VOID and name != "hr":
                continue
            if name in ENDS_P:
                for i in range(len(tags) - 1, 0, -1):
                    if tags[i] == "p":
                        close(i)
                        break
                    if tags[i] in ("td", "th", "div", "li", "section", "article", "body"):
                        break
            if name in ENDS:
                ended, scope = ENDS[name]
                for i in range(len(tags) - 1, 0, -1):
                    if tags[i] in scope:
                        break
                    if tags[i] in ended:
                        close(i)
                        break
            flush()
            if name == "hr":
                continue
            attributes = m[3] or m[6] or ""
            stack.append(self._add(stack[-1], KINDS.get(name, OTHER), (_TAG.get(name, _FEATURES["tag ?"]), *(_cues(attributes) if attributes else ()))))
            tags.append(name)
            boxes.append([0, 0, 0, 0])
        if at < len(html):
            run.append(unescape(html[at:]))
        close(1)

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(x, np.int64) for x in (self.parent, self.depth, self.kind, self.node, self.feature))


def _stops(text: str) -> int:
    return text.count(".") + text.count(",") + text.count("?") + text.count("!") + text.count("。")


def _looks(text: str, linked: int) -> list[int]:
    n = len(text)
    words, stops = text.count(" ") + 1, _stops(text)
    return [
        _FEATURES[f"size {min(words.bit_length() - 1, 5)}"],
        _FEATURES["links most" if 2 * linked > n else "links some" if linked else "links none"],
        _FEATURES["stops none" if not stops else "stops some" if stops < 4 else "stops many"],
        *([_FEATURES["ends in a stop"]] if text[-1] in ".!?…»”\"" else []),
        *([_FEATURES["copyright"]] if "©" in text else []),
    ]


def _box_looks(chars: int, linked: int, words: int, stops: int) -> list[int]:
    if not chars:
        return []
    return [
        _FEATURES[f"box size {min(words.bit_length() // 2, 7)}"],
        _FEATURES["box links most" if 2 * linked > chars else "box links some" if linked else "box links none"],
        _FEATURES[f"box stops {min(40 * stops // (words + 1), 3)}"],
    ]


class Tree:
    """Sum-product on all trees at once, level by level."""

    def __init__(self, forest: Forest):
        self.parent, depth, self.kind, self.node, self.feature = forest.arrays()
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(depth.max() + 2)) if len(depth) else [0]
        self.levels = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def marginals(self, weight: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of each node, and P(parent's state, own state) of each node but the roots. pair[kind, parent, own]: potentials."""
        n = len(self.parent)
        local = np.zeros((n, 2))
        local[:, 1] = np.bincount(self.node, weight[self.feature], n)
        up, sent, psi = local.copy(), np.zeros((n, 2)), pair[self.kind]
        for level in reversed(self.levels[1:]):
            sent[level] = np.logaddexp(psi[level, :, 0] + up[level, None, 0], psi[level, :, 1] + up[level, None, 1])
            np.add.at(up, self.parent[level], sent[level])
        down = np.zeros((n, 2))
        both = np.zeros((n, 2, 2))
        for level in self.levels[1:]:
            p = self.parent[level]
            rest = up[p] + down[p] - sent[level]
            joint = rest[:, :, None] + psi[level] + up[level][:, None, :]
            joint -= joint.max(axis=(1, 2), keepdims=True)
            joint = np.exp(joint)
            both[level] = joint / joint.sum(axis=(1, 2), keepdims=True)
            down[level] = np.logaddexp(rest[:, 0, None] + psi[level, 0], rest[:, 1, None] + psi[level, 1])
        belief = up + down
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), both


def _state(forest: Forest, labels: list[int]) -> np.ndarray:
    """A leaf's label; of an element, whether any leaf under it is content."""
    state = np.zeros(len(forest.parent), np.int64)
    for (_, node, _), y in zip(forest.leaves, labels, strict=True):
        while y and node >= 0 and not state[node]:
            state[node] = 1
            node = forest.parent[node]
    return state


def fit(pages: list[tuple[str, list[int]]], steps: int = 150, penalty: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """Weights of features and of pairs that make the labels likely. pages: html and a label for each of its runs of text, in order."""
    forest, labels = Forest(), []
    for html, own in pages:
        forest.add(html)
        labels += own
    tree, y = Tree(forest), _state(forest, labels)
    w, pair = np.zeros(N_FEATURES), np.zeros((N_KINDS, 2, 2))
    seen_w, seen_p = np.full(w.shape, 1e-8), np.full(pair.shape, 1e-8)
    inner = tree.parent >= 0
    given = np.zeros(pair.shape)
    np.add.at(given, (tree.kind[inner], y[tree.parent[inner]], y[inner]), 1)
    for _ in range(steps):
        p, both = tree.marginals(w, pair)
        g = np.bincount(tree.feature, (y - p)[tree.node], N_FEATURES) - penalty * w
        expected = np.zeros(pair.shape)
        np.add.at(expected, tree.kind[inner], both[inner])
        h = given - expected - penalty * pair
        seen_w += g * g
        seen_p += h * h
        w += 0.5 * g / np.sqrt(seen_w)
        pair += 0.5 * h / np.sqrt(seen_p)
    return w, pair


def labelled_pages(n: int = 240, seed: int = 8, hashed: float = 0.3) -> list[tuple[str, list[int]]]:
    """Pages laid out at random, with a label for each run of text: menus, headers, footers, sidebars, notices, adverts, forms and comments around an article.
    On a share `hashed` of the pages names of classes and ids say nothing, as those that build tools make."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        label: list[int] = []
        vocabulary = ["".join(r.choice("aeiounrtlsdmäéñ") for _ in range(r.randint(2, 9))) for _ in range(60)]

        def words(a: int, b: int, stops: float, vocabulary=vocabulary) -> str:
            w = [r.choice(vocabulary) + (r.choice(".,") if r.random() < stops else "") for _ in range(r.randint(a, b))]
            return " ".join(w) + ("." if stops else "")

        def text(y: int, a: int, b: int, stops: float = 0.0, label=label) -> str:
            label.append(y)
            return words(a, b, stops) + (" ©" if r.random() < 0.02 else "")

        def links(k: int, label=label, words=words) -> str:
            label.extend([0] * k)
            return "".join(f'<li><a href="/x">{words(1, 3, 0)}</a></li>' for _ in range(k))

        def named(tag: str, *names: str) -> str:
            if r.random() < 0.5 or tag == "div":
                return f'{tag} {r.choice(["class", "id"])}="{r.choice(names)}"'
            return tag

        def junk(text=text, links=links) -> str:
            kind = r.randrange(8)
            if kind == 0:
                tag = r.choice(["nav", "div"])
                return f"<{named(tag, 'menu', 'nav', 'navbar', 'main-menu', 'top-nav')}><ul>{links(r.randint(2, 8))}</ul></{tag}>"
            if kind == 1:
                tag = r.choice(["aside", "div"])
                return f"<{named(tag, 'sidebar', 'widget', 'related', 'recommended')}><h3>{text(0, 1, 4)}</h3><ul>{links(r.randint(1, 6))}</ul><p>{text(0, 5, 30, 0.15)}</p></{tag}>"
            if kind == 2:
                return f"<div class=\"{r.choice(['ad', 'ads', 'advert', 'banner', 'sponsored', 'promo'])}\">{text(0, 3, 30, r.choice([0, 0.2]))}</div>"
            if kind == 3:
                return f"<div class=\"{r.choice(['cookie', 'notice', 'consent', 'cookie-notice', 'popup'])}\"><p>{text(0, 6, 40, 0.15)}</p></div>"
            if kind == 4:
                return f"<{named('form', 'search', 'login', 'newsletter', 'subscribe')}><label>{text(0, 1, 5)}</label><input name=q><p>{text(0, 3, 15, 0.1)}</p></form>"
            if kind == 5:
                k = r.randint(1, 5)
                inner = "".join(f"<div class=\"comment\"><h4>{text(0, 1, 3)}</h4><p>{text(0, 5, 60, 0.15)}</p></div>" for _ in range(k))
                tag = r.choice(["section", "div"])
                return f"<{tag} {r.choice(['class', 'id'])}=\"{r.choice(['comments', 'reader-comments', 'replies'])}\">{inner}</{tag}>"
            if kind == 6:
                return f"<div class=\"{r.choice(['share', 'social', 'tags', 'pager', 'breadcrumb'])}\"><ul>{links(r.randint(2, 5))}</ul></div>"
            return f"<{named('header', 'masthead', 'top', 'header')}><h2>{text(0, 1, 5)}</h2><p>{text(0, 2, 12, r.choice([0, 0.1]))}</p></header>"

        def article(text=text) -> str:
            manner = r.choice([0, 0.1, 0.15, 0.15, 0.6, 1])  # from lists of words to a full stop after each
            parts = [f"<h1>{text(1, 2, 14)}</h1>"] if r.random() < 0.85 else []
            for _ in range(r.randint(1, 12)):
                kind = r.random()
                if kind < 0.72:
                    parts.append(f"<p>{'<b>' if r.random() < 0.2 else ''}{text(1, 1, r.choice([6, 30, 150]), manner)}" + ("</p>" if r.random() < 0.8 else "<br>"))
                elif kind < 0.8:
                    parts.append(f"<h2>{text(1, 1, 8)}</h2><p>{text(1, 10, 80, 0.12)}</p>")
                elif kind < 0.87:
                    parts.append("<ul>" + "".join(f"<li>{text(1, 2, 25, 0.05)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
                elif kind < 0.93:
                    parts.append(f"<blockquote><p>{text(1, 5, 40, 0.1)}</p></blockquote>")
                else:
                    parts.append("<table>" + "".join(f"<tr><td>{text(1, 1, 4)}</td><td>{text(1, 1, 6)}</td></tr>" for _ in range(r.randint(1, 3))) + "</table>")
                if r.random() < 0.05:
                    parts.append(junk())
            tag = r.choice(["article", "article", "article", "main", "main", "div", "section"])
            shell = named(tag, "content", "article", "post", "entry", "story", "main", "article-body", "entry-content") if tag != "article" or r.random() < 0.3 else tag
            return f"<{shell}>{''.join(parts)}</{tag}>"

        page = "".join(junk() for _ in range(r.randint(1, 4)))
        body = article()
        if r.random() < 0.3:
            body = f"<div class=\"{r.choice(['wrapper', 'page', 'container', 'row'])}\">{body}{junk() if r.random() < 0.5 else ''}</div>"
        page += body + "".join(junk() for _ in range(r.randint(0, 3)))
        if r.random() < 0.85:
            page += f"<{named('footer', 'footer', 'copyright')}>{r.choice(['&copy; ', ''])}{text(0, 2, 25, r.choice([0, 0.1]))}</footer>"
        if r.random() < hashed:
            page = re.sub(r'(class|id)="[^"]*"', lambda m: f'{m[1]}="{r.choice("abcsx")}{r.getrandbits(28):x}"', page)  # noqa: B023
        out.append((f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body>{page}</body></html>", label))
    return out


def _extracted(model, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, pair = model
        for batch in batches:
            pages = batch.column(column).to_pylist()
            for a in range(0, len(pages), 400):
                forest = Forest()
                for html in pages[a : a + 400]:
                    forest.add(html or "")
                p, _ = Tree(forest).marginals(weight, pair)
                blocks: list[list[str]] = [[] for _ in range(forest.pages)]
                for page, node, text in forest.leaves:
                    if p[node] >= 0.5:
                        blocks[page].append(text)
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(a, 400), pa.array(["\n\n".join(b) for b in blocks], pa.string())], names=["row", "text"])

    return run


def extract(pages: DataFrame, model: tuple[np.ndarray, np.ndarray] | None = None, column: str = "html") -> DataFrame:
    """Every column of pages but `column`, and text (text_ where they have a text): the main text, its blocks joined by two newlines."""
    kept = [c for c in pages.columns if c != column]
    rows = pages.select(F.struct(*kept).alias("row"), F.col(column).alias("html"))
    found = rows.mapInArrow(_extracted(model or fit(labelled_pages()), "html"), T.StructType([rows.schema["row"], T.StructField("text", T.StringType())]))
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], F.col("text").alias(S.free(kept, "text")))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
