"""Main text of web pages: a linear-chain conditional random field labels each leaf block as article text or not."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm.common import text_of
from lexivec.llm.html_blocks import Block, Element, blocks
from lexivec.llm.html_pages import labelled_pages

#: Pages that the field is trained on, by default; the bound of the training sample.
TRAINING_PAGES, TRAINING_SEED = 700, 11

_TAGS = "head title nav header footer aside form button option article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl table td th blockquote pre figure figcaption body".split()
#: Parts of class, id and role names that tell what a block is.
_WORDS = {
    "advert": "ad ads advert advertisement advertising sponsor sponsored promo promotion banner",
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs topbar toolbar pagination",
    "header": "header masthead branding logo",
    "footer": "footer legal copyright colophon bottom",
    "sidebar": "sidebar aside widget related rail recommended recommendations read popular teaser",
    "notice": "cookie cookies consent notice gdpr alert popup modal newsletter overlay privacy",
    "form": "form search login subscribe signup register input",
    "comments": "comment comments discussion reply replies disqus respond",
    "share": "share social sharing tools follow",
    "content": "content article post entry main story text body",
}
_GROUP_OF = {w: g for g, ws in _WORDS.items() for w in ws.split()}
FEATURES = [
    "bias", *[f"in:{t}" for t in _TAGS], *[f"at:{t}" for t in _TAGS], *[f"named:{g}" for g in _WORDS], "inner:chrome", "article>header", "article>chrome tag", "body alone",
    *[f"words:{n}" for n in (1, 2, 5, 10, 25)], "links:some", "links:most", "links:all", "ends a sentence", "copyright", "no letters", "first", "last",
    "page has article", "before article", "after article", "before heading", "in main container", "beside main container", "before main container", "after main container", "repeated container",
    "repeated after main", "short copyright", "comment heading", "after comment heading", "prose before", "prose after", "links before", "links after", "titles the prose", "repeats the page title", "closing copyright",
]
#: Headings of what readers wrote, by their first word.
_COMMENT_HEADINGS = set("comments comment responses replies reactions discussion opinions feedback reviews kommentare kommentar meinungen leserbriefe comentarios opiniones commentaires réactions avis".split())
#: Elements that are part of running text; what holds these is a container.
_INNER = set("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure figcaption table tbody thead tfoot tr td th header hgroup".split())
_AT = {f: i for i, f in enumerate(FEATURES)}
_IN = {t: _AT[f"in:{t}"] for t in _TAGS}
_BIT = {t: 1 << i for i, t in enumerate(_TAGS)}
_CHROME_BITS = sum(_BIT[t] for t in ("nav", "aside", "footer", "form"))


def _is_prose(b: Block) -> bool:
    return b.linked * 2 < len(b.text) and b.text.count(" ") >= 5 and b.text[-1] in ".!?:;…\"'”»"


class _Facts:
    """What an element inherits from those around it: tags of the path as bits, groups of names, whether it is inside chrome
    (the nearest element that tells), whether only plain tags are around, its innermost container, and the nearest element
    that is a container or a list item. Computed once an element, so that deep pages cost no more than flat ones."""

    __slots__ = ("chrome", "container", "groups", "plain", "solid", "tags")
    _PLAIN = frozenset(("html", "body", "p", "div", "section"))
    _CHROME = frozenset(("nav", "aside", "footer", "form"))

    def __init__(self, e: Element, up: _Facts | None):
        if up is None:
            self.tags, self.groups, self.chrome, self.plain, self.container, self.solid = 0, frozenset(), False, True, e, None
            return
        mine = {_GROUP_OF[w] for w in e.names if w in _GROUP_OF}
        self.tags = up.tags | _BIT.get(e.tag, 0)
        self.groups = up.groups if mine <= up.groups else up.groups | mine
        self.plain = up.plain and e.tag in self._PLAIN
        self.container = up.container if e.tag in _INNER else e
        self.solid = up.solid if e.tag in _INNER and e.tag != "li" else e
        if e.tag in ("article", "main") or "content" in mine:
            self.chrome = False
        else:
            self.chrome = up.chrome or e.tag in self._CHROME or bool(mine)


def _known(page: list[Block]) -> dict[Element, _Facts]:
    """The facts of all elements around the blocks."""
    facts: dict[Element, _Facts] = {}
    for b in page:
        way, e = [], b.element
        while e is not None and e not in facts:
            way.append(e)
            e = e.parent
        for e in reversed(way):
            facts[e] = _Facts(e, facts[e.parent] if e.parent else None)
    return facts


def _structure(page: list[Block], facts: dict[Element, _Facts]) -> list[list[str]]:
    """Features of each block that need the whole page: which container holds most of the prose, what is repeated, and what is near."""
    last_tag = [b.element.tag for b in page]
    of = [facts[b.element] for b in page]
    inside = [bool(f.tags & (_BIT["article"] | _BIT["main"])) for f in of]
    has_article = any(inside)
    prose = [_is_prose(b) for b in page]
    linked = [b.linked * 2 >= len(b.text) for b in page]
    # The container of a block is its innermost element that is no part of running text.
    containers = [f.container for f in of]
    # Elements with the same tag and names under one parent are repeated; rows of running text don't count.
    seen = {e: (e.parent.number, e.tag, e.names) for e in facts if e.parent}
    shapes = Counter(shape for shape in seen.values() if shape[1] not in _INNER or shape[1] == "li")
    often = {e for e, shape in seen.items() if shapes[shape] > 1}
    repeated = []
    for b in page:
        # Of the three nearest containers and list items; a list item that is the innermost element is running text.
        e, found = b.element, False
        e = facts[e].solid if e.tag not in _INNER else facts[e.parent].solid
        for _ in range(3 * bool(often)):
            if e is None:
                break
            found = found or e in often
            e = facts[e.parent].solid
        repeated.append(found)
    mass: dict[Element, int] = {}
    for b, c, p, r in zip(page, containers, prose, repeated, strict=True):
        if p:
            mass[c] = mass.get(c, 0) + (b.text.count(" ") + 1) // (3 if r else 1)
    best = max(mass, key=mass.get) if mass else None
    in_best = [bool(mass) and best.holds(b.element) for b in page]
    first_best, last_best = (in_best.index(True), len(page) - 1 - in_best[::-1].index(True)) if any(in_best) else (len(page), -1)
    first_article, last_article = (inside.index(True), len(page) - 1 - inside[::-1].index(True)) if has_article else (len(page), -1)
    headings = [i for i, t in enumerate(last_tag) if t == "h1"] or [i for i, t in enumerate(last_tag) if t == "h2"]
    last_prose = max((i for i, p in enumerate(prose) if p and "copyright" not in page[i].text.lower()), default=-1)
    title = next((b.text.lower() for b, f in zip(page, of, strict=True) if f.tags & _BIT["title"]), "")
    comments = False
    out = []
    for i, b in enumerate(page):
        on = []
        if has_article:
            on.append("page has article")
            if not inside[i]:
                on.append("before article" if i < first_article else "after article" if i > last_article else "page has article")
        if headings and i < headings[0]:
            on.append("before heading")
        if in_best[i]:
            on.append("in main container" if containers[i] == best else "beside main container")
        elif mass:
            on.append("before main container" if i < first_best else "after main container" if i > last_best else "beside main container")
        if repeated[i]:
            on.append("repeated container")
            if i > last_best:
                on.append("repeated after main")
        low = b.text.lower()
        n = low.count(" ") + 1
        if n <= 20 and ("©" in low or "copyright" in low or "rights reserved" in low or "(c) " in low):
            on.append("short copyright")
            if i > last_prose:
                on.append("closing copyright")
        if n <= 6 and not b.linked and not inside[i] and any(w.strip(":()") in _COMMENT_HEADINGS for w in low.split()):
            on.append("comment heading")
            comments = True
        elif comments:
            on.append("after comment heading")
        if i and prose[i - 1]:
            on.append("prose before")
        if i + 1 < len(page) and prose[i + 1]:
            on.append("prose after")
            if last_tag[i] in ("h1", "h2", "h3") and containers[i + 1] == containers[i]:
                on.append("titles the prose")
        if i and linked[i - 1]:
            on.append("links before")
        if i + 1 < len(page) and linked[i + 1]:
            on.append("links after")
        if i and low and low == title:
            on.append("repeats the page title")
        out.append(on)
    return out


def featurize(page: list[Block]) -> np.ndarray:
    """A row of 0 and 1 for each block."""
    x = np.zeros((len(page), len(FEATURES)))
    rows, columns = [], []
    facts = _known(page)
    for number, (b, found) in enumerate(zip(page, _structure(page, facts), strict=True)):
        on = [0, *[_AT[f] for f in found]]
        f = facts[b.element]
        on += [_IN[t] for t in _TAGS if f.tags & _BIT[t]]
        if b.element.tag in _BIT:
            on.append(_AT[f"at:{b.element.tag}"])
        on += [_AT[f"named:{g}"] for g in f.groups]
        if f.chrome:
            on.append(_AT["inner:chrome"])
        if f.tags & (_BIT["article"] | _BIT["main"]):
            if f.tags & _BIT["header"]:
                on.append(_AT["article>header"])
            if f.tags & _CHROME_BITS:
                on.append(_AT["article>chrome tag"])
        elif f.plain:
            on.append(_AT["body alone"])
        n = b.text.count(" ") + 1
        on.append(_AT[f"words:{max(k for k in (1, 2, 5, 10, 25) if n >= k)}"])
        if b.linked:
            part = b.linked / len(b.text)
            on.append(_AT["links:all" if part > 0.9 else "links:most" if part > 0.4 else "links:some"])
        if b.text[-1] in ".!?:;…\"'”»":
            on.append(_AT["ends a sentence"])
        if "©" in b.text or "copyright" in b.text.lower():
            on.append(_AT["copyright"])
        if not any(c.isalpha() for c in b.text):
            on.append(_AT["no letters"])
        rows += [number] * len(on)
        columns += on
    x[rows, columns] = 1
    if len(x):
        x[0, _AT["first"]] = x[-1, _AT["last"]] = 1
    return x


class ChainField:
    """Two labels; the score of a labelling is the sum of weights @ features over blocks with label 1 and of turns[a, b]."""

    def __init__(self, weights: np.ndarray, turns: np.ndarray):
        self.weights, self.turns = weights, turns

    @classmethod
    def train(cls, pages: list[tuple[np.ndarray, np.ndarray]], steps: int = 200, rate: float = 0.15, ridge: float = 1e-4) -> ChainField:
        """Maximum likelihood by Adam over all pages at once; pages are padded to the longest."""
        longest = max(len(y) for _, y in pages)
        x = np.zeros((len(pages), longest, len(FEATURES)))
        y = np.zeros((len(pages), longest), int)
        live = np.zeros((len(pages), longest), bool)
        for i, (xi, yi) in enumerate(pages):
            x[i, : len(yi)], y[i, : len(yi)], live[i, : len(yi)] = xi, yi, True
        flat, pairs = x[live], live[:, 1:]
        turns_seen = np.zeros((2, 2))
        np.add.at(turns_seen, (y[:, :-1][pairs], y[:, 1:][pairs]), 1)
        theta = np.zeros(len(FEATURES) + 4)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        total = live.sum()
        for t in range(1, steps + 1):
            w, turns = theta[:-4], theta[-4:].reshape(2, 2)
            e = np.zeros((len(pages), longest, 2))
            e[..., 1] = x @ w
            one, two = cls._marginals(e, live, turns)
            grad = np.r_[flat.T @ (y[live] - one[live]), (turns_seen - two).ravel()] / total - ridge * theta
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        return cls(theta[:-4], theta[-4:].reshape(2, 2))

    @staticmethod
    def _marginals(e: np.ndarray, live: np.ndarray, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The probability of label 1 at each place, and the expected number of each turn, by forward and backward sums."""
        n, longest, _ = e.shape
        forward, backward = np.zeros_like(e), np.zeros_like(e)
        forward[:, 0] = e[:, 0]
        for t in range(1, longest):
            s = forward[:, t - 1, :, None] + turns
            forward[:, t] = np.where(live[:, t, None], np.logaddexp(s[:, 0], s[:, 1]) + e[:, t], forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            s = turns + (e[:, t + 1] + backward[:, t + 1])[:, None, :]
            backward[:, t] = np.where(live[:, t + 1, None], np.logaddexp(s[..., 0], s[..., 1]), 0)
        z = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])[:, None]
        one = np.exp(forward[..., 1] + backward[..., 1] - z)
        joint = forward[:, :-1, :, None] + turns + (e[:, 1:] + backward[:, 1:])[:, :, None, :] - z[..., None, None]
        return one, np.exp(joint)[live[:, 1:]].sum(axis=0)

    def decode(self, x: np.ndarray) -> list[int]:
        """The best labelling of a page, by Viterbi."""
        if not len(x):
            return []
        scores = (x @ self.weights).tolist()
        (aa, ab), (ba, bb) = self.turns.tolist()
        off, on = 0.0, scores[0]
        back = []
        for s in scores[1:]:
            to_off, to_on = (0, off + aa) if off + aa >= on + ba else (1, on + ba), (0, off + ab) if off + ab > on + bb else (1, on + bb)
            back.append((to_off[0], to_on[0]))
            off, on = to_off[1], to_on[1] + s
        label = int(on > off)
        out = [label]
        for b in reversed(back):
            label = b[label]
            out.append(label)
        return out[::-1]


def train(pages: list[tuple[str, list[int]]]) -> ChainField:
    """A field from labelled pages (html, labels of its leaf blocks); pages whose blocks don't match their labels are errors."""
    rows = []
    for page, labels in pages:
        found = blocks(page)
        if len(found) != len(labels):
            raise ValueError(f"{len(found)} blocks, {len(labels)} labels")
        if found:
            rows.append((featurize(found), np.array(labels)))
    return ChainField.train(rows)


#: The weights of the default field with what they were trained from; made by store_weights().
WEIGHTS = Path(__file__).with_name("html_weights.json")


def store_weights(pages: int = TRAINING_PAGES, seed: int = TRAINING_SEED) -> None:
    """Trains the default field and writes its weights; to be done whenever the features or the invented pages change."""
    field = train(labelled_pages(pages, seed))
    WEIGHTS.write_text(json.dumps({"pages": pages, "seed": seed, "features": FEATURES, "weights": field.weights.tolist(), "turns": field.turns.tolist()}, indent=1) + "\n")


@lru_cache(maxsize=2)
def default_field(pages: int = TRAINING_PAGES, seed: int = TRAINING_SEED) -> ChainField:
    """The stored field, or a new one where that was trained on other pages or features."""
    known = json.loads(WEIGHTS.read_text()) if WEIGHTS.exists() else {}
    if (known.get("pages"), known.get("seed"), known.get("features")) == (pages, seed, FEATURES):
        return ChainField(np.array(known["weights"]), np.array(known["turns"]))
    return train(labelled_pages(pages, seed))


def main_text(page: str, field: ChainField) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, keep in zip(found, field.decode(featurize(found)), strict=True) if keep)


def extract(pages: DataFrame, html: str = "html", into: str = "text", field: ChainField | None = None) -> DataFrame:
    """pages with the main text of each in a column of its own in place of the html.

    Null and empty pages have an empty text. Pages are read one by one, so repeated rows, null ids and empty tables need
    no care; a column that is called like `into` is replaced. The training sample is bounded by TRAINING_PAGES."""
    field = field or default_field()

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(p, field) for p in batch], dtype=object)

    out = pages.withColumn(into, text(text_of(html)))
    return out if into == html else out.drop(html)
