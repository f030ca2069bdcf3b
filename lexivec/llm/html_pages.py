"""Labelled pages for training: invented pages whose every block is known to be article text or not."""

from __future__ import annotations

import html
import random

_SYLLABLES = "ba ce di fo gu la me ni ro su ta ve xi zo kra ple stri tho an en in on er ung ción tion lich eau aux é ü ñ".split()
_LINK_WORDS = "Home About Contact Products News Login Archive Help Jobs Sport Politik Inicio Accueil Kontakt".split()
#: Names that pages give to what is not the article, by kind.
CHROME_NAMES = {
    "menu": "menu nav navbar navigation breadcrumb topbar main-menu".split(),
    "header": "header masthead site-header page-header branding".split(),
    "footer": "footer site-footer legal copyright bottom colophon".split(),
    "sidebar": "sidebar aside widget related rail recommended most-read".split(),
    "notice": "cookie-notice banner consent notice gdpr alert popup newsletter".split(),
    "advert": "ad ads advert advertisement sponsored promo ad-slot".split(),
    "form": "search login subscribe signup contact-form comment-form".split(),
    "comments": "comments comment comment-list discussion replies disqus".split(),
    "share": "share social sharing tools".split(),
}
CONTENT_NAMES = "content article post entry main story article-body post-content entry-content text".split()


class PageMaker:
    """Pages as (html, labels): a label for each non-empty leaf block in page order, 1 for article text."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def words(self, least: int, most: int) -> str:
        r = self.rng
        out = ["".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(least, most))]
        return " ".join(out)

    def sentences(self, n: int) -> str:
        text = " ".join(self.words(4, 22).capitalize() + self.rng.choice("...,?!:") for _ in range(n))
        if self.rng.random() < 0.15:
            text = text.replace(" ", self.rng.choice(["*** ", "&&& ", "### ", "!! "]))
        return text

    def put(self, tag: str, text: str, label: int, attrs: str = "", inner: str = "{}") -> str:
        self.labels.append(label)
        close = "" if tag in ("p", "li") and self.rng.random() < self.unclosed else f"</{tag}>"
        return f"<{tag}{attrs}>{inner.format(html.escape(text, quote=False).replace('{', '').replace('}', ''))}{close}"

    def unknown(self) -> str:
        """A name that tells nothing."""
        return "".join(self.rng.choice(_SYLLABLES[:16]) for _ in range(self.rng.randint(2, 4)))

    def name(self, kind: str) -> str:
        r = self.rng
        if r.random() < 0.2:
            return ""
        if self.plain and kind not in ("advert", "notice", "share"):
            return f' {r.choice(["class", "class", "id"])}="{self.unknown()}"'
        return f' {r.choice(["class", "class", "id"])}="{r.choice(CHROME_NAMES[kind])}"'

    def links(self, n: int, label: int = 0) -> str:
        items = (self.put("li", self.rng.choice([self.words(1, 2), self.rng.choice(_LINK_WORDS)]), label, inner='<a href="/x">{}</a>') for _ in range(n))
        return f"<ul>{''.join(items)}</ul>"

    def chrome(self, kind: str) -> str:
        r = self.rng
        tag = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}.get(kind, "div")
        attrs = self.name(kind)
        if r.random() < 0.35 and attrs:
            tag = r.choice(["div", "section"])
        if tag == "div" and not attrs:
            attrs = f' class="{self.unknown() if self.plain and kind in ("menu", "header", "footer", "comments") else r.choice(CHROME_NAMES[kind])}"'
        if self.plain and kind in ("menu", "footer", "comments", "sidebar", "form") and r.random() < 0.6:
            tag = r.choice(["div", "section", "div"])
        if kind == "menu":
            body = self.links(r.randint(2, 9))
        elif kind == "header":
            body = self.put("div", self.words(1, 4), 0) + (self.put("p", self.words(3, 9), 0) if r.random() < 0.5 else "")
        elif kind == "footer":
            line = r.choice([f"© {r.randint(1999, 2026)} {self.words(1, 3).title()} Ltd.", f"Copyright {r.randint(1999, 2026)} {self.words(1, 3).title()}. All rights reserved.", f"{self.words(1, 2).title()} - all rights reserved"]) if self.plain else "© " * (r.random() < 0.7) + r.choice(["example.com · ", "2024 "]) + self.sentences(1)
            body = r.choice([self.put, self.bare])("p", line, 0)
            body += self.links(r.randint(1, 4)) if r.random() < 0.4 else ""
        elif kind == "sidebar":
            body = self.put("h3", self.words(1, 4), 0) + (self.links(r.randint(2, 6)) if r.random() < 0.6 else self.put("p", self.sentences(r.randint(1, 3)), 0))
        elif kind == "form":
            body = self.put("div", self.words(1, 4), 0) + '<input name="q">' + self.put("button", self.words(1, 2), 0)
        elif kind == "comments":
            heading = r.choice(["Comments", "2 comments", "Kommentare", "Comentarios", "Commentaires", "Reader opinions", "Responses"]) if self.plain and r.random() < 0.6 else self.words(1, 3)
            item = self.unknown() if self.plain else r.choice(["comment", "reply", "comment-body"])
            tag_of = r.choice(["div", "div", "li"]) if self.plain else "div"
            body = self.put("h3", heading, 0) if r.random() < 0.6 else ""
            for _ in range(r.randint(2, 5) if self.plain else r.randint(1, 4)):
                who = self.put(r.choice(["p", "div"]), self.words(1, 2).title() + r.choice(["", " wrote:", ", 2 days ago"]), 0) if self.plain and r.random() < 0.7 else ""
                body += f'<{tag_of} class="{item}">{who}{self.put("p", self.sentences(r.randint(1, 3)), 0)}</{tag_of}>'
        elif kind == "share":
            body = self.links(r.randint(2, 4))
        else:
            body = r.choice([self.put, self.bare])("p", self.sentences(r.randint(1, 3)), 0) + (self.put("button", self.words(1, 2), 0) if r.random() < 0.3 and kind == "notice" else "")
        return f"<{tag}{attrs}>{body}</{tag}>"

    def bare(self, tag: str, text: str, label: int) -> str:
        """The text directly in its parent."""
        self.labels.append(label)
        return html.escape(text, quote=False)

    def article(self) -> str:
        r = self.rng
        # A cell with links, which stands before the article's where that is a cell of a table.
        self.beside = ""
        layout = self.plain and r.random() < 0.15
        if layout and r.random() < 0.6:
            self.beside = self.put("td", self.words(2, 6).title(), 0, inner='<a href="/x">{}</a>')
        heading = self.put(r.choice(["h1", "h1", "h2"]), self.words(2, 12).capitalize(), 1)
        body = [f"<header>{heading}</header>" if r.random() < 0.15 else heading]
        for _ in range(r.choice([1, 2, 3, 5, 8, 13, 20])):
            kind = r.random()
            if kind < 0.8:
                inner = r.choice(["{}"] * 6 + ["<b>{}<br>", "<b>{}</b>", '<a href="/y">{}</a> ', "<em>{}</em>", "{} "])
                body.append(self.put("p", self.sentences(r.choice([1, 1, 2, 4, 7])) if r.random() < 0.9 else self.words(1, 3).capitalize() + ".", 1, inner=inner))
            elif kind < 0.86:
                body.append(self.put(r.choice(["h2", "h3"]), self.words(1, 6).capitalize(), 1))
            elif kind < 0.91:
                body.append("<ul>" + "".join(self.put("li", self.words(2, 12), 1) for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.94:
                body.append("<table>" + "".join("<tr>" + "".join(self.put("td", self.words(1, 3), 1) for _ in range(2)) + "</tr>" for _ in range(r.randint(1, 3))) + "</table>")
            elif kind < 0.96:
                body.append(f"<blockquote>{self.put('p', self.sentences(1), 1)}</blockquote>")
            else:
                body.append(self.chrome(r.choice(["advert", "share", "notice"] if self.plain else ["advert", "share", "sidebar", "notice"])))
        if r.random() < 0.08 and not self.plain:
            body.append(self.chrome("comments"))
        if self.plain:
            shapes = [("article", ""), ("main", f' id="{self.unknown()}"'), ("div", f' class="{self.unknown()}"'), ("div", ""), ("section", f' class="{self.unknown()}"'), ("", "")]
            tag, attrs = ("td", "") if layout else r.choice(shapes)
            if not tag:
                return "".join(body)
            if tag == "td":
                return f"<table><tr>{self.beside}<td>{''.join(body)}</td></tr></table>"
            return f"<{tag}{attrs}>{''.join(body)}</{tag}>"
        tag, attrs = r.choice([("article", ""), ("article", ' class="post"'), ("main", ""), ("div", f' class="{r.choice(CONTENT_NAMES)}"'), ("div", f' id="{r.choice(CONTENT_NAMES)}"')])
        end = "" if r.random() < 0.05 else f"</{tag}>"
        return f"<{tag}{attrs}>{''.join(body)}{end}"

    def page(self) -> tuple[str, list[int]]:
        r = self.rng
        self.labels: list[int] = []
        self.unclosed = r.choice([0, 0, 0.3, 1])
        #: Half of the pages have names that tell nothing.
        self.plain = r.random() < 0.5
        head = f"<!DOCTYPE html><html><head><meta charset=utf-8>{self.put('title', self.words(2, 9), 0)}<style>p{{margin:0}}</style><script>var a='</p>';</script></head><body>"
        top = "".join(self.chrome(k) for k in ("notice", "header", "menu", "form", "advert") if r.random() < 0.5)
        main = self.article()
        under = "".join(self.chrome(k) for k in ("share", "comments", "sidebar", "advert", "form", "menu", "footer") if r.random() < 0.5)
        if self.plain and r.random() < 0.3:
            under += self.put("p", f"{r.choice(['Copyright', '©', '(c)'])} {r.randint(1999, 2026)} {self.words(1, 3).title()} Ltd.", 0)
        return f"{head}{top}<!-- x -->{main}{under}" + r.choice(["</body></html>", ""]), self.labels


def labelled_pages(n: int, seed: int) -> list[tuple[str, list[int]]]:
    maker = PageMaker(seed)
    return [maker.page() for _ in range(n)]
