"""Training pages for the block labeller: random layouts around given prose, with known labels.

A page is drawn from a small grammar: notices, a header with menus, sidebars,
an article with headings, paragraphs, lists, tables and quotes, adverts and boxes
in between, reader comments, forms and a footer, under varying tag, class and id names, with
closing tags left out at times. Each text carries a private mark that says
whether it is content; the marks are taken out again when the page is cut into blocks.
"""

from __future__ import annotations

from html import escape
from random import Random

import numpy as np

from farelake.llm.html_blocks import Block, blocks_of

_MAIN, _REST = "\ue000", "\ue001"

# Names under which parts of pages are marked up, and phrases that stand in them.
MAIN_TAGS = ["article", "main", "section", "div", "td"]
MAIN_NAMES = ["article", "content", "post", "entry", "story", "main", "body", "text", "page", "article-body", "post-content", "entry-content",
              "story-text", "main-content", "news", "blog-post", "hentry"]
NAMES = {
    "menu": ["nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "tabs", "main-menu", "site-nav", "toc", "pagination",
             "pager", "languages", "links"],
    "header": ["header", "top", "masthead", "topbar", "site-header", "branding", "logo", "banner", "head"],
    "footer": ["footer", "site-footer", "bottom", "colophon", "copyright", "legal", "foot", "credits"],
    "sidebar": ["sidebar", "side", "widget", "related", "recommended", "popular", "trending", "rail", "right-col", "tags", "share",
                "social", "more-stories", "author-box", "aside", "infobox", "recent-posts"],
    "notice": ["notice", "cookie", "cookie-banner", "cookies", "consent", "gdpr", "alert", "warning", "popup", "modal", "message",
               "paywall", "announcement", "subscribe", "overlay", "toast"],
    "advert": ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "ad-slot", "banner-ad", "adsbox",
               "commercial", "teaser"],
    "comments": ["comments", "comment", "comment-list", "replies", "responses", "discussion", "reader-comments", "disqus", "thread",
                 "feedback", "reactions"],
    "form": ["form", "search", "login", "signup", "newsletter", "contact", "subscribe-form", "register"],
}
TAGS = {"menu": ["nav", "nav", "div", "ul"], "header": ["header", "header", "div"], "footer": ["footer", "footer", "div"],
        "sidebar": ["aside", "aside", "div", "section"], "notice": ["div", "div", "section", "aside", "dialog"],
        "advert": ["div", "div", "aside", "section"], "comments": ["section", "div", "div", "ol"], "form": ["form"]}
ROLES = {"menu": "navigation", "header": "banner", "footer": "contentinfo", "sidebar": "complementary", "notice": "alert", "form": "search"}
PHRASES = {
    "menu": ["Home", "About us", "Contact", "News", "Sport", "Login", "Archive", "Next", "Previous", "Start", "Inicio", "Accueil", "Kontakt"],
    "header": ["Daily News", "My Blog", "The Journal", "Welcome", "Skip to content", "All about everything", "Your source of news"],
    "footer": ["© 2024 Example Inc.", "All rights reserved.", "Privacy policy", "Terms of use", "Imprint", "Powered by a blog engine",
               "Alle Rechte vorbehalten.", "Tous droits réservés.", "Contact us at mail@example.com"],
    "sidebar": ["Related articles", "Most read", "Tags", "Share this", "Follow us", "Recent posts", "Read more", "You may also like", "About the author"],
    "notice": ["We use cookies to improve your experience.", "Accept all", "This site uses cookies.", "Please enable JavaScript.",
               "Subscribe to continue reading.", "Wir verwenden Cookies.", "Nous utilisons des cookies.", "Breaking: site maintenance tonight"],
    "advert": ["Advertisement", "Sponsored", "Buy now", "Special offer", "Anzeige", "Publicité", "Publicidad", "Click here to win"],
    "comments": ["Comments", "3 comments", "Reply", "Leave a reply", "Posted by Anna", "Report", "Great article!", "I do not agree.", "Log in to comment"],
    "form": ["Search", "Email", "Your name", "Subscribe", "Send", "Password", "Submit", "Sign up for our newsletter"],
}


class _Page:
    def __init__(self, r: Random, prose: list[str]):
        self.r, self.prose, self.tidy = r, prose, r.random() < 0.7
        self.plain = r.random() < 0.25  # no class names where the tag tells

    def words(self, low: int, high: int) -> str:
        return " ".join(self.r.choice(self.prose).split()[:self.r.randint(low, high)]) or "Word."

    def mark(self, text: str, main: bool) -> str:
        return (_MAIN if main else _REST) + escape(text, quote=False)

    def named(self, kind: str | None, names: list[str], force: bool) -> str:
        """Class, id or role that tells the part, perhaps with other names around it."""
        r, found = self.r, ""
        if force or (not self.plain and r.random() < 0.7):
            own = [r.choice(names)] + [r.choice(["col-md-8", "clearfix", "css-1x2y", "wrap", "row", "js-block", "left", "block"])] * (r.random() < 0.3)
            r.shuffle(own)
            found = f' class="{" ".join(own)}"' if r.random() < 0.75 else f' id="{own[0]}"'
        if kind in ROLES and r.random() < 0.1:
            found += f' role="{ROLES[kind]}"'
        return found

    def part(self, kind: str, inner: str) -> str:
        tag = self.r.choice(TAGS[kind])
        tells = tag in ("nav", "header", "footer", "aside", "form", "dialog")
        return f"<{tag}{self.named(kind, NAMES[kind], not tells)}>{inner}</{tag}>"

    def rest(self, kind: str, low: int = 1, high: int = 12) -> str:
        """A text that is no content: a phrase of its kind, or prose like any other."""
        phrase = self.r.choice(PHRASES[kind]) if self.r.random() < 0.5 else self.words(low, high)
        return self.mark(phrase, False)

    def links(self, kind: str) -> str:
        r = self.r
        made = [f'<a href="/{k}">{self.rest(kind, 1, 3)}</a>' for k in range(r.randint(2, 8))]
        style = r.random()
        if style < 0.6:
            return "<ul>" + "".join(f"<li>{m}</li>" if self.tidy else f"<li>{m}" for m in made) + "</ul>"
        return " | ".join(made) if style < 0.8 else "".join(f"<div>{m}</div>" for m in made)

    def box(self, kind: str) -> str:
        r, texts = self.r, []
        for _ in range(r.randint(1, 4)):
            inner = self.rest(kind, 1, 25)
            style = r.random()
            texts.append(f"<p>{inner}</p>" if style < 0.4 else f"<div>{inner}</div>" if style < 0.55 else f"<h3>{inner}</h3>" if style < 0.7
                         else self.links(kind) if style < 0.85 else inner + "<br>")
        return self.part(kind, "".join(texts))

    def form(self) -> str:
        fields = "".join(f'<label>{self.rest("form", 1, 3)}</label><input name="x">' for _ in range(self.r.randint(0, 3)))
        options = f"<select><option>{self.rest('form', 1, 2)}<option>{self.rest('form', 1, 2)}</select>" if self.r.random() < 0.2 else ""
        return self.part("form", f"{fields}{options}<button>{self.rest('form', 1, 2)}</button>")

    def comments(self) -> str:
        r, item = self.r, self.r.choice(["div", "li", "article", "p"])
        made = []
        for _ in range(r.randint(1, 5)):
            who = f"<b>{self.rest('comments', 1, 2)}</b> " if r.random() < 0.5 else ""
            text = self.mark(self.words(3, 60), False)
            body = who + text if item == "p" or r.random() < 0.5 else f"{who}<p>{text}</p>"
            made.append(f"<{item}{self.named(None, ['comment', 'reply', 'comment-body'], False)}>{body}</{item}>")
        title = f"<h3>{self.rest('comments', 1, 3)}</h3>" if r.random() < 0.6 else ""
        return self.part("comments", title + "".join(made) + (self.form() if r.random() < 0.3 else ""))

    def paragraph(self) -> str:
        r = self.r
        own = self.words(1, 90) if r.random() < 0.75 else self.words(1, 4)
        if r.random() < 0.05:  # an article may hold any phrase
            own = r.choice(PHRASES[r.choice(list(PHRASES))])
        text = self.mark(own, True)
        if r.random() < 0.1:
            text += f' <a href="#">{self.words(1, 4)}</a> {self.words(1, 12)}'
        style = r.random()
        if style < 0.72:
            return f"<p>{text}</p>" if self.tidy or r.random() < 0.5 else f"<p>{text}"
        if style < 0.78:
            return f"<p><b>{text}<br>"
        if style < 0.86:
            return f"<div>{text}</div>"
        if style < 0.93:
            kind = r.choice(["blockquote", "pre", "h2", "h3", "figure", "dl"])
            return f"<{kind}>{text}</{kind}>"
        if style < 0.97:
            return "<ul>" + "".join(f"<li>{self.mark(self.words(1, 15), True)}</li>" for _ in range(r.randint(1, 5))) + "</ul>"
        return "<table>" + "".join(f"<tr><td>{self.mark(self.words(1, 5), True)}</td><td>{self.mark(self.words(1, 5), True)}</td></tr>"
                                   for _ in range(r.randint(1, 4))) + "</table>"

    def article(self) -> str:
        r, parts = self.r, []
        if r.random() < 0.8:
            parts.append(f"<h1>{self.mark(self.words(2, 12), True)}</h1>")
        for _ in range(r.randint(1, 14)):
            parts.append(self.paragraph() * (r.randint(2, 20) if r.random() < 0.04 else 1))
            if r.random() < 0.08:
                parts.append(r.choice([lambda: self.box("advert"), lambda: self.box("sidebar"), lambda: self.box("notice"), self.form])())
        if r.random() < 0.15:
            parts.append(self.box("sidebar"))
        if r.random() < 0.2:
            parts.append(self.comments())
        tag = r.choice(MAIN_TAGS)
        inner = "".join(parts)
        if r.random() < 0.06:
            return inner
        if tag == "td":
            return f"<table><tr><td{self.named(None, MAIN_NAMES, True)}>{inner}</td></tr></table>"
        return f"<{tag}{self.named(None, MAIN_NAMES, tag in ('div', 'section') and r.random() < 0.8)}>{inner}</{tag}>"

    def html(self) -> str:
        r = self.r
        chance = lambda p, make: make() if r.random() < p else ""
        head = f"<h1>{self.rest('header', 1, 4)}</h1>" if r.random() < 0.5 else f"<a href=\"/\">{self.rest('header', 1, 4)}</a>"
        side = chance(0.5, lambda: self.box("sidebar"))
        before = r.random() < 0.4
        if r.random() < 0.06:
            return self.article()
        body = "".join([
            chance(0.3, lambda: self.box("notice")),
            chance(0.5, lambda: self.part("header", head + chance(0.4, lambda: self.part("menu", self.links("menu"))))),
            chance(0.6, lambda: self.part("menu", self.links("menu"))), chance(0.2, self.form),
            chance(0.35, lambda: self.box("advert")), side if before else "", self.article(), "" if before else side,
            chance(0.25, lambda: self.box("advert")), chance(0.3, self.comments),
            chance(0.7, lambda: self.box("footer")), chance(0.15, lambda: self.box("notice"))])
        for _ in range(r.randint(0, 2)):
            body = f'<div class="{r.choice(["page", "wrapper", "container", "site", "layout", "root", "outer"])}">{body}</div>'
        return f"<html><head><title>x</title></head><body>{body}" + ("</body></html>" if r.random() < 0.8 else "")


def pseudo_prose(r: Random, n: int) -> list[str]:
    """Sentences of made-up words, so that words alone tell nothing."""
    made = []
    for _ in range(n):
        words = ["".join(r.choice("bcdfglmnprstvw") + r.choice("aeiouéü") for _ in range(r.randint(1, 4))) for _ in range(r.randint(3, 90))]
        made.append(" ".join(words).capitalize() + r.choice([".", ".", "!", "?", ""]))
    return made


def drawn_pages(prose: list[str], n: int, seed: int = 0) -> list[tuple[list[Block], np.ndarray]]:
    """``n`` pages as blocks with labels, 1 for content."""
    r, out = Random(seed), []
    prose = [p.translate({ord(_MAIN): None, ord(_REST): None}) for p in prose] + pseudo_prose(r, max(200, len(prose) // 2))
    for _ in range(n):
        blocks = blocks_of(_Page(r, prose).html())
        labels = np.array([float(_MAIN in b.text) for b in blocks])
        for b in blocks:
            size = len(b.text)
            b.text = b.text.translate({ord(_MAIN): None, ord(_REST): None})
            b.linked = max(0, b.linked - (size - len(b.text))) if b.linked < size else len(b.text)
        out.append((blocks, labels))
    return out


def marked_up(blocks: list[Block]) -> np.ndarray | None:
    """Labels of a real page whose own markup names its article; None for any other."""
    main = {"article", "main", ".main", ".article"}
    rest = {"nav", "header", "footer", "aside", "form", "dialog"} | {"." + n for names in NAMES.values() for n in names if "-" not in n}
    if not any(main & set(b.path) for b in blocks):
        return None
    return np.array([float(bool(main & set(b.path)) and not rest & set(b.path)) for b in blocks])
