"""Labelled pages to learn from: layouts of common sites, filled by rule.

Every block carries ``data-label``: 1 for the main text, 0 for anything else.
The words are random letters, so nothing can be learned but structure.
"""

from __future__ import annotations

import random

#: Names that sites give to their parts. Plain lists.
NAMES = {
    "menu": ["nav", "menu", "navbar", "main-navigation", "breadcrumb", "top-links", ""],
    "head": ["header", "site-header", "masthead", "top-bar", "branding", ""],
    "foot": ["footer", "site-footer", "bottom", "colophon", "copyright", ""],
    "side": ["sidebar", "widget", "related", "recommended", "aside", "most-read", "trending"],
    "note": ["cookie-notice", "consent", "alert", "newsletter", "popup", "subscribe", "gdpr-banner", "modal"],
    "ad": ["ad", "ads", "advert", "sponsored", "promo", "banner-ad", "adsense"],
    "talk": ["comments", "comment-list", "discussion", "replies", "responses", "disqus"],
    "share": ["share", "social-links", "share-buttons", "tags", "follow-us"],
    "main": ["content", "article-body", "post", "entry-content", "story", "main", "text", "page", "", ""],
}


class Page:
    """Writes one page; every choice comes from ``seed``."""

    def __init__(self, seed: int):
        self.draw = random.Random(seed)
        self.words = ["".join(self.draw.choice("aeioulnrstdkmé") for _ in range(self.draw.randint(1, 9))) for _ in range(300)]

    def text(self, low: int, high: int, end: str = ".") -> str:
        words = [self.draw.choice(self.words) for _ in range(self.draw.randint(low, high))]
        words = [w + self.draw.choice([".", ",", "", "", "", "", "", ""]) for w in words]
        return " ".join(words).capitalize().rstrip(".,") + end

    def named(self, kind: str) -> str:
        name = self.draw.choice(NAMES[kind])
        return f' {self.draw.choice(["class", "class", "id"])}="{name}"' if name else ""

    def block(self, tag: str, label: int, inside: str, names: str = "") -> str:
        return f'<{tag}{names} data-label="{label}">{inside}</{tag}>'

    def links(self, n: int) -> str:
        items = "".join(self.block("li", 0, f'<a href="/x">{self.text(1, 4, "")}</a>') for _ in range(n))
        return self.block("ul", 0, items)

    def article(self) -> str:
        out = [self.block("h1", 1, self.text(1, 12, ""))]
        longest = self.draw.choice([3, 12, 90, 90, 90])
        for _ in range(self.draw.choice([1, 2, 5, 9, 30])):
            kind = self.draw.random()
            if kind < 0.74:
                link = f' <a href="/y">{self.text(1, 4, "")}</a> {self.text(2, 9)}' if self.draw.random() < 0.25 else ""
                bold = "<b>" if self.draw.random() < 0.2 else ""
                out.append(self.block("p", 1, bold + self.text(1, longest, self.draw.choice([".", ".", ""])) + link))
            elif kind < 0.82:
                out.append(self.block("h2", 1, self.text(1, 7, "")))
            elif kind < 0.88:
                out.append(self.block("ul", 1, "".join(self.block("li", 1, self.text(2, 25)) for _ in range(3))))
            elif kind < 0.93:
                out.append(self.block("blockquote", 1, self.block("p", 1, self.text(5, 40))))
            elif kind < 0.96:
                out.append(self.block("div", 0, self.text(3, 25), self.named("ad")))
            else:
                out.append(self.block("div", 0, self.links(3), self.named("share")))
        return "".join(out)

    def noise(self, kind: str) -> str:
        few = self.draw.randint(1, 4)
        if kind == "menu":
            return self.block(self.draw.choice(["nav", "nav", "div"]), 0, self.links(2 + few), self.named("menu") or ' class="menu"')
        if kind == "head":
            return self.block("header", 0, self.block("div", 0, self.text(1, 6, "")) + self.draw.choice(["", self.noise("menu")]),
                              self.named("head"))
        if kind == "foot":
            return self.block("footer", 0, self.draw.choice(["", self.links(few)]) + self.draw.choice(
                [f"&copy; site &middot; {self.text(3, 20)}", self.block("p", 0, "&copy; 2020 " + self.text(2, 12))]), self.named("foot"))
        if kind == "side":
            inside = self.block("h3", 0, self.text(1, 3, "")) + self.draw.choice(
                [self.links(2 + few), self.block("p", 0, self.text(4, 40))])
            return self.block(*self.draw.choice([("aside", 0, inside, ""), ("div", 0, inside, self.named("side"))]))
        if kind == "form":
            return self.block("form", 0, self.block("label", 0, self.text(1, 4, "")) + '<input type="text">' +
                              self.block("button", 0, self.text(1, 2, "")) + self.draw.choice(["", self.block("p", 0, self.text(3, 15))]))
        if kind == "talk":
            said = "".join(self.block("div", 0, self.block("p", 0, self.text(3, 60)), ' class="comment"') for _ in range(few))
            return self.block(self.draw.choice(["section", "div"]), 0, self.block("h3", 0, self.text(1, 3, "")) + said, self.named("talk"))
        tag = self.draw.choice(["div", "div", "section"])
        return self.block(tag, 0, self.draw.choice([self.text(3, 35), self.block("p", 0, self.text(3, 35))]), self.named(kind))

    def page(self) -> str:
        inside = self.article()
        wrap = self.draw.choice(["article", "article", "main", "div", "section"])
        body = self.block(wrap, 1, inside, self.named("main"))
        if self.draw.random() < 0.3:
            body = self.block("div", 1, body + self.draw.choice(["", self.noise("share")]), self.named("main"))
        chance = lambda p, kind: self.noise(kind) if self.draw.random() < p else ""
        before = chance(0.5, "head") + chance(0.7, "menu") + chance(0.3, "note") + chance(0.5, "ad")
        after = chance(0.4, "talk") + chance(0.5, "side") + chance(0.25, "form") + chance(0.3, "ad") + chance(0.3, "note")
        return f"<html><head><title>x</title></head><body>{before}{body}{after}{chance(0.9, 'foot')}</body></html>"


def pages(n: int, seed: int = 3) -> list[str]:
    return [Page(seed * 1_000_003 + i).page() for i in range(n)]
