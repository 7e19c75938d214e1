"""Labelled web pages to train the extraction model on: made by rule, each element that needs it marked.

The attribute data-label says whether what an element holds is main text ("content") or not
("other"); it holds for everything below until another one is given. Layouts, tags and class names
vary by the random seed; words are invented, so that nothing but structure tells the labels apart.
"""

from __future__ import annotations

import random

CONTENT_WRAPPERS = [
    "article", "article", "main", 'div class="content"', 'div id="content"', 'div class="post"', 'div class="entry-content"', 'div class="article-body"', 'div class="story"', 'section class="text"',
    'div class="main"', 'div class="post-content"', "div", "section", 'article class="post"', 'main id="main"', 'div role="main"',
]
MENUS = ["nav", "nav", 'div class="menu"', 'div class="navbar"', 'ul class="nav"', 'div id="navigation"', 'div class="breadcrumbs"', 'nav class="pagination"']
HEADS = ["header", "header", 'div class="header"', 'div id="masthead"', 'div class="top-bar"', 'div class="site-header"']
FEET = ["footer", "footer", 'div class="footer"', 'div id="footer"', 'div class="copyright"', 'div class="site-footer"']
SIDES = ["aside", "aside", 'div class="sidebar"', 'div id="sidebar"', 'aside class="related"', 'div class="related"', 'div class="widget"']
ADS = ['div class="ad"', 'div class="ad"', 'div class="ads"', 'div class="advert"', 'div class="advertisement"', 'div class="sponsored"', 'div class="promo"', 'div class="banner"', 'section class="ad-slot"']
NOTES = ['div class="cookie"', 'div class="cookie-notice"', 'div id="gdpr"', 'div class="notice"', 'div class="alert"', 'div class="consent"', 'div class="popup"', 'div role="alert"']
FORMS = ["form", "form", 'form class="search"', 'form class="newsletter"', 'div class="subscribe"', 'form id="login"']
TALK = ['section class="comments"', 'div class="comments"', 'div id="comments"', 'ol class="comment-list"', 'div class="comment"', 'div class="disqus"', 'div class="replies"', 'section id="comments"']
SHARES = ['div class="share"', 'div class="social"', 'ul class="share-links"', 'div class="tags"']


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.syllables = ["".join(self.r.choice("bcdfghlmnprstv") + self.r.choice("aeiou") for _ in range(1)) for _ in range(40)]

    def words(self, a: int, b: int) -> str:
        n = self.r.randint(a, b)
        w = ["".join(self.r.choice(self.syllables) for _ in range(self.r.randint(1, 4))) for _ in range(n)]
        return (" ".join(w)).capitalize() + self.r.choice([".", ".", "", "!", "?"])

    def element(self, spec: str, inside: str, label: str = "") -> str:
        tag = spec.split(" ")[0]
        return f"<{spec}{f' data-label="{label}"' if label else ''}>{inside}</{tag}>"

    def links(self, a: int, b: int) -> str:
        return "".join(f'<li><a href="/{i}">{self.words(1, 3)}</a></li>' for i in range(self.r.randint(a, b)))

    def block(self) -> str:
        r = self.r.random()
        if r < 0.62:
            text = self.words(1, 8) if self.r.random() < 0.25 else self.words(8, 90)
            if self.r.random() < 0.15:
                text += f' <a href="#">{self.words(1, 4)}</a> {self.words(3, 20)}'
            if self.r.random() < 0.15:
                text = f"<b>{text}</b>"
            if self.r.random() < 0.15:
                text += "<br>" + self.words(2, 20)
            return f"<p>{text}</p>"
        if r < 0.72:
            return f"<h{self.r.randint(1, 4)}>{self.words(1, 9)}</h2>".replace("</h2>", "</h2>")
        if r < 0.80:
            tag = self.r.choice(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{self.words(2, 25)}</li>" for _ in range(self.r.randint(1, 6))) + f"</{tag}>"
        if r < 0.86:
            return f"<blockquote>{self.words(5, 40)}</blockquote>"
        if r < 0.90:
            return f"<pre>{self.words(4, 30)}</pre>"
        if r < 0.94:
            return "<table>" + "".join(f"<tr><td>{self.words(1, 6)}</td><td>{self.words(1, 6)}</td></tr>" for _ in range(self.r.randint(1, 4))) + "</table>"
        if r < 0.97:
            return f"<div>{self.words(3, 60)}</div>"
        return f"<figure><img src='x'><figcaption>{self.words(3, 12)}</figcaption></figure>"

    def other(self, kinds: list[str]) -> str:
        kind = self.r.choice(kinds)
        made = {
            "menu": lambda: self.element(self.r.choice(MENUS), f"<ul>{self.links(2, 9)}</ul>" if self.r.random() < 0.7 else "".join(f"<a href='/'>{self.words(1, 2)}</a> " for _ in range(5)), "other"),
            "head": lambda: self.element(self.r.choice(HEADS), self.r.choice([f"<h1>{self.words(1, 4)}</h1><p>{self.words(2, 12)}</p>", f"<div>{self.words(1, 6)}</div><ul>{self.links(2, 5)}</ul>", f"<a href='/'>{self.words(1, 3)}</a>"]), "other"),
            "foot": lambda: self.element(self.r.choice(FEET), self.r.choice([f"&copy; {self.words(3, 14)}", f"<p>{self.words(4, 40)}</p><ul>{self.links(2, 6)}</ul>", f"<div>{self.words(2, 9)}</div><p>{self.words(3, 30)}</p>"]), "other"),
            "side": lambda: self.element(self.r.choice(SIDES), f"<h3>{self.words(1, 4)}</h3>" + self.r.choice([f"<ul>{self.links(2, 7)}</ul>", f"<p>{self.words(5, 50)}</p>", f"<div><p>{self.words(4, 30)}</p></div>"]), "other"),
            "ad": lambda: self.element(self.r.choice(ADS), self.r.choice([self.words(2, 30), f"<p>{self.words(2, 30)}</p>", f"<a href='/'>{self.words(2, 12)}</a>", f"<div>{self.words(2, 20)}</div>"]), "other"),
            "note": lambda: self.element(self.r.choice(NOTES), self.r.choice([self.words(4, 40), f"<p>{self.words(4, 40)}</p><button>{self.words(1, 2)}</button>"]), "other"),
            "form": lambda: self.element(self.r.choice(FORMS), self.r.choice([f"<label>{self.words(1, 4)}</label><input><button>{self.words(1, 2)}</button>", f"<p>{self.words(3, 20)}</p><input name=q>", f"<h3>{self.words(1, 4)}</h3><select><option>{self.words(1, 2)}</option></select>"]), "other"),
            "talk": lambda: self.element(self.r.choice(TALK), self.r.choice([f"<h3>{self.words(1, 3)}</h3>", ""]) + "".join(self.r.choice([f"<div class='comment'><p>{self.words(3, 60)}</p></div>", f"<p>{self.words(3, 50)}</p>", f"<li>{self.words(3, 50)}</li>", f"<article class='comment'><b>{self.words(1, 2)}</b><p>{self.words(3, 40)}</p></article>"]) for _ in range(self.r.randint(1, 5))), "other"),
            "share": lambda: self.element(self.r.choice(SHARES), f"<a href='/'>{self.words(1, 2)}</a> <a href='/'>{self.words(1, 2)}</a>", "other"),
        }
        return made[kind]()

    def page(self) -> str:
        blocks = [f"<h1>{self.words(2, 12)}</h1>"] * (self.r.random() < 0.8) + [self.block() for _ in range(self.r.choice([1, 2, 3, 5, 8, 14]))]
        for _ in range(self.r.choice([0, 0, 0, 1, 2])):
            blocks.insert(self.r.randint(0, len(blocks)), self.other(["ad", "share", "form", "side", "note", "talk"]))
        main = self.element(self.r.choice(CONTENT_WRAPPERS), "".join(blocks), "content")
        if self.r.random() < 0.35:
            main = self.element(self.r.choice(["div", 'div class="container"', "main", 'div id="wrapper"', 'div class="row"']), "".join(self.other(["menu", "side", "ad"]) for _ in range(self.r.choice([0, 1]))) + main + "".join(self.other(["side", "talk", "ad"]) for _ in range(self.r.choice([0, 1]))))
        before = [self.other(["head", "menu", "menu", "ad", "note", "form"]) for _ in range(self.r.randint(0, 3))]
        after = [self.other(["side", "talk", "ad", "share", "form", "note"]) for _ in range(self.r.randint(0, 2))] + [self.other(["foot"])] * (self.r.random() < 0.85)
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title></head><body>" + "".join(before) + main + "".join(after) + "</body></html>"


def labelled_pages(n: int = 600, seed: int = 1) -> list[str]:
    return [Maker(seed * 100_003 + i).page() for i in range(n)]
