"""Labelled pages for training: made by rule, with the main text known by construction.

data-main="1" marks where the main text starts and data-main="0" what lies in it but isn't of it.
"""

from __future__ import annotations

import random

_SYLLABLES = "ka lo mi ren tas vor el dun pes ia qui nor be sat um ge tri fol ache zin".split()


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentence(self) -> str:
        s = self.words(1, 18).capitalize()
        if self.r.random() < 0.08:
            s = s.upper()
        if self.r.random() < 0.1:
            s = " ".join(w + self.r.choice(["***", "!!", "|", "%%", " |"]) for w in s.split())
        return s + self.r.choice(["."] * 8 + ["?", "!", ""])

    def prose(self, low: int = 1, high: int = 7) -> str:
        out = " ".join(self.sentence() for _ in range(self.r.randint(low, high)))
        if self.r.random() < 0.25:
            w = self.word()
            out += f' <a href="/{w}">{w}</a> {self.sentence()}'
        if self.r.random() < 0.15:
            out = f"<b>{out}" + ("</b>" if self.r.random() < 0.6 else "")
        if self.r.random() < 0.1:
            out += f" {self.word()}@mail.example.com +1 (555) 010-{self.r.randint(1000, 9999)}"
        return out

    def attribute(self, names: list[str]) -> str:
        n = self.r.choice(names)
        return f' {self.r.choice(["class", "id"])}="{n}"'

    def links(self, low: int = 3, high: int = 9) -> str:
        return "".join(f'<li><a href="/{w}">{w}</a></li>' for w in (self.words(1, 3) for _ in range(self.r.randint(low, high))))

    def menu(self) -> str:
        kind = self.r.randint(0, 3)
        body = f"<ul>{self.links()}</ul>"
        if kind == 0:
            return f"<nav>{body}</nav>"
        if kind == 1:
            return f"<nav{self.attribute(['menu', 'main-nav', 'breadcrumb'])}>" + " ".join(f'<a href="#">{self.word()}</a>' for _ in range(5)) + "</nav>"
        if kind == 2:
            return f"<div{self.attribute(['menu', 'navbar', 'top-nav', 'navigation', 'breadcrumbs'])}>{body}</div>"
        return f"<ul{self.attribute(['menu', 'nav', 'links'])}>{self.links()}</ul>"

    def notice(self) -> str:
        return f"<div{self.attribute(['cookie-notice', 'notice', 'alert', 'consent', 'popup', 'newsletter', 'subscribe-box', 'banner-message'])}>" + self.r.choice([f"<p>{self.prose(1, 3)}</p>", self.prose(1, 2)]) + "</div>"

    def advert(self) -> str:
        return f"<{(t := self.r.choice(['div', 'div', 'aside', 'section', 'p']))}{self.attribute(['ad', 'ads', 'advert', 'ad-slot', 'sponsored', 'promo', 'advertisement'])}>{self.r.choice([self.prose(1, 3), f'<p>{self.prose(1, 2)}</p>' if t != 'p' else self.sentence()])}</{t}>"

    def sidebar(self) -> str:
        body = f"<h3>{self.words(1, 3)}</h3>" + self.r.choice([f"<ul>{self.links()}</ul>", f"<p>{self.prose(1, 4)}</p>", f"<p>{self.prose(1, 2)}</p><ul>{self.links(2, 4)}</ul>"])
        return self.r.choice([f"<aside>{body}</aside>", f"<aside{self.attribute(['sidebar', 'related', 'widget'])}>{body}</aside>", f"<div{self.attribute(['sidebar', 'widget', 'related-posts', 'side-column', 'recommended'])}>{body}</div>"])

    def form(self) -> str:
        return f"<form><label>{self.words(1, 3)}</label><input name=q><button>{self.word()}</button>" + self.r.choice(["", f"<p>{self.sentence()}</p>", f"<select><option>{self.word()}<option>{self.word()}</select>"]) + "</form>"

    def comments(self) -> str:
        one = lambda: self.r.choice([f"<li><p>{self.prose(1, 5)}</p></li>", f'<div class="comment"><b>{self.word()}</b><p>{self.prose(1, 5)}</p></div>'])
        body = "".join(one() for _ in range(self.r.randint(1, 5)))
        return f"<{(t := self.r.choice(['section', 'div', 'div', 'ol', 'aside']))}{self.attribute(['comments', 'comment-list', 'discussion', 'replies', 'reader-comments', 'responses'])}>" + self.r.choice(["", f"<h2>{self.words(1, 3)}</h2>"]) + f"{body}</{t}>"

    def header(self) -> str:
        inside = self.r.choice([f"<h1>{self.words(1, 3)}</h1>", f'<a href="/">{self.words(1, 3)}</a>', f"<p>{self.words(2, 6)}</p>", f"<div>{self.words(1, 4)}</div>"]) + self.r.choice(["", self.menu(), self.form()])
        return self.r.choice([f"<header>{inside}</header>", f"<header{self.attribute(['site-header', 'masthead', 'top'])}>{inside}</header>", f"<div{self.attribute(['header', 'masthead', 'page-header', 'topbar'])}>{inside}</div>"])

    def footer(self) -> str:
        inside = self.r.choice(["&copy; ", "Copyright ", "", "&copy; 2020 "]) + self.r.choice([f"{self.word()}.example.com &middot; {self.prose(1, 3)}", self.prose(1, 4), f"<ul>{self.links()}</ul>", f"<p>{self.prose(1, 3)}</p>"])
        return self.r.choice([f"<footer>{inside}</footer>", f"<footer{self.attribute(['site-footer', 'bottom'])}>{inside}</footer>", f"<div{self.attribute(['footer', 'page-footer', 'copyright', 'colophon'])}>{inside}</div>"])

    def block(self) -> str:
        kind = self.r.random()
        if kind < 0.62:
            return f"<p>{self.prose()}</p>" if self.r.random() < 0.8 else f"<p>{self.prose()}<br>"
        if kind < 0.7:
            return f"<p>{self.words(1, 3)}.</p>"
        if kind < 0.77:
            return f"<h{(n := self.r.randint(2, 4))}>{self.words(1, 7)}</h{n}>"
        if kind < 0.83:
            return "<ul>" + "".join(f"<li>{self.sentence()}</li>" for _ in range(self.r.randint(2, 5))) + "</ul>"
        if kind < 0.86:
            return f"<blockquote><p>{self.prose(1, 3)}</p></blockquote>"
        if kind < 0.89:
            return f"<pre>{self.words(3, 12)}</pre>"
        if kind < 0.92:
            return "<table><tr>" + "".join(f"<td>{self.words(1, 3)}</td>" for _ in range(4)) + "</tr></table>"
        if kind < 0.95:
            return f"<figure><img src=x><figcaption>{self.sentence()}</figcaption></figure>"
        return f"<div>{self.prose()}</div>"

    def inner(self) -> str:
        """Something in the main text's element that isn't of it."""
        made = self.r.choice([self.advert, self.sidebar, self.comments, self.form, self.notice, self.menu, self.footer])()
        cut = made.index(">") if " " not in made[: made.index(">")] else made.index(" ")
        return made[:cut] + ' data-main="0"' + made[cut:]

    def main(self) -> str:
        title = self.sentence()[:60]
        head = self.r.choice([f"<h1>{title}</h1>"] * 3 + [f"<h2>{title}</h2>", ""])
        blocks = [self.block() for _ in range(self.r.choice([0, 1, 1, 2, 3, 4, 6, 9, 14]))] or ([] if head else [f"<p>{self.prose()}</p>"])
        for _ in range(self.r.choice([0, 0, 0, 1, 2])):
            blocks.insert(self.r.randint(0, len(blocks)), self.inner())
        tag = self.r.choice(["article"] * 5 + ["main", "div", "div", "section"])
        names = "" if tag in ("article", "main") and self.r.random() < 0.6 else self.attribute(["article", "post", "entry", "story", "content", "main", "post-body", "article-body", "entry-content", "text", "main-content"])
        body = f'<{tag}{names} data-main="1">{head}{"".join(blocks)}</{tag}>'
        for _ in range(self.r.choice([0, 0, 0, 1, 2])):
            outer = self.r.choice(["div", "main", "section"])
            body = f"<{outer}{self.r.choice(['', self.attribute(['wrapper', 'container', 'page', 'layout', 'content', 'main', 'column'])])}>" + self.r.choice(["", self.advert(), self.notice()]) + body + self.r.choice(["", "", self.sidebar(), self.comments()]) + f"</{outer}>"
        return body

    def page(self) -> str:
        maybe = lambda f, p: f() if self.r.random() < p else ""
        before = [maybe(self.header, 0.5), maybe(self.menu, 0.7), maybe(self.notice, 0.3), maybe(self.advert, 0.5), maybe(self.form, 0.15), maybe(self.sidebar, 0.2)]
        self.r.shuffle(before)
        after = [maybe(self.comments, 0.3), maybe(self.sidebar, 0.3), maybe(self.advert, 0.2), maybe(self.notice, 0.2)]
        self.r.shuffle(after)
        return f"<html><head><title>x</title></head><body>{''.join(before)}{self.main()}{''.join(after)}{maybe(self.footer, 0.85)}</body></html>"


def labelled_pages(count: int, seed: int = 7) -> list[str]:
    return [Maker(seed * 1_000_003 + i).page() for i in range(count)]
