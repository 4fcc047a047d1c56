"""Labelled pages to fit the extraction model on.

Pages are put together from a few ways to write each part of a page. Elements that begin content carry
``x-keep="1"`` and those that end it ``x-keep="0"``; the parser hands that on to the blocks inside.
"""

from __future__ import annotations

import random

N_PAGES = 400
_SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe ri so tu ve wi xo ya ze en st ra le on".split()


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentence(self, low: int = 1, high: int = 18) -> str:
        return self.words(low, high).capitalize() + self.r.choice([".", ".", ".", "?", "!", ""])

    def sentences(self, low: int, high: int) -> str:
        parts = [self.sentence() for _ in range(self.r.randint(low, high))]
        if self.r.random() < 0.2:
            parts.insert(self.r.randrange(len(parts) + 1), f'<a href="/{self.word()}">{self.words(1, 4)}</a>')
        return " ".join(parts)

    def links(self, low: int, high: int) -> list[str]:
        return [f'<a href="/{self.word()}">{self.words(1, 3)}</a>' for _ in range(self.r.randint(low, high))]

    def link_list(self, low: int = 3, high: int = 9) -> str:
        return "<ul>" + "".join(f"<li>{x}</li>" for x in self.links(low, high)) + "</ul>"

    def wrap(self, choices: str, inner: str, keep: int | None = None) -> str:
        """Put into one of the elements named like ``div.class`` or ``div#id``."""
        tag, _, name = self.r.choice(choices.split()).replace("#", ".#").partition(".")
        mark = "" if keep is None else f' x-keep="{keep}"'
        attribute = f' id="{name[1:]}"' if name.startswith("#") else f' class="{name}"' if name else ""
        return f"<{tag}{attribute}{mark}>{inner}</{tag}>"

    # parts that are not content

    def navigation(self) -> str:
        inner = self.link_list() if self.r.random() < 0.7 else self.r.choice([" | ", " ", ""]).join(self.links(3, 9))
        return self.wrap("nav nav nav div.menu div#nav div.navbar div.breadcrumbs div.pagination", inner, 0)

    def header(self) -> str:
        inner = f"<h1>{self.words(1, 4)}</h1>" if self.r.random() < 0.3 else f"<p>{self.sentence(2, 8)}</p>" if self.r.random() < 0.5 else f"<div>{self.words(1, 5)}</div>"
        return self.wrap("header header div.header div#header div.masthead div.topbar", inner + (self.navigation() if self.r.random() < 0.4 else ""), 0)

    def advert(self) -> str:
        return self.wrap("div.ad div.ad div.ads div.advert div.sponsored aside.promo div.advertisement p.ad", self.sentences(1, 3), 0)

    def notice(self) -> str:
        inner = f"<p>{self.sentences(1, 3)}</p>" if self.r.random() < 0.5 else self.sentences(1, 3)
        return self.wrap("div.cookie div.cookie-consent div.notice div.alert div#popup section.notice aside.notice", inner, 0)

    def sidebar(self) -> str:
        inner = f"<h3>{self.words(1, 3)}</h3>" + (self.link_list() if self.r.random() < 0.6 else f"<p>{self.sentences(1, 4)}</p>")
        return self.wrap("aside aside div.sidebar div#sidebar div.widget", inner, 0)

    def comments(self) -> str:
        each = "".join(
            self.wrap("div.comment li.comment article.comment div.reply p", (f"<b>{self.words(1, 2)}</b> " if self.r.random() < 0.5 else "") + f"<p>{self.sentences(1, 5)}</p>", 0)
            for _ in range(self.r.randint(1, 5))
        )
        title = f"<h3>{self.words(1, 3)}</h3>" if self.r.random() < 0.6 else ""
        return self.wrap("section.comments div#comments div.comments ol.comment-list div.discussion section#comments", title + each, 0)

    def form(self) -> str:
        inner = f"<label>{self.words(1, 3)}</label><input name='q'>" + (f"<p>{self.sentence(2, 10)}</p>" if self.r.random() < 0.4 else "") + f"<button>{self.word()}</button>"
        return self.wrap("form form form.search form.login", inner, 0)

    def related(self) -> str:
        return self.wrap("div.related div.share section.related div.social div.tags", f"<h4>{self.words(1, 3)}</h4>" + self.link_list(2, 6), 0)

    def footer(self) -> str:
        inner = f"&copy; {self.word()} &middot; {self.sentences(1, 2)}" if self.r.random() < 0.7 else f"<p>{self.sentences(1, 2)}</p>" + self.link_list(2, 5)
        return self.wrap("footer footer footer div.footer div#footer p.copyright", inner, 0)

    # content

    def paragraph(self) -> str:
        text = self.sentences(1, 2) if self.r.random() < 0.4 else self.sentences(2, 9)
        kind = self.r.random()
        if kind < 0.08:
            return f"<p><b>{text}<br>"
        if kind < 0.13:
            return f"<p>{text}"
        return f"<p>{text}</p>" if kind < 0.95 else f"<p><em>{self.words(1, 4)}</em> {text}</p>"

    def content_block(self) -> str:
        kind = self.r.random()
        if kind < 0.74:
            return self.paragraph()
        if kind < 0.82:
            return self._heading(self.r.randint(2, 4))
        if kind < 0.88:
            tag = self.r.choice(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{self.sentence(2, 14)}</li>" for _ in range(self.r.randint(2, 6))) + f"</{tag}>"
        if kind < 0.92:
            return f"<blockquote>{self.wrap('p', self.sentences(1, 3))}</blockquote>"
        if kind < 0.95:
            rows = "".join("<tr>" + "".join(f"<td>{self.words(1, 3)}</td>" for _ in range(3)) + "</tr>" for _ in range(self.r.randint(2, 4)))
            return f"<table>{rows}</table>"
        if kind < 0.97:
            return f"<pre>{self.words(3, 20)}</pre>"
        return f"<figure><img src='x.png'><figcaption>{self.sentence(2, 10)}</figcaption></figure>"

    def _heading(self, level: int) -> str:
        return f"<h{level}>{self.words(1, 7)}</h{level}>"

    def article(self) -> str:
        blocks = [self.content_block() for _ in range(self.r.choice([1, 2, 3, 4, 5, 6, 8, 10, 14]))]
        if self.r.random() < 0.15:
            blocks = [f"<p>{self.sentence(1, 3)}</p>"]
        if self.r.random() < 0.8:
            blocks.insert(0, f"<h1>{self.sentence(1, 12)}</h1>")
        for part, chance in ((self.advert, 0.15), (self.related, 0.12), (self.comments, 0.06), (self.form, 0.04), (self.notice, 0.06), (self.sidebar, 0.05)):
            if self.r.random() < chance:
                blocks.insert(self.r.randrange(1, len(blocks) + 1), part())
        inner = "".join(blocks)
        made = self.wrap("article article article article main div.content div#content div.post section.entry div.article-body div.story div section", inner, 1)
        if self.r.random() < 0.3:
            made = self.wrap("main div#main div.wrapper div div.container", made)
        return made

    def bare_page(self) -> str:
        """Text with hardly any markup around it."""
        if self.r.random() < 0.3:
            return self.wrap("span", self.sentences(1, 4)).join(["<div x-keep=1>", "</div>"])
        kept = "".join(f'<p x-keep="1">{self.sentences(1, 5)}</p>' for _ in range(self.r.randint(1, 5)))
        return self.r.choice(["{}", "<body>{}</body>", "<html><body><div>{}</div></body></html>"]).format(kept)

    def page(self) -> str:
        if self.r.random() < 0.1:
            return self.bare_page()
        before = [p() for p, c in ((self.header, 0.5), (self.navigation, 0.75), (self.notice, 0.3), (self.advert, 0.45), (self.form, 0.15), (self.sidebar, 0.15)) if self.r.random() < c]
        after = [p() for p, c in ((self.comments, 0.4), (self.related, 0.3), (self.sidebar, 0.3), (self.advert, 0.3), (self.form, 0.2), (self.navigation, 0.15), (self.footer, 0.85)) if self.r.random() < c]
        self.r.shuffle(before)
        middle = self.article()
        if self.r.random() < 0.25 and after:
            middle = self.wrap("div div.row div#page div.container", middle + after.pop(0))
        head = f"<html><head><title>{self.words(2, 6)}</title><style>p{{}}</style></head><body>"
        return head + "".join(before) + middle + "".join(after) + self.r.choice(["</body></html>", ""])


def labelled_pages(n: int = N_PAGES, seed: int = 5) -> list[str]:
    """``n`` pages with marks on what is content. The same arguments give the same pages."""
    maker = _Maker(seed)
    return [maker.page() for _ in range(n)]
