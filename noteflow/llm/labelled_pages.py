"""Labelled pages for the extraction of main text, laid out in many ways from a seed.

``data-label="1"`` marks the elements that are content. The layouts are those of news pages, blogs
and manuals: with elements that say what they are, or with plain ``div`` and class names, or with
neither; with menus, notices, adverts, side columns, forms, comments and footers around the
article and some of them inside of it.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

#: Pages to train on; a documented bound, since the potentials are a few dozen frequencies.
PAGES = 600


class _Maker:
    def __init__(self, rng: random.Random):
        self.rng = rng
        self.plain = rng.random() < 0.15  # no class names at all
        self.semantic = rng.random() < 0.6

    def words(self, low: int, high: int) -> str:
        letters = "etaoinshrdlucm"
        made = ["".join(self.rng.choices(letters, k=self.rng.randint(2, 9))) for _ in range(self.rng.randint(low, high))]
        return " ".join(made).capitalize()

    def element(self, kind: str, inside: str, label: int = 0, marks: str = "") -> str:
        name = f' class="{marks}"' if marks and not self.plain else ""
        return f'<{kind}{name} data-label="{label}">{inside}</{kind}>'

    def links(self, low: int, high: int, kind: str = "li") -> str:
        each = (self.element(kind, f'<a href="/x">{self.words(1, 3)}</a>') for _ in range(self.rng.randint(low, high)))
        inside = "".join(each)
        return self.element("ul", inside) if kind == "li" else inside

    def pick(self, kind: str, names: str) -> tuple[str, str]:
        """An element that says what it is, or a division with a class name that does."""
        return (kind, "") if self.semantic else ("div", self.rng.choice(names.split()))

    def paragraph(self, label: int, low: int = 8, high: int = 90) -> str:
        text = self.words(low, high) + "."
        if self.rng.random() < 0.2:
            text += f' <a href="/y">{self.words(1, 3)}</a> {self.words(3, 9)}.'
        if self.rng.random() < 0.15:
            text = f"<b>{text}</b>"
        if self.rng.random() < 0.12:
            return f'<p data-label="{label}"><b>{text}<br>'  # never closed
        return self.element("p", text, label)

    def around(self) -> list[str]:
        rng, parts = self.rng, []
        kind, name = self.pick("nav", "nav menu navbar breadcrumb")
        parts.append(self.element(kind, self.links(3, 9), 0, name))
        if rng.random() < 0.4:
            kind, name = self.pick("header", "header masthead topbar")
            parts.append(self.element(kind, self.element("div", self.words(1, 4), 0, "logo") + self.links(2, 5), 0, name))
        if rng.random() < 0.7:
            name = rng.choice("ad ads advert sponsored promo".split())
            parts.append(self.element("div", self.words(3, 25) + ".", 0, name))
        if rng.random() < 0.35:
            name = rng.choice("cookie consent notice newsletter popup".split())
            parts.append(self.element("div", self.element("p", self.words(8, 30) + ".") + "<button>OK</button>", 0, name))
        if rng.random() < 0.3:
            parts.append(self.element("form", self.words(1, 4) + '<input name="q">', 0, rng.choice(["search", "login"])))
        return parts

    def beside(self) -> str:
        kind, name = self.pick("aside", "sidebar widget related rail")
        inside = self.element("h3", self.words(1, 3)) + self.links(2, 6)
        if self.rng.random() < 0.5:
            inside += self.element("p", self.words(6, 20))
        return self.element(kind, inside, 0, name)

    def comments(self) -> str:
        item = self.rng.choice(["li", "article", "div"])
        each = "".join(self.element(item, self.element("p", self.words(5, 40) + "."), 0, "comment")
                       for _ in range(self.rng.randint(1, 5)))
        kind = "section" if self.semantic else "div"
        each = self.element("ol", each) if item == "li" else each
        return self.element(kind, self.element("h3", self.words(1, 3)) + each, 0, "comments")

    def article(self) -> str:
        rng, inside = self.rng, []
        if rng.random() < 0.85:
            inside.append(self.element("h1", self.words(2, 12), 1))
        if rng.random() < 0.25:
            inside.append(self.element("div", self.words(2, 6), 0, rng.choice("byline meta author share".split())))
        for _ in range(rng.randint(1, 14)):
            draw = rng.random()
            if draw < 0.72:
                inside.append(self.paragraph(1, *((1, 6) if rng.random() < 0.15 else (8, 90))))
            elif draw < 0.80:
                inside.append(self.element("h2", self.words(1, 6), 1))
            elif draw < 0.86:
                each = "".join(self.element("li", self.words(3, 20), 1) for _ in range(rng.randint(2, 5)))
                inside.append(self.element("ul", each, 1))
            elif draw < 0.90:
                inside.append(self.element("blockquote", self.element("p", self.words(6, 30) + ".", 1), 1))
            elif draw < 0.93:
                cells = "".join(self.element("td", self.words(1, 4), 1) for _ in range(3))
                inside.append(self.element("table", self.element("tr", cells, 1), 1))
            elif draw < 0.96:
                inside.append(self.element("div", self.words(3, 15), 0, rng.choice("ad promo newsletter".split())))
            else:
                inside.append(self.beside())
        body = "".join(inside)
        if rng.random() < 0.1:
            return body  # right in the page
        if self.semantic or self.plain:
            return self.element("article", body, 1)
        return self.element("div", body, 1, rng.choice("content article post entry story".split()))

    def page(self) -> str:
        rng = self.rng
        parts = self.around()
        middle = self.article()
        if rng.random() < 0.25:
            middle += self.comments()
        if rng.random() < 0.4:
            middle = rng.choice([middle + self.beside(), self.beside() + middle])
        if rng.random() < 0.3:
            middle = self.element(*(("main", middle) if self.semantic else ("div", middle)), 0, rng.choice(["", "page", "wrap"]))
        kind, name = self.pick("footer", "footer legal copyright")
        below = self.words(2, 25) if rng.random() < 0.6 else self.words(2, 6) + self.links(2, 6)
        parts += [middle, self.element(kind, "&copy; " + below, 0, name)]
        return f"<html><head><title>t</title></head><body>{''.join(parts)}</body></html>"


def labelled_pages(count: int = PAGES, seed: int = 8) -> Iterator[str]:
    rng = random.Random(seed)
    for _ in range(count):
        yield _Maker(rng).page()
