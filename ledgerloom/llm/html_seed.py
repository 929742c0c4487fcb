"""Seed pages with known main text, for fitting the trees of ``html_text``.

Layouts are drawn at random: semantic elements or plain ones with telling,
neutral or no class names; menus, headers, sidebars, notices, adverts, forms and
reader comments about or inside the article; paragraphs from one word to
hundreds. Elements of main text carry ``data-main``, which is no feature.
"""

import random

_SYLLABLES = "an be ca de er fo gi ha in ka le mo na or pe qu re sa ti un ve wo ya zu".split()


class _Page:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.named = self.r.random() < 0.75  # plain elements have telling class names
        self.semantic = self.r.random() < 0.6
        self.closed = self.r.random() < 0.6

    def words(self, low: int, high: int) -> str:
        r = self.r
        n = int(low * (high / low) ** r.random())
        out = ["".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n)]
        for k in range(len(out)):
            if r.random() < 0.12:
                out[k] += r.choice(".,.,!?;")
        return " ".join(out).capitalize()

    def sentence(self, low: int, high: int) -> str:
        return self.words(low, high) + self.r.choice(["", ".", ".", "."])

    def element(self, tag: str, names: str, body: str, always: bool = False) -> str:
        r = self.r
        marks = ""
        if names and (self.named or always):
            pick = r.choice(names.split())
            marks = f' {r.choice(["class", "class", "id"])}="{r.choice(["", "", "site-", "c-", "js-x "])}{pick}{r.choice(["", "", "-box", " wide", "_1"])}"'
        elif r.random() < 0.5:
            marks = f' class="{r.choice(["row", "wrap", "container", "col", "x1", "inner", "css-1ab", "grid"])}"'
        return f"<{tag}{marks}>{body}</{tag}>"

    def either(self, tag: str, names: str, body: str) -> str:
        """The semantic element, or a plain one that only its names tell."""
        if self.semantic and self.r.random() < 0.85:
            return f"<{tag}>{body}</{tag}>" if self.r.random() < 0.6 else self.element(tag, names, body)
        return self.element("div", names, body)

    def links(self, low: int, high: int) -> str:
        return "".join(f'<li><a href="/{k}">{self.words(1, 4)}</a></li>' for k in range(self.r.randint(low, high)))

    def menu(self) -> str:
        return self.either("nav", "nav menu navbar navigation", f"<ul>{self.links(3, 12)}</ul>")

    def head(self) -> str:
        r = self.r
        inner = r.choice(["", f"<h1>{self.words(1, 4)}</h1>"]) + f"<p>{self.words(1, 12)}</p>" + (self.menu() if r.random() < 0.4 else "")
        return self.either("header", "header masthead banner", inner)

    def foot(self) -> str:
        r = self.r
        inner = r.choice([f"&copy; {self.words(1, 3)} &middot; {self.words(2, 30)}", f"<p>{self.words(2, 40)}</p><ul>{self.links(2, 6)}</ul>"])
        return self.either("footer", "footer copyright legal foot", inner)

    def side(self) -> str:
        r = self.r
        inner = f"<h3>{self.words(1, 4)}</h3>" + r.choice([f"<ul>{self.links(3, 10)}</ul>", f"<p>{self.words(5, 60)}</p>", f"<p>{self.words(5, 60)}</p><p>{self.words(5, 40)}</p>"])
        return self.either("aside", "sidebar side related widget promo", inner)

    def advert(self) -> str:
        return self.element("div", "ad ads advert advertisement sponsored promo banner", self.r.choice([self.words(2, 40), f"<p>{self.words(2, 40)}</p>"]), always=True)

    def notice(self) -> str:
        return self.element(self.r.choice(["div", "div", "section"]), "cookie cookies consent notice gdpr alert popup", f"<p>{self.words(4, 50)}</p><button>{self.words(1, 2)}</button>", always=True)

    def form(self) -> str:
        inner = f"<label>{self.words(1, 4)}</label><input name=q><button>{self.words(1, 2)}</button>"
        if self.r.random() < 0.5:
            inner = f"<p>{self.words(3, 20)}</p>{inner}"
        return self.r.choice([f"<form>{inner}</form>", self.element("div", "newsletter subscribe signup login search", f"<form>{inner}</form>")])

    def remarks(self) -> str:
        body = "".join(self.element(self.r.choice(["div", "li", "div", "article"]), "comment reply comment", self.r.choice(["<p>{}</p>", "<p>{0}</p><p>{0}</p>", "<b>x</b> {}"]).format(self.words(3, 90)), always=self.r.random() < 0.7) for _ in range(self.r.randint(1, 8)))
        inner = f"<h{self.r.choice('23')}>{self.words(1, 3)}</h3>{body}" + (self.form() if self.r.random() < 0.5 else "")
        return self.element(self.r.choice(["div", "section", "section", "aside"]), "comments comments discussion replies responses respond", inner, always=True)

    def share(self) -> str:
        return self.element("div", "share social sharing tags related breadcrumb", f"<ul>{self.links(2, 6)}</ul>", always=True)

    def block(self) -> str:
        r = self.r
        kind, end = r.random(), "" if self.closed or r.random() < 0.5 else None
        if kind < 0.72:
            text = self.sentence(1, 200)
            if r.random() < 0.15:
                text = f'<b>{self.words(1, 6)}</b> {text} <a href="#">{self.words(1, 4)}</a>'
            if r.random() < 0.1:
                text = f"<b>{text}<br>"
            return f"<p data-main>{text}" + ("</p>" if end is not None else "")
        if kind < 0.82:
            return f"<h{(level := r.choice('2234'))} data-main>{self.words(1, 10)}</h{level}>"
        if kind < 0.88:
            kind_of = r.choice(["ul", "ol"])
            return f"<{kind_of}>" + "".join(f"<li data-main>{self.sentence(1, 30)}</li>" for _ in range(r.randint(2, 6))) + f"</{kind_of}>"
        if kind < 0.92:
            return f"<blockquote data-main><p data-main>{self.sentence(3, 60)}</p></blockquote>"
        if kind < 0.95:
            return "<table>" + "".join("<tr>" + "".join(f"<td data-main>{self.words(1, 5)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 5))) + "</table>"
        if kind < 0.97:
            return f"<pre data-main>{self.words(3, 60)}</pre>"
        return f"<div data-main>{self.sentence(3, 100)}</div>"

    def article(self) -> str:
        r = self.r
        n = int(1 * 30 ** r.random())
        blocks = [self.block() for _ in range(n)]
        for extra in (self.advert, self.share, self.side, self.form):
            if r.random() < 0.12:
                blocks.insert(r.randint(0, len(blocks)), extra())
        title = f"<h1 data-main>{self.words(1, 14)}</h1>" if r.random() < 0.8 else ""
        if title and r.random() < 0.15:
            title = f"<header>{title}</header>"
        if r.random() < 0.12:
            blocks.append(self.remarks())
        body = title + "".join(blocks)
        if self.semantic and r.random() < 0.85:
            body = r.choice(["<article>{}</article>", "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>"]).format(body)
        else:
            body = self.element(r.choice(["div", "div", "section"]), "article content post entry story main text body", body, always=r.random() < 0.5)
        for _ in range(r.randint(0, 2)):
            if r.random() < 0.4:
                body = self.element("div", "content main page", body)
        return body

    def html(self) -> str:
        r = self.r
        top = [f() for f, p in ((self.notice, 0.25), (self.head, 0.5), (self.menu, 0.7), (self.advert, 0.4), (self.form, 0.15)) if r.random() < p]
        low = [f() for f, p in ((self.share, 0.2), (self.side, 0.3), (self.remarks, 0.35), (self.form, 0.15), (self.advert, 0.15), (self.foot, 0.8), (self.notice, 0.15)) if r.random() < p]
        if r.random() < 0.3:
            r.shuffle(top)
        middle = self.article()
        if r.random() < 0.2:
            middle = self.element("div", "", self.side() + middle) if r.random() < 0.5 else self.element("div", "", middle + self.side())
        body = "".join(top) + middle + "".join(low)
        if r.random() < 0.25:
            body = self.element("div", "", body)
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title><style>p{{}}</style></head><body>{body}" + ("</body></html>" if r.random() < 0.8 else "")


def seed_pages(n: int, seed: int = 0) -> list[str]:
    return [_Page(seed * 1_000_003 + k).html() for k in range(n)]
