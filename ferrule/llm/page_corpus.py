"""Labelled pages for training the block extractor.

Pages are composed from building blocks found on news sites, blogs, shops and
forums: menus, notices, adverts, side columns, forms, reader comments and
footers around an article of headings, paragraphs, lists, tables and quotes.
A page has one of several manners: semantic tags, telling class names, both,
opaque class names that say nothing, or prose straight in the body.  Names
that mislead, words of notices inside articles, and articles nested in lists
of teasers or comments occur too.  Main blocks lie between the comments
``<!--main-->`` and ``<!--/main-->``.  Everything is drawn from a seed.
"""

from __future__ import annotations

import random

_SYLLABLES = "an be co da el fi go ha in ja ke lo mi no or pa qui ro sa te un ve wo ya zu ar ber con den ent for ing lan men nor ost per ren sch ter tion und ver".split()
_BODY = ("content", "post", "entry", "article-body", "main-content", "story", "post-body", "entry-content", "text", "page-content")
_MENU = ("nav", "menu", "navbar", "navigation", "top-menu", "breadcrumb", "site-nav")
_AD = ("ad", "ads", "advert", "banner", "sponsored", "promo", "ad-slot", "advertisement")
_SIDE = ("sidebar", "related", "widget", "aside", "side", "recommended", "popular", "tags", "share", "social")
_FOOT = ("footer", "site-footer", "copyright", "legal", "bottom")
_NOTICE = ("cookie-notice", "notice", "consent", "alert", "popup", "newsletter", "subscribe", "gdpr")
_COMMENT = ("comments", "comment", "comment-list", "replies", "discussion", "reader-comments")


_NEUTRAL = ("wide", "clearfix", "grid", "inner", "wrap", "row", "block", "section", "box", "module", "unit", "left", "large")
_MISLEADING = ("no-comments", "ad-free", "has-sidebar", "with-footer", "comment-free", "nav-less", "without-ads", "no-header")
_CUES = ("subscribe", "comments", "share this", "privacy", "terms", "advertising", "related work", "newsletter", "reply")


class _Writer:
    def __init__(self, rng: random.Random):
        self.r = rng
        self.manner = rng.choices(("semantic", "named", "mixed", "opaque", "bare"), (3, 3, 3, 2, 2))[0]

    def words(self, a: int, b: int) -> str:
        r = self.r
        return " ".join("".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 3))) for _ in range(r.randint(a, b)))

    def sentence(self, a: int = 3, b: int = 18) -> str:
        return self.words(a, b).capitalize() + self.r.choice("....?!")

    def prose(self, a: int = 1, b: int = 7) -> str:
        r = self.r
        b = a if r.random() < 0.15 else b
        parts = [self.sentence() for _ in range(r.randint(a, b))]
        if r.random() < 0.3:
            i = r.randrange(len(parts))
            parts[i] = r.choice(("<b>{}</b>", "<em>{}</em>", '<a href="/x">{}</a>', "<strong>{}", "{}<br>")).format(parts[i])
        if r.random() < 0.08:
            parts.append(f"{self.words(1, 4).capitalize()} {r.choice(_CUES)} {self.words(1, 6)}.")
        return r.choice((" ", "\n", "  ")).join(parts)

    def links(self, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{i}">{self.words(1, 3)}</a></{tag}>' for i in range(self.r.randint(2, 9)))

    def opaque(self) -> str:
        r = self.r
        return r.choice(("css-", "sc-", "x", "c", "_")) + "".join(r.choice("bcdfghjkmpqrstvwxz0123456789") for _ in range(r.randint(2, 6)))

    def attributes(self, name: str) -> str:
        """A class or id of this name, dressed up or not."""
        r, kind = self.r, self.r.choice(("class", "class", "id"))
        if r.random() < 0.25:
            name = r.choice((f"{r.choice(_NEUTRAL)} {name}", f"{name} {r.choice(_NEUTRAL)}", f"{r.choice(('c', 'l', 'site', 'td', 'js'))}-{name}", f"{name}__{r.choice(_NEUTRAL)}", f"{name}-{r.randint(1, 9)}", f"{name} {self.opaque()}"))
        return f'{kind}="{name}"'

    def box(self, names: tuple[str, ...], semantic: str, inner: str) -> str:
        r = self.r
        name = r.choice(names)
        manner = self.manner if self.manner != "mixed" and r.random() < 0.85 else r.choice(("semantic", "named"))
        if manner in ("semantic", "opaque", "bare"):
            extra = f' class="{self.opaque()}"' if manner == "opaque" else f" {self.attributes(name)}" if r.random() < 0.3 else ""
            return f"<{semantic}{extra}>{inner}</{semantic}>"
        return f"<div {self.attributes(name)}>{inner}</div>"

    def menu(self) -> str:
        return self.box(_MENU, "nav", f"<ul>{self.links()}</ul>" if self.r.random() < 0.8 else self.links("span"))

    def advert(self) -> str:
        r, name = self.r, self.r.choice(_AD)
        inner = self.prose(1, 3) if r.random() < 0.8 else self.links("p")
        if r.random() < 0.3:
            inner = f"<p>{inner}</p>"
        tag = r.choice(("div", "div", "div", "aside", "section"))
        return (f"<!-- {name} -->" if r.random() < 0.5 else "") + f"<{tag} {self.attributes(name)}>{inner}</{tag}>"

    def side(self) -> str:
        r = self.r
        kind = r.random()
        if kind < 0.6:
            inner = f"<h3>{self.words(1, 3)}</h3><ul>{self.links()}</ul>"
        elif kind < 0.8:
            inner = f"<h3>{self.words(1, 3)}</h3><p>{self.prose(1, 2)}</p>"
        else:  # teasers, each an article of its own
            inner = "".join(f'<article><h3><a href="/t">{self.words(2, 6)}</a></h3><p>{self.sentence()}</p></article>' for _ in range(r.randint(2, 4)))
        return self.box(_SIDE, "aside", inner)

    def notice(self) -> str:
        text = self.r.choice(("We use cookies. ", "Subscribe to our newsletter. ", "Sign up now. ", "This site uses cookies. ", "")) + self.prose(1, 2)
        button = f"<button>{self.r.choice(('OK', 'Accept', 'Close', self.words(1, 2)))}</button>" if self.r.random() < 0.8 else ""
        return f"<div {self.attributes(self.r.choice(_NOTICE))}><p>{text}</p>{button}</div>"

    def unseen(self) -> str:
        return self.r.choice(('<div hidden>{}</div>', '<div style="display:none">{}</div>', '<p style="display: none">{}</p>')).format(self.prose(1, 3))

    def form(self) -> str:
        return f'<form action="/s"><label>{self.words(1, 3)}</label><input name="q"><p>{self.words(2, 6)}</p><button>{self.words(1, 2)}</button></form>'

    def header(self) -> str:
        inner = f"<h1>{self.words(1, 4)}</h1>" if self.r.random() < 0.5 else f'<a href="/">{self.words(1, 3)}</a>'
        return self.box(("header", "masthead", "top", "site-header", "page-header", "topbar"), "header", inner + (f"<p>{self.words(2, 7)}</p>" if self.r.random() < 0.5 else ""))

    def comments(self) -> str:
        r = self.r
        wrap = r.choice(("{}", "{}", '<article class="comment">{}</article>', "<li>{}</li>", f"<div {self.attributes('comment-body')}>{{}}</div>"))
        one = "".join(wrap.format(f"<{t}>{self.words(1, 2)}</{t}><p>{self.prose(1, 4)}</p>") for t in r.choices(("h4", "b", "div", "cite"), k=r.randint(1, 5)))
        name, tag = r.choice(_COMMENT), r.choice(("div", "section", "section", "ol"))
        return f"<{tag} {self.attributes(name)}><h3>{self.words(1, 2)}</h3>{one}</{tag}>"

    def footer(self) -> str:
        text = self.r.choice(("&copy; {}", "Copyright {}", "{} &middot; {}", "All rights reserved {}")).format(self.words(1, 4), self.sentence())
        return self.box(_FOOT, "footer", (f"<p>{text}</p>" if self.r.random() < 0.5 else text) + (f"<ul>{self.links()}</ul>" if self.r.random() < 0.3 else ""))

    def main_blocks(self) -> str:
        r = self.r
        head = f"<h1>{self.words(2, 10)}</h1>" if r.random() < (0.5 if self.manner == "bare" else 0.75) else ""
        if head and r.random() < 0.1:
            head = f"<header>{head}</header>"
        body = [head] if head else []
        for _ in range(r.choice((0, 1, 1, 2, 3, 5, 8))):
            kind = r.random()
            if kind < 0.62:
                body.append(f"<p>{self.prose()}</p>" if r.random() < 0.7 else f"<p><b>{self.prose()}<br>")
            elif kind < 0.68:
                body.append(f"<div>{self.prose(2, 6)}</div>")
            elif kind < 0.76:
                body.append(f"<h2>{self.words(1, 6)}</h2>")
            elif kind < 0.84:
                body.append("<ul>" + "".join(f"<li>{self.prose(1, 2)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.89:
                body.append(f"<blockquote>{self.prose(1, 3)}</blockquote>")
            elif kind < 0.93:
                body.append("<table>" + "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 3)}</td></tr>" for _ in range(r.randint(2, 4))) + "</table>")
            elif kind < 0.96:
                body.append(f"<pre>{self.words(4, 20)}</pre>")
            else:
                tag = r.choice(("object", "noscript", "figure", "canvas", "section"))
                body.append(f"<{tag}><p>{self.prose(1, 3)}</p></{tag}>")
        return "".join(body) or f"<p>{self.prose(1, 5)}</p>"

    def article(self) -> str:
        r = self.r
        if self.manner == "bare":
            return f'<!--main-->{self.main_blocks()}<!--/main-->'
        marked = f'<!--main-->{self.main_blocks()}<!--/main-->'
        if r.random() < 0.12:  # an advert inside
            marked += self.advert() + (f'<!--main--><p>{self.prose()}</p><!--/main-->' if r.randrange(2) else "")
        if r.random() < 0.12:
            marked += r.choice((self.comments, self.side, self.footer))()
        tag = r.choice(("article", "article", "main"))
        if self.manner == "opaque" and r.random() < 0.6:
            tag = "div"
        name = self.opaque() if self.manner == "opaque" else r.choice(_MISLEADING) if r.random() < 0.12 else r.choice(_BODY)
        if self.manner in ("named", "mixed") and r.random() < 0.6:
            tag = "div"
        bare = self.manner == "semantic" and r.random() < 0.7
        return f"<{tag}>{marked}</{tag}>" if bare else f"<{tag} {self.attributes(name)}>{marked}</{tag}>"


def labelled_pages(count: int, seed: int) -> list[str]:
    """``count`` pages; the same for the same seed."""
    rng = random.Random(seed)
    out = []
    for _ in range(count):
        w = _Writer(rng)
        p = rng.random if rng.random() < 0.85 else lambda: 0.99 if rng.random() < 0.9 else 0.0  # some pages hold little else
        before = [f() for f, c in ((w.notice, 0.2), (w.header, 0.35), (w.menu, 0.75), (w.form, 0.15), (w.advert, 0.4), (w.side, 0.15), (w.unseen, 0.08)) if p() < c]
        after = [f() for f, c in ((w.comments, 0.3), (w.side, 0.35), (w.advert, 0.3), (w.form, 0.15), (w.notice, 0.15), (w.menu, 0.1), (w.footer, 0.75), (w.unseen, 0.05)) if p() < c]
        middle = w.article() if rng.random() < 0.97 else ""
        if rng.random() < 0.3:
            middle = f'<div class="{rng.choice(("wrapper", "container", "row", "page"))}">{middle}{w.side() if p() < 0.5 else ""}</div>'
        body = rng.choice(("<body>", "<body>", '<body class="has-sidebar single">', '<body class="no-ads page">'))
        out.append(f"<!DOCTYPE html><html><head><title>{w.words(2, 8)}</title><style>p{{}}</style></head>{body}{''.join(before)}{middle}{''.join(after)}</body></html>")
    return out
