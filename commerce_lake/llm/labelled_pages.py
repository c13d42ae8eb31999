"""Labelled pages for fitting the HTML model: layouts with known content, filled with seeded words.

``data-y="1"`` opens a content region and ``data-y="0"`` a region that is none; nested
marks override outer ones.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

_MENU = ["nav", "div class=nav", "div id=menu", "ul class=menu", "div class=navbar", "div class=breadcrumbs", "div class=topnav", "ul class=nav-links"]
_HEAD = ["header", "div id=header", "div class=site-header", "div class=masthead", "div class=topbar", "div class=banner"]
_FOOT = ["footer", "div id=footer", "div class=site-footer", "div class=copyright", "div class=bottom", "div class=legal"]
_SIDE = ["aside", "div class=sidebar", "div id=sidebar", "section class=related", "div class=widget", "div class=recommended", "div class=popular-posts", "div class=share-buttons", "div class=social", "div class=tags", "div class=author-box"]
_NOTICE = ["div class=cookie-banner", "div class=notice", "div id=cookie-consent", "p class=notice", "div class=alert", "div class=popup", "div class=disclaimer", "div class=gdpr", "div role=alert", "div class=paywall", "div class=newsletter", "div class=subscribe"]
_AD = ["div class=ad", "div class=ads", "div class=advert", "div id=ad-top", "div class=sponsored", "aside class=promo", "div class=advertisement", "ins class=adsbygoogle", "div class=promotion"]
_COMMENTS = ["div id=comments", "section class=comments", "div class=comment-list", "ol class=commentlist", "div class=discussion", "div id=respond", "section id=disqus", "div class=reader-comments", "section id=comments class=comments-area"]
_MAIN = ["article", "main", "div class=content", "div id=content", "div class=post", "div class=entry-content", "div class=article-body", "section class=story", "div role=main", "div class=main-text", "article class=post", "td class=body", "div", "section", "div class=wrapper", "div class=document", "div class=post-body", "section class=chapter", "div class=page-content"]


def _tag(spec: str, inner: str, y: int | None = None) -> str:
    name, _, rest = spec.partition(" ")
    attributes = "".join(f' {a.partition("=")[0]}="{a.partition("=")[2]}"' for a in rest.split() if a)
    mark = "" if y is None else f' data-y="{y}"'
    return f"<{name}{attributes}{mark}>{inner}</{name}>"


class _Words:
    def __init__(self, rng: random.Random):
        self.rng = rng

    def some(self, low: int, high: int) -> str:
        r = self.rng
        return " ".join("".join(r.choice(("ba", "do", "ki", "lu", "men", "ra", "so", "ti", "ver", "o")) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high)))

    def sentences(self, n: int) -> str:
        return " ".join(self.some(3, 18).capitalize() + self.rng.choice("...?!") for _ in range(n))

    def links(self, n: int, item: str = "li") -> str:
        return "".join(f'<{item}><a href="/{self.some(1, 1)}">{self.some(1, 3)}</a></{item}>' for _ in range(n))


def labelled_pages(n: int = 500, seed: int = 7) -> Iterator[str]:
    rng = random.Random(seed)
    w = _Words(rng)
    pick = rng.choice

    def form() -> str:
        """A short form: labels, fields, and now and then a sentence."""
        fields = "".join(pick([f"<label>{w.some(1, 3)}</label><input name=x>", f"<p>{w.some(1, 4)} <input name=x></p>", f"<div>{w.some(1, 3)}<input></div>"]) for _ in range(rng.randint(1, 4)))
        return _tag(pick(["form", "form class=search", "form id=contact", "div class=signup"]), pick(["", f"<p>{w.sentences(1)}</p>"]) + fields + f"<button>{w.some(1, 2)}</button>", 0)

    def paragraphs(k: int) -> str:
        out = []
        for _ in range(k):
            kind = rng.random()
            text = w.sentences(pick([1, 1, 2, 3, 5, 8]))
            if kind < 0.05:
                out.append(form())
            elif kind < 0.6:
                out.append(f"<p>{text}</p>")
            elif kind < 0.68:
                out.append(f"<h2>{w.some(2, 8)}</h2><p>{text}</p>")
            elif kind < 0.8:
                long = pick([4, 14])
                out.append("<ul>" + "".join(f"<li>{w.some(2, long)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>")
            elif kind < 0.84:
                out.append(f"<blockquote><p>{text}</p></blockquote>")
            elif kind < 0.88:
                out.append(f"<div><p>{text}</p></div>")
            else:
                out.append(f'<p>{w.some(2, 6)} <a href="/x">{w.some(1, 3)}</a> {text}</p>')
        return "".join(out)

    def boilerplate(kinds: list[str]) -> str:
        kind = pick(kinds)
        if kind == "menu":
            links = w.links(rng.randint(3, 12))
            spec = pick(_MENU)
            return _tag(spec, links if spec.startswith("ul") else f"<ul>{links}</ul>", 0)
        if kind == "side":
            h = pick(["h2", "h3", "h4"])
            inner = f"<{h}>{w.some(1, 4)}</{h}>" + pick([f"<ul>{w.links(rng.randint(2, 8))}</ul>", f"<p>{w.sentences(1)}</p>", f"<p>{w.sentences(2)}</p><ul>{w.links(3)}</ul>", f"<p>{w.sentences(3)}</p>"])
            return _tag(pick(_SIDE), inner, 0)
        if kind == "comments":
            h = pick(["h2", "h3", "h4"])
            inner = f"<{h}>{w.some(1, 3)}</{h}>" + "".join(pick([f"<div class=comment><p>{w.sentences(rng.randint(1, 4))}</p></div>", f"<li class=comment><b>{w.some(1, 2)}</b><p>{w.sentences(rng.randint(1, 4))}</p></li>", f"<p>{w.sentences(rng.randint(1, 4))}</p>"]) for _ in range(rng.randint(1, 6)))
            return _tag(pick(_COMMENTS), inner, 0)
        spec = pick(_NOTICE if kind == "notice" else _AD)
        text = w.sentences(rng.randint(1, 3))
        return _tag(spec, text if spec.startswith("p ") else pick([text, f"<p>{text}</p>", f'<p>{text}</p><a href="/ok">{w.some(1, 2)}</a>']), 0)

    for _ in range(n):
        title = w.some(3, 10)
        inside = f"<h1>{title}</h1>" if rng.random() < 0.8 else ""
        if rng.random() < 0.15:
            inside = f"<header><h1>{title}</h1></header>"
        inside += paragraphs(rng.randint(1, 14))
        while rng.random() < 0.3:  # containers within containers, and chapters with names of their own
            inside = _tag(pick(_MAIN), inside) if rng.random() < 0.5 else "".join(f'<{t} {pick(["id", "class"])}="{w.some(1, 1)}">{x}</{t}>' for t, x in ((pick(["section", "div"]), inside), (pick(["section", "div"]), paragraphs(2))))
        if rng.random() < 0.3:
            inside += boilerplate(["ad", "side", "notice", "comments"]) + paragraphs(rng.randint(0, 3))
        bare = rng.random() < 0.2  # nothing but the body holds the text
        article = inside if bare else _tag(pick(_MAIN), inside, 1)
        for _ in range(0 if bare else rng.choice([0, 0, 1, 2])):
            article = _tag(pick(["div", "div class=wrapper", "div class=container", "main", "div id=page", "section", "div class=row"]), article + (boilerplate(["side", "ad", "comments"]) if rng.random() < 0.4 else ""))
        before = _tag(pick(_HEAD), pick([f"<h1>{w.some(1, 3)}</h1>", f"<p>{w.some(2, 6)}</p>", f'<a href="/">{w.some(1, 2)}</a>']), 0) if rng.random() < 0.5 else ""
        before += "".join(boilerplate(["menu", "menu", "notice", "ad"]) for _ in range(rng.randint(0, 3)))
        after = "".join(boilerplate(["side", "comments", "ad", "notice"]) for _ in range(rng.randint(0, 3)))
        if rng.random() < 0.85:
            after += _tag(pick(_FOOT), pick([w.some(3, 12), f"<p>{w.sentences(1)}</p>", f"<ul>{w.links(4)}</ul><p>{w.some(3, 8)}</p>"]), 0)
        if bare and rng.random() < 0.3:
            before = after = ""
        if not bare and rng.random() < 0.15 and "<form" not in article:  # forms do not nest
            before, after = "<form id=page>" + before, after + "</form>"
        yield f'<!DOCTYPE html><html><head><title>{title}</title></head><body data-y="{int(bare)}">{before}{article}{after}</body></html>'
