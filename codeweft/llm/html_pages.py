"""Labelled pages for the main-text model: a grammar of page layouts, drawn with a fixed seed.

Blocks of the article start with :data:`MARK`, which the trainer takes off again.
"""

from __future__ import annotations

import random

MARK = ""
_SYLLABLES = "ka lo mi ne ru ta si vo de pa li on er st an du fe gri ho ul".split()


def _words(r: random.Random, low: int, high: int) -> str:
    out = ["".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
    return " ".join(out)


def _sentences(r: random.Random, low: int, high: int) -> str:
    return " ".join(_words(r, 1, 14).capitalize() + r.choice([".", ".", ".", ",", "!", "?", " |"]) for _ in range(r.randint(low, high)))


def _links(r: random.Random, n: int) -> str:
    return "".join(f'<li><a href="/x">{_words(r, 1, 3)}</a></li>' for _ in range(n))


_CHROME = {
    "nav": lambda r: f"<ul>{_links(r, r.randint(2, 9))}</ul>",
    "short": lambda r: f"<p>{_words(r, 1, 8)}</p>",
    "text": lambda r: r.choice(["<p>{}</p>", "{}", "<span>{}</span>", "<div>{}</div>"]).format(_sentences(r, 1, 4)),
    "form": lambda r: f"<label>{_words(r, 1, 2)}</label><input type=text><button>{_words(r, 1, 2)}</button><p>{_sentences(r, 1, 1)}</p>",
    "teasers": lambda r: "".join(f'<h3><a href="/t">{_words(r, 2, 7)}</a></h3><p>{_sentences(r, 1, 2)}</p>' for _ in range(r.randint(1, 4))),
    "comments": lambda r: f"<h2>{_words(r, 1, 2)}</h2>" + "".join(f"<div class={r.choice(['comment', 'reply', 'c'])}><p>{_words(r, 1, 2)}</p><p>{_sentences(r, 1, 5)}</p></div>" for _ in range(r.randint(1, 5))),
    "legal": lambda r: f"&copy; {r.randint(1999, 2030)} {_words(r, 1, 4)} &middot; {_sentences(r, 1, 2)}",
}
#: (tag, classes or ids, inner parts)
_BEFORE = [
    ("nav", ["", "nav", "main-nav", "navbar", "menu", "breadcrumb", "breadcrumbs"], ["nav"]),
    ("div", ["nav", "navigation", "menu", "top-menu", "navbar", "topbar", "breadcrumb", "breadcrumbs", "toolbar", "skip-links"], ["nav", "short"]),
    ("header", ["", "header", "site-header", "page-header", "masthead"], ["nav", "short", "text"]),
    ("div", ["header", "site-header", "masthead", "branding", "banner", "logo", "top"], ["nav", "short", "text"]),
    ("div", ["ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "promo", "promotion", "banner-ad", "adbox"], ["text", "short"]),
    ("div", ["cookie", "cookie-notice", "cookies", "consent", "gdpr", "notice", "alert", "notification", "popup", "modal", "overlay", "message"], ["text", "short", "form"]),
    ("form", ["", "search", "search-form", "login", "signup", "subscribe"], ["form"]),
    ("div", ["search", "login", "newsletter", "subscribe", "signup"], ["form", "short"]),
]
_AFTER = [
    ("footer", ["", "footer", "site-footer", "page-footer"], ["legal", "nav", "text", "short"]),
    ("div", ["footer", "site-footer", "copyright", "legal", "bottom", "colophon"], ["legal", "nav", "text", "short"]),
    ("aside", ["", "sidebar", "related"], ["nav", "teasers", "text", "short"]),
    ("div", ["sidebar", "side", "rail", "widget", "widgets", "secondary", "related", "recommended", "more", "trending", "popular"], ["nav", "teasers", "text", "short"]),
    ("section", ["comments", "comment-list", "reader-comments", "responses", "discussion", "disqus"], ["comments"]),
    ("div", ["comments", "comment-list", "comment-section", "responses", "discussion", "disqus", "replies"], ["comments"]),
    ("div", ["share", "social", "tags", "pagination", "pager", "author-bio", "meta"], ["nav", "short"]),
    ("form", ["", "comment-form", "newsletter", "subscribe", "contact"], ["form"]),
]
_INSIDE = [x for x in _BEFORE if x[0] != "header"] + [x for x in _AFTER if x[0] != "footer"]
_HOLDERS = [("article", ""), ("article", ""), ("article", "post"), ("main", ""), ("div", "content"), ("div", "article"), ("div", "post"), ("div", "entry-content"), ("div", "article-body"), ("div", "story"), ("section", "article"), ("div", "main"), ("div", "post-content"), ("div", "text"), ("div", "")]


def _part(r: random.Random, kinds: list) -> str:
    tag, names, inner = r.choice(kinds)
    name = r.choice(names)
    attribute = f' {r.choice(["class", "class", "id"])}="{name}"' if name else ""
    return f"<{tag}{attribute}>" + "".join(_CHROME[r.choice(inner)](r) for _ in range(r.randint(1, 2))) + f"</{tag}>"


def _article(r: random.Random) -> str:
    out = [f"<h1>{MARK}{_words(r, 1, 12)}</h1>"] if r.random() < 0.8 else []
    for _ in range(r.randint(1, 9)):
        said = MARK + _sentences(r, 1, r.choice([1, 2, 6, 10]))
        kind = r.random()
        if kind < 0.5:
            out.append(f"<p>{said}</p>")
        elif kind < 0.62:
            out.append(f"<p><b>{said}<br>")
        elif kind < 0.68:
            out.append(f"<h2>{MARK}{_words(r, 1, 5)}</h2>")
        elif kind < 0.74:
            out.append("<ul>" + "".join(f"<li>{MARK}{_sentences(r, 1, 1)}</li>" for _ in range(r.randint(1, 4))) + "</ul>")
        elif kind < 0.79:
            out.append(f"<blockquote><p>{said}</p></blockquote>")
        elif kind < 0.83:
            out.append(f"<table><tr><td>{MARK}{_words(r, 1, 3)}<td>{MARK}{_words(r, 1, 3)}</tr></table>")
        elif kind < 0.87:
            out.append(f'<p>{said} <a href="/y">{_words(r, 1, 4)}</a> {_words(r, 1, 4)}.</p>')
        elif kind < 0.91:
            out.append(f"<pre>{MARK}{_words(r, 2, 8)}</pre>")
        elif kind < 0.94:
            out.append(f"<figure><img src=i><figcaption>{MARK}{_words(r, 2, 8)}</figcaption></figure>")
        else:
            out.append(f"<p>{MARK}{_words(r, 1, 2)}.</p>")
        if r.random() < 0.07:
            out.append(_part(r, _INSIDE))
    return "".join(out)


def page(r: random.Random) -> str:
    tag, name = r.choice(_HOLDERS)
    body = "".join(_part(r, _BEFORE) for _ in range(r.randint(0, 4)))
    held = _article(r) + "".join(_part(r, _AFTER) for _ in range(r.choice([0, 0, 0, 1])))
    held = f"<{tag}" + (f' {r.choice(["class", "id"])}="{name}"' if name else "") + f">{held}</{tag}>"
    if r.random() < 0.3:
        held = r.choice(["<main>{}</main>", '<div id="main">{}</div>', '<div class="wrapper">{}</div>', '<div class="container"><div class="row">{}</div></div>']).format(held)
    after = "".join(_part(r, _AFTER) for _ in range(r.randint(0, 4)))
    return f"<!DOCTYPE html><html><head><title>{_words(r, 2, 6)}</title></head><body>{body}{held}{after}" + r.choice(["</body></html>", ""])


def pages(n: int, seed: int = 7) -> list[str]:
    r = random.Random(seed)
    return [page(r) for _ in range(n)]
