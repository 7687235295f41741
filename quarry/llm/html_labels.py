"""Labelled pages made by rule: what the extractor's weights are learned from.

Each page is a list of (markup, label): label 1 for the article's words and tags, 0 for all else. Pages differ in
layout (semantic tags, plain divisions, tables), in the names of classes and ids, and in what stands inside the article.
One part beside it in seven bears a name that tells nothing and that no other part has, so that the cost of a tag is
learned from such pages too, and no chance name is learned.
"""

from __future__ import annotations

import random

#: Names that pages give to parts beside the article, by kind.
BESIDE = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs topnav submenu pagination pager skip toc",
    "header": "header masthead topbar branding logo hero sitehead",
    "footer": "footer foot colophon copyright legal bottombar sitefoot",
    "side": "sidebar side widget related recommended popular trending rail secondary complementary",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay disclaimer warning",
    "advert": "ad ads advert advertisement adsense banner sponsor sponsored promo promotion",
    "form": "form search login signup subscribe newsletter register",
    "comment": "comment comments commentlist respond reply replies disqus discussion responses",
    "share": "share sharing social follow tags tagcloud byline meta rating author",
}
#: Names of the article and what it stands in.
WITHIN = "article content post entry main body story text page wrapper container column row inner prose section".split()


def _words(r: random.Random, low: int, high: int) -> str:
    syllables = "ka lo mi ne tu ra si po ve da en or il".split()
    return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high)))


def _beside(r: random.Random, kind: str) -> str:
    blank = r.random() < 0.15  # a name that tells nothing
    name = "".join(r.choice("bcdfghjkmpqrstvwxz") for _ in range(12)) if blank else r.choice(BESIDE[kind].split())
    tag = {"menu": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form"}.get(kind) if not blank and r.random() < 0.5 else None
    tag = tag or r.choice(["div", "div", "section", "ul" if kind == "menu" else "div"])
    mark = f' {r.choice(["class", "id"])}="{name}"' if r.random() < 0.8 or tag in ("div", "section", "ul") else ""
    if kind == "menu":
        body = "".join(f'<li><a href="/{k}">{_words(r, 1, 3)}</a></li>' for k in range(r.randint(3, 9)))
        body = body if tag == "ul" else f"<ul>{body}</ul>"
    elif kind == "form":
        body = f"<label>{_words(r, 1, 3)}</label><input type='text'><textarea>{_words(r, 0, 4)}</textarea><select><option>{_words(r, 1, 2)}</option></select><button>{_words(r, 1, 2)}</button>"
    elif kind == "comment":
        body = "".join(f"<div><p>{_words(r, 5, 60)}</p></div>" for _ in range(r.randint(1, 5)))
    elif kind in ("side", "share"):
        body = f"<h3>{_words(r, 1, 4)}</h3>" + "".join(f"<a href='/{k}'>{_words(r, 2, 8)}</a>" for k in range(r.randint(2, 6)))
    else:
        body = r.choice(["<p>{}</p>", "{}", "<span>{}</span>"]).format(_words(r, 3, 30))
    return f"<{tag}{mark}>{body}</{tag}>"


def _article(r: random.Random, own: bool) -> list[tuple[str, int]]:
    head = f"<h1>{_words(r, 3, 10)}</h1>"
    out = [(f"<header>{head}</header>" if own and r.random() < 0.5 else head, 1)]
    for k in range(r.randint(1, 9)):
        roll = r.random()
        if roll < 0.08:
            out.append(("<ul>" + "".join(f"<li>{_words(r, 3, 15)}</li>" for _ in range(r.randint(2, 5))) + "</ul>", 1))
        elif roll < 0.16:
            tag = r.choice(["h2", "h3", "h4"])
            out.append((f"<{tag}>{_words(r, 2, 6)}</{tag}>", 1))
        elif roll < 0.22:
            out.append((f"<blockquote><p>{_words(r, 8, 40)}</p></blockquote>", 1))
        elif roll < 0.26:
            out.append(("<table>" + "".join(f"<tr><td>{_words(r, 1, 6)}</td><td>{_words(r, 1, 6)}</td></tr>" for _ in range(3)) + "</table>", 1))
        else:
            text = _words(r, 15, 120)
            if roll > 0.6:
                text += f" <b>{_words(r, 1, 3)}</b> <a href='#'>{_words(r, 1, 3)}</a>, <em>{_words(r, 1, 2)}</em> <span>{_words(r, 1, 2)}</span> <i>{_words(r, 1, 2)}</i>, <a href='/x'>{_words(r, 1, 3)}</a> <strong>{_words(r, 1, 2)}</strong> <code>x</code><br>{_words(r, 5, 40)}"
            tag = r.choice(["p", "p", "p", "p", "p", "p", "div", "figcaption", "pre"])
            out.append((f"<{tag}>{text}</{tag}>", 1))
        if r.random() < 0.12:
            out.append((_beside(r, r.choice(["advert", "side", "share", "notice", "form"])), 0))
    return out


def pages(n: int = 400, seed: int = 1) -> list[list[tuple[str, int]]]:
    """``n`` labelled pages."""
    out = []
    for k in range(n):
        r = random.Random(seed * 1_000_003 + k)
        page = [(f"<!DOCTYPE html><html><head><title>{_words(r, 3, 9)}</title><script>var a='</p><p>';</script><style>p{{}}</style></head><body>", 0)]
        page += [(_beside(r, kind), 0) for kind in ("notice", "header", "menu", "form", "advert") if r.random() < 0.6]
        tag = r.choice(["article", "main", "div", "section", "td"])
        name = f' {r.choice(["class", "id"])}="{r.choice(WITHIN)}"' if r.random() < 0.7 else ""
        outer = f'<div class="{r.choice(WITHIN)}">' if r.random() < 0.6 else ""
        before, after = ("<table><tr>", "</tr></table>") if tag == "td" else ("", "")
        page += [(outer + before, 0), (f"<{tag}{name}>", 0), *_article(r, tag == "article"), (f"</{tag}>", 0), (after + ("</div>" if outer else ""), 0)]
        page += [(_beside(r, kind), 0) for kind in ("share", "comment", "side", "menu", "advert", "footer") if r.random() < 0.6]
        out.append([*page, ("</body></html>", 0)])
    return out
