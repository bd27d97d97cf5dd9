"""Labelled pages in many layouts, to train and to test extraction.

Each page is drawn from a seeded generator: an article in one of many
wrappers, of paragraphs, headings, lists, quotes and tables; around it, and
between its blocks, menus, headers, footers, sidebars, notices, adverts, forms
and comments in the ways that pages mark them up.  Both kinds get texts from
the same words and of all lengths, so that a text's words alone say little.
"""

from __future__ import annotations

import html
import random
from collections.abc import Callable, Iterator

# fixed values: names that pages give to such parts
NAMES = {
    "menu": "nav navbar menu top-nav navigation topnav main-menu mainnav dropdown breadcrumb breadcrumbs toc pagination pager skip-link tab-list submenu",
    "header": "header head top masthead hero topbar site-header page-header banner logo branding site-title tagline toolbar",
    "footer": "footer foot bottom site-footer page-footer copyright colophon legal bottom-bar site-info imprint credits",
    "sidebar": "sidebar side left right aside widget related related-posts trending popular recommended more-stories side rail secondary tag-cloud archive author-box blogroll teaser-list",
    "notice": "cookie cookie-notice cookie-banner cookie-consent gdpr consent notice alert modal popup overlay paywall newsletter subscribe disclaimer announcement message toast privacy warning info-box",
    "advert": "ad ads advert advertisement ad-slot adsense sponsored sponsor promo promotion banner-ad dfp outbrain taboola commercial affiliate",
    "form": "form search search-form login signup contact-form newsletter-form poll survey",
    "comment": "comment comments comment-list commentlist comments-area discussion responses respond reply replies disqus user-comments reader-comments feedback thread",
    "share": "share social share-buttons social-links sharing follow like-box tags post-meta print-link",
    "main": "article article-body post post-body post-content entry entry-content content main-content story story-body text body-text page-content article-text article-content blog-post news-item maincontent",
    "plain": "container wrapper row col column page inner outer grid section box block layout site wrap center clearfix",
}
NAMES = {kind: names.split() for kind, names in NAMES.items()}
_ROLES = {"menu": "navigation", "header": "banner", "footer": "contentinfo", "sidebar": "complementary", "form": "search"}  # fixed values of HTML
_WORDS = """the of and a to in is on that by this with river stone market council report season winter people water century music history city
    study number system field group light summer school paper village mountain garden der die und nicht ein auf les des une dans pour est el los
    una con para""".split()
_CUES = {
    "menu": ["Home", "About", "Contact", "Next", "Previous", "Menu"],
    "header": ["Home", "Login", "Search"],
    "footer": ["© 2021", "Copyright", "Privacy", "Terms", "All rights reserved."],
    "notice": ["We use cookies.", "Privacy", "Subscribe to our newsletter.", "Please note."],
    "advert": ["Advertisement", "Sponsored", "Promoted"],
    "form": ["Search", "Username", "Password", "Register"],
    "comment": ["Reply", "12 comments", "Report", "says:"],
    "share": ["Share", "Facebook", "Twitter", "Follow"],
    "sidebar": ["Related", "Popular"],
}
_WRAPS: list[Callable[[random.Random, str], str]] = [
    lambda r, s: f"<article>{s}</article>",
    lambda r, s: f'<article class="{_name(r, "main")}">{s}</article>',
    lambda r, s: f"<main>{s}</main>",
    lambda r, s: f'<main id="{_name(r, "main")}"><article>{s}</article></main>',
    lambda r, s: f'<main><div class="{_name(r, "main")}">{s}</div></main>',
    lambda r, s: f'<div class="{_name(r, "main")}">{s}</div>',
    lambda r, s: f'<div id="{_name(r, "main")}">{s}</div>',
    lambda r, s: f'<div id="{_name(r, "main")}"><div class="{_name(r, "plain")}">{s}</div></div>',
    lambda r, s: f'<section class="{_name(r, "main")}">{s}</section>',
    lambda r, s: f'<div role="main">{s}</div>',
    lambda r, s: f'<div itemprop="articleBody">{s}</div>',
    lambda r, s: f'<div class="{_noise(r)}">{s}</div>',
    lambda r, s: f"<div>{s}</div>",
    lambda r, s: f'<table class="{_name(r, "plain")}"><tr><td class="{_name(r, "main")}">{s}</td></tr></table>',
    lambda r, s: s,
]


def _noise(r: random.Random) -> str:
    return "".join(r.choice("abcdefghkmxyz") for _ in range(r.randint(3, 6))) + str(r.randint(0, 99))


def _name(r: random.Random, kind: str) -> str:
    name = r.choice(NAMES[kind])
    draw = r.random()
    if draw < 0.12:
        name = f"{r.choice(['site', 'page', 'js', 'c', 'l', 'main', 'block'])}-{name}"
    elif draw < 0.24:
        name = f"{name}-{r.choice(['wrap', 'container', 'box', 'inner', 'area', 'list', 'section', 'item'])}"
    elif draw < 0.3:
        name = name.replace("-", "_")
    elif draw < 0.36:
        name = "".join(x.title() if i else x for i, x in enumerate(name.split("-")))
    return f"{name} {_noise(r)}" if r.random() < 0.15 else name


def _sentence(r: random.Random, n: int) -> str:
    words = [r.choice(_WORDS) if r.random() < 0.5 else "".join(r.choice("aeiourstnlmé") for _ in range(r.randint(2, 10))) for _ in range(n)]
    return (" ".join(words).capitalize() + r.choice([".", ".", ".", ".", "!", "?", "", " ***", ",", ":"])).strip()


def _text(r: random.Random, most: int) -> str:
    n = max(1, int(most ** r.random()))
    out = []
    while n > 0:
        k = min(n, r.randint(3, 25))
        out.append(_sentence(r, k))
        n -= k
    text = " ".join(out)
    return text + r.choice([" & more", " <b", ' "so"', "&&&"]) if r.random() < 0.05 else text


def _shown(r: random.Random, text: str) -> str:
    """Markup of a text: references, inline tags, unclosed ones among them."""
    out = html.escape(text, quote=r.random() < 0.5)
    draw = r.random()
    words = out.split(" ")
    i = r.randrange(len(words))
    if draw < 0.08:
        words[i] = f'<a href="/{_noise(r)}">{words[i]}</a>'
    elif draw < 0.16:
        words[i] = f"<{(t := r.choice(['b', 'i', 'em', 'strong', 'span', 'code']))}>{words[i]}</{t}>"
    elif draw < 0.2:
        words[i] = f"{words[i]}<br>"
    return r.choice(["", "", "", "<b>", "\n  "]) * (r.random() < 0.3) + " ".join(words)


def _article(r: random.Random) -> list[tuple[str, list[str]]]:
    """Blocks of main text: their markup, and the texts in order."""
    out: list[tuple[str, list[str]]] = []

    def add(shape: str, *texts: str) -> None:
        out.append((shape.format(*[_shown(r, t) for t in texts]), [" ".join(t.split()) for t in texts]))

    if r.random() < 0.7:
        add(r.choice(["<h1>{}</h1>", "<h1>{}</h1>", "<h2>{}</h2>", '<h1 class="title">{}</h1>']), _text(r, 14))
    for _ in range(r.randint(1, 14)):
        draw = r.random()
        if draw < 0.62:
            add(r.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<div>{}</div>", "<hr>{}<hr>"]), _text(r, 160))
        elif draw < 0.72:
            add(r.choice(["<h2>{}</h2>", "<h3>{}</h3>"]), _text(r, 8))
        elif draw < 0.82:
            n, kind = r.randint(2, 6), r.choice(["ul", "ol"])
            add(f"<{kind}>" + r.choice(["<li>{}</li>", "<li>{}"]) * n + f"</{kind}>", *[_text(r, 25) for _ in range(n)])
        elif draw < 0.88:
            add(r.choice(["<blockquote>{}</blockquote>", "<blockquote><p>{}</p></blockquote>", "<pre>{}</pre>"]), _text(r, 60))
        elif draw < 0.93:
            add("<table><tr><td>{}<td>{}</tr><tr><td>{}</td><td>{}</td></tr></table>", *[_text(r, 6) for _ in range(4)])
        elif draw < 0.97:
            add("<figure><img src='x.png'><figcaption>{}</figcaption></figure>", _text(r, 20))
        else:
            add("<dl><dt>{}<dd>{}</dl>", _text(r, 4), _text(r, 30))
    return out


def _rest(r: random.Random, kind: str) -> str:
    """One part that is not main text."""
    cue = lambda: html.escape(r.choice(_CUES[kind])) if r.random() < 0.25 else html.escape(_text(r, 5))
    para = lambda: f"<p>{_shown(r, _text(r, 60))}</p>" if r.random() < 0.7 else _shown(r, _text(r, 40))
    link = lambda: f'<a href="/{_noise(r)}">{cue()}</a>'
    links = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(1, 7))) + "</ul>" if r.random() < 0.7 else " | ".join(link() for _ in range(r.randint(2, 6)))
    tags = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form", "comment": "section", "notice": "div", "advert": "div", "share": "div"}
    inside = {
        "menu": links,
        "header": lambda: r.choice([link, cue, para, lambda: f"<h1>{cue()}</h1>", links])(),
        "footer": lambda: r.choice([lambda: "&copy; " + cue(), para, links, lambda: f"&copy; {_noise(r)}.example &middot; {para()}"])(),
        "sidebar": lambda: r.choice([links, para, lambda: f"<h3>{cue()}</h3>{links()}", lambda: f"<h4>{cue()}</h4>{para()}{para()}"])(),
        "notice": lambda: para() + r.choice(["", "<button>OK</button>", link()]),
        "advert": lambda: r.choice([para, link, lambda: f"<span>{cue()}</span>{para()}"])(),
        "form": lambda: r.choice(["", para()]) + f"<label>{cue()}</label><input name=q>" + r.choice(["<button>Go</button>", "<select><option>A<option>B</select>", "<button type=submit>" + cue() + "</button>"]),
        "comment": lambda: r.choice(["", f"<h3>{cue()}</h3>", f"<h2>{r.randint(1, 99)} {r.choice(['comments', 'Comments', 'responses', 'replies'])}</h2>"]) + "".join(r.choice(['<div class="{n}">{p}</div>', "<li><p>{p}</p></li>", '<article class="{n}"><footer>{c}</footer>{p}</article>', "<p>{p}</p>"]).format(n=_name(r, "comment"), p=para(), c=cue()) for _ in range(r.randint(1, 5))),
        "share": links,
    }[kind]()
    tag, name = tags[kind], _name(r, kind)
    draw = r.random()
    if kind == "footer" and draw < 0.06:
        return f"<p>&copy; {r.randint(1990, 2030)} {cue()}</p>"
    if kind in ("menu", "header", "footer", "sidebar", "form") and draw < 0.5:
        return f"<{tag}>{inside}</{tag}>" if r.random() < 0.7 else f'<{tag} class="{name}">{inside}</{tag}>'
    if draw < 0.57 and kind in _ROLES:
        return f'<div role="{_ROLES[kind]}">{inside}</div>'
    if draw < 0.55 and kind == "notice":
        return f'<div role="{r.choice(["alert", "dialog", "status"])}">{inside}</div>'
    if draw < 0.58:
        return f'<div {r.choice(["hidden", "style=display:none"])}>{inside}</div>'
    tag = r.choice([tag, "div", "div", "section", "ul" if kind == "menu" else "div"])
    if tag == "ul":
        inside = "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 7)))
    return f'<{tag} {r.choice(["class", "id", "class"])}="{name}">{inside}</{tag}>'


def labelled_pages(n: int, seed: int) -> Iterator[tuple[str, list[str]]]:
    """``n`` pages as html, each with the texts of its main blocks in order."""
    for k in range(n):
        r = random.Random(f"{seed}-{k}")
        parts, main = _article(r), []
        body = []
        for markup, texts in parts:
            if r.random() < 0.12:
                body.append(_rest(r, r.choice(["advert", "notice", "share", "sidebar", "form", "menu", "comment"])))
            body.append(markup)
            main += texts
        if r.random() < 0.3:
            body.append(_rest(r, r.choice(["comment", "comment", "share", "sidebar", "footer", "form"])))
        article = r.choice(_WRAPS)(r, "".join(body))
        before = [_rest(r, kind) for kind in r.sample(["menu", "header", "advert", "notice", "form", "sidebar", "menu"], r.randint(0, 4))]
        after = [_rest(r, kind) for kind in r.sample(["footer", "sidebar", "comment", "advert", "share", "notice", "form"], r.randint(0, 4))]
        inner = "".join([*before, article, *after])
        for _ in range(r.choice([0, 0, 1, 2])):
            inner = f'<div {r.choice(["class", "id"])}="{_name(r, "plain")}">{inner}</div>'
        head = f"<head><meta charset=utf-8><title>{html.escape(_text(r, 8))}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        yield f"<!DOCTYPE html><html>{head}<body>{r.choice(['', '<!-- note -->'])}{inner}" + r.choice(["</body></html>", "</body></html>", ""]), main
