"""Makes the weights of `html_blocks`: python -m vellum.llm.train_html. The same weights every time.

Pages are written by a seeded rule in many skeletons (article and main elements, named and plain divs, blogs, tables) with
menus, headers, footers, sidebars, notices, adverts, forms and reader comments around and inside the main text. Main text has
MARK in front of each block; the mark is taken off before the vectors are made.
"""

from __future__ import annotations

import random

import numpy as np

from vellum.llm.html_blocks import PATH_DIM, WEIGHTS, WORD_DIM, Block, Labeller, blocks, padded, vectors

MARK = "\ue000"
#: Words that stand around main texts rather than in them.
AROUND = (
    "home about contact us menu search login sign up register account cart shop help faq news blog archive archives categories tags share tweet facebook twitter email print "
    "subscribe newsletter rss follow advertisement sponsored promoted ad cookies cookie policy privacy terms conditions accept consent copyright rights reserved powered by "
    "comments comment reply leave a reply post posted says said on at your name website save submit cancel related posts popular recent more read next previous page skip to content "
    "navigation sitemap careers press jobs site map language all topics trending you may also like view"
).split()


def made_page(r: random.Random) -> tuple[list[Block], list[int]]:
    """A training page: its blocks and their labels."""
    alphabet = r.choice(("aeioubcdfghlmnprstvwz", "aeiouäöüßéèñçbcdfghlmnprst"))
    word = lambda: "".join(r.choice(alphabet) for _ in range(r.randint(1, 9)))
    common = [word() for _ in range(12)]
    free = lambda n: [r.choice(common) if r.random() < 0.3 else r.choice(AROUND) if r.random() < 0.02 else word() for _ in range(n)]
    line = lambda a, b: " ".join(free(r.randint(a, b)))
    sentence = lambda a, b: " ".join(line(4, 16).capitalize() + r.choice(("", ".", ".", ".", "!", "?")) for _ in range(r.randint(a, b)))
    known = r.random() < 0.6  # else the page's menus and the like are of unknown words, as in other languages
    around = lambda a, b: " ".join(r.choice(AROUND) if known else word() for _ in range(r.randint(a, b))).capitalize()
    named = r.random() < 0.75  # else divs without classes

    def div(names: tuple[str, ...], inner: str, *elements: str) -> str:
        tag = r.choice(elements) if elements and r.random() < 0.6 else "div"
        shown = r.choice(names)
        attribute = (f' class="{shown}"' if r.random() < 0.7 else f' id="{shown.replace(" ", "-")}"') if (named or tag == "div" and elements and r.random() < 0.3) else ""
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def menu() -> str:
        items = [f'<a href="/{word()}">{around(1, 3)}</a>' for _ in range(r.randint(2, 12))]
        k = r.random()
        if k < 0.65:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return r.choice((" | ", " ", " &middot; ", "\n", " &raquo; ")).join(items) if k < 0.9 else "".join(f"<p>{x}</p>" for x in items)

    def paragraph() -> str:
        k = r.random()
        if k < 0.5:
            return f"<p>{MARK}{sentence(1, 6)}</p>"
        if k < 0.58:
            return f"<p>{MARK}{sentence(1, 2)} <a href='/{word()}'>{line(1, 4)}</a> {sentence(1, 2)}</p>"
        if k < 0.66:
            return f"<p><b>{MARK}{sentence(1, 4)}<br>" + (f"{MARK}{sentence(1, 2)}" if r.random() < 0.3 else "")
        if k < 0.74:
            return f"<h{(n := r.randint(2, 4))}>{MARK}{line(2, 8)}</h{n}>"
        if k < 0.8:
            kind = r.choice(("ul", "ol"))
            return f"<{kind}>" + "".join(f"<li>{MARK}{line(2, 14)}</li>" for _ in range(r.randint(2, 6))) + f"</{kind}>"
        if k < 0.85:
            return f"<blockquote><p>{MARK}{sentence(1, 2)}</p></blockquote>"
        if k < 0.89:
            return f"<pre>{MARK}{sentence(1, 2)}</pre>"
        if k < 0.91:
            return f"<div>{MARK}{sentence(1, 4)}</div>"
        if k < 0.94:  # odd lines that are main text all the same
            odd = r.choice((r.choice((" | ", " - ", " / ", " &raquo; ", ", ")).join(free(r.randint(2, 20))), " ".join([word()] * r.randint(2, 60)), line(1, 30).upper(), "".join(r.choice("0123456789 .,-") for _ in range(r.randint(3, 40))) + "1", f"&copy; {r.randint(1990, 2030)} {line(1, 6)}", around(3, 10)))
            return f"<p>{MARK}{odd}</p>"
        cells = lambda tag: "<tr>" + "".join(f"<{tag}>{MARK}{line(1, 4)}</{tag}>" for _ in range(width)) + "</tr>"
        width = r.randint(2, 4)
        return "<table>" + cells("th") + "".join(cells("td") for _ in range(r.randint(1, 4))) + "</table>"

    def comments() -> str:
        title = r.choice((f"<h3>{around(1, 3)}</h3>", f"<h2>{r.randint(1, 99)} comments</h2>", "<h3>Comments</h3>", ""))
        said = lambda: r.choice((f"<p>{sentence(1, 4)}</p>", f"<p><b>{word()}</b> {around(1, 2)}:</p><p>{sentence(1, 4)}</p>", sentence(1, 3)))
        each = [div(("comment", "comment body", "reply", "response"), said(), "div", "article" if r.random() < 0.3 else "div") for _ in range(r.randint(1, 7))]
        inner = title + ("<ol>" + "".join(f"<li>{x}</li>" for x in each) + "</ol>" if r.random() < 0.4 else "".join(each))
        reply = r.choice(("", f'<h3>{r.choice(("Leave a Reply", "Leave a comment", "Add your comment", around(2, 4)))}</h3>' + form()))
        return div(("comments", "comment list", "comments area", "disqus thread", "responses", "discussion"), inner + reply, "section")

    def form() -> str:
        return f'<form action="/x"><label>{around(1, 3)}</label><input name="q"><p>{around(2, 8)}</p><button>{around(1, 2)}</button></form>'

    def advert() -> str:
        inner = r.choice((sentence(1, 3), f"<p>{sentence(1, 2)}</p>", f"<a href='/x'>{sentence(1, 1)}</a>", around(1, 3)))
        shown = r.choice(("ad", "ad", "ad", "ads", "advert", "advertisement", "banner", "sponsored", "promo", "promotion"))
        return f'<div class="{shown}">{inner}</div>'

    def aside() -> str:
        inner = r.choice((f"<h3>{around(1, 3)}</h3>{menu()}", f"<p>{sentence(1, 4)}</p>", f"<h4>{around(1, 3)}</h4><p>{sentence(1, 3)}</p>", menu()))
        return f"<aside>{inner}</aside>" if r.random() < 0.6 else f'<div class="{r.choice(("sidebar", "side", "widget", "related", "related posts"))}">{inner}</div>'

    def inside() -> str:
        """What is no main text though it stands inside its element."""
        share = f'<div class="{r.choice(("share", "social", "share buttons", "tags", "meta", "related", "author box", "newsletter"))}">{r.choice((menu(), around(2, 6)))}</div>'
        return r.choice((advert, aside, aside, lambda: share, comments))()

    def main() -> str:
        head = f"<h1>{MARK}{line(2, 10)}</h1>" if r.random() < 0.85 else ""
        parts = [paragraph() for _ in range(r.choice((0, 1, 1, 2, 3, 5, 8, 12)))]
        if not head and not parts:
            parts = [f"<p>{MARK}{sentence(1, 3)}</p>"]
        if r.random() < 0.3:
            parts.insert(r.randint(0, len(parts)), inside())
        if r.random() < 0.2:
            parts.append(inside())
        body = head + "".join(parts)
        k = r.random()
        if k < 0.35:
            return f"<article>{body}</article>"
        if k < 0.5:
            return r.choice(("<main>{}</main>", "<main><article>{}</article></main>", '<div id="wrap"><article class="post">{}</article></div>')).format(body)
        if k < 0.75:
            return r.choice(('<div class="content">{}</div>', '<div id="main"><div class="post entry">{}</div></div>', '<div class="article body">{}</div>', '<section class="story">{}</section>', '<div class="entry content">{}</div>', '<div id="content"><div class="text">{}</div></div>', '<div role="main">{}</div>')).format(body)
        if k < 0.93:
            return r.choice(("<div>{}</div>", "<div><div>{}</div></div>", "{}")).format(body)
        return f"<table><tr><td>{menu()}</td><td>{body}</td></tr></table>"

    has = lambda p: r.random() < p
    before = [
        (0.4, lambda: r.choice((f"<header><h1>{around(1, 4)}</h1><p>{around(3, 8)}</p></header>", div(("header", "masthead", "top", "branding"), f"<h2>{around(1, 4)}</h2>"), f"<header>{around(1, 5)}</header>", f"<div>{around(1, 4)}</div>"))),
        (0.85, lambda: div(("menu", "nav", "navigation", "navbar", "topnav"), menu(), "nav")),
        (0.25, lambda: f'<div class="{r.choice(("cookie notice", "cookie", "notice", "consent", "newsletter", "popup", "alert"))}" role="alert"><p>{r.choice((sentence(1, 2), around(4, 14)))}</p></div>'),
        (0.5, advert), (0.15, aside), (0.15, form), (0.15, lambda: div(("breadcrumb", "breadcrumbs"), " &gt; ".join(f"<a href='/'>{around(1, 2)}</a>" for _ in range(r.randint(1, 3))))),
    ]
    after = [
        (0.15, advert), (0.35, comments), (0.3, aside), (0.15, form), (0.1, lambda: div(("nav", "pagination", "pager"), menu(), "nav")),
        (0.85, lambda: r.choice((f"<footer>&copy; {word()}.example.com &middot; {sentence(1, 3)}</footer>", f"<footer><p>{r.choice((around(3, 10), sentence(1, 2)))}</p>{menu()}</footer>", div(("footer", "bottom", "colophon", "site info"), r.choice((sentence(1, 2), around(2, 8), f"&copy; {r.randint(1990, 2030)} {around(2, 6)}"))), f"<div>&copy; {r.randint(1990, 2030)} {around(1, 6)}</div>"))),
    ]
    body = "".join(f() for p, f in before if has(p)) + main() + "".join(f() for p, f in after if has(p))
    if r.random() < 0.2:
        body = div(("page", "wrapper", "container", "site"), body)
    out, labels = [], []
    for b in blocks(f"<html><head><title>t</title></head><body>{body}</body></html>"):
        text = b.text.replace(MARK, "").strip()
        if text:
            out.append(b._replace(text=text))
            labels.append(int(MARK in b.text))
    return out, labels


def fit(seed: int = 5, steps: int = 700, pages: int = 32) -> Labeller:
    """Adam on made pages."""
    r, net = random.Random(seed), Labeller()
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    v = {k: np.zeros_like(x) for k, x in net.w.items()}
    for step in range(1, steps + 1):
        made = [x for x in (made_page(r) for _ in range(pages)) if x[0]]
        x, mask = padded([vectors(found) for found, _ in made])
        # Words or the path go missing now and then, so that neither decides alone.
        x[:, :, PATH_DIM : PATH_DIM + WORD_DIM] *= r.random() < 0.8
        y = np.zeros(mask.shape, np.float32)
        for k, (_, labels) in enumerate(made):
            y[k, : len(labels)] = labels
        loss, g = net.gradients(x, mask, y)
        if step % 100 == 0:
            print(step, round(loss, 4), flush=True)
        rate = 0.012 * min(1.0, 1.6 * (1 - step / (steps + 1)))
        for k in net.w:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
            net.w[k] = (net.w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


if __name__ == "__main__":
    np.savez_compressed(WEIGHTS, **fit().w)
