"""Labelled pages to train the extraction model on, put together by rule from marked-up parts.

``data-label="1"`` marks what belongs to the article; everything else does not. The parts were marked
by hand; the rule varies wrappers, names, lengths and order, so that no single name decides.
"""

from __future__ import annotations

import random

_WORDS = """the of and to in is that for it was on are as with his they at be this from have or by one had not but what
all were when we there can an your which their said if do will each about how up out them then she many some so these
would other into has more her two like him see time could no make than first been its who now people my made over did
down only way find use may water long little very after words called just where most know""".split()


def _sentence(rng: random.Random, low: int, high: int) -> str:
    some = [rng.choice(_WORDS) for _ in range(rng.randint(low, high))]
    for k in range(4, len(some) - 1, 7):
        some[k] += rng.choice(["", ",", ""])
    return " ".join(some).capitalize() + rng.choice([".", ".", ".", "?", "!"])


def _prose(rng: random.Random) -> str:
    text = " ".join(_sentence(rng, 4, 22) for _ in range(rng.choice([1, 1, 2, 3, 5, 8])))
    if rng.random() < 0.2:
        some = text.split(" ")
        k = rng.randrange(len(some))
        some[k] = f'<a href="/x">{some[k]}</a>'
        text = " ".join(some)
    return text


def _phrase(rng: random.Random, low: int = 1, high: int = 5) -> str:
    return " ".join(rng.choice(_WORDS) for _ in range(rng.randint(low, high)))


def _links(rng: random.Random, tag: str = "li") -> str:
    return "".join(f'<{tag}><a href="/{k}">{_phrase(rng, 1, 3)}</a></{tag}>' for k in range(rng.randint(3, 7)))


def _within(rng: random.Random) -> str:
    """What stands inside an article without being part of it."""
    name = rng.choice(["ad", "advert", "promo-box", "newsletter", "related", "notice", "share-links", "sponsored"])
    text = " ".join(_sentence(rng, 2, 12) for _ in range(rng.choice([1, 1, 2])))
    return rng.choice([
        f'<div class="{name}" data-label="0">{text}</div>',
        f'<div class="{name}" data-label="0"><p>{text}</p></div>',
        f'<aside data-label="0"><p>{text}</p></aside>',
        f'<aside class="{name}" data-label="0"><h3>{_phrase(rng)}</h3><p>{text}</p></aside>',
        f'<form data-label="0"><p>{text}</p><label>{_phrase(rng)}</label><button>Send</button></form>',
        f'<nav data-label="0"><ul>{_links(rng)}</ul></nav>',
        f'<footer data-label="0"><p>{text}</p></footer>'])


def _article(rng: random.Random) -> str:
    parts = [f"<h1>{_phrase(rng, 3, 9)}</h1>"] if rng.random() < 0.8 else []
    if rng.random() < 0.15:
        parts = [f"<header>{''.join(parts)}</header>"]
    for _ in range(rng.randint(1, 9)):
        kind = rng.random()
        if kind < 0.78:
            parts.append(f"<p>{_prose(rng)}" + ("</p>" if rng.random() < 0.8 else ""))
        elif kind < 0.84:
            parts.append(f"<h2>{_phrase(rng, 2, 6)}</h2><p>{_prose(rng)}</p>")
        elif kind < 0.88:
            parts.append(f"<blockquote><p>{_prose(rng)}</p></blockquote>")
        elif kind < 0.92:
            parts.append("<ul>" + "".join(f"<li>{_sentence(rng, 3, 10)}</li>" for _ in range(3)) + "</ul>")
        elif kind < 0.95:
            parts.append(f"<p><b>{_prose(rng)}<br>")
        elif kind < 0.97:
            parts.append(f"<table><tr><td>{_phrase(rng)}</td><td>{_sentence(rng, 2, 6)}</td></tr></table>")
        else:
            parts.append(f"<p>{_phrase(rng, 1, 3)}.</p>")
        if rng.random() < 0.1:
            parts.append(_within(rng))
    if rng.random() < 0.08:
        parts.append(f'<div data-label="0">{rng.choice(_comments(rng))}</div>')
    inner = "".join(parts)
    opening = rng.choice([
        "<article>", "<article>", "<article>", '<article class="post">', "<main>", '<div id="content">',
        '<div class="post-body">', '<div class="entry-content">', '<section class="story">', '<div class="article-text">',
        "<div>", '<main><div class="c12">'])
    names = [t.split(" ")[0] for t in opening.strip("<>").split("><")]
    marked = opening.replace("<" + names[0], f'<{names[0]} data-label="1"', 1)
    return marked + inner + "".join(f"</{n}>" for n in reversed(names))


def _top(rng: random.Random) -> list[str]:
    return [
        f"<nav><ul>{_links(rng)}</ul></nav>",
        f"<nav>{_links(rng, 'span')}</nav>",
        f'<header><div class="logo">{_phrase(rng, 1, 2)}</div><p>{_phrase(rng, 3, 7)}</p></header>',
        f'<header><h1>{_phrase(rng, 1, 3)}</h1><p>{_sentence(rng, 3, 9)}</p></header>',
        f'<div id="menu"><ul>{_links(rng)}</ul></div>',
        f'<div class="top-bar">{_phrase(rng, 2, 4)} <a href="/login">log in</a></div>',
        f'<div class="breadcrumb"><a href="/">home</a> / <a href="/a">{_phrase(rng, 1, 2)}</a></div>',
        f'<div class="cookie-notice"><p>We use cookies. {_sentence(rng, 5, 18)}</p><button>Accept</button></div>',
        f'<div class="notice" role="alert">{_sentence(rng, 4, 16)}</div>',
        f'<div class="ad">{_sentence(rng, 2, 14)} {_sentence(rng, 2, 9)}</div>',
        f'<!-- ad --><div class="ad">{_sentence(rng, 2, 9)}</div>',
        f'<div id="banner-ad"><p>{_sentence(rng, 4, 14)}</p></div>',
        f'<form action="/search"><label>{_phrase(rng, 1, 2)}</label><input name="q"><button>Search</button></form>',
    ]


def _side(rng: random.Random) -> list[str]:
    return [
        f"<aside><h3>{_phrase(rng, 1, 3)}</h3><ul>{_links(rng)}</ul></aside>",
        f"<aside><p>{_sentence(rng, 5, 18)} {_sentence(rng, 5, 12)}</p></aside>",
        f'<div class="sidebar"><h3>{_phrase(rng, 1, 3)}</h3><p>{_sentence(rng, 5, 18)}</p><ul>{_links(rng)}</ul></div>',
        f'<div class="related"><h4>Related</h4><ul>{_links(rng)}</ul></div>',
        f'<div class="share">{_links(rng, "span")}</div>',
        f'<div class="sponsored"><p>{_sentence(rng, 5, 20)}</p></div>',
        f'<form class="newsletter"><p>{_sentence(rng, 4, 14)}</p><input name="mail"><button>Sign up</button></form>',
    ]


def _comments(rng: random.Random) -> list[str]:
    def some(tag: str) -> str:
        return "".join(f'<{tag} class="comment"><b>{_phrase(rng, 1, 2)}</b><p>{_prose(rng)}</p></{tag}>'
                       for _ in range(rng.randint(1, 5)))

    return [
        f'<section id="comments"><h2>Comments</h2>{some("div")}</section>',
        f'<div class="comments"><h3>{rng.randint(2, 9)} comments</h3><ol>{some("li")}</ol></div>',
        f'<div id="disqus_thread">{some("div")}</div>',
        f'<section class="comments">{some("article")}</section>',
    ]


def _bottom(rng: random.Random) -> list[str]:
    return [
        f"<footer>&copy; {_phrase(rng, 1, 2)} &middot; {_sentence(rng, 3, 12)}</footer>",
        f"<footer><p>{_sentence(rng, 5, 20)} {_sentence(rng, 5, 20)}</p><ul>{_links(rng)}</ul></footer>",
        f'<div id="footer"><p>Copyright 2020 {_phrase(rng, 1, 3)}. All rights reserved.</p></div>',
        f'<div class="legal"><p>{_sentence(rng, 6, 20)}</p></div>',
    ]


def pages(n: int = 400, seed: int = 11) -> list[str]:
    """The first ``n`` labelled pages."""
    out = []
    for k in range(n):
        rng = random.Random(seed * 100_003 + k)
        top = rng.sample(_top(rng), rng.randint(0, 4))
        side = rng.sample(_side(rng), rng.choice([0, 0, 1, 1, 2]))
        before = side if rng.random() < 0.3 else []
        after = [] if before else side
        comments = rng.sample(_comments(rng), 1) if rng.random() < 0.4 else []
        bottom = rng.sample(_bottom(rng), rng.choice([0, 1, 1, 2]))
        main = _article(rng) if rng.random() < 0.97 else ""
        body = "".join([*top, *before, main, *after, *comments, *bottom])
        out.append(f"<!DOCTYPE html><html><head><title>{_phrase(rng)}</title></head><body>{body}</body></html>")
    return out
