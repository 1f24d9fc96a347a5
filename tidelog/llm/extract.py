"""Main text of web pages by a linear-chain conditional random field over leaf blocks."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidelog.llm import labelled_pages
from tidelog.llm.blocks import ELEMENTS, Block, Element, leaf_blocks
from tidelog.llm.common import arrays, nonempty, strings

#: Labelled pages that the model is trained on, gradient steps, and weight of the penalty.
TRAINING_PAGES, STEPS, PENALTY = 400, 200, 0.02

# Parts of names that tell what an element is for.
ROLES = {
    "ad": "ad ads adv advert adverts advertisement banner promo promoted sponsor sponsored sponsors",
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs crumbs pagination pager toc topbar top bar tabs",
    "side": "sidebar side aside widget widgets rail related recommended more popular trending",
    "frame": "header masthead logo footer bottom copyright legal imprint disclaimer terms",
    "notice": "cookie cookies consent gdpr notice alert warning modal popup overlay announcement",
    "form": "form search login signin signup subscribe newsletter contact",
    "comment": "comment comments commentlist reply replies respond disqus discussion feedback",
    "share": "share sharing social follow",
    "content": "article content post entry story main text body page blog single",
}
_ROLE_OF = {word: role for role, words in ROLES.items() for word in words.split()}
_NAME = re.compile(r"[a-z]+")
_CUE = re.compile(r"©|\b(?:copyright|all rights reserved|cookies?|subscribe|sign up|log ?in|advertis\w*|sponsored|"
                  r"related|share|repl(?:y|ies)|comments?|search|accept|newsletter)\b", re.I)


@lru_cache(maxsize=4096)
def _element(name: str, named: str) -> tuple[str, ...]:
    """Features that an element gives to the blocks inside it."""
    roles = {_ROLE_OF[w] for w in _NAME.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", named).lower()) if w in _ROLE_OF}
    return (*((f"in {name}",) if name in ELEMENTS else ()), *(f"role {r}" for r in sorted(roles)))


def _inherited(element: Element | None, met: dict[int, frozenset[str]]) -> frozenset[str]:
    """Features of an element and of all around it: worked out once an element, and the set of the element
    around it where nothing is new. Names that HTML does not have tell nothing, so sets have a bound."""
    chain = []
    while element is not None and id(element) not in met:
        chain.append(element)
        element = element.around
    found = met[id(element)] if element is not None else frozenset()
    for element in reversed(chain):
        own = _element(element.name, element.named)
        if not found.issuperset(own):
            found = found.union(own)
        met[id(element)] = found
    return found


def features(blocks: list[Block]) -> list[list[str]]:
    """Per block, its features: the elements around it, their roles, and its text."""
    out, met = [], {}
    for k, block in enumerate(blocks):
        text = block.text
        words = text.count(" ") + 1
        found = {"always", *_inherited(block.inside, met)}
        if block.inside is not None:
            found.add(f"parent {block.inside.name}")
        share = block.linked / len(text)
        found.add("links none" if share == 0 else "links few" if share < 0.3 else "links most")
        found.add("words " + ("1-3" if words < 4 else "4-9" if words < 10 else "10-24" if words < 25 else "25+"))
        if text[-1] in ".!?…:;\"'”»":
            found.add("ends as a sentence")
        if "," in text:
            found.add("comma")
        if words < 40 and _CUE.search(text):
            found.add("cue")
        if not any(c.isalnum() for c in text):
            found.add("no letters")
        if k == 0:
            found.add("first")
        if k == len(blocks) - 1:
            found.add("last")
        for outer in ("article", "main"):
            if f"in {outer}" in found:
                found.update([f"{outer} and {x}" for x in sorted(found) if x.startswith(("in ", "role ")) and x not in (
                    "in body", "in html", "in article", "in main", "in div", "in p")])
        out.append(sorted(found))
    return out


class Field:
    """Weights of a chain with two labels (0 other, 1 article)."""

    def __init__(self, names: list[str], weights: np.ndarray, moves: np.ndarray):
        self.weights = {n: (float(a), float(b)) for n, (a, b) in zip(names, weights, strict=True)}
        self.moves = moves.tolist()

    def decode(self, rows: list[list[str]]) -> list[int]:
        """The most likely labels of a page's blocks (Viterbi)."""
        none = (0.0, 0.0)
        (aa, ab), (ba, bb) = self.moves
        other = article = 0.0
        back: list[tuple[int, int]] = []
        for k, row in enumerate(rows):
            e0 = e1 = 0.0
            for name in row:
                w = self.weights.get(name, none)
                e0 += w[0]
                e1 += w[1]
            if k == 0:
                other, article = e0, e1
                continue
            to0 = (0, other + aa) if other + aa >= article + ba else (1, article + ba)
            to1 = (0, other + ab) if other + ab >= article + bb else (1, article + bb)
            back.append((to0[0], to1[0]))
            other, article = to0[1] + e0, to1[1] + e1
        labels = [int(article > other)] if rows else []
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def train(pages: list[str], steps: int = STEPS, penalty: float = PENALTY) -> Field:
    """Maximise the conditional likelihood of the labels by gradient steps over all pages at once
    (forward and backward sums over the chain, step sizes by Adam)."""
    parsed = [p for p in map(leaf_blocks, pages) if p]
    rows = [features(p) for p in parsed]
    names = sorted({n for page in rows for row in page for n in row})
    place = {n: k for k, n in enumerate(names)}
    longest = max(map(len, rows))
    x = np.zeros((len(rows), longest, len(names)), np.float32)
    gold, there = np.zeros((len(rows), longest), int), np.zeros((len(rows), longest), bool)
    for p, (page, blocks) in enumerate(zip(rows, parsed, strict=True)):
        for t, row in enumerate(page):
            x[p, t, [place[n] for n in row]] = 1
            gold[p, t], there[p, t] = blocks[t].label, True
    flat, seen = x[there], np.eye(2)[gold] * there[..., None]
    both = there[:, 1:] & there[:, :-1]
    moved = np.einsum("pti,ptj,pt->ij", np.eye(2)[gold[:, :-1]], np.eye(2)[gold[:, 1:]], both)
    total = there.sum()
    w, m = np.zeros((len(names), 2)), np.zeros((2, 2))
    mean, square = [np.zeros_like(w), np.zeros_like(m)], [np.zeros_like(w), np.zeros_like(m)]
    for step in range(1, steps + 1):
        e = np.zeros((len(rows), longest, 2))
        e[there] = flat @ w.astype(np.float32)
        forward, backward = np.zeros_like(e), np.zeros_like(e)
        forward[:, 0] = e[:, 0]
        for t in range(1, longest):
            new = e[:, t] + _log_sum(forward[:, t - 1, :, None] + m, 1)
            forward[:, t] = np.where(there[:, t, None], new, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = _log_sum(m + (e[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(there[:, t + 1, None], new, 0)
        z = _log_sum(forward[:, -1], 1)
        # log z is the last true forward sum, which the padding carries on
        single = np.exp(forward + backward - z[:, None, None]) * there[..., None]
        pair = forward[:, :-1, :, None] + m + (e + backward)[:, 1:, None, :] - z[:, None, None, None]
        pair = np.exp(np.minimum(pair, 0)) * both[..., None, None]
        slope = [(flat.T @ (seen - single)[there].astype(np.float32)) / total - penalty * w / len(names),
                 (moved - pair.sum((0, 1))) / total - penalty * m / len(names)]
        for k, value in enumerate((w, m)):
            mean[k] = 0.9 * mean[k] + 0.1 * slope[k]
            square[k] = 0.999 * square[k] + 0.001 * slope[k] ** 2
            value += 0.1 * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    return Field(names, w, m)


def main_text(page: str | None, model: Field) -> str:
    blocks = leaf_blocks(page, labelled=False) if page else []
    labels = model.decode(features(blocks))
    return "\n\n".join(b.text for b, label in zip(blocks, labels, strict=True) if label)


def extract(pages: DataFrame, model: Field | None = None) -> DataFrame:
    """(page_id, url, text, n_chars): main text of each page; of a page without any, an empty text.

    The model is trained on TRAINING_PAGES labelled pages unless one is given. Pages are decoded where
    they are read, whole, without a shuffle. Null and empty pages have an empty text; null ids and urls
    stay null; equal rows come out once each; columns other than page_id, url and html are not read.
    """
    field = pages.sparkSession.sparkContext.broadcast(model or train(labelled_pages.pages(TRAINING_PAGES)))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for batch in nonempty(batches):
            texts = [main_text(p, field.value) for p in strings(batch, "html")]
            yield arrays(schema, {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts,
                                  "n_chars": list(map(len, texts))})

    rows = pages.selectExpr("cast(page_id as bigint) as page_id", "cast(url as string) as url",
                            "cast(html as string) as html")
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
