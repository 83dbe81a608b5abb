"""Operator 8: main text of pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: runs of text under one block-level element. The field labels each block as main text or
not, from its ancestors' tags, classes and ids and from its text, and each pair of neighbours; Viterbi finds the best
labelling of the page. It is trained on labelled pages: a bounded number, made here from a grammar of articles and of
what stands around them, with the kinds of markup that pages use for either.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled pages that the field is trained on.
TRAINING_PAGES = 500
#: The first alternative with a name is an element whose content is no markup: all up to its end tag is left out.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|iframe|title)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>|<(?=[a-zA-Z/])[^>]*(?:>|\Z)""", re.S | re.I)
_UNREAD_END = re.compile(r"</(button|select|svg)(?=[\s/>])", re.I)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORDS = re.compile(r"[a-z]+")
#: Elements that begin a block, elements that never hold text, and elements of which a new one ends the last.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Controls and drawings: their text is left out up to their end tag, if they have one.
UNREAD = frozenset("button select svg".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
NOT_IN_P = BLOCKS - {"html", "body", "head"}


class Block:
    __slots__ = ("links", "path", "text")

    def __init__(self, path: tuple[str, ...], text: str, links: int):
        self.path, self.text, self.links = path, text, links


def leaf_blocks(page: str) -> list[Block]:
    """Blocks of text in page order: references decoded, white space runs one space, trimmed; empty ones left out."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    held: list[str] = []
    in_link, linked, at = 0, 0, 0
    unread = None  # the element whose end tag is awaited
    last_end = {m[1].lower(): m.start() for m in _UNREAD_END.finditer(page)}

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text and not any(tag == "head" for tag, _ in stack):
                out.append(Block(tuple(f"{tag} {names}" if names else tag for tag, names in stack), text, linked))
            held.clear()
        linked = 0

    for m in _TOKEN.finditer(page):
        if m.start() > at and not unread:
            held.append(page[at : m.start()])
            if in_link:
                linked += m.start() - at
        at = m.end()
        name = m[3]
        if not name:
            continue
        tag = name.lower()
        if tag in UNREAD:
            if m[2]:
                unread = None if unread == tag else unread
            elif not unread and not m[4].endswith("/") and last_end.get(tag, -1) > m.start():
                unread = tag
            continue
        if unread:
            continue
        if tag == "a":
            in_link = 0 if m[2] else 1
        if tag in ("br", "wbr", "img", "input"):
            held.append(" ")
        if tag not in BLOCKS:
            continue
        if m[2]:
            if any(t == tag for t, _ in stack):
                flush()
                while stack.pop()[0] != tag:
                    pass
            continue
        flush()
        if stack and stack[-1][0] == "p" and tag in NOT_IN_P:
            stack.pop()
        while stack and stack[-1][0] in ENDS.get(tag, ()):
            stack.pop()
        if tag == "body":
            stack = [x for x in stack if x[0] != "head"]
        if tag not in VOID:
            names = " ".join(sorted({w for found in _NAMES.findall(m[4]) for w in _WORDS.findall("".join(found).lower())}))
            stack.append((tag, names))
    if at < len(page) and not unread:
        held.append(page[at:])
    flush()
    return out


#: What names of classes and ids tell, by how they begin.
_KINDS = {
    "nav": "nav menu breadcrumb crumb pager pagination toc skip topbar navbar links",
    "ad": "ad ads advert advertisement banner sponsor sponsored promo promotion affiliate",
    "comment": "comment comments respond reply replies disqus discussion reader",
    "side": "sidebar side aside widget related recommended trending popular more rail",
    "foot": "footer foot copyright legal colophon bottom",
    "head": "header masthead top logo brand site",
    "notice": "cookie consent notice alert gdpr privacy banner popup modal newsletter subscribe signup login",
    "share": "share social follow tweet facebook",
    "body": "article content post entry story main text body page prose",
}
_KIND_OF = {word: kind for kind, words in _KINDS.items() for word in words.split()}


@lru_cache(4096)
def _path_features(path: tuple[str, ...]) -> tuple[str, ...]:
    found = {"bias"}
    for depth, part in enumerate(reversed(path)):
        tag, _, names = part.partition(" ")
        found.add(f"in {tag}")
        if not depth:
            found.add(f"leaf {tag}")
        for name in names.split():
            kind = _KIND_OF.get(name) or _KIND_OF.get(name.rstrip("s"))
            if kind:
                found.add(f"names {kind}")
                if tag in ("p", "li", "div", "section") and not depth:
                    found.add(f"leaf names {kind}")
    tags = {part.partition(" ")[0] for part in path}
    found.add("within article" if tags & {"article", "main"} else "outside article")
    return tuple(sorted(found))


def features(block: Block) -> tuple[str, ...]:
    text = block.text
    n, density = len(text), block.links / max(len(text), 1)
    out = [f"length {min(n.bit_length(), 12)}", "links all" if density > 0.8 else "links many" if density > 0.3 else "links few" if density else "links none"]
    out.append("stop" if text[-1] in ".!?:\"'”»…" else "no stop")
    if "©" in text[:40] or "copyright" in text[:60].lower():
        out.append("copyright")
    if "|" in text or "·" in text or "»" in text:
        out.append("bars")
    return (*_path_features(block.path), *out)


_VOCABULARY = "the of and to in is was for on that with as it be at by from this which or an are not have had but all their one more other time when new may such only over into also its two".split()


def _labelled_page(rng: random.Random) -> list[tuple[Block, bool]]:
    """A page of the grammar as its blocks with their labels; the main text is marked by a character of its own."""

    def words(low: int, high: int) -> str:
        return " ".join(rng.choice(_VOCABULARY) + rng.choice(("", "", "er", "ing", "ed", "tion")) for _ in range(rng.randint(low, high)))

    def sentences(n: int) -> str:
        return " ".join(words(3, 18).capitalize() + "." for _ in range(n))

    def link(text: str) -> str:
        return f'<a href="/{text[:8]}">{text}</a>'

    mark = "\x01"

    def menu(tag: str, names: str) -> str:
        items = "".join(f"<li>{link(words(1, 3))}</li>" for _ in range(rng.randint(3, 9)))
        return f"<{tag}{names}><ul>{items}</ul></{tag}>"

    def named(*names: str) -> str:
        return f' {rng.choice(("class", "id"))}="{rng.choice(names)}"'

    def paragraph() -> str:
        kind, text = rng.random(), mark + sentences(rng.randint(1, 6))
        if kind < 0.1:
            text = mark + words(1, 6).capitalize() + rng.choice((".", ""))
        if rng.random() < 0.15:
            text = f"{text} {link(words(1, 4))} {words(2, 8)}."
        if kind < 0.65:
            return f"<p>{text}</p>"
        if kind < 0.72:
            return f"<h{(h := rng.randint(2, 4))}>{mark}{words(2, 8)}</h{h}>"
        if kind < 0.8:
            return f"<p><b>{text}<br>"
        if kind < 0.86:
            return "<ul>" + "".join(f"<li>{mark}{sentences(1)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        if kind < 0.9:
            return f"<blockquote><p>{text}</p></blockquote>"
        if kind < 0.94:
            return f"<pre>{text}</pre>"
        return f"<table><tr><td>{mark}{words(1, 5)}</td><td>{mark}{words(1, 5)}</td></tr></table>"

    def noise() -> str:
        kind = rng.randrange(9)
        if kind == 0:
            return f"<div{named('ad', 'ads', 'advert', 'sponsored', 'promo-box', 'ad-banner')}>{rng.choice((sentences(rng.randint(1, 2)), link(words(2, 6))))}</div>"
        if kind == 1:
            inner = rng.choice((menu("div", ""), f"<h3>{words(1, 3)}</h3><p>{sentences(rng.randint(1, 3))}</p>"))
            return rng.choice((f"<aside{rng.choice(('', named('sidebar', 'related')))}>{inner}</aside>", f"<div{named('sidebar', 'widget', 'related-posts')}>{inner}</div>"))
        if kind == 2:
            return f"<div{named('cookie-notice', 'consent', 'notice', 'newsletter')}>{rng.choice(('', '<p>'))}{sentences(rng.randint(1, 3))}</div>"
        if kind == 3:
            return f"<form{rng.choice(('', named('subscribe', 'login', 'search')))}><label>{words(1, 4)}</label><input type=text><p>{sentences(1)}</p></form>"
        if kind in (4, 5):
            entries = "".join(f"<{(t := rng.choice(('div', 'li', 'p')))}{rng.choice(('', named('comment', 'reply')))}>{sentences(rng.randint(1, 4))}</{t}>" for _ in range(rng.randint(1, 5)))
            return f"<{(t := rng.choice(('section', 'div', 'ol')))}{named('comments', 'reader-comments', 'comment-list', 'respond')}><h3>{words(1, 3)}</h3>{entries}</{t}>"
        if kind == 6:
            return f"<div{named('share', 'social-links')}>{link(words(1, 2))} {link(words(1, 2))}</div>"
        if kind == 7:
            return menu(rng.choice(("nav", "div")), named("nav", "menu", "breadcrumb", "pagination"))
        return menu("nav", "")

    head = rng.choice((f"<header{rng.choice(('', named('masthead', 'site-header')))}><p>{words(1, 5)}</p>{menu('nav', '')}</header>", menu("nav", ""), menu("nav", ""), f"<div{named('header', 'topbar')}>{words(1, 4)}</div>"))
    body = [f"<h1>{mark}{words(2, 10)}</h1>"] * (rng.random() < 0.85) + [paragraph() for _ in range(rng.randint(1, 14))]
    if rng.random() < 0.35:
        body.insert(rng.randrange(len(body) + 1), noise())
    wrap = rng.choice((("<article>", "</article>"),) * 4 + (("", ""), ("<main>", "</main>"), (f"<div{named('content', 'article-body', 'post', 'entry-content', 'story')}>", "</div>"), ("<main><article>", "</article></main>")))
    foot = rng.choice((f"<footer>&copy; {words(1, 3)} &middot; {sentences(1)}</footer>", f"<footer><p>{sentences(1)}</p>{menu('div', '')}</footer>", f"<div{named('footer', 'site-footer')}>&copy; {words(2, 6)}</div>"))
    if rng.random() < 0.1:
        head = ""
    if rng.random() < 0.1:
        foot = ""
    around = [noise() for _ in range(rng.randint(0, 3))], [noise() for _ in range(rng.randint(0, 3))]
    page = f"<html><head><title>{words(2, 6)}</title></head><body>{head}{''.join(around[0])}{wrap[0]}{''.join(body)}{wrap[1]}{''.join(around[1])}{foot}</body></html>"
    out = []
    for block in leaf_blocks(page):
        main = mark in block.text
        block.text = block.text.replace(mark, "").strip() or "."
        out.append((block, main))
    return out


class Field:
    """Weights of a two-label chain: of each feature by label, of neighbouring labels, and of the first label."""

    def __init__(self, names: dict[str, int]):
        self.names = names
        self.state, self.step, self.first = np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros(2)

    def rows(self, block: Block) -> list[int]:
        return [i for f in features(block) if (i := self.names.get(f)) is not None]

    def scores(self, blocks: list[Block]) -> np.ndarray:
        return np.array([self.state[self.rows(b)].sum(0) for b in blocks])

    def label(self, blocks: list[Block]) -> list[bool]:
        """Viterbi."""
        if not blocks:
            return []
        s0, s1 = self._sum(blocks[0])
        a, b = s0 + float(self.first[0]), s1 + float(self.first[1])
        t00, t01, t10, t11 = map(float, self.step.ravel())
        back = []
        for block in blocks[1:]:
            s0, s1 = self._sum(block)
            to0, to1 = a + t00 < b + t10, a + t01 < b + t11
            a, b = (b + t10 if to0 else a + t00) + s0, (b + t11 if to1 else a + t01) + s1
            back.append((to0, to1))
        out = [b > a]
        for pair in reversed(back):
            out.append(pair[out[-1]])
        return out[::-1]

    def _sum(self, block: Block) -> tuple[float, float]:
        a = b = 0.0
        pairs = self._pairs
        for f in features(block):
            if (w := pairs.get(f)) is not None:
                a += w[0]
                b += w[1]
        return a, b

    def settle(self) -> Field:
        self._pairs = {f: (float(self.state[i, 0]), float(self.state[i, 1])) for f, i in self.names.items()}
        return self


def train(pages: list[list[tuple[Block, bool]]], epochs: int = 12, rate: float = 0.3, decay: float = 1e-4, seed: int = 5) -> Field:
    """Log-likelihood by AdaGrad, page by page; marginals by forward and backward sums."""
    names: dict[str, int] = {}
    data = []
    for page in pages:
        rows = [[names.setdefault(f, len(names)) for f in features(b)] for b, _ in page]
        if rows:
            data.append((rows, np.array([int(y) for _, y in page])))
    field = Field(names)
    seen = [np.full_like(x, 1e-6) for x in (field.state, field.step, field.first)]
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(data)):
            rows, y = data[k]
            n = len(rows)
            flat, owner = np.concatenate(rows), np.repeat(np.arange(n), [len(r) for r in rows])
            s = np.zeros((n, 2))
            np.add.at(s, owner, field.state[flat])
            forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
            forward[0] = field.first + s[0]
            for i in range(1, n):
                forward[i] = np.logaddexp(forward[i - 1, 0] + field.step[0], forward[i - 1, 1] + field.step[1]) + s[i]
            for i in range(n - 2, -1, -1):
                onward = s[i + 1] + backward[i + 1]
                backward[i] = np.logaddexp(field.step[:, 0] + onward[0], field.step[:, 1] + onward[1])
            total = np.logaddexp(*forward[-1])
            error = np.exp(forward + backward - total)
            pairs = np.exp(forward[:-1, :, None] + field.step[None] + (s[1:] + backward[1:])[:, None, :] - total).sum(0) if n > 1 else np.zeros((2, 2))
            error[np.arange(n), y] -= 1
            np.subtract.at(pairs, (y[:-1], y[1:]), 1)
            gradient = np.zeros_like(field.state)
            np.add.at(gradient, flat, error[owner])
            for weights, g, sums in zip((field.state, field.step, field.first), (gradient + decay * field.state, pairs, error[0]), seen, strict=True):
                sums += g * g
                weights -= rate * g / np.sqrt(sums)
    return field.settle()


@lru_cache(2)
def trained_field(pages: int = TRAINING_PAGES, seed: int = 3) -> Field:
    rng = random.Random(seed)
    return train([_labelled_page(rng) for _ in range(pages)])


def main_text(field: Field, page: str | None) -> str:
    blocks = leaf_blocks(page or "")
    return "\n\n".join(b.text for b, main in zip(blocks, field.label(blocks), strict=True) if main)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", training_pages: int = TRAINING_PAGES) -> DataFrame:
    """Per row: id, url, text (main blocks in page order, joined by two line feeds) and n_chars, without a shuffle.

    A null or empty page, or one without main text, has the empty text; a very long one is read whole. Labellings of equal
    score go to the one that has less main text. Repeated rows, null ids and ties each get a row. Only the three named
    columns are read, so others can't clash. An empty table gives no rows.
    """
    shared = pages.sparkSession.sparkContext.broadcast(trained_field(training_pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(shared.value, x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    out = rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, url string, text string, n_chars long")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
