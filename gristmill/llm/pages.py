"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks: runs of text between block-level tags, each with its open tags. Features are the open
tags, words in their class and id, and the block's text (length, share of link text, punctuation, place). The field has
two labels; it is trained by maximum likelihood on labelled pages that ``labelled_pages`` writes from a seed, in many
layouts, and pages are decoded by Viterbi. Tasks decode a page at a time; the weights are a few hundred numbers.

Edge cases: null and empty pages give an empty text; a page of any length is read whole in its task, in time that grows with
its length, whatever is left unclosed; columns of any other name may stand beside page_id, url and html, which the query
takes by name; unclosed tags, comments and scripts run to where a browser would
end them or to the end of the page; repeated rows are treated alike; an empty table gives no rows.
"""

from __future__ import annotations

import html
import random
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import map_text

_TAG = re.compile(
    r"<!--(?:.*?-->|.*)|<!\[CDATA\[(?:.*?\]\]>|.*)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
#: What still counts where no tag ends: comments that run to the end of the page.
_LAST = re.compile(r"<!--|<!\[CDATA\[")
#: Open tags that a block sees, the innermost ones.
_DEPTH = 128
_CLASS = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Elements whose content is no text of the page; those that browsers read raw run to the end of the page if unclosed.
_HIDDEN = ("script", "style", "textarea", "template", "iframe", "svg", "select")
_RAW = frozenset(("script", "style", "textarea", "iframe"))
_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in _HIDDEN}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small "
    "span strike strong sub sup time tt u var wbr "
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover "
    "munderover mmultiscripts mtable mtr mtd semantics annotation".split()
)
_SPACED = frozenset(("br", "img", "wbr"))
#: A start tag ends open tags of these kinds, up to a container.
_CLOSES = {
    "p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"),
    "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"),
}
_BLOCK_ENDS_P = frozenset(
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre "
    "section table ul".split()
)
_WALLS = frozenset("ul ol dl table body html article section div main nav aside header footer form blockquote td th".split())


@dataclass
class Block:
    text: str
    open: tuple[tuple[str, str], ...]
    linked: int


def _decoded(text: str) -> str:
    """Character references decoded; the commonest one without a call for each."""
    if "&" not in text:
        return text
    return "&".join(html.unescape(x) if "&" in x else x for x in text.split("&amp;"))


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks with a visible character, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    linked = links = 0
    page = page or ""

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(_decoded("".join(parts)).split())
            if text:
                out.append(Block(text, tuple(x for x in stack[-_DEPTH:] if x[0] not in _INLINE), linked))
        parts, linked = [], 0

    at, n, last = 0, len(page), page.rfind(">")
    unclosed: set[str] = set()  # elements of which no end follows, so that it is looked for once
    while at < n:
        m = _TAG.search(page, at) if at <= last else _LAST.search(page, at)
        stop = m.start() if m else n
        if stop > at:
            parts.append(page[at:stop])
            if links:
                linked += stop - at
        if not m or at > last:
            break
        at = m.end()
        shut, name, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if name in _INLINE:
            if name in _SPACED:
                parts.append(" ")
            elif name == "a":
                links = 0 if shut else 1
            continue
        flush()
        links = 0
        if shut:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
                if name == "p" and stack[k][0] in _WALLS:
                    break
            continue
        if name in _HIDDEN and not (name == "svg" and attrs.endswith("/")):
            end = None if name in unclosed else _END[name].search(page, at)
            if end is None:
                unclosed.add(name)
            if end or name in _RAW:
                at = end.end() if end else n
                continue
        ends = _CLOSES.get(name, ("p",) if name in _BLOCK_ENDS_P else ())
        if name == "body":
            stack[:] = [x for x in stack if x[0] != "head"]
        while stack and stack[-1][0] in ends:
            stack.pop()
        if name not in _VOID and not attrs.endswith("/"):
            stack.append((name, " ".join(a or b or c for a, b, c in _CLASS.findall(attrs)).lower()))
    flush()
    return out


_TAGS = (
    "article main nav footer header aside form ul ol li table td section div p h1 h2 h3 h4 blockquote pre button figure "
    "figcaption head title dialog address details noscript"
).split()
_HINTS = {
    "menu": r"nav|menu|breadcrumb|toolbar|pagination|skip",
    "advert": r"\bads?\b|\bads?[-_]|[-_]ads?\b|advert|sponsor|promo|banner|outbrain|taboola",
    "notice": r"cookie|consent|notice|gdpr|popup|modal|alert|subscribe|newsletter|overlay|dialog",
    "comment": r"comment|repl(?:y|ies)|disqus|discussion|feedback",
    "side": r"sidebar|side-|widget|related|share|social|recommend|trending|popular|aside|more-",
    "foot": r"foot|copyright|legal|credits|colophon",
    "head": r"header|masthead|logo|branding|topbar|site-title",
    "form": r"form|search|login|signup|contact",
    "body": r"article|content|post|entry|story|\bmain\b|body|text|prose",
}
_HINT_RE = {k: re.compile(v) for k, v in _HINTS.items()}
_TEXT = 22
N_FEATURES = 1 + 2 * len(_TAGS) + 2 * len(_HINTS) + _TEXT


def _open_features(stack: tuple[tuple[str, str], ...]) -> list[int]:
    """Indices: open tags, the innermost tag, hints in any class, hints in the innermost class."""
    out = [0]
    names = {t for t, _ in stack}
    out += [1 + i for i, t in enumerate(_TAGS) if t in names]
    last = stack[-1][0] if stack else ""
    out += [1 + len(_TAGS) + i for i, t in enumerate(_TAGS) if t == last]
    at = 1 + 2 * len(_TAGS)
    every, own = " ".join(c for _, c in stack), next((c for _, c in reversed(stack) if c), "")
    out += [at + i for i, r in enumerate(_HINT_RE.values()) if r.search(every)]
    out += [at + len(_HINTS) + i for i, r in enumerate(_HINT_RE.values()) if r.search(own)]
    return out


def _text_features(b: Block, place: int, of: int) -> list[int]:
    n = len(b.text)
    at = N_FEATURES - _TEXT
    share = b.linked / max(n, 1)
    end = b.text[-1]
    out = [at + sum(n > k for k in (15, 40, 80, 160, 400)), at + 6 + sum(share > k for k in (0.0, 0.3, 0.7))]
    flags = (
        end in ".!?…\"”»:;", "©" in b.text or "(c)" in b.text[:8].lower(), b.text[0].isupper(), " " not in b.text,
        b.text.count(" ") < 4, any(c in b.text for c in ",.;"), b.text[0].isdigit(), "|" in b.text, "@" in b.text,
        place == 0, place * 5 < of, place * 5 >= 4 * of,
    )
    return out + [at + 10 + i for i, f in enumerate(flags) if f]


@dataclass
class Extractor:
    """Weights (features x 2) and transitions (2 x 2)."""

    weights: np.ndarray
    moves: np.ndarray
    _seen: dict = field(default_factory=dict, repr=False)

    def __getstate__(self) -> tuple[np.ndarray, np.ndarray]:
        return self.weights, self.moves

    def __setstate__(self, state: tuple[np.ndarray, np.ndarray]) -> None:
        self.weights, self.moves, self._seen = *state, {}

    def keep(self, found: list[Block]) -> list[bool]:
        """Viterbi: which blocks are main text."""
        gain = (self.weights[:, 1] - self.weights[:, 0]).tolist()
        (m00, m01), (m10, m11) = self.moves.tolist()
        back: list[tuple[int, int]] = []
        a = b = 0.0  # best scores that end in label 0 and 1; label 0 has no score of its own
        for i, x in enumerate(found):
            own = self._seen.get(x.open)
            if own is None:
                if len(self._seen) > 100_000:
                    self._seen.clear()
                own = self._seen[x.open] = sum(gain[k] for k in _open_features(x.open))
            own += sum(gain[k] for k in _text_features(x, i, len(found)))
            if i == 0:
                a, b = 0.0, own
                continue
            p, q = int(b + m10 > a + m00), int(b + m11 > a + m01)
            back.append((p, q))
            a, b = (b + m10 if p else a + m00), (b + m11 if q else a + m01) + own
        if not found:
            return []
        label = int(b > a)
        out = [label]
        for p, q in reversed(back):
            label = q if label else p
            out.append(label)
        return [bool(x) for x in reversed(out)]

    def text(self, page: str | None) -> str:
        found = blocks(page)
        return " ".join(x.text for x, k in zip(found, self.keep(found), strict=True) if k)


def train(pages: list[tuple[str, set[str]]], steps: int = 150, rate: float = 0.1) -> Extractor:
    """Maximum likelihood with a small quadratic penalty; forward-backward over all pages at once (Adam)."""
    found = [blocks(p) for p, _ in pages]
    most = max(map(len, found))
    x = np.zeros((len(pages), most, N_FEATURES), dtype=np.float32)
    y, mask = np.zeros((len(pages), most), dtype=np.int64), np.zeros((len(pages), most), dtype=bool)
    for i, (own, (_, main)) in enumerate(zip(found, pages, strict=True)):
        for j, b in enumerate(own):
            x[i, j, _open_features(b.open)] = 1
            x[i, j, _text_features(b, j, len(own))] = 1
            y[i, j], mask[i, j] = b.text in main and ("head", "") not in b.open, True
    gold = np.eye(2)[y] * mask[..., None]
    both = mask[:, 1:] & mask[:, :-1]
    moved = np.einsum("ija,ijb->ab", gold[:, :-1] * both[..., None], gold[:, 1:])
    flat = x.reshape(-1, N_FEATURES)
    theta = [np.zeros((N_FEATURES, 2)), np.zeros((2, 2))]
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    total = mask.sum()
    for step in range(1, steps + 1):
        weights, moves = theta
        unary = (flat @ weights).reshape(len(pages), most, 2)
        alpha, beta = np.zeros_like(unary), np.zeros_like(unary)
        alpha[:, 0] = unary[:, 0]
        for j in range(1, most):
            new = np.logaddexp(alpha[:, j - 1, :1] + moves[0], alpha[:, j - 1, 1:] + moves[1]) + unary[:, j]
            alpha[:, j] = np.where(mask[:, j, None], new, alpha[:, j - 1])
        for j in range(most - 2, -1, -1):
            ahead = beta[:, j + 1] + unary[:, j + 1]
            new = np.logaddexp(moves[:, 0] + ahead[:, :1], moves[:, 1] + ahead[:, 1:])
            beta[:, j] = np.where(mask[:, j + 1, None], new, 0)
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        p = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
        pair = alpha[:, :-1, :, None] + moves + (unary + beta)[:, 1:, None, :] - z[:, None, None, None]
        expected = (np.exp(np.minimum(pair, 0)) * both[..., None, None]).sum(axis=(0, 1))
        grads = [flat.T @ (gold - p).reshape(-1, 2) / total - 3e-4 * weights, (moved - expected) / total - 3e-4 * moves]
        for t, g, u, v in zip(theta, grads, first, second, strict=True):
            u += 0.1 * (g - u)
            v += 0.001 * (g * g - v)
            t += rate * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights, moves = theta
    return Extractor(weights, moves)


_SYLLABLES = "an ber che do en fi ga hel in ka lo mer no or pa que ri sta tion un ver wi xo yl za".split()


def labelled_pages(n: int = 360, seed: int = 11) -> list[tuple[str, set[str]]]:
    """Pages in varied layouts, each with the set of the texts of its main blocks."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(_SYLLABLES) for _ in range(rnd.randint(1, 4)))

    def words(lo: int, hi: int, end: str = "") -> str:
        return " ".join(word() for _ in range(rnd.randint(lo, hi))).capitalize() + end

    def sentences(lo: int, hi: int) -> str:
        return " ".join(words(3, 18, rnd.choice("...?!")) for _ in range(rnd.randint(lo, hi)))

    def junk() -> str:
        """A paragraph with signs between its words."""
        sign = rnd.choice([" | ", "### ", "*** ", " & "])
        return sign.join(words(1, 1, rnd.choice(["", "", "."])) for _ in range(rnd.randint(4, 60))).replace("&", "&amp;")

    def marked(tag: str, names: list[str], inner: str) -> str:
        name = rnd.choice(names)
        return f'<{tag} class="{name}">{inner}</{tag}>' if name else f"<{tag}>{inner}</{tag}>"

    def menu(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{word()}">{words(1, 2)}</a></li>' for _ in range(k)) + "</ul>"

    def aside_parts() -> list[str]:
        link = lambda: f'<a href="/{word()}">{words(2, 7)}</a>'
        return [
            marked("div", ["ad", "ads", "advert", "ad-slot", "sponsored", "promo banner"], rnd.choice([words(3, 9, "."), sentences(1, 2), "<p>" + sentences(1, 2) + "</p>"])),
            marked("div", ["cookie-notice", "consent", "gdpr-banner", "notice", "modal newsletter"], f"<p>{sentences(1, 3)}</p><button>{words(1, 2)}</button>"),
            marked("aside", ["sidebar", "", "widget", "related"], f"<h3>{words(1, 3)}</h3>" + rnd.choice([menu(4), f"<p>{sentences(1, 2)}</p>", f"<p>{link()}</p><p>{link()}</p>"])),
            marked("div", ["sidebar", "related-posts", "share social", "trending"], f"<h4>{words(1, 3)}</h4>{menu(3)}<p>{sentences(1, 2)}</p>"),
            f"<form action='/s'><label>{words(1, 2)}</label><p>{words(2, 6)}</p><input name='q'><button>{word()}</button></form>",
        ]

    def comments() -> str:
        each = "".join(f"<div class='{rnd.choice(['comment', 'comment-body', 'reply'])}'><p>{sentences(1, 3)}</p></div>" for _ in range(rnd.randint(1, 4)))
        return marked(rnd.choice(["section", "div"]), ["comments", "comment-list", "discussion", "disqus"], f"<h3>{words(1, 3)}</h3>{each}")

    def last() -> str:
        links = lambda: " | ".join(words(1, 2) for _ in range(rnd.randint(2, 5)))
        inner = rnd.choice([f"&copy; {word()}.com &middot; {words(3, 9, '.')}", f"&copy; {rnd.randint(1990, 2030)} {words(2, 6)}", sentences(1, 2), words(2, 6), links(), links()])
        shape = rnd.choice(["<footer>{}</footer>", "<footer class='site-footer'><div class='site-info'>{}</div></footer>", "<footer><p>{}</p></footer>", "<div class='footer'>{}</div>", "<div id='footer'><p>{}</p></div>", "<div class='bottom'>{}</div>", f"<div id='{word()}'><p>{{}}</p></div>"])
        return shape.format(inner)

    def themed(text: str) -> str:
        """The article within the frames of a theme, with its comments beside it in the same frame."""
        heading = rnd.choice(["", f"<header class='site-header'><p class='site-title'><a href='/'>{words(1, 3)}</a></p><nav class='main-navigation'>{menu(3)}</nav></header>"])
        replies = "".join(f"<li class='comment'><div class='{rnd.choice(['comment-content', 'comment-body'])}'><p>{sentences(1, 2)}</p></div></li>" for _ in range(rnd.randint(1, 3)))
        below = rnd.choice(["", f"<div class='comments-area'><h2 class='comments-title'>{words(1, 3)}</h2><ol class='comment-list'>{replies}</ol></div>"])
        inner = rnd.choice(["<main class='site-main'><article class='post'><div class='entry-content'>{}</div></article>{}</main>", "<div class='content-area'><div class='post'>{}</div>{}</div>", "<section role='main'>{}{}</section>", "<main><section>{}</section>{}</main>"])
        side = rnd.choice(["", f"<aside class='widget-area'><section class='widget'><h2>{words(1, 2)}</h2>{menu(3)}</section></aside>"])
        return f"{heading}<div class='site-content'>{inner.format(text, below)}{side}</div>"

    def table_layout(text: str) -> str:
        row = " | ".join(f'<a href="/{word()}">{words(1, 2)}</a>' for _ in range(rnd.randint(3, 6)))
        side = "<br>".join(f'<a href="/{word()}">{words(1, 3)}</a>' for _ in range(rnd.randint(2, 6)))
        end = rnd.choice([f"&copy; {rnd.randint(1990, 2030)} {words(2, 5)}", words(2, 6), " | ".join(words(1, 2) for _ in range(3))])
        return f"<table><tr><td>{row}</td></tr><tr><td>{side}</td><td>{text}</td></tr><tr><td>{end}</td></tr></table>"

    out = []
    for _ in range(n):
        main: set[str] = set()

        def keep(text: str) -> str:
            main.add(html.unescape(text))  # noqa: B023
            return text

        title, junky = words(1, 10, rnd.choice(["", "", "."])), rnd.random() < 0.08
        body = [f"<h1>{keep(title)}</h1>"] if rnd.random() < 0.85 else []
        for _ in range(rnd.randint(1, 9)):
            kind = rnd.random()
            if kind < 0.72:
                text = keep(junk() if junky or rnd.random() < 0.03 else rnd.choice([sentences(1, 2), sentences(2, 6), words(1, 3, "."), words(1, 12)]))
                body.append(rnd.choice([f"<p>{text}</p>", f"<p>{text}</p>", f"<p><b>{text}<br>", f"<div>{text}</div>", f"<p>{text}"]))
            elif kind < 0.8:
                body.append(f"<h2>{keep(words(1, 6))}</h2>")
            elif kind < 0.88:
                body.append("<ul>" + "".join(f"<li>{keep(words(2, 10, rnd.choice(['', '.'])))}</li>" for _ in range(rnd.randint(2, 5))) + "</ul>")
            elif kind < 0.93:
                body.append(f"<blockquote>{keep(sentences(1, 3))}</blockquote>")
            elif kind < 0.97:
                body.append(f"<pre>{keep(words(3, 9))}</pre>")
            else:
                body.append(f"<table><tr><td>{keep(words(1, 4))}</td><td>{keep(words(1, 4))}</td></tr></table>")
        if rnd.random() < 0.25:
            body.insert(rnd.randint(1, len(body)), rnd.choice(aside_parts()))
        if rnd.random() < 0.12:
            body.append(comments())
        if rnd.random() < 0.04:
            body.append(f"<noscript><p>{keep(sentences(1, 2))}</p></noscript>")
        text = "".join(body)
        wrap = rnd.random() * 1.25
        if wrap >= 1.1:
            text = themed(text)
        elif wrap >= 1:
            text = table_layout(text)
        elif wrap < 0.5:
            text = f"<article>{text}</article>"
        elif wrap < 0.65:
            text = f"<main>{text}</main>"
        elif wrap < 0.9:
            text = marked("div", ["content", "post-content", "article-body", "entry", "story main"], text)
        else:
            text = f"<div>{text}</div>"
        before, after = [], []
        if rnd.random() < 0.5:
            before.append(f"<header>{rnd.choice(['', f'<h1>{words(1, 2)}</h1>'])}<p>{words(1, 5)}</p></header>")
        if rnd.random() < 0.8:
            before.append(rnd.choice([f"<nav>{menu(rnd.randint(3, 8))}</nav>", f"<div class='menu'>{menu(5)}</div>", f"<div id='navbar'>{menu(4)}</div>"]))
        for part in aside_parts():
            if rnd.random() < 0.3:
                (before if rnd.random() < 0.5 else after).append(part)
        if rnd.random() < 0.35:
            after.append(comments())
        if rnd.random() < 0.1:
            (before if rnd.random() < 0.5 else after).append(f"<noscript>{sentences(1, 1)}</noscript>")
        if rnd.random() < 0.85:
            after.append(last())
        head = f"<head><title>{title}</title><style>p{{margin:0}}</style></head>" if rnd.random() < 0.9 else ""
        out.append((f"<!DOCTYPE html><html>{head}<body>{''.join(before)}{text}{''.join(after)}</body></html>", main))
    return out


def extract(pages: DataFrame, extractor: Extractor, column: str = "html", name: str = "text") -> DataFrame:
    """``pages`` with the column ``name`` in place of ``column``."""
    shared = pages.sparkSession.sparkContext.broadcast(extractor)
    return map_text(pages, column, lambda own: {name: [shared.value.text(x) for x in own]}, {name: "string"}, drop=[column])


def op7_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages, train(labelled_pages())).withColumn("n_chars", F.length("text").cast("long"))
