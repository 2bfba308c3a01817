"""Main text of HTML pages by a linear-chain conditional random field over leaf blocks.

A page is parsed to its leaf blocks: runs of text inside the innermost block elements, in
page order, with character references decoded and white space made even.  Scripts,
styles and comments give no block.  Each block has features of all its ancestors' tags, of
their class, id and role words, and of its own text and its neighbours'; the field tags
it as main text or not, and Viterbi decoding takes the most probable labels of a page.

The pages have no labels, so the field is trained on labelled pages made here
(``labelled_pages``): pages of many layouts from a fixed random seed, whose blocks know
what they are.  Training takes about a second and gives the same model everywhere.

Null and empty pages and pages without main text give an empty text.  Pages are taken
one by one: repeated rows get equal results, a null page_id or url is kept, further
columns are left out whatever their names, an empty table gives an empty result.  No page
fails: broken and unclosed markup is read as browsers do in the cases that matter here (a
new block closes a paragraph, an unknown end tag is ignored, ``<!`` and ``<?`` open a
comment up to the next ``>``, what is open at the page's end is closed or left out).  A
very long or deep page takes time and memory in proportion to its length.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict
from collections.abc import Collection, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm import crf
from cloakframe.llm.scratch import configure

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template noscript svg canvas iframe object math head title".split())
#: Elements that begin a block of their own.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead tr ul".split()
)
#: Elements whose start ends an open element of these names.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that an implied end does not reach beyond.
SCOPE = frozenset("ul ol dl table html body".split())
SEED = 11
#: Elements that a paragraph does not end beyond.
_P_SCOPE = SCOPE | {"td", "th", "button"}
_COMMENT_END = re.compile(r"--!?>")
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[a-z]+")


#: Innermost block element and feature names of all ancestors, text, letters inside links.
Block = tuple[tuple[str, frozenset[str]], str, int]


class _Blocks(HTMLParser):
    """Collects the leaf blocks of a page fed at once.

    Each open element holds the feature names of itself and all elements around it, and
    shares them with the one outside where it adds none.  ``known`` leaves out names that
    the field has no weight for, so there are only so many sets that differ on a way inwards.  Open
    elements are found by name, so a page takes time and memory in proportion to its
    length, however deep it nests.
    """

    def __init__(self, known: Collection[str] | None = None) -> None:
        super().__init__(convert_charrefs=True)
        self.known = known
        self.stack: list[tuple[str, frozenset[str]]] = []
        self.places: defaultdict[str, list[int]] = defaultdict(list)
        self.outer: list[int] = []
        self.found: list[Block] = []
        self.text: list[str] = []
        self.linked = 0
        self.silent = 0

    # Declarations and comments end as in browsers; the page's end closes whatever is open.

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i, report)

    def parse_bogus_comment(self, i: int, report: int = 1) -> int:
        return self.rawdata.find(">", i + 2) + 1 or len(self.rawdata)

    def parse_comment(self, i: int, report: int = 1) -> int:
        if self.rawdata.startswith(("<!-->", "<!--->"), i):
            return self.rawdata.index(">", i) + 1
        m = _COMMENT_END.search(self.rawdata, i + 4)
        return m.end() if m else len(self.rawdata)

    def parse_pi(self, i: int) -> int:
        return self.parse_bogus_comment(i)

    def parse_html_declaration(self, i: int) -> int:
        return self.parse_bogus_comment(i)

    def parse_starttag(self, i: int) -> int:
        k = super().parse_starttag(i)
        return self.parse_bogus_comment(i) if k < 0 else k

    def parse_endtag(self, i: int) -> int:
        k = super().parse_endtag(i) if self.rawdata.find(">", i + 1) >= 0 else len(self.rawdata)
        return self.parse_bogus_comment(i) if k < 0 else k

    def flush(self) -> None:
        if self.text:
            t = _SPACE.sub(" ", "".join(self.text)).strip()
            if t:
                own = self.stack[self.outer[-1]][0] if self.outer else "none"
                self.found.append(((own, self.stack[-1][1] if self.stack else frozenset()), t, self.linked))
        self.text, self.linked = [], 0

    def _innermost(self, names: set[str] | frozenset[str]) -> int:
        """Place of the innermost open element of these names, or -1."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def _close(self, names: set[str] | frozenset[str], scope: frozenset[str]) -> None:
        i = self._innermost(names)
        if i > self._innermost(scope):
            self.flush()
            self._drop(i)

    def _drop(self, i: int) -> None:
        for tag, _ in self.stack[i:]:
            self.silent -= tag in SILENT
            self.places[tag].pop()
        while self.outer and self.outer[-1] >= i:
            self.outer.pop()
        del self.stack[i:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.silent and tag == "body":  # a head or title left open
            self._drop(min(self.places[n][0] for n in SILENT if self.places.get(n)))
        if tag in BLOCK:
            self.flush()
            self._close({"p"}, _P_SCOPE)
        if tag in ENDS:
            self._close(ENDS[tag], SCOPE)
        if tag in VOID:
            if tag == "br":
                self.text.append(" ")
            return
        words: list[str] = []
        for k, v in attrs:
            if k in ("class", "id", "role", "itemprop", "aria-label") and v:
                words += _WORDS.findall(v.lower())
            elif k == "hidden":
                words.append("hidden")
        if tag in BLOCK:
            self.outer.append(len(self.stack))
        self.places[tag].append(len(self.stack))
        around = self.stack[-1][1] if self.stack else frozenset()
        new = {x for x in (f"in={tag}", *(f"w={w}" for w in words)) if x not in around and (self.known is None or x in self.known)}
        self.stack.append((tag, around | new if new else around))
        self.silent += tag in SILENT

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        if self.places.get(tag):
            self._drop(self.places[tag][-1])

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.text.append(data)
            if self.places.get("a"):
                self.linked += len(data.strip())


def blocks(html: str, known: Collection[str] | None = None) -> list[Block]:
    """Leaf blocks of a page in order, with those names of their ancestors that are ``known``."""
    p = _Blocks(known)
    p.feed(html)
    p.close()
    p.flush()
    return p.found


def _shape(text: str) -> list[str]:
    n = len(text)
    stops = text.count(".") + text.count("!") + text.count("?") + text.count("。")
    out = [f"len{min(8, n.bit_length())}", f"stops{min(3, stops)}"]
    if text[-1] in ".!?:\"'”»。":
        out.append("closed")
    if text[0] in "©®" or "©" in text or "All rights reserved" in text:
        out.append("copyright")
    if text[:1].isdigit():
        out.append("digit")
    if sum(c in "|·•›»→" for c in text):
        out.append("separators")
    return out


def features(found: list[Block]) -> Iterator[list[str]]:
    """Feature names of each block, one after another."""
    shapes = [_shape(t) for _, t, _ in found]
    own_tags = [own for (own, _), _, _ in found]
    for i, ((_, names), text, linked) in enumerate(found):
        f = [f"own={own_tags[i]}", *(f"s={x}" for x in shapes[i]), f"tag={own_tags[i]}&len{min(8, len(text).bit_length())}"]
        share = linked / max(1, len(text))
        f.append("linked" if share > 0.6 else "some links" if share > 0.15 else "unlinked")
        f += sorted(names)
        f.append(f"before={own_tags[i - 1]}" if i else "first")
        f.append(f"after={own_tags[i + 1]}" if i + 1 < len(found) else "last")
        yield f


# -- labelled pages -----------------------------------------------------------

#: Words in class and id attributes of layouts, fixed values.
MAIN_WORDS = "content article post entry body main story text page single".split()
SIDE_WORDS = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topbar links pagination pager toc".split(),
    "header": "header masthead banner logo branding hero top".split(),
    "footer": "footer bottom copyright legal credits colophon".split(),
    "aside": "sidebar aside widget related recommended trending popular rail secondary".split(),
    "notice": "cookie consent notice notification alert gdpr popup modal overlay newsletter subscribe signup promo".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promoted banner adsbygoogle".split(),
    "form": "form search login signup contact subscribe newsletter".split(),
    "comments": "comments comment replies reply discussion disqus responses thread reader".split(),
    "share": "share social sharing meta byline tags author toolbar".split(),
}


class _Maker:
    """Makes one page and the labels of its blocks."""

    def __init__(self, rng: random.Random) -> None:
        self.rng, self.out, self.labels = rng, [], []
        self.letters = [rng.choice(["en", "th", "er", "la", "ou", "ch", "ung", "ción", "mi", "st", "re", "é", "ö"]) for _ in range(10)]

    def word(self) -> str:
        return "".join(self.rng.choices(self.letters, k=self.rng.randint(1, 3)))

    def sentence(self, low: int = 4, high: int = 18) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(low, high))).capitalize() + self.rng.choice([".", ".", ".", "!", "?"])

    def prose(self, low: int = 1, high: int = 6) -> str:
        r = self.rng.random()
        if r < 0.12:  # a short paragraph
            return self.sentence(1, 5)
        t = " ".join(self.sentence() for _ in range(self.rng.randint(low, high)))
        if self.rng.random() < 0.2:
            w = t.split(" ")
            k = self.rng.randrange(len(w))
            w[k] = f"<{self.rng.choice(['b', 'em', 'i', 'strong', 'code'])}>{w[k]}" + ("" if self.rng.random() < 0.15 else "</b>")
            t = " ".join(w)
        if self.rng.random() < 0.2:
            w = t.split(" ")
            k = self.rng.randrange(len(w))
            w[k] = f'<a href="/{self.word()}">{w[k]}</a>'
            t = " ".join(w)
        return t

    def block(self, tag: str, text: str, main: bool, attrs: str = "", open_: bool = False) -> None:
        self.out.append(f"<{tag}{attrs}>{text}" + ("" if open_ else f"</{tag}>"))
        self.labels.append(main)

    def attrs(self, kind: str, often: float) -> str:
        if self.rng.random() > often:
            return ""
        w = self.rng.choice(SIDE_WORDS[kind] if kind in SIDE_WORDS else MAIN_WORDS)
        if self.rng.random() < 0.3:
            w += self.rng.choice(["-box", "-wrapper", "-1", " clearfix", "_area"])
        return f' {self.rng.choice(["class", "class", "id"])}="{w}"'

    def side(self, kind: str) -> None:
        rng = self.rng
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind, "div")
        plain = tag != "div" and rng.random() < 0.6
        if not plain:
            tag = "form" if kind == "form" else rng.choice(["div", "div", "section", "ul" if kind == "nav" else "div"])
        self.out.append(f"<{tag}{self.attrs(kind, 0.4 if plain else 1.0)}>")
        if kind == "nav":
            if tag != "ul":
                self.out.append("<ul>")
            for _ in range(rng.randint(2, 8)):
                self.block("li", f'<a href="/{self.word()}">{self.word()}</a>', False)
            if tag != "ul":
                self.out.append("</ul>")
        elif kind == "header":
            self.block(rng.choice(["div", "p", "h1", "h2", "span"]) if tag != "ul" else "li", self.sentence(1, 4), False) if rng.random() < 0.8 else None
            if rng.random() < 0.4:
                self.side("nav")
        elif kind == "footer":
            if rng.random() < 0.5:  # text right inside
                self.out.append(rng.choice(["&copy; ", "© 2024 "]) + self.sentence(2, 9))
                self.labels.append(False)
            else:
                for _ in range(rng.randint(1, 3)):
                    self.block(rng.choice(["p", "div"]), rng.choice(["&copy; ", "", ""]) + self.sentence(2, 9), False)
        elif kind in ("ad", "notice", "share"):
            if rng.random() < 0.55:
                self.out.append(self.sentence(1, 12) + (" " + self.sentence() if rng.random() < 0.4 else ""))
                self.labels.append(False)
            else:
                for _ in range(rng.randint(1, 3)):
                    self.block(rng.choice(["p", "div", "h4"]), self.prose(1, 2), False)
                if kind == "notice" and rng.random() < 0.5:
                    self.block("button", self.word(), False)
        elif kind == "form":
            if rng.random() < 0.5:
                self.block("p", self.sentence(1, 5), False)
            self.out.append('<input name="q">')
            self.block("button", self.word(), False)
        elif kind == "aside":
            self.block(rng.choice(["h2", "h3", "h4"]), self.sentence(1, 3), False)
            for _ in range(rng.randint(1, 4)):
                self.block("p", self.prose(1, 2), False)
        elif kind == "comments":
            self.block(rng.choice(["h2", "h3"]), self.sentence(1, 3), False)
            for _ in range(rng.randint(1, 5)):
                self.out.append("<div>" if rng.random() < 0.6 else '<div class="comment">')
                if rng.random() < 0.5:
                    self.block("p", self.word(), False)
                self.block("p", self.prose(1, 4), False)
                self.out.append("</div>")
        self.out.append(f"</{tag}>")

    def main(self) -> None:
        rng = self.rng
        shell = rng.choices(["article", "main", "div", "section", "td", "none"], [5, 3, 4, 1, 1, 1])[0]
        if shell == "td":
            self.out.append("<table><tr><td>")
        elif shell != "none":
            self.out.append(f"<{shell}{self.attrs('main', 0.4 if shell in ('article', 'main') else 1.0)}>")
        if rng.random() < 0.85:
            self.block("h1", self.sentence(2, 12), True)
        if rng.random() < 0.12:
            self.side("share")
        for _ in range(rng.choice([1, 2, 4, 6, 9, 14])):
            r = rng.random()
            if r < 0.06:
                self.block(rng.choice(["h2", "h3"]), self.sentence(1, 6)[:-1], True)
            elif r < 0.11:
                self.out.append("<ul>")
                for _ in range(rng.randint(2, 5)):
                    self.block("li", self.sentence(1, 12), True)
                self.out.append("</ul>")
            elif r < 0.15:
                self.block(rng.choice(["blockquote", "pre", "div", "figcaption"]), self.prose(1, 3), True)
            elif r < 0.19:
                self.side(rng.choice(["ad", "ad", "aside", "notice", "form"]))
            elif r < 0.27:  # markup left open
                self.block("p", "<b>" + self.sentence() + "<br>", True, open_=True)
            else:
                self.block("p", self.prose(), True, open_=rng.random() < 0.05)
        if rng.random() < 0.1:
            self.side("share")
        if rng.random() < 0.12:
            self.side("comments")
        if shell == "td":
            self.out.append("</td></tr></table>")
        elif shell != "none":
            self.out.append(f"</{shell}>")

    def page(self) -> tuple[str, list[bool]]:
        rng = self.rng
        self.out.append("<!DOCTYPE html><html><head><title>x</title><style>p{}</style><script>var a='<p>b</p>';</script></head><body>")
        wrapped = rng.random() < 0.3
        if wrapped:
            self.out.append(f'<div class="{rng.choice(["wrapper", "container", "site", "row", "layout"])}">')
        before = ["header", "nav", "notice", "ad", "form", "aside"]
        after = ["comments", "aside", "ad", "form", "notice", "nav", "footer"]
        for k in before:
            if rng.random() < {"nav": 0.8, "header": 0.4}.get(k, 0.22):
                self.side(k)
        self.main()
        for k in after:
            if rng.random() < {"footer": 0.85, "comments": 0.3, "aside": 0.3}.get(k, 0.18):
                self.side(k)
        if wrapped:
            self.out.append("</div>")
        if rng.random() < 0.9:
            self.out.append("</body></html>")
        return "".join(self.out), self.labels


def labelled_pages(n: int, seed: int = SEED) -> list[tuple[str, list[bool]]]:
    """``n`` pages with the label of each leaf block: whether it is main text."""
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        html, labels = _Maker(rng).page()
        if len(blocks(html)) == len(labels):  # broken markup may join blocks
            out.append((html, labels))
    return out


_MODELS: dict[tuple[int, int], crf.Model] = {}


def train(n: int = 800, seed: int = SEED) -> crf.Model:
    """The field fitted to ``labelled_pages(n, seed)``."""
    if (n, seed) in _MODELS:
        return _MODELS[n, seed]
    pages = labelled_pages(n, seed)
    names: dict[str, int] = {}
    rows = [list(features(blocks(h))) for h, _ in pages]
    lengths = np.array([len(r) for r in rows], np.int64)
    shape = (int(lengths.max()), len(rows))
    labels = np.zeros(shape)
    place, flat, offsets = [], [], []
    for j, (r, (_, y)) in enumerate(zip(rows, pages, strict=True)):
        labels[: len(y), j] = y
        for t, f in enumerate(r):
            place.append(t * shape[1] + j)
            offsets.append(len(flat))
            flat += [names.setdefault(x, len(names)) for x in f]
    theta, bias, chain = crf.fit(np.array(flat), np.array(offsets), np.array(place), shape, lengths, labels, np.ones(shape[1]), len(names), rounds=150, ridge=0.05)
    _MODELS[n, seed] = crf.Model({f: float(theta[i]) for f, i in names.items()}, bias, chain)
    return _MODELS[n, seed]


def main_text(pages: list[str], model: crf.Model) -> list[str]:
    """Main text of each page: its main blocks, joined by empty lines."""
    found = [blocks(p, model.weights) for p in pages]
    get = model.weights.get
    scores = [np.array([model.bias + sum(get(f, 0.0) for f in fs) for fs in features(b)]) for b in found]
    lengths = np.array([len(s) for s in scores], np.int64)
    out = [""] * len(pages)
    for part in crf.batches(lengths, 1 << 18):
        own = lengths[part]
        if not own[0]:
            continue
        grid = np.zeros((own[0], len(part)))
        for j, k in enumerate(part.tolist()):
            grid[: own[j], j] = scores[k]
        y = crf.decode(grid, own, model.chain)
        for j, k in enumerate(part.tolist()):
            out[k] = "\n\n".join(t for (_, t, _), on in zip(found[k], y[: own[j], j], strict=True) if on)
    return out


def extract(pages: DataFrame, model: crf.Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages`` (page_id, url, html, ...)."""
    configure(pages.sparkSession)
    fitted = model or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            html = [x or "" for x in b.column(2).to_pylist()]
            text: list[str] = []
            for at in range(0, len(html), 256):
                text += main_text(html[at : at + 256], fitted)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    cols = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return cols.mapInArrow(run, "page_id long, url string, text string, n_chars long")
