"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks, the stretches of text between the tags of block elements, each with the elements above it.
A block's features are those elements' names and the words of their class, id and role, and what its text looks like. The
field labels the blocks main or other; learnt transitions carry over from block to block, and Viterbi finds the best sequence.
It is trained on labelled pages that ``labelled_pages`` makes up from many layouts, not on the pages it is used on.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, raw

_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is no text of the page; those of the first kind hold raw text, in which tags are no tags.
_RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
_HIDDEN = _RAW | frozenset("head template svg math select datalist object audio video canvas map button noscript".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ENDS_P = _BLOCK - frozenset("body html head option caption".split())
#: Open elements that a start tag closes, and the elements that keep it from looking further up.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}
#: Where a comment ends; what is no tag at all ends at the next >.
_COMMENT_END = re.compile(r"--!?>")
_NAME = re.compile(r"[^\s/>]*+")
#: The attributes of a tag. Every repetition is possessive: nothing is ever read twice, whatever is left open.
_VALUE = r"""(?:"[^"]*+"?+|'[^']*+'?+|[^\s"'>][^\s>]*+)"""
_ATTRIBUTES = re.compile(rf"""(?:[\s/]++|(?:=[^\s/>=]*+|[^\s/>=]++)(?:\s*+=\s*+{_VALUE}?+)?+)*+""")
#: One attribute: its name and its whole value, so that nothing inside a value is taken for a name.
_ATTRIBUTE = re.compile(rf"""(=[^\s/>=]*+|[^\s/>=]++)(?:\s*+=\s*+({_VALUE}?+))?+""")
_NAMED = frozenset(("class", "id", "role", "aria-label"))
_PART = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+>?", re.I) for tag in _RAW}
#: Numeric references of more digits than any character has; unescape() would try to make a number of them.
_ZEROS, _HUGE = re.compile(r"&#([xX]?)0++(?=[0-9a-fA-F])"), re.compile(r"&#(?:[0-9]{8,}+|[xX][0-9a-fA-F]{7,}+);?+")


def decoded(text: str) -> str:
    """Character references decoded; one beyond Unicode is U+FFFD."""
    if "&" not in text:
        return text
    return unescape(_HUGE.sub("\ufffd", _ZEROS.sub(r"&#\1", text)) if "&#" in text else text)


@dataclass
class Block:
    text: str
    linked: int = 0  # characters inside links
    score: float = 0.0  # what the weights say of the elements above
    path: tuple[str, ...] = ()  # features of the elements above, where no weights were given
    label: int = -1


class _Open:
    """An open element, with what it takes to close it again."""

    __slots__ = ("tag", "hidden", "linked", "own", "score", "inside")

    def __init__(self, tag: str, hidden: bool, linked: bool, own: list[str], score: float, inside: float):
        self.tag, self.hidden, self.linked, self.own = tag, hidden, linked, own
        self.score, self.inside = score, inside  # of the elements up to this one


class _Tree:
    """The elements open at one point of a page.

    Opening, closing and looking for an element take time in proportion to its own attributes, not to the depth: places of
    open elements are kept by tag, and the features of the path by the number of elements that have them.
    """

    def __init__(self, weight: dict[str, float] | None):
        self.weight = weight
        self.stack: list[_Open] = []
        self.places: dict[str, list[int]] = {}  # of each tag
        self.blocks: list[int] = []  # places of block elements
        self.count: dict[str, int] = {}
        self.scopes: list[dict[str, int]] = []  # of each open article, the tags inside it

    @property
    def hidden(self) -> bool:
        return bool(self.stack) and self.stack[-1].hidden

    @property
    def linked(self) -> bool:
        return bool(self.stack) and self.stack[-1].linked

    def last(self, tag: str) -> int:
        """Place of the innermost open element of the name; -1 if there is none."""
        at = self.places.get(tag)
        return at[-1] if at else -1

    def first_above(self, tags: set[str], floor: int) -> int:
        """Place of the outermost open element of these names that lies inside the place floor; -1 if there is none."""
        found = [at[k] for t in tags if (at := self.places.get(t)) and (k := bisect_right(at, floor)) < len(at)]
        return min(found, default=-1)

    def open(self, tag: str, words: list[str], hidden: bool) -> None:
        get = (self.weight or {}).get
        top = self.stack[-1] if self.stack else None
        score, inside = (top.score, top.inside) if top else (0.0, 0.0)
        own = list(dict.fromkeys(words))
        if tag in _BLOCK:
            own.append(f"<{tag}")
            self.blocks.append(len(self.stack))
            if tag == "article":
                self.scopes.append({})
                inside = 0.0
            elif self.scopes:
                f, scope = f"article>{tag}", self.scopes[-1]
                if not scope.get(f):
                    inside += get(f, 0.0)
                scope[f] = scope.get(f, 0) + 1
        for f in own:
            if not self.count.get(f):
                score += get(f, 0.0)
            self.count[f] = self.count.get(f, 0) + 1
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append(_Open(tag, hidden or self.hidden, tag == "a" or self.linked, own, score, inside))

    def close(self, place: int) -> None:
        while len(self.stack) > place:
            x = self.stack.pop()
            self.places[x.tag].pop()
            for f in x.own:
                self.count[f] -= 1
                if not self.count[f]:
                    del self.count[f]
            if x.tag in _BLOCK:
                self.blocks.pop()
                if x.tag == "article":
                    self.scopes.pop()
                elif self.scopes:
                    scope, f = self.scopes[-1], f"article>{x.tag}"
                    scope[f] -= 1
                    if not scope[f]:
                        del scope[f]

    def block(self, text: str, linked: int) -> Block:
        innermost = f"in<{self.stack[self.blocks[-1]].tag}" if self.blocks else ""
        if self.weight is None:
            return Block(text, linked, path=tuple(sorted([*self.count, *(self.scopes[-1] if self.scopes else ()), *[innermost] * bool(innermost)])))
        top = self.stack[-1] if self.stack else None
        return Block(text, linked, (top.score + top.inside if top else 0.0) + self.weight.get(innermost, 0.0))


def leaf_blocks(html: str, weight: dict[str, float] | None = None) -> list[Block]:
    """The blocks with text, in page order: references decoded, white space inside turned into one space, trimmed.

    Each has the features of the elements above it or, given their weights, the sum of these. Tags are cut as browsers cut
    them; a tag that the page's end leaves open is dropped. The page is read once, from left to right.
    """
    tree, out = _Tree(weight), []
    buffer: list[str] = []
    linked = 0
    at, n = 0, len(html)

    def flush():
        nonlocal linked
        if buffer:
            text = _SPACE.sub(" ", decoded("".join(buffer))).strip()
            if text:
                out.append(tree.block(text, min(linked, len(text))))
            buffer.clear()
        linked = 0

    def close(place: int):
        if tree.blocks and tree.blocks[-1] >= place:
            flush()
        tree.close(place)

    while at < n:
        nxt = html.find("<", at)
        if nxt != at:
            nxt = n if nxt < 0 else nxt
            if not tree.hidden:
                buffer.append(html[at:nxt])
                if tree.linked:
                    linked += nxt - at
            at = nxt
            continue
        ends = html.startswith("</", at)
        name = _NAME.match(html, at + 1 + ends)
        if not (name.group()[:1].isascii() and name.group()[:1].isalpha()):
            if html.startswith("<!--", at):
                end = at + 4 if html.startswith(">", at + 4) else at + 5 if html.startswith("->", at + 4) else None
                m = None if end else _COMMENT_END.search(html, at + 4)
                at = end + 1 if end else m.end() if m else n
            elif html[at + 1 : at + 2] in ("!", "?", "/"):
                end = html.find(">", at)
                at = end + 1 if end >= 0 else n
            else:
                if not tree.hidden:
                    buffer.append("<")
                    linked += tree.linked
                at += 1
            continue
        tag = name.group().lower()
        inner = _ATTRIBUTES.match(html, name.end())
        at = inner.end() + 1
        if at > n:
            break  # the tag is left open
        if ends:
            if tag == "br":
                buffer.append(" ")
            elif (place := tree.last(tag)) >= 0 and (tag in _BLOCK or not tree.blocks or place > tree.blocks[-1]):
                close(place)  # a stray end tag of an inline element does not close blocks
            elif tag in _BLOCK:
                flush()
            continue
        if tag in ("br", "wbr", "img", "input"):
            if tag == "br":
                buffer.append(" ")
            continue
        if tag in _BLOCK:
            if tag in _ENDS_P and tree.blocks and tree.stack[tree.blocks[-1]].tag == "p":
                close(tree.blocks[-1])
            if tag in _CLOSES:
                closed, stops = _CLOSES[tag]
                place = tree.first_above(closed, max(map(tree.last, stops)))
                if place >= 0:
                    close(place)
            flush()
        if tag in _VOID:
            continue
        attributes = inner.group()
        if attributes.endswith("/") and tag in ("svg", "math", "path", "use"):
            continue
        words, gone = [], tag in _HIDDEN
        for key, value in _ATTRIBUTE.findall(attributes) if attributes else ():
            key = key.lower()
            if key == "hidden":
                gone = True
            elif key in _NAMED:
                words += [f".{x}" for x in _PART.findall(value.lower())]
        tree.open(tag, words, gone)
        if tag in _RAW:
            end = _RAW_END[tag].search(html, at)
            at = end.end() if end else n
            tree.close(len(tree.stack) - 1)
    flush()
    return out


#: What notices, adverts and the like say, by kind. A word between bars stands alone.
_CUES = {
    "rights": "©;(c);copyright;all rights reserved;tous droits;alle rechte;derechos reservados",
    "cookie": "cookie;gdpr;consent;privacy;datenschutz;confidentialité;privacidad",
    "share": "|share|;tweet;facebook;twitter;follow us;teilen;partager;compartir",
    "mail": "subscri;newsletter;sign up;sign in;log in;login;abonn;suscr;register",
    "more": "read more;related;see also;most read;popular;recommended;you may;weiterlesen;lire aussi;leer más",
    "ad": "advert;sponsor;promo;anzeige;publicit;publicidad;buy now",
    "reply": "|reply|;|comment|;|comments|;antwort;répondre;responder;kommentar;commentaire;comentario",
}
_DATE = re.compile(r"\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b|\b\d{4}-\d\d-\d\d\b")
#: Of each kind the texts one of which must be there, and the pattern that is counted then.
_CUE_TESTS = [(k, [x.strip("|") for x in c.split(";")], re.compile("|".join(re.escape(x.strip("|")).join((r"\b", r"\b") if x[0] == "|" else ("", "")) for x in c.split(";")))) for k, c in _CUES.items()]


def cues(text: str) -> dict[str, int]:
    """How often cues of each kind stand in the text."""
    low, out = text.lower(), {}
    for kind, literals, pattern in _CUE_TESTS:
        for x in literals:
            if x in low:
                if k := len(pattern.findall(low)):
                    out[kind] = k
                break
    if k := len(_DATE.findall(low)):
        out["date"] = k
    return out


def text_features(b: Block, i: int, n: int) -> list[str]:
    """Of the whole text, however long: its shape, and of each kind of cue that it comes and how thickly."""
    t = b.text
    words = t.count(" ") + 1
    share = b.linked / max(1, len(t))
    out = [f"w{min(7, words.bit_length())}", f"l{int(4 * share + 0.5)}", f"end{t[-1] in '.!?…:;' + chr(34) + '”»'}", f"cap{t[0].isupper()}", f"comma{min(2, t.count(','))}", f"stop{min(2, t.count('. '))}", f"bar{('|' in t) + ('·' in t) + ('»' in t) > 0}"]
    if i == 0:
        out.append("first")
    if i == n - 1:
        out.append("last")
    found = cues(t)
    for cue, k in found.items():
        out += (f"cue-{cue}", f"cue-{cue}-{min(4, (64 * k // words).bit_length() // 2)}")
    if found:
        out.append(f"cues{min(4, (64 * sum(found.values()) // words).bit_length() // 2)}")
    return out


@dataclass
class Model:
    weight: dict[str, float]  # what a feature adds to main less what it adds to other
    step: np.ndarray  # 2 x 2
    start: np.ndarray

    def viterbi(self, blocks: list[Block]) -> list[int]:
        """The best labels: 1 main, 0 other; other wins a tie. The blocks must have been scored with this model's weights."""
        (s00, s01), (s10, s11) = self.step.tolist()
        get, n, back = self.weight.get, len(blocks), []
        o, m = self.start.tolist()
        for i, b in enumerate(blocks):
            x = b.score + sum([get(f, 0.0) for f in text_features(b, i, n)])
            if i:
                from_o, from_m = o + s01 > m + s11, o + s00 >= m + s10
                back.append((0 if from_m else 1, 0 if from_o else 1))
                o, m = (o + s00 if from_m else m + s10), (o + s01 if from_o else m + s11)
            m += x
        if not n:
            return []
        label = [int(m > o)]
        for step in reversed(back):
            label.append(step[label[-1]])
        return label[::-1]


def extract(html: str, model: Model) -> str:
    blocks = leaf_blocks(html, model.weight)
    return "\n\n".join(b.text for b, y in zip(blocks, model.viterbi(blocks), strict=True) if y)


def main_text(pages: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row.

    A null or empty page has the empty text; a null page_id or url stays null. Repeated rows each get their row, an empty table
    gives none, other columns are ignored whatever their names. Time and memory are in proportion to a page's length, also for
    tags that are never closed and elements nested to any depth; a very long page is a slice of its own.
    """
    spark = pages.sparkSession
    sent = spark.sparkContext.broadcast(model or default_model())
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"), F.col(url_col).alias("url"))
    kinds = dict(rows.dtypes)

    def run(batches):
        m = sent.value
        for b in pieces(batches, "html"):
            texts = [extract(x.decode("utf-8", "replace"), m) if x else "" for x in raw(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")


_MODEL: list[Model] = []


def default_model() -> Model:
    """The model of the default training pages, trained once in a process."""
    if not _MODEL:
        from .html_pages import labelled_pages

        _MODEL.append(train(labelled_pages()))
    return _MODEL[0]


def train(pages: list[list[Block]], epochs: int = 10, rate: float = 0.5, l2: float = 2e-5, seed: int = 3) -> Model:
    """Maximum likelihood of labelled pages by Adagrad, gradients by forward-backward."""
    rng = np.random.default_rng(seed)
    index: dict[str, int] = {}
    coded = []
    for blocks in pages:
        feats = [[index.setdefault(f, len(index)) for f in [*b.path, *sorted(text_features(b, i, len(blocks)))]] for i, b in enumerate(blocks)]
        if blocks:
            coded.append((np.array([x for f in feats for x in f]), np.array([len(f) for f in feats]), np.array([b.label for b in blocks])))
    w, step, start = np.zeros(len(index)), np.zeros((2, 2)), np.zeros(2)
    gw, gs, g0 = np.full(len(w), 1e-8), np.full((2, 2), 1e-8), np.full(2, 1e-8)
    for _ in range(epochs):
        for p in rng.permutation(len(coded)).tolist():
            ids, n, y = coded[p]
            x = np.add.reduceat(w[ids], np.cumsum(n) - n)
            t = len(y)
            f, b = np.zeros((t, 2)), np.zeros((t, 2))
            score = np.stack((np.zeros(t), x), 1)
            f[0] = start + score[0]
            for i in range(1, t):
                z = f[i - 1][:, None] + step
                f[i] = np.logaddexp(z[0], z[1]) + score[i]
            for i in range(t - 2, -1, -1):
                z = step + score[i + 1] + b[i + 1]
                b[i] = np.logaddexp(z[:, 0], z[:, 1])
            total = np.logaddexp(*f[-1])
            prob = np.exp(f + b - total)
            d = prob[:, 1] - y
            g = np.bincount(ids, np.repeat(d, n), len(w)) if t else 0
            some = np.unique(ids)
            g = g[some] + l2 * w[some]
            gw[some] += g**2
            w[some] -= rate * g / np.sqrt(gw[some])
            pairs = np.exp(f[:-1, :, None] + step + (score[1:] + b[1:])[:, None, :] - total).sum(0) if t > 1 else np.zeros((2, 2))
            np.add.at(pairs, (y[:-1], y[1:]), -1)
            gs += pairs**2
            step -= 0.5 * rate * pairs / np.sqrt(gs)
            first = prob[0] - np.eye(2)[y[0]]
            g0 += first**2
            start -= 0.5 * rate * first / np.sqrt(g0)
    return Model({f: float(w[i]) for f, i in index.items()}, step, start)
