"""Operator 7: main text of web pages by a linear-chain conditional random field.

A page is cut into leaf blocks: the text between two tags that break lines, with the
elements that it lies in. A chain over the blocks in page order labels each as main text or
not: a weight a feature (ancestor tags, parts of their class, id and role names, text
length, link density, punctuation) and a weight for each pair of neighbouring labels. The
weights are trained by gradient ascent on the likelihood of labelled pages, with
forward-backward sums; Viterbi's best path decides.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element names.
DROPPED = "script style textarea title".split()  # their content is no markup
CONTROLS = frozenset("noscript template iframe select button canvas object audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split()) | frozenset("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mprescripts semantics".split())
#: Break no line, but part words.
PARTING = frozenset("br mtable mtr mtd annotation annotation-xml svg g path rect circle ellipse line polyline polygon text tspan textpath defs use symbol marker lineargradient radialgradient stop clippath mask filter pattern image desc switch animate animatetransform set".split())

_OPENS = re.compile(r"<!--|<!\[CDATA\[|<(" + "|".join(DROPPED) + r")(?=[\s/>])", re.I)
_CLOSES = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in DROPPED}
_CONTROL = re.compile(r"<(/?)(" + "|".join(sorted(CONTROLS)) + r")(?=[\s/>])((?:[^>\"'<]|\"[^\"<]*\"|'[^'<]*')*+)>", re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/><]*)((?:[^>\"'<]|\"[^\"<]*\"|'[^'<]*')*+)>|<(/?)([a-zA-Z][^\s/><]*)()[^>]*>|<[!?][^>]*>")
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+))|(hidden|display:\s*none|aria-hidden)", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_ANY_TAG = re.compile(r"<[^>]*>")
_SPACE = re.compile(r"\s+")


class Node:
    """An open element under those around it; `new` are the features that its path has and theirs have not."""

    __slots__ = ("up", "element", "new", "inside", "holder", "weight")

    def __init__(self, up: Node | None, element: str, new: tuple[str, ...]):
        self.up, self.element, self.new, self.weight = up, element, new, None
        tag = element.partition(" ")[0]
        self.inside = tag in ("article", "main") or (up is not None and up.inside)
        self.holder = element.startswith(("article", "main")) or (up is not None and up.holder)


@dataclass
class Block:
    node: Node | None  # paths are links to the element around, as copies of them would grow with their square
    text: str
    linked: int  # characters within links

    @property
    def path(self) -> tuple[str, ...]:
        out, node = [], self.node
        while node is not None:
            out.append(node.element)
            node = node.up
        return tuple(reversed(out))


@lru_cache(1 << 14)
def _own_features(element: str) -> tuple[str, ...]:
    tag, *names = element.split(" ")
    return (f"in {tag}", *(f"name {w}" for w in names))


def _element(tag: str, attributes: str) -> str:
    """tag, with the parts of its class, id and role names."""
    if not attributes or attributes.isspace():
        return tag
    parts = set()
    for m in _NAMES.finditer(attributes):
        if m[4]:
            parts.add("hidden")
        else:
            parts.update(p.lower() for p in _PART.findall(m[1] or m[2] or m[3] or ""))
    return " ".join([tag, *sorted(parts)])


def _closed_controls(page: str) -> set[int]:
    """Where the controls start that hold text and whose end is the next tag of their name; others end nothing and hold nothing."""
    waiting: dict[str, tuple[int, int]] = {}
    found = set()
    for m in _CONTROL.finditer(page, 0, page.rfind(">") + 1):
        tag = m[2].lower()
        if not m[1]:
            waiting.pop(tag, None)
            if not m[3].endswith("/"):
                waiting[tag] = m.span()
        elif tag in waiting:
            start, inner = waiting.pop(tag)
            last = page.rfind(">", inner, m.start()) + 1  # no tag ends after it
            if last <= inner:
                last = inner
            if page[last : m.start()].strip() or _ANY_TAG.sub("", page[inner:last]).strip():
                found.add(start)
    return found


def _without_dropped(page: str) -> str:
    """The page without comments, character data sections and elements whose content is no markup; one pass, whatever is left open."""
    out, at, last = [], 0, page.rfind(">")
    while m := _OPENS.search(page, at):
        if m[1] is None:
            mark = "-->" if page[m.end() - 1] == "-" else "]]>"
            end, instead = page.find(mark, m.end()), ""
            end = len(page) if end < 0 else end + 3
        elif m.end() > last:  # no tag ends any more
            out.append(page[at : m.end()])
            at = m.end()
            continue
        else:
            end, instead = page.index(">", m.end()) + 1, " "
            if page[end - 2] != "/":
                close = _CLOSES[m[1].lower()].search(page, end, last + 1)
                end = close.end() if close else len(page)
        out += [page[at : m.start()], instead]
        at = end
    return "".join(out) + page[at:]


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order, white space and character references resolved; blank ones are left out.

    Linear in the page's length, whatever is nested or left open in it.
    """
    out: list[Block] = []
    nodes: list[Node] = []  # open elements that break lines
    tags: list[str] = []
    open_at: dict[str, list[int]] = {}  # places of a tag's open elements
    seen: set[str] = set()  # features of the path
    pieces: list[str] = []
    links = linked = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = "".join(pieces)
            pieces.clear()
            if "&" in text:
                text = html.unescape(text)
            text = _SPACE.sub(" ", text).strip()
            if text:
                out.append(Block(nodes[-1] if nodes else None, text, linked))
        linked = 0

    def cut(i: int) -> None:
        while len(tags) > i:
            open_at[tags.pop()].pop()
            seen.difference_update(nodes.pop().new)

    def last(tag: str) -> int:
        places = open_at.get(tag)
        return places[-1] if places else -1

    def close(tag: str, within: tuple[str, ...] = ()) -> None:
        i = last(tag)
        if i >= 0 and all(last(w) < i for w in within):
            cut(i)

    page = _without_dropped(page)
    closed = _closed_controls(page)
    at = 0
    for m in _TAG.finditer(page, 0, page.rfind(">") + 1):
        if m.start() > at:
            piece = page[at : m.start()]
            pieces.append(piece)
            if links:
                linked += len(piece)
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, end = name.lower(), bool(m[1] or m[4])
        if tag in INLINE:
            if tag == "a":
                links = max(0, links - 1) if end else 1
            continue
        if tag in PARTING or tag in CONTROLS and (last(tag) < 0 if end else m.start() not in closed):
            pieces.append(" ")
            continue
        flush()
        if tag in VOID:
            continue
        if end:
            close(tag)
            links = 0
            continue
        if tags and tags[-1] == "p" and tag not in CONTROLS:
            cut(len(tags) - 1)
        if tag == "li":
            close("li", ("ul", "ol"))
        elif tag in ("td", "th"):
            close("td", ("tr", "table"))
            close("th", ("tr", "table"))
        elif tag == "tr":
            close("tr", ("table",))
        elif tag in ("dt", "dd"):
            close("dt", ("dl",))
            close("dd", ("dl",))
        element = _element(tag, m[3] or "")
        new = tuple(f for f in _own_features(element) if f not in seen)
        seen.update(new)
        open_at.setdefault(tag, []).append(len(tags))
        tags.append(tag)
        nodes.append(Node(nodes[-1] if nodes else None, element, new))
    if at < len(page):
        pieces.append(page[at:])
    flush()
    return out


def path_features(path: tuple[str, ...], holder: bool) -> list[str]:
    names = [p.split(" ") for p in path]
    inside = {n[0] for n in names}
    out = {f"in {t}" for t in inside} | {f"name {w}" for n in names for w in n[1:]}
    out.add(f"parent {names[-1][0] if names else '-'}")
    if holder and not inside & {"article", "main"}:
        out.add("outside the article")
    if not holder:
        out.add("no article")
    return sorted(out)


def text_features(b: Block) -> tuple[str, ...]:
    t = b.text
    n = t.count(" ") + 1
    size = min(n.bit_length(), 8)
    dense = b.linked / len(t)
    links = "none" if not b.linked else "some" if dense < 0.3 else "many" if dense < 0.8 else "all"
    ends = "stop" if t[-1] in ".!?…:;\"”»)" else "open"
    return (f"words {size}", f"links {links}", f"ends {ends}", f"words {size} ends {ends}", f"links {links} words {min(size, 4)}", f"commas {min(t.count(','), 2)}", "copyright" if "©" in t else "no copyright", "digits" if sum(map(str.isdigit, t[:200])) * 5 > min(len(t), 200) else "no digits")


def _has_holder(page: list[Block]) -> bool:
    return any(b.node is not None and b.node.holder for b in page)


@dataclass
class Model:
    weights: dict[str, float]  # of a feature for main text against not
    move: np.ndarray  # [label before, label]
    start: np.ndarray


def fit(pages: list[list[tuple[str, int]]], steps: int = 150, rate: float = 0.15, decay: float = 1e-3) -> Model:
    """A model of labelled pages, each a list of html pieces with 1: main text, 0: not, 2: no text of its own."""
    rows, truth = [], []
    for pieces in pages:
        known = "".join(f"{p}\x02{y}" if y < 2 else p for p, y in pieces)
        # each labelled piece is followed by a mark that names the label of the blocks before it
        found, labels, waiting = [], [], []
        for b in blocks(known):
            parts = b.text.split("\x02")
            text = parts[0] + "".join(p[1:] for p in parts[1:])
            marks = [int(p[0]) for p in parts[1:]]
            text = _SPACE.sub(" ", text).strip()
            if text:
                found.append(Block(b.node, text, min(b.linked, len(text))))
                waiting.append(len(found) - 1)
                labels.append(-1)
            if marks:
                for i in waiting:
                    labels[i] = marks[0]
                waiting = []
        if found:
            holder = _has_holder(found)
            rows.append([[*path_features(b.path, holder), *text_features(b)] for b in found])
            truth.append([max(y, 0) for y in labels])
    names = {f: i for i, f in enumerate(sorted({f for page in rows for b in page for f in b}))}
    n, longest = len(rows), max(map(len, rows))
    real = np.zeros((n, longest), bool)
    y = np.zeros((n, longest), int)
    at, feature = [], []
    for i, page in enumerate(rows):
        real[i, : len(page)], y[i, : len(page)] = True, truth[i]
        for t, b in enumerate(page):
            at += [i * longest + t] * len(b)
            feature += [names[f] for f in b]
    at, feature = np.array(at), np.array(feature)
    w, move, start = np.zeros(len(names)), np.zeros((2, 2)), np.zeros(2)
    state = [np.zeros((2, p.size)) for p in (w, move, start)]
    last = real.sum(1) - 1
    for step in range(1, steps + 1):
        e = np.bincount(at, w[feature], n * longest).reshape(n, longest)
        e = np.stack((np.zeros_like(e), e), axis=2)
        a, b = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        a[:, 0] = start + e[:, 0]
        for t in range(1, longest):
            nxt = np.logaddexp.reduce(a[:, t - 1, :, None] + move, axis=1) + e[:, t]
            a[:, t] = np.where(real[:, t, None], nxt, a[:, t - 1])
        z = np.logaddexp.reduce(a[np.arange(n), last], axis=1)
        for t in range(longest - 2, -1, -1):
            nxt = np.logaddexp.reduce(move + (e[:, t + 1] + b[:, t + 1])[:, None, :], axis=2)
            b[:, t] = np.where(real[:, t + 1, None], nxt, 0)
        one = np.exp(a + b - z[:, None, None]) * real[:, :, None]
        pair = np.exp(a[:, :-1, :, None] + move + (e + b)[:, 1:, None, :] - z[:, None, None, None]) * real[:, 1:, None, None]
        want = np.zeros((2, 2))
        np.add.at(want, (y[:, :-1][real[:, 1:]], y[:, 1:][real[:, 1:]]), 1)
        gap = ((y == 1) * real - one[:, :, 1]).ravel()
        grads = (np.bincount(feature, gap[at], len(names)) / n - decay * w, (want - pair.sum((0, 1))) / n, (np.bincount(y[:, 0], minlength=2) - one[:, 0].sum(0)) / n)
        for p, g, s in zip((w, move, start), grads, state):
            s[0] = 0.9 * s[0] + 0.1 * g.ravel()
            s[1] = 0.99 * s[1] + 0.01 * g.ravel() ** 2
            p += (rate * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.99**step)) + 1e-8)).reshape(p.shape)
    return Model({f: float(w[i]) for f, i in names.items()}, move, start)


def viterbi(e: list[float], model: Model) -> list[int]:
    """The best labels, given each block's weight for main text."""
    (m00, m01), (m10, m11) = model.move.tolist()
    s0, s1 = float(model.start[0]), float(model.start[1]) + e[0]
    back = []
    for x in e[1:]:
        f0, f1 = s1 + m10 > s0 + m00, s1 + m11 > s0 + m01
        back.append((f0, f1))
        s0, s1 = (s1 + m10 if f0 else s0 + m00), (s1 + m11 if f1 else s0 + m01) + x
    y = [int(s1 > s0)]
    for f0, f1 in reversed(back):
        y.append(int(f1 if y[-1] else f0))
    return y[::-1]


class Extractor:
    """Labels pages with a model. An element's weight is worked out once, from that of the element around it."""

    def __init__(self, model: Model):
        self.model = model

    def weight(self, node: Node | None, holder: bool) -> float:
        """The weights of path_features(), summed up along the path."""
        w = self.model.weights
        around, open_ = node, []
        while around is not None and around.weight is None:
            open_.append(around)
            around = around.up
        total = around.weight if around is not None else 0.0
        for x in reversed(open_):
            total += sum(w.get(f, 0.0) for f in x.new)
            x.weight = total
        total += w.get(f"parent {node.element.partition(' ')[0] if node else '-'}", 0.0)
        if not holder:
            return total + w.get("no article", 0.0)
        return total + (w.get("outside the article", 0.0) if node is None or not node.inside else 0.0)

    def main_text(self, page: str | None) -> str:
        found = blocks(page) if page else []
        if not found:
            return ""
        w, holder, e = self.model.weights, _has_holder(found), []
        for b in found:
            x = self.weight(b.node, holder)
            for f in text_features(b):
                x += w.get(f, 0.0)
            e.append(x)
        return "\n\n".join(b.text for b, y in zip(found, viterbi(e, self.model)) if y)


def learn(n_pages: int = 600, seed: int = 1) -> Model:
    """The model of the built-in labelled pages."""
    from tessera.llm.html_pages import labelled, with_controls

    return fit(labelled(n_pages, seed) + with_controls(n_pages // 4, seed))


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars), a row of pages each.

    text: the main blocks in page order, two line feeds apart, each with its character
    references decoded and white space made one blank; empty if there is none, as for null
    or empty html. Pages are read whole; repeated rows each give a row; empty tables stay
    empty; other columns aren't looked at.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or learn())  # a weight a feature of the labelled pages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor = Extractor(shared.value)
        for batch in batches:
            for i in range(0, len(batch), 1000):
                part = batch.slice(i, 1000)
                texts = [extractor.main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
