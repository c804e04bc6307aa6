"""Main text of web pages by the maximum-scoring subsequence: words score positive, tags negative, and a linear scan finds the best region.

The weights come from labelled pages: pages that mark their article themselves (article, main or an articleBody). For each kind of place that words stand in
(the block's tag, in a link or not, in surroundings or not) and for each tag the log-odds of standing in the article are learned. The marks are labels alone: what is
extracted is the best region, less the elements in it that score under zero by themselves. Elements tell by their tag or by the names of their class, id or role that
they are surroundings; a name that only has such a word in it costs some points and leaves the words of the element to decide.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.llm.common import lean

#: Labelled pages that the weights are fitted to at most (those with the smallest hash of their address and length).
MAX_LABELLED = 400

# Names of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol "
    "optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
RAW = "script|style|noscript|template|textarea|title|select|button|noframes|noembed"
#: Elements of the surroundings, and words that name them in a class, id or role; words that say nothing beside these.
OUTSIDE = frozenset("nav header footer aside form menu dialog head".split())
OUTSIDE_WORDS = re.compile(
    r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|notices?|alert|popup|modal|newsletter|subscri\w+|sidebar\w*|side|widgets?|menu\w*|nav\w*|breadcrumb\w*|toolbar|"
    r"masthead|header|footer|foot|comments?|commentlist|disqus|respon[ds]\w*|repl(?:y|ies)|share|sharing|social|related|recommend\w*|pagination|pager|login|signup|search|copyright|legal|hidden|contentinfo|complementary", re.I,
)
NEUTRAL_WORDS = frozenset("box container wrapper wrap section list area block bar link links button buttons form inner outer left right top bottom site page post article slot item items main text group row col column panel the".split())

_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>.*?(?:</(?P=raw)\s*+>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>|<[!?/][^>]*+>""",
    re.S | re.I,
)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|itemprop|hidden|aria-hidden)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_CLOSES_P = BLOCKS - {"html", "body", "head"}
#: Elements at which the search for an open paragraph or item ends.
_HOLDERS = frozenset("p div article section main td li blockquote body".split())
_PARTS = re.compile(r"[\W_\d]+|(?<=[a-z])(?=[A-Z])")

#: Points of an element whose names have a word of surroundings among others; points that an element left out costs the region around it at most.
WEAK, MOST_LOST = -3.0, -3.0


@dataclass
class Node:
    """An element, what it inherits from those around it, and where it stands among the pieces."""

    name: str
    parent: Node | None
    outside: bool = False  # in surroundings
    marked: bool = False  # in a marked article
    article: bool = False  # in an article, main or the like
    telling: Node | None = None  # the nearest element around, or itself, that tells it may be surroundings
    holder: Node | None = None  # the nearest of _HOLDERS
    block: str = "html"  # the nearest block's name
    first: int = 0
    last: int = 0


@dataclass
class Piece:
    """A stretch of text or a tag, in page order."""

    text: str
    node: Node
    block: int
    words: int
    link: bool
    tag: str = ""
    extra: float = 0.0


@dataclass
class Weights:
    """Score of a word by its place (block, in a link, in surroundings) and of a tag by its name."""

    words: dict[tuple[str, bool, bool], float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)

    def of(self, piece: Piece) -> float:
        if piece.tag:
            return self.tags.get(piece.tag, -0.2) + piece.extra
        if not piece.words:
            return 0.0
        return piece.words * self.words.get((piece.node.block, piece.link, piece.node.outside), -1.0 if piece.node.outside else -0.2 if piece.link else 0.5)


def evidence(name: str, attrs: dict[str, str]) -> int:
    """2 if an element names itself surroundings, 1 if a part of a name does, else 0."""
    if name in OUTSIDE or attrs.get("aria-hidden") == "true" or "hidden" in attrs:
        return 2
    found = 0
    for word in " ".join(attrs.get(k, "") for k in ("class", "id", "role")).split():
        parts = [x for x in _PARTS.split(word) if x]
        hits = [bool(OUTSIDE_WORDS.fullmatch(x)) for x in parts]
        if any(hits):
            found = max(found, 2 if all(h or x.lower() in NEUTRAL_WORDS for h, x in zip(hits, parts)) else 1)
    return found


def _open_ended(m: re.Match) -> bool:
    """Whether a comment, script or the like has no end, and so goes to the end of the page."""
    found = m[0]
    if found.startswith("<!--"):
        return not found.endswith("-->") or len(found) < 7
    return bool(m["raw"]) and not re.fullmatch(rf"</{m['raw']}\s*+>", found[found.rfind("</") :], re.I)


def pieces(page: str) -> tuple[list[Piece], list[Node]]:
    """A page as texts and tags, and the elements that may be surroundings, in page order; comments, scripts and the like are left out. The work is linear: what an element inherits is kept with it, and end tags of no open element are known by a count."""
    root = Node("html", None)
    now, block, links, at = root, 0, 0, 0
    out: list[Piece] = []
    telling: list[Node] = []
    opened: Counter = Counter()

    def text(raw: str) -> None:
        if raw:
            out.append(Piece(raw, now, block, len(raw.split()), links > 0))

    def leave(node: Node) -> None:
        nonlocal now, links
        while now is not node.parent and now is not root:
            now.last = len(out)
            links -= now.name == "a"
            opened[now.name] -= 1
            now = now.parent

    upto = page.rfind(">") + 1  # no tag ends after it
    for m in _TOKEN.finditer(page, 0, upto):
        text(page[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if at == upto and _open_ended(m):
            at = len(page)
        if not name:
            if m["raw"] and m["raw"].lower() in ("button", "select"):
                out.append(Piece(" ", now, block, 0, links > 0))
            continue
        if name in BLOCKS:
            block += 1
        if name == "br":
            out.append(Piece(" ", now, block, 0, links > 0))
            continue
        if m["end"]:
            found = now
            if opened[name] > 0:
                while found.name != name:
                    found = found.parent
                leave(found)
            out.append(Piece("", found, block, 0, links > 0, name))
            continue
        if name in _CLOSES_P and now.holder and (now.holder.name == "p" or now.holder.name == name == "li"):
            leave(now.holder)  # a block ends an open paragraph, and a list item the one before
        if name in ("article", "main") and now.outside and not now.article:
            # An element of the surroundings that was never closed doesn't hold the article.
            while now is not root and now.outside:
                leave(now)
        attrs = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(m["attrs"] or "")} if m["attrs"] else {}
        told = evidence(name, attrs)
        if name == "header" and now.article and not now.outside:
            told = 0
        out.append(Piece("", now, block, 0, links > 0, name, WEAK if told == 1 else 0.0))
        if name in VOID or (m["attrs"] or "").endswith("/") and name not in BLOCKS:
            continue
        outside = now.outside or told == 2
        article = name in ("article", "main") or attrs.get("role") in ("main", "article") or "articlebody" in attrs.get("itemprop", "").lower()
        node = Node(name, now, outside, now.marked or (article and not outside), now.article or article, now.telling, now.holder, name if name in BLOCKS else now.block, len(out) - 1)
        if told:
            node.telling = node
            telling.append(node)
        if name in _HOLDERS:
            node.holder = node
        now = out[-1].node = node
        opened[name] += 1
        links += name == "a"
    text(page[at:].partition("<!--")[0])
    while now is not root:
        now.last = len(out)
        now = now.parent
    return out, telling


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the run of scores with the largest sum, the first of equal ones; (0, 0) if none is over zero."""
    best, total, start, found = 0.0, 0.0, 0, (0, 0)
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, found = total, (start, i + 1)
    return found


def _left_out(scores: list[float], telling: list[Node]) -> list[Node]:
    """The outermost elements of those that tell they may be surroundings that score under zero, what is left out within them not counted."""
    sums = list(accumulate(scores, initial=0.0))
    removed: dict[int, float] = {}
    bad: set[int] = set()
    for node in reversed(telling):
        raw, gone = sums[node.last] - sums[node.first], removed.pop(id(node), 0.0)
        around = node.parent.telling
        if raw - gone < 0:
            bad.add(id(node))
            gone = raw
        if around is not None:
            removed[id(around)] = removed.get(id(around), 0.0) + gone
    out, end = [], 0
    for node in telling:
        if id(node) in bad and node.first >= end:
            out.append(node)
            end = node.last
    return out


def main_text(page: str | None, weights: Weights) -> str:
    """The blocks of the best region of a page, joined by blank lines; empty if it has none."""
    found, telling = pieces(page or "")
    scores = [weights.of(p) for p in found]
    gone = [False] * len(found)
    for node in _left_out(scores, telling):
        cost = max(MOST_LOST, sum(scores[node.first : node.last]))
        for k in range(node.first, node.last):
            gone[k], scores[k] = True, 0.0
        scores[node.first] = cost
    start, end = best_region(scores)
    if start == end:
        return ""
    # To the edges of the blocks that it begins and ends in.
    while start > 0 and found[start - 1].block == found[start].block and not gone[start - 1]:
        start -= 1
    while end < len(found) and found[end].block == found[end - 1].block and not gone[end]:
        end += 1
    blocks: dict[int, list[str]] = {}
    for p, left_out in zip(found[start:end], gone[start:end]):
        if p.text and not left_out:
            blocks.setdefault(p.block, []).append(p.text)
    texts = (" ".join(html.unescape("".join(parts)).split()) for parts in blocks.values())
    return "\n\n".join(t for t in texts if t)


def fit(pages: list[str]) -> Weights:
    """Weights of labelled pages: those that mark their article. Words of what names itself surroundings don't count as the article's, wherever they stand."""
    words: dict[bool, Counter] = {True: Counter(), False: Counter()}
    tags: dict[bool, Counter] = {True: Counter(), False: Counter()}
    for page in pages:
        for p in pieces(page)[0]:
            inside = p.node.marked and not p.node.outside
            if p.tag and not p.node.outside:
                tags[inside][p.tag] += 1
            elif p.words:
                words[inside][p.node.block, p.link, p.node.outside] += p.words
    odds = lambda c, k: math.log((c[True][k] + 1) / (c[False][k] + 1))
    places = {k: min(1.0, max(0.2 if not k[1] else -1.0, odds(words, k))) if odds(words, k) > 0 else max(-1.0, odds(words, k)) for k in {*words[True], *words[False]}}
    # A tag of the article costs little, one of the surroundings more.
    return Weights(places, {k: min(-0.1, max(-3.0, odds(tags, k) - 1.0)) for k in {*tags[True], *tags[False]}})


def fit_weights(df: DataFrame, html_col: str = "html", max_labelled: int = MAX_LABELLED) -> Weights:
    """Weights fitted to at most max_labelled pages that mark their article; with none, fixed ones hold."""
    named = df.select(F.col(html_col).cast("string").alias("h")).where(F.col("h").rlike("(?i)<article|<main|articleBody"))
    sample = named.select("h", F.xxhash64("h").alias("k")).orderBy("k").limit(max_labelled)
    return fit(sorted(r.h for r in sample.select("h").toLocalIterator()))


def extract_main_text(df: DataFrame, weights: Weights, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns named in keep, text string and n_chars long (its code points) of every whole page.

    A null or empty page, or one whose words all are surroundings, has an empty text. Repeated rows give repeated results; other columns don't matter. Rows are worked on alone; the work of one is linear in its length."""
    names = tuple(keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), weights) for x in batch.column(len(names))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*names, "text", "n_chars"])

    schema = T.StructType([*(df.schema[c] for c in names), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return df.select(*names, F.col(html_col).cast("string").alias("__html")).mapInArrow(lean(work), schema)
