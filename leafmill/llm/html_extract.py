"""Main text of HTML pages by maximum-scoring subsequence.

A page becomes a run of tokens. Words score by the elements around them - positive where labelled pages have their article,
negative where they have menus and the like - and tags score negative. One linear scan finds the contiguous run with the
highest sum. Inside it, what stands in an element that scores below zero is left out, and so is a block whose words, links
and all, don't sum up to more than zero.

The weights come from labelled pages: pages that mark their article or main element themselves, at most SAMPLE of them. A
word counts for each element around it, by its tag and by each of its names. Fixed prior counts stand in for what the sample
doesn't show: for a name, they depend on what it says as a whole, so that "share-price" isn't a sharing bar.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

#: Labelled pages that the weights are fitted on.
SAMPLE = 500

# Element names by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset("script style textarea title noscript template iframe svg math object canvas select".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body html caption td th tr tbody thead tfoot".split())
IMPLIED_END = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",)}
ROOTS = frozenset(("article", "main"))
CLOSED_INSIDE = frozenset("p li b i span a em strong".split())
NO_STOP, INLINE_STOP = frozenset(), frozenset(("td", "th", "table", "body"))
P_STOP = INLINE_STOP | {"button"}
LIST_STOP = frozenset(("ul", "ol", "dl", "table", "select", "menu"))

# Tags, roles and words of names of what surrounds an article, and words that say nothing beside them.
CHROME_TAGS = frozenset("nav aside footer form button menu dialog fieldset head header".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CHROME_WORDS = frozenset(
    "ad ads adsbygoogle advert adverts advertisement advertisements advertising sponsor sponsors sponsored promo promos promotion banner cookie cookies consent gdpr notice notices notification notifications popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar aside footer masthead copyright toolbar widget widgets share sharing social related recommended recommendations newsletter subscribe signup login search comment comments commentlist disqus reply replies respond responses discussion discussions thread threads reactions talkback skip".split()
)
PLAIN_WORDS = frozenset(
    "site page global main primary secondary top bottom left right inner outer wrap wrapper container content contents section area block box bar body list listing item items row col column group holder panel slot unit zone region link links button buttons icon icons form title heading label post posts article articles story stories entry entries user users reader readers sticky fixed first last js".split()
)
ARTICLE_WORDS = frozenset("article post story entry content".split())

# Prior counts of words, in the article and elsewhere, for features that a sample may lack.
CHROME_PRIOR, OTHER_PRIOR = (1, 400), (2, 2)
PRIORS = {
    **{f"in:{t}": (40, 2) for t in ("article", "main")},
    **{f"at:{t}": (12, 4) for t in ("p", "h1", "h2", "h3", "blockquote", "pre")},
    **{f"in:{t}": CHROME_PRIOR for t in sorted(CHROME_TAGS)},
    **{f"role:{r}": CHROME_PRIOR for r in sorted(CHROME_ROLES)},
    "at:a": (2, 6),
    "at:li": (6, 6),
    "outside": (2, 12),
}
#: The most that a feature with such a prior, a root, and any other feature may weigh.
MOST_CHROME, MOST_ROOT, MOST_OTHER = 6.0, 3.0, 1.0
#: What a word scores without any feature, what a tag costs at least, and what a word in a hidden element scores.
BASE, TAG, HIDDEN_SCORE = 0.5, -0.1, -20.0

QUOTED_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
TAG_START = re.compile(r"<(?:/?[a-zA-Z]|[!?])")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: Kinds of start tags, and elements, that a worker remembers for a slice of pages.
REMEMBERED = 20_000
#: Bytes of pages in a slice.
SLICE = 4 << 20


def chrome_name(parts: list[str]) -> bool:
    """Whether a name, as its words, says that the element isn't part of an article."""
    telling = [p for p in parts if p not in PLAIN_WORDS]
    if telling == ["header"]:
        return not ARTICLE_WORDS.intersection(parts)
    return bool(telling) and CHROME_WORDS.issuperset(telling)


#: What matters of a start tag: its features, whether it is a root, whether it is hidden.
Kind = tuple[tuple[str, ...], bool, bool]


def kind_of(tag: str, rest: str) -> Kind:
    attrs = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(rest)}
    role = attrs.get("role", "").lower()
    hidden = "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or bool(HIDDEN.search(attrs.get("style", "")))
    features = [f"in:{tag}"] if f"in:{tag}" in PRIORS else []
    if role in CHROME_ROLES:
        features.append(f"role:{role}")
    if tag not in ("html", "body"):
        for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
            parts = [w.lower() for w in NAME_PART.findall(name)]
            features.append(("as!" if chrome_name(parts) else "as:") + "-".join(parts)[:60])
    return tuple(dict.fromkeys(features)), tag in ROOTS or role in ("main", "article"), hidden


@dataclass
class Weights:
    """Log-odds of a word's features, and what a tag costs."""

    features: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)

    @classmethod
    def fit(cls, counts: dict[str, tuple[int, int]]) -> Weights:
        """counts: of each feature, words in and outside the articles of labelled pages; "tag:x" counts tags."""
        total = [1 + n for n in counts.get("words", (0, 0))]
        balance = math.log(total[0] / total[1])
        features, tags = {}, {}
        for name in {*counts, *PRIORS}:
            a, b = counts.get(name, (0, 0))
            if name.startswith("tag:"):
                tags[name[4:]] = TAG - min(0.3, max(0.0, math.log((b + 1) / (a + 1)) + balance))
            elif name != "words":
                p, q = prior = cls.prior(name)
                most = MOST_CHROME if prior == CHROME_PRIOR else MOST_ROOT if q < p == 40 or name == "outside" else MOST_OTHER
                features[name] = max(-most, min(most, math.log((a + p) / (b + q)) - (balance if a + b > p + q else 0.0)))
        return cls(features, tags)

    @staticmethod
    def prior(feature: str) -> tuple[int, int]:
        return CHROME_PRIOR if feature.startswith("as!") else PRIORS.get(feature, OTHER_PRIOR)

    def of(self, feature: str) -> float:
        own = self.features.get(feature)
        return own if own is not None else -MOST_CHROME if feature.startswith("as!") else 0.0


class Element:
    """An open element with what its place means for the words in it; equal places share one object.

    place: what its path weighs; below: what the path below the innermost root weighs."""

    __slots__ = ("tag", "features", "root", "hidden", "block", "place", "below", "score", "parent", "kids")

    def __init__(self, tag: str, kind: Kind, block: str, parent: Element | None, weights: Weights):
        self.tag, self.block, self.parent = tag, block, parent
        self.kids: dict[tuple[str, Kind], Element] = {}
        self.features, is_root, hidden = kind
        self.root = is_root or (parent is not None and parent.root)
        self.hidden = hidden or (parent is not None and parent.hidden)
        if parent is not None and parent.root and "in:header" in self.features:  # the article's own
            self.features = tuple(f for f in self.features if f != "in:header")
        own = sum(map(weights.of, self.features))
        self.place = HIDDEN_SCORE if self.hidden else max(HIDDEN_SCORE, min(8.0, (parent.place if parent else BASE) + own))
        self.below = 0.0 if is_root or parent is None else max(HIDDEN_SCORE, min(8.0, parent.below + own))
        self.score = max(-5.0, min(5.0, self.place + weights.of(f"at:{block}")))


class Reader:
    """Reads pages into tokens. Elements with the same path of kinds are one object, as long as there are not too many."""

    def __init__(self, weights: Weights):
        self.weights = weights
        self.outer = Element("", ((), False, False), "body", None, weights)
        self.kinds: dict[tuple[str, str], Kind] = {}
        self.elements = [self.outer]

    def opened(self, parent: Element, tag: str, rest: str) -> Element:
        kind = self.kinds.get((tag, rest))
        if kind is None:
            kind = kind_of(tag, rest)
            if len(self.kinds) < REMEMBERED and len(rest) < 300:
                self.kinds[tag, rest] = kind
        kid = parent.kids.get((tag, kind))
        if kid is None:
            kid = Element(tag, kind, tag if tag in BLOCK or tag == "a" else parent.block, parent, self.weights)
            if len(self.elements) < REMEMBERED:
                self.elements.append(kid)
                parent.kids[tag, kind] = kid
        return kid

    def tokens(self, page: str) -> list[Token]:
        """The page's tags and texts in order, with the elements that hold them; end tags that are left out are implied.

        Each character is looked at a bounded number of times, whatever the page is like."""
        stack = [self.outer]
        places: dict[str, list[int]] = {}  # of each tag, its places in the stack
        out: list[Token] = []
        last = 0

        def pop(tag: str, stop: frozenset[str]) -> None:
            own = places.get(tag)
            if not own or any(at and at[-1] > own[-1] for at in map(places.get, stop)):
                return
            at = own[-1]
            for e in stack[at:]:
                places[e.tag].pop()
            del stack[at:]

        find, start = page.find, TAG_START.search
        seek, quotes_close, tags_close = 0, True, True
        while (m := start(page, seek)) is not None:
            at = m.start()
            if page[at + 1] in "!?":
                end = find("-->", at + 4) if page.startswith("<!--", at) else find(">", at)
                if at > last:
                    out.append((page[last:at], stack[-1], ""))
                last = seek = len(page) if end < 0 else end + (3 if page.startswith("<!--", at) else 1)
                continue
            if not tags_close:  # a lone "<" is text
                seek = at + 1
                continue
            m = QUOTED_TAG.match(page, at) if quotes_close else None
            if m is None:
                quotes_close = False  # a quote is open up to the end of the page: from here on they don't count
                m = PLAIN_TAG.match(page, at)
                if m is None:
                    tags_close, seek = False, at + 1
                    continue
            if at > last:
                out.append((page[last:at], stack[-1], ""))
            last = seek = m.end()
            tag, rest = m[2].lower(), m[3]
            if m[1]:
                pop(tag, INLINE_STOP if tag in CLOSED_INSIDE else NO_STOP)
                out.append((None, stack[-1], tag))
                continue
            if tag in CLOSES_P:
                pop("p", P_STOP)
            for other in IMPLIED_END.get(tag, ()):
                pop(other, LIST_STOP)
            out.append((None, stack[-1], tag))
            if tag == "br":
                out.append((" ", stack[-1], ""))
            elif tag in RAW_TEXT and not rest.endswith("/"):
                close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, last)
                end = find(">", close.end()) if close else -1
                last = seek = len(page) if end < 0 else end + 1
            elif tag not in VOID and not (rest.endswith("/") and tag not in BLOCK):
                places.setdefault(tag, []).append(len(stack))
                stack.append(self.opened(stack[-1], tag, rest))
        if last < len(page):
            out.append((page[last:], stack[-1], ""))
        return out


#: A token: its text (None for a tag), the element that holds it, and the tag's name.
Token = tuple[str | None, Element, str]


def best_run(scores: list[float]) -> tuple[int, int]:
    """Ends of the contiguous run with the highest sum, the first of equals; (0, 0) if no sum is positive."""
    best, low, high, total, start = 0.0, 0, 0, 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, low, high = total, start, i + 1
    return low, high


def main_text(page: str | None, weights: Weights, reader: Reader | None = None) -> str:
    if not page:
        return ""
    run = (reader or Reader(weights)).tokens(page)
    marked = any(text and place.root and place.place >= 0 and not text.isspace() for text, place, _ in run)
    outside = weights.of("outside") if marked else 0.0
    tag_score = weights.tags.get
    scores = []
    for text, place, tag in run:
        if text is None:
            scores.append(tag_score(tag, TAG))
        elif place.root:
            # what is no part of the article should not part what stands around it
            scores.append(TAG if place.place < 0 else place.score * len(text.split()))
        else:
            score = place.score + outside
            scores.append((min(score, place.place) - 1.0 if place.place < 0 else score) * len(text.split()))
    low, high = best_run(scores)
    blocks: list[str] = []
    words: list[str] = []
    total = 0.0
    for (text, place, tag), score in zip(run[low:high], scores[low:high]):
        if text is not None:
            if place.place >= 0:
                words.append(text)
                total += score
        elif words and tag in BLOCK:
            if total > 0:
                blocks.append("".join(words))
            words, total = [], 0.0
    if total > 0:
        blocks.append("".join(words))
    return "\n".join(b for b in (" ".join((entities.unescape(x) if "&" in x else x).split()) for x in blocks) if b)


def count_features(pages: Iterator[str]) -> dict[str, tuple[int, int]]:
    """Of each feature, words in and outside the articles of these pages. What only the priors keep out of an article counts
    neither way."""
    reader = Reader(Weights.fit({}))
    found: Counter[tuple[str, bool]] = Counter()
    held: dict[int, tuple[Element, list[int]]] = {}
    for page in pages:
        for text, place, tag in reader.tokens(page):
            if text is None:
                found[f"tag:{tag}", place.root and place.below >= 0] += 1
            elif (n := len(text.split())) and (not place.root or place.below >= 0):
                found["words", place.root] += n
                found[f"at:{place.block}", place.root] += n
                held.setdefault(id(place), (place, [0, 0]))[1][place.root] += n
    # words count for all elements around them: from the elements up, the innermost first
    depth: dict[int, int] = {}

    def depth_of(e: Element) -> int:
        path = []
        while e is not None and id(e) not in depth:
            path.append(e)
            e = e.parent
        n = depth[id(e)] if e is not None else -1
        for x in reversed(path):
            n += 1
            depth[id(x)] = n
        return n

    by_depth: dict[int, dict[int, tuple[Element, list[int]]]] = {}
    for i, own in held.items():
        by_depth.setdefault(depth_of(own[0]), {})[i] = own
    for level in range(max(by_depth, default=-1), -1, -1):
        for e, (out, inside) in by_depth.get(level, {}).values():
            for f in e.features:
                found[f, True] += inside
                found[f, False] += out
            if e.parent is not None:
                above = by_depth.setdefault(level - 1, {}).setdefault(id(e.parent), (e.parent, [0, 0]))[1]
                above[0] += out
                above[1] += inside
    return {f: (found[f, True], found[f, False]) for f, _ in found}


def fit_weights(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> Weights:
    """Weights from the SAMPLE labelled pages whose ids have the lowest hashes; each feature that these pages show counts."""
    labelled = pages.where(F.lower(html_col).rlike("<(article|main)[ >]"))
    sample = [r[0] for r in labelled.select(F.col(id_col).alias("id")).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()]
    if not sample:
        return Weights.fit({})
    ids = pages.sparkSession.createDataFrame([(i,) for i in sample], T.StructType([T.StructField("id", pages.schema[id_col].dataType)])).distinct()
    chosen = labelled.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).join(F.broadcast(ids), "id").select("html")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = count_features(page for batch in batches for page in batch.column(0).to_pylist())
        names = sorted(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([found[f][0] for f in names], pa.int64()), pa.array([found[f][1] for f in names], pa.int64())],
            names=["feature", "inside", "outside"],
        )

    rows = chosen.mapInArrow(count, "feature string, inside long, outside long").groupBy("feature").agg(F.sum("inside"), F.sum("outside"))
    return Weights.fit({f: (a, b) for f, a, b in rows.collect()})  # the features of SAMPLE pages


def extract_text(pages: DataFrame, weights: Weights | None = None, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """pages without the html, with text and n_chars (code points).

    Null or empty html, and pages where no run of words scores above 0: empty text. Pages are read whole, however long, in
    time that grows with their length; repeated rows each. Empty table: empty result. Extra columns stay; those named text
    or n_chars are replaced.
    """
    if weights is None:
        weights = fit_weights(pages, id_col, html_col)
    pages = pages.drop(*[c for c in ("text", "n_chars") if c != html_col])
    carried = [f for f in pages.schema.fields if f.name != html_col]
    schema = T.StructType([*carried, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    at = pages.columns.index(html_col)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, at, SLICE):
            reader = Reader(weights)
            texts = [main_text(p, weights, reader) for p in part.column(at).to_pylist()]
            own = [part.column(i) for i in range(part.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*own, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[f.name for f in schema.fields])

    return pages.mapInArrow(extract, schema)
