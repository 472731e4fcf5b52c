"""Main text of web pages by minimum-cut labelling.

A page's text is cut into blocks at block-level tags. A linear classifier of a block's surroundings, length
and links gives its costs of being called content or boilerplate: capacities to the two terminals.
Neighbours in page order and blocks near each other in the DOM are joined by smoothness capacities. The
minimum cut, found by max-flow, is the labelling of least cost; the content side's blocks are the text.

Bad names and forms count for what they hold, but not where they wrap the page's main part.

Defined cases: null and empty pages have an empty text; elements that aren't closed or weren't opened are
repaired as browsers do in the common cases; a tag without its closing bracket is text; the time is linear in
the page's length for markup and text of any kind, and pages of any length are taken whole; repeated rows get
a row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces

#: Kinds of tags.
RAW = frozenset("script style noscript template textarea iframe svg math object select title".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_ITSELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BOUNDS = frozenset("ul ol menu table dl select body article div section main aside nav".split())
#: Names in class, id and role that tell what a container holds.
BAD_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|banner|breadcrumbs?|byline|comments?|comment-list|consent|contentinfo|cookies?|disqus|footer|foot|gdpr|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|notices|notification|pager|pagination|paywall|popup|promo|promoted|related|replies|reply|respond|share|sharing|shoutbox|sidebar|side|signup|skip|social|sponsor|sponsored|subscribe|subscription|tags?|toolbar|toc|warning|widget|complementary|search)(?:$|[\s_-]|\d)",
    re.I,
)
GOOD_NAMES = re.compile(r"(?:^|[\s_-])(?:article|articlebody|body|content|entry|main|post|story|text)(?:$|[\s_-]|\d)", re.I)
BAD_TAGS = frozenset("nav footer aside form menu dialog button select header search fieldset label".split())
GOOD_TAGS = frozenset(["article", "main"])

#: The classifier's weights: bias and what each trait adds to the log odds of being content.
WEIGHTS = {"bias": -1.0, "good_tag": 4.0, "good_name": 1.5, "bad_tag": -9.0, "bad_name": -9.0, "no_good": -3.0, "links": -3.0, "words": 0.08, "heading": 1.0}
MOST_WORDS = 30
#: Capacities between neighbours in page order and between blocks of one container; DOM steps weaken both.
NEXT, SAME = 1.0, 0.8
#: Share of the unmarked and its own text that a marked container without articles or good names around holds to be a wrapper.
WRAPS = 0.9

#: Each alternative ends at the next angle bracket outside of quotes or takes what it has read for good, so that the time is linear.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^<>]*+>|<\?[^<>]*+>|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^<>]*+>", re.I) for t in RAW}
#: Elements nested deeper than this count as children of the one at this depth, as in browsers.
MOST_DEPTH = 512


@dataclass(slots=True)
class Container:
    """An open element: its tag, parent and what its ancestors and it tell."""

    tag: str
    parent: Container | None
    depth: int
    bad_tag: bool
    bad_name: bool
    good_tag: bool
    good_name: bool
    own_tag: bool
    own_name: bool


@dataclass(slots=True)
class Block:
    text: str
    where: Container
    linked: int


def opened(tag: str, attributes: str, parent: Container | None) -> Container:
    names = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes)) if "=" in attributes else ""
    p = parent
    inside = p is not None and p.good_tag
    own_tag = tag in BAD_TAGS and not (tag == "header" and inside)
    own_name = bool(names) and tag not in ("html", "body") and tag not in GOOD_TAGS and BAD_NAMES.search(names) is not None
    return Container(
        tag, p, p.depth + 1 if p else 0,
        (p is not None and p.bad_tag) or own_tag,
        (p is not None and p.bad_name) or own_name,
        inside or tag in GOOD_TAGS,
        (p is not None and p.good_name) or (bool(names) and GOOD_NAMES.search(names) is not None),
        own_tag, own_name,
    )


def blocks(html: str) -> list[Block]:
    """Runs of text between block-level tags, white space made single, with their containers."""
    top = opened("html", "", None)
    stack, out, held, in_link, linked = [top], [], [], False, 0
    places: dict[str, list[int]] = defaultdict(list)  # of the elements of the stack by tag, in order
    at, end = 0, len(html)

    def close_from(k: int) -> None:
        """Close the elements of the stack from a place on."""
        for c in stack[k:]:
            places[c.tag].pop()
        del stack[k:]

    def nearest(tags) -> int:
        """The highest place in the stack with one of some tags."""
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(unescape("".join(held)).split())
            if text:
                out.append(Block(text, stack[-1], linked))
            held.clear()
        linked = 0

    while at < end:
        m = _TOKEN.search(html, at)
        if m is None:
            held.append(html[at:])
            if in_link:
                linked += end - at
            break
        if m.start() > at:
            held.append(html[at : m.start()])
            if in_link:
                linked += m.start() - at
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                in_link = False
            elif tag in BLOCKS:
                flush()
                if places.get(tag):
                    close_from(places[tag][-1])
                    in_link = False
            continue
        if tag in RAW and not m[3].endswith("/"):
            close = _RAW_END[tag].search(html, at)
            at = close.end() if close else end
            if tag == "select":
                flush()
        elif tag == "a":
            in_link = True
        elif tag == "br":
            held.append(" ")
        elif tag in BLOCKS:
            flush()
            if stack[-1].tag == "p" and len(stack) > 1:
                close_from(len(stack) - 1)
            if tag in CLOSES_ITSELF:
                k = nearest(CLOSES_ITSELF[tag])
                if k and k >= nearest(BOUNDS):
                    close_from(k)
            if tag not in VOID:
                places[tag].append(len(stack))
                stack.append(opened(tag, m[3], stack[min(len(stack), MOST_DEPTH) - 1]))
    flush()
    return out


def odds(b: Block, any_good: bool) -> float:
    """Log odds of content."""
    w, c = WEIGHTS, b.where
    x = w["bias"] + w["words"] * min(MOST_WORDS, b.text.count(" ") + 1) + w["links"] * min(1.0, b.linked / len(b.text))
    x += w["good_tag"] if c.good_tag else w["no_good"] if any_good else 0.0
    return x + w["good_name"] * c.good_name + w["bad_tag"] * c.bad_tag + w["bad_name"] * c.bad_name + w["heading"] * (len(c.tag) == 2 and c.tag[0] == "h" and c.tag != "hr")


def unmark_wrappers(found: list[Block]) -> None:
    """Take bad marks from what wraps the page's main part: a name may only mention a part, and a form may hold the whole page.

    A container with a bad name, or a form, is a wrapper if it holds most of the text and most of the articles'
    (or else of the good names') without being inside one; on pages without these, nearly all unmarked text. If
    all articles are still under bad marks, they are judged without those of what is around them.
    """
    if not any(b.where.bad_tag or b.where.bad_name for b in found):
        return
    trait = next((t for t in ("good_tag", "good_name") if any(getattr(b.where, t) for b in found)), None)
    every: dict[int, Container] = {}
    held, good = {}, {}
    sizes = [max(0, len(b.text) - b.linked) for b in found]
    for b, n in zip(found, sizes, strict=True):
        c = b.where
        while c is not None:
            k = id(c)
            every[k] = c
            held[k] = held.get(k, 0) + n
            good[k] = good.get(k, 0) + n * (trait is not None and getattr(b.where, trait))
            c = c.parent
    order = sorted(every.values(), key=lambda c: c.depth)
    top = id(order[0])
    wrappers: set[int] = set()

    def mark(reset: bool = False) -> None:
        for c in order:
            p, free = c.parent, id(c) in wrappers
            around = p is not None and not (reset and c.tag in GOOD_TAGS and not p.good_tag)
            c.bad_tag = (around and p.bad_tag) or (c.own_tag and not free)
            c.bad_name = (around and p.bad_name) or (c.own_name and not free)

    for c in order:
        k = id(c)
        if not (c.own_name or c.own_tag and c.tag == "form") or c.own_tag and c.tag != "form" or 2 * held[k] <= held[top]:
            continue
        if trait is None:
            unmarked = sum(n for b, n in zip(found, sizes, strict=True) if not (b.where.bad_tag or b.where.bad_name))
            wraps = held[k] >= WRAPS * (held[k] + unmarked) and not (c.parent.bad_tag or c.parent.bad_name)
        else:
            wraps = not getattr(c.parent, trait) and 2 * good[k] > good[top]
        if wraps:
            wrappers.add(k)
            mark()
    if trait == "good_tag" and all(b.where.bad_tag or b.where.bad_name for b in found if b.where.good_tag):
        mark(reset=True)


def steps(a: Container, b: Container) -> int:
    """Edges between two containers in the DOM."""
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        n += 1
    return n


def minimum_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Max-flow from blocks with positive odds to blocks with negative ones; True for the source's side."""
    near: list[dict[int, float]] = [{} for _ in costs]
    for i, j, c in edges:
        near[i][j] = near[i].get(j, 0.0) + c
        near[j][i] = near[j].get(i, 0.0) + c
    excess, closed = list(costs), set()
    for source in [i for i, c in enumerate(costs) if c > 0]:
        while source not in closed and excess[source] > 1e-9:
            reached, queue, found = {source: -1}, deque([source]), None
            while queue and found is None:
                i = queue.popleft()
                for j, c in near[i].items():
                    if c > 1e-9 and j not in reached and j not in closed:
                        reached[j] = i
                        if excess[j] < -1e-9:
                            found = j
                            break
                        queue.append(j)
            if found is None:  # no path leads from here to a sink any more, and so none will lead through here
                closed.update(reached)
                break
            path, j = [], found
            while reached[j] >= 0:
                path.append((reached[j], j))
                j = reached[j]
            flow = min(excess[source], -excess[found], *(near[a][b] for a, b in path))
            excess[source] -= flow
            excess[found] += flow
            for a, b in path:
                near[a][b] -= flow
                near[b][a] += flow
    return [i in closed for i in range(len(costs))]


def main_text(html: str | None) -> str:
    found = blocks(html or "")
    if not found:
        return ""
    unmark_wrappers(found)
    any_good = any(b.where.good_tag for b in found)
    costs = [odds(b, any_good) for b in found]
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, NEXT / (1 + steps(found[i - 1].where, b.where))))
        holder = id(b.where.parent)
        if holder in last and last[holder] != i - 1:
            edges.append((last[holder], i, SAME))
        elif holder in last:
            edges.append((i - 1, i, SAME))
        last[holder] = i
    return "\n\n".join(b.text for b, keep in zip(found, minimum_cut(costs, edges), strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = pa.array([main_text(h) for h in batch.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), texts], ["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
