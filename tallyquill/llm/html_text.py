"""Main text of web pages: streaming parser events, line densities, content regions."""

from __future__ import annotations

import math
import re
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyquill.functions.markup import Events
from tallyquill.llm.common import text_of
from tallyquill.shipping import ship

#: Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
CONTAINERS = frozenset("article body div html main section table td th blockquote aside nav header footer form ul ol dl li".split())
NEVER = frozenset("head title script style noscript template nav header footer aside button select textarea label iframe object svg canvas dialog menu search option".split())
#: Elements that show no text of their own.
SILENT = frozenset("head title script style noscript template iframe object svg canvas".split())
#: Words in an element's class, id or role that mark what surrounds an article.
AROUND = frozenset(
    "ad ads adsbygoogle advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu "
    "nav navbar navigation newsletter notice notices notification pagination popup promo promoted related replies reply respond share sharing sidebar "
    "social sponsor sponsored subscribe toolbar widget complementary contentinfo search".split()
)
#: Of these, words that say so wherever they stand in a compound name; the others have to be its head.
ANYWHERE = frozenset("ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments cookie cookies disqus footer nav navbar newsletter sponsor sponsored".split())
#: Words behind the head of a compound name that say nothing of their own.
NEUTRAL = frozenset(
    "site page main top bottom left right upper lower primary secondary global local inner outer box bar block area section list item items unit slot zone group post article entry "
    "blog news story desktop mobile sticky fixed button buttons link links icon icons form input module panel row text title wrap wrapper container holder content body thread".split()
)
#: Words before one of the above by which an element tells of it and isn't it; of whole layouts; of an article.
TELLING = frozenset("has have no non not with without show shows hide hides toggle".split())
LAYOUT = frozenset("wrap wrapper container layout".split())
OWN = frozenset("article entry post story content".split())
#: Of the names above those of whole pages' parts; others may stand inside an article as well.
PAGE_PARTS = frozenset("breadcrumb breadcrumbs contentinfo footer header masthead menu nav navbar navigation sidebar toolbar".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
CONTROLS = frozenset("input select textarea button".split())
#: Characters of text a control that a form has to have for being more than a form.
FORM_TEXT = 100
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_SPACE = re.compile(r"\s+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SIGMA, REACH = 2.0, 6
KERNEL = [math.exp(-(i * i) / (2 * SIGMA * SIGMA)) for i in range(-REACH, REACH + 1)]
#: Share of the dense characters that the heaviest regions have to hold to be the page's content.
SHARE = 0.9


def surrounding_words(name: str) -> set[str]:
    """What a class name, id or role says of the surroundings of articles, if it names them.

    A compound name does so by its head, the last word that isn't neutral (``site-footer``, ``menu-item``),
    or by a word that does wherever it stands (``cookie-law``, ``disqus_thread``). ``social-policy`` doesn't, nor do
    names that tell of a part (``has-sidebar``) or of a layout (``content-sidebar-wrap``). The header of
    an article is ``own-header``.
    """
    words = [w.lower() for w in _WORDS.findall(name)]
    named = [i for i, w in enumerate(words) if w in AROUND]
    if not named or TELLING.intersection(words[: named[-1]]):
        return set()
    if "sidebar" in words and "content" in words and LAYOUT.intersection(words):
        return set()
    head = len(words) - 1
    while head > named[-1] and (words[head] in NEUTRAL or words[head].isdigit()):
        head -= 1
    found = {words[i] for i in named}
    if found == {"header"} and OWN.intersection(words):
        return {"own-header"}
    return found if head == named[-1] or found & ANYWHERE else set()


def surrounds(attrs: list[tuple[str, str | None]]) -> set[str]:
    """What the attributes say of an element that surrounds an article or isn't shown; empty for others."""
    found = set()
    for key, value in attrs:
        if key in ("class", "id", "role") and value:
            for name in value.split():
                found |= surrounding_words(name)
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and value and _HIDDEN.search(value):
            found.add("hidden")
    return found


class Lines(Events):
    """Collects lines: text between block borders, its count of tags, and the container around it.

    Containers are numbered in page order and know the one around them, so memory and time are in
    proportion to the page, however deep it nests.
    """

    def __init__(self) -> None:
        super().__init__()
        self.open: list[tuple[str, int, bool, bool]] = []  # tag, the innermost container from here on, shut out, heard for its headings
        self.count: dict[str, int] = {}  # open elements by tag
        self.borders: list[int] = []  # places in ``open`` of containers and of what a block closes
        self.shut = self.headed = 0
        self.forms: list[list[int]] = [[0, 0, 1]]  # controls, characters, whether it holds an article's parts; 0 is no form
        self.tag_of, self.parent = [""], [0]  # containers by number; 0 is the page
        self.around: list[int] = []  # containers that hold text of a page's parts
        self.heard = True
        self.parts: list[str] = []
        self.tags = 0
        self.linked = self.chars = 0
        self.lines: list[tuple[str, int, int, float]] = []
        self.form_of: list[int] = []  # by line

    @property
    def box(self) -> int:
        return self.open[-1][1] if self.open else 0

    @property
    def form(self) -> int:
        return len(self.forms) - 1 if self.count.get("form") else 0

    def end_line(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                self.lines.append((text, self.tags, self.box, self.linked / max(1, self.chars)))
                self.form_of.append(self.form)
            self.parts = []
        self.tags = self.linked = self.chars = 0

    def drop(self, at: int) -> None:
        for tag, _, shut, headed in self.open[at:]:
            self.shut -= shut
            self.headed -= headed
            self.count[tag] -= 1
        del self.open[at:]
        while self.borders and self.borders[-1] >= at:
            self.borders.pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.end_line()
            if tag != "br":
                for at in reversed(self.borders):
                    there = self.open[at][0]
                    if there == "p" or there == tag == "li" or there in ("dt", "dd") and tag in ("dt", "dd") or there == "head" and tag == "body":
                        self.drop(at)
                        break
                    if there in CONTAINERS:
                        break
        self.tags += 1
        if tag in CONTROLS and ("type", "hidden") not in attrs and self.form:
            self.forms[-1][0] += 1
        if tag in VOID:
            return
        named = surrounds(attrs) if attrs and tag not in ("html", "body", "article", "main", "form") else set()
        if tag == "form" and not self.form:  # forms don't nest
            self.forms.append([0, 0, 0])
        elif tag in ("article", "main", "h1") and self.form:
            self.forms[-1][2] = 1
        headed = tag == "header" and named <= {"header", "own-header"} or tag != "header" and bool(named) and named <= {"header", "own-header"} and tag not in NEVER
        headed = headed and ("own-header" in named or bool(self.count.get("article") or self.count.get("main")))
        shut = (tag in NEVER or bool(named)) and not headed
        self.headed += headed
        box = self.box
        if shut and not self.shut:
            self.heard, self.shut_in = tag not in PAGE_PARTS and PAGE_PARTS.isdisjoint(named), box
        self.shut += shut
        if tag in CONTAINERS:
            self.tag_of.append(tag)
            self.parent.append(box)
            box = len(self.parent) - 1
        if tag in CONTAINERS or tag in ("p", "dt", "dd", "head"):
            self.borders.append(len(self.open))
        self.count[tag] = self.count.get(tag, 0) + 1
        self.open.append((tag, box, shut, headed))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        elif tag in BLOCKS:
            self.end_line()

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.end_line()
        self.tags += 1
        if self.count.get(tag):
            at = next(i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag)
            self.drop(at)

    def handle_data(self, data: str) -> None:
        if self.headed and not any(self.count.get(h) for h in HEADINGS):
            return
        if not self.shut:
            self.parts.append(data)
            self.chars += len(data)
            linked = len(data) * bool(self.count.get("a"))
            self.linked += linked
            if self.form and not linked:
                self.forms[-1][1] += len(data.strip())
        elif not self.heard and data.strip():
            self.heard = True
            self.around.append(self.shut_in)

    def read(self, html: str) -> None:
        super().read(html)
        self.end_line()
        kept = [holds or chars > FORM_TEXT * controls for controls, chars, holds in self.forms]
        if not all(kept):
            self.lines = [x for x, form in zip(self.lines, self.form_of, strict=True) if kept[form]]


def dense(lines: list[tuple[str, int, int, float]]) -> tuple[list[float], list[float], float]:
    """The lines' smoothed and own text-to-tag ratios (linked text left out), and the threshold above which lines are dense."""
    ratio = [len(text) * (1 - linked) / max(1, tags) for text, tags, _, linked in lines]
    smooth = []
    for i in range(len(ratio)):
        lo, hi = max(0, i - REACH), min(len(ratio), i + REACH + 1)
        k = KERNEL[lo - i + REACH : hi - i + REACH]
        smooth.append(sum(a * b for a, b in zip(ratio[lo:hi], k, strict=True)) / sum(k))
    mean = sum(smooth) / len(smooth)
    spread = math.sqrt(sum((x - mean) ** 2 for x in smooth) / len(smooth))
    return smooth, ratio, min(spread, mean)


def regions(lines: list[tuple[str, int, int, float]]) -> list[range]:
    """The content regions: of the runs of dense lines the heaviest ones that hold ``SHARE`` of all dense text.

    Smoothing blurs the ends of a run: lines there that aren't dense themselves aren't of the region.
    """
    smooth, ratio, least = dense(lines)
    runs, weight = [], []
    for i, x in enumerate(smooth):
        if x >= least:
            if not runs or runs[-1].stop != i:
                runs.append(range(i, i))
            runs[-1] = range(runs[-1].start, i + 1)
    for n, r in enumerate(runs):
        own = [i for i in r if ratio[i] >= least] or r
        runs[n] = range(own[0], own[-1] + 1)
        weight.append(sum(len(lines[i][0]) for i in runs[n]))
    chosen, left = [], SHARE * sum(weight)
    for n in sorted(range(len(runs)), key=lambda n: (-weight[n], n)):
        if chosen and left <= 0:
            break
        chosen.append(runs[n])
        left -= weight[n]
    return sorted(chosen, key=lambda r: r.start)


def enclosing(boxes: set[int], parent: list[int]) -> int:
    """The innermost container around all of some; one around another has the smaller number."""
    left = [-n for n in boxes]
    heapify(left)
    while True:
        n = -left[0]
        while left and -left[0] == n:
            heappop(left)
        if not left:
            return n
        heappush(left, -parent[n])


def outermost(kind: str, tag_of: list[str], parent: list[int]) -> list[int]:
    """For each container the outermost one of a kind that it is in, 0 where there is none."""
    found = [0] * len(parent)
    for n in range(1, len(parent)):
        found[n] = found[parent[n]] or (n if tag_of[n] == kind else 0)
    return found


def main_text(html: str) -> str:
    """The lines of the content, joined by a space.

    Elements that surround an article, by their tag or by a name among their class, id or role, give
    no lines at all, nor do forms whose controls outweigh their text (a form that holds an article, or more
    text than its controls account for, is the page's frame). An article's own header gives its headings. Runs of lines whose smoothed text-to-tag ratio is high are the content regions.
    If most of their text lies in ``article`` elements (else, in ``main``), the outermost of these that
    hold a region are the content; else the innermost container of all regions is. The container
    of the content is then widened to the outermost one that adds neither a part of the whole page
    (a menu, header, footer or sidebar) nor a line of links. So headlines, short paragraphs and what stands before, between
    and after long sections, lists or quotations stay.
    """
    p = Lines()
    p.read(html)
    if not p.lines:
        return ""
    chosen = [i for r in regions(p.lines) for i in r]
    total = sum(len(p.lines[i][0]) for i in chosen)
    best = enclosing({p.lines[i][2] for i in chosen}, p.parent)
    for kind in ("article", "main"):
        inside = outermost(kind, p.tag_of, p.parent)
        held = [i for i in chosen if inside[p.lines[i][2]]]
        if 2 * sum(len(p.lines[i][0]) for i in held) > total:
            parts = {inside[p.lines[i][2]] for i in held}
            if len(parts) > 1:
                return " ".join(text for text, _, box, _ in p.lines if inside[box] in parts)
            best = parts.pop()
            break
    counts = [[0] * len(p.parent) for _ in range(2)]  # parts of the page and lines of links by container, those inside it included
    for n in p.around:
        counts[0][n] += 1
    for _, _, box, linked in p.lines:
        counts[1][box] += linked > 0.5
    for c in counts:
        for n in range(len(c) - 1, 0, -1):
            c[p.parent[n]] += c[n]
    up = best
    while up:
        up = p.parent[up]
        if all(c[up] == c[best] for c in counts):
            best = up
    within = [False] * len(p.parent)
    for n in range(len(p.parent)):
        within[n] = n == best or bool(n) and within[p.parent[n]]
    return " ".join(text for text, _, box, _ in p.lines if within[box])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: id, url, ``text`` (empty if none) and ``n_chars``, its code points.

    Null html counts as empty, which gives an empty text; so does a page of nothing but what
    surrounds an article. Pages are read whole, in time and memory in proportion to their length, and
    broken markup is read as browsers do. Rows are independent, so ties and repeated rows need no
    rule. An empty table gives no rows. Other columns are not read.
    """
    ship(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), text_of(html_col).alias("html"))
    schema = T.StructType([rows.schema["id"], rows.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema.names)

    return rows.mapInArrow(run, schema).withColumnsRenamed({"id": id_col, "url": url_col})


def op10_html_text(spark, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
