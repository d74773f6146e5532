"""Main text of web pages: flat blocks judged by a decision tree.

A page is cut into flat text blocks at block-level tags.  Each block has its word
count and link density, those of its neighbours, its tag kind, and what the
enclosing containers say (content, boilerplate, nothing).  A decision tree decides
which blocks are main text.

Trees are trained by Spark on a small labelled table: blocks of about
``sample_pages`` pages that mark their article, plus a few hand-labelled rows.
One tree judges pages with such marks.  For pages without, a second tree learns
from the same blocks with the article's mark hidden, and with all marks hidden: it
goes by lengths, link densities and whatever boilerplate is marked.  The
hand-labelled rows weigh as much there as all sampled blocks: sampled pages may
share one layout, which says little about others.

Defined cases: null or empty html gives empty text; a page without any tag is one
block; unclosed comments, scripts and tags end with the page; repeated rows each
get a row; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sampled, stored
from .trees import evaluate, export

SAMPLE_PAGES = 400
DEPTH = 8

# --- fixed values: HTML's elements by role ---
SKIPPED = ("script", "style", "noscript", "template", "title", "textarea", "select", "button", "svg", "math", "iframe", "object")
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary
table tbody td tfoot th thead tr ul""".split())
CONTAINERS = frozenset("article aside body details dialog div dl fieldset figure footer form header main menu nav ol section table ul".split())
BOILERPLATE = frozenset("aside dialog footer form menu nav".split())
BOILER_HINT = re.compile(r"(?i)(?:^|[\s_-])(?:nav|navbar|navigation|menu|header|footer|sidebar|side|aside|ads?|advert\w*|sponsor\w*|promo\w*|banner|"
                         r"cookies?|consent|notice|gdpr|comments?|disqus|replies|reply|share|sharing|social|related|recommend\w*|newsletter|subscribe|"
                         r"signup|login|popup|modal|overlay|breadcrumbs?|pagination|toolbar|widget|copyright)(?:$|[\s_-])")
FRAME_WORDS = frozenset("area bar block body bottom box button buttons card container content foot head icons inner item items link links list main "
                        "outer panel post posts row section site slot top unit wrap wrapper".split())
CONTENT_HINT = re.compile(r"(?i)(?:^|[\s_-])(?:article|content|post|entry|story|main|body|text)(?:$|[\s_-])")

ATTRS = r"(?:[^<>\"'/]++|/(?!>)|\"[^\"]*\"|'[^']*')*+"
#: A skipped element's name ends before white space, / or >; the element ends at its />, else at its end tag, else with the page.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)"
                   r"|<(?P<skip>" + "|".join(SKIPPED) + r")(?=[\s/>])" + ATTRS + r"(?:/>|>.*?(?:</(?P=skip)\s*>|\Z))"
                   r"|<(?P<odd>" + "|".join(SKIPPED) + r")(?=[\s/>])[^>]*>.*?(?:</(?P=odd)\s*>|\Z)"
                   r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9]*)(?P<attrs>(?:[^<>\"']++|\"[^\"]*\"|'[^']*')*+)/?(?:>|\Z)"
                   r"|</?[a-zA-Z!?][^>]*(?:>|\Z)|<!?\Z", re.S | re.I)
NAMES = re.compile(r"""(?i)(?<![\w-])(?:class|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
HINTS = re.compile(r"""(?i)\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")

FEATURES = ("words", "links", "prev_words", "prev_links", "next_words", "next_links", "heading", "item", "inside", "prev_inside",
            "next_inside", "marked")
#: Hand-labelled blocks of pages without marks: words, link density of the block, of the one before, of the one after, heading, item, main text.
LABELLED = (
    (62, 0.0, 48, 0.0, 55, 0.02, 0, 0, 1), (35, 0.05, 70, 0.0, 28, 0.0, 0, 0, 1), (120, 0.01, 9, 0.0, 80, 0.0, 0, 0, 1),
    (18, 0.0, 66, 0.0, 41, 0.0, 0, 0, 1), (9, 0.0, 3, 1.0, 75, 0.0, 1, 0, 1), (7, 0.0, 55, 0.0, 60, 0.0, 1, 0, 1),
    (58, 0.0, 2, 1.0, 64, 0.01, 0, 0, 1), (40, 0.03, 1, 1.0, 22, 0.0, 0, 0, 1), (90, 0.02, 2, 0.5, 70, 0.0, 0, 0, 1),
    (25, 0.0, 40, 0.0, 33, 0.0, 0, 1, 1), (45, 0.1, 30, 0.0, 4, 1.0, 0, 0, 1), (4, 0.0, 52, 0.0, 47, 0.0, 0, 0, 1),
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 0), (2, 1.0, 1, 1.0, 2, 1.0, 0, 1, 0), (3, 1.0, 2, 1.0, 40, 0.0, 0, 1, 0),
    (12, 0.9, 3, 1.0, 14, 0.8, 0, 0, 0), (6, 0.5, 4, 1.0, 3, 1.0, 0, 0, 0), (8, 0.0, 2, 1.0, 5, 0.6, 0, 0, 0),
    (10, 0.3, 50, 0.0, 0, 0.0, 0, 0, 0), (5, 1.0, 60, 0.0, 2, 1.0, 0, 1, 0), (2, 0.0, 1, 1.0, 1, 1.0, 0, 0, 0),
)


def _judge(tag: str, attrs: str, above: int) -> int:
    """What an opened container says about its blocks: 1 main text, -1 boilerplate, 0 nothing new."""
    if tag in ("article", "main"):
        hint = " ".join(x for m in HINTS.findall(attrs) for x in m)
        return -1 if re.search(r"(?i)comment|reply|related|promo|teaser", hint) else 1
    if tag in BOILERPLATE or tag == "header" and above != 1:
        return -1
    if attrs and above == 1:
        # inside main text a name must say nothing else: share-buttons, not social-impact
        names = " ".join(x for m in NAMES.findall(attrs) for x in m).lower().split()
        return -1 if any(BOILER_HINT.search(n) and all(BOILER_HINT.search(w) or w in FRAME_WORDS for w in re.split(r"[-_]+", n) if w) for n in names) else 0
    if attrs:
        hint = " ".join(x for m in HINTS.findall(attrs) for x in m)
        if hint and BOILER_HINT.search(hint) and not (tag == "body" or above == 0 and CONTENT_HINT.search(hint)):
            return -1
    return 0


def blocks_of(page: str) -> tuple[list[str], np.ndarray]:
    """The page's blocks in order, and (words, link words, heading, item, inside) of each."""
    texts, rows = [], []
    parts: list[str] = []        # of the open block: text runs
    linked = heading = item = 0
    in_link = False
    stack: list[tuple[str, int]] = []   # open containers and what holds inside them
    inside = 0

    def close():
        nonlocal linked
        if parts:
            words = " ".join(parts).split() if len(parts) == 1 else "".join(parts).split()
            if words:
                texts.append(" ".join(words))
                rows.append((len(words), min(linked, len(words)), heading, item, inside))
            parts.clear()
        linked = 0

    def add(run: str):
        nonlocal linked
        if run:
            run = entities.unescape(run) if "&" in run else run
            parts.append(run)
            if in_link:
                linked += len(run.split())

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            add(page[at:m.start()])
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue             # comment, skipped element or broken tag
        tag, ends = tag.lower(), m["end"]
        if tag == "a":
            in_link = not ends
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCK:
            close()
            in_link = False
            if tag in CONTAINERS:
                if not ends:
                    own = _judge(tag, m["attrs"], inside)
                    inside = own or inside
                    stack.append((tag, inside))
                elif any(t == tag for t, _ in stack):
                    while stack.pop()[0] != tag:
                        pass
                    inside = stack[-1][1] if stack else 0
            heading = int(not ends and len(tag) == 2 and tag[0] == "h" and tag[1].isdigit())
            item = int(not ends and tag in ("li", "option", "dd", "dt"))
    add(page[at:])
    close()
    return texts, np.array(rows, np.float64).reshape(-1, 5)


def features(rows: np.ndarray, least: int = 2, most: int = 2) -> np.ndarray:
    """The feature matrix of one page's blocks, in the order of FEATURES; marks
    from ``least`` down and from ``most`` up are hidden."""
    n = len(rows)
    density = rows[:, 1] / np.maximum(rows[:, 0], 1)
    inside = np.where((rows[:, 4] <= -least) | (rows[:, 4] >= most), 0.0, rows[:, 4])
    shift = lambda v, by: np.concatenate((np.zeros(1), v[:-1])) if by > 0 else np.concatenate((v[1:], np.zeros(1)))
    marked = np.full(n, float((inside == 1).any()))
    return np.column_stack((rows[:, 0], density, shift(rows[:, 0], 1), shift(density, 1), shift(rows[:, 0], -1), shift(density, -1),
                            rows[:, 2], rows[:, 3], inside, shift(inside, 1), shift(inside, -1), marked)) if n else np.empty((0, len(FEATURES)))


def _hand_labelled() -> list[tuple[float, ...]]:
    return [(float(w), d, float(pw), pd, float(nw), nd, float(h), float(i), 0.0, 0.0, 0.0, 0.0, float(y), 1.0)
            for w, d, pw, pd, nw, nd, h, i, y in LABELLED]


def learn(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample_pages: int = SAMPLE_PAGES) -> tuple[tuple, tuple]:
    """Trees for marked and other pages, from the blocks of about ``sample_pages`` of the
    distinct pages (id and html), chosen by a hash of both."""
    spark = pages.sparkSession
    rows = pages.where(F.col(f"`{html_col}`").isNotNull()).select(F.col(f"`{html_col}`").alias("h"), F.col(f"`{id_col}`").alias("id"))
    part = sampled(rows, sample_pages, "html").select("h")
    schema = ", ".join(f"{f} double" for f in (*FEATURES, "label", "hand"))

    def label(batches):
        for b in batches:
            for page in b.column(0):
                _, rows = blocks_of(page.as_py())
                if len(rows) and (rows[:, 4] == 1).any():     # only pages that mark their article
                    y = (rows[:, 4] == 1).astype(float)
                    table = np.vstack([np.column_stack((features(rows, *hide), y, np.zeros(len(y)))) for hide in ((2, 2), (2, 1), (1, 1))])
                    yield pa.record_batch([pa.array(c) for c in table.T], [*FEATURES, "label", "hand"])

    found = part.mapInArrow(label, schema)
    table = stored(found.unionByName(spark.createDataFrame(_hand_labelled(), schema)).coalesce(4), "html-labelled")
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table)
    grow = lambda part: export(DecisionTreeClassifier(maxDepth=DEPTH, weightCol="weight", seed=7).fit(part))
    marked, bare = ready.where("marked = 1").withColumn("weight", F.lit(1.0)), ready.where("marked = 0")
    taken = bare.where("hand = 0").count()
    bare = bare.withColumn("weight", F.when(F.col("hand") == 1, max(1.0, taken / len(LABELLED))).otherwise(1.0))
    other = grow(bare)
    return (grow(marked) if marked.limit(1).count() else other), other


def main_text(page: str | None, trees: tuple[tuple, tuple]) -> str:
    texts, rows = blocks_of(page or "")
    if not texts:
        return ""
    marked, bare = trees
    keep = evaluate(marked if (rows[:, 4] == 1).any() else bare, features(rows)) > 0.5
    return "\n".join(t for t, k in zip(texts, keep.tolist()) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", trees: tuple[tuple, tuple] | None = None,
            sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """(id, url, text, n_chars) of every row of ``pages``."""
    trees = trees or learn(pages, id_col, html_col, sample_pages)
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    kinds = dict(rows.dtypes)

    def each(batches):
        for b in batches:
            found = [main_text(x.as_py(), trees) for x in b.column(2)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                                  ["id", "url", "text", "n_chars"])

    return rows.mapInArrow(each, f"id {kinds['id']}, url {kinds['url']}, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
