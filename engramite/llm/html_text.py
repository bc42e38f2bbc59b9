"""Main text of web pages, by paths that the pages of a host agree on.

Method: consensus host paths. A first pass over the pages scores the containers of each (how much text they hold near
by, how much of it is links or labelled as something else, what their tags and classes say) and gives the path of the
best one: the tags and classes from the body down, numbers and codes in classes made alike. Spark counts these votes by
host and path; a path that gets a share of at least ``SHARE`` of a host's votes is a winning path of it, so there are
at most 1 / SHARE of them. A second pass extracts each page again from the container whose path's share of votes times
own score is the greatest; where no winning path is on a page, or the host is not known, its own best container stays.

Within the container menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments go,
by tag, role, class or id; of a header inside an article the headings stay. Character references are decoded, white
space in a block becomes one space, blocks are trimmed, and those with text are joined by a line feed.

Edge cases: a null or empty page, and one without text, give an empty text; a page that is plain text is one container;
pages that end early, tags that are never closed, stray end tags, unquoted attributes and quotes that are never closed
are read as browsers do or nearly; null urls and urls without a host have no say and no consensus; rows with a null id
and repeated rows are pages of their own (each votes); an empty table stays empty; further columns are not read.
"""

from __future__ import annotations

import functools
import html as references
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from engramite.llm._batches import give_back, id_type, short_batches, slices
from engramite.session import scratch_path

#: The share of a host's votes that makes a path a winning one.
SHARE = 0.02
#: Bytes of winning paths up to which every task gets all of them; beyond, they are joined by host and salt.
BROADCAST_BYTES = 8 << 20
SALTS = 32

# The tags of HTML by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr keygen frame".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body html caption legend option tbody td tfoot th thead tr li dd dt".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
HOLDERS = frozenset("article aside blockquote center details div fieldset footer form header main nav ol section table td ul".split())
CANDIDATES = frozenset("article center div main section table td".split())
ALWAYS_DULL = frozenset("nav aside footer menu noscript template button select svg canvas audio video object dialog datalist search form".split())
#: What the start of a tag closes, and what a search for it does not go beyond.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
}
SCOPE = frozenset("table td th caption template".split())

#: Words of classes, ids and roles that tell what is no article.
DULL_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs complementary consent contentinfo cookie cookies copyright dialog discussion disqus "
    "disclaimer footer foot gdpr login masthead menu modal nav navbar navigation newsletter notice notification overlay pager pagination paywall popup "
    "privacy promo promotion promoted recommended recommendations related respond rail search share sharing shares sidebar signup skip social sponsor sponsored "
    "subscribe subscription toolbar topbar widget widgets alert announcement".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist reply replies discussion disqus respond".split())
HEAD_WORDS = frozenset({"header", "head"})
GOOD_WORDS = frozenset("article articles body content entry main page post story text".split())
#: Those of them that are of the article itself: a header in such an element is the article's.
OWN_WORDS = frozenset("article content entry post story".split())
#: A name that begins with one of these speaks of the layout around it.
ABOUT_LAYOUT = frozenset("no has with without is hide show".split())
_JOINED = re.compile(r"(?:menu|nav|navbar|sidebar|footer)$|^(?:comment|advert|sponsor|cookie|sidebar|navbar|footer|newsletter)")

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]{0,4096}+\"|'[^']{0,4096}+')*+|[^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[a-z]+")
_CODE = re.compile(r"(?=[a-z]*\d)[0-9a-z]{6,}|\d+")

KEEP, DULL, HEAD = 0, 1, 2


@functools.lru_cache(8192)
def label(tag: str, attributes: str) -> tuple[str, int, bool, int]:
    """(step of the path, what becomes of the element's text, whether it is of comments, whether its names speak for it: 2 if they name an article)."""
    names = {k.lower(): (a or b or c).lower() for k, a, b, c in _NAMES.findall(attributes)}
    classes = names.get("class", "").split()
    step = ".".join([tag, *dict.fromkeys(_CODE.sub("#", c) for c in classes)])
    state, comments, good = KEEP, False, 0
    for name in [*classes, *names.get("id", "").split(), *names.get("role", "").split()]:
        words = _WORDS.findall(name)
        if not words or words[0] in ABOUT_LAYOUT:
            continue
        if any(w in COMMENT_WORDS or w.startswith("comment") for w in words):
            state, comments = DULL, True
        elif any(w in DULL_WORDS or _JOINED.search(w) for w in words):
            state = DULL if state == KEEP or state == HEAD else state
        elif HEAD_WORDS & set(words):
            state = HEAD if state == KEEP else state
        elif GOOD_WORDS & set(words):
            good = max(good, 2 if OWN_WORDS & set(words) else 1)
    if tag == "header":
        state = HEAD if state == KEEP else state
    if tag in ("article", "main") and not comments and state != DULL:
        state = KEEP
    return step, DULL if tag in ALWAYS_DULL else state, comments, good


class Page:
    """A page as boxes (elements that hold or label text) and blocks of text."""

    def __init__(self, text: str) -> None:
        self.tags, self.parents, self.paths, self.labels = ["body"], [-1], ["body"], [("body", KEEP, False, 0)]
        self.blocks: list[list[tuple[int, str, bool, bool]]] = []
        self._read(text)
        self._settle()

    def _read(self, text: str) -> None:
        stack: list[tuple[str, int]] = []  # open elements: tag, box before it
        block: list[tuple[int, str, bool, bool]] = []
        box, link, heading, at = 0, 0, False, 0

        def cut() -> None:
            nonlocal block
            if block:
                self.blocks.append(block)
                block = []

        def close(depth: int) -> None:
            nonlocal box, link, heading
            if any(tag in BLOCK for tag, _ in stack[depth:]):
                cut()
            box = stack[depth][1]
            heading = heading and not any(tag in HEADING for tag, _ in stack[depth:])
            del stack[depth:]
            link = link if link <= len(stack) else 0

        def above(tags, borders) -> int:
            """Depth of the innermost open element of these tags, or -1."""
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in tags:
                    return depth
                if stack[depth][0] in borders:
                    return -1
            return -1

        find = _TOKEN.search
        end = len(text)
        while at < end:
            token = find(text, at)
            stop = token.start() if token else end
            if stop > at and not (piece := text[at:stop]).isspace():
                block.append((box, piece, link > 0, heading))
            elif stop > at and block:
                block.append((box, " ", False, heading))
            if not token:
                break
            at, tag = token.end(), token[2]
            if tag is None:
                continue
            tag = tag.lower()
            if token[1]:
                if tag in ("html", "body", "head"):
                    continue
                if tag in BLOCK:
                    depth = above((tag,), SIBLINGS.get(tag, ((), SCOPE))[1] if tag not in SCOPE else ({"table"} if tag != "table" else ()))
                else:
                    depth = above((tag,), BLOCK)
                if depth >= 0:
                    close(depth)
                elif tag in BLOCK:
                    cut()
                if tag == "a":
                    link = 0
                continue
            attributes = token[3]
            if tag in RAW:
                if not attributes.endswith("/") or tag == "script":
                    done = re.compile(f"</{tag}(?=[\\s/>]|\\Z)[^>]*(?:>|\\Z)", re.I).search(text, at)
                    at = done.end() if done else end
                continue
            if tag in VOID:
                if tag == "hr":
                    cut()
                elif tag == "br" and block:
                    block.append((box, " ", False, heading))
                continue
            if tag in ("html", "body", "head"):
                continue
            if tag in BLOCK:
                if tag in CLOSES_P and (depth := above(("p",), SCOPE | {"button"})) >= 0:
                    close(depth)
                if tag in SIBLINGS and (depth := above(*SIBLINGS[tag])) >= 0:
                    close(depth)
                cut()
            if tag == "a":
                link = len(stack) + 1
            if tag in HEADING:
                heading = True
            stack.append((tag, box))
            named = _NAMES.search(attributes) is not None
            about = label(tag, attributes if named else "")
            if tag in HOLDERS or about[1]:
                self.tags.append(tag)
                self.parents.append(box)
                self.paths.append(f"{self.paths[box]}/{about[0]}")
                self.labels.append(about)
                box = len(self.tags) - 1
            if attributes.endswith("/") and tag in ("svg", "path"):
                close(len(stack) - 1)
        cut()

    def _settle(self) -> None:
        """What becomes of each box's text, once it is known what the boxes hold."""
        count = len(self.tags)
        size, holds = [0] * count, [False] * count
        for block in self.blocks:
            for box, piece, _, heading in block:
                size[box] += len(piece)
                holds[box] = holds[box] or heading and self.tags[box] != "header"
        for box in range(count - 1, 0, -1):
            size[self.parents[box]] += size[box]
            holds[box] = holds[box] or self.tags[box] in ("main", "article")  # or a heading that is not of a header
            holds[self.parents[box]] |= holds[box] and self.tags[box] != "header"
        self.states = [KEEP] * count
        inside = [False] * count
        for box in range(1, count):
            tag, up, (_, state, comments, good) = self.tags[box], self.parents[box], self.labels[box]
            inside[box] = inside[up] or tag in ("article", "main") or good == 2
            if state == DULL and not comments and tag not in ("nav", "aside", "footer", "noscript") and holds[box] and 2 * size[box] > size[0]:
                state = KEEP  # what is labelled is around the article, not in it
            if state == HEAD:
                state = KEEP if tag != "header" and 2 * size[box] > size[0] else HEAD if inside[box] else DULL
            self.states[box] = DULL if DULL in (state, self.states[up]) else max(state, self.states[up])

    def scores(self) -> list[float]:
        """How much of an article each box looks to be; 0 for those that cannot be one."""
        count = len(self.tags)
        near, text, links, other, heads = [0.0] * count, [0] * count, [0] * count, [0] * count, [False] * count
        for block in self.blocks:
            for box, piece, link, heading in block:
                n = len(piece)
                if self.states[box] == KEEP or self.states[box] == HEAD and heading:
                    if link:
                        links[box] += n
                    else:
                        near[box] += n
                        text[box] += n
                    heads[box] |= heading
                else:
                    other[box] += n
        for box in range(count - 1, 0, -1):
            up = self.parents[box]
            near[up] += near[box] * (0.85 if self.tags[box] in CANDIDATES else 1)
            text[up] += text[box]
            links[up] += links[box]
            other[up] += other[box]
            heads[up] |= heads[box]
        out = [0.0] * count
        for box in range(count):
            tag = self.tags[box]
            if text[box] and (not box or tag in CANDIDATES and self.states[box] == KEEP):
                weight = {"article": 1.6, "main": 1.3}.get(tag, 1.0) if box else 0.7
                weight *= (1.25 if self.labels[box][3] else 1) * (1.4 if heads[box] and box else 1)
                out[box] = near[box] * weight * text[box] / (text[box] + links[box] + 0.2 * other[box])
        return out

    def best(self) -> str | None:
        """The path of the best box."""
        scores = self.scores()
        box = max(range(len(scores)), key=scores.__getitem__)
        return self.paths[box] if scores[box] > 0 else None

    def text(self, winning: dict[str, float] | None = None) -> str:
        """The text of the box that its own score and the share of votes of its path choose together."""
        scores = self.scores()
        told = [s * (winning or {}).get(p, 0.0) for s, p in zip(scores, self.paths)]
        chosen = told if any(told) else scores
        top = max(range(len(chosen)), key=chosen.__getitem__)
        if not chosen[top]:
            return ""
        within = [False] * len(self.tags)
        within[top] = True
        for box in range(top + 1, len(within)):
            within[box] = within[self.parents[box]]
        out = []
        for block in self.blocks:
            parts = [references.unescape(p) if "&" in p else p for box, p, _, heading in block if within[box] and (self.states[box] == KEEP or self.states[box] == HEAD and heading)]
            line = " ".join("".join(parts).split())
            if line:
                out.append(line)
        return "\n".join(out)


def host(url: Column) -> Column:
    """The host of an absolute url in lower case, or null."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def vote(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, votes): how many pages of each host have their best container at the path."""
    short_batches(pages.sparkSession)
    frame = pages.select(host(F.col(url_col).cast("string")).alias("host"), F.col(html_col).cast("string").alias("text")).where("host is not null and text <> ''")
    arrow = to_arrow_schema(StructType.fromDDL("host string, path string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                paths = [Page(t).best() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(paths, pa.string())], schema=arrow)
            del batch
            give_back()

    return frame.mapInArrow(run, "host string, path string").where("path is not null").groupBy("host", "path").agg(F.count("*").alias("votes"))


def winning_paths(votes: DataFrame, share: float = SHARE) -> DataFrame:
    """(host, paths): the paths with at least this share of a host's votes, each with its share."""
    totals = votes.groupBy("host").agg(F.sum("votes").alias("total"))
    part = votes.join(totals, "host").withColumn("share", F.col("votes") / F.col("total")).where(F.col("share") >= share)
    return part.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("path", "share"))).alias("paths"))


def extract(pages: DataFrame, share: float = SHARE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(id, url, text, n_chars) of every page. The winning paths are written once to the shared folder."""
    spark, path = pages.sparkSession, scratch_path(pages.sparkSession, "host-paths")
    winning_paths(vote(pages, url_col, html_col), share).write.parquet(path)
    rules = spark.read.parquet(path)
    size = rules.agg(F.sum(F.length("host") + F.length(F.concat_ws("", F.map_keys("paths"))) + 64)).first()[0] or 0
    url = F.col(url_col).cast("string")
    frame = pages.select(F.col(id_col).alias("id"), url.alias("url"), F.col(html_col).cast("string").alias("text"), host(url).alias("host"))
    if size <= broadcast_bytes:
        frame = frame.join(F.broadcast(rules), "host", "left")
    else:
        salted = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        frame = frame.withColumn("salt", F.pmod(F.xxhash64("url", "text"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    schema = f"{id_col} {id_type(pages, id_col)}, {url_col} string, text string, n_chars long"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = [Page(t).text(dict(w or ())) if t else "" for t, w in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=arrow)
            del batch
            give_back()

    short_batches(spark)
    return frame.select("id", "url", "text", "paths").mapInArrow(run, schema)
