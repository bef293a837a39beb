"""Main text of web pages by site style trees.

All pages of a host are merged into one tree whose nodes are element paths (tag, class and id from
the root, equal siblings as one). For each node the tree counts in how many pages it occurs, which
sequences of children it has there (its presentation styles), and in how many pages each of its text
blocks occurs (its content). A node is important if its styles or its contents vary from page to
page: presentation importance is the entropy of the styles and content importance one minus the mean
entropy of the blocks, both to the base of the number of pages. A branch combines its own importance
with that of its children, which weigh more the more children there are; a mere wrapper of one is as
important as that, however many are nested. Branches of low importance
are cut from every page of the host. Elements whose tag, role, class or id says that they are not
the article are cut as well, which also serves hosts with few pages, where entropy says nothing. If a
page has an article or main element, only that is read. Names are weaker evidence than tags: a name that
only qualifies (with-sidebar, category-social, search-results) does not count, and a named branch is
kept if it holds the page's article or most of its text, or if nothing else is there.

A branch that was seen in at least ``least_pages`` pages is cut wherever it is. One seen in fewer, two
at least, is weaker evidence, the more so the fewer they are: its importance has to be lower, and it
stays in a page of whose text such branches hold half or more (copies of an article on a small host).

Inside the article a paragraph or heading is only cut for the name of an advert, a notice of cookies
or a discussion. Where two or more article elements hold less than a third of a page's text, they are
teasers, and the text is what stands beside them.

Counts are combined per task before the shuffle, so a host with a third of all pages is no problem;
the cut branches are one short list per host.

Nulls: null html gives an empty text; a page without a url is a host of its own kind (null hosts are
merged). If everything of a page would be cut for low importance, its text is kept. Markup that does
not close, ends early or is not HTML at all is read as far as it goes; the time a page takes grows with
its length, however long, deep or hostile it is. Repeated rows are pages of their own. Other columns
play no part. Empty tables give empty results.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator, Set
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import stash
from .common import column_or_null

LEAST_PAGES = 8
LOW = 0.15
DECAY = 0.9
# Cut branches are broadcast up to this number (16 bytes each) and joined by host beyond.
BROADCAST_BRANCHES = 200_000
COUNTED = 400_000

# A tag is read with its quotes up to 400 of them, else up to the next bracket, so that a quote that is
# never closed does not make every later tag look for its end again.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>\"']++|\"[^\"]*+\"|'[^']*+'){0,400}+)>"
    r"|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>|\Z", re.I) for t in ("script", "style", "xmp", "iframe", "noembed", "noframes", "textarea", "title")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section select summary table tbody td tfoot th "
    "thead tr ul".split()
)
_CLOSES_P = _BLOCK - {"option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html", "head"}
_SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_NOISE_TAGS = frozenset(
    "nav footer aside form script style noscript template head button select option iframe svg object canvas menu dialog "
    "textarea title xmp noembed noframes audio video map datalist fieldset label".split()
)
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_NOISE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner nav navbar navigation menu "
    "menubar breadcrumb breadcrumbs footer sidebar sidebars aside cookie cookies consent gdpr notice notices popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended comments comment commentlist "
    "respond reply replies disqus pagination pager widget widgets toolbar skip masthead form search".split()
)
_TOP_NAMES = frozenset({"header", "topbar"})
_MAIN = frozenset({"article", "main"})
_QUALIFIES = frozenset("with has no without is category tag".split())
_CONTENT = frozenset("results work works layout page".split())
_TALK = frozenset("comments comment commentlist respond reply replies disqus".split())
# Names that count in an article's paragraphs and headings, and words that make a name a phrase.
_STRONG = _TALK | frozenset("ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo cookie cookies consent gdpr".split())
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
_PHRASE = frozenset("a an the of on for in to and at by from about or as".split())
_SPLIT_NAME = re.compile(r"[^a-z]+")


def _named(attributes: str) -> tuple[str, frozenset[str], bool]:
    """Signature (class and id without numbers), words of class and id, and whether an element is hidden or out of the article by role."""
    label, names, out = "", set(), False
    for key, value in _ATTRIBUTE.findall(attributes):
        key = key.lower()
        value = value.strip("\"'").lower()
        if key in ("class", "id"):
            words = [w for w in _SPLIT_NAME.split(value) if w]
            for name in value.split():
                parts = [w for w in _SPLIT_NAME.split(name) if w]
                phrase = len(parts) > 2 and not _PHRASE.isdisjoint(parts)
                if parts and not phrase and not (len(parts) > 1 and (parts[0] in _QUALIFIES or parts[-1] in _CONTENT)):
                    names.update(parts)
            label += ("." if key == "class" else "#") + "-".join(words)
        elif key == "role":
            out |= value in _NOISE_ROLES
            if value in ("main", "article"):
                names.add("role-main")
        elif key == "hidden" or (key == "aria-hidden" and value == "true"):
            out = True
        elif key == "style" and "display:none" in value.replace(" ", ""):
            out = True
    return label, frozenset(names), out


_named_memory: dict[str, tuple[str, frozenset[str], bool]] = {}


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


@dataclass(slots=True)
class _Block:
    """A block's text, its element path, whether it is cut by tag or name, in the article, in a branch to cut, in a weak one."""

    text: str
    path: int
    noise: bool
    main: bool
    cut: bool
    weak: bool


class Page:
    """Blocks of a page in order, and the element paths they have.

    ``cut`` and ``weak`` are paths of branches of low importance. ``children``: path to the sequence of
    its children's signatures.
    """

    def __init__(self, source: str, styles: bool = False, cut: Set[int] = frozenset(), weak: Set[int] = frozenset()):
        self.blocks: list[_Block] = []
        self.children: dict[int, list[str]] = {}
        self.parent: dict[int, int] = {}
        self.has_main = False
        self.articles = 0
        # Named branches: whether their name is that of a discussion. Per block those it is in, and how many of them the article is in.
        talk: list[bool] = []
        inside: list[tuple[tuple[int, ...], int]] = []
        root = _hash("")
        # open elements: tag, path, noise, in article, words to drop from the block around, named branches, how many around the article, cut, weak
        stack: list[tuple] = [("", root, False, False, False, (), 0, root in cut, root in weak)]
        # places of open elements by tag, and of those that are blocks
        opened: dict[str, list[int]] = {}
        fences: list[int] = [0]
        held: list[str] = []
        at, end, last = 0, len(source), source.rfind(">")

        def flush() -> None:
            if held:
                text = " ".join("".join(held).split())
                held.clear()
                if text:
                    _, path, noise, main, _, named, around, low, weakly = stack[-1]
                    self.blocks.append(_Block(text, path, noise, main, low, weakly))
                    inside.append((named, around))

        def push(element: tuple) -> None:
            opened.setdefault(element[0], []).append(len(stack))
            if element[0] in _BLOCK:
                fences.append(len(stack))
            stack.append(element)

        def close(down_to: int) -> None:
            if fences[-1] >= down_to:
                flush()
            while len(stack) > down_to:
                opened[stack.pop()[0]].pop()
            while fences[-1] >= down_to:
                fences.pop()

        def place(tags) -> int:
            """Place of the innermost open element with one of the tags; 0 if there is none."""
            return max((opened[t][-1] for t in tags if opened.get(t)), default=0)

        while at < end:
            match = _TOKEN.search(source, at) if at <= last else None
            begin = match.start() if match else end
            if at > last:  # no more tags; a comment may still open
                comment = source.find("<!--", at)
                begin = comment if comment >= 0 else end
            if begin > at and not stack[-1][4]:
                part = source[at:begin]
                held.append(html.unescape(part) if "&" in part else part)
            if not match:
                break
            at = match.end()
            closing, tag, attributes = (match[1], match[2], match[3]) if match[2] else (match[4], match[5], match[6])
            if not tag:
                continue
            tag = tag.lower()
            if closing:
                found = place((tag,))
                if tag in _BLOCK:
                    if found:
                        close(found)
                    else:
                        flush()
                elif found > fences[-1]:
                    close(found)
                continue
            if tag == "br":
                held.append(" ")
                continue
            if tag in _VOID and tag != "hr":
                continue
            if tag in _BLOCK:
                flush()
                if tag in _CLOSES_P and stack[fences[-1]][0] == "p":
                    close(fences[-1])
                if tag in _SIBLINGS:
                    ends, stops = _SIBLINGS[tag]
                    while (found := place(ends)) > place(stops):
                        close(found)
                        if stack[-1][0] not in ends:
                            break
            if tag == "hr":
                continue
            _, path, noise, main, drop, named, around, low, weakly = stack[-1]
            if attributes.strip(" /"):
                known = _named_memory.get(attributes)
                if known is None:
                    if len(_named_memory) > 50_000:
                        _named_memory.clear()
                    known = _named_memory[attributes] = _named(attributes)
                label, names, out = known
            else:
                label, names, out = "", frozenset(), False
            is_main = tag in _MAIN or "role-main" in names
            top = (tag == "header" or bool(names & _TOP_NAMES)) and not main
            counted = _STRONG if main and tag in _PROSE else _NOISE_NAMES
            named_noise = tag not in ("html", "body") and tag != "main" and bool(names & counted)
            own = out or tag in _NOISE_TAGS or top or (named_noise and tag not in _BLOCK)
            if tag in _RAW:
                at = _RAW[tag].search(source, at).end() if at <= last else end
                continue
            if tag not in _BLOCK:
                if not attributes.endswith("/"):
                    push((tag, path, noise, main, drop or (own and not noise), named, around, low, weakly))
                continue
            noise = noise or drop or own
            if named_noise and not noise:
                named = (*named, len(talk))
                talk.append(bool(names & _TALK))
            if is_main and not noise and not main:
                main, around = True, len(named)
                self.articles += tag == "article"
            self.has_main |= main and not around
            signature = tag + label
            below = _hash(f"{path}>{signature}")
            if styles:
                kids = self.children.setdefault(path, [])
                if not kids or kids[-1] != signature:
                    kids.append(signature)
                self.children.setdefault(below, [])
                self.parent[below] = path
            push((tag, below, noise, main, False, named, around, low or below in cut, weakly or below in weak))
        flush()
        if talk:
            self._settle_names(inside, talk)

    def _settle_names(self, inside: list[tuple[tuple[int, ...], int]], talk: list[bool]) -> None:
        """Cut the blocks of named branches, but not where the article or most of the text is."""
        rows = [(i, len(b.text), b.main) for i, b in enumerate(self.blocks) if not b.noise]
        total = sum(n for _, n, _ in rows)
        free = sum(n for i, n, _ in rows if not inside[i][0])
        keep: set[int] = set()
        if not self.has_main:
            articles = [(i, n) for i, n, main in rows if main]
            if sum(n for _, n in articles) >= free:
                # An article in a discussion counts only where there is no other.
                quiet = [i for i, _ in articles if not any(talk[k] for k in inside[i][0][: inside[i][1]])]
                for i in quiet or ([] if free else [i for i, _ in articles]):
                    keep.update(inside[i][0][: inside[i][1]])
        held = Counter()
        for i, n, _ in rows:
            held.update(dict.fromkeys(inside[i][0], n))
        keep.update(k for k, n in held.items() if 2 * n > total and not talk[k])
        left = [i for i, _, main in rows if keep.issuperset(inside[i][0]) and (main or not self.has_main)]
        if not left:
            # Nothing else is there: names say nothing on this page.
            keep.update(range(len(talk)))
        for block, (named, _) in zip(self.blocks, inside):
            block.noise = block.noise or not keep.issuperset(named)
            block.main = block.main and not block.noise
            self.has_main |= block.main

    def text(self) -> str:
        """Blocks of the article, without branches to cut unless nothing else is there."""
        clean = [b for b in self.blocks if not b.noise]
        kept = [b for b in clean if b.main or not self.has_main]
        beside = [b for b in clean if not b.main and not b.cut]
        if self.articles > 1 and _size(beside) > 2 * _size([b for b in kept if not b.cut]):
            kept = beside
        left = [b for b in kept if not b.cut] or kept
        strong = [b for b in left if not b.weak]
        if 2 * _size(strong) > _size(left):
            left = strong
        return "\n".join(b.text for b in left)


def _size(blocks: list[_Block]) -> int:
    return sum(len(b.text) for b in blocks)


def host_of(url: str | None) -> int:
    """Hash of a url's host in lower case, without user and port; 0 for none."""
    if url is None:
        return 0
    rest = url.split("://", 1)[-1]
    return _hash(re.split(r"[/?#]", rest, maxsplit=1)[0].rsplit("@", 1)[-1].split(":", 1)[0].lower())


def tree_counts(pages: DataFrame) -> DataFrame:
    """(host, path, parent, kind, feature, pages): pages of a host that have a path (0), a style (1) or a block (2) there."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            columns = list(zip(*((*k, n) for k, n in counts.items())))
            counts.clear()
            names = ["host", "path", "parent", "kind", "feature", "pages"]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names)

        for batch in batches:
            for url, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not source:
                    continue
                page, host = Page(source, styles=True), host_of(url)
                found = set()
                for path, kids in page.children.items():
                    parent = page.parent.get(path, 0)
                    found.add((host, path, parent, 0, 0))
                    found.add((host, path, parent, 1, _hash(" ".join(kids))))
                for block in page.blocks:
                    found.add((host, block.path, page.parent.get(block.path, 0), 2, _hash(block.text)))
                counts.update(found)
            if len(counts) > COUNTED:
                yield from out()
        if counts:
            yield from out()

    kinds = "host long, path long, parent long, kind long, feature long, pages long"
    sent = pages.select("url", "html").mapInArrow(count, kinds)
    return sent.groupBy("host", "path", "parent", "kind", "feature").agg(F.sum("pages").alias("pages"))


def node_importance(counts: DataFrame) -> DataFrame:
    """(host, path, parent, m, presentation, blocks, content): entropies of each node of each tree."""
    pages = counts.filter("kind = 0").select("host", "path", "parent", F.col("pages").alias("m"))
    log_k = F.log(F.col("pages").cast("double"))
    sums = counts.filter("kind > 0").groupBy("host", "path", "parent").agg(
        F.sum(F.when(F.col("kind") == 1, F.col("pages") * log_k)).alias("style_log"),
        F.count_if(F.col("kind") == 2).alias("blocks"),
        F.sum(F.when(F.col("kind") == 2, log_k)).alias("block_log"),
    )
    log_m = F.log(F.col("m").cast("double"))
    many = F.col("m") > 1
    return pages.join(sums, ["host", "path", "parent"]).select(
        "host", "path", "parent", "m", "blocks",
        F.when(many, (log_m - F.col("style_log") / F.col("m")) / log_m).otherwise(1.0).alias("presentation"),
        F.when(many & (F.col("blocks") > 0), 1 - F.col("block_log") / F.col("blocks") / log_m).otherwise(1.0).alias("content"),
    )


def low_branches(importance: DataFrame, least_pages: int = LEAST_PAGES, low: float = LOW) -> DataFrame:
    """(host, path, weak) of the branches to cut: a host's tree has one row per path and is walked from its leaves."""

    def walk(nodes: pd.DataFrame) -> pd.DataFrame:
        rows = {r.path: r for r in nodes.itertuples(index=False)}
        kids: dict[int, list[int]] = {}
        for r in rows.values():
            if r.parent in rows:
                kids.setdefault(r.parent, []).append(r.path)
        score: dict[int, float] = {}
        todo = [(p, False) for p, r in rows.items() if r.parent not in rows]
        while todo:
            path, ready = todo.pop()
            below = kids.get(path, [])
            if below and not ready:
                todo += [(path, True), *((k, False) for k in below)]
                continue
            r = rows[path]
            if below:
                decay = DECAY ** len(below)
                weights = [rows[k].m for k in below]
                own = r.content if r.blocks else r.presentation
                inner = sum(w * score[k] for w, k in zip(weights, below)) / sum(weights)
                score[path] = (1 - decay) * max(own, r.presentation) + decay * max(inner, r.content if r.blocks else 0.0)
                if len(below) == 1:
                    score[path] = max(score[path], inner)
            else:
                score[path] = r.content
        # Few pages say less: the bound falls to half of it for two.
        bound = {p: low if r.m >= least_pages else low * (1 - 1 / r.m) for p, r in rows.items()}
        cut = [p for p, s in score.items() if s < bound[p] and rows[p].m > 1 and (rows[p].blocks or kids.get(p))]
        weak = [rows[p].m < least_pages for p in cut]
        return pd.DataFrame({"host": [int(nodes["host"].iloc[0])] * len(cut), "path": cut, "weak": weak}).astype({"host": "int64", "path": "int64", "weak": "bool"})

    return importance.groupBy("host").applyInPandas(walk, "host long, path long, weak boolean")


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES, low: float = LOW) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    narrow = pages.select(
        column_or_null(pages, "page_id", "long").alias("page_id"),
        column_or_null(pages, "url", "string").alias("url"),
        column_or_null(pages, "html", "string").alias("html"),
    )
    spark = pages.sparkSession
    counts = stash(tree_counts(narrow), "tree-counts")
    branches = stash(low_branches(node_importance(counts), least_pages, low), "low-branches")
    names = ["page_id", "url", "text", "n_chars"]
    kinds = "page_id long, url string, text string, n_chars long"

    def row_of(page_id, url, source, cut, weak) -> tuple:
        text = Page(source, cut=cut, weak=weak).text() if source else ""
        return page_id, url, text, len(text)

    if branches.count() <= BROADCAST_BRANCHES:
        by_host: dict[int, tuple[set[int], set[int]]] = {}
        for host, path, weak in branches.collect():
            by_host.setdefault(host, (set(), set()))[weak].add(path)
        none = frozenset(), frozenset()
        sent = spark.sparkContext.broadcast(by_host)

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = zip(*(c.to_pylist() for c in batch.columns))
                done = [row_of(i, u, s, *sent.value.get(host_of(u), none)) for i, u, s in rows]
                yield _batch(done, names)

        return narrow.mapInArrow(read, kinds)

    lists = branches.groupBy("host").agg(
        F.collect_set(F.when(~F.col("weak"), F.col("path"))).alias("cut"), F.collect_set(F.when(F.col("weak"), F.col("path"))).alias("weak")
    )
    host = F.udf(host_of, "long", useArrow=True)

    def read_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            yield _batch([row_of(i, u, s, frozenset(c or ()), frozenset(w or ())) for i, u, s, c, w in rows], names)

    joined = narrow.withColumn("host", host("url")).join(lists, "host", "left")
    return joined.select("page_id", "url", "html", "cut", "weak").mapInArrow(read_joined, kinds)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 4
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names)
