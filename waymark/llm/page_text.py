"""Main text of web pages: site templates removed by counting element subtrees per host, then the article's blocks.

Containers (divisions, sections, lists, ...) are hashed from the bottom up in two forms, each counted by pages of the host:

- by words: tag, class words and all text and elements inside. On MANY pages or more it is template,
  wherever it stands (prose inside an article is never counted).
- by shape: the path to the element, and tags and class words inside with repeated neighbours as one; words and links apart.
  On MANY pages and half of the host's pages or more it is template, if it holds less than a third of their text on average.
  Subtrees with paragraphs, quotes or a main heading, and what lies in an article, are not judged by shape.

What recurs too seldom to be counted (small hosts, rare boxes, comments inside an article) is left to names, which decide last and
never over what holds the story:

- Navigation, menus, sidebars, footers and dialogs go by element or role.
- Headers go unless they stand in an article or hold the page's only main heading.
- Classes and ids are taken as whole words: `reader-comments` is named by its last part, `ad-slot` by its first as a slot is no thing of its own, while
  `has-sidebar` and `share-price-report` name nothing. A box so named goes, unless it holds the page's only main heading, an
  <article> or <main> (comments may hold articles of their own), or paragraphs that are more than half of the page's text.
- Forms go by the same rule: one around the whole page stays, without its controls.
- If the page has an <article>, or else a <main>, only what lies inside is kept; but not if the main heading is outside and more prose
  stands outside than in the largest of them (teasers beside a story).

Blocks: character references decoded, white space as one space, trimmed, joined by two newlines, in page order.
Broken markup: an end tag closes what is open inside it, an unmatched one closes nothing, a cut-off tag is dropped, a quote
without its end (within 4,096 characters) is a sign like any other. Work is in proportion to a page's length.

Null or empty html: an empty text. Null urls are one host. Pages are told apart by id and html: repeated rows count once and
come out each. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Pages of a host that a subtree must recur on to be template.
MANY = 10
#: Of shapes: the least share of the host's pages, and the share of their text under which a subtree is no content.
SHARE, CONTENT = 0.5, 1 / 3
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]{0,4096}+"|'[^']{0,4096}+'|["'])*+)(?:>|\Z)""", re.S
)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
# fixed values: element names and naming habits of web pages
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template svg iframe".split())
PROSE = set("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption td th".split())
CONTAINER = set("article aside body button center details dialog div dl fieldset figure footer form header html main menu nav ol section select summary table tbody tfoot thead tr ul".split())
ASIDE = set("nav footer aside menu dialog button select".split())
ASIDE_ROLES = set("navigation contentinfo complementary search dialog alert alertdialog menu menubar".split())
ASIDE_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification alert popup modal"
    " overlay newsletter subscribe subscription signup login sidebar nav navbar navigation menu breadcrumb breadcrumbs footer masthead toolbar widget"
    " related recommended recommendations share sharing social comment comments commentlist disqus reply replies respond pagination pager skip".split()
)
COMMENT_WORDS = set("comment comments commentlist disqus reply replies respond".split())
HEADER_WORDS = {"header", "topbar"}
#: Words that say what a box is like and not what it holds, before and after the word that names it.
STATES = set("has no not with without is hide show js".split())
BOXES = set("area bar block body box button buttons card cell col column container content form group holder icon icons inner item items link links list outer panel row section slot unit wrap wrapper zone".split())
CONTENT_TAGS = set("p h1 pre blockquote".split())


def names(said: str) -> set[str]:
    """The words that the tokens of a class or id are named by."""
    found = set()
    for token in said.split():
        parts = [w for w in re.split(r"[^a-z]+", token) if w]
        if not parts or parts[0] in STATES and len(parts) > 1:
            continue
        while len(parts) > 1 and parts[-1] in BOXES:
            parts.pop()
        found.add(parts[-1])
    return found


class Node:
    __slots__ = ("tag", "aside", "article", "prose", "parent", "sign", "path", "by_words", "by_shape", "n_text", "n_prose", "shapes", "content", "judged", "n_h1", "holds_main")

    def __init__(self, tag: str, parent: Node | None, attributes: str) -> None:
        import xxhash

        self.tag, self.parent = tag, parent
        self.article = tag in ("article", "main") or bool(parent and parent.article)
        self.prose = tag in PROSE or bool(parent and parent.prose)
        named = {name.lower(): (a or b or c).lower() for name, a, b, c in ATTRIBUTE.findall(attributes)} if "=" in attributes else {}
        tokens = f"{named.get('class', '')} {named.get('id', '')}"
        said = set(re.split(r"[^a-z]+", tokens)) - {""} if named else set()
        self.aside = self.kind(tag, named.get("role"), names(tokens) if said else set())
        self.sign = f"<{tag} {' '.join(sorted(said))}>"
        self.path = xxhash.xxh64_intdigest(f"{parent.path if parent else 0}{self.sign}")
        self.by_words, self.by_shape = xxhash.xxh64(self.sign), None
        self.n_text = self.n_prose = 0
        self.shapes, self.content = [], tag in CONTENT_TAGS
        self.n_h1, self.holds_main = int(tag == "h1"), tag in ("article", "main")
        self.judged: tuple[int, ...] = ()

    def kind(self, tag: str, role: str | None, words: set[str]) -> str:
        """What a node says itself that it is, besides the article; empty if nothing."""
        if tag in ASIDE or role in ASIDE_ROLES:
            return "aside"
        if tag in ("html", "body", "article", "main"):
            return ""
        if words & COMMENT_WORDS:
            return "comments"
        if words & ASIDE_WORDS:
            return "named"
        if tag == "form" or role == "form":
            return "form"
        if not self.article and (tag in ("header", "head") or role == "banner" or words & HEADER_WORDS):
            return "header"
        return ""

    def goes(self, n_h1: int, total: int) -> bool:
        """Whether its name deletes it, on a page with so many main headings and so much text."""
        if self.aside in ("", "aside"):
            return bool(self.aside)
        if self.tag == "head":
            return True
        if n_h1 and self.n_h1 == n_h1:
            return False
        if self.aside in ("named", "form"):
            return not (self.holds_main or self.content and 2 * self.n_text > total)
        return True


def walk(page: str) -> Iterator[tuple[str, object]]:
    """("text", (from, to)), ("break", None), ("open", node) and ("close", node), in page order."""
    stack: list[Node] = []
    n_open: Counter[str] = Counter()
    at, end = 0, len(page)

    def closed() -> tuple[str, Node]:
        n_open[stack[-1].tag] -= 1
        return "close", stack.pop()

    while at < end:
        found = TOKEN.search(page, at)
        stop = found.start() if found else end
        if stop > at:
            yield "text", (at, stop)
        if not found:
            break
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            if n_open[tag]:
                while stack[-1].tag != tag:
                    yield closed()
                yield closed()
            elif tag in PROSE or tag in CONTAINER:
                yield "break", None
        elif tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else end
        elif tag in VOID:
            yield ("break", None) if tag == "hr" else ("text", (at, at))
        elif tag in PROSE or tag in CONTAINER:
            if tag in PROSE:  # a paragraph, item or cell ends where the next begins
                while stack and stack[-1].tag in PROSE and (stack[-1].tag == tag or stack[-1].tag == "p" or {stack[-1].tag, tag} in ({"dt", "dd"}, {"td", "th"})):
                    yield closed()
            stack.append(Node(tag, stack[-1] if stack else None, found[3]))
            n_open[tag] += 1
            yield "open", stack[-1]
    while stack:
        yield closed()


def countable(node: Node) -> bool:
    return node.tag in CONTAINER and node.tag not in ("html", "body", "article", "main") and not (node.article and node.prose)


def judged_walk(page: str) -> tuple[list[tuple[str, object]], int]:
    """The page's events, each countable node with its hashes in `judged` (by shape: odd, by words: even), and the length of all text."""
    import xxhash

    events, open_, total = list(walk(page)), [], 0
    for kind, what in events:
        if kind == "text":
            text = " ".join(page[what[0] : what[1]].split())
            total += len(text)
            if open_ and text:
                open_[-1].by_words.update(text.encode("utf-8", "surrogatepass"))
                open_[-1].n_text += len(text)
                open_[-1].n_prose += len(text) * open_[-1].prose
        elif kind == "open":
            open_.append(what)
        elif kind == "close":
            node = open_.pop()
            shape = xxhash.xxh64_intdigest(f"{node.sign}{node.shapes}")
            words = node.by_words.intdigest()
            if open_:
                parent = open_[-1]
                parent.by_words.update(words.to_bytes(8, "little"))
                parent.n_text += node.n_text
                parent.n_prose += node.n_prose
                parent.content = parent.content or node.content
                if node.aside != "aside":  # what a sidebar holds is no sign of a story
                    parent.n_h1 += node.n_h1
                    parent.holds_main = parent.holds_main or node.holds_main
                if parent.shapes[-1:] != [shape]:
                    parent.shapes.append(shape)
            if countable(node) and node.n_text:
                by_shape = xxhash.xxh64_intdigest(f"{node.path} {shape}")
                found = [words & ~1] + ([by_shape | 1] if not (node.article or node.content) else [])
                node.judged = tuple(h - (1 << 64) if h >= 1 << 63 else h for h in found)
            node.by_words, node.shapes = None, []
    return events, total


def subtrees(page: str) -> dict[int, float]:
    """Hashes of the page's countable subtrees, each with its share of the page's text."""
    events, total = judged_walk(page) if page else ([], 0)
    found: dict[int, float] = {}
    for kind, node in events:
        if kind == "close":
            for h in node.judged:
                found[h] = found.get(h, 0.0) + node.n_text / total
    return found


def dropped(events: list[tuple[str, object]], total: int, template: set[int], by_name: bool) -> set[int]:
    """The nodes (by id) that are template, or that go by name."""
    roots = [node for kind, node in events if kind == "open" and node.parent is None]
    n_h1 = sum(node.n_h1 for node in roots if node.aside != "aside")
    return {id(node) for kind, node in events if kind == "open" and (not template.isdisjoint(node.judged) or by_name and node.goes(n_h1, total))}


def kept_inside(events: list[tuple[str, object]], gone: set[int]) -> str | None:
    """The element that the story is in: article or main; None for the whole page."""
    open_: list[Node] = []
    deep, outer = 0, {"article": 0, "main": 0}
    h1, prose, largest = Counter(), Counter(), Counter()
    for kind, node in events:
        if kind == "open":
            open_.append(node)
            deep += id(node) in gone
            if not deep:
                for tag in outer:
                    if node.tag == tag and not outer[tag]:
                        largest[tag] = max(largest[tag], node.n_prose, 1)
                    outer[tag] += node.tag == tag
                inside = {tag for tag in outer if outer[tag]}
                own = node.n_prose if node.prose and not (node.parent and node.parent.prose) else 0
                for tag in [*inside, "page"]:
                    h1[tag] += node.tag == "h1"
                    prose[tag] += own
        elif kind == "close":
            if not deep:
                for tag in outer:
                    outer[tag] -= node.tag == tag
            deep -= id(node) in gone
            open_.pop()
    for tag in ("article", "main"):
        if largest[tag] and (h1[tag] or not h1["page"] or prose["page"] - prose[tag] <= largest[tag]):
            return tag
    return None


def main_text(page: str, template: set[int] = frozenset(), by_name: bool = True) -> str:
    events, total = judged_walk(page) if page else ([], 0)
    gone = dropped(events, total, template, by_name)
    inside = kept_inside(events, gone) if by_name else None
    blocks: list[str] = []
    words: list[str] = []
    deep = within = 0

    def flush() -> None:
        text = " ".join(references.unescape("".join(words)).split())
        if text:
            blocks.append(text)
        words.clear()

    for kind, what in events:
        if kind == "text":
            if not deep and (within or not inside):
                words.append(page[what[0] : what[1]] if what[1] > what[0] else " ")
            continue
        flush()
        if kind == "open":
            within += what.tag == inside
            deep += id(what) in gone
        elif kind == "close":
            within -= what.tag == inside
            deep -= id(what) in gone
    flush()
    return "\n\n".join(blocks)


def templates(trees: DataFrame, hosts: DataFrame, many: int) -> DataFrame:
    """host, hash of subtrees that are template. trees: host, page, hash, share (a row per page and hash); hosts: host, n_host."""
    counted = trees.groupBy("host", "hash").agg(F.count("*").alias("n_pages"), F.avg("share").alias("share")).where(F.col("n_pages") >= many)
    counted = counted.join(hosts.withColumnRenamed("host", "_host"), F.col("host") == F.col("_host"))
    by_words = F.col("hash").bitwiseAND(F.lit(1)) == 0
    return counted.where(by_words | ((F.col("n_pages") >= SHARE * F.col("n_host")) & (F.col("share") < CONTENT))).select("host", "hash")


def extract(pages: DataFrame, many: int = MANY, by_name: bool = True) -> DataFrame:
    """page_id, url, text, n_chars for every page. by_name=False: template counting alone."""
    key = F.xxhash64(F.col("page_id"), F.col("html"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", key.alias("_key"), host.alias("_host"))

    def hash_subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [subtrees(page.as_py() or "") for page in batch.column(2)]
            hashes, shares = pa.array([list(f) for f in found], pa.list_(pa.int64())), pa.array([list(f.values()) for f in found], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), hashes, shares], ["page", "host", "hashes", "shares"])

    hashed = rows.select("_key", "_host", "html").mapInArrow(shared.lean(hash_subtrees), "page long, host string, hashes array<long>, shares array<double>")
    trees = shared.stage(hashed, "subtrees")
    pages_ = trees.groupBy("host", "page").agg(F.first("hashes").alias("hashes"), F.first("shares").alias("shares"))  # repeated rows once
    hosts = pages_.groupBy("host").agg(F.count("*").alias("n_host"))
    each = shared.stage(pages_.select("host", "page", F.explode(F.arrays_zip("hashes", "shares")).alias("t")).select("host", "page", F.col("t.hashes").alias("hash"), F.col("t.shares").alias("share")), "page-subtrees")
    template = shared.checked_broadcast(shared.stage(templates(each, hosts, many), "templates"))
    found = each.join(template, ["host", "hash"], "left_semi").groupBy(F.col("page").alias("_page")).agg(F.collect_set("hash").alias("template"))
    found = shared.stage(found, "template-subtrees")

    def text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py() or "", set(hashes.as_py() or ()), by_name) for page, hashes in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    joined = rows.join(shared.checked_broadcast(found), F.col("_key") == F.col("_page"), "left").select("page_id", "url", "html", "template")
    return joined.mapInArrow(shared.lean(text), "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
