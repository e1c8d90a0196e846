"""Main text of web pages by site style trees.

The pages of one host are merged into a style tree: a node is an element path (block elements with
their classes) and holds how often each presentation style (the order of its children) and each
content (a block of text right below it) occurs. From their entropies over the host's pages follows
how important a node is:

* A block that stands on all pages alike tells nothing, one that stands on a single page counts with
  all its words: a block's words weigh 1 less the entropy of its pages, in units of the log of all.
* A branch counts by its share of the words so weighed in the branch around it, next to an even
  share among the branches beside it, unless that branch is itself a body of text (its words stand
  right in leaves); there every branch counts by the entropy of its own words alone.
* Presentation counts by the entropy of its styles.

The fewer pages a node was seen on, the nearer its importance is drawn to ``NEUTRAL``. A role that the
markup tells (``nav``, ``footer``, a class such as ``cookie``) lowers a branch's importance by
``ROLE_WEIGHT``, ``article`` and ``main`` raise it; what is below ``LEAST`` is cut from each page with
all that it holds. A role found in a name counts for nothing where the branch holds the page's article
or most of its text, and half as much inside an article for names that articles use as well.

Nulls: null html is an empty page with empty text; a null url belongs to the host "". Pages are read
whole, however long. Repeated rows give repeated results; other columns are handed on.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Branches of less importance are cut.
LEAST = 0.3
#: How a role moves the importance of its branch; and a name that articles use as well, inside an article.
ROLE_WEIGHT, NAME_WEIGHT = 0.6, 0.3
#: Importance of a branch that nothing is known of, and the number of pages that weighs as much as that.
NEUTRAL, NEUTRAL_PAGES = 0.5, 2
#: Share of the content's entropy in the importance; the rest is the presentation's.
CONTENT_SHARE = 0.8
#: A node with this share of its words right in leaves is a body of text.
BODY_SHARE = 0.5
#: Elements nested deeper than this stand beside each other, as in browsers.
DEPTH = 512
#: Nodes up to this many (8 bytes each, some 100 with Java's objects) are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 100_000

# Element and attribute names of HTML.
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style noscript template textarea title svg math iframe object canvas select button audio video"
NOISE_TAGS = frozenset("nav aside footer form dialog menu head".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
NOISE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disqus disclaimer footer gdpr header login masthead menu modal nav navbar navigation newsletter notice "
    "overlay pager pagination popup promo promoted recommended related replies respond share sharing sidebar signup "
    "skip social sponsor sponsored subscribe tags toolbar topbar widget".split()
)
# Names that also stand for parts of an article.
SHARED_NAMES = frozenset("header footer banner related recommended notice disclaimer tags skip widget".split())

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({'|'.join(RAW.split())})\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+|[^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z/!][^<>]*\Z",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
NAME = re.compile(r"[a-z]+")


class Node:
    """An element of a page; ``key`` names its element path on its host."""

    __slots__ = ("children", "holds_main", "key", "main", "noise", "parent", "role", "styles", "tag", "words")

    def __init__(self, tag: str, key: int, parent: Node | None, role: str, main: bool, noise: bool):
        self.tag, self.key, self.parent, self.role, self.main, self.noise = tag, key, parent, role, main, noise
        self.words, self.holds_main, self.children = 0, False, 0
        self.styles: list[str] = []


#: Roles: none, an article's, a strong one (the element's own meaning), a weak one (a name), one that is weaker still inside an article.
PLAIN, MAIN, STRONG, WEAK, SHARED = "", "main", "strong", "weak", "shared"
#: Levels of importance that decide: below LEAST, below LEAST + NAME_WEIGHT, and from LEAST + ROLE_WEIGHT on. Others are of level 2.
LOW, LOWER, HIGH = 0, 1, 3


def _described(attributes: str) -> tuple[str, str]:
    """(class and id names with numbers as one, the role that the attributes tell)."""
    names, role = [], PLAIN
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id"):
            names.append(re.sub(r"\d+", "0", value))
            told = NOISE_NAMES.intersection(NAME.findall(value))
            if told and role != STRONG:
                role = SHARED if role != WEAK and told <= SHARED_NAMES else WEAK
        elif (
            (key == "role" and value in NOISE_ROLES) or key == "hidden" or (key == "aria-hidden" and value == "true")
            or (key == "style" and re.search(r"display\s*:\s*none", value))
        ):
            role = STRONG
    return " ".join(names), role


def parse(page: str, host: int = 0) -> list[tuple[Node, str]]:
    """Text blocks of a page in order, each with the node that it stands in."""
    root = Node("", host, None, PLAIN, False, False)
    stack, blocks, held = [root], [], []

    def flush() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                blocks.append((stack[-1], text))

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        if m[3] is None:
            continue
        tag = m[3].lower()
        if tag in VOID:
            if tag == "br":
                held.append(" ")
            elif tag == "hr":
                flush()
            continue
        if m[2]:
            if tag in INLINE and all(x.tag != tag for x in stack):
                continue
            flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        names, role = _described(m[4]) if m[4] else ("", PLAIN)
        if tag in INLINE and role == PLAIN and all(x.tag != tag for x in stack[1:]):
            continue
        flush()
        if tag in ("body", "article", "main"):
            # The end tag of a head may be left out.
            for k, x in enumerate(stack):
                if x.tag == "head":
                    del stack[k:]
                    break
        if tag not in INLINE and len(stack) > 1 and stack[-1].tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
            stack.pop()
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack[-1].tag == tag:
            stack.pop()
        parent = stack[-1]
        if tag in ("article", "main") and not parent.noise:
            role = MAIN
        elif tag in NOISE_TAGS or (tag == "header" and not parent.main):
            role = STRONG
        elif tag in ("html", "body"):
            role = PLAIN
        main = parent.main or role == MAIN
        noise = parent.noise or (role == STRONG and tag != "form")
        node = Node(tag, xxhash.xxh64_intdigest(f"{parent.key}>{tag}.{names}") >> 1, parent, role, main, noise)
        parent.styles.append(tag)
        parent.children += 1
        if not m[4].rstrip().endswith("/") and len(stack) <= DEPTH:
            stack.append(node)
    if at < len(page):
        held.append(page[at:])
    flush()
    for node, text in blocks:
        n, main = len(text.split()), False
        while node is not None:
            main = main or node.role == MAIN
            node.words += n
            node.holds_main = node.holds_main or (main and node.role != MAIN)
            node = node.parent
    return blocks


def _host(url_col: str):
    """The host as a non-negative number."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[^:]*://([^/?#]*)", 1))
    return F.shiftrightunsigned(F.xxhash64(host), 1)


def _tree_rows(batches):
    """One row for each node (kind 0: parent, style) and each text block (kind 1: words, content) of each page."""
    for b in batches:
        kinds, nodes, parents, items, words = [], [], [], [], []
        for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            seen: dict[int, list[str]] = {}
            parent_of: dict[int, int] = {}
            contents: dict[tuple[int, int], int] = {}
            visited: set[int] = set()
            for node, text in parse(page, host):
                content = (node.key, xxhash.xxh64_intdigest(text) >> 1)
                contents[content] = contents.get(content, 0) + len(text.split())
                while node.parent is not None and id(node) not in visited:
                    visited.add(id(node))
                    seen.setdefault(node.key, []).append(" ".join(node.styles))
                    parent_of[node.key] = node.parent.key
                    node = node.parent
            for key, styles in seen.items():
                kinds.append(0)
                nodes.append(key)
                parents.append(parent_of[key])
                items.append(xxhash.xxh64_intdigest("|".join(styles)) >> 1)
                words.append(0)
            for (key, content), n in contents.items():
                kinds.append(1)
                nodes.append(key)
                parents.append(0)
                items.append(content)
                words.append(n)
        columns = [pa.array(kinds, pa.int8()), *(pa.array(x, pa.int64()) for x in (nodes, parents, items, words))]
        yield pa.RecordBatch.from_arrays(columns, names=["kind", "node", "parent", "item", "words"])


def node_importance(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The hosts' style trees: (node, pages, importance); nodes are hashes of host and element path.

    Counted by (node, item) first, so that a host with a large share of all pages is summed up
    before the shuffle. What is joined after that are nodes, not pages.
    """
    rows = pages.select(_host(url_col).alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("page"))
    found = rows.mapInArrow(_tree_rows, "kind byte, node long, parent long, item long, words long")
    items = staged(found.groupBy("kind", "node", "item").agg(F.max("parent").alias("parent"), F.count("*").alias("n"), F.sum("words").alias("words")), "style-trees")
    # With item i on n_i of N pages, the entropy is log N - sum(n_i log n_i) / N; a block's own is log n_i of log N.
    logs = F.sum(F.col("n") * F.log("n"))
    nodes = items.where("kind = 0").groupBy("node").agg(F.max("parent").alias("parent"), F.sum("n").alias("pages"), logs.alias("logs"))
    scale = F.log(F.col("pages") + NEUTRAL_PAGES)
    texts = items.where("kind = 1").groupBy("node").agg(F.sum("words").alias("words"), F.sum(F.col("words") * F.log("n")).alias("repeated"))
    own = nodes.join(texts, "node", "left").select(
        "node", "parent", "pages", F.when(F.col("pages") > 1, 1 - F.col("logs") / (F.col("pages") * F.log("pages"))).otherwise(0.0).alias("presentation"),
        F.coalesce("words", F.lit(0)).cast("double").alias("words"), F.coalesce(F.col("words") - F.col("repeated") / scale, F.lit(0.0)).alias("told"),
    )
    tree = staged(own, "style-nodes")
    # Pairs of nodes and those above them, in rounds of twice the distance; then sums over branches.
    pairs = staged(tree.join(tree.select(F.col("node").alias("parent")), "parent").select("node", F.col("parent").alias("above"), F.lit(1).alias("d")), "style-pairs")
    step, far = 1, pairs
    while far.limit(1).count():
        ahead = pairs.select(F.col("node").alias("above"), F.col("above").alias("over"), F.col("d").alias("more"))
        longer = far.join(ahead, "above").select("node", F.col("over").alias("above"), (F.col("d") + F.col("more")).alias("d"))
        pairs, step = staged(pairs.unionByName(longer), "style-pairs"), 2 * step
        far = pairs.where(F.col("d") == step)
    below = pairs.join(tree.select("node", "words", "told"), "node").select(F.col("above").alias("node"), F.lit(False).alias("is_own"), "words", "told")
    sums = tree.select("node", F.lit(True).alias("is_own"), "words", "told").unionByName(below)
    branch = sums.groupBy("node").agg(
        F.sum("words").alias("all_words"), F.sum("told").alias("all_told"), F.sum(F.when(F.col("is_own"), 0).otherwise(F.col("words"))).alias("below"),
    )
    whole = staged(tree.join(branch, "node"), "style-sums")
    leaf_told = F.sum(F.when(F.col("below") == 0, F.col("all_told")).otherwise(0.0))
    around = whole.groupBy(F.col("parent").alias("node")).agg(F.sum("pages").alias("child_pages"), leaf_told.alias("leaf_told"))
    around = around.join(whole.select("node", F.col("pages").alias("p_pages"), F.col("all_told").alias("p_told"), F.col("told").alias("p_own")), "node")
    joined = whole.join(around.withColumnRenamed("node", "parent"), "parent", "left")
    novelty = F.col("all_told") / F.greatest(F.col("all_words"), F.lit(1.0))
    is_body = F.col("p_told").isNull() | (F.col("leaf_told") + F.col("p_own") >= BODY_SHARE * F.col("p_told"))
    even = (F.col("p_told") / F.col("p_pages")) / (F.col("child_pages") / F.col("p_pages"))
    share = F.when(is_body, 1.0).otherwise(F.least(F.lit(1.0), F.coalesce((F.col("all_told") / F.col("pages")) / even, F.lit(0.0))))
    # A branch's look counts no more than what it holds.
    measured = share * (CONTENT_SHARE * novelty + (1 - CONTENT_SHARE) * F.greatest(novelty * 0.5, F.col("presentation")))
    known = F.col("pages") / (F.col("pages") + NEUTRAL_PAGES)
    return joined.select("node", "pages", (known * measured + (1 - known) * NEUTRAL).alias("importance"))


def main_text(page: str, levels: dict[int, int] | None = None, host: int = 0, roles: bool = True) -> str:
    """Text of a page without its branches of low importance.

    ``levels`` holds the nodes whose importance decides (``LOW``, ``LOWER``, ``HIGH``). Without
    ``roles`` the tree alone decides.
    """
    levels = levels or {}
    blocks = parse(page, host)
    everything = sum(len(t.split()) for _, t in blocks)
    has_main = any(x.main for x, _ in blocks)
    verdicts: dict[int, bool] = {}

    def is_cut(node: Node) -> bool:
        """Whether this branch goes, whatever stands around it."""
        level = levels.get(node.key, 2)
        if not roles or node.role == PLAIN:
            return level == LOW and not (roles and (node.main or node.holds_main))
        if node.role == MAIN or ((node.role != STRONG or node.tag == "form") and node.holds_main):
            return False
        if node.role in (WEAK, SHARED) and not has_main and 2 * node.words > everything:
            return level == LOW
        if node.role == SHARED and node.main:
            return level in (LOW, LOWER)
        return level != HIGH

    def cut(node: Node) -> bool:
        if node.parent is None:
            return False
        if id(node) not in verdicts:
            verdicts[id(node)] = is_cut(node) or cut(node.parent)
        return verdicts[id(node)]

    return " ".join(t for x, t in blocks if not cut(x))


def _page_nodes(batches):
    """(name, nodes) of pages: all nodes that hold text."""
    for b in batches:
        every = []
        for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            keys = set()
            for node, _ in parse(page, host):
                while node is not None and node.key not in keys:
                    keys.add(node.key)
                    node = node.parent
            every.append(sorted(keys))
        yield pa.RecordBatch.from_arrays([b.column(2), pa.array(every, pa.list_(pa.int64()))], names=["name", "nodes"])


def extract_main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", roles: bool = True) -> DataFrame:
    """``pages`` with ``text``, the main text of each row, in place of any column of that name."""
    at = F.col("importance")
    level = F.when(at < LEAST, LOW).when(at < LEAST + NAME_WEIGHT, LOWER).when(at >= LEAST + ROLE_WEIGHT, HIGH)
    tree = node_importance(pages, url_col, html_col).select("node", level.alias("level")).where("level is not null")
    marked = staged(tree, "branch-levels")
    others = [c for c in pages.columns if c not in (html_col, "text")]
    packed = pages.select(F.struct(*[F.col(c) for c in others]).alias("row"), _host(url_col).alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("page"))
    schema = packed.select("row", F.lit("").alias("text")).schema
    shared = None
    if marked.count() <= BROADCAST_ROWS:
        shared = pages.sparkSession.sparkContext.broadcast({r.node: r.level for r in marked.collect()})
        ready = packed.withColumn("levels", F.lit(None).cast("array<struct<node:bigint,level:int>>"))
    else:
        # Pages are named by a hash; only names and nodes are shuffled before the levels found are handed back.
        named = packed.withColumn("name", F.xxhash64("host", "page"))
        asked = named.select("host", "page", "name").mapInArrow(_page_nodes, "name long, nodes array<bigint>")
        asked = asked.select("name", F.explode("nodes").alias("node")).distinct()
        found = asked.join(marked, "node").groupBy("name").agg(F.collect_list(F.struct("node", "level")).alias("levels"))
        ready = named.join(found, "name", "left").drop("name")

    def run(batches):
        for b in batches:
            texts = []
            for host, page, own in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                levels = shared.value if shared else {x["node"]: x["level"] for x in own or ()}
                texts.append(main_text(page, levels, host, roles))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["row", "text"])

    return ready.select("row", "host", "page", "levels").mapInArrow(run, schema).select("row.*", "text")
