"""Main text of web pages by wrapper induction over pages of one host.

Each page becomes a tree of block elements, in which runs of equal leaf siblings are one repeated node. Trees of one
host are aligned by simple tree matching: the largest number of node pairs that keeps labels, parents and the order of
siblings. Matched nodes become one node of the host's wrapper, others are added where they stand; each node counts the
pages that have it, the characters seen there, and (by a mergeable heavy-hitters summary) texts that recur in it.

A text that nearly all pages of a host have in a node is template; what varies is content, outside of what labels call
navigation, advertising and the like. A page is aligned with its host's wrapper, and its varying blocks are its text,
wherever they stand: a node that holds most of the text doesn't drop what is beside it. Nodes that the wrapper lacks
have no template.

All pages teach, a partition at a time; partial wrappers of one host are merged in two rounds, so that a hot host is
no hot task.
"""

from __future__ import annotations

import html
import json
import math
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_only, stored

BLOCK = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
SKIPPED = frozenset("script style noscript template iframe object svg canvas audio video select textarea button title head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDE_TAGS = frozenset("nav footer aside form menu dialog search fieldset".split())
ASIDE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related reply replies share sharing sidebar sidebars social sponsor sponsored subscribe toolbar widget".split())
ASIDE_ROLES = frozenset("navigation complementary contentinfo banner search form menu dialog alert".split())
#: A start tag of the key closes an open one of its values (the nearest, within a container).
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
CONTAINERS = frozenset("ul ol menu dl table".split())
#: A tag ends at the first > outside of quoted values. Nothing is matched twice: only a page's last quote can lack its
#: partner, and it is then a character like others.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""\b(class|id|role|hidden|itemprop)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_WORD = re.compile(r"[a-z]+")

#: A text is template where at least this share of a node's pages has it, and the node has this many pages.
CONSTANT, LEAST_PAGES = 0.9, 8
#: Counters of a node's heavy-hitters summary: at least so many, and so many for each text that a page has there on
#: average. A text undercounts by less than a sixteenth of the pages then, so none that nearly all pages have is lost.
COUNTERS, PER_TEXT = 128, 16
#: Elements nested deeper than this are no nodes of their own: their texts are blocks of the node at that depth.
DEEPEST = 150
#: How many open elements an end tag looks through for its start.
FARTHEST = 2000


class Node:
    """A block element: its label, whether its label sets it aside, and texts and nodes in page order."""

    __slots__ = ("aside", "items", "label", "slot")

    def __init__(self, label: str, aside: bool) -> None:
        self.label, self.aside = label, aside
        self.items: list[str | Node] = []
        self.slot: Slot | None = None


def _element(tag: str, attributes: str) -> Node:
    if not attributes.strip():
        return Node(tag, tag in ASIDE_TAGS)
    names: list[str] = []
    aside = tag in ASIDE_TAGS
    for name, a, b, c in _ATTR.findall(attributes):
        value, name = (a or b or c).lower(), name.lower()
        if name in ("class", "id"):
            words = _WORD.findall(value)
            if name == "class":
                names += sorted(set(words))
            aside = aside or not ASIDE_WORDS.isdisjoint(words)
        elif name == "role":
            aside = aside or value in ASIDE_ROLES
        elif name == "hidden":
            aside = True
    return Node(" ".join([tag, *names]), aside and tag not in ("html", "body", "article", "main"))


def parse(page: str) -> Node:
    """A tolerant parse in linear time: never fails, whatever is left open, closed twice or nested deeply."""
    root = Node("html", False)
    stack: list[tuple[str, Node]] = [("html", root)]
    text: list[str] = []
    at, skip_until, has_body = 0, None, False

    def flush() -> None:
        if text:
            words = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if words:
                stack[-1][1].items.append(words)

    while token := _TOKEN.search(page, at):
        if skip_until is None and token.start() > at:
            text.append(page[at : token.start()])
        at = token.end()
        tag = token[2]
        if tag is None:
            continue
        tag, closing = tag.lower(), bool(token[1])
        if skip_until is not None:
            if (closing and tag == skip_until) or (skip_until == "head" and tag == "body"):
                skip_until = None
                if closing:
                    continue
            else:
                continue
        if tag in SKIPPED:
            if not closing and not token[3].endswith("/"):
                if tag in ("script", "style", "title", "textarea"):
                    end = _END[tag].search(page, at)
                    at = end.end() if end else len(page)
                else:
                    skip_until = tag
            continue
        if tag == "br":
            text.append(" ")
        elif tag == "hr":
            flush()
        elif tag in BLOCK:
            flush()
            if closing:
                _close(stack, frozenset((tag,)), frozenset())
                continue
            if tag == "html" or (tag == "body" and has_body):
                continue
            has_body = has_body or tag == "body"
            _close(stack, _P, _KEEPS_P)
            if tag in CLOSES:
                _close(stack, CLOSES[tag], CONTAINERS)
            above, node = stack[-1][1], _element(tag, token[3])
            if len(stack) <= DEEPEST or (node.aside and not above.aside):
                above.items.append(node)
            else:
                node = above
            stack.append((tag, node))
    if skip_until is None and at < len(page):
        text.append(page[at:])
    flush()
    return root


_END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in ("script", "style", "title", "textarea")}
_P, _KEEPS_P = frozenset(("p",)), frozenset("td th li div article section body".split())


def _close(stack: list[tuple[str, Node]], tags: frozenset[str] | set[str], within: frozenset[str]) -> None:
    """Closes the nearest open element of one of the tags, and what it holds, unless one of `within` is nearer."""
    for k in range(len(stack) - 1, max(0, len(stack) - FARTHEST), -1):
        if stack[k][0] in tags:
            del stack[k:]
            return
        if stack[k][0] in within:
            return


# --- wrappers -----------------------------------------------------------------------------------------------------


class Slot:
    """A wrapper node: pages that have it, how many texts of its own they have there, recurring texts (counts, each at
    most slack too low), children in order."""

    __slots__ = ("aside", "kids", "label", "pages", "slack", "texts", "total")

    def __init__(self, label: str, aside: bool) -> None:
        self.label, self.aside = label, aside
        self.pages, self.total, self.slack = 0, 0, 0
        self.texts: dict[str, int] = {}
        self.kids: list[Slot] = []

    def pack(self) -> list:
        return [self.label, self.aside, self.pages, self.total, self.texts, self.slack, [k.pack() for k in self.kids]]

    @staticmethod
    def unpack(row: list) -> Slot:
        out = Slot(row[0], row[1])
        out.pages, out.total, out.texts, out.slack = row[2], row[3], dict(row[4]), row[5]
        out.kids = [Slot.unpack(k) for k in row[6]]
        return out


def text_key(text: str) -> str:
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=6).hexdigest()


def skeleton(node: Node) -> Slot:
    """A page's tree as a wrapper of one page: equal leaf siblings in a row are one slot. Made once for each node."""
    if node.slot is not None:
        return node.slot
    out = node.slot = Slot(node.label, node.aside)
    out.pages = 1
    texts = [x for x in node.items if isinstance(x, str)]
    out.total = len(texts)
    out.texts = {text_key(x): 1 for x in texts}
    for child in node.items:
        if isinstance(child, str):
            continue
        kid = skeleton(child)
        last = out.kids[-1] if out.kids else None
        if last is not None and last.label == kid.label and not last.kids and not kid.kids:
            last.total += kid.total
            last.texts.update(kid.texts)
        else:
            out.kids.append(kid)
    return out


def matching(a: list[Slot], b: list[Slot]) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two lists of siblings: the number of matched nodes, and the matched pairs."""
    n, m = len(a), len(b)
    if not n or not m:
        return 0, []
    if n == m and all(x.label == y.label for x, y in zip(a, b, strict=True)):
        return sum(1 + matching(x.kids, y.kids)[0] for x, y in zip(a, b, strict=True)), [(k, k) for k in range(n)]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n):
        row, above = best[i + 1], best[i]
        for j in range(m):
            value = max(row[j], above[j + 1])
            if a[i].label == b[j].label:
                value = max(value, above[j] + 1 + matching(a[i].kids, b[j].kids)[0])
            row[j + 1] = value
    pairs = []
    i, j = n, m
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return best[n][m], pairs[::-1]


def merge(into: Slot, other: Slot) -> None:
    """Aligns other with the wrapper and adds it."""
    into.pages += other.pages
    into.total += other.total
    into.slack += other.slack
    texts = into.texts
    for key, n in other.texts.items():
        texts[key] = texts.get(key, 0) + n
    most = max(COUNTERS, -(-PER_TEXT * into.total // into.pages))
    if len(texts) > 2 * most:
        cut = sorted(texts.values(), reverse=True)[most]
        into.texts = {k: n - cut for k, n in texts.items() if n > cut}
        into.slack += cut
    pairs = matching(into.kids, other.kids)[1]
    kids: list[Slot] = []
    i = j = 0
    for p, q in [*pairs, (len(into.kids), len(other.kids))]:
        kids += into.kids[i:p]
        kids += other.kids[j:q]
        if p < len(into.kids):
            merge(into.kids[p], other.kids[q])
            kids.append(into.kids[p])
        i, j = p + 1, q + 1
    into.kids = kids


def template_texts(slot: Slot) -> set[str]:
    """Texts that at least a CONSTANT share of the slot's pages has."""
    if slot.pages < LEAST_PAGES:
        return set()
    return {k for k, n in slot.texts.items() if n + slot.slack >= CONSTANT * slot.pages and n >= 0.5 * slot.pages}


def extract(page: str, wrapper: Slot | None) -> str:
    root = parse(page)
    blocks: list[str] = []

    def walk(node: Node, slot: Slot | None) -> None:
        template = template_texts(slot) if slot is not None and wrapper is not None else set()
        nodes = [x for x in node.items if isinstance(x, Node)]
        found: dict[int, Slot] = {}
        if slot is not None and nodes:
            # Leaf runs: each member is matched with the run's slot.
            runs: list[list[int]] = []
            kinds: list[Slot] = []
            for k, x in enumerate(nodes):
                kid = skeleton(x)
                if kinds and kinds[-1].label == kid.label and not kinds[-1].kids and not kid.kids:
                    runs[-1].append(k)
                else:
                    runs.append([k])
                    kinds.append(kid)
            for p, q in matching(slot.kids, kinds)[1]:
                for k in runs[q]:
                    found[k] = slot.kids[p]
        k = -1
        for item in node.items:
            if isinstance(item, str):
                if not template or text_key(item) not in template:
                    blocks.append(item)
                continue
            k += 1
            if not item.aside:
                walk(item, found.get(k))

    walk(root, wrapper)
    if not blocks and wrapper is not None:
        # A host whose pages are copies of one another: what recurs there is their content.
        wrapper = None
        walk(root, None)
    return "\n\n".join(blocks)


# --- the stages -------------------------------------------------------------------------------------------------

WRAPPERS = "host string, salt int, wrapper string"
#: Wrappers of all hosts go to every task while they are no larger than this; beyond it they are joined by host.
BROADCAST_BYTES = 16 << 20


def _host(url):
    return F.lower(F.coalesce(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))


def learn(pages: DataFrame, url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(host, wrapper) of every host, taught by all its pages. Pages without a host teach nothing.

    A host's partial wrappers, one or a few of each input partition, are merged in two rounds: in as many groups as the
    root of the number of partitions, then the groups.
    """
    salts = max(16, math.isqrt(pages.rdd.getNumPartitions()))

    def teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("wrappers")
        wrappers: dict[str, Slot] = {}

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(wrappers), pa.string()), pa.array([0] * len(wrappers), pa.int32()), pa.array([json.dumps(w.pack()) for w in wrappers.values()], pa.string())], names=["host", "salt", "wrapper"])

        for batch in batches:
            for host, page in zip(batch["host"].to_pylist(), batch["body"].to_pylist(), strict=True):
                own = skeleton(parse(page))
                if host in wrappers:
                    merge(wrappers[host], own)
                else:
                    wrappers[host] = own
            if len(wrappers) > 2000:  # bounded memory: partial wrappers are merged later
                yield out()
                wrappers.clear()
        if wrappers:
            yield out()

    def join(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        whole: Slot | None = None
        for row in sorted(table["wrapper"].to_pylist()):
            if whole is None:
                whole = Slot.unpack(json.loads(row))
            else:
                merge(whole, Slot.unpack(json.loads(row)))
        return pa.table({"host": pa.array([key[0].as_py()], pa.string()), "salt": pa.array([0], pa.int32()), "wrapper": pa.array([json.dumps(whole.pack())], pa.string())})

    rows = pages.select(_host(F.col(url_column)).alias("host"), F.coalesce(F.col(html_column).cast("string"), F.lit("")).alias("body")).where("host <> ''")
    parts = rows.mapInArrow(teach, WRAPPERS).withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(salts)).cast("int"))
    once = parts.groupBy("host", "salt").applyInArrow(join, WRAPPERS)
    return once.groupBy("host").applyInArrow(join, WRAPPERS).select("host", "wrapper")


def extract_pages(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    text is the blocks of the main article in page order, joined by two line feeds, with character references
    decoded and white space inside a block made one space; empty if there is none. Null html counts as empty; pages
    without a host are judged by their own trees; repeated rows stay; an empty table gives no rows; other columns are
    ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("wrappers")
        made: dict[str, Slot] = {}
        for batch in batches:
            texts = []
            for raw, page in zip(batch["wrapper"].to_pylist(), batch["body"].to_pylist(), strict=True):
                slot = None
                if raw:
                    if raw not in made:
                        if len(made) > 2000:
                            made.clear()
                        made[raw] = Slot.unpack(json.loads(raw))
                    slot = made[raw]
                texts.append(extract(page, slot).encode("utf-8", "replace").decode())
            yield pa.record_batch([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    wrappers = stored(learn(pages, url_column, html_column), "wrappers")
    size = wrappers.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host")).alias("n")).first()["n"] or 0
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"), _host(F.col(url_column)).alias("host"), F.coalesce(F.col(html_column).cast("string"), F.lit("")).alias("body"))
    joined = rows.join(F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers, "host", "left")
    return joined.select("page_id", "url", "body", "wrapper").mapInArrow(run, "page_id long, url string, text string, n_chars long")
