"""HTML extraction by a site style tree.

Pages of a host are merged into one tree of styles. A node is the path of block elements with their classes; it counts its
distinct pages, its child styles, the contents of its text blocks, its words and those inside links. A node's importance is
its entropy (of child styles: presentation; of contents: a block seen on every page carries nothing), less its share of
links, and outside the main stretch of a page less for a small share of the page's words. The tree decides on every node
that enough pages share: the trunk, nodes once on a page with most of its words, leads to the main text; branches off the
trunk and below it are cut where their importance is low. What tags and class names say only lowers a node's importance
there. It decides alone where a host or a node has too few pages for entropy to count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import Work, table


@dataclass(frozen=True)
class Settings:
    #: Least distinct pages of a host with a node before its entropy counts.
    pages: int = 4
    #: Importance under which a branch goes, off the trunk (with its share of words) and below it.
    outside: float = 0.33
    inside: float = 0.1
    #: Weight of the contents against the presentation.
    contents: float = 0.9
    #: Share of a page's words from which a node that is once on a page is of the trunk.
    trunk: float = 0.5
    #: What a node's importance is multiplied by if its tag or class says noise.
    named: float = 0.5
    #: Nodes up to which they travel with the tasks (16 bytes each); beyond it a salted join takes their place.
    most_sent: int = 200_000
    salts: int = 32


#: Elements nested deeper than this belong to the node of their ancestor at this depth; their text stays.
DEEP = 48

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|textarea|title)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>",
    re.S | re.I,
)
#: Elements that go with what they hold, if their end tag is there. Of the first two a tag may also close itself.
_HOLLOW = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in ("svg", "iframe", "noscript", "template", "select", "button")}
_SELF = ("svg", "iframe")
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_NOISE = frozenset("nav aside footer form menu dialog".split())
_MAIN = frozenset(("article", "main"))
_SAYS = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|sidebar|side-?nav|nav|navbar|navigation|menu|breadcrumbs?|footer|site-header|masthead|cookies?|consent|notice|notification|popup|modal|newsletter|subscribe|share|sharing|social|related|recommended|comments?|comment-list|disqus|respond|replies|complementary|contentinfo)(?:$|[\s_-])", re.I)
#: Layout words that say what a wrapper has beside it, not what it is.
_BESIDE = re.compile(r"(?:^|(?<=\s))(?:has|no|not|with|without)[-_]\S*", re.I)


def _hash(*x: str) -> int:
    from xxhash import xxh64_intdigest

    h = xxh64_intdigest("\x00".join(x))
    return h - (1 << 64) if h >> 63 else h


ROOT = _hash("")


@dataclass
class Block:
    text: str
    path: tuple[int, ...]
    noise: bool
    main: bool
    words: int
    linked: int


@dataclass
class _Open:
    tag: str
    path: tuple[int, ...]
    noise: bool
    main: bool
    head: bool
    named: bool
    children: list[str] = field(default_factory=list)


#: Bits of what is known of a node from its tags: below an article or main, a heading or below one, named as noise.
BELOW_MAIN, HEADING, NAMED = 1, 2, 4


def blocks(html: str | None) -> tuple[list[Block], dict[int, tuple[int, int, int, list[tuple[str, ...]]]]]:
    """Text blocks in page order, and each node's parent, flags, occurrences and the child styles of each occurrence."""
    out: list[Block] = []
    nodes: dict[int, tuple[int, int, int, list[tuple[str, ...]]]] = {}
    stack = [_Open("", (), False, False, False, False)]
    opened: dict[str, list[int]] = {}
    text: list[str] = []
    links: list[str] = []
    in_link = False

    def flush() -> None:
        if text:
            if joined := " ".join(found := unescape("".join(text)).split()):
                top = stack[-1]
                out.append(Block(joined, top.path, top.noise, top.main, len(found), len(unescape(" ".join(links)).split()) if links else 0))
            text.clear(), links.clear()

    def close(k: int) -> None:
        while len(stack) > k:
            o = stack.pop()
            opened[o.tag].pop()
            parent, flags, n, styles = nodes[o.path[-1]]
            if o.children:
                styles.append(tuple(dict.fromkeys(o.children)))
            nodes[o.path[-1]] = parent, flags, n + 1, styles

    def put(part: str) -> None:
        text.append(part)
        if in_link:
            links.append(part)

    at = 0
    html = html or ""
    open_ended: set[str] = set()  # no end tag is left
    while m := _TOKEN.search(html, at):
        if m.start() > at:
            put(html[at : m.start()])
        at = m.end()
        tag = m[3]
        if not tag:
            continue
        tag = tag.lower()
        if tag not in _BLOCKS:
            if tag == "br":
                text.append(" ")
            elif tag == "a":
                in_link = not m[2]
            elif tag in _HOLLOW and not m[2] and tag not in open_ended and not (tag in _SELF and m[4].endswith("/")):
                end = _HOLLOW[tag].search(html, at)
                if end:
                    at = end.end()
                else:
                    open_ended.add(tag)
            continue
        flush()
        in_link = False
        if m[2]:
            if opened.get(tag):
                close(opened[tag][-1])
            continue
        while stack[-1].tag == "p" or (tag == "li" and stack[-1].tag == "li") or (tag in ("dd", "dt") and stack[-1].tag in ("dd", "dt")) or (tag in ("td", "th") and stack[-1].tag in ("td", "th")):
            close(len(stack) - 1)
        if tag in _VOID or m[4].endswith("/"):
            continue
        said = " ".join(x[1] or x[2] or x[3] for x in _NAMES.findall(m[4])) if m[4] else ""
        top = stack[-1]
        named = tag in _NOISE or (tag == "header" and not top.main) or bool(said and tag not in ("body", "html", "article", "main") and _SAYS.search(_BESIDE.sub("", said)))
        style = f"{tag}.{said}" if said else tag
        top.children.append(style)
        parent = top.path[-1] if top.path else ROOT
        path = top.path if len(top.path) >= DEEP else (*top.path, _hash(str(parent), style))
        o = _Open(tag, path, top.noise or named, top.main or tag in _MAIN, top.head or tag in _HEADS, named)
        if path is not top.path and path[-1] not in nodes:
            nodes[path[-1]] = parent, BELOW_MAIN * top.main | HEADING * o.head | NAMED * named, 0, []
        opened.setdefault(tag, []).append(len(stack))
        stack.append(o)
    if at < len(html):
        put(html[at:])
    flush()
    close(1)
    return out, nodes


def host(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


_FIELDS = ("node", "kind", "what", "flags", "times", "words", "linked")
_ENTRIES = "array<struct<node:long,kind:int,what:long,flags:int,times:int,words:int,linked:int>>"


def entries(found: list[Block], nodes: dict) -> list[tuple[int, ...]]:
    """A page's entries (node, kind, what, flags, times, words, linked). kind 0: the node, its parent as what, with times, words and linked words; 1: child styles of an occurrence; 2: a content at or below it."""
    words: dict[int, int] = {ROOT: 0}
    linked: dict[int, int] = {}
    out = set()
    for x in found:
        content = _hash(x.text)
        words[ROOT] += x.words
        for node in x.path:
            words[node] = words.get(node, 0) + x.words
            linked[node] = linked.get(node, 0) + x.linked
            out.add((node, 2, content, 0, 0, 0, 0))
    for node, (parent, flags, times, styles) in nodes.items():
        out.add((node, 0, parent, flags, times, words.get(node, 0), linked.get(node, 0)))
        out.update((node, 1, _hash(*s), 0, 0, 0, 0) for s in styles)
    out.add((ROOT, 0, 0, 0, 1, words[ROOT], 0))
    return sorted(out)


def copy_of(found: list[Block]) -> int:
    """The same for pages of the same texts; texts that tags or classes call noise don't count, so that a menu of its own makes no page of its own."""
    return _hash(*(x.text for x in found if not x.noise))


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, copy, entries) of each page."""
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
    for b in batches:
        hosts, copies, ends = [], [], [0]
        rows: list[tuple[int, ...]] = []
        for url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            found, nodes = blocks(html)
            rows += entries(found, nodes)
            hosts.append(host(url)), copies.append(copy_of(found)), ends.append(len(rows))
        columns = zip(*rows, strict=True) if rows else [[] for _ in types]
        held = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], list(_FIELDS))
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(copies, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), held)], ["host", "copy", "entries"])


#: Bits of a verdict: of the trunk, its last node, low off the trunk, low below it.
TRUNK, LAST, LOW_OUTSIDE, LOW_INSIDE = 1, 2, 4, 8


def style_tree(pages: DataFrame, work: Work, s: Settings = Settings()) -> DataFrame:
    """(host, node, parent, flags, pages, share, entropy, links) of the nodes on at least s.pages distinct pages of a host.

    With m pages, entropy is (1 - w) P + w C: P = -sum p log_m p over child styles, and C = 1 - mean log_m(c) over
    the pages' contents, c the pages that hold one; w is s.contents, 1 without child styles. links is the share of words inside links,
    share that of the words of the pages. Pages of a host with the same texts are copies and count once, with the least of
    their entries.
    """
    found = pages.select("url", "html").mapInArrow(_entries, f"host string, copy long, entries {_ENTRIES}")
    distinct = work.write(found).groupBy("host", "copy").agg(F.min("entries").alias("entries"))
    each = distinct.select("host", F.inline("entries"))
    counts = each.groupBy("host", "node", "kind", "what").agg(F.count("*").alias("n"), F.max("flags").alias("flags"), *[F.sum(c).alias(c) for c in ("times", "words", "linked")])
    n = F.col("n").cast("double")
    own = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x))
    per = counts.groupBy("host", "node").agg(
        own(0, n).alias("m"), F.max(F.when(F.col("kind") == 0, F.col("what"))).alias("parent"), F.max("flags").alias("flags"),
        own(0, F.col("times")).alias("times"), own(0, F.col("words")).cast("double").alias("words"), own(0, F.col("linked")).alias("linked"),
        own(1, n).alias("p"), own(1, n * F.ln(n)).alias("p_log"), own(2, n).alias("c"), own(2, n * F.ln(n)).alias("c_log"),
    ).where(F.col("m") >= s.pages)
    per = work.write(per)
    base = F.ln("m")
    shape = F.coalesce((F.ln("p") - F.col("p_log") / F.col("p")) / base, F.lit(0.0))
    contents = F.coalesce(1 - F.col("c_log") / F.col("c") / base, F.lit(0.0))
    entropy = F.when(F.col("p").isNull(), contents).otherwise((1 - s.contents) * shape + s.contents * contents)
    root = per.where(F.col("node") == ROOT).select("host", (F.col("words") / F.col("m")).alias("of"))
    tree = per.where(F.col("node") != ROOT).join(root, "host")
    share = F.coalesce(F.try_divide(F.col("words") / F.col("m"), F.col("of")), F.lit(0.0))
    links = F.coalesce(F.try_divide(F.col("linked"), F.col("words")), F.lit(0.0))
    return tree.select("host", "node", "parent", "flags", F.col("m").cast("long").alias("pages"), "times", share.alias("share"), entropy.alias("entropy"), links.alias("links"))


def verdicts(tree: DataFrame, work: Work, s: Settings = Settings()) -> DataFrame:
    """(host, node, verdict bits) of every node of the tree.

    Importance is entropy * (1 - links), halved (s.named) if tag or class says noise; off the trunk it is also multiplied
    by twice the share of words, up to 1, as it is wherever a node is named so. Headings go by the rule below the trunk.
    """
    flag = lambda bit: F.col("flags").bitwiseAND(F.lit(bit)) != 0
    trunk = (F.col("share") >= s.trunk) & (F.col("times") <= 1.5 * F.col("pages")) & ~flag(BELOW_MAIN) & ~flag(HEADING)
    pure = F.col("entropy") * (1 - F.col("links"))
    whole = pure * F.least(F.lit(1.0), 2 * F.col("share")) * F.when(flag(NAMED), s.named).otherwise(1.0)
    inside = F.when(flag(NAMED), whole < s.outside).otherwise(pure < s.inside)
    outside = F.when(flag(HEADING) & ~flag(NAMED), inside).otherwise(whole < s.outside)
    tree = work.write(tree.select("host", "node", "parent", trunk.alias("trunk"), outside.alias("outside"), inside.alias("inside")))
    onward = tree.where("trunk").select("host", F.col("parent").alias("node"), F.lit(True).alias("onward")).distinct()
    bit = lambda c, b: F.when(c, b).otherwise(0)
    verdict = bit(F.col("trunk"), TRUNK) + bit(F.col("trunk") & F.col("onward").isNull(), LAST) + bit(F.col("outside"), LOW_OUTSIDE) + bit(F.col("inside"), LOW_INSIDE)
    return work.write(tree.join(onward, ["host", "node"], "left").select("host", "node", verdict.cast("int").alias("verdict")))


def kept(x: Block, known: dict[int, int], article: bool) -> tuple[bool, bool]:
    """Whether a block stays, and whether the tree said so: from the first node on that it doesn't know, names decide."""
    last = 0
    for node in x.path:
        v = known.get(node)
        if v is None:
            return not x.noise and (x.main or not article), False
        if last is not None and v & TRUNK:
            last = v
        elif v & (LOW_OUTSIDE if last is not None and not last & LAST else LOW_INSIDE):
            return False, True
        else:
            last = None
    return True, True


def _text(html: str | None, known: dict[int, int]) -> tuple[str, int, int]:
    """The text, and the blocks that the tree and that the names cut."""
    found, _ = blocks(html)
    article = any(x.main and not x.noise for x in found)
    out, cut = [], [0, 0]
    for x in found:
        stays, by_tree = kept(x, known, article)
        if stays:
            out.append(x.text)
        else:
            cut[not by_tree] += 1
    return "\n\n".join(out), *cut


_OUT = "url string, text string, cut_by_tree int, cut_by_name int"


def _batch(b: pa.RecordBatch, known: list[dict[int, int]]) -> pa.RecordBatch:
    found = [_text(html, k) for html, k in zip(b.column(2).to_pylist(), known, strict=True)]
    text, tree, name = zip(*found, strict=True) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(tree, pa.int32()), pa.array(name, pa.int32())], ["page_id", "url", "text", "cut_by_tree", "cut_by_name"])


def extract(pages: DataFrame, s: Settings = Settings()) -> DataFrame:
    """page_id, url, the main text of each row ("" if there is none), and how many blocks the tree and the names cut.

    A null html is empty; a null url is a host of its own. On hosts of fewer than s.pages distinct pages, and at nodes of
    fewer, tags and class names decide: an article is the main text; without one all of the body is, less what is named
    noise. Copies count as one page, and repeated rows get the same text. Ties of importance with a threshold stay. An
    empty table gives no rows. Columns other than page_id (of any type), url and html are left out. Elements without an end tag
    lose their tag alone, but for script, style, textarea and title, which go on to the end of the page as in a browser.
    """
    work = Work(pages.sparkSession, "pages")
    known = verdicts(style_tree(pages, work, s), work, s)
    rows = pages.select("page_id", "url", "html")
    out = f"page_id {rows.schema['page_id'].dataType.simpleString()}, {_OUT}"
    if known.count() <= s.most_sent:
        held: dict[str, dict[int, int]] = {}
        for h, node, verdict in known.limit(s.most_sent).collect():
            held.setdefault(h, {})[node] = verdict
        sent = pages.sparkSession.sparkContext.broadcast(held)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield _batch(b, [sent.value.get(host(url), {}) for url in b.column(1).to_pylist()])

        return rows.mapInArrow(run, out)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _batch(b, [{y["node"]: y["verdict"] for y in x or []} for x in b.column(3).to_pylist()])

    of = F.lower(F.regexp_extract("url", r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    per_host = known.groupBy("host").agg(F.collect_list(F.struct("node", "verdict")).alias("known"))
    per_host = per_host.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(s.salts - 1))))
    rows = rows.withColumns({"host": F.coalesce(of, F.lit("")), "salt": F.pmod(F.xxhash64("page_id", "url"), F.lit(s.salts)).cast("int")})
    return rows.join(per_host, ["host", "salt"], "left").select("page_id", "url", "html", "known").mapInArrow(joined, out)


def op5_site_style_tree_html(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "cut_by_tree", "cut_by_name")
