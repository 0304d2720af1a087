"""Operator 6: HTML extraction with site style trees.

The pages of a host are merged to one tree in which element nodes and presentation (style) nodes
alternate: a style node is the sequence of an element's children with their tags and attributes,
and its children are element nodes of their own. Nodes are 64-bit hashes of their paths, so that merging
is a grouped count. A text leaf is the more important the fewer of its pages share its content; an element
is the more important the more evenly its pages differ in style. Importance is composed from the
leaves up, and branches in which nothing is important are cut from each page. What few pages show says little of
the site, so importance is drawn to 1 by as many pages as EVIDENCE.

No host is ever held in one task: importance is composed by grouped sums, a level of the trees at a time for all hosts
together. Nodes of a single page have importance 1 and are left out of this, which are most.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, released, slices, written

#: A branch is cut when no node in it is more important than this.
THRESHOLD = 0.8
#: Weight of an element's own styles against what lies below, to the power of its number of styles.
GAMMA = 0.9
#: As many pages draw a node's importance to 1; without a difference between them a branch is cut from three pages on.
EVIDENCE = 7.0
#: Elements nested deeper are dissolved: their text belongs to the element of this depth.
DEEPEST = 100
#: More branches to cut than this are not broadcast, but joined to the pages that have them.
MOST_SENT = 200_000
#: Bytes of HTML that are parsed before a part of the result is handed on.
SLICE_BYTES = 1 << 22

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(script|style|noscript|template|textarea|svg)\b[^>]*>.*?(?:</\1\s*>|$)|<[a-zA-Z/!?][^>]*>|[^<]+|<", re.S | re.I)
#: Behind the last ">" no tag can end, so that none is looked for.
_TAIL = re.compile(r"<!--.*|[^<]+|<", re.S)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"""\s(class|id|style|width|align|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Formatting inside a text, which takes no part in the tree.
_INLINE = frozenset("b i em strong u s small big span font sub sup mark code br wbr abbr cite q".split())
_SKIP = frozenset("head".split())
_BLOCK = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: An open element of the key ends when one of the value begins.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}, "p": _BLOCK}


class Node:
    """An element, or a text leaf (tag "#text" with its text)."""

    __slots__ = ("tag", "attrs", "children", "text")

    def __init__(self, tag: str, attrs: str = "", text: str = ""):
        self.tag, self.attrs, self.children, self.text = tag, attrs, [], text


def _tokens(html: str) -> Iterator[re.Match]:
    last = html.rfind(">") + 1
    at = 0
    for m in _TOKEN.finditer(html, 0, last):
        at = m.end()
        # a comment or script that is open at the last ">" takes the rest along
        if at == last and last < len(html) and (m.group().startswith("<!--") or m.group(1)):
            whole = _TOKEN.match(html, m.start())
            yield whole
            at = whole.end()
            break
        yield m
    yield from _TAIL.finditer(html, at)


def parse(html: str) -> Node:
    """The element tree of a page: unclosed and misnested tags are mended, inline formatting is dissolved into text."""
    root = Node("#root")
    # open elements; below the deepest level the element of that level stands in their place
    stack, tags, count, buffer = [root], ["#root"], Counter(), []

    def flush() -> None:
        if buffer:
            text = " ".join(unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                stack[-1].children.append(Node("#text", "", text))

    def close(k: int) -> None:
        count.subtract(tags[k:])
        del stack[k:], tags[k:]

    for m in _tokens(html):
        token = m.group()
        if token[0] != "<" or len(token) == 1:
            buffer.append(token)
            continue
        if m.re is _TAIL or m.group(1):
            continue
        t = _TAG.match(token)
        if t is None:
            continue
        tag = t.group(2).lower()
        if tag in _INLINE:
            if tag in ("br", "wbr"):
                buffer.append(" ")
            continue
        flush()
        if t.group(1):
            if count[tag] > 0:
                k = len(tags) - 1
                while tags[k] != tag:
                    k -= 1
                close(k)
            continue
        while len(stack) > 1 and tag in _ENDS.get(tags[-1], ()):
            close(len(tags) - 1)
        node = stack[-1]
        if len(stack) <= DEEPEST:
            attrs = " ".join(sorted(f"{a.lower()}={v.strip(chr(34) + chr(39))}" for a, v in _ATTR.findall(token))) if " " in token else ""
            node = Node(tag, attrs)
            stack[-1].children.append(node)
        if tag not in _VOID and not token.endswith("/>"):
            stack.append(node)
            tags.append(tag)
            count[tag] += 1
    flush()
    return root


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def walk(root: Node) -> Iterator[tuple[int, int, int, int, int, Node]]:
    """(parent style, element, style or content, children or 0 for a leaf, depth, node) of every node, parents first."""
    stack = [(root, 0, _hash("#root"), 0)]
    while stack:
        node, parent, key, depth = stack.pop()
        if node.tag == "#text" or not node.children:
            yield parent, key, _hash(node.text), 0, depth, node
            continue
        style = _hash(f"{key}" + "".join(f"<{c.tag} {c.attrs}>" for c in node.children))
        kids = [(c, style, _hash(f"{style}/{i}"), depth + 1) for i, c in enumerate(node.children) if c.tag not in _SKIP]
        yield parent, key, style, len(kids) or -1, depth, node
        stack += kids


def extract(root: Node, cut: frozenset[int] | set[int]) -> tuple[str, int]:
    """Text of the page without the cut branches, a line for each text leaf, and the number of branches cut."""
    lines, gone = [], 0
    stack = [(root, _hash("#root"))]
    while stack:
        node, key = stack.pop()
        if key in cut:
            gone += 1
            continue
        if node.tag == "#text":
            lines.append(node.text)
        elif node.children:
            style = _hash(f"{key}" + "".join(f"<{c.tag} {c.attrs}>" for c in node.children))
            stack += [(c, _hash(f"{style}/{i}")) for i, c in reversed(list(enumerate(node.children))) if c.tag not in _SKIP]
    return "\n".join(lines), gone


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


_NODES = "array<struct<p bigint, e bigint, x bigint, kids int, d int>>"
_UNSIGNED = 0xFFFFFFFFFFFFFFFF


def _nodes(html: Column) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            for a, b in slices(pages, SLICE_BYTES):
                ends, out = [0], ([], [], [], [], [])
                for h in pages.slice(a, b - a):
                    for *row, _ in walk(parse(h.as_py() or "")):
                        for column, v in zip(out, row):
                            column.append(v)
                    ends.append(len(out[0]))
                columns = [pa.array(c, pa.uint64()).view(pa.int64()) for c in out[:3]] + [pa.array(c, pa.int32()) for c in out[3:]]
                yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, ["p", "e", "x", "kids", "d"]))

    return F.arrow_udf(released(run), _NODES)(html)


_TEXT = "struct<text string, gone int>"


def _extracted(pages: pa.Array, cuts: Iterator) -> pa.Array:
    texts, gone = [], []
    for h, cut in zip(pages, cuts):
        t, n = (None, None) if (h := h.as_py()) is None else extract(parse(h), cut)
        texts.append(t)
        gone.append(n)
    return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(gone, pa.int32())], ["text", "gone"])


def _with_list(html: Column, cut: Column) -> Column:
    """Texts of pages, each with the list of its own branches to cut."""

    def run(pages: pa.Array, cuts: pa.Array) -> pa.Array:
        return _extracted(pages, ({v & _UNSIGNED for v in c.as_py() or ()} for c in cuts))

    run.__annotations__ = {"pages": pa.Array, "cuts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, _TEXT)(html, cut)


def _with_sent(html: Column, host: Column, sent) -> Column:
    """Texts of pages by the branches to cut of all hosts, which were broadcast as {host: branches}."""

    def run(pages: pa.Array, hosts: pa.Array) -> pa.Array:
        return _extracted(pages, (sent.value.get(h.as_py(), frozenset()) for h in hosts))

    run.__annotations__ = {"pages": pa.Array, "hosts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, _TEXT)(html, host)


def _drawn(own: Column, evidence: float) -> Column:
    """An importance, drawn to 1 by the number of pages m that it rests on."""
    return 1 - (1 - own) * (F.col("m") - 1) / (F.col("m") - 1 + F.lit(evidence))


def unimportant(counts: DataFrame, threshold: float = THRESHOLD, gamma: float = GAMMA, evidence: float = EVIDENCE, scratch: Scratch | None = None) -> DataFrame:
    """(host, e): topmost elements below which, themselves included, nothing is important.

    counts has a row (host, p, e, x, kids, d, n) for each element at depth d and each of its styles (x with that many
    kids, -1 for none that counts) or contents (kids 0), which n pages have.
    """
    n, m, written = F.col("n"), F.col("m"), (scratch or Scratch()).written
    # all that one page alone has is of importance 1: its styles are summed up with their element
    leaf, style, single = F.col("kids") == 0, F.col("kids") != 0, (F.col("kids") != 0) & (n == 1)
    element = counts.groupBy("host", "p", "e", "d").agg(
        F.sum("n").alias("m"), F.count_if(leaf).alias("contents"), F.sum(F.when(leaf, F.log("n"))).alias("h"), F.count_if(style).alias("styles"),
        F.sum(F.when(style, n * F.log("n"))).alias("spread"), F.sum(F.when(style, n)).alias("styled"), F.count_if(single & (F.col("kids") > 0)).alias("single"),
    )
    element = written(element.where(m > 1), "elements")
    style = written(counts.where(style & (n > 1)).select("host", "e", "d", "x", "kids", "n"), "styles")
    last = element.agg(F.max("d")).first()[0]
    done, levels = None, []
    for d in range(-1 if last is None else last, -1, -1):
        now = element.where(F.col("d") == d)
        below = style.where(F.col("d") == d).select("host", "e", "x", "kids", "n")
        if done is None:
            below = below.withColumns({"own": F.lit(None).cast("double"), "most": F.lit(None).cast("double")})
        else:
            kids = done.groupBy("host", "p").agg(F.sum("own").alias("own"), F.max("most").alias("most")).toDF("kh", "kp", "own", "most")
            below = below.join(kids, (F.col("host") == F.col("kh")) & (F.col("x") == F.col("kp")), "left")
        below = below.groupBy("host", "e").agg(F.sum(n * F.coalesce("own", F.lit(0.0)) / F.greatest("kids", F.lit(1))).alias("under"), F.max("most").alias("under_most")).toDF("bh", "be", "under", "under_most")
        now = now.join(below, (F.col("host") == F.col("bh")) & (F.col("e") == F.col("be")), "left")
        # entropy to the base m of the shares n / m
        entropy = (F.col("styled") * F.log(m) - F.col("spread")) / m / F.log(m)
        weight = F.pow(F.lit(gamma), F.col("styles"))
        own = (1 - weight) * entropy + weight * (F.coalesce("under", F.lit(0.0)) + F.col("single")) / m
        own = _drawn(F.when(F.col("styles") > 0, own).otherwise(1 - F.col("h") / F.log(m) / F.col("contents")), evidence)
        now = now.withColumn("own", own).withColumn("most", F.greatest("own", "under_most", F.when(F.col("single") > 0, F.lit(1.0))))
        done = written(now.select("host", "p", "e", "own", "most"), "importance")
        levels.append(done)
    if not levels:
        return counts.select("host", "e").limit(0)
    every = reduce(DataFrame.union, levels)
    # a branch is cut where its parent is not
    above = style.select("host", "e", "x").join(every.where(F.col("most") > threshold).select("host", "e"), ["host", "e"]).select("host", F.col("x").alias("p")).distinct()
    low = every.where(F.col("most") <= threshold).select("host", "p", "e")
    return low.join(above, ["host", "p"], "left_semi").select("host", "e").union(low.where("p = 0").select("host", "e"))


def main_text(pages: DataFrame, threshold: float = THRESHOLD, evidence: float = EVIDENCE, most_sent: int = MOST_SENT) -> DataFrame:
    """(page_id, url, main_text, branches_cut) for every row of pages.

    Pages whose URL has no host are sites of their own, of which nothing is cut. What a host shows on few different pages is
    the less likely cut the fewer they are (EVIDENCE), and what it shows on one or two never is. A null page has null
    main_text and branches_cut; an empty one an empty text. Exact copies of a page within a host count as one page. Broken
    markup is read as far as it goes; elements nested deeper than DEEPEST are dissolved into the one of that depth, with
    their whole text. Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    host = host_of(F.col("url"))
    rows = pages.select("page_id", "url", "html", F.when(host.isNotNull(), F.xxhash64(host)).alias("host"), F.xxhash64("html").alias("content"))
    seen = rows.where("host is not null and html is not null")
    scratch = Scratch()  # tables that nothing reads any more once the branches to cut are written
    copies = scratch.written(seen.groupBy("host", "content").agg(F.count("*").alias("copies")).where("copies > 1"), "copies")
    weight = 1 / F.coalesce(F.col("copies"), F.lit(1))
    node = seen.join(copies, ["host", "content"], "left").select("host", weight.alias("w"), F.explode(_nodes(F.col("html"))).alias("o")).select("host", "w", "o.*")
    # copies of a page have the same nodes, so that their weights add up to one
    counts = scratch.written(node.groupBy("host", "p", "e", "x", "kids", "d").agg(F.round(F.sum("w")).cast("bigint").alias("n")), "nodes")
    cut = written(unimportant(counts, threshold, evidence=evidence, scratch=scratch), "cuts")
    scratch.clear()
    if cut.count() <= most_sent:
        by_host: dict[int, set[int]] = {}
        for h, e in cut.collect():
            by_host.setdefault(h, set()).add(e & _UNSIGNED)
        got = rows.select("page_id", "url", _with_sent(F.col("html"), F.col("host"), pages.sparkSession.sparkContext.broadcast(by_host)).alias("t"))
    else:
        own = seen.select("host", "content", F.explode(_nodes(F.col("html"))).alias("o")).select("host", "content", F.col("o.e").alias("e"))
        own = own.join(cut, ["host", "e"]).groupBy("host", "content").agg(F.collect_set("e").alias("cut"))
        got = rows.join(own, ["host", "content"], "left").select("page_id", "url", _with_list(F.col("html"), F.col("cut")).alias("t"))
    return got.select("page_id", "url", F.col("t.text").alias("main_text"), F.col("t.gone").alias("branches_cut"))
