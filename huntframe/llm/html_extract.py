"""Main text of web pages by site style trees.

The pages of a host are merged into one tree: a node is a path of element names and classes,
and it keeps in how many pages it occurs, which sequences of children it was presented with,
and which texts it had.  A text that occurs in k of the node's m pages has entropy
log k / log m, so a node's content counts for 1 - the mean entropy of its texts: 1 where every
page says something else, 0 where all say the same.  A node's presentation counts for the
entropy of its child sequences.  A branch's importance is the mean over its nodes, by their
texts, discounted with depth.  Pages of one host with the same html are one page of its tree.

A branch of a page stays if what speaks for it outweighs what speaks against it:

* The tree's evidence is ``(importance - UNDECIDED) * WEIGHT``, times 1 - 2 / (m + 1): one page of a
  branch says nothing, two little, and there is no number of pages at which a rule changes.
* Markup is a prior (``PRIORS``): a box or a paragraph stays unless its site says that it is the
  same everywhere.  What elements marked as the article (``article``, ``main``) weigh depends on
  the share of the page's text, headings aside, that they hold: from half of it on paragraphs in
  them weigh more than any evidence, so that passages that many articles share stay, and up to a
  quarter no more than any other box.  What stands beside elements that hold most of the text, or
  is called a menu, header, footer, form, advert, comment, ..., weighs less than any evidence.
  The latter count nowhere in the tree.

A branch goes only together with all below it.  A page that would lose all of its text has
nothing to compare: it is left to the priors.  Names are whole tokens of class, id and role;
what they leave in doubt (``has-sidebar``, ``comments-open``) the tree decides.

The tree is built from counts, aggregated before they are shuffled: a host with a third of all
pages is no larger a group than its template.  Parsing takes time in proportion to the page,
however its tags are broken.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huntframe.llm.store import written

UNDECIDED, WEIGHT = 0.6, 2.5
#: What markup says for a branch; evidence is between -1.5 and 1.
PRIORS = {"article": 3.0, "flow of a marked article": 2.0, "any other": 0.5}
#: Shares of a page's text between which its marked articles come to weigh more than any other branch.
SHARES = (0.25, 0.5)
DISCOUNT = 0.9
#: A table of hosts' branches is broadcast up to this many rows, of some 100 bytes each.
BROADCAST_BRANCHES = 100_000

#: A tag that has no ``<`` inside; it is never looked for beyond the next one.
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']++|\"[^<>\"]*+\"|'[^<>']*+')*+)>")
OPENING = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
QUOTE_OR_END = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-a-zA-Z0-9_:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
# Fixed values of the HTML standard.
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "xmp", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins",
    "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time",
    "tt", "u", "var", "wbr", "br",
}
FLOW = {
    "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "blockquote", "pre", "table", "thead",
    "tbody", "tfoot", "tr", "td", "th", "caption", "figure", "figcaption", "hr",
}
CLOSES_P = (FLOW | {"address", "article", "aside", "div", "footer", "form", "header", "main", "nav", "section"}) - {"tbody", "tr", "td", "th"}
#: Elements that a new one of some name ends, and where the search for an open one stops.
ENDS = (({"p"}, CLOSES_P, None), ({"li"}, {"li"}, {"ul", "ol"}), ({"dt", "dd"}, {"dt", "dd"}, {"dl"}), ({"tr"}, {"tr"}, {"table"}), ({"td", "th"}, {"td", "th"}, {"tr"}))
#: Elements that are never main text.
NOT_TEXT = {"head", "nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "svg", "canvas", "audio", "video", "object", "fieldset", "search"} | RAW
# Whole tokens of class, id and role that say that a branch is not the article: one or more such words, joined by
# hyphens, with what they hold.  No word is in two of the lists, so a token is read in one way only.
_NOT_ARTICLE = (
    r"(?:ads?|advert(?:s|isements?|ising)?|adsense|sponsor(?:s|ed)?|promo(?:s|ted|tions?)?|billboard|side-?bar|cookies?|consent|gdpr|"
    r"pop-?up|modal|overlay|newsletter|subscribe|sign-?up|log-?in|share|sharing|social|related|recommend(?:ed|ations?)?|comments?|disqus|"
    r"replies|respond|breadcrumbs?|nav|navbar|navigation|menu|pagination|pager|footer|masthead|toolbar|complementary|contentinfo|search|"
    r"banner|widgets?|notices?|remarks?)"
)
_HELD = r"(?:bars?|box(?:es)?|lists?|links?|buttons?|btns?|icons?|areas?|container|wrap|wrapper|blocks?|forms?|items?|posts|articles|stories|notice|slots?|units?|panel|thread|inner|[0-9]+)"
NOT_ARTICLE = re.compile(
    rf"(?:(?:site|page|main|primary|secondary|post|entry|article|reader|user|visitor)[-_]+)?{_NOT_ARTICLE}(?:[-_]+(?:{_NOT_ARTICLE}|{_HELD}))*|(?:site|page)-?header|skip-?links?|advert(?:isements?)?[-_][a-z0-9]+", re.I
)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
ARTICLE = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


class Node:
    """An element that makes a block of its own; ``parts`` are its texts and children in order."""

    __slots__ = ("cut", "marked", "name", "parts", "path")

    def __init__(self, name: str, path: int, cut: bool, marked: bool):
        self.name, self.path, self.cut, self.marked, self.parts = name, path, cut, marked, []


@lru_cache(1 << 14)
def _not_article(marks: str) -> bool:
    return any(map(NOT_ARTICLE.fullmatch, marks.split()))


def _named_away(parent: Node, name: str, found: dict[str, str]) -> bool:
    """Whether class, id or role say that an element is not the article.

    Articles and their flow have any name, and the ids of headings, and of sections in an
    article, are made from titles.
    """
    if name in ARTICLE or name in ("html", "body") or (parent.marked and name in FLOW):
        return False
    classes = found.get("class", "")
    title = name in HEADINGS or (parent.marked and (name == "section" or "section" in classes.lower().split()))
    return any(map(_not_article, (classes, found.get("role", ""), "" if title else found.get("id", ""))))


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def _made(parent: Node, name: str, attributes: str) -> Node:
    kind, named, hidden = name, False, False
    if attributes:
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
        named = _named_away(parent, name, found)
        hidden = "hidden" in found or found.get("aria-hidden") == "true" or bool(HIDDEN.search(found.get("style", "")))
        kind += "." + ".".join(sorted(found.get("class", "").lower().split()))
    # A header of the page goes; the header of an article holds its title.
    header = name == "header" and not parent.marked
    cut = parent.cut or hidden or name in NOT_TEXT or header or named
    node = Node(name, _hash(f"{parent.path}/{kind}"), cut, (parent.marked or name in ARTICLE) and not cut)
    parent.parts.append(node)
    return node


def _tag_end(html: str, at: int, plain: int) -> tuple[int, int]:
    """Where a tag ends that has a ``>`` somewhere, and up to where quotes in tags mean nothing.

    A quote that never closes would be looked for again by every tag before it, so up to there
    the next ``>`` ends a tag.
    """
    i = at
    while at >= plain:
        m = QUOTE_OR_END.search(html, i)
        if m is None:
            plain = len(html)
        elif m[0] == ">":
            return m.end(), plain
        else:
            i = html.find(m[0], m.end()) + 1
            if not i:
                plain = m.end()
    return html.find(">", at) + 1, plain


def markup(html: str) -> Iterator[tuple[str, str, str, str, int]]:
    """(text before, "/" or "", name, attributes, end) of each tag; comments and declarations have no name."""
    start = at = plain = 0
    last = html.rfind(">")
    while (lt := html.find("<", at)) >= 0:
        slash = name = attributes = ""
        if m := TAG.match(html, lt):
            (slash, name, attributes), end = m.groups(), m.end()
        elif html.startswith("<!--", lt):
            end = html.find("-->", lt + 4) + 3
            end = len(html) if end < 3 else end
        elif lt > last:
            break
        elif html.startswith(("<!", "<?"), lt):
            end = html.find(">", lt) + 1
        elif m := OPENING.match(html, lt):
            end, plain = _tag_end(html, m.end(), plain)
            slash, name, attributes = m[1], m[2], html[m.end() : end - 1]
        else:
            at = lt + 1
            continue
        skipped = yield html[start:lt], slash, name.lower(), attributes, end
        start = at = end if skipped is None else skipped
    yield html[start:], "", "", "", len(html)


def parsed(html: str | None) -> Node:
    """The block elements of a page; inline elements only carry text.  Never fails on bad markup."""
    html = html or ""
    root = Node("#page", _hash(""), False, False)
    stack = [root]
    near = [(0,) * len(ENDS)]  # for each level and row of ENDS, the level of the open element that it would end, or 0
    opened: dict[str, int] = {}

    def close(depth: int) -> None:
        for node in stack[depth:]:
            opened[node.name] -= 1
        del stack[depth:], near[depth:]

    tags = markup(html)
    found = next(tags, None)
    while found is not None:
        text, slash, name, attributes, end = found
        skip = None
        if text:
            stack[-1].parts.append(text)
        if slash:
            if opened.get(name):
                close(next(d for d in range(len(stack) - 1, 0, -1) if stack[d].name == name))
        elif name == "br":
            stack[-1].parts.append(" ")
        elif name in RAW:
            m = re.compile(rf"</{name}(?![a-z0-9:-])", re.I).search(html, end)
            skip = html.find(">", m.end()) + 1 if m else 0
            skip = skip or len(html)
        elif name and name not in INLINE:
            for k, (_, by, _) in enumerate(ENDS):
                if name in by and near[-1][k]:
                    close(near[-1][k])
            node = _made(stack[-1], name, attributes)
            if name not in VOID and not attributes.rstrip().endswith("/"):
                at = len(stack)
                line = [at if name in ends else 0 if (name not in FLOW if stops is None else name in stops) else up for (ends, _, stops), up in zip(ENDS, near[-1], strict=True)]
                stack.append(node)
                near.append(tuple(line))
                opened[name] = opened.get(name, 0) + 1
        try:
            found = tags.send(skip)
        except StopIteration:
            break
    return root


def _clean(texts: list[str]) -> str:
    return " ".join(unescape("".join(texts)).split())


def blocks(node: Node) -> Iterator[tuple[Node, str]]:
    """(node, text) of each run of text between block borders, in page order, without recursion."""
    todo: list = [(node, iter(node.parts), [])]
    while todo:
        owner, parts, run = todo[-1]
        for part in parts:
            if isinstance(part, str):
                run.append(part)
                continue
            if run and (text := _clean(run)):
                yield owner, text
            run.clear()
            todo.append((part, iter(part.parts), []))
            break
        else:
            if run and (text := _clean(run)):
                yield owner, text
            todo.pop()


def nodes(root: Node) -> Iterator[tuple[Node, list[int]]]:
    """Every node, parents first, with the paths from the root down to its parent (a list that changes as the walk goes on)."""
    line: list[int] = []
    todo = [(root, 0)]
    while todo:
        node, depth = todo.pop()
        del line[depth:]
        yield node, line
        line.append(node.path)
        todo += [(p, depth + 1) for p in node.parts if not isinstance(p, str)]


def _styles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page, once each: (host, path, ancestors, kind, what).  kind 0: child sequences, 1: texts, 2: the page itself.

    Ancestors are those 1, 2, 4, 8, ... levels above, as far as there are any.  Branches that are cut by what they are called count nowhere.
    """
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for host, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            root = parsed(html)
            above = {}
            rows = set()
            for node, line in nodes(root):
                if node.cut:
                    continue
                above[node.path] = [line[-(1 << k)] for k in range(len(line).bit_length())]
                children = [p.path for p in node.parts if not isinstance(p, str) and not p.cut]
                rows.add((node.path, 2, 0))
                rows.add((node.path, 0, _hash(repr([x for i, x in enumerate(children) if i == 0 or x != children[i - 1]]))))
            for node, text in blocks(root):
                if not node.cut:
                    rows.add((node.path, 1, _hash(text)))
            for path, kind, what in rows:
                for column, value in zip(out, (host, path, above[path], kind, what), strict=True):
                    column.append(value)
        yield pa.record_batch(
            [pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64()), strict=True)],
            ["host", "path", "above", "kind", "what"],
        )


def host_of(url: Column) -> Column:
    """Lower-case host without user, ``www`` and port; a null URL has the host ''."""
    authority = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    return F.regexp_replace(F.lower(F.regexp_replace(authority, "^.*@", "")), "^www[0-9]*\\.|:[0-9]*$", "")


def branch_importance(pages: DataFrame, pieces: DataFrame | None = None) -> DataFrame:
    """The hosts' style trees, from (host, html): ``host, path, pages, importance`` of every branch.

    ``pieces`` are the rows of ``_styles``; all counting is by (host, path, what), partial first.
    A branch has the sums of all levels below it.  Step k knows the sums of the next 2^k levels of
    every branch and adds those of its descendants 2^k levels down, so that a tree of n levels
    takes log2 n steps.
    """
    if pieces is None:
        pieces = pages.select("host", F.col("html").cast("string")).mapInArrow(
            _styles, "host string, path long, above array<long>, kind int, what long"
        )
    counted = pieces.groupBy("host", "path", "kind", "what").agg(F.count(F.lit(1)).alias("k"), F.first("above").alias("above"))
    counted = written(counted, "style-trees")
    merged = (
        counted.groupBy("host", "path")
        .agg(
            F.first("above").alias("above"),
            F.sum(F.when(F.col("kind") == 2, F.col("k"))).alias("m"),
            F.sum(F.when(F.col("kind") == 0, F.col("k"))).alias("styles"),
            F.sum(F.when(F.col("kind") == 0, F.col("k") * F.log("k"))).alias("klogk_style"),
            F.sum(F.when(F.col("kind") == 1, F.col("k"))).alias("texts"),
            F.sum(F.when(F.col("kind") == 1, F.col("k") * F.log("k"))).alias("klogk_text"),
        )
    )
    log_m = F.log("m")
    content = F.when(F.col("m") > 1, 1 - F.col("klogk_text") / F.col("texts") / log_m).otherwise(1.0)
    style = F.when(F.col("m") > 1, 1 - F.col("klogk_style") / F.col("styles") / log_m).otherwise(1.0)
    weight = F.coalesce("texts", F.lit(0)).cast("double")
    node = F.when(weight > 0, content).otherwise(style)
    w = F.greatest(weight, F.lit(0.05) * F.col("m"))
    own = written(merged.select("host", "path", "above", F.col("m").alias("pages"), (node * w).alias("node_w"), w.alias("w")), "branches")
    sums = own
    for k in range(own.agg(F.max(F.size("above"))).first()[0] or 0):
        faded = F.lit(DISCOUNT ** (1 << k))
        no = {"above": F.lit(None).cast("array<bigint>"), "pages": F.lit(None).cast("bigint")}
        up = sums.where(F.size("above") > k).select("host", F.get("above", F.lit(k)).alias("path"), (F.col("node_w") * faded).alias("node_w"), (F.col("w") * faded).alias("w"))
        sums = sums.unionByName(up.withColumns(no)).groupBy("host", "path").agg(
            F.first("above", True).alias("above"), F.max("pages").alias("pages"), F.sum("node_w").alias("node_w"), F.sum("w").alias("w")
        )
    return sums.select("host", "path", (F.col("node_w") / F.col("w")).alias("importance"), "pages")


def evidence(importance: Column, pages: Column) -> Column:
    """What a site's tree says for (positive) or against a branch of so many of its pages."""
    return (importance - UNDECIDED) * WEIGHT * (1 - 2 / (pages + 1))


def main_text(root: Node, against: dict[int, float]) -> str:
    """The blocks that stay, joined by newlines; ``against`` has the (negative) evidence for paths."""
    order = [node for node, _ in nodes(root)]
    has_text = {id(n) for n in order if any(isinstance(p, str) and p.strip() for p in n.parts)}
    named = [(n, text) for n, text in blocks(root) if not n.cut]
    share = marked_share(named)
    ramp = min(1.0, max(0.0, (share - SHARES[0]) / (SHARES[1] - SHARES[0])))

    def prior(n: Node) -> float:
        if n.name in ("#page", "html", "body"):
            return PRIORS["article"]
        if n.marked and (n.name in ARTICLE or n.name in FLOW):
            most = PRIORS["article" if n.name in ARTICLE else "flow of a marked article"]
            return PRIORS["any other"] + ramp * (most - PRIORS["any other"])
        return PRIORS["any other"]

    full: set[int] = set()
    noisy: set[int] = set()
    for n in reversed(order):  # children before parents
        below = [id(p) for p in n.parts if not isinstance(p, str)]
        if not n.cut and (id(n) in has_text or not full.isdisjoint(below)):
            full.add(id(n))
        if id(n) not in full or (prior(n) + against.get(n.path, 0.0) <= 0 and noisy.issuperset(below)):
            noisy.add(id(n))
    dropped: set[int] = set()
    for n in order:
        if id(n) in noisy or id(n) in dropped:
            dropped.add(id(n))
            dropped.update(id(p) for p in n.parts if not isinstance(p, str))
    if share > SHARES[1]:  # beside elements that hold most of the text nothing has enough evidence
        named = [(n, text) for n, text in named if n.marked]
    kept = [text for n, text in named if id(n) not in dropped]
    return "\n".join(kept or [text for _, text in named])


def marked_share(named: list[tuple[Node, str]]) -> float:
    """The share of a page's text, headings aside, that stands in elements marked as the article; 1 where there are only headings."""
    sizes = [(n.marked, len(text)) for n, text in named if n.name not in HEADINGS] or [(n.marked, len(text)) for n, text in named]
    return sum(size for marked, size in sizes if marked) / max(1, sum(size for _, size in sizes))


def different(pages: DataFrame) -> DataFrame:
    """Of a host's pages with the same html one, whatever their ids, as what a tree is made of.

    Only pages that are repeated are shuffled, each once a task.
    """
    rows = pages.select("host", "html", F.xxhash64("html").alias("h"))
    again = written(rows.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("host", "h"), "same-pages")
    again = F.broadcast(again) if again.count() <= BROADCAST_BRANCHES else again.hint("merge")
    once = rows.join(again, ["host", "h"], "left_anti").select("host", "html")
    return once.unionByName(rows.join(again, ["host", "h"], "left_semi").groupBy("host", "h").agg(F.min("html").alias("html")).select("host", "html"))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``, from the whole html.

    Null html is empty and has the text ''; a null URL belongs to the host ''.  Repeated rows
    are rows of the result each, and one page of the tree.  Other columns are ignored.  White space inside a block, ``br``
    included, is one space; blocks are joined by one newline.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        host_of(F.col("url")).alias("host"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    low = written(
        branch_importance(different(rows))
        .withColumn("says", evidence(F.col("importance"), F.col("pages")))
        .where(F.col("says") <= -PRIORS["any other"])  # no less than this ever decides
        .groupBy("host")
        .agg(F.collect_list("path").alias("paths"), F.collect_list("says").alias("says")),
        "unimportant",
    )
    size = low.agg(F.sum(F.size("paths"))).first()[0] or 0
    with_low = rows.join(F.broadcast(low) if size <= BROADCAST_BRANCHES else low.hint("merge"), "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for html, paths, says in zip(*batch.columns[2:], strict=True):  # one page at a time as Python objects
                texts.append(main_text(parsed(html.as_py()), dict(zip(paths.as_py() or (), says.as_py() or (), strict=True))))
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return with_low.select("page_id", "url", "html", "paths", "says").mapInArrow(run, "page_id long, url string, text string, n_chars long")
