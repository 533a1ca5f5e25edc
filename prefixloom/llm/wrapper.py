"""Main text of web pages by wrapper induction.

A page becomes a tree of its block elements; siblings of one label (tag, first class without
digits, and whether they may be content) are one node, so a list of any length is one slot. Some pages of each host are merged into a wrapper: each
is aligned with what is there by simple tree matching (the largest mapping of two trees that keeps labels,
parents and the order of children, by dynamic programming over the children of matched nodes), and what has
no partner is added. Then every page of the host is aligned with the wrapper, each text block is counted by
its slot, and a block that all pages of the host, or nearly all pages with that slot have in it is constant: it
is template, in an article as elsewhere. Equal pages count once, and near copies (with one longest block besides
those that all pages have) have one vote for a slot. What varies is content, unless its slot is a menu, footer, form and the like by its element, or is mostly links. Words of
adverts, comments and the like in class, id and role put a part in doubt, an article too, but not an article
below the part, nor a part with the page's top heading and most of its text; what is in doubt is content only
where a page has nothing else. An article or main part is a hint beside this: linked paragraphs in it stay,
unless their slot is a list of links on the host.

A page's text is its content blocks in page order: character references decoded, white space turned into
one blank, blocks joined by an empty line.

Scale: the wrapper of a host comes from WRAPPER_PAGES different pages, taken by hash with partial limits in the map
tasks, so a hot host costs no more. Alignment and extraction are one narrow pass over all pages; counts
are taken over all pages, copies counted once, by partial sums. Constant blocks are at most two to a slot.
Wrappers and constants are broadcast up to FEW_BYTES, else joined (and AQE splits a hot host). Trees are at most
DEPTH + 1 deep and handled without recursion, so deep pages are like others, and matching costs n log n.

Slots, texts and pairs of them are counted by 64-bit names. Null pages count as empty, null addresses as a host of their own. Hosts with fewer than LEAST_PAGES
different pages have no template, nor have those whose pages have nearly all
their text in common. Repeated rows stay. Old columns with the names of new ones are replaced; an empty table
gives an empty one.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BATCH_ROWS, slices, table, written

WRAPPER_PAGES = 8
LEAST_PAGES = 4
CONSTANT_SHARE = 0.9
NEAR_COPY = 0.9  # pages with more of their text in common are copies of each other, not pages of one template
MOST_LINKED = 0.6
FEW_BYTES = 16 << 20  # of wrappers or templates that are broadcast
MANY_COPIES = 32  # of a page, beyond which they are brought down to one first
KNOWN = 64  # wrappers a task keeps parsed
DEPTH = 40  # elements further down belong to the slot of their ancestor at this depth; their text counts alike

# tags by kind, as the HTML standard has them
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike "
             "strong sub sup time tt u var wbr br img label".split())
RAW = "script|style|textarea|title|xmp|iframe|noembed|noframes"
PARTS = set("article main".split())
# elements of what is not content, and words in class, id or role that put it in doubt
OUT = set("nav footer aside form script style head title noscript template iframe svg button select textarea menu dialog object canvas "
          "audio video math xmp noembed noframes option input".split())
WORDS = set("ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored sponsors cookie cookies consent gdpr notice notices "
            "alert popup modal overlay newsletter subscribe subscription sidebar menu nav navbar navigation breadcrumb breadcrumbs "
            "footer masthead topbar toolbar comment comments reply replies respond disqus share sharing social related recommended "
            "recommendations login signin signup search widget pagination pager skip skiplink contentinfo complementary dialog form tracking".split())
# a name that begins so says what its element has or is in, not what it is: with-sidebar, no-banner
ABOUT = set("with without no not non has have hide hides hidden show shows is are in on".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
               "header hgroup hr main menu nav ol p pre section table ul li dd dt".split())
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = set("ul ol dl table nav article section div body main aside footer header form".split())

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?P<rawattrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>", re.S | re.I)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HEADING = re.compile(r"h([1-6])\b")
SPLIT = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")


class Node:
    """Siblings of one label: a slot of the page."""

    __slots__ = ("label", "children", "parent", "depth", "slot", "out", "inside", "doubt", "named")

    def __init__(self, label: str, parent: Node | None, out: bool = False, inside: bool = False, doubt: bool = False, named: bool = False):
        self.label, self.parent, self.children = label, parent, {}
        self.depth = parent.depth + 1 if parent else 0
        self.slot, self.out, self.inside, self.doubt, self.named = "", out, inside, doubt, named

    def child(self, label: str, out: bool, inside: bool, doubt: bool, named: bool) -> Node:
        found = self.children.get(label)
        if found is None:
            found = self.children[label] = Node(label, self, out, inside, doubt, named)
        return found


def parse(page: str) -> tuple[Node, list[tuple[Node, str, int]]]:
    """The tree of a page, and its blocks in order: (node, text, characters in links)."""
    root = Node("", None)
    blocks: list[tuple[Node, str, int]] = []
    open_tags: list[tuple[str, Node]] = []
    n_open: Counter = Counter()
    here, text, linked, in_link = root, [], 0, False

    def flush() -> None:
        nonlocal linked
        if text:
            line = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if line:
                blocks.append((here, line, linked))
        linked = 0

    def pop_to(index: int) -> None:
        nonlocal here
        n_open.subtract(name for name, _ in open_tags[index:])
        del open_tags[index:]
        here = open_tags[-1][1] if open_tags else root

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at and not here.out:
            piece = page[at:m.start()]
            text.append(piece)
            if in_link:
                linked += len(piece.strip())
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "br":
                text.append(" ")
            elif tag == "a":
                in_link = not m["end"]
            continue
        flush()
        in_link = False
        if m["end"]:
            for i in range(len(open_tags) - 1, -1, -1) if n_open[tag] > 0 else ():
                if open_tags[i][0] == tag:
                    pop_to(i)
                    break
            continue
        if tag in CLOSES_P and open_tags and open_tags[-1][0] == "p":
            pop_to(len(open_tags) - 1)
        closing = SELF_CLOSING.get(tag)
        if closing:
            for i in range(len(open_tags) - 1, -1, -1):
                if open_tags[i][0] in closing:
                    pop_to(i)
                    break
                if open_tags[i][0] in SCOPES:
                    break
        if tag in VOID:
            continue
        node = here
        words, first_class = [], ""
        for name, a, b, c in ATTRIBUTE.findall(m["attrs"]) if m["attrs"] else ():
            value = a or b or c
            for one in value.split():
                parts = SPLIT.split(one if one.islower() else re.sub(r"(?<=[a-z])(?=[A-Z])", " ", one).lower())
                words += parts if parts[0] not in ABOUT else ()
            if name.lower() == "class" and not first_class:
                first_class = re.sub(r"\d+", "", value.split()[0]) if value.split() else ""
        part = tag in PARTS or "main" in words and "role" in m["attrs"].lower()
        named = tag not in ("html", "body") and not WORDS.isdisjoint(words)
        inside = (here.inside or part) and not named
        doubt = named or (here.doubt and not part)
        out = here.out or tag in OUT or (tag == "header" and not here.inside and not here.doubt)
        folded = here.depth >= DEPTH
        # what is put in doubt below DEPTH stays named, since its way up is not kept
        named = named or (folded and doubt and here.depth > DEPTH and here.named)
        if not folded or (out, inside, doubt, named) != (here.out, here.inside, here.doubt, here.named):
            label = ("" if folded else f"{tag}.{first_class}" if first_class else tag) + "!" * out + "*" * inside + "?" * (doubt + named)
            node = (here.parent if here.depth > DEPTH else here).child(label, out, inside, doubt, named)
        open_tags.append((tag, node))
        n_open[tag] += 1
        here = node
    if at < len(page) and not here.out:
        text.append(page[at:])
    flush()
    clear(blocks)
    return root, blocks


def clear(blocks: list[tuple[Node, str, int]]) -> None:
    """Takes the doubt from the part of a page that holds its top heading and most of its text."""
    heads = [(m[1], i) for i, (node, _, _) in enumerate(blocks) if (m := HEADING.match(node.label))]
    top = blocks[min(heads)[1]][0] if heads else None
    sizes: dict[int, int] = {}
    while top is not None and top.doubt:
        if top.named:
            sizes[id(top)] = 0
        top = top.parent
    if not sizes:
        return
    whole = 0
    for node, line, linked in blocks:
        whole += len(line) - linked
        while node is not None:
            if id(node) in sizes:
                sizes[id(node)] += len(line) - linked
            node = node.parent
    fine = {one for one, size in sizes.items() if 2 * size > whole}

    def doubted(node: Node) -> bool:
        while node.doubt:
            if node.named and id(node) not in fine:
                return True
            node = node.parent
        return False

    plain = [node for node in {id(b[0]): b[0] for b in blocks}.values() if node.doubt and not doubted(node)]
    for node in plain:
        node.doubt = False


def heaviest(weights: list[tuple[int, int]]) -> list[int]:
    """Indices of the increasing subsequence of (position, weight) of the largest weight; positions are distinct.

    A prefix-maximum tree over the positions, so long lists of children cost little.
    """
    rank = {p: i for i, p in enumerate(sorted(p for p, _ in weights), 1)}
    tree = [(0, -1)] * (len(weights) + 1)  # (weight of the best subsequence, its last index)
    before = []
    for i, (position, weight) in enumerate(weights):
        best, at = (0, -1), rank[position] - 1
        while at:
            best = max(best, tree[at], key=lambda x: x[0])
            at &= at - 1
        before.append(best[1])
        own, at = (best[0] + weight, i), rank[position]
        while at < len(tree):
            if own[0] > tree[at][0]:
                tree[at] = own
            at += at & -at
    best, at = (0, -1), len(weights)
    while at:
        best = max(best, tree[at], key=lambda x: x[0])
        at &= at - 1
    chosen, i = [], best[1]
    while i >= 0:
        chosen.append(i)
        i = before[i]
    return chosen[::-1]


def match(a: Node, b: Node) -> tuple[int, dict[int, Node]]:
    """Simple tree matching: the size of the largest mapping of two trees with equal roots, and b's partner of a's nodes by id.

    Labels of siblings differ, so a node can only have the child of its own label as partner, and the children's
    part is the heaviest sequence of common labels that has the same order on both sides. Works from the leaves up
    without recursion. A partner counts only if the partners of its ancestors do.
    """
    common, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        pairs = [(child, y.children[label]) for label, child in x.children.items() if label in y.children]
        common.append((x, y, pairs))
        todo += pairs
    size: dict[int, int] = {}
    partner = {id(a): b}
    for x, y, pairs in reversed(common):
        place = {label: i for i, label in enumerate(y.children)} if len(pairs) > 1 else {}
        weights = [(place.get(child.label, 0), size[id(child)]) for child, _ in pairs]
        kept = heaviest(weights) if len(pairs) > 1 else range(len(pairs))
        size[id(x)] = 1 + sum(weights[i][1] for i in kept)
        for i in kept:
            partner[id(pairs[i][0])] = pairs[i][1]
    return size[id(a)], partner


def align(page: Node, wrapper: Node) -> None:
    """Gives every node of the page the slot of its partner, or one of its own below its parent's."""
    partner = match(page, wrapper)[1]
    page.slot = wrapper.slot
    todo = [page]
    while todo:
        mine = todo.pop()
        for label, child in mine.children.items():
            if id(child) in partner:
                child.slot = partner[id(child)].slot
                todo.append(child)
            else:
                name_below(child, mine.slot + "/+" + label)


def name_below(node: Node, slot: str) -> None:
    todo = [(node, slot)]
    while todo:
        one, name = todo.pop()
        one.slot = name
        todo += [(child, f"{name}/{label}") for label, child in one.children.items()]


def merge(wrapper: Node, page: Node) -> None:
    """Adds to the wrapper what has no partner in it."""
    partner = match(page, wrapper)[1]
    todo = [(wrapper, page)]
    while todo:
        ours, theirs = todo.pop()
        for label, child in theirs.children.items():
            if id(child) in partner:
                todo.append((partner[id(child)], child))
            elif label not in ours.children:
                ours.children[label] = child


def dumped(root: Node) -> list:
    """The labels of a tree, each with its place in the list as parent's, parents first."""
    out, todo = [], [(root, -1)]
    while todo:
        node, parent = todo.pop()
        out.append([node.label, parent])
        todo += [(child, len(out) - 1) for child in reversed(node.children.values())]
    return out


def loaded(data: list) -> Node:
    nodes: list[Node] = []
    for label, at in data:
        parent = nodes[at] if at >= 0 else None
        node = Node(label, parent)
        node.slot = f"{parent.slot}/{label}" if parent else ""
        if parent:
            parent.children[label] = node
        nodes.append(node)
    return nodes[0]


def wrapper_of(pages: list[str]) -> str:
    """The merged tree of some pages, as text."""
    merged = Node("", None)
    for page in pages:
        merge(merged, parse(page)[0])
    return json.dumps(dumped(merged))


BLOCKS = "array<struct<slot:long,hash:long,size:int,text:string,inside:boolean,linked:boolean,doubt:boolean>>"


def hashed(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (row, html, wrapper) to (row, blocks): the blocks of a page that may be content."""
    known: dict[str, Node] = {}
    kind = pa.list_(pa.struct([("slot", pa.int64()), ("hash", pa.int64()), ("size", pa.int32()), ("text", pa.string()), ("inside", pa.bool_()), ("linked", pa.bool_()),
                                ("doubt", pa.bool_())]))
    for batch in batches:
        for part in slices(batch, "html"):
            rows = []
            for page, text in zip(part.column("html").to_pylist(), part.column("wrapper").to_pylist()):
                if text not in known:
                    if len(known) > KNOWN:
                        known.clear()
                    known[text] = loaded(json.loads(text))
                root, blocks = parse(page)
                align(root, known[text])
                row = []
                for node, line, linked in blocks:
                    listed = linked > MOST_LINKED * len(line)
                    row.append({"slot": hashed(node.slot), "hash": hashed(line), "size": 0 if listed or node.doubt else len(line), "text": line,
                                "inside": node.inside, "linked": listed, "doubt": node.doubt})
                rows.append(row)
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in part.schema.names if c not in ("html", "wrapper")], pa.array(rows, kind)],
                                             [*[c for c in part.schema.names if c not in ("html", "wrapper")], "blocks"])


def few(small: DataFrame, size: int | Column) -> DataFrame:
    """small with a broadcast hint if its rows (of ``size`` bytes beside the host's name) take at most FEW_BYTES; else the plain join stands."""
    cost = F.octet_length("host") + (F.lit(size) if isinstance(size, int) else size)
    return F.broadcast(small) if (small.agg(F.sum(cost.cast("long")).alias("n")).first()["n"] or 0) <= FEW_BYTES else small


def beside(rows: DataFrame, hosts: DataFrame, size: int | Column, how: str = "inner") -> DataFrame:
    return rows.join(few(hosts, size), "host", how)


def main_text(pages: DataFrame, html: str = "html", url: str = "url", out: str = "text") -> DataFrame:
    """pages with the main text of every page in a column ``out``."""
    spark = pages.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    own = [c for c in pages.columns if c != out and c != html]
    body = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit(""))
    host = F.coalesce(F.lower(F.regexp_extract(F.col(f"`{url}`"), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), host.alias("host"), body.alias("html"), F.xxhash64(body).alias("page"))

    # names of different pages first, so that copies of one page are one of them, then one page of each name: pages with
    # many copies are brought down to one before they go to their host's task, the others there
    first = Window.partitionBy("host").orderBy("page")
    names = rows.groupBy("host", "page").agg(F.count("*").alias("copies")).withColumn("n", F.row_number().over(first)).filter(F.col("n") <= WRAPPER_PAGES)
    names = written(names.select("host", "page", "copies"))
    bodies = rows.select("host", "page", "html")
    often = bodies.join(few(names.filter(F.col("copies") > MANY_COPIES).drop("copies"), 24), ["host", "page"]).groupBy("host", "page").agg(F.min("html").alias("html"))
    rarely = bodies.join(few(names.filter(F.col("copies") <= MANY_COPIES).drop("copies"), 24), ["host", "page"])
    # dealt by host, where the pages are compared as well
    one = F.row_number().over(Window.partitionBy("host", "page").orderBy("page"))
    some = rarely.unionByName(often).repartition("host").withColumn("copy", one).filter("copy = 1").drop("copy")
    wrappers = written(some.groupBy("host").applyInPandas(
        lambda part: pd.DataFrame({"host": [part["host"].iloc[0]], "wrapper": [wrapper_of(sorted(part["html"]))]}), "host string, wrapper string"))

    fields = rows.schema["row"].dataType.simpleString()
    aligned = beside(rows, wrappers, F.octet_length("wrapper")).select("row", "host", "page", "html", "wrapper").mapInArrow(
        blocks_of, f"row {fields}, host string, page long, blocks {BLOCKS}")
    aligned = written(aligned)

    # what all different pages of a host have is shared, unless it is nearly all of their text: then they are copies
    keys = F.arrays_zip(*[F.col(f"blocks.{c}").alias(c) for c in ("slot", "hash", "size", "linked")])  # without the texts
    seen = aligned.select("host", "page", F.explode(keys).alias("b")).groupBy("host", "page", "b.slot", "b.hash").agg(F.max("b.size").alias("size"))
    sizes = seen.groupBy("host").agg(F.countDistinct("page").alias("n")).filter(F.col("n") >= LEAST_PAGES)
    common = beside(seen.groupBy("host", "slot", "hash").agg(F.count("*").alias("c"), F.sum("size").alias("size")), sizes, 16)
    always = F.col("c") == F.col("n")
    shared = common.groupBy("host").agg(
        F.collect_set(F.when(always, F.struct("slot", "hash"))).alias("shared"), F.sum(F.when(always, F.col("size"))).alias("part"), F.sum("size").alias("whole"))
    shared = written(shared.filter(F.coalesce(F.col("part"), F.lit(0)) <= F.col("whole") * NEAR_COPY).select("host", "shared"))

    # near copies have one vote: that of the longest block of their own
    name = lambda b: F.xxhash64(b["slot"], b["hash"])
    among = lambda found, key: F.coalesce(F.array_contains(found, key), F.lit(False))
    # what a page has of its host's list, which may be long: a set operation, so no pairs
    own_part = lambda blocks, host_list: F.array_intersect(F.transform(blocks, name), host_list)
    longest = F.array_max(F.transform(
        F.filter("keys", lambda b: (b["size"] > 0) & ~among(F.col("own"), name(b))), lambda b: F.struct(b["size"].alias("size"), b["hash"].alias("hash"))))
    votes = beside(aligned.select("host", "page", keys.alias("keys")), shared, 16 * F.size("shared"), "left")
    votes = votes.withColumn("own", own_part("keys", F.transform("shared", name)))
    votes = written(votes.select("host", F.coalesce(longest["hash"], F.col("page")).alias("vote"), F.explode("keys").alias("b")).groupBy(
        "host", "vote", "b.slot", "b.hash").agg(F.bool_and("b.linked").alias("linked")))
    by_vote = votes.groupBy("host", "slot", "vote").agg(F.count_if("linked").alias("l"), F.count("*").alias("c"))
    slots = by_vote.groupBy("host", "slot").agg(F.count("*").alias("n"), F.sum("l").alias("l"), F.sum("c").alias("c"))
    slots = slots.filter(F.col("n") >= LEAST_PAGES)
    counts = votes.groupBy("host", "slot", "hash").agg(F.count("*").alias("c")).filter(F.col("c") >= LEAST_PAGES * CONSTANT_SHARE)
    counts = counts.join(slots.select("host", "slot", "n"), ["host", "slot"])
    constant = counts.filter(F.col("c") >= F.col("n") * CONSTANT_SHARE).select("host", "slot", "hash")
    lists = slots.filter(F.col("l") > F.col("c") * MOST_LINKED)
    found = constant.union(shared.select("host", F.explode("shared").alias("b")).select("host", "b.slot", "b.hash")).union(
        lists.select("host", "slot", F.lit(None).cast("long").alias("hash")))
    template = written(found.groupBy("host").agg(
        F.collect_set(F.when(F.col("hash").isNotNull(), F.xxhash64("slot", "hash"))).alias("template"), F.collect_set(F.when(F.col("hash").isNull(), F.col("slot"))).alias("lists")))

    marked = beside(aligned, template, 8 * (F.size("template") + F.size("lists")), "left")
    marked = marked.withColumn("own", own_part("blocks", F.col("template"))).withColumn("own_lists", F.array_intersect("blocks.slot", "lists"))
    listed = lambda b: b["linked"] & (~b["inside"] | among(F.col("own_lists"), b["slot"]))
    fits = F.filter("blocks", lambda b: ~among(F.col("own"), name(b)) & ~listed(b))
    sure = F.filter(fits, lambda b: ~b["doubt"])
    chosen = F.when(F.size(sure) > 0, sure).otherwise(fits)
    text = F.array_join(F.transform(chosen, lambda b: b["text"]), "\n\n")
    return marked.select(*[F.col(f"row.`{c}`") for c in own], text.alias(out))


def op5_wrapper(spark, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
