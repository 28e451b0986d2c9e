"""Main-text extraction from web pages by wrapper induction.

Per host, the block trees of a bounded set of seed pages are aligned one after
the other by simple tree matching; runs of equal siblings count as one node.
The merged tree names the host's nodes and nothing else: every page is aligned with
it, and a block that it does not know is named by its path below one that it does.

All pages of a host then vote.  For every node the distinct pages that have it,
the pages on which each text stands there, and the size of the texts are counted.
A text that stands at a node on ``CONSTANT_SHARE`` of its pages (``CONSTANT_PAGES`` or
more) is template, the rest of the node is a slot.  A page's text is what stands
in slots, without the blocks that are no article by their tag or role, or, outside
article and main elements, by the words of their class; where a page marks an
article or main element, only what it holds; elsewhere, only the part of the page
whose slots hold most of the text, by the sizes of its nodes over all pages that
have them.  So a rare layout is judged by the nodes of its own pages.

The words of a class are a guess: a block whose slots hold ``LARGE`` of the page's
text stays whatever its class, and where nothing of a page is left, it is read
again without the guesses, then without its marks.

The seeds are the ``SEEDS`` lowest hashes among a host's distinct pages.  Counts are
sent to the tasks for nodes on ``NODE_SHARE`` of a host's pages or more (and three); a
rarer node counts as a slot of its own page.  Texts, nodes and equal pages are told
apart by 64-bit hashes.  Alignment depends on a page's shape alone and is kept per shape.

Defined cases: null and empty html give the empty text; a page without a host
takes the template of all such pages; repeated rows get equal texts; broken
or cut markup is read as browsers would read it, as far as that concerns
blocks; an empty table gives no rows; other columns are not read, whatever their
names.
"""

from __future__ import annotations

import html as htmllib
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brokerlens.llm.common import Scratch, documents

SEEDS = 12
CONSTANT_PAGES = 3     # pages on which a text must be the same
CONSTANT_SHARE = 0.7   # of the pages that have the node
NODE_SHARE = 0.001     # of a host's pages: rarer nodes are not sent to the tasks
LEAST_SHARE = 0.7      # of a node's text that one child must hold to be descended into
LARGE = 0.5            # of a page's varying text: a slot that holds as much is no furniture
KEEP_SHAPES = 20_000   # alignments kept by a worker
DEEPEST = 150          # deeper blocks are read as siblings at that depth
WIDEST = 128           # more children than that are pooled by label for the alignment

# fixed values: html element names by their role here
RAW = "script|style|textarea"                                       # up to the end of the page without an end tag
WHOLE = {"svg", "noscript", "template", "iframe", "select", "canvas"}   # dropped with what they hold; without an end tag, the tag alone
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label",
          "maction", "mark", "math", "menclose", "merror", "mfrac", "mi", "mmultiscripts", "mn", "mo", "mover", "mpadded", "mphantom", "mroot",
          "mrow", "ms", "mspace", "msqrt", "mstyle", "msub", "msubsup", "msup", "mtable", "mtd", "mtext", "mtr", "munder", "munderover",
          "object", "q", "rp", "rt", "ruby", "s", "samp", "semantics", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
NO_ARTICLE = {"head", "title", "nav", "footer", "aside", "form", "button", "input", "menu", "dialog", "fieldset", "option", "header"}
NO_ARTICLE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
CLOSES_ITSELF = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"},
                 "option": {"select"}}
SUSPECT = re.compile(
    r"(?<![a-z])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu\w*|breadcrumbs?|masthead|header|footer|foot|"
    r"sidebar\w*|side|widgets?|related|recommend\w*|comments?|commentlist|respond|replies|reply|disqus\w*|cookies?|consent|gdpr|notices?|"
    r"alerts?|popup|modal|overlay|newsletter|subscribe|subscription|share|sharing|social|login|signup|signin|search\w*|form|"
    r"copyright|legal|disclaimer|pagination|pager|toolbar|skip|hidden|rail|teasers?|outbrain|taboola)(?![a-z])")
# class tokens that say what a block has or is about, not what it is
MODIFIER = re.compile(r"(?:has|have|no|not|non|with|without|is|are|category|cat|tag|topic|term|format|type|supports?)-")

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attr>(?:[^\"'>]|\"[^\"]*\"|'[^']*')*)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)[^>]*>|<[!?/][^>]*>|<[a-zA-Z!/?][^>]*\Z", re.S | re.I)
ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?|\"[^\"]*\"|'[^']*'")
WHOLE_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
                       rf"|<(?P<end>/?)(?P<tag>{'|'.join(sorted(WHOLE))})(?=[\s/>])(?:[^\"'>]|\"[^\"]*\"|'[^']*')*>", re.S | re.I)
DIGITS = re.compile(r"\d+")


class Node:
    """A block of a page: its label, its children and runs of text in order, and what is known of it:
    ``suspect`` by tag, role or style, ``guess`` by its class alone, ``inside`` an article or main element."""
    __slots__ = ("label", "tag", "items", "links", "suspect", "main", "guess", "inside")

    def __init__(self, tag, label="", suspect=False, main=False, guess=False, inside=False):
        self.tag, self.label, self.items, self.links = tag, label or tag, [], 0
        self.suspect, self.main, self.guess, self.inside = suspect, main, guess, inside

    def blocks(self):
        return [x for x in self.items if type(x) is Node]

    def own_text(self):
        return clean("".join(x for x in self.items if type(x) is str))


def clean(text: str) -> str:
    if "&" in text:
        text = htmllib.unescape(text)
    return " ".join(text.split())


def _guess(tag: str, tokens: list[str], main: bool, inside: bool) -> bool:
    """Whether a block's class names page furniture.  An article must be called so by a whole token,
    as a comment is; nothing else inside an article or main element, and no other mark, is judged by words."""
    if tag in ("html", "body"):
        return False
    if tag == "article":
        return any(SUSPECT.fullmatch(t) for t in tokens)
    return not main and not inside and any(SUSPECT.search(t) and not MODIFIER.match(t) for t in tokens)


def _node(tag: str, attrs: str, inside: bool = False) -> Node:
    label, suspect, main, guess = tag, tag in NO_ARTICLE, tag in ("article", "main"), False
    if attrs and not attrs.isspace():
        marks, tokens, seen = [], [], set()
        for m in ATTR.finditer(attrs):
            if not m[1] or (name := m[1].lower()) in seen:
                continue
            seen.add(name)
            value = (m[2] or "").strip("\"'").lower()
            if name == "hidden" or name == "style" and "display:none" in value.replace(" ", ""):
                suspect = True
            elif name == "role":
                suspect = suspect or value in NO_ARTICLE_ROLES
                main = main or value == "main"
            elif name == "itemprop":
                main = main or value == "articlebody"
            elif name in ("class", "id"):
                marks.append(DIGITS.sub("#", value))
                if name == "class":
                    tokens = value.replace("_", "-").split()
        names = " ".join(marks)
        if names:
            label = f"{tag}.{names}"
        guess = _guess(tag, tokens, main, inside)
    return Node(tag, label, suspect, main, guess, inside)


def _whole_ends(page: str) -> dict[int, int]:
    """Start of each complete ``WHOLE`` element to its end."""
    ends, is_open = {}, {}
    for m in WHOLE_TAG.finditer(page):
        if not m["tag"]:
            continue
        starts = is_open.setdefault(m["tag"].lower(), [])
        if not m["end"]:
            if not (m["tag"].lower() == "svg" and m[0].endswith("/>")):
                starts.append(m.start())
        elif starts:
            ends[starts.pop()] = m.end()
    return ends


def parse(page: str) -> Node:
    """The tree of a page's blocks; inline elements are part of their block's text."""
    root = Node("#page")
    stack = [root]
    link, at = 0, 0
    ends = None

    def text(s):
        if s:
            top = stack[-1]
            top.items.append(s)
            if link:
                top.links += len(s)

    for m in TOKEN.finditer(page):
        if m.start() < at:       # inside a dropped element
            continue
        text(page[at:m.start()])
        at = m.end()
        tag, end = m["tag"] or m["tag2"], m["end"] or m["end2"]
        if not tag:
            continue
        tag = tag.lower()
        if tag in WHOLE:
            if not end:
                ends = _whole_ends(page) if ends is None else ends
                at = ends.get(m.start(), at)
            continue
        if tag in INLINE:
            if tag == "a":
                link = 0 if end else 1
            continue
        if end:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    link = 0
                    break
            continue
        while stack[-1].tag in ("option", "optgroup") and tag not in ("option", "optgroup"):
            stack.pop()          # of a select without its end
        if tag in VOID:
            text(" ")
            continue
        if tag in CLOSES_ITSELF:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in CLOSES_ITSELF[tag] or stack[i].tag in ("article", "main", "section", "div"):
                    break
                if stack[i].tag == tag or tag in ("dt", "dd") and stack[i].tag in ("dt", "dd") or tag in ("td", "th") and stack[i].tag in ("td", "th"):
                    del stack[i:]
                    break
        elif stack[-1].tag == "p" or any(x.tag == "p" for x in stack[-3:]):
            # a block ends an open paragraph
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag not in ("h1", "h2", "h3", "h4", "h5", "h6", "pre"):
                    break
        if tag == "body" and len(stack) > 1:
            while len(stack) > 1 and stack[-1].tag != "html":
                stack.pop()
        above = stack[min(len(stack), DEEPEST) - 1]
        node = _node(tag, m["attr"] or "", above.inside or above.main)
        above.items.append(node)
        stack.append(node)
        link = 0
    text(page[at:])
    return root


class Shape:
    """A node of the aligned trees: a run of equal siblings counts once."""
    __slots__ = ("label", "kids", "key", "nodes")

    def __init__(self, label, kids, nodes):
        self.label, self.kids, self.nodes = label, kids, nodes
        self.key = f"{label}({','.join(k.key for k in kids)})" if kids else label


def shape(nodes: list[Node]) -> Shape:
    """Shape of a run of equal siblings; their children are pooled, in order, runs merged."""
    kids, run = [], []
    for node in nodes:
        for b in node.blocks():
            if run and run[-1].label != b.label:
                kids.append(shape(run))
                run = []
            run.append(b)
    if run:
        kids.append(shape(run))
    if len(kids) > WIDEST:
        pooled: dict = {}
        for k in kids:
            pooled.setdefault(k.label, []).extend(k.nodes)
        kids = [shape(run) for run in pooled.values()]
    return Shape(nodes[0].label, kids, nodes)


def match(a, b, memo):
    """Simple tree matching: the size of the largest order-preserving match of two trees with equal roots."""
    if a.label != b.label:
        return 0
    key = (id(a), id(b))
    if key not in memo:
        row = [0] * (len(b.kids) + 1)
        table = [row]
        for x in a.kids:
            new = [0]
            for j, y in enumerate(b.kids):
                new.append(max(new[j], row[j + 1], row[j] + match(x, y, memo)))
            table.append(new)
            row = new
        memo[key] = (1 + row[-1], table)
    return memo[key][0]


def pairs(a, b, memo, out):
    """Matched (node of a, node of b) of two trees with equal roots, roots included."""
    out.append((a, b))
    if not a.kids or not b.kids:
        return
    match(a, b, memo)
    table, i, j = memo[id(a), id(b)][1], len(a.kids), len(b.kids)
    while i and j:
        w = match(a.kids[i - 1], b.kids[j - 1], memo)
        if w and table[i][j] == table[i - 1][j - 1] + w:
            pairs(a.kids[i - 1], b.kids[j - 1], memo, out)
            i, j = i - 1, j - 1
        elif table[i][j] == table[i - 1][j]:
            i -= 1
        else:
            j -= 1


class Slot:
    """A template node: how many seed pages have it, the texts that stand there on all of them, and
    how much other text it holds on them."""
    __slots__ = ("label", "kids", "pages", "texts", "size")

    def __init__(self, label, pages=0, texts=(), size=0, kids=None):
        self.label, self.pages, self.texts, self.size, self.kids = label, pages, set(texts), size, kids or []

    def dump(self):
        return [self.label, self.pages, sorted(self.constant), self.size - self.pages * sum(map(len, self.constant)),
                [k.dump() for k in self.kids]]

    @classmethod
    def load(cls, x):
        return cls(x[0], x[1], x[2], x[3], [cls.load(k) for k in x[4]])

    @property
    def constant(self):
        return self.texts if self.pages >= CONSTANT_PAGES else set()


def _learn(slot: Slot, s: Shape, dropped: bool) -> None:
    texts = {t for n in s.nodes if (t := n.own_text())}
    slot.texts = slot.texts & texts if slot.pages else texts
    slot.pages += 1
    if not dropped:
        slot.size += sum(map(len, texts))


def _grow(slot: Slot, s: Shape, memo, dropped: bool = False) -> None:
    """Align a page's shape with the template below ``slot``; add what the template does not have.
    Text in blocks that are no article by tag, role or style (``dropped``) has no weight."""
    dropped = dropped or any(n.suspect for n in s.nodes)
    _learn(slot, s, dropped)
    matched = {}
    out = []
    pairs(slot, s, memo, out)
    for x, y in out:
        matched[id(y)] = x
    here = {id(k) for k in slot.kids}
    at = 0
    for k in s.kids:
        own = matched.get(id(k))
        if own is not None and id(own) in here:
            at = slot.kids.index(own) + 1
            _grow(own, k, memo, dropped)
        else:
            new = Slot(k.label)
            slot.kids.insert(at, new)
            at += 1
            _grow(new, k, memo, dropped)


def induce(pages: list[str]) -> Slot:
    """Template of a host's seed pages."""
    root = Slot("#page")
    for page in pages:
        _grow(root, shape([parse(page)]), {})
    return root


def _hash(text: str) -> int:
    import xxhash
    h = xxhash.xxh64_intdigest(text)
    return h - (1 << 64) if h >> 63 else h


class Wrapper:
    """A host's template, ready to name the nodes of its pages and to extract them.

    ``votes``: per node (mean size of its slot, hashes of its constant texts), counted over all pages;
    without it, that of the pages the template was induced from."""

    def __init__(self, template: Slot, votes: dict | None = None):
        self.template, self.shapes, self.ids = template, {}, {}
        todo = [template]
        while todo:
            x = todo.pop()
            self.ids[id(x)] = _hash(f"template {len(self.ids)}")
            todo += reversed(x.kids)
        self.votes = self._own_votes() if votes is None else votes

    def _own_votes(self) -> dict:
        out, todo = {}, [self.template]
        while todo:
            x = todo.pop()
            size = max(0, x.size - x.pages * sum(map(len, x.constant)))
            out[self.ids[id(x)]] = (size / max(1, x.pages), {_hash(t) for t in x.constant})
            todo += x.kids
        return out

    def align(self, s: Shape) -> dict[int, Slot]:
        """Template node of each node of a shape, by preorder number."""
        got = self.shapes.get(s.key)
        if got is None:
            if len(self.shapes) >= KEEP_SHAPES:
                self.shapes.clear()
            order, todo = {}, [s]
            while todo:
                x = todo.pop()
                order[id(x)] = len(order)
                todo += reversed(x.kids)
            out = []
            pairs(self.template, s, {}, out)
            got = self.shapes[s.key] = {order[id(y)]: x for x, y in out}
        return got

    def named(self, s: Shape) -> list[tuple]:
        """(node of the shape, its name, number of the node above, dropped) in preorder; a block is dropped if it or one
        above it is no article by tag, role or style."""
        aligned = self.align(s)
        out, todo = [], [(s, -1)]
        while todo:
            x, above = todo.pop()
            slot = aligned.get(len(out))
            name = self.ids[id(slot)] if slot is not None else _hash(f"{out[above][1] if above >= 0 else 0}/{x.label}")
            dropped = above >= 0 and out[above][3] or any(n.suspect for n in x.nodes)
            todo += [(k, len(out)) for k in reversed(x.kids)]
            out.append((x, name, above, dropped))
        return out

    def seen(self, page: str) -> dict:
        """What a page tells of its nodes: {name: {text hash: its size}}; text in dropped blocks, but headers, is not asked."""
        out: dict = {}
        for x, name, _, dropped in self.named(shape([parse(page)])):
            if not dropped or x.label == "header":
                texts = out.setdefault(name, {})
                for n in x.nodes:
                    if t := n.own_text():
                        texts[_hash(t)] = 0 if dropped else len(t)
        return out

    def text(self, page: str) -> str:
        """The page's main text; a page of which nothing is left is read without guesses, then without marks."""
        root = parse(page)
        named = self.named(shape([root]))
        number, weight, none = {}, [], (0.0, frozenset())
        for i, (x, name, _, dropped) in enumerate(named):
            own = []
            for node in x.nodes:
                number[id(node)] = i
                if name not in self.votes:
                    own.append(node.own_text())
            weight.append(0.0 if dropped else self.votes[name][0] if name in self.votes else float(sum(map(len, set(own)))))
        constant = [self.votes.get(name, none)[1] for _, name, _, _ in named]
        size, kids = [1] * len(named), [[] for _ in named]
        for i in range(len(named) - 1, 0, -1):
            above = named[i][2]
            weight[above] += weight[i]
            size[above] += size[i]
            kids[above].append(i)
        at = 0
        while kids[at]:
            best = max(reversed(kids[at]), key=weight.__getitem__)
            if weight[best] < LEAST_SHARE * max(1, weight[at]) or named[best][0].label.split(".")[0] in ("p", "h1", "h2", "li", "td"):
                break
            at = best
        main = range(at, at + size[at])
        large = {i for i, w in enumerate(weight) if weight[0] and w >= LARGE * weight[0]}
        slots = (number, constant, main)
        out: list[str] = []
        for guesses in (True, False):
            def dropped(node):
                return node.suspect or guesses and node.guess and number[id(node)] not in large

            marked = _mains(root, dropped)
            for top in marked or [root]:
                self._gather(top, slots, bool(marked), dropped, out)
            if out:
                break
        if marked and not out:
            self._gather(root, slots, False, dropped, out)
        return " ".join(out)

    def _gather(self, top: Node, slots, marked: bool, dropped, out: list[str]) -> None:
        stack = [(top, iter(top.items), [])]
        while stack:
            node, items, run = stack[-1]
            for x in items:
                if type(x) is str:
                    run.append(x)
                    continue
                self._flush(node, run, slots, marked, out)
                # a header inside an article holds its headline
                if not dropped(x) or marked and x.label == "header":
                    stack.append((x, iter(x.items), []))
                    break
            else:
                self._flush(node, run, slots, marked, out)
                stack.pop()

    def _flush(self, node: Node, run, slots, marked: bool, out: list[str]) -> None:
        t = clean("".join(run))
        run.clear()
        if not t:
            return
        number, constants, main = slots
        i = number[id(node)]
        if constants[i] and (_hash(t) in constants[i] or _hash(node.own_text()) in constants[i]):
            return
        if not marked:
            if i not in main or node.links > 0.6 * sum(len(x) for x in node.items if type(x) is str):
                return
        out.append(t)


def _mains(node: Node, dropped) -> list[Node]:
    """Outermost article or main elements outside dropped blocks; of a main element its articles, if it has any."""
    out, todo = [], list(reversed(node.blocks()))
    while todo:
        x = todo.pop()
        if dropped(x):
            continue
        if x.main:
            inner = [y for y in _mains(x, dropped) if y.tag == "article"] if x.tag == "main" else []
            out += inner or [x]
        else:
            todo += reversed(x.blocks())
    return out


def host(url: Column) -> Column:
    """Host name of a URL in lower case, empty without one."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)), F.lit(""))


def templates(pages: DataFrame, scratch: Scratch, seeds: int = SEEDS) -> DataFrame:
    """(host, template): the tree of each host as JSON, from its seed pages."""
    known = pages.where(F.length("html") > 0).select(host(F.col("url")).alias("host"), F.xxhash64("html").alias("mark"), "page_id", "html")
    distinct = known.groupBy("host", "mark").agg(F.min("page_id").alias("page_id"))
    nth = F.row_number().over(Window.partitionBy("host").orderBy("mark"))
    # written, so that its size is known before the pages' html is moved for it
    chosen = scratch.table(distinct.withColumn("nth", nth).where(F.col("nth") <= seeds).drop("nth"))
    k, c = known.alias("k"), chosen.alias("c")
    on = (F.col("k.host") == F.col("c.host")) & (F.col("k.mark") == F.col("c.mark")) & F.col("k.page_id").eqNullSafe(F.col("c.page_id"))
    seed = k.join(c, on, "left_semi").select("host", "mark", "html").dropDuplicates(["host", "mark"])      # repeated rows count once

    def learn(key, table):
        import json
        import pyarrow as pa
        distinct = dict(zip(table.column("mark").to_pylist(), table.column("html").to_pylist()))
        template = induce([distinct[m] for m in sorted(distinct)])
        return pa.table({"host": pa.array([key[0].as_py()], pa.string()), "template": pa.array([json.dumps(template.dump())], pa.string())})

    return seed.groupBy("host").applyInArrow(learn, "host string, template string")


class _Wrappers(dict):
    """Wrappers by their text form (template, votes), few at a time."""

    def __missing__(self, key):
        import json
        if len(self) > 100:
            self.clear()
        template, votes = key
        tree = Slot.load(json.loads(template)) if template else Slot("#page")
        self[key] = w = Wrapper(tree, {n: (m, set(c)) for n, m, c in json.loads(votes)} if votes else {})
        return w


def votes(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, votes): what all pages of a host say of their nodes, as JSON [[node, mean size, [constant texts]]].

    ``rows``: (host, html, template).  Each distinct page counts once."""
    def observe(batches):
        import pyarrow as pa
        wrappers = _Wrappers()
        for batch in batches:
            out: list = [[], [], [], [], []]
            for host, mark, page, template in zip(*(batch.column(c).to_pylist() for c in range(4))):
                for node, texts in wrappers[template, None].seen(page).items():
                    for t, size in {0: 0, **texts}.items():
                        for held, v in zip(out, (host, node, mark, t, size)):
                            held.append(v)
            yield pa.RecordBatch.from_arrays([*[pa.array(v, pa.int64()) for v in out[:4]], pa.array(out[4], pa.int32())],
                                             names=["host", "node", "mark", "text", "size"])

    known = rows.where(F.length("html") > 0).select(F.xxhash64("host").alias("host"), F.xxhash64("html").alias("mark"), "html", "template")
    seen = known.mapInArrow(observe, "host long, node long, mark long, text long, size int")
    # text 0 stands for the node itself
    texts = scratch.table(seen.groupBy("host", "node", "text").agg(F.countDistinct("mark").alias("n"), F.max("size").alias("size")))
    nodes = texts.groupBy("host", "node").agg(F.max(F.when(F.col("text") == 0, F.col("n"))).alias("pages"), F.sum(F.col("n") * F.col("size")).alias("total"))
    nodes = scratch.table(nodes.where(F.col("pages") >= CONSTANT_PAGES))
    common = texts.where((F.col("text") != 0) & (F.col("n") >= CONSTANT_PAGES)).join(nodes.select("host", "node", "pages"), ["host", "node"])
    fixed = common.where(F.col("n") >= F.lit(CONSTANT_SHARE) * F.col("pages")).groupBy("host", "node").agg(
        F.sum(F.col("n") * F.col("size")).alias("fixed"), F.collect_list("text").alias("constant"))       # at most a page's texts over CONSTANT_SHARE
    most = nodes.groupBy("host").agg(F.max("pages").alias("of_host"))
    kept = nodes.join(most, "host").where(F.col("pages") >= F.lit(NODE_SHARE) * F.col("of_host")).join(fixed, ["host", "node"], "left")
    mean = (F.col("total") - F.coalesce("fixed", F.lit(0))) / F.col("pages")
    # per host at most 1 / NODE_SHARE times the nodes of a page
    entry = F.concat(F.lit("["), F.concat_ws(",", F.col("node").cast("string"), F.round(mean, 3).cast("string"),
                                             F.concat(F.lit("["), F.concat_ws(",", F.coalesce("constant", F.array()).cast("array<string>")), F.lit("]"))), F.lit("]"))
    return kept.groupBy("host").agg(F.concat(F.lit("["), F.concat_ws(",", F.sort_array(F.collect_list(entry))), F.lit("]")).alias("votes"))


def extract_text(pages: DataFrame, seeds: int = SEEDS) -> DataFrame:
    """(page_id, url, text) per page row: the main text of the whole html."""
    scratch = Scratch(pages.sparkSession, "wrappers")
    kind = dict(pages.dtypes)["page_id"]
    known = scratch.table(templates(pages, scratch, seeds))
    named = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    counted = scratch.table(votes(named.join(known, "host", "left"), scratch))
    hosts = scratch.table(known.withColumn("mark", F.xxhash64("host")).join(counted.withColumnRenamed("host", "mark"), "mark", "left").drop("mark"))

    def run(batches):
        import pyarrow as pa
        wrappers = _Wrappers()
        for batch in batches:
            texts = [wrappers[template, counts].text(page) if page else ""
                     for page, template, counts in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    rows = named.join(hosts, "host", "left")
    return rows.select("page_id", "url", "html", "template", "votes").mapInArrow(run, f"page_id {kind}, url string, text string")


def q_op6(spark, sf_dir: str) -> DataFrame:
    """op6: the main text of all pages."""
    got = extract_text(documents(spark, sf_dir, "pages"))
    return got.withColumn("n_chars", F.length("text").cast("long"))
