"""Main text of web pages by wrapper induction over the pages of a host.

A page is read into a tree.  Siblings with one tag and class are one node, an
iterator, so trees are as wide as their markup is various.  Trees of a host are
aligned by simple tree matching and folded into a wrapper: for each node how many
pages have it, and how many of them with which text.  A text is template where at least
``TEMPLATE_SHARE`` of a node's pages have it, with ``LEAST_VARIETY`` different main texts;
what varies is a slot.  Copies of a page teach a task once, so a block that only the
copies of one article have is no template.
The text of a page is that of its main slots without template nodes and without parts
whose tag, role or class names them menu, header, footer, sidebar, notice, advert,
form, script, style or reader comments.

Wrappers fold in any order, so each task folds its pages of a host first, and parts of
a host are folded in groups before they meet: no task sees all pages of a host.

Contract of edge cases: a null or empty html gives an empty text; a page without a
host in its url is read without a wrapper; a host teaches nothing until its pages have
``LEAST_VARIETY`` different main texts; repeated rows have their own results; markup
that is not closed or not opened is read as browsers do in the common cases; elements
nested deeper than ``DEEPEST`` lie side by side, their texts in order; texts are taken
whole; other columns pass unchanged, a column named like the output is replaced.
"""

from __future__ import annotations

import html as html_text
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stages import materialise

#: Different main texts that a host must have before what its pages share is template.
LEAST_VARIETY = 4
#: Share of a node's pages that must have a text for it to be template.
TEMPLATE_SHARE = 0.9
#: Texts that fewer than half of so many pages have are no candidates any more.
PRUNE_FROM = 8
#: Levels of elements that are kept apart.
DEEPEST = 150
#: Quoted values and other pieces of one tag, after which the tag ends at its first ``>``.
TAG_PIECES = 2000
#: Groups in which parts of one host's wrapper are folded first.
FOLD_GROUPS = 64

# How HTML classes its elements, and what parts of pages are called.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead "
    "tr ul".split()
)
PARTS = frozenset(
    "aside button canvas dialog footer form head header iframe input label menu nav noframes noscript object option script "
    "select style svg template textarea title".split()
)
CLASSES = frozenset(
    "ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies dialog disqus footer form header login masthead menu modal nav navbar navigation newsletter notice notices "
    "popup promo promotion related respond search share sharing sidebar social sponsor sponsored subscribe toolbar".split()
)
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
MAIN_NAMES = frozenset("article articlebody content entry main post story".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_TAG_MARK = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")
_NAME = re.compile(r"[a-z]+")
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


class Node:
    __slots__ = ("tag", "mark", "names", "whole", "hidden", "holds", "kids", "print")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.kids, self.names, self.hidden = tag, [], frozenset(), False
        self.mark, self.print, self.whole, self.holds = tag, 0, frozenset(), False
        if attributes and not attributes.isspace():
            found = {}
            for name, value in _ATTRIBUTE.findall(attributes):
                found.setdefault(name.lower(), value.strip("\"'").lower())
            kind = found.get("class", "")
            self.mark = f"{tag}.{' '.join(sorted(kind.split()))}" if kind else tag
            words = f"{kind} {found.get('id', '')}".replace("_", "-").split()
            parts = {w for word in words for w in (word, *word.split("-"))}
            role = found.get("role", "")
            self.whole = frozenset(words)
            self.names = frozenset(parts | ({role} if role else set()))
            style = found.get("style", "").replace(" ", "")
            self.hidden = (
                "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in style or role in ROLES
            )


def _tag_end(page: str, at: int) -> int:
    """Where the tag whose name ends at ``at`` has its ``>``, -1 for nowhere; a quote without its pair is a plain sign."""
    begin = at
    for _ in range(TAG_PIECES):
        m = _TAG_MARK.search(page, at)
        if m is None:
            break
        if m[0] == ">":
            return m.start()
        closed = page.find(m[0], m.end())
        at = m.end() if closed < 0 else closed + 1
    return page.find(">", begin)


def _tokens(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """Start and end of every comment and tag, with ``/`` for an end tag, its name and its attributes."""
    at, last = 0, page.rfind(">")
    while 0 <= (at := page.find("<", at)) <= last:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield at, end, "", "", ""
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at) + 1
            yield at, end, "", "", ""
        else:
            m = _TAG.match(page, at)
            stop = _tag_end(page, m.end()) if m else -1
            if stop < 0:
                at += 1
                continue
            end = stop + 1
            jumped = yield at, end, m[1], m[2].lower(), page[m.end() : stop]
            end = jumped or end
        at = end


def read_page(page: str) -> Node:
    """The element tree; texts are kept as they are written."""
    root = Node("#page")
    stack = [root]
    # Of each element below the deepest level: its block, and whether it or one around it there is no text.
    around: list[tuple[Node, bool]] = []
    at, block = 0, None
    tokens = _tokens(page)
    token = next(tokens, None)
    while True:
        text = page[at : token[0]] if token else page[at:]
        if text:
            if len(stack) <= DEEPEST:
                stack[-1].kids.append(text)
            else:
                # Texts of deeper elements lie side by side, apart where their blocks differ.
                own, hidden = around[-1]
                if own is not block:
                    stack[DEEPEST - 1].kids.append(Node("br"))
                block = own
                piece = Node("span")
                piece.hidden = hidden
                piece.kids.append(text)
                stack[DEEPEST - 1].kids.append(piece)
        if not token:
            mark_holders(root)
            return root
        _, at, ending, tag, attributes = token
        jump = None
        if tag and ending:
            _close(stack, tag)
            if around:
                del around[max(len(stack) - DEEPEST, 0) :]
        elif tag:
            if tag == "p" or tag in BLOCKS:
                _close_before(stack, tag)
                if around:
                    del around[max(len(stack) - DEEPEST, 0) :]
            node = Node(tag, attributes)
            if len(stack) < DEEPEST:
                stack[-1].kids.append(node)
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                node.kids.append(page[at : end.start() if end else len(page)])
                at = jump = end.end() if end else len(page)
            elif tag not in VOID and not attributes.endswith("/"):
                if len(stack) >= DEEPEST:
                    own, hidden = around[-1] if around else (next((n for n in reversed(stack) if n.tag in BLOCKS), root), False)
                    around.append((node if tag in BLOCKS else own, hidden or node.hidden or is_part(node, True)))
                stack.append(node)
        token = _advance(tokens, jump)


def _advance(tokens, jump: int | None) -> tuple | None:
    try:
        return next(tokens) if jump is None else tokens.send(jump)
    except StopIteration:
        return None


def _close(stack: list[Node], tag: str) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == tag:
            del stack[i:]
            return
        if tag not in BLOCKS and stack[i].tag in BLOCKS and stack[i].tag != "p":
            return  # an inline end tag does not close the block around it


def _close_before(stack: list[Node], tag: str) -> None:
    """A block's start ends an open paragraph, an item's start the item before."""
    ended = {"p": ("p",), "li": ("p", "li"), "dt": ("p", "dt", "dd"), "dd": ("p", "dt", "dd"), "tr": ("p", "tr", "td", "th")}
    limit = {"li": ("ul", "ol", "menu"), "tr": ("table", "tbody", "thead", "tfoot")}.get(tag, ())
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in ended.get(tag, ("p",)):
            del stack[i:]
            if tag in ("p", "li"):
                return
        elif stack[i].tag in limit or (stack[i].tag in BLOCKS and tag not in ("tr", "li", "dt", "dd")):
            return
        elif stack[i].tag in ("table", "article", "section", "div", "ul", "ol", "dl", "body"):
            return


def is_part(node: Node, inside_main: bool) -> bool:
    """Whether an element is none of the article's own text."""
    if node.holds:
        return False
    if node.hidden or (node.tag in PARTS and not (node.tag == "header" and inside_main)):
        return True
    own = node.names & CLASSES
    return bool(own) and node.tag not in ("html", "body") and not (inside_main and own == {"header"})


def mark_holders(root: Node) -> None:
    """Set ``holds`` on elements that are named like a part but are around the article.

    Such an element has more than half of the page's paragraph text (of all text, if there
    are no paragraphs), and the article or main element with most of it is in there or
    around it.  Without such an element in there, only forms and classes that name a part
    within a longer name count.
    """
    weight: dict[int, int] = {}
    named: list[tuple[Node, tuple[Node, ...]]] = []
    mains: list[tuple[Node, tuple[Node, ...]]] = []

    def weigh(node: Node, above: tuple[Node, ...], paragraph: bool) -> int:
        total = 0
        for kid in node.kids:
            if isinstance(kid, str):
                total += len(kid.strip()) if paragraph else 0
            elif not kid.hidden and (kid.tag not in PARTS or kid.tag in ("form", "header")):
                total += weigh(kid, (*above, node), paragraph or kid.tag == "p")
        weight[id(node)] = total
        if node.tag in ("article", "main") and not is_part(node, False):
            mains.append((node, above))
        elif node.tag == "form" or (node.names & CLASSES and node.tag not in PARTS):
            named.append((node, above))
        return total

    whole = weigh(root, (), False)
    if named and not whole:  # a page without paragraphs is measured by all its text
        named.clear()
        mains.clear()
        whole = weigh(root, (), True)
    if not named or not whole:
        return
    best, around = max(mains, key=lambda m: weight[id(m[0])], default=(None, ()))
    for node, above in named:
        if 2 * weight[id(node)] <= whole:
            continue
        inside = any(node is x for x in around)
        loose = node.tag == "form" or not node.whole & CLASSES
        node.holds = inside or (loose and (best is None or any(best is x for x in above)))


def fingerprint(node: Node) -> int:
    """A hash of an element's visible text."""
    pieces = []
    for kid in node.kids:
        pieces.append(" ".join(kid.split()) if isinstance(kid, str) else str(fingerprint(kid)))
    node.print = xxhash.xxh64_intdigest("\x00".join(x for x in pieces if x)) >> 1
    return node.print


# A wrapper node is [mark, pages, {text: [pages, some main texts]}, children]; keys of a JSON object are strings.


def shape(nodes: list[Node], kind: int = 0) -> list:
    """The wrapper of one page's siblings of one mark; ``kind`` names the page's main text."""
    groups: dict[str, list[Node]] = {}
    for node in nodes:
        for kid in node.kids:
            if isinstance(kid, Node):
                groups.setdefault(kid.mark, []).append(kid)
    return [nodes[0].mark, 1, {str(n.print): [1, [kind]] for n in nodes}, [shape(g, kind) for g in groups.values()]]


def match(a: list, b: list, memo: dict) -> int:
    """Simple tree matching: the most nodes that two trees pair, parents with parents and in order."""
    if a[0] != b[0]:
        return 0
    key = (id(a), id(b))
    if key not in memo:
        memo[key] = 1 + _table(a[3], b[3], memo)[len(a[3])][len(b[3])]
    return memo[key]


def _table(left: list, right: list, memo: dict) -> list[list[int]]:
    best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i, x in enumerate(left):
        for j, y in enumerate(right):
            pair = best[i][j] + (match(x, y, memo) if x[0] == y[0] else 0)
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], pair)
    return best


def align(left: list, right: list, memo: dict) -> list[tuple]:
    """Children of two matched nodes in one order: pairs, or one with None."""
    if [x[0] for x in left] == [y[0] for y in right]:
        return list(zip(left, right))
    best = _table(left, right, memo)
    out, i, j = [], len(left), len(right)
    while i and j:
        x, y = left[i - 1], right[j - 1]
        if x[0] == y[0] and best[i][j] == best[i - 1][j - 1] + match(x, y, memo):
            out.append((x, y))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            out.append((x, None))
            i -= 1
        else:
            out.append((None, y))
            j -= 1
    out += [(x, None) for x in reversed(left[:i])] + [(None, y) for y in reversed(right[:j])]
    return out[::-1]


def fold(a: list, b: list, memo: dict) -> list:
    """The wrapper of all pages of two."""
    kids = [y if x is None else x if y is None else fold(x, y, memo) for x, y in align(a[3], b[3], memo)]
    pages, texts = a[1] + b[1], dict(a[2])
    for text, (n, kinds) in b[2].items():
        have, known = texts.get(text, (0, []))
        texts[text] = [have + n, known if len(known) >= LEAST_VARIETY else sorted({*known, *kinds})[:LEAST_VARIETY]]
    if pages >= PRUNE_FROM:
        texts = {t: e for t, e in texts.items() if 2 * e[0] >= pages}
    return [a[0], pages, texts, kids]


def fold_all(a: dict | None, b: dict) -> dict:
    if a is None:
        return b
    return {
        "tree": fold(a["tree"], b["tree"], {}),
        "kinds": sorted({*a["kinds"], *b["kinds"]})[:LEAST_VARIETY],
    }


def templates(node: list) -> list:
    """A wrapper with nothing but the texts that are template: [mark, pages, texts, children]."""
    mark, pages, texts, kids = node
    kept = [int(t) for t, (n, kinds) in texts.items() if len(kinds) >= LEAST_VARIETY and n >= TEMPLATE_SHARE * pages]
    return [mark, pages, kept, [templates(kid) for kid in kids]]


def main_slots(root: Node) -> list[Node]:
    """The elements that hold the article: the longest one and its siblings of that kind, in page order."""

    def walk(node: Node, test, found: list) -> list:
        for kid in node.kids:
            if isinstance(kid, Node) and not is_part(kid, False):
                if test(kid):
                    found.append((node, kid))
                else:
                    walk(kid, test, found)
        return found

    for test in (
        lambda n: n.tag == "article",
        lambda n: n.tag == "main" or "main" in n.names,
        lambda n: bool(n.names & MAIN_NAMES) and n.tag not in ("html", "body"),
        lambda n: n.tag == "body",
    ):
        found = walk(root, test, [])
        if found:
            parent, _ = max(found, key=lambda f: sum(map(len, blocks_of(f[1], None))))
            return [n for above, n in found if above is parent]
    return [root]


def blocks_of(slot: Node, wrapper: list | None) -> list[str]:
    """Texts of the slot's blocks in order, without parts and without template nodes."""
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        text = " ".join(html_text.unescape("".join(line)).split())
        line.clear()
        if text:
            out.append(text)

    def walk(node: Node, known: dict) -> None:
        for kid in node.kids:
            if isinstance(kid, str):
                line.append(kid)
                continue
            if is_part(kid, True):
                continue
            same = known.get(kid.mark)
            block = kid.tag in BLOCKS
            if same is not None and block and kid.print in same[2] and kid.kids:
                continue
            if block or kid.tag == "br":
                end()
            elif kid.tag in ("td", "th"):
                line.append(" ")
            walk(kid, {k[0]: k for k in same[3]} if same is not None else {})
            if block:
                end()
            elif kid.tag in ("td", "th"):
                line.append(" ")

    walk(slot, {k[0]: k for k in wrapper[3]} if wrapper is not None else {})
    end()
    return out


def _wrappers_of(root: Node, slots: list[Node], tree: list) -> list[list | None]:
    """The wrapper's node for each main slot, by aligning the page with the wrapper once; slots are siblings."""
    above = _path(root, slots[0])[:-1]
    page, memo = shape([root]), {}

    def step(page: list, tree: list, mark: str) -> tuple[list, list] | None:
        return next(((x, y) for x, y in align(page[3], tree[3], memo) if x is not None and y is not None and x[0] == mark), None)

    for mark in above:
        pair = step(page, tree, mark)
        if pair is None:
            return [None] * len(slots)
        page, tree = pair
    if slots[0] is root:
        return [tree]
    found = {mark: step(page, tree, mark) for mark in {slot.mark for slot in slots}}
    return [found[slot.mark] and found[slot.mark][1] for slot in slots]


def _path(root: Node, target: Node) -> list[str]:
    if root is target:
        return []
    for kid in root.kids:
        if isinstance(kid, Node):
            if kid is target:
                return [kid.mark]
            below = _path(kid, target)
            if below:
                return [kid.mark, *below]
    return []


def learn(page: str) -> dict:
    """One page's wrapper, with a hash of its main text."""
    root = read_page(page)
    fingerprint(root)
    kind = xxhash.xxh64_intdigest("\n".join(x for n in main_slots(root) for x in blocks_of(n, None))) >> 1
    return {"tree": shape([root], kind % (1 << 31)), "kinds": [kind]}


def extract(page: str | None, wrapper: dict | None) -> str:
    """The main text of one page; the wrapper's tree holds templates."""
    if not page:
        return ""
    root = read_page(page)
    slots = main_slots(root)
    nodes: list[list | None] = [None] * len(slots)
    if wrapper is not None and len(wrapper["kinds"]) >= LEAST_VARIETY:
        fingerprint(root)
        nodes = _wrappers_of(root, slots, wrapper["tree"])
    return "\n".join(x for slot, node in zip(slots, nodes) for x in blocks_of(slot, node))


_PARTIAL = "host string, salt int, wrapper string"


def learn_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html) to one folded wrapper for each host of a batch."""
    taught: set[tuple[str, int]] = set()  # main texts of this task, 8 bytes and a host's name each
    for batch in batches:
        hosts: dict[str, dict] = {}
        for host, page in zip(batch.column(0), batch.column(1)):
            if page.is_valid and len(page.as_buffer()):
                name, one = host.as_py(), learn(page.as_py())
                if (name, one["kinds"][0]) not in taught:
                    taught.add((name, one["kinds"][0]))
                    hosts[name] = fold_all(hosts.get(name), one)
        texts = [json.dumps(w) for w in hosts.values()]
        salts = [xxhash.xxh32_intdigest(t) % FOLD_GROUPS for t in texts]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(hosts), pa.string()), pa.array(salts, pa.int32()), pa.array(texts, pa.string())],
            names=["host", "salt", "wrapper"],
        )


def fold_wrappers(keys: int, last: bool = False):
    """Sorted by its first ``keys`` columns: one wrapper for each value of them, with templates alone if it is the ``last`` fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, wrapper = None, None

        def told() -> pa.RecordBatch:
            done = {**wrapper, "tree": templates(wrapper["tree"])} if last else wrapper
            return pa.RecordBatch.from_arrays(
                [pa.array([held[0]], pa.string()), pa.array([0], pa.int32()), pa.array([json.dumps(done)], pa.string())],
                names=["host", "salt", "wrapper"],
            )

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3))):
                key = row[:keys]
                if held is not None and key != held:
                    yield told()
                    wrapper = None
                held = key
                wrapper = fold_all(wrapper, json.loads(row[2]))
        if held is not None:
            yield told()

    return run


def extract_column():
    """A column function: (html, wrapper) to the main text."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        read: dict[str, dict] = {}
        for pages, wrappers in batches:
            out = []
            for page, wrapper in zip(pages, wrappers):
                known = None
                if wrapper.is_valid:
                    text = wrapper.as_py()
                    if text not in read:
                        if len(read) > 500:
                            read.clear()
                        read[text] = json.loads(text)
                    known = read[text]
                out.append(extract(page.as_py(), known))
            yield pa.array(out, pa.string())

    return F.arrow_udf(run, "string").asNondeterministic()


def induce_wrappers(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """(host, wrapper) for every host."""
    hosts = pages.select(F.lower(F.regexp_extract(url, _HOST, 1)).alias("host"), F.col(html).cast("string").alias("html"))
    parts = hosts.filter("host <> ''").mapInArrow(learn_pages, _PARTIAL)
    groups = parts.repartition("host", "salt").sortWithinPartitions("host", "salt").mapInArrow(fold_wrappers(2), _PARTIAL)
    whole = groups.repartition("host").sortWithinPartitions("host").mapInArrow(fold_wrappers(1, last=True), _PARTIAL)
    return whole.select("host", "wrapper")


def extract_main_text(pages: DataFrame, *, url: str = "url", html: str = "html", into: str = "text") -> DataFrame:
    """Add ``into``: the page's main text, blocks joined by line feeds.

    Wrappers are written first, so the join knows their size: small ones go to the pages,
    else pages meet them by host, where a large host is split.
    """
    wrappers = materialise(induce_wrappers(pages, url=url, html=html), "wrappers")
    keyed = pages.withColumn("__host", F.lower(F.regexp_extract(url, _HOST, 1)))
    known = wrappers.select(F.col("host").alias("__host"), F.col("wrapper").alias("__wrapper"))
    out = keyed.join(known, "__host", "left")
    return out.withColumn(into, extract_column()(F.col(html).cast("string"), F.col("__wrapper"))).drop("__host", "__wrapper")
