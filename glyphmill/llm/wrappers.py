"""Main text of HTML pages by wrappers: union-free regular expressions inferred from the pages of a host.

A page is a stream of start tags, end tags and texts. As elements nest, its stream is kept as a tree, in which groups that
come again are folded into `( ... )+`. The streams of a host are then aligned one after the other, in the order of their
expressions: what both have stays, what one lacks becomes `( ... )?`, what comes in another order becomes a repeated group,
texts that differ become slots, written `#`. All pages take part: those with one expression are merged where they are read,
and what is left of a host is aligned in parts of bounded size, then the parts.

A page is matched against its host's wrapper. Slots have a weight, the characters outside links that they hold on a page
on average; a text that is the same on all of at least LEAST unlike pages is the template's and weighs nothing. From the
page's root the element with SHARE of the weight is entered, again and again, as long as it is neither repeated nor a block
of text; <article> and <main> aren't left. The main text is what the slots of the element reached hold, with a first heading
beside the way; without the template's texts, elements that are links only, and elements that HTML has for other ends
(nav, footer, aside, form ...). Names of classes choose no element: they only veto one that says it's a comment, an advert and
so on. Hosts with fewer unlike pages have no template; there <article> or <main> is taken first.

Null and empty pages give an empty text, as do pages with markup only. Repeated rows are each extracted; equal pages count
once as unlike pages. A page without a host in its URL belongs to the host "". Very long and deeply nested pages take time
in proportion to their length. An empty table gives an empty one. Columns of the table besides the three aren't read.
Elements of equal weight: the first one. Wrappers don't depend on the order of pages or on how they are dealt out.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import common

#: Unlike pages that must agree in a text for it to be the template's.
LEAST = 3
#: Share of the weight that an element needs to be entered.
SHARE = 0.75
#: Share of an element's characters in links from which it is links only.
LINKED = 0.9
#: Unlike siblings without a class that are told apart by what they hold; more of them are one repeated group.
WIDE = 64
#: Expressions of a host that are aligned in one task, about.
PART = 512
#: Expressions that a task keeps before it hands them on.
HELD = 20_000
#: Characters of all wrappers up to which the driver hands them to all; beyond, they are joined by host.
BROADCAST = 8_000_000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe|select|head|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?|<[!?][^>]*>?|[^<]+|<", re.S | re.I)
_NAMES = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
# fixed values: elements of HTML
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img br".split())
VOID = frozenset("area base col embed hr input link meta param source track".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open element of the first kind ends where one of the second begins.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BLOCKS = HEADINGS | frozenset("p li dt dd tr td th ul ol dl table thead tbody tfoot pre blockquote figure figcaption caption address".split())
GENERIC = frozenset("div section table td th p".split())
OTHER_ENDS = frozenset("nav footer aside form button menu dialog".split())
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search dialog".split())
NOISE_NAMES = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside footer masthead topbar ad ads adv advert adverts advertisement advertising sponsor "
    "sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share "
    "sharing social related recommended comment comments commentlist disqus respond reply replies pagination pager widget widgets toolbar search searchbox skip".split()
)


class Node:
    """An element with what it holds, or a text ("#"), of one page or of many."""

    __slots__ = ("sig", "kids", "opt", "rep", "glue", "n", "chars", "links", "text", "pages", "blocks")

    def __init__(self, sig: str):
        self.sig, self.kids, self.n = sig, [], 1
        self.opt = self.rep = self.glue = False  # may lack; in a repeated group; in one with the next sibling
        # of texts: characters, those in links, the text if it is always the same, smallest hashes of its pages, blocks
        self.chars, self.links, self.text, self.pages, self.blocks = 0, 0, None, [], []

    @property
    def tag(self) -> str:
        return self.sig.partition(".")[0].partition("@")[0]

    def key(self) -> str:
        """What tells siblings apart: tag, class and role; without these also what it holds."""
        if self.sig in GENERIC and self.sig != "p":
            return self.sig + "{" + " ".join(sorted({k.sig for k in self.kids})) + "}"
        return self.sig


def merge(into: Node, other: Node, same_page: bool = False) -> None:
    """Align other with into, which becomes the expression of both."""
    work = [(into, other)]
    while work:
        a, b = work.pop()
        a.chars += b.chars
        a.links += b.links
        if not same_page:
            a.n += b.n
        a.opt, a.rep = a.opt or b.opt, a.rep or b.rep
        if a.sig == "#":
            if a.text != b.text:
                a.text = None
            if not same_page:
                a.pages = sorted({*a.pages, *b.pages})[:LEAST]
            a.blocks += b.blocks
            continue
        if len(a.kids) == len(b.kids) and all(x.sig == y.sig for x, y in zip(a.kids, b.kids)):
            for x, y in zip(a.kids, b.kids):
                x.glue = x.glue or y.glue
                work.append((x, y))
        else:
            work += _aligned(a, b)


def _pairs(a: list[Node], b: list[Node]) -> list[int]:
    """For each of b its partner's place in a, or -1: by key; of what is left, by signature in the order of both."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at.setdefault(x.key(), i)
    found, taken = [-1] * len(b), set()
    for j, y in enumerate(b):
        i = at.get(y.key(), -1)
        if i >= 0 and i not in taken:
            found[j] = i
            taken.add(i)
    if -1 in found:
        free: dict[str, list[int]] = {}
        for i in range(len(a) - 1, -1, -1):
            if i not in taken:
                free.setdefault(a[i].sig, []).append(i)
        for j, y in enumerate(b):
            if found[j] < 0 and free.get(y.sig):
                found[j] = free[y.sig].pop()
    return found


def _aligned(a: Node, b: Node) -> list[tuple[Node, Node]]:
    found = _pairs(a.kids, b.kids)
    pairs, after = [], {}
    place, glued = -1, [x.glue for x in a.kids]
    for j, y in enumerate(b.kids):
        i = found[j]
        if i < 0:  # a has none
            y.opt = True
            after.setdefault(place, []).append(y)
            continue
        pairs.append((a.kids[i], y))
        if i < place:  # another order: all between is one repeated group
            for k in range(i, place):
                glued[k] = True
        elif y.glue and j + 1 < len(b.kids) and found[j + 1] == i + 1:
            glued[i] = True
        place = i
    met = set(found)
    for i, x in enumerate(a.kids):
        x.opt = x.opt or i not in met
        x.glue = glued[i] and i + 1 < len(a.kids)
    kids: list[Node] = [*after.get(-1, ())]
    for i, x in enumerate(a.kids):
        kids.append(x)
        for y in after.get(i, ()):
            y.glue = x.glue
            kids.append(y)
    for x, y in zip(kids, kids[1:]):
        if x.glue:
            x.rep = y.rep = True
    kids[-1].glue = False
    a.kids = kids
    return pairs


def _folded(node: Node) -> None:
    """Siblings that come again are one repeated group, each once in it; one that not all rounds have may lack."""
    kids = node.kids
    if len(kids) < 2:
        return
    keys = [k.key() for k in kids]
    if len(keys) > WIDE:
        many: dict[str, set] = {}
        for k, key in zip(kids, keys):
            many.setdefault(k.sig, set()).add(key)
        keys = [k.sig if len(many[k.sig]) > WIDE else key for k, key in zip(kids, keys)]
    if len(set(keys)) == len(keys):
        return
    out: list[Node] = []
    at: dict[str, int] = {}
    last, seen = -1, []  # of each node kept, in which rounds of its group it was
    for k, key in zip(kids, keys):
        i = at.get(key, -1)
        if i < 0:
            at[key] = last = len(out)
            out.append(k)
            seen.append(1)
            continue
        for j in range(i, last):
            out[j].glue = True
        out[i].rep = out[last].rep = True
        seen[i] += 1
        last = i
        merge(out[i], k, same_page=True)
    end = 0
    while end < len(out):  # runs of glued nodes
        first = end
        while out[end].glue and end + 1 < len(out):
            end += 1
        most = max(seen[first : end + 1])
        for j in range(first, end + 1):
            if end > first:
                out[j].rep = True
                out[j].opt = out[j].opt or seen[j] < most
        end += 1
    node.kids = out


def parse(source: str) -> tuple[Node, list[str]]:
    """The page's folded tree and its blocks of text, as they stand in it."""
    root = Node("")
    stack, names = [root], [""]
    opened: dict[str, int] = {}
    pieces: list[list[str]] = []
    text: Node | None = None
    link, link_depth = False, 0
    mark = [xxhash.xxh3_64_intdigest(source.encode("utf-8", "surrogatepass")) >> 1]

    def close() -> None:
        nonlocal link
        _folded(stack.pop())
        opened[names.pop()] -= 1
        if len(stack) < link_depth:
            link = False

    for m in _TOKEN.finditer(source):
        token = m[0]
        if token[0] != "<" or token == "<":
            if text is None:
                if token.isspace():
                    continue
                text = Node("#")
                text.blocks, text.pages = [len(pieces)], mark
                stack[-1].kids.append(text)
                pieces.append([])
            pieces[-1].append(token)
            n = len(token)
            text.chars += n
            if link:
                text.links += n
            continue
        name = m[3]
        if name is None:
            if m[1] is not None:
                text = None
            continue
        name = name.lower()
        if name in INLINE:
            if name == "a":
                link, link_depth = not m[2], len(stack)
            elif name == "br" and text is not None:
                pieces[-1].append(" ")
            continue
        text = None
        if m[2]:
            if opened.get(name, 0) > 0:
                while names[-1] != name:
                    close()
                close()
            continue
        own = names[-1]
        if own == "p" or own in HEADINGS:  # hold no blocks
            close()
        elif name in ENDS:
            ends = ENDS[name]
            depth = len(names) - 1
            while depth > 0 and names[depth] in BLOCKS and names[depth] not in ends and names[depth] not in ("ul", "ol", "dl", "table"):
                depth -= 1
            if names[depth] in ends:
                while len(names) > depth:
                    close()
        if name in ("html", "body"):
            continue
        sig = name
        if "=" in m[4]:
            known, role = set(), ""
            for kind, *values in _NAMES.findall(m[4]):
                value = next((v for v in values if v), "").lower()
                if kind.lower() in ("class", "id"):
                    known.update(x for x in re.split(r"[^a-z0-9]+", value) if x and not x.isdigit())
                else:
                    role = role or value.split(" ")[0]
            sig += "".join("." + n for n in sorted(known)) + ("@" + role if role else "")
        node = Node(sig)
        stack[-1].kids.append(node)
        if name in VOID or m[4].endswith("/"):
            continue
        stack.append(node)
        names.append(name)
        opened[name] = opened.get(name, 0) + 1
    while len(stack) > 1:
        close()
    _folded(root)
    blocks = ["".join(p) for p in pieces]
    for node, _ in walk(root):
        if node.sig == "#":
            node.text = clean(blocks[node.blocks[0]]) if len({clean(blocks[i]) for i in node.blocks}) == 1 else None
    return root, blocks


def clean(raw: str) -> str:
    return " ".join((entities.unescape(raw) if "&" in raw else raw).split())


def walk(root: Node) -> Iterator[tuple[Node, int]]:
    """Nodes with their depth, in the order of the page."""
    work = [(root, 0)]
    while work:
        node, depth = work.pop()
        yield node, depth
        work += [(k, depth + 1) for k in reversed(node.kids)]


def expression(root: Node, texts: bool = False) -> str:
    """The regular expression over tags and texts; with texts, those of the template are written out."""
    out: list[str] = []
    work: list = [root]
    while work:
        x = work.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        after, before, glued = [], [], False
        for k in x.kids:
            if (k.rep and k.glue and not glued) or (k.rep and not k.glue and not glued):
                before.append("(")
            if k.opt:
                before.append("(")
            before.append(k)
            if k.opt:
                before.append(")?")
            if k.rep and not k.glue:
                before.append(")+")
            glued = k.glue
        if x.sig == "#":
            out.append("=" + x.text if texts and own(x) else "#")
        elif x.sig:
            out.append("<" + x.sig)
            after = [">" + x.tag]
        work += reversed([*before, *after])
    return " ".join(out)


def own(node: Node) -> bool:
    """Is a text the template's own?"""
    return node.text is not None and len(node.pages) >= LEAST


def dumps(root: Node) -> str:
    return json.dumps([[d, n.sig, n.opt + 2 * n.rep + 4 * n.glue, n.n] + ([n.chars, n.links, n.text, n.pages] if n.sig == "#" else []) for n, d in walk(root)], ensure_ascii=False, separators=(",", ":"))


def loads(data: str) -> Node:
    path: list[Node] = []
    for depth, sig, flags, n, *more in json.loads(data):
        node = Node(sig)
        node.opt, node.rep, node.glue, node.n = bool(flags & 1), bool(flags & 2), bool(flags & 4), n
        if more:
            node.chars, node.links, node.text, node.pages = more
        del path[depth:]
        if path:
            path[-1].kids.append(node)
        path.append(node)
    return path[0]


def aligned(trees: list[Node]) -> Node:
    """One expression of many, aligned in the order of their expressions, the most frequent first."""
    first, *rest = sorted(trees, key=lambda t: (-t.n, expression(t)))
    for tree in rest:
        merge(first, tree)
    return first


def infer(sources: list[str]) -> dict:
    """The wrapper of pages of one host, spelt out: regex, template (texts of its own), region (of the first page: the path entered)."""
    found = aligned([parse(s)[0] for s in sources])
    page = parse(sources[0])[0]
    _, path, _ = kept(Wrapper(found), page)
    return {"regex": expression(found, texts=True), "template": sorted({n.text for n, _ in walk(found) if n.sig == "#" and own(n)}), "region": path}


class Wrapper:
    """A host's expression with the weights of its nodes; without a template if it comes from too few unlike pages."""

    def __init__(self, root: Node):
        self.root = root
        order = [n for n, _ in walk(root)]
        self.known = max((len(n.pages) for n in order if n.sig == "#"), default=0) >= LEAST
        self.weight: dict[int, float] = {}
        self.linked: dict[int, float] = {}
        total: dict[int, tuple[int, int]] = {}
        for node in reversed(order):
            plain = links = 0
            if node.sig == "#":
                plain, links = (0, 0) if own(node) else (node.chars - node.links, node.links)
            for k in node.kids:
                plain, links = plain + total[id(k)][0], links + total[id(k)][1]
            total[id(node)] = plain, links
            self.weight[id(node)] = plain / node.n
            self.linked[id(node)] = links / max(1, plain + links)
        self.decided: dict[str, tuple[list[int], list[str], bool]] = {}


def _veto(node: Node) -> bool:
    """Does the element say that it is for another end?"""
    tag = node.tag
    if tag in OTHER_ENDS:
        return True
    if tag in ("article", "main"):
        return False
    names, _, role = node.sig.partition("@")
    return role in OTHER_ROLES or not NOISE_NAMES.isdisjoint(names.split(".")[1:])


def _is_article(node: Node) -> bool:
    return node.tag in ("article", "main") or node.sig.endswith(("@main", "@articlebody"))


def kept(wrapper: Wrapper, page: Node) -> tuple[list[int], list[str], bool]:
    """Numbers of the page's texts (in walk order) that are the main text, the path to their element, whether the wrapper has all of the page."""
    match: dict[int, Node] = {id(page): wrapper.root}
    whole, work = True, [page]
    while work:
        node = work.pop()
        mine = match.get(id(node))
        if mine is None:
            whole = False
        else:
            for k, i in zip(node.kids, _pairs(mine.kids, node.kids)):
                if i >= 0:
                    match[id(k)] = mine.kids[i]
        work += node.kids
    weigh = lambda n: wrapper.weight[id(match[id(n)])] if id(n) in match else 0.0
    at, path, heads = page, [], []
    if not wrapper.known:
        # few pages: the element that HTML has for it
        found = [n for n, _ in walk(page) if _is_article(n) and not _veto(n)]
        if found:
            at = max(found, key=weigh)
            path = [at.sig]
    while not _is_article(at):
        open_ = [k for k in at.kids if not _veto(k)]
        best = max(open_, key=weigh, default=None)
        if best is None or best.sig == "#" or best.tag in BLOCKS or (id(best) in match and match[id(best)].rep) or best.rep:
            break
        if weigh(best) <= 0 or weigh(best) < SHARE * sum(map(weigh, open_)):
            break
        heads += [k for k in open_[: open_.index(best)] if k.tag == "h1" and weigh(k) > 0]
        at = best
        path.append(at.sig)
    chosen: set[int] = set()
    work = [*heads, at]
    while work:
        node = work.pop()
        mine = match.get(id(node))
        if node.sig == "#":
            if mine is None or not own(mine):
                chosen.add(id(node))
        elif node is at or not (_veto(node) or (mine is not None and node.tag in ("ul", "ol", "div", "section") and wrapper.linked[id(mine)] >= LINKED)):
            work += node.kids
    texts = [n for n, _ in walk(page) if n.sig == "#"]
    return [i for i, n in enumerate(texts) if id(n) in chosen], path, whole


def extract(source: str | None, wrapper: Wrapper | None) -> str:
    """The main text of a page by its host's wrapper; without one, by the page's own expression."""
    if not source:
        return ""
    page, blocks = parse(source)
    wrapper = wrapper or Wrapper(page)
    form = expression(page)
    chosen = wrapper.decided.get(form)
    if chosen is None:
        if len(wrapper.decided) > 10_000:
            wrapper.decided.clear()
        chosen = wrapper.decided[form] = kept(wrapper, page)
    texts = [n for n, _ in walk(page) if n.sig == "#"]
    lines = (clean(blocks[b]) for b in sorted(b for i in chosen[0] for b in texts[i].blocks))
    return "\n".join(line for line in lines if line)


def host(url: str = "url") -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON), n (pages), from all pages: merged by expression where they are read, then aligned by host."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        held: dict[tuple[str, str], Node] = {}

        def out() -> pa.RecordBatch:
            rows = [(h, xxhash.xxh3_64_intdigest(e) - (1 << 63), dumps(t)) for (h, e), t in held.items()]
            held.clear()
            names = ["host", "form", "tree"]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.string()))], names)

        for batch in batches:
            for h, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                page = parse(source)[0]
                key = h, expression(page)
                if key in held:
                    merge(held[key], page)
                else:
                    held[key] = page
            if len(held) > HELD:
                yield out()
        yield out()

    def together(group: pd.DataFrame) -> pd.DataFrame:
        tree = aligned([loads(t) for t in group["tree"]]) if len(group) > 1 else None
        return pd.DataFrame({"host": group["host"].iloc[:1], "form": group["form"].iloc[:1], "tree": [dumps(tree) if tree else group["tree"].iloc[0]]})

    schema = "host string, form long, tree string"
    rows = pages.select(host().alias("host"), "html").where("html IS NOT NULL").mapInArrow(read, schema)
    rows = common.cut(rows.groupBy("host", "form").applyInPandas(together, schema))
    most = rows.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    parts = 1
    while most > PART * parts:
        parts *= PART
    while parts > 1:  # a hot host's expressions, part by part
        rows = common.cut(rows.withColumn("part", F.pmod(F.xxhash64("form", F.lit(parts)), F.lit(parts))).groupBy("host", "part").applyInPandas(together, schema))
        parts //= PART
    found = rows.groupBy("host").applyInPandas(together, schema)
    return found.select("host", F.col("tree").alias("wrapper"), F.get_json_object("tree", "$[0][3]").cast("long").alias("n"))


def main_text(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, url, text, n_chars (code points)."""
    pages = pages.select(F.col(key).alias("key"), "url", "html")
    spark = pages.sparkSession
    known = common.cut(wrappers(pages))
    size = known.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0
    rows = pages.withColumn("host", host())
    if size <= BROADCAST:
        handed = spark.sparkContext.broadcast({r["host"]: r["wrapper"] for r in known.collect()})
        rows = rows.select("key", "url", "html", "host")
    else:
        handed = None
        rows = common.join_hot(rows, known, "host", "n", "left").select("key", "url", "html", "wrapper")
    token = common.token()

    def start():
        parsed = common.per_worker("wrappers", token, lambda: common.Memo(lambda w: Wrapper(loads(w)), 2000))

        def each(batch):
            parsed.fresh()
            given = batch.column(3).to_pylist()
            if handed is not None:
                given = map(handed.value.get, given)
            texts = [extract(h, parsed[w] if w else None) for h, w in zip(batch.column(2).to_pylist(), given)]
            return {"key": batch.column(0), "url": batch.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())}

        return each

    kind = pages.schema["key"].dataType.simpleString()
    return common.arrow_map(rows, f"key {kind}, url string, text string, n_chars long", start).withColumnRenamed("key", key)
