"""HTML extraction with wrappers inferred as union-free regular expressions.

A page is a stream of tokens: block-level tags (with their classes, digits made alike; ids differ from page to page and are left out)
and text. Inline tags and white space are no structure; scripts, styles and comments are skipped. Adjacent equal elements collapse
into a repeated group, ``(...)+``, whatever their size. The streams of one host's pages are aligned one after the other with
the host's wrapper: a group that only one side has becomes optional, ``(...)?``; a group that is repeated on one side becomes repeated; every
text is a slot. Only distinct streams travel, with sums over the texts of each slot, so a host with a third of all pages costs its distinct streams.

Slots are labelled once per host, from all texts that the host's pages have there:

* *template*: a slot that holds the same text, or in a repeated group the same texts, on CONSTANT different pages or more and on all that have
  it, while other slots of the host vary; pages with the same texts are one page, so copies are no evidence. What is marked (below) must
  stand on all pages that have marked slots; a heading in an article or main element is its own text, whether it changes or not;
* *set apart*: most of its texts stand in elements that say so by tag, role, class or id (menus, headers, footers, sidebars, notices,
  adverts, forms, comments), a prior that needs no second page;
* *marked*: most stand in an article or main element, or in one whose class or id says content;
* *body*: what neither holds a constant text nor mostly links, inside the element that holds the most such text of the host.

Then each page is parsed by its host's wrapper. If it has marked slots that aren't template, those of the best mark are its main text,
otherwise its body slots are; their texts, cut into blocks by block-level tags, in page order.

Defined cases: null or empty html gives the empty text; a null or odd url belongs to host ''; a page that its wrapper can't parse
is labelled by the elements around its own slots; rows that repeat a page are kept; a tag that never ends is text; further columns are ignored.
"""

from __future__ import annotations

import difflib
import hashlib
import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import stored

#: Streams of a host are folded in steps, by so many salts; constant texts need so many pages.
SALTS, CONSTANT, LINKS = (256, 16), 3, 0.5

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"(?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+>")
_DIGITS = re.compile(r"\d+")
_RAW = {"script", "style", "noscript", "template", "textarea", "svg", "math", "iframe", "object", "canvas", "audio", "video", "title", "select"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
_BOILERPLATE_TAG = {"nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "fieldset", "head"}
_BOILERPLATE_ROLE = {"navigation", "banner", "complementary", "contentinfo", "search", "form", "menu", "menubar", "alert", "dialog", "alertdialog"}
_BOILERPLATE_NAME = re.compile(
    r"(?:^|[-_ ])(?:ads?|adverts?|advertisements?|adsense|adbox|adslot|sponsor(?:ed)?|promo(?:tion)?|banner|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|aside|footer|foot|header|masthead|topbar|"
    r"cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|more|tags|pagination|pager|"
    r"comments?|commentlist|replies|reply|respond|disqus|discussion|widget|toolbar|skip|legal|copyright|disclaimer|paywall|search|form)(?:$|[-_ ])",
    re.I,
)
_CONTENT_TAG, _CONTENT_NAME = {"article", "main"}, re.compile(r"(?:^|[-_ ])(?:article|articlebody|content|main|post|entry|story|maincontent|postbody|body)(?:$|[-_ ])", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACES = re.compile(r"\s+")


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, value): kind is 'open', 'close' or 'text'; value holds the attributes or the text. In linear time: what
    looks for an end and doesn't find it isn't looked for again."""
    at, size, last = 0, len(page), page.rfind(">")
    cdata, quotes = True, True
    while at < size:
        start = page.find("<", at)
        if start < 0:
            yield "text", "", page[at:]
            return
        if start > at:
            yield "text", "", page[at:start]
        at = start
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = size if end < 0 else end + 3
            continue
        if cdata and page.startswith("<![CDATA[", at):
            end = page.find("]]>", at + 9)
            if end >= 0:
                yield "text", "", page[at + 9 : end]
                at = end + 3
                continue
            cdata = False
        if at > last:  # no tag ends any more
            yield "text", "", page[at:]
            return
        if page.startswith(("<!", "<?"), at):
            at = page.find(">", at) + 1
            continue
        m = _NAME.match(page, at)
        if m is None:
            yield "text", "", "<"
            at += 1
            continue
        rest = _REST.match(page, m.end()) if quotes else None
        if rest is None:  # from here on, quotes don't hide the end of a tag
            quotes = False
        end = rest.end() if rest else page.find(">", m.end()) + 1
        closing, name, value = page[at + 1] == "/", m[1].lower(), page[m.end() : end - 1]
        at = end
        if closing:
            yield "close", name, ""
        elif name in _RAW:
            found = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = found.end() if found else size
        else:
            yield "open", name, value


class Element:
    """A block-level element: what its and its ancestors' names say, and a key of the tags down to it."""

    __slots__ = ("bad", "good", "heading", "key", "name", "parent", "tag")

    def __init__(self, name: str, attributes: str, parent: Element | None) -> None:
        self.name, self.parent = name, parent
        found = {k.lower(): a or b or c or "" for k, a, b, c in _ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
        label = _CAMEL.sub("-", f"{found.get('class', '')} {found.get('id', '')}").strip()
        role = found.get("role", "").lower()
        bad = name in _BOILERPLATE_TAG or role in _BOILERPLATE_ROLE or (label and name not in ("body", "html", "article", "main") and _BOILERPLATE_NAME.search(label)) or "hidden" in found
        self.bad = bool(parent and parent.bad) or bool(bad)
        own = name in _CONTENT_TAG or role in ("main", "article")
        soft = bool(label and _CONTENT_NAME.search(label)) and name not in ("body", "html")
        self.good = max(parent.good if parent else 0, 2 if own else 1 if soft else 0)
        self.heading = bool(parent and parent.heading) or name in ("h1", "h2", "h3", "h4", "h5", "h6")
        classes = sorted(set(_DIGITS.sub("0", found.get("class", "").lower()).replace("/", "-").split()))
        self.tag = name + (f".{'.'.join(classes)}" if classes else "") + (f"[{role}]" if role else "")
        self.key = hashlib.blake2b(f"{parent.key if parent else ''}/{self.tag}".encode(), digest_size=8).hexdigest()

    def inside(self, key: str) -> bool:
        element: Element | None = self
        while element is not None and element.key != key:
            element = element.parent
        return element is not None


_ELEMENTS: dict[tuple, Element] = {}


def _element(name: str, attributes: str, parent: Element | None) -> Element:
    """Elements are the same for all pages of a template, so they are made once; the store is bounded."""
    key = (parent, name, attributes)
    found = _ELEMENTS.get(key)
    if found is None:
        if len(_ELEMENTS) > 50_000:
            _ELEMENTS.clear()
        found = _ELEMENTS[key] = Element(name, attributes, parent)
    return found


class Page:
    """Structure tokens, and for each slot its element, its raw text and how many characters of it are links."""

    def __init__(self, page: str) -> None:
        self.stream: list[str] = []
        self.slots: list[tuple[Element | None, str, int]] = []
        stack: list[Element] = []
        opened: Counter[str] = Counter()
        text: list[str] = []
        links = linked = 0

        def flush() -> None:
            nonlocal linked
            raw = "".join(text)
            text.clear()
            if raw.strip():
                self.stream.append("#")
                self.slots.append((stack[-1] if stack else None, raw, linked))
            linked = 0

        def close() -> str:
            name = stack.pop().name
            opened[name] -= 1
            self.stream.append("/" + name)
            return name

        for kind, name, value in tokens(page):
            if kind == "text":
                text.append(value)
                linked += len(value) if links else 0
                continue
            if name == "a":
                links = int(kind == "open")
            inline = name in _INLINE and not (kind == "open" and value and ("class" in value or "id" in value or "hidden" in value or "role" in value))
            if kind == "open" and inline:
                if name in ("br", "img"):
                    text.append(" ")
                continue
            if kind == "close" and not opened[name]:
                if name == "p":
                    flush()
                continue
            flush()
            if kind == "open":
                if name in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "td", "th", "div", "ul", "ol", "section", "article", "table", "blockquote", "pre"):
                    while stack and (stack[-1].name == "p" or (stack[-1].name == name and name in ("li", "dt", "dd", "tr", "td", "th"))):
                        close()
                element = _element(name, value, stack[-1] if stack else None)
                self.stream.append(element.tag)
                if name in _VOID or value.rstrip().endswith("/"):
                    continue
                stack.append(element)
                opened[name] += 1
            else:
                while stack and close() != name:
                    pass
        flush()


# wrappers: lists of nodes; a node is a token (str), ["+", nodes] or ["?", nodes]


def _tag_name(token: str) -> str:
    return token.split(".")[0].split("[")[0]


class _Item:
    """A token, or an element with its items; ``slots`` are the slots of the stream that a text stands for."""

    __slots__ = ("items", "kind", "repeated", "slots", "tail", "token")

    def __init__(self, kind: int, token: str = "", slots: list[int] | None = None, items: list[_Item] | None = None, tail: str = "") -> None:
        self.kind, self.token, self.slots, self.items, self.tail, self.repeated = kind, token, slots, items, tail, False


def _merge(kept: _Item, more: _Item) -> None:
    """The slots of an element that repeats another one, item by item."""
    todo = [(kept, more)]
    while todo:
        a, b = todo.pop()
        if a.slots is not None:
            a.slots.extend(b.slots)
        if a.items:
            todo.extend(zip(a.items, b.items, strict=True))


def collapse_with_slots(stream: list[str]) -> tuple[list, list[list[int]]]:
    """Adjacent equal elements become one repeated group, from the inside out; and for each slot of the result the slots of ``stream``. In
    linear time, however deep elements are nested."""
    kinds: dict[object, int] = {}
    frames: list[list[_Item]] = [[]]
    names: list[str] = []

    def kind(of: object) -> int:
        return kinds.setdefault(of, len(kinds))

    seen = 0
    for token in stream:
        if token == "#":
            frames[-1].append(_Item(kind("#"), "#", [seen]))
            seen += 1
        elif token[0] != "/":
            name = _tag_name(token)
            if name in _VOID:
                frames[-1].append(_Item(kind(token), token))
            else:
                frames.append([_Item(kind(token), token)])
                names.append(name)
        elif names and names[-1] == token[1:]:
            names.pop()
            items = frames.pop()
            element = _Item(kind(tuple(-1 - x.kind if x.repeated else x.kind for x in items)), items=items, tail=token)
            own = frames[-1]
            if own and own[-1].items is not None and own[-1].kind == element.kind:
                _merge(own[-1], element)
                own[-1].repeated = True
            else:
                own.append(element)
        else:
            frames[-1].append(_Item(kind(token), token))
    nodes: list = []
    slots: list[list[int]] = []
    open_ = [(iter([x for f in frames for x in f]), nodes, "")]  # elements that never end count as their tokens
    while open_:
        items, out, tail = open_[-1]
        item = next(items, None)
        if item is None:
            open_.pop()
            if tail:
                out.append(tail)
        elif item.items is None:
            out.append(item.token)
            if item.slots is not None:
                slots.append(item.slots)
        else:
            inner = [] if item.repeated else out
            if item.repeated:
                out.append(["+", inner])
            open_.append((iter(item.items), inner, item.tail))
    return nodes, slots


def collapse(stream: list[str]) -> list:
    return collapse_with_slots(stream)[0]


def unrolled(nodes: list) -> list[str]:
    """The stream in which each group of a collapsed one stands once."""
    out: list[str] = []
    for n in nodes:
        out.extend([n] if isinstance(n, str) else unrolled(n[1]))
    return out


def _plain(node) -> str:  # noqa: ANN001
    """Key of a node whether it is repeated or stands once."""
    if isinstance(node, str):
        return node
    return "(" + "".join(_plain(n) + " " for n in node[1]) + ")"


def _units(nodes: list) -> list[tuple[str, list]]:
    """Alignment units: an element that stands once has the key of its repeated form."""
    out, i = [], 0
    while i < len(nodes):
        n = nodes[i]
        if not isinstance(n, str):
            out.append((_plain(n), [n]))
            i += 1
            continue
        if n[0] != "/" and n != "#":
            depth_name = "/" + _tag_name(n)
            j = i + 1
            while j < len(nodes) and isinstance(nodes[j], str) and nodes[j] == "#":
                j += 1
            if j < len(nodes) and nodes[j] == depth_name:
                out.append(("(" + "".join(x + " " for x in nodes[i : j + 1]) + ")", nodes[i : j + 1]))
                i = j + 1
                continue
        out.append((n, [n]))
        i += 1
    return out


def _is(nodes: list, kind: str) -> bool:
    return len(nodes) == 1 and not isinstance(nodes[0], str) and nodes[0][0] == kind


def _align_key(key: str, nodes: list) -> str:
    """An optional group is aligned by what it holds."""
    if not _is(nodes, "?"):
        return key
    return " ".join(_align_key(k, n) for k, n in _units(nodes[0][1]))


def _both(x: list, y: list) -> list:
    """One unit for two that align: optional if either is, repeated if either is."""
    inner = [n[0][1] if _is(n, "?") else n for n in (x, y)]
    kept = next((n for n in inner if _is(n, "+")), inner[0])
    return [["?", kept]] if _is(x, "?") or _is(y, "?") else kept


def align(wrapper: list, stream: list) -> list:
    """The wrapper that accepts what either side accepts: mismatches become optional groups, and once or repeated becomes repeated."""
    a, b = _units(wrapper), _units(stream)
    out: list = []
    matcher = difflib.SequenceMatcher(None, [_align_key(*u) for u in a], [_align_key(*u) for u in b], autojunk=False)
    for op, i, j, k, m in matcher.get_opcodes():
        if op == "equal":
            for (_, x), (_, y) in zip(a[i:j], b[k:m], strict=True):
                out.extend(_both(x, y))
        else:
            for _, nodes in (*a[i:j], *b[k:m]):
                out.extend(nodes if _is(nodes, "?") else [["?", nodes]])
    return out


def infer(streams: list[list]) -> list:
    """A wrapper of all streams, aligned one after the other."""
    wrapper = streams[0]
    for stream in streams[1:]:
        wrapper = align(wrapper, stream)
    return wrapper


def parse(wrapper: list, stream: list[str]) -> list[tuple[int, ...]] | None:
    """Which node of the wrapper each slot of the stream belongs to; None if the wrapper doesn't accept the stream."""
    slots: list[tuple[int, ...]] = []

    def run(nodes: list, at: int, place: tuple[int, ...]) -> int:
        for k, node in enumerate(nodes):
            if isinstance(node, str):
                if at >= len(stream) or stream[at] != node:
                    return -1
                if node == "#":
                    slots.append((*place, k))
                at += 1
                continue
            times = 0
            while True:
                mark = len(slots)
                after = run(node[1], at, (*place, k))
                if after < 0 or after == at:
                    del slots[mark:]
                    break
                at, times = after, times + 1
                if node[0] == "?":
                    break
            if node[0] == "+" and not times:
                return -1
        return at

    return slots if run(wrapper, 0, ()) == len(stream) else None


#: Sums of a slot over texts: texts, those in elements that are set apart, in a marked element, in an article or main, characters, of these in links,
#: and those that are headings.
_SUMS = ("n", "bad", "soft", "good", "chars", "link", "head")


def _block(raw: str) -> str:
    return _SPACES.sub(" ", entities.unescape(raw)).strip()


class Wrapper:
    """A host's expression and the labels of its slots."""

    def __init__(self, nodes: list, slots: list[dict]) -> None:
        """slots: per place its sums, the least hashes of the different pages that have it, the least and largest hash of what a page has
        there, and the element around its own."""
        self.nodes = nodes
        self.apart, self.template, self.mark, self.linked = set(), set(), {}, set()
        marked = [x for x in slots if 2 * x["soft"] > x["n"]]
        everywhere = max((x["times"] for x in marked), default=0)
        own = {tuple(x["place"]) for x in marked if x["times"] < everywhere or (2 * x["good"] > x["n"] and 2 * x["head"] > x["n"])}
        constant = {tuple(x["place"]) for x in slots if x["lo"] == x["hi"] and len(x["pages"]) >= CONSTANT} - own
        varies = any(tuple(x["place"]) not in constant and 2 * x["bad"] <= x["n"] for x in slots)
        weight: Counter[str] = Counter()
        for x in slots:
            place = tuple(x["place"])
            if 2 * x["bad"] > x["n"]:
                self.apart.add(place)
                continue
            self.mark[place] = 2 if 2 * x["good"] > x["n"] else 1 if 2 * x["soft"] > x["n"] else 0
            if varies and place in constant:
                self.template.add(place)
            elif x["link"] > LINKS * x["chars"]:
                self.linked.add(place)
            else:
                weight[x["around"]] += x["chars"]
        self.container = max(weight, key=lambda k: (weight[k], k), default="")

    def _main(self, slots: list, places: list | None) -> list[bool]:
        """Which slots of a page are its main text."""
        if places is None:
            apart = [bool(e and e.bad) for e, _, _ in slots]
            mark = [e.good if e else 0 for e, _, _ in slots]
            off, linked = [False] * len(slots), [link > LINKS * len(raw) for _, raw, link in slots]
        else:
            apart = [p in self.apart for p in places]
            mark = [self.mark.get(p, 0) for p in places]
            off, linked = [p in self.template for p in places], [p in self.linked for p in places]
        best = max((m for m, x, t in zip(mark, apart, off, strict=True) if not x and not t), default=0)
        if best:
            return [m == best and not x and not t for m, x, t in zip(mark, apart, off, strict=True)]
        body = [not x and not t and not k for x, t, k in zip(apart, off, linked, strict=True)]
        inside = [b and (not self.container or bool(e and e.inside(self.container))) for b, (e, _, _) in zip(body, slots, strict=True)]
        return inside if any(inside) else body

    def text(self, page: Page) -> str:
        main = self._main(page.slots, parse(self.nodes, page.stream))
        blocks = (_block(raw) for (_, raw, _), wanted in zip(page.slots, main, strict=True) if wanted)
        return "\n\n".join(b for b in blocks if b)


def host(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/@]*@)?([^/:?#]*)", url or "")
    return m[1].lower() if m else ""


_STAT = "n long, bad long, soft long, good long, chars long, link long, head long, times long, pages array<long>, lo long, hi long, around string"
_NAMES = (*_SUMS, "times", "pages", "lo", "hi", "around")
_KINDS = (*[pa.int64()] * 8, pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string())


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct streams of each host with sums over each of their slots (slot -1: over pages)."""
    found: dict[tuple[str, str, int], list] = {}
    names = ["host", "stream", "slot", *_NAMES]
    kinds = [pa.string(), pa.string(), pa.int32(), *_KINDS]

    def flush() -> pa.RecordBatch:
        rows = [(*k, *v) for k, v in found.items()]
        found.clear()
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    def add(key: tuple[str, str, int], row: list) -> None:
        old = found.get(key)
        if old is None:
            found[key] = row
        else:
            old[:8] = [a + b for a, b in zip(old[:8], row[:8], strict=True)]
            old[8] = sorted({*old[8], *row[8]})[:CONSTANT]
            old[9], old[10], old[11] = min(old[9], row[9]), max(old[10], row[10]), min(old[11], row[11])

    for batch in batches:
        for h, text in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            page = Page(text or "")
            nodes, slots = collapse_with_slots(page.stream)
            stream = json.dumps(nodes, separators=(",", ":"))
            hashes = [_hash(_block(raw)) for _, raw, _ in page.slots]
            own_page = [hash(tuple(hashes))]  # of integers: the same in every process
            add((h, stream, -1), [0] * 7 + [1, own_page, 0, 0, ""])
            for k, own in enumerate(slots):
                row: list = [0] * 7 + [1, own_page, 0, 0, ""]
                for element, raw, link in (page.slots[i] for i in own):
                    bad, good, head = bool(element and element.bad), element.good if element else 0, bool(element and element.heading)
                    row[:7] = [a + b for a, b in zip(row[:7], (1, bad, good > 0, good > 1, len(raw), link, head), strict=True)]
                    row[11] = element.parent.key if element and element.parent else ""
                # all that a page has there, in any order
                row[9] = row[10] = hashes[own[0]] if len(own) == 1 else hash(tuple(sorted(hashes[i] for i in own)))
                add((h, stream, k), row)
        if len(found) > 20_000:
            yield flush()
    yield flush()


def _fold(streams: list[tuple[str, int]]) -> str:
    """Most frequent streams first, so the wrapper begins with the common form."""
    ordered = [json.loads(s) for s, _ in sorted(streams, key=lambda x: (-x[1], len(x[0]), x[0]))]
    return json.dumps(infer(ordered), separators=(",", ":"))


def _fold_salted(table: pa.Table) -> pa.Table:
    streams = list(zip(table.column("stream").to_pylist(), table.column("n").to_pylist(), strict=True))
    return pa.table({"host": pa.array([table.column("host")[0].as_py()]), "stream": pa.array([_fold(streams)]), "n": pa.array([sum(n for _, n in streams)], pa.int64())})


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The place in its host's wrapper of each slot of a stream."""
    for batch in batches:
        rows: list[tuple] = []
        for h, stream, wrapper, slots in zip(*(batch.column(c).to_pylist() for c in ("host", "stream", "wrapper", "slots")), strict=True):
            places = parse(json.loads(wrapper), unrolled(json.loads(stream)))
            if places is not None:
                rows.extend((h, json.dumps(places[x["slot"]]), *(x[c] for c in _NAMES)) for x in slots)
        names = ["host", "place", *_NAMES]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.string(), *_KINDS], strict=True)], names=names)


def _summed(rows: DataFrame, *keys: str) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in (*_SUMS, "times")]
    # the CONSTANT least hashes of different pages tell whether there are so many
    few = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("pages")))), 1, CONSTANT)
    return rows.groupBy(*keys).agg(*sums, few.alias("pages"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("around").alias("around"))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, slots): a host's wrapper, and what its labels are made of, both as JSON."""
    found = stored(_summed(pages.mapInArrow(_streams, f"host string, stream string, slot int, {_STAT}"), "host", "stream", "slot"))
    folded = found.filter("slot < 0").select("host", "stream", F.col("times").alias("n"))
    for salts in SALTS:
        folded = folded.groupBy("host", F.pmod(F.xxhash64("stream"), F.lit(salts)).alias("salt")).applyInArrow(_fold_salted, "host string, stream string, n long")
    whole = stored(folded.groupBy("host").applyInArrow(_fold_salted, "host string, stream string, n long").select("host", F.col("stream").alias("wrapper")))
    slots = found.filter("slot >= 0").groupBy("host", "stream").agg(F.collect_list(F.struct("slot", *_NAMES)).alias("slots"))
    placed = _summed(slots.join(whole, "host").mapInArrow(_place, f"host string, place string, {_STAT}"), "host", "place")
    labels = placed.groupBy("host").agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.from_json("place", "array<int>").alias("place"), *_NAMES)))).alias("slots"))
    # stored, so that the join with the pages has two plain sides and a host with a third of all pages is split
    return stored(whole.join(labels, "host", "left"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, Wrapper] = {}
    for batch in batches:
        out = []
        for h, text, wrapper, slots in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "wrapper", "slots")), strict=True):
            if h not in known:
                if len(known) > 1000:
                    known.clear()
                known[h] = Wrapper(json.loads(wrapper or "[]"), json.loads(slots or "[]"))
            out.append(known[h].text(Page(text or "")))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    name = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/@]*@)?([^/:?#]*)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), name.alias("host"))
    return rows.join(wrappers(rows.select("host", "html")), "host", "left").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
