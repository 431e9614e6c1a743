"""HTML extraction (op 7): wrappers as union-free regular expressions, inferred from pages of the same host.

A page is a stream of tokens: opening tags of blocks, runs of text (a digest and lengths), closing tags. Pages of a host whose block
containers stand at the same paths are one template. The streams of all pages of a template are aligned, first those that a task meets,
then what the tasks found: what stands in step is aligned in turn, texts that differ become slots, what one stream lacks becomes
optional `?`, and a stretch between a tag and its closing that follows one of its like folds into a group `+`.

The wrapper decides what is text. Only slots count (and, where a template has no slot, all text); text in links counts against. From the
page down, an element is entered while it holds SHARE of the slot text; where that ends is the article's place. Pages take the element
at that place, but one that holds less there than in another element, and there a QUARTER of what the template's pages have
on average, is decided by itself, without the template's constant texts. Blocks of the article whose text stands alike in
all of CONSTANT pages or more are the template's and go.

Names only help where slots can't tell: <article> and <main> count double (and their constant texts count), elements named for another
purpose half. Inside the article's place elements that HTML itself has for another purpose go (navigation, forms, asides, headers,
footers), and of those named so by a word of class, id or role the ones that hold less than MAJOR of the place's slots.

Inline elements named so (a word of class, id or role) are parts of the wrapper too, for the slots to decide: one whose text stands alike in CONSTANT
pages or more goes, any other is text like what it stands in, and none is a place of its own.

Block elements and <br> end a block; white space inside a block becomes one space; blocks are joined by a space.

Defined results: null or empty html gives an empty text; null url is a host of its own; a page without tags is all text; very long and
very deep pages are handled whole, with stacks of their own and memory in proportion to the page; of places with as much slot text the
first in the page is taken; repeated rows give equal rows; an empty table gives no rows; extra columns aren't read.
"""

from __future__ import annotations

import bisect
import html as entities
import itertools
import json
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Parts of wrappers a task holds at a time before it hands them on; into how many parts a template's wrappers are dealt before the last ones meet.
HELD, SALTS = 100_000, 64
#: Share of slot text with which an element is entered; share of a template's usual text that moves a page's place; share with which a
#: named element stays; pages from which a constant block is the template's.
SHARE, QUARTER, MAJOR, CONSTANT = 0.6, 0.25, 0.67, 3
#: Templates, and bytes of what is known of them, up to which these are broadcast; beyond, they are joined by a shuffle.
BROADCAST_HOSTS, BROADCAST_BYTES = 100_000, 64 << 20

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*)>""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
SPACE = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements that HTML has for another purpose than text; header and footer stand for the page's own, or a section's.
OTHER = RAW | frozenset("nav footer header aside form button select option input head svg canvas iframe object audio video menu dialog".split())
#: Words of class, id or role that hint at such an element.
HINTS = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer header masthead menu modal nav navbar navigation newsletter notice notification pager pagination popup promo related share sharing sidebar social sponsor sponsored subscribe toolbar widget contentinfo complementary search".split())
#: An element that its own opening tag, or another of the set, ends.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Blocks that articles of one template have or lack as their authors please, so they tell no template.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote figure figcaption hr br table caption colgroup col thead tbody tfoot tr td th address".split())
#: Blocks that can't stand in a paragraph, so they end it.
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


#: What an element's names say: nothing, a hint at another purpose, or that HTML has it for another purpose.
NOTHING, HINT, PURPOSE = range(3)


class Node:
    __slots__ = ("key", "name", "says", "children")

    def __init__(self, key: str, name: str, says: int):
        self.key, self.name, self.says, self.children = key, name, says, []


def _node(name: str, attributes: str) -> Node:
    found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)} if "=" in attributes else {}
    words = [w for v in found.values() for w in re.split(r"[^a-z0-9]+", v.lower()) if w]
    # long numbers in classes are those of pages or posts
    key = name + "".join(f".{re.sub('[0-9]{3,}', '0', w)}" for w in found.get("class", "").split())
    hints = name not in ("html", "body", "main", "article") and not HINTS.isdisjoint(words)
    return Node(key, name, PURPOSE if name in OTHER else HINT if hints else NOTHING)


def parse(page: str) -> Node:
    """A lenient tree. Inline elements are nodes only where a name hints at another purpose (their says is NOTHING: slots decide); links are
    marked by (True, ...) strings, others leave only their text."""
    root = Node("#page", "#page", NOTHING)
    open_ = [root]
    hinted: list[list] = []  # inline nodes that are open: where in open_, name, how many plain elements of the name are open within
    links = 0
    at, end = 0, len(page)
    find = TAG.search

    def cut(to: int) -> None:
        del open_[to:]
        while hinted and hinted[-1][0] >= to:
            hinted.pop()

    while at < end:
        m = find(page, at)
        if m is None:
            open_[-1].children.append((links > 0, page[at:]))
            break
        if m.start() > at:
            open_[-1].children.append((links > 0, page[at : m.start()]))
        at = m.end()
        if m.group(2) is None:
            continue
        name = m.group(2).lower()
        if m.group(1):
            if name == "a":
                links = max(0, links - 1)
            if name in INLINE:
                own = next((h for h in reversed(hinted) if h[1] == name), None) if hinted else None
                if own and own[2]:
                    own[2] -= 1
                elif own:
                    cut(own[0])
            else:
                for k in range(len(open_) - 1, 0, -1):
                    if open_[k].name == name:
                        cut(k)
                        links = 0
                        break
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if name in INLINE:
            links += name == "a"
            node = _node(name, m.group(3)) if "=" in m.group(3) else None
            if name in VOID:
                continue
            if node is not None and node.says:
                node.says = NOTHING
                open_[-1].children.append(node)
                hinted.append([len(open_), name, 0])
                open_.append(node)
            elif hinted and (own := next((h for h in reversed(hinted) if h[1] == name), None)):
                own[2] += 1
            continue
        ends = CLOSES.get(name, set()) | ({"p"} if name in ENDS_P else set())
        while ends:
            k = len(open_) - 1
            while k and open_[k].name in INLINE:
                k -= 1
            if not k or open_[k].name not in ends:
                break
            cut(k)
        node = _node(name, m.group(3))
        open_[-1].children.append(node)
        if name not in VOID and not m.group(3).endswith("/"):
            open_.append(node)
            links = 0
    return root


def blocks(nodes: list[Node], goes=lambda node: False) -> list[str]:
    """Text of blocks in page order, without elements that go."""
    out, run = [], []

    def flush():
        text = SPACE.sub(" ", entities.unescape("".join(run))).strip()
        run.clear()
        if text:
            out.append(text)

    todo: list = list(reversed(nodes))
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, Node):
            inline = x.name in INLINE
            if not inline:
                flush()
            if not goes(x):
                if not inline:
                    todo.append(None)
                todo.extend(reversed(x.children))
        else:
            run.append(x[1])
    flush()
    return out


def unnested(step):
    """A function from a generator that yields its calls (of other such steps) and gets their results: it has a stack of its own, so depth has no limit."""

    def run(*args):
        stack, value = [step(*args)], None
        while stack:
            try:
                stack.append(stack[-1].send(value))
                value = None
            except StopIteration as end:
                stack.pop()
                value = end.value
        return value

    run.step = step
    return run


def template_of(root: Node) -> str:
    """A digest of the paths at which the page has containers; elements of other purpose and what prose holds don't count."""
    paths, todo = set(), [(root, 0)]
    while todo:
        node, at = todo.pop()
        at = zlib.crc32(f"{node.key}>".encode(), at)
        paths.add(at)
        todo.extend((c, at) for c in node.children if isinstance(c, Node) and not c.says and c.name not in PROSE and c.name not in INLINE)
    return f"{len(paths)}-{zlib.crc32(json.dumps(sorted(paths)).encode()):08x}"


def stream(root: Node) -> list[tuple]:
    """The page's tokens: (key, name, says) opens an element, None closes the last one, (digest, characters, characters in links, "#") is a run of text."""
    out: list = []
    size = link = digest = 0

    def close():
        nonlocal size, link, digest
        if size:
            out.append((digest, size, link, "#"))
        size = link = digest = 0

    todo: list = [root]
    while todo:
        x = todo.pop()
        if x is None:
            close()
            out.append(None)
        elif isinstance(x, Node):
            close()
            out.append((x.key, x.name, x.says))
            todo.append(None)
            todo.extend(reversed(x.children))
        elif t := x[1].strip():
            digest = zlib.crc32(t.encode(), digest)
            size += len(t)
            link += len(t) if x[0] else 0
    return out


class Part:
    """A piece of a wrapper: an element with its parts in order, or text (key '#'); how often it stands: 1, ?, + or *.

    digest: of the text that stands here alike in all pages; None for a slot.
    """

    __slots__ = ("key", "name", "says", "parts", "often", "digest", "size", "link")

    def __init__(self, key, name="", says=NOTHING, parts=None, digest=None, size=0, link=0):
        self.key, self.name, self.says, self.parts, self.often, self.digest, self.size, self.link = key, name, says, parts or [], "1", digest, size, link

    def __str__(self) -> str:
        out: list[str] = []
        todo: list = [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
                continue
            if x.often != "1":
                out.append("(")
                todo.append(f"){x.often}")
            if x.key == "#":
                out.append("#text" if x.digest is None else "text")
            else:
                out.append(f"<{x.key}>")
                todo.append("</>")
                todo.extend(reversed(x.parts))
        return "".join(out)


def wrapper_of(tokens: list[tuple]) -> Part:
    """The wrapper of one page: its stream with repeated stretches folded, each as its closing tag comes."""
    open_ = [Part("")]
    for x in tokens:
        if x is None:
            done = open_.pop()
            done.parts = fold(done.parts)
            open_[-1].parts.append(done)
        elif len(x) == 3:
            open_.append(Part(*x))
        else:
            open_[-1].parts.append(Part("#", digest=x[0], size=x[1], link=x[2]))
    return open_[0].parts[0]


def repeated(a: str, b: str) -> str:
    """How often something stands that stands so in two places."""
    many, none = "+" in a + b or "*" in a + b, "?" in a + b or "*" in a + b
    return "*" if many and none else "+" if many else "?" if none else "1"


@unnested
def folded(parts: list[Part]):
    """Neighbouring runs of equal keys, of one to four parts, become one run that repeats."""
    for width in (1, 2, 3, 4):
        if len(parts) < 2 * width:
            break
        out: list[Part] = []
        for p in parts:
            out.append(p)
            while len(out) >= 2 * width and all(out[-k].key == out[-k - width].key != "#" for k in range(1, width + 1)):
                later = [out.pop() for _ in range(width)][::-1]
                for k, q in enumerate(later):
                    out[k - width] = yield joined.step(out[k - width], q, False)
                    out[k - width].often = "*" if "*" in out[k - width].often + q.often or "?" in out[k - width].often + q.often else "+"
        parts = out
    return parts


def fold(parts: list[Part]) -> list[Part]:
    return parts if len(parts) < 2 else folded(parts)


def in_step(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Places of x and y that are aligned, ascending: what begins and ends alike, keys that stand once in both (the longest ascending run of them),
    and so on between these; stretches without such keys by their longest common subsequence. Memory is linear."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and x[a] == y[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and x[b - 1] == y[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        where: dict[str, list[int]] = {}
        for j in range(c, d):
            where.setdefault(y[j], []).append(j)
        own: dict[str, int] = {}
        for i in range(a, b):
            own[x[i]] = own.get(x[i], 0) + 1
        once = [(i, where[x[i]][0]) for i in range(a, b) if own[x[i]] == 1 and len(where.get(x[i], ())) == 1]
        tops, back, ends = [], {}, []  # the longest ascending run, by patience
        for i, j in once:
            k = bisect.bisect_left(tops, j)
            tops[k:k + 1], ends[k:k + 1] = [j], [i]
            back[i] = (j, ends[k - 1] if k else None)
        i, run = (ends[-1] if ends else None), []
        while i is not None:
            run.append((i, back[i][0]))
            i = back[i][1]
        if run:
            i, j = a, c
            for p, q in reversed(run):
                out.append((p, q))
                todo.append((i, p, j, q))
                i, j = p + 1, q + 1
            todo.append((i, b, j, d))
        else:
            out += [(a + i, c + j) for i, j in longest_common(x[a:b], y[c:d])]
    return sorted(out)


def common_lengths(x: list[str], y: list[str]) -> list[int]:
    """Of x and the first j of y, for each j, the length of the longest common subsequence; one number of len(y) bits is all that is kept."""
    full, rows = (1 << len(y)) - 1, dict.fromkeys(x, 0)
    for j, key in enumerate(y):
        if key in rows:
            rows[key] |= 1 << j
    open_ = full  # a bit is zero where the length goes up
    for key in x:
        hit = open_ & rows[key]
        open_ = ((open_ + hit) | (open_ - hit)) & full
    return [0, *itertools.accumulate(1 - (open_ >> j & 1) for j in range(len(y)))] if len(y) <= 64 else [0, *itertools.accumulate(c == "0" for c in reversed(f"{open_:0{len(y)}b}"))]


def longest_common(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence: x is halved, and y cut where the halves' lengths add up to most."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        if a == b or c == d:
            continue
        if b - a == 1:
            out += [(a, j) for j in [next((j for j in range(c, d) if y[j] == x[a]), None)] if j is not None]
            continue
        half = (a + b) // 2
        ahead, behind = common_lengths(x[a:half], y[c:d]), common_lengths(x[half:b][::-1], y[c:d][::-1])[::-1]
        cut = c + max(range(d - c + 1), key=lambda j: ahead[j] + behind[j])
        todo += [(a, half, c, cut), (half, b, cut, d)]
    return out


@unnested
def joined(a: Part, b: Part, pages: bool):
    """The least union-free expression for two parts of one key: of two pages (or sets of pages), or of one that follow each other."""
    if pages:
        digest = a.digest if a.digest == b.digest else None
    else:
        digest = zlib.crc32(b"%d" % b.digest, a.digest) if None not in (a.digest, b.digest) else None
    out = Part(a.key, a.name, a.says, digest=digest, size=a.size + b.size, link=a.link + b.link)
    out.often = repeated(a.often, b.often)
    x, y = a.parts, b.parts
    pairs = in_step([p.key for p in x], [p.key for p in y])
    i = j = 0
    for p, q in [*pairs, (len(x), len(y))]:
        for only in (x[i:p], y[j:q]):
            for part in only:
                part.often = repeated(part.often, "?")
            out.parts += only
        if p < len(x):
            out.parts.append((yield joined.step(x[p], y[q], pages)))
        i, j = p + 1, q + 1
    if len(out.parts) > 1 and len(out.parts) > len(pairs):  # else nothing new stands side by side
        out.parts = yield folded.step(out.parts)
    return out


def aligned(a: Part, b: Part) -> Part:
    return joined(a, b, True)


def infer(streams: list) -> Part:
    wrapper = wrapper_of(streams[0])
    for s in streams[1:]:
        wrapper = aligned(wrapper, wrapper_of(s))
    return wrapper


def dumped(part: Part) -> str:
    """A wrapper as JSON without nesting: its parts in page order, each with the number of its own."""
    rows, todo = [], [part]
    while todo:
        p = todo.pop()
        rows.append([p.key, p.name, p.says, p.often, p.digest, p.size, p.link, len(p.parts)])
        todo.extend(reversed(p.parts))
    return json.dumps(rows, separators=(",", ":"))


def loaded(rows: str) -> Part:
    open_: list[tuple[Part, int]] = []
    first = None
    for key, name, says, often, digest, size, link, n in json.loads(rows):
        part = Part(key, name, says, digest=digest, size=size, link=link)
        part.often = often
        first = first or part
        while open_ and len(open_[-1][0].parts) == open_[-1][1]:
            open_.pop()
        if open_:
            open_[-1][0].parts.append(part)
        open_.append((part, n))
    return first


class Place:
    """All parts of a wrapper at one path of keys. own: slot text right in them and in their prose; mass: and in all below."""

    __slots__ = ("key", "name", "says", "above", "below", "own", "mass", "fixed")

    def __init__(self, key: str, name: str, says: int, above):
        self.key, self.name, self.says, self.above, self.below, self.own, self.mass, self.fixed = key, name, says, above, [], 0, 0, 0

    def path(self) -> list[str]:
        out, place = [], self
        while place:
            out.append(place.key)
            place = place.above
        return out[::-1]

    def weight(self) -> float:
        """Mass as names would have it; what HTML has for another purpose, or within a line, is no place for an article."""
        return 0 if self.name in INLINE else max(self.mass, 0) * (2 if self.name in ("article", "main") else (1, 0.5, 0)[self.says])


def places(wrapper: Part, constant=frozenset()) -> list[Place]:
    """In page order, each after what it stands in. Constant texts count for nothing but in <article> and <main>, unless nothing else is there."""
    first = Place(wrapper.key, wrapper.name, wrapper.says, None)
    known, out, todo = {}, [first], [(wrapper, first, False)]
    while todo:
        part, place, named = todo.pop()
        below = []
        for p in part.parts:
            if p.key == "#":
                if p.digest is not None and p.digest in constant:
                    place.fixed += p.size
                    place.own += p.size if named and place.name not in INLINE else 0
                else:
                    place.own += p.size - 2 * p.link
            elif p.name in PROSE:
                below.append((p, place, named))
            else:
                at = known.get((id(place), p.key))
                if at is None:
                    at = known[id(place), p.key] = Place(p.key, p.name, p.says, place)
                    place.below.append(at)
                    out.append(at)
                below.append((p, at, named or p.name in ("article", "main")))
        todo.extend(reversed(below))
    for place in reversed(out):
        place.mass += place.own
        if place.above:
            place.above.mass += max(place.mass, 0)
            place.above.fixed += place.fixed
    return out if not constant or any(p.own > 0 and not p.says for p in out) else places(wrapper)


def article_path(wrapper: Part, constant=frozenset()) -> list[str]:
    """Keys from the page down to the element that holds the article."""
    place = places(wrapper, constant)[0]
    while place.below:
        best = max(place.below, key=Place.weight)
        if best.weight() <= 0 or best.weight() < SHARE * (max(place.own, 0) + sum(p.weight() for p in place.below)):
            break
        place = best
    return place.path()


def constants(wrapper: Part) -> list[int]:
    """Digests of the texts that stand alike in all pages of a wrapper."""
    out, todo = set(), [wrapper]
    while todo:
        part = todo.pop()
        if part.often in "1+":
            if part.key == "#" and part.digest is not None:
                out.add(part.digest)
            todo.extend(part.parts)
    return sorted(out)


def place_at(found: list[Place], path: list[str]) -> Place | None:
    place, at = found[0], {(id(p.above), p.key): p for p in found[1:]}
    for key in path[1:]:
        place = at.get((id(place), key))
        if place is None:
            return None
    return place


def leavings(found: list[Place], path: list[str], pages: int) -> list[list[str]]:
    """Paths of elements inside the article's place that aren't the article's: named for another purpose and minor, or the template's own."""
    top, out = place_at(found, path), []
    todo = list(top.below)
    while todo:
        p = todo.pop()
        minor = p.mass < MAJOR * max(top.mass, 1)
        if (p.says == HINT and minor) or (pages >= CONSTANT and p.mass <= 0 < p.fixed):
            out.append(p.path())
        else:
            todo.extend(p.below)
    return sorted(out)


def decide(wrapper: Part, pages: int) -> dict:
    """What a template's wrapper says: the path of the article, what it usually holds, what goes, and constant texts."""
    constant = constants(wrapper) if pages > 1 else []
    path, found = article_path(wrapper, frozenset(constant)), places(wrapper, frozenset(constant))
    return {"path": path, "usual": place_at(found, path).mass / pages, "goes": leavings(found, path, pages), "constant": constant}


def fits(own: list[Place], place: Place, usual: float) -> bool:
    """Whether no element beside the page's place holds more of its slot text, and as much as could be an article of the template."""
    on, p = set(), place
    while p:
        on.add(id(p))
        p = p.above
    inside = {id(place)}
    for p in own:
        if p.above and id(p.above) in inside:
            inside.add(id(p))
    beside = max((p.weight() for p in own if id(p) not in on and id(p) not in inside), default=0)
    return beside <= max(place.weight(), QUARTER * usual)


def at_path(nodes: list[Node], path: list[str]) -> list[Node]:
    """The nodes at the path below these, in page order; prose on the way isn't in paths."""
    for key in path:
        out, todo = [], [c for n in reversed(nodes) for c in reversed(n.children) if isinstance(c, Node)]
        while todo:
            n = todo.pop()
            if n.key == key and n.name not in PROSE:
                out.append(n)
            elif n.name in PROSE:
                todo.extend(c for c in reversed(n.children) if isinstance(c, Node))
        nodes = out
    return nodes


def extract(page: str, known: dict | None) -> str:
    root = parse(page)
    wrapper, constant = wrapper_of(stream(root)), frozenset(known["constant"] if known else ())
    own, found = places(wrapper, constant), []
    if known and (place := place_at(own, known["path"])) and fits(own, place, known["usual"]):
        path, goes = known["path"], known["goes"]
        found = at_path([root], path[1:])
    if not found:
        path = article_path(wrapper, constant)
        goes, found = leavings(own, path, 1), at_path([root], path[1:])
    gone = {id(n) for g in goes for n in at_path(found, g[len(path) :])}
    text = " ".join(blocks(found, lambda n: n.says == PURPOSE or id(n) in gone))
    # a place of nothing else has what it has
    return text or " ".join(blocks(found, lambda n: n.says == PURPOSE)) or " ".join(blocks([root], lambda n: n.says == PURPOSE))


def host(url="url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, template, pages, wrapper, known): the expression inferred from all pages of each host's template, and what decide() makes of it, as JSON."""
    schema = "host string, template string, pages long, wrapper string"

    def table_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int64(), pa.string()))], names=["host", "template", "pages", "wrapper"])

    def sketch(batches):
        held: dict[tuple[str, str], tuple[int, Part]] = {}
        parts = 0

        for batch in batches:
            for name, page in zip(batch.column(0), batch.column(1)):
                root = parse(page.as_py() or "")
                tokens = stream(root)
                key, own = (name.as_py(), template_of(root)), wrapper_of(tokens)
                n, before = held.get(key, (0, None))
                held[key] = (n + 1, aligned(before, own) if before else own)
                parts += len(tokens) if before is None else len(tokens) // 50  # wrappers grow by what their pages have for themselves
                if parts >= HELD:
                    yield table_of([(*k, n, dumped(w)) for k, (n, w) in held.items()])
                    held.clear()
                    parts = 0
        yield table_of([(*k, n, dumped(w)) for k, (n, w) in held.items()])

    def align(t):
        found, rows = None, sorted(zip(t.column("wrapper").to_pylist(), t.column("pages").to_pylist()))
        for text, _ in rows:
            found = aligned(found, loaded(text)) if found else loaded(text)
        return t.column("host")[0].as_py(), t.column("template")[0].as_py(), sum(n for _, n in rows), found

    def some(t):
        *key, found = align(t)
        return pa.Table.from_batches([table_of([(*key, dumped(found))])])

    def last(t):
        name, template, n, found = align(t)
        return pa.table({"host": [name], "template": [template], "pages": [n], "wrapper": [str(found)], "known": [json.dumps(decide(found, n))]})

    sketches = pages.select(host().alias("host"), "html").mapInArrow(sketch, schema)
    # a hot host's wrappers come from every task: they meet in SALTS parts before the last ones do
    salted = sketches.withColumn("salt", F.spark_partition_id() % SALTS).groupBy("host", "template", "salt").applyInArrow(some, schema)
    return salted.groupBy("host", "template").applyInArrow(last, "host string, template string, pages long, wrapper string, known string")


def extracted(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text, n_chars."""
    known = written(wrappers(pages), "wrappers").select("host", "template", "known")
    size = known.agg(F.count("*"), F.sum(F.octet_length("known"))).first()
    known = F.broadcast(known) if size[0] <= BROADCAST_HOSTS and (size[1] or 0) <= BROADCAST_BYTES else known

    def place(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([template_of(parse(h.as_py() or "")) for h in batch.column(2)], pa.string())], names=["page_id", "url", "html", "host", "template"])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [extract(h.as_py() or "", json.loads(k.as_py()) if k.as_py() else None) for h, k in zip(part.column(2), part.column(3))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", "html", host().alias("host"))
    rows = rows.mapInArrow(place, pages.select("page_id", "url", "html").schema.add("host", "string").add("template", "string")).join(known, ["host", "template"], "left").select("page_id", "url", "html", "known")
    return rows.mapInArrow(run, pages.select("page_id", "url").schema.add("text", "string").add("n_chars", "long"))


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages", "page_id", "url", "html"))
