"""Main text of web pages by wrappers: union-free regular expressions inferred from all pages of a layout of a host.

A page becomes a tree of elements and texts, in which runs of like elements are repeated groups. Its layout is the elements
that hold text in blocks, and its article or main element that holds most text, if any. The wrapper of a host's layout starts
as one page and is aligned with all others: texts that differ become slots, runs of like elements repeated groups, what only
one side has becomes optional. Groups of GROUP pages become one wrapper each, and those are aligned again until one is left,
so no task sees more than about GROUP of them. Equal pages count once, and no page is left out.

The wrapper's article is where the main text lies; without one, its element with the most text in blocks over all pages. If
that is no more than the page's body, texts that the wrapper has as constants there, from RECURS pages at least, are template
where they stand before or behind all other text.

Names of elements (class and id) say what isn't main text outside of the container; inside it only a whole name of a few
does, so a section called "related-work" or "notice" stays.

Pages stay in place: their trees, with long texts as digests, are shuffled, and pages meet their wrapper in a join of small rows.
"""

from __future__ import annotations

import html as entities
import marshal
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.llm.urls import host_of
from chunkloom.storage import staged

#: The container is at most so deep; texts further down count for the element there and are not lost.
MAX_DEPTH = 60
#: Cells of an alignment; of longer sequences like items at both ends are merged and all others are optional.
MAX_CELLS = 160_000
#: Optional items of one element; of more each run becomes one item for any, which stays optional. Neither the container nor constants depend on them.
MAX_OPTIONAL = 256
ANY = "*"
#: Pages or wrappers that are aligned in one task.
GROUP = 1024
#: Longer texts stand as digests in trees.
LONGEST = 32
#: Different pages that a template text is on at least.
RECURS = 3

#: Elements of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("nav aside footer form script style noscript template iframe svg math button select textarea input head title object canvas audio video dialog menu datalist label search".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
DROPPED_NAMES = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|notification|popup|modal|overlay|newsletter|subscri\w+|sidebar|side|rail|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|topbar|toolbar|comments?|commentlist|replies|reply|respond|disqus|discussion|related|recommend\w*|share|sharing|social|widget|login|signup|register|search|pagination|pager|skip\w*)(?:$|[\s_-])", re.I)
#: Whole names of what isn't main text even inside the container.
INNER_NAMES = frozenset("ad ads advert adverts advertisement adsense sponsored sponsor promo comments comment commentlist comment-list comments-section reader-comments disqus newsletter subscribe signup cookie-notice cookie-banner consent gdpr popup modal sidebar nav navbar navigation menu breadcrumb breadcrumbs pagination pager share sharing share-buttons social social-share related related-posts related-articles recommended toolbar login".split())
KEEPS_HEADER = ("article", "main")

NEVER = 1 << 30
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>|(<[a-zA-Z/][^<>]*$)", re.S)
_ATTR = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_QUOTED, _HIDDEN = re.compile(r"\"[^\"]*\"|'[^']*'"), re.compile(r"\shidden(?=[\s=/]|$)")


@dataclass
class Text:
    path: tuple[str, ...]  # keys of the elements around it, MAX_DEPTH at most
    text: str
    dropped: bool
    named: int  # depth of the first element whose name speaks against it; it counts outside of the container
    block: int  # texts of one block share it


def _key(tag: str, attrs: str) -> tuple[str, bool, bool]:
    """An element's name for alignment (tag, id and classes without digits), whether what it holds is never main text, and whether it isn't outside of the container."""
    a = {k.lower(): x or y or z for k, x, y, z in _ATTR.findall(attrs)} if "=" in attrs else {}
    names = f"{a.get('id', '')} {a.get('class', '')}".strip()
    key = tag + "".join(sorted({"." + n for n in re.sub(r"\d+", "", names).split()})) if names else tag
    own = tag in ("html", "body", "article", "main")
    dropped = tag in DROPPED or a.get("role", "").lower() in DROPPED_ROLES or bool(names) and tag not in ("html", "body") and not INNER_NAMES.isdisjoint(names.lower().split()) or bool("hidden" in attrs and _HIDDEN.search(_QUOTED.sub("", attrs))) or "none" in a.get("style", "") and bool(re.search(r"display\s*:\s*none", a["style"]))
    return key, dropped, bool(names and not own and DROPPED_NAMES.search(names))


def texts(page: str) -> list[Text]:
    """The page's texts in order. Ends that are missing are implied: a block ends an open p, an li the li before it."""
    out: list[Text] = []
    stack: list[tuple[str, str, bool, int]] = []  # tag, key, dropped, named
    open_tags: Counter = Counter()
    block, at, n = 0, 0, len(page)

    def say(raw: str) -> None:
        if raw and not raw.isspace():
            out.append(Text(tuple([x[1] for x in stack[:MAX_DEPTH]]), entities.unescape(raw), bool(stack) and stack[-1][2], stack[-1][3] if stack else NEVER, block))
        elif raw and out and out[-1].block == block:
            out[-1].text += " "

    def close(tag: str, within: frozenset[str] = frozenset()) -> None:
        if not open_tags[tag]:
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == tag:
                open_tags.subtract(x[0] for x in stack[i:])
                del stack[i:]
                return
            if stack[i][0] in within:
                return

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if (tag := m[2]) is None:
            continue
        tag = tag.lower()
        if tag in BLOCK:
            block += 1
        elif tag == "br" and out and out[-1].block == block:
            out[-1].text += " "
        if m[1]:
            close(tag)
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in BLOCK:
            close("p", frozenset({"td", "th", "body", "article", "section", "div", "li", "main", "blockquote"}))
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            close(tag, frozenset({"ul", "ol", "dl", "table", "select"} | ({"tr"} if tag in ("td", "th") else set())))
        if tag not in VOID and not m[3].endswith("/"):
            key, dropped, named = _key(tag, m[3])
            inside = any(open_tags[x] for x in KEEPS_HEADER) if tag == "header" else True
            above = stack[-1][2:] if stack else (False, NEVER)
            stack.append((tag, key, dropped or not inside or above[0], min(above[1], len(stack) if named else NEVER)))
            open_tags[tag] += 1
    return out


@dataclass
class Item:
    """An element (key, items) or a text (key "#"): how often it may occur, and what the pages had there."""

    key: str
    items: list[Item] = field(default_factory=list)
    value: str | None = None  # of a text; None: a slot
    optional: bool = False
    repeated: bool = False
    chars: int = 0
    pages: int = 1


def _fold(items: list[Item]) -> list[Item]:
    """Runs of like items become repeated groups."""
    out: list[Item] = []
    for x in items:
        if out and out[-1].key == x.key:
            out[-1] = _merged(out[-1], x, True)
        else:
            out.append(x)
    return out


def _merged(a: Item, b: Item, repeated: bool = False) -> Item:
    value = a.value if a.value == b.value else None
    return Item(a.key, align(a.items, b.items) if a.key != "#" else [], value, a.optional or b.optional, a.repeated or b.repeated or repeated, a.chars + b.chars, a.pages if repeated else a.pages + b.pages)


def _first(x: Item) -> str | None:
    """The first text of an item; None for a slot."""
    while x.key != "#" and x.items:
        x = x.items[0]
    return x.value


def _optional(x: Item) -> Item:
    return Item(x.key, x.items, x.value, True, x.repeated, x.chars, x.pages)


def _pooled(items: list[Item]) -> list[Item]:
    """At most MAX_OPTIONAL optional items stay by themselves; else each run of them is one item for any, in its place."""
    if sum(x.optional for x in items) <= MAX_OPTIONAL:
        return items
    out: list[Item] = []
    for optional, run in groupby(items, key=lambda x: x.optional):
        out += [Item(ANY, [Item("#", chars=sum(map(_chars, run)))], None, True, True)] if optional else run
    return out


def align(a: list[Item], b: list[Item]) -> list[Item]:
    """Both sequences as one: like items merged along their longest common order, of equally long ones one with more equal first texts; all others optional."""
    if [x.key for x in a] == [x.key for x in b]:
        return [_merged(x, y) for x, y in zip(a, b, strict=True)]
    n, m = len(a), len(b)
    out: list[Item] = []
    if n * m > MAX_CELLS:
        lo, hi = 0, 0
        while lo < min(n, m) and a[lo].key == b[lo].key:
            lo += 1
        while hi < min(n, m) - lo and a[n - 1 - hi].key == b[m - 1 - hi].key:
            hi += 1
        out = [_merged(x, y) for x, y in zip(a[:lo], b[:lo], strict=True)]
        out += map(_optional, (*a[lo : n - hi], *b[lo : m - hi]))
        out += [_merged(x, y) for x, y in zip(a[n - hi :], b[m - hi :], strict=True)]
    else:
        unit = n + m + 1  # so that no number of equal texts outweighs an item
        text = [_first(y) for y in b]
        best = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n - 1, -1, -1):
            key, first, row, below = a[i].key, _first(a[i]), best[i], best[i + 1]
            for j in range(m - 1, -1, -1):
                row[j] = max(below[j], row[j + 1], below[j + 1] + unit + (first is not None and first == text[j]) if key == b[j].key else 0)
        i = j = 0
        while i < n or j < m:
            if i < n and j < m and a[i].key == b[j].key and best[i][j] == best[i + 1][j + 1] + unit + ((f := _first(a[i])) is not None and f == text[j]):
                out.append(_merged(a[i], b[j]))
                i, j = i + 1, j + 1
            elif i < n and (j == m or best[i + 1][j] >= best[i][j + 1]):
                out.append(_optional(a[i]))
                i += 1
            else:
                out.append(_optional(b[j]))
                j += 1
    return _pooled(_fold(out))


def _signed(words: str) -> str:
    return words if len(words) <= LONGEST else "\0" + xxhash.xxh3_128_hexdigest(words.encode("utf-8", "surrogatepass"))


def tree(page_texts: list[Text], own: tuple[str, ...] | None = None) -> list[Item]:
    """The page's kept texts as items; elements are told apart by their keys' path. In the container `own` names of elements don't count."""
    root: list[Item] = []
    open_: list[Item] = []
    last: tuple[str, ...] = ()
    block = -1
    for t in page_texts:
        path = t.path
        if t.dropped or t.named != NEVER and not (own and path[: len(own)] == own):
            continue
        same = 0
        while same < min(len(path), len(last)) and path[same] == last[same]:
            same += 1
        if t.block != block and same == len(path) == len(last) and same:
            same -= 1
        del open_[same:]
        for key in path[same:]:
            x = Item(key)
            (open_[-1].items if open_ else root).append(x)
            open_.append(x)
        words = " ".join(t.text.split())
        (open_[-1].items if open_ else root).append(Item("#", value=_signed(words), chars=len(words)))
        last, block = path, t.block

    def fold(items: list[Item]) -> list[Item]:
        for x in items:
            x.items = fold(x.items)
        return _fold(items)

    return fold(root)


def show(items: list[Item]) -> str:
    """The wrapper as a regular expression over tags, constant texts and slots (#)."""
    out = []
    for x in items:
        body = ("#" if x.value is None else x.value) if x.key == "#" else f"<{x.key}>{show(x.items)}</>"
        out.append(f"({body})" + ("*" if x.repeated and x.optional else "+" if x.repeated else "?" if x.optional else "") if x.repeated or x.optional else body)
    return "".join(out)


@dataclass
class Wrapper:
    container: tuple[str, ...]
    constants: frozenset[str]
    expression: str


def _chars(x: Item) -> int:
    return x.chars if x.key == "#" else sum(map(_chars, x.items))


def candidates(items: list[Item]) -> list[tuple[int, tuple[str, ...], Item]]:
    """Characters in blocks, path and item of every element."""
    found: list[tuple[int, tuple[str, ...], Item]] = []
    near = lambda x: sum(_chars(y) if y.key == "#" or not any(z.key.split(".")[0] in BLOCK for z in y.items) else 0 for y in x.items)
    root = Item("", items)
    if n := near(root):  # a page without a body is one
        found.append((n, (), root))

    def walk(level: list[Item], path: tuple[str, ...]) -> None:
        for x in level:
            if x.key == "#":
                continue
            here = (*path, x.key)
            tag = x.key.split(".")[0]
            # texts right in it or in its blocks and inline elements
            found.append((near(x) if tag in BLOCK and tag not in ("p", "li", "ul", "ol", "html", "h1", "h2", "h3", "h4", "h5", "h6") else 0, here, x))
            walk(x.items, here)

    walk(items, ())
    return found


def own_container(page: list[Text]) -> tuple[str, ...] | None:
    """The article or main element with most of the page's text in such elements; of those inside each other the innermost that
    holds half of the one around it. Names count only above it, and not if nothing else is left."""
    for strict in (True, False):
        chars: Counter = Counter()
        for t in page:
            if not t.dropped:
                n = len(t.text)
                for i, key in enumerate(t.path):
                    if strict and t.named <= i:
                        break
                    if key.split(".")[0] in KEEPS_HEADER:
                        chars[t.path[: i + 1]] += n
        if chars:
            best = max((c for c in chars if not any(c[:i] in chars for i in range(1, len(c)))), key=lambda c: (chars[c], c))
            while inner := [c for c in chars if len(c) > len(best) and c[: len(best)] == best and 2 * chars[c] >= chars[best]]:
                best = max(inner, key=lambda c: (-len(c), chars[c], c))
            return best
    return None


@dataclass
class State:
    """Pages of one layout as one wrapper: their article's path, the characters in blocks of every element, and the aligned items."""

    own: tuple[str, ...] | None
    near: dict[tuple[str, ...], int]
    items: list[Item]

    def layout(self) -> int:
        return xxhash.xxh3_64_intdigest(repr((sorted(self.near), self.own)).encode("utf-8", "surrogatepass")) - (1 << 63)

    def dump(self) -> bytes:
        """Equal states give equal bytes (version 2 has no references)."""
        pack = lambda items: [(x.key, pack(x.items), x.value, x.optional, x.repeated, x.chars, x.pages) for x in items]
        return marshal.dumps((self.own, sorted(self.near.items()), pack(self.items)), 2)

    @staticmethod
    def load(raw: bytes) -> State:
        unpack = lambda items: [Item(k, unpack(i), *rest) for k, i, *rest in items]
        own, near, items = marshal.loads(raw)
        return State(own, dict(near), unpack(items))

    def add(self, other: State) -> None:
        for path, n in other.near.items():
            self.near[path] = self.near.get(path, 0) + n
        self.items = align(self.items, other.items)


def state_of(page: list[Text]) -> State | None:
    """A page as the wrapper of itself; None without text."""
    own = own_container(page)
    items = tree(page, own)
    near: dict[tuple[str, ...], int] = {}
    for n, path, _ in candidates(items):
        if n:
            near[path] = near.get(path, 0) + n
    return State(own, near, items) if items else None


def wrapper_of(state: State) -> Wrapper:
    """The article, or else the element with the most characters (of equal ones the less deep, then the greater path; the whole page
    if none has any), and the texts that stand in it on all pages, RECURS at least, outside of repeated groups."""
    container = state.own
    if container is None:
        container = max(state.near, key=lambda p: (state.near[p], -len(p), p), default=())
    constants: set[str] = set()

    def fixed(level: list[Item], path: tuple[str, ...]) -> None:
        for x in level:
            if x.optional or x.repeated:
                continue
            if x.key == "#":
                if not path and x.value and x.pages >= RECURS:
                    constants.add(x.value)
            elif not path or x.key == path[0]:
                fixed(x.items, path[1:])

    fixed(state.items, container)
    return Wrapper(container, frozenset(constants), show(state.items))


def infer(pages: list[list[Text]]) -> Wrapper | None:
    """The wrapper of pages of one layout; None if they hold no text."""
    whole: State | None = None
    for p in pages:
        if x := state_of(p):
            if whole is None:
                whole = x
            else:
                whole.add(x)
    return wrapper_of(whole) if whole else None


def _picked(every: list[Text], container: tuple[str, ...], constants: frozenset[str]) -> str:
    """Blocks of the container in page order, joined by a line feed."""
    inside = [t for t in every if not t.dropped and t.path[: len(container)] == container]
    kept = [t for t in inside if (t.named >= len(container) if container else t.named == NEVER)] or inside
    blocks: list[str] = []
    last = None
    for t in kept:
        if t.block == last:
            blocks[-1] += t.text
        else:
            blocks.append(t.text)
        last = t.block
    lines = [x for b in blocks if (x := " ".join(b.split()))]
    if constants and (not container or container[-1].split(".")[0] in ("html", "body")):  # the frame of a page without an element of its own for the text
        own = [i for i, x in enumerate(lines) if _signed(x) not in constants]
        lines = lines[own[0] : own[-1] + 1] if own else lines
    return "\n".join(lines)


def main_text(page: str | None, wrapper: Wrapper | None = None) -> str:
    """The page's text by its layout's wrapper; without one the page is its own."""
    every = texts(page or "")
    w = wrapper or infer([every])
    return _picked(every, w.container if w else (), w.constants if w else frozenset())


def _host() -> Column:
    return F.coalesce(host_of(F.col("url")), F.lit("")).alias("host")


def _fold_states(rows: DataFrame) -> DataFrame:
    """host, layout, content, state of the wrapper of every host, layout and part, aligned by content."""
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first, whole = None, 0, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*at[:2], first, whole.dump()), kinds, strict=True)], names=["host", "layout", "content", "state"])

        for b in batches:
            for *key, content, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = State.load(raw)
                if key == at:
                    whole.add(x)
                    continue
                if at:
                    yield done()
                at, first, whole = key, content, x
        if at:
            yield done()

    dealt = rows.select("host", "layout", "part", "content", "state").repartition("host", "layout", "part").sortWithinPartitions("host", "layout", "part", "content")
    return dealt.mapInArrow(run, "host string, layout long, content long, state binary")


def wrappers(pages: DataFrame) -> DataFrame:
    """host, layout, container, constants, expression of every layout of a host, from all its pages. Equal pages count once; pages
    without text give no rows, nor does an empty table. Ties go to the less deep path, then to the greater one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                out: dict[tuple, tuple] = {}
                for host, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if w := state_of(every := texts(x or "")):
                        raw = w.dump()
                        said = "\0".join(t.text for t in every if not t.dropped)  # runs of like elements have lost their texts in the state
                        row = (host, w.layout(), xxhash.xxh3_64_intdigest(raw + said.encode("utf-8", "surrogatepass")) - (1 << 63))
                        out[row] = (*row, raw)
                cols = list(zip(*out.values(), strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["host", "layout", "content", "state"])

    said = pages.select(_host(), "html").mapInArrow(run, "host string, layout long, content long, state binary")
    level = staged(said.dropDuplicates(["host", "layout", "content"]), "html-evidence")
    while True:
        parts = level.groupBy("host", "layout").agg(F.ceil(F.count("*") / GROUP).alias("parts"))
        most = parts.agg(F.max("parts")).first()[0] or 0
        level = staged(_fold_states(level.join(parts, ["host", "layout"]).withColumn("part", F.pmod("content", "parts"))), "html-wrappers")
        if most <= 1:
            break

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string())
        for b in batches:
            out = [(host, layout, list(w.container), sorted(w.constants), w.expression) for host, layout, raw in zip(*(c.to_pylist() for c in b.columns), strict=True) if (w := wrapper_of(State.load(raw)))]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(list(zip(*out, strict=True)) or [()] * 5, kinds, strict=True)], names=["host", "layout", "container", "constants", "expression"])

    return staged(level.select("host", "layout", "state").mapInArrow(finish, "host string, layout long, container array<string>, constants array<string>, expression string"), "html-wrappers")


_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row, by the wrapper of its host's layout.

    Null and empty pages, and pages without main text, have empty text. Null URLs and those without :// are one host.
    Repeated rows stay, null ids too; other columns are not read. White space includes no-break spaces. An empty table
    gives no rows.
    """
    rows = pages.select("page_id", "url", "html", _host())
    middle = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("layout", pa.int64()), ("said", pa.binary())])

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every page's texts that may be main text, and its layout."""
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                got = []
                for x in part.column(2).to_pylist():
                    every = [t for t in texts(x or "") if not t.dropped]
                    w = state_of(every)
                    got.append((w.layout() if w else None, marshal.dumps([(t.path, t.text, t.named, t.block) for t in every])))
                cols = list(zip(*got, strict=True)) or [()] * 2
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1), part.column(3), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary())], schema=middle)

    met = rows.mapInArrow(parsed, "page_id long, url string, host string, layout long, said binary").join(wrappers(pages.select("url", "html")).drop("expression"), ["host", "layout"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                got = [_picked([Text(p, x, False, n, k) for p, x, n, k in marshal.loads(raw)], tuple(c or ()), frozenset(k or ())) for raw, c, k in zip(*(part.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(got, pa.string()), pa.array([len(g) for g in got], pa.int64())], schema=_OUT)

    return met.select("page_id", "url", "said", "container", "constants").mapInArrow(run, "page_id long, url string, text string, n_chars long")
