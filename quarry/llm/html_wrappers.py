"""HTML main text by union-free regular-expression inference.

Pages of one host come from one template.  A page's token stream is read into
nested items: block elements, and one text slot for each run of text between
them (inline elements only shape a text).  Equal neighbours, single or as
groups, fold into one repeated item, and the page is then a union-free
expression: tags, text slots, repeated and optional groups.  Pages of one shape
are merged place by place.  The shapes of a host are then aligned one after
another, in an order that depends on nothing but the shapes: items in common
order are merged, an item only one side has becomes optional, a text that
differs becomes a variable slot.  The result is the host's wrapper.

Its slots are judged once per host.  The content root is the article, else the
main element, else an element named as content: what such an element holds is
the author's, and nothing equal on all pages is taken from it.  On a host
without one, the root is the element whose variable slots hold most text, and
texts in it that ``TEMPLATE_SHARE`` of the host's pages, and ``TEMPLATE_PAGES`` at
least, hold in one place of the wrapper are the template's where they stand
before the first or after the last of a page's other texts; between them they
stay, as a heading that all pages share.  A host without variable slots tells
nothing of a template.  Menus, headers outside of the article, footers,
sidebars, notices, adverts, forms and comments are left out by element, role or
name; a name counts if all its parts are such names or plain words of layout.
Each page is then read through its host's wrapper.

Tasks merge the pages of one host and shape they read before anything is
shuffled, and shapes of a host are aligned in ``SALTS`` groups first, so a host
with a third of all pages is no larger than others after the scan.  Places of
texts are counted over all pages with partial sums.  Wrappers are broadcast
while they take less than ``BROADCAST_BYTES``; beyond, pages are joined to them
in salted hash partitions.

Defined cases: null and empty pages give an empty text; pages with a null url
share one wrapper; text without markup is one block; an unclosed comment or
script runs to the end; a quote opens an attribute value only after ``=``;
repeated rows give equal results; an empty table gives an empty result.  Other
columns are not read.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

BROADCAST_BYTES = 64 << 20
SALTS = 16
#: Entries a task holds before it hands them on; they are merged again after the shuffle.
HELD = 4000
PERIODS = (2, 3, 4)
DEEP = 100
#: A text may be the template's if at least this share of a host's pages with content holds it in one place, and at least so many pages.
TEMPLATE_SHARE = 0.9
TEMPLATE_PAGES = 2

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title svg iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

LEFT_OUT_TAGS = frozenset("nav footer aside form button dialog select menu search head".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())
LEFT_OUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline-share comment comments commentlist consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notification popup promo promoted recommend recommended related replies respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toc toolbar widget widgets".split()
)
#: Words of layout, which say nothing themselves.
LAYOUT_NAMES = frozenset(
    "0 area bar block bottom box btn button buttons center col column container footer form global group head holder icons inner item items layer left link links list main message mobile msg outer page pane panel post posts primary right row secondary section site slot small sticky text top unit view wrap wrapper zone".split()
)
CONTENT_NAMES = frozenset("article articlebody content entry post story".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>|<[!?][^>]*>", re.S)
_NAMES = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_CUT = re.compile(r"[-_\s:]+|(?<=[a-z])(?=[A-Z])")


def host_of(url: str | None) -> str:
    found = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return found[1].lower() if found else ""


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """("+", tag, label), ("-", tag, ""), ("#", "", text): elements opened and closed, void and raw ones never opened."""
    at, end, raw = 0, len(page), None
    last = page.rfind(">") + 1  # no tag ends beyond
    low = None
    while at < end:
        if raw:
            low = low if low is not None else page.lower()
            stop = low.find(f"</{raw}", at)
            at, raw = (end, None) if stop < 0 else (stop, None)
            close = page.find(">", at)
            at = end if close < 0 else close + 1
            continue
        token = _TOKEN.search(page, at, last) if at < last else None
        if not token:
            cut = page.find("<!--", at)
            if page[at : end if cut < 0 else cut]:
                yield "#", "", page[at : end if cut < 0 else cut]
            return
        if token.start() > at:
            yield "#", "", page[at : token.start()]
        at = token.end()
        if token[0].startswith("<!--") and not token[0].endswith("-->"):
            return
        if token[2]:
            tag = token[2].lower()
            if token[1]:
                yield "-", tag, ""
            elif tag in RAW:
                raw = None if token[3].endswith("/") and tag == "svg" else tag
            else:
                yield "+", tag, _label(tag, token[3])


def _label(tag: str, attributes: str) -> str:
    """The tag with its classes and roles; parts with digits are one, and an id counts only if it is a known name."""
    if "=" not in attributes:
        return tag
    names = set()
    for key, *values in _NAMES.findall(attributes):
        value = re.sub(r"[A-Za-z]*\d[A-Za-z\d]*", "0", next((v for v in values if v), ""))
        for v in value.split():
            if key.lower() == "role":
                names.add("@" + v)
            elif key.lower() == "class" or _named_out(v) or CONTENT_NAMES & {v.lower(), *(w.lower() for w in _CUT.split(v))}:
                names.add("." + v)
    return tag + "".join(sorted(names))


def _named_out(name: str) -> bool:
    """Whether a class or id names something left out: itself, or all its parts with plain words of layout."""
    if name.lower() in LEFT_OUT_NAMES:
        return True
    parts = {w.lower() for w in _CUT.split(name) if w}
    return bool(parts & LEFT_OUT_NAMES) and parts <= LEFT_OUT_NAMES | LAYOUT_NAMES


def left_out(label: str, inside: bool = False) -> bool:
    """Whether an element holds no content; ``inside`` an article or main element a header is its own."""
    tag, *names = re.split(r"(?=[.@])", label)
    if tag in LEFT_OUT_TAGS or (tag == "header" and not inside):
        return True
    for name in names:
        if name[0] == "@":
            if name[1:].lower() in LEFT_OUT_ROLES:
                return True
        elif tag in ("body", "html", "article", "main"):
            if name[1:].lower() in LEFT_OUT_NAMES:
                return True
        elif _named_out(name[1:]) and not (inside and tag == "header"):
            return True
    return False


class Reader:
    """Open elements of a page, with the ends HTML lets authors leave out."""

    def __init__(self):
        self.tags: list[str] = []

    def opened(self, tag: str) -> int:
        """How many open elements end where this one starts."""
        if tag in ENDS:
            for n, open_tag in enumerate(reversed(self.tags), 1):
                if open_tag in ENDS[tag]:
                    return n
                if open_tag in SCOPE[tag]:
                    break
        if tag in BLOCK:
            for n, open_tag in enumerate(reversed(self.tags), 1):
                if open_tag == "p":
                    return n
                if open_tag in BLOCK:
                    break
        return 0

    def closed(self, tag: str) -> int:
        """How many open elements this end tag ends."""
        for n, open_tag in enumerate(reversed(self.tags), 1):
            if open_tag == tag:
                return n
            if tag not in BLOCK and open_tag in BLOCK:
                break
        return 0


# An item is [label, optional, repeated, children]; a text slot is ["#", optional, repeated, text hash or 0 if variable, characters];
# a repeated group is ["()", optional, 1, items].


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 1 | 1


def _tidy(parts: list[str]) -> str:
    return " ".join(html.unescape("".join(parts)).split())


def walked(page: str) -> Iterator[tuple[str, str, str]]:
    """("+", label, tag), ("-", "", "") and ("#", text, ""): block elements opened and closed and the texts between them, in order.

    Inline elements only shape a text; what stands in one that is left out is skipped.  Blocks below ``DEEP`` open ones
    still end texts, but are no elements of their own.
    """
    reader, shown, held = Reader(), [], []
    skipped = depth = 0

    def text() -> Iterator[tuple[str, str, str]]:
        if held:
            whole = _tidy(held)
            held.clear()
            if whole:
                yield "#", whole, ""

    def leave(n: int) -> Iterator[tuple[str, str, str]]:
        nonlocal skipped, depth
        for _ in range(n):
            reader.tags.pop()
            was = shown.pop()
            skipped -= was == "out"
            if was in ("item", "deep"):
                yield from text()
            if was == "item":
                depth -= 1
                yield "-", "", ""

    for kind, tag, value in events(page):
        if kind == "#":
            if not skipped:
                held.append(value)
        elif kind == "+":
            yield from leave(reader.opened(tag))
            what = "" if tag not in BLOCK or skipped else "item" if depth < DEEP else "deep"
            if what != "item" and left_out(value, True) and tag not in VOID:
                what = "out"
            if what in ("item", "deep"):
                yield from text()
            elif tag == "br" and not skipped:
                held.append(" ")
            if what == "item":
                yield "+", value, tag
            if tag in VOID:
                if what == "item":
                    yield "-", "", ""
            else:
                reader.tags.append(tag)
                shown.append(what)
                skipped += what == "out"
                depth += what == "item"
        else:
            yield from leave(reader.closed(tag))
    yield from leave(len(reader.tags))
    yield from text()


def expression(page: str) -> list:
    """A page as a union-free expression."""
    root: list = ["", 0, 0, []]
    stack = [root]
    for kind, value, tag in walked(page):
        if kind == "#":
            stack[-1][3].append(["#", 0, 0, _hash(value), len(value)])
        elif kind == "+":
            item = [value, 0, 0, []]
            stack[-1][3].append(item)
            stack.append(item)
        else:
            item = stack.pop()
            item[3] = fold(item[3])
    root[3] = fold(root[3])
    return root


def shape(item: list) -> str:
    """An expression without its texts; pages of one shape merge place by place, in any order."""
    if item[0] == "#":
        return f"#{item[1]}{item[2]}"
    return f"{item[0]}{item[1]}{item[2]}({','.join(map(shape, item[3]))})"


def fold(items: list, along: bool = True) -> list:
    """Equal neighbours, and groups of up to four items that repeat, become one repeated item; ``along``: all are of one page."""
    out: list = []
    for item in items:
        if out and out[-1][0] == item[0]:
            out[-1] = merge(out[-1], item, along)
            out[-1][2] = 1
        else:
            out.append(item)
    for period in PERIODS:
        at, folded = 0, []
        while at < len(out):
            group = [x[0] for x in out[at : at + period]]
            times = 1
            while len(group) == period and [x[0] for x in out[at + times * period : at + (times + 1) * period]] == group:
                times += 1
            if times > 1:
                body = out[at : at + period]
                for t in range(1, times):
                    body = [merge(a, b, along) for a, b in zip(body, out[at + t * period : at + (t + 1) * period])]
                folded.append(["()", 0, 1, body])
                at += times * period
            else:
                folded.append(out[at])
                at += 1
        out = folded
    return out


def merge(a: list, b: list, along: bool = False) -> list:
    """The least expression of this kind that covers two items of one label.

    Texts that differ are variable; those of one page (``along``) are a list, which other pages may hold as well.
    """
    optional, repeated = a[1] | b[1], a[2] | b[2]
    if a[0] == "#":
        several = _hash(f"{a[3]} {b[3]}") if along and a[3] and b[3] else 0
        return ["#", optional, repeated, a[3] if a[3] == b[3] and not along else several, a[4] + b[4]]
    return [a[0], optional, repeated, align(a[3], b[3], along)]


def align(a: list, b: list, along: bool = False) -> list:
    """Merge two sequences: common items in order, the others optional."""
    if [x[0] for x in a] == [x[0] for x in b]:
        return [merge(x, y, along) for x, y in zip(a, b)]
    out: list = []
    i = j = 0
    for p, q in common([v[0] for v in a], [v[0] for v in b]):
        out += [[v[0], 1, *v[2:]] for v in a[i:p]] + [[v[0], 1, *v[2:]] for v in b[j:q]]
        out.append(merge(a[p], b[q], along))
        i, j = p + 1, q + 1
    out += [[v[0], 1, *v[2:]] for v in a[i:]] + [[v[0], 1, *v[2:]] for v in b[j:]]
    # Optional neighbours of one label are one repeated item.
    return fold(out, along)


def _lengths(a: list[str], b: list[str]) -> list[int]:
    """Lengths of the longest common subsequences of ``a`` with every prefix of ``b``, a row of bits at a time."""
    where: dict[str, int] = {}
    for j, label in enumerate(b):
        where[label] = where.get(label, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for label in a:
        hit = row & where.get(label, 0)
        row = ((row + hit) | (row - hit)) & full
    out, n = [0], 0
    for bit in reversed(f"{row:0{len(b)}b}" if b else ""):
        n += bit == "0"
        out.append(n)
    return out


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence as pairs of places, by halving one side: exact at any length, in linear space."""
    lead = 0
    while lead < min(len(a), len(b)) and a[lead] == b[lead]:
        lead += 1
    tail = 0
    while tail < min(len(a), len(b)) - lead and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = [(i, i) for i in range(lead)]
    todo = [(lead, len(a) - tail, lead, len(b) - tail)]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 == a1 or b0 == b1:
            continue
        if a1 - a0 == 1:
            if a[a0] in b[b0:b1]:
                out.append((a0, b.index(a[a0], b0, b1)))
            continue
        mid = (a0 + a1) // 2
        there = _lengths(a[a0:mid], b[b0:b1])
        back = _lengths(a[mid:a1][::-1], b[b0:b1][::-1])[::-1]
        cut = max(range(len(there)), key=lambda k: there[k] + back[k])
        todo += [(mid, a1, b0 + cut, b1), (a0, mid, b0, b0 + cut)]
    return sorted(out) + [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]


class Slots:
    """A wrapper's elements by path, each with whether its text is content and which texts there are the template's."""

    __slots__ = ("content", "fixed", "inside", "kids", "label", "out", "path", "weight")

    def __init__(self, label: str, out: bool, path: int, inside: bool):
        self.label, self.out, self.kids, self.content, self.weight = label, out, {}, False, 0
        self.path, self.inside, self.fixed = path, inside, frozenset()

    def kid(self, label: str) -> Slots:
        kid = self.kids.get(label)
        if kid is None:
            inside = self.inside or re.split(r"[.@]", label)[0] in ("article", "main") or "@main" in label
            kid = self.kids[label] = Slots(label, self.out or left_out(label, inside), path_of(self.path, label), inside)
        return kid

    def take(self, items: list) -> None:
        for item in items:
            if item[0] == "#":
                if not item[3]:
                    self.weight += item[4]
            elif item[0] == "()":
                self.take(item[3])
            else:
                self.kid(item[0]).take(item[3])

    def every(self) -> Iterator[Slots]:
        todo = [self]
        while todo:
            here = todo.pop()
            yield here
            todo += reversed(here.kids.values())


def path_of(above: int, label: str) -> int:
    return _hash(f"{above}/{label}")


def compiled(wrapper: list, template: dict[int, frozenset[int]] | None = None) -> Slots:
    """Elements of a wrapper with their judgement; ``template``: the texts of (nearly) all pages by path."""
    root = Slots("", False, 0, False)
    root.take(wrapper[3])
    usable = [s for s in root.every() if not s.out]
    tag = lambda s: re.split(r"[.@]", s.label)[0]
    named = lambda s: CONTENT_NAMES & {w.lower() for n in re.split(r"[.@]", s.label)[1:] for w in (n, *_CUT.split(n))}
    roots = [s for s in usable if tag(s) == "article"]
    roots = roots or [s for s in usable if tag(s) == "main" or "@main" in s.label]
    roots = roots or [s for s in usable if tag(s) in ("div", "section", "td") and named(s)]
    told = not roots
    if told:
        gain = lambda s: s.weight + sum(k.weight for k in s.kids.values() if not k.out and tag(k) not in ("div", "section", "td", "body"))
        best = max(usable, key=gain)
        # Without a variable text the pages tell nothing of the template.
        roots = [best if gain(best) else root]
    todo = list(roots)
    while todo:
        s = todo.pop()
        if not s.out:
            s.content = True
            todo += s.kids.values()
    if told and any(s.weight for s in root.every() if s.content):
        for s in root.every():
            s.fixed = (template or {}).get(s.path, frozenset())
    return root


def main_text(page: str | None, wrapper: Slots) -> str:
    """Content of a page read through its host's wrapper: blocks joined by line ends, the template's around them left out."""
    blocks: list[tuple[str, bool]] = []
    stack: list[Slots | None] = [wrapper]
    for kind, value, _ in walked(page or ""):
        here = stack[-1]
        if kind == "#":
            if here is not None and here.content:
                blocks.append((value, bool(here.fixed) and _hash(value) in here.fixed))
        elif kind == "+":
            stack.append(here.kids.get(value) if here is not None else None)
        else:
            stack.pop()
    own = [n for n, (_, fixed) in enumerate(blocks) if not fixed]
    return "\n".join(text for text, _ in blocks[own[0] : own[-1] + 1]) if own else ""


SEEN = "host string, salt int, shape string, wrapper string, path bigint, text bigint, pages bigint"


def _observed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's pages: one expression per host and shape, and on how many pages each text stands in each place."""
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), *[pa.int64()] * 3]
    names = ["host", "salt", "shape", "wrapper", "path", "text", "pages"]
    shapes: dict[tuple[str, str], list] = {}
    places: dict[tuple[str, int, int], int] = {}

    def rows(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], kinds[k]) for k in range(7)], names)

    def shape_rows() -> pa.RecordBatch:
        out = [(host, _hash(s) % SALTS, s, json.dumps(w, separators=(",", ":"), ensure_ascii=False), None, None, n) for (host, s), (w, n) in shapes.items()]
        shapes.clear()
        return rows(out)

    def place_rows() -> pa.RecordBatch:
        out = [(host, None, None, None, path, text, n) for (host, path, text), n in places.items()]
        places.clear()
        return rows(out)

    for batch in batches:
        for url, cell in zip(batch.column(0), batch.column(1)):
            host, page = host_of(url.as_py()), cell.as_py() or ""
            own = expression(page)
            key, some = (host, shape(own)), int(bool(own[3]))
            shapes[key] = [merge(shapes[key][0], own), shapes[key][1] + some] if key in shapes else [own, some]
            path, seen = [0], set()
            for kind, value, _ in walked(page):
                if kind == "#":
                    seen.add((host, path[-1], _hash(value)))
                elif kind == "+":
                    path.append(path_of(path[-1], value))
                else:
                    path.pop()
            for place in seen:
                places[place] = places.get(place, 0) + 1
            if len(shapes) >= HELD:
                yield shape_rows()
            if len(places) >= 16 * HELD:
                yield place_rows()
    if shapes:
        yield shape_rows()
    if places:
        yield place_rows()


def _merged(table: pa.Table) -> pa.Table:
    """Wrappers of one host, or of one group of its shapes, aligned in the order of their shapes; equal shapes first."""
    by: dict[str, list] = {}
    for key, text, n in zip(*[table.column(c).to_pylist() for c in ("shape", "wrapper", "pages")]):
        w = json.loads(text)
        by[key] = [merge(by[key][0], w), by[key][1] + n] if key in by else [w, n]
    keys = sorted(by)
    whole, pages = by[keys[0]]
    for key in keys[1:]:
        whole, pages = merge(whole, by[key][0]), pages + by[key][1]
    salt = table.column("salt")[0].as_py()
    columns = [pa.array([table.column("host")[0].as_py()]), pa.array([salt], pa.int32()), pa.array([f"{salt:04d}"]), pa.array([json.dumps(whole, separators=(",", ":"), ensure_ascii=False)]), pa.array([pages], pa.int64())]
    return pa.table(columns, ["host", "salt", "shape", "wrapper", "pages"])


def infer(pages: DataFrame, url_col: str = "url", html_col: str = "html", folder: str | None = None) -> DataFrame:
    """host, wrapper (an expression as JSON), pages (those with content), template (path, text hash of what nearly all pages hold): one row per host."""
    spark = pages.sparkSession
    shared.attach(spark)
    rows = pages.select(F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    seen = shared.stored(rows.mapInArrow(_observed, SEEN), folder or shared.shared_folder(spark), "observed")
    schema = "host string, salt int, shape string, wrapper string, pages bigint"
    parts = seen.where("wrapper IS NOT NULL").select("host", "salt", "shape", "wrapper", "pages")
    whole = parts.groupBy("host", "salt").applyInArrow(_merged, schema).groupBy("host").applyInArrow(_merged, schema).select("host", "wrapper", "pages")
    places = seen.where("path IS NOT NULL").groupBy("host", "path", "text").agg(F.sum("pages").alias("n")).where(F.col("n") >= TEMPLATE_PAGES)
    fixed = places.join(whole.select("host", F.col("pages").alias("of")), "host").where(F.col("n") >= TEMPLATE_SHARE * F.col("of"))
    # A host has no more of these than texts on one page.
    fixed = fixed.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("path", "text"))).alias("template"))
    return whole.join(fixed, "host", "left")


def _ready(wrapper: str, template: list | None) -> Slots:
    by: dict[int, set[int]] = {}
    for place in template or ():
        by.setdefault(place["path"], set()).add(place["text"])
    return compiled(json.loads(wrapper), {k: frozenset(v) for k, v in by.items()})


def _extracted(batches: Iterator[pa.RecordBatch], wrappers) -> Iterator[pa.RecordBatch]:
    ready: dict[str, Slots] = {}
    for batch in batches:
        texts = []
        joined = batch.num_columns > 3
        for i in range(batch.num_rows):
            host = host_of(batch.column(1)[i].as_py())
            if host not in ready:
                if len(ready) >= HELD:
                    ready.clear()
                ready[host] = _ready(batch.column(3)[i].as_py(), batch.column(4)[i].as_py()) if joined else _ready(*wrappers.value[host])
            texts.append(main_text(batch.column(2)[i].as_py(), ready[host]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, text, n_chars: one row per row of ``pages``."""
    spark = pages.sparkSession
    shared.attach(spark)
    folder = shared.shared_folder(spark)
    wrappers = shared.stored(infer(pages, url_col, html_col, folder), folder, "wrappers")
    shared.dropped(spark, f"{folder}/observed")
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    schema = T.StructType([rows.schema.fields[0], T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    size = wrappers.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host") + 64 * F.coalesce(F.size("template"), F.lit(0)))).first()[0] or 0
    if size <= broadcast_bytes:
        held = spark.sparkContext.broadcast({r["host"]: (r["wrapper"], [x.asDict() for x in r["template"] or ()]) for r in wrappers.collect()})
        return rows.mapInArrow(partial(_extracted, wrappers=held), schema)
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    salted = rows.withColumn("host", host).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    copies = wrappers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, ["host", "salt"]).select("page_id", "url", "html", "wrapper", "template").mapInArrow(partial(_extracted, wrappers=None), schema)
