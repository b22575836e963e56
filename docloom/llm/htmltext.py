"""HTML extraction with inferred wrappers.

Method: union-free regular-expression inference. A page is a stream of items: text blocks and
elements, an element holding the stream of its own items. Adjacent items or groups of one
form become a repeated group. The streams of a host's pages are aligned one after another,
level by level: items that match meet (their insides are aligned in turn), items that only
some pages have become optional, and a text block becomes a slot that knows how many pages it
was on, how much text it held and which texts come back on page after page.

What the wrapper decides:
* texts that at least half of a host's pages (and three) hold in the same slot are template, not
  content, wherever they stand: menus, notices and promotions need no telling name;
* the content root, by descending from the body to the element that holds four fifths of the text
  that varies between pages, outside links; repeated groups and text elements are not entered, nor
  is an element that has headings beside it.
Every page of the host is then read below that root, less template texts. Names decide only
what the alignment cannot: elements such as nav or form, and classes such as "ad" or
"comments", are furniture unless they hold most of the text; article and main settle a root
with half of the text. Where template texts would be two fifths or more of an article they are
the article (copies of one page on a host), and stay. A template heading stays before content.
A page without the root (another layout, a host of one page) is read by its own wrapper.

The plan: each task folds its pages by host into one partial wrapper a host; these merge in a
tree of rounds of at most FAN wrappers each, so a host with a third of all pages is never
gathered. A host's rule (root and template texts) is broadcast when the rules' measured size is
small, and joined by shuffle beyond it.

Bounds (of the wrapper alone, no text of a page is dropped by them): beside more than WIDEST
siblings those on fewest pages leave the wrapper, elements nested deeper than DEEPEST
belong to the element at that depth, texts on under an eighth of the pages leave a slot of
over 512 texts, and lists of over 4,096 pairs align by the order of their names alone (n log n).

Defined results: null or empty html gives empty text; urls without a host, or that cannot be
read, share one host; repeated rows each keep their row. White space in a block becomes one
space; br is white space; blocks without text vanish.
"""

from __future__ import annotations

import html as html_lib
import json
import re
from bisect import bisect_left
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import configure, input_bytes, materialize, slices, table

BROADCAST_BYTES = 32 << 20
#: Wrappers of a host that one task merges in a round.
FAN = 64
WIDEST, DEEPEST = 256, 100
#: Share of a host's pages (and number of them) on which a text is template.
OFTEN, LEAST_PAGES = 0.5, 3
#: Share of the text around it from which an element holds all content.
MOST = 0.8
#: Share of an article from which template texts are taken for the article itself.
MOST_FIXED = 0.4

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(script|style|noscript|template|textarea|title|iframe)\b[^>]*>.*?(?:</\1\s*>|$)|<[!?][^>]*>|</\s*([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
_NAME = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_DIGITS = re.compile(r"[0-9]{2,}")
_LETTER = re.compile(r"[^\W\d_]")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var br wbr img".split())
#: Elements that close an open p, and what else the start of some elements closes.
_BLOCK = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_CLOSES = {
    "li": frozenset(["p", "li"]), "dt": frozenset(["p", "dt", "dd"]), "dd": frozenset(["p", "dt", "dd"]), "option": frozenset(["option"]),
    "tr": frozenset(["p", "td", "th", "tr"]), "td": frozenset(["p", "td", "th"]), "th": frozenset(["p", "td", "th"]),
}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold text rather than an article; equal ones beside each other repeat.
_TEXT = _HEADINGS | frozenset("p li ul ol dl dt dd tr td th table tbody thead tfoot caption blockquote pre figure figcaption address option".split())
#: Where short constant texts are labels of content.
_LABELS = frozenset("td th dt caption figcaption".split())
#: Elements that are page furniture by name.
_FURNITURE = frozenset("nav footer aside form button select dialog menu head svg canvas audio video object".split())
#: Class names, ids and roles that mark page furniture: whole names, each of whose parts is a word
#: of furniture or a neutral one ("cookie-notice", "site-header", but not "has-sidebar").
_WORD = (
    r"(?:ad|ads|advert[a-z0-9]*|sponsor[a-z0-9]*|promo[a-z0-9]*|banner|cookie[a-z0-9]*|consent|notice|notices|alert|popup|modal|newsletter|subscribe|signup|nav|navbar|navigation|menu|"
    r"breadcrumb[a-z0-9]*|sidebar|side|widget[a-z0-9]*|footer|header|masthead|related|share|social|comment|comments|respond|reply|replies|disqus|toolbar|pagination|pager|skip|login|search)\d*")  # fmt: skip
_NEUTRAL = (
    r"(?:site|page|global|main|primary|secondary|top|bottom|area|areas|list|lists|item|items|box|boxes|bar|block|container|wrapper|wrap|holder|inner|outer|panel|section|slot|unit|"
    r"button|buttons|btn|icon|icons|link|links|form|field|input|label|title|heading|media|network|networks|tools|posts|articles|stories|content|text|to|the|js|\d+)")  # fmt: skip
_MARKED = re.compile(rf"(?:^|\s)(?:{_NEUTRAL}[_-]+)*{_WORD}(?:[_-]+(?:{_WORD}|{_NEUTRAL}))*[_-]*(?:$|\s)", re.I)
#: Elements that their marks never make furniture.
_WHOLE = frozenset("html body main article".split())


# --- pages ------------------------------------------------------------------------------


def parse(html: str) -> list:
    """The page as an element [step, items]; an item is such an element or a block
    (text, characters inside links)."""
    root = ["", []]
    stack = [("", root)]  # open elements
    run, links, anchors = [], 0, 0
    at = 0

    def flush():
        nonlocal links
        if run:
            if text := " ".join("".join(run).split()):
                stack[-1][1][1].append((text, min(links, len(text))))
            run.clear()
        links = 0

    def words(raw: str):
        nonlocal links
        if "&" in raw:
            raw = html_lib.unescape(raw)
        run.append(raw)
        if anchors:
            links += len(raw)

    for m in _TOKEN.finditer(html):
        if m.start() > at:
            words(html[at : m.start()])
        at = m.end()
        if m[3]:
            name = m[3].lower()
            if name in _INLINE:
                if name == "a":
                    anchors = 1
                elif name == "br":
                    run.append(" ")
                continue
            flush()
            if name in _VOID:
                continue
            closes = _CLOSES.get(name) or (("p",) if name in _BLOCK else ())
            while stack[-1][0] in closes:
                stack.pop()
            marks = m[4]
            marks = " ".join(v.strip("\"'") for v in _NAME.findall(marks)) if marks and "=" in marks else ""
            node = [f"{name} {_DIGITS.sub('0', marks)}".strip(), []]
            if len(stack) <= DEEPEST:
                stack[-1][1][1].append(node)
                stack.append((name, node))
            else:
                stack.append((name, stack[-1][1]))
        elif m[2]:
            name = m[2].lower()
            if name == "a":
                anchors = 0
            if name in _INLINE:
                continue
            flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
    if at < len(html):
        words(html[at:])
    flush()
    return root


def mark_of(step: str, text: str) -> str:
    """What identifies a text in a slot: its element and words."""
    return blake2b(f"{step}\0{text}".encode("utf-8", "replace"), digest_size=8).hexdigest()


@lru_cache(maxsize=1 << 14)
def _furniture(step: str) -> bool:
    name, _, mark = step.partition(" ")
    return name in _FURNITURE or bool(mark and name not in _WHOLE and _MARKED.search(mark))


# --- wrappers: items are lists, so that JSON carries them between tasks ---------------------
# ["x", optional, pages, characters, characters in links, {mark: [pages, length]}]
# ["<", optional, step, items]
# ["+", optional, items]


def wrapper(page: list) -> list:
    """The wrapper of one page's element: its items, folded."""
    step, items = page
    out = []
    for item in items:
        if isinstance(item, tuple):
            text, links = item
            out.append(["x", False, 1, len(text), links, {mark_of(step, text): [1, len(text)]}])
        else:
            out.append(["<", False, item[0], wrapper(item)])
    return fold(out)


def key_of(item: list) -> str:
    """What has to agree for two items of two pages to align."""
    kind = item[0]
    if kind == "x":
        return "x"
    if kind == "<":
        return item[2]
    return key_of(item[2][0]) if len(item[2]) == 1 else "(" + " ".join(map(key_of, item[2])) + ")"


def _form(item: list) -> str:
    """What has to agree for two items of one page to repeat."""
    kind = item[0]
    if kind == "x":
        return "x"
    if kind == "+":
        return "+" + " ".join(map(_form, item[2]))
    name = item[2].partition(" ")[0]
    return item[2] if name in _TEXT else item[2] + "{" + " ".join(map(_form, item[3])) + "}"


def _meet(a: list, b: list, same: bool) -> list:
    """One item (a is used up) that accepts what two items of one key accept; same: both are of one page."""
    optional = a[1] or b[1]
    if a[0] == "x":
        seen = a[5]
        for mark, (pages, size) in b[5].items():
            old = seen.get(mark)
            if old is None:
                seen[mark] = [pages, size]
            else:
                old[0] = max(old[0], pages) if same else old[0] + pages
        pages = max(a[2], b[2]) if same else a[2] + b[2]
        if len(seen) > 512 and pages >= 16:
            seen = {m: v for m, v in seen.items() if v[0] * 8 >= pages}
        return ["x", optional, pages, a[3] + b[3], a[4] + b[4], seen]
    if a[0] == "<" and b[0] == "<":
        return ["<", optional, a[2], align(a[3], b[3], same)]
    one, two = (i[2] if i[0] == "+" else [i] for i in (a, b))
    return ["+", optional, [_meet(x, y, same) for x, y in zip(one, two)]]


def fold(items: list, longest: int = 6) -> list:
    """Adjacent groups of one form become a repeated group, short groups first."""
    for size in range(1, longest + 1):
        if len(items) < 2 * size:
            break
        keys = [key_of(i) for i in items]
        out, at = [], 0
        while at < len(items):
            group, end = items[at : at + size], at + size
            if keys[at:end] == keys[end : end + size] and not (size == 1 and group[0][0] == "x"):
                forms = [_form(i) for i in group]
                while keys[at : at + size] == keys[end : end + size] and [_form(i) for i in items[end : end + size]] == forms:
                    group = [_meet(x, y, True) for x, y in zip(group, items[end : end + size])]
                    end += size
            if end > at + size:
                out.append(["+", False, group[0][2] if size == 1 and group[0][0] == "+" else group])
            else:
                out.append(items[at])
                end = at + 1
            at = end
        items = out
    return items


def _features(item: list, depth: int = 3) -> set:
    """Names and texts near the top of an item."""
    if item[0] == "x":
        return set(list(item[5])[:8])
    out = {key_of(item)}
    if depth:
        for i in item[3] if item[0] == "<" else item[2]:
            out |= _features(i, depth - 1)
    return out


def _matches(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of positions, ascending in both lists, of items that align."""
    ka, kb = [key_of(i) for i in a], [key_of(i) for i in b]
    unique = len(set(ka)) == len(ka) and len(set(kb)) == len(kb)
    if not unique and len(a) * len(b) <= 4096:
        fa, fb = [_features(i) for i in a], [_features(i) for i in b]
        # the heaviest common subsequence, a pair weighing more the more its insides agree
        best = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
        worth = [[1 + 4 * len(x & y) / max(1, len(x | y)) if k == l else 0.0 for y, l in zip(fb, kb)] for x, k in zip(fa, ka)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                best[i][j] = max(best[i + 1][j], best[i][j + 1], worth[i][j] + best[i + 1][j + 1] if worth[i][j] else 0.0)
        out, i, j = [], 0, 0
        while i < len(a) and j < len(b):
            if worth[i][j] and best[i][j] == worth[i][j] + best[i + 1][j + 1]:
                out.append((i, j))
                i, j = i + 1, j + 1
            elif best[i][j] == best[i + 1][j]:
                i += 1
            else:
                j += 1
        return out
    if not unique:  # the first with the first of a name, the second with the second
        ka, kb = _numbered(ka), _numbered(kb)
    place = {k: j for j, k in enumerate(kb)}
    tails: list[int] = []  # least last position in b of a rising chain of each length
    chain: list[tuple[int, int, int]] = []  # (i, j, entry before)
    last: list[int] = []
    for i, k in enumerate(ka):
        if (j := place.get(k)) is None:
            continue
        at = bisect_left(tails, j)
        chain.append((i, j, last[at - 1] if at else -1))
        tails[at : at + 1] = [j]
        last[at : at + 1] = [len(chain) - 1]
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(chain[k][:2])
        k = chain[k][2]
    return out[::-1]


def _numbered(keys: list[str]) -> list[str]:
    count: dict[str, int] = {}
    out = []
    for k in keys:
        count[k] = n = count.get(k, -1) + 1
        out.append(f"{k}#{n}")
    return out


def _support(item: list) -> int:
    return item[2] if item[0] == "x" else max(map(_support, item[3] if item[0] == "<" else item[2]), default=0)


def align(a: list, b: list, same: bool = False) -> list:
    """The wrapper (a is used up) that accepts both lists: matching items meet, others become optional."""
    if len(a) == len(b) and all(key_of(x) == key_of(y) for x, y in zip(a, b)):
        return [_meet(x, y, same) for x, y in zip(a, b)]
    out, i, j = [], 0, 0

    def optional(items):
        for item in items:
            item[1] = True
            out.append(item)

    for x, y in _matches(a, b):
        optional(a[i:x])
        optional(b[j:y])
        out.append(_meet(a[x], b[y], same))
        i, j = x + 1, y + 1
    optional(a[i:])
    optional(b[j:])
    out = fold(out, 1)
    if len(out) > WIDEST:
        keep = sorted(sorted(range(len(out)), key=lambda k: -_support(out[k]))[:WIDEST])
        out = [out[k] for k in keep]
    return out


class Folder:
    """Aligns the wrappers of a host's pages one after another."""

    def __init__(self):
        self.items, self.pages = None, 0

    def add(self, items: list, pages: int = 1) -> None:
        self.pages += pages
        self.items = items if self.items is None else align(self.items, items)


# --- from wrapper to rule -------------------------------------------------------------------


def _fixed(x: list, pages: int, least: int = LEAST_PAGES) -> dict[str, int]:
    """Template texts of a slot, and the characters they take on all pages."""
    least = max(least, OFTEN * pages)
    return {m: n * size for m, (n, size) in x[5].items() if n >= least}


def _weight(item: list, pages: int) -> tuple[float, float]:
    """Text of an item, that of links and of texts that come back counting a tenth: all of it, and
    without furniture."""
    if item[0] == "x":
        own = item[3] - 0.9 * min(item[3], sum(_fixed(item, pages, 2).values()))
        own *= 1 - 0.9 * min(1.0, item[4] / max(1, item[3]))
        return own, own
    both = [_weight(i, pages) for i in (item[3] if item[0] == "<" else item[2])]
    raw, net = (sum(w[k] for w in both) for k in (0, 1))
    if item[0] == "<" and _furniture(item[2]):
        return raw, 0.0
    return raw, net


def content_root(items: list, pages: int) -> list[str]:
    """Steps from the top of the page to the element that holds the content."""
    path: list[str] = []
    while True:
        inner = [(i, *_weight(i, pages)) for i in items]
        raw, net = (sum(w[k] for w in inner) for k in (1, 2))
        # a mark on an element that holds most of the text says nothing
        real = [(i, r if i[0] == "<" and r >= 0.7 * raw and i[2].partition(" ")[0] not in _FURNITURE else n) for i, r, n in inner]
        total = sum(w for _, w in real)
        elements = [(w, i) for i, w in real if i[0] == "<" and i[2].partition(" ")[0] not in _TEXT]
        if not elements or total <= 0:
            return path
        w, best = max(elements, key=lambda e: e[0])
        name = best[2].partition(" ")[0]
        beside = any(x > 0 and i is not best and key_of(i).partition(" ")[0] in _HEADINGS for i, x in real)
        if not (name in ("html", "body") or (name in ("article", "main") and w >= 0.5 * total) or (w >= MOST * total and not beside)):
            return path
        path.append(best[2])
        items = best[3]


def _all_fixed(items: list, pages: int, out: set) -> set:
    for i in items:
        if i[0] == "x":
            out.update(_fixed(i, pages))
        else:
            _all_fixed(i[3] if i[0] == "<" else i[2], pages, out)
    return out


def rule_of(items: list, pages: int) -> str:
    """The JSON of a host's rule: root path and template texts."""
    return json.dumps([content_root(items, pages), sorted(_all_fixed(items, pages, set()))])


@lru_cache(maxsize=4096)
def _rule(text: str) -> tuple[list[str], frozenset]:
    root, fixed = json.loads(text)
    return root, frozenset(fixed)


# --- reading ------------------------------------------------------------------------------


def _find(page: list, path: list[str]) -> list[list]:
    """The elements at the end of a path of steps."""
    now = [page]
    for step in path:
        now = [i for e in now for i in e[1] if not isinstance(i, tuple) and i[0] == step]
    return now


def _blocks(element: list, out: list, marks: bool) -> list:
    """(text, step) of the blocks below an element, without furniture; marks: by marks as well as by name."""
    for item in element[1]:
        if isinstance(item, tuple):
            out.append((item[0], element[0]))
        elif not (_furniture(item[0]) if marks else item[0].partition(" ")[0] in _FURNITURE):
            _blocks(item, out, marks)
    return out


def _without_fixed(blocks: list, fixed: frozenset) -> list[str]:
    """The texts that are not template."""
    if not fixed:
        return [t for t, _ in blocks]
    names = [step.partition(" ")[0] for _, step in blocks]
    drop = [n not in _LABELS and bool(_LETTER.search(t)) and mark_of(step, t) in fixed for (t, step), n in zip(blocks, names)]
    size = sum(len(t) for t, _ in blocks)
    if sum(len(t) for (t, _), d in zip(blocks, drop) if d) >= MOST_FIXED * size:
        return [t for t, _ in blocks]
    for k in range(len(blocks) - 2, -1, -1):  # a heading belongs to the content that follows it
        if drop[k] and names[k] in _HEADINGS and names[k] != "h1" and not drop[k + 1]:
            drop[k] = False
    return [t for (t, _), d in zip(blocks, drop) if not d]


def extract(html: str | None, rule: str | None) -> str:
    """The page's main text by its host's rule; by the page's own wrapper where there is no rule or
    the rule leads to no text."""
    if not html:
        return ""
    page = parse(html)
    root, fixed = _rule(rule) if rule else ([], frozenset())
    tags = {s.partition(" ")[0] for s in root}
    for marks in (True, False):
        if tags - {"html", "body"} and (found := _find(page, root)):
            blocks = [b for e in found for b in _blocks(e, [], marks)]
            if got := _without_fixed(blocks, fixed):
                return "\n".join(got)
        own = content_root(wrapper(page), 1)
        if tags and not tags - {"html", "body"} and not {s.partition(" ")[0] for s in own} & {"article", "main"}:
            own = [s for s in own if s.partition(" ")[0] in ("html", "body")]  # the host's content is the whole body
        blocks = [b for e in _find(page, own) for b in _blocks(e, [], marks)]
        if not {s.partition(" ")[0] for s in own} - {"html", "body"}:
            blocks = [b for e in _find(page, own) for b in _body_blocks(e, marks)]
        if got := _without_fixed(blocks, fixed):
            return "\n".join(got)
    return ""


def _body_blocks(body: list, marks: bool) -> list:
    """Blocks of a page whose root is the body: a header directly below it is the site's."""
    some = [i for i in body[1] if isinstance(i, tuple) or i[0].partition(" ")[0] != "header"]
    return _blocks([body[0], some], [], marks) or _blocks(body, [], marks)


# --- plan -------------------------------------------------------------------------------


def host_of(url: Column) -> Column:
    """Lower-cased host of a url, "" where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[\]]+)", 1), F.lit("")))


_SCHEMA = "host string, wrapper string, pages long"


def _rows(some: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([h for h, _ in some]), pa.array([json.dumps(f.items) for _, f in some]), pa.array([f.pages for _, f in some], pa.int64())], ["host", "wrapper", "pages"])


def _partial(batches):
    folders: dict[str, Folder] = {}
    for batch in batches:
        for part in slices(batch, "html"):
            for host, html in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
                if html:
                    folders.setdefault(host, Folder()).add(wrapper(parse(html)))
            if len(folders) > 2000:  # bounded memory: what is aligned so far goes out
                yield _rows(list(folders.items()))
                folders.clear()
    if folders:
        yield _rows(list(folders.items()))


def _merge(batches):
    """Wrappers sorted by host within the partition, aligned one after another."""
    host, folder = None, None
    for batch in batches:
        for h, w, n in zip(*(batch.column(c).to_pylist() for c in ("host", "wrapper", "pages"))):
            if h != host:
                if folder:
                    yield _rows([(host, folder)])
                host, folder = h, Folder()
            folder.add(json.loads(w), n)
    if folder:
        yield _rows([(host, folder)])


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON of the union-free expression), pages."""
    spark = configure(pages.sparkSession)
    now = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(_partial, _SCHEMA)
    # a host has at most a wrapper a task, so the tasks bound the rounds
    tasks = max(1, -(-input_bytes(pages) // (1 << 20)), int(spark.conf.get("spark.sql.shuffle.partitions")))
    while True:
        tasks = -(-tasks // FAN)
        salt = F.pmod(F.xxhash64("wrapper"), F.lit(tasks))
        now = now.withColumn("salt", salt).repartition("host", "salt").sortWithinPartitions("host", "wrapper").select("host", "wrapper", "pages").mapInArrow(_merge, _SCHEMA)
        if tasks == 1:
            return now


def main_text(pages: DataFrame) -> DataFrame:
    """pages' page_id and url with text."""
    configure(pages.sparkSession)

    def choose(batches):
        for batch in batches:
            rules = [rule_of(json.loads(w), n) for w, n in zip(batch.column("wrapper").to_pylist(), batch.column("pages").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(rules)], ["host", "rule"])

    rules = materialize(wrappers(pages).mapInArrow(choose, "host string, rule string"), "op3-rules")
    size = rules.agg(F.sum(F.length("host") + F.length("rule") + 48)).first()[0] or 0
    rules = F.broadcast(rules) if size <= BROADCAST_BYTES else rules
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(rules, "host", "left").select("page_id", "url", "html", "rule")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [extract(h, r) for h, r in zip(part.column("html").to_pylist(), part.column("rule").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return rows.mapInArrow(run, "page_id long, url string, text string")


def op3_htmltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
