"""Main text of web pages by union-free wrappers of their hosts.

A page is a stream of tags and texts, nested as its elements are. Neighbouring groups of the same kind are folded into
one repeated group. The streams of pages that share a host and a template are then aligned one after the other, level
by level, with the wrapper found so far: where texts differ the wrapper gets a text slot, what only one side has
becomes an optional group, and where one side repeats what the other has once, that becomes a repeated group. No
alternatives arise, so the wrapper is a regular expression without unions.

How much text the slots hold tells where the article is: ``container`` goes down the wrapper to it. Each page is then
matched with the wrapper level by level, which finds the page's own article element, and its text is read off. Within
it, elements that mean something else by HTML's own names, or by a list of class words, are left out; text that is the
same on all pages stays.
"""

from __future__ import annotations

import html
import json
import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightloom.llm.common import slices, stash

#: Pages of a host's template that its wrapper is inferred from, chosen by a hash.
SAMPLE = 6
#: Longest group of neighbours that is looked for as a repeated one.
PERIOD = 4
#: Share of an element's text that one element in it must hold to be gone down to; and share of a page's for an article element to count.
MOST, SOME = 0.6, 0.1

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>""", re.S)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HIDDEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?false)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text, up to their end tag.
RAW = frozenset("script style noscript template textarea iframe object title svg math canvas xmp".split())
OUTSIDE = frozenset("nav header footer aside form menu dialog select button fieldset option".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that can hold an article.
HOLDER = frozenset("html body main article section div td tr tbody table center".split())
#: An open element that a start tag ends, and the elements beyond which it isn't looked for.
ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}
P_ENDS = frozenset({"p"}), BLOCK - {"p"}
#: Words of class, id and role values that mark what isn't the article.
SIGNS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies consent disqus footer header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted related replies reply search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
#: Words that say where or what kind of box something is, and nothing of what it holds.
PLACES = frozenset("area bar block body bottom box button buttons container content form icons inner item items left link links list main outer page panel post posts right row section site top wrap wrapper".split())


@dataclass(slots=True)
class Node:
    """An element (sign: its name and class words), a text (sign ``#``) or a group of neighbours (sign in brackets).

    Of a wrapper's text: ``text`` is None where it is a slot, ``size`` its characters on all pages, ``linked`` those in links.
    """

    sign: str
    text: str | None = None
    kids: list[Node] = field(default_factory=list)
    optional: bool = False
    repeated: bool = False
    size: int = 0
    linked: int = 0

    @property
    def name(self) -> str:
        return self.sign.split(".", 1)[0]


def class_words(name: str) -> list[str]:
    """The words that a class name counts for: a joined name whose parts are all SIGNS or PLACES, one a sign at least, for its parts, any other (share-price) for itself. Numbers don't count."""
    parts = [x for x in re.split("[_-]+", name) if x and not x.isdigit()]
    if any(x in SIGNS for x in parts) and all(x in SIGNS or x in PLACES for x in parts):
        return parts
    return ["-".join(parts)] if parts else []


def signature(name: str, attributes: str) -> str:
    """Tag name with its class, id and role words but for numbers, those that mark a hidden element included."""
    if not attributes.strip():
        return name
    found = sorted({w for m in NAMED.finditer(attributes) for name in re.split(r"[\s.#()]+", (m[1] or m[2] or m[3] or "").lower()) for w in class_words(name)})
    return ".".join([name, *found, *(["hidden"] if HIDDEN.search(attributes) else [])])


def parse(page: str) -> Node:
    """The page's elements and texts. An end tag ends what is open within; start tags end paragraphs, items and cells as HTML has it."""
    root = Node("")
    stack, names, opened = [root], [""], Counter()
    at, n = 0, len(page)

    def close(name: str) -> None:
        while names[-1] != name:
            opened[names.pop()] -= 1
            stack.pop()
        opened[names.pop()] -= 1
        stack.pop()

    def end_open(ended: frozenset[str], within: frozenset[str]) -> None:
        if not any(opened[x] for x in ended):
            return
        for x in reversed(names):
            if x in ended:
                return close(x)
            if x in within:
                return

    while at < n:
        m = TOKEN.search(page, at)
        stop = m.start() if m else n
        if stop > at:
            stack[-1].kids.append(Node("#", html.unescape(page[at:stop])))
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if opened[name]:
                close(name)
            continue
        if name in BLOCK:
            end_open(*P_ENDS)
        if name in ENDS:
            end_open(*ENDS[name])
        node = Node(signature(name, m[3] or m[6] or ""))
        stack[-1].kids.append(node)
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else n
        elif name not in VOID:
            stack.append(node)
            names.append(name)
            opened[name] += 1
    return root


def outside(sign: str) -> bool:
    name, *words = sign.split(".")
    return name in OUTSIDE or name in RAW or name == "head" or "hidden" in words or (name not in ("html", "body", "article", "main") and not SIGNS.isdisjoint(words))


def folded(items: list[Node], linked: bool = False) -> list[Node]:
    """What a wrapper of one page has for these items: blank texts gone, repeated groups folded, texts measured."""
    out = []
    for x in items:
        if x.sign == "#":
            if held := " ".join(x.text.split()):
                out.append(Node("#", held, size=len(held), linked=len(held) * linked))
        else:
            out.append(Node(x.sign, kids=folded(x.kids, linked or x.name == "a")))
    for period in range(1, PERIOD + 1):
        signs, done, i = [kind(x) for x in out], [], 0
        while i < len(out):
            unit, j = signs[i : i + period], i + period
            while signs[j : j + period] == unit and unit != ["#"] and (period == 1 or len(set(unit)) > 1):
                j += period
            if j > i + period:
                merged = out[i : i + period]
                for k in range(i + period, j, period):
                    merged = [join(x, y) for x, y in zip(merged, out[k : k + period])]
                one = merged[0] if period == 1 else group(merged)
                one.repeated = True
                done.append(one)
                i = j
            else:
                done.append(out[i])
                i += 1
        out = done
    return out


def kind(x: Node) -> str:
    """What neighbours of one repeated group have in common: the sign, and of elements that can hold an article also the signs within."""
    return x.sign + ">" + " ".join(sorted({k.sign for k in x.kids})) if x.name in HOLDER else x.sign


def group(items: list[Node]) -> Node:
    return Node(f"({' '.join(x.sign for x in items)})", kids=items)


def join(a: Node, b: Node) -> Node:
    """What takes both, which have one sign; where their texts differ there is a slot."""
    if a.sign == "#":
        return Node("#", a.text if a.text == b.text else None, [], a.optional or b.optional, False, a.size + b.size, a.linked + b.linked)
    return Node(a.sign, None, align(a.kids, b.kids), a.optional or b.optional, a.repeated or b.repeated)


def grouped(items: list[Node], others: list[Node]) -> list[Node]:
    """Items that a repeated group of the other side has once, or that follow each other as in it, as such a group."""
    for g in others:
        if g.sign.startswith("(") and not any(x.sign == g.sign for x in items):
            unit = [x.sign for x in g.kids]
            signs = [x.sign for x in items]
            for i in range(len(items) - len(unit) + 1):
                if signs[i : i + len(unit)] == unit:
                    items = [*items[:i], group(items[i : i + len(unit)]), *items[i + len(unit) :]]
                    break
    return items


def align(a: list[Node], b: list[Node]) -> list[Node]:
    """The items that take both lists: what one side lacks is optional."""
    if [x.sign for x in a] == [x.sign for x in b]:
        return [join(x, y) for x, y in zip(a, b)]
    a, b = grouped(a, b), grouped(b, a)
    out: list[Node] = []
    for kind, i, j, k, m in SequenceMatcher(None, [x.sign for x in a], [x.sign for x in b], autojunk=False).get_opcodes():
        if kind == "equal":
            out += [join(x, y) for x, y in zip(a[i:j], b[k:m])]
            continue
        for x in (*a[i:j], *b[k:m]):
            x.optional = True
            out.append(x)
    return out


def infer(pages: list[str]) -> Node:
    """The wrapper of pages, aligned one after the other."""
    sys.setrecursionlimit(1_000_000)  # pages may be nested as deeply as they like
    wrapper = None
    for p in pages:
        own = Node("", kids=folded(parse(p).kids))
        wrapper = own if wrapper is None else join(wrapper, own)
    return wrapper or Node("")


def expression(node: Node) -> str:
    """The wrapper as a regular expression over tokens; ``#`` is a text slot."""
    if node.sign == "#":
        held = "#" if node.text is None else json.dumps(node.text, ensure_ascii=False)
    else:
        inner = "".join([expression(x) for x in node.kids])
        held = inner if not node.sign or node.sign.startswith("(") else f"<{node.sign}>{inner}</{node.name}>"
    mark = "+" * node.repeated + "?" * node.optional
    return f"({held}){mark}" if mark else held


def weigh(wrapper: Node, pages: int) -> dict[int, tuple[float, float]]:
    """By the id of each node: text in its slots, not linked and linked; a text that is the same on several pages counts a tenth."""
    out: dict[int, tuple[float, float]] = {}

    def walk(x: Node) -> tuple[float, float]:
        if x.sign == "#":
            share = 1 if x.text is None or pages < 2 else 0.1
            out[id(x)] = (x.size - x.linked) * share, x.linked * share
        else:
            plain = linked = 0.0
            for k in x.kids:
                p, q = walk(k)
                plain += p
                linked += q
            out[id(x)] = plain, linked
        return out[id(x)]

    walk(wrapper)
    return out


def container(wrapper: Node, pages: int) -> list[tuple[list[Node], int]]:
    """The way to the element that holds the article: at each level the items, and which of them.

    An article or main element that occurs once on a page is it, if its slots hold a fair part of all text that isn't
    linked: the heaviest, and of nested ones the inner if most lies there. Else the way goes down while one element
    that occurs once holds most.
    """
    plain = {k: x for k, (x, _) in weigh(wrapper, pages).items()}
    above: dict[int, tuple[Node, int]] = {}

    def way_to(x: Node) -> list[tuple[list[Node], int]]:
        out = []
        while id(x) in above:
            x, i = above[id(x)]
            out.append((x.kids, i))
        return out[::-1]

    best: Node | None = None
    todo = [wrapper]
    while todo:
        node = todo.pop()
        for i, x in enumerate(node.kids):
            if x.name not in HOLDER or x.repeated:
                continue
            above[id(x)] = node, i
            todo.append(x)
            if x.name in ("article", "main") and not outside(x.sign) and plain[id(x)] >= SOME * plain[id(wrapper)] > 0:
                inner = best is not None and any(items[k] is best for items, k in way_to(x))
                if best is None or (plain[id(x)] >= MOST * plain[id(best)] if inner else plain[id(x)] > plain[id(best)]):
                    best = x
    if best is not None:
        return way_to(best)
    node = wrapper
    while True:
        held = max((x for x in node.kids if x.name in HOLDER and not x.repeated), key=lambda x: plain[id(x)], default=None)
        if held is None or plain[id(held)] < MOST * plain[id(node)] or not plain[id(held)]:
            return way_to(node)
        node = held


def reading(pages: list[str]) -> tuple[str, str]:
    """The wrapper of pages, as an expression, and what a reader needs of it, as JSON.

    ``levels``: for each level down to the article its items (sign, optional, repeated, signs within) and which one it is in. ``drop``:
    items beside the paragraphs, where the article has no element to itself, that are mostly links.
    """
    wrapper = infer(pages)
    way = container(wrapper, len(pages))
    item = lambda x: [x.sign, x.optional, x.repeated, sorted(within(x))]
    node = way[-1][0][way[-1][1]] if way else wrapper
    drop = []
    if node.name not in ("article", "main"):
        weight = weigh(wrapper, 1)
        drop = [i for i, x in enumerate(node.kids) if x.sign != "#" and x.name != "p" and weight[id(x)][1] > weight[id(x)][0]]
    return expression(wrapper), json.dumps({"levels": [[[item(x) for x in items], at] for items, at in way], "last": [item(x) for x in node.kids] if drop else [], "drop": drop})


def within(x: Node) -> set[str]:
    """Signs of what an element holds, those of groups one by one."""
    return {y for k in x.kids if k.sign != "#" for y in (within(k) if k.sign.startswith("(") else (k.sign,))}


def match(items: list, kids: list[Node]) -> list[int]:
    """For each element the wrapper's item that takes it, or -1: of all ways to match the one that leaves least over on both sides, and least within."""
    n, m = len(items), len(kids)
    own = [within(x) for x in kids]
    cost = [float(m - j) for j in range(m + 1)]
    steps = []
    for sign, optional, repeated, held in reversed(items):
        held = set(held)
        left, step = [0.0] * (m + 1), [0] * (m + 1)
        miss = 0.0 if optional else 1.0
        left[m] = cost[m] + miss
        for j in range(m - 1, -1, -1):
            best, how = cost[j] + miss, 0  # the item takes nothing (more)
            if left[j + 1] + 1 < best:
                best, how = left[j + 1] + 1, 1  # the element is left over
            if sign == kids[j].sign:
                far = 0.5 * len(own[j] ^ held) / max(1, len(own[j] | held))
                once, more = cost[j + 1] + far, left[j + 1] - miss + far
                if min(once, more if repeated else once) <= best:
                    best, how = (more, 3) if repeated and more < once else (once, 2)
            left[j], step[j] = best, how
        cost = left
        steps.append(step)
    steps.reverse()
    out, i, j = [-1] * m, 0, 0
    while i < n and j < m:
        how = steps[i][j]
        if how >= 2:
            out[j] = i
        i += how in (0, 2)
        j += how > 0
    return out


def locate(page: Node, levels: list) -> Node | None:
    """The page's own element at the end of the wrapper's way; None where the page lacks it."""
    node = page
    for items, at in levels:
        kids = [x for x in node.kids if x.sign != "#"]
        taken = match([x for x in items if x[0] != "#"], kids)
        target = sum(1 for x in items[:at] if x[0] != "#")
        node = next((k for k, t in zip(kids, taken) if t == target), None)
        if node is None:
            return None
    return node


@lru_cache(maxsize=256)
def loaded(held: str) -> dict:
    return json.loads(held)


def extract(page: str, held: str | None) -> str:
    """Blocks of the page's article, found by matching the page with its wrapper, or with its own where that has no such place."""
    root = parse(page)
    rules = loaded(held or reading([page])[1])
    node = locate(root, rules["levels"])
    if node is None:
        rules = loaded(reading([page])[1])
        node = locate(root, rules["levels"]) or root
    away: set[int] = set()
    if rules["drop"]:
        kids = [x for x in node.kids if x.sign != "#"]
        plain = [i for i, x in enumerate(rules["last"]) if x[0] != "#"]
        away = {id(k) for k, t in zip(kids, match([rules["last"][i] for i in plain], kids)) if t >= 0 and plain[t] in rules["drop"]}
    return "\n\n".join(blocks(node, away))


def blocks(article: Node, away: set[int]) -> list[str]:
    out: list[str] = []
    held: list[str] = []

    def end_block() -> None:
        if text := " ".join("".join(held).split()):
            out.append(text)
        held.clear()

    todo: list[Node | None] = [*reversed(article.kids)]  # None: a block ends
    while todo:
        x = todo.pop()
        if x is None:
            end_block()
        elif x.sign == "#":
            held.append(x.text)
        elif x.name in VOID:
            if x.name == "hr":
                end_block()
            elif x.name == "br":
                held.append(" ")
        else:
            block = x.name in BLOCK
            if block:
                end_block()
                todo.append(None)
            # the article's own heading may stand in a header element
            if not (id(x) in away or (outside(x.sign) and x.name != "header")):
                todo += reversed(x.kids)
    end_block()
    return out


def infer_templates(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for held in parts:
        rows = [(host, template, *reading(sorted({p for p in pages if p}))) for host, template, pages in zip(held["host"], held["template"], held["sample"])]
        yield pd.DataFrame(rows, columns=["host", "template", "wrapper", "rules"])


def template() -> Column:
    """Names a page's template: a hash of the distinct structural tags it has, with their class words but for numbers."""
    tags = F.regexp_extract_all("html", F.lit(r"""(?i)<((?:nav|header|main|article|aside|footer|form|div)(?:\s+class\s*=\s*["']?[^"'>]*)?)"""), F.lit(1))
    return F.xxhash64(F.array_sort(F.array_distinct(F.transform(tags, lambda x: F.regexp_replace(F.lower(x), r"[0-9\s]+", " "))))).alias("template")


def with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).select("page_id", "url", "html", host.alias("host"), template())


def host_wrappers(pages: DataFrame) -> DataFrame:
    """host, template, wrapper (an expression) and rules (see reading) of each template of a host, from SAMPLE pages of it; a host's pages never meet in one task."""
    each = [F.min(F.struct(F.xxhash64("page_id", "html", F.lit(k)).alias("h"), "html")).getField("html") for k in range(SAMPLE)]
    sampled = with_host(pages).groupBy("host", "template").agg(F.array(*each).alias("sample"))
    return sampled.mapInPandas(infer_templates, "host string, template long, wrapper string, rules string")


def read_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sys.setrecursionlimit(1_000_000)
    for batch in slices(batches, "html"):
        texts = [extract(p, e) for p, e in zip(batch.column("html").to_pylist(), batch.column("rules").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row.

    A null or empty page has an empty text. Pages without a url are grouped by template alone. Whole pages are read,
    however long or deeply nested. Repeated rows each get their row; an empty table gives none. Only page_id, url and
    html are read, so further columns play no part.
    """
    known = stash(host_wrappers(pages), "wrappers").select("host", "template", "rules")
    return with_host(pages).join(known, ["host", "template"], "left").select("page_id", "url", "html", "rules").mapInArrow(read_pages, "page_id long, url string, text string, n_chars long")
