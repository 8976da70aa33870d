import hashlib
import html
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flightloom.llm import components as C
from flightloom.llm import near_dedup as N
from flightloom.llm.components import components
from flightloom.llm.decontamination import contamination, phrase_matches
from flightloom.llm.suffixes import ENTRIES, LEAST, neighbours, passage_report, repeated_passages
from flightloom.llm.topk import top_products
from flightloom.llm.wrappers import extract, extract_main_text, host_wrappers, match, parse, reading

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def cut(text):
    return WORD.findall((text or "").translate(LOWER))


def test_contamination(spark, sf_dir, documents, rows, nothing):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").unionByName(spark.createDataFrame([(900, "two words"), (901, None), (902, "..."), (None, "said twice in full")], "item_id long, text string"))
    windows = defaultdict(set)
    for x in bench.collect():
        w = cut(x.text)
        if x.item_id is not None:
            for i in range(max(1, len(w) - 9)) if w else ():
                windows[tuple(w[i : i + 10])].add(str(x.item_id))
    want = []
    for d, t in rows:
        w, hit, items = cut(t), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    items |= windows[k]
        want.append((d, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    got = [tuple(x) for x in contamination(documents, bench).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and any(x[5] for x in want)
    assert contamination(nothing, bench).count() == 0
    assert not contamination(documents, bench.limit(0)).where("contaminated").count()


def test_batches_and_slack(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a x b c d"), (3, "c b a")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c"), (2, "d e f"), (3, "b c d")], "item_id long, text string")
    monkeypatch.setattr("flightloom.llm.decontamination.BATCH", 1)
    got = {x["doc_id"]: (x["starts"], x["ends"], x["items"]) for x in phrase_matches(docs, bench, 3).collect()}
    assert got == {1: ([0], [6], ["1", "2", "3"]), 2: ([2], [5], ["3"]), 3: ([], [], [])}
    near = {x["doc_id"]: (x["starts"], x["ends"], x["items"]) for x in phrase_matches(docs, bench, 3, slack=1).collect()}
    assert near[2] == ([0], [5], ["1", "3"])
    apart = spark.createDataFrame([(1, "a b q"), (2, "c d e"), (3, "c z a b")], "doc_id long, text string")
    assert not any(x["items"] for x in phrase_matches(apart, bench.where("item_id = 1"), 3, slack=1).collect())


def near_by_brute_force(words, phrase, slack, counts):
    """Whether the phrase's words stand within slack of their places, counted from some place of its rarest word."""
    offset = min(range(len(phrase)), key=lambda i: (counts[phrase[i]], i))
    return any(
        words[at] == phrase[offset] and all(any(0 <= p < len(words) and words[p] == w for p in range(at - offset + i - slack, at - offset + i + slack + 1)) for i, w in enumerate(phrase))
        for at in range(len(words))
    )


def test_proximity_against_brute_force(spark):
    """Many documents share a block, and a word may stand near its place in a neighbouring document."""
    rng = np.random.default_rng(3)
    texts = [list(map(str, rng.choice(list("abcdef"), rng.integers(1, 14)))) for _ in range(150)]
    phrases = [list(map(str, rng.choice(list("abcdefg"), 4, replace=False))) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(map(" ".join, texts))), "doc_id long, text string").coalesce(2)
    bench = spark.createDataFrame(list(enumerate(map(" ".join, phrases))), "item_id long, text string")
    halves = [x.doc_id for x in docs.where(F.spark_partition_id() == 0).collect()]
    for slack in (0, 1, 2, 5):
        got = {x["doc_id"]: x["items"] for x in phrase_matches(docs, bench, 4, slack=slack).collect()}
        for block in (halves, [i for i in range(len(texts)) if i not in set(halves)]):
            counts = Counter(w for i in block for w in texts[i])  # the rarest word is the block's
            for i in block:
                assert got[i] == sorted(str(k) for k, x in enumerate(phrases) if near_by_brute_force(texts[i], x, slack, counts)), (i, slack)


def test_a_place_in_a_neighbouring_document(spark):
    """The nearer place of a word lies in the document before, or both nearer ones do; a farther one in the document counts."""
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    for texts in (["b a c"], ["q a", "b a c"], ["a a a", "b a c", "a a a"], ["x", "b a c", "a"]):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
        got = {x["doc_id"]: (x["starts"], x["ends"]) for x in phrase_matches(docs, bench, 3, slack=2).collect()}
        assert got[texts.index("b a c")] == ([0], [3])


def classes_by_brute_force(rows):
    k, w, f = N.shingles(pa.array([t for _, t in rows], pa.string()))
    bags = [(k[a:b], w[a:b]) for a, b in zip(f[:-1], f[1:])]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    live = [(d, b) for (d, t), b in zip(rows, bags) if d is not None and len(b[0])]
    for i, (d, a) in enumerate(live):
        for e, b in live[:i]:
            if N.probability_jaccard(a, b) >= N.SIMILAR:
                x, y = sorted((find(d), find(e)))
                root[y] = x
    return {d: find(d) for d, _ in rows if d is not None}


def test_near_classes(documents, rows, nothing):
    want = classes_by_brute_force(rows)
    got = N.near_classes(documents).collect()
    assert len(got) == len(rows)
    assert all(x["class_id"] == (None if x["doc_id"] is None else want[x["doc_id"]]) for x in got)
    assert want[90006] == 90005 and want[90001] == 90001 and want[90002] == 90002
    assert N.near_classes(nothing).count() == 0


def test_an_id_with_several_texts(spark):
    """Each text keeps its own links, and the id ties the classes of its texts together."""
    rng = np.random.default_rng(6)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    first, second = word(80), word(80)
    near = lambda x: " ".join([*x[:-1], "changed"])
    pair = [(5, " ".join(first)), (9, near(first))]
    both = [*pair, (5, " ".join(second)), (5, None), (3, near(second)), (70, " ".join(word(80)))]
    for rows in (pair, both, both[::-1], [*both, *both]):
        got = N.near_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        want = classes_by_brute_force(rows)
        assert {x["doc_id"]: x["class_id"] for x in got if x["doc_id"] != 5} == {d: c for d, c in want.items() if d != 5} and want[9] == min(d for d, _ in rows if d < 70)
        assert sorted(x["class_id"] for x in got if x["doc_id"] == 5) == sorted(5 if t is None else want[5] for d, t in rows if d == 5)


def test_hot_buckets_are_cut_and_lose_no_link(spark, monkeypatch):
    """A star: copies that are near their source, some of them less than 0.8 alike to each other; cells smaller than the bucket."""
    monkeypatch.setattr(N, "CELL", 7)
    rng = np.random.default_rng(5)
    source = [f"w{i}" for i in rng.integers(0, 10_000, 200)]
    texts = [" ".join(source)]
    for _ in range(40):
        own = list(source)
        for at in rng.integers(0, 200, 5):
            own[at] = f"x{rng.integers(0, 10**6)}"
        texts.append(" ".join(own))
    rows = list(enumerate(texts, 100)) + [(7, "something else altogether that no one wrote before")]
    want = classes_by_brute_force(rows)
    got = {x["doc_id"]: x["class_id"] for x in N.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_probability_jaccard_against_its_definition():
    rng = np.random.default_rng(0)
    for _ in range(100):
        a, b = ({int(k): int(v) for k, v in zip(rng.integers(0, 30, 12), rng.integers(1, 5, 12))} for _ in range(2))
        want = sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in {*a, *b}) for i in {*a} & {*b})
        one, two = (tuple(np.array(x) for x in zip(*sorted(c.items()))) for c in (a, b))
        assert abs(N.probability_jaccard(one, two) - want) < 1e-9


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 9), (5, 4), (7, 7), (20, 30), (30, 40), (40, 50), (50, 60)]
    got = {tuple(x) for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (9, 1), (4, 4), (5, 4), (20, 20), (30, 20), (40, 20), (50, 20), (60, 20)}


def test_components_with_further_links(spark, monkeypatch):
    """Stars need no round, and further links none over those that are settled."""
    table, written = lambda links: spark.createDataFrame(links, "a long, b long"), []
    monkeypatch.setattr(C, "stash", lambda df, label, own=C.stash: written.append(label) or own(df, label))
    links, more = [(8, 2), (2, 3), (12, 10), (11, 10), (20, 21)], [(3, 11), (30, 31), (31, 12), (40, 41)]
    found = components(table(links[:1] + links[2:]))
    assert written == ["links"] and {tuple(x) for x in found.collect()} == {(8, 2), (2, 2), (10, 10), (11, 10), (12, 10), (20, 20), (21, 20)}
    found = components(table(links))
    got = {tuple(x) for x in C.joined(found, table(more)).collect()}
    assert got == {tuple(x) for x in components(table(links + more)).collect()} and (31, 2) in got and (21, 20) in got
    assert {tuple(x) for x in C.joined(found, table([])).collect()} == {tuple(x) for x in found.collect()}
    assert components(table([])).count() == 0


def passages_by_brute_force(rows):
    seen, out = defaultdict(set), {}
    texts = {(d, t): cut(t) for d, t in rows if t is not None}
    for k, w in texts.items():
        for j in range(len(w) - LEAST + 1):
            seen[tuple(w[j : j + LEAST])].add(k)
    for k, w in texts.items():
        spans = []
        for j in range(len(w) - LEAST + 1):
            if len(seen[tuple(w[j : j + LEAST])]) > 1:
                if spans and j <= spans[-1][1]:
                    spans[-1][1] = j + LEAST
                else:
                    spans.append([j, j + LEAST])
        if spans:
            out[k[0]] = ",".join(f"{a}:{b}" for a, b in spans)
    return out


def test_repeated_passages(spark, rows, nothing):
    short = [(d, t) for d, t in rows if t is None or len(t) < 100_000]
    rng = np.random.default_rng(2)
    word = lambda n: [f"u{x}" for x in rng.integers(0, 10**7, n)]
    shared = word(60)
    planted = [(70_000 + i, " ".join(word(30 + i) + shared[: 50 + i] + word(20))) for i in range(6)]
    table = short + planted
    got = {x["doc_id"]: x["spans"] for x in passage_report(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert got == passages_by_brute_force(table) and {70_000, 70_005} <= set(got)
    assert repeated_passages(nothing).count() == 0


def test_passages_between_partial_copies(spark):
    """Two documents share 52 words; many others hold the first 48 of them or the last 48, and stand between the two in every order."""
    rng = np.random.default_rng(8)
    word = lambda n: [f"v{x}" for x in rng.integers(0, 10**7, n)]
    texts, whole = [], set()
    for _ in range(5):
        shared = word(52)
        for part in [shared] * 2 + [shared[:48], shared[4:]] * 15:
            if part is shared:
                whole.add(len(texts))
            texts.append(" ".join(word(40) + part + word(40)))
    table = list(enumerate(texts))
    got = {x["doc_id"]: x["spans"] for x in passage_report(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert got == passages_by_brute_force(table) and set(got) == whole


def test_passages_of_texts_made_of_few_parts(spark):
    """Texts are random rows of a few parts, so that matches begin and end everywhere, repeat within a text, and rows repeat."""
    rng = np.random.default_rng(12)
    parts = [[f"p{x}" for x in rng.integers(0, 10**7, n)] for n in rng.integers(6, 45, 14)]
    texts = [" ".join(w for k in rng.integers(0, len(parts), rng.integers(2, 9)) for w in parts[k]) for _ in range(90)]
    table = list(enumerate(texts)) + [(3, texts[3])] * 5 + [(200, texts[4]), (201, " ".join(parts[0] * 30))]
    got = {x["doc_id"]: x["spans"] for x in passage_report(spark.createDataFrame(table, "doc_id long, text string").repartition(5)).collect()}
    want = passages_by_brute_force(table)
    assert got == want and len(want) > 50


def test_neighbours_are_found_over_the_seams_of_tasks(spark):
    rows = [(k, b, 1 + b % 3, 1 + b % 3, [b], [b // 2, b]) for k in range(3) for b in range(50)]
    entries = spark.createDataFrame(rows, ENTRIES).repartition(7)
    got = neighbours(entries, ["key", "right", "block"], "t").collect()
    assert sorted((x.key, x.block) for x in got) == sorted((k, b) for k in range(3) for a in range(49) for b in (a, a + 1))
    assert {x.to_right for x in got} == {0, 1} and all(x.apart for x in got)


def test_long_and_periodic_texts(documents):
    assert {x["doc_id"] for x in repeated_passages(documents.where("doc_id >= 90000")).collect()} == set()


def by_hand(vectors, k):
    usable = {}
    for i, v in vectors:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            usable.setdefault(i, tuple(int(np.floor(256 * float(x))) for x in v))
    out = []
    for q, a in usable.items():
        if q % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in usable.items() if i != q and len(b) == len(a))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def test_top_products(spark, sf_dir):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=6), 2)]) for i in range(400)]
    rows += [(i, [0.5] * 6) for i in range(400, 520)]  # ties
    rows += [(550, None), (600, [1.0, None] * 3), (601, [float("nan")] * 6), (602, [float("inf")] * 6), (None, [1.0] * 6), (3, rows[3][1]), (650, []), (700, [1.0, 2.0]), (750, [3.0, -1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = sorted(tuple(x) for x in top_products(table, table.where("vec_id % 50 = 0"), 5).collect())
    assert got == by_hand(exact, 5)
    # several vectors of an id are several rows, wherever they lie; clashing columns play no part
    twice = spark.createDataFrame([(50, [0.25] * 2), (7, [1.0, 0.5]), (7, [0.5, 0.25]), (7, [1.0, 0.5]), (8, [0.75, 0.5]), (50, [None, 9.0])], "vec_id long, embedding array<double>").selectExpr("*", "1 AS score", "2 AS print", "3 AS query_id")
    for parts in (1, 2, 6):
        spread = twice.repartition(parts)
        assert [tuple(x) for x in top_products(spread, spread.where("vec_id = 50")).collect()] == [(50, 1, 7, 24576), (50, 2, 8, 20480), (50, 3, 7, 12288)]
    assert top_products(table.limit(0), table.limit(0)).count() == 0
    few = table.where("vec_id in (0, 50, 7)")
    assert few.count() == 3 and top_products(few, few.where("vec_id % 50 = 0")).count() == 4


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">a</a></li><li>b</li></ul></nav><!-- x --><div class="cookie-notice">ok?</div>
<div class="ad">Buy</div><aside>side</aside><article><header><h1>Head &amp; line</h1></header><p>One
 two&nbsp;<b>three</b>.<br>four<p>unclosed &lt;p&gt;<ul><li>first</li><li>second</li></ul><form><input>f</form><figure><img><figcaption>cap</figcaption></figure>
<section class="comments"><p>reader says</p></section></article><footer>&copy; z</footer></body></html>"""


def test_extract():
    want = "Head & line\n\nOne two three. four\n\nunclosed <p>\n\nfirst\n\nsecond\n\ncap"
    assert extract(PAGE, None) == want
    assert extract("", None) == extract("<p>", None) == ""
    assert extract("plain < text", None) == "plain < text"
    deep = "<div>" * 20_000 + "at the bottom"
    assert extract(deep, reading([deep])[1]) == "at the bottom"


def test_a_wrapper_without_telling_names():
    """No article or main element and no class word: the slots alone tell where the article is."""
    page = "<html><body><div><a>home {0}</a><a>x y z</a></div><div><h2>{0}</h2><p>{1}</p><p>{2}</p></div><div>same</div></body></html>"
    pages = [page.format(*(f"{c}{i} word" for i in range(3))) for c in "abc"]
    wrapper, rules = reading(pages)
    assert wrapper == '<html><body><div>(<a>#</a>)+</div><div><h2>#</h2>(<p>#</p>)+</div><div>"same"</div></body></html>'
    assert [extract(p, rules) for p in pages] == [f"{c}0 word\n\n{c}1 word\n\n{c}2 word" for c in "abc"]
    other = pages[0].replace("<div><a>", "<div><b>new</b></div><div><a>").replace("</body>", "<div>more</div></body>")
    assert extract(other, rules) == "a0 word\n\na1 word\n\na2 word"  # a page with more than its wrapper has


def test_paragraphs_beside_menus():
    page = "<body><div><a href=1>{3} home</a> <a>other</a></div><h1>{0}</h1><p>{1}<p>{2}<div><a>{3} link</a></div></body>"
    pages = [page.format(*(f"{c}{i} word and more" for i in range(4))) for c in "abcdef"]
    assert extract(pages[2], reading(pages)[1]) == "c0 word and more\n\nc1 word and more\n\nc2 word and more"


def test_teasers_are_not_the_article_and_fixed_text_is():
    teaser = "<article class=card><h3>{0}</h3></article>"
    page = "<body><main><article class=post><h1>{0}</h1><p>{1} " + "long text " * 20 + "</p><div>Share this</div></article>" + teaser * 3 + "</main></body>"
    pages = [page.format(f"t{c}", f"p{c}") for c in "abcdef"]
    wrapper, rules = reading(pages)
    assert "(<article.card>" in wrapper and extract(pages[1], rules) == "tb\n\npb " + ("long text " * 20).strip() + "\n\nShare this"


def test_text_of_the_article_stays_whatever_the_number_of_pages_and_part_of_a_name():
    page = "<body><article><div class=by>By the editors</div><p class='share-price'>{0} rose</p><section class='search-results'><p>{0} found</p></section><div class='share-buttons'>go</div><div class='comments_section'>{0} says</div><p>{0} text</p></article></body>"
    for n in (1, 4, 5, 6, 9):
        pages = [page.format(f"w{i}") for i in range(n)]
        assert extract(pages[0], reading(pages)[1]) == "By the editors\n\nw0 rose\n\nw0 found\n\nw0 text"


def test_groups_are_repeated_or_optional():
    one, two = "<dl><dt>a<dd>b</dl>", "<dl><dt>a<dd>c<dt>d<dd>e</dl>"
    assert reading([one, two])[0] == reading([two, one])[0] == "<dl>(<dt>#</dt><dd>#</dd>)+</dl>"
    assert reading(["<p>a", "<hr><p>b"])[0] == "(<hr></hr>)?<p>#</p>"


def matches_by_brute_force(items, signs):
    """The fewest items and elements left over, of all ways to take elements in order."""
    if not items:
        return len(signs)
    sign, optional, repeated, _ = items[0]
    best = matches_by_brute_force(items[1:], signs) + (not optional)
    for n in range(1, len(signs) + 1):
        for skipped in range(len(signs) - n + 1):
            taken = signs[skipped : skipped + n]
            if set(taken) == {sign} and (n == 1 or repeated):
                best = min(best, skipped + matches_by_brute_force(items[1:], signs[skipped + n :]))
    return best


def test_match_against_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(300):
        items = [[str(rng.choice(["a", "b"])), bool(rng.integers(2)), False, []] for _ in range(rng.integers(1, 5))]
        kids = parse("".join(f"<{rng.choice(['a', 'b'])}></a></b>" for _ in range(rng.integers(0, 5)))).kids
        taken = match(items, kids)
        assert [t for t in taken if t >= 0] == sorted({t for t in taken if t >= 0}) and all(items[t][0] == k.sign for t, k in zip(taken, kids) if t >= 0)
        left = sum(t < 0 for t in taken) + sum(not optional and i not in taken for i, (_, optional, _, _) in enumerate(items))
        assert left == matches_by_brute_force(items, [k.sign for k in kids])


def test_a_host_of_two_templates(spark):
    first, second = "<body><div class=x><p>{0} one two three</p></div><div class=y>same</div></body>", "<body><nav><a>{0}</a></nav><div class=z><p>{0} four five</p></div></body>"
    rows = [(i, "http://h.example/p", (first if i % 2 else second).format(f"w{i}"), 1, "k") for i in range(12)] + [(3, "http://h.example/p", first.format("w3"), 1, "k")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, template int, host string")
    got = sorted((x.page_id, x.text) for x in extract_main_text(pages).collect())
    assert got == sorted((i, f"w{i} one two three" if i % 2 else f"w{i} four five") for i in [*range(12), 3])
    assert host_wrappers(pages).count() == 2


def test_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    odd = spark.createDataFrame([(90_000, None, None), (90_001, "http://h.example/1", ""), (90_002, "no url", PAGE), (90_003, "http://h.example/1", "<div>" * 3000)], "page_id long, url string, html string")
    got = {x["page_id"]: x for x in extract_main_text(pages.unionByName(odd)).collect()}
    assert got[90_000]["text"] == got[90_001]["text"] == got[90_003]["text"] == "" and got[90_002]["text"].startswith("Head & line")
    for x in pages.collect():
        article = re.search("<article>(.*?)</article>", x.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[x.page_id]["text"] == "\n\n".join(b for b in blocks if b) and got[x.page_id]["n_chars"] == len(got[x.page_id]["text"])
    assert extract_main_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 3])
def test_shingles_of_short_texts(n):
    keys, weights, first = N.shingles(pa.array([" ".join("abc"[:n])]))
    assert len(keys) == (n > 0) and first.tolist() == [0, int(n > 0)]
