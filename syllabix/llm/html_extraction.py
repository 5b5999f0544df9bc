"""Main text of web pages by wrappers inferred per host."""

from __future__ import annotations

from functools import lru_cache, reduce
from math import ceil

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syllabix.functions.joins import lookup_join
from syllabix.llm.common import map_batches
from syllabix.llm.html_tree import GROUP, INLINE, TEXT, Node, folded, match, merge, raw_tree, read, relabelled, walk
from syllabix.session import pin, ship_package, spread

# Fixed words: elements and class, id or role words of what is not the article.
OUTSIDE_TAGS = frozenset("nav header footer aside form button select option menu dialog head fieldset".split())
OUTSIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs comment comments "
    "commentlist commenter consent cookie cookies copyright disclaimer disqus dialog footer form gdpr header login masthead "
    "menu menus modal nav navbar navigation newsletter notice notices notification pagination pager popup privacy promo promoted "
    "recommended related reply replies respond search share sharing sidebar sidebars signup social sponsor sponsored subscribe "
    "subscription tags toolbar topbar widget widgets".split())
MAIN_TAGS = frozenset("article main".split())
MAIN_WORDS = frozenset("article articlebody content main maincontent post postbody entry story text body".split())
# Elements that may stand for the whole page, so that their words say nothing about a part.
WHOLE = frozenset("html body page".split())
# Elements whose text may be the same on all pages and still belong to the article, if they stand in it.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 th td dt dd caption figcaption".split())
# Elements that can hold an article, and those of which several in a row are entries of a list.
REGIONS = frozenset("html body page div section article main td center".split())
ENTRIES = frozenset("div section li".split())
# A slot with one text on at least so many different pages of a host belongs to the template.
TEMPLATE_PAGES = 5
# Part of the varying text that an element must hold to be the place of the article.
REGION_SHARE = 0.6
# A repeated entry's text counts one in so many, and template text is known from varying text of at least one in so many characters.
ENTRY_WEIGHT, LEAST_VARYING = 4, 10
# Words of labels on fewer than one in so many of the host's pages are left out of its expression.
RARE_WORD = 20
# Expressions that one task joins at a time, and parts that a wrapper keeps.
JOINED, MAX_PARTS = 32, 1_000


def host_of(url: str = "url") -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1))


def words_of(label: str) -> set[str]:
    """The whole class, id and role words of a label, without numbers at their ends."""
    return {w.rstrip("-_0") for w in label.split(".")[1:]}


def tag_of(label: str) -> str:
    return label.partition(".")[0]


def named_outside(label: str) -> bool:
    """Whether a word of the element says that it does not belong to an article."""
    return tag_of(label) not in WHOLE and bool(words_of(label) & OUTSIDE_WORDS)


def main_depth(label: str) -> int:
    """2 for article and main elements, 1 for one whose class says so, 0 otherwise."""
    if tag_of(label) in MAIN_TAGS:
        return 2
    return int(tag_of(label) not in WHOLE and bool(words_of(label) & MAIN_WORDS))


def outside_parts(root: Node, chars: dict[int, int]) -> set[int]:
    """Identities of the parts that tags or words put outside the article, with all below them.

    Tags decide, but for a header inside a main element. A word never drops an element that
    is or holds an article or main element, nor, where there is none, the greater part of
    the text (``chars`` by identity of text parts).
    """
    holds: dict[int, bool] = {}
    weight: dict[int, int] = {}
    for node in reversed(list(walk(root))):
        holds[id(node)] = tag_of(node.label) in MAIN_TAGS or any(holds[id(c)] for c in node.children)
        weight[id(node)] = chars.get(id(node), 0) + sum(weight[id(c)] for c in node.children)
    half, out = weight[id(root)], set()

    def visit(node: Node, inside: bool, gone: bool) -> None:
        tag = tag_of(node.label)
        if not gone:
            gone = tag in OUTSIDE_TAGS and not (inside and tag == "header")
            if not gone and named_outside(node.label):
                major = not holds[id(root)] and 2 * weight[id(node)] > half
                gone = not (holds[id(node)] or major)
        if gone:
            out.add(id(node))
        for child in node.children:
            visit(child, inside or tag in MAIN_TAGS, gone)

    visit(root, False, False)
    return out


def _text_parts(root: Node) -> list[Node]:
    return [n for n in walk(root) if n.label == TEXT]


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


# First sign of a piece of text: whether a border of a block stands before it.
BORDER, NO_BORDER = " ", "-"
PAGE_SCHEMA = (
    "page_id {0}, url string, host string, page bigint, shape string, shape_key bigint, texts array<struct<text: bigint, chars: int>>, "
    "parts array<int>, pieces array<string>")


def _read_pages(columns: dict[str, list]) -> dict[str, list]:
    """The one parse of a page: its elements, its text parts, and its pieces of text in page order with the numbers of their parts."""
    out: dict[str, list] = {c: columns[c] for c in ("page_id", "url", "host")}
    out |= {c: [] for c in ("page", "shape", "shape_key", "texts", "parts", "pieces")}
    for html in columns["html"]:
        root, items = raw_tree(html)
        number = {id(n): k for k, n in enumerate(_text_parts(root))}
        whole: list[list[str]] = [[] for _ in number]
        parts: list[int] = []
        pieces: list[list[str]] = []
        border = False
        for kind, part, value in items:
            if kind == "border":
                border = True
                continue
            k = number[id(part)]
            whole[k].append(" ".join(value.split()))
            if border or not parts or parts[-1] != k:
                parts.append(k)
                pieces.append([BORDER if border else NO_BORDER])
                border = False
            pieces[-1].append(value)
        texts = ["\n".join([*w, ""]) for w in whole]
        shape = root.write()
        out["page"].append(_hash("\0".join(texts)))
        out["shape"].append(shape)
        out["shape_key"].append(_hash(shape))
        out["texts"].append([{"text": _hash(t), "chars": len(t)} for t in texts])
        out["parts"].append(parts)
        out["pieces"].append(["".join(p) for p in pieces])
    return out


def read_pages(pages: DataFrame, html: str = "html", url: str = "url", page_id: str = "page_id") -> DataFrame:
    """Every page read once and written out: all that follows works on these rows."""
    rows = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"), host_of(url).alias("host"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    return pin(map_batches(rows, _read_pages, PAGE_SCHEMA.format(pages.schema[page_id].dataType.simpleString())))


def _words(columns: dict[str, list]) -> dict[str, list]:
    words = [sorted({w for n in walk(read(shape)) for w in n.label.split(".")[1:]}) for shape in columns["shape"]]
    return {"host": columns["host"], "words": words, "n": columns["n"]}


def _expressions(columns: dict[str, list]) -> dict[str, list]:
    written = [
        folded(relabelled(read(shape), set(kept or ()))).write()
        for shape, kept in zip(columns["shape"], columns["kept"], strict=True)]
    return {"host": columns["host"], "wrapper": written}


def _coarse(root: Node) -> Node:
    """The expression down to a depth at which it has no more than ``MAX_PARTS`` parts."""
    level, total = [root], 1
    while level:
        below = [c for n in level for c in n.children]
        total += len(below)
        if total > MAX_PARTS:
            for node in level:
                node.children = []
        level = [c for n in level for c in n.children]
    return root


def _joined(rows: pd.DataFrame) -> pd.DataFrame:
    whole = _coarse(reduce(merge, map(read, sorted(rows["wrapper"]))))
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "wrapper": [whole.write()]})


def _one_per_host(expressions: DataFrame) -> DataFrame:
    """Joins a host's expressions, ``JOINED`` at a time, in as many rounds as their number needs."""
    while True:
        counted = expressions.groupBy("host").agg(F.count(F.lit(1)).alias("_n"))
        most = counted.agg(F.max("_n")).first()[0] or 0
        parts = F.ceil(F.col("_n") / JOINED)
        dealt = lookup_join(expressions, counted, ["host"]).withColumn("_part", F.pmod(F.xxhash64("wrapper"), parts))
        joined = dealt.groupBy("host", "_part").applyInPandas(_joined, "host string, wrapper string")
        expressions = pin(joined.distinct())
        if ceil(most / JOINED) <= 1:
            return expressions


@lru_cache(maxsize=200)
def _wrapper(written: str) -> tuple[Node, dict[int, int]]:
    """A wrapper and the numbers of its parts."""
    root = read(written)
    return root, {id(n): i for i, n in enumerate(walk(root))}


def aligned(raw: Node, wrapper: Node, numbers: dict[int, int]) -> dict[int, int]:
    """Number of the wrapper's part for every part of the page; one without has the number of the part around it."""
    kept = {w for n in walk(wrapper) for w in n.label.split(".")[1:]}
    plain = relabelled(raw, kept)
    pairs = {id(a): numbers[id(b)] for a, b in match(plain, wrapper)}
    found: dict[int, int] = {}
    stack = [(raw, plain, 0)]
    while stack:
        node, same, around = stack.pop()
        found[id(node)] = at = pairs.get(id(same), around)
        # Texts are one object in both trees.
        stack.extend((c, d, at) for c, d in zip(node.children, same.children, strict=True))
    return found


def _aligned(columns: dict[str, list]) -> dict[str, list]:
    """Slots of all parts of a shape, and of its text parts."""
    out: dict[str, list] = {c: columns[c] for c in ("host", "shape_key", "shape")} | {"slots": [], "text_slots": []}
    for shape, written in zip(columns["shape"], columns["wrapper"], strict=True):
        raw = read(shape)
        slot_of = aligned(raw, *_wrapper(written))
        nodes = list(walk(raw))
        out["slots"].append([slot_of[id(n)] for n in nodes])
        out["text_slots"].append([slot_of[id(n)] for n in nodes if n.label == TEXT])
    return out


def _observed(columns: dict[str, list]) -> dict[str, list]:
    out: dict[str, list] = {"host": columns["host"], "slots": []}
    for slots, texts in zip(columns["text_slots"], columns["texts"], strict=True):
        seen: dict[int, list] = {}
        for slot, text in zip(slots, texts, strict=True):
            seen.setdefault(slot, []).append(text)
        out["slots"].append([
            {"slot": s, "text": _hash(str([t["text"] for t in ts])), "chars": sum(t["chars"] for t in ts)} for s, ts in seen.items()])
    return out


def locate(wrapper: Node, numbers: dict[int, int], slots: dict[int, tuple[bool, int]]) -> tuple[int, list[int]]:
    """Number of the part that holds the article (0 if none does), and of the parts that are template or lists of links.

    ``slots`` has, by number, whether the text is the same on all of the host's pages and how
    many characters it has on all together. From the top, the part with the most varying
    text is entered while it holds ``REGION_SHARE`` of it and leaves no varying h1 beside it.
    Text in repeated entries counts one in ``ENTRY_WEIGHT``; text in links and in parts that words
    put outside counts only where there is no other. A main element without varying text is no template. Words settle the rest: an article or main element around the
    place, or the only one in it, is taken instead.
    """
    nodes = list(walk(wrapper))
    below: dict[int, list[int]] = {}
    varying = [0] * len(nodes)
    linked, total, single = [0] * len(nodes), [0] * len(nodes), [True] * len(nodes)
    for at, (fixed, chars) in slots.items():
        total[at], varying[at], single[at] = chars, 0 if fixed else chars, fixed
    chars = {id(n): varying[i] for i, n in enumerate(nodes)}
    outside = outside_parts(wrapper, chars)
    parent: dict[int, int] = {}
    for i, node in enumerate(nodes):
        below[i] = [numbers[id(c)] for c in node.children]
        parent.update(dict.fromkeys(below[i], i))

    def above(i: int) -> list[int]:
        return [i, *above(parent[i])] if i in parent else [i]

    def entry(i: int) -> bool:
        return any(tag_of(nodes[k].label) in ENTRIES and (nodes[k].repeated or nodes[parent.get(k, k)].label == GROUP) for k in above(i))

    plain, heads = [0.0] * len(nodes), [False] * len(nodes)
    for i in slots:
        tags = {tag_of(nodes[k].label) for k in above(i)}
        if "a" in tags:
            linked[i] = total[i]
        if id(nodes[i]) not in outside and varying[i] and "a" not in tags:
            plain[i], heads[i] = varying[i] / ENTRY_WEIGHT if entry(i) else varying[i], "h1" in tags
    if not any(plain):
        plain = [v if id(n) not in outside else 0.0 for v, n in zip(varying, nodes, strict=True)]
    for i in range(len(nodes) - 1, 0, -1):
        up = parent[i]
        plain[up] += plain[i]
        linked[up] += linked[i]
        total[up] += total[i]
        heads[up] = heads[up] or heads[i]
        if total[i]:
            single[up] = single[up] and single[i]
    at = 0
    while below[at]:
        best = max(below[at], key=lambda i: plain[i])
        label = tag_of(nodes[best].label)
        beside = any(heads[i] for i in below[at] if i != best)
        if (label not in REGIONS and nodes[best].label != GROUP) or plain[best] < REGION_SHARE * max(plain[at], 1) or beside:
            break
        at = best
    named = [i for i, n in enumerate(nodes) if main_depth(n.label) == 2 and id(n) not in outside and plain[i]]
    around = [i for i in above(at) if i in named]
    within = [i for i in named if at in above(i) and not any(k in named for k in above(i)[1:])]
    if around:
        at = around[0]
    elif len(within) == 1:
        at = within[0]
    while nodes[at].label == GROUP:
        at = parent[at]
    if tag_of(nodes[at].label) in WHOLE:
        at = 0
    for i, node in enumerate(nodes):
        if main_depth(node.label) == 2 and single[i]:
            for part in walk(node):
                single[numbers[id(part)]] = False
    dropped = [
        i for i, n in enumerate(nodes)
        if i and total[i] and n.label not in (TEXT, GROUP) and tag_of(n.label) not in INLINE and tag_of(n.label) not in WHOLE
        and i not in above(at)
        and ((single[i] and tag_of(n.label) not in HEADINGS) or (linked[i] > 0.5 * total[i] and tag_of(n.label) in {"ul", "ol", "div", "section", "li"}))]
    return at, dropped


def _decided(columns: dict[str, list]) -> dict[str, list]:
    out: dict[str, list] = {"host": columns["host"], "wrapper": columns["wrapper"], "region": [], "dropped": []}
    for written, slots in zip(columns["wrapper"], columns["slots"], strict=True):
        known = {s["slot"]: (s["low"] == s["high"] and s["pages"] >= TEMPLATE_PAGES, s["chars"]) for s in slots or ()}
        if LEAST_VARYING * sum(c for fixed, c in known.values() if not fixed) < sum(c for fixed, c in known.values() if fixed):
            # Next to nothing differs, as among copies of one article: no place is called fixed.
            known = {s: (False, c) for s, (_, c) in known.items()}
        region, dropped = locate(*_wrapper(written), known)
        out["region"].append(region)
        out["dropped"].append(dropped)
    return out


def infer_wrappers(pages: DataFrame, html: str = "html", url: str = "url", page_id: str = "page_id") -> DataFrame:
    """``host``, ``wrapper``, ``region`` (the wrapper's part that holds the article, by number, 0 if none
    does) and ``dropped`` (its parts that are template or links), one row per host.

    Pages with the same texts count once. Every page's elements are folded into an
    expression of tags and of the class, id and role words found on enough of the host's
    pages: text becomes a slot and runs of like siblings a repeated group. The distinct
    expressions of a host are aligned, ``JOINED`` at a time, and mismatches become
    optional or repeated parts; no alternatives are made, and width and number of parts
    are bounded. Then every shape (the elements of a page) is matched against the wrapper once, and per slot
    the texts and characters of all pages are summed up before the shuffle.
    """
    return _inferred(read_pages(pages, html, url, page_id))[0]


def _inferred(read_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The hosts' wrappers, and the slots of every shape of a host: ``host``, ``shape_key``, ``shape``, ``slots``, ``text_slots``."""
    ship_package(read_.sparkSession)
    # Pages of one number have the same texts.
    distinct = pin(read_.groupBy("host", "page").agg(F.min(F.struct("shape", "shape_key")).alias("s"), F.first("texts").alias("texts")).select(
        "host", "page", "s.shape", "s.shape_key", "texts"))
    counted = distinct.groupBy("host").agg(F.count(F.lit(1)).alias("_pages"))
    shapes = pin(distinct.groupBy("host", "shape_key").agg(F.min("shape").alias("shape"), F.count(F.lit(1)).alias("n")))
    listed = map_batches(shapes.select("host", "shape", "n"), _words, "host string, words array<string>, n bigint")
    words = listed.select("host", F.explode("words").alias("word"), "n").groupBy("host", "word").agg(F.sum("n").alias("_n"))
    kept = words.join(counted, "host").filter(F.col("_n") * RARE_WORD >= F.col("_pages")).groupBy("host").agg(
        F.sort_array(F.collect_list("word")).alias("kept"))
    expressions = map_batches(
        lookup_join(shapes, kept, ["host"]).select("host", "shape", "kept"), _expressions, "host string, wrapper string")
    wrappers = _one_per_host(pin(expressions.distinct()))
    # Shapes of copies that stand for no page of their own have slots as well.
    every = read_.groupBy("host", "shape_key").agg(F.min("shape").alias("shape"))
    slots = pin(map_batches(
        spread(lookup_join(every, wrappers, ["host"]).select("host", "shape_key", "shape", "wrapper")), _aligned,
        "host string, shape_key bigint, shape string, slots array<int>, text_slots array<int>"))
    met = lookup_join(distinct.select("host", "shape_key", "texts"), slots.select("host", "shape_key", "text_slots"), ["host", "shape_key"], "inner")
    observed = map_batches(met, _observed, "host string, slots array<struct<slot: int, text: bigint, chars: bigint>>")
    seen = observed.select("host", F.explode("slots").alias("s")).groupBy("host", "s.slot").agg(
        F.min("s.text").alias("low"), F.max("s.text").alias("high"), F.count(F.lit(1)).alias("pages"), F.sum("s.chars").alias("chars"))
    gathered = seen.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("slot", "low", "high", "pages", "chars"))).alias("slots"))
    decided = map_batches(
        wrappers.join(gathered, "host", "left"), _decided, "host string, wrapper string, region int, dropped array<int>")
    return pin(decided), slots


def decided_by_shape(root: Node) -> bool:
    """Whether the parts outside the article are the same whatever the lengths of the texts."""
    nodes = list(walk(root))
    return any(tag_of(n.label) in MAIN_TAGS for n in nodes) or not any(named_outside(n.label) for n in nodes)


def wanted_parts(root: Node, slots: list[int], region: int, dropped: list[int], chars: list[int]) -> list[int]:
    """Numbers of the text parts that stand in the wrapper's region, but for what is template, links or named outside.

    A page that has nothing there, or whose wrapper has no region, gives the texts of its
    deepest kind of main element, even if they are empty, and without one all others.
    """
    nodes = list(walk(root))
    slot_of = {id(n): s for n, s in zip(nodes, slots, strict=True)}
    texts = [n for n in nodes if n.label == TEXT]
    out = outside_parts(root, {id(n): c for n, c in zip(texts, chars, strict=False)})
    gone = set(dropped)
    inside: set[int] = set()
    depth: dict[int, int] = {}
    best = 0
    stack = [(root, False, 0, False)]
    while stack:
        node, found, main, lost = stack.pop()
        at = slot_of[id(node)]
        found = found or bool(region and at == region)
        lost = lost or id(node) in out or (at in gone and at != region)
        main = max(main, main_depth(node.label))
        if not lost:
            best = max(best, main)
            depth[id(node)] = main
            if found:
                inside.add(id(node))
        stack.extend((c, found, main, lost) for c in node.children)
    placed = any(id(n) in inside for n in texts)
    wanted = inside if placed else {n for n, d in depth.items() if d == best}
    return [k for k, n in enumerate(texts) if id(n) in wanted]


def _placed(columns: dict[str, list]) -> dict[str, list]:
    """The wanted parts of every shape; for a shape that lengths of texts decide on, what is needed to find them."""
    out: dict[str, list] = {c: columns[c] for c in ("host", "shape_key")} | {c: [] for c in ("wanted", "slots", "region", "dropped")}
    for shape, slots, region, dropped in zip(*(columns[c] for c in ("shape", "slots", "region", "dropped")), strict=True):
        root = read(shape)
        fixed = decided_by_shape(root)
        out["wanted"].append(wanted_parts(root, slots, region or 0, dropped or [], []) if fixed else None)
        for name, value in (("slots", slots), ("region", region or 0), ("dropped", dropped or [])):
            out[name].append(None if fixed else value)
    return out


@lru_cache(maxsize=200)
def _shape(written: str) -> Node:
    return read(written)


def _texts(columns: dict[str, list]) -> dict[str, list]:
    out = []
    names = ("parts", "pieces", "shape", "wanted", "slots", "region", "dropped")
    for parts, pieces, shape, wanted, slots, region, dropped in zip(*(columns[c] for c in names), strict=True):
        if wanted is None:
            chars = [0] * (max(parts, default=-1) + 1)
            for k, piece in zip(parts, pieces, strict=True):
                chars[k] += len(piece) - 1
            wanted = wanted_parts(_shape(shape), slots, region, dropped, chars)
        chosen = set(wanted)
        # The border in front of a piece stands, whether the piece does or not.
        whole = [piece[0].replace(NO_BORDER, "") + (piece[1:] if k in chosen else "") for k, piece in zip(parts, pieces, strict=True)]
        out.append(" ".join("".join(whole).split()))
    return {"page_id": columns["page_id"], "url": columns["url"], "text": out}


def extract_text(pages: DataFrame, html: str = "html", url: str = "url", page_id: str = "page_id") -> DataFrame:
    """``page_id``, ``url``, ``text`` of every page: the article that its host's wrapper locates.

    Every page is parsed once; its elements, texts and their borders are written out. A host's
    different shapes are aligned with its wrapper once each, and the result is put
    together from the written pieces. White space is one space, and so is the border of a block.

    A missing page is empty and a page without an article gives an empty text. Missing
    and unreadable addresses share one wrapper. Missing identifiers and repeated rows are
    extracted row by row; other columns are not read; an empty table gives no rows.
    Character references are decoded. Shapes are looked up by a measured broadcast, or
    by a shuffle where they are too many.
    """
    read_ = read_pages(pages, html, url, page_id)
    wrappers, slots = _inferred(read_)
    found = lookup_join(slots.select("host", "shape_key", "shape", "slots"), wrappers.drop("wrapper"), ["host"])
    placed = map_batches(
        found, _placed, "host string, shape_key bigint, wanted array<int>, slots array<int>, region int, dropped array<int>")
    rows = lookup_join(read_.select("page_id", "url", "host", "shape", "shape_key", "parts", "pieces"), placed, ["host", "shape_key"])
    kind = pages.schema[page_id].dataType.simpleString()
    texts = map_batches(rows.drop("host", "shape_key"), _texts, f"page_id {kind}, url string, text string")
    return texts.withColumnsRenamed({"page_id": page_id, "url": url})
