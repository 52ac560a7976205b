"""Main text of web pages by equivalence-class template deduction.

1. Tokens. A page is read once into tags and text blocks. A token is a tag with the path of block elements above it (names
   and classes), or a text block at its path.
2. Occurrence vectors. The vector of a token over the pages of a host says how often it is on each page. Tokens with
   equal vectors form an equivalence class. Vectors are never built: the sum of hash(page, count) over the pages stands for one,
   so a host of any size is added up with partial sums, one row per (host, path, text).
3. Template. The class of the page itself (once on every page) is the skeleton. Another class is valid if it has at least ``LARGE`` tokens
   on at least ``MIN_PAGES`` pages, each of its texts lies directly in a tag of the class, and its outermost tags lie below a tag that is
   on every page or in a valid class (or at the top of the page). So a section that some pages have is template, while the texts of a
   copied article are not: they fill paragraphs, whose tags occur elsewhere too. Text of a valid class is template text, on pages that have
   its tokens in the order of the host. Text of the skeleton is, unless its path varies: a path that also holds a text of at most half of the
   host's pages is a slot, and what near copies of an article share stays in it.
   Repeated lists (menus outside of menu elements) are paths with at least two texts, all of them on more than half of the host's pages;
   their text is template text too.
4. Slots. What is left are slots. Slots below menus, headers, footers, sidebars, notices, adverts, forms and reader comments (by element
   or by class, id and role words) are dropped, template text is dropped, and the rest is the main text: the slots below ``article`` or ``main``
   elements if the page has text there, else all. A slot is kept however rare its path is and however often its text repeats.

A template needs ``MIN_PAGES`` pages; below that only step 4's element rules apply, so copies of one article on a small host are not
mistaken for a template. If dropping template text would leave nothing, it stays.

Only path and text hashes, counts and sums are shuffled, and one row per host joins the pages; what a host's row holds is bounded by
the size of its pages, not by their number (tokens of less than 2 % of the pages are no template, and their text is kept).

Rules for odd input: null or empty html gives an empty text; a null url belongs to the host ""; unclosed and crossing tags end with their
parent; repeated rows get equal texts; an empty table an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from newsloom.llm.common import small_batches
from newsloom.session import scratch_path

MIN_PAGES = 8
RARE = 0.02
LARGE = 3

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|title|svg|iframe|object|select|math)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-z][^\s/>]*)([^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_WORD = re.compile(r"[a-z]+")

#: Elements that start and end a block.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never main text.
DROPPED = frozenset("aside button dialog fieldset footer form head header menu nav".split())
#: Words of class, id and role that mark the same.
MARKS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe subscription signup login nav navbar navigation menu breadcrumb breadcrumbs sidebar "
    "widget share sharing social related recommended footer header masthead comment comments disqus replies reply form search toolbar "
    "pagination pager copyright contentinfo complementary".split()
)
#: Elements an element of the same group ends.
_ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}}
_SCOPES = frozenset("ul ol dl table article section div main nav aside header footer form body".split())


@dataclass
class Block:
    path: int
    text: str
    main: bool
    dropped: bool


@dataclass
class Page:
    """Counts of the tags by path, the path above each and its first place, and the text blocks, of one page."""

    tags: Counter = field(default_factory=Counter)
    above: dict[int, int] = field(default_factory=dict)
    places: dict[int, int] = field(default_factory=dict)
    blocks: list[Block] = field(default_factory=list)


def _hash(*parts) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(map(str, parts))) - (1 << 63)


_paths: dict[tuple, int] = {}


def _path(parent: int, name: str, marks: str) -> int:
    key = (parent, name, marks)
    got = _paths.get(key)
    if got is None:
        if len(_paths) > 100_000:
            _paths.clear()
        got = _paths[key] = _hash(*key)
    return got


def read_page(source: str | None) -> Page:
    """Tokens of a page."""
    page = Page()
    if not source:
        return page
    # Open block elements: (name, path, in main, dropped).
    stack: list[tuple[str, int, bool, bool]] = [("", _path(0, "", ""), False, False)]
    text: list[str] = []

    def flush() -> None:
        if text:
            whole = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if whole:
                _, path, main, dropped = stack[-1]
                page.blocks.append(Block(path, whole, main, dropped))
                if not dropped:
                    page.places.setdefault(_hash(path, whole), len(page.places))

    def close(names: set[str], within: frozenset[str] | None = None) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                del stack[i:]
                return
            if within and stack[i][0] in within:
                return

    end = 0
    for m in _TOKEN.finditer(source):
        if m.start() > end:
            text.append(source[end : m.start()])
        end = m.end()
        closing, name, attributes = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if name is None:
            if m[1] and m[1].lower() not in ("script", "style", "title"):
                text.append(" ")
            continue
        name = name.lower()
        if closing:
            if name in BLOCKS:
                flush()
                close({name})
            elif any(name == entry[0] for entry in stack[-3:]):
                flush()
                close({name})
            elif name == "br":
                text.append(" ")
            continue
        words: list[str] = []
        if attributes and ("=" in attributes):
            words = [w for a in _ATTRIBUTE.finditer(attributes) for w in _WORD.findall((a[2] or a[3] or a[4] or "").lower())]
        marked = any(w in MARKS for w in words)
        if name not in BLOCKS and not (marked and name not in VOID):
            if name in VOID:
                text.append(" ")
            continue
        flush()
        if name in BLOCKS:
            if name != "p" and stack[-1][0] == "p":
                close({"p"})
            if name in _ENDS:
                close(_ENDS[name], _SCOPES - _ENDS[name])
        _, parent, main, dropped = stack[-1]
        path = _path(parent, name, " ".join(words[:4]) if not any(len(w) > 20 for w in words) else "")
        page.tags[path] += 1
        page.above[path] = parent
        page.places.setdefault(path, len(page.places))
        if name in VOID or attributes.endswith("/") and name not in BLOCKS:
            continue
        stack.append((name, path, main or name in ("article", "main") or "main" in words, dropped or name in DROPPED or (marked and name not in ("html", "body", "article", "main") or marked and bool({"comment", "comments", "reply", "related", "ad", "ads"} & set(words)))))
    if end < len(source):
        text.append(source[end:])
    flush()
    return page


@dataclass
class Template:
    """What a host's pages have in common: hashes of (path, text) that are template, the other valid classes as tokens in order (a
    tag is its path, a text the hash of path and text)."""

    fixed: frozenset[int] = frozenset()
    classes: tuple[tuple[int, ...], ...] = ()


def main_text(page: Page, template: Template = Template()) -> str:
    """The main text of a page under its host's template."""
    kept = [b for b in page.blocks if not b.dropped]
    if any(b.main for b in kept):
        kept = [b for b in kept if b.main]
    fixed = set(template.fixed)
    for tokens in template.classes:
        places = [page.places.get(t, -1) for t in tokens]
        if places[0] >= 0 and all(a < b for a, b in zip(places, places[1:])):
            fixed.update(tokens)
    if fixed:
        varying = [b for b in kept if _hash(b.path, b.text) not in fixed]
        kept = varying or kept
    return "\n\n".join(b.text for b in kept)


def host_of(url: str | None) -> str:
    """Host of a url, in lower case; "" without one."""
    rest = (url or "").partition("://")[2]
    return re.split(r"[/?#]", rest, maxsplit=1)[0].lower()


_TOKENS = "host string, path bigint, text bigint, vector bigint, n bigint, above bigint, place bigint"
_MASK = (1 << 64) - 1


def occurrences(pages: DataFrame) -> DataFrame:
    """(host, path, text, vector, pages, n, above, place): a row per token of a host; text is 0 for tags, path and text are 0 for the page
    itself. Equal vectors (with equal pages) mean equal occurrence on all pages; place is the sum of the first places, so the tokens
    of a class that keep one order have it by place."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in small_batches(batches):
            rows: list[tuple] = []
            for url, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                host, page = host_of(url), read_page(source)
                own = _hash(url, len(source or ""), xxhash.xxh3_64_intdigest(source or ""))
                once = _hash(own, 1) >> 16
                rows.append((host, 0, 0, once, 1, 0, 0))
                for path, n in page.tags.items():
                    rows.append((host, path, 0, once if n == 1 else _hash(own, n) >> 16, n, page.above[path], page.places[path]))
                texts = Counter((b.path, b.text) for b in page.blocks if not b.dropped)
                for (path, text), n in texts.items():
                    token = _hash(path, text)
                    rows.append((host, path, token, once if n == 1 else _hash(own, n) >> 16, n, path, page.places[token]))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = (pa.string(), *[pa.int64()] * 6)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["host", "path", "text", "vector", "n", "above", "place"])

    tokens = pages.select(F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, _TOKENS)
    # Vectors are 48-bit hashes: their sum cannot overflow below 2^16 pages and wraps harmlessly above.
    return tokens.groupBy("host", "path", "text").agg(
        F.sum(F.col("vector").cast("decimal(38,0)")).alias("vector"),
        F.count(F.lit(1)).alias("pages"),
        F.sum("n").alias("n"),
        F.min("above").alias("above"),
        F.sum("place").alias("place"),
    )


@dataclass
class Token:
    path: int
    text: int
    above: int
    place: int
    group: str
    everywhere: bool

    @property
    def id(self) -> int:
        return self.text or self.path


def valid_classes(tokens: list[Token]) -> list[list[int]]:
    """The valid classes with text among a host's tokens, in order of place; see the module text. The skeleton is not among them."""
    groups: dict[str, list[Token]] = {}
    for token in tokens:
        groups.setdefault(token.group, []).append(token)
    grounds = {_path(0, "", "")} | {t.path for t in tokens if t.everywhere and not t.text}
    waiting = []
    for group in groups.values():
        tags = {t.path for t in group if not t.text}
        if len(group) >= LARGE and tags and all(t.path in tags for t in group if t.text):
            waiting.append((sorted(group, key=lambda t: (t.place, t.id)), tags))
    valid = []
    while True:
        ready = [w for w in waiting if all(t.above in w[1] or t.above in grounds for t in w[0])]
        if not ready:
            return sorted(valid)
        waiting = [w for w in waiting if w not in ready]
        for group, tags in ready:
            grounds |= tags
            if any(t.text for t in group):
                valid.append([t.id for t in group])


def templates(pages: DataFrame) -> DataFrame:
    """(host, fixed, classes) for hosts of at least MIN_PAGES pages."""
    # Several sums are taken over the tokens; kept in the shared folder, they cost one reading of the pages.
    spark, path = pages.sparkSession, scratch_path(pages.sparkSession, "tokens")
    occurrences(pages).write.parquet(path)
    tokens = spark.read.parquet(path)
    hosts = tokens.where("path = 0").select("host", F.col("pages").alias("all_pages"), F.col("vector").alias("page_vector")).where(F.col("all_pages") >= MIN_PAGES)
    known = tokens.where("path <> 0").join(hosts, "host")
    texts = known.where("text <> 0")
    skeleton = (F.col("vector") == F.col("page_vector")) & (F.col("pages") == F.col("all_pages"))
    # Steady paths: all of their texts are on most pages. One text that is not makes the path a slot. With several texts they are lists.
    lists = texts.groupBy("host", "path").agg(F.min("pages").alias("least"), F.count(F.lit(1)).alias("kinds"), F.max("all_pages").alias("all_pages"))
    steady = lists.where(F.col("least") * 2 > F.col("all_pages")).select("host", "path", F.when(F.col("kinds") > 1, F.col("path")).alias("menu"))
    # Tokens of too few pages are in no valid class; the others of a host are at most 1 / RARE times those of an average page.
    frequent = known.where((F.col("pages") >= MIN_PAGES) & (F.col("pages") >= F.col("all_pages") * RARE)).select(
        "host",
        F.struct(
            "path", "text", "above", "place", F.concat_ws(" ", F.col("vector").cast("string"), "pages").alias("grp"),
            (F.col("pages") == F.col("all_pages")).alias("everywhere"), skeleton.alias("skeleton"),
        ).alias("token"),
    )
    token = frequent.schema["token"].dataType
    none = F.lit(None).cast("bigint")
    gathered = frequent.select("host", "token", none.alias("path"), none.alias("menu")).union(steady.select("host", F.lit(None).cast(token), "path", "menu"))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in small_batches(batches, 16):
            fixed, classes = [], []
            for found, steady_, menus in zip(batch.column(1).to_pylist(), *(map(set, batch.column(i).to_pylist()) for i in (2, 3)), strict=True):
                fixed.append(sorted(t["text"] for t in found if t["text"] and (t["skeleton"] and t["path"] in steady_ or t["path"] in menus)))
                classes.append(valid_classes([Token(t["path"], t["text"], t["above"], t["place"], "" if t["skeleton"] else t["grp"], t["everywhere"]) for t in found if not (t["skeleton"] and t["text"])]))
            kinds = pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fixed, kinds[0]), pa.array(classes, kinds[1])], names=["host", "fixed", "classes"])

    return gathered.groupBy("host").agg(F.collect_list("token").alias("tokens"), F.collect_set("path").alias("steady"), F.collect_set("menu").alias("menus")).mapInArrow(run, "host string, fixed array<bigint>, classes array<array<bigint>>")


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    named = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rest = F.regexp_extract(F.substring("url", F.instr("url", "://") + 3, F.lit(2147483647)), r"^([^/?#]*)", 1)
    host = F.coalesce(F.when(F.instr("url", "://") > 0, F.lower(rest)), F.lit(""))
    joined = named.withColumn("host", host).join(templates(pages), "host", "left").select("page_id", "url", "html", "fixed", "classes")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in small_batches(batches):
            known: dict[tuple, Template] = {}
            texts = []
            for source, fixed, classes in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                key = (tuple(fixed or ()), tuple(map(tuple, classes or ())))
                template = known.get(key) or known.setdefault(key, Template(frozenset(key[0]), key[1]))
                texts.append(main_text(read_page(source), template))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string"
    return joined.mapInArrow(run, schema).withColumn("n_chars", F.length("text").cast("bigint"))
