"""Body text: token estimate, truncation, tag stripping, and HTML to text or markdown.

The HTML conversions are built from JVM string functions. They cover the tags feed bodies are made
of: headings, paragraphs, breaks, emphasis, links, images, lists, quotes, code, preformatted blocks
and rules. Everything else is removed, its text kept.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, functions as F

from newsloom.errors import UsageError
from newsloom.functions.base import (
    UNICODE_SPACE,
    ColumnOrName,
    bind,
    col,
    is_blank,
    per_session,
    replace_all,
)
from newsloom.schemas import CONTENT_FORMATS

# Fixed values.
TRUNCATION_MARKER = " …[truncated]"
CHARS_PER_TOKEN = 4
TEXT_WIDTH = 80


def estimate_tokens(text: ColumnOrName) -> Column:
    """Characters over four, rounded up; 0 for null."""
    chars = F.coalesce(F.length(col(text)), F.lit(0))
    return F.floor((chars + (CHARS_PER_TOKEN - 1)) / CHARS_PER_TOKEN).cast("bigint")


def is_over(text: ColumnOrName, max_chars: int | None) -> Column:
    """Whether ``truncate_chars`` would cut the text."""
    if max_chars is None:
        return F.lit(False)
    return F.coalesce(F.length(col(text)) > max_chars, F.lit(False))


def truncate_chars(text: ColumnOrName, max_chars: int | None) -> Column:
    """First ``max_chars`` characters plus a marker, when the text is longer than that."""
    if max_chars is None:
        return col(text)
    return F.when(
        is_over(text, max_chars),
        F.concat(F.substring(col(text), 1, max_chars), F.lit(TRUNCATION_MARKER)),
    ).otherwise(col(text))


def strip_tags(html: ColumnOrName) -> Column:
    """Drop everything between ``<`` and ``>``, then collapse white space. No entity decoding.

    An unclosed ``<`` drops the rest of the text and a stray ``>`` is dropped too.
    """
    bare = F.replace(replace_all(col(html), r"<[^>]*(?:>|\z)", ""), F.lit(">"), F.lit(""))
    return F.trim(replace_all(bare, f"[{UNICODE_SPACE}]+", " "))


# One constant, so that the plan holds a single folded map instead of hundreds of literals.
_NAMED_ENTITIES = json.dumps({name[:-1]: text for name, text in html5.items() if name.endswith(";")})


def _code_point(number: Column) -> Column:
    """The character of a Unicode code point; null outside the valid range."""
    valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))


def unescape_entities(text: ColumnOrName) -> Column:
    """Decode named and numeric character references; unknown ones stay as they are."""
    named = F.from_json(F.lit(_NAMED_ENTITIES), "map<string,string>")

    def decode(token: Column) -> Column:
        name = F.rtrim(F.substring(token, 2, 2147483647), F.lit(";"))
        digits = F.regexp_extract(token, r"^&#[xX]?0*([0-9A-Fa-f]+);\z", 1)
        is_hex = token.rlike("^&#[xX]")
        number = F.when(is_hex, F.conv(digits, 16, 10)).otherwise(digits)
        return (
            F.when(token == "&amp;", F.lit("&"))
            .when(token.rlike("^&#"), F.coalesce(_code_point(number.try_cast("bigint")), token))
            .when(token.rlike("^&[A-Za-z0-9]+;"), F.coalesce(named[name], token))
            .otherwise(token)
        )

    pattern = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);|&|[^&]+"
    return bind(
        text,
        lambda v: F.when(
            v.contains("&"),
            F.array_join(F.transform(F.regexp_extract_all(v, F.lit(pattern), F.lit(0)), decode), ""),
        ).otherwise(v),
    )


# --- HTML conversion ----------------------------------------------------------------------------
# The text is cut into tags and the runs between them once; each tag is looked up in a table of
# what it prints. That takes a handful of passes over the text, whatever the number of tag kinds.

# Patterns start with one plain character, not with a choice, so that they pass over other text quickly.
_UNSEEN = (
    r"(?is)<(?:!--.*?--|script\b[^>]*>.*?</script\s*|style\b[^>]*>.*?</style\s*"
    r"|head\b[^>]*>.*?</head\s*)>"
)
# Single blanks need no replacing, so only longer runs and other white space are matched.
_SPACES = r"[ \t\n\x0B\f\r]{2,}|[\t\n\x0B\f\r]"
_TOKENS = r"</?[A-Za-z!][^>]*(?:>|\z)|<|[^<]+"
_TAG_NAME = r"^<(/?[A-Za-z][A-Za-z0-9]*)"
_ATTR = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""

# Tags that start and end a block of their own.
BLOCK_TAGS = (
    "p div section article header footer main aside nav figure figcaption table thead tbody tr "
    "ul ol dl dt dd form fieldset address details summary blockquote pre h1 h2 h3 h4 h5 h6 html body"
).split()

# Elements that nest: lists, their items, quotes and preformatted blocks.
_NESTING = r"(?i)</?(?:ul|ol|li|blockquote|pre)\b[^>]*(?:>|\z)"
# Of these, all but flat bullet lists need to know what they stand in: an item is flat without blocks of its own.
_FLAT = "li|ul|" + "|".join(t for t in BLOCK_TAGS if t not in ("ul", "blockquote", "pre", "ol"))
_NEEDS_STACK = (
    r"(?i)<(?:(?:ol|blockquote|pre)\b"
    rf"|li\b[^>]*+>(?:[^<]++|<(?!/?(?:{_FLAT})\b))*+<(?!li\b|/li\b|/ul\b))"
)
# Least room for words beside the indent of a nested block of text; with less the conversion fails.
LEAST_WIDTH = 3


def _text_tags() -> dict[str, str]:
    printed = {name: "\n\n" for tag in BLOCK_TAGS for name in (tag, "/" + tag)}
    printed |= {"br": "\n", "/br": "\n", "li": "\n* ", "td": " ", "/td": " ", "th": " ", "/th": " "}
    return printed


def _markdown_tags() -> dict[str, str]:
    printed = _text_tags()
    printed |= {f"h{n}": "\n\n" + "#" * n + " " for n in range(1, 7)}
    for mark, tags in {"**": ("b", "strong"), "*": ("i", "em"), "`": ("code",)}.items():
        printed |= {name: mark for tag in tags for name in (tag, "/" + tag)}
    printed |= {"hr": "\n\n* * *\n\n"}
    return printed


def _table(entries: dict[str, str]) -> Column:
    """A constant map, folded into the plan as one literal."""
    return F.from_json(F.lit(json.dumps(entries)), "map<string,string>")


def _attribute(tag: Column, name: str) -> Column:
    pattern = rf"(?is)^<[a-z0-9]+\b[^>]*?\s{name}{_ATTR}"
    return F.concat(*[F.regexp_extract(tag, pattern, group) for group in (1, 2, 3)])


def _image(tag: Column) -> Column:
    shown = F.concat(
        F.lit("!["), _attribute(tag, "alt"), F.lit("]("), _attribute(tag, "src"), F.lit(")")
    )
    return F.when(tag.rlike(rf"(?is)^<img\b[^>]*?\ssrc{_ATTR}"), shown).otherwise(F.lit(""))


def _print_tags(html: Column, printed: dict[str, str], markdown: bool) -> Column:
    """Replace every tag by what it prints; unknown tags print nothing."""

    def show(token: Column) -> Column:
        def by_name(name: Column) -> Column:
            plain = F.coalesce(_table(printed)[name], F.lit(""))
            if not markdown:
                return plain
            return F.when(name == "img", _image(token)).otherwise(plain)

        is_tag = token.startswith("<") & (F.length(token) > 1)
        return F.when(is_tag, bind(F.lower(F.regexp_extract(token, _TAG_NAME, 1)), by_name)).otherwise(token)

    return F.array_join(
        F.transform(F.regexp_extract_all(html, F.lit(_TOKENS), F.lit(0)), show), ""
    )


def _tidy(text: Column) -> Column:
    text = replace_all(text, r"  +", " ")
    text = replace_all(text, r" ?\n ?", "\n")
    text = replace_all(text, r"\n\n\n+", "\n\n")
    return replace_all(text, r"^[\n ]+|[\n ]+\z", "")


def _wrap(text: Column, width: Column) -> Column:
    pattern = F.concat(F.lit(r"([^\n]{1,"), F.greatest(width, F.lit(1)).cast("string"), F.lit(r"})(?: +|\n|\z)"))
    return replace_all(F.regexp_replace(text, pattern, F.lit("$1\n")), r"\n+\z", "")


def _links(html: Column) -> Column:
    """Anchors with a target and an end as ``[text](target)``; the inner one of nested anchors counts."""
    whole = rf"(?is)<a\b[^>]*?\shref{_ATTR}[^>]*>((?:[^<]++|<(?!/?a\b))*+)</a\s*>"
    return bind(html, lambda v: F.when(v.rlike(r"(?i)<a\b"), replace_all(v, whole, "[$4]($1$2$3)")).otherwise(v))


def _flow(html: Column, markdown: bool) -> Column:
    """Text outside preformatted blocks: white space squeezed, tags printed, entities decoded."""

    def marked_up(v: Column) -> Column:
        printed = _print_tags(v, _markdown_tags() if markdown else _text_tags(), markdown)
        return _tidy(unescape_entities(F.when(v.contains("<"), printed).otherwise(v)))

    # Squeezed text without tags or entities has neither line breaks nor runs of blanks.
    return bind(
        replace_all(html, _SPACES, " "),
        lambda v: F.when(v.contains("<") | v.contains("&"), marked_up(v)).otherwise(F.trim(v)),
    )


def _preformatted(html: Column) -> Column:
    lines = replace_all(replace_all(html, r"\r\n?", "\n"), r"^\n", "")
    return replace_all(unescape_entities(_print_tags(lines, {"br": "\n"}, False)), r"\n+\z", "")


# The open elements of a place: the first letters of their names (which differ), and for each how many items it
# has had and what stands before a line inside it.
_OPEN = "kinds:string,open:array<struct<n:int,prefix:string>>"
# What the fold keeps between tags, and ``said``, what the last tag and its text print (null: nothing).
_PLACE = f"struct<{_OPEN},begun:boolean,blank:boolean,gap:string,failed:boolean,said:string>"
# Fixed value: tags folded in one go. What they print is joined then, so that no fold carries a long array along.
_FOLDED = 64


def _element(prefix: Column, n: Column | int = 0) -> Column:
    return F.struct((n if isinstance(n, Column) else F.lit(n)).cast("int").alias("n"), prefix.alias("prefix"))


def _last(kinds: Column, kind: Column | str) -> Column:
    """Place of the last element of a kind, from 1; 0 without one."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.length(kinds) - F.length(F.call_function("substring_index", kinds, kind, F.lit(-1)))


def _after_tag(s: Column, tag: Column, markdown: bool) -> Column:
    """``struct(kinds, open, prefix, shared, outside, first)`` after a nesting tag: the open elements and what stands before
    a line inside them, the same of those also open on the other side of the tag (their kinds only), and the text before
    the first line that follows."""
    kinds, open_, kind = s["kinds"], s["open"], tag["kind"]
    quote = "> " if markdown else ""

    def result(**fields: Column) -> Column:
        return F.struct(*[fields[k].alias(k) for k in ("kinds", "open", "prefix", "shared", "outside", "first")])

    def prefix(n: Column) -> Column:
        return F.coalesce(F.get(open_, n - 1)["prefix"], F.lit(""))

    def closed() -> Column:  # through the innermost one of that kind; a stray end tag closes nothing
        def left(n: Column) -> Column:
            outer, before = F.substring(kinds, F.lit(1), n), prefix(n)
            return result(kinds=outer, open=F.slice(open_, F.lit(1), n), prefix=before, shared=outer, outside=before, first=before)

        at = _last(kinds, kind)
        return bind(F.when(at > 0, at - 1).otherwise(F.length(kinds)), left)

    def list_item() -> Column:
        def placed(at: Column) -> Column:
            # An item ends the one before it in the same list.
            left = F.when(at["item"] > at["list"], at["item"] - 1).otherwise(F.length(kinds))
            number = F.concat((F.get(open_, at["list"] - 1)["n"] + 1).cast("string"), F.lit(". "))
            marker = F.when(F.substring(kinds, at["list"], F.lit(1)) == "o", number).otherwise(F.lit("* "))
            return bind(F.struct(left.alias("left"), prefix(left).alias("prefix"), marker.alias("marker"), at["list"].alias("list")), marked)

        def marked(own: Column) -> Column:
            outer = F.substring(kinds, F.lit(1), own["left"])
            counted = F.transform(
                F.slice(open_, F.lit(1), own["left"]),
                lambda e, i: F.when(i + 1 == own["list"], _element(e["prefix"], e["n"] + 1)).otherwise(e),
            )
            inner = F.concat(own["prefix"], F.repeat(F.lit(" "), F.length(own["marker"])))
            return result(
                kinds=F.concat(outer, F.lit("l")), open=F.concat(counted, F.array(_element(inner))), prefix=inner,
                shared=outer, outside=own["prefix"], first=F.concat(own["prefix"], own["marker"]),
            )

        places = F.struct(_last(kinds, "l").alias("item"), F.greatest(_last(kinds, "u"), _last(kinds, "o")).alias("list"))
        return bind(places, placed)

    def opened() -> Column:
        outside = prefix(F.length(kinds))
        inner = F.concat(outside, F.when(kind == "b", F.lit(quote)).otherwise(F.lit("")))
        return result(
            kinds=F.concat(kinds, kind), open=F.concat(open_, F.array(_element(inner))), prefix=inner,
            shared=kinds, outside=outside, first=inner,
        )

    return F.when(tag["ends"], closed()).when(kind == "l", list_item()).otherwise(opened())


def _nested(html: Column, markdown: bool) -> Column:
    """A text with nesting tags: one fold over them keeps the open elements, so that lists are numbered and
    indented and quotes marked at any depth. Null if text has no room beside its indent."""
    tags = F.regexp_extract_all(html, F.lit(_NESTING), F.lit(0))
    texts = F.split(html, _NESTING)

    def place(kinds: Column, open_: Column, begun: Column, blank: Column, gap: Column, failed: Column, said: Column) -> Column:
        return F.struct(
            kinds.alias("kinds"), open_.alias("open"), begun.alias("begun"), blank.alias("blank"), gap.alias("gap"),
            failed.alias("failed"), said.alias("said"),
        )

    def step(s: Column, part: Column) -> Column:
        kind = part["kind"]

        def show(t: Column) -> Column:
            raw = t["kinds"].contains("p")
            prefix = t["prefix"]
            room = F.lit(TEXT_WIDTH) - F.length(prefix)
            flow = part["flow"]
            fenced = lambda v: F.concat(F.lit("```\n"), v, F.lit("\n```")) if markdown else v
            block = bind(_preformatted(part["text"]), lambda v: F.when(v == "", v).otherwise(fenced(v)))
            wrapped = flow if markdown else F.when(flow == "", flow).otherwise(_wrap(flow, room))
            shown = F.when(raw, block).otherwise(wrapped)
            in_item = t["shared"].contains("l")
            apart = kind.isin("b", "p") | (kind.isin("u", "o") & ~in_item)
            outside = t["outside"]
            gap = F.coalesce(F.when(F.length(outside) < F.length(s["gap"]), outside), s["gap"], outside)
            blank = s["blank"] | apart
            starts = (kind == "l") & ~part["ends"]

            nothing = F.lit(None).cast("string")
            silent = place(t["kinds"], t["open"], s["begun"], blank, gap, s["failed"], nothing)

            def put(v: Column) -> Column:
                begin = F.concat(F.lit("\n"), prefix)
                empty = F.concat(F.lit("\n"), F.rtrim(prefix), F.lit("\n"))
                lines = F.replace(F.replace(v, F.lit("\n"), begin), F.concat(begin, F.lit("\n")), empty)
                lines = F.when(v.contains("\n"), lines).otherwise(v)
                lines = F.rtrim(F.concat(t["first"], lines))
                between = (
                    F.when(~s["begun"], F.lit(""))
                    .when(blank, F.concat(F.lit("\n"), F.rtrim(gap), F.lit("\n")))
                    .otherwise(F.lit("\n"))
                )
                tight = F.lit(False) if markdown else ((v != "") & ~raw & (room < LEAST_WIDTH))
                said = place(
                    t["kinds"], t["open"], F.lit(True), F.lit(False), nothing, s["failed"] | tight, F.concat(between, lines)
                )
                return F.when((v != "") | starts, said).otherwise(silent)

            return F.when((part["text"] == "") & ~starts, silent).otherwise(bind(shown, put))

        return bind(_after_tag(s, part, markdown), show)

    def folded(s: Column, chunk: Column) -> Column:
        """The place after some tags, and all that they print, from ``struct(at, said)`` before them."""
        nothing = F.array().cast("array<string>")
        start = F.struct(s["at"].alias("at"), nothing.alias("out"))
        # What a tag prints is put by with the tag after it: so the array is passed on, not copied at every level of a step.
        passed = lambda x: F.when(x["at"]["said"].isNull(), x["out"]).otherwise(F.concat(x["out"], F.array(x["at"]["said"])))
        silent = lambda at: place(*[at[name] for name in ("kinds", "open", "begun", "blank", "gap", "failed")], F.lit(None).cast("string"))
        kind = f"struct<at:{_PLACE},out:array<string>>"
        done = lambda x: F.struct(silent(x["at"]).alias("at"), F.array_join(passed(x), "").alias("said"))
        return F.aggregate(
            chunk, start.cast(kind), lambda x, part: F.struct(step(x["at"], part).alias("at"), passed(x).alias("out")), done
        )

    first = _flow(F.get(texts, F.lit(0)), markdown)
    first = first if markdown else _wrap(first, F.lit(TEXT_WIDTH))
    no_open = F.array().cast("array<struct<n:int,prefix:string>>")
    no, nothing = F.lit(False), F.lit(None).cast("string")
    start = bind(
        first, lambda v: F.struct(place(F.lit(""), no_open, v != "", no, nothing, no, nothing).alias("at"), v.alias("said"))
    )

    def part(tag: Column, text: Column) -> Column:
        named = lambda name: F.struct(
            F.substring(F.ltrim(name, F.lit("/")), 1, 1).alias("kind"), name.startswith("/").alias("ends"), text.alias("text"),
            F.when(text == "", text).otherwise(_flow(text, markdown)).alias("flow"),
        )
        return bind(F.lower(F.regexp_extract(tag, _TAG_NAME, 1)), named)

    parts = F.zip_with(tags, F.slice(texts, F.lit(2), F.greatest(F.size(texts) - 1, F.lit(0))), part)
    chunks = lambda ps: F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(ps), F.lit(1)), F.lit(_FOLDED)), lambda i: F.slice(ps, i, F.lit(_FOLDED))
    )
    kind = f"struct<run:struct<at:{_PLACE},said:string>,out:array<string>>"
    none_yet = F.struct(start.alias("run"), F.array().cast("array<string>").alias("out")).cast(kind)
    passed = lambda x: F.concat(x["out"], F.array(x["run"]["said"]))
    return F.aggregate(
        bind(parts, chunks),
        none_yet,
        lambda x, chunk: F.struct(folded(x["run"], chunk).alias("run"), passed(x).alias("out")),
        lambda x: F.when(~x["run"]["at"]["failed"], F.array_join(passed(x), "")),
    )


def _convert(html: Column, markdown: bool) -> Column:
    """Tags printed, entities decoded, white space tidied; plain text only gets the last part."""

    def marked_up(v: Column) -> Column:
        seen = replace_all(v, _UNSEEN, "")
        flow = _flow if markdown else lambda x, m: _wrap(_flow(x, m), F.lit(TEXT_WIDTH))
        return bind(
            _links(seen) if markdown else seen,
            lambda x: F.when(x.rlike(_NEEDS_STACK), _nested(x, markdown)).otherwise(flow(x, markdown)),
        )

    def plain(v: Column) -> Column:
        squeezed = F.trim(replace_all(v, _SPACES, " "))
        return squeezed if markdown else _wrap(squeezed, F.lit(TEXT_WIDTH))

    return bind(
        html, lambda v: F.when(v.contains("<") | v.contains("&"), marked_up(v)).otherwise(plain(v))
    )


@per_session
def to_text(html: ColumnOrName) -> Column:
    """Readable plain text, wrapped at 80 characters; null if nesting leaves no room for words."""
    return _convert(col(html), False)


@per_session
def to_markdown(html: ColumnOrName) -> Column:
    """Markdown with headings, emphasis, links, images, nested lists and quotes, and code."""
    return _convert(col(html), True)


@per_session
def content_source(content: ColumnOrName, summary: ColumnOrName) -> Column:
    """The entry's content unless blank, else its summary unless blank, else null."""
    return F.coalesce(
        F.when(~is_blank(content), col(content)), F.when(~is_blank(summary), col(summary))
    )


def _letters(text: Column) -> Column:
    return F.length(replace_all(text, r"[^\p{L}\p{N}]+", ""))


def _lost_text(html: Column, converted: Column) -> Column:
    """Whether a conversion kept under half of the letters between the tags. Scripts, styles, comments and
    document titles are not text."""
    # No text has more letters than its source has characters, which settles most bodies.
    beside = r"(?is)<!--.*?-->|<(script|style|title)\b[^>]*>.*?</\1\s*>"
    kept = _letters(converted) * 2
    return html.contains("<") & bind(
        kept, lambda k: (k < F.length(html)) & (k < _letters(strip_tags(replace_all(html, beside, " "))))
    )


@per_session
def extract_content(html: ColumnOrName, content_format: str) -> Column:
    """``struct(content, fell_back)`` of a body in the wanted format.

    The format is a plan-time choice. A conversion that fails (no result for a present body, or one
    that lost most of its text, such as a body put into ``head``) falls back to ``strip_tags`` and says so.
    """
    source = col(html)
    if content_format not in CONTENT_FORMATS:
        raise UsageError(f"invalid content_format '{content_format}'")
    if content_format == "none":
        return F.struct(F.lit(None).cast("string").alias("content"), F.lit(False).alias("fell_back"))
    if content_format == "html":
        return F.struct(source.alias("content"), F.lit(False).alias("fell_back"))
    converted = to_markdown(source) if content_format == "markdown" else to_text(source)

    def checked(v: Column) -> Column:
        failed = source.isNotNull() & F.coalesce(_lost_text(source, v), F.lit(True))
        return bind(
            failed,
            lambda bad: F.struct(F.when(bad, strip_tags(source)).otherwise(v).alias("content"), bad.alias("fell_back")),
        )

    return bind(converted, checked)
