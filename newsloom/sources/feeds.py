"""RSS, Atom and JSON Feed documents to one record per entry, in a single pass over the bodies.

XML formats share one parse schema whose fields cover RSS 0.9x/2.0 (``channel/item``), RSS 1.0
(``item`` beside ``channel``) and Atom (``entry``), so a body is parsed once whatever it turns out
to be and the table is scanned once.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.functions.base import bind, per_session
from newsloom.functions.values import collect_enclosures, names, none_if_empty, pick_link, terms

_MEDIA = "array<struct<_url:string,_type:string,_fileSize:string>>"
_LINKS = "array<struct<_VALUE:string,_href:string,_rel:string,_type:string,_length:string>>"
_RSS_ITEM = f"""struct<
    title:string, link:{_LINKS}, guid:struct<_VALUE:string,_isPermaLink:string>,
    pubDate:string, `dc:date`:string, author:array<string>, `dc:creator`:array<string>,
    category:array<string>, description:string, `content:encoded`:string,
    enclosure:array<struct<_url:string,_type:string,_length:string>>,
    `media:content`:{_MEDIA}, `media:group`:array<struct<`media:content`:{_MEDIA}>>>"""
_ATOM_ENTRY = f"""struct<
    title:string, link:{_LINKS}, id:string, published:string, updated:string,
    author:array<struct<name:string>>, category:array<struct<_term:string>>,
    summary:string, content:string,
    `media:content`:{_MEDIA}, `media:group`:array<struct<`media:content`:{_MEDIA}>>>"""
XML_SCHEMA = f"""struct<
    channel:struct<title:string, link:{_LINKS}, lastBuildDate:string, `dc:date`:string, item:array<{_RSS_ITEM}>>,
    item:array<{_RSS_ITEM}>,
    title:string, link:{_LINKS}, updated:string, entry:array<{_ATOM_ENTRY}>,
    _corrupt:string>"""
_PERSON = "struct<name:string>"
JSON_SCHEMA = f"""struct<
    version:string, title:string, home_page_url:string, feed_url:string,
    items:array<struct<
        id:string, url:string, external_url:string, title:string,
        content_html:string, content_text:string, summary:string,
        date_published:string, date_modified:string,
        author:{_PERSON}, authors:array<{_PERSON}>, tags:array<string>,
        attachments:array<struct<url:string,mime_type:string,size_in_bytes:string>>>>,
    _corrupt:string>"""
_PARSE_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}

# One parsed record: row 0 of a document describes the feed itself, rows 1.. its entries.
ENTRY = """struct<
    title:string, link:string, guid:string, published_text:string, updated_text:string,
    authors:array<string>, categories:array<string>, summary:string, body:string,
    enclosures:array<struct<url:string,mime:string,length:bigint>>>"""

# Leading declaration, comments and document type, then the name of the root element.
_ROOT = (
    r"(?s)^\x{feff}?\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*|<!DOCTYPE[^>\[]*(?:\[.*?\])?[^>]*>\s*)*+<([A-Za-z][A-Za-z0-9:_.\-]*)"
)


def detect_format(body: Column) -> Column:
    """``xml-rss``, ``xml-rdf``, ``xml-atom``, ``json``, or null for anything else."""
    return bind(
        F.lower(F.regexp_replace(F.regexp_extract(body, _ROOT, 1), "^[^:]*:", "")),
        lambda root: F.when(body.rlike(r"^\x{feff}?\s*\{"), F.lit("json"))
        .when(root == "rss", F.lit("xml-rss"))
        .when(root == "rdf", F.lit("xml-rdf"))
        .when(root == "feed", F.lit("xml-atom")),
    )


def plain_prefixes(body: Column) -> Column:
    """Drop the namespace prefix of an Atom root (``<a:feed>``) from all tags that carry it."""
    prefix = F.regexp_extract(F.regexp_extract(body, _ROOT, 1), r"^([^:]+):feed\z", 1)
    return bind(
        prefix,
        lambda p: F.when(
            F.length(p) > 0, F.regexp_replace(body, F.concat(F.lit("(</?)"), p, F.lit(":")), F.lit("$1"))
        ).otherwise(body),
    )


# The namespaces of the fields above, and the prefixes the parse schema knows them by.
_NAMESPACES = (
    ("http://purl.org/rss/1.0/modules/content/", "content"),
    ("http://purl.org/dc/elements/1.1/", "dc"),
    ("http://search.yahoo.com/mrss/", "media"),
)


_CDATA = r"(?s)<!\[CDATA\[.*?(?:\]\]>|\z)|(?:[^<]++|<(?!!\[CDATA\[))++"


def _rename(text: Column, pattern: Column, replacement: str) -> Column:
    """``regexp_replace`` outside of CDATA sections, whose text only looks like tags."""
    plain = lambda v: F.regexp_replace(v, pattern, F.lit(replacement))
    pieces = F.transform(
        F.regexp_extract_all(text, F.lit(_CDATA), F.lit(0)),
        lambda piece: F.when(piece.startswith("<![CDATA["), piece).otherwise(plain(piece)),
    )
    return F.when(text.contains("<![CDATA["), F.array_join(pieces, "")).otherwise(plain(text))


def _usual_prefix(text: Column, uri: str, usual: str) -> Column:
    known = uri.rstrip("/")
    declared = rf"""xmlns:([A-Za-z_][A-Za-z0-9_.\-]*)\s*=\s*["']{re.escape(known)}/?["']"""
    prefixes = F.array_except(F.regexp_extract_all(text, F.lit(declared), F.lit(1)), F.array(F.lit(usual)))

    def renamed(ps: Column) -> Column:
        names = F.array_join(F.transform(ps, lambda p: F.replace(p, F.lit("."), F.lit("\\."))), "|")
        pattern = F.concat(F.lit("(</?)(?:"), names, F.lit("):"))
        return F.when(F.size(ps) > 0, _rename(text, pattern, f"$1{usual}:")).otherwise(text)

    return F.when(text.contains(known), bind(prefixes, renamed)).otherwise(text)


def known_prefixes(body: Column) -> Column:
    """Rename prefixes bound to the namespaces above, by the root or any element below, to the usual ones.

    Only bodies that bind a prefix and name such an address are looked at; CDATA stays as it is.
    """

    def renaming(uri: str, usual: str):
        return lambda v: _usual_prefix(v, uri, usual)

    out = body
    for uri, usual in _NAMESPACES:
        out = bind(out, renaming(uri, usual))
    return F.when(body.contains("xmlns:"), out).otherwise(body)


def _links(raw: Column) -> Column:
    return F.transform(
        raw,
        lambda l: F.struct(
            F.coalesce(l["_href"], l["_VALUE"]).alias("href"),
            l["_rel"].alias("rel"),
            l["_type"].alias("type"),
            l["_length"].alias("length"),
        ),
    )


def _media(direct: Column, groups: Column) -> Column:
    nothing = F.array().cast(_MEDIA)
    grouped = F.flatten(F.transform(groups, lambda g: F.coalesce(g["media:content"], nothing)))
    return F.transform(
        F.concat(F.coalesce(direct, nothing), F.coalesce(grouped, nothing)),
        lambda m: F.struct(
            m["_url"].alias("url"), m["_type"].alias("type"), m["_fileSize"].alias("length")
        ),
    )


def _entry(**fields: Column) -> Column:
    return F.struct(*[value.alias(name) for name, value in fields.items()]).cast(ENTRY)


def _text(value: str | None = None) -> Column:
    return F.lit(value).cast("string")


def _no_links() -> Column:
    return F.lit(None).cast("array<struct<href:string,rel:string,type:string,length:string>>")


def _rss_entry(item: Column) -> Column:
    attached = F.transform(
        item["enclosure"],
        lambda e: F.struct(
            e["_url"].alias("href"),
            F.lit("enclosure").alias("rel"),
            e["_type"].alias("type"),
            e["_length"].alias("length"),
        ),
    )
    authors = F.concat(
        F.coalesce(item["author"], F.array().cast("array<string>")),
        F.coalesce(item["dc:creator"], F.array().cast("array<string>")),
    )
    return _entry(
        title=item["title"],
        link=pick_link(_links(item["link"])),
        guid=none_if_empty(item["guid"]["_VALUE"]),
        published_text=F.coalesce(item["pubDate"], item["dc:date"]),
        updated_text=_text(),
        authors=names(authors),
        categories=terms(item["category"]),
        summary=item["description"],
        body=item["content:encoded"],
        enclosures=collect_enclosures(_media(item["media:content"], item["media:group"]), attached),
    )


def _atom_entry(entry: Column) -> Column:
    links = _links(entry["link"])
    return _entry(
        title=entry["title"],
        link=pick_link(links),
        guid=none_if_empty(entry["id"]),
        published_text=entry["published"],
        updated_text=entry["updated"],
        authors=terms(F.transform(entry["author"], lambda a: a["name"])),
        categories=terms(F.transform(entry["category"], lambda c: c["_term"])),
        summary=entry["summary"],
        body=entry["content"],
        enclosures=collect_enclosures(_media(entry["media:content"], entry["media:group"]), links),
    )


def _json_entry(item: Column) -> Column:
    people = F.coalesce(item["authors"], F.array(item["author"]))
    attachments = F.transform(
        item["attachments"],
        lambda a: F.struct(
            a["url"].alias("url"), a["mime_type"].alias("type"), a["size_in_bytes"].alias("length")
        ),
    )
    return _entry(
        title=item["title"],
        link=F.coalesce(item["url"], item["external_url"]),
        guid=none_if_empty(item["id"]),
        published_text=item["date_published"],
        updated_text=item["date_modified"],
        authors=terms(F.transform(people, lambda p: p["name"])),
        categories=terms(item["tags"]),
        summary=item["summary"],
        body=F.coalesce(item["content_html"], item["content_text"]),
        enclosures=collect_enclosures(attachments, _no_links()),
    )


def _feed_entry(title: Column, link: Column, updated: Column) -> Column:
    """Row 0: the feed's own title, site link and date in the fields of an entry."""
    none = _text()
    no_names = F.array().cast("array<string>")
    return _entry(
        title=title,
        link=link,
        guid=none,
        published_text=none,
        updated_text=updated,
        authors=no_names,
        categories=no_names,
        summary=none,
        body=none,
        enclosures=F.array().cast("array<struct<url:string,mime:string,length:bigint>>"),
    )


@per_session
def _document_columns() -> tuple[Column, Column, Column, Column]:
    """Error text, feed, entries and their number of a document, from the columns ``_format``, ``_x``, ``_j``."""
    fmt = F.col("_format")
    x, j = F.col("_x"), F.col("_j")
    is_rss = fmt.isin("xml-rss", "xml-rdf")
    error = (
        F.when(fmt.isNull(), F.lit("unrecognised document: no feed root element"))
        .when(x["_corrupt"].isNotNull(), F.lit("malformed XML"))
        .when(j["_corrupt"].isNotNull(), F.lit("malformed JSON"))
        .when(is_rss & x["channel"].isNull(), F.lit("no channel element"))
        .when(
            (fmt == "json")
            & ~F.coalesce(j["version"].startswith("https://jsonfeed.org/version/1"), F.lit(False)),
            F.lit("not a JSON Feed of version 1"),
        )
    )
    channel = x["channel"]
    head = (
        F.when(
            is_rss,
            _feed_entry(
                channel["title"],
                pick_link(_links(channel["link"])),
                F.coalesce(channel["lastBuildDate"], channel["dc:date"]),
            ),
        )
        .when(fmt == "xml-atom", _feed_entry(x["title"], pick_link(_links(x["link"])), x["updated"]))
        .when(
            fmt == "json",
            _feed_entry(j["title"], F.coalesce(j["home_page_url"], j["feed_url"]), _text()),
        )
    )
    # RSS 1.0 keeps its items beside the channel, the other versions inside it.
    items = F.when(fmt == "xml-rss", F.coalesce(channel["item"], x["item"])).otherwise(
        F.coalesce(x["item"], channel["item"])
    )
    entries = (
        F.when(is_rss, F.transform(items, _rss_entry))
        .when(fmt == "xml-atom", F.transform(x["entry"], _atom_entry))
        .when(fmt == "json", F.transform(j["items"], _json_entry))
    )
    # The raw entries are counted, so that jobs that want no more than their number do not shape them.
    n_entries = (
        F.when(is_rss, F.array_size(items))
        .when(fmt == "xml-atom", F.array_size(x["entry"]))
        .when(fmt == "json", F.array_size(j["items"]))
    )
    return error, head, entries, n_entries


def parse_documents(documents: DataFrame, body: str = "body") -> DataFrame:
    """One row per document: its other columns plus ``parse_error``, ``feed``, ``entries`` and ``n_entries``.

    ``feed`` describes the feed in the fields of an entry, ``entries`` are in document order. A
    body that is not a readable feed gets an error text and no entries; it never fails the job.
    """
    keys = [c for c in documents.columns if c != body]
    fmt = F.col("_format")
    routed = documents.withColumn("_format", detect_format(F.col(body)))
    renamed = known_prefixes(F.col(body))
    xml = F.when(fmt == "xml-atom", bind(renamed, plain_prefixes)).when(fmt.startswith("xml"), renamed)
    json = F.when(fmt == "json", F.col(body))
    parsed = routed.select(
        *keys,
        "_format",
        F.from_xml(xml, XML_SCHEMA, _PARSE_OPTIONS).alias("_x"),
        F.from_json(json, JSON_SCHEMA, _PARSE_OPTIONS).alias("_j"),
    )
    error, head, entries, n_entries = _document_columns()
    nothing = F.array().cast(f"array<{ENTRY}>")
    return parsed.select(
        *keys,
        error.alias("parse_error"),
        F.when(error.isNull(), head).cast(ENTRY).alias("feed"),
        F.when(error.isNull(), F.coalesce(entries, nothing)).otherwise(nothing).alias("entries"),
        F.when(error.isNull(), F.coalesce(n_entries, F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias("n_entries"),
    )


def parse_feeds(documents: DataFrame, body: str = "body") -> DataFrame:
    """One row per entry of each document, with ``pos`` from 1, and row 0 for the feed itself.

    Row 0 carries ``parse_error``. Filters on the result do not parse the bodies again.
    """
    keys = [c for c in documents.columns if c != body]
    rows = parse_documents(documents, body).select(
        *keys, "parse_error", F.concat(F.array("feed"), F.col("entries")).alias("_rows")
    )
    # posexplode_outer, not posexplode: for the latter the optimizer adds a size filter below the
    # generator, which would parse every body twice.
    exploded = rows.select(*keys, "parse_error", F.posexplode_outer("_rows").alias("pos", "_entry"))
    return exploded.select(
        *keys,
        F.col("pos").cast("bigint").alias("pos"),
        F.when(F.col("pos") == 0, F.col("parse_error")).alias("parse_error"),
        "_entry.*",
    )
