"""Column functions on known answers."""

import random
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from newsloom.errors import UsageError
from newsloom.functions import dates, identity, jsontext, text, urls, values
from newsloom.params import FeedParams, parse_duration, parse_since

def no_text():
    return F.lit(None).cast("string")


def test_item_id_known_answers(evaluate):
    feed = "https://example.com/feed"
    rows = [(feed, "https://example.com/a"), (feed, ""), (feed, None)]
    ids = evaluate(rows, "f string, l string", identity.item_id("f", "l", no_text(), no_text(), no_text()))
    assert ids == ["1b9107de952289cb", "a86aced5664c7742", "a86aced5664c7742"]


def test_item_id_precedence_and_namespace(evaluate):
    rows = [
        ("f", "l", "g", "t", "p"),
        ("f", None, "g", "t", "p"),
        ("f", "", "", "t", "p"),
        ("f", None, None, None, "p"),
        ("g", "l", "g", "t", "p"),
    ]
    ids = evaluate(
        rows,
        "f string, l string, g string, t string, p string",
        identity.item_id("f", "l", "g", "t", "p"),
        identity.id_source("l", "g"),
    )
    assert [s for _, s in ids] == ["link", "guid", "hash", "hash", "link"]
    assert len({i for i, _ in ids}) == 5
    assert all(len(i) == 16 for i, _ in ids)


def test_tokens_and_truncation(evaluate):
    rows = [("abcdefgh",), ("abcdefghi",), ("",), ("héllo",), (None,), ("a😀b",)]
    assert evaluate(rows, "v string", text.estimate_tokens("v")) == [2, 3, 0, 2, 0, 1]
    marker = text.TRUNCATION_MARKER
    cut = evaluate(rows, "v string", text.truncate_chars("v", 2), text.is_over("v", 2))
    assert cut[0] == ("ab" + marker, True)
    assert cut[2] == ("", False) and cut[4] == (None, False)
    assert cut[5] == ("a😀" + marker, True)
    assert evaluate([("ab",)], "v string", text.truncate_chars("v", 2)) == ["ab"]
    assert evaluate([("ab",)], "v string", text.truncate_chars("v", 0)) == [marker]


def test_strip_tags(evaluate):
    rows = [
        ("<p>Hello <b>world</b></p>\n\n  again",),
        ("a < b > c",),
        ("cut <off here",),
        ("stray > here &amp; there\u00a0now\u2003end ",),
        (None,),
    ]
    assert evaluate(rows, "v string", text.strip_tags("v")) == [
        "Hello world again",
        "a c",
        "cut",
        "stray here &amp; there now end",
        None,
    ]


HTML_CASES = [
    ("<p>Hello <b>world</b></p>", "Hello **world**", "Hello world"),
    ("<h2>T</h2><p>x<br>y</p>", "## T\n\nx\ny", "T\n\nx\ny"),
    ('<a class="c" href="u?a=1&amp;b">t <i>i</i></a>', "[t *i*](u?a=1&b)", "t i"),
    ("<ul><li>a<li>b</ul>", "* a\n* b", "* a\n* b"),
    ("<ol><li>a</li> <li>b</li></ol>", "1. a\n2. b", "1. a\n2. b"),
    ("<blockquote>q<br>r</blockquote>z", "> q\n> r\n\nz", "q\nr\n\nz"),
    ("<pre><code>a\n  b</code></pre>", "```\na\n  b\n```", "a\n  b"),
    ('<img alt="A" src=\'s.png\'>', "![A](s.png)", ""),
    ("x<hr/>y", "x\n\n* * *\n\ny", "xy"),
    ("&eacute;&#233;&#xE9; &bogus; &", "ééé &bogus; &", "ééé &bogus; &"),
    ("<script>var a='<p>';</script>a<!-- <b> -->b<style>p{}</style>", "ab", "ab"),
    ("1 < 2  and\n3", "1 < 2 and 3", "1 < 2 and 3"),
    ("plain   text\n here", "plain text here", "plain text here"),
    ("<a href='x'>unclosed", "unclosed", "unclosed"),
    ("<a href=u><b>x</b> <a href=v>y</a></a>", "**x** [y](v)", "x y"),
    ("a\ue000b<p>c\ue002d\ue00f", "a\ue000b\n\nc\ue002d\ue00f", "a\ue000b\n\nc\ue002d\ue00f"),
    (
        "<ol><li>a<ul><li>b</li><li>c<ol><li>d</ol></ul></li><li>e</ol>f",
        "1. a\n   * b\n   * c\n     1. d\n2. e\n\nf",
        "1. a\n   * b\n   * c\n     1. d\n2. e\n\nf",
    ),
    ("<ol><li>a</ol><ol><li>b</ol>", "1. a\n\n1. b", "1. a\n\n1. b"),
    (
        "<blockquote>a<blockquote>b<br>c</blockquote>d</blockquote>e",
        "> a\n>\n> > b\n> > c\n>\n> d\n\ne",
        "a\n\nb\nc\n\nd\n\ne",
    ),
    ("<blockquote><ul><li>a<li>b</ul></blockquote>", "> * a\n> * b", "* a\n* b"),
    ("<ul><li><p>a</p><p>b</p></li></ul>", "* a\n\n  b", "* a\n\n  b"),
    ("<ol><li>x<pre>l\n  m &lt;\n</pre><li>y</ol>", "1. x\n\n   ```\n   l\n     m <\n   ```\n\n2. y", "1. x\n\n   l\n     m <\n\n2. y"),
    ("</ul>a<li>b<li>c</blockquote>d", "a\n* b\n* c\n\nd", "a\n* b\n* c\n\nd"),
    ("<ul><li></li></ul>z", "*\n\nz", "*\n\nz"),
]


def test_html_conversion(evaluate):
    rows = [(html,) for html, _, _ in HTML_CASES]
    got = evaluate(rows, "v string", text.to_markdown("v"), text.to_text("v"))
    assert got == [(markdown, plain) for _, markdown, plain in HTML_CASES]



def test_long_nested_texts_take_time_in_proportion(evaluate):
    """A fold that copies what it has printed at every tag takes minutes here."""
    n = 12_000
    rows = [("<ol>" + "".join(f"<li>a{i}<ul><li>b</li></ul></li>" for i in range(1, n + 1)) + "</ol>",)]
    began = time.monotonic()
    [got] = evaluate(rows, "v string", text.to_markdown("v"))
    assert got == "\n".join(f"{i}. a{i}\n{' ' * len(f'{i}. ')}* b" for i in range(1, n + 1))
    assert time.monotonic() - began < 60


def test_text_wraps_at_80(evaluate):
    words = " ".join(["word"] * 60)
    (wrapped,) = evaluate([(f"<p>{words}</p>",)], "v string", text.to_text("v"))
    assert all(len(line) <= 80 for line in wrapped.split("\n"))
    assert wrapped.replace("\n", " ") == words


def test_conversion_failures_fall_back(evaluate):
    deep = "<ul><li>" * 45 + "deep word"
    rows = [("<head><p>all the text</p></head>",), (deep,), ("<head><title>T</title></head><p>ok</p>",), ("<script>var a</script>",), (None,), ("",)]
    got = evaluate(rows, "v string", text.extract_content("v", "text"))
    assert [tuple(x) for x in got] == [("all the text", True), ("deep word", True), ("ok", False), ("", False), (None, False), ("", False)]
    got = evaluate(rows, "v string", text.extract_content("v", "markdown"))
    assert [x["fell_back"] for x in got] == [True, False, False, False, False, False]
    assert got[1]["content"].endswith("  * deep word")


def test_hosts_outside_ascii(evaluate):
    rng = random.Random(11)
    labels = ["ü", "bücher", "例え", "пример", "a😀b", "faß", "münchen-ost", "ñandú", "中文", "ليهمابتكلموشعربي؟"]
    pool = "abcz09-éüßøłжшあ漢字😀𝒳"
    labels += ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 40))) + "é" for _ in range(60)]
    rows = [(x,) for x in labels]
    assert evaluate(rows, "v string", urls.punycode("v")) == [x.encode("punycode").decode() for x in labels]
    hosts = [("Ü.Example",), ("xn--tda.example",), ("a。例え．com",), ("plain.ORG",), ("",)]
    assert evaluate(hosts, "v string", urls.ascii_host("v")) == ["xn--tda.example", "xn--tda.example", "a.xn--r8jz45g.com", "plain.org", ""]
    links = [("https://Ü.example:443/p é",), ("//bücher.example/x",), ("https://xn--tda.example/p%20%C3%A9",)]
    got = evaluate(links, "v string", urls.resolve_url(F.lit("https://e.org/"), "v"))
    assert got == ["https://xn--tda.example/p%20%C3%A9", "https://xn--bcher-kva.example/x", "https://xn--tda.example/p%20%C3%A9"]
    assert evaluate(links[:1], "v string", urls.authority("v")) == ["xn--tda.example:443"]
    ids = evaluate(links, "v string", identity.item_id(F.lit("https://f.org/"), urls.resolve_url(F.lit("https://e.org/"), "v"), no_text(), no_text(), no_text()))
    assert ids[0] == ids[2]


def test_content_source_and_extraction(evaluate):
    rows = [("c", "s"), (" \u00a0\n", "s"), (None, "s"), (None, "  "), ("<b>c</b>", None)]
    source = text.content_source("c", "s")
    assert evaluate(rows, "c string, s string", source) == ["c", "s", "s", None, "<b>c</b>"]
    for fmt, want in {"html": "<b>c</b>", "text": "c", "markdown": "**c**", "none": None}.items():
        (x,) = evaluate(rows[4:], "c string, s string", text.extract_content(source, fmt))
        assert tuple(x) == (want, False)
    with pytest.raises(UsageError):
        text.extract_content(source, "pdf")


BASE = "https://example.com/a/b/c?q=1#f"


URL_CASES = [
    ("/x", "https://example.com/x"),
    ("x/y", "https://example.com/a/b/x/y"),
    ("../z", "https://example.com/a/z"),
    ("./", "https://example.com/a/b/"),
    ("?p=2", "https://example.com/a/b/c?p=2"),
    ("#g", "https://example.com/a/b/c?q=1#g"),
    ("", "https://example.com/a/b/c?q=1"),
    ("//Other.COM:443/p", "https://other.com/p"),
    ("http://EX.com:80", "http://ex.com/"),
    ("https://e.org/x?y#z", "https://e.org/x?y#z"),
    ("https:foo", "https://example.com/a/b/foo"),
    ("mailto:A@b", "mailto:A@b"),
    ("/a b/é", "https://example.com/a%20b/%C3%A9"),
    ("/a/../../b/.", "https://example.com/b/"),
    ("/a/%2e%2E/k", "https://example.com/k"),
    ("/a.b/..c/d", "https://example.com/a.b/..c/d"),
    ("\\x\\y?a\\b", "https://example.com/x/y?a\\b"),
    (" /t\n ", "https://example.com/t"),
    ("HTTP://u:P@Host:8080/../x", "http://u:P@host:8080/x"),
    ("http://bad host/", None),
    ("http://h:99999/", None),
    ("http://", None),
]


def test_resolve_url(evaluate):
    rows = [(BASE, href) for href, _ in URL_CASES]
    got = evaluate(rows, "b string, h string", urls.resolve_url("b", "h"))
    assert got == [want for _, want in URL_CASES]


def test_unusable_base(evaluate):
    rows = [("not a url", "/x"), (None, "https://a.b/c"), ("https://h", "y")]
    got = evaluate(rows, "b string, h string", urls.resolve_url("b", "h"), urls.resolve_or_keep("b", "h"))
    assert got[0] == (None, "/x") and got[1][1] == "https://a.b/c" and got[2][0] == "https://h/y"


def test_authority(evaluate):
    rows = [("https://Ex.com/a",), ("http://ex.com:8080",), ("http://u@ex.com",), ("foo://h/x",), ("junk",)]
    assert evaluate(rows, "u string", urls.authority("u")) == [
        "ex.com:443", "ex.com:8080", "ex.com:80", "h:0", "junk",
    ]


def test_classify_feed_link(evaluate):
    rows = [
        ("application/rss+xml", "/x"),
        ("Application/Atom+XML; charset=utf-8", "/x"),
        ("application/json", "/x"),
        ("application/feed+json", "/x"),
        ("text/html", "/x.rss"),
        (None, "/feed.ATOM?x=1"),
        (None, "/feed.xml#a"),
        (None, "/feed?x=.rss"),
        ("", "/x.rss"),
    ]
    got = evaluate(rows, "t string, h string", urls.classify_feed_link("t", "h"))
    assert got == ["rss", "atom", "json", "json", None, "unknown", "unknown", None, None]


DATE_CASES = [
    ("Mon, 01 Jun 2026 09:00:00 GMT", "2026-06-01T09:00:00Z"),
    ("1 Jun 26 09:00 EST", "2026-06-01T14:00:00Z"),
    ("Mon, 01 June 2026 09:00:00 +0200", "2026-06-01T07:00:00Z"),
    ("2026-06-01T10:30:00.5+02:00", "2026-06-01T08:30:00Z"),
    ("2026-06-01", "2026-06-01T00:00:00Z"),
    ("Mon, 32 Jun 2026 09:00:00 GMT", None),
    ("Mon, 01 Foo 2026 09:00:00 GMT", None),
    ("01 una 2026 09:00:00 GMT", None),
    ("soon", None),
    (None, None),
]


def test_feed_dates(evaluate):
    rows = [(given,) for given, _ in DATE_CASES]
    got = evaluate(rows, "d string", dates.rfc3339(dates.parse_feed_date("d")))
    assert got == [want for _, want in DATE_CASES]


AS_OF = datetime(2026, 6, 2, tzinfo=timezone.utc)


def test_durations_and_since(evaluate):
    given = ["2h", "7d", " 1w ", "x", "5", "h", "1.5h", "99999999999999999999s"]
    rows = [(g,) for g in given]
    assert evaluate(rows, "v string", dates.parse_duration("v")) == [7200, 604800, 604800] + [None] * 5
    for g in given[:3]:
        assert parse_duration(g) == timedelta(seconds={"2h": 7200}.get(g, 604800))
    for g in given[3:]:
        with pytest.raises(UsageError):
            parse_duration(g)
    since = ["2h", "2026-06-01", "2026-06-01T01:02:03+01:00", "yesterday", "2026-13-01"]
    want = ["2026-06-01T22:00:00Z", "2026-06-01T00:00:00Z", "2026-06-01T00:02:03Z", None, None]
    got = evaluate([(s,) for s in since], "v string", dates.rfc3339(dates.parse_since("v", F.lit(AS_OF))))
    assert got == want
    for s, w in zip(since, want, strict=True):
        if w is None:
            with pytest.raises(UsageError):
                parse_since(s, AS_OF)
        else:
            assert parse_since(s, AS_OF).strftime("%Y-%m-%dT%H:%M:%SZ") == w


def test_retry_after(evaluate):
    rows = [(v,) for v in ["120", " 5 ", "Tue, 02 Jun 2026 00:02:00 GMT", "Mon, 01 Jun 2026 00:00:00 GMT", "x", None, "-3"]]
    got = evaluate(rows, "v string", dates.retry_after_seconds("v", F.lit(AS_OF)))
    assert got == [120.0, 5.0, 120.0, None, None, None, None]


INT_CASES = [
    ("25", 25, False), ('"25"', 25, False), ("25.0", 25, False), ('" 25 "', 25, False), ("1e2", 100, False),
    ("null", None, False), (None, None, False), ('""', None, False), ('"  "', None, False),
    ("-1", None, True), ("1.5", None, True), ('"x"', None, True), ("true", None, True), ('"25.0"', None, True),
    ("99999999999999999999", None, True),
]


def test_lenient_int(evaluate):
    got = evaluate([(given,) for given, _, _ in INT_CASES], "v string", values.lenient_int("v"))
    assert [tuple(g) for g in got] == [(value, is_error) for _, value, is_error in INT_CASES]


def test_content_format_and_people(evaluate):
    rows = [(" Markdown ",), ("TEXT",), ("pdf",)]
    assert evaluate(rows, "v string", values.parse_content_format("v")) == ["markdown", "text", None]
    rows = [("a@b.c (Alice)",), ("Bob",), ("a@b.c",), ("x (y)",)]
    assert evaluate(rows, "v string", values.person_name("v")) == ["Alice", "Bob", "a@b.c", "x (y)"]


def test_error_details(evaluate):
    got = evaluate([(429, "30", 1500)], "s int, r string, w int", values.http_details("s", "r"), values.wait_details("w"))
    assert got == [
        ('{"http_status":429,"retry_after":"30"}', '{"retry_after_seconds":1,"retry_after_ms":1500}')
    ]


def test_json_text(evaluate):
    import json

    nasty = 'quote " slash \\ / line\n tab\t bell\x07 é😀'
    (shown,) = evaluate([(nasty,)], "v string", jsontext.json_value("v"))
    assert json.loads(shown) == nasty
    assert evaluate([(None,)], "v string", jsontext.json_value("v")) == ["null"]


def test_params_are_checked():
    with pytest.raises(UsageError):
        FeedParams(content_format="pdf")
    with pytest.raises(UsageError):
        FeedParams(limit=-1)
    assert FeedParams().with_(limit=3).limit == 3
