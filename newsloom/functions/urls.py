"""URL resolution and host keys, following the URL Standard for http-like schemes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from newsloom.functions.base import ColumnOrName, bind, col, per_session, replace_all

# Schemes with an authority and their default ports.
DEFAULT_PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}

# Characters that must be percent-encoded, as bodies of character classes.
_CONTROL_AND_WIDE = r"\x00-\x20\x{7f}-\x{10ffff}"
UNSAFE_PATH = _CONTROL_AND_WIDE + r'"#<>?`{}'
UNSAFE_QUERY = _CONTROL_AND_WIDE + r'"#<>' + "'"
UNSAFE_FRAGMENT = _CONTROL_AND_WIDE + r'"<>`'

_GAP = "\ufdd0"
_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?\z"
_DOT_SEGMENT = r"(?i)/(?:\.|%2e){1,2}(?:[/?#]|\z)"
# Characters that never need encoding, and a host that is already in normal form.
_TAME_SEGMENT = r"[A-Za-z0-9\-._~!$&()*+,;=:@%]"
_TAME = r"[A-Za-z0-9\-._~!$&()*+,;=:@%/?#]"
_PLAIN_HOST = r"[a-z0-9\-]+(?:\.[a-z0-9\-]+)*"
_BAD_HOST = r"[\x00-\x20\"#%/<>?@\\^`{|}]"


def percent_encode(text: ColumnOrName, unsafe: str) -> Column:
    """Percent-encode the characters of a class as UTF-8 bytes; ``%`` itself is kept."""

    def encode_run(run: Column) -> Column:
        return F.when(run.rlike(f"^[{unsafe}]"), replace_all(F.hex(run), "(..)", "%$1")).otherwise(run)

    runs = f"[{unsafe}]+|[^{unsafe}]+"
    return bind(
        text,
        lambda v: F.when(
            v.rlike(f"[{unsafe}]"),
            F.array_join(F.transform(F.regexp_extract_all(v, F.lit(runs), F.lit(0)), encode_run), ""),
        ).otherwise(v),
    )


def remove_dot_segments(path: ColumnOrName) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""

    def fold(v: Column) -> Column:
        segments = F.split(F.substring(v, 2, 1 << 30), "/")
        plain = F.transform(segments, lambda s: F.replace(F.lower(s), F.lit("%2e"), F.lit(".")))
        last = F.element_at(plain, -1)

        def step(kept: Column, segment: Column) -> Column:
            dots = F.replace(F.lower(segment), F.lit("%2e"), F.lit("."))
            return (
                F.when(
                    dots == "..",
                    F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1))),
                )
                .when(dots == ".", kept)
                .otherwise(F.concat(kept, F.array(segment)))
            )

        kept = F.aggregate(segments, F.array(F.lit("")), step)
        tail = F.when(last.isin(".", ".."), F.array(F.lit(""))).otherwise(
            F.array().cast("array<string>")
        )
        return bind(
            F.array_join(F.concat(kept, tail), "/"),
            lambda joined: F.when(joined == "", F.lit("/")).otherwise(joined),
        )

    return bind(
        path, lambda v: F.when(v.rlike(r"(?i)/(?:\.|%2e){1,2}(?:/|\z)"), fold(v)).otherwise(v)
    )


def _split(url: Column) -> Column:
    """``[scheme, //authority, path, ?query, #fragment]``, absent parts empty."""
    return F.split(replace_all(url, _PARTS, _GAP.join(f"${i}" for i in range(1, 6))), _GAP)


def _clean(url: Column) -> Column:
    """Trim, drop tabs and line breaks, and read backslashes before the query as slashes."""
    bare = replace_all(url, r"^[\x00-\x20]+|[\x00-\x20]+\z|[\t\n\r]", "")
    return bind(
        bare,
        lambda v: F.when(
            v.contains("\\"),
            F.concat(
                F.translate(F.regexp_extract(v, r"^[^?#]*", 0), "\\", "/"),
                F.regexp_extract(v, r"(?s)[?#].*\z", 0),
            ),
        ).otherwise(v),
    )


# The parameters of punycode.
_BASE, _T_MIN, _T_MAX, _SKEW, _DAMP, _FIRST_BIAS, _FIRST_CODE = 36, 1, 26, 38, 700, 72, 128
_DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
# Steps that are enough for any label: digits of a number below 2^63, and divisions of the bias.
_MOST_DIGITS, _MOST_DIVISIONS = 14, 13


def _digits(delta: Column, bias: Column) -> Column:
    """A number in punycode's digits of varying base."""

    def step(s: Column, k: Column) -> Column:
        t = F.least(F.greatest(k * _BASE - bias, F.lit(_T_MIN)), F.lit(_T_MAX))
        last = s["q"] < t
        digit = F.when(last, s["q"]).otherwise(t + F.pmod(s["q"] - t, _BASE - t))
        shown = F.substring(F.lit(_DIGITS), (digit + 1).cast("int"), F.lit(1))
        rest = F.when(~last, F.floor((s["q"] - t) / (_BASE - t)).cast("bigint"))
        return F.when(s["q"].isNull(), s).otherwise(F.struct(rest.alias("q"), F.concat(s["out"], shown).alias("out")))

    start = F.struct(delta.cast("bigint").alias("q"), F.lit("").alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(_MOST_DIGITS)), start, step, lambda s: s["out"])


def _next_bias(delta: Column, size: Column, is_first: Column) -> Column:
    halved = F.floor(delta / F.when(is_first, _DAMP).otherwise(2))
    most = (_BASE - _T_MIN) * _T_MAX // 2

    def step(s: Column, _: Column) -> Column:
        smaller = F.struct(F.floor(s["d"] / (_BASE - _T_MIN)).cast("bigint").alias("d"), (s["k"] + _BASE).alias("k"))
        return F.when(s["d"] > most, smaller).otherwise(s)

    start = F.struct((halved + F.floor(halved / size)).cast("bigint").alias("d"), F.lit(0).alias("k"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(_MOST_DIVISIONS)),
        start,
        step,
        lambda s: (s["k"] + F.floor((_BASE - _T_MIN + 1) * s["d"] / (s["d"] + _SKEW))).cast("bigint"),
    )


def punycode(label: ColumnOrName) -> Column:
    """The punycode of a label: its ASCII characters, then where and what the others are.

    A decoder inserts the other characters one by one, by code and then place. Each is told as the
    distance from the state after the one before, a state being (code, index in what is there so far).
    """

    def encode(chars: Column) -> Column:
        codes = F.transform(chars, lambda c: F.ascii(c))
        basic = F.filter(chars, lambda c: F.ascii(c) < _FIRST_CODE)

        def inserted(cs: Column) -> Column:
            others = F.filter(
                F.transform(cs, lambda c, i: F.struct(c.alias("code"), i.alias("at"))), lambda x: x["code"] >= _FIRST_CODE
            )

            def index(x: Column) -> Column:
                return F.size(F.filter(cs, lambda c, j: (c < x["code"]) & (j < x["at"]) | (c == x["code"]) & (j < x["at"])))

            ordered = F.transform(F.array_sort(others), lambda x: F.struct(x["code"].alias("code"), index(x).alias("index")))
            start = F.struct(
                F.lit(_FIRST_CODE).alias("code"),
                F.lit(0).alias("index"),
                F.lit(_FIRST_BIAS).cast("bigint").alias("bias"),
                F.size(basic).alias("n"),
                F.when(F.size(basic) > 0, F.concat(F.array_join(basic, ""), F.lit("-"))).otherwise(F.lit("")).alias("out"),
            )

            def step(s: Column, x: Column) -> Column:
                delta = (x["code"] - s["code"]).cast("bigint") * (s["n"] + 1) + x["index"] - s["index"]
                return bind(
                    delta,
                    lambda d: F.struct(
                        x["code"].alias("code"),
                        (x["index"] + 1).alias("index"),
                        _next_bias(d, s["n"] + 1, s["n"] == F.size(basic)).alias("bias"),
                        (s["n"] + 1).alias("n"),
                        F.concat(s["out"], _digits(d, s["bias"])).alias("out"),
                    ),
                )

            return F.aggregate(ordered, start, step, lambda s: s["out"])

        return bind(codes, inserted)

    return bind(F.regexp_extract_all(col(label), F.lit("(?s)."), F.lit(0)), encode)


def ascii_host(host: ColumnOrName) -> Column:
    """A host lower-cased, its labels outside ASCII in their ``xn--`` form. Composed characters are expected."""

    def labels(v: Column) -> Column:
        parts = F.split(F.translate(v, "\u3002\uff0e\uff61", "..."), r"\.")
        wide = lambda x: F.when(x.rlike(r"[^\x00-\x7f]"), F.concat(F.lit("xn--"), punycode(x))).otherwise(x)
        return F.array_join(F.transform(parts, wide), ".")

    return bind(F.lower(col(host)), lambda v: F.when(v.rlike(r"[^\x00-\x7f]"), labels(v)).otherwise(v))


def _authority_text(authority: Column, scheme: Column) -> Column:
    """``user@host:port`` with the host in normal form and a default port dropped; null if malformed."""
    user = F.regexp_extract(authority, r"(?s)^(.*@)", 1)
    host_port = F.regexp_extract(authority, r"(?s)([^@]*)\z", 1)

    def build(hp: Column) -> Column:
        return bind(ascii_host(F.regexp_extract(hp, r"^(\[[^\]]*\]|[^:]*)", 1)), lambda host: shown_of(hp, host))

    def shown_of(hp: Column, host: Column) -> Column:
        port = F.ltrim(F.regexp_extract(hp, r":([0-9]*)\z", 1), F.lit("0"))
        zero = hp.rlike(r":0+\z")
        good = (
            hp.rlike(r"^(?:\[[^\]]*\]|[^:]*)(?::[0-9]*)?\z")
            & (F.length(host) > 0)
            & ~host.rlike(_BAD_HOST)
            & ((F.length(port) == 0) | (port.try_cast("int") <= 65535))
        )
        default = F.create_map(*[F.lit(x) for kv in DEFAULT_PORTS.items() for x in kv])[scheme]
        shown = (
            F.when(zero, F.lit(":0"))
            .when((F.length(port) == 0) | F.coalesce(port == default, F.lit(False)), F.lit(""))
            .otherwise(F.concat(F.lit(":"), port))
        )
        return F.when(good, F.concat(user, host, shown))

    return bind(host_port, build)


def is_absolute_url(url: ColumnOrName) -> Column:
    """Whether a text can serve as a base: an http-like URL with a host, or another scheme."""
    web = "|".join(DEFAULT_PORTS)
    return F.coalesce(
        F.when(col(url).rlike(rf"(?i)^\s*(?:{web}):"), col(url).rlike(rf"(?i)^\s*(?:{web}):/*[^/?#\s]"))
        .otherwise(col(url).rlike(r"^\s*[A-Za-z][A-Za-z0-9+.\-]*:")),
        F.lit(False),
    )


@per_session
def resolve_url(base: ColumnOrName, href: ColumnOrName) -> Column:
    """Absolute, normalised form of ``href`` against ``base``; null if that is impossible.

    Hosts are lower-cased, default ports dropped, dot segments removed, an empty path becomes
    ``/`` and unsafe characters are percent-encoded. Host names outside ASCII get their ``xn--`` form.
    """
    web = list(DEFAULT_PORTS)
    base, href = col(base), col(href)

    def join(b: Column, h: Column) -> Column:
        base_scheme = F.lower(b[0])
        own_scheme = F.lower(h[0])
        same_web = own_scheme.isin(web) & (own_scheme == base_scheme) & (h[1] == "")
        # ``http:path`` under the same scheme is relative; under another one it names a host.
        scheme = F.when(own_scheme == "", base_scheme).otherwise(own_scheme)
        inherits = (own_scheme == "") | same_web
        odd_web = own_scheme.isin(web) & ~same_web & (F.regexp_replace(h[1], "^//", "") == "")
        odd_rest = F.regexp_replace(h[2], "^/+", "")
        authority = (
            F.when(odd_web, F.regexp_extract(odd_rest, "^([^/]*)", 1))
            .when(h[1] != "", F.substring(h[1], 3, 1 << 30))
            .when(inherits, F.substring(b[1], 3, 1 << 30))
            .otherwise(F.lit(""))
        )
        base_path = F.when(b[2] == "", F.lit("/")).otherwise(b[2])
        path = (
            F.when(odd_web, F.regexp_extract(odd_rest, r"(?s)^[^/]*(.*)\z", 1))
            .when((h[1] != "") | ~inherits | h[2].startswith("/"), h[2])
            .when(h[2] == "", base_path)
            .otherwise(F.concat(F.regexp_extract(base_path, r"(?s)^(.*/)", 1), h[2]))
        )
        rooted = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
        keeps_query = inherits & (h[1] == "") & (h[2] == "") & (h[3] == "")
        query = F.when(keeps_query, b[3]).otherwise(h[3])
        joined = F.concat(
            scheme,
            F.lit("://"),
            _authority_text(authority, scheme),
            percent_encode(remove_dot_segments(rooted), UNSAFE_PATH),
            F.when(query == "", query).otherwise(
                F.concat(F.lit("?"), percent_encode(F.substring(query, 2, 1 << 30), UNSAFE_QUERY))
            ),
            F.when(h[4] == "", h[4]).otherwise(
                F.concat(F.lit("#"), percent_encode(F.substring(h[4], 2, 1 << 30), UNSAFE_FRAGMENT))
            ),
        )
        opaque = F.concat(
            own_scheme,
            F.lit(":"),
            h[1],
            percent_encode(F.concat(h[2], h[3], h[4]), r"\x00-\x1f\x{7f}-\x{10ffff}"),
        )
        return F.when((own_scheme != "") & ~own_scheme.isin(web), opaque).when(scheme.isin(web), joined)

    general = bind(
        _split(_clean(F.coalesce(base, F.lit("")))),
        lambda b: bind(_split(_clean(href)), lambda h: join(b, h)),
    )
    # Most links are in normal form already or rooted on a plain host; those need no taking apart.
    tame = ~href.rlike(_DOT_SEGMENT)
    plain_host = rf"^https?://{_PLAIN_HOST}"
    return (
        F.when(href.rlike(rf"{plain_host}/{_TAME}*\z") & tame & is_absolute_url(base), href)
        .when(
            href.rlike(rf"^/(?:{_TAME_SEGMENT}{_TAME}*)?\z") & tame & base.rlike(rf"{plain_host}(?:[/?#]|\z)"),
            F.concat(F.regexp_extract(base, plain_host, 0), href),
        )
        .otherwise(general)
    )


def resolve_or_keep(base: ColumnOrName, href: ColumnOrName) -> Column:
    """Item permalinks: the resolved URL, or the raw href where it cannot be resolved."""
    return F.coalesce(resolve_url(base, href), col(href))


@per_session
def authority(url: ColumnOrName) -> Column:
    """``host:port`` with the scheme's default port filled in (0 if it has none).

    Text that is not a URL is its own key.
    """

    def build(p: Column) -> Column:
        scheme = F.lower(p[0])
        host_port = F.regexp_extract(F.substring(p[1], 3, 1 << 30), r"(?s)([^@]*)\z", 1)
        port = none_if_blank(F.regexp_extract(host_port, r":([0-9]+)\z", 1))
        default = F.create_map(*[F.lit(x) for kv in DEFAULT_PORTS.items() for x in kv])[scheme]
        number = F.coalesce(port.try_cast("int").cast("string"), default, F.lit("0"))
        web = scheme.isin(list(DEFAULT_PORTS))

        def key(host: Column) -> Column:
            bad = (scheme == "") | (web & ((host == "") | host.rlike(_BAD_HOST)))
            return F.when(bad, col(url)).otherwise(F.concat(host, F.lit(":"), number))

        return bind(ascii_host(F.regexp_extract(host_port, r"^(\[[^\]]*\]|[^:]*)", 1)), key)

    return bind(_split(_clean(col(url))), build)


def none_if_blank(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def classify_feed_link(mime: ColumnOrName, href: ColumnOrName) -> Column:
    """Feed type of a page link, or null to reject it.

    A declared type decides alone; only without one does the file extension count.
    """
    declared = F.lower(F.trim(F.split_part(col(mime), F.lit(";"), F.lit(1))))
    by_type = (
        F.when(declared == "application/rss+xml", F.lit("rss"))
        .when(declared == "application/atom+xml", F.lit("atom"))
        .when(declared.isin("application/json", "application/feed+json"), F.lit("json"))
    )
    by_name = F.when(col(href).rlike(r"(?i)^[^?#]*\.(?:rss|atom|xml)(?:[?#]|\z)"), F.lit("unknown"))
    return F.when(col(mime).isNull(), by_name).otherwise(by_type)
