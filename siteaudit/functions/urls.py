"""URLs as Column expressions, after the public URL standard. Every function takes and returns Columns; nulls stay null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Schemes with an authority, their default ports, and the characters that stay as they are.
SPECIAL = ["http", "https", "ws", "wss", "ftp"]
DEFAULT_PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}
PATH_SAFE = "!$%&'()*+,\\-./0-9:;=@A-Z\\[\\\\\\]_a-z|~"
QUERY_SAFE = "!$%&()*+,\\-./0-9:;=?@A-Z\\[\\\\\\]^_`a-z{|}~"
FRAGMENT_SAFE = "!#$%&'()*+,\\-./0-9:;=?@A-Z\\[\\\\\\]^_a-z{|}~"
OPAQUE_SAFE = "\\x20-\\x7e"

_SCHEME = "^([A-Za-z][A-Za-z0-9+.\\-]*):"


def let(body: Callable[[Column], Column], **values: Column) -> Column:
    """body of a struct of values, each computed once: an expression that is used twice would double the plan at each level."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body), F.lit(0))


def url_parts(url: Column) -> Column:
    """Struct of scheme, host, port, path, query, fragment and origin of an absolute URL; query and fragment are null if absent, origin is null without a host, port too if it is no number of nine digits or fewer."""
    return F.when(url.isNotNull(), let(lambda s: _parts(s["url"]), url=url))


def _parts(url: Column) -> Column:
    has = lambda pattern: url.rlike(pattern)
    scheme = F.lower(F.regexp_extract(url, _SCHEME, 1))
    authority = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)", 1)
    host_port = F.regexp_replace(authority, "^.*@", "")
    host = F.lower(F.regexp_replace(host_port, ":[0-9]*$", ""))
    port = F.regexp_extract(host_port, ":([0-9]*)$", 1)
    path = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.\\-]*:(?://[^/?#]*)?([^?#]*)", 1)
    query = F.when(has("^[^#]*\\?"), F.regexp_extract(url, "^[^?#]*\\?([^#]*)", 1))
    fragment = F.when(has("#"), F.regexp_extract(url, "#((?s).*)$", 1))
    real_port = F.when(port != "", port).otherwise(default_port(scheme))
    origin = F.when(host != "", F.concat(scheme, F.lit("://"), host, F.lit(":"), F.coalesce(real_port, F.lit(""))))
    return F.struct(scheme.alias("scheme"), host.alias("host"), F.when(port.rlike("^0*[0-9]{1,9}$"), port.cast("int")).alias("port"), path.alias("path"), query.alias("query"), fragment.alias("fragment"), origin.alias("origin"))


def default_port(scheme: Column) -> Column:
    """The scheme's default port as text, or null."""
    out = F.lit(None).cast("string")
    for k, v in DEFAULT_PORTS.items():
        out = F.when(scheme == k, F.lit(v)).otherwise(out)
    return out


def strip_fragment(url: Column) -> Column:
    """The key under which a URL is fetched and visited."""
    return F.regexp_replace(url, "#(?s).*$", "")


def fragment_of(url: Column) -> Column:
    """What follows the first #; empty for a closing #, null for none."""
    return F.when(url.contains("#"), F.regexp_extract(url, "#((?s).*)$", 1))


def link_class(url: Column) -> Column:
    """data, document (http and https) or other."""
    scheme = F.lower(F.regexp_extract(url, _SCHEME, 1))
    return F.when(url.isNull(), F.lit(None)).when(scheme == "data", "data").when(scheme.isin("http", "https"), "document").otherwise("other")


def percent_encode(text: Column, safe: str) -> Column:
    """Characters outside safe (a character class) as percent signs and hex digits of their UTF-8."""

    def coded(t: Column) -> Column:
        runs = F.regexp_extract_all(t, F.lit(f"[{safe}]+|[^{safe}]+"), F.lit(0))
        shown = F.transform(runs, lambda r: F.when(r.rlike(f"^[{safe}]"), r).otherwise(F.replace(F.url_encode(r), F.lit("+"), F.lit("%20"))))
        return F.when(t.rlike(f"[^{safe}]"), F.concat_ws("", shown)).otherwise(t)

    return let(lambda s: coded(s["text"]), text=text)


def remove_dots(path: Column) -> Column:
    """Path without . and .. segments; it begins with a slash."""
    one, two = (lambda x: F.lower(x).isin(".", "%2e")), (lambda x: F.lower(x).isin("..", ".%2e", "%2e.", "%2e%2e"))

    def work(p: Column) -> Column:
        parts = F.split(F.regexp_replace(p, "^/", ""), "/", -1)
        kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(one(x), acc).when(two(x), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))))
        return F.when(p.rlike("(?i)/(\\.|%2e)"), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(p)

    closed = F.regexp_replace(path, "(?i)(/(?:\\.|%2e){1,2})$", "$1/")
    return let(lambda s: work(s["path"]), path=closed)


def _authority(scheme: Column, text: Column) -> Column:
    """Host in lower case and the port unless it is the default one; null if it can't be parsed."""

    def work(s: Column) -> Column:
        shown = F.when((s["port"] == "") | F.coalesce(s["port"] == default_port(s["scheme"]), F.lit(False)), F.lit("")).otherwise(F.concat(F.lit(":"), s["port"]))
        bad = (s["host"] == "") | (s["host"].rlike("[\\x00-\\x20\"#%/:<>?@\\\\^`{|}]") & ~s["host"].rlike("^\\[[0-9a-f:.]+\\]$"))
        bad = bad | (F.length(s["port"]) > 5) | (F.lpad(s["port"], 5, "0") > "65535")
        return F.when(~bad, F.concat(s["user"], s["host"], shown))

    def split(s: Column) -> Column:
        port = F.regexp_replace(F.regexp_extract(s["rest"], ":([0-9]*)$", 1), "^0+(?=[0-9])", "")
        return let(work, scheme=s["scheme"], user=s["user"], host=F.lower(F.regexp_replace(s["rest"], ":[0-9]*$", "")), port=port)

    return let(split, scheme=scheme, user=F.regexp_extract(text, "^(.*@)", 1), rest=F.regexp_replace(text, "^.*@", ""))


def resolve_url(base: Column, href: Column) -> Column:
    """href joined to the absolute URL base, or null where it can't be parsed.

    White space around href and tabs and line ends in it go; backslashes are slashes; host names are not
    converted to ASCII.
    """
    text = F.regexp_replace(F.regexp_replace(href, "^[\\x00-\\x20]+|[\\x00-\\x20]+$", ""), "[\\t\\n\\r]", "")
    return F.when(href.isNotNull(), let(_with_schemes, base=base, text=text))


def _with_schemes(s: Column) -> Column:
    given, b_scheme = F.lower(F.regexp_extract(s["text"], _SCHEME, 1)), F.lower(F.regexp_extract(s["base"], _SCHEME, 1))
    return let(_with_rest, base=s["base"], text=s["text"], given=given, b_scheme=b_scheme, after=F.regexp_replace(s["text"], _SCHEME, ""))


def _with_rest(s: Column) -> Column:
    # "https:/x" with a base of the same scheme is relative
    same = s["given"].isin(*SPECIAL) & F.coalesce(s["given"] == s["b_scheme"], F.lit(False)) & ~s["after"].rlike("^[/\\\\]{2}")
    relative = (s["given"] == "") | same
    rest = F.when(s["given"] == "", s["text"]).otherwise(s["after"])
    head = F.translate(F.regexp_extract(rest, "^([^?#]*)", 1), "\\", "/")
    return let(
        _joined,
        base=s["base"], text=s["text"], given=s["given"], after=s["after"], relative=relative, head=head,
        scheme=F.when(relative, s["b_scheme"]).otherwise(s["given"]),
        query=F.regexp_extract(rest, "^[^?#]*(\\?[^#]*)", 1),
        frag=F.regexp_extract(rest, "^[^#]*(#(?s).*)", 1),
        own=~relative | head.startswith("//"),
        b_authority=F.regexp_extract(s["base"], "^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)", 1),
        b_path=F.regexp_extract(s["base"], "^[A-Za-z][A-Za-z0-9+.\\-]*:(?://[^/?#]*)?([^?#]*)", 1),
        b_query=F.regexp_extract(s["base"], "^[^?#]*(\\?[^#]*)", 1),
    )


def _joined(s: Column) -> Column:
    head = s["head"]
    authority = F.when(s["own"], F.regexp_extract(head, "^/*([^/]*)", 1)).otherwise(s["b_authority"])
    path = (
        F.when(s["own"], F.regexp_replace(head, "^/*[^/]*", ""))
        .when(head.startswith("/"), head)
        .when(head == "", s["b_path"])
        .otherwise(F.concat(F.regexp_extract(s["b_path"], "^((?s).*/)", 1), head))
    )
    path = F.regexp_replace(path, "^(?!/)", "/")
    query = F.when((head == "") & (s["query"] == "") & ~s["own"], s["b_query"]).otherwise(percent_encode(s["query"], QUERY_SAFE))
    joined = F.concat(s["scheme"], F.lit("://"), _authority(s["scheme"], authority), percent_encode(remove_dots(path), PATH_SAFE), query, percent_encode(s["frag"], FRAGMENT_SAFE))
    opaque = F.concat(s["given"], F.lit(":"), percent_encode(s["after"], OPAQUE_SAFE))
    only_fragment = F.concat(strip_fragment(s["base"]), percent_encode(s["text"], FRAGMENT_SAFE))
    special = s["scheme"].isin(*SPECIAL)
    return F.when((s["given"] != "") & ~s["given"].isin(*SPECIAL), opaque).when(special, joined).when((s["given"] == "") & s["text"].startswith("#"), only_fragment)


def truncate_url(url: Column) -> Column:
    """data URLs of over 64 characters end after 64 of them, in dots."""
    return F.when(F.lower(F.substring(url, 1, 5)).eqNullSafe("data:") & (F.length(url) > 64), F.concat(F.substring(url, 1, 64), F.lit("..."))).otherwise(url)
