"""Media types, names, patterns, markup values and messages as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What each hint asks of a content type.
HINT_TYPES = {"css": "text/css", "html": "text/html", "robots": "text/plain", "svg": "image/svg+xml"}
SNIFFED = {"text/css": "css", "text/html": "html", "image/svg+xml": "svg"}
# Canonical prefixes of namespaces; elements of the bare ones keep their local names.
BARE_NAMESPACES = ["http://www.w3.org/1999/xhtml", "http://www.w3.org/2000/svg", "http://www.w3.org/1998/Math/MathML"]
PREFIXES = {
    "http://creativecommons.org/ns#": "cc",
    "http://purl.org/dc/elements/1.1/": "dc",
    "http://sodipodi.sourceforge.net/DTD/sodipodi-0.dtd": "sodipodi",
    "http://www.inkscape.org/namespaces/inkscape": "inkscape",
    "http://www.w3.org/1999/02/22-rdf-syntax-ns#": "rdf",
    "http://www.w3.org/1999/xlink": "xlink",
    "http://www.w3.org/XML/1998/namespace": "xml",
}
XMLNS = "http://www.w3.org/2000/xmlns/"
# Reasons that go with statuses in messages.
REASONS = {
    200: "OK", 201: "Created", 202: "Accepted", 204: "No Content", 206: "Partial Content",
    300: "Multiple Choices", 301: "Moved Permanently", 302: "Found", 303: "See Other", 304: "Not Modified", 307: "Temporary Redirect", 308: "Permanent Redirect",
    400: "Bad Request", 401: "Unauthorized", 403: "Forbidden", 404: "Not Found", 405: "Method Not Allowed", 408: "Request Timeout", 409: "Conflict", 410: "Gone", 418: "I'm a teapot", 429: "Too Many Requests",
    500: "Internal Server Error", 501: "Not Implemented", 502: "Bad Gateway", 503: "Service Unavailable", 504: "Gateway Timeout",
}


def media_type(headers: Column) -> Column:
    """Content-Type before the first semicolon, trimmed, case kept; null without the header. Header names are in lower case."""
    return F.trim(F.split_part(F.try_element_at(headers, F.lit("content-type")), F.lit(";"), F.lit(1)))


def document_type(media: Column, hint: Column) -> Column:
    """Struct of doc_type and error of a media type and a link's hint.

    Without a media type the hint holds. A hint wants its own type (sitemaps any type that ends in /xml) and
    gives content_type_invalid else; without a hint CSS, HTML and SVG are known by their type and anything
    else is no document.
    """
    low = F.lower(media)
    fits = hint == "sitemap"
    fits = fits & low.endswith("/xml")
    for h, t in HINT_TYPES.items():
        fits = fits | ((hint == h) & (low == t))
    sniffed = F.lit(None).cast("string")
    for t, d in SNIFFED.items():
        sniffed = F.when(low == t, F.lit(d)).otherwise(sniffed)
    doc = F.when(media.isNull(), hint).when(hint.isNull(), sniffed).when(fits, hint)
    bad = media.isNotNull() & hint.isNotNull() & ~fits
    return F.struct(doc.alias("doc_type"), F.when(bad, F.lit("content_type_invalid")).alias("error"))


def utf8_valid(body: Column) -> Column:
    """Whether a binary body is UTF-8; null for null."""
    return F.is_valid_utf8(body.cast("string"))


def status_accepted(status: Column, statuses: Column) -> Column:
    return F.array_contains(statuses, status)


def scheme_accepted(url: Column, schemes: Column) -> Column:
    """For http and https only; other links aren't checked."""
    return F.array_contains(schemes, F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.\\-]*):", 1)))


def matches_any(value: Column, patterns: list[str]) -> Column:
    """Whether one of the patterns occurs anywhere in value."""
    return value.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def full_match(value: Column, patterns: list[str]) -> Column:
    """Whether one of the patterns is all of value."""
    return value.rlike("^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")$") if patterns else F.lit(False)


def full_match_column(value: Column, patterns: Column) -> Column:
    """The same with an array of patterns in a column; null counts as none."""
    return F.exists(F.coalesce(patterns, F.array().cast("array<string>")), lambda p: F.regexp_like(value, F.concat(F.lit("^(?:"), p, F.lit(")$"))))


def wildcard_match(pattern: Column, name: Column) -> Column:
    """Exact, or for a pattern that ends in * a prefix; :* is any name without a colon."""
    prefix = F.substring(pattern, F.lit(1), F.length(pattern) - 1)
    return F.when(pattern == ":*", ~name.contains(":")).when(pattern.endswith("*"), F.startswith(name, prefix)).otherwise(pattern == name)


def value_matches(mode: Column, literals: Column, value: Column) -> Column:
    """mode any: always; literal: the value is one of the literals; token_list: one of its words is.

    literals: an array of structs (match, literal); match is exact, ci (ASCII case doesn't count) or token
    (runs of white space count as one space, those at the ends not at all).
    """
    squeezed = lambda x: F.trim(F.regexp_replace(x, "[ \\t\\n\\f\\r]+", " "))
    low = lambda x: F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    is_it = lambda v: F.exists(literals, lambda l: F.when(l["match"] == "exact", l["literal"] == v).when(l["match"] == "ci", low(l["literal"]) == low(v)).otherwise(squeezed(l["literal"]) == squeezed(v)))  # noqa: E731, E741
    words = F.filter(F.split(value, "[ \\t\\n\\f\\r]+"), lambda w: w != "")
    return F.when(mode == "any", F.lit(True)).when(mode == "token_list", F.exists(words, is_it)).otherwise(is_it(value))


def qualify_name(namespace: Column, prefix: Column, local: Column) -> Column:
    """Name with the canonical prefix of a known namespace; bare for HTML, SVG, MathML and no namespace; null for xmlns declarations.

    A canonical prefix that is bound to another namespace gives way to that namespace.
    """
    canonical = F.lit(None).cast("string")
    for ns, p in PREFIXES.items():
        canonical = F.when(namespace == ns, F.lit(p)).otherwise(canonical)
    known = prefix.isin(*PREFIXES.values())
    named = (
        F.when(canonical.isNotNull(), F.concat(canonical, F.lit(":"), local))
        .when(namespace.isNull() | (namespace == "") | namespace.isin(*BARE_NAMESPACES), local)
        .when(prefix.isNull() | (prefix == ""), local)
        .when(known, F.concat(namespace, F.lit(":"), local))
        .otherwise(F.concat(prefix, F.lit(":"), local))
    )
    return F.when(namespace == XMLNS, F.lit(None)).otherwise(named)


def status_text(status: Column) -> Column:
    """The status with its reason."""
    reasons = F.create_map(*[F.lit(x) for k, v in REASONS.items() for x in (k, v)])
    return F.concat_ws(" ", status.cast("string"), F.try_element_at(reasons, status.cast("int")))


def error_message(kind: Column, status: Column, scheme: Column, fragment: Column, expected: Column, actual: Column) -> Column:
    """The message of an error kind and what goes with it."""
    return (
        F.when(kind == "http_status", F.concat(F.lit("invalid status "), status_text(status)))
        .when(kind == "invalid_scheme", F.format_string('invalid scheme "%s"', scheme))
        .when(kind == "element_not_found", F.format_string("element for #%s not found", fragment))
        .when(kind == "content_type_invalid", F.format_string("content type expected %s but got %s", expected, actual))
        .when(kind == "url_parse", F.lit("URL cannot be parsed"))
        .when(kind == "too_many_redirects", F.lit("too many redirects"))
        .when(kind == "redirect_location", F.lit("location header not found on redirect"))
        .when(kind == "missing_response", F.lit("no response"))
        .when(kind == "robots_fetch", F.lit("robots.txt not fetched"))
        .when(kind == "data_url", F.lit("data URL cannot be decoded"))
        .otherwise(kind)
    )
