"""Faults of documents as a whole, as result rows beside those of their links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteaudit.functions.text import qualify_name
from siteaudit.functions.urls import let
from siteaudit.operators.elements import SVG_NS
from siteaudit.operators.extract import tag_values, xml_tag_strings
from siteaudit.operators.report import css_faults, svg_faults
from siteaudit.operators.sites import match_site

#: Element that faults of a document belong to.
DOCUMENT = "#document"


def svg_root(svg: Column) -> Column:
    """Struct of name (qualified) and namespace of the root element of an SVG text; null without any tag."""

    def work(s: Column) -> Column:
        space = lambda name: F.get(F.filter(tag_values(s["tag"]), lambda a: a["name"] == name)["value"], F.lit(0))
        told = lambda t: F.struct(qualify_name(t["space"], t["prefix"], t["local"]).alias("name"), t["space"].alias("namespace"))
        raw = F.regexp_extract(s["tag"], "^<([^\\s/>]*+)", 1)
        prefix = F.regexp_extract(raw, "^(.*):", 1)
        own = F.when(prefix == "", space("xmlns")).otherwise(space(F.concat(F.lit("xmlns:"), F.lower(prefix))))
        return F.when(s["tag"].isNotNull(), let(told, space=own, prefix=prefix, local=F.regexp_replace(raw, "^.*:", "")))

    return let(work, tag=F.get(xml_tag_strings(svg), F.lit(0)))


def _fault(kind: str, message: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), message.alias("message"))


def document_faults(docs: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """doc_url, element (#document), item, error_kind, error of documents: url, doc_type, body (text; null for one that can't be read).

    unreadable: no body; css_syntax and xml_syntax: one item for each message, sorted; sitemap: one for a sitemap that isn't
    well-formed; invalid_namespace and invalid_root_element: SVG documents whose site validates SVG (validate_svg of sites)
    and doesn't ignore the root's name. Narrow but for the join with the sites.
    """
    kind, body, none = F.col("doc_type"), F.col("body"), F.array().cast("array<struct<kind:string,message:string>>")
    each = lambda name, head, messages: F.transform(messages, lambda m: _fault(name, F.concat(F.lit(head), m)))
    found = (
        F.when(kind.isNull(), none)
        .when(body.isNull(), F.array(_fault("unreadable", F.lit("document cannot be read"))))
        .when(kind == "css", each("css_syntax", "invalid CSS: ", css_faults(body)))
        .when(kind == "svg", each("xml_syntax", "invalid XML: ", svg_faults(body)))
        .when((kind == "sitemap") & (F.size(svg_faults(body)) > 0), F.array(_fault("sitemap", F.lit("sitemap cannot be read"))))
        .otherwise(none)
    )
    rows = docs.select(F.col("url").alias("doc_url"), found.alias("found"), F.when((kind == "svg") & body.isNotNull(), svg_root(body)).alias("root"))
    if sites is not None and "validate_svg" in sites.columns:
        rows = match_site(rows, sites, "doc_url")
        ignored = F.coalesce(F.col("site.svg_ignored_elements"), F.array().cast("array<string>")) if "svg_ignored_elements" in sites.columns else F.array().cast("array<string>")
        judged = F.coalesce(F.col("site.validate_svg"), F.lit(False)) & F.col("root").isNotNull() & ~F.exists(ignored, lambda p: F.regexp_like(F.col("root.name"), F.concat(F.lit("^(?:"), p, F.lit(")$"))))
        wrong = F.array_compact(F.array(
            F.when(~F.col("root.namespace").eqNullSafe(SVG_NS), _fault("invalid_namespace", F.concat(F.lit(f"namespace expected {SVG_NS} but got "), F.coalesce("root.namespace", F.lit("none"))))),
            F.when(F.col("root.name") != "svg", _fault("invalid_root_element", F.concat(F.lit("root element expected svg but got "), F.col("root.name")))),
        ))
        rows = rows.withColumn("found", F.when(judged, F.concat("found", wrong)).otherwise(F.col("found")))
    rows = rows.select("doc_url", F.posexplode("found").alias("item", "f"))
    return rows.select("doc_url", F.lit(DOCUMENT).alias("element"), "item", F.col("f.kind").alias("error_kind"), F.col("f.message").alias("error"))


def readable(docs: DataFrame) -> DataFrame:
    """docs (url, doc_type, body in bytes) with their body as text: HTML with replacement characters for bytes that aren't UTF-8, null for any other document that isn't UTF-8."""
    text = F.col("body").cast("string")
    return docs.withColumn("body", F.when(F.col("doc_type") == "html", F.make_valid_utf8(text)).otherwise(F.try_validate_utf8(text)))
