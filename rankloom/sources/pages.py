"""Raw web pages -> listing fields, with regex column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import tokens

# The HTML entities decoded in page text (``&amp;`` last).
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def decode_entities(c: Column) -> Column:
    for a, b in ENTITIES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def page_fields(pages: DataFrame) -> DataFrame:
    """Title, site host, declared language and the article text of each page."""
    html = F.col("html")
    title = squeeze(decode_entities(F.regexp_extract(html, r"(?s)<title[^>]*>(.*?)</title>", 1)))
    body = F.regexp_extract(html, r"(?s)<article[^>]*>(.*?)</article>", 1)
    text = squeeze(decode_entities(F.regexp_replace(body, r"<[^>]*>", " ")))
    site = F.lower(F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1))
    lang = F.lower(F.regexp_extract(html, r"<html[^>]*\slang=\"([^\"]*)\"", 1))
    return pages.select("page_id", "url", site.alias("site"), lang.alias("lang"), title.alias("title"),
                        text.alias("text")).withColumn("n_words", F.size(tokens(F.col("text"))).cast("bigint"))
