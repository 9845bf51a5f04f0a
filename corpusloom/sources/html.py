"""Raw pages as Markdown lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def markdown(html: Column) -> Column:
    """Headings, list items and paragraphs of a page, a line each; layout (nav, footer, ads) as lines too; other tags go."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|head)\b.*?</\1>|<!--.*?-->|<!doctype[^>]*>", "")
    t = F.regexp_replace(t, r"(?i)<h1[^>]*>", "\n\n# ")
    t = F.regexp_replace(t, r"(?i)<li[^>]*>", "\n* ")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>|</(?:li|ul)>|<(?:ul|nav|footer|div|article)[^>]*>", "\n")
    t = F.regexp_replace(t, r"(?i)</?p[^>]*>|</(?:h1|nav|footer|div|article)>", "\n\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    for name, mark in (("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(mark))
    return t


def documents(pages: DataFrame) -> DataFrame:
    """``(doc_id, text)`` of ``pages(page_id, html)``."""
    return pages.select(F.col("page_id").alias("doc_id"), markdown(F.col("html")).alias("text"))
