"""HTML to page items in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import utrim

_BLOCKS = "address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul"


def html_items(html: Column) -> Column:
    """Texts of a page's blocks in order; scripts, styles and comments hold none."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|noscript|template)\b.*?</\1\s*>", " ")
    lines = F.regexp_replace(F.regexp_replace(bare, r"\s+", " "), rf"(?i)</?(?:{_BLOCKS})\b[^>]*>", "\n")
    plain = F.regexp_replace(lines, r"<[^>]*>", "")
    for name, mark in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("apos", "'"), ("nbsp", " "), ("amp", "&")):
        plain = F.replace(plain, F.lit(f"&{name};"), F.lit(mark))
    return F.filter(F.transform(F.split(plain, "\n"), utrim), lambda x: x != "")


def page_items(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, pos, text of every block of every page."""
    return pages.select(key, F.posexplode(html_items(F.col(html))).alias("pos", "text")).withColumn("pos", F.col("pos").cast("bigint"))
