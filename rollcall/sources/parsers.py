"""Pages and roll-call texts as columns: what a scraper would extract, from text already at hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strip_tags(html: Column) -> Column:
    """The text of a page: scripts and styles go, tags become blanks, common entities are read."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def links(pages: DataFrame, key: str, html: str, pattern: str = r"(?i)href\s*=\s*[\"']([^\"'#]+)") -> DataFrame:
    """(key, ord, url) of a page's links; the first of equal ones stays."""
    return pages.select(key, F.posexplode(F.array_distinct(F.regexp_extract_all(html, F.lit(pattern), 1))).alias("ord", "url"))


def document_ids(pages: DataFrame, key: str, html: str) -> DataFrame:
    """The distinct ids of documents that slip links name, in order."""
    return links(pages, key, html, r"(?i)href\s*=\s*[\"'][^\"']*witnessslip[^\"']*[?&]LegDocId=(\d+)").withColumnRenamed("url", "doc_id")


def table_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, ord, cells) of the rows of a page's tables."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"), 1)
    out = pages.select(key, F.posexplode(rows).alias("ord", "row"))
    return out.select(key, "ord", F.transform(F.regexp_extract_all("row", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]\s*>"), 1), strip_tags).alias("cells")).where(F.size("cells") > 0)


def bill_page(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Number, synopsis and last action of a status page."""
    text = strip_tags(F.col(html))
    return pages.select(
        key,
        F.regexp_extract(text, r"\b([HS](?:B|R|JR|JRCA)\s?\d{1,5})\b", 1).alias("bill_number"),
        F.trim(F.regexp_extract(text, r"(?i)synopsis as introduced\s*(.*?)\s*(?:last action|actions|$)", 1)).alias("synopsis"),
        F.trim(F.regexp_extract(text, r"(?i)last action\s*(.*?)\s*(?:synopsis|actions|$)", 1)).alias("last_action"),
    )


#: A line of a roll call holds codes and names; E (excused) and A (absent) count as not voting (fixed values).
CODE = r"(?m)(?:^|\s)(NV|Y|N|P|E|A)\s+([A-Z][A-Za-z'.\-]+(?:,\s?[A-Z][A-Za-z.]*)?(?:\s(?:Jr\.|Sr\.|II|III|IV))?)"


def roll_call(rows: DataFrame, text: str) -> DataFrame:
    """Adds yea_votes, nay_votes, present_votes, nv_votes, and the printed tally, from a roll call's text."""
    codes, names = F.regexp_extract_all(text, F.lit(CODE), 1), F.regexp_extract_all(text, F.lit(CODE), 2)
    pairs = F.arrays_zip(codes.alias("code"), names.alias("name"))

    def of(*wanted: str) -> Column:
        return F.transform(F.filter("__pairs", lambda p: p["code"].isin(*wanted)), lambda p: F.trim(p["name"]))

    out = rows.withColumn("__pairs", pairs)
    out = out.withColumns({"yea_votes": of("Y"), "nay_votes": of("N"), "present_votes": of("P"), "nv_votes": of("NV", "E", "A")})
    tally = r"(\d{1,3})\s+YEAS?\s+(\d{1,3})\s+NAYS?(?:\s+(\d{1,3})\s+PRESENT)?"
    return out.withColumns({"printed_yeas": F.regexp_extract(text, tally, 1).try_cast("int"), "printed_nays": F.regexp_extract(text, tally, 2).try_cast("int")}).drop("__pairs")


def parent_number(number: Column, parent: Column) -> Column:
    """An amendment's rows count for the bill that it amends."""
    return F.when(F.coalesce(parent, F.lit("")) != "", parent).otherwise(number)


def validate(rows: DataFrame, required: tuple[str, ...], recommended: tuple[str, ...] = (), strict: bool = False) -> DataFrame:
    """Adds warnings: which fields are empty. strict raises at the first required one."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    warn = F.array_compact(F.array(*(F.when(empty(c), F.lit(f"missing required {c}")) for c in required), *(F.when(empty(c), F.lit(f"missing recommended {c}")) for c in recommended)))
    if strict:
        bad = F.exists(warn, lambda w: F.contains(w, F.lit("required")))
        warn = F.when(bad, F.raise_error(F.array_join(warn, "; ")).cast("array<string>")).otherwise(warn)
    return rows.withColumn("warnings", warn)
