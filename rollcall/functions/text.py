"""Column functions on names, numbers, labels and free text. All but ratios and indel_ratio are built from Spark expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def compact_number(number: Column) -> Column:
    """HB0100 and HB100 both become HB100; anything else is upper-cased."""
    letters, digits = F.regexp_extract(number, r"^([A-Za-z]+)0*(\d+)", 1), F.regexp_extract(number, r"^([A-Za-z]+)0*(\d+)", 2)
    return F.when(digits != "", F.concat(F.upper(letters), digits)).otherwise(F.upper(number))


def padded_number(number: Column, width: int = 4) -> Column:
    """SB79 (SCA1) becomes SB0079: the bracketed end goes, the digits are filled up to width and never cut."""
    clean = F.trim(F.regexp_replace(number, r"\s*\(.*\)\s*$", ""))
    digits = F.regexp_extract(clean, r"^([A-Za-z]+)(\d+)$", 2)
    filled = F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0"))
    return F.when(digits != "", F.concat(F.upper(F.regexp_extract(clean, r"^([A-Za-z]+)(\d+)$", 1)), filled)).otherwise(F.upper(clean))


def number_parts(number: Column) -> Column:
    """A struct of kind, number and suffix; kind is the whole text where it is not letters and digits."""
    pattern = r"^([A-Za-z]+)(\d+)(.*)$"
    digits = F.regexp_extract(number, pattern, 2)
    return F.struct(
        F.when(digits != "", F.upper(F.regexp_extract(number, pattern, 1))).otherwise(number).alias("kind"),
        digits.try_cast("int").alias("number"),
        F.trim(F.regexp_extract(number, pattern, 3)).alias("suffix"),
    )


def numeric_suffix(number: Column) -> Column:
    """The digits at the end as a number, 0 where there are none."""
    return F.coalesce(F.regexp_extract(number, r"(\d+)\s*$", 1).try_cast("int"), F.lit(0))


def number_kind(number: Column) -> Column:
    return F.upper(F.regexp_extract(number, r"^([A-Za-z]+)", 1))


def surrogate_key(*parts: Column) -> Column:
    """Sixteen hex digits of the MD5 of the parts joined by a bar; null parts count as empty."""
    return F.substring(F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))), 1, 16)


def name_key(name: Column) -> Column:
    """Lower case, without periods, single blanks."""
    return F.trim(F.regexp_replace(F.lower(F.replace(name, F.lit("."), F.lit(""))), r"\s+", " "))


def seat_key(name: Column) -> Column:
    """name_key with hyphens as blanks."""
    return F.trim(F.regexp_replace(F.replace(F.replace(F.lower(name), F.lit("-"), F.lit(" ")), F.lit("."), F.lit("")), r"\s+", " "))


SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v")


def member_name_parts(name: Column) -> Column:
    """first (with middle), last and suffix of a name in natural order, as in "Mary A. Jones, Jr."."""
    suffix = F.regexp_extract(name, r"(?i),?\s+(jr\.?|sr\.?|ii|iii|iv|v)$", 1)
    core = F.trim(F.regexp_replace(F.regexp_replace(name, r"(?i),?\s+(jr\.?|sr\.?|ii|iii|iv|v)$", ""), r"\s+", " "))
    words = F.split(core, " ")
    return F.struct(F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), " ").alias("first"), F.element_at(words, -1).alias("last"), suffix.alias("suffix"))


def vote_name_parts(name: Column) -> Column:
    """last, first and suffix of a roll-call name, as in "Jones, Mary A., Jr."."""
    parts = F.split(name, ",", 3)
    return F.struct(F.trim(parts[0]).alias("last"), F.coalesce(F.trim(F.get(parts, F.lit(1))), F.lit("")).alias("first"), F.coalesce(F.trim(F.get(parts, F.lit(2))), F.lit("")).alias("suffix"))


def seat_name_parts(name: Column) -> Column:
    """initial and last of a seat label such as "M. Jones"."""
    pattern = r"^([A-Za-z])\.\s*(.+)$"
    last = F.regexp_extract(name, pattern, 2)
    return F.struct(F.regexp_extract(name, pattern, 1).alias("initial"), F.when(last != "", last).otherwise(name).alias("last"))


def last_name(name: Column) -> Column:
    """The last name for a roll-call line: before a comma, or else the last word; lower case, letters only."""
    before = F.when(F.contains(name, F.lit(",")), F.split(name, ",")[0]).otherwise(F.element_at(F.split(F.trim(name), r"\s+"), -1))
    return F.regexp_replace(F.lower(F.trim(before)), r"[^a-z\-' ]", "")


#: What follows "to" in an action without being a committee of substance (fixed values).
NOT_COMMITTEES = ("rules", "assignments", "assignments * reports", "rules * reports", "committee of the whole", "resolutions consent calendar", "executive", "executive appointments")


def committee_in_action(action: Column) -> Column:
    """The committee that an action assigns or refers to, without a tally behind it; null for procedural ones."""
    found = F.regexp_extract(action, r"(?:(?:Re-)?[Aa]ssigned\s+to|(?:Re-)?[Rr]eferred\s+to)\s*(.+?)(?:\s+Committee)?(?:\s*;.*|$)", 1)
    found = F.trim(F.regexp_replace(found, r"-+\s*$", ""))
    return F.when((found == "") | F.lower(found).isin(*NOT_COMMITTEES), None).otherwise(found)


def snippet(text: Column, query: str, around: int = 80) -> Column:
    """The text from around characters before the first match of query, whatever its case, to as many behind it, with
    dots where it is cut; without a match the start of the text."""
    at = F.locate(query.lower(), F.lower(text))
    start, end = F.greatest(at - around, F.lit(1)), F.least(at + len(query) + around, F.length(text) + 1)
    cut = F.concat(F.when(start > 1, "...").otherwise(""), F.substr(text, start, end - start), F.when(end <= F.length(text), "...").otherwise(""))
    head = F.concat(F.substring(text, 1, 2 * around), F.when(F.length(text) > 2 * around, "...").otherwise(""))
    return F.when(at == 0, head).otherwise(cut)


#: All white space of Unicode, as a class that Java and RE2 read alike; their \s are ASCII only, and differ.
WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def collapse(text: Column) -> Column:
    """Single blanks for runs of white space, none at the ends."""
    return F.trim(F.regexp_replace(text, WHITE + "+", " "))


def first_words(text: Column, n: int, least: int = 5) -> Column:
    """The first n words; null where there are least words or fewer."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.when(F.size(words) > least, F.array_join(F.slice(words, 1, n), " "))


def content_features(text: Column) -> Column:
    """Word count, its log, and flags for long and short texts."""
    n = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return F.struct(n.alias("word_count"), F.log1p(n).alias("log_words"), (F.length(text) > 10000).alias("is_long"), ((F.length(text) > 0) & (F.length(text) < 500)).alias("is_short"), F.regexp_count(text, F.lit(r"(?i)\bsection\b")).alias("sections"))


def clean_pdf_text(text: Column) -> Column:
    """Bill text from a PDF: plain punctuation, without page headers, line numbers and surplus blanks."""
    text = F.translate(text, "‘’“”–— ", "''\"\"-- ")
    text = F.regexp_replace(text, r"(?im)^\s*(?:page\s+\d+|-\s*\d+\s*-|[A-Z]{2,4}\d{1,5}\s+(?:enrolled|engrossed|introduced).*)\s*$", "")
    text = F.regexp_replace(text, r"(?m)^\s*\d{1,2}\s+(?=\S)", "")
    text = F.regexp_replace(text, r"[ \t]+", " ")
    return F.trim(F.regexp_replace(text, r"\n\s*\n+", "\n\n"))


def label_description(label: Column) -> Column:
    """The middle of a label whose parts are joined by " - ": without the first and the last part."""
    parts = F.split(label, " - ")
    return F.when(F.size(parts) > 2, F.array_join(F.slice(parts, 2, F.size(parts) - 2), " - ")).otherwise(F.element_at(parts, -1))


def url_number(url: Column) -> Column:
    """The bill number that a status address names in its parameters."""
    kind, number = F.regexp_extract(url, r"(?i)[?&]DocTypeID=([A-Za-z]+)", 1), F.regexp_extract(url, r"(?i)[?&]DocNum=(\d+)", 1)
    return F.when((kind != "") & (number != ""), F.concat(F.upper(kind), F.lpad(number, 4, "0"))).otherwise("")


def tab_url(url: Column, tab: str) -> Column:
    """A status address turned to another tab."""
    return F.regexp_replace(url, r"(?i)/BillStatus(?=[?/]|$)", f"/BillStatus/{tab}")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def safe_filename(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r'[\\/:*?"<>|#^\[\]]', ""))


def wikilink(target: Column, shown: Column | None = None) -> Column:
    return F.concat(F.lit("[["), target, F.lit("]]")) if shown is None else F.concat(F.lit("[["), target, F.lit("|"), shown, F.lit("]]"))


def progress_bar(share: Column, width: int = 10) -> Column:
    full = F.round(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * width).cast("int")
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(width) - full))


def district_of_geoid(geoid: Column) -> Column:
    """The district number of a census id, without the state's two digits and leading zeros."""
    return F.coalesce(F.substring(geoid, 3, 10).try_cast("int").cast("string"), F.lit(""))


def token_sort(text: Column, fold: bool = True) -> Column:
    """The words in order of code points, joined by blanks; fold takes case and periods away first."""
    words = F.split(name_key(text), " ") if fold else F.filter(F.split(text, WHITE + "+"), lambda w: w != "")
    return F.array_join(F.array_sort(words), " ")


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence: a bit of v is 0 where a position of a has been used."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = v = (1 << len(a)) - 1
    for c in b:
        u = v & at.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _common_many(a: list[str], b: list[str]) -> np.ndarray:
    """_common of many pairs at once, for texts of at most 63 code points on the left."""
    la, lb = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    x, y = (np.array(t, f"U{max(1, int(n.max()))}").view(np.uint32).reshape(len(t), -1) for t, n in ((a, la), (b, lb)))
    powers = np.uint64(1) << np.arange(x.shape[1], dtype=np.uint64)
    full = (np.uint64(1) << la.astype(np.uint64)) - np.uint64(1)
    v = full.copy()
    for j in range(y.shape[1]):
        u = v & ((x == y[:, j, None]) @ powers)
        v = np.where(j < lb, ((v + u) | (v - u)) & full, v)
    return la - np.bitwise_count(v).astype(np.int64)


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    """indel_ratio of every text of a (rows) with every one of b (columns), a character of all of b at a time."""
    la, lb = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    common = np.zeros((len(a), len(b)), np.int64)
    short = np.flatnonzero(la <= 63)
    if len(short) and len(b):
        n, width = la[short], max(1, int(lb.max()))
        x = np.array([a[i] for i in short], f"U{max(1, int(n.max()))}").view(np.uint32).reshape(len(short), -1)
        y = np.array(b, f"U{width}").view(np.uint32).reshape(len(b), -1)
        letters, codes = np.unique(y, return_inverse=True)
        codes = np.where(np.arange(width) < lb[:, None], codes.reshape(y.shape), len(letters)).T.copy()
        masks = np.zeros((len(short), len(letters) + 1), np.uint64)  # the last letter is behind a text's end and nowhere in a
        for k in range(x.shape[1]):
            at = np.minimum(np.searchsorted(letters, x[:, k]), len(letters) - 1)
            found = np.flatnonzero((letters[at] == x[:, k]) & (k < n))
            masks[found, at[found]] |= np.uint64(1 << k)
        full = ((np.uint64(1) << n.astype(np.uint64)) - np.uint64(1))[:, None]
        v = np.repeat(full, len(b), 1)
        for c in codes:
            u = v & masks[:, c]
            v = ((v + u) | (v - u)) & full
        common[short] = n[:, None] - np.bitwise_count(v)
    for i in np.flatnonzero(la > 63):
        common[i] = [_common(a[i], t) for t in b]
    both = (la[:, None] + lb).astype(np.float64)
    return (1 - (both - 2 * common) / np.maximum(both, 1)) * 100


@F.pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """100 * (1 - insertions and deletions from a to b / length of both); 100 for two empty texts, null for null."""
    known = (a.notna() & b.notna()).to_numpy()
    x, y = a[known].tolist(), b[known].tolist()
    common = np.zeros(len(x), np.int64)
    short = [i for i, (s, t) in enumerate(zip(x, y)) if len(s) <= 63 and len(t) <= 255]
    if short:
        common[short] = _common_many([x[i] for i in short], [y[i] for i in short])
    for i in sorted(set(range(len(x))).difference(short)):
        common[i] = _common(x[i], y[i])
    both = np.fromiter((len(s) + len(t) for s, t in zip(x, y)), np.float64, len(x))
    out = np.full(len(a), np.nan)
    out[known] = (1 - (both - 2 * common) / np.maximum(both, 1)) * 100
    return pd.Series(out)


def similarity(a: Column, b: Column, fold: bool = True) -> Column:
    """The ratio of insertions and deletions of the words in order; fold takes case and periods away first."""
    return indel_ratio(token_sort(a, fold), token_sort(b, fold))
