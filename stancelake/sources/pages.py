"""Clean-up of scraped pages and descriptions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def absolute(url: Column, base: str) -> Column:
    """The URL, behind the base unless it starts with http."""
    return F.when(F.startswith(url, F.lit("http")), url).otherwise(F.concat(F.lit(base), url))


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://([^/?#]+)", 1)


def html_text(html: Column) -> Column:
    """Text without scripts, styles and tags, the five basic references decoded, white space as one space."""
    plain = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    plain = F.regexp_replace(plain, r"<[^>]*>", " ")
    for reference, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(reference), F.lit(char))
    return F.btrim(F.regexp_replace(plain, r"[ \t\n\x0B\f\r]+", " "))


def title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1)


def attribute_json(html: Column, attribute: str, path: str) -> Column:
    """A JSON path of the first occurrence of an attribute that holds escaped JSON; null for none."""
    raw = F.regexp_extract(html, rf'{attribute}="([^"]*)"', 1)
    return F.get_json_object(F.replace(F.replace(raw, F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&")), path)


def detail(html: Column, attribute: str = "data-react-props") -> Column:
    """struct<body: string, pdf: string> of a detail page whose first element with the attribute holds JSON in it.

    body: the text of the document's content, without tags; empty where there is none, the JSON is malformed or null.
    pdf: the document's path if that is of a PDF, else null. The attribute may stand in either kind of quotes.
    """
    quoted = F.regexp_extract(html, rf"""(?s)\s{attribute}\s*=\s*(?:"([^"]*)"|'([^']*)')""", 1)
    raw = F.when(quoted != "", quoted).otherwise(F.regexp_extract(html, rf"""(?s)\s{attribute}\s*=\s*(?:"([^"]*)"|'([^']*)')""", 2))
    for reference, char in (("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        raw = F.replace(raw, F.lit(reference), F.lit(char))
    kept = F.from_json(raw, "document struct<content: string, path: string>", {"maxStringLen": str(2**31 - 1)})["document"]
    path = kept["path"]
    return F.struct(F.coalesce(html_text(kept["content"]), F.lit("")).alias("body"), F.when(F.endswith(F.lower(path), F.lit(".pdf")), path).alias("pdf"))


def is_legible(text: Column, least: float = 0.65) -> Column:
    """Not empty, no glyph codes, and letters and white space make up over `least` of it."""
    kept = F.char_length(F.regexp_replace(text, r"[^\p{L}\s]", ""))
    return F.coalesce((F.char_length(text) > 0) & ~F.contains(text, F.lit("(cid:")) & (kept / F.greatest(F.char_length(text), F.lit(1)) > least), F.lit(False))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\S+")), F.lit(0))


def full_text(from_html: Column, from_pdf: Column) -> Column:
    """The PDF's text if it is legible and has more words, else the page's."""
    return F.when(is_legible(from_pdf) & (n_words(from_pdf) > n_words(from_html)), from_pdf).otherwise(from_html)


def long_enough(text: Column, least: int = 50) -> Column:
    return n_words(text) >= least


def without_speaker(heading: Column, speaker: Column) -> Column:
    """The heading without what stands before its first colon, if that has the speaker's last name."""
    head = F.substring_index(heading, ":", 1)
    last = F.lower(F.substring_index(F.btrim(speaker), " ", -1))
    rest = F.btrim(F.substring(heading, F.char_length(head) + 2, F.char_length(heading)))
    return F.when(F.contains(heading, F.lit(":")) & F.contains(F.lower(head), last) & (rest != ""), rest).otherwise(F.btrim(heading))


def without_name(heading: Column, name: Column) -> Column:
    """The heading without a leading `name:`."""
    begin = F.concat(F.lower(name), F.lit(":"))
    return F.when(F.startswith(F.lower(heading), begin), F.btrim(F.substring(heading, F.char_length(name) + 2, F.char_length(heading)))).otherwise(heading)


def institution(description: Column, needles: Sequence[tuple[str, str]]) -> Column:
    """The bank of the first listed needle that the lower-cased description contains; null if untracked."""
    low, out = F.lower(description), F.lit(None).cast("string")
    for needle, bank in reversed(list(needles)):
        out = F.when(F.contains(low, F.lit(needle)), bank).otherwise(out)
    return out


def affiliation(description: Column) -> Column:
    """The first clause `, Role of (the) Institution ,`; the whole description without one."""
    clause = F.regexp_extract(description, r",\s*([A-Z][^,]*?\bof\b[^,]*?),", 1)
    return F.when(clause == "", description).otherwise(clause)


def role(description: Column, default: str = "Central banker") -> Column:
    """What stands before `of` in the affiliation clause."""
    found = F.btrim(F.regexp_extract(description, r",\s*([A-Z][^,]*?)\s+of\s+", 1))
    return F.when(found == "", default).otherwise(found)
