"""Native column expressions: document format, ids, guards, line features, local blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.normalise import SPACE_CLASS

# The document format.
SENTINEL = "Extracted text follows. Pages are separated by a form feed."
HEADER_KEYS = ["Title", "Authors", "Date", "Venue", "DOI", "Paper ID", "Source PDF", "Source SHA256", "Pages", "Extractor"]

# Guards.
FEWEST_CHARS, MOST_CHARS = 12, 5000
CHARS_PER_PAGE = 200
BLANK_PAGES_SHOWN = 12
BLOCK_CHARS, BLOCK_SIGNALS = 700, 3

# Line features of a reference list.
LINE_YEAR = r"\b(1[89][0-9]{2}|20[0-4][0-9])\b"
LINE_TOKENS = [r"pp\.\s*[0-9]", r"vol\.", r"no\.\s*[0-9]", r"et al\.", "doi", r"10\.[0-9]{4,}/", "In:", "In Proc", "Proceedings", "Journal", "arXiv", "LNCS", "https?://", "IEEE", "ACM", "Springer", r"Eds?\.", "Press", "Conference", "Workshop", "Symposium", r"Trans\.", r"pages\s+[0-9]"]
LINE_ENTRY = r"(?:^|\s\s)\s*(\[[0-9]{1,3}\]|[0-9]{1,3}\.\s+[A-Z])"
LINE_INITIALS = r"\b[A-Z]\.[ ,]"
LINE_FEATURES = [LINE_YEAR, "|".join(LINE_TOKENS), LINE_ENTRY, LINE_INITIALS]
#: For each token what its matches hold, and whether that alone is a match.
LINE_TOKEN_PARTS = [
    (["pp."], False), (["vol."], True), (["no."], False), (["et al."], True), (["doi"], True), (["10."], False), (["In:"], True), (["In Proc"], True), (["Proceedings"], True), (["Journal"], True), (["arXiv"], True), (["LNCS"], True),
    (["http://", "https://"], True), (["IEEE"], True), (["ACM"], True), (["Springer"], True), (["Ed.", "Eds."], True), (["Press"], True), (["Conference"], True), (["Workshop"], True), (["Symposium"], True), (["Trans."], True), (["pages"], False),
]
#: What each match of the other three holds: runs of single classes, which cost little where there is none.
LINE_HINTS = {LINE_YEAR: r"[12][089][0-9][0-9]", LINE_ENTRY: r"[0-9][.\]]", LINE_INITIALS: r"[A-Z]\.[ ,]"}

# What a block of a reference list holds.
BLOCK_YEAR = r"\b(?:1[5-9]|20)[0-9]{2}[a-z]?\b"
BLOCK_TOKENS = (
    r"\bpp\.|\bvol\.|\bno\.|\bnos\.|\beds?\.|\bIn:|\bProceedings\b|\bJournal\b|\bConference\b|\bPress\b|\barXiv\b|\bISBN\b|\bRetrieved\b|\bAvailable\s+at\b|\bAccessed\b"
    r"|(?i:\bdoi\b)|(?i:https?://)|\b[0-9]{1,4}\s*\(\s*[0-9]{1,3}\s*\)\s*[,:]|\b[0-9]{1,4}\s*:\s*[0-9]{1,5}\s*[-\u2013]\s*[0-9]"
)
BLOCK_INITIAL = r"\b[A-Z]\.(?=[\s,;)\]]|\z)"
BLOCK_ENTRY = r"(?md)^[ \t]*(?:\[\s*[0-9]{1,3}\s*\]|\(\s*[0-9]{1,3}\s*\)|[0-9]{1,3}\.)[ \t]"


# Documents: header, form feed, page, form feed, page..


def sections(raw: Column) -> Column:
    return F.split(raw, "\f", -1)


def has_header(raw: Column) -> Column:
    return F.contains(F.element_at(sections(raw), 1), F.lit(SENTINEL))


def header_end(raw: Column) -> Column:
    """The offset of the first character after the header, 0 without one."""
    head = F.element_at(sections(raw), 1)
    return F.when(F.contains(head, F.lit(SENTINEL)), F.length(head) + 1).otherwise(0).cast("int")


def header_text(raw: Column) -> Column:
    return F.when(has_header(raw), F.element_at(sections(raw), 1))


def pages(raw: Column) -> Column:
    """The pages of a document; without a header, one empty last page is dropped."""
    parts = sections(raw)
    n = F.size(parts)
    # Either way one section goes: the header in front, or the empty tail.
    return F.when(has_header(raw), F.slice(parts, F.lit(2), n)).when((n > 1) & (F.element_at(parts, -1) == ""), F.slice(parts, F.lit(1), n - 1)).otherwise(parts)


def body(raw: Column) -> Column:
    """The document without its header."""
    return F.when(has_header(raw), F.substring(raw, header_end(raw) + 1, F.length(raw))).otherwise(raw)


def header_fields(raw: Column) -> Column:
    """The known header fields as a map; an empty map without a header."""
    lines = F.filter(F.split(F.coalesce(header_text(raw), F.lit("")), "\n", -1), lambda x: F.array_contains(F.array(*map(F.lit, HEADER_KEYS)), F.split_part(x, F.lit(":"), F.lit(1))) & F.contains(x, F.lit(": ")))
    entry = F.transform(lines, lambda x: F.struct(F.split_part(x, F.lit(":"), F.lit(1)).alias("key"), F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("value")))
    # The first line of a key counts.
    keys = F.array_distinct(F.transform(entry, lambda e: e["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(entry, lambda e: e["key"] == k), 1)["value"]))


def is_blank(text: Column) -> Column:
    return text.rlike(r"^" + SPACE_CLASS + r"*\z")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE_CLASS}+|{SPACE_CLASS}+\z", "")


def clean_value(value: Column) -> Column:
    """A header value: white space runs become one space; null if nothing is left."""
    return F.nullif(F.regexp_replace(strip(value), SPACE_CLASS + "+", " "), F.lit(""))


def blank_pages(page_array: Column) -> Column:
    """1-based numbers of pages without text."""
    numbered = F.transform(page_array, lambda p, i: F.struct((i + 1).alias("n"), p.alias("p")))
    return F.transform(F.filter(numbered, lambda x: is_blank(x["p"])), lambda x: x["n"].cast("int"))


def page_list(numbers: Column, shown: int = BLANK_PAGES_SHOWN) -> Column:
    more = F.size(numbers) - shown
    text = F.array_join(F.transform(F.slice(numbers, 1, shown), lambda n: n.cast("string")), ", ")
    return F.when(more > 0, F.concat(text, F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise(text)


def measure(page_array: Column) -> Column:
    """struct<chars, n_pages, per_page>; per_page of no pages is 0."""
    chars = F.aggregate(page_array, F.lit(0).cast("long"), lambda s, p: s + F.length(p))
    n = F.size(page_array).cast("long")
    return F.struct(chars.alias("chars"), n.alias("n_pages"), F.when(n > 0, F.floor(chars / n)).otherwise(0).cast("long").alias("per_page"))


def has_text_layer(page_array: Column, floor: int = CHARS_PER_PAGE) -> Column:
    return measure(page_array)["per_page"] >= floor


# Ids.


def paper_id(filename: Column) -> Column:
    """An id from a file name: its stem, other characters than letters, digits and ._+- as underscores."""
    name = F.element_at(F.split(filename, "/"), -1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*\z", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(stem, "[^A-Za-z0-9._+-]+", "_"), r"^_+|_+\z", ""), F.lit("")), F.lit("paper"))


def is_safe_id(value: Column) -> Column:
    return value.rlike(r"^[A-Za-z0-9._-]{1,128}\z")


def is_sha256(value: Column) -> Column:
    return value.rlike(r"^[0-9a-f]{64}\z")


# Guards.


def guard(raw: Column, norm: Column) -> Column:
    """``TOO_LONG``, ``TOO_SHORT`` or null; length is tested on the raw text first."""
    return F.when(F.length(raw) > MOST_CHARS, "TOO_LONG").when(F.length(F.trim(norm)) < FEWEST_CHARS, "TOO_SHORT")


def echoed(raw: Column) -> Column:
    return F.substring(raw, 1, MOST_CHARS)


def threshold(value: Column, default: float = 0.65, least: float = 0.55, most: float = 0.72) -> Column:
    """struct<t, noted>: the threshold in use, and whether it was replaced or is out of the advised range."""
    number = value.try_cast("double")
    good = number.between(0, 1) & ~F.isnan(number)
    good = F.coalesce(good, F.lit(False))
    t = F.when(good, number).otherwise(default)
    return F.struct(t.alias("t"), (~good | ~t.between(least, most)).alias("noted"))


def clamp_hits(value: Column, default: int = 10, most: int = 50) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(most), F.coalesce(value, F.lit(default))))


# Text measures.


def count_of(text: Column, part: Column) -> Column:
    """Occurrences of ``part`` that do not overlap."""
    return ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("long")


def lower_bound(sorted_map: Column, value: Column) -> Column:
    """The first place of a sorted array whose element is not below ``value``."""
    return F.size(F.filter(sorted_map, lambda x: x < value))


def page_of(page_array: Column, span: Column) -> Column:
    """The first page, from 1, that holds the characters; null where none does."""
    return F.nullif(F.array_position(F.transform(page_array, lambda p: F.contains(p, span)), F.lit(True)), F.lit(0)).cast("int")


def feature_count(line: Column) -> Column:
    """How many of the four kinds of reference features a line shows.

    A pattern with word bounds or many branches is tried at each character, so only lines that hold what its
    matches hold are searched for it."""
    token = F.lit(False)
    for pattern, (parts, whole) in zip(LINE_TOKENS, LINE_TOKEN_PARTS, strict=True):
        for part in parts:
            there = F.contains(line, F.lit(part))
            token = token | (there if whole else there & line.rlike("(?U)" + pattern))
    out = token.cast("int")
    for pattern, hint in LINE_HINTS.items():
        out = out + (line.rlike(hint) & line.rlike("(?U)" + pattern)).cast("int")
    return out


def is_table_row(line: Column) -> Column:
    """Two rules or more, three short cells or more, or no fewer digits than letters."""
    text = strip(line)
    cells = F.filter(F.split(text, r"(?U)\s{2,}|\t|\|"), lambda c: c != "")
    digits = F.length(F.regexp_replace(text, r"(?U)[^\d]", ""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return (count_of(text, F.lit("|")) >= 2) | ((F.size(cells) >= 3) & F.forall(cells, lambda c: F.length(c) <= 24)) | ((digits > 0) & (digits >= letters))


def local_block(raw: Column, offset: Column) -> Column:
    """The text around an offset up to blank lines, ``BLOCK_CHARS`` to each side at most."""
    start = F.greatest(F.lit(0), offset - BLOCK_CHARS)
    before = F.substring(raw, start + 1, offset - start)
    after = F.substring(raw, offset + 1, F.lit(BLOCK_CHARS))
    head = F.element_at(F.split(before, r"\n[ \t]*\n", -1), -1)
    tail = F.element_at(F.split(after, r"\n[ \t]*\n", -1), 1)
    return F.concat(head, tail)


def block_signals(block: Column) -> Column:
    """The names of the reference-list signals a block shows."""
    found = [
        ("year", block.rlike("(?U)" + BLOCK_YEAR)),
        ("bibliographic_token", block.rlike("(?U)" + BLOCK_TOKENS)),
        ("initials", F.regexp_count(block, F.lit("(?U)" + BLOCK_INITIAL)) >= 2),
        ("entry_marker", block.rlike(BLOCK_ENTRY)),
    ]
    return F.array_compact(F.array(*[F.when(test, name) for name, test in found]))


def block_label(block: Column) -> Column:
    return F.when(block.isNull(), "LOCAL_BLOCK_NOT_ASSESSED").when(F.size(block_signals(block)) >= BLOCK_SIGNALS, "REFERENCE_LIKE_BLOCK_WARNING").otherwise("NO_REFERENCE_LIKE_BLOCK")
