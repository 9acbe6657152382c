"""Novels to chapters and paragraphs.

Headings need the offsets of multi-line matches, which no built-in function gives, so the splitter runs on Arrow batches of
whole texts; all else is column expressions.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vocabulary import TOC_GAP

# The catalogue's licence markers and the three conventions of chapter headings.
START_MARK = r"(?is)\*\*\*\s*START OF (THE|THIS) PROJECT GUTENBERG EBOOK.*?\*\*\*"
END_MARK = r"(?is)\*\*\*\s*END OF (THE|THIS) PROJECT GUTENBERG EBOOK.*?\*\*\*"
KEYWORD_HEADING = r"(?im)^[ \t]*(chapter|part|book)\s+([ivxlcdm]+|\d+)\b.*$"
NUMERAL_HEADING = r"(?m)^[ \t]*([IVXLCDM]+|\d+)\.\s+[A-Z][A-Z0-9 ,.'-]*\r?$"
TITLE_HEADING = r"(?m)^[ \t]*([A-Z][A-Z'’.,-]*(?: [A-Z'’.,-]+)+)[ \t]*\r?$"
TIERS = ((re.compile(KEYWORD_HEADING), 2), (re.compile(NUMERAL_HEADING), 1), (re.compile(TITLE_HEADING), 1))
#: White space at either end, as in Unicode.
_ENDS = r"(?U)^\s+|\s+$"


def strip_boilerplate(text: Column) -> Column:
    """What lies behind the first start mark and before the first end mark; either may be missing."""
    begin = F.regexp_instr(text, F.lit(START_MARK))
    head = F.length(F.regexp_extract(text, START_MARK, 0))
    end = F.regexp_instr(text, F.lit(END_MARK))
    first = F.when(begin > 0, begin + head).otherwise(1)
    past = F.when(end > 0, end).otherwise(F.length(text) + 1)
    return F.regexp_replace(F.substring(text, first, F.greatest(past - first, F.lit(0))), _ENDS, "")


def split_paragraphs(text: Column) -> Column:
    """Array of paragraphs: parted by blank lines, white space inside made single spaces, empty ones left out."""
    parts = F.transform(F.split(text, r"\n(?U:\s*)\n"), lambda p: F.regexp_replace(F.regexp_replace(p, _ENDS, ""), r"(?U)\s+", " "))
    return F.filter(parts, lambda p: p != "")


def chapter_text(paragraphs: Column) -> Column:
    return F.array_join(paragraphs, "\n\n")


def headings(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, title, number) by the first convention with two hits; else what the first found."""
    tiers = [[(m.start(), m.end(), m[0].strip(), m[g].strip().lower()) for m in p.finditer(text)] for p, g in TIERS]
    return next((t for t in tiers if len(t) > 1), tiers[0])


def repeats(items: list[str]) -> list[int]:
    """For each place how many items from there on are those from the start on (a Z-array; linear)."""
    z, left, right = [len(items)] + [0] * (len(items) - 1), 0, 0
    for i in range(1, len(items)):
        n = min(z[i - left], right - i) if i < right else 0
        while i + n < len(items) and items[n] == items[i + n]:
            n += 1
        z[i] = n
        if i + n > right:
            left, right = i, i + n
    return z


def contents_length(found: list[tuple[int, int, str, str]], gap: int = TOC_GAP) -> int:
    """How many leading headings are a table of contents: the most that come again in order right after, close together."""
    if not found:
        return 0
    close = next((i for i, (a, b) in enumerate(zip(found, found[1:])) if b[0] - a[1] > gap), len(found)) + 1
    again = repeats([h[3] for h in found])
    return max((k for k in range(1, min(close, len(found) // 2) + 1) if again[k] >= k), default=0)


def chapters_of(text: str) -> list[tuple[str | None, str]]:
    """(title, body) of each chapter; a text without headings is one without a title."""
    found = headings(text)
    found = found[contents_length(found) :]
    if not found:
        return [(None, text)]
    stops = [h[0] for h in found[1:]] + [len(text)]
    return [(h[2], text[h[1] : stop]) for h, stop in zip(found, stops)]


def find_headings(novels: DataFrame) -> DataFrame:
    """(book_id, position, start, title, number) of all headings of the clean text, a table of contents included."""
    return _each(novels, lambda t: [(i, h[0], h[2], h[3]) for i, h in enumerate(headings(t))], "position int, start int, title string, number string")


def drop_toc(novels: DataFrame) -> DataFrame:
    """(book_id, headings, dropped): how many headings there are, and how many of them are a table of contents."""
    return _each(novels, lambda t: [(len(f := headings(t)), contents_length(f))], "headings int, dropped int")


def split_chapters(novels: DataFrame) -> DataFrame:
    """(book_id, chapter, title, paragraphs): chapters with text, numbered from 1 in order."""
    raw = _each(novels, lambda t: [tuple(zip(*chapters_of(t)))], "title array<string>, body array<string>")
    # A novel's chapters are numbered inside its row, so nothing is shuffled.
    parts = F.transform(F.arrays_zip("title", "body"), lambda c: F.struct(c["title"].alias("title"), split_paragraphs(c["body"]).alias("paragraphs")))
    rows = raw.select("book_id", F.posexplode(F.filter(parts, lambda c: F.size(c["paragraphs"]) > 0)).alias("n", "c"))
    return rows.select("book_id", (F.col("n") + 1).alias("chapter"), "c.title", "c.paragraphs")


_KINDS = {"int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}


def _each(novels: DataFrame, f, schema: str) -> DataFrame:
    """Rows of ``f`` for the text of each novel (book_id, text)."""
    names = [x.split()[0] for x in schema.split(", ")]
    kind = novels.schema["book_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            ids, rows = [], []
            for i, t in zip(b.column("book_id"), b.column("text").to_pylist()):
                found = f(t or "")
                ids += [i.as_py()] * len(found)
                rows += found
            cols = list(zip(*rows)) if rows else [()] * len(names)
            kinds = [_KINDS[x.split()[1]] for x in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field("book_id").type), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["book_id", *names])

    return novels.select("book_id", "text").mapInArrow(run, f"book_id {kind}, {schema}")


def chapter_sample(chapters: DataFrame, percent: float) -> DataFrame:
    """The first chapters of each book, so many percent (half-way cases to the even number), one at least."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be above 0 and at most 100")
    total = chapters.groupBy("book_id").agg(F.count("*").alias("_n"))
    keep = F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(float(percent)) / 100).cast("int"))
    return chapters.join(total, "book_id").filter(F.col("chapter") <= keep).drop("_n")


def setting_sample(chapters: DataFrame, first: int = 2) -> DataFrame:
    """(book_id, opening): the text of the first chapters."""
    own = chapters.filter(F.col("chapter") <= first).groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("chapter", chapter_text(F.col("paragraphs")).alias("t")))).alias("c"))
    return own.select("book_id", F.array_join(F.transform("c", lambda x: x["t"]), "\n\n").alias("opening"))
