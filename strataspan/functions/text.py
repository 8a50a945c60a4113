"""Text functions: tokens, dates in names, HTML, headings, chunks, embedded JSON."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Separators from coarse to fine, size of a chunk and of what it repeats.
SEPARATORS = ("\n\n", "\n", "。", "！", "？", "；", "，", " ")
CHUNK, OVERLAP = 300, 60


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores, then each CJK character."""
    return F.concat(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]+)"), F.lit(1)), F.regexp_extract_all(text, F.lit("([一-鿿])"), F.lit(1)))


def token_count(text: Column) -> Column:
    """How many ``tokens`` a text has; null texts have none."""
    return F.coalesce(F.regexp_count(F.lower(text), F.lit("[a-z0-9_]+")) + F.regexp_count(text, F.lit("[一-鿿]")), F.lit(0))


def _replacing(old: str, new: str):
    return lambda p: F.replace(p, F.lit(old), F.lit(new))


def html_text(html: Column) -> Column:
    """Text of a page: script and style elements, comments and tags go; pieces are trimmed
    and joined by line breaks."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", "")
    bare = F.regexp_replace(bare, r"(?s)<!--.*?-->|<![^>]*>", "\u0001")
    parts = F.split(F.regexp_replace(bare, r"(?s)<[^>]*>", "\u0001"), "\u0001")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        parts = F.transform(parts, _replacing(name, char))
    trimmed = F.transform(parts, lambda p: F.regexp_replace(p, r"^[\s ]+|[\s ]+$", ""))
    return F.array_join(F.filter(trimmed, lambda p: p != ""), "\n")


def first_heading(text: Column, fallback: Column) -> Column:
    """The first heading of one to three #, else the fallback."""
    found = F.trim(F.regexp_extract(text, r"(?md)^#{1,3}\s+(.+)$", 1))
    return F.when(found != "", found).otherwise(fallback)


def name_date(name: Column) -> Column:
    """``YYYY-MM-DD`` of eight digits in a name, else the name."""
    day = F.regexp_extract(name, r"(\d{4})(\d{2})(\d{2})", 0)
    return F.when(day != "", F.concat_ws("-", F.substring(day, 1, 4), F.substring(day, 5, 2), F.substring(day, 7, 2))).otherwise(name)


def clean_sql(text: Column) -> Column:
    """A statement out of a fence, without closing semicolons."""
    fenced = F.regexp_extract(text, r"(?s)```(?:sql)?\s*(.*?)```", 1)
    return F.regexp_replace(F.trim(F.when(fenced != "", fenced).otherwise(text)), r"[;\s]+$", "")


def embedded_json(text: Column) -> Column:
    """The JSON text inside a fence, else from the first brace to the last; null if none."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.nullif(F.when(fenced != "", fenced).otherwise(braces), F.lit(""))


def years(text: Column) -> Column:
    """Distinct years 19xx and 20xx in a text, in order."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?<!\d)((?:19|20)\d{2})(?!\d)"), F.lit(1)), lambda y: y.cast("int"))))


Unit = tuple[int, str]  # the separator before it (its place in SEPARATORS, -1 at the start), and the unit


def finest(text: str, size: int) -> list[Unit]:
    """Units of at most ``size``: separator by separator, only what is still too long is cut;
    what no separator cuts is cut at ``size``. Empty units go, and what follows one stands
    behind the coarser of both separators."""
    units: list[Unit] = [(-1, text)]
    for level, sep in enumerate(SEPARATORS):
        cut: list[Unit] = []
        for before, unit in units:
            parts = unit.split(sep) if len(unit) > size else [unit]
            cut += zip([before] + [level] * (len(parts) - 1), parts, strict=True)
        units = cut
    out: list[Unit] = []
    waiting = len(SEPARATORS)
    for before, unit in units:
        waiting = min(waiting, before)
        for at in range(0, len(unit), size):
            out.append((len(SEPARATORS) if at else waiting, unit[at : at + size]))
        if unit:
            waiting = len(SEPARATORS)
    return out


def pieces(text: str, size: int) -> list[str]:
    """The units of a text, joined again: from the finest separator to the coarsest, from left
    to right, neighbours around a separator become one while they fit."""
    units = finest(text, size)
    for level in reversed(range(len(SEPARATORS))):
        sep, fewer = SEPARATORS[level], units[:1]
        for before, unit in units[1:]:
            first, last = fewer[-1]
            if before == level and len(last) + len(sep) + len(unit) <= size:
                fewer[-1] = (first, last + sep + unit)
            else:
                fewer.append((before, unit))
        units = fewer
    return [unit for _, unit in units]


def with_tails(parts: list[str], overlap: int) -> Iterator[tuple[int, str]]:
    """(index, part), each behind the last ``overlap`` characters of what came out before it."""
    tail = ""
    for i, part in enumerate(parts):
        whole = tail + part
        tail = whole[max(0, len(whole) - overlap) :]
        if not whole.isspace():
            yield i, whole


def chunk_texts(text: str | None, size: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, str]]:
    """(index, chunk) of a text; null and blank texts have none."""
    return list(with_tails(pieces((text or "").strip(), size), overlap))


def chunks(docs: DataFrame, key: str, text: str = "text", size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """key, index, chunk for each chunk of each text."""

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            cut = frame[text].map(lambda t: chunk_texts(t, size, overlap))
            rows = frame.assign(_cut=cut)[[key, "_cut"]].explode("_cut").dropna(subset="_cut")
            yield pd.DataFrame({key: rows[key], "index": rows["_cut"].str[0], "chunk": rows["_cut"].str[1]})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInPandas(split, f"`{key}` {kind}, index long, chunk string")
