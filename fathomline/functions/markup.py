"""Column expressions over filing markup. All of them are row-local: a filing
never leaves its row, so no step here shuffles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .text import find_all, replace_all, trim_ws

CUT = "\u0001"


def main_document(raw: Column) -> Column:
    """The 10-K body of an SGML wrapper; to the end when it is never closed;
    everything when there is none."""
    start = r"<DOCUMENT>\s*\n<TYPE>10-K\b"
    closed = F.regexp_extract(raw, rf"(?is){start}.*?</DOCUMENT>", 0)
    open_end = F.regexp_extract(raw, rf"(?is){start}.*", 0)
    return F.when(closed != "", closed).when(open_end != "", open_end).otherwise(raw)


def without_invisible(html: Column) -> Column:
    for tag in ("script", "style", "head"):
        html = F.regexp_replace(html, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", CUT)
    return F.regexp_replace(html, r"(?s)<!--.*?-->", CUT)


TABLE = r"(?is)<table\b.*?</table\s*>"


def leaf(table: Column) -> Column:
    """Innermost table of a match that opens several."""
    return F.regexp_extract(table, r"(?is).*(<table\b.*)$", 1)


def table_html(html: Column) -> Column:
    return F.transform(find_all(html, TABLE), lambda t: leaf(t))


def numeric_entities(text: Column) -> Column:
    """Decimal and hexadecimal character references by code point; those that name no
    character stay."""
    p = r"&#([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"

    def sign(ref: Column) -> Column:
        code = F.when(F.lower(F.substring(ref, 1, 1)) == "x", F.conv(F.substring(ref, 2, 6), 16, 10)).otherwise(ref).cast("int")
        real = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(real, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.concat(F.lit("&#"), ref, F.lit(";")))

    decoded = interleave(F.split(text, p, -1), F.transform(find_all(text, p, 1), sign))
    return F.when(F.contains(text, F.lit("&#")), decoded).otherwise(text)


def entities(text: Column) -> Column:
    return replace_all(numeric_entities(replace_all(text, fixed.HTML_ENTITIES)), fixed.CLEAN_ENTITIES[:6])


def plain(fragment: Column) -> Column:
    """Text of a fragment: tags out, entities decoded, white space collapsed."""
    return trim_ws(F.regexp_replace(entities(F.regexp_replace(fragment, r"<[^>]+>", " ")), r"(?U)\s+", " "))


_PLACED = "array<struct<text:string,col:int,left:int>>"


def _aged(x: Column) -> Column:
    return F.struct(x["text"].alias("text"), x["col"].alias("col"), (x["left"] - 1).alias("left"))


def occupancy_grid(rows: Column) -> Column:
    """Texts of all cells by row and column. ``rows``: arrays of (text, wide, tall).

    A fold over rows carries the cells that reach into later ones, each with its column
    and the rows it has left. In a row, carried cells come before a cell that would take
    their column; a wide cell is never torn, so one that it overlaps comes right behind
    it. Cells that reach beyond the last row make rows of their own."""
    nothing = F.array().cast(_PLACED)

    def place(acc: Column, c: Column) -> Column:
        out, rest = acc["out"], acc["rest"]
        later = F.filter(F.transform(rest, lambda x, j: F.when(x["col"] > F.size(out) + j, j)), lambda j: j.isNotNull())
        due = F.coalesce(F.get(later, 0), F.size(rest))
        first = F.size(out) + due
        own = F.transform(F.sequence(F.lit(0), c["wide"] - 1), lambda k: F.struct(c["text"].alias("text"), (first + k).alias("col"), (c["tall"] - 1).alias("left")))
        return F.struct(F.concat(out, F.transform(F.slice(rest, 1, due), _aged), own).alias("out"), F.slice(rest, due + 1, F.size(rest)).alias("rest"))

    def row(acc: Column, cells: Column) -> Column:
        out = F.aggregate(cells, F.struct(nothing.alias("out"), acc["open"].alias("rest")), place, lambda x: F.concat(x["out"], F.transform(x["rest"], _aged)))
        texts = F.transform(out, lambda x: x["text"])
        return F.struct(F.concat(acc["grid"], F.array(texts)).alias("grid"), F.filter(out, lambda x: x["left"] > 0).alias("open"))

    def below(acc: Column) -> Column:
        most = F.array_max(F.transform(acc["open"], lambda x: x["left"]))
        more = F.transform(F.sequence(F.lit(1), most), lambda k: F.transform(F.filter(acc["open"], lambda x: x["left"] >= k), lambda x: x["text"]))
        return F.concat(acc["grid"], F.when(F.size(acc["open"]) > 0, more).otherwise(F.array().cast("array<array<string>>")))

    return F.aggregate(rows, F.struct(F.array().cast("array<array<string>>").alias("grid"), nothing.alias("open")), row, below)


def table_cells(table: Column) -> Column:
    """Rows of cell texts; a cell over several columns or rows stands in each of them."""
    rows = find_all(table, r"(?is)<tr\b[^>]*>(.*?)</tr\s*>", 1)

    def span(cell: Column, name: str) -> Column:
        n = F.regexp_extract(cell, rf"(?is)^<t[dh]\b[^>]*\b{name}\s*=\s*[\"']?\s*(\d{{1,4}})", 1).try_cast("int")
        return F.greatest(F.coalesce(n, F.lit(1)), F.lit(1)).alias({"colspan": "wide", "rowspan": "tall"}[name])

    def cell(c: Column) -> Column:
        return F.struct(plain(F.regexp_extract(c, r"(?is)^<t[dh]\b[^>]*>(.*?)</t[dh]\s*>$", 1)).alias("text"), span(c, "colspan"), span(c, "rowspan"))

    cells = F.transform(rows, lambda r: F.transform(find_all(r, r"(?is)<t[dh]\b[^>]*>.*?</t[dh]\s*>"), cell))
    flat = F.transform(cells, lambda r: F.flatten(F.transform(r, lambda c: F.array_repeat(c["text"], c["wide"]))))
    tall = F.exists(cells, lambda r: F.exists(r, lambda c: c["tall"] > 1))
    return F.when(tall, occupancy_grid(cells)).otherwise(flat)


def body_rows(cells: Column) -> Column:
    """Rows below the header that hold anything."""
    rest = F.when(F.size(cells) > 1, F.slice(cells, 2, F.size(cells))).otherwise(F.array().cast("array<array<string>>"))
    return F.filter(rest, lambda r: F.exists(r, lambda c: c != ""))


def markdown(cells: Column) -> Column:
    """Pipe table as wide as its widest row: header row, alignment row, filled rows;
    '' when there are none. Empty cells read nan, empty headers 'Unnamed: i'."""
    head = F.get(cells, 0)
    width = F.when(F.size(head) > 0, F.array_max(F.transform(cells, lambda r: F.size(r)))).otherwise(0)
    line = lambda cs: F.concat(F.lit("| "), F.array_join(cs, " | "), F.lit(" |"))
    fill = lambda r: F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.coalesce(F.nullif(F.get(r, i), F.lit("")), F.lit("nan")))
    names = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.coalesce(F.nullif(F.get(head, i), F.lit("")), F.concat(F.lit("Unnamed: "), i.cast("string"))))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(":---|"), width))
    rows = F.transform(body_rows(cells), lambda r: line(fill(r)))
    text = F.concat_ws("\n", line(names), rule, F.array_join(rows, "\n"))
    return F.when((width > 0) & (F.size(rows) > 0), text).otherwise("")


def filled(table: Column) -> Column:
    cells = table_cells(table)
    return (F.size(F.get(cells, 0)) > 0) & (F.size(body_rows(cells)) > 0)


def placeholder_marks(matches: Column, flags: Column) -> Column:
    """What stands in the text for each table match: %%TABLE_n%% for a filled
    one (n counts filled ones), the match itself otherwise."""
    number = lambda i: F.size(F.filter(F.slice(flags, 1, i), lambda f: f)).cast("string")
    outer = lambda t: F.regexp_extract(t, r"(?is)(.*)<table\b", 1)
    mark = lambda t, i: F.concat(outer(t), F.lit(f"{CUT}%%TABLE_"), number(i), F.lit(f"%%{CUT}"))
    return F.transform(matches, lambda t, i: F.when(F.get(flags, i), mark(t, i)).otherwise(t))


def interleave(pieces: Column, between: Column) -> Column:
    """piece 0, between 0, piece 1, ... as one string."""
    return F.array_join(F.flatten(F.zip_with(pieces, between, lambda p, b: F.array(p, F.coalesce(b, F.lit(""))))), "")


def visible_text(html: Column) -> Column:
    """Text nodes, trimmed, joined by blanks."""
    nodes = F.split(F.regexp_replace(html, r"<[^>]+>", CUT), CUT, -1)
    nodes = F.transform(nodes, lambda n: trim_ws(entities(n)))
    text = F.array_join(F.filter(nodes, lambda n: n != ""), " ")
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n")


# --- lines and tables in text ------------------------------------------------
def is_pipe_line(line: Column) -> Column:
    s = trim_ws(line)
    return s.startswith("|") & s.endswith("|") & (F.length(s) > 2)


def table_runs(lines: Column, flags: Column) -> Column:
    """Maximal runs of flagged lines as (first, last), 1-based."""
    idx = F.sequence(F.lit(1), F.size(lines))
    at = lambda i: F.coalesce(F.get(flags, i - 1), F.lit(False))
    starts = F.filter(idx, lambda i: at(i) & ~F.when(i > 1, at(i - 1)).otherwise(F.lit(False)))
    ends = F.filter(idx, lambda i: at(i) & ~at(i + 1))
    return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("s"), e.alias("e")))


# --- cleaning ----------------------------------------------------------------
# the lookaheads only skip positions where no alternative can start
NOTATION = (
    r"(?=[($€£¥\d.,])(?:\([\d,.\s$€£%]+\)|[$€£¥]\s*[\d,.\s]+[MBKmbk]?|\(?[\d.,]+\s*%\)?|\b[\d,]+\.?\d*\s*[MBKmbk]\b)"
)
OPEN, CLOSE, RUN = "\ue000", "\ue001", "\ue002"  # private-use characters


def protect(text: Column, n: Column, pattern: str, mark: str) -> Column:
    """Replace the ``n`` matches of ``pattern`` by numbered marks."""
    marks = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")),
                        lambda i: F.concat(F.lit(mark), i.cast("string"), F.lit(CLOSE)))
    return interleave(F.split(text, pattern, -1), marks)


def restore(text: Column, found: Column, mark: str) -> Column:
    """Put the matches back where their marks stand."""
    p = mark + r"(\d+)" + CLOSE
    return interleave(F.split(text, p, -1), F.transform(find_all(text, p, 1), lambda i: F.get(found, i.cast("int"))))


def clean_plain(text: Column) -> Column:
    """Tags, style attributes, entities, filing boilerplate, white space."""
    t = F.regexp_replace(text, r'(?i)style\s*=\s*"[^"]*"', "")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    t = replace_all(t, fixed.CLEAN_ENTITIES)
    t = F.regexp_replace(t, "(?i)(?=[FDASPEC])" + fixed.BOILERPLATE_PATTERN, "")
    t = F.regexp_replace(t, r"(?U)(?=\s)[^\S\n|]+", " ")
    return trim_ws(F.regexp_replace(t, r"\n{3,}", "\n\n"))
