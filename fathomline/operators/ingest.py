"""From filing files to chunks.

Parsing, cleaning, metadata and chunking are projections over one filing per
row: wide, but without any shuffle, so throughput grows with the cluster and a
popular company skews nothing. Only placeholder lookups join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import markup as m
from ..functions import metadata as meta
from ..functions.text import estimate_tokens, find_all, trim_ws
from .percentiles import exact_percentiles


# --- parsing -----------------------------------------------------------------
def parse_filings(files: DataFrame, raw: str = "content") -> DataFrame:
    """Adds ``tables`` (Markdown), ``text_content`` with placeholders,
    ``table_count`` and ``table_positions``. Innermost tables are converted."""
    df = files.withColumn("_html", m.without_invisible(m.main_document(F.col(raw))))
    df = df.withColumns({"_match": find_all(F.col("_html"), m.TABLE), "_between": F.split("_html", m.TABLE, -1)})
    df = df.withColumn("_cells", F.transform("_match", lambda t: m.table_cells(m.leaf(t))))
    df = df.withColumn("_md", F.transform("_cells", lambda c: m.markdown(c)))
    df = df.withColumns({"_flags": F.transform("_md", lambda t: t != ""), "tables": F.filter("_md", lambda t: t != "")})
    df = df.withColumn("text_content", m.visible_text(m.interleave(F.col("_between"), m.placeholder_marks(F.col("_match"), F.col("_flags")))))
    mark = lambda i: F.concat(F.lit("%%TABLE_"), i.cast("string"), F.lit("%%"))
    spots = F.transform("tables", lambda _, i: F.struct(F.position(mark(i), F.col("text_content")).alias("p"), F.length(mark(i)).alias("n")))
    positions = F.transform(F.filter(spots, lambda x: x["p"] > 0), lambda x: F.struct((x["p"] - 1).alias("start"), (x["p"] - 1 + x["n"]).alias("end")))
    return df.withColumns({"table_count": F.size("tables"), "table_positions": positions}).drop("_html", "_match", "_between", "_cells", "_md", "_flags")


def table_rows(files: DataFrame, key: str, raw: str = "content") -> DataFrame:
    """Long form of every filled table: (key, table_index, row_index, cells)."""
    html = m.without_invisible(m.main_document(F.col(raw)))
    cells = F.filter(F.transform(m.table_html(html), lambda t: m.table_cells(t)), lambda c: (F.size(F.get(c, 0)) > 0) & (F.size(m.body_rows(c)) > 0))
    t = files.select(key, F.posexplode(cells).alias("table_index", "c"))
    return t.select(key, "table_index", F.posexplode(F.concat(F.array(F.get("c", 0)), m.body_rows(F.col("c")))).alias("row_index", "cells"))


def split_markdown_tables(docs: DataFrame, text: str) -> DataFrame:
    """Adds ``md_tables`` (runs of pipe lines) and ``rest`` (the other lines)."""
    df = docs.withColumn("_lines", F.split(text, "\n", -1)).withColumn("_flags", F.transform("_lines", lambda x: m.is_pipe_line(x)))
    runs = F.transform(m.table_runs(F.col("_lines"), F.col("_flags")), lambda r: F.array_join(F.slice("_lines", r["s"], r["e"] - r["s"] + 1), "\n"))
    rest = F.array_join(F.filter("_lines", lambda x: ~m.is_pipe_line(x)), "\n")
    return df.withColumns({"md_tables": runs, "rest": rest}).drop("_lines", "_flags")


def clean_financial_text(docs: DataFrame, text: str, out: str = "clean_text") -> DataFrame:
    """Cleaned text with figures and pipe tables untouched: both are replaced by
    numbered marks, the rest is cleaned, the marks are resolved again."""
    df = docs.withColumn("_fig", find_all(F.col(text), m.NOTATION))
    df = df.withColumn("_t", m.protect(F.col(text), F.size("_fig"), m.NOTATION, m.OPEN))
    df = df.withColumn("_lines", F.split("_t", "\n", -1)).withColumn("_flags", F.transform("_lines", lambda x: m.is_pipe_line(x)))
    df = df.withColumn("_runs", m.table_runs(F.col("_lines"), F.col("_flags")))
    df = df.withColumn("_tabs", F.transform("_runs", lambda r: F.array_join(F.slice("_lines", r["s"], r["e"] - r["s"] + 1), "\n")))
    df = df.withColumn("_first", F.transform("_runs", lambda r: r["s"]))
    place = lambda i: F.array_position("_first", i + 1)
    mark = lambda i: F.concat(F.lit(m.RUN), (place(i) - 1).cast("string"), F.lit(m.CLOSE))
    marked = F.transform("_lines", lambda x, i: F.when(~F.get("_flags", i), x).when(place(i) > 0, mark(i)))
    df = df.withColumn("_t", m.clean_plain(F.array_join(F.filter(marked, lambda x: x.isNotNull()), "\n")))
    df = df.withColumn("_t", m.restore(F.col("_t"), F.col("_tabs"), m.RUN)).withColumn("_t", m.restore(F.col("_t"), F.col("_fig"), m.OPEN))
    blank = F.coalesce(trim_ws(F.col(text)), F.lit("")) == ""
    return df.withColumn(out, F.when(blank, "").otherwise(F.col("_t"))).drop("_fig", "_t", "_lines", "_flags", "_runs", "_tabs", "_first")


# --- metadata ----------------------------------------------------------------
def extract_metadata(files: DataFrame, path: str = "path", content: str = "content", chunk_text: str | None = None, source_id: str | None = None) -> DataFrame:
    """Adds ticker, fiscal_year, doc_type, source_file, source_id, section and
    contains_table. An explicit source id wins over the accession number."""
    p, c = F.col(path), F.coalesce(F.col(content), F.lit(""))
    sid = meta.accession(p, c)
    text = F.col(chunk_text) if chunk_text else F.lit("")
    return files.withColumns({
        "ticker": meta.ticker(p, c), "fiscal_year": meta.fiscal_year(p, c), "doc_type": meta.doc_type(p, c), "source_file": meta.file_name(p),
        "source_id": F.coalesce(F.nullif(F.col(source_id), F.lit("")), sid) if source_id else sid,
        "section": meta.section(text), "contains_table": meta.has_table(text)})


# --- sections and tables in text ---------------------------------------------
def split_sections(text: Column) -> Column:
    """Array of (section, text): cut before 'Item N.' and 'Part I-IV' headers."""
    parts = F.filter(F.transform(F.split(text, rf"(?id)(?={fixed.SECTION_BOUNDARY})", -1), lambda p: trim_ws(p)), lambda p: p != "")
    head = lambda p: F.substring(trim_ws(F.regexp_extract(F.substring(p, 1, 300), "(?id)" + fixed.SECTION_HEADER, 0)), 1, fixed.SECTION_LABEL_CHARS)
    return F.transform(parts, lambda p: F.struct(F.coalesce(F.nullif(head(p), F.lit("")), F.lit(fixed.GENERAL)).alias("section"), p.alias("text")))


POSITION = rf"(?id){fixed.POSITION_HEADER}|{fixed.PART_HEADER}"


def last_header(text: Column) -> Column:
    """Label of the last section header in a text, null without one."""
    found = find_all(text, POSITION, 0)
    return F.when(F.size(found) > 0, F.substring(trim_ws(F.element_at(found, -1)), 1, fixed.SECTION_LABEL_CHARS))


def running_label(df: DataFrame, pieces: str, out: str) -> DataFrame:
    """Adds per piece the nearest header in earlier pieces (as-of by position).
    The labels are a column of their own, computed once per filing."""
    df = df.withColumn("_lab", F.transform(pieces, lambda p: last_header(p)))
    seen = lambda i: F.filter(F.slice("_lab", 1, i), lambda x: x.isNotNull())
    near = F.transform("_lab", lambda _, i: F.coalesce(F.get(F.reverse(seen(i)), 0), F.lit(fixed.GENERAL)))
    return df.withColumn(out, near).drop("_lab")


PLACEHOLDER = r"%%TABLE_(\d+)%%"


def placeholder_sections(df: DataFrame, text: str, out: str = "placeholders") -> DataFrame:
    """Adds an array of (table_index, section), one per placeholder."""
    df = df.withColumns({"_pc": F.split(text, PLACEHOLDER, -1), "_ids": find_all(F.col(text), PLACEHOLDER, 1)})
    df = running_label(df, "_pc", "_near")
    # the label before piece i + 1 covers everything up to placeholder i
    pair = F.zip_with("_ids", F.slice("_near", 2, F.size("_ids")), lambda n, s: F.struct(n.cast("int").alias("table_index"), s.alias("section")))
    return df.withColumn(out, F.when(F.size("_ids") > 0, pair).otherwise(F.array().cast("array<struct<table_index:int,section:string>>"))).drop("_pc", "_ids", "_near")


def table_chunks_in_text(df: DataFrame, text: str, out: str = "pieces") -> DataFrame:
    """Adds an array of (section, table, rest): each pipe table with the footnote
    lines right below it is one piece, ``rest`` the text that follows. The first
    entry has no table and holds the text before the first one."""
    kind = lambda x: F.when(x.rlike("(?d)" + fixed.TABLE_LINE), "T").when(x.rlike(fixed.FOOTNOTE_LINE), "F").otherwise("x")
    df = df.withColumn("_ls", F.split(text, "\n", -1))
    df = df.withColumn("_k", F.array_join(F.transform("_ls", kind), ""))  # one letter per line
    at = lambda i: F.substring(F.col("_k"), i, F.lit(1))
    begins = lambda i: (at(i + 1) == "T") & ((i == 0) | (at(i) != "T"))
    df = df.withColumn("_starts", F.filter(F.sequence(F.lit(0), F.size("_ls") - 1), begins))
    df = df.withColumn("_from", F.concat(F.array(F.lit(0)), F.col("_starts"))).withColumn("_to", F.concat(F.col("_starts"), F.array(F.size("_ls"))))
    lines = lambda s, e: F.when(e > s, F.array_join(F.slice("_ls", s + 1, e - s), "\n"))
    df = df.withColumn("_pieces", F.zip_with("_from", "_to", lambda s, e: F.coalesce(lines(s, e), F.lit(""))))
    df = running_label(df, "_pieces", "_near")
    df = df.withColumn("_n", F.transform(F.zip_with("_from", "_to", lambda s, e: F.substring(F.col("_k"), s + 1, e - s)),
                                         lambda k, i: F.when(i > 0, F.length(F.regexp_extract(k, "^T+F*", 0))).otherwise(0)))
    spans = F.zip_with(F.arrays_zip("_from", "_to", "_n"), F.col("_near"), lambda z, sec: F.struct(
        sec.alias("section"), lines(z["_from"], z["_from"] + z["_n"]).alias("table"), lines(z["_from"] + z["_n"], z["_to"]).alias("rest")))
    return df.withColumn(out, spans).drop("_ls", "_k", "_starts", "_from", "_to", "_pieces", "_near", "_n")


# --- bounded text chunks -----------------------------------------------------
def segments(text: Column, max_tokens: int) -> Column:
    """Paragraphs; longer ones as sentences; longer ones as words; longer ones
    cut hard. Nothing is dropped."""
    tok = estimate_tokens
    keep = lambda arr: F.filter(F.transform(arr, lambda s: trim_ws(s)), lambda s: s != "")
    wide = 4 * max_tokens
    hard = lambda w: F.when(tok(w) <= max_tokens, F.array(w)).otherwise(F.transform(
        F.sequence(F.lit(0), F.ceil(F.length(w) / wide).cast("int") - 1), lambda k: F.substring(w, k * wide + 1, F.lit(wide))))
    words = lambda s: F.when(tok(s) <= max_tokens, F.array(s)).otherwise(F.flatten(F.transform(keep(F.split(s, r"(?U)\s+")), hard)))
    sents = lambda p: F.when(tok(p) <= max_tokens, F.array(p)).otherwise(F.flatten(F.transform(keep(F.split(p, r"(?U)(?<=[.!?])\s+")), words)))
    return F.flatten(F.transform(keep(F.split(text, r"\n{2,}")), sents))


def pack(segs: Column, max_tokens: int, min_tokens: int, overlap: int) -> Column:
    """Greedy packing as a fold over segment sizes: array of (s, e) slices.

    A full chunk is closed and the next one starts with as many of its last
    segments as the overlap allows; a small last chunk joins its predecessor
    when both fit."""
    state = "struct<b:array<struct<s:int,e:int>>,s:int,i:int,c:array<int>,t:int>"
    zero = F.struct(F.array().cast("array<struct<s:int,e:int>>").alias("b"), F.lit(0).alias("s"), F.lit(0).alias("i"),
                    F.array().cast("array<int>").alias("c"), F.lit(0).alias("t")).cast(state)

    def step(a: Column, seg: Column) -> Column:
        x = estimate_tokens(seg)
        room = F.least(F.lit(overlap), F.lit(max_tokens) - x)
        back = F.aggregate(
            F.reverse(a["c"]), F.struct(F.lit(0).alias("n"), F.lit(0).alias("t"), F.lit(True).alias("go")),
            lambda r, y: F.when(r["go"] & (r["t"] + y <= room), F.struct((r["n"] + 1).alias("n"), (r["t"] + y).alias("t"), F.lit(True).alias("go")))
            .otherwise(F.struct(r["n"].alias("n"), r["t"].alias("t"), F.lit(False).alias("go"))))
        tail = F.when(back["n"] > 0, F.slice(a["c"], -back["n"], back["n"])).otherwise(F.array().cast("array<int>"))
        more = F.struct(a["b"], a["s"], a["i"] + 1, F.concat(a["c"], F.array(x)), a["t"] + x).cast(state)
        new = F.struct(F.concat(a["b"], F.array(F.struct(a["s"].alias("s"), a["i"].alias("e")))), a["i"] - back["n"], a["i"] + 1,
                       F.concat(tail, F.array(x)), back["t"] + x).cast(state)
        return F.when((a["t"] + x <= max_tokens) | (a["i"] == a["s"]), more).otherwise(new)

    def finish(a: Column) -> Column:
        last = F.struct(a["s"].alias("s"), a["i"].alias("e"))
        n = F.size(a["b"])
        prev = F.when(n > 0, F.element_at(a["b"], -1))
        # size of predecessor and tail together, overlap counted once
        joint = F.aggregate(F.slice(segs, prev["s"] + 1, a["i"] - prev["s"]), F.lit(0), lambda s, g: s + estimate_tokens(g))
        merge = (n > 0) & (a["t"] < min_tokens) & (joint <= max_tokens)
        merged = F.concat(F.slice(a["b"], F.lit(1), n - 1), F.array(F.struct(prev["s"].alias("s"), a["i"].alias("e"))))
        return F.when(merge, merged).otherwise(F.concat(a["b"], F.array(last)))

    return F.aggregate(segs, zero, step, finish)


def bounded_chunks(df: DataFrame, texts: str, out: str, max_tokens: int = fixed.CHUNK_MAX_TOKENS, min_tokens: int = fixed.CHUNK_MIN_TOKENS,
                   overlap_ratio: float = fixed.CHUNK_OVERLAP_RATIO) -> DataFrame:
    """``texts`` (array of texts) -> ``out`` (array of chunk arrays), in the row.
    Segments and cuts are columns of their own so that each is computed once."""
    whole = lambda t: F.when(estimate_tokens(t) <= max_tokens, F.array(t)).otherwise(segments(t, max_tokens))
    df = df.withColumn("_seg", F.transform(texts, whole))
    df = df.withColumn("_cut", F.transform("_seg", lambda s: pack(s, max_tokens, min_tokens, int(max_tokens * overlap_ratio))))
    text = lambda s, b: F.array_join(F.slice(s, b["s"] + 1, b["e"] - b["s"]), " ")
    return df.withColumn(out, F.zip_with("_seg", "_cut", lambda s, c: F.transform(c, lambda b: text(s, b)))).drop("_seg", "_cut")


def chunk_text_bounded(df: DataFrame, text: str, out: str = "chunks", **limits) -> DataFrame:
    """Adds an array of chunk texts; short texts stay whole, blank ones give none."""
    t = trim_ws(F.col(text))
    df = df.withColumn("_texts", F.filter(F.array(t), lambda x: x != ""))
    return bounded_chunks(df, "_texts", "_chunks", **limits).withColumn(out, F.flatten("_chunks")).drop("_texts", "_chunks")


def chunk_corpus(docs: DataFrame, text: str = "text_content", tables: str | None = "tables") -> DataFrame:
    """All chunks of each filing: parser tables, then pipe tables in the text
    (one running index), then section texts (their own index).

    ``docs`` carries ticker, fiscal_year, source_file and any other columns to
    keep; every chunk gets chunk_id, raw_text, chunk_type, token_count, section
    and contains_table."""
    from ..sources.derived import chunk_key

    keep = [c for c in docs.columns if c not in (text, tables, "section", "contains_table", "chunk_id")]
    df = table_chunks_in_text(docs, text, "_parts")
    own = F.transform(F.filter("_parts", lambda p: p["table"].isNotNull()), lambda p: F.struct(p["section"].alias("section"), p["table"].alias("t")))
    if tables:
        df = placeholder_sections(df, text, "_at")
        label = lambda i: F.coalesce(F.get(F.filter("_at", lambda s: s["table_index"] == i), 0)["section"], F.lit(fixed.GENERAL))
        own = F.concat(F.transform(tables, lambda t, i: F.struct(label(i).alias("section"), t.alias("t"))), own)
    entry = lambda i, section, text, kind: F.struct(i.alias("chunk_index"), section.alias("section"), text.alias("raw_text"), F.lit(kind).alias("chunk_type"))
    listed = lambda x: F.coalesce(x, F.array()).cast("array<struct<chunk_index:int,section:string,raw_text:string,chunk_type:string>>")
    df = df.withColumn("_tabs", F.transform(own, lambda p, i: entry(i, p["section"], trim_ws(p["t"]), "table")))
    remaining = F.array_join(F.filter(F.transform("_parts", lambda p: p["rest"]), lambda r: r.isNotNull()), "\n")
    df = df.withColumn("_secs", split_sections(remaining)).withColumn("_texts", F.transform("_secs", lambda x: x["text"]))
    df = bounded_chunks(df, "_texts", "_chunks")
    flat = F.flatten(F.zip_with("_secs", "_chunks", lambda x, c: F.transform(c, lambda t: F.struct(x["section"].alias("section"), t.alias("t")))))
    flat = F.transform(flat, lambda p, i: entry(i, p["section"], p["t"], "text"))
    # one pass: two would parse and clean every filing twice
    both = df.select(*keep, F.explode(F.concat(listed(F.col("_tabs")), listed(flat))).alias("p")).select(*keep, "p.*").where("chunk_type = 'text' OR raw_text <> ''")
    kind = F.when(F.col("chunk_type") == "table", "tbl").otherwise("txt")
    ids = {k: chunk_key(F.col("ticker"), F.col("fiscal_year"), k, F.col("source_file"), F.col("chunk_index")) for k in ("tbl", "txt")}
    return both.withColumns({
        "chunk_id": F.when(kind == "tbl", ids["tbl"]).otherwise(ids["txt"]), "token_count": estimate_tokens(F.col("raw_text")),
        "contains_table": F.col("chunk_type") == "table"})


# --- placeholders ------------------------------------------------------------
def placeholder_refs(chunks: DataFrame, text: str = "raw_text") -> DataFrame:
    """One row per placeholder: chunk_id, pos, table_index and the chunk id the
    table must have."""
    from ..sources.derived import chunk_key

    r = chunks.select("chunk_id", "ticker", "fiscal_year", "source_file", F.posexplode(find_all(F.col(text), PLACEHOLDER, 1)).alias("pos", "n"))
    r = r.withColumn("table_index", F.col("n").cast("long")).drop("n")
    return r.withColumn("ref_id", chunk_key(F.col("ticker"), F.col("fiscal_year"), "tbl", F.col("source_file"), F.col("table_index")))


def resolve_table_placeholders(chunks: DataFrame, tables: DataFrame, per_table: int = fixed.MAX_INLINE_TABLE_CHARS, per_doc: int = fixed.MAX_INLINE_CHARS_PER_DOC) -> DataFrame:
    """Put the referenced tables into the text, in order, under both caps; a
    missing table or a spent budget leaves the marker. Only placeholders travel
    through the table join, not the texts."""
    refs = placeholder_refs(chunks)
    t = tables.select(F.col("chunk_id").alias("ref_id"), F.substring("raw_text", 1, per_table).alias("table_text"))
    hit = refs.join(t, "ref_id", "left")
    size = F.coalesce(F.length("table_text"), F.lit(0))
    prior = F.coalesce(F.sum(size).over(Window.partitionBy("chunk_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = F.greatest(F.lit(0), F.least(size, F.lit(per_doc) - prior)).cast("int")
    new = F.when(kept > 0, F.concat(F.lit("\n[TABLE "), F.col("table_index").cast("string"), F.lit("]\n"), F.substring("table_text", F.lit(1), kept)))
    per = hit.select("chunk_id", "pos", F.coalesce(new, F.concat(F.lit("%%TABLE_"), F.col("table_index").cast("string"), F.lit("%%"))).alias("new"))
    per = per.groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "new"))), lambda s: s["new"]).alias("_new"))
    joined = m.interleave(F.split("raw_text", PLACEHOLDER, -1), F.col("_new"))
    return chunks.join(per, "chunk_id", "left").withColumn("raw_text", F.when(F.col("_new").isNotNull(), joined).otherwise(F.col("raw_text"))).drop("_new")


FILING = ["ticker", "fiscal_year", "source_file"]


def placeholder_alignment(chunks: DataFrame, tables: DataFrame) -> DataFrame:
    """Per filing: placeholders, resolved, unresolved."""
    t = tables.select(F.col("chunk_id").alias("ref_id"), F.lit(1).alias("_t"))
    j = placeholder_refs(chunks).join(t, "ref_id", "left")
    return j.groupBy(*FILING).agg(F.count(F.lit(1)).alias("refs"), F.count("_t").alias("resolved"), F.count_if(F.col("_t").isNull()).alias("unresolved"))


def orphan_tables(chunks: DataFrame, tables: DataFrame) -> DataFrame:
    """Table chunks no text chunk refers to."""
    refs = placeholder_refs(chunks).select(F.col("ref_id").alias("chunk_id")).distinct()
    return tables.join(refs, "chunk_id", "left_anti").select("chunk_id", *FILING)


def table_size_stats(tables: DataFrame, cap: int = fixed.MAX_INLINE_TABLE_CHARS) -> DataFrame:
    """Count, least, median, largest length and how many exceed the cap."""
    t = tables.select(F.length("raw_text").alias("n"))
    median = exact_percentiles(t, "n", {"median_chars": 0.5}).scalar()
    return t.agg(F.count(F.lit(1)).alias("tables"), F.min("n").alias("min_chars"), F.max("n").alias("max_chars"), F.count_if(F.col("n") > cap).alias("over_cap")).select("*", median.alias("median_chars"))
