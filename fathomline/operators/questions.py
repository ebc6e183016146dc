"""Preparing a table of questions: routing, scope, rewriting, memory."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions.text import any_of, find_all, first_match, trim_ws
from .windows import carry_forward

USER_ROLES = ["user", "human"]


def _map(pairs) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs for x in kv])


# --- routing -----------------------------------------------------------------
def is_unsafe(text: Column) -> Column:
    return text.rlike("(?i)" + "|".join(f"(?:{p})" for p in fixed.INJECTION_PATTERNS))


def is_chitchat(text: Column) -> Column:
    return trim_ws(text).rlike("(?i)" + "|".join(f"(?:{p})" for p in fixed.CHITCHAT_PATTERNS))


def route(text: Column) -> Column:
    """BLOCKED, GENERAL or REWRITE."""
    return F.when(is_unsafe(text), "BLOCKED").when(is_chitchat(text), "GENERAL").otherwise("REWRITE")


# --- companies, years, sections ----------------------------------------------
def all_tickers(text: Column) -> Column:
    """Known tickers and company names in the order they first appear."""
    known = [(t.lower(), t) for t in fixed.SUPPORTED_TICKERS] + fixed.COMPANY_WORDS
    found = find_all(F.lower(text), r"(?U)\b(" + "|".join(w for w, _ in known) + r")\b", 1)
    return F.array_distinct(F.transform(found, lambda w: _map(known)[w]))


def mentioned_tickers(text: Column) -> Column:
    """Companies named in the text, in dictionary order."""
    found = F.transform(find_all(F.lower(text), r"(?U)\b(" + "|".join(w for w, _ in fixed.MENTION_WORDS) + r")\b", 1), lambda w: _map(fixed.MENTION_WORDS)[w])
    return F.filter(F.array(*[F.lit(t) for t in fixed.SUPPORTED_TICKERS]), lambda t: F.array_contains(found, t))


def subject(text: Column) -> Column:
    """Supported ticker, else company name, else the first other capital word."""
    lowered = F.lower(text)
    steps = [(t.lower(), t) for t in fixed.SUPPORTED_TICKERS] + fixed.COMPANY_WORDS
    named = reduce(lambda acc, s: F.when(lowered.rlike(r"(?U)\b" + s[0] + r"\b"), s[1]).otherwise(acc), reversed(steps), F.lit(None).cast("string"))
    caps = F.filter(find_all(text, r"(?U)" + fixed.CAPS_PATTERN), lambda w: ~w.isin(fixed.NON_TICKER_CAPS))
    return F.coalesce(named, F.get(caps, 0))


def query_fiscal_year(text: Column) -> Column:
    """Latest year that follows FY or 'fiscal (year)'; bare years do not count."""
    return F.array_max(F.transform(find_all(text, "(?i)" + fixed.FISCAL_YEAR_PATTERN, 1), lambda y: y.cast("int"))).cast("string")


def _in_range(year: Column) -> Column:
    y = year.cast("int")
    return F.when(y.between(2000, 2035), y)


def own_year(text: Column) -> Column:
    return _in_range(F.get(find_all(text, fixed.YEAR_PATTERN), 0))


def last_year_of(text: Column) -> Column:
    years = find_all(text, fixed.YEAR_PATTERN)
    return _in_range(F.when(F.size(years) > 0, F.element_at(years, -1)))


def section_ref(text: Column) -> Column:
    n = F.regexp_extract(F.regexp_extract(text, "(?i)" + fixed.SECTION_REF_PATTERN, 0), r"[1-9][A-Za-z]?", 0)
    return F.when(n != "", F.concat(F.lit("Item "), F.upper(n)))


def has_reference(text: Column) -> Column:
    return F.lower(text).rlike("(?U)" + fixed.COREFERENCE_PATTERN)


# --- several companies -------------------------------------------------------
def multi_ticker_intent(text: Column) -> Column:
    return (F.size(mentioned_tickers(text)) >= 2) | text.rlike("(?i)" + fixed.COMPARISON_PATTERN)


def detected_tickers(text: Column, expand_when_named: bool = True) -> Column:
    """Named companies; comparison wording adds every supported one (also when
    some are named, unless switched off)."""
    named = mentioned_tickers(text)
    cross = F.lower(text).rlike("(?i)" + fixed.CROSS_COMPANY_PATTERN)
    cross = cross if expand_when_named else cross & (F.size(named) < 2)
    return F.when(cross, F.array_union(named, F.array(*[F.lit(t) for t in fixed.SUPPORTED_TICKERS]))).otherwise(named)


def comparison_pool(text: Column, explicit: Column) -> Column:
    """Explicit and detected tickers; at most four sub-retrievals."""
    given = F.filter(F.coalesce(explicit, F.array().cast("array<string>")), lambda t: t != "")
    return F.slice(F.array_union(given, detected_tickers(text)), 1, fixed.MAX_COMPARISON_TICKERS)


def cross_ticker_bypass(plans: DataFrame, query: str = "query") -> DataFrame:
    """No company restriction for questions about several companies."""
    free = multi_ticker_intent(F.col(query))
    return plans.withColumns({c: F.when(~free, F.col(c)) for c in ("ticker", "tickers") if c in plans.columns})


# --- rewriting ---------------------------------------------------------------
def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\W+"), lambda w: w != ""))


def needs_expansion(text: Column) -> Column:
    return (word_count(text) < fixed.MIN_EXPANSION_WORDS) | ~any_of(F.lower(text), fixed.FINANCE_KEYWORDS)


def _swap_first(text: Column, pattern: str, make) -> Column:
    """Replace the first match of ``pattern`` (null without one)."""
    p = rf"(?sU)^(.*?)({pattern})(.*)$"
    part = [F.regexp_extract(text, p, i) for i in (1, 2, 3)]
    return F.when(part[1] != "", F.concat(part[0], make(part[1]), part[2]))


def expand_queries(text: Column, max_variants: int = fixed.MAX_VARIANTS) -> Column:
    """Up to four distinct phrasings, the question itself first."""
    lowered, out = F.lower(text), []
    for term, synonyms in fixed.SYNONYMS:
        at = F.instr(lowered, term)
        for s in synonyms:
            out.append(F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.lit(s), F.substring(text, at + len(term), F.length(text)))))
    names = _map(fixed.COMPANY_LEGAL.items())
    out.append(_swap_first(text, fixed.CAPS_PATTERN, lambda t: F.concat(names[t], F.lit(" ("), t, F.lit(")"))))
    year = r"\b(?:19|20)\d{2}\b"
    out.append(_swap_first(text, year, lambda y: F.concat(F.lit("fiscal year "), y)))
    out.append(_swap_first(text, year, lambda y: F.concat(F.lit("FY "), y)))
    form = lowered.contains("10-k") | lowered.contains("10k")
    out.append(F.concat(text, F.when(form, " as disclosed in the SEC 10-K annual report").otherwise(" as reported in the company's annual report")))
    return F.slice(F.array_distinct(F.filter(F.array(text, *out), lambda v: v.isNotNull())), 1, max_variants)


def expanded(questions: DataFrame, query: str = "query") -> DataFrame:
    """One row per retrieval query: variant 0 is the question; only questions
    that need it get more."""
    t = trim_ws(F.col(query))
    variants = F.when(needs_expansion(t) | (word_count(t) < fixed.MIN_EXPANSION_WORDS), expand_queries(t)).otherwise(F.array(t))
    return questions.where(t != "").select("*", F.posexplode(variants).alias("variant", "retrieval_query"))


# --- conversations -----------------------------------------------------------
def resolve_references(turns: DataFrame) -> DataFrame:
    """Per user turn: the company and year it is about, and the question with
    the company spelled out where it only refers to one.

    ``turns``: conv_id, turn (integer), role, content."""
    user = F.lower("role").isin(USER_ROLES)
    t = turns.withColumns({"_all": F.when(user, all_tickers(F.col("content"))), "_sub": subject(F.col("content"))})
    at_least = lambda n: F.when(F.size("_all") >= n, F.col("_all"))
    prev = F.when(user, F.struct(F.coalesce("_sub", F.get("_all", 0)).alias("t")))
    t = carry_forward(t, "conv_id", "turn", {
        "_h1": at_least(1), "_h2": at_least(2), "_h3": at_least(3), "_prev": prev, "_any": F.lit(True),
        "_year": F.when(user, last_year_of(F.col("content")))}).where(user)
    low = F.lower("content")
    nth = lambda word, col, i: F.when(low.contains(f"{word} company"), F.get(col, i))
    refers = F.coalesce(F.col("_any"), F.lit(False)) & has_reference(F.col("content"))
    ticker = F.coalesce("_sub", nth("first", "_h1", 0), nth("second", "_h2", 1), nth("third", "_h3", 2), F.when(refers, F.col("_prev.t")))
    t = t.withColumns({"ticker": ticker, "fiscal_year": F.coalesce(own_year(F.col("content")), F.col("_year"))})
    name = F.coalesce(_map(fixed.COMPANY_LEGAL.items())[F.col("ticker")], F.col("ticker"))
    absent = ~F.contains(low, F.lower(name)) & ~F.contains(low, F.lower("ticker"))
    standalone = F.when(refers & F.col("ticker").isNotNull() & absent, trim_ws(F.concat(name, F.lit(" ("), "ticker", F.lit(") "), "content"))).otherwise(F.col("content"))
    tickers = F.when((F.size("_all") == 0) & F.col("ticker").isNotNull(), F.coalesce("_h1", F.col("_all"))).otherwise(F.col("_all"))
    return t.select("conv_id", "turn", "content", "ticker", "fiscal_year", F.when(F.size(tickers) > 1, tickers).alias("tickers"), standalone.alias("standalone_query"))


def memory_window(turns: DataFrame, pairs: int = fixed.MEMORY_PAIRS) -> DataFrame:
    """System turns and the last ``pairs`` exchanges. The rank filter is pushed
    below the shuffle, so long conversations send only their tail."""
    system = F.lower("role") == "system"
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    tail = turns.where(~system).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 2 * pairs).drop("_r")
    return turns.where(system).unionByName(tail)


def redact_last_ai(turns: DataFrame, replacement: str) -> DataFrame:
    """Replace the newest assistant turn; conversations without one get it
    appended. Joins on (conversation, turn), so long ones do not skew."""
    ai = F.lower("role") == "assistant"
    last = turns.groupBy("conv_id").agg(F.max(F.when(ai, F.col("turn"))).alias("_at"), F.max("turn").alias("_end"))
    hit = last.where("_at is not null").select("conv_id", F.col("_at").alias("turn"), F.lit(True).alias("_hit"))
    out = turns.join(hit, ["conv_id", "turn"], "left").withColumn("content", F.when(F.col("_hit") & ai, replacement).otherwise(F.col("content"))).drop("_hit")
    add = last.where("_at is null").select("conv_id", (F.col("_end") + 1).alias("turn"), F.lit("assistant").alias("role"), F.lit(replacement).alias("content"))
    return out.unionByName(add)
