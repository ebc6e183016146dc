"""Answer parsing and verification. Row-local work stays row-local (array
functions inside one projection); only evidence lookups join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.numbers import close_to, drop_zeros, normalize_number, number_tokens, numeric_values
from ..functions.text import find_all, first_match, trim_ws
from ..session import stored

ANSWER_SCHEMA = "internal_thought string, extracted_raw_data string, answer string, sources array<string>, content string"


# --- model output ------------------------------------------------------------
def strip_wrapping(raw: Column) -> Column:
    """Without thinking tags; the inside of a code fence when there is one."""
    t = trim_ws(F.coalesce(raw, F.lit("")))
    t = F.regexp_replace(t, r"(?s)<think>.*?</think>", "")
    t = trim_ws(F.regexp_replace(t, r"(?s)<thinking>.*?</thinking>", ""))
    return unfence(t)


def unfence(t: Column) -> Column:
    pattern = r"(?s)```(?:json)?\s*\n?(.*?)\n?```"
    return F.when(t.rlike(pattern), trim_ws(F.regexp_extract(t, pattern, 1))).otherwise(t)


def json_or_null(t: Column) -> Column:
    """The text when it is valid JSON, else its outermost braces when those are."""
    braces = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    valid = lambda c: F.try_parse_json(c).isNotNull()
    return F.when(valid(t) & (t != ""), t).when(valid(braces) & (braces != ""), braces)


def is_refusal(text: Column, markers: list[str] = fixed.REFUSAL_MARKERS) -> Column:
    low = F.lower(text)  # literal searches: an alternation would try every marker at every letter
    return F.coalesce(reduce(lambda x, y: x | y, [F.contains(low, F.lit(m)) for m in markers]), F.lit(False))


def _unescape(t: Column) -> Column:
    for old, new in (("\\n", "\n"), ("\\t", "\t"), ('\\"', '"'), ("\\\\", "\\")):
        t = F.replace(t, F.lit(old), F.lit(new))
    return t


def parse_answers(outputs: DataFrame, raw: str = "raw_output") -> DataFrame:
    """Model text -> internal_thought, extracted_raw_data, answer, sources and
    ``parsed`` (false when the raw text had to stand in)."""
    js = json_or_null(strip_wrapping(F.col(raw)))
    out = outputs.withColumn("_o", F.from_json(js, ANSWER_SCHEMA))
    for _ in range(3):  # answers wrapped as {"content": "<json>"} up to three deep
        out = out.withColumn("_o", F.coalesce(F.when(F.col("_o.content").isNotNull(), F.from_json("_o.content", ANSWER_SCHEMA)), F.col("_o")))
    answer = F.col("_o.answer")
    data = F.when(F.coalesce(F.length("_o.extracted_raw_data"), F.lit(0)) > 0, F.col("_o.extracted_raw_data")).otherwise(F.coalesce(answer, F.lit("N/A")))
    given = F.when(F.coalesce(F.size("_o.sources"), F.lit(0)) > 0, F.col("_o.sources")).otherwise(F.array(F.lit("unknown")))
    sources = F.filter(F.transform(given, lambda s: trim_ws(s)), lambda s: s != "")
    refusal = (F.size(sources) == 0) & is_refusal(answer)
    ok = (F.length(answer) > 0) & (F.length("_o.internal_thought") > 0) & (F.length(data) > 0) & (
        refusal | ((F.size(sources) > 0) & F.col("_o.internal_thought").rlike(r"\d")))
    ok = F.coalesce(ok, F.lit(False))
    inner = first_match(F.col(raw), r'"answer"\s*:\s*"((?:[^"\\]|\\.)*)"')
    plain = F.coalesce(_unescape(inner), F.nullif(trim_ws(F.col(raw)), F.lit("")), F.lit(fixed.EMPTY_ANSWER))
    return out.select(
        *outputs.columns,
        F.when(ok, F.col("_o.internal_thought")).otherwise("1. Fallback: raw LLM output could not be parsed as structured JSON.").alias("internal_thought"),
        F.when(ok, data).otherwise("No structured data was extracted from the LLM response.").alias("extracted_raw_data"),
        F.when(ok, answer).otherwise(plain).alias("answer"), F.when(ok, sources).otherwise(F.array(F.lit("unknown"))).alias("sources"), ok.alias("parsed"))


def classify_outputs(raw: Column) -> Column:
    """structured, refusal or malformed."""
    t = trim_ws(F.coalesce(raw, F.lit("")))
    return (F.when(t == "", "malformed").when(json_or_null(unfence(t)).isNotNull(), "structured")
            .when(is_refusal(t), "refusal").otherwise("malformed"))


# --- the answer against its own facts ----------------------------------------
def verify_claims(answers: DataFrame, answer: str = "answer", evidence: str = "extracted_raw_data", strict_parens: bool = True) -> DataFrame:
    """Every number of the answer must be among the numbers of its facts (also
    without leading zeros); an answer without numbers passes."""
    norm = lambda arr: F.transform(arr, lambda n: normalize_number(n, strict_parens))
    zero = lambda arr: F.transform(arr, lambda n: drop_zeros(n))
    df = answers.withColumns({"_n": number_tokens(F.col(answer)), "_e": F.array_distinct(norm(number_tokens(F.col(evidence))))})
    df = df.withColumn("_z", zero(F.col("_e")))

    def known(n: Column) -> Column:
        m = normalize_number(n, strict_parens)
        return F.array_contains("_e", m) | F.array_contains("_z", drop_zeros(m))

    return df.withColumns({"verified_claims": F.filter("_n", known), "failed_claims": F.filter("_n", lambda n: ~known(n))}).withColumn(
        "passed", F.size("failed_claims") == 0).drop("_n", "_e", "_z")


def verdict_status(verified: DataFrame, ran: Column, answer: str = "answer", skip_cache: Column | None = None) -> DataFrame:
    """passed / failed / error / not_run, the delivered text and whether the
    answer may enter the cache. Facts that are missing make an error."""
    status = (F.when(~ran, "not_run").when(F.col("extracted_raw_data").isNull(), "error").when(F.col("passed"), "passed").otherwise("failed"))
    skip = F.lit(False) if skip_cache is None else skip_cache
    return verified.withColumn("status", status).withColumns({
        "final_output": F.when(F.col("status") == "failed", fixed.SAFE_FALLBACK).otherwise(F.col(answer)),
        "cacheable": (F.col("status") == "passed") & ~skip & ~F.contains(F.lower(answer), F.lit("not available"))})


def enforce_delivery(verdicts: DataFrame, enforce: bool = True, answer: str = "answer", sources: str = "sources") -> DataFrame:
    """What the user receives: fallback on failure, a notice when verification
    broke down, otherwise the answer. Sources go with the answer."""
    failed = F.lit(enforce) & (F.col("status") == "failed")
    withheld = F.lit(enforce) & F.col("status").isin("error", "timeout")
    changed = failed | withheld
    return verdicts.withColumns({
        "delivered": F.when(failed, F.col("final_output")).when(withheld, fixed.WITHHELD_MESSAGE).otherwise(F.col(answer)),
        "delivered_sources": F.when(changed, F.array().cast("array<string>")).otherwise(F.col(sources)), "enforced": changed})


# --- the answer against the corpus -------------------------------------------
def financial_claims(answer: Column) -> Column:
    """Money, percent and metric phrases, distinct, in pattern order."""
    found = [F.transform(find_all(answer, "(?i)" + p), lambda c: F.trim(c)) for p in fixed.CLAIM_PATTERNS]
    return F.array_distinct(F.flatten(F.array(*found)))


def claim_rows(answers: DataFrame, keep: list[str], answer: str = "answer") -> DataFrame:
    """One row per claim: keep..., claim_no, claim, value."""
    rows = answers.select(*keep, F.posexplode(financial_claims(F.col(answer))).alias("claim_no", "claim"))
    return rows.withColumn("value", F.get(numeric_values(F.col("claim")), 0))


def _bucket(v: Column) -> Column:
    """Buckets half as wide as the tolerance: linear below 24 (where 0.12
    rules), logarithmic above. Close values lie at most two buckets apart."""
    return F.when(v < 24, F.floor(v / 0.0625)).otherwise(384 + F.floor(F.log(v / 24) / 0.00255)).cast("long")


def evidence_numbers(chunks: DataFrame, by: list[str], text: str = "raw_text") -> DataFrame:
    """Figures per scope, reduced to the lowest and highest per bucket. Only the
    nearest figure can decide closeness, so nothing is lost."""
    v = chunks.select(*by, F.explode(F.array_distinct(numeric_values(F.col(text)))).alias("v"))
    return v.groupBy(*by, _bucket(F.col("v")).alias("bucket")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))


def near_figures(evidence: DataFrame, by: list[str]) -> DataFrame:
    """For each bucket the ``figures`` that can be close to a value in it, those of five buckets: ten at most."""
    near = evidence.select(*by, F.explode(F.sequence(F.col("bucket") - 2, F.col("bucket") + 2)).alias("bucket"), F.array("lo", "hi").alias("x"))
    return near.groupBy(*by, "bucket").agg(F.flatten(F.collect_list("x")).alias("figures"))


def claims_vs_evidence(claims: DataFrame, evidence: DataFrame, by: list[str], key: list[str] | None = None) -> DataFrame:
    """Claims with ``matched``: a figure of the scope within the tolerance. Each
    claim meets one row, that of its bucket, so that no ``key`` is needed to bring them together again; the evidence, which is small beside the claims, is
    written first, so that its size is known when the join is planned."""
    near = stored(near_figures(evidence, by), "evidence").withColumnRenamed("bucket", "_bucket")
    met = claims.withColumn("_bucket", _bucket(F.col("value"))).join(near, [*by, "_bucket"], "left")
    matched = F.coalesce(F.exists("figures", lambda x: close_to(F.col("value"), x)), F.lit(False))
    return met.select(*claims.columns, matched.alias("matched"))


def derived_margin(chunks: DataFrame, by: list[str], order: str = "chunk_id", text: str = "raw_text") -> DataFrame:
    """Operating and gross margin per scope from its first revenue and first
    income or gross figure in document order."""
    def figure(pattern: str) -> Column:
        return F.replace(first_match(F.col(text), "(?i)" + pattern), F.lit(","), F.lit("")).try_cast("double")

    def first(name: str) -> Column:
        return F.min_by(name, F.when(F.col(name).isNotNull(), F.col(order))).alias(name)

    # figures are taken out of the texts that name one, before rows are sorted by scope; all scopes stay
    patterns = {"revenue": fixed.REVENUE_FIGURE, "operating": fixed.OPERATING_FIGURE, "gross": fixed.GROSS_FIGURE}
    low = F.lower(text)
    named = reduce(lambda x, y: x | y, [F.contains(low, F.lit(w)) for w in fixed.MARGIN_WORDS])
    scopes = chunks.select(*by).distinct().select(*by, F.lit(None).cast("string").alias(order), *[F.lit(None).cast("double").alias(n) for n in patterns])
    found = chunks.where(named).select(*by, F.col(order).cast("string").alias(order), *[figure(p).alias(n) for n, p in patterns.items()])
    f = found.unionByName(scopes).groupBy(*by).agg(*[first(n) for n in patterns])
    pct = lambda c: F.when((F.col("revenue") != 0) & (F.col(c) != 0), F.col(c) / F.col("revenue") * 100)
    return f.select(*by, pct("operating").alias("operating_margin"), pct("gross").alias("gross_margin"))


def key_metrics(chunks: DataFrame, by: list[str], order: str = "chunk_id", text: str = "raw_text") -> DataFrame:
    """First figure of each known metric per scope, in document order."""
    aggs = []
    for name, pattern in fixed.METRIC_PATTERNS.items():
        v = first_match(F.col(text), "(?i)" + pattern, 1)
        if name == "gross_margin":
            v = F.coalesce(v, first_match(F.col(text), "(?i)" + pattern, 2))
        aggs.append(F.min_by(v, F.when(v.isNotNull(), F.col(order))).alias(name))
    return chunks.groupBy(*by).agg(*aggs)


def segment_revenue(chunks: DataFrame, by: list[str], order: str = "chunk_id", text: str = "raw_text") -> DataFrame:
    """Segment names with their last stated revenue per scope."""
    p = "(?i)" + fixed.SEGMENT_REVENUE_PATTERN
    pairs = F.arrays_zip(find_all(F.col(text), p, 1).alias("name"), find_all(F.col(text), p, 2).alias("value"))
    rows = chunks.select(*by, order, F.posexplode(pairs).alias("pos", "p"))
    rows = rows.select(*by, F.struct(order, "pos").alias("at"), trim_ws(F.regexp_replace("p.name", r"\s+", " ")).alias("segment"), F.col("p.value").alias("value"))
    return rows.where(F.length("segment") < 80).groupBy(*by, "segment").agg(F.max_by("value", "at").alias("value"))


def metric_snippet(text: Column, metric: str) -> Column:
    import re

    found = F.regexp_extract(text, r"(?i)" + re.escape(metric) + r"[\s\S]{0,120}", 0)
    return F.substring(F.trim(F.regexp_replace(found, r"\s+", " ")), 1, 500)


ALIASES = {"AAPL": "APPLE", "MSFT": "MICROSOFT", "NVDA": "NVIDIA"}


def mentions_ticker(answer: Column, ticker: Column) -> Column:
    up = F.upper(answer)
    alias = reduce(lambda acc, kv: F.when(ticker == kv[0], kv[1]).otherwise(acc), ALIASES.items(), F.lit(None).cast("string"))
    return F.contains(up, ticker) | F.coalesce(F.contains(up, alias), F.lit(False))


def each_company(rows: DataFrame, companies: list[str]) -> DataFrame:
    """Rows of scope ALL once for each company, others as they are."""
    if not companies:
        return rows
    return rows.withColumn("ticker", F.explode(F.when(F.col("ticker") == "ALL", F.array(*[F.lit(c) for c in companies])).otherwise(F.array("ticker"))))


def presence_flags(answers: DataFrame, a: DataFrame, b: DataFrame, by: list[str], companies: list[str] | None = None) -> DataFrame:
    """Does either store hold anything for the scope? (distinct scopes only)
    With ``companies``, scope ALL has what any of them has."""
    both = a.select(*by, F.lit(True).alias("x"), F.lit(False).alias("y")).unionByName(b.select(*by, F.lit(False).alias("x"), F.lit(True).alias("y")))
    per = both.groupBy(*by).agg(F.bool_or("x").alias("in_a"), F.bool_or("y").alias("in_b"))
    if companies:
        rest = [c for c in by if c != "ticker"]
        every = per.where(F.col("ticker").isin(companies)).groupBy(*rest).agg(F.bool_or("in_a").alias("in_a"), F.bool_or("in_b").alias("in_b")).withColumn("ticker", F.lit("ALL"))
        per = per.where("ticker <> 'ALL'").unionByName(every)
    per = stored(per, "presence")  # a few rows: known as such when the join is planned
    return answers.join(per, by, "left").withColumns({"in_a": F.coalesce("in_a", F.lit(False)), "in_b": F.coalesce("in_b", F.lit(False))})


def grounding_status(answers: DataFrame, a: DataFrame, b: DataFrame, by: list[str], evidence_text: DataFrame | None = None, companies: list[str] = fixed.SUPPORTED_TICKERS) -> DataFrame:
    """PASS / PARTIAL / FAIL with the layer at fault, per answer.

    ``answers``: request_id, answer, query and ``by`` (ticker, fiscal_year). Scope ALL is
    checked against all ``companies``; a claim needs the figures of one of them."""
    texts = a if evidence_text is None else evidence_text
    # all that answers say, without their texts: read again for claims and answers, and all that is shuffled
    words = lambda c: F.lower(F.concat_ws(" ", c, F.col("query")))
    margin_of = lambda c: F.when(F.contains(words(c), F.lit("operating margin")), "operating").when(F.contains(words(c), F.lit("gross margin")), "gross")
    said = answers.select(
        "request_id", *by, (is_refusal(F.col("answer"), fixed.AUDIT_REFUSALS) | (F.trim("answer") == "")).alias("refused"), mentions_ticker(F.col("answer"), F.col("ticker")).alias("named"),
        F.transform(financial_claims(F.col("answer")), lambda c: F.struct(F.get(numeric_values(c), 0).alias("value"), margin_of(c).alias("margin"))).alias("said"))
    said = stored(said, "claims")
    claims = said.select("request_id", *by, F.posexplode("said").alias("claim_no", "c")).select("request_id", *by, "claim_no", "c.value", "c.margin")
    matched = claims_vs_evidence(each_company(claims, companies), evidence_numbers(texts, by), by)
    m = matched.join(stored(derived_margin(texts, by), "margins"), by, "left")
    derived = F.when(F.col("margin") == "operating", F.col("operating_margin")).when(F.col("margin") == "gross", F.col("gross_margin"))
    ok = F.col("matched") | F.coalesce(close_to(F.col("value"), derived), F.lit(False))
    # one shuffle for both groupings
    claim = m.select("request_id", "claim_no", ok.alias("ok")).repartition("request_id").groupBy("request_id", "claim_no").agg(F.bool_or("ok").alias("ok"))
    per = claim.groupBy("request_id").agg(F.count(F.lit(1)).alias("claims"), F.count_if("ok").alias("supported"))
    j = presence_flags(said.drop("said"), a, b, by, companies).join(per, "request_id", "left")
    refused = F.col("refused")
    everything = F.col("ticker") == "ALL"
    ratio = F.col("supported") / F.col("claims")
    hi, lo = F.when(everything, 0.5).otherwise(0.8), F.when(everything, 0.3).otherwise(0.5)
    case = (F.when(refused & ~F.col("in_a") & ~F.col("in_b"), "PASS|")
            .when(refused & F.col("in_a") & ~F.col("in_b"), "FAIL|Vector Retrieval").when(refused & ~F.col("in_a"), "FAIL|Context Assembly").when(refused, "FAIL|Generation")
            .when(~everything & ~F.col("named"), "FAIL|Generation").when(F.col("claims").isNull(), "PARTIAL|Generation")
            .when(ratio >= hi, "PASS|").when(ratio >= lo, "PARTIAL|Retrieval").otherwise("FAIL|Retrieval"))
    return j.select("request_id", F.split(case, r"\|")[0].alias("status"), F.split(case, r"\|")[1].alias("layer"),
                    F.coalesce("claims", F.lit(0)).alias("claims"), F.coalesce("supported", F.lit(0)).alias("supported"))


GRAMS = (1, 2, 3, 6)
#: beginnings of terms up to which words are looked through for them
TERM_STARTS = 4096


def _anchor(term: Column) -> Column:
    n = F.length(term)
    return F.when(n >= 6, F.substring(term, 1, 6)).when(n >= 3, F.substring(term, 1, 3)).otherwise(term)


def _any_of(starts: list[str]) -> str:
    """A pattern for any of some literal strings, grouped by their letters."""
    import re

    rests: dict[str, set[str]] = {}
    for s in starts:
        rests.setdefault(s[0], set()).add(s[1:])
    return "|".join(re.escape(c) + ("" if "" in rest else f"(?:{_any_of(sorted(rest))})") for c, rest in sorted(rests.items()))


def terms_in_text(terms: DataFrame, chunks: DataFrame, by: list[str], text: str = "raw_text") -> DataFrame:
    """Distinct (by, term) that occur as substring in any text of the scope.

    A term holds no blanks, so it lies inside one blank-separated word. Words
    meet terms on the term's leading letters, never every word with every term. Scopes that
    no term asks for, and words without the first three letters of any term, are left out before."""
    t = terms.select(*by, "term").distinct().withColumn("gram", _anchor(F.col("term")))
    asked = chunks.join(t.select(*by).distinct(), by, "left_semi")
    words = asked.select(*by, F.explode(F.array_distinct(F.split(F.lower(text), r"\s+"))).alias("word")).where("word <> ''")
    starts = t.where("gram <> ''").select(F.substring("gram", 1, 3).alias("s")).distinct()
    starts = [r.s for r in starts.limit(TERM_STARTS + 1).collect()]  # bounded; with more, all words stay
    if starts and len(starts) <= TERM_STARTS:
        words = words.where(F.col("word").rlike(_any_of(starts)))
    words = words.distinct()
    at = lambda n: F.when(F.length("word") >= n, F.transform(
        F.sequence(F.lit(1), F.length("word") - n + 1), lambda i: F.substring(F.col("word"), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    grams = words.select(*by, "word", F.explode(F.array_distinct(F.flatten(F.array(*[at(n) for n in GRAMS])))).alias("gram"))
    grams = grams.join(t.select(*by, "gram").distinct(), [*by, "gram"], "left_semi")
    exact = t.where("term = gram").join(grams.select(*by, "gram").distinct(), [*by, "gram"], "left_semi")
    g = grams.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("gram").alias("_gram"), "word")
    cond = reduce(lambda x, y: x & y, [F.col(c) == F.col(f"_{c}") for c in by], F.col("gram") == F.col("_gram")) & F.contains("word", "term")
    longer = t.where("term <> gram").join(g, cond, "left_semi")
    return exact.select(*by, "term").unionByName(longer.select(*by, "term"))


def grounding_class(answers: DataFrame, a: DataFrame, b: DataFrame, by: list[str], companies: list[str] = fixed.SUPPORTED_TICKERS) -> DataFrame:
    """Grounding label from the leading three terms of each claim; scope ALL over all ``companies``."""
    claims = each_company(claim_rows(answers, ["request_id", *by]), companies)
    plain = F.translate(F.lower("claim"), "$,", "")
    terms = F.slice(F.filter(F.split(plain, r"\s+"), lambda x: x != ""), 1, 3)
    c = claims.select("request_id", *by, "claim_no", F.explode_outer(terms).alias("term"))
    found = terms_in_text(c.where("term is not null"), a, by).withColumn("_f", F.lit(True))
    hit = c.join(found, [*by, "term"], "left").groupBy("request_id", "claim_no").agg(F.coalesce(F.bool_or("_f"), F.lit(False)).alias("ok"))
    per = hit.groupBy("request_id").agg(F.count(F.lit(1)).alias("claims"), F.count_if("ok").alias("supported"))
    j = presence_flags(answers, a, b, by, companies).join(per, "request_id", "left")
    refused = F.contains(F.lower(F.coalesce("answer", F.lit(""))), F.lit("not available")) | (F.coalesce("answer", F.lit("")) == "")
    ratio = F.col("supported") / F.col("claims")
    label = (F.when(refused & ~F.col("in_a") & ~F.col("in_b"), "CORRECT_REFUSAL").when(refused & ~F.col("in_a"), "CONTEXT_ASSEMBLY_FAILURE").when(refused, "RETRIEVAL_FAILURE")
             .when(F.col("claims").isNull(), "PARTIALLY_GROUNDED").when(ratio >= 0.8, "FULLY_GROUNDED").when(ratio > 0, "PARTIALLY_GROUNDED").otherwise("UNGROUNDED"))
    return j.select("request_id", label.alias("label"))


def number_to_chunks(targets: DataFrame, chunks: DataFrame, text: str = "raw_text") -> DataFrame:
    """Where each wanted figure stands: chunk and first offset (from 0). Figures
    are compared without grouping commas."""
    t = targets.select("number").distinct()
    found = chunks.select("chunk_id", F.explode(F.array_distinct(find_all(F.col(text), fixed.NUMERIC_TOKEN))).alias("token"), F.col(text).alias("_t"))
    found = found.select("chunk_id", F.replace("token", F.lit(","), F.lit("")).alias("number"), (F.expr("instr(_t, token)") - 1).alias("at"))
    return found.join(t, "number").groupBy("number", "chunk_id").agg(F.min("at").alias("offset"))
