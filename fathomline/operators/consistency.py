"""Set algebra between the chunk table (A) and the vector table (B).

Inputs carry chunk_id, ticker, fiscal_year, doc_type, source_id and ``seq`` (the
write order). Nothing here changes a store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from .stores import is_keyed, latest

META = ["ticker", "fiscal_year", "doc_type"]
KEY = ["p_ticker", "p_year", "p_type"]


def _norm(c: Column) -> Column:
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def provenance_key() -> list[Column]:
    return [F.coalesce(F.upper(_norm(F.col("ticker"))), F.lit("")).alias("p_ticker"), F.coalesce(_norm(F.col("fiscal_year")), F.lit("")).alias("p_year"),
            F.coalesce(F.upper(_norm(F.col("doc_type"))), F.lit("")).alias("p_type")]


def indexed(store: DataFrame) -> DataFrame:
    """One row per non-empty key, the last written one."""
    return latest(store.where(_norm(F.col("chunk_id")).isNotNull()), ["chunk_id"], "seq")


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer join of both indexes: chunk_id, struct a, struct b."""
    side = lambda df, n: indexed(df).select("chunk_id", F.struct(*META, "source_id").alias(n))
    return side(a, "a").join(side(b, "b"), "chunk_id", "full_outer")


def presence(a: DataFrame, b: DataFrame) -> DataFrame:
    """Status per key: paired, a_only, b_only."""
    status = F.when(F.col("a").isNull(), "b_only").when(F.col("b").isNull(), "a_only").otherwise("paired")
    return paired(a, b).select("chunk_id", status.alias("status"))


def reconcile_presence(a: DataFrame, b: DataFrame) -> DataFrame:
    """Counts per category, with rows lacking a key and rows beyond the first
    of a repeated key."""
    counted = presence(a, b).groupBy(F.col("status").alias("category")).agg(F.count(F.lit(1)).alias("n"))

    def anomalies(df: DataFrame, side: str) -> DataFrame:
        per = df.groupBy(_norm(F.col("chunk_id")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        both = per.agg(F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("n"))), F.lit(0)).alias("missing"),
                       F.coalesce(F.sum(F.when(F.col("k").isNotNull(), F.col("n") - 1)), F.lit(0)).alias("dup"))
        cases = F.array(F.struct(F.lit(f"{side}_missing_key").alias("category"), F.col("missing").alias("n")),
                        F.struct(F.lit(f"{side}_duplicate_key").alias("category"), F.col("dup").alias("n")))
        return both.select(F.explode(cases).alias("r")).select("r.category", "r.n")

    return counted.unionByName(anomalies(a, "a")).unionByName(anomalies(b, "b"))


def reconcile_identity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keyed and legacy rows per store."""
    both = indexed(a).select("source_id", F.lit("a").alias("store")).unionByName(indexed(b).select("source_id", F.lit("b").alias("store")))
    keyed = is_keyed(F.col("source_id"))
    return both.groupBy("store").agg(F.count_if(keyed).alias("keyed"), F.count_if(~keyed | keyed.isNull()).alias("legacy"))


def source_metadata_conflicts(a: DataFrame) -> DataFrame:
    """Identities that carry more than one (ticker, year, form)."""
    keyed = indexed(a).where(is_keyed(F.col("source_id"))).select(F.trim("source_id").alias("source_id"), *provenance_key()).distinct()
    per = keyed.groupBy("source_id").agg(F.count(F.lit(1)).alias("variants"), F.array_sort(F.collect_set(F.concat_ws("|", *KEY))).alias("keys"))
    return per.where("variants > 1")


def source_id_mismatch(a: DataFrame, b: DataFrame) -> DataFrame:
    """Paired keys whose stores name different filings."""
    sa, sb = _norm(F.col("a.source_id")), _norm(F.col("b.source_id"))
    return paired(a, b).where(F.col("a").isNotNull() & F.col("b").isNotNull() & (sa != sb)).select("chunk_id", sa.alias("a_source_id"), sb.alias("b_source_id"))


def normalize_provenance(rows: DataFrame) -> DataFrame:
    """Provenance rows -> key with its distinct identities."""
    r = rows.select(*provenance_key(), _norm(F.col("source_id")).alias("sid")).where("sid is not null").distinct()
    return r.groupBy(*KEY).agg(F.count(F.lit(1)).alias("candidates"), F.min("sid").alias("source_id"))


def backfill_assessment(a: DataFrame, b: DataFrame, provenance: DataFrame) -> DataFrame:
    """Per legacy row of either store: confirmed by the other store or by a
    unique provenance entry, ambiguous, or uncertain with its reason."""
    p = paired(a, b)
    stores = F.explode(F.array(
        F.struct(F.lit("a").alias("store"), F.col("a").alias("own"), F.col("b.source_id").alias("other")),
        F.struct(F.lit("b").alias("store"), F.col("b").alias("own"), F.col("a.source_id").alias("other")))).alias("s")
    legacy = p.select("chunk_id", stores).select("chunk_id", "s.store", "s.own", "s.other", *[F.col(f"s.own.{m}").alias(m) for m in META]).where(
        F.col("own").isNotNull() & ~F.coalesce(is_keyed(F.col("own.source_id")), F.lit(False)))
    prov = normalize_provenance(provenance)
    j = legacy.select("chunk_id", "store", "other", *META, *provenance_key()).join(prov, KEY, "left")
    complete = F.lit(True)
    for m in META:
        complete = complete & F.coalesce(_norm(F.col(m)) != fixed.UNKNOWN, F.lit(False))
    other = F.coalesce(is_keyed(F.col("other")), F.lit(False))
    status = (F.when(other, "confirmed").when(~complete, "uncertain").when(F.col("candidates").isNull(), "uncertain")
              .when(F.col("candidates") == 1, "confirmed").otherwise("ambiguous"))
    reason = (F.when(other, "other_store_keyed").when(~complete, "incomplete_metadata").when(F.col("candidates").isNull(), "no_provenance")
              .when(F.col("candidates") == 1, "provenance_map").otherwise("ambiguous_provenance"))
    sid = F.when(other, F.trim("other")).when(status == "confirmed", F.col("source_id"))
    return j.select("chunk_id", "store", status.alias("status"), reason.alias("reason"), sid.alias("source_id"))


ACTIONS = [("confirmed", "REVIEW"), ("uncertain", "ESCALATE"), ("ambiguous", "ESCALATE"), ("a_only", "INVESTIGATE"), ("b_only", "INVESTIGATE"),
           ("metadata_conflict", "INVESTIGATE"), ("source_id_mismatch", "INVESTIGATE")]


def proposed_actions(a: DataFrame, b: DataFrame, provenance: DataFrame) -> DataFrame:
    """Actions for the non-empty categories; a single 'none' row otherwise."""
    count = F.count(F.lit(1)).alias("n")
    counts = (
        backfill_assessment(a, b, provenance).groupBy(F.col("status").alias("category")).agg(count)
        .unionByName(presence(a, b).where("status <> 'paired'").groupBy(F.col("status").alias("category")).agg(count))
        .unionByName(source_metadata_conflicts(a).agg(count).select(F.lit("metadata_conflict").alias("category"), "n"))
        .unionByName(source_id_mismatch(a, b).agg(count).select(F.lit("source_id_mismatch").alias("category"), "n"))
    ).where("n > 0")
    action = F.create_map(*[F.lit(x) for kv in ACTIONS for x in kv])[F.col("category")]
    named = counts.select(action.alias("action"), "category", "n")
    none = named.agg(count).where("n = 0").select(F.lit("NONE").alias("action"), F.lit("no_anomalies").alias("category"), "n")
    return named.unionByName(none)


def store_parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Row counts of both stores: ok(n) or drift(difference)."""
    both = a.select(F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(F.lit(0).alias("a"), F.lit(1).alias("b")))
    n = both.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("a_rows"), F.coalesce(F.sum("b"), F.lit(0)).alias("b_rows"))
    same = F.col("a_rows") == F.col("b_rows")
    text = F.when(same, F.concat(F.lit("ok("), F.col("a_rows").cast("string"), F.lit(")"))).otherwise(
        F.concat(F.lit("drift("), (F.col("a_rows") - F.col("b_rows")).cast("string"), F.lit(")")))
    return n.select("a_rows", "b_rows", text.alias("parity"))


# --- replacing filings -------------------------------------------------------
def metadata_conflict_gate(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Per incoming filing: accepted unless a stored, well-formed field differs
    from the incoming one. Stored values are reduced per filing first."""
    meta = incoming.groupBy("source_id").agg(F.min_by(F.struct(*META), "chunk_id").alias("m"))
    stored = existing.where(is_keyed(F.col("source_id"))).select("source_id", F.struct(*META).alias("s")).distinct()
    clash = F.lit(False)
    for c in META:
        have = F.col(f"s.{c}")
        well = F.coalesce(~F.trim(have).isin("", fixed.UNKNOWN), F.lit(False))
        clash = clash | (well & ~have.eqNullSafe(F.col(f"m.{c}")))
    j = meta.join(stored, "source_id", "left")
    return j.groupBy("source_id").agg(F.bool_or(F.col("s").isNotNull() & clash).alias("conflict"))


def incoming_checks(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Verdict per incoming filing: accept, or why it is refused."""
    per = incoming.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.count_distinct("chunk_id").alias("ids"), F.count("embedding").alias("vectors"))
    j = per.join(metadata_conflict_gate(existing, incoming), "source_id", "left")
    verdict = (F.when(~F.coalesce(is_keyed(F.col("source_id")), F.lit(False)), "bad_identity").when(F.col("vectors") != F.col("chunks"), "vector_count")
               .when(F.col("ids") != F.col("chunks"), "duplicate_ids").when(F.col("conflict"), "metadata_conflict").otherwise("accept"))
    return j.select("source_id", "chunks", verdict.alias("verdict"))


def stale_ids(existing: DataFrame, expected: DataFrame) -> DataFrame:
    """Per filing to be replaced: expected, stale (to delete), missing, and
    whether the stored set already equals the expected one."""
    e = expected.select("source_id", "chunk_id").distinct().withColumn("want", F.lit(1))
    have = existing.where(is_keyed(F.col("source_id"))).select("source_id", "chunk_id").distinct().join(
        e.select("source_id").distinct(), "source_id", "left_semi").withColumn("have", F.lit(1))
    j = e.join(have, ["source_id", "chunk_id"], "full_outer")
    stale, missing = F.count_if(F.col("want").isNull()), F.count_if(F.col("have").isNull())
    return j.groupBy("source_id").agg(F.count("want").alias("expected"), stale.alias("stale"), missing.alias("missing"),
                                      ((stale == 0) & (missing == 0)).alias("converged"))


def replace_sources(existing_a: DataFrame, existing_b: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Replace whole filings in both stores: (new A, new B, report per filing).

    Refused filings leave both stores as they are. Rows without identity are
    never removed."""
    from .stores import delete_stale, upsert

    checks = incoming_checks(existing_a, incoming)
    ok = checks.where("verdict = 'accept'").select("source_id")
    accepted = incoming.join(ok, "source_id", "left_semi")
    keys = ["source_id", "chunk_id"]

    def replaced(existing: DataFrame, cols: list[str]) -> DataFrame:
        new = accepted.select(*cols)
        stale = existing.join(ok, "source_id", "left_semi").join(new, keys, "left_anti").select(*keys)
        keyed = existing.where(is_keyed(F.col("source_id")))
        rest = existing.where(~F.coalesce(is_keyed(F.col("source_id")), F.lit(False)))
        merged = upsert(delete_stale(keyed, stale), new, keys).drop("_inserted", "_written")
        return merged.unionByName(rest, allowMissingColumns=True)

    new_a = replaced(existing_a, [c for c in existing_a.columns if c in incoming.columns])
    new_b = replaced(existing_b, [c for c in existing_b.columns if c in incoming.columns])
    before = stale_ids(existing_a, accepted).select("source_id", F.col("stale").alias("removed_a"))
    before_b = stale_ids(existing_b, accepted).select("source_id", F.col("stale").alias("removed_b"))
    after = stale_ids(new_a, accepted).select("source_id", "expected", F.col("converged").alias("ca")).join(
        stale_ids(new_b, accepted).select("source_id", F.col("converged").alias("cb")), "source_id")
    report = checks.join(before, "source_id", "left").join(before_b, "source_id", "left").join(after, "source_id", "left").select(
        "source_id", "verdict", "chunks", F.coalesce("removed_a", F.lit(0)).alias("removed_a"), F.coalesce("removed_b", F.lit(0)).alias("removed_b"),
        F.coalesce(F.col("ca") & F.col("cb"), F.lit(False)).alias("converged"))
    return new_a, new_b, report
