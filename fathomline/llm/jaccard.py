"""Grouped prefix join: pairs of documents whose shingle sets are alike.

A document is the set of its distinct runs of five words; two link when their sets
share 80 % of their union. In one fixed order of all shingles, linked documents
share a shingle among their first ``n - ceil(0.8 n) + 1``, and with a prefix longer
by ``e`` they share ``1 + e`` of it. Shingles of many documents stand last in that
order, the rest is ordered by hash; and of the longer prefix each document drops as
many shingles as it can spare, those that most documents hold. So passages which
documents share do not bring them together.

1. A pass counts shingles inside tasks and names the frequent ones (at least
   ``OFTEN`` of the documents; so many at most that the list stays small).
2. Documents with the same set collapse to one representative, representatives
   with identical prefix and size to one group. Shingles of one group leave, and of
   the others those that their groups can spare.
3. A shingle's pivot is the group that shares most of its prefix. Every group is
   paired with the pivot that it meets most often; size bounds filter group pairs,
   which expand to members and are verified by their sets. Links give components.
4. Where a shingle or a group still joins several components, all pairs across
   components are verified too. No pair inside a component needs to be looked at.
   A pair meets at its first shared shingles only, not at each of them.

So each candidate pair is either verified or already connected, and components are
those of all links. Pairs are verified in stars around one document, split so that
a star of any size is dealt over tasks.

Documents without words have an empty set and link with nothing. Null ids count as
larger than all others. Rows that repeat an id are one document in several texts:
it links where any of them does. Only id and text are read; empty tables give empty
results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow import blocks, written
from .components import components
from .words import Words, mix

SHINGLE = 5
PERCENT = 80
#: share of the documents from which on a shingle is frequent
OFTEN = 0.0005
#: shingles that a task counts at once; those seen three times among so many are reported
COUNTED = 4_000_000
STAR = 256
#: shingles before its own that a row knows, so that two documents do not meet at every shingle they share
RECENT = 8
#: part of a set by which its prefix is longer than needed, in hundredths
LONGER = 5
LAST = (1 << 63) - 1
_U = np.uint64


def shingle_sets(texts: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, one after the other, and where each text's begin."""
    w = Words(texts, lower=True)
    g, ok = w.grams(n), w.starts(n)
    few = np.flatnonzero((w.count > 0) & (w.count < n))
    whole = np.zeros(len(few), np.uint64)
    for k in range(n - 1):
        has = w.count[few] > k
        at = w.begin[:-1][few[has]] + k
        whole[has] = mix(whole[has] + w.hash[at] + _U(k + 1))
    doc = np.concatenate([w.doc[:len(g)][ok], few])
    value = np.concatenate([g[ok], whole])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[new], value[new]
    return value, np.searchsorted(doc, np.arange(len(texts) + 1))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = np.empty(COUNTED, np.uint64), 0

    def emit() -> pa.RecordBatch:
        value = held[:size]
        value.sort()
        first = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if size else np.zeros(0, np.int64)
        n = np.diff(np.append(first, size))
        return pa.RecordBatch.from_arrays([pa.array(value[first[n >= 3]].view(np.int64)), pa.array(n[n >= 3])], ["shingle", "n"])

    for b in blocks(batches, "text"):
        value, _ = shingle_sets(b.column("text"))
        while len(value):
            some = value[:COUNTED - size]
            held[size:size + len(some)] = some
            size, value = size + len(some), value[len(some):]
            if size == COUNTED:
                yield emit()
                size = 0
    yield emit()


def frequent(docs: DataFrame) -> np.ndarray:
    """Shingles of many documents, the rarest first. At most the sum of set sizes
    over OFTEN / 2 times the documents: a bound by the mean length of a text alone."""
    total = docs.count()
    rows = docs.select("text").mapInArrow(_counted, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    found = rows.where(F.col("n") >= max(3.0, OFTEN / 2 * total)).collect()
    return np.array([r.shingle for r in sorted(found, key=lambda r: (r.n, r.shingle))], dtype=np.int64).view(np.uint64)


def _profiles(often: np.ndarray):
    """Size, set key, group key and prefix of each text. Within a batch equal sets carry one prefix."""
    by_value = np.argsort(often)
    ranked = often[by_value]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            value, begin = shingle_sets(b.column("text"))
            n = np.diff(begin)
            doc = np.repeat(np.arange(len(n)), n)
            cum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(value))])
            key = mix(cum[begin[1:]] - cum[begin[:-1]] + n.astype(np.uint64))
            cum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(value ^ _U(0x5851F42D4C957F2D)))])
            key2 = cum[begin[1:]] - cum[begin[:-1]]
            place = np.zeros(len(value), dtype=np.int64)
            if len(ranked):
                at = np.minimum(np.searchsorted(ranked, value), len(ranked) - 1)
                known = ranked[at] == value
                place[known] = by_value[at[known]] + 1
            order = np.lexsort((value, place, doc))
            value, place = value[order], place[order]
            rank = np.arange(len(value)) - np.repeat(begin[:-1], n)
            length = np.where(n > 0, np.minimum(n, n - (PERCENT * n + 99) // 100 + 1 + LONGER * n // 100), 0)
            inside = rank < np.repeat(length, n)
            first = np.concatenate([[0], np.cumsum(length)])
            prefix, heavy = value[inside], place[inside] > 0
            cum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(prefix))])
            group = mix(cum[first[1:]] - cum[first[:-1]] + mix(n.astype(np.uint64))).view(np.int64)
            # where the prefix ends in the order of all shingles
            at = np.maximum(first[1:] - 1, 0)
            ranks = np.where(place > 0, (1 << 62) + place, (value >> _U(2)).astype(np.int64))[inside]
            end = np.where(length > 0, ranks[at], 0) if len(ranks) else np.zeros(len(n), np.int64)
            _, once = np.unique(np.stack([key, key2]), axis=1, return_index=True)
            shown = np.zeros(len(n), dtype=bool)
            shown[once] = True
            lists = []
            for keep in (~heavy, heavy):
                own = keep & np.repeat(shown, length)
                sizes = np.add.reduceat(np.append(own, 0), first[:-1]) * (length > 0) if len(length) else length
                lists.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(prefix[own].view(np.int64))))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n.astype(np.int64)), pa.array(key.view(np.int64)), pa.array(key2.view(np.int64)), pa.array(group), pa.array(end), *lists], ["id", "n", "key", "key2", "group_key", "end", "light", "heavy"])

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of their token whose token the row before or behind has too."""
    last, sent = None, True  # the last row, and whether it went out
    for b in batches:
        if not b.num_rows:
            continue
        token = b.column("token").to_numpy()
        same = token[1:] == token[:-1]
        keep = np.append(False, same) | np.append(same, False)
        if last is not None and last.column("token")[0].as_py() == int(token[0]):
            keep[0] = True
            if not sent:
                yield last
        yield b.filter(pa.array(keep))
        last, sent = b.slice(b.num_rows - 1), bool(keep[-1])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=3).compress
    for b in blocks(batches, "text"):
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([squeeze((t or "").encode()) for t in b.column("text").to_pylist()], pa.binary())], ["id", "body"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of stars, which arrive star by star, their centre first, against the centre."""
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    star, centre = None, []
    for b in blocks(batches, "body", 1 << 20):
        value, begin = shingle_sets(pa.array([expand(x).decode() for x in b.column("body").to_pylist()], pa.string()))
        a, salt, ident = (b.column(c).to_pylist() for c in ("a", "salt", "id"))
        links = []
        for i in range(b.num_rows):
            own = value[begin[i]:begin[i + 1]]
            if star != (a[i], salt[i]):
                star, centre = (a[i], salt[i]), []
            if ident[i] == a[i]:
                centre.append(own.copy())
            elif any(alike(c, own) for c in centre):
                links.append((a[i], ident[i]))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([x for _, x in links], pa.int64())], ["a", "b"])


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    if not len(x) or not len(y) or 100 * min(len(x), len(y)) < PERCENT * max(len(x), len(y)):
        return False
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    both = int((x[at] == y).sum())
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def verified(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) of ids whose sets are alike, by their texts."""
    sizes = pairs.groupBy("a").count().select("a", F.ceil(F.col("count") / STAR).cast("int").alias("parts"))
    members = pairs.join(sizes, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("salt"), F.col("b").alias("id"))
    centres = sizes.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.col("a").alias("id"))
    stars = members.unionByName(centres).join(bodies, "id").select("a", "salt", "id", "body", (F.col("id") != F.col("a")).alias("member"))
    return stars.repartition("a", "salt").sortWithinPartitions("a", "salt", "member").drop("member").mapInArrow(_verified, "a long, b long")


def _prefix(n: Column) -> Column:
    return F.least(n, n - F.ceil(n * PERCENT / 100) + 1 + F.floor(n * LONGER / 100))


def _spare(n: Column) -> Column:
    """How many of its shared shingles a document can drop: partners have at least PERCENT of its size."""
    return F.floor(F.ceil(n * PERCENT / 100) * LONGER / 100)


def _earlier(x: Column, y: Column) -> Column:
    """The value of the side whose prefix ends first; the larger where both end alike."""
    return F.when(F.col("end") < F.col("end_m"), x).when(F.col("end") > F.col("end_m"), y).otherwise(F.greatest(x, y))


def _fits() -> Column:
    """Sizes that can link, and enough left to share: all of the prefix that ends first
    would stand in the other prefix."""
    n, m = F.col("n"), F.col("m")
    return (F.least(n, m) * 100 >= F.greatest(n, m) * PERCENT) & (_earlier(F.col("most"), F.col("most_m")) * (100 + PERCENT) >= (n + m) * PERCENT)


def _can_be_first() -> Column:
    """Whether a shared shingle can be the first that both documents of a link kept: all
    others that they share lie behind it in both or were dropped before it. One document
    drops all common shingles that the other does, or the other way round, since both
    drop by the same order."""
    return _enough_left(*[F.col(c) for c in ("place", "before", "place_m", "before_m")])


def _enough_left(place: Column, before: Column, place_m: Column, before_m: Column) -> Column:
    n, m = F.col("n"), F.col("m")
    return (F.greatest(before, before_m) + F.least(n - place, m - place_m)) * (100 + PERCENT) >= (n + m) * PERCENT


def _met_before() -> Column:
    """Whether the two have met already: at one of the last shingles before this one in
    both, which could be the first as well. Of shingles in a row that join the same two,
    only those too far apart to know of each other bring them together again."""
    return F.exists("recent", lambda x: F.exists("recent_m", lambda y: (x["token"] == y["token"]) & _enough_left(x["place"], x["before"], y["place"], y["before"])))


def meetings(spread: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that share a shingle and may be alike; few pairs stand there more than once."""
    open_ = spread.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("token")
    behind = Window.partitionBy("gid", "rep", "n", "end").orderBy("place", "token").rowsBetween(-RECENT, -1)
    across = spread.join(open_, "token", "left_semi").withColumn("recent", F.collect_list(F.struct("token", "place", "before")).over(behind)).drop("gid").withColumnRenamed("rep", "a")
    other = across.select("token", F.col("a").alias("b"), F.col("n").alias("m"), *[F.col(c).alias(f"{c}_m") for c in ("end", "place", "before", "most", "recent")], F.col("component").alias("d"))
    met = across.join(other, "token").where((F.col("a") < F.col("b")) & (F.col("component") != F.col("d")) & _fits() & _can_be_first() & ~_met_before())
    return met.select("a", "b")


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_shingles and component_id (the least id reachable by links) of every row."""
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("id"), F.col(text).alias("text"))
    # light shingles, the bulk, are made where they are dealt, not stored
    profiles = rows.mapInArrow(_profiles(frequent(rows)), "id long, n long, key long, key2 long, group_key long, end long, light array<long>, heavy array<long>")
    bulk = profiles.select("id", F.posexplode("light").alias("place", "token"))
    profiles = written(profiles.withColumn("ahead", F.size("light")).drop("light"), "profiles")
    sets = profiles.select("id", "n", "key", "key2", "group_key", "end")
    rep = sets.groupBy("key", "key2", "n").agg(F.min("id").alias("rep"))
    known = written(sets.join(rep, ["key", "key2", "n"]).select("id", "n", "rep", "group_key", "end"), "sets")
    groups = known.where("n > 0").groupBy("group_key", "n", "end").agg(F.min("rep").alias("gid"))
    members = written(known.where("n > 0").select("group_key", "n", "end", "rep").distinct().join(groups, ["group_key", "n", "end"]).select("gid", "rep", "n", "end"), "members")

    # shingles of the prefixes with their place in the order of all
    light = bulk.repartition("token").sortWithinPartitions("token")
    heavy = profiles.select("id", "ahead", F.posexplode("heavy").alias("place", "token"))
    tokens = light.select("token", "id", "place").mapInArrow(_repeated, "token long, id long, place int").unionByName(heavy.select("token", "id", (F.col("ahead") + F.col("place")).alias("place")))
    ids = known.where("n > 0").select("id", "rep", "n", "end").join(members, ["rep", "n", "end"]).select("id", "gid", "n", "end").distinct()
    shared = tokens.join(ids, "id").select("token", "gid", "n", "end", "place").distinct()
    held = shared.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    own = Window.partitionBy("gid", "n", "end")
    ranked = shared.join(held, "token").withColumn("rank", F.row_number().over(own.orderBy(F.desc("df"), F.desc("token")))).withColumn("met", F.count("*").over(own))
    dropped = F.col("rank") <= _spare(F.col("n"))
    ranked = ranked.withColumn("before", F.sum(dropped.cast("int")).over(own.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)))
    # without the shingles of the prefix that no other prefix has: the most that a partner whose prefix ends later can share
    most = F.col("n") - F.greatest(_prefix(F.col("n")) - F.col("met"), F.lit(0))
    kept = ranked.where(~dropped).select("token", "gid", "n", "end", "place", "before", most.alias("most"), (F.col("met") / F.col("n")).alias("weight"))
    buckets = written(kept, "buckets")

    # groups against the pivot that they meet most often, members of one group against its least
    best = buckets.groupBy("token").agg(F.max(F.struct("weight", (-F.col("gid")).alias("minus"), "n", "end", "most")).alias("best"))
    near = buckets.join(best.select("token", (-F.col("best.minus")).alias("pivot"), F.col("best.n").alias("m"), F.col("best.end").alias("end_m"), F.col("best.most").alias("most_m")), "token")
    met = near.where((F.col("gid") != F.col("pivot")) & _fits()).groupBy("gid", "pivot").count()
    group_pairs = met.groupBy("gid").agg(F.max_by("pivot", F.struct("count", "pivot")).alias("pivot")).select(*_ordered("gid", "pivot")).distinct()
    first, second = members.select(F.col("gid").alias("a"), F.col("rep").alias("ra")), members.select(F.col("gid").alias("b"), F.col("rep").alias("rb"))
    pairs = group_pairs.join(first, "a").join(second, "b").select(*_ordered("ra", "rb"))
    inside = members.where("rep <> gid").select(*_ordered("gid", "rep"))
    pairs = written(pairs.unionByName(inside).where("a <> b").distinct(), "pairs")

    texts = buckets.select("gid").distinct().join(members, "gid").select(F.col("rep").alias("id")).unionByName(members.where("rep <> gid").select(F.explode(F.array("gid", "rep")).alias("id"))).distinct()
    bodies = written(rows.where("text IS NOT NULL").mapInArrow(_packed, "id long, body binary").join(texts, "id"), "bodies")
    links = written(verified(pairs, bodies), "links")
    # texts under one id belong together
    several = known.where("n > 0").select("id", "rep").distinct().withColumn("a", F.min("rep").over(Window.partitionBy("id"))).where("a <> rep").select("a", F.col("rep").alias("b"))
    links = links.unionByName(several)
    so_far = components(links)

    # what is left: pairs across components
    labelled = members.join(so_far.select(F.col("node").alias("rep"), "component"), "rep", "left").select("gid", "rep", F.coalesce("component", "rep").alias("component"))
    rest = meetings(buckets.join(labelled, "gid").select("token", "gid", "rep", "n", "end", "place", "before", "most", "component")).distinct()
    # members of one group: its prefix and size say nothing more, so all across components
    many = labelled.groupBy("gid").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("gid")
    mixed = labelled.join(many, "gid", "left_semi").withColumnRenamed("rep", "a")
    inside = mixed.join(mixed.select("gid", F.col("a").alias("b"), F.col("component").alias("d")), "gid").where((F.col("a") < F.col("b")) & (F.col("component") != F.col("d"))).select("a", "b")
    rest = written(rest.unionByName(inside).distinct().join(pairs, ["a", "b"], "left_anti"), "pairs")
    links = links.unionByName(written(verified(rest, bodies), "links"))
    labels = components(links).select(F.col("node").alias("rep"), "component")
    done = known.join(labels, "rep", "left").select("id", "n", F.when(F.col("n") > 0, F.coalesce("component", "rep")).otherwise(F.col("id")).alias("component"))
    null = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return done.select(null("id").alias(key), F.col("n").alias("n_shingles"), null("component").alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` that are the least of their component; rows that repeat an id stay together."""
    name = "kept"
    while name in docs.columns:
        name += "_"
    kept = classes(docs, key, text).where(F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(key).alias(name)).distinct()
    return docs.join(kept, F.col(key).eqNullSafe(F.col(name)), "left_semi")
