"""Exact Jaccard join of documents on word shingles, by prefixes under several global token orders.

A document's set is its distinct shingles, as 64-bit hashes. Under any order of all shingles, two sets with a Jaccard
similarity of at least t share one of their first n - ceil(t n) + 1 members, and the first member they share has so
few before it in either set that the rest can hold the overlap that t asks for. The first order puts shingles that a
corpus-wide count sketch marks as frequent last and follows a hash otherwise; every set's prefix under it is posted.

Links are wanted up to connectivity, so a frequent member does not give all pairs of its sets. First, in some rounds,
every set is compared with one leader only, which it shares members with; the links found make components. What is
left are pairs between different components. Sets that share a good part of their prefix with other components are the
crowd: two of them must also share a prefix member under a second order, the exact frequency among the crowd, which
puts what sets have to themselves first. Any other pair is named by its first shared member under the first order, and
can only be of two sizes for which the few members that the less crowded set shares are enough. Only pairs that pass
are fetched; they must share prefix members under two further hash orders, and then whole sets are compared. So no link
between different texts is lost. Sets that are equal are one set throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._shared import discard, materialise, release, trim_worker
from .components import components

SLICE_BYTES = 500_000
#: Counters of the sketch; each task sends one such array.
SKETCH = 1 << 18
#: Sets whose ids are this few are looked up by broadcast, more by shuffling.
MAX_BROADCAST_IDS = 500_000
#: Rounds of comparing every set with one leader before all pairs between components are looked at.
LEADER_ROUNDS = 3
#: Sets that share so many hundredths of their prefix with other components go by the second order among themselves.
CROWDED = 20
#: Sketches that one task sums.
SKETCHES_AT_ONCE = 16
#: Multipliers that make the token orders; the first gives the candidates.
ORDERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of the texts, A-Z in lower case, and the number of words of each text."""
    raw = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-8", "surrogatepass"), np.uint8)
    solid = ~_SPACE[raw]
    edge = np.diff(solid.astype(np.int8), prepend=0)
    starts, stops = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    bounds = np.cumsum(np.fromiter((len(t.encode("utf-8", "surrogatepass")) + 1 if not t.isascii() else len(t) + 1 for t in texts), np.int64, len(texts)))
    counts = np.diff(np.searchsorted(starts, bounds), prepend=0)
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    low = _LOWER[raw]
    with np.errstate(over="ignore"):
        place = np.arange(len(raw), dtype=np.int64)
        first = np.zeros(len(raw), np.int64)
        first[starts] = starts
        place -= np.maximum.accumulate(first)
        longest = int((stops - starts).max())
        powers = np.cumprod(np.full(longest, 0x2545F4914F6CDD1D, np.uint64))
        value = (low.astype(np.uint64) + np.uint64(1)) * powers[np.minimum(place, longest - 1)]
        value[~solid] = 0
        return _mix(np.add.reduceat(value, starts)), counts


def shingle_sets(texts: list[str], width: int = 5) -> Iterator[np.ndarray]:
    """Each text's set: sorted distinct hashes of its shingles of `width` words; of all its words if it has fewer."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size < SLICE_BYTES):
            size += len(texts[end])
            end += 1
        words, counts = word_hashes(texts[at:end])
        with np.errstate(over="ignore"):
            h = np.full(max(0, len(words) - width + 1), width, np.uint64)
            for k in range(width):
                h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(h)])
            first = np.cumsum(counts) - counts
            for f, n in zip(first.tolist(), counts.tolist(), strict=True):
                if n >= width:
                    yield np.unique(h[f : f + n - width + 1])
                elif n:
                    x = np.full(1, n, np.uint64)
                    for k in range(n):
                        x = _mix(x * np.uint64(0x9E3779B97F4A7C15) + words[f + k : f + k + 1])
                    yield x
                else:
                    yield np.zeros(0, np.uint64)
        at = end


def fingerprint(members: np.ndarray) -> int:
    """A signed 64-bit id of a set."""
    if not len(members):
        return 0
    with np.errstate(over="ignore"):
        return int(_mix(_mix(members).sum(keepdims=True) + np.uint64(len(members))).view(np.int64)[0])


def _prefix(members: np.ndarray, heavy: np.ndarray, order: int, need: int) -> np.ndarray:
    """The first members under an order, in that order, one of which is among any partner's first members."""
    n = len(members)
    size = min(n, n - -(-need * n // 100) + 1)
    with np.errstate(over="ignore"):
        rank = _mix(members * np.uint64(order)) >> np.uint64(6)
    rank |= heavy[(members & np.uint64(SKETCH - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(58)
    first = np.argpartition(rank, size - 1)[:size]
    return members[first[np.argsort(rank[first])]]


def _classes(counts: np.ndarray) -> np.ndarray:
    """From the sketch: 0 for counters near the usual, else more the further they are above it (up to 31)."""
    usual = np.median(counts)
    above = (counts - usual) / (4 * np.sqrt(usual + 1) + 4)
    return np.clip(np.floor(np.log2(np.maximum(above, 0.5))) + 1, 0, 31).astype(np.uint8)


def _describe(docs: DataFrame, width: int) -> DataFrame:
    """Per row: doc_id, n (set size), fp (set id), text_hash; and per task one row with the task's sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim_worker()
        counts = np.zeros(SKETCH, np.uint32)
        for batch in batches:
            sizes, ids = [], []
            for members in shingle_sets(batch.column(1).to_pylist(), width):
                sizes.append(len(members))
                ids.append(fingerprint(members))
                np.add.at(counts, (members & np.uint64(SKETCH - 1)).astype(np.int64), np.uint32(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), batch.column(2), pa.nulls(len(sizes), pa.binary())], names=["doc_id", "n", "fp", "text_hash", "sketch"])
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, pa.int64()) for _ in range(4)), pa.array([counts.tobytes()])], names=["doc_id", "n", "fp", "text_hash", "sketch"])

    return docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(run, "doc_id long, n long, fp long, text_hash long, sketch binary")


def _counters(sketch: pa.Buffer) -> np.ndarray:
    """The counters of a task's sketch (32 bits each) or of a sum of them (64 bits)."""
    return np.frombuffer(sketch, np.uint32 if len(sketch) == 4 * SKETCH else np.int64).astype(np.int64)


def _heavy(described: DataFrame) -> np.ndarray:
    """The class of every counter of the sketch, summed over all tasks by a tree of tasks; the driver gets a byte a counter."""

    def summed(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        counts = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for x in batch.column(0):
                counts += _counters(x.as_buffer())
        return counts

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([summed(batches).tobytes()])], names=["sketch"])

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([_classes(summed(batches)).tobytes()])], names=["heavy"])

    parts = described.where("sketch IS NOT NULL").select("sketch")
    left = parts.count()
    while left > SKETCHES_AT_ONCE:
        left = -(-left // SKETCHES_AT_ONCE)
        parts = parts.repartition(left).mapInArrow(add, "sketch binary")
    return np.frombuffer(parts.repartition(1).mapInArrow(classify, "heavy binary").first()["heavy"], np.uint8)


def _postings(docs: DataFrame, heavy: np.ndarray, width: int, need: int) -> DataFrame:
    """token, heavy (whether the sketch marks it), fp, n, pos: the first order's prefix of every set, once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim_worker()
        seen: set[int] = set()
        for batch in batches:
            tokens, ids, sizes = [], [], []
            for members in shingle_sets(batch.column(0).to_pylist(), width):
                fp = fingerprint(members)
                if not len(members) or fp in seen:
                    continue
                seen.add(fp)
                tokens.append(_prefix(members, heavy, ORDERS[0], need))
                ids.append(fp)
                sizes.append(len(members))
            if tokens:
                yield _posted(tokens, ids, sizes, heavy)

    return docs.select("text").mapInArrow(run, POSTING)


POSTING = "token long, heavy boolean, fp long, n int, pos int"


def _posted(tokens: list[np.ndarray], ids: list[int], sizes: list[int], heavy: np.ndarray) -> pa.RecordBatch:
    flat, each = np.concatenate(tokens), np.fromiter(map(len, tokens), np.int64, len(tokens))
    marked = heavy[(flat & np.uint64(SKETCH - 1)).astype(np.int64)] > 0
    place = np.arange(len(flat)) - np.repeat(np.cumsum(each) - each, each)
    columns = [flat.view(np.int64), marked, np.repeat(np.array(ids, np.int64), each), np.repeat(np.array(sizes, np.int32), each), place.astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "heavy", "fp", "n", "pos"])


def _members(sets: DataFrame, heavy: np.ndarray) -> DataFrame:
    """All members of the sets (fp, members), as postings in no order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim_worker()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                tokens = [np.frombuffer(m.as_buffer(), np.uint64) for m in part.column(1)]
                yield _posted(tokens, part.column(0).to_pylist(), [len(t) for t in tokens], heavy)

    return sets.select("fp", "members").mapInArrow(run, POSTING)


def _counted(postings: DataFrame, value: str) -> DataFrame:
    """The distinct postings of tokens that have more than one value, with lo, hi (of the value) and c (postings) of their token.

    Tokens that the sketch marks are counted by partial aggregates and joined back, so none of them is one task's.
    """
    low, high, many = F.min(value), F.max(value), F.count(F.lit(1))
    by_token = W.partitionBy("token")
    light = postings.where("NOT heavy").select("*", low.over(by_token).alias("lo"), high.over(by_token).alias("hi"), many.over(by_token).alias("c"))
    frequent = postings.where("heavy")
    ends = frequent.groupBy("token").agg(low.alias("lo"), high.alias("hi"), many.alias("c")).where("lo <> hi")
    return light.where("lo <> hi").distinct().unionByName(frequent.join(ends, "token").select(*light.columns).distinct())


def _across(postings: DataFrame, need: int, crowd: bool) -> DataFrame:
    """Pairs (a, b) of sets of different labels that a shared token can be the first shared one of, given its places.

    Of pairs within the crowd none are given unless the postings are the crowd's own; of other pairs those whose sets
    both have as many open postings (o) as members of their prefixes must be shared.
    """
    one, two = (postings.select("token", *(F.col(c).alias(c + x) for c in ("fp", "n", "pos", "label", "o", "crowded"))) for x in "ab")
    na, nb = F.col("na"), F.col("nb")
    order = (na < nb) | ((na == nb) & (F.col("fpa") < F.col("fpb")))
    overlap = F.ceil((na + nb) * need / F.lit(100 + need))
    fits = (100 * na >= need * nb) & (na - F.col("posa") >= overlap) & (nb - F.col("posb") >= overlap)
    if not crowd:
        fits = fits & ~(F.col("crowdeda") & F.col("crowdedb")) & (F.least("oa", "ob") >= _least_shared(nb, na, need))
    met = one.join(two, "token").where((F.col("labela") != F.col("labelb")) & order & fits)
    return met.select(F.col("fpa").alias("a"), F.col("fpb").alias("b")).distinct()


def _least_shared(n: Column, m: Column, need: int) -> Column:
    """How many members of their first prefixes two sets of sizes n >= m must share to be similar enough.

    Of the members beyond the prefix that ends first, at most as many are common as that set has left: at most
    ceil(t n) - 1. The rest of the overlap that similarity asks for, t / (1 + t) (n + m), lies within both prefixes.
    """
    overlap = F.ceil((n + m) * need / F.lit(100 + need))
    return F.greatest(F.lit(1), overlap - (F.ceil(n * need / F.lit(100)) - 1))


def _verified(pairs: DataFrame, sets: DataFrame, heavy: np.ndarray, need: int) -> DataFrame:
    """The pairs (a, b) of set ids that share prefix members under every order and are similar enough."""
    a = sets.select(F.col("fp").alias("a"), F.col("members").alias("of_a"))
    b = sets.select(F.col("fp").alias("b"), F.col("members").alias("of_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim_worker()
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                one, two = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                keep.append(_linked(one, two, heavy, need))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(b, "b").join(a, "a").select("a", "b", "of_a", "of_b")
    return joined.mapInArrow(run, "a long, b long")


def _linked(one: np.ndarray, two: np.ndarray, heavy: np.ndarray, need: int) -> bool:
    if 100 * min(len(one), len(two)) < need * max(len(one), len(two)):
        return False
    for order in ORDERS[1:]:
        if not len(np.intersect1d(_prefix(one, heavy, order, need), _prefix(two, heavy, order, need), assume_unique=True)):
            return False
    common = len(np.intersect1d(one, two, assume_unique=True))
    return 100 * common >= need * (len(one) + len(two) - common)


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """fp, members (sorted, as bytes) of the wanted (fp, doc_id, text_hash) sets, from the texts of these documents.

    Sets that only rows without an id hold are found by their text's hash, so a null id is as good as any.
    """
    few = wanted.count() <= MAX_BROADCAST_IDS
    ids = wanted.select(F.col("fp").alias("__fp"), F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash"))
    chosen = docs.join(F.broadcast(ids) if few else ids, same).select("__fp", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim_worker()
        for batch in batches:
            wants, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found = [(f, m.tobytes()) for f, m in zip(wants, shingle_sets(texts, width), strict=True) if fingerprint(m) == f]
            for k in range(0, len(found), 1000):
                part = found[k : k + 1000]
                yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in part], pa.int64()), pa.array([m for _, m in part], pa.binary())], names=["fp", "members"])

    return chosen.mapInArrow(run, "fp long, members binary").dropDuplicates(["fp"])


def _with_sets(docs: DataFrame, sets: DataFrame | None, wanted: DataFrame, firsts: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """All sets fetched so far, with the wanted ones (fp); and these alone."""
    wanted = materialise(wanted, "jaccard-wanted")
    lacking = wanted if sets is None else wanted.join(sets.select("fp"), "fp", "left_anti")
    more = materialise(_sets(docs, lacking.join(firsts, "fp"), width), "jaccard-members")
    release(docs.sparkSession)
    sets = more if sets is None else sets.unionByName(more)
    few = wanted.count() <= MAX_BROADCAST_IDS  # the members stay where they are then
    return sets, sets.join(F.broadcast(wanted) if few else wanted, "fp", "left_semi")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, need: int = 75) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, its own included).

    Two documents link when 100 * |intersection| >= need * |union| of their sets. Null texts and texts without words
    have an empty set and link with nothing. Rows may repeat ids or texts; a row without an id gets the component's
    smallest id, null if there is none. Columns other than the two named are ignored, and an empty table gives none.
    """
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    described = materialise(_describe(docs, width), "jaccard-sets")
    heavy = _heavy(described)
    release(docs.sparkSession)
    rows = described.where("sketch IS NULL").drop("sketch")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("x")
    firsts = rows.where("n > 0").groupBy("fp").agg(first).select("fp", "x.doc_id", "x.text_hash")

    postings = materialise(_postings(docs, heavy, width, need), "jaccard-postings")
    shared = _counted(postings, "fp").select("token", "heavy", "fp", "n", "pos")
    own = 1 - F.count(F.lit(1)).over(W.partitionBy("fp")) / F.col("n")
    shared = materialise(shared.withColumn("own", own), "jaccard-shared")
    discard(postings)
    release(docs.sparkSession)

    # some rounds in which every set is compared with one leader only, of those outside its component: per member the
    # leader is the set with the least of its prefix to itself, among all sets at first and then among another quarter
    # of them each round, and of its leaders a set takes the most frequent one
    links, labels, sets, tried = None, None, None, None
    for turn in range(LEADER_ROUNDS):
        named = shared if labels is None else shared.join(labels.withColumnRenamed("node", "fp"), "fp", "left")
        named = named.withColumn("label", F.col("fp") if labels is None else F.coalesce("label", "fp"))
        turned = F.lit(turn > 0) & (F.pmod(F.xxhash64("fp", F.lit(turn)), F.lit(4)) > 0)
        leaders = named.groupBy("token").agg(F.min(F.struct(turned, "own", "fp", "n", "label")).alias("x"), F.min("label").alias("lo"), F.max("label").alias("hi"))
        leaders = leaders.where("lo <> hi").select("token", F.col("x.fp").alias("hub"), F.col("x.n").alias("hub_n"), F.col("x.label").alias("hub_label"))
        close = named.join(leaders, "token").where(F.col("label") != F.col("hub_label"))
        often = close.groupBy("fp", "hub").agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("n"), F.max("hub_n").alias("hub_n"))
        large, small = F.greatest("n", "hub_n"), F.least("n", "hub_n")
        often = often.where((100 * small >= need * large) & (4 * F.col("k") >= _least_shared(large, small, need)))
        if tried is not None:
            often = often.join(tried, ["fp", "hub"], "left_anti")
        pairs = materialise(often.groupBy("fp").agg(F.max(F.struct("k", "hub")).alias("x")).select(F.col("x.hub").alias("a"), F.col("fp").alias("b")), "jaccard-pairs")
        done = pairs.select(F.col("b").alias("fp"), F.col("a").alias("hub"))
        tried = done if tried is None else tried.unionByName(done)
        sets, both = _with_sets(docs, sets, _ends(pairs), firsts, width)
        found = materialise(_verified(pairs, both, heavy, need), "jaccard-links")
        links = found if links is None else links.unionByName(found)
        labels = components(links)
        release(docs.sparkSession)
        if not found.limit(1).count():
            break

    # all candidate pairs between different components: within the crowd by exact frequency, else by the first order
    in_component = labels.withColumnRenamed("node", "fp")
    labelled = shared.drop("own").join(in_component, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    open_tokens = materialise(_counted(labelled, "label").select("token", "fp", "n", "pos", "label"), "jaccard-open")
    discard(shared)
    release(docs.sparkSession)
    of_prefix = F.col("n") - F.ceil(F.col("n") * need / F.lit(100)) + 1
    opened = open_tokens.groupBy("fp", "n", "label").agg(F.count(F.lit(1)).alias("o")).withColumn("crowded", 100 * F.col("o") >= CROWDED * of_prefix)
    opened = materialise(opened.select("fp", "label", "o", "crowded"), "jaccard-opened")
    crowd = opened.where("crowded")
    sets, crowded = _with_sets(docs, sets, crowd.select("fp"), firsts, width)
    posted = materialise(_members(crowded, heavy), "jaccard-crowd")  # read three times below
    ranked = _counted(posted, "fp")
    place = F.row_number().over(W.partitionBy("fp").orderBy("c", "token")) - 1 + F.col("n") - F.count(F.lit(1)).over(W.partitionBy("fp"))
    ranked = ranked.withColumn("pos", place).where(100 * (F.col("n") - F.col("pos")) >= need * F.col("n"))
    ranked = materialise(ranked.join(crowd, "fp").select("token", "fp", "n", "pos", "label", "o", "crowded"), "jaccard-ranked")
    discard(posted)
    release(docs.sparkSession)
    some = open_tokens.join(opened.drop("label"), "fp")
    across = materialise(_across(some, need, False).unionByName(_across(ranked, need, True)).distinct(), "jaccard-across")
    sets, all_sets = _with_sets(docs, sets, _ends(across), firsts, width)
    late = materialise(_verified(across, all_sets, heavy, need), "jaccard-late-links")
    labels = components(links.unionByName(late))
    for table in (open_tokens, opened, ranked, across):
        discard(table)
    release(docs.sparkSession)

    named = labels.withColumnRenamed("node", "fp").join(firsts, "fp")
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of_set = firsts.join(named.join(least, "label").select("fp", "component_id"), "fp", "left").select("fp", F.coalesce("component_id", "doc_id").alias("__component"))
    joined = rows.join(of_set, (rows["fp"] == of_set["fp"]) & (rows["n"] > 0), "left")
    return joined.select(rows["doc_id"], F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("__component")).otherwise(rows["doc_id"]).alias("component_id"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs that are the first of their component; of rows with that same id, all whose component it is.

    Documents without words stay.
    """
    found = near_duplicates(docs, doc_id, text, **options)
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__first")).distinct()
    return docs.join(first, F.col(f"`{doc_id}`").cast("long").eqNullSafe(first["__first"]), "left_semi")
