"""Mixing sources to target weights, in DataFrame functions only.

The words of every source, document after document, form a stream that is cut into blocks of fixed length. Output
shards hold a fixed number of slots, and each slot draws its source at random in proportion to the targets, so a
shard's counts by source are a multinomial draw. The draws of a source beyond its quota of slots go to the sources
short of theirs. The t-th slot of a source takes the block at place t of a pseudorandom permutation of its blocks, a
new one for each pass over the source, and slots meet blocks by joining on (source, block).

Every random choice is a hash of ids and a seed, so reruns agree. No step gathers a source in one task: streams are
laid out by (source, bucket) with offsets from the buckets' sums, and slots are ranked by (shard, source).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._shared import SPACE_CLASS, WORD_CLASS, carries_columns, let, materialise, words

#: No document is taken more often than this, so no target exceeds this times its source's size.
MOST_REPEATS = 3


@dataclass
class Mix:
    """documents: one row per input row with doc_id, source, size, text_hash, source_size, target, taken.

    sources: source, source_rank, source_size, weight, target, n_blocks, n_slots. slots: shard, slot, source_rank,
    pass_no, block: what each output slot holds. spans: source_rank, block, doc_id, text_hash, source, start, from_word,
    to_word: the words of each document in each block; start is the document's place in its source's stream.
    """

    documents: DataFrame
    sources: DataFrame
    slots: DataFrame
    spans: DataFrame


def targets(sources: DataFrame) -> DataFrame:
    """sources(source, source_size, n_docs) with source_rank, weight and target.

    Sources by code point, null last, weigh 1, 2, 3, 1, ... They share the sum of all sizes by weight; a target stops
    at MOST_REPEATS times its source's size, and the excess is shared again by weight among the others: in order of
    cap / weight, a source is capped if its cap is no more than its share of what the ones before it leave. The
    windows here run over one row per source.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("source_rank", F.row_number().over(by_name)).withColumn("weight", (F.col("source_rank") - 1) % 3 + 1)
    cap = F.col("source_size") * F.lit(float(MOST_REPEATS))
    ranked = ranked.withColumn("cap", cap).withColumn("total", F.sum("source_size").over(W.partitionBy()))
    before = W.orderBy(F.col("cap") / F.col("weight"), "source_rank").rowsBetween(W.unboundedPreceding, -1)
    left = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weights_left = F.sum("weight").over(W.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    shared = ranked.withColumn("share", left / weights_left)
    shared = shared.withColumn("capped", F.col("cap") <= F.col("share") * F.col("weight"))
    level = F.max(F.when(~F.col("capped"), F.col("share"))).over(W.partitionBy())
    return shared.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(level * F.col("weight"))).drop("cap", "total", "share", "capped")


def _permuted(df: DataFrame, index: str, n: str, keys: list[Column], rounds: int) -> DataFrame:
    """df with `index` (0 <= index < n) moved by a pseudorandom permutation of 0..n-1 that the keys choose.

    Swap-or-not: each round pairs x with (k - x) mod n and swaps the pair or not by one bit of a hash of the pair.
    """

    def turn(x: Column, r: Column) -> Column:
        k = F.pmod(F.xxhash64(*keys, r), F.col(n))

        def swapped(y: Column) -> Column:
            return F.when(F.xxhash64(*keys, r, F.greatest(x, y)).bitwiseAND(F.lit(1)) == 1, y).otherwise(x)

        return let(F.pmod(k - x, F.col(n)), swapped)

    return df.withColumn(index, F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), F.col(index).cast("long"), turn))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", block_words: int = 128, shard_slots: int = 1 << 16, seed: int = 11, rounds: int = 16, bucket_rows: int = 200_000) -> Mix:
    """Mix the documents to their sources' targets; see Mix for what comes back.

    A document's size is its number of words; null and empty texts have size 0 and are taken 0 times. Null is a source
    of its own. Rows with equal id and text are documents of their own. Other columns are ignored. An empty table, or
    one without words, gives empty slots and zero targets. A source's taken words miss its target by no more than
    about a block, and no document is taken more than MOST_REPEATS times its size.
    """
    spark = docs.sparkSession
    slim = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.col(f"`{source}`").alias("source"),
        F.size(words(F.col(f"`{text}`"))).cast("long").alias("size"),
        F.xxhash64(F.col(f"`{text}`")).alias("text_hash"),
    )
    slim = materialise(slim, "mix-documents")
    totals = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    n_blocks = F.ceil(F.col("source_size") / block_words)
    passes = F.when(F.col("source_size") > 0, F.least(F.lit(MOST_REPEATS), F.floor(F.col("target") / F.col("source_size")))).otherwise(F.lit(0))
    rest = F.when(F.col("source_size") > 0, F.greatest(F.lit(0.0), F.col("target") - F.col("__passes") * F.col("source_size")) * F.col("n_blocks") / F.col("source_size")).otherwise(F.lit(0.0))
    sources = targets(totals).withColumn("n_blocks", n_blocks).withColumn("__passes", passes)
    sources = sources.withColumn("n_slots", F.col("__passes") * F.col("n_blocks") + F.when(F.col("__passes") < MOST_REPEATS, F.least(F.col("n_blocks"), F.round(rest).cast("long"))).otherwise(F.lit(0)))
    slots_to = F.sum("n_slots").over(W.orderBy("source_rank").rowsBetween(W.unboundedPreceding, 0))
    sources = materialise(sources.drop("__passes").withColumn("slots_to", slots_to), "mix-sources")
    n_slots, n_sources, n_docs = sources.agg(F.coalesce(F.sum("n_slots"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum("n_docs"), F.lit(0))).first()

    # each slot draws a number below n_slots; the source whose range holds it is found by joining on cells of the range
    cell = max(1, n_slots // max(1, 4 * n_sources))
    low = F.col("slots_to") - F.col("n_slots")
    ranges = sources.where("n_slots > 0").select("source_rank", low.alias("low"), F.col("slots_to").alias("high"), F.explode(F.sequence(F.floor(low / cell), F.floor((F.col("slots_to") - 1) / cell))).alias("cell"))
    drawn = spark.range(n_slots).select(F.col("id").alias("slot"), F.floor(F.col("id") / shard_slots).alias("shard"), F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(max(1, n_slots))).alias("draw"))
    drawn = drawn.withColumn("cell", F.floor(F.col("draw") / cell)).join(ranges, "cell").where("draw >= low AND draw < high").select("slot", "shard", "source_rank")
    drawn = materialise(drawn, "mix-draws")

    counts = drawn.groupBy("source_rank", "shard").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("before", F.sum("n").over(W.partitionBy("source_rank").orderBy("shard").rowsBetween(W.unboundedPreceding, 0)) - F.col("n"))
    ranked = drawn.withColumn("t", F.row_number().over(W.partitionBy("source_rank", "shard").orderBy("slot")) - 1)
    ranked = ranked.join(counts.select("source_rank", "shard", "before"), ["source_rank", "shard"]).withColumn("t", F.col("t") + F.col("before"))
    of_source = sources.select("source_rank", "n_slots", "n_blocks")
    ranked = ranked.join(of_source, "source_rank").select("slot", "shard", "source_rank", "t", "n_slots", "n_blocks")
    ranked = materialise(ranked, "mix-ranked")

    # slots drawn beyond a source's quota, about the square root of all, serve the sources short of theirs
    spare = ranked.where("t >= n_slots").select("slot", "shard", (F.row_number().over(W.orderBy("slot")) - 1).cast("long").alias("q"))
    had = counts.groupBy("source_rank").agg(F.sum("n").alias("had"))
    short = of_source.join(had, "source_rank", "left").withColumn("had", F.coalesce("had", F.lit(0))).where("had < n_slots")
    short = short.withColumn("q_to", F.sum(F.col("n_slots") - F.col("had")).over(W.orderBy("source_rank").rowsBetween(W.unboundedPreceding, 0)))
    units = short.select("source_rank", "n_slots", "n_blocks", "had", F.explode(F.sequence(F.col("had"), F.col("n_slots") - 1)).alias("t"), (F.col("q_to") - F.col("n_slots")).alias("__q"))
    units = units.withColumn("q", F.col("__q") + F.col("t"))
    mended = spare.join(units, "q").select("slot", "shard", "source_rank", "t", "n_slots", "n_blocks")
    filled = ranked.where("t < n_slots").unionByName(mended)
    filled = filled.withColumn("pass_no", F.floor(F.col("t") / F.col("n_blocks"))).withColumn("block", F.col("t") % F.col("n_blocks"))
    slots = _permuted(filled, "block", "n_blocks", [F.lit(seed), F.col("source_rank"), F.col("pass_no")], rounds).select("shard", "slot", "source_rank", "pass_no", "block")

    # the sources' streams: buckets in order, documents by id within a bucket
    buckets = max(64, -(-n_docs // bucket_rows))
    named = slim.join(sources.select("source", "source_rank", "source_size", "target"), slim["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    named = named.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(buckets)))
    sums = named.groupBy("source_rank", "bucket").agg(F.sum("size").alias("n"))
    sums = sums.withColumn("base", F.sum("n").over(W.partitionBy("source_rank").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("n"))
    inside = W.partitionBy("source_rank", "bucket").orderBy("doc_id", "text_hash").rowsBetween(W.unboundedPreceding, 0)
    laid = named.withColumn("__upto", F.sum("size").over(inside)).join(sums.select("source_rank", "bucket", "base"), ["source_rank", "bucket"])
    laid = laid.withColumn("start", F.col("base") + F.col("__upto") - F.col("size")).drop("bucket", "base", "__upto")
    full = laid.where("size > 0")
    first, last = F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)
    pieces = full.withColumn("block", F.explode(F.sequence(first, last)))
    pieces = pieces.withColumn("from_word", F.greatest(F.lit(0), F.col("block") * block_words - F.col("start"))).withColumn("to_word", F.least(F.col("size"), (F.col("block") + 1) * block_words - F.col("start")))

    uses = slots.groupBy("source_rank", "block").agg(F.count(F.lit(1)).alias("uses"))
    columns = ["doc_id", "source", "size", "text_hash", "source_size", "target"]
    taken = pieces.join(uses, ["source_rank", "block"], "left").groupBy("source_rank", "start", *columns)
    taken = taken.agg(F.coalesce(F.sum((F.col("to_word") - F.col("from_word")) * F.col("uses")), F.lit(0)).cast("long").alias("taken"))
    documents = taken.select(*columns, "taken").unionByName(laid.where("size = 0").select(*columns, F.lit(0).cast("long").alias("taken")))
    return Mix(documents, sources, slots, pieces.select("source_rank", "block", "doc_id", "text_hash", "source", "start", "from_word", "to_word"))


def _runs(mixed: Mix) -> DataFrame:
    """doc_id, text_hash, source, start, from_word, to_word: the drawn words of every document, once per pass over its source.

    Blocks that follow each other and are drawn in the same pass make one run.
    """
    row = ["doc_id", "text_hash", "source", "start"]
    drawn = mixed.slots.select("source_rank", "pass_no", "block").join(mixed.spans, ["source_rank", "block"])
    place = F.row_number().over(W.partitionBy(*row, "pass_no").orderBy("block"))
    runs = drawn.withColumn("__run", F.col("block") - place).groupBy(*row, "pass_no", "__run")
    return runs.agg(F.min("from_word").alias("from_word"), F.max("to_word").alias("to_word")).select(*row, "from_word", "to_word")


@carries_columns
def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", n_chars: str | None = None, **options) -> DataFrame:
    """The words that the mix draws, as rows of docs: one row per run of a document's words, whose text is that run.

    A pass over a source that takes all of a document gives it whole, with its text as it is; a run of a part of it
    keeps the white space between and after its words. So a source's words are those of its slots, whatever the length
    of its documents. Documents of which nothing is drawn go. n_chars names a column that follows a text that was cut.
    """
    mixed = mix(docs, doc_id, text, source, **options)

    def key(i: Column, h: Column, s: Column) -> Column:
        return F.xxhash64(i, i.isNull(), h, s, s.isNull())

    # rows equal in id, text and source are documents of their own; which row stands for which does not matter
    runs = _runs(mixed).groupBy(key(F.col("doc_id"), F.col("text_hash"), F.col("source")).alias("__key"), "start")
    runs = runs.agg(F.sort_array(F.collect_list(F.struct("from_word", "to_word"))).alias("runs"))
    runs = runs.groupBy("__key").agg(F.collect_list("runs").alias("__runs"))
    keyed = docs.withColumn("__key", key(F.col(f"`{doc_id}`"), F.xxhash64(F.col(f"`{text}`")), F.col(f"`{source}`")))
    joined = keyed.join(runs, "__key")
    joined = joined.withColumn("__row", F.row_number().over(W.partitionBy("__key").orderBy("__key"))).where(F.col("__row") <= F.size("__runs"))

    whole = F.col(f"`{text}`")
    size = F.size(words(whole))
    spaced = F.regexp_extract_all(whole, F.lit(f"{WORD_CLASS}++{SPACE_CLASS}*+"), F.lit(0))

    def texts(n: Column) -> Column:
        def cut(parts: Column) -> Column:
            return F.transform(
                F.col("__runs")[F.col("__row") - 1],
                lambda r: F.when(r["to_word"] - r["from_word"] == n, whole).otherwise(F.array_join(F.slice(parts, r["from_word"].cast("int") + 1, (r["to_word"] - r["from_word"]).cast("int")), "")),
            )

        return let(spaced, cut)

    out = joined.withColumn("__text", F.explode(let(size, texts)))
    changed = {text: F.col("__text")}
    if n_chars is not None:
        changed[n_chars] = F.when(F.col("__text") == whole, F.col(f"`{n_chars}`")).otherwise(F.length("__text").cast(docs.schema[n_chars].dataType))
    return out.select(*(changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns))
