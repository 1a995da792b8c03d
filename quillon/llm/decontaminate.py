"""Benchmark passages in documents, found by winnowing, in DataFrame functions only.

Of every `window - GRAM + 1` consecutive hashes of GRAM words the smallest is a fingerprint, in documents and in
benchmark items alike. Two texts that share `window` words share all hashes in them, so they share a fingerprint at the
same place of the span: none is missed. Fingerprints of both sides are joined; each meeting gives an item and a
diagonal, that is, by how many words the item lies to the right in the document. On a diagonal the item's words are
compared with the document's, which extends the hit to both sides as far as words agree; stretches of `window` words
and more are kept. Items of fewer words have no winnowed fingerprint: their one hash meets all of the documents'
hashes of that many words (lengths that no item has cost nothing).

Documents stay in their rows: the first pass sends out hashes of those that met an item only, by a 128-bit hash of the
text, and the second compares words within the row, so copies of a text are no hot group before the last join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import discard, let, materialise

GRAM = 6
#: Bits of a fingerprint that hold its place, so that the smallest hash brings its place along.
PLACE = (1 << 30) - 1
#: Fingerprints of items, and words of items at diagonals, that may be broadcast; more are joined by a shuffle.
MAX_BROADCAST_PRINTS = 500_000
MAX_BROADCAST_WORDS = 2_000_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain_words(text: Column) -> Column:
    """A-Z in lower case, then the maximal runs of ASCII letters, digits and characters beyond ASCII; null has none."""
    body = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(body) == F.char_length(body)
    low = F.when(ascii_only, F.lower(body)).otherwise(F.translate(body, _UPPER, _UPPER.lower()))
    return F.array_remove(F.split(low, _BETWEEN), "")


def _grams(h: Column, n: int) -> Column:
    """The hashes of n words from each place, that place in their low bits; h are the hashes of the words, at least n."""
    packed = lambda i: F.xxhash64(F.lit(n), *(F.get(h, i + k) for k in range(n))).bitwiseAND(F.lit(~PLACE)).bitwiseOR(i.cast("long"))
    return F.transform(F.sequence(F.lit(0), F.size(h) - n), packed)


def winnowed(h: Column, window: int) -> Column:
    """The fingerprints of a text with word hashes h: the smallest of every window - GRAM + 1 gram hashes, each once."""
    width = window - min(GRAM, window) + 1
    found = let(_grams(h, min(GRAM, window)), lambda g: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(g) - width + 1), lambda i: F.array_min(F.slice(g, i, width)))))
    return F.when(F.size(h) >= window, found).otherwise(F.array().cast("array<bigint>"))


def _prints(ws: Column, window: int, short: list[int]) -> Column:
    """Fingerprints and, for the lengths in short, all hashes of so many words."""

    def of(h: Column) -> Column:
        return F.concat(winnowed(h, window), *(F.when(F.size(h) >= n, _grams(h, n)).otherwise(F.array().cast("array<bigint>")) for n in short))

    return let(F.transform(ws, lambda w: F.xxhash64(w)), of)


def _spans(ws: Column, met: Column, window: int) -> Column:
    """The stretches on which the words of an item (words, diagonal) agree with ws, in words of the document."""
    v, shift = met["words"], met["diagonal"]
    low, high = F.greatest(F.lit(0), -shift), F.least(F.size(v), F.size(ws) - shift)
    odd = F.filter(F.sequence(low, F.greatest(low, high - 1)), lambda j: F.get(ws, j + shift) != F.get(v, j))
    edges = F.concat(F.array(low - 1), odd, F.array(high))
    need = F.least(F.lit(window), F.size(v))
    spans = let(edges, lambda e: F.transform(F.sequence(F.lit(1), F.size(e) - 1), lambda k: F.struct((F.get(e, k - 1) + 1 + shift).alias("f"), (F.get(e, k) + shift).alias("e"))))
    return F.when(high > low, F.filter(spans, lambda s: s["e"] - s["f"] >= need)).otherwise(F.array().cast("array<struct<f:int,e:int>>"))


def _covered(spans: Column) -> Column:
    """How many words lie in any of the spans, which come in order."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["e"] - F.greatest(s["f"], a["upto"]))).alias("n"), F.greatest(a["upto"], s["e"]).alias("upto"))
    return F.aggregate(spans, start, step, lambda a: a["n"])


def find_passages(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """docs with n_words, n_hit, spans, items and contaminated; columns of these names are replaced.

    spans: array of f, e, the stretches of words [f, e) that agree with some item over at least `window` words, or with
    all words of an item of fewer; they may overlap. n_hit: words in any of them (long). items: array of the ids, as
    strings in order, of the items met; a null id counts as an empty string. contaminated: n_hit > 0.
    Null and empty texts and texts without a word have no words and no hits, and as items meet nothing. Items with one
    id and several texts count once. Rows with equal texts have equal results.
    """
    added = ("n_words", "n_hit", "spans", "items", "contaminated")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in added]
    raw = benchmark.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("item_id"), plain_words(F.col(f"`{item_text}`")).alias("words"))
    items = materialise(raw.where(F.size("words") > 0).distinct().withColumn("item", F.monotonically_increasing_id()), "bench-items")
    short = sorted(r[0] for r in items.where(F.size("words") < window).select(F.size("words")).distinct().collect())
    own = items.select("item", F.explode(F.when(F.size("words") >= window, _prints(F.col("words"), window, [])).otherwise(_whole(F.col("words"), short))).alias("p"))
    own = materialise(own.select(F.col("p").bitwiseAND(F.lit(~PLACE)).alias("h"), F.col("p").bitwiseAND(F.lit(PLACE)).cast("int").alias("at"), "item"), "bench-prints")
    bounded = own.count() <= MAX_BROADCAST_PRINTS

    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    key = F.unhex(F.substring(F.sha2(body.cast("binary"), 256), 1, 32))
    sent = docs.select(key.alias("key"), F.explode(_prints(plain_words(F.col(f"`{text}`")), window, short)).alias("p"))
    sent = sent.select("key", F.col("p").bitwiseAND(F.lit(~PLACE)).alias("h"), F.col("p").bitwiseAND(F.lit(PLACE)).cast("int").alias("place"))
    met = sent.join(F.broadcast(own) if bounded else own, "h").select("key", "item", (F.col("place") - F.col("at")).alias("diagonal")).distinct()
    met = materialise(met.join(items.withColumn("n", F.size("words")), "item").select("key", "item_id", "diagonal", "words", "n"), "bench-met")
    small = met.agg(F.coalesce(F.sum(F.col("n") + 10), F.lit(0))).first()[0] <= MAX_BROADCAST_WORDS
    by_text = met.groupBy("key").agg(F.collect_list(F.struct("item_id", "diagonal", "words")).alias("met"))  # the meetings of one text
    discard(own)

    row = docs.select(F.struct(*others).alias("row"), key.alias("key"), plain_words(F.col(f"`{text}`")).alias("ws"))
    joined = row.join(F.broadcast(by_text) if small else by_text, "key", "left")

    def judged(ws: Column) -> Column:
        return F.filter(F.transform("met", lambda m: F.struct(m["item_id"].alias("item_id"), _spans(ws, m, window).alias("spans"))), lambda x: F.size(x["spans"]) > 0)

    hits = F.when(F.col("met").isNotNull(), judged(F.col("ws")))
    found = joined.select("row", F.size("ws").cast("long").alias("n_words"), hits.alias("hits"))
    spans = F.when(F.size("hits") > 0, F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda x: x["spans"])))))
    ids = F.when(F.size("hits") > 0, F.array_sort(F.array_distinct(F.transform("hits", lambda x: x["item_id"]))))
    found = found.select("row", "n_words", F.coalesce(spans, F.array().cast("array<struct<f:int,e:int>>")).alias("spans"), F.coalesce(ids, F.array().cast("array<string>")).alias("items"))
    found = found.select("row.*", "n_words", _covered(F.col("spans")).cast("long").alias("n_hit"), "spans", "items")
    return found.withColumn("contaminated", F.col("n_hit") > 0)


def _whole(ws: Column, short: list[int]) -> Column:
    """The one hash of an item with fewer words than a window."""

    def of(h: Column) -> Column:
        out = F.array().cast("array<bigint>")
        for n in short:
            out = F.when(F.size(h) == n, _grams(h, n)).otherwise(out)
        return out

    return let(F.transform(ws, lambda w: F.xxhash64(w)), of)
