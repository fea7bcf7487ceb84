"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

Texts become lower-case tokens (runs of letters and digits), kept as 64-bit hashes. A seed is a mask
laid over consecutive tokens: positions marked 1 are hashed, the others are ignored, so a seed
matches although an ignored token was replaced. Seeds of benchmark and documents are joined on their
hash; around every hit the tokens on the same diagonal are compared one by one.

A leak is an aligned window of WINDOW tokens that differ in at most SLACK places. Items of SHORT to
WINDOW - 1 tokens use their whole length with one difference fewer; shorter items must be found whole
and unchanged. The two masks hit every such window (tests/llm/test_decontam.py tries all patterns of
differences), so verification around hits misses none. Items under the shortest mask get a solid
mask of their own length, at most one for each such length.

Seeds of the benchmark are broadcast only after their count is known to be at most BROADCAST; a larger
benchmark is joined by shuffling (doc_id, position, hash), and only documents with hits are verified.

Defined cases: null or token-free texts and items leak nothing; documents shorter than an item's
window can't hold it and leak nothing; repeated items and documents count once for each id; rows with
a null id are judged together under the null id; further columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import split_by_ids

MASKS = ("110100000111", "1110111")
WINDOW, SLACK, SHORT = 16, 3, 13
BROADCAST = 500_000


def tokens(text: Column) -> Column:
    """Hashes of the tokens of a text, in order."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def window_of(n: Column) -> Column:
    return F.least(F.lit(WINDOW), n)


def needed(n: Column) -> Column:
    """Equal tokens that a window of an item of n tokens needs."""
    return F.when(n >= WINDOW, WINDOW - SLACK).when(n >= SHORT, n - (SLACK - 1)).otherwise(n)


def _hashed(h: Column, mask: str, at: list[int]):
    return lambda i: F.xxhash64(F.lit(mask), *[F.get(h, i + o) for o in at])


def seeds(h: Column, masks: tuple[str, ...]) -> Column:
    """All seeds of a token array, mask after mask: array of hashes."""
    each = []
    for mask in masks:
        at = [i for i, c in enumerate(mask) if c == "1"]
        places = F.when(F.size(h) >= len(mask), F.sequence(F.lit(0), F.size(h) - len(mask))).otherwise(F.array().cast("array<int>"))
        each.append(F.transform(places, _hashed(h, mask, at)))
    return F.concat(*each)


def located(place: Column, n: Column, masks: tuple[str, ...]) -> tuple[Column, Column]:
    """From the place of a seed in seeds() of n tokens: its token position and its mask's length."""
    pos, span, before = F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(0)
    for mask in masks:
        here = F.greatest(n - len(mask) + 1, F.lit(0))
        inside = pos.isNull() & (place < before + here)
        pos, span, before = F.when(inside, place - before).otherwise(pos), F.when(inside, F.lit(len(mask))).otherwise(span), before + here
    return pos, span


def _verified(hits: DataFrame) -> DataFrame:
    """hits (doc_id, item, p, q, span, h, b): p and q are the positions of a seed in the document's
    tokens h and in the item's tokens b. Best and outermost windows that hold the seed."""
    n_doc, n_item = F.size("h"), F.size("b")
    w = window_of(n_item)
    low = F.greatest(F.col("span") - w, -F.col("p"), -F.col("q"))
    high = F.least(w - 1, n_doc - 1 - F.col("p"), n_item - 1 - F.col("q"))
    hits = hits.select("doc_id", "item", "p", "q", "h", "b", w.alias("w"), needed(n_item).alias("need"), low.alias("low"), high.alias("high")).where("high - low + 1 >= w")
    equal = F.transform(F.sequence("low", "high"), lambda k: (F.get("h", F.col("p") + k) == F.get("b", F.col("q") + k)).cast("int"))
    hits = hits.select("doc_id", "item", "w", "need", (F.col("p") + F.col("low")).alias("start"), equal.alias("equal"))
    counts = F.transform(F.sequence(F.lit(0), F.size("equal") - F.col("w")), lambda s: F.aggregate(F.slice("equal", s + 1, F.col("w")), F.lit(0), lambda acc, x: acc + x))
    hits = hits.select("doc_id", "item", "w", "need", "start", counts.alias("counts")).where(F.array_max("counts") >= F.col("need"))
    passing = F.transform("counts", lambda c: c >= F.col("need"))
    first = F.array_position(passing, True) - 1
    last = F.size("counts") - F.array_position(F.reverse(passing), True)
    return hits.select("doc_id", "item", F.array_max("counts").alias("matched"), (F.col("start") + first).alias("first_token"), (F.col("start") + last + F.col("w")).alias("end_token"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs (doc_id, text) x benchmark (item_id, text) -> doc_id, item_id, matched (most equal tokens
    in a window), first_token and end_token (what the leaking windows cover), one row for each pair."""
    named = benchmark.select("item_id", tokens(F.col("text")).alias("b")).where(F.size("b") > 0).withColumn("item", F.xxhash64("b"))
    items = named.select("item", "b").dropDuplicates(["item"])
    least = min(map(len, MASKS))
    short = sorted(r[0] for r in items.where(F.size("b") < least).select(F.size("b")).distinct().collect())  # under `least` values
    masks = (*MASKS, *("1" * n for n in short))
    pos, span = located(F.col("place"), F.size("b"), masks)
    known = items.select("item", "b", F.posexplode(seeds(F.col("b"), masks)).alias("place", "seed"))
    known = known.select("seed", "item", pos.alias("q"), span.alias("span"))

    texts = docs.select("doc_id", tokens(F.col("text")).alias("h"))
    places = texts.select("doc_id", "h", F.posexplode(seeds(F.col("h"), masks)).alias("place", "seed"))
    p, own_span = located(F.col("place"), F.size("h"), masks)
    if known.count() <= BROADCAST:
        hits = places.join(F.broadcast(known), "seed").select("doc_id", "h", p.alias("p"), own_span.alias("own"), "item", "q", "span").where("own = span")
        hits = hits.join(F.broadcast(items), "item")
    else:
        bare = texts.select("doc_id", F.size("h").alias("n"), F.posexplode(seeds(F.col("h"), masks)).alias("place", "seed"))
        p, own_span = located(F.col("place"), F.col("n"), masks)
        hits = bare.join(known, "seed").select("doc_id", "n", p.alias("p"), own_span.alias("own"), "item", "q", "span").where("own = span").join(items, "item")
        hits = hits.withColumnRenamed("doc_id", "id").join(texts, F.expr("id <=> doc_id and n = size(h)")).drop("id")
    pairs = _verified(hits).groupBy("doc_id", "item").agg(F.max("matched").alias("matched"), F.min("first_token").alias("first_token"), F.max("end_token").alias("end_token"))
    return pairs.join(named.select("item", "item_id").distinct(), "item").select(
        "doc_id", "item_id", F.col("matched").cast("bigint").alias("matched"), F.col("first_token").cast("bigint").alias("first_token"), F.col("end_token").cast("bigint").alias("end_token")
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose text has no leak. Texts are told apart by their digest, so rows of a repeated
    or null id are judged one by one."""
    keyed = docs.withColumn("_text", F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    found = leaks(keyed.select(F.col("_text").alias("doc_id"), "text"), benchmark)
    return split_by_ids(keyed, found.select(F.col("doc_id").alias("_text")), "_text")[0].drop("_text")
