"""Benchmark passages in documents: SimHash of item-sized windows, then exact weighted similarity.

A window as long as a benchmark item is compared with the items of that length.  Fingerprints
within ``RADIUS`` bits agree in at least one of ``RADIUS`` + 1 blocks, so an equi-join on blocks finds
all of them; what it finds is verified by the weighted Jaccard similarity of word shingles, a shingle
weighing as often as it occurs.  At a document's edge a window ends with the document, so an item that
the document holds without its first or last words is found too.  A window without any shingle of an item has similarity 0, so
windows are laid only where a shingle of an item of their length stands, at the place that lines
both up.  Built from DataFrame functions alone;
the benchmark's tables are staged, so Spark knows their bytes and broadcasts only what its own threshold allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import WORD, let, staged, whole_text

#: Sets with similarity 0.8 differ in some 10 of 64 bits, give or take 3.
RADIUS = 20
BLOCKS = RADIUS + 1
BITS = 64


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(0))


def shingle_hashes(word_hashes: Column, size) -> Column:
    """Hashes of all runs of ``size`` words, from an array of word hashes; none if there are fewer."""
    n = F.size(word_hashes) - size + 1
    return F.when(n < 1, F.array().cast("array<long>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(F.slice(word_hashes, i, size))))


def weighted(hashes: Column) -> Column:
    """Tell the occurrences of a shingle apart, so that sets of them intersect as weights do."""
    return F.transform(hashes, lambda h, i: F.xxhash64(h, F.size(F.filter(F.slice(hashes, 1, i), lambda o: o == h))))


def simhash(hashes: Column) -> Column:
    """64 bits: the majority of each bit over all shingles, each as often as it occurs."""
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("long"),
        lambda out, b: out.bitwiseOR(F.when(
            2 * F.aggregate(hashes, F.lit(0).cast("long"), lambda n, h: n + F.call_function("getbit", h, b))
            > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))))


def blocks(fingerprint: Column) -> Column:
    """(number, bits) of each block; block widths differ by one at most."""
    edges = [k * BITS // BLOCKS for k in range(BLOCKS + 1)]
    return F.array(*[F.struct(F.lit(k).alias("block"),
                              F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("bits"))
                     for k, (a, b) in enumerate(zip(edges, edges[1:]))])


def benchmark_items(benchmark: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """``item_id``, ``m`` (words), ``step`` (shingle size), ``marks`` (weighted shingles), ``shingles``, ``print``; items with words only."""
    hashed = benchmark.select(
        F.col(key).alias("item_id"),
        let(words_of(whole_text(text)), lambda w: F.transform(w, lambda x: F.xxhash64(x))).alias("h"))
    items = hashed.filter(F.size("h") > 0).select("item_id", "h", F.size("h").alias("m"), F.least(F.lit(size), F.size("h")).alias("step"))
    shingled = staged(items.select("item_id", "m", "step", shingle_hashes(F.col("h"), F.col("step")).alias("shingles")), "benchmark")
    return staged(shingled.select("*", weighted(F.col("shingles")).alias("marks"), simhash(F.col("shingles")).alias("print")), "benchmark")


def numbered(docs: DataFrame) -> DataFrame:
    """Staged ``row`` (unique) and ``carry`` (a struct of all columns): rows are told apart whatever their keys are."""
    return staged(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(c) for c in docs.columns]).alias("carry")), "numbered")


def contaminated(docs: DataFrame, benchmark: DataFrame, *, size: int = 5, least: float = 0.8, key: str = "doc_id", text: str = "text",
                 item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``key``, ``item_id``, start (words before the best window), similarity: each document and item found in it, once.

    Words are compared in lower case; an item shorter than ``size`` words is one shingle.  Missing and empty texts
    hold nothing and items without words are found nowhere; every row is searched by itself, then repeated rows of a
    document count as one; a document without a key is found under the missing key; empty tables give an empty result.
    """
    whole = numbered(docs.select(F.col(key).alias("key"), F.col(text).alias("text")))
    found = staged(found_rows(whole.select("row", "carry.text"), benchmark, size=size, least=least, item_key=item_key, item_text=item_text), "found")
    best = F.max(F.struct("similarity", (-F.col("start")).alias("first"))).alias("best")
    return whole.select("row", "carry.key").join(found, "row").groupBy("key", "item_id").agg(best).select(
        F.col("key").alias(key), "item_id", (-F.col("best.first")).alias("start"), F.col("best.similarity").alias("similarity"))


def found_rows(rows: DataFrame, benchmark: DataFrame, *, size: int = 5, least: float = 0.8, item_key: str = "item_id",
               item_text: str = "text") -> DataFrame:
    """``row``, ``item_id``, start, similarity of a staged table with ``row`` (unique) and ``text``: each row and item found in it, once."""
    items = benchmark_items(benchmark, size, item_key, item_text)
    hashed = rows.select("row", let(words_of(whole_text("text")), lambda w: F.transform(w, lambda x: F.xxhash64(x))).alias("h"))
    steps = [r["step"] for r in items.select("step").distinct().collect()]  # at most ``size`` numbers
    spots = items.select("m", "step", F.posexplode("shingles").alias("at", "shingle")).distinct()
    found = None
    for step in steps:
        places = hashed.select("row", F.posexplode(let(F.col("h"), lambda h: shingle_hashes(h, step))).alias("place", "shingle"))
        own = staged(spots.filter(F.col("step") == step).drop("step"), "benchmark-shingles")
        hits = places.join(own, "shingle").select("row", "m", (F.col("place") - F.col("at")).alias("start"))
        hits = hits.distinct().withColumn("step", F.lit(step))
        found = hits if found is None else found.union(hits)
    if found is None:
        return rows.select("row").limit(0).select("row", F.lit(None).cast(benchmark.schema[item_key].dataType).alias("item_id"),
                                           F.lit(0).alias("start"), F.lit(0.0).alias("similarity"))
    found = staged(found, "benchmark-hits")
    lists = found.groupBy("row").agg(F.collect_list(F.struct("m", "step", "start")).alias("spots"))
    clamped = F.array_distinct(F.transform("spots", lambda s: F.struct(
        s["m"].alias("m"), s["step"].alias("step"), F.greatest(s["start"], F.lit(0)).alias("start"),
        (F.least(s["start"] + s["m"], F.size("h")) - F.greatest(s["start"], F.lit(0))).alias("words"))))
    spread = hashed.join(lists, "row").select("row", "h", F.explode(clamped).alias("s")).select("row", "h", "s.*")
    # A window cut by the document's edge has fewer shingles than the item, and no more of them can be shared.
    inside = spread.filter((F.col("words") >= F.col("step")) &
                           (F.col("words") - F.col("step") + 1 >= F.lit(least) * (F.col("m") - F.col("step") + 1) - 1e-9))
    windows = inside.select("row", "m", "step", "start", "words", F.slice("h", F.col("start") + 1, F.col("words")).alias("w"))
    windows = windows.select("row", "m", "start", "words", let(F.col("w"), lambda w: shingle_hashes(w, F.col("step"))).alias("shingles"))
    windows = staged(windows, "windows").select("*", simhash(F.col("shingles")).alias("print"))
    windows = staged(windows.select("*", weighted(F.col("shingles")).alias("marks")).drop("shingles"), "windows")

    left = windows.select("row", "m", "start", "words", "print", F.inline(blocks(F.col("print"))))
    right = items.select("item_id", "m", F.col("print").alias("item_print"), F.inline(blocks(F.col("print"))))
    near = left.join(right, ["m", "block", "bits"]).filter(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
    pairs = near.select("row", "m", "start", "words", "item_id").distinct()
    both = pairs.join(windows.select("row", "m", "start", "words", "marks"), ["row", "m", "start", "words"])
    both = both.join(items.select("item_id", F.col("marks").alias("item_marks")), "item_id")
    shared = F.size(F.array_intersect("marks", "item_marks"))
    total = F.size("marks") + F.size("item_marks")
    scored = both.select("row", "item_id", "start", (shared / (total - shared)).alias("similarity")).filter(F.col("similarity") >= least)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("first"))).alias("best")
    return scored.groupBy("row", "item_id").agg(best).select(
        "row", "item_id", (-F.col("best.first")).alias("start"), F.col("best.similarity").alias("similarity"))
