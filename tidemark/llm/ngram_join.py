"""Groups of documents whose word shingles overlap, by an adaptive prefix join.

Two sets of sizes a and b with Jaccard similarity of at least s share at least ceil(s * max(a, b))
shingles.  With the rarest shingles first, the first n - ceil(s * n) + l shingles of both sets must
then have l in common, for any l.  Each document takes the l that its estimated candidate cost
asks for: a longer prefix costs more postings, but every candidate must show more of them, so
fewer sets are compared.  A pair is compared if it shares the smaller of its two l in its prefixes.

Shingles that only one document has cannot match.  They come first in the order, and a document
with too few others has no partner and leaves before any pair is made.  Equal sets are joined
through their first document.  Pairs inside a group that is connected already are not needed:
rounds of comparisons with hubs come first, then all remaining pairs of different groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.census import Answers, all_windows, bucket_bits, chunked, repeated
from tidemark.llm.shared import run_hashes, staged, window_hashes, word_hashes

#: Matches that a prefix may be lengthened for.
MOST_MATCHES = 8
#: Cost of comparing one shingle of a candidate, in postings read.
COMPARE = 0.1
#: Rounds with hubs end when the remaining pairs are no more than this many times the postings.
FEW = 4
ROUNDS = 12

SETS = ("row long, key long, n long, sign long, sign2 long, l int, prefix array<long>, tokens array<long>, text string, carry {carry}")


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and row of every shingle (a row with fewer words is one shingle), and the words of each row."""
    words, _, _, before = word_hashes(texts, lower=True)
    counts = np.diff(before)
    row = np.repeat(np.arange(len(counts)), counts)
    hashes = window_hashes(words, size)
    inside = row[: len(hashes)] == row[size - 1:] if len(hashes) else np.zeros(0, bool)
    short = np.flatnonzero((counts > 0) & (counts < size))
    small = run_hashes(words, before[:-1][short], before[1:][short])
    at = np.concatenate([row[: len(hashes)][inside], short])
    order = np.argsort(at, kind="stable")
    return np.concatenate([hashes[inside], small])[order], at[order], counts


def _prefix(n: int, percent: int, ordered_counts: np.ndarray) -> tuple[int, int]:
    """Matches asked for and repeated shingles in the prefix, by the cheapest estimate."""
    need = -(-percent * n // 100)
    reach = len(ordered_counts) - need  # the prefix has ``reach`` + l shingles that others have
    most = min(MOST_MATCHES, need)
    read = np.cumsum(ordered_counts - 1.0)
    best = None
    for l in range(1, most + 1):
        postings = read[reach + l - 1]
        cost = postings + COMPARE * n * postings / l  # at most postings / l documents show l matches
        if best is None or cost < best[0]:
            best = cost, l, reach + l
    return best[1], best[2]


def _sets(chunks: DataFrame, answers: DataFrame, size: int, percent: int) -> DataFrame:
    """A row for each document: set size and signature; prefix and repeated shingles where it can have partners."""
    kind = SETS.format(carry=chunks.schema["carry"].dataType.simpleString())

    def make(docs: pa.Table, back: pa.Table) -> pa.Table:
        docs = docs.sort_by("row").combine_chunks()
        text = docs.column("text")
        text = pa.concat_arrays(text.chunks) if text.num_chunks != 1 else text.chunk(0)
        found = Answers(back)
        hashes, row, _ = shingles(text, size)
        out = []
        edges = np.searchsorted(row, np.arange(docs.num_rows + 1))
        for k in range(docs.num_rows):
            own = np.unique(hashes[edges[k]:edges[k + 1]])
            place = found.find(own)
            shared = place >= 0
            n, m = len(own), int(shared.sum())
            if n == 0 or m < -(-percent * n // 100):
                out.append((n, 0, 0, None, None, None))
                continue
            counts = found.counts[place[shared]]
            order = np.lexsort((own[shared], counts))
            tokens = own[shared][order].view(np.int64)
            l, length = _prefix(n, percent, counts[order])
            out.append((n, int(np.bitwise_xor.reduce(own).view(np.int64)), int(own.sum(dtype=np.uint64).view(np.int64)), l,
                        tokens[:length], tokens))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        made = [pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds]
        return pa.table([docs.column("row"), docs.column("key"), *made, text.cast(pa.string()), docs.column("carry")], names=[x.split()[0] for x in NAMES])

    sides = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk"))
    return staged(sides.applyInArrow(make, kind), "shingle-sets", free=True)


NAMES = ("row", "key", "n", "sign", "sign2", "l", "prefix", "tokens", "text", "carry")


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node``, ``label``: the smallest node that edges ``a``, ``b`` reach; one staged table for each round.

    Every round takes the smallest label of the neighbours and then the label's own label, so paths halve.
    """
    both = staged(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "links")
    labels = staged(nodes.select("node", F.col("node").alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"], "left").select(
            "node", F.least("label", F.coalesce("near", "label")).alias("next"), F.col("label").alias("old"))
        up = lower.select(F.col("node").alias("of"), F.col("next").alias("top"))
        jumped = lower.join(up, lower["next"] == up["of"]).select("node", F.least("next", "top").alias("label"), "old")
        step = staged(jumped, "labels")
        changed = step.filter(F.col("label") != F.col("old")).limit(1).count()
        labels = step.select("node", "label")
        if not changed:
            return labels


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a``, ``b`` whose whole sets are similar enough."""
    def side(name: str) -> DataFrame:
        return sets.select(F.col("row").alias(name), F.col("n").alias(f"n_{name}"), F.col("tokens").alias(f"t_{name}"))

    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("t_a", "t_b"))
    linked = 100 * F.col("shared") >= percent * (F.col("n_a") + F.col("n_b") - F.col("shared"))
    return staged(both.withColumn("shared", shared).filter(linked).select("a", "b"), "verified")


def _may_link(x: str, y: str, percent: int) -> Column:
    """Can two sets that share a token reach the similarity, by their sizes and the token's places in them?

    Before the token they share at most as many as the shorter part has, after it likewise.
    """
    n_x, n_y, m_x, m_y, at_x, at_y = (F.col(f"{c}{side}") for c in ("n", "m", "at") for side in (x, y))
    most = F.least(at_x, at_y) + F.least(m_x - at_x, m_y - at_y)
    return (100 * F.least(n_x, n_y) >= percent * F.greatest(n_x, n_y)) & ((100 + percent) * most >= percent * (n_x + n_y))


def _in_prefix(x: str, y: str, percent: int) -> Column:
    """Is the token in the prefixes that this very pair needs?  They are shorter than those for partners of any size."""
    n_x, n_y, l_x, l_y = (F.col(f"{c}{side}") for c in ("n", "l") for side in (x, y))
    room = (100 + percent) * F.least(l_x, l_y) - percent * (n_x + n_y)
    return F.greatest(*[(100 + percent) * (F.col(f"at{side}") - F.col(f"m{side}")) for side in (x, y)]) < room


def linked_groups(docs: DataFrame, size: int = 4, percent: int = 85, *, key: str = "doc_id", text: str = "text",
                  carry: list[str] = ()) -> DataFrame:
    """``key``, n_shingles, component_id, first (is this the row that stands for its group), text, ``carry``, for every row.

    A set holds the distinct shingles of ``size`` words, A-Z in lower case; a text with fewer words is one shingle,
    one without words (or missing) has none and is linked with nothing.  Rows link if 100 * shared >= ``percent``
    * united; a group's id is its smallest key.  Repeated rows are linked as equal texts; a row without a key can be
    linked and its group's id is the smallest key there is in it; an empty table gives an empty result.
    """
    chunks = chunked(docs, key, text, list(carry))

    def all_shingles(texts: pa.Array, keys: pa.Array):
        hashes, row, _ = shingles(texts, size)
        return hashes, row

    answers = repeated(all_windows(chunks, all_shingles, bucket_bits(chunks)))
    sets = _sets(chunks, answers, size, percent)
    possible = sets.filter(F.col("l").isNotNull())
    # Equal sets: one row stands for all.
    same = staged(possible.groupBy("sign", "sign2", "n").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("copies")), "equal-sets")
    members = staged(possible.select("row", "sign", "sign2", "n").join(same, ["sign", "sign2", "n"]).select("row", "rep"), "members")
    alone = staged(possible.join(same.select(F.col("rep").alias("row")), "row", "left_semi").select("row", "n", "l", "prefix", "tokens"),
                   "distinct-sets")
    label = _groups(alone, percent)
    grouped = members.join(label.withColumnRenamed("node", "rep"), "rep").select("row", "label")
    labelled = sets.select("row", "key", "n", "text", "carry").join(grouped, "row", "left").withColumn("label", F.coalesce("label", "row"))
    # Rows ascend with the key, so a group's first row has its smallest key; only rows without a key come before.
    ids = grouped.join(sets.select("row", "key"), "row").groupBy("label").agg(F.min("key").alias("id"))
    return labelled.join(ids, "label", "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("id", "key").alias("component_id"),
        (F.col("row") == F.col("label")).alias("first"), "text", "carry")


def _groups(sets: DataFrame, percent: int) -> DataFrame:
    """``node``, ``label`` of distinct sets."""
    nodes = sets.select(F.col("row").alias("node"))
    whole = sets.select("row", "n", "l", F.size("tokens").alias("m"), F.posexplode("prefix").alias("at", "token"))
    postings = staged(whole, "postings")
    counts = postings.groupBy("token").count().filter("count > 1").select("token")
    postings = staged(postings.join(counts, "token"), "postings")
    size, links, labels, left = postings.count(), None, nodes.select("node", F.col("node").alias("label")), None
    for turn in range(ROUNDS):
        open_ = postings.join(labels, postings["row"] == labels["node"]).select("row", "n", "l", "m", "at", "token", "label")
        # Tokens with one group only have nothing left to find.
        spread = open_.groupBy("token", "label").agg(F.count(F.lit(1)).alias("g"))
        spread = spread.groupBy("token").agg(F.count(F.lit(1)).alias("groups"), F.sum("g").alias("all"), F.sum(F.col("g") * F.col("g")).alias("own"))
        live = staged(spread.filter("groups > 1"), "live-tokens")
        pairs = live.agg(F.sum((F.col("all") * F.col("all") - F.col("own")) / 2)).first()[0] or 0
        open_ = staged(open_.join(live.select("token"), "token"), "open")
        if pairs <= FEW * max(size, 1) or left is not None and pairs > 0.9 * left:
            break
        left = pairs
        # A hub for each token: its first row, then rows drawn by hash; a row takes the hub it shares most tokens with.
        order = F.col("row") if turn == 0 else F.xxhash64("row", F.lit(turn))
        hubs = open_.groupBy("token").agg(F.min(F.struct(order.alias("o"), F.col("row").alias("hub"), F.col("n").alias("n_hub"),
                                                         F.col("m").alias("m_hub"), F.col("at").alias("at_hub"),
                                                         F.col("label").alias("hub_label"))).alias("h")).select("token", "h.*")
        meet = open_.join(hubs, "token").filter((F.col("label") != F.col("hub_label")) & _may_link("", "_hub", percent))
        best = meet.groupBy("row", "hub").count().groupBy("row").agg(F.max(F.struct("count", "hub")).alias("h"))
        tried = best.select(F.least("row", "h.hub").alias("a"), F.greatest("row", "h.hub").alias("b")).distinct()
        links, labels = _joined(links, _verified(tried, sets, percent), nodes)
    def side(name: str) -> DataFrame:
        return open_.select("token", F.col("row").alias(name), F.col("label").alias(f"g_{name}"),
                            *[F.col(c).alias(f"{c}_{name}") for c in ("n", "l", "m", "at")])

    met = side("a").join(side("b"), "token").filter((F.col("a") < F.col("b")) & (F.col("g_a") != F.col("g_b")) & _may_link("_a", "_b", percent)
                                                & _in_prefix("_a", "_b", percent))
    enough = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("met"), F.first(F.least("l_a", "l_b")).alias("l")).filter("met >= l")
    return _joined(links, _verified(enough, sets, percent), nodes)[1]


def _joined(links: DataFrame | None, more: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    links = more if links is None else links.union(more)
    return links, components(links, nodes)
