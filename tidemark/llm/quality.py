"""Quality by weak supervision: rules vote, and expectation-maximisation weighs their votes.

Each rule says good (1), bad (-1) or abstains (0).  Rules are taken as independent given the true
class.  Documents are counted by their pattern of votes, at most 3 to the number of rules, and the
expectation-maximisation runs over these patterns: the posterior of a pattern, then each rule's
rates of voting good and bad in either class, until the likelihood settles.  A document is kept if
its pattern's posterior of being good is high enough; no single rule can reject it.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import WORD, let, staged, whole_text

WINDOW = 8
#: Words that running text of the covered languages cannot do without (fixed values).
STOP_WORDS = (
    "the be to of and that have with a in is for on it as "
    "der die das und ist nicht mit ein zu von "
    "le la les de et que un une dans est "
    "el los que y en un una por con"
).split()


def repeated_window_words(words: Column, size: int = WINDOW) -> Column:
    """Words covered by windows of ``size`` words that start at two or more places of the same array."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    places = F.sequence(F.lit(1), F.size(words) - size + 1)
    windows = let(hashed, lambda h: F.transform(places, lambda i: F.xxhash64(F.slice(h, i, size))))
    covered = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h, size)))
    return F.when(F.size(words) <= size, F.lit(0)).otherwise(covered)


def _covered(hashes: Column, size: int) -> Column:
    """Neighbours in the order of (hash, place) that agree mark repeated starts; then the starts' windows are united."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    starts = let(pairs, lambda p: F.filter(F.transform(p, lambda x, k: F.when(
        F.coalesce(F.get(p, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(p, k + 1)["h"] == x["h"], F.lit(False)),
        x["i"])), lambda i: i.isNotNull()))
    return F.aggregate(
        F.sort_array(starts),
        F.struct(F.lit(-size).alias("last"), F.lit(0).alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(size), i - a["last"])).alias("n")),
        lambda a: a["n"],
    )


def measures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and exact counts over the whole text; a missing text has no words."""
    rows = docs.select(F.col(key).alias("key"), whole_text(text).alias("text"))
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(0))
    lines = F.filter(F.split("text", "\n", -1), lambda line: line.rlike(WORD))
    of_words = let(words, lambda w: F.struct(
        F.size(w).alias("n_words"), repeated_window_words(w).alias("n_repeat_words"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).alias("n_stop")))
    of_lines = let(lines, lambda x: F.struct(
        F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    counted = rows.select(
        "key", of_words.alias("w"), of_lines.alias("l"),
        F.char_length(F.translate("text", " \t\n\x0b\x0c\r", "")).alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", "#*$%&|<>", ""))).alias("n_symbols"),
        F.regexp_count("text", F.lit(r"[.!?](?=[\x20\x09-\x0D]|$)")).alias("n_ends"),
    )
    numbers = ("w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "l.n_lines", "w.n_repeat_words", "w.n_stop", "n_ends")
    return counted.select(F.col("key").alias(key), *[F.col(c).cast("long").alias(c.rpartition(".")[2]) for c in numbers])


def vote(value: Column, good: Column, bad: Column) -> Column:
    return F.when(value.isNull(), 0).when(good, 1).when(bad, -1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes from the columns of ``measures``; every rule abstains between its two bounds and where it has no basis."""
    n = F.col("n_words")
    mean_chars, symbols = F.try_divide("word_chars", "n_words"), F.try_divide("n_symbols", "n_words")
    doubled, repeated = F.try_divide("n_dup_lines", "n_lines"), F.try_divide("n_repeat_words", "n_words")
    stops, ends = F.try_divide("n_stop", "n_words"), F.try_divide("n_ends", "n_words")
    return {
        "length": vote(n, n >= 50, n < 30),
        "word_length": vote(mean_chars, mean_chars.between(3, 9), ~mean_chars.between(2.5, 12)),
        "symbols": vote(symbols, symbols <= 0.02, symbols > 0.1),
        "lines": vote(doubled, doubled <= 0.05, doubled > 0.3),
        "repeats": vote(repeated, repeated <= 0.05, repeated > 0.2),
        "stop_words": vote(stops, stops >= 0.08, stops < 0.02),
        "sentences": vote(ends, ends.between(0.01, 0.25), ~ends.between(0.002, 0.5)),
    }


def posterior(voted: DataFrame, names: list[str], *, prior: float = 0.8, accuracy: float = 0.8, rounds: int = 20,
              tolerance: float = 1e-5) -> tuple[Column, dict]:
    """Probability of good from the vote columns ``names``, fitted on all rows; also the fitted numbers.

    Starts from rules that are right with ``accuracy`` when they vote.  Every round is one sum over the table of
    vote patterns; the driver holds four rates for each rule.  An empty table leaves the starting values.
    """
    patterns = staged(voted.groupBy(*names).agg(F.count(F.lit(1)).alias("n")), "vote-patterns")
    rates = {r: {+1: (accuracy * 0.9, (1 - accuracy) * 0.9), -1: ((1 - accuracy) * 0.9, accuracy * 0.9)} for r in names}
    share, last = prior, -math.inf
    for _ in range(rounds):
        good = _good(names, rates, share)
        seen = patterns.select("*", good.alias("p"), _evidence(names, rates, share).alias("e"))
        sums = [F.sum("n").alias("n"), F.sum(F.col("n") * F.col("p")).alias("good"), F.sum(F.col("n") * F.col("e")).alias("fit")]
        for k, r in enumerate(names):
            for v, tag in ((1, "up"), (-1, "down")):
                hit = F.when(F.col(r) == v, F.col("n")).otherwise(0)
                sums += [F.sum(hit * F.col("p")).alias(f"g_{tag}_{k}"), F.sum(hit * (1 - F.col("p"))).alias(f"b_{tag}_{k}")]
        row = seen.agg(*sums).first()
        if not row["n"]:
            break
        n, n_good = row["n"], row["good"]
        # One document's worth of smoothing keeps every rate inside (0, 1).
        share = (n_good + prior) / (n + 1)
        for k, r in enumerate(names):
            rates[r] = {v: (((row[f"g_{tag}_{k}"] or 0) + 0.3) / (n_good + 1), ((row[f"b_{tag}_{k}"] or 0) + 0.3) / (n - n_good + 1))
                        for v, tag in ((1, "up"), (-1, "down"))}
        if abs(row["fit"] - last) <= tolerance * n:
            break
        last = row["fit"]
    return _good(names, rates, share), {"share": share, "rates": rates}


def _log(names: list[str], rates: Mapping, share: float, which: int) -> Column:
    total = F.lit(math.log(share if which == 0 else 1 - share))
    for r in names:
        up, down = rates[r][1][which], rates[r][-1][which]
        still = max(1e-9, 1 - up - down)
        total = total + F.when(F.col(r) == 1, math.log(up)).when(F.col(r) == -1, math.log(down)).otherwise(math.log(still))
    return total


def _good(names: list[str], rates: Mapping, share: float) -> Column:
    return 1 / (1 + F.exp(_log(names, rates, share, 1) - _log(names, rates, share, 0)))


def _evidence(names: list[str], rates: Mapping, share: float) -> Column:
    a, b = _log(names, rates, share, 0), _log(names, rates, share, 1)
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def quality(docs: DataFrame, *, least: float = 0.5, min_words: int = 20, repeat_percent: int = 30, key: str = "doc_id",
            text: str = "text") -> DataFrame:
    """``key``, the counts, each rule's vote, ``base_failed``, ``probability`` and ``kept``.

    ``base_failed``: fewer than ``min_words`` words, or more than ``repeat_percent`` of them in repeated windows; such
    rows are never kept.  Missing and empty texts have no words and fail; repeated rows are judged each; an empty
    table gives an empty result.  Votes are fitted on all rows that pass the base.
    """
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    voting = rules()
    counted = measures(docs, key, text).withColumn("base_failed", base)
    voted = staged(counted.select("*", *[v.alias(f"vote_{r}") for r, v in voting.items()]), "quality-votes")
    names = [f"vote_{r}" for r in voting]
    good, _ = posterior(voted.filter(~F.col("base_failed")), names)
    return voted.withColumn("probability", good).withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= least))
