"""Quality rules by weak supervision, in DataFrame functions only.

Rules vote +1 (good), -1 (bad) or abstain (0).  Expectation-maximisation over
the counts of vote patterns estimates each rule's error rates and the share of
good documents without labels; a document's posterior replaces the conjunction
of all rules.  Rules overlap on purpose: several see each kind of defect, so
bad votes that agree speak for a bad document, and a rule whose bad votes mostly
stand alone is found to be noisy and cannot reject a document by itself.

Priors are pseudo-documents in proportion to the corpus, so that they weigh the
same at every size; nothing is clamped.  The pattern table has at most
3**len(rules) rows whatever the corpus size, so it alone comes to the driver;
every document that passes the base rules is counted in it, since the others are
decided without votes.

Nulls and empty texts have no words and fail the base rules.  Rows that repeat a
doc_id, and rows without one, are judged one by one.  An empty table gives an
empty one.  Other columns of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from enclosa.llm.common import Shared

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Rounds of EM at most, the change at which it has settled, and the share of good documents that it starts from.
ROUNDS, SETTLED, PRIOR = 500, 1e-9, 0.6
#: What a rule is believed to do before votes are seen: P(bad vote | good) and P(bad vote | bad) among the votes it casts.
FALSE_ALARM, SEEN = 0.01, 0.4
#: Pseudo-documents for each document, for these two and for the share of good ones.
ALARM_WEIGHT, SEEN_WEIGHT, PRIOR_WEIGHT = 0.1, 0.001, 0.001
RULES = ("symbols", "shouting", "repeats", "word_length", "bangs", "stops", "marks", "variety", "lines", "length")
#: ASCII that is neither letter nor space.
MARKS = "!\"#$%&'()*+,-./0123456789:;<=>?@[\\]^_`{|}~"


def _without(c: Column, chars: str) -> Column:
    """``c`` without these characters: one byte search each, which costs less than a pattern."""
    for x in chars:
        c = F.replace(c, F.lit(x), F.lit(""))
    return c


def measured(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, the base counts, and what the rules look at.  One row a document, no shuffle.

    A window is known by a 64-bit hash of its words' hashes.  Only texts in which
    a window repeats sort their windows to find the places.
    """
    d = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    blank = F.col("t")
    for x in SPACES[1:]:
        blank = F.replace(blank, F.lit(x), F.lit(" "))
    d = d.withColumn("words", F.array_remove(F.split(blank, " "), ""))
    d = d.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    d = d.withColumn("n_words", F.size("words").cast("long")).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    d = d.withColumn("grams", F.expr(
        f"CASE WHEN n_words >= {WINDOW} THEN transform(sequence(0, CAST(n_words AS INT) - {WINDOW}), "
        "i -> xxhash64(" + ", ".join(f"hashes[i + {j}]" for j in range(WINDOW)) + ")) ELSE CAST(array() AS ARRAY<BIGINT>) END"))
    d = d.withColumn("places", F.expr(
        "CASE WHEN size(array_distinct(grams)) < size(grams) THEN sort_array(transform(grams, (h, i) -> named_struct('h', h, 'i', i))) END"))
    d = d.withColumn("again", F.expr(
        "sort_array(transform(filter(places, (g, k) -> g.h = get(places, k - 1).h OR g.h = get(places, k + 1).h), g -> g.i))"))
    length = F.length("t")
    return d.select(
        "doc_id",
        "n_words",
        F.length(_without(F.col("t"), SPACES)).cast("long").alias("word_chars"),
        (length - F.length(_without(F.col("t"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(f"""coalesce(aggregate(again, named_struct('last', -{WINDOW}, 'n', 0L),
            (s, p) -> named_struct('last', p, 'n', s.n + least({WINDOW}, p - s.last)), s -> s.n), 0L)""").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (length - F.length(F.regexp_replace("t", r"\p{Lu}", ""))).cast("long").alias("n_upper"),
        (length - F.length(_without(F.col("t"), "!"))).cast("long").alias("n_bangs"),
        (length - F.length(_without(F.col("t"), ".?"))).cast("long").alias("n_stops"),
        (length - F.length(F.translate("t", MARKS, ""))).cast("long").alias("n_marks"),
        F.size(F.array_distinct("hashes")).cast("long").alias("n_kinds"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), -1).when(F.coalesce(good, F.lit(False)), 1).otherwise(0)


def votes() -> dict[str, Column]:
    """The vote of each rule; a rule abstains between its two bounds."""
    w, c, lines = F.col("n_words"), F.col("word_chars"), F.col("n_lines")
    stops, marks, kinds = F.col("n_stops"), F.col("n_marks"), F.col("n_kinds")
    return {
        "symbols": _vote(10 * F.col("n_symbols") > 3 * w, 50 * F.col("n_symbols") <= w),
        "shouting": _vote(2 * F.col("n_upper") > c, 5 * F.col("n_upper") < c),
        "repeats": _vote((2 * F.col("n_dup_lines") > lines) | (10 * F.col("n_repeat_words") > w), 50 * F.col("n_repeat_words") <= w),
        "word_length": _vote((c < 3 * w) | (2 * c > 13 * w), (c >= 4 * w) & (c <= 6 * w)),
        "bangs": _vote(4 * F.col("n_bangs") > w, 50 * F.col("n_bangs") <= w),
        "stops": _vote((25 * stops < w) | (5 * stops > w), (20 * stops >= w) & (8 * stops <= w)),
        "marks": _vote(100 * marks > 8 * c, 100 * marks <= 5 * c),
        "variety": _vote(2 * kinds < w, 3 * kinds >= 2 * w),
        "lines": _vote(w < 12 * lines, (w >= 20 * lines) & (w <= 80 * lines)),
        "length": _vote(w < 40, w >= 80),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS, prior: float = PRIOR) -> dict:
    """EM over (votes, documents) patterns.

    Returns the share of good documents and, for each rule, P(vote | good) and
    P(vote | bad) among the votes that it casts; abstaining says nothing.  The
    beliefs above count as pseudo-documents.  Without documents the start values
    come back.
    """
    rules = len(patterns[0][0]) if patterns else len(RULES)
    believed = prior
    start = {1: {1: 1 - FALSE_ALARM, -1: FALSE_ALARM}, -1: {1: 1 - SEEN, -1: SEEN}}
    table = [{y: dict(start[y]) for y in (1, -1)} for _ in range(rules)]
    total = sum(n for _, n in patterns)
    weight = {1: ALARM_WEIGHT * total, -1: SEEN_WEIGHT * total}
    for _ in range(rounds if total else 0):
        good = 0.0
        counts = [{y: {v: weight[y] * start[y][v] for v in (1, -1)} for y in (1, -1)} for _ in range(rules)]
        for vote, n in patterns:
            q = posterior(prior, table, vote)
            good += q * n
            for k, v in enumerate(vote):
                if v:
                    counts[k][1][v] += q * n
                    counts[k][-1][v] += (1 - q) * n
        prior, before = (good + PRIOR_WEIGHT * total * believed) / (total + PRIOR_WEIGHT * total), prior
        last, table = table, []
        for c in counts:
            table.append({y: {v: c[y][v] / (c[y][1] + c[y][-1]) for v in (1, -1)} for y in (1, -1)})
        moved = max(abs(t[y][-1] - o[y][-1]) for t, o in zip(table, last, strict=True) for y in (1, -1))
        if max(moved, abs(prior - before)) < SETTLED:
            break
    return {"prior": prior, "table": table}


def posterior(prior: float, table: list, vote: tuple[int, ...]) -> float:
    z = math.log(prior / (1 - prior)) + sum(math.log(t[1][v] / t[-1][v]) for t, v in zip(table, vote, strict=True) if v)
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def accuracies(model: dict) -> list[float]:
    """For each rule, how often it is right when it votes."""
    out = []
    for t in model["table"]:
        right = model["prior"] * t[1][1] + (1 - model["prior"]) * t[-1][-1]
        wrong = model["prior"] * t[1][-1] + (1 - model["prior"]) * t[-1][1]
        out.append(right / (right + wrong) if right + wrong else 0.5)
    return out


def weak_supervision(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """doc_id, base counts, base_failed, quality (posterior), bad_votes and kept for every row of ``docs``."""
    named = votes()
    shared = Shared(docs.sparkSession, "quality-rules")
    d = shared.keep(measured(docs, text, key), "measured")  # texts are read once; a few numbers a document are kept
    seen = d.where(~base_failed()).groupBy(*[v.alias(k) for k, v in named.items()]).count().collect()
    model = fit(sorted((tuple(r[k] for k in named), r["count"]) for r in seen))
    z, bad = F.lit(math.log(model["prior"] / (1 - model["prior"]))), F.lit(0)
    for v, t in zip(named.values(), model["table"], strict=True):
        w = {x: math.log(t[1][x] / t[-1][x]) for x in (1, -1)}
        z = z + F.when(v == 1, w[1]).when(v == -1, w[-1]).otherwise(0.0)
        bad = bad + (v == -1).cast("int")
    q = 1 / (1 + F.exp(-z))
    d = d.withColumn("base_failed", base_failed()).withColumn("quality", q).withColumn("bad_votes", bad)
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality", "bad_votes"
    )
