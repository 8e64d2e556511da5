"""Quality rules: a learned decision list over text statistics, in native expressions.

Sequential covering in the manner of RIPPER: a rule is grown threshold by threshold on one
part of the labelled rows and pruned on the other, the rows it covers are set aside, and the
next rule is grown on the rest.  Only counts by feature and bin reach the driver.  The rules
become one ordered conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.session import stored

BREAK = "[ \\t-\\r]+"  # white space between words: \x20 and \x09 to \x0D
SYMBOLS = "#*$%&|<>"
FEATURES = {
    "mean_word": "word_chars / n_words",
    "symbol_share": "n_symbols / word_chars",
    "dup_line_share": "n_dup_lines / n_lines",
    "repeat_share": "n_repeat_words / n_words",
    "shout_share": "n_shouts / word_chars",
    "line_words": "n_words / n_lines",
}
CUTS = 24  # thresholds tried for each feature and class


def statistics(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of every whole text: one row per row of ``docs``, no shuffle.

    A null text has no words and counts 0 everywhere.  Windows of three words are told apart
    by a 64-bit hash.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    split = base.select(
        "doc_id",
        F.array_remove(F.split("text", BREAK), "").alias("words"),
        F.expr("filter(split(text, '\\n'), line -> length(translate(line, ' \\t\\n\\u000b\\u000c\\r', '')) > 0)").alias("lines"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ!", ""))).cast("long").alias("n_shouts"),
    )
    counted = split.selectExpr(
        "doc_id", "n_symbols", "n_shouts", "words",
        "cast(size(words) AS long) AS n_words",
        "cast(length(array_join(words, '')) AS long) AS word_chars",
        "cast(size(lines) AS long) AS n_lines",
        "cast(size(lines) - size(array_distinct(lines)) AS long) AS n_dup_lines",
    )
    hashed = counted.withColumn(
        "windows",
        F.expr("""CASE WHEN n_words >= 3 THEN transform(sequence(0, cast(n_words AS int) - 3),
            i -> xxhash64(words[i], words[i + 1], words[i + 2])) ELSE cast(array() AS array<bigint>) END"""),
    ).drop("words")
    ordered = hashed.withColumn(
        "ordered",
        F.expr("""CASE WHEN size(array_distinct(windows)) < size(windows)
            THEN sort_array(transform(windows, (h, i) -> struct(h, i)))
            ELSE cast(array() AS array<struct<h: bigint, i: int>>) END"""),
    ).drop("windows")
    places = ordered.withColumn(
        "places",
        F.expr("""sort_array(transform(
            filter(ordered, (w, k) -> w.h <=> get(ordered, k - 1).h OR w.h <=> get(ordered, k + 1).h), w -> w.i))"""),
    ).drop("ordered")
    return places.withColumn(
        "n_repeat_words",
        F.expr("""cast(aggregate(zip_with(places, slice(places, 2, greatest(size(places), 1)),
            (a, b) -> least(3, coalesce(b - a, 3))), 0, (s, x) -> s + x) AS long)"""),
    ).drop("places").withColumn(
        "base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    )


def features(stats: DataFrame) -> DataFrame:
    """``stats`` with the features as doubles; what is divided by zero is 0."""
    return stats.select("*", *[F.expr(f"coalesce(try_divide({a.replace(' / ', ', ')}), 0D)").alias(n) for n, a in FEATURES.items()])


@dataclass
class Rule:
    """A conjunction of (feature, is_upper_bound, threshold); covered rows are rejected."""

    terms: list[tuple[str, bool, float]]
    counts: dict[str, int] = field(default_factory=dict)

    def expression(self) -> Column:
        result = F.lit(True)
        for name, upper, value in self.terms:
            result = result & (F.col(name) <= value if upper else F.col(name) > value)
        return result

    def __str__(self) -> str:
        return " AND ".join(f"{n} {'<=' if upper else '>'} {v:.6g}" for n, upper, v in self.terms)


def _bin(name: str, cuts: list[float]) -> Column:
    """How many cuts lie below the feature."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda c: c < F.col(name)))


def _matches(terms: list[tuple[int, bool, int]]) -> Column:
    result = F.lit(True)
    for k, upper, cut in terms:
        result = result & (F.col(f"b{k}") <= cut if upper else F.col(f"b{k}") > cut)
    return result


def learn_rules(
    labelled: DataFrame, *, bad: str = "quality = 0", max_rules: int = 8, max_terms: int = 3,
    precision: float = 0.8, least: int = 5, names: list[str] | None = None,
) -> list[Rule]:
    """Decision list for the rows where ``bad`` holds; no rules if either class is missing.

    ``labelled``: rows with the features, doc_id and whatever ``bad`` needs; a null label is
    left out.  A rule must cover ``least`` bad rows and reach ``precision`` over all rows that
    the rules before left.  A conjunction that does not is given up, and another one is grown
    which begins with another feature or side; covering ends where no first term has gain.
    The driver sees cuts, and counts by feature and bin.
    """
    names = names or list(FEATURES)
    rows = labelled.select("doc_id", F.expr(bad).alias("bad"), *names).where("bad IS NOT NULL")
    steps = [i / CUTS for i in range(1, CUTS)]
    found = rows.groupBy("bad").agg(*[F.percentile_approx(n, steps, 10000).alias(n) for n in names]).collect()
    if len(found) < 2:
        return []
    cuts = {n: sorted({float(v) for r in found for v in r[n] or [] if not math.isnan(v)}) for n in names}
    for n in names:  # halfway to the next, so that a threshold is no value of a row
        cuts[n] = [(a + b) / 2 for a, b in zip(cuts[n], cuts[n][1:])]
    binned = rows.select(
        "bad", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("prune"),
        *[_bin(n, cuts[n]).alias(f"b{k}") for k, n in enumerate(names)],
    )
    bins = [f"b{k}" for k in range(len(names))]
    cells = stored(binned.groupBy("prune", *bins).agg(
        F.sum(F.col("bad").cast("long")).alias("p"), F.sum((~F.col("bad")).cast("long")).alias("n")
    ))
    rules: list[Rule] = []
    left = F.lit(True)

    def counts(terms: list[tuple[int, bool, int]]) -> list:
        pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(b).alias("b")) for k, b in enumerate(bins)]))
        rows = cells.where(left & ~F.col("prune") & _matches(terms)).select("p", "n", pairs.alias("x"))
        return rows.groupBy("x.k", "x.b").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).collect()

    given_up: set[tuple[int, bool]] = set()  # features and sides that began no rule; two of each feature at most
    whole = counts([])  # of all rows that are left: the same until there is a new rule
    while len(rules) < max_rules:
        terms: list[tuple[int, bool, int]] = []
        while len(terms) < max_terms:
            table = counts(terms) if terms else whole
            term = _best_term(table, len(names), given_up if not terms else set())
            if term is None:
                break
            terms.append(term)
        if not terms:
            break
        tests = [F.struct(*[
            F.sum(F.when(_matches(terms[: i + 1]) & part, F.col(c))).alias(f"{c}{tag}")
            for c in ("p", "n") for tag, part in (("", F.col("prune")), ("_all", F.lit(True)))
        ]).alias(f"t{i}") for i in range(len(terms))]
        row = cells.where(left).agg(*tests).first()

        def worth(i: int) -> float:
            p, n = row[i]["p"] or 0, row[i]["n"] or 0
            return (p - n) / (p + n) if p + n else -1.0

        keep = max(range(len(terms)), key=lambda i: (worth(i), -i))
        p, n = row[keep]["p_all"] or 0, row[keep]["n_all"] or 0
        if p < least or p < precision * (p + n) or worth(keep) < 2 * precision - 1:
            given_up.add(terms[0][:2])
            continue
        terms = terms[: keep + 1]
        rules.append(Rule([(names[k], upper, cuts[names[k]][cut if upper else cut - 1]) for k, upper, cut in _as_values(terms)], {"bad": p, "good": n}))
        left = left & ~_matches(terms)
        given_up.clear()
        whole = counts([])
    return rules


def _as_values(terms: list[tuple[int, bool, int]]) -> list[tuple[int, bool, int]]:
    """bin <= c is value <= cuts[c]; bin > c is value > cuts[c]."""
    return [(k, upper, cut if upper else cut + 1) for k, upper, cut in terms]


def _best_term(table: list, n_features: int, barred: set[tuple[int, bool]]) -> tuple[int, bool, int] | None:
    """The threshold with the largest FOIL gain outside ``barred``, None if there is no gain."""
    p_all = sum(r["p"] for r in table if r["k"] == 0)
    n_all = sum(r["n"] for r in table if r["k"] == 0)
    if not p_all or not n_all:
        return None
    before = math.log2(p_all / (p_all + n_all))
    best, chosen = 1e-9, None
    for k in range(n_features):
        p = n = 0
        for r in sorted((r for r in table if r["k"] == k), key=lambda r: r["b"]):
            p, n = p + r["p"], n + r["n"]
            for upper, x, y in ((True, p, n), (False, p_all - p, n_all - n)):
                if x and (x, y) != (p_all, n_all) and (k, upper) not in barred:
                    gain = x * (math.log2(x / (x + y)) - before)
                    if gain > best:
                        best, chosen = gain, (k, upper, r["b"])
    return chosen


def decision(rules: list[Rule]) -> Column:
    """The number of the first rule that covers a row, from 1; null for none."""
    result = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules, 1))):
        result = F.when(rule.expression(), F.lit(i)).otherwise(result)
    return result


def judged(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """``stats`` with rule (the covering rule's number or null) and kept."""
    rows = features(stats).withColumn("rule", decision(rules))
    return rows.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()).drop(*FEATURES)


def rate(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Statistics and verdict of every document, with rules learned from ``labels``
    (doc_id, quality).  Labels without a document, and null ones, teach nothing; without
    labels there are no rules.  Rules are learned on the documents which the base rule
    passes, since only these are judged by them."""
    stats = stored(statistics(docs))
    own = labels.select(F.col("doc_id").alias("labelled_id"), "quality")
    judgeable = features(stats).where(~F.col("base_failed"))
    rules = learn_rules(judgeable.join(own, F.col("doc_id") == F.col("labelled_id")), **options)
    return judged(stats, rules)
