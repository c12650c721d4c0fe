"""Quality rules: counts of a text, fixed limits, and a decision list learned from labelled documents. DataFrame operations only.

1. Counts. Words are runs of other characters than ASCII white space. A text's windows of WINDOW words are compared by hash first; only where two
   hashes meet are the windows themselves sorted and compared, and the words covered by windows found twice or more are counted.
   Everything stays in the row: no shuffle, however long the text.
2. Limits. A text of fewer than 10 words, or of which windows found again cover over 20 % of the words, fails.
3. Learning. Of the labelled documents that pass the limits, each feature is cut at quantiles of all and of the bad ones, and the documents are
   counted by their bins: the labelled statistics. Sequential covering: a rule starts empty and grows by the threshold with the
   highest information gain for bad documents (over documents whose id does not hash to the pruning part), one aggregation a step; it is then
   cut back to the conditions that are worth most on the pruning part, and kept if enough of what it covers is bad. Covered documents
   leave, and the next rule is learned from the rest. What comes to the driver is a count for each feature and bin.
4. Verdict. The rules as an ordered conditional expression: the first one that holds drops the document, else it stays.

Defined cases: null and empty texts have no words, fail the limits and are not kept; null labels do not count; a document with several labels
counts once for each, and each row of a repeated id with all labels of that id; without bad or without good labelled documents there are
no rules, and what passes the limits is kept; rows without an id have no label, but a verdict; ties in gain go to the feature and
threshold that come first; very long texts are counted whole; an empty table gives no rows; other columns pass through if they are
carried, but for those that have the name of a new one, in whatever case, which give way.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, saved

LEAST_WORDS, MOST_REPEATED = 10, 20
WINDOW = 5
#: Cuts of each feature: quantiles of all labelled documents and of the bad ones.
CUTS = 32
#: A rule has at most so many conditions and a list so many rules; a rule is kept if at least this share of what it covers is bad.
CONDITIONS, RULES, PRECISION = 4, 16, 0.9
#: One in so many labelled documents is for pruning.
PRUNE = 3

_SPACE = r"[\x20\x09-\x0D]+"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_digits", "n_capitals", "n_stops")
NEW = (*COUNTS, "base_failed", "kept")


def _rate(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def features() -> dict[str, Column]:
    """What rules look at, from the counts."""
    return {
        "words": F.col("n_words").cast("double"),
        "characters a word": _rate("word_chars", "n_words"),
        "symbols a word": _rate("n_symbols", "n_words"),
        "share of repeated lines": _rate("n_dup_lines", "n_lines"),
        "share of repeated words": _rate("n_repeat_words", "n_words"),
        "words a line": _rate("n_words", "n_lines"),
        "share of digits": _rate("n_digits", "word_chars"),
        "share of capitals": _rate("n_capitals", "word_chars"),
        "stops a word": _rate("n_stops", "n_words"),
    }


def counted(docs: DataFrame, *, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The carried columns (all if none are named) as _row, with COUNTS, all long."""
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in NEW]
    text = F.col("_text")
    read = docs.select(F.struct(*map(quoted, carry)).alias("_row"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("_text"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    split = read.select(
        "_row", F.array_remove(F.split(text, _SPACE), "").alias("_words"), lines.alias("_lines"),
        of(r"[#*$%&|<>]").alias("n_symbols"), of(r"[0-9]").alias("n_digits"), of(r"\p{Lu}").alias("n_capitals"), of(r"[.!?]").alias("n_stops"),
    )
    places = F.sequence(F.lit(0), F.size("_words") - WINDOW)
    hashes = F.transform(places, lambda i: F.xxhash64(*(F.get("_words", i + k) for k in range(WINDOW))))
    sized = split.select(
        "*", F.size("_words").cast("long").alias("n_words"), F.length(F.array_join("_words", "")).cast("long").alias("word_chars"), F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), F.when(F.size("_words") > WINDOW, hashes).alias("_hashes"),
    ).drop("_lines")
    again = sized.withColumn("_again", F.coalesce(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), F.lit(False))).drop("_hashes")
    window = lambda i: F.struct(F.array_join(F.slice("_words", i + 1, WINDOW), " ").alias("w"), i.alias("i"))
    windows = again.withColumn("_windows", F.when(F.col("_again"), F.sort_array(F.transform(places, window))))
    same = lambda x, k: F.coalesce(x["w"] == F.get("_windows", k)["w"], F.lit(False))
    found = windows.withColumn("_found", F.sort_array(F.transform(F.filter("_windows", lambda x, k: same(x, k + 1) | ((k > 0) & same(x, F.greatest(k - 1, F.lit(0))))), lambda x: x["i"])))
    steps = F.transform("_found", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_found", k + 1) - x, F.lit(WINDOW))).cast("long"))
    covered = F.coalesce(F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b), F.lit(0).cast("long"))
    return found.withColumn("n_repeat_words", covered).select("_row", *COUNTS)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = features()[self.feature]
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


@dataclass(frozen=True)
class Rule:
    """Drop where all conditions hold; bad and good are the labelled documents that it covered when it was learned."""

    conditions: tuple[Condition, ...]
    bad: float
    good: float

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return f"drop if {' and '.join(map(str, self.conditions))} ({self.bad:g} bad, {self.good:g} good)"


def verdict(rules: list[Rule]) -> Column:
    """True if the document stays: one conditional in the order of the rules."""
    out = F.when(F.lit(False), F.lit(False))
    for rule in rules:
        out = out.when(rule.column(), F.lit(False))
    return out.otherwise(F.lit(True))


def labelled(rows: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """Rows that have a label, with the numbers of their labels, bad (0) and good (1); the labels are summed by id first."""
    value = quoted(label_col).cast("int")
    votes = labels.where(value.isin(0, 1) & quoted(label_id_col).isNotNull()).groupBy(quoted(label_id_col).alias("_labelled"))
    votes = votes.agg(F.sum(F.when(value == 0, 1.0).otherwise(0.0)).alias("bad"), F.sum(F.when(value == 1, 1.0).otherwise(0.0)).alias("good"))
    joined = rows.join(votes, rows["_row"][id_col] == votes["_labelled"])
    return joined.withColumn("prune", F.pmod(F.xxhash64("_labelled", F.lit(13)), F.lit(PRUNE)) == 0).drop("_labelled")


def statistics(rows: DataFrame) -> tuple[DataFrame, dict[str, list[float]]]:
    """Labelled rows counted by the bins of their features, and the cuts: bin b lies above b of the cuts."""
    names, values = list(features()), list(features().values())
    shares = F.array(*(F.lit(i / CUTS) for i in range(CUTS)))
    ask = lambda v: (F.percentile_approx(v, shares, 10_000), F.percentile_approx(F.when(F.col("bad") > 0, v), shares, 10_000))
    found = rows.agg(*(q for v in values for q in ask(v))).first()
    cuts = {n: sorted({float(x) for part in found[2 * i : 2 * i + 2] for x in part or []}) for i, n in enumerate(names)}
    bin_of = lambda v, c: F.size(F.filter(F.array(*map(F.lit, c)).cast("array<double>"), lambda x: v > x)).cast("int")
    bins = F.array(*(bin_of(v, cuts[n]) for n, v in zip(names, values, strict=True)))
    cells = rows.select(bins.alias("bins"), "prune", "bad", "good").groupBy("bins", "prune").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    return saved(cells, "decision-list"), cuts


def _holds(step: tuple[int, bool, int]) -> Column:
    feature, above, cut = step
    value = F.col("bins")[feature]
    return value > cut if above else value <= cut  # above cut number c (from 0) are the bins over c


def _all(steps: list[tuple[int, bool, int]]) -> Column:
    out = F.lit(True)
    for s in steps:
        out = out & _holds(s)
    return out


def _counts(cells: DataFrame) -> dict[tuple[int, bool], dict[int, tuple[float, float]]]:
    """Bad and good by (feature, part) and bin."""
    out: dict[tuple[int, bool], dict[int, tuple[float, float]]] = {}
    long = cells.select("prune", "bad", "good", F.posexplode("bins").alias("feature", "bin"))
    for feature, part, b, bad, good in long.groupBy("feature", "prune", "bin").agg(F.sum("bad"), F.sum("good")).collect():
        out.setdefault((feature, part), {})[b] = (bad, good)
    return out


def _side(bins: dict[int, tuple[float, float]], above: bool, cut: int) -> tuple[float, float]:
    chosen = [v for b, v in bins.items() if (b > cut) == above]
    return sum(v[0] for v in chosen), sum(v[1] for v in chosen)


def _gain(bad: float, good: float, all_bad: float, all_good: float) -> float:
    if not bad:
        return -math.inf
    return bad * (math.log2(bad / (bad + good)) - math.log2(all_bad / (all_bad + all_good)))


def grown(cells: DataFrame, cuts: dict[str, list[float]]) -> tuple[list[tuple[int, bool, int]], float, float]:
    """One rule from the cells that no rule covers yet, pruned, and the bad and good that it covers."""
    names, steps = list(cuts), []
    worth: list[tuple[float, float, float]] = []  # of each prefix: on the pruning part, and what is covered in all
    while len(steps) < CONDITIONS:
        counts = _counts(cells.where(_all(steps)))
        whole = lambda part: _side(counts.get((0, part), {}), True, -1)
        bad, good = whole(False)
        if not bad or not good:
            break
        options = [(f, above, c) for f in range(len(names)) for c in range(len(cuts[names[f]])) for above in (True, False)]
        scored = [(_gain(*_side(counts.get((f, False), {}), above, c), bad, good), -i) for i, (f, above, c) in enumerate(options)]
        best, place = max(scored, default=(-math.inf, 0))
        if best <= 1e-9:
            break
        f, above, c = options[-place]
        steps.append((f, above, c))
        pruned, kept = _side(counts.get((f, True), {}), above, c), _side(counts.get((f, False), {}), above, c)
        worth.append(((pruned[0] - pruned[1]) / (sum(pruned) or 1.0), pruned[0] + kept[0], pruned[1] + kept[1]))
    if not steps:
        return [], 0.0, 0.0
    at = max(range(len(steps)), key=lambda i: (worth[i][0], worth[i][1], -i))
    return steps[: at + 1], worth[at][1], worth[at][2]


def learned(rows: DataFrame) -> list[Rule]:
    """The decision list of labelled rows (with COUNTS, bad, good and prune); rows that fail the limits are left out."""
    cells, cuts = statistics(rows.where(~base_failed()))
    names, rules, left = list(cuts), [], F.lit(True)
    while len(rules) < RULES:
        steps, bad, good = grown(cells.where(left), cuts)
        if not steps or (bad + 1) / (bad + good + 2) < PRECISION:  # Laplace's estimate: a few documents are not enough
            break
        rules.append(Rule(tuple(Condition(names[f], above, cuts[names[f]][c]) for f, above, c in steps), bad, good))
        left = left & ~_all(steps)
    return rules


def with_verdicts(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """Counted rows with base_failed and kept."""
    failed = rows.withColumn("base_failed", base_failed())
    return failed.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def quality_rules(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, label_id_col: str = "doc_id", label_col: str = "quality") -> tuple[DataFrame, list[Rule]]:
    """The carried columns of all documents (the id if none are named), COUNTS, base_failed and kept; and the rules.

    Texts are read once: their counts are written out, joined with the labels to learn, and judged.
    """
    kept = [c for c in dict.fromkeys([id_col, *(carry or [])]) if c.lower() not in NEW]
    rows = saved(counted(docs, text_col=text_col, carry=kept), "quality-counts")
    rules = learned(labelled(rows, labels, id_col=id_col, label_id_col=label_id_col, label_col=label_col))
    return with_verdicts(rows, rules).select([F.col("_row")[c].alias(c) for c in kept] + list(NEW)), rules
