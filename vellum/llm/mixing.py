"""Mixing domains to target weights by soft membership, in DataFrame operations only.

1. A classifier over the labelled table. The label is the domain column; a document is described by a cell
   of coarse text features. Naive Bayes over the feature bins, and a noise channel for the document's own
   label (right with probability 1 - noise, else any other domain alike), give each document posteriors
   over the domains. Documents without a label have the text features alone. As the features depend on each other, their
   evidence is tempered: it counts by the power under which the labels of held-out documents are likeliest (0: the text says nothing
   about its domain). That log loss, and the one by the domains' shares alone, are in the report. The noise is estimated from the same held-out
   documents: how often the label differs where the text is sure of the domain.
2. Tokens: a given column of counts, or pieces of text as byte-pair tokenizers make them (letters by up to six, digits by
   up to three, other marks one by one), which also counts scripts without spaces.
3. Rates. Each document gets a nonnegative rate such that the expected tokens of each domain,
   sum(rate * tokens * posterior), come as near to their targets as rates in [low, high] allow (high may be infinite).
   Projected gradient descent in the metric that weighs documents by their tokens:

       rate <- clip(rate - sum_k posterior_k * (G (S - T))_k / L)

   S are the expected domain totals, T the targets; errors are weighed by G, the inverse of what the rates can move
   (sum of tokens * p p', taken over the domains' mean posteriors; the diagonal alone beyond SOLVED domains), so that domains
   of any size come near at the same pace. L doubles where a step would not hold what its gradient promises. Steps
   start from points carried on by momentum, which begins anew where it points uphill; S is linear in the rates, so
   it is known there without another pass. The descent ends when no rate would move: clipped cells do not count.
   Documents of one cell and label share posteriors, start and steps, hence their rate: the table of cells
   carries the descent, and each step is one aggregation of it with a number a domain to the driver.
4. Copies: floor(rate) of each document, and one more with the fraction's probability, by a hash of the id, the text and the row's place in
   the table's files, so that rows without an id, and rows that are alike, are rounded each for itself.

Defined cases: null text has no tokens, and its rate follows from its cell; a null domain is unlabelled; with no labels at
all there is one domain, ''; repeated rows stay, each with the rate of its cell; very long texts are described whole; an empty
table gives no rows; other columns pass through, but for those that have the name of a new one, in whatever case, which give way.
"""

from __future__ import annotations

import json
import logging
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, saved

log = logging.getLogger(__name__)

#: How likely a label is not the document's domain is estimated where the text tells the domain. Held-out documents are dealt by how far
#: the evidence of their text for its first domain is ahead of that for the second (over GAP, in steps of it); where the text is as sure as
#: it gets, labels still disagree as often as they are wrong. So the noise is what is left of 1 by the best agreement of a step of
#: at least ENOUGH documents, within bounds; without such a step the text does not tell, nothing speaks against a label, and it is the least.
LEAST_NOISE, MOST_NOISE, GAP, ENOUGH = 0.02, 0.5, 0.6, 50
#: Powers of the text's evidence that are tried, and which part of the labelled documents is held out meanwhile.
TEMPERS, HELD_OUT = tuple(i / 10 for i in range(11)), 5
#: A posterior has an entry for each domain; more are refused. Up to SOLVED of them, G is a full matrix.
MAX_DOMAINS, SOLVED, WIDE = 10_000, 256, 64
#: Steps after which a descent is reported as not converged.
ROUNDS = 1000
#: The descent ends when a step moves no rate by more than this (times the budget, if that is over 1).
TOLERANCE = 1e-6
#: With rates held from below, the budget is doubled while a domain is off its target by more than this share and the last
#: doubling took off a part GAIN of that, after so many steps at most with one budget, and so many times at most.
MISS, GAIN, RUNG, DOUBLINGS = 0.01, 0.25, 60, 8
#: The table of cells is broadcast up to this many rows; beyond, it is joined by a shuffle.
BROADCAST_CELLS = 100_000
#: Pieces of text that count as a token.
TOKEN = r"\p{L}{1,6}|\p{N}{1,3}|[^\s\p{L}\p{N}]"
_FEATURES = ("f_size", "f_wide", "f_word", "f_th", "f_e")
_NEW = ("mix_tokens", "mix_domain", "mix_posterior", "mix_rate", "mix_copies")
_STEPS_A_PLAN = 6


def _ratio_bin(part: Column, whole: Column, scale: float, bins: int) -> Column:
    return F.least(F.lit(bins - 1), F.floor(scale * part / F.greatest(whole, F.lit(1)))).cast("int")


def described(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "source", tokens_col: str | None = None, carry: list[str] | None = None) -> DataFrame:
    """The carried columns (all if none are named) as _row, the _id, _domain, _tokens, _held and the feature bins."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = F.length(text)
    without = lambda s: size - F.length(F.replace(text, F.lit(s), F.lit("")))
    tokens = F.coalesce(quoted(tokens_col).cast("long"), F.lit(0)) if tokens_col else F.regexp_count(text, F.lit(TOKEN)).cast("long")
    first = docs.select(F.struct(*map(quoted, carry or docs.columns)).alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(F.col(id_col), text, F.monotonically_increasing_id()).alias("_own"), F.col(domain_col).cast("string").alias("_domain"), tokens.alias("_tokens"), size.alias("_size"), F.octet_length(text).alias("_bytes"), without("th").alias("_th"), without("e").alias("_e"))
    n, t = F.col("_size"), F.col("_tokens")
    return first.select(
        "_row",
        "_id",
        "_own",
        "_domain",
        "_tokens",
        (F.pmod(F.xxhash64("_id", "_size", "_tokens", F.lit(3)), F.lit(HELD_OUT)) == 0).alias("_held"),
        F.floor(F.log2(n + F.lit(1.0))).cast("int").alias("f_size"),
        _ratio_bin(F.col("_bytes") - n, n, 40.0, 8).alias("f_wide"),
        _ratio_bin(n, t, 2.0, 16).alias("f_word"),
        _ratio_bin(F.col("_th") / 2, t, 6.0, 8).alias("f_th"),
        _ratio_bin(F.col("_e"), n, 40.0, 8).alias("f_e"),
    )


def _array(values: list[float] | np.ndarray) -> Column:
    """One literal, however many values."""
    return F.from_json(F.lit(json.dumps([float(v) for v in values])), "array<double>")


def _names(values: list[str]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "array<string>")


def domains_of(cells: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Documents by domain, in order, and those of them not held out: MAX_DOMAINS at most come to the driver."""
    kept = F.sum(F.when(~F.col("_held"), F.col("docs"))) if "_held" in cells.columns else F.sum("docs")
    found = sorted(tuple(r) for r in cells.where("_domain is not null").groupBy("_domain").agg(F.sum("docs"), F.coalesce(kept, F.lit(0.0))).limit(MAX_DOMAINS + 1).collect())
    if len(found) > MAX_DOMAINS:
        raise ValueError(f"over {MAX_DOMAINS} domains")
    return {d: n for d, n, _ in found}, {d: n for d, _, n in found}


def _narrow(df: DataFrame, label: str) -> DataFrame:
    """A table of cells written in no more files than there are cores."""
    return saved(df.coalesce(df.sparkSession.sparkContext.defaultParallelism), label)


def text_evidence(cells: DataFrame, labelled: DataFrame, prior: dict[str, float]) -> DataFrame:
    """Cells with `evidence`, the log likelihood of the text features in each domain, learned from the labelled cells.

    The table of terms has a row a bin, at most 72, and is made from as many counts a domain.
    """
    domains = list(prior)
    long = labelled.select("_domain", "docs", F.posexplode(F.array(*_FEATURES)).alias("feature", "bin"))
    counts = long.groupBy("feature", "bin", "_domain").agg(F.sum("docs").alias("n")).coalesce(1)
    bins = counts.groupBy("feature", "bin").agg(F.map_from_entries(F.collect_list(F.struct("_domain", "n"))).alias("by"))
    sizes = bins.groupBy("feature").agg(F.count(F.lit(1)).alias("bins"))  # a row a feature
    chance = F.zip_with(_names(domains), _array(list(prior.values())), lambda d, n: F.log((F.coalesce(F.col("by")[d], F.lit(0.0)) + 1) / (n + F.col("bins") + 1)))
    terms = saved(bins.join(F.broadcast(sizes), "feature").select("feature", "bin", chance.alias("term")), "mixing-terms")
    out = cells.withColumn("evidence", _array([0.0] * len(domains)))
    for f, name in enumerate(_FEATURES):
        own = terms.where(F.col("feature") == f).select(F.col("bin").alias(name), "term")
        out = out.join(F.broadcast(own), name, "left").withColumn("evidence", F.when(F.col("term").isNull(), F.col("evidence")).otherwise(F.zip_with("evidence", "term", lambda a, b: a + b))).drop("term")
    return out


def _shares(prior: dict[str, float]) -> Column:
    total = sum(prior.values())
    return _array([math.log((n + 1) / (total + len(prior))) for n in prior.values()])


def _normalised(df: DataFrame, name: str, score: Column) -> DataFrame:
    """The column `name`, exponentials of the scores that add up to 1."""
    out = df.withColumn(name, score)
    out = out.withColumn(name, F.transform(name, lambda s: F.exp(s - F.array_max(F.col(name)))))
    out = out.withColumn("_sum", F.aggregate(name, F.lit(0.0), lambda a, b: a + b))
    return out.withColumn(name, F.transform(name, lambda s: s / F.col("_sum"))).drop("_sum")


def _times(factor: float):
    return lambda x: x * factor


def fit_temper(cells: DataFrame, prior: dict[str, float], mine: dict[str, float]) -> dict:
    """The power of the text's evidence, the mean log losses of held-out labels with it and without the text, and the noise of the labels,
    from so many held-out documents that the text is sure of."""
    none = {"temper": 1.0, "held_out": 0.0, "loss": math.nan, "share_loss": math.nan, "noise": LEAST_NOISE, "sure": 0.0}
    if len(prior) < 2:
        return none
    known = cells.where("_domain is not null")
    held = text_evidence(known.where("_held"), known.where(~F.col("_held")), mine).withColumns({"at": F.array_position(_names(list(prior)), F.col("_domain")).cast("int"), "shares": _shares(mine)})
    losses = []
    for i, temper in enumerate(TEMPERS):
        held = _normalised(held, f"p{i}", F.zip_with("shares", F.transform("evidence", _times(temper)), lambda a, b: a + b))
        losses.append(F.sum(-F.col("docs") * F.log(F.element_at(f"p{i}", F.col("at")) + 1e-300)))
    row = held.agg(F.sum("docs"), *losses).first()
    if not row[0]:
        return none
    best = int(np.argmin(row[1:]))
    out = {"temper": TEMPERS[best], "held_out": row[0], "loss": row[1 + best] / row[0], "share_loss": row[1] / row[0]}
    return out | label_noise(held, out["temper"])


def label_noise(held: DataFrame, temper: float) -> dict:
    """The noise of the labels of held-out cells (evidence, and `at`, the label's place in it), and the documents it comes from."""
    ranked = held.withColumn("_s", F.sort_array("evidence", asc=False))
    gap = temper * (F.element_at("_s", 1) - F.element_at("_s", 2))
    agree = F.when(F.element_at("evidence", F.col("at")) == F.element_at("_s", 1), F.col("docs")).otherwise(0.0)
    steps = ranked.withColumn("_gap", F.least(F.lit(20), F.floor(gap / GAP))).where("_gap >= 1").groupBy("_gap").agg(F.sum("docs"), F.sum(agree)).collect()
    shares = [(right / docs, docs) for _, docs, right in steps if docs >= ENOUGH]
    if not shares:
        return {"noise": LEAST_NOISE, "sure": 0.0}
    best, docs = max(shares)
    return {"noise": float(min(MOST_NOISE, max(LEAST_NOISE, 1 - best))), "sure": docs}


def posteriors(cells: DataFrame, *, noise: float = LEAST_NOISE, temper: float = 1.0, prior: dict[str, float] | None = None) -> tuple[DataFrame, list[str]]:
    """Cells with an array `p` of domain posteriors, and the domains in order."""
    prior = domains_of(cells)[0] if prior is None else prior
    if not prior:
        return cells.withColumn("p", _array([1.0])), [""]
    out, k = text_evidence(cells, cells.where("_domain is not null"), prior), len(prior)
    score = F.zip_with(_shares(prior), "evidence", lambda a, b: a + temper * b)
    wrong = math.log(noise / (k - 1)) if k > 1 else 0.0
    heard = F.zip_with(score, _names(list(prior)), lambda s, n: s + F.when(n == F.col("_domain"), math.log(1 - noise)).otherwise(wrong))
    return _normalised(out, "p", F.when(F.col("_domain").isNull(), score).otherwise(heard)).drop("evidence"), list(prior)


def _sums(cells: DataFrame, k: int, weight: Column, *more: Column) -> tuple[np.ndarray, np.ndarray, float]:
    """Sums of posterior * tokens * weight over the k domains and of the first columns, and the maximum of the last one.

    Up to WIDE domains are columns of one row; beyond, domains are rows, as wide plans are slow to compile.
    """
    cells = cells.withColumn("_w", F.col("tokens") * weight)
    if k <= WIDE:
        wanted = [*(F.sum(F.col("p")[i] * F.col("_w")) for i in range(k)), *map(F.sum, more[:-1]), *map(F.max, more[-1:])]
        values = np.array([x or 0.0 for x in cells.agg(*wanted).first()], float)
        return values[:k], values[k : k + len(more) - 1], float(values[-1])
    values = F.concat(F.transform("p", lambda x: x * F.col("_w")), F.array(*more) if more else F.array().cast("array<double>"))
    rows = sorted(cells.select(F.posexplode(values).alias("k", "v")).groupBy("k").agg(F.sum("v"), F.max("v")).collect())
    sums = np.array([r[1] or 0.0 for r in rows] or [0.0] * (k + len(more)), float)
    return sums[:k], sums[k : k + len(more) - 1], float(rows[-1][2] or 0.0) if rows else 0.0


def weights_of(cells: DataFrame, base: np.ndarray) -> np.ndarray:
    """G: the inverse of sum(tokens * p p') over the mean posteriors of the cells whose likeliest domain is the same, with a
    thousandth of its bound, the diagonal of the totals. A matrix, or its diagonal beyond SOLVED domains."""
    safe = np.where(base > 0, base, 1.0)
    if len(base) > SOLVED:
        return 1 / safe
    top = F.array_position("p", F.array_max("p")).alias("g")
    rows = cells.select(top, "tokens", F.posexplode("p").alias("k", "v")).groupBy("g", "k").agg(F.sum(F.col("tokens") * F.col("v"))).collect()
    totals = np.zeros((len(base) + 1, len(base)))
    for g, k, s in rows:
        totals[g, k] = s or 0.0
    tokens = totals.sum(1)
    seen = totals[tokens > 0] / np.sqrt(tokens[tokens > 0])[:, None]
    return np.linalg.inv(seen.T @ seen + 1e-3 * np.diag(safe))


def _stepped(cells: DataFrame, slope: np.ndarray, low: float, high: float) -> DataFrame:
    """Cells with `next`, the clipped step from the point `at`."""
    dot = F.aggregate(F.zip_with("p", _array(slope), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return cells.withColumn("next", F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), F.col("at") - dot)))


def _carried(cells: DataFrame, momentum: float) -> DataFrame:
    """The step taken: `next` becomes the rate, and the point goes on by the momentum."""
    return cells.withColumns({"rate": F.col("next"), "at": F.col("next") + F.lit(momentum) * (F.col("next") - F.col("rate"))}).drop("next")


def _all_carried(cells: DataFrame, steps: list[tuple[np.ndarray, float]], low: float, high: float) -> DataFrame:
    for slope, momentum in steps:
        cells = _carried(_stepped(cells, slope, low, high), momentum)
    return cells


def fit_rates(cells: DataFrame, domains: list[str], targets: dict[str, float] | None, *, budget: float = 1.0, low: float = 0.0, high: float = math.inf, rounds: int = ROUNDS) -> tuple[DataFrame, dict]:
    """Cells with their rate, and what the descent reached. targets: weights of the domains (alike if None);
    budget: target total as a multiple of the tokens at hand. If low > 0 it is the least budget: as no rate falls below
    low, others must grow, to twice what the largest domain needs at first."""
    weights = np.array([1.0 if targets is None else float(targets.get(d, 0.0)) for d in domains])
    start = float(min(high, max(low, 1.0)))
    cells = cells.withColumns({"rate": F.lit(start), "at": F.lit(start)})
    base = _sums(cells, len(domains), F.lit(1.0))[0]
    total = base.sum()
    goal = total * weights / (weights.sum() or 1.0)
    if low > 0:
        budget = max([budget, *(2 * low * base[goal > 0] / goal[goal > 0])])
    goal = budget * goal
    g = weights_of(cells, base)
    scaled = lambda x: g @ x if g.ndim == 2 else g * x
    now = there = base * start  # totals at the rates, and at the points
    pending: list[tuple[np.ndarray, float]] = []
    hold = lambda cells, pending: cells if not pending else saved(_all_carried(cells, pending, low, high), "mixing-rates")
    pace, steep, moved, turn, rung, doublings, miss, missed = 1.0, 1.0, math.inf, 0, 0, 0, math.inf, math.inf
    enough = lambda: moved <= TOLERANCE * max(1.0, budget)
    while turn < rounds and total:
        if enough() or rung >= RUNG:
            if low > 0 and MISS < miss < (1 - GAIN) * missed and doublings < DOUBLINGS and 2 * budget <= high:
                missed, moved = miss, math.inf
                cells = hold(cells, pending)
                cells, pending = cells.withColumns({"rate": 2 * F.col("rate"), "at": 2 * F.col("rate")}), []
                budget, goal, now = 2 * budget, 2 * goal, 2 * now
                there, pace, rung, doublings = now, 1.0, 0, doublings + 1
            elif enough():
                break
        turn, rung = turn + 1, rung + 1
        slope = scaled(there - goal)
        ahead = _stepped(_all_carried(cells, pending, low, high), slope / steep, low, high)
        step = F.col("next") - F.col("at")
        dot = F.aggregate(F.zip_with("p", _array(slope), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        after, (uphill, slid, far), most = _sums(ahead, len(domains), F.col("next"), -F.col("tokens") * step * (F.col("next") - F.col("rate")), F.col("tokens") * dot * step, F.col("tokens") * step * step, F.abs(step))
        value = lambda s: 0.5 * float((s - goal) @ scaled(s - goal))
        if value(after) > value(there) + slid + 0.5 * steep * far + 1e-12 * (value(there) + 1):
            steep *= 2  # the step promised more than it held: a shorter one
            continue
        moved = most * steep
        pace = 1.0 if uphill > 0 else pace
        faster = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        momentum, pace = (pace - 1) / faster, faster
        before, now = now, after
        there = now + momentum * (now - before)
        miss = float(np.max(np.abs(now[goal > 0] / goal[goal > 0] - 1), initial=0.0))
        pending.append((slope / steep, momentum))
        if len(pending) >= _STEPS_A_PLAN:
            cells, pending = saved(_carried(ahead, momentum), "mixing-rates"), []
    cells = _all_carried(cells, pending, low, high)
    miss = float(np.max(np.abs(now[goal > 0] / goal[goal > 0] - 1), initial=0.0))
    return cells.drop("at"), {"domains": domains, "base": base.tolist(), "goal": goal.tolist(), "reached": now.tolist(), "budget": float(budget), "miss": miss, "rounds": turn, "moved": float(moved), "converged": bool(enough() or not total)}


def with_rates(docs: DataFrame, targets: dict[str, float] | None = None, **settings) -> DataFrame:
    """The carried columns of docs with mix_tokens, mix_domain, mix_posterior, mix_rate and mix_copies. Settings as in mixed()."""
    return mixed(docs, targets, **settings)[0]


def mixed(docs: DataFrame, targets: dict[str, float] | None = None, *, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "source", tokens_col: str | None = None, carry: list[str] | None = None, budget: float = 1.0, low: float = 0.0, high: float = math.inf, noise: float | None = None, temper: float | None = None, seed: int = 7) -> tuple[DataFrame, dict]:
    """What with_rates returns, and the reports of fit_temper and fit_rates (noise and temper are found from the data if none are given); a descent that has not converged and missed targets are
    logged as warnings.

    tokens_col: a column of token counts, instead of pieces of text. carry: the columns to carry; without the text among
    them, texts are read and described once, and what is carried is written out.
    """
    carry = [c for c in carry or docs.columns if c.lower() not in _NEW]
    rows = described(docs, id_col=id_col, text_col=text_col, domain_col=domain_col, tokens_col=tokens_col, carry=carry)
    if text_col not in carry:
        rows = saved(rows, "mixing-rows")
    key = ["_domain", *_FEATURES]
    halves = _narrow(rows.groupBy(*key, "_held").agg(F.count(F.lit(1)).cast("double").alias("docs"), F.sum("_tokens").cast("double").alias("tokens")), "mixing-cells")
    prior, mine = domains_of(halves)
    text = fit_temper(halves, prior, mine) if temper is None or noise is None else {}
    text |= {k: v for k, v in (("temper", temper), ("noise", noise)) if v is not None}
    cells = halves.groupBy(*key).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    known, domains = posteriors(cells, noise=text["noise"], temper=text["temper"], prior=prior)
    fitted, report = fit_rates(_narrow(known, "mixing-posteriors"), domains, targets, budget=budget, low=low, high=high)
    report |= text
    if not report["converged"]:
        log.warning("mixing: not converged after %d steps; the last one moved a rate by %g", report["rounds"], report["moved"])
    if report["miss"] > MISS:
        log.warning("mixing: a domain is %.1f %% off its target of %g times the tokens: %s", 100 * report["miss"], report["budget"], list(zip(domains, report["reached"], report["goal"], strict=True)))
    top = F.array_position("p", F.array_max("p")).cast("int")
    rates = _narrow(fitted.select(*key, F.element_at(_names(domains), top).alias("mix_domain"), F.array_max("p").alias("mix_posterior"), F.col("rate").alias("mix_rate")), "mixing-rates")
    small = rates.count() <= BROADCAST_CELLS
    side = rates.select([F.col(c).alias(f"r_{c}") for c in key] + ["mix_domain", "mix_posterior", "mix_rate"])
    on = rows["_domain"].eqNullSafe(side["r__domain"])
    for c in _FEATURES:
        on = on & (rows[c] == side[f"r_{c}"])
    out = rows.join(F.broadcast(side) if small else side, on)
    luck = F.pmod(F.xxhash64("_own", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    whole = F.floor("mix_rate")
    out = out.withColumn("mix_copies", (whole + (luck < F.col("mix_rate") - whole).cast("int")).cast("int"))
    new = [F.col("_tokens").alias("mix_tokens"), *map(F.col, _NEW[1:])]
    return out.select([F.col("_row")[c].alias(c) for c in carry] + new), report
