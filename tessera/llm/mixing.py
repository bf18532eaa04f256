"""Mixing sources to target weights by iterative proportional fitting (operator 7).

Token counts by (source, language, topic) cell are raked: each round scales the cells to the source,
then the language, then the topic marginal, until all three hold.  A cell's factor is its raked over
its counted tokens.  Documents are kept with probability ``min(1, scale * factor)``, where the scale
spends the token budget; where a cell should grow beyond what it has, all of it is kept and
``weight`` carries the rest, so kept tokens times weight meet the targets in expectation.

Targets are tempered shares (share to the power of ``temper``, normalised) unless given.  The cell
table has one row for each combination that occurs and stays a DataFrame: marginals are aggregated
and joined back, with a checkpoint each; only the largest deviation of a round is collected.
Targets that no table with these cells has (such as a share for a source without tokens) never settle:
that is an error.  Documents meet the rates of their cells in a broadcast join if the cells were counted
to be ``BROADCAST_CELLS`` at most, so texts aren't dealt by cell; beyond that Spark joins as it sees fit.
The topic is a column expression of the caller's, or else by the words of ``TOPICS``.  Documents are decided by a hash of id and text, so the draw is the same on every run and rereading.

Everything is DataFrame functions.  Rows: a null source or language is a group of its own; null and
empty texts have no tokens and are kept with the probability of their cell (1 if the cell has no
tokens); repeated rows are decided alike; very long texts are counted whole; other columns pass by,
and clashing ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WORD_SEPARATORS, checkpointed, text_key

# Words that place a text in a topic; texts without any are "general".
TOPICS = {
    "legal": "license licence copyright public gnu warranty terms permission agreement law court rights",
    "technical": "token key software version code data server password http api system file",
    "commerce": "price buy sale order free discount shop pay card offer",
    "contact": "call mail email phone contact address street",
}
DIMENSIONS = ("source", "lang", "topic")
TEMPER = {"source": 0.7, "lang": 0.7, "topic": 1.0}
BUDGET = 0.8
TOLERANCE, MOST_ROUNDS = 1e-4, 40
BROADCAST_CELLS = 100_000


def topic_of(words: Column) -> Column:
    """The topic with most distinct words in a text (the first of equals), else general."""
    lexicon = F.array(*[F.lit(w) for w in sorted({w for ws in TOPICS.values() for w in ws.split()})])
    met = F.array_intersect(F.transform(words, lambda w: F.lower(w)), lexicon)
    met_of = lambda ws: F.size(F.array_intersect(met, F.array(*map(F.lit, ws.split()))))
    counts = [F.struct(met_of(ws).alias("n"), F.lit(-i).alias("i"), F.lit(t).alias("t")) for i, (t, ws) in enumerate(TOPICS.items())]
    best = F.greatest(*counts)
    return F.when(F.size(met) == 0, "general").otherwise(best["t"])


def with_cells(docs: DataFrame, text_col: str = "text", topic: Column | None = None) -> DataFrame:
    """docs with topic, n_tokens and the cell columns __source, __lang; topic: an expression over docs, nulls are "general"."""
    out = docs.withColumn("__topic", F.lit(None).cast("string") if topic is None else F.coalesce(topic.cast("string"), F.lit("general")))
    out = out.drop("topic", "n_tokens").withColumn("__words", F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), WORD_SEPARATORS), ""))
    out = out.withColumns({"n_tokens": F.size("__words").cast("bigint"), "topic": topic_of(F.col("__words")) if topic is None else F.col("__topic")}).drop("__words", "__topic")
    return out.withColumns({"__source": F.coalesce(F.col("source"), F.lit("\0")), "__lang": F.coalesce(F.col("lang"), F.lit("\0"))})


CELL = ["__source", "__lang", "topic"]


def rake(cells: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """cells(__source, __lang, topic, tokens) with factor; targets: for each dimension column a DataFrame (column, target share)."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    for c, target in targets.items() if total else ():
        off = target.join(cells.where("tokens > 0").select(c).distinct(), c, "left_anti").agg(F.sum("target")).first()[0] or 0
        if off > TOLERANCE:
            raise ValueError(f"raking can't reach a share of {off:.2g} for values of {c} without tokens")
    now, deviations = checkpointed(cells.withColumn("raked", F.col("tokens").cast("double"))), []
    while total and not (deviations and deviations[-1] < TOLERANCE):
        # what hasn't come nearer by 2 percent in five rounds never will
        if len(deviations) == MOST_ROUNDS or len(deviations) > 6 and deviations[-1] > 0.98 * deviations[-6]:
            raise ValueError(f"raking does not settle (off by {deviations[-1]:.2g} after {len(deviations)} rounds): no table with these cells has the target marginals")
        step, worst = now, []
        for c, target in targets.items():
            sums = step.groupBy(c).agg(F.sum("raked").alias("__sum")).join(target, c, "left")
            scale = F.when(F.col("__sum") > 0, F.try_divide(F.coalesce("target", F.lit(0.0)) * total, F.col("__sum"))).otherwise(1.0)
            step = step.join(sums.select(c, scale.alias(f"__scale_{c}")), c).withColumn("raked", F.col("raked") * F.col(f"__scale_{c}"))
            step = checkpointed(step)  # its sums and its rows are read next: plans would double with each dimension
            worst.append(F.abs(F.col(f"__scale_{c}") - 1))
        now = step
        deviations.append(now.where("raked > 0").agg(F.max(F.greatest(*worst))).first()[0] or 0.0)
        now = now.select(*cells.columns, "raked")
    return now.withColumn("factor", F.when(F.col("tokens") > 0, F.try_divide("raked", "tokens")).otherwise(1.0)).drop("raked")


def tempered(cells: DataFrame, column: str, temper: float) -> DataFrame:
    """(column, target): shares to a power, normalised."""
    power = F.pow(F.col("n").cast("double"), F.lit(temper))
    sums = cells.groupBy(column).agg(F.sum("tokens").alias("n"))
    whole = sums.agg(F.sum(power)).first()[0] or 1.0  # one number
    return sums.select(column, (power / F.lit(whole)).alias("target"))


def spend(cells: DataFrame, budget: float) -> float:
    """The scale at which cells keep a share ``budget`` of the tokens: sum(tokens * min(1, scale * factor))."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return 1.0
    kept = lambda s: F.sum(F.col("tokens") * F.least(F.lit(1.0), F.lit(s) * F.col("factor")))
    trials = [0.0, *(2.0**i for i in range(-30, 31))]
    for _ in range(4):  # each aggregation tries a finer grid between the two neighbours of the budget
        row = cells.agg(*[kept(t).alias(f"s{i}") for i, t in enumerate(trials)]).first()
        at = max(i for i, k in enumerate(row) if k <= budget * total)
        if at == len(trials) - 1:
            return trials[-1]
        low, high = trials[at], trials[at + 1]
        share = (budget * total - row[at]) / (row[at + 1] - row[at])  # kept() is linear but for the cells that fill up in between
        trials = [low + (high - low) * i / 32 for i in range(33)]
    return low + (high - low) * share


def mixing_rates(docs: DataFrame, budget: float = BUDGET, temper: dict[str, float] | None = None, targets: dict[str, DataFrame] | None = None, text_col: str = "text", topic: Column | None = None) -> DataFrame:
    """(__source, __lang, topic, tokens, factor, probability, weight) for each cell."""
    temper = temper or TEMPER
    cells = checkpointed(with_cells(docs, text_col, topic).groupBy(*CELL).agg(F.sum("n_tokens").alias("tokens")))
    names = dict(zip(DIMENSIONS, CELL))
    targets = {names[d]: (targets or {}).get(d) for d in DIMENSIONS}
    targets = {c: checkpointed(t if t is not None else tempered(cells, c, temper[d])) for (c, t), d in zip(targets.items(), DIMENSIONS)}
    raked = checkpointed(rake(cells, targets))
    scale = spend(raked, budget)
    p = F.least(F.lit(1.0), F.lit(scale) * F.col("factor"))
    return raked.withColumn("probability", p).withColumn("weight", F.coalesce(F.try_divide(F.lit(scale) * F.col("factor"), p), F.lit(0.0)))


def mix(docs: DataFrame, budget: float = BUDGET, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", topic: Column | None = None, **k) -> DataFrame:
    """docs with topic, n_tokens, probability, weight and kept."""
    rates = mixing_rates(docs, budget, text_col=text_col, topic=topic, **k).select(*CELL, "probability", "weight")
    rates = F.broadcast(rates) if rates.count() <= BROADCAST_CELLS else rates
    r1, r2 = text_key(F.col(text_col))
    draw = F.pmod(F.xxhash64(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), r1, r2), F.lit(1 << 52)) / F.lit(float(1 << 52))
    out = with_cells(docs.drop("probability", "weight", "kept"), text_col, topic).withColumn("__draw", draw)
    out = out.join(rates, CELL, "left").withColumn("kept", F.col("__draw") < F.col("probability"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("topic", "n_tokens", "probability", "weight", "kept")], "topic", "n_tokens", "probability", "weight", "kept")
