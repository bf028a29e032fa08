"""Mixing sources to target weights with soft membership.

1. A classifier learned from a labelled table gives every document a posterior over domains: Gaussian naive Bayes on a
   few text features, whose per-domain counts, means and variances are one aggregate over all labelled documents.
2. Documents of near equal posteriors share a cell: posteriors in ``grid`` parts tell which, fewer parts for many domains, so
   that there are at most ``cells`` cells (or as many as domains). Tokens, and tokens times exact posteriors, are summed by
   cell before anything is shuffled, so expected totals are exact; only the rate is the cell's.
3. Projected gradient descent on least squares fits a nonnegative rate for each cell, starting from 1, so that for every
   domain the expected token total, sum of rate * posterior * tokens, meets its target. Steps are scaled by tokens and
   accelerated; every step is a distributed aggregate of K totals over the cells.
4. Every document takes its cell's rate. A rate is an expected number of copies: ``Mix.apply`` emits floor(rate + u)
   copies, u from a hash of id and text, so a rate of 1 or more never loses a document.

All of it is DataFrame and SQL operations: one pass over texts, one shuffle of cells.
Targets that no nonnegative rates meet get the least squares fit. Default total: as many tokens as let the domain that is
scarcest against its weight keep its own total.

Defined results: a null text counts as empty (0 tokens); null ids get rates as any other; ids that repeat among documents
each get a rate, and as labelled rows each count once a label row; labels that are null or lack a document are not used.
Without labels of at least one domain, or without tokens, all rates are 1; documents of cells without tokens have rate 1. A domain without labels is unknown. An empty
table gives an empty result. Other columns are kept by ``Mix.apply``, also those whose names clash with ours.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import comb

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import Stored, table

#: Features of a text t of w words: logarithms of shares that tell junk from prose.
FEATURES = {
    "f_len": "ln(1 + w)",
    "f_word": "ln((length(t) + 1) / (w + 1))",
    "f_mark": "ln((regexp_count(t, '[!%#$&*|<>{}]') + 0.5) / (w + 1))",
    "f_upper": "ln((regexp_count(t, '[A-Z]') + 0.5) / (w + 1))",
    "f_digit": "ln((regexp_count(t, '[0-9]') + 0.5) / (w + 1))",
    "f_stop": "ln((regexp_count(t, '[.] ') + 0.5) / (w + 1))",
}
TOKENS = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Params:
    weights: dict[str, float] = field(default_factory=lambda: {"0": 0.05, "1": 0.95})  #: target share of each domain
    grid: int = 256
    cells: int = 20_000
    steps: int = 60
    close: float = 1e-4  #: greatest miss of a target, as a share of all target tokens, at which steps end
    spread: float = 0.05  #: least variance of a feature


def features(docs: DataFrame, id_col: str, text_col: str, whole: bool = False) -> DataFrame:
    """(id, u, tokens, features): u in [0, 1) from a hash of id and text; if ``whole`` also row, all of the columns."""
    sql_rx = TOKENS.replace("\\", "\\\\")
    row = [F.struct("*").alias("row")] if whole else []
    base = docs.select(*row, F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    base = base.withColumn("w", F.expr(f"cast(regexp_count(t, '{sql_rx}') as bigint)"))
    return base.select(*["row"] * whole, "id", uniform(F.col("id"), F.col("t")).alias("u"), F.col("w").alias("tokens"), *[F.expr(e).alias(n) for n, e in FEATURES.items()])


def uniform(id_: Column, text: Column) -> Column:
    return F.pmod(F.xxhash64(id_, text), F.lit(1 << 30)) / float(1 << 30)


def classifier(feats: DataFrame, labels: DataFrame, p: Params) -> list[tuple[str, float, dict[str, tuple[float, float]]]]:
    """(domain, prior, {feature: (mean, variance)}) of each domain that has labels, in the order of names.

    ``labels`` is (lid, domain). What comes to the driver is one row a domain.
    """
    names = sorted(p.weights)
    seen = feats.join(labels.where("lid is not null and domain is not null"), F.col("id") == F.col("lid")).where(F.col("domain").isin(names))
    aggs = [a for f in FEATURES for a in (F.avg(f).alias(f"m_{f}"), F.var_pop(f).alias(f"v_{f}"))]
    rows = sorted(seen.groupBy("domain").agg(F.count("*").alias("n"), *aggs).collect(), key=lambda r: r["domain"])
    total = sum(r["n"] for r in rows)
    return [(r["domain"], r["n"] / total, {f: (r[f"m_{f}"], r[f"v_{f}"] + p.spread) for f in FEATURES}) for r in rows]


def grid_of(k: int, p: Params) -> int:
    """Parts of a posterior over k domains, of which there are comb(parts + k - 1, k - 1) cells."""
    return max([g for g in range(1, p.grid + 1) if comb(g + k - 1, k - 1) <= p.cells], default=1)


def posteriors(feats: DataFrame, model: list, p: Params) -> DataFrame:
    """Adds post, array<double>, each domain's posterior, and c, array<int>, the cell: its parts, the rest at the likeliest."""
    logs = []
    for _, prior, shape in model:
        each = [f"- 0.5D * (ln({v!r}D) + ({f} - {m!r}D) * ({f} - {m!r}D) / {v!r}D)" for f, (m, v) in shape.items()]
        logs.append(f"ln({prior!r}D) {' '.join(each)}".replace("e-", "E-"))
    k = len(model)
    grid = grid_of(k, p)
    out = feats.withColumn("g", F.expr(f"array({', '.join(logs)})"))
    out = out.withColumn("g", F.expr("transform(g, x -> exp(x - array_max(g)))"))
    out = out.withColumn("post", F.expr("transform(g, x -> x / aggregate(g, 0D, (a, y) -> a + y))")).drop("g")
    out = out.withColumn("c", F.expr(f"transform(post, x -> cast(floor(x * {grid}) as int))")).withColumn("top", F.expr("cast(array_position(post, array_max(post)) as int)"))
    rest = f"{grid} - aggregate(c, 0, (a, y) -> a + y)"
    return out.withColumn("c", F.expr(f"transform(sequence(1, {k}), i -> element_at(c, i) + if(i = top, {rest}, 0))")).drop("top")


def cells_of(placed: DataFrame, k: int) -> DataFrame:
    """(c, tokens, t0, t1, ...): each cell's tokens and its expected tokens of each domain."""
    each = [F.sum(F.col("tokens") * F.element_at("post", i + 1)).alias(f"t{i}") for i in range(k)]
    return placed.groupBy("c").agg(F.sum("tokens").cast("double").alias("tokens"), *each)


def fit(cells: DataFrame, names: list[str], p: Params, total: float | None = None) -> DataFrame:
    """(c, rate) from cells as of ``cells_of``."""
    k = len(names)
    cells = cells.where("tokens > 0")
    post = [F.col(f"t{i}") / F.col("tokens") for i in range(k)]
    first = cells.agg(*[F.sum(F.col("tokens") * post[i]).alias(f"e{i}") for i in range(k)], *[F.sum(F.col("tokens") * post[i] * post[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    have = [first[f"e{i}"] or 0.0 for i in range(k)]
    weight = [p.weights[n] for n in names]
    share = [w / sum(weight) for w in weight]
    able = [h / s for h, s in zip(have, share, strict=True) if s > 0 and h > 0]
    if not able:
        return cells.select("c", F.lit(1.0).alias("rate"))
    want = [s * (total or min(able)) for s in share]
    gram = [[first[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]
    scale = [1.0 / max(gram[i][i], 1e-300) for i in range(k)]  # evens domains of very different size
    v = [1.0] * k
    for _ in range(200):  # the greatest curvature in those units, by power iteration on K numbers
        n = [sum((scale[i] * scale[j]) ** 0.5 * gram[i][j] * v[j] for j in range(k)) for i in range(k)]
        size = max(abs(x) for x in n) or 1.0
        v = [x / size for x in n]
    step = 1.0 / size

    rate, last = F.lit(1.0), F.lit(1.0)
    kept = [f"t{i}" for i in range(k)]
    state, held, t = cells.withColumn("rate", rate).withColumn("last", last), None, 1.0
    for i in range(p.steps):
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead = (t - 1) / s
        state = state.withColumn("look", F.col("rate") + ahead * (F.col("rate") - F.col("last")))
        got = state.agg(*[F.sum(F.col("look") * F.col("tokens") * post[j]).alias(f"e{j}") for j in range(k)], *[F.sum(F.col("rate") * F.col("tokens") * post[j]).alias(f"r{j}") for j in range(k)]).first()
        if max(abs(got[f"r{j}"] - want[j]) for j in range(k)) <= p.close * sum(want):
            break
        slope = sum((post[j] * (scale[j] * step * (got[f"e{j}"] - want[j])) for j in range(k)), F.lit(0.0))
        state = state.select("c", "tokens", *kept, F.greatest(F.lit(0.0), F.col("look") - slope).alias("new"), F.col("rate").alias("last")).withColumnRenamed("new", "rate")
        t = s
        if i % 6 == 5:  # cuts the chain of steps; cells are few
            before, held = held, Stored(state, "rates")
            state = held.df
            if before:
                before.drop()
    return state.select("c", "rate")


class Mix:
    """A classifier and the rates of its cells, fitted to documents; ``labels`` has label_id and label_col (string)."""

    def __init__(self, docs: DataFrame, labels: DataFrame, params: Params | None = None, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "domain", total: float | None = None):
        self.p, self.docs, self.cols = params or Params(), docs, (id_col, text_col)
        self.feats = Stored(features(docs, *self.cols), "features").df
        self.model = classifier(self.feats, labels.select(F.col(label_id).alias("lid"), F.col(label_col).alias("domain")), self.p)
        self.names = [m[0] for m in self.model]
        if self.model:
            placed = posteriors(self.feats, self.model, self.p)
            cells = Stored(cells_of(placed, len(self.names)), "cells")
            self.fitted = Stored(fit(cells.df, self.names, self.p, total), "fitted").df  # at most Params.cells rows
            cells.drop()

    def _rated(self, feats: DataFrame) -> DataFrame:
        if not self.model:
            return feats.withColumn("post", F.lit(None).cast("array<double>")).withColumn("rate", F.lit(1.0))
        return posteriors(feats, self.model, self.p).join(F.broadcast(self.fitted), "c", "left").withColumn("rate", F.coalesce("rate", F.lit(1.0)))

    def rates(self) -> DataFrame:
        """(id, u, tokens, posterior map<domain, share>, rate), one row a document."""
        keys = F.array(*map(F.lit, self.names)) if self.names else F.lit(None).cast("array<string>")
        return self._rated(self.feats).select("id", "u", "tokens", F.map_from_arrays(keys, "post").alias("posterior"), "rate")

    def apply(self) -> DataFrame:
        """The documents at their rates: each row's columns floor(rate + u) times. Texts are read again, not shuffled."""
        rated = self._rated(features(self.docs, *self.cols, whole=True))
        copies = F.expr("cast(floor(rate + u) as int)")
        return rated.select("row", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)))).select("row.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("domain"))
    got = Mix(table(spark, sf_dir, "documents"), labels).rates()
    return got.select(F.col("id").alias("doc_id"), "tokens", F.coalesce(F.element_at("posterior", "0"), F.lit(0.0)).alias("p_low"), F.coalesce(F.element_at("posterior", "1"), F.lit(0.0)).alias("p_high"), "rate", F.floor(F.col("rate") + F.col("u")).alias("copies"))
