"""URL filters: rules by host and path, and for the rest a ratio of character language models.

Two smoothed variable-order Markov models, one of accepted and one of rejected URLs, give each character a probability
from its longest contexts downwards: p_k(c | last k characters) = (n(context, c) + d * p_(k-1)(c)) / (n(context) + d).
A URL's figure is the sum of log p_accepted - log p_rejected over its characters, divided by their number; it is allowed
if the figure reaches a threshold calibrated on rule-labelled URLs that took no part in the counts.

Characters count as one of ``len(ALPHABET) + 2`` symbols (all digits as one, all else as one), so a model has at most that
number to the power ``order + 1`` grams however large the corpus: that is the bound on what is broadcast. Counts cover
every labelled URL. All of it is DataFrame operations.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule, and gets the verdict of a figure
of 0. Null ids stay null, repeated rows repeat, an empty table gives an empty result, other columns are not read. If one
side has no labelled URL, every figure is 0 and the threshold 0, so the method allows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import Stored, sql_text, table

ALPHABET = "abcdefghijklmnopqrstuvwxyz/.-_"
#: Every upper-case letter counts as its lower case, every digit as "0", everything else as "*", a URL's start as "^".
ORDER, DISCOUNT, BINS = 3, 2.0, 400


@dataclass(frozen=True)
class Rule:
    verdict: str  #: allow or block
    rule: str  #: host, slash, path prefix


RULES = (Rule("block", "com/en/"), Rule("allow", "example.com/en/7"), Rule("allow", "net/de/"), Rule("block", "example.net/de/8"), Rule("block", "org/es/"))


def parts(url: str) -> tuple[str, str]:
    """SQL for (host, path) of a URL column."""
    rest = f"if(locate('://', {url}) > 0, substring({url}, locate('://', {url}) + 3), '')"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = f"coalesce(translate(regexp_extract({rest}, '^[^/?#]*', 0), '{upper}', '{lower}'), '')"
    return host, f"coalesce(regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1), '')"


def rule_of(rules: tuple[Rule, ...]) -> str:
    """SQL over host and path: the longest rule that fits, as struct<rule, verdict>, or null."""
    each = []
    for r in sorted(rules, key=lambda r: (-len(r.rule), r.rule)):
        host, path = r.rule.split("/", 1)
        fits = f"(host = {sql_text(host)} or endswith(host, {sql_text('.' + host)})) and startswith(path, {sql_text('/' + path)})"
        each.append(f"when {fits} then named_struct('rule', {sql_text(r.rule)}, 'verdict', '{r.verdict}')")
    return f"case {' '.join(each)} end"


def _marked(urls: DataFrame) -> DataFrame:
    """Adds marks: the URL's host and path as symbols, led by ``order`` starts."""
    low = F.lower(F.concat("host", "path"))
    return urls.withColumn("marks", F.concat(F.lit("^" * ORDER), F.regexp_replace(F.regexp_replace(low, "[0-9]", "0"), r"[^a-z0/._\-]", "*")))


def _grams(urls: DataFrame) -> DataFrame:
    """A row per character: gram, the character behind its ``order`` last ones."""
    each = f"transform(sequence({ORDER + 1}, length(marks)), i -> substring(marks, i - {ORDER}, {ORDER + 1}))"
    return urls.withColumn("gram", F.explode(F.expr(f"if(length(marks) > {ORDER}, {each}, cast(array() as array<string>))")))


def models(labelled: DataFrame) -> DataFrame:
    """(gram, ratio): log p_accepted - log p_rejected of a gram's last character after its context, for all grams seen.

    ``labelled`` has marks and accepted (0 or 1). The counts shuffle at most one row per gram and task; all later steps
    are on at most (symbols to the power order + 1) rows.
    """
    counts = Stored(_grams(labelled).groupBy("gram").agg(F.sum("accepted").alias("n1"), F.sum(1 - F.col("accepted")).alias("n0")), "grams")
    out = counts.df.select("gram", *[F.lit(1.0 / (len(ALPHABET) + 2)).alias(f"p{s}") for s in "01"])
    for k in range(ORDER + 1):  # contexts of k characters
        seen = counts.df.groupBy(F.substring("gram", -(k + 1), k + 1).alias("g")).agg(*[F.sum(f"n{s}").alias(f"c{s}") for s in "01"])
        context = seen.groupBy(F.substring("g", 1, k).alias("h")).agg(*[F.sum(f"c{s}").alias(f"t{s}") for s in "01"])
        out = out.withColumn("g", F.substring("gram", -(k + 1), k + 1)).withColumn("h", F.substring("g", F.lit(1), F.lit(k)))
        out = out.join(F.broadcast(seen), "g").join(F.broadcast(context), "h")
        out = out.select("gram", *[((F.col(f"c{s}") + DISCOUNT * F.col(f"p{s}")) / (F.col(f"t{s}") + DISCOUNT)).alias(f"p{s}") for s in "01"])
    return out.select("gram", (F.log("p1") - F.log("p0")).alias("ratio"))


def figures(urls: DataFrame, ratios: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and figure: the mean ratio over a URL's characters; grams of no labelled URL count 0."""
    grams = _grams(_marked(urls).withColumn("row", F.monotonically_increasing_id()).select("row", *keep, "marks"))
    sums = grams.join(F.broadcast(ratios), "gram", "left").groupBy("row", *keep).agg((F.sum(F.coalesce("ratio", F.lit(0.0))) / F.count("*")).alias("figure"))
    return sums.drop("row")


def calibrate(figured: DataFrame) -> float:
    """The threshold with the best mean of both sides' shares judged right, from a histogram of ``BINS`` bins.

    ``figured`` has figure and accepted. Ties go to the threshold nearest 0, then the lower.
    """
    low, high = figured.agg(F.min("figure"), F.max("figure")).first()
    if low is None or low == high:
        return 0.0
    step = (high - low) / BINS
    bins = figured.groupBy(F.least(F.floor((F.col("figure") - low) / step), F.lit(BINS - 1)).alias("bin"), "accepted").count().collect()
    n = {(r["bin"], r["accepted"]): r["count"] for r in bins}  # at most 2 * BINS rows
    total = [max(1, sum(v for (_, a), v in n.items() if a == s)) for s in (0, 1)]
    best, right = None, [0, total[1]]  # threshold below all: all are allowed
    for b in range(BINS + 1):
        score = right[0] / total[0] + right[1] / total[1]
        at = low + b * step
        key = (-round(score, 12), abs(at), at)
        best = min(best or key, key)
        right = [right[0] + n.get((b, 0), 0), right[1] - n.get((b, 1), 0)]
    return best[2]


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", held_out: int = 5) -> DataFrame:
    """id_col, host, path, rule, figure (null where a rule decides), verdict.

    The models count the URLs that rules decide; one in ``held_out`` of them (by a hash of the URL) only calibrates.
    """
    host, path = parts("u")
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("u")).select("id", F.expr(host).alias("host"), F.expr(path).alias("path"))
    urls = urls.withColumn("fit", F.expr(rule_of(rules)))
    labelled = urls.where("fit is not null").withColumn("accepted", F.when(F.col("fit.verdict") == "allow", 1).otherwise(0))
    labelled = labelled.withColumn("held", F.pmod(F.xxhash64("host", "path"), F.lit(held_out)) == 0)
    learned = Stored(models(_marked(labelled.where("not held"))), "url-ratios")
    sides = {r[0] for r in labelled.where("not held").select("accepted").distinct().collect()}
    ratios = learned.df if len(sides) == 2 else learned.df.withColumn("ratio", F.lit(0.0))
    least = calibrate(figures(labelled.where("held"), ratios, ["accepted"])) if len(sides) == 2 else 0.0
    free = figures(urls.where("fit is null and host || path <> ''"), ratios, ["id", "host", "path"])
    blank = urls.where("fit is null and host || path = ''").select("id", "host", "path", F.lit(0.0).alias("figure"))
    judged = free.unionByName(blank).select("id", "host", "path", F.lit(None).cast("string").alias("rule"), "figure", F.when(F.col("figure") >= least, "allow").otherwise("block").alias("verdict"))
    ruled = urls.where("fit is not null").select("id", "host", "path", "fit.rule", F.lit(None).cast("double").alias("figure"), "fit.verdict")
    return ruled.unionByName(judged).withColumnRenamed("id", id_col)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
