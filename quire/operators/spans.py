"""Dictionary HTML as styled spans: a table of what tags do, and styles as running sums over a definition's tokens.

A style holds where more of its tags have begun than ended, so tags that are never closed hold to the end and ends of what is not
open count for nothing. A definition is a row, its tokens are dealt by it; every step is a window over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# What tags do. Marks: "f" ends a span at the tag's start ("e": at its end alone), "n" begins a line; the rest are styles.
TAGS = (
    {t: "x" for t in ("svg", "hiero", "math", "gallery", "nowiki", "poem", "ref")}
    | {t: "fb" for t in ("b", "strong", "code", "tt")} | {t: "fi" for t in ("i", "em", "var")} | {"u": "fu", "s": "fs"}
    | {t: "f" for t in ("sup", "sub", "small", "big")} | {t: "fn" for t in ("p", "div", "ol", "ul")}
    | {"blockquote": "fnq", "li": "fnl", "abbr": "fa"} | {t: "fnb" for t in ("h1", "h2", "h3", "h4")}
)
BREAKS = ("br", "hr")
PASSED_OVER = ("area", "base", "col", "embed", "img", "input", "link", "meta", "param", "source", "track", "wbr")
ANNOTATIONS = "t|tr|lang|gloss|pos|sc|alt|id"
ENTITIES = {
    "lsqb": "[", "rsqb": "]", "nbsp": " ", "ndash": "–", "mdash": "—", "hellip": "…", "bull": "•", "dagger": "†", "sect": "§", "para": "¶",
    "prime": "′", "Prime": "″", "times": "×", "minus": "−", "middot": "·", "lrm": "", "rlm": "", "lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'",
}
BULLETS = "■▪◆●"

TOKEN = r"""(?s)<!--.*?-->|<(?:"[^"]*"|'[^']*'|[^>"'])*>|\r\n|[\r\n]|[^<\r\n]+|<"""


def _table(of: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in of.items() for x in pair])


def decoded(c: Column) -> Column:
    """Text with the references of ``ENTITIES`` and numbers of characters read; others stay as written."""

    def one(x: Column) -> Column:
        name = F.substring(x, F.lit(2), F.length(x) - 2)
        digits = F.when(name.rlike("^#[0-9]{1,7}$"), F.conv(F.substring(name, F.lit(2), F.length(name)), 10, 16)).when(name.rlike("^#[xX][0-9A-Fa-f]{1,6}$"), F.upper(F.substring(name, F.lit(3), F.length(name))))
        code = F.lpad(digits, 8, "0")
        real = (code > "00000000") & (code <= "0010FFFF") & ~code.between("0000D800", "0000DFFF")
        return F.when(~x.rlike("^&.+;$"), x).when(real, F.decode(F.unhex(code), "UTF-32")).otherwise(F.coalesce(F.try_element_at(_table(ENTITIES), name), x))

    pieces = F.regexp_extract_all(c, F.lit(r"(?s)&[^;&]{1,32};|[^&]+|&"), F.lit(0))
    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(pieces, one), "")).otherwise(c)


#: Bytes of definitions in a task, whose windows hold some thirty times as many.
SHARE = 2 << 20


def dealt(definitions: DataFrame, by: list[str], html_col: str) -> DataFrame:
    """Definitions in as many tasks as their bytes ask for, so that a task's windows do not grow with the table; one more look at the sizes."""
    size = definitions.agg(F.sum(F.octet_length(html_col))).first()[0] or 0
    return definitions.repartition(max(int(definitions.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARE)), *by)


def styled_spans(definitions: DataFrame, by: list[str], html_col: str = "html") -> DataFrame:
    """by, span (from 0), text, start, end, bold, italic, underline, strike, indent, item, newline of definitions (by, html).

    start and end are places in the texts put together. Spans end where a style may change, at blocks and at ends of lines;
    newline: a line began since the span before; item: a list item did. Titles of abbreviations follow them in brackets, annotations (as
    <t:word>) become their word, subtrees of drawings and formulas go. Null and empty definitions have no spans; ``by`` has to
    tell definitions apart.
    """
    tokens = dealt(definitions, by, html_col).select(*by, F.posexplode(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(TOKEN), F.lit(0))).alias("at", "t"))
    tag = F.col("t").rlike(r"^<\s*/?\s*[A-Za-z_]") & F.col("t").endswith(">")
    name = F.lower(F.regexp_extract("t", r"^<\s*/?\s*([^\s/>]+)", 1))
    closing, alone = F.col("t").rlike(r"^<\s*/"), F.col("t").rlike(r"/\s*>$")
    tokens = tokens.withColumn("name", F.when(tag, name)).where("t not like '<!%' and t not like '<?%'").where(F.col("name").isNull() | ~F.col("name").isin(*PASSED_OVER))
    tokens = tokens.withColumn("step", F.when(F.col("name").isNull() | F.col("name").isin(*BREAKS), 0).when(closing, -1).when(alone, 0).otherwise(1))
    marks = F.coalesce(F.try_element_at(_table(TAGS), F.col("name")), F.lit("e"))
    note = F.regexp_extract("name", rf"^(?:{ANNOTATIONS}):(.+)$", 1)
    tokens = tokens.withColumn("marks", F.when(F.col("name").isNull(), "").when(F.col("name").isin(*BREAKS), "fn").when(note != "", "w").otherwise(marks))
    line = W.partitionBy(*by).orderBy("at")
    upto = line.rowsBetween(W.unboundedPreceding, 0)

    has = lambda *m: F.col("marks").rlike(f"[{''.join(m)}]")

    def held(rows: DataFrame, out: str, *m: str) -> DataFrame:
        """Adds how many tags of a mark are open after the token: begun less ended, ends of nothing left out."""
        rows = rows.withColumn("_s", F.sum(F.when(has(*m), F.col("step")).otherwise(0)).over(upto))
        return rows.withColumn(out, F.col("_s") - F.least(F.lit(0), F.min("_s").over(upto))).drop("_s")

    rows = held(tokens, "away", "x")
    hidden = (F.col("away") > 0) | has("x")  # within such a subtree, and its own tags
    rows = rows.withColumn("hidden", hidden).withColumn("step", F.when(F.col("hidden"), 0).otherwise(F.col("step")))
    for out, m in (("bold", "b"), ("italic", "i"), ("underline", "u"), ("strike", "s"), ("indent", "ql"), ("noted", "w"), ("depth", "a")):
        rows = held(rows, out, *m)
    # an abbreviation's end knows the title of the start that it ends: the last one as deep
    titled = F.regexp_extract("t", r"""\stitle\s*=\s*(?:"([^"]*)"|'([^']*)')""", 1)
    titled = F.when(titled != "", titled).otherwise(F.regexp_extract("t", r"""\stitle\s*=\s*(?:"([^"]*)"|'([^']*)')""", 2))
    rows = rows.withColumn("deep", F.when(has("a"), F.col("depth") + F.when(F.col("step") < 0, 1).otherwise(0)))
    rows = rows.withColumn("title", F.last(F.when(has("a") & ~closing, titled), ignorenulls=True).over(W.partitionBy(*by, "deep").orderBy("at").rowsBetween(W.unboundedPreceding, 0)))
    abbreviated = has("a") & (closing | alone) & (F.col("title") != "") & ~F.col("hidden")
    word = has("w") & (closing | alone) & ~F.col("hidden")
    spoken = F.when(abbreviated, F.concat(F.lit(" ("), decoded(F.col("title")), F.lit(")"))).when(word, F.regexp_extract("t", rf"(?i)^<\s*/?\s*(?:{ANNOTATIONS}):([^\s/>]+)", 1))
    plain = F.translate(F.regexp_replace(decoded(F.col("t")), r"[\x00-\x1F]", " "), BULLETS, "•" * len(BULLETS))
    broken = F.col("t").isin("\r", "\n", "\r\n")
    shown = F.when(F.col("name").isNull() & ~broken & ~F.col("hidden") & (F.col("noted") == 0), plain)
    ends = (has("f") | (closing | alone) & has("e") | spoken.isNotNull() | broken) & ~F.col("hidden")
    begins = (has("n") & ~((F.col("name") == "li") & closing) | broken) & ~F.col("hidden")
    rows = rows.withColumn("said", F.coalesce(spoken, shown)).withColumn("cut", (ends | (has("x") & (F.col("away") == 1) & ~closing)).cast("int")).withColumn("own", spoken.isNotNull())
    rows = rows.withColumn("group", F.sum(F.col("cut") + F.lag(F.col("own").cast("int"), 1, 0).over(line)).over(upto))
    rows = rows.withColumn("lines", F.sum(begins.cast("int")).over(upto)).withColumn("items", F.sum((F.col("marks").contains("l") & ~closing & ~F.col("hidden")).cast("int")).over(upto))
    texts = rows.where("said <> ''")
    styles = [F.first(F.col(c) > 0).alias(c) for c in ("bold", "italic", "underline", "strike")]
    pieces = texts.groupBy(*by, "group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "said"))), lambda s: s["said"]), "").alias("text"), *styles, F.first("indent").alias("indent"), F.min("lines").alias("lines"), F.min("items").alias("items"))
    order = W.partitionBy(*by).orderBy("group")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    since = lambda c: (F.col(c) > F.lag(c, 1, 0).over(order)).alias({"lines": "newline", "items": "item"}[c])
    start = F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)).cast("bigint")
    return pieces.select(*by, (F.row_number().over(order) - 1).cast("bigint").alias("span"), "text", start.alias("start"), (start + F.length("text")).alias("end"), "bold", "italic", "underline", "strike", "indent", since("items"), since("lines"))
