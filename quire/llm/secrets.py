"""Secret scans by a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived: every text that the rule matches satisfies
it. The index holds, for each trigram that some query names, the ids of the documents whose lower-cased text contains it;
intersecting postings by the queries leaves candidates, and only these are searched with the rule itself. A rule without
a mandatory trigram is searched in every text.

The index is stored: posting lists, sorted, one for each trigram and bucket of about ``bucket_rows`` documents (by a hash of
the id), so a list is bounded however many documents hold a trigram. Queries are evaluated bucket by bucket, an "and" as the
intersection of lists, an "or" as their union. Candidates meet their texts by id: a bitmap of fixed size tells texts that
can't be candidates, which are not shuffled; of the others Spark joins. As the search itself decides, an id that several
rows share only makes all of them candidates.
Defined results: a null text counts as empty and has no spans; rows with a null id can't be looked up, so every rule
searches them; repeated rows give repeated rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from re import _constants as rc
from re import _parser as rp

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import Stored, likely, matches, sql_text, table


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    check: str = "true"  #: SQL over the match x
    base: bool = True


_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = (
    Rule("assign", _ASSIGN, f"length(regexp_extract(x.m, {sql_text(_ASSIGN)}, 2)) >= 6"),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),  # a shorter run has no longer match inside it
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", base=False),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", base=False),
    Rule("slack", r"xox[baprs]-[A-Za-z0-9-]{10,}", base=False),
)
#: Exact strings that one part of a pattern may stand for before it counts as unknown.
MOST_STRINGS = 64

Query = tuple  # ("all",) | ("tri", t) | ("and", q...) | ("or", q...)
ALL: Query = ("all",)


def _join(kind: str, parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    if kind == "and":
        parts = [p for p in parts if p != ALL]
    elif ALL in parts:
        return ALL
    else:  # an alternative that asks for more than another adds nothing
        asks = {p: {p} if p[0] == "tri" else set(p[1:]) if p[0] == "and" else None for p in parts}
        parts = [p for p in parts if not any(o != p and asks[o] is not None and asks[p] is not None and asks[o] < asks[p] for o in parts)]
    return ALL if not parts else parts[0] if len(parts) == 1 else (kind, *parts)


def _of_strings(strings: set[str]) -> Query:
    """What a text holds that contains one of the strings."""
    return _join("or", [_join("and", [("tri", s[i : i + 3]) for i in range(len(s) - 2)]) for s in sorted(strings)])


def _class(items: list) -> set[str] | None:
    found: set[str] = set()
    for op, arg in items:
        if op is rc.LITERAL:
            found.add(chr(arg).lower())
        elif op is rc.RANGE and arg[1] - arg[0] < 8:
            found |= {chr(x).lower() for x in range(arg[0], arg[1] + 1)}
        else:
            return None
    return found


def _analyse(nodes) -> tuple[set[str] | None, Query]:
    """(the strings that the nodes stand for, if few; a query that every text with a match satisfies)."""
    run, exact, query = {""}, True, []
    for op, arg in nodes:
        strings, inner = None, ALL
        if op is rc.LITERAL:
            strings = {chr(arg).lower()}
        elif op is rc.IN:
            strings = _class(arg)
        elif op is rc.SUBPATTERN:
            strings, inner = _analyse(arg[3])
        elif op is rc.BRANCH:
            each = [_analyse(x) for x in arg[1]]
            if all(s is not None for s, _ in each):
                strings = set().union(*(s for s, _ in each))
            inner = _join("or", [_of_strings(s) if s is not None else q for s, q in each])
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT, rc.POSSESSIVE_REPEAT):
            low, high, body = arg
            part, q = _analyse(body)
            if part is not None and high <= 2:
                strings = {"".join(x) for n in range(low, high + 1) for x in itertools.product(part, repeat=n)}
            elif part is not None and len(part) == 1 and 0 < low:
                run = {r + p * low for r in run for p in part}
            inner = q if low else ALL
        elif op is rc.AT or op is rc.ASSERT or op is rc.ASSERT_NOT:
            strings = {""}
        if strings is not None and len(strings) * len(run) <= MOST_STRINGS:
            run = {r + s for r in run for s in strings}
        else:
            query += [_of_strings(run), inner if strings is None else _of_strings(strings)]
            run, exact = {""}, False
    return (run, _of_strings(run)) if exact else (None, _join("and", [*query, _of_strings(run)]))


def trigram_query(pattern: str) -> Query:
    """A Boolean query over lower-case trigrams; ("all",) if the pattern has none that is mandatory."""
    return _analyse(rp.parse(pattern))[1]


def trigrams(q: Query) -> set[str]:
    return {q[1]} if q[0] == "tri" else set().union(*(trigrams(x) for x in q[1:]), set())


def _lists(q: Query, column: dict[str, str], none: str) -> str:
    """SQL: the ids that satisfy the query, from a column of ids for each trigram."""
    if q[0] == "tri":
        return f"coalesce({column[q[1]]}, {none})"
    fold = "array_intersect" if q[0] == "and" else "array_union"
    out = _lists(q[1], column, none)
    for x in q[2:]:
        out = f"{fold}({out}, {_lists(x, column, none)})"
    return out


def index(docs: DataFrame, wanted: set[str], id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 16_384) -> DataFrame:
    """Postings (bucket, trigram, ids): sorted ids of the documents of a bucket whose lower-cased text holds a wanted trigram."""
    buckets = max(1, -(-docs.count() // bucket_rows))
    all_of = f"array({', '.join(sql_text(t) for t in sorted(wanted))})"
    low = docs.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("id"), F.lower(F.col(f"`{text_col}`")).alias("low"))
    rows = low.select(F.pmod(F.xxhash64("id"), F.lit(buckets)).alias("bucket"), "id", F.explode(F.expr(f"filter({all_of}, t -> contains(low, t))")).alias("trigram"))
    return rows.groupBy("bucket", "trigram").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def candidates(postings: DataFrame, queries: dict[str, Query], id_col: str = "doc_id") -> DataFrame:
    """(id_col, rules array<string>): the rules whose query the document's postings satisfy, where there are any."""
    names = {t: f"t{i}" for i, t in enumerate(sorted(set().union(*map(trigrams, queries.values()))))}
    none = f"cast(array() as {dict(postings.dtypes)['ids']})"
    laid = postings.groupBy("bucket").agg(*[F.first(F.when(F.col("trigram") == t, F.col("ids")), ignorenulls=True).alias(c) for t, c in names.items()])
    each = ", ".join(f"transform({_lists(q, names, none)}, x -> named_struct('id', x, 'rule', {sql_text(n)}))" for n, q in queries.items())
    found = laid.select(F.inline(F.expr(f"concat({each})")))
    return found.groupBy("id").agg(F.collect_set("rule").alias("rules")).withColumnRenamed("id", id_col)


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 16_384) -> DataFrame:
    """id_col, spans array<struct<start, place, kind, end>> by start, then the rules' order."""
    queries = {r.name: trigram_query(r.pattern) for r in rules}
    indexed = {n: q for n, q in queries.items() if q != ALL}
    docs = docs.select(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    if indexed:
        postings = Stored(index(docs, set().union(*map(trigrams, indexed.values())), id_col, "t", bucket_rows), "postings")
        found = Stored(candidates(postings.df, indexed, id_col), "candidates").df
        postings.drop()
        split = likely(docs, F.col(f"`{id_col}`"), found, F.col(f"`{id_col}`"))
        rest = split.where("not _likely").drop("_likely").withColumn("rules", F.lit(None).cast("array<string>"))
        docs = split.where("_likely").drop("_likely").join(found, id_col, "left").unionByName(rest)
    else:
        docs = docs.withColumn("rules", F.lit(None).cast("array<string>"))
    none = "cast(array() as array<struct<start:bigint,place:int,kind:string,end:bigint>>)"
    each = []
    for place, r in enumerate(rules):
        spans = f"transform(filter({matches('t', r.pattern)}, x -> {r.check}), x -> named_struct('start', x.start, 'place', {place}, 'kind', '{r.name}', 'end', x.end))"
        search = "true" if r.name not in indexed else f"(`{id_col}` is null or coalesce(array_contains(rules, '{r.name}'), false))"
        each.append(f"if({search}, {spans}, {none})")
    return docs.select(id_col, F.expr(f"array_sort(concat({', '.join(each)}))").alias("spans"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    base = ", ".join(f"'{r.name}'" for r in RULES if r.base)
    said = "concat(x.kind, ':', x.start, ':', x.end)"
    return found.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(spans, x -> x.kind = '{r.name}')) as bigint)").alias(f"n_{r.name}") for r in RULES if r.base],
        F.expr(f"sha2(array_join(transform(filter(spans, x -> x.kind in ({base})), x -> {said}), ','), 256)").alias("base_sha256"),
        F.expr(f"array_join(transform(spans, x -> {said}), ',')").alias("spans"),
    )


def _duck_spans(kind: str, rx: str, check: str = "true") -> str:
    rx = rx.replace("'", "''")
    return f"""
  {kind}_l as (select rid, regexp_split_to_array(t, '{rx}') g, regexp_extract_all(t, '{rx}') ms from d where regexp_matches(t, '{rx}')),
  {kind}_p as (select rid, g, ms, unnest(range(1, len(ms) + 1)) i from {kind}_l),
  {kind}_s as (select rid, '{kind}' kind, e - length(m) s, e from (
    select rid, ms[i] m, list_sum(list_transform(g[1:i], lambda x: length(x)))::bigint + list_sum(list_transform(ms[1:i], lambda x: length(x)))::bigint e from {kind}_p) where {check})"""


_D_ASSIGN = """(?i)(?:password|passwd|secret|token|api_?key)["']? *[:=] *["']?[A-Za-z0-9+/_.=-]+"""
_D_VALUE = _D_ASSIGN.replace("[A-Za-z0-9+/_.=-]+", "([A-Za-z0-9+/_.=-]+)").replace("'", "''")
OP8_SQL = f"""
with d as (select row_number() over () rid, doc_id, coalesce(text, '') t from documents),
{_duck_spans("assign", _D_ASSIGN, f"length(regexp_extract(m, '{_D_VALUE}', 1)) >= 6")},
{_duck_spans("access", "AKIA[A-Z0-9]+", "length(m) >= 20")},
{_duck_spans("hex", "[0-9a-f]+", "length(m) >= 24")},
{_duck_spans("pem", "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----")},
{_duck_spans("github", "gh[pousr]_[A-Za-z0-9]{36,}")},
{_duck_spans("slack", "xox[baprs]-[A-Za-z0-9-]{10,}")},
  a as (select * from assign_s union all select * from access_s union all select * from hex_s union all select * from pem_s union all select * from github_s union all select * from slack_s),
  o as (select *, list_position(['assign', 'access', 'hex', 'pem', 'github', 'slack'], kind) k, kind || ':' || s || ':' || e said from a),
  g as (select rid, count(*) filter (k = 1) n_assign, count(*) filter (k = 2) n_access, count(*) filter (k = 3) n_hex,
    string_agg(said, ',' order by s, k) filter (k <= 3) base, string_agg(said, ',' order by s, k) spans from o group by rid)
select doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex,
  sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans
from d left join g using (rid)
"""
