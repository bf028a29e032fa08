"""Personal data: regular expressions propose spans, checksums confirm them, nearby context words adjust the score.

Everything is a Spark SQL expression over one row: one scan, no shuffle, no Python. Patterns are written so that a long
run of one character class is read once (possessive, entered only at the start of a run), and positions are summed in
blocks, so very long texts stay linear. Context words are whole words within 40 code points before or after a span.

Kinds: email, ip (parts at most 255), card (Luhn), phone (9 to 15 digits) are the base kinds and always stay; iban
(mod-97) and ssn (needs a context word) are added by score.
Defined results: a null text counts as empty and has no spans; null ids stay null; repeated rows give repeated rows; an
empty table gives an empty result. ``redact`` replaces exactly the spans that ``find`` reports (those that overlap as one);
other columns are kept by it and ignored by ``find``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import matches, sql_text, table, without

_DIGITS = "regexp_replace(x.m, '[^0-9]', '')"
#: Luhn over the digits of x.m, from the right; every second digit is doubled.
_LUHN = (
    f"aggregate(sequence(1, length({_DIGITS})), 0, (a, i) -> a + if(i % 2 = 1, cast(substring({_DIGITS}, -i, 1) as int), "
    f"element_at(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), cast(substring({_DIGITS}, -i, 1) as int) + 1))) % 10 = 0"
)
_IBAN = "replace(x.m, ' ', '')"
#: The country and check digits go last, letters count 10 to 35, and the number leaves 1 on division by 97.
_MOD97 = (
    f"length({_IBAN}) between 15 and 34 and aggregate(sequence(0, length({_IBAN}) - 1), 0, (a, i) -> "
    f"pmod(if(ascii(substring({_IBAN}, (i + 4) % length({_IBAN}) + 1, 1)) >= 65, a * 100 + ascii(substring({_IBAN}, (i + 4) % length({_IBAN}) + 1, 1)) - 55, "
    f"a * 10 + ascii(substring({_IBAN}, (i + 4) % length({_IBAN}) + 1, 1)) - 48), 97)) = 1"
)
_LOCAL = "A-Za-z0-9._%+-"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str  #: proposes spans
    check: str  #: SQL over the match x, that confirms a span
    score: float
    context: str  #: words near the span that raise the score
    base: bool = True


KINDS = (
    Kind("email", rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "true", 0.9, "mail|contact|write"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"x.m rlike '^(?:0*+(?:(?:(?<=0)|25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]))(?:[.]|$)){4}$'", 0.7, "ip|host|server|address"),
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])", _LUHN, 0.95, "card|visa|credit|payment"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", f"length({_DIGITS}) between 9 and 15", 0.6, "phone|tel|call|mobile|fax"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9])++", _MOD97, 0.95, "iban|account|bank", False),
    Kind("ssn", r"(?<![0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}", "true", 0.4, "ssn|social security", False),
)
RAISE, LEAST = 0.3, 0.5


def _near(k: Kind) -> str:
    return rf"(?:^|[^a-z0-9_])(?:{k.context})(?:[^a-z0-9_]|$)"


def _score(k: Kind) -> str:
    return f"least(1.0D, {k.score}D + if(lower(concat(x.pre, ' ', x.post)) rlike {sql_text(_near(k))}, {RAISE}D, 0D))"


def _stays(k: Kind) -> str:
    return f"({k.check})" if k.base else f"({k.check}) and {_score(k)} >= {LEAST}D"


def _found(k: Kind, text: str, fields: str) -> str:
    return f"transform(filter({matches(text, k.pattern)}, x -> {_stays(k)}), x -> named_struct({fields}))"


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, spans array<struct<kind, start, end, score>> by kind as listed, then start."""
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    each = [_found(k, "t", f"'kind', '{k.name}', 'start', x.start, 'end', x.end, 'score', {_score(k)}") for k in KINDS]
    return docs.select(F.col("id").alias(id_col), F.expr(f"concat({', '.join(each)})").alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns, each span found replaced by its kind, as in ``[EMAIL]``; a null text stays null."""
    spans = [_found(k, f"`{text_col}`", f"'start', x.start, 'end', x.end, 'by', '[{k.name.upper()}]'") for k in KINDS]
    return docs.withColumn(text_col, F.expr(without(f"`{text_col}`", f"concat({', '.join(spans)})")))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    base = ", ".join(f"'{k.name}'" for k in KINDS if k.base)
    said = "concat(x.kind, ':', x.start, ':', x.end)"
    return found.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(spans, x -> x.kind = '{k.name}')) as bigint)").alias(f"n_{k.name}") for k in KINDS if k.base],
        F.expr(f"sha2(array_join(transform(filter(spans, x -> x.kind in ({base})), x -> {said}), ','), 256)").alias("base_sha256"),
        F.expr(f"array_join(transform(spans, x -> {said}), ',')").alias("spans"),
        F.expr("array_join(transform(spans, x -> concat(x.kind, ':', x.start, ':', cast(round(100 * x.score) as int))), ',')").alias("scores"),
    )


def _duck_spans(kind: str, rx: str, check: str) -> str:
    k = next(k for k in KINDS if k.name == kind)
    near = f"regexp_matches(lower(pre || ' ' || post), '{_near(k)}')"
    score = f"least(100, {round(100 * k.score)} + case when {near} then {round(100 * RAISE)} else 0 end)"
    return f"""
  {kind}_l as (select rid, regexp_split_to_array(t, '{rx}') g, regexp_extract_all(t, '{rx}') ms from d where regexp_matches(t, '{rx}')),
  {kind}_p as (select rid, g, ms, unnest(range(1, len(ms) + 1)) i from {kind}_l),
  {kind}_s as (select rid, '{kind}' kind, e - length(m) s, e, {score} score from (
    select rid, i, ms[i] m, right(g[i], {CONTEXT_N}) pre, left(g[i + 1], {CONTEXT_N}) post, list_sum(list_transform(g[1:i], lambda x: length(x)))::bigint + list_sum(list_transform(ms[1:i], lambda x: length(x)))::bigint e from {kind}_p)
    where {check}{'' if k.base else f' and {score} >= {round(100 * LEAST)}'})"""


CONTEXT_N = 40
_D_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_D_LUHN = f"length({_D_DIGITS}) between 13 and 19 and list_sum(list_transform(range(1, length({_D_DIGITS}) + 1), lambda i: case when i % 2 = 1 then {_D_DIGITS}[-i]::int else ([0, 2, 4, 6, 8, 1, 3, 5, 7, 9])[{_D_DIGITS}[-i]::int + 1] end)) % 10 = 0"
_D_IBAN = "replace(m, ' ', '')"
_D_MOD97 = f"length({_D_IBAN}) between 15 and 34 and (array_to_string(list_transform(range(0, length({_D_IBAN})), lambda i: case when ascii({_D_IBAN}[(i + 4) % length({_D_IBAN}) + 1]) >= 65 then (ascii({_D_IBAN}[(i + 4) % length({_D_IBAN}) + 1]) - 55)::varchar else {_D_IBAN}[(i + 4) % length({_D_IBAN}) + 1] end), '')) is not null and list_reduce(list_prepend(0::bigint, list_transform(range(0, length({_D_IBAN})), lambda i: ascii({_D_IBAN}[(i + 4) % length({_D_IBAN}) + 1])::bigint)), lambda a, c: case when c >= 65 then (a * 100 + c - 55) % 97 else (a * 10 + c - 48) % 97 end) = 1"
OP2_SQL = f"""
with d as (select row_number() over () rid, doc_id, coalesce(text, '') t from documents),
{_duck_spans("email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+", "true")},
{_duck_spans("ip", "[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+", "list_max(list_transform(string_split(m, '.'), lambda x: case when length(ltrim(x, '0')) > 3 then 999 else coalesce(nullif(ltrim(x, '0'), ''), '0')::int end)) <= 255")},
{_duck_spans("card", "[0-9](?:[ -]?[0-9])+", _D_LUHN)},
{_duck_spans("phone", "[+][0-9][ ().0-9-]+[0-9]", f"length({_D_DIGITS}) between 9 and 15")},
{_duck_spans("iban", "[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9])+", _D_MOD97)},
{_duck_spans("ssn", "[0-9]{3}-[0-9]{2}-[0-9]{4}", "not regexp_matches(pre, '[0-9]$')")},
  a as (select * from email_s union all select * from ip_s union all select * from card_s union all select * from phone_s union all select * from iban_s union all select * from ssn_s),
  o as (select *, list_position(['email', 'ip', 'card', 'phone', 'iban', 'ssn'], kind) k, kind || ':' || s || ':' || e said from a),
  g as (select rid, count(*) filter (k = 1) n_email, count(*) filter (k = 2) n_ip, count(*) filter (k = 3) n_card, count(*) filter (k = 4) n_phone,
    string_agg(said, ',' order by k, s) filter (k <= 4) base, string_agg(said, ',' order by k, s) spans,
    string_agg(kind || ':' || s || ':' || score, ',' order by k, s) scores from o group by rid)
select doc_id, coalesce(n_email, 0) n_email, coalesce(n_ip, 0) n_ip, coalesce(n_card, 0) n_card, coalesce(n_phone, 0) n_phone,
  sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans, coalesce(scores, '') scores
from d left join g using (rid)
"""
