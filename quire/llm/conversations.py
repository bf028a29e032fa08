"""Repair of the structure of conversations: faults found, cheapest edits to alternating turns, edits replayed.

A repaired conversation's roles read ``(s?(ua)+)?``: nothing, or pairs of user and assistant after a system row at most. Rows
are kept (free), given the role user or assistant, or deleted; rows of these roles without text are inserted. Blank and
duplicate rows have to go; a truncated one that stays costs extra. Of the cheapest edits those come first whose initials do.

1. Rows are dealt by conversation and sorted. One letter a row, its role and fault, makes a conversation's signature.
2. Each distinct signature is solved once: the cheapest edits from a row and role on, remembered for all four states and
   worked out from the last row back. Options at a row have different initials, so ties need no texts of edits.
3. Edits join back by signature. Signatures of a thousandth of all conversations or more are broadcast (they are a thousand
   at most and hold a thousand average conversations' letters at most), so none is hot.
4. Edits are laid before their conversation's rows, dealt and sorted again, and replayed row by row.

A conversation's rows pass through one task in order, since a digest of its whole text is one chain, but none is held: sorts
spill, and a task keeps a letter a row, or the edits' letters, of one conversation.

Defined results: a null id is one conversation, and as text one space; null roles and texts are one space; null turns come
first and are no gap; rows of equal turns are ordered by role and text, so copies are adjacent; roles count by their
first letter, s, u or a, others (empty ones too) are legal nowhere; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import Stored, lookup, table


@dataclass(frozen=True)
class Params:
    rerole: int = 3
    delete: int = 4
    insert: int = 3  #: over 0
    truncated: int = 3  #: more for a truncated row that stays


#: What follows from a state (0 begin, 1 system, 2 user, 3 assistant) with a row of a role; the role it waits for.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
WAITS = (2, 2, 3, 2)
NAMES = {2: "user", 3: "assistant"}
FAR = 1 << 60


def solve(signature: str, p: Params | None = None) -> tuple[int, str]:
    """(cost, initials of the cheapest edits in order, the ASCII-least of equal ones) of a signature.

    Letters are s, u, a, x for roles (x any other), upper case if truncated, and d for rows that have to go.
    """
    p = p or Params()
    memo = [bytearray(len(signature) + 1) for _ in NEXT]  # the edit to make from each state and row on

    def best(i: int, after: list[int]) -> list[int]:
        """Costs from row i on by state, given those from the next row on."""
        found = []
        for q in range(4):
            if i == len(signature):
                options = [(0 if q in (0, 3) else FAR, "")]
            else:
                row = signature[i]
                options = [(p.delete + after[q], "D")]
                if row != "d":
                    extra = p.truncated if row.isupper() else 0
                    options.append((p.rerole + extra + after[WAITS[q]], "R"))
                    if row.lower() in NEXT[q]:
                        options.append((extra + after[NEXT[q][row.lower()]], "K"))
            found.append(min(options))
        for q in (2, 3):  # one insertion leads from either to the other; a second would lead back
            found[q] = min(found[q], (p.insert + found[WAITS[q]][0], "I")) if found[WAITS[q]][1] != "I" else found[q]
        for q in (0, 1):
            found[q] = min(found[q], (p.insert + found[2][0], "I"))
        for q in range(4):
            memo[q][i] = ord(found[q][1] or ".")
        return [c for c, _ in found]

    costs: list[int] = []
    for i in range(len(signature), -1, -1):
        costs = best(i, costs)
    edits, q, i = bytearray(), 0, 0
    while (edit := memo[q][i]) != ord("."):
        edits.append(edit)
        if edit == ord("I"):
            q = WAITS[q]
            continue
        if edit == ord("K"):
            q = NEXT[q][signature[i].lower()]
        elif edit == ord("R"):
            q = WAITS[q]
        i += 1
    return costs[0], edits.decode()


def replay(edits: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the rows that (role, text) rows become."""
    q, rows = 0, iter(rows)
    for edit in edits:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        q = NEXT[q][role[:1]] if edit == "K" else WAITS[q]
        yield edit, role if edit == "K" else NAMES[q], text


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: rows damaged by crc32 of ``conv_id:turn``; dropped ones stay, marked as gone."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    rows = rows.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"), kind.alias("kind"))
    rows = rows.withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
    rows = rows.withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", "role", "text", (F.col("kind") == 0).alias("gone"), F.explode(copies).alias("copy")).drop("copy")


ORDER = ["turn", "role", "text"]  # nulls first


def _tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*[c.to_pylist() for c in b.columns], strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 5000, chars: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    """Record batches of at most so many rows and about so many characters."""
    some, size = [], 0
    for r in itertools.chain(rows, [None]):
        if r is not None:
            some.append(r)
            size += sum(len(x) for x in r if isinstance(x, str))
        if some and (r is None or len(some) >= most or size >= chars):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), schema.types, strict=True)], schema=schema)
            some, size = [], 0


def _profile(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, signature of (conv_id, turn, role, text, gone) rows."""
    white = r"\x20\x09-\x0D"
    again = F.row_number().over(W.partitionBy("conv_id", "gone", "role", "text").orderBy("turn"))
    text = F.col("text")
    fault = F.when(~text.rlike(f"[^{white}]"), "b").when(F.col("again") > 1, "d").when(~text.rlike(rf"[.!?][{white}]*\z"), "t").otherwise("k")
    dealt = rows.repartition("conv_id").withColumn("again", again).withColumn("fault", fault).sortWithinPartitions("conv_id", *ORDER, "again")
    kind = rows.schema["conv_id"].dataType.simpleString()
    shape = f"conv_id {kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, signature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.DataType] = []

        def seen() -> Iterator[pa.RecordBatch]:
            for b in batches:
                held[:] = [b.schema.field(0).type]
                yield b

        def told() -> Iterator[tuple]:
            for conv, group in itertools.groupby(_tuples(seen()), key=lambda r: r[0]):
                count, letters, before, illegal = dict.fromkeys("bdtk", 0), bytearray(), None, 0
                low = high = None
                turns = 0
                for _, turn, role, found, gone in group:
                    if gone:
                        continue
                    if turn is not None and (high is None or turn != high):
                        low, high, turns = turn if low is None else low, turn, turns + 1
                    count[found] += 1
                    role = role if role in ("s", "u", "a") else "x"
                    illegal += before is not None and before + role not in ("su", "ua", "au")
                    before = role
                    letters += ("d" if found in "bd" else role.upper() if found == "t" else role).encode()
                gaps = high - low + 1 - turns if turns else 0
                yield conv, gaps, count["b"], count["d"], count["t"], illegal, letters.decode()

        rows = told()
        first = next(rows, None)
        if first is not None:
            whole = [("conv_id", held[0]), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal")), ("signature", pa.string())]
            yield from _batches(itertools.chain([first], rows), pa.schema(whole))

    return dealt.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.left("role", F.lit(1)).alias("role"), "fault", "gone").mapInArrow(run, shape)


def _solved(rows: DataFrame, p: Params) -> DataFrame:
    """_profile's rows with cost and audit; each distinct signature is solved once."""
    found = Stored(_profile(rows), "profiles").df

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [solve(s, p) for s in b["signature"]]
            yield b.assign(cost=[c for c, _ in done], audit=[a for _, a in done])

    once = found.groupBy("signature").agg(F.count("*").alias("uses"))
    solved = Stored(once.mapInPandas(run, "signature string, uses bigint, cost bigint, audit string"), "solved").df
    return lookup(found, solved, ["signature"], "uses")


STATS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _replayed(rows: DataFrame, p: Params, digest: bool) -> DataFrame:
    solved = _solved(rows, p).select("conv_id", F.lit(0).alias("kind"), "audit", F.struct(*STATS).alias("stats"))
    texts = rows.where("not gone").select("conv_id", F.lit(1).alias("kind"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    both = solved.unionByName(texts, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *ORDER)
    kind = rows.schema["conv_id"].dataType.simpleString()
    shape = f"conv_id {kind}, " + (", ".join(f"{s} bigint" for s in STATS) + ", audit string, repaired_sha256 string" if digest else "position bigint, edit string, role string, text string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.DataType] = []

        def seen() -> Iterator[pa.RecordBatch]:
            for b in batches:
                held[:] = [b.schema.field(0).type]
                yield b

        def told() -> Iterator[tuple]:
            for conv, group in itertools.groupby(_tuples(seen()), key=lambda r: r[0]):
                _, audit, stats, _, _ = next(group)
                done = replay(audit, ((role, text) for *_, role, text in group))
                if digest:
                    sha = hashlib.sha256()
                    for i, (_, role, text) in enumerate(done):
                        sha.update(f"{chr(10) if i else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
                    yield conv, *[stats[s] for s in STATS], audit, sha.hexdigest()
                else:
                    yield from ((conv, i, *r) for i, r in enumerate(done))

        rows = told()
        first = next(rows, None)
        if first is not None:
            names = [*((s, pa.int64()) for s in STATS), ("audit", pa.string()), ("repaired_sha256", pa.string())] if digest else [("position", pa.int64()), *((n, pa.string()) for n in ("edit", "role", "text"))]
            yield from _batches(itertools.chain([first], rows), pa.schema([("conv_id", held[0]), *names]))

    return both.select("conv_id", "audit", "stats", "role", "text").mapInArrow(run, shape)


def _ready(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone, of rows that may lack the last."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    return rows.select("conv_id", "turn", name("role"), name("text"), gone.alias("gone"))


def audits(rows: DataFrame, p: Params | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation of (conv_id, turn, role, text) rows."""
    return _replayed(_ready(rows), p or Params(), digest=True)


def repair(rows: DataFrame, p: Params | None = None) -> DataFrame:
    """conv_id, position (from 0), edit (K, R or I), role, text: the rows of the repaired conversations."""
    return _replayed(_ready(rows), p or Params(), digest=False)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits(damage(table(spark, sf_dir, "conversations")))


def _sql() -> str:
    """The same in DuckDB SQL: the costs as a fold over a conversation's rows from the last back, four states at a time."""
    add = lambda cost, letter, state: f"{{'c': x.{state}.c + {cost}, 't': '{letter}' || x.{state}.t}}"
    extra = "(case when r.f = 't' then 3 else 0 end)"

    def raw(state: str, waits: str, keeps: dict[str, str]) -> str:
        stays = "r.f in ('t', 'k')"
        kept = "".join(f", case when {stays} and r.i = '{i}' then {add(extra, 'K', to)} end" for i, to in keeps.items())
        return f"least({add(4, 'D', state)}, case when {stays} then {add(f'3 + {extra}', 'R', waits)} end{kept})"

    b, s, u, a = raw("b", "u", {"s": "s", "u": "u"}), raw("s", "u", {"u": "u"}), raw("u", "a", {"a": "a"}), raw("a", "u", {"u": "u"})
    put = lambda of: f"{{'c': ({of}).c + 3, 't': 'I' || ({of}).t}}"
    u_all = f"least({u}, {put(a)})"
    step = f"{{'b': least({b}, {put(u_all)}), 's': least({s}, {put(u_all)}), 'u': {u_all}, 'a': least({a}, {put(u)})}}"
    first = "{'b': {'c': 0, 't': ''}, 's': {'c': 6, 't': 'II'}, 'u': {'c': 3, 't': 'I'}, 'a': {'c': 0, 't': ''}}"
    return rf"""
with crc as (select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, j: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) t),
  named as (select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') k from conversations),
  kinds as (select named.*, xor(list_reduce(list_transform(string_split(k, ''), lambda c: ascii(c)::bigint), lambda h, c: xor(h >> 8, t[(xor(h, c) & 255) + 1]), 4294967295), 4294967295) % 20 d from named, crc),
  rows as (select conv_id, turn, case when d = 4 then 'user' else role end role, case d when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end text,
    unnest(range(case when d = 3 then 2 else 1 end)) from kinds where d <> 0),
  seen as (select *, left(role, 1) i, row_number() over (partition by conv_id, role, text order by turn nulls first) again from rows),
  placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, again) nth from seen),
  faults as (select *, lag(i) over (partition by conv_id order by nth) before, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'b' when again > 1 then 'd'
    when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 't' else 'k' end f from placed),
  convs as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (f = 'b') blank, count(*) filter (f = 'd') duplicate, count(*) filter (f = 't') truncated,
    count(*) filter (nth > 1 and before || i not in ('su', 'ua', 'au')) illegal, list({{'i': i, 'f': f, 'role': role, 'text': text}} order by nth) rs from faults group by 1),
  solved as (select *, list_reduce(list_transform(list_reverse(rs), lambda r: {{'i': r.i, 'f': r.f}}), lambda x, r: {step}, {first}).b best from convs),
  edits as (select conv_id, rs, best.t t, unnest(range(1, len(best.t) + 1)) p from solved),
  turned as (select conv_id, p, t[p] e, rs[len(replace(t[1:p], 'I', ''))] r, len(replace(t[1:p], 'D', '')) place, ltrim(t, 'D')[1] = 'K' and rs[len(t) - len(ltrim(t, 'D')) + 1].i = 's' led from edits),
  made as (select conv_id, p, case when e = 'K' then r.role when (place - led::int) % 2 = 1 then 'user' else 'assistant' end || ':' || case when e = 'I' then '' else r.text end line from turned where e <> 'D'),
  texts as (select conv_id, string_agg(line, chr(10) order by p) whole from made group by 1)
select o.conv_id, coalesce(gaps, 0)::bigint gaps, coalesce(blank, 0)::bigint blank, coalesce(duplicate, 0)::bigint duplicate, coalesce(truncated, 0)::bigint truncated, coalesce(illegal, 0)::bigint illegal,
  coalesce(best.c, 0)::bigint as cost, coalesce(best.t, '') audit, sha256(coalesce(whole, '')) repaired_sha256
from (select distinct conv_id from conversations) o left join solved s on s.conv_id is not distinct from o.conv_id left join texts x on x.conv_id is not distinct from o.conv_id
"""


OP13_SQL = _sql()
