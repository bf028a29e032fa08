"""Phrase collocations by level-wise (Apriori) passes over the corpus.

1. Pass k counts the phrases of k words of each language that may be frequent: those whose first and last k - 1 words both
   are (pass 1 counts all words). Frequent (k - 1)-grams travel to the tasks as a bitmap of their 64-bit keys, 16 bits a
   gram and 64 MB at most; what it lets through by mistake is counted like the rest and falls below the threshold, so
   the tables are exact at any size.
2. A task counts blocks of ``block`` words by itself, one language at a time, and sends each distinct phrase of a block once;
   no text is shuffled. The sums below ``least`` are dropped and the level is stored.
3. Every part of a frequent phrase is frequent, so a cut finds both its parts in the level tables by an equi join, in exact
   decimal arithmetic. Parts that hold a thousandth of all cuts are broadcast, so no key is hot.
4. The first ``top`` of a language are found in slices by hash first and among those then.

Words are bytes: A-Z are lower-cased, all else stays. Lengths of pieces, texts and the vocabulary are not limited: a text
is cut into words about a megabyte at a time and a block keeps four bytes a word.

Defined results: null texts are empty, a null language is ``und``; rows that repeat an id or a text all count; an empty
table gives an empty result; ties of score and count go by phrase in byte order; other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import Bitmap, Stored, lookup, table


@dataclass(frozen=True)
class Params:
    most_words: int = 3
    least: int = 10  #: occurrences of a candidate
    covered: int = 50  #: percent of a candidate's occurrences that a longer one must have to drop it
    top: int = 2000
    block: int = 1_000_000  #: words counted together in a task


#: Ends of pieces become ".", which is no part of a word then; tabs become blanks; A-Z are lower-cased.
_MAP = bytes(0x2E if c in b".,;:!?\n\x0b\x0c\r" else 0x20 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
SLICE = 1 << 20
SENT = 200_000  #: phrases in a record batch


def _tokens(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text, "." between pieces, in slices of about ``SLICE`` bytes that end between words."""
    flat, at = text.translate(_MAP), 0
    while at < len(flat):
        end = flat.find(b" ", at + SLICE) if len(flat) - at > SLICE else -1
        end = end if end >= 0 else len(flat)
        yield flat[at:end].replace(b".", b" . ").split()
        at = end


_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class Block:
    """The words of some texts of one language, as numbers; 0 stands between pieces and texts."""

    def __init__(self, lang: str):
        self.lang, self.seed = lang, xxhash.xxh32_intdigest(lang.encode())
        self.known: dict[bytes, int] = {b".": 0}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: bytes) -> None:
        known = self.known
        for words in _tokens(text):
            known.update(zip(set(words).difference(known), itertools.count(len(known))))
            self.parts.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
            self.size += len(words)
        self.parts.append(np.zeros(1, np.int32))

    def counts(self, k: int, frequent: Bitmap | None, step: int) -> Iterator[tuple[list[bytes] | pa.Array, np.ndarray, np.ndarray]]:
        """(phrases, keys, counts) of k words whose first and last k - 1 may be frequent, at most ``step`` words at a time."""
        names = np.array(list(self.known), dtype=object)
        hashes = np.array([xxhash.xxh64_intdigest(w, self.seed) for w in self.known], dtype=np.uint64)
        ids = np.concatenate(self.parts) if self.parts else np.zeros(0, np.int32)
        if k == 1:
            n = np.bincount(ids, minlength=len(names))
            yield names[1:].tolist(), _mix(hashes[1:]), n[1:]
            return
        for at in range(0, len(ids), step):
            part = ids[at : at + step + k - 1]
            found = len(part) - k + 1
            if found < 1:
                break
            within = part > 0
            ok, key = np.ones(found + 1, dtype=bool), np.zeros(found + 1, dtype=np.uint64)  # of the k - 1 words from each place on
            for j in range(k - 1):
                ok &= within[j : j + found + 1]
                key = _mix(key * _MIX[2] + hashes[part[j : j + found + 1]])
            ok[ok] = frequent.has(key[ok])
            here = np.flatnonzero(ok[:-1] & ok[1:])
            if not len(here):
                continue
            group = part[here].astype(np.int64)
            for j in range(1, k):  # phrases as numbers: those of a shorter one, renumbered, and the next word
                group = np.unique(group, return_inverse=True)[1] * np.int64(len(names)) + part[here + j]
            _, first, n = np.unique(group, return_index=True, return_counts=True)
            for i in range(0, len(first), SENT):  # few phrases are spelt at a time
                some = here[first[i : i + SENT]]
                words = [names[part[some + j]] for j in range(k)]
                yield [b" ".join(w) for w in zip(*words, strict=True)], _mix(key[some] * _MIX[2] + hashes[part[some + k - 1]]), n[i : i + SENT]


def _count(docs: DataFrame, k: int, frequent: Bitmap | None, p: Params) -> DataFrame:
    """(lang, phrase, key, n): a level's counts of the tasks' blocks; with k = 1 also each block's number of words, of no phrase."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[str, Block] = {}

        def told(block: Block) -> Iterator[pa.RecordBatch]:
            for phrases, keys, n in block.counts(k, sent.value, p.block):
                if k == 1:
                    phrases, keys, n = [*phrases, None], np.append(keys, np.uint64(0)), np.append(n, n.sum())
                for i in range(0, len(phrases), SENT):
                    some = pa.array(phrases[i : i + SENT], pa.binary()).cast(pa.string(), safe=False)
                    lang = pa.array([block.lang] * len(some), pa.string())
                    yield pa.RecordBatch.from_arrays([lang, some, pa.array(keys[i : i + SENT].view(np.int64)), pa.array(n[i : i + SENT].astype(np.int64))], names=["lang", "phrase", "key", "n"])

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                block = blocks.get(lang) or blocks.setdefault(lang, Block(lang))
                block.add(text)
                if sum(x.size for x in blocks.values()) >= p.block:
                    largest = max(blocks.values(), key=lambda x: x.size)
                    yield from told(blocks.pop(largest.lang))
        for block in blocks.values():
            yield from told(block)

    return docs.mapInArrow(run, "lang string, phrase string, key bigint, n bigint").groupBy("lang", "phrase").agg(F.max("key").alias("key"), F.sum("n").alias("n"))


def levels(docs: DataFrame, p: Params | None = None, lang: str = "lang", text: str = "text") -> list[Stored]:
    """Stored tables (lang, phrase, key, n) of the frequent phrases of 1, 2, ... words; the first has each language's words under a null phrase."""
    p = p or Params()
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out: list[Stored] = []
    for k in range(1, p.most_words + 1):
        frequent = Bitmap(out[-1].df.where("phrase is not null"), "key") if out else None
        out.append(Stored(_count(rows, k, frequent, p).where((F.col("n") >= p.least) | F.col("phrase").isNull()), f"phrases{k}"))
    return out


def collocations(docs: DataFrame, p: Params | None = None, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases by the lowest score of their cuts.

    a, l and r are the occurrences of the phrase and of the two parts of that cut, n the language's words, and score is
    the integer part of 1,000,000 * a * a / (l * r).
    """
    p = p or Params()
    tables = levels(docs, p, lang, text)
    total = tables[0].df.where("phrase is null").select("lang", F.col("n").alias("total"))
    words = F.split("phrase", " ")
    found = tables[1].df if len(tables) > 1 else tables[0].df.where("false")
    for t in tables[2:]:
        found = found.unionByName(t.df)
    grams = tables[0].df.where("phrase is not null")
    for t in tables[1:]:
        grams = grams.unionByName(t.df)

    part = lambda a, b: F.concat_ws(" ", F.slice("w", a, b))
    inside = F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("w") - m + 1), lambda i: part(i, m)))
    longer = found.withColumn("w", words).where(F.size("w") > 2).select("lang", "n", F.explode(F.flatten(inside)).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("n").alias("most"))
    kept = found.select("lang", "phrase", F.col("n").alias("a")).join(longer, ["lang", "phrase"], "left").where(F.coalesce(F.col("most"), F.lit(0)) * 100 < F.col("a") * p.covered)

    cuts = kept.withColumn("w", words).select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = Stored(cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.size("w") - F.col("k")).alias("right")), "cuts").df
    sides = Stored(cuts.select("lang", F.explode(F.array("left", "right")).alias("phrase")).groupBy("lang", "phrase").agg(F.count("*").alias("uses")).join(grams.select("lang", "phrase", "n"), ["lang", "phrase"]), "parts").df
    side = lambda name, n: sides.select("lang", F.col("phrase").alias(name), F.col("n").alias(n), "uses")
    both = lookup(lookup(cuts, side("left", "l"), ["lang", "left"], "uses"), side("right", "r"), ["lang", "right"], "uses")
    scored = both.withColumn("score", F.expr("(cast(1000000 as decimal(38,0)) * a * a) div (cast(l as decimal(38,0)) * r)"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m")).select("lang", "phrase", "a", "m.l", "m.r", "m.score")
    slices = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = "order by score desc, a desc, phrase"
    best = best.selectExpr("*", f"row_number() over (partition by lang, pmod(xxhash64(phrase), {slices}) {order}) as nth").where(F.col("nth") <= p.top)
    best = best.selectExpr("*", f"row_number() over (partition by lang {order}) as rank").where(F.col("rank") <= p.top)
    return best.join(total, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
with pieces as (select coalesce(lang, 'und') lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) piece from documents),
  w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') w from pieces),
  totals as (select lang, sum(len(w))::bigint n from w group by 1),
  g as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) phrase from w, range(1, 4) t(k)),
  f as (select lang, k, phrase, count(*)::bigint a from g group by all having count(*) >= 10),
  longer as (select lang, unnest(list_value(array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' '))) phrase, a from f where k = 3),
  most as (select lang, phrase, max(a) a from longer group by 1, 2),
  c as (select f.*, string_split(f.phrase, ' ') w from f left join most using (lang, phrase) where k > 1 and 100 * coalesce(most.a, 0) < 50 * f.a),
  cuts as (select *, unnest(range(1, k)) cut from c),
  s as (select c.lang, c.phrase, c.a, c.cut, x.a l, y.a r, ((1000000::hugeint * c.a * c.a) // (x.a::hugeint * y.a))::bigint score from cuts c
    join f x on x.lang = c.lang and x.phrase = array_to_string(c.w[1 : c.cut], ' ') join f y on y.lang = c.lang and y.phrase = array_to_string(c.w[c.cut + 1 : c.k], ' ')),
  b as (select * from s qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
  r as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) rank from b)
select lang, rank, phrase, a, l, r, n, score from r join totals using (lang) where rank <= 2000
"""
