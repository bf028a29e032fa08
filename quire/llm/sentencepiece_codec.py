"""SentencePiece encoding and decoding by a distinct-chunk table.

Where no piece of a model crosses from text into a whitespace marker, the marked text falls apart into chunks (markers,
then text) that are segmented independently of each other.

1. One pass cuts the texts into blocks of documents. A block numbers its distinct chunks; a document becomes the array of
   its chunks' numbers, in order. Blocks end at ``block_chars`` characters or ``block_chunks`` chunks, between documents.
2. The table: each block's chunks, as one list for each of ``buckets`` hashes, are shuffled by hash, so a chunk of the corpus
   is met in one place whoever holds it. It is segmented and decoded there once, and the results go back to the blocks.
3. Block by block the numbers are replaced by the results, which joins ids back by position.

Documents' numbers are stored in buckets by block, where the pass writes them, and never shuffled; texts neither. What is
shuffled is each block's distinct chunks, there and their ids back. A task holds one block (in the table one hash's chunks);
a chunk that every block has is met as often as there are blocks.

Defined results: a null or empty text has no ids and decodes to the empty text. Ids are exactly the library's
``encode(text)`` without begin or end ids. Very long texts and very long chunks are encoded whole (a document is never cut,
so a block is as large as its largest document at least). Repeated rows give repeated rows; null ids stay null; only the
named columns are read, so others may have any name. A model whose pieces can cross a marker, or that normalises text,
is served by plain whole-text calls.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import Bucketed, table

MARK = "▁"


@dataclass(frozen=True)
class Params:
    block_chunks: int = 600_000  #: distinct chunks of a block at which it ends
    block_chars: int = 32_000_000  #: characters at which it ends
    buckets: int = 1024  #: hashes of chunks; the chunks of one are held by a task


class Codec:
    """Encodes and decodes with one model; not shared between processes."""

    def __init__(self, model_file: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        spec = pb.ModelProto.FromString(self.sp.serialized_model_proto())
        norm = spec.normalizer_spec
        pieces = [p.piece for p in spec.pieces if p.type in (1, 4)]
        self.separable = (
            not norm.precompiled_charsmap
            and norm.add_dummy_prefix
            and not norm.remove_extra_whitespaces
            and norm.escape_whitespaces
            and not spec.trainer_spec.treat_whitespace_as_suffix
            and spec.trainer_spec.model_type == 2
            and MARK in pieces
            and all(re.fullmatch(f"{MARK}*[^{MARK}]*", p) for p in pieces)
        )
        self.mark_id = self.sp.piece_to_id(MARK)

    def segment(self, chunks: list[str]) -> tuple[list[list[int]], list[str]]:
        """(ids, decoded text with its leading space) of marked chunks."""
        found = self.sp.encode([c[1:].replace(MARK, " ") for c in chunks], num_threads=1)
        found = [ids or [self.mark_id] for ids in found]
        return found, [" " + t for t in self.sp.decode(found, num_threads=1)]

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(list(ids)) if len(ids) else ""


class _Numbers(dict):
    """Numbers chunks in the order in which they are met."""

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        return n


def chunks(text: str) -> list[str]:
    return _SPLIT(MARK + text.replace(" ", MARK))


#: Chunks of a block whose numbers fit in three bytes.
_NARROW = 1 << 24
_SPLIT = re.compile(f"{MARK}+[^{MARK}]*").findall


def _planes(x: np.ndarray, wide: bool) -> bytes:
    """The numbers' lowest bytes, then their second ones and so on, three or, if ``wide``, four: they pack better so."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T[: 4 if wide else 3].tobytes()


def _numbers(planes: bytes, wide: bool) -> np.ndarray:
    out = np.zeros((len(planes) // (4 if wide else 3), 4), dtype=np.uint8)
    out[:, : 4 if wide else 3] = np.frombuffer(planes, dtype=np.uint8).reshape(4 if wide else 3, -1).T
    return out.view("<u4").ravel()


def _packed(x: np.ndarray) -> bytes:
    """Numbers in the fewest of one, two or four bytes each, which the first byte tells."""
    kind = next((k for k in (1, 2) if not len(x) or x.max() < 1 << 8 * k), 4)
    return bytes([kind]) + x.astype(f"<u{kind}").tobytes()


def _unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(b, dtype=f"<u{b[0]}", offset=1).astype(np.int64)


def _blocks(docs: DataFrame, p: Params) -> DataFrame:
    """Rows (block, id, codes) of documents and rows (block, bucket, codes, chunks) of blocks' distinct chunks, from (id, text).

    ``codes`` are the numbers of a document's chunks, or, as differences, of a bucket's; chunks are joined by
    blanks, as they hold none.
    """
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, n, size = TaskContext.get().partitionId(), 0, 0
        known, ids, codes = _Numbers(), [], []

        def flush() -> Iterator[pd.DataFrame]:
            block = (task << 32) + n
            for i in range(0, len(ids), 256):
                yield pd.DataFrame({"block": block, "bucket": None, "id": ids[i : i + 256], "codes": [_planes(c, len(known) > _NARROW) for c in codes[i : i + 256]], "chunks": None})
            held = list(known)
            bucket = np.fromiter((zlib.crc32(c.encode()) % p.buckets for c in held), np.int64, len(held))
            order = np.argsort(bucket, kind="stable")
            found, at = np.unique(bucket[order], return_index=True)
            lists = np.split(order, at[1:]) if len(held) else []
            for i in range(0, len(lists), 64):
                part = lists[i : i + 64]
                steps = [_packed(np.diff(x, prepend=0)) for x in part]
                yield pd.DataFrame({"block": block, "bucket": found[i : i + 64], "id": None, "codes": steps, "chunks": [" ".join([held[j] for j in x]) for x in part]})

        for b in batches:
            for i, t in zip(b["id"].astype(object).where(b["id"].notna(), None), b["text"], strict=True):
                ids.append(i)
                codes.append(np.array([known[c] for c in chunks(t)] if t else [], dtype="<u4"))
                size += len(t or "") + 16
                if len(known) >= p.block_chunks or size >= p.block_chars:
                    yield from flush()
                    n, size = n + 1, 0
                    known, ids, codes = _Numbers(), [], []
        if ids:
            yield from flush()

    return docs.mapInPandas(run, f"block bigint, bucket int, id {kind}, codes binary, chunks string")


def _segmented(rows: DataFrame, model_file: str) -> DataFrame:
    """(block, bucket, sizes, ids, odd) of rows (block, bucket, chunks): each chunk's number of ids, and all ids in turn.

    ``odd`` holds the decoded texts where one is not the chunk itself. A distinct chunk is segmented once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec, table_, last = Codec(model_file), {}, None
        for b in batches:
            out = []
            for bucket, joined in zip(b["bucket"], b["chunks"], strict=True):
                if bucket != last:
                    table_, last = {}, bucket
                held = joined.split(" ")
                new = [c for c in held if c not in table_]
                if new:
                    table_.update(zip(new, zip(*codec.segment(new), strict=True), strict=True))
                got = [table_[c] for c in held]
                same = all(g[1] == c.replace(MARK, " ") for c, g in zip(held, got, strict=True))
                sizes = np.array([len(g[0]) for g in got])
                ids = np.fromiter(itertools.chain.from_iterable(g[0] for g in got), np.int64, int(sizes.sum()))
                out.append((_packed(sizes), _packed(ids), None if same else [g[1] for g in got]))
            yield pd.DataFrame({"block": b["block"], "bucket": b["bucket"], "sizes": [o[0] for o in out], "ids": [o[1] for o in out], "odd": [o[2] for o in out]})

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(run, "block bigint, bucket int, sizes binary, ids binary, odd array<string>")


def _joined(docs: DataFrame, model_file: str, p: Params, digest: bool) -> DataFrame:
    """(id, n, ids, decoded) of docs (id, text); ids joined by commas; if ``digest``, the sha256 of both."""
    kind = docs.schema["id"].dataType.simpleString()
    shape = f"id {kind}, n bigint, ids string, decoded string"
    sha = (lambda s: hashlib.sha256(s.encode()).hexdigest()) if digest else (lambda s: s)

    if not Codec(model_file).separable:

        def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            codec = Codec(model_file)
            for b in batches:
                for i in range(0, len(b), 256):
                    part = b.iloc[i : i + 256]
                    ids = [codec.sp.encode(t) if t else [] for t in part["text"]]
                    yield pd.DataFrame({"id": part["id"], "n": [len(x) for x in ids], "ids": [sha(",".join(map(str, x))) for x in ids], "decoded": [sha(codec.decode(x)) for x in ids]})

        return docs.mapInPandas(whole, shape)

    held = Bucketed(_blocks(docs, p), ["block"], "chunks", dealt=False).df
    table_ = _segmented(held.where("bucket is not null").select("block", "bucket", "chunks"), model_file)

    def join(held: pd.DataFrame, table_: pd.DataFrame) -> pd.DataFrame:
        docs = held[held["bucket"].isna()]
        lists = held[held["bucket"].notna()]
        found = {int(b): r for b, *r in zip(table_["bucket"], table_["sizes"], table_["ids"], table_["odd"], strict=True)}
        codes = [np.cumsum(_unpacked(c)) for c in lists["codes"]]
        size = sum(map(len, codes))
        said, text, count = np.empty(size, dtype=object), np.empty(size, dtype=object), np.zeros(size, dtype=np.int64)
        for at, bucket, joined in zip(codes, lists["bucket"], lists["chunks"], strict=True):
            sizes, ids, odd = found[int(bucket)]
            count[at] = sizes = _unpacked(sizes)
            ends, ids = np.cumsum(sizes).tolist(), _unpacked(ids).tolist()
            said[at] = [",".join(map(str, ids[i:j])) for i, j in zip([0, *ends], ends)]
            text[at] = [c.replace(MARK, " ") for c in joined.split(" ")] if odd is None else list(odd)
        out = []
        for c in docs["codes"]:
            c = _numbers(c, size > _NARROW)
            out.append((int(count[c].sum()), sha(",".join(said[c].tolist())), sha("".join(text[c].tolist())[1:])))
        return pd.DataFrame({"id": docs["id"].to_numpy(object), "n": [o[0] for o in out], "ids": [o[1] for o in out], "decoded": [o[2] for o in out]})

    return held.select("block", "bucket", "id", "codes", "chunks").groupBy("block").cogroup(table_.groupBy("block")).applyInPandas(join, shape)


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", params: Params | None = None) -> DataFrame:
    """id_col, ids array<int>, decoded string: each whole text's ids and what they decode to."""
    out = _joined(_named(docs, id_col, text_col), model_file, params or Params(), digest=False)
    ids = F.when(F.col("ids") == "", F.array().cast("array<int>")).otherwise(F.split("ids", ",").cast("array<int>"))
    return out.select(F.col("id").alias(id_col), ids.alias("ids"), "decoded")


def encode_digest(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", params: Params | None = None) -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256 for each row: digests instead of the ids and texts themselves."""
    out = _joined(_named(docs, id_col, text_col), model_file, params or Params(), digest=True)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"), F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))


def decode(df: DataFrame, model_file: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds out_col: the text that each row's ids decode to (null and empty: the empty text)."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Codec(model_file)
        for s in batches:
            yield s.map(lambda i: "" if i is None else codec.decode([int(x) for x in i]))

    return df.withColumn(out_col, run(F.col(ids_col)))


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digest(table(spark, sf_dir, "documents"), model_path())
