"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text's words are read in overlapping windows (``length`` words, a new one every ``stride``); all windows of the whole
text are scored and the highest counts. A word's input joins a vector for the word (one shared vector for words that
training did not see often) and the mean of vectors for its character trigrams. Two gated recurrent networks read a window
forwards and backwards, attention weighs their states, and a logistic output judges the weighted mean.

Training uses a bounded sample of labelled rows: of each class at most ``sample`` documents (those with the smallest hashes)
of at most ``sample_chars`` characters together, each read whole: all its windows are scored ``readings`` times or more in the
course of training, its loss is the smooth maximum of the ``bag`` that were highest, and these are learned from. A part of the sample that neither counts of
words nor steps see sets the decision point on scores of whole texts, at the classes' shares among all labels. Only the
text enters a score.

Scoring is one pass without a shuffle; parameters (a few MB, bounded by ``vocabulary`` and ``buckets``) are broadcast, and
a task's table of word inputs is bounded.
Defined results: null and empty texts and texts without a word get the score of an empty window; repeated rows repeat
(a labelled id that several texts share trains with one of them); null ids stay null and are not held out; an empty table gives an empty result; labels that are null, or whose document is
missing, are not used; with labels of one class or none, every score is that class's (or 0). Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import table

WORDS = re.compile(r"[^\W_]+").findall
HAS_WORD = re.compile(r"[^\W_]").search
#: Rows of a task's table of word inputs, and windows scored together.
KNOWN, TOGETHER = 150_000, 1024
#: Texts, and characters of them, that a task tokenises together.
TEXTS, CHARS = 200, 2_000_000


@dataclass(frozen=True)
class Params:
    sample: int = 3000
    sample_chars: int = 40_000_000
    bag: int = 10
    length: int = 32
    stride: int = 16
    vocabulary: int = 20_000
    buckets: int = 2039
    word_dim: int = 12
    char_dim: int = 6
    hidden: int = 8
    attention: int = 8
    epochs: int = 6
    readings: int = 3  #: at least, of all windows in training
    steps: int = 400  #: at least; a small sample is read more often
    documents: int = 64  #: in a training step
    rate: float = 0.01


def starts(n: int, p: Params) -> range:
    """Where windows begin in a text of n words: every word is in one at least."""
    return range(0, max(1, n - p.length + p.stride), p.stride)


def trigram_means(words: list[str], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean vector of each word's trigrams, trigram buckets, their words): a word is read with a blank on both sides."""
    code = np.frombuffer((" " + "  ".join(words) + " ").encode("utf-32-le"), dtype="<u4").astype(np.int64)
    gram = (code[:-2] * 7919 + code[1:-1] * 104729 + code[2:]) % len(vectors)
    word = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])[:-2]
    inside = np.ones(len(gram), dtype=bool)
    edge = np.cumsum([len(w) + 2 for w in words])[:-1]
    inside[edge - 1], inside[edge - 2] = False, False  # grams over the border of two words
    gram, word = gram[inside], word[inside]
    count = np.bincount(word, minlength=len(words)).astype(np.float32)
    begin = np.concatenate([[0], np.cumsum(count[:-1])]).astype(np.int64)
    return np.add.reduceat(vectors[gram], begin, axis=0) / count[:, None], gram, word


def summed(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """(n, columns): the sums of the rows of values by place."""
    d = values.shape[1]
    return np.bincount((at[:, None] * d + np.arange(d)).ravel(), values.ravel(), n * d).reshape(n, d).astype(np.float32)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b by blocks of rows that one thread multiplies: more threads would only spin on matrices as narrow as these."""
    n = max(1, 200_000 // b.size)
    return a @ b if len(a) <= n else np.concatenate([a[i : i + n] @ b for i in range(0, len(a), n)])


class Network:
    """Parameters, forward and backward passes. Windows are (length, n) arrays of rows of a word table; 0 is padding."""

    def __init__(self, p: Params, vocabulary: dict[str, int], weights: dict[str, np.ndarray]):
        self.p, self.vocabulary, self.w = p, vocabulary, weights

    @staticmethod
    def fresh(p: Params, vocabulary: dict[str, int], lean: np.ndarray) -> Network:
        """Random parameters; a known word's vector starts with how much the word leans to toxic documents."""
        rng = np.random.default_rng(5)
        h, d = p.hidden, p.word_dim + p.char_dim
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        w = {"word": 0.1 * rng.standard_normal((len(vocabulary) + 1, p.word_dim)).astype(np.float32), "char": 0.1 * rng.standard_normal((p.buckets, p.char_dim)).astype(np.float32)}
        w["word"][1:, 0] = lean
        w["word"][0] = 0
        for s in "fb":
            w |= {f"W{s}": draw(d, 3 * h), f"U{s}": draw(h, 3 * h), f"b{s}": np.zeros(3 * h, np.float32)}
        w |= {"A": draw(2 * h, p.attention), "a": draw(p.attention), "o": draw(2 * h), "c": np.zeros(1, np.float32)}
        return Network(p, vocabulary, w)

    def inputs(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        rows = np.array([self.vocabulary.get(x, 0) for x in words])
        means, gram, word = trigram_means(words, self.w["char"])
        return np.concatenate([self.w["word"][rows], means], axis=1).astype(np.float32), (rows, gram, word)

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return product(x, self.w["Wf"]) + self.w["bf"], product(x, self.w["Wb"]) + self.w["bb"]

    def _run(self, side: str, table_: np.ndarray, ids: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """States (length, n, hidden); ids of the other side come reversed."""
        h, u = self.p.hidden, self.w[f"U{side}"]
        steps, n = ids.shape
        out = np.zeros((steps, n, h), np.float32)
        state, kept = np.zeros((n, h), np.float32), []
        mask = (ids > 0).astype(np.float32)[:, :, None]
        for t in range(steps):
            x, g = table_[ids[t]], state @ u
            zr = 0.5 + 0.5 * np.tanh(0.5 * (x[:, : 2 * h] + g[:, : 2 * h]))
            z, r, gn = zr[:, :h], zr[:, h:], g[:, 2 * h :]
            new = np.tanh(x[:, 2 * h :] + r * gn)
            m = mask[t] * (1 - z)
            if keep:
                kept.append((state, z, r, gn, new))
            state = state + m * (new - state)
            out[t] = state
        return out, kept

    def forward(self, tables: tuple[np.ndarray, np.ndarray], ids: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple | None]:
        """Logits of n windows."""
        f, kf = self._run("f", tables[0], ids, keep)
        b, kb = self._run("b", tables[1], ids[::-1], keep)
        s = np.concatenate([f, b[::-1]], axis=2)
        e = np.tanh(s @ self.w["A"])
        score = e @ self.w["a"] - 1e9 * (ids == 0)
        score -= score.max(axis=0)
        alpha = np.exp(score)
        alpha /= alpha.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", alpha, s)
        logit = np.einsum("nh,h->n", pooled, self.w["o"]) + self.w["c"]
        return logit, (ids, kf, kb, s, e, alpha, pooled) if keep else None

    def backward(self, kept: tuple, d: np.ndarray) -> tuple[dict[str, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """(gradients of everything but inputs, gradients of each window word's two projections) of sum(d * logits)."""
        ids, kf, kb, s, e, alpha, pooled = kept
        w, h = self.w, self.p.hidden
        g = {"o": np.einsum("nh,n->h", pooled, d), "c": np.array([d.sum()], np.float32)}
        dp = d[:, None] * w["o"]
        da = np.einsum("nh,tnh->tn", dp, s)
        ds = alpha[:, :, None] * dp
        dscore = alpha * (da - (alpha * da).sum(axis=0))
        g["a"] = np.einsum("tn,tnk->k", dscore, e)
        de = dscore[:, :, None] * w["a"] * (1 - e * e)
        g["A"] = np.einsum("tnh,tnk->hk", s, de)
        ds = ds + de @ w["A"].T
        g["Uf"], xf = self._back("f", kf, ids, ds[:, :, :h])
        g["Ub"], xb = self._back("b", kb, ids[::-1], ds[::-1, :, h:])
        return g, (xf, xb[::-1])

    def _back(self, side: str, kept: list, ids: np.ndarray, ds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h, u = self.p.hidden, self.w[f"U{side}"]
        du, carry = np.zeros_like(u), np.zeros_like(ds[0])
        dx = np.zeros((*ids.shape, 3 * h), np.float32)
        mask = (ids > 0).astype(np.float32)[:, :, None]
        for t in range(len(ids) - 1, -1, -1):
            state, z, r, gn, new = kept[t]
            dh = (ds[t] + carry) * mask[t]
            rest = (ds[t] + carry) * (1 - mask[t])
            dn = dh * (1 - z) * (1 - new * new)
            dz = dh * (state - new) * z * (1 - z)
            dr = dn * gn * r * (1 - r)
            dg = np.concatenate([dz, dr, dn * r], axis=1)
            dx[t] = np.concatenate([dz, dr, dn], axis=1)
            du += state.T @ dg
            carry = rest + dh * z + dg @ u.T
        return du, dx


def windows_of(row: np.ndarray, p: Params) -> np.ndarray:
    """(length, n): all windows of a text's words (numbers from 1; 0 is padding)."""
    n = len(starts(len(row), p))
    full = np.zeros((n - 1) * p.stride + p.length, row.dtype)
    full[: len(row)] = row
    return np.lib.stride_tricks.sliding_window_view(full, p.length)[:: p.stride].T


def train(texts: Iterable[list[str]], labels: list[int], share: float, p: Params) -> tuple[Network, float, float]:
    """(network, decision point, slope) from documents' words; share: of toxic documents among all labelled."""
    y = np.array(labels, np.float32)
    number: dict[str, int] = {}
    rows = [np.array([number.setdefault(w, len(number) + 1) for w in t], np.int32) for t in texts]
    names = ["", *number]
    rng = np.random.default_rng(9)
    order = rng.permutation(len(rows))
    check, learn = order[: max(2, len(order) // 6)], order[max(2, len(order) // 6) :]
    seen = np.zeros((2, len(names)))
    for i in learn:
        seen[int(y[i]), np.unique(rows[i])] += 1
    total = [max(1, (y[learn] == c).sum()) for c in (0, 1)]
    often = seen.sum(axis=0)
    lean = np.log((seen[1] + 1) / (total[1] + 2)) - np.log((seen[0] + 1) / (total[0] + 2))
    lean = np.clip(lean * (often / (often + 3)), -3, 3)
    top = sorted(np.flatnonzero(often[1:] >= 3) + 1, key=lambda w: (-abs(lean[w]) * np.sqrt(often[w]), names[w]))[: p.vocabulary]
    net = Network.fresh(p, {names[w]: i + 1 for i, w in enumerate(top)}, lean[top].astype(np.float32))
    first, second = ({k: np.zeros_like(v) for k, v in net.w.items()} for _ in range(2))
    step = 0

    def windows(docs: np.ndarray, only: dict[int, np.ndarray] | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
        wins = [windows_of(rows[i], p) if only is None else windows_of(rows[i], p)[:, only[i]] for i in docs]
        used, ids = np.unique(np.concatenate([np.zeros((p.length, 1), np.int32), *wins], axis=1), return_inverse=True)
        return [names[w] for w in used[1:]], ids.reshape(p.length, -1)[:, 1:], np.repeat(np.arange(len(docs)), [w.shape[1] for w in wins])

    def pad(t: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros((1, t.shape[1]), np.float32), t])

    def judged(tables: tuple, ids: np.ndarray) -> np.ndarray:
        return np.concatenate([net.forward(tables, ids[:, i : i + TOGETHER])[0] for i in range(0, ids.shape[1], TOGETHER)])

    def highest(logit: np.ndarray, of: np.ndarray) -> np.ndarray:
        """The ``bag`` highest windows of each document."""
        by = np.lexsort((-logit, of))
        return np.sort(by[np.arange(len(by)) - np.searchsorted(of[by], of[by]) < p.bag])

    epochs = max(p.epochs, -(-p.steps * p.documents // len(learn)))
    again, chosen = max(1, epochs // p.readings), {}
    for epoch in range(epochs):
        rate = p.rate * (1.0 if epoch < 0.7 * epochs else 0.3)
        rng.shuffle(learn)
        for i in range(0, len(learn), p.documents):
            docs = learn[i : i + p.documents]
            if epoch % again == 0:  # every window is scored
                words, ids, of = windows(docs)
                few = highest(judged(tuple(map(pad, net.project(net.inputs(words)[0]))), ids), of)
                place = few - np.searchsorted(of, of[few])
                chosen |= {d: place[of[few] == j] for j, d in enumerate(docs)}
            words, ids, of = windows(docs, chosen)
            x, (at, gram, word) = net.inputs(words)
            tables = tuple(map(pad, net.project(x)))
            logit, kept = net.forward(tables, ids, keep=True)
            top = np.full(len(docs), -1e9, np.float32)
            np.maximum.at(top, of, logit)
            part = np.exp(2 * (logit - top[of]))
            part /= np.bincount(of, part)[of]
            bag = np.bincount(of, part * logit)
            d = (1 / (1 + np.exp(-bag)) - y[docs])[of] * part / len(docs)
            g, (xf, xb) = net.backward(kept, d.astype(np.float32))
            dx = np.zeros_like(x)
            for s, dw in (("f", xf), ("b", xb)):
                each = summed(dw.reshape(-1, 3 * p.hidden), ids.ravel(), len(words) + 1)[1:]
                g[f"W{s}"], g[f"b{s}"] = np.einsum("ni,nj->ij", x, each), each.sum(axis=0)
                dx += product(each, net.w[f"W{s}"].T)
            g["word"] = summed(dx[:, : p.word_dim], at, len(net.w["word"]))
            g["word"][0] = 0
            count = np.bincount(word, minlength=len(words))
            g["char"] = summed((dx[:, p.word_dim :] / count[:, None])[word], gram, p.buckets)
            step += 1
            for k, v in net.w.items():
                first[k] += 0.1 * (g[k] - first[k])
                second[k] += 0.001 * (g[k] * g[k] - second[k])
                v -= (rate / (1 - 0.9**step)) * first[k] / (np.sqrt(second[k]) * (1 - 0.999**step) ** -0.5 + 1e-8)

    got = []
    for i in range(0, len(check), p.documents):
        words, ids, of = windows(check[i : i + p.documents])
        x, _ = net.inputs(words)
        logit = judged(tuple(map(pad, net.project(x))), ids)
        top = np.full(of.max() + 1, -1e9, np.float32)
        np.maximum.at(top, of, logit)
        got.append(top)
    return net, *decide(np.concatenate(got), y[check], share)


def decide(logit: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """(decision point, slope): the fewest wrong at the share of toxic documents; the middle of a gap."""
    if not (0 < y.sum() < len(y)):
        return 0.0, 1.0
    at = np.unique(logit)
    points = np.concatenate([[at[0] - 1], (at[1:] + at[:-1]) / 2, [at[-1] + 1]])
    wrong = np.array([share * (logit[y == 1] < c).mean() + (1 - share) * (logit[y == 0] >= c).mean() for c in points])
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    return float(points[best[len(best) // 2]]), 1.0


class Scorer:
    """Scores texts with a trained network, keeping the inputs of words it has met."""

    def __init__(self, net: Network, point: float, slope: float):
        self.net, self.p, self.point, self.slope = net, net.p, point, slope
        self.reset()

    def reset(self) -> None:
        self.place: dict[str, int] = {}
        self.tables = [np.zeros((1, 3 * self.p.hidden), np.float32)] * 2

    def rows(self, words: list[list[str]]) -> list[np.ndarray]:
        new = list(dict.fromkeys(w for ws in words for w in ws if w not in self.place))
        if new and len(self.place) + len(new) > KNOWN and self.place:
            self.reset()
            new = list(dict.fromkeys(w for ws in words for w in ws))
        if new:
            f, b = self.net.project(self.net.inputs(new)[0])
            for w in new:
                self.place[w] = len(self.place) + 1
            self.tables = [np.concatenate([self.tables[0], f]), np.concatenate([self.tables[1], b])]
        place = self.place
        return [np.array([place[w] for w in ws], np.int64) for ws in words]

    def __call__(self, texts: list[str | None]) -> list[float]:
        p, best = self.p, np.full(len(texts), -1e9, np.float32)
        if not texts:
            return []
        rows = self.rows([WORDS(t.lower()) if t else [] for t in texts])
        doc, wins, held = [], [], 0

        def flush() -> None:
            nonlocal doc, wins, held
            if wins:
                logit, _ = self.net.forward(tuple(self.tables), np.concatenate(wins, axis=1))
                np.maximum.at(best, np.concatenate(doc), logit)
            doc, wins, held = [], [], 0

        for i, r in enumerate(rows):
            view = windows_of(r, p)
            for j in range(0, view.shape[1], TOGETHER):
                part = view[:, j : j + TOGETHER]
                wins.append(part)
                doc.append(np.full(part.shape[1], i))
                held += part.shape[1]
                if held >= TOGETHER:
                    flush()
        flush()
        return (1 / (1 + np.exp(-np.clip(self.slope * (best - self.point), -30, 30)))).tolist()


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, params: Params | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[Network, float, float] | float:
    """(network, decision point, slope), or a constant score where the labels used are of one class or none."""
    p = params or Params()
    used = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    used = used.groupBy(id_col).agg(F.max(label_col).alias("y"))
    share = used.agg(F.avg((F.col("y") > 0).cast("double"))).first()[0]
    if share is None:
        return 0.0
    picked = None
    for c in (0, 1):  # at most 2 * sample ids
        rows = used.where((F.col("y") > 0) == F.lit(bool(c))).select(F.col(id_col).alias("lid"), F.lit(c).alias("y")).orderBy(F.xxhash64("lid"), "lid").limit(p.sample)
        picked = rows if picked is None else picked.unionByName(rows)

    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("t")).where("t <> ''").withColumn("h", F.xxhash64("t"))
    # one text an id (the one of the least hash), and of each class as many as sample_chars allows; copies train once
    sizes = texts.join(F.broadcast(picked), F.col("id") == F.col("lid")).groupBy("id").agg(F.min(F.struct("h", F.length("t").alias("n"))).alias("m"), F.max("y").alias("y"))
    wanted, chars = {}, [0, 0]
    for r in sorted(sizes.select("id", "y", "m.h", "m.n").collect(), key=lambda r: (r["h"], r["y"])):
        if (r["h"], r["y"]) not in wanted and chars[r["y"]] + r["n"] <= p.sample_chars:
            wanted[r["h"], r["y"]] = r["id"]
            chars[r["y"]] += r["n"]
    if not wanted:
        return 0.0
    chosen = docs.sparkSession.createDataFrame([(i, h, y) for (h, y), i in wanted.items()], docs.select(F.col(f"`{id_col}`").alias("lid"), F.lit(0).cast("bigint").alias("k"), F.lit(0).alias("y")).schema)
    got = texts.join(F.broadcast(chosen), (F.col("id") == F.col("lid")) & (F.col("h") == F.col("k"))).groupBy("h", "y").agg(F.min("t").alias("t")).collect()
    got = [(r["y"], r["t"]) for r in sorted(got, key=lambda r: (r["h"], r["y"])) if HAS_WORD(r["t"].lower())]
    y = [label for label, _ in got]
    if not 0 < sum(y) < len(y):
        return float(y[0]) if y else 0.0
    return train((WORDS(t.lower()) for _, t in got), y, share, p)


def score(docs: DataFrame, fitted: tuple[Network, float, float] | float, keep: list[str], text_col: str = "text", out_col: str = "score") -> DataFrame:
    """The columns ``keep`` and out_col: each whole text's score from 0 to 1."""
    if isinstance(fitted, float):
        return docs.select(*keep, F.lit(fitted).alias(out_col))
    sent = docs.sparkSession.sparkContext.broadcast(fitted)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(*sent.value)
        for s in batches:
            out: list[float] = []
            held, size = [], 0
            for t in s:
                held.append(t)
                size += len(t or "")
                if len(held) >= TEXTS or size >= CHARS:
                    out += scorer(held)
                    held, size = [], 0
            yield pd.Series(out + scorer(held), dtype="float64")

    return docs.select(*keep, run(F.col(text_col)).alias(out_col))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
