"""Language labels from a bidirectional gated recurrent network over bytes.

Two gated recurrent layers read a word's bytes forwards and backwards; every byte
gets a distribution over the learned languages, and a document's probabilities are
the mean over all its bytes.  The network is trained in numpy by backpropagation
through time.  Its state starts anew at ASCII white space (and after ``MAX_BYTES``
bytes without any), so equal words have equal outputs: a worker runs each distinct
word once and remembers what its bytes add up to.

The fit takes a bounded, hashed sample: about ``docs_per_lang`` distinct texts of each
language and ``words_per_lang`` of their words, and never more than twice as many.

Defined results: null texts, texts without a letter and an untrained model (no
labelled rows) give ``und`` with score 0; a null id counts as the empty text for
the split; rows that repeat are labelled as they stand; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from contactweave.llm.base import WORD_RE, bounded_batches, words_col, written

UNKNOWN = "und"
MAX_BYTES = 32
LETTER = re.compile(r"[^\W\d_]")
#: Most distinct words whose outputs a worker remembers.
CACHED_WORDS = 500_000


@dataclass(frozen=True)
class Fit:
    docs_per_lang: int = 400
    words_per_lang: int = 15_000
    hidden: int = 12
    steps: int = 350
    batch: int = 512
    rate: float = 0.02
    seed: int = 7


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, mask) of words of at most ``MAX_BYTES`` bytes."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    mask = np.arange(lengths.max(initial=1)) < lengths[:, None]
    out = np.zeros(mask.shape, np.int64)
    out[mask] = np.frombuffer(b"".join(words), np.uint8)
    return out, mask.astype(np.float32)


class Direction:
    """One gated recurrent layer; ``wx`` holds a row of input weights per byte."""

    def __init__(self, hidden: int, rng: np.random.Generator):
        self.h = hidden
        self.p = {"wx": rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32), "u": rng.normal(0, 0.3, (hidden, 3 * hidden)).astype(np.float32), "b": np.zeros(3 * hidden, np.float32)}

    def forward(self, x: np.ndarray, mask: np.ndarray, steps: range, keep: list | None = None) -> np.ndarray:
        H, p = self.h, self.p
        h, out = np.zeros((len(x), H), np.float32), np.zeros((*x.shape, H), np.float32)
        inputs = p["wx"] + p["b"]
        for t in steps:
            a, u, m = inputs[x[:, t]], h @ p["u"], mask[:, t : t + 1]
            zr = sigmoid(a[:, : 2 * H] + u[:, : 2 * H])
            z, r = zr[:, :H], zr[:, H:]
            n = np.tanh(a[:, 2 * H :] + r * u[:, 2 * H :])
            new = h + m * (1 - z) * (n - h)
            if keep is not None:
                keep.append((t, h, z, r, n, u[:, 2 * H :], m))
            h = out[:, t] = new
        return out

    def backward(self, x: np.ndarray, keep: list, d_out: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients from those of the outputs, back through time."""
        H, p = self.h, self.p
        g = {k: np.zeros_like(v) for k, v in p.items()}
        d_h = np.zeros((len(x), H), np.float32)
        for t, h, z, r, n, un, m in reversed(keep):
            d_h = d_h + d_out[:, t]
            step = d_h * m
            d_n = step * (1 - z) * (1 - n * n)
            d_z = -step * (n - h) * z * (1 - z)
            d_r = d_n * un * r * (1 - r)
            d_a = np.concatenate([d_z, d_r, d_n], 1)
            d_u = np.concatenate([d_z, d_r, d_n * r], 1)
            np.add.at(g["wx"], x[:, t], d_a)
            g["b"] += d_a.sum(0)
            g["u"] += h.T @ d_u
            d_h = d_h - step * (1 - z) + d_u @ p["u"].T
        return g


class Network:
    """Per-byte language probabilities."""

    def __init__(self, langs: list[str], fit: Fit = Fit()):
        rng = np.random.default_rng(fit.seed)
        self.langs = langs
        self.ahead, self.back = Direction(fit.hidden, rng), Direction(fit.hidden, rng)
        self.p = {"v": rng.normal(0, 0.3, (2 * fit.hidden, len(langs))).astype(np.float32), "c": np.zeros(len(langs), np.float32)}

    def states(self, x, mask, keep_ahead=None, keep_back=None):
        T = x.shape[1]
        return np.concatenate([self.ahead.forward(x, mask, range(T), keep_ahead), self.back.forward(x, mask, range(T - 1, -1, -1), keep_back)], 2)

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        e = states @ self.p["v"] + self.p["c"]
        e = np.exp(e - e.max(2, keepdims=True))
        return e / e.sum(2, keepdims=True)

    def label(self, words: list[bytes]) -> np.ndarray:
        """Every byte's probabilities: (word, position, language)."""
        x, mask = padded(words)
        return self.probabilities(self.states(x, mask)) * mask[:, :, None]

    def gradients(self, x, mask, y) -> list[tuple[dict, dict]]:
        """[(parameters, gradients)] of the mean cross-entropy over all bytes."""
        ahead, back, H = [], [], self.ahead.h
        s = self.states(x, mask, ahead, back)
        d = self.probabilities(s)
        d[np.arange(len(y)), :, y] -= 1
        d *= mask[:, :, None] / max(1.0, mask.sum())
        own = {"v": s.reshape(-1, 2 * H).T @ d.reshape(-1, len(self.langs)), "c": d.sum((0, 1))}
        d_s = d @ self.p["v"].T
        return [(self.p, own), (self.ahead.p, self.ahead.backward(x, ahead, d_s[:, :, :H])), (self.back.p, self.back.backward(x, back, d_s[:, :, H:]))]

    def train(self, words: list[bytes], labels: np.ndarray, fit: Fit) -> None:
        """Adam on shuffled batches."""
        rng, moments = np.random.default_rng(fit.seed), {}
        for step in range(1, fit.steps + 1):
            pick = rng.integers(0, len(words), fit.batch)
            x, mask = padded([words[i] for i in pick])
            rate = fit.rate * (1 - step / (fit.steps + 1))
            for params, grads in self.gradients(x, mask, labels[pick]):
                for k, g in grads.items():
                    m, v = moments.setdefault((id(params), k), (np.zeros_like(g), np.zeros_like(g)))
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    params[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)


def pieces(word: str) -> list[bytes]:
    raw = word.encode("utf-8", "replace")
    return [raw[i : i + MAX_BYTES] for i in range(0, len(raw), MAX_BYTES)]


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text is a multiple of 5."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learn(docs: DataFrame, fit: Fit, id_col: str, text_col: str, lang_col: str) -> Network | None:
    """A network fitted to the sample of the labelled rows outside the held-out
    fifth; the driver gets about ``words_per_lang`` words of each language."""
    rows = docs.where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    texts = F.approx_count_distinct(F.xxhash64(text_col)).alias("n")
    counts = {r["lang"]: r["n"] for r in rows.groupBy(F.col(lang_col).alias("lang")).agg(texts).collect()}
    if not counts:
        return None

    def share(limit: int, of: dict[str, int]) -> Column:
        """Per-million share of a language's rows that makes ``limit`` of them."""
        out = F.lit(0)
        for k, n in sorted(of.items()):
            out = F.when(F.col("lang") == k, F.lit(-(-1_000_000 * limit // max(1, n)))).otherwise(out)
        return out

    million = lambda *c: F.pmod(F.xxhash64(F.lit(fit.seed), *c), F.lit(1_000_000))
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    # Copies of a text share its hash, so they are reduced to one.
    sample = written(rows.where(million("text") < share(fit.docs_per_lang, counts)).dropDuplicates(["lang", "text"]), "sample")
    tokens = sample.select("lang", F.posexplode(words_col(F.col("text"))).alias("at", "word"), F.xxhash64("text").alias("print"))
    sizes = {r["lang"]: r["n"] for r in tokens.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn = tokens.where(million("print", "at") < share(fit.words_per_lang, sizes))
    first = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("print", "at"), "print", "at"))
    got = drawn.withColumn("n", first).where(F.col("n") <= 2 * fit.words_per_lang).select("lang", "word").collect()
    langs = sorted(counts)
    pairs = sorted((p, langs.index(r["lang"])) for r in got for p in pieces(r["word"]))
    net = Network(langs, fit)
    if pairs:
        net.train([p for p, _ in pairs], np.array([y for _, y in pairs]), fit)
    return net


class Labeller:
    """Document probabilities, with remembered words."""

    def __init__(self, net: Network):
        self.net, self.at = net, {}
        self.sums = np.zeros((1024, len(net.langs) + 1))

    def learn(self, words: list[str]) -> None:
        """Remember what new words' bytes add up to, and how many they are."""
        if len(self.at) + len(words) > CACHED_WORDS:
            self.at.clear()
        base, n = len(self.at), len(self.net.langs)
        while base + len(words) > len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
        cut = [(base + i, p) for i, w in enumerate(words) for p in pieces(w)]
        self.sums[base : base + len(words)] = 0
        cut.sort(key=lambda c: len(c[1]))
        for k in range(0, len(cut), 4096):
            part = cut[k : k + 4096]
            rows = np.array([r for r, _ in part])
            np.add.at(self.sums, (rows[:, None], np.arange(n)), self.net.label([p for _, p in part]).sum(1))
            np.add.at(self.sums, (rows, n), [len(p) for _, p in part])
        self.at.update(zip(words, range(base, base + len(words))))

    def document(self, text: str | None) -> tuple[str, float]:
        if not text or not LETTER.search(text):
            return UNKNOWN, 0.0
        words = WORD_RE.findall(text)
        rows = self.rows(words)
        total = self.sums[rows].sum(0)
        p = total[:-1] / total[-1]
        best = int(p.argmax())
        return self.net.langs[best], float(min(1.0, max(0.0, p[best])))

    def rows(self, words: list[str]) -> np.ndarray:
        try:
            return np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        except KeyError:
            self.learn(list({w for w in words if w not in self.at}))
            if any(w not in self.at for w in words):  # the table was emptied for them
                self.learn(list({w for w in words if w not in self.at}))
            return np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))


def label(docs: DataFrame, fit: Fit = Fit(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, lang_pred, score."""
    bounded_batches(docs.sparkSession)
    net = learn(docs, fit, id_col, text_col, lang_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(net) if net else None
        for b in batches:
            texts = b.column("text").to_pylist()
            if labeller:
                new = {w for t in texts if t for w in WORD_RE.findall(t) if w not in labeller.at}
                if 0 < len(new) < CACHED_WORDS:
                    labeller.learn(list(new))
            said = [labeller.document(t) if labeller else (UNKNOWN, 0.0) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array([x for x, _ in said], pa.string()), pa.array([x for _, x in said], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
