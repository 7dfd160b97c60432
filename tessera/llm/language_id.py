"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads windows of `WINDOW` bytes in both directions; each position's two states give probabilities of the
languages (every position is labelled), and a document's probabilities are the mean over all its positions. It is
trained in numpy by back-propagation through time with Adam. Texts are cut into windows that follow each other without
gaps, all of them are read, and the state is zero where a window begins; the windows of many documents run side by
side, so a very long text costs no more steps than short ones.

Training sees a sample: of each label at most SAMPLE_DOCS documents, chosen by a hash of their id, and of each document
one crop of CROP_CHARS characters at a hashed place.
Everything else covers whole texts of all documents. Label, source and id are never inputs of a prediction.

Defined results: `und` with score 0 if the text is null or has no letter (of any script), and everywhere if nothing
could be learned. A null id is neither learned from nor held out. Repeated rows get equal results, and of a repeated id
one row is learned from. No rows give no rows. For training ids must be integers, else TypeError; columns may have any
name and type, and those named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import chunked, extended, keyed, map_arrow, named, others

HIDDEN, WINDOW = 8, 64
SAMPLE_DOCS, CROP_CHARS = 384, 400
STEPS, BATCH, RATE, SEED = 260, 256, 0.02, 11
#: Windows that run side by side, fewer beyond so many languages.
LANES, LANES_LANGUAGES = 1024, 32


class Gru:
    """One direction. x: (time, lanes) bytes; states: (time, hidden, lanes). Rows of the tables: update, reset, new."""

    def __init__(self, rng: np.random.Generator, hidden: int) -> None:
        self.table = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
        self.u = rng.normal(0, 1 / np.sqrt(hidden), (3 * hidden, hidden)).astype(np.float32)
        self.hidden = hidden

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        h, k = np.zeros((self.hidden, x.shape[1]), np.float32), self.hidden
        states, saved = np.empty((len(x), k, x.shape[1]), np.float32), []
        for t, b in enumerate(x):
            g, a = self.table[b].T, self.u @ h
            gate = 1 / (1 + np.exp(-(g[: 2 * k] + a[: 2 * k])))
            z, r = gate[:k], gate[k:]
            n = np.tanh(g[2 * k :] + r * a[2 * k :])
            saved.append((h, z, r, n, a[2 * k :]))
            states[t] = h = n + z * (h - n)
        return states, saved

    def backward(self, x: np.ndarray, saved: list, outer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of table and u from the states' own gradients."""
        k = self.hidden
        d_table, d_u = np.zeros_like(self.table), np.zeros_like(self.u)
        later = np.zeros_like(outer[0])
        gates = np.empty((len(x), x.shape[1], 3 * k), np.float32)
        for t in range(len(x) - 1, -1, -1):
            h, z, r, n, a = saved[t]
            d = outer[t] + later
            d_n = d * (1 - z) * (1 - n * n)
            d_z = d * (h - n) * z * (1 - z)
            d_r = d_n * a * r * (1 - r)
            inner = np.concatenate((d_z, d_r, d_n * r))
            d_u += inner @ h.T
            later = d * z + self.u.T @ inner
            gates[t] = np.concatenate((d_z, d_r, d_n)).T
        np.add.at(d_table, x.reshape(-1), gates.reshape(-1, 3 * k))
        return d_table, d_u


class Adam:
    def __init__(self, parts: list[np.ndarray], rate: float) -> None:
        self.parts, self.rate, self.step = parts, rate, 0
        self.mean = [np.zeros_like(p) for p in parts]
        self.square = [np.zeros_like(p) for p in parts]

    def update(self, gradients: list[np.ndarray]) -> None:
        self.step += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in gradients))
        scale = min(1.0, 5.0 / (norm + 1e-9))
        for p, m, v, g in zip(self.parts, self.mean, self.square, gradients):
            g = g * scale
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.99**self.step)) + 1e-6)


class LanguageModel:
    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.ahead, self.back = Gru(rng, hidden), Gru(rng, hidden)
        self.out = rng.normal(0, 0.3, (len(languages), 2 * hidden)).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)
        self.fast: tuple | None = None

    def fit(self, texts: list[bytes], labels: list[str], steps: int = STEPS, seed: int = SEED) -> LanguageModel:
        """Each step takes BATCH windows, the languages in equal shares, at random places."""
        rng = np.random.default_rng(seed + 1)
        own: dict[str, list[np.ndarray]] = {language: [] for language in self.languages}
        for t, label in zip(texts, labels):
            if t:
                own[label].append(np.frombuffer(t, np.uint8))
        by = list(own.values())
        parts = [self.ahead.table, self.ahead.u, self.back.table, self.back.u, self.out, self.bias]
        adam = Adam(parts, RATE)
        for step in range(steps):
            adam.rate = RATE * (1 - 0.9 * step / steps)
            y = rng.integers(0, len(by), BATCH)
            x = np.empty((WINDOW, BATCH), np.uint8)
            for lane, k in enumerate(y):
                text = by[k][rng.integers(len(by[k]))]
                at = rng.integers(max(1, len(text) - WINDOW + 1))
                x[:, lane] = np.resize(text[at : at + WINDOW], WINDOW)
            adam.update(self._gradients(x, y))
        return self

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        k = self.ahead.hidden
        f, saved_f = self.ahead.forward(x)
        b, saved_b = self.back.forward(x[::-1])
        states = np.concatenate((f, b[::-1]), axis=1)  # (time, 2 hidden, lanes)
        logits = self.out @ states + self.bias[:, None]
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        d = p
        d[:, y, np.arange(len(y))] -= 1
        d /= d.shape[0] * d.shape[2]
        d_states = self.out.T @ d
        d_out = np.einsum("tcl,thl->ch", d, states, optimize=True)
        return [*self.ahead.backward(x, saved_f, d_states[:, :k]), *self.back.backward(x[::-1], saved_b, d_states[::-1, k:]), d_out, d.sum(axis=(0, 2))]

    def freeze(self) -> LanguageModel:
        """Tables for prediction: features first, gates halved so that one tanh serves as sigmoid."""
        k = self.ahead.hidden
        half = np.concatenate((np.full(2 * k, 0.5), np.ones(k))).astype(np.float32)
        self.fast = tuple((np.ascontiguousarray(g.table.T * half[:, None]), np.ascontiguousarray(g.u * half[:, None])) for g in (self.ahead, self.back))
        return self

    def _states(self, x: np.ndarray, live: np.ndarray, full: np.ndarray, table: np.ndarray, u: np.ndarray, order: range) -> np.ndarray:
        k, lanes = self.ahead.hidden, x.shape[1]
        states = np.empty((len(x), k, lanes), np.float32)
        h = np.zeros((k, lanes), np.float32)
        g, a, s = (np.empty((3 * k, lanes), np.float32) for _ in range(3))
        for t in order:
            np.take(table, x[t], axis=1, out=g, mode="clip")
            np.matmul(u, h, out=a)
            gate, new = s[: 2 * k], s[2 * k :]
            np.add(g[: 2 * k], a[: 2 * k], out=gate)
            np.tanh(gate, out=gate)
            gate *= 0.5
            gate += 0.5
            np.multiply(gate[k:], a[2 * k :], out=new)
            new += g[2 * k :]
            np.tanh(new, out=new)
            h = np.subtract(h, new, out=states[t])
            h *= gate[:k]
            h += new
            if not full[t]:
                h *= live[t]
        return states

    def predict(self, texts: list[bytes]) -> np.ndarray:
        """(document, language): mean probability over all positions; zeros for empty texts."""
        sizes = np.array([len(t) for t in texts], np.int64)
        counts = -(-sizes // WINDOW)
        total = int(counts.sum())
        sums = np.zeros((total, len(self.languages)))
        padded = np.zeros(total * WINDOW, np.uint8)
        live = np.zeros(total * WINDOW, bool)
        start = (np.concatenate(([0], np.cumsum(counts)))[:-1]) * WINDOW
        at = np.repeat(start - np.concatenate(([0], np.cumsum(sizes)))[:-1], sizes) + np.arange(sizes.sum())
        padded[at], live[at] = np.frombuffer(b"".join(texts), np.uint8), True
        k = self.ahead.hidden
        lanes = max(16, LANES * LANES_LANGUAGES // max(LANES_LANGUAGES, len(self.languages)))
        for i in range(0, total, lanes):
            x = np.ascontiguousarray(padded.reshape(-1, WINDOW)[i : i + lanes].T)
            own = np.ascontiguousarray(live.reshape(-1, WINDOW)[i : i + lanes].T)
            full = own.all(axis=1)
            f = self._states(x, own, full, *self.fast[0], range(WINDOW))
            b = self._states(x, own, full, *self.fast[1], range(WINDOW - 1, -1, -1))
            logits = self.out[:, :k] @ f
            logits += self.out[:, k:] @ b
            logits += self.bias[:, None]
            np.exp(logits, out=logits)  # states lie within -1 and 1, so this can't overflow
            logits /= logits.sum(axis=1, keepdims=True)
            logits *= own[:, None, :]
            sums[i : i + lanes] = logits.sum(axis=0).T
        out = np.zeros((len(texts), len(self.languages)))
        np.add.at(out, np.repeat(np.arange(len(texts)), counts), sums)
        return out / np.maximum(sizes, 1)[:, None]


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", hidden: int = HIDDEN, steps: int = STEPS, sample_docs: int = SAMPLE_DOCS, crop_chars: int = CROP_CHARS) -> LanguageModel | None:
    """A model from the labelled rows that are not held out (`sample_docs` of each label at most); None if there are none."""
    rows = keyed(docs, key, text, named(lang).alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    mark = F.xxhash64("id")
    chosen = rows.groupBy("lang", F.pmod(mark, F.lit(sample_docs)).alias("slot")).agg(F.min_by("id", F.struct(F.xxhash64("id", F.lit(1)), F.col("id"))).alias("id"))
    ids = [r.id for r in chosen.select("id").collect()]  # at most sample_docs of each language
    picked = docs.sparkSession.createDataFrame([(i,) for i in ids], "id long")
    length = F.greatest(F.length("text") - crop_chars, F.lit(0))
    crop = F.substring("text", F.pmod(F.xxhash64("id", F.lit(2)), length + 1).cast("int") + 1, F.lit(crop_chars))
    crops = rows.join(F.broadcast(picked), "id", "left_semi").select("id", "lang", crop.alias("crop")).filter(F.length("crop") > 0)
    one = crops.groupBy("id").agg(F.min(F.struct("lang", "crop")).alias("r"))  # however many rows an id has
    sample = one.select("id", "r.*").orderBy("id").collect()
    languages = sorted({r.lang for r in sample})
    if not languages:
        return None
    return LanguageModel(languages, hidden).fit([r.crop.encode("utf-8") for r in sample], [r.lang for r in sample], steps).freeze()


def identify(docs: DataFrame, model: LanguageModel | None, *, text: str = "text", label: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with its language (`label`) and `score`; its other columns stay, but for those named so."""
    kept = others(docs, label, score)
    if model is None:
        return docs.select(*map(named, kept)).withColumns({label: F.lit("und"), score: F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            at = whole.schema.get_field_index(text)
            done = 0
            for _, texts in chunked([pa.record_batch([pa.nulls(len(whole), pa.int64()), whole.column(at)], names=["k", "t"])], 2 << 20):
                own = [t if t and has_letter(t) else b"" for t in texts]
                p = model.predict(own)
                best = p.argmax(axis=1)
                names = [model.languages[k] if t else "und" for k, t in zip(best.tolist(), own)]
                batch = whole.slice(done, len(texts))
                done += len(texts)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names), pa.array(np.minimum(p[np.arange(len(p)), best], 1.0))], names=[*kept, label, score])

    return map_arrow(docs.select(*map(named, kept)), run, extended(docs, kept, f"`{label}` string, `{score}` double"))


def has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode("utf-8")))
