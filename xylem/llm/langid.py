"""Language identification: a bidirectional gated recurrent network over UTF-8 bytes.

Training runs in numpy on the driver, by backpropagation through time, on a bounded sample: at most
about PER_LANG documents of each language, and of each the window from its first letter on and
MORE_WINDOWS windows spread evenly over the text from a hash-chosen place, WINDOW bytes each. The sample
doesn't depend on row order or layout. Every byte position is labelled with its document's language;
languages weigh alike. The bound is on what the model is fitted to; there may be MOST_LANGS languages,
more are refused.

Prediction reads whole texts: the bytes are cut into windows of WINDOW bytes, the network labels
every position of every window and the position probabilities are averaged over the document. Memory
is bounded by a block of windows, however long a text is.

Defined cases: a text that is null or has no letter is `und` with score 0; without any training row
every text is `und`; repeated rows each get a row; very long texts are read whole;
of languages that tie the first by name wins; extra columns are kept or ignored as asked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from xylem.llm.common import OWN, held_out, slices

PER_LANG, MORE_WINDOWS, EPOCHS, HIDDEN, SEED, MOST_LANGS = 300, 3, 6, 8, 7, 1000
#: A small sample is gone through more often, until there were so many steps.
LEAST_STEPS = 250
WINDOW, BLOCK, BATCH = 128, 4096, 64
UNKNOWN = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Network:
    """w[d]: input rows of a byte for the gates update, reset and candidate; u[d]: the same from the state."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = SEED):
        self.langs, rng = langs, np.random.default_rng(seed)
        make = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        self.p = {"v": make(2 * hidden, len(langs)), "c": np.zeros(len(langs), np.float32)}
        for d in (0, 1):
            self.p |= {f"w{d}": make(3, 256, hidden), f"u{d}": make(3, hidden, hidden)}
        self.hidden = hidden

    def _states(self, x: np.ndarray, d: int) -> list[tuple]:
        """For each step of bytes x (steps, rows): the state before, the gates, the reset term and the state after."""
        w, u, h = self.p[f"w{d}"], self.p[f"u{d}"], np.zeros((x.shape[1], self.hidden), np.float32)
        steps = []
        for row in x if d == 0 else x[::-1]:
            z, r = _sigmoid(w[0][row] + h @ u[0]), _sigmoid(w[1][row] + h @ u[1])
            m = h @ u[2]
            n = np.tanh(w[2][row] + r * m)
            after = n + z * (h - n)
            steps.append((h, z, r, m, n, after))
            h = after
        return steps

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients of the weighted mean cross-entropy over positions; weight (steps, rows)."""
        steps, rows = x.shape
        both = [self._states(x, d) for d in (0, 1)]
        after = np.concatenate([np.stack([s[5] for s in both[0]]), np.stack([s[5] for s in both[1]])[::-1]], axis=2)
        logits = after @ self.p["v"] + self.p["c"]
        logits -= logits.max(axis=2, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=2, keepdims=True)
        scale = weight / max(weight.sum(), 1e-9)
        right = np.take_along_axis(prob, np.broadcast_to(y, (steps, rows))[:, :, None], axis=2)[:, :, 0]
        loss = float(-(np.log(right + 1e-12) * scale).sum())
        prob[:, np.arange(rows), y] -= 1
        delta = prob * scale[:, :, None]
        out = {"v": np.tensordot(after, delta, axes=([0, 1], [0, 1])), "c": delta.sum(axis=(0, 1))}
        back = delta @ self.p["v"].T
        for d in (0, 1):
            u, carried = self.p[f"u{d}"], np.zeros((rows, self.hidden), np.float32)
            du, dw = np.zeros_like(u), np.zeros_like(self.p[f"w{d}"])
            own = back[:, :, d * self.hidden : (d + 1) * self.hidden]
            gates = np.empty((steps, 3, rows, self.hidden), np.float32)
            for k in range(steps - 1, -1, -1):
                h, z, r, m, n, _ = both[d][k]
                t = k if d == 0 else steps - 1 - k
                dh = own[t] + carried
                dn = dh * (1 - z) * (1 - n * n)
                dz, dr, dm = dh * (h - n) * z * (1 - z), dn * m * r * (1 - r), dn * r
                carried = dh * z + dz @ u[0].T + dr @ u[1].T + dm @ u[2].T
                du += np.stack([h.T @ dz, h.T @ dr, h.T @ dm])
                gates[t] = (dz, dr, dn)
            for g in range(3):
                np.add.at(dw[g], x.ravel(), gates[:, g].reshape(-1, self.hidden))
            out |= {f"w{d}": dw, f"u{d}": du}
        return loss, out

    def fit(self, windows: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.02, seed: int = SEED) -> None:
        """Adam over shuffled batches; languages weigh alike."""
        rng, per = np.random.default_rng(seed), 1 / np.maximum(np.bincount(labels, minlength=len(self.langs)), 1)
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in (0, 1))
        t, epochs = 0, max(epochs, -(-LEAST_STEPS // -(-len(windows) // BATCH)))
        for epoch in range(epochs):
            order = rng.permutation(len(windows))
            for a in range(0, len(order), BATCH):
                some = order[a : a + BATCH]
                x, filled = window_matrix([windows[i] for i in some], max(len(windows[i]) for i in some))
                weight = filled.astype(np.float32) * per[labels[some]].astype(np.float32)
                _, grads = self.gradients(x, labels[some], weight)
                t += 1
                step = rate * 0.5 ** (2.5 * epoch / epochs) * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
                for k, g in grads.items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.p[k] = (self.p[k] - step * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)

    def _run(self, x: np.ndarray, d: int, keep, filled: np.ndarray | None = None) -> None:
        """The forward pass of prediction: halves are folded into the weights, buffers are reused.

        keep(t, state) gets the state after the byte at step t. Where filled is false the state stays
        zero, so what a short window gives doesn't depend on the windows beside it.
        """
        w, u, n = self.p[f"w{d}"].copy(), self.p[f"u{d}"].copy(), x.shape[1]
        w[:2] *= 0.5  # sigmoid(a) = (tanh(a / 2) + 1) / 2
        u[:2] *= 0.5
        u[2] *= 0.5  # the half of the reset gate
        h = np.zeros((n, self.hidden), np.float32)
        a, z, r, m = (np.empty_like(h) for _ in range(4))
        steps = range(len(x)) if d == 0 else range(len(x) - 1, -1, -1)
        for t in steps:
            for gate, out in ((0, z), (1, r)):
                np.take(w[gate], x[t], axis=0, out=out, mode="clip")
                np.matmul(h, u[gate], out=a)
                np.add(out, a, out=out)
                np.tanh(out, out=out)
                np.add(out, 1, out=out)
            np.matmul(h, u[2], out=m)
            np.multiply(m, r, out=m)
            np.take(w[2], x[t], axis=0, out=a, mode="clip")
            np.add(a, m, out=a)
            np.tanh(a, out=a)
            np.subtract(h, a, out=h)
            np.multiply(h, z, out=h)
            np.multiply(h, 0.5, out=h)
            np.add(h, a, out=h)
            if filled is not None:
                np.multiply(h, filled[t][:, None], out=h)
            keep(t, h)

    def window_sums(self, x: np.ndarray, filled: np.ndarray) -> np.ndarray:
        """Position probabilities summed over the filled positions of each window; x (steps, windows)."""
        k, n = len(self.langs), x.shape[1]
        logits = np.empty((len(x), n, k), np.float32)
        v, sums, x = self.p["v"], np.zeros((n, k), np.float32), x.astype(np.intp)
        self._run(x, 0, lambda t, h: np.matmul(h, v[: self.hidden], out=logits[t]))
        logits += self.p["c"]
        last = filled.sum(axis=0)
        whole = last.min() == len(x)

        def pool(t: int, h: np.ndarray) -> None:
            p = logits[t]
            np.add(p, h @ v[self.hidden :], out=p)
            np.exp(np.minimum(p, 60, out=p), out=p)
            np.divide(p, p.sum(axis=1, keepdims=True), out=p)
            if not whole:
                p *= filled[t][:, None]
            np.add(sums, p, out=sums)

        self._run(x, 1, pool, None if whole else filled)
        return sums

    def predict(self, texts: list[bytes]) -> np.ndarray:
        """Mean position probabilities (texts, languages); zeros for an empty text."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        data = np.frombuffer(b"".join(texts) + b" " * WINDOW, np.uint8)
        starts = np.cumsum(sizes) - sizes
        pieces = -(-sizes // WINDOW)
        owner = np.repeat(np.arange(len(texts)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = starts[owner] + nth * WINDOW
        length = np.minimum(sizes[owner] - nth * WINDOW, WINDOW)
        order = np.argsort(-length, kind="stable")  # whole windows first: short ones share blocks
        total = np.zeros((len(texts), len(self.langs)))
        for a in range(0, len(order), BLOCK):
            some = order[a : a + BLOCK]
            steps = int(length[some[0]])
            at = np.arange(steps)[:, None]
            filled = at < length[some][None, :]
            x = np.where(filled, data[begin[some][None, :] + at], 32)
            np.add.at(total, owner[some], self.window_sums(x, filled))
        return total / np.maximum(sizes, 1)[:, None]


def window_matrix(windows: list[bytes], steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (steps, windows), filled up with blanks, and which are filled."""
    x = np.full((len(windows), steps), 32, np.uint8)
    for k, w in enumerate(windows):
        x[k, : len(w)] = np.frombuffer(w, np.uint8)
    filled = np.arange(steps)[:, None] < np.array([len(w) for w in windows])[None, :]
    return x.T.astype(np.int64), filled


def sample(docs: DataFrame, per_lang: int = PER_LANG) -> list[tuple[str, bytes]]:
    """Windows of about per_lang texts of each language, from labelled rows outside the held-out part."""
    has_letter = F.col("text").rlike(r"\p{L}")
    rows = docs.where(~held_out(4, 2) & F.col("lang").isNotNull() & F.coalesce(has_letter, F.lit(False)))
    counts = {r[0]: r[1] for r in rows.groupBy(F.col("lang").cast("string")).count().limit(MOST_LANGS + 1).collect()}
    if len(counts) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages in `lang`")
    if not counts:
        return []
    mix = F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample"))
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, per_lang / n)))])
    drawn = rows.where(F.pmod(mix, F.lit(1 << 20)) < share[F.col("lang").cast("string")] * (1 << 20))
    # characters of a window are at most its bytes; each place is that of the k-th part of the text
    part = F.greatest(F.floor((F.char_length("text") - WINDOW) / MORE_WINDOWS), F.lit(0))
    spread = [F.substring("text", (F.lit(1) + k * part + F.pmod(F.shiftrightunsigned(mix, 20), part + 1)).cast("int"), F.lit(WINDOW)) for k in range(MORE_WINDOWS)]
    windows = F.array_distinct(F.filter(F.array(F.regexp_extract("text", rf"(?s)(\p{{L}}.{{0,{WINDOW - 1}}})", 1), *spread), lambda w: w.rlike(r"\p{L}")))
    got = drawn.select(mix.alias("m"), F.col("lang").cast("string").alias("lang"), windows.alias("ws"))
    got = got.orderBy("m", "lang", "ws").limit(4 * per_lang * len(counts)).collect()
    return [(r["lang"], w.encode()[:WINDOW]) for r in got for w in r["ws"]]


def train(docs: DataFrame, per_lang: int = PER_LANG) -> Network | None:
    rows = sample(docs, per_lang)
    if not rows:
        return None
    langs = sorted({lang for lang, _ in rows})
    number = {lang: k for k, lang in enumerate(langs)}
    network = Network(langs)
    network.fit([w for _, w in rows], np.array([number[lang] for lang, _ in rows]))
    return network


def with_language(docs: DataFrame, network: Network | None, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs with lang_pred and score (prefixed, so that no column clashes)."""
    keep = docs.columns if keep is None else keep
    text = docs["text"].cast("string")
    has_letter = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    # a kept text goes to Python once
    place = keep.index("text") if "text" in keep and isinstance(docs.schema["text"].dataType, T.StringType) else len(keep)
    held = docs.select(*keep, *([text.alias(f"{OWN}t")] if place == len(keep) else []), has_letter.alias(f"{OWN}l"))
    column = held.columns[place]
    schema = T.StructType([*held.schema.fields[: len(keep)], T.StructField(f"{OWN}lang", T.StringType()), T.StructField(f"{OWN}score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, column, 8 << 20):
                told = pc.if_else(batch.column(batch.num_columns - 1), batch.column(place), "")
                texts = told.cast(pa.binary()).to_pylist()
                if network is None:
                    langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
                else:
                    prob = network.predict(texts)
                    best = prob.argmax(axis=1)
                    langs = [network.langs[k] if t else UNKNOWN for k, t in zip(best, texts, strict=True)]
                    scores = np.clip(prob[np.arange(len(texts)), best], 0, 1)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return held.mapInArrow(run, schema)


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs, learned from docs."""
    named = with_language(docs, train(docs), ["doc_id"])
    return named.select("doc_id", held_out(4, 2).alias("held_out"), F.col(f"{OWN}lang").alias("lang_pred"), F.col(f"{OWN}score").alias("score"))


def keep_known(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """The documents, unchanged, whose language is known with at least this score."""
    named = with_language(docs, train(docs))
    return named.where((F.col(f"{OWN}lang") != UNKNOWN) & (F.col(f"{OWN}score") >= least)).select(*docs.columns)
