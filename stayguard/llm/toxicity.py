"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Inputs of a token are a hashed word embedding, the mean of hashed embeddings of its
four-character sequences, and two scores of how much more often than expected the token,
and the most suspect of its character sequences, stand in toxic labelled documents (for a
training document, without the document itself: what stands in one document teaches
nothing). Two
gated recurrent units read a window from both sides; attention weights their states; a
logistic unit scores the window. Windows of ``WINDOW`` tokens start every ``STRIDE`` tokens
and the last one ends with the text, so the whole of every text is scored. A text's score is
a logistic function of its largest and mean window logits and its number of windows.

Labels are learned from rows whose crc32(id as text) mod 3 is not 1, from at most
``MAX_PER_CLASS`` documents of each class, the least by a hash of the id. What the model
holds is bounded by that sample; scoring is one pass over the texts.

Rows: null text is empty; a text without tokens gets the share of toxic training rows; with
labels of one class only, or none, every score is that share (0 without labels); a null id
is not held out and never learned from; repeated rows are scored alike; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewise import flat, hashes, mix, runs

WINDOW, STRIDE = 32, 16
HIDDEN = 8
WORDS, WORD_DIM = 4096, 4
CHARS, CHAR_DIM = 4096, 4
GRAM = 4
MAX_PER_CLASS = 1500
EPOCHS, BATCH, RATE, DECAY = 3, 128, 0.01, 1e-3
#: Windows of each class that an epoch draws.
EPOCH_WINDOWS = 6000
THRESHOLD = 0.7
#: Token scores nearer to 0 than this are taken as 0.
LEAST_PRIOR = 3.0
SLICE_BYTES = 1 << 20
CHUNK = 2048  # windows scored at a time

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_TOKEN = np.zeros(256, bool)
_TOKEN[128:] = True
for _a, _b in ("09", "az", "AZ"):
    _TOKEN[ord(_a):ord(_b) + 1] = True


class Tokens:
    """Tokens of texts laid end to end: distinct ones with their bytes, and the run of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends = runs(_TOKEN[data], offsets)
        self.first = np.searchsorted(starts, offsets)
        low = _LOWER[data]
        h = hashes(low, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        self.hash, at, self.which = np.unique(h, return_index=True, return_inverse=True)
        lens = (ends - starts)[at]
        edged = np.full(int(lens.sum()) + 2 * len(lens) + GRAM, 32, np.uint8)  # each token between two spaces
        begin = np.cumsum(lens + 2) - lens - 2
        inner = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
        edged[np.repeat(begin, lens) + 1 + inner] = low[np.repeat(starts[at], lens) + inner]
        self.sizes = np.maximum(1, lens + 3 - GRAM)  # character sequences of each token
        self.begin = np.cumsum(self.sizes) - self.sizes
        where = np.repeat(begin - self.begin, self.sizes) + np.arange(int(self.sizes.sum()))
        grams = np.zeros(len(where), np.uint64)
        for k in range(GRAM):
            grams = grams << np.uint64(8) | edged[where + k]
        self.grams = grams
        self.char = (mix(grams) >> np.uint64(52)).astype(np.int64)
        self.word = (self.hash >> np.uint64(52)).astype(np.int64)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, first token and length of every window."""
        n = np.diff(self.first)
        count = np.where(n == 0, 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)))
        text = np.repeat(np.arange(len(n)), count)
        k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        start = np.minimum(k * STRIDE, np.maximum(0, n[text] - WINDOW))
        return text, self.first[:-1][text] + start, np.minimum(n[text], WINDOW)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


class Network:
    """Weights by name; ``forward`` and ``gradients`` work on windows of input projections."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM + 2, HIDDEN

        def draw(*shape, scale=None):
            return (rng.standard_normal(shape) * (scale or 1 / np.sqrt(shape[0]))).astype(np.float32)

        self.w = {"word": draw(WORDS, WORD_DIM, scale=0.05), "char": draw(CHARS, CHAR_DIM, scale=0.1),
                  "x": draw(d, 6 * h), "xb": np.zeros(6 * h, np.float32), "uf": draw(h, 3 * h), "ub": draw(h, 3 * h),
                  "a": draw(2 * h, h), "ab": np.zeros(h, np.float32), "av": draw(h), "o": draw(2 * h), "ob": np.zeros(1, np.float32)}

    def inputs(self, tokens: Tokens, scores: np.ndarray) -> np.ndarray:
        """Input vector of each distinct token; ``scores`` has its two scores."""
        if not len(tokens.hash):
            return np.zeros((0, WORD_DIM + CHAR_DIM + 2), np.float32)
        chars = np.add.reduceat(self.w["char"][tokens.char], tokens.begin) / tokens.sizes[:, None].astype(np.float32)
        return np.concatenate([self.w["word"][tokens.word], chars, scores], axis=1)

    @staticmethod
    def _pass(px: np.ndarray, u: np.ndarray, mask: np.ndarray | None, back: bool, keep: bool):
        t_all, n, _ = px.shape
        h, hs, saved = np.zeros((n, HIDDEN), np.float32), np.empty((t_all, n, HIDDEN), np.float32), []
        for t in range(t_all - 1, -1, -1) if back else range(t_all):
            hu = h @ u
            zr = _sigmoid(px[t, :, :2 * HIDDEN] + hu[:, :2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(px[t, :, 2 * HIDDEN:] + r * hu[:, 2 * HIDDEN:])
            new = c + z * (h - c)
            if mask is not None:
                new = np.where(mask[t][:, None], new, h)
            if keep:
                saved.append((t, h, z, r, c, hu[:, 2 * HIDDEN:]))
            h = hs[t] = new
        return hs, saved

    def forward(self, px: np.ndarray, mask: np.ndarray | None, keep: bool = False):
        """Logits of windows; ``px`` is (time, windows, 6 * HIDDEN)."""
        f, fs = self._pass(px[:, :, :3 * HIDDEN], self.w["uf"], mask, False, keep)
        b, bs = self._pass(px[:, :, 3 * HIDDEN:], self.w["ub"], mask, True, keep)
        hs = np.concatenate([f, b], axis=2)
        k = np.tanh(hs @ self.w["a"] + self.w["ab"])
        e = k @ self.w["av"]
        if mask is not None:
            e = np.where(mask, e, np.float32(-1e9))
        e = np.exp(e - e.max(axis=0))
        alpha = e / e.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", alpha, hs)
        return pooled @ self.w["o"] + self.w["ob"][0], (fs, bs, hs, k, alpha, pooled)

    def gradients(self, px: np.ndarray, mask: np.ndarray, err: np.ndarray):
        """Gradients for the loss's derivative ``err(logits)``; also of ``px``."""
        logit, (fs, bs, hs, k, alpha, pooled) = self.forward(px, mask, keep=True)
        d = err(logit)
        g = {"o": pooled.T @ d, "ob": d.sum(keepdims=True)}
        dp = d[:, None] * self.w["o"]
        dh = alpha[:, :, None] * dp
        da = np.einsum("nh,tnh->tn", dp, hs)
        de = alpha * (da - (alpha * da).sum(axis=0))
        de = np.where(mask, de, 0)
        g["av"] = np.einsum("tn,tnh->h", de, k)
        dk = de[:, :, None] * self.w["av"] * (1 - k * k)
        g["a"], g["ab"] = np.einsum("tnh,tnk->hk", hs, dk), dk.sum(axis=(0, 1))
        dh = dh + dk @ self.w["a"].T
        dpx = np.zeros_like(px)
        for name, saved, part, cols in (("uf", fs, dh[:, :, :HIDDEN], slice(0, 3 * HIDDEN)), ("ub", bs, dh[:, :, HIDDEN:], slice(3 * HIDDEN, 6 * HIDDEN))):
            u, gu, carry = self.w[name], np.zeros_like(self.w[name]), np.zeros((px.shape[1], HIDDEN), np.float32)
            for t, h, z, r, c, hc in reversed(saved):
                m = mask[t][:, None]
                dn = np.where(m, carry + part[t], 0)
                dc = dn * (1 - z) * (1 - c * c)
                pre = np.concatenate([dn * (h - c) * z * (1 - z), dc * hc * r * (1 - r), dc], axis=1)
                rec = np.concatenate([pre[:, :2 * HIDDEN], dc * r], axis=1)
                gu += h.T @ rec
                dpx[t, :, cols] = pre
                carry = np.where(m, dn * z + rec @ u.T, carry + part[t])
            g[name] = gu
        return logit, g, dpx


def _projected(net: Network, x: np.ndarray) -> np.ndarray:
    return x @ net.w["x"] + net.w["xb"]


def _laid_out(px: np.ndarray, start: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """(time, windows, ...) from rows of tokens, and the mask where windows are short."""
    t = np.arange(WINDOW)[:, None]
    at = start[None, :] + t
    if (lens == WINDOW).all():
        return px[at], None
    mask = t < lens[None, :]
    return px[np.where(mask, at, 0)], mask


class Scores:
    """Scores by sorted key; 0 for other keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys[values != 0], values[values != 0]

    def of(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), np.float32)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], np.float32(0))


class Model:
    """A trained network, token scores, and the weights that turn window logits into a text's score."""

    def __init__(self, rate: float, net: Network | None = None, words: Scores | None = None, grams: Scores | None = None):
        self.rate, self.net, self.words, self.grams, self.top = rate, net, words, grams, None

    def scores_of(self, tokens: Tokens) -> np.ndarray:
        grams = np.maximum.reduceat(self.grams.of(tokens.grams), tokens.begin) if len(tokens.hash) else np.zeros(0, np.float32)
        return np.stack([self.words.of(tokens.hash), grams], axis=1).astype(np.float32)

    def window_logits(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Text and logit of every window."""
        text, start, lens = tokens.windows()
        rows = _projected(self.net, self.net.inputs(tokens, self.scores_of(tokens)))[tokens.which]
        out = np.empty(len(text), np.float32)
        order = np.argsort(lens == WINDOW, kind="stable")  # short windows together
        for at in range(0, len(order), CHUNK):
            some = order[at:at + CHUNK]
            out[some] = self.net.forward(*_laid_out(rows, start[some], lens[some]))[0]
        return text, out

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        out = np.full(n, self.rate)
        if self.net is None or not len(data):
            return out
        text, logit = self.window_logits(Tokens(data, offsets))
        some, first = np.unique(text, return_index=True)
        if len(some):
            out[some] = 1 / (1 + np.exp(-(_features(logit, first) @ self.top)))
        return out


def _features(logit: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each text: 1, largest logit, mean logit, log of the number of windows."""
    count = np.diff(np.concatenate([first, [len(logit)]]))
    return np.stack([np.ones(len(first)), np.clip(np.maximum.reduceat(logit, first), -15, 15),
                     np.clip(np.add.reduceat(logit, first) / count, -15, 15), np.log(count)], axis=1).astype(np.float64)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _suspicion(k: np.ndarray, m: np.ndarray, rate: float) -> np.ndarray:
    """How far the toxic documents among k + m exceed what the rate lets expect, in about standard deviations."""
    expected = (k + m) * rate
    s = (k - expected) / np.sqrt(expected + 1)
    return np.where(np.abs(s) < LEAST_PRIOR, 0, np.clip(s, -3, 9) / 3).astype(np.float32)


def train(texts: list[bytes], toxic: np.ndarray, rate: float, seed: int = 7) -> Model:
    """A model from labelled texts; ``rate`` is the share of toxic rows where they come from."""
    toxic = np.asarray(toxic, bool)
    if not len(texts) or toxic.all() or not toxic.any():
        return Model(rate if len(texts) else 0.0)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    tokens = Tokens(np.frombuffer(b"".join(texts), np.uint8), offsets)
    text_of = np.repeat(np.arange(len(texts)), np.diff(tokens.first))
    share = toxic.mean()
    kinds, which = np.unique(tokens.grams, return_inverse=True)
    m, k = np.zeros((2, len(tokens.hash)))  # documents of either class with each token, and with each character sequence
    gm, gk = np.zeros((2, len(kinds)))
    for d in range(len(texts)):
        has = np.unique(tokens.which[tokens.first[d]:tokens.first[d + 1]])
        sizes = tokens.sizes[has]
        at = np.repeat(tokens.begin[has] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        (k if toxic[d] else m)[has] += 1
        (gk if toxic[d] else gm)[np.unique(which[at])] += 1
    model = Model(rate, Network(seed), Scores(tokens.hash, _suspicion(k, m, share)), Scores(kinds, _suspicion(gk, gm, share)))
    without = []  # the two scores of each token in a harmless, and in a toxic document, without that document
    for own in (0, 1):
        grams = np.maximum.reduceat(_suspicion(np.maximum(gk - own, 0), np.maximum(gm - 1 + own, 0), share)[which], tokens.begin)
        without.append(np.stack([_suspicion(np.maximum(k - own, 0), np.maximum(m - 1 + own, 0), share), grams], axis=1))
    without = np.stack(without).astype(np.float32)
    own = toxic[text_of].astype(np.int64)
    net, rng = model.net, np.random.default_rng(seed)
    text, start, lens = tokens.windows()
    y = toxic[text].astype(np.float32)
    use = np.ones(len(text), bool)
    first = {n: np.zeros_like(v) for n, v in net.w.items()}
    second = {n: np.zeros_like(v) for n, v in net.w.items()}
    step = 0

    def batch_of(some: np.ndarray):
        at = start[some][None, :] + np.arange(WINDOW)[:, None]
        mask = np.arange(WINDOW)[:, None] < lens[some][None, :]
        at = np.where(mask, at, 0)
        kinds, where = np.unique(tokens.which[at], return_inverse=True)
        sizes = tokens.sizes[kinds]
        begin = np.cumsum(sizes) - sizes
        grams = tokens.char[np.repeat(tokens.begin[kinds] - begin, sizes) + np.arange(sizes.sum())]
        chars = np.add.reduceat(net.w["char"][grams], begin) / sizes[:, None].astype(np.float32)
        where = where.reshape(at.shape)
        x = np.concatenate([net.w["word"][tokens.word[kinds]], chars], axis=1)[where]
        x = np.concatenate([x, without[own[at], tokens.which[at]]], axis=2)
        return x, mask, kinds, where, grams, sizes

    for epoch in range(EPOCHS):
        if epoch == 2:  # toxic texts have harmless windows: keep the half of each that looks most toxic
            logit = np.empty(len(text), np.float32)
            for a in range(0, len(text), CHUNK):
                some = np.arange(a, min(a + CHUNK, len(text)))
                x, mask, *_ = batch_of(some)
                logit[some] = net.forward(_projected(net, x), mask)[0]
            for d in np.flatnonzero(toxic):
                a, b = np.searchsorted(text, [d, d + 1])
                if b - a > 1:
                    use[a:b] = logit[a:b] >= np.median(logit[a:b])
        pos, neg = np.flatnonzero(use & (y == 1)), np.flatnonzero(y == 0)
        order = rng.permutation(np.concatenate([rng.permutation(pos)[:EPOCH_WINDOWS], rng.permutation(neg)[:2 * EPOCH_WINDOWS]]))
        for a in range(0, len(order), BATCH):
            some = order[a:a + BATCH]
            x, mask, kinds, where, grams, sizes = batch_of(some)
            target = y[some]
            _, g, dpx = net.gradients(_projected(net, x), mask, lambda logit: ((_sigmoid(logit) - target) / len(target)).astype(np.float32))
            g["x"], g["xb"] = np.einsum("tnd,tnk->dk", x, dpx), dpx.sum(axis=(0, 1))
            dx = (dpx @ net.w["x"].T)[:, :, :-2].reshape(-1, WORD_DIM + CHAR_DIM)
            per_kind = np.zeros((len(kinds), dx.shape[1]), np.float32)
            np.add.at(per_kind, where.ravel(), dx)
            g["word"], g["char"] = np.zeros_like(net.w["word"]), np.zeros_like(net.w["char"])
            np.add.at(g["word"], tokens.word[kinds], per_kind[:, :WORD_DIM])
            np.add.at(g["char"], grams, np.repeat(per_kind[:, WORD_DIM:] / sizes[:, None], sizes, axis=0))
            step += 1
            for n, grad in g.items():
                grad = grad + np.float32(DECAY) * net.w[n]
                first[n] = 0.9 * first[n] + 0.1 * grad
                second[n] = 0.999 * second[n] + 0.001 * grad * grad
                net.w[n] -= (RATE * (first[n] / (1 - 0.9 ** step)) / (np.sqrt(second[n] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    logit = np.empty(len(text), np.float32)
    for a in range(0, len(text), CHUNK):
        some = np.arange(a, min(a + CHUNK, len(text)))
        x, mask, *_ = batch_of(some)
        logit[some] = net.forward(_projected(net, x), mask)[0]
    some, begin = np.unique(text, return_index=True)
    model.top = _logistic(_features(logit, begin), toxic[some].astype(float))
    return model


def held_out(id_col: str | Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_per_class: int = MAX_PER_CLASS) -> Model:
    """A model from the labelled rows outside the held-out fold."""
    known = labels.filter(F.col("toxic").isNotNull()).select(F.col(id_col).alias("_id"), (F.col("toxic") > 0).alias("_toxic")).filter(~held_out("_id"))
    known = known.groupBy("_id").agg(F.max("_toxic").alias("_toxic")).filter("_id is not null")
    counts = {r["_toxic"]: r["n"] for r in known.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(F.lit(20), "_id")
    chosen = [known.filter(F.col("_toxic") == v).orderBy(order, "_id").limit(max_per_class) for v in (True, False)]
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.join(F.broadcast(chosen[0].unionByName(chosen[1])), "_id")  # at most two times max_per_class ids
    rows = rows.groupBy("_text").agg(F.min("_id").alias("_id"), F.max("_toxic").alias("_toxic"))  # copies teach once
    total = sum(counts.values())
    rate = counts.get(True, 0) / total if total else 0.0

    def learn(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = sorted((i, t, y) for b in parts for i, t, y in zip(*(b.column(c).to_pylist() for c in ("_id", "_text", "_toxic"))))
        model = train([t.encode() for _, t, _ in sample], np.array([y for _, _, y in sample], bool), rate)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    # the sample is bounded, so one task learns from it and the driver sees the weights only
    made = rows.select("_id", "_text", "_toxic").repartition(1).mapInArrow(learn, "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else Model(rate)


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, kept columns, held_out, score, predicted for every row."""
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, id_col, text_col))  # bounded by the training sample
    kept = (id_col, *keep)
    sent = kept if text_col in kept else (*kept, text_col)

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import batches
        for b in parts:
            data, offsets = flat(b.column(text_col))
            out = np.empty(b.num_rows)
            for a, z in batches(data, offsets, SLICE_BYTES):
                out[a:z] = model.value.scores(data[offsets[a]:offsets[z]], offsets[a:z + 1] - offsets[a])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(out)], names=[*kept, "score"])

    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in kept)
    out = docs.select(*sent).mapInArrow(score, fields + "score double")
    return out.select(*kept, held_out(id_col).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
