"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs, trained in numpy.

The network runs over a text in blocks of ``BLOCK`` words, each begun ``CONTEXT`` words before it in both directions, and gives every word a
state. Attention pools the states of every window of ``WINDOW`` words, one from each word on: a window's logit is the mean of its states'
outputs, weighted by their attention, so all windows come from two sliding sums. The document's score is the calibrated maximum over them. What
a word gives to the gates depends on the word alone, so each distinct word (from its characters and its own vector) is projected once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows, crc_mod, fresh

WINDOW, BLOCK, CONTEXT = 24, 48, 8
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_WORD_DIM, _CHAR_DIM, _HIDDEN, _CHAR_ROWS = 12, 8, 8, 4096


def words_of(chunk: str) -> list[str]:
    return _WORD.findall(chunk.lower())


def char_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the character table of all words' trigrams, bounds included, and their number in each word: hashes of three code points."""
    padded = [f"<{w}>" for w in words]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(p) for p in padded], np.int64)
    h = points[:-2] * np.uint64(0x9E3779B97F4A7C15) + points[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + points[2:] * np.uint64(0x165667B19E3779F9)
    inside = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)[: len(h)]
    keep = inside < np.repeat(sizes, sizes)[: len(h)] - 2
    return (h[keep] >> np.uint64(40)).astype(np.int64) % _CHAR_ROWS, sizes - 2


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Weights, the forward pass over windows of word rows, and its gradient."""

    def __init__(self, vocabulary: dict[str, int], evidence: np.ndarray, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        size = _WORD_DIM + _CHAR_DIM
        self.vocabulary, self.scale, self.shift, self.length_weight = vocabulary, 1.0, 0.0, 0.0
        self.w = {"word": normal(len(vocabulary) + 1, _WORD_DIM, scale=0.1), "char": normal(_CHAR_ROWS, _CHAR_DIM, scale=0.1)}
        self.w["word"][:, 0] = evidence
        for d in "fb":
            self.w |= {f"in_{d}": normal(size, 3 * _HIDDEN, scale=size**-0.5), f"rec_{d}": normal(_HIDDEN, 3 * _HIDDEN, scale=_HIDDEN**-0.5), f"bias_{d}": np.zeros(3 * _HIDDEN, np.float32)}
        self.w |= {"attend": normal(2 * _HIDDEN, scale=0.1), "out": normal(2 * _HIDDEN, scale=0.3), "bias": np.zeros(1, np.float32)}

    def inputs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Input vectors of words: their own vector beside the mean of their trigrams' vectors."""
        rows = np.array([self.vocabulary.get(w, len(self.vocabulary)) for w in words], np.int64)
        if not words:
            return np.zeros((0, _WORD_DIM + _CHAR_DIM), np.float32), rows, rows, rows
        flat, sizes = char_grams(words)
        chars = np.add.reduceat(self.w["char"][flat], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
        return np.concatenate([self.w["word"][rows], chars], axis=1).astype(np.float32), rows, flat, sizes

    def project(self, words: list[str]) -> np.ndarray:
        """What each word adds to the gates of both directions."""
        x = self.inputs(words)[0]
        return np.concatenate([x @ self.w["in_f"] + self.w["bias_f"], x @ self.w["in_b"] + self.w["bias_b"]], axis=1)

    def states(self, gates: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States of both directions. gates: steps x sequences x 6 hidden; mask: steps x sequences, 0 where there is no word."""
        steps, n = mask.shape
        h, hidden = _HIDDEN, np.zeros((steps, n, 2 * _HIDDEN), np.float32)
        for d, offset, order in (("f", 0, range(steps)), ("b", 3 * h, range(steps - 1, -1, -1))):
            state, rec, at = np.zeros((n, h), np.float32), self.w[f"rec_{d}"], (0 if d == "f" else h)
            for t in order:
                g, back = gates[t, :, offset : offset + 3 * h], state @ rec
                zr = _sigmoid(g[:, : 2 * h] + back[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                c = np.tanh(g[:, 2 * h :] + r * back[:, 2 * h :])
                new = (z * state + (1 - z) * c) * mask[t][:, None]
                if keep is not None:
                    keep.append((d, t, state, z, r, c, back[:, 2 * h :]))
                hidden[t, :, at : at + h] = state = new
        return hidden

    def forward(self, gates: np.ndarray, mask: np.ndarray, inside: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logits of one window in each sequence; inside: steps x sequences, 1 where a word is in the window."""
        hidden = self.states(gates, mask, keep)
        weight = np.exp(hidden @ self.w["attend"]) * inside
        weight /= np.maximum(weight.sum(0), 1e-9)
        pooled = (weight[:, :, None] * hidden).sum(0)
        if keep is not None:
            keep.append((hidden, weight, pooled))
        return pooled @ self.w["out"] + self.w["bias"]

    def gradient(self, words: list[list[str]], bounds: list[tuple[int, int]], y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradient of windows: lists of words with their context, and the window's bounds in each."""
        flat = list(dict.fromkeys(chain.from_iterable(words)))
        number = {w: k for k, w in enumerate(flat)}
        ids, mask = padded([[number[w] for w in ws] for ws in words])
        at = np.arange(len(mask))[:, None]
        inside = ((at >= [a for a, _ in bounds]) & (at < [b for _, b in bounds])).astype(np.float32)
        x, rows, grams, sizes = self.inputs(flat)
        table = np.concatenate([np.concatenate([x @ self.w["in_f"] + self.w["bias_f"], x @ self.w["in_b"] + self.w["bias_b"]], axis=1), np.zeros((1, 6 * _HIDDEN), np.float32)])
        keep: list = []
        logit = self.forward(table[ids], mask, inside, keep)
        p = _sigmoid(logit)
        loss = float(-(weight * np.log(np.clip(np.where(y, p, 1 - p), 1e-7, 1))).sum() / weight.sum())
        dlogit = ((p - y) * weight / weight.sum()).astype(np.float32)
        hidden, attention, pooled = keep.pop()
        g = {"out": pooled.T @ dlogit, "bias": dlogit.sum(keepdims=True)}
        dpooled = dlogit[:, None] * self.w["out"]
        dscore = attention * ((hidden * dpooled).sum(-1) - (pooled * dpooled).sum(-1))
        g["attend"] = (dscore[:, :, None] * hidden).sum((0, 1))
        dhidden = attention[:, :, None] * dpooled + dscore[:, :, None] * self.w["attend"]
        dtable, h = np.zeros_like(table), _HIDDEN
        for d in "fb":
            rec, drec, carry, at, offset = self.w[f"rec_{d}"], np.zeros_like(self.w[f"rec_{d}"]), 0, (0 if d == "f" else h), (0 if d == "f" else 3 * h)
            for _, t, state, z, r, c, back in reversed([k for k in keep if k[0] == d]):
                dnew = (dhidden[t, :, at : at + h] + carry) * mask[t][:, None]
                dc = dnew * (1 - z) * (1 - c * c)
                dz, dr = dnew * (state - c) * z * (1 - z), dc * back * r * (1 - r)
                dback = np.concatenate([dz, dr, dc * r], axis=1)
                drec += state.T @ dback
                carry = dnew * z + dback @ rec.T
                np.add.at(dtable[:, offset : offset + 3 * h], ids[t], np.concatenate([dz, dr, dc], axis=1))
            g[f"rec_{d}"] = drec
        dtable, dx = dtable[:-1], np.zeros_like(x)
        for d, part in (("f", dtable[:, : 3 * h]), ("b", dtable[:, 3 * h :])):
            g[f"in_{d}"], g[f"bias_{d}"] = x.T @ part, part.sum(0)
            dx += part @ self.w[f"in_{d}"].T
        g["word"], g["char"] = np.zeros_like(self.w["word"]), np.zeros_like(self.w["char"])
        np.add.at(g["word"], rows, dx[:, :_WORD_DIM])
        np.add.at(g["char"], grams, np.repeat(dx[:, _WORD_DIM:] / sizes[:, None], sizes, axis=0))
        return loss, g

    def calibrated(self, best: np.ndarray, windows: np.ndarray) -> np.ndarray:
        return _sigmoid(self.scale * best + self.length_weight * np.log(np.maximum(windows, 1)) + self.shift)


def padded(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Steps x sequences of ids (-1 beyond the end) and their mask."""
    sizes = np.array([len(r) for r in rows])
    at = np.arange(sizes.max(initial=1))[:, None]
    mask = at < sizes
    ids = np.full(mask.shape, -1, np.int64)
    ids.T[mask.T] = np.fromiter(chain.from_iterable(rows), np.int64, int(sizes.sum()))
    return ids, mask.astype(np.float32)


def sliding(values: np.ndarray) -> np.ndarray:
    """Sums of ``WINDOW`` values from each place on (of those that are left at the end), by doubling: no sum holds other values."""
    padded_values = np.concatenate([values, np.zeros(WINDOW, values.dtype)])
    total, start, part, width = np.zeros(len(values), values.dtype), 0, padded_values, 1
    while width <= WINDOW:
        if WINDOW & width:
            total += part[start : start + len(values)]
            start += width
        part = part[:-width] + part[width:]
        width *= 2
    return total


def window_counts(sizes: np.ndarray) -> np.ndarray:
    """Windows of texts of so many words: one from each word on that has enough after it, one for a shorter text."""
    return np.maximum(sizes - WINDOW + 1, 1)


def fit(texts: list[str], labels: np.ndarray, share: float, epochs: int = 8, batch: int = 128, rate: float = 0.02, seed: int = 7) -> Network:
    """A network from whole labelled texts; ``share``: how large a part of all labelled rows is toxic.

    Labels belong to texts, not to windows: a toxic text gives the window in which its words (later, the network) see most evidence, any
    other text gives its window of most evidence and one at random.
    """
    rng = np.random.default_rng(seed)
    lists = [words_of(t) for t in texts]
    seen: dict[str, list[int]] = {}
    for words, y in zip(lists, labels):
        for w in set(words):
            seen.setdefault(w, [0, 0])[int(y)] += 1
    vocabulary = {w: k for k, w in enumerate(sorted(w for w, n in seen.items() if sum(n) >= 3))}
    n1, n0 = max(labels.sum(), 1), max((1 - labels).sum(), 1)
    evidence = np.zeros(len(vocabulary) + 1)
    for w, k in vocabulary.items():
        evidence[k] = np.log((seen[w][1] + 0.5) / (n1 + 1)) - np.log((seen[w][0] + 0.5) / (n0 + 1))
    net = Network(vocabulary, (evidence / 3).clip(-1, 2), seed)
    known = {w: max(0.0, evidence[k] - 1) for w, k in vocabulary.items()}
    counts = window_counts(np.array([len(w) for w in lists], np.int64))
    values = [sliding(np.array([known.get(w, 0.0) for w in words]))[:n] for words, n in zip(lists, counts)]
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.w.items()}
    step = 0
    for epoch in range(epochs):
        if epoch == epochs // 2:
            values = window_logits(net, lists)
        chosen = []
        for words, n, value, y in zip(lists, counts, values, labels):
            if words:
                top = int(np.argmax(value))
                chosen += [(words, s, y) for s in ([top] if y else [top, int(rng.integers(n))])]
        order = rng.permutation(len(chosen))
        for lo in range(0, len(order), batch):
            part = [chosen[k] for k in order[lo : lo + batch]]
            froms = [max(s - CONTEXT, 0) for _, s, _ in part]
            spans = [ws[a : s + WINDOW + CONTEXT] for a, (ws, s, _) in zip(froms, part)]
            bounds = [(s - a, min(s + WINDOW, len(ws)) - a) for a, (ws, s, _) in zip(froms, part)]
            _, gradient = net.gradient(spans, bounds, np.array([y for *_, y in part], np.float32), np.ones(len(part), np.float32))
            step += 1
            for k, g in gradient.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                net.w[k] -= (rate * (0.3 if epoch >= epochs // 2 else 1) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    best = np.array([v.max() for v in window_logits(net, lists)])
    _calibrate(net, best, counts, labels, share)
    return net


def window_logits(net: Network, lists: list[list[str]]) -> list[np.ndarray]:
    flat = list(dict.fromkeys(chain.from_iterable(lists)))
    number = {w: k for k, w in enumerate(flat)}
    table = np.concatenate([net.project(flat), np.zeros((1, 6 * _HIDDEN), np.float32)])
    words = np.fromiter((number[w] for ws in lists for w in ws), np.int64)
    out, counts = _text_logits(net, table, words, np.array([len(ws) for ws in lists], np.int64), len(flat))
    return np.split(out, np.cumsum(counts)[:-1])


def _text_logits(net: Network, table: np.ndarray, words: np.ndarray, sizes: np.ndarray, nothing: int, most: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Logits of all windows of each text, and their number; words: rows of ``table``, one text after another. Row ``nothing`` is zero."""
    blocks = -(-sizes // BLOCK)
    of = np.repeat(np.arange(len(sizes)), blocks)
    begin = (np.cumsum(sizes) - sizes)[of]
    stop = begin + sizes[of]
    core = begin + (np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * BLOCK
    weight, value = np.zeros(len(words)), np.zeros(len(words))
    step = np.arange(-CONTEXT, BLOCK + CONTEXT)[:, None]
    for lo in range(0, len(of), most):
        at = core[lo : lo + most] + step
        mask = (at >= begin[lo : lo + most]) & (at < stop[lo : lo + most])
        ids = np.where(mask, words[np.clip(at, 0, len(words) - 1)], nothing)
        own = net.states(table[ids], mask.astype(np.float32))[CONTEXT : CONTEXT + BLOCK]
        inner = mask[CONTEXT : CONTEXT + BLOCK]
        places = at[CONTEXT : CONTEXT + BLOCK][inner]
        weight[places] = np.exp((own @ net.w["attend"])[inner].astype(np.float64).clip(-60, 60))
        value[places] = (own @ net.w["out"])[inner]
    # every text with room for a whole window, so that none reaches into the next one
    counts, room = window_counts(sizes), np.maximum(sizes, WINDOW)
    to = np.repeat(np.cumsum(room) - room - np.cumsum(sizes) + sizes, sizes) + np.arange(len(words))
    spread = np.zeros((2, int(room.sum())))
    spread[0, to], spread[1, to] = weight, weight * value
    total = sliding(spread[0])
    logits = np.where(total > 0, sliding(spread[1]) / np.where(total > 0, total, 1), 0) + net.w["bias"]
    first = np.repeat(np.cumsum(room) - room - np.cumsum(counts) + counts, counts)
    return logits[first + np.arange(counts.sum())], counts


def _calibrate(net: Network, best: np.ndarray, windows: np.ndarray, labels: np.ndarray, share: float) -> None:
    """Logistic regression of labels on the maximum and the number of windows, weighted to the true share of toxic rows."""
    n1 = labels.mean() if len(labels) else 0.5
    weight = np.where(labels == 1, share / max(n1, 1e-9), (1 - share) / max(1 - n1, 1e-9))
    x = np.column_stack([best.clip(-12, 12), np.log(np.maximum(windows, 1)), np.ones(len(best))]).astype(np.float64)
    beta = np.array([1.0, 0.0, 0.0])
    for _ in range(25):
        p = _sigmoid(x @ beta)
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([0.1, 1.0, 0.01])
        beta = beta + np.linalg.solve(hessian, x.T @ (weight * (labels - p)) - np.array([0.1 * (beta[0] - 1), 1.0 * beta[1], 0.01 * beta[2]]))
    net.scale, net.length_weight, net.shift = beta


def train(docs: DataFrame, labels: DataFrame, per_label: int = 1200) -> Network | None:
    """A network from labelled rows (doc_id, toxic) and their texts; None if a label has no rows.

    At most about ``per_label`` toxic and twice as many other texts are taken whole, by a hash of doc_id.
    """
    labels = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    counts = dict(labels.groupBy("toxic").count().collect())
    if not counts.get(0) or not counts.get(1):
        return None
    part = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_000)) / 1_000_000
    taken = labels.filter(part < F.when(F.col("toxic") == 1, F.lit(per_label / counts[1])).otherwise(F.lit(2 * per_label / counts[0])))
    rows = docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(taken), "doc_id").select(F.col("doc_id").cast("string").alias("k"), "text", "toxic").toArrow()  # taken is bounded by per_label
    order = np.argsort(np.array([k + t[:64] for k, t in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist())], object), kind="stable")
    texts, toxic = rows.column(1).to_pylist(), np.array(rows.column(2).to_pylist(), np.int64)
    if len(set(toxic.tolist())) < 2:
        return None
    return fit([texts[k] for k in order], toxic[order], counts[1] / (counts[0] + counts[1]))


class _Scorer:
    def __init__(self, net: Network, cap: int) -> None:
        self.net, self.cap = net, cap
        self.clear()

    def clear(self) -> None:
        """Rows of distinct words (row 0: none); runs between white space as numbers of row lists, held one after another."""
        self.words: dict[str, int] = {"": 0}
        self.runs: dict[str, int] = {}
        self.table = np.zeros((1024, 6 * _HIDDEN), np.float32)
        self.rows, self.begin = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def learn(self, new: list[str]) -> None:
        parts = [words_of(c) for c in new]
        fresh_words = [w for w in dict.fromkeys(chain.from_iterable(parts)) if w not in self.words]
        base = len(self.words)
        while base + len(fresh_words) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        if fresh_words:
            self.table[base : base + len(fresh_words)] = self.net.project(fresh_words)
            self.words.update(zip(fresh_words, range(base, base + len(fresh_words))))
        self.runs.update(zip(new, range(len(self.runs), len(self.runs) + len(new))))
        self.rows = np.concatenate([self.rows, np.fromiter(map(self.words.__getitem__, chain.from_iterable(parts)), np.int64)])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum([len(p) for p in parts])])

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The highest logit of each text's windows, and their number."""
        if len(self.words) > self.cap or len(self.runs) > 2 * self.cap:
            self.clear()
        lists = [(t or "").split() for t in texts]
        flat = list(chain.from_iterable(lists))
        new = [c for c in set(flat) if c not in self.runs]
        if new:
            self.learn(new)
        runs = np.fromiter(map(self.runs.__getitem__, flat), np.int64, len(flat))
        n = self.begin[runs + 1] - self.begin[runs]
        rows = self.rows[np.repeat(self.begin[runs] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        total = np.concatenate([[0], np.cumsum(n)])
        ends = np.cumsum([len(ws) for ws in lists])
        sizes = total[ends] - total[ends - [len(ws) for ws in lists]]
        logits, counts = _text_logits(self.net, self.table, rows, sizes, 0)
        return np.maximum.reduceat(logits, np.cumsum(counts) - counts), counts


_KEPT: list = [None, None]


def _scorer(net: Network, cap: int) -> _Scorer:
    if _KEPT[0] is not net:
        _KEPT[:] = [net, _Scorer(net, cap)]
    return _KEPT[1]


def score_texts(docs: DataFrame, net: Network | None, keep: tuple[str, ...] = ("doc_id",), memo: int = 200_000, step_bytes: int = 1 << 20) -> DataFrame:
    """Columns ``keep``, score (0 to 1) and n_windows of every whole text.

    Null and empty texts are one empty window, whose score is that of a text without evidence. Without a network every score is 0.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    shared, names = spark.sparkContext.broadcast(net), [*keep, "score", "n_windows"]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            texts, scores, counts = batch.column(len(keep)).to_pylist(), [np.zeros(0)], [np.zeros(0, np.int64)]
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") <= step_bytes):
                    size += len(texts[hi] or "")
                    hi += 1
                best, n = _scorer(net, memo).score(texts[lo:hi]) if net else (np.zeros(hi - lo), np.ones(hi - lo, np.int64))
                scores.append(net.calibrated(best, n) if net else best)
                counts.append(n)
                lo = hi
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(np.concatenate(scores).astype(np.float64)), pa.array(np.concatenate(counts).astype(np.int64))], names)

    kept = [f"`{c}`" for c in keep]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)
    return docs.select(*kept, F.col("text").alias(fresh(docs, "text_of"))).mapInArrow(predict, f"{types}, score double, n_windows long")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    net = train(docs, labels.filter(crc_mod("doc_id", 5) != 0))
    found = score_texts(docs, net)
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_windows")
