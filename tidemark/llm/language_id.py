"""Language identification by interpolated Kneser-Ney character models.

The n-grams of all languages are held in one sorted array of 64-bit hashes for each order; beside it stand, for each language, the
interpolated probability of the n-gram and the weight that its context leaves to lower orders. A word is scored with the white space
around it and nothing further, so each distinct run between white space is scored once and documents add up their runs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows, crc_mod, fresh, stored

UNKNOWN = "und"
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Characters that a score's confidence counts at most: more text doesn't make a close call certain.
CONFIDENT_CHARS = 50
#: Rows held aside that a language's own mean and variance need.
LEAST_ASIDE = 5


def words_of(chunk: str) -> list[str]:
    return _WORD.findall(chunk.lower())


def _code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of " word " for all words, each place's number within its word, and the words' lengths."""
    padded = [f" {w} " for w in words]
    points = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(p) for p in padded], np.int64)
    return points, np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes), sizes


def _hashes(points: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1 .. order the hash of the n characters that end at each place (of use from place n - 1 of a word on)."""
    mixed = (points + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(31)
    out, total, factor = [], mixed.copy(), np.uint64(1)
    with np.errstate(over="ignore"):
        for n in range(order):
            if n:
                factor *= _BASE
                total[n:] = total[n:] + mixed[:-n] * factor
            out.append(total.copy())
    return out


class Model:
    """Kneser-Ney models of several languages. ``grams``: language, n-gram, count (order 1 to ``order``, words padded with spaces)."""

    def __init__(self, languages: list[str], grams: list[tuple[str, str, int]], order: int, alphabet: int | None = None) -> None:
        self.languages, self.order = languages, order
        number = {g: k for k, g in enumerate(languages)}
        by_order: list[dict[str, np.ndarray]] = [{} for _ in range(order + 1)]
        for language, gram, n in grams:
            row = by_order[len(gram)].get(gram)
            if row is None:
                row = by_order[len(gram)][gram] = np.zeros(len(languages))
            row[number[language]] = n
        self.alphabet = alphabet or len(by_order[1]) + 1
        size = len(languages)
        self.keys, self.chances, self.rests = [], [], []
        lower_p, lower_at = None, {}
        for k in range(1, order + 1):
            names = list(by_order[k])
            counts = np.array([by_order[k][g] for g in names]).reshape(-1, size)
            at = {g: i for i, g in enumerate(names)}
            if k < order:  # below the highest order: in how many contexts, but for what begins a word
                kinds = np.zeros_like(counts)
                longer = list(by_order[k + 1])
                if longer:
                    np.add.at(kinds, [at[g[1:]] for g in longer], np.array([by_order[k + 1][g] for g in longer]) > 0)
                begins = np.array([g[0] == " " and k > 1 for g in names], bool)
                counts = np.where(begins[:, None], counts, kinds)
            one, two = (counts == 1).sum(0), (counts == 2).sum(0)
            discount = np.where(one > 0, one / np.maximum(one + 2 * two, 1), 0.5).clip(0.1, 0.9)
            contexts = {c: i for i, c in enumerate(dict.fromkeys(g[:-1] for g in names))}
            of = np.array([contexts[g[:-1]] for g in names], np.int64)
            total, kinds = np.zeros((len(contexts), size)), np.zeros((len(contexts), size))
            np.add.at(total, of, counts)
            np.add.at(kinds, of, counts > 0)
            rest = np.where(total > 0, discount * kinds / np.maximum(total, 1e-9), 1.0)
            under = np.full((len(names), size), 1 / self.alphabet) if k == 1 else lower_p[[lower_at[g[1:]] for g in names]].reshape(-1, size)
            p = np.maximum(counts - discount, 0) / np.maximum(total, 1e-9)[of] + rest[of] * under
            lower_p, lower_at = p, at
            self._keep(names, p, list(contexts), rest)

    def _keep(self, names: list[str], p: np.ndarray, contexts: list[str], rest: np.ndarray) -> None:
        def key(texts: list[str]) -> np.ndarray:
            n = len(texts[0])
            points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
            return _hashes(points, n)[n - 1][n - 1 :: n] if n else np.zeros(1, np.uint64)

        for texts, values, keep in ((names, np.log(p), self.chances), (contexts, np.log(rest), self.rests)):
            hashes = key(texts) if texts else np.zeros(0, np.uint64)
            order = np.argsort(hashes)
            keep.append((hashes[order], values[order].astype(np.float32)))

    @staticmethod
    def _find(table: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
        return at, table[at] == hashes

    def steps(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability by language of each character of " word ", one word after another (0 for the first space), and the words' lengths."""
        points, inside, sizes = _code_points(words)
        hashes = _hashes(points, self.order)
        total = np.zeros((len(points), len(self.languages)), np.float32)
        open_ = np.flatnonzero(inside > 0)
        for k in range(self.order, 0, -1):
            at = open_[inside[open_] >= k - 1]
            row, found = self._find(self.chances[k - 1][0], hashes[k - 1][at])
            total[at[found]] += self.chances[k - 1][1][row[found]]
            miss = at[~found]
            if k > 1:
                row, known = self._find(self.rests[k - 1][0], hashes[k - 2][miss - 1])
                total[miss[known]] += self.rests[k - 1][1][row[known]]
            else:
                total[miss] += self.rests[0][1][0] - np.float32(np.log(self.alphabet))
            done = np.zeros(len(points), bool)
            done[at[found]] = True
            open_ = open_[~done[open_]]
        total[inside == 0] = 0
        return total, sizes

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each word (and its end) by language, and its number of characters with the end."""
        if not words:
            return np.zeros((0, len(self.languages)), np.float32), np.zeros(0, np.int64)
        total, sizes = self.steps(words)
        return np.add.reduceat(total, np.cumsum(sizes) - sizes, axis=0), sizes - 1


class Identifier:
    """Models of groups of languages, side by side, and what rejection needs: a mean and variance for each language, and the bound for all.

    ``bound``: how many deviations above its language's mean a text's cross-entropy may be (deviations of short texts are wider).
    """

    def __init__(self, models: list[Model]) -> None:
        self.models, self.languages, self.alphabet = models, [g for m in models for g in m.languages], models[0].alphabet
        size = len(self.languages)
        # without rows held aside: half way to what random characters cost
        self.mean, self.var, self.bound = np.full(size, (1.0 + np.log(self.alphabet)) / 2), np.full(size, 0.25), 8.0

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [m.score(words) for m in self.models]
        return np.concatenate([f[0] for f in found], axis=1), found[0][1]

    def deviations(self, language: np.ndarray, cost: np.ndarray, letters: np.ndarray) -> np.ndarray:
        return (cost - self.mean[language]) / np.sqrt(self.var[language] * (1 + 100 / np.maximum(letters, 1)))

    def calibrate(self, language: np.ndarray, cost: np.ndarray, letters: np.ndarray, false_reject: float) -> None:
        """Means, variances and the bound from rows held aside: language (number), cross-entropy, letters.

        The bound is the deviation that a share ``false_reject`` of such texts exceeds: above the 90th percentile of all languages' deviations a
        generalised Pareto tail is fitted by its moments, as the share may be far below one row.
        """
        for k in range(len(self.languages)):
            own = cost[language == k]
            if len(own) >= LEAST_ASIDE:
                self.mean[k], self.var[k] = own.mean(), max(own.var(), 1e-6)
        z = self.deviations(language, cost, letters)[np.isin(language, np.flatnonzero(np.bincount(language, minlength=len(self.languages)) >= LEAST_ASIDE))]
        if len(z) >= 10 * LEAST_ASIDE:
            start = np.quantile(z, 0.9)
            excess = z[z > start] - start
            ratio = excess.mean() ** 2 / max(excess.var(), 1e-12)
            shape, scale = max(0.5 * (1 - ratio), 1e-3), 0.5 * excess.mean() * (1 + ratio)
            self.bound = float(max(start + scale / shape * ((0.1 / false_reject) ** shape - 1), z.max()))


class _Memo:
    """Scores of distinct runs between white space; forgotten when there are too many."""

    def __init__(self, model: Identifier, cap: int) -> None:
        self.model, self.cap = model, cap
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.model.languages) + 1), np.float64)

    def rows(self, chunks: list[str]) -> np.ndarray:
        if len(self.at) > self.cap:
            self.clear()
        new = [c for c in set(chunks) if c not in self.at]
        if new:
            lists = [words_of(c) for c in new]
            flat = list(dict.fromkeys(chain.from_iterable(lists)))
            number = {w: k for k, w in enumerate(flat)}
            scores, sizes = self.model.score(flat)
            both = np.concatenate([np.column_stack([scores, sizes]), np.zeros((1, len(self.model.languages) + 1))])
            index = np.array([number[w] for ws in lists for w in (ws or [None]) if w is not None] or [], np.int64)
            of = np.repeat(np.arange(len(new)), [len(x) for x in lists])
            sums = np.zeros((len(new), both.shape[1]))
            np.add.at(sums, of, both[index])
            base = len(self.at)
            while base + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[base : base + len(new)] = sums
            self.at.update(zip(new, range(base, base + len(new))))
        return np.fromiter(map(self.at.__getitem__, chunks), np.int64, len(chunks))

    def texts(self, texts: list[str | None]) -> np.ndarray:
        """Sums over each text: log probability by language, characters."""
        lists = [(t or "").split() for t in texts]
        at = self.rows(list(chain.from_iterable(lists)))
        sizes = np.array([len(x) for x in lists])
        out = np.zeros((len(texts), len(self.model.languages) + 1))
        full = np.flatnonzero(sizes)
        if len(full):
            out[full] = np.add.reduceat(self.table[at], (np.cumsum(sizes) - sizes)[full], axis=0)
        return out


_KEPT: list = [None, None]


def _memo(model: Identifier, cap: int) -> _Memo:
    """One for each worker process, of the last model."""
    if _KEPT[0] is not model:
        _KEPT[:] = [model, _Memo(model, cap)]
    return _KEPT[1]


def _grams_of(sample: DataFrame, order: int) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        for batch in batches:
            for text, language in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words.setdefault(language, Counter()).update(words_of(text or ""))
        for language, frequencies in words.items():
            grams = Counter()
            for word, n in frequencies.items():
                padded = f" {word} "
                for stop in range(2, len(padded) + 1):
                    for k in range(1, min(order, stop) + 1):
                        grams[padded[stop - k : stop]] += n
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(grams), pa.string()), pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], ["lang", "gram", "n"])

    return sample.select("text", "lang").mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame, order: int = 5, per_language: int = 1000, most_rows: int = 64_000, group: int = 32, false_reject: float = 1e-4) -> Identifier | None:
    """Models from rows doc_id, text, lang; None if no row has a lang.

    About ``per_language`` whole texts of each language are taken, by a hash of doc_id, and fewer (20 at least) where languages are so many that these
    would be more than ``most_rows``. Of a language with 25 rows or more, four in five are counted (in Spark) and the others are held aside to
    calibrate rejection to a share of ``false_reject`` of a language's own texts. ``group`` languages at a time make one model in the driver.
    """
    labelled = labelled.select("doc_id", "text", "lang").filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = dict(labelled.groupBy("lang").count().collect())
    if not sizes:
        return None
    most = min(per_language, max(20, most_rows // len(sizes)))
    spark = labelled.sparkSession
    shares = spark.createDataFrame([(k, min(1.0, most / n), min(most, n) >= 5 * LEAST_ASIDE) for k, n in sizes.items()], "lang string, share double, aside boolean")
    part = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_000)) / 1_000_000
    sample = labelled.join(F.broadcast(shares), "lang").withColumn("part", part / F.col("share")).filter("part < 1")  # shares: a row for each language
    aside = F.col("aside") & (F.col("part") < 0.2)
    grams = stored(_grams_of(sample.filter(~F.coalesce(aside, F.lit(False))), order), "language-grams")
    languages = sorted(r[0] for r in grams.select("lang").distinct().collect())
    if not languages:
        return None
    alphabet = grams.filter(F.char_length("gram") == 1).select("gram").distinct().count() + 1
    models = []
    for k in range(0, len(languages), group):
        rows = grams.filter(F.col("lang").isin(languages[k : k + group])).toArrow()  # bounded: per_language texts of each
        models.append(Model(languages[k : k + group], list(zip(*(c.to_pylist() for c in rows.columns))), order, alphabet))
    found = Identifier(models)
    own = score_texts(sample.filter(aside).select("doc_id", "text", "lang"), found, keep=("lang",)).filter("lang_pred = lang")
    own = own.select("lang_pred", "cross_entropy", "n_letters").toPandas()  # a fifth of the sample, numbers alone
    number = {g: k for k, g in enumerate(found.languages)}
    found.calibrate(own["lang_pred"].map(number).to_numpy(np.int64), own["cross_entropy"].to_numpy(np.float64), own["n_letters"].to_numpy(np.float64), false_reject)
    return found


def score_texts(docs: DataFrame, model: Identifier | None, keep: tuple[str, ...] = ("doc_id",), memo: int = 300_000) -> DataFrame:
    """Columns ``keep`` and lang_pred, score (confidence, 0 to 1), cross_entropy (nats a letter), n_letters, accepted.

    A text is accepted if its cross-entropy is within the calibrated bound of what its language's texts have. Null texts, texts without a letter, and
    all texts if there is no model: ``und``, score 0, not accepted. Ties: the first by name. Repeated rows stay, whole texts count however long, and
    an empty table gives no rows. Columns of ``keep`` may not have the names of the new ones.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    text = fresh(docs, "text_of")
    shared = spark.sparkContext.broadcast(model)
    names = [*keep, "lang_pred", "score", "cross_entropy", "n_letters", "accepted"]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        memo_of = _memo(model, memo) if model else None
        for batch in batches:
            n = batch.num_rows
            if model is None or not n:
                new = [pa.array([UNKNOWN] * n, pa.string()), pa.array([0.0] * n, pa.float64()), pa.array([None] * n, pa.float64()), pa.array([0] * n, pa.int64()), pa.array([False] * n, pa.bool_())]
            else:
                sums = memo_of.texts(batch.column(len(keep)).to_pylist())
                letters = sums[:, -1]
                cost = -sums[:, :-1] / np.maximum(letters, 1)[:, None]
                best = cost.argmin(axis=1)
                least = cost[np.arange(n), best]
                sure = 1 / np.exp((least[:, None] - cost) * np.minimum(letters, CONFIDENT_CHARS)[:, None]).sum(axis=1)
                far = model.deviations(best, least, letters)
                known = letters > 0
                new = [
                    pa.array([model.languages[b] if k else UNKNOWN for b, k in zip(best, known)], pa.string()), pa.array(np.where(known, sure, 0.0)),
                    pa.array(least, mask=~known), pa.array(letters.astype(np.int64)), pa.array(known & (far <= model.bound)),
                ]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *new], names)

    source = docs.select(*[f"`{c}`" for c in keep], F.col("text").alias(text))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[f"`{c}`" for c in keep]).schema)
    return source.mapInArrow(predict, f"{types}, lang_pred string, score double, cross_entropy double, n_letters long, accepted boolean")


def learning_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(crc_mod("doc_id", 4) != 2)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = score_texts(docs, train(learning_rows(docs)))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted")


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents whose language is accepted, with their own columns. (Columns that score_texts adds may clash: they're put aside.)"""
    model = train(learning_rows(docs))
    names = [f"c{k}" for k in range(len(docs.columns))]
    renamed = docs.toDF(*names)
    text = names[[c.lower() for c in docs.columns].index("text")]
    found = score_texts(renamed.withColumn("text", F.col(text)), model, keep=tuple(names))
    return found.filter("accepted").select(*[F.col(a).alias(b) for a, b in zip(names, docs.columns)])
