"""Mixing sources to target weights by iterative proportional fitting.

Kept tokens are raked to source, language and topic marginals, under the cap that no document is kept more than once: a cell keeps its tokens times
``least(1, a * b * c)``, with a factor for each of its source, language and topic. Documents are then sampled by these probabilities. First each
marginal is made reachable: what a target asks for beyond all tokens that there are goes to the others in proportion. Then each round solves
every source's factor exactly, in one Spark job that adds up the (language, topic) table; from that table the driver scales the other two
factors. Sources may be many and stay a table; languages times topics are held in the driver as numbers.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import Generations, arrow_rows, fresh, hot_join, hot_split, stored

TOPICS, NONE = 8, "(none)"
#: Longer runs are worked on each time, so the memo stays small.
MEMO_CHARS = 64
_WORD = regex.compile(r"\p{L}{4,}")


def _words(run: str) -> tuple[str, ...]:
    return tuple(_WORD.findall(run.lower()))


def _topic(text: str, topics: int, memo: Generations) -> tuple[int, int]:
    """Tokens (runs between white space) and topic of a text: the class of its most frequent word of four letters or more, case apart; ties by name."""
    counts = Counter(text.split())
    words = memo.fill([run for run in counts if len(run) <= MEMO_CHARS], lambda runs: map(_words, runs))
    best: dict[str, int] = {}
    for run, n in counts.items():
        for w in words[run] if len(run) <= MEMO_CHARS else _words(run):
            best[w] = best.get(w, 0) + n
    if not best:
        return counts.total(), 0
    most = max(best.values())
    return counts.total(), zlib.crc32(min(w for w, n in best.items() if n == most).encode("utf-8", "replace")) % topics


def with_weights(docs: DataFrame, out: str, topics: int = TOPICS, keep: list[str] | None = None, topic: str | None = None) -> DataFrame:
    """Columns ``keep`` (or all) of ``docs`` (source, lang, text) and a struct ``out``: source, lang, topic, tokens. Null source, lang: ``(none)``."""
    arrow_rows(docs.sparkSession)
    kept = docs.columns if keep is None else keep
    names = [f"c{k}" for k in range(len(kept))]
    lower = [c.lower() for c in docs.columns]
    column = {c: docs.columns[lower.index(c)] for c in ("source", "lang", "text")}
    struct = T.StructType([T.StructField(c, k) for c, k in (("source", T.StringType()), ("lang", T.StringType()), ("topic", T.IntegerType()), ("tokens", T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Generations()
        for batch in batches:
            source, lang = ([NONE if x is None else x for x in batch.column(len(names) + k).to_pylist()] for k in (0, 1))
            found = [_topic(t or "", topics, memo) for t in batch.column(len(names) + 2).to_pylist()]
            given = [-1 if t is None else t for t in batch.column(len(names) + 3).to_pylist()] if topic else [t for _, t in found]
            added = pa.StructArray.from_arrays([pa.array(source, pa.string()), pa.array(lang, pa.string()), pa.array(given, pa.int32()), pa.array([n for n, _ in found], pa.int64())], ["source", "lang", "topic", "tokens"])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], added], [*names, "added"])

    own = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names)], *[F.col(f"`{column[c]}`").cast("string").alias(f"own_{c}") for c in ("source", "lang", "text")], *([F.col(topic).cast("int").alias("own_topic")] if topic else []))
    found = own.mapInArrow(run, T.StructType([*own.schema.fields[: len(names)], T.StructField("added", struct)]))
    return found.toDF(*kept, out)


def targets_of(tokens: dict, target: float | dict) -> dict:
    """Target shares of the names that have tokens: given ones, or in proportion to a power of the tokens (below 1 it lifts what is rare)."""
    wanted = {k: max(0.0, float(target.get(k, 0.0))) if isinstance(target, dict) else float(v) ** target for k, v in tokens.items() if v > 0}
    total = sum(wanted.values())
    return {k: v / total if total else 0.0 for k, v in wanted.items()}


def reachable(tokens: np.ndarray, target: np.ndarray, budget: float) -> np.ndarray:
    """Of each name least(its tokens, m * its target), with m such that they add up to ``budget`` (or to all that targets allow)."""
    out, free, left = np.zeros(len(tokens)), target > 0, budget
    while free.any() and left > 0:
        share = target * free / (target * free).sum() * left
        full = free & (share >= tokens)
        if not full.any():
            return np.where(free, share, out)
        out[full], free = tokens[full], free & ~full
        left = budget - out.sum()
    return out


def source_factor(tokens: np.ndarray, ratio: np.ndarray, wanted: float) -> float:
    """The a for which tokens * least(1, a * ratio) add up to ``wanted``; if they can't, the least that keeps all with a ratio."""
    order = np.argsort(-ratio, kind="stable")
    tokens, ratio = tokens[order].astype(np.float64), ratio[order]
    some = int((ratio > 0).sum())
    if not some or wanted <= 0:
        return 0.0
    tokens, ratio = tokens[:some], ratio[:some]
    full = np.concatenate([[0.0], np.cumsum(tokens)])
    if wanted >= full[-1]:
        return float(1 / ratio[-1])
    rest = np.cumsum((tokens * ratio)[::-1])[::-1]
    a = (wanted - full[:-1]) / rest
    # so many are capped: the first number whose next cell is not
    return float(a[int(np.argmax(a * ratio <= 1))])


@dataclass
class Mix:
    """Factors and marginals. sources: source, tokens, wanted (kept tokens asked for), a; langs and topics: name -> (factor, tokens, target, kept tokens asked for)."""

    sources: DataFrame
    langs: dict[str, tuple[float, float, float, float]]
    topics: dict[int, tuple[float, float, float, float]]
    apart: list[float]


def rake(cells: DataFrame, budget: float, source_target: float | dict, lang_target: float | dict, topic_target: float | dict, tolerance: float = 1e-4, rounds: int = 40) -> Mix:
    """Factors by which kept tokens add up to the reachable targets of sources, languages and topics.

    cells: source, lang, topic, tokens (positive). Sources are met exactly; ``apart`` lists how far languages and topics were in each round, as a
    part of the budget. It ends below ``tolerance``, or where the marginals exclude each other and come no nearer.
    """
    spark = cells.sparkSession
    have = [dict(cells.groupBy(k).agg(F.sum("tokens")).collect()) for k in ("lang", "topic")]
    goals = [targets_of(h, t) for h, t in zip(have, (lang_target, topic_target))]
    names = [sorted(g) for g in goals]
    tokens, target = ([np.array([float(d[k]) for k in n]) for d, n in zip(ds, names)] for ds in (have, goals))
    by_source = cells.groupBy("source").agg(F.collect_list(F.struct("lang", "topic", "tokens")).alias("cells"), F.sum("tokens").alias("tokens"))
    if isinstance(source_target, dict):
        given = spark.createDataFrame([(k, float(v)) for k, v in source_target.items()], "source string, target double")
        by_source = by_source.join(given, "source", "left").withColumn("target", F.greatest(F.coalesce("target", F.lit(0.0)), F.lit(0.0)))
    else:
        by_source = by_source.withColumn("target", F.pow(F.col("tokens").cast("double"), F.lit(float(source_target))))
    by_source = stored(by_source, "mix-sources")
    allowed = by_source.filter("target > 0").agg(F.sum("tokens")).first()[0] or 0
    budget = min(budget, float(allowed), *(float(t[g > 0].sum()) for t, g in zip(tokens, target)))
    m = calibrate(by_source, budget)
    by_source = by_source.withColumn("wanted", F.least(F.col("tokens").cast("double"), F.col("target") * m))
    wanted = [reachable(t, g, budget) for t, g in zip(tokens, target)]
    at = [{k: i for i, k in enumerate(n)} for n in names]
    size = (len(names[0]), len(names[1]))

    def solved(factors: list[np.ndarray]):
        """A function of one source's cells and kept tokens: its factor, and the places of its cells, their tokens and ratios."""

        def one(rows: list[dict], want: float):
            i, j = (np.array([at[d][r[k]] for r in rows], np.int64) for d, k in enumerate(("lang", "topic")))
            t, ratio = np.array([r["tokens"] for r in rows], np.float64), factors[0][i] * factors[1][j]
            return source_factor(t, ratio, want), i, j, t, ratio

        return one

    def add_up(factors: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Kept tokens by language and topic: of cells below the cap, and of those at it."""
        one = solved(factors)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((2, *size))
            for batch in batches:
                for rows, want in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    a, i, j, t, ratio = one(rows, want)
                    capped = (a * ratio >= 1).astype(np.int64)
                    np.add.at(sums, (capped, i, j), t * np.minimum(1, a * ratio))
            k, i, j = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k, i, j, sums[k, i, j])], ["k", "i", "j", "kept"])

        table = np.zeros((2, *size))
        for k, i, j, kept in by_source.select("cells", "wanted").mapInArrow(run, "k long, i long, j long, kept double").groupBy("k", "i", "j").agg(F.sum("kept")).collect():
            table[k, i, j] = kept
        return table[0], table[1]

    factors, best, apart = [np.ones(n) for n in size], None, []
    for _ in range(rounds):
        free, full = add_up(factors)
        off = max(abs((free + full).sum(1 - d) - wanted[d]).max(initial=0.0) for d in (0, 1)) / max(budget, 1e-9)
        if not apart or off < min(apart):
            best = [f.copy() for f in factors]
        apart.append(off)
        if off < tolerance or len(apart) > 8 and min(apart[-4:]) > 0.9 * min(apart[:-4]):
            break
        scaled = free.copy()
        for _ in range(30):
            for d in (0, 1):
                now, fixed = scaled.sum(1 - d), full.sum(1 - d)
                by = np.where(wanted[d] > fixed, (wanted[d] - fixed) / np.maximum(now, 1e-300), wanted[d] / np.maximum(now + fixed, 1e-300))
                by = np.where(now > 0, by, np.where(wanted[d] < fixed * (1 - 1e-9), wanted[d] / np.maximum(fixed, 1e-300), 1.0)).clip(0.1, 10)
                by = np.where(wanted[d] > 0, by, 0.0)
                factors[d] = factors[d] * by
                scaled = scaled * (by[:, None] if d == 0 else by)
        # the sources' factors take up any common one; where no solution exists, factors must not run away
        factors = [np.where(w > 0, np.maximum(f / max(f.max(initial=0.0), 1e-300), 1e-9), 0.0) for f, w in zip(factors, wanted)]
    one = solved(best)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = [one(rows, want)[0] for rows, want in zip(batch.column(4).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(a, pa.float64())], ["source", "tokens", "target", "wanted", "a"])

    sources = by_source.select("source", "tokens", "target", "wanted", "cells").mapInArrow(last, "source string, tokens long, target double, wanted double, a double")
    tables = [{k: (float(f[i]), float(t[i]), float(g[i]), float(w[i])) for i, k in enumerate(n)} for n, f, t, g, w in zip(names, best, tokens, target, wanted)]
    return Mix(stored(sources, "mix-factors"), *tables, apart)


def calibrate(sources: DataFrame, budget: float) -> float:
    """The multiple m for which least(tokens, m * target) add up to ``budget``; each pass tries 16 at once."""
    most = sources.agg(F.max(F.when(F.col("target") > 0, F.col("tokens") / F.col("target")))).first()[0]
    if not most:
        return 0.0
    lo, hi = np.log2(most) - 60.0, float(np.log2(most))
    for _ in range(8):
        tries = np.linspace(lo, hi, 16)
        sums = sources.agg(*[F.sum(F.least(F.col("tokens").cast("double"), F.col("target") * float(2.0**t))) for t in tries]).first()
        below = [k for k, s in enumerate(sums) if s < budget]
        if not below or below[-1] == 15:
            return float(2.0 ** (tries[0] if not below else tries[-1]))
        lo, hi = tries[below[-1]], tries[below[-1] + 1]
    return float(2.0**hi)


def _factor(table: dict, column):
    """The factor of each name, as a map."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v[0])]), column), F.lit(0.0))


def mix(
    docs: DataFrame, keep: list[str] | None = None, share: float = 0.8, source_target: float | dict = 0.7, lang_target: float | dict = 0.7, topic_target: float | dict = 0.5,
    seed: int = 42, topics: int = TOPICS, topic: str | None = None,
) -> DataFrame:
    """Columns ``keep`` (doc_id among them; or all) of ``docs`` and a struct ``mix``: source, lang, topic, tokens, weight, probability, kept.

    A target is a dict of shares of kept tokens (names left out get none) or a power of the shares that there are. ``share`` of all tokens is
    expected to stay. ``topic``: an integer column of ``docs`` that holds the topic; without one it is the class (of ``topics``) of a text's most
    frequent word. ``weight`` is the product of the three factors and the probability ``least(1, weight)``. A document stays if a uniform hash of its doc_id is
    below its probability, so repeated rows go together. Texts without tokens have probability 1. A null source or lang is ``(none)``, a null topic -1.
    Ties of words go by name; whole texts count, however long. An empty table gives no rows.
    """
    return _mixed(docs, keep, share, source_target, lang_target, topic_target, seed, topics, topic)[0]


def _mixed(docs, keep, share, source_target, lang_target, topic_target, seed, topics, topic) -> tuple[DataFrame, Mix | None]:
    name = fresh(docs, "mix")
    # texts are read twice if they are kept; else what is left of them is small and read again from a table
    weighed = with_weights(docs, name, topics, topic=topic) if keep is None else stored(with_weights(docs, name, topics, keep, topic), "mix-documents")
    narrow = with_weights(docs, name, topics, [], topic) if keep is None else weighed
    cells = narrow.select(f"{name}.*").groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens")).filter("tokens > 0")
    cells = stored(cells, "mix-cells")
    u = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    rest = [F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]
    total = cells.agg(F.sum("tokens")).first()[0]
    if not total:
        return weighed.select(*rest, F.struct(f"{name}.*", F.lit(None).cast("double").alias("weight"), F.lit(1.0).alias("probability"), F.lit(True).alias("kept")).alias(name)), None
    found = rake(cells, share * total, source_target, lang_target, topic_target)
    a, key = fresh(docs, "factor_of_source"), fresh(docs, "source_key")
    factors = hot_split(found.sources.select(F.col("source").alias(key), F.col("a").alias(a), "tokens"), "tokens")
    joined = hot_join(weighed.withColumn(key, F.col(f"{name}.source")), *factors, key, "left")
    weight = F.col(a) * _factor(found.langs, F.col(f"{name}.lang")) * _factor(found.topics, F.col(f"{name}.topic"))
    p = F.when(F.col(f"{name}.tokens") == 0, 1.0).otherwise(F.least(F.lit(1.0), weight))
    return joined.select(*rest, F.struct(f"{name}.*", weight.alias("weight"), p.alias("probability"), (u < p).alias("kept")).alias(name)), found


def report(docs: DataFrame, share: float = 0.8, source_target: float | dict = 0.7, lang_target: float | dict = 0.7, topic_target: float | dict = 0.5, seed: int = 42, topics: int = TOPICS, topic: str | None = None) -> DataFrame:
    """kind (source, lang, topic), name and shares of tokens: have, target, reachable, expected and kept; target above reachable can't be met."""
    mixed, found = _mixed(docs, ["doc_id"], share, source_target, lang_target, topic_target, seed, topics, topic)
    if found is None:
        return docs.sparkSession.createDataFrame([], "kind string, name string, have double, target double, reachable double, expected double, kept double")
    mixed = stored(mixed.select("mix.*"), "mix-report")
    stays = F.when(F.col("kept"), F.col("tokens")).otherwise(0)
    sums = [mixed.groupBy(F.lit(k).alias("kind"), F.col(k).cast("string").alias("name")).agg(F.sum("tokens").alias("have"), F.sum(F.col("tokens") * F.col("probability")).alias("expected"), F.sum(stays).alias("kept")) for k in ("source", "lang", "topic")]
    small = [(kind, str(k), v[2], v[3]) for kind, table in (("lang", found.langs), ("topic", found.topics)) for k, v in table.items()]
    asked = docs.sparkSession.createDataFrame(small, "kind string, name string, target double, wanted double")
    asked = asked.union(found.sources.select(F.lit("source"), F.col("source"), "target", "wanted"))
    rows = stored(sums[0].union(sums[1]).union(sums[2]).join(asked, ["kind", "name"]), "mix-report")
    whole = rows.groupBy("kind").agg(*[F.sum(c).alias(f"all_{c}") for c in ("have", "target", "wanted", "expected", "kept")])
    part = lambda c: (F.col(c) / F.col(f"all_{c}"))
    return rows.join(F.broadcast(whole), "kind").select("kind", "name", part("have").alias("have"), part("target").alias("target"), part("wanted").alias("reachable"), part("expected").alias("expected"), part("kept").alias("kept"))


def sample(docs: DataFrame, **options) -> DataFrame:
    """The documents that ``mix`` keeps, with their own columns."""
    name = fresh(docs, "mix")
    return mix(docs, **options).filter(f"{name}.kept").drop(name)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text")
    found = mix(docs, keep=["doc_id"])
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "mix.source", "mix.lang", "mix.topic", "mix.tokens", "mix.weight", "mix.probability", "mix.kept")
