"""Divergence of each source's words from the other sources of its language, by an index that is built in a single pass over the texts.

Each task gathers counts by term in memory; once a block holds ``block`` postings it is spilled as a run sorted by term. Spark deals the runs to shards by a
hash of language and term, where its external sort merges them with a heap, and one stream over a shard adds equal terms up to frequencies. A term that
too few documents of a language have is dropped there, as a shard holds all of it.

The divergence of two sources is a sum over all kept terms, but most terms are in few sources. The sum starts as if no term were in either of both;
a histogram of each source's values corrects it for the terms that one has, and a stream over the postings of each term, for those that both have.
All arithmetic is on whole numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows, hot_join, hot_split, stored, text_bytes

#: ASCII letters become lower case, other ASCII bytes become spaces, bytes of further characters stay.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_SCALE = 10**9
_POSTING = "lang string, term string, source string, n long, docs long"
_FREQUENCY = "lang string, term string, source string, n long, total long, first int"


def runs(docs: DataFrame, block: int = 600_000) -> DataFrame:
    """lang, term, source, n (occurrences), docs (documents that have it): sorted runs of blocks of at most ``block`` postings and one text."""
    arrow_rows(docs.sparkSession)

    def spilled(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        keys = sorted(held)
        sizes = [len(held[k][0]) for k in keys]
        lang, source = (np.repeat(np.array([k[i] for k in keys], object), sizes) for i in (0, 1))
        terms = pa.array([t for k in keys for t in held[k][0]], pa.binary()).cast(pa.string())
        n = np.array([n for k in keys for n in held[k][0].values()], np.int64)
        in_docs = np.array([held[k][1][t] for k in keys for t in held[k][0]], np.int64)
        table = pa.table({"lang": pa.array(lang, pa.string()), "term": terms, "source": pa.array(source, pa.string()), "n": n, "docs": in_docs})
        yield from table.take(pc.sort_indices(table, [("lang", "ascending"), ("term", "ascending")])).to_batches(20_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            raw, at = text_bytes(batch.column(2))
            for row, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                words = raw[at[row] : at[row + 1]].tobytes().translate(_WORDS).split()
                if not words:
                    continue
                n, in_docs = held.setdefault(key, (Counter(), Counter()))
                size -= len(n)
                n.update(words)
                in_docs.update(set(words))
                size += len(n)
                if size >= block:
                    yield from spilled(held)
                    held, size = {}, 0
        if size:
            yield from spilled(held)

    return docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")]).mapInArrow(run, _POSTING)


def _changes(*columns: pa.Array) -> np.ndarray:
    """Where a row differs from the one before in any of the columns (null is a value); the first row counts."""
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        same, none = pc.equal(c[1:], c[:-1]), c.is_null().to_numpy(zero_copy_only=False)
        new[1:] |= ~(same.fill_null(False).to_numpy(zero_copy_only=False) | (none[1:] & none[:-1]))
    new[:1] = True
    return new


def _whole_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by lang and term (the first two columns), so that no term is cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch]).combine_chunks()
        last = np.flatnonzero(_changes(*(table.column(k).combine_chunks() for k in (0, 1))))[-1]
        if last:
            yield table.slice(0, last)
        held = table.slice(last).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def frequencies(sorted_runs: DataFrame, least_docs: int = 3) -> DataFrame:
    """lang, term, source, n, total (of the term in the language), first (1 for one row of each term): of terms in ``least_docs`` documents of a language or more.

    A term of very many sources is held whole, one number for each source.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_terms(batches):
            lang, term, source, n, in_docs = (c.combine_chunks() for c in table.columns)
            starts = np.flatnonzero(_changes(lang, term, source))
            rows, sums, in_docs = table.take(pa.array(starts)), np.add.reduceat(n.to_numpy(), starts), np.add.reduceat(in_docs.to_numpy(), starts)
            lang, term, source = (rows.column(k).combine_chunks() for k in range(3))
            firsts = np.flatnonzero(_changes(lang, term))
            sizes = np.diff([*firsts, len(starts)])
            totals, in_docs = np.add.reduceat(sums, firsts), np.add.reduceat(in_docs, firsts)
            at = np.arange(len(starts)) - np.repeat(firsts, sizes)
            kept = np.flatnonzero(np.repeat(in_docs, sizes) >= least_docs)
            out = [c.take(pa.array(kept)) for c in (lang, term, source)]
            yield pa.RecordBatch.from_arrays([*out, pa.array(sums[kept]), pa.array(np.repeat(totals, sizes)[kept]), pa.array((at[kept] == 0).astype(np.int32))], [c.split()[0] for c in _FREQUENCY.split(", ")])

    order = ("lang", "term", "source")
    return sorted_runs.repartition("lang", "term").sortWithinPartitions(*order).mapInArrow(run, _FREQUENCY)


def _share(n: Column, total: Column) -> Column:
    """1 + floor(10**9 * n / total) for n <= total, by three digits to the base 1000, as the product may be more than a long holds."""
    share, rest = F.lit(0).cast("long"), n
    for _ in range(3):
        rest = rest * 1000
        share, rest = share * 1000 + F.call_function("div", rest, total), rest % total
    return share + 1


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corrections for terms that both sources have, summed over the terms of a part of the stream."""
    apart = lambda p, q: (p - q) ** 2 // q
    for table in _whole_terms(batches):
        lang, term, source = (table.column(k).combine_chunks() for k in range(3))
        p, zero = (table.column(k).to_numpy() for k in (3, 4))
        firsts = np.flatnonzero(_changes(lang, term))
        sizes = np.repeat(np.diff([*firsts, len(p)]), np.diff([*firsts, len(p)]))
        begin = np.repeat(firsts, np.diff([*firsts, len(p)]))
        langs, sources = lang.dictionary_encode(), source.dictionary_encode()
        group, many = langs.indices.to_numpy().astype(np.int64), len(sources.dictionary)
        own, ends = sources.indices.to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])
        lo = 0
        while lo < len(p):  # some million pairs at once
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + (1 << 20), "right")) - 1)
            n = sizes[lo:hi]
            a = np.repeat(np.arange(lo, hi), n)
            b = np.repeat(begin[lo:hi] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            a, b = a[a != b], b[a != b]
            if len(a):
                value = apart(p[a], p[b]) - apart(p[a], zero[b]) - apart(zero[a], p[b]) + apart(zero[a], zero[b])
                code = (group[a] * many + own[a]) * many + own[b]
                order = np.argsort(code, kind="stable")
                code, value = code[order], value[order]
                starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
                code, value = code[starts], np.add.reduceat(value, starts)
                columns = [langs.dictionary.take(pa.array(code // many**2)), sources.dictionary.take(pa.array(code // many % many)), sources.dictionary.take(pa.array(code % many)), pa.array(value)]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "item", "value"])
            lo = hi


def divergence(docs: DataFrame, least_docs: int = 3, top: int = 200, block: int = 600_000, few: int = 20_000) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank (int, from 1): how far each source's words are from other sources, and which terms stand out in it.

    Null text, lang and source count as ''. A language without kept terms has its pairs at value 0 and no terms; a language's only source has no pairs. Ties
    are ranked by item. Repeated rows are documents of their own. Only text, lang and source are read, whatever else ``docs`` has. An empty table gives no rows.
    Totals are exact up to 9e15 words. The result has a row for each two sources of a language, so the groups are few beside it; up to ``few`` are broadcast.
    """
    words = stored(frequencies(runs(docs, block), least_docs), "term-frequencies")
    sums = words.groupBy("lang", "source").agg(F.sum("n").alias("words"), F.count("*").alias("terms"))
    langs = words.groupBy("lang").agg(F.sum("first").alias("v"), F.sum("n").alias("lang_words"))
    groups = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    none = F.lit(0).cast("long")
    groups = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", *[F.coalesce(c, none).alias(c) for c in ("words", "terms", "v", "lang_words")])
    groups = groups.withColumn("zero", _share(F.lit(1).cast("long"), F.greatest(F.col("words") + F.col("v"), F.lit(1).cast("long"))))
    groups = stored(groups, "source-totals")
    scored = hot_join(words, *hot_split(groups.withColumn("weight", F.col("terms")), "weight"), ["lang", "source"])
    scored = scored.withColumn("p", _share(F.col("n") + 1, F.col("words") + F.col("v"))).withColumn("q", _share(F.col("total") + 1, F.col("lang_words") + F.col("v")))

    by_group = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = scored.filter("p > q").select("lang", "source", F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(by_group)).filter(F.col("rank") <= top).withColumn("part", F.lit("term"))

    others = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("item_zero"))
    others = F.broadcast(others) if groups.count() <= few else others
    values = scored.groupBy("lang", "source", "zero", "p").agg(F.count("*").alias("m")).join(others, "lang").filter("source <> item")
    p, zero, q = F.col("p"), F.col("zero"), F.col("item_zero")
    base = groups.join(others, "lang").filter("source <> item").select("lang", "source", "item", (F.col("v") * _apart(zero, q)).alias("value"))
    has = values.select("lang", "source", "item", (F.col("m") * (_apart(p, q) - _apart(zero, q))).alias("value"))
    other_has = values.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), (F.col("m") * (_apart(q, p) - _apart(q, zero))).alias("value"))
    met = scored.select("lang", "term", "source", "p", "zero").repartition("lang", "term").sortWithinPartitions("lang", "term")
    both = met.mapInArrow(_both, "lang string, source string, item string, value long")
    pairs = base.union(has).union(other_has).union(both).groupBy("lang", "source", "item").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(by_group)).withColumn("part", F.lit("pair"))
    columns = ["lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank")]
    return pairs.select(*columns).union(terms.select(*columns))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    """The same rows by a dense grid of groups and kept terms."""
    return r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (
    SELECT i, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM d
),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT i) >= 3),
n AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
grid AS (
    SELECT g.lang, g.source, kept.term, coalesce(n.n, 0) AS n, sum(coalesce(n.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total, v.v
    FROM g JOIN kept ON g.lang = kept.lang JOIN v ON v.lang = g.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = kept.term
),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // (total + v)::HUGEINT AS p FROM grid),
whole AS (SELECT lang, term, sum(n) AS n, any_value(v) AS v FROM grid GROUP BY lang, term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 1)::HUGEINT) // (sum(n) OVER (PARTITION BY lang) + v)::HUGEINT AS q FROM whole),
sums AS (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
    FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
),
pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(sums.value, 0) AS BIGINT) AS value
    FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
),
terms AS (
    SELECT p.lang, p.source, 'term' AS part, p.term AS item, CAST(((p.p - q.q) * (p.p - q.q)) // q.q AS BIGINT) AS value
    FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q
)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR rank <= 200
"""
