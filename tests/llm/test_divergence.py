import re
from collections import Counter, defaultdict

import pytest

from tidemark.llm import divergence as D
from tidemark.llm.registry import ORACLE_SQL, QUERIES

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=3, top=200):
    """The definition on a dense grid, in whole numbers of any size."""
    docs, groups, count = defaultdict(Counter), set(), defaultdict(Counter)
    for lang, source, text in ((a or "", b or "", c or "") for a, b, c in rows):
        words = TERM.findall(text.translate(LOWER))
        docs[lang].update(set(words))
        groups.add((lang, source))
        count[lang, source].update(words)
    out = []
    for lang in {g for g, _ in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = [s for g, s in groups if g == lang]
        own = {s: {t: count[lang, s][t] for t in kept} for s in sources}

        def shares(n):
            total = sum(n.values()) + len(kept)
            return {t: 1 + 10**9 * (x + 1) // total for t, x in n.items()}

        p = {s: shares(own[s]) for s in sources}
        q = shares({t: sum(own[s][t] for s in sources) for t in kept})
        for s in sources:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])):
                out += [(lang, s, part, o, -x, k + 1) for k, (x, o) in enumerate(found)]
    return sorted(out)


EXTRA = [("xx", "lone", "über Über ÜBER"), ("yy", "a", ""), ("yy", "b", None), (None, None, "the The THE"), ("xx", "ü", "tie one"), ("xx", "u", "tie one"), ("xx", "z", "tie two x1y2z3")]


@pytest.mark.parametrize("block", [40, 600_000])
def test_divergence_is_the_definition(spark, odd, docs, block):
    rows = [(r.lang, r.source, r.text) for df in (odd, docs.limit(150)) for r in df.collect()] + EXTRA
    df = spark.createDataFrame(rows, "lang string, source string, text string").selectExpr("*", "1 AS term", "2 AS n", "'x' AS item").repartition(4)
    assert sorted(map(tuple, D.divergence(df, block=block, top=20).collect())) == plain(rows, top=20)


def test_many_groups_are_joined_by_shuffle(spark, docs):
    rows = [(r.lang, r.source, r.text) for r in docs.limit(60).collect()]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    assert sorted(map(tuple, D.divergence(df, few=0).collect())) == plain(rows)


def test_nothing_has_no_rows(nothing):
    assert D.divergence(nothing).count() == 0


def test_shares_are_exact_beyond_a_long_product(spark):
    for n, total in ((8 * 10**14 + 7, 9 * 10**15 - 1), (1, 10**15), (5, 5), (999, 1000)):
        found = spark.range(1).select(D._share(D.F.lit(n).cast("long"), D.F.lit(total).cast("long"))).first()[0]
        assert found == 1 + 10**9 * n // total


def test_query_as_registered(spark, sf, docs):
    import duckdb

    found = QUERIES["op12_source_divergence"](spark, sf)
    assert found.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    rows = sorted(map(tuple, found.collect()))
    assert rows == plain([(r.lang, r.source, r.text) for r in docs.collect()])
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(db.sql(ORACLE_SQL["op12_source_divergence"]).fetchall()) == rows
