import numpy as np
import pytest

from tidemark.llm import embedding_dedup as E
from tidemark.llm.registry import QUERIES


def plain(rows, least=0.95):
    """n_links and component of each row, from all pairs."""
    n = len(rows)
    links = np.zeros((n, n), bool)
    good = [k for k, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and np.any(v)]
    for length in {len(rows[k][1]) for k in good}:
        at = np.array([k for k in good if len(rows[k][1]) == length])
        x = np.array([np.array(rows[k][1], float) / np.abs(rows[k][1]).max() for k in at])
        x /= np.linalg.norm(x, axis=1)[:, None]
        links[np.ix_(at, at)] = x @ x.T >= least
    np.fill_diagonal(links, False)
    label = list(range(n))
    for start in range(n):
        if label[start] == start:
            todo = [start]
            while todo:
                for k in np.flatnonzero(links[todo.pop()]):
                    if label[k] != start:
                        label[k] = start
                        todo.append(k)
    least_id = {g: min((rows[k][0] for k in range(n) if label[k] == g and rows[k][0] is not None), default=None) for g in set(label)}
    return [(rows[k][0], int(links[k].sum()), least_id[label[k]], rows[k][0] == least_id[label[k]]) for k in range(n)]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0))


@pytest.fixture(scope="module")
def planted():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 32))
    tight = rng.normal(size=32) + 0.02 * rng.normal(size=(250, 32))  # one bucket at every level
    near = base[:100] + rng.uniform(0, 0.6, (100, 1)) * rng.normal(size=(100, 32)) * 0.5
    rows = [v.tolist() for v in np.concatenate([base, tight, near])] + [tight[0].tolist()] * 40 + [(3 * base[0]).tolist(), (1e200 * base[1]).tolist(), (-base[2]).tolist()]
    rows += [None, [], [0.0] * 32, [-0.0] * 32, [float("nan")] * 32, [float("inf")] + [1.0] * 31, [None] + [1.0] * 31, [1.0], [2.0], [-1.0], [1.0, 0.0, 0.0], [1.0, -0.0, 0.0], [1.0, 0.1, 0.0]]
    return [*enumerate(rows), (5, rows[7]), (None, rows[9]), (None, None), (None, [7.0, 7.0, 1.0, 5.0])]


@pytest.mark.parametrize("bucket", [16, 2048])
def test_links_are_those_of_all_pairs(spark, planted, bucket):
    df = spark.createDataFrame(planted, "vec_id long, embedding array<double>").selectExpr("*", "1 AS n", "2 AS node", "'x' AS vec", "3 AS label").repartition(3)
    found, expected = ordered(map(tuple, E.near_vectors(df, bucket=bucket).collect())), ordered(plain(planted))
    assert sum(r[1] for r in expected) > 60_000
    if bucket == 2048:
        assert found == expected
    else:  # five levels deep a few pairs may never meet, but none is made up or counted twice
        assert [r[0] for r in found] == [r[0] for r in expected]
        assert 0.97 * sum(r[1] for r in expected) <= sum(r[1] for r in found) <= sum(r[1] for r in expected)


@pytest.fixture(scope="module")
def crowd():
    """Different vectors of which about half of all pairs are at 0.95 or more, beside others."""
    rng = np.random.default_rng(8)
    centre = rng.normal(size=32)
    x = centre * np.sqrt(32) / np.linalg.norm(centre) + 0.229 * rng.normal(size=(500, 32))
    return list(enumerate([v.tolist() for v in np.concatenate([x, rng.normal(size=(300, 32))])]))


@pytest.mark.parametrize("bucket", [8, 64])
@pytest.mark.parametrize("exact", [False, True])
def test_crowded_cells_lose_no_link(spark, crowd, bucket, exact):
    df = spark.createDataFrame(crowd, "vec_id long, embedding array<double>").repartition(3)
    expected = ordered(plain(crowd))
    assert 0.3 < sum(r[1] for r in expected) / 500**2 < 0.7
    assert ordered(map(tuple, E.near_vectors(df, bucket=bucket, exact=exact).collect())) == expected


def test_tables_keep_the_chance_at_any_level():
    rng = np.random.default_rng(2)
    for dim in (64, 128, 768):
        x, z = rng.normal(size=(2, 4000, dim))
        x /= np.linalg.norm(x, axis=1)[:, None]
        z -= (z * x).sum(axis=1)[:, None] * x
        y = 0.95 * x + np.sqrt(1 - 0.95**2) * z / np.linalg.norm(z, axis=1)[:, None]
        for level in (1, 2, 3):
            share = np.mean([(E.cells(x, t, level) == E.cells(y, t, level)).mean() for t in range(2)])
            assert (1 - share) ** E.tables(dim, level) < 2 * E.MISSED, (dim, level, share)


def test_estimates_are_unbiased_and_within_their_bounds():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    noise = rng.normal(size=x.shape)
    noise -= (noise * x).sum(axis=1)[:, None] * x
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * noise / np.linalg.norm(noise, axis=1)[:, None]
    turned, code, factor = E.codes(x)
    other = E.codes(y)[0]
    bits = turned.shape[1]
    error = ((2.0 * np.unpackbits(code, axis=1) - 1) / np.sqrt(bits) * other).sum(axis=1) / factor - 0.95
    deviation = np.sqrt((1 - factor**2) / factor**2 * (1 - 0.95**2) / (bits - 1))
    assert abs(error.mean()) < 0.002 and (np.abs(error) < E.SIGMAS * deviation).all() and 0.8 < (error / deviation).std() < 1.2
    assert np.allclose(turned @ turned.T, x @ x.T)


def test_nothing_has_no_rows(spark):
    assert E.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_query_as_registered(spark):
    sf = "/root/testdata/check_s" if False else "/root/testdata/sf0.01"
    sf = "/root/testdata/sf0.01"
    found = QUERIES["op13_embedding_dedup"](spark, sf)
    assert found.dtypes == [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert ordered(map(tuple, found.collect())) == ordered(plain(rows))
