import gc
import hashlib
import random
import re
import weakref

import numpy as np
import pytest
import xxhash

import corpus_pipeline
import pyspark.sql.functions as F
from tidemark.llm import decontamination, suffix_dedup
from tidemark.llm.components import components
from tidemark.llm.decontamination import find_contamination, is_contaminated, remove_contaminated
from tidemark.llm.simhash import GrayIndex, gray_rank, keep_one, links, near_duplicates
from tidemark.llm.similarity import _by_index, similar_groups

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contamination(docs, items, size=13):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if (owners := windows.get(tuple(w[k : k + n]))) is not None:
                    found |= owners
                    hit.update(range(k, k + n))
        out.append((doc, len(w), len(hit), sorted(found)))
    return out


def key(row):
    return str(row)


@pytest.mark.parametrize("block_words", [500_000, 60])
def test_decontamination_against_brute_force(spark, sf, docs, texts, odd, block_words):
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet").limit(12).unionByName(spark.createDataFrame([(900, "and the dog"), (901, None), (902, "über"), (903, "!!")], "item_id long, text string"))
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    for df in (docs, odd):
        found = [(r.doc_id, r.c.n_words, r.c.n_hit, r.c["items"]) for r in find_contamination(df, benchmark, block_words=block_words, out="c", keep=["doc_id"]).collect()]
        assert sorted(found, key=key) == sorted(contamination([(r.doc_id, r.text) for r in df.collect()], items), key=key)


def test_longest_match_goes_beyond_a_window(spark):
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, "before " + " ".join(text.split()[5:45]) + " after"), (2, "w1 w2 w3")], "doc_id long, text string")
    found = {r.doc_id: r.c for r in find_contamination(docs, spark.createDataFrame([("i", text)], "item_id string, text string"), out="c").collect()}
    assert found[1].longest == 40 and [tuple(s) for s in found[1].spans] == [(1, 41)] and found[2].n_hit == 0


def test_longest_match_against_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(30):
        items = [" ".join(f"w{x}" for x in rng.integers(0, 3, rng.integers(1, 40))) for _ in range(5)]
        text = " ".join(f"W{x}" for x in rng.integers(0, 3, 80))
        index = decontamination.BenchmarkBlock([(str(k), t) for k, t in enumerate(items)], 4)
        raw = np.frombuffer(text.encode(), np.uint8)
        _, _, start, size, longest, _ = index.search(raw, np.array([0, len(raw)]))
        own, lists = words(text), [words(t) for t in items]
        for a, n, found in zip(start.tolist(), size.tolist(), longest.tolist()):
            reach = 0
            for w in lists:
                for b in range(len(w) - n + 1 if min(4, len(w)) == n else 0):
                    same = next((k for k, (x, y) in enumerate(zip(own[a:], w[b:])) if x != y), min(len(own) - a, len(w) - b))
                    reach = max(reach, same if same >= n else 0)
            assert found == reach


def test_a_window_of_very_many_items_and_documents(spark):
    """The window is in each of 3,000 items and documents; what a task works on grows with their sum, not with their product."""
    line = " ".join(f"w{k}" for k in range(13))
    items = spark.createDataFrame([(k, f"{line} tail{k} more{k}") for k in range(3000)], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"start{k} {line} tail{k} other") for k in range(3000)], "doc_id long, text string").repartition(4)
    for block_words in (500_000, 30_000):
        found = find_contamination(docs, items, block_words=block_words, out="c", keep=["doc_id"]).select("c.n_hit", "c.longest", F.size("c.items").alias("n")).distinct().collect()
        assert [tuple(r) for r in found] == [(14, 14, 3000)]


def test_blocks_are_held_one_at_a_time(spark, docs, monkeypatch):
    alive = []
    made = decontamination.BenchmarkBlock.__init__

    def counted(self, *args):
        made(self, *args)
        alive.append(weakref.ref(self))
        gc.collect()
        assert sum(r() is not None for r in alive) <= 4

    monkeypatch.setattr(decontamination.BenchmarkBlock, "__init__", counted)
    benchmark = spark.createDataFrame([(k, " ".join(f"q{k}x{j}" for j in range(20))) for k in range(12)], "item_id long, text string")
    some = docs.limit(20).cache()
    assert find_contamination(some, benchmark, block_words=20, out="c").filter("c.n_hit > 0 OR c.n_words IS NULL").count() == 0 and len(alive) == 12


def test_words_of_equal_hash_are_told_apart_by_their_bytes():
    a, b = (decontamination.Words(np.frombuffer(t, np.uint8), np.array([0, len(t)])) for t in (b"One two three", b"one Two thre two"))
    assert decontamination.same_bytes(a, np.array([0, 1, 2, 1]), b, np.array([0, 1, 2, 3])).tolist() == [True, True, False, True]


def test_contaminated_documents_go_and_columns_stay(spark, odd, nothing):
    benchmark = spark.createDataFrame([(1, "the cat sat on the mat and the dog ran to the hill")], "item_id long, text string")
    left = remove_contaminated(odd, benchmark)
    assert left.columns == odd.columns and left.count() == odd.count() - 2
    assert remove_contaminated(odd, spark.createDataFrame([], "item_id long, text string")).count() == odd.count()
    assert remove_contaminated(nothing, benchmark).count() == 0
    assert find_contamination(odd, benchmark, out="contamination").filter(is_contaminated("contamination_")).count() == 2


def brute_components(fps, most=3):
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= most
    labels = np.arange(len(fps))
    while True:
        new = np.array([labels[near[k]].min() for k in range(len(fps))])
        if (new == labels).all():
            return labels
        labels = new


def fingerprint(text):
    w = (text or "").encode().lower().split()
    n = min(3, len(w))
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[k : k + n]), 42) for k in range(len(w) - n + 1)] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates_against_brute_force(docs, odd):
    for df in (docs, odd):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        fps = np.array([fingerprint(t) for _, t in rows], np.uint64)
        labels = brute_components(fps)
        least = {g: min((i for (i, _), h in zip(rows, labels) if h == g and i is not None), default=None) for g in set(labels)}
        expected = sorted((str(i), int(f), least[g]) for (i, _), f, g in zip(rows, fps.view(np.int64), labels))
        assert sorted((str(r.doc_id), r.fp, r.component_id) for r in near_duplicates(df).collect()) == expected


@pytest.mark.parametrize("bucket", [4096, 40, 6])
def test_no_link_is_lost_in_crowded_buckets(spark, bucket):
    rng = random.Random(1)
    centers, values = [rng.getrandbits(64) for _ in range(4)], set()
    for k in range(900):
        v = centers[k % 4]
        for b in rng.sample(range(64), rng.randrange(7)):
            v ^= 1 << b
        values.add(v)
    fps = np.array(sorted(values), np.uint64)
    labels = brute_components(fps)
    signed = fps.view(np.int64).tolist()
    root = {r.node: r.root for r in components(links(spark.createDataFrame([(v,) for v in signed], "fp long"), 3, bucket)).collect()}
    found = [root.get(v, v) for v in signed]
    assert len(set(zip(labels, found))) == len(set(labels)) == len(set(found))


def test_gray_index_finds_all_pairs():
    rng = np.random.default_rng(3)
    fps = np.unique(rng.integers(0, 1 << 12, 400).astype(np.uint64))
    assert (np.bitwise_count(np.diff(np.sort(gray_rank(fps))).astype(np.uint64)) >= 0).all()
    index = GrayIndex(fps, np.zeros(len(fps), np.int64))
    found = {frozenset((int(index.fps[a]), int(index.fps[b]))) for x, y in index.links(3) for a, b in zip(x, y)}
    assert found == {frozenset((int(a), int(b))) for k, a in enumerate(fps) for b in fps[k + 1 :] if int(np.bitwise_count(a ^ b)) <= 3}


def test_one_of_each_group_stays(odd, nothing):
    kept = keep_one(odd)
    groups = near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({r.component_id for r in groups.collect()} - {None})
    assert keep_one(nothing).count() == 0


def similar_components(texts):
    lists = [(t or "").encode().lower().split() for t in texts]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in lists]
    labels = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9 and labels[a] != labels[b]:
                labels = [labels[b] if x == labels[a] else x for x in labels]
    return labels


def near_copies(seed):
    """Texts with copies of a changed word or a few: of 200 words 1 to 4 apart, so most pairs are at a similarity of 0.8 to 0.97."""
    rng, rows = random.Random(seed), []
    for base in range(12):
        text = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        for copy in range(6):
            own = list(text)
            for k in rng.sample(range(200), copy and 1 + copy % 4):
                own[k] = f"x{rng.randrange(10**6)}"
            rows.append((1000 + 6 * base + copy, " ".join(own)))
    return rows


@pytest.mark.parametrize("small", [16, 2])
def test_similar_groups_against_brute_force(spark, docs, odd, small):
    plain = [(r.doc_id, r.text) for df in (docs.limit(120), odd) for r in df.select("doc_id", "text").collect()]
    rows = [(k, t) for k, (_, t) in enumerate(plain)] + near_copies(3)
    labels = similar_components([t for _, t in rows])
    least = {g: min(i for (i, _), h in zip(rows, labels) if h == g) for g in set(labels)}
    found = similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), small=small)
    assert sorted(map(tuple, found.collect())) == sorted((i, least[g]) for (i, _), g in zip(rows, labels))


def test_index_connects_nodes_within_the_bits(spark):
    rng = random.Random(5)
    prints = [rng.randrange(1 << 64) for _ in range(40)]
    prints += [f ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for f in prints[:20]] + prints[:5]
    rows = [(100 + k, f - (1 << 64) if f >> 63 else f) for k, f in enumerate(prints)]
    roots = components(_by_index(spark.createDataFrame(rows, "node long, fp long"), 3))
    found = {r.node: r.root for r in roots.collect()}
    near = {n: min(m for (m, _), g in zip(rows, prints) if bin(f ^ g).count("1") <= 3) for (n, _), f in zip(rows, prints)}
    assert {n: found.get(n, n) for n, _ in rows} == {n: near[near[n]] for n, _ in rows}


def test_pipeline_stage_drops_planted_near_copies(spark, sf):
    rows = near_copies(4)
    labels = similar_components([t for _, t in rows])
    left = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf)
    assert sorted(r.doc_id for r in left.collect()) == sorted(rows[labels.index(g)][0] for g in set(labels))


def repeats(docs, size):
    bodies = [(d, (t or "").encode()) for d, t in docs]
    counts = {}
    for _, b in bodies:
        for k in range(len(b) - size + 1):
            counts[b[k : k + size]] = counts.get(b[k : k + size], 0) + 1
    out = []
    for d, b in bodies:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - size + 1):
            if counts[b[k : k + size]] > 1:
                gone[k : k + size] = True
        edges = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((d, len(b), int(gone.sum()), edges, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("group", [1000, 2])
def test_repeats_against_brute_force(spark, docs, odd, group):
    rng = random.Random(5)
    passage = " ".join(str(rng.random()) for _ in range(30))
    many = spark.createDataFrame([(k, f"{rng.random()} " * rng.randrange(4, 20) + passage[: rng.choice([190, 230, 400])] + f" {rng.random()}" * 9) for k in range(60)], "doc_id long, text string")
    common = spark.createDataFrame([(k, passage + (" end" if k % 3 else f" {k} {rng.random()}" * 9)) for k in range(60)], "doc_id long, text string")
    for df in (docs.limit(60), odd, many, common):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        found = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(frame, group).collect()]
        assert sorted(found, key=key) == sorted(repeats(rows, 200), key=key)


def test_repeats_in_an_empty_table(nothing):
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_statistics_of_the_run_length_index():
    rng = np.random.default_rng(1)
    for _ in range(20):
        strings = [bytes(rng.integers(97, 99, rng.integers(1, 50)).astype(np.uint8)) for _ in range(6)]
        strings += [strings[0] + b"x", strings[1][len(strings[1]) // 2 :]]
        raw, at = np.frombuffer(b"".join(strings), np.uint8), np.concatenate([[0], np.cumsum([len(s) for s in strings])])
        index = suffix_dedup.RunLengthIndex(raw, at)
        suffixes = [s[k:] for s in strings for k in range(len(s))]
        common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert index.statistics().tolist() == [max(common(s, t) for j, t in enumerate(suffixes) if j != i) for i, s in enumerate(suffixes)]
        order = sorted(range(len(raw)), key=lambda k: (suffixes[k], k))
        first = set(at[:-1].tolist())
        assert np.repeat(index.symbols, index.lengths).tolist() == [-1 if k in first else int(raw[k - 1]) for k in order]
        assert not hasattr(index, "suffixes") and len(index.heads) == len(index.tails) == len(index.symbols) <= len(raw)


def test_repetitive_text_has_few_runs():
    text = bytes(np.random.default_rng(2).integers(97, 123, 400).astype(np.uint8)) * 50
    index = suffix_dedup.RunLengthIndex(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert len(index.symbols) < 1000 < len(text) and index.statistics()[0] == len(text) - 400


@pytest.mark.parametrize("nodes", [3, 2048])
def test_links_across_groups_are_those_of_all_pairs(spark, nodes):
    import random

    from tidemark.llm.similarity import _across

    rng = random.Random(7)
    sets = {k: sorted(rng.sample(range(40), 20) if k % 3 else [x for x in range(40) if rng.random() < 0.9]) for k in range(60)}
    root = {k: k % 5 for k in sets}
    apart = spark.createDataFrame([(b, k, root[k]) for b in (1, 2) for k in sets if b == 1 or k % 2], "band long, node long, root long")
    whole = spark.createDataFrame(list(sets.items()), "node long, shingles array<long>")
    similar = {(a, b) for a in sets for b in sets if a < b and root[a] != root[b] and len(set(sets[a]) & set(sets[b])) >= 0.8 * len(set(sets[a]) | set(sets[b]))}
    found = {(r.u, r.v) for r in _across(apart.repartition(4), whole, 0.8, nodes=nodes).collect()}
    assert found <= similar
    # every node that is similar to one of a later group has a link to that group
    assert {(min(a, b, key=root.get), max(root[a], root[b])) for a, b in similar} == {(min(a, b, key=root.get), max(root[a], root[b])) for a, b in found}
