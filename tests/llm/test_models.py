import hashlib
import os
import zlib
from collections import Counter

import numpy as np
import regex

from tidemark.llm import language_id, toxicity, url_filter
from tidemark.llm.common import crc_mod
from tidemark.llm.fingerprints import PrefixHashes, edited, fingerprints, likeness
from tidemark.llm.mixing import mix, report, sample

import pyspark.sql.functions as F


def test_language_of_held_out_documents(spark, docs):
    model = language_id.train(language_id.learning_rows(docs))
    rows = language_id.score_texts(docs, model, keep=("doc_id", "lang")).filter(crc_mod("doc_id", 4) == 2).collect()
    assert len(rows) > 20 and np.mean([r.lang_pred == r.lang for r in rows]) > 0.97
    assert np.mean([r.accepted for r in rows]) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def plain_kneser_ney(words, order, alphabet):
    """p(character | what stands before it in its word), straight from the definition: counts at the highest order and at a word's begin, else kinds of contexts."""
    grams = Counter()
    for w in words:
        w = f" {w} "
        for stop in range(2, len(w) + 1):
            for n in range(1, min(order, stop) + 1):
                grams[w[stop - n : stop]] += 1

    def count(gram):
        if len(gram) == order or (len(gram) > 1 and gram[0] == " "):
            return grams.get(gram, 0)
        return sum(1 for g in grams if len(g) == len(gram) + 1 and g[1:] == gram)

    table = {g: count(g) for g in grams}
    discount = {}
    for n in range(1, order + 1):
        ones, twos = (sum(1 for g, c in table.items() if len(g) == n and c == k) for k in (1, 2))
        discount[n] = min(max(ones / (ones + 2 * twos) if ones else 0.5, 0.1), 0.9)

    def p(context, c):
        n = len(context) + 1
        own = {g: v for g, v in table.items() if len(g) == n and g[:-1] == context and v > 0}
        lower = p(context[1:], c) if context else 1 / alphabet
        if not own:
            return lower
        total = sum(own.values())
        return max(own.get(context + c, 0) - discount[n], 0) / total + discount[n] * len(own) / total * lower

    return p


def test_language_model_against_the_definition():
    english, german = ["the", "then", "this", "that", "other", "with", "path", "the"], ["der", "die", "das", "dann", "dort", "der", "oder"]
    letters = sorted({c for w in english + german for c in w}) + [" "]
    alphabet, order = len(letters) + 1, 3
    rows = []
    for lang, words in (("de", german), ("en", english)):
        grams = Counter(f" {w} "[k - n : k] for w in words for k in range(2, len(w) + 3) for n in range(1, min(order, k) + 1))
        rows += [(lang, g, n) for g, n in grams.items()]
    model = language_id.Model(["de", "en"], rows, order)
    plain = [plain_kneser_ney(w, order, alphabet) for w in (german, english)]
    for word in ("the", "das", "x", "thx", "ohr"):
        steps, padded = model.steps([word])[0], f" {word} "
        for k in range(1, len(padded)):
            for g in (0, 1):
                assert abs(np.exp(steps[k, g]) - plain[g](padded[max(0, k - order + 1) : k], padded[k])) < 1e-5
    # the chances of all characters, and of an unknown one, after "th" add up to one
    for g in (0, 1):
        after = [np.exp(model.steps([f"th{c}"])[0][3, g]) for c in [*letters[:-1], "?"]] + [np.exp(model.steps(["th"])[0][3, g])]
        assert abs(sum(after) - 1) < 1e-5


def test_rejection_is_calibrated():
    rng = np.random.default_rng(1)
    models = [language_id.Model(["a", "b"], [("a", "x", 3), ("b", "y", 2)], 1)]
    found = language_id.Identifier(models)
    language, letters = rng.integers(0, 2, 4000), rng.integers(20, 4000, 4000)
    cost = 2 + 0.5 * language + rng.normal(0, 0.05, 4000) * np.sqrt(1 + 100 / letters)
    found.calibrate(language[:1000], cost[:1000], letters[:1000], 1e-3)
    rejected = found.deviations(language[1000:], cost[1000:], letters[1000:]) > found.bound
    assert rejected.mean() < 5e-3 and found.deviations(np.array([0]), np.array([3.0]), np.array([500])) > found.bound


def test_languages_in_groups_and_of_few_rows(spark, docs):
    few = docs.withColumn("lang", F.when(F.col("doc_id") == 3, "xx").otherwise(F.col("lang")))
    model = language_id.train(language_id.learning_rows(few), group=2)
    assert len(model.models) == 3 and ("xx" in model.languages)
    rows = language_id.score_texts(docs, model, keep=("doc_id", "lang")).collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.97


def test_columns_of_any_name_and_null_languages_pass_the_stage(spark, docs, nothing):
    odd = docs.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, F.col("lang"))).selectExpr("*", "'mine' AS accepted", "'mine' AS lang_pred", "'mine' AS c0", "'mine' AS part", "'mine' AS share", "'mine' AS aside")
    kept = language_id.keep_known(odd.union(odd.filter("doc_id < 20")))
    assert kept.columns == odd.columns and kept.count() > 0.95 * (odd.count() + 20) and language_id.keep_known(nothing).count() == 0


def test_odd_texts_have_no_language(spark, odd, nothing, docs):
    model = language_id.train(language_id.learning_rows(docs))
    rows = {r.doc_id: r for r in language_id.score_texts(odd, model).collect()}
    assert {k for k, r in rows.items() if r.lang_pred == "und"} == {1, 2, 3, 5} and not any(rows[k].accepted or rows[k].score for k in (1, 2, 3, 5))
    assert not rows[11].accepted
    assert {r.lang_pred for r in language_id.score_texts(odd, None).collect()} == {"und"}
    assert language_id.train(nothing) is None and language_id.score_texts(nothing, model).count() == 0
    kept = language_id.keep_known(docs.withColumn("score", F.lit("mine")))
    assert kept.columns == [*docs.columns, "score"] and kept.count() > 0.97 * docs.count()


def test_network_gradient():
    net = toxicity.Network({"a": 0, "b": 1, "c": 2}, np.array([0.1, -0.2, 0.3, 0.0]))
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    batch, bounds, y, weight = [["a", "b", "zz", "c"] * 4, ["b", "c"], ["q"] * 24], [(2, 11), (0, 2), (4, 24)], np.array([1, 0, 1.0]), np.ones(3)
    _, gradient = net.gradient(batch, bounds, y, weight)
    for name, values in net.w.items():
        flat, at = values.reshape(-1), int(np.argmax(abs(gradient[name].reshape(-1))))
        old, losses = flat[at], []
        for step in (1e-3, -1e-3):
            flat[at] = old + step
            losses.append(net.gradient(batch, bounds, y, weight)[0])
        flat[at] = old
        assert abs((losses[0] - losses[1]) / 2e-3 - gradient[name].reshape(-1)[at]) < 1e-4


def test_toxicity_of_planted_words(spark):
    rng = np.random.default_rng(2)
    plain = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(400):
        words = list(rng.choice(plain, rng.integers(5, 200)))
        if k % 5 == 0:
            for bad in rng.choice(["scumx", "trashy", "idiotic"], 2):
                words.insert(int(rng.integers(0, len(words))), bad)
        rows.append((k, " ".join(words), int(k % 5 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    net = toxicity.train(df.filter("doc_id < 300"), df.select("doc_id", "toxic").filter("doc_id < 300"))
    found = {r.doc_id: r.score for r in toxicity.score_texts(df.filter("doc_id >= 300"), net).collect()}
    assert all((found[k] >= 0.5) == bool(y) for k, _, y in rows if k >= 300)


def test_toxicity_of_odd_texts(spark, odd, nothing):
    labels = spark.createDataFrame([(7, 1), (8, 0), (9, 0), (12, 0)], "doc_id long, toxic int")
    net = toxicity.train(odd, labels)
    rows = toxicity.score_texts(odd, net).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1
    assert toxicity.train(odd, labels.filter("toxic = 0")) is None and toxicity.score_texts(nothing, net).count() == 0
    assert {r.score for r in toxicity.score_texts(odd, None).collect()} == {0.0}


def plain_logits(net, words):
    """Every window's logit, word by word: blocks of 48 words, run from 8 words before them on in both directions, pooled over 24 words."""
    sigmoid, h = (lambda x: 1 / (1 + np.exp(-x))), 8
    states = np.zeros((len(words), 2 * h))
    for block in range(0, len(words), 48):
        for k, (d, order) in enumerate((("f", range(max(block - 8, 0), min(block + 48, len(words)))), ("b", range(min(block + 56, len(words)) - 1, block - 1, -1)))):
            state = np.zeros(h)
            for t in order:
                gates, back = net.project([words[t]])[0, 3 * h * k : 3 * h * (k + 1)], state @ net.w[f"rec_{d}"]
                z, r = sigmoid(gates[:h] + back[:h]), sigmoid(gates[h : 2 * h] + back[h : 2 * h])
                state = z * state + (1 - z) * np.tanh(gates[2 * h :] + r * back[2 * h :])
                if block <= t < block + 48:
                    states[t, h * k : h * (k + 1)] = state
    out = []
    for s in range(max(len(words) - 23, 1)):
        part = states[s : s + 24]
        weight = np.exp(part @ net.w["attend"])
        out.append((weight @ (part @ net.w["out"]) / weight.sum() if len(part) else 0.0) + float(net.w["bias"][0]))
    return out


def test_all_windows_are_scored():
    rng = np.random.default_rng(5)
    net = toxicity.Network({f"w{k}": k for k in range(30)}, rng.normal(0, 1, 31))
    net.w = {k: rng.normal(0, 0.7, v.shape).astype(np.float32) for k, v in net.w.items()}
    lists = [[f"w{k}" for k in rng.integers(0, 40, n)] for n in (0, 1, 23, 24, 25, 48, 49, 130, 0, 7)]
    for found, words in zip(toxicity.window_logits(net, lists), lists):
        assert np.allclose(found, plain_logits(net, words), atol=1e-4)


def test_sliding_sums():
    x = np.random.default_rng(0).normal(size=100)
    assert np.allclose(toxicity.sliding(x), [x[k : k + 24].sum() for k in range(100)]) and len(toxicity.sliding(x[:0])) == 0


def test_a_toxic_run_at_any_place_is_found(spark):
    rng = np.random.default_rng(4)
    text = lambda n: list(rng.choice([f"w{k}" for k in range(200)], n))
    rows = [(k, " ".join(text(60) + (list(rng.permutation(["scumx", "trashy", "idiotic", "vilest"])) if k % 4 == 0 else []) + text(60)), int(k % 4 == 0)) for k in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    net = toxicity.train(df, df.select("doc_id", "toxic"))
    body = text(120)
    planted = [(k, " ".join(body[:k] + ["idiotic", "vilest", "scumx", "trashy"] + body[k:])) for k in range(0, 121, 5)] + [(999, " ".join(body))]
    found = {r.doc_id: r.score for r in toxicity.score_texts(spark.createDataFrame(planted, "doc_id long, text string"), net).collect()}
    assert found.pop(999) < 0.5 and all(s >= 0.5 for s in found.values())


def test_prefix_hashes():
    a, b = (np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in ("abcabcabd", "xxabcabcaby"))
    x, y = PrefixHashes(a), PrefixHashes(b)
    assert x.equal(0, y, 2, 8) and not x.equal(0, y, 2, 9) and x.extension(0, y, 2) == 8 and x.extension(3, x, 0) == 5 and x.extension(0, y, 0) == 0


def test_fingerprints_against_brute_force(odd, docs, nothing):
    for df in (docs, odd):
        rows = sorted(((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
        changed = [edited(t, u) for (_, t), (_, u) in zip(rows, [*rows[1:], rows[0]])]
        found = fingerprints(df).collect()
        expected = sorted((str(i), len(t), hashlib.sha256(e.encode()).hexdigest(), len(os.path.commonprefix([t, e]))) for (i, t), e in zip(rows, changed))
        assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.same_edited) for r in found) == expected
        marks = {}
        for r in found:
            marks.setdefault(next(t for i, t in rows if i == r.doc_id), set()).add(r.fingerprint)
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert all(len(m) == 1 for m in marks.values()) and len({m for s in marks.values() for m in s}) == len(marks)
    assert fingerprints(nothing).count() == 0


def test_likeness():
    a, b = (PrefixHashes(np.frombuffer((t * 1).encode("utf-32-le"), np.uint32)).sketch() for t in ("one text of some length that is read", "quite another that shares nothing at all"))
    assert likeness(a, a) == 1 and likeness(a, b) < 0.2 and likeness(np.zeros(64, int), np.zeros(64, int)) == 1


def plain_mix(cells, share, targets):
    """Raking under the cap by the book: cells (source, lang, topic) -> tokens; bisection for one name at a time, until nothing moves."""
    budget = share * sum(cells.values())
    factors, wanted = [{}, {}, {}], []
    for d, target in enumerate(targets):
        have = Counter()
        for key, t in cells.items():
            have[key[d]] += t
        goal = {k: target.get(k, 0.0) if isinstance(target, dict) else v**target for k, v in have.items()}
        lo, hi = 0.0, 1e9
        for _ in range(200):
            m = (lo + hi) / 2
            lo, hi = (m, hi) if sum(min(have[k], m * g) for k, g in goal.items()) < budget else (lo, m)
        wanted.append({k: min(have[k], hi * g) for k, g in goal.items()})
        factors[d] = {k: float(g > 0) for k, g in goal.items()}
    for _ in range(300):
        for d in range(3):
            for name, want in wanted[d].items():
                mine = [(t, factors[(d + 1) % 3][k[(d + 1) % 3]] * factors[(d + 2) % 3][k[(d + 2) % 3]]) for k, t in cells.items() if k[d] == name]
                lo, hi = 0.0, 1e12
                for _ in range(90):
                    f = (lo * hi) ** 0.5 if lo else hi / 1e6
                    lo, hi = (f, hi) if sum(t * min(1, f * r) for t, r in mine) < want else (lo, f)
                    if hi < 1e-12:
                        break
                factors[d][name] = hi
    return {k: min(1.0, factors[0][k[0]] * factors[1][k[1]] * factors[2][k[2]]) for k in cells}, wanted


def test_mixing_against_plain_raking(spark):
    rng = np.random.default_rng(8)
    rows = [(k, " ".join(["w"] * int(rng.integers(1, 60))), str(rng.choice(["en", "de", "fr"], p=[0.7, 0.2, 0.1])), f"s{rng.integers(4)}", int(rng.integers(3))) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, theme int")
    for targets in ((0.7, 0.6, 0.5), ({"s0": 0.4, "s1": 0.3, "s2": 0.2, "s3": 0.1, "gone": 0.5}, {"en": 0.5, "de": 0.3, "fr": 0.2}, 1.0)):
        cells = Counter()
        for _, text, lang, source, theme in rows:
            cells[source, lang, theme] += len(text.split())
        expected, _ = plain_mix(cells, 0.6, targets)
        found = mix(df, share=0.6, source_target=targets[0], lang_target=targets[1], topic_target=targets[2], topic="theme").select("mix.*").collect()
        assert len(found) == len(rows) and max(abs(r.probability - expected[r.source, r.lang, r.topic]) for r in found) < 0.01


def test_mixing_meets_its_margins(docs, odd, nothing):
    for df in (docs, odd):
        rows = mix(df).select("mix.*" if "mix" not in df.columns else "mix_.*").collect()
        assert len(rows) == df.count()
        total = sum(r.tokens for r in rows)
        assert abs(sum(r.tokens * r.probability for r in rows) / total - 0.8) < 0.01
    kept = sample(odd)
    assert kept.columns == odd.columns and 0 < kept.count() <= odd.count()
    assert sample(nothing).count() == 0 and sample(docs, share=1.0).count() == docs.count()
    shares = report(docs).collect()
    assert {r.kind for r in shares} == {"source", "lang", "topic"} and report(nothing).count() == 0
    for r in shares:
        # 200 documents: marginals that are reachable alone exclude each other a little; sources are met exactly
        assert abs(r.expected - r.reachable) < (1e-6 if r.kind == "source" else 0.012) and abs(r.kept - r.expected) < 0.1
        assert r.target <= r.reachable + 1e-9 or abs(r.reachable * 0.8 - r.have) < 1e-6 or any(o.target > o.reachable for o in shares if o.kind == r.kind)


def test_sources_that_get_nothing(spark, docs):
    names = sorted(r[0] for r in docs.select("source").distinct().collect())
    rows = mix(docs, share=0.3, source_target={names[0]: 2.0, names[1]: 1.0}).select("mix.*").collect()
    assert all(r.probability == 0 for r in rows if r.source not in names[:2] and r.tokens) and any(r.kept for r in rows)


def topic_by_words(text):
    counts = Counter(regex.findall(r"\p{L}{4,}", (text or "").lower()))
    return zlib.crc32(min(counts, key=lambda w: (-counts[w], w)).encode()) % 8 if counts else 0


def test_topic_counts_every_word_whatever_its_case_and_punctuation(spark, docs, odd):
    planted = spark.createDataFrame([(1, "Data, data. (DATA) other other", "en", "a"), (2, "one-more other one-more-more other and-more", "en", "a")], "doc_id long, text string, lang string, source string")
    assert topic_by_words("data") != topic_by_words("other") != topic_by_words("more")
    for df in (planted, docs, odd):
        own = "mix_" if "mix" in df.columns else "mix"
        rows = mix(df).select("text", f"{own}.topic", f"{own}.tokens").collect()
        assert len(rows) == df.count() and all((r.topic, r.tokens) == (topic_by_words(r.text), len((r.text or "").split())) for r in rows)


def test_urls(spark):
    urls = ["HTTP://A.Example.COM/en/7?x", "https://example.com/en/8", "ftp://x.net/de/1", "http://example.net/de/88", "http://x.org/es/", "no scheme", None, "://", "http://h", "http://q.de/a/b/c/d/e#f", "http://com/en/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = {r.page_id: r for r in url_filter.filter_urls(pages, spark.createDataFrame([(9, 1), (9, 0), (77, 1)], "page_id long, bad int")).collect()}
    assert len(found) == len(urls)
    assert (found[0].host, found[0].path, found[0].rule, found[0].verdict) == ("a.example.com", "/en/7", "example.com/en/7", "allow")
    assert [found[k].rule for k in (1, 2, 3, 4, 5, 6, 7, 8, 10)] == ["com/en/", "net/de/", "example.net/de/8", "org/es/", None, None, None, None, "com/en/"]
    assert [(found[k].host, found[k].path) for k in (5, 6, 7, 8)] == [("", ""), ("", ""), ("", ""), ("h", "")]
    assert found[9].template == "/*/*/*/**"
    assert url_filter.filter_urls(pages.limit(0), spark.createDataFrame([], "page_id long, bad int")).count() == 0


def test_bad_branches_are_rejected(spark):
    rows = [(k, f"http://h.de/{'spam' if k % 2 else 'news'}/{k}") for k in range(200)]
    pages, bad = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([(k, k % 2) for k in range(100)], "page_id long, bad int")
    found = url_filter.filter_urls(pages, bad).collect()
    assert {(r.template, r.verdict) for r in found} == {("/spam/*", "block"), ("/news/*", "allow")}


def test_alike_branches_are_merged(spark):
    kinds = ["spam", "junk", "news", "blog", "misc"]
    bad_share = {"spam": 8, "junk": 8, "news": 0, "blog": 0, "misc": 4}
    rows = [(k, f"http://h.de/{kinds[k % 5]}/{k}") for k in range(1000)] + [(2000 + k, "http://h.de/777/x") for k in range(40)]
    labels = [(k, int(k // 5 % 10 < bad_share[kinds[k % 5]])) for k in range(1000)] + [(2000 + k, 1) for k in range(40)]
    pages, bad = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int")
    found = {r.page_id: r for r in url_filter.filter_urls(pages.union(pages.filter("page_id < 5")), bad).collect()}
    templates = {kind: {found[k].template for k in range(1000) if kinds[k % 5] == kind} for kind in kinds}
    assert templates == {"spam": {"/junk#1/*"}, "junk": {"/junk#1/*"}, "news": {"/blog#1/*"}, "blog": {"/blog#1/*"}, "misc": {"/*/*"}}
    # a number is a branch like any other if it has the counts
    assert found[2000].template == "/777/*" and [found[k].verdict for k in range(3)] == ["block", "block", "allow"]


def test_urls_of_one_very_common_host_and_path(spark):
    rows = [(k % 700, "http://h.de/a/1" if k % 3 else f"http://h.de/a/{k}") for k in range(900)] + [(k, f"http://x{k}.de/") for k in range(1000, 1100)]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'mine' AS template", "'mine' AS host", "0 AS n", "1 AS rows").repartition(7)
    bad = spark.createDataFrame([(k, k % 2) for k in range(0, 700, 5)], "page_id long, bad int")
    found = url_filter.filter_urls(pages, bad).collect()
    assert len(found) == len(rows) and sorted(r.page_id for r in found) == sorted(k for k, _ in rows)


def test_branches_below_the_third_level(spark):
    rows = [(k, f"http://h.de/a/b/c/{k}/{'spam' if k % 2 else 'news'}/{k}/x/y") for k in range(200)] + [(500, "http://h.de/a/b/c"), (501, "http://k.de/a/b/c/d/e")]
    pages, bad = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([(k, k % 2) for k in range(100)], "page_id long, bad int")
    found = {r.page_id: (r.template, r.verdict) for r in url_filter.filter_urls(pages, bad).collect()}
    assert len(found) == len(rows) and found[500][0] == "/*/*/*" and found[501][0] == "/*/*/*/**"
    assert all(found[k] == (("/*/*/*/*/spam/*/*/*", "block") if k % 2 else ("/*/*/*/*/news/*/*/*", "allow")) for k in range(200))


def test_subtrees_are_the_same_in_one_task_and_level_by_level(spark):
    import random

    from tidemark.llm.url_filter import template_verdicts

    rng = random.Random(11)
    rows = []
    for k in range(400):
        depth = rng.choice([2, 4, 5, 6, 7])
        segments = [rng.choice(["a", "b"]) if at < 3 else rng.choice(["shop", "news", "spam", "*", str(k), "é"]) for at in range(depth)]
        bad = None if rng.random() < 0.2 else int(("spam" in segments) ^ (rng.random() < 0.1))
        rows.append(("h" if k % 5 else "g", "/" + "/".join(segments), bad))
    rows += [("trap", "/" + "/".join(["x"] * 300), None)] * 8
    df = spark.createDataFrame(rows, "host string, path string, bad int").repartition(3)
    local, levels = (sorted(map(tuple, template_verdicts(d, whole).collect()), key=str) for d, whole in ((df, 1_000_000), (df.filter("host <> 'trap'"), 0)))
    assert [r for r in local if r[0] != "trap"] == levels and {r[3] for r in local if r[0] == "trap"} == {"/*" * 300}
    assert len({r[3] for r in local}) > 15
