"""Every corpus query as it is registered: its columns, their types, and their values against the definition, over the whole of a small table."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("tokenizers")
import public_tokenizers  # noqa: E402
import xxhash  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from tidemark.llm.registry import ORACLE_SQL, QUERIES  # noqa: E402


def rows_of(spark, sf, name, *columns):
    """The query's rows, after a check of its first columns (name and type)."""
    found = QUERIES[name](spark, sf)
    assert found.dtypes[: len(columns)] == [tuple(c.split()) for c in columns]
    return found.collect()


@pytest.mark.parametrize("name", ["op1_url_filter", "op6_decontamination"])
def test_rows_are_those_of_the_sql(spark, sf, name):
    import duckdb

    db = duckdb.connect()
    for table in ("pages", "labels", "documents", "benchmark"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    found = QUERIES[name](spark, sf)
    columns = {"op1_url_filter": ["page_id", "host", "path", "rule", "verdict"], "op6_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]}[name]
    assert found.columns[: len(columns)] == columns
    expected = db.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert Counter(map(tuple, found.select(*columns).collect())) == Counter(expected)


def test_op2(spark, sf, texts):
    found = rows_of(spark, sf, "op2_suffix_dedup", "doc_id bigint", "n_bytes bigint", "n_removed bigint", "n_spans bigint", "kept_sha256 string")
    raw = [(i, (t or "").encode()) for i, t in texts]
    count = Counter(hash(b[k : k + 200]) for _, b in raw for k in range(len(b) - 199))
    expected = []
    for i, b in raw:
        covered = np.zeros(len(b) + 1, int)
        for k in range(len(b) - 199):
            if count[hash(b[k : k + 200])] > 1:
                covered[k] += 1
                covered[min(k + 200, len(b))] -= 1
        gone = np.cumsum(covered)[: len(b)] > 0
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        expected.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    assert sorted(tuple(r)[:5] for r in found) == sorted(expected)


def test_op3(spark, sf, texts):
    found = rows_of(spark, sf, "op3_mixing", "doc_id bigint")
    assert sorted(r.doc_id for r in found) == sorted(i for i, _ in texts)
    assert all(0 <= r.probability <= 1 and r.weight >= 0 for r in found) and 0 < sum(r.kept for r in found) < len(found)


def test_op4(spark, sf, texts):
    found = {r.doc_id: r for r in rows_of(spark, sf, "op4_fingerprints", "doc_id bigint", "n_chars bigint", "edited_sha256 string", "fingerprint string", "edited_fingerprint string", "near_edited double", "near_next double")}
    order = sorted(((i, t or "") for i, t in texts), reverse=True)
    prints = defaultdict(set)
    for (i, t), (_, after) in zip(order, [*order[1:], order[0]]):
        half = len(t) // 2
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and (t != after or r.near_next == 1)
        prints[t].add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values()) and len(set.union(*prints.values())) == len(prints) and len(found) == len(texts)


def test_op5(spark, sf, texts):
    found = rows_of(spark, sf, "op5_token_output", "doc_id bigint", "start bigint", "n_tokens bigint", "ids_crc32 bigint")
    model, at, expected = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json"))), 0, []
    for i, t in sorted(texts):
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        expected.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(tuple(r)[:4] for r in found) == expected


def test_op7(spark, sf, texts):
    found = {r.doc_id: r for r in rows_of(spark, sf, "op7_simhash", "doc_id bigint", "fingerprint string", "component_id bigint")}
    prints = {}
    for i, t in texts:
        words = (t or "").encode().lower().split()
        grams = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) > 3 else [b" ".join(words)] if words else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0
    ids, label = sorted(prints), {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (prints[a] ^ prints[b]).bit_count() <= 3 and label[a] < label[b]:
                    label[b], changed = label[a], True
    assert {i: (f"{p:016x}", label[i]) for i, p in prints.items()} == {i: (r.fingerprint, r.component_id) for i, r in found.items()}


def test_op8(spark, sf, texts):
    found = rows_of(spark, sf, "op8_toxicity", "doc_id bigint", "held_out boolean", "score double", "predicted int")
    assert sorted(r.doc_id for r in found) == sorted(i for i, _ in texts)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)


def test_op10(spark, sf, docs):
    found = rows_of(spark, sf, "op10_language_id", "doc_id bigint", "held_out boolean", "lang_pred string", "score double")
    rows = {r.doc_id: r for r in docs.collect()}
    learned = {r.lang for r in rows.values() if r.lang and zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    hits = []
    for r in found:
        text = rows[r.doc_id].text or ""
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text)) and r.lang_pred in learned | {"und"}
        hits += [r.lang_pred == rows[r.doc_id].lang] if r.held_out and rows[r.doc_id].lang and r.lang_pred != "und" else []
    assert len(found) == len(rows) and np.mean(hits) > 0.95


def test_the_pipeline_takes_odd_and_empty_tables(spark, sf, odd, nothing, tmp_path):
    import shutil

    import corpus_pipeline

    for name, df, kept in (("odd", odd, None), ("none", nothing, 0)):
        folder = tmp_path / name
        folder.mkdir()
        df.write.parquet(str(folder / "documents.parquet"))
        for table in ("benchmark", "labels"):
            shutil.copy(f"{sf}/{table}.parquet", folder / f"{table}.parquet")
        docs, before = spark.read.parquet(str(folder / "documents.parquet")), None
        for step, (_, stage) in enumerate(corpus_pipeline.STAGES):
            columns = docs.columns
            stage(spark, docs, str(folder)).write.parquet(str(folder / f"stage{step}"))
            docs = spark.read.parquet(str(folder / f"stage{step}"))
            assert step == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
            assert before is None or docs.count() <= before
            before = docs.count()
        assert kept is None or before == kept
