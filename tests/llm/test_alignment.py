import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("tokenizers")
pytest.importorskip("sentencepiece")
import public_tokenizers  # noqa: E402

from tidemark.llm import token_alignment as T  # noqa: E402
from tidemark.llm.registry import QUERIES  # noqa: E402
from tidemark.llm.token_alignment import align_tokens, common_ends, parts_of  # noqa: E402

A, B = (str(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def plain(texts):
    """The definition, text by text, from offsets in whole texts."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer, decoders

    a_model, b_model, decoder = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B), decoders.ByteLevel()
    a_model.encode_special_tokens = True
    names = {chr(c): c for c in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    rest = iter(range(256, 512))
    for c in range(256):
        if c not in names.values():
            names[chr(next(rest))] = c
    assert decoder.decode(["Ġthe"]) == " the"
    docs, count = [], Counter()
    for text in texts:
        groups = []
        if text:
            a, b = a_model.encode(" " + text, add_special_tokens=False), b_model.encode(text)
            raw_a = [bytes(names[c] for c in t) for t in a.tokens]
            raw_b = [bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b_model.id_to_piece(i)) for i in b)]
            if b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
                ends = [{sum(map(len, raw[: k + 1])): k for k in range(len(raw))} for raw in (raw_a, raw_b)] if len(text) < 3000 else None
                if ends is None:
                    ends = []
                    for raw in (raw_a, raw_b):
                        at, own = 0, {}
                        for k, t in enumerate(raw):
                            at += len(t)
                            own[at] = k
                        ends.append(own)
                i = j = 0
                for e in sorted(set(ends[0]) & set(ends[1])):
                    groups.append((a.ids[i : ends[0][e] + 1], b[j : ends[1][e] + 1]))
                    i, j = ends[0][e] + 1, ends[1][e] + 1
        links = Counter((x, y) for g, h in groups for x in g for y in h)
        count.update(links.keys())
        docs.append((groups, links))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for groups, links in docs:
        digest = hashlib.sha256(";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups).encode()).hexdigest() if groups else ""
        sizes = (sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), sum(links.values()))
        out.append((*sizes, sum(n for p, n in links.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in links.items()), digest))
    return out


def rows_of(found):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in found.collect())


def test_galloping_finds_every_common_end():
    rng = random.Random(5)
    a, b, many_a, many_b, expected, base = [], [], [], [], [], 0
    for n, m in [(5, 150), (150, 5), (0, 9), (9, 0), (0, 0), (40, 40)] * 60:
        x, y = (sorted(rng.sample(range(200), rng.randint(0, k))) for k in (n, m))
        expected += [(len(a) + x.index(e), len(b) + y.index(e)) for e in sorted(set(x) & set(y))]
        a, b, base = a + [base + e for e in x], b + [base + e for e in y], base + 200
        many_a.append(len(x))
        many_b.append(len(y))
    i, j = common_ends(*(np.array(x, np.int64) for x in (a, many_a, b, many_b)))
    assert list(zip(i.tolist(), j.tolist())) == expected


def test_pairs_of_large_groups_are_counted(monkeypatch):
    model = T.Aligner(A, B)
    parts = ["日本語のテキスト漢字かな", "aaaa", "", "𝒳𝒴𝒵𝒳𝒴𝒵"]
    whole = model.align(parts)
    monkeypatch.setattr(T, "_LARGE", 1)
    split = model.align(parts)

    def per_part(x):
        stops = np.cumsum(x.sizes)
        return [sorted(Counter({p: int(x.times[lo:hi][x.pairs[lo:hi] == p].sum()) for p in x.pairs[lo:hi]}).items()) for lo, hi in zip(stops - x.sizes, stops)]

    assert per_part(whole) == per_part(split) and sum(n for p in per_part(split) for _, n in p) == split.counts[:, 3].sum()


@pytest.mark.parametrize("text", ["a b", " a", "a ", "a  b", "  ", "\n\n x  y \n", "a b c "])
def test_parts_join_to_the_text(text):
    assert " " + " ".join(parts_of(text)) == " " + text and all(parts_of(text))


EXTRA = ["a▁b c", "  two  leading", "trailing ", " ", "\t\t x", "<s> <unk> <0x41> </s> <|endoftext|>", "日本語のテキスト と 漢字", "naïve 😀😀 café", "\x00 nul", "x▁ ▁ y"]


@pytest.mark.parametrize("limits", [(16 << 20, 1_000_000), (2000, 50)])
def test_alignment_is_the_definition(spark, odd, texts, limits):
    rows = [(r.doc_id, r.text) for r in odd.collect()] + texts + [(900_000 + k, t) for k, t in enumerate(EXTRA)]
    expected = sorted((i if i is not None else -1, *x) for (i, _), x in zip(rows, plain([t for _, t in rows])))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_a", "'p' AS part", "2 AS own").repartition(3)
    assert rows_of(align_tokens(df, A, B, *limits)) == expected


def test_nothing_aligns_to_nothing(nothing):
    assert align_tokens(nothing, A, B).count() == 0


def test_query_as_registered(spark, sf, texts):
    found = QUERIES["op11_token_alignment"](spark, sf)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert rows_of(found) == sorted((i, *x) for (i, _), x in zip(texts, plain([t for _, t in texts])))
