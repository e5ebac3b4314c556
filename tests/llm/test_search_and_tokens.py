import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm import cases
from vellumgrid.llm import bpe, topk

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def test_tokens_equal_the_library(spark):
    lib = Tokenizer.from_file(VOCABULARY)
    got = bpe.encode_documents(cases.docs(spark), VOCABULARY, keep_ids=True).collect()
    want = []
    for r in cases.rows():
        ids = lib.encode(r[1] or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), ids, text))
    assert cases.multiset(tuple(r) for r in got) == cases.multiset(want)
    assert bpe.encode_documents(cases.empty(spark), VOCABULARY).count() == 0


def test_random_texts_equal_the_library():
    lib, machine, rnd = Tokenizer.from_file(VOCABULARY), bpe.compile_merges(VOCABULARY).ready(), random.Random(5)
    texts = ["".join(rnd.choice("aabcdeinthst  '0123é\n=-_/😀ß 　") for _ in range(rnd.randint(1, 200))) for _ in range(1500)]
    texts += ["a" * 300, " " * 90 + "x", "<|endoftext|><|endoftext|>", "<|endo<|endoftext|>", "it's WE'LL", "\x1c\x1d a\x85b"]
    for x, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False)):
        ids = machine.encode(x)
        assert ids.tolist() == e.ids and machine.decode(ids) == x


def test_small_automaton(tmp_path):
    """Merges ab, then bc, then aba: the sequences that it accepts are those of the merges in order."""
    import json

    letters = {v: k for k, v in bpe.byte_letters().items()}
    vocab = {letters[b]: b for b in range(256)} | {"ab": 256, "bc": 257, "aba": 258, "aa": 259}
    spec = {"added_tokens": [], "model": {"vocab": vocab, "merges": ["a b", "b c", "ab a", "a a"]}}
    path = tmp_path / "v.json"
    path.write_text(json.dumps(spec))
    machine = bpe.compile_merges(str(path)).ready()
    from itertools import product

    def merged(word):
        parts = list(word)
        for m in ("a b", "b c", "ab a", "a a"):
            u, v = m.split()
            out = []
            for x in parts:
                if out and out[-1] == u and x == v:
                    out[-1] = u + v
                else:
                    out.append(x)
            parts = out
        return parts

    for n in range(1, 7):
        for w in map("".join, product("abc", repeat=n)):
            assert [machine.labels[t].decode() for t in machine.read(w.encode())] == merged(w), w


def brute(rows):
    ok = [(i, np.floor(256 * np.array(v, float))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if i % 50 == 0}):
        a = next(v for i, v in ok if i == q)
        scored = sorted((-int(a[: len(v)] @ v[: len(a)]), i) for i, v in ok if i != q)[:5]
        out += [(q, k, i, -s) for k, (s, i) in enumerate(scored, 1)]
    return out


@pytest.mark.parametrize("shard", [7, 64])
def test_top_k(spark, shard):
    rnd = random.Random(2)
    rows = [(k, [rnd.uniform(-1, 1) for _ in range(8)]) for k in range(210)]
    rows += [(k, rows[3][1]) for k in range(300, 320)] + [(400, None), (401, [1.0, None] + [0.0] * 6), (402, [float("nan")] + [0.0] * 7), (403, [float("inf")] + [0.0] * 7), (None, rows[0][1]), (500, [0.5, 0.25]), (501, [])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, score string").repartition(3)
    exact = [(r.vec_id, r.embedding) for r in df.collect()]
    assert cases.multiset(tuple(r) for r in topk.top_k(df, tile=3, shard=shard).collect()) == cases.multiset(brute(sorted(exact, key=lambda r: (r[0] is None, r[0] or 0))))
    assert topk.top_k(df.limit(0)).count() == 0
