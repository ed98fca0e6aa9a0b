import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lociweave.llm import harmonic_pack, token_matrix, tokens

D = "doc_id long, text string, ids string, start long, offset long"
TEXTS = [
    None, "", " ", "  two  spaces ", "a", "plain words here, and more.", "line\n\n  indented\n\tx\n", "été   x y z", "<|endoftext|> inside <|endoftext|>", "don't we'll I'd",
    "中文 文字", "x" * 30_000, "word " * 9000, "a\r\nb \r\n c", " lead", "trail ", "\U0001f600 \U0001f600\U0001f600", "1234 56  78",
]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_vocabulary())
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


def rows(extra=()):
    return [(i if i % 5 else None, t, "x", 1, 2) for i, t in enumerate([*TEXTS, *extra])]


def test_ids_are_those_of_the_whole_text(reference):
    e = tokens.Encoder(tokens.default_vocabulary())
    r = random.Random(5)
    mixed = ["".join(r.choice(["a", "Bc", " ", "  ", "\n", "\t", "1", ".", "é", " ", "'s"]) for _ in range(60)) for _ in range(300)]
    for t in [*TEXTS, *mixed]:
        assert np.frombuffer(e.ids(t or ""), "<u4").tolist() == reference(t), repr(t)


def test_other_vocabularies_run_by_their_own_library():
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    e = tokens.Encoder(path)
    assert e.ids("Some words, here") == e.plain_ids("Some words, here") and e._fast is None


def check_pieces(pieces, want, capacity):
    by_seq, got = defaultdict(list), defaultdict(dict)
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u4")
        assert len(ids) == p["length"] > 0 and zlib.crc32(p["ids"]) == p["ids_crc32"]
        by_seq[p["sequence_id"]].append((p["offset"], p["length"]))
        got[p["doc_id"], p["doc_tokens"]][p["start"]] = ids
    padded = 0
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
        padded += 0 if at & (at - 1) == 0 else capacity - at
    return got, padded, sum(map(len, want))


def test_pieces_hold_every_id_once(spark, reference):
    r = random.Random(6)
    many = [" ".join(r.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(r.randrange(900))) for _ in range(150)]
    table = [(i, t) for i, t in enumerate([*TEXTS, *many])]
    pieces = harmonic_pack.pack(spark.createDataFrame([(i, t, "x", 1, 2) for i, t in table], D).repartition(3)).collect()
    want = [[*reference(t), 0] for _, t in table]
    got, padded, total = check_pieces(pieces, want, 1024)
    assert padded < 0.02 * total
    for (i, n), parts in got.items():
        assert n == len(want[i]) and np.concatenate([parts[k] for k in sorted(parts)]).tolist() == want[i]
        at = 0
        for k in sorted(parts):
            assert k == at
            at += len(parts[k])
    assert {i for i, _ in got} == {i for i, _ in table}


def test_cuts():
    for n in range(1, 5000, 7):
        pieces = harmonic_pack.cut(n, 1024, 6)
        assert sum(x for x, _ in pieces) == n and all(0 < x <= 1024 // k for x, k in pieces) and len(pieces) <= n // 1024 + 6


def test_no_rows_and_odd_capacity(spark):
    empty = spark.createDataFrame([], D)
    assert harmonic_pack.pack(empty).count() == 0 and token_matrix.token_matrix(empty).count() == 0
    with pytest.raises(ValueError):
        harmonic_pack.pack(empty, capacity=1000)


def plain_bfd(lengths, capacity):
    bins, free = [], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fit = [f for f in free if f >= lengths[i]]
        if fit:
            k = max(k for k, f in enumerate(free) if f == min(fit))
        else:
            bins.append([])
            free.append(capacity)
            k = len(bins) - 1
        bins[k].append(i)
        free[k] -= lengths[i]
    return bins, free


def test_best_fit_decreasing():
    r = random.Random(7)
    for _ in range(60):
        capacity = r.choice((1, 7, 64, 100))
        lengths = [r.randint(1, capacity) for _ in range(r.randrange(80))]
        bins = token_matrix.best_fit_decreasing(lengths, capacity)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        # bins of one free capacity are alike, so only how full the bins are is defined
        assert sorted(capacity - sum(lengths[i] for i in b) for b in bins) == sorted(plain_bfd(lengths, capacity)[1])


def test_matrix_round_trip(spark, reference, tmp_path):
    table = rows(["extra text " * 50] * 3)
    token_matrix.write_token_matrix(spark.createDataFrame(table, D).repartition(2), str(tmp_path / "m"), block_tokens=9000)
    out, docs = spark.read.parquet(str(tmp_path / "m")).collect(), defaultdict(dict)
    for s in out:
        ids = np.frombuffer(s["ids"], "<u2")
        assert len(ids) == 2048 and s["cu_seqlens"][0] == 0 and s["cu_seqlens"][-1] == s["n_tokens"] and (ids[s["n_tokens"] :] == 50256).all()
        assert s["position_resets"] == s["cu_seqlens"][:-1] and s["n_segments"] == len(s["doc_ids"])
        for k, (doc, row, start) in enumerate(zip(s["doc_ids"], s["doc_rows"], s["starts"])):
            docs[doc, row][start] = ids[s["cu_seqlens"][k] : s["cu_seqlens"][k + 1]]
    assert len({s["sequence_id"] for s in out}) == len(out)
    got = sorted([doc, *np.concatenate([p[k] for k in sorted(p)]).tolist()] if doc is not None else [-1, *np.concatenate([p[k] for k in sorted(p)]).tolist()] for (doc, _), p in docs.items())
    assert got == sorted([-1 if i is None else i, *reference(t), 50256] for i, t, *_ in table)
