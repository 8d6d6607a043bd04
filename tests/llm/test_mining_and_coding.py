"""Hard negatives, forced-boundary BPE and collocations against brute force and the library; odd rows and empty tables."""

import hashlib
import random
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from canopy.llm import collocations, forced_bpe, hard_negatives
from canopy.llm import queries as Q
from tests.conftest import SF
from tests.llm.test_text_operators import odd, texts  # noqa: F401

BPE = P.path("byte_bpe_50k.json")


def brute_negatives(rows, positives=5, negatives=5, low=80, high=100):
    rows = [(i, label, [int(np.floor(256 * float(x))) for x in v]) for i, label, v in rows if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (i, label, v) in enumerate(rows):
        if i % 10:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), j, other == label) for n, (j, other, w) in enumerate(rows) if n != at)
        for score, j, _ in [s for s in scored if s[2]][:positives]:
            fit = [s for s in scored if not s[2] and low * -score <= 100 * -s[0] <= high * -score][:negatives]
            out += [(i, j, rank, k, -score, -s) for rank, (s, k, _) in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(8192, 4096), (7, 3)])
def test_op11_agrees_with_brute_force(spark, blocks):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(3, 6))
    rows = [(n, int(rng.integers(0, 3)), (centres[n % 3] + 0.3 * rng.normal(size=6)).round(1).tolist()) for n in range(90)]
    rows += [rows[10], rows[10], rows[33], (200, None, [1.0] * 6), (210, 1, None), (220, 1, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (230, 1, [1.0, float("nan")] * 3), (240, 1, [float("inf")] * 6), (250, 2, [1.0, 2.0]), (260, 2, []), (None, 1, [1.0] * 6)]
    df = spark.createDataFrame(rows, "id long, label int, vector array<float>").withColumns({c: F.lit("x") for c in ("anchor", "block", "pos", "score", "copies", "p")})
    narrow = spark.createDataFrame([(i, label, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, label, v in rows], "id long, label int, vector array<double>")
    got = hard_negatives.mine(df, F.col("id") % 10 == 0, rows_block=blocks[0], anchors_block=blocks[1])
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    wanted = brute_negatives([tuple(r) for r in narrow.collect()])
    assert len(wanted) > 100 and sorted(map(tuple, got.collect())) == wanted


def test_op11_ties_few_rows_and_empty(spark):
    rows = [(n, n % 2, [0.5, 0.25]) for n in range(40)]
    df = spark.createDataFrame(rows, "id long, label int, vector array<float>")
    assert sorted(map(tuple, hard_negatives.mine(df, F.col("id") % 10 == 0, rows_block=4).collect())) == brute_negatives(rows)
    few = df.where("id in (0, 1, 2)")
    assert sorted(map(tuple, hard_negatives.mine(few, F.col("id") % 10 == 0).collect())) == brute_negatives(rows[:3])
    assert hard_negatives.mine(df.limit(0), F.col("id") % 10 == 0).count() == 0
    assert hard_negatives.mine(df, F.lit(None).cast("boolean")).count() == 0


def test_op11_large_components_stay_exact(spark):
    rows = [(n, n % 2, [float(2**33 + n), float(-(2**21) * n)]) for n in range(12)]
    df = spark.createDataFrame([(i, c, [x / 2**16 for x in v]) for i, c, v in rows], "id long, label int, vector array<double>")
    assert sorted(map(tuple, hard_negatives.mine(df, F.col("id") % 10 == 0).collect())) == brute_negatives([(i, c, [x / 2**16 for x in v]) for i, c, v in rows])


def test_op11_bounds_hold_and_spare_scores():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(4, 16)) * 300
    rows, anchors = (np.floor(centres[rng.integers(0, 4, n)] + rng.normal(size=(n, 16)) * 10).astype(np.int64) for n in (2000, 60))
    order, parent, length = hard_negatives.spanning_tree(anchors)
    far = np.sqrt(((anchors[:, None] - anchors[None]) ** 2).sum(2))
    assert sum(length) == pytest.approx(sum(sorted_tree(far)))
    scores, exact = hard_negatives.Scores(rows, anchors, SimpleNamespace(order=order, parent=parent, length=length)), rows @ anchors.T
    for at in scores.order:
        least = np.partition(exact[:, at], -20)[-20]

        def wanted(low, high, at=at, least=least):
            assert (low <= exact[:, at]).all() and (exact[:, at] <= high).all()
            return high >= least

        found, own = scores.at(at, wanted)
        assert (own == exact[found, at]).all() and set(np.flatnonzero(exact[:, at] >= least)) <= set(found)
    assert scores.scored < 0.5 * exact.size and not scores.known


def sorted_tree(far):
    """Kruskal's edge lengths."""
    root = list(range(len(far)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d, i, j in sorted((far[i, j], i, j) for i in range(len(far)) for j in range(i)):
        if find(i) != find(j):
            root[find(i)] = find(j)
            yield d


def test_op12_agrees_with_the_library(spark, texts):  # noqa: F811
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    got = {r.doc_id: r for r in Q.op12_forced_bpe(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), *digests)


ALPHABET = ["a", "é", "'", "'s", "'re", "l", "1", "½", " ", "  ", "\n", "\t", " ", " ", "　", "\x85", "\x1c", "!", "<|endoftext|>", "<|", "日", "本", "🙂", "́", "don't", "!'s", "ſ", "ﬁ"]


def test_op12_cuts_change_nothing():
    from tokenizers import Tokenizer

    library, own, rng = Tokenizer.from_file(BPE), forced_bpe.Coder(BPE), random.Random(3)
    for _ in range(8000):
        text = "".join(rng.choices(ALPHABET, k=rng.randint(0, 14)))
        ids = np.frombuffer(own.encode(text.encode()), np.int32)
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text
        assert own.decode(ids) == text
    raw = "été, don't\n日本 <|endoftext|> xyz's ".encode() * 50
    assert b"".join(own.fragments(raw)) == raw and len(own.fragments(raw)) > 200
    assert b"".join(forced_bpe.parts_of(raw, own.cuts(raw), 64)) == raw


def test_op12_long_and_odd_texts(spark, odd):  # noqa: F811
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    wanted = sorted((t or "", library.encode(t or "", add_special_tokens=False).ids) for t in (r.text for r in odd.collect()))
    for settings in ({}, {"long_chars": 10, "part": 32}):
        rows = forced_bpe.encode(odd, BPE, **settings).collect()
        assert sorted((r.decoded, r.ids) for r in rows) == wanted
        assert all(r.n_tokens == len(r.ids) for r in rows)
    assert forced_bpe.encode(odd.limit(0), BPE).count() == 0


def brute_collocations(docs, most=5, least=100, top=2000):
    counts, total = defaultdict(Counter), Counter()
    import re

    for lang, text in docs:
        lang = "und" if lang is None else lang
        plain = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", plain):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, most + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        often = {p: n for p, n in f.items() if len(p) > 1 and n >= least}
        parts = {p[i:j] for p, n in often.items() for i in range(len(p)) for j in range(i + 1, len(p) + 1) if j - i < len(p) and 100 * n >= 100 * f[p[i:j]]}
        scored = []
        for p, a in often.items():
            if p not in parts:
                score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, total[lang], -score) for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("bits, held", [(2**26, 2_000_000), (2**12, 50)])
def test_op13_agrees_with_brute_force(spark, monkeypatch, bits, held):
    rng = random.Random(2)
    words = ["A", "b", "c", "É", "日本", "x y", "z'", "\x00", "--"]
    docs = [(rng.choice(["en", "fr", None, "und", ""]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for _ in range(rng.randint(0, 60)))) for _ in range(120)]
    docs += [("en", "Of one piece and no more of it, " * 30), ("en", None), (None, ""), docs[3], docs[3]]
    df = spark.createDataFrame(docs, "lang string, text string").withColumns({c: F.lit(1) for c in ("phrase", "n", "h", "words", "f", "k", "score", "salt")}).repartition(5)
    monkeypatch.setattr(collocations.by_language, "__defaults__", None)
    monkeypatch.setattr(collocations.pair_counts, "__defaults__", (held,))
    monkeypatch.setattr(collocations.edges, "__defaults__", (held,))
    for least, top in ((2, 2000), (7, 5)):
        got = collocations.collocations(df, min_count=least, top=top, bits=bits)
        assert sorted(map(tuple, got.collect())) == brute_collocations(docs, least=least, top=top)


def test_op13_products_pass_64_bits(spark):
    runs = spark.createDataFrame([("en", "a b", 3 * 10**9), ("en", "a", 7 * 10**9), ("en", "b", 5 * 10**9)], "lang string, phrase string, n long")
    counts = {r.phrase: r.f for r in collocations.flows(runs, 5, 100).collect()}
    assert counts == {"a b": 3 * 10**9, "a": 10**10, "b": 5 * 10**9}


def test_op13_empty_and_odd(spark, odd):  # noqa: F811
    assert collocations.collocations(odd.limit(0)).count() == 0
    assert collocations.collocations(odd.withColumn("text", F.lit(None).cast("string"))).count() == 0
    rows = [(r.lang, r.text) for r in odd.collect()]
    assert sorted(map(tuple, collocations.collocations(odd).collect())) == brute_collocations(rows)
