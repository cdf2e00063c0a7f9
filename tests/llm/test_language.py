"""Spelling variants, hard negatives and the hidden Markov model against
plain versions on small hard tables."""

import itertools
import math
import random
import re
from collections import Counter
from zlib import crc32

import brute
import numpy as np
import pyarrow as pa
import pytest
from made import SCHEMA, clashing, documents, items, made_documents, ordered  # noqa: F401
from pyspark.sql import functions as F

from tessera.llm import hard_negatives, hmm, spelling

PAIRS = [r[:2] for r in made_documents()]


# --- spelling ----------------------------------------------------------------

def plain_counts(docs, damage=97, chars=5, least=3):
    n = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(brute.UP)
            h = crc32(f"{d}:{w}".encode())
            n[w if d is None or not damage or h % damage else w[:h % len(w)] + w[h % len(w) + 1:]] += 1
    return {w: k for w, k in n.items() if len(w) >= chars and k >= least}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(n, ratio=2):
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w
    return [(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n]


def spelling_documents():
    r = random.Random(9)
    base = ["".join(r.choice("abcdé") for _ in range(r.randint(4, 9))) for _ in range(60)]
    rows = [(i, " ".join(r.choice(base) for _ in range(60)).upper() if i % 5 == 0 else " ".join(r.choice(base) for _ in range(90)),
             "en", "a", 1) for i in range(120)]
    rows += [(500 + i, w[:i % len(w)] + r.choice("xyz") + w[i % len(w):] + " " + w[1:] + "1" + w[:-1], "en", "a", 1)
             for i, w in enumerate(base * 4)]
    rows += [(900, "aaaaaa aaaaaaa " * 4 + "aaaaaaaa " * 9 + "q" * 3000 + " " + ("q" * 2999 + " ") * 6 + ("q" * 3000 + " ") * 2, "en", "a", 1)]
    return rows + made_documents()


def test_spelling_variants(spark):
    rows = spelling_documents()
    docs = spark.createDataFrame(rows, SCHEMA).select("*", F.lit(1).alias("word"), F.lit(2).alias("n"), F.lit(3).alias("near")).repartition(4)
    got = spelling.variants(docs, damage=97)
    want = plain_variants(plain_counts([r[:2] for r in rows]))
    assert ordered(got.collect()) == ordered(want)
    assert sum(w[1] is not None for w in want) > 20 and any(w[2] != (w[1] or w[0]) for w in want)
    assert ("q" * 3000, "q" * 2999, "q" * 2999, 3, 1, 6) in want


@pytest.mark.parametrize("most", [32, 1 << 20])
def test_spelling_is_exact_however_small_the_filter(spark, most):
    """One block a length at most: nearly every edit passes the filter, and
    the join throws it out."""
    n = plain_counts([r[:2] for r in spelling_documents()[:200]], damage=None)
    words = spark.createDataFrame([(w, k) for w, k in n.items() if len(w) < 20], "word string, n long")
    assert ordered(spelling.grouped(words, most=most).collect()) == ordered(plain_variants({w: k for w, k in n.items() if len(w) < 20}))


def test_spelling_bloom_shards_by_length(spark):
    words = spark.createDataFrame([("w" * k, 3) for k in (5, 6, 64, 65, 66, 5000)], "word string, n long")
    blocks, table = spelling.bloom(words, 1 << 16)
    assert sorted(blocks.at) == sorted({int(spelling.shard(k)) for k in (5, 6, 64, 65, 66, 5000)})
    assert table.nbytes <= 1 << 16
    for k in (5, 6, 64, 5000):
        assert len(spelling._inside(spelling._hash(spelling.letters(["w" * k])), blocks.of(k), table)) == 1
    assert not len(spelling._inside(spelling._hash(spelling.letters(["v" * 5])), blocks.of(5), table))


def test_spelling_empty(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "12 34")], "doc_id long, text string")
    assert spelling.variants(docs).collect() == []
    assert spelling.variants(docs.limit(0)).collect() == []


# --- hard negatives ------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(n=420, dims=13, seed=4):
    r = random.Random(seed)
    centre = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(4)]
    rows = [(i, [float(np.float32(c + r.gauss(0, 0.8))) for c in centre[i % 4]], i % 3) for i in range(n)]
    rows += [(1000, None, 1), (1050, [0.0] * dims, None), (None, [1.0] * dims, 1), (1100, [1.0] * 5, 2), (1150, [], 1),
             (1200, [None] + [1.0] * (dims - 1), 1), (1250, [float("nan")] * dims, 1), (1300, [float("inf")] + [0.0] * (dims - 1), 1),
             (1350, [300.0] + [-2.0] * (dims - 1), 0), (1400, [0.0] * dims, 2)]
    rows += [(2000 + i, rows[50][1], i % 2) for i in range(40)]         # ties
    return rows + rows[20:60] + rows[-5:]                              # repeated rows


def plain_negatives(rows, every=50, positives=5, negatives=3):
    own = {}
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            own[i, label, tuple(math.floor(256 * x) for x in v)] = None
    out = []
    for a, al, av in own:
        if a % every:
            continue
        scores = sorted({(-sum(x * y for x, y in zip(av, bv)), b, bl) for b, bl, bv in own if b != a})
        for ps, p, _ in [s for s in scores if s[2] == al][:positives]:
            ps = -ps
            hard = [s for s in scores if s[2] != al and 50 * ps <= -100 * s[0] <= 95 * ps][:negatives]
            out += [(a, p, k + 1, n, ps, -s) for k, (s, n, _) in enumerate(hard)]
    return out


def test_hard_negatives(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, VECTORS).select("*", *[F.lit(1).alias(c) for c in ("id", "q", "x", "list", "score", "rank", "planes")])
    want = plain_negatives(rows)
    assert ordered(hard_negatives.mined(df.repartition(5)).collect()) == ordered(want)
    assert len(want) > 60


def test_hard_negatives_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHORS", 5)
    for name, value in (("LANES", 2), ("ROWS", 7), ("BLOCK", 16), ("HELD", 1)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = vectors(150)
    assert ordered(hard_negatives.mined(spark.createDataFrame(rows, VECTORS), every=30).collect()) == ordered(plain_negatives(rows, 30))


def test_subset_sum_tables_give_exact_products():
    r = np.random.default_rng(3)
    for dims, most in ((1, 1), (8, 100), (13, 40_000), (64, 1 << 29), (3, 1 << 40)):
        q, anchors = r.integers(-most, most, (50, dims)), r.integers(-most, most, (9, dims))
        layout = hard_negatives.Layout(dims, min(q.min(), anchors.min()), max(q.max(), anchors.max()))
        assert (layout.unpack(layout.pack(q))[:, :dims] == q).all()
        wide = layout.unpack(layout.pack(anchors))
        with np.errstate(over="ignore"):
            assert (layout.scores(layout.tables(wide), layout.pack(q)).astype(np.int64) == q @ anchors.T).all()


def test_hard_negatives_empty(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert hard_negatives.mined(empty).collect() == []
    assert hard_negatives.mined(spark.createDataFrame([(50, None, 1), (100, [1.0], 1)], VECTORS)).collect() == []


# --- hidden Markov model -------------------------------------------------------

def test_forward_backward_against_all_paths():
    r = np.random.default_rng(1)
    model = hmm.Model(r.dirichlet(np.ones(3)), r.dirichlet(np.ones(3), 3), r.dirichlet(np.ones(6), 3).T)
    texts = [r.integers(0, 6, n) for n in (1, 4, 6, 2, 6, 3)]
    flat, sizes = np.concatenate(texts), np.array([len(t) for t in texts])
    start, step, emit, logs = np.zeros(3), np.zeros((3, 3)), np.zeros((6, 3)), []
    for t in texts:
        total, parts = 0.0, []
        for path in itertools.product(range(3), repeat=len(t)):
            p = model.start[path[0]] * model.emit[t[0], path[0]]
            for i in range(1, len(t)):
                p *= model.step[path[i - 1], path[i]] * model.emit[t[i], path[i]]
            total += p
            parts.append((path, p))
        logs.append(math.log(total))
        for path, p in parts:
            start[path[0]] += p / total
            for i, k in enumerate(path):
                emit[t[i], k] += p / total
                if i:
                    step[path[i - 1], k] += p / total
    assert np.allclose(hmm.log_probabilities(model, flat, sizes), logs)
    sums = hmm.Expected(model)
    sums.add(flat, sizes)
    assert np.allclose(sums.start, start) and np.allclose(sums.step * model.step, step) and np.allclose(sums.emit, emit)
    assert math.isclose(sums.log, sum(logs))


def test_pieces_and_lanes_change_nothing(monkeypatch):
    r = np.random.default_rng(2)
    model = hmm.first_model(r.integers(0, 50, 30), 4)
    sizes = r.integers(1, 90, 40)
    flat = r.integers(0, 30, sizes.sum())

    def sums():
        e = hmm.Expected(model)
        e.add(flat, sizes)
        return np.concatenate([e.start, e.step.ravel(), e.emit.ravel(), [e.log]])
    whole, logs = sums(), hmm.log_probabilities(model, flat, sizes)
    for name, value in (("PIECE", 7), ("LANES", 3), ("GATHER", 11)):
        monkeypatch.setattr(hmm, name, value)
    assert np.allclose(sums(), whole) and np.allclose(hmm.log_probabilities(model, flat, sizes), logs)


def test_scaled_every_few_steps_and_where_texts_end(monkeypatch):
    """Also for words that no state expects: nothing underflows in between."""
    r = np.random.default_rng(4)
    emit = r.random((30, 4))
    emit[:5] *= 1e-13
    model = hmm.Model(r.dirichlet(np.ones(4)), r.dirichlet(np.ones(4), 4), emit / emit.sum(axis=0))
    sizes = np.sort(r.integers(1, 70, 12))[::-1]
    flat = np.concatenate([np.zeros(sizes[0], np.int64), r.integers(0, 30, sizes[1:].sum())])

    def sums():
        e = hmm.Expected(model)
        e.add(flat, sizes)
        return np.concatenate([e.start, e.step.ravel(), e.emit.ravel(), [e.log], hmm.log_probabilities(model, flat, sizes)])
    few, kept = sums(), []
    active = hmm._active(sizes)
    hmm._forward(model, flat, np.cumsum(sizes) - sizes, active, 0, sizes[0], None, keep=kept)
    ends = np.append(active, 0)
    for t, (_, _, alpha, scale) in enumerate(kept):
        scaled = len(alpha) if (t + 1) % 8 == 0 else ends[t] - ends[t + 1]
        assert (0 if scale is None else len(scale)) == scaled
    monkeypatch.setattr(hmm, "SCALED", 1)
    assert np.allclose(sums(), few, rtol=1e-11, atol=0)


ODD_TEXTS = [b" a  b ", b"", None, b"  \n", b"a\x0b\x0cB\x1c\x85c\r\n", "\u00c4a \u2003\u0130 x\x00Y \ud800".encode("utf-8", "surrogatepass"), b"\xff\xfe A", b"b a B" * 9]


def test_words_of_many_texts_at_once():
    for texts in (ODD_TEXTS, ODD_TEXTS[3:4], []):
        words, sizes = hmm.tokens(pa.array([b"x"] + texts, pa.binary()).slice(1))
        want = [(t or b"").lower().split() for t in texts]
        assert sizes.tolist() == [len(ws) for ws in want] and words.to_pylist() == [w for ws in want for w in ws]


def test_counts_and_symbols_of_cut_batches(spark, monkeypatch):
    """Batches are cut by bytes; no cut may lose, move or split a text's words."""
    texts = [None if t is None else bytearray(t) for t in ODD_TEXTS + [b"rare rare b", b"c"] * 3]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text binary").coalesce(1)
    n = Counter(w for t in texts for w in bytes(t or b"").lower().split())
    for split, held in ((4 << 20, 16 << 20), (4, 9)):
        monkeypatch.setattr(hmm, "SPLIT", split)
        monkeypatch.setattr(hmm, "HELD", held)
        assert {bytes(r.word): r.n for r in hmm.word_counts(docs).collect()} == n
        known = hmm.lexicon(docs, symbols=2)
        at = {w: i for i, w in enumerate(known.words)}
        got = sorted(hmm.encoded_texts(docs, known).collect(), key=lambda r: r.doc_id)
        assert len(got) == len(texts) and 0 < len(at) <= 2
        for r, t in zip(got, texts):
            ws = bytes(t or b"").lower().split()
            assert r.symbols == [at.get(w, len(at)) for w in ws] + [len(at) + 1]
            assert r.n_known == 1 + sum(w in at for w in ws)
            assert {bytes(x.word): x.n for x in r.rare} == Counter(w for w in ws if w not in at) and len(r.rare) == len({w for w in ws if w not in at})


def plain_base(docs, train):
    n = Counter()
    split = [[w.translate(brute.UP) for w in brute.words(t)] + [None] for _, t in docs]
    for ws, keep in zip(split, train):
        n.update(ws if keep else [])
    total = sum(n.values())
    return [(d, keep, len(ws), sum(n[w] > 0 for w in ws), total, sum(math.log10((n[w] + 1) / (total + len(n) + 1)) for w in ws))
            for (d, _), ws, keep in zip(docs, split, train)]


@pytest.mark.parametrize("symbols", [1 << 17, 50, 0])
def test_scores(spark, symbols):
    docs = PAIRS + [(200 + i, f"unseen{i} words{i % 3} here here here") for i in range(9)]
    keep = [d is None or crc32(str(d).encode()) % 7 != 2 and d < 200 for d, _ in docs]
    df = spark.createDataFrame([(*p, k, 1) for p, k in zip(docs, keep)], "doc_id long, text string, keep boolean, row int").select(
        "*", *[F.lit(0).alias(c) for c in ("symbols", "base", "rare", "word")]).repartition(3)
    got = hmm.scored(df, F.col("keep"), states=3, rounds=2, symbols=symbols)
    own = sorted(got.collect(), key=lambda r: (str(r.doc_id), r.n_tokens, r.base_score))
    want = sorted(plain_base(docs, keep), key=lambda r: (str(r[0]), r[2], r[5]))
    assert [tuple(r)[:5] for r in own] == [w[:5] for w in want]
    assert np.allclose([r.base_score for r in own], [w[5] for w in want], rtol=1e-12)
    assert all(math.isfinite(r.score) and r.score <= 0 for r in own)


def test_model_probabilities_sum_to_one_over_texts(spark):
    """The chances of all one-word texts and of the rest add up: symbols and
    the words inside the rare symbol are each a distribution."""
    docs = spark.createDataFrame([(1, "a b a c"), (2, "a a b d"), (3, "c a")], "doc_id long, text string")
    known = hmm.lexicon(docs, symbols=2)
    assert known.words == [b"a"]        # b and c are equally common: both or none
    model, logs = hmm.baum_welch(hmm.encoded_texts(docs, known), known, states=2, rounds=8)
    assert np.allclose(model.emit.sum(axis=0), 1) and np.allclose(model.step.sum(axis=1), 1) and math.isclose(model.start.sum(), 1)
    assert logs[-1] > logs[0]


def test_latent_states_find_two_languages(spark):
    """Texts of two vocabularies: the states must tell them apart, which word
    frequencies cannot."""
    r = random.Random(3)
    names = [[f"{x}{i}" for i in range(40)] for x in "xy"]
    rows = [(i, " ".join(r.choice(names[i % 2]) for _ in range(40))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = hmm.scored(docs, F.col("doc_id") < 200, states=2, rounds=12).where("NOT train").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] - out[1] > 0.9 * 100 * 39 * math.log10(2)


def test_scores_without_training_texts(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (None, "")], "doc_id long, text string")
    out = hmm.scored(docs, F.lit(False)).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in out} == {(1, 3, 0, 0, 0.0), (2, 1, 0, 0, 0.0), (None, 1, 0, 0, 0.0)}
    assert all(math.isfinite(r.score) for r in out)
    assert hmm.scored(docs.limit(0), F.lit(True)).collect() == []
