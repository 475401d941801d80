"""Whitening, mixing and spelling variants against plain versions, with edge cases."""
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
llm = pytest.importorskip("vicinity.llm")

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, n long, h string, at long"
LONG = "palavra " * 20_000


def rows_of(spark, rows):
    """Documents (id, text, source), with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], DOCS)


def plain_spelling(docs, ratio=5):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c < "\x7f" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            counts[w if h % 199 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 6 and k >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    out, form = {}, {}
    for w in n:
        others = [x for x in n if x != w and near(w, x)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
        out[w] = [len(others), form[w]]
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (n[w], *out[w], n.get(form[w]), root)
    return out


def spelling_texts(rng, n):
    heads, letters = ["banana", "bananas", "abcdefgh", "aaaaaa", "ÉéÀàÿx", "wordlike", "zzzzzzz"], "abnÉzé"
    bag = []
    for _ in range(60):
        w = list(rng.choice(heads))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(2)] = rng.choices(letters, k=rng.randrange(2))
        bag += ["".join(w)] * rng.choice([1, 2, 6, 40])
    return [" ".join(rng.choices(bag, k=rng.randrange(1, 120))).replace("n", "N") for _ in range(n)]


@pytest.mark.parametrize("tile", [1 << 15, 64])
def test_spelling(spark, tile):
    from vicinity.llm.spelling import variants

    rng = random.Random(3)
    texts = [*spelling_texts(rng, 60), None, "", "123 ,.", LONG, "qwertya " * 6 + "qwertyab " * 40 + "qwertyabc " * 300]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (3, texts[3]), (3, texts[3])]
    got = variants(rows_of(spark, [(*d, "s") for d in docs]), tile=tile).collect()
    want = plain_spelling(docs)
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in got} == want and len(got) == len(want)
    assert any(w[2] and w[2] != w[4] for w in want.values()) and max(w[1] for w in want.values()) >= 5  # chains, crowds


def test_spelling_odd(spark):
    from vicinity.llm.spelling import variants

    run = "ab" * 4000
    docs = [(i, f"{run} {run}c {run[:-1]}") for i in range(9)]
    got = {r.word: r.n_near for r in variants(rows_of(spark, [(*d, "s") for d in docs])).collect()}
    assert got == {w: v[1] for w, v in plain_spelling(docs).items()} and got[run] == 2
    assert variants(rows_of(spark, [])).count() == 0


def test_spelling_on_given_documents(spark):
    from vicinity.llm.queries import op13_spelling

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in op13_spelling(spark, SF).collect()}
    assert got == plain_spelling(docs)


def plain_mix(docs):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = Counter()
    for _, text, source in docs:
        total[source] += size(text)
    names = sorted(total, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, full = {}, set()
    while True:
        rest = 1.5 * sum(total.values()) - sum(2 * total[s] for s in full)
        free = [s for s in names if s not in full]
        target = {s: 2.0 * total[s] if s in full else rest / sum(weight[x] for x in free) * weight[s] for s in names}
        over = {s for s in free if target[s] >= 2 * total[s]}
        if not over:
            return {s: (total[s], target[s]) for s in names}, size
        full |= over


def test_mixing(spark):
    from vicinity.llm.mixing import mix

    rng = random.Random(7)
    docs = [(i, "w " * rng.randrange(80), f"s{rng.randrange(9)}" if i % 3 else "hot") for i in range(900)]
    docs += [(1, "a b c", None), (2, "d e", None), (None, "x y z", "hot"), (None, None, "none"), (5, "", "none"), (7, " \t\n ", "none"), (8, LONG, "￿"), (9, "tail word \n", "\U0001f600")]
    docs += [(50, "same row here", "hot")] * 400 + [(51, "alone", "all alike")] * 30
    got = mix(rows_of(spark, docs)).collect()
    want, size = plain_mix(docs)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d[0], size(d[1])) for d in docs)
    taken, ties = Counter(), Counter()
    for r in got:
        assert (r.source_size, pytest.approx(r.target)) == want[r.source] and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        ties[r.source] += r.size > 0 and r.taken % r.size > 0
    for s, (_, target) in want.items():
        assert target - max(1, ties[s]) - 1e-6 <= taken[s] <= target + 1e-6
        assert ties[s] <= 1 or s in ("hot", "all alike")
    again = mix(rows_of(spark, docs[::-1]).repartition(7)).collect()
    assert Counter(again) == Counter(got)
    assert mix(rows_of(spark, [])).count() == 0
    assert [r.taken for r in mix(rows_of(spark, [(1, None, None)])).collect()] == [0]


def test_mixing_is_nested(spark):
    from vicinity.llm.mixing import mix

    docs = rows_of(spark, [(i, "w " * (1 + i % 17), "ab"[i % 2]) for i in range(300)])
    low, high = ({r.doc_id: r.taken for r in mix(docs, share=x, weights=(1, 1)).collect()} for x in (0.4, 0.7))
    assert all(high[i] >= n for i, n in low.items())


VECTORS = "vec_id long, embedding array<double>, label int, d long, n string, at long"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "x", 2) for i, v in rows], VECTORS)


def check_whitening(rows, got, most=32):
    good = [(i, v) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    x = np.floor(np.array([v for _, v in good]) * 64).astype(np.int64) + 1_000_000
    n, d = x.shape
    c = x - x.mean(0)
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    width = min(d, most)
    ids = sorted({i for i, _ in good})
    assert len(got) == n * width and {r.component for r in got} == set(range(1, width + 1)) and {r.n for r in got} == {n}
    dev = {i: ((n * xx - x.sum(0)) ** 2).sum() for (i, _), xx in zip(good, x)}
    assert all(r.deviation == dev[r.vec_id] for r in got)
    w = {(r.vec_id, r.component): r.whitened for r in got}
    for k in range(width):
        mine = np.array([w[i, k + 1] for i in ids], float)
        want = np.array([c[[j for j, _ in good].index(i)] @ vectors[:, k] / np.sqrt(values[k]) for i in ids])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-6
    assert {round(r.explained / (values[r.component - 1] / values.sum()), 6) for r in got} == {1.0}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_whitening(spark):
    from vicinity.llm.whitening import whiten

    rng = np.random.default_rng(4)
    rows = [(i, (rng.standard_normal(7) * np.logspace(0, 2, 7)).tolist()) for i in range(200)]
    bad = [(900, None), (901, [1.0, None] * 3 + [0.0]), (902, [float("nan")] * 7), (903, [float("inf")] + [0.0] * 6), (904, [1e200] + [0.0] * 6), (905, [])]
    check_whitening(rows, whiten(vectors_of(spark, rows + bad)).collect())
    check_whitening(rows, whiten(vectors_of(spark, rows), most=3).collect(), 3)
    assert whiten(vectors_of(spark, [])).count() == 0 and whiten(vectors_of(spark, bad)).count() == 0


def test_whitening_odd(spark):
    from vicinity.llm.whitening import whiten

    alike = whiten(vectors_of(spark, [(1, [1.0, 2.0])] * 3)).collect()
    assert len(alike) == 6 and all(r.whitened is None and r.explained is None and r.deviation == 0 for r in alike)
    line = whiten(vectors_of(spark, [(None, [float(k), 2.0 * k]) for k in range(9)])).collect()
    assert {(r.component, r.whitened is None) for r in line} == {(1, False), (2, True)} and {round(r.explained, 9) for r in line} == {0.0, 1.0}
    two = whiten(vectors_of(spark, [(k, [k * 0.1, k * k * 0.1]) for k in range(8)] + [(k, [k * 0.5, -(k**1.5), k**0.5]) for k in range(8)])).collect()
    assert len(two) == 8 * 5 and {r.n for r in two} == {8}
    huge = whiten(vectors_of(spark, [(k, [(-1.0) ** k * 1e16, k * 1e15]) for k in range(5)])).collect()
    assert len(huge) == 10 and all(r.deviation is None and r.whitened is not None for r in huge)
    assert abs(sum(r.whitened**2 for r in huge if r.component == 1) / 5 - 1) < 1e-9


def test_whitening_on_given_vectors(spark):
    from vicinity.llm.queries import op11_whitening

    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitening(rows, op11_whitening(spark, SF).collect())


def test_factors():
    from vicinity.llm.whitening import one_sided_jacobi, pivoted_cholesky

    rng = np.random.default_rng(8)
    for d in (1, 2, 5, 30):
        a = rng.standard_normal((d + 3, d)) * np.logspace(0, -6, d)
        v = a.T @ a
        low = pivoted_cholesky(v)
        assert np.allclose(low @ low.T, v, atol=1e-14 * v.max())
        e, q = one_sided_jacobi(low)
        assert np.allclose(q.T @ q, np.eye(d), atol=1e-13) and (np.diff(e) <= 0).all()
        assert np.allclose(np.sqrt(e), np.linalg.svd(a, compute_uv=False), rtol=1e-6)


def test_mixing_sql(spark):
    import duckdb

    from vicinity.llm.queries import ORACLES, op12_mixing

    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = {r[0]: r for r in db.execute(f"SELECT doc_id, source, size, source_size, target, taken FROM ({ORACLES['op12_mixing']})").fetchall()}
    got = {r.doc_id: tuple(r) for r in op12_mixing(spark, SF).select("doc_id", "source", "size", "source_size", "target", "taken").collect()}
    assert got == want
