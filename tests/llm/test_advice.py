import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("vicinity.llm")

DOCS = "doc_id long, text string, lang string"


def test_jaccard_repeated_rows(spark):
    """Repeated rows over several partitions, and one id with unlike texts."""
    from vicinity.llm.jaccard_join import jaccard_components

    rng = random.Random(8)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    a, b, c = words(104), words(104), words(104)
    # 43 shared shingles of 100 each: Jaccard 0.27, no link, though counted twice it was one
    rows = [(10, a), (11, a[:47] + words(57)), (12, b), (13, b[:-1] + ["other"]), (14, c), (15, c), (15, b), (16, []), (16, c), (17, words(3)), (18, [])]
    table = spark.createDataFrame([(i, " ".join(w), "en") for i, w in rows], DOCS)
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set() for _, w in rows]
    group = {i: i for i, _ in rows}
    for _ in rows:
        for (i, _), s in zip(rows, sets):
            for (j, _), t in zip(rows, sets):
                if s and 100 * len(s & t) >= 75 * len(s | t):
                    group[i] = group[j] = min(group[i], group[j])
    want = sorted((i, len(s), group[i]) for (i, _), s in zip(rows, sets))
    one = table.coalesce(1)
    for how in ({}, {"region": 2, "rounds": 2}):
        for docs, times in ((table.repartition(3), 1), (one.union(one), 2), (one.union(one).union(table.repartition(2)), 3)):
            got = sorted(map(tuple, jaccard_components(docs, **how).collect()))
            assert got == sorted(want * times)


def test_quality_word_order(spark):
    """Real words in nonsense order, in three scripts, score worse than in good order."""
    from vicinity.llm import quality_lm as q

    rng = random.Random(4)
    vocabularies = [[a + b for a in "кто где как мир дом лес".split() for b in "ы ами ого ить ная".split()], [a + b for a in ("stone", "river", "cloud", "field") for b in ("s", "ing", "ed", "ly", "er", "est")], [chr(0x4E00 + 7 * k) for k in range(40)]]
    texts, bad = [], []
    for v, gap in zip(vocabularies, (" ", " ", "")):
        follow = {w: rng.sample(v, 3) for w in v}
        for _ in range(60):
            w = [rng.choice(v)]
            while len(w) < 80:
                w.append(rng.choice(follow[w[-1]]))
            texts.append(gap.join(w))
            bad.append(gap.join(rng.sample(w, len(w))))
    n = len(texts)
    table = spark.createDataFrame([(i, t, "aa") for i, t in enumerate(texts + bad)], DOCS)
    trusted = table.where(f"doc_id < {n} AND doc_id % 60 < 40").select("doc_id")
    out = {r.doc_id: r for r in q.classify(table.repartition(3), trusted).collect()}
    fresh = [i for i in range(n) if i % 60 >= 40]
    assert sum(out[i].kept for i in fresh) >= 0.8 * len(fresh)
    assert all(out[n + i].perplexity > 1.2 * out[i].perplexity for i in fresh)
    again = {r.doc_id: r.perplexity for r in q.classify(table.coalesce(1), trusted).collect()}
    assert all(again[i] == pytest.approx(out[i].perplexity) for i in again) and len(again) == 2 * n


def test_quality_shares(spark):
    """After any context the shares and the weight of what is below sum to one, and the shards grow with the text."""
    from vicinity.llm import quality_lm as q

    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(30)}" for _ in range(60)) for _ in range(30)]
    table = spark.createDataFrame([(i, t, "aa") for i, t in enumerate(texts)], DOCS)
    top = {r.g3: r for r in q._word_counts(table, "text").collect()}
    shards, bottom = q.train_words(table)
    found = {r.key: r for r in shards.collect()}
    for gram, context in (("g3", "x3"), ("g2", "x2")):
        total = {}
        for g, x in {(r[gram], r[context]) for r in top.values()}:
            total[x] = total.get(x, 0) + found[g].share
        assert all(total[x] + found[x].back == pytest.approx(1, abs=1e-5) for x in total)
    assert sum(found[g].share for g in {r.g1 for r in top.values()}) + bottom == pytest.approx(1, abs=1e-5)
    assert q.train_words(table.where("doc_id < 10"))[0].count() < shards.count()


def test_languages_alphabets(spark):
    """More languages than any bound, alphabets far beyond one table, texts longer than
    a sample, words longer than a segment."""
    from vicinity.llm.language_id import _automaton, identify, phrases

    rng = random.Random(2)
    texts, langs = [], []
    for k in range(30):  # scripts of 40 letters, each pair of languages in one script
        script = [chr((0x430, 0x4E00 + 100 * k, 0x3B1, 0x20000 + 100 * k)[k // 2 % 4] + j) for j in range(24)]
        own = ["".join(rng.choice(script) for _ in range(5)) for _ in range(60)]
        for _ in range(6):
            texts.append(" ".join(rng.choice(own) for _ in range(40)))
            langs.append(f"l{k:02}")
    own = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(50)]
    texts += [" ".join(rng.choice(own) for _ in range(6000)), " ".join(rng.choice(own) for _ in range(40))]
    langs += ["long", None]
    n = len(texts)
    table = spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate(zip(texts, langs))], DOCS)
    got = {r.doc_id: r.lang_pred for r in identify(table, F.col("doc_id") % 6 != 5).collect()}
    assert all(got[i] == langs[i] for i in range(n - 1)) and got[n - 1] == "long"
    code = [rng.randrange(1, 200) for _ in range(3000)]
    probe = code[100:1300] + [0, 0] + code[5:90] + [300]
    dense, sparse = _automaton(code), _automaton(code, 1)
    import numpy as np

    for t, *rare in (dense, sparse):
        many = phrases(t, np.array(probe * 40), np.arange(40) * len(probe), np.full(40, len(probe)), rare)
        assert phrases(t, np.array(probe), np.array([0]), np.array([len(probe)]), rare).tolist() == [5] and many.tolist() == [5] * 40


def test_crf_long_documents(spark):
    """Lines after the 500th of a labelled text reach the weights, summed by tasks as on the driver."""
    import numpy as np

    from vicinity.llm.line_crf import fit

    good, bad = "A calm line of several words.", "## $$ 12345 BUY NOW %%"
    texts = ["\n".join([good] * 500 + [bad if y else good] * 700) for y in (0, 1)] * 4 + [good, bad]
    table = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(texts))], "doc_id long, quality int")
    crf = fit(table, labels)
    short = fit(spark.createDataFrame([(i, "\n".join(t.split("\n")[:500]), "en") for i, t in enumerate(texts)], DOCS), labels)
    assert not np.allclose(crf.emit, short.emit, atol=0.01)
    tasks = fit(table, labels, driver_lines=0)
    assert np.allclose(crf.emit, tasks.emit, atol=1e-4) and np.allclose(crf.pair, tasks.pair, atol=1e-4)


def test_line_runs_with_another_first_place(spark):
    """A run's tail goes though the first place of its first line lacks it."""
    from vicinity.llm.line_dedup import dedup_lines

    w = "word " * 59 + "end"
    texts = [w, *(f"{w}\ny1\ny2\nown {k}\nmore {k}" for k in range(6)), f"{w}\ny1"]
    out = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], DOCS)).collect()}
    assert [out[0], out[1], out[7]] == [w, "y1\ny2\nown 0\nmore 0", ""]
    assert [out[k + 1] for k in range(1, 6)] == [f"own {k}\nmore {k}" for k in range(1, 6)]


def test_model_with_pieces_over_line_ends_is_refused(tmp_path):
    """Runs end at line ends, so a piece that goes on after one can't be found; one that ends there can."""
    import pytest
    from sentencepiece import sentencepiece_model_pb2

    from vicinity.llm.sentencepiece import Model

    def model(*pieces):
        proto = sentencepiece_model_pb2.ModelProto()
        proto.normalizer_spec.remove_extra_whitespaces = False
        proto.pieces.add(piece="<unk>", score=0.0, type=2)
        for p in pieces:
            proto.pieces.add(piece=p, score=-1.0, type=1)
        (tmp_path / "m").write_bytes(proto.SerializeToString())
        return Model(str(tmp_path / "m"))

    assert len(model("a", "a\n", "\n").pieces) == 4
    for bad in ("\na", "a\nb", "\n\n", "a▁"):
        with pytest.raises(ValueError):
            model("a", bad)
