"""Scores of op6 and op7 and the pipeline's run() against versions in plain Python."""
import math
import random
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("vicinity.llm")

DOCS = "doc_id long, text string, lang string"


def test_toxicity_scores(spark):
    """A text's score is the logistic of the bias and the weights of its distinct words."""
    from vicinity.llm import text as tx
    from vicinity.llm.toxicity import fit, score

    rng = random.Random(3)
    names = [a + b for a in ("stone", "river", "Cloud", "ÉTÉ", "women", "scum", "idiot") for b in ("", "s", "ing")]
    texts = [" ".join(rng.choice(names) for _ in range(rng.randrange(1, 40))) + (" trash!" * (i % 3)) for i in range(200)] + [None, "", "12 34", "Scum-scum, SCUM\n" * 3000]
    table = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], DOCS)
    model = fit(table, spark.createDataFrame([(i, int("trash" in texts[i])) for i in range(200)], "doc_id long, toxic int"))
    weights = dict(zip(model.features.tolist(), model.weights.tolist()))

    def feature(word):
        raw = word.encode()
        return int(tx.span_hashes(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]))[0] >> np.uint64(64 - model.bits))

    def plain(text):
        words, now = set(), ""
        for c in (text or "") + " ":
            if c.isascii() and not c.isalpha():
                words.add(now)
                now = ""
            else:
                now += c.lower() if c.isascii() else c
        logit = model.bias + sum(weights.get(f, 0.0) for f in {feature(w) for w in words if w})
        return 1 / (1 + math.exp(-max(-30, min(30, logit))))

    got = {r.doc_id: r.score for r in score(table.repartition(3), model).collect()}
    assert weights and all(got[i] == pytest.approx(plain(t), abs=1e-5) for i, t in enumerate(texts))


def test_quality_probabilities(spark):
    """Perplexities by interpolated modified Kneser-Ney counts of plain Python."""
    from vicinity.llm import quality_lm as q

    rng = random.Random(8)
    texts = [" ".join(rng.choice(["a", "bb", "ccc", "dd.", "e-f", "日本"]) for _ in range(rng.randrange(1, 30))) for _ in range(40)]
    table = spark.createDataFrame([(i, t, "aa") for i, t in enumerate([*texts, "unseen zz a bb", "", None])], DOCS)
    trusted = table.where("doc_id < 30")
    letters = q.train(trusted)
    logs = q.log_table(letters)

    def cut(text):
        raw = text.encode()
        data = np.frombuffer(raw, np.uint8)
        starts, ends, _ = q.words(data, np.array([0, len(data)]))
        return [raw[a:b].decode() for a, b in zip(starts, ends)]

    three = Counter()
    for t in texts[:30]:
        w = ["<s>", "<s>", *cut(t)]
        three.update(zip(w, w[1:], w[2:]))
    two = Counter(g[1:] for g in three)
    one = Counter(g[1:] for g in two)

    def order(counts):
        n = [sum(c == j for c in counts.values()) for j in (1, 2, 3, 4)]
        d = [0.5] * 3
        if n[0] and n[1]:
            y = n[0] / (n[0] + 2 * n[1])
            d = [max(0.0, min(j, j - (j + 1) * y * n[j] / n[j - 1])) if n[j - 1] else 0.5 for j in (1, 2, 3)]
        off = lambda c: [v or 0.5 for v in d][min(c, 3) - 1]
        total, lost = Counter(), Counter()
        for g, c in counts.items():
            total[g[:-1]] += c
            lost[g[:-1]] += off(c)
        return lambda g, below: (max(0.0, counts.get(g, 0) - off(counts[g])) / total[g[:-1]] if g in counts else 0.0) + (lost[g[:-1]] / total[g[:-1]] if total[g[:-1]] else 1.0) * below

    p1, p2, p3 = order(one), order(two), order(three)

    def plain(text):
        codes, _ = q.class_codes(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
        total = sum(float(logs[c]) for c in codes if c % q.CLASSES <= q.LINE)
        w = ["<s>", "<s>", *cut(text)]
        for k in range(2, len(w)):
            raw = w[k].encode()
            spelled = math.exp(sum(float(logs[c]) for c in q.class_codes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]))
            total += math.log(p3(tuple(w[k - 2 : k + 1]), p2(tuple(w[k - 1 : k + 1]), p1((w[k],), spelled))))
        return math.exp(-total / len(text))

    got = {r.doc_id: r.perplexity for r in q.perplexities(table, letters, q.train_words(trusted)).collect()}
    assert got[41] is None and got[42] is None and len(got) == 43
    assert all(got[i] == pytest.approx(plain(t), rel=1e-4) for i, t in enumerate([*texts, "unseen zz a bb"]))


def test_pipeline_run(spark, tmp_path):
    """run() over a fixture with nulls, an empty text, ties and repeated texts."""
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline as cp
    from tests.llm.test_edges import lines_left

    rng = random.Random(5)
    english, french = "the and of to stone river cloud field with from that this were have".split(), "le la les une des dans pour avec sur mais nous vous être été".split()
    say = lambda v, n: " ".join(rng.choice(v) + rng.choice(["", "s", "x"]) for _ in range(n))
    rows = []
    for i in range(60):
        text = "\n".join(say(english if i % 2 else french, 12) for _ in range(4))
        rows.append((i, text + ("\nscum scum" if i % 5 == 0 else ""), "en" if i % 2 else "fr"))
    run = "\n".join(say(english, 20) for _ in range(3))
    long = say(english, 300)
    rows += [(60, run + "\nown words of sixty", "en"), (61, "other words here\n" + run, "en"), (62, run, "en"), (63, long, None), (64, long.replace(" ", "  ", 1) + " tail", "en"), (65, None, "en"), (66, "", "en"), (67, "123 456", "en"), (68, long, "en")]
    for name, table in (("documents", spark.createDataFrame([(i, t, l, "s", len(t or "")) for i, t, l in rows], "doc_id long, text string, lang string, source string, n_chars long")), ("labels", spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(60)], "doc_id long, quality int, toxic int"))):
        table.coalesce(2).write.parquet(f"{tmp_path}/{name}.parquet")
    left = [(i, t) for i, t, _ in rows if any(c.isalpha() for c in t or "") and "scum" not in t]
    left = [(i, new) for (i, old), (_, new) in zip(left, lines_left(left)) if new.strip() or new == old]
    sets = {i: {tuple(w[k : k + 5]) for w in [t.lower().split()] for k in range(max(1, len(w) - 4))} for i, t in left}
    kept = {}
    for i, t in sorted(left):  # groups of this fixture are pairs, so the first of each stays
        if not any(100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) for j in sets if j < i):
            kept[i] = t
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: len(whole.encode(t, add_special_tokens=False).ids) + 1 for i, t in kept.items()}
    out = cp.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.doc_tokens for r in out} == want and 62 not in want and 64 not in want and 63 in want
    assert Counter({i: sum(r.length for r in out if r.doc_id == i) for i in want}) == Counter(want)
