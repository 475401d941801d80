"""Defined results on odd tables: repeated rows, null ids, clashing names, empty tables."""
import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("vicinity.llm")


def b32(body):
    return base64.b32encode(hashlib.sha1(body).digest()).decode()


def test_archive_repeated_and_null_ids(spark, tmp_path):
    from vicinity.llm import warc_zip as w

    rows = [(1, "aaaa"), (2, "cccc"), (5, "aaaa"), (5, "bbbb"), (5, "cccc"), (5, "aaaa"), (None, "aaaa"), (None, "dddd"), (1, "aaaa"), (7, "dddd")]
    pages = spark.createDataFrame([(i, "u", h, 1, "x", "y") for i, h in rows], "page_id long, url string, html string, refers_to int, digest string, payload string")
    want = sorted(((i, 4, b32(h.encode()), "response" if i in (1, 2, None) or h in ("bbbb", "dddd") else "revisit", {"aaaa": 1, "cccc": 2}[h] if i == 5 and h != "bbbb" else None) for i, h in rows), key=str)
    for most in (w.BROADCAST_LINKS, 0):
        w.BROADCAST_LINKS, kept = most, w.BROADCAST_LINKS
        try:
            got = w.read_packages(w.write_packages(pages.repartition(3), f"file://{tmp_path}/{most}"))
            assert sorted((tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == want
        finally:
            w.BROADCAST_LINKS = kept


def test_archive_digest_is_that_of_the_payload(spark, tmp_path):
    """A payload that isn't the one that was hashed is an error."""
    from vicinity.llm import warc_zip as w

    raw = w.warc_record("response", "u", 3, b32(b"other"), 4, b"body", None)
    warc, http, payload = w.parse_record(raw)
    assert payload == b"body" and b32(payload) != warc["warc-payload-digest"].removeprefix("sha1:") and http["content-length"] == "4"
    import gzip
    import json

    path = tmp_path / "x.wacz"
    with open(path, "wb") as f:
        z = w.ZipWriter(f)
        z.open(w.ARCHIVE)
        z.write(gzip.compress(raw))
        n = z.member["size"]
        z.close_member()
        z.open(w.INDEX)
        z.write(("u 20240101000000 " + json.dumps({"offset": 0, "length": n, "digest": "x"}) + "\n").encode())
        z.close_member()
        z.finish()
    with pytest.raises(Exception, match="its payload has"):
        w.read_packages(spark.createDataFrame([(f"file://{path}", 1)], "path string, records long")).collect()


def lines_left(rows, min_words=50, min_lines=3):
    """Brute force of line dedup: a line goes if it lies in a run that an earlier place has."""
    docs = []
    for i, text in sorted({r for r in rows if None not in r}):
        lines = [(p, x) for p, x in enumerate(text.split("\n")) if x.strip(" ")]
        docs.append((i, text, lines))
    seen, gone = set(), {}
    for size in range(1, 12):  # every run, however long
        seen.clear()
        for i, text, lines in docs:
            for a in range(len(lines) - size + 1):
                run = lines[a : a + size]
                if size < min_lines and sum(len(x.strip(" ").split(" ")) for _, x in run) < min_words:
                    continue
                if (key := tuple(x for _, x in run)) in seen:
                    gone.setdefault((i, text), set()).update(p for p, _ in run)
                seen.add(key)
    return [(i, t if not gone.get((i, t)) else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[i, t])) for i, t in rows]


def test_lines_against_brute_force(spark):
    from vicinity.llm.line_dedup import dedup_lines

    rng = random.Random(7)
    line = lambda: rng.choice([f"l{rng.randrange(6)}", f"own {rng.random()}", "w " * rng.choice([20, 30, 49, 59]) + str(rng.randrange(2)), "", " "])
    rows = [(rng.randrange(60), "\n".join(line() for _ in range(rng.randrange(1, 12)))) for _ in range(120)]
    # unique texts of one id come in an order of their own, so only ids with one text are compared in full
    rows = list({i: (i, t) for i, t in rows}.values()) + [(100, "\n".join(["x"] * 9)), (101, "x\nx\nx"), (102, "l1\nl2\nl3\nl4\nl5\nl1\nl2\nl3")]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted(lines_left(rows))


def test_lines_of_repeated_ids_and_odd_columns(spark):
    from vicinity.llm.line_dedup import dedup_lines

    run, own = "r1\nr2\nr3\nr4", "own a\nown b\nown c\nown d\nown e"
    rows = [(1, run), (5, run), (5, own), (5, own), (None, run), (6, None), (7, ""), (8, "tail\n" + run)]
    table = spark.createDataFrame([(*r, [1], 2, "k") for r in rows], "doc_id long, text string, gone_mask array<int>, n_removed int, Gone_ID string")
    out = dedup_lines(table)
    assert out.columns == ["doc_id", "text", "gone_mask", "Gone_ID", "n_lines", "n_removed"]
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect()), key=str) == sorted([(1, run, 4, 0), (5, "", 4, 4), (5, own, 5, 0), (5, own, 5, 0), (None, run, 4, 0), (6, None, 0, 0), (7, "", 0, 0), (8, "tail", 5, 4)], key=str)
    assert dedup_lines(table.limit(0)).count() == 0


def test_jaccard_regions_and_buckets(spark):
    """Large regions are split around pivots, recursively, and any number of buckets
    gives the same links; a passage and copies that meet in one chunk."""
    from vicinity.llm import jaccard_join as j

    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(60)]
    texts = []
    for c in range(14):  # clusters of near copies that all share a passage
        own = [word() for _ in range(70 if c % 2 else 25)]
        for _ in range(rng.randrange(1, 9)):
            w = [*own, *passage] if c % 3 else list(own)
            for _ in range(rng.randrange(0, 9)):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
    texts += [texts[3]] * 5
    sets = [{tuple(w[k : k + 5]) for w in [t.split()] for k in range(len(w) - 4)} for t in texts]
    group = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for how in ({"bits": 18}, {"bits": 9, "region": 8, "rounds": 3}, {"region": 6, "rounds": 1}, {"region": 20}):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in j.jaccard_components(table, **how).collect()}
        assert [got[i] for i in range(len(texts))] == [(len(s), g) for s, g in zip(sets, group)]


def test_jaccard_region_in_memory():
    """The recursion in a task spans what comparing all pairs spans."""
    import numpy as np

    from vicinity.llm.jaccard_join import _join_region

    rng = np.random.default_rng(3)
    lists = []
    for _ in range(40):
        base = rng.choice(4000, 60, replace=False)
        for _ in range(6):
            s = base.copy()
            s[: rng.integers(0, 14)] = rng.choice(4000, 60)[: 1]
            lists.append(np.unique(s).astype(np.int64))
    n, ids = np.array([len(s) for s in lists]), np.arange(len(lists))
    for home in (np.ones(len(lists), bool), rng.random(len(lists)) < 0.4):
        want = list(range(len(lists)))
        got = list(range(len(lists)))

        def join(g, a, b):
            low, high = sorted((g[a], g[b]))
            g[:] = [low if x == high else x for x in g]

        for a in range(len(lists)):
            for b in range(a):
                if (home[a] or home[b]) and 100 * len(np.intersect1d(lists[a], lists[b])) >= 75 * len(np.union1d(lists[a], lists[b])):
                    join(want, a, b)
        for a, b in _join_region(ids, n, lists, 75, home, ids, leaf=8, pivots=4):
            join(got, a, b)
        assert got == want and len(set(want)) > 20


WIDE = "doc_id long, text string, lang string, quality int, toxic int, score double, kept boolean, start long, ids string, h long, gone int"


def test_odd_tables(spark):
    """Empty tables, null ids, repeated rows, ties and columns whose names clash: a row
    out for a row in, equal rows alike."""
    import public_tokenizers

    from vicinity.llm import language_id, line_crf, packing, quality_lm, sentencepiece, toxicity

    body = "the river and the stone are here again in this field of words that go on for long"
    rows = [(1, body, "en"), (1, body, "en"), (2, body, None), (None, body, "en"), (None, None, None), (3, "", "en"), (4, "uns la vie est belle", "fr"), (4, "other text of the same id", "fr")]
    table = spark.createDataFrame([(*r, 1, 0, 0.5, True, 1, "x", 1, 1) for r in rows], WIDE).repartition(2)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (4, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    piece, bpe = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
    runs = {
        "op1": lambda t, y: sentencepiece.round_trip(t, piece), "op4": lambda t, y: packing.pack_documents(t, bpe).where("start = 0"), "op6": lambda t, y: toxicity.score(t, toxicity.fit(t, y)),
        "op7": lambda t, y: quality_lm.classify(t, y.where("quality = 1").select("doc_id")), "op9": lambda t, y: line_crf.judge(t, line_crf.fit(t, y)), "op10": lambda t, y: language_id.identify(t, F.lit(True)),
    }
    for name, run in runs.items():
        out = run(table, labels).collect()
        assert sorted(str(r.doc_id) for r in out) == sorted(str(i) for i, *_ in rows), name
        same = {tuple(v for k, v in r.asDict().items() if k not in ("sequence_id", "offset")) for r in out if r.doc_id == 1}
        assert len(same) == 1, name
        assert run(table.limit(0), labels.limit(0)).count() == 0 and run(table.limit(0), labels).count() == 0, name


def test_packing_limits(spark):
    """Segments and loss-bearing tokens bind as tokens do."""
    import public_tokenizers

    from vicinity.llm.packing import Limits, pack_documents

    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 30))), " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 12)))) for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, asked string").coalesce(1)
    lim = Limits(24, 3, 10)
    pieces = pack_documents(table, public_tokenizers.path("word_bpe_49k.json"), limits=lim, prompt_col="asked").collect()
    prompt = {i: len(a.split()) for i, _, a in rows}  # single letters are single tokens
    by = {}
    for r in pieces:
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        assert sum(r.length for r in own) <= lim.tokens and len(own) <= lim.segments
        assert sum(r.length - min(r.length, max(0, prompt[r.doc_id] - r.start)) for r in own) <= lim.loss
    assert {i: sum(r.length for r in pieces if r.doc_id == i) for i, *_ in rows} == {i: len(t.split()) + len(a.split()) + 1 for i, t, a in rows}


def test_pipeline_empty(spark, tmp_path):
    import corpus_pipeline as cp

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_components_keep_only_the_newest_edges(spark, tmp_path, monkeypatch):
    """Earlier rounds' edges are removed; the result still reads whole."""
    from vicinity.llm import shared

    folders = (f"file://{tmp_path}/{n}" for n in range(100))
    monkeypatch.setattr(shared, "shared_dir", lambda spark: next(folders))
    found = shared.components(spark.createDataFrame([(i, i + 1) for i in range(1, 20)] + [(40, 41), (7, 7), (None, 3)], "a long, b long"))
    assert {(r.node, r.component) for r in found.collect()} == {(i, 1) for i in range(1, 21)} | {(40, 40), (41, 40)}
    assert len(list(tmp_path.iterdir())) == 1 and next(folders) > f"file://{tmp_path}/2"


def test_products_meet_each_pair_once():
    """Pairs of rows of which one is at home, each once, guests never with guests."""
    import numpy as np

    from vicinity.llm.embedding_dedup import _products

    home = np.array([True, False, True, True, False, True, False])
    rows = np.arange(7)

    def met(left, right, same):
        out = []
        for own, other, later in _products(left, right, home, same, 2):
            out += [tuple(sorted((int(own[p]), int(other[q])))) for p in range(len(own)) for q in range(len(other)) if not later or p < q]
        return sorted(out)

    wanted = lambda pairs: sorted((p, q) for p, q in pairs if home[p] or home[q])
    assert met(rows, rows, True) == wanted((p, q) for p in rows for q in rows if p < q)
    assert met(rows[:3], rows[3:], False) == wanted((p, q) for p in rows[:3] for q in rows[3:])
    assert met(rows[1:2], rows[4:5], False) == []
