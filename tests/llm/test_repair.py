"""Repeated ids, vectors of any size, buckets without a cap, folders that go."""
import os
import subprocess
import sys
import textwrap
from collections import defaultdict

import numpy as np
import pytest

llm = pytest.importorskip("vicinity.llm")

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain_links(rows, min_cos):
    """id -> (links, component) from rows (id, vector, label), each row's links added to its id."""
    n, near = defaultdict(int), defaultdict(set)
    scaled = []
    for _, v, _ in rows:
        v = np.array(v)
        scaled.append(v / np.abs(v).max())
    for a in range(len(rows)):
        n[rows[a][0]] += 0
        for b in range(len(rows)):
            u, v = scaled[a], scaled[b]
            if a != b and rows[a][2] == rows[b][2] and u @ v / np.sqrt((u @ u) * (v @ v)) >= min_cos:
                n[rows[a][0]] += 1
                near[rows[a][0]].add(rows[b][0])
    out = {}
    for i in n:
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (n[i], min(seen))
    return out


def test_repeated_ids(spark):
    from vicinity.llm.embedding_dedup import near_duplicates

    v, w = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    v2, w2 = [1.0, 0.1, 0.0, 0.0], [0.1, 1.0, 0.0, 0.0]
    rng = np.random.default_rng(2)
    crowd = [(int(rng.integers(20)), (np.eye(4)[rng.integers(4)] + rng.standard_normal(4) * 0.2).tolist(), int(rng.integers(2))) for _ in range(60)]
    for rows in (
        [(1, v, 0), (1, w, 0), (2, v2, 0), (3, w2, 0)],
        [(1, v, 0), (1, w, 1), (2, v2, 1), (3, w2, 0)],
        [(1, v, 0), (1, v, 0), (1, v, 1), (2, v2, 0), (2, v2, 1)],
        crowd, crowd + crowd,
    ):
        got = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), block=2, tile=8).collect()
        want = plain_links(rows, 0.93)
        assert len(got) == len(rows) and {r.vec_id: (r.n_links, r.component_id) for r in got} == want
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_vectors_of_any_size(spark):
    from vicinity.llm.embedding_dedup import near_duplicates

    rows = [(k, [x * s, y * s], 0) for k, (x, y, s) in enumerate([(1, 1, 1e-200), (1, 1.01, 1e-200), (1, 1, 1e200), (1, 1.02, 1e250), (-1, 1, 5e-324), (-1, 1.0, 1e-310), (1, 1, 1.0)])]
    df = spark.createDataFrame([(i, [float(x) for x in v], l) for i, v, l in rows], "vec_id long, embedding array<double>, label int")
    assert {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(df).collect()} == plain_links(rows, 0.93)
    exact = {r.vec_id: r.component_id for r in near_duplicates(df.where("vec_id IN (0, 1, 2)"), min_cos=1.0).collect()}
    assert exact[1] == 1
    with pytest.raises(ValueError):
        near_duplicates(df, min_cos=1.5)


def test_buckets_grow(spark, monkeypatch):
    """The model answers alike whatever the number of buckets."""
    from vicinity.llm import quality_lm

    docs = spark.createDataFrame([(i, f"one two three {i % 7} four five six. Seven {i % 3}" * 3, "x") for i in range(40)], "doc_id long, text string, lang string")
    trusted = docs.select("doc_id").where("doc_id < 30")
    few = {r.doc_id: r.perplexity for r in quality_lm.classify(docs, trusted).collect()}
    monkeypatch.setattr(quality_lm, "MOST_KEYS", 1e-3)
    many = {r.doc_id: r.perplexity for r in quality_lm.classify(docs, trusted).collect()}
    assert few == pytest.approx(many)


def test_nothing_is_left(tmp_path):
    """After the driver's end the shared folder is empty, also where a job failed."""
    job = f"""
    import sys
    sys.path.insert(0, {ROOT!r})
    from pyspark.sql import SparkSession, functions as F
    spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}").config("spark.sql.shuffle.partitions", "2").getOrCreate()
    from vicinity.llm.queries import op8_warc_zip
    from vicinity.llm.shared import written
    print(op8_warc_zip(spark, "/root/testdata/sf0.001").count())
    import os
    assert not any(f.endswith(".wacz") for _, _, names in os.walk({str(tmp_path)!r}) for f in names)
    try:
        written(spark.range(9).select(F.raise_error(F.lit("as planned"))))
    except Exception:
        print("failed")
    """
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(job)], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and done.stdout.split()[-1] == "failed", done.stderr
    assert not [p for p in tmp_path.rglob("*") if p.is_file() or p.name.startswith("vicinity")]  # Spark itself leaves an empty folder


def test_language_models_go():
    """Words far longer than others leave nothing of a model behind in a worker."""
    import gc
    import weakref

    from vicinity.llm.language_id import _automaton, phrases

    code = [k * 7 % 190 + 1 for k in range(600)]
    table, *rare = _automaton(code)
    assert phrases(table, np.array(code), np.array([0]), np.array([600]), rare).tolist() == [1]
    left = weakref.ref(table)
    del table
    gc.collect()
    assert left() is None


def test_workers_give_memory_back():
    """After a task of packing a worker holds little: what was freed is the system's again."""
    job = f"""
    import re, sys
    sys.path.insert(0, {ROOT!r})
    import pyarrow as pa
    import pyarrow.parquet as pq
    import public_tokenizers
    from types import SimpleNamespace
    from vicinity.llm import packing

    packing.TaskContext = SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0))
    kind = SimpleNamespace(dataType=SimpleNamespace(simpleString=lambda: "long"))
    docs = SimpleNamespace(schema=dict(doc_id=kind), select=lambda *c: SimpleNamespace(mapInArrow=lambda run, schema: run))
    held = lambda: sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) // 1024
    rows = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_batches()
    before = held()
    print(sum(b.num_rows for b in packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))(iter(rows))))
    print(held() - before)
    """
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(job)], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    pieces, more = map(int, done.stdout.split())
    assert pieces > 0 and more < 40, more


def test_language_workers_stay_small():
    """A worker that tells languages holds 16-bit tables and the arrays of a small slice."""
    job = f"""
    import re, sys, threading, time
    sys.path.insert(0, {ROOT!r})
    import pyarrow as pa
    import pyarrow.parquet as pq
    from types import SimpleNamespace
    from vicinity.llm import language_id

    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text", "lang"])
    own = {{}}
    for t, l in zip(texts.column("text").to_pylist(), texts.column("lang").to_pylist()):
        if t and l and len(own.setdefault(l, "")) < 30000:
            own[l] += " " + t
    model = language_id.fit({{l: [t] for l, t in own.items()}}, 30000)
    assert all(t.dtype == "uint16" for t, *_ in model["tables"])
    kind = SimpleNamespace(dataType=SimpleNamespace(simpleString=lambda: "long"))
    docs = SimpleNamespace(schema=dict(doc_id=kind), select=lambda *c: SimpleNamespace(mapInArrow=lambda run, schema: run))
    docs.sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda m: SimpleNamespace(value=m)))
    held = lambda: sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) // 1024
    rows, most = texts.select(["doc_id", "text"]).combine_chunks().to_batches(), [0]
    before = held()
    def watch():
        while True:
            most[0] = max(most[0], held())
            time.sleep(0.005)
    threading.Thread(target=watch, daemon=True).start()
    print(sum(b.num_rows for b in language_id.predict(docs, model)(iter(rows))))
    print(most[0] - before)
    """
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(job)], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    n, more = map(int, done.stdout.split())
    assert n > 0 and more < 120, more
