"""Nearest neighbours, the quality classifier, archives and the pipeline."""

import base64
import collections
import hashlib
import os
import re
import shutil
import subprocess
import sys

import numpy as np
import pyarrow.dataset as ds
from pyspark.sql import functions as F

import corpus_pipeline
from chartwise.llm import kmeans_tree, quality, secret_scan, warc
from chartwise.llm.common import table
from chartwise.llm.queries import QUERIES
from test_text_operators import check_packing

SF = "/root/testdata/sf0.001"


def exact_nearest(ids, x, query, k):
    out = []
    for i in np.flatnonzero(query(ids)):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        d[ids == ids[i]] = np.inf
        order = np.lexsort((ids, d))[:k]
        out += [(int(ids[i]), r + 1, int(ids[j]), d[j]) for r, j in enumerate(order) if d[j] < np.inf]
    return out


def test_nearest_query_reaches_its_recall(spark):
    t = ds.dataset(f"{SF}/embeddings.parquet").to_table().to_pandas()
    want = exact_nearest(t.vec_id.to_numpy(), np.stack(t.embedding).astype(float), lambda i: i % 100 == 0, 10)
    got = QUERIES["op1_kmeans_tree"](spark, SF).collect()
    near = {(r.query_id, r.vec_id): r.score for r in got}
    hits = [near[(q, v)] == s for q, _, v, s in want if (q, v) in near]
    assert len(hits) >= 0.9 * len(want) and all(hits) and len(got) == len(want)


def test_nearest_recall_with_many_leaves(spark, monkeypatch):
    monkeypatch.setattr(kmeans_tree, "LEAF_ROWS", 40)
    monkeypatch.setattr(kmeans_tree, "BLOCK_ROWS", 16)
    monkeypatch.setattr(kmeans_tree, "BLOCK_QUERIES", 4)
    monkeypatch.setattr(kmeans_tree, "SAMPLE", 900)
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(30, 8))
    x = np.concatenate([centre[rng.integers(0, 30, 2000)] + 0.1 * rng.normal(size=(2000, 8)), np.tile(centre[0], (1000, 1))])
    ids = np.arange(len(x))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>").repartition(4)
    got = kmeans_tree.search(df, F.col("id") % 50 == 0).collect()
    want = exact_nearest(ids, x, lambda i: i % 50 == 0, 10)
    mine = {(r.query_id, r.vec_id) for r in got}
    assert sum((q, v) in mine for q, _, v, _ in want) >= 0.9 * len(want)
    assert got[0].visits < 3000 / 40


def test_nearest_of_isolated_vectors(spark, monkeypatch):
    """Beside dense clusters, a vector in a leaf of few rows still gets all its neighbours; so does a query whose id repeats."""
    monkeypatch.setattr(kmeans_tree, "LEAF_ROWS", 8)
    centre = 100 * np.random.default_rng(0).normal(size=(12, 4))
    x = np.concatenate([centre[np.arange(600) % 12], 5000 + np.arange(20.0).reshape(5, 4), np.full((24, 4), -5000.0)])
    ids = np.concatenate([np.arange(605), np.full(24, 700)])
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>").repartition(3)
    found = collections.defaultdict(set)
    for r in kmeans_tree.search(df, F.col("id") >= 600).collect():
        found[r.query_id].add(r.rank)
        assert r.vec_id != r.query_id
    assert found == {i: set(range(1, 11)) for i in (*range(600, 605), 700)}


def test_nearest_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]),
            (7, [None, 1.0]), (8, [float("inf"), 1.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (10, [2.0, 0.0]), (10, [2.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, leaf string")
    got = sorted(tuple(r)[:4] for r in kmeans_tree.search(df, F.col("id") == 0).collect())
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 10, 1.0), (0, 4, 10, 1.0)]
    assert kmeans_tree.search(df.limit(0), F.col("id") == 0).count() == 0


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in QUERIES["op3_importance"](spark, sf).collect()}
    assert len(rows) == 10000
    labels = ds.dataset(f"{sf}/labels.parquet").to_table().to_pandas()
    kept = collections.Counter((int(q), rows[i].kept) for i, q in zip(labels.doc_id, labels.quality, strict=True))
    assert kept[(1, True)] >= 0.995 * (kept[(1, True)] + kept[(1, False)])
    assert kept[(0, False)] >= 0.9 * (kept[(0, True)] + kept[(0, False)])


def test_quality_counts_by_hand(spark):
    """Weights from the models as counted in plain Python, and Gumbel top-k."""
    import pyarrow as pa

    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["a b c", "a b", "junk !! junk", None, "", "a junk"])], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1 if k < 2 else 0) for k in range(3)], "doc_id long, quality int")
    sample = quality.labelled(labels)
    ratio = quality.model(docs, sample)
    good_ids = {r.doc_id for r in sample.filter("good and not held").collect()}
    raw, good = np.ones(quality.BUCKETS), np.ones(quality.BUCKETS)
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    grams = {k: np.concatenate([g for _, _, g, _ in quality.grams(pa.array([t], pa.string()))] or [np.zeros(0, int)]) for k, t in enumerate(texts)}
    assert len(grams[0]) == 5 and len(grams[2]) == 5 and len(grams[3]) == 0
    for k, g in grams.items():
        np.add.at(raw, g, 1)
        if k in good_ids:
            np.add.at(good, g, 1)
    want = np.log(good / good.sum()) - np.log(raw / raw.sum()) if good_ids else np.zeros(quality.BUCKETS)
    assert np.allclose(ratio, want)
    rows = quality.weighted(docs, ratio).collect()
    for r in rows:
        assert abs(r._log_weight - want[grams[r.doc_id]].sum()) < 1e-9
    top = [r.doc_id for r in quality.top_k(docs, labels, 3).collect()]
    assert top == [r.doc_id for r in sorted(rows, key=lambda r: -r._key)[:3]]


def test_quality_edges(spark, edge, nothing):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (99, 0)], "doc_id long, quality int")
    left = quality.keep_good(edge, labels)
    assert left.columns == edge.columns and left.count() == edge.count()  # no two classes: nothing is rejected
    assert quality.resampled(nothing, labels).count() == 0
    assert quality.resampled(edge, labels.limit(0)).filter("kept").count() == edge.count()


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def expected_pages(rows, least):
    top = {}
    for i, h in rows:
        b = (h or "").encode()
        if i is not None and len(b) >= least:
            top[b] = max(i, top.get(b, i))
    out = collections.Counter()
    for i, h in rows:
        b = (h or "").encode()
        to = top.get(b)
        revisit = i is not None and to is not None and to != i
        out[(i, len(b), digest(b), "revisit" if revisit else "response", to if revisit else None)] += 1
    return out


def test_archives_query(spark):
    t = ds.dataset(f"{SF}/pages.parquet").to_table().to_pandas()
    got = collections.Counter(tuple(r)[:5] for r in QUERIES["op4_warc"](spark, SF).collect())
    assert got == expected_pages([(int(i), h) for i, h in zip(t.page_id, t.html, strict=True)], 0)


def test_archives_edges(spark):
    rows = [(1, "http://a/ b", "x"), (2, None, "x"), (3, "u", None), (4, "u", ""), (4, "u", ""), (None, "u", "x"), (None, "v", "alone"),
            (5, "http://ü/漢", "WARC/1.0\r\n\r\nContent-Length: 3\r\n\r\n é漢😀\r\n"), (6, "", "y" * 300000), (7, "u", "same"), (8, "u", "same")]
    df = spark.createDataFrame([(*r, "p", "q") for r in rows], "page_id long, url string, html string, payload string, refers_to string").repartition(3)
    for least in (0, 4):
        back = warc.round_trip(df, least)
        got = collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back.collect())
        assert got == expected_pages([(i, h) for i, _, h in rows], least)
        whole = {r.page_id: bytes(r.payload).decode() for r in back.filter("record_type = 'response'").collect()}
        assert whole[5] == rows[7][2] and whole[6] == rows[8][2]
    assert warc.round_trip(df.limit(0)).count() == 0


def test_archives_of_stated_size(spark, tmp_path):
    rows = [(i, f"http://a/{i}", f"{i} " * 400) for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = str(tmp_path / "warc")
    warc.convert(warc.to_arc(pages), path, file_bytes=10_000)
    sizes = [len(warc.gzip.open(os.path.join(path, f)).read()) for f in os.listdir(path) if f.endswith(".gz")]
    total = sum(len(h) for _, _, h in rows)
    assert len(sizes) >= total // 10_000 * 0.8 and max(sizes) < 60_000
    assert {r.page_id: bytes(r.payload).decode() for r in warc.read_warc(spark, path).collect()} == {i: h for i, _, h in rows}


def test_archives_of_an_id_on_two_payloads(spark):
    rows = [(1, "alone"), (1, "shared"), (2, "shared"), (3, "also"), (1, "also"), (2, "kept")]
    df = spark.createDataFrame([(i, f"http://a/{k}", h) for k, (i, h) in enumerate(rows)], "page_id long, url string, html string").repartition(3)
    back = warc.round_trip(df).collect()
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back) == expected_pages(rows, 0)
    assert {bytes(r.payload).decode() for r in back if r.record_type == "response"} == {h for _, h in rows}


def test_arc_versions():
    rows = [(1, "http://x", b"a\nb"), (None, None, b"")]
    for version in (1, 2):
        raw = warc.arc_file(version, rows)
        assert list(warc.parse_arc(raw)) == [("http://x", "1", warc.STARTED, "text/html", b"a\nb"), ("urn:none", "-", warc.STARTED, "text/html", b"")]
        try:
            list(warc.parse_arc(raw[:-3].replace(b"http://x", b"http://x y")))
            raise AssertionError("a malformed record line was accepted")
        except ValueError:
            pass


def near_kept(rows, words=5):
    """Ids that stay when one document of each group of texts with Jaccard similarity 0.8 or more of word shingles stays."""
    sets, owners = {}, collections.defaultdict(list)
    for i, t in rows:
        w = re.findall("[^\\x20\\x09-\\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k: k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
        for g in sets[i]:
            owners[g].append(i)
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    shared = collections.Counter((a, b) for o in owners.values() for k, a in enumerate(o) for b in o[k + 1:])
    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i for i in root if find(i) == i}


def test_pipeline(spark):
    """Every stage against plain Python on its own input."""
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs = table(spark, SF, "documents")
    labels = table(spark, SF, "labels")
    seen, inputs, outputs = docs, [], []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        inputs.append({r.doc_id: r for r in seen.collect()})
        out = spark.createDataFrame(out.collect(), docs.schema)
        outputs.append({r.doc_id: r for r in out.collect()})
        assert out.count() == len(outputs[-1])
        seen = out
    # the classifier keeps what lies above its cutoff, with the weights summed in plain Python
    ratio, least = quality.fit(docs, labels)
    keys = {r.doc_id: r._key for r in quality.weighted(docs.select("doc_id", "text"), ratio).select("doc_id", "_key").collect()}
    assert set(outputs[0]) == {i for i, k in keys.items() if k >= least}
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    assert len(good & set(outputs[0])) >= 0.95 * len(good & set(inputs[0]))
    top = {}
    for i, r in inputs[1].items():
        top[r.text] = max(i, top.get(r.text, i))
    assert set(outputs[1]) == set(top.values())
    assert set(outputs[2]) == near_kept([(i, r.text) for i, r in inputs[2].items()])
    for before, after in zip(inputs[:3], outputs[:3], strict=True):
        assert all(after[i] == before[i] for i in after)
    spans = {r.doc_id: r.spans for r in secret_scan.secrets(spark.createDataFrame(list(inputs[3].values()), docs.schema)).collect()}
    assert set(outputs[3]) == set(inputs[3])
    for i, r in outputs[3].items():
        ranges = sorted(tuple(map(int, x.split(":")[1:])) for x in spans[i].split(",") if x)
        text, done, to = inputs[3][i].text, [], -1
        for x, y in ranges:
            if x > to:
                done.append([max(to, 0), x])
            to = max(to, y)
        want = "".join(text[x:y] + secret_scan.MASK for x, y in done) + text[max(to, 0):] if ranges else text
        assert r.text == want and r.n_chars == len(want)
    check_packing(corpus_pipeline.run(spark, SF).collect(), [(i, r.text) for i, r in outputs[3].items()])


def test_pipeline_stages_on_edges(spark, edge, nothing):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, edge, SF).columns == edge.columns
        assert stage(spark, nothing, SF).count() == 0


def test_library_stands_without_this_package(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    copy = tmp_path / "repo"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_entry_without_a_tokenizer_library():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = ("import sys, warnings; sys.modules['public_tokenizers'] = None; warnings.simplefilter('error');\n"
            "import __spark_entry__ as e\n"
            "try:\n    e.queries()\nexcept UserWarning as w:\n    print('warned', w)\n"
            "warnings.simplefilter('ignore'); q = e.queries(); assert len(q) > 80 and not any(n.startswith('op') for n in q)")
    out = subprocess.run([sys.executable, "-c", code], cwd=root, check=True, capture_output=True, text=True)
    assert "public_tokenizers" in out.stdout
