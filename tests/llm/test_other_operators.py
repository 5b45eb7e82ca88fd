"""Vectors, web pages, urls, the pipeline and the registry."""

from __future__ import annotations

import gzip
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scanfold.llm import components, durable, neighbours, queries, sampling, urlfilter, warc


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 140)] + [(5, 5), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def _brute(rows, threshold=0.95):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            ok[i] = x / np.linalg.norm(x)
    root, links = {i: i for i, _ in rows if i is not None}, dict.fromkeys((i for i, _ in rows if i is not None), 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(ok)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if ok[a] @ ok[b] >= threshold:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (links[i], find(i)) for i in root}


def test_vectors_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF", 16)
    monkeypatch.setattr(neighbours, "LEAF_MOST", 48)
    monkeypatch.setattr(neighbours, "BLOCK", 32)
    rng = np.random.default_rng(7)
    rows, nr = [], 0
    for size in (1, 1, 2, 3, 70, 40, 1, 2, 5):
        centre = rng.standard_normal(8)
        for _ in range(size):
            rows.append((nr, (centre + rng.standard_normal(8) * 0.05).tolist()))
            nr += 1
    rows += [(nr + i, rng.standard_normal(8).tolist()) for i in range(150)]
    nr += 150
    rows += [(nr, None), (nr + 1, [0.0] * 8), (nr + 2, [float("nan")] + [1.0] * 7), (nr + 3, [1.0] * 3), (nr + 4, [None] + [1.0] * 7), (nr + 5, rows[0][1]), (nr + 6, [2 * x for x in rows[0][1]]), (nr + 7, [float("inf")] * 8)]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, label int, component_id int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in neighbours.similar_vectors(table).collect()}
    assert got == _brute(rows)


def _tight_groups(spark):
    """Two groups of near vectors, 0.999 within and 0.96 across, and vectors apart from them."""
    rng = np.random.default_rng(11)
    a, b = np.eye(8)[0], 0.965 * np.eye(8)[0] + np.sqrt(1 - 0.965**2) * np.eye(8)[1]
    rows = [(i, ((a if i % 2 else b) + rng.standard_normal(8) * 0.002).tolist()) for i in range(40)]
    rows += [(40 + i, rng.standard_normal(8).tolist()) for i in range(20)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_vectors_keep_links_between_tight_groups(spark, monkeypatch):
    rows, table = _tight_groups(spark)
    monkeypatch.setattr(neighbours, "_one_group", None)  # the audit passes
    got = {r.vec_id: (r.n_links, r.component_id) for r in neighbours.similar_vectors(table).collect()}
    assert got == _brute(rows) and got[0] == (39, 0)


def test_vectors_are_all_compared_when_the_audit_fails(spark, monkeypatch):
    rows, table = _tight_groups(spark)
    none = np.zeros(0, np.int64)
    monkeypatch.setattr(neighbours, "_spanning", lambda ok: (none, none))
    monkeypatch.setattr(neighbours, "FORESTS", 1)
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    got = {r.vec_id: (r.n_links, r.component_id) for r in neighbours.similar_vectors(table).collect()}
    assert got == _brute(rows)
    monkeypatch.setattr(neighbours, "WHOLE_MOST", 50)
    with pytest.raises(RuntimeError, match="recall"):
        neighbours.similar_vectors(table)


def test_descent_finds_what_the_start_graph_lacks(spark, monkeypatch):
    """2,000 vectors with planted groups: two trees find part of the links, descent from them nearly all."""
    rng = np.random.default_rng(3)
    rows = []
    for size in [1] * 1100 + [2] * 200 + [5] * 60 + [30] * 6:
        centre = rng.standard_normal(32)
        rows += [(centre + rng.standard_normal(32) * 0.1 * (size > 1)).tolist() for _ in range(size)]
    x = np.array(rows)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = int((x @ x.T >= 0.95).sum()) - len(x)
    classes = spark.createDataFrame([(i, v.tobytes(), 1) for i, v in enumerate(x)], "rep long, unit binary, copies long")

    def listed():
        lists = neighbours.neighbour_lists(classes, len(x), 32, 0.95, 1, 2, None)
        checked = neighbours.audit(lists, classes.withColumn("component", F.lit(0)), len(x), 0.95, 1)
        assert checked.vectors == 1024 and checked.links == checked.found
        return lists.where("sim >= 0.95").count() / true

    monkeypatch.setattr(neighbours, "LEAF", 64)
    whole = listed()
    monkeypatch.setattr(neighbours, "ROUNDS", 0)
    assert listed() < 0.6 < 0.99 < whole
    monkeypatch.undo()
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in neighbours.similar_vectors(table).collect()}
    assert [got[i] for i in range(len(x))] == ((x @ x.T >= 0.95).sum(axis=1) - 1).tolist()


def test_vectors_edge_cases(spark):
    schema = "vec_id long, embedding array<float>"
    assert neighbours.similar_vectors(spark.createDataFrame([], schema)).count() == 0
    got = neighbours.similar_vectors(spark.createDataFrame([(None, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0]), (5, [3.0, 0.0])], schema)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in got) == [(0, 0, 0, True), (3, 1, 3, True), (3, 1, 3, True), (4, 0, 4, True), (5, 1, 3, False)]


def _pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, payload string, payload_bytes int")


def test_archives_round_trip(spark):
    long = "ä" * 80
    rows = [(5, "http://a/1", long), (3, "http://a/2", long), (9, None, long), (4, "http://a\r\nX: y", "short"), (2, "u", "short"), (1, "u", None), (8, "u", ""), (None, "u", long), (6, "u", "x" * 99), (7, "u", "x" * 99), (10, "u", "WARC/1.1\r\n\r\n" * 20), (11, "u", "y" * 3_000_000)]
    got = warc.archive_pages(_pages(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for i, _, h in rows:
        raw = (h or "").encode()
        r = by[i]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        revisit = i in (5, 9)
        assert (r.record_type, r.refers_to) == (("revisit", 3) if revisit else ("response", None))
        assert bytes(r.block) == (b"" if revisit else raw)
    assert warc.archive_pages(_pages(spark, [])).count() == 0


def test_normaliser_makes_members(tmp_path):
    records = [warc.record_bytes([("WARC-Type", "response"), ("N", str(i))], bytes([i % 256]) * (i * 37)) for i in range(60)]
    whole = gzip.compress(b"".join(records[:30])) + gzip.compress(b"".join(records[30:]))
    (tmp_path / "m.gz").write_bytes(whole)
    n = warc.normalise(*(f"file://{tmp_path}/{x}" for x in ("m.gz", "n.gz", "n.idx")))
    assert n == 60
    data = (tmp_path / "n.gz").read_bytes()
    spans = [tuple(map(int, x.split("\t"))) for x in (tmp_path / "n.idx").read_text().splitlines()]
    assert spans[-1][0] + spans[-1][1] == len(data)
    for (a, k), r in zip(spans, records, strict=True):
        assert gzip.decompress(data[a : a + k]) == r
    (tmp_path / "bad.gz").write_bytes(gzip.compress(b"".join(records)[:-3]))
    with pytest.raises(ValueError, match="within a record"):
        warc.normalise(*(f"file://{tmp_path}/{x}" for x in ("bad.gz", "o.gz", "o.idx")))
    # a stream flushed and cut at a record boundary, without its end
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    (tmp_path / "cut.gz").write_bytes(z.compress(b"".join(records[:3])) + z.flush(zlib.Z_FULL_FLUSH))
    with pytest.raises(EOFError):
        warc.normalise(*(f"file://{tmp_path}/{x}" for x in ("cut.gz", "o.gz", "o.idx")))


def test_urls(spark):
    cases = [
        ("http://Example.NET/en/x?q", "example.net", "/en/x", "example.net/en/", "allow"), ("http://a.example.net/de/", "a.example.net", "/de/", "net/", "block"), ("http://net", "net", "", None, "allow"),
        ("http://myexample.com/de/1", "myexample.com", "/de/1", None, "allow"), ("http://www.example.com/de/1#x", "www.example.com", "/de/1", "example.com/de/", "block"), ("x://b.org/fr/?a", "b.org", "/fr/", "org/fr/", "allow"),
        ("http://h.example/casino-x", "h.example", "/casino-x", None, "block"), ("http://h.example/casinos", "h.example", "/casinos", None, "allow"), ("http://h.example/free/free", "h.example", "/free/free", None, "allow"),
        ("http://h.example/FREE/poker", "h.example", "/FREE/poker", None, "block"), ("no scheme /de/", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("a://b://c/d", "b:", "//c/d", None, "allow"),
        ("http://x.example/" + "a" * 100_000, "x.example", "/" + "a" * 100_000, None, "allow"), ("http://ÄÖ.Org/fr/", "ÄÖ.org", "/fr/", "org/fr/", "allow"),
    ]
    table = spark.createDataFrame([(i, c[0], "h", "r") for i, c in enumerate(cases)] + [(None, "http://q.example", "h", "r"), (0, cases[0][0], "h", "r")], "page_id long, url string, host string, rule string")
    got = urlfilter.judge_urls(table).collect()
    assert len(got) == len(cases) + 2
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    for i, c in enumerate(cases):
        assert by[i] == c[1:]
    assert urlfilter.judge_urls(table.limit(0)).count() == 0


def test_pipeline_stages(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_dedup", "redact_pii", "mix_sources", "pack"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in out.select("doc_id").collect()}
        out = stage(spark, out, sf_dir)
        assert out.columns == docs.columns
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        assert set(ids) <= before
        if name == "quality_classifier":
            good = {d for d, q in labels.items() if q == 1}
            assert len(good - set(ids)) <= 0.05 * len(good)
        if name == "near_dedup":
            assert len(ids) == len(set(ids))
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_pipeline_packs_whole_sequences(spark, sf_dir):
    from tokenizers import Tokenizer

    rows = [(1, "one two three"), (1, "one two three"), (2, "word " * 5000), (2, "word " * 5000), (None, "nobody"), (None, "no one"), (3, None), (4, "")]
    got = corpus_pipeline.pack(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir).collect()
    encode = Tokenizer.from_file(queries.tokenizer_path()).encode
    # each row's ids, in order, by its copy
    texts = {}
    for r in sorted(got, key=lambda r: (r.copy, r.piece)):
        assert r.ids_crc32 == zlib.crc32(r.ids) and r.start == len(texts.get((r.doc_id, r.copy), ()))
        texts.setdefault((r.doc_id, r.copy), []).extend(np.frombuffer(r.ids, np.uint32).tolist())
    want = [(i, [*(encode(t or "", add_special_tokens=False).ids), 0]) for i, t in rows]
    assert sorted(map(str, ((i, t) for (i, _), t in texts.items()))) == sorted(map(str, want))
    # and each sequence is built from the ids of its pieces
    sequences = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == len(sequences.setdefault(r.sequence_id, []))
        sequences[r.sequence_id] += np.frombuffer(r.ids, np.uint32).tolist()
    assert max(map(len, sequences.values())) <= 2048 and sum(map(len, sequences.values())) == sum(len(t) for _, t in want)


def test_samples_are_bounded_and_fixed(spark):
    df = spark.range(20_000)
    one = {r.id for r in sampling.hash_share(df, F.col("id"), 1000).collect()}
    assert 850 < len(one) < 1150 and one == {r.id for r in sampling.hash_share(df.repartition(7), F.col("id"), 1000).collect()}
    assert sampling.hash_share(df.limit(10), F.col("id"), 1000).count() == 10


def test_session_values_are_kept(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "77")
    durable.bounded_batches(spark)
    assert spark.conf.get(key) == "77"
    spark.conf.set(key, before)


def test_registry():
    names = queries.queries()
    assert {n.split("_")[0] for n in names} == {f"op{i}" for i in range(1, 14)}
    assert set(queries.oracle_sql()) <= set(names)
