"""Repeated substrings, hard negatives and conversations, each against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanfold.llm import conversations, minhash, mixing, negatives, neighbours, suffixes


def _later(pieces, ages, length):
    seen, out = set(), [None] * len(pieces)
    for k in sorted(range(len(pieces)), key=lambda k: ages[k]):
        windows = [pieces[k][i : i + length] for i in range(len(pieces[k]) - length + 1)]
        out[k] = []
        for w in windows:
            out[k].append(w in seen)
            seen.add(w)
    return out


def test_suffix_sort_finds_later_windows():
    rng = random.Random(3)
    for _ in range(120):
        length, letters = rng.choice([4, 10, 27, 30, 100]), rng.choice([1, 2, 4])
        pieces = [bytes(rng.randrange(letters) for _ in range(length + rng.randrange(60))) for _ in range(rng.randint(1, 12))]
        pieces += [rng.choice(pieces) for _ in range(3)]
        ages = np.array(rng.sample(range(100), len(pieces)))
        assert [x.tolist() for x in suffixes.later_windows(pieces, ages, length)] == _later(pieces, ages, length)


def _kept(rows, length=100):
    """Brute force over (order, id, text)."""
    out, seen = {}, set()
    for k, (i, text) in sorted(enumerate(rows), key=lambda r: (r[1][0] is None, r[1][0] or 0, r[0])):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for at in range(len(b) - length + 1):
            w = b[at : at + length]
            if w in seen:
                gone[at : at + length] = b"\1" * length
            seen.add(w)
        spans = sum(gone[at] and not (at and gone[at - 1]) for at in range(len(b)))
        out[k] = (i, len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone, strict=True) if not g))
    return sorted(out.values(), key=repr)


def _texts():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 9)))
    some = lambda n: " ".join(word() for _ in range(n))
    passage, template = some(40), some(30)
    rows = [(5, some(50) + passage + some(20)), (2, some(10) + passage), (9, passage + passage), (7, None), (8, ""), (10, "x" * 99), (11, "x" * 100), (12, "x" * 450), (13, "x" * 130)]
    rows += [(20 + i, template[: 90 + i] + some(3) + template[60:] + some(2)) for i in range(30)]
    rows += [(60, rows[0][1]), (61, rows[0][1][:-7]), (None, some(5) + passage), (2, some(10) + passage), (2, rows[1][1])]
    long = some(120_000)
    rows += [(70, long + passage + long[1000:40_000] + some(2000)), (71, some(100) + long[300_000:301_000])]
    return rows


@pytest.mark.parametrize("hot", [None, 1])
def test_repeats_match_brute_force(spark, monkeypatch, hot):
    if hot:  # every anchor takes the way of the crowded ones
        monkeypatch.setattr(suffixes, "HOT", hot)
    rows = _texts()
    assert len(rows[-2][1].encode()) > 1.2 * suffixes.PIECE
    df = spark.createDataFrame([(i, t, 1, "q", 0.5, 3) for i, t in rows], "doc_id long, text string, row int, h string, states double, at int").coalesce(1)
    got = [(r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in suffixes.drop_repeats(df).collect()]
    assert sorted(got, key=repr) == _kept(rows)
    assert suffixes.drop_repeats(df.limit(0)).count() == 0


def _mined(rows):
    ok = []
    for k, (i, v, label) in enumerate(rows):
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            ok.append((k, i, (label + 1) % 10 if i % 7 == 0 else label, np.floor(256 * np.array(v, float)).astype(int).tolist()))
    out = []
    for k, i, label, v in ok:
        if i % 100:
            continue
        near = sorted((-sum(p * q for p, q in zip(v, w, strict=False)), j, m, other) for m, j, other, w in ok if m != k)
        for s, j, _, other in [x for x in near if x[3] == label][:5]:
            bad = [(t, n) for t, n, _, o in near if o != label and 80 * -s <= 100 * -t <= 100 * -s][:5]
            out += [(i, j, r + 1, n, -s, -t) for r, (t, n) in enumerate(bad)]
    return sorted(out)


def test_hard_negatives_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 16)
    monkeypatch.setattr(negatives, "PIVOTS", 5)
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(0, 0.3, 12).tolist(), int(rng.integers(0, 4))) for k in range(300)]
    rows += [(300 + k, rows[100][1], k % 3) for k in range(60)]  # equal vectors, ties by id
    rows += [(400, None, 1), (500, [float("nan")] + [0.1] * 11, 1), (600, [0.1] * 12, None), (None, [0.2] * 12, 1), (700, [0.0] * 12, 2), (800, [0.3] * 5, 1), (200, rows[3][1], 1), (900, [None] + [0.1] * 11, 1), (501, [float("inf")] * 12, 0)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, row int, v int")
    # floats as they are stored
    stored = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    got = sorted(tuple(r) for r in negatives.hard_negatives(negatives.prepared(df)).collect())
    assert got == _mined(stored) and len(got) > 60
    assert negatives.hard_negatives(negatives.prepared(df.limit(0))).count() == 0
    assert negatives.hard_negatives(negatives.prepared(df.where("vec_id = 100"))).count() == 0


def test_scores_of_large_vectors_are_exact(spark):
    big = [(0, [1.5e6, 3e6]), (1, [2e6, 1e6]), (2, [2e6, 1e6 - 1 / 256]), (3, [-1e6, 2e6])]
    df = spark.createDataFrame([(i, v, i % 2) for i, v in big], "vec_id long, embedding array<double>, label int")
    got = sorted(tuple(r) for r in negatives.hard_negatives(negatives.prepared(df)).collect())
    # 0 becomes label 1, as do 1 and 3
    v = {i: [int(np.floor(256 * x)) for x in w] for i, w in big}
    score = lambda i: sum(p * q for p, q in zip(v[0], v[i], strict=True))
    assert score(1) > 1 << 57
    want = [(0, i, 1, 2, score(i), score(2)) for i in (1, 3) if 80 * score(i) <= 100 * score(2) <= 100 * score(i)]
    assert got == want and want
    with pytest.raises(ValueError, match="long"):
        negatives.hard_negatives(negatives.prepared(df.withColumn("embedding", F.transform("embedding", lambda x: x * 1e4))))


def _cheapest(rows):
    """(cost, edits) by trying all, for rows (initial, faulty, truncated)."""
    best = None

    def go(i, g, cost, edits, run):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(rows) and g in (0, 3):
            best = min(best or (cost, edits), (cost, edits))
        steps = {0: "u", 1: "u", 2: "a", 3: "u"}[g]
        if run < 3:
            go(i, {"u": 2, "a": 3}[steps], cost + 2, edits + "I", run + 1)
        if i < len(rows):
            initial, faulty, late = rows[i]
            go(i + 1, g, cost + 3, edits + "D", 0)
            if not faulty:
                if initial == steps or (g == 0 and initial == "s"):
                    go(i + 1, {"s": 1, "u": 2, "a": 3}[initial], cost + late, edits + "K", 0)
                go(i + 1, {"u": 2, "a": 3}[steps], cost + 2 + late, edits + "R", 0)

    go(0, 0, 0, "", 0)
    return best


def test_composition_finds_the_cheapest_edits():
    rng = random.Random(1)
    for _ in range(250):
        rows = [(rng.choice("ssuuuaaat"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randrange(7))]
        search = conversations.Search()
        for r in rows:
            search.read(*r)
        cost, put, back = search.end()
        edits = "".join("I" * len(b) + e for b, e, _ in list(back)[::-1]) + "I" * len(put)
        assert (cost, edits) == _cheapest(rows)


def _repaired(rows):
    by = {}
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        own = by.setdefault(c, [])
        if kind:
            text = "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text
            own += [(t is not None, t or 0, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for c, own in by.items():
        own.sort()
        seen, facts, counts = set(), [], [0, 0, 0]
        for _, _, role, text in own:
            bare = text.strip(" \t\n\v\f\r")
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            facts.append((role[:1], fault in (0, 1), fault == 2))
        turns = [t for known, t, _, _ in own if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(facts, facts[1:], strict=False))
        cost, edits = _cheapest(facts)
        lines, g, i = [], 0, 0
        for e in edits:
            to = {0: "u", 1: "u", 2: "a", 3: "u"}[g]
            role, text = ("", "") if e == "I" else own[i][2:]
            i += e != "I"
            if e == "D":
                continue
            lines.append((role if e == "K" else conversations.ROLES[to]) + ":" + text)
            g = {"s": 1, "u": 2, "a": 3}[role[0] if e == "K" else to]
        out.append((c, gaps, *counts, illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_conversations_match_brute_force(spark):
    rng = random.Random(4)
    texts = ["Yes.", "No", " ", "", "ok! ", "Why?\n", "so\x0b", None, "x" * 3000 + "."]
    rows = []
    for c in [*range(60), None]:
        for _ in range(rng.randrange(1, 7)):
            rows.append((c, rng.choice([None, 0, 1, 2, 3, 5]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""]), rng.choice(texts)))
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], "conv_id long, turn long, role string, text string, pos int, key string")
    got = sorted((tuple(r) for r in conversations.repaired(conversations.damaged(df)).collect()), key=repr)
    assert got == _repaired(rows)
    said = conversations.messages(conversations.damaged(df)).where("conv_id = 3").orderBy("pos", "nth").collect()
    assert hashlib.sha256("\n".join(f"{m.role}:{m.text}" for m in said).encode()).hexdigest() == next(r for r in got if r[0] == 3)[-1]
    assert conversations.repaired(conversations.damaged(df.limit(0))).count() == 0
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    empty = conversations.repaired(conversations.damaged(spark.createDataFrame([(dropped, 0, "user", "a")], df.select("conv_id", "turn", "role", "text").schema))).first()
    assert tuple(empty) == (dropped, *[0] * 6, "", hashlib.sha256(b"").hexdigest())


def test_long_conversations_stay_small(spark):
    df = spark.range(30_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.col("id").cast("string"), F.lit(".")).alias("text"))
    r = conversations.repaired(df.withColumn("alive", F.lit(True))).first()
    assert r.cost == 0 and r.audit == "K" * 30_000 and r.gaps == 0


def test_dedup_of_clashing_columns(spark):
    rows = [(i, "the same words again and again " + ("" if i in (1, 2) else str(i) * 30), "g", 1, 2, 3) for i in (1, 2, 3, None, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone_id string, id int, `row` int, nth int")
    kept = minhash.one_of_each_group(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3]
    assert minhash.one_of_each_group(df.limit(0)).columns == df.columns


def test_parts_of_a_source_are_even_for_regular_ids(spark):
    sized = spark.range(20_000).select((F.col("id") * 41).alias("mix_id"), F.lit("s").alias("mix_source"), F.lit(9).cast("long").alias("mix_size"))
    sizes = sized.groupBy(F.col("mix_source").alias("source")).agg(F.sum("mix_size").alias("source_size"), F.count("*").alias("n_docs"))
    plan = mixing.systematic_copies(sized, mixing.source_targets(sizes))
    assert plan.agg(F.sum("copies")).first()[0] == 20_000
    x = F.pmod(F.col("mix_id"), F.lit(mixing.SPREAD_PRIME)) * F.lit(mixing.SPREAD)
    part = F.pmod(F.shiftright(x.bitwiseAND(F.lit((1 << 32) - 1)), 16), F.lit(41))
    assert sized.groupBy(part).count().agg(F.max("count")).first()[0] < 700


def test_vectors_of_each_length_link_among_themselves(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [0.99, 0.01, 0.0]), (4, [1.0]), (5, [2.0, 0.0]), (20, [])] + [(6 + i, [1.0, float(i), 0.0, -float(i)]) for i in range(5)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in neighbours.similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got[1] == got[2] == got[3] == (2, 1) and got[4] == (0, 4) and got[5] == (0, 5) and got[20] == (0, 20)
    assert got[6] == (0, 6) and got[9] == (2, 7)
