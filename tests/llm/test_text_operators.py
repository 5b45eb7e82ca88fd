"""Operators over document texts against brute force, with nulls, empties, ties, repeats and clashing columns."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib
from array import array

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scanfold.llm import fingerprint, grouping, minhash, mixing, packing, passages, pii, quality, queries, tokens, trees

WORD = r"[^\x20\x09-\x0D]+"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, component_id long, score double"


def docs(spark, rows):
    """Rows (doc_id, text[, source]) in a table with columns that clash with the operators' own."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 7, 8, 0.5) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(text):
    return re.findall(WORD, (text or "").translate(FOLD))


def shingles(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def components(sets, linked):
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and linked(sets[a], sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def corpus(seed=1, n=40):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, base = [], [rng.choice(vocabulary) for _ in range(60)]
    for i in range(n):
        kind = i % 4
        if kind == 0:
            w = [rng.choice(vocabulary) for _ in range(rng.randint(1, 80))]
        elif kind == 1:
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        elif kind == 2:
            w = base[: rng.randint(40, 60)]
        else:
            w = [x.upper() if rng.random() < 0.3 else x for x in base]
        rows.append((i + 10, " ".join(w)))
    return rows


EDGE = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one  two\n")]


@pytest.mark.parametrize(("width", "num"), [(3, 85), (5, 80)])
def test_minhash_matches_brute_force(spark, width, num):
    rows = EDGE + corpus(3, 60)
    got = {r.doc_id: r for r in minhash.minhash_components(docs(spark, rows), shingle=width, num=num).collect()}
    sets = {d: shingles(t, width) for d, t in rows}
    want = components(sets, lambda a, b: 100 * len(a & b) >= num * len(a | b))
    assert {d: r.component_id for d, r in got.items()} == want
    assert {d: r.n_shingles for d, r in got.items()} == {d: len(s) for d, s in sets.items()}
    assert all(r.kept == (d == r.component_id) for d, r in got.items())


def test_minhash_large_group_of_near_copies(spark):
    rng = random.Random(2)
    base = [f"b{i}" for i in range(70)]
    rows = []
    for i in range(700):
        w = list(base)
        for _ in range(i % 5):
            w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in minhash.minhash_components(docs(spark, rows), shingle=3, num=85).collect()}
    assert got == components({d: shingles(t, 3) for d, t in rows}, lambda a, b: 100 * len(a & b) >= 85 * len(a | b))


def test_long_patterned_words_are_told_apart(spark):
    """Thue-Morse words collide in polynomials modulo 2 ** 64; documents that differ in one share a third of their shingles."""
    bits = [bin(k).count("1") & 1 for k in range(1024)]
    a, b = ("".join("ab"[x ^ flip] for x in bits) for flip in (0, 1))
    got = minhash.minhash_components(docs(spark, [(1, f"{a} one two three"), (2, f"{b} one two three"), (3, f"{a.upper()} one two three")]), shingle=3, num=85)
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == [(1, 1), (2, 2), (3, 1)]


def test_minhash_groups_that_their_hub_does_not_join(spark, monkeypatch):
    """Chains of copies, each near the next and far from the first, in clusters of several blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(grouping, "HOT_ROWS", 5)
    rng = random.Random(5)
    rows = []
    for g in range(3):
        words = [f"w{g}x{rng.randrange(10**6)}" for _ in range(80)]
        for k in range(40):
            rows.append((100 * g + k, " ".join(words)))
            words[rng.randrange(80)] = f"e{g}x{k}"
    got = {r.doc_id: r.component_id for r in minhash.minhash_components(docs(spark, rows), shingle=2, num=80).collect()}
    assert got == components({d: shingles(t, 2) for d, t in rows}, lambda a, b: 100 * len(a & b) >= 80 * len(a | b))


def test_minhash_null_and_repeated_ids(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (3, "z y x w"), (3, "a b c d")]
    got = minhash.minhash_components(docs(spark, rows), shingle=3, num=85).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (3, 1, False)]
    assert minhash.minhash_components(docs(spark, []), shingle=3).count() == 0
    kept = minhash.one_of_each_group(docs(spark, rows), shingle=3, num=85)
    assert kept.columns == docs(spark, []).columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1]


def test_bit_counts_estimate_similarity():
    rng = np.random.default_rng(0)
    shared, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (800, 100, 100))
    h = np.concatenate((shared, a, shared, b))
    packed = minhash.pack(minhash.minima(h, np.array([0, 900, 1800])))
    d = packed[0] ^ packed[1]
    same = minhash.PERMUTATIONS - int(np.bitwise_count((d | (d >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum())
    assert abs(minhash.similarity_from_matches(same / minhash.PERMUTATIONS) - 0.8) < 0.15
    assert same >= minhash.least_matches(0.8)


def test_word_encoder_matches_the_tokenizer(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    encode = Tokenizer.from_file(path).encode
    rng = np.random.default_rng(11)
    signs = [*"aAbBéÉß'<|>  \t\n\r\x0b\x0c\x1c\x85\xa0.,!?-0123٣Ⅷ×÷ª€漢字русский\u0301\u0301İİıſƏɐ\u2028\u3000\x00\x7f", "'s", "'ll", "<|endoftext|>", "<|startoftext|>", "abcdefghijklmnopqrstuvwxyz", "ﬁ", "🙂"]
    texts = ["".join(rng.choice(signs, rng.integers(0, 40))) for _ in range(4000)] + [None, "", " ", "\n\n", "x" * 5000, "x" * 5000, "word " * 3000]
    one = tokens.WordEncoder(path)
    for limit, rounds in ((tokens.CACHE_WORDS, 2), (50, 1)):  # words kept, and forgotten at every pass
        monkeypatch.setattr(tokens, "CACHE_WORDS", limit)
        monkeypatch.setattr(tokens, "PASS_BYTES", 10_000)
        for _ in range(rounds):
            for lo, hi, ids, bounds in tokens.encoded(one, pa.array(texts), 0):
                for k, t in enumerate(texts[lo:hi]):
                    assert ids[bounds[k] : bounds[k + 1]].tolist() == [*encode(t or "", add_special_tokens=False).ids, 0]


def test_word_encoder_stays_small_over_ever_new_words(monkeypatch):
    """What a worker keeps and its scratch arrays do not grow with the texts that it has met; ids stay the tokenizer's."""
    import tracemalloc

    import pyarrow as pa
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    encode = Tokenizer.from_file(path).encode
    fresh = ("".join(chr(97 + n // 26**k % 26) for k in range(5)) for n in range(1_000_000))
    one, kept = tokens.WordEncoder(path), 0
    for _ in range(30):
        text = " ".join([*(next(fresh) for _ in range(10_000)), "met every time"])
        (_, _, ids, _), *_ = tokens.encoded(one, pa.array([text]), 0)
        kept = max(kept, len(one.first))
    assert ids.tolist() == [*encode(text, add_special_tokens=False).ids, 0]
    assert kept < 275_000
    # words met again are kept, and so are not asked for anew
    one.thin()
    assert 1 < len(one.first) < 100
    monkeypatch.setattr(one, "_ask", None)
    (_, _, ids, _), *_ = tokens.encoded(one, pa.array(["time every met"]), 0)
    assert ids.tolist() == [*encode("time every met", add_special_tokens=False).ids, 0]

    monkeypatch.setattr(tokens, "CACHE_BYTES", 1 << 20, raising=False)
    long = tokens.WordEncoder(path)
    for k in range(30):
        text = " ".join(f"漢字{k}x{i}'" * 60 for i in range(100))
        (_, _, ids, _), *_ = tokens.encoded(long, pa.array([text]), 0)
        assert ids.tolist() == [*encode(text, add_special_tokens=False).ids, 0]
        assert long.ids.nbytes + sum(map(len, long.long)) < (1 << 20) + 4 * len(ids) + len(text.encode())

    many = pa.array(["some words of a text, over and over. " * 30] * 4_000)
    tracemalloc.start()
    for _ in tokens.encoded(tokens.WordEncoder(path), many, 0):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6, peak


def test_words_with_one_key_are_told_apart(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    encode = Tokenizer.from_file(path).encode
    monkeypatch.setattr(tokens, "mix64", lambda x: np.zeros_like(x))
    one = tokens.WordEncoder(path)
    for text in ("one two three two one", "three four five one"):
        (_, _, ids, _), *_ = tokens.encoded(one, pa.array([text]), 0)
        assert ids.tolist() == [*encode(text, add_special_tokens=False).ids, 0]


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    rows = EDGE + corpus(5, 20) + [(90, "It's <|endoftext|> İ a\x1cb “quoted”... 3.14"), (91, "word " * 5000), (None, "null id"), (4, "one")]
    t = Tokenizer.from_file(path)
    table = docs(spark, rows)
    pieces = packing.tokenize_pieces(table, path, max_len=256)
    got = packing.place_pieces(pieces, 2, max_len=256).toPandas()
    want = collections.Counter()
    for d, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for p, at in enumerate(range(0, len(ids), 256)):
            part = ids[at : at + 256]
            want[(d, p, at, len(part), array("I", part).tobytes())] += 1
    assert collections.Counter((None if pd.isna(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids) for r in got.itertuples()) == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        ends = np.cumsum(g["length"])
        assert (g["offset"].to_numpy() == np.concatenate(([0], ends[:-1]))).all() and ends.iloc[-1] <= 256
    assert packing.place_pieces(packing.tokenize_pieces(docs(spark, []), path), 1).count() == 0


def test_best_fit_takes_the_tightest_bin():
    rng = np.random.default_rng(1)
    for _ in range(30):
        lengths = rng.integers(1, 100, rng.integers(1, 200))
        bins, offsets = packing.best_fit_decreasing(lengths, 100)
        room = []
        want = {}
        for i in np.argsort(-lengths, kind="stable"):
            fit = [(r, -k) for k, r in enumerate(room) if r >= lengths[i]]
            if fit:
                k = next(k for k, r in enumerate(room) if r == min(fit)[0])
            else:
                room.append(100)
                k = len(room) - 1
            room[k] -= lengths[i]
            want[i] = k
        assert bins.max() + 1 == len(room)
        assert all(lengths[bins == b].sum() <= 100 for b in range(len(room)))
        assert sorted(100 - lengths[bins == b].sum() for b in range(len(room))) == sorted(room)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": lambda: True, "ip": lambda m=m: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda d=d: 13 <= len(d) <= 19 and pii.luhn(d), "phone": lambda d=d: 9 <= len(d) <= 15}[kind]():
                out.append((kind, m.start(), m.end()))
    return out


def test_pii_base_matches_the_patterns():
    rng = random.Random(4)
    for _ in range(20_000):
        text = "".join(rng.choice("1234567@.+- ()ab0é") for _ in range(rng.randint(0, 45)))
        assert pii.base_spans(text) == base_spans(text), text
    assert pii.base_spans("Mail bob@x.example.com, card 4111 1111 1111 1111 or +1 (212) 555-1234 at 10.0.0.1.") == [("email", 5, 22), ("ip", 73, 81), ("card", 29, 48), ("phone", 52, 69)]


def test_card_and_phone_candidates_match_brute_force():
    """In rejected runs all ranges of whole digit groups with the right number of digits are proposed."""
    rng = random.Random(8)
    for _ in range(300):
        text = "x " + "".join(str(rng.randrange(10)) + rng.choice(["", " ", "-", " "]) for _ in range(rng.randint(20, 50))) + "7 y"
        if any(k == "card" for k, _, _ in pii.base_spans(text)):
            continue
        groups = [m.span() for m in re.finditer("[0-9]+", text)]
        want = {(a, b) for i, (a, _) in enumerate(groups) for _, b in groups[i:] if 13 <= len(re.sub("[^0-9]", "", text[a:b])) <= 19 and pii.luhn(re.sub("[^0-9]", "", text[a:b]))}
        assert {(a, b) for k, a, b in pii.candidates(text) if k == "card"} == want
        call = "+" + text[2:-2]
        ends = [m.end() for m in re.finditer("[0-9]+", call)]
        if not any(k == "phone" for k, _, _ in pii.base_spans(call)):
            want = {(0, b) for b in ends if 9 <= len(re.sub("[^0-9]", "", call[:b])) <= 15}
            assert {(a, b) for k, a, b in pii.candidates(call) if k == "phone" and not a} == want


def test_pii_adds_spans_and_redacts(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    filler = []
    for i in range(200):
        spans = [f"user{i}@mail.example.com", f"10.1.{i}.7", f"+1 ({rng.randint(100, 999)}) 555-{1000 + i}", "4111 1111 1111 1111"]
        rng.shuffle(spans)
        filler.append((100 + i, " ".join(x for s in spans for x in [*(word() for _ in range(rng.randint(1, 4))), s]) + (" end" if i % 2 else "")))
    rows = [(1, None), (2, ""), (3, "é +1 (504) 555-2652 191.60.21.84 end"), (4, "plain text"), (4, "plain text"), (None, "a@b.co")] + filler
    table = docs(spark, rows)
    model = pii.train(table)
    got = {r.doc_id: r for r in pii.find_pii(table, model).collect()}
    assert len(pii.find_pii(table, model).collect()) == len(rows)
    assert got[1].spans == "" and got[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    base = base_spans(rows[2][1])
    assert got[3].base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
    assert got[3].n_phone == 1 and "phone:2:19" in got[3].spans and "ip:20:32" in got[3].spans
    red = {r.doc_id: r for r in pii.redact_documents(table, model).collect()}
    assert red[3].text == "é [PHONE] [IP] end" and red[3].n_chars == len(red[3].text)
    assert red[1].text is None and red[4].text == "plain text" and red[None].text == "[EMAIL]"
    assert pii.find_pii(docs(spark, []), pii.train(docs(spark, []))).count() == 0


def test_fingerprints_against_exact_sets(spark):
    rows = EDGE + corpus(8, 40) + [(500, "longer " * 3 + " ".join(f"t{i}" for i in range(3000))), (500, "again"), (None, "no id")]
    got = fingerprint.edited_fingerprints(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(10**9)), r[1] or ""))
    want = []
    for i, (d, t) in enumerate(order):
        t, u = t or "", order[(i + 1) % len(order)][1] or ""
        cut = len(t) // 3
        e = t[: len(t) - cut] + u[:cut]
        a, b, c = shingles(t, 5), shingles(e, 5), shingles(u, 5)
        near = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), near(a, b), near(a, c)))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    have = sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got), key=key)
    for h, w in zip(have, sorted(want, key=key), strict=True):
        assert h[:3] == w[:3]
        assert abs(h[3] - w[3]) < 0.2 and abs(h[4] - w[4]) < 0.2
        if w[1] < 600:  # few shingles are kept whole
            assert h[3] == pytest.approx(w[3]) and h[4] == pytest.approx(w[4])
    assert fingerprint.edited_fingerprints(docs(spark, [])).count() == 0
    one = fingerprint.edited_fingerprints(docs(spark, [(1, "abc def ghi")])).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abc def abc").hexdigest()


def test_sketches_merge_and_estimate():
    whole = " ".join(f"t{i}" for i in range(5000))
    a, b, c = fingerprint.sketches([whole, " ".join(whole.split()[:2500]), " ".join(whole.split()[2496:])])
    assert (fingerprint.merge(b, c) == a).all()
    assert abs(fingerprint.distinct_count(a) / 4996 - 1) < 0.3
    assert fingerprint.containment(b, a) > 0.95 and abs(fingerprint.resemblance(a, b) - 0.5) < 0.15
    assert (fingerprint.decode(fingerprint.encode(a)) == a).all()


def test_passages_finds_planted_and_fuzzy(spark):
    rng = random.Random(9)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    plant, fuzzy = fresh(60), fresh(120)
    edited = list(fuzzy)
    for i in (20, 50, 51, 90):
        edited[i] = "edit"
    del edited[70]
    rows = [
        (1, " ".join(fresh(80) + plant + fresh(30))), (2, " ".join(plant)), (3, " ".join(fresh(10) + plant + fresh(200))),
        (4, " ".join(fresh(40) + fuzzy)), (5, " ".join(edited + fresh(5))), (6, " ".join(fresh(300))), (7, " ".join(fresh(50) + plant[:30] + fresh(40))),
        (8, None), (9, ""), (10, "short"), (None, " ".join(plant)), (11, " ".join(plant)), (11, " ".join(plant)),
    ]
    got = passages.repeated_passages(docs(spark, rows)).collect()
    pairs = {(r.doc_id, r.ref_id) for r in got}
    assert pairs == {(2, 1), (3, 1), (5, 4), (11, 1)}
    text = {d: words(t) for d, t in rows}
    for r in got:
        if r.ref_id == 1:
            assert text[r.doc_id][r.start_word : r.end_word] == text[1][r.ref_start : r.ref_end] == plant and r.similarity == 1
        else:
            assert r.n_words >= 115 and 0.9 < r.similarity < 1
    assert passages.repeated_passages(docs(spark, [])).count() == 0


def test_passages_with_evenly_spaced_edits(spark):
    rng = random.Random(4)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    rows, want = [], {}
    for k, (period, size) in enumerate([(5, 54), (5, 200), (6, 60), (8, 60), (10, 60), (12, 100)] * 2):
        own = fresh(size)
        edited = [w if i % period != period - 1 else f"e{i}" for i, w in enumerate(own)]
        rows += [(2 * k, " ".join(fresh(30) + own + fresh(30))), (2 * k + 1, " ".join(fresh(70) + edited + fresh(10)))]
        # brute force on the diagonal of the plant: all but an edit at the end
        want[2 * k + 1] = (2 * k, 70, 70 + size - (size % period == 0))
    # texts that end with a block of words
    own = fresh(2 * passages.WORDS_BLOCK)
    rows += [(90, " ".join(own)), (91, " ".join(own))]
    want[91] = (90, 0, len(own))
    # agreement of 3 words in 4 without a short seed beyond the margin on both sides of an exact part, longer than the first margin
    own = fresh(3000)
    edited = [w if 1400 <= i < 1600 or i % 4 != 3 else f"e{i}" for i, w in enumerate(own)]
    rows += [(100, " ".join(own)), (101, " ".join(fresh(40) + edited))]
    got = {r.doc_id: (r.ref_id, r.start_word, r.end_word) for r in passages.repeated_passages(docs(spark, rows), least_similarity=0.75).collect()}
    assert got == want | {101: (100, 40, 3039)}


def test_passages_cover_all_shared_runs(spark):
    """Every word that lies in a run of 50 words or more shared with a lesser document is in a passage, by brute force."""
    rng = random.Random(12)
    common = [[f"c{k}w{rng.randrange(10**6)}" for _ in range(rng.randint(52, 90))] for k in range(4)]
    rows = []
    for d in range(40):
        w = [f"d{d}w{rng.randrange(10**6)}" for _ in range(rng.randint(0, 60))]
        for c in rng.sample(common, rng.randint(0, 2)):
            at = rng.randint(0, len(w))
            w[at:at] = c
        rows.append((d, " ".join(w)))
    rows += [(90, "x " * 4000 + " ".join(common[0])), (91, ""), (92, None)]
    texts = {d: words(t) for d, t in rows}
    want = set()
    for d in texts:
        for e in texts:
            if e < d:
                at = collections.defaultdict(list)
                for j in range(len(texts[e]) - 49):
                    at[tuple(texts[e][j : j + 50])].append(j)
                for i in range(len(texts[d]) - 49):
                    if tuple(texts[d][i : i + 50]) in at:
                        want |= {(d, i + k) for k in range(50)}
    found = {(r.doc_id, k) for r in passages.repeated_passages(docs(spark, rows)).collect() for k in range(r.start_word, r.end_word)}
    assert want and len(want - found) == 0 and len(found - want) <= 0.02 * len(want)


def test_chaining_matches_quadratic_search():
    rng = np.random.default_rng(3)
    for _ in range(40):
        n = int(rng.integers(1, 25))
        pos, ref = rng.integers(0, 200, n), rng.integers(0, 200, n)
        best = np.zeros(n)
        for i in np.lexsort((-ref, pos)):
            ok = (pos < pos[i]) & (ref < ref[i])
            gain = (best[ok] - ((pos[i] - pos[ok]) + (ref[i] - ref[ok])) / 16).max(initial=0)
            best[i] = 8 + max(0.0, gain)
        chain = passages.chains(pos, ref)[0]
        assert (np.diff(pos[chain]) > 0).all() and (np.diff(ref[chain]) > 0).all()
        gaps = (pos[chain[-1]] - pos[chain[0]] + ref[chain[-1]] - ref[chain[0]]) / 16
        assert 8 * len(chain) - gaps == pytest.approx(best.max())


def test_quality_learns_and_compiles(spark):
    rng = random.Random(6)
    good = [" ".join(rng.choice(["the", "and", "stone", "river", "light"]) for _ in range(60)) + "." for _ in range(150)]
    bad = [" | ".join(f"X{rng.randrange(99)}!!" for _ in range(40)) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(900, None), (901, ""), (None, good[0]), (0, good[0])]
    table = docs(spark, rows)
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(300)] + [(5000, 1, 0), (None, 0, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(table, labels)
    got = quality.score_documents(table, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 300 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([r.predicted == int(r.doc_id < 150) for r in held]) > 0.95
    data = pd.DataFrame([(r.doc_id, r.score) for r in got], columns=["d", "s"]).dropna().drop_duplicates("d").set_index("d")["s"]
    stats = quality.with_statistics(table.select("doc_id", "text"), "text").toPandas().dropna(subset=["doc_id"]).drop_duplicates("doc_id")
    again = model.score(stats[["stat_" + s for s in quality.STATISTICS]].to_numpy())
    assert np.allclose(again, data.loc[stats["doc_id"]].to_numpy())
    kept = quality.keep_good(table, model)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} >= set(range(150))
    assert len(model.rules) < 200
    none = quality.train(table, labels.limit(0))
    assert quality.score_documents(table, none).where("score = 0.5").count() == len(rows)
    assert quality.score_documents(docs(spark, []), model).count() == 0


def _targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    capped = set()
    while True:
        left = sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        free = sum(w[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and left * w[s] / free > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in capped else left * w[s] / free for s in names}
        capped |= over


def test_statistics_match_brute_force():
    import pyarrow as pa

    texts = ["One two, two THREE!\nfour | five. six; a bb", "", " \n ", "Straße 12 € #x# ok\n\nlast", "w " * 300 + "\n" + "v", "a,b c.d: e!"]
    data, offsets = quality.text_buffers(pa.array(texts))
    got = quality.statistics(data, offsets)
    keep = set(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ.,") | set(range(128, 256))
    for row, text in zip(got, texts, strict=True):
        raw = text.encode()
        w = re.findall(rb"[^\x20\x09-\x0D]+", raw)
        low = [x.translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))) for x in w]
        n, size = len(w), max(1, len(raw))
        pairs = list(zip(low, low[1:], strict=False))
        share = {k: sum(c in v for c in raw) / size for k, v in quality._CLASSES.items()}
        want = {"words": np.log1p(n), "word_length": sum(map(len, w)) / max(1, n), **share, "high": sum(c >= 128 for c in raw) / size, "lines": raw.count(b"\n") / max(1, n), "distinct": len(set(low)) / max(1, n)}
        want |= {"repeated_pairs": 1 - len(set(pairs)) / max(1, n - 1), "marked": sum(x[-1] not in keep for x in w) / max(1, n), "short": sum(len(x) <= 2 for x in w) / max(1, n), "long": sum(len(x) >= 10 for x in w) / max(1, n)}
        want["longest_line"] = np.log1p(max(len(re.findall(rb"[^\x20\x09-\x0D]+", line)) for line in raw.split(b"\n")))
        assert np.allclose(row, [want[k] if n else 0 for k in quality.STATISTICS])


def test_mixing_targets_and_copies(spark):
    rng = random.Random(11)
    rows = []
    for i in range(600):
        source = rng.choice(["b", "B", "a", "é", None, "tiny"]) if i > 20 else "tiny"
        rows.append((i, " ".join(["w"] * (rng.randint(0, 3) if source == "tiny" else rng.randint(0, 120))), source))
    rows += [(700, None, "a"), (None, "x y", "a"), (None, "x y", "a"), (3, "dup id", "b")]
    mixed = mixing.mix_sources(docs(spark, rows)).select("row.doc_id", "row.source", "mix_size", "source_size", "target", "copies").toPandas()
    assert len(mixed) == len(rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    want = _targets(dict(sizes))
    mixed["source"] = mixed["source"].astype(object).where(mixed["source"].notna(), None)
    for s, size in sizes.items():
        own = mixed[mixed["source"].isna()] if s is None else mixed[mixed["source"] == s]
        assert own["target"].iloc[0] == pytest.approx(want[s]) and own["source_size"].iloc[0] == size
        assert abs((own["copies"] * own["mix_size"]).sum() - want[s]) <= 0.05 * want[s] + 120
    assert mixed["copies"].between(0, 3).all()
    again = mixing.mix_sources(docs(spark, rows[::-1])).select("row.doc_id", "mix_size", "copies").toPandas()
    key = ["doc_id", "mix_size", "copies"]
    assert (again.sort_values(key)[key].fillna(-1).to_numpy() == mixed.sort_values(key)[key].fillna(-1).to_numpy()).all()
    taken = mixing.taken_documents(mixing.mix_sources(docs(spark, rows)))
    assert taken.columns == docs(spark, []).columns and taken.count() == mixed["copies"].sum()
    assert mixing.mix_sources(docs(spark, [])).count() == 0
    assert mixing.mix_sources(docs(spark, [(1, None, None)])).first().copies in (0, 1)


def test_mixing_uses_no_python(spark, sf_dir):
    plan = queries.op10_systematic_mixing(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_held_out_rows(spark):
    got = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long").select("doc_id", quality.is_held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_pii_counts_are_of_base_spans(spark):
    every = pii.SpanModel(trees.fit_boosted(np.array([[0.0], [1.0]] * 20), np.array([0.0, 1.0] * 20), trees=1), dict.fromkeys(pii.KINDS, 0.0))
    rows = [(1, "call (212) 555-1234 or +1 212 555 1234"), (2, "bob [at] x [dot] org"), (3, None)]
    got = {r.doc_id: r for r in queries._base_counts(pii.find_pii(docs(spark, rows), every)).collect()}
    for d, text in rows:
        base = base_spans(text or "")
        assert [got[d][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert got[d].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
    assert [len(got[d].spans.split(",")) for d in (1, 2)] == [2, 1]
