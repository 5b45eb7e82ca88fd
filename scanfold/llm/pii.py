"""Personal data in texts: fixed patterns, and candidates that boosted trees accept.

The base finds four kinds by pattern and check, leftmost and without retries. Candidate generators then propose
overlapping spans around what those patterns leave or reject: parts of rejected phone, card and address runs, national
phone numbers and spelled-out mail addresses. Boosted trees score a candidate by its format and its context, and a
threshold calibrated for each kind on rows that the trees have not seen accepts it. Base spans always stay.

Texts without digits, ``@`` or spelled-out ``at`` signs are set aside by one numpy pass over the Arrow buffer.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import durable
from .hashing import release_memory, text_buffers
from .sampling import hash_share
from .trees import Boosted, fit_boosted

KINDS = ("email", "ip", "card", "phone")
#: Documents, those of the least hashes among texts with base spans, that the fit reads at most, and characters kept around a span.
SAMPLE_ROWS = 3_000
#: Documents in which those are looked for, about as many of a larger table.
READ_ROWS = 100_000
CONTEXT = 40
#: Spans of a kind that a document of the sample gives to the fit, and their greatest length.
EACH_KIND = 4
LONGEST = 200
#: Least share of right candidates among those above a kind's threshold, on the calibration rows.
PRECISION = 0.98

# The patterns of the four kinds, with possessive repeats where no backtracking can help.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

_NATIONAL = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])")
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[({] ?at ?[\])}] ?[A-Za-z0-9-]{1,63}(?: ?[\[({] ?dot ?[\])}] ?[A-Za-z0-9-]{1,63}|\.[A-Za-z0-9-]{1,63}){1,8}")
_MARK = re.compile(r"[0-9@]|[\[({] ?at ?[\])}]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield "email", start, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            # no later start before this sign can match, and none reaches over it
            done = at + 1
            at = text.find("@", done)


def raw_matches(text: str) -> Iterator[tuple[Span, bool]]:
    """Matches of the four patterns, leftmost and non-overlapping by kind, and whether each passes its check."""
    for s in _emails(text):
        yield s, True
    for m in _DOTTED.finditer(text):
        parts = m[0].split(".")
        at = m.start()
        for i in range(0, len(parts) - len(parts) % 4, 4):
            own = parts[i : i + 4]
            size = sum(map(len, own)) + 3
            yield ("ip", at, at + size), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in own)
            at += size + 1
    for m in _DIGITS.finditer(text):
        d = _only_digits(m[0]) if m.end() - m.start() <= 40 else ""
        yield ("card", m.start(), m.end()), 13 <= len(d) <= 19 and luhn(d)
    for m in _PHONE.finditer(text):
        yield ("phone", m.start(), m.end()), 9 <= len(_only_digits(m[0])) <= 15


def base_spans(text: str) -> list[Span]:
    """Base spans by kind as in KINDS, then start; ends are exclusive and count code points."""
    found = [s for s, ok in raw_matches(text) if ok]
    return sorted(found, key=lambda s: (KINDS.index(s[0]), s[1]))


def candidates(text: str) -> list[Span]:
    """Overlapping spans, with a high recall, outside what the base accepts. Their number is linear in the text."""
    out: set[Span] = set()
    for (kind, a, b), ok in raw_matches(text):
        if ok:
            continue
        if kind == "phone":
            # the starts of a run that has too many digits, up to the ends of its groups
            n = 0
            for m in re.finditer(r"[0-9]++", text[a:b]):
                n += m.end() - m.start()
                if n > 15:
                    break
                if n >= 9:
                    out.add(("phone", a, a + m.end()))
        elif kind == "card":
            groups = [m.span() for m in re.finditer(r"[0-9]++", text[a:b])]
            for i, (s, _) in enumerate(groups):
                n = 0
                for g in islice(groups, i, i + 19):
                    n += g[1] - g[0]
                    if n > 19:
                        break
                    if n >= 13 and luhn(_only_digits(text[a + s : a + g[1]])):
                        out.add(("card", a + s, a + g[1]))
        elif kind == "ip":
            edges = [m.span() for m in re.finditer(r"[0-9]++", text[a:b])]
            if len(edges) == 4 and all(len(text[a + s : a + e].lstrip("0")) <= 3 for s, e in edges):
                out.add(("ip", a, b))
    out.update(("phone", m.start(), m.end()) for m in _NATIONAL.finditer(text))
    out.update(("email", m.start(), m.end()) for m in _SPELLED.finditer(text))
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def features(text: str, span: Span) -> list[float]:
    """Format of the span and its surroundings."""
    kind, a, b = span
    s = text[a:b]
    d = _only_digits(s)
    before, after = text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]
    groups = re.findall(r"[0-9]+", s)
    groups = [*map(len, groups[:5]), *[0] * 5][:5]
    lead, follow = before[-1:], after[:1]
    return [
        float(KINDS.index(kind)), float(b - a), float(len(d)), float(luhn(d)) if d else 0.0, *map(float, groups), float(len(re.findall(r"[0-9]+", s))),
        float(s.count("(")), float(s.count(")")), float(s.count("-")), float(s.count(" ")), float(s.count(".")), float(s.startswith("+")),
        float(lead.isalnum()), float(lead in ("-", ".", "_", "=")), float(follow.isalnum()), float(follow in ("-", "_", "=", "%")), float(follow == "."),
        float(bool(re.match(r"[ .-]?[0-9]", after))), float(bool(re.match(r" [0-9]{1,3}\.[0-9]", after))), float(bool(re.search(r"[0-9][ .-]?$", before))),
        float(bool(re.search(r"(?i)(tel|phone|call|fax|mobil)[a-z]*[:. ]*$", before))), float(bool(re.search(r"(?i)(token|id|isbn|order|version|no|nr)[\"' :=.#]*$", before))),
        float(bool(re.search(r"[0-9a-fA-F]{6}$", before)) or bool(re.match(r"[0-9a-fA-F]{6}", after))),
        float(max((int(x) for x in re.findall(r"[0-9]{1,4}", s)), default=0)),
    ]


@dataclass
class SpanModel:
    """Trees over ``features`` and the least score that each kind's candidates need."""

    trees: Boosted | None = None
    thresholds: dict[str, float] = field(default_factory=dict)

    def extra(self, text: str, base: list[Span]) -> list[Span]:
        """Accepted candidates, best first, that overlap neither base spans nor each other."""
        if self.trees is None:
            return []
        found = candidates(text)
        if not found:
            return []
        taken = bytearray(len(text))
        for _, a, b in base:
            taken[a:b] = b"\1" * (b - a)
        found = [s for s in found if taken.find(1, s[1], s[2]) < 0]
        if not found:
            return []
        scores = self.trees.predict(np.array([features(text, s) for s in found]))
        out: list[Span] = []
        for score, s in sorted(zip(scores.tolist(), found, strict=True), key=lambda x: (-x[0], -(x[1][2] - x[1][1]), x[1])):
            if score >= self.thresholds.get(s[0], 2.0) and taken.find(1, s[1], s[2]) < 0:
                taken[s[1] : s[2]] = b"\1" * (s[2] - s[1])
                out.append(s)
        return out


def find_spans(text: str, model: SpanModel) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, both by kind as in KINDS and start."""
    base = base_spans(text)
    extra = model.extra(text, base)
    return base, sorted([*base, *extra], key=lambda s: (KINDS.index(s[0]), s[1], s[2])) if extra else base


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the bracketed kind of its first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def training_rows(contexts: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and group numbers of candidates from (kind, before, span, after) rows.

    A true span is written into its own context and, as runs that the patterns join are, straight before another
    number; a candidate is right when it is that span. Spans with a changed digit or a digit more are wrong.
    """
    x, y, g = [], [], []

    def add(text: str, span: Span, right: bool, group: int) -> None:
        x.append(features(text, span)), y.append(float(right)), g.append(group)

    rows = list(contexts.itertuples(index=False))
    for i, r in enumerate(rows):
        a = len(r.before)
        text = r.before + r.span + r.after
        add(text, (r.kind, a, a + len(r.span)), True, i)
        other = rows[(i * 7 + 3) % len(rows)]
        if r.kind in ("phone", "card") and other.kind in ("ip", "card", "phone"):
            text = r.before + r.span + " " + other.span.lstrip("+") + other.after
            for s in candidates(text):
                if s[0] == r.kind and s[1] < a + len(r.span) and s[2] > a:
                    add(text, s, s[1:] == (a, a + len(r.span)), i)
        if r.kind == "phone":
            local = re.sub(r"^\+[0-9]{1,3} ?", "", r.span)
            text = r.before + local + r.after
            for s in candidates(text):
                if s[0] == "phone" and s[1] < a + len(local) and s[2] > a:
                    add(text, s, s[1:] == (a, a + len(local)), i)
        if r.kind == "email":
            for t in (r.span.replace("@", " [at] ").replace(".", " [dot] "), r.span.replace("@", "(at)")):
                text = r.before + t + r.after
                for s in candidates(text):
                    if s[0] == "email":
                        add(text, s, abs(s[2] - a - len(t)) <= 1, i)
        # a digit more, or an address part above 255, makes a number of something else
        at = next((k for k, c in enumerate(r.span) if c.isdigit() and c != "0"), None)
        if at is not None and r.kind != "email":
            wrong = r.span[: at + 1] + ("9" if r.kind != "ip" else "99") + r.span[at + 1 :]
            for rep in range(3):
                text = r.before + ("", "no. ", 'id = "')[rep] + wrong + r.after
                for s in candidates(text):
                    add(text, s, False, i)
    return np.array(x).reshape(len(y), -1), np.array(y), np.array(g)


def fit(contexts: pd.DataFrame) -> SpanModel:
    """Trees from two of three contexts and thresholds from the third; without contexts the base stands alone."""
    if not len(contexts):
        return SpanModel()
    x, y, g = training_rows(contexts)
    own = g % 3 != 2
    if not own.any() or own.all():
        return SpanModel()
    trees = fit_boosted(x[own], y[own], trees=40, depth=4, rate=0.3, least=4.0)
    scores = trees.predict(x)
    thresholds = {}
    for k, kind in enumerate(KINDS):
        rows = ~own & (x[:, 0] == k)
        if not (y[rows] > 0).any():
            continue
        order = np.argsort(-scores[rows], kind="stable")
        s, right = scores[rows][order], np.cumsum(y[rows][order]) / np.arange(1, rows.sum() + 1)
        ends = np.append(s[1:] != s[:-1], True)
        ok = np.flatnonzero((right >= PRECISION) & ends)
        if len(ok):
            thresholds[kind] = max(0.5, float(s[ok[-1]]))
    return SpanModel(trees, thresholds)


def _marked(column: pa.Array) -> np.ndarray:
    """Rows whose text may hold a span: it has a digit, an ``@`` or an opening bracket."""
    data, offsets = text_buffers(column)
    out = np.zeros(len(offsets) - 1, bool)
    if not len(data):
        return out
    hit = np.zeros(256, bool)
    hit[[*range(48, 58), 64]] = True
    base = int(offsets[0])
    where = np.flatnonzero(hit[data[base : int(offsets[-1])]]) + base
    out[np.unique(np.searchsorted(offsets, where, "right") - 1)] = True
    spelled = re.compile(rb"[\[({] ?at ?[\])}]")
    for m in spelled.finditer(memoryview(data)[base : int(offsets[-1])]):
        out[np.searchsorted(offsets, m.start() + base, "right") - 1] = True
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> SpanModel:
    """A model from the base spans, with CONTEXT characters around them, of at most ``sample_rows`` documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in np.flatnonzero(_marked(batch.column(1))).tolist():
                text = batch.column(1)[i].as_py()
                found = [s for s in base_spans(text) if s[2] - s[1] <= LONGEST]
                spans = [s for k in KINDS for s in [s for s in found if s[0] == k][:EACH_KIND]]
                if spans:
                    at = batch.column(0)[i].as_py()
                    rows.append((at, [{"kind": k, "before": text[max(0, a - CONTEXT) : a], "span": text[a:b], "after": text[b : b + CONTEXT]} for k, a, b in spans]))
            item = pa.struct([(n, pa.string()) for n in ("kind", "before", "span", "after")])
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(item))], names=["id", "spans"])

    durable.bounded_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = hash_share(base, F.col("id"), READ_ROWS).mapInArrow(run, "id long, spans array<struct<kind:string,before:string,span:string,after:string>>")
    rows = found.orderBy(F.xxhash64("id"), "id", F.xxhash64("spans")).limit(sample_rows).collect()
    flat = [tuple(s) for r in rows for s in r.spans]
    return fit(pd.DataFrame(flat, columns=["kind", "before", "span", "after"]))


_RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_base array<long>"


def find_pii(docs: DataFrame, model: SpanModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of every row's whole text: id_col, the number of all spans by kind, the SHA-256 of the joined base spans,
    all spans joined, as ``kind:start:end`` by kind and start, and n_base, the numbers of base spans in the order of KINDS.

    Null and empty texts have none. Null and repeated ids are ordinary rows; other columns are not read.
    """
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            counts, own = np.zeros((n, len(KINDS)), np.int64), np.zeros((n, len(KINDS)), np.int64)
            digest, spans = [empty] * n, [""] * n
            for i in np.flatnonzero(_marked(batch.column(1))).tolist():
                base, every = find_spans(batch.column(1)[i].as_py(), model)
                for k, _, _ in every:
                    counts[i, KINDS.index(k)] += 1
                for k, _, _ in base:
                    own[i, KINDS.index(k)] += 1
                digest[i], spans[i] = hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[:, k]) for k in range(4)), pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array(list(own), pa.list_(pa.int64()))], names=[x.split()[0] for x in _RESULT.split(", ")])
        release_memory()

    durable.bounded_batches(docs.sparkSession)
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _RESULT)
    return out.withColumnRenamed("doc_id", id_col)


def redact_documents(docs: DataFrame, model: SpanModel, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The rows of ``docs`` with every span in ``text_col`` replaced by its kind and ``chars_col``, if there is such a
    column, set to the new number of code points where the text changes. Null texts stay null."""
    names = docs.columns
    at = names.index(text_col)
    chars = names.index(chars_col) if chars_col in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            changed, texts = np.zeros(len(batch), bool), []
            for i in np.flatnonzero(_marked(batch.column(at))).tolist():
                text = batch.column(at)[i].as_py()
                _, every = find_spans(text, model)
                if every:
                    changed[i] = True
                    texts.append(redact(text, every))
            cols, mask = list(batch.columns), pa.array(changed)
            cols[at] = pc.replace_with_mask(cols[at], mask, pa.array(texts, cols[at].type))
            if chars is not None:
                cols[chars] = pc.replace_with_mask(cols[chars], mask, pa.array([len(t) for t in texts], cols[chars].type))
            yield pa.RecordBatch.from_arrays(cols, names=names)
            release_memory()

    durable.bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, T.StructType(docs.schema.fields))
