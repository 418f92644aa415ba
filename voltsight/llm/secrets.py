"""Secret scan: base patterns, and random strings found by character models.

Two first-order Markov models over characters - one of random strings, one of
ordinary identifiers - are compared by log-likelihood ratio.  They are trained
from labelled samples: the values that the base patterns find are random, all
other runs of token characters are ordinary.  The samples of all documents are
counted where they are (two transition tables per task) and summed; nothing is
sampled.  A run of at least ``MIN_RUN`` token characters outside the base spans
whose ratio reaches ``MIN_LLR`` nats is an added span of kind ``random``.

Defined results: a null text counts as empty; with no labelled sample at all,
both models are uniform and nothing is added; repeated rows get equal results.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import runs, to_codepoints, utf8_chunks

# The base patterns and least lengths of the scan.
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "random")

MIN_RUN, MIN_WORD, MIN_LLR, SMOOTHING, BACKOFF = 16, 6, 14.0, 0.5, 200.0
_ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
STATES = len(_ALPHABET) + 1                              # and the state before the first character
_STATE = np.full(256, -1, np.int16)
_STATE[list(_ALPHABET)] = np.arange(1, STATES)


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """``(start, end, kind, start of the value)`` in code points, in order."""
    out = []
    low = text.lower()
    if any(k in low for k in ("passw", "secret", "token", "key")):
        out += [(m.start(), m.end(), "assign", m.start(2)) for m in ASSIGN.finditer(text)
                if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m.start()) for m in ACCESS.finditer(text)
                if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), m.end(), "hex", m.start()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _labels(text: str, spans, size: int) -> np.ndarray:
    """Per byte of one row: 0 ordinary, 1 value of a base span, 2 rest of a base span."""
    label = np.zeros(size, np.int8)
    at = {p: len(text[:p].encode()) for s in spans for p in (s[0], s[3], s[1])}
    for start, end, _, value in spans:
        part = label[at[start]:at[value]]
        part[part == 0] = 2
        label[at[value]:at[end]] = 1
    return label


def _chunk_labels(texts: pa.Array, first: int, bounds: np.ndarray):
    label, found = np.zeros(bounds[-1], np.int8), []
    for i in range(len(bounds) - 1):
        text = texts[first + i].as_py() or ""
        spans = base_spans(text)
        found.append((text, spans))
        if spans:
            label[bounds[i]:bounds[i + 1]] = _labels(text, spans, bounds[i + 1] - bounds[i])
    return label, found


def _transitions(state: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Transition counts (from, to) of the runs; state 0 comes before a run."""
    inside = np.zeros(len(state) + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    at = np.flatnonzero(np.cumsum(inside[:-1]))
    before = np.where(at > 0, state[at - 1], 0)
    first = np.zeros(len(state), bool)
    first[starts] = True
    before[first[at]] = 0
    return np.bincount(before.astype(np.int64) * STATES + state[at], minlength=STATES * STATES)


def sample_counts(docs: DataFrame) -> DataFrame:
    """``label, cell, n``: summed transition counts of the labelled samples
    (label 1: random, 0: ordinary)."""
    def run(batches):
        total = np.zeros((2, STATES * STATES), np.int64)
        for b in batches:
            for first, data, bounds in utf8_chunks(b.column(0)):
                label, _ = _chunk_labels(b.column(0), first, bounds)
                state = _STATE[data]
                for kind, least in ((0, MIN_WORD), (1, 1)):
                    starts, ends = runs((state > 0) & (label == kind), bounds)
                    long = ends - starts >= least
                    total[kind] += _transitions(state, starts[long], ends[long])
        kind, cell = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(cell.astype(np.int32)),
                                          pa.array(total[kind, cell])], ["label", "cell", "n"])

    return docs.select("text").mapInArrow(run, "label int, cell int, n bigint").groupBy("label", "cell").agg(
        F.sum("n").alias("n"))


def train(docs: DataFrame) -> np.ndarray:
    """Log-likelihood ratios (from, to) of random against ordinary strings."""
    counts = np.zeros((2, STATES * STATES))
    for r in sample_counts(docs).collect():              # at most 2 x STATES^2 rows
        counts[r.label, r.cell] = r.n
    counts = counts.reshape(2, STATES, STATES)[:, :, 1:]
    single = counts.sum(1) + SMOOTHING                   # rare states fall back on the frequency of characters
    single /= single.sum(1, keepdims=True)
    p = (counts + BACKOFF * single[:, None]) / (counts.sum(2, keepdims=True) + BACKOFF)
    ratio = np.zeros((STATES, STATES))
    ratio[:, 1:] = np.log(p[1]) - np.log(p[0])
    return ratio


def scan(texts: pa.Array, ratio: np.ndarray) -> list[list[tuple[int, int, str]]]:
    """All spans of each text, in order."""
    out = []
    for first, data, bounds in utf8_chunks(texts):
        label, found = _chunk_labels(texts, first, bounds)
        state = _STATE[data]
        starts, ends = runs((state > 0) & (label == 0), bounds)
        long = ends - starts >= MIN_RUN
        starts, ends = starts[long], ends[long]
        added: dict[int, list] = {}
        if len(starts):
            before = np.concatenate([[0], np.maximum(state[:-1], 0)])
            step = np.concatenate([[0.0], np.cumsum(ratio[before, np.maximum(state, 0)])])
            score = step[ends] - step[starts + 1] + ratio[0, state[starts]]
            for s, e in zip(starts[score >= MIN_LLR], ends[score >= MIN_LLR]):
                added.setdefault(int(np.searchsorted(bounds, s, side="right")) - 1, []).append((s, e))
        for i, (text, spans) in enumerate(found):
            own = [(s, e, kind) for s, e, kind, _ in spans]
            if i in added:
                at = to_codepoints(data[bounds[i]:bounds[i + 1]], np.array(added[i]) - bounds[i])
                own += [(int(s), int(e), "random") for s, e in at]
            out.append(sorted(own, key=lambda x: (x[0], KINDS.index(x[2]))))
    return out


def joined(spans, kinds=KINDS) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, e, kind in spans if kind in kinds)


def secrets(docs: DataFrame, ratio: np.ndarray | None = None) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_random, base, spans`` of every row."""
    ratio = train(docs) if ratio is None else ratio

    def run(texts):
        found = scan(texts, ratio)
        counts = [pa.array([sum(x[2] == k for x in f) for f in found], pa.int64()) for k in KINDS]
        return pa.StructArray.from_arrays(
            counts + [pa.array([joined(f, KINDS[:3]) for f in found], pa.string()),
                      pa.array([joined(f) for f in found], pa.string())],
            [f"n_{k}" for k in KINDS] + ["base", "spans"])

    kind = ", ".join(f"n_{k} bigint" for k in KINDS) + ", base string, spans string"
    return docs.select("doc_id", F.arrow_udf(run, kind)("text").alias("s")).select("doc_id", "s.*")
