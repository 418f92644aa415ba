"""Personal data: base patterns and a skip-chain conditional random field.

The field's nodes are the tokens (non-blank runs) that hold a digit or an ``@``;
tokens of one base span are one node, and so are tokens of digits, parted by
spaces, that together repeat the end of a base span's number or follow a ``+``.  All other tokens
are ``O`` by definition and cut the chain.  Its labels are ``O`` and the kinds of
the base patterns.  Adjacent nodes share a chain potential; nodes of the same
document with the same key share skip potentials.  The key is what near-repeats
have in common: the part before ``@``, the last ``MIN_DIGITS`` digits of a number
with at least so many (an address of four numbers stays whole), or the folded
token.  The factors are trained piecewise (each from its own counts of features
and labels) over all documents.  There, nodes in base spans have their kind as
label, and so have nodes linked with one by key: they are not known to be ``O``.
Loopy belief propagation in log space then runs over each document.  Nodes in
base spans are observed.  Another node whose belief in a kind reaches ``BELIEF``
is an added span of that kind, so a number that occurs once in full and again
without its prefix gets one label.

A node is linked with the nearest observed node of its key before it, or else with
the first observed one, or else with the first node, so a token repeated m times
costs m links, not all pairs, and however long a document is, each repeat is one
link from an observed mention.  Messages are passed until those of a document
change by less than ``TOLERANCE``; where they swing, the step is halved every
``PATIENCE`` rounds, so that they come to rest.  Defined results: a null text
counts as empty; with no base span anywhere no potential favours a kind and
nothing is added; repeated rows get equal results.
"""

from __future__ import annotations

import re
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import runs, to_codepoints, utf8_chunks

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O",) + KINDS
# The base patterns.  Digit runs are taken whole, from their start.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

MIN_DIGITS, MAX_DIGITS, LEAST_PHONE, MOST_PHONE, MIN_KEY, BELIEF, SMOOTHING, TOLERANCE, PATIENCE = 7, 19, 9, 15, 6, 0.9, 0.5, 1e-4, 100


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str):
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` in code points, by kind and start."""
    out = [(s, e, "email") for s, e in _emails(text)]
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(text)
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text)
                if LEAST_PHONE <= sum(c in "0123456789" for c in m.group()) <= MOST_PHONE]
    return out


_STRIP = ".,;:!?#$%&*|()[]{}<>\"'`~^"
_DIGITS = np.array([48 <= c <= 57 for c in range(256)])
_BLANK = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])
_BUCKETS = np.array([1, 3, 4, 5, 7, 10, 13, 20])
_FEATURES = (2, 9, 5, 2, 2, 2, 2, 3)                    # number of values of each feature
_FIRST = np.concatenate([[0], np.cumsum(_FEATURES)])


_QUAD = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")
_NUMBER = re.compile(r"[+().,;:0-9-]*[0-9][+().,;:0-9-]*")


def _digits(token: str) -> str:
    return "".join(c for c in token if c in "0123456789")


def _features(token: str) -> list[int]:
    digits = _digits(token)
    check = 1 + luhn(digits) if 13 <= len(digits) <= 19 else 0
    values = ("@" in token, int(np.searchsorted(_BUCKETS, len(digits), side="right")), min(token.count("."), 4),
              token.startswith("+"), "(" in token or ")" in token, "-" in token, any(c.isalpha() for c in token), check)
    return [int(f + v) for f, v in zip(_FIRST, values)]


def _key(token: str) -> str | None:
    token = token.strip(_STRIP)
    if "@" in token:
        return token.split("@")[0].lower() or None
    digits = _digits(token)
    if len(digits) >= MIN_DIGITS and not any(c.isalpha() for c in token) and not _QUAD.fullmatch(token):
        return digits[-MIN_DIGITS:]
    return token.lower() if len(token) >= MIN_KEY else None


def _numbers(span: str, kind: str) -> set[str]:
    """Digits of a base span.  A phone pattern takes in numbers that follow it, so
    each of its blank-separated heads that is long enough counts."""
    if kind == "phone":
        return {h for h in accumulate(_digits(x) for x in span.split()) if len(h) >= LEAST_PHONE}
    return {_digits(span)} if kind == "card" else set()


def _opened(tokens: list[str], free: list[bool], joined: list[bool]) -> list[tuple[int, int]]:
    """First and last of the free tokens that make up a number opened by ``+``, as long
    as it can be a phone's: a longer number behind it doesn't hide it."""
    out, i = [], 0
    while i < len(tokens):
        last, size = i, len(_digits(tokens[i]))
        if free[i] and tokens[i].lstrip(_STRIP).startswith("+") and _NUMBER.fullmatch(tokens[i]):
            while last + 1 < len(tokens) and free[last + 1] and joined[last + 1] and "+" not in tokens[last + 1] \
                    and _NUMBER.fullmatch(tokens[last + 1]) and size + len(_digits(tokens[last + 1])) <= MOST_PHONE:
                last += 1
                size += len(_digits(tokens[last]))
            if last > i and size >= LEAST_PHONE:
                out.append((i, last))
        i = last + 1
    return out


def _repeats(tokens: list[str], free: list[bool], joined: list[bool], numbers: dict[str, set[str]]) -> list[tuple[int, int]]:
    """First and last of the free tokens that together are the end of a number in
    ``numbers`` (by its key), the longest one; ``joined``: only spaces before the token."""
    out, done = [], 0
    for last in range(len(tokens)):
        first, digits, i = None, "", last
        while i >= done and free[i] and _NUMBER.fullmatch(tokens[i]) and len(digits) < MAX_DIGITS:
            digits = _digits(tokens[i]) + digits
            if any(x.endswith(digits) for x in numbers.get(digits[-MIN_DIGITS:], ())):
                first = i
            if not joined[i]:
                break
            i -= 1
        if first is not None:
            out.append((first, last))
            done = last + 1
    return out


class Graph:
    """Nodes of a chunk of rows: features, observed labels, labels to learn from, chain and skip links."""

    def __init__(self, texts: pa.Array, first: int, data: np.ndarray, bounds: np.ndarray):
        starts, ends = runs(~_BLANK[data], bounds)
        marked = np.concatenate([[0], np.cumsum(_DIGITS[data] | (data == 64))])
        node = np.flatnonzero(marked[ends] > marked[starts])
        row = np.searchsorted(bounds, starts[node], side="right") - 1
        near = np.flatnonzero((np.diff(node) == 1) & (np.diff(row) == 0))
        span, label, glued = np.zeros((len(node), 2), np.int64), np.zeros(len(node), np.int64), np.zeros(len(node), bool)
        self.base, per_row, keys = [], np.searchsorted(row, np.arange(len(bounds))), {}
        for i in range(len(bounds) - 1):
            text = texts[first + i].as_py() or ""
            spans = base_spans(text) if per_row[i] < per_row[i + 1] else []
            self.base.append(spans)
            if per_row[i] == per_row[i + 1]:
                continue
            own = slice(per_row[i], per_row[i + 1])
            at = np.stack([starts[node[own]], ends[node[own]]], 1) - bounds[i]
            span[own] = to_codepoints(data[bounds[i]:bounds[i + 1]], at)
            numbers: dict[str, set[str]] = {}
            for s, e, kind in spans:
                inside = np.flatnonzero((span[own, 0] < e) & (span[own, 1] > s)) + per_row[i]
                label[inside], glued[inside[1:]] = LABELS.index(kind), True
                digits = _numbers(text[s:e], kind)
                for d in digits:
                    numbers.setdefault(d[-MIN_DIGITS:], set()).add(d)
                keys.setdefault(inside[0], set()).update([d[-MIN_DIGITS:] for d in digits] or filter(None, [_key(text[s:e])]))
            if numbers or "+" in text:
                at = span[own].tolist()
                tokens, free = [text[s:e] for s, e in at], (label[own] == 0).tolist()
                joined = [False] + [not text[x[1]:y[0]].strip(" ") and text[x[1] - 1] not in ",;:!?" for x, y in zip(at, at[1:])]
                groups = _opened(tokens, free, joined)
                for a, b in groups:
                    free[a:b + 1] = [False] * (b + 1 - a)
                for a, b in groups + (_repeats(tokens, free, joined, numbers) if numbers else []):
                    glued[per_row[i] + a + 1:per_row[i] + b + 1] = True
        lead = np.flatnonzero(~glued)                    # first token of each node
        of = np.cumsum(~glued) - 1
        links = np.stack([of[near], of[near + 1]], 1)
        self.chain = links[links[:, 0] < links[:, 1]]
        self.row, self.label = row[lead], label[lead]
        self.span = np.stack([span[lead, 0], span[np.append(lead[1:], len(node)) - 1, 1]], 1) if len(lead) else span
        self.features = np.zeros((len(lead), len(_FEATURES)), np.int64)
        held: dict[tuple, list[int]] = {}
        own_keys: list[set] = [set() for _ in lead]
        for j, found in keys.items():
            own_keys[of[j]] |= found
        for j, i in enumerate(self.row.tolist()):
            if j == 0 or i != self.row[j - 1]:
                text = texts[first + i].as_py()
            s, e = self.span[j]
            token = text[s:e]
            self.features[j] = _features(token)
            trimmed = token.strip(_STRIP)
            before = len(token) - len(token.lstrip(_STRIP))
            self.span[j] = (s + before, s + before + len(trimmed))
            for key in own_keys[j] or filter(None, [_key(token)]):
                held.setdefault((i, key), []).append(j)
        skip, self.taught = set(), self.label.copy()
        for nodes in held.values():
            root = hub = next((j for j in nodes if self.label[j]), nodes[0])
            for j in nodes:
                if j != root:
                    skip.add((hub, j))
                if self.label[j]:
                    hub = j
                elif self.label[hub]:
                    self.taught[j] = self.label[hub]
        self.skip = np.array(sorted(skip), np.int64).reshape(-1, 2)


def counts(docs: DataFrame) -> DataFrame:
    """``factor, i, j, n``: feature-label, chain and skip counts of all documents."""
    n = len(LABELS)

    def run(batches):
        total = {"feature": np.zeros((_FIRST[-1], n), np.int64), "chain": np.zeros((n, n), np.int64),
                 "skip": np.zeros((n, n), np.int64), "label": np.zeros((1, n), np.int64)}
        for b in batches:
            for first, data, bounds in utf8_chunks(b.column(0)):
                g = Graph(b.column(0), first, data, bounds)
                for f in range(len(_FEATURES)):
                    np.add.at(total["feature"], (g.features[:, f], g.taught), 1)
                total["label"][0] += np.bincount(g.taught, minlength=n)
                for name in ("chain", "skip"):
                    links = getattr(g, name)
                    np.add.at(total[name], (g.taught[links[:, 0]], g.taught[links[:, 1]]), 1)
        for name, t in total.items():
            i, j = np.nonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(i), pa.string()), pa.array(i.astype(np.int32)),
                                              pa.array(j.astype(np.int32)), pa.array(t[i, j])], ["factor", "i", "j", "n"])

    return docs.select("text").mapInArrow(run, "factor string, i int, j int, n bigint").groupBy("factor", "i", "j").agg(
        F.sum("n").alias("n"))


class Field:
    """Potentials in log space, and inference."""

    def __init__(self, feature, chain, skip, label):
        label = label[0] + SMOOTHING
        prior = label / label.sum()
        self.unary = np.zeros_like(feature, float)
        for lo, hi in zip(_FIRST[:-1], _FIRST[1:]):
            p = feature[lo:hi] + SMOOTHING
            self.unary[lo:hi] = np.log(p / p.sum(0))
        self.prior = np.log(prior)
        self.chain, self.skip = self._association(chain), self._association(skip)

    @staticmethod
    def _association(t):
        p = (t + t.T + SMOOTHING) / (t + t.T + SMOOTHING).sum()
        return np.log(p) - np.log(p.sum(1))[:, None] - np.log(p.sum(0))[None]

    def beliefs(self, g: Graph) -> np.ndarray:
        """Label probabilities of every node after loopy message passing."""
        n = len(LABELS)
        score = self.prior + self.unary[g.features].sum(1)
        score -= score.max(1, keepdims=True) if len(score) else 0
        seen = np.flatnonzero(g.label)
        kind = g.label[seen]
        score[seen] = -np.inf
        score[seen, kind] = 0
        links = np.concatenate([g.chain, g.skip])
        source = np.concatenate([links[:, 0], links[:, 1]])
        target = np.concatenate([links[:, 1], links[:, 0]])
        back = np.roll(np.arange(len(source)), len(links))
        factor = np.tile(np.repeat([0, 1], [len(g.chain), len(g.skip)]), 2)
        both = np.stack([self.chain, self.skip])
        message, live, step, turn = np.zeros((len(source), n)), np.arange(len(source)), 0.5, 0
        while len(live):                                 # links of the documents that still change
            total = score.copy()
            np.add.at(total, target[live], message[live])
            out = total[source[live]] - message[back[live]]
            new = np.logaddexp.reduce(out[:, :, None] + both[factor[live]], axis=1)
            move = step * (new - new.max(1, keepdims=True) - message[live])
            message[live] += move
            most, row = np.zeros(g.row[-1] + 1), g.row[source[live]]
            np.maximum.at(most, row, np.abs(move).max(1))
            live, turn = live[most[row] >= TOLERANCE], turn + 1
            step = step / 2 if turn % PATIENCE == 0 else step
        total = score.copy()
        np.add.at(total, target, message)
        p = np.exp(total - total.max(1, keepdims=True)) if len(total) else total
        return p / p.sum(1, keepdims=True) if len(p) else p


def train(docs: DataFrame) -> Field:
    n = len(LABELS)
    t = {"feature": np.zeros((_FIRST[-1], n)), "chain": np.zeros((n, n)), "skip": np.zeros((n, n)), "label": np.zeros((1, n))}
    for r in counts(docs).collect():                     # a fixed number of cells
        t[r.factor][r.i, r.j] = r.n
    return Field(**t)


def scan(texts: pa.Array, field: Field) -> list[tuple[list, list]]:
    """Per text: base spans and added spans."""
    out = []
    for first, data, bounds in utf8_chunks(texts):
        g = Graph(texts, first, data, bounds)
        p = field.beliefs(g)
        added: dict[int, list] = {}
        if len(p):
            best, linked, last = p.argmax(1), set(g.chain[:, 1].tolist()), -2
            for j in np.flatnonzero((g.label == 0) & (best > 0) & (p.max(1) >= BELIEF) & (g.span[:, 1] > g.span[:, 0])):
                s, e = map(int, g.span[j])
                own = added.setdefault(int(g.row[j]), [])
                if any(s < y and e > x for x, y, _ in g.base[g.row[j]]):
                    continue
                if j == last + 1 and j in linked and own and own[-1][2] == LABELS[best[j]]:
                    s = own.pop()[0]                     # neighbouring tokens of one kind are one span
                own.append((s, e, LABELS[best[j]]))
                last = j
        out += [(base, added.get(i, [])) for i, base in enumerate(g.base)]
    return out


def joined(spans) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, e, kind in sorted(spans, key=lambda x: (KINDS.index(x[2]), x[0])))


def personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, n_added, base, spans`` of every row."""
    field = train(docs) if field is None else field

    def run(texts):
        found = scan(texts, field)
        counted = [pa.array([sum(x[2] == k for x in b) for b, _ in found], pa.int64()) for k in KINDS]
        return pa.StructArray.from_arrays(
            counted + [pa.array([len(a) for _, a in found], pa.int64()),
                       pa.array([joined(b) for b, _ in found], pa.string()),
                       pa.array([joined(b + a) for b, a in found], pa.string())],
            [f"n_{k}" for k in KINDS] + ["n_added", "base", "spans"])

    kind = ", ".join(f"n_{k} bigint" for k in KINDS) + ", n_added bigint, base string, spans string"
    return docs.select("doc_id", F.arrow_udf(run, kind)("text").alias("s")).select("doc_id", "s.*")
