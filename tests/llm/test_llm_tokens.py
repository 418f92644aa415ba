"""Packing, cross-tokenizer alignment and fill-in-middle against brute-force versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from llm_fixtures import SF001, no_docs, odd_docs  # noqa: F401
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voltsight.llm import alignment, fim, packing, queries
from voltsight.llm.common import table

BITS = ["a", "é", "日", " ", " ", "\n", "\x00", "\x0b", " ", "　", "<|endoftext|>", "<s>", "🎉", "\r", "▁", "x.", "'s", " the", " it's",
        "́", "\x85", "12", " <0x41>", "<P>", "<S", "İ", "ß", "Σ "]


def mixed_texts(n=1500, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 14))) for _ in range(n)] + [
        " ", "a ", " a", "a  b", "  ", "ab1" * 3000, "word " * 9000, ""]


@pytest.fixture(scope="module")
def mixed_docs(spark):
    rows = [(i, t, f"x{i}") for i, t in enumerate(mixed_texts())] + [(7, "again the same id", "x"), (None, "no id at all", "x"), (90001, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, start string").withColumns(
        {c: F.lit("clash") for c in ("length", "n", "form", "chunk", "pair", "block", "piece_key", "output", "docs", "place")})
    return docs.unionByName(table(spark, SF001, "documents").select("doc_id", "text"), allowMissingColumns=True).repartition(5)


def of_texts(df):
    return sorted(((r.doc_id if r.doc_id is not None else -1, r.text) for r in df.select("doc_id", "text").collect()),
                  key=lambda x: (x[0], x[1] or ""))


# ---- 11 packing -------------------------------------------------------------------------------

def check_packing(docs, pieces, capacity, end_id):
    """Every id of every document lies in one piece; sequences are gapless and hold at most ``capacity``."""
    own = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    want = Counter()
    for doc_id, text in of_texts(docs):
        ids = own.encode(text or "", add_special_tokens=False).ids + [end_id]
        want[doc_id, zlib.crc32(np.array(ids, "<u4").tobytes()), len(ids)] += 1
    rows = pieces.collect()
    inside = defaultdict(list)
    for r in rows:
        assert len(r.ids) == r.length > 0 and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        inside[r.sequence_id].append((r.offset, r.length))
    for parts in inside.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    # rows of one document are told apart by their chain of starts
    got, chains = Counter(), defaultdict(lambda: defaultdict(list))
    for r in sorted(rows, key=lambda r: r.start):
        chains[r.doc_id if r.doc_id is not None else -1, r.doc_tokens][r.start].append(r)
    for (doc_id, n), starts in chains.items():
        for first in starts[0]:
            ids, at = list(first.ids), first.length
            while at < n:
                ids += starts[at][0].ids
                at += starts[at][0].length
            got[doc_id, zlib.crc32(np.array(ids, "<u4").tobytes()), n] += 1
    if all(len(s) == 1 for starts in chains.values() for s in starts.values()):
        assert got == want
    else:
        assert Counter((d, n) for d, _, n in got.elements()) == Counter((d, n) for d, _, n in want.elements())
    return len(inside), sum(r.length for r in rows)


def test_packing_places_every_id_once(spark, mixed_docs, odd_docs):
    check_packing(mixed_docs, packing.packed(mixed_docs, with_ids=True), 4096, 2)
    check_packing(mixed_docs, packing.packed(mixed_docs, capacity=64, windows=16, filler=16, with_ids=True), 64, 2)
    check_packing(odd_docs, packing.packed(odd_docs, with_ids=True), 4096, 2)


def test_packing_pads_little(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    seqs = packing.packed(docs).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    held = sum(r.n for r in seqs)
    assert max(r.n for r in seqs) <= 4096
    assert 1 - held / (4096 * len(seqs)) < 0.01


def test_packing_empty(no_docs):
    assert packing.packed(no_docs).collect() == []


def plain_difference(sizes, k):
    """The textbook method on full k-tuples of (sum, items)."""
    states = [(s, n, [(s, [i])] + [(0, [])] * (k - 1)) for n, (s, i) in enumerate(sorted(((s, i) for i, s in enumerate(sizes)), key=lambda x: (-x[0], x[1])))]
    turn = len(states)
    while len(states) > 1:
        states.sort(key=lambda x: (-x[0], x[1]))
        (_, _, a), (_, _, b) = states.pop(0), states.pop(0)
        a, b = sorted(a, key=lambda x: -x[0]), sorted(b, key=lambda x: x[0])
        new = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a, b)]
        least = min(x[0] for x in new)
        new = [(x[0] - least, x[1]) for x in new]
        states.append((max(x[0] for x in new), turn, new))
        turn += 1
    return sorted(sum(sizes[i] for i in x[1]) for x in states[0][2])


def test_differencing_equals_the_textbook_method():
    rng = random.Random(3)
    for _ in range(40):
        k = rng.randint(1, 6)
        sizes = rng.sample(range(1, 5000), rng.randint(k, 30))
        window = packing.difference(np.array(sizes), k)
        got = sorted(np.bincount(window, weights=sizes, minlength=k).astype(int).tolist())
        want = plain_difference(sizes, k)
        assert max(got) - min(got) == max(want) - min(want)
    assert packing.difference(np.array([8, 7, 6, 5, 4]), 2).tolist() in ([1, 0, 1, 0, 0], [0, 1, 0, 1, 1])


def test_window_count_rises_beyond_capacity():
    sizes = np.array([60] * 10 + [1] * 50)
    window = packing.windows_of(sizes, capacity=100)
    filled = np.bincount(window, weights=sizes)
    assert filled.max() <= 100 and len(filled) >= 10
    assert len(np.unique(packing.windows_of(np.full(20_000, 1), 4096))) <= 6


ODD = ["a", "A", "E", "é", "É", "ß", "Ŷ", "ÿ", "×", "÷", "µ", "İ", "Σ", "W", "K", "ł", "\u030a", "\u0301", "\u0338", " ", " ", "\t", "\xa0", "\x85", "\x1c",
       "'", "'S", "'re", "$$$", "&", "<", "|", "<|endoftext|>", "<|ENDOFTEXT|>", ",", ")", "7", "日", "🎉", "\x00", "The", "ver"]


def test_packing_words_are_cut_at_marks_and_folded():
    got = packing.words(pa.array(["Ciónr$$$ ÉA! abc,d", None, " It's\n", "A|B W\u030a, Êt\u0301", ""]))
    assert got.to_pylist() == [["ciónr", "$$$", "éa", "!", "abc", ",d"], [], ["it", "'s"], ["A|B", "W\u030a,", "Êt\u0301"], []]
    rng = random.Random(8)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 25))) for _ in range(4000)] + [None, ""]
    own = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    ids, bounds = packing.token_ids(pa.array(["before", *texts, "after"]).slice(1, len(texts)))
    for i, text in enumerate(texts):
        assert ids[bounds[i]:bounds[i + 1]].tolist() == [*own.encode(text or "", add_special_tokens=False).ids, packing.END_ID], text
    assert packing.token_ids(pa.array([], pa.string()))[1].tolist() == [0]


# ---- 12 alignment -----------------------------------------------------------------------------

def plain_alignment(rows):
    """Whole texts, two pointers, every link counted."""
    a = Tokenizer.from_file(public_tokenizers.path(alignment.A_PATH))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.B_PATH))
    level = alignment.byte_level()
    found, count = [], Counter()
    for doc_id, text in rows:
        found.append((doc_id, [], [], [], ""))
        if not text:
            continue
        ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        spelled = ([bytes(level[c] for c in a.id_to_token(i)) for i in ids[0]],
                   [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]])
        if any(b"".join(s) != (" " + text).encode() for s in spelled):
            continue
        ends = [np.cumsum([len(x) for x in s]).tolist() for s in spelled]
        both = sorted(set(ends[0]) & set(ends[1]))
        at = [{x: n + 1 for n, x in enumerate(e)} for e in ends]
        cut = [[0, *(where[x] for x in both)] for where in at]
        parts = [["".join(("|" if side and not i else "," if i else "") + str(t) for i, t in enumerate(ids[side][lo:hi]))
                  for lo, hi in zip(cut[side], cut[side][1:])] for side in (0, 1)]
        i = j = 0
        links = []
        while i < len(ids[0]):
            links.append((ids[0][i], ids[1][j]))
            x, y = ends[0][i], ends[1][j]
            i, j = i + (x <= y), j + (y <= x)
        count.update(links)
        found[-1] = (doc_id, ids[0], ids[1], links, ";".join(x + y for x, y in zip(*parts)))
    best = defaultdict(int)
    for (_, y), c in count.items():
        best[y] = max(best[y], c)
    return [(d, len(x), len(y), g.count(";") + bool(g), len(ln), sum(count[p] == best[p[1]] for p in ln), sum(count[p] for p in ln),
             hashlib.sha256(g.encode()).hexdigest() if g else "", g) for d, x, y, ln, g in found]


def test_alignment_equals_plain(spark, mixed_docs, odd_docs, monkeypatch):
    for docs in (mixed_docs, odd_docs):
        want = plain_alignment(of_texts(docs))
        got = sorted(tuple(-1 if v is None else v for v in r) for r in alignment.aligned(docs).collect())
        assert got == sorted(w[:8] for w in want)
        spelled = sorted((-1 if r.doc_id is None else r.doc_id, r.groups) for r in alignment.groups(docs).collect())
        assert spelled == sorted((w[0], w[8]) for w in want)
    assert sum(w[4] > w[3] > 0 for w in plain_alignment(of_texts(odd_docs))) > 3


def test_alignment_over_many_chunks(spark, mixed_docs):
    """Counts and best links don't depend on how documents fall into chunks."""
    rows = [sorted(map(tuple, alignment.aligned(mixed_docs.repartition(n)).fillna(-1).collect())) for n in (1, 40)]
    assert rows[0] == rows[1]


def test_alignment_empty(no_docs):
    assert alignment.aligned(no_docs).collect() == []
    assert alignment.groups(no_docs).collect() == []


def test_coalescing_of_separate_intervals():
    sizes_a, sizes_b = np.array([2, 3, 1]), np.array([5, 1])
    group_a, group_b, link_a, link_b = alignment.coalesce(sizes_a, sizes_b, np.array([0, 2, 5]), np.array([0, 5]))
    assert group_a.tolist() == [0, 0, 1] and group_b.tolist() == [0, 1]
    assert list(zip(link_a.tolist(), link_b.tolist())) == [(0, 0), (1, 0), (2, 1)]


# ---- 13 fill-in-middle ------------------------------------------------------------------------

def plain_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", text, None, None
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return len(units), form, out, len(p), len(m)


def test_fim_equals_plain_and_restores(spark, mixed_docs, odd_docs):
    forms = Counter()
    for docs in (mixed_docs, odd_docs):
        rows = fim.fill_in_middle(docs).withColumn("again", fim.restored()).collect()
        assert len(rows) == docs.count()
        for r in rows:
            assert (r.n, r.form, r.output, r.prefix_chars, r.middle_chars) == plain_fim(r.doc_id, r.text)
            assert r.again == (r.text or "")
            forms[r.form] += 1
    assert min(forms.values()) > 50 and len(forms) == 3


def test_fim_keeps_other_columns(spark, odd_docs, no_docs):
    out = fim.fill_in_middle(odd_docs)
    assert out.columns[:len(odd_docs.columns)] == odd_docs.columns
    assert out.where("component_id is null").count() == 0
    assert fim.fill_in_middle(no_docs).collect() == []
    with pytest.raises(ValueError):
        fim.fill_in_middle(no_docs, sentinels=("<P>", "P<S", "<M>"))


def test_token_query_columns(spark):
    head = {"op11_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            "op12_token_alignment": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
            "op13_fill_in_middle": ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]}
    for name, want in head.items():
        df = queries.QUERIES[name](spark, SF001)
        assert df.columns == want
        assert df.count() >= 200
