"""Fill-in-middle transformation as a ``pyarrow.compute`` pipeline per batch.

Every text is split into units (a word with the blanks before it; blanks at the
end are a unit of their own).  Per batch: texts become list arrays of units, the
lists are flattened beside the parent index of each unit, a unit's ordinal is its
place less that of its parent's first unit, and the units are filtered by role -
prefix, middle or suffix, by two cuts - rebuilt as lists and joined to pieces by
``binary_join``; the pieces and the sentinels are joined element by element.

The cuts and the form come from a hash of seed and id (Spark columns): four
unsigned 32-bit groups of sha256; the first two give the cuts, the third whether
the text is transformed, the fourth suffix-prefix-middle or prefix-suffix-middle.

Defined results: a null or empty text, or one that holds a sentinel, is plain and
its output is the (empty) text; a null ``doc_id`` hashes as the empty string;
rows that repeat an id get the cuts of that id over their own units; a very long
text is cut like any other (batches are processed in slices of about ``CHUNK``
bytes of text, or one text if that is longer); repeated rows and extra columns
are kept as they are; an empty table gives no rows.  Columns added: ``n, form,
output, prefix_chars, middle_chars`` - an input column of such a name is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dictionary import BLANKS, gathered

SEED, FIM_PERCENT, SPM_PERCENT = 42, 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CHUNK = 4 << 20
#: a byte that no UTF-8 text holds: it marks the ends of units
_END = b"\xff"
ADDED = ("n", "form", "output", "prefix_chars", "middle_chars")


def draws_of(seed: int, doc_id: str = "doc_id") -> list[Column]:
    """Four unsigned 32-bit numbers that depend on seed and id only."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def units(texts: pa.Array) -> pa.Array:
    """List array of the units of each text (as bytes); an empty text has one empty unit."""
    raw = texts.cast(pa.large_binary())
    marked = pc.replace_substring_regex(raw, f"([^\\x20\\x09-\\x0D])({BLANKS})".encode(), b"\\1" + _END + b"\\2")
    return pc.split_pattern(marked, _END)


def _pieces(lists: pa.Array, low: pa.Array, high: pa.Array) -> list[pa.Array]:
    """The joined units before ``low``, from there to ``high``, and after it."""
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    size = pc.cast(pc.list_value_length(lists), pa.int64())
    rows = pa.array(np.arange(len(lists)))
    first = pc.subtract(pc.cumulative_sum(size), size)
    ordinal = pc.subtract(pa.array(np.arange(len(flat))), pc.take(first, parent))
    from_low, from_high = (pc.greater_equal(ordinal, pc.take(cut, parent)) for cut in (low, high))
    out = []
    for role in (pc.invert(from_low), pc.and_not(from_low, from_high), from_high):
        owner = pc.filter(parent, role)
        counts = pc.value_counts(owner)
        at = pc.index_in(rows, counts.field("values").cast(pa.int64()))
        count = pc.fill_null(pc.take(counts.field("counts"), at), 0)
        bounds = pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(count)])
        own = pa.LargeListArray.from_arrays(bounds, pc.filter(flat, role))
        out.append(pc.binary_join(own, pa.scalar(b"", flat.type)))
    return out


def transform(texts: pa.Array, draws: list[pa.Array], fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT,
              sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> list[pa.Array]:
    """The columns ``ADDED`` of a batch of texts without nulls."""
    p, s, m = (pa.scalar(x.encode(), pa.large_binary()) for x in sentinels)
    raw = texts.cast(pa.large_binary())
    lists = units(raw)
    n = pc.if_else(pc.equal(pc.binary_length(raw), 0), 0, pc.cast(pc.list_value_length(lists), pa.int64()))
    one_more = pc.add(n, 1)

    def rest(a, b):
        return pc.subtract(a, pc.multiply(pc.divide(a, b), b))

    cuts = [rest(d, one_more) for d in draws[:2]]
    plain = pc.or_(pc.equal(n, 0), pc.greater_equal(rest(draws[2], pa.scalar(100, pa.int64())), fim_percent))
    for mark in sentinels:
        plain = pc.or_(plain, pc.match_substring(texts, mark))
    spm = pc.less(rest(draws[3], pa.scalar(100, pa.int64())), spm_percent)
    before, inside, after = _pieces(lists, pc.min_element_wise(*cuts), pc.max_element_wise(*cuts))
    nothing = pa.scalar(b"", pa.large_binary())
    as_spm = pc.binary_join_element_wise(s, after, p, before, m, inside, nothing)
    as_psm = pc.binary_join_element_wise(p, before, s, after, m, inside, nothing)
    output = pc.if_else(plain, raw, pc.if_else(spm, as_spm, as_psm))
    form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
    none = pa.scalar(None, pa.int64())
    chars = [pc.if_else(plain, none, pc.cast(pc.utf8_length(x.cast(pa.large_string())), pa.int64())) for x in (before, inside)]
    return [n, form, output.cast(pa.large_string()), *chars]


def fill_in_middle(docs: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT,
                   sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """``docs`` with ``n, form, output, prefix_chars, middle_chars``."""
    if len({x[:1] for x in sentinels}) != 1 or any(sentinels[0][:1] in x[1:] for x in sentinels) or len({*map(len, sentinels)}) != 1 \
            or len(set(sentinels)) < 3:
        raise ValueError("sentinels must differ, be equally long, and share a first character that occurs nowhere else in them")
    kept = [f for f in docs.schema.fields if f.name not in ADDED]
    names = [f"draw_{i}{'_' * max(map(len, docs.columns))}" for i in range(4)]
    schema = T.StructType(kept + [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField(
        "output", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType())])

    def run(batches):
        for t in gathered(batches, CHUNK):
            texts = pc.fill_null(t["text"], "").combine_chunks().cast(pa.large_string())
            added = transform(texts, [t[d].combine_chunks() for d in names], fim_percent, spm_percent, sentinels)
            own = t.drop_columns(names)
            for name, column in zip(ADDED, added):
                own = own.append_column(name, column.cast(pa.string()) if name == "output" else column)
            yield from own.combine_chunks().to_batches(1024)

    own = [F.col(f"`{f.name}`") for f in kept]
    return docs.select(*own, *[d.alias(n) for d, n in zip(draws_of(seed), names)]).mapInArrow(run, schema)


def restored(output: str = "output", form: str = "form", sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)):
    """Column: the exact text, rebuilt from output and form.  A transformed text
    holds no sentinel of its own, so its three sentinels stand where they were put."""
    p, s, m = sentinels
    out = F.col(output)

    def between(a: str, b: str | None):
        after = F.locate(a, out) + len(a)
        return F.substring(out, after, F.length(out) if b is None else F.locate(b, out) - after)

    psm = F.concat(between(p, s), between(m, None), between(s, m))
    spm = F.concat(between(p, m), between(m, None), between(s, p))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(out)
