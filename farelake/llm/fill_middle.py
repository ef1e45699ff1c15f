"""Fill-in-the-middle: texts cut at two token borders and put in another order.

Tokens are runs of ASCII letters, and every other code point by itself. The
cuts come from a hash of seed and id: two draws over 0 .. n tokens. Most texts
stay as they are (``plain``), the rest become prefix-suffix-middle (``psm``) or
suffix-prefix-middle (``spm``) with three marks in front of the parts.

Cuts are found in the UTF-8 bytes. A sparse exception index holds the position
of every multibyte character and the running sum of its excess bytes: a
binary search in it turns a byte cut into code points (and back,
``bytes_of``), so spans of ASCII need arithmetic only. The n-th token's start is looked up in
counts per block of bytes, so that no array beside the text is larger than a
byte a byte and eight bytes a multibyte character.

Defined results: a NULL text counts as empty and, like a text that holds a mark,
stays plain; an empty text too. A NULL id is hashed as no digits. Every row
gives a row, repeated ones the same one. Other columns come along in ``row``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from farelake.llm.common import table

# Marks of prefix, suffix and middle (fixed values).
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = r"<[PSM]>"
SEED = 1
PLAIN_PERCENT = 10
SPM_PERCENT = 20
# Bytes counted together when a token is looked up.
BLOCK = 1 << 12
# Output bytes handed over in one Arrow batch, beyond one text's own.
OUT_BYTES = 8 << 20

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


class Units:
    """Token starts and code points of one text, by position in its UTF-8 bytes."""

    def __init__(self, text: bytes):
        data = np.frombuffer(text, np.uint8)
        self.n_bytes = len(data)
        letter = _LETTER[data]
        begins = (data & 0xC0) != 0x80
        begins[1:] &= ~(letter[1:] & letter[:-1])
        self.begins = begins
        pad = -len(begins) % BLOCK
        self.until = np.cumsum(np.pad(begins, (0, pad)).reshape(-1, BLOCK).sum(axis=1)) if len(begins) else np.zeros(0, np.int64)
        self.n = int(self.until[-1]) if len(begins) else 0
        # The exception index: where multibyte characters begin, and the excess bytes of all up to each.
        self.wide = np.flatnonzero(data >= 0xC0)
        lead = data[self.wide]
        self.excess = np.cumsum(1 + (lead >= 0xE0) + (lead >= 0xF0), dtype=np.int64)

    def start(self, unit: int) -> int:
        """Byte where token ``unit`` begins; the end of the text for the number of tokens."""
        if unit >= self.n:
            return self.n_bytes
        block = int(np.searchsorted(self.until, unit, side="right"))
        before = int(self.until[block - 1]) if block else 0
        at = block * BLOCK
        return at + int(np.flatnonzero(self.begins[at:at + BLOCK])[unit - before])

    def chars(self, byte: int) -> int:
        """Code points in front of a byte position that begins a character."""
        k = int(np.searchsorted(self.wide, byte))
        return byte - (int(self.excess[k - 1]) if k else 0)

    def bytes_of(self, char: int) -> int:
        """Byte position of a code point; the inverse of ``chars``."""
        before = np.concatenate([[0], self.excess[:-1]]) if len(self.wide) else self.wide
        k = int(np.searchsorted(self.wide - before, char))
        return char + (int(self.excess[k - 1]) if k else 0)


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[k:k + 8], 16) for k in (0, 8, 16, 24))


def arrange(text: bytes, doc_id: int | None, seed: int = SEED, plain_percent: int = PLAIN_PERCENT,
            spm_percent: int = SPM_PERCENT) -> tuple[int, str, int | None, int | None, bytes]:
    """(tokens, form, code points of prefix and of middle, output) of one text."""
    units = Units(text)
    first, second, plain, order = draws(seed, doc_id)
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    if not text or plain % 100 >= 100 - plain_percent or any(m in text for m in marks):
        return units.n, "plain", None, None, text
    low, high = sorted((first % (units.n + 1), second % (units.n + 1)))
    a, b = units.start(low), units.start(high)
    p, s, m = marks
    view = memoryview(text)
    if order % 100 < spm_percent:
        form, parts = "spm", (s, view[b:], p, view[:a], m, view[a:b])
    else:
        form, parts = "psm", (p, view[:a], s, view[b:], m, view[a:b])
    before = units.chars(a)
    return units.n, form, before, units.chars(b) - before, b"".join(parts)


def _batches(batches: Iterator[pa.RecordBatch], seed: int, plain_percent: int, spm_percent: int) -> Iterator[pa.RecordBatch]:
    names = ["n", "form", "prefix_chars", "middle_chars", "output"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    for batch in batches:
        ids, texts, carried = batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("row")
        rows, first, held = [], 0, 0

        def flush(end: int) -> pa.RecordBatch:
            made = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds[:4])]
            made.append(pa.array([r[4] for r in rows], pa.binary()).cast(pa.string()))
            return pa.RecordBatch.from_arrays(
                [carried.slice(first, end - first), batch.column("doc_id").slice(first, end - first), *made],
                ["row", "doc_id", *names])

        for k, doc_id in enumerate(ids):
            text = texts[k].as_buffer().to_pybytes() if texts[k].is_valid else b""
            rows.append(arrange(text, doc_id, seed, plain_percent, spm_percent))
            held += len(text)
            if held >= OUT_BYTES:
                yield flush(k + 1)
                rows, first, held = [], k + 1, 0
        if rows:
            yield flush(len(ids))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED,
                   plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT,
                   carry: tuple[str, ...] | None = None) -> DataFrame:
    """Each document with n, form, prefix_chars, middle_chars and its rearranged text ``output``.

    ``row`` holds the columns in ``carry`` (default: all but the text).
    """
    kept = [c for c in docs.columns if c != text_col] if carry is None else list(carry)
    row = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(None).cast("int").alias("none"))
    rows = docs.select(row.alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = T.StructType([rows.schema["row"], rows.schema["doc_id"]])
    for name, kind in (("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()),
                       ("middle_chars", T.LongType()), ("output", T.StringType())):
        schema.add(name, kind)
    return rows.mapInArrow(partial(_batches, seed=seed, plain_percent=plain_percent, spm_percent=spm_percent), schema)


def restored(output: str = "output", form: str = "form") -> Column:
    """The original text, rebuilt from an output and its form."""
    parts = F.split(F.col(output), MARKS, -1)
    return (F.when(F.col(form) == "psm", F.concat(parts[1], parts[3], parts[2]))
            .when(F.col(form) == "spm", F.concat(parts[2], parts[3], parts[1]))
            .otherwise(F.col(output)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"), carry=())
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                       F.sha2(restored().cast("binary"), 256).alias("restored_sha256"))


SQL = r"""
with cut as (
  select doc_id, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as tokens,
         sha256('1:' || coalesce(doc_id::varchar, '')) as h
  from documents),
drawn as (
  select *, len(tokens) as n,
         ('0x' || h[1:8])::bigint % (len(tokens) + 1) as c1, ('0x' || h[9:16])::bigint % (len(tokens) + 1) as c2,
         text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>')
           or ('0x' || h[17:24])::bigint % 100 >= 90 as plain,
         ('0x' || h[25:32])::bigint % 100 < 20 as spm
  from cut),
parts as (
  select doc_id, text, n, case when plain then 'plain' when spm then 'spm' else 'psm' end as form,
         array_to_string(tokens[1:least(c1, c2)], '') as p,
         array_to_string(tokens[least(c1, c2) + 1:greatest(c1, c2)], '') as m,
         array_to_string(tokens[greatest(c1, c2) + 1:], '') as s
  from drawn)
select doc_id, n::bigint as n, form,
       case when form <> 'plain' then length(p)::bigint end as prefix_chars,
       case when form <> 'plain' then length(m)::bigint end as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
              else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
       sha256(text) as restored_sha256
from parts"""
