"""Fill-in-middle transformation over memoised content-defined chunks.

A text is a sequence of lines (its units). Two cuts between lines, drawn from
a seeded hash of the document's id, part it into prefix, middle and suffix,
which are written in the order psm or spm with marks before each part.

Lines are never listed. A rolling hash over the last ``WINDOW`` bytes cuts
texts into chunks at places that depend on the content alone, so a passage
that many documents share makes the same chunks in all of them. Each
chunk has a boundary summary: how many lines end in it and where, how many
code points it has up to each, whether it holds a mark, and its first and
last bytes (a mark may straddle chunks). Summaries are kept in a memo keyed
by the chunk's bytes, so a hit is a comparison of the content itself and not
of a hash. Adding the chunks' counts finds the chunk in which a cut lies; only
its summary is searched for the place.

The work is one narrow pass: no shuffle, a memo of at most ``MEMO_BYTES`` for
each task, blocks of at most ``BLOCK_BYTES`` of text (a longer text is a block
of its own). ``restore`` rebuilds the text with DataFrame functions.

Defined results: null texts count as empty; empty texts and texts that hold a
mark stay plain; a null id hashes as the empty word; repeated rows give
repeated rows; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlab.llm.arrays import U, flat, lean, prefix_sums, range_hashes, row_blocks
from basketlab.llm.store import read

SEED, RATE, SPM_SHARE = 7, 100, 50
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
WINDOW, CUT_BITS = 32, 11                 # a chunk of 2 KB on average
MIN_CHUNK, MAX_CHUNK = 256, 1 << 16
MEMO_BYTES = 8 << 20
BLOCK_BYTES = 1 << 19


def content_cuts(raw: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each text, relative to the block. A cut stands
    where the hash of the WINDOW bytes before it, all of the same text, has
    CUT_BITS leading zeros; cuts closer than MIN_CHUNK to the one before are
    passed over, and a stretch of MAX_CHUNK without one is cut there."""
    at = np.zeros(0, np.int64)
    if len(raw) >= WINDOW:
        ends = np.arange(WINDOW, len(raw) + 1)
        h = range_hashes(prefix_sums(raw), ends - WINDOW, ends)
        at = ends[h >> U(64 - CUT_BITS) == 0]
    first = np.searchsorted(at, offsets[:-1] + WINDOW)
    last = np.searchsorted(at, offsets[1:])
    out = []
    for start, end, i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), first.tolist(), last.tolist()):
        cuts, before = [], start
        for c in [*at[i:max(i, j)].tolist(), end]:
            while c - before > MAX_CHUNK:
                before += MAX_CHUNK
                cuts.append(before)
            if c == end or c - before >= MIN_CHUNK:
                before = c
                cuts.append(c)
        out.append(cuts if end > start else [])
    return out


@dataclass(frozen=True)
class Summary:
    ends: np.ndarray       # bytes up to and with each line end
    chars_at: np.ndarray   # code points up to there
    chars: int
    marked: bool
    head: bytes
    tail: bytes


def summarise(body: bytes) -> Summary:
    b = np.frombuffer(body, np.uint8)
    ends = np.flatnonzero(b == 10) + 1
    first = np.cumsum(b & 0xC0 != 0x80)    # bytes that begin a code point
    return Summary(ends, first[ends - 1], int(first[-1]), any(m in body for m in MARKS), body[:2], body[-2:])


class Memo:
    """Summaries by chunk content; beyond ``limit`` bytes the oldest leave."""

    def __init__(self, limit: int = MEMO_BYTES):
        self.limit, self.size, self.held, self.hits = limit, 0, {}, 0

    def of(self, body: bytes) -> Summary:
        got = self.held.get(body)
        if got is not None:
            self.hits += 1
            return got
        got = self.held[body] = summarise(body)
        self.size += self._cost(body, got)
        while self.size > self.limit and len(self.held) > 1:
            old = next(iter(self.held))
            self.size -= self._cost(old, self.held.pop(old))
        return got

    @staticmethod
    def _cost(body, summary):
        return len(body) + 16 * len(summary.ends) + 400


def locate(summaries: list[Summary], lengths: list[int], cut: int, lines: int) -> tuple[int, int]:
    """(bytes, code points) before the cut after the first ``cut`` lines of a
    text with ``lines`` line ends: chunk counts are added up to the chunk that
    holds the cut's line end. A cut beyond the last line end is the text's
    end (its last line is not closed)."""
    at = chars = seen = 0
    if cut == 0:
        return 0, 0
    for s, n in zip(summaries, lengths):
        here = len(s.ends)
        if cut <= lines and seen + here >= cut:
            k = cut - seen - 1
            return at + int(s.ends[k]), chars + int(s.chars_at[k])
        seen, at, chars = seen + here, at + n, chars + s.chars
    return at, chars


def arrange(key: str, chunks: list[bytes], memo: Memo, rate: int = RATE, spm_share: int = SPM_SHARE):
    """(lines, form, prefix_chars, middle_chars, output) of one text, given as
    its chunks; ``key`` is hashed."""
    text = b"".join(chunks)
    summaries = [memo.of(c) for c in chunks]
    ends = sum(len(s.ends) for s in summaries)
    n = ends + (1 if text and text[-1] != 10 else 0)
    marked, tail = False, b""
    for s in summaries:
        marked = marked or s.marked or any(m in tail + s.head for m in MARKS)
        tail = (tail + s.tail)[-2:]
    h = hashlib.sha256(key.encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    if not text or marked or h3 % 100 >= rate:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    lengths = [len(c) for c in chunks]
    (i, before), (j, upto) = (locate(summaries, lengths, c, ends) for c in (low, high))
    prefix, middle, suffix = text[:i], text[i:j], text[j:]
    p, s, m = MARKS
    if h4 % 100 < spm_share:
        return n, "spm", before, upto - before, s + suffix + p + prefix + m + middle
    return n, "psm", before, upto - before, p + prefix + s + suffix + m + middle


def fim_transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED,
                  rate: int = RATE, spm_share: int = SPM_SHARE) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every row:
    ``rate`` per cent of the texts are rearranged, ``spm_share`` per cent of
    those in the order spm."""
    def work(batches):
        memo = Memo()
        for batch in batches:
            for b in row_blocks(batch, "text", BLOCK_BYTES):
                raw, offsets = flat(b.column("text"))
                body, rows = raw.tobytes(), []
                for i, start, cuts in zip(b.column("id").to_pylist(), offsets.tolist(), content_cuts(raw, offsets)):
                    chunks = [body[x:y] for x, y in zip([start, *cuts[:-1]], cuts)]
                    rows.append(arrange(f"{seed}:{'' if i is None else i}", chunks, memo, rate, spm_share))
                n, form, before, middle, output = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()),
                     pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())],
                    ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(lean(work), "id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(output: str = "output", form: str = "form") -> Column:
    """The text of a transformed row. A plain text is the output itself; in
    the others each mark stands exactly once, since the text holds none."""
    out = F.col(output)

    def between(first, second):
        a = F.locate(first, out) + len(first)
        return out.substr(a, F.locate(second, out) - a)

    middle = out.substr(F.locate(MIDDLE, out) + len(MIDDLE), F.length(out))
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(out)


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    made = fim_transform(read(spark, sf_dir, "documents"))
    return made.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
                       F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                       F.sha2(restore().cast("binary"), 256).alias("restored_sha256"))


ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units
  FROM documents),
c AS (
  SELECT *, len(units) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(units) + 1) AS c1,
         ('0x' || substr(h, 9, 8))::BIGINT % (len(units) + 1) AS c2,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                   OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= {RATE} THEN 'plain'
              WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < {SPM_SHARE} THEN 'spm' ELSE 'psm' END AS form
  FROM d),
p AS (
  SELECT *, coalesce(array_to_string(units[1:least(c1, c2)], ''), '') AS prefix,
         coalesce(array_to_string(units[least(c1, c2) + 1:greatest(c1, c2)], ''), '') AS middle,
         coalesce(array_to_string(units[greatest(c1, c2) + 1:], ''), '') AS suffix
  FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
                        WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
