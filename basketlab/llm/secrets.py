"""Secret scan with a trigram inverted index.

For each rule a Boolean query over lower-cased trigrams is derived from its
regular expression: literal pieces are concatenated (alternatives and small
classes multiply out) and every piece of three or more characters demands its
trigrams. Texts are indexed in segments of bounded bytes: postings (trigram
to text) of the trigrams that some rule asks for, found in one pass over the
bytes. Postings are intersected and united as the rule's query says, and only
the texts that remain are searched with the expression itself. A rule without
mandatory trigrams scans every text. A segment lives inside one task, so
nothing is shuffled and a lost executor costs only its own segments again.

Matches are leftmost and non-overlapping for each rule; ``least`` drops
matches (or a group of them) that are too short. Offsets count code points,
ends are exclusive.

Defined results: null text counts as empty and has no spans; ids may be null
or repeat, every row gives a row; an empty table gives an empty result; extra
columns are ignored (``redact`` keeps them).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlab.llm.arrays import flat, lean, row_blocks
from basketlab.llm.store import read

SEGMENT_BYTES = 1 << 20
MOST_STRINGS, MOST_CLASS = 64, 8


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 0     # fewest characters of ``group``
    group: int = 0


# The three base kinds in their order, then further kinds.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16,}"),   # the maximal runs of 16 or more; shorter runs would be dropped
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")

ALL = ("all",)


def _and(a, b):
    if a == ALL or a == b:
        return b
    return a if b == ALL else ("and", a, b)


def _or(a, b):
    if a == ALL or b == ALL:
        return ALL
    return a if a == b else ("or", a, b)


def _demand(strings: set[str]):
    """What a text must hold if it holds one of ``strings``."""
    clauses = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings}
    if frozenset() in clauses:
        return ALL
    clauses = [c for c in clauses if not any(d < c for d in clauses)]
    return reduce(_or, (reduce(_and, (("tri", t) for t in sorted(c))) for c in sorted(clauses, key=sorted)))


def _parts(nodes):
    """(exact strings or None, query) of a parsed sequence."""
    run, query, exact = {""}, ALL, True
    for op, arg in nodes:
        name, strings, q = str(op), None, ALL
        if name == "LITERAL":
            strings = {chr(arg).lower()}
        elif name == "IN":
            strings = _members(arg)
        elif name == "SUBPATTERN":
            strings, q = _parts(arg[3])
        elif name == "BRANCH":
            found = [_parts(x) for x in arg[1]]
            if all(s is not None for s, _ in found):
                strings = set().union(*(s for s, _ in found))
            else:
                q = reduce(_or, (_and(q, _demand(s)) if s is not None else q for s, q in found))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, body = arg
            s, bq = _parts(body)
            if s is not None and int(high) <= 1:
                strings = s | ({""} if low == 0 else set())
            elif s is not None and low == high and len(s) ** int(low) <= MOST_STRINGS:
                strings = reduce(lambda a, _: {x + y for x in a for y in s}, range(int(low)), {""})
            elif low >= 1:
                q = _and(bq, _demand(s)) if s is not None else bq
        elif name == "AT":
            strings = {""}
        if strings is not None and len(strings) * len(run) <= MOST_STRINGS:
            run = {x + y for x in run for y in strings}
            continue
        query, run, exact = _and(query, _demand(run)), {""}, False
        if strings is not None:
            run = strings if len(strings) <= MOST_STRINGS else {""}
        else:
            query = _and(query, q)
    return (run, ALL) if exact else (None, _and(query, _demand(run)))


def _members(items):
    out = set()
    for op, arg in items:
        if str(op) == "LITERAL":
            out.add(chr(arg).lower())
        elif str(op) == "RANGE" and arg[1] - arg[0] < MOST_CLASS:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= MOST_CLASS else None


def trigram_query(pattern: str):
    """The Boolean query a text must satisfy to hold a match: nested
    ("and" | "or", a, b) over ("tri", text), or ("all",)."""
    strings, query = _parts(re._parser.parse(pattern))
    query = _demand(strings) if strings is not None else query
    return query if all(t.isascii() for t in trigrams(query)) else ALL


def trigrams(query) -> set[str]:
    if query[0] == "tri":
        return {query[1]}
    return set() if query == ALL else trigrams(query[1]) | trigrams(query[2])


def matching(query, postings: dict[str, np.ndarray], n: int) -> np.ndarray:
    """Sorted positions of the texts that satisfy ``query``."""
    if query == ALL:
        return np.arange(n)
    if query[0] == "tri":
        return postings[query[1]]
    a, b = matching(query[1], postings, n), matching(query[2], postings, n)
    return np.intersect1d(a, b, True) if query[0] == "and" else np.union1d(a, b)


@lru_cache(maxsize=4)
def _compiled(rules: tuple[Rule, ...]):
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = sorted(set().union(*(trigrams(q) for q in queries)))
    table = np.zeros(1 << 24, np.uint16)
    for k, t in enumerate(wanted, 1):
        a, b, c = t.encode()
        table[a << 16 | b << 8 | c] = k
    return [re.compile(r.pattern, re.ASCII) for r in rules], queries, wanted, table


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def segment_postings(texts: pa.Array, wanted: list[str], table: np.ndarray) -> dict[str, np.ndarray]:
    """Postings of the wanted trigrams over the texts of one segment."""
    raw, offsets = flat(texts)
    out = {t: np.zeros(0, np.int64) for t in wanted}
    if len(raw) < 3 or not wanted:
        return out
    low = _LOWER[raw]
    code = low[:-2].astype(np.int32) << 16 | low[1:-1].astype(np.int32) << 8 | low[2:]
    which = table[code]
    at = np.flatnonzero(which)
    row = np.searchsorted(offsets, at, side="right") - 1
    inside = at + 3 <= offsets[row + 1]
    pairs = np.unique(which[at[inside]].astype(np.int64) << 40 | row[inside])
    for k in np.unique(pairs >> 40):
        out[wanted[k - 1]] = pairs[(pairs >> 40) == k] & ((1 << 40) - 1)
    return out


def segment_spans(texts: pa.Array, rules: tuple[Rule, ...]) -> list[list[tuple]]:
    """Per text its spans (start, rule number, end), sorted."""
    expressions, queries, wanted, table = _compiled(rules)
    postings = segment_postings(texts, wanted, table)
    found: list[list[tuple]] = [[] for _ in range(len(texts))]
    for k, (rule, expression, query) in enumerate(zip(rules, expressions, queries)):
        for i in matching(query, postings, len(texts)):
            for m in expression.finditer(texts[int(i)].as_py() or ""):
                if len(m[rule.group]) >= rule.least:
                    found[i].append((m.start(), k, m.end()))
    for x in found:
        x.sort()
    return found


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(id, spans) of every row: spans is an array of (kind, start, end) by
    start, then by the rules' order."""
    def scan(batches):
        for batch in batches:
            for b in row_blocks(batch, "text", SEGMENT_BYTES):
                spans = [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in x]
                         for x in segment_spans(b.column("text"), rules)]
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(spans, pa.list_(pa.struct(
                    [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))], ["id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(scan), "id long, spans array<struct<kind:string,start:long,end:long>>")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text",
           length_col: str | None = None) -> DataFrame:
    """``docs`` with every span replaced by ``[kind]`` (overlapping spans by
    the first one's); ``length_col``, if given, follows the changed texts."""
    schema = docs.schema

    def clean(batches):
        for batch in batches:
            for b in row_blocks(batch, text_col, SEGMENT_BYTES):
                at = b.schema.get_field_index(text_col)
                texts = b.column(text_col)
                spans = segment_spans(texts, rules)
                hit = [i for i, x in enumerate(spans) if x]
                if hit:
                    values = texts.to_pylist()
                    for i in hit:
                        t, out, upto = values[i], [], 0
                        for s, k, e in spans[i]:
                            if s >= upto:
                                out += [t[upto:s], f"[{rules[k].kind}]"]
                            upto = max(upto, e)
                        values[i] = "".join([*out, t[upto:]])
                    b = b.set_column(at, b.schema.field(at), pa.array(values, b.schema.field(at).type))
                    if length_col:
                        j = b.schema.get_field_index(length_col)
                        n = b.column(j).to_pylist()
                        for i in hit:
                            n[i] = len(values[i])
                        b = b.set_column(j, b.schema.field(j), pa.array(n, b.schema.field(j).type))
                yield b

    return docs.mapInArrow(lean(clean), schema)


def _joined(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def _is(kind: str):
    return lambda span: span["kind"] == kind


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(read(spark, sf_dir, "documents"))
    spans = F.col("spans")
    base = F.filter(spans, lambda x: x["kind"].isin(*BASE))
    counts = [F.size(F.filter(spans, _is(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(_joined(base), 256).alias("base_sha256"),
                        _joined(spans).alias("spans"))
