"""Secret scan: fixed patterns, and beside them sliding-window entropy over candidate strings.

A candidate is a maximal run of token characters. A window slides over it; the counts of its
characters and of their classes, and with them the Shannon entropy, change by one character that
leaves and one that comes, so a string costs time in proportion to its length. The class of what is
in the window just then (hex digits alone, letters and digits, or with other signs) says which
threshold holds, so a key keeps its own behind a prefix. A window of letters alone or of digits
alone is no secret: words and numbers are not. Runs of windows above their threshold become one
span. An allow-list cuts out the parts of a candidate that are known to be none.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import per_batch

KINDS = ("assign", "access", "hex", "entropy")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
# Runs are maximal, so a lower bound on the length finds the same matches as a filter afterwards.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]+")
#: Hex in groups; the separators don't count as characters of the key.
_HEX_GROUPS = re.compile(r"(?<![A-Za-z0-9])[0-9A-Fa-f]{4,}(?:[-_][0-9A-Fa-f]{4,})+(?![A-Za-z0-9])")

# What a character adds to the counts of digits, letters, letters beyond f, and other signs.
_DIGIT, _HEX_LETTER, _LETTER, _SIGN = range(4)
_CLASS = {c: _DIGIT for c in "0123456789"} | {c: _HEX_LETTER for c in "abcdefABCDEF"} | {c: _LETTER for c in "ghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ"}


@dataclass(frozen=True)
class EntropyRule:
    """Window length in characters and least bits a character, by class of the characters in the window."""

    window: int = 16
    hex_bits: float = 2.9
    alnum_bits: float = 3.5
    base64_bits: float = 3.75
    #: A part of a candidate that one of these matches, between ends of runs of letters and digits, is no secret.
    allow: tuple[str, ...] = (
        r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",  # UUID
        r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?:T[0-9]{2,6}Z?)?",  # date
        r"[A-Za-z0-9]*(?i:example|sample|dummy|placeholder|x{6}|0{8}|1234567890|abcdefgh)[A-Za-z0-9]*",
    )

    def allowed(self) -> list[re.Pattern]:
        return [re.compile(rf"(?<![A-Za-z0-9])(?:{p})(?![A-Za-z0-9])") for p in self.allow]


def high_entropy_spans(s: str, rule: EntropyRule) -> list[tuple[int, int]]:
    """The parts of ``s`` that windows with enough entropy for their class cover, as (start, end)."""
    width = rule.window
    if len(s) < width:
        return []
    # H = log2(w) - sum(c log2 c) / w: a threshold on H is an upper bound on the sum.
    hex_most, alnum_most, base64_most = ((math.log2(width) - bits) * width + 1e-9 for bits in (rule.hex_bits, rule.alnum_bits, rule.base64_bits))
    term = [0.0] + [c * math.log2(c) for c in range(1, width + 1)]
    count: dict[str, int] = {}
    of_class = [0, 0, 0, 0]
    total = 0.0
    spans: list[tuple[int, int]] = []
    for i, ch in enumerate(s):
        if i >= width:  # first one leaves, so no count passes the width
            old = s[i - width]
            c = count[old]
            total += term[c - 1] - term[c]
            count[old] = c - 1
            of_class[_CLASS.get(old, _SIGN)] -= 1
        c = count.get(ch, 0)
        total += term[c + 1] - term[c]
        count[ch] = c + 1
        of_class[_CLASS.get(ch, _SIGN)] += 1
        if i >= width - 1 and of_class[_DIGIT] and of_class[_HEX_LETTER] + of_class[_LETTER]:
            if total <= (base64_most if of_class[_SIGN] else alnum_most if of_class[_LETTER] else hex_most):
                start = i - width + 1
                if spans and start <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], i + 1)
                else:
                    spans.append((start, i + 1))
    return spans


def candidate_spans(s: str, rule: EntropyRule, allow: list[re.Pattern]) -> list[tuple[int, int]]:
    """The parts of a candidate that count: what the allow-list leaves is searched piece by piece."""
    cuts = sorted(m.span() for p in allow for m in p.finditer(s))
    pieces, start = [], 0
    for a, b in [*cuts, (len(s), len(s))]:
        if a - start >= rule.window:
            pieces.append((start, a))
        start = max(start, b)
    found = []
    for start, end in pieces:
        found += [(start + a, start + b) for a, b in high_entropy_spans(s[start:end], rule)]
        for m in _HEX_GROUPS.finditer(s, start, end):
            at = [i for i, c in enumerate(m[0], m.start()) if c not in "-_"]
            found += [(at[a], at[b - 1] + 1) for a, b in high_entropy_spans("".join(s[i] for i in at), rule)]
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan(text: str, rule: EntropyRule = EntropyRule()) -> list[tuple[int, int, str]]:
    """All (start, end, kind) of a text by start, then kind; offsets are code points.

    Spans of the fixed patterns and of the entropy stand side by side, also where they overlap.
    """
    out: list[tuple[int, int, str]] = []
    for m in _ASSIGN.finditer(text):
        if len(m[2]) >= 12:
            out.append((m.start(), m.end(), "assign"))
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    allow = _compiled(rule)
    for m in _CANDIDATE.finditer(text):
        if m.end() - m.start() >= rule.window and not m[0].isalpha():
            out += [(a + m.start(), b + m.start(), "entropy") for a, b in candidate_spans(m[0], rule, allow)]
    out.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    return out


@functools.cache
def _compiled(rule: EntropyRule) -> list[re.Pattern]:
    return rule.allowed()


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: EntropyRule = EntropyRule()) -> DataFrame:
    """One row per row of ``docs``: the id and ``spans``, an array of (start, end, kind).

    A null text counts as empty and has no spans; other columns are not read; repeated rows give
    repeated results. Whole texts are scanned, one at a time, however long. Spans with the same start
    come in the order of KINDS. The id keeps its type. An empty table gives an empty result.
    """
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [[{"start": a, "end": b, "kind": k} for a, b, k in scan(t or "", rule)] for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(span))], names=["id", "spans"])

    picked = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return picked.mapInArrow(per_batch(run), f"id {dict(picked.dtypes)['id']}, spans array<struct<start:int,end:int,kind:string>>")


def _joined(spans) -> str:
    return ",".join(f"{x['kind']}:{x['start']}:{x['end']}" for x in spans)


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = batch.column(1).to_pylist()
        base = [[x for x in r if x["kind"] != "entropy"] for r in rows]
        n = {k: pa.array([sum(x["kind"] == k for x in r) for r in rows], pa.int64()) for k in KINDS}
        sha = [hashlib.sha256(_joined(r).encode()).hexdigest() for r in base]
        cols = [batch.column(0), n["assign"], n["access"], n["hex"], pa.array(sha), pa.array([_joined(r) for r in rows]), n["entropy"]]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long"
    return found.mapInArrow(per_batch(digest), schema)
