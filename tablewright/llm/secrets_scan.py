"""Secret scan: all rules in one byte pass of a combined, minimised automaton."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tablewright.llm.automaton import Automaton, compile_rules
from tablewright.llm.shared import chunks, whole_texts


@dataclass(frozen=True)
class Rule:
    """A kind of secret.

    ``pattern`` is in the automaton's dialect; it must end in a fixed text or in a greedy loop over one
    class, so that all matches that share an end character share the end. ``value`` is the class of that
    loop where ``least`` counts the loop's characters alone, else ``least`` counts the whole match.
    """

    kind: str
    pattern: str
    least: int
    lead: str = ""


# The three base rules.
BASE_RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=\-]+""", 6, r"""(?i:password|passwd|secret|token|api_?key)["']? *[:=] *["']?"""),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
# Public credential formats beyond the base.
MORE_RULES = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9\-]+", 15),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0),
)
RULES = BASE_RULES + MORE_RULES

STRIDE = 1024
"""Bytes of a lane; lanes begin after a byte that resets every state, so cutting loses nothing."""


@lru_cache(maxsize=8)
def automata(rules: tuple[Rule, ...]) -> tuple[Automaton, list[Automaton]]:
    """Built once in each Python worker; about 1,000 states for the default rules."""
    return compile_rules([r.pattern for r in rules])


def states_of(machine: Automaton, data: np.ndarray) -> np.ndarray:
    """The state after each byte. Lanes of the text advance in lockstep; one pass, each byte once."""
    n = len(data)
    found = np.empty(n, np.int32)
    if n == 0:
        return found
    column = machine.byte_class[data].astype(np.int32)
    resets = np.flatnonzero(machine.sync_bytes()[data]) + 1
    at = np.searchsorted(resets, np.arange(STRIDE, n, STRIDE))
    begins = np.unique(np.concatenate([[0], resets[at[at < len(resets)]]]))
    begins = begins[begins < n]
    sizes = np.diff(np.concatenate([begins, [n]]))
    order = np.argsort(-sizes, kind="stable")
    begins, sizes = begins[order], sizes[order]
    step, classes = machine.step, machine.classes
    state = np.full(len(begins), machine.start, np.int32)
    # lanes still running at step t: sizes are in falling order
    running = len(sizes) - np.searchsorted(sizes[::-1], np.arange(sizes[0]), side="right")
    t = 0
    while t < sizes[0] and running[t] >= 16:
        k = running[t]
        here = begins[:k] + t
        now = step[state[:k] * classes + column[here]]
        found[here] = now
        state[:k] = now
        t += 1
    if t < sizes[0]:  # a few long lanes without a reset
        table = step.tolist()
        for lane in range(running[t]):
            s = int(state[lane])
            lo, hi = int(begins[lane]) + t, int(begins[lane] + sizes[lane])
            out = []
            for c in column[lo:hi].tolist():
                s = table[s * classes + c]
                out.append(s)
            found[lo:hi] = out
    return found


def leftmost(mirror: Automaton, data: bytes, end: int, floor: int) -> int:
    """The first position at or after ``floor`` from which the rule matches up to ``end``, else -1."""
    state, best = mirror.start, -1
    for at in range(end - 1, floor - 1, -1):
        state = mirror.step[state * mirror.classes + mirror.byte_class[data[at]]]
        if state == mirror.dead:
            break
        if mirror.accept[state]:
            best = at
    return best


def scan(data: np.ndarray, offsets: np.ndarray, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, int, int]]:
    """(row, start, end, rule) in code points of every match that meets its length, by row, start and rule.

    For each rule the matches are the leftmost ones that don't overlap, as a regular expression
    search gives them; too short ones take their place and are then dropped.
    """
    machine, mirrors = automata(rules)
    rows = len(offsets) - 1
    # rows are parted by a line feed, which resets every state
    wide = np.full(len(data) + rows, 10, np.uint8)
    shift = np.repeat(np.arange(rows), np.diff(offsets))
    wide[np.arange(len(data)) + shift] = data
    starts = offsets[:-1] + np.arange(rows)
    accept = machine.accept[states_of(machine, wide)]
    hits = np.flatnonzero(accept)
    follows = accept[np.minimum(hits + 1, len(wide) - 1)]
    ends_here = accept[hits] & ~follows
    hits, ends_here = hits[ends_here != 0], ends_here[ends_here != 0]
    found: list[tuple[int, int, int, int]] = []
    if not len(hits):
        return found
    owner = np.searchsorted(starts, hits, side="right") - 1
    floors: dict[tuple[int, int], int] = {}
    points: dict[int, np.ndarray] = {}
    raw = wide.tobytes()
    for hit, row, bits in zip(hits.tolist(), owner.tolist(), ends_here.tolist(), strict=True):
        base = int(starts[row])
        for k, rule in enumerate(rules):
            if not bits >> k & 1:
                continue
            end = hit + 1
            begin = leftmost(mirrors[k], raw, end, floors.get((row, k), base))
            if begin < 0:
                continue
            floors[row, k] = end
            size = end - begin
            if rule.lead:
                size -= re.match(rule.lead.encode(), raw[begin:end]).end()
            if size < rule.least:
                continue
            if row not in points:
                own = data[offsets[row] : offsets[row + 1]]
                points[row] = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
            found.append((row, int(points[row][begin - base]), int(points[row][end - base]), k))
    return sorted(found, key=lambda x: (x[0], x[1], x[3]))


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every secret in every whole text: ``doc_id``, ``spans`` array of (kind, start, end) by start, then rule.

    Starts and ends are in code points, ends exclusive. Null and empty texts give an empty array; a
    very long text is scanned like any other; rows, repeated ones too, are independent, so nothing is
    shuffled and a lost task is simply run again. Other columns are not read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [r.kind for r in rules]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for ids, data, offsets in chunks(batches):
            spans: list[list[dict]] = [[] for _ in range(len(ids))]
            for row, start, end, k in scan(data, offsets, rules):
                spans[row].append({"kind": kinds[k], "start": start, "end": end})
            yield pa.record_batch([ids, pa.array(spans, kind)], names=["doc_id", "spans"])

    return whole_texts(docs, id_col, text_col).mapInArrow(work, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def op1_secret_scans(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of the scan over all documents; counts and base_sha256 are of the base rules."""
    from pyspark.sql import functions as F

    found = secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["kind"].isin(*[r.kind for r in BASE_RULES]))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(r.kind) for r in BASE_RULES], F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
