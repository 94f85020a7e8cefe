import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tablewright.llm.secrets_scan import BASE_RULES, RULES, automata, op1_secret_scans, scan, secrets


def brute(text: str | None) -> dict:
    """The base of one text by regular expressions, for tests."""
    text = text or ""
    rows = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.sub("[A-Z]", lambda c: c[0].lower(), text)):
        if len(m[2]) >= 6:
            rows.append((m.start(), 0, "assign", m.end()))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 20:
            rows.append((m.start(), 1, "access", m.end()))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m[0]) >= 24:
            rows.append((m.start(), 2, "hex", m.end()))
    rows.sort()
    said = ",".join(f"{k}:{s}:{e}" for s, _, k, e in rows)
    return {"n_assign": sum(r[1] == 0 for r in rows), "n_access": sum(r[1] == 1 for r in rows), "n_hex": sum(r[1] == 2 for r in rows), "base_sha256": hashlib.sha256(said.encode()).hexdigest()}


def digest(text, rules=RULES):
    raw = (text or "").encode()
    found = scan(np.frombuffer(raw, np.uint8), np.array([0, len(raw)], np.int64), rules)
    base = [x for x in found if x[3] < len(BASE_RULES)]
    said = ",".join(f"{RULES[k].kind}:{s}:{e}" for _, s, e, k in base)
    count = lambda k: sum(x[3] == k for x in base)
    return {"n_assign": count(0), "n_access": count(1), "n_hex": count(2), "base_sha256": hashlib.sha256(said.encode()).hexdigest()}


PIECES = ["password", "passwd", "Secret", "TOKEN", "api_key", "apikey", "api", "=", ":", " ", "'", '"', "==", "abcdef", "0123456789abcdef", "AKIA", "AKIAAKIA", "ABCD1234EFGH5678", "\n", "é", "x", "-", "ghp_" + "a1" * 20, "xoxb-123456-abcdef", "日本", "."]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25))
def test_base_matches_regular_expressions(parts):
    text = "".join(parts)
    assert digest(text) == brute(text)


def test_lanes_and_rows_agree_with_single_texts():
    rng = random.Random(5)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(0, 400))) for _ in range(60)] + ["", "a" * 90_000, "token=" + "Z" * 50_000, "f" * 3000 + " " + "9" * 24]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    found = scan(np.frombuffer(b"".join(raw), np.uint8), offsets)
    for row, text in enumerate(texts):
        said = ",".join(f"{RULES[k].kind}:{s}:{e}" for r, s, e, k in found if r == row and k < 3)
        assert hashlib.sha256(said.encode()).hexdigest() == brute(text)["base_sha256"]


def test_added_kinds_and_minimal_automaton():
    text = "ghp_" + "z" * 36 + " xoxb-12345-zbcdefgh -----BEGIN RSA PRIVATE KEY----- ghp_short"
    raw = np.frombuffer(text.encode(), np.uint8)
    assert [RULES[k].kind for *_, k in scan(raw, np.array([0, len(raw)]))] == ["forge", "chat", "pem"]
    machine, _ = automata(RULES)
    table = np.column_stack([machine.accept, machine.step.reshape(-1, machine.classes)])
    assert len(np.unique(table, axis=0)) == len(table)


def test_query_over_edge_rows(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "password = hunter2x"), (3, "password = hunter2x"), (None, "x"), (5, "é token:abcdef " * 5000)]
    docs = spark.createDataFrame([(a, b, "clash") for a, b in rows], "doc_id long, text string, spans string")
    got = secrets(docs).collect()
    assert len(got) == len(rows)
    assert {len(r.spans) for r in got if r.doc_id == 3} == {1}
    assert secrets(docs.limit(0)).collect() == []
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in op1_secret_scans(spark, str(tmp_path)).collect()}
    for doc, text in rows:
        assert {k: out[doc][k] for k in ("n_assign", "n_access", "n_hex", "base_sha256")} == brute(text)
