import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm.secrets import BASE, MORE, RULES, Ledger, Rule, listed, op13_secret_ledger, scan

TABLES = "/root/testdata/sf0.01"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace(
    "(password|passwd|secret|token|api_?key)", "(" + "|".join(
        "".join(f"[{c}{c.upper()}]" if c.isalpha() else c + ("?" if c == "_" else "") for c in w)
        for w in ("password", "passwd", "secret", "token", "api_key")) + ")"))


def plain(text):
    """Base findings by the patterns as they stand, on characters."""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text or "") if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 24]
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found)]


def base(rows):
    return {r[0]: ",".join(x for x in r["spans"].split(",") if x.split(":")[0] in ("assign", "access", "hex")) for r in rows}


def random_texts(n):
    r = random.Random(3)
    parts = ["password", "Passwd", "SECRET", "token", "api_key", "APIKEY", "apiKey", "ſecret", "toKen", "=", ":", " ", "  ", "'", '"', "é", "日本",
             "AKIA", "AKIAAKIA", "ABCDEF0123456789", "Z" * 9, "a" * 23, "0123456789abcdef" * 2, "g", "x=y-z/", "abc12", "_.", "\n",
             "-----BEGIN RSA PRIVATE KEY-----", "https://user:pass@host/"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(n)]


def test_base_findings_of_random_texts():
    for text in random_texts(4000):
        found = scan(text.encode(), BASE)
        got = sorted((a, i, rule.kind, b) for i, (rule, spans) in enumerate(zip(BASE, found)) for a, b in spans)
        assert [f"{k}:{a}:{b}" for a, _, k, b in got] == plain(text), text


@pytest.mark.parametrize("kind, secret", [
    ("pem", "-----BEGIN EC PRIVATE KEY-----\nAbc+/=\n-----END EC PRIVATE KEY-----"), ("pem", "-----BEGIN PRIVATE KEY-----"),
    ("jwt", "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl"), ("userinfo", "https://me:word@"),
    ("bearer", "Authorization: Bearer abcdefghijklmnop"),
])
def test_added_kinds(kind, secret):
    text = f"é {secret} x"
    found = {r.kind: s for r, s in zip(MORE, scan(text.encode(), MORE))}
    assert found[kind] == [(2, 2 + len(secret))]


def test_only_unseen_pairs_are_scanned(spark):
    texts = [(1, "a", "token: abcdef12"), (1, "b", "clean"), (2, "a", "token: abcdef12"), (3, "a", None), (3, "b", "")]
    versions = spark.createDataFrame(texts, "doc_id long, version string, text string")
    ledger = Ledger(spark)
    new = ledger.update(versions)
    assert new.count() == 3 * len(RULES) and new.select("blob").distinct().count() == 3
    assert ledger.update(versions).count() == 0
    more = versions.unionAll(spark.createDataFrame([(4, "a", "password=hunter22"), (5, "a", "clean")], versions.schema))
    assert ledger.update(more).count() == len(RULES)
    newer = (Rule("assign", 2, rb"nothing"),) + RULES[1:]
    assert ledger.update(more, rules=newer).count() == 4  # one rule has a new version, for four texts
    found = {(r.doc_id, r.version): r.spans for r in
             ledger.findings(more, keys=("doc_id", "version")).select("doc_id", "version", listed(F.col("found")).alias("spans")).collect()}
    assert found == {(1, "a"): "assign:0:15", (1, "b"): "", (2, "a"): "assign:0:15", (3, "a"): "", (3, "b"): "", (4, "a"): "assign:0:17", (5, "a"): ""}
    assert {r.s for r in ledger.findings(more, rules=newer).select(listed(F.col("found")).alias("s")).collect()} == {""}


def test_copies_empty_and_clashing_columns(spark):
    rows = [(7, "x token=abcdefgh", "k", b"1")] * 50 + [(None, "secret: 1234567", "k", None), (8, "y" * 200_000 + "AKIA" + "A" * 16, "k", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string, blob binary")
    ledger = Ledger(spark)
    ledger.update(docs)
    got = ledger.findings(docs).select("doc_id", listed(F.col("found")).alias("s")).collect()
    assert sorted(map(str, got)) == sorted(map(str, [spark.createDataFrame([(i, s)], "doc_id long, s string").first() for i, s in
                                                     [(7, "assign:2:16")] * 50 + [(None, "assign:0:15"), (8, "access:200000:200020")]]))
    none = docs.where("false")
    Ledger(spark).update(none)
    assert ledger.findings(none).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").collect()
    rows = op13_secret_ledger(spark, TABLES).collect()
    want = {r.doc_id: plain(r.text) for r in docs}
    assert len(rows) == len(docs) and base(rows) == {k: ",".join(v) for k, v in want.items()}
    for r in rows:
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x.startswith(k) for x in want[r.doc_id]) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(",".join(want[r.doc_id]).encode()).hexdigest()
    assert sum(map(len, want.values())) > 0
