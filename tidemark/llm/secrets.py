"""Secret scans: a ledger of content-addressed texts, so that only unseen pairs of text and rule version are scanned."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm.words import blobs
from tidemark.session import new_path, stage
from tidemark.shipping import ship_package


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` on UTF-8 bytes, leftmost and non-overlapping; a new ``version`` is scanned anew.

    A text without any of ``hints`` (if given) cannot match. ``group`` and ``least`` drop matches whose group is shorter.
    """

    kind: str
    version: int
    pattern: bytes
    hints: tuple[bytes, ...] = ()
    group: int = 0
    least: int = 0

    def spans(self, text: bytes, lowered: bytes) -> list[tuple[int, int]]:
        if self.hints and not any(x in lowered for x in self.hints):
            return []
        return [m.span() for m in re.finditer(self.pattern, text) if len(m[self.group]) >= self.least]


#: Fixed patterns: the three base kinds in their order, then the kinds this scan adds.
BASE = (
    Rule("assign", 1, rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"), 2, 6),
    Rule("access", 1, rb"AKIA[A-Z0-9]{16,}", (b"akia",)),
    Rule("hex", 1, rb"(?<![0-9a-f])[0-9a-f]{24,}"),
)
MORE = (
    Rule("pem", 1, rb"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]+-----END (?:[A-Z]+ )*PRIVATE KEY-----)?", (b"private key-----",)),
    Rule("jwt", 1, rb"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", (b".eyj",)),
    Rule("userinfo", 1, rb"[A-Za-z][A-Za-z0-9+.-]{1,31}://[^\s:/@?#]{1,256}:[^\s/@?#]{1,256}@", (b"://",)),
    Rule("bearer", 1, rb"(?i:authorization\x20*:\x20*bearer)\x20+[A-Za-z0-9+/_.~=-]{16,}", (b"bearer",)),
)
RULES = BASE + MORE

#: Copies of a text are joined with its findings in so many groups.
SALTS = 16
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def scan(text: bytes, rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int]]]:
    """Spans of every rule, in code points."""
    lowered = text.lower()
    found = [rule.spans(text, lowered) for rule in rules]
    if text.isascii() or not any(found):
        return found
    # A code point begins at every byte but those of the form 10xxxxxx.
    points = np.append(0, np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))
    return [[(int(points[a]), int(points[b])) for a, b in spans] for spans in found]


class Ledger:
    """Parquet table (blob, kind, version, spans) of what was scanned: one row per text and rule, also without findings.

    ``blob`` is the SHA-256 of the text. Every addition is a Parquet write of its own below ``path``; a run that is
    repeated after a failure finds what was committed and scans the rest.
    """

    schema = "blob binary, kind string, version int, spans array<struct<start:long,end:long>>"

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or new_path(spark, "ledger")

    def rows(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], self.schema)
        # A text scanned twice by jobs that ran at the same time has equal rows.
        return self.spark.read.schema(self.schema).parquet(self.path)

    def update(self, versions: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Scan what the ledger does not know yet of all texts of ``versions``; gives the pairs that were scanned."""
        spark = self.spark
        ship_package(spark)
        address = versions.select(F.coalesce(versions[text], F.lit("")).cast("binary").alias("body"))
        address = address.select(F.unhex(F.sha2("body", 256)).alias("blob"), "body")
        # One body per content; equal texts of a task become one before the shuffle.
        bodies = address.groupBy("blob").agg(F.first("body").alias("body"))
        numbers = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(_name(r)), F.lit(i))])
        known = (self.rows().select("blob", numbers[_named()].alias("rule")).where("rule is not null").groupBy("blob").agg(F.collect_set("rule").alias("seen")))
        todo = bodies.join(known, "blob", "left").where(F.coalesce(F.size("seen"), F.lit(0)) < len(rules)).select("blob", "body", "seen")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                seen = batch.column("seen").to_pylist()
                for a in range(0, len(batch), 512):
                    part = batch.slice(a, 512)
                    blob, kind, version, spans = [], [], [], []
                    for at, body, done in zip(part.column("blob").to_pylist(), blobs(part.column("body")), seen[a : a + 512]):
                        left = tuple(r for i, r in enumerate(rules) if not done or i not in done)
                        for rule, found in zip(left, scan(body, left)):
                            blob.append(at)
                            kind.append(rule.kind)
                            version.append(rule.version)
                            spans.append([{"start": s, "end": e} for s, e in found])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(blob, pa.binary()), pa.array(kind, pa.string()), pa.array(version, pa.int32()), pa.array(spans, _SPANS)],
                        ["blob", "kind", "version", "spans"])

        # Stored apart as well: read from the ledger's plan again, the pairs would no longer be unseen.
        new = stage(todo.mapInArrow(run, self.schema), "scanned")
        new.write.mode("append").parquet(self.path)
        return new

    def findings(self, versions: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text",
                 rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """One row per row of ``versions``: its ``keys`` (path, version) and ``found``: array of kind, start, end.

        Findings are in order of their start, then of ``rules``. A missing text is empty, other columns are ignored, rows
        without or with repeated keys have a row each. Texts of any length are scanned whole. An empty table gives
        an empty result; a text that the ledger does not know has no findings.
        """
        paths = versions.select(*[versions[k].alias(f"key{i}") for i, k in enumerate(keys)],
                                F.unhex(F.sha2(F.coalesce(versions[text], F.lit("")).cast("binary"), 256)).alias("blob"))
        # Keys and address are enough for the join; copies of one text are spread over salts.
        paths = paths.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
        order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
        entry = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), order[F.col("kind")].alias("place"),
                                                        s["end"].alias("end"), F.col("kind").alias("kind")))
        found = (self.rows().where(F.size("spans") > 0).where(_named().isin([_name(r) for r in rules]))
                 .groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(entry)))).alias("found"))
                 .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
        spans = F.transform("found", lambda f: F.struct(f["kind"].alias("kind"), f["start"].alias("start"), f["end"].alias("end")))
        none = F.array().cast("array<struct<kind:string,start:long,end:long>>")
        return (paths.join(found, ["blob", "salt"], "left")
                .select(*[F.col(f"key{i}").alias(k) for i, k in enumerate(keys)], F.coalesce(spans, none).alias("found")))


def _name(rule: Rule) -> str:
    return f"{rule.kind}:{rule.version}"


def _named() -> Column:
    return F.concat_ws(":", "kind", F.col("version").cast("string"))


def listed(found: Column) -> Column:
    """``kind:start:end`` of all findings, joined by commas."""
    return F.array_join(F.transform(found, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")


def op13_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ledger = Ledger(spark)
    ledger.update(docs)
    found = ledger.findings(docs)
    base = [r.kind for r in BASE]
    count = lambda kind: F.size(F.filter("found", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in base],
                        F.sha2(listed(F.filter("found", lambda f: f["kind"].isin(base))), 256).alias("base_sha256"),
                        listed(F.col("found")).alias("spans"))
