"""Secret scans over an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its content. The ledger is a Parquet table
``blob, rule_version, findings`` in a folder that all machines share: which rule, at which version, was applied
to which blob, and what it found. A run scans only pairs that the ledger lacks (a new blob meets all rules, a known
blob only new or changed rules), appends them and joins all findings back to every path that holds the blob.
"""
from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionflow.llm.common import attach_by_digest, digest, not_null_id, shared_folder, stored, whole_text

FINDINGS = "array<struct<kind:string,start:int,end:int>>"
LEDGER_SCHEMA = f"blob binary, rule_version string, findings {FINDINGS}"


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` (leftmost, not overlapping) whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def version(self) -> str:
        return hashlib.sha256(repr((self.kind, self.pattern, self.group, self.least)).encode()).hexdigest()[:16]

    def find(self, compiled: re.Pattern, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in compiled.finditer(text) if m.end(self.group) - m.start(self.group) >= self.least]


# The three base kinds in their order, then public formats that the method adds.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]+", 0, 24),
)
MORE = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{20,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE + MORE


def read_ledger(spark, ledger: str) -> DataFrame:
    """The ledger; empty if nothing was scanned yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], LEDGER_SCHEMA)
    return spark.read.schema(LEDGER_SCHEMA).parquet(ledger)


def scan_secrets(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES,
                 path: str = "doc_id", text: str = "text") -> DataFrame:
    """One row ``doc_id, blob, findings`` per row of ``docs`` (a version of a path); the ledger grows by what is new.

    Findings are spans ``kind, start, end`` in code points, end exclusive, by start, then rule order, then end. NULL
    texts count as empty. Rows with NULL or repeated paths each get their row; other columns are left out, whatever
    their names. An empty table gives an empty one and scans nothing.
    """
    spark = docs.sparkSession
    ledger = ledger or shared_folder(spark)
    content = whole_text(docs[text])
    versions = [rule.version for rule in rules]
    full = docs.select(not_null_id(docs[path]).alias("_id"), docs[path].alias("doc_id"), content.alias("_text"),
                       digest(content).alias("blob"))
    keyed = stored(full.drop("_text"))
    seen = (read_ledger(spark, ledger).filter(F.col("rule_version").isin(versions))
            .groupBy("blob").agg(F.collect_set("rule_version").alias("_seen")))  # at most one per rule
    wanted = F.array(*map(F.lit, versions))
    unseen = (keyed.groupBy("blob").agg(F.min("_id").alias("_id")).join(seen, "blob", "left")
              .withColumn("_rules", F.array_except(wanted, F.coalesce("_seen", F.array().cast("array<string>"))))
              .filter(F.size("_rules") > 0).select(F.col("blob").alias("_b"), F.col("_id").alias("_i"), "_rules"))
    texts = full.join(unseen, (F.col("_id") == F.col("_i")) & (F.col("blob") == F.col("_b")))

    def run(batches):
        import pyarrow as pa
        # ASCII: letters match in either case, and nothing else folds to them
        ready = {rule.version: (rule, re.compile(rule.pattern, re.ASCII)) for rule in rules}
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            blobs, used, found = [], [], []
            for blob, whole, todo in zip(*(batch.column(k).to_pylist() for k in range(3))):
                for version in todo:
                    rule, compiled = ready[version]
                    blobs.append(blob)
                    used.append(version)
                    found.append([{"kind": rule.kind, "start": a, "end": b} for a, b in rule.find(compiled, whole)])
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), pa.array(used, pa.string()),
                                              pa.array(found, kind)], names=["blob", "rule_version", "findings"])

    (texts.select("blob", "_text", "_rules").mapInArrow(run, LEDGER_SCHEMA)
     .write.mode("append").parquet(ledger))
    # One row per blob and rule; repeated entries (repeated rows, two runs at once) become one.
    rank = F.create_map(*[x for k, rule in enumerate(rules) for x in (F.lit(rule.kind), F.lit(k))])
    entries = (read_ledger(spark, ledger).filter(F.col("rule_version").isin(versions))
               .groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("findings"))).alias("_f")))
    ordered = F.array_sort(F.transform("_f", lambda x: F.struct(
        x["start"].alias("start"), rank[x["kind"]].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))))
    findings = F.transform(ordered, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"),
                                                       x["end"].alias("end")))
    return attach_by_digest(keyed.drop("_id"), entries.select("blob", findings.alias("findings")),
                            "blob").select("doc_id", "blob", "findings")
