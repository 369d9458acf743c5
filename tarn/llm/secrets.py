"""Secret scans over an incremental ledger of blobs.

Every version of every path is addressed by the SHA-256 of its content.  The
ledger holds, for each (blob, rule, rule version) that was ever scanned, the
spans found.  A scan looks only at pairs that the ledger lacks, once per blob
however many paths and versions share it, and findings are joined back to all
of them.  DataFrame functions only.

Spans are in code points, end exclusive.  A rule's matches are leftmost and do
not overlap; of them those failing its minimum length are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import discard, fresh_path, written
from .names import col, columns_of, free_name


@dataclass(frozen=True)
class Rule:
    """``group`` of a match must have ``least`` characters; ``version`` changes whenever the rule does."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1


# The three base rules.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    # runs of 18 or more are the same matches as all runs with the shorter ones dropped
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{16,}"),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END [A-Z ]{0,40}PRIVATE KEY-----)?"),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}"),
)
RULES = BASE_RULES + MORE_RULES

#: Findings, and addresses of new blobs, of up to this estimated size are broadcast to the versions.
BROADCAST_BYTES = 32 << 20
#: Of one address in memory.
BLOB_BYTES = 128

_SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """array<struct(start, rank, kind, end)> of one rule's matches in a text that isn't null.

    The pieces between matches and the matches, in turn, make up the text; their
    lengths give the places.
    """
    none = F.array().cast(_SPANS)
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else matches
    pieces = F.split(text, rule.pattern, -1)
    parts = F.zip_with(F.arrays_zip(matches.alias("m"), judged.alias("g")), F.slice(pieces, 1, F.size(matches)), lambda x, p: F.struct(F.length(p).alias("gap"), F.length(x["m"]).alias("n"), F.length(x["g"]).alias("g")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), (start + x["n"]).alias("end"))
        return F.struct((start + x["n"]).alias("at"), F.when(x["g"] >= rule.least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    return F.when(text.rlike(rule.pattern), F.aggregate(parts, zero, step)["spans"]).otherwise(none)


def content_address(text: Column) -> Column:
    """SHA-256 of the text in UTF-8; null counts as empty."""
    return F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256)


def _ledger(spark: SparkSession, path: str) -> DataFrame:
    schema = f"blob string, kind string, version int, spans {_SPANS}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(conf).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def scan_new_blobs(versions: DataFrame, ledger: str, text: str = "text", rules: tuple[Rule, ...] = RULES) -> int:
    """Scans what the ledger at ``ledger`` lacks of ``versions`` and appends it; the number of blobs scanned.

    ``versions`` has one row per version of a path.  A blob of which some rules
    are unseen is scanned by those alone.  Empty contents are blobs like others.
    """
    spark = versions.sparkSession
    known = _ledger(spark, ledger)
    content = versions.select(content_address(col(text)).alias("blob"), F.coalesce(col(text), F.lit("")).alias("text"))
    wanted = F.array(*[_pair(r) for r in rules])
    seen = known.groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("seen"))
    todo = content.select("blob").distinct().join(seen, "blob", "left").select("blob", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<struct<kind:string,version:int>>"))).alias("todo")).where("size(todo) > 0")
    todo = written(todo, "todo")
    n = todo.count()
    if not n:
        return 0
    # Few new blobs (an increment): other texts are left where they are.  Else texts move once, by blob, and each task
    # first drops those that it has already.
    if n * BLOB_BYTES <= BROADCAST_BYTES and 8 * n <= versions.count():
        content = content.join(F.broadcast(todo.select("blob")), "blob", "left_semi")
    unseen = content.groupBy("blob").agg(F.first("text").alias("text")).join(todo, "blob")
    found = F.array(*[
        F.when(F.array_contains(F.col("todo"), _pair(r)), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), spans_of(F.col("text"), r, i).alias("spans")))
        for i, r in enumerate(rules)
    ])
    unseen.select("blob", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f")).select("blob", "f.*").write.mode("append").parquet(ledger)
    discard(spark, todo)
    return n


def _pair(rule: Rule) -> Column:
    return F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"))


def scan_secrets(versions: DataFrame, ledger: str | None = None, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``versions`` with one more column, the last: all spans of every row's text, by start and then by rule.

    It is called ``_spans``, with more underscores where ``versions`` has such a
    column.  Scans what is new and reads the rest from the ledger; without a
    ``ledger`` a new one is made in the shared folder.  All rows and columns stay;
    a null text has no spans.
    """
    spark = versions.sparkSession
    ledger = ledger or fresh_path(spark, "ledger")
    scan_new_blobs(versions, ledger, text, rules)
    name, blob = free_name(versions, "_spans"), free_name(versions, "_blob")
    current = reduce(lambda a, b: a | b, [(F.col("kind") == r.kind) & (F.col("version") == r.version) for r in rules])
    known = _ledger(spark, ledger).where(current & (F.size("spans") > 0)).dropDuplicates(["blob", "kind", "version"])
    findings = known.groupBy(F.col("blob").alias(blob)).agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias(name))
    findings = written(findings, "findings")
    # Texts need not move if what was found is small; else both sides are dealt by blob.
    found_bytes = findings.agg(F.sum(F.size(name) * 48 + 128)).first()[0] or 0
    if found_bytes <= BROADCAST_BYTES:
        findings = F.broadcast(findings)
    joined = versions.withColumn(blob, content_address(col(text))).join(findings, blob, "left")
    return joined.select(*columns_of(versions), F.coalesce(name, F.array().cast(_SPANS)).alias(name))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with every span, or union of overlapping spans, replaced by ``[kind]``."""
    zero = F.struct(F.lit(0).alias("to"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["to"] + 1, s["start"] - acc["to"])
        mark = F.concat(F.lit("["), s["kind"], F.lit("]"))
        return F.struct(F.greatest(acc["to"], s["end"]).alias("to"), F.when(s["start"] >= acc["to"], F.concat(acc["parts"], F.array(gap, mark))).otherwise(acc["parts"]).alias("parts"))

    done = F.aggregate(spans, zero, step)
    rest = F.substring(text, done["to"] + 1, F.length(text))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(done["parts"], ""), rest)).otherwise(text)
