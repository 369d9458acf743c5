"""The registered queries of this subpackage: thin digests of its operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, langid, license_scan, mpegts, neardup, packing, secrets, sharding, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_warc(_table(spark, sf_dir, "pages"))
    records = warc.read_warc(spark, archives)
    response = F.col("record_type") == "response"
    return records.select(
        warc.page_of("record_id").alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("content_length")).alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type",
        warc.page_of("refers_to").alias("refers_to"),
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    p = license_scan.LicenseScan()
    model = license_scan.train(license_scan.corpus_lines(docs, p.negatives, p.window), p)
    return license_scan.scan_licenses(docs, model)


def op4_mpeg_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", mpegts.sizes().alias("n_bytes"), "text")
    return mpegts.media_features(mpegts.add_media(docs), keep=("doc_id", "n_bytes")).drop("units")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("_spans")
    base = F.filter(spans, lambda s: s["kind"].isin([r.kind for r in secrets.BASE_RULES]))
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(r.kind) for r in secrets.BASE_RULES), F.sha2(secrets.spans_text(base), 256).alias("base_sha256"), secrets.spans_text(spans).alias("spans"))


#: The conversation that each formatting run also holds.
PROBE = r"\### Assistant: </turn> ok"


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    out = chat.format_conversations(turns.unionByName(probe))
    back = chat.parse(F.col("formatted"))
    said = F.array_join(F.transform(back, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = chat.loss_text(F.col("formatted"), F.col("loss_spans"))
    out = out.select("conv_id", F.size(back).cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return out.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out().alias("held_out"), F.col("_lang.lang").alias("lang_pred"), F.col("_lang.score").alias("score"), F.col("_lang.ambiguous").alias("ambiguous"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


SHARDS = 40


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = sharding.document_sizes(_table(spark, sf_dir, "documents"))
    out = sharding.byte_shards(sized, SHARDS, "doc_id")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {f.__name__: f for f in (op1_warc, op2_decontamination, op3_license_scan, op4_mpeg_ts, op5_secret_scan, op6_chat_format, op7_language_id, op8_best_fit_packing, op9_minhash_near_dedup, op10_sharding)}



def _spans_sql(rule: secrets.Rule, rank: int) -> str:
    """A list of {start, rank, kind, end} of one rule's matches, from the pieces between them."""
    pattern = rule.pattern.replace("(?<![0-9a-f])", "").replace("'", "''")
    matches, judged, pieces = f"regexp_extract_all(t, '{pattern}')", f"regexp_extract_all(t, '{pattern}', {rule.group})", f"regexp_split_to_array(t, '{pattern}')"
    start = f"list_sum(list_transform({pieces}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform({matches}[1:i - 1], lambda x: length(x))), 0)"
    every = f"list_transform(range(1, len({matches}) + 1), lambda i: {{'start': CAST({start} AS BIGINT), 'rank': {rank}, 'kind': '{rule.kind}', 'n': CAST(length({matches}[i]) AS BIGINT), 'g': length({judged}[i])}})"
    return f"CASE WHEN regexp_matches(t, '{pattern}') THEN list_filter({every}, lambda s: s.g >= {rule.least}) ELSE [] END"


def _joined(spans: str) -> str:
    return f"array_to_string(list_transform({spans}, lambda s: s.kind || ':' || s.start || ':' || (s.start + s.n)), ',')"


_BASE = f"list_filter(spans, lambda s: s.rank < {len(secrets.BASE_RULES)})"
_ESCAPED = "length({0}) + length({0}) - length(replace({0}, '\\', '')) + len(string_split({0}, '</turn>')) - 1 + len(string_split({0}, ': ')) - 1 + coalesce(list_sum(list_transform(regexp_extract_all({0}, '#{{3,}}'), lambda x: length(x) - 2)), 0)"
_CONTROL = "contains({0}, '</turn>') OR contains({0}, '###') OR regexp_matches({0}, '(?s)\\\\.')"
_IN_ORDER = "ORDER BY turn NULLS FIRST, role, txt"

#: SQL for the queries that it can express.
ORACLES = {
    "op1_warc": """
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
               CASE WHEN other IS NULL THEN 'response' ELSE 'revisit' END AS record_type, other AS refers_to
        FROM (SELECT *, CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM m THEN m END AS other
              FROM (SELECT page_id, h, octet_length(encode(h)) AS n, max(page_id) OVER (PARTITION BY h) AS m
                    FROM (SELECT page_id, coalesce(html, '') AS h FROM pages)))""",
    "op2_decontamination": r"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
        i AS (SELECT item_id, ws, least(10, len(ws)) AS k FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark) WHERE len(ws) > 0),
        iw AS (SELECT DISTINCT item_id, k, array_to_string(ws[p:p + k - 1], ' ') AS w FROM (SELECT *, unnest(range(1, len(ws) - k + 2)) AS p FROM i)),
        ks AS (SELECT DISTINCT k FROM i),
        dw AS (SELECT r, k, p, array_to_string(ws[p:p + k - 1], ' ') AS w FROM (SELECT r, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM d, ks)),
        found AS (SELECT r, p, iw.k, item_id FROM dw JOIN iw ON dw.w = iw.w AND dw.k = iw.k),
        hit AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + k)) AS q FROM found) GROUP BY r),
        items AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY r)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
               sha256(coalesce(list, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated,
               CASE WHEN len(ws) > 0 THEN coalesce(hit.n, 0) / len(ws) ELSE 0.0::DOUBLE END AS coverage
        FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)""",
    "op5_secret_scan": f"""
        SELECT doc_id, {", ".join(f"CAST(len(list_filter(spans, lambda s: s.kind = '{r.kind}')) AS BIGINT) AS n_{r.kind}" for r in secrets.BASE_RULES)},
               sha256({_joined(_BASE)}) AS base_sha256, {_joined("spans")} AS spans
        FROM (SELECT doc_id, list_sort(flatten([{", ".join(_spans_sql(r, i) for i, r in enumerate(secrets.RULES))}])) AS spans
              FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))""",
    "op6_chat_format": f"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS txt FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'),
        e AS (SELECT *, {_CONTROL.format("txt")} OR {_CONTROL.format("role")} OR contains(role, ': ') AS conflict FROM t)
        SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || txt || chr(10), '' {_IN_ORDER})) AS turns_sha256,
               CAST(length(coalesce(string_agg(txt, '' {_IN_ORDER}) FILTER (role = 'assistant'), '')) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(txt, '' {_IN_ORDER}) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(14 + CASE WHEN conflict THEN {_ESCAPED.format("role")} + {_ESCAPED.format("txt")} ELSE length(role) + length(txt) END) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op10_sharding": f"""
        WITH tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i))),
        d AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 16 AS BIGINT) AS size,
                     list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM documents),
        s AS (SELECT doc_id, size, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32,
                     sum(size) OVER (ORDER BY doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS everything FROM d, tab),
        p AS (SELECT *, CAST(least({SHARDS - 1}, ((2 * upto - size) * {SHARDS}) // (2 * everything)) AS INTEGER) AS shard FROM s)
        SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p""",
}
