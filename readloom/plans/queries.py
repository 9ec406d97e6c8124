"""Named queries of the core, each with its SQL counterpart where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from readloom.config import Context, Extraction, Settings
from readloom.functions.dna import LOG_RIGHT, LOG_WRONG, WEIGHTS, partial_barcode, quality_stats, tag_id, true_barcode
from readloom.functions.text import value_sql
from readloom.operators import barcodes, cluster, consensus, evaluate, pileup, split
from readloom.operators.salted import group_summary, heavy_groups
from readloom.plans import pipeline
from readloom.session import Scratch, spread, table
from readloom.sources import error_parse, fastq

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


@query(
    "p1_found",
    f"""SELECT bc FROM (SELECT {value_sql('bc')} AS bc, count(*) AS n FROM assigned_reads WHERE bc IS NOT NULL GROUP BY 1)
    WHERE n * 100 >= (SELECT count(*) FROM assigned_reads)""",
)
def p1_found(spark, sf):
    return heavy_groups(table(spark, sf, "assigned_reads"), 0.01)


@query(
    "p1_groups",
    f"""SELECT {value_sql('bc')} AS bc, count(*) AS n_reads, count(DISTINCT {value_sql('seq')}) AS n_distinct_seq,
    epoch_us(min(loaded_at)) AS first_loaded_us, epoch_us(max(loaded_at)) AS last_loaded_us
    FROM assigned_reads WHERE bc IS NOT NULL GROUP BY 1""",
)
def p1_groups(spark, sf):
    out = group_summary(table(spark, sf, "assigned_reads"))
    return out.select(
        "bc",
        "n_reads",
        "n_distinct_seq",
        F.unix_micros("first_loaded_at").alias("first_loaded_us"),
        F.unix_micros("last_loaded_at").alias("last_loaded_us"),
    )


_LINES = r"""SELECT raw_id, file_idx, raw, list_transform(string_split(regexp_replace(raw, '\n\z', ''), chr(10)),
    lambda x: regexp_replace(x, '\r\z', '')) AS ls FROM raw_fastq"""
_CHECKED = rf"""SELECT raw_id, file_idx, ls, CASE WHEN raw IS NULL OR len(ls) <> 4 THEN 'lines'
    WHEN NOT regexp_matches(ls[1], '\A@[!-~]') OR length(regexp_replace(ls[1], '[^"]', '', 'g')) % 2 = 1
      OR (starts_with(ls[1], '@bc=') AND NOT regexp_full_match(ls[1], '{error_parse.CONSENSUS_HEADER}')) THEN 'header'
    WHEN NOT regexp_full_match(ls[2], '{error_parse.SEQUENCE}') THEN 'sequence'
    WHEN NOT starts_with(ls[3], '+') THEN 'separator'
    WHEN NOT regexp_full_match(ls[4], '{error_parse.QUALITY}') THEN 'quality'
    WHEN length(ls[2]) <> length(ls[4]) THEN 'length' END AS reason FROM ({_LINES})"""


@query("p3_found", f"SELECT raw_id, reason FROM ({_CHECKED}) WHERE reason IS NOT NULL")
def p3_found(spark, sf):
    parsed = error_parse.parse_records(table(spark, sf, "raw_fastq"))
    return error_parse.rejected(parsed).select("raw_id", "reason")


@query(
    "p3_loaded",
    f"""SELECT raw_id, file_idx, ls[1] AS header, ls[2] AS seq, ls[3] AS plus, ls[4] AS qual,
    CASE WHEN starts_with(ls[1], '@bc=') THEN regexp_extract(ls[1], '^@bc=([^;]*)', 1) END AS bc,
    CASE WHEN starts_with(ls[1], '@bc=') THEN TRY_CAST(regexp_extract(ls[1], ';bcid=([^;]*)', 1) AS BIGINT) END AS bcid,
    CASE WHEN starts_with(ls[1], '@bc=') THEN TRY_CAST(regexp_extract(ls[1], ';count=([^;]*)', 1) AS BIGINT) END AS "count",
    CASE WHEN starts_with(ls[1], '@bc=') THEN TRY_CAST(regexp_extract(ls[1], ';min_q=([^;]*)', 1) AS BIGINT) END AS min_q,
    CASE WHEN starts_with(ls[1], '@bc=') THEN TRY_CAST(regexp_extract(ls[1], ';mean_q=([^;]*)', 1) AS BIGINT) END AS mean_q,
    CASE WHEN starts_with(ls[1], '@bc=') THEN TRY_CAST(regexp_extract(ls[1], ';minor_frac_mean=([^;]*)', 1) AS DOUBLE) END AS minor_frac_mean,
    CASE WHEN starts_with(ls[1], '@bc=') THEN TRY_CAST(regexp_extract(ls[1], ';minor_frac_max=([^;]*)', 1) AS DOUBLE) END AS minor_frac_max
    FROM ({_CHECKED}) WHERE reason IS NULL""",
)
def p3_loaded(spark, sf):
    return error_parse.loaded(error_parse.parse_records(table(spark, sf, "raw_fastq")))


@query("p3_edits")
def p3_edits(spark, sf):
    return error_parse.rejected(error_parse.parse_records(table(spark, sf, "raw_fastq")))


# ---- barcode extraction, clustering and consensus over the reads table ----

HOW = Settings(extraction=Extraction(start=0, length=20))
EXACT = Settings(extraction=Extraction(start=0, length=20, max_indels=0), max_mismatches=0, align=False)
ONE_EDIT = Settings(extraction=Extraction(start=0, length=20, max_indels=1), max_mismatches=1)
CONTEXT = Settings(extraction=Extraction(context=Context.parse("GATCCGTTANNNNNNTGGAC"), max_indels=1))

_FIXED = "CASE WHEN length(seq) >= 20 THEN upper(substr(seq, 1, 20)) END"
_FOUND = f"""SELECT *, CASE WHEN n_unknown IS NULL OR n_unknown > 2 THEN 'failed' WHEN n_unknown > 0 THEN 'unknown' ELSE 'ok' END AS status
    FROM (SELECT *, CASE WHEN regexp_full_match(barcode, '[ACGTN]*') THEN CAST(length(barcode) - length(replace(barcode, 'N', '')) AS INT) END AS n_unknown
    FROM (SELECT *, {_FIXED} AS barcode FROM reads))"""
_COUNTS = f"SELECT barcode, count(*) AS n FROM ({_FOUND}) WHERE status = 'ok' GROUP BY barcode"
_EXACT_IDS = f"SELECT barcode, n, row_number() OVER (ORDER BY n DESC, barcode) AS bcid FROM ({_COUNTS})"
_WITH_N = f"""SELECT u.barcode, arg_min(e.bcid, [-e.n, (position(substr(e.barcode, u.p, 1) IN 'ACGT') - 1)
    + CASE WHEN u.q > u.p THEN 4 * (position(substr(e.barcode, u.q, 1) IN 'ACGT') - 1) ELSE 0 END]) AS bcid
    FROM (SELECT DISTINCT barcode, position('N' IN barcode) AS p, length(barcode) - position('N' IN reverse(barcode)) + 1 AS q
    FROM ({_FOUND}) WHERE status = 'unknown') u
    JOIN ({_EXACT_IDS}) e ON regexp_full_match(e.barcode, replace(u.barcode, 'N', '.')) GROUP BY u.barcode"""
_ASSIGNED = f"""SELECT f.*, k.bcid FROM ({_FOUND}) f LEFT JOIN (SELECT barcode, bcid FROM ({_EXACT_IDS}) UNION ALL ({_WITH_N})) k
    ON k.barcode = f.barcode AND f.status <> 'failed'"""


def _found(spark, sf, how=HOW):
    return barcodes.extracted(spread(table(spark, sf, "reads")), how)


def _exact(spark, sf):
    return pipeline.run(table(spark, sf, "reads"), EXACT)


@query("scan_reads", "SELECT file_idx, count(*) AS n_reads, count(seq) AS n_seq, CAST(sum(length(seq)) AS BIGINT) AS n_bases FROM reads GROUP BY file_idx")
def scan_reads(spark, sf):
    return table(spark, sf, "reads").groupBy("file_idx").agg(
        F.count(F.lit(1)).alias("n_reads"), F.count("seq").alias("n_seq"), F.sum(F.length("seq")).alias("n_bases")
    )


def _as_files(spark, sf, reverse=False):
    """The reads as one FASTQ file for each file_idx, every third one gzipped, in the shared folder: (paths, file_idx)."""
    reads = table(spark, sf, "reads").where("file_idx is not null")
    if reverse:
        reads = reads.withColumns({"header": F.concat("header", F.lit("/2")), "seq": F.reverse("seq"), "qual": F.reverse("qual")})
    scratch = Scratch(spark)
    made = {}
    for zipped in (False, True):
        some = reads.where((F.col("file_idx") % 3 == 0) == zipped).repartition("file_idx").sortWithinPartitions("file_idx", "read_idx")
        lines = some.select(F.col("file_idx").alias("number"), fastq.record().alias("value"))
        paths = fastq.write_pieces(lines, f"{scratch.root}/{'zipped' if zipped else 'plain'}", lambda n: f"{n}.fastq", zipped)
        made |= {int(p.rsplit("/", 1)[1].removesuffix(".fastq")): p for p in paths}
    return [made[k] for k in sorted(made)], sorted(made)


def _of_files(df, numbers):
    return df.withColumn("file_idx", F.get(F.array(*map(F.lit, numbers)), F.col("file_idx")).cast("int"))


_STORED = """SELECT file_idx, row_number() OVER (PARTITION BY file_idx ORDER BY read_idx) - 1 AS read_idx, coalesce(header, '') AS header,
    coalesce(seq, '') AS seq, coalesce(plus, '+') AS plus, coalesce(qual, '') AS qual FROM reads WHERE file_idx IS NOT NULL"""


@query("scan_fastq", _STORED)
def scan_fastq(spark, sf):
    paths, numbers = _as_files(spark, sf)
    return _of_files(fastq.read_fastq(spark, paths, split_bytes=1 << 20), numbers)


@query("scan_fastq_source", "SELECT file_idx, count(*) AS n_reads, CAST(sum(length(seq)) AS BIGINT) AS n_bases FROM reads WHERE file_idx IS NOT NULL GROUP BY file_idx")
def scan_fastq_source(spark, sf):
    paths, numbers = _as_files(spark, sf)
    spark.dataSource.register(fastq.FastqSource)
    made = _of_files(spark.read.format("fastq").option("paths", ",".join(paths)).load(), numbers)
    return made.groupBy("file_idx").agg(F.count(F.lit(1)).alias("n_reads"), F.sum(F.length("seq")).alias("n_bases"))


@query(
    "scan_pairs",
    f"""SELECT file_idx, read_idx, header, seq, qual, header || '/2' AS header2, reverse(seq) AS seq2, reverse(qual) AS qual2 FROM ({_STORED})""",
)
def scan_pairs(spark, sf):
    (first, numbers), (second, _) = _as_files(spark, sf), _as_files(spark, sf, reverse=True)
    return _of_files(fastq.read_pairs(spark, first, second), numbers).select("file_idx", "read_idx", "header", "seq", "qual", "header2", "seq2", "qual2")


@query("extract_fixed", f"SELECT read_idx, barcode, n_unknown, status FROM ({_FOUND})")
def extract_fixed(spark, sf):
    return _found(spark, sf).select("read_idx", "barcode", "n_unknown", "status")


def _sql_hit(low: str, last: str, pattern: str) -> str:
    n = len(pattern)
    return f"""list_min(list_filter(list_transform(range({low}, {last} + 1), lambda p: {{'m': list_sum(list_transform(range(1, {n + 1}),
    lambda i: CAST(substr(s, p + i, 1) <> substr('{pattern}', i, 1) AS INT))), 'p': p}}), lambda x: x.m <= 1)).p"""


@query(
    "extract_context",
    f"""SELECT read_idx, CASE WHEN hit - b >= 1 AND abs(hit - b - 6) <= 1 THEN substr(s, CAST(b AS INT) + 1, CAST(hit - b AS INT)) END AS barcode
    FROM (SELECT *, {_sql_hit('greatest(b + 5, b)', 'least(b + 12, length(s)) - 5', 'TGGAC')} AS hit FROM
    (SELECT read_idx, s, {_sql_hit('0', 'length(s) - 9', 'GATCCGTTA')} + 9 AS b FROM (SELECT read_idx, upper(seq) AS s FROM reads)))""",
)
def extract_context(spark, sf):
    return _found(spark, sf, CONTEXT).select("read_idx", "barcode")


START = Settings(extraction=Extraction(context=Context.parse("^ACGNNNNNNNNNNNN"), max_indels=0))
END = Settings(extraction=Extraction(context=Context.parse("GATCCGTTANNNNNNTGGAC$"), max_indels=1))
TO_END = Settings(extraction=Extraction(context=Context.parse("GATCCGTTANNNNNNNNNNN$"), max_indels=1))


@query(
    "extract_anchored_start",
    f"""SELECT read_idx, CASE WHEN {_sql_hit('0', 'least(length(s), 5) - 3', 'ACG')} = 0 AND length(s) >= 15 THEN substr(s, 4, 12) END AS barcode
    FROM (SELECT read_idx, upper(seq) AS s FROM reads)""",
)
def extract_anchored_start(spark, sf):
    return _found(spark, sf, START).select("read_idx", "barcode")


@query("extract_anchored_end", ORACLE["extract_context"].replace("abs(hit - b - 6) <= 1", "abs(hit - b - 6) <= 1 AND hit + 5 = length(s)"))
def extract_anchored_end(spark, sf):
    return _found(spark, sf, END).select("read_idx", "barcode")


@query(
    "extract_to_end",
    f"""SELECT read_idx, CASE WHEN abs(length(s) - b - 11) <= 1 THEN substr(s, CAST(b AS INT) + 1) END AS barcode FROM
    (SELECT read_idx, s, {_sql_hit('0', 'length(s) - 9', 'GATCCGTTA')} + 9 AS b FROM (SELECT read_idx, upper(seq) AS s FROM reads))""",
)
def extract_to_end(spark, sf):
    return _found(spark, sf, TO_END).select("read_idx", "barcode")


@query("barcode_counts", _COUNTS)
def barcode_counts(spark, sf):
    return barcodes.barcode_counts(_found(spark, sf))


@query(
    "read_stats",
    f"""SELECT file_idx, count(*) AS n_reads, count(*) FILTER (status = 'failed') AS n_failed, count(*) FILTER (status = 'unknown') AS n_with_unknown,
    count(*) FILTER (status = 'ok') AS n_ok, count(bcid) AS n_assigned FROM ({_ASSIGNED}) GROUP BY file_idx""",
)
def read_stats(spark, sf):
    return _exact(spark, sf).stats()


@query(
    "edges_substitution",
    f"""WITH c AS MATERIALIZED (SELECT barcode FROM ({_COUNTS})) SELECT x.barcode AS a, y.barcode AS b FROM c x JOIN c y ON x.barcode <> y.barcode
    AND length(x.barcode) = length(y.barcode) AND hamming(x.barcode, y.barcode) <= 2""",
)
def edges_substitution(spark, sf):
    return barcodes.substitution_pairs(barcodes.barcode_counts(_found(spark, sf)), 2)


@query("edges_one_substitution", ORACLE["edges_substitution"].replace("<= 2", "<= 1"))
def edges_one_substitution(spark, sf):
    return barcodes.substitution_pairs(barcodes.barcode_counts(_found(spark, sf)), 1)


_DELETED = "SELECT DISTINCT barcode, substr(barcode, 1, CAST(i AS INT) - 1) || substr(barcode, CAST(i AS INT) + 1) AS s FROM (SELECT barcode, unnest(range(1, length(barcode) + 1)) AS i FROM c)"


@query(
    "edges_fixed_indel",
    f"""WITH c AS MATERIALIZED (SELECT barcode FROM ({_COUNTS})), d AS ({_DELETED}),
    h AS (SELECT c.barcode AS a, d.barcode AS b FROM c JOIN d ON substr(c.barcode, 1, length(c.barcode) - 1) = d.s AND c.barcode <> d.barcode)
    SELECT a, b FROM h UNION SELECT b, a FROM h""",
)
def edges_fixed_indel(spark, sf):
    return barcodes.indel_pairs(barcodes.barcode_counts(_found(spark, sf)), 1, fixed=True)


_CONTEXT_COUNTS = f"""SELECT DISTINCT barcode FROM ({ORACLE['extract_context']}) WHERE regexp_full_match(barcode, '[ACGT]+')"""


@query(
    "edges_context_indel",
    f"""WITH c AS MATERIALIZED ({_CONTEXT_COUNTS}), d AS ({_DELETED}), h AS (SELECT c.barcode AS a, d.barcode AS b FROM c JOIN d ON c.barcode = d.s)
    SELECT a, b FROM h UNION SELECT b, a FROM h""",
)
def edges_context_indel(spark, sf):
    return barcodes.indel_pairs(barcodes.barcode_counts(_found(spark, sf, CONTEXT)), 1, fixed=False)


# two deletions are one after the other; with one or two of them, both kinds of pairs come out
_DELETED_TWICE = f"""d AS ({_DELETED}), d2 AS (SELECT DISTINCT barcode, substr(s, 1, CAST(i AS INT) - 1) || substr(s, CAST(i AS INT) + 1) AS s
    FROM (SELECT barcode, s, unnest(range(1, length(s) + 1)) AS i FROM d))"""


@query(
    "edges_fixed_two_indels",
    f"""WITH c AS MATERIALIZED (SELECT barcode FROM ({_COUNTS})), {_DELETED_TWICE},
    h AS (SELECT c.barcode AS a, d.barcode AS b FROM c JOIN d ON substr(c.barcode, 1, length(c.barcode) - 1) = d.s AND c.barcode <> d.barcode
      UNION SELECT c.barcode, d2.barcode FROM c JOIN d2 ON substr(c.barcode, 1, length(c.barcode) - 2) = d2.s AND c.barcode <> d2.barcode)
    SELECT a, b FROM h UNION SELECT b, a FROM h""",
)
def edges_fixed_two_indels(spark, sf):
    return barcodes.indel_pairs(barcodes.barcode_counts(_found(spark, sf)), 2, fixed=True)


@query(
    "edges_context_two_indels",
    f"""WITH c AS MATERIALIZED ({_CONTEXT_COUNTS}), {_DELETED_TWICE},
    h AS (SELECT c.barcode AS a, d.barcode AS b FROM c JOIN d ON c.barcode = d.s UNION SELECT c.barcode, d2.barcode FROM c JOIN d2 ON c.barcode = d2.s)
    SELECT a, b FROM h UNION SELECT b, a FROM h""",
)
def edges_context_two_indels(spark, sf):
    return barcodes.indel_pairs(barcodes.barcode_counts(_found(spark, sf, CONTEXT)), 2, fixed=False)


# the sequential rule: the first barcode left (by falling count, length, text) takes its neighbours among those left
_CLUSTERS = f"""(WITH RECURSIVE c AS MATERIALIZED ({_COUNTS}), d AS ({_DELETED}),
    h AS (SELECT c.barcode AS a, d.barcode AS b FROM c JOIN d ON substr(c.barcode, 1, length(c.barcode) - 1) = d.s AND c.barcode <> d.barcode),
    k AS MATERIALIZED (SELECT barcode, n, row_number() OVER (ORDER BY n DESC, length(barcode), barcode) AS r FROM c),
    e AS (SELECT x.barcode AS a, y.barcode AS b FROM c x JOIN c y ON x.barcode <> y.barcode AND length(x.barcode) = length(y.barcode)
      AND hamming(x.barcode, y.barcode) <= 2 UNION SELECT a, b FROM h UNION SELECT b, a FROM h),
    near AS MATERIALIZED (SELECT x.r, list(y.r) AS l FROM e JOIN k x ON x.barcode = e.a JOIN k y ON y.barcode = e.b WHERE x.r < y.r GROUP BY x.r),
    g(centre, got, rest) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), (SELECT list(r ORDER BY r) FROM k)
      UNION ALL SELECT rest[1], list_prepend(rest[1], CASE WHEN l IS NULL THEN [] ELSE list_intersect(l, rest) END),
      CASE WHEN l IS NULL THEN rest[2:] ELSE list_filter(rest[2:], lambda x: NOT list_contains(l, x)) END
      FROM g LEFT JOIN near ON near.r = rest[1] WHERE len(rest) > 0),
    m AS (SELECT centre, unnest(got) AS r FROM g WHERE centre > 0),
    ids AS (SELECT k.r AS centre, k.barcode AS centroid, row_number() OVER (ORDER BY k.n DESC, k.barcode) AS bcid FROM k JOIN m ON m.centre = k.r AND m.r = k.r)
    SELECT k.barcode, centroid, bcid, k.n FROM m JOIN k USING (r) JOIN ids USING (centre))"""


def clustered(sql: str) -> str:
    """The SQL of a query over exact barcodes, over clusters."""
    return sql.replace(_EXACT_IDS, f"SELECT barcode, n, bcid FROM {_CLUSTERS}")


#: Clusters within two substitutions or one indel, their reads summed up without alignment.
GROUPED = Settings(extraction=Extraction(start=0, length=20), align=False)


def _grouped(spark, sf):
    return pipeline.run(table(spark, sf, "reads"), GROUPED)


@query("clusters", f"SELECT barcode, centroid, bcid FROM {_CLUSTERS}")
def clusters(spark, sf):
    return cluster.cluster(barcodes.barcode_counts(_found(spark, sf)), HOW)


@query("assign_to_clusters", clustered(f"SELECT read_idx, bcid FROM ({_ASSIGNED})"))
def assign_to_clusters(spark, sf):
    return _grouped(spark, sf).assigned.select("read_idx", "bcid")


@query("clusters_exact", f"SELECT barcode, barcode AS centroid, bcid FROM ({_EXACT_IDS})")
def clusters_exact(spark, sf):
    return _exact(spark, sf).assignments


@query("resolve_unknown", _WITH_N)
def resolve_unknown(spark, sf):
    r = _exact(spark, sf)
    return barcodes.resolve_unknown(r.found, r.counts, r.assignments)


@query("assign_reads", f"SELECT read_idx, bcid FROM ({_ASSIGNED})")
def assign_reads(spark, sf):
    return _exact(spark, sf).assigned.select("read_idx", "bcid")


@query("failed_reads", f"SELECT read_idx, header, seq, plus, qual FROM ({_ASSIGNED}) WHERE bcid IS NULL")
def failed_reads(spark, sf):
    return _exact(spark, sf).assigned.where("bcid is null").select("read_idx", "header", "seq", "plus", "qual")


_WEIGHT = f"CASE WHEN k < 33 THEN 0 WHEN k > 73 THEN 42 ELSE {list(WEIGHTS)}[k - 32] END"
_BASES = f"""SELECT bcid, i AS pos, substr(seq, i + 1, 1) AS base, CASE WHEN i < coalesce(length(qual), 0) THEN ord(substr(qual, i + 1, 1)) ELSE 0 END AS k
    FROM (SELECT bcid, seq, qual, CAST(unnest(range(0, length(seq))) AS INT) AS i FROM ({_ASSIGNED}) WHERE bcid IS NOT NULL)"""
_PILES = f"""SELECT bcid, pos, {', '.join(f"CAST(sum(CASE WHEN base = '{c.upper()}' THEN w ELSE 0 END) AS BIGINT) AS {c}" for c in 'acgt')}, CAST(0 AS BIGINT) AS gap
    FROM (SELECT *, {_WEIGHT} AS w FROM ({_BASES})) GROUP BY bcid, pos"""


@query("pileup", _PILES)
def piled(spark, sf):
    return pileup.pileup(_exact(spark, sf).assigned)


_LOGS = f"list_transform([a, c, g, t, gap], lambda x: x * ({LOG_RIGHT}) + (a + c + g + t + gap - x) * ({LOG_WRONG}))"
_CALLS = f"""SELECT *, CASE WHEN blank THEN 0 ELSE CAST(least(40, greatest(0, floor(10 * (list_max(lp) + log10(list_sum(list_transform(lp, lambda v: pow(10.0, v - list_max(lp))))))
      - 10 * (list_max(lo) + log10(list_sum(list_transform(lo, lambda v: pow(10.0, v - list_max(lo)))))) + 0.5))) AS INT) END AS q FROM (
    SELECT *, list_concat(lp[1:place - 1], lp[place + 1:]) AS lo, ng = 0 OR top_count > 1 AS blank FROM (
    SELECT p.*, {_LOGS} AS lp, greatest(a, c, g, t) AS top, list_position([a, c, g, t], greatest(a, c, g, t)) AS place, a + c + g + t AS ng,
      len(list_filter([a, c, g, t], lambda x: x = greatest(a, c, g, t))) AS top_count, list_sort([a, c, g, t])[3] AS second
    FROM (SELECT *, max(CASE WHEN a + c + g + t + gap > half THEN pos END) OVER (PARTITION BY bcid) AS last FROM
      (SELECT *, sum(a + c + g + t + gap) OVER (PARTITION BY bcid) / count(*) OVER (PARTITION BY bcid) / 2 AS half FROM ({_PILES}))) p WHERE pos <= last))"""
_CALLED = f"""SELECT bcid, pos, CASE WHEN blank OR q < 4 THEN 'N' ELSE substr('ACGT', place, 1) END AS base, q,
    CASE WHEN ng > 0 THEN second / ng END AS minor, CASE WHEN blank THEN 0 ELSE ng END AS calls, CASE WHEN blank THEN 0 ELSE ng - top END AS missense FROM ({_CALLS})"""


@query("base_calls", f"SELECT bcid, pos, base, q, round(minor, 6) AS minor, calls, missense FROM ({_CALLED})")
def base_calls(spark, sf):
    made = pileup.called(pileup.pileup(_exact(spark, sf).assigned))
    return made.select("bcid", "pos", "base", "q", F.round("minor", 6).alias("minor"), "calls", "missense")


_CONSENSUS = f"""SELECT s.bcid, s.count, CASE WHEN s.count = 1 THEN s.seq ELSE coalesce(m.seq, '') END AS seq, CASE WHEN s.count = 1 THEN coalesce(s.qual, '') ELSE coalesce(m.qual, '') END AS qual,
    CASE WHEN s.count = 1 THEN 0.0 ELSE coalesce(minor_max, 0.0) END AS minor_max, CASE WHEN s.count = 1 THEN 0.0 ELSE coalesce(minor_mean, 0.0) END AS minor_mean,
    CASE WHEN s.count = 1 THEN 0 ELSE coalesce(calls, 0) END AS calls, CASE WHEN s.count = 1 THEN 0 ELSE coalesce(missense, 0) END AS missense
    FROM (SELECT bcid, count(*) AS "count", any_value(seq) AS seq, any_value(qual) AS qual FROM ({_ASSIGNED}) WHERE bcid IS NOT NULL AND length(seq) > 0 GROUP BY bcid) s
    LEFT JOIN (SELECT bcid, string_agg(base, '' ORDER BY pos) AS seq, string_agg(chr(q + 33), '' ORDER BY pos) AS qual, coalesce(max(minor), 0.0) AS minor_max,
    coalesce(avg(minor), 0.0) AS minor_mean, sum(calls) AS calls, sum(missense) AS missense FROM ({_CALLED}) GROUP BY bcid) m ON m.bcid = s.bcid"""
_Q = "list_transform(string_split(qual, ''), lambda x: greatest(ord(x) - 33, 0))"
_RECORDS = f"""SELECT *, CASE WHEN length(seq) >= 20 THEN substr(seq, 1, 20) END AS bc, CAST(CASE WHEN qual = '' THEN 0 ELSE list_min({_Q}) END AS INT) AS min_q,
    CAST(CASE WHEN qual = '' THEN 0 ELSE list_sum({_Q}) // length(qual) END AS INT) AS mean_q FROM ({_CONSENSUS})"""


@query(
    "consensus_unaligned",
    f"""SELECT bc, bcid, "count", min_q, mean_q, round(minor_mean, 6) AS minor_frac_mean, round(minor_max, 6) AS minor_frac_max, seq, qual FROM ({_RECORDS}) WHERE bc IS NOT NULL""",
)
def consensus_unaligned(spark, sf):
    made = _exact(spark, sf).passed()
    return made.select(
        "bc", "bcid", "count", "min_q", "mean_q", F.round("minor_frac_mean", 6).alias("minor_frac_mean"), F.round("minor_frac_max", 6).alias("minor_frac_max"), "seq", "qual"
    )


@query("consensus_of_clusters", clustered(ORACLE["consensus_unaligned"]))
def consensus_of_clusters(spark, sf):
    made = _grouped(spark, sf).passed()
    return made.select(
        "bc", "bcid", "count", "min_q", "mean_q", F.round("minor_frac_mean", 6).alias("minor_frac_mean"), F.round("minor_frac_max", 6).alias("minor_frac_max"), "seq", "qual"
    )


#: A barcode so far along the read that the consensus of some groups ends before it.
LATE = Settings(extraction=Extraction(start=100, length=20, max_indels=0), max_mismatches=0, align=False)


def _late(sql: str) -> str:
    for form in ("upper(substr(seq, {}, 20))", "substr(seq, {}, 20)"):
        sql = sql.replace("length(seq) >= 20 THEN " + form.format(1), "length(seq) >= 120 THEN " + form.format(101))
    return sql


@query("consensus_failed", _late(f'SELECT bcid, "count", seq, qual FROM ({_RECORDS}) WHERE bc IS NULL'))
def consensus_failed(spark, sf):
    return pipeline.run(table(spark, sf, "reads"), LATE).consensus.where("bc is null").select("bcid", "count", "seq", "qual")


@query("error_rates", f"SELECT CAST(sum(calls) AS BIGINT) AS calls, round(sum(missense) / sum(calls), 9) AS missense_rate, CAST(0 AS DOUBLE) AS indel_rate FROM ({_RECORDS})")
def error_rates(spark, sf):
    rates = _exact(spark, sf).rates()
    return rates.select("calls", F.round("missense_rate", 9).alias("missense_rate"), "indel_rate")


# aligning is a chain of folds, which SQL cannot say; tests compare it with a plain loop
@query("consensus_aligned")
def consensus_aligned(spark, sf):
    return pipeline.run(table(spark, sf, "reads"), HOW).passed().drop("calls", "missense", "indels")


_LINES_OF = """SELECT concat_ws(chr(10), printf('@bc=%s;bcid=%d;count=%d;min_q=%d;mean_q=%d;minor_frac_mean=%.3f;minor_frac_max=%.3f',
    bc, bcid, "count", min_q, mean_q, CAST(minor_mean AS DOUBLE), CAST(minor_max AS DOUBLE)), seq, '+', qual) AS value FROM ({}) WHERE bc IS NOT NULL"""


@query("consensus_fastq", clustered(_LINES_OF.format(_RECORDS)))
def consensus_fastq(spark, sf):
    return _grouped(spark, sf).fastq_lines()


@query("aligned_fastq")
def aligned_fastq(spark, sf):
    return pipeline.run(table(spark, sf, "reads"), HOW).fastq_lines()


@query(
    "failed_fastq",
    _late(f"""SELECT concat_ws(chr(10), coalesce(header, ''), coalesce(seq, ''), coalesce(plus, ''), coalesce(qual, '')) AS value FROM ({_ASSIGNED}) WHERE bcid IS NULL
    UNION ALL SELECT concat_ws(chr(10), printf('@bcid=%d;count=%d', bcid, "count"), seq, '+', qual) FROM ({_RECORDS}) WHERE bc IS NULL"""),
)
def failed_fastq(spark, sf):
    return pipeline.run(table(spark, sf, "reads"), LATE).failed_lines()


_SIZES = f"SELECT bcid, count(*) AS n_barcodes, CAST(sum(n) AS BIGINT) AS n_reads FROM {_CLUSTERS} GROUP BY bcid"


@query("cluster_sizes", _SIZES)
def cluster_sizes(spark, sf):
    r = _grouped(spark, sf)
    return evaluate.cluster_sizes(r.counts, r.assignments)


@query(
    "size_histogram",
    f"""SELECT least(n_barcodes, 13) AS n_barcodes, count(*) AS n_clusters, min(n_reads) AS least_reads, max(n_reads) AS most_reads,
    round(avg(n_reads), 6) AS mean_reads FROM ({_SIZES}) GROUP BY 1""",
)
def size_histogram(spark, sf):
    r = _grouped(spark, sf)
    out = evaluate.size_histogram(evaluate.cluster_sizes(r.counts, r.assignments))
    return out.withColumn("mean_reads", F.round("mean_reads", 6))


_TRUE = r"substr(regexp_extract(substr(header, position('barcode=' IN header) + 8), '\A([^ \t\r\n]*)', 1), 1, 64)"
_TRUTH = f"SELECT {_TRUE} AS true_bc, bcid FROM ({_ASSIGNED}) WHERE position('barcode=' IN header) > 0 AND {_TRUE} <> '' AND bcid IS NOT NULL"


@query("truth_tags", f"SELECT read_idx, CASE WHEN position('barcode=' IN header) > 0 AND {_TRUE} <> '' THEN {_TRUE} END AS true_bc FROM reads")
def truth_tags(spark, sf):
    return table(spark, sf, "reads").select("read_idx", true_barcode(F.col("header")).alias("true_bc"))


@query(
    "split_histogram",
    clustered(f"SELECT least(n, 6) AS n_clusters, count(*) AS n_barcodes FROM (SELECT true_bc, count(DISTINCT bcid) AS n FROM ({_TRUTH}) GROUP BY true_bc) GROUP BY 1"),
)
def split_histogram(spark, sf):
    return evaluate.split_histogram(evaluate.truth_pairs(_grouped(spark, sf).assigned))


@query(
    "merge_histogram",
    clustered(f"SELECT least(n, 6) AS n_barcodes, count(*) AS n_clusters FROM (SELECT bcid, count(DISTINCT true_bc) AS n FROM ({_TRUTH}) GROUP BY bcid) GROUP BY 1"),
)
def merge_histogram(spark, sf):
    return evaluate.merge_histogram(evaluate.truth_pairs(_grouped(spark, sf).assigned))


_PART = "SELECT '{}' AS section, CAST({} AS INT) AS bin, '{}' AS measure, round(CAST({} AS DOUBLE), 6) AS value FROM ({})"


@query(
    "evaluation_report",
    " UNION ALL ".join(
        _PART.format(section, key, measure, measure, sql)
        for section, key, measures, sql in (
            ("barcodes of a cluster", "n_barcodes", ("n_clusters", "least_reads", "most_reads", "mean_reads"), ORACLE["size_histogram"]),
            ("clusters of a true barcode", "n_clusters", ("n_barcodes",), ORACLE["split_histogram"]),
            ("true barcodes of a cluster", "n_barcodes", ("n_clusters",), ORACLE["merge_histogram"]),
            ("reads", "0", ("n_reads", "n_without_truth"), clustered(f"""SELECT count(*) AS n_reads, count(*) FILTER (position('barcode=' IN header) = 0 OR header IS NULL
                OR {_TRUE} = '') AS n_without_truth FROM ({_ASSIGNED}) WHERE bcid IS NOT NULL""")),
        )
        for measure in measures
    ),
)
def evaluation_report(spark, sf):
    r = _grouped(spark, sf)
    return evaluate.report(r.counts, r.assignments, r.assigned).withColumn("value", F.round("value", 6))


# groups here are small, so the report starts at two reads instead of a hundred
@query(
    "diameters",
    f"""WITH x AS MATERIALIZED (SELECT * FROM {_CLUSTERS}), big AS (SELECT bcid, centroid, CAST(sum(n) AS BIGINT) AS n_reads FROM x GROUP BY bcid, centroid
      HAVING sum(n) >= 2 ORDER BY n_reads DESC, bcid LIMIT 20),
    sampled AS (SELECT bcid, centroid, barcode FROM x JOIN big USING (bcid, centroid) WHERE barcode <> centroid QUALIFY row_number() OVER (PARTITION BY bcid ORDER BY barcode) <= 10),
    y AS (SELECT bcid, CAST(max(CASE WHEN length(barcode) = length(centroid) THEN hamming(barcode, centroid) END) AS INT) AS d,
      count(*) FILTER (length(barcode) <> length(centroid)) AS n_other_length, count(*) AS n_sampled FROM sampled GROUP BY bcid)
    SELECT bcid, centroid, n_reads, coalesce(d, 0) AS max_distance, coalesce(n_other_length, 0) AS n_other_length, coalesce(n_sampled, 0) AS n_sampled,
    coalesce(n_sampled, 0) > 0 AND coalesce(d, 0) >= 2 AS suspicious FROM big LEFT JOIN y USING (bcid)""",
)
def diameters(spark, sf):
    return _grouped(spark, sf).diameters(least=2)


@query(
    "split_files",
    """SELECT file_idx, read_idx, barcode, CAST(run AS BIGINT) AS run, CAST((run - 1) // 100 + 1 AS INT) AS file_no FROM (
    SELECT *, sum(CASE WHEN barcode IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY file_idx ORDER BY read_idx) AS run FROM (
    SELECT *, lag(barcode) OVER (PARTITION BY file_idx ORDER BY read_idx) AS before FROM (
    SELECT file_idx, read_idx, substr(seq, 1, 4) AS barcode FROM reads WHERE length(seq) >= 4)))""",
)
def split_files(spark, sf):
    return split.split_by_barcodes(table(spark, sf, "reads"), 0, 4, 100, chunk=1000).select("file_idx", "read_idx", "barcode", "run", "file_no")


@query(
    "same_records",
    """WITH m AS (SELECT DISTINCT coalesce(header, '') || ' changed' AS header, seq, plus, qual FROM reads WHERE header IS NULL OR position('barcode=' IN header) = 0)
    SELECT CAST(0 AS BIGINT) AS only_first, count(*) AS only_second, count(*) = 0 AS same FROM m""",
)
def same_records(spark, sf):
    """All reads against themselves and all reads once more, those without a tag under a header no read has."""
    r = table(spark, sf, "reads")
    marked = r.withColumn("header", F.when(F.coalesce(F.locate("barcode=", "header"), F.lit(0)) == 0, F.concat(F.coalesce("header", F.lit("")), F.lit(" changed"))).otherwise(F.col("header")))
    return evaluate.same_records(r, r.unionByName(marked))


@query(
    "mixed_groups",
    f"SELECT bcid, count(*) FILTER (minor >= 0.15) AS n_mixed, count(*) FILTER (minor >= 0.15) >= 3 AS mixed FROM ({_CALLED}) GROUP BY bcid",
)
def mixed_groups(spark, sf):
    return evaluate.mixed_groups(pileup.called(pileup.pileup(_exact(spark, sf).assigned)))


@query(
    "usable_consensus",
    f'SELECT bcid, "count", min_q FROM ({_RECORDS}) WHERE bc IS NOT NULL AND min_q > 30 AND "count" > 1',
)
def usable_consensus(spark, sf):
    return _exact(spark, sf).passed().where("min_q > 30 and count > 1").select("bcid", "count", "min_q")


@query(
    "tagged_ids",
    r"""SELECT read_idx, TRY_CAST(nullif(regexp_extract(h, '^[^;]*(?:;[^U;][^;]*)*;UBID=([0-9]+)', 1), '') AS BIGINT) AS ubid
    FROM (SELECT read_idx, header || ';UBID=' || read_idx AS h FROM reads)""",
)
def tagged_ids(spark, sf):
    tagged = F.concat("header", F.lit(";UBID="), F.col("read_idx").cast("string"))
    return table(spark, sf, "reads").select("read_idx", tag_id(tagged).alias("ubid"))


@query(
    "sorted_fastq",
    f"""SELECT concat_ws(chr(10), coalesce(header, '') || ';UBID=' || bcid, coalesce(seq, ''), coalesce(plus, ''), coalesce(qual, '')) AS value
    FROM ({_ASSIGNED}) WHERE bcid IS NOT NULL""",
)
def sorted_fastq(spark, sf):
    return consensus.sorted_lines(_exact(spark, sf).assigned)


@query("partial_barcodes", "SELECT read_idx, substr(seq, 101, 20) AS barcode FROM reads")
def partial_barcodes(spark, sf):
    return table(spark, sf, "reads").select("read_idx", partial_barcode(F.col("seq"), 100, 20).alias("barcode"))


_MATES = "SELECT file_idx, read_idx, header || '/2' AS header, reverse(seq) AS seq, reverse(qual) AS qual FROM reads"


def _pairs(spark, sf, first):
    """Reads joined with mates of their own, which are stored in another order."""
    mates = table(spark, sf, "reads").withColumns({"header": F.concat("header", F.lit("/2")), "seq": F.reverse("seq"), "qual": F.reverse("qual")})
    return evaluate.paired(first, mates.orderBy(F.desc("read_idx")))


@query(
    "paired_reads",
    f"""SELECT a.file_idx, a.read_idx, a.header, a.seq, b.header AS header2, b.seq AS seq2, b.qual AS qual2 FROM reads a
    JOIN ({_MATES}) b ON b.file_idx = a.file_idx AND b.read_idx = a.read_idx""",
)
def paired_reads(spark, sf):
    return _pairs(spark, sf, table(spark, sf, "reads")).select("file_idx", "read_idx", "header", "seq", "header2", "seq2", "qual2")


@query(
    "paired_consensus",
    f"""SELECT x.bcid, x.count, x.seq, x.qual, coalesce(y.seq, '') AS seq2, coalesce(y.qual, '') AS qual2 FROM ({_CONSENSUS}) x LEFT JOIN
    ({_CONSENSUS.replace(f'({_ASSIGNED})', f'(SELECT * REPLACE (reverse(seq) AS seq, reverse(qual) AS qual) FROM ({_ASSIGNED}))')}) y ON y.bcid = x.bcid""",
)
def paired_consensus(spark, sf):
    pairs = _pairs(spark, sf, _exact(spark, sf).assigned)
    return consensus.paired_consensus(pairs, EXACT).select("bcid", "count", "seq", "qual", "seq2", "qual2")


@query(
    "sorted_by_barcode",
    f"SELECT read_idx, barcode, row_number() OVER (ORDER BY barcode, file_idx, read_idx) AS place FROM ({_FOUND}) WHERE status <> 'failed'",
)
def sorted_by_barcode(spark, sf):
    return evaluate.placed(consensus.by_barcode(_found(spark, sf)).select("read_idx", "barcode"))


@query("unknown_bases", f"SELECT n_unknown, count(*) AS n_reads FROM ({_FOUND}) GROUP BY n_unknown")
def unknown_base_counts(spark, sf):
    return _found(spark, sf).groupBy("n_unknown").agg(F.count(F.lit(1)).alias("n_reads"))


@query(
    "quality_stats",
    f"SELECT read_idx, CAST(CASE WHEN qual = '' THEN 0 ELSE list_min({_Q}) END AS INT) AS min_q, CAST(CASE WHEN qual = '' THEN 0 ELSE list_sum({_Q}) // length(qual) END AS INT) AS mean_q FROM reads",
)
def quality(spark, sf):
    least, mean = quality_stats(F.col("qual"))
    return table(spark, sf, "reads").select("read_idx", least.alias("min_q"), mean.alias("mean_q"))
