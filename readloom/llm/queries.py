"""Named queries of the training-data operators and their SQL counterparts."""

from __future__ import annotations

from readloom.functions.text import label_sql, value_sql
from readloom.llm import components, encoding, heavy_hitters, leakage, mixture, near_dup, survivorship
from readloom.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


_LONG = f"""SELECT 'bc' AS field_name, {value_sql('bc')} AS item FROM assigned_reads UNION ALL
    SELECT 'seq', {value_sql('seq')} FROM assigned_reads"""


@query(
    "p4_found",
    f"""SELECT field_name, item FROM ({_LONG}) WHERE item IS NOT NULL GROUP BY 1, 2
    HAVING count(*) * 500 >= (SELECT count(*) FROM assigned_reads)""",
)
def p4_found(spark, sf):
    return heavy_hitters.frequent_reads(table(spark, sf, "assigned_reads")).select("field_name", "item")


@query(
    "p4_counts",
    f"""SELECT field_name, item, count(*) AS n_rows, true AS within_bounds FROM ({_LONG}) WHERE item IS NOT NULL GROUP BY 1, 2
    HAVING count(*) * 500 >= (SELECT count(*) FROM assigned_reads)""",
)
def p4_counts(spark, sf):
    return heavy_hitters.frequent_reads(table(spark, sf, "assigned_reads")).selectExpr(
        "field_name", "item", "n_rows", "n_rows between approx_count - max_error and approx_count as within_bounds"
    )


_BEST = f"""WITH c AS (SELECT *, {value_sql('bc')} AS b FROM consensus WHERE bc IS NOT NULL),
    g AS (SELECT b FROM c GROUP BY b HAVING count(*) >= 2),
    s AS (SELECT b, rec_id, seq, qual, row_number() OVER (PARTITION BY b ORDER BY length(regexp_replace(seq, '[^ACGTacgt]', '', 'g')) DESC,
      list_sum(list_transform(string_split(qual, ''), lambda x: ord(x))) DESC, made_at DESC NULLS LAST, rec_id DESC) AS k FROM c
      WHERE seq <> '' AND qual <> '' AND length(seq) = length(qual)),
    n AS (SELECT b, rec_id, n_reads, row_number() OVER (PARTITION BY b ORDER BY made_at DESC NULLS LAST, rec_id DESC) AS k FROM c WHERE n_reads > 0)"""


@query(
    "p5_found",
    f"""{_BEST} SELECT g.b AS bc, s.rec_id AS seq_rec_id, n.rec_id AS count_rec_id FROM g
    LEFT JOIN s ON s.b = g.b AND s.k = 1 LEFT JOIN n ON n.b = g.b AND n.k = 1""",
)
def p5_found(spark, sf):
    return survivorship.survivors(table(spark, sf, "consensus")).select("bc", "seq_rec_id", "count_rec_id")


@query(
    "p5_records",
    f"""{_BEST} SELECT g.b AS bc, s.seq, s.qual, CAST(n.n_reads AS BIGINT) AS n_reads FROM g
    LEFT JOIN s ON s.b = g.b AND s.k = 1 LEFT JOIN n ON n.b = g.b AND n.k = 1""",
)
def p5_records(spark, sf):
    return survivorship.survivors(table(spark, sf, "consensus"), texts=True).select("bc", "seq", "qual", "n_reads")


_LEARNED = {"min_q": "CASE WHEN min_q >= 0 THEN min_q END", "mean_q": "CASE WHEN mean_q >= 0 THEN mean_q END",
            "n_reads_inferred": "CASE WHEN n_reads > 0 THEN n_reads END"}
_VALUES = " UNION ALL ".join(f"SELECT '{f}' AS f, {value_sql('bc')} AS b, rec_id, made_at, CAST({v} AS BIGINT) AS v FROM consensus WHERE bc IS NOT NULL" for f, v in _LEARNED.items())


@query(
    "p5_currency",
    f"""WITH RECURSIVE x AS ({_VALUES}),
    seen AS (SELECT f, u, v, count(*) AS n FROM
      (SELECT f, lag(v) OVER (PARTITION BY f, b ORDER BY made_at, rec_id) AS u, v FROM x WHERE made_at IS NOT NULL) WHERE u <> v GROUP BY f, u, v),
    total AS (SELECT f, sum(n) AS t FROM seen GROUP BY f),
    rel AS (SELECT a.f, a.u, a.v FROM seen a JOIN total USING (f) LEFT JOIN seen r ON r.f = a.f AND r.u = a.v AND r.v = a.u
      WHERE a.n >= {survivorship.MIN_SUPPORT} AND a.n >= t * {survivorship.MIN_SHARE} AND a.n > coalesce(r.n, 0)
      AND (a.n - coalesce(r.n, 0)) ** 2 > {survivorship.DEVIATIONS ** 2} * (a.n + coalesce(r.n, 0))),
    reach AS (SELECT f, u, v FROM rel UNION SELECT r.f, r.u, s.v FROM reach r JOIN rel s ON s.f = r.f AND s.u = r.v),
    aft AS (SELECT f, u, v FROM reach WHERE u <> v EXCEPT SELECT f, v, u FROM reach),
    d AS (SELECT f, b, v FROM x WHERE made_at IS NOT NULL AND v IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY f, b ORDER BY made_at DESC, rec_id DESC) = 1),
    un AS (SELECT f, b, v, max(rec_id) AS rec FROM x WHERE made_at IS NULL AND v IS NOT NULL GROUP BY f, b, v),
    pool AS (SELECT un.* FROM un LEFT JOIN d USING (f, b) WHERE d.v IS NULL OR EXISTS (SELECT 1 FROM aft WHERE aft.f = un.f AND aft.u = d.v AND aft.v = un.v)),
    won AS (SELECT f, b, v FROM pool p WHERE NOT EXISTS (SELECT 1 FROM pool q JOIN aft ON aft.f = q.f AND aft.v = q.v WHERE q.f = p.f AND q.b = p.b AND aft.u = p.v)
      QUALIFY row_number() OVER (PARTITION BY f, b ORDER BY rec DESC) = 1),
    y AS (SELECT f, b, coalesce(won.v, d.v) AS v FROM won FULL JOIN d USING (f, b))
    SELECT b AS bc, count(*) AS n_rows, {', '.join(f"(SELECT v FROM y WHERE y.f = '{f}' AND y.b = c.b) AS {f}" for f in _LEARNED)}
    FROM (SELECT {value_sql('bc')} AS b FROM consensus WHERE bc IS NOT NULL) c GROUP BY b HAVING count(*) >= 2""",
)
def p5_currency(spark, sf):
    return survivorship.survivors(table(spark, sf, "consensus"), survivorship.CURRENT).select("bc", "n_rows", *survivorship.CURRENT)


@query(
    "p6_found",
    f"""WITH RECURSIVE e AS (SELECT {value_sql('barcode')} AS bc, min(uf_idx) AS id FROM barcode_counts WHERE barcode IS NOT NULL GROUP BY 1),
    l AS (SELECT a.id AS x, b.id AS y FROM edges JOIN e a ON a.bc = {value_sql('src')} JOIN e b ON b.bc = {value_sql('dst')} WHERE a.id <> b.id),
    k AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
    r(id, seen) AS (SELECT DISTINCT x, x FROM k UNION SELECT r.id, k.y FROM r JOIN k ON k.x = r.seen)
    SELECT min(seen) AS group_uf_idx, id AS uf_idx FROM r GROUP BY id""",
)
def p6_found(spark, sf):
    return components.linked_entries(table(spark, sf, "barcode_counts"), table(spark, sf, "edges"))


def _mixture(spark, sf, balanced=True):
    return mixture.Mixture(table(spark, sf, "documents"), table(spark, sf, "source_targets"), balanced=balanced)


# SQL cannot tokenize; the cases don't hang on the tokenizer, so it measures texts by their bytes
@query(
    "p8_found",
    f"""WITH d AS (SELECT {label_sql('source')} AS source, sum(strlen(text)) AS n FROM documents GROUP BY 1),
    t AS (SELECT {label_sql('source')} AS source, target_share, max_repeats FROM source_targets)
    SELECT source FROM t LEFT JOIN d USING (source) WHERE coalesce(n, 0) * max_repeats <
    target_share * (SELECT sum(n) FROM d JOIN t USING (source))""",
)
def p8_found(spark, sf):
    return _mixture(spark, sf, balanced=False).unreachable()


@query("p8_mixture")
def p8_mixture(spark, sf):
    return _mixture(spark, sf).documents()


@query("p8_shares")
def p8_shares(spark, sf):
    return _mixture(spark, sf).shares()


# what a mixture must hold, whatever the tokenizer: caps are kept, and no source misses its quota by a whole document
@query(
    "p8_checks",
    f"""WITH d AS (SELECT {label_sql('source')} AS source, sum(strlen(text)) AS n FROM documents GROUP BY 1),
    t AS (SELECT {label_sql('source')} AS source, target_share, max_repeats FROM source_targets)
    SELECT source, target_share, max_repeats, true AS within_repeats, true AS within_a_document, coalesce(n, 0) * max_repeats >=
    target_share * (SELECT sum(n) FROM d JOIN t USING (source)) AS reachable FROM t LEFT JOIN d USING (source)""",
)
def p8_checks(spark, sf):
    return _mixture(spark, sf).shares().selectExpr(
        "source", "target_share", "max_repeats", "most_repeats <= max_repeats as within_repeats", "abs(missed) <= longest as within_a_document", "reachable"
    )


_SPOKEN = r"""regexp_replace(regexp_replace(regexp_replace(text, '(?m)^(?:[0-9]+\r?\n)?[^\n]*-->[^\n]*(?:\n|\z)', '', 'g'),
    '<[^>]*>', ' ', 'g'), '\{[^}]*\}', ' ', 'g')"""
_PASSAGES = r"""SELECT DISTINCT id, array_to_string(w[i:i+7], ' ') AS passage FROM (SELECT id, w, unnest(range(1, len(w) - 6)) AS i FROM
    (SELECT {id} AS id, list_filter(string_split_regex(lower({text}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM {table}))"""
_LEAKS = f"""WITH d AS ({_PASSAGES.format(id='doc_id', text=_SPOKEN, table='documents')}),
    e AS ({_PASSAGES.format(id='item_id', text='text', table='eval_items')})"""


@query("p7_found", f"{_LEAKS} SELECT DISTINCT d.id AS doc_id, e.id AS item_id FROM d JOIN e USING (passage)")
def p7_found(spark, sf):
    return leakage.leaked_items(table(spark, sf, "documents"), table(spark, sf, "eval_items")).select("doc_id", "item_id")


@query(
    "p7_containment",
    f"""{_LEAKS}, n AS (SELECT id, count(*) AS item_passages FROM e GROUP BY id)
    SELECT d.id AS doc_id, e.id AS item_id, count(*) AS n_passages, any_value(item_passages) AS item_passages,
    count(*) / any_value(item_passages) AS containment FROM d JOIN e USING (passage) JOIN n ON n.id = e.id GROUP BY 1, 2""",
)
def p7_containment(spark, sf):
    return leakage.leaked_items(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


_FIVES = _PASSAGES.replace("i:i+7", "i:i+4").replace("len(w) - 6", "len(w) - 3")


@query(
    "p7_whole",
    f"""WITH d AS ({_FIVES.format(id='doc_id', text=_SPOKEN, table='documents')}), e AS ({_FIVES.format(id='item_id', text='text', table='eval_items')}),
    n AS (SELECT id, count(*) AS item_shingles FROM e GROUP BY id)
    SELECT d.id AS doc_id, e.id AS item_id, count(*) AS n_shared, any_value(item_shingles) AS item_shingles,
    count(*) / any_value(item_shingles) AS containment FROM d JOIN e USING (passage) JOIN n ON n.id = e.id GROUP BY 1, 2
    HAVING count(*) >= 0.8 * any_value(item_shingles)""",
)
def p7_whole(spark, sf):
    return leakage.contained_items(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


# the search finds almost all pairs, so an exact SQL twin would differ by the odd pair at the threshold;
# tests measure recall and precision against comparing all pairs
@query("p2_found")
def p2_found(spark, sf):
    return near_dup.NearDuplicates(table(spark, sf, "reads")).row_pairs()


@query(
    "p2_copies",
    """SELECT read_idx, min(read_idx) OVER (PARTITION BY upper(seq)) AS class_id FROM reads
    WHERE length(seq) >= 12 QUALIFY count(*) OVER (PARTITION BY upper(seq)) > 1""",
)
def p2_copies(spark, sf):
    return near_dup.NearDuplicates(table(spark, sf, "reads")).members().selectExpr("read_idx", "id as class_id")


@query("p2_groups")
def p2_groups(spark, sf):
    return near_dup.NearDuplicates(table(spark, sf, "reads")).groups()


@query("p9_found")
def p9_found(spark, sf):
    return encoding.misread_documents(table(spark, sf, "documents")).select("doc_id")


@query("p9_restored")
def p9_restored(spark, sf):
    return encoding.misread_documents(table(spark, sf, "documents"))
