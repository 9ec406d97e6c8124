"""One surviving record for each group of duplicate records, field by field."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions.text import value_of
from readloom.session import Scratch

#: A relation between two values is kept if it was seen this often,
MIN_SUPPORT = 3
#: made up this share of all changes of its field, so at most 1/MIN_SHARE relations a field leave the executors,
MIN_SHARE = 1e-4
#: and outweighs its reverse by so many standard deviations of an even coin.
DEVIATIONS = 3


@dataclass(frozen=True)
class Field:
    """A field whose current value is wanted: its name, the values that count, and whether undated rows
    take part by learned precedence or are older than every dated row."""

    name: str
    least: int = 0
    learned: bool = True

    def value(self) -> Column:
        c = F.col(self.name).cast("long")
        return F.when(c >= self.least, c)


COUNT = Field("n_reads", least=1, learned=False)
#: name of the result, field
CURRENT = {"min_q": Field("min_q"), "mean_q": Field("mean_q"), "n_reads_inferred": Field("n_reads", least=1)}


def _count_transitions(fields: tuple[str, ...]):
    """Over rows sorted by (bc, t, rec_id): how often each value followed another, and the partition's end rows."""
    names = ["field", "old", "new", "n", "part", "bc", "t", "rec_id"]

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        counts: dict[str, list[np.ndarray]] = {f: [] for f in fields}
        first = last = None
        for b in batches:
            if not len(b):
                continue
            bc = b.column("bc").dictionary_encode()
            key = bc.indices.to_numpy()
            joined = last is not None and last["bc"] == b.column("bc")[0].as_py()
            for f in fields:
                v = b.column(f).fill_null(-1).to_numpy()
                use = (key[1:] == key[:-1]) & (v[1:] >= 0) & (v[:-1] >= 0) & (v[1:] != v[:-1])
                got = np.stack([v[:-1][use], v[1:][use]], axis=1)
                if joined and last[f] is not None and v[0] >= 0 and last[f] != v[0]:
                    got = np.concatenate([got, [[last[f], v[0]]]])
                pairs, n = np.unique(got, axis=0, return_counts=True)
                counts[f].append(np.column_stack([pairs, n]))
            first = first or b.slice(0, 1).to_pylist()[0]
            last = b.slice(len(b) - 1, 1).to_pylist()[0]
        rows = [(f, int(o), int(w), int(n), None, None, None, None) for f in fields for c in counts[f] for o, w, n in c]
        for end in (first, last) if first else ():
            rows += [(f, end[f], None, None, part, end["bc"], end["t"], end["rec_id"]) for f in fields]
        if rows:
            types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return run, "field string, old long, new long, n long, part int, bc string, t long, rec_id long"


def learn_relations(rows: DataFrame, fields: dict[str, Field], scratch: Scratch) -> dict[str, list[tuple[int, int]]]:
    """(u, v) for each field: v is seen to follow u within a group, clearly more often than u follows v.

    All dated rows of all groups are learned from. They are range-partitioned by (bc, made_at, rec_id), so a
    huge group is cut into pieces like any other stretch; what follows what across a cut is taken from the
    end rows of the partitions, of which the driver gets two a partition. A relation has MIN_SUPPORT
    changes, MIN_SHARE of all changes of its field, and lies DEVIATIONS standard deviations above its reverse.
    """
    run, schema = _count_transitions(tuple(fields))
    base = rows.where("bc is not null and made_at is not null").select(
        "bc", F.unix_micros("made_at").alias("t"), "rec_id", *(f.value().alias(name) for name, f in fields.items())
    )
    made = scratch.put(base.repartitionByRange("bc", "t", "rec_id").sortWithinPartitions("bc", "t", "rec_id").mapInArrow(run, schema))
    ends = made.where("part is not null").orderBy("field", "bc", "t", "rec_id", "part").collect()
    across = [
        (a["field"], a["old"], b["old"], 1, None, None, None, None)
        for a, b in itertools.pairwise(ends)
        if a["field"] == b["field"] and a["part"] != b["part"] and a["bc"] == b["bc"] and None not in (a["old"], b["old"]) and a["old"] != b["old"]
    ]
    seen = made.where("n is not null").unionByName(rows.sparkSession.createDataFrame(across, schema))
    low, high = F.least("old", "new"), F.greatest("old", "new")
    both = seen.groupBy("field", low.alias("low"), high.alias("high")).agg(
        F.sum(F.when(F.col("old") < F.col("new"), F.col("n")).otherwise(0)).alias("up"), F.sum("n").alias("n")
    )
    total = both.groupBy("field").agg(F.sum("n").alias("total"))
    up, down = F.col("up"), F.col("n") - F.col("up")
    clear = (
        (F.greatest(up, down) >= F.greatest(F.lit(float(MIN_SUPPORT)), F.col("total") * MIN_SHARE))
        & ((up - down) * (up - down) > DEVIATIONS**2 * F.col("n"))
    )
    found = both.join(F.broadcast(total), "field").where(clear).select("field", "low", "high", (up > down).alias("rises")).collect()
    out: dict[str, list[tuple[int, int]]] = {name: [] for name in fields}
    for field, a, b, rises in found:
        out[field].append((a, b) if rises else (b, a))
    scratch.drop(made)
    return out


def precedence(relations: list[tuple[int, int]]) -> dict[int, set[int]]:
    """The values after each value: what its relations lead to and what does not lead back.

    Values that follow each other in a circle are not comparable, so the order is strict and partial.
    """
    step: dict[int, set[int]] = {}
    for u, v in relations:
        step.setdefault(u, set()).add(v)
        step.setdefault(v, set())
    reach = {}
    for u in step:
        seen, todo = set(), list(step[u])
        while todo:
            v = todo.pop()
            if v not in seen:
                seen.add(v)
                todo += step[v]
        reach[u] = seen
    return {u: {v for v in seen if v != u and u not in reach[v]} for u, seen in reach.items()}


def latest_value(after: dict[int, set[int]], dated: int | None, rivals: dict[int, int], other: int | None) -> int | None:
    """The topologically latest value of one group's partial order.

    ``dated`` is the value of its latest dated row, ``rivals`` are the undated values the order knows
    (value: largest rec_id), ``other`` is the largest rec_id of the other undated rows. Returns one of the
    rivals, or None where the dated or the other one stays. Of several latest ones that with the largest rec_id wins.
    """
    pool = [v for v in rivals if v in after.get(dated, ())] if dated is not None else list(rivals)
    last = [v for v in pool if not after[v] & rivals.keys()]
    best = max(last, key=lambda v: rivals[v], default=None)
    if best is not None and dated is None and other is not None and other > rivals[best]:
        return None
    return best


def _choose(fields: tuple[str, ...], order: dict[str, dict[int, set[int]]]):
    """Each group's partial order of values, and its latest ones."""

    def run(batches):
        for b in batches:
            out = [b.column("bc"), b.column("n_rows"), b.column("seq_rec_id")]
            for f in fields:
                dated, value, other, lone = (b.column(f"{f}_{c}") for c in ("dr", "dv", "ur", "uv"))
                rec = pa.compute.coalesce(dated, other)
                val = pa.compute.if_else(dated.is_valid(), value, lone)
                pool = b.column(f"{f}_pool")
                doubt = np.nonzero(pool.is_valid().to_numpy(zero_copy_only=False))[0]
                if len(doubt):
                    rec, val = rec.to_pylist(), val.to_pylist()
                    for i in doubt:
                        rivals = {x["v"]: x["r"] for x in pool[int(i)].as_py()}
                        v = latest_value(order[f], value[int(i)].as_py(), rivals, other[int(i)].as_py())
                        if v is not None:
                            rec[i], val[i] = rivals[v], v
                    rec, val = pa.array(rec, pa.int64()), pa.array(val, pa.int64())
                out += [rec, val]
            yield pa.RecordBatch.from_arrays(out, names=["bc", "n_rows", "seq_rec_id", *(f"{f}_{c}" for f in fields for c in ("rec_id", "value"))])

    schema = ", ".join(["bc string, n_rows long, seq_rec_id long", *(f"{f}_rec_id long, {f}_value long" for f in fields)])
    return run, schema


def latest(base: DataFrame, fields: dict[str, Field]) -> DataFrame:
    """(bc, n_rows, seq_rec_id and of each field F its F_rec_id and F_value) of every group of two rows or more.

    A group's rows are in a partial order: dated rows by (made_at, rec_id); undated rows of a field that is
    not ``learned`` below all dated ones and among themselves by rec_id; undated rows of a learned field by
    the precedence of their values alone. The topologically latest value is taken. A group is summed up by mergeable
    maxima and, of its undated rows, one for each value the learned order knows, so it may hold any share of the rows.
    """
    learn = {name: f for name, f in fields.items() if f.learned}
    order = {name: {} for name in fields}
    if learn:
        order |= {name: precedence(r) for name, r in learn_relations(base, learn, Scratch(base.sparkSession)).items()}
    t, undated = F.unix_micros("made_at"), F.col("made_at").isNull()
    known = {name: f.value().isin(list(order[name])) if order[name] else F.lit(False) for name, f in fields.items()}
    letters = F.length("seq") - F.length(F.translate("seq", "ACGTacgt", ""))
    codes = F.aggregate(F.split("qual", ""), F.lit(0).cast("bigint"), lambda a, c: a + F.ascii(c))
    whole = (F.length("seq") > 0) & (F.length("seq") == F.length("qual"))
    parts = [F.when(whole, F.struct(letters.alias("l"), codes.alias("q"), F.coalesce(t, F.lit(-(2**62))).alias("t"), "rec_id")).alias("_seq")]
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.max("_seq").alias("_seq")]
    shown = [F.col("_seq.rec_id").alias("seq_rec_id")]
    for name, f in fields.items():
        v = f.value()
        parts += [
            F.when(v.isNotNull() & ~undated, F.struct(t.alias("t"), "rec_id", v.alias("v"))).alias(f"{name}_d"),
            F.when(v.isNotNull() & undated & ~known[name], F.struct("rec_id", v.alias("v"))).alias(f"{name}_u"),
        ]
        aggs += [F.max(f"{name}_{k}").alias(f"{name}_{k}") for k in "du"]
        shown += [F.col(f"{name}_{k}.{c}").alias(f"{name}_{k}{c[0]}") for k in "du" for c in ("rec_id", "v")]
    groups = base.select("bc", *parts).groupBy("bc").agg(*aggs).where("n_rows >= 2").select("bc", "n_rows", *shown)
    none = F.lit(None).cast("array<struct<v:bigint,r:bigint>>")
    held = [name for name in fields if order[name]]
    if held:
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("f"), F.when(known[n], fields[n].value()).alias("v")) for n in held]))
        rivals = base.where(undated).select("bc", "rec_id", each.alias("x")).where("x.v is not null")
        rivals = rivals.groupBy("bc", F.col("x.f").alias("f"), F.col("x.v").alias("v")).agg(F.max("rec_id").alias("r"))
        # at most 2/MIN_SHARE values a field are known to the order, which bounds the lists
        pools = rivals.groupBy("bc").agg(*[F.collect_list(F.when(F.col("f") == n, F.struct("v", "r"))).alias(f"{n}_pool") for n in held])
        groups = groups.join(pools, "bc", "left").withColumns({f"{n}_pool": F.when(F.size(f"{n}_pool") > 0, F.col(f"{n}_pool")) for n in held})
    groups = groups.withColumns({f"{n}_pool": none for n in fields if n not in held})
    run, schema = _choose(tuple(fields), order)
    return groups.mapInArrow(run, schema)


def survivors(rows: DataFrame, current: dict[str, Field] | None = None, texts: bool = False) -> DataFrame:
    """For each barcode value with two or more rows: bc, n_rows, the rows whose seq and n_reads are the best, and n_reads.

    * seq and qual come together from one row (``seq_rec_id``): among the rows with both given, not
      empty and equally long, the one with most letters A, C, G, T in either case, then the highest
      sum of qual's character codes, then the latest made_at (null is oldest), then the largest
      rec_id. With ``texts`` they are fetched.
    * n_reads comes from ``count_rec_id``: among the rows with n_reads > 0 the latest in the group's order,
      in which a row without made_at is the oldest and rec_id decides between equal times.
    * The fields of ``current`` (``CURRENT``: min_q, mean_q and a second opinion on n_reads) are
      chosen by currency: which value follows which is learned from the dated rows of all groups. A row without
      date supplies the value if the learned order puts it after the group's latest dated value; without any
      dated value the topologically latest value wins. Values the order does not compare leave the dated one
      in place; ties go to the largest rec_id.

    A field no row can supply is null. Null bc rows belong to no group; groups of one row are left
    out; an empty input gives an empty result. Repeated rows count as rows. Negative values are no values.
    Other columns are ignored.
    """
    used = ("rec_id", "seq", "qual", "made_at", "n_reads", *{f.name for f in (current or {}).values()} - {"n_reads"})
    base = rows.select(value_of("bc").alias("bc"), *used).where("bc is not null")
    got = latest(base, {"n_reads": COUNT} | (current or {}))
    out = got.select(
        "bc", "n_rows", "seq_rec_id", F.col("n_reads_rec_id").alias("count_rec_id"), F.col("n_reads_value").alias("n_reads"),
        *(F.col(f"{name}_value").alias(name) for name in current or {}),
    )
    if not texts:
        return out
    of = base.where((F.length("seq") > 0) & (F.length("seq") == F.length("qual"))).select("bc", F.col("rec_id").alias("seq_rec_id"), "seq", "qual")
    return out.join(of.dropDuplicates(["bc", "seq_rec_id"]), ["bc", "seq_rec_id"], "left")
