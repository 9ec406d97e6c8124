"""Mixing sources to target weights."""

from __future__ import annotations

import heapq
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions.text import label_of
from readloom.llm import tokens
from readloom.operators.salted import hot_keys, salted_lookup
from readloom.session import Scratch, spread

#: Hash buckets in which a seeded selection finds its cut, at each of two levels.
BUCKETS = 4096
#: The target list is a small table by its nature; it is refused beyond this many sources.
MAX_SOURCES = 10_000
#: A set of sources that share texts is a pattern of its own if those texts hold 1/PATTERNS of the tokens, so at most PATTERNS
#: sets are; the documents of rarer sets count for their own source alone.
PATTERNS = 10_000


def _measure(vocabulary):
    def run(batches):
        for b in batches:
            texts = b.column("text")
            counts = [tokens.count(t.as_py(), vocabulary.value) if t.is_valid else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("source"), b.column("text_key"), pa.array(counts, pa.int64())],
                names=["doc_id", "source", "text_key", "tokens"],
            )

    return run


def measured_documents(docs: DataFrame, targets: DataFrame, path: str = tokens.VOCABULARY) -> DataFrame:
    """(doc_id, source, text_key, tokens) of the documents whose source is listed; whole texts are counted."""
    listed = targets.select(label_of("source").alias("source")).distinct()
    docs = spread(docs.select("doc_id", "source", "text"))
    rows = docs.select("doc_id", label_of("source").alias("source"), F.unhex(F.md5("text")).alias("text_key"), "text")
    rows = rows.join(F.broadcast(listed), "source", "left_semi").select("doc_id", "source", "text_key", "text")
    vocabulary = docs.sparkSession.sparkContext.broadcast(tokens.read_vocabulary(path))
    return rows.mapInArrow(_measure(vocabulary), "doc_id long, source string, text_key binary, tokens long")


class Flow:
    """Min-cost flow by successive cheapest paths; the graph has patterns and sources, not documents."""

    def __init__(self):
        self.to, self.room, self.cost, self.out = [], [], [], defaultdict(list)

    def arc(self, a, b, room: float, cost: float) -> int:
        for u, v, r, c in ((a, b, room, cost), (b, a, 0.0, -cost)):
            self.out[u].append(len(self.to))
            self.to.append(v)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, start, end, eps: float = 1e-6) -> None:
        height = defaultdict(float)
        while True:
            dist, via, queue = {start: 0.0}, {}, [(0.0, 0, start)]
            done, order = set(), 0
            while queue:
                d, _, u = heapq.heappop(queue)
                if u in done:
                    continue
                done.add(u)
                for e in self.out[u]:
                    v = self.to[e]
                    if self.room[e] > eps and v not in done:
                        nd = d + self.cost[e] + height[u] - height[v]
                        if nd < dist.get(v, float("inf")) - 1e-12:
                            dist[v], via[v] = nd, e
                            order += 1
                            heapq.heappush(queue, (nd, order, v))
            if end not in done:
                return
            far = max(dist[v] for v in done)
            for v in list(self.out):
                height[v] += dist[v] if v in done else far
            path, v = [], end
            while v != start:
                path.append(via[v])
                v = self.to[via[v] ^ 1]
            amount = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= amount
                self.room[e ^ 1] += amount


def plan_flow(supply: list[tuple[str, str, int]], targets: list[tuple[str, float, int]], balanced: bool = False) -> tuple[dict, dict]:
    """Routes tokens from membership patterns to the quotas of the sources.

    ``supply`` has (pattern, source, tokens of the documents of that source whose text has this
    pattern of sources). A text used once costs nothing, each further use costs one more a token, so
    repetition is spread evenly and texts of several sources are shared rather than doubled. The quotas
    are shares of the supply's total, or, ``balanced``, of the largest total at which every source can
    reach its share. Returns the tokens routed by (pattern, source) and the quota of each source.
    """
    total = float(sum(t for _, _, t in supply))
    if balanced:
        have = defaultdict(int)
        for _, s, t in supply:
            have[s] += t
        total = min([total, *(have[s] * r / share for s, share, r in targets if share > 0)])
    quota = {s: share * total for s, share, _ in targets}
    repeats = {s: r for s, _, r in targets}
    flow, arcs = Flow(), {}
    by_pattern = defaultdict(dict)
    for p, s, t in supply:
        by_pattern[p][s] = t
    for p, own in sorted(by_pattern.items()):
        most = sum(repeats[s] for s in own)
        step = max(own.values())
        for k in range(most):
            flow.arc("start", ("p", p), float(step), float(k))
        for s, t in sorted(own.items()):
            arcs[p, s] = flow.arc(("p", p), ("s", s), float(t * repeats[s]), 0.0)
    for s, q in sorted(quota.items()):
        flow.arc(("s", s), "end", q, 0.0)
    flow.run("start", "end")
    return {k: flow.room[e ^ 1] for k, e in arcs.items()}, quota


class Mixture:
    """A drawn mixture: ``documents`` (doc_id, source, tokens, repeats) and ``shares`` of the sources."""

    def __init__(self, docs: DataFrame, targets: DataFrame, seed: int = 17, path: str = tokens.VOCABULARY, balanced: bool = False):
        """Documents with a source of ``targets`` (lower case, trimmed) are the supply; their tokens, copies
        included, are the total, and each source's quota is target_share * total. Documents with a
        null or unlisted source take no part; a null or empty text has no tokens. Identical texts in
        several sources form a membership pattern. Where a pattern's share of a source is used in
        part, documents enter in the order of a seeded hash until the tokens are filled, so the
        same seed gives the same mixture. A listed source without documents reaches nothing; in a
        ``balanced`` mixture, which is as small as its scarcest source demands, it leaves nothing to draw.
        """
        spark = docs.sparkSession
        self.scratch = Scratch(spark)
        self.targets = targets.select(label_of("source").alias("source"), "target_share", "max_repeats").where("source is not null")
        listed = [tuple(r) for r in self.targets.limit(MAX_SOURCES + 1).collect()]
        if len(listed) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} target sources")
        sized = self.scratch.put(measured_documents(docs, self.targets, path))
        n, total = sized.agg(F.count(F.lit(1)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
        # at most as many members as sources are listed, so the sets are bounded
        sets = sized.where("text_key is not null").groupBy("text_key").agg(F.sort_array(F.collect_set("source")).alias("s"))
        sets = sets.where(F.size("s") > 1).select("text_key", F.array_join("s", "|").alias("set"))
        shared = self.scratch.put(salted_lookup(sized, sets, "text_key", "doc_id", hot_keys(sized, "text_key", n), "left"))
        kept = shared.where("set is not null").groupBy("set").agg(F.sum("tokens").alias("t")).where(F.col("t") * PATTERNS >= F.lit(total))
        shared = shared.join(F.broadcast(kept.select("set", F.col("set").alias("pattern"))), "set", "left")
        order = F.xxhash64(F.lit(seed), "doc_id")
        self.keyed = self.scratch.put(
            shared.select("doc_id", "source", F.coalesce("pattern", "source").alias("pattern"), "tokens", order.alias("ord"))
        )
        supply = [tuple(r) for r in self.keyed.groupBy("pattern", "source").agg(F.sum("tokens")).collect()]
        self.routed, self.quota = plan_flow(supply, listed, balanced)
        self.supply = {(p, s): t for p, s, t in supply}
        self.repeats = {s: r for s, _, r in listed}
        self.total = total

    def unreachable(self) -> DataFrame:
        """The sources whose quota the flow cannot fill."""
        got = defaultdict(float)
        for (_, s), f in self.routed.items():
            got[s] += f
        short = [(s,) for s, q in sorted(self.quota.items()) if got[s] < q - 1e-3]
        return self.keyed.sparkSession.createDataFrame(short, "source string")

    def _cut(self, docs: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
        """Documents by a bucket of their hash, and the bucket of each pattern and source in which ``rest`` is reached."""
        bucket = F.shiftrightunsigned("ord", 52 - 12 * level).bitwiseAND(F.lit(BUCKETS - 1))
        docs = docs.withColumn("bucket", bucket)
        sums = docs.where("rest > 0").groupBy("pattern", "source", "rest", "bucket").agg(F.sum("tokens").alias("t"))
        run = Window.partitionBy("pattern", "source").orderBy("bucket")  # at most BUCKETS rows
        over = sums.withColumn("upto", F.sum("t").over(run)).where(F.col("upto") > F.col("rest"))
        cut = over.groupBy("pattern", "source").agg(F.min(F.struct("bucket", (F.col("rest") - F.col("upto") + F.col("t")).alias("room"))).alias("c"))
        return docs, cut.select("pattern", "source", F.col("c.bucket").alias("cut"), F.col("c.room").alias("room"))

    def documents(self) -> DataFrame:
        """(doc_id, source, tokens, repeats) of the documents drawn.

        All of a source's documents of a pattern are used ``full`` times, and in the order of a seeded hash so many
        once more as fit into the ``rest``. What is left of the rests of a source's patterns goes to those
        documents next in order that fit in, so a source misses its quota by less than one document.
        """
        spark = self.keyed.sparkSession
        rows = []
        for (p, s), f in sorted(self.routed.items()):
            t, most = self.supply[p, s], self.repeats[s]
            full = min(int(f / t + 1e-9), most) if t else 0
            rows.append((p, s, full, max(0.0, f - full * t) if full < most else 0.0))
        schema = "pattern string, source string, full int, rest double"
        docs = self.keyed.join(F.broadcast(spark.createDataFrame(rows, schema)), ["pattern", "source"])
        done = []
        for level in (0, 1):
            docs, cut = self._cut(docs, level)
            docs = docs.join(F.broadcast(cut), ["pattern", "source"], "left")
            inside = F.coalesce(F.col("bucket") == F.col("cut"), F.lit(False))
            below = F.coalesce(F.col("bucket") < F.col("cut"), F.lit(True)) & (F.col("rest") > 0)
            done.append(docs.where(~inside).select("doc_id", "source", "tokens", (F.col("full") + below.cast("int")).alias("repeats")))
            docs = docs.where(inside).select("doc_id", "source", "pattern", "tokens", "ord", "full", F.col("room").alias("rest"))
        # 1/BUCKETS^2 of a pattern's documents
        order = Window.partitionBy("pattern", "source").orderBy("ord", "doc_id")
        last = self.scratch.put(docs.withColumn("upto", F.sum("tokens").over(order)))
        first_out = (F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("tokens") <= F.col("rest"))
        left = last.where(first_out).select("pattern", "source", "tokens", (F.col("rest") - F.col("upto") + F.col("tokens")).alias("left")).collect()
        room = defaultdict(float)
        for r in left:
            room[r["source"]] += r["left"]
        more = [("", "")]
        for r in sorted(left, key=lambda r: (-r["tokens"], r["pattern"])):
            if r["tokens"] <= room[r["source"]]:
                room[r["source"]] -= r["tokens"]
                more.append((r["pattern"], r["source"]))
        more = spark.createDataFrame(more, "pattern string, source string").withColumn("more", F.lit(True))
        last = last.join(F.broadcast(more), ["pattern", "source"], "left")
        extra = (F.col("upto") <= F.col("rest")) | (first_out & F.col("more").isNotNull())
        done.append(last.select("doc_id", "source", "tokens", (F.col("full") + extra.cast("int")).alias("repeats")))
        return done[0].unionByName(done[1]).unionByName(done[2]).where("repeats > 0")

    def shares(self) -> DataFrame:
        """Of each listed source: its tokens, those wanted and drawn, its actual share and the largest number of repeats.

        ``reachable`` says whether the source can reach its share of the whole supply (as ``unreachable``), ``missed`` how many
        tokens the drawn ones are short of the wanted ones, and ``longest`` how many the longest document of the source has.
        """
        spark = self.keyed.sparkSession
        have = self.keyed.groupBy("source").agg(F.sum("tokens").alias("tokens_available"), F.max("tokens").alias("longest"))
        drawn = self.documents().groupBy("source").agg(
            F.sum(F.col("tokens") * F.col("repeats")).alias("tokens_drawn"), F.max("repeats").alias("most_repeats")
        )
        quota = spark.createDataFrame(sorted(self.quota.items()), "source string, tokens_wanted double")
        out = self.targets.join(quota, "source").join(have, "source", "left").join(drawn, "source", "left")
        out = out.fillna(0, ["tokens_available", "longest", "tokens_drawn", "most_repeats"])
        total = F.sum("tokens_drawn").over(Window.partitionBy(F.lit(1)))  # one row a source
        return out.select(
            "source", "target_share", "max_repeats", "tokens_available", "tokens_wanted", "tokens_drawn",
            (F.col("tokens_drawn") / total).alias("actual_share"), "most_repeats", "longest",
            (F.col("tokens_wanted") - F.col("tokens_drawn")).alias("missed"),
            (F.col("tokens_available") * F.col("max_repeats") >= F.col("target_share") * self.total).alias("reachable"),
        )
