"""Mixing sources to target weights (problem 9): min-cost flow over membership patterns.

A text may occur in several sources. Texts are aggregated by the set of sources that hold
them, their membership pattern, and only the patterns' token totals reach the driver. There
a flow routes each pattern's tokens to the quotas of its sources: the first use of a token is
free, each repetition costs one more than the last, so repetition is convex and goes where
it is needed. The flow's amounts become intervals on each pattern's seeded order of texts, and
a text is taken for the source whose interval holds it whole. Running sums are taken in
hash buckets with offsets, so no pattern is gathered in one task. What the ends of the
intervals leave of a quota is closed by texts that fit: of every size class (powers of two)
some unused ones are offered, and the driver takes the largest that fit, last the nearest.
"""

from __future__ import annotations

from collections import defaultdict, deque

from pyspark.sql import DataFrame, Window, functions as F

from lodestrata.session import materialize

#: Patterns the driver accepts. With up to 12 sources there cannot be more.
MAX_PATTERNS = 4096
#: Texts of one hash bucket of the running sums.
BUCKET_TEXTS = 50_000
#: Unused texts of each size class offered for what is left of a quota, besides one per interval of it.
OFFERS = 8


class Flow:
    """Successive cheapest paths on a graph of a few thousand arcs with integer capacities."""

    def __init__(self) -> None:
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []
        self.out: dict[int, list[int]] = defaultdict(list)

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        at = len(self.to)
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return at

    def run(self, source: int, sink: int) -> int:
        total = 0
        while True:
            dist, via, queue, inside = {source: 0}, {}, deque([source]), {source}
            while queue:
                x = queue.popleft()
                inside.discard(x)
                for e in self.out[x]:
                    y = self.to[e]
                    if self.room[e] > 0 and dist[x] + self.cost[e] < dist.get(y, 1 << 60):
                        dist[y], via[y] = dist[x] + self.cost[e], e
                        if y not in inside:
                            inside.add(y)
                            queue.append(y)
            if sink not in dist:
                return total
            path, x = [], sink
            while x != source:
                path.append(via[x])
                x = self.to[via[x] ^ 1]
            push = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= push
                self.room[e ^ 1] += push
            total += push


def route(patterns: dict[tuple[str, ...], int], quotas: dict[str, int], repeats: dict[str, int]) -> tuple[int, dict]:
    """Tokens routed in all, and ``{(pattern, level, source): tokens}``.

    A pattern offers its tokens once per level; a level is open to the sources whose
    ``repeats`` reach it.
    """
    g = Flow()
    names = {s: i + 2 for i, s in enumerate(sorted(quotas))}
    node = len(names) + 2
    arcs = {}
    for s, i in names.items():
        g.arc(i, 1, quotas[s], 0)
    for p in sorted(patterns):
        wanted = [s for s in p if s in quotas]
        for level in range(1, max((repeats[s] for s in wanted), default=0) + 1):
            g.arc(0, node, patterns[p], level - 1)
            for s in wanted:
                if repeats[s] >= level:
                    arcs[p, level, s] = g.arc(node, names[s], patterns[p], 0)
            node += 1
    total = g.run(0, 1)
    return total, {k: g.room[e ^ 1] for k, e in arcs.items() if g.room[e ^ 1] > 0}


def plan_mix(patterns: dict[tuple[str, ...], int], shares: dict[str, float], repeats: dict[str, int]) -> tuple[int, dict]:
    """The largest total size whose quotas can all be met, and its routes."""
    held = {p: n for p, n in patterns.items() if n > 0}
    quota = lambda t: {s: int(round(t * x)) for s, x in shares.items() if x > 0}
    low, high = 0, sum(n * max((repeats.get(s, 0) for s in p), default=0) for p, n in held.items())
    while low < high:
        mid = (low + high + 1) // 2
        q = quota(mid)
        if route(held, q, repeats)[0] == sum(q.values()):
            low = mid
        else:
            high = mid - 1
    return low, route(held, quota(low), repeats)[1]


def mix_sources(docs: DataFrame, ident: str, text: str, source: str, targets: DataFrame, seed: int = 5) -> DataFrame:
    """``mix_name, <ident>, source, copies, n_tokens``: the records of each mix.

    ``docs`` has ``n_tokens`` beside the named columns. Equal texts are one text, taken
    under its smallest id, and belong to all sources they occur in; null sources belong to
    none, texts without tokens are not used. ``targets``: ``mix_name, source,
    target_share, max_repeats``, at most 12 sources a mix; shares of a mix are scaled to
    sum to 1, null shares are 0, null repeats are 1. The total of a mix is the largest for
    which every quota can be met; a source with a share but no tokens makes it 0. A text
    is used at most ``max_repeats`` times, over all sources together at most as often as
    its most repeatable source allows. A source's tokens differ from its quota by less than
    half of the smallest text that is still unused, if any is small enough to fit at all.
    Empty tables give no rows.
    """
    spark = docs.sparkSession
    wanted: dict[str, dict[str, tuple[float, int]]] = defaultdict(dict)
    for m, s, x, r in targets.where("mix_name is not null and source is not null").select("mix_name", "source", "target_share", "max_repeats").limit(10_001).collect():
        wanted[m][s] = (float(x or 0), int(r if r is not None else 1))
    if sum(map(len, wanted.values())) > 10_000 or any(len(v) > 12 for v in wanted.values()):
        raise ValueError("too many targets: at most 12 sources in a mix and 10000 rows")
    known = sorted({s for v in wanted.values() for s in v})
    listed = F.array(*map(F.lit, known)) if known else F.array().cast("array<string>")
    keyed = docs.where(F.col("n_tokens") > 0).select(F.col(ident).alias("id"), F.col(source).alias("src"), "n_tokens", F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), F.reverse(text)).alias("h2"))
    texts = keyed.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.first("n_tokens").alias("n_tokens"), F.array_sort(F.collect_set(F.when(F.array_contains(listed, F.col("src")), F.col("src")))).alias("pattern"))
    texts = texts.where(F.size("pattern") > 0).withColumn("order", F.xxhash64(F.lit(seed), "h1", "h2"))
    totals = {tuple(p): (n, k) for p, n, k in texts.groupBy("pattern").agg(F.sum("n_tokens"), F.count("*")).limit(MAX_PATTERNS + 1).collect()}
    if len(totals) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    zones, quotas, allowed, parts = [], {}, {}, defaultdict(int)
    for m in sorted(wanted):
        scale = sum(x for x, _ in wanted[m].values()) or 1.0
        shares = {s: x / scale for s, (x, _) in wanted[m].items()}
        repeats = {s: r for s, (_, r) in wanted[m].items()}
        # only this mix's sources count, so patterns that agree in them share one order
        offered: dict[tuple[str, ...], int] = {p: n for p, (n, _) in totals.items()}
        total, routes = plan_mix(offered, shares, repeats)
        spans: dict[tuple, list] = defaultdict(list)
        begin: dict[tuple, int] = defaultdict(int)
        for (p, level, s), n in sorted(routes.items()):
            spans[p, level].append((s, begin[p, level], begin[p, level] + n))
            begin[p, level] += n
            parts[m, s] += 1
        for p in totals:
            for level in range(1, max((repeats.get(s, 0) for s in p), default=0) + 1):
                zones.append((m, list(p), level, spans.get((p, level), [])))
        quotas |= {(m, s): int(round(total * x)) for s, x in shares.items() if x > 0 and total > 0}
        allowed |= {(m, s): r for s, r in repeats.items()}
    zone = spark.createDataFrame(zones, "mix_name string, pattern array<string>, level int, spans array<struct<source:string,lo:long,hi:long>>")
    buckets = max(1, -(-sum(k for _, k in totals.values()) // BUCKET_TEXTS))
    texts = texts.withColumn("bucket", F.pmod(F.shiftright("order", 20), F.lit(buckets)))
    sums = texts.groupBy("pattern", "bucket").agg(F.sum("n_tokens").alias("t"))
    before = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offset = sums.select("pattern", "bucket", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("pattern", "bucket").orderBy("order", "id").rowsBetween(Window.unboundedPreceding, -1)
    placed = texts.withColumn("before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(offset, ["pattern", "bucket"])
    placed = placed.select("id", "pattern", "n_tokens", "order", (F.col("offset") + F.col("before")).alias("lo"))
    # zones: a bounded number of rows (patterns x levels of the parameter table)
    at = placed.join(F.broadcast(zone) if len(zones) <= 50_000 else zone, "pattern")
    inside = F.filter("spans", lambda x: (x["lo"] <= F.col("lo")) & (F.col("lo") + F.col("n_tokens") <= x["hi"]))
    at = at.withColumn("source", F.get(inside, F.lit(0))["source"])
    taken = materialize(at.where("source is not null").select("mix_name", "id", "source", "n_tokens"), "taken")
    got = {(r[0], r[1]): r[2] for r in taken.groupBy("mix_name", "source").agg(F.sum("n_tokens")).collect()}
    left = {k: q - got.get(k, 0) for k, q in quotas.items() if q > got.get(k, 0)}
    more = _closed(at.where("source is null"), left, allowed, parts)
    extra = spark.createDataFrame(more, "mix_name string, id long, source string, n_tokens long").withColumn("id", F.col("id").cast(dict(taken.dtypes)["id"]))
    uses = taken.unionByName(extra).groupBy("mix_name", "id", "source")
    return uses.agg(F.count("*").alias("copies"), F.first("n_tokens").alias("n_tokens")).withColumnRenamed("id", ident)


def _closed(unused: DataFrame, left: dict[tuple[str, str], int], allowed: dict[tuple[str, str], int], parts: dict[tuple[str, str], int]) -> list[tuple]:
    """Uses (mix, id, source, tokens) that close what is ``left`` of the quotas, from texts ``unused`` at a level.

    At most ``OFFERS`` and one per interval of each size class of each quota reach the driver.
    """
    if not left:
        return []
    spark = unused.sparkSession
    need = spark.createDataFrame([(m, s, r, allowed[m, s], OFFERS + parts[m, s]) for (m, s), r in left.items()], "mix_name string, source string, room long, most int, offers int")
    each = unused.select("mix_name", "level", "id", "n_tokens", "order", F.explode("pattern").alias("source"))
    # need: a row per target at most, of which there are 10,000 at most
    fits = each.join(F.broadcast(need), ["mix_name", "source"]).where("level <= most and n_tokens < 2 * room").withColumn("class", F.floor(F.log2("n_tokens")))
    turn = F.row_number().over(Window.partitionBy("mix_name", "source", "class").orderBy("order", "id", "level"))
    offers: dict[tuple[str, str], list[tuple]] = defaultdict(list)
    most = OFFERS + max(parts.values(), default=0)
    for m, s, i, level, n in fits.withColumn("turn", turn).where(F.col("turn") <= most).where("turn <= offers").select("mix_name", "source", "id", "level", "n_tokens").collect():
        offers[m, s].append((n, i, level))
    out, used = [], set()
    for (m, s), room in sorted(left.items(), key=lambda x: (-x[1], x[0])):
        free = sorted((x for x in offers[m, s] if (m, *x[1:]) not in used), key=lambda x: (-x[0], x[1], x[2]))
        chosen = []
        for x in free:
            if x[0] <= room:
                chosen.append(x)
                room -= x[0]
        rest = [x for x in free if x not in chosen and x[0] < 2 * room]
        chosen += [min(rest, key=lambda x: (abs(room - x[0]), x[1], x[2]))] if rest else []
        used |= {(m, i, level) for _, i, level in chosen}
        out += [(m, i, s, n) for n, i, _ in chosen]
    return out


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per mix and source: texts, most copies, tokens, target and actual share, and ``gap_tokens``,
    what the source has above (or below) its share of the mix; a gap is less than the size of a text."""
    got = mixed.groupBy("mix_name", "source").agg(F.count("*").alias("texts"), F.max("copies").alias("most_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"))
    all_tokens = got.groupBy("mix_name").agg(F.sum("tokens").alias("total"))
    t = targets.select("mix_name", "source", "target_share", "max_repeats")
    out = t.join(got, ["mix_name", "source"], "left").join(all_tokens, "mix_name", "left").fillna(0, ["texts", "most_copies", "tokens"])
    scale = F.sum("target_share").over(Window.partitionBy("mix_name"))
    gap = F.round(F.col("tokens") - F.col("total") * F.col("target_share") / scale).cast("long").alias("gap_tokens")
    return out.select("mix_name", "source", "target_share", "max_repeats", "texts", "most_copies", "tokens", F.round(F.col("tokens") / F.col("total"), 6).alias("actual_share"), gap)
