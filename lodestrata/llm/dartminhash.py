"""Near-duplicate records with small edits (problem 3), by DartMinHash.

A text is the set of its runs of ``width`` successive words, each with a weight that falls
with the share of texts holding it, so that boilerplate does not fill the buckets. Each
element throws hashed darts: its region of the (weight, rank) plane holds a Poisson process
of density one, made from the element's hash alone, so the same element has the same darts
in every text. A dart counts if it lands below the element's weight and before the text's
rank bound; it hits one of ``k`` coordinates, and each coordinate keeps its earliest dart.
Two texts agree in a coordinate with the probability of their weighted Jaccard similarity.
Coordinates are joined in bands. Of every candidate pair first the smallest element hashes are
compared, which settles all but one in a hundred thousand links and sends away most unlike
pairs for a few bytes; what is left is verified exactly on the plain sets.

Copies are collapsed to one representative before any signature is made, so a copy group of
any size costs one signature. Nothing but the fixed-size weight table reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestrata.llm.hashing import WORD, WordHashes, mix, shingles, unit
from lodestrata.session import materialize

#: Slots of the document-frequency table: its size, and so the broadcast, is fixed.
DF_SLOTS = 1 << 17
#: Bytes kept of an element's hash in the stored sets, and in the sketches.
KEPT, BRIEF = 5, 3
#: Smallest elements in a sketch, and how unlikely a link may fail the comparison of sketches.
SKETCH, UNLIKELY = 48, 1e-5
#: Bits of a band's name that are kept. Zeros at its end are not worth their place in a shuffle.
BAND_BITS = 48
#: Darts a coordinate gets on average: it stays empty with a probability of e to the minus that.
DARTS_EACH = 5.0


@dataclass(frozen=True)
class Darts:
    """``bands`` of ``rows`` coordinates. ``rare``: share of texts below which an element has full weight."""

    bands: int = 128
    rows: int = 5
    rare: float = 0.01
    power: float = 1.0
    least: float = 0.01

    @property
    def k(self) -> int:
        return self.bands * self.rows


def pack(sets: np.ndarray, kept: int = KEPT) -> bytes:
    return sets.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - kept :].tobytes()


def unpack(data: np.ndarray, kept: int = KEPT) -> np.ndarray:
    """Elements of packed sets, from their bytes laid end to end."""
    wide = np.zeros((len(data) // kept, 8), np.uint8)
    wide[:, 8 - kept :] = data.reshape(-1, kept)
    return wide.view("<u8").reshape(-1)


def packed_column(column: pa.Array, kept: int = KEPT) -> tuple[np.ndarray, np.ndarray]:
    """All elements of a binary column, and where each row's begin (with the end)."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return unpack(data, kept), (offsets - offsets[0]) // kept


#: Strips of the weight axis, each with darts of its own, so that a text of light elements throws few in vain.
STRIPS = ((0.0, 0.125), (0.125, 0.5), (0.5, 1.0))


def signatures(keys: np.ndarray, weights: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """DartMinHash of ragged weighted sets, one row of ``k`` dart names per set; 0 where no dart fell.

    Set ``i`` is ``keys[starts[i]:starts[i + 1]]`` with weights in (0, 1]. About
    ``DARTS_EACH * k`` darts hit each set, whatever its size.
    """
    n = len(starts) - 1
    best = np.full(n * k, np.iinfo(np.uint64).max, np.uint64)
    sizes = np.diff(starts)
    owners = np.repeat(np.arange(n), sizes)
    total = np.bincount(owners, weights, minlength=n)
    bounds = np.divide(DARTS_EACH * k, total, out=np.zeros(n), where=total > 0)[owners]
    for strip, (low, high) in enumerate(STRIPS):
        into = weights > low
        base, w, owner, bound = keys[into] ^ np.uint64(strip * 0xA24BAED4963EE407 & 0xFFFFFFFFFFFFFFFF), weights[into], owners[into], bounds[into]
        rank = np.zeros(len(base))
        turn = 0
        while len(base):
            turn += 1
            h = mix(base + np.uint64(turn * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            rank = rank - np.log(unit(h)) / (high - low)
            live = rank < bound
            base, w, owner, bound, rank, h = base[live], w[live], owner[live], bound[live], rank[live], h[live]
            place = mix(h ^ np.uint64(0xD6E8FEB86659FD93))
            hit = low + unit(place) * (high - low) <= w
            g = mix(place[hit])
            cell = owner[hit] * k + (g % np.uint64(k)).astype(np.int64)
            order = rank[hit].astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)
            np.minimum.at(best, cell, order | (g >> np.uint64(32)))
    names = best & np.uint64(0xFFFFFFFF)
    names[best == np.iinfo(np.uint64).max] = 0
    return names.reshape(n, k)


def level(weights: np.ndarray, starts: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    """No element of a set weighs more than the heaviest of its lightest ``threshold`` share.

    Two texts of similarity t have between t (one holds the other) and 2t / (1 + t) (like
    sizes) of the larger one's elements in common, so t is the share that is common at
    least. In a large family of near copies the common elements are frequent, so light;
    what single edits or own additions bring in is rare, so heavy, and would hide the
    likeness. The cap takes that weight away, whatever the family's size.
    """
    num, den = threshold
    out = np.empty_like(weights)
    for a, b in zip(starts[:-1], starts[1:]):
        w = weights[a:b]
        m = max(0, -(-(b - a) * num // den) - 1)
        out[a:b] = np.minimum(w, np.partition(w, m)[m]) if b > a else w
    return out


def _sets(width: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            ids, sizes, packed, briefs = [], [], [], []
            for rep, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = WORD.findall(text)
                if len(words) - width + 1 < least:
                    continue
                s, first = shingles(np.fromiter((known[w] for w in words), np.uint64, len(words)), width)
                if len(s) >= least:
                    ids.append(rep)
                    sizes.append(len(s))
                    # in the order of the text, so that passages many texts share are alike and compress
                    packed.append(pack(s[np.argsort(first)]))
                    briefs.append(pack(s[:SKETCH], BRIEF))
            cols = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(packed, pa.binary()), pa.array(briefs, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["rep", "n", "elements", "brief"])

    return run


def _slot(elements: np.ndarray) -> np.ndarray:
    return (elements >> np.uint64(64 - 17)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(DF_SLOTS, np.int64)
    for batch in batches:
        seen += np.bincount(_slot(packed_column(batch.column(0))[0]), minlength=DF_SLOTS)
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], names=["slot", "df"])


def _banded(table, darts: Darts, threshold: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = table.value
        for batch in batches:
            for at in range(0, len(batch), 400):
                part = batch.slice(at, 400)
                keys, starts = packed_column(part.column(1))
                names = signatures(mix(keys), level(weight[_slot(keys)], starts, threshold), starts, darts.k).reshape(len(part), darts.bands, darts.rows)
                h = np.arange(1, darts.bands + 1, dtype=np.uint64)[None, :].repeat(len(part), 0)
                for i in range(darts.rows):
                    h = mix(h * np.uint64(0x9E3779B97F4A7C15) + names[:, :, i])
                full = (names != 0).all(axis=2).reshape(-1)
                reps = np.repeat(part.column(0).to_numpy(), darts.bands)
                h &= np.uint64((1 << 64) - (1 << 64 - BAND_BITS))
                yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1)[full].view(np.int64)), pa.array(reps[full])], names=["band", "rep"])

    return run


def least_common(num: int, den: int) -> np.ndarray:
    """For each number m of compared elements up to ``SKETCH``, how many of them a link has in
    common at least, but for a probability of ``UNLIKELY``: a quantile of the binomial law."""
    out = np.zeros(SKETCH + 1, np.int64)
    t = num / den
    for m in range(1, SKETCH + 1):
        below = 0.0
        while out[m] < m and (below := below + math.comb(m, int(out[m])) * t ** int(out[m]) * (1 - t) ** (m - int(out[m]))) <= UNLIKELY:
            out[m] += 1
    return out


def alike(x: np.ndarray, xs: np.ndarray, y: np.ndarray, ys: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Whether two rows of sketches have enough in common among the smallest ``SKETCH`` of both together."""
    n = len(xs) - 1
    both = np.full((n, 2 * SKETCH), np.iinfo(np.uint64).max)
    for flat, starts, at in ((x, xs, 0), (y, ys, SKETCH)):
        row = np.repeat(np.arange(n), np.diff(starts))
        both[row, at + np.arange(len(flat)) - starts[row]] = flat
    both.sort(axis=1)
    real = both != np.iinfo(np.uint64).max
    again = np.zeros_like(real)
    again[:, 1:] = (both[:, 1:] == both[:, :-1]) & real[:, 1:]
    place = np.cumsum(real & ~again, axis=1)
    inside = place <= SKETCH
    return (again & inside).sum(axis=1) >= need[np.minimum(place[:, -1], SKETCH)]


def _rough(num: int, den: int):
    need = least_common(num, den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 3))
            ok = (np.minimum(n_a, n_b) * den >= np.maximum(n_a, n_b) * num) & alike(*packed_column(batch.column(4), BRIEF), *packed_column(batch.column(5), BRIEF), need)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(ok)) for i in (0, 1)], names=["rep_a", "rep_b"])

    return run


def _verify(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, xs = packed_column(batch.column(2))
            y, ys = packed_column(batch.column(3))
            common = np.zeros(len(batch), np.int64)
            for i in range(len(batch)):
                common[i] = len(np.intersect1d(x[xs[i] : xs[i + 1]], y[ys[i] : ys[i + 1]], assume_unique=True))
            either = np.diff(xs) + np.diff(ys) - common
            ok = pa.array(common * den >= either * num)
            rows = [batch.column(0), batch.column(1), pa.array(common), pa.array(either.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([c.filter(ok) for c in rows], names=["rep_a", "rep_b", "common", "either"])

    return run


@dataclass(frozen=True)
class Duplicates:
    """``members``: id, rep (one row per id and text). ``sets``: rep, n, elements, brief, of the
    texts with enough elements. ``links``: rep_a < rep_b, common, either."""

    members: DataFrame
    sets: DataFrame
    links: DataFrame


def near_duplicates(docs: DataFrame, ident: str, text: str, *, width: int = 5, threshold: tuple[int, int] = (4, 5),
                    min_elements: int = 1, darts: Darts = Darts()) -> Duplicates:
    """Texts whose sets of word runs have a Jaccard similarity of at least ``threshold``.

    ``ident`` is an integer; rows with a null one are ignored. A null text is the empty
    text. Texts of fewer than ``width`` words, or with fewer than ``min_elements`` distinct
    runs, are members of their class of copies and have no links. Copies (same words in the
    same order) share a representative, the smallest id among them; an id that comes with
    several texts is a member of several classes. Links hold between representatives, and
    every link found is exact; a link at the threshold itself is found with a probability of
    about ``1 - (1 - threshold ** rows) ** bands``, less ``UNLIKELY``. Other columns are ignored.
    """
    words = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    rows = docs.where(F.col(ident).isNotNull()).select(F.col(ident).cast("long").alias("id"), words.alias("words"))
    keyed = rows.select("id", "words", F.xxhash64("words").alias("h1"), F.xxhash64(F.lit(1), F.reverse("words")).alias("h2"))
    classes = keyed.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.first("words").alias("words"))
    sets = materialize(classes.select("rep", "words").mapInArrow(_sets(width, min_elements), "rep long, n int, elements binary, brief binary"), "sets")
    ids = materialize(keyed.select("id", "h1", "h2").distinct(), "ids")
    members = ids.join(ids.groupBy("h1", "h2").agg(F.min("id").alias("rep")), ["h1", "h2"]).select("id", "rep")
    members = materialize(members, "members")

    counted = sets.select("elements").mapInArrow(_count, "slot int, df long").groupBy("slot").agg(F.sum("df").alias("df")).toArrow()
    total = max(1, sets.count())
    share = np.zeros(DF_SLOTS)
    share[counted.column("slot").to_numpy()] = counted.column("df").to_numpy() / total
    rarity = np.log(1 / np.clip(share, darts.rare, 1.0)) / math.log(1 / darts.rare)
    table = docs.sparkSession.sparkContext.broadcast(np.maximum(darts.least, rarity**darts.power))

    banded = sets.select("rep", "elements").mapInArrow(_banded(table, darts, threshold), "band long, rep long")
    x, y = banded.alias("x"), banded.alias("y")
    met = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.rep") < F.col("y.rep")))
    met = met.select(F.col("x.rep").alias("rep_a"), F.col("y.rep").alias("rep_b")).distinct()
    brief = lambda p: sets.select(F.col("rep").alias(f"rep_{p}"), F.col("n").alias(f"n_{p}"), F.col("brief").alias(f"brief_{p}"))
    sketched = met.join(brief("a"), "rep_a").join(brief("b"), "rep_b").select("rep_a", "rep_b", "n_a", "n_b", "brief_a", "brief_b")
    pairs = materialize(sketched.mapInArrow(_rough(*threshold), "rep_a long, rep_b long"), "pairs")

    # only sets in a pair travel; whether the list of their ids is broadcast depends on its size
    needed = sets.join(pairs.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).distinct(), "rep", "left_semi")
    left = needed.select(F.col("rep").alias("rep_a"), F.col("elements").alias("set_a"))
    right = needed.select(F.col("rep").alias("rep_b"), F.col("elements").alias("set_b"))
    both = pairs.join(left, "rep_a").join(right, "rep_b").select("rep_a", "rep_b", "set_a", "set_b")
    links = both.mapInArrow(_verify(*threshold), "rep_a long, rep_b long, common long, either long")
    return Duplicates(members, sets, materialize(links, "links"))


def linked_ids(found: Duplicates) -> DataFrame:
    """Every pair of different ids, ``id_a < id_b``, with linked or equal texts of enough elements."""
    m = found.members
    a, b = m.select(F.col("id").alias("x"), F.col("rep").alias("rep_a")), m.select(F.col("id").alias("y"), F.col("rep").alias("rep_b"))
    across = found.links.select("rep_a", "rep_b").join(a, "rep_a").join(b, "rep_b").select("x", "y")
    enough = m.join(found.sets.select("rep"), "rep", "left_semi")
    inside = enough.select(F.col("id").alias("x"), "rep").join(enough.select(F.col("id").alias("y"), "rep"), "rep").where("x < y").select("x", "y")
    pairs = across.unionByName(inside).where("x <> y")
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def groups(found: Duplicates) -> DataFrame:
    """One row per id and text: ``id, class_id, group_id, n_links``.

    ``class_id`` is the representative of the copies, ``n_links`` the number of other classes
    linked to it, ``group_id`` the smallest class id that is reached over links. Every round
    lowers labels, so the rounds end by themselves; jumps make them about the logarithm of
    the longest chain.
    """
    both = found.links.select("rep_a", "rep_b").unionByName(found.links.select(F.col("rep_b").alias("rep_a"), F.col("rep_a").alias("rep_b")))
    degree = both.groupBy("rep_a").agg(F.count("*").alias("n_links"))
    label = both.groupBy("rep_a").agg(F.min("rep_b").alias("m")).select(F.col("rep_a").alias("rep"), F.least("rep_a", "m").alias("group_id"))
    label = materialize(label, "labels")
    while True:
        # the smallest label among the neighbours, then one jump along the pointer
        near = both.join(label.select(F.col("rep").alias("rep_b"), "group_id"), "rep_b").groupBy("rep_a").agg(F.min("group_id").alias("m"))
        step = label.join(near.withColumnRenamed("rep_a", "rep"), "rep").select("rep", "group_id", F.least("group_id", "m").alias("low"))
        jump = label.select(F.col("rep").alias("low"), F.col("group_id").alias("far"))
        step = step.join(jump, "low", "left").select("rep", F.col("group_id").alias("was"), F.least("low", F.coalesce("far", "low")).alias("group_id"))
        step = materialize(step, "labels")
        if step.where("was <> group_id").limit(1).count() == 0:
            break
        label = step.select("rep", "group_id")
    m = found.members.join(label, "rep", "left").join(degree.withColumnRenamed("rep_a", "rep"), "rep", "left")
    return m.select("id", F.col("rep").alias("class_id"), F.coalesce("group_id", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
