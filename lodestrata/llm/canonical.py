"""Mapping free-typed values to a canonical list (problem 5): a prefix-filter set-similarity join.

A value is cut into phrases (runs of words of a piece between separators, one word longer
than the longest name listed), a phrase is a set of letter pairs. All sets are ordered by one global order,
rarest pair first, so two sets with Jaccard similarity of at least ``t`` share a pair
within their prefixes. Only prefixes are joined; the length filter and the positional
filter run inside the join, the survivors are verified exactly, and the best entry is kept.
Work is done once per distinct value, so a value typed by a third of all rows costs one.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

#: Slots of the table of pair frequencies behind the global order; its size is fixed.
RANK_SLOTS = 4096
#: The points of the compass, for which their first letter stands.
COMPASS = {"north", "south", "east", "west"}
#: Names that begin with the same word, from which on the word is one that people shorten.
SHARED = 2
#: Letters that do not decompose into a base letter and a mark.
PLAIN = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i"})

_PIECE = re.compile(r"[,/|()\[\]{};:&•·\n\t]+|\s-+\s")
_WORD = re.compile(r"[^\W_]+")
_SPACED = re.compile(r"(?:(?<=\s)|^)(?:[^\W_](?:\s?\.)?\s){2,}[^\W_](?=\s|$)")


def fold(text: str) -> str:
    """Lower case without accents."""
    low = unicodedata.normalize("NFKD", text.lower())
    return "".join(c for c in low if not unicodedata.combining(c)).translate(PLAIN)


def phrases(value: str, most: int) -> set[str]:
    """The phrases of up to ``most`` words, each written together: 'S t . X, YZ' gives 'stx' and 'yz'."""
    out: set[str] = set()
    whole = _SPACED.sub(lambda m: re.sub(r"[\s.]", "", m.group()), fold(value))
    for piece in _PIECE.split(whole):
        words = _WORD.findall(piece)
        for i in range(len(words)):
            for n in range(1, most + 1):
                if i + n <= len(words):
                    out.add("".join(words[i : i + n]))
    return {p for p in out if len(p) > 1}


def shortened(word: str) -> set[str]:
    """How a word is usually shortened: its first two letters, first and last letter, first and
    last two, without vowels; a word of three letters and a point of the compass to the first."""
    bare = word[0] + re.sub(r"[aeiou]", "", word[1:])
    single = re.sub(r"(.)\1", r"\1", bare)
    out = {word[:2], word[0] + word[-1], word[0] + word[-2:], bare, single, single[:1] + single[-2:]}
    return {x for x in out if 1 < len(x) < len(word)} | ({word[0]} if len(word) == 3 or word in COMPASS else set())


def forms(name: str, common: frozenset[str] = frozenset()) -> set[str]:
    """How an entry may be written: with its first word in full or, if it is ``common``, in a short form."""
    words = _WORD.findall(fold(name))
    if not words:
        return set()
    heads = {words[0]} | (shortened(words[0]) if len(words) > 1 and words[0] in common else set())
    return {"".join([w, *words[1:]]) for w in heads}


def pairs(phrase: str) -> set[str]:
    p = f"^{phrase}$"
    return {p[i : i + 2] for i in range(len(p) - 1)}


def edits(a: str, b: str) -> int:
    """Insertions, deletions, replacements and swaps of neighbours that turn ``a`` into ``b``."""
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            cost = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[j - 2] + 1)
            row.append(cost)
    return row[-1]


def _edits_of(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([-1 if x is None else edits(x, y) for x, y in zip(a, b)], dtype="int32")


def _first_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per name of several words its first word, and its number of words."""
    for batch in batches:
        words = [_WORD.findall(fold(x)) for x in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([w[0] if len(w) > 1 else None for w in words], pa.string()), pa.array([len(w) for w in words], pa.int32())], names=["word", "words"])


def _slot(pair: str) -> int:
    return xxhash.xxh32_intdigest(pair.encode("utf-8", "surrogatepass")) % RANK_SLOTS


def _expand(split, freq: np.ndarray | None):
    """Rows (key, phrase, grams in global order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, grams = [], [], []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for p in sorted(split(value)):
                    keys.append(key)
                    texts.append(p)
                    grams.append(sorted(pairs(p), key=lambda g: (freq[_slot(g)], g)) if freq is not None else sorted(pairs(p)))
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(texts, pa.string()), pa.array(grams, pa.list_(pa.string()))], names=["key", "phrase", "grams"])

    return run


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(RANK_SLOTS, np.int64)
    for batch in batches:
        for grams in batch.column(0).to_pylist():
            for g in grams:
                seen[_slot(g)] += 1
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], names=["slot", "n"])


def match_canonical(values: DataFrame, value: str, entries: DataFrame, *, similarity: tuple[int, int] = (1, 4), max_edits: int = 2,
                    letters_per_edit: int = 3) -> DataFrame:
    """The entry each distinct value means: ``value, entry_id`` (-1 if none) and ``score``.

    ``entries``: ``entry_id`` long, ``name`` string, ``context`` array of strings (the names
    by which the surroundings of the entry are known, such as its country), ``weight`` long.
    One entry may have several rows with other names. A phrase matches a name if the sets of
    letter pairs have a Jaccard similarity of at least ``similarity``, and, checked exactly
    afterwards, at most ``max_edits`` edits (swaps of neighbours count once) and one edit for every
    ``letters_per_edit`` letters of the name.
    An entry whose context is contradicted - the value names a context, but none of the
    entry's - is out. Best is the highest similarity, then fewest edits, then the longer
    phrase, the larger ``weight``, the smaller id. Null and blank values give no row; a
    value that is a context only, or has no letters, gives -1. No values give no rows;
    no entries give -1 for every value. Columns beyond those named are ignored.
    """
    num, den = similarity
    spark = values.sparkSession
    distinct = values.select(F.col(value).cast("string").alias("value")).where(F.trim("value") != "").distinct()
    named = entries.select(F.col("entry_id").cast("long"), "name", "context", F.coalesce("weight", F.lit(0)).cast("long").alias("weight"))
    names = named.select("name").where("name is not null").distinct()
    contexts = named.select(F.explode("context").alias("name")).where("name is not null").distinct()
    # the words that begin several entries, and the length of the longest name: bounded by the list, and so small
    heads = names.unionByName(contexts).mapInArrow(_first_words, "word string, words int")
    most = 1 + (heads.agg(F.max("words")).first()[0] or 0)
    common = frozenset(r[0] for r in names.mapInArrow(_first_words, "word string, words int").where("word is not null").groupBy("word").count().where(F.col("count") >= SHARED).select("word").collect())
    written = partial(forms, common=common)
    listed = names.select("name", "name").toDF("key", "name").mapInArrow(_expand(written, None), "key string, phrase string, grams array<string>")
    counted = listed.select("grams").mapInArrow(_slots, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    freq = np.zeros(RANK_SLOTS, np.int64)
    for slot, n in counted:
        freq[slot] = n

    def sets(df: DataFrame, split) -> DataFrame:
        out = df.toDF("key", "name").mapInArrow(_expand(split, freq), "key string, phrase string, grams array<string>")
        size = F.size("grams")
        # an edit takes away three pairs at most, so both prefixes end after 3 * max_edits + 1 at the latest
        return out.withColumns({"size": size, "prefix": F.least(size - F.ceil(size * num / den).cast("int") + 1, F.lit(3 * max_edits + 1))})

    spoken = sets(distinct.select("value", "value"), partial(phrases, most=most))
    typed = spoken.select("phrase", "grams", "size", "prefix").distinct()
    kept = sets(names.select("name", "name"), written).select(F.col("key").alias("name"), F.col("phrase").alias("form"), "grams", "size", "prefix")
    left = typed.select("phrase", "size", F.posexplode(F.slice("grams", F.lit(1), F.col("prefix"))).alias("i", "gram"))
    right = kept.select("form", F.col("size").alias("size_r"), F.posexplode(F.slice("grams", F.lit(1), F.col("prefix"))).alias("j", "gram")).distinct()
    need = F.ceil((F.col("size") + F.col("size_r")) * num / (num + den))
    near = (F.col("size") * den >= F.col("size_r") * num) & (F.col("size_r") * den >= F.col("size") * num)
    room = 1 + F.least(F.col("size") - F.col("i") - 1, F.col("size_r") - F.col("j") - 1)
    # the shared pair at (i, j) may be preceded by up to min(i, j) shared pairs
    met = left.join(right, "gram").where(near & (room + F.least("i", "j") >= need)).select("phrase", "form").distinct()
    a, b = typed.select("phrase", F.col("grams").alias("ga")), kept.select("form", F.col("grams").alias("gb")).distinct()
    both = met.join(a, "phrase").join(b, "form").withColumn("common", F.size(F.array_intersect("ga", "gb")))
    both = both.withColumn("either", F.size("ga") + F.size("gb") - F.col("common")).where(F.col("common") * den >= F.col("either") * num)
    # a swap is two edits to the built-in distance, which screens the pairs inside the JVM
    close = F.abs(F.length("phrase") - F.length("form")) <= max_edits
    both = both.withColumn("plain", F.levenshtein("phrase", "form", 2 * max_edits)).where(close & (F.col("plain") >= 0))
    # only from two plain edits on there can be a swap, for which Python is asked
    counted = F.pandas_udf(_edits_of, "int")(F.when(F.col("plain") > 1, F.col("phrase")), "form")
    both = both.select("phrase", "form", "common", "either", "plain", counted.alias("counted"))
    both = both.withColumn("edits", F.when(F.col("plain") > 1, F.col("counted")).otherwise(F.col("plain")))
    both = both.where((F.col("edits") <= max_edits) & (F.col("edits") * letters_per_edit <= F.length("form")))
    sure = both.select("phrase", "form", (F.col("common") / F.col("either")).alias("score"), "edits")
    by_name = sure.join(kept.select("name", "form"), "form").join(named, "name").select("phrase", "entry_id", "score", "edits", "context", "weight")

    said = spoken.select(F.col("key").alias("value"), "phrase")
    context_forms = contexts.select("name", "name").toDF("key", "name").mapInArrow(_expand(forms, None), "key string, phrase string, grams array<string>")
    spoken_context = said.join(context_forms.select(F.col("key").alias("said"), "phrase"), "phrase").groupBy("value").agg(F.collect_set("said").alias("said"))
    found = said.join(by_name, "phrase").join(spoken_context, "value", "left")
    agrees = F.col("said").isNull() | F.arrays_overlap("said", "context")
    found = found.where(agrees)
    order = F.struct(F.round("score", 9), -F.col("edits"), F.length("phrase"), "weight", -F.col("entry_id"))
    best = found.groupBy("value").agg(F.max_by(F.struct("entry_id", "score"), order).alias("b"))
    return distinct.join(best, "value", "left").select("value", F.coalesce("b.entry_id", F.lit(-1)).alias("entry_id"), F.coalesce("b.score", F.lit(0.0)).alias("score"))


def place_entries(places: DataFrame) -> DataFrame:
    """Entries of the table ``places``: names and alternative names, countries as context."""
    every = F.explode(F.concat(F.array("place_name"), F.coalesce("alt_names", F.array().cast("array<string>"))))
    context = F.array_compact(F.array("country_name", "country_code"))
    return places.select(F.col("place_id").alias("entry_id"), every.alias("name"), context.alias("context"), F.col("population").alias("weight"))
