"""Variant spellings of organisation names (problem 7), by canonical rewriting.

Every written name is reduced to core words and a kind (bank, software, ...), without legal
form, remarks and filler words, and every rewriting of it that people use is generated:
other word orders, the kind dropped or shortened, initials, the first word alone, nicknames,
and the spellings one slip away (as deletion forms). The forms are exploded and equi-joined.
A link is scored by the rarity of its rewriting: a form that several organisations could
have names one of them only if nearly all who write in full mean that one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestrata.llm.canonical import edits, fold
from lodestrata.session import materialize

#: Legal forms, written without dots.
LEGAL = set("ltd limited inc incorporated corp corporation llc llp lp plc gmbh ag kg ohg se sarl sas srl spa oy oyj ab nv bv sa pty pte co company kk".split())
#: Words that carry no name.
FILLER = set("the of and at von de der la le for".split())
#: Kinds of organisation with their usual short forms.
KINDS = {
    "technologies": "technology tech techs technol techn",
    "software": "softw soft sw",
    "systems": "system sys syst",
    "analytics": "analytic anal analyt",
    "logistics": "logistic log logist",
    "engineering": "eng engg engin engrg engr",
    "laboratories": "laboratory lab labs",
    "institute": "inst institut institution",
    "university": "uni univ universities",
    "foods": "food fds",
    "media": "med",
    "bank": "bk bnk banking",
    "consulting": "cons consult consultants consultancy consultant",
    "robotics": "robotic robots robot rob",
    "solutions": "solution sol",
    "services": "service svc svcs serv",
    "industries": "industry ind",
    "group": "grp",
    "networks": "network net",
    "partners": "partner",
    "studios": "studio",
    "energy": "energies",
    "insurance": "ins insur",
    "college": "coll",
    "international": "intl",
    "associates": "assoc assocs",
    "manufacturing": "mfg",
    "pharmaceuticals": "pharma pharm pharmaceutical",
}
_KIND = {w: k for k, short in KINDS.items() for w in [k, *short.split()]}
#: What people type who name no organisation.
NO_NAME = {
    "student", "retired", "none", "open source", "myself", "private", "n a", "na", "nil", "null", "looking for work", "looking for a job", "freelance", "freelancer",
    "freelancing", "self employed", "independent", "unemployed", "me", "home", "nobody", "no company", "nowhere", "personal", "hobbyist", "job seeker", "self", "various",
    "undefined", "unknown", "between jobs", "not applicable", "independent contractor", "contractor", "no", "test", "anonymous", "secret", "confidential", "other",
}

_NOTE = re.compile(r"\([^)]*\)|\[[^\]]*\]")
_DOTTED = re.compile(r"\b(?:[A-Za-z]\.){2,}")
_CAMEL = re.compile(r"(?<=[^\W\d_A-Z])(?=[A-Z][^\W\d_A-Z])")
_WORD = re.compile(r"[^\W_]+")


def _kind_of(word: str) -> str | None:
    known = _KIND.get(word)
    if known or len(word) < 3:
        return known
    return next((k for k in KINDS if abs(len(k) - len(word)) <= 1 and edits(word, k) <= 1), None)


def words_of(value: str) -> list[str]:
    """All words of a name but remarks and fillers, legal forms included."""
    text = _DOTTED.sub(lambda m: m.group().replace(".", ""), _NOTE.sub(" ", value))
    words = _WORD.findall(fold(_CAMEL.sub(" ", text)))
    return [w for w in words if w not in FILLER] or words


def parse(value: str) -> tuple[list[str], str | None] | None:
    """Core words in the order written, and the kind; None if no organisation is named."""
    plain = " ".join(_WORD.findall(fold(_NOTE.sub(" ", value))))
    if not plain or plain in NO_NAME:
        return None
    words = words_of(value)
    kept = [w for i, w in enumerate(words) if i == 0 or w not in LEGAL] or words
    exact = [w for w in kept if w in _KIND]
    kinds = exact or [w for w in kept[-1:] + kept[:1] if _kind_of(w)][:1]
    if kinds and len(kept) > 1:
        at = len(kept) - 1 - kept[::-1].index(kinds[-1])
        return kept[:at] + kept[at + 1 :], _kind_of(kinds[-1])
    return kept, None


def nickname(core: list[str]) -> str:
    """The first word up to its last vowel, with the start of the second word or a y."""
    stem = re.sub(r"[^aeiou]+$", "", core[0]) or core[0]
    return stem + (core[1][:3] if len(core) > 1 else "y")


def short_forms(core: list[str], kind: str) -> dict[str, int]:
    """Reduced writings of a full name with their grade, from 1 (the kind dropped) over
    initials and nicknames to 4 (the first word alone)."""
    out = {core[0]: 4, nickname(core): 3, "".join(w[0] for w in [*core, kind]): 3}
    out |= {f"{core[0]} {core[1][0]}": 3} if len(core) > 1 else {}
    out[f"{core[0]} {''.join(w[0] for w in [*core[1:], kind])}"] = 2
    out |= {" ".join(sorted(core)): 1, "".join(core): 1}
    return {x: g for x, g in out.items() if len(x) > 1}


def slips(text: str) -> set[str]:
    """The text and its single deletions: two texts one edit apart share one of these."""
    return {text, *(text[:i] + text[i + 1 :] for i in range(len(text)))}


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: list[list] = [[], [], [], [], [], []]
        for value, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if p := parse(value):
                core, kind = p
                for c, x in zip(cols, (value, n, " ".join(sorted(core)) + (f" #{kind}" if kind else ""), core, kind, " ".join(words_of(value)))):
                    c.append(x)
        kinds = [pa.string(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["value", "n", "key", "core", "kind", "said"])


def _exploded(make):
    """Rows (key, form, grade) of the forms ``make`` gives, with their grade or 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out, grades = [], [], []
            for key, core, kind in zip(*(c.to_pylist() for c in batch.columns)):
                made = make(core, kind)
                for f in made:
                    keys.append(key)
                    out.append(f)
                    grades.append(made[f] if isinstance(made, dict) else 0)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(out, pa.string()), pa.array(grades, pa.int32())], names=["key", "form", "grade"])

    return run


def together(core: list[str]) -> list[str]:
    """The name written together, from any of its words on."""
    return ["".join(core[i:] + core[:i]) for i in range(len(core))]


def _slipped(core: list[str], kind: str | None) -> set[str]:
    """Forms of which two names share one if they differ by an edit inside a word, whatever the
    order of their words, or by an edit or missing blanks where they are written on in turn.

    A form of L letters belongs to at most (L + 1) * alphabet names of one edit, so none is hot.
    Written on from any word, up to two words take every order, so edits inside them are there too.
    """
    tail = f"#{kind or ''}"
    words = sorted(core) if len(core) > 2 else []
    rest = [" ".join(words[:i] + words[i + 1 :]) for i in range(len(words))]
    inside = {f"{r}|{s}{tail}" for r, w in zip(rest, words) for s in slips(w)}
    return inside | {s + tail for f in together(core) for s in slips(f)}


def near(a: str, b: str) -> bool:
    """Whether two names (words as written, and kind) have the same kind and cores at most one edit apart."""
    (x, k), (y, m) = _split(a), _split(b)
    if k != m:
        return False
    left, right = Counter(x) - Counter(y), Counter(y) - Counter(x)
    if left.total() <= 1 and right.total() <= 1 and edits("".join(left), "".join(right)) <= 1:
        return True
    if abs(len("".join(x)) - len("".join(y))) > 1:
        return False
    return any(edits(p, q) <= 1 for p in together(x) for q in together(y))


def _near(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([near(x, y) for x, y in zip(a, b)], dtype=bool)


def _split(key: str) -> tuple[list[str], str | None]:
    core, _, kind = key.partition(" #")
    return core.split(" "), kind or None


def link_names(names: DataFrame, name: str, least_score: float = 0.9) -> DataFrame:
    """``value, entity``: the organisation each distinct written name means.

    ``entity`` is the canonical form of the organisation's most frequent full writing. Values
    that name no organisation (nulls, blanks, signs only, words for none) have no row. Names
    that are full (core words and a kind) and equal after rewriting are one; a name one slip
    away from a more frequent one joins it, and what that one joins. A reduced name could
    stand for every organisation one of whose rewritings it is; of those, the closest kind of
    rewriting counts. A rewriting's rarity for an organisation is that organisation's share of
    all rows written in full by the organisations that share it: the chance that it is meant.
    The reduced name joins the organisation if that is at least ``least_score``, else it stays
    on its own. Repeated rows count as frequency only; ties go to the smaller form. Other
    columns are ignored.
    """
    counts = names.select(F.col(name).cast("string").alias("value")).where(F.trim("value") != "").groupBy("value").agg(F.count("*").alias("n"))
    parsed = materialize(counts.mapInArrow(_parsed, "value string, n long, key string, core array<string>, kind string, said string"), "names")
    keyed = materialize(parsed.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("spellings"), F.min(F.struct("core", "kind")).alias("x")).select("key", "n", "spellings", "x.*"), "keys")
    schema = "key string, form string, grade int"
    # one slip away: deletion forms, equi-joined and verified; the less frequent key follows the more frequent
    # keys and forms travel as hashes; a key's forms are a set, and what meets by chance is not near
    slip = keyed.select("key", "core", "kind").mapInArrow(_exploded(_slipped), schema).select(F.xxhash64("key").alias("id"), F.xxhash64("form").alias("form"))
    a, b = slip.select(F.col("id").alias("id_a"), "form"), slip.select(F.col("id").alias("id_b"), "form")
    met = _merge(a, b, "form").where("id_a <> id_b").select("id_a", "id_b").distinct()
    text = F.concat_ws(" #", F.array_join("core", " "), "kind")
    w = lambda p: keyed.select(F.xxhash64("key").alias(f"id_{p}"), F.col("key").alias(p), F.struct("n", "spellings").alias(f"w{p}"), text.alias(f"text_{p}"))
    met = _merge(_merge(met, w("a"), "id_a"), w("b"), "id_b").where((F.col("wa") < F.col("wb")) | ((F.col("wa") == F.col("wb")) & (F.col("a") > F.col("b"))))
    met = met.where(F.pandas_udf(_near, "boolean")("text_a", "text_b"))
    follow = _ends(met.groupBy("a").agg(F.max_by("b", F.struct("wb", F.col("b"))).alias("to")))
    settled = materialize(_merge(keyed, follow.select(F.col("a").alias("key"), F.col("to").alias("entity")), "key", "left").withColumn("entity", F.coalesce("entity", "key")), "settled")
    # every order in which an organisation was written has reduced forms of its own
    of = settled.select("key", "entity")
    orders = _merge(parsed.where("kind is not null").select("key", "core", "kind").distinct(), of, "key")
    weight = settled.where("kind is not null").groupBy("entity").agg(F.sum("n").alias("n"))
    forms = _merge(orders.select("entity", "core", "kind").mapInArrow(_exploded(short_forms), schema).distinct().withColumnRenamed("key", "entity"), weight, "entity")
    rare = forms.groupBy("form", "grade").agg(F.sum("n").alias("sharing"), F.max(F.struct("n", F.col("entity"))).alias("top"))
    # a legal form may also be initials, so the name is looked up with it as well
    short = parsed.where("kind is null").select("key", "core", "said").distinct()
    reduced = short.select("key", F.explode(F.array_distinct(F.array("said", "key", F.array_join("core", " "), F.array_join("core", "")))).alias("form")).distinct()
    score = F.col("top.n") / F.col("sharing")
    best = _merge(reduced, rare, "form").groupBy("key").agg(F.min_by(F.struct(score.alias("score"), F.col("top.entity").alias("to")), F.struct("grade", -score, "top.entity")).alias("x"))
    joined = materialize(best.where(F.col("x.score") >= least_score).select("key", F.col("x.to").alias("to")), "joined")
    # a reduced name that follows another one goes where that one goes
    entity = _merge(_merge(of, joined, "key", "left"), joined.select(F.col("key").alias("entity"), F.col("to").alias("further")), "entity", "left")
    entity = entity.select("key", F.coalesce("to", "further", "entity").alias("entity"))
    return _merge(parsed.select("value", "key"), entity, "key").select("value", "entity")


def _merge(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join of two sides that both grow with the names, never broadcast.

    By its own estimate Spark would: it knows the size of the compressed files that a side
    starts from, but not how many forms Python makes of each name, and a join once planned as
    a broadcast stays one when the real size is known. The driver builds what is broadcast.
    """
    return left.join(right.hint("merge"), on, how)


def _ends(follow: DataFrame) -> DataFrame:
    """``a, to`` with every ``to`` replaced by the end of the chain of follows it is in.

    What is followed is always the more frequent, so there are no rings; every round doubles
    the jumps, so a chain of n takes log2(n) rounds.
    """
    while True:
        follow = materialize(follow, "follows")
        on = follow.select(F.col("a").alias("to"), F.col("to").alias("far"))
        if _merge(follow, on, "to", "left_semi").limit(1).count() == 0:
            return follow
        follow = _merge(follow, on, "to", "left").select("a", F.coalesce("far", "to").alias("to"))


def variant_pairs(linked: DataFrame) -> DataFrame:
    """``name_a < name_b`` (by code point), both naming the same organisation."""
    a, b = linked.select(F.col("value").alias("name_a"), "entity"), linked.select(F.col("value").alias("name_b"), "entity")
    return _merge(a, b, "entity").where("name_a < name_b").select("name_a", "name_b")
