"""Personal information inside free text (problem 6): information-theoretic sanitisation.

Patterns only propose. They propose values with a form of their own (addresses of mail,
phones, numbers of persons, streets) and, as possible names, every capitalised term. What is
replaced is decided by how strongly terms reveal a protected entity, estimated from the
co-occurrences of the whole corpus as pointwise mutual information, in bits:

- a value with a form, by its features (its shape in digits and signs, the word before it, the
  words of a street): the rate at which a feature occurs in values of a kind, against the rate
  of that kind in the corpus;
- a name, by its term: how often it stands with an email address that spells it, against how
  often any term does; and by its context (the two words before it, or an address right
  behind it): the share of the context's terms that disclose.

Every distinct text is read once. Its candidates, with all that a decision may need, become
rows; learning and deciding are aggregates and joins of these rows, exact at every size.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lodestrata.llm.canonical import fold
from lodestrata.session import materialize

#: A term must co-occur this often with what it discloses, with this many bits.
LEAST_EVENTS = 2
LEAST_BITS = 4.0
#: Shares of a term's occurrences that disclose, by an address or also by a telling context, from which the bits do
#: not matter: where much of a corpus discloses, no term can reach them.
SURE_RATE = 1 / 16
SURE_TOLD = 1 / 2
#: Least occurrences of a context, and share of its terms that disclose.
LEAST_CONTEXT = 4
LEAST_SHARE = 0.4
#: A feature of a form discloses its kind from this rate or these bits on.
SURE_FORM = 1 / 2
FORM_BITS = 3.0

#: Words before a number that identifies a person.
ID_LABELS = (
    r"ssn|social security(?: number| no\.?)?|nino|ni number|national insurance(?: number| no\.?)?|tax id|tin|(?:personal )?tax (?:number|no\.?)"
    r"|identity card|identity number|national id|id card|id number|passport(?: number)?|dni|nie|nif|cpf|steuer-?id|steuernummer|codice fiscale|personalausweis|ausweis|пасспорт|паспорт|инн|снилс|身份证|护照"
)
#: Words that begin or end a street address.
STREET_ENDS = "Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Drive|Dr|Row|Close|Court|Ct|Way|Place|Pl|Square|Sq|Terrace|Crescent|Boulevard|Blvd|Gardens|Grove|Hill|Walk|Mews|Parade|Alley"
STREET_STARTS = r"Calle|C/|Avenida|Avda\.?|Av\.|Plaza|Pza\.?|Paseo|Camino|Carrera|Ronda|Rua|R\.|Travessa|Praça|Largo|Estrada|Alameda|Via|Viale|Piazza|Corso|Vicolo|Strada"
FRENCH_STREETS = r"rue|chemin|avenue|av\.|bd|boulevard|place|allée|allee|impasse|quai|route|cours|passage|ruelle|square"
GERMAN_ENDS = r"straße|strasse|str\.|gasse|weg|allee|platz|graben|ring|damm|ufer|steig|markt|pfad|hof"
GERMAN_STARTS = r"Am|An der|An den|Auf der|Auf dem|Im|In der|Zum|Zur|Hinterer|Hintere|Vorderer|Vordere|Alter|Alte|Neuer|Neue|Unterer|Untere|Oberer|Obere|Kleine|Große|Langer|Lange"
#: Words that make a capitalised run the name of an organisation.
ORGANISATION = {"inc", "ltd", "llc", "gmbh", "ag", "corp", "co", "foundation", "team", "project", "labs", "authors", "contributors", "group", "institute", "university", "software", "systems", "technologies", "bank", "media", "laboratories", "robotics", "consulting", "analytics", "logistics", "engineering", "foods"}

_AT = r"(?:\s?@\s?|\s?(?:\(at\)|\[at\]|\{at\}|<at>)\s?|\s(?:at|AT)\s(?=[\w-]+(?:\s?[(\[{]dot[)\]}]|\s(?:dot|DOT)\s)))"
_DOT = r"(?:\.|\s?(?:\(dot\)|\[dot\]|\{dot\})\s?|\s(?:dot|DOT)\s)"
EMAIL = re.compile(rf"(?<![\w.+@/-])([A-Za-z0-9](?:[\w.+-]*[A-Za-z0-9])?){_AT}([A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}})(?![\w@])", re.I)
_LOGIN = re.compile(r"(?:\b(?:ssh|scp|sftp|rsync|git\s+clone|clone)\s(?:-\S+\s)*|://)$", re.I)
_HEAD, _TAIL = r"(?<![\w.\-/:,+(])", r"(?![\w/]|[-.:,]\d)"
PHONE = re.compile(
    rf"{_HEAD}(?:\+\d{{1,3}}[\s.\-]?(?:\(\d{{1,4}}\)[\s.\-]?)?\d(?:[\s.\-]?\d){{6,12}}|\(\d{{2,5}}\)\s?\d{{3,4}}[\s.\-]?\d{{3,4}}"
    rf"|0\d(?:[ .\-]\d\d){{4}}|\d{{3}}[-.]\d{{3}}[-.]\d{{4}}|00[1-9]\d[-. ]\d{{2,4}}[-. ]\d{{3,8}}(?:[-. ]\d{{1,4}})?|0\d{{2,4}}[ /]\d{{3,4}}[ -]?\d{{3,4}}){_TAIL}"
)
ID_LABELLED = re.compile(rf"\b(?i:{ID_LABELS})\b[\s:.#№-]*(?:\b(?i:no|nr|number)\b[\s:.#]*)?((?:[A-Z]{{1,3}}[ -]?)?\d+(?:[ -]\d+)*[A-Z]?)(?![\w])")
ID_SHAPE = re.compile(r"(?<![\w-])(?:\d{3}-\d{2}-\d{4}|[A-Z]{2} \d{2} \d{2} \d{2} [A-D]|[A-Z]{2}-\d{6}-\d)(?![\w-])")
_FLAT = r"(?:(?:Flat|Apt|Apartment|Unit|Suite|Room)\.?\s+\w{1,4},\s+)?"
_LINK_WORDS = r"(?:(?:de|del|da|do|das|dos|della|dei|degli|di|la|las|los|el)\s+){0,3}"
ADDRESS = re.compile(
    rf"{_FLAT}(?<![\w.\-/:#])\d{{1,4}}[A-Za-z]?,?\s+(?:[A-Z][\w'’-]+\s+){{1,3}}(?:{STREET_ENDS})\b\.?(?:,\s+[A-Z]\w+(?:\s+\d{{4,6}}\b)?)?"
    rf"|(?<![\w])(?:{STREET_STARTS})\s+{_LINK_WORDS}[A-ZÀ-Þ][\w'’-]+(?:\s+{_LINK_WORDS}[A-ZÀ-Þ][\w'’-]+){{0,3}},?\s+(?:n\.?º?\s*)?\d{{1,4}}[a-z]?\b(?:,\s+\d{{1,2}}º\s?\w)?(?:,\s+\d{{4,5}}(?:-\d{{3}})?\s+[A-Z]\w+)?"
    rf"|(?<![\w.\-/:#])\d{{1,4}}[a-z]?(?:\s(?:bis|ter))?,?\s+(?:{FRENCH_STREETS})\s+(?:de\s+la\s+|de\s+l['’]|des\s+|du\s+|de\s+|d['’]|la\s+)?[A-ZÀ-Þ][\w'’-]+(?:\s+[A-ZÀ-Þ][\w'’-]+)?(?:,\s+\d{{5}}\s+[A-Z]\w+)?"
    rf"|(?<![\w])(?:[A-ZÄÖÜ][a-zäöüß]+(?:{GERMAN_ENDS})|(?:{GERMAN_STARTS})\s+[A-ZÄÖÜ][a-zäöüß]+)\s+\d{{1,4}}[a-z]?\b(?:,\s+\d{{5}}\s+[A-Z]\w+)?"
    r"|(?:ул\.|улица|пр\.|проспект|пер\.|переулок)\s+[А-Я][\w-]+,?\s+(?:д\.\s*)?\d{1,4}|[一-鿿]{2,8}(?:路|街|大道)\d{1,4}号"
)
_FENCE = re.compile(r"^[ \t>]*(```|~~~).*?(?:^[ \t>]*\1[^\n]*$|\Z)", re.M | re.S)
_COMMENT = re.compile(r"[ \t]*(?:#+|//+|--|;+|/?\*+|<!--|%+)[ \t]")
#: Letters that begin a name, and those that go on.
_UP, _LOW = "A-ZÀ-ÖØ-ÞŠŽČĆĐŁŚŹŻŃŐŰĞİŞА-ЯЁ", "a-zß-öø-ÿā-žа-яё'’"
_CAP = re.compile(rf"(?<![\w@.+/-])(?:[{_UP}](?:[{_LOW}]+(?:-[{_UP}][{_LOW}]+)*|\.))(?![\w@])")
_WORD = rf"[{_UP}][{_LOW}]+(?:-[{_UP}][{_LOW}]+)*"
_RUN = rf"(?:(?:{_WORD}|[{_UP}]\.),? )"
_EARLIER = re.compile(rf"(?<![\w@.+/,-]){_RUN}{{1,2}}$")
_BEFORE_EMAIL = re.compile(rf"(?<![\w@.+/,-])({_RUN}{{1,3}})<$")
_BEFORE_ADDRESS = re.compile(rf"(?:^|[\n.!?。！？|>#:/;]\s*|^\W+\s*)({_RUN}{{0,2}}{_WORD}), $")
_LAST_FIRST = re.compile(rf"(?<![\w@.+/-])({_WORD}), $")
_REST = re.compile(rf"(?: [{_UP}]\.)*(?: (?:van |von |de |da |del |di )?{_WORD})?")
_AFTER_LAST = re.compile(rf", ([{_UP}][{_LOW}]+)")
#: A number with its signs, and what has a sign of mail in it: the places where a value may be.
_NUMBER = re.compile(r"[+(]?\d(?:[\d ().,:/+-]*\d)?")
_MAIL = re.compile(r"(?<![\w.+-])[\w.+-]+@[\w.-]+")
_DIGIT = re.compile(r"\d")
_NO_LETTER = re.compile(r"[\W\d_]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_LOCAL = re.compile(r"[a-z]{3,}")


def _blank(m: re.Match) -> str:
    """Blanks for code, except for its comment lines, which are prose."""
    return "\n".join(x if _COMMENT.match(x) else " " * len(x) for x in m.group().split("\n"))


def _has_email(text: str) -> bool:
    if "@" in text:
        return True
    low = text.lower()
    return "at)" in low or "at]" in low or "at}" in low or (" at " in low and " dot " in low)


def patterned(text: str, plain: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of values with a form of their own; ``plain`` is the text with blanks for code."""
    out: list[tuple[int, int, str]] = []
    if _has_email(text):
        for m in EMAIL.finditer(text):
            after = text[m.end() : m.end() + 2]
            if m.group(1).lower() == "git" or (after[:1] == ":" and after[1:2].strip()) or _LOGIN.search(text[max(0, m.start() - 24) : m.start()]):
                continue
            if " at " in m.group() and not re.search(r"[\d._+-]", m.group(1)):
                continue  # plain words, as in "look at this dot"
            out.append((m.start(), m.end(), "email"))
    at = 0
    for line in plain.split("\n"):
        if _DIGIT.search(line):
            taken = [(s - at, e - at) for s, e, _ in out if s >= at]
            free = lambda s, e: all(e <= a or s >= b for a, b in taken)  # noqa: B023, E731
            for kind, pattern, group in (("id_number", ID_SHAPE, 0), ("id_number", ID_LABELLED, 1), ("phone", PHONE, 0), ("street_address", ADDRESS, 0)):
                for m in pattern.finditer(line):
                    s, e = m.span(group)
                    if sum(c.isdigit() for c in m.group(group)) >= (1 if kind == "street_address" else 6) and free(s, e):
                        taken.append((s, e))
                        out.append((at + s, at + e, kind))
        at += len(line) + 1
    return sorted(out)


def words_before(plain: str, start: int) -> list[str]:
    """The one or two words before a place on its line, within 40 characters; none unless a blank parts them."""
    seg = plain[max(plain.rfind("\n", 0, start) + 1, start - 40) : start]
    return seg.split()[-2:] if seg[-1:] in (" ", "\t") else []


def context_of(plain: str, start: int) -> str:
    """The one or two words before a term, digits as 0; empty at the start of a line or sentence."""
    words = words_before(plain, start)
    if not words or words[-1][-1] in ".!?:;。！？|/#" or words[-1][0].isupper():
        return ""
    return _DIGIT.sub("0", " ".join(words)).lower()


def _spelled(term: str, local: str) -> bool:
    """Whether the local part of an address spells the term."""
    t = fold(term).replace("'", "").replace("’", "")
    return len(t) >= 3 and any(t == p or (len(t) >= 4 and p.endswith(t) and len(p) <= len(t) + 2) for p in _LOCAL.findall(local))


def _disclosed(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Stretches around email addresses with the addresses' local parts."""
    out = []
    for s, e, kind in spans:
        if kind == "email":
            m = EMAIL.match(text, s)
            out.append((s - 70, s, (m.group(1) if m else "").lower()))
    return out


#: Columns of a candidate: its text, what it is (``cap`` a term, ``run`` the terms before an address, ``span`` a value
#: with a form, ``mark`` a feature), and where a name that begins with it would begin or end in each case.
ROW = "h1 long, h2 long, copies long, what string, kind string, term string, context string, s int, e int, n int, near boolean, back int, early int, follow string, follow_e int, rest int, org int"
_TYPES = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
_FIELDS = [tuple(f.strip().split(" ")) for f in ROW.split(",")]


def _organised(plain: str, s: int, e: int) -> bool:
    """Whether the run, with the word behind it, names an organisation."""
    run = plain[s:e]
    if ORGANISATION.isdisjoint(_LETTERS.findall(plain[s : e + 14].lower())):
        return False
    words = _LETTERS.findall(run + " " + plain[e : e + 14].split("\n")[0])
    return any(w.lower() in ORGANISATION for w in words[: len(run.split()) + 1])


def features(kind: str, value: str, before: str) -> list[str]:
    """What tells a value with a form: its shape, the word before it; of a street its words."""
    if kind == "street_address":
        return [f"street {w.lower()}" for w in re.findall(r"[^\W\d_]{2,}", value)] or ["street"]
    if kind == "email" or "@" in value:
        return [f"mail {before}", "sign " + ("@" if "@" in value else "at"), "host " + re.sub(r".*[@\s)\]}]", "", value).lower()]
    return [f"word {before}", "shape " + _DIGIT.sub("0", value)[:24]]


def scan(text: str) -> list[tuple]:
    """The candidates of a text, as ``ROW`` without the first three columns."""
    plain = _FENCE.sub(_blank, text) if "```" in text or "~~~" in text else text
    spans = patterned(text, plain)
    near = _disclosed(text, spans) if spans else []
    rows: list[tuple] = []
    marks: Counter = Counter()

    def word_before(at: int) -> str:
        words = words_before(plain, at)
        return _NO_LETTER.sub("", words[-1].lower()) if words else ""

    for s, e, kind in spans:
        trim = s
        while trim > 0 and text[trim - 1] in " ,<":
            trim -= 1
        rows.append(("span", kind, None, None, s, e, 1, None, trim, None, None, None, None, None))
        rows += [("mark", kind, f, None, s, e, 1, None, None, None, None, None, None, None) for f in dict.fromkeys(features(kind, text[s:e], word_before(s)))]
        # whoever stands right before an address, of mail or of a street
        before = {"email": _BEFORE_EMAIL, "street_address": _BEFORE_ADDRESS}.get(kind)
        lo = max(0, s - 64, plain.rfind("\n", 0, s) + 1)
        if before and (m := before.search(plain[lo:s])):
            run = m.group(1).rstrip(" ,")
            rows.append(("run", "person_name", run, f">{kind}", lo + m.start(1), lo + m.start(1) + len(run), 1, None, None, None, None, None, None, None))
    for pattern in (_NUMBER, _MAIL) if "@" in plain else (_NUMBER,):
        at = 0
        for m in pattern.finditer(plain):
            while at < len(spans) and spans[at][1] <= m.start():
                at += 1
            if at == len(spans) or spans[at][0] >= m.end():
                marks.update(features("", m.group(), word_before(m.start())))
    rows += [("mark", "", f, None, -1, -1, n, None, None, None, None, None, None, None) for f, n in marks.items()]
    streets = [(a, b) for a, b, kind in spans if kind == "street_address"]
    before = -9
    for m in _CAP.finditer(plain):
        s, e = m.span()
        # the patterns are asked only where the signs they need are there
        last = _LAST_FIRST.search(plain, max(0, s - 60), s) if plain[s - 2 : s] == ", " else None
        early = _EARLIER.search(plain, max(0, s - 50), s) if before in (s - 1, s - 2) else None
        follow = _AFTER_LAST.match(plain, e) if plain[e : e + 2] == ", " else None
        before = e
        back, begin = last.start() if last else -1, early.start() if early else -1
        follow_e, rest = follow.end() if follow else -1, _REST.match(plain, e).end() if plain[e : e + 1] == " " else e
        org = (begin >= 0 and _organised(plain, begin, e)) + 2 * (follow_e >= 0 and _organised(plain, s, follow_e)) + 4 * _organised(plain, s, rest)
        spelled = any(a <= s < b and _spelled(m.group(), local) for a, b, local in near)
        rows.append(("cap", "street_address" if streets and any(a <= s < b for a, b in streets) else "", m.group(), context_of(plain, s), s, e, 1, spelled, back, begin, follow.group(1) if follow else None, follow_e, rest, org))
    return rows


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, len(whole), 1000):
            batch = whole.slice(at, 1000)
            rows: list[tuple] = []
            for key, text in zip(zip(*(batch.column(i).to_pylist() for i in (0, 1, 2))), batch.column(3).to_pylist()):
                rows += [(*key, *r) for r in scan(text)]
            columns = list(zip(*rows)) or [()] * len(_FIELDS)
            yield pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(columns, _FIELDS)], names=[n for n, _ in _FIELDS])


def _hashes(text: str) -> list[Column]:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def candidates(texts: DataFrame, text: str) -> DataFrame:
    """The candidates of every distinct text (``ROW``), read once; null and empty texts have none."""
    once = texts.where(F.col(text) != "").groupBy(*_hashes(text)).agg(F.first(text).alias("text"), F.count("*").alias("copies"))
    return materialize(once.select("h1", "h2", "copies", "text").mapInArrow(_scanned, ROW), "candidates")


@dataclass(frozen=True)
class Learned:
    """``terms`` (term) and ``contexts`` (context) that disclose persons; ``features`` (kind, term,
    discloses) of values with a form."""

    terms: DataFrame
    contexts: DataFrame
    features: DataFrame


def learn(found: DataFrame) -> Learned:
    """What discloses, from the candidates of a corpus.

    Rates are those over distinct texts, so that a text copied often weighs no more than
    another; how often something occurs at least is counted over all rows.
    """
    total = lambda *names: [F.sum(c).alias(c) for c in names]
    over = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    caps = found.where("what = 'cap' and length(term) > 2").select("context", "term", F.lit(1).alias("n"), F.col("near").cast("int").alias("events"), "copies")
    pairs = caps.groupBy("context", "term").agg(*total("n", "events"), F.sum("copies").alias("all_n"), F.sum(F.col("events") * F.col("copies")).alias("all_events"))
    pairs = materialize(pairs, "terms")
    every = pairs.agg(*total("n", "events")).first()
    n, events = every[0] or 0, every[1] or 0
    rate = F.col("events") / F.col("n")
    discloses = lambda base, sure: (rate >= sure) | (F.log2(rate / F.lit(base)) >= LEAST_BITS)
    terms = pairs.groupBy("term").agg(*total("n", "events", "all_events"))
    loud = materialize(terms.where((F.col("all_events") >= LEAST_EVENTS) & discloses(max(events, 1) / max(n, 1), SURE_RATE)).select("term"), "loud")
    loudly = loud.withColumn("loud", F.lit(1))
    hits = lambda c: F.sum(F.when(F.col("loud") == 1, F.col(c)).otherwise(0))
    marked = pairs.where("context <> ''").select("context", "term", "n", "all_n").join(loudly, "term", "left")
    # the words before an address are a context as well, in which they disclose together
    runs = found.where("what = 'run'").select("h1", "h2", "s", "copies", "context", F.explode(F.split("term", r"[ ,]+")).alias("term")).join(loudly, "term", "left")
    runs = runs.groupBy("h1", "h2", "s", "context").agg(F.lit(1).alias("n"), F.max("copies").alias("all_n"), F.max("loud").alias("loud"))
    marked = marked.select("context", "n", "all_n", "loud").unionByName(runs.select("context", "n", "all_n", "loud"))
    contexts = marked.groupBy("context").agg(*total("n", "all_n"), hits("n").alias("hits"), hits("all_n").alias("all_hits"))
    telling = contexts.where((F.col("all_n") >= LEAST_CONTEXT) & (F.col("hits") >= LEAST_SHARE * F.col("n")) & (F.col("all_hits") >= 3)).select("context")
    telling = materialize(telling, "contexts")
    # a term also co-occurs with a person where it follows a telling context
    follows = lambda events, n: F.greatest(events, F.when(F.col("told") == 1, F.col(n)).otherwise(0)).alias(events)
    seen = pairs.join(telling.withColumn("told", F.lit(1)), "context", "left").select("term", "n", follows("events", "n"), follows("all_events", "all_n"))
    seen = seen.groupBy("term").agg(*total("n", "events", "all_events"))
    base = seen.agg(over(F.sum("events"), F.sum("n"))).first()[0] or 1.0
    strong = (F.col("all_events") > LEAST_EVENTS) & discloses(base, SURE_TOLD)
    terms = materialize(loud.unionByName(seen.where(strong).select("term")).distinct(), "disclosing")
    # features: the share of a feature's places that hold a value of the kind, against all places' share;
    # a street's words are places wherever they are capitalised
    words = found.where("what = 'cap' and kind = ''").select(F.lit("").alias("kind"), F.concat(F.lit("street "), F.lower("term")).alias("term"), "n")
    marks = found.where("what = 'mark'").select("kind", "term", "n").unionByName(words).groupBy("kind", "term").agg(F.sum("n").alias("n"))
    family = F.when(F.col("term").startswith("street"), "street").when(F.col("term").startswith("shape") | F.col("term").startswith("word"), "number").otherwise("mail")
    marks = materialize(marks.withColumn("family", family), "marks")
    places = marks.groupBy("family").agg(F.sum("n").alias("places"))
    kinds = marks.where("kind <> ''").groupBy("family", "kind").agg(F.sum("n").alias("values"))
    by = marks.groupBy("family", "term").agg(F.sum("n").alias("of_term"))
    joined = marks.where("kind <> ''").join(by, ["family", "term"]).join(kinds, ["family", "kind"]).join(places, "family")
    share = F.col("n") / F.col("of_term")
    bits = F.log2(share / (F.col("values") / F.col("places")))
    return Learned(terms, telling, materialize(joined.select("kind", "term", ((share >= SURE_FORM) | (bits >= FORM_BITS)).alias("discloses")), "features"))


#: What of a candidate decides: the columns of ``decide``.
EVIDENCE = ["what", "kind", "s", "e", "loud", "near", "back", "early", "follow_e", "rest", "org"]


def decide(evidence: list[tuple]) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the values of one text, from its ``EVIDENCE``: values with a form, terms
    that disclose or are disclosed (each with the whole name around it), and names before addresses."""
    spans = sorted((s, e, kind, back) for what, kind, s, e, _, _, back, *_ in evidence if what == "span")
    out: list[tuple[int, int, str]] = []
    end = -1
    for _, _, s, e, loud, near, back, early, follow_e, rest, org in sorted((x for x in evidence if x[0] == "cap"), key=lambda x: x[2]):
        if s < end:
            continue
        if loud and back >= max(end, 0):
            s = back
        elif near and not loud and early >= max(end, 0):
            s, org = early, org & 1
        elif not loud and follow_e >= 0:
            e, org = follow_e, org & 2
        else:
            e, org = rest, org & 4
        if org and not loud:
            continue
        over = [(a, trim) for a, b, _, trim in spans if s < b and e > a]
        if over:
            first, trim = min(over)
            if first <= s:
                continue
            e = trim
        if e > s:
            out.append((s, e, "person_name"))
            end = e
    for what, kind, s, e, *_ in evidence:
        if what == "run" and not any(a < e and b > s for a, b, *_ in [*out, *spans]):
            out.append((s, e, kind))
    return sorted([*out, *((s, e, kind) for s, e, kind, _ in spans)])


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("kind", pa.string())]))
    for batch in batches:
        out = [decide([tuple(x[c] for c in EVIDENCE) for x in rows]) for rows in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([[dict(zip("se", x), kind=x[2]) for x in rows] for rows in out], kind)], names=["h1", "h2", "found"])


def _values(found: DataFrame, learned: Learned) -> DataFrame:
    """``h1, h2, found``: the values of each text that has any."""
    key = ["h1", "h2", "s"]
    known = found.where("what = 'mark' and kind <> ''").select(*key, "kind", "term").join(learned.features, ["kind", "term"], "left")
    # what the corpus does not know is judged by itself: all its places hold the value
    told = known.groupBy(*key, "kind").agg(F.max(F.coalesce("discloses", F.lit(True))).alias("discloses")).where("discloses")
    spans = found.where("what = 'span'").join(told.select(*key, "kind"), [*key, "kind"], "left_semi").withColumn("loud", F.lit(False))
    runs = found.where("what = 'run'").join(learned.contexts, "context", "left_semi").withColumn("loud", F.lit(False))
    caps = found.where("what = 'cap'")
    caps = caps.join(learned.terms.select("term", F.lit(True).alias("is_loud")), "term", "left").join(learned.contexts.select("context", F.lit(True).alias("told")), "context", "left")
    caps = caps.withColumn("loud", F.coalesce("is_loud", F.lit(False)) & (F.length("term") > 2)).where("loud or near or told")
    caps = caps.join(learned.terms.select(F.col("term").alias("follow"), F.lit(True).alias("followed")), "follow", "left")
    caps = caps.withColumn("follow_e", F.when(F.col("followed"), F.col("follow_e")).otherwise(-1))
    keep = ["h1", "h2", F.struct(*EVIDENCE).alias("x")]
    each = spans.select(*keep).unionByName(runs.select(*keep)).unionByName(caps.select(*keep))
    by = each.groupBy("h1", "h2").agg(F.collect_list("x").alias("evidence"))
    return materialize(by.mapInArrow(_decided, "h1 long, h2 long, found array<struct<s:int,e:int,kind:string>>"), "values")


def find(text: str, terms: set[str], contexts: set[str]) -> list[tuple[int, int, str]]:
    """The values of one text, given the terms and contexts that disclose; features unknown to the corpus."""
    evidence = []
    for what, kind, term, context, s, e, _, near, back, early, follow, follow_e, rest, org in scan(text) if text else []:
        loud = what == "cap" and len(term) > 2 and term in terms
        if what == "span" or (what == "run" and context in contexts) or (what == "cap" and (loud or near or context in contexts)):
            evidence.append((what, kind, s, e, loud, near, back, early, follow_e if follow in terms else -1, rest, org))
    return decide(evidence)


def personal_values(texts: DataFrame, keys: list[str], text: str, learned: Learned, found: DataFrame | None = None) -> DataFrame:
    """``keys`` and one row per personal value: ``kind, start_pos, end_pos`` (characters from 1, inclusive).

    Kinds: ``email, phone, id_number, street_address, person_name``. Labels and titles are no
    part of a value; logins at hosts are no emails. Null and empty texts give no rows,
    repeated rows give repeated results. Texts are read whole; ``found`` are their
    candidates if they have been read already.
    """
    values = _values(found if found is not None else candidates(texts, text), learned)
    each = texts.where(F.col(text) != "").select(*keys, *_hashes(text)).join(values, ["h1", "h2"])
    return each.select(*keys, F.explode("found").alias("f")).select(*keys, "f.kind", (F.col("f.s") + 1).cast("long").alias("start_pos"), F.col("f.e").cast("long").alias("end_pos"))


def sanitize(texts: DataFrame, keys: list[str], text: str, learned: Learned, found: DataFrame | None = None) -> DataFrame:
    """``keys`` and ``text`` with every personal value replaced by ``[EMAIL]``, ``[PHONE]``,
    ``[ID_NUMBER]``, ``[STREET_ADDRESS]`` or ``[PERSON_NAME]``, and ``replaced``, their number.
    A null text stays null."""
    values = _values(found if found is not None else candidates(texts, text), learned)
    keyed = texts.select(*keys, F.col(text).alias("__text"), *_hashes(text)).join(values, ["h1", "h2"], "left")
    piece = lambda at, e: F.substr("__text", at + 1, e - at)
    # one step per value: the text up to it and its placeholder
    step = lambda acc, v: F.struct(F.concat(acc["out"], piece(acc["at"], v["s"]), F.lit("["), F.upper(v["kind"]), F.lit("]")).alias("out"), v["e"].alias("at"))
    done = F.aggregate(F.coalesce("found", F.array().cast("array<struct<s:int,e:int,kind:string>>")), F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step)
    keyed = keyed.withColumn("__done", done)
    clean = F.when(F.col("found").isNull(), F.col("__text")).otherwise(F.concat("__done.out", piece(F.col("__done.at"), F.length("__text"))))
    return keyed.select(*keys, clean.alias(text), F.coalesce(F.size("found"), F.lit(0)).alias("replaced"))
