"""Document and segment languages (problem 4): nearest of several centroids per language.

A word is the normalised TF-IDF vector of its letter runs (one to four letters, with the
word's edges, the whole word, and its script; runs that all languages use alike weigh
little), a sentence the sum of its words, each weighted by the root
of its length. Sentences, centred and of unit length, are compared by cosine with clustered
centroids of every language; a sentence whose distance to the nearest centroid is beyond what
that language's own sentences show is rejected, and so is one nearer to another language than
its text's, unless clearly so. Cosines need a vector's part along the centroids, which is kept
per word, and its length; the length of the rest is taken from ``SKETCH`` random directions.

The classifier is fitted on at most ``SAMPLE_ROWS`` labelled documents per language. Labels
may be wrong: sentences nearer to another language's centroid than to their own leave the
fit before the centroids are clustered. Everything else covers every sentence of every text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from lodestrata.llm.prose import WORD, sentences

#: Labelled documents per language, and sentences of one document, used for the fit.
SAMPLE_ROWS = 250
SAMPLE_SENTENCES = 16
#: Hashed dimensions, and centroids per language.
DIMENSIONS = 1 << 14
CLUSTERS = 6
#: Random directions from which the length of what no centroid accounts for is estimated (to about 1 / sqrt(2 * SKETCH)).
SKETCH = 24
#: A language's least cosine, as a share of the second percentile of its own sentences.
FLOOR = 0.3
#: Words that make a phrase count without the end mark of a sentence.
PHRASE_WORDS = 5
#: Least lead of the best language, as a share of its cosine, for a sentence to count.
LEAST_LEAD = 0.12
#: Least lead of another language over the main language of the text, and for sentences of fewer than SHORT words.
SWITCH_LEAD, SHORT_LEAD, SHORT = 0.4, 0.7, 6
#: Floors that a sentence in another language than its text's has to reach.
SWITCH_FLOORS = 1.5

#: Names under which a language is declared, by two-letter code. Codes may carry a region.
NAMES = {
    "en": "eng english",
    "es": "spa spanish español espanol castellano castilian",
    "pt": "por portuguese português portugues",
    "fr": "fra fre french français francais",
    "de": "deu ger german deutsch",
    "it": "ita italian italiano",
    "ru": "rus russian русский",
    "zh": "zho chi chinese 中文 汉语 普通话 mandarin cmn",
}
#: What is written where the language is not known.
UNKNOWN = ["", "und", "unknown", "unk", "undetermined", "none", "null", "n/a", "na", "?", "-", "mul", "zxx", "xx", "other", "auto"]


def declared(lang: Column) -> Column:
    """Two-letter code of a declared language; null if missing or a word for unknown; the cleaned text if of no known language."""
    clean = F.lower(F.trim(lang))
    head = F.regexp_extract(clean, r"^([^-_]*)", 1)
    pairs = [(w, code) for code, names in NAMES.items() for w in [code, *names.split()]]
    known = F.create_map(*(F.lit(x) for p in pairs for x in p))
    return F.when(clean.isNull() | clean.isin(UNKNOWN), None).otherwise(F.coalesce(F.try_element_at(known, head), clean))


def letter_runs(word: str) -> list[str]:
    """The runs of one to four letters of a lower-case word with its edges, the whole word, and its script."""
    w = f"<{word}>"
    script = "script:" + unicodedata.name(word[0], "?").split(" ")[0]
    return [script, w, w, *(w[i : i + n] for n in (1, 2, 3, 4) for i in range(len(w) - n + 1) if w[i : i + n] not in "<>")]


def dimensions(word: str) -> np.ndarray:
    return np.array([xxhash.xxh32_intdigest(r.encode("utf-8", "surrogatepass")) % DIMENSIONS for r in letter_runs(word)])


def word_vector(word: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dimensions and values of the normalised TF-IDF vector, scaled by the root of the length."""
    dims, tf = np.unique(dimensions(word), return_counts=True)
    v = tf * idf[dims]
    return dims, v / np.sqrt((v * v).sum()) * np.sqrt(len(word))


@dataclass(frozen=True)
class Model:
    """``basis``: orthonormal directions that span the centroids less their mean, then random
    ones across them; ``centre``: that mean along each; ``points``: unit centroids in the basis."""

    langs: list[str]
    idf: np.ndarray
    basis: np.ndarray  # dimensions x directions
    centre: np.ndarray
    points: np.ndarray  # directions of the first kind x centroids
    of: np.ndarray  # index of the language of each centroid
    floor: np.ndarray  # least cosine of each language's sentences

    def cosines(self, along: np.ndarray) -> np.ndarray:
        """Cosine with every centroid of vectors given along the basis."""
        x = along - self.centre
        n = len(self.points)
        length = np.sqrt((x[:, :n] ** 2).sum(axis=1) + (x[:, n:] ** 2).mean(axis=1))
        return (x[:, :n] @ self.points) / np.maximum(length, 1e-9)[:, None]


def _basis(axes: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``basis, centre, points`` of a model from unit centroids (columns) and the mean."""
    q, size, turn = np.linalg.svd(axes, full_matrices=False)
    kept = size > 1e-6
    q, points = q[:, kept], (size[:, None] * turn)[kept]
    across = np.random.default_rng(3).standard_normal((len(axes), SKETCH))
    basis = np.concatenate([q, across - q @ (q.T @ across)], axis=1).astype(np.float32)
    return basis, (centre @ basis).astype(np.float32), points.astype(np.float32)


class _Words:
    """Sparse vectors of a vocabulary, and sums of them weighted by counts."""

    def __init__(self, vocab: list[str], idf: np.ndarray) -> None:
        vectors = [word_vector(w, idf) for w in vocab]
        self.dims = np.concatenate([d for d, _ in vectors])
        self.values = np.concatenate([v for _, v in vectors])
        self.word = np.repeat(np.arange(len(vocab)), [len(d) for d, _ in vectors])
        self.weight = np.array([np.sqrt(len(w)) for w in vocab])

    def mean(self, counts: np.ndarray) -> np.ndarray:
        total = np.bincount(self.dims, self.values * counts[self.word], minlength=DIMENSIONS)
        return total / max(1e-9, float((counts * self.weight).sum()))

    def along(self, axes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.weight), axes.shape[1]))
        np.add.at(out, self.word, self.values[:, None] * axes[self.dims])
        return out


def _axes(means: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors (as columns) from the centre to the means, and the centre along each."""
    away = means - centre
    away = (away / np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-9)).T
    return away, centre @ away


def _telling(rows: list[tuple[int, list[str]]], vocab: dict[str, int], n_langs: int) -> np.ndarray:
    """Weight of each dimension from how unevenly the languages use it (inverse class frequency):
    near 0 if all use it alike, 1 if one alone does."""
    use = np.zeros((n_langs, len(vocab)))
    for k, words in rows:
        for w in words:
            use[k, vocab[w]] += 1 / len(words)
    dims = [np.unique(dimensions(w)) for w in vocab]
    flat, word = np.concatenate(dims), np.repeat(np.arange(len(vocab)), [len(d) for d in dims])
    by = np.stack([np.bincount(flat, u[word], minlength=DIMENSIONS) for u in use])
    by /= np.maximum(by.sum(axis=1, keepdims=True), 1e-9)
    share = by / np.maximum(by.sum(axis=0), 1e-12)
    entropy = -(share * np.log(np.maximum(share, 1e-12))).sum(axis=0) / np.log(max(2, n_langs))
    return np.where(by.sum(axis=0) > 0, 0.05 + (1 - entropy) ** 2, 1.0)


def fit(sample: list[tuple[str, list[str]]], least_rows: int = 3) -> Model:
    """``sample``: (language, words of a sentence). Languages with fewer than ``least_rows`` sentences are left out."""
    sizes: dict[str, int] = {}
    for lang, _ in sample:
        sizes[lang] = sizes.get(lang, 0) + 1
    langs = sorted(x for x in sizes if sizes[x] >= least_rows)
    rows = [(langs.index(x), [w.lower() for w in words]) for x, words in sample if x in langs and len(words) >= 3]
    vocab = {w: i for i, w in enumerate(sorted({w for _, words in rows for w in words}))}
    # document frequency by word types, which repeated sentences do not distort
    df = np.zeros(DIMENSIONS)
    for w in vocab:
        df[np.unique(dimensions(w))] += 1
    idf = np.log1p((1 + len(vocab)) / (1 + df))
    if rows:
        idf *= _telling(rows, vocab, len(langs))
    if not rows:
        none = np.zeros(0)
        return Model([], idf, np.zeros((DIMENSIONS, SKETCH), np.float32), np.zeros(SKETCH), np.zeros((0, 0)), np.zeros(0, int), none)
    words = _Words(list(vocab), idf)
    label = np.array([r[0] for r in rows])
    flat = np.concatenate([[vocab[w] for w in ws] for _, ws in rows])
    sentence = np.repeat(np.arange(len(rows)), [len(ws) for _, ws in rows])
    weight = np.bincount(sentence, words.weight[flat])

    def means(part: np.ndarray, n: int) -> np.ndarray:
        """Mean vectors of the sentences of each part; -1 is none."""
        ok = part[sentence] >= 0
        cell = np.bincount(part[sentence[ok]] * len(vocab) + flat[ok], 1 / weight[sentence[ok]], minlength=n * len(vocab)).reshape(n, -1)
        return np.stack([words.mean(c) for c in cell])

    def cosines(axes: np.ndarray, bias: np.ndarray) -> np.ndarray:
        by_word = words.along(axes)
        return np.stack([np.bincount(sentence, by_word[flat, k]) for k in range(axes.shape[1])], 1) / weight[:, None] - bias

    part = label.copy()
    for _ in range(3):
        first = means(part, len(langs))
        near = cosines(*_axes(first, first.mean(0))).argmax(1)
        part = np.where(near == label, label, -1)
    centre = means(part, len(langs)).mean(0)
    cluster = np.where(part >= 0, part * CLUSTERS + np.arange(len(part)) % CLUSTERS, -1)
    for _ in range(6):
        m = means(cluster, len(langs) * CLUSTERS)
        near = cosines(*_axes(m, centre))
        own = np.stack([near[np.arange(len(part)), np.maximum(part, 0) * CLUSTERS + j] for j in range(CLUSTERS)], 1).argmax(1)
        cluster = np.where(part >= 0, part * CLUSTERS + own, -1)
    used = np.unique(cluster[cluster >= 0])
    axes, _ = _axes(means(cluster, len(langs) * CLUSTERS)[used], centre)
    of = used // CLUSTERS
    basis, middle, points = _basis(axes, centre)
    by_word = words.along(basis)
    along = np.stack([np.bincount(sentence, by_word[flat, k]) for k in range(basis.shape[1])], 1) / weight[:, None]
    model = Model(langs, idf, np.ascontiguousarray(basis), middle, points, of, np.ones(len(langs)))
    best = model.cosines(along)
    floor = model.floor
    for k in range(len(langs)):
        if (of == k).any() and (part == k).any():
            floor[k] = FLOOR * float(np.percentile(best[part == k][:, of == k].max(1), 2))
    return model


class Scorer:
    """Cosines of sentences with every language, from cached scores of words."""

    def __init__(self, model: Model) -> None:
        self.m = model
        self.at: dict[str, int] = {}
        self.scores = np.zeros((1024, model.basis.shape[1] + 1), np.float32)

    def word(self, w: str) -> int:
        i = self.at.get(w)
        if i is None:
            i = len(self.at)
            if i == len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            low = w.lower()
            d, v = word_vector(low, self.m.idf)
            self.scores[i, :-1] = v @ self.m.basis[d]
            self.scores[i, -1] = np.sqrt(len(low))
            self.at[w] = i
        return i

    def tidy(self) -> None:
        """Between batches: forget the cached words when there are many."""
        if len(self.at) > 300_000:
            self.__init__(self.m)

    def cosines(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Cosine of each sentence with its nearest centroid of each language; no sentence may be empty."""
        m = self.m
        best = np.full((len(starts), len(m.langs)), -1.0, np.float32)
        for a in range(0, len(starts), 20_000):
            b = min(a + 20_000, len(starts))
            lo, hi = starts[a], starts[b] if b < len(starts) else len(words)
            total = np.add.reduceat(self.scores[words[lo:hi]], starts[a:b] - lo, axis=0)
            cosine = m.cosines(total[:, :-1] / np.maximum(total[:, -1:], 1e-9))
            for k in range(len(m.langs)):
                if (m.of == k).any():
                    best[a:b, k] = cosine[:, m.of == k].max(1)
        return best


def judge(best: np.ndarray, doc: np.ndarray, counts: np.ndarray, size: np.ndarray, n_docs: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language of each sentence (-1: rejected) and its lead over the next, as a share of its cosine.

    A sentence is rejected if its cosine is below the floor of its language. It is also
    rejected if the language that most words of its text are nearest to is another one, and
    its own does not lead that one by ``SWITCH_LEAD`` (``SHORT_LEAD`` where it is short), or
    does not reach ``SWITCH_FLOORS`` floors.
    """
    n, langs = best.shape
    if not n or not langs:
        return np.full(n, -1), np.zeros(n)
    at = np.arange(n)
    top = best.argmax(1)
    high = best[at, top]
    mass = np.zeros((n_docs, langs))
    good = counts & (high >= floor[top])
    np.add.at(mass, (doc[good], top[good]), size[good])
    main = mass.argmax(1)[doc]
    lead_over_main = (high - np.maximum(best[at, main], 0)) / np.maximum(high, 1e-9)
    unsure = (top != main) & (mass.max(1)[doc] > 0) & ((lead_over_main < np.where(size < SHORT, SHORT_LEAD, SWITCH_LEAD)) | (high < SWITCH_FLOORS * floor[top]))
    others = best.copy()
    others[at, top] = -1
    lead = np.clip((high - np.maximum(others.max(1), 0)) / np.maximum(high, 1e-9), 0, 1)
    return np.where(unsure | (high < floor[top]), -1, top), lead


@dataclass
class Read:
    """Sentences of a batch of texts, with their words."""

    doc: np.ndarray
    words: list[list[str]]
    lang: np.ndarray
    sure: np.ndarray
    counts: np.ndarray  # sentence is one, or a phrase long enough


def _is_sentence(text: str, words: list[str]) -> bool:
    """A sentence with an end mark, or a phrase of ``PHRASE_WORDS`` words; titles, names and
    addresses, in which hardly a word begins with a small letter, are neither."""
    small = sum(1 for w in words if not w[0].isupper())
    ends = text.rstrip("\"'”’)]*_ ")[-1:] in ".!?。！？…"
    return small >= 2 and small * 5 >= len(words) * 2 and (len(words) >= PHRASE_WORDS or (ends and len(words) >= 3))


def read(texts: list[str | None], scorer: Scorer) -> Read:
    doc, words, flat, starts, counts = [], [], [], [], []
    for i, text in enumerate(texts):
        for s in sentences(text or ""):
            w = WORD.findall(s)
            if not w:
                continue
            starts.append(len(flat))
            flat.extend(map(scorer.word, w))
            doc.append(i)
            words.append(w)
            counts.append(_is_sentence(s, w))
    best = scorer.cosines(np.array(flat, int), np.array(starts, int))
    scorer.tidy()
    owner, counted = np.array(doc, int), np.array(counts, bool)
    lang, sure = judge(best, owner, counted, np.array([len(w) for w in words], int), len(texts), scorer.m.floor)
    return Read(owner, words, lang, sure, counted)


def languages_of(r: Read, n_docs: int, n_langs: int) -> np.ndarray:
    """Words in counted sentences, per document and language."""
    out = np.zeros((n_docs, n_langs), np.int64)
    if len(r.doc):
        ok = r.counts & (r.lang >= 0) & (r.sure >= LEAST_LEAD)
        np.add.at(out, (r.doc[ok], r.lang[ok]), np.fromiter((len(w) for w in r.words), int, len(r.words))[ok])
    return out


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, out = [], []
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            spoken = {" ".join(w) for w in map(WORD.findall, sentences(text or "")) if len(w) >= 3}
            taken = sorted(spoken, key=lambda x: xxhash.xxh32_intdigest(f"{len(text)} {x}".encode("utf-8", "surrogatepass")))[:SAMPLE_SENTENCES]
            langs += [lang] * len(taken)
            out += taken
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.string())], names=["lang", "words"])


def train(docs: DataFrame, ident: str, text: str, lang: str, rows: int = SAMPLE_ROWS) -> Model:
    """Fit on about ``rows`` labelled documents per language, chosen by a hash of ``ident``."""
    labelled = docs.select(declared(F.col(lang)).alias("lang"), F.col(ident).alias("id"), F.col(text).alias("text")).where(F.col("lang").isin(list(NAMES)))
    sizes = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return fit([])
    share = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, int(1e6 * min(1.0, rows / n)))))
    chosen = labelled.where(F.pmod(F.xxhash64(F.lit(17), "id"), F.lit(1_000_000)) < share[F.col("lang")])
    got = chosen.select("lang", "text").mapInArrow(_sampled, "lang string, words string").limit(len(NAMES) * rows * SAMPLE_SENTENCES * 2).toArrow()
    order = sorted(set(zip(got.column(0).to_pylist(), got.column(1).to_pylist())))
    return fit([(x, w.split(" ")) for x, w in order])


def identify(docs: DataFrame, text: str, model: Model, keep: list[str]) -> DataFrame:
    """``keep``, then ``languages``: array of ``(lang, confidence, words)``, most words first.

    A language is in the array if at least one sentence, or phrase of five or more words, is
    in it; ``words`` are those of its counted sentences, ``confidence`` their share of the
    words of all counted sentences. Null and empty texts, and texts without such a sentence,
    have an empty array. Texts are read whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("lang", pa.string()), ("confidence", pa.float64()), ("words", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scorer = Scorer(m)
        for whole in batches:
            for at in range(0, len(whole), 500):
                batch = whole.slice(at, 500)
                n = languages_of(read(batch.column(batch.num_columns - 1).to_pylist(), scorer), len(batch), len(m.langs))
                out = []
                for row in n:
                    total = int(row.sum())
                    out.append([{"lang": m.langs[k], "confidence": round(int(row[k]) / total, 6), "words": int(row[k])} for k in sorted(np.flatnonzero(row), key=lambda k: (-row[k], k))])
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, kind)], names=[*keep, "languages"])

    fields = ", ".join(f"`{n}` {t}" for n, t in docs.select(*keep).dtypes)
    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, f"{fields}, languages array<struct<lang:string,confidence:double,words:long>>")


def segments(docs: DataFrame, ident: str, text: str, model: Model) -> DataFrame:
    """``<ident>, segment_no, lang, confidence, sentences, words``: runs of sentences of one language.

    Rejected sentences and those that do not count belong to the segment around them; a text
    that has only such sentences is one segment of language ``und`` and confidence 0. Texts
    without words have no segment.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scorer = Scorer(m)
        for whole in batches:
            for at in range(0, len(whole), 500):
                batch = whole.slice(at, 500)
                r = read(batch.column(1).to_pylist(), scorer)
                rows: list[list] = []
                begin = np.searchsorted(r.doc, np.arange(len(batch) + 1))
                for i, key in enumerate(batch.column(0).to_pylist()):
                    open_: list | None = None
                    first = len(rows)
                    for j in range(begin[i], begin[i + 1]):
                        ok = r.counts[j] and r.lang[j] >= 0 and r.sure[j] >= LEAST_LEAD
                        lang = m.langs[r.lang[j]] if ok else None
                        if open_ is None or (lang and open_[2] not in ("und", lang)):
                            open_ = [key, len(rows) - first, lang or "und", 0.0, 0, 0, 0]
                            rows.append(open_)
                        if lang and open_[2] == "und":
                            open_[2] = lang
                        n = len(r.words[j])
                        open_[4] += 1
                        open_[5] += n
                        if ok:
                            open_[3] += float(r.sure[j]) * n
                            open_[6] += n
                cols = list(zip(*((k, s, lang, round(c / max(1, w), 6), n, total) for k, s, lang, c, n, total, w in rows))) or [[]] * 6
                kinds = [batch.schema.field(0).type, pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[ident, "segment_no", "lang", "confidence", "sentences", "words"])

    kind = dict(docs.dtypes)[ident]
    return docs.select(ident, text).mapInArrow(run, f"`{ident}` {kind}, segment_no int, lang string, confidence double, sentences int, words long")


def wrong_labels(found: DataFrame, ident: str, lang: str) -> DataFrame:
    """``<ident>, lang``: a row per language of each text whose label is missing, names another
    language, or stands for a mixed text. Texts in which no language was found are no case."""
    said = declared(F.col(lang))
    names = F.transform("languages", lambda x: x["lang"])
    bad = said.isNull() | (F.size("languages") > 1) | ~F.array_contains(names, said)
    return found.where((F.size("languages") > 0) & bad).select(ident, F.explode(names).alias("lang"))
