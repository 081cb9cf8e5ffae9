"""Reading level of each document (problem 10): the median of classic readability grades.

Syllables are counted by hyphenation-style rules: vowel groups, less silent endings, plus
hiatus. Five grade formulas read the same counts (letters, words, sentences, syllables, long
words); their median is the grade. Levels are the intervals between cut points that are
fitted once on the labelled samples, a fixed table.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestrata.llm.prose import WORD, sentences

_GROUP = re.compile(r"[aeiouyà-öø-ÿ]+")
_SPLIT = re.compile(r"[iu][ao](?!u)|eo|i[eu](?=[mnt])|ya|[aeiou]ing$|creat|[^q]uous")
_JOIN = re.compile(r"[cst]i(?:o|a|e)|gio|q[u][aeio]")
_SILENT = re.compile(r"(?<=[^aeiouyl])e$|(?<=[aeiou]l)e$|(?<=[^aeioudt])ed$|(?<=[^aeiouscxzghl])es$|(?<=[^aeiou])e(?=ly$|ment|ful|less|ness)")


def syllables(word: str) -> int:
    """Syllables of a lower-case word, at least 1."""
    w = _SILENT.sub("", word)
    return max(1, len(_GROUP.findall(w)) + len(_SPLIT.findall(w)) - len(_JOIN.findall(w)))


def grades(letters: float, words: float, sents: float, syll: float, many: float) -> list[float]:
    """Flesch-Kincaid, Gunning fog, SMOG, Coleman-Liau and automated readability.

    ``many`` is the number of words of three and more syllables.
    """
    per, sy, lt = words / sents, syll / words, letters / words
    return [
        0.39 * per + 11.8 * sy - 15.59,
        0.4 * (per + 100 * many / words),
        1.0430 * math.sqrt(many * 30 / sents) + 3.1291,
        5.88 * lt - 29.6 / per - 15.8,
        4.71 * lt + 0.5 * per - 21.43,
    ]


class Counts(dict):
    """word -> (letters, syllables, 1 if of three and more syllables)."""

    def __missing__(self, word: str) -> tuple[int, int, int]:
        if len(self) > 200_000:
            self.clear()
        low = word.lower()
        n = syllables(low)
        self[word] = out = (sum(c.isalpha() for c in low), n, int(n >= 3))
        return out


def sentence_counts(words: list[str], known: Counts) -> tuple[int, int, int, int]:
    """Letters, words, syllables and long words of one sentence."""
    c = [known[w] for w in words]
    return sum(x[0] for x in c), len(c), sum(x[1] for x in c), sum(x[2] for x in c)


def level_of(sents: list[tuple[int, int, int, int]]) -> float | None:
    """The grade of a text: the median of its sentences' grades, each weighted by its words.

    A sentence's grade is the median of the five formulas. With the weighted median a stray
    sentence, however easy or hard, does not move the grade of the whole.
    """
    if not sents:
        return None
    g = sorted((float(np.median(grades(c[0], c[1], 1, c[2], c[3]))), c[1]) for c in sents)
    half, seen = sum(n for _, n in g) / 2, 0
    for x, n in g:
        seen += n
        if seen >= half:
            return x
    return None


def cut_points(samples: list[tuple[float, int]]) -> list[tuple[float, int]]:
    """(lower bound, level) in rising order: between neighbouring levels the cut that leaves
    the fewest labelled samples on the wrong side, in the middle of the widest such gap."""
    levels = sorted({lv for _, lv in samples})
    out = [(-math.inf, levels[0])] if levels else []
    for below, above in zip(levels, levels[1:]):
        pair = sorted((g, lv) for g, lv in samples if lv in (below, above))
        best = min(
            (sum(lv == above for _, lv in pair[:i]) + sum(lv == below for _, lv in pair[i:]), -(pair[i][0] - pair[i - 1][0]), (pair[i][0] + pair[i - 1][0]) / 2)
            for i in range(1, len(pair))
        )
        out.append((best[2], above))
    return out


def _prose_counts(text: str | None, known: Counts) -> list[tuple[int, int, int, int]]:
    return [sentence_counts(w, known) for w in map(WORD.findall, sentences(text or "")) if w]


def fit_levels(samples: DataFrame, text: str, level: str, most: int = 100_000) -> list[tuple[float, int]]:
    """Cut points from at most ``most`` labelled texts; a null text or level is left out."""
    known = Counts()
    rows = samples.select(text, level).where(F.col(text).isNotNull() & F.col(level).isNotNull()).limit(most).collect()
    graded = ((level_of(_prose_counts(t, known)), lv) for t, lv in rows)
    return cut_points([(g, lv) for g, lv in graded if g is not None])


def reading_levels(docs: DataFrame, ident: str, text: str, cuts: list[tuple[float, int]], model=None, only: str = "en") -> DataFrame:
    """``<ident>, grade, reading_level, words``: for texts whose prose is only in the language ``only``.

    Without a language ``model`` every text counts as such. Texts without prose (null, empty,
    code only) have no row. Whole texts are read; equal rows give equal results.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model, cuts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lodestrata.llm.language import Scorer, languages_of, read

        model, cuts = shared.value
        bounds, levels = np.array([c[0] for c in cuts]), [c[1] for c in cuts]
        scorer = Scorer(model) if model else None
        wanted = model.langs.index(only) if model and only in model.langs else -1
        known = Counts()
        for whole in batches:
            for at in range(0, len(whole), 500):
                batch = whole.slice(at, 500)
                keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                if scorer:
                    r = read(texts, scorer)
                    has = languages_of(r, len(batch), len(model.langs)) > 0
                    begin = np.searchsorted(r.doc, np.arange(len(batch) + 1))
                    pure = [wanted >= 0 and has[i, wanted] and has[i].sum() == 1 for i in range(len(batch))]
                    counts = [[sentence_counts(r.words[j], known) for j in range(begin[i], begin[i + 1])] if pure[i] else [] for i in range(len(batch))]
                else:
                    counts = [_prose_counts(t, known) for t in texts]
                rows = [(k, g, levels[int(np.searchsorted(bounds, g, side="right")) - 1], sum(x[1] for x in c)) for k, c in zip(keys, counts) if (g := level_of(c)) is not None]
                cols = list(zip(*rows)) or [[]] * 4
                kinds = [batch.schema.field(0).type, pa.float64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[ident, "grade", "reading_level", "words"])

    kind = dict(docs.dtypes)[ident]
    return docs.select(ident, text).mapInArrow(run, f"`{ident}` {kind}, grade double, reading_level int, words long")
