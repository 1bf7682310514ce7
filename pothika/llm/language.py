"""Problem 10: missing and wrong language labels, and texts in several languages.

Rank-order profiles: each language's most frequent n-grams of letters, ranked, from labelled samples. A stretch of
text is compared to each profile by the out-of-place distance of its own ranked n-grams, an n-gram that a profile
lacks counting as out of place by the whole profile. Texts are cut into sentences, quotations and lines; the cheapest
sequence of languages over these units, with a price for each change, gives the stretches.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import INVISIBLE, TO_DEVANAGARI

#: Ranks of a profile, longest n-gram, labelled rows used at most (by id), running words that make a language count.
RANKS, LONGEST, SAMPLES, RUN = 1200, 5, 20_000, 12
#: Price of a change of language, in out-of-place shares of a word: two changes cost what a run of RUN words has to gain by a
#: twelfth a word.
CHANGE = 0.5
LANGUAGES = ["hi", "gu", "sa", "mr", "en"]
#: Names and codes of the languages; anything else names none.
NAMES = {
    "hi": ["hi", "hin", "hindi", "हिन्दी", "हिंदी"], "gu": ["gu", "guj", "gujarati", "gujrati", "ગુજરાતી"],
    "sa": ["sa", "san", "sanskrit", "संस्कृत"], "mr": ["mr", "mar", "marathi", "मराठी"], "en": ["en", "eng", "english"],
}
#: Cuts a text into units: sentence ends, line ends, quotation marks, brackets.
_UNIT = re.compile(r"[।॥\n\r“”\"«»()\[\]{}‘]+|[.!?]+(?=\s|$)")
_WORD = re.compile("[A-Za-zÀ-ɏ̀-ͯḀ-ỿऀ-ॣॱ-ॿઁ-૥ૹ-૿]+")


def label_of(name: str | None) -> str | None:
    """The language that a label names: a code with or without region, or a name, in any case."""
    if not name:
        return None
    name = re.split(r"[-_ ]", name.strip().lower())[0]
    return next((k for k, v in NAMES.items() if name in v), None)


class Grams:
    """Numbers for n-grams. Gujarati letters are numbered apart from the Devanagari ones they correspond to."""

    def __init__(self, known: dict[str, int]):
        self.known, self.kept = known, {}

    @staticmethod
    def of(word: str) -> list[str]:
        own = "઀" <= word[0] <= "૿"
        padded = f"_{word.translate(TO_DEVANAGARI) if own else word}_"
        found = [padded[i : i + n] for n in range(1, LONGEST + 1) for i in range(len(padded) - n + 1) if padded[i : i + n] != "_"]
        return ["ગ" + g for g in found] if own else found

    def numbers(self, word: str) -> np.ndarray:
        got = self.kept.get(word)
        if got is None:
            if len(self.kept) > 200_000:
                self.kept.clear()
            n = len(self.known)  # unknown n-grams share one number, as all profiles lack them
            got = self.kept[word] = np.array([self.known.get(g, n) for g in self.of(word)], np.int32)
        return got


def train(samples: DataFrame, text: str = "text", lang: str = "lang", key: str = "sample_id", most: int = SAMPLES) -> tuple[dict[str, int], np.ndarray]:
    """(numbers of the n-grams, ranks by language and number) from at most `most` labelled rows, by id."""
    rows = samples.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).orderBy(key).limit(most).select(lang, text).collect()
    counts = {k: Counter() for k in LANGUAGES}
    for name, t in rows:
        if (k := label_of(name)) is not None:
            for w in _WORD.findall(INVISIBLE.sub("", t).lower()):
                grams = Grams.of(w)
                # Gujarati stands in two scripts: both count for both
                counts[k].update(g.removeprefix("ગ") for g in grams)
                if k == "gu":
                    counts[k].update("ગ" + g.removeprefix("ગ") for g in grams)
    ranked = {}
    for k, c in counts.items():
        order = sorted(c.items(), key=lambda x: (-x[1], x[0]))
        plain, own = [g for g, _ in order if g[0] != "ગ"], [g for g, _ in order if g[0] == "ગ"]
        ranked[k] = plain[:RANKS], own[:RANKS]
    known = {g: i for i, g in enumerate(dict.fromkeys(g for v in ranked.values() for part in v for g in part))}
    ranks = np.full((len(LANGUAGES), len(known) + 1), RANKS, np.float32)
    for l, k in enumerate(LANGUAGES):
        for part in ranked[k]:
            for r, g in enumerate(part):
                ranks[l, known[g]] = r
    return known, ranks


def distances(numbers: np.ndarray, owners: np.ndarray, n: int, ranks: np.ndarray) -> np.ndarray:
    """Out-of-place distance of n units to each language, as a share of the greatest one.

    numbers and owners: the n-grams of all units and the unit of each, in order of units.
    """
    width = ranks.shape[1]
    keys, counts = np.unique(owners.astype(np.int64) * width + numbers, return_counts=True)
    unit, gram = keys // width, keys % width
    # ties: by the best rank in any profile, so that equal counts stand in the order in which they'd be expected
    order = np.lexsort((ranks.min(0)[gram], -counts, unit))
    unit, gram, counts = unit[order], gram[order], counts[order]
    starts = np.searchsorted(unit, np.arange(n))
    rank = np.arange(len(unit)) - starts[unit]
    out = np.empty((n, len(ranks)))
    weight = np.bincount(unit, counts, n)
    for l in range(len(ranks)):
        place = ranks[l, gram]
        off = np.where(place >= RANKS, RANKS, np.minimum(np.abs(place - rank), RANKS))
        out[:, l] = np.bincount(unit, off * counts, n) / RANKS / np.maximum(weight, 1)
    return out


def units(text: str) -> list[list[str]]:
    """The words of each unit of a text; units also end where the script changes."""
    out: list[list[str]] = []
    for part in _UNIT.split(text):
        script = None
        for w in _WORD.findall(part):
            c = w[0]
            mine = "G" if "઀" <= c <= "૿" else "D" if "ऀ" <= c <= "ॿ" else "L"
            if mine != script:
                out.append([])
                script = mine
            out[-1].append(w)
    return out


def _best(cost: np.ndarray, words: np.ndarray) -> list[int]:
    """The cheapest language of each unit in turn, a change costing CHANGE."""
    total, back = cost[0] * words[0], []
    for i in range(1, len(cost)):
        k = int(total.argmin())
        stay = total <= total[k] + CHANGE
        back.append(np.where(stay, np.arange(len(total)), k))
        total = np.minimum(total, total[k] + CHANGE) + cost[i] * words[i]
    path = [int(total.argmin())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def stretches(df: DataFrame, samples: DataFrame, key: str, text: str, label: str, sample_key: str = "sample_id") -> DataFrame:
    """(key, label_lang, segment, lang, words, confidence): the stretches of each text with words, in order.

    label_lang is the language that the label names, null if none. Texts without letters, empty and null texts give
    no row; repeated rows give repeated rows. confidence is the lead over the next language, 0 to 1.
    """
    known, ranks = train(samples, key=sample_key)
    model = df.sparkSession.sparkContext.broadcast((known, ranks))
    schema = f"{key} {df.schema[key].dataType.simpleString()}, label_lang string, segment int, lang string, words int, confidence double"

    def part(keys: list, labels: list, texts: list, grams: Grams, ranks: np.ndarray) -> pd.DataFrame:
        lists = [units(INVISIBLE.sub("", t).lower()) if t else [] for t in texts]
        flat = [u for us in lists for u in us]
        rows = []
        if flat:
            arrays = [grams.numbers(w) for u in flat for w in u]
            n_words = np.array([len(u) for u in flat])
            sizes = np.array([len(a) for a in arrays])
            owners = np.repeat(np.repeat(np.arange(len(flat)), n_words), sizes)
            cost = distances(np.concatenate(arrays), owners, len(flat), ranks)
            at = 0
            for k, name, us in zip(keys, labels, lists):
                if not us:
                    continue
                mine, w = cost[at : at + len(us)], n_words[at : at + len(us)]
                at += len(us)
                path = _best(mine, w)
                starts = [i for i in range(len(path)) if not i or path[i] != path[i - 1]] + [len(path)]
                for s, (lo, hi) in enumerate(zip(starts, starts[1:])):
                    d = (mine[lo:hi] * w[lo:hi, None]).sum(0)
                    first = d[path[lo]]
                    second = np.delete(d, path[lo]).min()
                    rows.append((k, label_of(name), s, LANGUAGES[path[lo]], int(w[lo:hi].sum()), float(min(1.0, max(0.0, 1 - first / second))) if second else 0.0))
        return pd.DataFrame(rows, columns=["k", "label_lang", "segment", "lang", "words", "confidence"]).rename(columns={"k": key})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, ranks = model.value
        grams = Grams(known)
        for batch in batches:
            for lo in range(0, len(batch), 500):  # bounds the memory of the n-grams
                b = batch.iloc[lo : lo + 500]
                yield part(b[key].tolist(), b[label].tolist(), b[text].tolist(), grams, ranks)

    return df.select(key, label, text).filter(F.col(text).isNotNull()).mapInPandas(run, schema)


def wrong_labels(segments: DataFrame, key: str) -> DataFrame:
    """(key, lang) of texts whose label is missing, names none or a wrong language, and of texts in several languages.

    One row for each language with a stretch of at least RUN words; rows of one key count as one text, of their labels the
    first in order counts. The stretches of a text stand in one
    partition each as they come, and are few, so they are gathered per text.
    """
    per = segments.groupBy(key).agg(
        F.min("label_lang").alias("label"),
        F.array_distinct(F.collect_list(F.when(F.col("words") >= RUN, F.col("lang")))).alias("langs"),
    )
    case = (F.size("langs") > 1) | F.col("label").isNull() | ~F.array_contains("langs", F.col("label"))
    return per.filter(case).select(key, F.explode("langs").alias("lang"))
