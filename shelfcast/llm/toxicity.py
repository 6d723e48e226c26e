"""Toxicity scores from fuzzy lexicon matches in context (operator 5).

The lexicon is learned: words and word beginnings (stems) that labelled toxic
texts use significantly more often than clean ones, counted once per group of
copies: terms of 3 to 24 characters with a letter among them, stems of 4 to 7,
at most ``max_terms`` of the strongest evidence. A stem stands beside the words
it covers, which keep their own edits. The lexicon forms a trie. A Levenshtein automaton is intersected with that trie:
states are sets of (trie node, edits so far), determinised on demand and kept
per worker, so that a token costs one table step per character and most tokens
end in the dead state after a few. Misspelled terms are matched with one edit
(two from nine letters on, none under five); stems match the beginning of a
token, with one edit from seven letters on.

Every match is scored in a window of words around it: quotation marks and
reporting verbs speak for a quotation, second-person words and further matches
for abuse. A logistic model on the sums of a text's matches gives the score.
Lexicon and model are fitted on a bounded sample: at most ``per_class``
labelled texts of either class, each of at most ``max_bytes`` bytes.

Defined cases: a null text scores as an empty one; an empty text has no match;
without labels of both classes nothing can be learned and every score is 0;
whole texts are scanned, at any length; rows are independent, so ties, repeated
rows and extra columns change nothing; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shared, held_out, map_rows, per_worker
from .labelled import Logistic, class_counts, labelled_sample
from .near_dup import shingle_set

#: Words to either side of a match that are looked at.
WINDOW = 8
#: Tokens kept in a worker's cache of matches.
CACHE = 200_000
EDGES = ".,;:!?\"'“”„«»‹›‘’()[]{}<>…*_-–—#%&$|/\\"
OPENING, CLOSING = "\"“„«‹‘'", "\"”“»›’'"
REPORTING = frozenset(
    "said says quote quoted quoting called calling calls wrote writes word term phrase "
    "sagte sagt nannte nennt zitat schrieb wort dit disait appelle mot citation écrit "
    "dijo dice llamó palabra cita escribió".split())
SECOND_PERSON = frozenset(
    "you your yours you're youre u ur yourself du dich dir dein deine ihr euch "
    "tu te toi ton ta tes vous votre vos tú ti usted ustedes eres sois".split())

SAMPLE = pa.schema([("label", pa.int32()), ("sketch", pa.int64()), ("text", pa.string())])
COUNTS = pa.schema([("term", pa.string()), ("stem", pa.bool_()), ("toxic", pa.int64()), ("clean", pa.int64())])
STEMS = range(4, 8)


def token(word: str) -> str:
    return word.strip(EDGES).lower()


class LexiconAutomaton:
    """Levenshtein automaton of all terms at once, determinised as tokens ask for it."""

    def __init__(self, words: list[str], stems: list[str]):
        # node: children, edits allowed to a word or stem that ends here (-1: none ends), edits allowed below
        self.children, self.word, self.stem, self.below = [{}], [-1], [-1], [0]
        for terms, ends, allowed in ((words, self.word, self.word_edits), (stems, self.stem, self.stem_edits)):
            for term in terms:
                node = 0
                for c in term:
                    if c not in self.children[node]:
                        self.children[node][c] = len(self.children)
                        self.children.append({})
                        self.word.append(-1)
                        self.stem.append(-1)
                        self.below.append(0)
                    self.below[node] = max(self.below[node], allowed(term))
                    node = self.children[node][c]
                ends[node] = max(ends[node], allowed(term))
                self.below[node] = max(self.below[node], allowed(term))
        self.alphabet = frozenset("".join([*words, *stems]))
        self.states: dict[tuple, list] = {}
        self.start = self._state({0: 0}, -1) if words or stems else None

    @staticmethod
    def word_edits(term: str) -> int:
        return 0 if len(term) < 5 else 1 if len(term) < 9 else 2

    @staticmethod
    def stem_edits(term: str) -> int:
        return 0 if len(term) < 7 else 1

    def _state(self, nodes: dict[int, int], stem: int):
        """[steps, edits of a word that ends here, edits of a stem passed, nodes]; -1 for none."""
        todo = list(nodes.items())
        while todo:  # term characters that the token leaves out
            node, e = todo.pop()
            for child in self.children[node].values():
                if e < self.below[child] and e + 1 < nodes.get(child, 99):
                    nodes[child] = e + 1
                    todo.append((child, e + 1))
        word = -1
        for node, e in nodes.items():
            if e <= self.word[node]:
                word = e if word < 0 else min(word, e)
            if e <= self.stem[node]:
                stem = e if stem < 0 else min(stem, e)
        if not nodes and stem < 0:
            return None
        key = frozenset(nodes.items()), stem
        if key not in self.states:
            self.states[key] = [{}, word, stem, nodes]
        return self.states[key]

    def _step(self, state: list, c: str):
        nodes: dict[int, int] = {}

        def reach(node, e):
            if e <= self.below[node] and e < nodes.get(node, 99):
                nodes[node] = e
        for node, e in state[3].items():
            for label, child in self.children[node].items():
                reach(child, e if label == c else e + 1)
            reach(node, e + 1)
        return self._state(nodes, state[2])

    def match(self, text: str) -> int:
        """Edits to the nearest term (0: exact), or -1."""
        state = self.start
        if state is None:
            return -1
        for c in text:
            c = c if c in self.alphabet else ""
            steps = state[0]
            if c not in steps:
                steps[c] = self._step(state, c)
            state = steps[c]
            if state is None:
                return -1
            if state[2] == 0:
                return 0
        found = [e for e in state[1:3] if e >= 0]
        return min(found) if found else -1


class Scanner:
    """Matches of whole texts; raw words are looked up in a bounded cache first."""

    def __init__(self, words: list[str], stems: list[str]):
        self.automaton = LexiconAutomaton(words, stems)
        self.cache: dict[str, int] = {}

    def matches(self, words: list[str]) -> list[tuple[int, int]]:
        """(place, edits) of the matching words."""
        get, found = self.cache.get, []
        for i, w in enumerate(words):
            edits = get(w)
            if edits is None:
                edits = self.automaton.match(token(w))
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                self.cache[w] = edits
            if edits >= 0:
                found.append((i, edits))
        return found

    @staticmethod
    def quoted(words: list[str], i: int) -> bool:
        """An opening mark before the word, or on it, and a closing one after it, without a gap."""
        before = False
        for j in range(i, max(-1, i - WINDOW), -1):
            if j < i and words[j][-1:] in CLOSING and words[j][:1] not in OPENING:
                break
            if words[j][:1] in OPENING:
                before = True
                break
        return before and any(w.rstrip(".,;:!?")[-1:] in CLOSING for w in words[i:i + WINDOW] if w.rstrip(".,;:!?"))

    def features(self, text: str | None) -> list[float]:
        words = (text or "").split()
        found = self.matches(words)
        exact = fuzzy = quotes = 0
        context = 0.0
        for n, (i, edits) in enumerate(found):
            around = {token(w) for w in words[max(0, i - WINDOW):i + WINDOW + 1]}
            in_quotes = self.quoted(words, i)
            reported = bool(around & REPORTING)
            near = (n > 0 and i - found[n - 1][0] <= WINDOW) + (n + 1 < len(found) and found[n + 1][0] - i <= WINDOW)
            context += max(0.0, 1 - 0.6 * in_quotes - 0.2 * reported + 0.5 * bool(around & SECOND_PERSON) + 0.25 * near)
            if in_quotes:
                quotes += 1
            elif edits:
                fuzzy += 1
            else:
                exact += 1
        n = max(len(words), 1)
        return [math.log1p(exact), math.log1p(fuzzy), math.log1p(quotes), math.log1p(context), float(exact > 0),
                math.log1p(100 * len(found) / n), math.log(n)]


def count_terms(sample: DataFrame) -> DataFrame:
    """(term, stem, toxic, clean): texts of each class that hold the word or stem."""
    def rows(source):
        counts: list[Counter] = [Counter(), Counter()]

        def flush():
            for key in counts[0].keys() | counts[1].keys():
                yield key[0], key[1], counts[1][key], counts[0][key]
            counts[0].clear()
            counts[1].clear()
        for label, text in source:
            terms = {t for w in text.split() if 3 <= len(t := token(w)) <= 24 and any(map(str.isalpha, t))}
            counts[label].update((t, False) for t in terms)
            counts[label].update({(t[:k], True) for t in terms for k in STEMS if len(t) >= k})
            if len(counts[0]) + len(counts[1]) > 300_000:
                yield from flush()
        yield from flush()
    return (map_rows(sample.select("label", "text"), rows, COUNTS)
            .groupBy("term", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))


def choose_terms(rows: list[tuple[str, bool, int, int]]) -> tuple[list[str], list[str]]:
    """Words and stems of the lexicon. A stem gives way to a longer one, or to a word, that covers nearly all its uses."""
    stems = {t: n for t, stem, n, _ in rows if stem}
    words = {t: n for t, stem, n, _ in rows if not stem}
    chosen: set[str] = set()
    covered: set[str] = set()
    for stem in sorted(stems, key=len):
        if any(stem.startswith(s) for s in covered):
            continue
        covered.add(stem)
        while longer := [s for s in stems if s[:-1] == stem and s.startswith(stem) and stems[s] >= 0.95 * stems[stem]]:
            stem = longer[0]
        if not any(w.startswith(stem) and words[w] >= 0.9 * stems[stem] for w in words):
            chosen.add(stem)
    return sorted(words), sorted(chosen)


def learn(docs: DataFrame, labels: DataFrame, train, per_class: int, max_bytes: int, max_terms: int):
    """((words, stems), model), or None without labels of both classes."""
    counts = class_counts(labels, "toxic", train)
    if not min(counts):
        return None
    store = Shared(docs.sparkSession, "toxicity")

    def sketched(source):
        for label, text in source:
            found = shingle_set(text, 5)
            yield label, int(found.min().astype(np.int64)) if len(found) else 0, text
    # one text per class and sketch stands for a group of copies
    taken = labelled_sample(docs, labels, "toxic", train, per_class, max_bytes).select("label", "text")
    sample = store.write(map_rows(taken, sketched, SAMPLE).groupBy("label", "sketch").agg(F.min("text").alias("text")), "sample")
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return None
    n, total = sizes[1], sizes[0] + sizes[1]
    toxic, clean = F.col("toxic"), F.col("clean")
    both = toxic + clean
    # log-likelihood ratio of the two rates (25: about 6e-7 by chance), and hardly any clean text
    evidence = 2 * (toxic * F.log(toxic * total / (both * n))
                    + F.when(clean > 0, clean * F.log(clean * total / (both * (total - n)))).otherwise(0.0))
    terms = (count_terms(sample).where((toxic > 0) & (clean * n <= 0.02 * toxic * (total - n)))
             .withColumn("g", evidence).where("g >= 25").orderBy(F.desc("g"), "term").limit(max_terms))
    lexicon = choose_terms([(r["term"], r["stem"], r["toxic"], r["clean"]) for r in terms.collect()])

    def measured(source):
        scanner = Scanner(*lexicon)
        for label, text in source:
            yield label, scanner.features(text)
    found = map_rows(sample.select("label", "text"), measured,
                     pa.schema([("label", pa.int32()), ("x", pa.list_(pa.float64()))])).collect()
    x, y = np.array([r["x"] for r in found]), np.array([float(r["label"]) for r in found])
    weight = np.where(y == 1, counts[1] / sizes[1], counts[0] / sizes[0])
    store.drop("sample")
    return lexicon, Logistic(x, y, weight * len(y) / weight.sum())


def toxicity(text: Column, learned) -> Column:
    """Score column of a text column."""
    if learned is None:
        return F.lit(0.0)
    lexicon, model = learned
    name = ("toxicity", *map(tuple, lexicon))

    def score(texts: pd.Series) -> pd.Series:
        scanner = per_worker(name, lambda: Scanner(*lexicon))
        x = np.array([scanner.features(t) for t in texts]).reshape(len(texts), -1)
        return pd.Series(model(x) if len(texts) else np.zeros(0))
    return F.pandas_udf(score, "double")(text)


def score_toxicity(docs: DataFrame, labels: DataFrame, *, modulus: int = 4, remainder: int = 2, threshold: float = 0.3,
                   per_class: int = 4000, max_bytes: int = 32 << 10, max_terms: int = 5000) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text.

    Labels are learned only from rows whose crc32 of doc_id mod ``modulus``
    isn't ``remainder``.
    """
    learned = learn(docs, labels, lambda c: ~held_out(c, modulus, remainder), per_class, max_bytes, max_terms)
    scored = docs.select("doc_id", held_out(docs["doc_id"], modulus, remainder).alias("held_out"),
                         toxicity(F.col("text"), learned).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, modulus: int = 4, remainder: int = 2, threshold: float = 0.3,
               per_class: int = 4000, max_bytes: int = 32 << 10, max_terms: int = 5000) -> DataFrame:
    """The documents that score under ``threshold``, with all their columns."""
    learned = learn(docs, labels, lambda c: ~held_out(c, modulus, remainder), per_class, max_bytes, max_terms)
    return docs.where(toxicity(F.col("text"), learned) < threshold)
