"""Toxicity: Levenshtein automata intersected with a learned lexicon trie.

Fitting counts, over a bounded sample of labelled documents, in how many
documents of each class a word occurs. Words and word beginnings that mark the
toxic class become the lexicon. Scoring walks each distinct word through the
lazily determinised product of the lexicon's trie and a Levenshtein automaton
(one edit from five letters on, two from nine; insertion, deletion,
substitution, swap of neighbours), which dies after a few letters for most
words. A hit counts with the share of toxic documents among those that have
its term; a hit inside quotation marks, or close behind a word of reporting,
counts for less. Hits combine as independent evidence.

Defined cases: a null or empty text has no hits and the score of documents
without hits; null doc_ids are scored and not held out; repeated rows get
equal scores; with no labels the lexicon is empty and every score equal; an
empty table gives no rows; further columns are kept, and one named score is
replaced.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from condist.llm import labelled
from condist.llm.scratch import frugal
from condist.llm.tokens import slices

EDGES = string.punctuation + "“”„«»‘’‹›…–—¿¡·•"
OPENING, CLOSING = "\"“„«‘‹'", "\"”“»’›'"
#: Words of reporting, unless others are given; what follows within the window is a mention rather than an attack.
REPORTING = frozenset("said says wrote writes called calls quoted quotes quote word term slur sagte schrieb dijo escribió dit écrit".split())
#: Words a worker remembers before it starts afresh.
CACHE_WORDS = 500_000
#: States of an automaton after which it starts afresh.
STATES = 100_000
#: Shares of the toxic documents that a term may need; the best on a fold of the rows to learn from is taken.
SUPPORTS = (0.0025, 0.005, 0.01, 0.02, 0.04)


def edits(term: str) -> int:
    """How many edits a term may be away from its spelling."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """Product of a trie of terms (and stems) with a Levenshtein automaton, determinised as words need it.

    A state holds (node, edits, swapped) triples: the trie node reached, the
    edits spent, and the letter that a swap still owes. Node 0 is the root.
    """

    def __init__(self, terms: list[str], stems: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.allowed: list[int] = [0]  # most edits of any term below
        for words, slot in ((terms, self.term), (stems, self.stem)):
            for word in words:
                node, path = 0, [0]
                for c in word:
                    if c not in self.children[node]:
                        self.children[node][c] = len(self.children)
                        self.children.append({})
                        self.term.append(None)
                        self.stem.append(None)
                        self.allowed.append(0)
                    path.append(node := self.children[node][c])
                slot[node] = word
                for p in path if slot is self.term else ():
                    self.allowed[p] = max(self.allowed[p], edits(word))
        self._begin()

    def _begin(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.start = self._state({(0, 0, "")})

    def _state(self, items: set) -> int:
        work = list(items)
        while work:  # letters of the term that the word leaves out
            node, e, owed = work.pop()
            if not owed and e < self.allowed[node]:
                for child in self.children[node].values():
                    if e + 1 <= self.allowed[child] and (child, e + 1, "") not in items:
                        items.add((child, e + 1, ""))
                        work.append((child, e + 1, ""))
        key = frozenset(items)
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        return self.ids[key]

    def _move(self, state: int, c: str) -> int:
        out = set()
        for node, e, owed in self.states[state]:
            if owed:
                if owed == c:
                    out.add((node, e, ""))
                continue
            if c in self.children[node]:
                out.add((self.children[node][c], e, ""))
            if e < self.allowed[node]:
                out.add((node, e + 1, ""))
                for letter, child in self.children[node].items():
                    if e + 1 <= self.allowed[child]:
                        out.add((child, e + 1, ""))
                    if letter != c and c in self.children[child]:
                        out.add((self.children[child][c], e + 1, letter))
        self.moves[state][c] = to = self._state(out)
        return to

    def match(self, word: str) -> tuple[str, int] | None:
        """The closest term and its edits; a stem that begins the word counts as no edit."""
        if len(self.states) > STATES:
            self._begin()
        state = self.start
        for c in word:
            to = self.moves[state].get(c)
            state = self._move(state, c) if to is None else to
            found = self.states[state]
            if not found:
                return None
            for node, e, owed in found:
                if not e and not owed and self.stem[node]:
                    return self.stem[node], 0
        ends = [(e, self.term[n]) for n, e, owed in self.states[state] if not owed and self.term[n] and e <= edits(self.term[n])]
        return min(ends)[::-1] if ends else None


def squeeze(word: str) -> str:
    """Runs of three or more of a letter as one."""
    out = []
    for i, c in enumerate(word):
        if not (i >= 2 and c == word[i - 1] == word[i - 2]):
            out.append(c)
    kept = "".join(out)
    for c in {c for i, c in enumerate(word) if i >= 2 and c == word[i - 1] == word[i - 2]}:
        kept = kept.replace(c + c, c)
    return kept


@dataclass
class Model:
    """Lexicon with the weight of exact and of misspelled hits by term, and how context discounts them."""

    exact: dict[str, float]
    stems: dict[str, float]
    misspelled: dict[str, float]
    known: frozenset[str]
    base: float
    window: int = 8
    quoted: float = 0.3
    reported: float = 0.5
    reporting: frozenset[str] = REPORTING
    _words: dict = field(default_factory=dict, repr=False)
    _automaton: Automaton | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_words": {}, "_automaton": None}

    def word(self, raw: str) -> tuple[str, float] | None:
        """Term and weight of one lower-case word with its marks."""
        word = raw.strip(EDGES)
        if len(word) < 3:
            return None
        if self._automaton is None:
            self._automaton = Automaton(list(self.exact), list(self.stems))
        for form in dict.fromkeys((word, squeeze(word))):
            hit = self._automaton.match(form)
            if hit and (hit[1] == 0 or form not in self.known):
                term, e = hit
                return term, (self.misspelled.get(term, 0.0) if e else self.exact.get(term) or self.stems[term])
        return None

    def hits(self, text: str) -> list[tuple[int, str, float]]:
        """Word number, term and weight in context of each hit."""
        words, found, cache = text.lower().split(), [], self._words
        for i, raw in enumerate(words):
            try:
                hit = cache[raw]
            except KeyError:
                hit = cache[raw] = self.word(raw)
            if hit:
                found.append((i, hit[0], hit[1] * self._context(words, i)))
        if len(cache) > CACHE_WORDS:
            cache.clear()
        return found

    def _context(self, words: list[str], i: int) -> float:
        before, after = words[max(0, i - self.window) : i + 1], words[i : i + self.window + 1]
        opens = next((k for k in range(len(before) - 1, -1, -1) if before[k][0] in OPENING), None)
        closed = opens is not None and any(w[-1] in CLOSING or w.rstrip(".,;:!?")[-1:] in tuple(CLOSING) for w in before[opens:-1])
        if opens is not None and not closed and any(w.rstrip(".,;:!?")[-1:] in tuple(CLOSING) for w in after):
            return self.quoted
        return self.reported if any(w.strip(EDGES) in self.reporting for w in before[:-1]) else 1.0

    def score(self, hits: list[tuple[int, str, float]]) -> float:
        clean = 1 - self.base
        for _, _, weight in hits:
            clean *= 1 - weight
        return 1 - clean


def word_sets(sampled: DataFrame) -> DataFrame:
    """words, label: the set of words of each document; documents of one class and one set count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                lists = [sorted({w for raw in (t or "").lower().split() if len(w := raw.strip(EDGES)) > 2}) for t in part.column("text").to_pylist()]
                yield pa.record_batch([pa.array(lists, pa.list_(pa.string())), part.column("label")], ["words", "label"])

    return sampled.mapInArrow(frugal(run), "words array<string>, label int").distinct()


def word_counts(sets: DataFrame) -> DataFrame:
    """word, ones, zeros: rows of ``word_sets`` of each class that have the word."""
    return (
        sets.select(F.explode("words").alias("word"), "label")
        .groupBy("word")
        .agg(F.sum("label").alias("ones"), F.sum(1 - F.col("label")).alias("zeros"))
    )


def chance(ones, zeros, n: dict[int, int], share: float):
    """Share of toxic documents among those with a term, with classes at their shares among all labels; of numbers or columns."""
    a, b = share * ones / max(n[1], 1), (1 - share) * (zeros + 0.5) / max(n[0], 1)
    return a / (a + b)


def lexicon(counts: DataFrame, n: dict[int, int], share: float, support: float, precision: float, stem_words: int) -> tuple[dict[str, float], dict[str, float]]:
    """Terms and stems with their precision, from the counts of words in ``n`` documents of each class."""
    least = max(5, support * n[1])
    good = (F.col("ones") >= least) & (chance(F.col("ones"), F.col("zeros"), n, share) >= precision)
    begins = F.explode(F.array(*[F.when(F.length("word") >= k, F.substring("word", 1, k)) for k in (4, 5, 6)])).alias("stem")
    stem_rows = (
        counts.select(begins, "ones", "zeros")
        .where("stem IS NOT NULL")
        .groupBy("stem")
        .agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"), F.count_if(F.col("ones") >= 2).alias("words"), F.max("ones").alias("top"))
        .where(good & (F.col("words") >= stem_words) & (F.col("top") < 0.5 * F.col("ones")) & (F.col("zeros") <= 0.002 * F.col("ones")))
        .collect()
    )
    by_stem = {r["stem"]: r for r in stem_rows}
    # of stems that begin one another, the longest that keeps nearly all documents
    stems = {}
    for s, r in sorted(by_stem.items(), key=lambda x: len(x[0])):
        longer = [t for t in by_stem if t != s and t.startswith(s) and by_stem[t]["ones"] >= 0.95 * r["ones"]]
        if not longer and not any(s.startswith(t) for t in stems):
            stems[s] = chance(r["ones"], r["zeros"], n, share)
    words = counts.where(good).collect()
    return {r["word"]: chance(r["ones"], r["zeros"], n, share) for r in words if not any(r["word"].startswith(s) for s in stems)}, stems


def sizes(sets: DataFrame) -> dict[int, int]:
    return {0: 0, 1: 0} | {r["label"]: r["count"] for r in sets.groupBy("label").count().collect()}


def best_support(
    learn: DataFrame, check: DataFrame, share: float, precision: float, stem_words: int, supports: tuple[float, ...], threshold: float = 0.3
) -> float:
    """The support whose lexicon, learned from the sets ``learn``, errs least on the texts ``check`` at that threshold.

    Of equals it is the largest; where ``check`` lacks a class, the middle one.
    """
    counts, n = word_counts(learn).persist(), sizes(learn)
    drafts = []
    for support in supports:
        exact, stems = lexicon(counts, n, share, support, precision, stem_words)
        drafts.append(Model(exact, stems, exact, frozenset(), 0.0))
    counts.unpersist()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            hit = [[m.score(m.hits(t or "")) >= threshold for t in texts] for m in drafts]
            yield pa.record_batch([batch.column("label"), pa.array(list(map(list, zip(*hit, strict=True))), pa.list_(pa.bool_()))], ["label", "hit"])

    rows = check.select("text", "label").mapInArrow(frugal(judge), "label int, hit array<boolean>").groupBy("label")
    shares = {r["label"]: r for r in rows.agg(*[F.avg(F.get("hit", F.lit(k)).cast("double")).alias(f"s{k}") for k in range(len(supports))]).collect()}
    if len(shares) < 2:
        return sorted(supports)[len(supports) // 2]
    wrong = [(1 - share) * shares[0][f"s{k}"] + share * (1 - shares[1][f"s{k}"]) for k in range(len(supports))]
    return max(s for s, w in zip(supports, wrong, strict=True) if w <= min(wrong) + 1e-12)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    modulus: int = 4,
    held_out: int = 2,
    per_class: int = 10_000,
    supports: tuple[float, ...] = SUPPORTS,
    precision: float = 0.5,
    stem_words: int = 5,
    reporting: frozenset[str] = REPORTING,
) -> Model:
    """Learn a lexicon from at most ``per_class`` labelled documents of each class.

    A term needs a share of the toxic documents (five at least) and, with
    classes at their shares among all labels, ``precision``; so the lexicon
    has at most (distinct words of a document) / share terms. Which of
    ``supports`` that share is, the rows with the remainder after ``held_out``
    decide, which are learned from afterwards. Counts and totals are both of
    distinct sets of words. A stem is a beginning of four to six letters shared
    by ``stem_words`` words or more.
    """
    use = labelled.remainder(modulus) != held_out
    share = labelled.prior(labels, "toxic", use)
    sampled = labelled.sample(docs, labels, "toxic", use, per_class).persist()
    sets = word_sets(sampled).persist()
    n = sizes(sets)
    if not n[1]:
        sets.unpersist()
        sampled.unpersist()
        return Model({}, {}, {}, frozenset(), share, reporting=reporting)
    checks = labelled.remainder(modulus) == (held_out + 1) % modulus
    learn = word_sets(sampled.where(~checks)).persist()
    support = best_support(learn, sampled.where(checks), share, precision, stem_words, supports)
    learn.unpersist()
    counts = word_counts(sets).persist()
    exact, stems = lexicon(counts, n, share, support, precision, stem_words)
    draft = Model(exact, stems, dict.fromkeys(exact, 1.0), frozenset(), 0.0)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(list(exact), list(stems))
        for batch in batches:
            rows = []
            for w, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hit = automaton.match(w)
                if hit and hit[1]:
                    rows.append((w, hit[0], a, b))
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], ["word", "term", "ones", "zeros"])

    # words within two edits of the lexicon: as many as it allows, whatever the corpus
    variants = counts.mapInArrow(frugal(near), "word string, term string, ones long, zeros long").collect()
    known = frozenset(r["word"] for r in variants if r["zeros"] and chance(r["ones"], r["zeros"], n, share) < precision)
    seen: dict[str, list[float]] = {t: [1.0, 1.0] for t in exact}
    for r in variants:
        if r["word"] not in known:
            seen[r["term"]][0] += r["ones"]
            seen[r["term"]][1] += r["zeros"]
    misspelled = {t: exact[t] * a / (a + b) for t, (a, b) in seen.items()}
    draft = Model(exact, stems, misspelled, known, 0.0)

    def missed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            none = [not draft.hits(t or "") for t in batch.column("text").to_pylist()]
            yield pa.record_batch([pa.array(none), batch.column("label")], ["none", "label"])

    left = sampled.mapInArrow(frugal(missed), "none boolean, label int").groupBy("label").agg(F.count_if("none").alias("none"), F.count("*").alias("all")).collect()
    rate = {r["label"]: r["none"] / r["all"] for r in left}
    a, b = share * rate.get(1, 0), (1 - share) * rate.get(0, 1)
    counts.unpersist()
    sets.unpersist()
    sampled.unpersist()
    return Model(exact, stems, misspelled, known, a / (a + b) if a + b else share, reporting=reporting)


def score(docs: DataFrame, model: Model, name: str = "score", hits: str | None = None) -> DataFrame:
    """``docs`` with a column ``name`` and, if asked for, the hits (word number, term, weight in context)."""
    kept = docs.drop(name, *([hits] if hits else [])).withColumn("text", F.col("text").cast("string"))
    hit_type = T.ArrayType(T.StructType([T.StructField("word", T.IntegerType()), T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType())]))
    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.DoubleType()), *([T.StructField(hits, hit_type)] if hits else [])])
    arrow = pa.list_(pa.struct([("word", pa.int32()), ("term", pa.string()), ("weight", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [model.hits(t or "") for t in part.column("text").to_pylist()]
                extra = [pa.array([model.score(h) for h in found], pa.float64())]
                if hits:
                    extra.append(pa.array([[{"word": i, "term": t, "weight": w} for i, t, w in h] for h in found], arrow))
                yield pa.RecordBatch.from_arrays([*part.columns, *extra], names=[*part.schema.names, name, *([hits] if hits else [])])

    return kept.mapInArrow(frugal(run), schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score all documents; labels with remainder 2 are held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, model)
    held = F.coalesce(labelled.remainder(4) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
