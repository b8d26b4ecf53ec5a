"""Operator 5: toxicity by a weighted finite-state grammar over clauses.

A trie of learned word stems finds the words that matter; only clauses that hold one are
read further. There each word becomes a symbol (insult, threat, target, negation, report,
other) and five small transducers run over the symbols, one after another: insults open
with their learned weight; a target next to them strengthens them; a threat needs a target;
a negation shortly before weakens what follows; reported speech discounts the clause. A
document adds up its clauses, and a logistic curve fitted on the sample turns that sum and
the length of the text (long texts meet a stem by chance) into a score.

Stems are learned from the labelled sample alone: words and their beginnings whose share
among toxic documents cannot be chance (a binomial bound over all stems that were tried)
and that come far more often there; their weight is the log of that ratio. Near-equal toxic
rows count as one; no number of stems is set.
The word lists below only name function words and plain threats.

Null, empty and unmatched texts get the curve's value at zero; without labels of both
classes every score is 0. Equal texts get equal scores. Extra columns are kept as they are.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from .common import python_tasks, labelled_sample, stored

PER_CLASS = 4000
THRESHOLD = 0.3
PREFIX = range(4, 10)

# fixed word lists: the closed classes of the grammar in the corpus' four languages
TARGET = frozenset("you your yours he she they him her them du dich dir ihr euch sie er tu toi te vous il elle ils tú usted ustedes él ella ellos".split())
NEGATION = frozenset("not no never nobody isn't aren't wasn't don't nicht kein keine nie ne pas jamais aucun nunca ninguno jamás".split())
REPORT = frozenset("said says claimed reported wrote quoted sagte behauptete schrieb dit affirmé écrit dijo afirmó escribió".split())
THREAT = frozenset("kill murder strangle shoot stab töten umbringen erschießen tuer assassiner étrangler matar asesinar apuñalar".split())

_CLAUSE = re.compile(r"[.!?;:\n]+")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class Grammar:
    stems: dict[str, float]  # a stem that ends in "$" must end its word
    curve: tuple[float, float, float] = (0.0, 0.0, -50.0)  # clauses, length, constant
    _trie: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"_trie": None}

    def trie(self):
        if self._trie is None:
            self._trie = ahocorasick.Automaton()
            for s, w in self.stems.items():
                self._trie.add_word(s.rstrip("$"), (s, w))
            for s in THREAT:
                if s not in self.stems:
                    self._trie.add_word(s, (s + "$", 0.0))
            self._trie.make_automaton()
        return self._trie

    def hits(self, low: str) -> dict[int, tuple[int, float]]:
        """Start of a word -> (end of the match, weight) of its heaviest stem."""
        found: dict[int, tuple[int, float]] = {}
        for last, (stem, weight) in self.trie().iter(low):
            first, end = last + 1 - len(stem.rstrip("$")), last + 1
            if first and low[first - 1].isalpha() or stem[-1] == "$" and low[end : end + 1].isalpha():
                continue
            if weight >= found.get(first, (0, -1.0))[1]:
                found[first] = (end, weight)
        return found

    def clauses(self, text: str) -> list[tuple[str, float]]:
        """Matched clauses and their weights, in order."""
        low = text.lower()
        hits = self.hits(low)
        if not hits:
            return []
        marks = [(m.start(), m.end()) for m in _CLAUSE.finditer(low)]
        begins, ends = [0, *(e for _, e in marks)], [*(b for b, _ in marks), len(low)]
        out = []
        for i in sorted({bisect_right(begins, at) - 1 for at in hits}):
            weight = self.weigh([self.symbol(w, hits) for w in _WORD.finditer(low, begins[i], ends[i])])
            if weight > 0:
                out.append((low[begins[i] : ends[i]].strip(), weight))
        return out

    def symbol(self, word: re.Match, hits: dict[int, tuple[int, float]]) -> tuple[str, float]:
        w = word.group()
        if w in THREAT:
            return "threat", 2.0
        if word.start() in hits and hits[word.start()][1] > 0:
            return "insult", hits[word.start()][1]
        for name, words in (("target", TARGET), ("negation", NEGATION), ("report", REPORT)):
            if w in words:
                return name, 0.0
        return "other", 0.0

    def weigh(self, symbols: list[tuple[str, float]]) -> float:
        """Compose the transducers over one clause."""
        return reported(negated(threatened(targeted(symbols))))

    def inputs(self, text: str, clauses: list[tuple[str, float]]) -> tuple[float, float, float]:
        return math.log1p(sum(w for _, w in clauses)), math.log1p(len(text)), 1.0

    def score(self, text: str, clauses: list[tuple[str, float]]) -> float:
        z = sum(a * x for a, x in zip(self.curve, self.inputs(text, clauses), strict=True))
        return round(1 / (1 + math.exp(-max(-50.0, min(50.0, z)))), 6)


# The transducers. Each reads the clause's (symbol, weight) pairs in order, keeps a small
# state, and writes the pairs with new weights.


def targeted(symbols: list[tuple[str, float]]) -> list[tuple[str, float]]:
    """An insult within three words after a target is a quarter heavier."""
    since, out = 9, []
    for kind, w in symbols:
        since = 0 if kind == "target" else since + 1
        out.append((kind, w * 1.25 if kind == "insult" and since <= 3 else w))
    return out


def threatened(symbols: list[tuple[str, float]]) -> list[tuple[str, float]]:
    """A threat counts only where the clause names a target after it."""
    ahead, out = False, []
    for kind, w in reversed(symbols):
        ahead = ahead or kind == "target"
        out.append((kind, 0.0 if kind == "threat" and not ahead else w))
    return out[::-1]


def negated(symbols: list[tuple[str, float]]) -> list[tuple[str, float]]:
    """A negation halves the weight of the two words that follow."""
    left, out = 0, []
    for kind, w in symbols:
        out.append((kind, w / 2 if left else w))
        left = 2 if kind == "negation" else max(0, left - 1)
    return out


def reported(symbols: list[tuple[str, float]]) -> float:
    """The clause's weight; what follows a verb of saying counts three quarters."""
    total, factor = 0.0, 1.0
    for kind, w in symbols:
        total += factor * w
        if kind == "report":
            factor = 0.75
    return total


def stems_of(text: str) -> Counter:
    """Stem -> how many words of the text have it."""
    out: Counter = Counter()
    for w, n in Counter(_LETTERS.findall(text.lower())).items():
        for size in PREFIX:
            if len(w) >= size:
                out[w[:size]] += n
        if len(w) >= 3:
            out[w + "$"] += n
    return out


def learn_stems(sample: DataFrame) -> dict[str, float]:
    """Stems whose share among toxic rows is beyond chance, with the log-ratio of their rates."""
    python_tasks(sample.sparkSession)
    sample = unlike_toxic(sample)
    n = {r.y: r for r in sample.groupBy("y").agg(F.count("*").alias("rows"), F.sum(F.length("t")).alias("chars")).collect()}
    if 0 not in n or 1 not in n or not n[0].chars or not n[1].chars:
        return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, uses = (Counter(), Counter()), (Counter(), Counter())
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = stems_of(t)
                uses[y].update(found)
                rows[y].update(found.keys())
        stems = [*(rows[0].keys() | rows[1].keys())]
        for i in range(0, len(stems), 50_000):
            s = stems[i : i + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(s), *(pa.array([c[x] for x in s], pa.int64()) for c in (*rows, *uses))], names=["stem", "rows0", "rows1", "uses0", "uses1"]
            )

    counts = (
        sample.select("t", "y").mapInArrow(run, "stem string, rows0 long, rows1 long, uses0 long, uses1 long")
        .groupBy("stem").agg(*(F.sum(c).alias(c) for c in ("rows0", "rows1", "uses0", "uses1")))
    )
    ratio = F.log((F.col("uses1") + 0.5) / F.lit(float(n[1].chars))) - F.log((F.col("uses0") + 0.5) / F.lit(float(n[0].chars)))
    share = F.col("rows1") / (F.col("rows0") + F.col("rows1"))
    # 2.5: twelve times as frequent
    ranked = (
        counts.where("rows1 >= 5").select("stem", "rows0", "rows1", ratio.alias("ratio"), share.alias("share"))
        .where(f"ratio > 2.5 and share > {n[1].rows / (n[0].rows + n[1].rows)}")
        .orderBy(F.desc(F.col("rows1") * F.col("share")), F.length("stem"), "stem").collect()
    )
    index = {r.stem: i for i, r in enumerate(ranked)}

    def having(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(index[s] for s in stems_of(t).keys() & index.keys()) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), pa.array(found, pa.list_(pa.int32()))], names=["k", "has"])

    has = sample.where("y = 1").select("k", "t").mapInArrow(having, "k string, has array<int>").toArrow().sort_by("k").column("has")
    rows = [np.asarray(r.values, "int64") for r in has]
    chosen = cover(rows, [r.stem.rstrip("$") for r in ranked], np.array([r.rows0 for r in ranked], "float64"), n[0].rows)
    return {ranked[i].stem: float(ranked[i].ratio) for i in chosen}


def unlike_toxic(sample: DataFrame) -> DataFrame:
    """The sample without toxic rows that are near-equal to others."""
    toxic = sample.where("y = 1").groupBy("t").agg(F.min(F.col("k").cast("string")).alias("k"))
    toxic = stored(sample.sparkSession, toxic.select("k", "t", F.lit(1).alias("y"), F.xxhash64("t").alias("h")), "toxic")

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mins = pa.array([sketch(t) for t in b.column(2).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), mins], names=["k", "h", "mins"])

    rows = sorted(toxic.select("k", "h", "t").mapInArrow(sketches, "k string, h long, mins array<long>").collect())
    kept = sample.sparkSession.createDataFrame([(r.h,) for r in unlike(rows)], "h long")
    toxic = toxic.join(F.broadcast(kept), "h", "left_semi").select("k", "t", "y")
    return sample.where("y = 0").select(F.col("k").cast("string").alias("k"), "t", "y").unionByName(toxic)


def sketch(text: str) -> list[int]:
    """Least hash of the text's words under 16 functions."""
    words = {*_LETTERS.findall(text.lower())} or {""}
    h = np.array([xxhash.xxh64_intdigest(w) for w in words], "uint64")
    odd = np.arange(1, 32, 2, dtype="uint64") * np.uint64(0x9E3779B97F4A7C15)
    return (h[:, None] * odd >> np.uint64(20)).min(0).astype("int64").tolist()


def unlike(rows: list) -> list:
    """Rows without those that share 12 of 16 least hashes with an earlier one: many copies
    of one toxic text must not make its every word look toxic."""
    seen: dict[tuple[int, int], list[int]] = {}
    out = []
    for r in rows:
        shared = Counter(i for m in enumerate(r.mins) for i in seen.get(m, ()))
        if max(shared.values(), default=0) < 12:
            for m in enumerate(r.mins):
                seen.setdefault(m, []).append(len(out))
            out.append(r)
    return out


def cover(rows: list[np.ndarray], stems: list[str], clean: np.ndarray, all_clean: int) -> list[int]:
    """Stems that explain toxic rows, greedily: the one with the least likely share among the
    rows that fewer than three chosen stems explain, so long as that is not chance. Longer
    forms of a chosen stem add nothing."""
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    stem = np.concatenate([np.zeros(0, "int64"), *rows])
    by, out, done = np.zeros(len(rows), "int64"), [], np.zeros(len(stems), bool)
    while len(stem):
        left = by < 3
        toxic = np.bincount(stem[left[row]], minlength=len(clean)).astype("float64")
        toxic[done] = 0
        p = max(1, left.sum()) / (max(1, left.sum()) + all_clean)
        share = np.clip(toxic / np.maximum(toxic + clean, 1), 1e-9, 1 - 1e-9)
        # log of the binomial bound: rows with the stem times the divergence of their share from p
        surprise = np.where((share > p) & (toxic >= 5), (toxic + clean) * (share * np.log(share / p) + (1 - share) * np.log((1 - share) / (1 - p))), 0)
        best = int(surprise.argmax())
        if surprise[best] < 13.8:  # one in a million, for about as many stems tried
            break
        out.append(best)
        done |= [s.startswith(stems[best]) for s in stems]
        by[row[stem == best]] += 1
    return out


def fit(sample: DataFrame) -> Grammar:
    """sample: (k, t, y), bounded; only counts and sums of numbers reach the driver."""
    grammar = Grammar(learn_stems(sample))
    if not grammar.stems:
        return grammar

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [grammar.inputs(t, grammar.clauses(t)) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in x], pa.float64()) for i in range(2)), b.column(1)], names=["a", "b", "y"])

    rows = sample.select("t", "y").mapInArrow(run, "a double, b double, y int").collect()
    x = np.array([(r.a, r.b, 1.0) for r in rows])
    grammar.curve = tuple(map(float, logistic(x, np.array([r.y for r in rows], "float64"))))
    return grammar


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02) -> np.ndarray:
    """Coefficients by damped Newton steps, with a small ridge."""
    b = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -50, 50)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(h, x.T @ (p - y) + ridge * b)
        b -= step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
    return b


def score(docs: DataFrame, grammar: Grammar, text: str = "text", column: str = "score", clauses: str = "clauses") -> DataFrame:
    """``docs`` with a score and the matched clauses; the names must be free."""
    python_tasks(docs.sparkSession)
    schema = StructType([*docs.schema, StructField(column, DoubleType()), StructField(clauses, ArrayType(StringType()))])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            found = [grammar.clauses(t) for t in texts]
            scores = [grammar.score(t, f) for t, f in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(scores, pa.float64()), pa.array([[c for c, _ in f] for f in found], pa.list_(pa.string()))],
                names=[*b.schema.names, column, clauses],
            )

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, fold: int = 2, of: int = 4, label: str = "toxic", column: str = "score") -> DataFrame:
    """Learn from ``labels`` and score all of ``docs`` (which has doc_id and text)."""
    return score(docs, fit(labelled_sample(docs, labels, label, fold, of, PER_CLASS)), column=column)
