"""Toxicity by a weighted finite-state pattern grammar over the clauses of a text.

Words become classes (insult, threat, target, negation, reported speech, determiner, intensifier, modal). Three small
transducers read a clause's classes: one rewrites insults and threats inside the scope of a negation, one those after a
verb of reported speech, one weighs what is left, more where a target or a strong intensifier stands in the same clause.
They are composed once into a single deterministic machine.

Clauses decide, not words: an insult that nothing supports weighs less than THRESHOLD. Support is a target ("you idiot"), a
strong intensifier ("utter moron"), a second insult of the clause, or a second matched clause within NEAR characters. A
document's score is the largest sum of matched clauses that begin within NEAR characters of each other, so neither a long text
nor what is negated, reported or a threat to nobody adds up to a verdict; it is toxic from THRESHOLD on.

The lexicon holds English words; insults of other languages are learnt from a bounded sample of labelled documents
(SAMPLE of each class), as words and as stems. Near copies in the sample count once, so a copied text teaches nothing.

A compiled pattern over the Arrow column passes on only texts with an insult or a threat at all, between characters that end a
word for the clause reader too (so _emphasis_ hides nothing); no clause without one can score, so nothing is lost. One narrow
pass, no shuffle.

Defined results: a null or empty text scores 0.0 and is not toxic; very long texts are read whole; repeated rows are
scored each; a null doc_id stays null; extra columns are ignored; an empty table gives an empty result. Clauses that tie in
weight all count. An empty table of labels, or one without toxic rows, teaches nothing: the English lexicon alone is used.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped

INSULTS = (
    "idiot idiots idiotic moron morons moronic scum loser losers clown clowns trash stupid worthless pathetic disgusting imbecile imbeciles "
    "dumb dumbass asshole assholes bastard bastards bitch jerk jerks fool fools vermin filth filthy subhuman pig pigs"
).split()
THREATS = "kill hurt destroy murder strangle stab shoot burn hang beat crush".split()
LEXICON = {
    "I": INSULTS,
    "H": THREATS,
    "T": "you your yours yourself yourselves youre you're u ya du dich dir euch ihr tu toi te vous ti usted ustedes vosotros tú".split(),
    "P": "he she they them him her his their these those people everyone".split(),
    "N": "not never no nor neither isn't aren't wasn't weren't ain't don't doesn't didn't cannot can't won't nicht kein keine pas".split(),
    "D": "a an the such any some this that one of".split(),
    "X": "so very really just even".split(),
    "S": "total totally complete completely absolute absolutely utter utterly fucking damn bloody".split(),
    "R": "said says saying called calls calling wrote writes quoted quotes claimed claims alleged allegedly reportedly shouted yelled tweeted".split(),
    "M": "will gonna should must shall wanna i'll we'll".split(),
}
CLASS = {word: c for c, words in LEXICON.items() for word in words}
#: Words after a negation, determiners and intensifiers only, that it still reaches over.
SCOPE = 3
INSULT, LEARNT, TARGETED, INTENSE, NEGATED, REPORTED, THREAT, THREAT_TARGET = 1.0, 0.6, 0.5, 0.5, 0.1, 0.3, 0.5, 1.5
#: Above the weight of an insult that nothing supports.
THRESHOLD = 1.1
#: Characters within which matched clauses support each other.
NEAR = 2000
_CLAUSE = re.compile(r"[^.,;:!?\n\r()\"“”]+")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
#: Labelled documents of each class that the insults of further languages are learnt from: those of the smallest md5(doc_id).
SAMPLE = 4000
#: A word or stem is learnt where toxic documents hold it ODDS times as often as clean ones and where so many unrelated toxic
#: documents hold it that chance would give all of them to the toxic side with a probability of CHANCE at most.
ODDS, CHANCE = 60.0, 1e-6
#: Words that must share a stem, and lengths of stems.
STEM_WORDS = 3
STEMS = (4, 5, 6, 7)

#: A transducer: (state, symbol) -> (state, symbol, weight); symbols it does not name pass unchanged from and to `rest`.
Machine = dict[tuple[object, str], tuple[object, str, float]]


def negation() -> Machine:
    """Insults (I, learnt ones L) and threats (H) become i and h in the scope of a negation."""
    m: Machine = {}
    for left in range(SCOPE + 1):
        for c in "ILHTPNDXSRMO":
            m[left, c] = (0, c, 0.0)
        m[left, "N"] = (SCOPE, "N", 0.0)
        if left:
            m[left, "I"], m[left, "L"], m[left, "H"] = ((left - 1, x, 0.0) for x in "iih")
            m[left, "D"], m[left, "X"], m[left, "S"] = ((left - 1, x, 0.0) for x in "DXS")
    return m


def reported() -> Machine:
    """Insults and threats become j and k after a verb of reported speech."""
    m: Machine = {}
    for on in (False, True):
        for c in "ILHTPNDXSRMOih":
            m[on, c] = (on or c == "R", {"I": "j", "L": "j", "H": "k"}.get(c, c) if on else c, 0.0)
    return m


def scoring() -> Machine:
    """Weighs insults, and threats that a modal leads in; a target counts once, before or after, an intensifier right before."""
    m: Machine = {}
    for target in (False, True):
        for insult in range(4):  # 1: there was one; 2 more: a strong intensifier has just been read
            had = insult & 1
            for threat in (0, 1, 2):  # nothing, a modal, a threat without its target
                for c in "ILHTPNDXSRMOihjk":
                    to, weight = (target, had, threat), 0.0
                    if c in "IL":
                        weight = (INSULT if c == "I" else LEARNT) + (TARGETED if target and not had else 0.0) + (INTENSE if insult & 2 else 0.0)
                        to = (target, 1, threat)
                    elif c == "S":
                        to = (target, had | 2, threat)
                    elif c == "i":
                        weight = INSULT * NEGATED
                    elif c == "j":
                        weight = INSULT * REPORTED
                    elif c == "T":
                        weight = (TARGETED if had and not target else 0.0) + (THREAT_TARGET if threat == 2 else 0.0)
                        to = (True, had, 0 if threat == 2 else threat)
                    elif c == "P":
                        weight, to = (THREAT_TARGET, (target, had, 0)) if threat == 2 else (0.0, to)
                    elif c == "M":
                        to = (target, had, 1)
                    elif c == "H" and threat == 1:
                        to, weight = (target, had, 2), THREAT
                    m[(target, insult, threat), c] = (to, c, weight)
    return m


def compose(first: Machine, second: Machine, start: tuple) -> tuple[Machine, tuple]:
    """The machine that feeds the output of first to second; weights add up."""
    out: Machine = {}
    todo, seen = deque([start]), {start}
    symbols = {c for _, c in first}
    while todo:
        a, b = todo.popleft()
        for c in symbols:
            if (a, c) not in first:
                continue
            to_a, middle, w1 = first[a, c]
            to_b, last, w2 = second[b, middle]
            out[(a, b), c] = ((to_a, to_b), last, w1 + w2)
            if (to_a, to_b) not in seen:
                seen.add((to_a, to_b))
                todo.append((to_a, to_b))
    return out, start


def grammar() -> tuple[Machine, tuple]:
    m, start = compose(negation(), reported(), (0, False))
    return compose(m, scoring(), (start, (False, False, 0)))


GRAMMAR, START = grammar()


class Clause(NamedTuple):
    start: int
    end: int
    weight: float
    counts: float  # of the weight, what is neither negated, reported nor a threat to nobody


class Lexicon:
    """Word classes, with learnt insults; `hit` finds every text that can score."""

    def __init__(self, words: tuple[str, ...] = (), stems: tuple[str, ...] = ()) -> None:
        self.words, self.stems = frozenset(words), frozenset(stems)
        # What ends a word here are all characters but ASCII letters and digits, no fewer than end one for _WORD.
        left, right = "(?:^|[^A-Za-z0-9])", "(?:$|[^A-Za-z0-9])"
        whole = "|".join(re.escape(w) for w in sorted({*INSULTS, *THREATS, *self.words}) if w.isascii())
        begun = "|".join(re.escape(w) for w in sorted(self.stems) if w.isascii())
        other = [re.escape(w) for w in sorted({*self.words, *self.stems}) if not w.isascii()]
        self.hit = "(?i)" + "|".join([f"{left}(?:{whole}){right}", *([f"{left}(?:{begun})"] if begun else []), *other])

    def of(self, word: str) -> str:
        found = CLASS.get(word)
        if found:
            return found
        return "L" if word in self.words or any(word[:n] in self.stems for n in STEMS) else "O"

    def matched(self, text: str) -> list[Clause]:
        """The clauses that score."""
        out = []
        for clause in _CLAUSE.finditer(text):
            state, total, counts, threats, any_hit = START, 0.0, 0.0, 0.0, False
            for word in _WORD.finditer(clause.group().lower()):
                c = self.of(word.group().replace("’", "'"))
                any_hit = any_hit or c in "ILH"
                state, read, weight = GRAMMAR[state, c]
                total += weight
                if read == "H":
                    threats += weight
                elif read not in "ij":
                    # A threat counts once its target is there.
                    if read in "TP" and weight >= THREAT_TARGET:
                        threats, weight = 0.0, weight + threats
                    counts += weight
            if any_hit and total > 0:
                out.append(Clause(clause.start(), clause.end(), round(total, 6), round(counts, 6)))
        return out

    def clauses(self, text: str) -> list[tuple[int, int, float]]:
        """start, end and weight of each clause that scores."""
        return [c[:3] for c in self.matched(text)]

    def found(self, texts: pa.Array) -> dict[int, list[Clause]]:
        """The scoring clauses by row."""
        hits = pc.indices_nonzero(pc.match_substring_regex(pc.fill_null(texts, ""), self.hit)).to_pylist()
        return {i: c for i in hits if (c := self.matched(texts[i].as_py()))}


def score(clauses: list[Clause]) -> float:
    """The largest sum of what counts of clauses (in order) that begin within NEAR characters of each other."""
    best, now, first = 0.0, 0.0, 0
    for c in clauses:
        now += c.counts
        while clauses[first].start < c.start - NEAR:
            now -= clauses[first].counts
            first += 1
        best = max(best, round(now, 6))
    return best


def _unrelated(texts: list[set[str]]) -> list[set[str]]:
    """Word sets without those that share half of their words with an earlier one."""
    kept: list[set[str]] = []
    where: dict[str, list[int]] = {}
    for words in texts:
        long = [w for w in words if len(w) > 5]
        near = Counter(i for w in long for i in where.get(w, ()))
        if any(n > 0.5 * max(len(long), 1) for _, n in near.most_common(1)):
            continue
        for w in long:
            where.setdefault(w, []).append(len(kept))
        kept.append(words)
    return kept


def learn(toxic: list[str], clean: list[str]) -> tuple[list[str], list[str]]:
    """Words and stems that mark the toxic texts."""
    sets = [[{m.group() for m in _WORD.finditer(t.lower())} for t in texts] for texts in (sorted(toxic), clean)]
    sets[0] = _unrelated(sets[0])
    counts = []
    for texts in sets:
        n: Counter = Counter()
        for words in texts:
            n.update((0, w) for w in words)
            n.update({(1, w[:k]) for w in words for k in STEMS if len(w) > k})
        counts.append(n)
    bad, good = counts
    members: dict[str, int] = Counter(w[:k] for kind, w in bad if not kind for k in STEMS if len(w) > k)

    share = len(sets[0]) / max(1, len(sets[0]) + len(sets[1]))
    least = math.ceil(math.log(CHANCE) / math.log(min(max(share, 1e-3), 0.9)))

    def marks(key: tuple[int, str]) -> bool:
        n = bad[key]
        return n >= least and (n + 0.5) / (len(sets[0]) + 1) >= ODDS * (good[key] + 0.5) / (len(sets[1]) + 1)

    stems = {w for kind, w in bad if kind and members[w] >= STEM_WORDS and marks((1, w))}
    # Of nested stems that the same documents hold, the longest; of others the shortest.
    for k in STEMS[:-1]:
        for w in [w for w in stems if len(w) == k]:
            longer = [x for x in stems if len(x) == k + 1 and x.startswith(w)]
            if longer and sum(bad[1, x] for x in longer) >= 0.9 * bad[1, w] and len(longer) == 1:
                stems.discard(w)
    stems -= {w for w in stems if any(w[:k] in stems for k in STEMS if k < len(w))}
    words = {w for kind, w in bad if not kind and w not in CLASS and len(w) > 2 and marks((0, w))}
    return sorted(w for w in words if not any(w[:k] in stems for k in STEMS)), sorted(stems)


def lexicon(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Lexicon:
    """The lexicon with what a bounded sample of labelled documents teaches; learnt in one task from the sample alone."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id"), (F.col("toxic") > 0).alias("_toxic")).distinct()
    chosen = [known.where("_toxic" if t else "NOT _toxic").orderBy(F.md5(F.col("_id").cast("string")), "_id").limit(sample) for t in (True, False)]
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen[0].unionByName(chosen[1])), F.col("doc_id") == F.col("_id"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        words, stems = learn(*(pdf["text"][pdf["_toxic"] == t].drop_duplicates().sort_values().tolist() for t in (True, False)))
        return pd.DataFrame({"term": pd.Series([*words, *stems], dtype=object), "stem": np.repeat([False, True], [len(words), len(stems)])})

    found = rows.select(F.lit(0).alias("_all"), "text", "_toxic").groupBy("_all").applyInPandas(fit, "term string, stem boolean").collect()
    return Lexicon(tuple(r.term for r in found if not r.stem), tuple(r.term for r in found if r.stem))


def toxicity(docs: DataFrame, labels: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, n_clauses, clauses (start, end and weight of each that scores) and toxic for each document."""
    lex = lexicon(docs, labels) if labels is not None else Lexicon()
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("weight", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = lex.found(batch.column(1))
            rows = [found.get(i, []) for i in range(len(batch))]
            columns = [pa.array([score(x) for x in rows], pa.float64()), pa.array([len(x) for x in rows], pa.int64()), pa.array([[{"start": c.start, "end": c.end, "weight": c.weight} for c in x] for x in rows], kind)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "score", "n_clauses", "clauses"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, score double, n_clauses long, clauses array<struct<start:int,end:int,weight:double>>")
    return out.withColumn("toxic", F.col("score") >= threshold)


def drop_toxic(docs: DataFrame, labels: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not toxic, with their own columns: each batch is filtered where it is scored."""
    lex = lexicon(docs, labels) if labels is not None else Lexicon()
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(len(batch), dtype=bool)
            for i, found in lex.found(batch.column(at)).items():
                keep[i] = score(found) < threshold
            yield batch.filter(pa.array(keep))

    return mapped(docs, run)
