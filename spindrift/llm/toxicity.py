"""Toxicity by a weighted finite-state grammar over clauses.

Transducers read a clause word by word: insults and threats (what is said),
targets (whom), negation and reported speech (how). They are composed into one
machine. Each of its arcs puts out relations (an insult beside a target, under
negation, in reported speech; a threat with intent and victim), and the path's
weight is the insults' own weights plus the relations'. Clauses, not words, are
scored; a text's score comes from its strongest clause and the weight of the
others by a logistic link.

What is fitted, on a bounded sample of labelled texts (``SAMPLE`` at most):

* the insult transducer's arcs: to the insults listed here come words and word
  beginnings chosen one by one, each for the toxic texts that no earlier one
  explains, so words that merely sit in copies of a toxic text aren't learned;
* the weight of each relation and the link, by the strongest clause of every
  text in turns with a logistic fit towards ``PRIOR``, which is what a relation
  keeps that the sample never shows.

Matching runs through one Aho-Corasick automaton, and only texts that it stops
in are cut into clauses.
"""

from __future__ import annotations

import bisect
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold
from .quality_knn import sample

#: Labelled texts that are sampled to fit: the bound of all that reaches the driver.
SAMPLE = 8000
#: The least number of toxic texts that an entry must explain, and the share of its texts that must be toxic.
SUPPORT, PRECISION = 4, 0.4
#: How many entries may be expected by chance, over all candidates.
CHANCE = 0.1
#: Word beginnings that may become entries have these lengths.
STEMS = (4, 5, 6, 7)
#: The weight of a listed insult while the sample says nothing about it.
LISTED = 4.0

# Closed classes of words, in English, German, French and Spanish.
INSULTS = (
    "idiot idiots moron morons imbecile stupid dumb fool loser losers scum scumbag trash garbage worthless pathetic disgusting filthy vermin pig clown jerk bastard bitch asshole dumbass freak creep coward liar "
    "dumm dummkopf trottel depp blödmann vollidiot versager abschaum dreck dreckig wertlos ekelhaft erbärmlich widerlich schwein arschloch feigling lügner "
    "idiote imbécile crétin abruti débile stupide minable ordure déchet dégoûtant pathétique connard salaud salope porc lâche menteur "
    "idiota imbécil estúpido estúpida tonto tonta basura escoria inútil asqueroso asquerosa patético patética cerdo cabrón gilipollas cobarde mentiroso"
).split()
TARGETS = "you your yours yourself u ya he him she they them du dir ihr sie er tu toi vous il elle ils usted ustedes él ella ellos tú eres".split()
VICTIMS = "dich euch ihn te t ti os lo la los las le les vous lui sie ihr dir".split()  # may stand before the verb
NEGATIONS = "not no never neither nor without cannot isn't aren't wasn't weren't don't doesn't didn't won't wouldn't can't couldn't shouldn't ain't nicht kein keine keinen nie niemals ohne pas jamais sans nunca jamás sin".split()
REPORTS = "said says say told wrote writes called calls claimed claims quoted according sagte sagt schrieb nannte laut dit disait écrit appelé selon dijo dice escribió llamó según".split()
THREATS = "kill murder stab shoot strangle hang beat hurt destroy töten umbringen erschießen schlagen tuer frapper assassiner matar golpear asesinar".split()
INTENTS = "will shall gonna going should must werde wirst soll muss vais va dois voy vas va debes".split()

#: What an arc can put out: relations of an insult, and threats.
RELATIONS = ("beside a target", "negated", "reported", "threat", "reported threat")
#: Weights before the sample is seen: the insults' own weight, each relation, and the log of the other clauses' weight.
PRIOR = (0.8, 0.5, -3.0, -1.5, 5.0, 1.5, 0.3)
#: How firmly the fit holds to them.
RIDGE = (2.0, 2.0, 2.0, 2.0, 2.0, 2.0, 2.0)
#: Words over which negation and a target reach.
REACH = 3
_ROUNDS = 6

_word = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|,")
_clause = re.compile(r"[^.!?;\n]+")

#: I insult, H threat, W intent, T target, V victim that is a target too, N negation, R report, "," a comma, - any other word.
SYMBOLS = "IHWTVNR,-"
_CLASS = {w: s for s, ws in (("T", TARGETS), ("V", VICTIMS), ("W", INTENTS), ("H", THREATS), ("R", REPORTS), ("N", NEGATIONS)) for w in ws}
_CLASS[","] = ","
_TAILS = {"ll": "W", "t": "N"}


def _symbols(word: str) -> str:
    """The symbols of a word: a contraction that isn't listed is two words ("i'll": any, intent)."""
    word = word.replace("’", "'")
    if "'" not in word or word in _CLASS:
        return _CLASS.get(word, "-")
    head, tail = word.split("'", 1)
    return _CLASS.get(head, "-") + (_TAILS.get(tail) or _CLASS.get(tail, "-"))


class Transducer:
    """A deterministic machine: step(state, symbol) gives the next state and the relations put out; state 0 is the start."""

    def __init__(self, arcs: dict[tuple[int, str], tuple[int, tuple[int, ...]]]):
        self.arcs = arcs

    @classmethod
    def of(cls, start, step) -> Transducer:
        """The machine of all states that step(state, symbol) -> (state, relations) reaches from start."""
        number, todo, arcs = {start: 0}, [start], {}
        for state in todo:
            for s in SYMBOLS:
                after, out = step(state, s)
                if after not in number:
                    number[after] = len(number)
                    todo.append(after)
                arcs[number[state], s] = (number[after], out)
        return cls(arcs)

    def step(self, state: int, symbol: str) -> tuple[int, tuple[int, ...]]:
        return self.arcs[state, symbol]

    def compose(self, other: Transducer) -> Transducer:
        """Both at once on the same word; what they put out adds up."""

        def step(state: tuple[int, int], symbol: str) -> tuple[tuple[int, int], tuple[int, ...]]:
            (a, x), (b, y) = self.step(state[0], symbol), other.step(state[1], symbol)
            return (a, b), x + y

        return Transducer.of((0, 0), step)


def targets() -> Transducer:
    """An insult at most REACH words after a target, or before one."""

    def step(state: tuple[int, int], s: str) -> tuple[tuple[int, int], tuple[int, ...]]:
        after_target, after_insult = state
        hit = (s == "I" and after_target > 0) or (s in "TV" and after_insult > 0)
        less = lambda n: n if s == "," else max(0, n - 1)
        return (REACH if s in "TV" else less(after_target), REACH if s == "I" and not hit else 0 if hit else less(after_insult)), (0,) if hit else ()

    return Transducer.of((0, 0), step)


def negations() -> Transducer:
    """An insult at most REACH words after a negation; what stands between two commas isn't counted."""

    def step(state: tuple[int, bool], s: str) -> tuple[tuple[int, bool], tuple[int, ...]]:
        left, aside = state
        if s == "N":
            return (REACH, False), ()
        if s == "," and left:
            return (left, not aside), ()
        if aside:
            return state, ()
        return (max(0, left - 1), False), (1,) if s == "I" and left else ()

    return Transducer.of((0, False), step)


def reports() -> Transducer:
    """An insult after a verb of speech, which holds to the end of the clause."""
    return Transducer.of(False, lambda state, s: (state or s == "R", (2,) if state and s == "I" else ()))


def threats() -> Transducer:
    """A verb of violence within reach of an intent, with a victim between them or at most two words after; a negation undoes the intent."""

    def step(state: tuple[int, bool, int, bool], s: str) -> tuple[tuple[int, bool, int, bool], tuple[int, ...]]:
        intent, victim, verb, told = state
        kind = (4 if told else 3,)
        told = told or s == "R"
        if s == "W":
            return (REACH + 1, False, 0, told), ()
        if s == "N":
            return (0, False, 0, told), ()
        if s == "H" and intent:
            return (0, False, 0 if victim else 3, told), kind if victim else ()
        out = kind if verb and s in "TV" else ()
        return (max(0, intent - 1), victim and intent > 1 or (s == "V" and intent > 0), 0 if out else max(0, verb - 1), told), out

    return Transducer.of((0, False, 0, False), step)


def grammar() -> Transducer:
    return targets().compose(negations()).compose(reports()).compose(threats())


def _words(texts: list[str]) -> list[set[str]]:
    """The different words of each text; texts share one object for a word."""
    pool: dict[str, str] = {}
    return [{pool.setdefault(w, w) for w in _word.findall(t.lower())} for t in texts]


def _one_of_copies(words: list[set[str]], labels: list[int]) -> list[int]:
    """The places of texts without near copies of equal label: those whose four least word hashes are the same."""
    known = {w: zlib.crc32(w.encode("utf-8", "surrogatepass")) for own in words for w in own}
    first: dict[tuple, int] = {}
    for i, (own, y) in enumerate(zip(words, labels, strict=True)):
        first.setdefault((tuple(sorted({known[w] for w in own})[:4]), y), i)
    return sorted(first.values())


def learn_lexicon(texts: list[str], labels: list[int]) -> dict[str, float]:
    """Entries (a word ends in "$", a beginning doesn't) and their weights: log odds of toxic against other texts. Of near copies one counts."""
    words = _words(texts)
    some = _one_of_copies(words, labels)
    return _lexicon([words[i] for i in some], [labels[i] for i in some])


def _lexicon(words: list[set[str]], labels: list[int]) -> dict[str, float]:
    n_toxic = sum(1 for y in labels if y)
    n_clean = len(words) - n_toxic
    if not n_toxic or not n_clean:
        return {}
    def entries(word: str) -> list[str]:
        return ([word + "$"] if len(word) > 2 else []) + [word[:k] for k in STEMS if len(word) >= k]

    posting: dict[str, list[int]] = defaultdict(list)
    for i, (own, y) in enumerate(zip(words, labels, strict=True)):
        if y:
            for e in {e for w in own if w != "," for e in entries(w)}:
                posting[e].append(i)
    # So many toxic texts by chance alone are too unlikely, among all candidates.
    support = max(SUPPORT, math.ceil(math.log(len(posting) / CHANCE + 1) / math.log((n_toxic + n_clean) / n_toxic)))
    posting = {e: p for e, p in posting.items() if len(p) >= support}
    none: list[str] = []
    known, clean = {",": none}, Counter()  # by word the entries that are left of it
    for own, y in zip(words, labels, strict=True):
        if not y:
            for w in own:
                if w not in known:
                    known[w] = [e for e in entries(w) if e in posting] or none
            clean.update({e for w in own for e in known[w]})
    good = {e: set(p) for e, p in posting.items() if len(p) >= PRECISION * (len(p) + clean[e]) and len(p) / (n_toxic + 1) > 3 * clean[e] / (n_clean + 1)}

    def rank(e: str) -> tuple:
        """By what it explains and how purely; then the narrowest: words before beginnings, longer before shorter."""
        return (len(good[e]) * (len(posting[e]) / (len(posting[e]) + clean[e])) ** 2, e.endswith("$"), len(e), e)

    # What an entry explains only shrinks as others are taken, so the best of the old ranks is looked at again before it counts.
    held = {e: rank(e) for e in good}
    order, taken, found = sorted(held, key=held.get), set(), {}
    while order:
        best = order.pop()
        good[best] -= taken
        if not good[best]:
            continue
        now = rank(best)
        if now != held[best]:
            held[best] = now
            bisect.insort(order, best, key=held.get)
            continue
        taken |= good[best]
        found[best] = math.log((len(posting[best]) + 0.5) / (n_toxic + 1)) - math.log((clean[best] + 0.5) / (n_clean + 1))
    return found


class Clause:
    """Where a clause lies, its insults' weight and how often each relation holds."""

    __slots__ = ("span", "insults", "relations")

    def __init__(self, span: tuple[int, int], insults: float, relations: list[int]):
        self.span, self.insults, self.relations = span, insults, relations


class Scorer:
    """Lexicon, grammar, relation weights and link; learned from a sample or given. relations=False scores the insults' own weights alone."""

    def __init__(self, lexicon: dict[str, float], weights: tuple[float, ...] = PRIOR, base: float = -4.0, relations: bool = True):
        self.lexicon, self.weights, self.base, self.relations, self.machine = lexicon, weights, base, relations, grammar()
        self._automaton = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def _matches(self, low: str) -> list[tuple[int, str, float]]:
        """Where insults and threats begin, with their symbol and weight."""
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for entry, weight in [*((w + "$", 0.0) for w in THREATS), *self.lexicon.items()]:
                whole = entry.endswith("$")
                word = entry[:-1] if whole else entry
                held = self._automaton.get(word, None)
                self._automaton.add_word(word, [*(held or []), (len(word), whole, "I" if entry in self.lexicon else "H", weight)])
            self._automaton.make_automaton()
        out = []
        for end, entries in self._automaton.iter(low):
            for size, whole, symbol, weight in entries:
                at = end - size + 1
                if (at == 0 or not low[at - 1].isalpha()) and not (whole and end + 1 < len(low) and low[end + 1].isalpha()):
                    out.append((at, symbol, weight))
        return out

    def clauses(self, text: str) -> list[Clause]:
        """Clauses that hold an insult or a threat."""
        low = text.lower()
        matches = self._matches(low)
        if not matches:
            return []
        insult: dict[int, float] = {}
        for at, s, w in matches:
            if s == "I":
                insult[at] = max(w, insult.get(at, w))
        spans = [m.span() for m in _clause.finditer(low)]
        starts = [a for a, _ in spans]
        out = []
        for i in sorted({bisect.bisect_right(starts, at) - 1 for at, *_ in matches}):
            a, b = spans[i]
            state, own, counts = 0, 0.0, [0] * len(RELATIONS)
            for m in _word.finditer(low, a, b):
                said = m.start() in insult
                own += insult.get(m.start(), 0.0)
                for symbol in "I" if said else _symbols(m[0]):
                    state, relations = self.machine.step(state, symbol)
                    for r in relations:
                        counts[r] += 1
            if own or any(counts):
                out.append(Clause((a, b), own, counts))
        return out

    def _vectors(self, clauses: list[Clause]) -> np.ndarray:
        x = np.array([(c.insults, *c.relations) for c in clauses], float)
        return x if self.relations else x * np.array([1.0] + [0.0] * len(RELATIONS))

    def judge(self, text: str | None) -> tuple[float, int, str | None]:
        """Score, number of clauses above zero, and the strongest of them."""
        clauses = self.clauses(text or "")
        if not clauses:
            return self._link(self.base), 0, None
        paths = self._vectors(clauses) @ np.array(self.weights[:-1])
        best = int(paths.argmax())
        z = self.base + paths[best] + self.weights[-1] * math.log1p(max(0.0, float(np.delete(paths, best).clip(0).sum())))
        a, b = clauses[best].span
        return self._link(z), int((paths > 0).sum()), (text or "").lower()[a:b].strip() if paths[best] > 0 else None

    def score(self, text: str | None) -> float:
        return self.judge(text)[0]

    @staticmethod
    def _link(z: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def fit(self, texts: list[str], labels: list[int]) -> None:
        """Relation weights and link: the strongest clause of each text under the weights so far, then a logistic fit, in turns."""
        held = [self._vectors(c) if (c := self.clauses(t)) else None for t in texts]
        y, mean, ridge = np.array(labels, float), np.array((0.0, *PRIOR)), np.diag((0.01, *RIDGE))
        beta = np.array((self.base, *self.weights))
        for _ in range(_ROUNDS):
            x = np.zeros((len(texts), len(beta)))
            x[:, 0] = 1
            for row, own in zip(x, held, strict=True):
                if own is not None:
                    paths = own @ beta[1:-1]
                    best = int(paths.argmax())
                    row[1:-1], row[-1] = own[best], math.log1p(np.delete(paths, best).clip(0).sum())
            for _ in range(30):
                p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
                step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ (beta - mean))
                beta = beta + np.clip(step, -2, 2)
                if abs(step).max() < 1e-6:
                    break
        self.base, self.weights = float(beta[0]), tuple(float(b) for b in beta[1:])


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", size: int = SAMPLE, relations: bool = True) -> Scorer:
    """A scorer from a sample of labelled rows; by default those whose crc32(id) mod 4 isn't 2. Without any, the listed insults and threats score by PRIOR."""
    rows = sample(docs, labels, label_col, fold(id_col, 4) != 2 if learn is None else learn, size, id_col, text_col)
    return fit_texts([t for t, _ in rows], [y for _, y in rows], relations)


def fit_texts(texts: list[str], labels: list[int], relations: bool = True) -> Scorer:
    """A scorer from labelled texts. A listed insult that the sample has in as many other as toxic texts is left out."""
    words = _words(texts)
    some = _one_of_copies(words, labels)
    learned = _lexicon([words[i] for i in some], [labels[i] for i in some])
    n_toxic, asked = sum(labels), set(INSULTS)
    seen = {1: Counter(), 0: Counter()}
    for i in some:
        seen[1 if labels[i] else 0].update(words[i] & asked)
    rate = lambda w, y, n: (seen[y][w] + 0.5) / (n + 1)
    listed = {w + "$": LISTED for w in INSULTS if seen[0][w] < SUPPORT or rate(w, 1, n_toxic) > 3 * rate(w, 0, len(texts) - n_toxic)}
    scorer = Scorer(listed | learned, relations=relations)
    if len(set(labels)) == 2:
        scorer.fit(texts, labels)
    return scorer


def score(docs: DataFrame, scorer: Scorer, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """docs with a struct of score (0 to 1), n_clauses and worst (the strongest clause); a column of that name is replaced.

    Null and empty texts, and texts without a match, have the link's base score,
    no clauses and a null worst. Equal texts have equal scores; of clauses that
    tie the first is the worst.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    @F.arrow_udf("struct<score: double, n_clauses: int, worst: string>")
    def judge(texts: pa.Array) -> pa.Array:
        own = shared.value
        scores, counts, worst = zip(*(own.judge(t) for t in texts.to_pylist()), strict=True) if len(texts) else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(counts, pa.int32()), pa.array(worst, pa.string())], names=["score", "n_clauses", "worst"])

    return docs.select(*[c for c in docs.columns if c != out], judge(F.col(text_col).cast("string")).alias(out))
