"""Toxicity of whole texts: misspelled lexicon terms and the context they stand in.

The lexicon is learned from labelled documents. Its trie and a Levenshtein automaton make one
deterministic automaton that reads each word once. A hit weighs less where the words around it
quote or report it and more where they address someone. A logistic model turns the weights into a score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from controlweave.llm.tables import batch, chunks, decoded, payloads, prepared

#: Labelled documents that the model is fitted on, about; all if there are fewer.
TRAINING_ROWS = 20_000
#: Terms of the lexicon and words known to be harmless, at most: the size of the model.
TERMS = 256
HARMLESS = 4096
#: Evidence that a term needs, in nats: its documents' share of toxic ones against the overall share.
EVIDENCE = 12.0
#: Terms of fewer letters must be met exactly.
FUZZY_LETTERS = 5
#: Words on either side of a hit that make its context.
CONTEXT_WORDS = 8
FUZZY, QUOTED, REPORTED, DENIED, DIRECTED = 0.8, 0.3, 0.5, 0.6, 1.25
THRESHOLD = 0.3

_OPENING, _CLOSING = "\"“„«‹", "\"”“»›"
_REPORTING = frozenset(
    "said says saying wrote writes called calls quote quoted quotes quoting word words term terms slur insult insults "
    "dit disait mot terme sagte sagt wort begriff dijo dice palabra término".split()
)
_DENYING = frozenset("not never no isn't aren't wasn't pas jamais nicht kein keine nie nunca".split())
_ADDRESSING = frozenset("you you're your u ur tu toi vous votre du dich dein ihr sie usted eres ti".split())
_WORD = re.compile(r"\w[\w'’]*")


class Automaton:
    """A deterministic automaton for all words within one edit of a lexicon's terms.

    States are sets of (trie node, edits so far); the trie keeps terms with a common begin together.
    ``step[state, letter class]`` is the next state, 0 the dead one; ``term`` and ``edits`` tell what
    a state accepts (-1: nothing).
    """

    def __init__(self, terms: list[str], edits: int = 1, fuzzy_letters: int = FUZZY_LETTERS) -> None:
        letters = sorted({c for t in terms for c in t})
        self.classes = np.zeros(1 << 16, np.int32)
        for k, c in enumerate(letters, 1):
            if ord(c) < 1 << 16:
                self.classes[ord(c)] = k
        trie: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        budget = [0]
        for number, term in enumerate(terms):
            node, allowed = 0, edits if len(term) >= fuzzy_letters else 0
            budget[0] = max(budget[0], allowed)
            for c in term:
                k = letters.index(c) + 1
                if k not in trie[node]:
                    trie[node][k] = len(trie)
                    trie.append({})
                    budget.append(0)
                node = trie[node][k]
                budget[node] = max(budget[node], allowed)
            ends[node] = number
        own = [edits if len(t) >= fuzzy_letters else 0 for t in terms]

        def closed(state: set[tuple[int, int]]) -> frozenset:
            """With the letters of terms that a word may lack."""
            todo, best = list(state), {}
            while todo:
                node, e = todo.pop()
                if e > budget[node] or best.get(node, 99) <= e:
                    continue
                best[node] = e
                todo += [(child, e + 1) for child in trie[node].values()]
            return frozenset(best.items())

        start = closed({(0, 0)})
        states, table, accepted = {frozenset(): 0, start: 1}, [], []
        queue = [frozenset(), start]
        for state in queue:
            row = []
            for k in range(len(letters) + 1):
                after: set[tuple[int, int]] = set()
                for node, e in state:
                    if k in trie[node]:
                        after.add((trie[node][k], e))
                    after.add((node, e + 1))  # a letter too many
                    after |= {(child, e + 1) for child in trie[node].values()}  # another letter
                new = closed(after)
                if new not in states:
                    states[new] = len(queue)
                    queue.append(new)
                row.append(states[new])
            table.append(row)
            hits = sorted((e, ends[node]) for node, e in state if node in ends and e <= own[ends[node]])
            accepted.append(hits[0] if hits else (-1, -1))
        self.step = np.array(table, np.int32)
        self.edits, self.term = (np.array([a[k] for a in accepted], np.int32) for k in range(2))
        self.shortest = min(map(len, terms), default=1) - edits
        self.longest = max(map(len, terms), default=0) + edits

    def read(self, letters: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words (their index) that end in an accepting state, and that state."""
        sizes = ends - starts
        alive = np.flatnonzero((sizes >= self.shortest) & (sizes <= self.longest))
        state = np.ones(len(alive), np.int32)
        found, found_states = [], []
        for place in range(self.longest + 1):
            done = sizes[alive] == place
            if done.any():
                at, s = alive[done], state[done]
                good = self.term[s] >= 0
                found.append(at[good])
                found_states.append(s[good])
                alive, state = alive[~done], state[~done]
            if not len(alive):
                break
            state = self.step[state, letters[starts[alive] + place]]
            keep = state > 0
            alive, state = alive[keep], state[keep]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int32)
        order = np.argsort(np.concatenate(found), kind="stable")
        return np.concatenate(found)[order], np.concatenate(found_states)[order]


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Which code points of the basic plane are white space, and which letters or digits."""
    points = [chr(i) for i in range(1 << 16)]
    return np.array([c.isspace() for c in points]), np.array([c.isalnum() for c in points])


@dataclass
class Hit:
    """A word of a text that matches a term."""

    term: str
    found: str
    start: int
    edits: int
    context: str
    weight: float


@dataclass
class Model:
    """What is learned: terms with weights, harmless words, and the logistic model's coefficients."""

    terms: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    harmless: frozenset[str] = frozenset()
    coefficients: list[float] = field(default_factory=lambda: [-3.0, 0.0, 0.0, 0.0])
    automaton: Automaton | None = None

    def __post_init__(self) -> None:
        self.automaton = self.automaton or Automaton(self.terms)


def _context(text: str, start: int, end: int) -> str:
    """How the words around a hit use it: quoted, reported, denied, directed or plain."""
    before, after = text[max(0, start - 12 * CONTEXT_WORDS) : start], text[end : end + 12 * CONTEXT_WORDS]
    near = _WORD.findall(before)[-CONTEXT_WORDS:]
    opened = max((before.rfind(c) for c in _OPENING), default=-1)
    if opened >= 0 and "\n" not in before[opened:]:
        inside = before[opened + 1 :]
        closes = min((i for i in (after.find(c) for c in _CLOSING) if i >= 0), default=-1)
        if closes >= 0 and "\n" not in after[:closes] and len(_WORD.findall(inside)) + len(_WORD.findall(after[:closes])) <= CONTEXT_WORDS:
            return "quoted"
    if any(w in _REPORTING for w in near):
        return "reported"
    if any(w in _DENYING for w in near[-3:]):
        return "denied"
    if any(w in _ADDRESSING for w in near[-4:] + _WORD.findall(after)[:3]):
        return "directed"
    return "plain"


_FACTOR = {"quoted": QUOTED, "reported": REPORTED, "denied": DENIED, "directed": DIRECTED, "plain": 1.0}


class Reader:
    """Finds hits in texts, many at once."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.white, self.alnum = _tables()

    def hits(self, texts: list[str]) -> Iterator[tuple[int, list[Hit]]]:
        """The number of words and the hits of each text."""
        lowered = [t.lower() for t in texts]
        joined = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.minimum(joined, (1 << 16) - 1).astype(np.int64)
        sound = np.flatnonzero(self.alnum[points])
        white = np.concatenate([[-1], np.flatnonzero(self.white[points])])
        starts, ends = white[:-1] + 1, white[1:]
        filled = ends > starts
        starts, ends = starts[filled], ends[filled]
        # marks around a word don't belong to it, marks within it do
        first = np.searchsorted(sound, starts)
        last = np.searchsorted(sound, ends) - 1
        worded = last >= first
        at, to = (sound[first[worded]], sound[last[worded]] + 1) if len(sound) else (starts[:0], ends[:0])
        begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in lowered])])
        counts = np.diff(np.searchsorted(at, begins))
        automaton = self.model.automaton
        words, states = automaton.read(automaton.classes[points], at, to)
        owner = np.searchsorted(begins, at[words], side="right") - 1
        out: list[list[Hit]] = [[] for _ in texts]
        for w, s, i in zip(words, states, owner, strict=True):
            text, start = lowered[i], int(at[w] - begins[i])
            found = text[start : start + int(to[w] - at[w])]
            edits, term = int(automaton.edits[s]), int(automaton.term[s])
            if edits and found in self.model.harmless:
                continue
            context = _context(text, start, start + len(found))
            weight = self.model.weights[term] * (FUZZY if edits else 1.0) * _FACTOR[context]
            out[i].append(Hit(self.model.terms[term], found, start, edits, context, weight))
        yield from zip(counts.tolist(), out, strict=True)


def features(n_words: int, hits: list[Hit]) -> list[float]:
    """All weight together, the heaviest hit, and weight per root of the length."""
    total = sum(h.weight for h in hits)
    return [math.log1p(total), max((h.weight for h in hits), default=0.0), math.log1p(total / math.sqrt(max(n_words, 1)) * 10)]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> list[float]:
    """Coefficients of a logistic model with an intercept, by Newton steps."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def _score(model: Model, n_words: int, hits: list[Hit]) -> float:
    z = model.coefficients[0] + sum(c * f for c, f in zip(model.coefficients[1:], features(n_words, hits), strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(column: Column) -> Column:
    """Whether a document is kept from training: the CRC-32 of its id as text modulo 4 is 2."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _texts(batches, column: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for part in batches:
        yield part, [decoded(t) for t in payloads(part.column(column))]


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Model:
    """Learn lexicon and coefficients from about ``rows`` labelled documents, none held out.

    The sample is drawn by a hash of the id. Without labelled toxic and other texts the lexicon is empty.
    """
    prepared(docs.sparkSession)
    known = labels.where(~held_out(labels["doc_id"])).where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, rows / max(known.count(), 1))
    sample = known.where(F.xxhash64("doc_id") <= F.lit(min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))))
    # the sample's ids are bounded by its size
    training = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))
    per_doc = training.select((F.col("toxic") > 0).cast("int").alias("toxic"), F.explode(words).alias("word"))
    total = training.agg(F.count("*"), F.sum((F.col("toxic") > 0).cast("int"))).first()
    if not total[0] or not total[1] or total[0] == total[1]:
        return Model()
    base = total[1] / total[0]
    stats = per_doc.where("length(word) BETWEEN 3 AND 24").groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("t"))
    rate = F.col("t") / F.col("n")
    smooth = lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(0.0)
    evidence = F.col("n") * (smooth(rate, F.lit(base)) + smooth(1 - rate, F.lit(1 - base)))
    odds = F.log((F.col("t") + 0.5) / (total[1] + 1)) - F.log((F.col("n") - F.col("t") + 0.5) / (total[0] - total[1] + 1))
    chosen = stats.where((rate > base) & (evidence >= EVIDENCE)).select("word", odds.alias("odds"), evidence.alias("e"))
    top = chosen.where("odds > 1.5").orderBy(F.desc("e"), "word").limit(TERMS).collect()
    model = Model([r.word for r in top], [float(r.odds) for r in top])

    def fuzzy(batches) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for part, some in _texts(batches, 0):
            near = [bool(h) and h[0].edits > 0 for _, h in reader.hits(some)]
            yield part.filter(pa.array(near, pa.bool_()))

    rare = stats.where((F.col("n") >= 3) & (rate < 0.3)).select("word", "n").mapInArrow(fuzzy, "word string, n bigint")
    model.harmless = frozenset(r.word for r in rare.orderBy(F.desc("n"), "word").limit(HARMLESS).collect())

    def measured(batches) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for part, some in _texts(batches, 1):
            x = [features(n, h) for n, h in reader.hits(some)]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[k] for r in x], pa.float64()) for k in range(3))], names=["toxic", "a", "b", "c"])

    used = training.select((F.col("toxic") > 0).cast("double").alias("toxic"), F.col("text").cast("binary"))
    data = np.array([tuple(r) for r in used.mapInArrow(measured, "toxic double, a double, b double, c double").collect()])
    model.coefficients = _logistic(data[:, 1:], data[:, 0])
    return model


_HIT = pa.struct([("term", pa.string()), ("found", pa.string()), ("start", pa.int32()), ("edits", pa.int32()), ("context", pa.string()), ("weight", pa.float64())])
_HIT_DDL = "array<struct<term:string,found:string,start:int,edits:int,context:string,weight:double>>"


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Score every whole text: the id, ``held_out``, ``score`` (0 to 1), ``predicted`` (1 from the
    threshold on) and ``hits`` (term, word found, start, edits, context, weight).

    Null and empty texts have no hits and the score of a text without any. Repeated rows and null
    ids are kept (null: not held out), an empty table gives no rows, other columns are ignored.
    Narrow: no shuffle.
    """
    prepared(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()
    own = docs.select(docs[id_column], held_out(docs[id_column]).alias("held_out"), docs[text_column].cast("binary"))

    def scored(batches) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for part in batches:
            scores, hits = [], []
            for _, group in chunks([t or b"" for t in payloads(part.column(2))]):
                for n, found in reader.hits([decoded(t) for t in group]):
                    scores.append(_score(model, n, found))
                    hits.append([vars(h) for h in found])
            out = pa.schema([part.schema.field(0), part.schema.field(1), ("score", pa.float64()), ("predicted", pa.int32()), ("hits", pa.list_(_HIT))])
            yield batch(out, [part.column(0), part.column(1), scores, [int(s >= threshold) for s in scores], hits])

    return own.mapInArrow(scored, f"`{id_column}` {kind}, held_out boolean, score double, predicted int, hits {_HIT_DDL}")


def accepted(docs: DataFrame, model: Model, text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, whose text scores below the threshold. Narrow: no shuffle."""
    prepared(docs.sparkSession)
    place = docs.columns.index(text_column)

    def keep(batches) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for part in batches:
            good = []
            for _, group in chunks([t or b"" for t in payloads(part.column(place))]):
                good += [_score(model, n, found) < threshold for n, found in reader.hits([decoded(t) for t in group])]
            yield part.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
