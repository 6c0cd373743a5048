"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols (insult, threat, modal, target, negation, report, clause end,
other). Small weighted transducers rewrite the symbol stream: the matcher finds
insults and joins a modal to a threat word, the aim transducer marks what has a
target before or after it in its clause, the negation transducer what is denied, the
reported-speech transducer what is only quoted. An arc may carry a weight; weights
add up along a clause, so a clause is worth what its whole path says: an insult
without a target little, one aimed at someone much, a denied or quoted one less. The
composition is compiled into one table, so a text is read once.

A text is judged by its worst passage, that of PASSAGE tokens whose matched clauses
weigh most: its score is the logistic of that weight and an intercept, less the
logarithm of how many passages long the text is, since the worst of many is bad by
chance. So a word here and there in a long text doesn't decide, and a passage of
abuse does.

The weights of the arcs are learned from labelled documents, and so are further
insults and what each is worth: a word that stands in many toxic documents and in
hardly any other. What the grammar knows bounds what may be learned (see limits): a
denied or quoted hit is worth next to nothing, and one word of the fixed list without
a target stays under the cut, unless labels of texts with nothing else in them say
otherwise; one aimed at someone is over it in a short text, and so is an aimed threat.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, ready, text_of, whole_row, with_columns
from .words import WordMemory

#: Fixed word lists: what the grammar knows before it has seen a label.
INSULTS = "idiot moron stupid scum trash loser clown worthless pathetic disgusting imbecile bastard idiota imbécil estúpido basura idiote imbécile ordure connard dummkopf abschaum arschloch trottel".split()
THREATS = "kill hurt destroy beat stab shoot murder tuer frapper détruire töten schlagen vernichten matar golpear destruir".split()
MODALS = "will shall gonna going must should vais va vas werde wird werden voy va vamos".split()
TARGETS = "you your you're he she him her they them people all everyone tu te toi vous ton du dich dir ihr euch sie usted ustedes ti vosotros ellos".split()
NEGATIONS = "not no never don't isn't aren't cannot without ne pas jamais non nicht kein keine nie ni nunca jamás sin".split()
REPORTS = "said says called calls wrote claimed quoted dit appelle écrit sagte nannte schrieb dijo llamó escribió".split()

OTHER, INSULT, THREAT, MODAL, TARGET, NEGATION, REPORT, STOP, QUOTE, HIT = range(10)
#: Tokens that a negation reaches.
REACH = 3
#: Labelled documents of each class that the lexicon and the model are fitted on, at most.
MAX_LABELLED = 10_000
#: A learned word stands in this share of the toxic documents (and in four)...
COVER = 0.015
#: ...and is so much more likely there than elsewhere.
LIFT = 100.0
#: What a learned word is worth in fixed insults, from this on, as labels vouch for it...
VOUCHED = 1.25
#: ...and at most.
MOST_WORTH = 2.0
#: Documents get label 1 from this score on.
CUT = 0.3
#: Tokens of a passage; a clause that goes on for longer is cut there.
PASSAGE = 200
#: What a denied or quoted hit is worth at most, whatever else is on its path.
TAKEN_BACK = 0.25
#: One fixed insult without a target stays so far under the cut, on the logistic scale...
MARGIN = 0.2
#: ...unless so many labelled texts hold nothing else, and most of them are toxic.
LONE_TEXTS = 30

_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;\n]|[\"“”«»]")
#: The weighted arcs: a first insult of a clause, a further one, a threat, and what hits are aimed, denied, told.
ARCS = ("insult", "again", "threat", "aimed", "denied", "reported")
#: The model before any label: the intercept, then each arc's weight.
PRIOR = np.array([-3.0, 1.5, 0.5, 2.0, 2.5, -3.9, -3.9])
#: Arcs whose weight is multiplied by what the word is worth.
_LEXICAL = ("insult", "again")


@dataclass
class Transducer:
    """Arcs (state, symbol) -> (next state, symbol out, name of the weight or None).

    A symbol without an arc passes in place and weighs nothing; a clause end leads to the start.
    """

    arcs: dict

    def step(self, state, symbol):
        if (state, symbol) in self.arcs:
            return self.arcs[state, symbol]
        return (0 if symbol == STOP else state), symbol, None


def grammar() -> list[Transducer]:
    """The chain of transducers: what one puts out, the next one reads."""
    # states: 1 after a modal, 2 after an insult, 3 after both
    match = {(k, INSULT): (k | 2, HIT, "again" if k & 2 else "insult") for k in range(4)} | {(k, MODAL): (k | 1, MODAL, None) for k in range(4)}
    match |= {(k, THREAT): (k & 2, HIT, "threat") for k in (1, 3)}
    # states: 1 after a target, 2 after a hit without one
    aim = {(k, TARGET): (1, TARGET, None) for k in (0, 1)} | {(0, HIT): (2, HIT, None), (1, HIT): (1, HIT, "aimed"), (2, TARGET): (1, TARGET, "aimed")}
    # states: tokens that the negation still reaches
    deny = {(k, NEGATION): (REACH, NEGATION, None) for k in range(REACH + 1)}
    for k in range(1, REACH + 1):
        deny |= {(k, s): (k - 1, s, "denied" if s == HIT else None) for s in (OTHER, THREAT, MODAL, TARGET, REPORT, QUOTE, HIT)}
    # states: 1 after a reporting word, to the end of the clause; 2 in a quotation after one, to its end
    told = {(0, REPORT): (1, REPORT, None), (1, QUOTE): (2, QUOTE, None), (2, QUOTE): (0, QUOTE, None), (2, STOP): (2, STOP, None)}
    told |= {(k, HIT): (k, HIT, "reported") for k in (1, 2)}
    return [Transducer(match), Transducer(aim), Transducer(deny), Transducer(told)]


def composed(chain: list[Transducer], states: tuple, symbol: int) -> tuple[tuple, int]:
    """One step through all of ``chain``: the states after it, and the weighted arcs on its way as bits."""
    after, taken = [], 0
    for machine, state in zip(chain, states, strict=True):
        state, symbol, name = machine.step(state, symbol)
        after.append(state)
        taken |= 1 << ARCS.index(name) if name else 0
    return tuple(after), taken


class Reader:
    """Reads texts with the compiled grammar under a lexicon of insults and what each is worth."""

    def __init__(self, lexicon: dict[str, float], weights: np.ndarray = PRIOR):
        self.lexicon = lexicon | dict.fromkeys(INSULTS, 1.0)  # everyday words too: worth one whatever is learned
        self.fixed = {w: s for s, ws in ((THREAT, THREATS), (MODAL, MODALS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in ws}
        self.fixed |= dict.fromkeys(".!?;\n", STOP) | dict.fromkeys("\"“”«»", QUOTE)
        self.memory = WordMemory(self._symbols, limit=500_000)
        self.weights = dict(zip(ARCS, weights[1:].tolist(), strict=True))
        # compile: numbers for the states that can be reached, and a table over them
        chain = grammar()
        number, todo, self.table = {(0,) * len(chain): 0}, [(0,) * len(chain)], []
        while todo:
            state, row = todo.pop(0), []
            for symbol in range(HIT):
                after, taken = composed(chain, state, symbol)
                if after not in number:
                    number[after] = len(number)
                    todo.append(after)
                row.append((number[after], taken, symbol == STOP))
            self.table.append(row)

    def _symbols(self, words: list[str]) -> Iterator[tuple[int, float]]:
        for word in words:
            low = word.lower()
            yield (INSULT, self.lexicon[low]) if low in self.lexicon else (self.fixed.get(low, OTHER), 1.0)

    def placed(self, values: list[tuple[int, float]]) -> Iterator[tuple[int, dict[str, float]]]:
        """Per matched clause: the token that it ends before, and what was met on each weighted arc of its path."""
        state, clause, since = 0, {}, 0
        for at, (symbol, worth) in enumerate(values):
            if at - since == PASSAGE:
                if clause:
                    yield at, clause
                state, clause, since = 0, {}, at
            state, taken, ends = self.table[state][symbol]
            if taken:
                for k, name in enumerate(ARCS):
                    if taken >> k & 1:
                        clause[name] = clause.get(name, 0.0) + (worth if name in _LEXICAL else 1.0)
            if ends:
                if clause:
                    yield at, clause
                clause, since = {}, at + 1
        if clause:
            yield len(values), clause

    def clauses(self, values: list[tuple[int, float]]) -> Iterator[dict[str, float]]:
        """Per matched clause: what was met on each weighted arc of its path."""
        return (clause for _, clause in self.placed(values))

    def worst(self, placed: list[tuple[int, dict[str, float]]]) -> list[dict[str, float]]:
        """The clauses that end in the passage that weighs most, the first of such."""
        weights = [self.weight(clause) for _, clause in placed]
        total, most, first, span = 0.0, 0.0, 0, (0, 0)
        for k, (at, _) in enumerate(placed):
            total += weights[k]
            while placed[first][0] <= at - PASSAGE:
                total -= weights[first]
                first += 1
            if total > most + 1e-9:
                most, span = total, (first, k + 1)
        return [clause for _, clause in placed[span[0] : span[1]]]

    def judged(self, texts: list[str]) -> Iterator[tuple[list[dict[str, float]], list[dict[str, float]], int]]:
        """Per text its matched clauses, those of its worst passage, and how many passages long it is."""
        for values in self.memory.texts(texts, _TOKEN.findall):
            placed = list(self.placed(values)) if any(v[0] == INSULT or v[0] == THREAT for v in values) else []
            yield [clause for _, clause in placed], self.worst(placed), max(1, -(-len(values) // PASSAGE))

    def read(self, texts: list[str]) -> Iterator[list[dict[str, float]]]:
        """Per text its matched clauses."""
        return (found for found, _, _ in self.judged(texts))

    def scores(self, texts: list[str], intercept: float) -> Iterator[tuple[float, list[dict[str, float]]]]:
        """Per text its score and its matched clauses."""
        for found, worst, passages in self.judged(texts):
            total = intercept + sum(map(self.weight, worst)) - math.log(passages)
            yield 1 / (1 + math.exp(-max(-30.0, min(30.0, total)))), found

    def weight(self, clause: dict[str, float]) -> float:
        """What a clause is worth: the weights along its path, at least nothing."""
        return max(0.0, sum(self.weights[name] * n for name, n in clause.items()))


_READERS: dict[tuple, Reader] = {}


def _reader(lexicon: tuple, weights: tuple) -> Reader:
    """One reader a worker keeps between its tasks."""
    if (lexicon, weights) not in _READERS:
        _READERS.clear()
        _READERS[lexicon, weights] = Reader(dict(lexicon), np.array(weights))
    return _READERS[lexicon, weights]


def _feature_batches(batches: Iterator[pa.RecordBatch], lexicon: tuple) -> Iterator[pa.RecordBatch]:
    reader = _reader(lexicon, tuple(PRIOR.tolist()))
    for batch in batches:
        x, passages, lone = [], [], []
        for found, worst, n in reader.judged(batch.column(1).to_pylist()):
            x.append([1.0, *(sum(c.get(name, 0.0) for c in worst) for name in ARCS)])
            passages.append(n)
            lone.append(found == [{"insult": 1.0}])
        columns = [batch.column(0), pa.array(x, pa.list_(pa.float64())), pa.array(passages, pa.int32()), pa.array(lone, pa.bool_())]
        yield pa.RecordBatch.from_arrays(columns, names=["label", "x", "passages", "lone"])


def _score_batches(batches: Iterator[pa.RecordBatch], lexicon: tuple, weights: tuple) -> Iterator[pa.RecordBatch]:
    reader = _reader(lexicon, weights)
    for batch in batches:
        score, kinds = [], []
        for value, found in reader.scores(batch.column(1).to_pylist(), weights[0]):
            score.append(value)
            kinds.append([" ".join(name for name in ARCS if name in c) for c in found])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array(kinds, pa.list_(pa.string()))], names=[batch.schema.names[0], "score", "clauses"])


def learn_lexicon(labelled: DataFrame) -> dict[str, float]:
    """Words that tell toxic (label 1) from other texts, and what each is worth: (text, label) rows, no null.

    A word that is as much likelier in toxic texts as LIFT says is worth VOUCHED fixed
    insults, likelier ones up to MOST_WORTH. Each word stands in a share of COVER of the toxic texts, so
    there are at most as many as one toxic text has words, over COVER.
    """
    n = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}  # two rows
    bad, good = n.get(1, 0), n.get(0, 0)
    if not bad or not good:
        return {}
    words = labelled.select("label", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}']+", -1))).alias("word")).where("word <> ''")
    counted = words.groupBy("word").agg(F.sum("label").alias("bad"), F.count(F.lit(1)).alias("all"))
    lift = ((F.col("bad") + 0.5) / (bad + 1)) / ((F.col("all") - F.col("bad") + 0.25) / (good + 1))
    told = counted.where((F.col("bad") >= max(4, COVER * bad)) & (lift >= LIFT)).select("word", F.least(F.lit(MOST_WORTH), VOUCHED * F.log(lift) / math.log(LIFT)).alias("worth"))
    return {r["word"]: r["worth"] for r in told.collect()}


def limits(lone_decides: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """What weights have to keep to: rows c and bounds b, with c @ weights <= b."""
    at = {name: k for k, name in enumerate(ARCS, 1)}
    rows = [({at[a]: -1}, 0.0) for a in ("insult", "again", "threat", "aimed")]
    worth = {name: MOST_WORTH if name in _LEXICAL else 1.0 for name in ("insult", "again", "threat")}
    rows += [({at[hit]: n, at["aimed"]: 1, at[back]: 1}, TAKEN_BACK) for hit, n in worth.items() for back in ("denied", "reported")]
    cut = math.log(CUT / (1 - CUT))
    rows += [({0: -1, at[hit]: -1, at["aimed"]: -1}, -cut - MARGIN) for hit in ("insult", "threat")]
    if not lone_decides:
        rows.append(({0: 1, at["insult"]: 1}, cut - MARGIN))
    c = np.zeros((len(rows), len(PRIOR)))
    for k, (row, _) in enumerate(rows):
        c[k, list(row)] = list(row.values())
    return c, np.array([b for _, b in rows])


def fit(x: np.ndarray, bad: np.ndarray, n: np.ndarray, offset: np.ndarray, lone_decides: bool = False, strength: float = 1.0) -> np.ndarray:
    """Logistic weights by Newton steps, drawn to PRIOR and held within limits; a step that does harm is halved.

    Row k of ``x`` stands for n[k] texts, bad[k] of them toxic. What is beyond a limit
    costs its square so many times that all texts together move it by a few
    thousandths, less than MARGIN.
    """
    c, b = limits(lone_decides)
    bound = 1e3 * max(10.0, float(n.sum()))

    def loss(w: np.ndarray) -> float:
        z, over = x @ w + offset, np.maximum(c @ w - b, 0)
        return float((n * np.logaddexp(0, z)).sum() - bad @ z + strength / 2 * ((w - PRIOR) ** 2).sum() + bound / 2 * (over**2).sum())

    w = PRIOR.copy()
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w + offset, -30, 30)))
        over = np.maximum(c @ w - b, 0)
        slope = x.T @ (bad - n * p) - strength * (w - PRIOR) - bound * (c.T @ over)
        bend = (x * (n * p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w)) + bound * (c[over > 0].T @ c[over > 0])
        step, now = np.linalg.solve(bend, slope), loss(w)
        while loss(w + step) > now and np.abs(step).max() > 1e-8:
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[dict[str, float], np.ndarray]:
    """Lexicon and weights from labelled documents, at most ``max_labelled`` of each class.

    The sample holds the ids of the least hashes, so it's the same each time. Rows
    whose label isn't 0 or 1 or whose id is null take no part; without labels the
    fixed lists and the prior weights hold.
    """
    ready(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label")).where("_id IS NOT NULL AND label IN (0, 1)").groupBy("_id").agg(F.max("label").alias("label"))
    drawn = [known.where(F.col("label") == k).orderBy(F.xxhash64("_id"), "_id").limit(max_labelled) for k in (0, 1)]
    sample = F.broadcast(drawn[0].unionByName(drawn[1]))  # 2 * max_labelled rows at most
    held = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("text")).join(sample, "_id")
    held = materialize(held.select("text", "label"), "labelled")
    lexicon = learn_lexicon(held)
    seen = held.select("label", "text").mapInArrow(lambda it, lex=tuple(sorted(lexicon.items())): _feature_batches(it, lex), "label int, x array<double>, passages int, lone boolean")
    # the sample's distinct feature vectors: no more than it has ids, but for ids of several texts
    rows = seen.groupBy("x", "passages", "lone").agg(F.sum("label").alias("bad"), F.count(F.lit(1)).alias("n")).collect()
    if not rows:
        return lexicon, PRIOR.copy()
    bad, n = (np.array([r[k] for r in rows], float) for k in ("bad", "n"))
    lone = np.array([r["lone"] for r in rows])
    decides = n[lone].sum() >= LONE_TEXTS and bad[lone].sum() > n[lone].sum() / 2
    return lexicon, fit(np.array([r["x"] for r in rows]), bad, n, -np.log([r["passages"] for r in rows]), bool(decides))


def _scored(docs: DataFrame, first: Column, lexicon: dict[str, float], weights: np.ndarray, text_col: str) -> DataFrame:
    """(first, score, clauses, predicted) of every row."""
    ready(docs.sparkSession)
    lex, own = tuple(sorted(lexicon.items())), tuple(float(w) for w in weights)
    rows = docs.select(first.alias("row"), text_of(text_col).alias("text"))
    scored = rows.mapInArrow(lambda it: _score_batches(it, lex, own), f"row {rows.schema['row'].dataType.simpleString()}, score double, clauses array<string>")
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def score(docs: DataFrame, lexicon: dict[str, float], weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, score (0 to 1), predicted (1 from CUT on) and clauses (arcs of the matched ones) of every whole text.

    A null or empty text has the score of a short text without matches. One row per
    input row; only the text is looked at. Map-only. An empty table gives no rows.
    """
    return _scored(docs, F.col(id_col), lexicon, weights, text_col).withColumnRenamed("row", id_col)


def score_rows(docs: DataFrame, lexicon: dict[str, float], weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, and score, clauses and predicted (see score), which take the place of those of their names."""
    scored = _scored(docs, whole_row(docs), lexicon, weights, text_col)
    return with_columns(scored, docs, {c: F.col(c) for c in ("score", "clauses", "predicted")})


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2
