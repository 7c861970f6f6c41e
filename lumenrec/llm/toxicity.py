"""Toxicity by a weighted finite-state grammar over clauses.

A lexical transducer turns words into symbols (insult, ambiguous insult, threat,
target, speaker, negation, report, clause end, other). Five small transducers
rewrite them in turn: one marks what stands in the scope of a negation, one what a
clause reports of somebody else, one what is an insult and whether it meets a
target on either side, one what is a threat and whom it is for (the target after
it, or before it if the speaker is named), and one keeps of each clause what it
matched. Their composition is one table, run once over a text. An ambiguous
insult, such as trash, counts only where it meets a target, and a threatening word
without a target is no threat.

The score weighs matched clauses by kind: a logistic model over the clauses of each
kind and their share of all clauses.

Insults are stems. Besides the listed ones they are learned from labelled
documents: stems that are clearly commoner in toxic ones. Learning takes at most
SAMPLE labelled rows, chosen by a hash of their id; every stem of these that meets
the test is used. The weights are fitted on the same rows, each half of them
scanned with the stems of the other half. Without labels of both kinds the listed
stems and PRIOR weights are used.

Odd input: null and empty texts have no clause and get the score of that; labels
without id or value are not used; the larger label of a repeated id counts; rows
of equal id are scored each for itself; a null id is never held out; an empty
table gives an empty result; other columns are ignored or, where rows are
filtered, kept.
"""

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, small_batches, staged

SAMPLE = 20_000
THRESHOLD = 0.3
#: Lengths of the prefixes that are tried as stems, besides whole words.
PREFIXES = (4, 5, 6)

# Word lists of the grammar, four languages.
INSULTS = "idiot idiots moron morons imbecile stupid dumbass bastard bastards scumbag asshole bitch depp trottel arschloch hurensohn vollidiot dummkopf connard connasse salaud crétin abruti imbécile cabrón gilipollas idiota estúpido estúpida hijoputa"
AMBIGUOUS = "worthless pathetic scum loser trash garbage disgusting dumb ugly pig rat clown dirt dreck abschaum müll déchet ordure porc basura escoria cerdo"
THREATS = "kill hurt destroy beat murder strangle shoot stab töte töten umbringen zerstören schlagen tuer tue tuerai détruire frapper matar mataré destruir golpear"
TARGETS = "you your yours u ya yourself him her them his their dich dir du euch ihr ihn te toi tu vous ton votre ti tú usted ustedes vosotros lo los"
SPEAKERS = "i we ill ich wir je j nous yo nosotros voy vamos vais"
NEGATIONS = "not no never nobody without don doesn didn isn aren wasn won wouldn shouldn couldn ain nicht kein keine nie niemand pas jamais aucun sans nunca jamás nadie ningún"
REPORTS = "said says wrote claimed called reported quoted sagte schrieb behauptete nannte dit écrit prétend dijo escribió afirmó llamó"

OTHER, INSULT, WEAK, THREAT, TARGET, SPEAKER, NEGATION, REPORT, END = range(9)
#: What a clause may match. A transducer that has matched puts out the kind's bit above the symbols.
KINDS = "insult directed_insult threat directed_threat negated reported".split()
BARE_INSULT, DIRECTED_INSULT, BARE_THREAT, DIRECTED_THREAT, NEGATED, REPORTED = (16 << k for k in range(6))
SYMBOL = 15
#: Bias, then for each kind the weight of log(1 + clauses), then that of insulting and threatening clauses among all clauses.
PRIOR = np.array([-4.0, 3.0, 5.0, 0.0, 7.0, 0.3, 0.3, 3.0])

_TOKENS = re.compile(r"[^\W\d_]+|[.!?;\n]").findall


# --- transducers ------------------------------------------------------------
# A transducer is (start, step): step(state, x) gives the next state and what is put out for the symbol x.
# Bits above the symbol are matches of the transducers before it and go through.


def _negation(scope: int = 3):
    """Insults and threats up to some words after a negation are negated."""

    def step(left: int, x: int):
        if x == NEGATION:
            return scope, x
        if x == END:
            return 0, x
        return max(left - 1, 0), NEGATED if left and x in (INSULT, WEAK, THREAT) else x

    return 0, step


def _report():
    """Insults and threats after a verb of saying are somebody else's, to the end of the clause."""

    def step(inside: bool, x: int):
        symbol = x & SYMBOL
        if symbol in (REPORT, END):
            return symbol == REPORT, x
        return inside, REPORTED if inside and symbol in (INSULT, WEAK, THREAT) else x

    return False, step


def _insult(reach: int = 4, behind: int = 3):
    """Insults with a target up to `reach` words before or `behind` words after them are directed; others match if they are not ambiguous."""

    def step(state: tuple[int, int], x: int):
        left, wait = state
        symbol = x & SYMBOL
        if symbol == END:
            return (0, 0), x
        if symbol == TARGET:
            return (reach, 0), x | (DIRECTED_INSULT if wait else 0)
        if symbol in (INSULT, WEAK):
            if left:
                return (left - 1, 0), DIRECTED_INSULT
            return (0, behind), BARE_INSULT if symbol == INSULT else OTHER
        return (max(left - 1, 0), max(wait - 1, 0)), x

    return (0, 0), step


def _threat(reach: int = 3):
    """Threats with a target up to `reach` words after them, or before them if the speaker is named in the clause, are directed."""

    def step(state: tuple[bool, int, int], x: int):
        speaker, left, wait = state
        symbol, done = x & SYMBOL, x & ~SYMBOL
        if symbol == END:
            return (False, 0, 0), x
        if symbol == SPEAKER:
            return (True, max(left - 1, 0), max(wait - 1, 0)), done
        if symbol == TARGET:
            return (speaker, reach + 1, 0), done | (DIRECTED_THREAT if wait else 0)
        if symbol == THREAT:
            if speaker and left:
                return (speaker, 0, 0), done | DIRECTED_THREAT
            return (speaker, 0, reach), done | BARE_THREAT
        return (speaker, max(left - 1, 0), max(wait - 1, 0)), done

    return (False, 0, 0), step


def compose(*machines):
    """The transducer that runs the first and feeds what it puts out to the next one."""
    starts, steps = zip(*machines)

    def step(states, x):
        after = []
        for state, one in zip(states, steps):
            state, x = one(state, x)
            after.append(state)
        return tuple(after), x

    return starts, step


def table(machine) -> list[list[tuple[int, int]]]:
    """All reachable states of a transducer, numbered: table[state][symbol] = (state, put out)."""
    start, step = machine
    number, rows, todo = {start: 0}, [], [start]
    for state in todo:
        row = []
        for x in range(END + 1):
            after, y = step(state, x)
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            row.append((number[after], y))
        rows.append(row)
    return rows


GRAMMAR = table(compose(_negation(), _report(), _insult(), _threat()))
MARKED = (INSULT, WEAK, THREAT)


def clauses(symbols: bytes) -> tuple[list[int], int]:
    """How many clauses match each of KINDS, and the number of clauses: the last transducer, which puts out a clause's matches at its end."""
    state, matched, counts, n, filled = 0, 0, Counter(), 0, False
    for x in (*symbols, END):
        state, y = GRAMMAR[state][x]
        if x == END:
            if matched:
                counts[matched] += 1
                matched = 0
            n += filled
            filled = False
        else:
            filled = True
            matched |= y & ~SYMBOL
    # the stronger match of a clause counts
    stronger = {BARE_INSULT: DIRECTED_INSULT, BARE_THREAT: DIRECTED_THREAT}
    kinds = [BARE_INSULT, DIRECTED_INSULT, BARE_THREAT, DIRECTED_THREAT, NEGATED, REPORTED]
    return [sum(c for m, c in counts.items() if m & k and not m & stronger.get(k, 0)) for k in kinds], n


class Scanner:
    """A text's features: the logarithm of 1 + its clauses of each kind, and the share of insulting and threatening ones."""

    def __init__(self, stems: set[str]) -> None:
        self.stems = stems
        self.symbols: dict[str, int] = {"\n": END, ".": END, "!": END, "?": END, ";": END}
        for words, symbol in ((TARGETS, TARGET), (SPEAKERS, SPEAKER), (NEGATIONS, NEGATION), (REPORTS, REPORT), (THREATS, THREAT), (AMBIGUOUS, WEAK), (INSULTS, INSULT)):
            self.symbols |= dict.fromkeys(words.split(), symbol)
        self.symbols |= {w: INSULT for w, x in self.symbols.items() if x == WEAK and f"{w}$" in stems}
        self.fixed = dict(self.symbols)

    def symbol(self, word: str) -> int:
        return INSULT if f"{word}$" in self.stems or any(word[:n] in self.stems for n in PREFIXES if len(word) > n) else OTHER

    def __call__(self, text: str | None) -> np.ndarray:
        words = _TOKENS((text or "").lower())
        symbols, out = self.symbols, np.zeros(len(KINDS) + 1)
        if len(symbols) > 300_000:
            symbols = self.symbols = dict(self.fixed)
        new = set(words).difference(symbols)
        symbols.update((w, self.symbol(w)) for w in new)
        seen = bytes(map(symbols.__getitem__, words))
        if any(x in seen for x in MARKED):
            counts, n = clauses(seen)
            out[:-1] = np.log1p(counts)
            out[-1] = (counts[0] + counts[1] + counts[3]) / max(n, 1)
        return out


def stems_in(text: str) -> set[str]:
    words = {w for w in _TOKENS(text.lower()) if w[0].isalpha()}
    return {f"{w}$" for w in words} | {w[:n] for w in words for n in PREFIXES if len(w) > n}


# --- learning ---------------------------------------------------------------


def clearly_toxic(t: Column, c: Column, toxic: int, clean: int) -> Column:
    """Stems whose share of toxic texts is, error bounds included, several times that of clean ones, and which clean ones hardly have."""
    low = (t - 1.65 * F.sqrt(t)) / max(toxic, 1)
    high = (c + 1.65 * F.sqrt(c) + 1) / max(clean, 1)
    return (low >= 6 * high) & (c <= 0.02 * t)


def fit(x: np.ndarray, y: np.ndarray, steps: int = 40, ridge: float = 0.5) -> np.ndarray:
    """Logistic weights by Newton's method, drawn to PRIOR."""
    x = np.column_stack([np.ones(len(x)), x])
    w = PRIOR.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * (w - PRIOR)
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w = w - np.clip(move, -2, 2)
    return w


def _count_stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = [Counter() for _ in range(4)]
    for batch in batches:
        for text, toxic, half in zip(*(c.to_pylist() for c in batch.columns)):
            counts[2 * half + toxic].update(stems_in(text or ""))
    every = sorted(set().union(*counts))
    for i in range(0, len(every), 10_000):
        some = every[i : i + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), *(pa.array([c[s] for s in some], pa.int64()) for c in counts)], names=["stem", "c0", "t0", "c1", "t1"])


def _scan_halves(stems):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanners = [Scanner(s) for s in stems.value]
        for batch in batches:
            out = [scanners[1 - half](text).tolist() for text, half in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    return run


def train(docs: DataFrame, labels: DataFrame, usable: Column) -> tuple[set[str], np.ndarray]:
    """Stems and weights from labels(doc_id, toxic) whose doc_id meets `usable`."""
    spark = docs.sparkSession
    chosen = labels.filter(usable).filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).withColumn("half", F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(2)).cast("int"))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "toxic", "half")
    rows = staged(rows.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))), "labelled")  # a bounded sample, read three times
    size = {(r.half, r.toxic): r.n for r in rows.groupBy("half", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = [[size.get((half, toxic), 0) for toxic in (0, 1)] for half in (0, 1)]
    every = [n[0][0] + n[1][0], n[0][1] + n[1][1]]
    if not all(every):
        return set(), PRIOR
    stems = rows.mapInArrow(_count_stems, "stem string, c0 long, t0 long, c1 long, t1 long").filter("t0 + t1 > 0 or c0 + c1 > 0").groupBy("stem").agg(*(F.sum(c).alias(c) for c in ("c0", "t0", "c1", "t1")))
    tests = [clearly_toxic(F.col(f"t{h}"), F.col(f"c{h}"), n[h][1], n[h][0]) for h in (0, 1)] + [clearly_toxic(F.col("t0") + F.col("t1"), F.col("c0") + F.col("c1"), every[1], every[0])]
    found = stems.select("stem", *(t.alias(f"s{i}") for i, t in enumerate(tests))).filter("s0 or s1 or s2").collect()
    picked = [{r.stem for r in found if r[f"s{i}"]} for i in range(3)]
    scanned = rows.mapInArrow(_scan_halves(spark.sparkContext.broadcast(picked[:2])), "x array<double>, toxic int").toPandas()
    discard(rows)
    return picked[2], fit(np.array(scanned.x.tolist()), scanned.toxic.to_numpy(float))


def scorer(stems: set[str], weights: np.ndarray, docs: DataFrame) -> Column:
    """A column expression that scores the text column of docs."""
    model = docs.sparkSession.sparkContext.broadcast((stems, weights))
    state: dict[str, Scanner] = {}

    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scan, w = state.setdefault("scan", Scanner(model.value[0])), model.value[1]
        for texts in batches:
            x = np.array([scan(t) for t in texts.to_pylist()]).reshape(-1, len(w) - 1)
            yield pa.array(1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30))), pa.float64())

    return scores(F.col("text").cast("string"))


def held_out(modulus: int, remainder: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus)) == remainder, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs(doc_id, text); labels of held-out ids are not looked at."""
    small_batches(docs.sparkSession)
    model = train(docs, labels, ~held_out(4, 2))
    scored = docs.select("doc_id", held_out(4, 2).alias("held_out"), scorer(*model, docs).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score below the threshold, all columns kept; learns from the same labels."""
    small_batches(docs.sparkSession)
    model = train(docs, labels, ~held_out(4, 2))
    return docs.filter(scorer(*model, docs) < THRESHOLD)
