"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult or threat (a lexicon learned from labels, and a list of
threats), target, negation, reporting word, quote mark, or plain word; marks end
clauses. Three transducers read a clause's symbols and are composed into one:

  negation  rewrites an insult or threat within a few words of a negation as a negated one,
  report    rewrites one after a reporting word or within quotes as a reported one,
  target    remembers the strongest of them, and whether someone is addressed or pointed
            at anywhere in the clause.

The state in which the composed machine ends names the clause's pattern (targeted insult,
negated insult, reported threat, ...); the lexicon weight of the hit that decided on it is
the match's weight. A document is scored on the weights of its matched clauses by
pattern. A pattern counts by a fixed prior (`PRIOR`: plain above reported above
negated, targeted above untargeted) times one learned slope, and by a learned
departure from it, held small unless labels show it.

The lexicon: words are counted by labelled documents, toxic and other, on at most
`Settings.labelled_rows` rows; only uses outside negation and report count, so a clean
document that quotes or denies an insult doesn't speak against the word. Words and word
beginnings that toxic texts alone have, beyond chance, are its entries, so unseen forms
of a stem match too. No entry that passes is left out; each needs several toxic labelled
rows, so the rows' bound holds for the entries too.

Cases: null and empty texts match nothing and get the score of no match. Labels that are
null don't count; of repeated labels of one id the largest counts. Without labels of
both kinds all scores are the rate of toxic labels (0 without any). Repeated rows are
scored each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import text_of, written
from ledgerloom.llm.tokens import slices

#: Fixed word lists in the corpus's languages.
TARGETS = "you your yours he she him her they them these those du dich dir euch ihr sie tu toi vous vos ils elles tú usted ustedes vosotros ellos ellas".split()
NEGATIONS = "not never no none neither nor nicht nie kein keine keinen niemals pas jamais aucun aucune nunca jamás tampoco".split()
REPORTS = "said says say called calls quoted quotes wrote reported claims sagte sagt schrieb nannte dit disait écrit appelle dijo dice escribió llamó".split()
THREATS = "kill killing destroy hurt burn shoot stab beat töten umbringen schlagen tuer frapper matar golpear quemar".split()
QUOTES = "\"“”„«»"
#: What a listed threat weighs that labels don't show: such words have harmless senses, so one alone isn't enough.
THREAT = 1.0
_END = r"[.,;:!?…]+[\"'”»)\]]*$"
_REPORTING = rf"(?i)^(?:{'|'.join(REPORTS)})[,:]$"
_CORE = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_BETWEEN = r"[^\p{L}\p{Nl}\p{No}]+"


def folded(words: pa.Array) -> pa.Array:
    """Tokens in lower case, letter by letter, a final sigma as any other: the one way that entries and texts are compared in."""
    return pc.replace_substring(pc.utf8_lower(words), "ς", "σ")


@dataclass(frozen=True)
class Settings:
    """labelled_rows: at most so many labelled rows are learned from, the first by a hash of their id."""

    labelled_rows: int = 40_000
    threshold: float = 0.7
    shortest: int = 3
    longest: int = 8
    purity: float = 0.97
    surprise: float = 28.0
    stem_share: float = 0.98
    ridge: float = 1e-4


# ---- transducers


@dataclass(frozen=True)
class Transducer:
    """States from 0, and (state, symbol) -> (state, output); without an entry a symbol passes unchanged.

    finals: what a text that ends in a state is accepted as.
    """

    states: int
    moves: dict[tuple[int, str], tuple[int, str]] = field(default_factory=dict)
    finals: dict[int, str] = field(default_factory=dict)

    def step(self, state: int, symbol: str) -> tuple[int, str]:
        return self.moves.get((state, symbol), (state, symbol))

    def __matmul__(self, other: Transducer) -> Transducer:
        """Composition: this one's output is read by the other, which accepts."""
        symbols = {s for _, s in self.moves} | {o for _, o in self.moves.values()} | {s for _, s in other.moves}
        moves = {}
        for a, b, s in product(range(self.states), range(other.states), symbols):
            p, middle = self.step(a, s)
            q, out = other.step(b, middle)
            if (p, q, out) != (a, b, s):
                moves[a * other.states + b, s] = (p * other.states + q, out)
        finals = {a * other.states + b: x for a in range(self.states) for b, x in other.finals.items()}
        return Transducer(self.states * other.states, moves, finals)


#: I insult, H threat, T target, N negation, R reporting word, Q quote mark, W any other word.
#: A negation reaches so many words.
REACH = 4
_HITS = [x + n + r for x in "IH" for n in ("", "-") for r in ("", "r")]
PATTERNS = [h + t for h in _HITS for t in ("", "t")]


def _prior(pattern: str) -> float:
    """What a match of the pattern counts for, against a plain insult, before labels are seen."""
    base = {"I": 1.0, "It": 1.25, "H": 0.25, "Ht": 1.0}[pattern[0] + ("t" if pattern[-1] == "t" else "")]
    return base * (0.1 if "-" in pattern else 1.0) * (0.15 if "r" in pattern else 1.0)


PRIOR = np.array([_prior(p) for p in PATTERNS])
_STRENGTH = {h: _prior(h + "t") for h in _HITS}


def _negation() -> Transducer:
    moves = {(k, "N"): (REACH, "N") for k in range(REACH + 1)}
    for k in range(1, REACH + 1):
        moves |= {(k, x): (k - 1, x) for x in "TRW"} | {(k, x): (k - 1, x + "-") for x in "IH"}
    return Transducer(REACH + 1, moves)


def _report() -> Transducer:
    """0 plain, 1 after a reporting word, 2 within quotes."""
    moves = {(0, "R"): (1, "R"), (0, "Q"): (2, "Q"), (1, "Q"): (2, "Q"), (2, "Q"): (0, "Q")}
    return Transducer(3, moves | {(s, x + n): (s, x + n + "r") for s in (1, 2) for x in "IH" for n in ("", "-")})


def _target() -> Transducer:
    """States (target seen, strongest hit so far)."""
    held = [None, *_HITS]
    at = {(t, h): t * len(held) + k for t in (0, 1) for k, h in enumerate(held)}
    moves, finals = {}, {}
    for (t, h), state in at.items():
        moves[state, "T"] = (at[1, h], "T")
        for x in _HITS:
            if h is None or _STRENGTH[x] > _STRENGTH[h]:
                moves[state, x] = (at[t, x], x)
        if h is not None:
            finals[state] = h + ("t" if t else "")
    return Transducer(len(at), moves, finals)


GRAMMAR = _negation() @ _report() @ _target()
_PATTERN = {p: i for i, p in enumerate(PATTERNS)}
#: A feature for each pattern, and one of all by their priors.
WIDTH = len(PATTERNS) + 1


def clause_match(symbols: list[tuple[str, float]]) -> tuple[int, float] | None:
    """The pattern and weight of a clause."""
    state, best = 0, 0.0
    held = None
    for symbol, weight in symbols:
        state, out = GRAMMAR.step(state, symbol)
        if weight > 0:
            now = GRAMMAR.finals[state].rstrip("t")
            if now != held:
                held, best = now, weight
            elif out == now:
                best = max(best, weight)
    return (_PATTERN[GRAMMAR.finals[state]], best) if held else None


# ---- lexicon and scoring


@dataclass
class Model:
    words: dict[str, float]
    stems: dict[str, float]
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        fold = lambda entries: dict(zip(folded(pa.array(list(entries), pa.string())).to_pylist(), entries.values(), strict=True))
        self.words, self.stems = fold(self.words), fold(self.stems)
        self._sizes = sorted({len(s) for s in self.stems})
        # what a token's run of letters must be or begin with, for the token to hold an entry
        run = lambda entry: re.split("['’]", entry)[0]
        whole = {run(e) for e in (*self.words, *THREATS, *(s for s in self.stems if run(s) != s))}
        self._whole = pa.array(sorted(whole), pa.string())
        self._starts = {k: pa.array(sorted(s for s in self.stems if len(s) == k and run(s) == s), pa.string()) for k in self._sizes}

    def symbol(self, token: str, low: str) -> list[tuple[str, float]]:
        """A token's symbols, in order. low: the token, folded."""
        out = [("Q", 0.0)] if token[:1] in QUOTES and len(token) > 1 else []
        for core in _CORE.findall(low):
            weight = self.words.get(core, 0.0)
            if self.stems:
                weight = max([weight, *(self.stems[core[:k]] for k in self._sizes if k <= len(core) and core[:k] in self.stems)])
            if core in _THREATS:
                out.append(("H", max(weight, THREAT)))
            elif weight > 0:
                out.append(("I", weight))
            else:
                out.append((_MARKS.get(core, "W"), 0.0))
        if any(q in token[-3:] for q in QUOTES):
            out.append(("Q", 0.0))
        return out

    def hits(self, words: pa.Array) -> np.ndarray:
        """Which of the different tokens hold an insult or threat.

        Their runs of letters are looked up in Arrow, in the same way for a lexicon of any size;
        the tokens that are left are read whole.
        """
        out = np.zeros(len(words), bool)
        low = folded(words)
        runs = pc.split_pattern_regex(low, _BETWEEN)
        each, of = runs.flatten(), np.asarray(pc.list_parent_indices(runs))
        found = pc.is_in(each, self._whole).to_numpy(zero_copy_only=False)
        for k, starts in self._starts.items():
            found |= pc.is_in(pc.utf8_slice_codeunits(each, 0, k), starts).to_numpy(zero_copy_only=False)
        maybe = np.unique(of[found])
        at = pa.array(maybe, pa.int64())
        out[maybe] = [any(s in "IH" for s, _ in self.symbol(w, x)) for w, x in zip(words.take(at).to_pylist(), low.take(at).to_pylist(), strict=True)]
        return out


_MARKS = {w: s for s, words in (("T", TARGETS), ("N", NEGATIONS), ("R", REPORTS)) for w in words}
_THREATS = frozenset(THREATS)


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Each text's tokens as codes, the texts' starts (with the end), and the tokens; a line end is a token."""
    spread = pc.replace_substring(texts.cast(pa.large_string()), "\n", " \n ")
    lists = pc.split_pattern(spread, " ")
    coded = lists.flatten().dictionary_encode()
    return np.asarray(coded.indices, np.int64), np.asarray(lists.offsets, np.int64), coded.dictionary


def clause_ends(words: pa.Array) -> np.ndarray:
    """Which of the different tokens end a clause; what a comma or colon sets off from its reporting word is one with it."""
    marked = pc.and_not(pc.match_substring_regex(words, _END), pc.match_substring_regex(words, _REPORTING))
    return pc.or_(marked, pc.equal(words, "\n")).to_numpy(zero_copy_only=False)


def features(model: Model, texts: pa.Array) -> np.ndarray:
    """For each text, the summed weights of its matched clauses by pattern, and their sum by the priors."""
    out = np.zeros((len(texts), WIDTH))
    if not len(texts):
        return out
    codes, at, words = tokens_of(texts)
    spots = np.flatnonzero(model.hits(words)[codes])
    if not len(spots):
        return out
    # a clause ends at its mark or with its text
    stops = np.union1d(np.flatnonzero(clause_ends(words)[codes]), at[1:] - 1)
    symbols: dict[int, list] = {}
    for c in np.unique(np.searchsorted(stops, spots)).tolist():
        stop = int(stops[c])
        row = int(np.searchsorted(at, stop, side="right")) - 1
        start = max(int(stops[c - 1]) + 1 if c else 0, int(at[row]))
        own = codes[start : stop + 1].tolist()
        for k in own:
            if k not in symbols:
                symbols[k] = model.symbol(words[k].as_py(), folded(words.slice(k, 1))[0].as_py())
        if found := clause_match([s for k in own for s in symbols[k]]):
            out[row, found[0]] += found[1]
    out[:, -1] = out[:, :-1] @ PRIOR
    return out


def probabilities(model: Model, x: np.ndarray) -> np.ndarray:
    z = model.bias + np.log1p(x) @ model.weights
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton's method; (weights, bias)."""
    if not len(y) or y.min() == y.max():
        rate = float(y.mean()) if len(y) else 0.0
        return np.zeros(x.shape[1]), math.log(max(rate, 1e-9) / max(1 - rate, 1e-9))
    z = np.column_stack([np.log1p(x), np.ones(len(y))])
    w = np.zeros(z.shape[1])
    hold = np.full(len(w), ridge * len(y))
    hold[:-2] *= 200  # a pattern departs from its prior only on evidence
    hold[-1] = 1e-9
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(hold) + 1e-9 * np.eye(len(w)), z.T @ (y - p) - hold * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that nothing is learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def _plain(codes: np.ndarray, at: np.ndarray, words: pa.Array) -> np.ndarray:
    """Which tokens stand outside the reach of a negation, a reporting word and quotes, in their clause."""
    own = words.to_pylist()
    cores = [[c for c in _CORE.findall(w) if c in _MARKS] for w in folded(words).to_pylist()]
    negates = np.array([any(_MARKS[c] == "N" for c in x) for x in cores] or [False])[codes]
    reports = np.array([any(_MARKS[c] == "R" for c in x) for x in cores] or [False])[codes]
    quotes = np.array([sum(w.count(q) for q in QUOTES) for w in own] or [0], np.int64)
    place = np.arange(len(codes))
    ends = np.zeros(len(codes), bool)
    ends[np.flatnonzero(clause_ends(words)[codes])] = True
    ends[at[1:] - 1] = True
    first = np.concatenate([[True], ends[:-1]])
    start = np.maximum.accumulate(np.where(first, place, 0))
    near = np.maximum.accumulate(np.where(negates, place, -REACH - 1))
    told = np.maximum.accumulate(np.where(reports, place, -1))
    before = np.concatenate([[0], np.cumsum(quotes[codes])])
    within = (before[:-1] - before[start]) % 2 > 0
    return ~((near >= start) & (place - near <= REACH) | (told >= start) | within | (quotes[codes] > 0))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, toxic documents, other documents) of each batch, by plain uses."""
    for batch in batches:
        for rows in slices(batch):
            codes, at, words = tokens_of(rows.column("text"))
            cores = [set(_CORE.findall(w)) for w in folded(words).to_pylist()]
            names: dict[str, int] = {}
            flat = np.array([names.setdefault(c, len(names)) for x in cores for c in x], np.int64)
            sizes = np.array([len(x) for x in cores], np.int64)
            row = np.repeat(np.arange(len(at) - 1), np.diff(at))
            plain = _plain(codes, at, words)
            pairs = np.unique(row[plain] * max(1, len(words)) + codes[plain])
            row, code = pairs // max(1, len(words)), pairs % max(1, len(words))
            starts = np.cumsum(sizes) - sizes
            each = sizes[code]
            word = flat[np.repeat(starts[code] - (np.cumsum(each) - each), each) + np.arange(each.sum())] if len(flat) else flat
            doc = np.repeat(row, each)
            pairs = np.unique(doc * max(1, len(names)) + word)
            doc, word = pairs // max(1, len(names)), pairs % max(1, len(names))
            toxic = np.asarray(rows.column("toxic"), np.int64)[doc]
            n, t = np.bincount(word, minlength=len(names)), np.bincount(word, weights=toxic, minlength=len(names)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(list(names), pa.string()), pa.array(t), pa.array(n - t)], names=["word", "toxic_docs", "other_docs"])


def _surprise(toxic: Column, other: Column, rate: float) -> Column:
    """Twice the log-likelihood ratio of a word's toxic share against the overall rate."""
    t, o = toxic.cast("double"), other.cast("double")
    n = t + o
    part = lambda k, q: F.when(k > 0, k * F.log(k / (n * F.lit(q)))).otherwise(0.0)
    return 2 * (part(t, rate) + part(o, 1 - rate))


def learn(docs: DataFrame, labels: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Lexicon and pattern weights from a bounded sample of the labelled rows that aren't held out."""
    s = settings or Settings()
    known = labels.select(F.col("doc_id").cast("long").alias("__of"), F.col("toxic").cast("int").alias("toxic")).dropna()
    known = known.filter(~held_out("__of")).groupBy("__of").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("__of"), "__of").limit(s.labelled_rows)  # a bounded table, so it may be broadcast
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), text_of(text_col).alias("text"))
    sample = written(rows.join(F.broadcast(known), F.col("__id") == F.col("__of")).select("text", "toxic"), "labelled")
    total = sample.agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).first()
    if not total.n or not 0 < total.t < total.n:
        return Model({}, {}, *fit_logistic(np.zeros((total.n, WIDTH)), np.full(total.n, float(bool(total.t))), s.ridge))
    words = written(sample.mapInArrow(_count_words, "word string, toxic_docs long, other_docs long").groupBy("word").agg(F.sum("toxic_docs").alias("t"), F.sum("other_docs").alias("o")), "words")
    rate = words.agg((F.sum("t") / F.sum(F.col("t") + F.col("o"))).alias("rate")).first().rate
    chosen = (F.col("t") >= F.lit(s.purity) * (F.col("t") + F.col("o"))) & (_surprise(F.col("t"), F.col("o"), rate) >= s.surprise)
    weight = F.log((F.col("t") + 0.5) / F.lit(total.t)) - F.log((F.col("o") + 0.5) / F.lit(total.n - total.t))
    stem = F.explode(F.expr(f"transform(filter(sequence({s.shortest}, {s.longest}), k -> k < char_length(word)), k -> substring(word, 1, k))"))
    # a stem stands for its words only if several toxic ones share it
    stems = words.select(stem.alias("entry"), "t", "o").groupBy("entry").agg(F.sum("t").alias("t"), F.sum("o").alias("o"), F.count_if(F.col("t") > 0).alias("forms")).filter("forms >= 3")
    found = words.select(F.col("word").alias("entry"), "t", "o", F.lit(False).alias("stem")).unionByName(stems.select("entry", "t", "o", F.lit(True).alias("stem")))
    found = found.filter(chosen).orderBy(F.col("t").desc(), "entry", "stem").select("entry", "stem", "t", weight.alias("weight")).collect()
    entries = sorted((r.stem, len(r.entry), r.entry, r.weight, r.t) for r in found)
    stems_of: dict[str, float] = {}
    longer = {entry: (w, t) for is_stem, _, entry, w, t in entries if is_stem and w > 0}
    for entry in longer:  # the shortest stem speaks for the longer ones, drawn out while it keeps its documents
        if any(entry[:k] in stems_of or entry[:k] in longer for k in range(s.shortest, len(entry))):
            continue
        while more := [e for e in longer if e[:-1] == entry and longer[e][1] >= s.stem_share * longer[entry][1]]:
            entry = more[0]
        stems_of[entry] = longer[entry][0]
    words_of = {entry: w for is_stem, _, entry, w, _ in entries if not is_stem and w > 0}
    model = Model(words_of, stems_of, np.zeros(WIDTH), 0.0)

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = pd.DataFrame(np.round(features(model, part.column("text")), 6))
                x["toxic"] = np.asarray(part.column("toxic"))
                grouped = x.groupby(list(x.columns)).size()
                for key, n in grouped.items():
                    yield pa.RecordBatch.from_pydict({"x": pa.array([list(key[:-1])], pa.list_(pa.float64())), "toxic": pa.array([key[-1]], pa.int32()), "n": [n]})

    vectors = sample.mapInArrow(matched, "x array<double>, toxic int, n long").groupBy("x", "toxic").agg(F.sum("n").alias("n")).collect()  # at most labelled_rows
    x = np.array([r.x for r in vectors]).reshape(-1, WIDTH)
    n = np.array([r.n for r in vectors])
    model.weights, model.bias = fit_logistic(np.repeat(x, n, axis=0), np.repeat([float(r.toxic) for r in vectors], n), s.ridge)
    return model


def scored(docs: DataFrame, model: Model, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    least = (settings or Settings()).threshold

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch):
                p = probabilities(model, features(model, rows.column("text")))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(p)], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    out = rows.mapInArrow(score, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def toxicity_scores(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> DataFrame:
    return scored(docs, learn(docs, labels, settings), settings)


def without_toxic(docs: DataFrame, labels: DataFrame, settings: Settings | None = None, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that aren't predicted toxic."""
    model, least = learn(docs, labels, settings), (settings or Settings()).threshold
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(at), "")
            p = np.concatenate([probabilities(model, features(model, s.column("text"))) for s in slices(pa.RecordBatch.from_arrays([texts], names=["text"]))] or [np.empty(0)])
            yield batch.filter(pa.array(p < least))

    return docs.mapInArrow(keep, docs.schema)
