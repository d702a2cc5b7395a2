"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed from left to right into phrases, each as
long as the automaton can follow it; the language whose phrases, weighted by log2 of the length of its labelled text, are
fewest for the text's length wins. Texts are normalised first: ASCII letters lower-cased, every run of other ASCII bytes
one separator, longer code points by their bytes. All languages are parsed in step over thousands of segments of SEGMENT
symbols at a time by table look-up; a phrase ends with its segment, which costs every language the same.

Labelled text is a bounded sample: of each language, ROWS_PER_LANG rows at most by hash of doc_id (of rows of one doc_id, one),
up to CHARS_PER_ROW characters of each, at a place that the hash chooses, and SYMBOLS_PER_LANG symbols of these at most, an
equal share of every drawn row; whatever the number of languages, MAX_LANGS at most. An automaton is kept as a double array
(states' rows of transitions laid over each other), some 0.5 MB a language. Prediction reads whole texts and nothing else,
long ones in slices that end at white space.

Null texts and texts without a letter are `und` with score 0. If nothing can be learned, everything is `und`. Score: the
share of the winner when each language weighs 2^-(its bits above the winner's / 8). Repeated rows each count; an empty
table gives an empty result; further columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thicket.llm._common import read
from thicket.llm._text import _slices, by_bytes, texts

ROWS_PER_LANG, CHARS_PER_ROW, SYMBOLS_PER_LANG, MAX_LANGS, SEGMENT = 48, 1024, 22_528, 256, 512
FOLDS = 5
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[128:] = 27 + np.arange(128) % 64
_SYMBOL[0xC0:] = 91
ALPHABET = 92
SCHEMA = "doc_id long, lang_pred string, score double"


def symbols(offs: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised symbols of all texts, runs of separators as one, and the number of each text's symbols."""
    b = _SYMBOL[data[offs[0] : offs[-1]]]
    keep = np.ones(len(b), bool)
    keep[1:] = (b[1:] != 0) | (b[:-1] != 0)
    starts = (offs[:-1] - offs[0])[np.diff(offs) > 0]
    keep[starts] = True
    ends = np.concatenate([[0], np.cumsum(keep)])
    return b[keep], ends[offs[1:] - offs[0]] - ends[offs[:-1] - offs[0]]


def automaton(text: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence of symbols; state 0 is its start."""
    go, link, length, last = [{}], [-1], [0], 0
    for c in text.tolist():
        now = len(go)
        go.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = now
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                clone = len(go)
                go.append(dict(go[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = clone
                    p = link[p]
                link[q] = link[now] = clone
        last = now
    return go


def double_array(go: list[dict[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base of each state, and owner and next state of each cell: s goes by c to next[base[s] + c] if owner there is s."""
    room = sum(map(len, go)) + 2 * ALPHABET + 1
    base, owner, to = [0] * len(go), [-1] * room, [0] * room
    low = begin = 0  # no cell before low is free; rows of several transitions are tried from begin on
    for s in sorted(range(len(go)), key=lambda s: -len(go[s])):
        out = list(go[s])
        if not out:
            continue
        while low < len(owner) and owner[low] >= 0:
            low += 1
        at, tries = max(low - min(out), 0) if len(out) == 1 else max(begin, low - min(out), 0), 0
        while True:
            if at + ALPHABET >= len(owner):
                owner += [-1] * room
                to += [0] * room
            if all(owner[at + c] < 0 for c in out):
                break
            at, tries = at + 1, tries + 1
        if tries > 20:
            begin = at
        base[s] = at
        for c in out:
            owner[at + c], to[at + c] = s, go[s][c]
    size = max(base) + ALPHABET
    return tuple(np.array(x, np.int32) for x in (base, (owner + [-1] * size)[:size], (to + [0] * size)[:size]))


def shared(rows: list[np.ndarray], most: int) -> np.ndarray:
    """At most `most` symbols of the rows, an equal share of each; what short rows leave goes to the longer ones."""
    take, left = [0] * len(rows), most
    for nth, k in enumerate(sorted(range(len(rows)), key=lambda k: len(rows[k]))):
        take[k] = min(len(rows[k]), left // (len(rows) - nth))
        left -= take[k]
    return np.concatenate([r[:n] for r, n in zip(rows, take, strict=True)] or [np.zeros(0, np.uint8)])


class Model:
    """langs, and for each its automaton and the bits that a phrase costs."""

    def __init__(self, labelled: dict[str, list[str]], symbols_per_lang: int = SYMBOLS_PER_LANG):
        self.langs = sorted(labelled)
        parts = {k: shared([symbols(*texts(pa.array([t])))[0] for t in v], symbols_per_lang) for k, v in labelled.items()}
        machines = [automaton(parts[k]) for k in self.langs]
        self.bits = np.array([np.log2(max(2, len(parts[k]))) for k in self.langs])
        self.arrays = [double_array(go) for go in machines]
        self.roots = [np.array([go[0].get(c, 0) for c in range(ALPHABET)], np.int32) for go in machines]

    def phrases(self, sym: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Number of phrases of each text (rows) in each language."""
        counts = np.zeros((len(self.langs), len(sizes)), np.int64)
        per = -(-sizes // SEGMENT)
        if not per.sum():
            return counts.T
        text = np.repeat(np.arange(len(sizes)), per)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
        begin = np.repeat(np.cumsum(sizes) - sizes, per) + nth * SEGMENT
        length = np.minimum(SEGMENT, np.repeat(sizes, per) - nth * SEGMENT)
        order = np.argsort(-length, kind="stable")
        begin, length, text = begin[order], length[order], text[order]
        alive = np.searchsorted(-length, -np.arange(length[0]), "left")
        for k in range(len(self.langs)):
            (base, owner, to), root, n = self.arrays[k], self.roots[k], len(begin)
            state, ended = np.zeros(n, np.int32), np.ones(n, np.int32)
            for t, a in enumerate(alive.tolist()):
                c = sym[begin[:a] + t]
                cell = base[state[:a]] + c
                stop = owner[cell] != state[:a]  # a phrase ends, a new one has begun with c
                ended[:a] += stop
                state[:a] = np.where(stop, root[c], to[cell])
            counts[k] = np.bincount(text, weights=ended, minlength=len(sizes)).astype(np.int64)
        return counts.T

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        offs, data = texts(column)
        n = len(offs) - 1
        some, counts = np.zeros(n, bool), np.zeros((n, len(self.langs)), np.int64)
        for first, rows, cuts in _slices(offs, data):
            own = slice(first, first + rows)
            raw = data[cuts[0] : cuts[-1]]
            letter = np.concatenate([[0], np.cumsum((_SYMBOL[raw] > 0) & (raw < 128))])
            some[own] |= letter[cuts[1:] - cuts[0]] > letter[cuts[:-1] - cuts[0]]
            for i in np.flatnonzero(~some[own] & (np.diff(cuts) > 0)):
                some[first + i] = any(map(str.isalpha, bytes(data[cuts[i] : cuts[i + 1]]).decode("utf-8", "replace")))
            counts[own] += self.phrases(*symbols(cuts, data))
        if not self.langs:
            return ["und"] * n, np.zeros(n)
        bits = counts * self.bits
        best = bits.argmin(1)
        share = 1 / np.exp2((bits.min(1, keepdims=True) - bits) / 8).sum(1)
        return [self.langs[k] if s else "und" for k, s in zip(best, some, strict=True)], np.where(some, share, 0.0)


def fold(folds: int = FOLDS):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def train(docs: DataFrame, rows: int = ROWS_PER_LANG, chars: int = CHARS_PER_ROW, folds: int = FOLDS) -> Model:
    """A model of the labelled rows whose fold is not 0."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(folds) != 0))
    counts = {r[0]: r[1] for r in usable.groupBy("lang").agg(F.approx_count_distinct("doc_id")).limit(MAX_LANGS + 1).collect()}
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages: the tables would pass their bound")
    if not counts:
        return Model({})
    share = F.element_at(F.create_map(*[F.lit(x) for k, v in counts.items() for x in (k, min(1.0, 4.0 * rows / max(1, v)))]), F.col("lang"))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    place = (draw % F.greatest(F.lit(1), F.length("text") - chars + 1) + 1).cast("int")
    drawn = usable.where(draw < share * (1 << 30)).select("lang", draw.alias("draw"), F.col("text").substr(place, F.lit(chars)).alias("part"))
    one = drawn.groupBy("lang", "draw").agg(F.min("part").alias("part")).withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("draw")))
    parts: dict[str, list[str]] = {}
    for lang, _, part in sorted(one.where(F.col("nth") <= rows).select("lang", "draw", "part").collect()):  # chars of each
        parts.setdefault(lang, []).append(part)
    return Model(parts)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of each row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in by_bytes(batches, 4 << 20):
            langs, score = held.value.predict(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def keep_identified(docs: DataFrame, model: Model, least_score: float = 0.0) -> DataFrame:
    """The rows of docs that aren't `und` and reach least_score, in one pass over them."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for batch in by_bytes(batches, 4 << 20):
            langs, score = held.value.predict(batch.column(at))
            yield batch.filter(pa.array([x != "und" for x in langs]) if least_score <= 0 else pa.array([x != "und" and s >= least_score for x, s in zip(langs, score, strict=True)]))

    return docs.mapInArrow(run, docs.schema)


def op5_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    found = identify(docs, train(docs))
    return found.select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score")


QUERIES = {"op5_language_id": op5_language_id}
ORACLE_SQL: dict[str, str] = {}
