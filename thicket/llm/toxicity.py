"""Toxicity by the nearest labelled examples under exact cosine of weighted TF-IDF.

Terms are runs of five bytes within a word, the space before it included, and whole words of three bytes or fewer; A-Z
lower-cased. Insults are inflected and compounded, and such terms still meet. Every term of every example is indexed, whatever
its label, length or rank. A term weighs by idf, times LEAST plus the root of its chi-square between the examples' labels,
of which a term that leans to clean ones gets the part CLEAN: so no term is without weight, and what tells the labels apart
counts most. Document frequencies are counted over all documents. Terms that no example has can't meet one, so they are
left out, also from a document's norm.

A document is compared with all examples. They lie in GROUPS groups of like ones: terms whose share of a group times their
share of all examples is SHARE (DENSE of them at most) go by a matrix product, the others by their postings; what comes within SLACK of the NEAREST-th best is computed anew in double precision, so
the neighbours found are the exact ones (ties: all examples as near as the last are taken). Votes weigh by
1 / (1.05 - cosine), with PRIOR votes of the examples' base rate; a document without any term is as near to every example
without one as to any.

The share of toxic votes is then calibrated: the examples are dealt to FOLDS_OUT folds by hash of their text, each fold is
scored by the others (whose labels alone weigh the terms), and a logistic curve over the log odds of those shares is fitted,
each example counting for as many learnable rows as it stands for. So a score is a chance in the learnable rows.

Examples are a bounded sample: at most PER_LABEL learnable rows of each label, by hash of doc_id; their index is broadcast.
Learnable: label not null, crc32(doc_id as text) mod 3 not 1. Of several texts of one labelled doc_id the least is taken.
Null text counts as empty. Without examples every score is 0; with examples of one label only, shares aren't calibrated. Texts
are taken in slices that end at white space, so a long one needs no more memory than its distinct terms. Repeated rows each
count; an empty table gives an empty result; further columns are ignored."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm._common import cut, read
from thicket.llm._text import LOWER, SLICE, SPACE, _slices, by_bytes, texts

PER_LABEL, LEAST, CLEAN, BLOCK, NEAREST, PRIOR, CUTOFF = 4096, 0.25, 0.7, 256, 7, 0.5, 0.7
GROUPS, SHARE, DENSE, SLACK = 8, 1 / 512, 4096, 1e-4
FOLDS, HELD, FOLDS_OUT = 3, 1, 4
FOLDED = np.where(SPACE, 0x20, LOWER).astype(np.uint8).tobytes()


def grams(offs: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms of all texts, as numbers of 40 bits, and the text of each."""
    n, total = len(offs) - 1, int(offs[-1] - offs[0])
    gaps = offs[:-1] - offs[0] + np.arange(n)  # a space before each text
    own = np.ones(total + n + 8, bool)
    own[gaps] = own[total + n :] = False
    b = np.full(total + n + 8, 0x20, np.uint8)
    b[own] = np.frombuffer(data[offs[0] : offs[-1]].tobytes().translate(FOLDED), np.uint8)
    word = b != 0x20
    w = np.ndarray((len(b) - 8,), dtype="<u8", buffer=b, strides=(1,))
    pair = word[1:] & word[:-1]
    run = np.flatnonzero(pair[1 : len(w) + 1] & pair[3 : len(w) + 3])
    short = np.flatnonzero(~word[: len(w)] & word[1 : len(w) + 1])  # whole words of three bytes or fewer, with the spaces around them
    two = word[short + 2]
    three = word[short + 3] & two
    some = ~(word[short + 4] & three)
    short, bits = short[some], np.uint64(24) + np.uint64(8) * two[some] + np.uint64(8) * three[some]
    g = [w[run] & np.uint64((1 << 40) - 1), w[short] & ((np.uint64(1) << bits) - np.uint64(1))]
    of = [np.repeat(np.arange(n), np.diff(np.searchsorted(i, np.append(gaps, len(b))))) for i in (run, short)]
    return np.concatenate(g), np.concatenate(of)


def counted(column: pa.Array):
    """(text, term, times) arrays of each slice of a column, ascending by term and then text."""
    offs, data = texts(column)
    for first, n, cuts in _slices(offs, data):
        g, of = grams(cuts, data)
        if n == 1:
            terms, times = np.unique(g, return_counts=True)
            yield np.full(len(terms), first), terms, times
            continue
        key = np.sort(g << np.uint64(24) | of.astype(np.uint64))
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        times = np.diff(np.append(at, len(key)))
        yield first + (key[at] & np.uint64((1 << 24) - 1)).astype(np.int64), key[at] >> np.uint64(24), times


def looked_up(terms: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal numbers of g (ascending) begins, and its place in `terms`, or -1."""
    at = np.flatnonzero(np.append(True, g[1:] != g[:-1])[: len(g)])
    place = np.minimum(np.searchsorted(terms, g[at]), len(terms) - 1)
    return at, np.where(terms[place] == g[at], place, -1)


def frequencies(terms: np.ndarray, column: pa.Array) -> np.ndarray:
    """In how many texts each of `terms` (sorted) is."""
    if np.diff(texts(column)[0]).max(initial=0) > SLICE:  # a text in several slices
        return np.bincount(features(terms, column)[1], minlength=len(terms))
    df = np.zeros(len(terms), np.int64)
    for _, g, _ in counted(column):
        if len(g) and len(terms):
            at, place = looked_up(terms, g)
            df[place[place >= 0]] += np.diff(np.append(at, len(g)))[place >= 0]
    return df


def features(terms: np.ndarray, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of texts, the places of their terms in `terms` (sorted), ascending, and how often each occurs."""
    rows, places, counts, last, again = [], [], [], -1, False
    for of, g, times in counted(column):
        if len(of) and len(terms):
            at, place = looked_up(terms, g)
            place = np.repeat(place, np.diff(np.append(at, len(g))))
            same = place >= 0
            again |= int(of.min()) <= last
            last = max(last, int(of.max()))
            rows.append(of[same])
            places.append(place[same])
            counts.append(times[same])
    if not rows:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    of, place, times = map(np.concatenate, (rows, places, counts))
    if again:  # a text in several slices
        key, inverse = np.unique(of * len(terms) + place, return_inverse=True)
        (of, place), times = np.divmod(key, len(terms)), np.bincount(inverse, weights=times).astype(np.int64)
    else:
        order = np.argsort(of.astype(np.uint16) if len(column) < 1 << 16 else of, kind="stable")
        of, place, times = of[order], place[order], times[order]
    return np.searchsorted(of, np.arange(len(column) + 1)), place, times


def _vocabulary(batches):
    for batch in by_bytes(batches, 2 << 20):
        found = [np.unique(g) for _, g, _ in counted(batch.column(0))]
        terms = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
        for k in range(0, len(terms), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(terms[k : k + 100_000].astype(np.int64))], names=["term"])


def _frequencies(vocabulary):
    """Each task's documents, and in how many of them each term is (term -1: the documents)."""

    def run(batches):
        terms = vocabulary.value
        df, total = np.zeros(len(terms), np.int64), 0
        for part in by_bytes(batches, 2 << 20):
            df += frequencies(terms, part.column(0))
            total += part.num_rows
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([total])], names=["term", "df"])
        for k in range(0, len(found), 100_000):
            part = found[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(df[part])], names=["term", "df"])

    return run


def packed(place: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending places and their times in few bytes."""
    both = np.stack([np.diff(place, prepend=0), times]).astype("<u4")
    return zlib.compress(both.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T.copy().view("<u4").reshape(2, -1).astype(np.int64)
    return np.cumsum(both[0]), both[1]


def _examples(vocabulary):
    def run(batches):
        for batch in by_bytes(batches, 2 << 20):
            offs, place, times = features(vocabulary.value, batch.column(3))
            lists = [packed(place[a:z], times[a:z]) for a, z in zip(offs[:-1], offs[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(lists, pa.binary())], names=["doc_id", "toxic", "part", "terms"])

    return run


def weights(idf: np.ndarray, lists: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Weight of each term by its idf and by how it tells the examples' labels apart."""
    zeros = np.zeros(0, np.int64)
    a, b = (np.bincount(np.concatenate([zeros, *(x for x, y in zip(lists, toxic, strict=True) if y == label)]), minlength=len(idf)).astype(float) for label in (1, 0))
    n1, n0 = int((toxic == 1).sum()), int((toxic == 0).sum())
    if not n1 or not n0:
        return idf * LEAST
    chi2 = (n1 + n0) * (a * (n0 - b) - b * (n1 - a)) ** 2 / (np.maximum(1, (a + b) * (n1 + n0 - a - b)) * n1 * n0)
    return idf * (LEAST + np.sqrt(chi2) * np.where(a * n0 > b * n1, 1.0, CLEAN))


def log_odds(share: np.ndarray) -> np.ndarray:
    share = np.clip(share, 1e-6, 1 - 1e-6)
    return np.log(share / (1 - share))


def curve(share: np.ndarray, toxic: np.ndarray, votes: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic curve from log odds of shares to labels, drawn by a unit ridge to (1, 0)."""
    x = np.stack([log_odds(share), np.ones(len(share))], 1)
    votes = votes * len(votes) / max(1e-9, votes.sum())
    at = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -500, 500)))
        step = np.linalg.solve((x * (votes * p * (1 - p))[:, None]).T @ x + np.eye(2), x.T @ (votes * (toxic - p)) - (at - [1.0, 0.0]))
        at = at + step * min(1.0, 1 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-10:
            break
    return (float(at[0]), float(at[1])) if at[0] > 0 else (1.0, 0.0)


def alike(x: np.ndarray, k: int) -> np.ndarray:
    """k groups of like rows at most, by a few rounds of cosine k-means from rows at even distances."""
    centres, group = x[np.linspace(0, len(x) - 1, k).astype(int)], np.zeros(len(x), np.int64)
    for _ in range(6):
        group = (x @ centres.T).argmax(1)
        sums = np.stack([x[group == j].sum(0) for j in range(k)])
        centres = sums / np.maximum(1e-9, np.linalg.norm(sums, axis=1, keepdims=True))
    return group


class Index:
    """Unit vectors of examples, for cosines with `block` texts at a time. examples: (doc_id, toxic, packed terms).

    What a worker needs beyond them is laid out at its first use: the examples in groups of like ones; for each group the
    matrix of the terms that are frequent in it; and postings of all other terms."""

    def __init__(self, examples: list, weight: np.ndarray, line: tuple[float, float] = (1.0, 0.0), block: int = BLOCK):
        self.examples, self.weight, self.line, self.block, self.laid = examples, weight, line, block, None
        self.base = float(np.mean([x[1] for x in examples])) if examples else 0.0

    def flat(self, kept: list) -> None:
        self.ids, self.toxic = (np.array([x[k] for x in kept], np.int64) for k in (0, 1))
        self.starts = np.cumsum([0, *(len(x[2]) for x in kept)])
        self.terms = np.concatenate([np.zeros(0, np.int32), *(x[2] for x in kept)])
        self.values = np.concatenate([np.zeros(0), *(x[3] for x in kept)])

    def lay(self) -> None:
        if self.laid is not None:
            return
        kept, bare = [], [0, 0]
        for doc, toxic, data in self.examples:
            terms, times = unpacked(data)
            if len(terms):
                w = self.units(np.array([0, len(terms)]), terms, times)
                kept.append((doc, toxic, terms.astype(np.int32), w))
            else:
                bare[toxic] += 1
        self.none = (bare[1] + PRIOR * self.base) / (sum(bare) + PRIOR)
        kept.sort(key=lambda x: x[0])
        self.flat(kept)
        most, n = len(self.weight), len(kept)
        groups = max(1, min(GROUPS, n // 64))
        mass = np.bincount(self.terms, weights=self.values**2, minlength=most)
        column = np.full(most, -1)
        heavy = np.argsort(-mass, kind="stable")[:512]
        column[heavy] = np.arange(len(heavy))
        row, at = np.repeat(np.arange(n), np.diff(self.starts)), column[self.terms]
        x = np.zeros((n, len(heavy)), np.float32)
        x[row[at >= 0], at[at >= 0]] = self.values[at >= 0]
        group = alike(x, groups) if n else np.zeros(0, np.int64)
        order = np.argsort(group, kind="stable")
        self.flat([kept[i] for i in order])
        bounds = np.searchsorted(group[order], np.arange(groups + 1))
        often, matrices, rare, used = [], [], np.ones(len(self.terms), bool), np.zeros(most, bool)
        overall = np.bincount(self.terms, minlength=most) / max(1, n)
        for a, z in zip(bounds[:-1], bounds[1:], strict=True):
            own = slice(self.starts[a], self.starts[z])
            terms = self.terms[own]
            count = np.bincount(terms, minlength=most)
            gain = overall * count  # of a product: postings saved for a text, as texts have a term as often as examples
            top = np.argsort(-gain, kind="stable")[:DENSE]
            top = top[(count[top] >= 2) & (gain[top] >= SHARE * (z - a))]
            column[:] = -1
            column[top] = np.arange(len(top))
            at, row = column[terms], np.repeat(np.arange(z - a), np.diff(self.starts[a : z + 1]))
            rare[own] = at < 0
            matrix = np.zeros((len(top), z - a), np.float32)
            matrix[at[at >= 0], row[at >= 0]] = self.values[own][at >= 0]
            often.append(top)
            matrices.append(matrix)
            used[top] = True
        column[:] = -1
        column[used] = np.arange(used.sum())
        entry = np.flatnonzero(rare)
        entry = entry[np.argsort(self.terms[entry], kind="stable")]
        starts = np.searchsorted(self.terms[entry], np.arange(most + 1))
        posting = np.empty((len(entry), 2), np.int32)  # example, and its value's bits: one look-up for both
        posting[:, 0] = np.repeat(np.arange(n), np.diff(self.starts))[entry]
        posting[:, 1] = self.values[entry].astype(np.float32).view(np.int32)
        posting = posting.view(np.int64).ravel()
        self.laid = column, int(used.sum()), [column[t] for t in often], matrices, bounds, starts, posting
        self.spread = np.zeros(most)

    def units(self, offs: np.ndarray, terms: np.ndarray, times: np.ndarray) -> np.ndarray:
        """The unit vectors of texts whose terms lie between offs, one after the other; none of them without terms."""
        w = (1 + np.log(times)) * self.weight[terms]
        return w / np.repeat(np.maximum(1e-12, np.sqrt(np.add.reduceat(w * w, offs[:-1]))), np.diff(offs))

    def cosines(self, offs: np.ndarray, terms: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Cosines of some texts with all examples, in single precision."""
        column, width, often, matrices, bounds, starts, posting = self.laid
        n, of = len(offs) - 1, np.repeat(np.arange(len(offs) - 1), np.diff(offs))
        q, out, at = np.zeros((width, n), np.float32), np.zeros((len(self.ids), n), np.float32), column[terms]
        q[at[at >= 0], of[at >= 0]] = w[at >= 0]
        for top, matrix, a, z in zip(often, matrices, bounds[:-1], bounds[1:], strict=True):
            out[a:z] = matrix.T @ q[top]  # a text in each column: so the rows of q lie together
        out = np.ascontiguousarray(out.T)
        begin = starts[terms]
        size = starts[terms + 1] - begin
        some = np.flatnonzero(size)
        begin, size, w, cuts = begin[some], size[some], w[some], np.searchsorted(some, offs)
        for k in range(n):
            own = slice(cuts[k], cuts[k + 1])
            if cuts[k + 1] > cuts[k]:
                first, end = begin[own], np.cumsum(size[own])
                at = np.ones(end[-1], np.int64)
                at[0] = first[0]
                at[end[:-1]] = first[1:] - first[:-1] - size[own][:-1] + 1
                found = posting[np.cumsum(at, out=at)]
                value = found.view(np.float32)[1::2] * np.repeat(w[own], size[own])
                out[k] += np.bincount(found & 0xFFFFFFFF, weights=value, minlength=len(self.ids))
        return out

    def best(self, terms: np.ndarray, w: np.ndarray, near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the examples, the k with the best cosines (near: in single precision), ties of the last included."""
        floor = 0.0
        if len(near) > 4 * k:  # the k-th best of k or more parts' best is no better than the k-th best of all
            part = np.maximum.reduceat(near, np.arange(0, len(near), max(1, len(near) // max(128, 2 * k))))
            floor = np.partition(part, -k)[-k] - SLACK
        some = np.flatnonzero(near >= floor) if floor > 0 else np.flatnonzero(near > 0)
        if len(some) > k:
            some = some[near[some] >= np.partition(near[some], -k)[-k] - SLACK]
        self.spread[terms] = w
        runs = [slice(a, z) for a, z in zip(self.starts[some].tolist(), self.starts[some + 1].tolist(), strict=True)]
        cosine = np.array([self.spread[self.terms[r]].dot(self.values[r]) for r in runs])
        self.spread[terms] = 0.0
        if len(some) > k:
            good = cosine >= np.partition(cosine, -k)[-k] - 1e-9
            some, cosine = some[good], cosine[good]
        order = np.lexsort((self.ids[some], -np.round(cosine, 9)))
        return some[order], cosine[order]

    def nearest(self, terms, times, k: int = NEAREST) -> tuple[np.ndarray, np.ndarray]:
        """Examples with a cosine above 0 and not below the k-th best, and their cosines, best first. terms: ascending."""
        self.lay()
        terms, offs = np.asarray(terms), np.array([0, len(terms)])
        w = self.units(offs, terms, np.asarray(times))
        return self.best(terms, w, self.cosines(offs, terms, w)[0], k)

    def shares(self, offs: np.ndarray, terms: np.ndarray, times: np.ndarray) -> list[tuple[float, list[int], list[float]]]:
        """Share of toxic votes, nearest doc_ids and their cosines of each text, whose terms lie between its offsets."""
        self.lay()
        out = [(self.none, [], [])] * (len(offs) - 1)
        some = np.flatnonzero(np.diff(offs)) if len(self.ids) else np.zeros(0, np.int64)
        for k in range(0, len(some), self.block):
            part = some[k : k + self.block]
            bounds = np.append(offs[part], offs[part[-1] + 1])  # what lies between is without terms
            t, own = terms[bounds[0] : bounds[-1]], bounds - bounds[0]
            w = self.units(own, t, times[bounds[0] : bounds[-1]])
            for i, a, z, near in zip(part.tolist(), own[:-1], own[1:], self.cosines(own, t, w), strict=True):
                found, cosine = self.best(t[a:z], w[a:z], near, NEAREST)
                v = 1 / (1.05 - np.minimum(1.0, cosine))
                value = (float(v[self.toxic[found] == 1].sum()) + PRIOR * self.base) / (float(v.sum()) + PRIOR)
                out[i] = (value, self.ids[found[:3]].tolist(), np.round(cosine[:3], 6).tolist())
        return out

    def calibrated(self, share: np.ndarray) -> np.ndarray:
        if not self.examples:
            return np.zeros(len(share))
        return 1 / (1 + np.exp(-np.clip(self.line[0] * log_odds(share) + self.line[1], -500, 500)))


def _cross(held):
    """Shares of toxic votes of the examples of one part by those of the others."""

    def run(batches):
        for batch in batches:
            for part in batch.column(0).to_pylist():
                rows, parts, idf = held.value
                lists = [unpacked(x[2]) for x in rows]
                other = [i for i in range(len(rows)) if parts[i] != part]
                own = [i for i in range(len(rows)) if parts[i] == part]
                index = Index([rows[i] for i in other], weights(idf, [lists[i][0] for i in other], np.array([rows[i][1] for i in other])))
                offs = np.cumsum([0, *(len(lists[i][0]) for i in own)])
                got = index.shares(offs, *(np.concatenate([np.zeros(0, np.int64), *(lists[i][k] for i in own)]) for k in (0, 1)))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([g[0] for g in got], pa.float64())], names=["row", "share"])

    return run


def fold():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS


def fit(d: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> tuple[np.ndarray, Index]:
    """Terms (sorted) and the index of a sample of the labelled rows of d (doc_id, text)."""
    spark = d.sparkSession
    learnable = labels.where((fold() != HELD) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picks = [learnable.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for y in (0, 1)]
    sample = cut(picks[0].unionByName(picks[1]))  # 2 * per_label rows at most, so it may be broadcast
    text = F.min(F.coalesce("text", F.lit(""))).alias("text")
    part = F.pmod(F.xxhash64("text"), F.lit(FOLDS_OUT)).cast("int").alias("part")
    marked = cut(d.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"), text).select("doc_id", "toxic", part, "text"))
    terms = np.sort(marked.select("text").mapInArrow(_vocabulary, "term long").distinct().toArrow()["term"].to_numpy().astype(np.uint64))
    vocabulary = spark.sparkContext.broadcast(terms)
    seen = d.select("text").mapInArrow(_frequencies(vocabulary), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    place, times = seen["term"].to_numpy(), seen["df"].to_numpy()
    df = np.zeros(len(terms))
    df[place[place >= 0]] = times[place >= 0]
    idf = np.log((times[place < 0].sum() + 1) / (df + 1)) + 1
    got = marked.mapInArrow(_examples(vocabulary), "doc_id long, toxic int, part int, terms binary").toArrow().sort_by("doc_id").to_pydict()
    examples, toxic = list(zip(got["doc_id"], got["toxic"], got["terms"], strict=True)), np.array(got["toxic"], np.int64)
    weight = weights(idf, [unpacked(x[2])[0] for x in examples], toxic)
    if len(set(got["toxic"])) < 2:
        return terms, Index(examples, weight)
    held = spark.sparkContext.broadcast((examples, got["part"], idf))
    crossed = spark.range(FOLDS_OUT, numPartitions=FOLDS_OUT).mapInArrow(_cross(held), "row int, share double").toArrow()
    share = np.zeros(len(examples))
    share[crossed["row"].to_numpy()] = crossed["share"].to_numpy()
    counts = {r[0]: r[1] for r in learnable.groupBy("toxic").count().collect()}
    stands = np.array([counts[y] / max(1, (toxic == y).sum()) for y in (0, 1)])
    return terms, Index(examples, weight, curve(share, toxic, stands[toxic]))


def score_toxicity(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (doc_ids of the nearest examples), evidence_cosine of each row."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    terms, fitted = fit(d, labels, per_label)
    vocabulary, index = (d.sparkSession.sparkContext.broadcast(x) for x in (terms, fitted))

    def run(batches):
        for batch in by_bytes(batches, 2 << 20):
            got = index.value.shares(*features(vocabulary.value, batch.column(1)))
            score = index.value.calibrated(np.array([g[0] for g in got]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score, pa.float64()), pa.array([g[1] for g in got], pa.list_(pa.int64())), pa.array([g[2] for g in got], pa.list_(pa.float64()))],
                names=["doc_id", "score", "evidence", "evidence_cosine"],
            )

    scored = d.mapInArrow(run, "doc_id long, score double, evidence array<long>, evidence_cosine array<double>")
    return scored.select("doc_id", F.coalesce(fold() == HELD, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"), "evidence", "evidence_cosine")


def op9_toxicity(spark, sf_dir):
    return score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {"op9_toxicity": op9_toxicity}
ORACLE_SQL: dict[str, str] = {}
