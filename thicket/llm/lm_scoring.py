"""Language-model scoring by cross-entropy difference.

Two models of one order, one smoothing and one vocabulary score each document: one of target text, one of the
background, which is every document. A document's score is the mean difference of its words' losses in bits: below 0 it
is more like the target than like the corpus.

`score_words`, which the query runs, counts words (runs of bytes other than white space, A-Z lower-cased, by 64-bit hash) and
pairs of neighbouring words over all documents, without pruning or a closed vocabulary: the table grows with the corpus. It
stays distributed. Documents are dealt to chunks by hash of doc_id; a chunk counts its words and pairs and sends the counts to
parts by hash of word or pair (as arrays, one row for each chunk and part; 48 bits of hash besides the part). A part adds them
up and sends each chunk the totals, in the order of its keys. Chunks and parts grow in number with the corpus. Pairs are interpolated with words, and words with their spelling, by SMOOTH pseudo-counts; so a word that a
model never saw still has a loss. A word's last place in a text counts as a context too (what follows is the text's end,
which is not scored).

Spelling, and `score_documents`, is by 4-grams over 40 classes of bytes (letters, capitals, digits, kinds of white space and
marks, parts of longer code points): 40^4 cells, whose loss tables are broadcast (2 x 10 MB). Each order is interpolated with
the one below by SMOOTH pseudo-counts, the lowest with the uniform distribution.

The target is every document that is labelled with the wanted quality. Its doc_ids are broadcast as sorted numbers of 8 bytes
if there are BROADCAST_IDS at most; beyond that they are joined to the documents, whose texts are then shuffled twice more.
Null text counts as empty; a text without words has 0 tokens and null losses. Without target rows both losses still exist: the
target model is then uniform. An empty table gives an empty result; further columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm._common import read
from thicket.llm._text import SPACE, by_bytes, mix, texts, word_hashes

K, ORDER, SMOOTH, BROADCAST_IDS = 40, 4, 10.0, 1 << 23
CELLS = K**ORDER
CHUNK_BYTES, LEAST_CHUNKS = 4 << 20, 512
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BEGIN = np.uint64(0x5851F42D4C957F2D)  # the word before a text's first
CLASS = np.full(256, 34, np.uint8)
CLASS[97:123] = np.arange(26)
CLASS[65:91] = 26
CLASS[48:58] = 27
CLASS[[0x20, 0x09]] = 28
CLASS[[0x0A, 0x0B, 0x0C, 0x0D]] = 29
CLASS[ord(".")], CLASS[ord(",")] = 30, 31
CLASS[[*map(ord, "!?;:")]] = 32
CLASS[[*map(ord, "'\"-()[]{}")]] = 33
CLASS[0xC0:] = 35
CLASS[0x80:0xC0] = 36 + np.arange(64) % 4
START = 29
COUNTS = "cell int, background long, target long"
SCORES = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


def cells(offs: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram of every byte, whose context before a text's start is line ends, and the tokens of each text."""
    sizes = np.diff(offs)
    total, n, pad = int(sizes.sum()), len(sizes), ORDER - 1
    at = np.arange(total) + np.repeat(pad * np.arange(1, n + 1), sizes)
    s = np.full(total + pad * n, START, np.int32)
    s[at] = CLASS[data[offs[0] : offs[-1]]]
    code = s[at]
    for back in range(1, ORDER):
        code += s[at - back] * np.int32(K**back)
    return code, sizes


def _ends(offs: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Whether each byte is a word's last."""
    word = ~SPACE[data[offs[0] : offs[-1]]]
    last = word.copy()
    last[:-1] &= ~word[1:]
    edges = (offs[1:] - offs[0])[np.diff(offs) > 0] - 1
    last[edges] = word[edges]
    return last


def _wanted(rows: pa.Table | pa.RecordBatch, ids) -> np.ndarray:
    """Whether each row is of the target: by its own column, or by the broadcast doc_ids."""
    if ids is None:
        return np.asarray(rows["wanted"].to_numpy(zero_copy_only=False) if isinstance(rows, pa.RecordBatch) else rows["wanted"].to_numpy(), bool)
    known, column = ids.value, rows["doc_id"]
    if not len(known):
        return np.zeros(len(column), bool)
    x = np.asarray(column.fill_null(0))
    return (known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x) & np.asarray(column.is_valid())


def _count(ids):
    """Each cell's counts, and those of words as cell -1."""

    def run(batches):
        both, total = np.zeros((2, CELLS), np.int64), np.zeros(2, np.int64)
        for batch in by_bytes(batches, 2 << 20):
            offs, data = texts(batch["text"])
            code, sizes = cells(offs, data)
            wanted, last = np.repeat(_wanted(batch, ids), sizes), _ends(offs, data)
            for row, own in ((0, slice(None)), (1, wanted)):
                both[row] += np.bincount(code[own], minlength=CELLS)
                total[row] += np.count_nonzero(last[own])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), *(pa.array([x]) for x in total)], names=["cell", "background", "target"])
        found = np.flatnonzero(both[0])
        for k in range(0, len(found), 100_000):
            part = found[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(both[0, part]), pa.array(both[1, part])], names=["cell", "background", "target"])

    return run


def losses(counts: np.ndarray) -> np.ndarray:
    """Bits of each cell's last token after its others."""
    p = np.full(1, 1.0 / K)
    for order in range(1, ORDER + 1):
        c = counts.reshape(-1, K**order).sum(0).reshape(-1, K).astype(np.float64)
        lower = np.tile(p.reshape(-1, K), (c.shape[0] // max(1, p.size // K), 1)) if order > 1 else np.full((1, K), 1.0 / K)
        p = ((c + SMOOTH * lower) / (c.sum(1, keepdims=True) + SMOOTH)).ravel()
    return (-np.log2(p)).astype(np.float32)


def _score(tables):
    def run(batches):
        loss = tables.value
        for batch in by_bytes(batches, 2 << 20):
            offs, data = texts(batch.column(1))
            code, sizes = cells(offs, data)
            of = np.repeat(np.arange(len(sizes)), sizes)
            n = np.maximum(sizes, 1)
            t, b = (np.bincount(of, weights=loss[k][code], minlength=len(sizes)) / n for k in (1, 0))
            none = sizes == 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), *[pa.array(x, mask=none) for x in (t, b, t - b)]],
                names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"],
            )

    return run


def marked(docs: DataFrame, target_ids: DataFrame, most: int = BROADCAST_IDS) -> tuple:
    """docs as doc_id and text, and the broadcast doc_ids of the target; or with a column `wanted`, and None, if they are more than `most`."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = target_ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    if ids.count() <= most:
        return d, docs.sparkSession.sparkContext.broadcast(np.sort(ids.toArrow()["doc_id"].to_numpy()))
    key = F.coalesce("doc_id", F.xxhash64("text"))  # rows without a doc_id are no hot key
    d = d.withColumn("key", key).join(ids.select(F.col("doc_id").alias("key"), F.lit(True).alias("wanted")), "key", "left")
    return d.select("doc_id", "text", (F.col("doc_id").isNotNull() & F.coalesce("wanted", F.lit(False))).alias("wanted")), None


def count_cells(d: DataFrame, ids) -> tuple[np.ndarray, np.ndarray]:
    """Counts [background, target] of each cell, and of words, over all rows. d, ids: as marked() gives them."""
    got = d.mapInArrow(_count(ids), COUNTS).groupBy("cell").agg(F.sum("background").alias("background"), F.sum("target").alias("target")).toArrow()
    cell, counts = got["cell"].to_numpy(), np.stack([got[x].to_numpy() for x in ("background", "target")])
    both = np.zeros((2, CELLS), np.int64)
    both[:, cell[cell >= 0]] = counts[:, cell >= 0]
    return both, counts[:, cell < 0].sum(1)


def score_documents(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score of each row."""
    d, ids = marked(docs, target_ids)
    tables = docs.sparkSession.sparkContext.broadcast(np.stack([losses(c) for c in count_cells(d, ids)[0]]))
    return d.select("doc_id", "text").mapInArrow(_score(tables), SCORES)


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word and of its pair with the word before, its text, and where it ends in the column's bytes."""
    offs, data = texts(column)
    parts = [(h, of + first) for first, _n, h, of in word_hashes(offs, data)]
    h = np.concatenate([x[0] for x in parts] or [np.zeros(0, np.uint64)])
    of = np.concatenate([x[1] for x in parts] or [np.zeros(0, np.int64)])
    before = np.append(_BEGIN, h[:-1])[: len(h)]
    before[np.append(True, of[1:] != of[:-1])[: len(of)]] = _BEGIN
    return h, mix(before * _ODD + h), of, np.flatnonzero(_ends(offs, data)) + 1


def _own(column: pa.Array, wanted: np.ndarray, parts: int):
    """words() of a chunk with keys for hashes (part and 48 bits), the key of each word's context, and each key's counts."""
    h, pair, of, end = words(column)
    first = np.append(True, of[1:] != of[:-1])[: len(of)]
    before = np.append(_BEGIN, h[:-1])[: len(h)]
    before[first] = _BEGIN
    one, two, context = (x & np.uint64((1 << 48) - 1) | (x >> np.uint64(48)) % np.uint64(parts) << np.uint64(48) for x in (h, pair, before))
    key = np.concatenate([one, two, context[first]])
    target = wanted[np.concatenate([of, of, of[first]])]
    found, place = np.unique(key, return_inverse=True)
    counts = np.stack([np.bincount(place, minlength=len(found)), np.bincount(place, weights=target, minlength=len(found))]).astype(np.int64)
    return one, two, context, of, end, first, found, counts


def _planes(x: np.ndarray, size: int = 8) -> bytes:
    """The first `size` bytes of each number, all first bytes first: what is alike lies together and compresses."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def _numbers(data: bytes, size: int = 8) -> np.ndarray:
    out = np.zeros((len(data) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8).reshape(size, -1).T
    return out.reshape(-1).view("<u8")


def _packed(rows: list) -> pa.Table:
    """rows: (chunk, part, ascending keys, background, target). Keys as the steps between their 48 bits, counts compressed."""
    low, codec = np.uint64((1 << 48) - 1), pa.Codec("zstd", 1)
    return pa.table([
        *[pa.array([x[k] for x in rows], pa.int32()) for k in (0, 1)],
        pa.array([_planes(np.diff(x[2] & low, prepend=np.uint64(0)), 6) for x in rows], pa.binary()),
        *[pa.array([codec.compress(_planes(x[k]), asbytes=True) for x in rows], pa.binary()) for k in (3, 4)],
    ], names=["chunk", "part", "keys", "background", "target"])


def _counts(data: bytes, n: int) -> np.ndarray:
    """The n counts that _packed() compressed."""
    return _numbers(pa.Codec("zstd").decompress(data, 8 * n, asbytes=True)).astype(np.int64)


def _ask(parts: int, ids):
    def run(table: pa.Table) -> pa.Table:
        *_, found, counts = _own(table["text"].combine_chunks(), _wanted(table, ids), parts)
        chunk, bounds = table["chunk"][0].as_py(), np.searchsorted(found >> np.uint64(48), np.arange(parts + 1))
        return _packed([(chunk, k, found[i:j], counts[0, i:j], counts[1, i:j]) for k, (i, j) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if j > i])

    return run


def _add(table: pa.Table) -> pa.Table:
    part, chunks = table["part"][0].as_py(), table["chunk"].to_pylist()
    keys = [np.cumsum(_numbers(x, 6)) for x in table["keys"].to_pylist()]
    bounds = np.cumsum([0, *map(len, keys)])
    found, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = []
    for name in ("background", "target"):
        own = np.concatenate([_counts(x, len(k)) for x, k in zip(table[name].to_pylist(), keys, strict=True)])
        total.append(np.bincount(place, weights=own, minlength=len(found)).astype(np.int64)[place])
    return _packed([(chunk, part, found[:0], total[0][i:j], total[1][i:j]) for chunk, i, j in zip(chunks, bounds[:-1], bounds[1:], strict=True)])


def _answer(tables, totals, parts: int, ids):
    def run(docs: pa.Table, sent: pa.Table) -> pa.Table:
        n, column = len(docs), docs["text"].combine_chunks()
        one, two, context, of, end, first, found, counts = _own(column, _wanted(docs, ids), parts)
        bounds = np.searchsorted(found >> np.uint64(48), np.arange(parts + 1))
        for part, *c in zip(*(sent[x].to_pylist() for x in ("part", "background", "target")), strict=True):
            i, j = bounds[part : part + 2]
            counts[:, i:j] = [_counts(x, j - i) for x in c]
        offs, data = texts(column)
        code, _sizes = cells(offs, data)
        begin = np.append(0, end[:-1])[: len(end)]
        begin[first] = (offs[:-1] - offs[0])[of[first]]
        at, place, context = (np.searchsorted(found, x) for x in (one, two, context))
        size, out = np.bincount(of, minlength=n), []
        for row in (1, 0):
            c = counts[row].astype(float)
            bits = np.append(0.0, np.cumsum(tables.value[row][code], dtype=np.float64))
            spelt = np.exp2(bits[begin] - bits[end])
            p = (c[at] + SMOOTH * spelt) / (totals[row] + SMOOTH)
            p = (c[place] + SMOOTH * p) / (c[context] + SMOOTH)
            out.append(np.bincount(of, weights=-np.log2(np.maximum(p, 1e-300)), minlength=n) / np.maximum(size, 1))
        none = size == 0
        return pa.table([docs["doc_id"], pa.array(size), *[pa.array(x, mask=none) for x in (*out, out[0] - out[1])]], names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    return run


def score_words(docs: DataFrame, target_ids: DataFrame, least_chunks: int = LEAST_CHUNKS, most_ids: int = BROADCAST_IDS) -> DataFrame:
    """doc_id, n_tokens (words), target_loss, background_loss, score of each row. target_ids: doc_ids of the target, any number."""
    d, ids = marked(docs, target_ids, most_ids)
    both, sums = count_cells(d, ids)
    tables = docs.sparkSession.sparkContext.broadcast(np.stack([losses(c) for c in both]))
    chunks = max(least_chunks, int(both[0].sum()) // CHUNK_BYTES)
    d = d.withColumn("text", F.coalesce("text", F.lit("")))
    d = d.withColumn("chunk", F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))), F.lit(chunks)).cast("int"))
    parts = min(1 << 16, 1 << max(0, chunks.bit_length() - 2))
    packed = "chunk int, part int, keys binary, background binary, target binary"
    groups = d.groupBy("chunk")  # dealt once, read twice
    totals = groups.applyInArrow(_ask(parts, ids), packed).groupBy("part").applyInArrow(_add, packed)
    return groups.cogroup(totals.groupBy("chunk")).applyInArrow(_answer(tables, sums, parts, ids), SCORES)


def target_ids(labels: DataFrame) -> DataFrame:
    """doc_ids of all rows of the wanted quality, each once."""
    return labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()


def op2_lm_scoring(spark, sf_dir):
    return score_words(read(spark, sf_dir, "documents"), target_ids(read(spark, sf_dir, "labels")))


QUERIES = {"op2_lm_scoring": op2_lm_scoring}
ORACLE_SQL: dict[str, str] = {}
