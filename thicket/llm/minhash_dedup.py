"""Near-duplicates by one-permutation MinHash, banded buckets and star-shaped candidate edges.

A text's set of word shingles is hashed once; the hash range is split into ROWS * BANDS bins and each bin keeps its least
hash. Empty bins are filled by optimal densification: bin i takes the value of the first filled bin in a random order of
its own. ROWS neighbouring bins make a band, and sets that agree on a band meet in a bucket. Two sets with a similarity of
0.8 miss each other in all 32 bands of 5 with a chance of 3 in a million.

Equal sets are one class from the start, so copies never make pairs. In a bucket, edges go from its centre (the class that
meets most others over all its bands, so the original of a family of copies) to the rest: a star. Edges are confirmed on
full sets, confirmed ones are joined to components, and a bucket whose classes are then in one component is closed.

What is left in open buckets, as texts around one common passage are, is dealt anew by an exact rule. Put all shingles in
one order, rare before frequent; then two sets of at least that similarity share a shingle among the first n - ceil(0.8 n)
+ 1 of each, and the first one that they share leaves enough behind it in both. A class goes to a bucket for each of its
first shingles, and only pairs of different components with room for the overlap behind the shared one become edges: texts
with a passage in common meet at their own words, not at the passage. Any order is exact; this one goes by counts in CELLS
cells, whose size is fixed. Centres follow in rounds, WIDER times as many in each, until every bucket is closed or has had
every class as centre. There is no cap on buckets or candidates.

Texts without words, and null, have an empty set and are linked with nothing. A null doc_id comes after all others.
Repeated rows of equal text are one class and each gets a row. An empty table gives an empty result; further columns are
ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thicket.llm._common import cut, join_groups, read, unused
from thicket.llm._text import _ODD, by_bytes, mix, shingle_set, texts, words_by_text

BANDS, ROWS = 32, 5
SHINGLE, PERCENT = 5, 80
BINS = BANDS * ROWS
WIDER = 16  # each round takes so many times the centres of all before
CELL_BITS = 22
CELLS = 1 << CELL_BITS
ROWS_PER_PART = 50_000  # of bucket rows, for the small tables between rounds
ROWS_PER_SALT = 256
MARK_BITS = 24
_EDGES = (np.arange(BINS + 1, dtype=object) * 2**64 // BINS)
_LOW = np.array([int(x) for x in _EDGES[:-1]], np.uint64)
_TOP = np.array([int(x) - 1 for x in _EDGES[1:]], np.uint64)
_rng = np.random.default_rng(7)
_TURN = np.argsort(_rng.random((BINS, BINS)), axis=1)
_BAND = _rng.integers(0, 2**63, BANDS, dtype=np.uint64)
SIGNED = "doc_id long, text_key long, n_shingles long, sid binary, bands array<long>"


def signature(s: np.ndarray) -> np.ndarray:
    """Least hash of each bin of a sorted, non-empty set of hashes, densified."""
    at = np.searchsorted(s, _LOW)
    least = s[np.minimum(at, len(s) - 1)]
    filled = (least >= _LOW) & (least <= _TOP)
    empty = np.flatnonzero(~filled)
    if len(empty):
        turn = _TURN[empty]
        least[empty] = least[turn[np.arange(len(empty)), filled[turn].argmax(1)]]
    return least


def bands(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(BANDS, ROWS)
    h = _BAND.copy()
    for k in range(ROWS):
        h += rows[:, k] * _ODD[k]
    return mix(h).view(np.int64)


def set_id(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _sign(size: int):
    def run(batches):
        for batch in by_bytes(batches, 4 << 20):
            n, sids, found = [], [], []
            for _, words in words_by_text(*texts(batch.column(2))):
                s = shingle_set(words, size)
                n.append(len(s))
                sids.append(set_id(s))
                found.append(bands(signature(s)) if len(s) else np.zeros(0, np.int64))
            offs = np.cumsum([0, *map(len, found)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sids, pa.binary()), lists], names=["doc_id", "text_key", "n_shingles", "sid", "bands"])

    return run


def place_key(place: str, text_key: str) -> Column:
    """A number for a row by its place and text, and so (twins apart) for the row that stands for a class."""
    return F.xxhash64(place, text_key)


def _marks(batches):
    bits = np.zeros(1 << MARK_BITS - 3, np.uint8)
    for batch in batches:
        k = batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - MARK_BITS)
        np.bitwise_or.at(bits, k >> np.uint64(3), np.uint8(1) << (k & np.uint64(7)).astype(np.uint8))
    at = np.flatnonzero(bits)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bits[at].astype(np.int64))], names=["at", "bits"])


def marks(keys: DataFrame) -> np.ndarray:
    """A bit for each of 2^MARK_BITS ranges of keys: whether there is a key in it. Its size is fixed; the more keys, the more
    rows pass it in vain, and none that should pass fails to."""
    got = keys.mapInArrow(_marks, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << MARK_BITS - 3, np.uint8)
    out[got["at"].to_numpy()] = got["bits"].to_numpy()
    return out


def _sets(size: int, marked):
    """Sets of the rows (key, text) whose key is marked, once for each key of a task."""

    def run(batches):
        seen: set[int] = set()
        for batch in by_bytes(batches, 4 << 20):
            keys = batch.column(0).to_numpy()
            k = keys.view(np.uint64) >> np.uint64(64 - MARK_BITS)
            hit = np.flatnonzero(marked.value[k >> np.uint64(3)] >> (k & np.uint64(7)).astype(np.uint8) & 1)
            own = []
            for i in hit.tolist():
                if int(keys[i]) not in seen:
                    seen.add(int(keys[i]))
                    own.append(i)
            if own:
                s = [shingle_set(w, size) for _, w in words_by_text(*texts(batch.column(1).take(pa.array(own))))]
                kinds = (pa.int64(), pa.binary(), pa.binary())
                columns = (keys[own], [set_id(x) for x in s], [x.tobytes() for x in s])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["row_key", "sid", "hashes"])

    return run


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            ok = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (a, b))
                both = np.sort(np.concatenate([a, b]))
                same = int((both[1:] == both[:-1]).sum())
                ok.append(100 * same >= percent * (len(both) - same))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def confirm(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges (a, b) whose sets are similar. Sets are unique, so a centre with many edges makes a skewed join of light
    rows with one set, which adaptive execution may split."""
    one = edges.join(sets.select(F.col("v").alias("b"), F.col("hashes").alias("y")), "b")
    pairs = one.join(sets.select(F.col("v").alias("a"), F.col("hashes").alias("x")), "a")
    return pairs.select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a binary, b binary")


def vertex() -> Column:
    """A class's place and set in one value, which sorts by place."""
    return F.concat(F.unhex(F.lpad(F.hex(F.expr("place ^ shiftleft(1L, 63)")), 16, "0")), F.col("sid"))


def place_of(v: str) -> Column:
    return F.expr(f"cast(conv(hex(substring({v}, 1, 8)), 16, -10) AS bigint) ^ shiftleft(1L, 63)")


def components(links: DataFrame, parts: int) -> DataFrame:
    """v, comp: the least vertex of its component, for each vertex of links (a, b) that isn't the least itself.

    Large-star and small-star in turn: each vertex's larger, then smaller, neighbours are hung on its least one, until
    every component is a star around its least vertex."""
    edges, last = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), None
    by = Window.partitionBy("u")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.withColumn("m", F.least(F.min("v").over(by), "u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        hung = large.withColumn("m", F.min("v").over(by)).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = cut(hung.select("e.*").where("u <> v").distinct().coalesce(parts))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == last:
            return edges.select(F.col("u").alias("v"), F.col("v").alias("comp"))
        last = now


def cell(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _tally(batches):
    times = np.zeros(CELLS, np.int32)
    for batch in batches:
        for x in batch.column(0):
            np.add.at(times, cell(np.frombuffer(x.as_buffer(), np.uint64)), 1)
    found = np.flatnonzero(times)
    for k in range(0, len(found), 100_000):
        part = found[k : k + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(times[part].astype(np.int64))], names=["cell", "times"])


def cell_counts(sets: DataFrame) -> np.ndarray:
    """Number of shingles of all sets in each cell, as far as 32 bits go: CELLS numbers, whatever the input."""
    got = sets.select("hashes").mapInArrow(_tally, "cell long, times long").groupBy("cell").agg(F.sum("times").alias("times")).toArrow()
    out = np.zeros(CELLS, np.int32)
    out[got["cell"].to_numpy()] = np.minimum(got["times"].to_numpy(), (1 << 31) - 1)
    return out


def first_shingles(s: np.ndarray, times: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of the first n - ceil(n * percent / 100) + 1 shingles, rare ones first, that another set may have, and their places."""
    own = times[cell(s)]
    order = np.lexsort((s, own))[: len(s) - -(-len(s) * percent // 100) + 1]
    place = np.flatnonzero(own[order] > 1)
    return s[order[place]].view(np.int64), place + 1


def _first(counts, percent: int):
    def run(batches):
        for batch in batches:
            for part in by_bytes([batch], 1 << 20):
                got = [first_shingles(np.frombuffer(x.as_buffer(), np.uint64), counts.value, percent) for x in part.column(3)]
                row = pa.array(np.repeat(np.arange(part.num_rows), [len(k) for k, _ in got]))
                keys, places = (np.concatenate(x) if got else np.zeros(0, np.int64) for x in zip(*got, strict=True))
                yield pa.RecordBatch.from_arrays([*[part.column(k).take(row) for k in range(3)], pa.array(keys), pa.array(places)], names=["v", "comp", "n", "key", "pos"])

    return run


def several(rows: DataFrame, above: int = 0) -> DataFrame:
    """The rows of buckets in which components meet and, if they have ranks, one is above `above`; rows: checkpointed."""
    last = F.max("rank") if above else F.lit(1)
    groups = rows.groupBy("key").agg(F.count("*").alias("held"), F.min("comp").alias("least"), F.max("comp").alias("most"), last.alias("last"))
    groups = cut(groups.where((F.col("least") != F.col("most")) & (F.col("last") > above)).drop("least", "most", "last"))
    return join_groups(rows, groups, "key", "held")


def ranked(rows: DataFrame) -> DataFrame:
    """rows of several(), with a rank of their own in their bucket, large sets before small ones by and large.

    A bucket is dealt to `salts` salts of some ROWS_PER_SALT rows; ranks run in turn through its salts."""
    salted = rows.withColumn("salts", F.ceil(F.col("held") / ROWS_PER_SALT).cast("int")).withColumn("salt", F.pmod(F.xxhash64("v"), F.col("salts")).cast("int"))
    own = F.row_number().over(Window.partitionBy("key", "salt").orderBy(F.desc("n"), "v"))
    return salted.withColumn("rank", ((own - 1) * F.col("salts") + F.col("salt") + 1).cast("long")).drop("held")


def classes_with_components(docs: DataFrame, signed: DataFrame, size: int, percent: int) -> DataFrame:
    """sid, rows, component (least place) of each class of equal non-empty sets."""
    spark, big = docs.sparkSession, F.lit((1 << 63) - 1).cast("long")
    classes = cut(
        signed.where("n_shingles > 0")
        .groupBy("sid")
        .agg(
            F.count("*").alias("rows"), F.min(F.struct(F.coalesce("doc_id", big).alias("place"), "text_key")).alias("least"),
            F.first("n_shingles").alias("n"), F.first("bands").alias("bands"),
        )
        .select("sid", "rows", "least.place", "least.text_key", "n", "bands")
        .withColumn("v", vertex())
    )
    met = classes.select("v", "n", place_key("place", "text_key").alias("row_key"), F.explode("bands").alias("key"))
    buckets = cut(met.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"))
    by_v = Window.partitionBy("v")  # BANDS rows at most
    rows = join_groups(met, buckets, "key", "members").withColumns({"degree": F.sum("members").over(by_v), "nth": F.row_number().over(by_v.orderBy("key"))})
    rows = cut(rows)
    found = rows.count()
    if not found:
        return classes.select("sid", "rows", F.col("place").alias("component"))
    # the centre: by degree over all bands, so of two classes the same one leads in every bucket
    centres = rows.groupBy("key").agg(F.min(F.struct((-F.col("degree")).alias("d"), "v", "n")).alias("c"), F.count("*").alias("held"))
    centres = cut(centres.select("key", "held", F.col("c.v").alias("a"), F.col("c.n").alias("m")))
    parts = max(8, found // ROWS_PER_PART)
    wanted = cut(rows.where("nth = 1").select("v", "row_key", F.substring("v", 9, 16).alias("sid")))
    marked = spark.sparkContext.broadcast(marks(wanted.select("row_key")))
    keyed = docs.select(F.coalesce("doc_id", big).alias("place"), F.xxhash64("text").alias("text_key"), "text").select(place_key("place", "text_key").alias("row_key"), "text")
    taken = keyed.mapInArrow(_sets(size, marked), "row_key long, sid binary, hashes binary")
    sets = cut(taken.join(wanted, ["row_key", "sid"]).select("v", "hashes").dropDuplicates(["v"]))
    fits = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
    edges = join_groups(rows, centres, "key", "held").where((F.col("a") != F.col("v")) & fits).select("a", F.col("v").alias("b"))
    labels = None

    def joined(labels: DataFrame | None, edges: DataFrame) -> DataFrame | None:
        good = cut(confirm(cut(edges.distinct().coalesce(parts)), sets, percent))
        if good.isEmpty():
            return labels
        return components(good if labels is None else good.unionByName(labels.select(F.col("v").alias("a"), F.col("comp").alias("b"))), parts)

    def labelled(rows: DataFrame) -> DataFrame:
        return cut(rows.withColumn("comp", F.col("v")) if labels is None else rows.join(labels, "v", "left").withColumn("comp", F.coalesce("comp", "v")))

    labels = joined(labels, edges)
    held = cut(several(labelled(rows.where("members > 2").select("key", "v", "n"))).select("v", "comp", "n").distinct().join(sets, "v"))
    if not held.isEmpty():
        counts = spark.sparkContext.broadcast(cell_counts(held))
        firsts = cut(held.select("v", "comp", "n", "hashes").mapInArrow(_first(counts, percent), "v binary, comp binary, n long, key long, pos long"))
        wide = F.lit(float(np.log(max(1.05, 100 / percent * 1.0001))))
        length = lambda n: F.floor(F.log(F.col(n)) / wide)  # noqa: E731  two similar sets are in one class of lengths or in neighbouring ones
        open_rows, low, high = cut(ranked(several(firsts)).withColumn("length", length("n"))), 1, 2
        room = 1 + F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("at"))
        near = fits & (room * (100 + percent) >= (F.col("n") + F.col("m")) * percent)
        while not open_rows.isEmpty():
            centre = open_rows.where((F.col("rank") >= low) & (F.col("rank") < high)).select("key", F.col("v").alias("a"), F.col("n").alias("m"), F.col("comp").alias("c"), F.col("rank").alias("r"), F.col("pos").alias("at"), "length")
            centre = centre.withColumn("length", F.explode(F.array(*[F.col("length") + k for k in (-1, 0, 1)])))
            edges = centre.join(open_rows, ["key", "length"]).where((F.col("rank") > F.col("r")) & (F.col("c") != F.col("comp")) & near).select("a", F.col("v").alias("b"))
            labels = joined(labels, edges)
            open_rows, low, high = cut(several(labelled(open_rows.drop("comp")), high).drop("held").coalesce(parts)), high, high * WIDER
    if labels is None:
        return classes.select("sid", "rows", F.col("place").alias("component"))
    return classes.select("sid", "rows", "v", "place").join(labels, "v", "left").select("sid", "rows", F.coalesce(place_of("comp"), "place").alias("component"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id (least doc_id reachable by links), kept, of each row."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = cut(d.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(_sign(size), SIGNED))
    found = cut(classes_with_components(d, signed, size, percent))
    rows = signed.select("doc_id", "text_key", "n_shingles", "sid")
    joined = join_groups(rows.where("n_shingles > 0"), found, "sid", "rows").select("doc_id", "text_key", "n_shingles", F.when(F.col("component") < (1 << 63) - 1, F.col("component")).alias("component_id"))
    alone = rows.where("n_shingles = 0").select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that stay, one of each component, with the columns of docs."""
    stay = cut(near_duplicates(docs, size, percent).where("kept").groupBy("doc_id", "text_key").agg(F.count("*").alias("times")))
    again, key = not stay.where("times > 1").isEmpty(), unused(docs, "_key")
    d = docs.withColumn(key, F.xxhash64("text")).alias("d")
    s = stay.alias("s")
    out = d.join(s, F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col(f"d.{key}") == F.col("s.text_key")), "left_semi")
    return (out.dropDuplicates(["doc_id", key]) if again else out).drop(key)


def op7_minhash_dedup(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "documents"), size=2).drop("text_key")


QUERIES = {"op7_minhash_dedup": op7_minhash_dedup}
ORACLE_SQL = {
    # all pairs that share a shingle, by their full sets: for small tables
    "op7_minhash_dedup": r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
q AS (SELECT r, doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM d),
u AS (SELECT r, len(s) AS n, unnest(s) AS sh FROM q),
l AS (SELECT a.r AS a, b.r AS b FROM u a JOIN u b ON a.sh = b.sh AND a.r < b.r AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT r, doc_id AS c FROM q UNION SELECT e.b, c.c FROM c JOIN e ON e.a = c.r),
m AS (SELECT r, min(c) AS component_id FROM c GROUP BY r)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM q JOIN m USING (r)"""
}
