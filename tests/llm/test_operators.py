"""The text operators on small tables with nulls, empty and long texts, ties, repeated rows and extra columns, against
brute force."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from thicket.llm import _text, best_fit_packing, chat_format, exact_dedup, language_id, lm_scoring, minhash_dedup, mixing, sketches, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, rank int, bucket int, sid string, kept boolean"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows(texts, ids=None, langs=None, sources=None):
    n = len(texts)
    ids = list(range(n)) if ids is None else ids
    return [(ids[i], texts[i], langs[i] if langs else "en", sources[i] if sources else f"s{i % 3}", None, 1, 2, 3, "x", True) for i in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    r = random.Random(3)
    words = ["".join(r.choice("abcdefg") for _ in range(r.randint(1, 6))) for _ in range(300)]
    base = [" ".join(r.choice(words) for _ in range(r.randint(30, 90))) for _ in range(12)]
    texts = [None, "", " \n\t", "one", "ONE", "one two", *base]
    for b in base[:5]:
        w = b.split()
        for k in range(6):
            c = list(w)
            c[r.randrange(len(c))] = f"new{k}"
            texts.append(" ".join(c))
        texts += [b.upper(), b]
    texts += ["x" * 30_000, " ".join(r.choice(words) for _ in range(20_000)), "é ñ ß 漢字 🙂 " * 5, None]
    ids = list(range(len(texts)))
    ids[-1] = None
    ids[7] = ids[8]  # two texts of one doc_id
    data = rows(texts, ids)
    data.append(data[10])  # a repeated row
    return spark.createDataFrame(data, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_words_match_a_regular_expression():
    r = random.Random(1)
    texts = ["", " ", "a", " a  b\n", "É x\u00a0y \x0b z", None, "q" * 50] + ["".join(r.choice("ab \n\tÉ") for _ in range(r.randint(0, 60))) for _ in range(200)]
    long = " ".join(r.choice(["aa", "b", "cc"]) for _ in range(5000))
    known = {}
    old, _text.SLICE = _text.SLICE, 64
    try:
        got = dict(_text.words_by_text(*_text.texts(pa.array([*texts, long]))))
    finally:
        _text.SLICE = old
    for i, t in enumerate([*texts, long]):
        words = WORD.findall((t or "").translate(AZ))
        assert len(words) == len(got[i])
        for w, h in zip(words, got[i].tolist(), strict=True):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


def shingles(text, size):
    w = WORD.findall((text or "").translate(AZ))
    return set(zip(*[w[k:] for k in range(size)], strict=False)) if len(w) >= size else ({tuple(w)} if w else set())


def brute_components(data, size, percent=80):
    """(doc_id, text) rows -> least doc_id reachable, by row."""
    sets = [shingles(t, size) for _, t in data]
    parent = list(range(len(data)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(data)):
        for b in range(a + 1, len(data)):
            if sets[a] and sets[b]:
                same = len(sets[a] & sets[b])
                if 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
                    parent[find(a)] = find(b)
    least = defaultdict(lambda: None)
    for i, (d, _) in enumerate(data):
        if d is not None and (least[find(i)] is None or d < least[find(i)]):
            least[find(i)] = d
    return [least[find(i)] if sets[i] else data[i][0] for i in range(len(data))]


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(odd, size):
    data = [(r["doc_id"], r["text"]) for r in odd.collect()]
    want = Counter((d, c, len(shingles(t, size))) for (d, t), c in zip(data, brute_components(data, size), strict=True))
    got = Counter((r["doc_id"], r["component_id"], r["n_shingles"]) for r in minhash_dedup.near_duplicates(odd, size).collect())
    assert got == want


def test_near_duplicates_of_a_family_whose_copies_differ_from_each_other(spark):
    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(200)]
    texts = []
    for _ in range(60):
        c = list(base)
        for k in r.sample(range(200), 9):
            c[k] = f"z{r.randrange(10**9)}"
        texts.append(" ".join(c))
    texts.insert(40, " ".join(base))
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows(texts), DOCS), 2).collect()
    want = brute_components(list(enumerate(texts)), 2)
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(want))


def test_signature_agrees_as_often_as_the_sets():
    r = np.random.default_rng(2)
    for n in (3, 40, 3000):
        common = r.integers(0, 2**63, n * 4, dtype=np.uint64)
        a, b = (np.unique(np.append(common, r.integers(0, 2**63, n // 2, dtype=np.uint64))) for _ in range(2))
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        same = np.mean(minhash_dedup.signature(a) == minhash_dedup.signature(b))
        assert abs(same - j) < 0.15


def test_keep_one_keeps_columns_and_one_of_each(odd):
    got = minhash_dedup.keep_one(odd, 5)
    assert got.columns == odd.columns
    kept = got.collect()
    assert len({(r["doc_id"], r["text"]) for r in kept}) == len(kept)


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_dedup(odd, bits):
    data = [(r["doc_id"], (r["text"] or "").translate(AZ)) for r in odd.collect()]
    groups = defaultdict(list)
    for d, t in data:
        groups[t].append(d)
    best = {t: max((d for d in ds if d is not None), default=None) for t, ds in groups.items()}
    want = Counter((d, best[t], len(groups[t]), d == best[t], hashlib.sha256(t.encode()).hexdigest()) for d, t in data)
    got = Counter(map(tuple, exact_dedup.exact_dedup(odd, id_bits=bits).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()))
    assert got == want


def test_exact_keep_one(odd):
    got = exact_dedup.keep_one(odd).collect()
    texts = [(r["text"] or "").translate(AZ) for r in got]
    assert sorted(texts) == sorted({(r["text"] or "").translate(AZ) for r in odd.collect()})


def test_chunks_depend_on_content_alone():
    r = np.random.default_rng(1)
    body = r.integers(97, 123, 60_000).astype(np.uint8)
    cut = lambda b: {bytes(b[a:z]) for a, z in exact_dedup.chunks(0, len(b), exact_dedup.breaks(b))}
    one, other = cut(body), cut(np.concatenate([np.full(1000, 120, np.uint8), body]))
    assert len(one & other) > 0.8 * len(one)
    assert all(len(c) <= exact_dedup.MOST for c in one)
    parts = exact_dedup.chunks(5, 60_000, exact_dedup.breaks(body))
    assert parts[0][0] == 5 and parts[-1][1] == 60_000 and all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))


def test_mixing_takes_targets(odd):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count()
    by = defaultdict(lambda: [0, None, 0])
    for r in got:
        k = by[r["source_size"], r["target"]]
        k[0] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    for (size, target), (taken, _, _) in by.items():
        assert abs(taken - target) <= 1 and target <= 2 * size + 1e-9
    total = sum(s for s, _ in by)
    assert abs(sum(t for _, t in by) - 1.5 * total) < 1e-6 * total
    assert Counter(got) == Counter(mixing.mix(odd.repartition(3)).collect())


def test_mixing_schedule_and_resample(spark):
    d = spark.createDataFrame(rows([f"w{i} " * (i % 7 + 1) for i in range(60)], sources=[None if i % 4 == 0 else f"s{i % 4}" for i in range(60)]), DOCS)
    m = {r["doc_id"]: r["taken"] for r in mixing.mix(d).collect()}
    s = mixing.schedule(d).collect()
    words = Counter()
    for r in s:
        words[r["doc_id"]] += r["words"]
    assert {k: v for k, v in m.items() if v} == dict(words)
    assert [r["finish"] for r in s] == sorted(r["finish"] for r in s)
    again = Counter(r["doc_id"] for r in mixing.resample(d).collect())
    assert again == Counter({k: int(v / (k % 7 + 1) + 0.5) for k, v in m.items() if int(v / (k % 7 + 1) + 0.5)})


def test_mixing_is_a_queue_served_in_order_of_finish(spark):
    """Against one loop over all documents of all passes; few ranges, so that each holds several of them."""
    r = random.Random(5)
    texts = ["w " * r.choice([0, 1, 1, 2, 5, 40, 700]) for _ in range(300)]
    sources = [r.choice(["a", "b", "b", "b", "c", None]) for _ in texts]
    d = spark.createDataFrame(rows(texts, sources=sources), DOCS)
    old, mixing.LEAST_RANGES = mixing.LEAST_RANGES, 7
    try:
        got = mixing.schedule(d).collect()
        whole = {x["doc_id"]: x for x in mixing.mix(d).collect()}
    finally:
        mixing.LEAST_RANGES = old
    queue, done = [], Counter()
    for i, x in whole.items():
        for n in range(2):
            a = x["start"] + n * x["source_size"]
            goal = int(x["target"])
            cuts = [a, goal, a + x["size"]] if a < goal < a + x["size"] else [a, a + x["size"]]
            queue += [(z / x["target"], x["source"] is None, x["source"] or "", y, i, n, z - y) for y, z in zip(cuts, cuts[1:], strict=False) if z > y]
    budget, at, want = sum(int(t) for t in {(x["source"], x["target"]): x["target"] for x in whole.values()}.values()), 0, []
    for finish, _, _, _, i, n, words in sorted(queue):
        if at < budget:
            want.append((i, n, finish, at, min(words, budget - at)))
            done[i] += want[-1][-1]
        at += words
    assert [tuple(x) for x in got] == want
    assert all(x["taken"] == done[i] for i, x in whole.items())


def test_mixing_shares_among_rows_that_look_alike(spark):
    texts = [*["a b c"] * 400, *["d e f"] * 100, "x y", "x y"]
    d = spark.createDataFrame(rows(texts, ids=[1] * 500 + [2, 2], sources=["s"] * 400 + ["t"] * 100 + ["u", "v"]), DOCS)
    took = Counter()
    for x in mixing.mix(d).collect():
        took[x["source"]] += x["taken"]
    got = Counter(x["source"] for x in mixing.resample(d).collect())
    for source, words in (("s", 3), ("t", 3), ("u", 2), ("v", 2)):
        assert abs(got[source] * words - took[source]) <= 0.15 * took[source] + words


def brute_rule(host, path, rules):
    fits = [(len(r), len(r.partition("/")[0]), r, v) for r, v in rules if r for h, slash, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith(slash + p)]
    return max(fits)[2:] if fits else (None, None)


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "http://NET", "https://a.net/x", "https://a.example.net/en/q?x#y", "http://example.com/de/1", "http://x.org/fr/", "http://example.org?x=/fr/", "http://notnet/", "ftp://b.c.net#z", "a://b://c.net/"]
    r = random.Random(2)
    for _ in range(300):
        urls.append(f"http://{'.'.join(r.choice(['a', 'b', 'ab', 'net', 'org']) for _ in range(r.randint(1, 4)))}/{r.choice(['', 'a', 'ab/', 'a/b'])}")
    rules = [*url_filter.RULES, ("a.net", "block"), ("net/a", "allow"), ("b.net/", "block"), ("a.b.net/a", "allow"), ("ab/", "block"), (None, "block")]
    pages = spark.createDataFrame([(i, u, None, "extra", "r") for i, u in enumerate(urls)], "page_id long, url string, html string, host string, rule string")
    got = {x["page_id"]: x for x in url_filter.url_filter(pages, spark.createDataFrame(rules, "rule string, verdict string")).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        at = (u or "").find("://")
        host, path = "", ""
        if at >= 0:
            host, path = re.match(r"([^/?#]*)([^?#]*)", u[at + 3 :]).groups()
        host = host.translate(AZ)
        rule, verdict = brute_rule(host, path, rules)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule, verdict or "allow"), u


def test_chats(spark):
    long = [(1, t, "user", f"u{t}") for t in range(5)]
    data = [*long, *[(2, t, "user", f"u{t}") for t in range(3)], *[(3, t, "user", f"u{t}") for t in range(5)], (4, 0, "user", "u0"), (4, 1, "bot", "other"), (5, 0, None, None), (6, 0, "", ""), (None, 0, "user", "null"), (7, 0, "user", "u0u1"), (8, 1, "user", "same"), (8, 1, "user", "same")]
    d = spark.createDataFrame([(*r, "x") for r in data], "conv_id long, turn long, role string, text string, n string")
    got = {r["conv_id"]: (r["n_turns"], r["copies"], r["rendered"]) for r in chat_format.format_chats(d).collect()}
    assert set(got) == {1, 4, 5, None, 7, 8}
    assert got[1] == (5, 2, "".join(f"<|user|>\nu{t}<|end|>\n" for t in range(5)))
    assert got[5] == (1, 2, "<||>\n<|end|>\n") and got[8][0] == 2


def test_packing(odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = best_fit_packing.pack_documents(odd.where("doc_id <> 8 OR doc_id IS NULL")).collect()
    by_doc, by_sequence = defaultdict(set), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].add((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, text in {(r["doc_id"], r["text"]) for r in odd.where("doc_id <> 8 OR doc_id IS NULL").collect()}:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or 2048
        starts = [0, *range(min(first, len(ids)), len(ids), 2048)] if len(ids) > 2048 else [0]
        ends = [*starts[1:], len(ids)]
        assert by_doc[d] == {(k, a, z - a, zlib.crc32(ids[a:z].tobytes())) for k, (a, z) in enumerate(zip(starts, ends, strict=True))}
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_matched_runs_are_best_fit_decreasing():
    r = random.Random(4)
    for _ in range(30):
        counts = Counter(r.randint(1, 50) for _ in range(r.randint(0, 300)))
        plan = best_fit_packing.matched_runs(counts, 50)
        fill, seen = Counter(), Counter()
        for length, a, z, at, per, offset in plan:
            for k in range(z - a):
                s = at + k // per
                assert fill[s] == offset + (k % per) * length
                fill[s] += length
            seen[length] += z - a
        assert seen == counts and all(v <= 50 for v in fill.values())
        gaps = []
        for length in sorted(counts.elements(), reverse=True):
            fit = [g for g in gaps if g >= length]
            if fit:
                gaps.remove(min(fit))
                gaps.append(min(fit) - length)
            else:
                gaps.append(50 - length)
        assert len(fill) == len(gaps)


def test_special_tokens_and_odd_characters_encode_as_the_tokenizer_does():
    from tokenizers import Tokenizer

    path = best_fit_packing.vocabulary
    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    encode = best_fit_packing.encoder(path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"))
    for text in ("", "a<|endoftext|>b", "\x1c\x85\u2003x  y\n\n", "don't I'LL ½²", "𝒳 汉字 é́", "a" * 3000, " " * 500):
        assert encode(text).tolist() == t.encode(text, add_special_tokens=False).ids


def test_language_id_parses_as_by_hand(spark):
    labelled = {"x": ["abab abab"], "y": ["bcbc cbcb"]}
    m = language_id.Model(labelled)
    text = "abab bcbcbc cab"
    sym, sizes = language_id.symbols(*_text.texts(pa.array([text])))
    for k, lang in enumerate(m.langs):
        train, s, n, at = labelled[lang][0], text, 1, 0
        run = ""
        for c in s:
            if run + c in train:
                run += c
            else:
                n, run = n + 1, c if c in train else ""
        assert m.phrases(sym, sizes)[0, k] == n
        assert at == 0


def test_language_id(spark, none):
    r = random.Random(9)
    syllables = {"aa": ["ka", "lo", "mi"], "bb": ["tre", "sch", "ung"], "cc": ["ció", "ña", "ll"]}
    texts, langs = [], []
    for i in range(90):
        lang = sorted(syllables)[i % 3]
        texts.append(" ".join("".join(r.choice(syllables[lang]) for _ in range(3)) for _ in range(20)))
        langs.append(lang)
    texts += [None, "", "123 !!", "漢字", "lokami", texts[0] * 400]
    langs += [None, "aa", "aa", None, "aa", "aa"]
    d = spark.createDataFrame(rows(texts, langs=langs), DOCS)
    got = {x["doc_id"]: x for x in language_id.identify(d, language_id.train(d)).collect()}
    assert len(got) == len(texts) and all(0 <= x["score"] <= 1 for x in got.values())
    assert [got[i]["lang_pred"] for i in range(90)] == langs[:90]
    assert [got[i]["lang_pred"] for i in (90, 91, 92)] == ["und"] * 3 and got[93]["lang_pred"] != "und" and got[95]["lang_pred"] == "aa"
    kept = language_id.keep_identified(d, language_id.train(d))
    assert kept.columns == d.columns and kept.count() == len(texts) - 3
    empty = language_id.train(none)
    assert {x["lang_pred"] for x in language_id.identify(d, empty).collect()} == {"und"}


def test_lm_scores_match_a_plain_count(spark):
    texts = [None, "", "a", "abc abd", "The cat. The cat!", "zz" * 50, "Été ÇA"]
    d = spark.createDataFrame(rows(texts), DOCS)
    target = spark.createDataFrame([(3,), (4,)], "doc_id long")
    old = lm_scoring.K
    got = {r["doc_id"]: r for r in lm_scoring.score_documents(d, target).collect()}
    classes = {i: [int(lm_scoring.CLASS[b]) for b in (t or "").encode()] for i, t in enumerate(texts)}

    def model(ids):
        counts = Counter()
        for i in ids:
            s = [lm_scoring.START] * 3 + classes[i]
            for k in range(3, len(s)):
                for n in range(4):
                    counts[tuple(s[k - n : k + 1])] += 1
                    counts["c", tuple(s[k - n : k])] += 1

        def loss(context, c):
            p = 1 / old
            for n in range(4):
                h = tuple(context[len(context) - n :]) if n else ()
                p = (counts[(*h, c)] + lm_scoring.SMOOTH * p) / (counts["c", h] + lm_scoring.SMOOTH)
            return -np.log2(p)

        return loss

    for name, loss in (("target_loss", model([3, 4])), ("background_loss", model(range(len(texts))))):
        for i, s in classes.items():
            if not s:
                assert got[i][name] is None and got[i]["n_tokens"] == 0
                continue
            padded = [lm_scoring.START] * 3 + s
            want = np.mean([loss(padded[k - 3 : k], padded[k]) for k in range(3, len(padded))])
            assert got[i][name] == pytest.approx(want, rel=1e-4)


def test_lm_word_scores_match_a_plain_count(spark, none):
    texts = [None, "", " \n", "a", "abc abd abc", "The cat. The cat!", " the cat\tsat  ", "zz " * 50, "\u6f22\u5b57 \u00c9t\u00e9 ABC abd", "the cat sat", "sat cat the"]
    ids = [*range(9), 5, None]
    d = spark.createDataFrame(rows(texts, ids), DOCS)
    found = lm_scoring.score_words(d, spark.createDataFrame([(4,), (6,)], "doc_id long"), 3).collect()
    got = sorted(((x["n_tokens"], x["target_loss"], x["background_loss"]) for x in found), key=repr)
    cls = [[lm_scoring.START] * 3 + [int(lm_scoring.CLASS[b]) for b in (t or "").encode()] for t in texts]

    def losses(own):
        c, g = Counter(), Counter()
        for i in own:
            s = cls[i]
            for k in range(3, len(s)):
                for n in range(4):
                    c[tuple(s[k - n : k + 1])] += 1
                    c["c", tuple(s[k - n : k])] += 1
            w = [None, *(x.translate(AZ) for x in WORD.findall(texts[i] or ""))]
            g["n"] += len(w) - 1
            g[None] += len(w) > 1
            for x, y in zip(w, w[1:], strict=False):
                g[y] += 1
                g[x, y] += 1
        out = []
        for t, s in zip(texts, cls, strict=True):
            at, before, bits = 0, None, []
            for m in WORD.finditer(t or ""):
                end, spelt = len(t[: m.end()].encode()), 1.0
                for k in range(at + 3, end + 3):
                    p = 1 / lm_scoring.K
                    for n in range(4):
                        p = (c[tuple(s[k - n : k + 1])] + 10 * p) / (c["c", tuple(s[k - n : k])] + 10)
                    spelt *= p
                y = m.group().translate(AZ)
                one = (g[y] + 10 * spelt) / (g["n"] + 10)
                bits.append(-np.log2((g[before, y] + 10 * one) / (g[before] + 10)))
                at, before = end, y
            out.append(np.mean(bits) if bits else None)
        return out

    target, background = losses([4, 6]), losses(range(len(texts)))
    want = sorted(((len(WORD.findall(t or "")), a, b) for t, a, b in zip(texts, target, background, strict=True)), key=repr)
    for x, y in zip(got, want, strict=True):
        assert x[0] == y[0] and (x[1:] == y[1:] if y[1] is None else x[1:] == pytest.approx(y[1:], rel=1e-4))
    assert lm_scoring.score_words(none, none.select("doc_id")).count() == 0


def test_lm_query_tells_words_of_the_same_letters_apart(spark, tmp_path):
    """The word order of the target is what differs; capitals, digits and non-Latin words too are words of their own."""
    a, b = "\u043c\u0438\u0440 \u0434\u043e\u043c", "\u0434\u043e\u043c \u043c\u0438\u0440"
    texts = [" ".join([("x " + a + " y") if i % 2 else ("x " + b + " y")] * 20) for i in range(60)]
    d = spark.createDataFrame(rows(texts), DOCS)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {x["doc_id"]: x for x in lm_scoring.op2_lm_scoring(spark, str(tmp_path)).collect()}
    assert all(x["n_tokens"] == 80 for x in got.values())
    assert max(got[i]["score"] for i in range(31, 60, 2)) + 1 < min(got[i]["score"] for i in range(30, 60, 2))


def test_lm_target_is_every_labelled_row(spark, tmp_path):
    """Where all rows are of the wanted quality, target and background are one model, however many rows there are."""
    spark.createDataFrame(rows([f"w{i % 700} x{i} y{i % 9}" for i in range(5000)]), DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(5000)] + [(3, 1, 0), (None, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = lm_scoring.op2_lm_scoring(spark, str(tmp_path)).collect()
    assert len(got) == 5000 and all(x["target_loss"] > 0 and x["score"] == 0 for x in got)


def test_lm_target_too_large_to_broadcast(spark):
    texts = [None, "", "a b", "The cat. The cat!", "zz " * 50, "the cat sat", "sat cat the", "x the cat"]
    d = spark.createDataFrame(rows(texts, [0, 1, 2, 3, 4, 4, None, None]), DOCS)
    target = spark.createDataFrame([(3,), (4,), (4,), (None,), (99,)], "doc_id long")
    few, many = (sorted(lm_scoring.score_words(d, target, 3, most).collect(), key=repr) for most in (100, 2))
    assert few == many and len(few) == len(texts) and any(x["score"] for x in few)


def test_sketches(spark, odd):
    texts = ["", None, "a", "a b c d e f g", " ".join(f"w{i}" for i in range(400)), " ".join(f"w{i}" for i in range(40, 440)), "é" * 9, "x y"]
    ids = [5, 3, 1, 0, 9, 8, None, 2]
    d = spark.createDataFrame(rows(texts, ids), DOCS)
    got = {r["doc_id"]: r for r in sketches.fingerprints(d).collect()}
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    assert len(got) == len(ids)
    for k, i in enumerate(order):
        a, b = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        n = len(a) // 4
        e = a[: len(a) - n] + b[:n]
        r = got[ids[i]]
        assert (r["n_chars"], r["edited_sha256"]) == (len(a), hashlib.sha256(e.encode()).hexdigest())
        for name, other in (("near_edited", e), ("near_next", b)):
            x, y = shingles(a, 5), shingles(other, 5)
            want = len(x & y) / len(x | y) if x | y else 1.0
            assert r[name] == pytest.approx(want, abs=1e-9 if len(x | y) <= sketches.K else 0.15)
    many = sketches.fingerprints(odd)
    assert many.count() == odd.count()
    same = defaultdict(set)
    for r, t in many.join(odd.where("doc_id IS NOT NULL AND doc_id <> 8").select("doc_id", F.coalesce("text", F.lit("")).alias("t")), "doc_id").select("fingerprint", "t").collect():
        same[t].add(r)
    assert all(len(v) == 1 for v in same.values())


def test_sketches_merge_and_count():
    a, b = (np.unique(np.random.default_rng(s).integers(0, 2**64, 5000, dtype=np.uint64)) for s in (1, 2))
    b = b[::2]  # every second one: the least half of b would not be evenly spread, as hashes are
    whole = np.unique(np.concatenate([a, b]))
    k = sketches.K
    assert (sketches.merge(a[:k], b[:k]) == whole[:k]).all()
    assert sketches.distinct_count(whole[:k]) == pytest.approx(len(whole), rel=0.3)
    assert sketches.containment(a[:k], whole[:k]) > 0.6
    assert (sketches.decode(sketches.encode(a[:k])) == a[:k]).all() and base64.b64decode(sketches.encode(a[:3]))


def test_toxicity(spark, none):
    r = random.Random(8)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(400)]
    texts, toxic = [], []
    for i in range(300):
        w = [r.choice(words) for _ in range(40)]
        bad = i % 4 == 0
        if bad:
            w[r.randrange(40)] = r.choice(["vilestuff", "Grumpling", "nastyword"]) + r.choice(["", "er", "s"])
        texts.append(" ".join(w))
        toxic.append(int(bad))
    texts += [None, "", "x", texts[0] * 100]
    d = spark.createDataFrame(rows(texts), DOCS)
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)] + [(None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in toxicity.score_toxicity(d, labels).collect()}
    assert len(got) == len(texts) and all(0 <= x["score"] <= 1 for x in got.values())
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] == (i in held) for i in range(300))
    assert np.mean([got[i]["predicted"] == toxic[i] for i in held]) > 0.97
    assert {x["score"] for x in toxicity.score_toxicity(d, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score_toxicity(none, labels).count() == 0


def test_nearest_examples_are_exact():
    r = np.random.default_rng(6)
    weight = r.random(50) + 0.5
    lists = [(np.sort(r.choice(50, k, False)), r.integers(1, 4, k)) for k in r.integers(1, 9, 700)]
    index = toxicity.Index([(i, int(r.random() < 0.3), toxicity.packed(*x)) for i, x in enumerate(lists)], weight, block=16)
    unit = lambda t, n: index.units(np.array([0, len(t)]), t, n)
    dense = np.zeros((700, 50))
    for i, (t, n) in enumerate(lists):
        assert all((x == y).all() for x, y in zip(toxicity.unpacked(toxicity.packed(t, n)), (t, n), strict=True))
        dense[i, t] = unit(t, n)
    for _ in range(50):
        t = np.sort(r.choice(50, 5, False))
        n = r.integers(1, 4, 5)
        q = np.zeros(50)
        q[t] = unit(t, n)
        cosine = dense @ q
        floor = np.sort(cosine)[-toxicity.NEAREST]
        found, value = index.nearest(t, n)
        assert set(index.ids[found]) == set(np.flatnonzero((cosine >= floor - 1e-9) & (cosine > 0)))
        assert np.allclose(value, np.sort(cosine[index.ids[found]])[::-1])


def plain_terms(text):
    out = Counter()
    for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").translate(AZ).encode()):
        if 0 < len(w) < 4:
            out[b" " + w + b" "] += 1
        w = b" " + w
        out.update(w[k : k + 5] for k in range(len(w) - 4))
    return out


def plain_fit(examples, df, total):
    """[(terms, toxic)] -> a function from terms to the share of toxic votes."""
    n1 = sum(y for _, y in examples)
    n0, weight = len(examples) - n1, {}
    for t in {t for x, _ in examples for t in x}:
        a, b = (sum(t in x for x, y in examples if y == label) for label in (1, 0))
        chi2 = (n1 + n0) * (a * (n0 - b) - b * (n1 - a)) ** 2 / (max(1, (a + b) * (n1 + n0 - a - b)) * n1 * n0)
        lean = 1 if a * n0 > b * n1 else toxicity.CLEAN
        weight[t] = (np.log((total + 1) / (df[t] + 1)) + 1) * (toxicity.LEAST + np.sqrt(chi2) * lean)

    def unit(x):
        v = {t: (1 + np.log(n)) * weight[t] for t, n in x.items() if t in weight}
        size = np.sqrt(sum(c * c for c in v.values()))
        return {t: c / size for t, c in v.items()}

    units, base, prior = [(unit(x), y) for x, y in examples], n1 / len(examples), toxicity.PRIOR

    def share(x):
        q = unit(x)
        if not q:
            bare = [y for u, y in units if not u]
            return (sum(bare) + prior * base) / (len(bare) + prior)
        near = sorted(((sum(q[t] * c for t, c in u.items() if t in q), y) for u, y in units if u), reverse=True)
        near = [(c, y) for c, y in near if c > 1e-12]
        near = [(c, y) for c, y in near if c >= near[min(len(near), toxicity.NEAREST) - 1][0] - 1e-9]
        votes = [(1 / (1.05 - min(1, c)), y) for c, y in near]
        return (sum(v for v, y in votes if y) + prior * base) / (sum(v for v, _ in votes) + prior)

    return share


def test_toxicity_is_what_a_plain_search_gives(spark):
    """Terms, document frequencies, weights, neighbours, votes, folds and the curve, all anew and one at a time."""
    r = random.Random(12)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 8))) for _ in range(60)]
    texts = [" ".join([*(r.choice(words) for _ in range(r.randint(0, 12))), *(["vile" + r.choice(words)] if i % 3 == 0 else [])]) for i in range(120)]
    texts += [None, "", "\t", texts[0], "ZZZZZZZ", texts[3] * 40]
    labels = [(i, 1 if i % 3 == 0 else i % 17 == 0) for i in range(110)]
    d = spark.createDataFrame(rows(texts), DOCS)
    parts = {x["doc_id"]: x["p"] for x in d.select("doc_id", F.expr("pmod(xxhash64(coalesce(text, '')), 4)").alias("p")).collect()}
    old, _text.SLICE = _text.SLICE, 50
    try:
        terms, index = toxicity.fit(d.select("doc_id", "text"), spark.createDataFrame([(i, int(y)) for i, y in labels], "doc_id long, toxic int"))
        share = index.shares(*toxicity.features(terms, pa.array(texts, pa.string())))
        score = index.calibrated(np.array([s[0] for s in share]))
    finally:
        _text.SLICE = old
    counts = [plain_terms(t) for t in texts]
    df = Counter(t for x in counts for t in x)
    examples = [(i, counts[i], int(y)) for i, y in labels if zlib.crc32(str(i).encode()) % 3 != 1]
    plain = plain_fit([x[1:] for x in examples], df, len(texts))
    assert [s[0] for s in share] == pytest.approx([plain(x) for x in counts], abs=1e-6)
    cross, toxic = [], np.array([y for *_, y in examples])
    for i, x, _ in examples:
        cross.append(plain_fit([e[1:] for e in examples if parts[e[0]] != parts[i]], df, len(texts))(x))
    odds = lambda s: np.log(np.clip(s, 1e-6, 1 - 1e-6) / (1 - np.clip(s, 1e-6, 1 - 1e-6)))

    def cost(a, b):
        z = a * odds(np.array(cross)) + b
        return np.logaddexp(0, np.where(toxic == 1, -z, z)).sum() + ((a - 1) ** 2 + b**2) / 2

    a, b = index.line
    assert all(cost(a, b) <= cost(a + x, b + z) for x in (-1e-3, 0, 1e-3) for z in (-1e-3, 0, 1e-3))
    assert score == pytest.approx(1 / (1 + np.exp(-(a * odds(np.array([plain(x) for x in counts])) + b))), abs=1e-6)


def test_toxicity_terms_and_frequencies_are_those_of_a_plain_count():
    r = random.Random(8)
    texts = [None, "", " ", "a", "ab abc abcd", "\tX yz\n", "É 漢字 🙂", "a" * 9] + ["".join(r.choice("abC \n\tÉ") for _ in range(r.randint(0, 60))) for _ in range(200)]
    number = lambda t: int.from_bytes(t, "little")
    for column in (texts, [*texts, "abc ab " * 200_000, "abcd b"]):  # the second with a text in several slices
        plain = [plain_terms(t) for t in column]
        known = sorted({number(t) for p in plain for t in p})[::2] + [1 << 41]
        df = Counter(number(t) for p in plain for t in p)
        array, terms = pa.array(column, pa.string()), np.array(known, np.uint64)
        assert toxicity.frequencies(terms, array).tolist() == [df[t] for t in known]
        offs, place, times = toxicity.features(terms, array)
        for k, p in enumerate(plain):
            own = slice(offs[k], offs[k + 1])
            want = {number(t): c for t, c in p.items()}
            assert dict(zip(terms[place[own]].tolist(), times[own].tolist(), strict=True)) == {t: want[t] for t in known if t in want}
    assert toxicity.frequencies(np.zeros(0, np.uint64), pa.array(texts, pa.string())).tolist() == []


def test_toxicity_multiplies_only_what_saves_postings():
    """A term goes by a matrix product where texts meet it often enough; each entry of an example is laid out once."""
    r = np.random.default_rng(7)
    chance = np.array([0.5] * 20 + [0.09] * 10 + [0.02] * 200)
    lists = [(t, np.ones(len(t), np.int64)) for t in (np.flatnonzero(r.random(230) < chance) for _ in range(700)) if len(t)]
    index = toxicity.Index([(i, 0, toxicity.packed(*x)) for i, x in enumerate(lists)], np.ones(230))
    index.lay()
    _column, _width, _often, matrices, bounds, _starts, posting = index.laid
    overall = np.bincount(index.terms, minlength=230) / len(lists)
    for matrix, a, z in zip(matrices, bounds[:-1], bounds[1:], strict=True):
        count = np.bincount(index.terms[index.starts[a] : index.starts[z]], minlength=230)
        assert len(matrix) == ((overall * count >= toxicity.SHARE * (z - a)) & (count >= 2)).sum() < 40
    assert sum((m > 0).sum() for m in matrices) + len(posting) == len(index.terms)


def test_toxicity_learns_rare_and_short_words(spark):
    """Each insult is in two labelled texts, too few for a floor on chi-square; some have three letters or fewer."""
    r = random.Random(9)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(4, 7))) for _ in range(400)]
    short = ["".join(r.choice("uvwxyz") for _ in range(3)) for _ in range(40)]
    texts, toxic = [], []
    for i in range(600):
        w = [r.choice(words) for _ in range(6)]
        if i % 5 == 0:
            w[3:3] = [short[i // 5 % 40]] * 4
        texts.append(" ".join(w))
        toxic.append(int(i % 5 == 0))
    d = spark.createDataFrame(rows(texts), DOCS)
    got = {x["doc_id"]: x for x in toxicity.score_toxicity(d, spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")).collect()}
    learned = [short[i // 5 % 40] for i in range(0, 600, 5) if not got[i]["held_out"]]
    bad = [i for i in range(0, 600, 5) if got[i]["held_out"] and short[i // 5 % 40] in learned]
    assert len(bad) > 20 and all(short[i // 5 % 40] in texts[got[i]["evidence"][0]].split() for i in bad)
    clean = [got[i]["score"] for i in range(600) if i % 5 and got[i]["held_out"]]
    assert min(got[i]["score"] for i in bad) > np.mean(clean)


def test_language_model_shares_its_bound_among_rows():
    rows_ = [np.full(n, k, np.uint8) for k, n in enumerate([3, 100, 40, 100])]
    assert np.bincount(language_id.shared(rows_, 63)).tolist() == [3, 20, 20, 20]
    assert len(language_id.shared(rows_, 1000)) == 243 and len(language_id.shared([], 9)) == 0
    model = language_id.Model({"aa": ["ab" * 50, "xyz" * 30], "bb": ["q" * 90]}, 40)
    assert model.phrases(language_id.symbols(*_text.texts(__import__("pyarrow").array(["xyzxyz"])))[0], np.array([6]))[0, 0] == 1  # learned from the second row


def test_double_array_goes_where_the_automaton_does():
    r = np.random.default_rng(3)
    go = language_id.automaton(r.integers(0, 7, 400).astype(np.uint8))
    base, owner, to = language_id.double_array(go)
    for s, out in enumerate(go):
        for c in range(language_id.ALPHABET):
            assert (to[base[s] + c] if owner[base[s] + c] == s else None) == out.get(c)


def test_language_of_a_long_text_is_found_in_slices(spark):
    m = language_id.Model({"x": ["abab abab"], "y": ["bcbc cbcb"]})
    column = pa.array(["abab ba " * 40, None, "bcbc cbcb " * 40, "12 34 " * 40, "\u6f22 " * 50])
    whole = m.predict(column)
    old, _text.SLICE = _text.SLICE, 64
    try:
        sliced = m.predict(column)
    finally:
        _text.SLICE = old
    assert whole[0] == sliced[0] and whole[0][:4] == ["x", "und", "y", "und"] and whole[0][4] != "und"


def test_language_sample_takes_one_row_of_a_doc_id(spark):
    d = spark.createDataFrame([(1, "ab " * 30, "xx")] * 3000 + [(k, "cd " * 30, "yy") for k in range(300)], "doc_id long, text string, lang string")
    m = language_id.train(d)
    assert m.langs == ["xx", "yy"] and m.predict(pa.array(["ab ab", "cd cd"]))[0] == ["xx", "yy"]


def test_empty_tables(spark, none, odd):
    assert minhash_dedup.near_duplicates(none).count() == 0
    assert minhash_dedup.keep_one(none).count() == 0
    assert exact_dedup.exact_dedup(none).count() == 0
    assert exact_dedup.keep_one(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert mixing.resample(none).count() == 0
    assert best_fit_packing.pack_documents(none).count() == 0
    assert sketches.fingerprints(none).count() == 0
    assert lm_scoring.score_documents(none, none.select("doc_id")).count() == 0
    assert language_id.identify(none, language_id.Model({})).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.url_filter(pages, spark.createDataFrame([("net/", "block")], "rule string, verdict string")).count() == 0
    assert chat_format.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    blank = spark.createDataFrame(rows([None, "", None]), DOCS)
    assert minhash_dedup.near_duplicates(blank).where("kept").count() == 3
    assert mixing.mix(blank).agg(F.sum("taken")).first()[0] == 0


def test_columns_with_the_names_of_helpers(spark):
    d = spark.createDataFrame(rows(["a b c", "A B C", "d e f g", None, "a b c"], sources=["x"] * 5), DOCS)
    names = ["times", "text_key", "text_sha256", "_size", "_time", "_key", "_sha", "start", "target", "comp", "v"]
    more = d.select("*", *[F.concat(F.lit(n), "doc_id").alias(n) for n in names])
    for f in (mixing.resample, exact_dedup.keep_one, minhash_dedup.keep_one, lambda x: language_id.keep_identified(x, language_id.Model({"en": ["a b c d"]}))):
        plain, got = f(d), f(more)
        assert got.columns == more.columns
        found = got.collect()
        assert sorted(r["doc_id"] for r in found) == sorted(r["doc_id"] for r in plain.collect()) and found
        assert all(r[n] == f"{n}{r['doc_id']}" for r in found for n in names)


def test_texts_that_share_a_passage_are_told_apart(spark):
    r = random.Random(6)
    passage = [f"p{k}" for k in range(60)]
    texts = [" ".join([*(f"w{r.randrange(10**9)}" for _ in range(n)), *passage]) for n in [12, 20, 40] * 25]
    texts += [t + " end" for t in texts[::7]]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows(texts), DOCS), 2).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(brute_components(list(enumerate(texts)), 2)))


def test_first_shingles_hold_one_of_each_similar_pair():
    r = np.random.default_rng(4)
    times = np.zeros(minhash_dedup.CELLS, np.int32)
    sets = []
    for _ in range(60):
        base = r.integers(0, 2**64, 80, dtype=np.uint64)
        sets += [np.unique(np.append(base[k:], r.integers(0, 2**64, k, dtype=np.uint64))) for k in (0, 3, 6, 9)]
    for s in sets:
        np.add.at(times, minhash_dedup.cell(s), 1)
    first = [dict(zip(*minhash_dedup.first_shingles(s, times, 80), strict=True)) for s in sets]
    for a in range(len(sets)):
        for b in range(a):
            same = len(np.intersect1d(sets[a], sets[b]))
            n = len(sets[a]) + len(sets[b])
            met = any(180 * (1 + min(len(sets[a]) - first[a][k], len(sets[b]) - first[b][k])) >= 80 * n for k in first[a].keys() & first[b].keys())
            assert met or 100 * same < 80 * (n - same)
