"""Operators over documents against brute force, and the cases their docstrings define."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tablewright.llm import bpe, lattice, mixing, passages, shards, shingle_join, token_files, toxicity
from tablewright.llm.common import components, read

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    "foo  <|endoftext|>  bar\n x y  \n",
    "",
    " ",
    "a\x1c \x1d b é ΑΣ Σ don't  I'll\t\t z",
    "<|startoftext|> x<|endoftext|>",
    "́ a   b  c",
    "\x00 \x00",
    "Ünïcödé x² ½ don't I'LL ''s ÀÖ×÷ØÞß ŉǅ İx ſt \x85q",
    "Á x <|ENDOFTEXT|> Y",
    " lead  trail ",
    "a\xa0 b​ c 日本語 \U0001f600",
    "long " * 3000 + "x" * 5000,
]


def words(text):
    return (text or "").encode().lower().split()


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, nulls in every column, a repeated row, and columns whose names operators use themselves."""
    rows = [(i, t, "en", f"s{i % 3}", len(t), "x", "y", "z") for i, t in enumerate(ODD)]
    rows += [(100, None, None, None, None, None, None, None), (None, "no id here", "en", "s0", 10, "x", "y", "z")]
    rows += [(7, ODD[7], "en", "s1", len(ODD[7]), "x", "y", "z")]
    return spark.createDataFrame(rows, f"{DOCUMENT}, _row string, _id string, class string")


@pytest.fixture(scope="module")
def labels(spark, sf):
    return read(spark, sf, "labels")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCUMENT)


def test_empty_tables(spark, none, labels):
    assert shards.document_slots(none).count() == 0
    assert bpe.document_digests(none).count() == 0
    assert toxicity.document_scores(none, labels.limit(0)).count() == 0
    assert token_files.document_checksums(none).count() == 0
    assert mixing.apply_mix(none, labels.limit(0)).count() == 0
    assert passages.document_spans(none).count() == 0 and passages.without_repeats(none).count() == 0
    assert shingle_join.document_components(none).count() == 0 and shingle_join.first_of_each(none).count() == 0
    assert lattice.document_scores(none).count() == 0


def test_shards(spark, odd):
    rows = spark.range(2000).select(F.col("id").alias("k"))
    tree = shards.tree_for(40)
    placed = shards.place(shards.place(rows, ["k"], tree), ["k"], shards.tree_for(41), into="grown").toPandas()
    moved = placed[placed["shard"] != placed["grown"]]
    assert set(moved["grown"]) == {40} and 20 < len(moved) < 90
    assert placed["shard"].value_counts().between(20, 90).all() and placed["shard"].nunique() == 40
    # A shard that weighs more takes rows; outside its own region and rack nothing moves between others.
    heavy = shards.place(shards.place(rows, ["k"], tree), ["k"], shards.reweighted(tree, 7, 3.0), into="now").toPandas()
    moved = heavy[heavy["shard"] != heavy["now"]]
    assert (moved["now"] // 20 == 0).all() and ((moved["shard"] // 20 == 1) | (moved["now"] // 5 == 1)).all()
    out = shards.document_slots(odd).toPandas()
    assert len(out) == odd.count()
    for _, group in out.groupby("shard"):
        assert sorted(group["slot"]) == list(range(len(group)))
    sizes = {r["doc_id"]: r["size"] for r in shards.document_slots(odd).collect()}
    assert sizes[100] == 16 and sizes[3] == len(ODD[3].encode()) + 16
    with pytest.raises(ValueError):
        shards.tree_for(0)


def test_hot_rows_get_their_own_slots(spark):
    same = spark.range(500).select(F.lit(3).cast("long").alias("doc_id"), F.lit("copy").alias("text"))
    slots = [r["slot"] for r in shards.document_slots(same).collect()]
    assert sorted(slots) == list(range(500))


def test_bpe_is_the_library(spark, sf, odd):
    docs = read(spark, sf, "documents").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    texts = collections.defaultdict(list)
    for r in docs.collect():
        texts[r["doc_id"]].append(r["text"] or "")
    tok = Tokenizer.from_file(public_tokenizers.path(bpe.TOKENIZER))
    tok.no_truncation(), tok.no_padding()

    def expected(text):
        ids = tok.encode(text, add_special_tokens=False).ids
        decoded = tok.decode(ids, skip_special_tokens=False)
        return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    got = [(r["doc_id"], (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"])) for r in bpe.document_digests(docs).collect()]
    want = [(i, expected(t)) for i, held in texts.items() for t in held]
    assert sorted(got, key=str) == sorted(want, key=str)
    # The same whatever the size of a chunk.
    small = bpe.encode_decode(docs, chunk_size=500, finish=bpe.digests, schema=bpe.DIGESTS).collect()
    assert sorted(map(tuple, small), key=str) == sorted(((i, *w) for i, w in want), key=str)


def test_token_files(spark, sf, odd, tmp_path):
    docs = read(spark, sf, "documents").select("doc_id", "text").where("doc_id > 200 or doc_id < 50").unionByName(odd.select("doc_id", "text"))
    docs = docs.where("doc_id is null or doc_id != 7")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.where("doc_id >= 12 or doc_id is null").collect()}
    docs = docs.where("doc_id >= 12 or doc_id is null")
    tok = Tokenizer.from_file(public_tokenizers.path(token_files.TOKENIZER))
    tok.no_truncation(), tok.no_padding()
    path, at = str(tmp_path / "tokens"), 0
    rows = sorted(token_files.document_checksums(docs, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted(texts, key=lambda i: (i is not None, i or 0))
    for r in rows:
        ids = [*tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids, token_files.END_ID]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert {(r["doc_id"], r["start"]) for r in rows} == {(r["doc_id"], r["start"]) for r in token_files.read_index(spark, path).collect()}
    one = token_files.read_documents(spark, path, [100]).collect()
    assert len(one) == 1 and list(one[0]["ids"]) == [1]


@pytest.mark.parametrize("text", ODD)
def test_words_for_tokens_are_the_library(text):
    tok = Tokenizer.from_file(public_tokenizers.path(token_files.TOKENIZER))
    tok.no_truncation(), tok.no_padding()
    alone = [i for w in token_files.words_for(text) for i in tok.encode(w, add_special_tokens=False).ids]
    assert alone == tok.encode(text, add_special_tokens=False).ids
    assert "".join(bpe.words_at_spaces(text)) == text


def test_mixing(spark, sf, odd, labels):
    docs = read(spark, sf, "documents")
    rows, plan = mixing.mix_sources(docs, labels)
    out = mixing.with_copies(rows, plan).toPandas()
    per = out.groupby("source").agg({"size": "sum", "taken": "sum", "target": "first", "source_size": "first"})
    assert (per["size"] == per["source_size"]).all()
    assert (abs(per["taken"] - per["target"]) <= out["size"].max() / 2 + 1).all()
    assert (out["taken"] <= 3 * out["size"]).all() and abs(per["target"].sum() - per["size"].sum()) < 1e-6
    again = mixing.with_copies(*mixing.mix_sources(docs.repartition(3), labels)).toPandas()
    key = ["doc_id", "taken"]
    assert out[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()
    mixed = mixing.apply_mix(docs, labels)
    assert mixed.columns == docs.columns and mixed.count() == out["copies"].sum()
    strange = mixing.apply_mix(odd, labels)
    assert strange.columns == odd.columns and strange.where("doc_id = 100").count() <= 3


def test_targets_by_hand(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 90), (None, 100)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    # Weights 5, 2, 1, 5: a stops at 30, the null source at 300, the rest is shared 2 : 1 until c stops at 270.
    assert got == {"a": 30.0, "b": 600.0, "c": 270.0, None: 300.0}


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    names = sorted(sets)
    for n, a in enumerate(names):
        for b in names[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def near_copies():
    r, rows, n = random.Random(5), [], 10_000
    for _ in range(12):
        base = [r.choice("abcdefghij") + str(r.randrange(40)) for _ in range(r.choice([6, 9, 30, 80, 200]))]
        for k in range(6):
            v = list(base)
            for _ in range(max(1, len(v) * k // 100)):
                v[r.randrange(len(v))] = f"q{r.randrange(10**6)}"
            rows.append((n, " ".join(v)))
            n += 1
    for _ in range(150):
        rows.append((n, " ".join(r.choice("abc") if r.random() < 0.1 else "abcdefghijk"[j] for j in range(r.randrange(1, 12)))))
        n += 1
    return [*rows, (n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, rows[0][1]), (n + 4, rows[0][1].upper())]


def test_join_links_all_similar_sets(spark, sf, odd):
    rows = [(r[0], r[1]) for r in read(spark, sf, "documents").where("doc_id < 120").select("doc_id", "text").collect()] + near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in shingle_join.document_components(docs).collect()}
    want = brute_components(rows)
    assert got == want
    kept = shingle_join.first_of_each(docs)
    assert {r["doc_id"] for r in kept.collect()} == {c for _, c in want.values()}
    strange = shingle_join.first_of_each(odd)
    assert strange.columns == odd.columns and strange.where("doc_id = 7").count() == 1 and strange.where("doc_id is null").count() == 1


@pytest.mark.parametrize("x, y", [(3, 4), (4, 4), (7, 9), (20, 26), (100, 110), (900, 1000), (1500, 1200)])
def test_similar_sets_share_a_signature(x, y):
    r = np.random.RandomState(x + y)
    for _ in range(30):
        common = math.ceil(3 * (x + y) / 7)
        if common > min(x, y):
            return
        pool = r.randint(0, 2**63, x + y - common).astype(np.uint64)
        a, b = np.sort(pool[:x]), np.sort(np.concatenate([pool[:common], pool[x:]]))
        assert len(b) == y and np.isin(shingle_join.signatures(a), shingle_join.signatures(b)).any()


def test_compact_windows_by_hand():
    r = np.random.RandomState(0)
    sequences = [r.randint(0, 2**63, size=n).astype(np.uint64) for n in (46, 47, 100, 300)]
    owner, c, left, right = passages.compact_windows(sequences, 0, 46)
    salt = passages.mix(np.array([1], np.uint64))[0]
    for k, s in enumerate(sequences):
        h, want = passages.mix(s ^ salt), set()
        for i in range(len(h)):
            a = b = i
            while a > 0 and h[a - 1] > h[i]:
                a -= 1
            while b < len(h) - 1 and h[b + 1] > h[i]:
                b += 1
            if b - a + 1 >= 46:
                want.add((i, a, b))
        assert {t[1:] for t in zip(owner, c, left, right, strict=True) if t[0] == k} == want


def test_passages(spark, odd):
    r, rows, planted = random.Random(3), [], []

    def some(n):
        return [f"w{r.randrange(3000)}" for _ in range(n)]

    for g in range(4):
        passage = some(51 + 15 * g)
        for k in range(4):
            q = list(passage)
            if g % 2 and k:
                q[r.randrange(10, len(q) - 10)] = f"edit{r.randrange(10**6)}"
            a, b = some(r.randrange(5, 150)), some(r.randrange(5, 150))
            planted.append((len(rows), len(a), len(a) + len(q), k))
            rows.append((len(rows), " ".join(a + q + b)))
    clean = [(1000 + k, " ".join(some(120))) for k in range(20)]
    others = [(2000, None), (2001, ""), (None, " ".join(some(90))), (2002, "one text"), (2002, " ".join(some(90))), (2003, clean[0][1])]
    docs = spark.createDataFrame([*rows, *clean, *others], "doc_id long, text string").repartition(4)
    found = passages.document_spans(docs).collect()
    assert len(found) == docs.count()
    spans = {x["doc_id"]: x["spans"] for x in found}
    for i, a, b, k in planted:
        assert (not spans[i]) if k == 0 else any(x["start"] <= a + 5 and x["end"] >= b - 5 and x["source_id"] < i for x in spans[i])
    assert not any(spans[i] for i, _ in clean) and spans[2003][0]["source_id"] == 1000
    kept = {x["doc_id"]: x["text"] for x in passages.without_repeats(docs).collect()}
    assert 2003 not in kept and kept[1000] == clean[0][1] and {2000, 2001, 2002, None} <= set(kept)
    i, a, b, _ = planted[1]
    assert words(kept[i]) == words(rows[i][1])[:a] + words(rows[i][1])[b:]
    strange = passages.without_repeats(odd)
    assert strange.columns == odd.columns and strange.count() == odd.count()


def test_passages_of_later_texts(spark):
    r, rows = random.Random(5), []

    def some(n):
        return [f"w{r.randrange(10**6)}" for _ in range(n)]

    # The first and third copy differ from the second in one word each, and so are not similar to each other.
    for _ in range(150):
        passage = some(60)
        x, y = r.sample(range(14, 46, 6), 2)
        for place in (x, None, y):
            q = list(passage)
            if place is not None:
                q[place] = some(1)[0]
            before, after = some(r.randrange(5, 80)), some(r.randrange(5, 80))
            rows.append((len(rows), " ".join(before + q + after), len(before), len(before) + 60))
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string").repartition(4)
    spans = {x["doc_id"]: x["spans"] for x in passages.document_spans(docs).collect()}
    lost = [i for i, _, a, b in rows if i % 3 == 2 and not any(x["start"] <= a + 5 and x["end"] >= b - 5 and x["source_id"] == i - 1 for x in spans[i])]
    assert not lost


def test_shared_passages_with_more_words_on_either_side():
    r = np.random.RandomState(4)

    def some(n):
        return r.randint(0, 2**32, n, dtype=np.uint32)

    def text(words, lead, tail):
        return passages.shingles_of(np.concatenate([some(lead), words, some(tail)]).astype(np.uint64))

    everywhere = [(0, 10**6)]
    for k in range(100):
        passage, at, more = some(50 + k % 30), r.randint(10, 40), 1 + k % 5
        longer = np.concatenate([passage[:at], some(more), passage[at:]])
        short, long = passages.shingles_of(passage.astype(np.uint64)), passages.shingles_of(longer.astype(np.uint64))
        common = len(np.intersect1d(short, long))
        assert common >= 0.75 * (len(short) + len(long) - common)
        x, y = text(passage, 20, 30), text(longer, 40, 10)
        for b, a, first, n in ((x, y, 20, len(short)), (y, x, 40, len(long))):
            assert any(i <= first and j >= first + n - 1 for i, j in passages.shared_passages(b, a, everywhere)), (k, at, more)
    # The passage twice in the other text, and one far from similar.
    twice = passages.shingles_of(np.concatenate([passage, some(60), passage]).astype(np.uint64))
    assert passages.shared_passages(short, twice, everywhere) == [(0, len(short) - 1)]
    assert passages.shared_passages(short, passages.shingles_of(np.concatenate([passage[:35], some(60)]).astype(np.uint64)), everywhere) == []


def test_repeats_are_similar_as_every_stretch_says():
    rng, seen = np.random.default_rng(11), set()

    def plain(mine, a):
        for x in range(len(a)):
            for y in range(x, len(a)):
                theirs = set(a[x : y + 1].tolist())
                common = len(theirs & set(mine.tolist()))
                if 100 * common >= 75 * (len(mine) + len(theirs) - common):
                    return True
        return False

    for _ in range(400):
        letters = int(rng.integers(3, 30))
        mine = np.unique(rng.integers(0, letters, int(rng.integers(1, 25))))
        a = rng.integers(0, letters + int(rng.integers(0, 15)), int(rng.integers(1, 40)))
        seen.add(plain(mine, a))
        assert passages.repeats_similar(mine, a) == plain(mine, a), (mine, a)
    assert seen == {True, False}


def test_sketches_keep_shared_passages_and_rule_out_lines():
    rng = np.random.default_rng(12)

    def common(n, at):
        """Bits in common of two texts of random shingles that share a stretch of ``n``, seen from its place ``at``."""
        one, other = (rng.integers(0, 1 << 63, 200 + n, np.uint64) for _ in range(2))
        other[100 : 100 + n] = one[100 : 100 + n]
        (x, p), (y, q) = (passages.sketches(t, np.array([100 + at])) for t in (one, other))
        assert p[0] and q[0]
        return int(np.bitwise_count((x & y).view(np.uint64)).sum())

    assert all(common(46, at) >= passages.MIN_BITS for at in range(46))
    assert np.mean([common(11, at % 11) >= passages.MIN_BITS for at in range(200)]) < 0.05
    assert not passages.sketches(np.tile(np.arange(20, dtype=np.uint64), 8), np.array([80]))[1][0]


def test_sketches_rule_out_longer_lines_and_texts_that_repeat_others():
    rng = np.random.default_rng(14)

    def allowed(one, other, at, to):
        (x, _), (y, _) = passages.sketches(one, np.array([at])), passages.sketches(other, np.array([to]))
        return int(np.bitwise_count((x & y).view(np.uint64)).sum()) >= int(passages.bits_to_share(one, np.array([at]))[0])

    def some(n):
        return rng.integers(0, 1 << 63, n, np.uint64)

    # A line of 15 shingles, which one pair in eleven passed with 512 bits.
    passed = 0
    for _ in range(300):
        line = some(15)
        passed += allowed(np.concatenate([some(100), line, some(100)]), np.concatenate([some(60), line, some(100)]), 107, 67)
    assert passed < 9
    # Shingles that come twice and are not in the other text, then one line that is: such texts met all others.
    met = 0
    for _ in range(100):
        line, again = some(9), np.repeat(some(60), 2)
        met += allowed(np.concatenate([again, line, some(90)]), np.concatenate([some(90), line, some(90)]), 124, 94)
    assert met < 25
    # A passage that repeats itself is found however often it does so there, and in any order of its repeats.
    for times in (1, 3, 9):
        few = some(12)
        one, other = np.concatenate([some(60), np.tile(few, 6), some(60)]), np.concatenate([some(60), np.tile(np.repeat(few, times), 5), some(60)])
        assert all(allowed(one, other, 60 + k, 60 + k * times) for k in range(12))


def test_pairs_without_room_for_a_passage_are_not_looked_into(monkeypatch):
    rng = np.random.default_rng(15)
    some = lambda n: passages.shingles_of(rng.integers(0, 1 << 63, n + 4, np.uint64))
    line, looked = some(30), []
    b, a = (np.concatenate([some(200), line, some(200)]) for _ in range(2))
    monkeypatch.setattr(passages, "candidates", lambda hit, width, of=passages.candidates: looked.append(1) or of(hit, width))
    assert passages.shared_passages(b, a, [(0, len(b))]) == [] and not looked
    whole = np.concatenate([some(20), b[150:300]])
    assert passages.shared_passages(b, whole, [(0, len(b))]) == [(150, 299)] and looked


def test_stretches_and_cut():
    hit = np.array([1] * 30 + [0] * 5 + [1] * 30 + [0] * 60 + [1] * 3, bool)
    assert passages.stretches(hit, 46) == [(0, 64)] and passages.stretches(hit, 80) == []
    assert passages.cut("a b  c\nd e", [(1, 3)]) == "a \nd e" and passages.cut("a b", [(0, 2)]) == ""


def test_field_marginals_by_enumeration():
    r = np.random.RandomState(1)
    lengths, steps = np.array([4, 0, 1, 3]), r.randn(4)
    emission = r.randn(lengths.sum())
    p, pairs = toxicity.marginals(emission, lengths, steps)
    want, want_pairs, at = [], np.zeros(4), 0
    for n in lengths:
        if n:
            total, on, both = 0.0, np.zeros(n), np.zeros(4)
            for code in range(2**n):
                s = [(code >> k) & 1 for k in range(n)]
                w = math.exp(sum(emission[at + k] * s[k] for k in range(n)) + sum(steps[2 * s[k] + s[k + 1]] for k in range(n - 1)))
                total += w
                on += w * np.array(s)
                for k in range(n - 1):
                    both[2 * s[k] + s[k + 1]] += w
            want += (on / total).tolist()
            want_pairs += both / total
        at += n
    assert np.allclose(p, want) and np.allclose(pairs, want_pairs)


def test_toxicity(spark, odd):
    sf = "/root/testdata/sf0.01"
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    out = toxicity.document_scores(docs, labels)
    tried = out.join(labels, "doc_id").where("held_out").toPandas()
    assert out.count() == docs.count() and tried["score"].between(0, 1).all()
    assert ((tried["score"] >= 0.7) == (tried["predicted"] == 1)).all()
    wrong_clean = ((tried["toxic"] == 0) & (tried["predicted"] == 1)).sum()
    found = ((tried["toxic"] == 1) & (tried["predicted"] == 1)).sum() / (tried["toxic"] == 1).sum()
    assert wrong_clean <= 2 and found >= 0.7
    assert {r["held_out"] for r in out.where("doc_id = 5").collect()} == {zlib.crc32(b"5") % 3 == 1}
    strange = toxicity.score(odd, toxicity.train(docs, labels))
    assert strange.count() == odd.count() and strange.where("predicted = 1").count() == 0
    assert toxicity.without_toxic(odd, labels.limit(0)).columns == odd.columns
    spans = out.where("predicted = 1").join(docs, "doc_id").select("text", F.explode("spans").alias("s")).limit(50).collect()
    assert all(" " not in r["text"][r["s"]["start"] : r["s"]["end"]] for r in spans)


def test_lattice_sums_all_segmentations():
    start = lattice.vocabulary(lattice.VOCABULARY)[2]
    seg = lattice.Segmenter(lattice.VOCABULARY, start)
    numbers = lattice.vocabulary(lattice.VOCABULARY)[0]

    def brute(w, used=(), p=1.0):
        """Every segmentation: its probability and the pieces it uses."""
        if not w:
            yield p, used
            return
        spelt = [f"<0x{b:02X}>" for b in w[0].encode()]
        yield from brute(w[1:], (*used, *spelt), p * math.prod(start[numbers[x]] for x in spelt))
        for j in range(1, len(w) + 1):
            if w[:j] in numbers and not w[:j].startswith("<0x"):
                yield from brute(w[j:], (*used, w[:j]), p * start[numbers[w[:j]]])

    words_ = ["▁the", "▁thereof", "▁日本x", "▁éa", "▁the", "▁\U0001f600"]
    got, want = seg.log10(words_, expect=True), np.zeros(len(start))
    for w, score in zip(words_, got, strict=True):
        ways = list(brute(w))
        total = sum(p for p, _ in ways)
        assert math.isclose(score, math.log10(total), rel_tol=1e-9)
        for p, used in ways:
            for x in used:
                want[numbers[x]] += p / total
    assert np.allclose(seg.expected, want)
    assert seg.log10(["▁" + "x" * 3000])[0] < -1000 and len(seg.log10([])) == 0


def test_lattice_scores(spark, sf, odd):
    docs = read(spark, sf, "documents").select("doc_id", "text").where("doc_id >= 101").unionByName(odd.select("doc_id", "text"))
    rows = [(r[0], words(r[1])) for r in docs.collect()]
    out = {i: 0 for i, _ in rows}
    training = [w for i, w in rows if i is None or zlib.crc32(str(i).encode()) % 10]
    counts = collections.Counter(x for w in training for x in [*w, None])
    total, distinct = sum(counts.values()), len(counts)
    below = math.log10(total + 0.1 * (distinct + 1))
    want = {i: sum(math.log10(counts[x] + 0.1) - below for x in [*w, None]) for i, w in rows}
    known = {i: sum(x in counts for x in [*w, None]) for i, w in rows}
    got = lattice.document_scores(docs).collect()
    assert len(got) == len(rows) and set(out) == {r["doc_id"] for r in got}
    for r in got:
        i = r["doc_id"]
        assert r["n_known"] == known[i] and r["train_tokens"] == total
        assert math.isclose(r["base_score"], want[i], rel_tol=1e-9) and r["score"] < 0
    held = [r for r in got if r["held_out"] and r["doc_id"] >= 101]
    assert np.corrcoef([r["score"] for r in held], [r["base_score"] for r in held])[0, 1] > 0.9


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 2), (9, 8), (8, 10), (2, 1), (7, 7)] + [(100 + k, 101 + k) for k in range(40)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {k: 1 for k in range(1, 6)} | {k: 8 for k in (8, 9, 10)} | {k: 100 for k in range(100, 141)}


def test_pipeline(spark, sf):
    docs = read(spark, sf, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5
    result = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(result.columns)
    kept = {r["doc_id"] for r in result.select("doc_id").distinct().collect()}
    assert kept and kept <= {r["doc_id"] for r in docs.select("doc_id").collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf).columns == docs.columns
