"""Periodic runs, whitening and exact search against brute force, and the cases their docstrings define."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tablewright.llm import ball_tree, bpe, periodic, shingle_join, token_files, whitening
from tablewright.llm.common import components, stored

DOCUMENT = "doc_id long, text string, lang string, runs string, key string, collapsed string, _row string"
VECTOR = "vec_id long, embedding array<float>, label int, x string, id string"


def plain_runs(w):
    """All runs by comparing every lag at every place."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i + q - s
            own = w[s : s + length]
            smaller = any(own[: length - p] == own[p:] for p in range(1, q))
            if length >= max(6, 4 * q) and not smaller:
                out.append((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_digests(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    kept = b" ".join(x for i, x in enumerate(w) if i not in dropped)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    milli = 1000 * best[1] // best[2] if best else None
    return (len(runs), *(best or (None, None, None)), milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def random_words(r, n, kinds):
    words = [f"w{r.randrange(kinds)}" for _ in range(n)]
    if n and r.random() < 0.6:
        a = r.randrange(n)
        p = r.randint(1, max(1, (n - a) // 4))
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def test_runs_are_those_of_all_lags():
    r = random.Random(5)
    for _ in range(300):
        texts = [[x.encode() for x in random_words(r, r.randint(0, 90), r.choice([1, 2, 3, 5, 30]))] for _ in range(4)]
        assert periodic.runs_of(texts) == [plain_runs(t) for t in texts]


def test_long_repetitive_texts():
    words = [b"a"] * 200_000
    assert periodic.runs_of([words, words[:5]]) == [[(0, 200_000, 1)], []]
    r = random.Random(1)
    block = [b"%d" % r.randrange(9) for _ in range(5000)]
    assert (100, 25_000, 5000) in periodic.runs_of([[b"x%d" % i for i in range(100)] + block * 5])[0]


def test_document_digests(spark, sf):
    r = random.Random(3)
    rows = [(i, " ".join(random_words(r, r.randint(0, 120), 12)), "en", "r", "k", "c", "o") for i in range(150)]
    rows += [(i, " \t".join(random_words(r, 40, 3)) + " é \x1c\n", None, None, None, None, None) for i in range(150, 180)]
    rows += [(None, "a " * 9, None, None, None, None, None), (500, None, *[None] * 5), (501, "", *[None] * 5), (502, " \n", *[None] * 5)]
    rows += [rows[3], rows[3], (3, "b " * 30, *[None] * 5), (600, "long words " * 30_000, *[None] * 5)]
    df = spark.createDataFrame(rows, DOCUMENT).repartition(3)
    got = sorted(map(tuple, periodic.document_digests(df).collect()), key=str)
    assert got == sorted([(d, *plain_digests(d, t)) if d != 600 else (d, *plain_600(t)) for d, t, *_ in rows], key=str)
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {d["doc_id"]: d["text"] for d in documents.collect()}
    for row in periodic.document_digests(documents).collect():
        if len((texts[row["doc_id"]] or "").split()) < 400:
            assert tuple(row)[1:] == plain_digests(row["doc_id"], texts[row["doc_id"]])
    assert periodic.document_digests(spark.createDataFrame([], DOCUMENT)).count() == 0


def plain_600(text):
    """One run of period two over the whole text, as its id makes nothing periodic."""
    assert zlib.crc32(b"600") % 10
    n = len(text.split())
    lines = f"0,{n},2\n"
    return 1, 0, n, 2, 500 * n, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b"long words").hexdigest()


def test_texts_without_repeats_keep_their_columns(spark):
    rows = [(1, "x  y\n", "en", "r", "k", "c", "o"), (2, "s " + "a b " * 5 + "t", "de", "r2", "k2", "c2", "o2"), (3, None, *[None] * 5)]
    df = spark.createDataFrame(rows, DOCUMENT)
    out = periodic.without_repeats(df)
    assert out.schema == df.schema
    assert {tuple(x) for x in out.collect()} == {rows[0], (2, "s a b t", *rows[1][2:]), rows[2]}


# --- whitening


@pytest.fixture(scope="module")
def vectors():
    r = np.random.RandomState(2)
    x = (r.randn(600, 20) @ np.diag(np.linspace(0.2, 2, 20))).astype(np.float32)
    x[50:90] = x[50]
    return [(i, [float(v) for v in row], i % 3, "x", "y") for i, row in enumerate(x)]


def odd_vectors(width):
    nan, inf = float("nan"), float("inf")
    bad = [None, [None] + [1.0] * (width - 1), [nan] + [1.0] * (width - 1), [1.0] * (width - 1) + [-inf]]
    return [(2000 + 50 * k, v, None, None, None) for k, v in enumerate(bad)]


def whole(rows):
    return np.array([[int(np.floor(64 * np.float64(np.float32(c)))) + 1_000_000 for c in v] for _, v, *_ in rows], np.int64)


def test_whitened(spark, vectors):
    rows = [*vectors, vectors[7], (None, vectors[8][1], None, None, None)]
    df = spark.createDataFrame([*rows, *odd_vectors(20)], VECTOR).repartition(4)
    got = whitening.embedding_whitened(df).collect()
    assert len(got) == 16 * len(rows)
    fitted = np.unique(whole(rows), axis=0)
    n, sums = len(fitted), fitted.sum(axis=0)
    centred = fitted - sums / n
    values, parts = np.linalg.eigh(centred.T @ centred / n)
    values, parts = values[::-1], parts[:, ::-1]
    by_id = {r[0]: x for r, x in zip(rows, whole(rows), strict=True)}
    table = {}
    for r in got:
        x = by_id[r["vec_id"]]
        assert r["n"] == n and r["deviation"] == int(((n * x - sums) ** 2).sum()) and r["identity_error"] < 1e-9
        assert np.isclose(r["explained"], values[r["component"] - 1] / values.sum(), rtol=1e-10)
        table.setdefault(r["component"], []).append((r["whitened"], (x - sums / n) @ parts[:, r["component"] - 1] / values[r["component"] - 1] ** 0.5))
    assert set(table) == set(range(1, 17))
    for pairs in table.values():
        mine, theirs = np.array(pairs).T
        assert np.allclose(mine, theirs * np.sign(mine @ theirs), atol=1e-8)


def test_whitening_of_odd_tables(spark, vectors):
    assert whitening.embedding_whitened(spark.createDataFrame([], VECTOR)).count() == 0
    assert whitening.embedding_whitened(spark.createDataFrame(odd_vectors(4), VECTOR)).count() == 0
    # Alike vectors have no variance; two vectors have one component.
    assert whitening.embedding_whitened(spark.createDataFrame([vectors[0], vectors[0]], VECTOR)).count() == 0
    two = whitening.embedding_whitened(spark.createDataFrame(vectors[:2], VECTOR)).collect()
    assert [(r["component"], round(abs(r["whitened"]), 6), r["explained"]) for r in two] == [(1, 1.0, 1.0)] * 2
    # Shorter ones end in zeros: [1] and [1, 0] are one vector of the fit; an entry too large for its whole number drops its row.
    mixed = [(1, [1.0], 0, "", ""), (2, [1.0, 0.0], 0, "", ""), (3, [0.0, 2.0], 0, "", ""), (4, [], 0, "", ""), (5, [1e30, 0.0], 0, "", "")]
    got = whitening.embedding_whitened(spark.createDataFrame(mixed, VECTOR)).collect()
    assert {r["n"] for r in got} == {3} and {r["vec_id"] for r in got} == {1, 2, 3, 4} and {r["component"] for r in got} == {1, 2}
    # Large entries stay exact.
    big = [(i, [float(2.0**40 * i), float(i % 5)], 0, "", "") for i in range(9)]
    sums = whole(big).sum(axis=0)
    for r in whitening.embedding_whitened(spark.createDataFrame(big, VECTOR)).collect():
        exact = sum((9 * int(c) - int(s)) ** 2 for c, s in zip(whole(big)[r["vec_id"]], sums, strict=True))
        assert r["deviation"] == (exact if exact < 1 << 63 else None)


def test_spectrum_slices():
    r = np.random.RandomState(0)
    for d in (1, 2, 5, 40):
        for kind in range(4):
            a = r.randn(d, d)
            if kind == 1:
                a[:, (d + 1) // 2 :] = 0
            m = {2: np.diag(np.repeat([3.0, 2.0, 1.0], d)[:d]), 3: np.diag([5 + 1e-9, *[5.0] * (d - 1)])}.get(kind, a.T @ a)
            values = np.linalg.eigvalsh(m)[::-1]
            found = whitening.leading_components(m, 16)
            u = np.array([c.vector for c in found])
            assert len(found) == min(16, (values > 1e-10 * values[0]).sum())
            assert np.allclose([c.value for c in found], values[: len(found)], rtol=1e-11)
            assert np.abs(u @ u.T - np.eye(len(u))).max() < 1e-10
            assert np.abs(u @ m @ u.T - np.diag([c.value for c in found])).max() < 1e-10 * values[0]
            assert all(c.above < j <= c.from_here for j, c in enumerate(found, 1))
            s = float(r.choice(values) + 0.1 * r.randn())
            assert whitening.positive_pivots(m - s * np.eye(d)) == (values > s).sum()


# --- exact search


def plain_top(rows, every, wanted):
    """(query_id, rank, vec_id, score) in whole numbers of Python."""
    taking = [(i, [int(np.floor(256.0 * np.float64(np.float32(c)))) for c in v]) for i, v, *_ in rows]
    taking = sorted({(i, tuple(x)) for i, x in taking})
    out = []
    for q, x in taking:
        if q % every == 0:
            scores = [(-max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(x, y)))), i) for i, y in taking if (i, y) != (q, x)]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:wanted], 1)]
    return sorted(out)


def found(df, **options):
    return sorted(tuple(r) for r in ball_tree.embedding_top(df, **options).drop("query_part").collect())


@pytest.mark.parametrize("shard_rows", [None, 60])
def test_exact_top(spark, vectors, shard_rows):
    rows = [*vectors, vectors[7]]
    df = spark.createDataFrame([*rows, *odd_vectors(20), (None, vectors[0][1], 0, "", "")], VECTOR).repartition(4)
    assert found(df, shard_rows=shard_rows) == plain_top(rows, 50, 5)


def test_exact_top_of_odd_tables(spark, vectors):
    assert found(spark.createDataFrame([], VECTOR)) == []
    assert found(spark.createDataFrame(vectors[:1], VECTOR)) == []
    few = vectors[:4]
    assert found(spark.createDataFrame(few, VECTOR)) == plain_top(few, 50, 5)
    # Many copies, zero vectors, shorter vectors, two vectors of one id.
    rows = [(i, [1.0, 2.0], 0, "", "") for i in range(300)] + [(i, [0.0, 0.0], 0, "", "") for i in range(300, 320)]
    rows += [(400, [3.0], 0, "", ""), (401, [], 0, "", ""), (450, [1.0, -5.0], 0, "", ""), (50, [2.0, 0.5], 0, "", "")]
    assert found(spark.createDataFrame(rows, VECTOR), shard_rows=2) == plain_top([(i, [*v, 0.0, 0.0][:2]) for i, v, *_ in rows], 50, 5)
    # Products beyond doubles and longs.
    big = [(i, [float(i + 1) * 10.0**k, 1.0], 0, "", "") for k in (3, 8, 20) for i in range(100 * k, 100 * k + 30)]
    assert found(spark.createDataFrame(big, VECTOR), shard_rows=20) == plain_top(big, 50, 5)


def test_branch_and_bound_passes_over_leaves():
    r = np.random.RandomState(4)
    x = np.floor(256 * np.repeat(r.randn(40, 8), 60, axis=0) + 6 * r.randn(2400, 8))
    tree, order = ball_tree.build_tree(x, 16)
    assert sorted(order.tolist()) == list(range(2400)) and (tree.items == x[order]).all()
    for (start, end), centre, radius in zip(tree.spans, tree.centres, tree.radii, strict=True):
        assert (ball_tree.norms(tree.items[start:end] - centre) <= radius * (1 + 1e-12)).all()
    looked_at = []
    offer = ball_tree.Best.offer
    ball_tree.Best.offer = lambda self, rows, scores, *rest: (looked_at.append(scores.size), offer(self, rows, scores, *rest))[1]
    try:
        best = ball_tree.search_tree(tree, order, x[:50], np.full(50, ball_tree.NONE), 6)
    finally:
        ball_tree.Best.offer = offer
    assert (best.scores == np.sort(x[:50] @ x.T, axis=1)[:, ::-1][:, :6]).all()
    assert sum(looked_at) < 0.3 * 50 * 2400
    # A floor leaves only what reaches it.
    floor = best.scores[:, 2]
    again = ball_tree.search_tree(tree, order, x[:50], floor, 6)
    assert (again.scores[:, :3] == best.scores[:, :3]).all()


def test_results_repeat(spark, vectors):
    df = stored(spark.createDataFrame(vectors, VECTOR), "vectors")
    assert found(df, shard_rows=100) == found(df.repartition(7), shard_rows=300)


# --- rows that share an id


def test_unlike_texts_under_one_id_are_judged_apart(spark):
    r = random.Random(9)
    a, b, c, d = (" ".join(f"w{r.randrange(10**6)}" for _ in range(40)) for _ in range(4))
    near = " ".join([*a.split()[:-1], "other"])
    rows = [(1, a), (1, b), (2, c), (2, d), (3, a), (3, near), (3, c), (1, a), (1, b.upper()), (4, ""), (4, None), (4, " "), (None, a), (5, near), (6, d)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted(map(tuple, shingle_join.first_of_each(df).collect()), key=str)
    want = [(1, a), (1, min(b, b.upper())), (2, c), (2, d), (4, ""), (4, None), (4, " "), (None, a)]
    assert kept == sorted(want, key=str)


@pytest.mark.parametrize("x, y", [(1, 1), (1, 2), (3, 4), (7, 8), (63, 64), (90, 120), (500, 600), (9000, 7000)])
def test_sketches_bound_the_difference_of_sets(x, y):
    r = np.random.RandomState(x)
    pool = np.unique(r.randint(0, 2**62, 2 * (x + y)).astype(np.uint64) << np.uint64(2))
    for share in (0.0, 0.5, 0.9, 1.0):
        common = int(share * min(x, y))
        drawn = r.permutation(pool)[: x + y - common]
        a, b = np.sort(drawn[:x]), np.sort(np.concatenate([drawn[:common], drawn[x:]]))
        least = shingle_join.least_difference(shingle_join.sketch_of(a), shingle_join.sketch_of(b))
        assert least == shingle_join.least_difference(shingle_join.sketch_of(b), shingle_join.sketch_of(a))
        assert least <= x + y - 2 * common
        # Similar sets are never ruled out; larger ones with half of the union or less in common always are here.
        if 4 * common >= 3 * (x + y - common):
            assert 7 * least <= x + y
        elif min(x, y) > 50 and 2 * common <= x + y - common:
            assert 7 * least > x + y


def test_components_are_settled_or_refused(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {r["component"] for r in components(chain, "a", "b").collect()} == {0}
    with pytest.raises(RuntimeError):
        components(chain, "a", "b", max_rounds=1)


def test_token_files_of_repeated_ids(spark):
    texts = [(5, "one two"), (5, "three"), (5, "one two"), (None, "x"), (3, None), (1, "a b c")]
    got = token_files.document_checksums(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).collect()
    starts = sorted((r["start"], r["n_tokens"]) for r in got)
    assert [s for s, _ in starts] == [sum(n for _, n in starts[:i]) for i in range(len(starts))]
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == [None, 1, 3, 5, 5, 5]
    assert sorted(r["n_tokens"] for r in got if r["doc_id"] == 3) == [1]


def test_small_latin_words_go_to_the_model_alone():
    """The same ids as from the whole tokenizer, without its other steps."""
    known, tok = token_files.Ids(token_files.TOKENIZER), bpe.tokenizer(token_files.TOKENIZER)
    words = ["the", "thonreanly", "été", "ßçñø", "ŵȝƿ", "x" * 40]
    calls, whole = [], known.encode
    known.encode = lambda word, **how: calls.append(word) or whole(word, **how)
    for word in [*words, "'s", "7", "...", "Ab", "a b", "İ", "ªº", ""]:
        assert np.frombuffer(known[word], known.kind).tolist() == tok.encode(word, add_special_tokens=False).ids, word
    assert not set(calls) & set(words) and {"'s", "7", "Ab", "a b"} <= set(calls)
    text = "It's 'til [x]\t7km\x1c\x7f don't\n\n\"q\" <| a<|b"
    for part in (text, text[:-8], text + "é"):
        ids = np.concatenate([np.frombuffer(known[w], known.kind) for w in token_files.words_for(part)])
        assert ids.tolist() == tok.encode(part, add_special_tokens=False).ids
