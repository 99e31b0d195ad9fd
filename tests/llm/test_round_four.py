import random

import numpy as np
import pyarrow as pa

from tablewright.llm import bpe, shingle_join, token_files, toxicity


def test_latin_texts_are_split_at_white_space_and_marks_at_the_end_of_words():
    """Texts without odd marks don't go through the tokenizer's pattern; all get its ids."""
    assert token_files.words_for("It isn't so-called,\tend.\n") == ["it", "isn't", "so-called", ",", "end", "."]
    assert token_files.words_for("Élan vital, ça-là.") == ["élan", "vital", ",", "ça-là", "."]
    known, tok = token_files.Ids(token_files.TOKENIZER), bpe.tokenizer(token_files.TOKENIZER)
    rng, pieces = random.Random(4), [*"aZé9'.,!<|-×«ªµß \t\n\x0b\x1c\x1f\x85\xa0Ÿǅ", "word", "'s", "don't", "..", "12", "<|end|>", "ς", ". ", ", "]
    for _ in range(3000):
        text = "".join(rng.choices(pieces, k=rng.randrange(1, 12)))
        got = np.frombuffer(b"".join(known[w] for w in token_files.words_for(text)), known.kind)
        assert got.tolist() == tok.encode(text, add_special_tokens=False).ids, text


def test_pairs_are_bounded_and_one_a_class_before_larger_facts_join(spark):
    """Sizes, parities and shared signatures rule pairs out at once; of a class's other pairs one goes on."""
    facts = spark.createDataFrame([(c, n, p, 0, 0, 0) for c, n, p in [(1, 100, 0), (2, 100, 1), (3, 100, -1), (4, 200, 0), (5, 96, 0)]], "class long, n long, p0 long, p1 long, p2 long, p3 long")
    pairs = [(1, 2, 9), (1, 3, 50), (1, 4, 50), (1, 5, 8), (2, 5, 8), (3, 5, 60), (2, 3, 1)]
    shared = spark.createDataFrame(pairs, "a long, b long, shared long")
    left = shingle_join.allowed(shared, facts)
    # 64 differing bits are more than 200 / 7; 200 is more than 4 / 3 of 100; one shared signature of three.
    assert sorted((r["a"], r["b"]) for r in left.collect()) == [(1, 2), (1, 5), (2, 5)]
    assert sorted(map(tuple, shingle_join.most_often(left).collect())) == [(1, 2, 9, 100, 100), (1, 5, 8, 100, 96)]


def test_scoring_sums_no_pairs_and_holds_few_rows():
    """The same scores from a batch of any size, a few rows and words at a time."""
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["ab", "cd", "badword", "ef."], rng.integers(0, 40))) for _ in range(1300)]
    model = toxicity.Field(dict.fromkeys(toxicity.features("badword"), 2.0), np.array([0.1, -0.1, -0.2, 0.2]), np.array([-3.0, 1.0, 2.0]))
    table = pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})
    sizes = [b.num_rows for b in toxicity.slices(iter([table]))]
    assert sum(sizes) == len(texts) and max(sizes) <= 500
    got = np.concatenate([b.column("score").to_numpy() for b in toxicity._scored(model, 0.7)(iter([table]))])
    emissions = toxicity.Emissions(model.weights)
    for i in range(0, len(texts), 100):
        words = texts[i].split()
        p, _ = toxicity.marginals(np.array([emissions[w] for w in words]), np.array([len(words)]), model.steps)
        curve = toxicity.aggregates(p, np.array([len(words)])) @ model.curve
        assert abs(got[i] - 1 / (1 + np.exp(-curve[0]))) < 1e-12
