"""The pipeline's near stage against all pairs by their five-word Jaccard similarity."""

import random

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)}


def edited_copies():
    """Texts of 6 to 1000 words, each with copies in which up to a forty-fifth of the words differs, some of copies."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    texts = [None, "", "One two", "one TWO", "one two three"]
    for n in [6, 20, 50, 100, 100, 300, 1000] * 4:
        family = [[word() for _ in range(n)]]
        for _ in range(8):
            w = list(rng.choice(family))
            for i in rng.sample(range(n), rng.randint(1, max(1, n // 45))):
                w[i] = word()
            family.append(w)
        texts += [" ".join(w) for w in family]
    return list(enumerate(texts))


def truth(rows):
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    for i, j in pairs:
        x, y = sorted((find(i), find(j)))
        root[y] = x
    return pairs, [find(i) for i in range(len(rows))]


def test_near_stage_is_that_of_all_pairs(spark):
    rows = edited_copies()
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    pairs, roots = truth(rows)
    assert len(pairs) > 100
    kept = corpus_pipeline.near(spark, df, "")
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(roots))
    assert corpus_pipeline.near(spark, df.limit(0), "").count() == 0


def test_near_stage_keeps_one_row_a_class(spark):
    """Null ids come last, and neither null nor repeated ids let a second row of a class stay."""
    rng = random.Random(6)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(100)] for _ in range(4)]
    copy = lambda k, n: " ".join(base[k][:-1] + [f"end{n}"])
    rows = [(None, copy(0, n)) for n in range(3)] + [(None, copy(1, 0)), (9, copy(1, 1)), (8, copy(1, 2))] + [(4, copy(2, 0)), (4, copy(2, 1))] + [(None, copy(3, 0))]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    kept = corpus_pipeline.near(spark, df, "").collect()
    assert sorted(r["text"].split()[0] for r in kept) == sorted(b[0] for b in base)
    assert sorted(str(r["doc_id"]) for r in kept) == ["4", "8", "None", "None"]
