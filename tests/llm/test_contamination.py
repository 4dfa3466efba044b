import random
import re

import numpy as np

from tidemark.llm import contamination


def longest(x, y):
    row = [0] * (len(y) + 1)
    for a in x:
        before = 0
        for j, b in enumerate(y):
            before, row[j + 1] = row[j + 1], before + 1 if a == b else max(row[j + 1], row[j])
    return row[-1]


def test_common_length_equals_the_table():
    rng = np.random.default_rng(2)
    for _ in range(200):
        x, y = rng.integers(0, 6, rng.integers(1, 30)), rng.integers(0, 6, rng.integers(0, 40))
        assert contamination.common_length(x, y) == longest(x.tolist(), y.tolist())


def test_planted_items_are_found_and_clean_documents_left(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 8))) for _ in range(900)] + ["the", "of", "and"] * 150
    items = [(i, " ".join(rng.choices(words, k=rng.choice([14, 30, 70]))) + ".") for i in range(20)]
    docs, want = [(0, None), (1, "")], set()
    for d in range(2, 150):
        own = rng.choices(words, k=rng.randint(5, 400))
        if d % 5 == 0:
            number, text = items[d % 20]
            body = text.split(" ")
            if d % 2:  # a paraphrase: a word in eight is another
                body = [rng.choice(words) if i % 8 == 3 else w for i, w in enumerate(body)]
            spot = rng.randrange(len(own))
            own[spot:spot] = body
            want.add((d, number))
        docs.append((d, " ".join(own)))
    docs += [docs[10], (None, items[3][1])]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int").repartition(3)
    bench = spark.createDataFrame([*items, (77, None), (78, ""), (None, "x")], "item_id long, text string")
    got = contamination.contaminated(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want | {(None, 3)}
    assert sum(r.doc_id == 10 for r in got) == 2
    assert contamination.contaminated(df.limit(0), bench).count() == 0
    assert contamination.contaminated(df, bench.limit(0)).count() == 0


def test_an_item_that_a_third_of_short_rows_hold_is_found(spark):
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(4, 8))) for _ in range(3000)]
    items = [(i, " ".join(rng.sample(words, 55)) + ".") for i in range(30)]
    docs, want = [], set()
    for d in range(300):
        own = rng.choices(words, k=rng.randint(60, 90) if d % 3 == 0 else rng.randint(40, 100))
        if d % 3 == 0:
            spot = rng.randrange(len(own))
            own[spot:spot] = items[0][1].split(" ")
            want.add((d, 0))
        docs.append((d, " ".join(own)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = contamination.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want


def test_every_verbatim_item_is_found_amid_a_repeated_word_of_another_item(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(4, 8))) for _ in range(2000)]
    items = [(i, " ".join(rng.sample(words, rng.choice([15, 20, 50]))) + ".") for i in range(60)]
    docs = []
    for d in range(300):
        own = [rng.choice(items[(d + 1) % 60][1].rstrip(".").split(" "))] * rng.randint(30, 200)
        spot = rng.randrange(len(own))
        own[spot:spot] = items[d % 60][1].split(" ")
        docs.append((d, " ".join(own)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = contamination.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(d, d % 60) for d in range(300)}


def test_each_spot_is_judged_by_its_own_shares(spark):
    item, answer = [f"ask{i}" for i in range(40)], [f"told{i}" for i in range(10)]
    other = iter(f"other{i}" for i in range(10_000))

    def spot(asked, told):  # the first words of both parts, the rest replaced
        return [w if i < asked else next(other) for i, w in enumerate(item)] + [w if i < told else next(other) for i, w in enumerate(answer)]

    gap = lambda: [next(other) for _ in range(300)]
    first, second = spot(25, 5), spot(20, 9)  # shares 0.60 and 0.58, answers 0.5 and 0.9
    docs = [(1, first), (2, second), (3, first + gap() + second), (4, second + gap() + first)]
    df = spark.createDataFrame([(d, " ".join(x)) for d, x in docs], "doc_id long, text string")
    got = contamination.contaminated(df, spark.createDataFrame([(9, f"{' '.join(item)}. {' '.join(answer)}")], "item_id long, text string")).collect()
    assert sorted((r.doc_id, round(r.common_share, 2), round(r.answer_share, 2)) for r in got) == [(d, 0.58, 0.9) for d in (2, 3, 4)]


def test_latent_space_retrieves_what_a_search_over_all_pairs_finds(spark):
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 8))) for _ in range(600)] + ["the", "of", "and", "to"] * 100
    items = [(i, " ".join(rng.choices(words, k=rng.choice([16, 28, 48]))) + ".") for i in range(12)]
    docs = []
    for d in range(70):
        own = rng.choices(words, k=rng.randint(20, 160))
        if d % 3:
            body = items[d % 12][1].split(" ")
            changed = rng.choice([0, 8, 5, 3])  # verbatim, and paraphrases of growing distance
            body = [rng.choice(words) if changed and i % changed == 1 else w for i, w in enumerate(body)]
            spot = rng.randrange(len(own))
            own[spot:spot] = body
        docs.append((d, " ".join(own)))
    number: dict[str, int] = {}
    coded = lambda text: np.array([number.setdefault(w, len(number)) for w in re.findall("[a-z]+", text)])
    want = set()
    for d, text in docs:
        x = coded(text)
        for i, item in items:
            y = coded(item)
            long = len(y) + max(2, len(y) // 4)
            if max(contamination.common_length(y, x[a : a + long]) for a in range(len(x))) >= 0.7 * len(y):
                want.add((d, i))
    got = contamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect()
    near = {(r.doc_id, r.item_id): r.path for r in got if r.common_share >= 0.7}
    assert set(near) == want and len(want) > 30
    assert sum(p == "cosine" for p in near.values()) >= 0.9 * len(want)
    assert all(r.path == "cosine" for r in got if r.common_share < 0.7)  # paraphrases further off come through the latent space alone
