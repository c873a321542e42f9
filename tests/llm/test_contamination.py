"""Held-out passages: whole, in part, changed, and too short."""

import random

from acequia.llm.contamination import MIN_WORDS, find_contamination, longest_stretch

random.seed(8)
VOCAB = [a + b for a in "ma ro ti le su pa co".split() for b in "der lin sor tac ven bis gol".split()]
ITEMS = {i: " ".join(random.choice(VOCAB) for _ in range(60)).capitalize() + f". En Brumeda el grupo midió {i + 3} km." for i in range(6)}
BODY = "Texto cualquiera del puesto que no contiene nada de lo buscado. "


def words(i):
    return ITEMS[i].split()


def docs():
    changed = [w if k % 9 else "otra" for k, w in enumerate(words(2))]
    return [
        (1, BODY + ITEMS[0] + BODY, {0}), (2, ITEMS[0].upper().replace(" ", "\r\n> "), {0}), (3, BODY + " ".join(words(1)[10:26]), {1}), (4, BODY + " ".join(words(1)[10:23]), set()),
        (5, " ".join(changed), {2}), (6, BODY * 300 + "«" + ITEMS[3] + "»" + ITEMS[4], {3, 4}), (7, BODY, set()), (8, None, set()), (9, "", set()), (10, " \n", set()), (11, BODY + ITEMS[0] + BODY, {0}),
        (12, " ".join(reversed(words(5))), set()),
    ]


def test_found_items(spark):
    rows = docs()
    d = spark.createDataFrame([(k, t, "x") for k, t, _ in rows], "doc_id bigint, text string, item string")
    e = spark.createDataFrame([*[(i, "es", t) for i, t in ITEMS.items()], (98, "es", None), (99, "es", "")], "item_id bigint, lang string, text string")
    got = find_contamination(d, e).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == sorted((k, i) for k, _, s in rows for i in s)
    assert find_contamination(d.limit(0), e).collect() == [] and find_contamination(d, e.limit(0)).collect() == []


def test_stretch():
    item = [f"w{i}" for i in range(40)]
    assert longest_stretch(item, item, 0) == 40 and longest_stretch(["x", *item], item, 1) == 40 and longest_stretch(item, item, 3) == 0
    broken = item[:20] + ["a", "b"] + item[22:]
    assert longest_stretch(broken, item, 0) == 20
    assert longest_stretch(item[:MIN_WORDS], item, 0) == MIN_WORDS


def test_refilled_slots_must_be_consistent():
    names = frozenset(["ana", "leo", "eva"])
    item = ["ana" if i % 8 == 0 else f"w{i}" for i in range(32)]
    same = ["leo" if w == "ana" else w for w in item]
    assert longest_stretch(same, item, 0, names) == 32


def test_short_items_and_changed_words_against_brute_force(spark):
    """Every item of 1 to 24 words with every one word changed, against comparing all alignments."""
    rnd = random.Random(3)
    items = {n: [f"q{n}w{i}{rnd.randrange(99)}x" for i in range(n)] for n in range(1, 25)}
    texts, k = {}, 0
    for n, own in items.items():
        for i in range(-1, n):
            k += 1
            texts[k] = ["aa", "bb"] + [w if j != i else "otra" for j, w in enumerate(own)] + ["cc"]
    want = {
        (d, n) for d, t in texts.items() for n, own in items.items()
        if any(longest_stretch(t, own, g) >= min(MIN_WORDS, n) for g in range(-n, len(t)))
    }
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id bigint, text string")
    e = spark.createDataFrame([(n, " ".join(t)) for n, t in items.items()], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in find_contamination(d, e).collect()} == want and len(want) > 100
