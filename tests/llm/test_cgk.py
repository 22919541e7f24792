"""How far the walks alone get, without the grams beside them."""

import random

from larkspur.llm import decontamination

R = random.Random(2)
LETTERS = {"latin": "etaoinshrdlucmfwyp", "cyrillic": "оеаинтсрвлкмдпуяыь"}


def prose(letters, n, words=[]):  # noqa: B006
    key = (letters, 400)
    if not any(k == key for k, _ in words):
        words.append((key, ["".join(R.choice(letters) for _ in range(R.randint(3, 11))) for _ in range(400)]))
    vocabulary = next(v for k, v in words if k == key)
    out = ""
    while len(out) < n:
        out += R.choice(vocabulary) + " "
    return out[:n].strip()


def edited(text, n, letters):
    t = list(text)
    for _ in range(n):
        k = R.randrange(len(t))
        t[k : k + 1] = R.choice(([], [R.choice(letters)], [t[k], R.choice(letters)]))
    return "".join(t)


def even(text, every, letters):
    """Letters replaced at even distances, from some place on."""
    t = list(text)
    for k in range(R.randrange(every), len(t), every):
        t[k] = R.choice([c for c in letters if c != t[k]])
    return "".join(t)


def even_recall(letters, length, every, n=60):
    items = [prose(letters, length) for _ in range(n)]
    index = decontamination.Index(list(enumerate(items)))
    texts = [f"{prose(letters, 100)} {even(t, every, letters)} {prose(letters, 100)}" for t in items]
    held = {k for k, t in enumerate(items) if decontamination.edit_distance_within(t, " ".join(texts[k].split())) <= int(len(t) * 0.2 + 1e-9)}
    return len(held & {k for k, i, *_ in index.hits(texts) if k == i}) / max(1, len(held)), len(held)


def test_recall_of_edits_at_even_distances():
    for script, letters in LETTERS.items():
        for length in (20, 40, 64, 80, 120, 200, 400):
            for every in (5, 6, 7, 8, 10, 20):
                found, held = even_recall(letters, length, every)
                assert found >= 0.9, (script, length, every, found, held)


def recall(letters, length, share, grams):
    items = [prose(letters, length) for _ in range(60)]
    index = decontamination.Index(list(enumerate(items)))
    if not grams:
        index.tiers = lambda similarity: []
    texts = [f"{prose(letters, 100)} {edited(t, int(len(t) * share), letters)} {prose(letters, 100)}" for t in items]
    held = {k for k, t in enumerate(items) if decontamination.edit_distance_within(t, " ".join(texts[k].split())) <= int(len(t) * 0.2 + 1e-9)}
    return len(held & {k for k, i, *_ in index.hits(texts) if k == i}) / max(1, len(held))


def test_recall_in_both_scripts():
    for letters in LETTERS.values():
        for length in (20, 40, 80, 200, 400):
            assert all(recall(letters, length, share, True) >= 0.9 for share in (0.02, 0.1, 0.2))


def test_walks_alone_find_few_edits():
    assert min(recall(LETTERS["latin"], length, 0.02, False) for length in (130, 200, 400)) >= 0.9


if __name__ == "__main__":
    for script, letters in LETTERS.items():
        for length in (80, 130, 200, 400):
            print(script, length, *[(share, round(recall(letters, length, share, False), 2), round(recall(letters, length, share, True), 2)) for share in (0.02, 0.05, 0.1, 0.15, 0.2)])
            print("    even", *[(every, *even_recall(letters, length, every)) for every in (5, 6, 7, 8, 10)])
