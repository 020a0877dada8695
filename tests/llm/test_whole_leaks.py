"""Short stretches with substitutions at any places."""

from itertools import combinations

import numpy as np

from lectern.llm import decontaminate


def seen(length, gone, mask):
    return any(not any(mask[g - at] == "1" for g in gone if 0 <= g - at < len(mask)) for at in range(length - len(mask) + 1))


def test_masks_leave_no_placement_out():
    for n in range(13, 21):
        assert all(any(seen(n, gone, m) for m in decontaminate.MASKS) for gone in combinations(range(n), n // 5)), n
    for n in range(1, 13):
        assert all(any(seen(n, gone, m) for m in decontaminate.short_masks(n)) for gone in combinations(range(n), n // 5)), n


def test_longest_stretch():
    for seed in range(60):
        equal = np.random.default_rng(seed).random(seed % 30) < 0.7
        want = max((b - a for a in range(len(equal) + 1) for b in range(a, len(equal) + 1) if 5 * equal[a:b].sum() >= 4 * (b - a)), default=0)
        length, same = decontaminate.longest_stretch(equal, 0.8)
        assert length == want and 5 * same >= 4 * length


def test_short_stretches_with_substitutions(spark):
    word = [f"w{i}" for i in range(60)]
    items = [(1, " ".join(word[:30])), (2, " ".join(word[40:48]))]
    rows, k = [], 0
    for gone in combinations(range(13), 2):
        rows.append((k, "pad " + " ".join("x" if j in gone else w for j, w in enumerate(word[8:21])) + " end"))
        k += 1
    rows += [(1000 + j, "so " + " ".join("y" if i == j else w for i, w in enumerate(word[40:48])) + " it is") for j in range(8)]
    rows += [(2000, " ".join(word[:9])), (2001, " ".join(word[40:46]))]
    found = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    for r in found:
        assert r["items"] == ([] if r["doc_id"] >= 2000 else [2] if r["doc_id"] >= 1000 else [1]), r
