"""Cases that earlier versions of the operators cut short."""

import itertools

import numpy as np

from lectern.llm import minhash


def test_centres_leave_only_buckets_where_they_were_compared(spark):
    """Buckets made by hand: p is of bucket 1's largest part and a stray in bucket 2; only q, in bucket 1, is like p.

    Further buckets overlap at random and have several strays each.
    """
    rng = np.random.default_rng(11)
    line = lambda tag, a: " ".join(f"{tag}{i}" for i in range(a, a + 100))
    texts = {"p1": line("p", 0), "p2": line("p", 1), "p": line("p", 8), "q": line("p", 20), "z0": line("z", 0), "z1": line("z", 1), "z2": line("z", 2)}
    name = {k: minhash.class_of(minhash.shingle_sets([t.encode()])[0]) for k, t in texts.items()}
    other = next(t for t in (line(f"r{i}x", 0) for i in range(1000)) if minhash.class_of(minhash.shingle_sets([t.encode()])[0]) < name["q"])
    texts["r"] = other
    texts |= {f"{f}{k}": line(f, int(a)) for f in ("e", "f", "g", "h") for k, a in enumerate(np.cumsum(rng.integers(4, 14, 10)))}
    sets = {k: minhash.shingle_sets([t.encode()])[0] for k, t in texts.items()}
    name = {k: minhash.class_of(s) for k, s in sets.items()}
    buckets = {1: ["p1", "p2", "p", "q", "r"], 2: ["z0", "z1", "z2", "p"]}
    loose = [k for k in texts if k[0] in "efgh"]
    buckets |= {b: [str(x) for x in rng.choice(loose, 7, replace=False)] for b in range(3, 15)}
    sketch = minhash.sketches(list(sets.values()))
    marks = dict(zip(sets, minhash.marks_of(sketch).tolist()))
    used = {k for held in buckets.values() for k in held}
    nodes = [(bytearray(name[k]), [b for b, held in buckets.items() if k in held], marks[k]) for k in used]
    members = [(b, bytearray(name[k]), len(sets[k]), bytearray(name[held[0]])) for b, held in buckets.items() for k in held]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts.values())], "doc_id long, text string")
    got = minhash._components(
        docs,
        spark.createDataFrame(members, "bucket long, node binary, n long, low binary"),
        spark.createDataFrame(nodes, "node binary, bands array<long>, marks array<long>"),
        75,
    ).collect()
    part = {bytes(r["node"]): bytes(r["part"]) for r in got}
    group = {k: k for k in used}
    for held in buckets.values():
        for a, b in itertools.combinations(held, 2):
            common = len(np.intersect1d(sets[a], sets[b]))
            if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                old, new = group[a], group[b]
                group = {k: new if g == old else g for k, g in group.items()}
    assert group["p"] == group["q"] == group["p1"] != group["z0"]
    for a, b in itertools.combinations(sorted(used), 2):
        assert (part[name[a]] == part[name[b]]) == (group[a] == group[b]), (a, b)
