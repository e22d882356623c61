"""Exact groups, SimHash components and mixing against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import xxhash

from matchlode.llm.exact_dedup import exact_groups
from matchlode.llm.mixing import mix_sources
from matchlode.llm.simhash import fingerprint_components, near_duplicates

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_groups(rows):
    groups = defaultdict(list)
    for doc, text, *_ in rows:
        groups[(text or "").translate(UPPER)].append(doc)
    out = []
    for text, docs in groups.items():
        keep = max((d for d in docs if d is not None), default=None)
        out += [(d, keep, len(docs), d == keep, hashlib.sha256(text.encode()).hexdigest()) for d in docs]
    return sorted(out, key=str)


def groups(df, **more):
    return sorted(map(tuple, exact_groups(df, **more).collect()), key=str)


def test_exact_groups(frame):
    rows = [(i, random.Random(i).choice(["Aa", "aA", "b", "É", "é", "c d", "c  d"])) for i in range(60)]
    rows += [(100, None), (101, ""), (None, "b"), (None, "alone"), (3, "unique"), (3, "unique")]
    assert groups(frame(rows)) == brute_groups(rows)
    assert groups(frame(rows), hot=1) == brute_groups(rows)


def test_exact_groups_of_an_empty_table(frame):
    assert exact_groups(frame([(1, "a")]).filter("false")).count() == 0


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(values, linked):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_near_duplicates(frame):
    rnd = random.Random(4)
    rows = []
    for i in range(40):
        w = [f"w{rnd.randrange(50)}" for _ in range(rnd.randrange(0, 80))]
        rows.append((len(rows), " ".join(w)))
        for _ in range(rnd.randrange(3)):
            if w:
                w = list(w)
                w[rnd.randrange(len(w))] = "Z"
            rows.append((len(rows), " ".join(w).upper() if rnd.random() < 0.3 else " ".join(w)))
    rows += [(900, None), (901, ""), (902, "one"), (903, "one two"), (903, "one two")]
    fps = [brute_fingerprint(t) for _, t in rows]
    root = roots(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    want = sorted((d, fps[i], min(rows[j][0] for j in range(len(rows)) if root[j] == root[i])) for i, (d, _) in enumerate(rows))
    assert sorted((r.doc_id, r.fp % 2**64, r.component_id) for r in near_duplicates(frame(rows)).collect()) == want


def test_components_find_every_link_up_to_three_bits(spark):
    rng = np.random.default_rng(0)
    fps = []
    for b in rng.integers(0, 2**64, 60, dtype=np.uint64):
        fps.append(int(b))
        for _ in range(rng.integers(0, 7)):
            x = fps[-1] if rng.random() < 0.6 else int(b)
            for bit in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(bit)
            fps.append(x)
    fps = sorted(set(fps))
    root = roots(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")
    got = {r.fp % 2**64: r.comp for r in fingerprint_components(df).collect()}
    assert len({(root[i], got[x]) for i, x in enumerate(fps)}) == len(set(root)) == len(set(got.values()))


def test_a_null_id_names_no_component(frame):
    got = {(r.doc_id, r.component_id) for r in near_duplicates(frame([(None, "a b c d"), (5, "a b c d"), (None, "q r s t")])).collect()}
    assert got == {(None, 5), (5, 5), (None, None)}


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight, cap, left = {s: i % 3 + 1 for i, s in enumerate(names)}, {s: 3.0 * sizes[s] for s in names}, float(sum(sizes.values()))
    target, free = {}, set(names)
    while free:
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * unit >= cap[s]}
        if not over:
            target |= {s: weight[s] * unit for s in free}
            break
        for s in over:
            target[s] = cap[s]
            left -= cap[s]
        free -= over
    return target


def test_mixing(frame):
    rnd = random.Random(8)
    rows = [(i, "w " * rnd.randrange(0, 30), "en", rnd.choice(["a", "a", "a", "b", "c", "d", None, "é"])) for i in range(400)]
    rows += [(1000, "w " * 5, "en", "tiny"), (1001, None, "en", "empty")]
    got = mix_sources(frame(rows)).collect()
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len((t or "").split())
    want = brute_targets(sizes)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source]
        assert r.taken == r["size"] * r.copies and r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    assert len(got) == len(rows)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]
    again = mix_sources(frame(rows[::-1])).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mixing_without_words(frame):
    assert [(r.target, r.taken) for r in mix_sources(frame([(1, None, None, "a"), (2, " ", None, None)])).collect()] == [(0.0, 0)] * 2
    assert mix_sources(frame([(1, "a")]).filter("false")).count() == 0


def test_mixing_repeated_rows(frame):
    got = mix_sources(frame([(1, "a b", None, "s")] * 4 + [(None, "c", None, "s")])).collect()
    assert len(got) == 5 and sum(r.taken for r in got) == 9


CLASHING = ("h", "key", "bucket", "kind", "fp", "version", "draw", "size", "copies", "known", "paths", "spread", "held_out", "text_to_scan", "id", "media", "ids", "keep_0", "digest")


def test_clashing_columns_and_partitions_change_nothing(frame, spark):
    from pyspark.sql import functions as F

    from matchlode.llm import language_model, line_dedup, media, substring_dedup

    rows = [(i, f"line {i % 5} a b c\nsecond {i % 3} d e f g\nthird\n" + "w " * (i % 20), "en", f"s{i % 4}") for i in range(60)]
    plain, more = frame(rows), frame(rows).repartition(7)
    for c in CLASHING:
        more = more.withColumn(c, F.lit(f"x {c}"))
    makers = {
        "spans": substring_dedup.remove_repeated_spans,
        "lines": line_dedup.remove_repeated_lines,
        "groups": exact_groups,
        "mix": mix_sources,
        "near": near_duplicates,
        "model": language_model.score_documents,
        "media": lambda d: media.store_audio(d),
    }
    for name, make in makers.items():
        assert sorted(map(str, make(plain).collect())) == sorted(map(str, make(more).collect())), name
    spark.conf.set("spark.sql.shuffle.partitions", "300")  # more buckets
    try:
        assert sorted(map(str, substring_dedup.remove_repeated_spans(plain).coalesce(1).collect())) == sorted(map(str, substring_dedup.remove_repeated_spans(more).coalesce(1).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
