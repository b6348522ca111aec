import random

import numpy as np
import pytest
import xxhash

from gradeloom.llm.components import components
from gradeloom.llm.simhash import fingerprint_links, hex_fingerprint, near_duplicate_groups


def brute_fingerprint(text, shingle):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\v\f\r":
        lowered = lowered.replace(space, " ")
    words = [w for w in lowered.split(" ") if w]
    runs = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows, shingle, max_bits):
    prints = [brute_fingerprint(text, shingle) for _, text in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= max_bits:
                group[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return sorted(((d, f"{prints[i]:016x}", least.get(root(i))) for i, (d, _) in enumerate(rows)), key=repr)


def some_rows():
    rng = random.Random(3)
    words = ["Über", "the", "Of", "ça", "x1", "don't", "THE"]
    base = [rng.choice(words) for _ in range(120)]
    rows = [(i, " ".join(base[:60] + [str(i)] + base[60:])) for i in range(20)]
    rows += [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))) for i in range(40)]
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, "one"), (204, "one  two"), (203, "one"), (7, "other text with an id used twice"), (None, "one")]
    rows.append((300, "long word " * 30_000))
    return rows


@pytest.mark.parametrize("shingle,max_bits", [(3, 3), (5, 4)])
def test_groups_equal_brute_force(table, shingle, max_bits):
    rows = some_rows()
    got = near_duplicate_groups(table(rows), shingle=shingle, max_bits=max_bits)
    found = [tuple(r) for r in got.select("doc_id", hex_fingerprint(), "component_id").collect()]
    assert sorted(found, key=repr) == brute_groups(rows, shingle, max_bits)
    chosen = got.filter("first_of_group").groupBy("component_id").count()
    assert all(n == 1 for _, n in chosen.collect())
    assert got.filter("first_of_group").count() == got.select("component_id").distinct().count()


def test_crowded_buckets_are_dealt_out_again(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    prints = {base}
    for _ in range(400):
        prints.add(rng.choice(sorted(prints)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    prints |= {rng.getrandbits(64) for _ in range(200)}
    values = np.array(sorted(prints), np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(v,) for v in values], "fingerprint long")
    expected = brute_components(values)
    for limit in (4096, 8):
        links = fingerprint_links(frame, max_bits=3, max_bucket=limit)
        got = {frozenset(g) for (g,) in components(links).groupBy("root").agg({"node": "collect_set"}).select("collect_set(node)").collect()}
        assert got == expected


def brute_components(values):
    left, found = set(values), set()
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            x = todo.pop()
            group.add(x)
            near = {y for y in left if ((x ^ y) & (2**64 - 1)).bit_count() <= 3}
            left -= near
            todo += near
        if len(group) > 1:
            found.add(frozenset(group))
    return found


def test_long_chain_and_star_are_components(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (2000, 2001), (2001, 2000)]
    roots = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert roots == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}, 2000: 2000, 2001: 2000}


def test_empty_table_and_clashing_names(spark):
    schema = "doc_id long, text string, fingerprint string, component_id string, _row int, first_of_group int"
    assert near_duplicate_groups(spark.createDataFrame([], schema)).count() == 0
    got = near_duplicate_groups(spark.createDataFrame([(1, "a", "x", "y", 1, 2)], schema)).collect()
    assert got[0].component_id == 1 and got[0].first_of_group is True
