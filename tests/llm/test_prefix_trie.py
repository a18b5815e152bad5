import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tessera.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string, key string, n long"


def brute_force(rows):
    said = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            h = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            said[c].append(((turn is not None, turn or 0), role, h, text))
    said = {c: [(r, x) for _, r, _, x in sorted(v)] for c, v in said.items()}
    built = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(said.get(c - c % 20, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = {}
    for node in sorted(members, key=len, reverse=True):
        mine = members[node]
        words = len(node[-1][1].split()) if node else 0
        below = [out[x] for x in children[node]]
        ends = ",".join(map(str, sorted(c for c in mine if built[c] == node)))
        out[node] = (min(mine), len(node), min(members[node[:-1]]) if node else None, len(mine), len(below),
                     sum(x[5] for x in below) or 1, (len(mine) - 1) * words + sum(x[6] for x in below),
                     hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=str)


def some_rows(seed, convs, longest, pool):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(3 * convs), convs):
        first = rng.choice([0, None, -3])
        for i in range(rng.randint(1, longest)):
            rows.append((c, first if i == 0 else i, rng.choice(["user", "bot", None]) if pool > 1 else "user",
                         rng.choice([None, "", "a b", "É  c\n", "d"][:pool])))
    rng.shuffle(rows)
    return rows


def run(spark, rows, partitions=3):
    frame = spark.createDataFrame([(*r, "x", 5) for r in rows], SCHEMA).repartition(partitions)
    return sorted(map(tuple, T.prefix_trie(frame).collect()), key=str)


@pytest.mark.parametrize("seed,convs,longest,pool", [(1, 60, 6, 3), (2, 40, 3, 1), (3, 12, 40, 1), (4, 30, 5, 5)])
def test_matches_brute_force(spark, seed, convs, longest, pool):
    rows = some_rows(seed, convs, longest, pool)
    assert run(spark, rows) == brute_force(rows)


def test_conversations_over_several_bands_and_levels(spark):
    """Depths around the band borders, and more turns than HEIGHT bands hold."""
    rows = [(c, i, "u", "same") for c, n in ((0, 15), (20, 16), (40, 17), (60, 31), (80, 32), (100, 33), (120, 300)) for i in range(n)]
    rows += [(140, i, "u", "same" if i < 259 else "other words") for i in range(262)]
    assert run(spark, rows) == brute_force(rows)


def test_ties_nulls_long_texts_and_missing_heads(spark):
    rows = [(21, None, "u", "b"), (21, None, "u", "a"), (21, None, "u", "a"), (21, 1, None, None), (None, 1, "u", "x"),
            (22, 1, "u", "only"), (23, 5, "u", "w " * 30_000), (-5, 1, "u", "neg"), (0, 1, "u", "head"), (1, 1, "u", "head"), (2, 9, "", "")]
    rows = [r for r in rows if r[0] is None or r[0] >= 0]
    assert run(spark, rows) == brute_force(rows)


def test_copies_and_one_common_first_turn(spark):
    rows = [(c, i, "u", f"t{i}") for c in range(150) for i in range(4)] + [(c, i, "u", f"{c if i else 'first'}") for c in range(200, 300) for i in range(3)]
    assert run(spark, rows) == brute_force(rows)


def test_empty_table_and_no_ids(spark):
    assert run(spark, [(None, 1, "u", "x")]) == []
    assert T.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_conversation_with_most_turns_over_many_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", 7)
    rows = [(20, i, "u", f"x{i % 5}") for i in range(500)] + [(c, i, "u", f"x{i % 5}") for c in range(21, 40) for i in range(3)]
    assert run(spark, rows, 5) == brute_force(rows)
