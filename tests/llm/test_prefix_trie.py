"""The conversation trie against a plain version, and the radix tree's layouts."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from flowguard.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, key string, path string, first int"


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            sha = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            convs[c].append(((turn is not None, turn or 0), role, sha, text))
    convs = {c: [(r, t) for _, r, _, t in sorted(v)] for c, v in convs.items()}
    rebuilt = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(convs.get(c - c % 100, [])[:h] + own[h:])
    nodes = defaultdict(set)
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            nodes[path[:d]].add(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        childless = [p for p in below if not any(len(q) == len(p) + 1 and q[:-1] == p for q in nodes)]
        ends = ",".join(map(str, sorted(c for c in members if rebuilt[c] == path)))
        out.append((
            min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members),
            sum(len(p) == len(path) + 1 and p[:-1] == path for p in nodes), len(childless),
            sum((len(nodes[p]) - 1) * (len(p[-1][1]) if p else 0) for p in below), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def got(spark, rows, parts=4):
    frame = spark.createDataFrame([(*r, "k", "p", 1) for r in rows], SCHEMA).repartition(parts)
    return sorted(map(tuple, prefix_trie.conversation_trie(frame).drop("key").collect()), key=str)


def conversations(seed):
    rng = random.Random(seed)
    turns = [(rng.choice(["user", "assistant", "", None]), rng.choice(["héllo", "yes", "", None, "a longer text " * 9, "no"])) for _ in range(7)]
    rows = []
    for c in [*range(40), *range(100, 130), 200, 205, 399, 1000, 1001, 1050]:
        for t in range(rng.randint(1, 6)):
            rows.append((c, rng.choice([t, t, t, None]), *rng.choice(turns)))
    rows += [(None, 0, "user", "none"), (300, 0, "user", "x"), (300, 0, "user", "x"), (301, 0, "user", "x"), (301, 1, "user", "𝔘" * 30000)]
    return rows + [(302, t, "user", f"turn {t % 3}") for t in range(60)] + rows[:5]


def test_nodes_match_a_plain_version(spark, monkeypatch):
    rows = conversations(1)
    assert got(spark, rows) == brute(rows)
    monkeypatch.setattr(prefix_trie, "TREE_BYTES", 300)
    rows = conversations(2)
    assert got(spark, rows) == brute(rows)


def test_a_shared_first_turn_and_equal_conversations(spark):
    rows = [(c, t, "user", f"turn {t}" if t < 2 or c % 3 else f"own {c} {t}") for c in range(0, 240) for t in range(8)]
    assert got(spark, rows) == brute(rows)


def test_no_rows_and_no_turns_left(spark):
    assert got(spark, []) == []
    short = [c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 0][:3]
    rows = [(c, 0, "user", "gone") for c in short]
    want = [(short[0], 0, None, 3, 0, 1, 0, hashlib.sha256(",".join(map(str, short)).encode()).hexdigest())]
    assert got(spark, rows) == brute(rows) == want


@pytest.mark.parametrize("fanout", [3, 15, 16, 17, 47, 48, 49, 200, 256])
def test_layouts_grow_and_keep_their_children(fanout):
    rng = random.Random(fanout)
    first = rng.sample(range(256), fanout)
    node = prefix_trie.Node(b"")
    for b in first:
        node.put(prefix_trie.Node(bytes([b, 1])))
    for b in first:
        node.put(prefix_trie.Node(bytes([b, 2])))
    assert sorted(k.edge[0] for k in node.children()) == sorted(first)
    assert all((node.child(b).edge[1] == 2) if b in first else node.child(b) is None for b in range(256))


def test_tree_rows_follow_the_paths():
    rng = random.Random(4)
    ids = [bytes(rng.choices(range(3), k=prefix_trie.DIGEST)) + n.to_bytes(4) for n in (1, 2, 5, 9)]
    paths = {c: [rng.choice(ids) for _ in range(rng.randint(0, 6))] for c in range(80)}
    tree = prefix_trie.Tree()
    for c, path in paths.items():
        tree.add(c, b"".join(path), 1 << 62, False)
    counts = defaultdict(int)
    for path in paths.values():
        for d in range(len(path) + 1):
            counts[d, tuple(path[:d])] += 1
    rows = [r for r in tree.rows() if r[-1] is None]
    assert sorted((r[1], r[4]) for r in rows) == sorted((d, n) for (d, _), n in counts.items())
    assert len({r[0] for r in rows}) == len(rows)
