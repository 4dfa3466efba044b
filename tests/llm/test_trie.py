import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb

from tidemark.llm import trie

NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    """Every prefix of every rebuilt conversation, by the definition."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in own.items()}
    members = defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        made = tuple(own.get(c - c % 20, [])[:h] + own[c][h:])
        for d in range(len(made) + 1):
            members[made[:d]].append((c, d == len(made)))
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out = []
    for p, x in members.items():
        below, leaves, saved = [p], 0, 0
        while below:
            q = below.pop()
            below += kids[q]
            leaves += not kids[q]
            saved += (len(members[q]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) if q else 0)
        ends = ",".join(str(c) for c in sorted(c for c, e in x if e))
        up = min(c for c, _ in members[p[:-1]]) if p else None
        out.append((min(c for c, _ in x), len(p), up, len(x), len(kids[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def made(spark, rows, columns="conv_id long, turn long, role string, text string"):
    turns = spark.createDataFrame(rows, columns).repartition(3)
    got = trie.trie(trie.paths(trie.rebuilt(trie.conversations(turns))))
    return sorted((tuple(r[c] for c in NODE) for r in got.collect()), key=repr)


def corpus(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(n * 2), n):
        for turn in range(rng.choice([1, 1, 2, 3, 4, 6])):
            rows.append((c, turn, rng.choice(["user", "assistant", None]) if rng.random() < 0.1 else "user", rng.choice(["hello  there", "a", "b c d", "", None, "x y"]) if rng.random() < 0.8 else f"own {rng.random()}"))
    return rows


def test_equals_brute_force(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for seed, parts in ((1, 4), (2, 13), (3, 1)):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            rows = corpus(seed)
            assert made(spark, rows) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_many_copies_cross_partitions(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", 9)
    try:
        rows = [(c, t, "user", f"turn {t} of all") for c in range(300) for t in range(3)] + [(c, t, "user", f"other {c % 5} {t}") for c in range(300, 400) for t in range(4)]
        rows += [(c, 0, "user", "turn 0 of all") for c in range(400, 440)] + [(c, t, "user", f"turn {t} of all") for c in range(440, 460) for t in range(9)]
        assert made(spark, rows) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_nulls_ties_repeated_rows_and_turnless(spark):
    rows = [(None, 0, "user", "no conversation"), (5, None, None, None), (5, None, None, None), (5, 1, "user", "b"), (5, 1, "user", "a"), (5, 1, "user", "a"), (7, 0, "user", "w " * 60000), (3, 0, "a", "b"), (4, 0, "", "1:ab")]
    rows += [(c, 0, "user", "only") for c in range(21, 40)]  # of conversation 20, which is absent; with h > 0 nothing is left
    assert made(spark, rows) == brute(rows)
    wider = [(*r, "x", 1) for r in rows]
    assert made(spark, wider, "conv_id long, turn long, role string, text string, path string, words int") == brute(rows)
    assert made(spark, []) == []
    assert made(spark, [(2, 0, "user", "one")]) == brute([(2, 0, "user", "one")])


def test_runs_cut_anywhere():
    """Forests of any contiguous runs of the sorted paths, merged, are the forest of the whole."""
    rng = random.Random(9)
    signs = [bytes([i]) * 16 for i in range(3)]
    rows = sorted((b"".join(rng.choices(signs, k=rng.randint(0, 5))), i, None) for i in range(80))
    rows = [(p, i, [p[16 * k] + 1 for k in range(len(p) // 16)]) for p, i, _ in rows]
    for cuts in ([], [40], sorted(rng.sample(range(1, 80), 20))):
        opened, closed = {}, 0
        for number, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
            run = trie.Run(number)
            for row in rows[a:b]:
                run.add(*row)
            for r in run.forest():
                closed += r[0] == trie.CLOSED
                if r[0] == trie.OPEN:
                    opened[r[5]] = opened.get(r[5], 0) + r[7]
        prefixes = {p[: 16 * k] for p, _, _ in rows for k in range(len(p) // 16 + 1)}
        assert closed + len(opened) == len(prefixes)
        assert opened[b""] == len(rows)


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    want = sorted(con.sql(trie.SQL).fetchall(), key=repr)
    got = trie.op13_conversation_trie(spark, folder).select(*NODE).collect()
    assert sorted(map(tuple, got), key=repr) == want
    rows = con.sql("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    assert brute(rows) == want
