"""The prefix trie, repeated bytes and vector codes against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from frames import ODD, words

from pitwise.llm import codes, queries, suffixes, trie

# 11 prefix trie

TURNS = "conv_id bigint, turn int, role string, text string, ids int, lens string, conv string, n int, base int, id int, depth int, path int, bucket int"
MORE = (1, "l", "c", 2, 3, 4, 5, 6, 7)


def brute_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    members, kids, below = defaultdict(list), defaultdict(list), {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        turns = own.get(c - c % 100, [])[:h] + turns[h:]
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append((c, len(turns)))
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    out = Counter()
    for node in sorted(members, key=len, reverse=True):
        here = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        below[node] = (sum(below[k][0] for k in kids[node]) or 1, here + sum(below[k][1] for k in kids[node]))
        ends = ",".join(str(c) for c, n in sorted(members[node]) if n == len(node))
        parent = min(members[node[:-1]])[0] if node else None
        out[(min(members[node])[0], len(node), parent, len(members[node]), len(kids[node]), *below[node], hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


def odd_turns():
    r = random.Random(5)
    rows = [(1, None, "user", "a"), (1, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (1, 0, "assistant", "é" * 9), (None, 1, "user", "x"), (300, 5, None, "long " * 5000)]
    for c in [*range(0, 260, 3), *range(100, 140), 200, 201, 202, 501, -7, -100, 10**15]:
        for t in range(r.choice([1, 2, 2, 3, 7])):
            rows.append((c, t, r.choice(["user", "user", None]), "hello" if t == 0 else r.choice(["a", "b", None, "", "cc" * 40])))
    for c in range(1000, 1060):
        rows += [(c, t, "user", f"same {t}") for t in range(8)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("local", [1, 40, 200_000])
def test_trie_is_that_of_brute_force(spark, local):
    rows = odd_turns()
    turns = spark.createDataFrame([(*x, *MORE) for x in rows], TURNS).repartition(3)
    assert Counter(tuple(r) for r in trie.prefix_trie(trie.rebuilt(turns), local).collect()) == brute_trie(rows)


def test_trie_blocks_of_equal_conversations(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 7)
    rows = [(c, t, "user", f"turn {t}") for c in range(-30, 100) for t in range(6, 9)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    assert Counter(tuple(r) for r in trie.prefix_trie(trie.rebuilt(turns)).collect()) == brute_trie(rows)


def test_trie_of_no_conversations(spark):
    none = spark.createDataFrame([], TURNS)
    assert trie.prefix_trie(trie.rebuilt(none)).count() == 0
    assert trie.prefix_trie(trie.rebuilt(spark.createDataFrame([(None, 1, "user", "x", *MORE)], TURNS))).count() == 0


def test_quicksort_needs_no_order():
    r = random.Random(2)
    seqs = {tuple(r.choice([3, 5, 9]) for _ in range(r.randint(0, 6))) for _ in range(200)}
    rows = [(i, 1, list(s), [1] * len(s), str(i)) for i, s in enumerate(seqs)]
    nodes = trie.finished(rows, 0)
    assert len(nodes) == len({s[:d] for s in seqs for d in range(len(s) + 1)})
    assert nodes[0][3] == len(seqs) and nodes[0][5] == sum(1 for s in seqs if not any(t[: len(s)] == s and len(t) > len(s) for t in seqs))


def test_trie_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert Counter(tuple(r) for r in queries.op11_trie(spark, sf).collect()) == brute_trie(rows)


# 12 repeated bytes


def brute_removed(bodies, least):
    """Which bytes go, for each body."""
    starts = Counter(b[i : i + least] for b in bodies for i in range(len(b) - least + 1))
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - least + 1):
            if starts[b[i : i + least]] > 1:
                gone[i : i + least] = b"\1" * least
        out.append(bytes(gone))
    return out


def brute_rows(rows, least):
    """Rows of (doc_id, text) as the operator gives them."""
    bodies = [(t or "").encode() for _, t in rows]
    out = Counter()
    for (doc_id, _), body, gone in zip(rows, bodies, brute_removed(bodies, least)):
        kept = bytes(x for x, g in zip(body, gone) if not g)
        out[(doc_id, len(body), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest())] += 1
    return out


def test_interval_expansion_finds_what_repeats():
    r = random.Random(1)
    for _ in range(150):
        least, letters = r.choice([5, 12, 70]), r.choice([b"ab", b"abc\xff", bytes(range(256))])
        pool = [bytes(r.choice(letters) for _ in range(r.randint(least // 2, 3 * least))) for _ in range(3)]
        bodies = [b"".join(r.choice(pool) if r.random() < 0.5 else bytes(r.choice(letters) for _ in range(r.randint(0, least))) for _ in range(r.randint(1, 5))) for _ in range(4)]
        for found, gone in zip(suffixes.repeats(bodies, least), brute_removed(bodies, least)):
            mark = bytearray(len(gone))
            for s, e in found:
                mark[s:e] = b"\1" * (e - s)
            assert bytes(mark) == gone


def test_common_prefixes_rise_to_the_least():
    text = np.frombuffer(b"banana bandana banana\xff", np.uint8)
    order = suffixes.rotations(text, 8)
    turned = [bytes(np.roll(text, -i)) for i in order]
    assert [t[:8] for t in turned] == sorted(t[:8] for t in turned)
    want = [0] + [min(5, next(i for i in range(len(a)) if a[i] != b[i])) for a, b in zip(turned, turned[1:])]
    assert suffixes.common_prefixes(text, order, 5).tolist() == want


def test_every_window_has_one_segment_and_equal_windows_one_key():
    r = random.Random(3)
    shared = words(300, 8).encode()
    texts = [words(40, 1).encode() + shared + words(50, 2).encode(), words(90, 3).encode() + shared, b"a" * 6000, bytes(r.choice(b"ab") for _ in range(3000))]
    for seeds in (*suffixes.SEEDS, None):
        keys = {}
        for t in texts:
            at = 0
            for key, _, start, n, again in suffixes.segments(t, 400, seeds):
                assert start == at and n >= 400
                at = start + n - 399
                for w in range(start, at):
                    assert keys.setdefault(t[w : w + 400], key) == key
                mine = [t[w : w + 400] for w in range(start, at)]
                assert again or len(set(mine)) == len(mine)
            assert at == len(t) - 399


def planted():
    r = random.Random(4)
    passage, line = words(120, 50), words(40, 51)
    rows = [(100 + i, f"{words(60, 100 + i)} {passage[r.randint(0, 40) : r.randint(600, 900)]} {words(30, 300 + i)}") for i in range(12)]
    rows += [(200 + i, f"{words(40, 500 + i)} {line} {words(40, 700 + i)}") for i in range(40)]
    rows += [(300, "a" * 5000), (301, "ab" * 300), (302, words(50, 9) * 3), (303, "é" * 401), (304, "x" * 399), (305, "x" * 400), (306, "y" * 401)]
    return rows


@pytest.mark.parametrize("bucket", [2_000_000, 4000])
def test_repeats_of_odd_and_planted_rows(spark, monkeypatch, bucket):
    monkeypatch.setattr(suffixes, "BUCKET", bucket)  # a small one sends frequent keys through the further hashes, and single windows
    rows = [(r[0], r[1]) for r in ODD] + planted()
    docs = spark.createDataFrame([(*x, 1, 2, "b", 3, "r") for x in rows], "doc_id bigint, text string, k1 int, k2 int, body string, h int, ranges string").repartition(3)
    got = suffixes.without_repeats(docs, kept=True).collect()
    assert Counter(tuple(r)[:5] for r in got) == brute_rows(rows, 400)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_repeats_of_other_lengths(spark):
    rows = [(i, words(8, i % 3) + words(6, i)) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for least in (12, 64, 90):
        assert Counter(tuple(r) for r in suffixes.without_repeats(docs, least).collect()) == brute_rows(rows, least)


def test_repeats_query_and_empty_table(spark, none):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert Counter(tuple(r) for r in queries.op12_repeats(spark, sf).collect()) == brute_rows(rows, 400)
    assert suffixes.without_repeats(none).count() == 0


# 13 vector codes


def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, v, x) for i, v, x in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = max([1, *(-(-len(v) // parts) for _, v, _ in kept)])
    vectors = [[int(np.floor(256 * c)) for c in v] + [0] * (parts * width - len(v)) for _, v, _ in kept]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in vectors]
    starts = {}
    for (i, _, _), c in zip(kept, cut):
        starts[i] = min(starts.get(i, c), c)
    first = [starts[i] for i in sorted(starts, key=lambda i: (i is None, i or 0))[:entries]]
    books = [[list(c[p]) for c in first] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            at = defaultdict(list)
            for c in cut:
                at[nearest(p, c[p])[1]].append(c[p])
            for k, xs in at.items():
                books[p][k] = [sum(col) // len(xs) for col in zip(*xs)]
    found = [[nearest(p, c[p]) for p in range(parts)] for c in cut]
    errors, labels = [sum(d for d, _ in f) for f in found], Counter()
    for (_, _, x), e in zip(kept, errors):
        labels[x] += e
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return Counter((i, "".join(f"{k:02x}" for _, k in f), e, labels[x], digest) for (i, _, x), f, e in zip(kept, found, errors))


def test_codes_of_odd_rows(spark):
    r = random.Random(6)
    nan, inf = float("nan"), float("inf")
    rows = [(i, [r.choice([-0.5, 0.25, 0.001, 1.5]) for _ in range(32)], r.choice([0, 1, None])) for i in range(5, 150)]
    rows += [rows[3], rows[3], (2, None, 1), (3, [1.0, None] * 16, 1), (0, [nan] + [0.0] * 31, 1), (1, [-inf] + [0.0] * 31, 2), (None, [0.5] * 32, None), (7, [0.0] * 32, 0), (160, [1.0] * 30, 5), (161, [], 5)]
    df = spark.createDataFrame([(*x, "c", 1, 2) for x in rows], "vec_id bigint, embedding array<float>, label int, code string, error int, salt int").repartition(4)
    assert Counter(tuple(x) for x in codes.compressed(df).collect()) == brute_codes(rows)


def test_few_vectors_and_none(spark):
    schema = "vec_id bigint, embedding array<float>, label int"
    rows = [(i, [i / 7] * 16, i % 2) for i in range(5)]
    assert Counter(tuple(x) for x in codes.compressed(spark.createDataFrame(rows, schema)).collect()) == brute_codes(rows)
    assert codes.compressed(spark.createDataFrame([], schema)).count() == 0
    with pytest.raises(Exception, match="too large"):
        codes.compressed(spark.createDataFrame([(1, [1e30] * 16, 0)], schema)).collect()


def test_tree_search_keeps_the_first_of_equally_near_entries():
    r = np.random.default_rng(0)
    for _ in range(20):
        book = r.integers(-3, 4, (r.integers(1, 65), 3))
        x = r.integers(-4, 5, (500, 3))
        far = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        found, best = codes.nearest(codes.tree_of(book), book, x)
        assert (found == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()


def test_codes_query_and_decoding(spark):
    sf = "/root/testdata/sf0.001"
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding), r.label) for r in vectors.collect()]
    assert Counter(tuple(x) for x in queries.op13_codes(spark, sf).collect()) == brute_codes(rows)
    code = codes.trained(vectors)
    whole = {i: np.floor(256 * np.array(v)) for i, v, _ in rows}
    coded = codes.encoded(vectors, code)
    errors = {r.vec_id: r.error for r in coded.collect()}
    for r in codes.decoded(coded, code).collect():
        assert ((whole[r.vec_id] - np.array(r.components)) ** 2).sum() == errors[r.vec_id]
