"""The corpus operators against brute force, on small frames that hold every odd case."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from frames import ODD, SCHEMA, row, words

from pitwise.llm import chat, hilbert, mixing, passages, pieces, pii, quality, queries, simhash, syncmers, tokenfile
from pitwise.llm.common import bucket_of

TEXTS = [(r[0], r[1] or "") for r in ODD]


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# 1 SimHash


def brute_fingerprint(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] if len(ws) >= 3 else [" ".join(ws)] if ws else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(fps)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= 2:
            parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_simhash_odd_rows(odd):
    got = Counter((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in rows_of(simhash.near_duplicates(odd, 3)))
    fps = [brute_fingerprint(t) for _, t in TEXTS]
    roots = brute_components(fps)
    least = {}
    for (d, _), root in zip(TEXTS, roots):
        if d is not None:
            least[root] = min(d, least.get(root, d))
    assert got == Counter((d, f, least.get(root)) for (d, _), f, root in zip(TEXTS, fps, roots))


def test_simhash_links_are_exact_in_hot_and_cold_blocks(spark):
    r = random.Random(5)
    values = {r.getrandbits(64) for _ in range(60)}
    for center in [r.getrandbits(64) for _ in range(3)]:
        for _ in range(80):  # far more than are compared in pairs
            values.add(center ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))))
    values = sorted(simhash.signed(v) for v in values)
    from pitwise.llm.components import components

    nodes = spark.createDataFrame([(v,) for v in values], "fp bigint")
    root = {x["node"]: x["root"] for x in rows_of(components(simhash.links(nodes)))}
    brute = brute_components([v & (1 << 64) - 1 for v in values])
    groups = {}
    for v, b in zip(values, brute):
        groups.setdefault(b, set()).add(root.get(v, v))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_unique_documents_keeps_one_of_each_group(spark):
    base = [words(300, s) for s in range(12)]
    near = [" ".join("changed" if i == 150 else w for i, w in enumerate(t.split())) for t in base]
    docs = spark.createDataFrame([row(i, t) for i, t in enumerate(base + near + base[:3])], SCHEMA)
    kept = simhash.unique_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in rows_of(kept)) == list(range(12))


def test_unique_documents_finds_near_copies_in_a_large_group(spark):
    base = words(400, 1).split()
    texts = []
    for s in range(120):
        r = random.Random(s)
        at = set(r.sample(range(400), 2))
        texts.append(" ".join(f"new{s}" if i in at else w for i, w in enumerate(base)))
    docs = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], SCHEMA)
    assert simhash.unique_documents(docs).count() == 1


def kept_by_brute_force(texts, similarity=0.8):
    """The smallest number of each component of texts whose shingle sets are at least so similar."""
    sets, root = [], list(range(len(texts)))
    for text in texts:
        w = text.split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if len(x & sets[j]) >= similarity * len(x | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [i for i in range(len(texts)) if find(i) == i]


def test_unique_documents_finds_every_pair_of_short_near_copies(spark):
    r, texts = random.Random(5), []
    for i in range(150):  # one word changed in the middle of 48 to 110 words: Jaccard of 0.79 to 0.91
        base = words(48 + i % 63, 7000 + i).split()
        texts += [" ".join(base), " ".join("changed" if k == len(base) // 2 else w for k, w in enumerate(base))]
        if i % 3 == 0:
            at = r.randrange(len(base))
            texts.append(" ".join("other" if k == at else w for k, w in enumerate(base)))
    docs = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], SCHEMA)
    assert sorted(x["doc_id"] for x in rows_of(simhash.unique_documents(docs))) == kept_by_brute_force(texts)


def test_unique_documents_compares_mixed_families_of_one_block(spark):
    texts, shared = [], words(150, 1)
    for family in range(5):  # one template, and each family's own words
        base = f"{shared} {words(60, 50 + family)}".split()
        texts += [" ".join(f"new{k}" if i == 3 * k + family else w for i, w in enumerate(base)) for k in range(24)]
    for family in range(3):  # each text changes one more word of the last one, so the first is like few of them
        base = words(64, 80 + family).split()
        order = random.Random(family).sample(range(64), 40)
        for k, at in enumerate(order):
            base[at] = f"step{k}"
            texts.append(" ".join(base))
    order = random.Random(9).sample(range(len(texts)), len(texts))
    texts = [texts[i] for i in order]
    docs = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], SCHEMA)
    want = kept_by_brute_force(texts)
    assert sorted(x["doc_id"] for x in rows_of(simhash.unique_documents(docs))) == want and len(want) >= 8


def test_unique_documents_counts_a_repeated_shingle_once(spark):
    line = " ".join(f"say{i}" for i in range(10))
    texts = [" ".join(f"{line} {words(23, 1000 * s + k)}" for k in range(40)) for s in range(1, 4)]
    docs = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], SCHEMA)
    assert simhash.unique_documents(docs).count() == 3

    blocks = [" ".join([line] * 40 + [words(930, s)]) for s in range(2)]
    docs = spark.createDataFrame([row(i, t) for i, t in enumerate(blocks)], SCHEMA)
    assert simhash.unique_documents(docs).count() == 2


# 2 syncmers


def test_edited_fingerprints(odd):
    got = sorted((r["n_chars"], r["edited_sha256"]) for r in rows_of(syncmers.edited_fingerprints(odd)))
    order = sorted(TEXTS, key=lambda x: (-(x[0] if x[0] is not None else -(1 << 63)), x[1]))
    want = []
    for i, (_, text) in enumerate(order):
        after, n = order[(i + 1) % len(order)][1], len(text)
        want.append((n, hashlib.sha256((text[: n - n // 2] + after[: n // 2]).encode()).hexdigest()))
    assert got == sorted(want)


def test_closed_syncmers_are_context_free():
    text = words(300, 9)
    at, kept = syncmers.anchors(text)
    shifted = dict(zip((syncmers.anchors("prefix " + text)[0] - 7).tolist(), syncmers.anchors("prefix " + text)[1].tolist()))
    assert len(at) > 50 and all(shifted[a] == h for a, h in zip(at.tolist(), kept.tolist()))


def test_closed_syncmers_by_definition():
    text = words(60, 2)
    points = [ord(c) for c in text]
    at = set(syncmers.anchors(text)[0].tolist())
    mixed = syncmers._mix(np.array(points, np.uint64) + np.uint64(1)).tolist()
    inner = []
    for i in range(len(points) - syncmers.S + 1):
        h = 0
        for x in mixed[i : i + syncmers.S]:
            h = (h * syncmers._BASE + x) % (1 << 64)
        inner.append(int(syncmers._mix(np.array([h], np.uint64))[0]))
    for i in range(len(points) - syncmers.K + 1):
        part = inner[i : i + syncmers.K - syncmers.S + 1]
        assert (i in at) == (min(part) in (part[0], part[-1]))


def by_hand(text, most):
    """The ``most`` smallest anchor hashes of a text, each with its first place."""
    first = {}
    for at, h in zip(*(x.tolist() for x in syncmers.anchors(text))):
        first.setdefault(h, at)
    return {h: first[h] for h in sorted(first)[:most]}


def likeness_by_hand(a, b, most):
    """All chains of shared anchors in one order, by the table of longest ones."""
    if not a or not b:
        return float(len(a) == len(b))
    both = sorted({*a, *b})
    both = both[:most] if len(a) >= most or len(b) >= most else both
    places = [b[h] for h in sorted((h for h in both if h in a and h in b), key=lambda h: a[h])]
    longest = []
    for i, x in enumerate(places):
        longest.append(1 + max((longest[j] for j in range(i) if places[j] < x), default=0))
    share = max(longest, default=0) / len(both)
    return 2 * share / (1 + share)


def test_edited_fingerprints_by_brute_force(spark):
    long, other, common = words(900, 21), words(900, 22), words(120, 23)
    texts = [long, other, f"{common} {words(90, 24)}", f"{words(80, 25)} {common}", long, long[2000:] + long[:2000], common * 3, words(40, 26), "", "short", None, "é" * 500, words(7, 27)]
    texts += [f"{words(60, 30 + i)} {common} {words(20 * i, 50 + i)}" for i in range(12)]
    rows = {r["doc_id"]: r for r in syncmers.edited_fingerprints(spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], SCHEMA)).collect()}
    texts = [t or "" for t in texts]
    assert set(rows) == set(range(len(texts)))
    shown = lambda found: "".join(f"{h:08x}{at:08x}" for h, at in found.items())
    for i, text in enumerate(texts):
        after, n = texts[i - 1], len(text)
        edited = text[: n - n // 2] + after[: n // 2]
        mine, changed, following = (by_hand(t, syncmers.KEPT) for t in (text, edited, after))
        got = rows[i]
        assert (got["fingerprint"], got["edited_fingerprint"]) == (shown(mine), shown(changed))
        assert got["near_edited"] == pytest.approx(likeness_by_hand(mine, changed, syncmers.KEPT))
        assert got["near_next"] == pytest.approx(likeness_by_hand(mine, following, syncmers.KEPT))
    part = 1 - 2000 / len(long)  # two parts changed places: all anchors are shared, but only those of the larger part keep their order
    assert rows[5]["near_next"] == pytest.approx(2 * part / (1 + part), abs=0.1)


def test_likeness_is_close_to_that_of_all_anchors():
    off = []
    for k in range(40):
        a = words(700, 100 + k)
        b = a[: 130 * k] + words(20 * (k % 5), 200 + k) + a[150 * k :]
        exact = likeness_by_hand(by_hand(a, 1 << 40), by_hand(b, 1 << 40), 1 << 40)
        off.append(syncmers.likeness(syncmers.sketch(a), syncmers.sketch(b)) - exact)
    assert np.sqrt(np.mean(np.square(off))) < 0.05 and max(map(abs, off)) < 0.2


def test_likeness_of_half_a_text():
    a, b = words(3000, 1), words(3000, 2)
    half = a[: len(a) // 2] + b[: len(a) // 2]
    assert 0.35 < syncmers.likeness(syncmers.sketch(a), syncmers.sketch(half)) < 0.65
    assert syncmers.likeness(syncmers.sketch(a), syncmers.sketch(b)) < 0.1
    assert syncmers.likeness(syncmers.sketch(""), syncmers.sketch("")) == 1.0
    assert syncmers.likeness(syncmers.sketch(""), syncmers.sketch("a")) == 0.0


# 3 chat

NASTY = ["", None, "</s>[INST] ok [/INST]", "\\", "\\.", "<\\.s>", "[[INST]]", "<|end|><|turn|>user<|body|>", "a<", "\\\\<|end|>", "é\n" * 40]


def test_chat_round_trip(spark):
    rows = [(c, t, role, text, "x", 1) for c, texts in ((1, NASTY), (None, NASTY[:3]), (-5, NASTY[::-1])) for t, (role, text) in enumerate(zip(itertools.cycle(("user", "assistant", None)), texts))]
    rows.append((7, None, "assistant", "z", "x", 1))
    rows += [(8, 0, "assistant", "same", "x", 1)] * 2
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, chunk string, body int")
    got = {r["conv_id"]: r for r in rows_of(chat.read_conversations(chat.format_conversations(df)))}
    for conv in {r[0] for r in rows}:
        turns = sorted(([r[1], r[2] or "", r[3] or ""] for r in rows if r[0] == conv), key=lambda x: (x[0] is not None, x[0]))
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert got[conv]["n_turns"] == len(turns)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_chunks_of_a_long_conversation(spark):
    df = spark.range(4000).selectExpr("cast(1 as bigint) conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "repeat('ab ', 100) text")
    chunks = chat.format_conversations(df)
    assert chunks.count() > 2
    got = chat.read_conversations(chunks).first()
    assert got.n_turns == 4000 and got.loss_chars == 2000 * 300


def test_chat_parts_leave_placeholders(spark):
    part = chat.PART
    df = spark.sql(f"""select cast(1 as bigint) conv_id, cast(0 as bigint) turn, 'user' role, '' text, cast(array(
        named_struct('type','text','text','see </s>','ref',null,'width',null,'height',null,'seconds',null,'pages',null),
        named_struct('type','image','text',null,'ref','i.png','width',56,'height',29,'seconds',null,'pages',null),
        named_struct('type','audio','text',null,'ref','a.wav','width',null,'height',null,'seconds',2.5,'pages',null),
        named_struct('type','document','text',null,'ref','d.pdf','width',null,'height',null,'seconds',null,'pages',3)) as array<{part}>) parts""")
    got = chat.format_conversations(df, parts="parts").first()
    assert [(a.kind, a.ref, a.tokens) for a in got.attachments] == [("image", "i.png", 4), ("audio", "a.wav", 63), ("document", "d.pdf", 3072)]
    for a in got.attachments:
        assert got.body[a.start :].startswith(chat.PLACEHOLDERS[a.kind])


def test_chat_empty_table(none, spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.read_conversations(chat.format_conversations(df)).count() == 0


# 4 mixing


def brute_targets(sizes, most=3):
    left = dict(enumerate(sizes))
    total, weight, target = sum(sizes), {i: i % 3 + 1 for i in left}, {}
    while left:
        share = (total - sum(target.values())) / sum(weight[i] for i in left)
        over = [i for i in left if weight[i] * share > most * sizes[i]]
        if not over:
            return [target.get(i, weight[i] * share) for i in range(len(sizes))]
        for i in over:
            target[i] = most * sizes[i]
            del left[i]
    return [target[i] for i in range(len(sizes))]


def test_targets_stop_at_three_times_the_size(spark):
    sizes = [5000, 40, 10, 700, 0, 30]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(list(enumerate(sizes)), "source int, source_size bigint").select(F.struct(F.lit(False).alias("missing"), F.format_string("%02d", "source").alias("name")).alias("source_key"), "source", "source_size")
    got = {int(r["source_key"]["name"]): r["target"] for r in rows_of(mixing.targets(df))}
    for i, want in enumerate(brute_targets(sizes)):
        assert got[i] == pytest.approx(want)


def test_permutation_is_a_bijection(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 1000):
        df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("bigint"), F.lit(3)).alias("x"))
        assert sorted(r["x"] for r in rows_of(df)) == list(range(n))


def test_mix(spark):
    docs = spark.createDataFrame([row(i, words(40 + 37 * i % 400, i), source=f"s{i % 7}" if i % 7 else None) for i in range(400)], SCHEMA)
    first, again = (sorted(tuple(r.values()) for r in rows_of(mixing.mix(docs.repartition(n)))) for n in (3, 5))
    assert first == again
    rows = rows_of(mixing.mix(docs))
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    by_source = {}
    for r in rows:
        by_source.setdefault(r["doc_id"] % 7, []).append(r)
    assert sum(x[0]["target"] for x in by_source.values()) == pytest.approx(sum(r["size"] for r in rows))
    for x in by_source.values():
        assert sum(r["size"] for r in x) == x[0]["source_size"]
        assert sum(r["taken"] for r in x) == pytest.approx(x[0]["target"], rel=0.05)


def test_mix_odd_rows(odd, none):
    rows = rows_of(mixing.mix(odd))
    assert sorted(r["size"] for r in rows) == sorted(len(t.encode().split()) for _, t in TEXTS)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    assert mixing.mixed_documents(odd).columns == odd.columns


# 5 pieces


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


STRANGE = ["", " ", "  ", "\n", " \n ", "a", " a  b ", "▁", "a▁b", "▁▁ a", "tab\tand\nline\n\n", "é́ 😀 中文", "x" * 500, "\x00\x1c", "</s> <s> <unk>", "a b", "<0x0A>"]


def test_pieces_as_the_library_encodes():
    lib, own = library(), pieces.encoder(None)
    assert own.by_run
    r = random.Random(1)
    samples = STRANGE + ["".join(r.choice(" ab\n▁é中<>/s.") for _ in range(r.randint(0, 60))) for _ in range(500)]
    for text in samples:
        ids, shown = own.encode(text)
        assert ids == lib.encode(text), repr(text)
        assert shown == "".join(f"{i} " for i in ids)


def test_pieces_spans_cover_the_text():
    own = pieces.encoder(None)
    for text in STRANGE:
        ids, raw = own.encode(text)[0], text.encode()
        spans = own.spans(text, ids)
        assert b"".join(raw[a:b] for a, b in spans.tolist()) == raw
        for i, (a, b) in zip(ids, spans.tolist()):
            piece = own.lib.id_to_piece(i)
            if not own.lib.is_byte(i):
                assert raw[a:b].decode() in (piece.replace("▁", " "), piece.replace("▁", " ")[1:], piece, piece[1:])


def test_character_map_takes_the_longest_prefix():
    import struct

    # keys "a" -> "X" and "ab" -> "YZ": a node's base is where its children and its value unit stand
    units = [0] * 1024
    label = lambda c: ord(c)
    base = {"": 256, "a": 512, "ab": 768}
    at = {"": 0}
    at["a"] = base[""] ^ label("a")
    at["ab"] = base["a"] ^ label("b")
    units[0] = base[""] << 10
    units[at["a"]] = (base["a"] ^ at["a"]) << 10 | 1 << 8 | label("a")
    units[base["a"]] = 0x80000000 | 0
    units[at["ab"]] = (base["ab"] ^ at["ab"]) << 10 | 1 << 8 | label("b")
    units[base["ab"]] = 0x80000000 | 2
    blob = struct.pack("<I", 4096) + struct.pack("<1024I", *units) + b"X\0YZ\0"
    found = pieces.CharacterMap(blob)
    assert found.longest(b"ac", 0) == (1, b"X")
    assert found.longest(b"zab", 1) == (2, b"YZ")
    assert found.longest(b"b", 0) is None
    assert pieces.CharacterMap(b"").longest(b"a", 0) is None


def test_piece_digests_odd_rows(odd, none):
    lib = library()
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows_of(pieces.digests(odd)))
    want = Counter()
    for d, text in TEXTS:
        ids = lib.encode(text, add_eos=True)
        want[d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()] += 1
    assert got == want
    assert pieces.digests(none).count() == 0 and pieces.encoded(none).count() == 0
    assert all(r["ids"][-1] == 2 and len(r["ids"]) == len(r["starts"]) for r in rows_of(pieces.encoded(odd)))


# 6 token files


def test_blocks_round_trip():
    r = np.random.default_rng(0)
    for ids in (np.zeros(0), np.full(5, 49407), r.integers(0, 49408, 1000), np.where(r.random(700) < 0.05, 4_000_000_000, 7), np.array([0, 4_294_967_295] * 100)):
        ids = ids.astype(np.uint32)
        assert tokenfile.read_segment(tokenfile.write_segment([3, None], [len(ids), 0], ids))[2].tolist() == ids.tolist()
    assert len(tokenfile.pack_blocks(np.where(np.arange(1280) % 40 == 0, 1 << 30, 5).astype(np.uint32))[0]) < 128


def test_token_file_odd_rows(odd, none):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows_of(tokenfile.read_tokens(tokenfile.write_tokens(odd))))
    at, want = 0, []
    for d, text in sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode())):
        ids = lib.encode(text, add_special_tokens=False).ids + [2]
        want.append((at, d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert tokenfile.read_tokens(tokenfile.write_tokens(none)).count() == 0


def test_words_as_the_tokenizer_encodes():
    own = tokenfile.encoder(public_tokenizers.path("word_bpe_49k.json"))
    r = random.Random(2)
    alphabet = ["a", "B", "é", "É", "ß", "İ", "Σ", "ǰ", "J̌", "é", ".", ",", "'s", "'", "1", " ", "\n", "\x1c", " ", "<|endoftext|>", "<|StartOfText|>", "…", "中"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 25))) for _ in range(800)] + ["word, Word. don't x...", ""]
    want = [e.ids for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in own.encode([t.encode() for t in texts])] == want


# 7 passages


def test_passages_found_and_clean_documents_left_alone(spark):
    shared = words(70, 100).split()
    edited = [w if i % 17 else "edit" for i, w in enumerate(shared)]
    shorter = shared[: 12] + shared[14:]
    texts = [words(200, 1), words(90, 2) + " " + " ".join(shared) + " " + words(60, 3), " ".join(edited) + " " + words(100, 4), words(30, 5) + " " + " ".join(shorter), words(300, 6), " ".join(shared[:30]) + " " + words(90, 7)]
    docs = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)] + [row(None, texts[1]), row(20, None)], SCHEMA)
    got = rows_of(passages.repeated_passages(docs))
    # few texts share the seeds: each meets each; a text without an id is a copy of its first document
    assert {(r["doc_id"], r["other_id"]) for r in got} == {(2, 1), (3, 1), (3, 2), (None, 1)}
    for r in got:
        assert r["end"] - r["start"] >= 60 and (r["other_id"] != 1 or r["doc_id"] is None or 88 <= r["other_start"] <= 92)


def test_passages_of_exact_copies_and_empty_table(spark, none):
    docs = spark.createDataFrame([row(i, words(120, 1)) for i in range(30)] + [row(99, "same " * 300)], SCHEMA)
    got = rows_of(passages.repeated_passages(docs))
    assert {(r["doc_id"], r["other_id"], r["start"], r["end"]) for r in got} == {(i, 0, 0, 120) for i in range(1, 30)}
    assert passages.repeated_passages(none).count() == 0


def test_chains_against_all_orders():
    r = random.Random(3)
    for _ in range(30):
        matches = sorted({(r.randint(0, 60), r.randint(0, 60)) for _ in range(12)})
        best = {}
        for i, (q, s) in enumerate(matches):
            best[i] = max([passages.K] + [passages.K + best[j] - passages.GAP * (q - matches[j][0] + s - matches[j][1]) for j in range(i) if matches[j][0] < q and matches[j][1] < s])
        found = passages.chains(np.array([m[0] for m in matches]), np.array([m[1] for m in matches]))
        top = max(best.values())
        scores = [len(c) * passages.K - passages.GAP * sum(matches[c[-1]][x] - matches[c[0]][x] for x in (0, 1)) for c in found]
        assert top == passages.K or max(scores) == pytest.approx(top)


def test_edit_distance():
    r = random.Random(4)

    def plain(a, b):
        table = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            table[i][j] = min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        return table[-1][-1]

    for _ in range(50):
        a, b = ([r.randint(0, 3) for _ in range(r.randint(0, 9))] for _ in range(2))
        assert passages.edit_distance(np.array(a), np.array(b)) == plain(a, b)


# 8 personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, digits[::-1]))) % 10 == 0


def brute_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


PERSONAL = [
    "mail é a.b@c.de, x@y and a@b.co_d@e.fg", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.02.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1112 0000000000000",
    "+1 (555) 123-4567 +12 +1 5551234567890123456", "no data at all", "", None, "9" * 3000, "1 2 3 4 5 6 7 8 9 " * 2000, "a" * 5000 + "@", "😀 me@x.org 😀 10.0.0.1",
    'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "call (073) 555-8658 now", "on 1999-03-04 there were 12-34 of 56", "@.@.@ ...@a.b",
]


def test_base_spans_against_plain_patterns(spark):
    rows = [(i, t) for i, t in enumerate(PERSONAL)]
    r = random.Random(8)
    rows += [(100 + i, "".join(r.choice("12 34.@+-()ab.") for _ in range(60))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {x["doc_id"]: x for x in rows_of(pii.digests(df))}
    for i, t in rows:
        want = brute_spans(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), (t, want)
        assert set(filter(None, want.split(","))) <= set(filter(None, got[i]["spans"].split(",")))
        assert got[i]["n_card"] == want.count("card:")
    assert "secret:9:49" in got[11]["spans"] and "phone:5:19" in got[12]["spans"]
    assert got[4]["spans"] == got[13]["spans"] == ""


def test_redaction_keeps_rows_and_columns(odd, none):
    rows = rows_of(pii.redacted(odd))
    assert len(rows) == len(ODD) and pii.redacted(odd).columns == odd.columns
    text = next(r for r in rows if r["doc_id"] == 6)["text"]
    assert "a@b.co" not in text and "<email>" in text
    assert pii.redacted(none).count() == 0 and pii.digests(none).count() == 0


def test_trees_on_held_out_sentences(spark):
    from pyspark.sql import functions as F

    model = pii.trained(spark)
    rows = pii.training_sentences(spark, 9000).where("id >= 6000").select("label", F.explode(pii.candidates(F.col("text"))).alias("c")).select("label", "c.*")
    score = pii._score(model["trees"], {f: F.col(f) for f in pii.FEATURES})
    threshold = F.create_map(*[F.lit(x) for kv in model["thresholds"].items() for x in kv])
    said, true = score >= threshold[F.col("kind")], F.col("label") == 1
    hit, chosen, all_true = rows.select(F.count_if(said & true), F.count_if(said), F.count_if(true)).first()
    assert all_true > 1000 and hit / chosen >= 0.98 and hit / all_true >= 0.9


# 9 quality


def brute_quality(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    count, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(ws), sum(map(len, ws)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(ws) < 50 or 100 * len(covered) > 50 * len(ws)


def test_quality_counts(spark):
    r = random.Random(6)
    texts = ["", None, "a", "a b", "a b c a b c", "x\nx\n\n y\nx", "#|<> \x0b\x1c é", "Ha " * 70] + ["".join(r.choice(["a", "b", "#", " ", " ", "\n", "\t", "é"]) for _ in range(r.randint(0, 400))) for _ in range(80)]
    df = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], SCHEMA)
    got = {x["doc_id"]: x for x in rows_of(quality.judged(df))}
    for i, t in enumerate(texts):
        g = got[i]
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"], g["base_failed"]) == brute_quality(t or ""), repr(t)
        assert not (g["base_failed"] and g["kept"])


def test_quality_thresholds_keep_clean_documents(spark):
    clean = [row(i, words(120, i), lang=f"l{i % 2}", source=f"s{i % 3}") for i in range(700)]
    junk = [row(1000 + i, re.sub(" ", "%%% ", words(120, 5000 + i)), lang="l0", source="s0") for i in range(20)]
    got = {r["doc_id"]: r["kept"] for r in rows_of(quality.judged(spark.createDataFrame(clean + junk, SCHEMA)))}
    assert all(got[r[0]] for r in clean) and not any(got[r[0]] for r in junk)


def test_quality_odd_rows(odd, none):
    assert quality.judged(odd).count() == len(ODD)
    kept = quality.kept_documents(odd)
    assert kept.columns == odd.columns and kept.count() == sum(len(t.split()) >= 50 for _, t in TEXTS)
    assert quality.judged(none).count() == 0 and quality.kept_documents(none).count() == 0


# 10 sharding


def test_hilbert_neighbours_differ_in_one_step():
    side = np.arange(8)
    grid = np.stack(np.meshgrid(side, side, side, indexing="ij"), -1).reshape(-1, 3)
    place = hilbert.hilbert_index(grid, 3)
    assert sorted(place.tolist()) == list(range(512))
    walk = grid[np.argsort(place)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_shards(odd, none, spark):
    rows = rows_of(hilbert.hilbert_shards(odd, shards=5))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((d, len(t.encode()) + 16, zlib.crc32(t.encode())) for d, t in TEXTS)
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert max(map(len, by_shard.values())) - min(map(len, by_shard.values())) <= 1 and set(by_shard) == set(range(5))
    assert hilbert.hilbert_shards(none).count() == 0


def test_bucket_of(spark):
    from pyspark.sql import functions as F

    bounds = [1, 5, 9]
    got = rows_of(spark.range(12).select("id", bucket_of(F.col("id"), bounds).alias("b")))
    assert all(r["b"] == sum(x < r["id"] for x in bounds) for r in got)


@pytest.mark.parametrize("run", [lambda d: simhash.near_duplicates(d, 3), simhash.unique_documents, syncmers.edited_fingerprints, syncmers.fingerprint_anchors])
def test_empty_tables(none, run):
    assert run(none).count() == 0


def test_registry_names():
    names = list(queries.queries())
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in names] == list(range(1, 11))
