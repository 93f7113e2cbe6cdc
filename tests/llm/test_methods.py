"""The methods of chat formatting, mixing and quality rules, held to brute force."""

import math
import random
from collections import Counter, defaultdict

import pytest
from frames import SCHEMA, row, words
from pyspark.sql import functions as F

from pitwise.llm import chat, mixing, quality
from pitwise.llm.common import stored


def rows_of(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# chat


def test_split_control_strings_and_attachments_come_back(spark):
    r, rows = random.Random(4), []
    for conv in range(40):
        for turn in range(r.randint(1, 4)):
            parts = []
            for _ in range(r.randint(0, 6)):
                kind = r.choice(("text", "text", "text", "image", "audio", "document", None, "poem", "none"))
                part = {"type": kind, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None}
                if kind in ("image", "audio", "document"):
                    part |= {"ref": f"r{r.randrange(99)}", "width": r.choice((None, -5, 28, 29, 84)), "height": r.choice((None, 1, 84)), "seconds": r.choice((None, float("nan"), -1.0, 0.02, 2.5)), "pages": r.choice((None, 0, 3))}
                else:
                    text = r.choice(chat.CONTROL + ("\\", "\\.", "<\\.", "é<", "[[INST]]"))
                    at = r.randint(0, len(text))
                    for piece in (text[:at], text[at:]):  # a control string over two parts
                        parts.append(part | {"text": piece or None})
                    continue
                parts.append(None if kind == "none" else part)
            rows.append((conv, turn, r.choice(("user", "assistant", "<|turn", None)), "", parts or None))
    df = spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, text string, content array<{chat.PART}>")
    chunks = stored(chat.format_conversations(df, parts="content"))
    got = {(x["conv_id"], x["nth"]): x for x in rows_of(chat.read_parts(chunks))}
    digest = {x["conv_id"]: x for x in rows_of(chat.read_conversations(chunks))}
    loss = Counter()
    for conv, turn, role, _, parts in rows:
        want = []
        for part in parts or []:
            kind = part and part["type"]
            if kind in ("image", "audio", "document"):
                amount = lambda k: part[k] if part[k] is not None and part[k] > 0 else 0  # noqa: E731, B023
                tokens = {"image": max(1, math.ceil(amount("width") / 28) * math.ceil(amount("height") / 28)), "audio": max(1, math.ceil(amount("seconds") * 25)), "document": 1024 * max(1, amount("pages"))}[kind]
                want.append((kind, None, part["ref"], tokens))
            elif part and part["text"]:
                if want and want[-1][0] == "text":
                    want[-1] = ("text", want[-1][1] + part["text"], None, None)
                else:
                    want.append(("text", part["text"], None, None))
        x = got.pop((conv, turn))
        assert x["role"] == (role or "") and [(p["type"], p["text"], p["ref"], p["tokens"]) for p in x["parts"]] == want
        loss[conv] += sum(len(t) for kind, t, _, _ in want if kind == "text") if role == "assistant" else 0
    assert not got and all(digest[c]["loss_chars"] == n for c, n in loss.items())


# mixing


@pytest.fixture(scope="module")
def mixture(spark):
    docs = spark.createDataFrame([row(i, words(40 + 37 * i % 400, i), source=f"s{i % 5}" if i % 5 else None) for i in range(900)] + [row(9, "twice " * 70, source="s1")] * 3, SCHEMA)
    return docs.repartition(3).cache()


def test_taken_words_by_brute_force(spark, mixture):
    block, seed = 64, 7
    spread = F.xxhash64(F.lit(seed), "doc_id", mixing.n_words(F.col("text")))
    docs = mixture.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"), spread.alias("spread"), F.pmod(spread, F.lit(4)).alias("bucket")).collect()
    sizes = spark.createDataFrame([(s is None, s or "", s, sum(d["size"] for d in docs if d["source"] == s)) for s in {d["source"] for d in docs}], "missing boolean, name string, source string, source_size bigint")
    sources = mixing.targets(sizes.select(F.struct("missing", "name").alias("source_key"), "source", "source_size"))
    times = Counter((x["source_key"]["name"], x["block_no"]) for x in rows_of(mixing.mixed_blocks(sources)))
    want = Counter()
    for name in {d["source"] for d in docs}:
        at = 0
        for d in sorted((d for d in docs if d["source"] == name), key=lambda d: (d["bucket"], d["spread"], d["doc_id"])):
            words_taken = sum(times[name or "", w // block] for w in range(at, at + d["size"]))
            want[d["doc_id"], d["size"], words_taken] += 1
            at += d["size"]
    got = Counter((x["doc_id"], x["size"], x["taken"]) for x in rows_of(mixing.mix(mixture)))
    assert got == want


def test_slots_are_drawn_for_every_shard(spark):
    sizes = [40_000, 160_000, 80_000, 240_000]
    rows = spark.createDataFrame([(False, f"s{i}", f"s{i}", n) for i, n in enumerate(sizes)], "missing boolean, name string, source string, source_size bigint")
    sources = mixing.targets(rows.select(F.struct("missing", "name").alias("source_key"), "source", "source_size"))
    target = {x["source_key"]["name"]: x["target"] for x in rows_of(sources)}
    slots = rows_of(mixing.mixed_blocks(sources, block=16, shard=256))
    total, whole = len(slots), sum(target.values())
    assert sorted(x["slot"] for x in slots) == list(range(total))
    counts = defaultdict(Counter)
    for x in slots:
        counts[x["shard"]][x["source_key"]["name"]] += 1
    full = [c for c in counts.values() if sum(c.values()) == 256]
    assert len(full) > 100
    for name, t in target.items():
        p = t / whole
        got = [c[name] for c in full]
        mean = sum(got) / len(got)
        spread = sum((g - mean) ** 2 for g in got) / len(got)
        assert mean == pytest.approx(256 * p, rel=0.05)
        assert 0.6 < spread / (256 * p * (1 - p)) < 1.5  # fixed counts would not spread at all
        times = Counter(x["block_no"] for x in slots if x["source_key"]["name"] == name)
        assert max(times.values()) - min(times.values()) <= 1 and max(times.values()) <= 3 and sum(times.values()) == pytest.approx(t / 16, abs=2)


def test_mixed_documents_follow_what_is_taken(spark, mixture):
    taken, size, copies = Counter(), {}, Counter()
    for x in rows_of(mixing.mix(mixture)):
        taken[x["doc_id"] % 5 if x["doc_id"] != 9 or x["size"] != 70 else 1] += x["taken"]
    for x in rows_of(mixing.mixed_documents(mixture)):
        key = 1 if x["text"].startswith("twice") else x["doc_id"] % 5
        copies[key] += len(x["text"].split())
    for k, n in taken.items():
        assert copies[k] == pytest.approx(n, rel=0.04)


# quality


def brute_verdicts(docs):
    """kept of every document, from the docstring of the module alone."""
    step = math.log1p(2 * quality.ERROR)
    groups = defaultdict(lambda: defaultdict(list))
    for d in docs:
        if not d["base_failed"]:
            for m, (a, b, _) in quality.METRICS.items():
                v = d[a] / d[b] if d[b] else 0.0
                bucket = math.exp(math.ceil(math.log(v) / step) * step) if v > 1e-6 else 0.0
                for key in ((d["lang"], d["source"]), (d["lang"],), ()):
                    groups[m][key].append(bucket)

    def fence(m, key):
        values, level = sorted(groups[m][key]), quality.METRICS[m][2]
        at = lambda q: math.sqrt(values[max(0, math.ceil(q * len(values) - 1e-9) - 1)])
        return at(level) + quality.RANGES * (at(level) - at(0.5)), len(values)

    def limit(m, d):
        up = fence(m, ())[0]
        for key in ((d["lang"],), (d["lang"], d["source"])):
            own, n = fence(m, key) if groups[m][key] else (0.0, 0)
            up = (n * own + quality.PRIOR * up) / (n + quality.PRIOR)
        return up * up

    def kept(d):
        return not d["base_failed"] and not any(max(d[a] - quality.NOISE * math.sqrt(d[a] + 1), 0) > limit(m, d) * d[b] for m, (a, b, _) in quality.METRICS.items())

    return [kept(d) for d in docs]


def marked(n, seed, share):
    r = random.Random(seed)
    return " ".join(w + ("#" if r.random() < share else "") for w in words(n, seed).split())


def test_verdicts_by_brute_force(spark):
    r = random.Random(2)
    rows = []
    for i in range(600):
        text = marked(r.randint(30, 300), i, r.choice((0, 0, 0.02, 0.3, 0.9)) if i % 3 else 0)
        if i % 17 == 0:
            text += "\n" + "\n".join(["the same line"] * r.randint(2, 30))
        rows.append(row(i, text, lang=r.choice(("en", "de", None)), source=r.choice(("a", "b", "rare" if i % 50 == 0 else "a", None))))
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {x["doc_id"]: x["kept"] for x in rows_of(quality.judged(docs))}
    measured = sorted(rows_of(quality.measured(docs).drop("doc")), key=lambda d: d["doc_id"])
    want = {d["doc_id"]: k for d, k in zip(measured, brute_verdicts(measured))}
    assert got == want and 20 < sum(not d["base_failed"] and not want[d["doc_id"]] for d in measured) < 400
    assert sorted(x["doc_id"] for x in rows_of(quality.kept_documents(docs))) == sorted(i for i, k in want.items() if k)


def test_the_same_text_is_judged_by_its_source(spark):
    # ten times the documents that a group leans on its language for
    plain = [row(i, words(150, i), source="prose") for i in range(2000)]
    tables = [row(10_000 + i, marked(150, 10_000 + i, 0.25 + i % 40 / 100), source="tables") for i in range(2000)]
    same = marked(150, 77, 0.5)
    docs = spark.createDataFrame([*plain, *tables, row(50_000, same, source="prose"), row(50_001, same, source="tables")], SCHEMA)
    got = {x["doc_id"]: x["kept"] for x in rows_of(quality.judged(docs))}
    assert not got[50_000] and got[50_001]
    assert all(got[i] for i in range(2000)) and all(got[10_000 + i] for i in range(2000))


def test_fingerprint_gates_lose_next_to_nothing_at_the_limit():
    """The exact binomial tail beyond each gate, and what it still rules out of texts that have nothing in common."""
    import math

    from pitwise.llm import setjoin, simhash

    share = math.acos(2 * 0.8 / 1.8) / math.pi
    for lanes, unlike in ((setjoin.FIRST, 1e-2), (setjoin.LANES, 1e-12)):
        bits, most = 64 * lanes, setjoin.bits_apart(0.8, lanes)
        tail = lambda p, lo, hi: sum(math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(lo, hi))
        assert tail(share, most + 1, bits + 1) <= 1.01 * setjoin.LOST < tail(share, most, bits + 1)
        assert tail(0.5, 0, most + 1) < unlike


def test_redaction_of_many_spans(spark):
    """More spans than a block, some inside others, in order and in linear time."""
    from pitwise.llm import pii

    text = " ".join(f"w{i} a{i}@b.co +49 170 {i:07d} x" for i in range(700))
    docs = spark.createDataFrame([(1, text, "en", "s", len(text))], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    (row,) = pii.redacted(docs).collect()
    assert row.text == " ".join(f"w{i} <email> <phone> x" for i in range(700)) and row.n_chars == len(row.text)


def test_near_copies_meet_by_their_fingerprints(spark, monkeypatch):
    """Without the rounds by members of sets, SimHash alone brings copies with near fingerprints together, and whole sets tell them from others."""
    from pitwise.llm import setjoin, simhash

    base = [words(400, k) for k in range(6)]
    texts = base + [b + " more" for b in base]  # one further shingle of nearly 400
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    none = spark.createDataFrame([], "a bigint, b bigint")
    monkeypatch.setattr(setjoin, "_with_hub", lambda *_: none)
    monkeypatch.setattr(setjoin, "_others", lambda *_: none.selectExpr("a", "b", "0 apart"))
    prints = {r["doc_id"]: r["fp"] for r in simhash.fingerprints(docs).collect()}
    near = [k for k in range(6) if ((prints[k] ^ prints[k + 6]) & (2**64 - 1)).bit_count() <= 2]
    kept = {r["doc_id"] for r in simhash.unique_documents(docs).collect()}
    assert near and kept == set(range(12)) - {k + 6 for k in near}
