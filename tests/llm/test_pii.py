"""Added personal-data spans against brute force, gates against none, very many matches, and sentences of other templates."""

import random
import time
from collections import Counter

from pyspark.sql import functions as F

from pitwise.llm import pii


def spans_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r.doc_id: [s for s in r.spans.split(",") if s] for r in pii.digests(df).collect()}


PIECES = ["call (073) 555-8658", "555-123-4567", "john at example.com", "a (at) b dot org", "4111 1111 1111 1111", "4111.1111.1111.1112", "key AbCdEfGhIjKlMnOpQrStUvWx", "token=9f86d081884c7d659a2feaa0c55ad015", "ssn 123-45-6789", "DE89 3704 0044 0532 0130 00", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "lives at 12 Baker Street", "12:30:45", "1999-03-04", "pages 123-456 78", "+49 30 1234567", "x@y.zz", "10.0.0.1", "at", "dot", "the", "1", "see", "look at home. Then"]


def texts_of(n, seed):
    r = random.Random(seed)
    return [" ".join(r.choice(PIECES) for _ in range(r.randint(0, 12))) + r.choice(("", "\n", " 😀 ")) + r.choice(PIECES) for _ in range(n)]


def test_added_spans_by_brute_force(spark):
    texts = texts_of(120, 1)
    model = pii.trained(spark)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    score = pii._score(model["trees"], {f: F.col(f"c.{f}") for f in pii.FEATURES})
    found = df.select("doc_id", F.explode(pii.candidates(F.col("text"))).alias("c")).select("doc_id", "c.kind", "c.start", "c.end", (-score).alias("score")).collect()
    base = {r.doc_id: [(s.kind, s.start, s.end) for s in r.b] for r in df.select("doc_id", pii.base_spans(F.col("text")).alias("b")).collect()}
    place = {k: i for i, k in enumerate(pii.CANDIDATES)}
    got, added = spans_of(spark, texts), 0
    for i in range(len(texts)):
        meets = lambda a, b: a[1] < b[2] and b[1] < a[2]
        rows = [(c.kind, c.start, c.end, (round(c.score + 0.0, 2), c.start - c.end, c.start, -place[c.kind])) for c in found if c.doc_id == i and -c.score >= model["thresholds"][c.kind]]
        rows = [c for c in rows if not any(meets(c, b) for b in base[i])]
        best = lambda rows: [c for c in rows if not any(d[3] < c[3] and meets(c, d) for d in rows)]
        first = best(rows)
        kept = first + best([c for c in rows if not any(meets(c, d) for d in first)])
        added += len(kept)
        want = sorted([(pii.KINDS.index(k), a, b, k) for k, a, b, *_ in [*base[i], *kept]])
        assert got[i] == [f"{k}:{a}:{b}" for _, a, b, k in want], texts[i]
    assert added > 150


def test_what_stands_elsewhere_never_matters(spark, monkeypatch):
    texts = texts_of(200, 2) + PIECES
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    show = lambda: [[(s.kind, s.start, s.end) for s in r.c] for r in df.select(pii.candidates(F.col("text")).alias("c")).collect()]
    gated = show()
    monkeypatch.setattr(pii, "GATES", dict.fromkeys(pii.GATES, ""))
    assert show() == gated
    assert spans_of(spark, ["mail john at example.com today", "secret: AbCdEfGhIjKlMnOpQrStUvWxYz"]) == {0: ["email:5:24"], 1: ["secret:8:34"]}


def test_very_many_matches_in_one_text(spark):
    text = "".join(f"call ({i % 900 + 100}) 555-{i % 10000:04} or a{i}@b.org. " for i in range(16_000))
    began = time.monotonic()
    got = spans_of(spark, [text])[0]
    assert Counter(s.split(":")[0] for s in got) == {"email": 16_000, "phone": 16_000}
    assert time.monotonic() - began < 120
    starts = [int(s.split(":")[1]) for s in got if s.startswith("email")]
    assert all(text[a : a + 1] == "a" and text[a - 4 : a] == " or " for a in starts)


def test_sentences_of_other_templates(spark):
    personal = [
        ("phone", "You can ring me under (212) 555-0147 in the evening."), ("phone", "Her telephone is 415-555-0132 now"), ("phone", "dial 030 555 01234 for help"),
        ("email", "please reach anna.lee (at) sample dot com soon"), ("email", "Mail jo at sample.org for details"),
        ("secret", 'password="9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"'), ("secret", "bearer AbCdEfGhIjKlMnOpQrStUvWxYzAbCd was sent"),
        ("card", "I paid with card 4929.1234.5678.9012 then"), ("iban", "Bank account: DE89 3704 0044 0532 0130 00"), ("id", "my social security number: 078-05-1120"),
        ("ipv6", "server 2001:0db8:85a3:08d3:1319:8a2e:0370:7344 is down"), ("address", "They live at 221 Baker Street in town"),
    ]
    clean = ["Nothing of note happened at home. Then they left.", "It ran from 12:30:45 until 13:00:00.", "see pages 120-134 15 of the book", "version 10.20.30 of it came in 2024/05/06", "The year 1999-03-04 was born in mind.", "Donaudampfschifffahrtsgesellschaft is a long word", "A plain sentence without any of it.", "path some/long/path/to/a/page/of/text here"]
    got = spans_of(spark, [t for _, t in personal] + clean)
    hits = sum(any(s.startswith(kind) for s in got[i]) for i, (kind, _) in enumerate(personal))
    wrong = sum(bool(got[len(personal) + i]) for i in range(len(clean)))
    assert hits >= 10 and wrong == 0, [(t, got[i]) for i, (_, t) in enumerate(personal)] + [(t, got[len(personal) + i]) for i, t in enumerate(clean)]
