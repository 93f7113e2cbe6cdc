"""Personal data by boosted trees over candidate spans, in DataFrame operations alone.

Patterns that must hold exactly (``BASE``) give the base spans. Beyond them,
high-recall generators propose further, overlapping spans: numbers in phone and
card shapes, written-out addresses, account numbers, identity numbers, IPv6
addresses, street addresses, long keys. A gradient-boosted tree ensemble scores
each by its format and the text before it; thresholds calibrated on sentences of
other templates than it was trained on select what is added. Base spans always
stay and win over added ones. Of overlapping added ones those stay that no better
one overlaps (a higher score in hundredths, then the longer, the earlier, the more
special kind), and of the rest, where it is clear of these, once more.

The ensemble is trained here by Spark ML on ``TRAINING_ROWS`` generated
sentences (the bound is that parameter), once for each application, and scored
as a plain expression. Spans are code points, end exclusive.

Patterns use possessive loops and start only where a run starts, and what a
generator is spared for (``GATES``) is implied by its pattern, so what stands
elsewhere in a text never matters. Places are summed in blocks of the root of the
matches and overlaps are looked up by binary search, so a text of very many
matches takes little more than linear time.

Null and empty texts have no spans; null and repeated doc_ids keep their rows;
an empty table gives none; texts are read whole. Only ``doc_id`` and ``text`` are
read (redaction keeps all columns).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL = "[A-Za-z0-9._%+-]"
#: Kind and pattern of the base spans, in the order of the output.
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of further candidates: kind, and pattern.
_AT, _DOT = r"\x20?(?:\(at\)|\[at\]|\x20at\x20|(?<=\x20)at\x20)\x20?", r"\x20?(?:\(dot\)|\[dot\]|\x20dot\x20|(?<=\x20)dot\x20|\.)\x20?"
_STREET = "Street|Avenue|Road|Lane|Drive|Boulevard|Court|Square|Terrace|St|Ave|Rd|Ln|Dr|Blvd"
CANDIDATES = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++{_AT}[A-Za-z0-9-]++{_DOT}[A-Za-z]{{2,}}+",
    "card": r"(?<![0-9])[0-9]{4}[\x20.-][0-9]{4}[\x20.-][0-9]{4}[\x20.-][0-9]{1,7}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20./-]?[0-9]{2,4}[\x20./-][0-9]{2,5}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20,}+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ipv6": r"(?<![A-Za-z0-9:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![A-Za-z0-9:.])",
    "address": rf"(?<![0-9])[0-9]{{1,5}}\x20(?:[A-Z][A-Za-z]{{1,20}}\x20){{1,3}}(?:{_STREET})\b",
}
#: Short patterns without which a generator's pattern cannot match.
GATES = {"email": r"at[\x20)\]]", "card": r"[0-9]{4}", "phone": "[0-9]{2}", "secret": r"[A-Za-z0-9_/+-]{20}", "iban": "[A-Z]{2}[0-9]{2}", "id": "-[0-9]{2}-", "ipv6": ":[0-9A-Fa-f]{0,4}:", "address": f"[A-Za-z] (?:{_STREET})"}
KINDS = (*BASE, *(k for k in CANDIDATES if k not in BASE))
#: Words that speak for a kind, and against any, when they stand shortly before a candidate.
CONTEXT = {"email": "mail|contact|write|reach", "card": "card|visa|credit|account|paid", "phone": "phone|call|tel|mobile|fax|dial|ring", "secret": "token|secret|key|passw|auth|bearer|credential", "iban": "iban|account|bank|transfer|pay", "id": "ssn|social|security|identity|insurance|tax", "ipv6": "ip|host|address|server|from|ping", "address": "live|address|at|home|ship|send|visit|street"}
AGAINST = r"version|pages?|sum|row|isbn|figure|between|total|number of|see|born|since|until|in|on|ratio|score|time|length"
FEATURES = (*(f"is_{k}" for k in CANDIDATES), "length", "digits", "letters", "capitals", "turns", "separators", "brackets", "slashes", "colons", "distinct", "longest", "checks", "dated", "context", "against", "quoted")
TRAINING_ROWS = 9000
_SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def _starts(sizes: Column) -> Column:
    """Where each hit starts, from (gap, hit) lengths: blocks of the root of their number are summed, then the blocks."""
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("starts"))
    width = F.ceil(F.sqrt(F.size(sizes))).cast("int")
    begins = F.when(F.size(sizes) > 0, F.sequence(F.lit(1), F.size(sizes), F.greatest(width, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    one = lambda a, p: F.struct((a["at"] + p["gap"] + p["hit"]).alias("at"), F.concat(a["starts"], F.array(a["at"] + p["gap"])).alias("starts"))
    blocks = F.transform(begins, lambda b: F.aggregate(F.slice(sizes, b, width), zero, one))
    whole = lambda a, b: F.struct((a["at"] + b["at"]).alias("at"), F.concat(a["starts"], F.transform(b["starts"], lambda s: s + a["at"])).alias("starts"))
    return F.aggregate(blocks, zero, whole, lambda a: a["starts"])


def _found(text: Column, kind: str, pattern: str) -> Column:
    """All leftmost matches of a pattern with their places, and up to 24 characters before each (after the match before it)."""

    def placed(v: Column) -> Column:
        pairs = F.zip_with(v["hits"], F.slice(v["gaps"], 1, F.size(v["hits"])), lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))
        sizes = lambda p: F.transform(p, lambda x: F.struct(F.length(x["gap"]).cast("bigint").alias("gap"), F.length(x["hit"]).cast("bigint").alias("hit")))
        span = lambda x, s: F.struct(F.lit(kind).alias("kind"), s.alias("start"), (s + F.length(x["hit"])).alias("end"), x["hit"].alias("hit"), F.right(x["gap"], F.lit(24)).alias("before"))
        return bound(pairs, lambda p: F.zip_with(p, bound(sizes(p), _starts), span))

    return bound(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps")), placed)


def _luhn(digits: Column) -> Column:
    def value(i):
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + value(i))
    return (F.length(digits) > 0) & (total % 10 == 0)


def _mod97(hit: Column) -> Column:
    """Whether an account number's check digits hold."""
    plain = F.upper(F.regexp_replace(hit, "[^A-Za-z0-9]", ""))
    turned = F.split(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4)), "")
    rest = lambda a, c: F.when(c == "", a).when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(turned, F.lit(0), rest) == 1


def _valid(kind: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: p.rlike("^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])$"))
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _checker(kind: str):
    return lambda span: _valid(kind, span["hit"])


def _measurer(kind: str):
    return lambda span: bound(F.lower(span["before"]), lambda before: _features(span, before, kind))


def base_spans(text: Column) -> Column:
    """The spans that the base patterns give, by kind and start."""
    parts = []
    for kind, pattern in BASE.items():
        likely = F.contains(text, F.lit("@")) if kind == "email" else F.contains(text, F.lit("+")) & text.rlike("[0-9]") if kind == "phone" else text.rlike("[0-9]")
        good = F.filter(_found(text, kind, pattern), _checker(kind))
        parts.append(F.when(likely, F.transform(good, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))).otherwise(F.array().cast(_SPAN)))
    return F.concat(*parts)


def candidates(text: Column) -> Column:
    """Candidate spans with their features, by kind and start."""
    parts = [F.when(text.rlike(GATES[kind]), F.transform(_found(text, kind, pattern), _measurer(kind))) for kind, pattern in CANDIDATES.items()]
    return F.flatten(F.filter(F.array(*parts), lambda p: p.isNotNull()))


def _features(span: Column, before: Column, kind: str) -> Column:
    hit = span["hit"]
    count = lambda chars: F.length(F.regexp_replace(hit, f"[^{chars}]", "")).cast("double")
    flag = lambda c: c.cast("int").cast("double")
    named = {
        **{f"is_{k}": F.lit(float(k == kind)) for k in CANDIDATES},
        "length": F.length(hit).cast("double"),
        "digits": count("0-9"),
        "letters": count("A-Za-z"),
        "capitals": count("A-Z"),
        "turns": (F.size(F.regexp_extract_all(hit, F.lit("[a-z][A-Z0-9]|[0-9][A-Za-z]|[A-Z][0-9]"), F.lit(0)))).cast("double"),
        "separators": count(r"\x20.-"),
        "brackets": count(r"()\[\]"),
        "slashes": count("/"),
        "colons": count(":"),
        "distinct": F.size(F.array_distinct(F.split(hit, ""))).cast("double"),
        "longest": F.array_max(F.transform(F.split(hit, "[^0-9]"), lambda p: F.length(p))).cast("double"),
        "checks": flag(_mod97(hit) if kind == "iban" else _luhn(F.regexp_replace(hit, "[^0-9]", "")) if kind == "card" else F.lit(False)),
        "dated": flag(hit.rlike(r"^(?:(?:19|20)[0-9]{2}[-/. ][0-9]{2}[-/. ][0-9]{2}|[0-9]{2}[-/. ][0-9]{2}[-/. ](?:19|20)[0-9]{2}|[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?)$")),
        "context": flag(before.rlike(rf"(?:{CONTEXT[kind]})")),
        "against": flag(before.rlike(rf"\b(?:{AGAINST})\b")),
        "quoted": flag(before.rlike("[\"'`=:]\\s*$")),
    }
    return F.struct(span["kind"].alias("kind"), span["start"].alias("start"), span["end"].alias("end"), *[named[f].alias(f) for f in FEATURES])


def _templates(seed: str) -> list[tuple[int, int, Column]]:
    """(part, label, text) of generated sentences: part 0 trains, part 1 calibrates; templates of the parts differ."""
    pick = lambda k, m: F.pmod(F.xxhash64(F.lit(seed), "id", F.lit(k)), F.lit(m))
    num = lambda k, w: F.lpad(pick(k, 10**w).cast("string"), w, "0")
    word = lambda k: F.substring(F.translate(F.sha2(F.concat_ws(",", F.lit(seed), F.lit(str(k)), F.col("id").cast("string")), 256), "0123456789", "ghijklmnop"), F.lit(1), (pick(f"w{k}", 7) + 3).cast("int"))
    name = lambda k: F.initcap(word(k))
    hexed = lambda k, w: F.substring(F.sha2(F.concat_ws("-", F.lit(str(k)), F.col("id").cast("string")), 256), 1, w)
    key = F.substring(F.sha2(F.col("id").cast("string"), 256), F.lit(1), (pick("kl", 30) + 24).cast("int"))
    mixed = F.substring(F.translate(F.base64(F.unhex(F.sha2(F.col("id").cast("string"), 256))), "=", ""), 1, 40)
    cased = F.regexp_replace(mixed, "[0-9/+]", "x")
    plain = F.concat(F.lit("DE00"), num("i1", 6), num("i2", 6), num("i3", 6))
    # check digits that make the remainder 1: letters D and E are 13 and 14
    rest = F.aggregate(F.split(F.concat(num("i1", 6), num("i2", 6), num("i3", 6), F.lit("131400")), ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise((a * 10 + c.cast("int")) % 97))
    iban = F.concat(F.lit("DE"), F.lpad((98 - rest).cast("string"), 2, "0"), F.substring(plain, 5, 18))
    spaced = F.trim(F.regexp_replace(iban, "(.{4})", "$1 "))
    v6 = F.concat_ws(":", *[hexed(f"v{i}", 4) for i in range(8)])
    cat = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    phone = lambda a, b: cat(num(1, 3), a, num(2, 3), b, num(3, 4))
    return [
        (0, 1, cat("call (", num(1, 3), ") ", num(2, 3), "-", num(3, 4))),
        (0, 1, cat("phone: ", phone("-", "-"))),
        (1, 1, cat("mobile ", phone(" ", " "))),
        (0, 1, cat("fax no. ", phone(".", "."))),
        (1, 1, cat(word(9), " (", num(1, 3), ") ", num(2, 3), "-", num(3, 4), " ", word(8))),
        (0, 1, cat("tel ", num(1, 4), " ", num(2, 3), " ", num(3, 4))),
        (0, 0, cat("on 19", num(1, 2), "-0", (pick(2, 9) + 1).cast("string"), "-", num(3, 2), " they")),
        (1, 0, cat("in 20", num(1, 2), "/", num(2, 2), "/", num(3, 2))),
        (0, 0, cat(word(1), " 20", num(1, 2), "-", num(2, 2), "-", num(3, 2))),
        (0, 0, cat("call ", "19", num(1, 2), "-", num(2, 2), "-", num(3, 2))),
        (1, 0, cat(word(1), " ", num(1, 2), "/", num(2, 2), "/20", num(3, 2))),
        (0, 0, cat("pages ", num(1, 3), "-", num(2, 3), " of ", num(3, 2))),
        (0, 0, cat("sum ", num(1, 3), " ", num(2, 3), " ", num(3, 3))),
        (1, 0, cat("total ", num(1, 2), " ", num(2, 3), " ", num(3, 3))),
        (0, 0, cat("version ", num(1, 2), ".", num(2, 2), ".", num(3, 2))),
        (1, 0, cat(word(1), " between ", num(1, 3), "-", num(2, 3), " ", num(3, 2))),
        (0, 1, cat("card ", num(1, 4), ".", num(2, 4), ".", num(3, 4), ".", num(4, 4))),
        (1, 1, cat("visa ", num(1, 4), " ", num(2, 4), " ", num(3, 4), " ", num(4, 4))),
        (0, 1, cat("paid by credit ", num(1, 4), "-", num(2, 4), "-", num(3, 4), "-", num(4, 4))),
        (0, 0, cat("row ", num(1, 4), " ", num(2, 4), " ", num(3, 4), " ", num(4, 4))),
        (1, 0, cat("figure ", num(1, 4), ".", num(2, 4), ".", num(3, 4), ".", num(4, 4))),
        (0, 1, cat("mail ", word(1), " (at) ", word(2), " dot com")),
        (1, 1, cat(word(1), "[at]", word(2), ".org")),
        (0, 1, cat(word(1), " (at) ", word(2), " (dot) net")),
        (0, 1, cat("contact ", word(1), " at ", word(2), ".com")),
        (1, 1, cat("write to ", word(1), " at ", word(2), " dot org")),
        (0, 0, cat(word(1), " at ", word(2), " dot ", word(3))),
        (0, 0, cat(word(1), " ", word(2), " at ", word(3), ". ", name(4))),
        (1, 0, cat("look at ", word(3), ".", name(4))),
        (0, 1, cat('token = "', key, '"')),
        (1, 1, cat("api_key=", key)),
        (0, 1, cat("secret: ", mixed)),
        (1, 1, cat("password: ", cased)),
        (0, 1, cat("auth ", cased)),
        (0, 0, cat(word(1), F.repeat(word(2), 5), word(3), " and")),
        (1, 0, cat(name(1), F.repeat(word(2), 4), word(5), " is")),
        (0, 0, cat("see ", word(1), "/", word(2), "/", word(3), "/", word(4), "/", word(5), "/page")),
        (1, 0, cat(word(1), "-", word(2), "-", word(3), "-", word(4), "-", word(5))),
        (0, 0, cat("number ", F.repeat(num(1, 2), 12))),
        (0, 1, cat("iban ", iban)),
        (1, 1, cat("transfer to ", spaced)),
        (0, 1, cat("bank account ", spaced)),
        (0, 0, cat("code XA", num(1, 2), F.upper(hexed("n1", 4)), F.upper(hexed("n2", 4)), F.upper(hexed("n3", 3)))),
        (1, 0, cat("model KZ", num(1, 2), " ", F.upper(hexed("n1", 4)), " ", F.upper(hexed("n2", 4)))),
        (0, 1, cat("ssn ", num(1, 3), "-", num(2, 2), "-", num(3, 4))),
        (1, 1, cat("social security no. ", num(1, 3), "-", num(2, 2), "-", num(3, 4))),
        (0, 1, cat("tax identity: ", num(1, 3), "-", num(2, 2), "-", num(3, 4))),
        (0, 0, cat("isbn ", num(1, 3), "-", num(2, 2), "-", num(3, 4))),
        (1, 0, cat("see figure ", num(1, 3), "-", num(2, 2), "-", num(3, 4))),
        (0, 1, cat("host ", v6)),
        (1, 1, cat("from ", v6)),
        (0, 1, cat("ping ", hexed("x", 4), "::", hexed("y", 4), ":", hexed("z", 4))),
        (0, 0, cat("time ", num(1, 2), ":", num(2, 2), ":", num(3, 2))),
        (0, 0, cat("from ", num(1, 2), ":", num(2, 2), ":", num(3, 2), " until")),
        (0, 0, cat(word(1), " ", num(1, 2), ":", num(2, 2), ":", num(3, 2))),
        (1, 0, cat("host ", num(1, 2), ":", num(2, 2), ":", num(3, 2))),
        (1, 0, cat("ratio ", num(1, 1), ":", num(2, 1), ":", num(3, 1))),
        (0, 1, cat("address ", num(1, 3), " ", name(1), " Street")),
        (1, 1, cat("lives at ", num(1, 2), " ", name(1), " ", name(2), " Road")),
        (0, 1, cat("ship it to ", num(1, 4), " ", name(1), " Ave")),
        (0, 0, cat("in ", num(1, 4), " ", name(1), " ", name(2), " Court")),
        (1, 0, cat("since 19", num(1, 2), " ", name(1), " Square")),
    ]


def training_sentences(spark: SparkSession, n: int = TRAINING_ROWS, seed: str = "train") -> DataFrame:
    """part, text and label: generated sentences with one number, address or key each, which is personal (1) or not (0)."""
    made = _templates(seed)
    which = F.pmod("id", F.lit(len(made)))
    text, label, part = F.lit(""), F.lit(0.0), F.lit(0)
    for i, (p, y, t) in enumerate(made):
        text, label, part = F.when(which == i, t).otherwise(text), F.when(which == i, float(y)).otherwise(label), F.when(which == i, p).otherwise(part)
    filler = lambda k: F.element_at(F.array(*map(F.lit, ("river", "anna", "stone", "the", "of", "morgen", "lune", "casa"))), (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(8)) + 1).cast("int"))
    return spark.range(n).select("id", part.alias("part"), F.concat(filler("a"), F.lit(" "), text, F.lit(" "), filler("z"), F.lit(".")).alias("text"), label.alias("label"))


_models: dict[str, dict] = {}


def trained(spark: SparkSession) -> dict:
    """Trees (nested tuples with weights) and the threshold of each kind, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _models:
        rows = training_sentences(spark).select("part", "label", F.explode(candidates(F.col("text"))).alias("c")).select("part", "label", "c.*")
        rows = VectorAssembler(inputCols=list(FEATURES), outputCol="vector").transform(rows).cache()
        model = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=16, maxDepth=4, stepSize=0.3, seed=1).fit(rows.where("part = 0"))
        trees = [(w, _tree(t._call_java("rootNode"))) for w, t in zip(model.treeWeights, model.trees)]
        # the lowest score, in hundredths, from which 98 % of a kind's candidates are personal, in sentences of templates that were not trained on
        scored = rows.where("part = 1").withColumn("bin", F.floor(_score(trees, {f: F.col(f) for f in FEATURES}) * 100))
        bins = scored.groupBy("kind", "bin").agg(F.sum("label").alias("hits"), F.count("*").alias("n")).collect()
        cuts = {}
        for kind in CANDIDATES:
            hits = n = 0
            cuts[kind] = 2.0
            for b in sorted((r for r in bins if r["kind"] == kind), key=lambda r: -r["bin"]):
                hits, n = hits + b["hits"], n + b["n"]
                if hits >= 0.98 * n and b["bin"] >= 50:
                    cuts[kind] = b["bin"] / 100
        rows.unpersist()
        _models[app] = {"trees": trees, "thresholds": cuts}
    return _models[app]


def _tree(node):
    if node.getClass().getSimpleName() == "LeafNode":
        return node.prediction()
    split = node.split()
    return split.featureIndex(), split.threshold(), _tree(node.leftChild()), _tree(node.rightChild())


def _score(trees: list, values: dict[str, Column]) -> Column:
    def leaf(tree):
        if isinstance(tree, float):
            return F.lit(tree)
        f, at, left, right = tree
        return F.when(values[FEATURES[f]] <= at, leaf(left)).otherwise(leaf(right))

    total = F.lit(0.0)
    for weight, tree in trees:
        total = total + weight * leaf(tree)
    return 1 / (1 + F.exp(-2 * total))


def _below(spans: Column, at: Column) -> Column:
    """How many spans of a sorted array start below a place."""
    steps = F.array(*[F.lit(1 << i) for i in range(30, -1, -1)])
    return F.when(F.size(spans) == 0, 0).otherwise(F.aggregate(steps, F.lit(0), lambda n, s: F.when((n + s <= F.size(spans)) & (F.get(spans, n + s - 1)["start"] < at), n + s).otherwise(n)))


def _overlapping(spans: Column, c: Column) -> Column:
    """Those of sorted spans, apart from each other, that a span overlaps."""
    first = F.greatest(_below(spans, c["start"] + 1), F.lit(1))
    near = F.slice(spans, first, F.greatest(_below(spans, c["end"]) - first + 1, F.lit(0)))
    return F.when(F.size(spans) == 0, F.slice(spans, 1, 0)).otherwise(F.filter(near, lambda s: (s["end"] > c["start"]) & (s["start"] < c["end"])))


def _clear(groups: Column, kinds: tuple, c: Column, better: bool = False) -> Column:
    """Whether no span of any kind's group overlaps ``c``; ``better``: none that is better than it."""
    out = F.lit(True)
    for k in kinds:
        over = _overlapping(groups[k], c)
        over = F.filter(over, lambda s: s["order"] < c["order"]) if better else over
        out = out & (F.size(over) == 0)
    return out


def _by_kind(spans: Column, kinds: tuple) -> Column:
    """A struct with each kind's spans, in their order."""
    return F.struct(*[F.filter(spans, _of(k)).alias(k) for k in kinds])


def _of(kind: str):
    return lambda s: s["kind"] == kind


def added_spans(text: Column, base: Column, model: dict) -> Column:
    """Selected candidates that no base span overlaps; of overlapping ones the best, twice."""
    threshold = F.create_map(*[F.lit(x) for kv in model["thresholds"].items() for x in kv])
    kinds = tuple(CANDIDATES)
    place = F.array(*map(F.lit, kinds))

    def selected(groups: Column) -> Column:
        scored = F.transform(candidates(text), lambda c: F.struct((-_score(model["trees"], {f: c[f] for f in FEATURES})).alias("score"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind")))
        chosen = F.filter(scored, lambda c: (-c["score"] >= threshold[c["kind"]]) & _clear(groups, tuple(BASE), c))
        return F.transform(chosen, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), F.struct(F.round(c["score"], 2).alias("score"), (c["start"] - c["end"]).alias("shorter"), c["start"].alias("start"), (-F.array_position(place, c["kind"])).alias("kind")).alias("order")))

    def best(spans: Column) -> Column:
        return bound(_by_kind(spans, kinds), lambda groups: F.filter(spans, lambda c: _clear(groups, kinds, c, better=True)))

    def twice(spans: Column) -> Column:
        rest = lambda groups: F.filter(spans, lambda c: _clear(groups, kinds, c))
        more = lambda first: bound(bound(_by_kind(first, kinds), rest), best)
        return bound(best(spans), lambda first: F.concat(first, more(first)))

    found = bound(bound(_by_kind(base, tuple(BASE)), selected), lambda spans: F.when(F.size(spans) < 2, spans).otherwise(twice(spans)))
    return F.transform(found, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def all_spans(text: Column, base: Column, model: dict) -> Column:
    """Base spans and the selected further ones, by kind as listed, then start."""
    place = F.array(*map(F.lit, KINDS))
    keyed = F.transform(F.concat(base, added_spans(text, base, model)), lambda s: F.struct(F.array_position(place, s["kind"]).alias("p"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.sort_array(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with ``pii_base`` and ``pii_spans``."""
    model = trained(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumn("pii_base", base_spans(body))
    any_gate = body.rlike("|".join(f"(?:{g})" for g in GATES.values()))
    return rows.withColumn("pii_spans", F.when(any_gate, all_spans(body, F.col("pii_base"), model)).otherwise(F.col("pii_base")))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame) -> DataFrame:
    """Counts of the base spans, their digest, and all spans."""
    rows = with_spans(docs.select(F.col("doc_id").cast("bigint"), "text"))
    count = lambda k: F.size(F.filter("pii_base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return rows.select("doc_id", *[count(k) for k in BASE], F.sha2(_joined(F.col("pii_base")), 256).alias("base_sha256"), _joined(F.col("pii_spans")).alias("spans"))


def _reaches(spans: Column) -> Column:
    """``out``: each span with the furthest end before it (what ends no later than that is inside another), and the furthest of all as ``at``: by blocks of the root of their number, as in :func:`_starts`."""
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<from:bigint,start:bigint,kind:string>>").alias("out"))
    width = F.ceil(F.sqrt(F.size(spans))).cast("int")
    begins = F.when(F.size(spans) > 0, F.sequence(F.lit(1), F.size(spans), F.greatest(width, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    one = lambda a, s: F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("from"), s["start"].alias("start"), s["kind"].alias("kind")))).alias("out"))
    blocks = F.transform(begins, lambda b: F.aggregate(F.slice(spans, b, width), zero, one))
    moved = lambda x, at: F.struct(F.greatest(x["from"], at).alias("from"), x["start"].alias("start"), x["kind"].alias("kind"))
    whole = lambda a, b: F.struct(F.greatest(a["at"], b["at"]).alias("at"), F.concat(a["out"], F.transform(b["out"], lambda x: moved(x, a["at"]))).alias("out"))
    return F.aggregate(blocks, zero, whole)


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with each span replaced by its kind in angle brackets, and ``n_chars`` set anew."""
    rows = with_spans(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("text")))
    text = F.col("text")
    ordered = F.sort_array(F.transform("pii_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def pieces(spans: Column) -> Column:
        show = lambda p: F.concat(F.substring(text, (p["from"] + 1).cast("int"), F.greatest(p["start"] - p["from"], F.lit(0)).cast("int")), F.when(p["start"] >= p["from"], F.concat(F.lit("<"), p["kind"], F.lit(">"))).otherwise(""))
        return bound(_reaches(spans), lambda r: F.concat(F.array_join(F.transform(r["out"], show), ""), F.substring(text, (r["at"] + 1).cast("int"), F.length(text))))

    rows = rows.withColumn("clean", F.when(F.size("pii_spans") > 0, bound(ordered, pieces)).otherwise(text))
    new = {"text": F.col("clean"), "n_chars": F.when(F.size("pii_spans") > 0, F.length("clean").cast("bigint")).otherwise(F.col("doc.n_chars")) if "n_chars" in docs.columns else None}
    return rows.select(*[new[c].alias(c) if c in new else F.col(f"doc.`{c}`") for c in docs.columns])
