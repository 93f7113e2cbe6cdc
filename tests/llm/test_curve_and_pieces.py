"""Files of the curve are skipped by readers, anchors line up passages, and a character map's spans are the library's own."""

import glob
import random

import public_tokenizers
import pyarrow.parquet as pq
from frames import ODD, SCHEMA, row, words

from pitwise.llm import hilbert, pieces, syncmers


def files_met(path, keep):
    """Files whose ranges leave room for a row with these ranges of columns."""
    met, files = 0, sorted(glob.glob(f"{path}/**/*.parquet", recursive=True))
    for f in files:
        meta = pq.ParquetFile(f).metadata
        ranges = {}
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                column = meta.row_group(g).column(c)
                if column.path_in_schema in keep and column.statistics is not None and column.statistics.has_min_max:
                    low, high = ranges.get(column.path_in_schema, (column.statistics.min, column.statistics.max))
                    ranges[column.path_in_schema] = min(low, column.statistics.min), max(high, column.statistics.max)
        met += all(name not in ranges or (ranges[name][0] <= high and low <= ranges[name][1]) for name, (low, high) in keep.items())
    return met, len(files)


def test_readers_skip_files_in_every_dimension(spark, tmp_path):
    r = random.Random(1)
    rows = [row(i, words(r.randint(5, 200), i), lang=r.choice(("de", "en", "fr", "es")), source=f"s{r.randrange(8)}") for i in range(3000)]
    docs = spark.createDataFrame(r.sample(rows, len(rows)), SCHEMA)
    hilbert.write_shards(docs, f"{tmp_path}/curve", shards=32)
    docs.repartition(32).write.parquet(f"{tmp_path}/plain")
    assert sorted(x[0] for x in spark.read.parquet(f"{tmp_path}/curve").select("doc_id").collect()) == list(range(3000))
    for keep, most in (({"source": ("s3", "s3")}, 0.6), ({"lang": ("de", "de")}, 0.75), ({"doc_id": (0, 300)}, 0.6), ({"source": ("s3", "s3"), "doc_id": (0, 600)}, 0.35)):
        met, n = files_met(f"{tmp_path}/curve", keep)
        assert n >= 30 and met <= most * n, (keep, met, n)
        assert files_met(f"{tmp_path}/plain", keep)[0] == 32


def test_written_shards_keep_odd_rows(spark, odd, none, tmp_path):
    hilbert.write_shards(odd, f"{tmp_path}/odd", shards=4)
    assert spark.read.parquet(f"{tmp_path}/odd").count() == len(ODD)
    hilbert.write_shards(none, f"{tmp_path}/none", shards=4)
    assert not glob.glob(f"{tmp_path}/none/**/*.parquet", recursive=True)


def test_written_shards_are_those_of_the_query_and_names_do_not_clash(spark, tmp_path):
    """60,000 rows: a third of them equal in every column, and columns of the names that are added."""
    docs = spark.range(40_000).selectExpr("id as doc_id", "repeat(string(id), int(id % 7)) as text", "string(id % 5) as source", "string(id % 3) as lang", "1 as shard", "'c' as curve_size")
    docs = docs.unionByName(spark.range(20_000).selectExpr("7L as doc_id", "'same' as text", "'1' as source", "cast(null as string) as lang", "1 as shard", "'c' as curve_size"))
    shard, size = hilbert.write_shards(docs, f"{tmp_path}/curve", shards=40)
    assert (shard, size) == ("_shard", "_curve_size")
    written = spark.read.parquet(f"{tmp_path}/curve")
    assert [r["count"] for r in written.groupBy(shard).count().orderBy(shard).collect()] == [1500] * 40
    placed = hilbert.hilbert_shards(docs, shards=40)
    want = {(r.doc_id, r.shard): r.n for r in placed.groupBy("doc_id", "shard").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert {(r.doc_id, r[shard]): r.n for r in written.groupBy("doc_id", shard).agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()} == want


def test_anchors_line_up_a_shared_passage(spark):
    shared = words(60, 1)
    texts = [words(50, 2) + " " + shared + " " + words(30, 3), words(10, 4) + " " + shared + " " + words(40, 5), words(100, 6)]
    rows = syncmers.shared_runs(spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], SCHEMA)).collect()
    (found,) = rows
    shift = texts[1].index(shared) - texts[0].index(shared)
    assert (found.doc_id, found.other_id, found["shift"]) == (1, 0, shift)
    assert abs(found.start - texts[1].index(shared)) < 25 and abs(found.end - texts[1].index(shared) - len(shared)) < 25


def test_spans_through_a_character_map(tmp_path):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    rules = sentencepiece_model_pb2.ModelProto()
    rules.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    model = sentencepiece_model_pb2.ModelProto()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model.ParseFromString(f.read())
    model.normalizer_spec.precompiled_charsmap = rules.normalizer_spec.precompiled_charsmap
    path = tmp_path / "mapped.model"
    path.write_bytes(model.SerializeToString())
    own = pieces.PieceEncoder(str(path))
    assert own.map.units and not own.by_run
    r = random.Random(2)
    texts = ["ﬁne ①②  ｆｕｌｌ ｗｉｄｔｈ", "Å é ẛ̣ ㌀ …", "tab\tand​zero", "ﷺ x", "", "plain text"] + ["".join(r.choice("aﬁ①Ａẹ́ ㌀ ﷺ\t中😀.") for _ in range(r.randint(1, 40))) for _ in range(300)]
    for text in texts:
        ids = own.encode(text)[0]
        assert ids == own.lib.encode(text)
        whole, align = own.normalised(text)
        assert whole.decode() == own.lib.normalize(text), repr(text)
        spans = own.spans(text, ids).tolist()
        proto = own.lib.encode(text, return_type="proto")
        raw = text.encode()
        if not any(own.lib.is_byte(i) for i in ids):
            want = [(p.begin, p.end) for p in proto.pieces]
            assert [tuple(s) for s in spans] == want, repr(text)
        assert spans == [] or (spans[0][0] == 0 and spans[-1][1] == len(raw) and all(a[1] == b[0] for a, b in zip(spans, spans[1:])))
