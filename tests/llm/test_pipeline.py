import collections
import random
import zlib

import numpy as np
import pytest
import zstandard
from test_operators import brute_components, brute_groups, brute_toxicity, collect  # noqa: F401

from tidemark.llm import quality_rules

pipeline = pytest.importorskip("corpus_pipeline")
tokenizers = pytest.importorskip("public_tokenizers")

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, row long, n_chars long, __key string, score double"


def corpus():
    """Rows with everything that a stage must stand: nulls in any column, shared and missing ids, rows that are the same
    altogether, exact and near copies, toxic, repetitive and long texts."""
    random.seed(31)
    words = ["".join(random.choice("etaoinshrdlu") for _ in range(random.randint(2, 9))) for _ in range(700)]
    prose = lambda n: " ".join(random.choice(words) for _ in range(n))
    rows = [(i, prose(random.randint(60, 120)) + (" vile nasty foul" * 3 if i % 6 == 0 else "")) for i in range(90)]
    clean = [t for i, t in rows if i % 6]
    rows += [(200 + i, clean[i].replace(" ", "  ")) for i in range(5)] + [(300 + i, clean[i]) for i in range(5)]
    for i in range(10, 14):
        w = clean[i].split()
        w[30] = "changed"
        rows.append((400 + i, " ".join(w)))
    rows += [(None, prose(80)), (None, prose(80)), (None, clean[20]), (7, prose(90)), rows[8], rows[8], (None, None), (500, ""), (501, "the same words again " * 60), (502, prose(9000))]
    rows = [(i, t, "en" if len(t or "") % 2 else None, 5, None, "k", 0.5) for i, t in rows]
    return [*rows, (9, rows[9][1], "a", 5, None, "k", 0.5), (9, rows[9][1], "b", 5, None, "k", 0.5)]


def brute(spark, rows, labels):
    """The rows that each filtering stage leaves, by plain means."""
    compress = zstandard.ZstdCompressor(level=3).compress
    limits = quality_rules.Limits()

    def good(t):
        data = (t or "").encode()
        n, *_, repeated = quality_rules.base_counts(data)
        return n >= limits.min_words and 100 * repeated <= limits.repeat_percent * n and quality_rules.verdict(data, compress, limits)[2]

    stages = [[r for r in rows if good(r[1])]]
    scores = brute_toxicity(spark, [r[:2] for r in stages[-1]], labels)
    stages.append([r for r, s in zip(stages[-1], scores) if s < 0.5])
    groups = brute_groups([r[:2] for r in stages[-1]])
    first = {}  # of rows that are the same, one; of others with one id and text the first as JSON, which leaves out nulls
    for r, g in zip(stages[-1], groups):
        if g[3]:
            first.setdefault(r[:2], []).append((r[2] is None, r[2] or "", r))
    stages.append([min(x)[2] for x in first.values()])
    left = stages[-1]
    component = brute_components({i: r[1] for i, r in enumerate(left)}, 5, 80)
    best = {}
    for i, r in enumerate(left):
        best.setdefault(component[i][1], []).append((r[0] is None, r[0] or 0, i))
    stages.append([left[min(g)[2]] for g in best.values()])
    return stages


def test_stages_by_brute_force(spark, tmp_path):
    rows = corpus()
    labels = [(i, int(i % 6 == 0)) for i in range(0, 80)] + [(None, 1), (7, None)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    labels = [x for x in labels if None not in x]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    wants = brute(spark, rows, labels)
    assert len(rows) > len(wants[0]) > len(wants[1]) > len(wants[2]) > len(wants[3])
    for (name, stage), want in zip(pipeline.STAGES, wants):
        stage(spark, docs, str(tmp_path)).write.parquet(f"file://{tmp_path}/{name.replace(' ', '-')}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name.replace(' ', '-')}")
        assert docs.columns == [x.split()[0] for x in SCHEMA.split(", ")], name
        assert sorted(map(tuple, docs.collect()), key=repr) == sorted(want, key=repr), name
    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(tokenizers.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    ids = {r[1]: tokenizer.encode(r[1], add_special_tokens=False).ids + [1] for r in wants[-1]}
    pieces, filled = collections.Counter(), collections.defaultdict(list)
    for r in pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect():
        pieces[r.doc_id, r.start, r.length, r.ids_crc32] += 1
        filled[r.sequence_id].append((r.offset, r.length))
    for sequence in filled.values():
        ends = [a + n for a, n in sorted(sequence)]
        assert [a for a, _ in sorted(sequence)] == [0, *ends[:-1]] and ends[-1] <= 2048
    want = collections.Counter()
    for r in wants[-1]:
        for at in range(0, len(ids[r[1]]), 2048):
            part = ids[r[1]][at : at + 2048]
            want[r[0], at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert pieces == want


def test_stages_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([(1, 1)], "doc_id long, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0, name


def test_each_stage_filters_its_input(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    counts, columns = [docs.count()], docs.columns
    for i, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"file://{tmp_path}/{i}")
        before, docs = docs, spark.read.parquet(f"file://{tmp_path}/{i}")
        if i < len(pipeline.STAGES) - 1:
            assert docs.columns == columns, name
            assert docs.join(before, "doc_id", "left_anti").count() == 0
            counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]
    assert docs.select("doc_id").distinct().count() == counts[-1]
    whole = pipeline.run(spark, DATA)
    key = ["doc_id", "start", "length", "ids_crc32"]
    assert whole.select(key).exceptAll(docs.select(key)).count() == 0 and whole.count() == docs.count()
