"""Each operator against a brute-force version, and its defined cases."""

import collections
import hashlib
import math
import random
import re
import zlib
from array import array

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, exact_dedup, jaccard_join, lm_scoring, packing, quality_rules, token_counts, toxicity, warc

P = pytest.importorskip("public_tokenizers")
#: The operators' own column names come along as extra columns.
SCHEMA = "doc_id long, text string, row long, n long, data string, key string, digest string, label int"


def frame(spark, texts, parts=3):
    rows = [(i, t, 1, 2, "x", "y", "z", 3) for i, t in (texts.items() if isinstance(texts, dict) else enumerate(texts))]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def texts():
    random.seed(11)
    words = ["".join(random.choice("abcdefgéß") for _ in range(random.randint(1, 7))) for _ in range(300)]
    prose = lambda n: " ".join(random.choice(words) + random.choice(["", "", ".", ",", "\n", "!"]) for _ in range(n))
    out = [prose(random.randint(1, 150)) for _ in range(60)]
    out += out[:5] + [out[0].replace(" ", "  "), out[1] + "\n"]
    out += [None, "", " ", "\n\t", "word", "same same same same same same", "The end.", "the END.", prose(6000), "x" * 9000, "日本語 テキスト　です", "a\x1cb \x85c", "<|endoftext|> text"]
    return out


def collect(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_exact_dedup(spark, texts):
    for digest_hex, batches in ((64, None), (64, 1), (1, 1)):
        got = collect(exact_dedup.exact_groups(frame(spark, texts), digest_hex, batches))
        assert len(got) == len(texts)
        groups = collections.defaultdict(list)
        for i, t in enumerate(texts):
            groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
        for norm, group in groups.items():
            keep = min(group)[1]
            for _, i in group:
                r = got[i]
                assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (keep, len(group), i == keep, hashlib.sha256(norm.encode()).hexdigest())
    kept = exact_dedup.keep_first(frame(spark, texts))
    assert kept.columns == frame(spark, texts).columns and kept.count() == len(groups)


def brute_groups(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0))
    best = {norm: min(g) for norm, g in groups.items()}
    out = []
    for i, t in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        n, nameless, keep = best[norm]
        out.append((i, None if nameless else keep, len(groups[norm]), (-len(t or ""), i is None, i or 0) == best[norm], hashlib.sha256(norm.encode()).hexdigest()))
    return out


ODD_ROWS = [(1, "same text"), (2, "same  text"), (2, "another text"), (None, "same   text"), (None, "lone"), (3, "twin"), (3, "twin"), (4, None), (5, ""), (6, " \n"), (None, "x y"), (None, "xy")]


@pytest.mark.parametrize("digest_hex", [64, 1])
def test_exact_dedup_over_calls(spark, texts, tmp_path, digest_hex):
    """The state outlives a call and an object: later documents are judged against earlier ones, and their bytes compared."""
    calls = [list(enumerate(texts))[:40], [(100 + i, (t or "") + " " * (i % 3)) for i, t in enumerate(texts)], [(i, t) for i, t in ODD_ROWS]]
    seen = []
    for number, rows in enumerate(calls):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        if number == 1:  # from files that others wrote
            docs.write.parquet(f"file://{tmp_path}/docs")
            docs = spark.read.parquet(f"file://{tmp_path}/docs")
        stream = exact_dedup.Deduplicator(spark, f"file://{tmp_path}/home", digest_hex)
        assert stream.add(docs) == number
        seen += rows
        fields = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
        got = stream.verdicts().select(*fields).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(brute_groups(seen), key=repr)
        assert (stream.clashes().count() > 0) == (digest_hex == 1)
        own = stream.verdicts(number).select(*fields).collect()
        assert sorted(map(tuple, own), key=repr) == sorted(brute_groups(seen)[-len(rows) :], key=repr)


@pytest.mark.parametrize("digest_hex", [64, 1])
def test_keep_first_by_rows(spark, digest_hex):
    docs = spark.createDataFrame([(i, t, 1, 2, "x", "y", "z", 3) for i, t in ODD_ROWS], SCHEMA)
    kept = exact_dedup.keep_first(docs, digest_hex)
    assert kept.columns == docs.columns
    want = [(None, "same   text"), (2, "another text"), (None, "lone"), (3, "twin"), (6, " \n"), (None, "x y")]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(want, key=repr)


def test_exact_dedup_runs_no_python_on_executors(spark, texts):
    for df in (exact_dedup.exact_groups(frame(spark, texts)), exact_dedup.keep_first(frame(spark, texts))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_quality_rules(spark, texts):
    docs = {i: t for i, t in enumerate(texts)} | {500: "la la " * 400, 501: " ".join(f"w{random.random()}" for _ in range(300)), 502: "\n".join(["one line that says it"] * 80)}
    got = collect(quality_rules.measure(frame(spark, docs)))
    word = re.compile(r"[^\x20\x09-\x0D]+")
    for i, t in docs.items():
        t = t or ""
        w = word.findall(t)
        seen = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {j + d for j in range(len(w) - 2) if seen[tuple(w[j : j + 3])] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if word.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert got[501].kept and not got[500].kept
    # The method's own verdict: repetition that the base rules do not see, and text that does not compress.
    noise = "".join(chr(random.randrange(33, 126)) + (" " if random.random() < 0.1 else "") for _ in range(9000)) + "".join(chr(random.randrange(0x4E00, 0x9FFF)) for _ in range(9000))
    slow = " ".join(f"number {i // 7} of the long list" for i in range(3000))
    got = collect(quality_rules.measure(frame(spark, [noise, slow])))
    assert not got[1].kept and got[1].ratio > 4.2 and got[0].ratio < 1.6
    assert quality_rules.keep_good(frame(spark, docs)).columns == frame(spark, docs).columns


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    rows = packing.pack(exactly_saved(packing.cut(frame(spark, texts), path)), group_rows=40).collect()
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, x in ids.items():
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at
            at += length
        assert at == len(x)
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048


def test_word_ids_are_the_library_s():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    own = packing.WordIds(path, most=200)
    random.seed(2)
    # Letters with a lower case of two, letters that are taken apart, marks that join them, white space of all kinds.
    pool = "abcXYZ\u0130\u0131ßÄé\u03a3\u03c2\u0958\u09dc\u0301\u093c'’.,;!-_#$\"()  \n\t\x85\u2028\u3000\x1c019日ーﬁªⅧ"
    words = ["don't", "dogs'", "rock'n'roll", "x\u0958,", "word$$$", "%%%", "THE", "\u0130stanbul", "o''s"]
    texts = ["".join(random.choice(pool) for _ in range(random.randint(0, 40))) for _ in range(1500)] + [" ".join(random.choices(words, k=6)) for _ in range(200)]
    for i in range(0, len(texts), 170):
        for text, got in zip(texts[i : i + 170], own.encode(texts[i : i + 170])):
            assert got == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def exactly_saved(df):
    from tidemark.llm.common import save

    return save(df, "test")


def test_minimum_slack():
    random.seed(3)
    for _ in range(300):
        counts = {random.randint(1, 40): random.randint(1, 3) for _ in range(random.randint(0, 7))}
        capacity = random.randint(1, 70)
        sums = {0}
        for length, n in counts.items():
            sums = {s + length * k for s in sums for k in range(n + 1) if s + length * k <= capacity}
        total, used = packing.fill(counts, capacity)
        assert total == max(sums) == sum(a * n for a, n in used) and all(n <= counts[a] for a, n in used)
        left = collections.Counter()
        for pattern, windows in packing.patterns(counts, 70):
            assert sum(a * n for a, n in pattern) <= 70
            left.update({a: n * windows for a, n in pattern})
        assert left == counts


def test_warc(spark, texts, tmp_path):
    html = dict(enumerate(texts)) | {200: "y" * 100, 201: "y" * 100, 202: "z" * 99, 203: "z" * 99, 204: "\r\n\r\nWARC/1.1\r\n\r\n" * 30, 205: "\r\n\r\nWARC/1.1\r\n\r\n" * 30}
    pages = spark.createDataFrame([(i, None if i % 5 == 0 else f"http://x/{i}\r\nbad: 1", t, "extra") for i, t in html.items()], "page_id long, url string, html string, records string")
    manifest = warc.write_archives(pages.repartition(3), f"file://{tmp_path}/crawl", roll_bytes=20_000)
    assert manifest.count() > 3
    normal = warc.normalise(manifest, f"file://{tmp_path}/members")
    got = collect(warc.read_archives(normal), "page_id")
    first = {}
    for i, t in sorted(html.items()):
        first.setdefault((t or "").encode(), i)
    assert set(got) == set(html)
    for i, t in html.items():
        data = (t or "").encode()
        again = len(data) >= 100 and first[data] != i
        r = got[i]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[data] if again else None)
    # One seek reads one record; archives of many members are read as well.
    path = normal.first().path.removeprefix("file://")
    assert len(list(warc.split_records(warc.inflate(open(path, "rb"))))) == normal.first().records
    assert warc.read_archives(warc.normalise(warc.write_archives(pages.limit(0), f"file://{tmp_path}/a"), f"file://{tmp_path}/b")).count() == 0


def test_warc_keeps_every_payload(spark, tmp_path):
    """Shared and missing page_ids, repeated rows: each payload can be read from some response."""
    rows = [(1, "a" * 200), (5, "a" * 200), (5, "b" * 200), (5, "b" * 200), (None, "a" * 200), (None, "c" * 200), (None, "c" * 200), (7, None), (7, "")]
    pages = spark.createDataFrame([(i, None, t) for i, t in rows], "page_id long, url string, html string").repartition(2)
    got = warc.read_archives(warc.normalise(warc.write_archives(pages, f"file://{tmp_path}/a"), f"file://{tmp_path}/b")).collect()
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = [(1, digest("a" * 200), "response", None), (5, digest("a" * 200), "revisit", 1), (None, digest("a" * 200), "revisit", 1)]
    want += [(5, digest("b" * 200), "response", None)] * 2 + [(None, digest("c" * 200), "response", None)] * 2 + [(7, digest(""), "response", None)] * 2
    assert sorted(((r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == sorted(want, key=repr)


def test_byte_bpe(spark, texts):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = byte_bpe.load_ranks(path)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = collect(byte_bpe.encode_documents(frame(spark, texts), path, P.PATTERN, keep_ids=True))
    for i, t in enumerate(texts):
        ids = own.encode_ordinary(t or "")
        data = np.array(ids, "<u4").tobytes()
        r = got[i]
        assert (r.n_tokens, bytes(r.ids), r.ids_sha256, r.decoded_sha256) == (len(ids), data, hashlib.sha256(data).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    encoder = byte_bpe.TextEncoder(ranks, P.PATTERN, memory=50)
    random.seed(4)
    pool = "abthe  \n\t'sll é日本\x1c\x85　😀0123!!--aaaaaa"
    for _ in range(2000):
        x = "".join(random.choice(pool) for _ in range(random.randint(0, 60)))
        assert list(array("I", encoder.encode(x))) == own.encode_ordinary(x)
    assert all(encoder.bpe.reduce(k) == [v] and encoder.bpe.merge(k) == (v,) for k, v in list(ranks.items())[::50])


def test_token_counts(spark, texts):
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = P.path("piece_bpe_32k.model")
    pieces = token_counts.load_pieces(path)
    for by_bytes in (True, False):
        bytes_ = [(f"<0x{i:02X}>", 0.0) for i in range(256)] if by_bytes else []
        model = Tokenizer(models.Unigram([("<unk>", 0.0), *bytes_, *pieces], unk_id=0, byte_fallback=by_bytes))
        model.pre_tokenizer = pre_tokenizers.Metaspace(replacement=token_counts.MARK, prepend_scheme="always", split=True)
        got = collect(token_counts.count_tokens(frame(spark, texts), path, by_bytes))
        for i, t in enumerate(texts):
            assert got[i].n_unigram_tokens == len(model.encode(t or "", add_special_tokens=False).ids)


def brute_ppm(train, text, order):
    seen = collections.defaultdict(collections.Counter)
    pad = bytes([lm_scoring.START]) * order
    for t in train:
        z = pad + t + b"\xff"
        for i in range(order, len(z)):
            for k in range(order + 1):
                seen[z[i - k : i]][z[i]] += 1
    z, total = pad + text + b"\xff", 0.0
    for i in range(order, len(z)):
        excluded, p = set(), 1.0
        for k in range(order, -1, -1):
            live = {s: n for s, n in seen.get(z[i - k : i], {}).items() if s not in excluded}
            if z[i] in live:
                p *= live[z[i]] / (sum(live.values()) + len(live))
                break
            if live:
                p *= len(live) / (sum(live.values()) + len(live))
            excluded |= set(live)
        else:
            p /= lm_scoring.SYMBOLS - len(excluded)
        total += math.log10(p)
    return total


def test_lm_scoring(spark, texts, monkeypatch):
    docs = {i: t for i, t in enumerate(texts) if len(t or "") < 3000}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    low = {i: (t or "").encode().lower() for i, t in docs.items()}
    train = [x for i, x in low.items() if not held[i]]
    counts = collections.Counter(w for x in train for w in [*x.split(), b""])
    n, v = sum(counts.values()), len(counts)
    for shard, common in ((10**6, 10**6), (300, 3), (40, 10**6)):  # with 40 entries in a shard, pairs of bytes are split
        monkeypatch.setattr(lm_scoring, "BLOCK_ROWS", 7)
        got = collect(lm_scoring.score(frame(spark, docs), lm_scoring.fold(F.col("doc_id"), 7) == 2, order=3, shard_grams=shard, common_words=common))
        for i, x in low.items():
            words = [*x.split(), b""]
            r = got[i]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(words), sum(counts[w] > 0 for w in words), n)
            assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words))
            if i % 7 == 0 or not x:
                assert r.score == pytest.approx(brute_ppm(train, x, 3))


def test_trie_sums_to_one():
    grams = np.unique(lm_scoring.grams_of([b"abracadabra", b"abba"], 2)[0], return_counts=True)
    low, at = np.unique(grams[0] & np.uint64(0xFFFF), return_inverse=True)
    trie = lm_scoring.Trie(*grams, low, np.bincount(at, weights=grams[1]), 2)
    symbols = [s for s in range(256) if s != lm_scoring.START]
    for context in (b"ab", b"ra", b"zz", b"xa"):
        keys = np.array([(context[0] << 16) | (context[1] << 8) | s for s in symbols], np.uint64)
        assert (10 ** trie.log10(keys)).sum() == pytest.approx(1)


def test_toxicity(spark):
    random.seed(8)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(400)]
    docs, labels = {}, []
    for i in range(600):
        bad = i % 4 == 0
        t = [random.choice(words) for _ in range(40)]
        if bad:
            t[random.randrange(40)] = random.choice(["vile", "nasty", "foul"])
            t[random.randrange(40)] = "nasty,"
        docs[i] = " ".join(t)
        if i < 400:
            labels.append((i, int(bad)))
    docs |= {900: None, 901: "", 902: "nasty " * 2000}
    table = spark.createDataFrame([*labels, (1, None), (None, 1)], "doc_id long, toxic int")
    held = toxicity.fold(F.col("doc_id")) == 0
    got = collect(toxicity.score(frame(spark, docs), table, ~held, held))
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    right = sum(got[i].predicted == (i % 4 == 0) for i in range(600))
    assert right >= 590 and got[902].predicted == 1 and got[900].predicted == got[901].predicted == 0
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in docs)
    none = toxicity.score(frame(spark, docs), table.limit(0), ~held, held)
    assert {r.score for r in none.collect()} == {0.0}
    kept = toxicity.keep_clean(frame(spark, docs), table)
    assert kept.columns == frame(spark, docs).columns and kept.count() == sum(r.predicted == 0 for r in got.values())


def check_index(examples, queries, idf, k, **options):
    index = toxicity.BlockMaxIndex(examples, idf, **options)
    dense = np.zeros((len(examples), len(idf)))
    for i, (t, n) in enumerate(examples):
        dense[i, t] = index.weigh(t, n)
    for (t, n), (ids, cosines) in zip(queries, index.nearest(queries, k), strict=True):
        all_ = dense[:, t] @ index.weigh(t, n) if len(t) else np.zeros(len(examples))
        want = sorted((-round(c, 9), i) for i, c in enumerate(all_) if round(c, 9) > 0)[:k]
        assert ids.tolist() == [i for _, i in want] and cosines.tolist() == pytest.approx([-c for c, _ in want])


def sparse(terms, times=None):
    return np.array(terms, np.int64), np.array(times or [random.randint(1, 3) for _ in terms], float)


def test_block_max_is_exact():
    random.seed(9)
    idf = np.array([random.uniform(0, 3) for _ in range(12)])
    vector = lambda: sparse(sorted(random.sample(range(12), random.randint(0, 4))))
    examples = [vector() for _ in range(300)]  # many ties
    for k in (1, 10, 299, 300, 400):
        check_index(examples, [vector() for _ in range(60)], idf, k, block=16, frequent=0.2)
    check_index([], [vector()], idf, 5)


def test_block_max_is_exact_over_many_terms():
    random.seed(10)
    idf = np.array([random.uniform(1, 3) * (20 if i % 50 == 0 else 1) for i in range(3000)])
    vector = lambda: sparse(sorted({min(2999, int(random.expovariate(0.01))) for _ in range(random.randint(0, 80))}))
    examples = [vector() for _ in range(2000)]
    for k in (3, 200):
        check_index(examples, [vector() for _ in range(60)] + examples[:300], idf, k)


def brute_toxicity(spark, docs, labels):
    """Score by row number of ``docs`` (doc_id, text): dense vectors, all cosines sorted, votes and curve."""
    ids = sorted({i for i, _ in docs if i is not None})
    draws = {r.doc_id: r.h for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    known, example = {}, {}
    for i, y in labels:
        if zlib.crc32(str(i).encode()) % 5 and i in draws:
            known[i] = max(y, known.get(i, 0))
            example[i] = min(t or "" for j, t in docs if j == i)
    order = sorted(known, key=lambda i: (draws[i], i))
    count = lambda t: collections.Counter(re.findall(r"[^\W\d_]+", (t or "").lower()))
    terms, own = [count(t) for _, t in docs], {i: count(example[i]) for i in order}
    vocabulary = sorted({w for c in own.values() for w in c})
    toxic, k = np.array([known[i] for i in order]), toxicity.neighbours(len(order))
    bad, good, idf = toxic.sum(), len(toxic) - toxic.sum(), []
    for w in vocabulary:
        a, b = (sum(w in own[i] for i in order if known[i] == y) for y in (1, 0))
        under = (a + b) * (len(order) - a - b) * bad * good
        phi = max(0, abs(a * (good - b) - b * (bad - a)) - len(order) / 2) / math.sqrt(under) if under else 0
        idf.append((1 + math.log((1 + len(docs)) / (1 + sum(w in c for c in terms)))) * (1 + toxicity.RELEVANCE * phi))

    def unit(c):
        v = np.array([(1 + math.log(c[w])) if c[w] else 0.0 for w in vocabulary]) * np.array(idf)
        return v / np.linalg.norm(v) if len(v) and np.linalg.norm(v) else v

    matrix, prior = np.array([unit(own[i]) for i in order]), toxic.mean()

    def vote(c, leave=None):
        cosines = np.round(matrix @ unit(c), 9)
        near = sorted((-x, j) for j, x in enumerate(cosines) if x > 0 and j != leave)[:k]
        w = np.array([1 / (1 + x + toxicity.NEAR) for x, _ in near])
        return (w @ toxic[[j for _, j in near]] + prior) / (w.sum() + 1) if near else -1.0

    pairs = [(vote(own[i], j), known[i]) for j, i in enumerate(order)]
    xs, ys = toxicity.isotonic([v for v, _ in pairs if v >= 0], [y for v, y in pairs if v >= 0])
    alone = [y for v, y in pairs if v < 0]
    lonely = (sum(alone) + prior) / (len(alone) + 1)
    votes = [vote(c) for c in terms]
    return [lonely if v < 0 else min(1, max(0, np.interp(v, xs, ys))) for v in votes]


def test_toxicity_scores_by_brute_force(spark):
    """Every score of a whole table."""
    random.seed(14)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(120)]
    docs = {i: " ".join([random.choice(words) for _ in range(random.randint(0, 25))] + ["Vile, nasty"] * (i % 7 == 0)) for i in range(150)}
    docs |= {i: docs[i - 100] for i in range(200, 220)} | {900: None, 901: "", 902: "unheard of", 903: "12 34"}
    labels = [(i, int(i % 7 == 0 or i % 31 == 0)) for i in range(0, 150, 2)] + [(901, 0), (4, 1)]
    held = toxicity.fold(F.col("doc_id")) == 0
    got = collect(toxicity.score(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int"), ~held, held))
    for i, want in zip(docs, brute_toxicity(spark, list(docs.items()), labels)):
        assert got[i].score == pytest.approx(want, abs=1e-6), i
        assert got[i].predicted == (got[i].score >= 0.5)
    assert len({r.score for r in got.values()}) > 10


def test_toxicity_rows_stand_for_themselves(spark):
    bad, good = "you vile nasty creature of the deep", "the quiet harbour lay behind the hill"
    rows = [(i, f"{bad if i % 2 else good} number {'abcdefghij'[i % 10]}", 1, 2, "x", "y", "z", 3) for i in range(60)]
    extra = [(5, good, 1, 2, "x", "y", "z", 3), (None, bad, 1, 2, "x", "y", "z", 3), (None, good, 1, 2, "x", "y", "z", 3), (8, None, 1, 2, "x", "y", "z", 3), rows[6], rows[6]]
    docs = spark.createDataFrame(rows + extra, SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns
    want = [(r[0], r[1]) for r in rows + extra if "vile" not in (r[1] or "")]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(want, key=repr)
    held = toxicity.fold(F.col("doc_id")) == 0
    got = toxicity.score(docs, labels, ~held, held).collect()
    assert len(got) == len(rows) + len(extra) and all(r.held_out for r in got if r.doc_id is None)


def brute_components(docs, k, percent):
    sets = {}
    for i, t in docs.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_copies():
    random.seed(5)
    words = [f"w{i}" for i in range(900)]
    doc = lambda n: [random.choice(words) for _ in range(n)]
    base, passage, chain, out = doc(90), doc(80), doc(100), []
    for _ in range(90):
        d = list(base)
        for _ in range(random.randint(0, 4)):
            d[random.randrange(len(d))] = random.choice(words)
        out.append(" ".join(d))
    out += [" ".join(passage + doc(random.choice([2, 6, 10, 40]))) for _ in range(80)]
    for _ in range(40):
        chain = chain[2:] + doc(2)
        out.append(" ".join(chain))
    return out + out[:7] + [x.upper() for x in out[:3]]


def test_jaccard_join(spark, texts):
    docs = dict(enumerate(near_copies() + texts))
    want = brute_components(docs, 4, 85)
    for most, pivots in ((10**6, 16), (900, 1), (900, 0)):
        rows = jaccard_join.join_components(frame(spark, docs), 4, 85, most, pivots).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want and len(rows) == len(docs)


def test_heap_merge():
    assert jaccard_join.heap_merge([[1, 4, 9], [4], [], [0, 4, 9]]) == {0: 1, 1: 1, 4: 3, 9: 2}
    assert jaccard_join.heap_merge([]) == {}


def test_search_finds_all_links():
    random.seed(6)
    for halves in (False, True):
        for _ in range(60):
            sets = [np.array(sorted(random.sample(range(25), random.randint(1, 14))), np.int64) for _ in range(25)]
            sizes = [len(s) for s in sets]
            root = list(range(25))
            found = list(jaccard_join.search(sets, sizes, 60))
            if halves:  # by themselves, and against each other
                a, b = (sets[:12], sizes[:12]), (sets[12:], sizes[12:])
                found = list(jaccard_join.search(*a, 60)) + [(x + 12, y + 12) for x, y in jaccard_join.search(*b, 60)] + list(jaccard_join.search(*a, 60, *b))
            for a, b in found:
                root = [min(root[a], root[b]) if x in (root[a], root[b]) else x for x in root]
            want = list(range(25))
            for a in range(25):
                for b in range(a):
                    x, y = set(sets[a].tolist()), set(sets[b].tolist())
                    if 100 * len(x & y) >= 60 * len(x | y):
                        want = [min(want[a], want[b]) if v in (want[a], want[b]) else v for v in want]
            assert root == want


def test_keep_one_by_rows(spark):
    """Rows stand for themselves: shared ids, ids that are missing, and rows that are the same altogether."""
    random.seed(21)
    base = [f"w{random.randint(0, 99)}" for _ in range(60)]
    near = " ".join(base[:-1] + ["x"])
    base = " ".join(base)
    rows = [(1, base), (2, base), (2, "another text that is alone here"), (3, near), (3, near), (None, near), (None, "a text without an id that is alone"),
            (4, "twice the same row of a text"), (4, "twice the same row of a text"), (None, "nobody has an id here at all"), (None, "nobody has an id here at all"), (5, None), (6, "")]
    docs = spark.createDataFrame([(i, t, 1, 2, "x", "y", "z", 3) for i, t in rows], SCHEMA)
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    want = [(1, base), (2, "another text that is alone here"), (None, "a text without an id that is alone"), (4, "twice the same row of a text"), (None, "nobody has an id here at all"), (5, None), (6, "")]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(want, key=repr)
    got = jaccard_join.join_components(docs).collect()
    assert len(got) == len(rows) and sorted(r.component_id for r in got if r.component_id is not None) == [1, 1, 1, 1, 1, 2, 4, 4, 5, 6]


def test_empty_tables(spark):
    docs = frame(spark, ["x"]).limit(0)
    held = lm_scoring.fold(F.col("doc_id"), 7) == 2
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    empty = [
        exact_dedup.exact_groups(docs), quality_rules.measure(docs), packing.pack_documents(docs), jaccard_join.join_components(docs), lm_scoring.score(docs, held),
        toxicity.score(docs, labels, held, held), token_counts.count_tokens(docs, P.path("piece_bpe_32k.model")), byte_bpe.encode_documents(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN),
    ]
    assert [d.count() for d in empty] == [0] * len(empty)


def test_repeated_and_nameless_rows(spark, texts):
    """Operators that judge a row by its own text give a row for each: repeated ones, shared ids, and ids that are missing."""
    rows = [(i, t, 1, 2, "x", "y", "z", 3) for i, t in enumerate(texts[:6])]
    docs = spark.createDataFrame([*rows, rows[2], rows[2], (None, texts[0], 1, 2, None, None, None, None), (3, texts[4], 1, 2, "x", "y", "z", 3)], SCHEMA)
    ids = [0, 1, 2, 2, 2, 3, 3, 4, 5, None]
    got = [r for r in exact_dedup.exact_groups(docs).collect() if r.doc_id == 2]
    assert len(got) == 3 and all(r.group_size == 3 and r.kept for r in got)
    held = lm_scoring.fold(F.col("doc_id"), 7) == 2
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int")
    found = {
        "dedup": exact_dedup.exact_groups(docs), "join": jaccard_join.join_components(docs), "quality": quality_rules.measure(docs), "lm": lm_scoring.score(docs, held, order=2),
        "toxicity": toxicity.score(docs, labels, held, held), "counts": token_counts.count_tokens(docs, P.path("piece_bpe_32k.model")),
        "bpe": byte_bpe.encode_documents(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN),
    }
    for name, df in found.items():
        assert sorted((r.doc_id for r in df.collect()), key=str) == sorted(ids, key=str), name
    assert packing.pack_documents(docs).where("start = 0").count() == len(ids)
    alone = {r.doc_id: r.score for r in found["lm"].collect() if r.doc_id in (None, 0)}
    assert alone[None] == alone[0]  # the same text
    assert all(r.held_out for name in ("lm", "toxicity") for r in found[name].collect() if r.doc_id is None)


def test_packing_leaves_little_padding(spark):
    random.seed(17)
    words = [f"w{i}" for i in range(50)]
    docs = {i: " ".join(random.choice(words) for _ in range(int(random.lognormvariate(5, 1)))) for i in range(800)}
    rows = packing.pack_documents(frame(spark, docs)).collect()
    used, sequences = sum(r.length for r in rows), len({r.sequence_id for r in rows})
    assert sequences <= -(-used // 2048) * 1.01 + 1


def test_large_component_of_near_copies(spark):
    """5,000 documents of one component, some of them linked only through others, in blocks that are far smaller."""
    random.seed(23)
    words = [f"w{i}" for i in range(3000)]
    base = [random.choice(words) for _ in range(60)]
    docs = {}
    for i in range(5_000):
        d = list(base)
        for _ in range(random.randint(0, 3)):
            d[random.randrange(60)] = random.choice(words)
        docs[i] = " ".join(d)
    rows = jaccard_join.join_components(frame(spark, docs), 4, 85, search_shingles=40_000).collect()
    shingles = {i: frozenset(tuple(w[j : j + 4]) for j in range(len(w) - 3)) for i, w in ((i, t.split()) for i, t in docs.items())}
    near = shingles[min(docs, key=lambda i: -len(shingles[i] & frozenset(tuple(base[j : j + 4]) for j in range(57))))]
    got = {r.doc_id: r.component_id for r in rows}
    top = collections.Counter(got.values()).most_common(1)[0][0]
    # Whatever links with the most usual text is in its component; whatever is alone links with nothing.
    assert all(got[i] == top for i, s in shingles.items() if 100 * len(s & near) >= 85 * len(s | near))
    alone = [i for i, c in collections.Counter(got.values()).items() if c == 1]
    for i in random.sample(alone, min(60, len(alone))):
        assert not any(j != i and 100 * len(shingles[i] & s) >= 85 * len(shingles[i] | s) for j, s in shingles.items())


def test_components(spark, monkeypatch):
    from tidemark.llm import components

    random.seed(12)
    edges = [(i, i + 1) for i in range(60)] + [(random.randint(100, 400), random.randint(100, 400)) for _ in range(150)] + [(7, 7), (500, 499)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(70):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    table = spark.createDataFrame(edges, "a long, b long")
    for most in (10**6, 20):
        monkeypatch.setattr(components, "TASK_EDGES", most)
        assert {r.id: r.component for r in components.components(table).collect()} == root
    assert components.components(table.limit(0)).count() == 0


def test_toxicity_learns_from_few_labels(spark):
    random.seed(12)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(400)]
    docs = {i: " ".join([random.choice(words) for _ in range(30)] + ["vile", "nasty"] * (i % 5 == 0)) for i in range(90)}
    table = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(40)], "doc_id long, toxic int")
    held = toxicity.fold(F.col("doc_id")) == 0
    got = collect(toxicity.score(frame(spark, docs), table, ~held, held))
    assert all(got[i].predicted == 1 for i in docs if i % 5 == 0)
    assert sum(got[i].predicted for i in docs if i % 5) <= 3
    # Terms that do not go with the label make neighbours as well.
    assert all(r.neighbours for r in got.values())


def test_lm_scoring_when_splits_change_between_passes(spark, tmp_path, monkeypatch):
    path, size = f"file://{tmp_path}/docs", "spark.sql.files.maxPartitionBytes"
    docs = {i: f"text {i} " + "abc" * (i % 5) + " and more" * (i % 3) for i in range(40)}
    frame(spark, docs, 8).write.parquet(path)
    held = lm_scoring.fold(F.col("doc_id"), 7) == 2
    want = {i: r.score for i, r in collect(lm_scoring.score(spark.read.parquet(path), held, order=3)).items()}
    before, save = spark.conf.get(size), lm_scoring.save

    def saves(df, label, **more):
        out = save(df, label, **more)
        if label == "ppm-answers":
            spark.conf.set(size, "1000")
        return out

    monkeypatch.setattr(lm_scoring, "save", saves)
    try:
        got = lm_scoring.score(spark.read.parquet(path), held, order=3, shard_grams=40).collect()
    finally:
        spark.conf.set(size, before)
    assert sorted(r.doc_id for r in got) == sorted(docs) and all(r.score == pytest.approx(want[r.doc_id]) for r in got)


def test_incompressible_passages_in_ascii():
    import base64

    import zstandard

    random.seed(13)
    words = ["".join(random.choice("etaoinshrdlu") for _ in range(random.randint(2, 8))) for _ in range(300)]
    prose = " ".join(random.choice(words) for _ in range(5000)).encode()
    noise = base64.encodebytes(random.randbytes(20_000))
    compress = zstandard.ZstdCompressor(level=3).compress
    verdict = lambda data: quality_rules.verdict(data, compress, quality_rules.Limits())
    assert verdict(prose[:20_000])[1:] == (0.0, True)
    for share in (0.5, 0.6):
        n = int(20_000 * share)
        whole, bad, kept = verdict(prose[: 20_000 - n] + noise[:n])
        assert bad > 1 / 3 and not kept, (share, whole, bad)
    letters = "".join(random.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") + " " * (random.random() < 0.15) for _ in range(4000)).encode()
    assert not verdict(letters)[2]
