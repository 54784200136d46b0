import hashlib
import os
import random
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
import brute  # noqa: E402
import sqlcheck  # noqa: E402

from segspark.llm import bpe, components, digest, language, licences, mixing, registry, shards, suffix_runs, token_files  # noqa: E402

SF = "/root/testdata/sf0.001"
first = lambda k: (k is not None, k or 0)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.tokenizer_path(bpe.TOKENIZER))


@pytest.mark.parametrize("name", sorted(registry.load()[1]))
@pytest.mark.parametrize("place", ["edge", "sf0.001"])
def test_check_sql(spark, edge_dir, name, place):
    folder = edge_dir if place == "edge" else SF
    con = sqlcheck.duckdb.connect()
    for t in ("documents", "labels", "pages", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    sqlcheck.compare(registry.load()[0][name](spark, folder), con, registry.load()[1][name])


@pytest.mark.parametrize("name", sorted(registry.load()[0]))
def test_empty_table(spark, empty_dir, name):
    assert registry.load()[0][name](spark, empty_dir).collect() == []


def test_token_files(result, edge_docs, library):
    got = sorted(result("op1_"), key=lambda r: r["start"])
    want, start = [], 0
    for key, text, *_ in sorted(edge_docs, key=lambda r: (first(r[0]), r[1] or "")):
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        want.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got] == want


def test_token_files_of_documents_without_a_key(spark, tmp_path, library):
    """A third of the rows has no key: several parts, no text lost, starts without gaps, text order inside a key."""
    texts = sorted(f"{i % 97} word{i} and more" for i in range(3000))
    docs = spark.createDataFrame([(None if i % 3 else i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(8)
    merge = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merge, "false")
    try:
        index = token_files.write_tokens(docs, f"file:{tmp_path}/none", bpe.tokenizer_path(bpe.TOKENIZER))
    finally:
        spark.conf.set(merge, "true")
    parts = index.where(f"first_key = {token_files.NO_KEY}").collect()
    assert len(parts) > 1 and max(r["n_docs"] for r in parts) < 1200
    rows = sorted(token_files.read_tokens(spark, f"file:{tmp_path}/none").collect(), key=lambda r: r["start"])
    want = [(None if i % 3 else i, t) for i, t in enumerate(texts)]
    want = [r for r in want if r[0] is None] + [r for r in want if r[0] is not None]
    start = 0
    for r, (key, text) in zip(rows, want, strict=True):
        ids = library.encode(text, add_special_tokens=False).ids + [1]
        assert (r["key"], r["start"], np.frombuffer(r["ids"], "<u4").tolist()) == (key, start, ids)
        start += len(ids)


def test_token_files_of_another_tokenizer(spark, tmp_path):
    """A file that is not cut at white space gets whole texts; blocks of a part follow each other."""
    from tokenizers import Tokenizer

    file = bpe.tokenizer_path("byte_bpe_50k.json")
    texts = [f"Text  number {i}\n" * i for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    token_files.write_tokens(docs, f"file:{tmp_path}/tokens", file, end_id=50256)
    rows = token_files.read_tokens(spark, f"file:{tmp_path}/tokens").orderBy("key").collect()
    library = Tokenizer.from_file(file)
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in rows] == [
        library.encode(t, add_special_tokens=False).ids + [50256] for t in texts]


def test_bpe(result, edge_docs, library):
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in result("op2_"))
    want = Counter()
    for key, text, *_ in edge_docs:
        ids = library.encode(text or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[key, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))] += 1
    assert got == want


def test_bpe_on_random_text(library):
    vocabulary = bpe.Vocabulary(bpe.tokenizer_path(bpe.TOKENIZER))
    known = token_files._Pieces(bpe.tokenizer_path(bpe.TOKENIZER), "<u4")
    rng = random.Random(5)
    letters = "aabcéE.,!'<|>0123 ΣσİKſ̣́ñ#$ \n\t\xa0　\x1c\x85각x한ﬁǅ"
    for i in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) + ("<|endoftext|>'ve" if i % 9 == 0 else "")
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(vocabulary.encode(text), "<i4").tolist() == ids
        rows = [bpe.pieces(text)]
        known.prepare(rows)
        assert np.frombuffer(b"".join(map(known.__getitem__, rows[0])), "<u4").tolist() == ids
        assert vocabulary.decode(ids) == library.decode(ids, skip_special_tokens=False)
    with pytest.raises(ValueError):
        bpe.Vocabulary(bpe.tokenizer_path("byte_bpe_50k.json"))


def test_near_duplicates(result, edge_docs):
    rows = [(r[0], r[1]) for r in edge_docs]
    want = Counter((k, n, c, k == c) for (k, _), (n, c) in zip(rows, brute.components(rows)))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in result("op3_")) == want


def test_near_duplicates_of_a_large_group(spark):
    """Many variants of one text, of which only some are linked: more than one block of a bucket."""
    from segspark.llm import minmax

    rng = random.Random(3)
    base = [f"t{i}" for i in range(150)]
    rows = []
    for i in range(700):
        words = base.copy()
        for _ in range(i % 6):
            words[rng.randrange(150)] = f"e{rng.random()}"
        rows.append((i * 3 % 701, " ".join(words)))
    got = {r["key"]: r["component_id"] for r in minmax.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: c for (k, _), (_, c) in zip(rows, brute.components(rows))}


def test_near_duplicates_of_shared_keys(spark):
    """Rows without a key, or with one repeated key, and different texts are documents of their own."""
    import corpus_pipeline

    text = lambda name: " ".join(f"{name}{i}" for i in range(60))
    rows = [(None, text("a")), (None, text("b")), (None, text("c")), (None, text("c")), (None, text("a") + " end"), (5, text("a").upper()),
            (9, text("b")), (7, text("d")), (7, text("e")), (8, text("e"))]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r["doc_id"], r["text"][:2]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == Counter({(None, "a0"): 1, (None, "b0"): 1, (None, "c0"): 1, (7, "d0"): 1, (7, "e0"): 1})


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(1000 + i, 1000) for i in range(50)] + [(rng.randrange(3000, 3100), rng.randrange(3000, 3100)) for _ in range(60)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    name = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in range(300):
        for a, b in edges:
            if a != b:
                name[a] = name[b] = min(name[a], name[b])
    assert got == name


def test_repeats(result, edge_docs):
    want = Counter((k, len((t or "").encode()), n, s, hashlib.sha256(kept).hexdigest()) for (k, t, *_), (kept, n, s) in
                   zip(edge_docs, brute.kept_bytes([r[1] for r in edge_docs])))
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in result("op4_"))
    assert got == want


@pytest.mark.parametrize("hot,length", [(suffix_runs.HOT, 400), (5, 400), (0, 400), (suffix_runs.HOT, 224), (5, 101), (0, 64)])
def test_repeats_of_random_pieces(spark, hot, length):
    """Texts made of shared pieces and periods, so that repeats overlap, nest and end inside each other; with frequent grams."""
    rng = random.Random(9)
    parts = ["".join(rng.choice("abcde ") for _ in range(rng.choice([150, 260, 410, 700]))) for _ in range(12)]
    parts += ["xy" * 300, "q" * 450, "abc" * 150]
    texts = ["".join(rng.choice(parts)[rng.randrange(3):] for _ in range(rng.randrange(1, 7))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans, _ = suffix_runs.repeated_spans(docs, hot=hot, length=length)
    got = {r["key"]: suffix_runs._rest(texts[r["key"]], r["removed"]) for r in spans.collect()}
    assert got == {i: k[0] for i, k in enumerate(brute.kept_bytes(texts, length))}


def test_ranges_of_suffixes_that_begin_alike(spark):
    """Repeated passages that all begin with the same bytes are spread over many parts, and found."""
    rng = random.Random(12)
    passages = ["0000000" + "".join(rng.choice("abcdefgh ") for _ in range(93)) for _ in range(300)]
    rows = [(i, 2, p + f"tail {i}" * 20, [0]) for k in (0, 1) for i, p in enumerate(passages, 300 * k)]
    texts = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows], "row long, text string, anchors array<bigint>")
    head = int.from_bytes(b"0000000")
    runs = suffix_runs.sorted_runs(texts, [head] * 7, length=100)
    sizes = {r["part"]: r["n"] for r in runs.selectExpr("part", "size(rows) AS n").groupBy("part").agg({"n": "sum"}).toDF("part", "n").collect()}
    assert len(sizes) == 7 and max(sizes.values()) < 600 / 4
    found = suffix_runs.merged_extents(runs, 8, length=100).collect()
    assert {r["row"] for r in found} == set(range(600)) and all((r["start"], r["end"]) == (0, 100) for r in found)


def test_loser_tree():
    rng = random.Random(2)
    runs = [sorted("".join(rng.choice("ab") for _ in range(rng.randrange(12))).encode() for _ in range(rng.randrange(30))) for _ in range(7)]
    merged = list(suffix_runs.merge_runs([suffix_runs.front_code(r) if r else ([], []) for r in runs]))
    strings = [m[2] for m in merged]
    assert strings == sorted(s for r in runs for s in r)
    assert [m[3] for m in merged][1:] == [len(os.path.commonprefix([a, b])) for a, b in zip(strings, strings[1:])]
    assert all(runs[r][i] == s for r, i, s, _ in merged)


def test_digests(result, edge_docs):
    got = result("op5_")
    assert len(got) == len(edge_docs)
    rows = sorted([(k, t or "") for k, t, *_ in edge_docs if k is not None], reverse=True) + [(None, "no key here at all")]
    want = Counter()
    for i, (k, t) in enumerate(rows):
        half, after = len(t) // 2, rows[(i + 1) % len(rows)][1]
        want[k, len(t), hashlib.sha256((t[:len(t) - half] + after[:half]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    prints = defaultdict(set)
    by_key = {k: t for k, t in rows}
    for r in got:
        prints[by_key[r["doc_id"]]].add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert (r["fingerprint"] == "") == (by_key[r["doc_id"]] == "")
    assert all(len(p) == 1 for p in prints.values())


def test_entropy_and_likeness():
    data = np.frombuffer(random.Random(4).randbytes(500).replace(b"\x01", b"aaaaaaaa"), np.uint8)
    for p, step in enumerate(digest.entropy_steps(data)):
        share = np.array(list(Counter(data[p:p + digest.FEATURE].tolist()).values())) / digest.FEATURE
        assert abs(step - digest.STEPS * (-(share * np.log2(share)).sum() / np.log2(digest.FEATURE))) <= 0.51
    rank = np.arange(digest.STEPS + 1)
    text, other = ("".join(random.Random(seed).choices("abcdefgh ijkl", k=4000)) for seed in (6, 7))
    a, b, c, d = digest.fingerprints([text, text[:3600] + other[3600:], other, text], rank)
    assert digest.likeness(a, d) == 1 and digest.likeness(a, b) > 0.7 > 0.2 > digest.likeness(a, c)
    assert digest.likeness(a, b) == digest.likeness(b, a)


def plain_digest(text, rank):
    """Fingerprint by its definition: entropy of each window, elections place by place, one filter after another."""
    data = (text or "").encode()
    data = data.ljust(digest.FEATURE, b"\0") if data else data
    n = len(data) - digest.FEATURE + 1
    steps = [int(digest.entropy_steps(np.frombuffer(data[p:p + digest.FEATURE], np.uint8))[0]) for p in range(max(0, n))]
    wins = Counter(
        min((rank[steps[p]], p) for p in range(max(0, e), min(n, e + digest.RIVALS)))[1] for e in range(1 - digest.RIVALS, n)) if n > 0 else {}
    chosen = sorted(p for p, w in wins.items() if w >= digest.WINS)
    out = b""
    for s in range(0, len(chosen), digest.PER_FILTER):
        bits = 0
        for p in chosen[s:s + digest.PER_FILTER]:
            h = 0x9E3779B97F4A7C15
            for k in range(0, digest.FEATURE, 8):
                h = (h ^ int.from_bytes(data[p + k:p + k + 8], "little")) * 0xBF58476D1CE4E5B9 % 2**64
                h ^= h >> 29
            for k in range(digest.PROBES):
                bits |= 1 << (digest.BITS - 1 - (h >> 11 * k) % digest.BITS)
        out += bits.to_bytes(digest.BITS // 8)
    return out


def test_fingerprints_by_definition():
    rng = random.Random(6)
    rank = np.array(rng.sample(range(digest.STEPS + 1), digest.STEPS + 1))
    texts = ["".join(rng.choice("abcdef é.") for _ in range(n)) for n in (0, 1, 7, 31, 32, 33, 64, 95, 190, 191, 192, 255, 260, 900, 5000)] + ["a" * 400]
    for text, own in zip(texts, digest.fingerprints(texts, rank)):
        assert own.tobytes() == plain_digest(text, rank)


def test_likeness_at_every_length():
    """Near copies are alike at every length, whichever side of a number of bytes either is on."""
    rng = random.Random(16)
    rank = np.arange(digest.STEPS + 1)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    for n in range(80, 700, 13):
        text = " ".join(rng.choice(words) for _ in range(n))[:n]
        a, b, c, d = digest.fingerprints([text, text[:-10], "more ahead" + text, " ".join(rng.choice(words) for _ in range(n))[:n]], rank)
        # Ten bytes are an eighth of the shortest text, and near all of its few windows.
        assert min(digest.likeness(a, b), digest.likeness(a, c)) > (0.7 if n >= 200 else 0.4), n
        assert digest.likeness(a, d) < 0.35, n
    text = " ".join(rng.choice(words) for _ in range(60))
    for cut in (250, 254, 255, 256, 260):
        a, b = digest.fingerprints([text[:cut], text[:cut // 2] + "other words that follow here " * 9], rank)
        assert digest.likeness(a, b) > 0.2


def test_shards(result):
    rows = result("op6_")
    assert all(r["grown_shard"] in (r["shard"], 8) for r in rows)
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))


def test_shard_weights(spark):
    """Shares follow the weights, and a weight that rises in one rack moves rows into its region only."""
    keys = spark.range(20000).withColumnRenamed("id", "doc_id")
    tree = [(0, 0, 0, 1.0), (0, 0, 1, 3.0), (0, 1, 2, 2.0), (1, 2, 3, 2.0)]
    more = [(0, 0, 0, 1.0), (0, 0, 1, 3.0), (0, 1, 2, 2.0), (1, 2, 3, 4.0)]
    both = shards.assign_shards(shards.assign_shards(keys, "doc_id", tree), "doc_id", more, "after").toPandas()
    assert np.allclose(both["shard"].value_counts(normalize=True).sort_index(), [1 / 8, 3 / 8, 2 / 8, 2 / 8], atol=0.02)
    moved = both[both["shard"] != both["after"]]
    assert len(moved) and set(moved["after"]) == {3}
    with pytest.raises(ValueError):
        shards.assign_shards(keys, "doc_id", [(0, 0, 0, 0.0)])


def test_mix(result):
    by_target = defaultdict(int)
    for r in result("op7_"):
        assert 0 <= r["taken"] <= 2 * r["size"]
        by_target[r["source_size"], r["target"]] += r["taken"]
    assert all(abs(t - got) <= 1 for (_, t), got in by_target.items())


def test_mix_targets(spark):
    docs = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 10), (None, 500)], "source string, size long")
    got = {r["_source"]: r["target"] for r in mixing.source_targets(docs).collect()}
    # 1.5 * 1610 = 2415 words by 5, 2, 1, 5: a and c stop at 200 and 20; 2195 by 2 and 5 are above 1000 for null, b has the rest.
    assert got == pytest.approx({"a": 200.0, None: 1000.0, "c": 20.0, "b": 1195.0})


def test_mixed_rows_of_one_key_and_size(spark):
    """Rows of one key, source and size are taken each for itself, so the mix emits no more than its targets."""
    import corpus_pipeline

    rows = [(None, f"one two three w{i % 6}", "en", "c") for i in range(8)] + [(1, "x " * 40, "en", "a"), (2, "y " * 30, "en", "b")]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    sizes = mixing.sized(docs)
    want = {r["_source"]: int(r["target"]) for r in mixing.source_targets(sizes).collect()}
    got = Counter()
    for r in corpus_pipeline.mixed(spark, docs, "").collect():
        got[r["source"]] += len(r["text"].split())
    assert all(abs(got[k] - n) <= 1 for k, n in want.items()) and set(got) == set(want)


def test_licences(spark):
    s = licences.SENTENCES
    texts = [
        f"{s['mit-grant']}\n{s['mit-notice']}.", f"{s['mit-notice']}. {s['mit-grant']}", f"Intro. {s['apache-reference'].upper()}! End.",
        f"{s['apache-terms']}.\n\n{s['apache-copy']}\n", f"{s['reserved']}.\nwords\n{s['mit-reference']}.", None, "",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(r["licences"], r["n_unmatched"]) for r in licences.scan_licences(docs).orderBy("doc_id").collect()]
    assert got == [("MIT", 0), ("MIT-incomplete", 1), ("Apache-2.0", 0), ("Apache-2.0", 0), ("MIT,all-rights-reserved", 0), ("", 0), ("", 0)]


def test_language(spark, result, edge_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    network = language.fit(docs.filter(~language.held_out()))
    unseen = language.classify(docs.filter(language.held_out()), network).select("lang", "lang_pred", "score").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in unseen]) > 0.97 and all(0 <= r["score"] <= 1 for r in unseen)
    again = language.fit(docs.filter(~language.held_out()))
    assert all((network.weights[k] == again.weights[k]).all() for k in network.weights)
    assert len(result("op9_")) == len(edge_docs)
    for r in result("op9_"):
        text = next(t for k, t, *_ in edge_docs if k == r["doc_id"])
        assert r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 4 == 2)
        assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, text or "")))


def test_every_language_is_learned(spark):
    docs = spark.range(140).selectExpr("id AS doc_id", "concat('text ', id) AS text", "concat('l', id % 70) AS lang")
    assert len({r["lang"] for r in language.training_documents(docs).select("lang").collect()}) == 70
    # Fewer of each label where labels are many; never none.
    for most, each in ((70, 1), (140, 2), (10, 1)):
        rows = language.training_documents(docs, most=most).groupBy("lang").count().collect()
        assert len(rows) == 70 and {r["count"] for r in rows} == {each}


def test_network_by_plain_loops():
    net = language.ByteNetwork(["a", "b", "c"], seed=3)
    x = language.windows("Größe und Länge".encode() * 30)
    for got, row in zip(net.forward(x), x, strict=True):
        pooled = []
        for w in language.WIDTHS:
            for f in range(language.FILTERS):
                best = max(sum(float(net.weights["embed"][row[i + j], k]) * float(net.weights[f"filter{w}"][j * language.EMBED + k, f])
                               for j in range(w) for k in range(language.EMBED)) for i in range(language.WINDOW - w + 1))
                pooled.append(max(0.0, best + float(net.weights[f"bias{w}"][f])))
        z = [sum(h * float(o) for h, o in zip(pooled, net.weights["out"][:, c])) + float(net.weights["out_bias"][c]) for c in range(3)]
        e = np.exp(np.array(z) - max(z))
        assert np.allclose(got, e / e.sum(), atol=1e-4)


def test_gradients():
    net = language.ByteNetwork(["a", "b"], seed=1)
    rng = np.random.default_rng(0)
    x, y = rng.integers(97, 105, (4, language.WINDOW)), np.array([0, 1, 1, 0])
    loss = lambda: -np.log(net.forward(x)[np.arange(4), y]).mean()
    grads = net.gradients(x, y)
    for name in ("out", "filter3", "embed"):
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        own = net.weights[name]
        own[at] += 1e-3
        up = loss()
        own[at] -= 2e-3
        down = loss()
        own[at] += 1e-3
        assert (up - down) / 2e-3 == pytest.approx(grads[name][at], rel=0.08)


def test_quality(result, edge_docs):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = Counter((r["doc_id"], *(r[n] for n in names)) for r in result("op10_"))
    assert got == Counter((k, *brute.base_counts(t)) for k, t, *_ in edge_docs)
    assert not any(r["kept"] and r["base_failed"] for r in result("op10_"))


def test_quality_against_labels(spark):
    from segspark.llm import quality

    sf = "/root/testdata/sf0.01"
    scored = quality.q_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    fine = scored[~scored["base_failed"]]
    assert fine[fine["quality"] == 1]["kept"].mean() > 0.99
    assert scored[scored["quality"] == 0]["kept"].mean() < 0.35


def test_quality_counts_every_trusted_document(spark):
    """More trusted documents than any sample held: target and threshold come from all of them."""
    from segspark.llm import quality

    words = [f"concat('{c}', doc_id % {m})" for c, m in zip("abcdefghijkl", range(3, 15))]
    docs = spark.range(20_500).selectExpr("id AS doc_id", f"concat_ws(' ', {', '.join(words)}) AS text")
    assert {r["score"] for r in quality.quality_filter(docs, docs.select("doc_id")).select("score").collect()} == {0.0}
    got = quality.quality_filter(docs, docs.filter("doc_id % 41 > 0").select("doc_id")).toPandas()
    trusted = got[(got["doc_id"] % 41 > 0) & ~got["base_failed"]]["score"].round(4)
    least = 2 * np.percentile(trusted, 0.1) - np.percentile(trusted, 50)
    clear = (got["score"] - least).abs() > 2e-4
    assert len(trusted) == 20_000 and (got["kept"] == (~got["base_failed"] & (got["score"] >= least)))[clear].all()


def test_pipeline(spark, edge_dir, empty_dir, edge_docs, library):
    import corpus_pipeline as pipeline

    docs, texts = spark.read.parquet(f"{edge_dir}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        docs = pipeline.store(stage(spark, docs, edge_dir), name)
        texts[name] = Counter((r[0], r[1]) for r in docs.select("doc_id", "decoded" if name == "tokens" else "text").collect())
        assert name == "tokens" or docs.columns == pipeline.COLUMNS
    lettered = [(k, t) for k, t, *_ in edge_docs if any(map(str.isalpha, t or ""))]
    assert set(texts["language"]) <= set(lettered) and sum(texts["language"].values()) >= len(lettered) - 2
    rows = list(texts["language"].elements())
    stays = {k for (k, _), (_, c) in zip(rows, brute.components(rows)) if k == c}
    assert texts["near_dedup"] == Counter({(k, t): 1 for k, t in rows if k in stays})
    rows = list(texts["near_dedup"].elements())
    assert texts["repeats"] == Counter(
        (k, kept.decode("utf-8", "ignore")) for (k, _), (kept, *_) in zip(rows, brute.kept_bytes([t for _, t in rows], pipeline.PASSAGE)))
    assert {k for k, _ in texts["mix"]} <= {k for k, _ in texts["repeats"]} and max(Counter(k for k, _ in texts["mix"].elements()).values()) <= 2
    assert texts["tokens"] == Counter((k, library.decode(
        library.encode(t, add_special_tokens=False).ids, skip_special_tokens=False)) for k, t in texts["mix"].elements())
    assert pipeline.run(spark, empty_dir).count() == 0
