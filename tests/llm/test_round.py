"""Spelling variants, page texts and conversations against plain versions."""

import itertools
import os
import random
import re
import sys
from collections import Counter

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
sys.path.insert(0, os.path.dirname(__file__))
import conftest as tables  # noqa: E402
import sqlcheck  # noqa: E402

from segspark.llm import conversations, html_text, variants  # noqa: E402


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def test_near_words(spark):
    """Every pair and no other, also of very long words, of letters that repeat, and of words with one prefix."""
    rng = random.Random(2)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(5, 8))) for _ in range(500)}
    words |= {"x" * k for k in range(5, 40)} | {"prefixprefix" + "".join(rng.choice("ab") for _ in range(4)) for _ in range(12)}
    long = "".join(rng.choice("abcdefgh") for _ in range(3000))
    words |= {long, long[:700] + long[701:], long[:2999] + "z", "z" + long, long[:1500] + "z" + long[1501:], long[:9] + "zz" + long[9:]}
    words = sorted(words)
    table = spark.createDataFrame([(w, i + 3) for i, w in enumerate(words)], "word string, n long").repartition(5)
    got = {(r["word"], r["other"]) for r in variants.near_pairs(table).collect()}
    less = Counter()
    want = set()
    by = {}
    for w in words:
        for i in range(len(w)):
            by.setdefault((i, hash(w[:i] + w[i + 1:])), []).append(w)
            less[w[:i] + w[i + 1:]] += 0
    for own in by.values():
        want |= {(a, b) for a in own for b in own if a != b and one_edit(a, b)}
    known = set(words)
    for w in words:
        for i in range(len(w)):
            if (v := w[:i] + w[i + 1:]) in known:
                want |= {(w, v), (v, w)}
    assert got == want


def test_nodes_are_exact(spark, monkeypatch):
    """The walk itself finds the pairs: hashed names let no other pair through to the confirmation."""
    monkeypatch.setattr(variants.F, "levenshtein", lambda a, b, most: variants.F.lit(1))
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(5, 9))) for _ in range(400)})
    pairs = variants.near_pairs(spark.createDataFrame([(w, 3) for w in words], "word string, n long")).collect()
    assert {(r["word"], r["other"]) for r in pairs} == {(a, b) for a in words for b in words if one_edit(a, b)}


def best(pattern):
    """Least (cost, edits) by plain dynamic programming over all states, strings and all."""
    following = lambda q, r: {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((q, r))

    def closed(state):
        for _ in range(3):
            for q, (c, a) in list(state.items()):
                for r in "ua":
                    if to := following(q, r):
                        state[to] = min(state.get(to, (10**9, "")), (c + 5, a + "I"))
        return state

    state = closed({"": (0, "")})
    for kind in pattern:
        new, more = {}, 5 if kind.isupper() else 0
        for q, (c, a) in state.items():
            steps = [(q, c + 2, a + "D")]
            if kind != "-":
                steps += [(following(q, kind.lower()), c + more, a + "K")] + [(following(q, r), c + 1 + more, a + "R") for r in "ua"]
            for to, cost, edits in steps:
                if to is not None:
                    new[to] = min(new.get(to, (10**9, "")), (cost, edits))
        state = closed(new)
    return min(state[q] for q in ("", "a") if q in state)


def test_cheapest_edits():
    for n in range(4):
        for p in itertools.product("suaxSUAX-", repeat=n):
            assert conversations.cheapest("".join(p)) == best("".join(p))
    rng = random.Random(3)
    for _ in range(400):
        p = "".join(rng.choice("suauauaxSUAX-") for _ in range(rng.randint(4, 60)))
        assert conversations.cheapest(p) == best(p)


@pytest.mark.parametrize("block", [3, 50])
def test_blocks_of_a_conversation(spark, edge_dir, monkeypatch, block):
    """Small blocks: the same rows as from the whole conversations."""
    monkeypatch.setattr(conversations, "BLOCK", block)
    con = sqlcheck.duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{edge_dir}/conversations.parquet')")
    sqlcheck.compare(conversations.q_repair(spark, edge_dir), con, conversations.SQL)


def test_repaired_turns(spark, edge_dir):
    turns = conversations.damage(spark.read.parquet(f"{edge_dir}/conversations.parquet"))
    rows = conversations.repaired_turns(turns).orderBy("conv_id", "part", "block", "place").collect()
    sha = {r["conv_id"]: r["repaired_sha256"] for r in conversations.repair(turns).collect()}
    for conv, digest in sha.items():
        own = [(r["role"], r["text"]) for r in rows if r["conv_id"] == conv]
        assert conversations._sha(own) == digest
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in own))


@pytest.fixture(scope="module")
def model(spark):
    return html_text.fit(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))


def kept(page):
    inside = [False] * len(page.tag)
    for i in range(1, len(inside)):
        inside[i] = page.keep[i] or inside[page.parent[i]]
    return " ".join(t for n, t, _ in page.blocks if inside[n])


def test_unseen_layouts(model):
    """Layouts that were not learned: nearly all texts exactly, and nearly all words."""
    rng = random.Random(77)
    words = ["".join(rng.choice("aeiourstlnmkp") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    long = [" ".join(rng.choice(words) for _ in range(rng.randint(6, 70))).capitalize() + "." for _ in range(300)]
    exact = both = got_words = want_words = 0
    for _ in range(150):
        html = html_text.layout(rng, long, words)
        got, want = html_text.main_texts([html], model)[0], kept(html_text.Page(html))
        exact += got == want
        a, b = Counter(got.split()), Counter(want.split())
        both += sum((a & b).values())
        got_words += sum(a.values())
        want_words += sum(b.values())
    assert exact >= 115 and both >= 0.97 * got_words and both >= 0.97 * want_words


def test_pages_of_the_table(spark, model):
    """The one layout of the test pages, read by a plain rule."""
    import html as entities

    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        inner = re.sub("<br>|</?(?:p|h1)>", " ", re.search("<article>(.*)</article>", r["html"], re.S)[1])
        assert html_text.main_texts([r["html"]], model)[0] == " ".join(entities.unescape(re.sub("</?b>", "", inner)).split())


def test_decoding_takes_the_best_tree():
    rng = random.Random(8)
    for _ in range(60):
        html = "".join(rng.choice(["<div>", "</div>", f"<p>{i}</p>", f"t{i} "]) for i in range(9))
        page = html_text.Page(html)
        n = len(page.tag)
        odds = np.array([rng.randint(-9, 9) + 0.5 for _ in range(n)])
        top = max(
            (sum(odds[i] for i in chosen), chosen) for k in range(n + 1) for chosen in itertools.combinations(range(n), k)
            if all(page.parent[i] in chosen for i in chosen if i))[0]
        open_nodes = set()
        worth = odds.copy()
        for i in range(n - 1, 0, -1):
            worth[page.parent[i]] += max(0, worth[i])
        assert max(0, worth[0]) == top
        text = html_text.decode(page, odds).split()
        for i in range(n):
            if worth[i] > 0 and (i == 0 or page.parent[i] in open_nodes):
                open_nodes.add(i)
        assert text == [w for node, t, _ in page.blocks if node in open_nodes for w in t.split()]


def test_boosting_learns():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = html_text.Boosted().fit(x[:2000], y[:2000])
    assert ((model.log_odds(x[2000:]) > 0) == (y[2000:] > 0)).mean() > 0.95


def test_edge_pages(result):
    got = Counter((r["page_id"], r["text"]) for r in result("op12_"))
    want = Counter((p, t) for p, _, _, t in tables.edge_pages() if t is not None)
    assert not want - got and sum(got.values()) == len(tables.edge_pages())
    assert all(r["n_chars"] == len(r["text"]) for r in result("op12_"))
