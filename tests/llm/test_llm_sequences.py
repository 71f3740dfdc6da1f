"""The conversation trie, periodic runs and license scans against brute force, and on awkward input."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.llm import periodic_runs
from shelfcast.llm.conversation_trie import NODE_COLUMNS, prefix_trie, regrafted, shard_nodes, turn_sequences
from shelfcast.llm.license_scan import TEMPLATES, Template, with_licenses
from shelfcast.llm.periodic_runs import SquareCatcher, best_run, repeated_words, with_runs
from shelfcast.llm.queries import with_planted_runs

# --- conversations ---

CONVERSATIONS = "conv_id long, turn long, role string, text string, parent string, ends long"


def brute_sequences(rows):
    by = collections.defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            name = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            by[conv].append((turn is not None, turn or 0, name, (role, text)))
    return {c: tuple(t[3] for t in sorted(ts)) for c, ts in by.items()}


def brute_trie(sequences):
    nodes, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, s in sequences.items():
        ends[s].append(c)
        for d in range(len(s) + 1):
            nodes[s[:d]].append(c)
    children = collections.Counter(k[:-1] for k in nodes if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(members) - 1) * len(k[-1][1].encode()) if k else 0
            leaves[k[:d]] += not children[k]
    digest = {k: hashlib.sha256(",".join(map(str, sorted(ends.get(k, ())))).encode()).hexdigest() for k in nodes}
    return sorted(
        (
            (min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], digest[k])
            for k, m in nodes.items()
        ),
        key=str,
    )


def random_conversations(seed, n=120):
    random.seed(seed)
    texts = [None, "", "a", "ü" * 5, "hello", "same " * 30]
    rows = [(None, 0, "user", "nobody's", "p", 1), (7, None, None, None, "p", 1), (7, None, "user", "x", "p", 1), (7, 3, "user", "x", "p", 2)]
    for c in random.sample(range(-20, 5000), n):
        for t in range(random.choice([1, 1, 2, 3, 9, 30])):
            rows.append((c, random.choice([t, t, 2]), random.choice(["user", "assistant"]), random.choice(texts[: 1 + t]), "p", t))
    return rows + rows[5:9]


@pytest.mark.parametrize("seed, shard_turns, cells", [(1, 1 << 18, 1 << 21), (2, 60, 64), (3, 30, 8)])
def test_trie_equals_brute_force(spark, monkeypatch, seed, shard_turns, cells):
    monkeypatch.setattr(shard_nodes, "__defaults__", (cells,))
    rows = random_conversations(seed)
    got = prefix_trie(turn_sequences(spark.createDataFrame(rows, CONVERSATIONS)), shard_turns)
    assert got.columns == list(NODE_COLUMNS)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_trie(brute_sequences(rows))


def test_many_equal_conversations_are_split(spark):
    """A third of all rows is one conversation; its members lie in several shards."""
    rows = [(c, t, "user", f"{t}" if c % 3 == 0 else f"{c % 7} {t}", "", 0) for c in range(600) for t in range(3)]
    got = prefix_trie(turn_sequences(spark.createDataFrame(rows, CONVERSATIONS)), 30)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_trie(brute_sequences(rows))


def test_a_long_conversation_and_none(spark):
    rows = [(1, t, "user", f"{t}", "", 0) for t in range(3000)] + [(2, 0, "user", "0", "", 0)]
    df = spark.createDataFrame(rows, CONVERSATIONS)
    got = {r["depth"]: r for r in prefix_trie(turn_sequences(df)).collect()}
    assert len(got) == 3001 and (got[1]["n_convs"], got[2]["n_convs"], got[0]["saved_tokens"]) == (2, 1, 1)
    assert got[3000]["parent_conv_id"] == 1 and got[1]["ends_sha256"] == hashlib.sha256(b"2").hexdigest()
    assert prefix_trie(turn_sequences(df.limit(0))).count() == 0


def test_heads_of_other_conversations(spark):
    rows = random_conversations(4, 60)
    own = turn_sequences(spark.createDataFrame(rows, CONVERSATIONS))
    c = F.col("conv_id")
    got = {r["conv_id"]: [bytes(t["id"]) for t in r["turns"]] for r in regrafted(own, c - c % 5, F.abs(c) % 4, 3).collect()}
    plain = {r["conv_id"]: [bytes(t["id"]) for t in r["turns"]] for r in own.collect()}
    for conv, turns in plain.items():
        base = conv - (conv % 5 if conv >= 0 else -(-conv % 5))
        h = abs(conv) % 4
        assert got[conv] == plain.get(base, [])[:h] + turns[h:]


def test_no_turns_left(spark):
    """A conversation whose head comes from an absent one, and is all it had, is at the root."""
    own = turn_sequences(spark.createDataFrame([(8, 0, "user", "x", "", 0)], CONVERSATIONS))
    got = prefix_trie(regrafted(own, F.lit(5), F.lit(8), 8)).collect()
    assert [tuple(r) for r in got] == [(8, 0, None, 1, 0, 1, 0, hashlib.sha256(b"8").hexdigest())]


# --- runs ---


def brute_runs(words, length=24, power=3):
    found = []
    for p in range(1, len(words) // power + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            run = (i, j - i + p, p)
            if j > i and run[1] >= max(length, power * p) and run[:2] not in [f[:2] for f in found]:
                found.append(run)
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def random_words(alphabet):
    words = []
    for _ in range(random.choice([1, 2, 4])):
        words += [random.randrange(alphabet) for _ in range(random.choice([0, 3, 30]))]
        root = [random.randrange(alphabet) for _ in range(random.choice([1, 2, 3, 4, 7, 8, 9, 16, 17, 31]))]
        root = root * random.choice([1, 1, 2]) + root[: random.randrange(3)]
        words += root * random.choice([2, 3, 5]) + root[: random.randrange(len(root) + 1)]
    return words


@pytest.mark.parametrize("step", [7, 1 << 16])
def test_runs_equal_brute_force(monkeypatch, step):
    monkeypatch.setattr(periodic_runs, "STEP_WORDS", step)
    random.seed(step)
    seen = 0
    for _ in range(400):
        words = random_words(random.choice([1, 2, 3, 50]))
        length, power = random.choice([1, 4, 24]), random.choice([2, 3, 3, 4])
        catcher = SquareCatcher(length, power)
        catcher.append(np.array(words))
        assert catcher.runs() == brute_runs(words, length, power), (words, length, power)
        seen += len(catcher.runs())
    assert seen > 400


def test_runs_of_words_that_defeat_hashes_and_of_many_squares():
    fibonacci = [[0], [0, 1]]
    while len(fibonacci[-1]) < 300:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    thue_morse = [i.bit_count() & 1 for i in range(4096)]
    for words in (fibonacci[-1], thue_morse):
        catcher = SquareCatcher(1, 2)
        catcher.append(np.array(words[:700]))
        assert catcher.runs() == brute_runs(words[:700], 1, 2)
    catcher = SquareCatcher()
    catcher.append(np.array(thue_morse))
    catcher.append(np.zeros(100_000, np.int64))
    assert catcher.runs() == [(4096 - (thue_morse[-1] == 0), 100_000 + (thue_morse[-1] == 0), 1)]


def test_best_run_and_what_is_left():
    assert best_run([]) is None
    assert best_run([(0, 30, 10), (40, 24, 8), (90, 50, 16)]) == (90, 50, 16)
    assert best_run([(5, 30, 10), (3, 24, 8)]) == (3, 24, 8)
    assert np.flatnonzero(~repeated_words(10, [(1, 6, 2), (2, 6, 3)])).tolist() == [0, 1, 2, 8, 9]


def test_runs_on_awkward_texts(spark):
    texts = [None, "", " \n\t", "a", "x " * 24, "x " * 23, "a b c d e f g h " * 3 + "q", "A a " * 20, "w " * 500_000, "x " * 24]
    docs = spark.createDataFrame([(i, t, f"n{i}", 5) for i, t in enumerate(texts)], "doc_id long, text string, c0 string, runs long")
    got = {r["doc_id"]: r for r in with_runs(docs).collect()}
    assert got[0]["collapsed"] == got[2]["collapsed"] == "" and got[0]["runs"] == [] and got[0]["best"] is None
    assert [tuple(r) for r in got[4]["runs"]] == [(0, 24, 1)] and got[4]["collapsed"] == "x"
    assert got[5]["runs"] == [] and got[5]["collapsed"].count("x") == 23
    assert [tuple(r) for r in got[6]["runs"]] == [(0, 24, 8)] and got[6]["collapsed"] == "a b c d e f g h q"
    assert [tuple(r) for r in got[7]["runs"]] == [(0, 40, 2)]
    assert [tuple(r) for r in got[8]["runs"]] == [(0, 500_000, 1)]
    assert got[9]["runs"] == got[4]["runs"] and got[9]["c0"] == "n9"
    empty = with_runs(docs.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "text", "c0", "runs", "best", "collapsed"]


def test_planted_runs(spark):
    import zlib

    texts = ["".join(f"w{(i * k) % 23} " for i in range(n)) for k, n in zip(range(1, 80), [0, 1, 2, 30, 100] * 16)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "a b"), (3, None)], "doc_id long, text string")
    for r in with_planted_runs(docs).collect():
        if r["doc_id"] is None:
            assert r["text"] == "a b"
        elif r["text"] is not None:
            h = zlib.crc32(str(r["doc_id"]).encode())
            words = texts[r["doc_id"]].split()
            if h % 10 == 0 and words:
                g = h // 10
                a = g % len(words)
                p = 1 + (len(words) - a) // (3 + g % 8)
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))]
            assert r["text"].split() == words


# --- licenses ---


def brute_notices(text, weights, templates=TEMPLATES, least=0.6):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    found = []
    for t in templates:
        whole = sum(weights[w] for w in t.words)
        for at in range(-len(t.words), len(words)):
            same = [0 <= at + k < len(words) and words[at + k] == w for k, w in enumerate(t.words)]
            share = sum(weights[w] for w, s in zip(t.words, same) if s) / whole
            if all(same[k] for k in t.must) and share >= least:
                found.append((t.label, t.phrase, at, share))
    return len(words), found


def test_licenses_equal_brute_force(spark):
    random.seed(3)
    vocabulary = sorted({w for t in TEMPLATES for w in t.words}) + ["zzz", "lorem", "é"]
    texts = [None, "", "!?", "MIT License", "Under-the\nMIT license, under THE mit LICENSE.", "licence", "cc by nc", "CC BY-NC 4.0 cc by nc",
             "Kind", "mit license " * 2_000, "license version 2 apache license version 2"]
    for _ in range(150):
        t = list(random.choice(TEMPLATES).words)
        for _ in range(random.choice([0, 0, 1, 2])):
            t[random.randrange(len(t))] = random.choice(vocabulary)
        cut = random.choice([0, 0, 1, 3])
        texts.append(random.choice([" ", ", ", " # "]).join(random.choices(vocabulary, k=random.randrange(20)) + t[cut:] + random.choices(vocabulary, k=3)))
    docs = spark.createDataFrame([(i, t, "x", 9) for i, t in enumerate(texts)], "doc_id long, text string, words string, n_words long")
    from shelfcast.llm.license_scan import word_weights

    weights = word_weights(docs, [w for t in TEMPLATES for w in t.words])
    got = with_licenses(docs)
    assert got.columns == ["doc_id", "text", "words", "n_words", "notices"]
    rows = {r["doc_id"]: r for r in got.collect()}
    for i, text in enumerate(texts):
        n, want = brute_notices(text, weights)
        assert rows[i]["n_words"] == n and rows[i]["words"] == "x"
        assert [(m["label"], m["phrase"], m["at"]) for m in rows[i]["notices"]] == [w[:3] for w in want], text
        assert np.allclose([m["share"] for m in rows[i]["notices"]], [w[3] for w in want])
    assert with_licenses(docs.limit(0)).count() == 0


def test_templates_need_two_mandatory_words():
    with pytest.raises(ValueError):
        Template.of("x", "a [b] c")


def test_license_scan_runs_in_the_jvm(spark):
    docs = spark.createDataFrame([(1, "mit license")], "doc_id long, text string")
    plan = with_licenses(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


