"""The text operators against brute force, and on awkward input."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.llm import sentencepieces
from shelfcast.llm.common import shared_folder
from shelfcast.llm.edit_counts import RANKS, Counter, build, edit, edited_counts
from shelfcast.llm.html_content import extract, main_text
from shelfcast.llm.lattice import MARK, Trie, expected_counts, marginals, viterbi
from shelfcast.llm.lattice_lm import lattice_scores
from shelfcast.llm.line_dedup import drop_repeated_lines
from shelfcast.llm.mixing import dealt, mix, split_quotas, targets
from shelfcast.llm.ngram_join import bounded, jaccard_links, near_duplicate_classes
from shelfcast.llm.robust_outliers import chi_square_quantile, robust_quality, text_counts
from shelfcast.llm.sentencepieces import Encoder, decode_ids, encode_documents
from shelfcast.llm.shingles import differing_bits, parity_bitmap, shingle_sets, wide_bitmap
from shelfcast.llm.spot_signatures import fingerprints_with_edit
from shelfcast.llm.toxicity import fit_ordinal, fit_toxicity, score_toxicity

AWKWARD = [None, "", " \n\t", "a", "a b c", "ß▁ x  y\r\n", "\n\n", "the of the", "word " * 3000]


def documents(spark, texts, **more):
    rows = [(i, t, ["en", "de", None][i % 3], [f"s{i % 4}", None][i % 7 == 0]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def words(text):
    return (text or "").encode().lower().split()


def corpus(seed, n=60):
    """Random texts with copies, near copies, short ones and awkward ones."""
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "of", "and"]
    texts = list(AWKWARD)
    for _ in range(n):
        kind = random.random()
        if kind < 0.4 or len(texts) < 12:
            texts.append(" ".join(random.choices(vocabulary, k=random.choice([3, 30, 90, 300]))))
        else:
            base = (random.choice(texts[9:]) if len(texts) > 9 else "a").split(" ")
            for _ in range(random.choice([0, 1, 1, 3, 9])):
                base[random.randrange(len(base))] = random.choice(vocabulary)
            texts.append(" ".join(base))
    return texts


# --- shingles and the join ---


def shingles(text):
    w = words(text)
    return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_classes(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_and_links(spark, seed):
    texts = corpus(seed)
    docs = documents(spark, texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicate_classes(docs).collect()}
    assert got == brute_classes(texts)
    if seed == 1:
        members, links = jaccard_links(docs)
        node = {r["key"]: bytes(r["node"]) if r["node"] else None for r in members.collect()}
        sets = [shingles(t) for t in texts]
        want = set()
        for i in range(len(texts)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if node[i] != node[j] and both and 100 * both >= 80 * len(sets[i] | sets[j]):
                    want.add((*sorted((node[i], node[j])), both))
        assert {(bytes(r["a"]), bytes(r["b"]), r["overlap"]) for r in links.collect()} == want


def test_join_on_nulls_repeats_and_nothing(spark):
    same = "one two three four five six seven"
    docs = spark.createDataFrame([(None, same), (4, same), (4, same), (9, same + " "), (2, None)], "doc_id long, text string")
    got = sorted(near_duplicate_classes(docs).collect(), key=str)
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in got) == [
        (-1, 3, 4), (2, 0, 2), (4, 3, 4), (4, 3, 4), (9, 3, 4),
    ]
    assert near_duplicate_classes(docs.limit(0)).count() == 0


def test_signatures_bound_the_overlap():
    random.seed(4)
    for _ in range(200):
        x = np.unique(np.array(random.sample(range(1, 1 << 60), 300), np.uint64))
        y = np.unique(np.concatenate([x[: random.randrange(300)], np.array(random.sample(range(1, 1 << 60), 40), np.uint64)]))
        common = len(np.intersect1d(x, y))
        apart = len(x) + len(y) - 2 * common
        one, two = (parity_bitmap(v, 1024).view(np.uint64)[None, :] for v in (x, y))
        assert np.bitwise_count(one ^ two).sum() <= apart
        assert differing_bits(wide_bitmap(x).tobytes(), wide_bitmap(y).tobytes()) <= apart
        if 100 * common >= 80 * (len(x) + len(y) - common):
            assert bounded(one, two, np.array([len(x)]), np.array([len(y)]), 80).all()


def test_shingle_sets_equal_sets_of_words():
    texts = [(t or "").encode() for t in corpus(3)]
    mine = [len(s) for s in shingle_sets(texts)]
    assert mine == [len(shingles(t.decode())) for t in texts]


# --- lines ---


def brute_lines(texts, least):
    seen = collections.Counter()
    for t in texts:
        seen.update({k for line in (t or "").encode().split(b"\n") if (k := line.strip().lower())})
    out = []
    for t in texts:
        lines = (t or "").encode().split(b"\n")
        kept = [line for line in lines if seen[line.strip().lower()] < least]
        out.append((b"\n".join(kept).decode(), len(lines), len(lines) - len(kept)))
    return out


def test_lines_against_brute_force(spark):
    random.seed(5)
    pool = ["Shared one ", "\tshared ONE", "two", "", "  ", "three", "ß line", "rare"]
    texts = ["\n".join(random.choices(pool, k=random.randrange(6))) for _ in range(40)] + AWKWARD
    docs = documents(spark, texts).withColumn("N_dropped", F.lit("clash"))
    for least in (2, 10):
        rows = drop_repeated_lines(docs, least, keep="none", bits=15).collect()
        got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in rows}
        assert [got[i] for i in range(len(texts))] == brute_lines(texts, least)
    assert set(rows[0].asDict()) == {"doc_id", "text", "lang", "source", "n_lines", "n_dropped"}
    first = drop_repeated_lines(docs, 2, keep="first")
    counted = collections.Counter(
        line.strip().lower() for r in first.collect() for line in r["text"].encode().split(b"\n") if line.strip()
    )
    assert set(counted.values()) == {1} and len(counted) >= 5
    assert drop_repeated_lines(docs.limit(0)).count() == 0
    repeated = spark.createDataFrame([(None, "x")] * 10, "doc_id long, text string")
    assert {r["text"] for r in drop_repeated_lines(repeated, 10, keep="none").collect()} == {""}


# --- quality ---


def brute_counts(text):
    t = text or ""
    w = t.encode().split()
    windows = collections.defaultdict(list)
    for i in range(len(w) - 2):
        windows[tuple(w[i : i + 3])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        dup += bool(line.encode().split()) and line in seen
        seen.add(line)
    symbols = sum(t.count(c) for c in "#*$%&|<>")
    return [len(w), sum(len(x.decode()) for x in w), symbols, dup, len(covered), t.count("\n") + 1]


def test_quality(spark):
    texts = corpus(6) + ["a b c a b c\nx\nx\n \n #*$"]
    got = [list(map(int, r)) for r in zip(*text_counts([(t or "").encode() for t in texts]), strict=True)]
    assert got == [brute_counts(t) for t in texts]
    random.seed(1)
    normal = [" ".join(f"{random.choice('abcdefg') * random.randrange(3, 8)}{random.randrange(999)}" for _ in range(random.randrange(60, 300))) for _ in range(300)]
    odd = [" ".join(f"x{i}***&&&" for i in range(80)), " ".join("y" * 200 + str(i) for i in range(90))]
    rows = robust_quality(documents(spark, normal + odd + AWKWARD)).orderBy("doc_id").collect()
    assert all(r["kept"] for r in rows[:300])
    assert [(r["kept"], r["base_failed"]) for r in rows[300:302]] == [(False, False)] * 2
    assert [r["base_failed"] for r in rows[302:]] == [True] * len(AWKWARD)
    assert robust_quality(documents(spark, ["a"]).limit(0)).count() == 0
    assert abs(chi_square_quantile(0.975, 5) - 12.8325) < 1e-3


def test_quality_with_a_third_of_copies(spark):
    random.seed(2)
    clean = [" ".join(f"{random.choice('abcdefg') * random.randrange(3, 8)}{random.randrange(999)}" for _ in range(random.randrange(60, 300))) for _ in range(134)]
    copy = " ".join(f"abcde{i}*" for i in range(150))
    rows = [(i, t, "en", "s") for i, t in enumerate(clean + [copy] * 66)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = robust_quality(docs).orderBy("doc_id").collect()
    assert not any(r["base_failed"] for r in got)
    assert [r["kept"] for r in got] == [True] * 134 + [False] * 66


# --- subword lattices ---


def all_cuts(word):
    if not word:
        yield []
    for i in range(1, len(word) + 1):
        for rest in all_cuts(word[i:]):
            yield [word[:i], *rest]


def test_lattice_against_all_segmentations():
    random.seed(2)
    pieces = {bytes(random.choices(b"abc", k=random.randrange(1, 4))): 0 for _ in range(14)}
    pieces = {p: i for i, p in enumerate(pieces)}
    scores = np.log(np.random.default_rng(1).dirichlet(np.ones(len(pieces))))
    bytes_ = np.full(256, -6.0)
    trie = Trie.of(pieces)
    assert all(trie.find(p) == i for p, i in pieces.items()) and trie.find(b"zz") == -1
    byte_ids = np.arange(256, dtype=np.int32) + len(pieces)
    every = np.concatenate([scores, bytes_])

    def paths(word):
        for cut in all_cuts(word):
            options = [[]]
            for part in cut:
                ids = ([pieces[part]] if part in pieces else []) + ([len(pieces) + part[0]] if len(part) == 1 else [])
                options = [o + [i] for o in options for i in ids]
            yield from options

    tested = [b"a", b"abcab", b"cabbac", b"zza", b"bbbbb"]
    total = marginals(trie, scores, bytes_, tested)
    best = viterbi(trie, scores, bytes_, tested, byte_ids)
    counts = expected_counts(trie, scores, bytes_, tested, np.ones(len(tested)), len(pieces))
    want_counts = np.zeros(len(every))
    for word, mass, path in zip(tested, total, best, strict=True):
        chances = {tuple(p): math.exp(sum(every[i] for i in p)) for p in paths(word)}
        assert math.isclose(math.log(sum(chances.values())), mass, abs_tol=1e-9)
        assert math.isclose(max(chances.values()), math.exp(sum(every[path])), rel_tol=1e-9)
        for p, chance in chances.items():
            for i in p:
                want_counts[i] += chance / sum(chances.values())
    assert np.allclose(counts, want_counts)


def test_lattice_scores_against_plain_counts(spark):
    texts = corpus(7)
    docs = documents(spark, texts)
    rows = {r["doc_id"]: r for r in lattice_scores(docs).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))}
    seen, ends = collections.Counter(), 0
    for i, t in enumerate(texts):
        if not held[i]:
            seen.update(words(t))
            ends += 1
    n, v = sum(seen.values()) + ends, len(seen) + 1
    by_word = {}
    for i, t in enumerate(texts):
        r, w = rows[i], words(t)
        base = sum(math.log10((seen[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[i], len(w) + 1, n)
        assert r["n_known"] == sum(seen[x] > 0 for x in w) + 1
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        by_word[i] = r["score"]
    # a text of two words is as likely as its words, less one end
    pair = lattice_scores(documents(spark, ["w1", "w2", "w1 w2", None]))
    s = {r["doc_id"]: r["score"] for r in pair.collect()}
    assert math.isclose(s[2], s[0] + s[1] - s[3], rel_tol=1e-9)
    assert lattice_scores(docs.limit(0)).count() == 0


def test_encoding_round_trip_and_library(spark, tmp_path):
    import sentencepiece
    import struct

    texts = [t for t in corpus(8)] + ["  two  spaces ", "日本語 😀▁", "\x00\x01", "a" * 5000]
    done = decode_ids(encode_documents(documents(spark, texts).withColumn("IDS", F.lit(1))))
    for r in done.collect():
        assert r["round_trip"] and r["decoded"] == (texts[r["doc_id"]] or "")
        assert len(r["ids"]) == r["n_pieces"]
    assert encode_documents(documents(spark, ["a"]).limit(0)).count() == 0

    def field(number, kind, data):
        head = bytes([number << 3 | kind]) if number < 16 else bytes([(number << 3 | kind) & 127 | 128, number >> 4])
        return head + (bytes([len(data)]) + data if kind == 2 else data)

    random.seed(3)
    own = ["▁", *"abcd"] + ["".join(random.choices("▁abcd"[1:], k=k)) for k in (2, 2, 3, 3, 4)]
    own = list(dict.fromkeys(own + ["▁ab", "▁c", "▁da"]))
    listed = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    listed += [(f"<0x{b:02X}>", -20.0, 6) for b in range(256)]
    listed += [(p, -1.0 - random.random() * 6 - 1e-3 * i, 1) for i, p in enumerate(own)]
    model = b"".join(
        field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, bytes([k])))
        for p, s, k in listed
    )
    trainer = field(3, 0, b"\x01") + field(35, 0, b"\x01")
    normal = field(1, 2, b"identity") + field(3, 0, b"\x01") + field(4, 0, b"\x00") + field(5, 0, b"\x01")
    path = tmp_path / "own.model"
    path.write_bytes(model + field(2, 2, trainer) + field(3, 2, normal))
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    mine = Encoder.load(str(path))
    for _ in range(200):
        text = "".join(random.choices("abcd   ", k=random.randrange(1, 25)))
        ids, _ends = mine.encode([text.encode()])
        score = lambda found: sum(mine.known.scores[i] for i in found)
        assert math.isclose(score(ids.tolist()), score(library.encode(text)), abs_tol=1e-4), text
        assert mine.decode(ids).decode() == text


def test_a_full_cache_keeps_what_a_batch_uses(monkeypatch):
    monkeypatch.setattr(sentencepieces, "MOST_CACHED", 5)
    encoder, cache, seen = Encoder.load(), sentencepieces.Units(), []
    plain = Encoder.encode_units
    monkeypatch.setattr(Encoder, "encode_units", lambda self, units: seen.append(sorted(units)) or plain(self, units))
    batches = [[b"one two", b"", b"three one"], [b"one  two four\xe2\x96\x81", b"two three fives six"], [b"six one one"]]
    got = [encoder.encode(batch, cache) for batch in batches]
    # " one" came and stayed, although the second batch did not fit beside the first
    assert seen[:2] == [[b" one", b" three", b" two"], [b"  two", b" fives", b" four\xe2\x96\x81", b" six"]]
    assert seen[2] == []
    for batch, (ids, ends) in zip(batches, got, strict=True):
        alone = [encoder.encode([text])[0] for text in batch]
        assert ids.tolist() == [i for path in alone for i in path]
        assert ends.tolist() == [0, *np.cumsum([len(path) for path in alone])]
        assert [encoder.decode(path) for path in alone] == batch


# --- mixing ---


def test_targets_and_quotas():
    assert targets([100, 100, 100], [5, 2, 1], 1.5, 2) == [200.0, pytest.approx(500 / 3), pytest.approx(250 / 3)]
    assert targets([], [], 1.5, 2) == [] and targets([0, 10], [1, 1], 1.5, 2) == [0.0, 15.0]
    quotas = np.array([1024, 37, 0, 500])
    table = split_quotas(quotas, 7, 1)
    assert (table.sum(axis=1) == quotas).all() and np.ptp(table.sum(axis=0)) <= 1
    assert (table == split_quotas(quotas, 7, 1)).all() and (table >= 0).all()


def test_mix(spark):
    random.seed(9)
    texts = ["w " * random.randrange(1, 60) for _ in range(400)] + AWKWARD[:-1]
    docs = documents(spark, texts).withColumn("size", F.lit("clash"))
    rows = mix(docs, shards=8).select("doc.*", F.col("size").alias("words_"), "source_size", "target", "draws")
    rows = rows.drop("size") if "size" in docs.columns else rows
    got = mix(docs.drop("size"), shards=8).collect()
    sizes = collections.Counter()
    taken = collections.Counter()
    goal = {}
    for r in got:
        assert r["size"] == len(words(r["doc"]["text"])) and len(r["draws"]) <= 2
        sizes[r["doc"]["source"]] += r["size"]
        taken[r["doc"]["source"]] += r["size"] * len(r["draws"])
        goal[r["doc"]["source"]] = r["target"]
        assert all(0 <= d["shard"] < 8 for d in r["draws"])
    order = sorted(sizes, key=lambda s: (s is None, s))
    want = targets([sizes[s] for s in order], [[5, 2, 1][i % 3] for i in range(len(order))], 1.5, 2)
    for s, target in zip(order, want, strict=True):
        assert math.isclose(goal[s], target) and abs(taken[s] - target) <= 3
    again = {r["doc"]["doc_id"]: r["draws"] for r in mix(docs.drop("size"), shards=8).collect()}
    assert again == {r["doc"]["doc_id"]: r["draws"] for r in got}
    out = dealt(mix(docs.drop("size"), shards=8), 8)
    assert out.columns == ["doc_id", "text", "lang", "source"]
    assert out.count() == sum(len(r["draws"]) for r in got)
    assert mix(docs.limit(0)).count() == 0


# --- toxicity ---


def test_ordinal_fit_orders_thresholds():
    random.seed(1)
    rows, grades = [], []
    for _ in range(300):
        g = random.choice([0, 0, 1, 2])
        rows.append(np.array(sorted({0} if g == 1 else {0, 1} if g == 2 else set()), np.int64))
        grades.append(g)
    weights, cuts = fit_ordinal(rows, np.array(grades), 2, 3)
    assert (weights > 0).all() and cuts[0] < weights[0] < cuts[1] < weights.sum()


def test_toxicity_held_out(spark):
    random.seed(2)
    def text(toxic):
        plain = [f"word{random.randrange(500)}" for _ in range(40)]
        for _ in range(3 * toxic):
            plain.insert(random.randrange(len(plain)), random.choice(["vileness", "vilest", "foulbeast", "foulbeing"]) + random.choice(["", ".", "!"]))
        return " ".join(plain)
    kinds = [i % 5 == 0 for i in range(500)]
    texts = [text(k) for k in kinds] + AWKWARD
    docs = documents(spark, texts).withColumn("Toxic", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(kinds[i])) for i in range(250)] + [(None, 1), (3, None), (99999, 1)], "doc_id long, toxic int")
    model = fit_toxicity(docs, labels)
    got = {r["doc_id"]: r for r in score_toxicity(docs, model).collect()}
    found = [got[i]["toxic"] for i in range(500)]
    assert not any(f for f, k in zip(found, kinds, strict=True) if not k)
    assert sum(found[250:]) >= 45  # of 50 that the fit has not seen
    assert not any(got[i]["toxic"] for i in range(500, len(texts)))
    assert all(0 <= got[i]["expected_severity"] <= 2 for i in range(500))
    assert min(got[i]["expected_severity"] for i in range(0, 500, 5)) > max(got[i]["expected_severity"] for i in range(500) if i % 5)
    blank = fit_toxicity(docs, labels.limit(0))
    assert not any(r["toxic"] for r in score_toxicity(docs, blank).collect())
    assert score_toxicity(docs.limit(0), model).count() == 0


# --- pages ---

PAGE = """<html><head><title>No</title><script>var a="</p>";</script></head><body>
<header class="masthead">Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies.</div><div class="sidebar"><p>Other news, read more of it.</p></div>
<{tag}><h1>The &lt;title&gt;</h1><p>First   <b>bold</b> text,\n with a <a href="x">link</a>.<br>More.
<p>Second &amp; last paragraph, which is long enough.</p><form><input><label>Mail</label></form></{tag}>
<section class="comments"><p>I like it, a lot, really.</p></section><footer>&copy; me</footer></body>"""


@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_main_text(tag):
    got = extract(PAGE.replace("{tag}", tag))
    assert got.split("\n")[-2:] == ["First bold text, with a link. More.", "Second & last paragraph, which is long enough."]
    assert "cookies" not in got and "Home" not in got and "like it" not in got and "Mail" not in got
    if tag != "div":
        assert got.startswith("The <title>\n")


@pytest.mark.parametrize("off", ["hidden", 'aria-hidden="true"', 'style="display: none"', 'class="a b c sidebar"'])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_hidden_parts_of_a_path(tag, off):
    seen, not_seen = "<p class='a b c x'>A long text, that all can see.</p>", f"<p {off}>A long note, that no one sees.</p>"
    if "class" not in off:
        seen = seen.replace(" class='a b c x'", "")
    for parts in ([seen, seen, not_seen], [not_seen, seen, seen], [seen, not_seen, seen]):
        got = extract(f"<body><{tag}>{''.join(parts)}</{tag}></body>")
        assert got == "A long text, that all can see.\nA long text, that all can see."


@pytest.mark.parametrize("tag", ["article", "main", 'div class="main"'])
def test_short_blocks_of_an_article(tag):
    prose = "This is a sentence, of some length, with points. And so on, and on: it ends here!"
    cells = [[str(10 * i + j) for j in range(3)] for i in range(1, 5)]
    table = "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in row) + "</tr>" for row in cells) + "</table>"
    items = [f"{c * 5}" for c in "abcdefghijklmnopqrst"]
    body = f"<p>{prose * 4}</p>{table}<p>{prose * 4}</p><ul>{''.join(f'<li>{i}</li>' for i in items)}</ul><aside>Ad</aside>"
    page = f"<body><nav><a href=x>Home</a></nav><{tag}>{body}</{tag.split()[0]}><div><a href=y>More</a></div></body>"
    want = [prose * 4, *(c for row in cells for c in row), prose * 4, *items]
    assert extract(page).split("\n") == want


def test_links_that_open_a_paragraph():
    one = "<p><a href=x>Spark</a> is an engine, for data of any size, as they say.</p>"
    two = "<p><b><a href=y>It</a></b> runs, <a href=z>here</a> and there, on many machines. <a href=w>More</a></p>"
    want = "Spark is an engine, for data of any size, as they say."
    assert extract(f"<div>{one}</div>") == want
    got = extract(f"<body><nav><a href=q>Home</a></nav><div>{one}{two}<p><span hidden>no</span></p></div></body>")
    assert got == want + "\nIt runs, here and there, on many machines. More"


def test_awkward_pages(spark):
    pages = [None, "", "plain text, no tags", "<p>a", "<<<>>>", "<p" + "x" * 1000, "<script>never closed", PAGE]
    df = spark.createDataFrame([(i, "u", p, "clash") for i, p in enumerate(pages)], "page_id long, url string, html string, Text string")
    rows = main_text(df).orderBy("page_id").collect()
    assert [r["text"] for r in rows[:4]] == ["", "", "plain text, no tags", "a"]
    assert all(r["n_chars"] == len(r["text"]) for r in rows) and len(rows) == len(pages)
    assert main_text(df.limit(0)).count() == 0


# --- edits ---


def test_edits_against_full_recounts(spark):
    with open(RANKS, "rb") as file:
        counter = Counter(file.read())
    random.seed(3)
    bits = ["'", "re", "  ", " ", "\n", "the", "ß", "12", "!!", " \n ", "", " don't", "日本"]
    for text in [*map(lambda t: t or "", corpus(10, 30)), "it'r e's  \n\n x"]:
        parts = counter.split(text)
        tree = build(parts, counter.counts(parts))
        for _ in range(8):
            start, cut = random.randrange(-1, len(text) + 3), random.choice([0, 1, 5, 40])
            put = "".join(random.choices(bits, k=random.choice([0, 1, 3])))
            at = min(max(start, 0), len(text))
            want = text[:at] + put + text[at + cut :]
            text = edit(counter, tree, text, start, cut, put)
            assert text == want and tree.chars[1] == len(text)
            assert tree.total() == sum(counter.counts(counter.split(text)))
    docs = documents(spark, corpus(11, 20)).withColumn("N_tokens", F.lit(0))
    for r in edited_counts(docs).collect():
        assert r["n_tokens"] == sum(counter.counts(counter.split(r["text"] or "")))
        assert r["edited_tokens"] == sum(counter.counts(counter.split(r["edited_text"])))
        assert r["edited_chars"] == len(r["edited_text"])
    assert edited_counts(docs.limit(0)).count() == 0


def test_a_grown_leaf_is_cut_without_splitting_the_text():
    with open(RANKS, "rb") as file:
        counter = Counter(file.read())
    random.seed(5)
    long = " ".join("ab" * 400 + str(i) for i in range(100))
    short = " ".join(f"w{i}" for i in range(3000))
    for text in (short, long):
        parts = counter.split(text)
        tree, whole = build(parts, counter.counts(parts)), counter.split
        counter.split = None  # an edit splits touched regions alone
        for put in [" word" * 5000, *[" x y"] * 10]:
            start = random.randrange(len(text))
            before = text
            text = edit(counter, tree, text, start, 3, put)
            assert text == before[:start] + put + before[start + 3 :] and tree.chars[1] == len(text)
        counter.split = whole
        assert tree.total() == sum(counter.counts(counter.split(text)))
        assert tree.n > 100 and len(put) < tree.read


# --- fingerprints ---


def test_fingerprints(spark):
    texts = corpus(12) + ["the cat sat on the mat", "the cat sat on the mat"]
    rows = {r["doc_id"]: r for r in fingerprints_with_edit(documents(spark, texts)).collect()}
    n = len(texts)
    for i in range(n):
        own, following = texts[i] or "", texts[(i - 1) % n] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + following[:half]
        assert rows[i]["n_chars"] == len(own)
        assert rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        same = rows[i]["fingerprint"] == rows[(i - 1) % n]["fingerprint"]
        assert (rows[i]["near_next"] == 1.0) == same and 0 <= rows[i]["near_edited"] <= 1
        assert (own == following) <= same
    assert rows[n - 1]["near_next"] == 1.0
    odd = spark.createDataFrame([(None, "the a"), (None, "the a"), (5, None), (5, "x")], "doc_id long, text string")
    assert fingerprints_with_edit(odd).count() == 4
    assert fingerprints_with_edit(odd.limit(1)).first()["near_next"] == 1.0
    assert fingerprints_with_edit(odd.limit(0)).count() == 0


# --- pipeline ---


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    random.seed(4)
    line = "a line that many documents share for good"
    texts = [" ".join(random.choices([f"w{i}" for i in range(900)], k=60)) + f"\n{line}" for _ in range(40)]
    texts += [texts[0], texts[1] + " tail", None, ""]
    texts += [" ".join(random.choices([f"v{i}" for i in range(900)], k=40)) + " vilest vileness foulbeast" for _ in range(20)]
    docs = documents(spark, texts).withColumn("n_chars", F.lit(0).cast("long"))
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 44)) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    kept = spark.read.parquet(f"{folder}/documents.parquet")
    ids = []
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, folder)
        assert kept.columns == docs.columns
        ids.append({r["doc_id"] for r in kept.collect()})
    assert ids[0] == ids[1] == set(range(44))
    assert ids[2] == set(range(44)) - {40, 41}
    assert kept.where(F.col("text").contains(line)).count() == 0
    out = corpus_pipeline.run(spark, folder)
    assert {r["doc_id"] for r in out.collect()} <= ids[2] and out.where("not round_trip").count() == 0
    assert shared_folder(spark)


def test_near_duplicates_with_repeated_ids(spark):
    import corpus_pipeline

    random.seed(8)
    a, b, c, d = (" ".join(random.choices([f"w{i}" for i in range(900)], k=60)) for _ in range(4))
    rows = [(0, c), (1, a), (1, a), (1, a), (2, a), (3, b), (3, c), (4, b), (5, d), (5, d + " end"), (None, a), (None, a), (6, ""), (6, ""), (7, None)]
    docs = spark.createDataFrame([(i, t, "en", f"s{n}", 0) for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    left = [(r["doc_id"], r["text"]) for r in got.collect()]
    fives = [x for x in left if x[0] == 5]
    assert len(fives) == 1 and fives[0][1] in (d, d + " end")
    want = [(0, c), (1, a), (3, b), (None, a), (None, a), (6, ""), (6, ""), (7, None)]
    assert sorted(map(repr, (x for x in left if x[0] != 5))) == sorted(map(repr, want))
    assert {r["source"] for r in got.where("doc_id = 1").collect()} == {"s1"}
