"""Operators 1, 2 and 6 against brute force."""

import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from featsieve.llm import dart_minhash as darts, inverted_multi_index as imi, near_sets, paragraph_banding as banding


def shingles(text, n=5):
    words = re.findall(r"\w+", (text or "").lower())
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def classes_of(items, similar):
    label = {i: i for i in items}
    for a in items:
        for b in items:
            if a < b and label[a] != label[b] and similar(a, b):
                low, high = sorted((label[a], label[b]))
                label = {i: low if x == high else x for i, x in label.items()}
    return label


def family(rng, size, words=60, edits=5):
    base = [f"w{rng.integers(5000)}" for _ in range(words)]
    out = []
    for i in range(size):
        own = list(base)
        for j in rng.choice(words, int(rng.integers(0, edits + 1)), replace=False):
            own[j] = f"e{rng.integers(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(5)
    texts = [t for size in (40, 12, 3, 2) for t in family(rng, size)] + [" ".join(f"u{rng.integers(9000)}" for _ in range(50)) for _ in range(20)]
    texts += [texts[0]] * 15 + ["!!!", "!!!", "", "one two"]
    order = rng.permutation(len(texts))
    return {int(i): texts[k] for i, k in enumerate(order)}


def test_classes_match_brute_force(spark, corpus):
    sets = {i: shingles(t) for i, t in corpus.items()}
    alike = lambda a, b: corpus[a] == corpus[b] if not (sets[a] and sets[b]) else len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8
    got = darts.near_duplicates(spark.createDataFrame(list(corpus.items()), "doc_id long, text string").repartition(5))
    assert {r.doc_id: r.class_id for r in got.collect()} == classes_of(sorted(corpus), alike)


def test_blocks_of_a_bucket_lose_no_pair(spark, corpus):
    """Blocks far smaller than the buckets: the square of blocks must see all pairs a whole bucket sees."""
    docs = spark.createDataFrame([(i, t) for i, t in corpus.items() if shingles(t)], "doc_id long, text string")
    banded = darts._sketches(docs, 5, 20, 4).select(F.col("doc_id").alias("id"), "bands")
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    sets_of = lambda ids: darts.shingle_sets(texts.join(ids, "id", "left_semi"))
    one, many = ({r.id: r.label for r in near_sets.similar_classes(banded, sets_of, 0.8, block=b).collect()} for b in (512, 4))
    assert one == many and len(set(one.values())) > 1


def test_agreement_estimates_weighted_similarity():
    rng = np.random.default_rng(2)
    value = rng.integers(0, 2**63, 400).astype(np.uint64)
    a, b = 1 + rng.integers(0, 3, 300).astype(float), 0.5 + 3 * rng.random(300)
    doc = np.repeat([0, 1], 300)
    signature = darts.dart_signatures(doc, np.concatenate([np.sort(value[:300]), np.sort(value[100:])]), np.concatenate([a, b]), 2, 2000)
    weights = [dict(zip(np.sort(value[:300]).tolist(), a)), dict(zip(np.sort(value[100:]).tolist(), b))]
    keys = set(weights[0]) | set(weights[1])
    want = sum(min(w.get(k, 0) for w in weights) for k in keys) / sum(max(w.get(k, 0) for w in weights) for k in keys)
    assert abs((signature[0] == signature[1]).mean() - want) < 4 * (want * (1 - want) / 2000) ** 0.5


@pytest.mark.parametrize("n", [1, 2, 50, 30_000])
def test_all_coordinates_are_filled(n):
    signature = darts.dart_signatures(np.zeros(n, int), near_sets.mixed(np.arange(n, dtype=np.uint64)), np.ones(n), 1, 80)
    assert (signature != 0).all()


def test_near_duplicates_of_odd_rows(odd, empty):
    got = {r.doc_id: r.class_id for r in darts.near_duplicates(odd).collect()}
    assert got[7] == got[1] == 1 and got[None] is None and got[2] == got[3] == 2 and got[5] == 5 and got[4] == 4
    assert darts.near_duplicates(odd).count() == 12 and darts.near_duplicates(empty).count() == 0


def test_texts_of_one_id_are_judged_each(spark):
    rng = np.random.default_rng(32)
    one, two, three = ([f"{x}{rng.integers(10**6)}" for _ in range(80)] for x in "abc")
    docs = [(1, one), (1, two), (2, [*one, "more"]), (3, [*two, "more"]), (4, three), (5, [*two, "other"]), (5, three)]
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.class_id) for r in darts.near_duplicates(docs).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (5, 1), (5, 4)]
    left = corpus_pipeline.near_dedup(spark, docs, None).collect()
    assert sorted((r.doc_id, r.text[0]) for r in left) == [(1, "a"), (1, "b"), (4, "c")]


def test_doubled_texts_are_found(spark):
    """Plain similarity 0.8 and more, though counts differ by a factor of eight."""
    rng = np.random.default_rng(31)
    texts = [" ".join(f"d{rng.integers(10**6)}" for _ in range(200)) for _ in range(12)]
    docs = [(2 * i + j, " ".join([t] * (8 if j else 1))) for i, t in enumerate(texts) for j in (0, 1)]
    got = darts.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    assert {r.doc_id: r.class_id for r in got.collect()} == {d: d - d % 2 for d, _ in docs}


def test_components_of_long_chains(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 105), (105, 101)]
    got = {r.id: r.label for r in near_sets.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 105: 100}


def rows_stored(monkeypatch):
    """(name, rows) of what near_sets stores from now on."""
    kept, plain = [], near_sets.stored

    def counted(df, name):
        out = plain(df, name)
        kept.append((name, out.count()))
        return out

    monkeypatch.setattr(near_sets, "stored", counted)
    return kept


def test_rounds_of_components_take_only_links_left_to_join(spark, monkeypatch):
    """Chains up and down, a star, a clique, random links: later rounds carry few links, whatever the order of ids."""
    rng = np.random.default_rng(41)
    links = [(i, i + 1) for i in range(1500)] + [(-i, -i - 1) for i in range(2000, 3500)] + [(10**6, 10**5 + i) for i in range(500)]
    links += [(2 * 10**6 + i, 2 * 10**6 + j) for i in range(30) for j in range(30)] + [(-(2**63), 2**63 - 1), (7777777, 7777777)]
    links += [tuple(x) for x in (3 * 10**6 + rng.integers(0, 900, (600, 2))).tolist()]
    label = {i: i for link in links for i in link}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in links:
        low, high = sorted((root(a), root(b)))
        label[high] = low
    kept = rows_stored(monkeypatch)
    got = {r.id: r.label for r in near_sets.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: root(i) for i in label}
    edges = [n for name, n in kept if name == "edges"]
    assert sum(edges) < len(links) and all(2 * b < a for a, b in zip([len(links), *edges], edges))


def test_open_buckets_join_labels_not_links(spark, monkeypatch):
    """Members that no centre reaches: the second pass sees only pairs of classes, and classes are those of all pairs."""
    sets = {i: frozenset(range(3 * i, 3 * i + 60)) for i in range(40)}  # neighbours have 57 of 63 in common, the next ones 54 of 66
    sets |= {100 + i: frozenset(range(1000 + 200 * i, 1060 + 200 * i)) for i in range(5)}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8
    want = {i: label for i, label in classes_of(sorted(sets), alike).items() if i < 100}
    seen, plain = [], near_sets.components

    def recorded(links):
        out = plain(links)
        seen.append(([tuple(x) for x in links.collect()], {r.id: r.label for r in out.collect()}))
        return out

    monkeypatch.setattr(near_sets, "components", recorded)
    banded = spark.createDataFrame([(i, [5, 6]) for i in sets], "id long, bands array<long>")
    items = spark.createDataFrame([(i, sorted(x)) for i, x in sets.items()], "id long, items array<long>")
    for block in (512, 4):
        seen.clear()
        got = {r.id: r.label for r in near_sets.similar_classes(banded, lambda ids: items.join(ids, "id", "left_semi"), 0.8, block=block).collect()}
        assert got == want and len(set(want.values())) == 1
        (_, first), (second, _) = seen
        assert second and all(first.get(i, i) == i for link in second for i in link)


# --- operator 2

@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(1500)]
    rows += [(i, rows[7][1]) for i in range(1500, 1700)]  # a hot vector
    odd = [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [1.0] * 15 + [None]), (2080, [1.0] * 3), (None, rows[0][1]), (0, rows[0][1])]
    return rows, spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumnRenamed("embedding", "embedding").selectExpr("*", "1 as score", "2 as rank").repartition(4)


def brute(rows, k=20):
    ids, x = np.asarray([i for i, _ in rows]), np.asarray([v for _, v in rows], np.float32).astype(float)
    out = {}
    for q in ids[ids % 20 == 0].tolist():
        s = (x * x[ids == q][0]).sum(axis=1)
        s[ids == q] = -np.inf
        order = np.lexsort((ids, -s))[: min(k, len(ids) - 1)]
        out[q] = list(zip(ids[order].tolist(), s[order].tolist()))
    return out


def test_recall_and_scores(vectors, monkeypatch):
    rows, df = vectors
    monkeypatch.setattr(imi, "SHARD_ROWS", 150)  # the hot cell is split
    monkeypatch.setattr(imi, "BLOCK_QUERIES", 20)
    want, got = brute(rows), defaultdict(list)
    for r in imi.nearest_neighbours(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(want)
    hits = 0
    for q, own in got.items():
        assert [r for r, _, _ in own] == list(range(1, 21)) and q not in [i for _, i, _ in own]
        scores = dict(want[q])
        assert all(abs(scores[i] - s) < 1e-12 for _, i, s in own if i in scores)
        assert own == sorted(own, key=lambda x: (-x[2], x[1]))
        hits += len(set(scores) & {i for _, i, _ in own})
    assert hits / (20 * len(got)) >= 0.9


def test_few_rows_give_all_candidates(spark, vectors):
    rows = vectors[0][:8]
    got = imi.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == brute(rows)[0]


def test_no_vectors(vectors):
    assert imi.nearest_neighbours(vectors[1].limit(0)).count() == 0
    assert imi.nearest_neighbours(vectors[1].filter("vec_id >= 2000")).count() in (0, 1, 2)


def test_walk_gives_all_cells_in_order():
    rng = np.random.default_rng(0)
    index = imi.Index(rng.normal(size=(7, 3)), rng.normal(size=(5, 3)), rng.integers(0, 2, 35))
    q = rng.normal(size=6)
    score = (index.left @ q[:3])[:, None] + (index.right @ q[3:])[None, :]
    assert list(index.walk(q)) == [c for c in np.argsort(-score.ravel(), kind="stable").tolist() if index.counts[c]]


# --- operator 6

def test_bands_meet_the_recall():
    for threshold, recall in ((0.8, 0.997), (0.5, 0.9)):
        n = banding.tuned_bands(threshold, recall)
        assert 1 - (1 - threshold**2) ** n >= recall > 1 - (1 - threshold**2) ** (n - 1)


def test_paragraphs_cover_the_text_and_do_not_depend_on_what_stands_before():
    rng = np.random.default_rng(1)
    text = ". ".join(" ".join(f"w{rng.integers(999)}" for _ in range(9)) for _ in range(60)) + "\nshort line\n" + "x" * 5000
    spans = banding.paragraphs(text)
    assert all(a < b for a, b in spans if b - a) and [s for s, _ in spans] == sorted(s for s, _ in spans)
    covered = "".join(text[a:b] for a, b in spans)
    assert covered.replace("\n", "") == text.replace("\n", "")
    own = {text[a:b] for a, b in spans}
    moved = {("Some other start here. " + text)[a:b] for a, b in banding.paragraphs("Some other start here. " + text)}
    assert len(own & moved) >= len(own) - 2


def test_kinds_of_characters_are_those_of_each_character():
    rng = np.random.default_rng(2)
    some = "abcXYZ09_ \n\t\x00-.!?\"')]\u2019\u201d\u00bb\u3002\uff01\u0964\u6f22\u0e17\u30a2\u00e9\u0130\u00df\ud800\U0001f600\U0010ffff"
    for text in ["".join(rng.choice(list(some), 500)), "plain words. and more?", "\n", some, ""]:
        lower, word, alone, space, stops, closing, full_stops = banding._characters(text)
        assert lower.tolist() == [ord(c.lower()[0]) for c in text] and lower.dtype == np.uint64
        assert word.tolist() == [c.isalnum() or c == "_" for c in text] and space.tolist() == [c.isspace() for c in text]
        assert alone.tolist() == [c in "\u6f22\u0e17\u30a2" for c in text] and stops.tolist() == [c in ".!?" for c in text]
        assert closing.tolist() == [c in "\"')]\u2019\u201d\u00bb" for c in text] and full_stops.tolist() == [c in "\u3002\uff01\uff0e\uff1f\u0964" for c in text]


def test_repeats_are_found_and_clean_documents_left(spark):
    rng = np.random.default_rng(9)
    sentence = lambda n=12: " ".join(f"v{rng.integers(20000)}" for _ in range(n)) + "."
    passage = " ".join(sentence() for _ in range(6))
    words = passage.split()
    words[20] = "changed"
    docs = [(i, " ".join(sentence() for _ in range(20)) + "\n" + " ".join(sentence() for _ in range(4))) for i in range(30)]
    docs += [(100 + i, " ".join(sentence() for _ in range(5)) + "\n" + passage + "\n" + sentence()) for i in range(5)]
    docs += [(200, " ".join(sentence() for _ in range(9)) + " " + passage + " " + " ".join(sentence() for _ in range(9))), (201, sentence() + "\n" + " ".join(words))]
    got = banding.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).toPandas()
    assert set(got.doc_id) == {100, 101, 102, 103, 104, 200, 201}
    assert (got[got.keep].groupby("class_id").size() == 1).all() and set(got[got.keep].doc_id) == {100}
    text = dict(docs)
    for r in got.itertuples():
        if r.doc_id < 201:
            assert text[r.doc_id][r.start : r.end].strip() in passage


def test_passages_of_odd_rows(odd, empty):
    got = banding.repeated_passages(odd).toPandas()
    assert set(got.doc_id) == {10, 11} and got.keep.sum() * 2 == len(got)
    assert banding.repeated_passages(empty).count() == 0


def planted_words(spark, rng, passage, around, joint):
    """Least number of matched words of a passage planted in two documents between other text of its kind."""
    docs, places = [], {}
    for i in range(0, 2 * len(passage), 2):
        for d in (i, i + 1):
            left, right = around(rng), around(rng)
            docs.append((d, left + joint + passage[i // 2] + joint + right))
            places[d] = (len(left), len(left + joint + passage[i // 2]))
    got = banding.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).toPandas()
    matched = dict.fromkeys(places, 0)
    for r in got.itertuples():
        assert places[r.doc_id][0] - 40 <= r.start and r.end <= places[r.doc_id][1] + 40
        matched[r.doc_id] += r.n_words
    return np.asarray(list(matched.values()))


def made(rng, n, longest, end, vocabulary=20000):
    """``n`` words in sentences or lines of 1 to ``longest`` words."""
    out = []
    while n > 0:
        k = min(n, int(rng.integers(1, longest + 1)))
        out.append(" ".join(f"z{rng.integers(vocabulary)}" for _ in range(k)) + end)
        n -= k
    return out


def test_passages_of_short_sentences_on_one_line_are_found(spark):
    rng = np.random.default_rng(21)
    text = lambda n: " ".join(made(rng, n, 7, "."))
    matched = planted_words(spark, rng, [text(n) for n in list(range(51, 81)) * 2], lambda r: text(60), " ")
    assert (matched >= 25).all()


def test_passages_without_sentence_ends_are_found(spark):
    rng = np.random.default_rng(22)
    text = lambda n, by=" ": by.join(made(rng, n, 1, ""))
    assert (planted_words(spark, rng, [text(n) for n in list(range(51, 81)) * 2], lambda r: text(40), " ") >= 25).all()
    assert (planted_words(spark, rng, [text(n, "|") for n in range(51, 81)], lambda r: text(90, "|"), "|") >= 25).all()
    letters = lambda n: "".join(chr(0x4E00 + int(rng.integers(3000))) for _ in range(n))
    assert (planted_words(spark, rng, [letters(n) for n in range(51, 81)], lambda r: letters(100), "") >= 25).all()
    code = lambda n: "".join("0123456789abcdef"[int(rng.integers(16))] for _ in range(n))
    assert (planted_words(spark, rng, [code(900)] * 3, lambda r: code(500), "") >= 25).all()


def test_passages_of_short_lines_are_found(spark):
    rng = np.random.default_rng(23)
    text = lambda n: "\n".join(made(rng, n, 4, ""))
    assert (planted_words(spark, rng, [text(n) for n in list(range(51, 81)) * 2], lambda r: text(40), "\n") >= 25).all()


def test_paragraphs_of_eight_words_are_matched_nearly(spark):
    rng = np.random.default_rng(24)
    lines = [[f"y{rng.integers(20000)}" for _ in range(n)] for n in (8, 9, 10, 11)]
    docs = [(i, "\n".join(" ".join(x + [f"e{i}"]) for x in lines)) for i in range(3)] + [(3, "\n".join(map(" ".join, lines)))]
    want = {n for n in (8, 9, 10, 11) if (n - 4) / (n - 3) >= 0.8}  # one word more than in document 3
    got = banding.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string"), min_passage=1).toPandas()
    assert want == {8, 9, 10, 11} and set(got[got.doc_id == 3].n_words) == want


def test_an_edited_sentence_does_not_part_a_passage(spark):
    rng = np.random.default_rng(25)
    parts = [" ".join(f"x{rng.integers(20000)}abc" for _ in range(14)) + "." for _ in range(3)]
    docs = [(1, " ".join(parts)), (2, " ".join([parts[0], " ".join(f"q{i}abcdef" for i in range(14)) + ".", parts[2]]))]
    got = banding.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).toPandas()
    assert sorted(got.n_words) == [14] * 4 and set(got.passage_words) == {28}
