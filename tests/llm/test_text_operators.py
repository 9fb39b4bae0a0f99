"""The text operators against the libraries, brute force, and the edge cases that their docstrings state."""

from __future__ import annotations

import hashlib
import io
import itertools
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import pytest

from quern.llm import bpe, chat, decontaminate, language, media, near, shared, tokenfile, toxicity, urls, warc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, label int, __r int"
EN = "the quick brown fox jumps over the lazy dog and then it runs away from the angry farmer with his long stick"
DE = "der schnelle braune fuchs springt über den faulen hund und läuft dann weg von dem bauern mit dem stock"


def documents(spark, texts, langs=None, ids=None):
    """A table with extra columns whose names clash with the operators' own."""
    ids = ids if ids is not None else list(range(len(texts)))
    langs = langs or ["en"] * len(texts)
    return spark.createDataFrame([(i, t, x, "s", len(t or ""), "x", 1, 2) for i, t, x in zip(ids, texts, langs, strict=True)], DOCS)


def strange_texts():
    r = random.Random(5)
    parts = ["a", "aa", "b", " ", "  ", "\n", "\t", "é", "漢", "😀", "'s", "'", "1", "²", "<|endoftext|>", "<|endo", "\u0301", "\u200d", "!", "Aa", "\x00", "\xa0", "\x1c", "\x85", "ª", "ſ", "ǅ"]
    some = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(400)]
    return ["", " ", "a" * 3000, " " * 999, "ab" * 2000, *some]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


# -- BPE and token files


def test_bpe_is_the_librarys(tokenizer):
    voc, texts = bpe.vocabulary(bpe.default_vocabulary()), strange_texts()
    for ids, said in zip(bpe.Encoder(voc).encode(texts), tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids == said.ids
        assert bpe.decode(ids, voc) == tokenizer.decode(said.ids, skip_special_tokens=False)


def test_bpe_merges_overlapping_pairs_from_the_left():
    assert bpe.not_overlapping(np.arange(5), np.array([False, True, True, False, True])).tolist() == [True, False, True, True, False]


def test_bpe_digests_and_edges(spark, tokenizer):
    rows = {r.doc_id: r for r in bpe.digests(documents(spark, [None, "", EN, EN, "x" * 200_000])).collect()}
    ids = tokenizer.encode(EN, add_special_tokens=False).ids
    assert rows[2].n_tokens == len(ids) and rows[2].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() == rows[3].ids_sha256
    assert rows[0].n_tokens == 0 and rows[0].ids_sha256 == rows[1].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert rows[4].decoded_sha256 == hashlib.sha256(b"x" * 200_000).hexdigest()
    assert bpe.digests(documents(spark, [])).count() == 0


def test_bpe_holds_equal_pieces_once():
    encoder = bpe.Encoder(bpe.vocabulary(bpe.default_vocabulary()), len)
    text = "some longer words " * 50_000
    list(encoder.block([text]))
    tracemalloc.start()
    cut = encoder.block([text] * 4)  # 600,000 pieces
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(map(len, cut)) >= 600_000 and most < 40 * 600_000


def test_bpe_encode_decode_round_trip(spark):
    texts = [EN, DE, "", "<|endoftext|>"]
    back = bpe.decoded(bpe.encoded(documents(spark, texts))).collect()
    assert {r.doc_id: r.text for r in back} == dict(enumerate(texts))


def test_token_files_round_trip(spark, tokenizer, tmp_path):
    texts = [None, EN, DE, "", EN, *strange_texts()[5:60]]
    ids = [7, 3, 3, 9, None, *range(100, 155)]
    manifest = tokenfile.write(documents(spark, texts, ids=ids), f"file://{tmp_path}/out")
    got = tokenfile.read(manifest).collect()
    want = sorted(((i is not None, i or 0, x) for i, x in zip(ids, [[*e.ids, 2] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)], strict=True)), key=lambda x: x[:2])
    assert len(got) == len(want) and sum(r.n_tokens for r in got) == sum(len(x) for *_, x in want)
    crc = sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got)
    assert crc == sorted((a, b, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for a, b, x in want)
    starts = sorted((r.start, r.n_tokens) for r in got)
    assert all(a + n == b for (a, n), (b, _) in itertools.pairwise(starts)) and starts[0][0] == 0
    in_order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert in_order[0] is None and in_order[1:] == sorted(in_order[1:])
    assert tokenfile.read(tokenfile.write(documents(spark, []), f"file://{tmp_path}/none")).count() == 0


def test_token_file_is_plain_zstandard_and_finds_damage():
    import zstandard

    out = io.BytesIO()
    writer = tokenfile.FrameWriter(out, 2)
    step, tokenfile.FRAME_IDS = tokenfile.FRAME_IDS, 4
    try:
        for i, ids in enumerate(([1, 2, 3, 4, 5, 6, 7, 8, 9], [], [10])):
            writer.add(i, np.array(ids, "<u2").tobytes())
    finally:
        tokenfile.FRAME_IDS = step
    writer.close()
    reader = tokenfile.FrameReader(out)
    assert [reader.document(k).tolist() for k in range(3)] == [[1, 2, 3, 4, 5, 6, 7, 8, 9], [], [10]]
    assert reader.held.tolist() == [3, 1, 1] and reader.find(2) == [2] and reader.find(9) == []
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True).read()
    assert np.frombuffer(plain, "<u2").tolist() == [*range(1, 11)]
    bad = bytearray(out.getvalue())
    bad[reader.frames[0].at + reader.frames[0].packed - 1] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        tokenfile.FrameReader(io.BytesIO(bytes(bad))).document(0)
    with pytest.raises(ValueError, match="seek table"):
        tokenfile.FrameReader(io.BytesIO(b"x" * 50))


# -- language


def test_language_by_profiles(spark):
    texts = [EN, DE] * 6 + ["", None, "123 !!", EN[:20]]
    langs = ["en", "de"] * 6 + [None, "en", None, None]
    docs = documents(spark, texts, langs)
    rows = docs.select("doc_id", language.identify(docs, language.learn(docs)).alias("j")).collect()
    got = {r.doc_id: (r.j.lang_pred, r.j.score) for r in rows}
    assert all(got[i][0] == langs[i] for i in range(12)) and got[15][0] == "en"
    assert got[12] == got[13] == got[14] == ("und", 0.0) and all(0 <= s <= 1 for _, s in got.values())
    kept = language.keep_known(docs, language.learn(docs))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {*range(12), 15}
    none = language.learn(documents(spark, []))
    assert language.judged(EN, none) == ("und", 0.0)


def test_language_equals_brute_force(spark):
    """Profiles and distances from dictionaries of strings."""
    r = random.Random(4)
    texts = [" ".join(r.choice((EN if k % 2 else DE).split()) for _ in range(r.randrange(1, 30))) for k in range(60)] + ["é", "x" * 50_000, EN + " " + DE]
    langs = ["en" if k % 2 else "de" for k in range(60)] + [None, "zz", None]

    def grams(text):
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        run = " " + " ".join(words) + " "
        found = [run[i : i + n] for n in (1, 2, 3) for i in range(len(run) - n + 1) if run[i : i + n] != " "] if words else []
        return found

    def code(gram):
        out = 0
        for c in gram:
            out = out << 21 | ord(c)
        return out

    def ranked(counts):
        return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))[: language.RANKS]]

    known = {}
    for t, x in zip(texts, langs, strict=True):
        if x:
            for g in grams(t):
                known.setdefault(x, {}).setdefault(g, 0)
                known[x][g] += 1
    places = {x: {g: i for i, g in enumerate(ranked(c))} for x, c in known.items()}
    docs = documents(spark, texts, langs)
    profiles = language.learn(docs)
    assert profiles.languages == sorted(places)
    for t in texts:
        counts = {}
        for g in grams(t):
            counts[g] = counts.get(g, 0) + 1
        own = ranked(counts)
        apart = [sum(abs(p[g] - i) if g in p else language.RANKS for i, g in enumerate(own)) for _, p in sorted(places.items())]
        best = apart.index(min(apart))
        assert language.judged(t, profiles) == (sorted(places)[best], 1 - apart[best] / (language.RANKS * len(own)))
    twice = language.learn(docs.unionByName(docs))
    assert twice.languages == profiles.languages and (twice.ranks == profiles.ranks).all()


def test_language_counts_do_not_depend_on_the_way():
    code = language.framed("Übel, über; 漢字 " + EN)
    grams, n = language.counted(np.concatenate((code, [language.BETWEEN])))
    one, m = np.unique(language.ngrams(code), return_counts=True)
    order = np.argsort(grams)
    assert grams[order].tolist() == one.tolist() and n[order].tolist() == m.tolist()


def test_held_out_rule(spark):
    rows = documents(spark, [""] * 50).select("doc_id", shared.held_out(language.F.col("doc_id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


# -- toxicity


def test_toxicity_finds_the_sentence(spark):
    r = random.Random(3)
    word = lambda: r.choice(EN.split())
    sentence = lambda *more: " ".join([*[word() for _ in range(6)], *more])
    texts = [". ".join([sentence(), sentence(*(["blorft"] if i % 4 == 0 else [])), sentence()]) for i in range(300)]
    model = toxicity.fit([*texts, None, ""], [int(i % 4 == 0) for i in range(300)] + [0, 0])
    assert all((toxicity.judged(t, model)[0] >= toxicity.CUT) == (i % 4 == 0) for i, t in enumerate(texts))
    (bad,) = toxicity.judged(texts[0], model)[1]
    assert "blorft" in texts[0][bad["start"] : bad["end"]] and "." not in texts[0][bad["start"] : bad["end"]]
    assert toxicity.judged(None, model) == toxicity.judged("", model) and toxicity.judged("", model)[0] < toxicity.CUT
    assert toxicity.fit([], []).noise == 0 and toxicity.judged("x", toxicity.fit(["a"], [1]))[0] >= toxicity.CUT
    docs = documents(spark, [texts[0], texts[1], None])
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {1, 2}


def test_toxicity_learns_from_the_greatest_label_of_an_id(spark):
    labels = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (None, 1), (3, None)], "doc_id bigint, toxic int")
    docs = documents(spark, [EN, DE, EN, EN, DE, EN], ids=[0, 0, 1, 3, 3, None])
    got = [tuple(x) for x in toxicity.sample(docs, labels).collect()]
    assert sorted(got) == sorted((i, n, t) for i, n, t in [(0, 1, min(EN, DE)), (1, 0, EN)] if zlib.crc32(str(i).encode()) % 4 != 2)


def test_toxicity_holds_out_and_bounds_what_it_learns_from(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id bigint, toxic int")
    docs = documents(spark, ["x" * 100] * 200)
    ids = [x.id for x in toxicity.sample(docs, labels).collect()]
    assert sorted(ids) == [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert toxicity.sample(docs, labels, chars=1050).count() == 10 and toxicity.sample(docs, labels, most=7).count() == 7
    assert toxicity.learn(docs.limit(0), labels).noise == 0 and toxicity.learn(docs, labels.limit(0)).weights == {}


def test_toxicity_sample_leaves_out_only_the_texts_that_do_not_fit(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, toxic int")
    for long in (0, 7, 31, 59):
        docs = documents(spark, ["x" * (5000 if i == long else 100) for i in range(60)])
        ids = {x.id for x in toxicity.sample(docs, labels, chars=5000).collect()}
        assert ids == {i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2} - {long}
    model = toxicity.learn(documents(spark, [f"you are awful {i}." if i % 2 else f"a good day {i}." for i in range(59)] + ["long " * 40_000]), labels)
    assert model.weights


def test_toxicity_gradient_is_that_of_finite_differences():
    r = np.random.default_rng(5)
    doc, y = np.sort(r.integers(0, 6, 15)), np.array([1, 0, 0, 1, 0, 1.0])
    sent, word = np.sort(r.integers(0, 15, 40)), r.integers(0, 9, 40)
    theta = np.append(r.normal(0, 0.7, 9), [-1.0, -1.5])
    value, slope = toxicity.loss(theta, y, doc, sent, word)
    for k in range(len(theta)):
        step = np.zeros_like(theta)
        step[k] = 1e-6
        assert abs((toxicity.loss(theta + step, y, doc, sent, word)[0] - toxicity.loss(theta - step, y, doc, sent, word)[0]) / 2e-6 - slope[k]) < 1e-5
    odds = np.ones(6) * (1 - toxicity.sigmoid(theta[-1]))
    for k, d in enumerate(doc):
        odds[d] *= 1 - toxicity.sigmoid(theta[word[sent == k]].sum() + theta[-2])
    assert abs(value - np.mean(np.where(y > 0, -np.log(1 - odds), -np.log(odds)))) < 1e-9


def test_toxicity_score_is_the_noisy_or_of_its_sentences():
    model = toxicity.Model({"bad": 3.0, "worse": 5.0, "wors*": 0.5}, -4.0, 0.02)
    p = lambda x: 1 / (1 + np.exp(-x))
    want = 1 - (1 - 0.02) * (1 - p(-4)) * (1 - p(-1)) * (1 - p(1.5))
    score, found = toxicity.judged("A cat. A bad bad cat! Worse", model)
    assert abs(score - want) < 1e-12 and [(x["start"], x["end"]) for x in found] == [(21, 27)]
    long = "A cat. " * 200_000 + "worse bad"
    assert toxicity.judged(long, model)[1][0]["start"] >= 7 * 200_000 - 1


# -- near duplicates


def test_toxicity_learns_from_as_many_documents_as_are_left(spark, monkeypatch):
    taught = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels: taught.append(len(texts)))
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(400)], "doc_id bigint, quality int, toxic int")
    toxicity.learn(documents(spark, [EN] * 200, ids=list(range(200, 400))), labels, most=60)
    assert taught == [60]


def brute_classes(texts, ids):
    sets, parent = {}, {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, t in zip(ids, texts, strict=True):
        w = re.findall(r"\w+", (t or "").lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    for a, b in itertools.combinations(ids, 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: find(i) for i in ids}


def varied(r, words, n):
    out = list(words)
    for _ in range(n):
        out[r.randrange(len(out))] = f"w{r.randrange(10**6)}"
    return " ".join(out)


def test_near_duplicate_classes_match_brute_force(spark):
    r = random.Random(11)
    base = [[f"v{r.randrange(5000)}" for _ in range(120)] for _ in range(12)]
    texts = [varied(r, b, r.randrange(4)) for b in base for _ in range(9)] + [" ".join(b) for b in base] * 2 + ["", None, "!!", "one two", "One, two"]
    got = {x.id: x["class"] for x in near.classes(documents(spark, texts)).collect()}
    assert got == brute_classes(texts, range(len(texts)))


def test_near_duplicates_keep_one_row_of_each(spark):
    texts = [EN, EN, EN + " end", DE, None, "", EN]
    docs = documents(spark, texts, ids=[5, 2, 9, 4, 7, 8, None])
    kept = near.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((x.doc_id is not None, x.doc_id or 0) for x in kept.collect()) == [(False, 0), (True, 2), (True, 4), (True, 7)]
    assert near.keep_one(documents(spark, [])).count() == 0
    assert near.keep_one(documents(spark, [EN, EN, DE], ids=[1, 1, 3])).count() == 2


def test_large_buckets_keep_their_links(spark):
    r = random.Random(2)
    base = [f"u{r.randrange(9000)}" for _ in range(200)]
    texts = [varied(r, base, 2) for _ in range(60)] + [varied(r, [f"z{i}" for i in range(200)], 1) for _ in range(30)]
    got = {x.id: x["class"] for x in near.classes(documents(spark, texts)).collect()}
    assert got == brute_classes(texts, range(len(texts)))


def chained(r, groups, each):
    """Texts that share one long passage, in groups whose own parts drift step by step: hubs alone lose some links."""
    passage = [f"p{i}" for i in range(150)]
    texts = []
    for _ in range(groups):
        own = [f"o{r.randrange(10**6)}" for _ in range(60)]
        for _ in range(each):
            own[r.randrange(len(own))] = f"d{r.randrange(10**6)}"
            own[r.randrange(len(own))] = f"d{r.randrange(10**6)}"
            texts.append(" ".join(passage + own))
    return texts


def test_texts_that_hubs_leave_apart_are_joined_exactly(spark, monkeypatch):
    monkeypatch.setattr(near, "ROUNDS", 1)
    texts = chained(random.Random(4), 12, 8)
    got = {x.id: x["class"] for x in near.classes(documents(spark, texts)).collect()}
    assert got == brute_classes(texts, range(len(texts)))


def joined(nodes, links):
    parent = dict(nodes)

    def find(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {i: find(i) for i in nodes}


def templates(r, groups, each):
    """Texts that share a passage of four fifths and more and little else; some share their rest, too."""
    texts = []
    for _ in range(groups):
        passage, rest = [f"p{r.randrange(10**6)}" for _ in range(100)], [f"q{r.randrange(10**6)}" for _ in range(40)]
        for _ in range(each):
            own = rest[: r.randrange(30)] if r.random() < 0.3 else [f"o{r.randrange(10**6)}" for _ in range(r.randrange(40))]
            texts.append(" ".join(passage[: r.choice([94, 97, 100])] + own))
    return texts


@pytest.mark.parametrize("rare", [16, 3])
@pytest.mark.parametrize("made", [chained, templates])
def test_the_rest_joins_all_that_any_links_join(spark, rare, made):
    texts = made(random.Random(6), 3, 30)
    words = near.WordHashes()
    with np.errstate(over="ignore"):
        rows = [(i, np.unique((near.shingles(near.word_hashes(t, words)) >> np.uint64(32)).astype(np.uint32).view(np.int32)).tolist()) for i, t in enumerate(texts)]
    sets = spark.createDataFrame(rows, "id bigint, shingles array<int>")
    held = {i: set(s) for i, s in rows}
    links = {(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if len(held[a] & held[b]) >= 0.8 * len(held[a] | held[b])}
    some = joined({i: i for i in held}, random.Random(1).sample(sorted(links), len(links) // 20))
    nodes = spark.createDataFrame(list(some.items()), "node bigint, label bigint")
    pairs = [(x.a, x.b) for x in near.rest_pairs(nodes, sets, rare=rare).collect()]
    assert len(pairs) == len(set(pairs)) and all(a < b and some[a] != some[b] for a, b in pairs)
    assert joined(some, links & set(pairs)) == joined({i: i for i in held}, links)
    assert near.rest_pairs(nodes.limit(0), sets).count() == 0


@pytest.mark.parametrize("kind", ["int", "string", "bigint"])
def test_one_of_each_whatever_the_type_of_ids(spark, kind):
    docs = documents(spark, [EN] * 8 + [DE])
    docs = docs.withColumn("doc_id", docs.doc_id.cast(kind))
    kept = near.keep_one(docs)
    assert kept.schema == docs.schema and sorted(str(x.doc_id) for x in kept.collect()) == ["0", "8"]


def test_no_link_of_the_test_documents_is_lost(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    held: dict = {}
    for x in rows:
        w = re.findall(r"\w+", (x.text or "").lower())
        held[x.doc_id] = {hash(tuple(w[k : k + 5])) for k in range(max(1, len(w) - 4))}
    inverted: dict = {}
    links = set()
    for i in sorted(held):
        met: dict = {}
        for s in held[i]:
            for j in inverted.setdefault(s, []):
                met[j] = met.get(j, 0) + 1
            inverted[s].append(i)
        links |= {(j, i) for j, n in met.items() if n >= 0.8 * (len(held[i]) + len(held[j]) - n)}
    want = joined({i: i for i in held}, links)
    got = {x.id: x["class"] for x in near.classes(spark.createDataFrame(rows)).collect()}
    assert len(links) > 50 and got == want


def test_links_of_texts_with_unequal_repeated_lines(spark):
    """The sets are alike by 0.84, the weighted shingles by far less."""
    r = random.Random(9)
    texts = []
    for k in range(24):
        shared = " ".join(f"s{r.randrange(10**6)}" for _ in range(150))
        for _ in range(2):
            line = " ".join(f"l{r.randrange(10**6)}" for _ in range(10))
            texts.append(shared + f"\n{line}" * (20, 1000)[k % 2])
    got = {x.id: x["class"] for x in near.classes(documents(spark, texts)).collect()}
    want = brute_classes(texts, range(len(texts)))
    assert len(set(want.values())) == 24
    assert got == want


def test_prob_min_hash_estimates_weighted_similarity():
    r = np.random.default_rng(1)
    shingle = r.integers(1, 2**62, 60).astype(np.uint64)
    w1, w2 = r.integers(1, 5, 60).astype(float), r.integers(1, 5, 60).astype(float)
    kept = near.prob_min_hash(np.repeat([0, 1], 60), np.tile(shingle, 2), np.concatenate((w1, w2)), 2, 4096)
    exact = sum(1 / np.maximum(w1 / a, w2 / b).sum() for a, b in zip(w1, w2, strict=True))
    assert abs((kept[0] == kept[1]).mean() - exact) < 0.04


# -- decontamination


def test_leaks_verbatim_and_paraphrased(spark):
    r = random.Random(4)
    words = [f"{a}{b}" for a in ("ba", "ke", "lo", "mi", "nu", "ro") for b in ("dan", "fil", "gor", "hes", "jap", "tux", "vim")]
    text = lambda n: " ".join(r.choice(words) + str(r.randrange(30)) for _ in range(n))
    items = [text(30) for _ in range(12)] + ["", None, "too short", "!!"]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id bigint, text string")
    near_item = items[1].split()
    for k in (4, 11, 19):
        near_item[k] = "other"
    texts = [text(80), f"{text(70)} {items[0]} {text(50)}", f"{text(40)} {' '.join(near_item)} {text(90)}", None, "", text(2000) + " short too", f"{text(500)}, {items[2].upper()}! {items[3]}, too; short"]
    docs = documents(spark, texts)
    got = {(x.doc_id, x.item_id) for x in decontaminate.contamination(docs, bench).collect()}
    assert got == {(1, 0), (2, 1), (6, 2), (6, 3), (6, 14)}
    kept = decontaminate.keep_unseen(docs, bench)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {0, 3, 4, 5}
    empty = bench.limit(0)
    assert decontaminate.contamination(docs, empty).count() == 0 and decontaminate.keep_unseen(docs, empty).count() == 7
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


def plain_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = list(itertools.accumulate(range(len(b) + 1), lambda s, j, row=row, x=x: max(s, row[j], row[j - 1] + (x == b[j - 1])) if j else 0))
    return row[-1]


def brute_leaks(text, index):
    """The items that the checks find around any passage, each cosine from the passage's own words."""
    other = len(index.vocabulary)
    ids = [index.vocabulary.get(w, other) for w in decontaminate.words_of(text)]
    found = set()
    for f in range(0, max(1, len(ids) - decontaminate.STRIDE), decontaminate.STRIDE) if ids else ():
        z = index.basis[ids[f : f + decontaminate.WINDOW]].sum(axis=0)
        cosine = index.passages @ z / max(np.linalg.norm(z), 1e-6)
        for i, (words, answers) in enumerate(zip(index.words, index.answers, strict=True)):
            far = len(words) + len(words) // 4
            here = ids[max(0, f - max(0, far - decontaminate.STRIDE)) : f + max(decontaminate.WINDOW, far)]
            share, held = decontaminate.common_subsequence(words, here) / len(words), sum(w in here for w in words) / len(words)
            answered = sum(t in here for t in answers) >= len(answers) / 2
            moved = share >= decontaminate.REORDERED and (held >= decontaminate.HELD or cosine[index.owner == i].max() >= decontaminate.NEAR)
            if share >= decontaminate.VERBATIM or answered and (share >= decontaminate.PARAPHRASE or moved):
                found.add(index.items[i])
    return found


@pytest.mark.parametrize("times", [1, 1000, 10**7])
def test_leaks_are_those_of_brute_force_at_any_corpus_size(spark, monkeypatch, times):
    """A corpus of `times` as many documents, with the benchmark's words as common as before."""
    r = random.Random(12)
    common = [f"c{k}" for k in range(60)]
    items = [" ".join(r.choice(common) if r.random() < 0.7 else f"r{r.randrange(400)}" for _ in range(n)) for n in (8, 15, 24, 38, 59, 59, 90, 200)]
    filler = lambda n: [r.choice(common) if r.random() < 0.3 else f"x{r.randrange(10**6)}" for _ in range(n)]
    texts = []
    for k in range(64):
        leak = [w if r.random() > k % 8 * 0.08 else f"y{r.randrange(10**6)}" for w in items[k % len(items) - k // 16].split()]
        texts.append(" ".join(filler(r.randrange(300)) + leak + filler(r.randrange(300))))
    docs = documents(spark, texts)
    own = decontaminate.frequencies
    monkeypatch.setattr(decontaminate, "frequencies", lambda *a: tuple(x * times for x in own(*a)))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    with shared.Tables(spark) as tables:
        index = decontaminate.build(docs.select("text"), bench.toPandas(), decontaminate.sampled(docs.select("text")), tables)
    want = [brute_leaks(t, index) for t in texts]
    assert sum(map(len, want)) > 40
    assert [{x["item_id"] for x in found} for found in decontaminate.leaks(texts, index)] == want


def test_latent_space_is_small_and_brings_words_of_one_company_together(spark):
    """Topics of 12 words each: a passage of a topic in other words has a greater cosine than one of another topic."""
    r = random.Random(8)
    topics = [[f"t{k}w{i}" for i in range(12)] for k in range(20)]
    texts = [" ".join(r.choice(topics[k % 20]) for _ in range(32)) for k in range(600)]
    items = [" ".join(r.choice(t[:6]) for _ in range(32)) for t in topics]
    docs = documents(spark, texts)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    index = next(decontaminate.indexes(docs.select("text"), bench))
    assert index.basis.shape[1] <= 64 and len(index.basis) > 240
    other = " ".join(r.choice(topics[3][6:]) for _ in range(32))
    z = decontaminate.projected(np.asarray([index.vocabulary[w.encode()] for w in other.split()]), index.basis)
    cosine = index.passages @ z
    assert set(other.split()).isdisjoint(items[3].split()) and int(index.owner[np.argmax(cosine)]) == 3
    assert cosine.max() > 3 * np.delete(cosine, np.argmax(cosine)).max()


def test_basis_is_the_singular_vectors(spark):
    r = np.random.default_rng(3)
    a = np.zeros((60, 40))
    for row in a:
        row[r.choice(40, 6, False)] = r.random(6)
    a += 3 * np.outer(r.random(60), r.random(40)) + 2 * np.outer(r.random(60) - 0.5, r.random(40) - 0.5)
    rows = spark.createDataFrame([(list(range(40)), x.tolist()) for x in a], "terms array<bigint>, weights array<double>")
    basis = decontaminate.latent_basis(rows, 60, 40, 4)
    _, value, turn = np.linalg.svd(a)
    assert np.allclose(basis.T @ basis, np.eye(4), atol=1e-4)
    assert np.allclose(np.linalg.norm(a @ basis, axis=0), value[:4], rtol=0.02) and abs(turn[0] @ basis[:, 0]) > 0.999


def test_paraphrases_are_found_and_others_are_not(spark):
    """Reordered clauses and replaced words: the share found, and none of the texts without an item."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(r.randint(2, 4)))
    common = [word() for _ in range(60)]
    sentence = lambda n: [r.choice(common) if r.random() < 0.5 else word() for _ in range(n)]
    items = [sentence(36) for _ in range(40)]
    moved = [x[24:] + x[12:24] + x[:12] for x in items]
    replaced = [[w if r.random() > 0.3 else word() for w in x] for x in items]
    texts = [" ".join(sentence(40) + x + sentence(40)) for x in moved + replaced] + [" ".join(sentence(120)) for _ in range(80)]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id bigint, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.contamination(documents(spark, texts), bench).collect()}
    want = {(k, k % 40) for k in range(80)}
    assert got <= want
    # the words that were replaced are the rarest here, so the answer check is as hard as can be
    assert sum(k < 40 for k, _ in got) >= 38 and sum(k >= 40 for k, _ in got) >= 20


def test_a_very_long_text_is_searched_whole(spark):
    r = random.Random(10)
    item = " ".join(f"q{r.randrange(10**6)}" for _ in range(30))
    text = " ".join(f"z{r.randrange(5000)}" for _ in range(300_000))
    docs = documents(spark, [f"{text} {item}", text, f"{item} {text}"])
    bench = spark.createDataFrame([(1, item), (1, item)], "item_id bigint, text string")
    assert {x.doc_id for x in decontaminate.contamination(docs, bench).collect()} == {0, 2}


def test_common_subsequence():
    r = random.Random(6)
    for _ in range(60):
        a, b = ([r.randrange(5) for _ in range(r.randrange(14))] for _ in range(2))
        assert decontaminate.common_subsequence(a, b) == plain_subsequence(a, b)


# -- URL filter


def test_url_rules_match_brute_force(spark):
    r = random.Random(8)
    hosts = ["a.example.com", "example.com", "com", "xexample.com", "EXAMPLE.NET", "b.org", "casino-win.example.net", "a.cheap-pills.org", "POKER.io", "alphabets.io", "", "net"]
    paths = ["/en/7", "/en/", "/en", "/de/8x", "/de/", "/es/1?x=/en/", "#/en/", "", "/en/7?q"]
    made = [f"{p}{h}{t}" for p in ("http://", "://", "") for h in hosts for t in paths] + [None, "", "://", "a://b://c/en/"]
    rows = spark.createDataFrame([(i, u, "x") for i, u in enumerate(made)], "page_id bigint, url string, host string")

    def brute(url):
        host, path = urls.parts(url)
        fit = [(len(h + p), h + p, v) for h, p, v in urls.RULES if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (max(fit)[1], max(fit)[2]) if fit else (None, "block" if set(re.split("[.-]", host)) & set(urls.WARNED) else "allow")

    build = lambda x: urls.build(urls.entries(spark, x), shared.scratch(spark, "t"))
    got = urls.two_lists(rows, build(urls.RULES), urls.build(urls.warned_hosts(rows), shared.scratch(spark, "t"), least_shards=3)).collect()
    assert len(urls.build(urls.warned_hosts(rows.unionByName(rows)), shared.scratch(spark, "t"), least_shards=3).shards) > 1
    assert len(got) == len(made) and all((x.rule, x.verdict) == brute(made[x.page_id]) for x in got)
    assert all((x.host, x.path) == tuple(urls.parts(made[x.page_id])) for x in got)
    many = [(f"h{r.randrange(400)}.net", f"/{r.randrange(9)}", r.choice(["allow", "block"])) for _ in range(900)]
    size, urls.SHARD_ROWS = urls.SHARD_ROWS, 50
    try:
        prober = urls.Prober(build(many))
    finally:
        urls.SHARD_ROWS = size
    assert len(prober.rules.shards) > 4
    said = {(h, p): "allow" for h, p, _ in many} | {(h, p): v for h, p, v in many if v == "block"}
    assert all(prober.judge([f"x://{h}{p}"])[0][3] == v for (h, p), v in said.items())
    assert urls.Prober(build([])._replace(shards=[], firsts=[])).judge(["x://a/b"]) == [("a", "/b", None, "allow")]


def test_url_hits_are_confirmed(monkeypatch, spark):
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda *_: 7)
    shard = urls.shard_bytes(np.array([7, 7], np.uint64), [b"a\n", b"b\n"], np.array([1, 0], np.uint8))
    path = shared.scratch(spark, "shard")[7:]
    with open(path, "wb") as f:
        f.write(shard)
    prober = urls.Prober(urls.Filter([7], [f"file://{path}"], [0], 1, "none"))
    assert [x[3] for x in prober.judge(["x://a", "x://b", "x://c"])] == ["block", "allow", "none"]


# -- chat


def legal(rendered):
    return re.fullmatch("s?(ua)*", "".join(x[0] for x in re.findall(r"<\|(system|user|assistant)\|>\n", rendered))) is not None


def brute_cost(roles):
    """The least cost by dynamic programming over whole sequences, states as the last written role."""
    best = {chat.START: 0}
    for role in roles:
        new = {}
        for s, c in best.items():
            for s0, r, cost, action, _ in chat.MOVES:
                if s0 == s:
                    total = c + cost + (chat.RELABEL * chat.SCALE if r != role else 0) + (0 if action == "keep" and r == role else 1)
                    new[r] = min(new.get(r, chat.NEVER), total)
        best = new
    return min(c + chat.ENDS[s][0] for s, c in best.items())


def cost_of(roles, done):
    c = 0
    for role, (r, action, ins) in zip(roles, done, strict=True):
        c += {"keep": 0, "merge": chat.MERGE * chat.SCALE, "insert": len(ins) * chat.INSERT * chat.SCALE}[action]
        c += (chat.RELABEL * chat.SCALE if r != role else 0) + (0 if action == "keep" and r == role else 1)
    return c + chat.ENDS[done[-1][0]][0]


def test_chat_repair_costs_least_also_over_chunks(spark, monkeypatch):
    r = random.Random(9)
    talks = [[r.choice(["user", "assistant", "system", " User", None, "bot"]) for _ in range(n)] for n in (1, 2, 3, 5, 8, 40, 41) for _ in range(4)]
    rows = [(k, i, role, f"t{i}", "x", 0) for k, talk in enumerate(talks) for i, role in enumerate(talk)]
    rows += [(None, 0, "user", None, "x", 0), (99, None, "assistant", "", "x", 0), (99, 3, "user", "a", "x", 0), (99, 3, "user", "a", "x", 0)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, code string, last int")
    code = {"user": chat.USER, "assistant": chat.ASSISTANT, "system": chat.SYSTEM}
    whole = {x.conv_id: x.rendered for x in chat.rendered(chat.repaired(turns)).collect()}
    assert len(whole) == len(talks) + 2 and all(map(legal, whole.values()))
    monkeypatch.setattr(chat, "CHUNK", 8)
    cut = chat.repaired(turns)
    assert cut.count() == len(rows) and all(map(legal, (x.rendered for x in chat.rendered(cut).collect())))
    for talk in talks:
        roles = [code.get((x or "").strip().lower(), 0) for x in talk]
        begin, end = chat.states_between([chat.chunk_matrix(roles)])
        assert cost_of(roles, chat.choices(roles, begin, end)) == brute_cost(roles)
    actions = {(x.conv_id, x.position): (x.role, x.action) for x in cut.collect()}
    for k, talk in enumerate(talks):
        roles = [code.get((x or "").strip().lower(), 0) for x in talk]
        done = [(code[actions[k, i][0]], {"relabel": "keep"}.get(actions[k, i][1], actions[k, i][1]), ()) for i in range(len(talk))]
        assert sum(a == "merge" for _, a, _ in done) <= len(talk) and len(done) == len(roles)
    assert chat.repaired(turns.limit(0)).count() == 0


def test_chat_keeps_a_legal_talk(spark):
    turns = spark.createDataFrame([(1, 0, "system", "S"), (1, 1, "user", "Q"), (1, 2, "assistant", "A")], "conv_id bigint, turn bigint, role string, text string")
    (row,) = chat.rendered(chat.repaired(turns)).collect()
    assert row.rendered == "<|system|>\nS<|end|>\n<|user|>\nQ<|end|>\n<|assistant|>\nA<|end|>\n"


# -- media


def filtered_png(rows, kinds):
    """A PNG by the standard's own per-byte definitions, with the given filter of each row."""
    out, before = bytearray(), bytes(len(rows[0]))
    for row, kind in zip(rows, kinds, strict=True):
        out.append(kind)
        for x, v in enumerate(row):
            a, b, c = (row[x - 3] if x >= 3 else 0), before[x], (before[x - 3] if x >= 3 else 0)
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out.append((v - [0, a, b, (a + b) // 2, paeth][kind]) % 256)
        before = row
    head = media.struct.pack(">IIBBBBB", len(rows[0]) // 3, len(rows), 8, 2, 0, 0, 0)
    return media.SIGNATURE + media.chunk(b"IHDR", head) + media.chunk(b"tEXt", b"k\0v") + media.chunk(b"IDAT", zlib.compress(bytes(out))) + media.chunk(b"IEND", b"")


def test_png_reads_every_filter_and_finds_faults():
    r = random.Random(1)
    rows = [bytes(r.randrange(256) for _ in range(21)) for _ in range(40)]
    image = filtered_png(rows, [r.randrange(5) for _ in rows])
    assert media.pixels(image).tobytes() == b"".join(rows)
    for at in (3, 20, 60, len(image) - 2):
        bad = bytearray(image)
        bad[at] ^= 4
        with pytest.raises(ValueError):
            media.pixels(bytes(bad))
    with pytest.raises(ValueError, match="cut off|no last"):
        media.pixels(image[:-12])


def test_media_round_trip(spark):
    texts = [None, "", EN, EN, "ü" * 96, "x" * 192, "y" * 700_000]
    rows = {x.doc_id: x for x in media.features(media.stored(documents(spark, texts))).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        assert (rows[i].n_bytes, rows[i].payload_bytes, rows[i].payload_sha256, rows[i].tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert rows[2][1:] == rows[3][1:] and len(rows[2].feature) == 16
    assert media.features(media.stored(documents(spark, []))).count() == 0


def test_decontamination_starts_no_other_python_workers(spark, monkeypatch):
    docs = documents(spark, [EN, "other words altogether"])
    bench = spark.createDataFrame([(1, EN)], "item_id bigint, text string")
    plain = spark.sparkContext.parallelize

    def parallelize(rows, *more):
        assert not len(rows), "rows that Python workers of another kind unpickle"
        return plain(rows, *more)

    monkeypatch.setattr(spark.sparkContext, "parallelize", parallelize)
    assert [x.doc_id for x in decontaminate.keep_unseen(docs, bench).collect()] == [1]


# -- WARC


def test_warc_derivatives_link_to_their_source(spark):
    html = "<html><head><title>T &amp; t</title><script>x='<p>'</script></head><body><!-- no --><p>one  two</p><p>three <a href='/x'>four</a></p></body></html>"
    rows = [(1, "http://a/b", html), (2, None, None), (3, "http://c\r\nX: y", "plain"), (None, "http://d", "<p>d"), (None, "http://e", "<p>d"), (1, "http://a/b", html)]
    pages = spark.createDataFrame([(*x, "r", "t") for x in rows], "page_id bigint, url string, html string, record string, text string")
    source = warc.responses(pages)
    manifest = warc.write(source, shared.scratch(spark, "t"))
    got = warc.read(manifest.where("path is not null")).collect()
    assert len(got) == 12 and sum(x.record_type == "metadata" for x in got) == 6
    assert len({x.record_id for x in got}) == 10 and manifest.agg({"records": "sum"}).first()[0] == 12
    one = [x for x in got if x.page_id == 1 and x.record_type == "conversion"]
    assert one[0] == one[1] and one[0].text == "T & t\none two\nthree four"
    first = next(x.record for x in source.collect() if x.page_id == 1)
    record, end = warc.parse(bytes(first))
    assert end == len(first) and one[0].refers_to == record.get("WARC-Record-ID") and one[0].payload_digest == record.get("WARC-Payload-Digest")
    metadata, conversion, _ = warc.derivatives(bytes(first))
    again, _ = warc.parse(warc.record_bytes(metadata))
    assert again.block == metadata.block and b"source-WARC-Target-URI: http://a/b\r\n" in metadata.block and b"links: 1\r\n" in metadata.block
    assert conversion.get("WARC-Target-URI") == "http://a/b" and all("\n" not in (x.target_uri or "") for x in got)
    bad = spark.createDataFrame([(1, bytes(first).replace(b"one", b"0ne")), (2, None), (3, b"WARC/1.1\r\n\r\n")], "page_id bigint, record binary")
    assert sorted((x.page_id, x.fault is not None, x.record) for x in warc.derive(bad).collect()) == [(i, True, None) for i in (1, 2, 3)]
    said = warc.write(bad, shared.scratch(spark, "t")).collect()
    assert sorted(x.page_id for x in said) == [1, 2, 3] and all(x.path is None and x.fault for x in said)
    assert warc.write(warc.responses(pages.limit(0)), shared.scratch(spark, "t")).count() == 0


def test_warc_text_of_odd_markup_and_its_time():
    cases = {
        "a<p>b<!-- c": ("a\nb<!-- c", 0),
        "a<!-- <p> b>c": ("a b>c", 0),
        "<a\nHREF = x>y</a><a name=href>z": ("yz", 1),
        "x<SCRIPT>1</script >y<style>z": ("x yz", 0),
        "a\x85b\u2028 c\r\n\n d &lt;p&gt;&#10;e": ("a b c\nd <p>\ne", 0),
        "a<my-tag b>c</ d>e<?f>g<h": ("aceg<h", 0),
    }
    for source, want in cases.items():
        assert warc.text_and_links(source) == want, source
    page = "<p>" + "some words of a page, " * 20_000

    def least(work) -> float:
        took = []
        for _ in range(7):
            began = time.process_time()
            work()
            took.append(time.process_time() - began)
        return min(took)

    # blanks were collapsed by such an expression, which alone takes longer than all does now
    assert least(lambda: warc.text_and_links(page)) < 0.8 * least(lambda: re.sub(r"[^\S\n]+", " ", page))


def test_warc_files_are_plain_and_hand_made_ones_are_read(spark, tmp_path):
    import base64
    import gzip

    sha = lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()
    block = b"f: 1\r\n"
    by_hand = b"WARC/1.0\r\nWARC-Type: metadata\r\nwarc-record-id: <urn:x>\r\nContent-Length: 6\r\nWARC-Block-Digest: " + sha(block).encode() + b"\r\nX-Long: a\r\n  b\r\n\r\n" + block + b"\r\n\r\n"
    (tmp_path / "good.warc.gz").write_bytes(gzip.compress(by_hand) + gzip.compress(by_hand.replace(b"metadata", b"warcinfo")))
    (tmp_path / "bad.warc.gz").write_bytes(gzip.compress(by_hand) + gzip.compress(by_hand.replace(b"f: 1", b"f: 2")))
    (tmp_path / "cut.warc.gz").write_bytes(gzip.compress(by_hand)[:-9])
    paths = spark.createDataFrame([(f"file://{tmp_path}/{n}.warc.gz",) for n in ("good", "bad", "cut")], "path string")
    got = sorted(x.record_type for x in warc.read(paths).collect())
    assert got == ["error", "error", "metadata", "metadata", "warcinfo"]
    record, _ = warc.parse(by_hand)
    assert record.get("X-LONG") == "a b" and record.get("WARC-Record-ID") == "<urn:x>"
    pages = spark.createDataFrame([(9, "http://a", "<p>x</p>y")], "page_id bigint, url string, html string")
    (file,) = warc.write(warc.responses(pages), f"file://{tmp_path}/out").collect()
    plain = gzip.decompress(open(file.path[7:], "rb").read())
    assert plain.count(b"WARC/1.1\r\n") == 2 and plain.endswith(b"\r\n\r\nx\ny\r\n\r\n") and sha(b"x\ny").encode() in plain and b"Page-ID: 9\r\n" in plain


def test_hostile_markup_takes_linear_time():
    import time

    for part in ("<script>", "<a ", "<!--", "<", "</script ", "<style></styl", "<a href ", "&", "<p>" + " " * 9, "<template><!--"):
        began = time.perf_counter()
        warc.text_and_links(part * 60_000)
        assert time.perf_counter() - began < 5
    assert warc.text_and_links("a<script>b") == ("ab", 0) and warc.text_and_links("a < b <c") == ("a < b <c", 0)
    assert warc.text_and_links("<a x>1</a><a HREF = 'y'>2</a><a-b href=1><!-- <a href=3> -->") == ("12", 2)


# -- the pipeline


def test_pipeline_matches_its_stages_by_hand(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(7)
    word = lambda lang: r.choice((EN if lang == "en" else DE).split())
    text = lambda lang, n=60: " ".join(word(lang) + r.choice(["", "s", "en", "ing"]) for _ in range(n))
    langs = [r.choice(["en", "de"]) for _ in range(240)]
    texts = [text(x) for x in langs]
    toxic = [i % 6 == 0 for i in range(240)]
    texts = [f"{t}. You blorft fool" if bad else t for t, bad in zip(texts, toxic, strict=True)]
    item = " ".join(f"q{k}zz" for k in range(30))
    texts[1] += " " + item
    texts[3] = texts[2]
    texts[5], texts[7] = "...", None
    documents(spark, texts, langs).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(b)) for i, b in enumerate(toxic)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {x.doc_id: x for x in pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {i for i in range(240) if not toxic[i]} - {1, 3, 5, 7}
    assert got[2].decoded_sha256 == hashlib.sha256(texts[2].encode()).hexdigest()
