"""Operators on documents against brute force, and on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from realcurve.llm import fingerprints, jaccard_join, mixing, packing, ppm, rans, tokens, toxicity

SPACE = r"[\x20\x09-\x0D]+"


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def split(text):
    return [w for w in re.split(SPACE, text or "") if w]


def lower(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def shingles(text, n):
    w = split(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def held_out(doc_id, n):
    return zlib.crc32((b"" if doc_id is None else str(doc_id).encode())) % n == 1


def ids_by_library(name, texts):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# fingerprints


def check_fingerprints(docs):
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in fingerprints.edited_pairs(docs).collect())
    want = Counter()
    for i, (doc_id, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        cut = len(text) // 3
        want[doc_id, len(text), hashlib.sha256((text[: len(text) - cut] + after[:cut]).encode()).hexdigest()] += 1
    assert got == want


def test_fingerprints_follow_each_other(spark, sf_dir, odd_docs, no_docs):
    check_fingerprints(documents(spark, sf_dir))
    check_fingerprints(odd_docs)
    check_fingerprints(odd_docs.where("doc_id = 5"))
    assert fingerprints.edited_pairs(no_docs).count() == 0


def test_fingerprint_likeness_is_near_jaccard(spark):
    base = [f"word{i}" for i in range(800)]
    rows = [(k, " ".join(base[k * 20 :] + [f"other{i}" for i in range(k * 20)])) for k in range(20)] + [(99, " ".join(base)), (100, None), (101, "")]
    df = fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    by = {r.doc_id: r for r in df.collect()}
    assert by[0].fingerprint == by[99].fingerprint and by[100].fingerprint == by[101].fingerprint == ""
    pairs = df.selectExpr("doc_id", "fingerprint a").crossJoin(df.where("doc_id = 0").selectExpr("fingerprint b"))
    from pyspark.sql import functions as F

    near = fingerprints.likeness(fingerprints.unpacked(F.col("a")), fingerprints.unpacked(F.col("b")))
    for r in pairs.withColumn("near", near).collect():
        a, b = shingles(dict(rows)[r.doc_id], 5), shingles(rows[0][1], 5)
        assert abs(r.near - len(a & b) / len(a | b)) < 0.13


# scores by partial matching


def brute_ppm(train, texts, order=ppm.ORDER):
    counts = defaultdict(Counter)
    stream = lambda t: b"\xff" * order + (t or "").encode().lower() + b"\xff"
    for t in train:
        s = stream(t)
        for i in range(order, len(s)):
            for o in range(order + 1):
                counts[s[i - o : i]][s[i]] += 1
    out = []
    for t in texts:
        s, total = stream(t), 0.0
        for i in range(order, len(s)):
            out_of = set()
            for o in range(order, -1, -1):
                c = counts.get(s[i - o : i], Counter())
                n, q = sum(v for y, v in c.items() if y not in out_of), sum(y not in out_of for y in c)
                if n:
                    if s[i] in c and s[i] not in out_of:
                        total += math.log10((2 * c[s[i]] - 1) / (2 * n))
                        break
                    total += math.log10(q / (2 * n))
                out_of |= set(c)
            else:
                total -= math.log10(256 - len(counts[b""]))
        out.append(total)
    return out


def test_ppm_equals_brute_force(spark, sf_dir, land):
    docs = documents(spark, sf_dir).where("doc_id < 60").withColumn("trained", toxicity.fold(F.col("doc_id"), 5) != 1)
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()))
    train = [t for k, t in rows if not held_out(k, 5)]
    words = Counter(w for t in train for w in [*split(lower(t)), None])
    n, v = sum(words.values()), len(words)
    want = brute_ppm(train, [t for _, t in rows])
    got = {r.doc_id: r for r in ppm.score(docs, land).collect()}
    for (k, t), score in zip(rows, want):
        own = [*split(lower(t)), None]
        assert (got[k].n_tokens, got[k].n_known, got[k].train_tokens) == (len(own), sum(w in words for w in own), n)
        assert got[k].base_score == pytest.approx(sum(math.log10((words[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own))
        assert got[k].score == pytest.approx(score, rel=1e-6)


def test_ppm_probabilities_add_up_and_windows_do_not_matter(monkeypatch):
    texts = [b"abracadabra", b"", b"banana band"]
    pairs = np.concatenate([p for p, _ in ppm.windows(texts)])
    monkeypatch.setattr(ppm, "WINDOW", 7)
    assert np.array_equal(pairs, np.concatenate([p for p, _ in ppm.windows(texts)]))
    keys, n = ppm.merged([pairs], [np.ones(len(pairs), np.int64)])
    two = np.zeros(1 << 16, np.int64)
    np.add.at(two, (keys & np.uint64(0xFFFF)).astype(int), n)
    for context in (b"dabra", b"xxana", b"zzzzz"):
        asked = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)], np.uint64)
        p = 10 ** ppm.log_probabilities(asked, keys, n, two.reshape(256, 256))
        assert p.sum() == pytest.approx(1) and (p > 0).all()


def test_ppm_odd_rows(odd_docs, no_docs, land):
    from pyspark.sql import functions as F

    got = ppm.score(odd_docs.withColumn("trained", F.col("doc_id") > 3), land).collect()
    assert len(got) == 11 and all(r.score < 0 for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (2, 3, 4)} == {1}
    untrained = ppm.score(odd_docs.withColumn("trained", F.lit(None).cast("boolean")), land).collect()
    assert {r.train_tokens for r in untrained} == {0}
    assert next(r.score for r in untrained if r.doc_id == 8) == pytest.approx(-8 * math.log10(256))
    assert ppm.score(no_docs.withColumn("trained", F.lit(True)), land).count() == 0


# mixing


def test_mixing_targets_and_pieces(spark, sf_dir, odd_docs, no_docs, land):
    for docs in (documents(spark, sf_dir), odd_docs):
        placed, pieces = (f.collect() for f in mixing.mix(docs, land, block=64))
        assert Counter(r.doc_id for r in placed) == Counter(r.doc_id for r in docs.collect())
        size = {(r.k, r.start): r.size for r in placed if r["size"]}
        took = Counter()
        for p in pieces:
            assert 0 <= p.from_word and p.from_word + p.n_words <= size[p.k, p.start] and 0 < p.n_words <= 64
            took[p.k, p.start] += p.n_words
        assert all(n <= 2 * size[k] for k, n in took.items())
        by_source = Counter()
        for (k, _), n in took.items():
            by_source[k] += n
        for k, target in {(r.k, r.target) for r in placed}:
            assert abs(by_source[k] - target) <= 1
        assert len({(p.slot, p.k) for p in pieces}) == len({p.slot for p in pieces})
    assert mixing.taken(no_docs, land).count() == 0


def test_mixing_schedule_is_even_in_every_prefix(spark):
    quotas = spark.createDataFrame([(1, 0, 1 << 30, 500), (2, 1 << 30, 3 << 29, 250), (3, 3 << 29, 1 << 31, 250)], "k long, low long, high long, blocks long")
    slots = sorted((r.slot, r.k, r["rank"]) for r in mixing.schedule(spark, quotas, 1000).collect())
    assert Counter(k for _, k, _ in slots) == {1: 500, 2: 250, 3: 250}
    for n in (10, 50, 200, 777):
        seen = Counter(k for _, k, _ in slots[:n])
        assert abs(seen[1] - n / 2) <= 3 and abs(seen[2] - n / 4) <= 3
    for k in (1, 2, 3):
        assert sorted(r for _, q, r in slots if q == k) == list(range(Counter(q for _, q, _ in slots)[k]))


def test_mixing_reruns_agree(odd_docs, land):
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(mixing.taken(odd_docs, land)) == rows(mixing.taken(odd_docs.repartition(3), land))


# token files


def test_parts_give_the_ids_of_whole_texts():
    rng = np.random.default_rng(3)
    bits = ["a", "B", " ", "  ", "\n", "\t", " \n", "é", "Ü", "1", "23", ".", ",", "'s", "　", "<|endoftext|>", "😀", "́", "İ", "Σ", "word", "\x1c", "\xa0", "don't"]
    texts = ["".join(rng.choice(bits, rng.integers(0, 12))) for _ in range(3000)] + [None]
    for name, spaced in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        own = tokens.Encoder(public_tokenizers.path(name), spaced)
        own.MOST_PARTS = 50
        want = [np.array(i, "<u4").tobytes() for i in ids_by_library(name, texts)]
        assert own.encode(texts) == want and own.encode(texts) == want


def test_new_words_go_to_the_library_together():
    words = [a + b + c + d for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh" for d in "aéüc"]
    for name, spaced in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        own, asked = tokens.Encoder(public_tokenizers.path(name), spaced), []
        library = own.library
        own.library = type("Counted", (), {"encode_batch_fast": staticmethod(lambda texts, **more: asked.extend(texts) or library.encode_batch_fast(texts, **more))})
        for text, most in (("x " + " ".join(words), 50), ("x " + " ".join(w + "$$$" for w in words), 3), ("x " + " ".join(w + "," for w in words), 3)):
            del asked[:]
            got = own.encode([text])  # a run of signs after a known word asks for the signs alone
            assert len(asked) <= most
            assert got == [np.array(i, "<u4").tobytes() for i in ids_by_library(name, [text])]


def test_latin_words_go_to_the_model_alone():
    rng = np.random.default_rng(5)
    letters = [chr(c) for c in range(0x250) if chr(c).isalpha() and c != 0x130]
    words = ["".join(rng.choice(letters, rng.integers(1, 9))) for _ in range(2000)]
    texts = ["x " + " ".join(w + "\nx"[: 2 * (i % 7 == 0)] for i, w in enumerate(words)), "x a.\n" + ".\n".join(words[:300]) + " b", "x " + " ".join(w + ".\nOther" for w in words)]
    breaks = ["\n", "a\n", "\na", "a\n\nb", "a\n\n\nb", "a \nb", "a\n b", "a\t\nb", "a\n\tb", "a\n\x0bb", "a\n\x85b", "a\n\xa0b", "a\n'sb", "a\n12. b", "a\n_b", "a.\n.b", "a\n\u0130b", "a\n_b_ c", "a\n\nb c \nd", "a\n\nb \nword", "a \n\nb", " \nword", "\n\nword \nx"]
    for name, spaced in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        own, asked = tokens.Encoder(public_tokenizers.path(name), spaced), []
        library = own.library
        own.library = type("Counted", (), {"encode_batch_fast": staticmethod(lambda texts, **more: asked.extend(texts) or library.encode_batch_fast(texts, **more))})
        got = own.encode(texts)
        assert sum(map(len, asked)) < 100  # first words and signs
        assert got + own.encode(breaks) == [np.array(i, "<u4").tobytes() for i in ids_by_library(name, texts + breaks)]


def test_projection_is_the_mean_of_signs():
    size = 49_408
    lanes = (packing.signs(size)[:, None] >> np.arange(0, 16 * packing.DIMS, 16, dtype=np.uint64)) & np.uint64(0xFFFF)
    assert set(np.unique(lanes)) == {0, 1}
    plain = lanes.astype(np.float64) * 2 - 1
    for n in (1, 7, 65_535, 65_536, 150_000):
        ids = np.random.default_rng(n).integers(0, size, n)
        assert np.array_equal(packing.projection(ids, size), plain[ids].mean(axis=0))
    most = np.full(200_000, int(np.flatnonzero((lanes == 1).all(axis=1))[0]))  # no lane runs over
    assert packing.projection(most, size).tolist() == [1.0] * packing.DIMS


def test_rans_blocks_round_trip_and_notice_damage():
    rng = np.random.default_rng(5)
    ids = np.concatenate([rng.zipf(1.3, 200_000) % 50_000, np.full(5000, 7), rng.integers(0, 50_257, 70_000)]).astype(np.uint32)
    edges = np.array([0, 1, 65, 70_000, 70_001, 200_100, len(ids)])
    freq = rans.scaled(np.bincount(ids))
    assert freq.sum() == 1 << rans.SCALE and np.array_equal(rans.unpack_table(rans.pack_table(freq)), freq)
    blocks = rans.encode_blocks(ids, edges, freq)
    assert np.array_equal(np.concatenate(rans.decode_blocks(blocks, freq)), ids)
    assert np.array_equal(rans.decode_blocks(blocks[3:4], freq)[0], ids[70_000:70_001])
    p = np.bincount(ids) / len(ids)
    assert 8 * sum(map(len, blocks)) < 1.05 * -(p[p > 0] * np.log2(p[p > 0])).sum() * len(ids) + 8 * 64 * 8 * 40
    bad = bytearray(blocks[2])
    bad[-5] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        rans.decode_blocks([bytes(bad)], freq)


def test_rans_files_give_back_every_document(spark, sf_dir, odd_docs, no_docs, land):
    for docs in (documents(spark, sf_dir), odd_docs):
        rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        at, want = 0, []
        for (doc_id, _), ids in zip(rows, ids_by_library("byte_bpe_50k.json", [t for _, t in rows])):
            ids.append(0)
            want.append((doc_id, at, len(ids), crc(ids)))
            at += len(ids)
        assert sorted(map(repr, map(tuple, rans.round_trip(docs, land).collect()))) == sorted(map(repr, want))
    assert rans.round_trip(no_docs, land).count() == 0


# near-duplicates


def brute_components(rows, n, like):
    sets = [(k, shingles(lower(t), n)) for k, t in rows]
    parent = {k: k for k, _ in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and a is not None and b is not None and 100 * len(x & y) >= like * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q) if p != q else p
    return Counter((k, len(x), root(k) if k is not None else None) for k, x in sets)


@pytest.mark.parametrize("n, like", [(4, 85), (5, 80), (2, 95)])
def test_jaccard_join_equals_all_pairs(spark, land, odd_docs, n, like, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)  # so that groups are cut into several tiles
    rng = np.random.default_rng(n)
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    passage = [f"p{i}" for i in range(60)]
    for g in range(14):
        size = int(rng.integers(3, 160))
        base = [f"g{g}w{i}" for i in range(size)]
        for _ in range(6):
            w = list(base)
            for _ in range(int(rng.integers(0, 1 + size // 12))):
                w[int(rng.integers(0, size))] = f"edit{rng.integers(0, 10**6)}"
            rows.append((100 + len(rows), " ".join(w)))
        rows.append((100 + len(rows), " ".join(passage + base[: int(rng.integers(1, 12))])))
        rows.append((100 + len(rows), " ".join(base[: 1 + size * 9 // 10])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(map(tuple, jaccard_join.join(docs, land, n, like).collect()))
    assert got == brute_components(rows, n, like)


def test_jaccard_join_empty(no_docs, land):
    assert jaccard_join.join(no_docs, land).count() == 0


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(2)
    for like in (80, 85, 95):
        for _ in range(400):
            size = int(rng.integers(1, 120))
            a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
            b = a[rng.random(len(a)) > rng.random() * 0.2]
            b = np.unique(np.concatenate((b, rng.integers(0, 1 << 63, rng.integers(0, 1 + size // 8)).astype(np.uint64))))
            if len(b) and jaccard_join.linked(a, b, like) and not np.array_equal(a, b):
                (x, x_spare), (y, y_spare) = jaccard_join.signature_keys(a, like), jaccard_join.signature_keys(b, like)
                _, at, to = np.intersect1d(x, y, return_indices=True)
                # in some band both can leave out what they spare and share a key still
                assert any((np.minimum(x_spare[at], y_spare[to])[x_spare[at] & 1 == f] >> 1 < (x_spare[at] & 1 == f).sum()).all()
                           and (x_spare[at] & 1 == f).any() for f in (0, 1))


# toxicity


def test_toxicity_on_held_out_rows(spark, land):
    rng = np.random.default_rng(8)
    vocab, bad = [f"wo{i}rd" for i in range(300)], ["zxcurse", "qvinsult", "mdslur"]
    rows, marks = [], []
    for k in range(600):
        w = list(rng.choice(vocab, rng.integers(8, 60)))
        toxic = k % 5 == 0
        if toxic:
            for _ in range(3):
                w[int(rng.integers(0, len(w)))] = str(rng.choice(bad)) + str(rng.choice(["", "s", "ed"]))
        rows.append((k, " ".join(w)))
        marks.append((k, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.train(toxicity.labelled(docs, labels, land))
    got = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    held = [k for k, _ in marks if held_out(k, 3)]
    assert len(held) > 150
    assert sum(got[k].predicted == dict(marks)[k] for k in held) >= 0.98 * len(held)


def test_toxicity_odd_rows(spark, odd_docs, no_docs):
    one_class = spark.createDataFrame([("some text", 1), (None, 1), ("x", None)], "text string, toxic int")
    model = toxicity.train(one_class)
    got = toxicity.scored(odd_docs, model)
    assert got.columns.count("score") == 1 and all(0.5 < r.score < 1 for r in got.collect())
    both = toxicity.train(spark.createDataFrame([("bad bad", 1), ("good", 0), (None, 0), ("", 1)], "text string, toxic int"))
    assert all(0 <= r.score <= 1 for r in toxicity.scored(odd_docs, both).collect())
    assert toxicity.scored(no_docs, both).count() == 0
    assert toxicity.train(one_class.where("1 = 0")).bias == 0.0


def test_toxicity_draws_different_texts(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "FIT_ROWS", 5)
    rows = spark.createDataFrame([(f"text {i}", 1) for i in range(40)], "text string, toxic int")
    low = sorted((r.h, r.text) for r in rows.selectExpr("text", "xxhash64(text) h").collect())[:5]
    copied = rows.union(spark.createDataFrame([(low[0][1], 1)] * 50, "text string, toxic int"))
    assert toxicity._sampled(copied, 1)["text"].tolist() == [t for _, t in low]


def test_toxicity_ngrams_are_of_characters():
    # two words of three-byte characters: only whole characters make n-grams, 3 to 6 with the marks around
    assert len(toxicity.features("日本 x")) == 3 + 1 and len(toxicity.features("日本語 日")) == 3 + 2 + 1 + 1
    assert toxicity.features("AbÉ").tolist() == toxicity.features("abÉ").tolist() != toxicity.features("abé").tolist()


# packing


def test_packing_covers_every_id_once(spark, sf_dir, odd_docs, no_docs, land):
    for docs in (documents(spark, sf_dir), odd_docs.where("doc_id <> 1")):
        rows = docs.collect()
        ids = {r.doc_id: x + [1] for r, x in zip(rows, ids_by_library("word_bpe_49k.json", [r.text for r in rows]))}
        pieces, sequences = defaultdict(list), defaultdict(list)
        for r in packing.pieces(docs, land).collect():
            own = ids[r.doc_id][r.start : r.start + r.length]
            assert r.ids_crc32 == crc(own) and r.ids == np.array(own, "<u4").tobytes() and r.doc_tokens == len(ids[r.doc_id]) and len(own) == r.length > 0
            pieces[r.doc_id].append((r.start, r.length))
            sequences[r.sequence_id].append((r.offset, r.length))
        for found, full in [(v, len(ids[k])) for k, v in pieces.items()] + [(v, None) for v in sequences.values()]:
            at = 0
            for start, length in sorted(found):
                assert start == at
                at += length
            assert at == full if full else at <= 2048 and (at == 2048 or at & (at - 1) == 0)
        assert set(pieces) == set(ids) and sorted(sequences) == list(range(len(sequences)))
    assert sum(r.length for r in packing.pieces(odd_docs.where("doc_id = 1"), land).collect()) == 2 * (len(ids_by_library("word_bpe_49k.json", [odd_docs.first().text])[0]) + 1)
    assert packing.pieces(no_docs, land).count() == 0


def test_hilbert_order_visits_neighbours():
    side = 8
    grid = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    key = packing.hilbert(grid, 3)
    assert sorted(key) == list(range(side**3))
    walk = grid[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()
