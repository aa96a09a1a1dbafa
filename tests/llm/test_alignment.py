"""Alignment of tokenizers against whole texts by plain Python."""

import hashlib
from collections import Counter

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from realcurve.llm import alignment
from realcurve.llm.queries import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def tokens(text, a, b, of):
    """Spans of both sides over the bytes of a whole text, or None."""
    out = []
    for ids, spelled in ((a.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(of[c] for c in a.id_to_token(i))), (b.encode(text), lambda i: alignment.piece_bytes(b.id_to_piece(i)))):
        spans, at = [], 0
        for i in ids:
            n = len(spelled(i))
            spans.append((at, at + n, i))
            at += n
        if b"".join(spelled(i) for i in ids) != (" " + text).encode():
            return None
        out.append(spans)
    return out


def brute(rows):
    a, b, of = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), alignment.byte_of_character()
    a.encode_special_tokens = True
    docs, counts = [], Counter()
    for i, text in rows:
        got = tokens(text, a, b, of) if text else None
        if got is None:
            docs.append((i, None, [], 0))
            continue
        x, y = got
        links = []
        for s, e, k in x:
            links += [(k, q) for u, v, q in y if u < e and v > s]
        ends = sorted({e for _, e, _ in x} & {e for _, e, _ in y})
        groups, at = [], 0
        for end in ends:
            groups.append(",".join(str(k) for s, e, k in x if at < e <= end) + "|" + ",".join(str(k) for s, e, k in y if at < e <= end))
            at = end
        counts.update(links)
        docs.append((i, groups, links, (len(x), len(y))))
    best = {}
    for (_, q), n in counts.items():
        best[q] = max(best.get(q, 0), n)
    out = Counter()
    for i, groups, links, n in docs:
        if groups is None:
            out[i, 0, 0, 0, 0, 0, 0, ""] += 1
        else:
            out[i, n[0], n[1], len(groups), len(links), sum(counts[k] == best[k[1]] for k in links), sum(counts[k] for k in links), hashlib.sha256(";".join(groups).encode()).hexdigest()] += 1
    return out


ODD = [
    (1, "A plain text, with some words."), (1, "A plain text, with some words."), (2, None), (3, ""), (4, " "), (5, "  two  spaces \n and\tlines \r\n end "), (6, "▁mark and more"), (7, "<|endoftext|> and </s> <s> <0x0A> <unk> it's"),
    (8, "naïve 日本語 😀😀 é x   y\u0000z ᠎ q"), (None, "no id"), (9, "supercalifragilistic" * 30), (10, "12345 67,89.0 #$%^&*() --- ___"), (11, "don't 'll x's  's"), (12, "ا ب ت ทดสอบ"), (13, "a ▁ b"), (14, "End. of, it.. é. ß, 4. .a ,b z.\n. x., U.S. a.b. Ы. 語, , ."), (15, ".") , (16, "a."), (2**60, "large id"), (None, None)]


def found(df, land, **how):
    return Counter(map(tuple, alignment.align(df, land, A, B, **how).collect()))


def test_odd_texts_against_whole_texts(spark, land):
    rows = ODD + [(100 + i, f"text number {i} has the words of {i % 3} and {'x' * (i % 7)}") for i in range(40)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, pairs string, n_a int")
    want = brute(rows)
    assert found(df, land) == want
    assert found(df, land, chunk=50) == want


def test_documents_of_the_folder(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if len(r.text or "") < 3000]
    import realcurve.llm.common as common

    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(df, common.landing(spark)) == brute(rows)
    assert QUERIES["op11_alignment"](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_long_text_and_no_rows(spark, land, odd_docs, no_docs):
    long = " ".join(f"w{i % 977} x{i % 31}" for i in range(60_000))
    df = spark.createDataFrame([(1, long), (2, long)], "doc_id long, text string")
    a, b = sorted(alignment.align(df, land, A, B).collect())
    assert a[1:] == b[1:] and a.n_links == a.n_a + a.n_b - a.n_groups and a.count_sum % 2 == 0
    assert alignment.align(odd_docs, land, A, B).count() == odd_docs.count() and alignment.align(no_docs, land, A, B).count() == 0


def test_slices_expand_links():
    # bytes:  aa bbb c | dd   against  a abb bc | dd
    groups, links = alignment.sliced([1, 2, 3, 4], [5, 6, 7, 8], [2, 3, 1, 2], [1, 3, 2, 2])
    assert groups == [(0, 3, 0, 3), (3, 4, 3, 4)]
    assert links == [1, 5, 1, 6, 2, 6, 2, 7, 3, 7, 4, 8]
    assert alignment.sliced([1, 2], [3], [1, 1], [2]) == ([(0, 2, 0, 1)], [1, 3, 2, 3])


def test_what_is_held_of_parts_is_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(alignment, "MOST_BYTES", 20_000, raising=False)
    own = alignment.Aligner(A, B)
    size = lambda held: sum(len(p) + len(f or b"") for p, f in held.items())
    for k in range(8):
        parts = [f"{k}x{i}" + "語日本" * 30 for i in range(5)]
        # the first are asked for again and again
        assert own.learn(["again", *parts]) == alignment.Aligner(A, B).learn(["again", *parts])
        assert size(own.late) <= 20_000 and size(own.before) <= 40_000
    own.learn([f"{i}" + "語日本" * 300 for i in range(20)])
    assert size(own.late) == size(own.before) == 0


def test_numbers_of_a_chunk_are_bytes_to_the_jvm():
    row = alignment._chunk(7, [1, None, 3], ["a word and a word", None, "and 日本語"], alignment.Aligner(A, B)).iloc[0]
    assert all(isinstance(row[c], bytes) for c in ("doc_parts", "part", "times", "part_pairs", "pair_at"))
    assert alignment.unpacked(row["doc_parts"]).tolist() == [3, 0, 2] and alignment.unpacked(row["times"]).tolist() == [2, 2, 1, 1, 1]
    for numbers in ([], [0], [3, 255], [256, 1], [65_535], [65_536, 0], [2**32 - 1], [2**32]):
        assert alignment.unpacked(alignment.packed(numbers)).tolist() == numbers
        assert len(alignment.packed(numbers)) == 1 + len(numbers) * (1 if max(numbers, default=0) < 256 else 2 if max(numbers) < 65_536 else 4 if max(numbers) < 2**32 else 8)
