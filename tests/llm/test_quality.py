"""The cascade of quality rules against plain Python, and its order."""

import re

import numpy as np
from pyspark.sql import functions as F

from realcurve.llm import quality_cascade as qc


def plain(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [s for s in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    n = len(words)
    chars, symbols, dup = sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines))
    failed = n < 10 or 100 * len(covered) > 20 * n
    rejected = [
        10 * symbols > n, chars < 2 * n or chars > 12 * n, 100 * dup > 30 * len(lines), any(len(w) > 1000 for w in words),
        100 * sum(any(c.isalpha() for c in w) for w in words) < 40 * n,
        100 * sum(s.lstrip(" \t\n\v\f\r")[0] in "-*•" for s in lines) > 90 * len(lines),
        100 * sum(s.rstrip(" \t\n\v\f\r").endswith(("...", "…")) for s in lines) > 30 * len(lines)]
    return n, chars, symbols, dup, len(covered), failed, not failed and not any(rejected)


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def judged(spark, land, texts):
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)], "doc_id long, text string, kept string, n_words string")
    return {r.doc_id: tuple(r[c] for c in NAMES) for r in qc.judge(df, land).collect()}


def test_counts_and_verdicts_against_plain_python(spark, land):
    rng = np.random.default_rng(3)
    some = ["alpha", "beta", "gamma", "delta", "épsilon", "😀", "12", "x#y", "-", "..."]
    texts = [" ".join(rng.choice(some[: rng.integers(3, 10)], rng.integers(1, 60))) for _ in range(60)]
    texts += ["".join(rng.choice(["word ", "two\n", "\n", "\t", " ", "- item\n", "end...\n", "\r\n", "Ünï "], 40)) for _ in range(60)]
    good = "Every one of these many words stands here only once so that nothing else can be said about it"
    texts += [None, "", " \n\t", good, good, good + " " + "x" * 1001, good + " #$%", "1 2 3 4 5 6 7 8 9 10 11", "\n".join(["- " + w for w in good.split()]), "\n".join(good.split()[:5] * 3),
              " ".join(f"w{i}" for i in range(20000)), " ".join(f"w{i % 7}" for i in range(3000)), "a b c d e a b c d e", "a b c d e f g h a b c d e f g h i", "\n".join(w + "…" for w in good.split())]
    got = judged(spark, land, texts)
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        if t is None or len(t) < 5000:
            assert got[i] == plain(t), t
    long = got[len(texts) - 5]
    assert long[0] == 20000 and long[4] == 0 and long[6]
    assert got[len(texts) - 4][4] == 3000 and not got[len(texts) - 4][6]


def test_rows_of_every_kind(odd_docs, no_docs, land):
    got = qc.judge(odd_docs, land).collect()
    assert len(got) == odd_docs.count()
    assert {r.doc_id: r.kept for r in got if r.doc_id in (1, 2, 3, 5)} == {1: True, 2: False, 3: False, 5: True}
    assert "score" in got[0].asDict() and qc.judge(no_docs, land).count() == 0


def test_order_by_rejections_per_cost(spark, land):
    texts = [" ".join(f"w{i}x{k}" for k in range(200)) + (" #" * 60 if i % 2 else "") + ("\nline one\nline one" * 9 if i % 10 == 0 else "") for i in range(300)]
    sample = land(qc.counted(spark.createDataFrame([(t,) for t in texts], "text string")))
    held = {r.name: r for r in qc.rules()}
    slow = qc.Rule("slow_symbols", held["symbols"].rejects & F.exists("__words", lambda w: w.rlike("(#|z+q)$")))
    order = [r.name for r in qc.ordered(sample, [slow, *held.values()])]
    # the slow twin rejects the same rows, so it comes after all that reject more of what is left
    assert order[0] == "symbols" and order.index("repeated_lines") < order.index("slow_symbols")
    none = [r.name for r in qc.ordered(sample.where("1 = 0"), list(held.values()))]
    assert none == sorted(held)


def test_any_order_keeps_the_same(spark, land):
    texts = ["# " * 30 + "word " * 30, "one two three four five six seven eight nine ten eleven", "9 " * 5 + "8 7 6 5 4 3 2 1 0"]
    df = qc.counted(spark.createDataFrame([(t,) for t in texts], "text string"))
    found = [[r.f is None for r in df.select(qc.cascade(o).alias("f")).collect()] for o in (qc.rules(), qc.rules()[::-1])]
    assert found[0] == found[1] == [False, True, False]
