"""LM scoring by prediction by partial matching (PPM) over bytes.

The model is a trie of contexts of up to ``ORDER`` bytes with the counts of the symbols after each, of A-Z lower-cased UTF-8 between marks, gathered from all training
documents. A symbol is looked for from the longest context down. At a context with ``n`` counts of ``q`` symbols a symbol
counted ``c`` times has the share ``(2 c - 1) / 2 n`` and an escape ``q / 2 n`` (method D), and symbols of the longer context, already ruled out, are excluded from ``n`` and ``q``; contexts never seen and those with nothing
left are passed without cost. Below order 0 the symbols not seen are equally likely. So the probabilities of all symbols add up to 1.

Neither the trie nor the text goes through one place. A chunk of documents asks for the distinct (context, symbol) pairs of its text; pairs are dealt
by their two nearest context bytes into shards, each of which has whole subtries, answers the pairs with log-probabilities, and sends them back to
the chunk, where they are summed by document. Words and their counts for the base score travel the same way. Only the counts of byte pairs, 65,536 at most,
reach every task. Pairs travel as sorted, deflated arrays, a row for each chunk and shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Land, count_below, landing, quantile_bounds, slots, table, with_code
from .hashing import lowered, mixed, word_hashes
from .toxicity import fold

#: Bytes of the longest context; with the symbol they fit 48 bits.
ORDER = 5
#: Bytes of text of a chunk, shards of the trie, chunks whose questions are answered together.
CHUNK, SHARDS, TOGETHER = 16 << 20, 64, 32
#: Positions of a text that are looked at together.
WINDOW = 1 << 21
#: Kinds of keys.
PAIR, WORD = 0, 1
#: Never a byte of UTF-8: the begin and the end of a document.
MARK = 0xFF
#: The end, as a word.
END_WORD = int(mixed(np.array([0xE0F], np.uint64))[0])

_U = np.uint64


def pack(a: np.ndarray) -> bytes:
    """Ascending numbers as deflated planes of the bytes of their differences."""
    return zlib.compress(np.diff(a.astype(_U), prepend=_U(0)).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(_U).reshape(-1), dtype=_U)


def windows(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(context, symbol) pairs of all texts and the text of each, some at a time; each text ends with the mark."""
    head = bytes([MARK]) * ORDER
    stream = np.frombuffer(b"".join(head + t + bytes([MARK]) for t in texts), np.uint8)
    size = np.array([len(t) + 1 for t in texts], np.int64)
    first = np.cumsum(size + ORDER) - size
    for at in range(0, len(stream), WINDOW):
        low, stop = max(0, at - ORDER), min(len(stream), at + WINDOW)
        part = stream[low:stop].astype(_U)
        pair = np.zeros(stop - at, _U)
        for k in range(ORDER, -1, -1):
            shifted = part[at - low - k : stop - low - k] if at - low >= k else np.concatenate((np.zeros(k, _U), part[: stop - at - k]))
            pair = (pair << _U(8)) | shifted
        where = np.arange(at, stop)
        owner = np.searchsorted(first, where, side="right") - 1
        real = (owner >= 0) & (where < first[owner] + size[owner])
        yield pair[real], owner[real]


def counted(pairs: np.ndarray, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 48-bit pairs and how many of each are trained."""
    s = np.sort((pairs << _U(1)) | trained.astype(_U))
    key = s >> _U(1)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat((s & _U(1)).astype(np.int64), first) if len(first) else np.zeros(0, np.int64)


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with their summed counts."""
    key, n = np.concatenate(keys) if keys else np.zeros(0, _U), np.concatenate(counts) if counts else np.zeros(0, np.int64)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(first) else n


def shard_of(kind: int, keys: np.ndarray, shards: int) -> np.ndarray:
    nearest = (keys >> _U(8)) & _U(0xFFFF) if kind == PAIR else keys
    return (mixed(nearest + _U(kind)) % _U(shards)).astype(np.int64)


def _levels(keys: np.ndarray, counts: np.ndarray, two: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs and counts by order, longest first: those of order 2 and more from the shard, the rest from the counts of byte pairs."""
    out = [(keys, counts)]
    for order in range(ORDER - 1, 1, -1):
        keys, counts = merged([keys & _U((1 << 8 * (order + 1)) - 1)], [counts])
        out.append((keys, counts))
    flat = two.reshape(-1)
    out.append((np.flatnonzero(flat).astype(_U), flat[flat > 0]))
    one = two.sum(axis=0)
    out.append((np.flatnonzero(one).astype(_U), one[one > 0]))
    return out


def _found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each key in a sorted table and whether it is there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def _contexts(keys: np.ndarray, *sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct contexts of sorted pairs, and by context the sums of what comes with the pairs."""
    ctx = keys >> _U(8)
    first = np.flatnonzero(np.concatenate(([True], ctx[1:] != ctx[:-1]))) if len(ctx) else np.zeros(0, np.int64)
    return ctx[first], *[np.add.reduceat(s, first) if len(first) else s for s in sums]


def log_probabilities(asked: np.ndarray, keys: np.ndarray, counts: np.ndarray, two: np.ndarray) -> np.ndarray:
    """log10 probability of the symbol of each asked pair after its context; ``keys, counts`` is the shard, ``two`` the counts of byte pairs."""
    levels = _levels(keys, counts, two)
    out, done = np.zeros(len(asked)), np.zeros(len(asked), bool)
    for level, (key, n) in enumerate(levels):
        order = ORDER - level
        own = asked & _U((1 << 8 * (order + 1)) - 1)
        ctx, total, distinct = _contexts(key, n, np.ones(len(key), np.int64))
        at, seen = _found(ctx, own >> _U(8))
        left = np.where(seen, total[at] if len(total) else 0, 0)
        kinds = np.where(seen, distinct[at] if len(total) else 0, 0)
        if level:  # exclude the symbols of the longer context
            above = levels[level - 1][0]
            lower, there = _found(key, above & _U((1 << 8 * (order + 1)) - 1))
            longer, mass, number = _contexts(above, np.where(there, n[lower] if len(n) else 0, 0), there.astype(np.int64))
            at, hit = _found(longer, (asked & _U((1 << 8 * (order + 2)) - 1)) >> _U(8))
            left = left - np.where(hit, mass[at] if len(mass) else 0, 0)
            kinds = kinds - np.where(hit, number[at] if len(mass) else 0, 0)
        at, hit = _found(key, own)
        hit &= ~done
        some = left > 0
        whole = np.where(some, 2 * left, 1)
        out += np.where(hit, np.log10(np.where(hit, 2 * (n[at] if len(n) else 1) - 1, 1) / whole), 0)
        gone = ~done & ~hit & some
        out += np.where(gone, np.log10(np.where(gone, kinds, 1) / whole), 0)
        done |= hit
    return out - np.where(done, 0, np.log10(256 - len(levels[-1][0])))


def _gathered(rows: DataFrame, shards: int) -> DataFrame:
    """``kind, shard, chunk, keys, counts``: what each chunk holds, and how often in training texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for chunk, own in batch.groupby("chunk", sort=False):
                if len(held) and (chunk, PAIR) not in held:
                    yield from sent(held)
                texts, trained = [lowered(t) for t in own["text"]], own["trained"].to_numpy(bool)
                for pairs, owner in windows(texts):
                    held.setdefault((chunk, PAIR), []).append(counted(pairs, trained[owner]))
                for at in range(0, len(texts), 1000):
                    words = [np.append(word_hashes(t), _U(END_WORD)) for t in texts[at : at + 1000]]
                    ones = np.repeat(trained[at : at + 1000].astype(np.int64), [len(w) for w in words])
                    held.setdefault((chunk, WORD), []).append(merged([np.concatenate(words)], [ones]))
                for key, parts in held.items():
                    if len(parts) > 4:
                        held[key] = [merged([p[0] for p in parts], [p[1] for p in parts])]
        yield from sent(held)

    def sent(held: dict) -> Iterator[pd.DataFrame]:
        for (chunk, kind), parts in held.items():
            keys, n = merged([p[0] for p in parts], [p[1] for p in parts])
            place = shard_of(kind, keys, shards)
            order = np.argsort(place, kind="stable")
            edges = np.searchsorted(place[order], np.arange(shards + 1))
            rows = []
            for s in range(shards):
                at = order[edges[s] : edges[s + 1]]
                if len(at):
                    rows.append((kind, s, chunk, pack(keys[at]), zlib.compress(n[at].astype("<u4").tobytes(), 1)))
            yield pd.DataFrame(rows, columns=["kind", "shard", "chunk", "keys", "counts"])
        held.clear()

    return rows.mapInPandas(run, "kind int, shard int, chunk int, keys binary, counts binary")


def _summed(parts: DataFrame, *by: str) -> DataFrame:
    """``kind, shard`` (and what else is in ``by``) with the merged trained keys and counts."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        keys, n = merged([unpack(k) for k in rows["keys"]], [np.frombuffer(zlib.decompress(c), "<i8" if wide else "<u4").astype(np.int64) for c, wide in zip(rows["counts"], rows["wide"])])
        keys, n = keys[n > 0], n[n > 0]
        out = rows.iloc[:1][list(by)].assign(keys=[pack(keys)], counts=[zlib.compress(n.astype("<i8").tobytes(), 1)], wide=True, distinct_keys=len(keys), total=int(n.sum()))
        return out

    kinds = ", ".join(f"{b} int" for b in by) + ", keys binary, counts binary, wide boolean, distinct_keys long, total long"
    return parts.select(*by, "keys", "counts", "wide").groupBy(*by).applyInPandas(run, kinds)


def _byte_pairs(trie: DataFrame) -> np.ndarray:
    """Counts of symbols by the byte before."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            total = np.zeros(1 << 16, np.int64)
            for k, c in zip(batch["keys"], batch["counts"]):
                np.add.at(total, (unpack(k) & _U(0xFFFF)).astype(np.int64), np.frombuffer(zlib.decompress(c), "<i8"))
            at = np.flatnonzero(total)
            yield pd.DataFrame({"pair": at, "n": total[at]})

    found = trie.where(F.col("kind") == PAIR).select("keys", "counts").mapInPandas(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    two = np.zeros(1 << 16, np.int64)
    two[found["pair"]] = found["n"]
    return two.reshape(256, 256)


def score(docs: DataFrame, land: Land, trained: str = "trained") -> DataFrame:
    """``doc_id, trained, n_tokens, n_known, train_tokens, base_score, score`` for each row of ``docs`` (``doc_id, text`` and the boolean ``trained``).

    Other columns are ignored. A null or empty text is its end alone; a null ``trained`` is false. Rows with null or equal ids are documents of their own. Without
    any training text all symbols are equally likely, and the base score is 0.
    """
    spark = with_code(docs.sparkSession)
    rows = docs.select("doc_id", "text", F.coalesce(F.col(trained), F.lit(False)).alias("trained"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    bounds = quantile_bounds(rows, "doc_id", max(slots(spark), -(-size // CHUNK)))
    rows = rows.withColumn("chunk", F.coalesce(count_below(bounds, F.col("doc_id")), F.lit(0)).cast("int"))
    block = F.floor(F.col("chunk") / TOGETHER).cast("int").alias("block")
    asked = land(_gathered(rows.select("text", "trained", "chunk"), SHARDS))
    near = _summed(asked.select("*", block, F.lit(False).alias("wide")), "kind", "shard", "block")
    trie = land(_summed(near, "kind", "shard"))
    words = trie.where(F.col("kind") == WORD).agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n"), F.coalesce(F.sum("distinct_keys"), F.lit(0)).alias("v")).first()
    tokens, least = words["n"], words["n"] + 0.5 * (words["v"] + 1)
    two = spark.sparkContext.broadcast(_byte_pairs(trie))

    def answer(questions: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(questions):
            kind = int(questions["kind"].iloc[0])
            keys = unpack(shard["keys"].iloc[0]) if len(shard) else np.zeros(0, _U)
            n = np.frombuffer(zlib.decompress(shard["counts"].iloc[0]), "<i8") if len(shard) else np.zeros(0, np.int64)
            lists = [unpack(k) for k in questions["keys"]]
            every = np.unique(np.concatenate(lists))
            if kind == PAIR:
                value = log_probabilities(every, keys, n, two.value)
            else:
                at, hit = _found(keys, every)
                value = np.where(hit, n[at] if len(n) else 0, 0).astype(np.float64)
            for chunk, packed, own in zip(questions["chunk"], questions["keys"], lists):
                held = value[np.searchsorted(every, own)]
                out.append((chunk, kind, packed, zlib.compress(held.astype("<f4" if kind == PAIR else "<f8").tobytes(), 1)))
        return pd.DataFrame(out, columns=["chunk", "kind", "keys", "vals"])

    def add_up(texts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        held = {}
        for kind in (PAIR, WORD):
            own = answers[answers["kind"] == kind]
            keys = np.concatenate([unpack(k) for k in own["keys"]] or [np.zeros(0, _U)])
            vals = np.concatenate([np.frombuffer(zlib.decompress(v), "<f4" if kind == PAIR else "<f8") for v in own["vals"]] or [np.zeros(0)])
            order = np.argsort(keys, kind="stable")
            held[kind] = keys[order], vals[order].astype(np.float64)
        data = [lowered(t) for t in texts["text"]]
        total = np.zeros(len(data))
        for pairs, owner in windows(data):
            distinct, back = np.unique(pairs, return_inverse=True)
            total += np.bincount(owner, held[PAIR][1][np.searchsorted(held[PAIR][0], distinct)][back], minlength=len(data))
        base, known, count = [], [], []
        for t in data:
            c = held[WORD][1][np.searchsorted(held[WORD][0], np.append(word_hashes(t), _U(END_WORD)))]
            base.append(float(np.log10((c + 0.5) / least).sum()))
            known.append(int((c > 0).sum()))
            count.append(len(c))
        return pd.DataFrame({"doc_id": texts["doc_id"].astype("Int64"), "trained": texts["trained"], "n_tokens": count, "n_known": known, "base_score": base, "score": total})

    shards = trie.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(len(bounds) // TOGETHER)))).select("kind", "shard", "block", "keys", "counts")
    questions = asked.select("kind", "shard", block, "chunk", "keys")
    answers = questions.groupBy("kind", "shard", "block").cogroup(shards.groupBy("kind", "shard", "block")).applyInPandas(answer, "chunk int, kind int, keys binary, vals binary")
    kinds = "doc_id long, trained boolean, n_tokens long, n_known long, base_score double, score double"
    out = rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(add_up, kinds)
    return out.select("doc_id", "trained", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` scored by a model of those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("trained", fold(F.col("doc_id"), 5) != 1)
    return score(docs, landing(spark)).withColumn("held_out", ~F.col("trained")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
