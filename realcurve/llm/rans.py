"""Token-id files coded by a static range asymmetric numeral system.

A file row is a segment: the documents of one range of ids, in order. The segment's counts of ids, scaled to a power of two, are the table
that its blocks share. A block holds whole documents, about ``BLOCK`` ids, dealt in turn to ``LANES`` coders whose words are interleaved in
the order in which decoding asks for them. Every ``SPAN`` steps a checkpoint keeps the states of all coders and the place in the words, so a
block is decoded from all its checkpoints at once; segments and blocks don't depend on each other. Each block carries checksums of its words and of its ids.

Layout of a block, little-endian: ids, steps, checkpoints, words (4 x uint32), crc32 of the ids, crc32 of the rest (2 x uint32), places of the
checkpoints (uint32), their states (uint64, ``LANES`` each), words (uint32). A table is two deflated runs of uint32: steps between the ids, scaled counts.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Land, count_below, landing, quantile_bounds, slots, table, with_code
from .tokens import encoder, in_slices

#: Ids of a block at least, coders of a block, steps between checkpoints.
BLOCK, LANES, SPAN = 1 << 16, 64, 256
#: log2 of the sum of a table, and the least state of a coder.
SCALE, LOW = 20, np.uint64(1 << 31)
#: Bytes of text wished for in a segment.
SEGMENT = 4 << 20
#: The id after each document.
END = 0

_HEAD = struct.Struct("<6I")
_U = np.uint64


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def scaled(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to the sum ``2 ** SCALE``, 1 at least where there was one; what rounding leaves goes to the most frequent."""
    seen = counts > 0
    room = (1 << SCALE) - int(seen.sum())
    if room < 0:
        raise ValueError(f"more than {1 << SCALE} distinct ids")
    out = np.where(seen, 1 + counts.astype(object) * room // max(1, int(counts.sum())), 0).astype(np.int64)
    if seen.any():
        out[counts.argmax()] += (1 << SCALE) - out.sum()
    return out


def pack_table(freq: np.ndarray) -> bytes:
    ids = np.flatnonzero(freq).astype("<u4")
    parts = [zlib.compress(np.diff(ids, prepend=np.uint32(0)).astype("<u4").tobytes()), zlib.compress(freq[ids].astype("<u4").tobytes())]
    return struct.pack("<2I", len(parts[0]), zlib.crc32(b"".join(parts))) + b"".join(parts)


def unpack_table(data: bytes) -> np.ndarray:
    size, check = struct.unpack_from("<2I", data)
    if zlib.crc32(data[8:]) != check:
        raise ValueError("damaged table")
    ids = np.cumsum(np.frombuffer(zlib.decompress(data[8 : 8 + size]), "<u4"), dtype=np.int64)
    out = np.zeros(int(ids[-1]) + 1 if len(ids) else 0, np.int64)
    out[ids] = np.frombuffer(zlib.decompress(data[8 + size :]), "<u4")
    return out


def _alike(steps: np.ndarray) -> Iterator[np.ndarray]:
    """Groups of blocks that differ by less than a factor of two in length, longest first, so that none is filled up much."""
    order = np.argsort(-steps, kind="stable")
    level = np.array([int(s).bit_length() for s in steps[order]])
    for at in np.unique(level)[::-1]:
        yield order[level == at]


def encode_blocks(ids: np.ndarray, edges: np.ndarray, freq: np.ndarray) -> list[bytes]:
    """The blocks ``ids[edges[i]:edges[i + 1]]``, coded side by side."""
    begins, out = (np.cumsum(freq) - freq).astype(_U), [b""] * (len(edges) - 1)
    freq, lanes = freq.astype(_U), np.arange(LANES)
    first, last = edges[:-1], edges[1:]
    steps = -(-(last - first) // LANES)
    for group in _alike(steps):
        if not len(group):
            continue
        top = int(steps[group[0]])
        state = np.full((len(group), LANES), LOW, _U)
        words, given = np.zeros((top, len(group), LANES), np.uint32), np.zeros((top, len(group), LANES), bool)
        marks = np.zeros((-(-top // SPAN), len(group), LANES), _U)
        sizes = steps[group]
        for t in range(top - 1, -1, -1):
            a = int(np.searchsorted(-sizes, -t, side="left"))  # blocks with more than t steps
            at = first[group[:a], None] + t * LANES + lanes
            real = at < last[group[:a], None]
            sym = ids[np.where(real, at, first[group[:a], None])]
            f, x = freq[sym], state[:a]
            full = real & (x >= f << _U(63 - SCALE))
            words[t, :a], given[t, :a] = x & _U(0xFFFFFFFF), full
            x = np.where(full, x >> _U(32), x)
            q = x // f
            state[:a] = np.where(real, (q << _U(SCALE)) + (x - q * f) + begins[sym], state[:a])
            if t % SPAN == 0:
                marks[t // SPAN, :a] = state[:a]
        for i, b in enumerate(group):
            n, m = int(steps[b]), -(-int(steps[b]) // SPAN)
            hit = given[:n, i]
            stream = words[:n, i][hit].astype("<u4").tobytes()
            places = np.concatenate(([0], np.cumsum(hit.sum(axis=1))))[:n:SPAN].astype("<u4")
            body = places.tobytes() + marks[:m, i].astype("<u8").tobytes() + stream
            own = ids[first[b] : last[b]].astype("<u4").tobytes()
            out[b] = _HEAD.pack(len(own) // 4, n, m, len(stream) // 4, zlib.crc32(own), zlib.crc32(body)) + body
    return out


def decode_blocks(blocks: list[bytes], freq: np.ndarray) -> list[np.ndarray]:
    """The ids of each block, all checkpoints of all blocks side by side. Damaged blocks raise ValueError."""
    names = np.repeat(np.arange(len(freq)), freq).astype(np.uint32)
    begins, freq = (np.cumsum(freq) - freq).astype(_U), freq.astype(_U)
    heads, states, places, steps, counts, streams, base = [], [], [], [], [], [], 0
    for data in blocks:
        n, length, marks, words, own, body = _HEAD.unpack_from(data)
        if zlib.crc32(data[_HEAD.size :]) != body:
            raise ValueError("damaged block")
        at = _HEAD.size
        places.append(np.frombuffer(data, "<u4", marks, at).astype(np.int64) + base)
        states.append(np.frombuffer(data, "<u8", marks * LANES, at + 4 * marks).reshape(marks, LANES))
        streams.append(np.frombuffer(data, "<u4", words, at + 4 * marks + 8 * marks * LANES))
        begin = np.arange(marks) * SPAN
        steps.append(np.minimum(SPAN, length - begin))
        counts.append(np.minimum(SPAN * LANES, n - begin * LANES))
        heads.append((marks, own))
        base += words
    if not blocks:
        return []
    stream = np.concatenate([*streams, np.zeros(1, np.uint32)]).astype(_U)
    steps, counts, place, state = np.concatenate(steps), np.concatenate(counts), np.concatenate(places), np.concatenate(states)
    order = np.argsort(-steps, kind="stable")
    steps_, counts_, place, state = steps[order], counts[order], place[order], state[order].copy()
    top, lanes, low = int(steps_[0]) if len(steps_) else 0, np.arange(LANES), _U((1 << SCALE) - 1)
    found = np.zeros((len(order), top, LANES), np.uint32)
    for t in range(top):
        a = int(np.searchsorted(-steps_, -t, side="left"))
        x = state[:a]
        real = t * LANES + lanes < counts_[:a, None]
        part = x & low
        sym = names[np.where(real, part, _U(0)).astype(np.int64)]
        found[:a, t] = sym
        x = np.where(real, freq[sym] * (x >> _U(SCALE)) + part - begins[sym], x)
        need = real & (x < LOW)
        nth = np.cumsum(need, axis=1)
        state[:a] = np.where(need, (x << _U(32)) | stream[np.where(need, place[:a, None] + nth - 1, 0)], x)
        place[:a] += nth[:, -1]
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    out, at = [], 0
    for marks, own in heads:
        parts = [found[back[at + k]].reshape(-1)[: counts[at + k]] for k in range(marks)]
        ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        if zlib.crc32(ids.astype("<u4").tobytes()) != own:
            raise ValueError("block does not give its ids")
        out.append(ids)
        at += marks
    return out


def write(docs: DataFrame, path: str, tokenizer: str | None = None, spaced: bool = True, end: int = END) -> None:
    """Writes the ids of ``docs`` (``doc_id, text``; other columns are ignored) as segments, in ascending ``doc_id`` order, null ids first.

    Null and empty texts are their end alone. Rows with one id follow in the order of their texts' bytes. Segments are ranges of ids that hold about
    equal numbers of documents; their number grows with the bytes of text and is twice the shuffle's partitions at least.
    """
    with_code(docs.sparkSession)
    rows = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("at"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    bounds = quantile_bounds(rows, "at", max(2 * slots(docs.sparkSession), -(-size // SEGMENT)))
    name = tokenizer or default_tokenizer()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(text=group["text"].fillna("")).sort_values(["at", "text"], kind="stable")
        enc, texts, parts = encoder(name, spaced), group["text"].tolist(), []
        for a, b in in_slices(texts):
            parts += [x + struct.pack("<I", end) for x in enc.encode(texts[a:b])]
        sizes = np.array([len(p) // 4 for p in parts], np.int64)
        ids = np.frombuffer(b"".join(parts), "<u4")
        stops = np.cumsum(sizes)
        edges, docs_in = [0], []
        for i, stop in enumerate(stops):
            if stop - edges[-1] >= BLOCK or i == len(stops) - 1:
                docs_in.append(i + 1 - sum(docs_in))
                edges.append(int(stop))
        freq = scaled(np.bincount(ids))
        blocks = encode_blocks(ids, np.array(edges), freq)
        return pd.DataFrame({"segment": [int(group["segment"].iloc[0])], "n_ids": [len(ids)], "counts": [pack_table(freq)], "blocks": [blocks],
                             "block_docs": [docs_in], "doc_ids": [[None if pd.isna(d) else int(d) for d in group["doc_id"].astype("Int64")]], "doc_sizes": [sizes]})

    kinds = "segment long, n_ids long, counts binary, blocks array<binary>, block_docs array<int>, doc_ids array<long>, doc_sizes array<int>"
    cut = rows.withColumn("segment", count_below(bounds, F.col("at")).cast("long"))
    cut.groupBy("segment").applyInPandas(run, kinds).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document of a written folder: ``start`` ids lie before it, ``ids`` are little-endian unsigned 32-bit numbers."""
    files = with_code(spark).read.parquet(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for segment, counts, blocks, doc_ids, sizes in zip(batch["segment"], batch["counts"], batch["blocks"], batch["doc_ids"], batch["doc_sizes"]):
                ids = np.concatenate(decode_blocks(list(blocks), unpack_table(counts))).astype("<u4")
                stops = np.cumsum(np.asarray(sizes, np.int64))
                data = ids.tobytes()
                cut = [data[4 * (b - n) : 4 * b] for b, n in zip(stops.tolist(), sizes)]
                yield pd.DataFrame({"doc_id": pd.array([None if pd.isna(d) else int(d) for d in doc_ids], "Int64"), "segment": segment, "at": stops - sizes, "n_tokens": sizes, "ids": cut})

    docs = files.select("segment", "counts", "blocks", "doc_ids", "doc_sizes").mapInPandas(run, "doc_id long, segment long, at long, n_tokens long, ids binary")
    ahead = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)  # a row for each segment
    before = files.select("segment", F.coalesce(F.sum("n_ids").over(ahead), F.lit(0)).alias("before"))
    return docs.join(before, "segment").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids")


def round_trip(docs: DataFrame, land: Land) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every row of ``docs``, from files written and read back."""
    path = land.path()
    write(docs, path)
    return read(docs.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` as the files give it back."""
    return round_trip(table(spark, sf_dir, "documents"), landing(spark))
