"""Alignment of two tokenizations of the same texts, and how often two ids stand for the same bytes.

A text's tokens by both vocabularies end at byte offsets. The ends of either side are kept in a dictionary from end to index; the keys that
both have, sorted, cut the two id lists into groups, and within a group every pair of tokens whose byte ranges overlap is a link. Both
vocabularies cut a text at a single space between two other characters, and between a Latin letter and a stop that ends a word, so a text is aligned
part by part, and a part that was seen before is looked up with its groups and links.

The texts go through in chunks of bounded size. A chunk's row holds its distinct parts with their links and, for each document, its parts:
so what is counted over the corpus is one row for each distinct pair of ids in a chunk. The totals of the chunk's pairs come back to it, and
the numbers of its documents are sums over their parts. What only the chunk itself reads again goes as bytes: the JVM neither takes such rows
apart nor copies them number by number.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import accumulate
from struct import Struct

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Land, landing, table, with_code

#: Characters of the texts of a chunk, and parts that a worker remembers, twice: those of late and those before.
CHUNK, MOST_PARTS = 2_000_000, 150_000
#: Bytes of what is remembered of parts, likewise: without spaces a part is as long as its text.
MOST_BYTES = 32_000_000
#: Fixed value: what stands for a space in pieces.
SPACE_MARK = "▁"
#: A pair of ids as one number.
SHIFT = 32


def byte_of_character() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones of Latin-1 as they are, the others from U+0100 on in turn."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


def piece_bytes(piece: str) -> bytes:
    found = re.fullmatch(r"<0x([0-9A-Fa-f]{2})>", piece)
    return bytes([int(found[1], 16)]) if found else piece.replace(SPACE_MARK, " ").encode()


def sliced(a_ids: list[int], b_ids: list[int], a_sizes: Sequence[int], b_sizes: Sequence[int]) -> tuple[list[tuple[int, int, int, int]], list[int]]:
    """Groups as ``(a from, a to, b from, b to)`` and the ids of links, two for each, of two id lists over the same bytes."""
    a_end = dict(zip(accumulate(a_sizes), range(1, len(a_ids) + 1)))
    b_end = dict(zip(accumulate(b_sizes), range(1, len(b_ids) + 1)))
    groups, links, i, j = [], [], 0, 0
    for end in sorted(a_end.keys() & b_end.keys()):
        p, q = a_end[end], b_end[end]
        groups.append((i, p, j, q))
        if p - i == 1:  # one token on a side overlaps all of the other
            for y in b_ids[j:q]:
                links += a_ids[i], y
        elif q - j == 1:
            for x in a_ids[i:p]:
                links += x, b_ids[j]
        else:
            u, v, left, right = i, j, a_sizes[i], b_sizes[j]
            while True:
                links += a_ids[u], b_ids[v]
                step = min(left, right)
                left, right = left - step, right - step
                if not left:
                    u += 1
                    left = a_sizes[u] if u < p else 0
                if not right:
                    v += 1
                    right = b_sizes[v] if v < q else 0
                if u == p or v == q:
                    break
        i, j = p, q
    return groups, links


class Aligner:
    """Parts of texts with what their alignment gives: numbers of tokens of either side and of groups, the ids of links, the groups as text, in
    one row of bytes; None for a part whose tokens don't spell it."""

    HEAD = Struct("<III")

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads keep memory of their own
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        of = byte_of_character()
        spelled = {i: bytes(of[c] for c in piece) if all(c in of for c in piece) else piece.encode() for piece, i in self.a.get_vocab().items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        # of every id: its bytes, their number, and the id as text
        self.a_ids = {i: (x, len(x), str(i)) for i, x in spelled.items()}
        self.b_ids = [(x, len(x), str(i)) for i, x in enumerate(map(piece_bytes, pieces))]
        # a piece that goes on after a space would join two parts
        self.cuts = not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces)
        self.late: dict[str | int, bytes | None] = {}
        self.before: dict[str | int, bytes | None] = {}
        self.held = 0
        # a stop after a letter is a token of its own where no piece holds both; it goes by its code, as a word can't
        one = {c: (self.a.encode(c, add_special_tokens=False).ids, self.b.piece_to_id(c)) for c in ".,"}
        self.stops = {c: ord(c) for c in one if not any(len(p) > 1 and p[-1] == c and p[-2].isalpha() for p in pieces) and pieces[one[c][1]] == c}
        self.fixed = {ord(c): self._aligned(c, one[c][0], [one[c][1]]) for c in self.stops}

    #: Between two characters that are no white space of any library.
    CUT = re.compile(r"(?<=[^\s\u180e]) (?=[^\s\u180e])")

    def parts(self, text: str | None) -> list[str | int]:
        """Words with the space before them; the code of a stop that is cut off."""
        if not text:
            return []
        if not self.cuts:
            return [text]
        out, stops = [], self.stops
        for p in self.CUT.split(text):
            if p[-1] in stops and len(p) > 1 and p[-2] < "\u0250" and p[-2].isalpha():
                out += p[:-1], stops[p[-1]]
            else:
                out.append(p)
        return out

    def learn(self, parts: list[str | int]) -> list[bytes | None]:
        """What is held of each part; parts not held are aligned first."""
        late, before = self.late, self.before
        new = []
        for p in parts:
            if p not in late:
                if p in before:
                    self._keep(p, before[p])
                elif p not in self.fixed:
                    new.append(p)
        for at in range(0, len(new), 1000):
            some = new[at : at + 1000]
            for p, a, b in zip(some, self.a.encode_batch_fast([" " + p for p in some], add_special_tokens=False), self.b.encode(some, num_threads=1)):
                self._keep(p, self._aligned(" " + p, a.ids, b))
        out = [late[p] if p in late else self.fixed[p] for p in parts]
        if len(late) > MOST_PARTS or self.held > MOST_BYTES:  # what hasn't been asked for since is let go
            # nor is what a chunk of long parts leaves worth keeping
            self.late, self.before, self.held = {}, late if self.held <= 2 * MOST_BYTES else {}, 0
        return out

    def _keep(self, part: str, found: bytes | None) -> None:
        self.late[part] = found
        self.held += len(part) + len(found or b"")

    def _aligned(self, text: str, a_ids: list[int], b_ids: list[int]) -> bytes | None:
        whole = text.encode()
        if not a_ids or not b_ids:
            return None
        a_bytes, a_sizes, a = zip(*map(self.a_ids.__getitem__, a_ids))
        b_bytes, b_sizes, b = zip(*map(self.b_ids.__getitem__, b_ids))
        if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            return None
        groups, links = sliced(a_ids, b_ids, a_sizes, b_sizes)
        shown = ";".join([f"{a[i]}|{b[j]}" if p - i == 1 == q - j else ",".join(a[i:p]) + "|" + ",".join(b[j:q]) for i, p, j, q in groups])
        return self.HEAD.pack(len(a_ids), len(b_ids), len(groups)) + array("I", links).tobytes() + shown.encode()


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


CHUNKS = ("chunk long, doc_id array<long>, no_id array<boolean>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, sha array<string>, "
          "doc_parts binary, part binary, times binary, part_pairs binary, pair_at binary, pairs array<long>, links array<long>")


def packed(values: Sequence[int]) -> bytes:
    """Whole numbers, each in as few bytes as the largest takes; that number of bytes comes first."""
    size = np.min_scalar_type(int(np.max(values, initial=0))).itemsize
    return bytes([size]) + np.asarray(values, f"<u{size}").tobytes()


def unpacked(held: bytes) -> np.ndarray:
    return np.frombuffer(held, f"<u{held[0]}", offset=1).astype(np.int64)


def _chunk(number: int, doc_ids: list, texts: list[str | None], own: Aligner) -> pd.DataFrame:
    """The row of a chunk. ``part, times``: the parts of its documents one after another, ``doc_parts`` of each; ``pair_at``: the links of its
    parts likewise, ``part_pairs`` of each, by place in ``pairs``, which are the distinct pairs with their ``links`` in the chunk. The first
    five are ``packed``."""
    place: dict[str | int, int] = {}
    split = [[place.setdefault(p, len(place)) for p in own.parts(t)] for t in texts]
    found = own.learn([*place])
    heads, bad = b"".join([f[: own.HEAD.size] if f else bytes(own.HEAD.size) for f in found]), {i for i, f in enumerate(found) if f is None}
    sums = np.frombuffer(heads, "<u4").astype(np.int64).reshape(-1, 3)
    sizes = sums[:, 0] + sums[:, 1] - sums[:, 2]  # a group's tokens overlap in a chain
    ends = (own.HEAD.size + 8 * sizes).tolist()
    shown = [f[e:] if f else b"" for f, e in zip(found, ends)]
    none, parts, times, rows = np.zeros(0, np.int64), [], [], []
    for local in split:
        if not local or bad and not bad.isdisjoint(local):
            rows.append((0, 0, 0, "", 0))
            continue
        each, n = np.unique(np.array(local, np.int64), return_counts=True)
        parts.append(each)
        times.append(n)
        sha = hashlib.sha256()
        for at in range(0, len(local), 4096):  # long texts are written piece by piece
            sha.update((b";" if at else b"") + b";".join([shown[i] for i in local[at : at + 4096]]))
        n_a, n_b, n_groups = (int(x) for x in n @ sums[each])
        rows.append((n_a, n_b, n_groups, sha.hexdigest(), len(each)))
    part, times = (np.concatenate(x) if x else none for x in (parts, times))
    used = np.bincount(part, times, len(found)).astype(np.int64)
    ids_of_links = np.frombuffer(b"".join([f[own.HEAD.size : e] for f, e in zip(found, ends) if f]), np.uint32).astype(np.int64)
    pairs, at = np.unique(ids_of_links[::2] << SHIFT | ids_of_links[1::2], return_inverse=True)
    links = np.bincount(at, np.repeat(used, sizes), len(pairs)).astype(np.int64)
    n_a, n_b, n_groups, sha, doc_parts = zip(*rows)
    n_links = [a + b - g for a, b, g in zip(n_a, n_b, n_groups)]
    row = (number, [i or 0 for i in doc_ids], [i is None for i in doc_ids], n_a, n_b, n_groups, n_links, sha, *map(packed, (doc_parts, part, times, sizes, at)), pairs, links)
    return pd.DataFrame({c.split()[0]: [list(v) if isinstance(v, tuple) else v] for c, v in zip(CHUNKS.split(", "), row)})


def _aligned(a_path: str, b_path: str, size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, number = aligner(a_path, b_path), TaskContext.get().partitionId() << 40
        ids, texts, held = [], [], 0
        for batch in batches:
            for i, t in zip(batch["doc_id"], batch["text"]):
                ids.append(None if pd.isna(i) else int(i))
                texts.append(t)
                held += len(t or "")
                if held >= size or len(ids) >= size:
                    yield _chunk(number, ids, texts, own)
                    ids, texts, held, number = [], [], 0, number + 1
        if ids:
            yield _chunk(number, ids, texts, own)

    return run


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _summed(chunk: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """Documents of a chunk, given the corpus-wide counts of its pairs."""
    aligner.cache_clear()  # nothing is aligned from here on
    r = chunk.iloc[0]
    place, of = known["place"].to_numpy(np.int64), {"best": np.zeros(len(r["pairs"]), np.int64), "total": np.zeros(len(r["pairs"]), np.int64)}
    for name, value in of.items():
        value[place] = known[name].to_numpy(np.int64)
    at, sizes, part, times, doc_parts = (unpacked(r[c]) for c in ("pair_at", "part_pairs", "part", "times", "doc_parts"))
    by_part, by_doc, sums = np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.arange(len(doc_parts)), doc_parts), {}
    for name, value in of.items():
        of_part, of_doc = np.zeros(len(sizes), np.int64), np.zeros(len(doc_parts), np.int64)
        np.add.at(of_part, by_part, value[at])
        np.add.at(of_doc, by_doc, times * of_part[part])
        sums[name] = of_doc
    ids = pd.array(np.asarray(r["doc_id"], np.int64), "Int64")
    ids[np.asarray(r["no_id"], bool)] = pd.NA
    return pd.DataFrame({"doc_id": ids, "n_a": r["n_a"], "n_b": r["n_b"], "n_groups": r["n_groups"], "n_links": r["n_links"], "n_best": sums["best"], "count_sum": sums["total"], "groups_sha256": r["sha"]})


def align(docs: DataFrame, land: Land, a_path: str, b_path: str, chunk: int = CHUNK) -> DataFrame:
    """One row for every row of ``docs`` (``doc_id, text``; other columns are ignored), as ``RESULT``.

    A null or empty text, and one whose joined token bytes on a side are not a space and the text (as where it holds U+2581), has no tokens: zeros, and an empty
    ``groups_sha256``. Repeated rows each have a row and count in full; a null id stays null. A text longer than a chunk is a chunk of its own. An
    empty table gives none.
    """
    with_code(docs.sparkSession)
    chunks = land.compressed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(_aligned(a_path, b_path, chunk), CHUNKS))
    seen = chunks.select(F.explode(F.arrays_zip("pairs", "links")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.links").alias("n"))
    totals = land(seen.groupBy("pair").agg(F.sum("n").alias("total")))
    b_id = F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1))
    # no more rows than the second vocabulary has ids
    highest = F.broadcast(totals.groupBy(b_id.alias("b")).agg(F.max("total").alias("highest")))
    ranked = totals.join(highest, b_id == F.col("b")).select(F.col("pair"), "total", (F.col("total") == F.col("highest")).cast("int").alias("best"))
    asked = chunks.select(F.col("chunk").alias("of"), F.posexplode("pairs").alias("place", "pair"))
    known = asked.join(ranked, "pair").select("of", "place", "total", "best")
    return chunks.drop("links").groupBy("chunk").cogroup(known.groupBy("of")).applyInPandas(_summed, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents``, by byte pairs and by pieces."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return align(docs, landing(spark), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
