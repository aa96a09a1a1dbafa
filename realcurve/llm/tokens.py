"""Token ids of whole texts by the tokenizers library, for tasks.

Both vocabularies cut a text at a single space between two other characters in every case, so the ids of a text are those of its
space-separated parts one after another. A part is encoded by the library once, many of them as one text, and then looked up. Texts with other white space beside a space are encoded whole.
Words of Latin letters need nothing of a vocabulary's normalizer and pattern but lower case and bytes as letters; the library's model gets them in that form.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

#: What the two vocabularies do before their model, as the library states it: normalizer and pre-tokenizer. ``True``: with a space before words.
_BEFORE = {
    True: (None, b'{"type":"ByteLevel","add_prefix_space":false,"trim_offsets":true,"use_regex":true}'),
    False: (
        rb'{"type":"Sequence","normalizers":[{"type":"NFC"},{"type":"Replace","pattern":{"Regex":"\\s+"},"content":" "},{"type":"Lowercase"}]}',
        rb"""{"type":"Sequence","pretokenizers":[{"type":"Split","pattern":{"Regex":"'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},"behavior":"Removed","invert":true},{"type":"ByteLevel","add_prefix_space":false,"trim_offsets":true,"use_regex":false}]}""",
    ),
}
#: The letter that stands for a byte in the model's vocabulary, for bytes of letters and a space, which stays; an underscore becomes what stands for a space.
_LETTERS = np.arange(256, dtype="<u2")
_LETTERS[[*range(127, 161), 173]] = 256 + np.arange(33, 68)
_LETTERS[ord("_")] = 256 + 32


class Encoder:
    """Ids as little-endian unsigned 32-bit numbers. ``spaced``: parts after the first keep the space before them."""

    #: Parts held at most where nothing else is said, in two halves: those of late and those before; what hasn't been asked for since is let go.
    MOST_PARTS = 600_000
    #: Parts that the library gets as one text.
    TOGETHER = 200
    #: What stands for a space in the model's letters.
    SPACE = "\u0120"
    #: Stands between parts in such a text; an id of its own.
    FENCE = "\x01"
    #: A run of these after a Latin letter is cut off in every case; the apostrophe is not among them.
    STOPS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
    #: In place of ids: one byte, as no ids are.
    WHOLE = b"?"

    def __init__(self, path: str, spaced: bool, held: int = MOST_PARTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.library, self.spaced, self.MOST_PARTS = Tokenizer.from_file(path), spaced, held
        self.library.encode_special_tokens = True  # names of special tokens in a text are ordinary text
        self.size = self.library.get_vocab_size()
        self.line = self.whole(["\n"])[0]
        self.fence = int(np.frombuffer(self.whole([self.FENCE])[0], "<u4")[-1])
        # the ids that begin (end, where not spaced) a word
        self.edge = np.zeros(self.size, bool)
        self.edge[[i for t, i in self.library.get_vocab().items() if (t.startswith(self.SPACE) if spaced else t.endswith("</w>"))]] = True
        states = [x and x.__getstate__() for x in (self.library.normalizer, self.library.pre_tokenizer)]
        self.model = Tokenizer(self.library.model) if states == [*_BEFORE[spaced]] else None
        if self.model:
            self.model.pre_tokenizer = CharDelimiterSplit(" ")
            self.gap = self.model.encode(self.SPACE).ids[0] if spaced else None
        # no part has a space, so one before a part tells the first of a text from the others where they differ
        self.late: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _cut(ids: np.ndarray, edges: list[int]) -> list[bytes]:
        data = ids.tobytes()
        return [data[4 * a : 4 * b] for a, b in zip(edges, edges[1:])]

    def _joined(self, parts: list[str]) -> list[bytes]:
        """Ids of every part for itself, of words that the library cuts at the single spaces between them, each with one id of ``edge``."""
        ids = np.array(self.library.encode_batch_fast([" " * self.spaced + " ".join(parts)], add_special_tokens=False)[0].ids, "<u4")
        return self._at_edges(parts, ids)

    def _at_edges(self, parts: list[str], ids: np.ndarray) -> list[bytes]:
        at = np.flatnonzero(self.edge[ids])
        if len(at) != len(parts):  # another vocabulary
            return self.whole([" " * self.spaced + p for p in parts])
        return self._cut(ids, [*at.tolist(), len(ids)] if self.spaced else [0, *(at + 1).tolist()])

    def _by_model(self, text: str) -> np.ndarray:
        """Ids of space-separated words of Latin letters."""
        raw = np.frombuffer((text if self.spaced else text.lower()).encode(), np.uint8)
        return np.array(self.model.encode_batch_fast([_LETTERS[raw].tobytes().decode("utf-16-le")], add_special_tokens=False)[0].ids, "<u4")

    def _latin(self, parts: list[str]) -> list[bytes]:
        """As ``_joined``, of words of Latin letters."""
        return self._at_edges(parts, self._by_model("_" + " _".join(parts) if self.spaced else " ".join(parts)))

    def _begun(self, parts: list[str]) -> list[bytes]:
        """The same of words that no space is before; each has a mark of one character, which is left out."""
        ids = self._by_model(" _ ".join([p[1:] for p in parts]) + " _")
        at = np.flatnonzero(ids == self.gap)
        if len(at) != len(parts):  # another vocabulary
            return self.whole([p[1:] for p in parts])
        data, ends = ids.tobytes(), at.tolist()
        return [data[4 * a : 4 * b] for a, b in zip([0, *(at + 1).tolist()], ends)]

    def _fenced(self, parts: list[str]) -> list[bytes]:
        """The same of parts without ``FENCE``, whatever number of words they are."""
        between = f" {self.FENCE} "
        ids = np.array(self.library.encode_batch_fast([between.join(parts) + between], add_special_tokens=False)[0].ids, "<u4")
        at = np.flatnonzero(ids == self.fence)
        if len(at) != len(parts):  # another vocabulary
            return self.whole(parts)
        data, ends = ids.tobytes(), at.tolist()
        return [data[4 * a : 4 * b] for a, b in zip([0, *(at + 1).tolist()], ends)]

    def _kept(self, parts: set[str]) -> set[str]:
        """Parts that are not held, of some that are not in ``late``; what was held before is held again."""
        again = self.before.keys() & parts
        self.late.update([(p, self.before[p]) for p in again])
        return parts - again

    def _learn(self, new: set[str]) -> None:
        """Holds ids of the parts, none of them in ``late``; ``WHOLE`` where a text with the part is encoded whole."""
        late, new, mark, stops = self.late, self._kept(new), " " * self.spaced, self.STOPS
        ended = [(p, c, mark + p[len(c) :]) for p in new if (c := p.rstrip(stops)) != p and c and (x := c[-1]) < "\u0250" and x.isalpha() and x != "\u0130"]
        asked = new.difference([p for p, _, _ in ended])
        asked.update([x for _, c, signs in ended for x in (c, signs)])
        asked = self._kept(asked.difference([p for p in asked if p in late]))
        lines = [p for p in asked if p[:1] == "\n" and len(p) > 1 and p[1:].strip() == p[1:]] if self.spaced else []
        asked.difference_update(lines)
        asked.update([x for p in lines if (x := " " + p[1:]) not in late])
        # letters that no normalizer changes into something else
        latin, begun, words, others, alone = [], [], [], [], []
        for p in asked:
            if p.isalpha():  # one word
                if p.isascii() or max(p) < "\u0250" and "\u0130" not in p:
                    (latin if self.model else words).append(p)
                    continue
                if self.spaced:
                    words.append(p)
                    continue
            late[p] = self.WHOLE
            if not self.spaced:
                (alone if self.FENCE in p else others).append(p)
            elif p and p.lstrip(" ") == p.strip():
                if p[0] != " ":
                    words.append(p)
                else:
                    (begun if self.model and p[1:].isalpha() and max(p) < "\u0250" else alone).append(p)
        ways = ((latin, self._latin), (begun, self._begun), (words, self._joined), (others, self._fenced), (alone, lambda some: self.whole([p.lstrip(" ") for p in some])))
        for some, ids_of in ways:
            for at in range(0, len(some), self.TOGETHER):  # the library's results are large beside their ids
                late.update(zip(some[at : at + self.TOGETHER], ids_of(some[at : at + self.TOGETHER])))
        for p in lines:
            late[p] = self.line + late[" " + p[1:]]
        for p, c, signs in ended:
            stem = late[c]
            late[p] = stem + late[signs] if stem is not self.WHOLE else stem

    def _parts(self, text: str | None) -> list[str]:
        if not text:
            return [""]
        if not self.spaced:  # any white space is only what separates words
            return text.replace("\n", " ").split(" ")
        if "\n\n" not in text:  # a line's first word keeps the end of line before it
            return text.replace("\n", " \n").split(" ")
        return text.split(" ") if " \n" not in text else ["", ""]  # the latter: encoded whole

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; null is empty."""
        split = [*map(self._parts, texts)]
        rows, gaps, new, held = [], [], set(), self.late.get
        for parts in split:
            if self.spaced:
                parts[0] = " " + parts[0]
            got = [*map(held, parts)]
            at = [i for i, x in enumerate(got) if x is None]
            new.update([parts[i] for i in at])
            rows.append(got)
            gaps.append(at)
        self._learn(new)
        for parts, got, at in zip(split, rows, gaps):
            for i in at:
                got[i] = held(parts[i])
        out = [b"".join(got) if self.WHOLE not in got else self.whole([text or ""])[0] for text, got in zip(texts, rows)]
        if len(self.late) > self.MOST_PARTS // 2:
            self.late, self.before = {}, self.late
        return out


@lru_cache(maxsize=2)
def encoder(path: str, spaced: bool, held: int = Encoder.MOST_PARTS) -> Encoder:
    return Encoder(path, spaced, held)


def in_slices(texts: list[str | None], size: int = 1 << 20):
    """Index ranges of texts of about ``size`` characters together."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= size:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(texts):
        yield at, len(texts)
