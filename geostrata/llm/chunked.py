"""Token ids by the tokenizers library, with the ids of repeated chunks remembered.

A text is cut only where the vocabulary's own pre-tokenizer always cuts, so the chunks' ids in a row are exactly
the library's ids of the whole text:

* ``words``: at ASCII white space, which a vocabulary that drops white space replaces and never joins over;
* ``spaces``: before a space that follows a character that is no white space, for byte-level vocabularies whose
  tokens hold white space at their start only; and around single newlines between characters that are no white space.

Texts are cut and their chunks counted off by Arrow: Python sees every distinct chunk of a group of texts once, and
numpy puts the texts' ids together from the chunks' ids. A chunk that is new is put together from a word of Latin
letters, whose ids the library's model gives without its pre-tokenizer, and marks after it. Whatever else a chunk has
(other white space, runs of it, special tokens, digits) is left to the library as it is.

Cases: null texts are the callers' to make empty; an empty text has no ids; a very long one is cut by itself.
"""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks remembered by a worker; longer chunks are not.
BOUND, LONG = 400_000, 64
#: Characters of the texts that are cut at once, where there are several.
GROUP = 4_000_000
#: Starts the key of a chunk that has no space before it.
FIRST = "\x01"
_LATIN = re.compile(r"\x01?([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
_SPACES = re.compile(r"(?<=\S)(?= \S)")


def _printed() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the rest from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in set(own))
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _strings(words: pa.StringArray) -> list[str]:
    """An array of strings without spaces as a list: joined, decoded at once and cut, in a third of the time."""
    if not len(words):
        return []
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py().split(" ")


class ChunkEncoder:
    def __init__(self, path: str, cut: str, bound: int = BOUND):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.cut, self.bound = self.tokenizer.model, cut, bound
        spec = json.loads(self.tokenizer.to_str())
        #: Whether words may go to the model as they are: byte-level BPE with no affix but the word's end.
        self.plain = spec["model"]["type"] == "BPE" and not spec["model"].get("continuing_subword_prefix") and '"ByteLevel"' in json.dumps(spec["pre_tokenizer"])
        self.table = _printed()
        self.known: dict[str, bytes] = {}
        self._reset()

    def _reset(self) -> None:
        """An empty memory: number of each chunk, and of each number the place and count of its ids."""
        self.numbers: dict[str, int] = {}
        self.ids, self.used, self._count = np.empty(1 << 20, np.uint32), 0, 0
        self.starts, self.counts = np.empty(1 << 18, np.int64), np.empty(1 << 18, np.int32)

    def keys(self, text: str) -> str | list[str]:
        """Keys of the chunks of a text, joined by spaces where that is possible."""
        if self.cut == "words":
            if "\t" in text or "\r" in text:
                text = text.replace("\t", " ").replace("\r", " ")
            return text.replace("\n", " ")
        if "  " in text or "\n " in text or " \n" in text or "\n\n\n" in text or text.endswith("\n\n") or not text.replace("\n", "").isprintable():
            return [FIRST + c for c in _SPACES.split(text)]
        return FIRST + text.replace("\n", f" {FIRST}\n {FIRST}")

    def chunk(self, key: str) -> str:
        return key if self.cut == "words" else key[1:] if key.startswith(FIRST) else " " + key

    def word(self, word: str) -> list[int]:
        """Ids of a word of Latin letters, with the space before it if it has one."""
        if self.cut == "words":
            word = word.lower()
        text = word.replace(" ", self.table[32]) if word.isascii() else word.encode().decode("latin-1").translate(self.table)
        return [t.id for t in self.model.tokenize(text)]

    def each(self, chunks: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        gc.disable()  # the many strings here are no garbage; looking for it takes a tenth of the time
        try:
            at = size = 0
            for i, t in enumerate(texts):
                if i > at and size + len(t) > GROUP:
                    out += self._encode(texts[at:i])
                    at, size = i, 0
                size += len(t)
            return out + self._encode(texts[at:])
        finally:
            gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.keys(t) for t in texts]
        odd = [i for i, x in enumerate(cut) if isinstance(x, list)]
        lists = pc.split_pattern(pa.array(["" if isinstance(x, list) else x for x in cut], pa.string()), " ")
        coded = pc.dictionary_encode(lists.flatten())
        codes, ends = coded.indices.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()
        distinct = _strings(coded.dictionary)
        own = {k: None for i in odd for k in cut[i]}
        numbers = self.remember([*distinct, *own])
        chunks = numbers[codes]
        if odd:  # their chunks in the place of the empty text's
            place = dict(zip(own, numbers[len(distinct) :].tolist(), strict=True))
            pieces = np.split(chunks, ends[:-1])
            for i in odd:
                pieces[i] = np.fromiter((place[k] for k in cut[i]), np.int64, len(cut[i]))
            chunks, ends = np.concatenate(pieces), np.cumsum([len(p) for p in pieces])
        counts = self.counts[chunks]
        upto = np.cumsum(counts, dtype=np.int64)
        total = int(upto[-1]) if len(upto) else 0
        kind = np.int32 if max(total, self.used) < 2**31 else np.int64
        at = np.repeat((self.starts[chunks] - (upto - counts)).astype(kind), counts)
        at += np.arange(total, dtype=kind)
        data = self.ids[at].tobytes()
        stops = (4 * np.r_[0, upto][ends]).tolist()
        return [data[s:e] for s, e in zip([0, *stops[:-1]], stops, strict=True)]

    def remember(self, keys: list[str]) -> np.ndarray:
        """Numbers of chunks, new ones encoded."""
        if len(self.numbers) > self.bound:
            self._reset()
        new = [k for k in keys if k not in self.numbers]
        if new:
            self._add(new)
        out = np.fromiter(map(self.numbers.__getitem__, keys), np.int64, len(keys))
        for k in new:  # too long to be kept; what they left is dropped with the next reset
            if len(k) > LONG:
                del self.numbers[k]
        return out

    def _add(self, new: list[str]) -> None:
        words, marked, whole = {}, [], []
        for k in new:
            m = _LATIN.fullmatch(k) if self.plain and len(k) <= LONG else None
            if m is None:
                whole.append((k, self.chunk(k)))
                continue
            word, marks = m.groups()
            if self.cut == "words":
                word = word.lower()
            elif k[0] != FIRST:
                word = " " + word
            words[word] = None
            marked.append((k, word, marks))
        for w in words:
            words[w] = self.word(w)
        self.rest({marks for _, _, marks in marked if marks} | {c for _, c in whole if c})
        known = {m: np.frombuffer(self.known[m], np.uint32).tolist() for m in {marks for _, _, marks in marked if marks}}
        flat: list[int] = []
        sizes: list[int] = []
        for _, word, marks in marked:
            ids = words[word]
            flat += ids
            sizes.append(len(ids))
            if marks:
                flat += known[marks]
                sizes[-1] += len(known[marks])
        ids = np.concatenate([np.array(flat, np.uint32), *(np.frombuffer(self.known[c] if c else b"", np.uint32) for _, c in whole)])
        sizes += [len(self.known[c]) // 4 if c else 0 for _, c in whole]
        first = self._count
        self._keep(first, ids, np.array(sizes, np.int64))
        self.numbers.update(zip((k for k, *_ in (*marked, *whole)), range(first, first + len(sizes)), strict=True))

    def _keep(self, first: int, ids: np.ndarray, sizes: np.ndarray) -> None:
        n = first + len(sizes)
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.empty(max(len(self.ids), len(ids)), np.uint32)])
        if n > len(self.counts):
            more = max(len(self.counts), n)
            self.starts, self.counts = np.concatenate([self.starts, np.empty(more, np.int64)]), np.concatenate([self.counts, np.empty(more, np.int32)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[first:n] = self.used + np.cumsum(sizes) - sizes
        self.counts[first:n] = sizes
        self.used += len(ids)
        self._count = n

    def rest(self, parts: set[str]) -> None:
        """Bring ids of other parts of chunks into ``known``."""
        if len(self.known) > self.bound // 8:
            self.known.clear()
        todo = [a for a in parts if a not in self.known]
        for at in range(0, len(todo), 4096):
            own = todo[at : at + 4096]
            self.known.update(zip(own, self.each(own), strict=True))


def parts(batch: pa.RecordBatch, column: int, limit: int = GROUP) -> Iterator[pa.RecordBatch]:
    """A batch cut into slices of about ``limit`` bytes of a string column, of one row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + limit, "right")))
        yield batch.slice(at, end - at)
        at = end


@lru_cache(maxsize=4)
def encoder(path: str, cut: str, bound: int = BOUND) -> ChunkEncoder:
    return ChunkEncoder(path, cut, bound)
