"""SentencePiece BPE encoding and decoding by a merge-type prefix table.

A BPE encoding of a prefix is unique, and so is its last token. The table holds that token for every prefix of a
segment: at each end position an automaton over the vocabulary gives the pieces that end there, and the one that
is compatible with the last token of the prefix before it (the two pieces joined encode to just these two) is
stored. Ids are then read backwards from the end. The vocabulary is read with the sentencepiece library; encoding
and decoding are done here.

Text is cut where white space starts, as no piece holds white space after another character. Runs of white space
have pieces of equal, lowest score, which the library merges from the left after all others; these are merged in
that order. Characters outside the vocabulary become byte pieces and separate what stands on their sides.

Cases: a null or empty text has no ids and decodes to the empty text; any id (null too) passes through; an empty
table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.llm import common

SPACE = "▁"
#: Entries that a cache may hold before it is emptied.
BOUND = 180_000
#: Longer segments are not remembered.
LONG = 64
_SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.score = [sp.get_score(i) for i in range(n)]
        self.bytes_ = {int(self.pieces[i][1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        skip = {i for i in range(n) if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        self.unknown = next((i for i in range(n) if sp.is_unknown(i)), None)
        self.control = {i for i in range(n) if sp.is_control(i)}
        self.id = {p: i for i, p in enumerate(self.pieces) if i not in skip}
        self.chars = {p for p in self.id if len(p) == 1}
        if any(SPACE in p.lstrip(SPACE) for p in self.id) or any(p.startswith(SPACE * 2) and p.strip(SPACE) for p in self.id):
            raise ValueError("a piece holds white space where this encoder cuts")
        self.words = {p: i for p, i in self.id.items() if p == SPACE or p.strip(SPACE)}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.words.items():
            if all(c in self.chars for c in p):
                self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.sizes = [len(p) for p in self.pieces]
        self.pairs: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        self.surface = [b"" if i in self.control else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        for b, i in self.bytes_.items():
            self.surface[i] = bytes([b])
        if self.unknown is not None:
            self.surface[self.unknown] = " ⁇ ".encode()
        self.last_control = max(self.control, default=-1)
        self.byte_ids = frozenset(self.bytes_.values())

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain merging of a short list: best score first, leftmost among equals."""
        symbols = list(symbols)
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                k = self.id.get(symbols[i] + symbols[i + 1])
                if k is not None and (best is None or self.score[k] > best):
                    best, at = self.score[k], i
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def compatible(self, a: int, b: int) -> bool:
        """Whether pieces a and b, joined, encode to a and b."""
        key = a << 24 | b
        known = self.pairs.get(key)
        if known is None:
            x, y = self.pieces[a], self.pieces[b]
            if len(self.pairs) > 2 * BOUND:
                self.pairs.clear()
            known = self.pairs[key] = self.merged(list(x + y)) == [x, y]
        return known

    def alone(self, a: int) -> bool:
        """Whether piece a encodes to itself."""
        known = self.whole.get(a)
        if known is None:
            known = self.whole[a] = len(self.merged(list(self.pieces[a]))) == 1
        return known

    @lru_cache(maxsize=256)  # noqa: B019 - one model a process
    def run(self, n: int) -> tuple[int, ...]:
        """Ids of n white-space characters. The longest pieces of such runs are short, so a window at the left
        is all that merging from the left ever touches; what no longer merges with its right side is done."""
        symbols, done = [SPACE] * min(n, 64), []
        left = n - len(symbols)
        while True:
            symbols = self.merged(symbols)
            if not left:
                return tuple(self.id[s] for s in done + symbols)
            done.append(symbols.pop(0))
            take = min(left, 64)
            left -= take
            symbols = [SPACE] * (sum(map(len, symbols)) + take)

    def known(self, text: str) -> list[int]:
        """Ids of a text of known characters with white space at its start only, if at all."""
        n = len(text)
        last = [-1] * (n + 1)
        pairs, compatible = self.pairs, self.compatible
        for end, (length, i) in self.automaton.iter(text):  # by end, longest first
            end += 1
            if last[end] >= 0:
                continue
            start = end - length
            if start:
                before = last[start]
                if before < 0:
                    continue
                fits = pairs.get(before << 24 | i)
                if fits is None:
                    fits = compatible(before, i)
            else:
                fits = self.alone(i)
            if fits:
                last[end] = i
        out, at = [], n
        while at:
            i = last[at]
            out.append(i)
            at -= self.sizes[i]
        return out[::-1]

    def segment(self, text: str) -> list[int]:
        """Ids of white space followed by other characters (either may be missing)."""
        body = text.lstrip(SPACE)
        spaces = len(text) - len(body)
        out: list[int] = []
        if body:
            head = SPACE if spaces else ""
            for part, is_known in self.parts(head + body):
                if is_known:
                    out += self.known(part)
                else:
                    out += [self.bytes_.get(b, self.unknown) for b in part.encode("utf-8", "replace")] if self.bytes_ else [self.unknown]
            if spaces and out[0] == self.id[SPACE]:
                out = out[1:]
            else:
                spaces -= bool(spaces)
        return [*self.run(spaces), *out] if spaces else out

    def parts(self, text: str) -> list[tuple[str, bool]]:
        """Maximal parts of characters that the vocabulary has, and of others."""
        if all(c in self.chars for c in text):
            return [(text, True)]
        out: list[tuple[str, bool]] = []
        for c in text:
            is_known = c in self.chars
            if out and out[-1][1] == is_known:
                out[-1] = (out[-1][0] + c, is_known)
            else:
                out.append((c, is_known))
        return out

    def encode_bytes(self, text: str) -> bytes:
        """Ids as 32-bit integers in a row."""
        if not text:
            return b""
        get, miss = self.cache.get, self._miss
        if "  " not in text and text[0] != " " and text[-1] != " " and SPACE not in text:  # words one space apart
            return b"".join([get(x) or miss(x) for x in text.split(" ")])
        return b"".join([get(x) or miss(x) for x in _SEGMENT.findall(SPACE + text.replace(" ", SPACE))])

    def _miss(self, seg: str) -> bytes:
        """Ids of a segment; one without white space stands for itself after a space."""
        ids = np.array(self.segment(seg if seg[0] == SPACE else SPACE + seg), np.int32).tobytes()
        if len(seg) <= LONG:
            cache = self.cache
            if len(cache) > 2 * BOUND:  # the older half goes; what is frequent soon comes back
                for old in list(islice(cache, BOUND)):
                    del cache[old]
            cache[seg] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        if self.control and min(ids, default=self.last_control + 1) <= self.last_control and not self.control.isdisjoint(ids):  # control ids end a character's bytes
            parts, rest = [], list(ids)
            while (at := next((i for i, x in enumerate(rest) if x in self.control), None)) is not None:
                parts.append(rest[:at])
                rest = rest[at + 1 :]
            parts.append(rest)
            texts: list[str] = []
            for part in parts:
                texts.append(self._joined(part, not any(texts)))
            return "".join(texts)
        return self._joined(ids, True)

    def _joined(self, ids: list[int], begins: bool) -> str:
        first = ids[0] if begins and len(ids) else None
        data = b"".join(map(self.surface.__getitem__, ids))
        if first is not None and first not in self.byte_ids and self.pieces[first].startswith(SPACE):
            data = data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:  # ids that no text gives: each byte that is no part of a character is replaced
            return self._repaired(data)

    @staticmethod
    def _repaired(data: bytes) -> str:
        out, i = [], 0
        while i < len(data):
            for n in (1, 2, 3, 4):
                try:
                    out.append(data[i : i + n].decode())
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            gc.disable()  # no garbage arises here
            ids = [m.encode_bytes(t.as_py() or "") for t in batch.column(1)]
            gc.enable()
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int64)
            flat = np.frombuffer(b"".join(ids), np.int32)
            for at in range(0, len(ids), 500):  # pieces of a batch stay below Arrow's 2 GB lists
                to = min(len(ids), at + 500)
                part = pa.ListArray.from_arrays(pa.array(ends[at : to + 1] - ends[at], pa.int32()), pa.array(flat[ends[at] : ends[to]]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), part], ["id", "ids"])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            gc.disable()  # nor here
            texts = [m.decode(x.values.to_numpy().tolist() if x.is_valid else []) for x in batch.column(1)]
            gc.enable()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["id", "ids", "decoded"])

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the ids of every whole text. No shuffle."""
    common.ship(docs.sparkSession)
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(plain.dtypes)["id"]
    return plain.mapInArrow(common.tidy(_encode(path)), f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, decoded): the text of every list of ids. No shuffle."""
    common.ship(encoded.sparkSession)
    plain = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = dict(plain.dtypes)["id"]
    return plain.mapInArrow(common.tidy(_decode(path)), f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)
