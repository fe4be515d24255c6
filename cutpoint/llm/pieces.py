"""SentencePiece encoding that keeps offsets, and decoding.

A text is normalised here, by longest-prefix search in the model's compiled character map, and for every
normalised byte the source byte it came from is recorded. The normalised text is then cut before each run
of word marks that follows another character: where no piece of the vocabulary holds a mark after another
character, no merge crosses such a cut, so the blocks between cuts can be segmented on their own and
remembered. Blocks are segmented by the sentencepiece library with a copy of the model whose normaliser is
switched off. Piece lengths, summed, are looked up in the recorded alignment: every piece gets the span of
source bytes it stands for.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, types as T

from cutpoint.llm.texts import quoted, without

MARK = "▁"
#: Blocks longer than this are segmented without being remembered.
LONGEST_REMEMBERED = 64
#: Remembered words of one Python worker; beyond, those not met lately are forgotten.
REMEMBERED = 300_000
#: Characters of normalised text split into blocks at a time.
STRETCH = 1 << 20
#: Bytes of results handed back to Spark at a time.
FLUSH = 8 << 20

ADDED = (("ids", T.BinaryType()), ("starts", T.BinaryType()), ("ends", T.BinaryType()), ("decoded", T.StringType()))


def fields(message: bytes) -> Iterator[tuple[int, object, bytes]]:
    """(number, value, raw bytes) of a protocol buffer message."""
    at, end = 0, len(message)

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = message[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    while at < end:
        began = at
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 1:
            value, at = message[at : at + 8], at + 8
        elif kind == 2:
            size, at = varint(at)
            value, at = message[at : at + size], at + size
        else:
            value, at = message[at : at + 4], at + 4
        yield key >> 3, value, message[began:at]


class CharacterMap:
    """The compiled character map: a double-array trie of byte strings and their replacements."""

    def __init__(self, compiled: bytes):
        (size,) = struct.unpack_from("<I", compiled) if compiled else (0,)
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist() if size else []
        self.replacements = compiled[4 + size :]
        self.first = self._first_bytes()

    def _first_bytes(self) -> frozenset[int]:
        """Bytes that begin a rule: texts without them need no search."""
        if not self.units:
            return frozenset()
        root = self._offset(self.units[0])
        return frozenset(
            b for b in range(1, 256) if root ^ b < len(self.units) and self.units[root ^ b] & 0x800000FF == b
        )

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest rule that begins at ``at``, and its replacement."""
        units, found = self.units, None
        node = self._offset(units[0])
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(units) or units[node] & 0x800000FF != text[i]:
                break
            has_leaf = units[node] >> 8 & 1
            node ^= self._offset(units[node])
            if has_leaf:
                begin = units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.replacements[begin : self.replacements.index(b"\0", begin)]
        return found


class Encoder:
    """One model: normalises, segments and projects pieces back to source bytes."""

    def __init__(self, model: bytes):
        top = list(fields(model))
        spec = dict(
            (n, v) for number, value, _ in top if number == 3 for n, v, _ in fields(value)
        )
        trainer = dict((n, v) for number, value, _ in top if number == 2 for n, v, _ in fields(value))
        self.map = CharacterMap(spec.get(2, b""))
        self.dummy_prefix = bool(spec.get(3, 1))
        self.squeeze = bool(spec.get(4, 1))
        self.escape = bool(spec.get(5, 1))
        self.mark_last = bool(trainer.get(24, 0))
        self.space = (MARK if self.escape else " ").encode()
        bare = b"\x0a\x08identity\x18\x00\x20\x00\x28\x00"  # no prefix, no squeezing, no escaping
        self.segmenter = sentencepiece.SentencePieceProcessor(
            model_proto=b"".join(raw for number, _, raw in top if number != 3) + b"\x1a" + bytes([len(bare)]) + bare
        )
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bos, self.eos, self.unknown = self.library.bos_id(), self.library.eos_id(), self.library.unk_id()
        pieces = [{n: v for n, v, _ in fields(value)} for number, value, _ in top if number == 1]
        kinds = [p.get(3, 1) for p in pieces]
        texts = [p.get(1, b"") for p in pieces]
        #: Bytes of normalised text that a piece stands for; byte pieces: −1.
        self.lengths = np.array([-1 if k == 6 else len(t) for t, k in zip(texts, kinds)], np.int64)
        self.byte_of = {i: int(t[3:5], 16) for i, (t, k) in enumerate(zip(texts, kinds)) if k == 6}
        usual = [t.decode(errors="replace") for t, k in zip(texts, kinds) if k in (1, 4, 5)]
        self.protected = sorted((t for t, k in zip(texts, kinds) if k == 4), key=len, reverse=True)
        self.mark = self.space.decode()
        crossing = any(self.mark in t.lstrip(self.mark) for t in usual)
        self.blocks = not (crossing or self.protected or self.mark_last)
        self.cut = re.compile(f"(?<=[^{self.mark}]){self.mark}")
        #: Pieces of a mark and the word after it: (id, normalised bytes) pairs. Young and old words.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    # ---- normalisation --------------------------------------------------------------------------

    def _protected(self, source: bytes, at: int) -> int:
        return next((len(p) for p in self.protected if source.startswith(p, at)), 0)

    def _units(self, source: bytes) -> Iterator[tuple[int, int, bytes]]:
        """(begin, end, replacement) of stretches of the source; a stretch without rules comes whole."""
        special = self.map.first | {p[0] for p in self.protected}
        if not special:
            if source:
                yield 0, len(source), source
            return
        searched = re.compile(b"[" + re.escape(bytes(sorted(special))) + b"]")
        at = begun = 0
        while found := searched.search(source, at):
            at = found.start()
            kept = self._protected(source, at)
            rule = (kept, source[at : at + kept]) if kept else self.map.units and self.map.longest(source, at)
            if not rule:
                at += 1
                while at < len(source) and source[at] & 0xC0 == 0x80:
                    at += 1
                continue
            if begun < at:
                yield begun, at, source[begun:at]
            yield at, at + rule[0], rule[1]
            at = begun = at + rule[0]
        if begun < len(source):
            yield begun, len(source), source[begun:]

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised text, and for each of its bytes (and its end) the source byte it came from."""
        source = text.encode()
        if not source:
            return b"", np.zeros(1, np.int64)
        made: list[bytes] = []
        origin: list[np.ndarray] = []
        for begin, end, new in self._units(source):
            made.append(new)
            # A copied stretch maps byte by byte (a character's bytes to its first), a replacement to its start.
            if end - begin == len(new) and new == source[begin:end]:
                origin.append(np.arange(begin, end, dtype=np.int64))
            else:
                origin.append(np.full(len(new), begin))
        flat = np.frombuffer(b"".join(made), np.uint8)
        come = np.concatenate(origin) if origin else np.zeros(0, np.int64)
        raw = np.frombuffer(source, np.uint8)
        if len(come):
            # Within a multi-byte source character every byte belongs to the character's first byte.
            head = (raw & 0xC0) != 0x80
            if not head.all():
                come = np.maximum.accumulate(np.where(head, np.arange(len(raw)), 0))[come]
        end = len(source)
        if self.squeeze:
            space = flat == 32
            before = np.concatenate(([True], space[:-1])) if len(space) else space
            keep = ~(space & before)
            flat, come = flat[keep], come[keep]
            if len(flat) and flat[-1] == 32:
                end = int(come[-1])
                flat, come = flat[:-1], come[:-1]
        if not len(flat) and self.squeeze:
            return b"", np.zeros(1, np.int64)
        body = flat.tobytes()
        if self.escape:
            counts = np.where(flat == 32, len(self.space), 1)
            body, come = body.replace(b" ", self.space), np.repeat(come, counts)
        first = int(come[0]) if len(come) and self.squeeze else 0
        if self.dummy_prefix and not self.mark_last:
            body, come = self.space + body, np.concatenate((np.full(len(self.space), first), come))
        elif self.dummy_prefix:
            body, come = body + self.space, np.concatenate((come, np.full(len(self.space), end)))
        return body, np.append(come, end)

    # ---- segmentation ---------------------------------------------------------------------------

    def _lengths(self, block: str, ids: list[int]) -> np.ndarray:
        """Normalised bytes of each piece. Of a character spelt in byte pieces, the last holds all."""
        if self.unknown in ids:
            return np.array([len(p.encode()) for p in self.segmenter.encode(block, out_type=str)], np.int64)
        sizes = self.lengths[ids]
        if (sizes < 0).any():
            sizes = sizes.copy()
            i = 0
            while i < len(ids):
                if sizes[i] >= 0:
                    i += 1
                    continue
                head = self.byte_of[ids[i]]
                n = 1 if head < 0xC0 else 2 if head < 0xE0 else 3 if head < 0xF0 else 4
                sizes[i : i + n - 1] = 0
                sizes[i + n - 1] = n
                i += n
        return sizes

    def _segment(self, body: str) -> np.ndarray:
        """(id, normalised bytes) of each piece of a normalised text."""
        ids = self.segmenter.encode_as_numpy(body)
        sizes = self.lengths[ids]
        if (odd := (sizes < 0) | (ids == self.unknown)).any():
            if (ids == self.unknown).any():
                sizes = self._lengths(body, ids.tolist())
            else:  # runs of byte pieces
                edges = np.flatnonzero(np.diff(np.concatenate(([0], odd.view(np.int8), [0]))))
                for begin, end in edges.reshape(-1, 2).tolist():
                    sizes[begin:end] = self._lengths("", ids[begin:end].tolist())
        return np.column_stack((ids, sizes)).astype("<u4")

    def _learn(self, words: set[str]) -> None:
        """Segment new words in one text: no merge crosses from one to the next."""
        if len(self.known) > REMEMBERED // 2:
            self.older, self.known = self.known, {}
        # A block that ends in a mark would join the next one's.
        apart = {w for w in words if not w or w.endswith(self.mark)}
        self.known.update((w, self._segment(self.mark + w).tobytes()) for w in apart)
        if not (new := list(words - apart)):
            return
        pairs = self._segment(self.mark + self.mark.join(new))
        reach = np.cumsum(pairs[:, 1], dtype=np.int64)
        sizes = [len(w.encode()) + len(self.space) for w in new]
        stops = (8 * np.searchsorted(reach, np.cumsum(sizes), "right")).tolist()
        flat = pairs.tobytes()
        self.known.update((w, flat[a:b]) for w, a, b in zip(new, [0, *stops], stops))

    def _blocks(self, body: str) -> bytes:
        """Pieces of a normalised text, block by block, each looked up or learnt."""
        if self.mark * 2 in body:
            words = self.cut.split(body)
            if lead := body.startswith(self.mark):
                words[0] = words[0][len(self.mark) :]
        else:
            words = body.split(self.mark)
            if lead := not words[0]:
                del words[0]
        first = b"" if lead else self._segment(words.pop(0)).tobytes()
        found = list(map(self.known.get, words))
        if None in found:
            missing = {w for w, f in zip(words, found) if f is None}
            again = {w: f for w in missing if (f := self.older.get(w)) is not None}
            self.known.update(again)
            if missing := missing.difference(again):
                self._learn(missing)
            get, older = self.known.get, self.older
            found = [f or get(w) or older[w] for w, f in zip(words, found)]
            for w in missing:
                if len(w) > LONGEST_REMEMBERED:
                    del self.known[w]
        return first + b"".join(found)

    def _stretches(self, body: str) -> Iterator[str]:
        at = 0
        while len(body) - at > STRETCH and (found := self.cut.search(body, at + STRETCH)):
            yield body[at : found.start()]
            at = found.start()
        yield body[at:]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, begins and ends (source bytes) of the pieces of ``text``, without begin and end ids."""
        normalised, origin = self.normalise(text)
        body = normalised.decode()
        if not body:
            pairs = b""
        elif self.blocks:
            pairs = b"".join([self._blocks(part) for part in self._stretches(body)])
        else:
            pairs = self._segment(body).tobytes()
        ids, sizes = np.frombuffer(pairs, "<u4").reshape(-1, 2).T
        reach = np.cumsum(sizes, dtype=np.int64)
        return ids, origin[reach - sizes], origin[reach]


@lru_cache(maxsize=2)
def encoder(model: bytes) -> Encoder:
    return Encoder(model)


def encode(
    df: DataFrame, model_path: str, text: str = "text", *, add_bos: bool = True, add_eos: bool = True
) -> DataFrame:
    """Add ids, begins and ends of the pieces, and the text decoded from the ids.

    ``ids``, ``starts`` and ``ends`` are binary: little-endian unsigned 32-bit numbers, one per id; starts
    and ends are offsets into the UTF-8 source, end exclusive; the begin id spans nothing at 0, the end id
    nothing at the end. ``decoded`` is what the library decodes from all ids. Null texts count as empty;
    an empty text has the begin and end ids only. Texts are encoded whole, however long. Columns that
    already bear one of the four names are replaced, all others are kept; repeated rows stay repeated.
    The model's file is read where this is called and travels with the tasks.
    """
    with open(model_path, "rb") as file:
        model = file.read()
    kept = without(df, *[n for n, _ in ADDED])
    source = df.select(*[quoted(c) for c in kept.columns], df[quoted(text)].alias("\0text"))
    schema = T.StructType([*kept.schema.fields, *[T.StructField(n, t) for n, t in ADDED]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(model)
        for batch in batches:
            column, kept_columns = batch.column(batch.num_columns - 1), batch.columns[:-1]
            out: list[list] = [[], [], [], []]
            begun = size = 0

            def flush(end: int) -> pa.RecordBatch:
                new = [pa.array(v, pa.string() if i == 3 else pa.binary()) for i, v in enumerate(out)]
                same = [c.slice(begun, end - begun) for c in kept_columns]
                return pa.RecordBatch.from_arrays([*same, *new], names=schema.names)

            for i in range(len(column)):
                value = column[i].as_py() or ""
                ids, starts, ends = made.encode(value)
                last = len(value.encode())
                ids = np.concatenate(([made.bos] * add_bos, ids, [made.eos] * add_eos)).astype("<u4")
                out[0].append(ids.tobytes())
                out[1].append(np.concatenate(([0] * add_bos, starts, [last] * add_eos)).astype("<u4").tobytes())
                out[2].append(np.concatenate(([0] * add_bos, ends, [last] * add_eos)).astype("<u4").tobytes())
                out[3].append(made.library.decode(ids.astype(np.int32)))
                size += 12 * len(ids) + last
                if size > FLUSH:
                    yield flush(i + 1)
                    begun, size, out = i + 1, 0, [[], [], [], []]
            if out[0]:
                yield flush(len(column))

    return source.mapInArrow(run, schema)
