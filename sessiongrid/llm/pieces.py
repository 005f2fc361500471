"""SentencePiece encoding with byte offsets, and decoding, from an existing model file.

A text is normalised by the longest prefixes that the model's compiled character map knows; beside every normalised byte
stands the source byte it came from. The normalised text is cut before each run of space marks, which no piece of the
vocabulary crosses (checked when the model is read; else the text is one part), and each distinct part is merged once a
task: the pair with the best score first, then the leftmost. Characters without a piece become their bytes' pieces, or
the unknown id. Each piece is projected through the alignment to the bytes of the source text it stands for; bytes of one
character share its span.

Texts are worked on where they lie: nothing is shuffled, a lost task costs its own rows, and memory is bounded by one
text and PARTS_KEPT distinct parts.

Defined results: null and empty texts have no pieces; a null list of ids decodes to an empty text; a null id in a list is
left out; repeated rows are kept; columns named as an output are replaced. The model's path is read on the driver and its tables
are broadcast (their size is that of the vocabulary).
"""

from __future__ import annotations

import heapq
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sessiongrid.llm.texts import Shared, free_name, text_slices

MARK = "▁"
MARK_BYTES = MARK.encode()
PARTS_KEPT = 200_000
#: texts are worked on in pieces of about so many bytes
SLICE = 1 << 18
#: parts of more characters are merged one by one with a queue
LONG = 64
#: two ids or a rank and an id are one number
BITS = 24
LOW = (1 << BITS) - 1
NEVER = 1 << 62
# piece types and the merging model kind of the file format (fixed values)
NORMAL, UNKNOWN, CONTROL, BYTE, MERGES = 1, 2, 3, 6, 2
# surface of an unknown id in decoded text (fixed value)
UNKNOWN_TEXT = " ⁇ "


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of one message in protocol-buffer form."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = number(at)
        if key & 7 == 0:
            value, at = number(at)
        elif key & 7 == 2:
            size, at = number(at)
            value, at = data[at : at + size], at + size
        else:
            size = {1: 8, 5: 4}[key & 7]
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class CharacterMap:
    """The compiled map of a normaliser: a double-array trie over source bytes, then the replacement texts."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.texts = blob[4 + size :] if blob else b""

    def _child(self, unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement of the longest known prefix of ``data[at:]`` and its length."""
        if not self.units:
            return None
        units, best = self.units, None
        place = self._child(units[0])
        for i in range(at, len(data)):
            place ^= data[i]
            unit = units[place]
            if unit & 0x800000FF != data[i]:
                break
            place ^= self._child(unit)
            if unit >> 8 & 1:
                best = units[place] & 0x7FFFFFFF, i + 1 - at
        if best is None:
            return None
        return self.texts[best[0] : self.texts.index(b"\0", best[0])], best[1]


class Parts:
    """Parts of texts that were merged already: where each one's ids and byte bounds lie in flat arrays."""

    def __init__(self):
        self.rows: dict[str, int] = {}
        self.ids, self.begins, self.ends = array("i"), array("i"), array("i")
        self.first, self.size, self.width = array("q"), array("q"), array("q")

    def add(self, parts: list[str], ids: np.ndarray, begins: np.ndarray, ends: np.ndarray, size: np.ndarray, width: np.ndarray) -> None:
        first = len(self.ids) + np.cumsum(size) - size
        self.rows.update(zip(parts, range(len(self.rows), len(self.rows) + len(parts))))
        for name, values in (("ids", ids), ("begins", begins), ("ends", ends), ("first", first), ("size", size), ("width", width)):
            own = getattr(self, name)
            own.frombytes(values.astype(own.typecode).tobytes())


@dataclass
class PieceModel:
    """A vocabulary of pieces, its merges and its normaliser.

    ``pairs`` holds for two ids that may merge the rank of their merge (the least first) and the new id.
    """

    pairs: dict[int, int]
    widths: np.ndarray
    characters: np.ndarray
    surfaces: list[bytes]
    kinds: list[int]
    byte_ids: np.ndarray | None
    unknown: int
    map: CharacterMap
    prefix: bool
    squeeze: bool
    escape: bool
    parted: bool
    known: Parts = field(default_factory=Parts)

    def __post_init__(self):
        self.pair_keys = np.array(sorted(self.pairs) or [-1], np.int64)
        self.pair_values = np.array([self.pairs.get(k, NEVER) for k in self.pair_keys.tolist()], np.int64)

    def __getstate__(self):
        return {**self.__dict__, "known": Parts()}

    # normalisation

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them (and for the end) the byte of ``text`` it came from."""
        mark = MARK_BYTES if self.escape else b" "
        if not text:
            return b"", np.zeros(1, np.int64)
        if not self.map.units and not self.squeeze:
            source = np.frombuffer(text, np.uint8)
            space = source == 32
            align = np.repeat(np.arange(len(text), dtype=np.int64), np.where(space, len(mark), 1))
            head = len(mark) if self.prefix else 0
            return (mark if self.prefix else b"") + text.replace(b" ", mark), np.concatenate([np.zeros(head, np.int64), align, [len(text)]])
        out: list[bytes] = []
        origin: list[int] = []
        at, spaced, begun = 0, self.squeeze, False
        while at < len(text):
            found = self.map.longest(text, at)
            if found is None:
                step = next((n for lead, n in ((0xF0, 4), (0xE0, 3), (0xC0, 2)) if text[at] >= lead), 1)
                found = text[at : at + step], step
            piece, step = found
            if not begun and not (self.squeeze and piece == b" "):
                begun = True
                if self.prefix:
                    out.append(mark)
                    origin += [at] * len(mark)
            if spaced:
                piece = piece.lstrip(b" ")
            if piece:
                spaced = self.squeeze and piece.endswith(b" ")
                piece = piece.replace(b" ", mark)
                out.append(piece)
                origin += [at] * len(piece)
            at += step
        done = b"".join(out)
        end = len(text) if begun else 0
        while self.squeeze and done.endswith(mark):
            done = done[: -len(mark)]
            end = origin[len(done)]
        return done, np.array([*origin[: len(done)], end], np.int64)

    # pieces

    def _values(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank and new id of merging two ids, NEVER where they do not merge."""
        keys = (left << BITS) | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.pair_keys[at] == keys), self.pair_values[at], NEVER)

    def merged(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of many parts after all merges; in each round every part that can does its next one.

        ``owner`` is the part of each symbol, in order; characters without a piece are negative.
        """
        done: list[tuple[np.ndarray, np.ndarray]] = []
        value = np.full(len(symbols), NEVER)
        same = np.flatnonzero(owner[1:] == owner[:-1])
        value[same] = self._values(symbols[same], symbols[same + 1])
        while len(symbols):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            sizes = np.diff(np.append(starts, len(symbols)))
            rank = value >> BITS
            least = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            over = least == NEVER >> BITS
            if over.any():
                done.append((owner[over], symbols[over]))
                symbols, owner, value, rank, least = (c[~over] for c in (symbols, owner, value, rank, least))
            at = np.flatnonzero(rank == least)
            if not len(at):
                break
            at = at[np.append(True, owner[at][1:] != owner[at][:-1])]  # of equal scores the leftmost goes first
            symbols[at] = value[at] & LOW
            stays = np.ones(len(symbols), bool)
            stays[at + 1] = False
            symbols, owner, value = symbols[stays], owner[stays], value[stays]
            at -= np.arange(len(at))
            for left in (at, at[at > 0] - 1):
                inside = np.append(owner[1:] == owner[:-1], False)[left]
                value[left] = NEVER
                left = left[inside]
                value[left] = self._values(symbols[left], symbols[left + 1])
        if not done:
            return symbols, owner
        owner, symbols = (np.concatenate(c) for c in zip(*done))
        order = np.argsort(owner, kind="stable")
        return symbols[order], owner[order]

    def _merged_long(self, symbols: list[int]) -> list[int]:
        """The symbols of one part of many characters, by a queue of pairs."""
        pairs = self.pairs
        alive = [True] * len(symbols)
        after = [*range(1, len(symbols)), -1]
        before = list(range(-1, len(symbols) - 1))
        queue = []

        def offers(left: int, right: int) -> Iterator[tuple[int, int, int, int, int, int]]:
            if left >= 0 and right >= 0 and symbols[left] >= 0 and symbols[right] >= 0:
                pair = pairs.get(symbols[left] << BITS | symbols[right])
                if pair is not None:
                    yield pair >> BITS, left, right, pair & LOW, symbols[left], symbols[right]

        for i in range(len(symbols) - 1):
            queue += offers(i, i + 1)
        heapq.heapify(queue)
        while queue:
            _, i, j, merged, one, two = heapq.heappop(queue)
            if not alive[i] or not alive[j] or symbols[i] != one or symbols[j] != two or after[i] != j:
                continue
            symbols[i], alive[j] = merged, False
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for pair in (*offers(before[i], i), *offers(i, after[i])):
                heapq.heappush(queue, pair)
        return [s for s, here in zip(symbols, alive) if here]

    def learn(self, parts: list[str]) -> None:
        """Merge parts and add them to the known ones."""
        code = np.frombuffer("".join(parts).encode("utf-32-le"), "<u4").astype(np.int64)
        symbols = self.characters[code].astype(np.int64)
        symbols = np.where(symbols < 0, -1 - code, symbols)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        owner = np.repeat(np.arange(len(parts)), lengths)
        long = np.flatnonzero(lengths > LONG)
        found = [self.merged(symbols[lengths[owner] <= LONG], owner[lengths[owner] <= LONG])]
        first = np.cumsum(lengths) - lengths
        for part in long.tolist():
            one = np.array(self._merged_long(symbols[first[part] : first[part] + lengths[part]].tolist()))
            found.append((one, np.full(len(one), part)))
        symbols, owner = (np.concatenate(c) for c in zip(*found))
        order = np.argsort(owner, kind="stable")
        symbols, owner = symbols[order], owner[order]
        strange = symbols < 0
        code = np.where(strange, -1 - symbols, 0)
        width = np.where(strange, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000), self.widths[np.where(strange, 0, symbols)])
        ends = np.cumsum(width)
        begins = ends - width
        start = np.zeros(len(parts), np.int64)
        new = np.append(True, owner[1:] != owner[:-1])
        start[owner[new]] = begins[new]
        begins, ends = begins - start[owner], ends - start[owner]
        ids = np.where(strange, self.unknown, symbols)
        if self.byte_ids is not None and strange.any():
            copies = np.where(strange, width, 1)
            within = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
            ids, begins, ends, owner, code, width, strange = (np.repeat(c, copies) for c in (ids, begins, ends, owner, code, width, strange))
            lead = np.where(width == 1, 0, 0xFF00 >> width & 0xFF)  # 1100 0000, 1110 0000, 1111 0000
            byte = code >> 6 * (width - 1 - within) & np.where(within > 0, 0x3F, 0xFF) | np.where(within > 0, 0x80, lead)
            ids = np.where(strange, self.byte_ids[np.where(strange, byte, 0)], ids)
        size = np.bincount(owner, minlength=len(parts))
        wide = np.zeros(len(parts), np.int64)
        np.maximum.at(wide, owner, ends)
        self.known.add(parts, ids, begins, ends, size, wide)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of texts one after the other, the bytes of their own text from and to which each stands, and the number of ids of each text."""
        known = self.known
        if len(known.rows) > PARTS_KEPT:
            known = self.known = Parts()
        parts, n_parts, aligns, lengths = [], [], [], []
        for text in texts:
            normal, align = self.normalise(text)
            whole = normal.decode("utf-8", "replace")
            own = PARTS.findall(whole) if self.parted else [whole] if whole else []
            parts += own
            n_parts.append(len(own))
            aligns.append(align)
            lengths.append(len(align))
        unseen = list(set(parts).difference(known.rows))
        if unseen:
            self.learn(unseen)
        rows = np.fromiter(map(known.rows.__getitem__, parts), np.int64, len(parts))
        first, sizes, widths = (np.frombuffer(c, np.int64)[rows] for c in (known.first, known.size, known.width))
        # where each id lies in the table of known parts
        at = np.arange(sizes.sum()) + np.repeat(first - np.cumsum(sizes) + sizes, sizes)
        ids, begins, ends = (np.frombuffer(c, np.int32)[at] for c in (known.ids, known.begins, known.ends))
        # parts follow each other in the normalised text; the alignments have one more entry a text, for its end
        owner = np.repeat(np.arange(len(texts)), n_parts)
        base = np.repeat(np.cumsum(widths) - widths + owner, sizes)
        text_of = np.repeat(owner, sizes)
        counts = np.bincount(text_of, minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)
        align = np.concatenate(aligns) if aligns else np.zeros(0, np.int64)
        begins, ends = begins + base, ends + base
        if self.byte_ids is None and len(ids):  # runs of unknown characters that meet where parts meet
            new = np.append(True, (ids[1:] != self.unknown) | (ids[:-1] != self.unknown) | (text_of[1:] != text_of[:-1]))
            ids, begins, ends = ids[new], begins[new], ends[np.append(np.flatnonzero(new)[1:] - 1, len(ids) - 1)]
            counts = np.bincount(text_of[new], minlength=len(texts))
        return ids, align[begins], align[ends], counts

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no text become U+FFFD each."""
        kinds, surfaces, out = self.kinds, self.surfaces, []
        begun = False
        for i in ids:
            kind = kinds[i]
            if kind == CONTROL:
                continue
            surface = surfaces[i]
            if not begun and kind == NORMAL and (self.prefix or self.squeeze) and surface.startswith(b" "):
                surface = surface[1:]
                # one space mark goes; with squeezing the text has begun only when something is left
                begun = bool(surface) or not self.squeeze
            else:
                begun = begun or bool(surface)
            out.append(surface)
        joined = b"".join(out)
        try:
            return joined.decode()
        except UnicodeDecodeError:
            return re.sub("[\udc80-\udcff]", "�", joined.decode("utf-8", "surrogateescape"))


PARTS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def read_model(path: str) -> PieceModel:
    """The merging model in a file; user-defined and unused pieces and space marks as suffixes are refused."""
    with open(path, "rb") as file:
        data = file.read()
    rows, trainer, normaliser = [], {}, {}
    for number, value in fields(data):
        if number == 1:
            row = dict(fields(value))
            score = struct.unpack("<f", row[2])[0] if 2 in row else 0.0
            rows.append((row.get(1, b"").decode(), score, row.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(fields(value))
        elif number == 3:
            normaliser = dict(fields(value))
    if trainer.get(3, 1) != MERGES or trainer.get(24, 0):
        raise ValueError("the model must be a merging model with space marks before words")
    if {kind for _, _, kind in rows} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
        raise ValueError("user-defined and unused pieces are not supported")
    byte_ids = np.full(256, -1)
    surfaces = []
    for i, (piece, _, kind) in enumerate(rows):
        if kind == BYTE:
            byte_ids[int(piece[1:-1], 16)] = i
            surfaces.append(bytes([int(piece[1:-1], 16)]))
        else:
            surfaces.append(UNKNOWN_TEXT.encode() if kind == UNKNOWN else piece.replace(MARK, " ").encode())
    characters = np.full(0x110000, -1, np.int32)
    normal = {piece: i for i, (piece, _, kind) in enumerate(rows) if kind == NORMAL}
    order = {score: rank for rank, score in enumerate(sorted({rows[i][1] for i in normal.values()}, reverse=True))}
    pairs = {}
    for piece, i in normal.items():
        for cut in range(1, len(piece)):
            left, right = normal.get(piece[:cut]), normal.get(piece[cut:])
            if left is not None and right is not None:
                pairs[left << BITS | right] = order[rows[i][1]] << BITS | i
        if len(piece) == 1:
            characters[ord(piece)] = i
    return PieceModel(
        pairs, np.array([len(piece.encode()) for piece, _, _ in rows]), characters, surfaces, [kind for _, _, kind in rows], byte_ids if byte_ids.min() >= 0 else None,
        next((i for i, row in enumerate(rows) if row[2] == UNKNOWN), 0), CharacterMap(normaliser.get(2, b"")),
        bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1)), bool(normaliser.get(5, 1)),
        not any(MARK in piece.lstrip(MARK) for piece in normal),
    )


def encode(docs: DataFrame, model: PieceModel, text: str = "text", keep: list[str] | None = None, decoded: str | None = None) -> DataFrame:
    """Kept columns with ``ids`` and, for each id, ``begins`` and ``ends``: the bytes of the source text it stands for.

    ``decoded`` names a further column with the text that :func:`decode` gives for the ids, worked out in the same pass.
    """
    new = ["ids", "begins", "ends"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in [*new, decoded]]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(n, T.ArrayType(T.IntegerType())) for n in new])
    if decoded:
        schema.add(decoded, T.StringType())
    shared = Shared(docs.sparkSession, model)
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value
        for batch in batches:
            for first, last, data, offsets in text_slices(batch.column(len(kept)), SLICE):
                raw = data.tobytes()
                *found, counts = pieces.encode([raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())])
                stops = np.append(0, np.cumsum(counts)).astype(np.int32)
                columns = [batch.column(i).slice(first, last - first) for i in range(len(kept))]
                columns += [pa.ListArray.from_arrays(pa.array(stops), pa.array(f.astype(np.int32))).cast(out.field(n).type) for f, n in zip(found, new)]
                if decoded:
                    ids, bounds = found[0].tolist(), stops.tolist()
                    columns.append(pa.array([pieces.decode(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:])], out.field(decoded).type))
                yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias(free_name("__text", kept))).mapInArrow(run, schema)


def decode(encoded: DataFrame, model: PieceModel, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """All columns with the text of the list ``ids``."""
    kept = [c for c in encoded.columns if c != name]
    schema = T.StructType([encoded.schema[c] for c in kept] + [T.StructField(name, T.StringType())])
    shared = Shared(encoded.sparkSession, model)
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value
        for batch in batches:
            columns = [batch.column(i) for i in range(len(kept))]
            lists = batch.column(len(kept))
            texts = [pieces.decode([i for i in row.values.to_pylist() if i is not None] if row.is_valid else []) for row in lists]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, out.field(name).type)], names=out.names)

    return encoded.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{ids}`").alias(free_name("__ids", kept))).mapInArrow(run, schema)


def digest(encoded: DataFrame, keep: list[str]) -> DataFrame:
    """Number of ids, and hashes of the ids joined by commas and of the decoded text."""
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select(
        *keep, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
