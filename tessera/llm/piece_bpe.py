"""Exact encoding and decoding with SentencePiece vocabularies of merge (BPE) type.

Merging by score gives, for any text, the one sequence of pieces in which every two neighbours stay apart when they
are merged afresh. So the sequence can be found from the left: take the longest piece at a place (Aho-Corasick), keep
it if it agrees with the piece before it, else the next shorter one, and go a piece back where none is left, marking
the place as failed so that it is never tried again. Work is linear in the text; agreement is looked up per pair.

A text is encoded unit by unit. Units end where no piece of the vocabulary holds the two characters that meet there,
so no merge can cross (checked when the vocabulary is read); units recur, and each worker keeps those it has met.
"""

from __future__ import annotations

import functools
import itertools
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import list_column, packed, text_blocks, text_column, unpacked

#: Units and pairs that a worker remembers (units: beside those of the text at hand); older ones are forgotten.
REMEMBERED = 1 << 18
SPACE = "▁"
_CONTROL = b"\xff\xff"
_LATIN = "A-Za-zÀ-ɏ"
#: Ways to cut a text, finest first, and the pairs of neighbouring characters that no piece may hold for it.
_CUTS = (
    (f"{SPACE}?[{_LATIN}]+|{SPACE}*[^{SPACE}{_LATIN}]+|{SPACE}+(?:[{_LATIN}]+)?", f"[{_LATIN}][^{_LATIN}]|[^{SPACE}{_LATIN}][{SPACE}{_LATIN}]"),
    (f"{SPACE}*[^{SPACE}]+|{SPACE}+", f"[^{SPACE}]{SPACE}"),
    ("(?s).+", "(?!)"),
)


class PieceCoder:
    """Encoder and decoder of one vocabulary file. Spaces are kept, and a text that is not empty gets one in front."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        if model.normalize(" a  ﬁ") != f"{SPACE}{SPACE}a{SPACE}{SPACE}ﬁ":
            raise ValueError(f"{path}: only vocabularies that keep texts as they are, with one space in front, are read")
        size = range(model.get_piece_size())
        if any(model.is_unused(i) for i in size):
            raise ValueError(f"{path}: vocabularies with unused pieces are not read")
        names = [model.id_to_piece(i) for i in size]
        plain = [i for i in size if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.ids = {names[i]: i for i in plain}
        self.scores = {names[i]: model.get_score(i) for i in plain}
        self.byte_ids = {int(names[i][3:5], 16): i for i in size if model.is_byte(i)}
        if len(self.byte_ids) != 256 or any(c not in self.ids for p in self.ids for c in p):
            raise ValueError(f"{path}: vocabularies without a piece for each byte, and for each character of their pieces, are not read")
        self.unknown = model.unk_id()
        #: The bytes each id stands for in a decoded text. A control id stands for none, but ends a run of byte pieces:
        #: its bytes are in no UTF-8, so that a text with such ids is read run by run.
        spelt = [_CONTROL if model.is_control(i) else bytes([int(names[i][3:5], 16)]) if model.is_byte(i) else names[i].replace(SPACE, " ").encode() for i in size]
        spelt[self.unknown] = " ⁇ ".encode()
        self.spelt, self.is_byte = spelt, [model.is_byte(i) for i in size]

        # a piece that its own characters do not merge into is never part of an encoding
        made = {p: self._merged(p) for p in self.ids if len(p) > 1}
        reachable = [p for p in self.ids if len(p) == 1 or made[p][0] == [p]]
        self._edges({p: made[p][1] for p in reachable if len(p) > 1})
        # pieces of an encoding go by their numbers in this list: lengths, the next shorter piece each begins with, ids
        self.parts = reachable
        number = {p: k for k, p in enumerate(reachable)}
        self.lengths = [len(p) for p in reachable]
        self.shorter = [next((number[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in number), None) for p in reachable]
        self.part_ids = [self.ids[p] for p in reachable]
        self.single = {p: k for p, k in number.items() if len(p) == 1}
        self.endings = ahocorasick.Automaton()  # over texts read backwards: what ends there starts here
        for p in reachable:
            if len(p) > 1:
                self.endings.add_word(p[::-1], number[p])
        self.endings.make_automaton()
        self.unit = next(re.compile(cut) for cut, held in _CUTS if not any(re.search(held, p) for p in self.ids))
        self.known: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by the merges themselves: the best score first, the leftmost of equal ones."""
        return self._merged(text)[0]

    def _merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """The pieces, and the two parts that were merged last."""
        parts, scores, last = list(text), self.scores, None
        while len(parts) > 1:
            best = max(((scores[a + b], -k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in scores), default=None)
            if best is None:
                break
            k = -best[1]
            last = parts[k], parts[k + 1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts, last

    def _edges(self, halves: dict[str, tuple[str, str]]) -> None:
        """For each piece, what stands at its right and left edge while it is merged, with the score that ends it.

        Only of pieces all of whose merges come in falling order of score, as their parts' scores show: there merges on
        both sides of a border happen in the order of their scores. Other pieces have no edges here.
        """
        self.right: dict[str, list[tuple[str, float]]] = {}
        self.left: dict[str, list[tuple[str, float]]] = {}
        for p in sorted(halves, key=len):
            a, b = halves[p]
            if all(len(x) == 1 or x in self.right and self.scores[x] > self.scores[p] for x in (a, b)):
                self.right[p] = [*self.right.get(b, ()), (b, self.scores[p])]
                self.left[p] = [*self.left.get(a, ()), (a, self.scores[p])]

    def agree(self, left: int, right: int) -> bool:
        """Whether two pieces stay apart when their characters are merged together."""
        if len(self.pairs) >= REMEMBERED:
            self.pairs.clear()
        found = self.pairs[left << 32 | right] = self._agree(self.parts[left], self.parts[right])
        return found

    def _agree(self, left: str, right: str) -> bool:
        if len(left) > 1 and left not in self.right or len(right) > 1 and right not in self.left:
            return self.merged(left + right) == [left, right]
        scores, never = self.scores, float("-inf")
        ends, starts = iter(self.right.get(left, ())), iter(self.left.get(right, ()))
        (x, until_x), (y, until_y) = next(ends, (left, never)), next(starts, (right, never))
        while True:
            across = scores.get(x + y)
            if across is not None and (across > until_x or until_x == never) and (across >= until_y or until_y == never):
                return False
            if until_x == until_y == never:
                return True
            if until_x >= until_y:
                x, until_x = next(ends, (left, never))
            else:
                y, until_y = next(starts, (right, never))

    def pieces(self, unit: str) -> list[str]:
        """The pieces of a unit; characters outside the vocabulary are pieces of their own."""
        at, out = 0, []
        for part in self._backtrack(unit):
            out.append(unit[at] if part < 0 else self.parts[part])
            at += len(out[-1])
        return out

    def _backtrack(self, unit: str) -> list[int]:
        """The numbers of a unit's pieces; -1 for a character that is in no piece, next to which all pieces stay apart."""
        n, lengths, parts = len(unit), self.lengths, self.single
        longest = [parts.get(c, -1) for c in unit]
        seen = n
        for end, part in self.endings.iter(unit[::-1]):
            if end != seen:  # the longest of an end comes first
                seen = end
                longest[n - 1 - end] = part
        failed = 0  # a bit for each place from which the rest cannot be encoded
        taken: list[int] = []
        last, at, known, shorter = -1, 0, self.pairs.get, self.shorter
        piece = longest[0] if n else None
        while at < n:
            while piece is not None:
                end = at + (lengths[piece] if piece >= 0 else 1)
                if not failed or not failed >> end & 1:
                    if last < 0 or piece < 0:
                        break
                    apart = known(last << 32 | piece)
                    if apart or apart is None and self.agree(last, piece):
                        break
                piece = shorter[piece] if piece >= 0 else None
            if piece is not None:
                taken.append(piece)
                last, at = piece, end
                if at < n:
                    piece = longest[at]
            elif not taken:
                raise ValueError(f"no sequence of pieces merges into {unit[:80]!r}")
            else:
                failed |= 1 << at
                piece = taken.pop()
                at -= lengths[piece] if piece >= 0 else 1
                last = taken[-1] if taken else -1
        return taken

    def unit_ids(self, unit: str) -> bytes:
        taken, ids = self._backtrack(unit), self.part_ids
        if -1 not in taken:
            return array("i", [ids[k] for k in taken]).tobytes()
        out, at = array("i"), 0
        for part in taken:  # characters outside the vocabulary go by their bytes
            if part < 0:
                out.extend(self.byte_ids[b] for b in unit[at].encode())
            else:
                out.append(ids[part])
            at += self.lengths[part] if part >= 0 else 1
        return out.tobytes()

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, as the library's ``encode`` gives them without begin and end ids."""
        if not text:
            return np.zeros(0, dtype=np.int32)
        if len(self.known) >= REMEMBERED // 2:
            self.earlier, self.known = self.known, {}
        units = self.unit.findall(SPACE + text.replace(" ", SPACE))
        known, earlier = self.known, self.earlier
        for unit in set(units).difference(known):
            known[unit] = earlier.get(unit) or self.unit_ids(unit)
        out = b"".join(map(known.__getitem__, units))
        if len(known) > REMEMBERED:  # one text with very many units
            known.clear()
        return np.frombuffer(out, dtype=np.int32)

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids, as the library's ``decode`` gives it: one leading space goes, broken bytes become U+FFFD.

        The space goes that the first piece begins with (control ids do not count); a byte piece keeps its own.
        """
        spelt = self.spelt
        ids = ids if isinstance(ids, list) else list(ids)
        raw = b"".join([spelt[i] for i in ids])
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            runs = itertools.groupby(ids, lambda i: spelt[i] is _CONTROL)
            text = "".join(_lenient(b"".join([spelt[i] for i in run])) for control, run in runs if not control)
        if text[:1] == " ":
            first = next(i for i in ids if spelt[i] is not _CONTROL)
            if not self.is_byte[first] and first != self.unknown:
                text = text[1:]
        return text


def _lenient(raw: bytes) -> str:
    """UTF-8 with U+FFFD for every single byte that does not belong to a whole character."""
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode())
            break
        except UnicodeDecodeError as e:
            out.append(raw[at : at + e.start].decode() + "\N{REPLACEMENT CHARACTER}")
            at += e.start + 1
    return "".join(out)


@functools.lru_cache(maxsize=2)
def coder(path: str) -> PieceCoder:
    """One for each vocabulary in a worker process."""
    return PieceCoder(path)


def encode_pieces(docs: DataFrame, path: str, column: str = "text", decoded: str | None = None) -> DataFrame:
    """``docs`` with ``ids``: the ids of the whole text under the vocabulary at ``path``, which every executor can read.

    With ``decoded``, a column of that name also has the text decoded from those ids. A null or empty text has no ids
    and decodes to an empty one. Repeated rows stay, each with its ids; an empty table stays empty; columns of ``docs``
    named like the new ones are replaced, all others stay as they are. Nothing is shuffled.
    """
    rows = docs.drop("ids", *([decoded] if decoded else []))
    kept = rows.select(packed(rows).alias("row"), text_column(docs, column).alias("text"))
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType(), False)), *([T.StructField("decoded", T.StringType())] if decoded else [])]
    schema = T.StructType([kept.schema["row"], *fields])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = coder(path)
        for part, _, _ in text_blocks(batches):
            ids = [both.encode(t) for t in part.column(part.schema.get_field_index("text")).to_pylist()]
            counts = np.array([len(i) for i in ids], dtype=np.int64)
            columns = [part.column(part.schema.get_field_index("row")), list_column(np.concatenate(ids), counts, pa.int32())]
            if decoded:
                columns.append(pa.array([both.decode(i.tolist()) for i in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    out = kept.mapInArrow(encode, schema)
    return out.select(*unpacked("row", rows.columns), "ids", *([F.col("decoded").alias(decoded)] if decoded else []))


def decode_pieces(rows: DataFrame, path: str, column: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the text that the ids in ``column`` stand for (null ids: null; none: empty).

    Ids outside the vocabulary and null elements fail, as in the library. A column named as ``out`` is replaced.
    """
    kept = rows.drop(out)
    paired = kept.select(packed(kept).alias("row"), rows[column].cast("array<int>").alias("ids"))
    schema = T.StructType([paired.schema["row"], T.StructField("text", T.StringType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = coder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [None if ids is None else decoder.decode(ids) for ids in part.column(part.schema.get_field_index("ids")).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("row")), pa.array(texts, pa.string())], names=["row", "text"])

    return paired.mapInArrow(decode, schema).select(*unpacked("row", kept.columns), F.col("text").alias(out))
