"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The machine is compiled from a ``.model`` file in three parts.

* The normaliser maps characters: arcs for every rule of the model's character
  map, the longest that matches, all of weight 0; then spaces are collapsed, put
  in front and rewritten to U+2581 as the model says.
* The lexicon has an arc for every piece, which reads its characters, writes its
  id and costs minus its score in a unigram model and nothing in a merge model.
  A character that is no piece has an arc of its own, the dearest of all, that
  writes the byte pieces of its UTF-8 form (byte fallback) or the unknown id.
* The acceptor of a merge model reads pieces. Its states are the last piece; the
  arc to the next has weight 0 if merging their joint string, best piece first,
  ends in just these two, and infinity otherwise. A unigram model's has one state.

They are composed with each input on demand. A state of the composition is a
position in the normalised input and a state of the acceptor. The path of least
weight in the tropical semiring is found best first: states leave a queue by
their distance, the furthest position first among equals, until the end is
reached. In a merge model all finite paths weigh 0 and there is only one.

No piece holds U+2581 behind another character (checked at compile time), so no
arc crosses a word start, and each word is composed by itself and remembered;
in the same way a word falls apart between characters that no piece joins.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tarnfield.llm.superkmers import _parts
from tarnfield.plans.workspace import ship, tidy

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_UNITS = 200_000  # words remembered per worker, of late and before
_PAIRS = 400_000  # acceptor arcs, in the same way
_CHARS = 1 << 21  # numbers of pieces and characters stay below
# Fixed by the model format: kinds of pieces.
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_UNIGRAM, _MERGES = 1, 2
_UNKNOWN_COST = 10.0  # what an unknown character costs beyond the dearest piece


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a serialised message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            n = number() if tag & 7 == 2 else {1: 8, 5: 4}[tag & 7]
            yield tag >> 3, data[at : at + n]
            at += n


class _Recent(dict):
    """What was asked of late; values of ``make`` that fell out are kept for one more generation."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.before = make, most, {}

    def __missing__(self, key):
        got = self.before.get(key)
        if got is None:
            got = self.make(key)
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        self[key] = got
        return got


class _Arcs(dict):
    """Lengths of the pieces that may start where the next three characters are these, the longest first; 1 is always among them."""

    def __init__(self, pieces):
        super().__init__()
        self.pieces = frozenset(p for p in pieces if len(p) < 3)
        longer: dict[str, set[int]] = {}
        for p in pieces:
            if len(p) > 2:
                longer.setdefault(p[:3], set()).add(len(p))
        self.longer = longer

    def __missing__(self, start: str) -> tuple[int, ...]:
        two = {2} if len(start) > 1 and start[:2] in self.pieces else set()
        found = tuple(sorted(self.longer.get(start, set()) | two | {1}, reverse=True))
        if len(self) < _UNITS:
            self[start] = found
        return found


def _single(x: float) -> float:
    """Rounded to single precision, in which path weights are summed."""
    return struct.unpack("f", struct.pack("f", x))[0]


def character_map(blob: bytes) -> dict[str, str]:
    """The rules of a precompiled character map: a double array over UTF-8 bytes, then the strings that its leaves point to."""
    if not blob:
        return {}
    (size,) = struct.unpack("<I", blob[:4])
    units, strings = np.frombuffer(blob, np.uint32, size // 4, 4).astype(np.int64), blob[4 + size :]
    label, leaf = units & 0x800000FF, (units >> 8) & 1
    offset = (units >> 10) << ((units & 0x200) >> 6)
    rules, chars = {}, np.arange(1, 256)
    keys, base = [b""], offset[:1].copy()
    while len(base):  # all nodes of a level at once
        at = base[:, None] ^ chars
        valid = at < len(units)
        parent, c = np.nonzero(valid & (label[np.where(valid, at, 0)] == chars))
        node = at[parent, c]
        keys = [keys[i] + bytes([x + 1]) for i, x in zip(parent.tolist(), c.tolist(), strict=True)]
        base = node ^ offset[node]
        for i in np.flatnonzero(leaf[node]).tolist():
            start = int(units[base[i]] & 0x7FFFFFFF)
            rules[keys[i].decode()] = strings[start : strings.index(b"\0", start)].decode()
    return rules


class Normaliser:
    """The first machine: longest rules of the character map, then spaces."""

    def __init__(self, rules: dict[str, str], prefix: bool, collapse: bool, escape: bool):
        self.rules, self.prefix, self.collapse, self.escape = rules, prefix, collapse, escape
        self.widths: dict[str, list[int]] = {}
        for k in rules:
            own = self.widths.setdefault(k[0], [])
            if len(k) not in own:
                own.append(len(k))
        for own in self.widths.values():
            own.sort(reverse=True)

    def _mapped(self, text: str) -> str:
        out, at, widths, rules = [], 0, self.widths, self.rules
        while at < len(text):
            for w in widths.get(text[at], ()):
                if (to := rules.get(text[at : at + w])) is not None and at + w <= len(text):
                    out.append(to)
                    at += w
                    break
            else:
                out.append(text[at])
                at += 1
        return "".join(out)

    def __call__(self, text: str) -> str:
        if self.rules and not self.widths.keys().isdisjoint(text):
            text = self._mapped(text)
        if self.collapse:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        text = (" " if self.prefix else "") + text
        if not self.escape:
            return text
        text = text.replace(" ", SPACE)
        return text.rstrip(SPACE) if self.collapse else text


class Transducer:
    """The compiled machine."""

    def __init__(self, model: bytes):
        self.rank: dict[str, int] = {}  # of pieces that merging may build; the lower the earlier
        self.ids: dict[str, int] = {}
        self.bytes_: dict[int, int] = {}
        self.out: list[bytes] = []
        self.unknown, kind_of_model, rules = 0, _UNIGRAM, Normaliser({}, True, True, True)
        scores: dict[str, float] = {}
        users: list[str] = []
        for n, value in _fields(model):
            if n == 1:
                piece, score, kind = "", b"\0\0\0\0", _NORMAL
                for k, v in _fields(value):
                    piece, score, kind = (v.decode(), score, kind) if k == 1 else (piece, v, kind) if k == 2 else (piece, score, v) if k == 3 else (piece, score, kind)
                at = len(self.out)
                if kind in (_NORMAL, _USER):
                    self.ids[piece], scores[piece] = at, array("f", score)[0]
                    self.out.append(piece.replace(SPACE, " ").encode())
                    users += [piece] * (kind == _USER)
                elif kind == _BYTE:
                    self.bytes_[int(piece[3:5], 16)] = at
                    self.out.append(bytes([int(piece[3:5], 16)]))
                else:
                    self.unknown = at if kind == _UNKNOWN else self.unknown
                    self.out.append(b"" if kind == _CONTROL else b" \xe2\x81\x87 ")
            elif n == 2:
                spec = dict(_fields(value))
                kind_of_model = spec.get(3, _UNIGRAM)
                if kind_of_model not in (_UNIGRAM, _MERGES) or spec.get(24, 0):
                    raise ValueError("only unigram and merge models with spaces in front are compiled")
            elif n == 3:
                spec = dict(_fields(value))
                rules = Normaliser(character_map(spec.get(2, b"")), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1)))
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece crosses a word start")
        if users and kind_of_model == _MERGES:
            raise ValueError("merge models with pieces that users defined aren't compiled")
        self.normalise, self.prefix, self.merges = rules, rules.prefix, kind_of_model == _MERGES
        normal = [x for p, x in scores.items() if p not in users] or [0.0]
        # Lexicon weights; all arcs of a merge model are free.
        self.cost = dict.fromkeys(scores, 0.0) if self.merges else {p: -x for p, x in scores.items()} | {p: -_single(len(p.encode()) * max(normal) - 0.1) for p in users}
        self.dearest = 0.0 if self.merges else -_single(min(normal) - _UNKNOWN_COST)
        if min(self.cost.values(), default=0) < 0:
            raise ValueError("a piece has a positive score")
        self.rank = {p: i for i, p in enumerate(sorted(scores, key=lambda p: -scores[p]))}
        self.arcs = _Arcs(self.ids)
        self.glued = frozenset(p[i : i + 2] for p in self.ids for i in range(len(p) - 1))
        self.pieces = {i: p for p, i in self.ids.items()}
        self.joined: dict[int, bool] = _Recent(self._accepts, _PAIRS)
        self.units: dict[str, bytes] = _Recent(self._unit, _UNITS)
        self.is_byte = np.zeros(len(self.out), bool)
        self.is_byte[list(self.bytes_.values())] = True

    def _merged(self, text: str) -> list[str]:
        rank, none = self.rank.get, len(self.rank)
        parts = list(text)
        ranks = [rank(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] + parts[i], none)
            if i < len(ranks):
                ranks[i] = rank(parts[i] + parts[i + 1], none)
        return parts

    def _piece(self, number: int) -> str:
        return self.pieces[number] if number < len(self.out) else chr(number - len(self.out))

    def _accepts(self, arc: int) -> bool:
        """Whether the acceptor has an arc of weight 0 for the pair of pieces; the left one is ``_CHARS - 1`` at the start."""
        left, right = "" if arc // _CHARS == _CHARS - 1 else self._piece(arc // _CHARS), self._piece(arc % _CHARS)
        # A pair that is a piece itself merges on.
        return (not left or left + right not in self.rank) and self._merged(left + right) == ([left, right] if left else [right])

    def _shortest(self, unit: str) -> list[int]:
        """Numbers of the pieces along the path of least weight over one word, best first; of characters that are none, ``len(out)`` more than their code."""
        n, number, joined, arcs, cost, merges, chars = len(unit), self.ids.get, self.joined, self.arcs, self.cost, self.merges, len(self.out)
        # To each state of the composition (position, acceptor's state): its distance, where its last arc starts, from which state, reading what.
        begin = _CHARS - 1
        best = {(0, begin): (0.0, -1, None)}
        queue = [(0.0, 0, begin, 0)]  # distance, minus position, acceptor's state, next of its arcs
        while queue:
            far, at, last, turn = heappop(queue)
            at = -at
            if at == n:
                break
            state, widths = (at, last), arcs[unit[at : at + 3]]
            if not merges and far > best[state][0]:
                continue  # a shorter way here has been followed
            for i in range(turn, len(widths)):
                end = at + widths[i]
                if end > n:
                    continue
                piece = number(unit[at:end])
                if piece is None:
                    if widths[i] > 1:
                        continue
                    piece = chars + ord(unit[at])
                if merges:
                    if not joined[last * _CHARS + piece] or (end, piece) in best:
                        continue
                    best[end, piece] = (0.0, at, state)
                    if i + 1 < len(widths):
                        heappush(queue, (far, -at, last, i + 1))  # its other arcs wait: they weigh no less
                    heappush(queue, (far, -end, piece, 0))
                    break
                way = _single(far + cost.get(unit[at:end], self.dearest))
                old = best.get((end, begin))
                if old is None or (way, at) < old[:2]:  # of equal ones, that with the longer last piece
                    best[end, begin] = (way, at, state, piece)
                    heappush(queue, (way, -end, begin, 0))
        else:
            raise ValueError("no finite path")
        state, path = (n, last), []
        while state[0]:
            path.append(state[1] if merges else best[state][3])
            state = best[state][2]
        return path[::-1]

    def _written(self, path: list[int]) -> bytes:
        """What the lexicon writes along a path: ids, as 32-bit integers."""
        out, chars = array("i"), len(self.out)
        for piece in path:
            if piece < chars:
                out.append(piece)
            elif self.bytes_:
                out.extend([self.bytes_[b] for b in chr(piece - chars).encode()])
            else:
                out.append(self.unknown)
        return out.tobytes()

    def _unit(self, unit: str) -> bytes:
        """Ids of one word. No arc spans two neighbouring characters that no piece holds, so the word falls apart there."""
        glued = self.glued
        cuts = [i for i in range(1, len(unit)) if unit[i - 1 : i + 1] not in glued]
        if not cuts:
            return self._written(self._shortest(unit))
        return b"".join(self.units[unit[a:b]] for a, b in zip([0, *cuts], [*cuts, len(unit)], strict=True))

    def encode(self, text: str) -> array:
        """Piece ids of ``text``; none for an empty one. Unknown characters in turn write one unknown id."""
        ids = array("i", b"".join(map(self.units.__getitem__, _WORD.findall(self.normalise(text)))))
        if not self.bytes_ and self.unknown in ids:
            ids = array("i", [x for i, x in enumerate(ids) if x != self.unknown or not i or ids[i - 1] != x])
        return ids

    def forget(self) -> None:
        """Drops what has been remembered."""
        for held in (self.units, self.joined):
            held.clear()
            held.before = {}
        self.arcs.clear()

    def decode(self, ids) -> str:
        """The text of ``ids``, without the leading space that encoding adds."""
        out = self.out
        data = b"".join(map(out.__getitem__, ids))
        if self.prefix and data.startswith(b" "):
            data = data[1:]
        return data.decode("utf-8", "replace")


_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


@lru_cache(maxsize=2)
def _compiled(model: bytes) -> Transducer:
    return Transducer(model)


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_texts(docs: DataFrame, model: bytes, text: str = "text", decoded: bool = False) -> DataFrame:
    """``docs`` plus ``ids`` array<int> and, if asked for, ``decoded``, what these ids read back as.

    Null and empty texts have no ids; columns of these names are replaced.
    """
    ship(docs.sparkSession)
    made = ("ids", *["decoded"] * decoded)
    keep = [c for c in docs.columns if c not in made]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema] + ["ids array<int>", *["decoded string"] * decoded])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _compiled(model)
        for batch in (part for whole in batches for part in _parts(whole, text)):
            flat, ends, back = array("i"), [0], []
            for t in batch.column(text):
                ids = machine.encode(t.as_py() or "")
                flat.extend(ids)
                ends.append(len(flat))
                if decoded:
                    back.append(machine.decode(ids))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(memoryview(flat) if flat else [], pa.int32()))
            more = [pa.array(back, pa.string())] if decoded else []
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [ids, *more], names=[*keep, *made])
        machine.forget()

    return docs.mapInArrow(run, schema)


def decode_ids(rows: DataFrame, model: bytes, ids: str = "ids") -> DataFrame:
    """``rows`` plus ``decoded`` string; null ids decode to an empty text, a column of that name is replaced."""
    ship(rows.sparkSession)
    keep = [c for c in rows.columns if c != "decoded"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema] + ["decoded string"])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _compiled(model)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):  # so that few texts are held twice
                batch = whole.slice(at, 500)
                texts = [machine.decode(x.values.to_numpy().tolist() if x.is_valid else ()) for x in batch.column(ids)]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(texts, pa.string())], names=[*keep, "decoded"])

    return rows.mapInArrow(run, schema)


def document_pieces(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, n_pieces, n_byte_pieces, ids_sha256 (of 32-bit little-endian ids), decoded_sha256 and round_trip of every document.

    ``round_trip`` says whether decoding the ids gives the text again; it cannot
    where a text holds U+2581 itself, which reads back as a space. Null texts
    count as empty.
    """
    ship(docs.sparkSession)
    model = read_model(path)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _compiled(model)
        for batch in batches:
            n, n_bytes, ids_sha, text_sha, same = [], [], [], [], []
            for t in batch.column("text"):
                t = t.as_py() or ""
                ids = machine.encode(t)
                back = machine.decode(ids)
                n.append(len(ids))
                n_bytes.append(int(machine.is_byte[np.frombuffer(ids, np.int32)].sum()) if ids else 0)
                ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(back.encode()).hexdigest())
                same.append(back == t)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string()), pa.array(same, pa.bool_())],
                names=["doc_id", "n_pieces", "n_byte_pieces", "ids_sha256", "decoded_sha256", "round_trip"],
            )
        machine.forget()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_pieces long, n_byte_pieces long, ids_sha256 string, decoded_sha256 string, round_trip boolean")
