"""SentencePiece encoding and decoding as a streaming Viterbi over backpointers.

The model is a merge (BPE) model: a piece is valid after another only if the
merges would leave the two side by side. For every end position exactly one
piece is the last of the prefix's encoding, so the lattice has one surviving
backpointer a position, and the encoder walks the text once, left to right:

* at a position it tries the pieces that end there, longest first, and keeps
  the first that is valid after the last piece of the prefix before it;
* it keeps backpointers for a window only. A piece is at most ``max_piece``
  long, so later pieces can only start in the last ``max_piece`` positions.
  Once the backpointer paths of all of these run through one boundary, the
  ids up to it are committed and their backpointers dropped;
* no piece holds a space mark after another character, nor a character that
  the vocabulary lacks, so there the paths converge at once. The stretches
  between such places are walked many at a time, in step, and remembered in a
  table of bounded size.

Ids equal those of the ``sentencepiece`` library. Characters outside the
vocabulary become byte pieces; decoding returns the text exactly, but for
U+2581, which the model's format itself cannot tell from a space.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held, prepare, read

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
STRETCH = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
REMEMBERED, LONGEST_REMEMBERED, PAIRS = 500_000, 24, 2_000_000
#: Stretches up to this length are walked in step, longer ones one at a time.
IN_STEP = 128
#: A character that no piece holds.
FOREIGN = "\U0010ffff"


def load(model_file: str = MODEL) -> dict:
    """Pieces, scores and byte pieces of a model file; about 1 MB."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = range(p.get_piece_size())
    plain = [i for i in ids if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
    return {
        "pieces": {p.id_to_piece(i): i for i in plain},
        "scores": {i: p.get_score(i) for i in plain},
        "bytes": {int(p.id_to_piece(i)[1:-1], 16): i for i in ids if p.is_byte(i)},
        "unknown": p.unk_id(),
        "size": p.get_piece_size(),
    }


class Trie:
    """All pieces as one trie in flat tables, walked from many positions at once.

    An edge's key is its node and character, so a look-up is exact. Edges stand
    in an open-addressing table of at least four slots an edge.
    """

    def __init__(self, ids: dict[str, int]):
        child: dict[int, int] = {}
        piece = [-1]
        for text, i in ids.items():
            node = 0
            for c in text:
                key = node << 21 | ord(c)
                if key not in child:
                    child[key] = len(piece)
                    piece.append(-1)
                node = child[key]
            piece[node] = i
        self.piece = np.array(piece, np.int32)
        self.table = Pairs(max(2, (4 * len(child)).bit_length()))
        self.table.put(np.fromiter(child.keys(), np.int64, len(child)), np.fromiter(child.values(), np.int32, len(child)))

    def found(self, points: np.ndarray, most: int) -> list[np.ndarray]:
        """At n - 1: for every position the piece of the n characters from it on, else -1."""
        out = [np.full(len(points), -1, np.int32) for _ in range(most)]
        at, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        for n in range(most):
            node = self.table.get(node << 21 | points[at + n]).astype(np.int64)
            ok = node >= 0
            at, node = at[ok], node[ok]
            out[n][at] = self.piece[node]
            ok = at + n + 1 < len(points)
            at, node = at[ok], node[ok]
            if not len(at):
                break
        return out


class Pairs:
    """A growing table from keys of 63 bits to small numbers; -1 where there is none."""

    def __init__(self, bits: int):
        self.bits, self.n = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Where each key stands, or the free slot where it would."""
        slot = ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        there = self.keys[slot]
        todo = np.flatnonzero((there != keys) & (there >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[todo]]
            todo = todo[(there != keys[todo]) & (there >= 0)]
        return slot

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self.slots(keys)
        return np.where(self.keys[slot] == keys, self.values[slot], -1)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add distinct keys that are not there yet."""
        while (self.n + len(keys)) * 2 > 1 << self.bits:
            old, was = self.keys, self.values
            self.__init__(self.bits + 1)
            self.put(old[old >= 0], was[old >= 0])
        while len(keys):  # several keys may want one slot: the first takes it, the others look again
            slot = self.slots(keys)
            first = np.unique(slot, return_index=True)[1]
            self.keys[slot[first]], self.values[slot[first]] = keys[first], values[first]
            self.n += len(first)
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values = keys[rest], values[rest]


class Codec:
    """Encoder and decoder of one model."""

    def __init__(self, model: dict):
        self.ids, self.scores, self.bytes = model["pieces"], model["scores"], model["bytes"]
        self.unknown = model["unknown"]
        self.max_piece = max(map(len, self.ids), default=1)
        self.text = {i: p for p, i in self.ids.items()}
        out = [b""] * model["size"]
        for p, i in self.ids.items():
            out[i] = p.replace(MARK, " ").encode()
        for b, i in self.bytes.items():
            out[i] = bytes([b])
        self.out = out
        self.trie = Trie(self.ids)
        self.score = np.zeros(model["size"])
        for i, x in self.scores.items():
            self.score[i] = x
        # The merges: pairs of pieces that are a piece together. None if a piece's character is no piece.
        whole = all(c in self.ids for p in self.ids for c in p)
        self.single = {i: [self.ids[c] for c in p] for p, i in self.ids.items()} if whole else None
        joined = {self.ids[p[:k]] << 31 | self.ids[p[k:]]: i for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids}
        self.joined = Pairs(16)
        self.joined.put(np.fromiter(joined.keys(), np.int64, len(joined)), np.fromiter(joined.values(), np.int32, len(joined)))
        self.valid = Pairs(16)
        self.tried: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """The merges themselves, on a short text: best score first, then leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for j in range(len(parts) - 1):
                i = self.ids.get(parts[j] + parts[j + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], j
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, a: int, b: int) -> bool:
        """May piece b come right after piece a?"""
        ok = self.tried.get((a, b))
        if ok is None:
            if len(self.tried) > PAIRS:
                self.tried.clear()
            x, y = self.text[a], self.text[b]
            ok = self.tried[a, b] = self.merged(x + y) == [x, y]
        return ok

    def stay(self, keys: np.ndarray) -> np.ndarray:
        """1 for each pair of pieces that the merges leave side by side; all pairs merged in step."""
        pairs = list(zip((keys >> 31).tolist(), (keys & 0x7FFFFFFF).tolist()))
        if self.single is None or len(pairs) < 256:
            return np.array([self.merged(self.text[a] + self.text[b]) == [self.text[a], self.text[b]] for a, b in pairs], np.int32)
        parts = [self.single[a] + self.single[b] for a, b in pairs]
        n = np.array([len(x) for x in parts])
        row = np.repeat(np.arange(len(parts)), n)
        now = np.full((len(parts), max(3, n.max())), -1, np.int64)
        now[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = [i for x in parts for i in x]
        todo, at = np.arange(len(parts)), np.arange(now.shape[1] - 1)
        while True:
            left, right = now[todo, :-1], now[todo, 1:]
            into = self.joined.get(np.where(right < 0, -2, left << 31 | right).ravel()).reshape(left.shape)
            score = np.where(into < 0, -np.inf, self.score[into])
            j = score.argmax(1)  # of equal scores the leftmost
            some = score.max(1) > -np.inf
            todo, j, into = todo[some], j[some], into[some]
            if not len(todo):
                break
            new = np.take_along_axis(now[todo], at + (at > j[:, None]), 1)
            new[np.arange(len(todo)), j] = into[np.arange(len(todo)), j]
            now[todo, :-1], now[todo, -1] = new, -1
        return ((now[:, 0] == keys >> 31) & (now[:, 1] == (keys & 0x7FFFFFFF)) & (now[:, 2] < 0)).astype(np.int32)

    def follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The same of many pairs; ids under 0 are foreign characters or a start."""
        ok = (a < 0) | (b < 0)
        at = np.flatnonzero(~ok)
        keys = a[at].astype(np.int64) << 31 | b[at]
        known = self.valid.get(keys)
        new = np.unique(keys[known < 0])
        if len(new):
            if self.valid.n > PAIRS:
                self.valid = Pairs(16)
            values = np.concatenate([self.stay(new[lo : lo + 32768]) for lo in range(0, len(new), 32768)])
            self.valid.put(new, values)
            lost = np.flatnonzero(known < 0)
            known[lost] = values[np.searchsorted(new, keys[lost])]
        ok[at] = known == 1
        return ok

    def stretches(self, parts: list[str]) -> list[bytes]:
        """Ids of many stretches at once, all walked left to right in step.

        At step ``end`` each stretch that is as long gets the one valid last
        piece of its prefix. Its end is a boundary that every path runs
        through, so there its ids are committed.
        """
        most = self.max_piece
        size = np.array([len(p) for p in parts])
        order = np.argsort(-size, kind="stable")
        start = (np.cumsum(size + 1) - size - 1)[order]  # a foreign mark ends each
        points = np.frombuffer((FOREIGN.join(parts) + FOREIGN).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        found = self.trie.found(points, most)
        last, length = np.full(len(points), -1, np.int64), np.ones(len(points), np.int64)
        for end in range(1, int(size.max(initial=0)) + 1):
            open_ = start[: np.searchsorted(-size[order], -end, "right")]
            for n in range(min(most, end), 0, -1):
                piece = found[n - 1][open_ + (end - n)]
                some = np.flatnonzero(piece >= 0)
                if len(some):
                    at, piece = open_[some], piece[some].astype(np.int64)
                    before = last[at + (end - n - 1)] if n < end else np.full(len(at), -1)
                    ok = self.follow(before, piece)
                    last[at[ok] + end - 1], length[at[ok] + end - 1] = piece[ok], n
                    left = np.ones(len(open_), bool)
                    left[some[ok]] = False
                    open_ = open_[left]
            assert (found[0][open_ + end - 1] < 0).all(), "no piece is valid here"
        # Back along the pointers, all stretches in step again; then forwards.
        mine = np.zeros(len(points), bool)
        at, low = start + size[order] - 1, start
        while len(at):
            mine[at] = True
            at = at - length[at]
            ok = at >= low
            at, low = at[ok], low[ok]
        out: list[bytes] = []
        where = np.flatnonzero(mine)
        ids = last[where]
        count = np.add.reduceat(mine, np.sort(start), dtype=np.int64) if len(parts) else np.empty(0, np.int64)
        if (ids < 0).any():  # foreign characters: their bytes' ids
            wide = [[i] if i >= 0 else self.foreign(chr(points[w])) for i, w in zip(ids.tolist(), where.tolist())]
            part = np.repeat(np.arange(len(parts)), count)
            count = np.bincount(part, weights=[len(x) for x in wide], minlength=len(parts)).astype(np.int64)
            ids = np.array([i for x in wide for i in x], np.int64)
        flat, ends = ids.astype(np.int32).tobytes(), (4 * np.cumsum(count)).tolist()
        for lo, hi in zip([0, *ends], ends):
            out.append(flat[lo:hi])
        return out

    def foreign(self, c: str) -> list[int]:
        return [self.bytes[b] for b in c.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]

    def stream(self, text: str) -> Iterator[int]:
        """Ids of one long ``text``, committed as the backpointer paths converge."""
        ids, most = self.ids, self.max_piece
        base = 0  # everything before it is committed
        last, size = [], []  # at j: the piece that ends at base + j + 1, and its length
        before = -1  # the last committed piece
        due = 2 * most
        for end in range(1, len(text) + 1):
            for n in range(min(most, end - base), 0, -1):
                piece = ids.get(text[end - n : end])
                if piece is None:
                    if n > 1:
                        continue
                    piece = -1 - ord(text[end - 1])
                start = end - n - base
                previous = last[start - 1] if start else before
                if previous < 0 or piece < 0 or self.follows(previous, piece):
                    last.append(piece)
                    size.append(n)
                    break
            else:
                raise AssertionError("no piece is valid here")
            if len(last) >= due:
                # The paths of the last max_piece boundaries, walked back until one is left.
                live = set(range(len(last) - most + 1, len(last) + 1))
                while len(live) > 1:
                    top = max(live)
                    live.remove(top)
                    live.add(top - size[top - 1])
                meet = live.pop()
                if meet:
                    yield from self.path(last, size, meet)
                    before = last[meet - 1]
                    base += meet
                    del last[:meet], size[:meet]
                due = 2 * max(most, len(last))
        yield from self.path(last, size, len(last))

    def path(self, last: list[int], size: list[int], end: int) -> list[int]:
        back = []
        while end:
            piece = last[end - 1]
            if piece >= 0:
                back.append(piece)
            elif self.bytes:
                back += [self.bytes[b] for b in reversed(chr(-1 - piece).encode())]
            else:
                back.append(self.unknown)
            end -= size[end - 1]
        return back[::-1]

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of every text; what is not remembered is encoded once."""
        known = self.known
        cut_up = [STRETCH.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = list({p for parts in cut_up for p in parts if p not in known})
        short = [p for p in new if len(p) <= IN_STEP]
        got = {p: np.fromiter(self.stream(p), np.int32).tobytes() for p in new if len(p) > IN_STEP}
        for lo in range(0, len(short), 1 << 15):
            part = short[lo : lo + (1 << 15)]
            got.update(zip(part, self.stretches(part)))
        known.update(got)
        out = [np.frombuffer(b"".join([known[p] for p in parts]), np.int32) for parts in cut_up]
        if len(known) > REMEMBERED:
            known.clear()
        else:
            for p in got:
                if len(p) > LONGEST_REMEMBERED:
                    del known[p]
        return out

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.out.__getitem__, ids.tolist()))
        return raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace")


def codec_of(no: str, model: dict) -> Codec:
    """This process's codec of a model: what it remembers serves later tasks."""
    return held(f"codec {no}", lambda: Codec(model))


def encode_decode(docs: DataFrame, model_file: str = MODEL, text_col: str = "text") -> DataFrame:
    """Every row with ``n_tokens int, ids array<int>, decoded_sha256 string, round_trip boolean``.

    ``decoded_sha256`` is of the text decoded from the ids. A null text is
    encoded as an empty one, which has no ids; a text of any length is encoded
    whole; an empty table stays empty. Columns of these names are replaced;
    all others stay, ``text_col`` included. One pass, no shuffle.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(load(model_file))
    no = uuid.uuid4().hex
    keep = [c for c in docs.columns if c not in ("n_tokens", "ids", "decoded_sha256", "round_trip")]
    docs = docs.select(keep)
    schema = T.StructType(docs.schema.fields + [T.StructField("n_tokens", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded_sha256", T.StringType()), T.StructField("round_trip", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(no, shared.value)
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                shas, same = [], []
                texts = part.column(keep.index(text_col)).to_pylist()
                ids = codec.encode_all(texts)
                for text, got in zip(texts, ids):
                    back = codec.decode(got)
                    shas.append(hashlib.sha256(back.encode()).hexdigest())
                    same.append(back == (text or ""))
                n = np.array([len(x) for x in ids], np.int32)
                flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n), lists, pa.array(shas), pa.array(same)], names=[*keep, "n_tokens", "ids", "decoded_sha256", "round_trip"])

    return docs.mapInArrow(run, schema)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_decode(docs).select("doc_id", "n_tokens", "ids", "decoded_sha256", "round_trip")
