"""SentencePiece encoding and decoding as shortest paths in a transducer.

``Transducer`` compiles a model file once: the normaliser (dummy prefix, space
to its visible form), the pieces as a trie over characters, and byte fallback
for characters that no piece covers.  An input is composed with it as a lattice:
arcs are the pieces that spell a span of the input, and the encoding is the path of
least weight (tropical semiring: add along a path, take the least).

* unigram models: an arc weighs minus its piece's score;
* BPE models: an arc weighs nothing, and joining two arcs weighs infinity unless
  merging the text of both gives just these two pieces.  Exactly one path is
  finite, the one that merging the whole input gives.

Inputs are cut where no piece can reach across (before a run of visible spaces,
and between two characters that no piece holds side by side), which changes
no path; equal cuts of a batch are solved once, all cuts side by side in numpy.

Rows: null text gives null ids, an empty text no ids; the decoder turns null
into null.  Texts of any length are cut as above and never as a
prefix; memory follows their characters, time for text without any cut too (about
0.5 ms a character, so such a text of 1 MB takes minutes).  U+2581 in a text decodes as a space, as the format has it.  Repeated
rows are coded each; an empty table gives no rows.  Other columns are ignored
by ``encode``/``decode``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from citeweave.llm.frames import quoted, schema_with
from citeweave.llm.words import HashIndex, ranges, slices, span_hash, text_bytes
from citeweave.session import ship_package

TOKENIZERS = "/opt/tokenizers"
_SPACE = 0x2581
_UNIGRAM, _BPE = 1, 2
_WIDTHS = (16, 64, 512)   # then by powers of two
_loaded: dict = {}


class _Pairs:
    """Which two pieces may follow each other under BPE; answers are kept."""

    KEEP = 4_000_000

    def __init__(self, pieces: dict[str, tuple[int, float]], text: list[str]):
        self.rank = {p: s for p, (_, s) in pieces.items()}
        self.text = text
        self._reset()

    def _reset(self):
        self.keys, self.good = np.zeros(0, np.uint64), np.zeros(0, bool)
        self.index = HashIndex(self.keys)
        self.new_keys, self.new_good = np.zeros(0, np.uint64), np.zeros(0, bool)
        self.new_index = HashIndex(self.new_keys)

    def merged(self, text: str) -> list[str]:
        """Merge neighbours by best score, leftmost on ties, until none fits."""
        out = list(text)
        while True:
            best, at = None, -1
            for i in range(len(out) - 1):
                score = self.rank.get(out[i] + out[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return out
            out[at:at + 2] = [out[at] + out[at + 1]]

    def may_follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        at = self.index.find(keys)
        ok = np.zeros(len(keys), dtype=bool)
        known = at >= 0
        ok[known] = self.good[at[known]]
        if not known.all():
            rest = np.flatnonzero(~known)
            at = self.new_index.find(keys[rest])
            if (at < 0).any():
                fresh = np.unique(keys[rest[at < 0]])
                answers = [self.merged(self.text[k >> 32] + self.text[k & 0xFFFFFFFF])
                           == [self.text[k >> 32], self.text[k & 0xFFFFFFFF]] for k in fresh.tolist()]
                self.new_keys = np.concatenate([self.new_keys, fresh])
                self.new_good = np.concatenate([self.new_good, np.array(answers, dtype=bool)])
                self.new_index = HashIndex(self.new_keys)
                at = self.new_index.find(keys[rest])
            ok[rest] = self.new_good[at]
            if len(self.new_keys) > 4096:
                if len(self.keys) > self.KEEP:
                    self._reset()
                else:
                    self.keys = np.concatenate([self.keys, self.new_keys])
                    self.good = np.concatenate([self.good, self.new_good])
                    self.index = HashIndex(self.keys)
                    self.new_keys, self.new_good = np.zeros(0, np.uint64), np.zeros(0, bool)
                    self.new_index = HashIndex(self.new_keys)
        return ok


class Transducer:
    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb
        m = pb.ModelProto()
        m.ParseFromString(model)
        norm, kind = m.normalizer_spec, type(m.pieces[0])
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only the identity normaliser is compiled")
        if m.trainer_spec.model_type not in (_UNIGRAM, _BPE) or not m.trainer_spec.byte_fallback:
            raise ValueError("a unigram or BPE model with byte fallback is needed")
        self.bpe = m.trainer_spec.model_type == _BPE
        self.prefix = norm.add_dummy_prefix
        self.byte_ids = np.zeros(256, dtype=np.int32)
        normal: dict[str, tuple[int, float]] = {}
        spelled = []
        for i, p in enumerate(m.pieces):
            if p.type == kind.BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
                spelled.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type == kind.NORMAL:
                normal[p.piece] = (i, p.score)
                spelled.append(p.piece.replace("▁", " ").encode())
            else:
                spelled.append(b"")
        if any("▁" in p.lstrip("▁") for p in normal):
            raise ValueError("pieces with an inner space are not compiled")
        self.n_ids = len(spelled)
        self.is_byte = np.zeros(self.n_ids, dtype=bool)
        self.is_byte[self.byte_ids] = True
        self.size = np.array([len(s) for s in spelled], dtype=np.int64)
        self.head = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(spelled), dtype=np.uint8)
        self.cost = np.zeros(self.n_ids)
        if not self.bpe:
            for i, score in normal.values():
                self.cost[i] = -score
            # as the library: an unknown character costs the worst score and ten more
            self.unknown = 10.0 - min(s for _, s in normal.values())
        self._compile(normal)
        text = [""] * self.n_ids
        for p, (i, _) in normal.items():
            text[i] = p
        self.pairs = _Pairs(normal, text)

    def _compile(self, normal: dict[str, tuple[int, float]]) -> None:
        arcs: dict[int, int] = {}
        ends, inner = [-1], set()
        self.longest = 1
        for piece, (i, _) in normal.items():
            node, cps = 0, [ord(c) for c in piece]
            self.longest = max(self.longest, len(cps))
            for c in cps:
                key = node << 21 | c
                if key not in arcs:
                    arcs[key] = len(ends)
                    ends.append(-1)
                node = arcs[key]
            ends[node] = i
            inner.update(a << 21 | b for a, b in zip(cps, cps[1:]))
        self.ends = np.array(ends, dtype=np.int64)
        self.arcs = HashIndex(np.array(list(arcs), dtype=np.uint64))
        self.heads = np.array(list(arcs.values()), dtype=np.int64)
        self.inner = HashIndex(np.array(list(inner), dtype=np.uint64))

    def _step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Trie node after one more character, or -1."""
        at = self.arcs.find(node.astype(np.uint64) << np.uint64(21) | char.astype(np.uint64))
        return np.where(at >= 0, self.heads[at], -1)

    def _paths(self, chars: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best paths of rows of ``chars``: piece ids (an uncovered character c
        as -1 - c) end to end, and their number per row."""
        n, width = chars.shape
        rows = np.arange(n)
        cost = np.full((n, width + 1), np.inf)
        cost[:, 0] = 0.0
        last = np.full((n, width + 1), -1, dtype=np.int32)   # piece that ends here
        come = np.zeros((n, width + 1), dtype=np.int32)      # where it begins
        for i in range(width):
            live = rows[(length > i) & np.isfinite(cost[:, i])]
            if not len(live):
                continue
            node = np.zeros(len(live), dtype=np.int64)
            covered = np.zeros(len(live), dtype=bool)
            act, idx = live, np.arange(len(live))
            for size in range(1, min(self.longest, width - i) + 1):
                more = length[act] >= i + size
                act, idx = act[more], idx[more]
                if not len(act):
                    break
                nxt = self._step(node[idx], chars[act, i + size - 1])
                on = nxt >= 0
                act, idx = act[on], idx[on]
                node[idx] = nxt[on]
                piece = self.ends[nxt[on]]
                here = piece >= 0
                r, p = act[here], piece[here]
                if size == 1:
                    covered[idx[here]] = True
                before = last[r, i].astype(np.int64)         # no arc into i is still to come
                if self.bpe:
                    inner = before >= 0
                    ok = np.ones(len(r), dtype=bool)
                    ok[inner] = self.pairs.may_follow(before[inner], p[inner])
                    r, p = r[ok], p[ok]
                total = cost[r, i] + self.cost[p]
                better = total < cost[r, i + size]
                r, p = r[better], p[better]
                cost[r, i + size], last[r, i + size], come[r, i + size] = total[better], p, i
            # a character without a piece of its own goes to its bytes
            bare = live[~covered]
            total = cost[bare, i] + (0.0 if self.bpe else self.unknown)
            better = total < cost[bare, i + 1]
            bare = bare[better]
            cost[bare, i + 1], come[bare, i + 1] = total[better], i
            last[bare, i + 1] = -1 - chars[bare, i].astype(np.int64)
        # walk back, then put the arcs of each row in order
        seen_row, seen_arc, at, live = [], [], length.copy(), rows[length > 0]
        while len(live):
            seen_row.append(live)
            seen_arc.append(last[live, at[live]])
            at[live] = come[live, at[live]]
            live = live[at[live] > 0]
        if not seen_row:
            return np.zeros(0, np.int64), np.zeros(n, np.int64)
        row, arc = np.concatenate(seen_row), np.concatenate(seen_arc).astype(np.int64)
        order = np.lexsort((-np.arange(len(row)), row))
        return arc[order], np.bincount(row, minlength=n)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts laid end to end as UTF-8, and their n+1 offsets."""
        n_docs = len(offsets) - 1
        chars = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        lead = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
        offs = lead[offsets]
        full = np.diff(offs) > 0
        heads = offs[:-1][full]
        if self.prefix:
            chars = np.insert(chars, heads, _SPACE)
            offs = offs + np.concatenate([[0], np.cumsum(full)])
            heads = offs[:-1][full]
        if not len(chars):
            return np.zeros(0, np.int32), np.zeros(n_docs + 1, np.int64)
        chars = np.where(chars == 32, np.uint32(_SPACE), chars)
        cut = np.ones(len(chars), dtype=bool)
        pair = chars[:-1].astype(np.uint64) << np.uint64(21) | chars[1:].astype(np.uint64)
        cut[1:] = self.inner.find(pair) < 0
        cut[1:] |= (chars[1:] == _SPACE) & (chars[:-1] != _SPACE)
        cut[heads] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(chars))
        _, one, back = np.unique(span_hash(chars, start, end), return_index=True, return_inverse=True)
        kinds, sizes = self._solve(chars, start[one], end[one] - start[one])
        many = sizes[back]
        ids = kinds[ranges((np.cumsum(sizes) - sizes)[back], many)]
        total = np.concatenate([[0], np.cumsum(many)])
        return ids, total[np.searchsorted(start, offs)]

    def _solve(self, chars: np.ndarray, start: np.ndarray, length: np.ndarray):
        """Ids of each span, end to end, and their number per span."""
        # rows of one grid are padded to twice their length at most, short ones aside
        widths, longest = list(_WIDTHS), int(length.max())
        while widths[-1] < longest:
            widths.append(2 * widths[-1])
        parts, low = [], 0
        for high in widths:
            pick = np.flatnonzero((length > low) & (length <= high))
            if len(pick):
                wide = int(length[pick].max())
                grid = chars[np.minimum(start[pick, None] + np.arange(wide), len(chars) - 1)]
                arcs, count = self._paths(grid, length[pick])
                parts.append((np.repeat(pick, count), arcs))
            low = high
        row = np.concatenate([p[0] for p in parts])
        arc = np.concatenate([p[1] for p in parts])
        order = np.argsort(row, kind="stable")
        row, arc = row[order], arc[order]
        # bytes of uncovered characters
        bare = arc < 0
        code = np.where(bare, -1 - arc, 0)
        width = np.where(bare, 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF), 1)
        ids = np.repeat(arc, width).astype(np.int32)
        if bare.any():
            raw = np.array(code[bare], dtype=np.uint32).tobytes().decode("utf-32-le").encode()
            ids[np.repeat(bare, width)] = self.byte_ids[np.frombuffer(raw, dtype=np.uint8)]
        return ids, np.bincount(row, weights=width, minlength=len(start)).astype(np.int64)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 of the texts laid end to end, and their n+1 offsets."""
        size = self.size[ids]
        data = self.bytes[ranges(self.head[ids], size)]
        total = np.concatenate([[0], np.cumsum(size)])
        offs = total[offsets]
        if self.prefix:
            full = np.diff(offs) > 0
            heads = offs[:-1][full]
            drop = heads[data[heads] == 32]
            gone = np.zeros(len(data) + 1, dtype=np.int64)
            gone[drop + 1] = 1
            data = np.delete(data, drop)
            offs = offs - np.cumsum(gone)[offs]
        return data, offs


def load(model: bytes) -> Transducer:
    """The compiled model; each Python worker compiles it once."""
    if model not in _loaded:
        _loaded[model] = Transducer(model)
    return _loaded[model]


def _model(df: DataFrame, path: str):
    ship_package(df.sparkSession)
    with open(path, "rb") as f:  # a vocabulary file of fixed size
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(documents: DataFrame, model_path: str = f"{TOKENIZERS}/piece_bpe_32k.model",
           keep: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """Columns ``keep`` and ``ids`` (array<int>) of every row; a column of that
    name among ``keep`` is replaced."""
    model = _model(documents, model_path)
    keep = tuple(c for c in keep if c.lower() != "ids")

    def run(batches):
        t = load(model.value)
        for batch in batches:
            for part in slices(batch, max_bytes=2 << 20):
                text = part.column("text")
                ids, offs = t.encode(*text_bytes(text))
                coded = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(ids, pa.int32()),
                                                 mask=text.is_null() if text.null_count else None)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], coded],
                                                 names=[*keep, "ids"])
    df = documents.select(*map(quoted, dict.fromkeys((*keep, "text"))))
    return df.mapInArrow(run, schema_with(df, keep, ids=T.ArrayType(T.IntegerType())))


def decode(coded: DataFrame, model_path: str = f"{TOKENIZERS}/piece_bpe_32k.model") -> DataFrame:
    """All columns of ``coded`` and ``decoded``, the text of ``ids``; a column of
    that name is replaced."""
    coded = coded.drop("decoded")
    model = _model(coded, model_path)

    def run(batches):
        t = load(model.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                ids = batch.column("ids")
                many = pc.fill_null(pc.list_value_length(ids), 0).to_numpy().astype(np.int64)
                offs = np.concatenate([[0], np.cumsum(many)])
                data, cuts = t.decode(ids.flatten().to_numpy(), offs)
                raw = data.tobytes()
                try:
                    raw.decode("utf-8")
                    text = pa.StringArray.from_buffers(
                        len(batch), pa.py_buffer(cuts.astype(np.int32).tobytes()), pa.py_buffer(raw))
                except UnicodeDecodeError:  # ids that no text encodes to
                    text = pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])])
                if ids.null_count:
                    text = pa.array([None if n else x for n, x in
                                     zip(ids.is_null().to_pylist(), text.to_pylist())], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, text], names=[*batch.schema.names, "decoded"])
    return coded.mapInArrow(run, schema_with(coded, coded.columns, decoded=T.StringType()))
