"""SentencePiece encoding and decoding with seeded merge-dropout.

The model is a merge (BPE) model read from a file whose path is a parameter.
Text is cut where no merge can cross: before a run of spaces that follows a
word, and around characters that no piece of several characters holds. Each
chunk keeps an agenda of candidate merges, best score first and leftmost on
ties. A popped candidate is skipped for good when the keyed hash of (seed, run,
text, the chunk's position in it, place, merged piece) falls below the dropout
rate; otherwise its two symbols merge and the new neighbours join the agenda.
With rate 0 the result is that of the usual encoder.

So every occurrence of a chunk has draws of its own, while an occurrence's
result depends on nothing but seed, run, text and position: any retry gives the
same ids. ``run`` tells passes over the same texts apart. A cache of bounded
size keeps each chunk's merges without skips. An occurrence draws for those; if
none of them is skipped its ids are the cached ones, else its own agenda is
processed with its own draws. Agendas of many occurrences advance together as
numpy arrays.

Decoding joins pieces and byte pieces. Characters that the model lacks, and
U+2581 itself (which stands for the space), are written as bytes, so decoding
gives back every text exactly.

Defined results: a null text has null ids and decodes to null; an empty text
has no ids; repeated rows repeat.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quillion.llm.common import arrow_map, columns, free
from quillion.llm.features import mix
from quillion.session import read

RATE, SEED, RUN = 0.1, 20240601, 0
MARK = "▁"
#: Chunk that stands for U+2581 in a text; no other chunk holds a space.
LITERAL = " "
CACHE_CHUNKS, GROUP, OCCURRENCES = 400_000, 10_000, 200_000
#: Chunks longer than this keep their agendas in a heap instead of arrays.
LONG = 48
_NONE = np.int32(2**31 - 1)
_PLACE, _PIECE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


class Pieces:
    """A merge model: its pieces, their scores and the table of merges."""

    def __init__(self, model: bytes, seed: int = SEED, rate: float = RATE, run: int = RUN):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.texts = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids = np.zeros(256, np.int64)
        self.byte_of = np.full(n, -1)
        normal = {}
        for i, t in enumerate(self.texts):
            if sp.is_byte(i):
                self.byte_of[i] = int(t[3:5], 16)
                self.byte_ids[int(t[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                normal[t] = i
        if (self.byte_of >= 0).sum() != 256:
            raise ValueError("the model has no byte pieces, so it can't encode every text without loss")
        self.normal = normal
        # symbols that are not pieces but parts of some: single characters get numbers after the pieces
        self.char_id: dict[str, int] = {t: i for t, i in normal.items() if len(t) == 1}
        merging = {c for t in normal if len(t) > 1 for c in t}
        for c in sorted(merging - self.char_id.keys()):
            self.char_id[c] = n + len(self.char_id)
        self.symbols = max([n, *self.char_id.values()]) + 1
        score = np.full(self.symbols, -np.inf)
        score[:n] = [sp.get_score(i) for i in range(n)]
        self.score = score
        # rank of each symbol's score, best first; the last entry (also at -1) is for no candidate
        order = np.unique(-score[np.isfinite(score)])
        self.none = np.int32(len(order))
        self.rank = np.append(np.searchsorted(order, -score), self.none).astype(np.int32)
        known = self.char_id | normal
        merges = {known[t[:k]] * self.symbols + known[t[k:]]: i for t, i in normal.items() if len(t) > 1 for k in range(1, len(t)) if t[:k] in known and t[k:] in known}
        self.merges = merges
        self._lay_out(np.fromiter(merges.keys(), np.int64, len(merges)), np.fromiter(merges.values(), np.int32, len(merges)))
        crossing = any(re.search(f"[^{MARK}]{MARK}", t) for t in normal)
        inner = "".join(re.escape(c) for c in sorted(merging - {MARK}))
        # a run of spaces with the word after it; or characters that take part in no merge, one by one
        self.cut = re.compile(f"{MARK}*[{inner}]+|{MARK}+|." if not crossing else f"[{MARK}{inner}]+|.", re.S)
        self.seed, self.bar, self.run = seed, np.uint64(min(int(rate * 2.0**64), 2**64 - 1)), run
        self.clear()
        raw = [b" " if t == MARK else t.replace(MARK, " ").encode() if self.byte_of[i] < 0 else bytes([self.byte_of[i]]) for i, t in enumerate(self.texts)]
        self.raw_flat, self.raw_count = np.frombuffer(b"".join(raw), np.uint8), np.fromiter(map(len, raw), np.int64)
        self.raw_start = np.cumsum(self.raw_count) - self.raw_count
        # ids of each symbol: itself, or the bytes of a character that is no piece
        ids = [[i] for i in range(n)] + [self.byte_ids[list(c.encode())].tolist() for c, i in sorted(self.char_id.items(), key=lambda x: x[1]) if i >= n]
        self.id_flat, self.id_count = np.array([i for x in ids for i in x], np.int64), np.fromiter(map(len, ids), np.int64)
        self.id_start = np.cumsum(self.id_count) - self.id_count

    def _lay_out(self, keys: np.ndarray, made: np.ndarray) -> None:
        """The table of merges as a hash table with linear probing, at most an eighth full."""
        bits = max(4, int(len(keys) * 8).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slot_keys, self.slot_made = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        slot = (keys.astype(np.uint64) * _PLACE) >> self.shift
        todo = np.arange(len(keys))
        while len(todo):
            free = todo[self.slot_keys[slot[todo]] < 0]
            _, some = np.unique(slot[free], return_index=True)  # one key for each free slot
            won = free[some]
            self.slot_keys[slot[won]], self.slot_made[slot[won]] = keys[won], made[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = (slot[todo] + np.uint64(1)) & np.uint64((1 << bits) - 1)

    def clear(self) -> None:
        """Forget all chunks."""
        self.known: dict[str, int] = {}
        # by chunk: where its symbols, its ids and its merges begin in the flat arrays below; one more entry for the end
        self.at_symbol, self.at_id, self.at_mark = (np.zeros(1, np.int64) for _ in range(3))
        self.flat_symbols, self.flat_ids = np.zeros(0, np.int32), np.zeros(0, np.uint32)
        # place and piece of each merge, as they enter the hash
        self.flat_marks = np.zeros(0, np.uint64)

    def skips(self, key, place, piece):
        """True where the candidate that makes ``piece`` at ``place`` is dropped."""
        with np.errstate(over="ignore"):  # modulo 2**64
            return self.drawn(np.uint64(key) ^ (np.uint64(place) * _PLACE + np.uint64(piece) * _PIECE))

    def drawn(self, h):
        """True where the hash of ``h`` is below the rate."""
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ (h >> np.uint64(32))) < self.bar

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Piece that each pair of symbols makes, or -1: a hash table with linear probing."""
        key = left.astype(np.int64) * self.symbols + right
        slot = (key.astype(np.uint64) * _PLACE) >> self.shift
        have = self.slot_keys[slot]
        out = np.where(have == key, self.slot_made[slot], -1)
        todo = np.flatnonzero((have != key) & (have >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + np.uint64(1)) & np.uint64(len(self.slot_keys) - 1)
            have = self.slot_keys[slot[todo]]
            found = have == key[todo]
            out[todo[found]] = self.slot_made[slot[todo[found]]]
            todo = todo[~found & (have >= 0)]
        return out

    def written(self, symbols: list[int], chars: str, places: list[int]) -> bytes:
        """Ids (2 or 4 bytes each) of final symbols; those that are no pieces become bytes."""
        out = []
        for s, p in zip(symbols, places, strict=True):
            if s < len(self.texts):
                out.append(s)
            else:
                out += self.byte_ids[list(chars[p].encode())].tolist()
        return np.array(out, np.uint32).tobytes()

    def chunk_slow(self, key: int, chunk: str) -> bytes:
        """One occurrence with a heap as its agenda; the meaning of ``chunks``, and the way for long ones."""
        import heapq

        sym = [self.char_id[c] for c in chunk]
        n = len(sym)
        nxt, prv, live = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        agenda: list = []

        def add(i: int) -> None:
            if i >= 0 and nxt[i] >= 0 and (p := self.merges.get(sym[i] * self.symbols + sym[nxt[i]], -1)) >= 0:
                heapq.heappush(agenda, (-self.score[p], i, p, sym[i], sym[nxt[i]], nxt[i]))

        for i in range(n - 1):
            add(i)
        while agenda:
            _, i, p, left, right, j = heapq.heappop(agenda)
            if not live[i] or nxt[i] != j or sym[i] != left or sym[j] != right:
                continue
            with np.errstate(over="ignore"):
                if self.skips(key, i, p):
                    continue
            sym[i], live[j], nxt[i] = p, False, nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
            add(prv[i])
            add(i)
        at = [i for i in range(n) if live[i]]
        return self.written([sym[i] for i in at], chunk, at)

    def advanced(self, sym: np.ndarray, keys: np.ndarray | None) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
        """Symbols (place, row; -1 past the end) with all merges made, and (row, place, piece) of the merges by step.

        Agendas of all rows advance together, one step each at a time. ``prio``
        holds, at each symbol that begins a candidate, the rank of its score and
        its place in one number, so a row's smallest entry is the top of its
        agenda. Without ``keys`` nothing is skipped.
        """
        width, n = sym.shape
        out, steps, of = sym.copy(), [], np.arange(n)
        place = np.arange(width, dtype=np.int32)[:, None]
        cand = np.full((width, n), -1, np.int32)
        pair = sym[1:] >= 0
        cand[:-1][pair] = self.merged(sym[:-1][pair], sym[1:][pair])
        prio = np.where(cand >= 0, self.rank[cand] * 64 + place, _NONE).astype(np.int32)
        sym = out.copy()
        nxt = np.where(np.vstack([pair, np.zeros((1, n), bool)]), place + 1, -1).astype(np.int32)
        prv = np.broadcast_to(place - 1, (width, n)).copy()
        while n:
            best = prio.min(0)
            act = np.flatnonzero(best != _NONE)
            if len(act) < 0.7 * n:  # rows that are done leave
                out[:, of] = sym
                sym, cand, prio, nxt, prv = (a.take(act, 1) for a in (sym, cand, prio, nxt, prv))
                of, best, n = of[act], best[act], len(act)
                keys, act = None if keys is None else keys[act], np.arange(n)
                if not n:
                    break
            s, c, p, x, v = (a.reshape(-1) for a in (sym, cand, prio, nxt, prv))
            at = best[act] & 63
            i = at * n + act
            piece = c[i]
            if keys is not None:
                drop = self.drawn(keys[act] ^ (at.astype(np.uint64) * _PLACE + piece.astype(np.uint64) * _PIECE))
                p[i[drop]] = _NONE
                go = ~drop
                act, at, i, piece = act[go], at[go], i[go], piece[go]
            else:
                steps.append((of[act], at, piece))
            j = x[i] * n + act
            after, before = x[j], v[i]
            s[i], s[j], p[j], x[i] = piece, -1, _NONE, after
            has = after >= 0
            v[after[has] * n + act[has]] = at[has]
            p[i[~has]] = _NONE
            # the merged symbol with what follows it, and what precedes it with the merged symbol
            back = before >= 0
            left = np.concatenate([i[has], before[back] * n + act[back]])
            right = np.concatenate([after[has] * n + act[has], i[back]])
            new = self.merged(s[left], s[right])
            c[left] = new
            p[left] = np.where(new >= 0, self.rank[new] * 64 + left // n, _NONE)
        out[:, of] = sym
        return out, steps

    def flattened(self, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of columns of final symbols, one column after the other, and how many each has; symbols that are no pieces become bytes."""
        real = sym.T >= 0
        many, flat = real.sum(1), sym.T[real]
        if (flat >= len(self.texts)).any():
            size = self.id_count[flat]
            begin = np.cumsum(size) - size
            row = np.repeat(np.arange(len(many)), many)
            many = np.bincount(row, size, len(many)).astype(np.int64)
            flat = self.id_flat[np.repeat(self.id_start[flat] - begin, size) + np.arange(size.sum())]
        return flat.astype(np.uint32), many

    def symbols_of(self, chunks: list[str]) -> np.ndarray:
        """Symbols (place, row) of the characters of chunks, -1 past their ends."""
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        rows = np.full((len(chunks), size.max(initial=0)), -1, np.int32)
        rows[np.arange(rows.shape[1]) < size[:, None]] = np.fromiter(map(self.char_id.__getitem__, "".join(chunks)), np.int32)
        return np.ascontiguousarray(rows.T)

    def numbers(self, chunks: list[str]) -> np.ndarray:
        """Numbers of chunks of at most ``LONG`` characters in the cache, to which new ones are added."""
        new = sorted(set(chunks) - self.known.keys(), key=len)
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        one = [c for c in new if len(c) == 1]
        ids = [[self.normal[c]] if c in self.normal and c != LITERAL else self.byte_ids[list((MARK if c == LITERAL else c).encode())] for c in one]
        added = [(np.zeros(0, np.int32), np.zeros(len(one), np.int64), np.concatenate([np.zeros(0, np.uint32), *ids]).astype(np.uint32), np.fromiter(map(len, ids), np.int64), np.zeros(0, np.uint64), np.zeros(len(one), np.int64))]
        for at in range(len(one), len(new), GROUP):
            sym = self.symbols_of(new[at : at + GROUP])
            out, steps = self.advanced(sym, None)
            row, place, piece = (np.concatenate(x) for x in zip(*steps, strict=True)) if steps else (np.zeros(0, np.int64),) * 3
            order = np.argsort(row, kind="stable")
            marks = place[order].astype(np.uint64) * _PLACE + piece[order].astype(np.uint64) * _PIECE
            real = sym.T >= 0
            added.append((sym.T[real], real.sum(1), *self.flattened(out), marks, np.bincount(row, minlength=sym.shape[1])))
        if new:
            symbols, n_symbols, ids, n_ids, marks, n_marks = (np.concatenate(x) for x in zip(*added, strict=True))
            self.flat_symbols, self.flat_ids, self.flat_marks = np.append(self.flat_symbols, symbols), np.append(self.flat_ids, ids), np.append(self.flat_marks, marks)
            self.at_symbol, self.at_id, self.at_mark = (np.append(a, a[-1] + np.cumsum(n)) for a, n in ((self.at_symbol, n_symbols), (self.at_id, n_ids), (self.at_mark, n_marks)))
        return np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))

    def chunk_ids(self, keys, want: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of occurrences of chunks, one after the other, and how many each has; ``keys`` (one for all, or one each) key the draws."""
        keys = np.broadcast_to(np.asarray(keys, np.uint64), len(want))
        got = [self._block(keys[at : at + OCCURRENCES], want[at : at + OCCURRENCES]) for at in range(0, len(want), OCCURRENCES)]
        return tuple(np.concatenate(x) for x in zip((np.zeros(0, np.uint32), np.zeros(0, np.int64)), *got, strict=True))

    def chunks(self, keys, want: list[str]) -> list[bytes]:
        """Ids of occurrences of chunks, each as bytes."""
        ids, many = self.chunk_ids(keys, want)
        raw, ends = ids.tobytes(), (4 * np.cumsum(many)).tolist()
        return [raw[s:e] for s, e in zip([0, *ends], ends, strict=False)]

    def _block(self, keys: np.ndarray, want: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > CACHE_CHUNKS:
            self.clear()
        slow = {k: np.frombuffer(self.chunk_slow(keys[k], c), np.uint32) for k, c in enumerate(want) if len(c) > LONG} if max(map(len, want)) > LONG else {}
        if slow:
            want = [LITERAL if k in slow else c for k, c in enumerate(want)]
        which = self.numbers(want)
        n_marks = self.at_mark[which + 1] - self.at_mark[which]
        owner = np.repeat(np.arange(len(want)), n_marks)
        begin = np.cumsum(n_marks) - n_marks
        at = np.repeat(self.at_mark[which] - begin, n_marks) + np.arange(len(owner))
        # an occurrence none of whose merges is skipped has the cached ids
        varied = np.unique(owner[self.drawn(keys[owner] ^ self.flat_marks[at])])
        start, many = self.at_id[which], self.at_id[which + 1] - self.at_id[which]
        size = self.at_symbol[which[varied] + 1] - self.at_symbol[which[varied]]
        order = np.argsort(size, kind="stable")
        varied, size = varied[order], size[order]
        more, end = [self.flat_ids], len(self.flat_ids)
        for at in range(0, len(varied), GROUP):
            v, n = varied[at : at + GROUP], size[at : at + GROUP]
            place = np.arange(n[-1])[:, None]
            sym = np.where(place < n, self.flat_symbols[np.minimum(self.at_symbol[which[v]] + place, len(self.flat_symbols) - 1)], -1)
            ids, many[v] = self.flattened(self.advanced(sym, keys[v])[0])
            start[v] = end + np.cumsum(many[v]) - many[v]
            more.append(ids)
            end += len(ids)
        for k, ids in slow.items():
            start[k], many[k] = end, len(ids)
            more.append(ids)
            end += len(ids)
        return np.concatenate(more)[np.repeat(start - (np.cumsum(many) - many), many) + np.arange(many.sum())], many

    def keys_of(self, text: str, n: int) -> np.ndarray:
        """Keys of the n chunks of a text."""
        h = hashlib.blake2b(text.encode(), digest_size=8, key=f"{self.seed}/{self.run}".encode()).digest()
        return mix(mix(np.uint64(int.from_bytes(h, "little")) + np.arange(1, n + 1, dtype=np.uint64) * _PLACE))

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Ids of each text."""
        parts = [self.split(t) if t else [] for t in texts]
        keys = [self.keys_of(t, len(p)) for t, p in zip(texts, parts, strict=True) if p]
        ids, many = self.chunk_ids(np.concatenate(keys) if keys else 0, [c for p in parts for c in p])
        ends = np.append(0, np.cumsum(many))[np.cumsum([len(p) for p in parts])] if parts else []
        return [None if t is None else x for t, x in zip(texts, np.split(ids, ends[:-1]), strict=True)] if parts else []

    def split(self, t: str) -> list[str]:
        """Chunks of a text, with marks for spaces and LITERAL for marks."""
        parts: list[str] = []
        for k, piece in enumerate(t.split(MARK)):
            parts += [LITERAL] if k else []
            parts += self.cut.findall(("" if k else MARK) + piece.replace(" ", MARK))
        return parts

    def decode(self, ids: np.ndarray | None) -> str | None:
        """The text of ids, without the mark in front."""
        if ids is None:
            return None
        size = self.raw_count[ids]
        raw = self.raw_flat[np.repeat(self.raw_start[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())].tobytes()
        return raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace")


_OPEN: dict[tuple, Pieces] = {}


def opened(model: bytes, *args) -> Pieces:
    """The model, built once in a worker process."""
    key = (zlib.crc32(model), *args)
    if key not in _OPEN:
        _OPEN.clear()
        _OPEN[key] = Pieces(model, *args)
    return _OPEN[key]


def _mapped(df: DataFrame, keep: list[str], added: list[T.StructField], fn, model: str | None, *args) -> DataFrame:
    with open(model or default_model(), "rb") as f:
        known = df.sparkSession.sparkContext.broadcast(f.read())
    schema = T.StructType([*[df.schema[c] for c in keep], *added])
    names = [f.name for f in added]
    return arrow_map(df, lambda b: {c: b.column(c) for c in keep} | dict(zip(names, fn(opened(known.value, *args), b), strict=True)), schema)


def encode(df: DataFrame, text_col: str = "text", out: str = "ids", model: str | None = None, seed: int = SEED, rate: float = RATE, run: int = RUN) -> DataFrame:
    """``df`` and as the last column ``out``, ids (array of int) of each text (underscores behind the name if it is taken)."""
    fn = lambda p, b: [p.encode(b.column(text_col).to_pylist())]
    return _mapped(df, df.columns, [T.StructField(free(out, df.columns), T.ArrayType(T.IntegerType()))], fn, model, seed, rate, run)


def decode(df: DataFrame, ids_col: str = "ids", out: str = "text", model: str | None = None) -> DataFrame:
    """``df`` without the ids and as the last column ``out``, the text of each array of ids (underscores behind the name if it is taken)."""
    keep = [c for c in df.columns if c != ids_col]
    fn = lambda p, b: [[p.decode(None if x is None else np.array(x, np.int64)) for x in b.column(ids_col).to_pylist()]]
    return _mapped(df, keep, [T.StructField(free(out, keep), T.StringType())], fn, model)


def round_trip(df: DataFrame, keep: list[str], text_col: str = "text", model: str | None = None, seed: int = SEED, rate: float = RATE, run: int = RUN) -> DataFrame:
    """Columns ``keep`` with what encoding each text and decoding its ids gives.

    n_pieces; ids_sha256 (of the ids as little-endian 32-bit integers);
    decoded_sha256 (of the decoded text); lossless (it equals the text). Null
    texts have 0 pieces and null digests, and are lossless.
    """
    kinds = {"n_pieces": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType(), "lossless": T.BooleanType()}
    added = [T.StructField(free(n, keep), k) for n, k in kinds.items()]

    def fn(p: Pieces, b: pa.RecordBatch) -> list:
        texts = b.column(text_col).to_pylist()
        ids = p.encode(texts)
        back = [p.decode(i) for i in ids]
        return [
            [0 if i is None else len(i) for i in ids],
            [None if i is None else hashlib.sha256(i.tobytes()).hexdigest() for i in ids],
            [None if t is None else hashlib.sha256(t.encode()).hexdigest() for t in back],
            [t == u for t, u in zip(texts, back, strict=True)],
        ]

    return _mapped(columns(df, [*keep, text_col]), keep, added, fn, model, seed, rate, run)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "documents"), ["doc_id"])
