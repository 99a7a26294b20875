"""Byte-level BPE encoding and decoding with a contiguous rank array.

A text is split at the special tokens, then into pieces by the vocabulary's pattern. A piece of up to SHORT bytes holds
its parts and the ranks of neighbouring parts in two arrays: the minimum of the ranks is found by a scan, the boundary
there is deleted and the ranks on both sides are looked up anew, until no pair has a rank. Many distinct pieces are
merged at once, a row each. A longer piece would make the scans quadratic and uses a heap over linked parts instead;
both give the same ids.

Nulls and empty texts have no ids and decode to the empty text. Ids of a text depend on the text alone, so ties,
repeated rows and the order of rows do not matter. The caches hold chunks and pieces only and take nothing more when full.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_batches, only

# What counts as a letter or number to a newer Unicode than that of the library (16), as ranges of a class.
NEWER_LETTERS = (
    r"\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    r"\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    r"\U00011df1\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff3\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    r"\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168"
    r"\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    r"\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    r"\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
NEWER_NUMBERS = (
    r"\U00011de0-\U00011de9\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ff4-\U00016ff6"
)
LETTER, NUMBER = rf"[\p{{L}}--[{NEWER_LETTERS}]]", rf"[\p{{N}}--[{NEWER_NUMBERS}]]"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?{LETTER}+| ?{NUMBER}+| ?[^\s{LETTER}{NUMBER}]+|\s+(?!\S)|\s+"
#: Unicode White_Space, as the pattern's \s has it; Python's re also counts 1C to 1F.
_WS = "\t-\r \x85\xa0  -     　"
#: A stretch that ends where a piece must end: before a single space that a word follows, and around white space.
CHUNK = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
SHORT = 64
NO_RANK = np.int32(2**31 - 1)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


#: Texts that are held as Python objects at once.
TEXTS = 1_000


@dataclass
class Codec:
    """Tables of one vocabulary; plain arrays, so that it can be broadcast."""

    pair_keys: np.ndarray  # left id << 32 | right id, sorted
    pair_ranks: np.ndarray
    pair_ids: np.ndarray
    byte_ids: np.ndarray
    token_bytes: list[bytes]
    specials: dict[str, int]
    cache_entries: int = 80_000
    chunks: dict[str, bytes] = field(default_factory=dict)
    pieces: dict[str, bytes] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> Codec:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        to_byte = {c: b for b, c in enumerate(byte_characters())}
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        tokens = [b""] * size
        for token, i in vocab.items():
            tokens[i] = bytes(to_byte[c] for c in token)
        for t in spec["added_tokens"]:
            tokens[t["id"]] = t["content"].encode()
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        ids = np.array([vocab[a + b] for a, b in merges], np.int32)
        order = np.argsort(keys, kind="stable")
        return cls(
            keys[order],
            np.arange(len(keys), dtype=np.int32)[order],
            ids[order],
            np.array([vocab[c] for c in byte_characters()], np.int32),
            tokens,
            {t["content"]: t["id"] for t in spec["added_tokens"]},
        )

    def __getstate__(self) -> dict:
        return self.__dict__ | {"chunks": {}, "pieces": {}}

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of pairs; NO_RANK for pairs that never merge."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        hit = self.pair_keys[at] == key
        return np.where(hit, self.pair_ranks[at], NO_RANK), self.pair_ids[at]

    def merge_short(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (little-endian, 32 bits) of pieces of similar length: a row of parts and a row of adjacent ranks for each."""
        lengths = np.array([len(p) for p in pieces])
        width = int(lengths.max())
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        parts = self.byte_ids[raw]
        columns = np.arange(width)
        ranks = np.full(parts.shape, NO_RANK, np.int32)
        if width > 1:
            found, _ = self.find(parts[:, :-1], parts[:, 1:])
            ranks[:, :-1] = np.where(columns[1:] < lengths[:, None], found, NO_RANK)
        live = np.arange(len(pieces))
        while len(live):
            at = ranks[live].argmin(axis=1)
            go = ranks[live, at] != NO_RANK
            live, at = live[go], at[go]
            if not len(live):
                break
            rows, cols = parts[live], ranks[live]
            own = np.arange(len(live))
            _, merged = self.find(rows[own, at], rows[own, at + 1])
            source = np.minimum(columns + (columns > at[:, None]), width - 1)
            rows, cols = np.take_along_axis(rows, source, 1), np.take_along_axis(cols, source, 1)
            rows[own, at] = merged
            cols[:, -1] = NO_RANK
            lengths[live] -= 1
            last = lengths[live] - 1
            right, _ = self.find(merged, rows[own, np.minimum(at + 1, width - 1)])
            cols[own, at] = np.where(at < last, right, NO_RANK)
            has = at > 0
            left, _ = self.find(rows[own[has], at[has] - 1], merged[has])
            cols[own[has], at[has] - 1] = left
            parts[live], ranks[live] = rows, cols
        parts = parts.astype("<u4")
        return [p[: 4 * n] for p, n in zip(map(bytes, parts.view(np.uint8).reshape(len(pieces), -1)), lengths.tolist(), strict=True)]

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same result for a long piece, by a heap over linked parts."""
        parts = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks, _ = self.find(np.array(parts[:-1]), np.array(parts[1:]))
        heap = [(r, i, parts[i], parts[i + 1]) for i, r in enumerate(ranks.tolist()) if r != NO_RANK]
        heapq.heapify(heap)
        gone = [False] * n

        def push(i: int) -> None:
            if i >= 0 and after[i] < n:
                r, _ = self.find(np.array([parts[i]]), np.array([parts[after[i]]]))
                if r[0] != NO_RANK:
                    heapq.heappush(heap, (int(r[0]), i, parts[i], parts[after[i]]))

        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i] = int(self.find(np.array([a]), np.array([b]))[1][0])
            gone[j], after[i] = True, after[j]
            if after[j] < n:
                before[after[j]] = i
            push(before[i])
            push(i)
        return np.array([p for p, g in zip(parts, gone, strict=True) if not g], np.int32)

    def learn(self, missing: set[str]) -> dict[str, bytes]:
        """Ids of chunks that the cache lacks; they join the cache while it has room."""
        find = _pieces().findall
        split = {c: find(c) for c in missing}
        known = self.pieces
        distinct = sorted({p for ps in split.values() for p in ps if p not in known}, key=len)
        raw = [p.encode() for p in distinct]
        order = sorted(range(len(raw)), key=lambda i: len(raw[i]))
        done: dict[str, bytes] = {}
        lo = 0
        while lo < len(order):
            least = len(raw[order[lo]])
            if least > SHORT:
                done[distinct[order[lo]]] = self.merge_long(raw[order[lo]]).astype("<u4").tobytes()
                lo += 1
                continue
            hi = lo
            while hi < len(order) and len(raw[order[hi]]) <= min(SHORT, least + 3) and hi - lo < 20_000:
                hi += 1
            own = order[lo:hi]
            for i, ids in zip(own, self.merge_short([raw[i] for i in own]), strict=True):
                done[distinct[i]] = ids
            lo = hi
        fresh = {c: b"".join([known[p] if p in known else done[p] for p in ps]) for c, ps in split.items()}
        if len(known) < 2 * self.cache_entries:
            known.update(done)
        if len(self.chunks) < self.cache_entries:
            self.chunks.update(fresh)
        return fresh

    def segments(self, text: str) -> list[str]:
        """Ordinary stretches at even places, special tokens at odd ones."""
        if not any(s in text for s in self.specials):
            return [text]
        return re.split("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")", text)

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out, parts = [], [[CHUNK.findall(s) if k % 2 == 0 else s for k, s in enumerate(self.segments(t))] for t in texts]
        known = self.chunks
        missing = {c for ps in parts for p in ps[::2] for c in p if c not in known}
        fresh = self.learn(missing) if missing else {}
        for ps in parts:
            out.append(
                b"".join(
                    [
                        b"".join([known[c] if c in known else fresh[c] for c in p]) if k % 2 == 0 else self.specials[p].to_bytes(4, "little")
                        for k, p in enumerate(ps)
                    ]
                )
            )
        return out

    def decode(self, ids: bytes) -> str:
        tokens = self.token_bytes
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_compiled = None


def _pieces():
    global _compiled
    if _compiled is None:
        _compiled = regex.compile(PATTERN, regex.V1)
    return _compiled


def _groups(texts: list[str | None], most: int = 1 << 20):
    """Consecutive texts of about so many characters together, so that the chunk lists stay small."""
    group, size = [], 0
    for t in texts:
        group.append(t or "")
        size += len(t or "")
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def _cuts(batch: pa.RecordBatch):
    """A batch as ones of up to TEXTS rows."""
    for lo in range(0, batch.num_rows, TEXTS):
        yield batch.slice(lo, TEXTS)


def _default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids): ids of each whole text; null and empty texts have none."""
    codec = df.sparkSession.sparkContext.broadcast(Codec.load(path or _default_path()))

    def run(whole: pa.RecordBatch):
        for batch in _cuts(whole):
            found = [x for g in _groups(batch.column(1).to_pylist()) for x in codec.value.encode_many(g)]
            ids = pa.array([np.frombuffer(x, "<i4") for x in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in found], pa.int64()), ids], ["id", "n_tokens", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(only(df, id=id_col, text=text_col), run, f"id {kind}, n_tokens bigint, ids array<int>")


def decode(df: DataFrame, path: str | None = None, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text): bytes of the tokens as UTF-8, with the replacement character where they are none. Null ids: empty."""
    codec = df.sparkSession.sparkContext.broadcast(Codec.load(path or _default_path()))

    def run(batch: pa.RecordBatch):
        texts = [codec.value.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(only(df, id=id_col, ids=ids_col), run, f"id {kind}, text string")


def round_trip_digests(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of encoding each text and decoding its ids, without moving either."""
    codec = df.sparkSession.sparkContext.broadcast(Codec.load(path or _default_path()))

    def run(batch: pa.RecordBatch):
        rows = []
        for group in (g for cut in _cuts(batch) for g in _groups(cut.column(1).to_pylist())):
            for ids in codec.value.encode_many(group):
                decoded = codec.value.decode(ids).encode()
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()))
        n, a, b = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(only(df, id=id_col, text=text_col), run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
