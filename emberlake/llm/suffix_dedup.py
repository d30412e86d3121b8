"""Removal of byte strings that an earlier document has, by column-wise construction of sorted suffixes.

A byte goes if it lies in a string of ``WINDOW`` bytes that also starts in a document of smaller id. Strings are compared in
a collection of short sequences to whose front one symbol each is added per round, from the last column to the first.
After each round the sequences stand in the order of what has been added so far (as in a Burrows-Wheeler transform,
a stable partition by the new symbol), and the lengths of the prefixes that neighbours have in common are carried over from
the round before. Where a common prefix reaches ``WINDOW``, the strings are equal; the least id of each such class is noted.

Done for whole texts this takes as many rounds over all bytes as the longest text has. Here the collection is cut so that a
few rounds do and Spark can deal it out, without losing a match. Each string of ``WINDOW`` bytes has an anchor, its
group of ``ANCHOR`` bytes with the least hash (the leftmost of equals); equal strings have equal anchors at equal places.
Neighbouring strings with one anchor form a sequence of at most ``2 * WINDOW - ANCHOR`` bytes. So:

1. Blocks of documents send the hashes of their anchors to buckets; a bucket tells which occur in two or more documents.
2. Blocks send the distinct sequences of such anchors, with the least id of each, to the anchor's bucket, where the
   collection is built column by column; blocks are told of strings that smaller ids have elsewhere.
3. Blocks mark the bytes and write the spans. All three read the same exchange of the texts.

Between the steps only packed arrays travel, one row for a block and bucket; a string that a block holds often travels once.

Edge cases: null and empty texts have no bytes; texts shorter than the window are kept; equal ids do not remove from each other,
repeated rows included; rows without an id are left out of the result; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations


from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.llm.common import task_count

WINDOW = 50
ANCHOR = 20
BLOCK_BYTES = 8_000_000
_SPAN = WINDOW - ANCHOR + 1
_FRAME = 2 * WINDOW - ANCHOR
_CHUNK = 1 << 20
_A = 0x9E3779B97F4A7C15  # odd, so it has an inverse
_A_INVERSE = pow(_A, -1, 1 << 64)
_HIGH = np.uint64((1 << 64) - (1 << 24))
_RUN_TYPES = (np.int64, np.int64, np.int64, np.uint64, np.uint64)
_ANSWER = "block int, bucket int, kind int, payload binary"


def _power(base: int, exponent: int) -> np.uint64:
    return np.uint64(pow(base, exponent, 1 << 64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _anchor_hashes(data: np.ndarray) -> np.ndarray:
    """The hash of the ``ANCHOR`` bytes from every position."""
    parts, size = {1: data.astype(np.uint64)}, 1
    while 2 * size <= ANCHOR:
        parts[2 * size] = parts[size][:-size] * _power(_A, size) + parts[size][size:]
        size *= 2
    out, done = None, 0
    for size in sorted(parts, reverse=True):
        if done + size <= ANCHOR:
            out = parts[size] if out is None else out[: len(parts[size]) - done] * _power(_A, size) + parts[size][done:][: len(out)]
            done += size
    return _mix(out[: len(data) - ANCHOR + 1])


def _leftmost_least(hashes: np.ndarray) -> np.ndarray:
    """For every start the position of the least of ``_SPAN`` hashes, the leftmost of equals.

    Compares the first 40 bits; the rest of a number holds the position.
    """
    keys, size = (hashes & _HIGH) | np.arange(len(hashes), dtype=np.uint64), 1
    while size < _SPAN:
        step = min(size, _SPAN - size)
        keys, size = np.minimum(keys[:-step], keys[step:]), size + step
    return (keys & ~_HIGH).astype(np.int64)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``_A`` and of its inverse for the places of a chunk."""
    return tuple(np.cumprod(np.r_[np.uint64(1), np.full(_CHUNK - 1, np.uint64(base))]) for base in (_A, _A_INVERSE))


class Block:
    """The documents of a block, and the runs of neighbouring strings with one anchor, in order of their places."""

    def __init__(self, rows: pa.Table) -> None:
        # In one order at every reading, as exchanges deliver rows in any order and the runs are numbered.
        found = sorted(zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()))
        self.ids, texts = np.array([i for i, _ in found], dtype=np.int64), [t for _, t in found]
        self.sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        # Chunks overlap by less than a window, so that each string starts in one of them; runs may be cut there.
        found = [self._runs(at, min(at + _CHUNK, len(self.data))) for at in range(0, max(0, len(self.data) - WINDOW + 1), _CHUNK - WINDOW + 1)]
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, dtype=t) for t in _RUN_TYPES]
        self.anchor, self.first, self.last, self.hash, self.whole = columns
        self.doc = np.searchsorted(self.ends, self.first, side="right")

    def _runs(self, base: int, stop: int) -> tuple[np.ndarray, ...]:
        data = self.data[base:stop]
        hashes = _anchor_hashes(data)
        best = _leftmost_least(hashes)
        whole = np.ones(len(best) + 1, dtype=bool)  # strings that lie in one document
        lo, hi = np.searchsorted(self.ends, [base, stop], side="right")
        for end in (self.ends[lo:hi] - base).tolist():
            if end > 0:
                whole[max(0, end - WINDOW + 1) : end] = False
        starts = np.flatnonzero(whole[:-1])
        if not len(starts):
            return tuple(np.zeros(0, dtype=t) for t in _RUN_TYPES)
        best = best[starts]
        head = np.flatnonzero(np.r_[True, (best[1:] != best[:-1]) | (starts[1:] != starts[:-1] + 1)])
        first, last, anchor = starts[head], starts[np.r_[head[1:], len(starts)] - 1], best[head]
        # The hash of each run's bytes from running sums of symbol times power.
        powers, inverse = _powers()
        sums = np.r_[np.uint64(0), np.cumsum(data * powers[: len(data)])]
        content = _mix((sums[last + WINDOW] - sums[first]) * inverse[first] + (last - first).astype(np.uint64))
        return anchor + base, first + base, last + base, hashes[anchor], content

    def anchors(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct anchor hashes by bucket and hash, each run's place among them, whether several ids have one, and the buckets."""
        unique, of = np.unique(self.hash, return_inverse=True)
        bucket = (unique % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((unique, bucket))
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        of = place[of]
        least, most = np.full(len(unique), np.iinfo(np.int64).max), np.full(len(unique), np.iinfo(np.int64).min)
        np.minimum.at(least, of, self.ids[self.doc])
        np.maximum.at(most, of, self.ids[self.doc])
        return unique[order], of, least < most, bucket[order]

    def sequences(self, buckets: int, answers: pa.Table) -> tuple[np.ndarray, ...] | None:
        """Runs whose anchor is shared, by sequence; of each distinct sequence the first run, which has its least id.

        Gives the runs, each run's sequence, the first runs, their buckets, and where each bucket's sequences begin.
        """
        unique, of, _, bucket = self.anchors(buckets)
        shared = np.zeros(len(unique), dtype=bool)
        for number, kind, payload in zip(*(answers.column(c).to_pylist() for c in ("bucket", "kind", "payload"))):
            if kind == 0:
                lo, hi = np.searchsorted(bucket, [number, number + 1])
                shared[lo:hi] = np.unpackbits(np.frombuffer(payload, dtype=np.uint8), count=hi - lo).astype(bool)
        runs = np.flatnonzero(shared[of])
        if not len(runs):
            return None
        runs = runs[np.lexsort((self.ids[self.doc[runs]], self.whole[runs], of[runs]))]
        new = np.r_[True, (of[runs[1:]] != of[runs[:-1]]) | (self.whole[runs[1:]] != self.whole[runs[:-1]])]
        firsts = runs[new]
        own = bucket[of[firsts]]
        return runs, np.cumsum(new) - 1, firsts, own, np.searchsorted(own, np.arange(buckets + 1))

    def frames(self, runs: np.ndarray) -> np.ndarray:
        """The bytes of the runs, aligned by their anchors; what is outside a run is zero."""
        columns = np.arange(_FRAME) - (_SPAN - 1)
        at = self.anchor[runs][:, None] + columns
        outside = (at < self.first[runs][:, None]) | (at >= self.last[runs][:, None] + WINDOW)
        at[outside] = 0
        out = self.data[at]
        out[outside] = 0
        return out


def _least_ids(frames: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each sequence and place of the anchor (0 to ``_SPAN`` - 1) the least id with the string that starts so far before it.

    Equal sequences count once; an anchor with a single sequence needs no order.
    """
    anchors = np.ascontiguousarray(frames[:, _SPAN - 1 : _SPAN - 1 + ANCHOR]).view(f"V{ANCHOR}").ravel()
    group = np.unique(anchors, return_inverse=True)[1].ravel()
    weights = np.array([pow(_A, i + 1, 1 << 64) for i in range(_FRAME)], dtype=np.uint64)
    content = np.zeros(len(frames), dtype=np.uint64)
    for column in range(_FRAME):
        content += frames[:, column] * weights[column]
    order = np.lexsort((ids, content, group))
    same = (group[order[1:]] == group[order[:-1]]) & (content[order[1:]] == content[order[:-1]])
    same[same] = (frames[order[1:][same]] == frames[order[:-1][same]]).all(axis=1)
    new = np.r_[True, ~same]
    kind = np.empty(len(order), dtype=np.int64)
    kind[order] = np.cumsum(new) - 1
    firsts = order[new]
    least = np.broadcast_to(ids[firsts][:, None], (len(firsts), _SPAN)).copy()
    several = np.bincount(group[firsts])[group[firsts]] > 1
    if several.any():
        own = firsts[several]
        least[several] = _ordered(frames[own], group[own], ids[own], low[own], high[own])
    return least[kind]


def _ordered(frames: np.ndarray, group: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The column-wise construction over distinct sequences; those of different anchors (``group``, ascending) never meet."""
    out = np.broadcast_to(ids[:, None], (len(ids), _SPAN)).copy()
    order, columns = np.arange(len(ids)), np.ascontiguousarray(frames.T)
    new_group = np.r_[True, group[1:] != group[:-1]]  # groups keep their places in every order
    common = np.where(new_group, -1, 0).astype(np.int16)  # with the one before; -1 at a new anchor
    for column in range(_FRAME - 1, -1, -1):
        symbol = columns[column][order]
        # A stable partition by anchor and new symbol keeps the order of what follows.
        move = np.lexsort((symbol, group))
        # The least common prefix on the way from the one before with this symbol, and one symbol more.
        way = np.minimum.reduceat(np.r_[common, np.int16(-1)], np.c_[move[:-1] + 1, move[1:] + 1].ravel())[::2] if len(move) > 1 else np.zeros(0, dtype=np.int16)
        order, symbol = order[move], symbol[move]
        common = np.r_[np.int16(-1), np.where(symbol[1:] == symbol[:-1], way + 1, 0)].astype(np.int16)
        common[new_group] = -1
        place = _SPAN - 1 - column
        if place >= 0:
            valid = (low[order] <= place) & (place <= high[order])
            classes = np.cumsum(common < WINDOW) - 1
            least = np.full(classes[-1] + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, classes[valid], ids[order[valid]])
            out[order[valid], place] = least[classes[valid]]
    return out


def _answer(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * 4
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["block", "bucket", "kind", "payload"])


def _pack_sequences(block: Block, firsts: np.ndarray) -> bytes:
    anchor = block.anchor[firsts]
    parts = [block.ids[block.doc[firsts]].astype(np.int64), (anchor - block.last[firsts]).astype(np.uint8), (anchor - block.first[firsts]).astype(np.uint8), block.frames(firsts)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(p.tobytes() for p in parts))


def _unpack_sequences(payload: bytes) -> tuple[np.ndarray, ...]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), dtype=np.uint8)
    n = len(raw) // (_FRAME + 10)
    return raw[: 8 * n].view(np.int64), raw[8 * n : 9 * n], raw[9 * n : 10 * n], raw[10 * n :].reshape(n, _FRAME)


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_removed, spans, kept)``: removed spans of bytes ``[start, end)`` and the remaining bytes."""
    source = docs.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).cast("binary").alias("text"))
    total = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = task_count(docs.sparkSession, total, BLOCK_BYTES)
    blocks = source.select(F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int").alias("block"), "doc_id", "text")

    def send_anchors(rows: pa.Table) -> pa.Table:
        block = Block(rows)
        unique, _, several, bucket = block.anchors(buckets)
        cut = np.searchsorted(bucket, np.arange(buckets + 1))
        out = []
        for b in range(buckets):
            lo, hi = cut[b], cut[b + 1]
            if lo < hi:
                out.append((rows.column("block")[0].as_py(), b, 0, unique[lo:hi].tobytes() + np.packbits(several[lo:hi]).tobytes()))
        return _answer(out)

    def tell_shared(rows: pa.Table) -> pa.Table:
        sent = []
        for payload in rows.column("payload").to_pylist():
            n = len(payload) * 8 // 65  # eight bytes and one bit each, filled up to whole bytes
            sent.append((np.frombuffer(payload, dtype=np.uint64, count=n), np.unpackbits(np.frombuffer(payload, dtype=np.uint8, offset=8 * n), count=n).astype(bool)))
        every = np.sort(np.concatenate([u for u, _ in sent]))
        twice = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], *(u[s] for u, s in sent)]))
        out = []
        for number, (unique, _) in zip(rows.column("block").to_pylist(), sent):
            at = np.minimum(np.searchsorted(twice, unique), max(0, len(twice) - 1))
            flags = twice[at] == unique if len(twice) else np.zeros(len(unique), dtype=bool)
            if flags.any():
                out.append((number, rows.column("bucket")[0].as_py(), 0, np.packbits(flags).tobytes()))
        return _answer(out)

    def send_sequences(rows: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and answers.num_rows:
            block = Block(rows)
            found = block.sequences(buckets, answers)
            if found is not None:
                _, _, firsts, _, cut = found
                number = rows.column("block")[0].as_py()
                out = [(number, b, 1, _pack_sequences(block, firsts[cut[b] : cut[b + 1]])) for b in range(buckets) if cut[b] < cut[b + 1]]
        return _answer(out)

    def tell_least(rows: pa.Table) -> pa.Table:
        parts = [_unpack_sequences(p) for p in rows.column("payload").to_pylist()]
        ids, low, high, frames = (np.concatenate(c) for c in zip(*parts))
        least = _least_ids(frames, ids, low, high)
        out, at = [], 0
        for number, part in zip(rows.column("block").to_pylist(), parts):
            own = least[at : at + len(part[0])]
            places = np.arange(_SPAN)
            lower = (own < part[0][:, None]) & (places >= part[1][:, None]) & (places <= part[2][:, None])
            # Stretches of places with one smaller id.
            start = lower & np.c_[np.ones(len(own), dtype=bool), (own[:, 1:] != own[:, :-1]) | ~lower[:, :-1]]
            end = lower & np.c_[(own[:, 1:] != own[:, :-1]) | ~lower[:, 1:], np.ones(len(own), dtype=bool)]
            (sequence, a), (_, b) = np.nonzero(start), np.nonzero(end)
            if len(sequence):
                payload = b"".join(x.tobytes() for x in (own[sequence, a].astype(np.int64), sequence.astype(np.uint32), a.astype(np.uint8), b.astype(np.uint8)))
                out.append((number, rows.column("bucket")[0].as_py(), 1, payload))
            at += len(part[0])
        return _answer(out)

    def write(rows: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(rows) if rows.num_rows else None
        if block is None:
            return pa.table([pa.array([], t) for t in types], names=names)
        change = np.zeros(len(block.data) + 1, dtype=np.int32)
        found = block.sequences(buckets, answers) if answers.num_rows else None
        if found is not None:
            runs, of, firsts, _, cut = found
            own = block.ids[block.doc[runs]]
            covered = runs[block.ids[block.doc[firsts]][of] < own]
            np.add.at(change, block.first[covered], 1)
            np.add.at(change, block.last[covered] + WINDOW, -1)
            begins = np.searchsorted(of, np.arange(len(firsts) + 1))
            for bucket, kind, payload in zip(*(answers.column(c).to_pylist() for c in ("bucket", "kind", "payload"))):
                if kind != 1:
                    continue
                n = len(payload) // 14
                least, sequence = np.frombuffer(payload, np.int64, n), np.frombuffer(payload, np.uint32, n, 8 * n).astype(np.int64) + cut[bucket]
                a, b = np.frombuffer(payload, np.uint8, n, 12 * n).astype(np.int64), np.frombuffer(payload, np.uint8, n, 13 * n).astype(np.int64)
                times = begins[sequence + 1] - begins[sequence]
                which = np.repeat(np.arange(n), times)
                run = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(begins[sequence], times)
                hit = least[which] < own[run]
                anchor, which = block.anchor[runs[run[hit]]], which[hit]
                np.add.at(change, anchor - b[which], 1)
                np.add.at(change, anchor - a[which] + WINDOW, -1)
        gone = np.cumsum(change[:-1]) > 0
        spans, removed, kept = [], [], []
        for start, size in zip(block.starts.tolist(), block.sizes.tolist()):
            own = gone[start : start + size]
            edge = np.flatnonzero(np.diff(np.r_[False, own, False]))
            spans.append([{"start": s, "end": e} for s, e in edge.reshape(-1, 2).tolist()])
            removed.append(int(own.sum()))
            kept.append(block.data[start : start + size][~own].tobytes())
        columns = (block.ids, block.sizes, removed, spans, kept)
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    names = ["doc_id", "n_bytes", "n_removed", "spans", "kept"]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
    result = "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary"
    by_block = blocks.groupBy("block")
    shared = by_block.applyInArrow(send_anchors, _ANSWER).groupBy("bucket").applyInArrow(tell_shared, _ANSWER)
    sequences = by_block.cogroup(shared.groupBy("block")).applyInArrow(send_sequences, _ANSWER)
    least = sequences.groupBy("bucket").applyInArrow(tell_least, _ANSWER)
    return by_block.cogroup(shared.unionByName(least).groupBy("block")).applyInArrow(write, result)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
