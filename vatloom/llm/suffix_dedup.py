"""Removal of repeated 50-byte strings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

A byte goes when a 50-byte string over it also starts in a document with a smaller id. Finding these
strings needs all occurrences of a string in one place, without a suffix array of the whole corpus:

1. Exact copies of a document are settled by its hash: every string of theirs starts in the first.
2. Documents are dealt out in chunks. In every 50-byte window the smallest hash of its 24-byte
   substrings (the leftmost, if equal) is the window's anchor: equal windows have equal anchors at equal
   places. Each chunk sends its distinct anchor hashes, and learns which occur in several documents.
3. For each such anchor a chunk sends its distinct contexts (the bytes of the windows that have this
   anchor) with the smallest document of each. Contexts of an anchor pass one task, so all
   occurrences of a repeated string do; a string that a third of all documents share is one row a chunk.
4. There, contexts of an anchor that are all equal are settled at once. The others are joined in one
   text of about a megabyte, and its Burrows-Wheeler transform is extended backwards breadth first:
   intervals of all strings of length 0, 1, 2, ... give the positions where neighbouring suffixes share
   that many bytes, by increasing value, each found once and then no longer followed, until length 50.
   What is left are the intervals of strings of 50 bytes and more; each gets its smallest document.
   An anchor whose contexts exceed ``group_bytes`` together is not held: its windows go on as rows, are
   dealt out by their 50 bytes and sorted by document, so the first of equal ones has the smallest.
5. Chunks take back, for each context, the smallest document of its windows, and remove.

Anchor hashes are truncated to 48 bits; equal hashes of different substrings only bring contexts
together that don't match.

Defined cases. Null text: empty. Null id: neither removed from nor compared. Documents under 50 bytes:
kept. Rows with the same id never remove from each other. Repeated rows: one result row each. Empty
table: empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table
from .textvec import _B, _B_INV, _BYTE, _power, mix

LENGTH, GRAM = 50, 24
SPAN = LENGTH - GRAM + 1
CHUNK_BYTES, PIECE_BYTES, TEXT_BYTES = 4 << 20, 1 << 20, 1 << 20
GROUP_BYTES = 4 << 20
REPEATED, SETTLED, COPY, WINDOW = 0, 1, 2, 3
NOTES = "chunk long, kind int, idx long, data binary"
OPEN = NOTES + ", at int, doc long, several boolean"
RUN = np.dtype([("n", "<i4"), ("doc", "<i8")])
_POS = np.uint64((1 << 21) - 1)


def _anchors(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, end of windows) of each anchor in ``data``, documents cut at ``bounds``."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(_B, n), dtype=np.uint64, out=sums[1:])
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * _power(_B_INV, n)[: n - GRAM + 1])
    wide = len(grams) > int(_POS)
    bits = _POS if not wide else np.uint64((1 << int(len(grams)).bit_length()) - 1)
    low = (grams & ~bits) | np.arange(len(grams), dtype=np.uint64)
    done = 1
    while done < SPAN:
        step = min(done, SPAN - done)
        low = np.minimum(low[:-step], low[step:])
        done += step
    at = (low & bits).astype(np.int64)
    # windows must end inside their document
    doc = np.searchsorted(bounds, np.arange(len(at)), side="right")
    real = np.arange(len(at)) + LENGTH <= bounds[np.minimum(doc, len(bounds) - 1)]
    starts = np.flatnonzero(real & np.concatenate([[True], (at[1:] != at[:-1]) | ~real[:-1] | (doc[1:] != doc[:-1])]))
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.flatnonzero(real & np.concatenate([(at[1:] != at[:-1]) | ~real[1:] | (doc[1:] != doc[:-1]), [True]])) + 1
    return grams[at[starts]] >> np.uint64(16), starts, ends


class Chunk:
    """The documents of a chunk in ascending id, copies of earlier documents left out of the comparison."""

    def __init__(self, docs: pa.Table, notes: pa.Table):
        ids, texts = docs.column("doc_id").to_pylist(), docs.column("text").to_pylist()
        kinds = np.array(notes.column("kind").to_pylist(), np.int32)
        self.notes = notes
        copies = set(notes.filter(pa.array(kinds == COPY)).column("idx").to_pylist()) if len(kinds) else set()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0))
        self.rows = [(ids[i], (texts[i] or "").encode()) for i in order]
        self.copied = [d is not None and d in copies for d, _ in self.rows]

    def compared(self) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray, bytes, np.ndarray]]:
        """(rows, bounds, hash, first, end...) of pieces of about PIECE_BYTES."""
        group, size = [], 0
        for i, (doc, text) in enumerate(self.rows):
            if doc is None or self.copied[i] or len(text) < LENGTH:
                continue
            if group and size + len(text) > PIECE_BYTES:
                yield self._piece(group)
                group, size = [], 0
            group.append(i)
            size += len(text)
        if group:
            yield self._piece(group)

    def _piece(self, group: list[int]):
        whole = b"".join(self.rows[i][1] for i in group)
        bounds = np.cumsum([len(self.rows[i][1]) for i in group])
        h, first, end = _anchors(np.frombuffer(whole, np.uint8), bounds)
        return group, bounds, whole, h, first, end

    def contexts(self):
        """(hash, bytes, index of the distinct context, row, place in the row) of every occurrence of a repeated anchor."""
        blobs = [x for x, k in zip(self.notes.column("data").to_pylist(), self.notes.column("kind").to_pylist()) if k == REPEATED]
        repeated = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in blobs])) if blobs else np.zeros(0, np.uint64)
        seen: dict[bytes, int] = {}
        if not len(repeated):
            return
        for group, bounds, whole, h, first, end in self.compared():
            hit = np.flatnonzero(repeated[np.minimum(np.searchsorted(repeated, h), len(repeated) - 1)] == h)
            of = np.searchsorted(bounds, first[hit], side="right")
            before = np.concatenate([[0], bounds])[of]
            for x, a, b, g, z in zip(h[hit].tolist(), first[hit].tolist(), end[hit].tolist(), of.tolist(), before.tolist()):
                context = whole[a : b - 1 + LENGTH]
                yield x, context, seen.setdefault(context, len(seen)), group[g], a - z


def _send_anchors(buckets: int):
    def run(docs: pa.Table, notes: pa.Table) -> pa.Table:
        chunk = Chunk(docs, notes)
        hashes, owners = [], []
        for group, bounds, _, h, first, _ in chunk.compared():
            hashes.append(h)
            owners.append(np.array(group)[np.searchsorted(bounds, first, side="right")])
        key = docs.column("chunk")[0].as_py() if len(docs) else notes.column("chunk")[0].as_py()
        out: list = [[], [], []]
        if hashes:
            h, o = np.concatenate(hashes), np.concatenate(owners)
            order = np.argsort(h, kind="stable")  # owners ascend already
            h, o = h[order], o[order]
            start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            last = np.concatenate([start[1:], [len(h)]]) - 1
            # the lowest bit says that two documents of this chunk have the anchor
            sent = (h[start] << np.uint64(1)) | (o[start] != o[last]).astype(np.uint64)
            bucket = (h[start] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            sent, bucket = sent[order], bucket[order]
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            for a, b in zip(cut, [*cut[1:], len(sent)]):
                out[0].append(int(bucket[a]))
                out[1].append(key)
                # 49 bits: seven bytes each
                out[2].append(sent[a:b].view(np.uint8).reshape(-1, 8)[:, :7].tobytes())
        return pa.table({"bucket": pa.array(out[0], pa.int64()), "chunk": pa.array(out[1], pa.int64()), "data": pa.array(out[2], pa.binary())})

    return run


def _unpacked(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 7, 8), np.uint8)
    wide[:, :7] = np.frombuffer(data, np.uint8).reshape(-1, 7)
    return wide.view(np.uint64).ravel()


def _repeated(rows: pa.Table) -> pa.Table:
    """For each chunk, its anchor hashes that occur in several documents."""
    chunks = np.array(rows.column("chunk").to_pylist(), np.int64)
    parts = [_unpacked(x) for x in rows.column("data").to_pylist()]
    sent, owner = np.concatenate(parts), np.repeat(chunks, [len(p) for p in parts])
    h, many = sent >> np.uint64(1), (sent & np.uint64(1)).astype(bool)
    order = np.argsort(h, kind="stable")
    h, many, owner = h[order], many[order], owner[order]
    start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    n = np.diff(np.append(start, len(h)))
    keep = np.repeat((n > 1) | np.logical_or.reduceat(many, start), n)
    h, owner = h[keep], owner[keep]
    order = np.argsort(owner, kind="stable")
    h, owner = h[order], owner[order]
    cut = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(h) else []
    ends = [*cut[1:], len(h)] if len(h) else []
    return pa.table({"chunk": pa.array([int(owner[a]) for a in cut], pa.int64()), "kind": pa.array([REPEATED] * len(cut), pa.int32()), "idx": pa.array([0] * len(cut), pa.int64()), "data": pa.array([h[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary())})


def _send_contexts(docs: pa.Table, notes: pa.Table) -> pa.Table:
    chunk = Chunk(docs, notes)
    hashes, texts, first, several = [], [], [], []
    for h, context, i, row, _ in chunk.contexts():
        doc = chunk.rows[row][0]
        if i == len(texts):
            hashes.append(h)
            texts.append(context)
            first.append(doc)
            several.append(False)
        elif doc != first[i]:
            several[i] = True
    key = docs.column("chunk")[0].as_py() if len(docs) else 0
    return pa.table({"h": pa.array(hashes, pa.int64()), "chunk": pa.array([key] * len(texts), pa.int64()), "idx": pa.array(range(len(texts)), pa.int64()), "context": pa.array(texts, pa.binary()), "doc": pa.array(first, pa.int64()), "several": pa.array(several, pa.bool_())})


def suffix_order(symbols: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Order of suffixes by their first ``depth`` symbols (under 512) at least."""
    n, width = len(symbols), 7
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(width, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(width):
        key = (key << 9) | padded[j : j + n]
    while True:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], (ordered[1:] != ordered[:-1]).astype(np.int64)]))
        if width >= depth:
            return order
        later = np.zeros(n, np.int64)
        later[: n - width] = rank[width:] + 1 if width < n else 0
        key = rank * (n + 1) + later
        width *= 2


def expanded(symbols: np.ndarray, order: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Whether each suffix in ``order`` shares fewer than ``depth`` symbols with the one before.

    Symbol 0 separates texts; strings are not extended over it.
    """
    n = len(symbols)
    bwt = symbols[order - 1]  # order == 0 wraps to the last symbol, a separator
    lf = np.empty(n, np.int64)
    lf[np.argsort(bwt.astype(np.uint16), kind="stable")] = np.arange(n)  # a radix sort
    found = np.zeros(n + 1, bool)
    found[0] = found[n] = True
    lb, rb = np.array([0]), np.array([n])
    for level in range(depth):
        size = rb - lb
        if not len(size):
            break
        owner = np.repeat(np.arange(len(lb)), size)
        idx = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lb, size)
        if level:
            real = bwt[idx] != 0
            idx, owner = idx[real], owner[real]
        if not len(idx):
            break
        to = lf[idx]
        turn = np.argsort(to)
        to, owner, letter = to[turn], owner[turn], bwt[idx][turn]
        edge = np.concatenate([[True], (to[1:] != to[:-1] + 1) | (owner[1:] != owner[:-1]) | (letter[1:] != letter[:-1])])
        lb = to[edge]
        rb = np.append(to[np.flatnonzero(edge)[1:] - 1], to[-1]) + 1
        new = ~found[rb]
        # the last interval of a letter ends where the next letter begins, found already; its own start may be new
        found[rb[new]] = True
        keep = new | ~found[lb]
        found[lb] = True
        lb, rb = lb[keep], rb[keep]
    return found[:n]


def smallest_documents(texts: pa.Array, docs: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The smallest document in whose text the string of ``depth`` bytes at each place occurs, for all places of all texts, and the first place (n + 1) of each text."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    symbols = np.zeros(int(sizes.sum() + len(sizes)), np.int64)
    inside = np.ones(len(symbols), bool)
    inside[starts + sizes] = False
    symbols[inside] = np.frombuffer(b"".join(texts.to_pylist()), np.uint8).astype(np.int64) + 1
    order = suffix_order(symbols, depth)
    group = np.cumsum(expanded(symbols, order, depth)) - 1
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    whole = np.arange(len(symbols)) - starts[owner] + depth <= sizes[owner]
    doc = np.where(whole, docs[owner], np.iinfo(np.int64).max)[order]
    low = np.minimum.reduceat(doc, np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])))
    out = np.empty(len(symbols), np.int64)
    out[order] = low[group]
    return out[whole], np.concatenate([[0], np.cumsum(np.maximum(0, sizes - depth + 1))])


def _runs(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of equal values that don't cross the borders ``first`` (n + 1), and the first run (n + 1) of each part."""
    edge = np.concatenate([[True], values[1:] != values[:-1]])
    edge[first[:-1]] = True
    cut = np.flatnonzero(edge)
    out = np.empty(len(cut), RUN)
    out["n"], out["doc"] = np.diff(np.append(cut, len(values))), values[cut]
    return out, np.searchsorted(cut, first)


def _settled(rows: pa.Table) -> pa.RecordBatch:
    """Answers for all contexts of some anchors: runs of windows with the smallest document of each. Rows that need none are left out."""
    coded = rows.column("context").combine_chunks().dictionary_encode()
    texts, code = coded.dictionary, coded.indices.to_numpy()
    h, doc, several = (rows.column(c).to_numpy() for c in ("h", "doc", "several"))
    low = np.full(len(texts), np.iinfo(np.int64).max)
    np.minimum.at(low, code, doc)
    anchor = np.empty(len(texts), np.int64)
    anchor[code] = h  # a context has one anchor, which its bytes determine
    _, back, count = np.unique(anchor, return_inverse=True, return_counts=True)
    mixed = count[back] > 1
    # a context that is alone has one run; the runs of the others follow
    runs = np.empty(len(texts), RUN)
    runs["n"], runs["doc"] = pc.binary_length(texts).to_numpy(zero_copy_only=False) - LENGTH + 1, low
    first, n_runs = np.arange(len(texts)), np.ones(len(texts), np.int64)
    least, most = low.copy(), low.copy()
    if mixed.any():
        at = np.flatnonzero(mixed)
        found, borders = smallest_documents(texts.take(pa.array(at)), low[at])
        more, cut = _runs(found, borders)
        first[at], n_runs[at] = len(runs) + cut[:-1], np.diff(cut)
        least[at], most[at] = np.minimum.reduceat(found, borders[:-1]), np.maximum.reduceat(found, borders[:-1])
        runs = np.concatenate([runs, more])
    need = np.flatnonzero(several | (least[code] != doc) | (most[code] != doc))
    k = n_runs[code[need]]
    ends = np.cumsum(k)
    picked = runs[np.repeat(first[code[need]] - (ends - k), k) + np.arange(k.sum())]
    offsets = np.concatenate([[0], ends]).astype(np.int64) * RUN.itemsize
    data = pa.Array.from_buffers(pa.large_binary(), len(need), [None, pa.py_buffer(offsets), pa.py_buffer(picked.tobytes())]).cast(pa.binary())
    take = pa.array(need)
    return pa.RecordBatch.from_arrays([rows.column("chunk").combine_chunks().take(take), pa.array(np.full(len(need), SETTLED, np.int32)), rows.column("idx").combine_chunks().take(take), data], names=["chunk", "kind", "idx", "data"])


def _answers(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The answers for whole anchors, in the columns of OPEN."""
    b = _settled(pa.Table.from_batches(held))
    none = [pa.nulls(len(b), t) for t in (pa.int32(), pa.int64(), pa.bool_())]
    return pa.RecordBatch.from_arrays([*b.columns, *none], names=[*b.schema.names, "at", "doc", "several"])


def _windows(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The windows of contexts as rows, some thousand contexts at a time."""
    for start in range(0, len(b), 4096):
        part = b.slice(start, 4096)
        contexts = part.column("context").to_pylist()
        n = np.array([len(c) - LENGTH + 1 for c in contexts], np.int64)
        row = pa.array(np.repeat(np.arange(len(n)), n))
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        data = pa.array([c[i : i + LENGTH] for c in contexts for i in range(len(c) - LENGTH + 1)], pa.binary())
        chunk, idx, doc, several = (part.column(c).take(row) for c in ("chunk", "idx", "doc", "several"))
        yield pa.RecordBatch.from_arrays([chunk, pa.array(np.full(len(row), WINDOW, np.int32)), idx, data, pa.array(at.astype(np.int32)), doc, several], names=["chunk", "kind", "idx", "data", "at", "doc", "several"])


def _settle(group_bytes: int):
    """Rows come sorted by anchor hash; gives each context the smallest documents of its windows, and the windows of anchors above ``group_bytes`` as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[pa.RecordBatch] = []  # whole anchors
        last: list[pa.RecordBatch] = []  # the anchor that may go on
        size = last_size = 0
        anchor, wide = None, False
        for b in batches:
            h = b.column("h").to_numpy()
            cut = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(b) else []
            if len(b) and h[0] != anchor:
                done, size, last, last_size, wide = [*done, *last], size + last_size, [], 0, False
            # all anchors of a batch but its first and last begin and end in it
            borders = sorted({0, *cut[1:2], *cut[-1:], len(b)})
            for k, (x, y) in enumerate(zip(borders[:-1], borders[1:])):
                if k:
                    done, size, last, last_size, wide = [*done, *last], size + last_size, [], 0, False
                if size > TEXT_BYTES:
                    yield _answers(done)
                    done, size = [], 0
                part = b.slice(x, y - x)
                last.append(part)
                last_size += pc.sum(pc.binary_length(part.column("context"))).as_py()
                if wide or (last_size > group_bytes and h[x] == h[y - 1]):
                    wide = True
                    for p in last:
                        yield from _windows(p)
                    last, last_size = [], 0
            if len(b):
                anchor = h[-1]
        if done or last:
            yield _answers([*done, *last])

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows come sorted by their bytes and document; each later one gets the first document. Nothing but the present window is held."""
    now, low = None, 0
    for b in batches:
        kind = b.column("kind").to_numpy()
        settled = b.filter(pa.array(kind != WINDOW))
        if len(settled):
            yield settled.select(["chunk", "kind", "idx", "data"])
        rows = b.filter(pa.array(kind == WINDOW))
        lows = []
        docs = rows.column("doc").to_pylist()
        for window, doc in zip(rows.column("data").to_pylist(), docs):
            if window != now:
                now, low = window, doc
            lows.append(low)
        least = np.array(lows, np.int64)
        need = np.flatnonzero((least < np.array(docs, np.int64)) | rows.column("several").to_numpy(zero_copy_only=False).astype(bool)) if len(rows) else []
        if len(need):
            runs = np.empty((len(need), 2), RUN)
            runs["n"][:, 0], runs["doc"][:, 0] = rows.column("at").to_numpy()[need], np.iinfo(np.int64).max  # what stands before the window
            runs["n"][:, 1], runs["doc"][:, 1] = 1, least[need]
            take = pa.array(need)
            yield pa.RecordBatch.from_arrays([rows.column("chunk").take(take), pa.array(np.full(len(need), SETTLED, np.int32)), rows.column("idx").take(take), pa.array([r.tobytes() for r in runs], pa.binary())], names=["chunk", "kind", "idx", "data"])


def _remove(docs: pa.Table, notes: pa.Table) -> pa.Table:
    chunk = Chunk(docs, notes)
    settled: dict[int, list[list[tuple[int, int]]]] = {}
    for i, x, k in zip(*(notes.column(c).to_pylist() for c in ("idx", "data", "kind"))):
        if k == SETTLED:
            settled.setdefault(i, []).append(np.frombuffer(x, RUN).tolist())
    gone: dict[int, list[tuple[int, int]]] = {}
    for _, _, i, row, at in chunk.contexts() if settled else ():
        doc = chunk.rows[row][0]
        for runs in settled.get(i, ()):
            place = at
            for n, low in runs:
                if low < doc:
                    gone.setdefault(row, []).append((place, place + n - 1 + LENGTH))
                place += n
    ids, sizes, removed, spans, hashes, kept = [], [], [], [], [], []
    for row, (doc, text) in enumerate(chunk.rows):
        cuts: list[list[int]] = []
        if chunk.copied[row] and len(text) >= LENGTH:
            cuts = [[0, len(text)]]
        for a, b in sorted(gone.get(row, ())):
            if cuts and a <= cuts[-1][1]:
                cuts[-1][1] = max(cuts[-1][1], b)
            else:
                cuts.append([a, b])
        rest, at = [], 0
        for a, b in cuts:
            rest.append(text[at:a])
            at = b
        rest.append(text[at:])
        left = b"".join(rest)
        ids.append(doc)
        sizes.append(len(text))
        removed.append(len(text) - len(left))
        spans.append(len(cuts))
        hashes.append(hashlib.sha256(left).hexdigest())
        kept.append(left)
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(hashes, pa.string()), "kept": pa.array(kept, pa.binary())})


def deduplicate(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes)."""
    spark = documents.sparkSession
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    prints = staged(docs.select("doc_id", F.sha2("text", 256).alias("h"), F.octet_length("text").cast("long").alias("n")), "sd-prints")
    total = prints.agg(F.sum("n")).first()[0] or 0
    n_chunks = max(1, -(-total // CHUNK_BYTES))
    chunk = F.pmod(F.xxhash64("doc_id"), F.lit(n_chunks)).alias("chunk")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(n_chunks, 20_000))
    dealt = docs.select(chunk, "doc_id", "text").repartition(parts, "chunk")

    firsts = staged(prints.where("doc_id IS NOT NULL").groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last"), "sd-firsts")
    copies = prints.join(firsts, "h").where("doc_id > first").select("doc_id").distinct()
    none = F.lit(None).cast("binary").alias("data")
    copies = staged(copies.select(chunk, F.lit(COPY).alias("kind"), F.col("doc_id").alias("idx"), none), "sd-copies")

    # one plan from here on: the exchange of the texts and that of the anchors are each made once and read again
    def with_notes(notes: DataFrame):
        return dealt.groupBy("chunk").cogroup(notes.repartition(parts, "chunk").groupBy("chunk"))

    anchors = with_notes(copies).applyInArrow(_send_anchors(n_chunks), "bucket long, chunk long, data binary")
    repeated = anchors.groupBy("bucket").applyInArrow(_repeated, NOTES)
    known = copies.unionByName(repeated)
    contexts = with_notes(known).applyInArrow(_send_contexts, "h long, chunk long, idx long, context binary, doc long, several boolean")
    settled = contexts.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(_settle(group_bytes), OPEN)
    key = F.when(F.col("kind") == WINDOW, F.xxhash64("data")).otherwise(F.xxhash64("chunk", "idx"))
    settled = settled.withColumn("key", key).repartition(parts, "key").sortWithinPartitions(F.when(F.col("kind") == WINDOW, F.col("data")), "doc").drop("key").mapInArrow(_joined, NOTES)
    return with_notes(known.unionByName(settled)).applyInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents")).drop("kept")
