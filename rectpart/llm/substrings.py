"""Exact removal of repeated byte strings, the suffix-array kind of deduplication, over all documents.

Every string of SPAN bytes (a window) that also starts in a document with a smaller id is covered. Two equal windows have the same anchor: the
gram of GRAM bytes in them with the least hash, together with the HALF bytes before it or, where the window has fewer, behind it. A run of windows with one anchor is a stretch of a
document; equal windows lie in stretches with equal anchors, so suffixes need comparing only within an anchor's group. The gram alone would recur by chance, and the more so the
larger the table; an anchor is long enough that this share doesn't grow.

1. Documents are packed into batches of about BATCH_BYTES where they are read. Each batch sends digests of its distinct texts by bucket, and buckets answer which of them stand in a
   smaller document as a whole. Such copies are covered from end to end, and take no part in what follows.
2. Each batch sends CODE_BITS bits of its distinct anchors' hashes by bucket. Buckets answer which of them occur in two documents; all others can't be in a repeated string.
   Anchors that share their bits by chance cost bytes further on, not results.
3. Batches send hashes of the distinct stretches of repeated anchors, with the least document id of each.
4. Buckets answer which stretches stand in a smaller document as a whole, and which of an anchor that has other stretches, too, are the first of their kind: only these can share
   a window with another one, and only their bytes are sent.
5. Buckets order the suffixes of each anchor's stretches by linear grouping over Lyndon prefixes (``suffixes``), take neighbours with the same first SPAN bytes as
   one group, and answer, for each stretch, which windows start in a smaller document. Beforehand, what lies outside a stretch's first and last window whose
   fingerprint comes twice is left out: it can't be in a group of two.
6. Batches add up the covered bytes of each document.

Copies cost a hash a batch, whatever their number, so that no group grows with a hot passage. The batches' exchange, compressed, is used five times.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rectpart.llm import suffixes, textops

SPAN, GRAM = 50, 8
#: Of each window, a gram and so many bytes before it or behind it lie within the window.
HALF = (SPAN - GRAM) // 2
#: Bytes of text in a batch, and about how many anchors a bucket should get.
BATCH_BYTES, BUCKET_ANCHORS, LEAST_BUCKETS = 1_500_000, 2_000_000, 128
#: Buckets of anchors for each bucket of whole texts.
TEXT_SHARE = 8
#: Of an anchor's hash, what is sent besides its bucket: with BUCKET_ANCHORS in a bucket, one in a hundred meets another one by chance.
CODE_BITS = 28
_ALL = np.uint64(2**64 - 1)


def _least(a: np.ndarray, n: int) -> np.ndarray:
    """Minimum over each n neighbours."""
    size, out = 1, a
    while 2 * size <= n:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(a) - n + 1], out[n - size : len(a) - size + 1])


def _ids(table: pa.Table) -> np.ndarray:
    return table["doc_id"].fill_null(np.iinfo(np.int64).max).to_numpy()


class Texts:
    """The distinct texts of a batch that have a window, in an order that depends on their contents alone."""

    def __init__(self, table: pa.Table, buckets: int):
        self.ids, (data, offsets) = _ids(table), textops.buffers(table["text"])
        self.long = np.flatnonzero(np.diff(offsets) >= SPAN)
        digests = b"".join(hashlib.blake2b(data[offsets[i] : offsets[i + 1]], digest_size=16).digest() for i in self.long.tolist())
        keys = np.frombuffer(digests, "<u8").reshape(-1, 2)
        bucket = (keys[:, 0] % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((self.ids[self.long], keys[:, 1], keys[:, 0], bucket))
        new = np.concatenate([[True], (keys[order[1:]] != keys[order[:-1]]).any(1)]) if len(order) else np.zeros(0, bool)
        self.of = np.zeros(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1
        first = order[new]
        self.keys, self.least, self.bucket = keys[first], self.ids[self.long[first]], bucket[first]

    def by_bucket(self) -> Iterator[tuple[int, int, int]]:
        """Of each bucket, the range of its distinct texts."""
        begin, n = suffixes.runs(self.bucket)
        yield from zip(self.bucket[begin].tolist(), begin.tolist(), (begin + n).tolist(), strict=True)

    def copies(self, marks: dict[int, bytes]) -> np.ndarray:
        """Of each row, whether a smaller document has its text; marks: of a bucket, a bit for each text that stands in a smaller document of another batch."""
        flag = np.zeros(len(self.least), bool)
        for bucket, a, b in self.by_bucket():
            if bucket in marks:
                flag[a:b] = np.unpackbits(np.frombuffer(marks[bucket], np.uint8), count=b - a)
        out = np.zeros(len(self.ids), bool)
        out[self.long] = flag[self.of] | (self.ids[self.long] > self.least[self.of])
        return out


class Batch:
    """The stretches of a batch of texts, in an order that depends on their contents alone."""

    def __init__(self, table: pa.Table, buckets: int):
        self.ids = _ids(table)
        self.data, self.offsets = textops.buffers(table["text"])
        self.prefix = textops.prefix_hash(self.data)
        n = len(self.data)
        self.start = self.count = self.code = self.doc = np.zeros(0, np.int64)
        if n >= SPAN:
            at = np.arange(n - GRAM + 1)
            hashes = textops.span_hash(self.prefix, at, at + GRAM)
            bits = np.uint64(max(22, n.bit_length()))
            least = _least(hashes >> bits << bits | at.astype(np.uint64), SPAN - GRAM + 1)
            ends = np.repeat(self.offsets[1:], np.diff(self.offsets))[: len(least)]
            first = np.flatnonzero(np.arange(len(least)) + SPAN <= ends)  # windows within one text
            anchor = (least[first] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
            anchor -= HALF * (anchor - first >= HALF)
            if len(first):
                new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (first[1:] != first[:-1] + 1)]))
                self.start, self.count = first[new], np.diff(np.append(new, len(first)))
                h = textops.span_hash(self.prefix, anchor[new], anchor[new] + GRAM + HALF)
                self.code = (h % np.uint64(buckets)).astype(np.int64) << CODE_BITS | (h >> np.uint64(64 - CODE_BITS)).astype(np.int64)
                self.doc = np.searchsorted(self.offsets, self.start, "right") - 1
        self.codes, self.of = np.unique(self.code, return_inverse=True)
        bucket = self.codes >> CODE_BITS
        self.buckets, begin = np.unique(bucket, return_index=True)
        self.bounds = np.append(begin, len(bucket))

    def by_bucket(self) -> Iterator[tuple[int, int, int]]:
        for k, bucket in enumerate(self.buckets.tolist()):
            yield bucket, int(self.bounds[k]), int(self.bounds[k + 1])

    def several(self) -> np.ndarray:
        """Of each distinct anchor, whether two documents of the batch have it."""
        low, high = np.full(len(self.codes), np.iinfo(np.int64).max), np.full(len(self.codes), np.iinfo(np.int64).min)
        np.minimum.at(low, self.of, self.ids[self.doc])
        np.maximum.at(high, self.of, self.ids[self.doc])
        return low < high

    def repeated(self, marks: dict[int, bytes]) -> None:
        """Keeps the stretches whose anchors are marked, and finds the distinct ones; marks: a bit for each anchor of a bucket."""
        flag = np.zeros(len(self.codes), bool)
        for bucket, a, b in self.by_bucket():
            if bucket in marks:
                flag[a:b] = np.unpackbits(np.frombuffer(marks[bucket], np.uint8), count=b - a)
        keep = np.flatnonzero(flag[self.of]) if len(self.of) else np.zeros(0, np.int64)
        self.start, self.count, self.code, self.doc = self.start[keep], self.count[keep], self.code[keep], self.doc[keep]
        content = textops.span_hash(self.prefix, self.start, self.start + self.count + SPAN - 1)
        order = np.lexsort((self.ids[self.doc], content, self.count, self.code))
        c, n, x = self.code[order], self.count[order], content[order]
        new = np.concatenate([[True], (c[1:] != c[:-1]) | (n[1:] != n[:-1]) | (x[1:] != x[:-1])]) if len(order) else np.zeros(0, bool)
        self.entry = np.zeros(len(order), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.first = order[new]  # of each distinct stretch, an occurrence in its smallest document
        self.hashes = x[new]
        self.entry_bucket = self.code[self.first] >> CODE_BITS

    def entries(self) -> Iterator[tuple[int, int, int]]:
        """Of each bucket, the range of its distinct stretches."""
        begin, n = suffixes.runs(self.entry_bucket)
        yield from zip(self.entry_bucket[begin].tolist(), begin.tolist(), (begin + n).tolist(), strict=True)

    def covered(self, masks: np.ndarray) -> np.ndarray:
        """Bytes covered, given for each distinct stretch the windows that start in smaller documents; all bits: every occurrence is covered."""
        whole = (masks[self.entry] == _ALL) | (self.ids[self.doc] > self.ids[self.doc[self.first]][self.entry])
        edge = np.zeros(len(self.data) + 1, np.int64)
        np.add.at(edge, self.start[whole], 1)
        np.add.at(edge, self.start[whole] + self.count[whole] + SPAN - 1, -1)
        part = np.flatnonzero(~whole & (masks[self.entry] != 0))
        window, n = suffixes.ranges(np.zeros(len(part), np.int64), self.count[part]), self.count[part]
        hit = (np.repeat(masks[self.entry[part]], n) >> window.astype(np.uint64) & np.uint64(1)).astype(bool)
        at = (np.repeat(self.start[part], n) + window)[hit]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + SPAN, -1)
        return np.cumsum(edge[:-1]) > 0


def resolve(keys: np.ndarray, counts: np.ndarray, docs: np.ndarray, content: np.ndarray) -> np.ndarray:
    """For each stretch (anchor key, number of windows, least document, bytes), a bit for each window that also starts in a smaller
    document; all bits where the whole stretch stands in a smaller one."""
    size = counts + SPAN - 1
    start = np.cumsum(size) - size
    prefix = textops.prefix_hash(content)
    whole = textops.span_hash(prefix, start, start + size)
    by_kind = np.lexsort((docs, whole, counts, keys))
    k, c, h = keys[by_kind], counts[by_kind], whole[by_kind]
    new_key = np.concatenate([[True], k[1:] != k[:-1]])
    new = new_key | np.concatenate([[True], (c[1:] != c[:-1]) | (h[1:] != h[:-1])])
    distinct = np.cumsum(new) - 1
    firsts = by_kind[new]
    masks = np.zeros(len(keys), np.uint64)
    # candidates: of anchors with two different stretches, the runs from the first to the last window whose fingerprint comes twice
    of_key = np.cumsum(new_key)[new] - 1
    several = firsts[(np.bincount(of_key) > 1)[of_key]] if len(firsts) else firsts
    n = counts[several]
    at = suffixes.ranges(start[several], n)
    _, which, times = np.unique(textops.span_hash(prefix, at, at + SPAN), return_inverse=True, return_counts=True)
    again = np.flatnonzero(times[which] > 1)
    owner = np.repeat(np.arange(len(several)), n)[again]
    begin, length = suffixes.runs(owner)
    low, high = at[again[begin]], at[again[begin + length - 1]]
    _, of_set = np.unique(keys[several[owner[begin]]], return_inverse=True)
    # the order of all suffixes of an anchor's runs; neighbours in it with the same first SPAN bytes are one group
    order = suffixes.suffix_order(content, low, high - low + SPAN, of_set)
    ends = np.zeros(len(content) + 1, np.int64)
    ends[suffixes.ranges(low, high - low + SPAN)] = np.repeat(high + SPAN, high - low + SPAN)
    order = order[order + SPAN <= ends[order]]
    group = np.cumsum(_differ(content, order)) - 1
    stretch = np.searchsorted(start, order, "right") - 1
    least = np.full(int(group[-1]) + 1 if len(group) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, group, docs[stretch])
    hit = least[group] < docs[stretch]
    np.bitwise_or.at(masks, stretch[hit], np.uint64(1) << (order[hit] - start[stretch[hit]]).astype(np.uint64))
    # equal stretches: those of the smallest document share its windows
    masks[by_kind] = np.where(docs[by_kind] > docs[firsts][distinct], _ALL, masks[firsts][distinct])
    return masks


def states(keys: np.ndarray, counts: np.ndarray, docs: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """What becomes of each stretch (anchor key, number of windows, least document, hash of its bytes)."""
    order = np.lexsort((docs, hashes, counts, keys))
    k, c, h = keys[order], counts[order], hashes[order]
    new_key = np.concatenate([[True], k[1:] != k[:-1]])
    new = new_key | np.concatenate([[True], (c[1:] != c[:-1]) | (h[1:] != h[:-1])])
    firsts, of_key = order[new], np.cumsum(new_key) - 1
    several = np.bincount(of_key[new])[of_key] > 1
    out = np.zeros(len(keys), np.uint8)
    out[order] = np.where(docs[order] > docs[firsts][np.cumsum(new) - 1], _WHOLE, np.where(several, _ASKED, _FREE))
    return out


def _differ(content: np.ndarray, at: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """Of each window, whether its bytes are others than those of the one before it; the first is True."""
    out = np.ones(len(at), bool)
    for i in range(1, len(at), block):
        k = np.arange(i, min(len(at), i + block))
        two = content[at[k[0] - 1 : k[-1] + 1, None] + np.arange(SPAN)]
        out[k] = (two[1:] != two[:-1]).any(1)
    return out


def _low(values: np.ndarray, n: int) -> bytes:
    """The lowest n bytes of each value, all first ones, then all second ones, and so on: bytes that hardly differ stand together and compress."""
    return np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes()


def _from_low(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((len(raw) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(raw, np.uint8).reshape(n, -1).T
    return out.view("<i8").ravel()


def _ascending(codes: np.ndarray) -> bytes:
    """What is sent of ascending codes of one bucket: the steps between them."""
    return _low(np.diff(codes & ((1 << CODE_BITS) - 1), prepend=0), 4)


def _from_ascending(raw: bytes) -> np.ndarray:
    return np.cumsum(_from_low(raw, 4))


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(table: pa.Table) -> pa.Table:
    """The rows of a batch."""
    return pa.ipc.open_stream(table["rows"][0].as_buffer()).read_all()


_BATCH = "batch long, rows binary"
_TEXTS = "batch long, bucket long, keys binary, docs binary"
_FROM_BATCH = "batch long, bucket long, keys binary, flags binary"
_ANSWER = "batch long, bucket long, kind int, bits binary"
#: hashes: of whole stretches; content: the bytes of those that are asked for
_STRETCHES = "batch long, bucket long, keys binary, counts binary, docs binary, hashes binary"
_CONTENT = "batch long, bucket long, keys binary, counts binary, docs binary, content binary"
#: What buckets answer: anchors that occur in two documents; what becomes of a stretch; its covered windows; texts that stand in a smaller document.
_MARKS, _STATES, _MASKS, _COPIES = 0, 1, 2, 3
#: What becomes of a stretch: nothing of it is covered; all is; its bytes are asked for.
_FREE, _WHOLE, _ASKED = 0, 1, 2


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.table([pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary: the remaining bytes) of every row; carry: also `row`, a struct of all its columns but the text.

    Null text counts as empty, and texts shorter than SPAN bytes lose nothing. Windows are judged on the input. Rows that repeat with the same id don't cover
    each other, and each gives a row; a null id counts as larger than all others. An empty table gives no rows; other columns aren't read.
    """
    others = [docs[c] for c in docs.columns if c != text_col] if carry else []
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), *([F.struct(*others).alias("row")] if others else []))
    total = docs.agg(F.sum(F.octet_length(docs[text_col])).alias("n")).first().n or 0
    buckets = max(LEAST_BUCKETS, total // 16 // BUCKET_ANCHORS)
    text_buckets = buckets // TEXT_SHARE

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            _, offsets = textops.buffers(batch.column(1))
            for i, j in textops.slices(offsets, BATCH_BYTES):
                yield from _table(_BATCH, [(number, _packed(pa.Table.from_batches([batch.slice(i, j - i)])))]).to_batches()
                number += 1

    def texts(table: pa.Table) -> pa.Table:
        batch, x = table["batch"][0].as_py(), Texts(_unpacked(table), text_buckets)
        return _table(_TEXTS, [(batch, bucket, x.keys[a:b].tobytes(), _low(x.least[a:b], 8)) for bucket, a, b in x.by_bucket()])

    def match(table: pa.Table) -> pa.Table:
        docs = [_from_low(x, 8) for x in table["docs"].to_pylist()]
        _, of = np.unique(np.frombuffer(b"".join(table["keys"].to_pylist()), "V16"), return_inverse=True)
        every = np.concatenate(docs)
        least = np.full(of.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, of, every)
        parts = np.split(least[of] < every, np.cumsum([len(x) for x in docs])[:-1])
        return _table(_ANSWER, [(batch, bucket, _COPIES, np.packbits(x).tobytes()) for batch, bucket, x in zip(table["batch"].to_pylist(), table["bucket"].to_pylist(), parts, strict=True) if x.any()])

    def told(table: pa.Table, answers: pa.Table) -> tuple[Batch, list[dict[int, bytes]], np.ndarray]:
        """What is left of a batch without copies, what buckets answered so far, of each kind by bucket, and which rows are copies."""
        given: list[dict[int, bytes]] = [{}, {}, {}, {}]
        for kind, bucket, bits in zip(answers["kind"].to_pylist(), answers["bucket"].to_pylist(), answers["bits"].to_pylist(), strict=True):
            given[kind][bucket] = bits
        copy = Texts(table, text_buckets).copies(given[_COPIES])
        return Batch(table.select(["doc_id", "text"]).filter(pa.array(~copy)), buckets), given, copy

    def anchors(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _table(_FROM_BATCH, [])
        batch, (x, _, _) = table["batch"][0].as_py(), told(_unpacked(table), answers)
        several = x.several()
        return _table(_FROM_BATCH, [(batch, bucket, _ascending(x.codes[a:b]), np.packbits(several[a:b]).tobytes()) for bucket, a, b in x.by_bucket()])

    def mark(table: pa.Table) -> pa.Table:
        keys = [_from_ascending(x) for x in table["keys"].to_pylist()]
        flags = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)).astype(bool) for x, k in zip(table["flags"].to_pylist(), keys, strict=True)]
        _, of, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        some = np.zeros(len(times), bool)
        some[of[np.concatenate(flags)]] = True
        out = (some | (times > 1))[of]
        ends = np.cumsum([len(k) for k in keys])
        rows = []
        for batch, bucket, k, end in zip(table["batch"].to_pylist(), table["bucket"].to_pylist(), keys, ends, strict=True):
            mine = out[end - len(k) : end]
            if mine.any():
                rows.append((batch, bucket, _MARKS, np.packbits(mine).tobytes()))
        return _table(_ANSWER, rows)

    def stretches(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _table(_STRETCHES, [])
        batch, (x, given, _) = table["batch"][0].as_py(), told(_unpacked(table), answers)
        x.repeated(given[_MARKS])
        rows = []
        for bucket, a, b in x.entries():
            k = x.first[a:b]
            rows.append((batch, bucket, _ascending(x.code[k]), x.count[k].astype(np.uint8).tobytes(), _low(x.ids[x.doc[k]], 8), x.hashes[a:b].astype("<u8").tobytes()))
        return _table(_STRETCHES, rows)

    joined = lambda table, c, read: np.concatenate([read(x) for x in table[c].to_pylist()])

    def about(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return joined(table, "keys", _from_ascending), joined(table, "counts", lambda x: np.frombuffer(x, np.uint8).astype(np.int64)), joined(table, "docs", lambda x: _from_low(x, 8))

    def answered(table: pa.Table, kind: int, values: np.ndarray) -> pa.Table:
        """Values of all stretches that were sent, to the batches that sent them."""
        parts = np.split(values, np.cumsum([len(c) for c in table["counts"].to_pylist()])[:-1])
        return _table(_ANSWER, [(b, k, kind, v.tobytes()) for b, k, v in zip(table["batch"].to_pylist(), table["bucket"].to_pylist(), parts, strict=True) if v.any()])

    def ask(table: pa.Table) -> pa.Table:
        return answered(table, _STATES, states(*about(table), joined(table, "hashes", lambda x: np.frombuffer(x, "<u8"))))

    def contents(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _table(_CONTENT, [])
        batch, (x, given, _) = table["batch"][0].as_py(), told(_unpacked(table), answers)
        x.repeated(given[_MARKS])
        rows = []
        for bucket, a, b in x.entries():
            k = x.first[a:b][np.frombuffer(given[_STATES].get(bucket, bytes(b - a)), np.uint8) == _ASKED]
            if len(k):
                content = x.data[suffixes.ranges(x.start[k], x.count[k] + SPAN - 1)]
                rows.append((batch, bucket, _ascending(x.code[k]), x.count[k].astype(np.uint8).tobytes(), _low(x.ids[x.doc[k]], 8), pa.compress(content.tobytes(), "zstd", asbytes=True)))
        return _table(_CONTENT, rows)

    def decide(table: pa.Table) -> pa.Table:
        keys, counts, docs = about(table)
        sizes = [sum(c) + (SPAN - 1) * len(c) for c in table["counts"].to_pylist()]
        content = b"".join(pa.decompress(x, n, "zstd", asbytes=True) for x, n in zip(table["content"].to_pylist(), sizes, strict=True))
        return answered(table, _MASKS, resolve(keys, counts, docs, np.frombuffer(content, np.uint8)).astype("<u8"))

    plain = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    # the row's own type, with what isn't nullable in it
    out_schema = T.StructType.fromDDL(plain).add(base.schema["row"]) if others else plain
    nothing, with_row = _table(plain, []), bool(others)

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return nothing
        table = _unpacked(table)
        x, given, copy = told(table, answers)
        x.repeated(given[_MARKS])
        masks = np.zeros(len(x.first), np.uint64)
        for bucket, a, b in x.entries():
            state = np.frombuffer(given[_STATES].get(bucket, bytes(b - a)), np.uint8)
            masks[a:b][state == _WHOLE] = _ALL
            if bucket in given[_MASKS]:
                masks[a:b][state == _ASKED] = np.frombuffer(given[_MASKS][bucket], "<u8")
        gone = x.covered(masks)
        upto = np.concatenate([[0], np.cumsum(gone)])
        begins = gone & ~np.concatenate([[False], gone[:-1]]) if len(gone) else gone
        inside = x.offsets[:-1][x.offsets[:-1] < len(gone)]
        begins[inside] = gone[inside]
        spans = np.concatenate([[0], np.cumsum(begins)])
        left, rest = x.data[~gone], x.offsets - upto[x.offsets]
        lo, hi = x.offsets[:-1], x.offsets[1:]
        n_bytes = np.diff(textops.buffers(table["text"])[1])
        n_removed, n_spans = n_bytes.copy(), np.ones(len(copy), np.int64)  # a copy goes as one span
        n_removed[~copy], n_spans[~copy] = upto[hi] - upto[lo], spans[hi] - spans[lo]
        parts = zip(rest[:-1].tolist(), rest[1:].tolist(), strict=True)
        kept = [b"" if gone_whole else left[slice(*next(parts))].tobytes() for gone_whole in copy.tolist()]
        out = pa.table([table["doc_id"], pa.array(n_bytes), pa.array(n_removed), pa.array(n_spans), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])
        return out.append_column("row", table["row"]) if with_row else out

    packed = base.mapInArrow(pack, _BATCH)
    ask_batches = lambda given, f, schema: packed.groupBy("batch").cogroup(given.groupBy("batch")).applyInArrow(f, schema)
    copies = packed.groupBy("batch").applyInArrow(texts, _TEXTS).groupBy("bucket").applyInArrow(match, _ANSWER)
    marks = copies.unionByName(ask_batches(copies, anchors, _FROM_BATCH).groupBy("bucket").applyInArrow(mark, _ANSWER))
    asked = ask_batches(marks, stretches, _STRETCHES).groupBy("bucket").applyInArrow(ask, _ANSWER)
    answers = marks.unionByName(asked)
    decided = ask_batches(answers, contents, _CONTENT).groupBy("bucket").applyInArrow(decide, _ANSWER)
    return ask_batches(answers.unionByName(decided), finish, out_schema)


def covered_brute(docs: dict[int, bytes], span: int = SPAN) -> dict[int, list[tuple[int, int]]]:
    """The definition itself, for tests: covered runs of each document."""
    first: dict[bytes, int] = {}
    for i in sorted(docs):
        for at in range(len(docs[i]) - span + 1):
            first.setdefault(docs[i][at : at + span], i)
    out = {}
    for i, b in docs.items():
        gone = bytearray(len(b))
        for at in range(len(b) - span + 1):
            if first[b[at : at + span]] < i:
                gone[at : at + span] = b"\1" * span
        runs, k = [], 0
        while (k := gone.find(1, k)) >= 0:
            end = gone.find(0, k)
            end = len(b) if end < 0 else end
            runs.append((k, end))
            k = end
        out[i] = runs
    return out

