"""Long exact spans shared between documents: repeated-phrase automata.

1. Fingerprint. Every window of ``least`` code points names one anchor in it: the place of the smallest hash of
   ``least // 2`` code points, a choice that depends on the window's text alone. Texts are written in chunks to the
   shared folder on the way; anchors that occur in one document only are dropped.
2. Confirm. The windows of the remaining anchors are hashed whole, with 128 bits, and compared by ranges of the hash: first
   among the chunks of a region, then among regions of regions, up a tree of fixed fan. A window with two documents is a
   recurring one as soon as they meet; above, two entries stand for it whatever number of documents below has it. Every
   chunk learns where its own recurring windows begin.
3. Locate. Every chunk cuts its recurring windows into passages, compiles them into Aho-Corasick automata, in shards of
   bounded size, and streams all its documents through them. A hit is extended letter by letter along the passage; stretches
   of at least ``least`` code points are shared, and stretches that touch are one run.

What travels is one fingerprint for about ``least // 4`` code points, and hashes and places of candidate windows, at most two
for a window and chunk; texts never do. No pair of documents is formed, and no group holds more than a region of a tree.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, functions as F

from varicohort.session import fresh_path, parallelism, written

CHUNK_CHARS = 2_000_000
BLOCK = 1_000_000
SHARD_CHARS = 1_000_000
WINDOWS_PER_RANGE = 1_000_000
FAN = 256  # chunks of a region, and regions of the next one
CHUNKS_PER_SALT = 1 << 20
MOST_TASKS = 32_768
_U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd, hence invertible modulo 2**64


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(n, b, _U)
            p[0] = 1
            both.append(np.cumprod(p, dtype=_U))
        _POWERS[base] = (both[0], both[1])
    return _POWERS[base][0][:n], _POWERS[base][1][:n]


class Rolling:
    """Hashes of all stretches of a given length in an array of code points; ``which`` of two independent ones."""

    def __init__(self, codes: np.ndarray, which: int = 0):
        up, self.down = _powers(_BASES[which], len(codes) + 1)
        self.n = len(codes)
        self.sums = np.zeros(self.n + 1, _U)
        np.cumsum(_mix(codes.astype(_U) + _U(1 + (which << 40))) * up[:-1], out=self.sums[1:])

    def of(self, k: int) -> np.ndarray:
        return _mix((self.sums[k:] - self.sums[:-k]) * self.down[: self.n - k + 1])


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _least_in(a: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every ``w`` consecutive values, from running minima within blocks."""
    n = len(a)
    p = np.full(-(-n // w) * w, np.iinfo(_U).max, _U)
    p[:n] = a
    p = p.reshape(-1, w)
    ahead = np.minimum.accumulate(p, 1).ravel()
    back = np.minimum.accumulate(p[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchors(codes: np.ndarray, ends: np.ndarray, least: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with the same anchor: (hash of the anchor, first window start, number of windows).

    codes: texts one after the other; ends: where each ends. Windows do not cross the end of a text. Among equal
    hashes in a window the last one is its anchor.
    """
    k = least // 2
    mask = _U((1 << 24) - 1)
    found: list[tuple[np.ndarray, ...]] = []
    for at in range(0, max(0, len(codes) - least + 1), block):
        part = codes[at : at + block + least - 1]
        if len(part) < least:
            break
        h = Rolling(part).of(k)
        key = (h & ~mask) | (mask - np.arange(len(h), dtype=_U))
        best = _least_in(key, least - k + 1)
        anchor = (mask - (best & mask)).astype(np.int64)
        start = np.arange(at, at + len(anchor))
        doc = np.searchsorted(ends, start, "right")
        inside = start + least <= ends[np.minimum(doc, len(ends) - 1)]
        start, anchor, doc = start[inside], anchor[inside], doc[inside]
        if not len(start):
            continue
        cut = np.flatnonzero(np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(doc) != 0) | (np.diff(start) != 1)]))
        found.append((h[anchor[cut]], start[cut], np.diff(np.append(cut, len(start)))))
    if not found:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


_ZSTD = zstandard.ZstdCompressor(3)


def _squeeze(a: np.ndarray) -> bytes:
    """Sorted numbers as differences, compressed."""
    return _ZSTD.compress(np.diff(a, prepend=a.dtype.type(0)).tobytes())


def _expand(b: bytes, dtype) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(b), dtype), dtype=dtype)


class _Chunks:
    """The chunk files in the shared folder."""

    def __init__(self, folder: str):
        self.fs, self.base = pafs.FileSystem.from_uri(folder)

    def write(self, chunk: int, ids: list[int], texts: list[str]) -> None:
        # the number holds the attempt's, so whatever order another attempt reads in, rows and file stay together
        out = io.BytesIO()
        pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string())}), out, compression="zstd", compression_level=3, use_dictionary=False)
        self.fs.create_dir(self.base, recursive=True)
        with self.fs.open_output_stream(f"{self.base}/{chunk}.parquet") as f:
            f.write(out.getvalue())

    def read(self, chunk: int) -> tuple[np.ndarray, list[str], np.ndarray]:
        t = pq.read_table(f"{self.base}/{chunk}.parquet", filesystem=self.fs)
        texts = t["text"].to_pylist()
        return t["doc_id"].to_numpy(), texts, np.cumsum([len(x) for x in texts])


def _fingerprint(folder: str, least: int, chunk_chars: int, block: int):
    def emit(store: _Chunks, chunk: int, ids: list[int], texts: list[str]) -> pa.RecordBatch | None:
        store.write(chunk, ids, texts)
        ends = np.cumsum([len(t) for t in texts])
        h, start, n = anchors(_codes("".join(texts)), ends, least, block)
        if not len(h):
            return None
        doc = np.asarray(ids, np.int64)[np.searchsorted(ends, start, "right")]
        order = np.lexsort((start, h))
        h, start, n, doc = h[order], start[order], n[order], doc[order]
        cut = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        edge = np.append(cut, len(h))
        runs = np.stack([start, n], 1).astype("<i4")
        flat = runs.tobytes()
        blobs = [flat[8 * a : 8 * b] for a, b in zip(edge[:-1], edge[1:])]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(cut), chunk, np.int64)), pa.array(h[cut].view(np.int64)), pa.array(np.minimum.reduceat(doc, cut)), pa.array(np.maximum.reduceat(doc, cut)), pa.array(np.add.reduceat(n, cut)), pa.array(blobs, pa.binary())],
            names=["chunk", "anchor", "lo", "hi", "windows", "runs"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, part = _Chunks(folder), TaskContext.get().taskAttemptId()
        ids: list[int] = []
        texts: list[str] = []
        size = made = 0
        for b in batches:
            for i, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
                if len(t) < least:
                    continue
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size >= chunk_chars:
                    out = emit(store, (part << 24) | made, ids, texts)
                    ids, texts, size, made = [], [], 0, made + 1
                    if out is not None:
                        yield out
        if ids and (out := emit(store, (part << 24) | made, ids, texts)) is not None:
            yield out

    return run


def _pack(h: np.ndarray, pos: np.ndarray, doc: np.ndarray, chunk: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    return np.ascontiguousarray(h).tobytes(), _squeeze(pos), _squeeze(doc), _squeeze(chunk)


def _cuts(a: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin in sorted arrays, and the end."""
    new = np.ones(len(a), bool)
    new[1:] = a[1:] != a[:-1]
    for x in more:
        new[1:] |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(new), len(a))


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    cuts = _cuts(bucket[order])
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield int(bucket[order[a]]), order[a:b]


COLUMNS = ["found", "bucket", "region", "chunk", "hashes", "pos", "docs", "chunks"]
PACKED = "found boolean, bucket bigint, region bigint, chunk bigint, hashes binary, pos binary, docs binary, chunks binary"


def _window_hashes(folder: str, least: int, buckets: int, regions: int, block: int):
    """Recurring anchors of a chunk to the whole hashes of their windows, one row per range of the hash."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        chunk = int(pdf["chunk"].iloc[0])
        ids, texts, ends = _Chunks(folder).read(chunk)
        runs = np.frombuffer(b"".join(pdf["runs"]), "<i4").reshape(-1, 2).astype(np.int64)
        runs = runs[np.argsort(runs[:, 0])]
        n = runs[:, 1]
        pos = np.repeat(runs[:, 0] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        doc = np.searchsorted(ends, pos, "right")
        begins = np.concatenate([[0], ends[:-1]])
        hashes = np.empty((len(pos), 2), _U)
        at = 0
        edges = _cuts(doc)
        while at < len(edges) - 1:  # some documents at a time
            to, size = at, 0
            while to < len(edges) - 1 and (to == at or size < block):
                size += len(texts[doc[edges[to]]])
                to += 1
            some = [doc[edges[j]] for j in range(at, to)]
            lens = np.array([len(texts[d]) for d in some])
            moved = np.repeat(np.cumsum(lens) - lens - begins[some], np.diff(edges[at : to + 1]))
            sl = slice(edges[at], edges[to])
            where = pos[sl] + moved
            codes = _codes("".join(texts[d] for d in some))
            for b in range(0, len(codes), block):
                inside = (where >= b) & (where < b + block)
                if inside.any():
                    for k in (0, 1):
                        hashes[sl.start + np.flatnonzero(inside), k] = Rolling(codes[b : b + block + least - 1], k).of(least)[where[inside] - b]
            at = to
        owner = ids[doc]
        order = np.lexsort((pos, owner, hashes[:, 1], hashes[:, 0]))
        h, o = hashes[order], owner[order]
        cuts = _cuts(h[:, 0], h[:, 1])
        first, last = cuts[:-1], cuts[1:] - 1
        # once per chunk, or twice if two documents of the chunk have it
        keep = np.sort(np.concatenate([order[first], order[last[o[last] != o[first]]]]))
        h, pos, owner = hashes[keep], pos[keep], owner[keep]
        region = int(_mix(np.array([chunk], _U))[0] % _U(regions))
        out = []
        for bucket, s in _by_bucket((h[:, 0] % _U(buckets)).astype(np.int64)):
            out.append((False, bucket, region, chunk, *_pack(h[s], pos[s], owner[s], np.full(len(s), chunk, np.int64))))
        return pd.DataFrame(out, columns=COLUMNS)

    return run


def _decide(buckets: int, last: bool, fan: int):
    """Entries of one range of the hash and one region: places in recurring windows to their chunks, the rest a level up.

    Upwards go the entries of windows that have one document so far, and for a recurring window its least and largest
    document without a place, so that entries from elsewhere meet them.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.frombuffer(b"".join(pdf["hashes"]), _U).reshape(-1, 2)
        pos, doc, chunk = (np.concatenate([_expand(b, np.int64) for b in pdf[c]]) for c in ("pos", "docs", "chunks"))
        order = np.lexsort((doc, h[:, 1], h[:, 0]))
        h, pos, doc, chunk = h[order], pos[order], doc[order], chunk[order]
        cuts = _cuts(h[:, 0], h[:, 1])
        head, tail = cuts[:-1], cuts[1:] - 1
        recurs = doc[head] != doc[tail]
        several = np.repeat(recurs, np.diff(cuts))
        told = several & (chunk >= 0)
        out = []
        c, p = chunk[told], pos[told]
        by = np.lexsort((p, c))
        c, p = c[by], p[by]
        edges = _cuts(c) if len(c) else np.zeros(1, np.int64)
        for a, b in zip(edges[:-1], edges[1:]):
            out.append((True, None, None, int(c[a]), None, _squeeze(p[a:b]), None, None))
        if not last:
            ends = np.concatenate([head[recurs], tail[recurs]])
            up = np.concatenate([np.flatnonzero(~several), ends])
            place = np.concatenate([np.ones((~several).sum(), bool), np.zeros(len(ends), bool)])
            region = int(pdf["region"].iloc[0]) // fan
            for bucket, s in _by_bucket((h[up, 0] % _U(buckets)).astype(np.int64)):
                u, here = up[s], place[s]
                out.append((False, bucket, region, None, *_pack(h[u], np.where(here, pos[u], -1), doc[u], np.where(here, chunk[u], -1))))
        return pd.DataFrame(out, columns=COLUMNS).astype({"bucket": "Int64", "region": "Int64", "chunk": "Int64"})

    return run


def passages_at(starts: np.ndarray, texts: list[str], ends: np.ndarray, least: int) -> list[str]:
    """The texts that windows beginning at ``starts`` cover; windows that begin one after the other are one passage."""
    doc = np.searchsorted(ends, starts, "right")
    cuts = np.append(np.flatnonzero(np.concatenate([[True], (np.diff(starts) != 1) | (np.diff(doc) != 0)])), len(starts))
    out = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        d = doc[a]
        begin = ends[d] - len(texts[d])
        out.append(texts[d][starts[a] - begin : starts[b - 1] - begin + least])
    return out


def _same_ahead(a: str, i: int, b: str, j: int) -> int:
    """Number of equal code points from a[i] and b[j] on."""
    most = min(len(a) - i, len(b) - j)
    n, step = 0, 64
    while n < most:
        m = min(step, most - n)
        if a[i + n : i + n + m] == b[j + n : j + n + m]:
            n, step = n + m, step * 2
        elif m == 1:
            break
        else:
            step = max(1, m // 2)
    return n


def _same_behind(a: str, i: int, b: str, j: int) -> int:
    most = min(i, j)
    n, step = 0, 64
    while n < most:
        m = min(step, most - n)
        if a[i - n - m : i - n] == b[j - n - m : j - n]:
            n, step = n + m, step * 2
        elif m == 1:
            break
        else:
            step = max(1, m // 2)
    return n


def locate(passages: list[str], texts: list[str], least: int, shard_chars: int = SHARD_CHARS) -> list[list[tuple[int, int]]]:
    """For each text the runs of code points that lie in stretches of at least ``least`` found in some passage."""
    import ahocorasick

    piece = least // 2  # every stretch of ``least`` holds a whole piece cut at a multiple of this
    found: list[list[tuple[int, int]]] = [[] for _ in texts]
    shard: list[str] = []
    size = 0
    queue = sorted(set(passages))
    for n, p in enumerate(queue):
        shard.append(p)
        size += len(p)
        if size < shard_chars and n + 1 < len(queue):
            continue
        automaton, at = ahocorasick.Automaton(), {}
        for k, q in enumerate(shard):
            for o in range(0, len(q) - piece + 1, piece):
                at.setdefault(q[o : o + piece], []).append((k, o))
        for word, places in at.items():
            automaton.add_word(word, places)
        automaton.make_automaton()
        for t, text in enumerate(texts):
            seen: dict[tuple[int, int], int] = {}  # passage and shift: up to where it has been followed
            for end, places in automaton.iter(text):
                begin = end + 1 - piece
                for k, o in places:
                    if seen.get((k, begin - o), -1) >= end:
                        continue
                    q = shard[k]
                    right = begin + _same_ahead(text, begin, q, o)
                    left = begin - _same_behind(text, begin, q, o)
                    seen[(k, begin - o)] = right - 1
                    if right - left >= least:
                        found[t].append((left, right))
        shard, size = [], 0
    return [merge_runs(x) for x in found]


def merge_runs(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching stretches as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _locate(folder: str, least: int, shard_chars: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, texts, ends = _Chunks(folder).read(int(pdf["chunk"].iloc[0]))
        starts = np.unique(np.concatenate([_expand(b, np.int64) for b in pdf["pos"]]))
        found = locate(passages_at(starts, texts, ends, least), texts, least, shard_chars)
        rows = [(int(i), a, b) for i, spans in zip(ids, found) for a, b in spans]
        return pd.DataFrame(rows, columns=["doc_id", "span_start", "span_end"]).astype({"doc_id": "int64", "span_start": "int32", "span_end": "int32"})

    return run


def shared_spans(documents: DataFrame, least: int = 200, id_col: str = "doc_id", text: str = "text", chunk_chars: int = CHUNK_CHARS, block: int = BLOCK, shard_chars: int = SHARD_CHARS, windows_per_range: int = WINDOWS_PER_RANGE, fan: int = FAN) -> DataFrame:
    """(doc_id, span_start, span_end): the longest runs in which every code point lies in a shared stretch.

    A stretch of ``least`` code points is shared if it occurs in the text of a document with another id. Rows without
    id or text, and texts shorter than ``least``, have no spans; rows repeated under one id are one document. Positions
    are code points from 0, the end is exclusive. Windows of different texts are told apart by 128 bits.

    chunk_chars, block, shard_chars, windows_per_range and fan bound what a task holds at once; the result is the same
    for all of them.
    """
    spark = documents.sparkSession
    folder = fresh_path(spark, "chunks")
    docs = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    prints = written(docs.mapInArrow(_fingerprint(folder, least, chunk_chars, block), "chunk bigint, anchor bigint, lo bigint, hi bigint, windows bigint, runs binary"), "fingerprints")
    n_chunks = prints.select("chunk").distinct().count()
    tasks = lambda n: min(MOST_TASKS, 2 * max(parallelism(spark), n))
    recurring = prints.groupBy("anchor").agg(F.min("lo").alias("least_id"), F.max("hi").alias("most_id")).where("least_id != most_id").select("anchor")
    mine = prints.select("chunk", "anchor", "windows", "runs")
    keys = ["anchor"]
    if (salts := ceil(n_chunks / CHUNKS_PER_SALT)) > 1:  # an anchor has a row in every chunk at most
        recurring = recurring.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        mine, keys = mine.withColumn("salt", F.pmod(F.xxhash64("chunk"), F.lit(salts)).cast("int")), ["anchor", "salt"]
    candidates = written(mine.join(recurring, keys).select("chunk", "windows", "runs"), "candidates")
    windows = candidates.agg(F.sum("windows")).first()[0] or 0
    regions = [max(1, ceil(n_chunks / fan))]
    while regions[-1] > 1:
        regions.append(ceil(regions[-1] / fan))
    # as many ranges of the hash as the windows of a region ask for
    buckets = [max(ceil(parallelism(spark) / regions[0]), ceil(windows / regions[0] / windows_per_range))]
    for a, b in zip(regions[:-1], regions[1:]):
        buckets.append(buckets[-1] * ceil(a / b))
    entries = candidates.drop("windows").repartition(tasks(n_chunks), "chunk").groupBy("chunk").applyInPandas(_window_hashes(folder, least, buckets[0], regions[0], block), PACKED)
    found = []
    for k, (b, r) in enumerate(zip(buckets, regions)):
        top = r == 1
        out = entries.repartition(tasks(b * r), "bucket", "region").groupBy("bucket", "region").applyInPandas(_decide(0 if top else buckets[k + 1], top, fan), PACKED)
        out = out if top else written(out, "windows")  # read twice
        found.append(out.where("found").select("chunk", "pos"))
        entries = out.where("NOT found")
    places = reduce(DataFrame.unionByName, found)
    return places.repartition(tasks(n_chunks), "chunk").groupBy("chunk").applyInPandas(_locate(folder, least, shard_chars), "doc_id bigint, span_start int, span_end int")


def shared_part(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, n_chars, n_spans, shared_chars, shared_share) of every row with an id, documents without spans included."""
    per = spans.groupBy("doc_id").agg(F.count("*").alias("n_spans"), F.sum((F.col("span_end") - F.col("span_start")).cast("bigint")).alias("shared_chars"))
    size = F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint")
    d = documents.where("doc_id IS NOT NULL").select("doc_id", size.alias("n_chars")).join(per, "doc_id", "left")
    got = F.coalesce("shared_chars", F.lit(0))
    return d.select("doc_id", "n_chars", F.coalesce("n_spans", F.lit(0)).alias("n_spans"), got.alias("shared_chars"), F.when(F.col("n_chars") > 0, got / F.col("n_chars")).otherwise(F.lit(0.0)).alias("shared_share"))
