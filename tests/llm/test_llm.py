"""Texts: sizes, packing, mixing, shared spans; against brute force, invariants and edge cases."""

import os
import random
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings, strategies as st

pytest.importorskip("varicohort.llm")

from varicohort.llm import entry, mixing, packing, spans, tokens  # noqa: E402
from varicohort.session import rows_table  # noqa: E402


def brute_spans(docs, least):
    """Windows in a dictionary."""
    seen = defaultdict(set)
    for i, t in docs:
        if i is not None and t is not None:
            for k in range(len(t) - least + 1):
                seen[t[k : k + least]].add(i)
    out = set()
    for i, t in docs:
        if i is None or t is None:
            continue
        runs = spans.merge_runs([(k, k + least) for k in range(len(t) - least + 1) if len(seen[t[k : k + least]]) > 1])
        out |= {(i, a, b) for a, b in runs}
    return out


def made_up(seed, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé🙂") for _ in range(rng.randint(1, 7)))
    text = lambda k: " ".join(word() for _ in range(k))
    common = [text(rng.randint(4, 40)) for _ in range(8)]
    docs = []
    for i in range(n):
        parts = [text(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            c = rng.choice(common)
            a, b = sorted((rng.randint(0, len(c)), rng.randint(0, len(c))))
            parts += [c[a:b] if rng.random() < 0.5 else c, text(rng.randint(0, 20))]
        docs.append((i, "".join(parts)))
    # a third of all documents ends in one passage; copies, periodic texts, repeats, nulls, short and empty ones
    docs = [(i, t + common[0] * 2 if i % 3 == 0 else t) for i, t in docs]
    docs += [(1000, "a" * 500), (1001, "a" * 300 + "b"), (1002, "ab" * 300), (1003, "abab" * 80), (1004, docs[5][1]), (5, docs[5][1]), (7, "x" + docs[7][1]), (None, docs[3][1]), (1005, None), (1006, ""), (1007, docs[9][1] * 3)]
    return docs


@pytest.mark.parametrize("least, block, shard, chunk, per_range, fan", [(40, 10**6, 10**6, 2 * 10**6, 10**6, 256), (41, 300, 200, 9000, 500, 3), (40, 1000, 5000, 2000, 400, 2), (200, 10**6, 10**6, 9000, 10**6, 256)])
def test_shared_spans(spark, least, block, shard, chunk, per_range, fan):
    docs = made_up(least)
    df = rows_table(spark, [(i, t, "x") for i, t in docs], "doc_id bigint, text string, chunk string").repartition(3)
    got = {tuple(r) for r in spans.shared_spans(df, least, chunk_chars=chunk, block=block, shard_chars=shard, windows_per_range=per_range, fan=fan).distinct().collect()}
    assert got == brute_spans(docs, least)


def test_a_passage_in_every_chunk(spark, monkeypatch):
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    common = letters(60)
    docs = [(i, letters(10) + common + letters(10)) for i in range(200)]
    monkeypatch.setattr(spans, "CHUNKS_PER_SALT", 50)
    df = rows_table(spark, docs, "doc_id bigint, text string").repartition(4)
    got = {tuple(r) for r in spans.shared_spans(df, 40, chunk_chars=1, fan=16, windows_per_range=1000).collect()}
    assert got == brute_spans(docs, 40)


def test_no_group_holds_all_copies_of_a_window():
    """The tree over 2,000 chunks that all have one passage, and one window each in a second chunk and nowhere else."""
    n, fan, windows = 2000, 16, 21
    own = lambda c: min(c, n - 1 - c) + 1000
    rows = []
    for c in range(n):
        h = np.array([[w, 7] for w in range(windows)] + [[own(c), 7]], np.uint64)
        rows.append((False, 0, c // fan, c, *spans._pack(h, np.arange(windows + 1), np.full(windows + 1, c), np.full(windows + 1, c))))
    level, largest, got = pd.DataFrame(rows, columns=spans.COLUMNS), 0, {}
    while len(level):
        top = level["region"].nunique() == 1
        outs = []
        for _, g in level.groupby(["bucket", "region"]):
            largest = max(largest, sum(len(b) // 16 for b in g["hashes"]))
            outs.append(spans._decide(4, top, fan)(g))
        out = pd.concat(outs)
        for r in out[out["found"]].itertuples():
            got.setdefault(r.chunk, []).extend(spans._expand(r.pos, np.int64).tolist())
        level = out[~out["found"]]
    assert {c: sorted(p) for c, p in got.items()} == {c: list(range(windows + 1)) for c in range(n)}
    assert largest <= 2 * windows * fan + n


def test_order_of_a_second_attempt_does_not_matter(spark, tmp_path):
    """An attempt that reads its rows in another order writes other chunk files, and its rows refer to those."""
    store = spans._Chunks(f"file://{tmp_path}")
    for attempt, ids in ((1, [1, 2]), (2, [2, 1])):
        store.write(attempt << 24, ids, [f"text {i}" for i in ids])
    assert store.read(1 << 24)[0].tolist() == [1, 2] and store.read(2 << 24)[0].tolist() == [2, 1]


def test_windows_with_equal_halves_of_the_hash(spark):
    h = np.array([[5, 1], [5, 2], [5, 1]], np.uint64)
    pdf = pd.DataFrame([(False, 0, 0, 7, *spans._pack(h, np.array([0, 1, 2]), np.array([10, 11, 12]), np.array([7, 7, 8])))], columns=spans.COLUMNS)
    out = spans._decide(0, True, 256)(pdf)
    assert [(r.chunk, spans._expand(r.pos, np.int64).tolist()) for r in out.itertuples()] == [(7, [0]), (8, [2])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=60), min_size=1, max_size=6), st.integers(2, 12))
def test_anchors_depend_on_the_window_alone(texts, least):
    ends = np.cumsum([len(t) for t in texts])
    h, start, n = spans.anchors(spans._codes("".join(texts)), ends, least)
    covered = sorted(int(s) + k for s, m in zip(start, n) for k in range(m))
    assert covered == [int(e) - len(t) + k for t, e in zip(texts, ends) for k in range(len(t) - least + 1)]
    joined, of = "".join(texts), {}
    for x, s, m in zip(h, start, n):
        for k in range(m):
            assert of.setdefault(joined[s + k : s + k + least], x) == x


def test_rolling_hash():
    codes = spans._codes("abcabcabd" * 50)
    assert not set(spans.Rolling(codes).of(9)) & set(spans.Rolling(codes, 1).of(9))
    h = spans.Rolling(codes).of(9)
    text = "abcabcabd" * 50
    of = defaultdict(set)
    for k, x in enumerate(h):
        of[text[k : k + 9]].add(int(x))
    assert all(len(v) == 1 for v in of.values()) and len({next(iter(v)) for v in of.values()}) == len(of)


def test_shared_part(spark):
    docs = rows_table(spark, [(1, "x" * 50), (2, "y"), (3, None), (4, "x" * 40)], "doc_id bigint, text string")
    got = {r.doc_id: (r.n_chars, r.n_spans, r.shared_chars, r.shared_share) for r in spans.shared_part(docs, spans.shared_spans(docs, 40)).collect()}
    assert got == {1: (50, 1, 50, 1.0), 2: (1, 0, 0, 0.0), 3: (0, 0, 0, 0.0), 4: (40, 1, 40, 1.0)}


def test_p9_on_the_tables(spark, sf):
    docs = [tuple(r.values()) for r in pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    assert {tuple(r) for r in entry.p9_found(spark, sf).collect()} == brute_spans(docs, 200)


def test_token_sizes(spark):
    path = f"{tokens.TOKENIZER_DIR}/{tokens.VOCABULARY}"
    if not os.path.exists(path):
        pytest.skip("no vocabulary here")
    rng = random.Random(4)
    long = "".join(rng.choice(["word", " ", "\n\n", "  \t", "été", "12", "!?", "'s", " x"]) for _ in range(3000))
    whole = len(tokens.encoding(path).encode_ordinary(long))
    assert all(tokens.count_tokens(long, path, n) == whole for n in (50, 1000, 10**6)) and tokens.count_tokens("", path) == 0
    df = rows_table(spark, [(1, "a b"), (None, "<|endoftext|>"), (3, None), (4, "")], "doc_id bigint, text string")
    got = {r.doc_id: r.n_tokens for r in tokens.token_sizes(df, ["doc_id"]).collect()}
    assert got[1] == 2 and got[None] > 1 and got[4] == 0 and 3 not in got


def check_packing(rows, sizes, capacities):
    by = defaultdict(list)
    pieces = defaultdict(list)
    for r in rows:
        by[r.capacity, r.window].append((r["at"], r.n_tokens))
        pieces[r.capacity, r.piece_of].append((r.piece_no, r.token_start, r.n_tokens))
    for (cap, _), items in by.items():
        end = 0
        for at, n in sorted(items):
            assert at == end or n == 0  # no gap, no overlap
            end = max(end, at + n)
        assert end <= cap
    for cap in capacities:
        for doc, n in sizes:
            got = sorted(pieces[cap, doc])
            assert [p for p, _, _ in got] == list(range(len(got))) and sum(x for _, _, x in got) == n
            assert len(got) == max(1, -(-n // cap)) and all(x == cap for _, _, x in got[:-1])
            assert [s for _, s, _ in got] == [k * cap for k in range(len(got))]


@pytest.mark.parametrize("parts", [(100_000, 50_000), (60, 20)])
def test_packing(spark, parts):
    rng = random.Random(5)
    sizes = [(i, rng.choice([0, 1, rng.randint(1, 60), rng.randint(1, 400)])) for i in range(700)] + [(900, 100), (901, 1000), (902, 2048)]
    df = rows_table(spark, sizes, "doc_id bigint, n_tokens bigint")
    rows = packing.pack(df, [100, 64], 8, *parts).collect()
    check_packing(rows, sizes, [100, 64])
    for cap in (100, 64):
        windows = {r.window for r in rows if r.capacity == cap and r.n_tokens}
        assert len(windows) <= 1.25 * sum(n for _, n in sizes) / cap
    assert {tuple(r) for r in rows} == {tuple(r) for r in packing.pack(df.repartition(5), [100, 64], 8, *parts).collect()}


def test_packing_edges(spark):
    empty = rows_table(spark, [], "doc_id bigint, n_tokens bigint")
    assert packing.pack(empty, [10]).collect() == []
    odd = rows_table(spark, [(None, 3), (1, 4), (1, 4), (2, None)], "doc_id bigint, n_tokens bigint")
    assert sorted(r.n_tokens for r in packing.pack(odd, [10]).collect()) == [3, 4, 4]
    with pytest.raises(ValueError):
        packing.pack(empty, [0])


def test_mixing(spark):
    rng = random.Random(6)
    docs, i = [], 0
    for source, n in (("big", 4000), (" Small ", 60), ("mid", 900), ("unasked", 300), (None, 50)):
        for _ in range(n):
            docs.append((i, source, rng.choice([0, None, rng.randint(1, 300)])))
            i += 1
    docs[7] = (7, "big", 90_000)  # much longer than a block
    targets = [("big", 2.0, 1), (" BIG", 3.0, 4), ("small", 1.0, 5), ("Mid", 3.0, 2), ("absent", 1.0, 2), (None, 1.0, 1), ("zero", 0.0, 3), ("never", 2.0, 0)]
    d = rows_table(spark, docs, "doc_id bigint, source string, n_tokens bigint")
    t = rows_table(spark, targets, "source string, target_weight double, max_repeats int")
    m = mixing.mix(d, t, docs_per_bucket=100)
    shares = {r.source: r for r in m.shares.collect()}
    assert shares.keys() == {"big", "small", "mid", "absent", "unasked", None} and shares["absent"].actual_share == 0
    assert shares["unasked"].stock_tokens == sum(n or 0 for _, s, n in docs if s == "unasked") and shares["unasked"].n_chosen == 0
    size = {i: n for i, _, n in docs}
    all_tokens = sum(r.n_tokens for r in shares.values())
    for s, w in (("big", 5 / 9), ("small", 1 / 9), ("mid", 3 / 9)):
        assert abs(shares[s].n_tokens - shares[s].need_tokens) <= 45_000 and abs(shares[s].share_if_available - w) < 1e-9
    assert max(shares[s].need_tokens / shares[s].available_tokens for s in ("big", "small", "mid")) > 0.999  # what bounds the mixture
    rows = m.chosen.collect()
    copies = defaultdict(set)
    for r in rows:
        assert r.copy_no not in copies[r.doc_id]
        copies[r.doc_id].add(r.copy_no)
    assert all(len(c) <= {"big": 1, " Small ": 5, "mid": 2}[docs[i][1]] and size[i] for i, c in copies.items())
    # slots are filled, with documents of one source and about equal tokens; ranks have no gap before the end
    slots = defaultdict(list)
    for r in rows:
        slots[r.slot].append(r)
    assert all(len({r.source for r in x}) == 1 for x in slots.values())
    full = [sum(r.n_tokens for r in x) for x in slots.values()]
    usual = [n for n in full if n < 90_000]
    assert sum(abs(n - m.block_tokens) <= 300 for n in usual) > 0.9 * len(usual)
    # every prefix is mixed: the first third of the slots has about the same shares, the long document aside
    last = sorted(slots)[len(slots) // 3]
    first = defaultdict(int)
    for r in rows:
        if r.slot < last and r.doc_id != 7:
            first[r.source] += r.n_tokens
    assert abs(first["mid"] / (first["mid"] + first["small"]) - 3 / 4) < 0.12
    assert {tuple(r) for r in rows} == {tuple(r) for r in mixing.mix(d.repartition(7), t, docs_per_bucket=100).chosen.collect()}
    over = {r.source: r for r in mixing.mix(d, t, total_tokens=10**7).shares.collect()}
    assert over["small"].n_tokens == 5 * over["small"].stock_tokens and over["big"].n_tokens == over["big"].stock_tokens
    assert over["small"].need_tokens > over["small"].available_tokens == over["small"].n_tokens
    assert mixing.mix(d.limit(0), t).chosen.collect() == [] and mixing.mix(d, t.limit(0)).chosen.collect() == []


def test_schedule_is_even(spark):
    rows = mixing.schedule(spark, 5000, [("a", 1.0), ("b", 3.0)], chunk=64).orderBy("slot").collect()
    k = defaultdict(int)
    for r in rows:
        assert r.k == k[r.source]
        k[r.source] += 1
        assert abs(k["a"] - (r.slot + 1) / 4) < 4


CLASH = ["chunk", "anchor", "slot", "k", "window", "at", "leftover", "copy_no", "n_tokens", "capacity", "target", "passage"]


@pytest.mark.parametrize("name", sorted(entry.QUERIES))
def test_empty_and_dirty(spark, sf, tmp_path, name):
    for kind in ("empty", "dirty"):
        os.makedirs(tmp_path / kind)
        for t in ("documents", "pack_sizes", "mix_targets"):
            rows = pq.read_table(f"{sf}/{t}.parquet")
            if kind == "empty" and t == "documents":
                rows = rows.slice(0, 0)
            elif t == "documents":
                nulls = [rows.slice(j, 1).set_column(j, f, pa.nulls(1, f.type)) for j, f in enumerate(rows.schema)]
                rows = pa.concat_tables([rows, rows.slice(0, 20), *nulls, pa.table({f.name: pa.nulls(1, f.type) for f in rows.schema}, schema=rows.schema)])
                for c in CLASH:
                    rows = rows.append_column(c, pa.array(["x"] * rows.num_rows))
            pq.write_table(rows, tmp_path / kind / f"{t}.parquet")
    none = entry.QUERIES[name](spark, str(tmp_path / "empty")).collect()
    assert none == [] or name in ("p8_shares", "p8_capped") and all(r.n_tokens == 0 for r in none) or name == "p8_check" and all(r.n == 0 or r.rule == "targets" for r in none)
    rows = entry.QUERIES[name](spark, str(tmp_path / "dirty")).collect()
    assert rows
    if name.endswith("_check"):
        con = duckdb.connect()
        for t in ("documents", "pack_sizes", "mix_targets"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        df = entry.QUERIES[name](spark, sf)
        cur = con.execute(entry.SQL[name])
        at = [x[0] for x in cur.description]
        assert sorted(tuple(r) for r in df.collect()) == sorted(tuple(r[at.index(c)] for c in df.columns) for r in cur.fetchall())
    if name == "p9_found":
        d = [tuple(r.values()) for r in pq.read_table(tmp_path / "dirty/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
        assert {tuple(r) for r in rows} == brute_spans(d, 200)
