"""Operators that must use all of their input, against brute force, with the registered settings."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tablewright.llm import plans, ranked_search
from tablewright.llm.mixing import Mix
from tests.llm.data import documents, odd_rows, table


def whole_search(rows, k):
    """Every distinct word of a document is a query term, by its frequency times idf."""
    words = [(d, re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for d, t, *_ in rows]
    n, mean = len(words), sum(len(w) for _, w in words) / len(words)
    df = Counter(t for _, w in words for t in set(w))
    idf = {t: math.log1p((n - c + 0.5) / (c + 0.5)) for t, c in df.items()}
    out = {}
    for d in {d for d, _ in words if d is not None and d % 20 == 0}:
        freq = Counter(t for x, w in words if x == d for t in w)
        scores = []
        for x, w in words:
            c = Counter(w)
            s = math.fsum(freq[t] * idf[t] * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in freq if t in c)
            if s:
                scores.append((round(-s, 7), x is not None, x or 0))
        out[d] = sorted(scores)[:k]
    return {d: v for d, v in out.items() if v}


@pytest.mark.parametrize("shard_bytes,pack,cells", [(6 << 20, 128_000, 1 << 18), (3000, 50, 100)])
def test_a_query_is_the_whole_document(spark, monkeypatch, tmp_path, shard_bytes, pack, cells):
    monkeypatch.setattr(ranked_search, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(ranked_search, "PACK", pack)
    monkeypatch.setattr(ranked_search, "CELLS", cells)
    monkeypatch.setattr(ranked_search, "GROUPS", 3)
    monkeypatch.setattr(ranked_search, "HELD", 2)
    monkeypatch.setattr(ranked_search, "BLOCK", 4)
    # The last has words of its own only.
    rows = documents(8, 120) + odd_rows() + [(9980, "alonezza alonezzb alonezzb", "en", "a", 26)]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    found = defaultdict(list)
    for r in plans.op8_ranked_search(spark, str(tmp_path)).collect():
        found[r.doc_id].append((r["rank"], round(-r.score, 7), r.match_id is not None, r.match_id or 0))
    want = whole_search(rows, 10)
    assert set(found) == set(want) and want[9980][0][2] == 9980 and len(want) > 5
    for d, hits in want.items():
        got = sorted(found[d])
        assert [g[0] for g in got] == list(range(1, len(hits) + 1))
        assert [g[1] for g in got] == pytest.approx([h[0] for h in hits], abs=1e-6)
        assert [g[2:] for g in got] == [h[1:] for h in hits]


@pytest.mark.parametrize("span,cells", [(16, 1 << 18), (4, 1 << 18), (16, 3000)])
def test_spans_under_the_floor_stay_closed(monkeypatch, span, cells):
    """Of the bounds of 40 queries most are under the floor, and the best are those of brute force."""
    monkeypatch.setattr(ranked_search, "SPAN", span)
    monkeypatch.setattr(ranked_search, "CELLS", cells)
    rng = np.random.default_rng(5)
    # Neighbours share a topic, so that a span bounds documents that are alike.
    texts = [" ".join([*(f"c{x}" for x in rng.zipf(1.5, 20) % 30), *(f"t{i // 20}x{x}" for x in rng.integers(0, 12, 15))]).encode() for i in range(1200)]
    term, doc, freq, length = ranked_search.term_counts(texts)
    begin = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
    counts = np.diff(np.append(begin, len(term)))
    idf = dict(zip(term[begin].tolist(), np.log1p((1200 - counts + 0.5) / (counts + 0.5)).tolist()))
    empty = np.zeros(0, "<u4")
    row = {"doc_ids": np.arange(1200, dtype="<i8"), "lengths": length.astype("<u4"), "terms": term[begin], "counts": counts.astype("<u4"),
           "docs": doc.astype("<u4"), "freqs": freq.astype("<u4"), "block_docs": empty, "block_freqs": empty, "block_lengths": empty}
    shard = ranked_search.WholeShard({k: v.tobytes() for k, v in row.items()}, float(length.mean()))
    asked = list(range(0, 1200, 30))
    words = [ranked_search.term_counts([texts[i]]) for i in asked]
    weights = [np.array([f * idf[t] for t, f in zip(w[0].tolist(), w[2].tolist())]) for w in words]
    sizes = np.array([len(w) for w in weights])
    blobs = {"queries": np.array(asked), "sizes": sizes, "words": np.concatenate([w[0] for w in words]), "weights": np.concatenate(weights)}
    codes = zlib.compress(np.arange(sizes.sum(), dtype="<u4").tobytes())
    pack = ranked_search.Pack({**{k: v.tobytes() for k, v in blobs.items()}, "codes": codes})
    shard.within(pack, 10)
    assert shard.skipped > 2 * shard.opened > 0
    shares = freq * 2.2 / (freq + shard.norm[doc])
    for w, v, best in zip(words, weights, pack.best):
        weight = dict(zip(w[0].tolist(), v.tolist()))
        scores = np.bincount(doc, [weight.get(t, 0.0) * s for t, s in zip(term.tolist(), shares.tolist())], 1200)
        want = sorted((-round(s, 9), d) for d, s in enumerate(scores.tolist()))[:10]
        assert sorted((-round(s, 9), -d) for s, d in best) == want


def test_search_of_whole_documents_in_nothing(spark):
    index = ranked_search.build_index(table(spark, []))
    queries = ranked_search.document_queries(table(spark, []), index)
    assert ranked_search.search_documents(index, queries).collect() == []


def test_shards_are_not_dealt_out(spark, monkeypatch):
    """However many parts the queries have, only packs and results are shuffled."""
    rows = [r for r in documents(8, 120) if r[1]]
    df = table(spark, rows)
    index = ranked_search.build_index(df)
    queries = ranked_search.document_queries(df.where("doc_id % 20 = 0"), index)
    whole = sorted(map(tuple, ranked_search.search_documents(index, queries).collect()))
    monkeypatch.setattr(ranked_search, "PACK", 20)
    monkeypatch.setattr(ranked_search, "HELD", 1)
    found = ranked_search.search_documents(index, queries)
    assert sorted(map(tuple, found.collect())) == whole
    assert len({r[0] for r in whole}) > 3
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Repartition" in line and "true" in line]
    assert len(dealt) == 1 and "CartesianProduct" in found._jdf.queryExecution().executedPlan().toString()
    kept = plan[plan.index(dealt[0]) :]
    assert "block_docs" not in kept


def test_a_task_is_given_each_shard_and_each_pack_once(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "SHARD_BYTES", 2000)
    monkeypatch.setattr(ranked_search, "PACK", 20)
    monkeypatch.setattr(ranked_search, "GROUPS", 2)
    df = table(spark, [r for r in documents(8, 120) if r[1]])
    index = ranked_search.build_index(df)
    packs = ranked_search.packed(ranked_search.document_queries(df.where("doc_id % 20 = 0"), index))
    shards, n_packs = index.count(), packs.count()
    tasks = defaultdict(list)
    for r in ranked_search.paired(index, packs.repartition(3)).withColumn("task", F.spark_partition_id()).collect():
        tasks[r.task].append(r)
    assert shards > 8 and n_packs > 4 and sum(map(len, tasks.values())) == shards * n_packs
    for rows in tasks.values():
        for key, blobs in (("shard", ranked_search.POSTINGS), ("pack", [c for c in packs.columns if c != "pack"])):
            first = [r[key] not in {x[key] for x in rows[:i]} for i, r in enumerate(rows)]
            assert all([r[blob] is not None for r in rows] == first for blob in blobs)


def test_a_row_group_of_the_index_has_few_shards(spark, monkeypatch):
    """However many shards a task makes, readers and writers of the index hold a few."""
    monkeypatch.setattr(ranked_search, "SHARD_BYTES", 3000)
    monkeypatch.setattr(ranked_search, "FEW_SHARDS", ranked_search.FEW_SHARDS | {"parquet.block.size": 8000})
    index = ranked_search.build_index(table(spark, [r for r in documents(8, 120) if r[1]]).coalesce(1))
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in index.inputFiles()]
    groups = [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)]
    assert sum(groups) == index.count() > 8 and max(groups) <= 4


def test_texts_hashed_in_turns_give_the_same_terms(monkeypatch):
    texts = [(t or "").encode() for _, t, *_ in documents(8, 60)]
    for some in (texts, texts[:1], []):
        want = ranked_search.term_counts(some)
        for size in (1, 300, 5000):
            monkeypatch.setattr(ranked_search, "HASHED", size)
            assert all(np.array_equal(a, b) for a, b in zip(want, ranked_search.term_counts(some), strict=True))
            monkeypatch.undo()


@pytest.mark.parametrize("room", [1, 50, 1 << 20])
def test_frequencies(spark, monkeypatch, room):
    monkeypatch.setattr(ranked_search, "SHARD_BYTES", 3000)
    monkeypatch.setattr(ranked_search, "ROOM", room)
    rows = documents(8, 60) + odd_rows()
    index = ranked_search.build_index(table(spark, rows))
    want = defaultdict(int)
    for _, t, *_ in rows:
        for term in ranked_search.term_counts([(t or "").encode()])[0].view(np.int64).tolist():
            want[term] += 1
    assert sorted(map(tuple, ranked_search.frequencies(index).collect())) == sorted(want.items())


@pytest.mark.parametrize("room", [1, 2000])
def test_room_of_a_part_changes_nothing(monkeypatch, room):
    """Queries that meet many cells, or many common terms, are searched a few at a time."""
    rng = np.random.default_rng(6)
    texts = [" ".join([*(f"c{x}" for x in rng.zipf(1.5, 20) % 30), *(f"t{x}" for x in rng.integers(0, 3000, 40))]).encode() for _ in range(400)]
    term, doc, freq, length = ranked_search.term_counts(texts)
    begin = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
    row = {"doc_ids": np.arange(400, dtype="<i8"), "lengths": length.astype("<u4"), "terms": term[begin], "docs": doc.astype("<u4"),
           "counts": np.diff(np.append(begin, len(term))).astype("<u4"), "freqs": freq.astype("<u4")}
    shard = ranked_search.WholeShard({k: v.tobytes() for k, v in row.items()}, float(length.mean()))
    words = [ranked_search.term_counts([texts[i]]) for i in range(0, 400, 10)]
    sizes = np.array([len(w[0]) for w in words])
    blobs = {"queries": np.arange(0, 400, 10), "sizes": sizes, "words": np.concatenate([w[0] for w in words]), "weights": np.concatenate([w[2] * 1.5 for w in words])}
    given = {**{k: v.tobytes() for k, v in blobs.items()}, "codes": zlib.compress(np.arange(sizes.sum(), dtype="<u4").tobytes())}
    parts, part = [], shard._part
    monkeypatch.setattr(shard, "_part", lambda *a: (parts.append((len(a[3]), int(shard.cells[a[0]].sum()))), part(*a)))
    want, got = ranked_search.Pack(given), ranked_search.Pack(given)
    shard.within(want, 10)
    n = len(parts)
    monkeypatch.setattr(ranked_search, "ROOM", room)
    shard.within(got, 10)
    assert n == 1 < len(parts) - n and sum(q for q, _ in parts[n:]) == 40
    assert all(q == 1 or cells <= room for q, cells in parts[n:])
    assert [sorted(b) for b in got.best] == [sorted(b) for b in want.best] and all(len(b) == 10 for b in want.best)


@pytest.mark.parametrize("terms", [3, 12])
def test_likeness_terms_are_the_highest_by_tf_idf(spark, terms):
    rows = [r for r in documents(8, 120) if r[1]] + [(9980, "alonezza alonezzb alonezzb", "en", "a", 26)]
    df = table(spark, rows)
    asked = df.where("doc_id % 20 = 0")
    queries, _ = ranked_search.likeness_queries(asked, ranked_search.build_index(df), terms=terms, least_df=1)
    freqs = ranked_search.words_by_document(asked).withColumnRenamed("doc_id", "query")
    found = defaultdict(list)
    for r in queries.join(freqs, ["query", "term"]).collect():
        found[r.query].append(r.freq * r.weight)
    words = {d: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()) for d, t, *_ in rows}
    stands = Counter(t for w in words.values() for t in set(w))
    idf = {t: math.log1p((len(rows) - c + 0.5) / (c + 0.5)) for t, c in stands.items()}
    want = {d: sorted((n * idf[t] for t, n in Counter(w).items()), reverse=True)[:terms] for d, w in words.items() if d % 20 == 0 and w}
    assert set(found) == set(want) and len(want[9980]) == 2
    for d, best in want.items():
        assert sorted(found[d], reverse=True) == pytest.approx(best)


def test_small_sources_stay_in_the_mix(spark):
    # 40 words a source; by the weights 5, 2, 1 the targets are 75, 30 and 15 words, the last two under half a block.
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(40)), "en", f"host{i:03d}", 0) for i in range(30)]
    df = table(spark, rows)
    mix = Mix(df, weights=(5, 2, 1), most=3.0, block_words=128)
    for r in mix.taken().collect():
        assert r.target > 10 and abs(r.taken - r.target) <= r.target / 8
    assert {r.source for r in mix.documents(df).select("source").collect()} == {r[3] for r in rows}
