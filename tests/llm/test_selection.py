"""Mixing, decontamination, toxicity, search, chats and the pipeline."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tablewright.llm import chat_format, decontamination, plans, ranked_search, toxicity
from tablewright.llm.decontamination import drop_contaminated, find_contamination
from tablewright.llm.mixing import Mix, schedule, targets
from tests.llm.data import documents, odd_rows, table

SMALL = "/root/testdata/sf0.001"


# Mixing


def shared_out(sizes, weights=(5, 2, 1), most=3.0):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    open_names, target, left = set(names), dict.fromkeys(names, 0.0), float(sum(sizes.values()))
    while open_names and left > 1e-9:
        total = sum(weight[s] for s in open_names)
        give, left = left, 0.0
        for s in list(open_names):
            target[s] += give * weight[s] / total
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_names.discard(s)
    return target


@pytest.mark.parametrize("seed", range(6))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {name: rng.choice([0, 1, 10, 10, 500, 4000]) for name in ["b", "a", "ä", "Z", "😀", "￿", None, "c", ""][: 2 + seed]}
    df = spark.createDataFrame([(s, 1, n) for s, n in sizes.items()], "source string, rows long, source_size long")
    found = {r.source: r.target for r in targets(df).collect()}
    assert found == pytest.approx(shared_out(sizes), rel=1e-9, abs=1e-6)


def count(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("rows", [documents(3, 150), odd_rows()])
def test_taken_words(spark, rows):
    df = table(spark, rows)
    mix = Mix(df, block_words=16)
    found = mix.taken().collect()
    assert sorted((str(r.doc_id), r["size"]) for r in found) == sorted((str(r[0]), count(r[1])) for r in rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += count(r[1])
    want, taken = shared_out(sizes), Counter()
    source = defaultdict(set)
    for r in rows:
        source[r[0], count(r[1])].add(r[3])
    for r in found:
        assert 0 <= r.taken <= 3 * r["size"]
        assert any(r.source_size == sizes[s] and r.target == pytest.approx(want[s]) for s in source[r.doc_id, r["size"]])
        taken[r.target] += r.taken
    for target, words in taken.items():
        alike = sum(want[s] == pytest.approx(target) for s in want)
        assert abs(words - alike * target) <= 16 * alike
    again = Mix(table(spark, rows[::-1]), block_words=16).taken()
    assert sorted(map(repr, again.select(*sorted(again.columns)).collect())) == sorted(
        map(repr, mix.taken().select(*sorted(again.columns)).collect())
    )


def test_any_part_of_the_schedule_has_the_shares(spark):
    plan = spark.createDataFrame([("a", 100, 500, 0), ("b", 30, 300, 500), (None, 7, 200, 800)], "source string, blocks long, slots long, low long")
    slots = schedule(plan, 10).orderBy("slot").collect()
    assert len({r.slot for r in slots}) == 1000
    for n in (64, 128, 512):
        seen = Counter(r.source for r in slots if r.slot < n)
        for name, share in (("a", 500), ("b", 300), (None, 200)):
            assert abs(seen[name] - n * share / 1024) <= 2
    turns = [r.block + 30 * r.turn for r in slots if r.source == "b"]
    assert turns == list(range(300))


def test_mixed_documents(spark):
    rows = documents(3, 150) + [documents(3, 150)[4]] * 3
    df = table(spark, rows).withColumn("_doc", F.lit(1)).withColumn("tie", F.lit("x"))
    out = Mix(df, block_words=16).documents(df)
    assert out.columns == df.columns
    sizes, got = Counter(), Counter()
    for r in rows:
        sizes[r[3]] += count(r[1])
    known = {repr(r) for r in df.collect()}
    for r in out.collect():
        assert repr(r) in known
        got[r.source] += count(r.text)
    for s, t in shared_out(sizes).items():
        assert abs(got[s] - t) <= 3200
    assert Mix(table(spark, [])).taken().collect() == []
    assert Mix(table(spark, [])).documents(table(spark, [])).collect() == []


# Decontamination


def tokens(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def hits(docs, items, width=13):
    grams = defaultdict(set)
    for item, text in items:
        w = tokens(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            grams[tuple(w[i : i + width])].add(str(item))
    lengths = {len(g) for g in grams}
    out = []
    for doc, text, *_ in docs:
        w = tokens(text)
        hit, found = [False] * len(w), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit[i : i + n] = [True] * n
                    found |= grams[tuple(w[i : i + n])]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((str(doc), len(w), sum(hit), len(found), digest, sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return sorted(out)


def contamination_case():
    docs = documents(6, 80) + [(None, "Two-WORDS only", None, None, 1)]
    rng = random.Random(1)
    items = [(1, None), (2, ""), (3, "two words"), (30, "Two, Words!"), (4, "é"), (5, "?!")]
    for n in range(20):
        words = (rng.choice(docs)[1] or "none").split()
        at = rng.randrange(len(words)) if words else 0
        items.append((100 + n, " ".join(words[at : at + rng.randrange(3, 60)]).upper().replace("É", "é")))
    return docs, items + [items[-1]]


@pytest.mark.parametrize("block", [200_000, 25])
def test_contamination(spark, block):
    docs, items = contamination_case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = table(spark, docs).withColumns({"_spans": F.lit(1), "n_words": F.lit(2)})
    found = find_contamination(df, bench, block_windows=block).collect()
    want = hits(docs, items)
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found) == want
    assert any(w[5] for w in want) and any(w[2] and not w[5] for w in want)
    left = drop_contaminated(df, bench, block_windows=block)
    assert left.columns == df.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(w[0] for w in want if not w[5])


def test_no_benchmark_and_no_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = documents(1, 20)
    assert not any(r.contaminated for r in find_contamination(table(spark, docs), none).collect())
    some = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert find_contamination(table(spark, []), some).collect() == []


def test_windows_with_one_rarest_word_are_told_apart():
    windows = [((b"rare", b"a", b"b"), ("1",)), ((b"a", b"rare", b"b"), ("2",)), ((b"rare", b"a", b"c"), ("3",)), ((b"b",), ("4",))]
    block = decontamination.WindowBlock(windows, {b"a": 9, b"b": 9, b"c": 9, b"rare": 1})
    words = decontamination.Words([b"rare a", b"a rare b rare a c"], decontamination.NON_ALNUM)
    begin, window = block.matches(words, words.hashes())
    assert sorted((b, block.items[w][0]) for b, w in zip(begin.tolist(), window.tolist())) == [(2, "2"), (4, "4"), (5, "3")]


# Toxicity


def test_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Network(1)
    types = toxicity.Types([b"one two three four five six", b"seven one ab"])
    goal = np.array([1.0, 0.0], np.float32)

    def loss():
        odds = net.forward(net.project(types)[1], types.windows).astype(np.float64)
        return float(np.mean(np.log1p(np.exp(odds)) - goal * odds))

    caught = {}
    net._descend = lambda grad, rate: caught.update(grad)
    net.learn(types, types.windows, goal, 0.0)
    for name in ("out", "attend", "Uf", "Wb", "cf", "grams", "words"):
        weights, grad = net.p[name], caught[name]
        used = np.argwhere(np.abs(grad) > np.abs(grad).max() * 0.3)
        for at in map(tuple, used[rng.choice(len(used), min(4, len(used)), replace=False)]):
            keep = weights[at]
            weights[at] = keep + 0.02
            up = loss()
            weights[at] = keep - 0.02
            down = loss()
            weights[at] = keep
            assert (up - down) / 0.04 == pytest.approx(grad[at], rel=0.1, abs=2e-4), name


def toxic_case(n=260):
    rng = random.Random(7)
    clean = ["".join(rng.choice("abcdeilnorst") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(clean) for _ in range(rng.randrange(3, 150))]
        bad = i % 3 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words) + 1), rng.choice(["VILEST", "grimzug", "Grimzugly", "vile"]))
        rows.append((i, " ".join(words), "en", "a", 1))
        labels.append((i, 0, int(bad)))
    return rows, labels


@pytest.fixture(scope="module")
def trained(spark):
    rows, labels = toxic_case()
    df, known = table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return rows, labels, df, toxicity.fit(df, known)


def test_held_out_accuracy(spark, trained):
    rows, labels, df, weights = trained
    truth = {i: t for i, _, t in labels}
    scored = toxicity.score(df, weights).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    held = [r for r in scored if r.held]
    assert len(held) > 60 and sum((r.score >= 0.7) == truth[r.doc_id] for r in held) >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 for r in scored)


def test_the_end_of_a_long_text_counts(spark, trained):
    rows, labels, df, weights = trained
    clean = next(r[1] for r in rows if r[0] % 3 == 1)
    cases = [(None, None), (1, ""), (2, "?!\n"), (3, " ".join([clean] * 60)), (4, " ".join([clean] * 60) + " vilest grimzug vile"), (4, "vile")]
    made = spark.createDataFrame([(i, t, 0.5, "x") for i, t in cases], "doc_id long, text string, score double, toxic string")
    found = toxicity.score(made, weights).collect()
    assert len(found) == len(cases)
    by_text = {r.text: r.score for r in found}
    assert by_text[None] == by_text[""] == by_text["?!\n"] == 0.0
    assert by_text[cases[4][1]] > by_text[cases[3][1]]
    kept = toxicity.drop_toxic(made.withColumn("_toxicity", F.lit("own")), weights).collect()
    assert {r["_toxicity"] for r in kept} == {"own"} and None in {r.text for r in kept}


def test_learning_needs_both_labels_and_ignores_the_held_out(spark, trained):
    rows, labels, df, weights = trained
    one = spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(df, toxicity.fit(df, one)).collect()} == {0.0}
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(table(spark, []), toxicity.fit(df, none)).collect() == []
    known = spark.createDataFrame([(i, t) for i, _, t in labels] + [(None, 1), (5, None)], "doc_id long, toxic int")
    turned = known.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    sample = [sorted(map(tuple, toxicity.training_sample(df, t).collect())) for t in (known, turned)]
    assert sample[0] == sample[1]


# Search


def direct_search(rows, terms, k):
    words = [(d, re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for d, t, *_ in rows]
    n, mean = len(words), sum(len(w) for _, w in words) / len(words)
    df = Counter(t for _, w in words for t in set(w))
    idf = {t: math.log1p((n - c + 0.5) / (c + 0.5)) for t, c in df.items()}
    counts = [(d, Counter(w), len(w)) for d, w in words]
    out = {}
    for d in {d for d, _ in words if d is not None and d % 20 == 0}:
        freq = Counter(t for x, w in words if x == d for t in w)
        chosen = {t for t in freq if df[t] > 1}
        assert len(chosen) <= terms
        scores = []
        for x, c, length in counts:
            s = sum(idf[t] * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * length / mean)) for t in chosen if t in c)
            if s:
                scores.append((round(-s, 9), x is not None, x or 0))
        out[d] = sorted(scores)[:k]
    return out


@pytest.mark.parametrize("shard_bytes,part", [(16 << 20, 200_000), (3000, 5)])
def test_search(spark, monkeypatch, shard_bytes, part):
    monkeypatch.setattr(ranked_search, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(ranked_search, "PART", part)
    monkeypatch.setattr(ranked_search, "BLOCK", 4)
    # All terms are query terms, so ties in their choice do not matter.
    rows = documents(8, 120) + odd_rows()
    df = table(spark, rows)
    index = ranked_search.build_index(df)
    assert index.agg(F.sum("n_docs")).first()[0] == len(rows)
    queries, held = ranked_search.likeness_queries(df.where("doc_id % 20 = 0"), index, terms=10_000)
    found = defaultdict(list)
    for r in ranked_search.search(index, queries, held, k=5).collect():
        found[r["query"]].append((r["rank"], round(-r.score, 9), r.doc_id is not None, r.doc_id or 0))
    want = {d: v for d, v in direct_search(rows, 10_000, 5).items() if v}
    assert set(found) == set(want) and len(want) > 3
    for d, hitlist in want.items():
        got = sorted(found[d])
        assert [g[0] for g in got] == list(range(1, len(hitlist) + 1))
        assert [g[1] for g in got] == pytest.approx([h[0] for h in hitlist], abs=1e-8)
        assert [g[2:] for g in got] == [h[1:] for h in hitlist]


def test_search_in_nothing(spark):
    empty = table(spark, [])
    index = ranked_search.build_index(empty)
    queries, held = ranked_search.likeness_queries(empty, index)
    assert ranked_search.search(index, queries, held).collect() == []


def test_pruning_skips_and_stays_exact():
    rng = np.random.default_rng(3)
    texts = [b" ".join(f"t{int(x)}".encode() for x in rng.zipf(1.4, 40) % 50) for _ in range(3000)]
    term, doc, freq, length = ranked_search.term_counts(texts)
    begin = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
    counts = np.diff(np.append(begin, len(term)))
    starts, _ = ranked_search.block_starts(counts)
    ends = np.append(starts[1:], len(term)) - 1
    row = {
        "doc_ids": np.arange(3000, dtype="<i8"), "lengths": length.astype("<u4"), "terms": term[begin], "counts": counts.astype("<u4"),
        "docs": doc.astype("<u4"), "freqs": freq.astype("<u4"), "block_docs": doc[ends].astype("<u4"),
        "block_freqs": np.maximum.reduceat(freq, starts).astype("<u4"), "block_lengths": np.minimum.reduceat(length[doc], starts).astype("<u4"),
    }
    shard = ranked_search.Shard({k: v.tobytes() for k, v in row.items()}, float(length.mean()))
    chosen = term[begin][rng.choice(len(begin), 6, replace=False)]
    weights = np.array([4.0, 3.0, 1.0, 0.4, 0.2, 0.1])
    best = ranked_search.search_shard(shard.lists(np.sort(chosen), weights), shard.ids, 7)
    scores = np.zeros(3000)
    for t, w in zip(np.sort(chosen), weights):
        at = term == t
        scores[doc[at]] += w * freq[at] * 2.2 / (freq[at] + shard.norm[doc[at]])
    want = sorted(((-s, d) for d, s in enumerate(scores) if s))[:7]
    assert [d for _, _, d in sorted(best, key=lambda x: (-x[0], x[2]))] == [d for _, d in want]


# Chats


def chat_rows(n=120):
    rng = random.Random(5)
    rows = []
    for c in range(n):
        roles = (["system"] if c % 4 == 0 else []) + ["user", "assistant"] * rng.randrange(1, 4)
        for i, role in enumerate(roles):
            words = rng.randrange(4, 12) if role == "user" else rng.randrange(25, 60)
            text = " ".join("word" + "abcde"[rng.randrange(5)] for _ in range(words)) + ("?" if role == "user" else ".\n- one\n- two")
            rows.append((c, i, role, text))
    return rows


def chat_tables(spark, rows, keep=True):
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    return turns, plans.raw_transcripts(turns)


def test_roles_and_texts_come_back(spark):
    rows = chat_rows()
    turns, raw = chat_tables(spark, rows)
    known = raw.where("conv_id % 2 = 0")
    found = chat_format.parse(raw.drop("role"), chat_format.fit(known)).collect()
    want = {(c, i): (role, text) for c, i, role, text in rows if c % 2}
    got = {(r.conv_id, r.turn): (r.role, r.text) for r in found if r.conv_id % 2}
    right = sum(got.get(k) == v for k, v in want.items())
    assert right >= 0.95 * len(want)
    one = next(r for r in found if r.role == "user")
    assert one.rendered == f"<|im_start|>user\n{one.text}<|im_end|>\n"


def test_chunks_change_nothing(spark, monkeypatch):
    turns, raw = chat_tables(spark, chat_rows(40))
    long = raw.withColumn("part", F.col("conv_id") * 100 + F.col("part")).withColumn("conv_id", F.lit(1).cast("long"))
    model = chat_format.fit(raw)
    whole = chat_format.parse(long.drop("role"), model).orderBy("turn").collect()
    monkeypatch.setattr(chat_format, "CHUNK", 3)
    monkeypatch.setattr(chat_format, "ROWS_PER_TASK", 10)
    assert chat_format.parse(long.drop("role"), model).orderBy("turn").collect() == whole
    assert [r.turn for r in whole] == list(range(len(whole))) and len(whole) > 100


def test_odd_chats(spark):
    rows = [(1, 0, "user: hi"), (1, 1, None), (1, None, "system: first"), (1, 2, ""), (1, 3, "bot: yes"), (1, 3, "bot: yes"), (None, 0, "Human: ?"), (2, 0, ""), (3, 0, "no marker")]
    df = spark.createDataFrame(rows, "conv_id long, part long, text string").withColumn("chunk", F.lit(9))
    model = chat_format.fit(chat_tables(spark, chat_rows(40))[1])
    found = sorted(((str(r.conv_id), r.turn, r.role, r.text) for r in chat_format.parse(df, model).collect()))
    by_conv = defaultdict(list)
    for c, _, role, text in found:
        by_conv[c].append((role, text))
    assert by_conv["1"] == [("system", "first"), ("user", "hi"), ("assistant", "yes"), ("assistant", "yes")]
    assert by_conv["None"] == [("user", "?")] and "2" not in by_conv and len(by_conv["3"]) == 1
    assert chat_format.parse(df.limit(0), chat_format.Model()).collect() == []


# Pipeline


def test_pipeline_stages(spark, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.stored(stage(spark, docs, SMALL), name)
        before, left = docs.collect(), after.collect()
        if name != "sharding":
            assert after.columns == docs.columns
        if name not in ("mixing", "sharding"):
            assert set(map(tuple, left)) <= set(map(tuple, before)) and len(left) == len(set(r.doc_id for r in left))
        if name == "near_dedup":
            from tests.llm.test_near_duplicates import direct

            want = direct([(r.doc_id, r.text) for r in before], 5)
            assert {r.doc_id for r in left} == {d for d, (_, c, _) in want.items() if c == d}
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
            assert {str(r.doc_id) for r in left} == {w[0] for w in hits([(r.doc_id, r.text) for r in before], items) if not w[5]}
        if name == "mixing":
            sizes, got = Counter(), Counter()
            for r in before:
                sizes[r.source] += count(r.text)
            for r in left:
                got[r.source] += count(r.text)
            want = shared_out(sizes)
            assert all(abs(got[s] - want[s]) <= 3 * max(count(r.text) for r in before if r.source == s) + 128 for s in sizes)
        if name == "sharding":
            assert sorted(r.doc_id for r in left) == sorted(r.doc_id for r in before)
        docs = after
    assert corpus_pipeline.ORACLE_SQL is None


def test_queries_are_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
