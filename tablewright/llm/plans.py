"""Each operator bound to the shared tables: ``opN_<name>``, and the pipeline.

A query runs its operator over the whole table and derives a digest per document from what the
operator made.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.chat_format import fit as fit_transcripts
from tablewright.llm.chat_format import parse
from tablewright.llm.decontamination import find_contamination
from tablewright.llm.html_extraction import extract_main_text
from tablewright.llm.merkle_manifest import folded, hex_text, merkle_manifest, proof_text
from tablewright.llm.mixing import Mix
from tablewright.llm.near_duplicates import near_duplicates
from tablewright.llm.periodic_runs import periodic_runs
from tablewright.llm.phrase_automata import remove_repeats
from tablewright.llm.ranked_search import build_index, document_queries, search_documents
from tablewright.llm.sharding import shard_dataset, shard_digest
from tablewright.llm.suffix_arrays import remove_repeated_bytes
from tablewright.llm.token_files import token_index, write_token_files
from tablewright.llm.toxicity import fit, held_out, score
from tablewright.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def public_tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query
def op1_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_token_files(table(spark, folder, "documents"), path, public_tokenizer("word_bpe_49k.json"), end_id=2)
    return token_index(spark, path)


@query
def op4_sharding(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return shard_digest(shard_dataset(docs, scratch_path(spark, "shards"), shards=16, grow=True))


@query
def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    mix = Mix(docs, weights=(5, 2, 1), most=3.0, block_words=128)
    return mix.taken().select("doc_id", "size", "source_size", "target", "taken")


@query
def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    return find_contamination(docs, items, width=13, min_share=(1, 20))


@query
def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


@query
def op3_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), shingle=4, percent=80)


@query
def op2_phrase_automata(spark: SparkSession, folder: str) -> DataFrame:
    left = remove_repeats(table(spark, folder, "documents"), width=20)
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op5_suffix_arrays(spark: SparkSession, folder: str) -> DataFrame:
    left = remove_repeated_bytes(table(spark, folder, "documents"), width=50)
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


@query
def op8_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    index = build_index(docs)
    found = search_documents(index, document_queries(docs.where("doc_id % 20 = 0"), index), k=10)
    return found.select(F.col("query").alias("doc_id"), "rank", F.col("doc_id").alias("match_id"), "score")


def raw_transcripts(turns: DataFrame) -> DataFrame:
    """The table's turns as transcripts in five house styles; the last has blank lines for markers."""
    style = F.pmod(F.xxhash64("conv_id"), F.lit(5))
    name = F.initcap("role")
    short = F.when(F.col("role") == "user", "Q").when(F.col("role") == "assistant", "A").otherwise("Context")
    other = F.when(F.col("role") == "user", "Human").when(F.col("role") == "assistant", "Bot").otherwise("System")
    text = F.coalesce("text", F.lit(""))
    raw = (
        F.when(style == 0, F.concat(name, F.lit(": "), text))
        .when(style == 1, F.concat(F.lit("### "), other, F.lit(":\n"), text))
        .when(style == 2, F.concat(F.lit("["), "role", F.lit("] "), text))
        .when(style == 3, F.concat(short, F.lit(": "), text))
        .otherwise(F.concat(text, F.lit("\n")))
    )
    return turns.select("conv_id", F.col("turn").alias("part"), raw.alias("text"), "role")


@query
def op6_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    raw = raw_transcripts(table(spark, folder, "conversations"))
    known = raw.where(F.crc32(F.col("conv_id").cast("string").cast("binary")) % 3 != 1)
    turns = parse(raw.drop("role"), fit_transcripts(known))
    return turns.select("conv_id", "turn", "role", "n_lines", F.sha2("rendered", 256).alias("rendered_sha256"))


def lower_a_to_z(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def number_hash(number: Column) -> Column:
    """Unsigned crc32 of the decimal form."""
    return F.crc32(number.cast("string").cast("binary"))


@query
def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    tampered = F.when(number_hash(F.col("doc_id")) % 3 == 0, lower_a_to_z(F.col("text"))).otherwise(F.col("text"))
    proofs = merkle_manifest(table(spark, folder, "documents"), found={"text": tampered})
    named = proofs.select(
        "doc_id", *[hex_text(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")],
        F.sha2(proof_text(F.col("proof")), 256).alias("proof_sha256"),
        folded(F.col("found_leaf"), F.col("proof")).alias("folded_root"),
    )
    return named.withColumn("verified", F.col("folded_root") == F.col("root"))


def _merkle_sql(levels: int = 7, forest: int = 3, fan: int = 8) -> str:
    """The manifest level by level, for trees of up to ``fan ** levels`` leaves."""

    def fields(text: str) -> str:
        names = ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)
        return "sha256(" + " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in names) + ")"

    crc = (
        "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), "
        "lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]), "
        "lambda r, z: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)))"
    )
    lowered = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    parts = [
        f"hashed AS (SELECT doc_id, lang, {fields('text')} AS leaf, "
        f"CASE WHEN {crc} % 3 = 0 THEN {fields(lowered)} ELSE {fields('text')} END AS fold FROM documents)",
        "d0 AS (SELECT doc_id, coalesce('=' || lang, '-') AS tree, lang, row_number() OVER (PARTITION BY lang "
        "ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf, fold, '' AS proof FROM hashed)",
        "n0 AS (SELECT tree, i, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM d0)",
    ]

    def level(k: int, nodes: str, docs: str) -> None:
        group = f"CASE WHEN n > 1 THEN i // {fan} ELSE i END"
        parts.append(
            f"{nodes}s{k} AS (SELECT a.tree, a.i, any_value(a.n) AS n, "
            "coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, "
            "coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r "
            f"FROM {nodes}{k} a JOIN {nodes}{k} b ON a.tree = b.tree AND a.i // {fan} = b.i // {fan} GROUP BY a.tree, a.i)"
        )
        parts.append(
            f"{nodes}{k + 1} AS (SELECT tree, i, h, count(*) OVER (PARTITION BY tree) AS n FROM (SELECT tree, {group} AS i, "
            "CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h "
            f"FROM {nodes}{k} GROUP BY tree, {group}))"
        )
        more = "" if nodes == "n" else ", d.subroot"
        parts.append(
            f"{docs}{k + 1} AS (SELECT d.doc_id, d.tree, d.lang, CASE WHEN s.n > 1 THEN d.i // {fan} ELSE d.i END AS i, d.leaf, "
            "CASE WHEN s.n > 1 THEN sha256(s.l || d.fold || s.r) ELSE d.fold END AS fold, d.proof || s.l || s.r AS proof"
            f"{more} FROM {docs}{k} d JOIN {nodes}s{k} s ON d.tree = s.tree AND d.i = s.i)"
        )

    for k in range(levels):
        level(k, "n", "d")
    parts.append(
        f"f0 AS (SELECT '' AS tree, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, h, count(*) OVER () AS n, lang "
        f"FROM (SELECT DISTINCT lang, h FROM n{levels} JOIN (SELECT DISTINCT tree, lang FROM d0) USING (tree)))"
    )
    parts.append(
        f"e0 AS (SELECT doc_id, '' AS tree, d.lang, f0.i, leaf, fold, proof, f0.h AS subroot FROM d{levels} d "
        "JOIN f0 ON d.lang IS NOT DISTINCT FROM f0.lang)"
    )
    for k in range(forest):
        level(k, "f", "e")
    return (
        f"WITH {', '.join(parts)} SELECT e.doc_id, e.leaf, e.subroot, f.h AS root, sha256(e.proof) AS proof_sha256, "
        f"e.fold AS folded_root, e.fold = f.h AS verified FROM e{forest} e, f{forest} f"
    )


ORACLES["op12_merkle_manifest"] = _merkle_sql()


def with_planted_periods(docs: DataFrame) -> Column:
    """The text in which, for every tenth hash of doc_id, the words from word a on repeat with period p."""
    h = number_hash(F.col("doc_id"))
    g = F.expr("crc32(cast(cast(doc_id AS string) AS binary)) div 10")
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    split = F.struct(words.alias("words"), g.alias("g"))

    def planted(x: Column) -> Column:
        n = F.size(x["words"]).cast("long")
        a = F.pmod(x["g"], F.greatest(n, F.lit(1)))
        p = 1 + F.floor((n - a) / (3 + x["g"] % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        moved = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(x["words"], place(i)))
        return F.when(n > 0, F.array_join(moved, " ")).otherwise("")

    return F.when(h % 10 == 0, F.get(F.transform(F.array(split), planted), F.lit(0))).otherwise(F.col("text"))


@query
def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = periodic_runs(docs, with_planted_periods(docs))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.withColumn("longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("longest.start").alias("start"),
        (-F.col("longest.less")).alias("length"),
        F.col("longest.period").alias("period"),
        F.expr("(-1000 * longest.less) div longest.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op11_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    texts = extract_main_text(table(spark, folder, "pages"))
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))
