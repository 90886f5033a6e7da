"""The operators' queries: ``(spark, sf_dir) -> DataFrame``, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (exact, fingerprints, lines, minhash, packing, pages, pii, repetition, runs, sharding,
               toxicity, unigram, whitening)
from .words import prepared

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, table: str = "documents", sql: str | None = None):
    """Register ``fn(frame of table, spark, folder) -> DataFrame``."""
    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            prepared(spark)
            return fn(spark.read.parquet(f"{folder}/{table}.parquet"), folder)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file lies on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_fingerprints")
def op1(docs, folder):
    return fingerprints.edited_fingerprints(docs)


@query("op2_packing")
def op2(docs, folder):
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


@query("op3_toxicity")
def op3(docs, folder):
    labels = docs.sparkSession.read.parquet(f"{folder}/labels.parquet")
    return toxicity.grade(docs, toxicity.fit(docs, labels))


# Sets of shingles, links by their intersections, and what can be reached over links.
LINKED = """
    with recursive words as (select doc_id, list_filter(regexp_split_to_array(translate(
            coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
        numbered as (select doc_id, len(w) as n, unnest(w) as word,
            generate_subscripts(w, 1) as i from words),
        runs as (select doc_id, i, n, hash(list(word) over (partition by doc_id order by i
            rows between current row and 4 following)) as shingle from numbered),
        items as (select distinct doc_id, shingle from runs where i <= greatest(1, n - 4)),
        sets as (select doc_id, count(shingle) as size from documents left join items
            using (doc_id) group by 1),
        pairs as (select a.doc_id as a, b.doc_id as b, count(*) as n from items a join items b
            on a.shingle = b.shingle and a.doc_id <> b.doc_id group by 1, 2),
        links as (select p.a, p.b from pairs p join sets x on x.doc_id = p.a
            join sets y on y.doc_id = p.b where 100 * n >= 75 * (x.size + y.size - n)),
        reached(a, b) as (select doc_id, doc_id from sets
            union select r.a, l.b from reached r join links l on r.b = l.a)
    select d.doc_id, d.size as n_shingles, min(r.b) as component_id, d.doc_id = min(r.b) as kept
    from sets d join reached r on r.a = d.doc_id group by d.doc_id, d.size"""


@query("op4_minhash", sql=LINKED)
def op4(docs, folder):
    return minhash.link(docs)


@query("op5_sharding")
def op5(docs, folder):
    """From 12 shards to 16."""
    moved = sharding.reshard(docs, old_shards=12, shards=16)
    return moved.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                        "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


@query("op6_lines")
def op6(docs, folder):
    return lines.report(docs, edits=3, least=1)


# A word is inside a repeat of k words if one of the k windows that hold it stands twice.
REPEATS = """
    with texts as (select doc_id, coalesce(text, '') as text from documents),
        words as (select doc_id, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'),
            lambda x: x <> '') as w, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as symbols,
            list_filter(string_split(text, chr(10)),
                lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from texts),
        numbered as (select doc_id, len(w) as n, unnest(w) as word,
            generate_subscripts(w, 1) as i from words),
        runs as (select doc_id, n, i, length(word) as chars, """ + ", ".join(f"""
            case when i <= n - {k - 1} then hash(list(word) over (partition by doc_id order by i
                rows between current row and {k - 1} following)) end as run{k}"""
            for k in (3, repetition.MIN_REPEAT, repetition.MOST_LONGEST + 1)) + """ from numbered),
        twice as (select doc_id, n, i, chars, """ + ", ".join(f"""
            run{k} is not null and count(*) over (partition by doc_id, run{k}) > 1 as twice{k}"""
            for k in (3, repetition.MIN_REPEAT, repetition.MOST_LONGEST + 1)) + """ from runs),
        inside as (select doc_id, chars, """ + ", ".join(f"""
            max(twice{k}) over (partition by doc_id order by i
                rows between {k - 1} preceding and current row) as inside{k}"""
            for k in (3, repetition.MIN_REPEAT)) + f""",
            twice{repetition.MOST_LONGEST + 1} as long from twice),
        counts as (select doc_id, sum(chars) as chars, count_if(inside3) as repeated,
            count_if(inside{repetition.MIN_REPEAT}) as covered, bool_or(long) as long
            from inside group by 1)
    select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(chars, 0) as bigint) as word_chars,
        symbols as n_symbols, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
        cast(coalesce(repeated, 0) as bigint) as n_repeat_words,
        cast(coalesce(covered, 0) as bigint) as n_covered_words,
        len(w) < 50 or 100 * coalesce(repeated, 0) > 50 * len(w) as base_failed,
        not (len(w) < 50 or 100 * coalesce(repeated, 0) > 50 * len(w))
            and coalesce(covered, 0) <= {repetition.MOST_COVERED} * len(w)
            and not coalesce(long, false) as kept
    from words left join counts using (doc_id)"""


@query("op7_repetition", sql=REPEATS)
def op7(docs, folder):
    return repetition.assess(docs).drop("longest_repeat")


@query("op8_pii")
def op8(docs, folder):
    return pii.detect(docs)


@query("op9_main_text", table="pages")
def op9(rows, folder):
    return pages.extract(rows)


@query("op10_sentencepiece")
def op10(docs, folder):
    """Ids of every text, and a digest of what they decode to."""
    pieces = unigram.Pieces.from_model(tokenizer("piece_bpe_32k.model"))
    rows = unigram.decoded(unigram.encoded(docs, pieces), pieces)
    return rows.select("doc_id", "n_ids", "ids_crc32", "ids",
                       F.length("text").cast("long").alias("decoded_chars"),
                       F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


@query("op11_whitening", table="embeddings")
def op11(rows, folder):
    return whitening.whiten(rows)


@query("op12_runs")
def op12(docs, folder):
    return runs.report(runs.made_periodic(docs)).drop("n_words")


# Of equal texts the longest original, then the smallest id.
COPIES = """
    with texts as (select doc_id, length(coalesce(text, '')) as chars, regexp_replace(
            coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') as norm from documents)
    select doc_id, first_value(doc_id) over best as keep_id, count(*) over (partition by norm)
            as group_size, doc_id = first_value(doc_id) over best as kept, sha256(norm) as text_sha256
    from texts window best as (partition by norm order by chars desc, doc_id)"""


@query("op13_exact", sql=COPIES)
def op13(docs, folder):
    return exact.report(docs)
