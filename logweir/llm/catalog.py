"""The registered queries of this folder and the SQL that checks them where SQL can."""

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from logweir.llm import (
    ctw,
    decontaminate,
    exact_copies,
    jaccard,
    language_id,
    lexical_search,
    packing,
    repeated_passages,
    secret_scan,
    token_counts,
    token_files,
    url_templates,
    whitening,
)
from logweir.session import scratch_path

END_ID = 2
SEQUENCE = 1_024
TOKEN_LIMIT = 4_096
CONTEXT = 6  # bytes before a byte


def tokenizer(name: str) -> str:
    """Path of a public tokenizer's file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    token_files.write(documents(spark, sf_dir), folder, tokenizer("byte_bpe_50k.json"), END_ID)
    width = token_files.width_of(spark, folder)
    return token_files.digests(token_files.documents(spark, folder), width)


def op2_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_copies(documents(spark, sf_dir), 3, Fraction(9, 10), links=True)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(
        documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"), TOKEN_LIMIT
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contaminated(documents(spark, sf_dir), benchmark)


def op5_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies.exact_copies(documents(spark, sf_dir))


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages.without_repeats(documents(spark, sf_dir), 35)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(documents(spark, sf_dir))


def op8_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(documents(spark, sf_dir), depth=CONTEXT)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), END_ID, SEQUENCE)


# The rules for pages.
RULES = [
    url_templates.Rule("allow", "com", "/"),
    url_templates.Rule("block", "example.com", "/en/"),
    url_templates.Rule("allow", "www.example.com", "/en/"),
    url_templates.Rule("block", "net", "/es/"),
    url_templates.Rule("block", "net", "/fr/"),
]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return lexical_search.search(documents(spark, sf_dir), benchmark)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_files,
        op2_near_copies,
        op3_token_counts,
        op4_decontamination,
        op5_exact_copies,
        op6_repeated_passages,
        op7_secret_scan,
        op8_context_tree,
        op9_language_id,
        op10_packing,
        op11_url_filter,
        op12_lexical_search,
        op13_whitening,
        pipeline,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {
    "op5_exact_copies": f"""
        WITH plain AS (SELECT doc_id, {_LOWER} AS text FROM documents)
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept,
               sha256(text) AS text_sha256
        FROM plain
        WINDOW same AS (PARTITION BY text)
    """,
    "op12_lexical_search": r"""
        WITH found AS (
            SELECT doc_id, row_number() OVER () AS row,
                   regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents WHERE text IS NOT NULL
        ),
        docs AS (SELECT doc_id, row, terms, CAST(len(terms) AS BIGINT) AS n FROM found WHERE len(terms) > 0),
        totals AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS held FROM docs),
        postings AS (
            SELECT row, term, count(*) AS tf
            FROM (SELECT row, unnest(terms) AS term FROM docs) GROUP BY row, term
        ),
        items AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark
        ),
        weights AS (
            SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
            FROM postings CROSS JOIN totals GROUP BY term
        ),
        sized AS (
            SELECT row, doc_id, 100 - 50 + ((50 * n * n_docs) // held) AS m
            FROM docs CROSS JOIN totals
        ),
        scored AS (
            SELECT item_id, row, doc_id,
                   CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
            FROM items JOIN weights USING (term) JOIN postings USING (term) JOIN sized USING (row)
            GROUP BY item_id, row, doc_id
        ),
        ranked AS (
            SELECT item_id, doc_id, score,
                   row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
            FROM scored WHERE score > 0
        )
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50
    """,
}
