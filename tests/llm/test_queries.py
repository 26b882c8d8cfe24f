"""Registered queries: whole tables against plain versions, and the pipeline's stages."""

import random

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from logweir.llm import catalog, language_id
from tests.compare import connect
from tests.llm import brute
from tests.llm.test_operators import check_packed, rows_of

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


def rows(sf_dir):
    table = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"])
    return list(zip(*(c.to_pylist() for c in table.columns)))


def test_names():
    assert [n.split("_")[0] for n in catalog.QUERIES] == [*(f"op{n}" for n in range(1, 14)), "pipeline"]


@pytest.mark.parametrize("name", list(catalog.SQL))
def test_query_equals_sql(spark, name):
    df = catalog.QUERIES[name](spark, MEDIUM)
    result = connect(MEDIUM).execute(catalog.SQL[name])
    columns = [d[0] for d in result.description]
    assert rows_of(df, *columns) == sorted(result.fetchall())


def test_exact_copies_run_no_python(spark):
    plan = catalog.op5_exact_copies(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_near_copies(spark):
    got = catalog.op2_near_copies(spark, MEDIUM)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == brute.near_copies(rows(MEDIUM), 3, 90, 100)


def test_repeated_passages(spark):
    got = catalog.op6_repeated_passages(spark, MEDIUM)
    columns = ("doc_id", "n_words", "n_removed", "kept_sha256")
    assert rows_of(got, *columns) == brute.without_repeats(rows(MEDIUM), 35)


def test_secrets(spark):
    got = rows_of(catalog.op7_secret_scan(spark, MEDIUM), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    assert got == [(d, *brute.base_secrets(t)) for d, t in sorted(rows(MEDIUM))]
    table = pq.read_table(f"{MEDIUM}/documents.parquet", columns=["doc_id", "text", "source"])
    whole = list(zip(*(c.to_pylist() for c in table.columns)))
    got = rows_of(catalog.op7_secret_scan(spark, MEDIUM), "doc_id", "spans", "live_looking", "copied")
    assert got == sorted(brute.all_secrets(whole))


def test_scores(spark):
    columns = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")
    got = rows_of(catalog.op8_context_tree(spark, MEDIUM), *columns)
    for mine, plain in zip(got, brute.unigram(rows(MEDIUM)), strict=True):
        assert mine[:5] == plain[:5] and mine[5] == pytest.approx(plain[5], rel=1e-9)


def test_token_files(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(catalog.tokenizer("byte_bpe_50k.json"))
    got = rows_of(catalog.op1_token_files(spark, SMALL), "doc_id", "start", "n_tokens", "ids_crc32")
    assert got == brute.token_files(rows(SMALL), library, 2)


def test_languages_held_out(spark):
    lang = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang")
    got = catalog.op9_language_id(spark, MEDIUM).join(lang, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert sum(r.rejected for r in got) / len(got) < 0.01


def test_unknown_languages_and_junk_are_rejected(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    model = language_id.fit(docs)
    rng = random.Random(6)
    finnish = "kun ihmiset kävelivät järven rannalla he näkivät veneen joka oli täynnä kalaa ja vihanneksia".split()
    welsh = "mae hi'n bwrw glaw heddiw ac rydym ni wedi cyrraedd yr ysgol yn hwyr iawn eto".split()
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    odd = [" ".join(rng.choice(kind) for _ in range(200)) for kind in (finnish, welsh)]
    odd += ["".join(rng.choice(letters) for _ in range(1_500)), "\n".join("".join(rng.choice(letters) for _ in range(76)) for _ in range(20))]
    frame = spark.createDataFrame([(t,) for t in odd], "text string")
    assert [r.rejected for r in language_id.predict(frame, model).collect()] == [True] * 4
    judged = language_id.predict(docs, model, keep=["doc_id"])
    assert judged.where("rejected AND lang_pred <> 'und'").count() <= 0.005 * docs.count()


def test_packing(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(catalog.tokenizer("byte_bpe_50k.json"))
    got = catalog.op10_packing(spark, SMALL).collect()
    check_packed(rows(SMALL), got, library, catalog.SEQUENCE)


def test_pipeline_stages(spark):
    """Each stage keeps what its plain version keeps, on what its predecessor kept."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["language_id", "exact_dedup", "near_dedup", "decontamination", "packing"]

    def run(name, df):
        out = steps[name](spark, df, SMALL)
        assert name == "packing" or out.columns == docs.columns
        return {r.doc_id: r.text for r in out.collect()} if name != "packing" else out.collect()

    def frame(kept):
        return docs.where(docs.doc_id.isin(list(kept)))

    clean = run("language_id", docs)
    assert len(clean) >= 0.98 * docs.count()
    one = run("exact_dedup", frame(clean))
    assert set(one) == {r[0] for r in brute.exact_copies(clean.items()) if r[3]}
    two = run("near_dedup", frame(one))
    assert set(two) == {r[0] for r in brute.near_copies(one.items(), 5, 4, 5) if r[0] == r[2]}
    three = run("decontamination", frame(two))
    items = [" ".join(brute.words(t)) for t in pq.read_table(f"{SMALL}/benchmark.parquet")["text"].to_pylist()]
    whole = {d for d, t in two.items() if any(i in " ".join(brute.words(t)) for i in items)}
    assert whole <= set(two) - set(three) and len(set(two) - set(three)) <= len(whole) + 3
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(catalog.tokenizer("byte_bpe_50k.json"))
    check_packed(list(three.items()), run("packing", frame(three)), library, catalog.SEQUENCE)


def test_pipeline_runs(spark):
    got = catalog.pipeline(spark, SMALL)
    assert got.columns[:2] == ["doc_id", "piece"] and got.count() > 100


def odd_rows(spark):
    """Null and repeated ids, equal and near texts among them, and columns named like helpers."""
    rng = random.Random(2)
    words = lambda n: " ".join(rng.choice(["river", "stone", "green", "letter", "window"]) + str(rng.randrange(30)) for _ in range(n))
    base, item = words(80), pq.read_table(f"{SMALL}/benchmark.parquet")["text"][2].as_py()
    rows = [(7, "alone here"), (7, "shared text"), (8, "Shared text"), (None, "copy without id"), (None, "copy without id")]
    rows += [(9, base), (9, base + " more"), (None, base + " again"), (3, words(60)), (3, words(60)), (None, f"{words(9)} {item}"), (None, None), (4, None), (5, "")]
    rows = [(d, t, "en", "s", 0, True, "x", 1.0, n, n, "g") for n, (d, t) in enumerate(rows)]
    schema = (
        "doc_id long, text string, lang string, source string, n_chars long, rejected boolean, "
        "lang_pred string, score double, row long, document long, `group` string"
    )
    return spark.createDataFrame(rows, schema).repartition(3)


def test_pipeline_stages_tell_rows_apart(spark):
    docs, steps = odd_rows(spark), dict(corpus_pipeline.STAGES)

    def run(name):
        out = steps[name](spark, docs, SMALL)
        assert out.columns == docs.columns
        return {r.row for r in out.collect()}

    # All texts with letters but one, whose words the others do not have.
    assert run("language_id") == set(range(1, 11))
    kept = run("exact_dedup")
    # 1 and 2 are equal and 8 is the largest id; one of 3 and 4 stays; of the empty ones that of id 5
    assert kept - {3, 4} == {0, 2, 5, 6, 7, 8, 9, 10, 13} and len(kept & {3, 4}) == 1
    kept = run("near_dedup")
    assert kept - {3, 4, 5, 6} == {0, 1, 8, 9, 10, 11, 12, 13}
    assert len(kept & {3, 4}) == 1 and len(kept & {5, 6}) == 1
    assert run("decontamination") == set(range(14)) - {10}
    packed = steps["packing"](spark, docs, SMALL)
    assert packed.count() >= 14


def test_pipeline_stages_of_an_empty_table(spark):
    docs = odd_rows(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).collect() == [], name
