from __future__ import annotations

import collections
import itertools
import random

import corpus_pipeline as pipeline
import pytest
from test_texts import edited, language_rows, weighted_jaccard
from test_urls_and_mixing import brute_mix


def as_counter(df, cols=("doc_id", "text")):
    return collections.Counter(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder with the labels and an empty documents table."""
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, i % 2) for i in range(0, 240, 3)], "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    return at


def test_one_of_each_keeps_least_ids(spark, corner_docs, folder):
    got = as_counter(pipeline.one_of_each(spark, corner_docs, folder))
    # Texts of corner_docs are copies or unrelated: every text once, with its least id, and null texts whole.
    least = {}
    for r in corner_docs.collect():
        if r["text"] is not None:
            k = (r["doc_id"] is None, r["doc_id"] or 0)
            least[r["text"]] = min(least.get(r["text"], k), k)
    want = collections.Counter((None if none else i, t) for t, (none, i) in least.items())
    want += collections.Counter((r["doc_id"], None) for r in corner_docs.collect() if r["text"] is None)
    assert got == want


def test_one_of_each_against_brute_force(spark, folder):
    rng = random.Random(8)
    texts = []
    for _ in range(5):
        text = " ".join(f"w{rng.randrange(300)}" for _ in range(120))
        texts += [edited(rng, text, k) for k in (0, 0, 1, 2, 8)]
    label = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if weighted_jaccard(texts[i], texts[j]) >= 0.8:
            low, high = sorted((label[i], label[j]))
            label = [low if x == high else x for x in label]
    assert 5 <= len(set(label)) < 25
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string")
    assert as_counter(pipeline.one_of_each(spark, docs, folder)) == collections.Counter((i, texts[i]) for i in set(label))


def test_mixed_takes_the_copies_of_the_mix(spark, corner_docs, folder):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in corner_docs.collect()]
    want = collections.Counter()
    for r, (n, _, _, taken) in zip(rows, brute_mix(rows)):
        if n and taken:
            want[(r[0], r[1])] += taken // n
    assert as_counter(pipeline.mixed(spark, corner_docs, folder)) == want


def test_filters_and_pieces_keep_rows_and_columns(spark, corner_docs, no_docs, folder, model_files):
    learned = spark.createDataFrame(language_rows(), "doc_id long, text string, lang string")
    odd = spark.createDataFrame([(900, None, None), (901, "", None), (902, "123 !!", None), (None, "the and of that house", "en")], learned.schema)
    kept = pipeline.known_language(spark, learned.unionByName(odd), folder)
    assert kept.columns == learned.columns and kept.filter("doc_id >= 900").count() == 0 and kept.filter("doc_id IS NULL").count() == 1
    assert kept.count() >= 0.97 * 240
    for stage in (pipeline.known_language, pipeline.not_toxic, pipeline.one_of_each, pipeline.mixed):
        assert stage(spark, corner_docs, folder).columns == corner_docs.columns
        assert stage(spark, no_docs, folder).collect() == []
    plain = pipeline.not_toxic(spark, corner_docs, folder).filter("text IS NULL OR text = ''")
    assert plain.count() == corner_docs.filter("text IS NULL OR text = ''").count()
    assert as_counter(pipeline.in_pieces(spark, corner_docs, folder), ["doc_id"]) == as_counter(corner_docs, ["doc_id"])


def test_run_on_nothing(spark, folder, model_files):
    assert pipeline.run(spark, folder).collect() == []


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """All tables of the operators, small: three languages, toxic texts, copies, nulls."""
    at, rng = str(tmp_path_factory.mktemp("small")), random.Random(12)
    rows = [(i, t, lang, f"s{i % 3}") for i, t, lang in language_rows(300)]
    spiced = [(i, t + " rotten vile scoundrel rotten" * 3 if i % 5 == 0 else t, lang, s) for i, t, lang, s in rows]
    rows = spiced + [(1000 + i, spiced[i][1], spiced[i][2], "s0") for i in range(1, 9)] + [(2000, None, None, None), (2001, "", "en", "s1")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)], "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(i, f"https://a{i % 7}.example.org/{['es', 'en', 'de'][i % 3]}/{i}?q") for i in range(40)], "page_id long, url string").write.parquet(f"{at}/pages.parquet")
    vectors = [(i, [rng.gauss(0, 1) for _ in range(6)] if i % 4 else [1.0, 0.5, 0.0, 0.0, 0.0, 0.1 * i]) for i in range(60)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{at}/embeddings.parquet")
    return at


def test_run_is_the_stages_in_turn(spark, small, model_files):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    sizes, toxic = [docs.count()], {r["doc_id"] for r in docs.filter("text LIKE '%rotten vile%'").collect()}
    for name, stage in pipeline.STAGES:
        docs = pipeline.materialize(stage(spark, docs, small))
        sizes.append(docs.count())
        ids = [r["doc_id"] for r in docs.collect()]
        if name == "language_id":
            assert not {2000, 2001} & set(ids) and len(ids) > 290
        if name == "toxicity":
            assert not toxic & set(ids) and len(ids) > 0.95 * (sizes[1] - len(toxic))
        if name == "near_dedup":
            assert not [i for i in ids if i >= 1000]
    got = as_counter(pipeline.run(spark, small), ["doc_id", "n_tokens"])
    assert got == as_counter(docs, ["doc_id", "n_tokens"]) and sum(got.values()) == sizes[-1]


@pytest.mark.parametrize("name,table,key", [
    ("op1_near_duplicates", "documents", "doc_id"), ("op2_near_vectors", "embeddings", "vec_id"), ("op3_language_id", "documents", "doc_id"),
    ("op4_token_files", "documents", "doc_id"), ("op5_transport_streams", "documents", "doc_id"), ("op6_toxicity", "documents", "doc_id"),
    ("op7_lm_score", "documents", "doc_id"), ("op8_piece_segments", "documents", "doc_id"), ("op9_url_filter", "pages", "page_id"),
    ("op10_source_mix", "documents", "doc_id"), ("op13_personal_data", "documents", "doc_id"),
])
def test_registered_queries_answer_for_every_row(spark, small, model_files, name, table, key):
    from tapeweave.llm.queries import QUERIES

    rows = spark.read.parquet(f"{small}/{table}.parquet")
    got = QUERIES[name](spark, small)
    assert as_counter(got, [key]) == as_counter(rows, [key])


def test_language_and_toxicity_queries_on_held_out_rows(spark, small):
    from tapeweave.llm.queries import QUERIES

    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    languages = [r for r in QUERIES["op3_language_id"](spark, small).collect() if r["held_out"] and docs[r["doc_id"]]["text"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in languages) >= 0.95 * len(languages) > 50
    judged = [r for r in QUERIES["op6_toxicity"](spark, small).collect() if r["held_out"] and docs[r["doc_id"]]["text"]]
    assert sum(r["predicted"] == int("rotten vile" in docs[r["doc_id"]]["text"]) for r in judged) >= 0.95 * len(judged) > 50
