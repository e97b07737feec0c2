import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.constants import ANSWER_ERROR, NOTHING_FOUND, NOTHING_RELEVANT
from scriptorium.functions.vectors import hash_vector
from scriptorium.operators import prompts, retrieval
from scriptorium.plans import queries


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(2)
    found = rng.normal(size=(90, 8))
    found[10], found[11] = found[3], found[3]
    found[20] = 0
    return found


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("pivots, block", [(64, 512), (5, 7), (1, 3)])
def test_nearest_against_brute_force(spark, vectors, metric, pivots, block, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", block)
    monkeypatch.setattr(retrieval, "BLOCKS_PER_KEY", 2)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    corpus = spark.createDataFrame(rows, "id bigint, embedding array<double>").repartition(5)
    asked = corpus.withColumnRenamed("id", "query_id")
    found = retrieval.nearest(corpus, asked, 4, metric, pivots=pivots).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.distance, r.id))
    for i, q in enumerate(vectors):
        if metric == "l2":
            distances = ((vectors - q) ** 2).sum(axis=1)
        else:
            norms = np.linalg.norm(vectors, axis=1) * np.linalg.norm(q)
            distances = 1 - np.divide(vectors @ q, norms, out=np.zeros(len(vectors)), where=norms > 0)
        expected = sorted((round(float(d), 6) + 0.0, j) for j, d in enumerate(distances))[:4]
        assert got[i] == expected


def test_fewer_vectors_than_asked_for_and_text_ids(spark):
    corpus = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0])], "id string, embedding array<double>")
    asked = spark.createDataFrame([(7, [2.0, 0.0])], "query_id bigint, embedding array<double>")
    found = retrieval.nearest(corpus, asked, 5).orderBy("rank").collect()
    assert [(r.rank, r.id, r.distance) for r in found] == [(1, "a", 0.0), (2, "b", 0.0)]


def test_hash_vectors(spark):
    frame = spark.createDataFrame([("One two, two!",), ("two ONE two",), ("",)], "t string")
    a, b, c = (r[0] for r in frame.select(hash_vector(F.col("t"))).collect())
    assert a == b and abs(sum(x * x for x in a) - 1) < 1e-12 and c == [0.0] * 64


def test_models_plug_in(spark):
    embed = retrieval.model_embedder(lambda: lambda texts: np.array([[len(t), 1.0] for t in texts]))
    frame = spark.createDataFrame([("abc",)], "t string")
    assert retrieval.embed_texts(frame, "t", embed).first().embedding == [3.0, 1.0]


def test_report(spark):
    results = spark.createDataFrame([(1, 1, "c", 0.123456)], "query_id int, rank int, id string, distance double")
    chunks = spark.createDataFrame(
        [("c", "p/f.md", "f.md", 0, 3, 4, 9, "text")],
        "id string, path string, filename string, chunk_index int, total_chunks int, start_line int, end_line int, chunk string",
    )
    row = retrieval.search_report(results, chunks).first()
    assert (row.result_no, row.lines, row.chunk_of, row.relevance) == (1, "4 - 9", "1 de 3", "87.65%")


def test_contexts_keep_the_rank_and_tell_why_nothing_came(spark):
    questions = spark.createDataFrame([(1, "q1"), (2, "q2"), (3, "q3")], "query_id int, question string")
    results = spark.createDataFrame(
        [(1, 1, "a", 2.0), (1, 2, "b", 0.5), (1, 3, "c", 1.0), (2, 1, "a", 1.5)],
        "query_id int, rank int, id string, distance double",
    )
    chunks = spark.createDataFrame([("a", "S", "A"), ("b", "S", "B"), ("c", None, "C")], "id string, source string, chunk string")
    found = {r.query_id: r.context for r in prompts.context_assembly(questions, results, chunks).collect()}
    assert found == {
        1: "[Fragmento 2 - Fuente: S]\nB\n\n[Fragmento 3 - Fuente: Desconocido]\nC",
        2: NOTHING_RELEVANT,
        3: NOTHING_FOUND,
    }
    assert [r["rank"] for r in retrieval.within_cutoff(results).orderBy("rank").collect()] == [2, 3]


def test_prompts_and_payloads(spark):
    contexts = spark.createDataFrame([(1, 'say "ñ"\n', "ctx")], "query_id int, question string, context string")
    built = prompts.prompt_build(contexts, "temas")
    prompt = built.first().prompt
    assert prompt.startswith("Eres un asistente experto en temas.\nTu tarea") and "CONTEXTO:\nctx\n\nPREGUNTA:\nsay" in prompt
    assert json.loads(prompts.request_payload(built).first().payload) == {
        "model": "local-model", "messages": [{"role": "user", "content": prompt}], "max_tokens": 800, "temperature": 0.5,
    }


def test_answers(spark):
    good = json.dumps({"choices": [{"message": {"content": "sí"}}]})
    rows = [(1, 200, "OK", good), (2, 200, "OK", "{}"), (3, 200, "OK", "no json"), (4, 500, "Server Error", good), (5, 200, "OK", None)]
    found = prompts.parse_responses(spark.createDataFrame(rows, "query_id int, status int, reason string, body string"))
    assert {r.query_id: r.answer for r in found.collect()} == {
        1: "sí", 2: ANSWER_ERROR, 3: ANSWER_ERROR, 4: "Error al procesar la consulta: Server Error", 5: ANSWER_ERROR,
    }


def test_unusable_vectors_are_left_out_and_named(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [None, 1.0]), (5, [0.0, 1.0])]
    corpus = spark.createDataFrame(rows, "id bigint, embedding array<double>")
    asked = spark.createDataFrame([(7, [1.0, 0.0]), (8, None)], "query_id bigint, embedding array<double>")
    for metric in ("cosine", "l2"):
        assert [(r.query_id, r.id) for r in retrieval.nearest(corpus, asked, 5, metric).orderBy("rank").collect()] == [(7, 1), (7, 5)]
    found = {r.id: r.reason for r in retrieval.rejected_vectors(corpus, 2).collect()}
    assert found == {2: "no vector", 3: "wrong width", 4: "null in vector"}


def test_over_wide_vectors_do_not_empty_the_result(spark):
    """Neither a question nor a vector of the corpus with a number too many changes what the others find."""
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0, 5.0])]
    corpus = spark.createDataFrame(rows, "id bigint, embedding array<double>")
    asked = spark.createDataFrame([(7, [1.0, 0.0]), (8, [1.0, 0.0, 1.0])], "query_id bigint, embedding array<double>")
    assert [(r.query_id, r.id) for r in retrieval.nearest(corpus, asked, 5).orderBy("query_id", "rank").collect()] == [(7, 1), (7, 2)]
    assert {r.query_id: r.reason for r in retrieval.rejected_vectors(asked, 2).collect()} == {8: "wrong width"}


def test_label_means_of_usable_vectors(spark, tmp_path):
    rows = [(1, 0, [1.0, 0.0]), (2, 0, [1.0, 0.0, 9.0]), (3, 1, [0.0, 1.0]), (4, 1, [0.0, 1.0])]
    spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = queries.QUERIES["knn_cosine"](spark, str(tmp_path)).collect()
    assert {(r.query_id, r.id) for r in found if r["rank"] == 1} == {(0, 1), (1, 3)} and len(found) == 6


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_probes_bound_the_search_and_keep_the_recall(spark, metric):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 16)) * 3
    found = np.concatenate([centre + rng.normal(size=(50, 16)) for centre in centres])
    corpus = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(found)], "id bigint, embedding array<double>").repartition(4).checkpoint()
    asked = corpus.filter("id % 50 = 0").withColumnRenamed("id", "query_id")
    exact = {(r.query_id, r.id) for r in retrieval.nearest(corpus, asked, 10, metric).collect()}
    near = retrieval.nearest(corpus, asked, 10, metric, probes=8).collect()
    assert len(near) == len(exact) == 400
    assert len(exact & {(r.query_id, r.id) for r in near}) >= 0.9 * len(exact)
