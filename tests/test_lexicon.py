import time

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import lexicon


def corpus(spark, *texts):
    return spark.createDataFrame([(f"d{i}", text) for i, text in enumerate(texts)], "path string, text string")


def definitions(spark, text):
    return {r.acronym: r.definition for r in lexicon.acronym_definitions(corpus(spark, text)).collect()}


def test_acronyms_are_whole_words_of_plain_capitals(value):
    text = "ÀBC ABX ABCÉ A_B X2 QRS. ETSÑ A abx-ABX"
    assert value(lexicon.acronyms_in(F.col("t")), t=text) == ["ABX", "QRS", "ABX"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("AB (first) AB (second)", {"AB": "first"}),
        ("the thing (AB) and more", {"AB": "the thing"}),
        ("x (note) the thing ( AB ) y", {"AB": "note) the thing"}),
        ("AB (  )", {"AB": ""}),
        ("AB () then AB (def)", {"AB": "def"}),
        ("XABX (def) ABX", {"XABX": "def", "ABX": "def"}),
        ("AB (one (two) three", {"AB": "one (two"}),
        ("AB (never closed", {"AB": None}),
        ("((AB) yes (AB)", {"AB": "AB) yes"}),
        ("one (AB) two (CD)", {"AB": "one", "CD": "AB) two"}),
        ("long form (AB), AB (short form)", {"AB": "short form"}),
        ("AB (x CD (y)", {"AB": "x CD (y", "CD": "y"}),
        ("plain AB", {"AB": None}),
    ],
)
def test_definition_forms(spark, text, expected):
    assert definitions(spark, text) == expected


def test_only_the_first_document_defines(spark):
    found = lexicon.acronym_dictionary(corpus(spark, "AB here", "AB (later)", "CD (now) AB")).collect()
    rows = {r.acronym: (r.definition, r.n_files, r.files) for r in found}
    assert rows == {"AB": (None, 3, ["d0", "d1", "d2"]), "CD": ("now", 1, ["d2"])}


def test_parts_hold_the_same_postings(spark):
    texts = [f"COMMON word (X{i % 3}) tables tables COMMON (def {i})" for i in range(60)]
    whole = {r.acronym: r for r in lexicon.acronym_dictionary(corpus(spark, *texts), parts=1).collect()}
    split = lexicon.acronym_dictionary(corpus(spark, *texts), parts=5).collect()
    assert len({r.part for r in split}) == 5
    for name, row in whole.items():
        mine = [r for r in split if r.acronym == name]
        assert sorted(f for r in mine for f in r.files) == row.files
        assert {(r.definition, r.n_files) for r in mine} == {(row.definition, row.n_files)}
    terms = lexicon.term_dictionary(corpus(spark, *texts), parts=1).collect()
    cut = lexicon.term_dictionary(corpus(spark, *texts), parts=5).collect()
    assert {(r.term, r.occurrences) for r in cut} == {(r.term, r.occurrences) for r in terms}


def test_sentences_and_tokens(spark):
    frame = corpus(spark, "Uno dos! tres4 a-b Árbol?\nla Casa  blanca.")
    sentences = [r.sentence for r in lexicon.sentence_rows(frame).orderBy("sentence_no").collect()]
    assert sentences == ["Uno dos!", "tres4 a-b Árbol?", "la Casa  blanca."]
    tokens = lexicon.token_rows(frame).orderBy("sentence_no", "position").collect()
    assert [(r.sentence_no, r.position, r.token) for r in tokens] == [
        (0, 0, "dos"), (1, 0, "árbol"), (2, 0, "casa"), (2, 1, "blanca"),
    ]


def test_runs_close_over_stop_words_and_break_at_other_tokens(spark):
    frame = corpus(spark, "Puertas de madera van hacia jardines. Tables")
    runs = [r.term for r in lexicon.noun_run_rows(frame).orderBy("sentence_no", "run_no").collect()]
    assert runs == ["puertas madera", "hacia jardines", "table"]


def test_tagger_may_be_a_python_model(spark):
    tagger = lexicon.model_tagger(lambda tokens: ["NNS" if token.endswith("s") else "VB" for token in tokens])
    frame = corpus(spark, "gatos perros corren buses")
    runs = [r.term for r in lexicon.noun_run_rows(frame, tagger=tagger).orderBy("run_no").collect()]
    assert runs == ["gatos perros", "buse"]
    tags = [r.tag for r in lexicon.tagged_token_rows(frame, tagger=tagger).orderBy("position").collect()]
    assert tags == ["NNS", "NNS", "VB", "NNS"]


@pytest.mark.parametrize(
    "noun, lemma",
    [("cities", "city"), ("boxes", "box"), ("houses", "house"), ("class", "class"), ("virus", "virus"), ("bus", "bus"), ("gas", "gas"), ("dogs", "dog"), ("watches", "watch")],
)
def test_plural_rule(value, noun, lemma):
    assert value(lexicon.plural_lemma(F.col("t")), t=noun) == lemma


def test_lemma_table_and_support(spark):
    frame = corpus(spark, "mejores. bueno. mejor. single", "mejores")
    runs = lexicon.noun_run_rows(frame, lemma=lambda noun: noun)
    lemmas = spark.createDataFrame([("mejores", "bueno"), ("mejor", "bueno")], "term string, lemma string")
    found = lexicon.term_dictionary(frame, runs=lexicon.lemma_by_table(runs, lemmas)).collect()
    assert [(r.term, r.occurrences, r.n_files, r.files) for r in found] == [("bueno", 4, 2, ["d0", "d1"])]


def test_definitions_in_linear_time(spark):
    """Very many parentheses, closed at the end only or never, and very many acronyms."""
    names = ["".join(chr(65 + i // 26**k % 26) for k in (2, 1, 0)) for i in range(3000)]
    for text in ("AB (x " * 100_000, "(" * 100_000 + "AB (", "AB (x " * 100_000 + ")", " ".join(f"{n} (def {n})" for n in names)):
        started = time.time()
        found = definitions(spark, text)
        assert time.time() - started < 20
        if len(found) > 1:
            assert found == {n: f"def {n}" for n in names}
        elif text.endswith(")"):
            assert found["AB"].startswith("x AB (x ") and len(found["AB"]) > 500_000
        else:
            assert found == {"AB": None}
