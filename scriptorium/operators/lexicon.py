"""Acronyms with definitions, and frequent noun terms, with their postings.

Everything up to the aggregations works inside one row per document: no shuffle carries text. Postings are
rows (``acronym_definitions``, ``term_postings``), which have no bound per entry. Where lists are asked for,
they come in numbered parts, by a hash of the path: the number is a parameter, the same at every size of the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.constants import (
    MIN_ACRONYM_LENGTH,
    MIN_NOUN_LENGTH,
    MIN_OCCURRENCES,
    NOT_NOUNS,
    NOT_PLURAL,
    NOUN_TAG,
    OTHER_TAG,
    PLURAL_RULES,
    SPACE,
    STOP_WORDS,
)
from scriptorium.functions.text import let, strip

#: Parts that the lists of an entry come in, unless a caller asks for more.
PARTS = 1
_NOT_WORD = r"[^\p{L}\p{N}_]+"
_NOT_TOKEN = r"[^\p{L}\p{N}_'\-]+"
_GAP = "|"

Tagger = Callable[[Column], Column]
Lemma = Callable[[Column], Column]


def part_of(key: Column, parts: int) -> Column:
    """The part of a document: the first 32 bits of the MD5 of its key, modulo the number of parts."""
    return (F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint") % parts).cast("int")


# Acronyms


def acronyms_in(text: Column, min_length: int = MIN_ACRONYM_LENGTH) -> Column:
    """All acronym occurrences of a text in order: whole words of capitals A to Z."""
    return F.filter(F.split(text, _NOT_WORD), lambda word: word.rlike(f"^[A-Z]{{{min_length},}}$"))


def acronym_occurrences(documents: DataFrame, key: str = "path") -> DataFrame:
    """``(key, acronym, occurrences)``."""
    return (
        documents.select(key, F.explode(acronyms_in(F.col("text"))).alias("acronym"))
        .groupBy(key, "acronym")
        .agg(F.count("*").alias("occurrences"))
    )


_ENTRIES = "array<struct<acronym:string,form:int,at:int,part:int>>"


def _entries(acronyms: Column, closed: Column, opened: Column) -> Column:
    """Everything that can define an acronym of the text, sorted by acronym, form and place.

    ``closed`` are the texts before each ``)``, cut at their ``(``: what follows one of these up to the ``)`` is form 1 for the run of capitals before it,
    and for the ends of that run. ``opened`` is the whole text cut at its ``(``: form 2 is an acronym alone in parentheses, behind any text. Form 0 stands
    for the acronym itself.
    """
    lengths = F.array_distinct(F.transform(acronyms, F.length))

    def first_form(parts: Column, at: Column) -> Column:
        def ends(part: Column, k: Column) -> Column:
            def entries(run: Column) -> Column:
                own = F.filter(lengths, lambda n: n <= F.length(run))
                return F.transform(own, lambda n: F.struct(F.right(run, n).alias("acronym"), F.lit(1).alias("form"), at.alias("at"), k.alias("part")))

            # The last part stands behind the last "(" and has nothing to define; empty parentheses define nothing either.
            defines = (k < F.size(parts) - 1) & ~((k == F.size(parts) - 2) & (F.element_at(parts, -1) == ""))
            return F.when(defines, let(F.regexp_extract(part, f"([A-Z]{{2,}}){SPACE}*$", 1), entries)).otherwise(F.array().cast(_ENTRIES))

        return F.flatten(F.transform(parts, ends))

    def second_form(part: Column, k: Column) -> Column:
        alone = F.regexp_extract(part, rf"^{SPACE}*([A-Z]{{2,}}){SPACE}*\)", 1)
        found = F.when((k > 0) & (F.get(opened, k - 1) != ""), alone).otherwise("")
        return F.struct(found.alias("acronym"), F.lit(2).alias("form"), k.alias("at"), F.lit(0).alias("part"))

    itself = F.transform(acronyms, lambda a: F.struct(a.alias("acronym"), F.lit(0).alias("form"), F.lit(0).alias("at"), F.lit(0).alias("part")))
    one = F.flatten(F.transform(closed, first_form)).cast(_ENTRIES)
    two = F.filter(F.transform(opened, second_form), lambda entry: entry["acronym"] != "").cast(_ENTRIES)
    return F.sort_array(F.concat(itself.cast(_ENTRIES), one, two))


def _definitions(text: Column) -> Column:
    """``ARRAY<STRUCT<acronym, definition>>``: one entry per acronym of the text.

    The text is cut at its parentheses once, for all acronyms together. In the sorted entries an acronym's first definition stands behind the acronym
    itself, so nothing is looked up, and only the definitions that are taken are built.
    """

    def define(found: Column) -> Column:
        def of(entries: Column) -> Column:
            def built(entry: Column, i: Column) -> Column:
                def definition(best: Column) -> Column:
                    parts = F.get(found["closed"], best["at"])
                    inside = F.array_join(F.slice(parts, best["part"] + 2, F.size(parts)), "(")
                    front = F.get(found["opened"], best["at"] - 1)
                    return F.when(best["acronym"] != entry["acronym"], F.lit(None)).when(best["form"] == 1, strip(inside)).when(best["form"] == 2, strip(front))

                return F.struct(entry["acronym"].alias("acronym"), let(F.get(entries, i + 1), definition).alias("definition"))

            made = F.transform(entries, lambda entry, i: F.when(entry["form"] == 0, built(entry, i)))
            return F.filter(made, lambda entry: entry.isNotNull())

        return let(_entries(found["acronyms"], found["closed"], found["opened"]), of)

    # What stands behind the last ")" is not closed.
    closed = let(F.split(text, r"\)"), lambda parts: F.slice(parts, F.lit(1), F.size(parts) - 1))
    return let(
        F.struct(
            F.array_distinct(acronyms_in(text)).alias("acronyms"),
            F.transform(closed, lambda part: F.split(part, r"\(")).alias("closed"),
            F.split(text, r"\(").alias("opened"),
        ),
        define,
    )


def acronym_definitions(documents: DataFrame, key: str = "path") -> DataFrame:
    """``(key, acronym, definition)``: the distinct acronyms of each document, null without a definition."""
    return documents.select(key, F.explode(_definitions(F.col("text"))).alias("_found")).select(key, "_found.acronym", "_found.definition")


def acronym_dictionary(documents: DataFrame, key: str = "path", parts: int = PARTS) -> DataFrame:
    """``(acronym, part, definition, n_files, files)``.

    The definition is that of the first document with the acronym, also when it has none there.
    """
    found = acronym_definitions(documents, key).withColumn("part", part_of(F.col(key), parts))
    by_part = found.groupBy("acronym", "part").agg(
        F.sort_array(F.collect_list(key)).alias("files"),
        F.min_by("definition", key).alias("_definition"),
        F.min(key).alias("_first"),
    )
    totals = by_part.groupBy("acronym").agg(
        F.min_by("_definition", "_first").alias("definition"),
        F.min("_first").alias("_first_of_all"),
        F.sum(F.size("files")).alias("n_files"),
    )
    # Both sides of the join read the same columns, so that the parts are shuffled once and reused: the
    # part of the first document takes its own definition, which is that of the totals.
    own = F.col("_first") == F.col("_first_of_all")
    return by_part.join(totals, "acronym").select(
        "acronym",
        "part",
        F.when(own, F.col("_definition")).otherwise(F.col("definition")).alias("definition"),
        "n_files",
        "files",
    )


# Terms


def sentences_of(text: Column) -> Column:
    """Sentences of a text: cut after ``. ! ?`` before whitespace, and at line ends."""
    marked = F.regexp_replace(text, f"([.!?]){SPACE}+", "$1\n")
    return F.filter(F.transform(F.split(marked, "\n"), strip), lambda sentence: sentence != "")


def tokens_of(sentence: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Lower-cased alphabetic tokens of a sentence without stop words. Mixed tokens go as a whole."""
    alphabetic = F.filter(F.split(sentence, _NOT_TOKEN), lambda token: token.rlike(r"^\p{L}+$"))
    return F.filter(F.transform(alphabetic, F.lower), lambda token: ~token.isin(list(stop_words)))


def length_tagger(
    nouns: Sequence[str] = (), others: Sequence[str] = NOT_NOUNS, min_length: int = MIN_NOUN_LENGTH
) -> Tagger:
    """The default tagger: listed words first, then any token of at least ``min_length`` letters is a noun."""

    def tag(token: Column) -> Column:
        by_rule = F.when(F.length(token) >= min_length, NOUN_TAG).otherwise(OTHER_TAG)
        listed = F.when(token.isin(list(others)), OTHER_TAG)
        return (listed.when(token.isin(list(nouns)), NOUN_TAG) if nouns else listed).otherwise(by_rule)

    return lambda tokens: F.transform(tokens, tag)


def model_tagger(tag_tokens: Callable[[list[str]], list[str]]) -> Tagger:
    """A tagger from a Python function over the tokens of a sentence, applied in Arrow batches."""

    @F.pandas_udf("array<string>")
    def tag(sentences):
        return sentences.map(lambda tokens: tag_tokens(list(tokens)))

    return tag


def plural_lemma(noun: Column) -> Column:
    """The default lemma of a single noun: plural endings removed by rule."""
    rule = F.when(F.length(noun) < 4, noun)
    for ending, replacement in PLURAL_RULES:
        stem = F.substring(noun, F.lit(1), F.length(noun) - len(ending))
        rule = rule.when(noun.endswith(ending), F.concat(stem, F.lit(replacement)))
    kept = F.lit(False)
    for ending in NOT_PLURAL:
        kept = kept | noun.endswith(ending)
    return rule.when(noun.endswith("s") & ~kept, F.substring(noun, F.lit(1), F.length(noun) - 1)).otherwise(noun)


def noun_runs_of(tokens: Column, tags: Column, lemma: Lemma = plural_lemma) -> Column:
    """Terms of a sentence: every maximal run of nouns, as a phrase, or as the lemma of a single noun.

    Other tokens become gap marks, so that the runs are the pieces of one string between the marks.
    """
    marked = F.zip_with(tokens, tags, lambda token, tag: F.when(tag.startswith(NOUN_TAG), token).otherwise(_GAP))
    runs = F.transform(F.split(F.array_join(marked, " "), r"\|"), lambda run: F.btrim(run, F.lit(" ")))
    return F.transform(
        F.filter(runs, lambda run: run != ""), lambda run: F.when(run.contains(" "), run).otherwise(lemma(run))
    )


def sentence_rows(documents: DataFrame, key: str = "path") -> DataFrame:
    return documents.select(key, F.posexplode(sentences_of(F.col("text"))).alias("sentence_no", "sentence"))


def token_rows(documents: DataFrame, key: str = "path", stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """``(key, sentence_no, position, token)``; the position counts the tokens that stay."""
    return sentence_rows(documents, key).select(
        key, "sentence_no", F.posexplode(tokens_of(F.col("sentence"), stop_words)).alias("position", "token")
    )


def tagged_token_rows(
    documents: DataFrame,
    key: str = "path",
    tagger: Tagger | None = None,
    stop_words: Sequence[str] = STOP_WORDS,
) -> DataFrame:
    """``(key, sentence_no, position, token, tag)``."""
    tagger = tagger or length_tagger()
    tokens = sentence_rows(documents, key).select(
        key, "sentence_no", tokens_of(F.col("sentence"), stop_words).alias("_tokens")
    )
    zipped = tokens.select(key, "sentence_no", "_tokens", tagger(F.col("_tokens")).alias("_tags"))
    return zipped.select(
        key,
        "sentence_no",
        F.posexplode(F.arrays_zip(F.col("_tokens").alias("token"), F.col("_tags").alias("tag"))).alias("position", "_t"),
    ).select(key, "sentence_no", "position", "_t.token", "_t.tag")


def tag_by_table(tokens: DataFrame, tags: DataFrame, default: Column) -> DataFrame:
    """Tag token rows by a table ``(token, tag)`` of any size; ``default`` where it has no entry."""
    return tokens.join(tags, "token", "left").withColumn("tag", F.coalesce("tag", default))


def noun_run_rows(
    documents: DataFrame,
    key: str = "path",
    tagger: Tagger | None = None,
    lemma: Lemma = plural_lemma,
    stop_words: Sequence[str] = STOP_WORDS,
) -> DataFrame:
    """``(key, sentence_no, run_no, term)``."""
    tagger = tagger or length_tagger()
    sentences = sentence_rows(documents, key).select(
        key, "sentence_no", tokens_of(F.col("sentence"), stop_words).alias("_tokens")
    )
    if hasattr(tagger, "evalType"):  # a vectorised function may not stand inside a lambda
        runs = noun_runs_of(F.col("_tokens"), tagger(F.col("_tokens")), lemma)
    else:
        runs = let(F.col("_tokens"), lambda tokens: noun_runs_of(tokens, tagger(tokens), lemma))
    return sentences.select(key, "sentence_no", F.posexplode(runs).alias("run_no", "term"))


def lemma_by_table(runs: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Replace single-noun terms by a table ``(term, lemma)`` of any size."""
    single = lemmas.filter(~F.col("term").contains(" ")).select("term", "lemma")
    return runs.join(single, "term", "left").withColumn("term", F.coalesce("lemma", "term")).drop("lemma")


def term_postings(runs: DataFrame, key: str = "path") -> DataFrame:
    """``(term, key, n)``: how often each term occurs in each document."""
    return runs.groupBy("term", key).agg(F.count("*").alias("n"))


def term_dictionary(
    documents: DataFrame,
    key: str = "path",
    min_occurrences: int = MIN_OCCURRENCES,
    parts: int = PARTS,
    runs: DataFrame | None = None,
    **options,
) -> DataFrame:
    """``(term, part, occurrences, n_files, files)`` of the terms that occur often enough.

    Occurrences are combined per document, then per part, before anything is grouped by term alone.
    ``runs`` may bring ready term rows (for instance with lemmas from a table).
    """
    runs = noun_run_rows(documents, key, **options) if runs is None else runs
    by_part = (
        term_postings(runs, key).withColumn("part", part_of(F.col(key), parts))
        .groupBy("term", "part")
        .agg(F.sort_array(F.collect_list(key)).alias("files"), F.sum("n").alias("_occurrences"))
    )
    totals = (
        by_part.groupBy("term")
        .agg(F.sum("_occurrences").alias("occurrences"), F.sum(F.size("files")).alias("n_files"))
        .filter(F.col("occurrences") >= min_occurrences)
    )
    # As above: naming the occurrences of the part, never more than all, keeps both sides alike.
    occurrences = F.greatest("occurrences", "_occurrences").alias("occurrences")
    return by_part.join(totals, "term").select("term", "part", occurrences, "n_files", "files")
