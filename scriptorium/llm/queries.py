"""The registered queries of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import (
    bpe,
    chat_format,
    edit_fingerprint,
    exact_dedup,
    gated_lm,
    lexical_search,
    licenses,
    merkle,
    packing,
    quality_classifier,
    quality_rules,
    simhash,
    token_counts,
)
from scriptorium.llm.common import checkpointed, table
from scriptorium.llm.native import lower_ascii


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probability that a document is of good quality."""
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


#: A conversation whose texts look like the marks of a common template.
MARKS_AS_TEXT = "SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what is read back from the formatted conversations."""
    columns = ("conv_id", "turn", "role", "text")
    turns = table(spark, sf_dir, "conversations").select(*columns).unionByName(spark.sql(MARKS_AS_TEXT))
    made = chat_format.format_chats(turns)
    read = made.select(
        "conv_id",
        chat_format.read_turns(F.col("formatted")).alias("turns"),
        chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
    written = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(written.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op3_edit_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness to each other and to the next document's."""
    return edit_fingerprint.edited_by_next(table(spark, sf_dir, "documents"), "doc_id")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 2,048 tokens."""
    return packing.packed_documents(table(spark, sf_dir, "documents"), "doc_id")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the tokens and of the decoded bytes of every document."""
    tokens = bpe.encode(table(spark, sf_dir, "documents"), "doc_id", decoded=True)
    written = F.array_join(F.col("ids").cast("array<string>"), " ")
    return tokens.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.encode(written, "utf-8"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_gated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log-likelihood of every document under a gated recurrent model, and under single words."""
    return gated_lm.score(table(spark, sf_dir, "documents"), "doc_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SimHash fingerprint of every document and its component at two bits or fewer."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", width=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences named in each document."""
    return licenses.scan(table(spark, sf_dir, "documents"), "doc_id")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document, and whether they go beyond a context of 2,048."""
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), "doc_id")
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules' statistics of every document, and whether it is kept."""
    measured = quality_rules.measure(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    judged = quality_rules.decide(checkpointed(measured))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The columns of a document that its leaf covers, in this order.
LEAF = ("doc_id", "source", "lang", "n_chars", "text")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, proof and verification; in a fifth of the documents the text was changed after the manifest was made."""
    docs = table(spark, sf_dir, "documents")
    changed = merkle.leaf_digest(*[lower_ascii(F.col(c)) if c == "text" else F.col(c) for c in LEAF])
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, changed)
    leaves = docs.select(F.col("source").alias("tree"), F.col("doc_id").alias("key"), merkle.leaf_digest(*map(F.col, LEAF)).alias("digest"), tampered.alias("altered"))
    return merkle.manifest(leaves).proof_digests("doc_id")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest-scoring documents of each benchmark item."""
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id", k=20)


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one of its exact copies that stays."""
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"), "doc_id")


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_chat_format": op2_chat_format,
    "op3_edit_fingerprint": op3_edit_fingerprint,
    "op4_packing": op4_packing,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_gated_lm": op6_gated_lm,
    "op7_simhash": op7_simhash,
    "op8_licenses": op8_licenses,
    "op9_token_counts": op9_token_counts,
    "op10_quality_rules": op10_quality_rules,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_lexical_search": op12_lexical_search,
    "op13_exact_dedup": op13_exact_dedup,
}


def _template_values() -> str:
    rows = [(name, licenses.bigrams_of(body), licenses.words_of_template(body)) for name, body in licenses.TEMPLATES]
    return ", ".join(f"('{name}', [{', '.join(repr(g) for g in grams)}], '{words[0]} {words[1]}', {len(words)})" for name, grams, words in rows)


def _rules_sql() -> str:
    """Statistics by unnested windows, and the same expectation-maximisation as a recursive query."""
    n = len(quality_rules.RULES)
    votes = ", ".join(f"CASE WHEN n_words = 0 THEN 0 WHEN {r.bad} THEN 1 WHEN {r.good} THEN 2 ELSE 0 END" for r in quality_rules.RULES)
    odds = f"ln({quality_rules.RIGHT}::DOUBLE / {quality_rules.WRONG})"
    logit = f"list_sum(list_transform(range(1, {n + 1}), lambda r: CASE v[r] WHEN 2 THEN odds[r] WHEN 1 THEN -odds[r] ELSE 0.0 END))"
    right = "list_sum(list_transform(range(1, len(vs) + 1), lambda j: ms[j] * CASE vs[j][r] WHEN 2 THEN q[j] WHEN 1 THEN 1 - q[j] ELSE 0.0 END))"
    cast = "list_sum(list_transform(range(1, len(vs) + 1), lambda j: CASE WHEN vs[j][r] = 0 THEN 0.0 ELSE ms[j] END))"
    share = f"least(({right} + {quality_rules.RIGHT}) / ({cast} + {quality_rules.RIGHT + quality_rules.WRONG}), {quality_rules.MOST}::DOUBLE)"
    return rf"""
        WITH RECURSIVE w AS MATERIALIZED (
          SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
                 list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
          FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
        wins AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
        twice AS (SELECT doc_id, i FROM wins QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
        covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(5) r(k) GROUP BY doc_id),
        s AS MATERIALIZED (
          SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
                 len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(l) AS n_lines,
                 length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS n_capitals, length(regexp_replace(t, '[^!]+', '', 'g')) AS n_exclamations,
                 CASE WHEN len(w) > {quality_rules.BLOCK} THEN list_sum(list_transform(range(0, len(w), {quality_rules.BLOCK}),
                   lambda i: {quality_rules.BLOCK} * len(list_distinct(w[i + 1:i + {quality_rules.BLOCK}]))))::BIGINT // len(w) ELSE len(list_distinct(w)) END AS n_distinct
          FROM w LEFT JOIN covered USING (doc_id)),
        votes AS MATERIALIZED (SELECT *, [{votes}] AS v FROM s),
        patterns AS (SELECT v, count(*)::DOUBLE AS n, len(list_filter(v, lambda x: x > 0)) > 1 AS m FROM votes GROUP BY v),
        counted AS (SELECT list(v ORDER BY v) AS vs, list(CASE WHEN m THEN n ELSE 0.0 END ORDER BY v) AS ms FROM patterns),
        em AS (
          SELECT 0 AS step, vs, ms, list_transform(range({n}), lambda r: {odds}) AS odds FROM counted
          UNION ALL
          SELECT step + 1, vs, ms, list_transform(list_transform(range(1, {n + 1}), lambda r: {share}), lambda a: ln(a / (1 - a)))
          FROM (SELECT *, list_transform(vs, lambda v: 1 / (1 + exp(-{logit}))) AS q FROM em WHERE step < {quality_rules.ROUNDS})),
        posterior AS (SELECT v, 1 / (1 + exp(-{logit})) AS p FROM (SELECT unnest(vs) AS v, odds FROM em WHERE step = {quality_rules.ROUNDS}))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
               NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND p >= 0.5 AS kept
        FROM votes JOIN posterior USING (v)
    """


CAPITALS_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _merkle_sql() -> str:
    """Levels by grouping, proofs by joining each leaf to the runs above it, roots by folding those runs again."""

    def field(value: str) -> str:
        return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}, '-')"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join(field(text if c == 'text' else c) for c in LEAF)})"

    # CRC-32 of the digits of the key, bit by bit.
    bits = "list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, xor(c, ascii(d)::BIGINT))"
    crc = f"xor(4294967295, list_reduce(string_split(doc_id::VARCHAR, ''), lambda c, d: {bits}, 4294967295::BIGINT))"
    up = "SELECT {tree} level + 1, i // 16, sha256(string_agg(d, '' ORDER BY i)) FROM (SELECT *, count(*) OVER ({part}) AS n FROM {name}) WHERE n > 1 GROUP BY {tree} level, i // 16"
    return f"""
        WITH RECURSIVE leaves AS MATERIALIZED (
          SELECT doc_id, source, {leaf('text')} AS d, CASE WHEN {crc} % 5 = 0 THEN {leaf(CAPITALS_SQL.format('text'))} END AS changed,
                 row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM documents),
        nodes AS (SELECT source, 0 AS level, i, d FROM leaves UNION ALL {up.format(tree='source,', part='PARTITION BY source', name='nodes')}),
        built AS MATERIALIZED (SELECT * FROM nodes),
        heights AS MATERIALIZED (SELECT source, max(level) AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS rank FROM built GROUP BY source),
        subroots AS MATERIALIZED (SELECT h.*, b.d AS subroot FROM heights h JOIN built b ON b.source IS NOT DISTINCT FROM h.source AND b.level = h.height),
        tops AS (SELECT 0 AS level, rank AS i, subroot AS d FROM subroots UNION ALL {up.format(tree='', part='', name='tops')}),
        top AS MATERIALIZED (SELECT * FROM tops),
        root AS MATERIALIZED (SELECT level AS height, d AS root FROM top ORDER BY level DESC LIMIT 1),
        steps AS MATERIALIZED (
          SELECT doc_id, l.d AS leaf, changed, subroot, l.source, l.i, height, rank, 0 AS level FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source),
        runs AS MATERIALIZED (
          SELECT doc_id, level, list(d ORDER BY nth) AS run, list_position(list(nth ORDER BY nth), own) AS place FROM (
            SELECT s.doc_id, b.level, b.d, b.i AS nth, s.i // (16 ** b.level)::BIGINT AS own FROM steps s JOIN built b
              ON b.source IS NOT DISTINCT FROM s.source AND b.level < s.height AND b.i // 16 = s.i // (16 ** (b.level + 1))::BIGINT
            UNION ALL
            SELECT s.doc_id, s.height + t.level, t.d, t.i, s.rank // (16 ** t.level)::BIGINT FROM steps s, root r JOIN top t
              ON t.level < r.height WHERE t.i // 16 = s.rank // (16 ** (t.level + 1))::BIGINT) GROUP BY doc_id, level, own),
        ways AS MATERIALIZED (
          SELECT doc_id, list({{'run': run, 'place': place}} ORDER BY level) AS way,
                 string_agg(array_to_string(list_concat(run[:place - 1], run[place + 1:]), ''), '' ORDER BY level) AS proof FROM runs GROUP BY doc_id),
        folds AS (
          SELECT doc_id, 0 AS step, coalesce(changed, leaf) AS d, coalesce(way, []) AS way FROM steps LEFT JOIN ways USING (doc_id)
          UNION ALL
          SELECT doc_id, step + 1, sha256(array_to_string(list_concat(list_append(way[step + 1].run[:way[step + 1].place - 1], d), way[step + 1].run[way[step + 1].place + 1:]), '')), way
          FROM folds WHERE step < len(way))
        SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, f.d AS folded_root, f.d = root AS verified
        FROM steps JOIN folds f USING (doc_id) LEFT JOIN ways USING (doc_id), root WHERE f.step = len(f.way)
    """


ORACLES: dict[str, str] = {
    "op11_merkle_manifest": _merkle_sql(),
    "op12_lexical_search": """
        WITH words AS MATERIALIZED (
          SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
          FROM documents WHERE text IS NOT NULL),
        sized AS MATERIALIZED (SELECT doc_id, w, len(w)::BIGINT AS n FROM words WHERE len(w) > 0),
        whole AS MATERIALIZED (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM sized),
        tf AS MATERIALIZED (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM sized) GROUP BY ALL),
        weights AS MATERIALIZED (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, whole GROUP BY term, docs),
        asked AS MATERIALIZED (SELECT item_id, term, count(*)::BIGINT AS times FROM (
          SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE text IS NOT NULL) GROUP BY ALL),
        scores AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::BIGINT AS score
          FROM asked JOIN weights USING (term) JOIN tf USING (term), whole GROUP BY item_id, doc_id),
        ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scores WHERE score > 0)
        SELECT * FROM ranked WHERE rank <= 20
    """,
    "op13_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, {CAPITALS_SQL.format("coalesce(text, '')")} AS t FROM documents)
    """,
    "op10_quality_rules": _rules_sql(),
    "op8_licenses": f"""
        WITH t(license, grams, first, n_words) AS (VALUES {_template_values()}),
        d AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g') AS x FROM documents),
        g AS (SELECT doc_id, x, regexp_split_to_array(x, '\\n *\\n[ \\n]*') AS p FROM d),
        parts AS (
          SELECT doc_id, unnest(list_concat(string_split(x, chr(10)), list_filter(p, lambda y: contains(y, chr(10))), CASE WHEN len(p) > 1 THEN [x] ELSE [] END)) AS part
          FROM g),
        words AS (SELECT doc_id, row_number() OVER () AS part, list_filter(regexp_split_to_array(part, '[ \\n]+'), lambda y: y <> '') AS w FROM parts),
        grams AS (SELECT doc_id, part, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM words WHERE len(w) > 1),
        whole AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(x, '[ \\n]+'), lambda y: y <> '') AS w FROM d),
        pairs AS (SELECT doc_id, unnest(range(1, len(w))) AS i, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM whole),
        windows AS (
          SELECT doc_id, i, license, grams, list_distinct(list_transform(range(i, least(i + n_words - 1, len(w))), lambda j: w[j] || ' ' || w[j + 1])) AS b
          FROM pairs JOIN t ON gram = first JOIN whole USING (doc_id)),
        dice AS (
          SELECT doc_id, 1 AS part, part AS place, license, max(2.0::DOUBLE * len(list_intersect(b, grams)) / (len(b) + len(grams))) AS dice FROM grams, t GROUP BY ALL
          UNION ALL
          SELECT doc_id, 0, i, license, max(2.0::DOUBLE * len(list_intersect(b, grams)) / (len(b) + len(grams))) FROM windows GROUP BY ALL),
        best AS (SELECT * FROM dice WHERE dice >= {licenses.LEAST} QUALIFY dice = max(dice) OVER (PARTITION BY doc_id, part, place))
        SELECT doc_id, license, sum(part) AS n_parts, sum(1 - part) AS n_windows, max(dice) AS dice FROM best GROUP BY ALL
    """,
    "op2_chat_format": """
        WITH t AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL
          SELECT -7, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)),
        s AS (
          SELECT *, role IS DISTINCT FROM lag(role) OVER w AS fresh, role IS DISTINCT FROM lead(role) OVER w AS last,
                 regexp_replace(role, '<(\\\\*)\\|', '<\\\\\\1|', 'g') AS e_role, regexp_replace(text, '<(\\\\*)\\|', '<\\\\\\1|', 'g') AS e_text
          FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(length(e_text) + CASE WHEN fresh THEN length('<|block|><|text|>') + length(e_role) ELSE length('<|more|>') END
                   + CASE WHEN last THEN length('<|end|>') + 1 ELSE 0 END)::BIGINT AS formatted_chars
        FROM s GROUP BY conv_id
    """,
}
