"""Queries p5 to p8 and the SQL of those that SQL can express."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import leak, lookalike, mix, seen
from tidemark.scratch import cut
from tidemark.sources.tables import table


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return seen.over_folder(spark, folder).repeats()


def p5_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return seen.over_folder(spark, folder).verdicts()


def p5_error_rate(spark: SparkSession, folder: str) -> DataFrame:
    ops = table(spark, folder, "incoming_ops")
    stored = table(spark, folder, "leader_sst").select("store_id", "key").unionByName(table(spark, folder, "sst_index").select("store_id", "key"))
    return seen.error_rate(ops, seen.over_folder(spark, folder).verdicts(), seen.exact_repeats(ops, stored))


def p5_error_rate_of_a_worse_answer(spark: SparkSession, folder: str) -> DataFrame:
    """The rate of wrong answers of the verdicts after every tenth of them was turned to ``first``."""
    ops = table(spark, folder, "incoming_ops")
    stored = table(spark, folder, "leader_sst").select("store_id", "key").unionByName(table(spark, folder, "sst_index").select("store_id", "key"))
    worse = seen.over_folder(spark, folder).verdicts().withColumn("verdict", F.when(F.col("op_id") % 10 == 0, "first").otherwise(F.col("verdict")))
    return seen.error_rate(ops, worse, seen.exact_repeats(ops, stored))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return leak.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p6_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    return leak.cleaned(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p6_items(spark: SparkSession, folder: str) -> DataFrame:
    return p6_found(spark, folder).groupBy("item_id").agg(F.count("*").alias("n_documents"))


def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mix.mixture(mix.with_tokens(table(spark, folder, "documents")), table(spark, folder, "mix_targets"))


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mix.shares(p7_mixture(spark, folder), table(spark, folder, "mix_targets"))


def p7_exact_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """The mixture of the largest total that every source with documents can serve."""
    documents, targets = cut(mix.with_tokens(table(spark, folder, "documents"))), table(spark, folder, "mix_targets")
    total = mix.largest_exact_total(mix.source_sizes(documents, targets))
    return mix.mixture(documents, targets, total)


def p7_exact_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mix.shares(p7_exact_mixture(spark, folder), table(spark, folder, "mix_targets"))


def _by_characters(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.lower(F.btrim("source")).alias("source"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("tokens"))


def p7_mixture_by_characters(spark: SparkSession, folder: str) -> DataFrame:
    """The mixture with texts sized by their characters, which SQL can count."""
    return mix.mixture(_by_characters(spark, folder), table(spark, folder, "mix_targets")).select("doc_id", "copy", "source", "tokens")


def p7_shares_by_characters(spark: SparkSession, folder: str) -> DataFrame:
    targets = table(spark, folder, "mix_targets")
    return mix.shares(mix.mixture(_by_characters(spark, folder), targets), targets)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.equal_looking(table(spark, folder, "documents"))


def p8_forms(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.forms(table(spark, folder, "documents")).select("doc_id", "form")


def p8_classes(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.classes(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (p5_found, p5_verdicts, p5_error_rate, p5_error_rate_of_a_worse_answer, p6_found, p6_cleaned, p6_items, p7_mixture, p7_shares, p7_exact_mixture, p7_exact_shares, p7_mixture_by_characters, p7_shares_by_characters, p8_found, p8_forms, p8_classes)}

_SEEN = """WITH k AS (SELECT store_id, key, -1 AS op_id FROM leader_sst UNION ALL SELECT store_id, key, -1 FROM sst_index
UNION ALL SELECT store_id, key, op_id FROM incoming_ops),
f AS (SELECT store_id, key, min(op_id) AS first FROM k WHERE key IS NOT NULL GROUP BY store_id, key),
v AS (SELECT o.op_id, o.op_id <> f.first AS repeated FROM incoming_ops o LEFT JOIN f ON o.store_id = f.store_id AND o.key = f.key) """


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _letters() -> str:
    """Rows of single characters and their forms: those with a decomposition or a look-alike in the scripts of the tables' languages, and wide and joined forms."""
    blocks = (*range(0x80, 0x2500), 0x3000, *range(0xFB00, 0xFB07), *range(0xFF00, 0xFFEF))
    rows = ((chr(i), lookalike._form(chr(i))) for i in blocks if unicodedata.decomposition(chr(i)) or i in lookalike._shape or lookalike._is_invisible(chr(i)) or unicodedata.category(chr(i)) == "Zs")
    return ", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in (*rows, ("\t", " "), ("\ufeff", "")) if a != b)


# Forms by characters: line ends, then each character's form, then composition.
_FORMS = f"""letters(a, b) AS (VALUES {_letters()}),
texts AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM eval_items),
marks AS (SELECT side, id, string_split(regexp_replace(text, '\\r\\n|\\r|\\x{{85}}|\\x{{2028}}|\\x{{2029}}', chr(10), 'g'), '') AS cs FROM texts WHERE text <> ''),
places AS (SELECT side, id, generate_subscripts(cs, 1) AS k, unnest(cs) AS c FROM marks),
shaped AS (SELECT side, id, nfc_normalize(string_agg(coalesce(b, c), '' ORDER BY k)) AS form FROM places LEFT JOIN letters ON a = c GROUP BY side, id),
forms AS (SELECT texts.side, texts.id, texts.text, CASE WHEN texts.text IS NOT NULL THEN coalesce(form, '') END AS form FROM texts LEFT JOIN shaped ON shaped.side = texts.side AND shaped.id = texts.id),
docs AS (SELECT id AS doc_id, text, form FROM forms WHERE side = 'd') """


def _folded() -> str:
    """Rows of letters and the one letter (with its marks) that stands for all it may be read as when case doesn't matter."""
    coarse = leak.Words.shared()._coarse_of
    rows = ((chr(i), unicodedata.normalize("NFC", coarse(chr(i)))) for i in (*range(0x41, 0x600), *range(0x1C80, 0x2000), 0x212A, 0x212B) if chr(i).isalpha())
    return ", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in rows if a != b)


# Windows of words under case and shape.
_WINDOWS = f"""folded(a, b) AS (VALUES {_folded()}),
letters_of AS (SELECT side, id, generate_subscripts(string_split(form, ''), 1) AS k, unnest(string_split(form, '')) AS c FROM forms WHERE form <> ''),
words AS (SELECT side, id, regexp_extract_all(nfc_normalize(string_agg(coalesce(b, c), '' ORDER BY k)), '[\\p{{L}}\\p{{N}}\\p{{M}}]+') AS ws FROM letters_of LEFT JOIN folded ON a = c GROUP BY side, id),
starts AS (SELECT side, id, ws, unnest(generate_series(1, len(ws) - 7)) AS k FROM words WHERE len(ws) >= 8),
windows AS (SELECT DISTINCT side, id, array_to_string(ws[k : k + 7], ' ') AS w FROM starts),
leaks AS (SELECT DISTINCT i.id AS item_id, d.id AS doc_id FROM windows i JOIN windows d ON d.w = i.w AND d.side = 'd' AND i.side = 'i') """

_MIXED = """d AS (SELECT doc_id, lower(trim(source, ' ')) AS source, CAST(coalesce(length(text), 0) AS BIGINT) AS tokens FROM documents WHERE text <> ''),
m AS (SELECT doc_id, d.source, tokens, target_share AS share, max_repeats AS passes FROM d JOIN mix_targets t ON d.source = lower(trim(t.source, ' '))),
s AS (SELECT source AS of, sum(tokens) AS size FROM m GROUP BY source),
p AS (SELECT m.*, unnest(generate_series(1, passes)) AS copy FROM m),
q AS (SELECT p.*, size, sum(tokens) OVER (PARTITION BY source, copy ORDER BY CAST('0x' || substr(md5('0:' || doc_id || ':' || copy), 1, 15) AS BIGINT), doc_id ROWS UNBOUNDED PRECEDING) AS so_far FROM p JOIN s ON source = of),
f AS (SELECT *, CAST((copy - 1) * size + so_far AS DOUBLE) / share AS finish FROM q),
g AS (SELECT *, sum(tokens) OVER (ORDER BY finish, source, doc_id, copy ROWS UNBOUNDED PRECEDING) AS running FROM f),
mixed AS (SELECT doc_id, CAST(copy AS INTEGER) AS copy, source, tokens FROM g WHERE running <= (SELECT sum(size) FROM s)) """

SQL = {
    "p5_found": _SEEN + "SELECT op_id FROM v WHERE repeated",
    "p5_verdicts": _SEEN + "SELECT op_id, CASE WHEN repeated IS NULL THEN 'no key' WHEN repeated THEN 'repeat' ELSE 'first' END AS verdict FROM v",
    "p5_error_rate": _SEEN + "SELECT count(repeated) AS n_rows, count(*) FILTER (repeated) AS n_repeats, CAST(0 AS BIGINT) AS n_wrong, CAST(0 AS DOUBLE) AS wrong_rate FROM v",
    "p5_error_rate_of_a_worse_answer": _SEEN + """, w AS (SELECT repeated, repeated AND op_id % 10 = 0 AS wrong FROM v WHERE repeated IS NOT NULL)
SELECT count(*) AS n_rows, count(*) FILTER (repeated) AS n_repeats, count(*) FILTER (wrong) AS n_wrong, count(*) FILTER (wrong) / count(*) AS wrong_rate FROM w""",
    "p6_found": f"WITH {_FORMS}, {_WINDOWS} SELECT item_id, doc_id FROM leaks",
    "p6_items": f"WITH {_FORMS}, {_WINDOWS} SELECT item_id, count(*) AS n_documents FROM leaks GROUP BY item_id",
    "p7_mixture_by_characters": f"WITH {_MIXED} SELECT doc_id, copy, source, tokens FROM mixed",
    "p7_shares_by_characters": f"""WITH {_MIXED}, u AS (SELECT source, doc_id, count(*) AS uses, sum(tokens) AS tokens FROM mixed GROUP BY source, doc_id),
r AS (SELECT source, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS n_documents, CAST(sum(uses) AS BIGINT) AS n_copies, max(uses) AS most_uses FROM u GROUP BY source)
SELECT lower(trim(t.source, ' ')) AS source, target_share, coalesce(r.tokens, 0) / (SELECT sum(tokens) FROM r) AS actual_share, coalesce(r.tokens, 0) AS tokens, coalesce(n_documents, 0) AS n_documents, coalesce(n_copies, 0) AS n_copies, coalesce(most_uses, 0) AS most_uses
FROM mix_targets t LEFT JOIN r ON r.source = lower(trim(t.source, ' '))""",
    "p8_found": f"WITH {_FORMS} SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM docs a JOIN docs b ON a.form = b.form AND a.text <> b.text AND a.doc_id < b.doc_id",
    "p8_forms": f"WITH {_FORMS} SELECT doc_id, form FROM docs",
    "p8_classes": f"WITH {_FORMS}, k AS (SELECT form, min(doc_id) AS class_id, count(DISTINCT text) AS n_spellings FROM docs WHERE form IS NOT NULL GROUP BY form) SELECT doc_id, class_id, n_spellings FROM docs JOIN k ON docs.form = k.form",
}
