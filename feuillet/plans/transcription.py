"""Queries over transcription rules and user lookups, with their SQL on register lines."""

from pyspark.sql import functions as F

from feuillet.functions.text import CORRECTIONS, ocr_correct_text
from feuillet.operators import extract as E
from feuillet.operators import transcription as T
from feuillet.plans.extract import s_find
from feuillet.plans.registry import query
from feuillet.plans.text import s_ocr

SUGGEST = " UNION ".join(f"SELECT doc_id, unnest(regexp_extract_all(text, '({a}\\.)', 1)) AS original, '{b}' AS corrected, {c}::DOUBLE AS confidence, 'abbreviation:{a}\\.' AS rule FROM lines" for a, b, c in (("bapt", "baptême", 0.95), ("mar", "mariage", 0.90), ("inh", "inhumation", 0.95)))


@query("txt14_transcription_suggest", SUGGEST)
def _(t):
    return T.transcription_suggest(t.lines)


@query("txt15_transcription_apply", "SELECT doc_id, text, replace(replace(replace(text, 'bapt.', 'baptême'), 'mar.', 'mariage'), 'inh.', 'inhumation') AS corrected_text, regexp_matches(text, 'bapt\\.|mar\\.|inh\\.')::INTEGER AS n_applied FROM lines")
def _(t):
    return T.transcription_apply(t.lines)


@query("txt16_validate_correction", "SELECT doc_id, 'inh.' AS original, CASE WHEN doc_id % 2 = 0 THEN 'inhumation' ELSE 'inhumé' END AS corrected, text AS context, CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE 0.7 END::DOUBLE AS confidence FROM lines")
def _(t):
    return T.validate_correction(t.lines.select("doc_id", F.lit("inh.").alias("original"), F.when(F.col("doc_id") % 2 == 0, "inhumation").otherwise("inhumé").alias("corrected"), F.col("text").alias("context")))


@query("udx1_with_corrections", f"SELECT doc_id, {s_ocr('text', {'laboureur': 'cultivateur'})} AS out FROM lines")
def _(t):
    return t.lines.select("doc_id", ocr_correct_text("text", T.with_corrections(CORRECTIONS, {"laboureur": "cultivateur"})).alias("out"))


@query("udx2_with_pattern", f"SELECT doc_id, 'trade' AS kind, start, \"end\", hit FROM {s_find('lines', 'laboureur')}")
def _(t):
    return E.mentions(t.lines, T.with_pattern([], "trade", T.expand_patterns({"trade": "{trade}"}, {"trade": "laboureur"})["trade"]))


@query("udx3_correction_log", "SELECT k AS original, sum((length(text) - length(replace(text, k, ''))) // length(k))::BIGINT AS n FROM lines, (SELECT unnest(['Jeau', 'Cliarles']) AS k) WHERE contains(text, k) GROUP BY k")
def _(t):
    return T.correction_log(t.lines, {k: CORRECTIONS[k] for k in ("Jeau", "Cliarles", "Dom Th")})
