"""Judging translations, and applying what the judge corrects."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions.fixed import EVALUATION_FAILED
from docloom.operators import review
from docloom.plans.common import WS, documents
from docloom.plans.registry import query


def _judge(original, translated, language):
    """Stands in for a model: a score by length, no JSON at ß, no answer at ñ."""
    if "ñ" in original:
        raise ValueError("judge refused")
    if "ß" in original:
        return "Score: 7"
    return '```json\n{"score": %d, "accuracy": "%s"}\n```' % (len(translated) % 11, language)


_SENT = "SELECT doc_id, text AS original_text, '[hi] ' || text AS translated_text, 'Hindi' AS target_language FROM documents"
_RAW = f"""
SELECT doc_id, CASE
  WHEN contains(original_text, 'ñ') THEN '{{"score": 0, "error": "judge refused", "suggestion": "{EVALUATION_FAILED}"}}'
  WHEN contains(original_text, 'ß') THEN 'Score: 7'
  ELSE '```json' || chr(10) || '{{"score": ' || (length(translated_text) % 11) || ', "accuracy": "Hindi"}}'
    || chr(10) || '```' END AS raw FROM ({_SENT})
"""


def _sent(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id", F.col("text").alias("original_text"), F.concat(F.lit("[hi] "), "text").alias("translated_text"),
        F.lit("Hindi").alias("target_language"))


@query("evaluate", _RAW)
def evaluate(spark, sf_dir):
    return review.evaluate(_sent(spark, sf_dir), _judge, keep=("doc_id",)).select("doc_id", "raw")


@query("evaluate_and_score", f"""
SELECT doc_id, score, CASE WHEN score >= 8 THEN 'good' WHEN score >= 5 THEN 'fair' ELSE 'poor' END AS band,
  error, suggestion
FROM (SELECT doc_id, CASE WHEN starts_with(raw, '```') THEN
    CAST(regexp_extract(raw, '"score": ([0-9]+)', 1) AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS score,
  CASE WHEN raw = 'Score: 7' THEN 'malformed JSON' WHEN starts_with(raw, '{{') THEN 'judge refused' END AS error,
  CASE WHEN starts_with(raw, '```') THEN NULL ELSE '{EVALUATION_FAILED}' END AS suggestion FROM ({_RAW}))
""")
def evaluate_and_score(spark, sf_dir):
    raw = review.evaluate(_sent(spark, sf_dir), _judge, keep=("doc_id",)).select("doc_id", "raw")
    return review.parse_reviews(raw).select(
        "doc_id", "score", review.score_band().alias("band"), "error", "suggestion")


_REVIEWER = "CASE lang WHEN 'en' THEN 'gemini' WHEN 'fr' THEN 'openai' WHEN 'de' THEN 'claude' END"
_TAGGED = "'<p class=\"a\">' || text || '</p>'"


def _plain_judge(name):
    def judge(original, translated, language):
        if "<p" in original or "<p" in translated:
            raise ValueError("a tag was sent")
        return f"{name} {language} {len(original)} {len(translated)}"

    return judge


@query("evaluate_requests", f"""
SELECT doc_id, r AS reviewer_provider, CASE WHEN r IN ('gemini', 'openai') THEN 200 ELSE 503 END AS status,
  CASE WHEN coalesce(r, '') NOT IN ('gemini', 'openai') THEN 'Reviewer ' || chr(39) || coalesce(r, '') || chr(39) || ' not configured'
  END AS detail,
  CASE WHEN r IN ('gemini', 'openai') THEN r || ' hi ' || length(t) || ' ' || length(t) END AS raw
FROM (SELECT doc_id, {_REVIEWER} AS r, trim(' ' || regexp_replace(text, '<[^>]*>?', ' ', 'g') || ' ', {WS}) AS t FROM documents)
""")
def evaluate_requests(spark, sf_dir):
    """Each request by the reviewer it names, without tags; unknown reviewers come back."""
    rows = documents(spark, sf_dir).selectExpr(
        "doc_id", f"{_REVIEWER} AS reviewer_provider", f"{_TAGGED} AS original_text", f"{_TAGGED} AS translated_text",
        "'hi' AS target_language")
    judges = {"gemini": _plain_judge("gemini"), "openai": _plain_judge("openai")}
    return review.evaluate_requests(rows, judges, keep=("doc_id",))


# stored answers: fenced and full; plain; cut off; with null lists. The word is the text's own.
_WORD = "regexp_extract(text, '[A-Za-z]{4,}', 0)"
_JSON = (
    "concat('{\"score\": ', CAST(length(text) % 11 AS VARCHAR(9)), '.5, \"accuracy\": \"a\", \"tone\": \"t\", "
    "\"issues\": [\"' , " + _WORD + ", '\", \"second é\"], \"suggestion\": \"s\", \"corrections\": "
    "[{\"incorrect_snippet\": \"', " + _WORD + ", '\", \"suggested_fix\": \"F\", \"reason\": \"r\"}, "
    "{\"incorrect_snippet\": \"\", \"suggested_fix\": \"G\", \"reason\": null}]}')"
)
_STORED = (
    f"CASE lang WHEN 'en' THEN concat('```json', chr(10), {_JSON}, chr(10), '```') WHEN 'fr' THEN {_JSON} "
    f"WHEN 'de' THEN substr({_JSON}, 1, 60) ELSE '{{\"score\": 4, \"issues\": null, \"corrections\": null}}' END"
)
_GOOD = "lang IN ('en', 'fr')"


def _reviews(spark, sf_dir):
    raw = documents(spark, sf_dir).selectExpr("doc_id", f"{_STORED} AS raw")
    return review.parse_reviews(raw).drop("raw")


@query("parse_reviews", f"""
SELECT doc_id, CASE WHEN {_GOOD} THEN length(text) % 11 + CAST(0.5 AS DOUBLE) WHEN lang = 'es' THEN 4 ELSE 0 END
    AS score,
  CASE WHEN {_GOOD} THEN 'a' END AS accuracy, CASE WHEN {_GOOD} THEN 't' END AS tone,
  CASE WHEN {_GOOD} THEN {_WORD} || '|second é' END AS issues,
  CASE WHEN {_GOOD} THEN 's' WHEN lang = 'de' THEN '{EVALUATION_FAILED}' END AS suggestion,
  CASE WHEN {_GOOD} THEN 2 END AS corrections, CASE WHEN lang = 'de' THEN 'malformed JSON' END AS error
FROM documents
""")
def parse_reviews(spark, sf_dir):
    return _reviews(spark, sf_dir).select(
        "doc_id", "score", "accuracy", "tone", F.array_join("issues", "|").alias("issues"), "suggestion",
        F.when(F.col("corrections").isNotNull(), F.size("corrections")).cast("long").alias("corrections"), "error")


@query("score_band", """
SELECT doc_id, CASE WHEN n_chars % 11 >= 8 THEN 'good' WHEN n_chars % 11 >= 5 THEN 'fair' ELSE 'poor' END AS band
FROM documents
""")
def score_band(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", review.score_band(F.col("n_chars") % 11).alias("band"))


@query("explode_issues", f"""
SELECT doc_id, 0 AS pos, {_WORD} AS issue FROM documents WHERE {_GOOD}
UNION ALL SELECT doc_id, 1, 'second é' FROM documents WHERE {_GOOD}
""")
def explode_issues(spark, sf_dir):
    return review.explode_issues(_reviews(spark, sf_dir), ["doc_id"])


@query("explode_corrections", f"""
SELECT doc_id, 0 AS pos, {_WORD} AS incorrect_snippet, 'F' AS suggested_fix, 'r' AS reason FROM documents WHERE {_GOOD}
UNION ALL SELECT doc_id, 1, '', 'G', NULL FROM documents WHERE {_GOOD}
""")
def explode_corrections(spark, sf_dir):
    return review.explode_corrections(_reviews(spark, sf_dir), ["doc_id"])


# ----------------------------------------------------------------------- corrections

_HTML = "concat('<p>', replace(text, ' the ', ' <b>the</b> '), '</p>')"
# a word of the text with a fix full of pattern signs; words a tag keeps apart; text that is
# nowhere; an empty snippet
_FIX = "X$1&\\y$"
_LOOSE = r"o(?:<[^>]+>)*f(?:<[^>]+>)*(?:\s|&nbsp;)+(?:<[^>]+>)*t(?:<[^>]+>)*h(?:<[^>]+>)*e"


def _corrected(spark, sf_dir):
    docs = documents(spark, sf_dir).selectExpr("doc_id", "text", f"{_HTML} AS html", f"{_WORD} AS word")

    def c(snippet, fix):
        return F.struct(snippet.alias("incorrect_snippet"), F.lit(fix).alias("suggested_fix"),
                        F.lit("r").alias("reason"))

    return docs.withColumn("corrections", F.array(
        c(F.col("word"), _FIX), c(F.lit("of the"), "O$T"), c(F.lit("zz<q"), "Z"), c(F.lit(""), "E")))


def _first_sql(html: str, snippet: str, fix: str) -> str:
    return (f"CASE WHEN {snippet} <> '' AND contains({html}, {snippet}) THEN substr({html}, 1, "
            f"strpos({html}, {snippet}) - 1) || '{fix}' || substr({html}, strpos({html}, {snippet}) + "
            f"length({snippet})) ELSE {html} END")


_STEP1 = f"SELECT doc_id, word, html, {_first_sql('html', 'word', _FIX)} AS h1 FROM (SELECT doc_id, {_HTML} AS html, {_WORD} AS word FROM documents)"
_STEP2 = f"""
SELECT *, CASE WHEN contains(h1, 'of the') THEN {_first_sql("h1", "'of the'", "O$T")}
  ELSE regexp_replace(h1, '{_LOOSE}', 'O$T', 'g') END AS h2 FROM ({_STEP1})
"""
_OUTCOME = f"""
SELECT doc_id, h2, CASE WHEN word = '' THEN 'ignored' WHEN contains(html, word) THEN 'exact' ELSE 'unmatched' END AS o1,
  CASE WHEN contains(h1, 'of the') THEN 'exact' WHEN h1 <> h2 THEN 'fuzzy' ELSE 'unmatched' END AS o2, word
FROM ({_STEP2})
"""


@query("valid_corrections", f"""
SELECT doc_id, 0 AS pos, word AS incorrect_snippet FROM ({_STEP1}) WHERE word <> '' AND contains(html, word)
UNION ALL SELECT doc_id, 1, 'of the' FROM ({_STEP1}) WHERE contains(html, 'of the')
""")
def valid_corrections(spark, sf_dir):
    docs = _corrected(spark, sf_dir)
    rows = review.explode_corrections(docs, ["doc_id", "html"])
    return review.valid_corrections(rows).select("doc_id", "pos", "incorrect_snippet")


@query("apply_fix_exact", f"SELECT doc_id, h1 AS html FROM ({_STEP1})")
def apply_fix_exact(spark, sf_dir):
    """The first occurrence only."""
    html, word = F.col("html"), F.col("word")
    fixed = F.when(review.usable(word, F.lit(_FIX)), review.fix_exact(html, word, F.lit(_FIX))).otherwise(html)
    return _corrected(spark, sf_dir).select("doc_id", fixed.alias("html"))


@query("apply_fix_fuzzy", f"""
SELECT doc_id, regexp_replace(html, '{_LOOSE}', 'O$T', 'g') AS html FROM (SELECT doc_id, {_HTML} AS html FROM documents)
""")
def apply_fix_fuzzy(spark, sf_dir):
    """Every loose match, through tags."""
    return _corrected(spark, sf_dir).select(
        "doc_id", review.fix_fuzzy(F.col("html"), F.lit("of the"), F.lit("O$T")).alias("html"))


@query("apply_fixes", f"SELECT doc_id, h2 AS fixed_html, o1 || ' ' || o2 || ' unmatched ignored' AS outcome FROM ({_OUTCOME})")
def apply_fixes(spark, sf_dir):
    done = review.apply_fixes(_corrected(spark, sf_dir))
    return done.select("doc_id", "fixed_html", F.array_join("outcome", " ").alias("outcome"))


@query("unmatched_fixes", f"""
SELECT doc_id, 0 AS pos, word AS incorrect_snippet, '{_FIX}' AS suggested_fix FROM ({_OUTCOME}) WHERE o1 = 'unmatched'
UNION ALL SELECT doc_id, 1, 'of the', 'O$T' FROM ({_OUTCOME}) WHERE o2 = 'unmatched'
UNION ALL SELECT doc_id, 2, 'zz<q', 'Z' FROM ({_OUTCOME})
""")
def unmatched_fixes(spark, sf_dir):
    done = review.apply_fixes(_corrected(spark, sf_dir))
    return review.unmatched_fixes(done, ["doc_id"]).select(
        "doc_id", "pos", "incorrect_snippet", "suggested_fix")


@query("dismiss", f"""
SELECT doc_id, array_to_string(list_filter([{_WORD}, 'of the', 'zz<q', ''], lambda x, i: i <> length(text) % 4 + 1), '|')
  AS left_over FROM documents
""")
def dismiss(spark, sf_dir):
    """Each document drops one of its corrections."""
    docs = _corrected(spark, sf_dir)
    kept = review.dismiss("corrections", F.length("text") % 4)
    return docs.select("doc_id", F.array_join(
        F.transform(kept, lambda c: c["incorrect_snippet"]), "|").alias("left_over"))
