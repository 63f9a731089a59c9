"""DuckDB SQL of the out-of-vocabulary study: splits, models, threshold, tests and their counts."""

from __future__ import annotations

import random

from mojiweave.plans.oracles import _STOP, GLUED, LATIN, LEX, STUDY, WORDS, _list, _spans, _values
from mojiweave.sources.fixed import DECLARED, STUDY_PARTICLES, STUDY_PREFIXES, STUDY_PROBES

#: The Japanese words as the study's seed shuffles them.
_SHUFFLED = list(DECLARED)
random.Random(20261010).shuffle(_SHUFFLED)
_BUCKET = "CAST('0x' || substr(md5(word), 1, 8) AS BIGINT)"
_NAMES = "(VALUES ('shape'), ('model'), ('either')) t(test)"


def _stream(ord_: str) -> tuple[str, str]:
    return f"{_list(STUDY_PREFIXES)}[{ord_} % 4 + 1]", f"{_list(STUDY_PARTICLES)}[{ord_} % 9 + 1]"


_PRE, _POST = _stream("ord")
PARTS = [
    LEX, WORDS, STUDY,
    f"english AS (SELECT text AS word FROM words WHERE length(text) BETWEEN 3 AND 24 AND NOT list_contains({_list(_STOP)}, text))",
    f"shuffled AS (SELECT word, place FROM {_values(list(zip(_SHUFFLED, range(len(_SHUFFLED)), strict=True)))} t(word, place))",
    f"""parts AS (
  SELECT word, 'English' AS language, CASE WHEN {_BUCKET} % 100 = 0 THEN 'dev' ELSE 'train' END AS part FROM english
  UNION ALL
  SELECT word, 'Japanese', CASE WHEN place < 55 THEN 'train' WHEN place < 70 THEN 'dev' ELSE 'test' END FROM shuffled
)""",
    """negatives AS (SELECT word, row_number() OVER (ORDER BY k) - 1 AS ord FROM (
  SELECT word, place AS k FROM parts JOIN shuffled USING (word) WHERE language = 'Japanese' AND part = 'test' UNION ALL SELECT word, 1000 + ord FROM study WHERE language = 'Japanese'))""",
    "own AS (SELECT word, language, ord FROM study WHERE language = 'English' UNION ALL SELECT word, 'Japanese', ord FROM negatives)",
    f"""streams AS (SELECT {_PRE} || word || {_POST} AS text, length({_PRE}) AS s, length({_PRE}) + length(word) AS e, language = 'English' AS positive FROM own)""",
    _spans("streams"),
    GLUED.format(words="negatives", n="(SELECT count(*) FROM negatives)"),
    f"probes AS (SELECT word FROM {_values([(w,) for w in STUDY_PROBES])} t(word))",
    "asked AS (SELECT word FROM parts WHERE part = 'dev' UNION SELECT word FROM own UNION SELECT word FROM spans UNION SELECT word FROM glue UNION SELECT word FROM probes)",
    """counts AS (
  SELECT language, substr(s, i - z + 1, z) AS gram, count(*) AS n
  FROM (SELECT language, s, i, unnest(range(1, least(3, i) + 1)) AS z FROM (SELECT language, s, unnest(range(2, length(s) + 1)) AS i FROM (SELECT language, '^' || word || '$' AS s FROM parts WHERE part = 'train'))) GROUP BY ALL
), totals AS (SELECT language, substr(gram, 1, length(gram) - 1) AS context, sum(n) AS total FROM counts GROUP BY ALL)""",
    """places AS (SELECT k.language, word, substr(s, i, 1) AS c, CASE WHEN i >= 3 THEN substr(s, i - 2, 2) END AS c2, substr(s, i - 1, 1) AS c1 FROM (SELECT word, s, unnest(range(2, length(s) + 1)) AS i FROM (SELECT word, '^' || word || '$' AS s FROM asked)), (VALUES ('English'), ('Japanese')) k(language))""",
    """met AS (SELECT p.language, word, c, CASE WHEN t2.total IS NOT NULL THEN c2 WHEN t1.total IS NOT NULL THEN c1 ELSE '' END AS context FROM places p LEFT JOIN totals t2 ON t2.context = c2 AND t2.language = p.language LEFT JOIN totals t1 ON t1.context = c1 AND t1.language = p.language)""",
    """likely AS (SELECT m.language, word, avg(ln((coalesce(n, 0) + 0.25) / (total + 0.25 * 27))) AS l FROM met m JOIN totals t ON t.language = m.language AND t.context = m.context LEFT JOIN counts k ON k.language = m.language AND gram = m.context || c GROUP BY ALL)""",
    "scores AS (SELECT e.word, e.l - j.l AS difference FROM likely e JOIN likely j USING (word) WHERE e.language = 'English' AND j.language = 'Japanese')",
    "dev AS (SELECT language, difference FROM parts JOIN scores USING (word) WHERE part = 'dev')",
    """threshold AS (SELECT v AS threshold FROM (
  SELECT v, count(*) FILTER (language = 'Japanese' AND difference > v) AS fp, count(*) FILTER (language = 'English' AND difference > v) / greatest(1, count(*) FILTER (language = 'English')) AS recall, count(*) FILTER (language = 'Japanese') AS n
  FROM dev, (SELECT round(difference, 5) AS v FROM dev UNION SELECT 0) GROUP BY v) WHERE fp <= floor(n * 0.05) ORDER BY recall DESC, v LIMIT 1)""",
    f"tests AS (SELECT word, difference, {LATIN.format('word')} AS shape, difference > threshold AS model, {LATIN.format('word')} OR difference > threshold AS either FROM scores, threshold)",
    "long_tests AS (SELECT word, 'shape' AS test, shape AS predicted FROM tests UNION ALL SELECT word, 'model', model FROM tests UNION ALL SELECT word, 'either', either FROM tests)",
]
_SQL = "WITH " + ",\n".join(PARTS) + "\n"

STUDY_ORACLES: dict[str, str] = {
    "oov_splits": _SQL + "SELECT language, part, CAST(count(*) AS DOUBLE) AS value FROM parts GROUP BY ALL UNION ALL SELECT '', 'threshold', round(threshold, 5) FROM threshold",
    "oov_predictions": _SQL + "SELECT word, language, CAST(ord AS BIGINT) AS ord, round(difference, 6) AS difference, model, shape FROM own JOIN tests USING (word)",
    "oov_confusion": _SQL
    + "SELECT test, positive, positive_detected, negative, negative_detected, round(positive_detected / positive, 4) AS recall, round(negative_detected / negative, 4) AS false_positive_rate FROM (SELECT test, count(*) FILTER (language = 'English') AS positive, count(*) FILTER (language = 'English' AND predicted) AS positive_detected, count(*) FILTER (language = 'Japanese') AS negative, count(*) FILTER (language = 'Japanese' AND predicted) AS negative_detected FROM own JOIN long_tests USING (word) GROUP BY test)",
    "oov_discordance": _SQL
    + "SELECT a AS first_only, b AS second_only, round(least(1, 2 * list_sum(list_transform(range(0, least(a, b) + 1), lambda k: exp(lgamma(a + b + 1) - lgamma(k + 1) - lgamma(a + b - k + 1)))) / pow(2, a + b)), 9) AS p_two_sided FROM (SELECT count(*) FILTER (model AND NOT shape) AS a, count(*) FILTER (shape AND NOT model) AS b FROM own JOIN tests USING (word) WHERE language = 'English')",
    "oov_lists": _SQL
    + """SELECT list, word, round(difference, 3) AS difference, shape, model FROM (
  SELECT 'missed' AS list, * FROM own JOIN tests USING (word) WHERE language = 'English' AND NOT model UNION ALL SELECT 'false-positive', * FROM own JOIN tests USING (word) WHERE language = 'Japanese' AND model
  UNION ALL SELECT 'model-only', * FROM own JOIN tests USING (word) WHERE language = 'English' AND model AND NOT shape UNION ALL SELECT 'suffix-only', * FROM own JOIN tests USING (word) WHERE language = 'English' AND shape AND NOT model)
UNION ALL SELECT 'probe', word, round(difference, 3), shape, model FROM probes JOIN tests USING (word)""",
    "oov_localized": _SQL
    + f"""SELECT test, (SELECT count(*) FROM streams WHERE positive) AS positive_cases, count(*) FILTER (positive AND gold) AS gold_recovered, CAST(coalesce(sum(n) FILTER (positive), 0) AS BIGINT) AS positive_spans,
(SELECT count(*) FROM streams WHERE NOT positive) AS negative_cases, count(*) FILTER (NOT positive AND n > 0) AS negative_with_any, CAST(coalesce(sum(n) FILTER (NOT positive), 0) AS BIGINT) AS negative_spans
FROM {_NAMES} LEFT JOIN (SELECT test, t.text, positive, count(*) AS n, bool_or(p.start = s AND p."end" = e) AS gold FROM streams t JOIN spans p ON p.text = t.text JOIN long_tests l ON l.word = p.word WHERE predicted GROUP BY ALL) USING (test) GROUP BY test""",
    "glued_counts": _SQL + "SELECT count(*) AS n, count(*) FILTER (shape) AS shape, count(*) FILTER (model) AS model, count(*) FILTER (either) AS either FROM glue JOIN tests USING (word)",
}

_ROWS = {
    ("splits", "oov_splits"): "language, part, CAST(round(value * 100000) AS BIGINT)",
    ("confusion", "oov_confusion"): "test, positive, positive_detected, negative, negative_detected",
    ("localized", "oov_localized"): "test, positive_cases, gold_recovered, positive_spans, negative_cases, negative_with_any, negative_spans",
    ("gluedControls", "glued_counts"): "n, shape, model, either",
    ("discordance", "oov_discordance"): "first_only, second_only",
    ("lists", "oov_lists"): "list, word, shape, model",
}
STUDY_ORACLES["exported_study"] = " UNION ALL ".join(f"SELECT '{section}' AS section, concat_ws('|', {line}) AS line FROM ({STUDY_ORACLES[name]})" for (section, name), line in _ROWS.items())
