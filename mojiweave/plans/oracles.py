"""DuckDB SQL of the queries that SQL can express, written against the tables alone."""

from __future__ import annotations

from mojiweave.sources.fixed import ENDINGS, ENGLISH_SEEDS, ENTRIES, GLUE, JAPANESE_SEEDS, KANA, OOV_WORDS, PHONETIC_WORDS, PREFIXES, STUDY_PARTICLES, STUDY_PREFIXES, STUDY_STOP

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BINDING, _HARD, _NEUTRAL = "._-+#@/:", ",;!?。、！？ ", "()[]{}\"'"


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(_q(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + ")"


def _list(xs) -> str:
    return "[" + ", ".join(map(_q, xs)) + "]"


_CLASS = f"CASE WHEN regexp_matches(c, '^[A-Za-z0-9]$') THEN 'word' WHEN contains({_q(_BINDING)}, c) THEN 'binding' WHEN contains({_q(_HARD)}, c) THEN 'hard' WHEN contains({_q(_NEUTRAL)}, c) THEN 'neutral' ELSE 'other' END"
_BAD = "[^A-Za-z0-9 ._\\-+#@/:,;!?。、！？()\\[\\]{}\"'']"
_NORM = f"translate({{}}, '{_UP}', '{_LOW}')"


def _lenient(x: str) -> str:
    return _NORM.format(f"regexp_replace({x}, '{_BAD}', '', 'g')")


WORDS = f"words AS (SELECT DISTINCT unnest(regexp_extract_all({_NORM.format('text')}, '[a-z]+')) AS text FROM documents)"
LEX = "lex AS (SELECT raw, output, language, CAST(weight AS DOUBLE) AS weight, evidence, ord FROM " + _values([(e.raw, e.output, e.language, e.weight, e.evidence, e.ord) for e in ENTRIES]) + " t(raw, output, language, weight, evidence, ord))"
KANAS = "kana_keys AS (SELECT * FROM " + _values(list(KANA.items())) + " t(k, v))"
PROFILE_WORDS = "pw AS (SELECT * FROM " + _values([(e.language, e.raw) for e in ENTRIES] + [("Japanese", w) for w in JAPANESE_SEEDS] + [("English", w) for w in ENGLISH_SEEDS]) + " t(language, word))"
STUDY = "study AS (SELECT * FROM " + _values([(w, "English", i) for i, w in enumerate(OOV_WORDS)] + [(w, "Japanese", i) for i, w in enumerate(PHONETIC_WORDS)]) + " t(word, language, ord))"
LATIN = f"(length({{0}}) BETWEEN 7 AND 24 AND regexp_matches({{0}}, '({'|'.join(ENDINGS)})$'))"
_STOP = sorted({e.raw for e in ENTRIES if e.language == "Japanese"} | set(OOV_WORDS) | set(PHONETIC_WORDS) | set(STUDY_STOP))


def _units(source: str) -> str:
    """Recursive units of the texts of a CTE `source` (text), as CTE `u`: text, beg (from 1), token, preview, kind."""
    rest = "substr(text, pos)"
    c, d = "substr(text, pos, 1)", "substr(text, pos + 1, 1)"
    token = (
        f"CASE WHEN {c} = {d} AND contains('bcdfghjklmpqrstvwxyz', {c}) THEN {c} WHEN substr(text, pos, 2) = 'nn' THEN 'nn' "
        f"WHEN {c} = 'n' AND ({d} = '' OR NOT contains('aiueoy', {d})) THEN 'n' "
        + " ".join(f"WHEN substr(text, pos, {n}) IN (SELECT k FROM kana_keys WHERE length(k) = {n}) THEN substr(text, pos, {n})" for n in (3, 2, 1))
        + f" WHEN list_contains({_list(PREFIXES)}, {rest}) THEN {rest} ELSE {c} END"
    )
    return f"""
walk AS (
  SELECT text, 1 AS pos, '' AS token, 0 AS beg, '' AS sokuon FROM {source}
  UNION ALL
  SELECT text, pos + length(t), t, pos, CASE WHEN length(t) = 1 AND t = {d} AND contains('bcdfghjklmpqrstvwxyz', t) THEN 'y' ELSE '' END
  FROM (SELECT text, pos, {token} AS t FROM walk WHERE pos <= length(text))
),
u AS (
  SELECT text, beg, token, sokuon, v,
         CASE WHEN NOT regexp_matches(token, '^[a-z]') THEN 'Symbol' WHEN sokuon = 'y' OR token = 'nn' OR (token = 'n' AND substr(text, beg + 1, 1) <> 'y') OR v IS NOT NULL THEN 'Kana' WHEN beg + length(token) > length(text) AND list_contains({_list(PREFIXES)}, token) THEN 'Ambiguous' ELSE 'Pending' END AS kind,
         CASE WHEN NOT regexp_matches(token, '^[a-z]') THEN token WHEN sokuon = 'y' THEN 'っ' WHEN token = 'nn' OR (token = 'n' AND substr(text, beg + 1, 1) <> 'y') THEN 'ん' WHEN v IS NOT NULL THEN v WHEN beg + length(token) > length(text) AND list_contains({_list(PREFIXES)}, token) THEN '{{' || token || '…}}' ELSE '{{' || token || '?}}' END AS preview
  FROM walk LEFT JOIN kana_keys ON k = token AND sokuon = '' WHERE beg > 0
)"""


def _with(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n"


HITS = """hits AS (
  SELECT text, i - 1 AS start, i - 1 + length(raw) AS "end", raw, output, language, weight, evidence
  FROM (SELECT text, unnest(range(1, length(text) + 1)) AS i FROM words), (SELECT DISTINCT length(raw) AS n FROM lex) JOIN lex ON length(raw) = n AND substr(text, i, n) = raw AND i + n - 1 <= length(text)
)"""
GRAMS = """grams AS (
  SELECT language, g AS gram, count(*) AS n FROM (
    SELECT language, unnest(list_concat([substr(s, i, 2) for i in range(1, length(s))], [substr(s, i, 3) for i in range(1, length(s) - 1)])) AS g FROM (SELECT language, '^' || word || '$' AS s FROM pw)
  ) GROUP BY ALL
), sums AS (SELECT language, greatest(1, sum(n)) AS total, greatest(32, count(*)) AS vocabulary FROM grams GROUP BY language)"""


def _priced(source: str) -> str:
    """Scores of the words of a CTE `source` (text), as CTE `priced`: text, ja, en."""
    return f"""
wg AS (SELECT text, unnest(list_concat([substr(s, i, 2) for i in range(1, length(s))], [substr(s, i, 3) for i in range(1, length(s) - 1)])) AS gram FROM (SELECT DISTINCT text, '^' || text || '$' AS s FROM {source})),
each_gram AS (
  SELECT text, ln((coalesce(j.n, 0) + 0.35) / (sj.total + 0.35 * sj.vocabulary)) AS lj, ln((coalesce(e.n, 0) + 0.35) / (se.total + 0.35 * se.vocabulary)) AS le
  FROM wg LEFT JOIN (SELECT * FROM grams WHERE language = 'Japanese') j ON j.gram = wg.gram LEFT JOIN (SELECT * FROM grams WHERE language = 'English') e ON e.gram = wg.gram,
       (SELECT * FROM sums WHERE language = 'Japanese') sj, (SELECT * FROM sums WHERE language = 'English') se
),
priced AS (SELECT text, avg(lj) AS ja, avg(le) AS en FROM each_gram GROUP BY text)"""


_COUNTS = """counts AS (
  SELECT substr(s, i - z + 1, z) AS gram, count(*) AS n
  FROM (SELECT s, i, unnest(range(1, least(3, i) + 1)) AS z FROM (SELECT s, unnest(range(2, length(s) + 1)) AS i FROM (SELECT '^' || word || '$' AS s FROM train))) GROUP BY 1
), totals AS (SELECT substr(gram, 1, length(gram) - 1) AS context, sum(n) AS total FROM counts GROUP BY 1)"""
_TRAIN = f"train AS (SELECT text AS word FROM words WHERE length(text) BETWEEN 3 AND 24 AND NOT list_contains({_list(_STOP)}, text))"
_MIXED = f"mixed AS (SELECT word, language, p || word || a AS text, CAST(length(p) AS BIGINT) AS start, CAST(length(p) + length(word) AS BIGINT) AS \"end\" FROM (SELECT word, language, {_list(STUDY_PREFIXES)}[ord % 4 + 1] AS p, {_list(STUDY_PARTICLES)}[ord % 9 + 1] AS a FROM study))"


def _spans(source: str) -> str:
    return f"""spans AS (
  SELECT text, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end", substr(text, s + 1, e - s) AS word
  FROM (SELECT text, s, unnest(range(s + 7, least(s + 24, length(text)) + 1)) AS e FROM (SELECT text, unnest(range(0, length(text))) AS s FROM (SELECT DISTINCT text FROM {source})))
  WHERE regexp_matches(substr(text, s + 1, e - s), '^[a-zA-Z]+$') AND (e = length(text) OR regexp_matches(substr(text, e + 1), '^({'|'.join(STUDY_PARTICLES)})'))
)"""


GLUED = f"glue AS (SELECT i, word FROM (SELECT i, a.word || {_list(GLUE)}[i % 7 + 1] || b.word AS word FROM (SELECT unnest(range(0, 100)) AS i) JOIN {{words}} a ON a.ord = (i * 7) % {{n}} JOIN {{words}} b ON b.ord = (i * 11 + 3) % {{n}}) WHERE length(word) BETWEEN 7 AND 24)"
_URLS = f"words AS (SELECT DISTINCT {_lenient('url')} AS text FROM pages)"
_BINDER = "[._\\-+#@/:]"
_CHARS = "chars AS (SELECT text, i AS at0, substr(text, i + 1, 1) AS c FROM (SELECT text, unnest(range(0, length(text))) AS i FROM words))"
_MARKED = f"""marked AS (
  SELECT text, at0, c, length(regexp_extract(substr(text, 1, at0), '[a-z0-9]{{0,12}}$')) AS l, length(regexp_extract(substr(text, at0 + 2, 12), '^[a-z0-9]*')) AS r,
         CASE WHEN c = '+' THEN length(regexp_extract(substr(text, at0 + 2), '^\\+*')) ELSE 0 END AS p
  FROM chars WHERE regexp_matches(c, '{_BINDER}')
), cuts AS (
  SELECT DISTINCT text, s, e, substr(text, s + 1, e - s) AS raw FROM (
    SELECT text, s, unnest(CASE WHEN r > 0 THEN range(at0 + 2, at0 + 2 + r) ELSE range(at0 + 1 + p, at0 + 2 + p) END) AS e
    FROM (SELECT *, unnest(range(at0 - l, at0)) AS s FROM marked WHERE l > 0 AND (r > 0 OR c IN ('#', '+'))))
), tokens AS (
  SELECT text AS whole, s, e, raw, head, regexp_replace(raw, '[^a-z]', '', 'g') AS la, regexp_replace(head, '[^a-z]', '', 'g') AS lh, regexp_replace(substr(raw, length(head) + 2), '[^a-z]', '', 'g') AS lt
  FROM (SELECT *, regexp_extract(raw, '^(.*?){_BINDER}', 1) AS head FROM cuts WHERE regexp_matches(raw, '[a-z]'))
), runs AS (SELECT la AS text FROM tokens UNION SELECT lh FROM tokens UNION SELECT lt FROM tokens)"""
_LEANS = "leans AS (SELECT text AS k, CASE WHEN text = '' THEN 0 ELSE greatest(-2.5, least(2.5, en - ja)) END AS v FROM priced)"
_PLAIN = "CASE WHEN k = 'hard' THEN 1.0 WHEN k = 'binding' THEN 0.1 WHEN k = 'neutral' THEN 0.45 ELSE -3.2 END"

ORACLES: dict[str, str] = {
    "structural_edges": _with(PROFILE_WORDS, GRAMS, LEX, _URLS, HITS, _CHARS, _MARKED, _priced("runs"), _LEANS, "follows AS (SELECT DISTINCT text, start FROM hits WHERE language = 'Japanese' AND weight >= 5.1)")
    + f"SELECT whole AS text, s AS start, e AS \"end\", raw AS output, 'LatinStructural' AS kind, round(CAST(length(raw) - 0.65 + 1.75 + 0.55 * (length(raw) - length(regexp_replace(raw, '{_BINDER}', '', 'g'))) AS DOUBLE) + 0.25 * a.v + 0.95 * h.v + 0.65 * t.v + CASE WHEN follows.text IS NULL THEN 0 ELSE 1.8 END - CASE WHEN NOT regexp_matches(head, '^[a-z]*$') THEN 0 WHEN length(head) <= 2 THEN 2.6 WHEN length(head) = 3 THEN 0.45 ELSE 0 END - 0.35 * greatest(0, length(raw) - 12), 6) AS local_score FROM tokens JOIN leans a ON a.k = la JOIN leans h ON h.k = lh JOIN leans t ON t.k = lt LEFT JOIN follows ON follows.text = whole AND follows.start = e",
    "symbol_edges": _with(_URLS, _CHARS) + f"SELECT text, at0 AS start, at0 + 1 AS \"end\", c AS output, CASE WHEN k = 'hard' THEN 'HardBoundary' WHEN k = 'binding' THEN 'BindingSymbol' WHEN k = 'neutral' THEN 'NeutralSymbol' ELSE 'Unknown' END AS kind, CAST({_PLAIN} AS DOUBLE) AS local_score FROM (SELECT *, {_CLASS} AS k FROM chars) WHERE k <> 'word'",
    "unknown_edges": _with(KANAS, LEX, WORDS, HITS, _CHARS, "cut AS (SELECT text AS whole, s, substr(text, s + 1, e - s) AS text FROM (SELECT text, s, unnest(range(s + 1, least(s + 24, length(text)) + 1)) AS e FROM (SELECT text, unnest(range(0, length(text))) AS s FROM words)))", "spans AS (SELECT DISTINCT text FROM cut)", _units("spans"), "reads AS (SELECT text FROM u GROUP BY text HAVING bool_and(kind = 'Kana'))", "held AS (SELECT text, start FROM hits UNION SELECT whole, s FROM cut JOIN reads USING (text))", recursive=True)
    + "SELECT text, at0 AS start, at0 + 1 AS \"end\", c AS output, 'Unknown' AS kind, CAST(-3.2 AS DOUBLE) AS local_score FROM chars WHERE NOT EXISTS (SELECT 1 FROM held WHERE held.text = chars.text AND held.start = at0)",
    "char_class_counts": f"SELECT {_CLASS} AS class, CAST(sum(n) AS BIGINT) AS n, count(*) AS kinds FROM (SELECT c, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY c) GROUP BY 1",
    "normalize_text": f"SELECT conv_id, turn, {_NORM.format('text')} AS text FROM conversations",
    "input_validity": f"SELECT page_id, NOT regexp_matches(url, '{_BAD}') AS allowed, NOT regexp_matches(url, '[^A-Za-z]') AS letters FROM pages",
    "lenient_filter": f"SELECT page_id, {_lenient('url')} AS text FROM pages",
    "prefix_frames": "SELECT p_partkey, step, substr(p_name, 1, step) AS prefix FROM (SELECT p_partkey, p_name, unnest(range(1, length(p_name) + 1)) AS step FROM part)",
    "lexicon_scan": _with(LEX) + "SELECT raw, output, language, weight, evidence, CAST(ord AS BIGINT) AS ord FROM lex",
    "kana_scan": _with(KANAS) + "SELECT k AS romaji, v AS kana FROM kana_keys",
    "kana_convert": _with(KANAS, WORDS, _units("words"), recursive=True) + "SELECT text, CASE WHEN bool_and(kind = 'Kana') THEN string_agg(preview, '' ORDER BY beg) END AS kana FROM u GROUP BY text",
    "phonetic_units": _with(KANAS, WORDS, _units("words"), recursive=True) + "SELECT text, CAST(beg - 1 AS BIGINT) AS start, CAST(beg - 1 + length(token) AS BIGINT) AS \"end\", token AS raw, preview, kind, CAST(CASE kind WHEN 'Kana' THEN 1.0 WHEN 'Ambiguous' THEN 0.35 ELSE 0.05 END AS DOUBLE) AS confidence FROM u",
    "phonetic_coverage": _with(KANAS, WORDS, _units("words"), recursive=True)
    + "SELECT text, preview, round(k, 9) AS kana_coverage, round(a, 9) AS ambiguous_coverage, round(greatest(0, least(1, 1 - k - 0.35::DOUBLE * a)), 9) AS unresolved_ratio FROM (SELECT text, string_agg(preview, '' ORDER BY beg) AS preview, coalesce(sum(length(token)) FILTER (kind = 'Kana'), 0) / sum(length(token)) AS k, coalesce(sum(length(token)) FILTER (kind = 'Ambiguous'), 0) / sum(length(token)) AS a FROM u GROUP BY text)",
    "readability": _with(KANAS, WORDS, _units("words"), recursive=True)
    + "SELECT text, round(sum(c * length(token)) / sum(length(token)), 9) AS whole, round(coalesce(sum(c * o) / nullif(sum(o), 0), 0), 9) AS inner FROM (SELECT text, token, CAST(CASE kind WHEN 'Kana' THEN 1.0 WHEN 'Ambiguous' THEN 0.35 ELSE 0.05 END AS DOUBLE) AS c, greatest(0, least(beg - 1 + length(token), length(text) - 1) - greatest(beg - 1, 1)) AS o FROM u) GROUP BY text",
    "lexicon_hits": _with(LEX, WORDS, HITS) + 'SELECT text, start, "end", output, language, weight, evidence FROM hits',
    "lexicon_prefix_hits": _with(LEX, WORDS) + "SELECT text, raw, language FROM words JOIN lex ON starts_with(raw, text) AND length(raw) > length(text)",
    "boundary_lexical_support": _with(LEX, WORDS, HITS, "conf AS (SELECT raw, greatest(0, least(1, (weight - 3.5) / 3.5)) AS c FROM lex)", "places AS (SELECT text, unnest(range(0, length(text) + 1)) AS position FROM words)", "l AS (SELECT text, \"end\" AS position, max(c) AS l FROM hits JOIN conf USING (raw) GROUP BY ALL)", "r AS (SELECT text, start AS position, max(c) AS r FROM hits JOIN conf USING (raw) GROUP BY ALL)", "begun AS (SELECT substr(raw, 1, n) AS tail, 0.75 * max(c) AS p FROM (SELECT raw, c, unnest(range(1, length(raw))) AS n FROM conf) GROUP BY 1)", "p AS (SELECT text, position, p FROM places JOIN begun ON position > 0 AND tail = substr(text, position + 1))")
    + "SELECT text, position, round(CASE WHEN position = 0 OR position = length(text) THEN 0 WHEN coalesce(l, 0) > 0 AND greatest(coalesce(r, 0), coalesce(p, 0)) > 0 THEN sqrt(l * greatest(coalesce(r, 0), coalesce(p, 0))) ELSE 0.35 * greatest(coalesce(l, 0), coalesce(r, 0), coalesce(p, 0)) END, 9) AS support FROM places LEFT JOIN l USING (text, position) LEFT JOIN r USING (text, position) LEFT JOIN p USING (text, position)",
    "strong_boundary_semi": _with(LEX, WORDS, HITS)
    + "SELECT DISTINCT text, \"end\" AS position, 'before' AS side FROM hits WHERE language = 'Japanese' AND weight >= 5.2 UNION ALL SELECT DISTINCT text, start, 'after' FROM hits WHERE language = 'Japanese' AND weight >= 5.1 AND (evidence IN ('japanese-particle', 'japanese-verb-suffix', 'japanese-auxiliary', 'japanese-verb') OR length(raw) >= 3)",
    "ngram_profile": _with(PROFILE_WORDS, GRAMS) + "SELECT language, gram, n FROM grams",
    "profile_totals": _with(PROFILE_WORDS, GRAMS) + "SELECT language, CAST(total AS BIGINT) AS total, CAST(vocabulary AS BIGINT) AS vocabulary FROM sums",
    "profile_scores": _with(PROFILE_WORDS, GRAMS, WORDS, _priced("words")) + "SELECT text AS word, round(ja, 6) AS japanese, round(en, 6) AS english, round(greatest(-2.5, least(2.5, en - ja)), 6) AS advantage FROM priced",
    "lexical_edges": _with(KANAS, PROFILE_WORDS, GRAMS, LEX, WORDS, HITS, "raws AS (SELECT raw AS text FROM lex)", _priced("raws"), _units("raws"), "conv AS (SELECT text, bool_and(kind = 'Kana') AS reads FROM u GROUP BY text)", recursive=True)
    + "SELECT hits.text, start, \"end\", output, CASE WHEN language = 'Japanese' THEN 'JapaneseLexical' ELSE 'EnglishLexical' END AS kind, round(CASE WHEN language = 'Japanese' THEN length(raw) - 0.45 + CASE WHEN evidence = 'japanese-particle' THEN 0.45 ELSE 0.95 END + 0.10 * weight + 0.35 * greatest(-2.5, least(2.5, ja - en)) ELSE length(raw) - 0.45 + CASE WHEN length(raw) >= 5 THEN 1.80 ELSE 0.20 END + 0.10 * weight + 0.50 * greatest(-2.5, least(2.5, en - ja)) - CASE WHEN length(raw) < 5 AND reads THEN 2.35 ELSE 0 END END, 6) AS local_score FROM hits JOIN priced ON priced.text = raw JOIN conv ON conv.text = raw",
    "phonetic_edges": _with(KANAS, PROFILE_WORDS, GRAMS, WORDS, "cut AS (SELECT text AS whole, s, e, substr(text, s + 1, e - s) AS text FROM (SELECT text, s, unnest(range(s + 1, least(s + 24, length(text)) + 1)) AS e FROM (SELECT text, unnest(range(0, length(text))) AS s FROM words)))", "spans AS (SELECT DISTINCT text FROM cut)", _units("spans"), "reads AS (SELECT text, string_agg(preview, '' ORDER BY beg) AS output FROM u GROUP BY text HAVING bool_and(kind = 'Kana'))", _priced("reads"), recursive=True)
    + "SELECT whole AS text, s AS start, e AS \"end\", output, round(length(cut.text) - 0.55 + 0.42 * greatest(-2.5, least(2.5, ja - en)), 6) AS local_score FROM cut JOIN reads USING (text) JOIN priced USING (text)",
    "binding_runs": f"SELECT text, CAST(place AS BIGINT) AS place, run FROM (SELECT text, unnest(runs) AS run, unnest(range(0, len(runs))) AS place FROM (SELECT text, list_filter(regexp_extract_all(text, '[A-Za-z0-9._\\-+#@/:]+'), lambda r: regexp_matches(r, '[._\\-+#@/:]')) AS runs FROM (SELECT DISTINCT {_lenient('url')} AS text FROM pages)))",
    "suffix_shape": _with(WORDS) + f"SELECT text AS word, {LATIN.format('text')} AS latin_ending FROM words",
    "markov_counts": _with(WORDS, _TRAIN, _COUNTS) + "SELECT gram, n FROM counts",
    "markov_totals": _with(LEX, "train AS (SELECT raw AS word FROM lex WHERE language = 'Japanese')", _COUNTS) + "SELECT context, CAST(total AS BIGINT) AS total FROM totals",
    "markov_likelihood": _with(WORDS, STUDY, _TRAIN, _COUNTS, "places AS (SELECT word, s, unnest(range(2, length(s) + 1)) AS i FROM (SELECT word, '^' || word || '$' AS s FROM study))", "ctx AS (SELECT word, substr(s, i, 1) AS c, CASE WHEN i >= 3 THEN substr(s, i - 2, 2) END AS c2, substr(s, i - 1, 1) AS c1 FROM places)", "met AS (SELECT word, c, CASE WHEN t2.total IS NOT NULL THEN c2 WHEN t1.total IS NOT NULL THEN c1 ELSE '' END AS context FROM ctx LEFT JOIN totals t2 ON t2.context = c2 LEFT JOIN totals t1 ON t1.context = c1)")
    + "SELECT word, round(avg(ln((coalesce(n, 0) + 0.25) / (total + 0.25 * 27))), 6) AS likelihood FROM met JOIN totals USING (context) LEFT JOIN counts ON gram = context || c GROUP BY word",
    "shape_confusion": _with(STUDY) + f"SELECT positive, positive_detected, negative, negative_detected, round(positive_detected / positive, 4) AS recall, round(negative_detected / negative, 4) AS false_positive_rate FROM (SELECT count(*) FILTER (language = 'English') AS positive, count(*) FILTER (language = 'English' AND {LATIN.format('word')}) AS positive_detected, count(*) FILTER (language = 'Japanese') AS negative, count(*) FILTER (language = 'Japanese' AND {LATIN.format('word')}) AS negative_detected FROM study)",
    "mixed_stream_builder": _with(STUDY, _MIXED) + 'SELECT word, language, text, start, "end" FROM mixed',
    "oov_spans": _with(STUDY, _MIXED, _spans("mixed")) + f'SELECT text, start, "end", word FROM spans WHERE {LATIN.format("word")}',
    "oov_all_spans": _with(WORDS, _spans("words")) + "SELECT text, count(*) AS n FROM spans GROUP BY text",
    "glued_controls": _with(STUDY, "ja AS (SELECT word, ord FROM study WHERE language = 'Japanese')", GLUED.format(words="ja", n=len(PHONETIC_WORDS))) + f"SELECT i, word, {LATIN.format('word')} AS shape FROM glue",
    "particle_collisions": _with(WORDS) + f"SELECT text AS word, p AS particle FROM words, (SELECT unnest({_list(STUDY_PARTICLES)}) AS p) WHERE contains(text, p)",
}
