"""DuckDB SQL of orthographic evidence and of the phonetic-first reading: anchors and what fills the gaps between them."""

from __future__ import annotations

from mojiweave.plans.lattice_oracles import PHRASES, URL_TEXTS, with_all
from mojiweave.plans.oracles import _BAD, KANAS, LEX, _units

_TOKEN, _KINDS = "a-z0-9._\\-+#@/:", "('japanese-particle', 'japanese-verb-suffix', 'japanese-auxiliary', 'japanese-verb')"
_LETTER = "regexp_matches({}, '^[a-z]+$')"


def _unresolved(of: str, name: str) -> str:
    """CTE `name` (text, x): what of the letters of the texts of `u` is neither kana nor a beginning of it."""
    parts = "CASE WHEN kind <> 'Symbol' THEN length(token) ELSE 0 END AS n, CASE WHEN kind = 'Kana' THEN length(token) ELSE 0 END AS k, CASE WHEN kind = 'Ambiguous' THEN length(token) ELSE 0 END AS a"
    return f"{name} AS (SELECT text, CASE WHEN sum(n) = 0 THEN 0 ELSE least(1, greatest(0, 1 - sum(k) / sum(n) - sum(a) / sum(n) * 0.35::DOUBLE)) END AS x FROM (SELECT text, {parts} FROM u WHERE text IN (SELECT text FROM {of})) GROUP BY text)"


def evidence(source: str) -> list[str]:
    """CTEs up to `evidence` (text, s, e, raw, kind, confidence, complete, reason, at0) of the texts that `source` selects."""
    return [
        LEX, KANAS, f"words AS ({source})",
        "hits AS (SELECT text, i - 1 AS s, i - 1 + length(raw) AS e, raw, output, language, weight, evidence FROM (SELECT text, unnest(range(1, length(text) + 1)) AS i FROM words), (SELECT DISTINCT length(raw) AS n FROM lex) JOIN lex ON length(raw) = n AND substr(text, i, n) = raw AND i + n - 1 <= length(text))",
        "chars AS (SELECT text, i AS at0, substr(text, i + 1, 1) AS c FROM (SELECT text, unnest(range(0, length(text))) AS i FROM words))",
        f"""marks AS (
  SELECT *, w AND (r OR c IN ('#', '+')) AS token, CASE WHEN w THEN at0 - length(regexp_extract(substr(text, 1, at0), '[{_TOKEN}]*$')) ELSE at0 END AS s,
         at0 + 1 + CASE WHEN r THEN length(regexp_extract(substr(text, at0 + 2), '^[{_TOKEN}]*')) ELSE length(regexp_extract(substr(text, at0 + 2), '^[#+]*')) END AS reach
  FROM (SELECT *, at0 > 0 AND regexp_matches(substr(text, at0, 1), '^[a-z0-9]$') AS w, regexp_matches(substr(text, at0 + 2, 1), '^[a-z0-9]$') AS r FROM chars WHERE regexp_matches(c, '^[._\\-+#@/:]$'))
)""",
        # a Japanese suffix inside the token ends it, if what is before it does not read as romaji
        f"""cuts AS (
  SELECT m.text, at0, cut, substr(m.text, at0 + 2, cut - at0 - 1) AS before FROM (SELECT *, unnest(range(at0 + 2, reach)) AS cut FROM marks WHERE token AND r) m
  WHERE {_LETTER.format('substr(m.text, cut + 1, reach - cut)')} AND regexp_matches(substr(m.text, at0 + 2, cut - at0 - 1), '[a-z]')
    AND EXISTS (SELECT 1 FROM hits h WHERE h.text = m.text AND h.s = cut AND language = 'Japanese' AND weight >= 5.1 AND (evidence IN {_KINDS} OR length(raw) >= 3))
)""",
        "spoken AS (SELECT DISTINCT before AS text FROM cuts UNION SELECT raw FROM lex)",
        _units("spoken"),
        _unresolved("spoken", "odd"),
        "ends AS (SELECT c.text, at0, min(cut) AS cut FROM cuts c JOIN odd ON odd.text = before WHERE x >= 0.20 GROUP BY ALL)",
        "tokens AS (SELECT m.text, m.at0, s, coalesce(cut, reach) AS e FROM marks m LEFT JOIN ends USING (text, at0) WHERE token)",
        """evidence AS (
  SELECT text, at0 AS s, at0 + 1 AS e, c AS raw, 'HardBoundary' AS kind, 0.99::DOUBLE AS confidence, true AS complete, 'hard-boundary-symbol' AS reason, at0 FROM chars WHERE contains(',;!?。、！？ ', c)
  UNION ALL SELECT text, at0, at0 + 1, c, 'NeutralSymbol', 0.70, true, 'neutral-symbol', at0 FROM chars WHERE contains('()[]{}"''', c)
  UNION ALL SELECT text, s, e, substr(text, s + 1, e - s), 'LatinBindingToken', 0.97, true, 'binding-symbol-joins-latin-token', at0 FROM tokens t
    WHERE NOT EXISTS (SELECT 1 FROM tokens o WHERE o.text = t.text AND o.s <= t.s AND t.e <= o.e AND (o.s < t.s OR o.e > t.e OR o.at0 < t.at0))
  UNION ALL SELECT text, s, length(text), substr(text, s + 1), 'IncompleteBindingToken', 0.72, false, 'binding-symbol-awaiting-right-context', at0 FROM marks WHERE NOT token AND w AND at0 = length(text) - 1
  UNION ALL SELECT text, at0, at0 + 1, c, 'BindingSymbol', 0.55, false, 'binding-symbol-without-complete-token', at0 FROM marks WHERE NOT token AND NOT (w AND at0 = length(text) - 1)
)""",
    ]


def anchors(source: str) -> list[str]:
    """CTEs up to `anchors` (text, s, e, raw, score, readability, kind): tokens first, then by score and length, none that overlaps one before."""
    return [
        *evidence(source),
        "reads AS (SELECT text AS raw, sum(CASE kind WHEN 'Kana' THEN 1.0 WHEN 'Ambiguous' THEN 0.35 ELSE 0.05 END::DOUBLE * length(token)) / sum(length(token)) AS reads FROM u WHERE text IN (SELECT raw FROM lex) GROUP BY text)",
        "strong_end AS (SELECT DISTINCT text, e AS at0 FROM hits WHERE language = 'Japanese' AND weight >= 5.2)",
        f"strong_start AS (SELECT DISTINCT text, s AS at0 FROM hits WHERE language = 'Japanese' AND weight >= 5.1 AND (evidence IN {_KINDS} OR length(raw) >= 3))",
        """wanted AS (
  SELECT *, length(raw) >= 5 AND ((l AND (r OR e = length(text))) OR (s = 0 AND r)) AS rescued FROM (
    SELECT h.text, s, e, raw, weight, reads, a.at0 IS NOT NULL AS l, b.at0 IS NOT NULL AS r FROM hits h JOIN reads USING (raw) LEFT JOIN strong_end a ON a.text = h.text AND a.at0 = s LEFT JOIN strong_start b ON b.text = h.text AND b.at0 = e WHERE language = 'English')
)""",
        """listed AS (
  SELECT text, s, e, raw, 9.0::DOUBLE + 0.05::DOUBLE * length(raw) AS score, 0.0::DOUBLE AS readability, 'orthographic' AS kind FROM evidence WHERE kind = 'LatinBindingToken'
  UNION ALL
  SELECT text, s, e, raw, 2.0::DOUBLE * greatest(0, least(1, (weight - 3.5::DOUBLE) / 3.5::DOUBLE)) + 2.5::DOUBLE * (1 - reads) + 0.03::DOUBLE * length(raw) + CASE WHEN rescued THEN 2 ELSE 0 END, reads, CASE WHEN reads <= 0.80 THEN 'anomaly' ELSE 'contextual' END FROM wanted WHERE reads <= 0.80 OR rescued
)""",
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY kind <> 'orthographic', round(score, 9) DESC, e - s DESC, s) AS k FROM listed)",
        """picked AS (
  SELECT text, 0::BIGINT AS k, CAST([] AS STRUCT(s BIGINT, e BIGINT)[]) AS held, false AS taken FROM words
  UNION ALL
  SELECT text, k, CASE WHEN free THEN list_append(held, {'s': s, 'e': e}) ELSE held END, free
  FROM (SELECT p.text, r.k, p.held, r.s, r.e, len(list_filter(p.held, lambda h: h.s < r.e AND r.s < h.e)) = 0 AS free FROM picked p JOIN ranked r ON r.text = p.text AND r.k = p.k + 1)
)""",
        "anchors AS (SELECT r.* FROM ranked r JOIN picked p USING (text, k) WHERE taken)",
    ]


def segments(source: str) -> list[str]:
    """CTEs up to `segments` (text, s, e, raw, output, language, confidence, reason): anchors, and each gap read from left to right."""
    symbol, hard = "NOT regexp_matches(c, '^[a-z]$')", "contains(',;!?。、！？ ', c)"
    held = "l.e < p.b AND EXISTS (SELECT 1 FROM japanese q WHERE q.text = p.text AND q.s = l.e)"
    return [
        *anchors(source),
        """gaps AS (SELECT text, a, b FROM (
  SELECT text, coalesce(lag(e) OVER (PARTITION BY text ORDER BY s), 0) AS a, s AS b FROM anchors
  UNION ALL SELECT t.text, coalesce(m, 0), length(t.text) FROM words t LEFT JOIN (SELECT text, max(e) AS m FROM anchors GROUP BY text) USING (text)) WHERE a < b)""",
        "stretch AS (SELECT text AS whole, s, e, substr(text, s + 1, e - s) AS text FROM (SELECT text, s, unnest(range(s + 1, s + 1 + length(regexp_extract(substr(text, s + 1, 16), '^[a-z]+')))) AS e FROM (SELECT text, unnest(range(0, length(text))) AS s FROM words)))",
        "said AS (SELECT DISTINCT text FROM stretch)",
        _units("said").replace("walk AS", "walk2 AS").replace("FROM walk ", "FROM walk2 ").replace("\nu AS (", "\nu2 AS ("),
        "kanas AS (SELECT text, string_agg(preview, '' ORDER BY beg) AS output FROM u2 GROUP BY text HAVING bool_and(kind = 'Kana'))",
        "readable AS (SELECT whole AS text, s, e, text AS raw, output FROM stretch JOIN kanas USING (text))",
        "japanese AS (SELECT * FROM hits WHERE language = 'Japanese')",
        # what each place of a gap that ends at0 b would be read as, if the reading came to it
        "spots AS (SELECT text, b, at0, substr(text, at0 + 1, 1) AS c FROM (SELECT text, b, unnest(range(a, b)) AS at0 FROM gaps))",
        "known AS (SELECT p.text, p.b, at0, max(e) AS e FROM spots p JOIN japanese j ON j.text = p.text AND j.s = at0 AND e <= b GROUP BY ALL)",
        """inside AS (SELECT p.text, p.b, at0, bool_or(j.evidence = 'japanese-particle' AND j.e < p.b) AS particle, bool_or(j.evidence <> 'japanese-particle' AND length(j.raw) >= 3 AND j.weight >= 5.2 AND j.e <= p.b) AS strong
  FROM spots p JOIN japanese j ON j.text = p.text AND j.s > at0 AND j.s < p.b WHERE p.b - at0 BETWEEN 3 AND 8 GROUP BY ALL)""",
        "short AS (SELECT i.text, i.b, i.at0, r.output FROM inside i JOIN readable r ON r.text = i.text AND r.s = i.at0 AND r.e = i.b WHERE particle AND NOT strong)",
        f"""blocks AS (SELECT p.text, p.b, p.at0, min(n.at0) AS stop FROM spots p JOIN (SELECT * FROM spots n WHERE {symbol} OR EXISTS (SELECT 1 FROM japanese j WHERE j.text = n.text AND j.s = n.at0 AND j.weight >= 5.2 AND length(j.raw) >= 3 AND j.e <= n.b)) n
  ON n.text = p.text AND n.b = p.b AND n.at0 > p.at0 GROUP BY ALL)""",
        "longest AS (SELECT p.text, p.b, p.at0, max(r.e) AS e FROM spots p LEFT JOIN blocks k USING (text, b, at0) JOIN readable r ON r.text = p.text AND r.s = p.at0 AND r.e <= least(coalesce(k.stop, p.b), p.b) GROUP BY ALL)",
        f"""steps AS (
  SELECT p.text, p.b, p.at0 AS s, CASE WHEN {symbol} THEN p.at0 + 1 WHEN k.e IS NOT NULL THEN k.e WHEN h.output IS NOT NULL THEN p.b WHEN l.e IS NOT NULL THEN l.e ELSE p.at0 + 1 END AS e,
         CASE WHEN {symbol} THEN c WHEN k.e IS NOT NULL THEN j.output WHEN h.output IS NOT NULL THEN h.output WHEN l.e IS NOT NULL THEN r.output ELSE c END AS output,
         CASE WHEN {symbol} OR (k.e IS NULL AND h.output IS NULL AND l.e IS NULL) THEN 'Unknown' ELSE 'Japanese' END AS language,
         CASE WHEN {hard} THEN 0.99 WHEN {symbol} THEN 0.70 WHEN k.e IS NOT NULL THEN CASE WHEN j.evidence = 'japanese-romaji-alias' THEN 0.92 ELSE 0.96 END WHEN h.output IS NOT NULL THEN 0.84 WHEN l.e IS NOT NULL THEN CASE WHEN {held} THEN 0.89 ELSE 0.80 END ELSE 0.15 END::DOUBLE AS confidence,
         CASE WHEN {hard} THEN 'stage2-hard-boundary-symbol' WHEN {symbol} THEN 'stage2-symbol' WHEN k.e IS NOT NULL THEN 'stage2-' || j.evidence WHEN h.output IS NOT NULL THEN 'stage2-short-whole-phonetic'
              WHEN l.e IS NOT NULL THEN CASE WHEN {held} THEN 'stage2-phonetic-fallback-boundary-supported' ELSE 'stage2-phonetic-fallback' END ELSE 'stage2-unresolved' END AS reason
  FROM spots p LEFT JOIN known k USING (text, b, at0) LEFT JOIN japanese j ON j.text = p.text AND j.s = p.at0 AND j.e = k.e
  LEFT JOIN short h USING (text, b, at0) LEFT JOIN longest l USING (text, b, at0) LEFT JOIN readable r ON r.text = p.text AND r.s = p.at0 AND r.e = l.e
)""",
        """taken AS (
  SELECT text, b, a AS at0 FROM gaps
  UNION ALL
  SELECT t.text, t.b, s.e FROM taken t JOIN steps s ON s.text = t.text AND s.b = t.b AND s.s = t.at0 WHERE s.e < t.b
)""",
        """segments AS (
  SELECT s.text, s.s, s.e, substr(s.text, s.s + 1, s.e - s.s) AS raw, output, language, confidence, reason FROM steps s JOIN taken t ON t.text = s.text AND t.b = s.b AND t.at0 = s.s
  UNION ALL
  SELECT text, s, e, raw, raw, 'English', CASE kind WHEN 'orthographic' THEN 0.98 WHEN 'contextual' THEN 0.94 ELSE greatest(0, least(0.99::DOUBLE, 0.90::DOUBLE + (1 - readability) * 0.08::DOUBLE)) END,
         CASE kind WHEN 'orthographic' THEN 'stage2-orthographic-latin-token' WHEN 'contextual' THEN 'stage2-english-from-context-boundaries' ELSE 'stage2-english-from-phonetic-anomaly' END FROM anchors
)""",
    ]


TEXTS = f"SELECT text FROM ({PHRASES}) UNION SELECT text || 'wotukau' FROM ({URL_TEXTS})"

PHONETIC_ORACLES: dict[str, str] = {
    "symbol_evidence": with_all(evidence(URL_TEXTS), 'SELECT text, s AS start, e AS "end", raw, kind, confidence, complete, reason FROM evidence'),
    "anchors": with_all(anchors(TEXTS), 'SELECT text, s AS start, e AS "end", raw, round(score, 9) AS score, round(readability, 9) AS readability, kind FROM anchors'),
    "gap_resolution": with_all(segments(TEXTS), 'SELECT text, s AS start, e AS "end", raw, output, language, round(confidence, 9) AS confidence, reason FROM segments'),
    "uncovered_units": with_all(
        [*segments(TEXTS), _units("words").replace("walk AS", "walk3 AS").replace("FROM walk ", "FROM walk3 ").replace("\nu AS (", "\nu3 AS (")],
        """SELECT text, beg - 1 AS start, beg - 1 + length(token) AS "end", preview, kind FROM u3 WHERE NOT EXISTS (SELECT 1 FROM segments s WHERE s.text = u3.text AND language = 'English' AND confidence >= 0.90 AND s.s <= beg - 1 AND beg - 1 + length(token) <= s.e)""",
    ),
    "phonetic_violations": f"SELECT text, length(text) AS steps, length(text) AS characters, 0::BIGINT AS broken FROM ({TEXTS})",
    "quarantined_inputs": f"SELECT page_id, url, rejected, instr(url, rejected) - 1 AS rejected_at FROM (SELECT page_id, url, regexp_extract(url, '{_BAD}') AS rejected FROM pages) WHERE rejected <> ''",
}
