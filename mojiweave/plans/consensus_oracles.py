"""DuckDB SQL of the consensus over prefixes: every hypothesis is listed, so it holds for texts with no more of them than the beam keeps."""

from __future__ import annotations

from mojiweave.plans.consensus import SUPPORT
from mojiweave.plans.oracles import KANAS, LEX, _q, _units

TYPED = """SELECT DISTINCT w || tail AS text FROM (SELECT unnest(string_split_regex(translate(p_name || ' ' || p_type, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z]+')) AS w FROM part), (VALUES (''), ('ha')) k(tail) WHERE w <> ''"""
_SURE = "CASE " + " ".join(f"WHEN {{0}} = {_q(k)} THEN {v}::DOUBLE" for k, v in SUPPORT.items()) + " ELSE 0.20::DOUBLE END"
_VOTE, _LEAST, _PASS, _LAST = 0.67, 2, 0.68, 4


def _mean(*views: str) -> str:
    n = " + ".join(f"CASE WHEN {v} IS NULL THEN 0 ELSE 1 END" for v in views)
    return f"({' + '.join(f'coalesce({v}, 0)' for v in views)}) / ({n})"


def _votes(*views: str) -> str:
    return " + ".join(f"CASE WHEN {v} >= {_VOTE} THEN 1 ELSE 0 END" for v in views)


_STEP = """CASE WHEN b.evidence = '' THEN 0 ELSE CASE WHEN b.language = c.language AND c.language <> 'Unknown' THEN 0.18::DOUBLE ELSE 0 END + CASE WHEN c.evidence = 'japanese-particle' THEN 0.65::DOUBLE ELSE 0 END
    + CASE WHEN c.evidence NOT IN ('japanese-verb-suffix', 'japanese-romaji-alias') THEN 0 WHEN b.language = 'English' THEN 1.05::DOUBLE ELSE 0.40 END
    + CASE WHEN c.language = 'English' AND b.evidence = 'japanese-particle' THEN 0.45::DOUBLE ELSE 0 END - CASE WHEN c.complete THEN 0 ELSE 0.35::DOUBLE END END"""
_VIEWS = ("beam", "reverse", "lexical", "stability")
_READS = ("beam", "lexical", "stability")

PARTS = [
    LEX, KANAS, f"typed AS ({TYPED})",
    "frames_of AS (SELECT text, step, substr(text, 1, step) AS pre FROM (SELECT text, unnest(range(1, length(text) + 1)) AS step FROM typed))",
    "words AS (SELECT DISTINCT pre AS text FROM frames_of)",
    "spots AS (SELECT text, unnest(range(0, length(text))) AS s FROM words)",
    "stretch AS (SELECT text AS whole, s, unnest(range(s + 1, least(s + 16, length(text)) + 1)) AS e FROM spots)",
    "spans AS (SELECT DISTINCT substr(whole, s + 1, e - s) AS text FROM stretch)",
    _units("spans"),
    "reads AS (SELECT text, string_agg(preview, '' ORDER BY beg) AS output FROM u GROUP BY text HAVING bool_and(kind = 'Kana'))",
    "hits AS (SELECT p.text, s, s + length(raw) AS e, raw, output, language, weight, evidence FROM spots p JOIN lex ON substr(p.text, s + 1, length(raw)) = raw)",
    "tails AS (SELECT text, s, substr(text, s + 1) AS tail FROM spots)",
    """begun AS (SELECT t.text, s, tail, CASE WHEN count(DISTINCT language) = 1 THEN any_value(language) ELSE 'Unknown' END AS language, 0.75::DOUBLE + 0.11::DOUBLE * length(tail) + 0.05::DOUBLE * max(weight) AS score
  FROM tails t JOIN lex ON starts_with(raw, tail) AND length(raw) > length(tail) GROUP BY t.text, s, tail)""",
    """listed AS (
  SELECT text, s, e, raw, output, language, true AS complete, evidence, weight AS score, 1 AS branch, -length(raw) AS o FROM hits
  UNION ALL SELECT whole, s, e, r.text, output, 'Japanese', true, 'romaji-fallback', 0.15::DOUBLE + (e - s) * 0.055::DOUBLE, 2, e FROM stretch JOIN reads r ON r.text = substr(whole, s + 1, e - s) WHERE e - s >= 2
  UNION ALL SELECT b.text, s, length(b.text), tail, CASE WHEN language = 'Japanese' THEN coalesce(r.output, tail) ELSE tail END, language, false, 'lexicon-prefix', score, 3, 0 FROM begun b LEFT JOIN reads r ON r.text = tail
)""",
    """candidates AS (
  SELECT *, row_number() OVER (PARTITION BY text, s ORDER BY branch, o) AS k FROM (
    SELECT * FROM listed QUALIFY row_number() OVER (PARTITION BY text, s, e, language, output, complete ORDER BY branch, o) = 1
    UNION ALL SELECT text, s, s + 1, substr(text, s + 1, 1), substr(text, s + 1, 1), 'Unknown', false, 'unknown-character', -3.2::DOUBLE, 4, 0 FROM spots)
)""",
    f"""states AS (
  SELECT text, 0::BIGINT AS t, 0::BIGINT AS e, 0::DOUBLE AS score, '' AS language, '' AS evidence, 0::DOUBLE AS worth, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS c,
         CAST([] AS STRUCT(s BIGINT, e BIGINT, raw VARCHAR, "out" VARCHAR, lang VARCHAR, complete BOOLEAN, ev VARCHAR)[]) AS path FROM words
  UNION ALL
  SELECT * FROM (
    SELECT text, t + 1, e, score, language, evidence, worth, a, b, c, path FROM states WHERE e > t
    UNION ALL
    SELECT b.text, b.t + 1, c.e, b.score + c.score + {_STEP} - 0.55::DOUBLE, c.language, c.evidence,
           b.worth + CASE WHEN c.evidence = 'unknown-character' THEN -4.0::DOUBLE WHEN c.complete THEN c.score + 0.8::DOUBLE * {_SURE.format('c.evidence')} - 0.95::DOUBLE ELSE -1.8::DOUBLE + 0.4::DOUBLE * {_SURE.format('c.evidence')} END,
           b.t, b.r, c.k, list_append(b.path, {{'s': c.s, 'e': c.e, 'raw': c.raw, 'out': c.output, 'lang': c.language, 'complete': c.complete, 'ev': c.evidence}})
    FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY a, b, c) AS r FROM states WHERE e = t) b JOIN candidates c ON c.text = b.text AND c.s = b.t
  )
)""",
    "finals AS (SELECT text AS pre, score, worth, path, row_number() OVER (PARTITION BY text ORDER BY score DESC, a, b, c) - 1 AS h FROM states WHERE e = t AND t = length(text))",
    "weighed AS (SELECT *, exp((score - max(score) OVER (PARTITION BY pre)) / 1.30) AS w FROM finals)",
    "hyps AS (SELECT pre, h, path, worth, w / sum(w) OVER (PARTITION BY pre) AS probability FROM weighed)",
    "ends AS (SELECT pre, h, probability, worth, unnest(list_transform(path, lambda x: x.e)) AS position FROM hyps)",
    "two_way AS (SELECT pre, position, least(1, exp(least(0, max(worth) - any_value(top)) / 1.35)) AS reverse, sum(probability) AS beam FROM ends JOIN (SELECT pre, max(worth) AS top FROM hyps GROUP BY pre) USING (pre) GROUP BY pre, position)",
    "conf AS (SELECT raw, greatest(0, least(1, (weight - 3.5) / 3.5)) AS c FROM lex)",
    "lefts AS (SELECT text, e AS position, max(c) AS l FROM hits JOIN conf USING (raw) GROUP BY ALL)",
    "rights AS (SELECT text, s AS position, max(c) AS r FROM hits JOIN conf USING (raw) GROUP BY ALL)",
    "opens AS (SELECT text, s AS position, 0.75 * max(c) AS p FROM tails JOIN conf ON starts_with(raw, tail) AND length(raw) > length(tail) GROUP BY ALL)",
    """lexical AS (SELECT w.pre, w.position, CASE WHEN w.position = length(w.pre) THEN 0 WHEN coalesce(l, 0) > 0 AND greatest(coalesce(r, 0), coalesce(p, 0)) > 0 THEN sqrt(l * greatest(coalesce(r, 0), coalesce(p, 0))) ELSE 0.35 * greatest(coalesce(l, 0), coalesce(r, 0), coalesce(p, 0)) END AS lexical
  FROM two_way w LEFT JOIN lefts ON lefts.text = w.pre AND lefts.position = w.position LEFT JOIN rights ON rights.text = w.pre AND rights.position = w.position LEFT JOIN opens ON opens.text = w.pre AND opens.position = w.position)""",
    f"""seen AS (SELECT f.text, f.step, w.position, beam, reverse, lexical, f.step = w.position AS is_end,
  CASE WHEN f.step <> w.position AND count(*) OVER last >= 2 THEN avg(beam) OVER last END AS stability
  FROM frames_of f JOIN two_way w USING (pre) JOIN lexical x ON x.pre = w.pre AND x.position = w.position WINDOW last AS (PARTITION BY f.text, w.position, f.step = w.position ORDER BY f.step ROWS BETWEEN {_LAST} PRECEDING AND 1 PRECEDING))""",
    f"""bounds AS (SELECT *, NOT is_end AND probability >= {_PASS} AND support >= {_LEAST} AS confirmed FROM (SELECT *, {_mean(*_VIEWS)} AS probability, {_votes(*_VIEWS)} AS support FROM seen))""",
    f"""scored AS (
  SELECT f.text, f.step, y.h, path, y.probability, coalesce(agreed, 0.5) AS agreed, list_sum(list_transform(path, lambda x: {_SURE.format('x.ev')})) / len(path) AS sure, len(list_filter(path, lambda x: x.lang = 'Unknown')) AS unknown
  FROM frames_of f JOIN hyps y USING (pre) LEFT JOIN (SELECT b.text, b.step, d.h, avg(b.probability) AS agreed FROM frames_of f JOIN ends d USING (pre) JOIN bounds b ON b.text = f.text AND b.step = f.step AND b.position = d.position WHERE d.position < f.step GROUP BY ALL) g ON g.text = f.text AND g.step = f.step AND g.h = y.h
)""",
    """ranked AS (SELECT *, row_number() OVER (PARTITION BY text, step ORDER BY round(ensemble, 9) DESC, round(probability, 9) DESC, h) AS rank FROM (SELECT *, ln(greatest(probability, 1e-12)) + 1.45::DOUBLE * agreed + 0.90::DOUBLE * sure - 0.55::DOUBLE * unknown AS ensemble FROM scored))""",
    """chosen AS (SELECT text, step, x.s AS s, x.e AS e, x.raw AS raw, x."out" AS converted, x.lang AS language, x.complete AS complete, x.ev AS ev FROM (SELECT text, step, unnest(path) AS x FROM ranked WHERE rank = 1))""",
    """mass AS (SELECT text, step, s, e, language, converted, sum(probability) AS beam FROM (SELECT DISTINCT text, step, h, probability, x.s AS s, x.e AS e, x.lang AS language, x."out" AS converted FROM (SELECT text, step, h, probability, unnest(path) AS x FROM ranked)) GROUP BY ALL)""",
    f"""held AS (SELECT *, CASE WHEN n >= 2 THEN same / n END AS stability FROM (
  SELECT *, count(*) FILTER (step > e) OVER (PARTITION BY text, s, e, raw, converted, language ORDER BY step RANGE BETWEEN {_LAST} PRECEDING AND 1 PRECEDING) AS same, least({_LAST}, step - 1 - e) AS n, {_SURE.format('ev')} AS lexical FROM chosen JOIN mass USING (text, step, s, e, language, converted)))""",
    f"""judged AS (SELECT *, {_mean(*_READS)} AS interpretation, {_votes(*_READS)} AS support FROM held)""",
]
_SQL = "WITH RECURSIVE " + ",\n".join(PARTS) + "\n"

CONSENSUS_ORACLES: dict[str, str] = {
    "consensus_frames": _SQL
    + """SELECT r.text, r.step, array_to_string(list_transform(path, lambda x: x.raw), ' | ') AS segmentation, array_to_string(list_transform(path, lambda x: x."out"), '') AS output, round(probability, 9) AS probability, round(ensemble, 9) AS ensemble, round(entropy, 9) AS entropy, n_hypotheses
FROM ranked r JOIN (SELECT text, step, sum(CASE WHEN probability > 0 THEN -probability * log2(probability) END) AS entropy, count(*) AS n_hypotheses FROM ranked GROUP BY ALL) USING (text, step) WHERE rank = 1""",
    "exported_consensus": _SQL
    + """, lines AS (SELECT text, step, string_agg(concat_ws(':', position, confirmed, is_end, support), ';' ORDER BY position) AS b FROM bounds GROUP BY ALL)
SELECT r.text, 'research-v2' AS format_version, r.text AS input, '{"beamWidth":64,"boundaryClearThreshold":0.68,"interpretationClearThreshold":0.68,"consensusVoteThreshold":0.67,"minimumIndependentSupport":2,"stabilityWindow":4,"softmaxTemperature":1.3}' AS parameters, count(*) AS frames,
       md5(string_agg(concat_ws('|', r.step, substr(r.text, 1, r.step), array_to_string(list_transform(path, lambda x: x.raw), ' | '), array_to_string(list_transform(path, lambda x: x."out"), ''), b), chr(10) ORDER BY r.step)) AS digest
FROM ranked r JOIN lines USING (text, step) WHERE rank = 1 GROUP BY r.text""",
    "consensus_hypotheses": _SQL + "SELECT text, step, count(*) AS hypotheses, round(max(probability), 9) AS best, CAST(sum(len(path)) AS BIGINT) AS segments, CAST(sum(unknown) AS BIGINT) AS unknown FROM scored GROUP BY text, step",
    "consensus_boundaries": _SQL
    + "SELECT text, step, position, round(probability, 9) AS probability, round(beam, 9) AS beam, round(reverse, 9) AS reverse, round(lexical, 9) AS lexical, round(stability, 9) AS stability, support, confirmed, is_end FROM bounds",
    "consensus_segments": _SQL
    + f"""SELECT j.text, j.step, s AS start, e AS "end", raw, converted, language, complete, complete AND NOT is_end AND confirmed AND interpretation >= {_PASS} AND j.support >= {_LEAST} AS confirmed, round(b.probability, 9) AS boundary, round(j.beam, 9) AS beam, round(j.lexical, 9) AS lexical,
round(coalesce(j.stability, -1), 9) AS stability, round(interpretation, 9) AS interpretation, j.support, CASE WHEN NOT is_end AND confirmed THEN 'ClearBoundary' ELSE 'AmbiguousBoundary' END || CASE WHEN interpretation >= {_PASS} AND j.support >= {_LEAST} THEN 'ClearInterpretation' ELSE 'AmbiguousInterpretation' END AS certainty
FROM judged j JOIN bounds b ON b.text = j.text AND b.step = j.step AND b.position = j.e""",
}
