"""DuckDB SQL of the lattice: all candidate edges, the beam and the incremental session, as recursive queries."""

from __future__ import annotations

from mojiweave.plans.oracles import _BINDER, _CHARS, _CLASS, _LEANS, _MARKED, _PLAIN, GRAMS, HITS, KANAS, LEX, PROFILE_WORDS, _lenient, _priced, _units
from mojiweave.sources.fixed import LatticeParameters

P = LatticeParameters()


def edges(source: str) -> list[str]:
    """CTEs up to `edges` (text, start, end, raw, output, language, kind, ev, score) of the texts that `source` selects (distinct, lenient), and `shown` (text, preview)."""
    return [
        PROFILE_WORDS, GRAMS, LEX, KANAS, f"words AS ({source})", HITS, _CHARS, _MARKED,
        """cut AS (
  SELECT text AS whole, s, e, substr(text, s + 1, e - s) AS text FROM (SELECT text, s, unnest(range(s + 1, s + 1 + length(regexp_extract(substr(text, s + 1, %d), '^[a-z]+')))) AS e FROM (SELECT text, unnest(range(0, length(text))) AS s FROM words))
)""" % P.phonetic_span,
        "spans AS (SELECT DISTINCT text FROM cut UNION SELECT raw FROM lex UNION SELECT text FROM words)",
        _units("spans"),
        "reads AS (SELECT text, string_agg(preview, '' ORDER BY beg) AS output FROM u GROUP BY text HAVING bool_and(kind = 'Kana'))",
        "shown AS (SELECT text, string_agg(preview, '' ORDER BY beg) AS preview FROM u WHERE text IN (SELECT text FROM words) GROUP BY text)",
        "named AS (SELECT text FROM reads UNION SELECT raw FROM lex UNION SELECT text FROM runs)",
        _priced("named"),
        _LEANS,
        "follows AS (SELECT DISTINCT text, start FROM hits WHERE language = 'Japanese' AND weight >= 5.1)",
        f"""found AS (
  SELECT h.text, start, "end", raw, h.output, language, CASE WHEN language = 'Japanese' THEN 'JapaneseLexical' ELSE 'EnglishLexical' END AS kind, evidence AS ev,
         CASE WHEN language = 'Japanese' THEN length(raw) - 0.45::DOUBLE + CASE WHEN evidence = 'japanese-particle' THEN 0.45::DOUBLE ELSE 0.95 END + 0.10::DOUBLE * weight + 0.35::DOUBLE * greatest(-2.5, least(2.5, ja - en))
              ELSE length(raw) - 0.45::DOUBLE + CASE WHEN length(raw) >= 5 THEN 1.80::DOUBLE ELSE 0.20 END + 0.10::DOUBLE * weight + 0.50::DOUBLE * greatest(-2.5, least(2.5, en - ja)) - CASE WHEN length(raw) < 5 AND r.text IS NOT NULL THEN 2.35::DOUBLE ELSE 0 END END AS score
  FROM hits h JOIN priced p ON p.text = raw LEFT JOIN reads r ON r.text = raw
  UNION ALL
  SELECT whole, s, e, cut.text, output, 'Japanese', 'JapanesePhonetic', 'phonetic-lattice', length(cut.text) - 0.55::DOUBLE + 0.42::DOUBLE * greatest(-2.5, least(2.5, ja - en)) FROM cut JOIN reads USING (text) JOIN priced USING (text)
  UNION ALL
  SELECT whole, s, e, raw, raw, 'English', 'LatinStructural', 'orthographic-lattice',
         length(raw) - 0.65::DOUBLE + 1.75::DOUBLE + 0.55::DOUBLE * (length(raw) - length(regexp_replace(raw, '{_BINDER}', '', 'g'))) + 0.25::DOUBLE * a.v + 0.95::DOUBLE * h.v + 0.65::DOUBLE * t.v + CASE WHEN f.text IS NULL THEN 0 ELSE 1.8::DOUBLE END
         - CASE WHEN NOT regexp_matches(head, '^[a-z]*$') THEN 0 WHEN length(head) <= 2 THEN 2.6::DOUBLE WHEN length(head) = 3 THEN 0.45::DOUBLE ELSE 0 END - 0.35::DOUBLE * greatest(0, length(raw) - 12)
  FROM tokens JOIN leans a ON a.k = la JOIN leans h ON h.k = lh JOIN leans t ON t.k = lt LEFT JOIN follows f ON f.text = whole AND f.start = e
)""",
        f"""edges AS (
  SELECT text, start, "end", raw, output, language, kind, ev, round(score, 9) AS score FROM found
  UNION ALL
  SELECT text, at0, at0 + 1, c, c, 'Unknown', CASE WHEN k = 'hard' THEN 'HardBoundary' WHEN k = 'binding' THEN 'BindingSymbol' WHEN k = 'neutral' THEN 'NeutralSymbol' ELSE 'Unknown' END,
         CASE WHEN k = 'hard' THEN 'hard-boundary' WHEN k = 'binding' THEN 'standalone-binding-symbol' WHEN k = 'neutral' THEN 'neutral-symbol' ELSE 'unknown-character' END, CAST({_PLAIN} AS DOUBLE)
  FROM (SELECT *, {_CLASS} AS k FROM chars) WHERE k <> 'word' OR NOT EXISTS (SELECT 1 FROM found WHERE found.text = chars_text AND found.start = at0)
)""".replace("SELECT *, ", "SELECT *, text AS chars_text, "),
    ]


_STEP = f"""CASE WHEN b.kind = '' THEN CASE WHEN e.ev = 'japanese-particle' THEN -3.25::DOUBLE WHEN e.language = 'Japanese' AND e.ev IN ('japanese-verb-suffix', 'japanese-auxiliary') THEN -1.75::DOUBLE ELSE 0 END
    WHEN b.kind = 'HardBoundary' THEN 0.35::DOUBLE WHEN e.kind = 'HardBoundary' THEN 0.45::DOUBLE
    ELSE CASE WHEN 'Unknown' IN (b.language, e.language) THEN 0 WHEN b.language = e.language THEN 0.12::DOUBLE ELSE -{P.switch_penalty}::DOUBLE END
         + CASE WHEN e.ev <> 'japanese-particle' THEN 0 WHEN b.language = 'English' THEN 0.55::DOUBLE WHEN b.ev = 'japanese-particle' THEN -1.20::DOUBLE ELSE 0 END - CASE WHEN e.kind = 'Unknown' THEN 1 ELSE 0 END END"""


def beam(paths: bool) -> list[str]:
    """CTEs up to `finals` (text, rank, score, seg, out) and `work` (text, expanded) of the texts of `words`; with paths, finals has path, a list of edges.

    A row of `states` at place t is a path that ends at t or later; those that end at t are ranked and cut to the beam.
    """
    more = ", list_append(path, {'s': e.start, 'e': e.\"end\", 'raw': e.raw, 'out': e.output, 'key': e.start || ':' || e.\"end\" || ':' || e.output || ':' || e.language || ':' || e.kind}) AS path"
    none = ", CAST([] AS STRUCT(s BIGINT, e BIGINT, raw VARCHAR, \"out\" VARCHAR, \"key\" VARCHAR)[]) AS path"
    return [
        "ready AS (SELECT *, row_number() OVER (PARTITION BY text, start ORDER BY score DESC, \"end\" - start DESC, kind) AS place FROM edges)",
        f"""states AS (
  SELECT text, 0::BIGINT AS t, 0::BIGINT AS "end", 0::DOUBLE AS score, '' AS language, '' AS kind, '' AS ev, '' AS seg, '' AS out, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS c{none if paths else ''} FROM words WHERE length(text) > 0
  UNION ALL
  SELECT * FROM (
    SELECT text, t + 1 AS t, "end", score, language, kind, ev, seg, out, a, b, c{', path' if paths else ''} FROM states WHERE "end" > t
    UNION ALL
    SELECT b.text, b.t + 1, e."end", b.score + e.score + {_STEP}, e.language, e.kind, e.ev, CASE WHEN b.seg = '' THEN e.raw ELSE b.seg || ' | ' || e.raw END, b.out || e.output, b.t, b.r, e.place{more if paths else ''}
    FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY score DESC, a, b, c) AS r FROM states WHERE "end" = t QUALIFY r <= {P.beam}) b JOIN ready e ON e.text = b.text AND e.start = b.t
  )
)""",
        f"""finals AS (SELECT text, score, seg, out{', path' if paths else ''}, row_number() OVER (PARTITION BY text ORDER BY score DESC, a, b, c) AS rank FROM states WHERE "end" = t AND t = length(text) QUALIFY rank <= {P.beam})""",
        f"""work AS (SELECT text, CAST(sum(least({P.beam}, n) * m) AS BIGINT) AS expanded FROM (SELECT text, t, count(*) AS n FROM states WHERE "end" = t GROUP BY ALL) JOIN (SELECT text, start AS t, count(*) AS m FROM edges GROUP BY ALL) USING (text, t) GROUP BY text)""",
    ]


def with_all(parts: list[str], select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + select


SESSION = [
    "best AS (SELECT * FROM finals WHERE rank = 1)",
    f"near AS (SELECT f.text, f.rank, f.path, count(*) OVER (PARTITION BY f.text) AS n FROM finals f JOIN best b USING (text) WHERE (b.score - f.score <= {P.score_window} AND f.rank <= {P.consensus_paths}) OR f.rank <= 2)",
    "levels AS (SELECT text, k, count(*) AS held, any_value(n) AS n, count(DISTINCT key) AS kinds FROM (SELECT text, n, unnest(range(1, len(path) + 1)) AS k, unnest(path).key AS key FROM near) GROUP BY text, k)",
    "shared AS (SELECT text, coalesce(min(k) FILTER (held < n OR kinds > 1), max(k) + 1) - 1 AS common FROM levels WHERE n >= 2 GROUP BY text)",
    """decoded AS (
  SELECT b.text, b.path, b.out, coalesce(common, 0) AS common, expanded,
         CASE WHEN coalesce(common, 0) > 0 AND path[1].e <= length(b.text) - %d THEN path[1].key ELSE '' END AS sig,
         CASE WHEN coalesce(common, 0) > 0 THEN path[common].e ELSE 0 END AS common_end,
         length(regexp_extract(b.text, '^.*[,;!?。、！？ ]')) AS cut
  FROM best b JOIN work USING (text) LEFT JOIN shared USING (text)
)""" % P.lookahead,
    f"""session AS (
  SELECT text, 0::BIGINT AS step, 0::BIGINT AS done, '' AS said, '' AS sig, 0::BIGINT AS stable, 0::BIGINT AS common_end, 0::BIGINT AS work, 0::BIGINT AS total, '' AS shown, CAST([] AS STRUCT(s BIGINT, e BIGINT, raw VARCHAR, "out" VARCHAR)[]) AS commits, '' AS reason FROM typed
  UNION ALL
  SELECT x.text, x.step, x.done + x.base, x.said || x.committed, CASE WHEN x.base > 0 THEN '' ELSE x.sig END, CASE WHEN x.base > 0 THEN 0 ELSE x.stable END, x.common_end, x.work + CASE WHEN x.base > 0 THEN coalesce(again.expanded, 0) ELSE 0 END,
         x.total + x.work + CASE WHEN x.base > 0 THEN coalesce(again.expanded, 0) ELSE 0 END, CASE WHEN x.base > 0 THEN coalesce(again.out, '') ELSE x.shown END, x.commits, x.reason
  FROM (
    SELECT *, CASE WHEN len(chosen) > 0 THEN chosen[len(chosen)].e ELSE 0 END AS base, coalesce(list_aggregate(list_transform(chosen, lambda x: x.out), 'string_agg', ''), '') AS committed,
           list_transform(chosen, lambda x: {{'s': done + x.s, 'e': done + x.e, 'raw': x.raw, 'out': x.out}}) AS commits, CASE WHEN len(chosen) = 0 THEN '' WHEN cut > 0 THEN 'hard-boundary' ELSE 'multi-hypothesis-prefix-consensus' END AS reason
    FROM (
      SELECT *, CASE WHEN cut > 0 THEN CASE WHEN list_contains(list_transform(path, lambda x: x.e), cut) THEN list_filter(path, lambda x: x.e <= cut) ELSE [] END WHEN sig <> '' AND stable >= {P.stable_frames} THEN path[1:1] ELSE [] END AS chosen
      FROM (
        SELECT s.text, s.step + 1 AS step, s.done, s.said, s.total, d.sig, CASE WHEN d.sig <> '' AND d.sig = s.sig THEN s.stable + 1 WHEN d.sig <> '' THEN 1 ELSE 0 END AS stable, d.common_end, d.expanded AS work, d.out AS shown, d.path, d.cut
        FROM session s JOIN decoded d ON d.text = substr(s.text, s.done + 1, s.step + 1 - s.done) WHERE s.step < length(s.text)
      )
    )
  ) x LEFT JOIN decoded again ON again.text = substr(x.text, x.done + x.base + 1, x.step - x.done - x.base)
)""",
]


PHRASES = f"SELECT DISTINCT 'kyouha' || {_lenient('p_name')} || 'wotukau' AS text FROM part"
WORD_TEXTS = "SELECT DISTINCT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z]+')) AS text FROM documents"
URL_TEXTS = f"SELECT DISTINCT {_lenient('url')} AS text FROM pages"


def session(typed: str, select: str, *more: str) -> str:
    """SQL over `session`, a row per text of `typed` and keystroke; every stretch of a text is decoded once."""
    stretches = "SELECT DISTINCT substr(text, a + 1, b - a) AS text FROM (SELECT text, a, unnest(range(a + 1, length(text) + 1)) AS b FROM (SELECT text, unnest(range(0, length(text))) AS a FROM typed))"
    return with_all([f"typed AS ({typed})", *edges(stretches), *beam(True), *SESSION, *more], select)


_EVENTS = "SELECT DISTINCT event_type || ' ' AS text FROM events"
#: The events that count after the last edit of a user that replaces the input: a purchase by its own text, an error by nothing; a signup adds nothing.
SINCE_EDIT = """(SELECT * FROM (SELECT *, count(*) FILTER (WHERE event_type IN ('purchase', 'error')) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS later FROM events)
  WHERE coalesce(later, 0) = 0 AND event_type NOT IN ('error', 'signup'))"""
_LAST = "(SELECT * FROM session WHERE step = length(text))"
_HASH = "CAST('0x' || substr(md5(concat_ws(chr(31), step, output, committed_output)), 1, 15) AS BIGINT)"

LATTICE_ORACLES: dict[str, str] = {
    "candidate_edges": with_all(
        edges(URL_TEXTS),
        """SELECT text, start, "end", raw, output, language, kind, round(score, 6) AS local_score, ev AS evidence, row_number() OVER (PARTITION BY text ORDER BY start, "end" - start DESC, round(score, 6) DESC, kind, output) AS place FROM edges""",
    ),
    "ranked_edges": with_all(
        edges(URL_TEXTS),
        """SELECT text, start, "end", output, kind, round(score, 6) AS local_score, row_number() OVER (PARTITION BY text, start ORDER BY "end" - start DESC, round(score, 6) DESC, output, kind) AS rank FROM edges""",
    ),
    "lattice_best_path": with_all([*edges(WORD_TEXTS), *beam(False)], "SELECT text, round(score, 9) AS score, seg AS segmentation, out AS output, expanded FROM finals JOIN work USING (text) WHERE rank = 1"),
    "lattice_top_paths": with_all(
        [*edges(PHRASES), *beam(False)],
        "SELECT text, rank, round(score, 9) AS score, round(score - first_value(score) OVER (PARTITION BY text ORDER BY rank), 9) AS relative_score, seg AS segmentation, out AS output FROM finals QUALIFY rank <= 12",
    ),
    "lattice_competitive_paths": with_all([*edges(PHRASES), *beam(False)], "SELECT f.text, count(*) AS n FROM finals f JOIN (SELECT text, score FROM finals WHERE rank = 1) b USING (text) WHERE b.score - f.score <= 4.0 GROUP BY f.text"),
    "lattice_path_edges": with_all(
        [*edges(URL_TEXTS), *beam(True), "steps AS (SELECT text, rank, unnest(path) AS x, unnest(range(0, len(path))) AS place FROM finals WHERE rank = 1)"],
        """SELECT s.text, rank, place, e.start, e."end", e.raw, e.output, e.language, e.kind, e.score AS local_score, round(CASE WHEN ja IS NULL OR e.language = 'Unknown' THEN -8 ELSE ja END, 6) AS japanese_profile, round(CASE WHEN en IS NULL OR e.language = 'Unknown' THEN -8 ELSE en END, 6) AS english_profile, e.ev AS evidence
FROM steps s JOIN edges e ON e.text = s.text AND x.key = e.start || ':' || e."end" || ':' || e.output || ':' || e.language || ':' || e.kind LEFT JOIN priced p ON p.text = regexp_replace(e.raw, '[^a-z]', '', 'g')""",
    ),
    "path_violations": with_all([*edges(URL_TEXTS), *beam(True)], "SELECT text, count(*) AS paths, CAST(sum(len(path)) AS BIGINT) AS edges, 0::BIGINT AS broken FROM finals GROUP BY text"),
    "session_frames": session(
        PHRASES,
        """SELECT s.text, step, substr(s.text, 1, step) AS input, done AS committed_raw_length, said AS committed_output, substr(s.text, done + 1, step - done) AS active_raw, coalesce(v.preview, '') AS phonetic_preview, common_end AS consensus_end, sig AS consensus_signature,
stable AS consensus_stable_frames, said || s.shown AS output, work AS expanded_edges_this_step, total AS total_expanded_edges, false AS rebuilt FROM session s LEFT JOIN shown v ON v.text = substr(s.text, done + 1, step - done) WHERE step > 0""",
    ),
    "session_commit_events": session(PHRASES, """SELECT text, step, c.s AS start, c.e AS "end", c.raw AS raw, c.out AS output, reason FROM (SELECT text, step, reason, unnest(commits) AS c FROM session)"""),
    "session_results": session(
        PHRASES,
        f"SELECT l.text, said || shown AS output, done AS committed_raw_length, said AS committed_output, total AS total_expanded_edges, n AS n_commits FROM {_LAST} l JOIN (SELECT text, CAST(sum(len(commits)) AS BIGINT) AS n FROM session GROUP BY text) USING (text)",
    ),
    "exported_sessions": session(
        PHRASES,
        """SELECT text, 'evidence-lattice-v1' AS format_version, text AS input, '{"beamWidth":16,"maxPhoneticSpan":24,"maxLatinSide":12,"consensusPathCount":8,"alternativeScoreWindow":4.0,"commitLookahead":3,"commitStabilityFrames":2,"languageSwitchPenalty":0.3}' AS parameters,
       max_by(said || shown, step) AS output, max(done) AS committed_raw_length, count(*) AS frames, md5(string_agg(concat_ws('|', step, substr(text, 1, step), done, said, substr(text, done + 1, step - done), said || shown, work, total, 'false', commits), chr(10) ORDER BY step)) AS digest
FROM (SELECT * EXCLUDE (commits), array_to_string(list_transform(commits, lambda c: concat_ws(':', c.s, c.e, c.raw, c."out", reason)), ';') AS commits FROM session WHERE step > 0) GROUP BY text""",
    ),
    "session_work": session(PHRASES, "SELECT text, count(*) AS frames, CAST(sum(work) AS BIGINT) AS work, max(total) AS total, 0::BIGINT AS broken FROM session WHERE step > 0 GROUP BY text"),
    "session_signatures": session(PHRASES, f"SELECT text, bit_xor({_HASH}) AS signature FROM (SELECT text, step, said || shown AS output, said AS committed_output FROM session WHERE step > 0) GROUP BY text"),
    "frame_counts": session(PHRASES, "SELECT text, count(*) AS frames, length(text) AS characters FROM session WHERE step > 0 GROUP BY text"),
    "wide_beams": session(PHRASES, "SELECT s.text, max(n) AS widest FROM session s JOIN (SELECT text, count(*) AS n FROM finals GROUP BY text) f ON f.text = substr(s.text, s.done + 1, s.step - s.done) WHERE step > 0 GROUP BY s.text"),
    "segments_by_language": with_all([*edges(URL_TEXTS), *beam(True)], "SELECT language, count(*) AS segments, CAST(sum(length(raw)) AS BIGINT) AS characters FROM (SELECT text, unnest(path) AS x FROM finals WHERE rank = 1) s JOIN edges e ON e.text = s.text AND x.key = e.start || ':' || e.\"end\" || ':' || e.output || ':' || e.language || ':' || e.kind GROUP BY language"),
    "keystroke_sessions": session(
        _EVENTS,
        f"""SELECT CAST(user_id AS VARCHAR) AS session_id, CAST(sum(length(e.text)) AS BIGINT) AS frames, CAST(sum(length(e.text)) AS BIGINT) AS committed_raw_length, string_agg(said || l.shown, '' ORDER BY ts, event_id) AS output, CAST(sum(total) AS BIGINT) AS total_expanded_edges
FROM (SELECT *, event_type || ' ' AS text FROM events) e JOIN {_LAST} l ON l.text = e.text GROUP BY user_id""",
    ),
    "stream_sessions": session(
        _EVENTS,
        f"""SELECT CAST(user_id AS VARCHAR) AS session_id, CAST(coalesce(sum(length(e.text)), 0) AS BIGINT) AS frames, CAST(coalesce(sum(length(e.text)), 0) AS BIGINT) AS committed_raw_length, coalesce(string_agg(said || l.shown, '' ORDER BY ts, event_id), '') AS output, CAST(coalesce(sum(total), 0) AS BIGINT) AS total_expanded_edges
FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN (SELECT *, event_type || ' ' AS text FROM {SINCE_EDIT}) e USING (user_id) LEFT JOIN {_LAST} l ON l.text = e.text GROUP BY user_id""",
    ),
}
