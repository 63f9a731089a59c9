"""DuckDB SQL of the phonetic-first session: what is read, frozen, shaken and thawed at each keystroke, as a recursion over keystrokes."""

from __future__ import annotations

from mojiweave.plans.lattice_oracles import PHRASES, SINCE_EDIT, with_all
from mojiweave.plans.oracles import _units
from mojiweave.plans.phonetic_first import PhoneticParameters
from mojiweave.plans.phonetic_oracles import TEXTS, segments

P = PhoneticParameters()
_SEG = 'STRUCT(s BIGINT, e BIGINT, raw VARCHAR, "out" VARCHAR, lang VARCHAR, conf DOUBLE, why VARCHAR, st VARCHAR, pen DOUBLE)'
_MOVE = 'STRUCT(s BIGINT, e BIGINT, raw VARCHAR, "from" VARCHAR, "to" VARCHAR, reason VARCHAR)'
_RIPPLE = "STRUCT(s BIGINT, e BIGINT, kind VARCHAR, strength DOUBLE, a BIGINT, b BIGINT, reason VARCHAR)"
_THAW = "STRUCT(s BIGINT, e BIGINT, raws VARCHAR, reason VARCHAR)"
_APART = "greatest(0, {r}.s - {x}.e, {x}.s - {r}.e)"


def _end(committed: str) -> str:
    return f"CASE WHEN len({committed}) = 0 THEN 0 ELSE {committed}[len({committed})].e END"


def _tail(committed: str) -> str:
    """The place in the list from which the last soft segments stand; null if there is none or something hard follows."""
    softs = f"list_filter(range(1, len({committed}) + 1), lambda i: {committed}[i].st = 'S')"
    first = f"({softs})[greatest(1, len({softs}) - {P.segment_radius - 1})]"
    return f"CASE WHEN len({softs}) > 0 AND len(list_filter({committed}[{first}:], lambda c: c.st = 'H')) = 0 THEN {first} END"


def _moves(which: str, before: str, after: str, reason: str) -> str:
    return f"list_transform({which}, lambda c: {{'s': c.s, 'e': c.e, 'raw': c.raw, 'from': '{before}', 'to': '{after}', 'reason': {reason}}})"


def _hard(committed: str, test: str) -> str:
    return f"list_transform({committed}, lambda c: {{'s': c.s, 'e': c.e, 'raw': c.raw, 'out': c.out, 'lang': c.lang, 'conf': c.conf, 'why': c.why, 'st': CASE WHEN {test} THEN 'H' ELSE c.st END, 'pen': c.pen}})"


def _shaken(segs: str, odd: str) -> str:
    near = f"list_filter({odd}, lambda r: {_APART.format(r='r', x='x')} <= {P.radius})"
    pen = f"coalesce(list_max(list_transform({near}, lambda r: least(0.70::DOUBLE, r.strength * pow({P.decay}, {_APART.format(r='r', x='x')})))), 0)"
    made = f"list_transform({segs}, lambda x: {{'x': x, 'p': {pen}}})"
    return f"list_transform({made}, lambda y: {{'s': y.x.s, 'e': y.x.e, 'raw': y.x.raw, 'out': y.x.out, 'lang': y.x.lang, 'conf': CASE WHEN y.p > 0 AND y.x.why <> 'stage2-orthographic-latin-token' THEN y.x.conf * (1 - y.p) ELSE y.x.conf END, 'why': y.x.why, 'st': 'A', 'pen': CASE WHEN y.x.why <> 'stage2-orthographic-latin-token' THEN y.p ELSE 0 END}})"


def _waves(segs: str, odd: str, base: str) -> str:
    d = _APART.format(r="r", x="x")
    return f"flatten(list_transform({segs}, lambda x: list_transform(list_filter({odd}, lambda r: {d} <= {P.radius}), lambda r: {{'s': {base} + r.s, 'e': {base} + r.e, 'kind': r.kind, 'strength': r.strength, 'a': {base} + x.s, 'b': {base} + x.e, 'reason': r.reason || ';distance=' || {d}}})))"


def _firm(segs: str, odd: str, size: str) -> str:
    """Segments with the confidence they are judged by and whether they may be frozen."""
    sure = f"CASE WHEN x.why = 'stage2-phonetic-fallback' AND i < len({segs}) AND starts_with({segs}[i + 1].why, 'stage2-japanese-') THEN greatest(x.conf, 0.88::DOUBLE) ELSE x.conf END"
    near = f"len(list_filter({odd}, lambda r: r.strength >= {P.trigger} AND {_APART.format(r='r', x='x')} <= {P.radius})) > 0"
    return f"list_transform({segs}, lambda x, i: {{'x': x, 'conf': {sure}, 'ok': {size} - x.e >= {P.lookahead} AND {sure} >= {P.freeze} AND x.lang <> 'Unknown' AND NOT ({near})}})"


_UNITS = _units("words").replace("walk AS", "walk3 AS").replace("FROM walk ", "FROM walk3 ").replace("\nu AS (", "\nu3 AS (")
READS = [
    f"""segs AS (SELECT text, list(CAST({{'s': s, 'e': e, 'raw': raw, 'out': output, 'lang': language, 'conf': confidence, 'why': reason, 'st': 'A', 'pen': 0}} AS {_SEG}) ORDER BY s) AS segs FROM segments GROUP BY text)""",
    "hard_marks AS (SELECT text, bool_or(kind = 'HardBoundary') AS hard FROM evidence GROUP BY text)",
    _UNITS,
    f"""odds AS (
  SELECT text, beg - 1 AS s, beg - 1 + length(token) AS e, 'PendingPhonetic' AS kind, CASE WHEN beg - 1 + length(token) = length(text) THEN 0.35 ELSE 1.0 END::DOUBLE AS strength, 'not-readable-as-romaji-here' AS reason, 1 AS grp FROM u3
  WHERE kind = 'Pending' AND NOT EXISTS (SELECT 1 FROM segments g WHERE g.text = u3.text AND g.language = 'English' AND g.confidence >= 0.90 AND g.s <= beg - 1 AND beg - 1 + length(token) <= g.e)
  UNION ALL SELECT text, s, e, 'UnknownSegment', 1.0, reason, 2 FROM segments WHERE language = 'Unknown' AND NOT contains(reason, 'symbol')
  UNION ALL SELECT text, s, e, 'LowConfidenceSegment', greatest({P.trigger}, least(1, {P.trigger}::DOUBLE + ({P.low_confidence}::DOUBLE - confidence) / {P.low_confidence}::DOUBLE * (1 - {P.trigger}::DOUBLE))), reason || ';confidence=' || printf('%.3f', confidence), 3
    FROM segments WHERE language <> 'Unknown' AND NOT contains(reason, 'symbol') AND confidence < {P.low_confidence} AND length(text) - e >= {P.lookahead}
  UNION ALL SELECT text, s, e, kind, 0.95, reason, 4 FROM evidence WHERE kind = 'IncompleteBindingToken'
)""",
    "odd_lists AS (SELECT text, list({'s': s, 'e': e, 'kind': kind, 'strength': strength, 'reason': reason} ORDER BY grp, s) AS odd FROM odds GROUP BY text)",
    """readings AS (SELECT w.text, coalesce(segs, []) AS segs, coalesce(odd, []) AS odd, coalesce(hard, false) AS hard FROM words w LEFT JOIN segs USING (text) LEFT JOIN odd_lists USING (text) LEFT JOIN hard_marks USING (text)
  UNION ALL SELECT '', [], [], false)""",
    f"""session AS (
  SELECT text, 0::BIGINT AS step, CAST([] AS {_SEG}[]) AS committed, CAST([] AS {_SEG}[]) AS active, 0::BIGINT AS base, 0::BIGINT AS work, 0::BIGINT AS total, CAST([] AS {_MOVE}[]) AS moves, CAST([] AS {_RIPPLE}[]) AS ripples, CAST([] AS {_THAW}[]) AS thaws FROM typed
  UNION ALL
  SELECT text, n, CAST(CASE WHEN boundary THEN {_hard('c4', 'true')} ELSE c4 END AS {_SEG}[]), CAST(active AS {_SEG}[]), base3, work, total + work,
         CAST(moves || CASE WHEN boundary THEN {_moves("list_filter(c4, lambda c: c.st = 'S')", 'SoftFrozen', 'HardFrozen', "'hard-boundary-observed'")} ELSE [] END AS {_MOVE}[]), CAST(ripples AS {_RIPPLE}[]), CAST(thaws AS {_THAW}[])
  FROM (
    SELECT f.*, CASE WHEN len(frozen) > 0 THEN r.hard ELSE hard2 END AS boundary, CASE WHEN len(frozen) > 0 THEN {_shaken('r.segs', 'r.odd')} ELSE shaken END AS active,
           f.waves || CASE WHEN len(frozen) > 0 THEN {_waves('r.segs', 'r.odd', 'base3')} ELSE [] END AS ripples, f.spent + CASE WHEN len(frozen) > 0 THEN n - base3 ELSE 0 END AS work
    FROM (
      SELECT *, c3 || frozen AS c4, CASE WHEN len(frozen) > 0 THEN frozen[len(frozen)].e ELSE base2 END AS base3, moves3 || {_moves('frozen', 'Active', 'SoftFrozen', "'high-confidence-with-lookahead'")} AS moves
      FROM (
        SELECT *, list_transform(firm[1:CASE WHEN len(list_filter(firm, lambda y: NOT y.ok)) = 0 THEN len(firm) ELSE list_position(list_transform(firm, lambda y: y.ok), false) - 1 END],
                 lambda y: {{'s': base2 + y.x.s, 'e': base2 + y.x.e, 'raw': y.x.raw, 'out': y.x.out, 'lang': y.x.lang, 'conf': y.conf, 'why': y.x.why, 'st': 'S', 'pen': y.x.pen}}) AS frozen
        FROM (
          SELECT *, {_firm('shaken', 'odd2', '(n - base2)')} AS firm
          FROM (
            SELECT d.*, r.odd AS odd2, r.hard AS hard2, {_shaken('r.segs', 'r.odd')} AS shaken, d.waves1 || {_waves('r.segs', 'r.odd', 'base2')} AS waves, (n - base1) + CASE WHEN shook THEN n - base2 ELSE 0 END AS spent
            FROM (
              SELECT *, {_end('c3')} AS base2
              FROM (
                SELECT *, CASE WHEN shook THEN c2[:tail2 - 1] ELSE c2 END AS c3, CASE WHEN shook THEN moves2 || {_moves('c2[tail2:]', 'SoftFrozen', 'Active', "'context-ripple:' || why2")} ELSE moves2 END AS moves3,
                       CASE WHEN shook THEN thaws1 || [{{'s': c2[tail2].s, 'e': base1, 'raws': array_to_string(list_transform(c2[tail2:], lambda c: c.raw), '|'), 'reason': why2}}] ELSE thaws1 END AS thaws
                FROM (
                  SELECT c.*, tail2 IS NOT NULL AND len(list_filter(r.odd, lambda x: x.strength >= {P.trigger} AND x.s <= {P.radius})) > 0 AS shook,
                         array_to_string(list_filter(list_transform(r.odd, lambda x: x.kind), lambda k, i: list_position(list_transform(r.odd, lambda x: x.kind), k) = i), '+') AS why2
                  FROM (
                    SELECT *, {_end('c2')} AS base1, {_tail('c2')} AS tail2
                    FROM (
                      SELECT *, {_hard('c1', f"c.st = 'S' AND n - c.e >= {P.hard_lookahead}")} AS c2,
                             moves1 || {_moves(f"list_filter(c1, lambda c: c.st = 'S' AND n - c.e >= {P.hard_lookahead})", 'SoftFrozen', 'HardFrozen', "'sufficient-lookahead-without-local-contradiction'")} AS moves2
                      FROM (
                        SELECT text, n, total, CASE WHEN crossed THEN committed[:tail1 - 1] ELSE committed END AS c1,
                               CASE WHEN crossed THEN {_moves('committed[tail1:]', 'SoftFrozen', 'Active', "'context-ripple:CrossBoundaryReinterpretation'")} ELSE [] END AS moves1,
                               CASE WHEN crossed THEN [{{'s': done, 'e': done, 'kind': 'CrossBoundaryReinterpretation', 'strength': 1.0::DOUBLE, 'a': start1, 'b': stop1, 'reason': over.why || ':' || over.raw}}] ELSE [] END AS waves1,
                               CASE WHEN crossed THEN [{{'s': start1, 'e': done, 'raws': array_to_string(list_transform(committed[tail1:], lambda c: c.raw), '|'), 'reason': 'CrossBoundaryReinterpretation'}}] ELSE [] END AS thaws1
                        FROM (
                          SELECT b.*, over, tail1 IS NOT NULL AND over IS NOT NULL AND over.lang <> 'Unknown' AND over.conf >= {P.freeze} AS crossed
                          FROM (
                            SELECT a.*, (list_filter(r.segs, lambda x: x.s < done - start1 AND done - start1 < x.e))[1] AS over
                            FROM (
                              SELECT *, committed[tail1].s AS start1, least(n, done + {max(2 * P.radius, 8)}) AS stop1
                              FROM (SELECT text, step + 1 AS n, committed, total, {_end('committed')} AS done, {_tail('committed')} AS tail1 FROM session WHERE step < length(text))
                            ) a LEFT JOIN readings r ON r.text = substr(a.text, start1 + 1, stop1 - start1)
                          ) b
                        )
                      )
                    )
                  ) c JOIN readings r ON r.text = substr(c.text, base1 + 1, n - base1)
                )
              )
            ) d JOIN readings r ON r.text = substr(d.text, base2 + 1, n - base2)
          )
        )
      )
    ) f JOIN readings r ON r.text = substr(f.text, base3 + 1, n - base3)
  )
)""",
]


def session(typed: str, select: str) -> str:
    """SQL over `session`, a row per text of `typed` and keystroke; every stretch of a text is read once."""
    stretches = "SELECT DISTINCT substr(text, a + 1, b - a) AS text FROM (SELECT text, a, unnest(range(a + 1, length(text) + 1)) AS b FROM (SELECT text, unnest(range(0, length(text))) AS a FROM typed))"
    return with_all([f"typed AS ({typed})", *segments(stretches), *READS], select)


def _keystrokes(events: str) -> str:
    """What users' events come to, read as one session each. Nothing after a first space is ever frozen, and what
    is odd reaches six characters far: the first three events settle what is frozen, and each later one reads as it does after a space.
    """
    rows = f"(SELECT user_id, event_type || ' ' AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM {events})"
    typed = f"SELECT DISTINCT string_agg(t, '' ORDER BY k) AS text FROM {rows} WHERE k <= 3 GROUP BY user_id UNION SELECT DISTINCT ' ' || event_type || ' ' FROM events"
    later = f"(SELECT substr(text, 2) AS t, {_SAID.format('segs[2:]')} AS said FROM readings)"
    return session(
        typed,
        f"""SELECT CAST(user_id AS VARCHAR) AS session_id, CAST(coalesce(frames, 0) AS BIGINT) AS frames, coalesce(list_max(list_transform(list_filter(committed, lambda c: c.st = 'H'), lambda c: c.e)), 0) AS committed_raw_length,
       coalesce({_SAID.format('committed')} || {_SAID.format('active')}, '') || coalesce(more, '') AS output
FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN (SELECT user_id, string_agg(t, '' ORDER BY k) FILTER (WHERE k <= 3) AS text, sum(length(t)) AS frames, string_agg(said, '' ORDER BY k) FILTER (WHERE k > 3) AS more
  FROM {rows} JOIN {later} USING (t) GROUP BY user_id) e USING (user_id) LEFT JOIN session s ON s.text = e.text AND s.step = length(e.text)""",
    )


_SAID = "array_to_string(list_transform({}, lambda c: c.out), '')"
FREEZE_ORACLES: dict[str, str] = {
    "phonetic_keystrokes": _keystrokes("events"),
    "stream_phonetic_sessions": _keystrokes(SINCE_EDIT),
    "phonetic_session_results": session(
        TEXTS,
        f"SELECT text, {_SAID.format('committed')} || {_SAID.format('active')} AS output, base AS committed_raw_length, coalesce(list_max(list_transform(list_filter(committed, lambda c: c.st = 'H'), lambda c: c.e)), 0) AS hard_committed_raw_length, total AS total_analyzed FROM session WHERE step = length(text) AND step > 0",
    ),
    "phonetic_work": session(
        TEXTS,
        "SELECT text, total AS work, length(text) * (length(text) + 1) // 2 AS naive, round(total / (length(text) * (length(text) + 1) / 2), 6) AS share, total < 0.8::DOUBLE * (length(text) * (length(text) + 1) // 2) AS spared FROM session WHERE step = length(text) AND step > 0",
    ),
    "exported_phonetic": session(
        PHRASES,
        f"""SELECT text, 'phonetic-first-rcr-v2' AS format_version, text AS input, '{{"minimumLookaheadToFreeze":2,"maximumJapaneseFallbackLength":16,"englishAnomalyThreshold":0.8,"freezeConfidenceThreshold":0.86,"lowConfidenceRippleThreshold":0.86,"hardFreezeLookahead":12,"rippleSegmentRadius":2,"rippleCharacterRadius":6,"rippleDecay":0.45,"rippleTriggerThreshold":0.45}}' AS parameters,
       count(*) AS frames, md5(string_agg(concat_ws('|', step, substr(text, 1, step), base, said, substr(text, base + 1, step - base), said || shown, work, total, 'false', segs), chr(10) ORDER BY step)) AS digest
FROM (SELECT text, step, base, work, total, {_SAID.format('committed')} AS said, {_SAID.format('active')} AS shown, array_to_string(list_transform(active, lambda x: concat_ws(':', base + x.s, base + x.e, x.raw, x."out", x.lang, x.why)), ';') AS segs FROM session WHERE step > 0) GROUP BY text""",
    ),
    "freeze_transitions": session(PHRASES, 'SELECT text, step, m.s AS start, m.e AS "end", m.raw AS raw, m."from" AS "from", m."to" AS "to", m.reason AS reason FROM (SELECT text, step, unnest(moves) AS m FROM session)'),
    "ripple_events": session(PHRASES, "SELECT text, step, r.s AS source_start, r.e AS source_end, r.kind AS source_kind, round(r.strength, 9) AS strength, r.a AS affected_start, r.b AS affected_end, r.reason AS reason FROM (SELECT text, step, unnest(ripples) AS r FROM session)"),
    "thaw_events": session(PHRASES, 'SELECT text, step, t.s AS start, t.e AS "end", t.raws AS raw_segments, t.reason AS reason FROM (SELECT text, step, unnest(thaws) AS t FROM session)'),
    "phonetic_segments": session(
        PHRASES,
        'SELECT text, step, base + x.s AS start, base + x.e AS "end", x.raw AS raw, x."out" AS output, x.lang AS language, round(x.conf, 9) AS confidence, x.why AS decision_reason, \'Active\' AS freeze_state, round(x.pen, 9) AS context_penalty FROM (SELECT text, step, base, unnest(active) AS x FROM session WHERE step = length(text))',
    ),
}
