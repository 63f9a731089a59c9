"""Phonetic-first sessions of text columns, and what their steps hold, as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mojiweave.functions import phonetic
from mojiweave.operators.dictionary import confidence, dealt, ends_strong, hits, starts_strong
from mojiweave.operators.intervals import first_apart
from mojiweave.operators.lattice import _map_texts, arrow_schema, in_order
from mojiweave.operators.orthography import is_cut, marks
from mojiweave.plans import phonetic_first as P
from mojiweave.sources.tables import lexicon as entries

SEGMENT = "struct<start:int,end:int,raw:string,output:string,language:string,confidence:double,decision_reason:string,freeze_state:string,context_penalty:double>"
MARK = "struct<start:int,end:int,raw:string,kind:string,confidence:double,complete:boolean,reason:string>"
RIPPLE = "struct<source_start:int,source_end:int,source_kind:string,strength:double,affected_start:int,affected_end:int,reason:string>"
THAW = "struct<start:int,end:int,raw_segments:array<string>,reason:string>"
MOVE = "struct<start:int,end:int,raw:string,from:string,to:string,reason:string>"
STEP = (
    "step int, input string, committed_raw_length int, hard_committed_raw_length int, committed_output string, active_raw string, preview string, "
    f"segments array<{SEGMENT}>, frozen array<{SEGMENT}>, output string, analyzed int, total_analyzed long, rebuilt boolean, "
    f"symbol_evidence array<{MARK}>, ripple_events array<{RIPPLE}>, thaw_events array<{THAW}>, freeze_transitions array<{MOVE}>"
)
NAMES = tuple(x.split()[0] for x in STEP.replace(", ", "\n").splitlines())


def _fields(kind: str) -> list[str]:
    return [x.split(":")[0] for x in kind[len("struct<") : -1].replace("array<string>", "x").split(",")]


def segment_names() -> list[str]:
    return _fields(SEGMENT)


def step_fields() -> str:
    """STEP as the inside of a struct type."""
    out = STEP
    for name in NAMES:
        out = out.replace(f"{name} ", f"{name}:", 1) if out.startswith(f"{name} ") else out.replace(f", {name} ", f", {name}:", 1)
    return out


def step_row(s: P.Step) -> dict:
    row = dict(zip(NAMES, s, strict=True))
    for name, kind in (("segments", SEGMENT), ("frozen", SEGMENT), ("symbol_evidence", MARK), ("thaw_events", THAW), ("freeze_transitions", MOVE)):
        row[name] = [dict(zip(_fields(kind), x, strict=True)) for x in row[name]]
    row["ripple_events"] = [dict(zip(_fields(RIPPLE), (*r[:4], *r.affected, r.reason), strict=True)) for r in s.ripples]
    return row


def phonetic_steps(texts: DataFrame, p: P.PhoneticParameters | None = None) -> DataFrame:
    """A row per distinct text and keystroke, as if it was typed."""
    p = p or P.PhoneticParameters()

    def work(text: str) -> Iterator[dict]:
        yield from map(step_row, P.PhoneticSession(p).update(text))

    return _map_texts(texts, STEP, work)


#: What checked_steps() reads.
CHECKED = ("step", "input", "committed_raw_length", "hard_committed_raw_length", "committed_output", "active_raw", "segments", "frozen", "output", "freeze_transitions")


def bare_steps(texts: DataFrame, p: P.PhoneticParameters | None = None) -> DataFrame:
    """The columns CHECKED of phonetic_steps, segments as they are before they are shaken."""
    from pyspark.sql.types import _parse_datatype_string

    p = p or P.PhoneticParameters()
    ddl = "text string, " + ", ".join(x for x in STEP.replace(", ", "\n").splitlines() if x.split()[0] in CHECKED)
    schema, places = arrow_schema(_parse_datatype_string(ddl)), [NAMES.index(x) for x in CHECKED]

    def column(values: tuple, kind):
        import pyarrow as pa

        if not pa.types.is_list(kind):
            return pa.array(values, kind)
        flat = [x for v in values for x in v]
        parts, own = list(zip(*flat, strict=True)) or [[]] * kind.value_type.num_fields, list(kind.value_type)
        ends = pa.array(accumulate(map(len, values), initial=0), pa.int32())
        return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(parts, own, strict=True)], fields=own)).cast(kind)

    def made(rows: list):
        import pyarrow as pa

        columns = list(zip(*rows, strict=True)) or [()] * len(schema)
        return pa.RecordBatch.from_arrays([column(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches: Iterator) -> Iterator:
        typing = P.Typing(p, bare=True)
        for batch in batches:
            rows: list = []
            for text in batch.column("text").to_pylist():
                typing.type(text)
                rows += ((text, *(s[i] for i in places)) for s in typing.steps())
                if len(rows) >= 2000:
                    yield made(rows)
                    rows = []
            yield made(rows)

    return in_order(texts).mapInArrow(run, ddl)


def results(texts: DataFrame, p: P.PhoneticParameters | None = None) -> DataFrame:
    """(text, output, committed_raw_length, hard_committed_raw_length, total_analyzed) of each distinct text after its last keystroke, as last_steps() has them: the steps before are not made."""
    from pyspark.sql.types import _parse_datatype_string

    p = p or P.PhoneticParameters()
    ddl = "text string, output string, committed_raw_length int, hard_committed_raw_length int, total_analyzed long"
    schema = arrow_schema(_parse_datatype_string(ddl))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        typing = P.Typing(p)
        for batch in batches:
            rows = []
            for text in filter(None, batch.column("text").to_pylist()):
                s = typing.type(text)
                rows.append((text, typing.output(), s.done, s.hard, s.total))
            columns = list(zip(*rows, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return in_order(texts).mapInArrow(run, ddl)


def anchor_candidates(texts: DataFrame, p: P.PhoneticParameters | None = None, lexicon: DataFrame | None = None) -> DataFrame:
    """(text, found array<struct<start, end, raw, score, readability, kind>>) of all that may anchor a reading of each distinct text: tokens, words that romaji reads badly, and words between strong Japanese.

    A text's entries and symbols come together once, as two small lists; all else looks at these.
    """
    p = p or P.PhoneticParameters()
    lexicon = lexicon if lexicon is not None else entries(texts.sparkSession)
    size, japanese = F.length("raw"), F.col("language") == "Japanese"
    reads = phonetic.readability(phonetic.units(F.col("raw")), F.lit(0), size)
    known = lexicon.select("raw", "weight", (~japanese).alias("latin"), F.when(~japanese, reads).alias("readability"), ends_strong().alias("ends"), starts_strong().alias("starts"))
    texts = dealt(texts)
    hit = hits(texts, known.filter("latin or ends or starts")).select("text", F.struct("start", "end", *known.columns).alias("hit"), F.lit(None).alias("mark"))
    mark = marks(texts).filter("token").select("text", F.lit(None).alias("hit"), F.struct("at", "start", "after", "reach").alias("mark"))
    held = hit.unionByName(mark).groupBy("text").agg(F.collect_list("hit").alias("hits"), F.collect_list("mark").alias("marks"))
    held = held.withColumns({"before": F.transform(F.filter("hits", lambda h: h["ends"]), lambda h: h["end"]), "after": F.transform(F.filter("hits", lambda h: h["starts"]), lambda h: h["start"])})
    text = F.col("text")

    def token(m: Column) -> Column:
        own = lambda a: F.substr(text, m["at"] + 2, a - m["at"] - 1)
        tail = lambda a: F.substr(text, a + 1, m["reach"] - a)
        cuts = F.filter("after", lambda a: m["after"] & (m["at"] + 1 < a) & (a < m["reach"]) & is_cut(own(a), tail(a)))
        return F.struct(m["at"].alias("at"), m["start"].alias("start"), F.coalesce(F.array_min(cuts), m["reach"]).alias("end"))

    held = held.withColumn("tokens", F.transform("marks", token))

    def inside(t: Column) -> Column:
        first = lambda o: (o["start"] < t["start"]) | ((o["start"] == t["start"]) & ((o["end"] > t["end"]) | ((o["end"] == t["end"]) & (o["at"] < t["at"]))))
        return F.exists("tokens", lambda o: first(o) & (o["end"] >= t["end"]))

    def anchor(start: Column, end: Column, raw: Column, score: Column, readability: Column, kind: Column) -> Column:
        return F.struct(start.alias("start"), end.alias("end"), raw.alias("raw"), score.alias("score"), readability.alias("readability"), kind.alias("kind"))

    def of_token(t: Column) -> Column:
        n = t["end"] - t["start"]
        return anchor(t["start"], t["end"], F.substr(text, t["start"] + 1, n), 9.0 + 0.05 * n, F.lit(0.0), F.lit("orthographic"))

    def rescued(h: Column) -> Column:
        left, right = F.array_contains("before", h["start"]), F.array_contains("after", h["end"])
        return (F.length(h["raw"]) >= 5) & ((left & (right | (h["end"] == F.length(text)))) | ((h["start"] == 0) & right))

    def of_word(h: Column) -> Column:
        odd = h["readability"] <= p.english_anomaly
        score = 2.0 * confidence(h["weight"]) + 2.5 * (1.0 - h["readability"]) + 0.03 * F.length(h["raw"]) + 2.0 * rescued(h).cast("int")
        return anchor(h["start"], h["end"], h["raw"], score, h["readability"], F.when(odd, "anomaly").otherwise("contextual"))

    tokens = F.transform(F.filter("tokens", lambda t: ~inside(t)), of_token)
    words = F.transform(F.filter("hits", lambda h: h["latin"] & ((h["readability"] <= p.english_anomaly) | rescued(h))), of_word)
    return held.select("text", F.concat(tokens, words).alias("found"))


def anchors(texts: DataFrame, p: P.PhoneticParameters | None = None, lexicon: DataFrame | None = None) -> DataFrame:
    """(text, start, end, raw, score, readability, kind) of the Latin words and tokens of each distinct text: tokens first, then by score and length, none that overlaps one before."""
    names = ("start", "end", "raw", "score", "readability", "kind")
    ranked = F.transform("found", lambda f: F.struct((f["kind"] != "orthographic").alias("a"), (-f["score"]).alias("b"), (f["start"] - f["end"]).alias("c"), *(f[n].alias(n) for n in names)))
    each = anchor_candidates(texts, p, lexicon).select("text", F.array_sort(ranked).alias("x"))
    return each.select("text", F.inline(first_apart(F.col("x"), each.schema["x"].dataType.simpleString()))).drop("a", "b", "c")


def resolved(texts: DataFrame, p: P.PhoneticParameters | None = None) -> DataFrame:
    """(text, start, end, raw, output, language, confidence, reason): each distinct text read as a whole."""
    p = p or P.PhoneticParameters()
    names = ("start", "end", "raw", "output", "language", "confidence", "reason")
    return _map_texts(texts, "start int, end int, raw string, output string, language string, confidence double, reason string", lambda text: (dict(zip(names, s, strict=False)) for s in P.resolve(text, p)[0]))


def uncovered(texts: DataFrame, p: P.PhoneticParameters | None = None) -> DataFrame:
    """(text, start, end, preview, kind) of the phonetic units of each distinct text that no Latin segment of 0.90 or more covers."""
    texts = texts.select("text").filter("text is not null").distinct()
    units = texts.select("text", F.inline(phonetic.units(F.col("text"))))
    latin = resolved(texts, p).filter("language = 'English' and confidence >= 0.90").select("text", F.col("start").alias("_a"), F.col("end").alias("_b"))
    return units.join(latin, (units["text"] == latin["text"]) & (F.col("_a") <= F.col("start")) & (F.col("end") <= F.col("_b")), "left_anti").select("text", "start", "end", "preview", "kind")


def last_steps(steps: DataFrame) -> DataFrame:
    """Of each text the step after its last keystroke."""
    return steps.filter(F.col("step") == F.length("text"))


def events(steps: DataFrame, which: str) -> DataFrame:
    """The rows of symbol_evidence, ripple_events, thaw_events or freeze_transitions, or of segments or frozen."""
    return steps.select("text", F.col("step"), F.inline(which))


def checked_steps(steps: DataFrame) -> DataFrame:
    """Steps with bad: the active segments leave a gap, are not the input's characters, are not active, or do not make up the output; what was frozen
    is not soft, not sure enough or not committed; hard turned into active; or the lengths are out of order.
    """
    own = F.concat(F.col("committed_output"), F.array_join(F.transform("segments", lambda s: s["output"]), "")) != F.col("output")
    raw = F.array_join(F.transform("segments", lambda s: s["raw"]), "") != F.col("active_raw")
    gap = F.exists(F.transform("segments", lambda s, i: s["start"] != F.when(i == 0, F.col("committed_raw_length")).otherwise(F.try_element_at(F.col("segments"), i)["end"])), lambda b: b)
    back = F.exists("freeze_transitions", lambda t: (t["from"] == "HardFrozen") & (t["to"] == "Active"))
    hard = F.col("hard_committed_raw_length") > F.col("committed_raw_length")
    short = F.col("committed_raw_length") + F.length("active_raw") != F.length("input")
    firm = F.exists("frozen", lambda s: (s["freeze_state"] != "SoftFrozen") | (s["confidence"] < P.PhoneticParameters().freeze) | (s["end"] > F.col("committed_raw_length")))
    loose = F.exists("segments", lambda s: s["freeze_state"] != "Active")
    return steps.withColumn("bad", own | raw | F.coalesce(gap, F.lit(False)) | back | hard | short | firm | loose)


def broken_steps(steps: DataFrame) -> DataFrame:
    return checked_steps(steps).filter("bad").select("text", "step")
