"""Lattice edges, best paths and session frames of text columns.

Edges come from joins (entries by substring, spans from bounded sequences). The beam and the session
run in Arrow batches, once per distinct text; what they return is nested as the result format has it
and can be taken apart by the DataFrame functions below.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mojiweave.functions.phonetic import beginnings, converts, leading, said
from mojiweave.functions.syntax import char_class, char_set
from mojiweave.operators.dictionary import counted, dealt, hits
from mojiweave.operators.profile import BOUND, advantage, place_leans, scores, span_lean
from mojiweave.plans import lattice as L
from mojiweave.sources.fixed import BINDING, LatticeParameters

EDGE = "struct<start:int,end:int,raw:string,output:string,language:string,kind:string,local_score:double,japanese_profile:double,english_profile:double,evidence:string>"
PATH = f"struct<score:double,relative_score:double,segmentation:string,output:string,edges:array<{EDGE}>>"
COMMIT = "struct<start:int,end:int,raw:string,output:string,reason:string>"
FRAME = (
    "step int, input string, committed_raw_length int, committed_output string, active_raw string, phonetic_preview string, "
    f"candidate_edges array<{EDGE}>, top_paths array<{PATH}>, consensus_end int, consensus_signature string, consensus_stable_frames int, "
    f"commit_events array<{COMMIT}>, output string, expanded_edges_this_step int, total_expanded_edges long, rebuilt boolean"
)
FRAME_NAMES = [x.split()[0] for x in FRAME.replace(", ", "\n").splitlines()]


def _edge(e: L.Edge) -> dict:
    return dict(zip(("start", "end", "raw", "output", "language", "kind", "local_score", "japanese_profile", "english_profile", "evidence"), e, strict=True))


def path_rows(paths: list[L.Path]) -> list[dict]:
    best = paths[0].score if paths else 0.0
    return [{"score": x.score, "relative_score": x.score - best, "segmentation": " | ".join(e.raw for e in x.edges), "output": "".join(e.output for e in x.edges), "edges": [_edge(e) for e in x.edges]} for x in paths]


def frame_row(f: L.Frame, nested: bool) -> dict:
    """A frame as a row; without nested, edges and paths are left empty."""
    row = dict(zip(FRAME_NAMES, f, strict=True))
    row["candidate_edges"] = [_edge(e) for e in f.edges] if nested else []
    row["top_paths"] = path_rows(f.paths) if nested else []
    row["commit_events"] = [dict(zip(("start", "end", "raw", "output", "reason"), c, strict=True)) for c in f.commits]
    return row


def arrow_schema(df_schema):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df_schema)


def in_order(texts: DataFrame) -> DataFrame:
    """The distinct texts, those that begin alike together: what reads them one after the other need not read a beginning twice.

    Texts are few bytes and much work, so they are dealt by the number of cores and not by their size.
    """
    each = texts.select("text").filter("text is not null").distinct()
    return each.repartitionByRange(4 * texts.sparkSession.sparkContext.defaultParallelism, "text").sortWithinPartitions("text")


def _map_texts(texts: DataFrame, ddl: str, work) -> DataFrame:
    """work(text) -> rows, for each distinct text; the text is the first column of each row."""
    from pyspark.sql.types import _parse_datatype_string

    schema = arrow_schema(_parse_datatype_string(f"text string, {ddl}"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                rows += ({"text": text} | r for r in work(text))
                if len(rows) >= 2000:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, schema)

    return in_order(texts).mapInArrow(run, f"text string, {ddl}")


@lru_cache(maxsize=4)
def _reader(p: LatticeParameters) -> L.Reader:
    """A worker's reader: what it knows of places outlives a task."""
    return L.Reader(p)


def decode(texts: DataFrame, parameters: LatticeParameters | None = None, top: int | None = None, fields: tuple[str, ...] | None = None) -> DataFrame:
    """(text, rank, score, relative_score, segmentation, output, edges, expanded) of the best paths of each distinct text.

    fields: which fields the edges have, all without it.
    """
    from pyspark.sql.types import _parse_datatype_string

    p = parameters or LatticeParameters()
    held = [(i, x) for i, x in enumerate(EDGE[len("struct<") : -1].split(",")) if fields is None or x.split(":")[0] in fields]
    ddl = f"text string, rank int, score double, relative_score double, segmentation string, output string, edges array<struct<{','.join(x for _, x in held)}>>, expanded int"
    schema, picked = arrow_schema(_parse_datatype_string(ddl)), [i for i, _ in held]

    def made(rows: list, edges: list, ends: list):
        import pyarrow as pa

        columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
        parts = list(zip(*edges, strict=True)) if edges else [[]] * len(L.Edge._fields)
        kind = schema.field("edges").type
        values = pa.StructArray.from_arrays([pa.array(parts[i], f.type) for i, f in zip(picked, kind.value_type, strict=True)], fields=list(kind.value_type))
        nested = pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), values).cast(kind)
        plain = [pa.array(c, schema.field(n).type) for c, n in zip(columns, ("text", "rank", "score", "relative_score", "segmentation", "output", "expanded"), strict=True)]
        return pa.RecordBatch.from_arrays([*plain[:-1], nested, plain[-1]], schema=schema)

    def run(batches: Iterator) -> Iterator:
        reader = _reader(p)
        for batch in batches:
            rows, edges, ends = [], [], []
            for text in batch.column("text").to_pylist():
                reader.read(text)
                paths, work = reader.paths(top), reader.expanded
                for rank, (score, path) in enumerate(paths, 1):
                    rows.append((text, rank, score, score - paths[0].score, " | ".join([e[2] for e in path]), "".join([e[3] for e in path]), work))
                    edges += path
                    ends.append(len(edges))
                if len(rows) >= 5000:
                    yield made(rows, edges, ends)
                    rows, edges, ends = [], [], []
            yield made(rows, edges, ends)

    return in_order(texts).mapInArrow(run, ddl)


def session_frames(texts: DataFrame, parameters: LatticeParameters | None = None, nested: bool = False) -> DataFrame:
    """A row per distinct text and keystroke, as if it was typed."""
    p = parameters or LatticeParameters()
    return _map_texts(texts, FRAME, lambda text: (frame_row(f, nested) for f in L.Session(p, nested=nested).update(text)))


def session_results(texts: DataFrame, parameters: LatticeParameters | None = None) -> DataFrame:
    """(text, output, committed_raw_length, committed_output, total_expanded_edges, n_commits) of each distinct text after its last keystroke."""
    p = parameters or LatticeParameters()

    def work(text: str) -> Iterator[dict]:
        session = L.Session(p, nested=False)
        frames = session.update(text)
        last = frames[-1] if frames else None
        yield {"output": last.output if last else "", "committed_raw_length": session.done, "committed_output": last.committed_output if last else "", "total_expanded_edges": session.total, "n_commits": sum(len(f.commits) for f in frames)}

    return _map_texts(texts, "output string, committed_raw_length int, committed_output string, total_expanded_edges long, n_commits int", work)


def _entries(lexicon: DataFrame, profile_words: DataFrame) -> DataFrame:
    """The entries with the kind and local_score of their edges."""
    priced = scores(lexicon.select(F.col("raw").alias("word")), profile_words).withColumnRenamed("word", "raw")
    ja = F.col("language") == "Japanese"
    n = F.length("raw").cast("double")
    short = F.when((n < 5) & converts(F.col("raw")), 2.35).otherwise(0.0)
    japanese = n - 0.45 + F.when(F.col("evidence") == "japanese-particle", 0.45).otherwise(0.95) + 0.10 * F.col("weight") + 0.35 * advantage(F.col("japanese"), F.col("english"))
    english = n - 0.45 + F.when(n >= 5, 1.80).otherwise(0.20) + 0.10 * F.col("weight") + 0.50 * advantage(F.col("english"), F.col("japanese")) - short
    kind = F.when(ja, "JapaneseLexical").otherwise("EnglishLexical")
    return lexicon.join(F.broadcast(priced), "raw").withColumns({"local_score": F.when(ja, japanese).otherwise(english), "kind": kind})


def _lexical(each: DataFrame, entries: DataFrame) -> DataFrame:
    return hits(each, entries).select("text", "start", "end", "raw", "output", "language", "kind", "local_score", "evidence")


def lexical_edges(texts: DataFrame, lexicon: DataFrame, profile_words: DataFrame) -> DataFrame:
    """(text, start, end, raw, output, language, kind, local_score, evidence) of dictionary entries."""
    return _lexical(texts.select("text").distinct(), _entries(lexicon, profile_words))


def phonetic_spans(texts: DataFrame, parameters: LatticeParameters | None = None, *more: str) -> DataFrame:
    """(text, start, n, output) of all spans of letters that convert to kana, of `phonetic_span` letters at most.

    texts: distinct; more: array columns with an element for each place, of which a span gets the part from its start on. What
    starts at a place is read once, whatever its length.
    """
    longest = (parameters or LatticeParameters()).phonetic_span
    at = lambda i: F.struct(i.alias("start"), F.regexp_extract(F.substr("text", i + 1, F.lit(longest)), "^[a-z]+", 0).alias("run"), *(F.slice(c, i + 1, F.lit(longest)).alias(c) for c in more))
    starts = texts.filter(F.length("text") > 0).select("text", F.inline(F.transform(F.sequence(F.lit(0), F.length("text") - 1), at))).filter(F.length("run") > 0)
    read = starts.select("text", "start", "run", *more, leading(F.col("run")).alias("_t")).filter((F.size("_t") > 0) | F.startswith("run", F.lit("n")))
    each = read.select(*read.columns, said(F.col("_t")).alias("_k")).select("*", F.explode(F.sequence(F.lit(0), F.size("_t"))).alias("_n"))
    spans = each.select("text", "start", *more, F.explode(beginnings(*map(F.col, ("run", "_t", "_k", "_n")))).alias("_s")).filter("_s is not null")
    return spans.select("text", "start", F.col("_s.n").alias("n"), F.col("_s.kana").alias("output"), *more)


def phonetic_edges(texts: DataFrame, profile_words: DataFrame, parameters: LatticeParameters | None = None) -> DataFrame:
    """The same of all spans that convert to kana; grams are priced once for each place of a text, and neither places nor spans are in a shuffle."""
    return _phonetic(dealt(texts), profile_words, parameters)


def _phonetic(each: DataFrame, profile_words: DataFrame, parameters: LatticeParameters | None) -> DataFrame:
    spans = phonetic_spans(place_leans(each, profile_words), parameters, "leans")
    lean, n = F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), span_lean(F.col("leans"), F.col("n")))), F.col("n")
    raw = F.substr("text", F.col("start") + 1, n)
    return spans.select("text", "start", (F.col("start") + n).alias("end"), raw.alias("raw"), "output", F.lit("Japanese").alias("language"), F.lit("JapanesePhonetic").alias("kind"), (n - 0.55 + 0.42 * lean).alias("local_score"), F.lit("phonetic-lattice").alias("evidence"))


def _letters(text: Column) -> Column:
    return F.regexp_replace(text, "[^a-z]", "")


def structural_edges(texts: DataFrame, lexicon: DataFrame, profile_words: DataFrame, parameters: LatticeParameters | None = None) -> DataFrame:
    """The same of Latin tokens around each binding symbol: word characters on both sides, or a closing # or +.

    A symbol makes at most latin_side squared spans. The letters around it are priced once for each place, and neither symbols nor spans are in a shuffle.
    """
    return _structural(dealt(texts), lexicon, profile_words, parameters)


def _structural(each: DataFrame, lexicon: DataFrame, profile_words: DataFrame, parameters: LatticeParameters | None) -> DataFrame:
    side = (parameters or LatticeParameters()).latin_side
    at, left, right, leans = F.col("at"), F.col("left"), F.col("right"), F.col("leans")
    chars = each.select("text", F.posexplode(F.split("text", "")).alias("at", "c")).filter(F.col("c").isin(*BINDING))
    around = {"left": F.regexp_extract(F.substr("text", F.lit(1), at), f"[a-z0-9]{{0,{side}}}$", 0), "right": F.regexp_extract(F.substr("text", at + 2, F.lit(side)), "^[a-z0-9]*", 0)}
    plus = F.when(F.col("c") == "+", F.length(F.regexp_extract(F.substr("text", at + 2, F.length("text")), r"^\+*", 0))).otherwise(0)
    marked = chars.withColumns({**around, "plus": plus}).filter((F.length("left") > 0) & ((F.length("right") > 0) | F.col("c").isin("#", "+")))
    # a span has letters of the left side's end and of the right side's beginning: a part of both sides' letters
    marked = marked.select("text", at.alias("symbol"), "left", "right", "plus", F.concat(_letters(left), _letters(right)).alias("both"))
    priced = place_leans(marked, profile_words, "both", ("text", "symbol", "left", "right", "plus"))
    # one row: what lifts a span that it follows
    strong = lexicon.filter("language = 'Japanese' and weight >= 5.1").agg(F.collect_set("raw").alias("strong"))
    lean = lambda first, n: F.when(n > 0, F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), -span_lean(F.slice(leans, first, F.greatest(n, F.lit(1))), n)))).otherwise(0.0)
    m = F.length(_letters(left))
    # both are columns of the table, or their letters are cut out anew for each span
    sides = priced.crossJoin(F.broadcast(strong)).withColumn("strong", F.filter("strong", lambda x: F.contains("text", x)))
    sides = sides.select("*", m.alias("m"), F.transform(F.sequence(F.lit(1), F.length(left)), lambda k: F.length(_letters(F.substr(left, F.length(left) - k + 1, k)))).alias("heads"))
    sides = sides.select("*", F.when(F.length(right) > 0, F.transform(F.sequence(F.lit(1), F.length(right)), lambda k: F.length(_letters(F.substr(right, F.lit(1), k))))).otherwise(F.array(F.lit(0))).alias("tails"))
    m, closing = F.col("m"), F.when(F.length(right) > 0, 2).otherwise(F.col("plus") + 1)
    starts = F.transform("heads", lambda h, i: F.struct((F.col("symbol") - 1 - i).alias("start"), h.alias("h"), lean(m - h + 1, h).alias("lean_head")))
    followed = lambda end: F.exists("strong", lambda x: F.substr("text", end + 1, F.length(x)) == x)
    ends = F.transform("tails", lambda t, i: F.struct((F.col("symbol") + closing + i).alias("end"), t.alias("t"), lean(m + 1, t).alias("lean_tail"), followed(F.col("symbol") + closing + i).alias("followed")))
    sides = sides.select("text", "symbol", "plus", "leans", "m", starts.alias("starts"), ends.alias("ends"))
    # the first symbol of a span tells whose it is, so no span comes twice
    spans = sides.select("text", "symbol", "plus", "leans", "m", "ends", F.inline("starts")).select("text", "symbol", "plus", "leans", "m", "start", "h", "lean_head", F.inline("ends"))
    spans = spans.filter(F.col("h") + F.col("t") > 0).withColumn("lean_span", lean(m - F.col("h") + 1, F.col("h") + F.col("t")))
    n, head, bonus = F.col("end") - F.col("start"), F.col("symbol") - F.col("start"), F.when(F.col("followed"), 1.80).otherwise(0.0)
    light = F.when(F.col("h") == head, F.when(head <= 2, 2.60).when(head == 3, 0.45).otherwise(0.0)).otherwise(0.0)
    score = n - 0.65 + 1.75 + 0.55 * (F.col("plus") + 1) + 0.25 * F.col("lean_span") + 0.95 * F.col("lean_head") + 0.65 * F.col("lean_tail") + bonus - light - 0.35 * F.greatest(F.lit(0), n - 12)
    raw = F.substr("text", F.col("start") + 1, n)
    return spans.select("text", "start", "end", raw.alias("raw"), raw.alias("output"), F.lit("English").alias("language"), F.lit("LatinStructural").alias("kind"), score.alias("local_score"), F.lit("orthographic-lattice").alias("evidence"))


def symbol_edges(texts: DataFrame) -> DataFrame:
    """The same of symbols, and of characters that are neither symbol nor word."""
    return _symbols(texts.select("text").distinct())


def _symbols(each: DataFrame) -> DataFrame:
    c = F.col("raw")
    kind = char_class(c)
    named = F.when(kind == "hard", "HardBoundary").when(kind == "binding", "BindingSymbol").when(kind == "neutral", "NeutralSymbol").otherwise("Unknown")
    score = F.when(kind == "hard", 1.0).when(kind == "binding", 0.10).when(kind == "neutral", 0.45).otherwise(-3.2)
    why = F.when(kind == "hard", "hard-boundary").when(kind == "binding", "standalone-binding-symbol").when(kind == "neutral", "neutral-symbol").otherwise("unknown-character")
    rows = each.select("text", F.posexplode(F.split("text", "")).alias("start", "raw")).filter((F.length(c) > 0) & (kind != "word"))
    return rows.select("text", "start", (F.col("start") + 1).alias("end"), "raw", c.alias("output"), F.lit("Unknown").alias("language"), named.alias("kind"), score.alias("local_score"), why.alias("evidence"))


def _lone_characters(each: DataFrame) -> DataFrame:
    """The edge of each word character of distinct texts by itself."""
    rows = each.select("text", F.posexplode(F.split("text", "")).alias("start", "raw")).filter(F.col("raw").rlike("^[a-z0-9]$"))
    return rows.select("text", "start", (F.col("start") + 1).alias("end"), "raw", F.col("raw").alias("output"), F.lit("Unknown").alias("language"), F.lit("Unknown").alias("kind"), F.lit(-3.2).alias("local_score"), F.lit("unknown-character").alias("evidence"))


def unknown_edges(texts: DataFrame, others: DataFrame) -> DataFrame:
    """The same of word characters at which none of the other edges starts."""
    return _lone_characters(texts.select("text").distinct()).join(others.select("text", "start").distinct(), ["text", "start"], "left_anti")


def candidate_edges(texts: DataFrame, lexicon: DataFrame, profile_words: DataFrame, parameters: LatticeParameters | None = None) -> DataFrame:
    """All edges of the distinct texts, of equal ones the best, with their order in the text: start, longest, best.

    A part has so many characters of texts, so what a task sorts does not grow with their number.
    """
    each, parts = counted(texts)
    each = each.repartition(parts, "text")
    # only entries can make equal edges
    alike = Window.partitionBy("raw", "output", "language").orderBy(F.desc("local_score"))
    entries = _entries(lexicon, profile_words).withColumn("_r", F.row_number().over(alike)).filter("_r = 1").drop("_r")
    certain = _lexical(each, entries).unionByName(_phonetic(each, profile_words, parameters)).unionByName(_structural(each, lexicon, profile_words, parameters)).unionByName(_symbols(each))
    rows = certain.withColumn("_alone", F.lit(False)).unionByName(_lone_characters(each).withColumn("_alone", F.lit(True)))
    # a text's edges come together once and are sorted once: both windows are over them in that order
    order = ["start", F.desc(F.col("end") - F.col("start")), F.desc("local_score"), "kind", "output"]
    rows = rows.repartition(parts, "text").sortWithinPartitions("text", *order)
    held = F.count_if(~F.col("_alone")).over(Window.partitionBy("text", "start"))
    best = rows.withColumn("_held", held).filter("not _alone or _held = 0").drop("_alone", "_held")
    return best.withColumn("place", F.row_number().over(Window.partitionBy("text").orderBy(*order)))


def explode_edges(decoded: DataFrame) -> DataFrame:
    """Paths taken apart: a row per edge with its place in the path."""
    return decoded.select("text", "rank", F.posexplode("edges").alias("place", "edge")).select("text", "rank", "place", "edge.*")


def parameter_row(p: LatticeParameters) -> dict:
    return asdict(p)
