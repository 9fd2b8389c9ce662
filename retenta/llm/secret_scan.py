"""Secret scan: fixed patterns, and formats learned from the credentials these find.

One pass over the texts gives the base spans and the other credential-like tokens. From a
bounded sample of the base spans' credentials (labelled by their kind) probabilistic
automata are inferred (``automata``); a fifth of the sample is held back. Every other token
is then scored: it is added as a span of kind ``format`` where an automaton gives it at
least the likelihood a letter that all but the LEAST share of the held-back credentials
reach, and more than the automata of ordinary numbers and words do. Those are inferred
from short runs of digits or letters that are no candidates: the other tokens themselves,
which hold the secrets to be found, set no limit.

Cases: a null text counts as empty; positions are code points, ends exclusive; with no
credentials in the corpus no format is learned and none added; repeated rows are scanned
row by row; other columns are dropped unless named in ``keep``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retenta.llm.automata import Automaton
from retenta.llm.staging import staged, text_of

# The base patterns and the least lengths of their matches.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ["assign", "access", "hex", "format"]
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: other tokens: as many credential letters, not all of one class
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{16,}")

#: numbers and words too short to be other tokens
PLAIN = "(?<![A-Za-z0-9+/_=.-])(?:[0-9]{1,15}|[A-Za-z]{1,15})(?![A-Za-z0-9+/_=.-])"

#: distinct strings of a kind from which an automaton is inferred
SAMPLE = 400
#: every so many-th labelled credential is held back from an automaton
HELD = 5
#: share of the held-back credentials that may lie below the limit
LEAST = 0.05

SPAN = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("value", T.StringType())])
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("value", pa.string())]))


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, credential) by start, then kind."""
    found = []
    if any(x in (low := text.lower()) for x in KEYWORDS):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def other_tokens(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Credential-like tokens with a digit that no base span touches."""
    out = []
    for m in TOKEN.finditer(text):
        value = m[0].rstrip(".=-_+/")
        a, b = m.start(), m.start() + len(value)
        if len(value) >= 16 and any(x.isdigit() for x in value) and not any(s < b and a < e for s, _, e, _ in base):
            out.append((a, 3, b, value))
    return out


def find(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and ``found``: base spans and, as kind 3, the other tokens."""
    chosen = docs.select(*[F.col(c) for c in keep], text_of(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column("__text").to_pylist():
                base = base_spans(x)
                rows.append([{"kind": k, "start": a, "stop": b, "value": v} for a, k, b, v in base + other_tokens(x, base)])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(rows, ARROW_SPANS)], [*keep, "__found"])

    kept = [f for f in chosen.schema.fields if f.name != "__text"]
    return chosen.mapInArrow(run, T.StructType([*kept, T.StructField("__found", T.ArrayType(SPAN))]))


def fit(examples: list[str]) -> tuple[Automaton, float] | None:
    """An automaton and its least log2 likelihood a letter, from the held-back examples that
    it accepts (from its own where it accepts none); None without examples."""
    if not examples:
        return None
    own = [x for k, x in enumerate(examples) if (k + 1) % HELD]
    automaton = Automaton(own)
    scores = sorted(s for x in examples[HELD - 1 :: HELD] if (s := automaton.score(x)) is not None)
    scores = scores or sorted(automaton.score(x) for x in own)
    return automaton, scores[int(LEAST * len(scores))]


def learn(found: DataFrame, docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> tuple[list[tuple[Automaton, float]], list[Automaton]]:
    """``fit`` for each base kind, and automata of ordinary numbers and words, each from at
    most ``sample`` distinct strings: those of the smallest hash."""
    labelled = found.select(F.explode("__found").alias("x")).select("x.kind", "x.value").filter("kind < 3").distinct()
    plain = docs.select(F.explode(F.regexp_extract_all(text_of(text), F.lit(PLAIN), F.lit(0))).alias("value")).distinct()
    plain = plain.join(labelled.select("value").distinct(), "value", "left_anti")
    strings = labelled.unionByName(plain.select(F.when(F.col("value").rlike("^[0-9]"), 3).otherwise(4).alias("kind"), "value"))
    rank = F.row_number().over(W.partitionBy("kind").orderBy(F.xxhash64("value"), "value"))
    rows = strings.withColumn("rank", rank).filter(F.col("rank") <= sample).orderBy("kind", "rank").collect()
    examples = [[r["value"] for r in rows if r["kind"] == k] for k in range(5)]
    return [f for x in examples[:3] if (f := fit(x))], [Automaton(x) for x in examples[3:] if x]


def is_credential(value: str, formats: list[tuple[Automaton, float]], ordinary: list[Automaton]) -> bool:
    scores = [s for a, least in formats if (s := a.score(value)) is not None and s >= least]
    return bool(scores) and all((s := a.score(value)) is None or max(scores) > s for a in ordinary)


def scan(docs: DataFrame, keep: list[str], text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """``keep`` columns and ``spans``, an array of (kind, start, stop, value) by start, then
    kind in the order of ``KINDS``. A kept column named ``spans`` gives way."""
    keep = [c for c in keep if c.lower() != "spans"]
    found = staged(find(docs, keep, text), "secret-spans")
    automata = found.sparkSession.sparkContext.broadcast(learn(found, docs, text, sample))  # at most 5 * sample strings' states

    @F.pandas_udf(T.ArrayType(T.BooleanType()))
    def accepted(values):
        return values.map(lambda xs: [is_credential(x, *automata.value) for x in xs])

    tokens = F.filter("__found", lambda x: x["kind"] == 3)
    with_tokens = found.withColumn("__ok", accepted(F.transform(tokens, lambda x: x["value"])))
    added = F.transform(F.filter(F.arrays_zip(tokens.alias("t"), F.col("__ok").alias("ok")), lambda x: x["ok"]), lambda x: x["t"])
    base = F.filter("__found", lambda x: x["kind"] < 3)
    ordered = F.array_sort(F.transform(F.concat(base, added), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("no"), x["stop"].alias("stop"), x["value"].alias("value"))))
    names = F.array(*[F.lit(x) for x in KINDS])
    spans = F.transform(ordered, lambda x: F.struct(names[x["no"]].alias("kind"), x["start"], x["stop"], x["value"]))
    return with_tokens.select(*[F.col(c) for c in keep], spans.alias("spans"))
