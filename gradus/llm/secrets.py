"""Secrets in texts: three fixed patterns, and random strings by two character Markov models.

Everything is DataFrame functions. One model is of random strings, the values that the patterns
find; the other is of ordinary identifiers, the long runs that they leave, paths, versions and
names with numbers among them. Each distinct string of either label counts once. What no pattern
covers of a run is a secret if its log-likelihood ratio under the two models is high enough, or
else each stretch of it whose ratio is. What looks like a secret among the ordinary samples is
left out when the models are fitted for the second time.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm.common import table, texts
from gradus.session import write_out

# The patterns of the base kinds, in order, and their least lengths.
ASSIGN = (
    "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "markov")

#: Characters of the runs that are compared, and their least lengths.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE, ORDINARY = 16, 12
#: Log-likelihood ratio from which a run is a secret: about the odds of ordinary runs to secrets.
LEAST_RATIO = 10.0
#: How many observations a state's overall frequency counts for behind each state.
SMOOTH = 10.0

_CLASS = "[A-Za-z0-9+/_=-]"
_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"
_STATES = len(ALPHABET) + 1  # and the state before the first character


def run_pattern(least: int) -> str:
    return f"(?<!{_CLASS}){_CLASS}{{{least},}}"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, also where ``use`` is a loop."""
    return F.element_at(F.transform(F.array(value), use), 1)


def matches(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """Spans of a pattern's leftmost non-overlapping matches, in code points, with their values.

    What stands between matches comes from ``split``, the matches from ``regexp_extract_all``;
    their lengths add up to the places.
    """
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.zip_with(
        gaps, found, lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit"))
    )
    if group:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        parts = F.zip_with(
            parts, values, lambda p, v: F.struct(p["gap"].alias("gap"), p["hit"].alias("hit"), v.alias("value"))
        )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("spans"))

    def step(state: Column, part: Column) -> Column:
        begin = state["at"] + part["gap"]
        end = begin + F.length(part["hit"])
        span = F.struct(
            begin.alias("start"),
            F.lit(kind).alias("kind"),
            end.alias("end"),
            part["value" if group else "hit"].alias("value"),
        )
        return F.struct(
            end.alias("at"), F.concat(state["spans"], F.array(span)).cast(_SPAN).alias("spans")
        )

    real = F.filter(parts, lambda part: part["hit"].isNotNull())
    return F.aggregate(real, start, step, lambda state: state["spans"])


def _none() -> Column:
    return F.array().cast(_SPAN)


def base_spans(text: Column) -> Column:
    """Spans of the three kinds, by start, then kind. Cheap tests spare most texts the search."""
    assign = F.when(
        (F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))) & text.rlike(ASSIGN),
        F.filter(matches(text, ASSIGN, 0, 2), lambda s: F.length(s["value"]) >= LEAST["assign"]),
    )
    access = F.when(
        F.contains(text, F.lit("AKIA")),
        F.filter(matches(text, ACCESS, 1), lambda s: F.length(s["value"]) >= LEAST["access"]),
    )
    # A run shorter than the least length fails whole, so the search may ask for the length.
    long_hex = f"{HEX[:-1]}{{{LEAST['hex']},}}"
    hexes = F.when(text.rlike(f"{HEX[:-1]}{{{LEAST['hex']}}}"), matches(text, long_hex, 2))
    return F.array_sort(F.concat(*[F.coalesce(x, _none()) for x in (assign, access, hexes)]))


def _without_base(text: Column) -> Column:
    """The text with a blank in place of what the patterns find."""
    plain = F.when(
        F.contains(text, F.lit("=")) | F.contains(text, F.lit(":")), F.regexp_replace(text, ASSIGN, " ")
    ).otherwise(text)
    return F.regexp_replace(F.regexp_replace(plain, ACCESS, " "), f"{HEX[:-1]}{{{LEAST['hex']},}}", " ")


def _state(character: Column) -> Column:
    """Number of a character, 0 where the alphabet lacks it."""
    return F.instr(F.lit(ALPHABET), character)


def _characters(string: Column) -> Column:
    """All characters at once; one substring for each walks the string every time."""
    return F.filter(F.split(string, ""), lambda c: c != "")


def samples(docs: DataFrame) -> DataFrame:
    """Distinct labelled strings of all texts: ``value, random``.

    All long runs that the patterns leave are ordinary samples; some may be secrets.
    """
    rows = texts(docs).select("text")
    random = F.transform(
        base_spans(F.col("text")), lambda s: F.struct(s["value"].alias("value"), F.lit(True).alias("random"))
    )
    runs = F.regexp_extract_all(_without_base(F.col("text")), F.lit(run_pattern(ORDINARY)), F.lit(0))
    ordinary = F.transform(runs, lambda run: F.struct(run.alias("value"), F.lit(False).alias("random")))
    return rows.select(F.explode(F.concat(random, ordinary)).alias("s")).select("s.*").distinct()


def transitions(strings: DataFrame) -> DataFrame:
    """``a, b, random, n``: how often a character follows another (or nothing) under either label."""
    states = F.transform(_characters(F.col("value")), _state)
    steps = let(
        states,
        lambda found: F.zip_with(
            F.concat(F.array(F.lit(0)), found),
            F.concat(found, F.array(F.lit(-1))),
            lambda a, b: F.struct(a.alias("a"), b.alias("b")),
        ),
    )
    return (
        strings.where(F.length("value") > 0)
        .select("random", F.explode(steps).alias("t"))
        .where("t.b >= 0")  # nothing follows the last one
        .groupBy("t.a", "t.b", "random")
        .agg(F.count("*").alias("n"))
    )


def _probabilities(counts: dict[tuple[int, int], int]) -> list[float]:
    """Probability of each state behind each; rare ones lean on how frequent a state is at all."""
    after = [0] * _STATES
    whole = [0.0] * _STATES
    for (a, b), n in counts.items():
        after[a] += n
        whole[b] += n
    total = sum(whole)
    single = [(n + 1.0) / (total + _STATES) for n in whole]
    return [
        (counts.get((a, b), 0) + SMOOTH * single[b]) / (after[a] + SMOOTH)
        for a in range(_STATES)
        for b in range(_STATES)
    ]


def _fit(strings: DataFrame, spared: int = 0) -> list[float] | None:
    """Log-likelihood ratio of each transition; None without samples of both labels.

    ``spared`` ordinary observations of each transition count nothing: with one, a sample isn't
    held against itself.
    """
    counts: dict[bool, dict[tuple[int, int], int]] = {}
    for row in transitions(strings).collect():
        n = row["n"] if row["random"] else max(0, row["n"] - spared)
        counts.setdefault(row["random"], {})[row["a"], row["b"]] = n
    if len(counts) < 2:
        return None
    both = zip(_probabilities(counts[True]), _probabilities(counts[False]), strict=True)
    return [math.log(p / q) for p, q in both]


def log_ratios(docs: DataFrame, least_ratio: float = LEAST_RATIO) -> list[float]:
    """Log-likelihood ratio of each transition, random to ordinary, by number of both states.

    The first fit is without runs of letters and digits, as those may be secrets themselves; ordinary
    samples that are secrets under it are left out of the second. A run with digits comes in where
    its other characters are ordinary, as a whole and in every stretch. The driver gets the counts
    of transitions: twice the square of the alphabet at most. Without samples of both labels every
    ratio is 0 and nothing is added.
    """
    value = F.col("value")
    mixed = ~F.col("random") & value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    strings = write_out(samples(docs).withColumn("mixed", mixed), "secret-samples")
    first = _fit(strings.where("not mixed"), spared=1)
    if first is None:
        return [0.0] * (_STATES * _STATES)
    ratios = F.array(*[F.lit(x) for x in first])
    letters = F.regexp_replace(value, "[0-9]+", "")
    named = (likelihood_ratio(letters, ratios) < 0) & (F.size(stretches(letters, ratios, least_ratio)) == 0)
    plain = F.when(F.col("random"), True).when(F.col("mixed"), named).otherwise(
        likelihood_ratio(value, ratios) < least_ratio
    )
    return _fit(strings.where(plain)) or _fit(strings.where("not mixed"))


def likelihood_ratio(string: Column, ratios: Column) -> Column:
    start = F.struct(F.lit(0).alias("state"), F.lit(0.0).alias("total"))

    def step(at: Column, character: Column) -> Column:
        return let(
            _state(character),
            lambda now: F.struct(
                now.alias("state"),
                (at["total"] + F.element_at(ratios, at["state"] * _STATES + now + 1)).alias("total"),
            ),
        )

    return F.aggregate(_characters(string), start, step, lambda at: at["total"])


def uncovered(run: Column, base: Column) -> Column:
    """The parts of a run (a span) that no base span covers, of the least length."""
    start = F.struct(run["start"].alias("at"), F.array().cast(_SPAN).alias("parts"))

    def part(begin: Column, end: Column) -> Column:
        value = F.substring(run["value"], begin - run["start"] + 1, end - begin)
        span = F.struct(
            begin.alias("start"), run["kind"].alias("kind"), end.alias("end"), value.alias("value")
        )
        return F.when(end - begin >= CANDIDATE, F.array(span)).otherwise(F.array()).cast(_SPAN)

    def step(state: Column, b: Column) -> Column:
        return F.struct(
            F.greatest(state["at"], b["end"]).alias("at"),
            F.concat(state["parts"], part(state["at"], b["start"])).alias("parts"),
        )

    touching = F.filter(base, lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"]))
    return F.aggregate(
        touching, start, step, lambda state: F.concat(state["parts"], part(state["at"], run["end"]))
    )


def stretches(string: Column, ratios: Column, least_ratio: float) -> Column:
    """``begin, until`` of the stretches whose ratio is high enough, or of all of the string if its
    whole ratio is.

    A running sum that restarts where it is 0, or has fallen from its peak by the least ratio.
    """
    none = F.array().cast("array<struct<begin:int,until:int>>")
    start = F.struct(
        F.lit(0).alias("state"),
        F.lit(0).alias("i"),
        F.lit(0.0).alias("whole"),
        F.lit(0.0).alias("total"),
        F.lit(0.0).alias("peak"),
        F.lit(0).alias("begin"),
        F.lit(0).alias("until"),
        none.alias("found"),
    )

    def closed(at: Column) -> Column:
        one = F.array(F.struct(at["begin"].alias("begin"), at["until"].alias("until")))
        return F.when(at["peak"] >= least_ratio, F.concat(at["found"], one)).otherwise(at["found"])

    def step(at: Column, character: Column) -> Column:
        def after(now: Column) -> Column:
            i, total = at["i"] + 1, at["total"] + now["ratio"]
            ends = (total <= 0) | (total <= at["peak"] - least_ratio)
            rises = total > at["peak"]
            return F.struct(
                now["state"].alias("state"),
                i.alias("i"),
                (at["whole"] + now["ratio"]).alias("whole"),
                F.when(ends, 0.0).otherwise(total).alias("total"),
                F.when(ends, 0.0).when(rises, total).otherwise(at["peak"]).alias("peak"),
                F.when(ends, i).otherwise(at["begin"]).alias("begin"),
                F.when(ends | rises, i).otherwise(at["until"]).alias("until"),
                F.when(ends, closed(at)).otherwise(at["found"]).alias("found"),
            )

        def scored(state: Column) -> Column:
            ratio = F.element_at(ratios, at["state"] * _STATES + state + 1)
            return F.struct(state.alias("state"), ratio.alias("ratio"))

        return let(let(_state(character), scored), after)

    all_of_it = F.array(F.struct(F.lit(0).alias("begin"), F.length(string).alias("until")))
    return F.aggregate(
        _characters(string),
        start,
        step,
        lambda at: F.when(at["whole"] >= least_ratio, all_of_it).otherwise(closed(at)),
    )


def secret_parts(run: Column, ratios: Column, least_ratio: float) -> Column:
    """Spans of a run's stretches, each grown to the next character that is no letter or digit; what a
    stretch has grown to must be likelier random than ordinary, too."""

    def grown(s: Column) -> Column:
        head = F.substring(run["value"], F.lit(1), s["begin"])
        tail = F.substring(run["value"], s["until"] + 1, F.length(run["value"]))
        begin = s["begin"] - F.length(F.regexp_extract(head, "[A-Za-z0-9]*$", 0))
        until = s["until"] + F.length(F.regexp_extract(tail, "^[A-Za-z0-9]*", 0))
        return F.struct(
            (run["start"] + begin).alias("start"),
            run["kind"].alias("kind"),
            (run["start"] + until).alias("end"),
            F.substring(run["value"], begin + 1, until - begin).alias("value"),
        )

    spans = F.transform(stretches(run["value"], ratios, least_ratio), grown)
    long = F.filter(spans, lambda s: s["end"] - s["start"] >= CANDIDATE)
    return F.array_distinct(F.filter(long, lambda s: likelihood_ratio(s["value"], ratios) >= 0))


def find_secrets(docs: DataFrame, least_ratio: float = LEAST_RATIO, **columns: str) -> DataFrame:
    """``doc_id, base, added`` for every row: arrays of ``start, kind, end, value``.

    ``kind`` is the number in ``KINDS``; places are code points, ends exclusive; arrays are in
    order of start. ``added`` has the parts of runs that are secrets and that no base span covers. One pass for the models, one
    for the spans, no text is shuffled. A NULL or empty text has none; a NULL id stays; repeated
    rows give repeated results; an empty table an empty one; other columns are ignored.
    """
    ratios = F.array(*[F.lit(x) for x in log_ratios(docs, least_ratio)])
    pattern = run_pattern(CANDIDATE)

    def added(text: Column, base: Column) -> Column:
        parts = F.flatten(F.transform(matches(text, pattern, 3), lambda run: uncovered(run, base)))
        runs = F.flatten(F.transform(parts, lambda part: secret_parts(part, ratios, least_ratio)))
        return F.coalesce(F.when(text.rlike(pattern), runs), _none())

    rows = texts(docs, **columns)
    found = let(
        base_spans(F.col("text")),
        lambda base: F.struct(base.alias("base"), added(F.col("text"), base).alias("added")),
    )
    return rows.select("doc_id", found.alias("found")).select("doc_id", "found.base", "found.added")


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(kind) for kind in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )


def _one_if(number: int) -> Callable[[Column], Column]:
    return lambda kind: F.when(kind == number, 1)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    number = {
        f"n_{kind}": F.size(F.array_compact(F.transform(kinds, _one_if(k)))).cast("long")
        for k, kind in enumerate(KINDS[:3])
    }
    return found.select(
        "doc_id",
        *[column.alias(name) for name, column in number.items()],
        F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_markov"),
    )
