"""Find secrets in texts: fixed patterns, and strings whose characters look random.

Candidate strings are runs of the characters that keys are made of. A window slides over each one; when it moves on
by a character, one count goes up, one goes down, and the sum of c * log2(c) over the window's counts changes by
those two alone. Windows whose entropy reaches the limit of the string's character class are marked, from the first
to the last of them; strings on the allow list are not.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN_VALUE = 6
# Characters of candidates; their places number the counts.
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
CANDIDATE = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
# Class: pattern of the whole candidate, and the entropy in bits per character from which a window is marked.
CLASSES = (
    ("hexadecimal", "^[0-9a-fA-F]+$", 3.0),
    ("lower case and digits", "^[0-9a-z_=-]+$", 3.5),
    ("upper case and digits", "^[0-9A-Z_=-]+$", 3.5),
    ("base 64", "^[0-9A-Za-z+/_=-]+$", 3.8),
)
# Candidates that match one of these are no secrets.
ALLOWED = (
    "^[^0-9]*$",  # no digit: words
    "^[0-9_=/+-]*$",  # no letter: numbers, dates, rules
    "^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",  # identifiers in the usual form
    "(?i)(example|sample|dummy|placeholder|changeme|xxxx)",
    "(?i)(0123456789|abcdefgh)",
    "^[a-z]+([-_/][a-z]+)*[-_/]?[0-9]{1,4}$",  # words and a number
)


def _spans(text: Column, pattern: str, kind: int, keep: Column | None = None) -> Column:
    """array<struct<start, kind, end>> of all matches, leftmost first; ``keep``: whether each one counts."""
    between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    lengths = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.length(x))
    keep = F.transform(lengths, lambda x: F.lit(True)) if keep is None else keep
    empty = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    found = F.aggregate(
        F.arrays_zip(F.slice(between, 1, F.greatest(F.size(lengths), F.lit(0))).alias("gap"), lengths.alias("len"), keep.alias("keep")),
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda s, m: F.struct(
            (s["at"] + m["gap"] + m["len"]).alias("at"),
            F.when(m["keep"], F.concat(s["out"], F.array(F.struct(
                (s["at"] + m["gap"]).alias("start"), F.lit(kind).alias("kind"), (s["at"] + m["gap"] + m["len"]).alias("end")))))
            .otherwise(s["out"]).alias("out")))["out"]
    return found


def _marked() -> str:
    """SQL for one candidate c (text, at): the first and last marked place in it, 0 if none."""
    terms = ", ".join(repr(c * math.log2(c) if c else 0.0) + "D" for c in range(WINDOW + 2))
    limit = "case " + " ".join(f"when c.text rlike '{p}' then {h}D" for _, p, h in CLASSES) + " else 99D end"
    g = "element_at(array({0}), cast({1} as int) + 1)"
    enters = f"instr('{ALPHABET}', substring(c.text, i, 1))"
    leaves = f"if(i > {WINDOW}, instr('{ALPHABET}', substring(c.text, i - {WINDOW}, 1)), 0)"
    step = (f"transform(array(named_struct('x', {enters}, 'y', {leaves})), m -> named_struct('x', m.x, 'y', m.y, "
            f"'s', a.s + if(m.x = m.y, 0D, {g.format(terms, 'element_at(a.n, m.x) + 1')} - {g.format(terms, 'element_at(a.n, m.x)')} "
            f"+ if(m.y = 0, 0D, {g.format(terms, 'element_at(a.n, greatest(m.y, 1)) - 1')} - {g.format(terms, 'element_at(a.n, greatest(m.y, 1))')}))))[0]")
    body = (f"transform(array({step}), t -> named_struct("
            f"'n', transform(a.n, (v, j) -> v + if(j + 1 = t.x, 1, 0) - if(j + 1 = t.y, 1, 0)), 's', t.s, "
            f"'first', if(a.first = 0 and i >= {WINDOW} and {math.log2(WINDOW)}D - t.s / {WINDOW}D >= a.h, i - {WINDOW - 1}, a.first), "
            f"'last', if(i >= {WINDOW} and {math.log2(WINDOW)}D - t.s / {WINDOW}D >= a.h, i, a.last), 'h', a.h))[0]")
    start = f"named_struct('n', array_repeat(0, {len(ALPHABET)}), 's', 0D, 'first', 0, 'last', 0, 'h', {limit})"
    return f"aggregate(sequence(1, length(c.text)), {start}, (a, i) -> {body}, a -> named_struct('first', a.first, 'last', a.last))"


def find_secrets(docs: DataFrame, text: str = "text", name: str = "secret_spans") -> DataFrame:
    """``docs`` with ``name``: array<struct<start, kind, end>> in code points, end exclusive, sorted by start and kind.

    Kinds are numbers of KINDS. Null texts are empty and have no spans. Other columns are kept; one called like the
    new one is replaced. Spans of different kinds may overlap. Only SQL functions run, row by row, without a shuffle.
    """
    docs = docs.drop(name)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    values = F.transform(F.regexp_extract_all(body, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= ASSIGN_VALUE)
    # what each pattern needs is looked for first
    assign = F.when(F.contains(body, F.lit("=")) | F.contains(body, F.lit(":")), _spans(body, ASSIGN, 0, values)).otherwise(none)
    access = F.when(F.contains(body, F.lit("AKIA")), _spans(body, ACCESS, 1)).otherwise(none)
    hexes = F.when(body.rlike(HEX), _spans(body, HEX, 2)).otherwise(none)
    runs = F.when(body.rlike(CANDIDATE), F.transform(_spans(body, CANDIDATE, 3), lambda s: F.struct(
        F.substring(body, s["start"] + 1, s["end"] - s["start"]).alias("text"), s["start"].alias("at")))).otherwise(
            F.expr("cast(array() as array<struct<text:string,at:int>>)"))
    allowed = " or ".join(f"c.text rlike '{p}'" for p in ALLOWED)
    quoted = f"""transform(filter(transform(filter(_runs, c -> not ({allowed})), c -> named_struct('at', c.at, 'm', {_marked()})), c -> c.m.first > 0),
        c -> named_struct('start', c.at + c.m.first - 1, 'kind', 3, 'end', c.at + c.m.last))"""
    out = docs.withColumn("_runs", runs).withColumn(name, F.array_sort(F.concat(assign, access, hexes, F.expr(quoted))))
    return out.drop("_runs")


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with each span, or stretch of overlapping spans, replaced by ``mask``."""
    done = F.aggregate(
        spans, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda a, s: F.struct(
            F.when(s["start"] >= a["at"], F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mask)))
            .otherwise(a["out"]).alias("out"),
            F.greatest(a["at"], s["end"]).alias("at")))
    return F.when(F.size(spans) > 0, F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))).otherwise(text)
