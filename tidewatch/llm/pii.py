"""Operator 9: personal data by patterns, checksums and context words.

Regular expressions propose spans, validators (octets, Luhn, mod 97, digit
counts) confirm them, and words shortly before a span, back to the candidate
before it, move its score.  The score decides on added kinds: bare numbers and
credentials stay only where their context speaks for them.  Base kinds stay
whatever their score.  All of it is DataFrame functions on one row at a time:
nothing is shuffled.

The patterns are written so that Java's matcher needs linear time: repetitions
are possessive and a match begins only where a run of its characters begins (or
where the match before ended), which finds the same leftmost matches.  Places
are running sums over pieces of an array and texts are cut from pieces of
bounded length, so the whole is in proportion to the text.

Defined results: a null text counts as empty and has no spans; the digest of no
spans is that of the empty string; equal rows stay as many rows; other columns
of the input stay.  Spans of different kinds may overlap.  An added kind is
tried wherever its pattern begins, inside candidates that fail too, so its
confirmed spans may overlap each other.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

_LOCAL = "A-Za-z0-9._%+-"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_MOD_97 = (
    "aggregate(split(concat(substring({v}, 5), left({v}, 4)), ''), 0L, "
    "(r, c) -> CASE WHEN c = '' THEN r WHEN c BETWEEN '0' AND '9' THEN (r * 10 + CAST(c AS BIGINT)) % 97 "
    "ELSE (r * 100 + ascii(c) - 55) % 97 END) = 1"
)

#: Characters of an IBAN by country: of the registry, and of countries that use it without an entry there.
_IBAN_LENGTHS = {
    15: "NO",
    16: "BE",
    18: "DK FI FK FO GL NL SD",
    19: "MK SI",
    20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST",
    26: "DZ IR IS TR",
    27: "BI BL CF CG CM DJ FR GA GF GP GQ IT KM MC MF MG MQ MR NC PF PM RE SM TD TF WF YT",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG",
    29: "BR EG PS QA UA",
    30: "JO KW MU YE",
    31: "MT SC",
    32: "LC",
    33: "RU",
}


def _iban() -> str:
    """Country, check digits, then groups of four and the rest that the country's length leaves; a space may stand before each."""
    parts = []
    for n, countries in _IBAN_LENGTHS.items():
        fours, rest = divmod(n - 4, 4)
        parts.append(f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{fours}}}" + (f" ?[A-Z0-9]{{{rest}}}" if rest else ""))
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?=((?:{'|'.join(parts)})(?![A-Za-z0-9])))[A-Z]"


@dataclass(frozen=True)
class Kind:
    """A kind of personal data.

    confirm is SQL over x.value; near are words that raise the score by gain when
    they stand within CONTEXT characters before the span, doubt words that lower
    it by 0.3.  The pattern of a kind that is not base matches one character and
    looks ahead at its candidate, group 1.
    """

    name: str
    guard: str
    pattern: str
    confirm: str
    prior: float
    near: str
    gain: float = 0.1
    doubt: str = "isbn|order|version|build"
    base: bool = True


#: In the order in which spans with the same start are listed.
KINDS = (
    Kind("email", "@", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "true", 0.9, "mail|contact|write"),
    Kind("ip", ".", r"[0-9](?<![0-9]{2})[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++", rf"x.value RLIKE '^{_OCTET}(?:[.]{_OCTET}){{3}}$'", 0.6, "ip|host|server|address|addr"),
    Kind("card", "", r"[0-9]++(?:[ -][0-9]++)*+", "length(translate(x.value, ' -', '')) BETWEEN 14 AND 19 AND luhn_check(translate(x.value, ' -', ''))", 0.8, "card|visa|credit|karte|tarjeta|carte"),
    Kind("phone", "+", r"\+[0-9][ ().0-9-]+[0-9]", "length(translate(x.value, '+ ().-', '')) BETWEEN 10 AND 15", 0.7, "phone|tel|call|mobile|fax"),
    Kind("iban", "", _iban(), _MOD_97.format(v="translate(x.value, ' ', '')"), 0.7, "iban|account|bank|konto|compte|cuenta", 0.2, base=False),
    # Three, two and four digits; areas, groups and numbers of zeros, area 666 and areas from 900 on were never given out.
    Kind("ssn", "-", r"(?<![0-9A-Za-z-])(?=([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9A-Za-z-]))[0-9]", "NOT x.value RLIKE '^(?:000|666|9..)|-00-|-0000$'", 0.4, "ssn|social security|taxpayer|insurance n", 0.3, base=False),
    # Eight to twelve digits in one run: an account only where words say so.
    Kind("account", "", r"(?<![0-9A-Za-z.+-])(?=([0-9]{8,12}+)(?![0-9A-Za-z-]|[.][0-9]))[0-9]", "true", 0.3, "account n|account:|acct|kontonummer|konto-nr|cuenta n|compte n", 0.3, base=False),
    # Letters and digits mixed, 16 characters or more, named as a credential.
    Kind("secret", "", r"(?<![0-9A-Za-z_+/=-])(?=([0-9A-Za-z_+/=-]{16,}+))[0-9A-Za-z]", "x.value RLIKE '[0-9]' AND x.value RLIKE '[A-Za-z]'", 0.3, "passw|secret|token|api[_ -]?key|access[_ -]?key|credential", 0.3, base=False),
)

#: Characters before a span that are searched for context words.
CONTEXT = 40
#: Added (not base) spans need this score.
KEEP_SCORE = 0.5

#: Items of a piece of an array, and characters of a piece of a text.
RUN, CUT = 512, 512

_SPANS = "array<struct<start:int,kind_no:int,end:int,kind:string,value:string,score:double>>"


def _let(name: str, value: str, body: str) -> str:
    """SQL: ``body``, in which ``name`` stands for ``value``, computed once and written once whatever is pushed where in a plan."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _running(values: str, start: str, step: Callable[[str, str], str]) -> str:
    """SQL: for each item of the array ``values``, ``step`` over all items before it, from ``start``.

    An array grows by copying, so the items are taken in pieces of RUN: what
    stands before a piece comes from the totals of the pieces before it.
    """

    def scan(over: str, at: str) -> str:
        return f"aggregate({over}, named_struct('now', {at}, 'seen', CAST(array() AS array<int>)), (s, v) -> named_struct('now', {step('s.now', 'v')}, 'seen', concat(s.seen, array(s.now))), s -> s.seen)"

    pieces = f"transform(sequence(0, greatest(size(w) - 1, 0) div {RUN}), i -> slice(w, i * {RUN} + 1, {RUN}))"
    totals = f"transform(c, q -> aggregate(q, {start}, (a, v) -> {step('a', 'v')}))"
    joined = f"flatten(zip_with(c, {scan(totals, start)}, (q, o) -> {scan('q', 'o')}))"
    return _let("w", values, _let("c", pieces, joined))


def _plus(a: str, v: str) -> str:
    return f"{a} + {v}"


def _most(a: str, v: str) -> str:
    return f"greatest({a}, {v})"


def _spans_of(k: int, text: str) -> str:
    """SQL: the confirmed spans of a kind in a text, of base kinds leftmost and not overlapping.

    A place is the sum of the lengths of the matches (m) and of the gaps before
    them (g); the match of an added kind uses up its first character only.
    """
    kind, none = KINDS[k], f"CAST(array() AS {_SPANS})"
    used = f"zip_with(g, m, (x, y) -> length(x) + {'length(y)' if kind.base else '1'})"
    places = f"zip_with({_running(used, '0', _plus)}, g, (o, x) -> named_struct('start', o + length(x), 'before', x))"
    placed = f"zip_with({places}, m, (x, y) -> named_struct('start', x.start, 'end', x.start + length(y), 'value', y, 'before', x.before))"
    before = f"lower(right(x.before, {CONTEXT}))"
    score = f"greatest(0D, least(1D, {kind.prior}D + CASE WHEN {before} RLIKE '{kind.near}' THEN {kind.gain}D ELSE 0D END - CASE WHEN {before} RLIKE '{kind.doubt}' THEN 0.3D ELSE 0D END))"
    kept = f"transform(filter({placed}, x -> {kind.confirm}), x -> named_struct('start', x.start, 'kind_no', {k}, 'end', x.end, 'kind', '{kind.name}', 'value', x.value, 'score', {score}))"
    if not kind.base:
        kept = f"filter({kept}, x -> x.score >= {KEEP_SCORE}D)"
    pattern = _quoted(kind.pattern)
    found = _let("m", f"regexp_extract_all({text}, {pattern}, {0 if kind.base else 1})", f"CASE WHEN size(m) = 0 THEN {none} ELSE {_let('g', f'slice(split({text}, {pattern}, -1), 1, size(m))', kept)} END")
    return f"CASE WHEN contains({text}, '{kind.guard}') THEN {found} ELSE {none} END" if kind.guard else found


def find_spans(df: DataFrame, text_col: str = "text", into: str = "pii_spans") -> DataFrame:
    """Adds the array ``into`` of struct(start, kind_no, end, kind, value, score), by start, then kind.

    Places count code points; the end is exclusive.
    """
    rows = df.select(F.struct("*").alias("_row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    spans = F.array_sort(F.concat(*(F.expr(_spans_of(k, "_text")) for k in range(len(KINDS)))))
    return rows.select("_row", spans.alias("_spans")).select(*(F.col(f"_row.`{c}`").alias(c) for c in df.columns if c != into), F.col("_spans").alias(into))


def _redacted(text: str, spans: str) -> str:
    """SQL: the text with each span replaced by its kind in brackets; of overlapping spans the first gives the name.

    The text is cut into pieces of CUT characters, so that a part is found
    without reading all before it.
    """

    def part(a: str, b: str) -> str:
        """The text from place a to place b."""
        held = f"array_join(slice(t, {a} div {CUT} + 1, ({b} - 1) div {CUT} - {a} div {CUT} + 1), '')"
        return f"CASE WHEN {b} > {a} THEN substring({held}, {a} % {CUT} + 1, {b} - {a}) ELSE '' END"

    # u: how far the spans before a span reach.
    reached = _running("transform(r, x -> x.end)", "0", _most)
    named = f"transform(filter(zip_with(r, {reached}, (x, u) -> named_struct('x', x, 'u', u)), z -> z.x.start >= z.u), z -> concat({part('z.u', 'z.x.start')}, '[', upper(z.x.kind), ']'))"
    rest = _let("e", "array_max(transform(r, x -> x.end))", _let("n", f"length({text})", part("e", "n")))
    done = _let("t", f"regexp_extract_all({text}, '(?s).{{1,{CUT}}}', 0)", f"concat(array_join({named}, ''), {rest})")
    return _let("r", spans, f"CASE WHEN size(r) = 0 THEN {text} ELSE {done} END")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs (text, n_chars and more) with the spans of every text replaced by their kinds; n_chars follows where a text has spans."""
    wrapped = docs.select(F.struct("*").alias("_row"), F.col(f"`{text_col}`").alias("_text"))
    found = find_spans(wrapped, "_text", "_spans")
    rows = found.select("_row", (F.size("_spans") > 0).alias("_changed"), F.expr(_redacted("_text", "_spans")).alias("_clean"))
    columns = {c: F.col(f"_row.`{c}`") for c in docs.columns}
    columns[text_col] = F.col("_clean")
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("_changed"), F.length("_clean").cast("long")).otherwise(columns["n_chars"])
    return rows.select(*(column.alias(c) for c, column in columns.items()))


def _joined(spans: str) -> str:
    return f"array_join(transform({spans}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [i for i, k in enumerate(KINDS) if k.base]
    base_spans = f"filter(pii_spans, x -> x.kind_no IN ({', '.join(map(str, base))}))"
    counts = [F.expr(f"CAST(size(filter(pii_spans, x -> x.kind_no = {i})) AS BIGINT)").alias(f"n_{KINDS[i].name}") for i in base]
    return found.select(
        "doc_id",
        *counts,
        F.expr(f"sha2({_joined(base_spans)}, 256)").alias("base_sha256"),
        F.expr(_joined("pii_spans")).alias("spans"),
        F.expr("array_max(transform(pii_spans, x -> x.score))").alias("top_score"),
    )
