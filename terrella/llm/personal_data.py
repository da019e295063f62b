"""Personal data in texts by weak supervision, in DataFrame and SQL functions only.

Base spans come from four patterns (e-mail, IP address, payment card, telephone) with their checks.  Further spans are
candidates of looser patterns: written-out e-mail, national telephone, US social security number, IBAN, and runs of mixed
letters and digits that may be secrets (keys, tokens, passwords).  Every
candidate and every base span gets votes from labelers - its pattern's own strict form, a gazetteer of words before it,
its neighbours, and a gazetteer of words that speak against it - each yes, no or silent.  Expectation-maximisation over
the counts of vote patterns (at most 3**4 a kind, however many documents) estimates how reliable each labeler is and
how
likely each pattern is to be personal data; a logistic span classifier is then trained on those soft labels, over the
votes, the kind, and what the span itself and its neighbours look like (length, distinct characters, letters with digits,
separators of one kind, a sign of a label before it, the end of a phrase after it).  Candidates it accepts are added; base
spans always stay.  Both fits are SQL expressions over one row, of one struct for each combination of votes, kind and
looks that occurs (at most 3**4 * 7 * 2**6, however many documents).

Positions are code points, the end exclusive.  Patterns that would rescan a run from each of its characters start only
where a run starts (or the last match ended), which finds the same leftmost matches in linear time.

Defined results: a null or empty text has no spans; rows that repeat an id each get a result; no candidates at all
leave the base spans alone; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrella.llm.common import written

KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "secret")
BASE = 4
_LOCAL = "[A-Za-z0-9._%+-]"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"

#: kind number, a cheap necessary condition, the pattern
PATTERNS = {
    "email": (0, "contains(text, '@')", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (1, "contains(text, '.')", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (2, "true", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": (3, "contains(text, '+')", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
CANDIDATES = {
    "email_written": (0, "contains(text, 'at]') OR contains(text, 'at)')", rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+\x20?(?:\[at\]|\(at\))\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?\[dot\]\x20?|\x20?\(dot\)\x20?)[A-Za-z0-9-]++)++"),
    "phone_national": (3, "true", r"(?<![0-9+(.-])(?:\([2-9][0-9]{2}\)\x20?|[2-9][0-9]{2}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9.-])"),
    "ssn": (4, "contains(text, '-')", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban": (5, "true", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "secret": (6, "true", rf"(?<![A-Za-z0-9_+/-])(?![A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}+(?![A-Za-z0-9_+/-]))(?![0-9_+/-]*+(?![A-Za-z]))(?![A-Za-z_+/-]*+(?![0-9]))(?!{_LOCAL}*+@)[A-Za-z0-9_+/-]{{16,}}+"),
}
#: Words that, just before a span, speak for its kind.
GAZETTEER = (
    "mail|e-mail|contact|write|reach|address|schreib|kontakt|adresse|écri|courriel|escrib|correo|dirección",
    "ip|host|server|client|addr|login|visit|rechner|zugriff|serveur|hôte|servidor|acceso",
    "card|visa|master|amex|credit|debit|pay|cc|karte|kredit|zahl|carte|crédit|tarjeta|crédito|pago",
    "tel|phone|call|mobile|cell|fax|dial|number|contact|anruf|handy|nummer|rufe|appel|portable|numéro|llam|móvil|número",
    "ssn|social|security|taxpayer|sozial|sécurité|seguridad",
    "iban|bank|account|transfer|konto|überweis|compte|banque|virement|cuenta|banco",
    "pass|pwd|secret|token|key|auth|bearer|credential|api|kennwort|geheim|schlüssel|clé|mot de passe|contraseña|clave",
)
#: Words that speak against any kind.
AGAINST = "isbn|issn|doi|version|release|order|invoice|part|model|serial|build|rev|commit|checksum|sha|md5|chapter|section|page|figure|table|bestellung|rechnung|seite|kapitel|commande|facture|chapitre|pedido|factura|página"
LABELERS = 4
REACH = 40
EM_ROUNDS, FIT_ROUNDS, FIT_RATE = 30, 150, 2.0
_SPAN = "struct<s:bigint,k:int,e:bigint,m:string,base:boolean>"


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def located(pattern: str, kind: int, base: bool, test: str, text: str = "text") -> str:
    """SQL: the matches of a pattern in ``text`` as an array of spans.

    Matches and the gaps between them are measured; their lengths are summed in blocks of 128, so that a text with very
    many matches costs no quadratic time.  ``x -> ...`` over a one-element array binds a value once.
    """
    rx = _sql(pattern)
    pairs = f"filter(zip_with(regexp_extract_all({text}, {rx}, 0), split({text}, {rx}, -1), (m, g) -> named_struct('m', m, 'g', length(g), 'n', length(m))), x -> x.m IS NOT NULL)"
    inner = f"named_struct('p', o, 'out', cast(array() AS array<{_SPAN}>))"
    step = f"(acc, x) -> named_struct('p', acc.p + x.g + x.n, 'out', concat(acc.out, array(named_struct('s', acc.p + x.g, 'k', {kind}, 'e', acc.p + x.g + x.n, 'm', x.m, 'base', {str(base).lower()}))))"
    sums = "aggregate(bs, named_struct('p', 0L, 'out', cast(array() AS array<bigint>)), (acc, b) -> named_struct('p', acc.p + aggregate(b, 0L, (z, x) -> z + x.g + x.n), 'out', concat(acc.out, array(acc.p))), acc -> acc.out)"
    blocks = "transform(sequence(0, (size(a) - 1) DIV 128), i -> slice(a, cast(i * 128 + 1 AS int), 128))"
    spans = f"flatten(zip_with(bs, {sums}, (b, o) -> aggregate(b, {inner}, {step}, acc -> acc.out)))"
    let = f"transform(array({pairs}), a -> CASE WHEN size(a) = 0 THEN cast(array() AS array<{_SPAN}>) ELSE transform(array({blocks}), bs -> {spans})[0] END)[0]"
    return f"CASE WHEN {test} THEN {let} ELSE cast(array() AS array<{_SPAN}>) END"


_DIGITS = "regexp_replace(x.m, '[^0-9]', '')"
_LUHN = f"""transform(array({_DIGITS}), d -> length(d) BETWEEN 14 AND 19 AND aggregate(sequence(1, length(d)), 0, (z, i) -> z + transform(array(cast(substring(d, length(d) - i + 1, 1) AS int) * (2 - i % 2)), v -> v - CASE WHEN v > 9 THEN 9 ELSE 0 END)[0]) % 10 = 0)[0]"""
CHECKS = {
    "email": "true",
    "ip": f"x.m RLIKE {_sql(f'^{_OCTET}(?:[.]{_OCTET}){{3}}$')}",
    "card": _LUHN,
    "phone": f"length({_DIGITS}) BETWEEN 10 AND 15",
}
#: The strict form of each kind, as the first labeler sees it.
STRICT = (
    r"^[A-Za-z0-9][^@]*@[A-Za-z0-9.-]*\.[A-Za-z]{2,}$",
    r"^(?:[1-9]|1?[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.[0-9]{1,3}){3}$",
    r"^(?:[3-6][0-9]{13,18}|[3-6][0-9]{3}(?:[ -][0-9]{4}){3})$",
    r"^\+?[0-9()][0-9() .-]{8,}[0-9]$",
    r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    r"^[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){3,7}(?: [A-Z0-9]{1,3})?)$",
    r"^(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[a-z]_[A-Za-z0-9]{20,}|sk[-_][A-Za-z0-9_-]{16,}|xox[a-z]-[A-Za-z0-9-]{10,}|[0-9a-f]{16,}|(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_-]{20,})$",
)


def _votes() -> str:
    """SQL: the votes v (1 yes, -1 no, 0 silent) for a span ``x`` of ``text``, and its looks g (1 or 0 each)."""
    strict = " ".join(f"WHEN {k} THEN x.m RLIKE {_sql(p)}" for k, p in enumerate(STRICT))
    words = " ".join(f"WHEN {k} THEN before RLIKE {_sql(f'(?:^|[^a-z])(?:{w})')}" for k, w in enumerate(GAZETTEER))
    votes = f"""array(
        CASE WHEN CASE x.k {strict} END THEN 1 ELSE -1 END,
        CASE WHEN CASE x.k {words} END THEN 1 ELSE 0 END,
        CASE WHEN before RLIKE CASE x.k WHEN 6 THEN '[a-z0-9_./]$' ELSE '[a-z0-9_/=]$' END OR after RLIKE '^[A-Za-z0-9_/=]' THEN -1 ELSE 1 END,
        CASE WHEN before RLIKE '(?:^|[^a-z])(?:{AGAINST})[^a-z]{{0,12}}$' THEN -1 ELSE 0 END)"""
    looks = """array(
        cast(length(x.m) >= 20 AS int),
        cast(size(array_distinct(split(substring(x.m, 1, 64), ''))) >= 9 AS int),
        cast(x.m RLIKE '[A-Za-z]' AND x.m RLIKE '[0-9]' AS int),
        cast(size(array_distinct(split(regexp_replace(substring(x.m, 1, 64), '[A-Za-z0-9+]', ''), ''))) <= 1 AS int),
        cast(before RLIKE '[:=#(\"][ \"(]*$' AS int),
        cast(after RLIKE '^([.,;:!?)\"\\n]|$)' AS int))"""
    votes = f"named_struct('v', {votes}, 'g', {looks})"
    context = f"named_struct('b', lower(substring(text, cast(greatest(1, x.s - {REACH} + 1) AS int), cast(least(x.s, {REACH}) AS int))), 'a', substring(text, cast(x.e + 1 AS int), 1))"
    return f"transform(array({context}), c -> {votes.replace('before', 'c.b').replace('after', 'c.a')})[0]"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and an array of spans with votes; base spans and candidates that overlap none of them."""
    df = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    found = df.select("doc_id", "text", *(F.expr(f"filter({located(p, k, True, test)}, x -> {CHECKS[name]})").alias(f"b{k}") for name, (k, test, p) in PATTERNS.items()), *(F.expr(located(p, k, False, test)).alias(name) for name, (k, test, p) in CANDIDATES.items()))
    joined = found.select("doc_id", "text", F.concat(*(F.col(f"b{k}") for k in range(BASE))).alias("base"), F.concat(*map(F.col, CANDIDATES)).alias("more"))
    free = "filter(more, x -> NOT exists(base, b -> b.s < x.e AND x.s < b.e))"
    every = joined.select("doc_id", "text", F.expr(f"CASE WHEN size(base) + size(more) = 0 THEN base ELSE concat(base, {free}) END").alias("spans"))
    return every.select("doc_id", F.expr(f"transform(transform(spans, x -> named_struct('x', x, 'y', {_votes()})), z -> named_struct('s', z.x.s, 'k', z.x.k, 'e', z.x.e, 'base', z.x.base, 'v', z.y.v, 'g', z.y.g))").alias("spans"))


def patterns(spans: DataFrame) -> DataFrame:
    """Kind, votes, looks and count: one row for each combination, however many documents there are."""
    return spans.select(F.explode("spans").alias("x")).groupBy(F.col("x.k").alias("k"), F.col("x.v").alias("v"), F.col("x.g").alias("g")).agg(F.count("*").cast("double").alias("n"))


#: What is believed of each labeler at first: the chances of a yes and of a no for personal data, and for other text.
BELIEFS = ((0.85, 0.14, 0.25, 0.74), (0.5, 0.01, 0.15, 0.01), (0.9, 0.09, 0.5, 0.49), (0.01, 0.03, 0.01, 0.4))
PRIOR = 0.7
#: The weight of these beliefs, as a share of all spans.
HELD = 0.1
_CHANCES = ("yes", "no", "other_yes", "other_no")


def _posterior(p: str, x: str) -> str:
    """SQL: the chance that a span with the votes of ``x`` is personal data; silence is a vote of its own."""
    chance = f"""CASE {x}.v[j] WHEN 1 THEN ln({p}.yes[j] / {p}.other_yes[j]) WHEN -1 THEN ln({p}.no[j] / {p}.other_no[j])
        ELSE ln((1 - {p}.yes[j] - {p}.no[j]) / (1 - {p}.other_yes[j] - {p}.other_no[j])) END"""
    return f"1 / (1 + exp(-(aggregate(sequence(0, {LABELERS - 1}), ln({p}.prior / (1 - {p}.prior)), (z, j) -> z + {chance}))))"


def reliabilities() -> str:
    """SQL over ``pats``: the prior and, per labeler, the chances of its votes for personal data and for other text.

    The beliefs count as HELD of all spans, so the fit is the same for any multiple of the counts.
    """
    listed = {name: "array(" + ", ".join(f"{b[k]}D" for b in BELIEFS) + ")" for k, name in enumerate(_CHANCES)}
    start = f"named_struct('prior', {PRIOR}D, " + ", ".join(f"'{name}', {value}" for name, value in listed.items()) + ")"
    total = lambda what, when="true": f"aggregate(qs, 0D, (z, x) -> z + CASE WHEN {when} THEN x.n * ({what}) ELSE 0D END)"
    rate = lambda name, q, vote: f"transform({listed[name]}, (b, j) -> ({total(q, f'x.v[j] = {vote}')} + h * b) / ({total(q)} + h))"
    rates = ", ".join(f"'{name}', {rate(name, q, vote)}" for name, q, vote in zip(_CHANCES, ("x.q", "x.q", "1 - x.q", "1 - x.q"), (1, -1, 1, -1), strict=True))
    step = f"""transform(array(transform(pats, x -> named_struct('v', x.v, 'n', x.n, 'q', {_posterior('p', 'x')}))), qs -> named_struct(
        'prior', ({total('x.q')} + h * {PRIOR}D) / ({total('1D')} + h), {rates}))[0]"""
    return f"transform(array({HELD}D * greatest(1D, aggregate(pats, 0D, (z, x) -> z + x.n))), h -> aggregate(sequence(1, {EM_ROUNDS}), {start}, (p, i) -> {step}))[0]"


LOOKS = 6
FEATURES = 1 + 2 * LABELERS + len(KINDS) + LOOKS
_FEATURES = f"concat(array(1D), flatten(transform(sequence(0, {LABELERS - 1}), j -> array(CASE WHEN x.v[j] = 1 THEN 1D ELSE 0D END, CASE WHEN x.v[j] = -1 THEN 1D ELSE 0D END))), transform(sequence(0, {len(KINDS) - 1}), k -> CASE WHEN x.k = k THEN 1D ELSE 0D END), transform(x.g, b -> cast(b AS double)))"


def classifier() -> str:
    """SQL over ``pats`` and ``rel``: weights of a logistic regression on the soft labels, by gradient descent."""
    rows = f"transform(pats, x -> named_struct('f', {_FEATURES}, 'n', x.n, 'q', {_posterior('rel', 'x')}))"
    dot = "aggregate(zip_with(w, r.f, (a, b) -> a * b), 0D, (z, y) -> z + y)"
    errors = f"transform(rs, r -> r.n * (1 / (1 + exp(-({dot}))) - r.q))"
    step = f"transform(array({errors}), es -> transform(w, (a, i) -> a - {FIT_RATE}D * (aggregate(zip_with(es, rs, (e, r) -> e * r.f[i]), 0D, (z, y) -> z + y) / total + 0.001D * a)))[0]"
    return f"transform(array({rows}), rs -> transform(array(greatest(1D, aggregate(pats, 0D, (z, x) -> z + x.n))), total -> aggregate(sequence(1, {FIT_ROUNDS}), array_repeat(0D, {FEATURES}), (w, i) -> {step}))[0])[0]"


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = 0.5) -> DataFrame:
    """doc_id and ``spans``: array of struct(s, k, e, base), by start and kind; k numbers KINDS."""
    spans = written(candidates(docs, id_col, text_col), "spans")
    one = patterns(spans).agg(F.sort_array(F.collect_list(F.struct("k", "v", "g", "n"))).alias("pats"))  # as many structs as combinations
    fitted = one.withColumn("rel", F.expr(reliabilities())).select(F.expr(classifier()).alias("w")).first()
    weights = ", ".join(f"{float(x)!r}D" for x in fitted["w"])
    dot = f"aggregate(zip_with(array({weights}), {_FEATURES}, (a, b) -> a * b), 0D, (z, y) -> z + y)"
    kept = f"filter(spans, x -> x.base OR 1 / (1 + exp(-({dot}))) >= {accept}D)"
    return spans.select("doc_id", F.expr(f"array_sort(transform({kept}, x -> named_struct('s', x.s, 'k', x.k, 'e', x.e, 'base', x.base)))").alias("spans"))


def report(found: DataFrame) -> DataFrame:
    """Counts of base spans by kind, the digest of the base spans, and all spans as text."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    joined = lambda spans: f"array_join(transform({spans}, x -> concat({names}[x.k], ':', x.s, ':', x.e)), ',')"
    counts = [F.expr(f"cast(size(filter(spans, x -> x.base AND x.k = {k})) AS bigint)").alias(f"n_{KINDS[k]}") for k in range(BASE)]
    return found.select("doc_id", *counts, F.expr(f"sha2({joined('filter(spans, x -> x.base)')}, 256)").alias("base_sha256"), F.expr(joined("spans")).alias("spans"))
