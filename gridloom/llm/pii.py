"""Personal data by weak supervision, in DataFrame functions alone.

Four kinds of span: email, ip, card, phone. Base spans come from one pattern a
kind and a check of each match. What a pattern finds and its check drops is
searched again for a well-formed span inside (a card or phone number run
together with its neighbours), and e-mail addresses with the at sign spelled
out in brackets are looked for; these are candidates.

Labelers vote on every base span and candidate: 1, 0 (no opinion) or -1. They
are the base pattern, a gazetteer (top-level domains, country codes, issuers'
first digits, reserved addresses), cue words before the span, the characters
around it, and its layout. Vote patterns, a few hundred at most, are counted
over all documents; expectation-maximisation on these counts estimates each
labeler's reliability a kind, and a logistic classifier is trained on the
posterior labels. Candidates that it accepts are added; base spans stay.

Credentials are counted beside them; they are no kind of span.

Defined results: a null text is empty; without spans the span string is empty
and the digest that of an empty string. A repeated row gets its row. Offsets
are code points. Patterns that could backtrack use possessive loops, so time
is in proportion to the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "gazetteer", "cues", "edges", "layout")
#: Rounds of expectation-maximisation and of the classifier's gradient steps.
ROUNDS, STEPS, ACCEPT = 15, 150, 0.5

# Gazetteers and cue words.
_TLDS = "com|org|net|edu|gov|mil|int|info|biz|io|dev|app|de|fr|es|it|nl|uk|us|eu|ch|at|be|pt|pl|se|no|dk|fi|ie|ca|au|nz|jp|cn|in|br|mx|ar|ru"
_COUNTRY = "1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|53|54|55|56|57|58|60|61|62|63|64|65|66|81|82|84|86|90|91|92|93|94|95|98|351|352|353|354|358|359|370|371|372|380|385|386|420|421|852|886|971|972"
_CUES = {
    "email": "mail|contact|write|reach|kontakt|schreib|correo|contacto|courriel|adresse",
    "ip": "ip|host|server|address|addr|client|login|serveur|servidor|adresse",
    "card": "card|visa|credit|debit|mastercard|amex|karte|carte|tarjeta|payment|pay",
    "phone": "phone|tel|call|mobile|cell|fax|dial|telefon|anruf|appel|llam|contact",
}
_AGAINST = "version|isbn|issn|sku|order|serial|build|release|section|figure|table|token|hash|key"

# The at sign's run is left where a search begins, or where the last match ended.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_SPELLED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(](?:dot|DOT)[\])]) ?[A-Za-z0-9-]++)++"
_CARD_IN = r"(?<![0-9])(?:[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{13,19})(?![0-9])"
_PHONE_IN = r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{4}(?![0-9])"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


# Credentials, as named values and by the forms that issuers give them.
_SECRET = r"(?:(?i:token|secret|passwd|password|api[_-]?key|access[_-]?key)[\"']?\s{0,4}[=:]\s{0,4}[\"']?[A-Za-z0-9+/_-]{16,}+)|\bAKIA[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36}\b|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"

# What any of these ends with, which few texts have: the names are looked for in those alone.
_SECRET_VALUE = r"[=:]\s{0,4}[\"']?[A-Za-z0-9+/_-]{16}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|-----BEGIN "


def _running(array: str, name: str) -> str:
    """Starts of matches, from an array of (g, m): the gap before each and its length.

    Sums run inside blocks of 256 and over blocks, so that an array of n
    matches is not copied n times.
    """
    a, b, c, e, s, k = (f"{name}{x}" for x in "abcesk")
    block = f"aggregate({{0}}, named_struct('at', {{1}}, 'o', cast(array() as array<bigint>)), ({a}, {e}) -> named_struct('at', {a}.at + {e}.g + {e}.m, 'o', concat({a}.o, array({a}.at + {e}.g))), {a} -> {a}.o)"
    sums = f"transform({c}, {s} -> named_struct('g', 0L, 'm', aggregate({s}, 0L, ({a}, {e}) -> {a} + {e}.g + {e}.m)))"
    blocks = f"transform(sequence(0, (size({array}) - 1) div 256), {k} -> slice({array}, {k} * 256 + 1, 256))"
    return f"transform(array({blocks}), {c} -> flatten(zip_with({c}, {block.format(sums, '0L')}, ({s}, {b}) -> {block.format(s, b)})))[0]"


def _found(text: str, pattern: str, name: str) -> str:
    """Matches in order: (at, m, before, after), with up to 32 characters before and one after."""
    m, p, x, i, z = (f"{name}{v}" for v in ("ms", "ps", "x", "i", "z"))
    lengths = f"zip_with({x}.ms, slice({x}.ps, 1, size({x}.ms)), ({m}, {p}) -> named_struct('g', cast(length({p}) as bigint), 'm', cast(length({m}) as bigint)))"
    each = f"zip_with({x}.ms, {_running(f'{z}', name)}, ({m}, {i}) -> named_struct('m', {m}, 'at', {i}))"
    rows = f"transform(transform(array({lengths}), {z} -> {each})[0], ({m}, {i}) -> named_struct('at', {m}.at, 'm', {m}.m, 'before', right({x}.ps[{i}], 32), 'after', left({x}.ps[{i} + 1], 1)))"
    return f"transform(array(named_struct('ms', regexp_extract_all({text}, r'{pattern}', 0), 'ps', split({text}, r'{pattern}', -1))), {x} -> {rows})[0]"


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _luhn(m: str, name: str) -> str:
    """Whether 12 to 19 digits have a valid check digit."""
    d, a, i = f"{name}d", f"{name}a", f"{name}i"
    total = f"aggregate(sequence(1, length({d})), 0, ({a}, {i}) -> {a} + element_at(if({i} % 2 = 1, array(0,1,2,3,4,5,6,7,8,9), array(0,2,4,6,8,1,3,5,7,9)), cast(substring(reverse({d}), {i}, 1) as int) + 1))"
    return f"transform(array({_digits(m)}), {d} -> length({d}) between 12 and 19 and {total} % 10 = 0)[0]"


def _valid(kind: str, m: str, name: str) -> str:
    if kind == "ip":
        return f"{m} rlike r'^{_BYTE}(?:\\.{_BYTE}){{3}}$'"
    if kind == "card":
        return _luhn(m, name)
    if kind == "phone":
        return f"length({_digits(m)}) between 9 and 15"
    return "true"


def _votes(kind: str, x: str, base: bool) -> str:
    """The labelers' votes on match ``x`` as text, one sign each: + 0 -."""
    sign = lambda plus, minus="false": f"case when {plus} then '+' when {minus} then '-' else '0' end"
    gazetteer = {
        "email": sign(f"{x}.m rlike r'(?i)(?:\\.|dot[\\])] ?)(?:{_TLDS})$'"),
        "ip": sign(f"not {x}.m rlike r'^0*(?:0|127|255)\\.'", "true"),
        "card": sign(f"{x}.m rlike '^[3-6]'", "true"),
        "phone": sign(f"{x}.m rlike r'^\\+(?:{_COUNTRY})(?![0-9])'"),
    }[kind]
    layout = {
        "email": sign(f"length({x}.m) <= 80", "true"),
        "ip": sign(f"not {x}.m rlike r'(?:^|\\.)0[0-9]'", "true"),
        "card": sign(f"length({_digits(f'{x}.m')}) in (13, 15, 16)", "true"),
        "phone": sign(f"{x}.m rlike r'[\\x20().-]'", "true"),
    }[kind]
    cues = sign(f"{x}.before rlike r'(?i)(?:{_CUES[kind]})[^a-z]*$'", f"{x}.before rlike r'(?i)(?:{_AGAINST})[^a-z]*$'")
    edges = sign(f"not {x}.before rlike r'[\\p{{L}}0-9]$' and not {x}.after rlike r'^[\\p{{L}}0-9]'", "true")
    return f"concat({sign(str(base).lower())}, {gazetteer}, {cues}, {edges}, {layout})"


def _span(kind: str, x: str, base: bool, at: str = "0L") -> str:
    return f"named_struct('start', {at} + {x}.at, 'kind', {KINDS.index(kind)}, 'stop', {at} + {x}.at + length({x}.m), 'base', {str(base).lower()}, 'votes', {_votes(kind, x, base)})"


def spans(text: str = "text") -> Column:
    """Base spans and candidates of a text column, as one array in order."""
    none = "cast(array() as array<struct<start:bigint,kind:int,stop:bigint,base:boolean,votes:string>>)"
    t = f"coalesce({text}, '')"
    parts = []
    for kind, pattern, inner, guard in (
        ("email", _EMAIL, None, f"contains({t}, '@')"),
        ("ip", _IP, None, f"{t} rlike r'[0-9]\\.[0-9]'"),
        ("card", _CARD, _CARD_IN, f"{t} rlike r'[0-9](?:[\\x20-]?[0-9]){{11}}'"),
        ("phone", _PHONE, _PHONE_IN, f"{t} rlike r'\\+[0-9]'"),
    ):
        n = kind[0]
        good = f"transform(filter({n}all, {n}f -> {n}f.ok), {n}g -> {_span(kind, f'{n}g.x', True)})"
        made = good
        if inner:
            again = f"transform(filter({_found(f'{n}h.x.m', inner, n + 'n')}, {n}q -> {_valid(kind, f'{n}q.m', n + 'w')}), {n}q -> {_span(kind, f'{n}q', False, f'{n}h.x.at')})"
            made = f"concat({good}, flatten(transform(filter({n}all, {n}f -> not {n}f.ok), {n}h -> {again})))"
        checked = f"transform({_found(t, pattern, n + 'o')}, {n}v -> named_struct('x', {n}v, 'ok', {_valid(kind, f'{n}v.m', n + 'y')}))"
        parts.append(f"if({guard}, transform(array({checked}), {n}all -> {made})[0], {none})")
    spelled = f"transform({_found(t, _SPELLED, 's')}, sx -> {_span('email', 'sx', False)})"
    parts.append(f"if({t} rlike r'(?:at|AT)[\\])]', {spelled}, {none})")
    return F.array_sort(F.expr(f"concat({', '.join(parts)})"))


def reliabilities(patterns: DataFrame) -> DataFrame:
    """(kind, votes, posterior, probability) from (kind, votes, n).

    One row a kind folds expectation-maximisation: the chance of each vote of
    each labeler given that a span is or is not personal data, with pseudo
    counts that hold a labeler to be better than chance, then the posterior of
    each pattern. The second fold takes gradient steps of a logistic
    classifier whose features are the votes.
    """
    k = len(LABELERS)
    # pseudo counts by vote (+, 0, -) for spans that are personal data; the others are mirrored
    prior = "map('+', 6D, '0', 3D, '-', 1D)"
    other = "map('+', 1D, '0', 3D, '-', 6D)"
    total = "aggregate(zip_with(ps, post, (p, w) -> p.n * {w}), 0D, (a, x) -> a + x)"
    by_vote = "aggregate(zip_with(ps, post, (q, w) -> if(substring(q.votes, {l}, 1) = substring(p.votes, {l}, 1), q.n * {w}, 0D)), 0D, (a, x) -> a + x)"
    terms = []
    for one in range(1, k + 1):
        vote = f"substring(p.votes, {one}, 1)"
        terms.append(f"ln(({prior}[{vote}] + {by_vote.format(l=one, w='w')}) / (10 + s.yes)) - ln(({other}[{vote}] + {by_vote.format(l=one, w='(1 - w)')}) / (10 + s.no))")
    update = f"transform(array(named_struct('yes', {total.format(w='w')}, 'no', {total.format(w='(1 - w)')})), s -> transform(ps, p -> 1 / (1 + exp(-greatest(-30D, least(30D, ln((2 + s.yes) / (2 + s.no)) + {' + '.join(terms)}))))))[0]"
    start = "transform(ps, p -> 1 / (1 + exp(-aggregate(p.x, 0D, (a, v) -> a + v))))"
    grouped = patterns.withColumn("x", F.expr(f"transform(sequence(1, {k}), i -> case substring(votes, i, 1) when '+' then 1D when '-' then -1D else 0D end)"))
    grouped = grouped.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n"), "x"))).alias("ps"))
    em = grouped.withColumn("post", F.expr(f"aggregate(sequence(1, {ROUNDS}), {start}, (post, i) -> {update})"))
    dot = "aggregate(zip_with(p.x, slice(w, 2, {k}), (u, v) -> u * v), w[0], (a, v) -> a + v)".format(k=k)
    guess = f"1 / (1 + exp(-({dot})))"
    step = f"transform(w, (old, j) -> old - 0.001D * old + aggregate(zip_with(ps, post, (p, y) -> p.n / size * (y - {guess}) * if(j = 0, 1D, p.x[j - 1])), 0D, (a, g) -> a + g))"
    trained = em.withColumn("size", F.expr("aggregate(ps, 0D, (a, p) -> a + p.n)")).withColumn("w", F.expr(f"aggregate(sequence(1, {STEPS}), array_repeat(0D, {k + 1}), (w, i) -> {step})"))
    return trained.select("kind", "post", F.posexplode("ps").alias("i", "p"), "w").select("kind", "p.votes", F.expr("post[i]").alias("posterior"), F.expr(guess).alias("probability"))


def fit(docs: DataFrame) -> dict[tuple[int, str], float]:
    """The classifier's probability for each kind and vote pattern that occurs.

    At most 4 * 3 ** 5 rows come to the driver.
    """
    counts = docs.select(F.explode(spans()).alias("s")).groupBy("s.kind", "s.votes").agg(F.count(F.lit(1)).alias("n"))
    return {(r["kind"], r["votes"]): r["probability"] for r in reliabilities(counts).collect()}


def accepted(found: Column, model: dict[tuple[int, str], float]) -> Column:
    """Base spans, and candidates whose vote pattern the classifier accepts."""
    kept = [F.lit(f"{k}{v}") for (k, v), p in sorted(model.items()) if p >= ACCEPT]
    good = F.array(*kept) if kept else F.array().cast("array<string>")
    return F.filter(found, lambda s: s["base"] | F.array_contains(good, F.concat(s["kind"].cast("string"), s["votes"])))


def _listed(array: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(array, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def detect(docs: DataFrame, model: dict[tuple[int, str], float] | None = None) -> DataFrame:
    """doc_id, a count of base spans a kind, the base spans' digest, all spans, credentials (n_secret) and all of these (n_all)."""
    model = fit(docs) if model is None else model
    secrets = F.when(F.col("text").rlike(_SECRET_VALUE), F.regexp_count("text", F.lit(_SECRET))).otherwise(0).cast("long")
    all_spans = docs.select("doc_id", accepted(spans(), model).alias("_all"), secrets.alias("n_secret"))
    base = all_spans.withColumn("_base", F.filter("_all", lambda s: s["base"]))
    counts = [F.expr(f"cast(size(filter(_base, s -> s.kind = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    total = (F.size("_all") + F.col("n_secret")).cast("long")
    return base.select("doc_id", *counts, F.sha2(_listed(F.col("_base")).cast("binary"), 256).alias("base_sha256"), _listed(F.col("_all")).alias("spans"), "n_secret", total.alias("n_all"))


def redact(docs: DataFrame, model: dict[tuple[int, str], float] | None = None) -> DataFrame:
    """The documents' columns, with each span in text replaced by its kind in brackets.

    Spans that overlap are replaced as one. n_chars, where there is one, follows.
    """
    model = fit(docs) if model is None else model
    columns = docs.columns
    # inside, the input's columns have numbers, so that none clashes with ours
    inner = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(columns)], F.col("text"))
    marked = inner.withColumn("_spans", accepted(spans(), model))
    names = "array(" + ", ".join(f"'[{k.upper()}]'" for k in KINDS) + ")"
    pieces = f"""aggregate(_spans, named_struct('at', 0L, 'out', cast(array() as array<string>)),
        (a, s) -> if(s.start < a.at,
            named_struct('at', greatest(a.at, s.stop), 'out', a.out),
            named_struct('at', s.stop, 'out', concat(a.out, array(substring(text, cast(a.at as int) + 1, cast(s.start - a.at as int)), {names}[s.kind])))),
        a -> concat(array_join(a.out, ''), substring(text, cast(a.at as int) + 1)))"""
    made = marked.withColumn("_new", F.when(F.size("_spans") > 0, F.expr(pieces)).otherwise(F.col("text")))
    out = []
    for i, c in enumerate(columns):
        value = F.col(f"_c{i}")
        if c == "text":
            value = F.col("_new")
        elif c == "n_chars":
            value = F.when((F.size("_spans") > 0) & value.isNotNull(), F.length("_new").cast(docs.schema[c].dataType)).otherwise(value)
        out.append(value.alias(c))
    return made.select(*out)
