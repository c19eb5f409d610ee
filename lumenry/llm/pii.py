"""Personal data by weak supervision. DataFrame functions only; the driver sees vote patterns, never rows.

Candidate spans come from the four base expressions and from wider ones. Labelers (regular expressions,
checksums, gazetteers, context) vote 1, -1 or 0 on each candidate. Candidates are counted by kind and vote
pattern; expectation-maximisation over these few counts estimates how reliable each labeler is. Its posteriors then
train a final span classifier on the candidates' votes, lengths and forms (what characters they have, and whether a quote or an
equals sign stands before them), and candidates that it accepts become spans of the method. Of accepted ones that overlap, the one of the higher score stays, then the
longer one. Base spans always stay, and nothing is added that overlaps them.

Spans are found with extraction and splitting by the same expression: the lengths of what stands between
the matches give their places. Expressions start only at the beginning of a run or where the last match ended, and
their repetitions are possessive, so that long runs cost linear time and no stack.

Defined results: null and empty texts have no spans; repeated rows are searched each for itself; an empty table gives an
empty result and a model that accepts nothing; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: Kinds in the order in which spans of the same start are listed; the first four are base kinds.
KINDS = ("email", "ip", "card", "phone", "local_phone", "ssn", "iban", "secret", "person")
BASE = KINDS[:4]

_MAIL = "[A-Za-z0-9._%+-]"
_NAME = "[A-ZÀ-Ý][a-zà-ÿ]{1,20}"
TITLES = "Mrs|Mr|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señora|Señor"
# Frequent given and family names, cities, and banks, by which the gazetteers know persons and accounts.
GIVEN = (
    "James|Mary|John|Patricia|Robert|Jennifer|Michael|Linda|William|Elizabeth|David|Barbara|Richard|Susan|Joseph|Jessica|Thomas|Sarah|Charles|Karen|Daniel|Emma|Laura|Anna|Peter|Paul|Hans|Klaus|Sabine|"
    "Jean|Pierre|Marie|Jacques|Sophie|Claire|Antoine|Jürgen|Wolfgang|Ursula|Heike|José|Juan|Carlos|Luis|Carmen|Pilar|María|Antonio|Francisco|Miguel|Isabel|Julia|Martin|Stefan|Andreas|Alice|Nicolas|Elena|Lucía|Pablo"
)
FAMILY = (
    "Smith|Johnson|Williams|Brown|Jones|Miller|Davis|Wilson|Anderson|Taylor|Moore|Jackson|White|Harris|Clark|Lewis|Walker|Hall|Young|King|Müller|Schmidt|Schneider|Fischer|Weber|Meyer|Wagner|Becker|Schulz|Hoffmann|"
    "Martin|Bernard|Dubois|Durand|Moreau|Laurent|Lefebvre|Leroy|Roux|Fournier|García|Fernández|González|Rodríguez|López|Martínez|Sánchez|Pérez|Gómez|Ruiz|Hernández|Jiménez|Díaz|Moreno|Álvarez|Keller|Bauer|Richter|Klein|Wolf"
)
CITIES = "London|Paris|Berlin|Madrid|New York|Boston|Chicago|Munich|Hamburg|Lyon|Marseille|Barcelona|Sevilla|San Francisco|Los Angeles|Vienna|Zurich|Geneva|Brussels|Amsterdam"
BANKS = "Bank|Banque|Banco|Sparkasse|Volksbank|Santander|Barclays|Postbank|Caixa"
EXPRESSIONS = {
    "email": rf"(?:\G|(?<!{_MAIL})){_MAIL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # runs of digits with blanks or hyphens between; where two stand together the base expression ends, see _numbers
    "card": r"(?:\G|(?<![0-9]))[0-9][0-9\x20-]*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "local_phone": r"(?<![0-9+])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    # any long run; the labelers tell keys from long words, names of files and digests
    "secret": r"(?:\G|(?<![A-Za-z0-9_-]))[A-Za-z0-9_-]{20,}+",
    "person": rf"(?<![A-Za-zÀ-ÿ])(?:(?:{TITLES})\.?\x20{_NAME}(?:\x20{_NAME})?|{_NAME}\x20{_NAME}(?:\x20{_NAME})?)(?![A-Za-zÀ-ÿ])",
}
#: A text without a match of this has no candidate of the kind; cheaper than the expression itself.
GATES = {
    "email": r"@[A-Za-z0-9-]",
    "ip": r"[0-9]\.[0-9]",
    "card": r"[0-9][0-9\x20-]{10,}[0-9]",
    "phone": r"\+[0-9]",
    "local_phone": r"[0-9]\)?[\x20.-][0-9]{3}",
    "ssn": r"[0-9]-[0-9]{2}-[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}",
    "secret": r"[A-Za-z0-9_-]{20}",
    "person": rf"{_NAME}\x20[A-ZÀ-Ý]|(?:{TITLES})\.\x20",
}

#: Gazetteers: endings of public host names, and words that come before or after personal data.
HOST_ENDINGS = "com|org|net|edu|gov|io|de|fr|es|uk|eu|info|biz|co|us|ch|at|it|nl"
CONTEXT = {
    "email": "mail|contact|write|reach|courriel|correo|schreib",
    "ip": "ip|host|server|address|adresse|login|from",
    "card": "card|visa|master|credit|payment|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|ruf|appel|llam",
    "local_phone": "phone|call|tel|mobile|fax|ruf|appel|llam",
    "ssn": "ssn|social|security|tax|insurance",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "secret": "key|token|secret|password|passwd|credential|auth|bearer",
    "person": "name|dear|contact|by|signed|from|von|par|por",
}
#: Beginnings of keys that their makers give, and words before digests that are no secrets.
KEYS = "AKIA|gh[pousr]_|sk-|xox[abp]-|AIza"
DIGESTS = "commit|sha|md5|checksum|digest|revision|hash|uuid|build"
AGAINST = "version|v\\.|isbn|issn|order|invoice|page|section|figure|table|build|release|item|serial"

LABELERS = ("shape", "checksum", "gazetteer", "context", "against", "edge")
LEFT, RIGHT = 32, 12
CHUNK = 256
ROUNDS = 50
ACCEPT = 0.5
#: Votes that a candidate of a kind without a base rule needs beyond those against it, before reliabilities are known.
CAUTION = 2.5


def _starts(lengths: Column) -> Column:
    """Start of each match from an array of (gap, own) lengths, in chunks so that long arrays cost little."""
    step = F.lit(CHUNK)
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / step).cast("int")), lambda c: F.slice(lengths, c * step + 1, step))
    total = lambda ch: F.aggregate(ch, F.lit(0), lambda a, x: a + x["gap"] + x["own"])
    bases = F.aggregate(F.transform(chunks, total), F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    none = F.array().cast("array<int>")

    def inside(ch, base):
        return F.aggregate(
            ch,
            F.struct(F.coalesce(base, F.lit(0)).alias("at"), none.alias("out")),
            lambda a, x: F.struct((a["at"] + x["gap"] + x["own"]).alias("at"), F.concat(a["out"], F.array(a["at"] + x["gap"])).alias("out")),
            lambda a: a["out"],
        )

    return F.flatten(F.zip_with(chunks, F.slice(bases, 1, F.size(chunks)), inside))


_SPAN = "array<struct<start:int,value:string>>"


def _matches(df: DataFrame, kind: str) -> DataFrame:
    """Adds the array ``m_<kind>`` of (start, value) of the expression's matches in ``text``."""
    expression, found, cut = F.lit(EXPRESSIONS[kind]), f"_f_{kind}", f"_c_{kind}"
    has = F.col("text").rlike(GATES[kind])
    df = df.withColumn(found, F.when(has, F.regexp_extract_all("text", expression, F.lit(0))))
    df = df.withColumn(cut, F.when(F.size(found) > 0, F.split("text", EXPRESSIONS[kind], -1)))
    lengths = F.zip_with(F.slice(cut, 1, F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("own")))
    df = df.withColumn(f"_l_{kind}", F.when(F.size(found) > 0, lengths))
    starts = F.when(F.size(f"_l_{kind}") > 0, _starts(F.col(f"_l_{kind}")))
    spans = F.zip_with(starts, found, lambda s, m: F.struct(s.alias("start"), m.alias("value")))
    df = df.withColumn(f"m_{kind}", F.coalesce(spans, F.array().cast(_SPAN)))
    if kind == "card":
        df = df.withColumn("m_card", _numbers(F.col("m_card")))
    return df.drop(found, cut, f"_l_{kind}")


def _numbers(runs: Column) -> Column:
    """Runs of digits, blanks and hyphens cut where two of the latter meet: the matches of ``[0-9]([ -]?[0-9])+``."""

    def parts(run):
        pieces = F.split(run["value"], r"[\x20-]{2,}", -1)
        gaps = F.regexp_extract_all(run["value"], F.lit(r"[\x20-]{2,}"), F.lit(0))
        lengths = F.zip_with(pieces, gaps, lambda p, g: F.struct(F.lit(0).alias("gap"), (F.length(p) + F.coalesce(F.length(g), F.lit(0))).alias("own")))
        cut = F.zip_with(_starts(lengths), pieces, lambda s, p: F.struct((run["start"] + s).alias("start"), F.regexp_replace(p, r"[\x20-]$", "").alias("value")))
        return F.when(F.length(run["value"]) >= 12, cut).otherwise(F.array().cast(_SPAN))

    return F.filter(F.flatten(F.transform(runs, parts)), lambda s: F.length(s["value"]) >= 12)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)
    figures = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.substring(digits, i, F.lit(1)).cast("int").alias("d"), ((n - i) % 2).alias("odd")))
    total = F.aggregate(figures, F.lit(0), lambda a, x: a + F.when(x["odd"] == 1, F.when(x["d"] > 4, x["d"] * 2 - 9).otherwise(x["d"] * 2)).otherwise(x["d"]))
    return (n > 0) & (total % 10 == 0)


def _small_octets(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda x: F.length(F.regexp_replace(x, "^0+", "")).between(0, 3) & (F.coalesce(F.regexp_replace(x, "^0+(?=.)", "").try_cast("int"), F.lit(999)) <= 255))


def passes(kind: str, value: Column) -> Column:
    """The base rule on a match."""
    if kind == "ip":
        return _small_octets(value)
    if kind == "card":
        digits = _digits(value)
        return F.length(digits).between(12, 19) & F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _vote(positive: Column, negative: Column) -> Column:
    return F.when(positive, 1).when(negative, -1).otherwise(0)


def _checksum(kind: str, value: Column) -> Column:
    if kind == "iban":
        compact = F.regexp_replace(value, " ", "")
        turned = F.concat(F.substring(compact, 5, 64), F.substring(compact, 1, 4))
        letters = F.transform(F.split(turned, ""), lambda x: F.when(x.rlike("[A-Z]"), (F.ascii(x) - 55).cast("string")).otherwise(x))
        mod = F.aggregate(F.split(F.array_join(letters, ""), ""), F.lit(0), lambda a, x: (a * 10 + F.coalesce(x.try_cast("int"), F.lit(0))) % 97)
        return _vote(mod == 1, mod != 1)
    if kind == "ssn":
        bad = value.rlike("^(?:000|666|9)|-00-|-0000$")
        return _vote(~bad, bad)
    if kind in ("card", "ip", "phone"):
        ok = passes(kind, value)
        return _vote(ok, ~ok)
    if kind == "secret":  # as many characters as a key or a digest in hexadecimal has
        return _vote(value.rlike("^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32})$"), F.lit(False))
    if kind == "person":
        both = value.rlike(rf"^(?:{TITLES})\.?\x20|(?:^|\x20)(?:{GIVEN})\x20(?:{_NAME}\x20)?(?:{FAMILY})$")
        return _vote(both, F.lit(False))
    return F.lit(0)


def _gazetteer(kind: str, value: Column) -> Column:
    if kind == "email":
        known = value.rlike(rf"(?i)\.(?:{HOST_ENDINGS})$")
        return _vote(known, ~known)
    if kind == "card":
        brand = _digits(value).rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)")
        return _vote(brand, ~brand)
    if kind == "ip":
        odd = value.rlike(r"^(?:0|127|255)\.|\.0\.0$")
        return _vote(~odd, odd)
    if kind in ("phone", "local_phone"):
        odd = _digits(value).rlike("^0{3,}|([0-9])\\1{6,}")
        return _vote(~odd, odd)
    if kind == "ssn":
        return _vote(F.lit(False), value.rlike("^(?:078-05-1120|219-09-9999|123-45-6789)$"))  # numbers that were printed as examples
    if kind == "iban":
        country = value.rlike("^(?:AD|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IS|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SE|SI|SK|SM)")
        return _vote(country, ~country)
    if kind == "secret":
        return _vote(value.rlike(f"^(?:{KEYS})"), ~value.rlike("[0-9]") | value.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"))  # an account is no key
    if kind == "person":
        known = value.rlike(rf"(?:^|\x20)(?:{GIVEN})\x20|\x20(?:{FAMILY})$")
        place = value.rlike(rf"(?:^|\x20)(?:{CITIES}|{BANKS})(?:\x20|$)")
        return _vote(known & ~place, place | (~known & ~value.rlike(rf"^(?:{TITLES})\.?\x20")))
    return F.lit(0)


def _shape(kind: str, value: Column) -> Column:
    if kind in BASE:
        return _vote(passes(kind, value), ~passes(kind, value))
    n = F.length(_digits(value))
    if kind == "local_phone":
        return _vote(n.between(9, 11), n < 8)
    if kind == "secret":
        mixed = (n >= 3) & value.rlike("[A-Za-z]") & (F.length(value) <= 128) & ~value.rlike("[a-z]{9}")
        return _vote(mixed, ~mixed)
    if kind == "person":
        titled = value.rlike(rf"^(?:{TITLES})\.?\x20")
        return _vote(titled, F.lit(False))
    return F.lit(1)


def _form(kind: str, value: Column, left: Column) -> Column:
    """Which characters a span has and what stands right before it, as bits; three, so that patterns stay few."""
    bits = (left.rlike(r"[\"'=:]\s*$"), value.rlike("[A-Z]"), value.rlike(r"^[0-9a-fA-F\x20-]+$"))
    return sum((F.when(b, 1 << i).otherwise(0) for i, b in enumerate(bits)), F.lit(0))


def _candidate(kind: str, text: Column, span: Column) -> Column:
    """A span with its votes and a shape bucket."""
    value, start = span["value"], span["start"]
    left = F.lower(F.substring(text, F.greatest(start - LEFT, F.lit(0)) + 1, F.least(start, F.lit(LEFT))))
    right = F.substring(text, start + F.length(value) + 1, F.lit(RIGHT))
    glued = left.rlike(r"[\p{L}\p{N}]$") | right.rlike(r"^[\p{L}\p{N}]")
    votes = (
        _shape(kind, value),
        _checksum(kind, value),
        _gazetteer(kind, value),
        _vote(left.rlike(rf"\b(?:{CONTEXT[kind]})"), F.lit(False)),
        _vote(F.lit(False), left.rlike(rf"\b(?:{DIGESTS if kind == 'secret' else AGAINST})\W*\w*\W*$")),
        _vote(~glued, glued),
    )
    return F.struct(
        F.lit(KINDS.index(kind)).alias("kind"),
        start.alias("start"),
        (start + F.length(value)).alias("end"),
        (passes(kind, value) if kind in BASE else F.lit(False)).alias("base"),
        F.array(*(v.cast("int") for v in votes)).alias("votes"),
        F.least(F.floor(F.length(value) / 4), F.lit(9)).cast("int").alias("long"),
        _form(kind, value, left).cast("int").alias("form"),
    )


_CANDIDATE = "array<struct<kind:int,start:int,end:int,base:boolean,votes:array<int>,long:int,form:int>>"


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, candidates): of every kind, with votes."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for kind in KINDS:
        df = _matches(df, kind)

    def judged(kind):
        return F.transform(f"m_{kind}", lambda s: _candidate(kind, F.col("text"), s)).cast(_CANDIDATE)

    found = [judged(k) for k in KINDS]
    any_ = sum((F.size(f"m_{k}") for k in KINDS[1:]), F.size("m_email")) > 0
    return df.select("doc_id", F.when(any_, F.concat(*found)).otherwise(F.array().cast(_CANDIDATE)).alias("candidates"))


#: kind, votes, length bucket, form, how many candidates
Pattern = tuple[int, tuple[int, ...], int, int, int]


def patterns(found: DataFrame) -> list[Pattern]:
    """At most kinds x 3^labelers x 10 lengths x 8 forms rows, whatever the input."""
    rows = found.select(F.explode("candidates").alias("c")).groupBy("c.kind", "c.votes", "c.long", "c.form").count().collect()
    return sorted((r["kind"], tuple(r["votes"]), r["long"], r["form"], r["count"]) for r in rows)


def reliabilities(seen: Sequence[Pattern]) -> tuple[dict[int, float], dict[tuple[int, int, int, int], float], list[float]]:
    """EM for two classes: (prior by kind, P(vote | class) by (kind, labeler, vote, class), posterior of each row).

    Starts from the majority of votes, by more than CAUTION where no base rule holds a kind; rates are smoothed by one pseudo-candidate a vote.
    """
    post = [1 / (1 + math.exp(-sum(v) + (CAUTION if kind >= len(BASE) else 0))) for kind, v, *_ in seen]
    prior: dict[int, float] = {}
    rate: dict[tuple[int, int, int, int], float] = {}
    for _ in range(ROUNDS):
        mass: dict[tuple[int, int], float] = {}
        hits: dict[tuple[int, int, int, int], float] = {}
        for (kind, votes, _, _, n), p in zip(seen, post, strict=True):
            for y, q in ((1, p), (0, 1 - p)):
                mass[kind, y] = mass.get((kind, y), 0) + n * q
                for i, v in enumerate(votes):
                    hits[kind, i, v, y] = hits.get((kind, i, v, y), 0) + n * q
        prior = {k: (mass[k, 1] + 1) / (mass[k, 1] + mass[k, 0] + 2) for k, y in mass if y}
        # a vote for is at least as likely of a true span as a vote against: classes keep their sense
        rate = {}
        for kind in prior:
            for i in range(len(LABELERS)):
                for y in (0, 1):
                    lean = {1: 1.5 if y else 0.5, -1: 0.5 if y else 1.5, 0: 1.0}
                    for v in (-1, 0, 1):
                        rate[kind, i, v, y] = (hits.get((kind, i, v, y), 0) + lean[v]) / (mass[kind, y] + 3)
        post = []
        for kind, votes, *_ in seen:
            odds = math.log(prior[kind] / (1 - prior[kind])) + sum(math.log(rate[kind, i, v, 1] / rate[kind, i, v, 0]) for i, v in enumerate(votes))
            post.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
    return prior, rate, post


def _inputs(kind: int, votes: Sequence[int], long: int, form: int) -> list[str]:
    bits = [f"k{kind}f{i}" for i in range(3) if form >> i & 1]
    return ["bias", f"k{kind}", f"k{kind}l{long}", *bits, *(f"k{kind}v{i}{v}" for i, v in enumerate(votes) if v)]


def classifier(seen: Sequence[Pattern], post: Sequence[float], rounds: int = 300, rate: float = 0.5, l2: float = 0.01) -> dict[str, float]:
    """Logistic span classifier on kind, length, form and votes, trained on the posteriors weighted by log counts."""
    w: dict[str, float] = {}
    rows = [(_inputs(k, v, b, f), math.log1p(n), p) for (k, v, b, f, n), p in zip(seen, post, strict=True)]
    total = sum(n for _, n, _ in rows) or 1.0
    square: dict[str, float] = {}
    for _ in range(rounds):
        g: dict[str, float] = {}
        for x, n, p in rows:
            e = n * (1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w.get(i, 0.0) for i in x))))) - p) / total
            for i in x:
                g[i] = g.get(i, 0.0) + e
        for i, d in g.items():
            d += l2 * w.get(i, 0.0) / total
            square[i] = square.get(i, 0.0) + d * d
            w[i] = w.get(i, 0.0) - rate * d / (math.sqrt(square[i]) + 1e-9)
    return w


def accepted(seen: Sequence[Pattern], weights: dict[str, float]) -> dict[tuple[int, tuple[int, ...], int, int], float]:
    """Patterns that the classifier takes for personal data, with their scores."""
    score = lambda x: 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights.get(i, 0.0) for i in _inputs(*x))))))
    return {x[:4]: score(x[:4]) for x in seen if score(x[:4]) >= ACCEPT}


def _key(c: Column) -> Column:
    return F.concat_ws("/", c["kind"].cast("string"), F.array_join(F.transform(c["votes"], lambda v: v.cast("string")), ""), c["long"].cast("string"), c["form"].cast("string"))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(F.transform(spans, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda c: F.concat_ws(":", F.element_at(names, c["kind"] + 1), c["start"].cast("string"), c["end"].cast("string"))), ",")


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, base, added): base spans, and accepted spans that neither a base span nor an accepted one of a higher score overlaps."""
    found = table(candidates(docs))  # one pass over the texts: their spans are few
    seen = patterns(found)
    _, _, post = reliabilities(seen) if seen else ({}, {}, [])
    taken = accepted(seen, classifier(seen, post))
    scores = {"/".join((str(k), "".join(map(str, v)), str(b), str(f))): s for (k, v, b, f), s in taken.items() if KINDS[k] not in BASE}
    base = found.withColumn("base", F.filter("candidates", lambda c: c["base"]))
    if not scores:
        return base.select("doc_id", "base", F.array().cast(_CANDIDATE).alias("added"))
    known = F.create_map(*[F.lit(x) for pair in scores.items() for x in pair])
    meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    rank = lambda c: F.struct(F.try_element_at(known, _key(c)).alias("score"), (c["end"] - c["start"]).alias("size"), (-c["start"]).alias("at"), (-c["kind"]).alias("kind"))
    free = F.filter("candidates", lambda c: ~c["base"] & F.try_element_at(known, _key(c)).isNotNull() & ~F.exists("base", lambda b: meets(b, c)))
    rows = base.select("doc_id", "base", F.transform(free, lambda c: F.struct(c.alias("c"), rank(c).alias("r"))).alias("free"))
    best = F.filter("free", lambda x: ~F.exists("free", lambda y: meets(x["c"], y["c"]) & (y["r"] > x["r"])))
    return rows.select("doc_id", "base", F.transform(best, lambda x: x["c"]).alias("added"))


def report(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    n = lambda k: F.size(F.filter("base", lambda c: c["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(n, BASE), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "added")).alias("spans"))


def mask(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with every span of the last column replaced by its kind in angle brackets, last span first."""
    found = spans(docs.select(F.struct("doc_id", "text").alias("doc_id"), "text"))
    names = F.array(*(F.lit(f"<{k}>") for k in KINDS))
    ordered = F.reverse(F.array_sort(F.transform(F.concat("base", "added"), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind")))))
    done = F.aggregate(
        ordered,
        F.struct(F.col("doc_id.text").alias("t"), F.lit(2**31 - 1).alias("at")),
        lambda a, c: F.struct(
            F.when(c["end"] <= a["at"], F.concat(F.substring(a["t"], F.lit(1), c["start"]), F.element_at(names, c["kind"] + 1), F.substring(a["t"], c["end"] + 1, F.lit(2**31 - 1)))).otherwise(a["t"]).alias("t"),
            F.least(a["at"], c["start"]).alias("at"),
        ),
        lambda a: a["t"],
    )
    return found.select("doc_id.doc_id", F.when(F.col("doc_id.text").isNull(), None).otherwise(done).alias("text"))
