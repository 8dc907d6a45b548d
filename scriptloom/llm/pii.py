"""Personal data: labelers vote on candidate spans, EM weighs the votes, a classifier decides.

Everything is DataFrame functions. Fixed patterns give the base spans; wider patterns give further
candidates on the text with the base spans blanked. Six labelers (two of form, one gazetteer,
three of context) vote for or against every candidate, or abstain. Expectation-maximisation over
the counts of all vote vectors estimates each labeler's reliability for each kind; the
posteriors are the soft labels that a logistic classifier of the span's features is trained on.
The classifier decides which candidates join the base spans.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptloom.llm.common import cut, double_array, let

KINDS = ["email", "ip", "card", "phone"]
#: A candidate joins the base spans from this probability on.
THRESHOLD = 0.5
BEFORE, AFTER = 40, 4
#: Starts of spans are summed in blocks of so many, which keeps a text with a million of them cheap.
BLOCK = 128

# Possessive classes and the look-behind (or the end of the last match, \G) give the same matches
# as the plain patterns, in time linear in the text.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_DOT, _HEX = r"(?:\[\.\]|\(\.\))", "[0-9A-Fa-f]{1,4}"
WIDER = {
    "email": rf"(?i)(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++(?: ?[(\[{{]at[)\]}}] ?| at )[A-Za-z0-9-]++(?:(?: ?[(\[{{]dot[)\]}}] ?| dot )[A-Za-z0-9-]++)++",
    "ip": rf"(?<![0-9A-Za-z:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}}|[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}})(?![0-9A-Za-z:])",
    "card": r"(?<![0-9+])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?:\1[0-9]{1,3})??|3[47][0-9]{2}([ -])[0-9]{6}\2[0-9]{5})(?![0-9])",
    "phone": r"\+1[ .-]?\(?[2-9][0-9]{2}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
    r"|\+[2-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{1,4}\)?){2,5}(?![0-9]|\.[0-9])"
    r"|(?<![0-9+(.-])(?<![0-9][ ])(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9]|[.-][0-9])",
}
# Gazetteers and context words.
TOP_DOMAINS = "com net org edu gov mil int info biz io dev app co me eu de fr es it at ch be nl uk ie pt pl cz se no dk fi ru us ca mx br ar cl au nz jp cn kr in tr gr za test"
FILE_SUFFIXES = "png jpg jpeg gif svg pdf js css html py txt md zip gz json xml csv"
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|6011|6[45]|35|30|36|38"
CALLING_CODES = "1|7|2[07]|2[1-6][0-9]|3[0-469]|3[578][0-9]|4[013-9]|42[0-9]|5[1-8]|50[0-9]|59[0-9]|6[0-6]|67[0-9]|8[1246]|85[0-9]|9[0-58]|9[679][0-9]"
UNROUTED = r"(?:0|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."
NEAR_WORDS = {
    "email": "e-?mail|mail|contact|kontakt|correo|courriel|write to|reach|reply",
    "ip": "ip|address|addr|host|server|client|login|peer|adresse|dirección",
    "card": "card|visa|mastercard|amex|credit|debit|karte|kreditkarte|carte|tarjeta|payment",
    "phone": "tel|phone|call|mobile|cell|fax|whatsapp|telefon|handy|téléphone|teléfono|sms|dial",
}
FAR_WORDS = "version|release|section|chapter|order|invoice|isbn|issn|sku|part|serial|rfc|figure|table|page|build|commit|hash|sha256|md5|id|timestamp|offset"
LABELERS = ["form", "check", "gazetteer", "near_words", "far_words", "borders"]
FEATURES = ["plus", "bracket", "separated", "long", "varied", "assigned", *LABELERS]


# -- spans ------------------------------------------------------------------------------------


def _starts(sizes: Column) -> Column:
    """Sum of all earlier sizes, for each place: whole blocks first, then the places of each."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    blocks = lambda s: F.sequence(F.lit(0), (F.size(s) - 1).bitwiseAND(F.lit(-BLOCK)), F.lit(BLOCK))
    inside = lambda s, b, before: F.transform(F.slice(s, b + 1, F.lit(BLOCK)), lambda x, i: before + total(F.slice(s, b + 1, i)))

    def place(s: Column) -> Column:
        sums = F.transform(blocks(s), lambda b: total(F.slice(s, b + 1, F.lit(BLOCK))))
        return let(sums, lambda t: F.flatten(F.transform(blocks(s), lambda b, k: let(total(F.slice(t, F.lit(1), k)), lambda before: inside(s, b, before)))))

    return let(sizes, place)


SPAN = "array<struct<start: int, end: int, value: string, before: string, after: string>>"


def _cuts(text: Column, pattern: str) -> Column:
    """Matches ``h`` of a pattern and the pieces ``p`` around them; null without a match."""
    return F.when(text.rlike(pattern), F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("h"), F.split(text, pattern, -1).alias("p")))


def _spans(cuts: Column) -> Column:
    """Code point ranges of :func:`_cuts`, with the texts in them and around them."""
    h, p = cuts["h"], cuts["p"]
    sizes = F.transform(h, lambda x, i: F.length(x) + F.length(F.get(p, i)))

    def spans(starts: Column) -> Column:
        def span(x: Column, i: Column) -> Column:
            start = F.get(starts, i) + F.length(F.get(p, i))
            around = (F.right(F.get(p, i), F.lit(BEFORE)).alias("before"), F.left(F.get(p, i + 1), F.lit(AFTER)).alias("after"))
            return F.struct(start.alias("start"), (start + F.length(x)).alias("end"), x.alias("value"), *around)

        return F.transform(h, span)

    return let(_starts(sizes), spans)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    def passes(d: Column) -> Column:
        digit = lambda j: F.substring(d, j, F.lit(1)).cast("int")
        add = lambda s, j: s + F.when(j % 2 == 1, digit(j)).otherwise(2 * digit(j) - F.when(digit(j) > 4, 9).otherwise(0))
        return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0

    return let(F.reverse(_digits(value)), passes)


def _octets(value: Column) -> Column:
    return value.rlike(r"^0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]{0,2})(?:[^0-9]+0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]{0,2})){3}$")


def _n_digits(value: Column, least: int, most: int) -> Column:
    return F.length(_digits(value)).between(least, most)


def base_valid(kind: str, value: Column) -> Column:
    return {"email": lambda v: F.lit(True), "ip": _octets, "card": lambda v: F.when(_n_digits(v, 13, 19), _luhn(v)).otherwise(F.lit(False)), "phone": lambda v: _n_digits(v, 9, 15)}[kind](value)


def _wider_valid(kind: str, value: Column) -> Column:
    groups = F.size(F.filter(F.split(value, ":"), lambda x: x != ""))
    tests = {"ip": F.when(F.contains(value, F.lit(":")), (groups >= 4) & value.rlike("[0-9]")).otherwise(_octets(value)), "card": _n_digits(value, 13, 19), "phone": _n_digits(value, 9, 15)}
    return tests.get(kind, F.lit(True))


def _blanked(text: Column, cuts: Column, kind: str) -> Column:
    """The text with its base spans of a kind blanked, no character moved."""
    mark = lambda x: F.when(base_valid(kind, x), F.repeat(F.lit("\x01"), F.length(x))).otherwise(x)
    joined = F.array_join(F.transform(cuts["h"], lambda x, i: F.concat(F.get(cuts["p"], i), mark(x))), "")
    return F.when(cuts.isNull(), text).otherwise(F.concat(joined, F.element_at(cuts["p"], -1)))


# -- votes and features -----------------------------------------------------------------------


def _vote(yes: Column, no: Column) -> Column:
    """2 for, 1 against, 0 abstains."""
    return F.when(yes, 2).when(no, 1).otherwise(0)


def _votes(kind: str, s: Column) -> list[Column]:
    v, low = s["value"], F.lower(s["value"])
    never, before = F.lit(False), F.lower(s["before"])
    listed = lambda names: "|".join(names.split())
    domain = low.rlike(rf"(?:\.|dot[)\]}}]? ?)(?:{listed(TOP_DOMAINS)})$")
    form = {
        "email": low.rlike(r"^[a-z0-9][a-z0-9._%+-]*@(?:[a-z0-9-]+\.)+[a-z]{2,}$") | low.rlike(r"[(\[{]at[)\]}].*[(\[{]dot[)\]}]"),
        "ip": v.rlike(r"^(?:[1-9][0-9]{0,2}|0)(?:[^0-9]+(?:[1-9][0-9]{0,2}|0)){3}$") | v.rlike(r"^(?:[0-9A-Fa-f]{1,4}:){7}"),
        "card": v.rlike(r"^(?:[0-9]{13,16}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})$"),
        "phone": v.rlike(r"^(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}$"),
    }[kind]
    check = {
        "email": (F.length(v) <= 254) & ~F.contains(v, F.lit("..")) & (F.contains(v, F.lit("@")) | domain),  # a spelt-out address needs a known domain
        "ip": F.when(F.contains(v, F.lit(":")), F.lit(True)).otherwise(_octets(v)),
        "card": _luhn(v),
        "phone": _n_digits(v, 10, 13),
    }[kind]
    gazetteer = {
        "email": _vote(domain, low.rlike(rf"\.(?:{listed(FILE_SUFFIXES)})$") | ~F.contains(v, F.lit("@"))),
        "ip": _vote(~v.rlike(f"^{UNROUTED}"), v.rlike(f"^{UNROUTED}")),
        "card": _vote(v.rlike(f"^(?:{ISSUERS})"), F.lit(True)),
        "phone": _vote(v.rlike(rf"^\+(?:{CALLING_CODES})"), v.startswith("+")),
    }[kind]
    clear = s["before"].rlike(r"(?:^|[\s(<\"'\[{:=,;\x01])$") & s["after"].rlike(r"^(?:$|[\s)>\"'\]},;:!?\x01]|\.(?:$|\s))")
    return [
        _vote(form, ~form),
        _vote(check, ~check),
        gazetteer,
        _vote(before.rlike(rf"\b(?:{NEAR_WORDS[kind]})\b"), never),
        _vote(never, before.rlike(rf"\b(?:{FAR_WORDS})[\s.:#=№-]*$")),
        _vote(clear, ~clear),
    ]


def _weighed(kind: str, spans: Column, base: bool) -> Column:
    """Spans as ``start, end, base, votes, features``; votes in base 3, features as bits."""

    def each(s: Column) -> Column:
        v = s["value"]
        own = [
            F.contains(v, F.lit("+")),
            F.contains(v, F.lit("(")),
            v.rlike("[ .-]"),
            F.length(v) >= 16,
            F.size(F.array_distinct(F.split(v, ""))) >= 6,
            s["before"].rlike("[:=]\\s*$"),
        ]
        coded = F.array(*(x.cast("int") for x in _votes(kind, s)))

        def packed(votes: Column) -> Column:
            bits = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(own)), F.lit(0))
            bits = sum((F.when(votes[k] == 2, 1 << (len(own) + k)).otherwise(0) for k in range(len(LABELERS))), bits)
            code = sum((votes[k] * 3**k for k in range(len(LABELERS))), F.lit(0))
            return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(base).alias("base"), code.alias("votes"), bits.alias("features"))

        return let(coded, packed)

    return F.transform(spans, each)


CANDIDATE = "array<struct<start: int, end: int, base: boolean, votes: int, features: int>>"


def _of_kind(kind: str) -> Column:
    """Base spans of ``cuts`` and further candidates of ``text``."""
    text, base, none = F.col("text"), F.col("cuts"), F.array().cast(CANDIDATE)
    spans = lambda cuts, valid: F.filter(_spans(cuts), lambda s: valid(kind, s["value"]))
    weighed = lambda cuts, valid, known: F.when(cuts.isNotNull(), _weighed(kind, spans(cuts, valid), known)).otherwise(none)
    further = let(_blanked(text, base, kind), lambda t: let(_cuts(t, WIDER[kind]), lambda c: weighed(c, _wider_valid, False)))
    # a text without a match of the wider pattern has no further candidates
    return F.concat(let(base, lambda c: weighed(c, base_valid, True)), F.when(text.rlike(WIDER[kind]), further).otherwise(none))


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id`` and, for each kind, its base spans and further candidates with votes and features."""
    found = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    for kind in KINDS:
        found = found.withColumn("cuts", _cuts(F.col("text"), BASE[kind])).withColumn(kind, _of_kind(kind)).drop("cuts")
    return found.drop("text")


# -- model ------------------------------------------------------------------------------------

#: Votes expected of a labeler before data are seen: for, against and abstention, of right and of wrong candidates.
EXPECTED = {"check": ([0.90, 0.02, 0.08], [0.10, 0.85, 0.05]), None: ([0.60, 0.10, 0.30], [0.20, 0.50, 0.30])}
#: Weight of that expectation, in candidates; EM rounds; ridge and Newton steps of the classifier.
PRIOR_ROWS, ROUNDS, RIDGE, STEPS = 30.0, 40, 1.0, 25


@dataclass
class Model:
    """Per kind: reliability of each labeler (rows: right and wrong candidates; columns: abstains,
    against, for), share of right candidates, weights of the classifier (last: its intercept)."""

    reliability: dict[str, np.ndarray] = field(default_factory=dict)
    share: dict[str, float] = field(default_factory=dict)
    weights: dict[str, np.ndarray] = field(default_factory=dict)


def _expected() -> np.ndarray:
    rows = [EXPECTED.get(name, EXPECTED[None]) for name in LABELERS]
    return np.array([[[p[2], p[1], p[0]] for p in pair] for pair in rows])


def em(votes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Reliabilities, share of right candidates and each vote vector's posterior."""
    prior = _expected()
    table, share = prior.copy(), 0.5
    hits = np.stack([votes == v for v in range(3)], axis=-1).astype(float)
    for _ in range(ROUNDS):
        logs = np.einsum("nlv,lyv->ny", hits, np.log(table)) + np.log([share, 1 - share])
        right = 1 / (1 + np.exp(np.clip(logs[:, 1] - logs[:, 0], -50, 50)))
        mass = np.stack([right, 1 - right], axis=1) * counts[:, None]
        table = np.einsum("nlv,ny->lyv", hits, mass) + PRIOR_ROWS * prior
        table /= table.sum(axis=2, keepdims=True)
        share = float((mass[:, 0].sum() + PRIOR_ROWS / 2) / (counts.sum() + PRIOR_ROWS))
    return table, share, right


def logistic(x: np.ndarray, target: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Ridge logistic regression on soft labels by damped Newton steps; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, keep = np.zeros(x.shape[1]), np.diag([RIDGE] * (x.shape[1] - 1) + [1e-3])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (counts * p * (1 - p))[:, None]).T @ x + keep, x.T @ (counts * (target - p)) - keep @ w)
        w = w + step / max(1.0, float(np.abs(step).max()) / 2)
    return w


def _examples() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Votes that every table's classifier also sees, so that kinds without wrong candidates are bounded:
    each labeler alone for or against, weighted as :data:`EXPECTED` says."""
    size = len(LABELERS)
    votes = [[2 * bool(b >> k & 1) + (not b >> k & 1) for k in range(size)] for b in range(1 << size)]
    prior = _expected()
    right = np.array([np.prod([prior[k, 0, v] for k, v in enumerate(row)]) for row in votes])
    wrong = np.array([np.prod([prior[k, 1, v] for k, v in enumerate(row)]) for row in votes])
    weight = (right + wrong) / (right + wrong).sum() * PRIOR_ROWS
    return np.array(votes), right / (right + wrong), weight


def fit(found: DataFrame) -> Model:
    """Reliabilities and classifiers from all candidates, counted by kind, votes and features.

    The driver gets at most one row per kind, vote vector and feature set (their number is fixed
    by the labelers and features, whatever the size of the table).
    """
    each = F.explode(F.concat(*(F.transform(k, lambda s: F.struct(F.lit(i).alias("kind"), s["votes"].alias("votes"), s["features"].alias("features"))) for i, k in enumerate(KINDS))))
    rows = found.select(each.alias("c")).groupBy("c.kind", "c.votes", "c.features").count().orderBy("kind", "votes", "features").collect()
    model, (tried, belief, weight) = Model(), _examples()
    own = len(FEATURES) - len(LABELERS)
    assumed = np.hstack([np.zeros((len(tried), own)), (tried == 2).astype(float)])
    for k, kind in enumerate(KINDS):
        mine = [r for r in rows if r.kind == k]
        counts = np.array([float(r["count"]) for r in mine])
        votes = np.array([[r.votes // 3**j % 3 for j in range(len(LABELERS))] for r in mine], dtype=int).reshape(-1, len(LABELERS))
        bits = np.array([[r.features >> j & 1 for j in range(len(FEATURES))] for r in mine], dtype=float).reshape(-1, len(FEATURES))
        model.reliability[kind], model.share[kind], right = em(votes, counts)
        model.weights[kind] = logistic(np.vstack([bits, assumed]), np.concatenate([right, belief]), np.concatenate([counts, weight]))
    return model


def _probability(kind: str, features: Column, model: Model) -> Column:
    *weights, bias = model.weights[kind].tolist()
    table = double_array([round(w, 9) for w in weights])
    add = lambda total, k: total + F.get(table, k) * F.shiftright(features, 0).bitwiseAND(F.call_function("shiftleft", F.lit(1), k)).cast("boolean").cast("int")
    logit = F.aggregate(F.sequence(F.lit(0), F.lit(len(weights) - 1)), F.lit(round(bias, 9)), add)
    return 1 / (1 + F.exp(-logit))


# -- operator ---------------------------------------------------------------------------------


def detect(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id`` and one array per kind of ``start, end, base, probability``, by start.

    Null texts are empty and have no spans; repeated rows come back as often; null ids stay; an
    empty table gives an empty result; extra columns are ignored. Base spans stay whatever their
    probability; a probability equal to the threshold is enough for the others.
    """
    found = cut(candidates(docs))
    model = fit(found)

    def kept(kind: str) -> Column:
        judged = F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"), _probability(kind, s["features"], model).alias("probability")))
        return F.array_sort(F.filter(judged, lambda s: s["base"] | (s["probability"] >= threshold)))

    return found.select("doc_id", *(kept(k).alias(k) for k in KINDS))


def spans(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per span: ``doc_id, kind, start, end, base, probability``; see :func:`detect`."""
    found = detect(docs, threshold)
    each = F.concat(*(F.transform(k, lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"), s["probability"].alias("probability"))) for k in KINDS))
    return found.select("doc_id", F.explode(each).alias("s")).select("doc_id", "s.*")


def digest(found: DataFrame) -> DataFrame:
    """Counts and hash of the base spans and the list of all spans, from :func:`detect`."""
    base = lambda k: F.filter(k, lambda s: s["base"])
    told = lambda k, of: F.transform(of, lambda s: F.concat_ws(":", F.lit(k), s["start"].cast("string"), s["end"].cast("string")))
    return found.select(
        "doc_id",
        *(F.size(base(F.col(k))).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.array_join(F.concat(*(told(k, base(F.col(k))) for k in KINDS)), ","), 256).alias("base_sha256"),
        F.array_join(F.concat(*(told(k, F.col(k)) for k in KINDS)), ",").alias("spans"),
    )
