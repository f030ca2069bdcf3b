"""Personal data: exact patterns, and spans that weakly supervised labelers vote for.

Everything runs on built-in expressions. The base kinds are patterns with a check each. Further spans come from looser
shapes: regex, gazetteer and context labelers vote on each (1 for, -1 against, 0 abstains), expectation maximisation
over the counts of vote patterns estimates how each labeler votes on true and on false spans, and a logistic classifier
on votes, kinds and the span's own features is trained on the resulting probabilities. Labelers of context see the 32
characters before a span and the 2 after it; cues further away do not count. Only counts of patterns reach the driver:
at most 3 ** 7 vote patterns for each kind, and MODEL_PATTERNS patterns of votes and features."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivec.llm.common import fresh, let, running_sums, text_of
from lexivec.sources.folders import materialize

#: Base patterns, written so that a failing attempt is not repeated inside the same run of characters: a match starts
#: where a run starts or where the last match ended, and what is matched is not given back.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# Registered IBAN countries with the length of their numbers.
IBAN_LENGTHS = dict(
    x.split(":")
    for x in "AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BR:29 BY:28 CH:21 CR:22 CY:28 CZ:24 DE:22 DK:18 DO:28 EE:20 ES:24 FI:18 FO:18 FR:27 GB:22 GE:22 GI:23 GL:18 GR:27 GT:28 HR:21 HU:28 "
    "IE:22 IL:23 IS:26 IT:27 JO:30 KW:30 KZ:20 LB:28 LI:21 LT:20 LU:20 LV:21 MC:27 MD:24 ME:22 MK:19 MR:27 MT:31 MU:30 NL:18 NO:15 PK:24 PL:28 PS:29 PT:25 QA:29 RO:24 RS:22 SA:24 SE:24 SI:19 SK:24 SM:27 "
    "TN:24 TR:26 UA:29 VA:22 VG:24 XK:20".split()
)
# Gazetteers, which only vote: first names and titles, kinds of streets, months, prefixes of issued keys, values that
# stand in examples, and capitalised words that are no one's name or no street before a number.
FIRST_NAMES = (
    "James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Daniel Nancy Matthew Lisa Anthony Margaret Mark Sandra "
    "Emily Laura Kevin Brian Anna Peter Hans Klaus Jürgen Wolfgang Ursula Monika Petra Sabine Andreas Stefan Jean Pierre Marie Michel Nathalie Isabelle Philippe François Catherine José Antonio Manuel "
    "Francisco María Carmen Ana Lucía Javier Carlos Isabel"
).split()
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Monsieur Madame Señor Señora".split()
STREETS = "Street St Avenue Ave Road Rd Lane Boulevard Blvd Drive Court Square Terrace Place Close Crescent".split()
# Months in English, German, French and Spanish.
MONTHS = (
    "january february march april may june july august september october november december januar februar märz mai juni juli oktober dezember "
    "janvier février mars avril juin juillet août septembre octobre novembre décembre enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre "
    "jan feb mar apr jun jul aug sep sept oct nov dec"
).split()
NO_NAMES = "The This That And Of For In On At To With Der Die Das Und Mit Le La Les Des Et El Los Las Un Una License Public General Free Software University Institute Company Inc Ltd GmbH Street Road Avenue City North South East West New Open Chapter".split()
NO_STREETS = "Section Chapter Version Figure Table Page Part Article Step Level Room Window Type Model Phase Group Day Week".split()
#: Words in lower case that stand inside names.
PARTICLES = "van von der den de del della di da la le el al bin ibn dos".split()
KEY_PREFIXES = "AKIA ASIA AIza ghp_ gho_ github_pat_ glpat- sk_live_ sk- xoxb- xoxp- eyJ".split()
EXAMPLES = {"ssn": "078-05-1120 219-09-9999 123-45-6789", "secret": "example sample dummy changeme placeholder 0123456789 abcdef0123 deadbeef xxxxxxxx yourkey your_", "iban": "GB82WEST12345698765432"}

_WORD = r"\p{Lu}[\p{Ll}]++"
_NAME = r"(?:\p{Lu}['’])?\p{Lu}[\p{Ll}]++(?:\p{Lu}[\p{Ll}]++)?"
_NEXT = rf"(?: \p{{Lu}}\.)?(?:-| (?:(?:{'|'.join(PARTICLES)}) ){{0,2}}){_NAME}"
#: Looser shapes that labelers vote on: figures, numbers beside capitalised words, and runs of two to four capitalised words. No
#: list of names, streets or months makes a candidate.
SHAPES = {
    "secret": r"(?<![A-Za-z0-9+/_=.-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{16,}+",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}([ -])[0-9]{2}\1[0-9]{4}(?![0-9A-Za-z-])",
    "national_phone": r"(?<![0-9A-Za-z+)-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
    "iban": rf"(?=[A-Z]{{2}}[0-9]{{2}})(?<![A-Za-z0-9])(?:{'|'.join(IBAN_LENGTHS)})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: [A-Z0-9]{{1,3}}|[A-Z0-9]{{1,3}})?(?![A-Za-z0-9])",
    "date": r"(?<![0-9\p{L}./-])(?:(?=[0-9])(?:[0-9]{1,2}([./-])[0-9]{1,2}\1[0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}(?:\.|st|nd|rd|th)? (?:de )?\p{L}{3,10}\.? (?:de )?[0-9]{4})|(?=\p{Lu})\p{Lu}\p{Ll}{2,9}\.? [0-9]{1,2},? [0-9]{4})(?![0-9A-Za-z/-])",
    "address": rf"(?=[0-9])(?<![0-9A-Za-z.,/-])[0-9]{{1,5}}[A-Za-z]? {_WORD}(?: {_WORD}){{0,3}}(?![\p{{L}}0-9]|,? [0-9]{{4}}(?![0-9]))|(?=\p{{Lu}})(?<![\p{{L}}])(?:{_WORD}[ -]){{0,2}}{_WORD},? [0-9]{{1,4}}[a-z]?(?![\p{{L}}0-9]|[.:/-]?[0-9]|,? [0-9]{{4}}(?![0-9]))|(?=[RrAaCcPp])(?<![\p{{L}}0-9])(?:[Rr]ue|[Aa]venue|[Cc]alle|[Pp]laza) (?:de |du |de la |des |del )?{_WORD}(?: {_WORD})?(?:,? [0-9]{{1,4}})?(?![\p{{L}}0-9])",
    "name": rf"(?=\p{{Lu}})(?<![\p{{L}}'’])(?:\p{{Lu}}\p{{Ll}}{{1,3}}\. {_NAME}(?:{_NEXT}){{0,3}}|{_NAME}(?:{_NEXT}){{1,3}})(?!\p{{L}})",
}
KINDS = (*BASE, *SHAPES)

#: Words before a span that speak for its kind.
CUES = {
    "secret": r"(?:token|secret|passw|pwd|api.?key|access.?key|auth|bearer|credential|private)",
    "ssn": r"(?:ssn|social|security|tax|taxpayer|sozial)",
    "national_phone": r"(?:phone|tel|call|mobile|cell|fax|dial|ruf|handy|appel)",
    "iban": r"(?:iban|account|konto|bank|compte|cuenta|transfer)",
    "date": r"(?:born|birth|dob|geboren|geburt|née? le|naissance|nacid|nacimiento)",
    "address": r"(?:address|lives? (?:at|in)|resid|home|adresse|anschrift|wohn|habite|domicil|vive en|direcci)",
    "name": r"(?:name|signed|dear|contact|regards|sincerely|author|patient|customer|employee|caller|colleague|friend|i am |i'm |mr\.? |mrs\.? |heiß|liebe|appelle|llamo|atentamente|kunde|client)",
}
#: Words before a span that speak against personal data of any kind.
COUNTER_CUES = r"(?:commit|version|isbn|issn|doi|sha1|sha256|md5|checksum|revision|order|invoice|serial|part|http|www|page|model|published|released|updated|since|until|saint|church)"

#: Kinds whose shapes are so loose that a context without any cue or label speaks against them, and an end does not speak for them.
LOOSE = ("date", "address", "name")
#: Labelers of which one must vote for a loose shape: without a listed value, a cue or a label it is held to be false.
SUPPORT = ("gazetteer", "cue", "assigned")
LABELERS = ("form", "gazetteer", "cue", "counter", "assigned", "make_up", "closed")
#: The most patterns of votes and features that the classifier is trained on, the frequent ones first.
MODEL_PATTERNS = 20_000
#: Values of each feature of a span: length, part of distinct characters, classes of characters, character before.
FEATURES = (5, 4, 8, 4)


def _luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:
        d = digits.substr(F.length(digits) - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


CHECKS = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$"),
    "card": lambda m: let(F.translate(m, " -", ""), lambda d: F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(False)),
    "phone": lambda m: F.length(F.translate(m, "+ ().-", "")).between(10, 15),
}


def _matches(text: Column, patterns: dict[str, str], gates: dict[str, Column]) -> Column:
    """array<struct<start, rank, end, match, before, after>>: every match of each pattern (where its kind's gate holds)
    with its place in code points and its surroundings."""
    none = F.array().cast("array<string>")

    def cut(kind: str, pattern: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        found = F.when(gates[kind], found).otherwise(none) if kind in gates else found
        return let(found, lambda m: F.struct(F.lit(KINDS.index(kind)).alias("rank"), m.alias("m"), F.when(F.size(m) > 0, F.split(text, pattern, -1)).otherwise(none).alias("g")))

    def placed(c: Column) -> Column:
        m, g = c["m"], c["g"]
        lengths = F.zip_with(m, F.slice(g, F.lit(1), F.size(m)), lambda x, y: (F.length(x) + F.length(y)).cast("bigint"))
        return let(
            running_sums(lengths),
            lambda ends: F.transform(
                m,
                lambda x, i: F.struct(
                    (F.get(ends, i + 1) - F.length(x)).alias("start"), c["rank"].alias("rank"), F.get(ends, i + 1).alias("end"), x.alias("match"),
                    F.lower(F.right(F.get(g, i), F.lit(32))).alias("before"), F.left(F.get(g, i + 1), F.lit(2)).alias("after"),
                ),
            ),
        )

    cuts = F.array(*[cut(k, p) for k, p in patterns.items()])
    return F.flatten(F.transform(F.filter(cuts, lambda c: F.size(c["m"]) > 0), placed))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0).cast("int")


def _iban_holds(m: Column) -> Column:
    """Whether an IBAN has its country's length and the remainder 1."""
    bare = F.translate(m, " ", "")
    turned = F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4)))
    lengths = F.create_map(*[F.lit(x) for kv in IBAN_LENGTHS.items() for x in (kv[0], int(kv[1]))])

    def step(a: Column, c: Column) -> Column:
        v = F.when(c <= "9", F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (F.when(v > 9, a * 100).otherwise(a * 10) + v) % 97

    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c)))
    return (F.element_at(lengths, F.substr(bare, F.lit(1), F.lit(2))) == F.length(bare)) & (rest == 1)


def _one_of(m: Column, words: str | list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in (words.split() if isinstance(words, str) else words)]), lambda w: F.contains(m, w))


def _votes(x: Column) -> Column:
    """The labelers' votes on a loose match, in the order of LABELERS."""
    m, before, after, rank = x["match"], x["before"], x["after"], x["rank"]
    digits, letters = F.length(F.regexp_replace(m, "[^0-9]", "")), F.length(F.regexp_replace(m, "[^A-Za-z]", ""))
    yes, no = F.lit(True), F.lit(False)
    bad_ssn = m.rlike(r"^(?:000|666|9)|-00-|-0000$")
    year = F.regexp_extract(m, r"(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)", 1)
    month = F.regexp_extract(F.lower(m), r"(\p{L}{3,10})\.? (?:de )?[0-9]", 1)
    words = (month != "") & (F.regexp_extract(m, r"(?:^|[^0-9])(?:0?[1-9]|[12][0-9]|3[01])(?:[^0-9]|$)", 0) != "")
    real_date = words | m.rlike(r"^(?:0?[1-9]|[12][0-9]|3[01])[./-](?:0?[1-9]|[12][0-9]|3[01])[./-]|-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])$")
    headline = m.rlike(r"(?:^|[ -])(\p{L}+)[ -]\1(?:[ -]|$)") | after.rlike(r"^[ -]\p{Lu}")
    form = {
        "secret": (m.rlike(r"^(?:[0-9a-f]{24,}|[0-9A-F]{24,}|(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9]).{20,})$"), m.rlike(r"^[0-9]+$|[-_=/+]{3}")),
        "ssn": (~bad_ssn, bad_ssn), "national_phone": (m.rlike(r"^\(?[2-9][0-9]{2}"), m.rlike(r"^\(?[01]")),
        "date": (real_date & (year != ""), ~real_date | (year == "")), "address": (m.rlike("^[0-9]|[0-9][a-z]?$"), ~m.rlike("[0-9]")), "name": (m.rlike(r" \p{Lu}\. ") & ~headline, headline),
    }
    gazetteer = {
        "secret": (_one_of(m, KEY_PREFIXES), _one_of(F.lower(m), EXAMPLES["secret"])), "ssn": (no, _one_of(m, EXAMPLES["ssn"])),
        "national_phone": (no, m.rlike(r"555[ .-]01[0-9]{2}$")), "iban": (no, F.translate(m, " ", "") == EXAMPLES["iban"]),
        "date": (year.between("1920", "2012") & ((month == "") | month.isin(MONTHS)), (year > "2020") | ((month != "") & ~month.isin(MONTHS))),
        "address": (m.rlike(rf" (?:{'|'.join(STREETS)})$|(?:straße|strasse|gasse|weg|platz|allee) |^(?:[Rr]ue|[Cc]alle|[Aa]venue|[Pp]laza) "), m.rlike(rf"^(?:{'|'.join(NO_STREETS)}) ") | F.regexp_extract(F.lower(m), r"(\p{L}+),? ?[0-9]*$", 1).isin(MONTHS)),
        "name": (m.rlike(rf"(?:^| )(?:{'|'.join(FIRST_NAMES)}) |^(?:{'|'.join(TITLES)})\.? "), m.rlike(rf"(?:^|[ -])(?:{'|'.join(NO_NAMES)})(?:[ -]|$)")),
    }
    make_up = {
        "secret": ((digits >= 4) & (letters >= 2), (digits < 4) | (letters < 2)), "ssn": (yes, no), "national_phone": (yes, no), "iban": (digits >= 10, digits < 10),
        "address": (no, before.rlike(r"[.!?]\s*$") & m.rlike("^[0-9]+ ")), "name": (no, before.rlike(r"(?:[0-9]|[.!?]['\")]*)\s*$|^$")),
    }
    holds = _iban_holds(m)
    form["iban"] = (holds, ~holds)

    def by_kind(pairs: dict[str, tuple[Column, Column]]) -> Column:
        out = F.lit(0)
        for kind, pair in pairs.items():
            out = F.when(rank == KINDS.index(kind), _vote(*pair)).otherwise(out)
        return out

    cue = F.coalesce(*[F.when(rank == KINDS.index(k), before.rlike(c)) for k, c in CUES.items()])
    secret, loose = rank == KINDS.index("secret"), rank.isin([KINDS.index(k) for k in LOOSE])
    votes = {
        "form": by_kind(form), "gazetteer": by_kind(gazetteer), "cue": _vote(cue, loose & ~before.rlike(r"[\p{L}.][:=]\s*$")), "counter": _vote(no, before.rlike(COUNTER_CUES + r"[^=]*$")),
        "assigned": _vote(before.rlike(r"[=:]\s*[\"']?$|[\"']$"), secret & before.rlike(r"[a-z0-9]\s$")), "make_up": by_kind(make_up),
        "closed": _vote(~loose & after.rlike(r"^(?:[\"'.,;:!?)\s]|$)"), after.rlike(r"^[@/#]")),
    }
    return F.array(*[votes[name] for name in LABELERS])


def _features(x: Column) -> Column:
    """What the classifier sees of a span besides the votes; FEATURES has the number of values of each."""
    m, n = x["match"], F.length(x["match"])

    def bucket(v: Column, *ends: float) -> Column:
        return sum((F.when(v >= e, 1).otherwise(0) for e in ends), F.lit(0))

    distinct = F.size(F.array_distinct(F.split(m, ""))) / n
    classes = F.when(m.rlike(r"\p{Ll}"), 1).otherwise(0) + F.when(m.rlike(r"\p{Lu}"), 2).otherwise(0) + F.when(m.rlike("[0-9]"), 4).otherwise(0)
    last = F.right(x["before"], F.lit(1))
    return F.array(bucket(n, 8, 16, 24, 40), bucket(distinct, 0.25, 0.5, 0.75), classes, F.when(last.rlike(r"^\s?$"), 0).when(last.isin("'", '"'), 1).when(last.isin("=", ":"), 2).otherwise(3)).cast("array<int>")


def scan(text: Column) -> Column:
    """struct<base: array<struct<start, rank, end>>, maybe: array<struct<start, rank, end, votes, features>>>; rank is the place of the kind in KINDS."""
    secret = KINDS.index("secret")

    def apart(of: Column, from_: Column) -> Column:
        return F.when(F.size(from_) == 0, of).otherwise(F.filter(of, lambda c: ~F.exists(from_, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))))

    def holds(x: Column) -> Column:
        checks = F.lit(False)
        for k, check in CHECKS.items():
            checks = F.when(x["rank"] == KINDS.index(k), check(x["match"])).otherwise(checks)
        return checks

    def voted(x: Column) -> Column:
        return F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), _votes(x).alias("votes"), _features(x).alias("features"))

    def chosen(base: Column, loose: Column) -> Column:
        # A run that is a number of another kind is no secret.
        others, secrets = F.filter(loose, lambda x: x["rank"] != secret), F.filter(loose, lambda x: x["rank"] == secret)
        maybe = let(others, lambda o: F.concat(o, apart(secrets, o)))
        spans = F.transform(base, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end")))
        return F.struct(F.array_sort(spans).alias("base"), F.transform(apart(maybe, base), voted).alias("maybe"))

    def found(digit: Column) -> Column:
        gates = {"email": text.contains("@"), "phone": digit & text.contains("+"), **{k: digit for k in ("ip", "card", "secret", "ssn", "national_phone", "iban", "date", "address")}}
        return _matches(text, BASE | SHAPES, gates)

    return let(let(text.rlike("[0-9]"), found), lambda f: let(F.filter(f, lambda x: (x["rank"] < len(BASE)) & holds(x)), lambda b: chosen(b, F.filter(f, lambda x: x["rank"] >= len(BASE)))))


@dataclass
class Model:
    """Weights of the span classifier; without training it adds no span. reliability has the part of each labeler's votes
    that agree with the estimated truth, None where it casts none; shift has what a vote for, none and one against
    add to the log odds of a span. loose is the model of the kinds in LOOSE, which are many and mostly false: estimated with the
    others, they would turn what a labeler's vote says of these."""

    bias: dict[int, float] = field(default_factory=dict)
    yes: list[float] = field(default_factory=lambda: [0.0] * len(LABELERS))
    no: list[float] = field(default_factory=lambda: [0.0] * len(LABELERS))
    features: list[list[float]] = field(default_factory=lambda: [[0.0] * n for n in FEATURES])
    reliability: list[float | None] = field(default_factory=list)
    shift: list[tuple[float, float, float]] = field(default_factory=list)
    support: bool = False
    loose: Model | None = None

    def accepts(self, candidate: Column) -> Column:
        score = F.lit(0.0)
        for rank, b in self.bias.items():
            score = score + F.when(candidate["rank"] == rank, F.lit(b)).otherwise(F.lit(0.0))
        for i, (y, n) in enumerate(zip(self.yes, self.no, strict=True)):
            v = F.get(candidate["votes"], F.lit(i))
            score = score + F.when(v == 1, F.lit(y)).when(v == -1, F.lit(n)).otherwise(F.lit(0.0))
        for i, weights in enumerate(self.features):
            score = score + F.get(F.array(*[F.lit(w) for w in weights]), F.get(candidate["features"], F.lit(i)))
        own = candidate["rank"].isin(list(self.bias)) & (score > 0) if self.bias else F.lit(False)
        if self.support:
            own = own & F.exists(F.array(*[F.get(candidate["votes"], F.lit(LABELERS.index(k))) for k in SUPPORT]), lambda v: v == 1)
        return own | self.loose.accepts(candidate) if self.loose else own


#: Votes that each labeler is held to have cast before any data: (against, none, for) on true spans; on false ones reversed.
PRIOR_VOTES = (0.75, 2.0, 3.0)


def estimate(rank: np.ndarray, votes: np.ndarray, n: np.ndarray, rounds: int = 100, possible: np.ndarray | bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(truth, cast): the probability that each pattern (kind rank[i], votes[i] by all labelers, n[i] times) is true, and
    cast[t, l, v], the probability of vote v - 1 of labeler l on spans of truth t.

    Labelers are independent given the truth. Each kind has a prior of its own. The first guess counts votes.
    Patterns that are not possible are held to be false."""
    kinds = np.unique(rank)
    before = np.stack([np.tile(PRIOR_VOTES[::-1], (votes.shape[1], 1)), np.tile(PRIOR_VOTES, (votes.shape[1], 1))])
    truth = possible / (1 + np.exp(-1.4 * votes.sum(axis=1)))
    is_vote = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    cast = before
    for _ in range(rounds):
        weight = np.stack([(1 - truth) * n, truth * n])
        cast = before + np.einsum("tp,plv->tlv", weight, is_vote)
        cast = cast / cast.sum(axis=2, keepdims=True)
        odds = np.einsum("plv,lv->p", is_vote, np.log(cast[1]) - np.log(cast[0]))
        for k in kinds:
            of = rank == k
            part = (weight[1, of].sum() + 2) / (n[of].sum() + 4)
            odds[of] += math.log(part / (1 - part))
        truth = possible / (1 + np.exp(-np.clip(odds, -30, 30)))
    return truth, cast


def _design(rank: np.ndarray, votes: np.ndarray, features: np.ndarray, kinds: list[int]) -> np.ndarray:
    parts = [rank[:, None] == np.array(kinds), votes == 1, votes == -1]
    parts += [features[:, [i]] == np.arange(size) for i, size in enumerate(FEATURES)]
    return np.concatenate(parts, axis=1).astype(float)


def train(counts: list[tuple[int, tuple[int, ...], tuple[int, ...], int]], ridge: float = 1.0, support: bool = False) -> Model:
    """Model from (rank, votes, features, count) rows: probabilities from their votes, then a classifier that also sees features.
    With support, one of the labelers in SUPPORT must vote for a span."""
    if not counts:
        return Model(support=support)
    rank, n = np.array([r for r, *_ in counts]), np.array([float(c) for *_, c in counts])
    votes, features = np.array([v for _, v, _, _ in counts]), np.array([f for _, _, f, _ in counts])
    patterns, at = np.unique(np.c_[rank, votes], axis=0, return_inverse=True)
    truth, cast = estimate(patterns[:, 0], patterns[:, 1:], np.bincount(at.ravel(), n), possible=(patterns[:, [1 + LABELERS.index(k) for k in SUPPORT]] == 1).any(axis=1) | (not support))
    y = truth[at.ravel()]
    kinds = sorted(set(rank.tolist()))
    x = _design(rank, votes, features, kinds)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (n * (y - p)) - ridge * w)
        w = w + np.clip(step, -2, 2)
    width, right = len(LABELERS), []
    for i in range(width):
        some = votes[:, i] != 0
        agree = np.where(votes[some, i] == 1, y[some], 1 - y[some])
        right.append(round(float((agree * n[some]).sum() / n[some].sum()), 6) if some.any() else None)
    shift = np.log(cast[1]) - np.log(cast[0])
    ends = np.cumsum([len(kinds), width, width, *FEATURES])
    bias, yes, no, *rest = (v.round(9).tolist() for v in np.split(w, ends[:-1]))
    return Model(dict(zip(kinds, bias, strict=True)), yes, no, rest, right, [tuple(r[::-1]) for r in shift.round(6).tolist()], support)


def fit(candidates: DataFrame, maybe: str = "maybe", patterns: int = MODEL_PATTERNS) -> Model:
    """Train on the counts of patterns in all rows of an array column of candidates; of patterns beyond `patterns`, which
    is more than texts are known to have, the rarest are left out of training (no span is left out of the decision)."""
    counts = candidates.select(F.explode(maybe).alias("c")).groupBy("c.rank", "c.votes", "c.features").count()
    found = counts.orderBy(F.desc("count"), "rank", "votes", "features").limit(patterns).collect()
    rows = sorted((r["rank"], tuple(r["votes"]), tuple(r["features"]), r["count"]) for r in found)
    loose = {KINDS.index(k) for k in LOOSE}
    model = train([r for r in rows if r[0] not in loose])
    model.loose = train([r for r in rows if r[0] in loose], support=True)
    return model


def spans(found: Column, model: Model) -> Column:
    """Base spans and accepted candidates, by start and then kind."""
    more = F.transform(F.filter(found["maybe"], model.accepts), lambda c: F.struct(c["start"].alias("start"), c["rank"].alias("rank"), c["end"].alias("end")))
    return F.array_sort(F.concat(found["base"], more))


def show(of: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(of, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, text: str = "text") -> tuple[DataFrame, Model]:
    """docs without its text, with columns base and spans (arrays of start, rank, end), and the model that chose.

    A null text is an empty one. Rows are scanned one by one; repeated rows, null ids and empty tables need no care.
    Columns of docs that are called base, spans or found are replaced."""
    found = materialize(docs.withColumn("found", scan(text_of(text))).drop(text))
    model = fit(found, "found.maybe")
    return found.withColumn("base", F.col("found.base")).withColumn("spans", spans(F.col("found"), model)).drop("found"), model


def mask(text: Column, of: Column) -> Column:
    """text with each span replaced by <KIND>; spans that overlap become one mark, that of the first."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        mark = F.concat(text.substr((a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.get(names, s["rank"]))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.array(mark))).alias("out"))

    done = F.aggregate(of, start, step, lambda a: F.concat(F.array_join(a["out"], ""), text.substr((a["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(of) == 0, text).otherwise(done)


def redact(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """docs with personal data masked in `text`, and `length`, where docs has it, the new number of code points.

    A null text stays null; all rows stay."""
    name = fresh("found", docs)
    model = fit(docs.select(scan(text_of(text)).alias(name)), f"{name}.maybe")
    out = docs.withColumn(text, F.when(F.col(text).isNotNull(), let(scan(text_of(text)), lambda s: mask(F.col(text), spans(s, model)))))
    return out.withColumn(length, F.length(text).cast(docs.schema[length].dataType)) if length in docs.columns else out
