import hashlib
import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from lexivec.llm import pii
from lexivec.llm.common import running_sums
from lexivec.llm.queries import op7_pii


def luhn(d):
    return sum(int(x) if i % 2 == 0 else 2 * int(x) - 9 * (int(x) > 4) for i, x in enumerate(reversed(d))) % 10 == 0


BASE = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(d := re.sub("[ -]", "", m)) <= 19 and luhn(d)),
    (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def brute(text):
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(BASE) for m in re.finditer(p, text or "") if ok(m.group()))


CASES = [
    None, "", "a@b.c_d@e.f", "a@b.c.@d.e a@b", "1.2.3.4.5.6.7.8", "001.02.3.0255 256.1.1.1 1.2..3.4.5.6", "4111 1111 1111 1111", "4111-1111-1111-1111 +1 (555) 123-4567 é 192.168.1.1",
    "x" * 3000 + "@" + "y." * 3000 + "z", "1" * 5000, "1 " * 5000, "+1" + "2" * 9 + "(" * 10, "ééé@é.com é.x@y.zé@q.r", "x" * 300_000,
]


def test_base_spans_match_brute_force(spark):
    rng = random.Random(1)
    parts = ["a", "b@", ".", "1", "22", "333", "-", " ", "+", "@c.d", "4111111111111111", "(", ")", "é", "token=", '"']
    texts = CASES + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "a@b.c"), (0, None)], "doc_id long, text string").withColumn("base", F.lit(1)).withColumn("found", F.lit(1))
    found, _ = pii.find(docs)
    rows = [(r["doc_id"], [tuple(s) for s in r["base"]]) for r in found.collect()]
    assert len(rows) == len(texts) + 2
    for i, spans in rows:
        assert spans == brute("a@b.c" if i is None else texts[i])


def test_query_counts_kinds_wherever_they_stand(spark, tmp_path):
    mixed = ["a@b.co c@d.co é a@b.co", "10.0.0.1", "4111 1111 1111 1111", "+1 (555) 123-4567", "😀 +1 (555) 123-4567, 1.2.3.4; 4111111111111111 a@b.co 1.2.3.4 c@d.co"]
    texts = CASES + mixed + [" ".join(mixed) * 50]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op7_pii(spark, str(tmp_path)).collect()}
    assert got.keys() == set(range(len(texts)))
    for i, t in enumerate(texts):
        want, row = brute(t), got[i]
        shown = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want]
        assert [row[c] for c in ("n_email", "n_ip", "n_card", "n_phone")] == [sum(k == rank for _, k, _ in want) for rank in range(4)]
        assert row["base_sha256"] == hashlib.sha256(",".join(shown).encode()).hexdigest()
        assert [s for s in row["spans"].split(",") if s.split(":")[0] in pii.BASE] == shown


def test_labelers_vote_and_clean_texts_stay(spark):
    rng = random.Random(2)
    secret = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    number = lambda holds: next(d for d in iter(lambda: f"98{rng.randint(10**12, 10**13)}", "") if luhn(d) == holds)
    dirty = [f'here token = "{secret()}" ends' for _ in range(40)]
    clean = [f"order {number(False)} was sent with commit of the day" for _ in range(40)] + ["plain words " * 50]
    card = f"order {number(True)} was sent"
    docs = spark.createDataFrame(list(enumerate([*dirty, *clean, card])), "doc_id long, text string")
    found, model = pii.find(docs)
    got = {r["doc_id"]: (len(r["base"]), len(r["spans"])) for r in found.collect()}
    assert got == {i: (0, int(i < 40)) for i in range(81)} | {81: (1, 1)}
    assert len(model.reliability) == len(pii.LABELERS)
    out = {r["doc_id"]: r for r in pii.redact(docs.withColumn("n_chars", F.length("text")).withColumn("found", F.lit(1))).collect()}
    assert out[0]["text"] == 'here token = "<SECRET>" ends' and out[0]["n_chars"] == len(out[0]["text"])
    assert all(out[i]["text"] == t for i, t in enumerate(dirty + clean) if i >= 40) and out[81]["text"] == "order <CARD> was sent"


def test_secrets_with_late_digits(spark):
    texts = [f'token = "{"".join(random.Random(i).choice("abcdefgXYZ") for _ in range(n))}1234567890" end' for i, n in enumerate((20, 100, 3000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [len(r[0]) for r in docs.select(pii.scan(F.col("text"))["maybe"]).collect()] == [1, 1, 1]


SYLLABLES = "ta re mi lo su ven dar kel pri gos".split()


def planted(seed, n):
    """(text, spans (kind, value) that are personal data) with as many look-alikes that are not."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(2, 4)))
    words = lambda: " ".join(word() for _ in range(rng.randint(3, 12)))

    def iban():
        rest = digits(18)
        return f"DE{98 - int(rest + '131400') % 97:02}{rest}"

    key = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(36))
    ssn = lambda: f"{rng.randint(100, 599)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}"
    phone = lambda: f"({rng.randint(200, 989)}) {rng.randint(200, 989)}-{digits(4)}"
    born = lambda: f"{rng.randint(1, 28):02}.{rng.randint(1, 12):02}.{rng.randint(1930, 2005)}"
    person = lambda: f"{rng.choice(pii.FIRST_NAMES)} {word().capitalize()}"
    home = lambda: f"{rng.randint(1, 999)} {word().capitalize()} {rng.choice(['Street', 'Avenue', 'Road'])}"
    true = [("secret", "api key: ", key), ("ssn", "SSN: ", ssn), ("national_phone", "call ", phone), ("iban", "IBAN: ", iban), ("date", "born ", born), ("name", "contact: ", person), ("address", "home address: ", home)]
    false = [
        ("commit ", lambda: digits(18)), ("serial ", lambda: f"9{digits(2)}-00-{digits(4)}"), ("part ", lambda: f"{rng.randint(0, 199):03} {digits(3)} {digits(4)}@"), ("order ", lambda: f"DE00{digits(18)}"),
        ("published ", lambda: f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(2021, 2025)}"), ("model ", lambda: "-".join(["item", digits(2), word(), "x" * 14])),
    ]
    for _ in range(n):
        parts, want = [words()], []
        for _ in range(rng.randint(0, 3)):
            kind, cue, make = rng.choice(true)
            value = make()
            want.append((kind, value))
            parts += [cue + value + ".", words()]
        for _ in range(rng.randint(0, 3)):
            cue, make = rng.choice(false)
            parts += [cue + make(), words()]
        yield " ".join(parts), want


def test_precision_and_recall_of_planted_spans(spark, capsys):
    rows = list(planted(3, 1500))
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    found, model = pii.find(docs)
    got = {(r["doc_id"], pii.KINDS[s["rank"]], rows[r["doc_id"]][0][s["start"] : s["end"]]) for r in found.collect() for s in r["spans"] if s["rank"] >= len(pii.BASE)}
    want = {(i, k, v) for i, (_, spans) in enumerate(rows) for k, v in spans}
    precision, recall = len(got & want) / len(got), len(got & want) / len(want)
    with capsys.disabled():
        print(f"\nop7: precision {precision:.3f}, recall {recall:.3f} of {len(want)} planted spans; reliability {dict(zip(pii.LABELERS, model.reliability, strict=True))}")
    assert precision >= 0.95 and recall >= 0.95


def brute_estimate(items, rounds):
    """Expectation maximisation item by item, as its definition says, for (rank, votes) items."""
    guess = [1 / (1 + math.exp(-1.4 * sum(v))) for _, v in items]
    width = len(items[0][1])
    for _ in range(rounds):
        cast = [[dict(zip((-1, 0, 1), pii.PRIOR_VOTES[:: 1 if t else -1], strict=True)) for _ in range(width)] for t in (0, 1)]
        prior = {}
        for (rank, votes), p in zip(items, guess, strict=True):
            one = prior.setdefault(rank, [2.0, 4.0])
            one[0] += p
            one[1] += 1
            for i, v in enumerate(votes):
                cast[0][i][v] += 1 - p
                cast[1][i][v] += p
        guess = []
        for rank, votes in items:
            a, b = prior[rank][0] / prior[rank][1], 1 - prior[rank][0] / prior[rank][1]
            for i, v in enumerate(votes):
                a *= cast[1][i][v] / sum(cast[1][i].values())
                b *= cast[0][i][v] / sum(cast[0][i].values())
            guess.append(a / (a + b))
    return guess


def test_estimates_match_brute_force_and_bad_labelers_lose_their_weight():
    rng = np.random.default_rng(6)
    truth = rng.random(3000) < 0.4
    side = np.where(truth, 1, -1)

    def labeler(right, speaks):
        return np.where(rng.random(3000) < speaks, np.where(rng.random(3000) < right, side, -side), 0)

    votes = np.stack([labeler(0.9, 0.8), labeler(0.85, 0.7), labeler(0.95, 0.5), labeler(0.5, 0.9), np.ones(3000, int), labeler(0.15, 0.8), np.zeros(3000, int)], axis=1)
    rank = rng.integers(4, 6, 3000)
    patterns, n = np.unique(np.c_[rank, votes], axis=0, return_counts=True)
    got, cast = pii.estimate(patterns[:, 0], patterns[:, 1:], n.astype(float), rounds=8)
    items = [(int(r), tuple(v.tolist())) for r, v in zip(rank, votes, strict=True)]
    by_pattern = dict(zip(items, brute_estimate(items, 8), strict=True))
    assert np.allclose(got, [by_pattern[int(r), tuple(v)] for r, *v in patterns.tolist()], atol=1e-9)

    features = [tuple([0] * len(pii.FEATURES))] * len(patterns)
    model = pii.train([(int(r), tuple(v), f, int(c)) for (r, *v), f, c in zip(patterns.tolist(), features, n, strict=True)])
    assert all(abs(model.reliability[i] - r) < 0.05 for i, r in ((0, 0.9), (1, 0.85), (2, 0.95), (3, 0.5), (5, 0.15))) and model.reliability[6] is None
    assert abs(model.yes[3]) < 0.3 and abs(model.shift[4][0]) < 0.05 and model.yes[5] < -0.5 < 0.5 < model.yes[0]


def test_features_move_the_decision():
    """Spans with the same votes are told apart by what they look like."""
    rows = []
    for length, votes, n in ((3, (1, 0, 1, 0, 1, 1, 1), 400), (0, (-1, 0, 0, -1, 0, -1, 1), 400), (3, (0, 0, 0, 0, 0, 0, 1), 30), (0, (0, 0, 0, 0, 0, 0, 1), 30)):
        rows.append((4, votes, (length, 2, 5, 0), n))
    model = pii.train(rows)
    assert model.features[0][3] > 0 > model.features[0][0]


def test_redaction_of_overlaps_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "mail a@b.org, call +1 (555) 123-4567; 4111 1111 1111 1111 é 10.0.0.1."), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert got == {1: "mail <EMAIL>, call <PHONE>; <CARD> é <IP>.", 2: None}
    assert pii.redact(docs.limit(0)).count() == 0
    found, model = pii.find(docs.limit(0))
    assert found.count() == 0 and not model.bias


def test_running_sums(spark):
    for n in (0, 1, 2, 9, 10, 101):
        v = list(range(1, n + 1))
        got = spark.range(1).select(running_sums(F.array(*map(F.lit, v)).cast("array<bigint>"))).first()[0]
        assert got == [sum(v[:i]) for i in range(n + 1)]


def test_plan_is_native(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert "Python" not in pii.redact(docs)._jdf.queryExecution().toString()


def test_shapes_alone_make_candidates(spark):
    """Values that no list has are candidates, whatever their cue."""
    values = {
        "name": ["Nguyen Van Lan", "Olumide Adebayo", "Priya Sharma", "Heinrich Vogel", "Siobhan O'Brien", "Ludwig van der Berg", "Prof. Okafor", "Anna-Lena McDonald"],
        "address": ["12 Elm Terrace", "7b Quiet Willow Row", "Lindenallee 12", "rue de Rivoli 5"],
        "date": ["3 May 1980", "May 3, 1980", "3. März 1980", "3 de mayo de 1980", "1980-05-03"], "ssn": ["123 45 6789", "123-45-6789"],
    }
    rows = [(i, k, v, f"{cue}{v}, as said") for i, (k, v, cue) in enumerate((k, v, c) for k, vs in values.items() for v in vs for c in ("contact: ", "lives at ", "seen near "))]
    docs = spark.createDataFrame([(i, t) for i, _, _, t in rows], "doc_id long, text string")
    got = {r["doc_id"]: {(pii.KINDS[c["rank"]], c["start"], c["end"]) for c in r["maybe"]} for r in docs.select("doc_id", pii.scan(F.col("text"))["maybe"].alias("maybe")).collect()}
    for i, k, v, t in rows:
        assert (k, t.index(v), t.index(v) + len(v)) in got[i], t


#: Names, streets and labels that stand in no list or cue of the operator.
GIVEN = "Olumide Priya Heinrich Siobhan Nguyen Yusuf Ingrid Tadeusz Aiko Bronwen Dmitri Fatoumata Giulia Hamza Itziar Leilani".split()
FAMILY = "Adebayo Sharma Vogel Okonkwo Lindqvist Petrov Tanaka Moreau Castellanos Haddad Novak Jansen Kowalski Mbeki Rossi Eriksen".split()
PLACES = "Elm Willow Harbour Quarry Juniper Chestnut Abbey Mill Orchard Foundry".split()
WAYS = "Row Mews Grove Parade Walk Rise".split()


def unlisted(seed, n):
    """(text, spans (kind, value)): personal data of unlisted values, half of them after a label that is no cue, and look-alikes."""
    rng = random.Random(seed)
    pick = rng.choice
    month = lambda: pick("January March May July October".split())
    person = lambda: f"{pick(GIVEN)} {pick(FAMILY)}"
    home = lambda: f"{rng.randint(1, 300)} {pick(PLACES)} {pick(WAYS)}"
    born = lambda: f"{rng.randint(1, 28)} {month()} {rng.randint(1930, 2005)}"
    number = lambda: f"{rng.randint(100, 599)} {rng.randint(10, 99)} {rng.randint(1000, 9999)}"
    true = [("name", ("caller ", "patient ", "bearer: ", "occupant: "), person), ("address", ("lives at ", "home: ", "premises: ", "deliver: "), home), ("date", ("born ", "birth date ", "arrival in the world: ", "b.: "), born), ("ssn", ("SSN ", "social security ", "insured: ", "number: "), number)]
    false = [
        lambda: f"so the {pick(PLACES)} {pick(WAYS)} Institute of", lambda: f"ended. {pick(PLACES)} {pick('Stones Rivers Hills'.split())} were", lambda: f"the {pick('General Free New Open'.split())} {pick(PLACES)} Society",
        lambda: f"topic: {pick(PLACES)} {pick('Stones Rivers Hills'.split())} in",
        lambda: f"published {rng.randint(1, 28)} {month()} {rng.randint(2021, 2025)}", lambda: f"in {pick('Section Chapter Figure Table'.split())} {rng.randint(1, 99)}", lambda: f"sold {rng.randint(1, 99)} {pick('Tulip Apple Lamp'.split())}s", lambda: f"on {rng.randint(1, 28)} barrels 1{rng.randint(100, 999)}",
    ]
    plain = lambda: " ".join("".join(pick(SYLLABLES) for _ in range(2)) for _ in range(rng.randint(6, 12)))
    for _ in range(n):
        parts, want = [plain()], []
        for _ in range(rng.randint(0, 3)):
            kind, labels, make = pick(true)
            value = make()
            want.append((kind, value))
            parts += [pick(labels) + value + ".", plain()]
        for _ in range(rng.randint(0, 4)):
            parts += [pick(false)(), plain()]
        yield " ".join(parts), want


def test_precision_and_recall_of_unlisted_values(spark, capsys):
    assert not set(GIVEN) & set(pii.FIRST_NAMES) and not set(WAYS) & set(pii.STREETS)
    rows = list(unlisted(4, 1500))
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    found, model = pii.find(docs)
    got = {(r["doc_id"], pii.KINDS[s["rank"]], rows[r["doc_id"]][0][s["start"] : s["end"]]) for r in found.collect() for s in r["spans"] if s["rank"] >= len(pii.BASE)}
    want = {(i, k, v) for i, (_, spans) in enumerate(rows) for k, v in spans}
    with capsys.disabled():
        for kind in ("name", "address", "date", "ssn"):
            g, w = {x for x in got if x[1] == kind}, {x for x in want if x[1] == kind}
            print(f"\nop7, unlisted {kind}: precision {len(g & w) / max(1, len(g)):.3f}, recall {len(g & w) / len(w):.3f} of {len(w)}", end="")
        print(f"\nop7, unlisted: precision {len(got & want) / len(got):.3f}, recall {len(got & want) / len(want):.3f} of {len(want)}; reliability {dict(zip(pii.LABELERS, model.reliability, strict=True))}")
    assert len(got & want) / len(got) >= 0.8 and len(got & want) / len(want) >= 0.8
    can = [*range(len(pii.LABELERS) - 1)]  # an end of text speaks against a loose shape only
    assert all(model.loose.reliability[i] is not None for i in can) and model.reliability[-1] is not None


def test_loose_shapes_do_not_turn_the_votes_of_others(spark):
    """Thousands of capitalised runs without any cue neither become names nor make numbers secrets."""
    rng = random.Random(5)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    number = lambda: next(d for d in iter(lambda: f"98{rng.randint(10**13, 10**14 - 1)}", "") if not luhn(d))
    texts = [f'here token = "{key()}" ends' for _ in range(60)] + [f"was lost {number()} again" for _ in range(60)]
    texts += ["Orre Orre Orre Orre. Then Willow Stones went to Mill Harbour Row Quarry Abbey " * 30] * 60
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found, model = pii.find(docs)
    assert {r["doc_id"]: len(r["spans"]) for r in found.collect()} == {i: int(i < 60) for i in range(180)}
