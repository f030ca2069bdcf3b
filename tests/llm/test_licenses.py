import random

import numpy as np
from pyspark.sql import functions as F

from lexivec.llm import licenses

LINES = [t for _, t in licenses.NOTICES]


def test_spans_of_planted_notices(spark):
    rng = random.Random(8)
    rows, want = [], []
    for i in range(300):
        words = ["".join(rng.choice("aeioustné") for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(0, 80))]
        text = " ".join(words)
        if i % 3:
            name, line = licenses.NOTICES[i % len(licenses.NOTICES)]
            before = text + "\n" if text else ""
            text = before + line + " " + " ".join(words[:5])
            end = len(line) - len(line.rstrip(".")) + 0
            want.append((i, name, len(before), len(before) + len(line) - end, 1.0))
        rows.append((i, text))
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (None, LINES[0]), (902, LINES[0] + "\n")] + [(902, LINES[0] + "\n")], "doc_id long, text string").withColumn("license", F.lit(1))
    out = licenses.scan(docs).collect()
    got = [(r["doc_id"], r["license"], r["start"], r["end"], r["coverage"]) for r in out]
    more = [(i, "Apache-2.0", 0, len(LINES[0]) - 1, 1.0) for i in (None, 902, 902)]
    assert sorted(got, key=repr) == sorted(want + more, key=repr)
    assert licenses.scan(docs.limit(0)).count() == 0


def test_changed_notices():
    s = licenses.Scanner(licenses.TEMPLATES, licenses.COVERAGE)
    name, start, end, matched, n, cover = s.scan("x y. This big work is LICENSED under the GNU General Public Licence, version 3. z")[0]
    assert (name, matched, n) == ("GPL-3.0-only", 11, 12) and start == 5 and cover == 11 / 12
    assert [m[0] for m in s.scan("Licensed under CC BY 4.0. " * 50)] == ["CC-BY-4.0"] * 50
    assert [m[0] for m in s.scan("Licensed under CC BY-NC 4.0. " * 3)] == ["CC-BY-NC-4.0"] * 3
    assert s.scan("all the rights of the reserved are under the version of a license " * 30) == []


def test_every_changed_or_deleted_word_of_short_notices():
    s, rng = licenses.Scanner(licenses.TEMPLATES, licenses.COVERAGE), random.Random(6)
    for line in (t for t in LINES if 5 <= len(s.words(t.encode())[0]) <= 9):
        words = line.split()
        n = len(s.words(line.encode())[0])
        for i in range(len(words)):
            if len(s.words(words[i].encode())[0]) > 1:
                continue
            for new in (["an"], ["those"], []):
                changed = words[:i] + new + words[i + 1 :]
                for _ in range(20):
                    around = ["".join(rng.choice("qxzjk") for _ in range(6)) for _ in range(6)]
                    got = s.scan(" ".join([*around[:3], *changed, *around[3:]]))
                    assert len(got) == 1 and got[0][3] >= licenses.COVERAGE * got[0][4], (n, changed, got)


def test_bsd_clauses():
    s = licenses.Scanner(licenses.TEMPLATES, licenses.COVERAGE)
    shared, own = (next(t for n, t in licenses.NOTICES if n == f"BSD-{k}-Clause") for k in (2, 3))
    names = lambda text: [m[0] for m in s.scan(text)]
    assert names(f"{shared}: a. b.") == ["BSD-2-Clause"]
    assert names(f"{shared}: a. b. {own}. c") == ["BSD-3-Clause"] * 2
    assert names(f"{shared}: a. {shared}: b. {own}. {shared}") == ["BSD-2-Clause", "BSD-3-Clause", "BSD-3-Clause", "BSD-2-Clause"]


def whole(t, x):
    """The best local alignment of t in x without a band: (score, matched, start, end)."""
    rows, best = [[(0, 0, -1)] * (len(x) + 1)], (0, 0, 0, 0)
    for a in t:
        row = [(0, 0, -1)]
        for j, b in enumerate(x):
            s, m, at = rows[-1][j]
            options = [(s + (2 if a == b else -1), m + (a == b), j if at < 0 else at)]
            options += [(s - 1, m, at) for s, m, at in (rows[-1][j + 1], row[j])]
            top = max(options)
            row.append(top if top[0] > 0 else (0, 0, -1))
            if row[-1][:2] > best[:2]:
                best = (*row[-1], j + 1)
        rows.append(row)
    return best


def brute(s, text):
    """Licences and words of what a scan without index and bands finds: each template's best places, one after another."""
    hashes = s.words(text.encode())[0].tolist()
    found = []
    for k, t in enumerate(s.templates):
        left = list(hashes)
        while True:
            score, matched, a, b = whole(t.tolist(), left)
            if not matched or matched < s.coverage * len(t):
                break
            found.append((-score, -matched / len(t), k, a, b, matched))
            left[a:b] = [-1] * (b - a)
    return [(s.templates[k].tolist(), a, b, m) for k, a, b, m, _ in sorted(licenses.chosen(found), key=lambda x: x[1])]


def test_scan_matches_brute_force():
    rng = random.Random(12)
    s = licenses.Scanner(licenses.TEMPLATES, licenses.COVERAGE)
    for i in range(30):
        name, line = licenses.TEMPLATES[(i * 7 + 2) % len(licenses.TEMPLATES)]
        words = line.split()
        for _ in range(int(len(words) * rng.choice([0, 0.05, 0.1]))):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([["zzz"], [], [words[at], "yyy"]])
        around = [["".join(rng.choice("qxzjk") for _ in range(6)) for _ in range(rng.randint(0, 12))] for _ in range(2)]
        text = " ".join([*around[0], *words, *around[1]])
        hashes = s.words(text.encode())[0]
        got = licenses.chosen([(-sc, -m / len(s.templates[k]), k, a, b, m) for sc, m, k, a, b in s.matched(hashes)])
        assert [(s.templates[k].tolist(), a, b, m) for k, a, b, m, _ in sorted(got, key=lambda x: x[1])] == brute(s, text), (name, text)


def test_whole_licence_texts():
    s = licenses.Scanner(licenses.TEMPLATES, licenses.COVERAGE)
    for name, text in licenses.FULL_TEXTS:
        (got,) = s.scan(f"Copyright 2020 A. Body\n\n{text}\n\nint main;")
        assert (got[0], got[5]) == (name, 1.0) and got[3] == got[4] and got[1] == 24
    assert len(s.scan("\n".join(t for _, t in licenses.FULL_TEXTS))) == len(licenses.FULL_TEXTS)


def test_many_notices():
    s = licenses.Scanner(licenses.TEMPLATES, licenses.COVERAGE)
    assert len(s.scan("\n".join(f"file {i}. {licenses.NOTICES[0][1]}" for i in range(3000)))) == 3000


def test_winnowing_guarantee():
    rng = np.random.default_rng(3)
    for _ in range(50):
        grams = rng.integers(0, 50, int(rng.integers(1, 40))).astype(np.uint64)
        kept = set(licenses.winnow(grams).tolist())
        for i in range(len(grams) - licenses.WINDOW + 1):
            assert kept & set(range(i, i + licenses.WINDOW))


def test_alignment_is_the_best_within_its_band():
    def full(t, x):
        best = (0, 0)
        rows = [[(0, 0)] * (len(x) + 1) for _ in range(len(t) + 1)]
        for i, a in enumerate(t, 1):
            for j, b in enumerate(x, 1):
                s, m = rows[i - 1][j - 1]
                up, left = rows[i - 1][j], rows[i][j - 1]
                top = max((s + (2 if a == b else -1), m + (a == b)), (up[0] - 1, up[1]), (left[0] - 1, left[1]))
                rows[i][j] = top if top[0] > 0 else (0, 0)
                best = max(best, rows[i][j])
        return best

    rng = random.Random(1)
    for _ in range(200):
        t, x = [[rng.randint(0, 3) for _ in range(rng.randint(1, 9))] for _ in range(2)]
        assert licenses.align(t, x, 0, 12)[:2] == full(t, x)
