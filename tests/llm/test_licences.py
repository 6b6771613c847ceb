import math
import random
from collections import Counter

import pytest

from redbuild.llm import licences as L


def files(spark, rows):
    return spark.createDataFrame(rows, "path string, text string")


def test_lines_and_files_are_found(spark):
    rows = [
        ("a/x.c", "code\nReleased under the MIT License.\nmore code here"), ("a/y.c", "nothing of the sort"),
        ("b/z.c", "LICENSED under the apache license, version 2.0!"), ("c/w.c", "the license of this is a version of the work"),
        ("d/v.c", None), ("d/u.c", ""), ("e/t.c", "Licensed under CC BY 4.0."), ("e/s.c", "Licensed under CC BY-NC 4.0."),
    ]
    got = {r["path"]: (r["licence"], r["line"]) for r in L.own_licences(files(spark, rows)).collect()}
    assert got == {
        "a/x.c": ("MIT", 1), "a/y.c": (None, None), "b/z.c": ("Apache-2.0", 0), "c/w.c": (None, None), "d/v.c": (None, None),
        "d/u.c": (None, None), "e/t.c": ("CC-BY-4.0", 0), "e/s.c": ("CC-BY-NC-4.0", 0),
    }


def test_scores_equal_plain_cosines(spark):
    rows = [("p", "under the MIT License of old"), ("q", "version 3 of the GNU General Public License\nreleased under license"), ("r", "zzz yyy")]
    n, df = L.document_counts(files(spark, rows), L.TEMPLATES)
    assert n == 3 and df[b"license"] == 2 and df[b"mit"] == 1
    scanner = L.Scanner(L.TEMPLATES, n, df, 0.3)
    bag = lambda t: Counter(L.tokens(L.cleaned(t)))
    weight = lambda w: scanner.idf.get(w, scanner.other)
    norm = lambda b: math.sqrt(sum((c * weight(w)) ** 2 for w, c in b.items()))
    for _, text in rows:
        best = 0
        for unit in [*text.split("\n"), text]:
            for _, template in L.TEMPLATES:
                a, b = bag(unit), bag(template)
                best = max(best, sum(a[w] * b[w] * weight(w) ** 2 for w in a) / (norm(a) * norm(b)))
        got = scanner.scan(text)[1]
        assert abs(got - best) < 1e-9 if best >= 0.3 else got <= best + 1e-9


def test_nearest_directory_passes_its_licence_on(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [
        ("LICENSE", mit), ("top.c", "code"), ("a/b/COPYING.txt", f"Some words before.\n{apache}\n" + "and quite some more " * 20),
        ("a/b/c/d/deep.c", "code"), ("a/other.c", "code"), ("a/b/own.c", f"code\n{mit}\ncode and more code that is long enough " * 1),
        ("a/b/header.c", f"{mit}\n" + "code " * 50), (None, "code"),
    ]
    got = {r["path"]: (r["effective"], r["inherited_from"]) for r in L.with_inherited(L.own_licences(files(spark, rows))).collect()}
    assert got["a/b/c/d/deep.c"] == ("Apache-2.0", "a/b/COPYING.txt")
    assert got["a/other.c"] == ("MIT", "LICENSE") and got["top.c"] == ("MIT", "LICENSE")
    assert got["a/b/header.c"] == ("MIT", None) and got[None] == (None, None)


def test_bare_wrapped_and_full_notices(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met"
    full = dict(L.full_texts())
    words = "/* ".join(f"{w}\n" for w in dict(L.TEMPLATES)["ISC"].split())
    prose = "\n".join(f"some prose of line {i} and more" for i in range(40))
    rows = [
        ("a", f"{prose}\nAll rights reserved.\n{prose}"), ("b", "// Copyright (c) 2020 Acme.\n// All rights reserved.\ncode"),
        ("c", "# " + bsd.replace("\n", "\n# ") + "\n# " + prose), ("d", f"Copyright 2001. All rights reserved.\n\n{bsd}:\n{prose}"),
        ("e", f"{prose}\n{words}\n{prose}"), ("f", "all the rights of man are reserved for others and so on"), ("g", prose),
        *((f"full/{name}", text.replace("<holder>", "Jo Doe").replace("<year>", "1999")) for name, text in full.items()),
    ]
    got = {r["path"]: (r["licence"], r["line"]) for r in L.own_licences(files(spark, rows)).collect()}
    assert got["a"] == ("Proprietary", 40) and got["b"][0] == "Proprietary"
    assert got["c"] == ("BSD-3-Clause", 0) and got["d"] == ("BSD-3-Clause", 2)
    assert got["e"] == ("ISC", 40) and got["f"] == got["g"] == (None, None)
    assert all(got[f"full/{name}"] == (name, None) for name in full), [(n, got[f"full/{n}"]) for n in full]


def test_odd_input(spark, odd, empty):
    from pyspark.sql import functions as F

    named = odd.withColumn("path", F.when(F.col("doc_id") != 7, F.concat(F.lit("x/"), F.col("doc_id").cast("string"))))
    got = L.with_inherited(L.own_licences(named))
    assert got.count() == odd.count() and got.filter("effective IS NOT NULL").count() == 0
    assert L.with_inherited(L.own_licences(empty.withColumn("path", F.lit("x")))).count() == 0


def test_groups_of_lines_of_any_length_equal_brute_force():
    rng = random.Random(1)
    words = [w for _, text in L.TEMPLATES for w in text.split()]
    counts = Counter(w for _, text in L.TEMPLATES for w in L.tokens(L.cleaned(text)))
    scanner = L.Scanner(L.TEMPLATES, 1_000, {w: 40 * n for w, n in counts.items()}, L.LEAST)

    def other_lines():
        return [" ".join(rng.choice([*words, *(f"q{i}" for i in range(60))]) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 4))]

    reached = long = 0
    for _ in range(120):
        notice = rng.choice(L.TEMPLATES)[1].split() * rng.choice([1, 1, 6, 12])
        if rng.random() < 0.5:  # words of a repeated notice in any order make long groups
            rng.shuffle(notice)
        notice = [w if rng.random() < 0.93 else f"z{rng.randrange(9)}" for w in notice]
        lines = []
        while notice:
            n = rng.randint(1, 9)
            lines.append(" ".join(notice[:n]))
            notice = notice[n:]
        bags = [Counter(L.tokens(line)) for line in L.cleaned("\n".join(other_lines() + lines + other_lines())).split(b"\n")]
        scores = {(i, j): scanner.best(sum(bags[i:j], Counter()))[0] for i in range(len(bags)) for j in range(i + 1, len(bags) + 1)}
        best = max(scores, key=scores.get)
        if scores[best] >= L.LEAST:
            assert scanner.closest(bags)[0] == pytest.approx(scores[best], abs=1e-9)
            reached += 1
            long += sum(sum(bag.values()) for bag in bags[slice(*best)]) > 60
    assert reached > 60 and long > 10
